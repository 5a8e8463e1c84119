import random

from stallmark.llm import truncation

WORDS = "the seller checked the panel and the buyer returned a charger after one week because it was noisy".split()


def test_finds_cut_texts(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(400):
        sentences = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + rng.choice([".", "!"]) for _ in range(8)]
        t = " ".join(sentences) + rng.choice(["", "", "\nThanks", "\nEdit: solved"])
        if i % 5 == 0:
            t = " ".join(sentences)[: rng.randrange(150, 260)].rstrip()
            if t[-1] in ".!":
                t = t[:-1]
            cut.add(i)
            t += rng.choice(["", "…", " [more]"])
        rows.append((i, t, "a" if i % 2 else None, "en", 0))
    rows += [(900, None, "a", "en", 0), (901, "  ", "a", None, 0), (902, rows[0][1], None, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, id int")
    s = truncation.find_cut(truncation.score_ends(df)).collect()
    assert len(s) == 401
    got = {r.id for r in s if r.cut} - {902}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 4
    rate = {r.source: r for r in truncation.rates(truncation.find_cut(truncation.score_ends(df))).collect()}
    assert rate["a"]["values"] == 200


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string, source string, lang string")
    assert truncation.score_ends(e).count() == 0


def _texts(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + f" for Rs. {rng.randrange(100, 999)} in all." for _ in range(5)]
        rows.append((i, " ".join(parts) + rng.choice(["", "\nhttps://shop.example/" + rng.choice(WORDS) + str(rng.randrange(9))]), "ab"[i % 2], "en"))
    return rows


def test_final_marks_and_links_are_scored(spark):
    rows = _texts(400)
    for i in range(8):
        rows[i] = (i, rows[i][1][: rows[i][1].index("Rs.", 120) + 3], *rows[i][2:])  # ends with a final mark, yet was cut
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r.id for r in truncation.find_cut(truncation.score_ends(df)).filter("cut").collect()}
    assert got == set(range(8))


def test_passes_change_nothing(spark):
    df = spark.createDataFrame(_texts(120) + [(500, "x", None, None), (501, "…", "a", "hi"), (502, "a" * 50_000, "a", "en")], "doc_id bigint, text string, source string, lang string")
    one, many = ({r.id: round(r.log_odds, 9) for r in truncation.score_ends(df, most_bits=b).collect()} for b in (27, 14))
    assert one == many and len(one) == 123 and one[501] == -10.0


def test_thresholds_are_fitted_per_language():
    heap = {-30: 500, -29: 50, 20: 3000, 21: 200}
    t = truncation._valley(heap)
    assert -5 < t < 1.5 and truncation._valley({3: 10}) is None
    assert truncation._valley({**heap, **{b: 9 for b in range(-20, -6)}}) > -1.5
