from stallmark.llm.canonical import Matcher, edits, map_values, name_of

CITIES = [
    name_of(text, ref, region, code)
    for ref, names, region, code in (
        (1, ["Hilashilm", "Dosabad"], "Kakbhibel", "KA"), (2, ["Kresaarand"], "Jiyaari", "JI"), (3, ["Kresaarand"], "Prarvdandga", "PR"), (4, ["Neyashla"], "Kunprakro", "KU"),
        (5, ["New Hilashilm"], "Kregelu", "KE"), (6, ["Port Vandrika East"], "Kregelu", "KE"),
    )
    for text in names
]


def test_edits():
    assert [edits("abcd", b, 2) for b in ("abcd", "abdc", "abd", "axyd", "zzzz")] == [0, 1, 1, 2, 3]


def test_matching():
    m = Matcher(CITIES)
    for value, want in (
        ("Hilashilm", 1), ("HILASHILM, Kakbhibel", 1), ("Hilasheelm", 1), ("H1lash1lm", 1), ("hlashilm", 1), ("dosabad", 1), ("Kresaarand (PR)", 3), ("Jiyaari - Kresaarand", 2),
        ("Neyashla Highway, Hilashilm", 1), ("new hilashilm", 5), ("Neyashla Road, Elsewhere", 0), ("Kakbhibel only", 0), ("unknown", 0), ("?", 0), ("123456", 0), ("Kresaaránd, JI", 2),
        # sets of tokens: other order, a typo in each of several tokens, one token of three left out, glued, too little
        ("Hilashilm New", 1), ("east port vandrica", 6), ("Prot Vandrikka Esat", 6), ("Vandrikka East", 6), ("newhilashilm", 5), ("Port of Calls", 0),
    ):
        assert m.resolve(value)[0] == want, value
    assert Matcher([]).resolve("Hilashilm")[0] == 0


def test_table(spark):
    c = spark.createDataFrame([(1, "brand", "Kishkova", None, None, ["Other"]), (2, "city", "Kishkova", None, None, None), (3, "brand", None, None, None, [])], "ref_id bigint, kind string, name string, state_name string, state_code string, aliases array<string>")
    df = spark.createDataFrame([(1, "kishk.ova", 9), (2, None, 9), (3, " ​", 9), (4, "no brand", 9), (4, "no brand", 9), (5, "other ltd", 9)], "record_id int, brand string, ref_id int")
    assert sorted((r.record_id, r.ref_id) for r in map_values(df, "record_id", "brand", c, "brand").collect()) == [(1, 1), (4, 0), (4, 0), (5, 1)]
    assert {r.ref_id for r in map_values(df, "record_id", "brand", c.limit(0), "brand").collect()} == {0}
    assert map_values(df.limit(0), "record_id", "brand", c, "brand").count() == 0


def test_parts_decide_like_one_list(spark):
    rows = [(1, "city", "Hilashilm", "Kakbhibel", "KA", ["Dosabad"]), (2, "city", "Kresaarand", "Jiyaari", "JI", []), (3, "city", "Kresaarand", "Prarvdandga", "PR", None), (4, "city", "New Hilashilm", "Kregelu", "KE", []), (5, "city", "Port Vandrika East", "Kregelu", "KE", ["PVE Harbour"])]
    c = spark.createDataFrame(rows, "ref_id bigint, kind string, name string, state_name string, state_code string, aliases array<string>")
    values = ["Hilashilm", "hilashlim", "new hilashilm", "Kresaarand, JI", "Kresaarand (Prarvdandga)", "Vandrikka East Port", "dosabaad", "nowhere at all", "Jiyaari", "Kregelu", "Hilash", None, " "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 2)], "record_id int, v string")
    one, many = (sorted((r.record_id, r.value, r.ref_id, round(r.score, 6)) for r in map_values(df, "record_id", "v", c, "city", at_once=n).collect()) for n in (1000, 2))
    assert one == many and {r[2] for r in one} >= {0, 1, 2, 3, 4, 5}
