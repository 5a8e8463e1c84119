"""Queries over small tables of their own: each does the whole job."""

import __spark_entry__

from stallmark.functions import text


def run(spark, folder, name, **tables):
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return __spark_entry__.queries()[name](spark, str(folder)).collect()


def test_all_cues_claims_and_lexicons(spark, tmp_path):
    t = spark.createDataFrame([(1, "Sealed phone, sealed, with bill, 2 months old, repaired", "with box and bill"), (2, None, None)], "record_id bigint, title string, description string")
    got = {r.record_id: r.cues for r in run(spark, tmp_path, "condition_parse", synthetic_listings=t)}
    assert got == {1: "2 months old|Sealed|sealed|with bill|repaired", 2: ""}  # as written
    assert {r.record_id: r.claims for r in run(spark, tmp_path, "claims")} == {1: "1:Invoice / GST Bill Available=bill", 2: ""}
    docs = spark.createDataFrame([(1, "s", "en", "phone, company office"), (2, "s", "en", "phone")], "doc_id bigint, source string, lang string, text string")
    r = run(spark, tmp_path, "lexicon_by_family", documents=docs)[0].asDict()
    assert set(r) == {"lang", "n", *(f"{n}_rate" for n in text.LEXICONS)} and r["company_claims_rate"] == 0.5


def test_html_listing_takes_every_row(spark, tmp_path):
    titles = ['TV 32" \\ new', "a</script><h1>b</h1> & c", None, "rent ₹ 700", "plain", "far", "tiny", "nan"]
    prices = [1e6, 25000000.0, 5.0, None, -1.0, 12345678.25, 0.0001, float("nan")]
    rows = [(i, t, p, f"https://x.example/iid-{i}234567") for i, (t, p) in enumerate(zip(titles, prices))]
    o = spark.createDataFrame(rows, "record_id bigint, title string, price double, listing_url string")
    got = {r.record_id: (r.title, r.price, r.listing_id) for r in run(spark, tmp_path, "html_listing", olx_listings=o)}
    assert got == {i: (t, None if p != p else p, f"{i}234567") for i, t, p, _ in rows}


def test_jaccard_copies_have_a_class_and_links(spark, tmp_path):
    texts = ["a b c d e f g h i", "i h g f e d c b a a", "a b c d e f g h", "a b c d e f g h", "x y z", "x y"]
    docs = spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(texts)], "doc_id bigint, source string, lang string, text string")
    assert [(r.a, r.b) for r in run(spark, tmp_path, "jaccard_pairs", documents=docs)] == [(0, 2)]
    got = sorted((r.id, r.class_id, r.copies, r.links) for r in run(spark, tmp_path, "jaccard_classes"))
    assert got == [(0, 0, 2, 3), (1, 0, 2, 3), (2, 2, 2, 3), (3, 2, 2, 3), (4, 4, 1, 0)]


def test_unknown_listings_of_both_sides(spark, tmp_path):
    m = spark.createDataFrame([(1, "l1", "L8"), (2, "l9", "l1 "), (3, "L9", " "), (4, None, "l7")], "match_id bigint, listing_a string, listing_b string")
    o = spark.createDataFrame([("L1",), (None,)], "listing_id string")
    got = {r.check_name: r.failures for r in run(spark, tmp_path, "integrity_checks", image_matches=m, olx_listings=o)}
    assert got == {"repeated_match_id": 0, "missing_side": 2, "self_match": 0, "unknown_listing": 3}


def test_vector_statistics_count_every_vector(spark, tmp_path):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    r = run(spark, tmp_path, "visual_pairs", embeddings=e)[0]
    assert (r.at_50, r.at_70, r.at_90, r.pairs_50) == (2, 2, 2, 1)
    assert {p.rank: p.mean_similarity for p in run(spark, tmp_path, "knn_rank_profile")} == {1: 0.33166667, 2: -0.99833333}
