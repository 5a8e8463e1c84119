import json

from pyspark.sql import functions as F

from stallmark.sources import captures, html, records
from stallmark.streaming import ingest


def listing(i, **k):
    return {"listing_id": i, "source_url": f"https://x.example/{i}", "raw": {"title": f"t{i}", "price": "₹5"}, "media": [{"file_id": "f", "src": "https://i.example/1.jpg", "gallery_index": 0}], **k}


def test_captures(spark, tmp_path):
    doc = {"source": "x", "captures": [{"captured_at": "2024", "listings": [listing("1"), listing(None, source_url=None), listing("2", media=None)]}, {"capture_id": "c2", "listings": [listing("1")]}]}
    for n in ("a.json", "b.json"):
        (tmp_path / n).write_text(json.dumps(doc))
    docs, manifest = captures.read_exports(spark, str(tmp_path))
    assert {(r.file_name, r.is_duplicate, r.identical_to) for r in manifest.collect()} == {("a.json", False, None), ("b.json", True, "a.json")}
    seen = captures.sightings(docs)
    assert seen.count() == 3 and {r.page_type for r in seen.collect()} == {"search"}
    assert [r.media_id for r in captures.media_references(seen).collect()] == ["MED-1-0"]
    assert sorted(r.listings_count for r in captures.deduplicated_captures(seen).collect()) == [2]


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('raw_title,price,source,synthetic\n"A, b",45k,s,yes\n,-5,,no\n')
    r = records.read_records(spark, str(tmp_path / "r.csv"))
    good, bad = records.split_valid(r)
    assert [x.title for x in good.collect()] == ["A, b"] and len(bad.first().errors) == 3
    c = records.canonical(good).first()
    assert c.price_amount == 45000.0 and c.listing_id.startswith("lst_") and c.price_currency == "INR"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "r.json").write_text(json.dumps([{"source": "s", "title": "T", "seller": {"phone": "1"}, "media": [{"sha256": "x"}], "extracted_claims": {"a": "b"}}]))
    flat = records.flat_export(records.read_json(spark, str(folder / "r.json"))).first()
    assert flat.seller_phone == "1" and flat.media_count == 1 and json.loads(flat.extracted_claims_json) == {"a": "b"}
    spark.dataSource.register(records.RecordFolder)
    assert spark.read.format("record_folder").load(str(folder)).count() == 1


def test_html(spark):
    ld = '<script type="application/ld+json">{"name":"Phone","offers":{"price":"500"},"description":"d"}</script>'
    pages = [("https://x.example/item/iid-1234567", f'{ld}<img src="https://i.example/a.jpg"><img src="https://i.example/a.jpg">'), ("u", "<h1>Old</h1> ₹ 1,200"), ("v", None)]
    out = {r.url: r for r in html.listing_pages(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert out[pages[0][0]].title == "Phone" and out[pages[0][0]].price == 500.0 and out[pages[0][0]].images == ["https://i.example/a.jpg"]
    assert (out["u"].title, out["u"].price, out["v"].title) == ("Old", 1200.0, None)
    cards = html.search_cards(spark.createDataFrame([("s", '<a href="/item/1"></a><a href="/item/2"></a><a href="/item/1"></a>')], "url string, html string"))
    assert [r.url for r in cards.orderBy("position").collect()] == ["/item/1", "/item/2"]
    got = spark.createDataFrame([("Urgent, GST bill", "WhatsApp me"), (None, None)], "t string, d string").select(html.claims(F.col("t"), F.col("d")).alias("c")).collect()
    assert [(c.position, c.claim.split(" ")[0], c.evidence) for c in got[0].c] == [(1, "Urgent", "urgent"), (2, "Invoice", "gst"), (3, "WhatsApp", "whatsapp")] and got[1].c == []


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    src = str(tmp_path / "landing")
    rows = [("a", "s1", 3), ("a", "s2", 1), ("b", "s3", 5), (None, "s4", 9)]
    schema = "key string, sighting string, at int"
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    ingest.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame(rows[:2], schema).write.mode("append").parquet(src)
    ingest.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {r.key: (r.first_seen, r.last_seen, r.sightings) for r in ingest.latest_state(spark, str(tmp_path / "state")).collect()}
    assert got == {"a": (1, 3, 2), "b": (5, 5, 1)}
