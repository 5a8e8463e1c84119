import pytest
from pyspark.sql import functions as F

from stallmark.functions import products

LISTINGS = [
    ("Apple iPhone 17 Pro Max 256GB Desert Titanium 100% battery health", "iphone", dict(brand="Apple", product_family="iPhone", model="iPhone 17 Pro Max", variant="Pro Max", storage_gb=256, color="Desert Titanium", battery_health_percent=100, accessory_or_device="device", query_match_status="direct_match", normalization_confidence="high")),
    ("iPhone 14 128gb Blue 6 months old with bill box", "iphone", dict(model="iPhone 14", storage_gb=128, color="Blue", condition="used")),
    ("Apple MacBook Air M1 2020 8GB 256GB Space Gray", "macbook", dict(product_family="MacBook", model="MacBook Air", chip="M1", ram_gb=8, storage_gb=256, year=2020, color="Space Gray", product_category="Laptop", query_match_status="direct_match")),
    ("PS5 controller white", "ps5 controller", dict(model="DualSense Controller", query_match_status="direct_match", product_category="Gaming Accessory")),
    ("Sony PS5 slim digital edition", "ps5 controller", dict(model="PlayStation 5", query_match_status="different_product")),
    ("iPhone 13 back cover", "iphone", dict(product_category="Accessory", accessory_or_device="case", query_match_status="related_accessory")),
    ("samsung galaxy s24 ultra", "iphone", dict(model="Galaxy S24 Ultra", brand="Samsung", query_match_status="different_product")),
    ("xbox series x 1tb", "tv", dict(model="Xbox Series X", storage_gb=1024, query_match_status="direct_match")),
    ("lenovo thinkpad i5 16 gb ram 512 ssd", "macbook", dict(brand="Lenovo", model="Lenovo Thinkpad", chip="I5", ram_gb=16, storage_gb=512, query_match_status="different_product")),
    ("oneplus nord ce 3", "x", dict(model="Oneplus Nord Ce 3".replace("Oneplus", "OnePlus"))),
    ("some mobile", "iphone", dict(model="Generic Smartphone", query_match_status="ambiguous")),
    ("wooden chair", None, dict(model="Unknown Product", brand="Unknown", query_match_status="unknown")),
    (None, "iphone", dict(model=None, accessory_or_device="unknown", query_match_status="unknown")),
    ("Pixel 8 pro 12/256", "q", dict(model="Pixel 8 Pro", ram_gb=12, storage_gb=256)),
    ("ps4 pro 16gb", "q", dict(model="PlayStation 4", storage_gb=16, ram_gb=None)),
]


def test_listings(spark):
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(LISTINGS)], "i int, t string, q string")
    got = {r.i: r.asDict() for r in df.select("i", *[c.alias(n) for n, c in products.normalised_listing(F.col("t"), F.col("q")).items()]).collect()}
    for i, (title, _, want) in enumerate(LISTINGS):
        assert {k: got[i][k] for k in want} == want, title


@pytest.mark.parametrize("raw,sub,title,want", [
    ("Smartphones", "iphone", None, ("Smartphones", "iPhone")), ("Gaming", None, "xbox series s", ("Gaming", "Xbox")), ("ps5", None, None, ("Gaming", "PlayStation")),
    ("phone", None, "redmi note", ("Smartphones", "Xiaomi")), (None, None, "old GoPro hero", ("Cameras", "Action Camera")), ("Chairs", "oak", "sofa", ("Chairs", "oak")), (None, None, None, ("Electronics", None)),
])
def test_category(spark, raw, sub, title, want):
    df = spark.createDataFrame([(raw, sub, title)], "c string, s string, t string")
    r = df.select(products.category(F.col("c"), F.col("s"), F.col("t")).alias("x")).first().x
    assert (r.category, r.subcategory) == want
