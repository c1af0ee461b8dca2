from pyspark.sql import functions as F

from quern.operators import queries, statistics


def test_all_keys_are_tested_against_their_filter(spark):
    """Keys beyond the first two hundred, too: the filter holds the first 250 of 300."""
    options, keys = statistics.Options(), [f"key {i:03d}" for i in range(300)]
    places = statistics.bloom_places(spark, [(k,) for k in keys], [spark.createDataFrame([("",)], "k string").schema["k"].dataType], options)
    bitmaps = {}
    for p in {p for some in places[:250] for p in some}:
        data = bitmaps.setdefault((p - 1) // 32768 + 1, bytearray(4096))
        data[(p - 1) % 32768 // 8] |= 1 << (p - 1) % 8
    bloom = [(b, bytes(d)) for b, d in bitmaps.items()]
    manifest = spark.createDataFrame([("f", bloom)], "file string, bloom array<struct<bucket long, bitmap binary>>")
    held = {p for some in places[:250] for p in some}
    want = sum(not held.issuperset(p) for p in places)
    asked = [0, 249, 250, 299]
    got = manifest.select(*[statistics.bloom_may_hold(F.col("bloom"), [places[k]]).alias(f"k{k}") for k in asked], statistics.bloom_may_hold(F.col("bloom"), places[240:260]).alias("any"), statistics.bloom_may_hold(F.col("bloom"), []).alias("none")).first()
    assert list(got) == [*(held.issuperset(places[k]) for k in asked), True, False]
    entries = spark.createDataFrame([("f", k) for k in keys], "file string, k0 string")
    assert queries.bloom_missing(entries, manifest, options).first()["missing"] == want > 0
    assert queries.bloom_missing(entries.where("k0 < 'key 250'"), manifest, options).first()["missing"] == 0
