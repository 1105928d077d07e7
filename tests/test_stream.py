"""Batches merge by key into the buckets that they touch."""

from pyspark.sql import functions as F

from strandline.streaming import upserts


def test_batches_touch_their_buckets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for number, rows in enumerate(['{"sample_id": "a", "v": 1}\n{"sample_id": "b", "v": 2}\n', '{"sample_id": "a", "v": 5}\n', '{"sample_id": "a", "v": 7}\n{"sample_id": "c", "v": 3}\n', '{"sample_id": "a", "v": 9}\n']):
        (tmp_path / f"in/{number}.json").write_text(rows)
        upserts.score_stream(spark, str(tmp_path / "in"), "sample_id string, v int", lambda d: d.withColumn("s", F.col("v") * 2), out, str(tmp_path / "cp"), buckets=8).awaitTermination(60)
    assert {(r.sample_id, r.s) for r in upserts.current(spark, out).collect()} == {("a", 18), ("b", 4), ("c", 6)}
    own = spark.sql("select cast(pmod(xxhash64('a'), 8) as int) as k").first().k
    assert upserts.versions(spark, out)[own][-2:] == [2, 3] and len(upserts.versions(spark, out)[own]) == 2
