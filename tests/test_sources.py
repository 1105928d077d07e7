"""Probes, slices and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.sources import records, sinks


def test_meta_outputs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.txt").write_text("")
    paths = spark.createDataFrame([("a.json",), ("b.json",), ("c.txt",), ("d.json",), (None,)], "rel_path string")
    got = {r.rel_path: (r.exists, r.non_empty, r.valid_json) for r in records.read_meta_outputs(spark, paths, str(tmp_path)).collect()}
    assert got == {"a.json": (True, True, True), "b.json": (True, True, False), "c.txt": (True, False, None), "d.json": (False, False, False), None: (False, False, None)}


def test_slice_by_name(spark):
    df = spark.createDataFrame([(x,) for x in "abcd"], "d string")
    assert [r.d for r in records.slice_by_name(df, "d", "b", "c", 2).orderBy("d").collect()] == ["b", "c"]
    for bad in (("c", "b", None), ("b", "x", None), ("b", "c", 3)):
        with pytest.raises(ValueError):
            records.slice_by_name(df, "d", *bad)


def test_settings_and_folders(spark):
    assert records.env_substituted({"a": ["${X}/${Y}", 1]}, {"X": "v"}) == {"a": ["v/${Y}", 1]}
    x = spark.range(1).select(records.raw_folder(F.lit("/d/raw/")).alias("a"), records.raw_folder(F.lit("/d/straw")).alias("b"), sinks.manifest_name(F.lit("")).alias("m")).first()
    assert (x.a, x.b) == ("/d/raw", "/d/straw/raw") and x.m.startswith("empty_input_path__da39a3ee5e")


def test_summarize_and_write(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"b": 1, "a": 2}\n\n{"c": 1}\n')
    row = records.summarize_jsonl(spark, str(tmp_path / "x.jsonl")).first()
    assert row.columns == ["a", "b", "c"] and row.rows == 2
    df = spark.createDataFrame([(1,), (2,)], "i int").coalesce(1)
    sinks.write_records(df, str(tmp_path / "out"), True)
    sinks.write_records(df.limit(0).coalesce(1), str(tmp_path / "none"), True)
    read = lambda name: [x for p in (tmp_path / name).glob("part-*") for x in json.loads(p.read_text() or "[]")]
    assert read("out") == [{"i": 1}, {"i": 2}] and read("none") == []
    edges = spark.createDataFrame([('a"', "b")], "src string, dst string")
    assert sinks.dot_lines(edges).first().line == '  "a\\"" -> "b";'
