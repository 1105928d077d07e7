"""Sinks: JSON lines, chat exports and trees as text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.relational import upsert


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, null fields left out."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """More lines in a folder of JSON lines. Not idempotent: rows that are written again are there twice."""
    write_jsonl(df, path, "append")


def write_pretty(df: DataFrame, path: str, single: bool = False) -> None:
    """One indented JSON array of all rows, or the one row as an object, in a file of one task: for reports, not for tables."""
    row = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    lines = df.coalesce(1).select(row.alias("value"))
    out = lines.limit(1) if single else lines.mapInArrow(_bracketed, "value string")
    out.coalesce(1).write.mode("overwrite").text(path)


def append_array(new: DataFrame, old: DataFrame, path: str) -> None:
    """A record file of old rows and new ones, written to a new folder (the old one is still being read)."""
    write_records(old.unionByName(new, allowMissingColumns=True), path, True)


def merge_jsonl(new: DataFrame, processed: DataFrame, old: DataFrame, path: str, key: str = "sample_id") -> None:
    """Rewrite a record file with processed keys replaced, in a new folder (the old one is still being read)."""
    write_jsonl(upsert(old, new, processed, key), path)


def to_chat(records: DataFrame, sample_id: str, prompt: str, output: str, logs: str, prediction: str, system: str | None = None) -> DataFrame:
    """(sample_id, conversations, system): the model's turn is the output, else the joined logs, else the prediction."""
    said = F.coalesce(F.nullif(F.col(output), F.lit("")), F.nullif(F.array_join(logs, "\n"), F.lit("")), F.col(prediction))
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return records.select(F.col(sample_id).alias("sample_id"), F.array(turn("human", F.col(prompt)), turn("gpt", said)).alias("conversations"), F.lit(system).alias("system"))


def tree_lines(paths: DataFrame) -> DataFrame:
    """Text lines of a tree, from (node, depth, order): indented by depth."""
    return paths.select("order", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("node").cast("string")).alias("line"))


def write_records(df: DataFrame, path: str, array: bool) -> None:
    """Records as they came: JSON lines, or one JSON array a part file (a frame without partitions leaves an empty file)."""
    if not array:
        write_jsonl(df, path)
        return
    # Lines of one partition joined to an array by their ends, so that no partition is held whole.
    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    lines = rows.mapInArrow(_bracketed, "value string")
    lines.write.mode("overwrite").text(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lead = "["
    for batch in batches:
        out = []
        for x in batch.column(0).to_pylist():
            out.append(lead + x)
            lead = ","
        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": pa.array(["[]" if lead == "[" else "]"], pa.string())})


def dot_lines(edges: DataFrame) -> DataFrame:
    """(src, dst, line): the edges of a graph in DOT form, without its head and foot."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select("src", "dst", F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("line"))


def manifest_name(path: Column) -> Column:
    """The file name of the manifest of an input path: its cleaned head and a digest."""
    clean = F.nullif(F.substring(F.regexp_replace(path, "[^a-zA-Z0-9._-]+", "_"), 1, 80), F.lit(""))
    return F.concat(F.coalesce(clean, F.lit("empty_input_path")), F.lit("__"), F.substring(F.sha1(F.coalesce(path, F.lit(""))), 1, 10), F.lit(".json"))
