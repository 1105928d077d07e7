"""Manifests of datasets: one row per input path from the inventory of its files, and the coverage targets that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import scores as S
from strandline.operators.evidence import suffix
from strandline.sources.records import TABLES

#: The budget of a dataset that isn't there, and weights of targets.
MISSING_BUDGET, INVENTORY_WEIGHT, SCHEMA_WEIGHT = 4, 2.0, 1.75


def folders(files: DataFrame) -> DataFrame:
    """(input_path, num_dirs, max_depth): folders that hold files, with all above them and the root."""
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    x = files.select("input_path", F.explode(above).alias("dir")).distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return x.groupBy("input_path").agg(F.count("*").alias("num_dirs"), F.max(depth).alias("max_depth"))


def capped(files: DataFrame, max_files: int) -> DataFrame:
    """The first ``max_files`` files of each input path by name, and whether there are more (truncated)."""
    rank = F.row_number().over(W.partitionBy("input_path").orderBy("rel_path"))
    x = files.withColumn("rank", rank).where(F.col("rank") <= max_files + 1)
    more = x.where(F.col("rank") > max_files).select("input_path", F.lit(True).alias("truncated"))
    return x.where(F.col("rank") <= max_files).drop("rank").join(more, "input_path", "left").fillna(False, ["truncated"])


def _top(files: DataFrame, value: str, name: str, most: int, extra: list) -> DataFrame:
    """(input_path, array of the ``most`` frequent values, by number, then name)."""
    x = files.groupBy("input_path", F.col(value).alias(name)).agg(F.count("*").alias("count"), *extra)
    share = F.round(F.col("count") / F.sum("count").over(W.partitionBy("input_path")), 4)
    x = x.withColumn("share", share).withColumn("rk", F.row_number().over(W.partitionBy("input_path").orderBy(F.desc("count"), name))).where(F.col("rk") <= most)
    return x.groupBy("input_path").agg(F.array_sort(F.collect_list(F.struct("rk", *[c for c in x.columns if c not in ("input_path", "rk")]))).alias("top"))


def table_candidates(files: DataFrame, table_limit: int) -> DataFrame:
    """(input_path, rel_path, ext, rk) of each dataset's largest tables, size and name both falling."""
    x = files.select("input_path", "rel_path", suffix(F.col("rel_path")).alias("ext"), "size").where(F.col("ext").isin(*TABLES)).distinct()
    return x.withColumn("rk", F.row_number().over(W.partitionBy("input_path").orderBy(F.desc("size"), F.desc("rel_path")))).where(F.col("rk") <= table_limit).drop("size")


def manifests(files: DataFrame, paths: DataFrame | None = None, summaries: DataFrame | None = None, max_files: int = 2000, top_extensions: int = 8, top_subtrees: int = 8, table_limit: int = 8) -> DataFrame:
    """One row per input path of ``paths`` (all of ``files``, if not given).

    files: (input_path, rel_path, size).  summaries: (input_path, rel_path,
    columns, row_count, truncated) of tables, joined to the candidates.
    Ties in frequency go to the lesser name; files beyond ``max_files`` by
    name are left out, and truncated says so.  A path without files is not
    available.
    """
    files = capped(files, max_files).withColumn("_suffix", suffix(F.col("rel_path")))
    files = files.withColumns({"suffix": F.when(F.col("_suffix") == "", "<no_ext>").otherwise(F.col("_suffix")), "top_level": F.when(F.contains("rel_path", F.lit("/")), F.split_part("rel_path", F.lit("/"), F.lit(1))).otherwise("<root>")})
    total = files.groupBy("input_path").agg(F.count("*").alias("num_files"), F.sum("size").alias("total_bytes"), F.max("truncated").alias("truncated"))
    ext = _top(files, "suffix", "ext", top_extensions, []).withColumnRenamed("top", "major_extensions")
    sub = _top(files, "top_level", "name", top_subtrees, [F.sum("size").alias("byte_count")]).withColumnRenamed("top", "dominant_subtrees")
    best = files.groupBy("input_path", "suffix").agg(F.min_by(F.struct("suffix", "rel_path", "size"), F.struct(-F.col("size"), F.col("rel_path"))).alias("f"))
    best = best.groupBy("input_path").agg(F.slice(F.array_sort(F.collect_list("f")), 1, max(8, top_extensions + table_limit)).alias("representative_files"))
    tables = table_candidates(files, table_limit)
    if summaries is None:
        tables = tables.withColumns({"columns": F.array().cast("array<string>"), "row_count": F.lit(None).cast("bigint"), "truncated": F.lit(False)})
    else:
        tables = tables.join(summaries.select("input_path", "rel_path", "columns", F.col("row_count").cast("bigint").alias("row_count"), "truncated"), ["input_path", "rel_path"], "left")
    tables = tables.groupBy("input_path").agg(F.array_sort(F.collect_list(F.struct("rk", "rel_path", "ext", "columns", "row_count", "truncated"))).alias("table_summaries"))
    x = total.join(folders(files), "input_path").join(ext, "input_path").join(sub, "input_path").join(best, "input_path").join(tables, "input_path", "left")
    n_tables = F.greatest(F.size("table_summaries"), F.lit(0))
    x = x.withColumns({"count_exact": ~F.col("truncated"), "expected_tool_budget": S.tool_budget(F.col("num_files"), F.size("major_extensions"), F.size("dominant_subtrees"), n_tables, F.col("truncated")), "available": F.lit(True)})
    if paths is None:
        return x
    x = paths.select("input_path").distinct().join(x, "input_path", "left")
    return x.fillna(False, ["available", "truncated", "count_exact"]).fillna(MISSING_BUDGET, ["expected_tool_budget"])


def with_manifest(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records`` (input_path) with the manifest of their dataset, each made once; available is false without."""
    return records.join(manifest, "input_path", "left").fillna(False, ["available"])


def coverage_targets(manifest: DataFrame) -> DataFrame:
    """(input_path, target_id, type, name, columns, weight) of the available manifests: inventory, extensions, subtrees but the root, tables."""
    none = F.lit(None).cast("array<string>")
    target = lambda kind, prefix, name, columns, weight: F.struct(F.concat(F.lit(prefix), F.coalesce(name, F.lit(""))).alias("target_id"), F.lit(kind).alias("type"), name.alias("name"), columns.alias("columns"), weight.alias("weight"))
    one = F.array(target("inventory", "inventory", F.lit(None).cast("string"), none, F.lit(INVENTORY_WEIGHT)))
    ext = F.transform("major_extensions", lambda e: target("extension", "ext::", e["ext"], none, S.target_weight(e["share"])))
    sub = F.transform(F.filter("dominant_subtrees", lambda d: d["name"] != "<root>"), lambda d: target("subtree", "subtree::", d["name"], none, S.target_weight(d["share"])))
    tab = F.transform("table_summaries", lambda t: target("schema", "schema::", t["rel_path"], t["columns"], F.lit(SCHEMA_WEIGHT)))
    kind = "array<struct<target_id: string, type: string, name: string, columns: array<string>, weight: double>>"
    all_ = F.flatten(F.array_compact(F.array(*[a.cast(kind) for a in (one, ext, sub, tab)])))
    return manifest.where("available").select("input_path", F.inline(all_))


def manifest_facts(manifest: DataFrame) -> DataFrame:
    """(input_path, kind, label, value, exact): what a manifest says, as facts for matching claims."""
    fact = lambda kind, value, label=None, exact=True: F.struct(F.lit(kind).alias("kind"), F.lit(label).cast("string").alias("label"), value.cast("string").alias("value"), (F.lit(exact) if isinstance(exact, bool) else exact).alias("exact"))
    tables = F.coalesce("table_summaries", F.array().cast(manifest.schema["table_summaries"].dataType))
    whole = F.when(F.col("count_exact"), F.array(fact("count", F.col("num_files"), "file_count"), fact("count", F.col("num_dirs"), "dir_count")))
    parts = [
        F.transform("representative_files", lambda f: fact("path", f["rel_path"])), F.transform("representative_files", lambda f: fact("extension", f["suffix"])),
        F.transform(tables, lambda t: fact("path", t["rel_path"])), F.transform(tables, lambda t: fact("extension", t["ext"])),
        F.flatten(F.transform(tables, lambda t: F.transform(F.coalesce(t["columns"], F.array().cast("array<string>")), lambda c: fact("column", c)))),
        F.transform(F.filter(tables, lambda t: t["row_count"].isNotNull()), lambda t: fact("count", t["row_count"], "row_count", ~F.coalesce(t["truncated"], F.lit(False)))),
        F.transform("major_extensions", lambda e: fact("extension", e["ext"])), whole,
    ]
    return manifest.where("available").select("input_path", F.inline(F.flatten(F.array_compact(F.array(*parts))))).distinct()
