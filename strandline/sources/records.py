"""Scans of records, trajectories, seeds and file inventories."""

from __future__ import annotations

import importlib
import json
import posixpath
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Keys under which a wrapping object may hold the table, and file kinds that are tables.
WRAPPERS = ("records", "results", "data", "samples")
TABLES = (".csv", ".tsv", ".json", ".jsonl", ".parquet")
KEYS = {
    "id": ("sample_id", "task_id", "id", "uid", "question_id"),
    "trajectory": ("output", "trajectory", "response", "logs"),
    "prediction": ("prediction", "pred", "model_answer", "final_answer"),
    "reference": ("answer", "reference", "reference_answer", "gold", "gold_answer", "target", "label", "expected_answer", "answer_key"),
    "query": ("input", "question", "query", "task", "prompt"),
}
NODE = "node_id: string, parent_id: string, children_ids: array<string>, depth: int, logs: array<string>, action_type: string, mcts_stats: struct<visit_count: int, q_value: double, r_pre: double, r_post: double, expandable: boolean>"
TRAJECTORY = f"trajectory_id string, source_id string, seed_data string, total_depth int, nodes array<struct<{NODE}>>"


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file that is not white space, '' if there is none."""
    row = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    return row.c if row else ""


def read_records(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Records of JSON lines, of a JSON array, or of an object with the table under one of ``WRAPPERS``; an object without any is an error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    head = first_character(spark, path)
    if path.endswith(".jsonl") and head != "[":
        return reader.json(path)
    df = spark.read.option("multiLine", True).json(path)
    if head == "[":
        return df if schema is None else reader.option("multiLine", True).json(path)
    for key in WRAPPERS:
        if key in df.columns and isinstance(df.schema[key].dataType, ArrayType):
            return df.select(F.inline(key)) if isinstance(df.schema[key].dataType.elementType, StructType) else df.select(F.explode(key))
    raise ValueError(f"{path} holds no table: an array, or an object with one under {', '.join(WRAPPERS)}")


def read_objects(spark: SparkSession, path: str, schema: str | StructType, safe: bool = False) -> DataFrame:
    """Rows of JSON lines that are objects; other values are left out.  A line that doesn't read is an error, or, if ``safe``, leaves no row of its file at all; so does a missing file."""
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    except AnalysisException:
        if safe:
            return spark.createDataFrame([], schema)
        raise
    value = F.try_parse_json("value")
    if safe:
        bad = lines.where(value.isNull()).select("file").distinct()
        lines = lines.join(F.broadcast(bad) if bad.limit(1000).count() < 1000 else bad, "file", "left_anti")
    else:
        lines = lines.withColumn("value", F.when(value.isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON: "), F.substring("value", 1, 80)))))
    objects = lines.where(F.startswith(F.ltrim("value"), F.lit("{")))
    return objects.select(F.from_json("value", schema if isinstance(schema, str) else schema.json()).alias("r")).select("r.*")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON array; none where the file is missing, holds something else or doesn't read."""
    empty = spark.createDataFrame([], schema)
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return empty
    found = text.where(F.startswith(F.ltrim("value"), F.lit("[")) & F.try_parse_json("value").isNotNull())
    return found.select(F.inline(F.from_json("value", f"array<struct<{_fields(schema)}>>")))


def _fields(schema: str) -> str:
    kind = StructType.fromDDL(schema)
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kind)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories of JSON lines or of one array, whatever the name; none where the file is empty."""
    head = first_character(spark, path)
    if not head:
        return spark.createDataFrame([], TRAJECTORY)
    return spark.read.schema(TRAJECTORY).option("multiLine", head == "[").json(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds (content, kwargs); a line without content is an error."""
    df = spark.read.schema("content string, kwargs map<string, string>").json(path)
    return df.select(F.coalesce("content", F.raise_error(F.lit("a seed has no content"))).alias("content"), F.coalesce("kwargs", F.create_map().cast("map<string,string>")).alias("kwargs"))


def relative(path: str, root: str) -> Column:
    """The path of a file below ``root``."""
    marker = root.rstrip("/").split("://")[-1].split(":", 1)[-1] + "/"
    return F.element_at(F.split(path, F.regexp_replace(F.lit(marker), r"([.\[\]{}()*+?^$|\\])", r"\\$1"), 2), -1)


def listing(spark: SparkSession, root: str) -> list[tuple[str, int, bool]]:
    """(path below the root, bytes, whether a folder) of all that lies under a folder, by name, from the file system: files of no bytes are there too."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top, out, todo = fs.getFileStatus(base).getPath().toString().rstrip("/") + "/", [], [base]
    while todo:
        for s in fs.listStatus(todo.pop()):
            out.append((s.getPath().toString()[len(top) :], s.getLen(), s.isDirectory()))
            if s.isDirectory():
                todo.append(s.getPath())
    return sorted(out)


def inventory(spark: SparkSession, root: str, max_files: int = 2000) -> DataFrame:
    """Files under a folder: rel_path, suffix, size, top_level, depth; by name, up to ``max_files``.

    The listing is the driver's, as Spark's own is; files of no bytes count.
    """
    files = [(p, n) for p, n, folder in listing(spark, root) if not folder]
    x = spark.createDataFrame(files[:max_files], "rel_path string, size bigint")
    suffix = F.lower(F.regexp_extract("rel_path", r"[^./](\.[^./]+)$", 1))
    top = F.when(F.contains("rel_path", F.lit("/")), F.split_part("rel_path", F.lit("/"), F.lit(1))).otherwise("<root>")
    return x.select("rel_path", F.when(suffix == "", "<no_ext>").otherwise(suffix).alias("suffix"), "size", top.alias("top_level"), (F.regexp_count("rel_path", F.lit("/")) + 0).alias("depth"))


def inventory_totals(spark: SparkSession, root: str, max_files: int = 2000) -> dict:
    """num_files, num_dirs (the root and empty ones too), total_bytes, max_depth and truncated of a folder."""
    found = listing(spark, root)
    files, folders = [f for f in found if not f[2]], [f for f in found if f[2]]
    kept = files[:max_files]
    return {"num_files": len(kept), "num_dirs": len(folders) + 1, "total_bytes": sum(f[1] for f in kept), "max_depth": max((f[0].count("/") + 1 for f in folders), default=0), "truncated": len(files) > max_files}


def summarize_table(spark: SparkSession, path: str, cap: int = 100_000, most_bytes: int = 5 << 20, head: int = 50, names: int = 100) -> dict:
    """{columns (up to ``names``), rows, truncated, error} of a table file.

    rows is None where a text format has ``cap`` or more, or a JSON file more
    than ``most_bytes``.  Keys are those of the first ``head`` objects, sorted.
    A file that doesn't read has an error in place of columns.
    """
    kind = path[path.rfind(".") :].lower()
    out = {"columns": [], "rows": None, "truncated": False, "error": None}
    try:
        if kind in (".csv", ".tsv"):
            df = spark.read.option("header", True).option("sep", "\t" if kind == ".tsv" else ",").csv(path)
            n = df.limit(cap).count()
            return out | {"columns": [c.strip() for c in df.columns][:names], "rows": n if n < cap else None, "truncated": n >= cap}
        if kind == ".parquet":
            df = spark.read.parquet(path)
            return out | {"columns": df.columns[:names], "rows": df.count()}
        if kind == ".jsonl":
            lines = spark.read.text(path).where(F.trim("value") != "")
            n = lines.limit(cap).count()
            return out | {"columns": _keys(lines.limit(head), names), "rows": (n or None) if n < cap else None, "truncated": n >= cap}
        if kind == ".json":
            base = spark._jvm.org.apache.hadoop.fs.Path(path)
            if base.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(base).getLen() > most_bytes:
                return out | {"truncated": True}
            text = spark.read.option("wholetext", True).text(path).select(F.parse_json("value"), "value")
            raw = text.first().value.strip()
            if raw.startswith("{"):
                return out | {"columns": _keys(text, names), "rows": 1}
            if raw.startswith("["):
                items = text.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
                return out | {"columns": _keys(items.limit(head), names), "rows": items.count()}
    except Exception as e:  # a summary is of whatever lies there
        return out | {"error": str(e).split("\n")[0]}
    return out


def _keys(objects: DataFrame, names: int) -> list[str]:
    found = objects.select(F.explode(F.json_object_keys("value")).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("k")).first().k
    return list(found[:names])


def trajectory_files(spark: SparkSession, root: str) -> list[str]:
    """The trajectory file that ``root`` is or holds, else those of its folders, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    name = "trajectories.jsonl"
    for one in (root, f"{root.rstrip('/')}/{name}"):
        if one.endswith(name) and fs.exists(path(one)) and fs.getFileStatus(path(one)).isFile():
            return [one]
    found = fs.globStatus(path(f"{root.rstrip('/')}/*/{name}")) or []
    return sorted(s.getPath().toString() for s in found if s.isFile())


def discover(spark: SparkSession, *roots: str) -> DataFrame:
    """Trajectories of all ``root/*/trajectories.jsonl``, with the file they come from; roots that aren't there are skipped."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    globs = [f"{r.rstrip('/')}/*/trajectories.jsonl" for r in roots]
    there = [g for g in globs if path(g).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(g))]
    if not there:
        return spark.createDataFrame([], f"{TRAJECTORY}, file string")
    # Files hold lines or one array: each kind is read its own way.
    lines = spark.read.text(there).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.substring(F.trim("value"), 1, 1).alias("c"), F.monotonically_increasing_id().alias("i"))
    heads = lines.groupBy("file").agg(F.min_by("c", "i").alias("c")).collect()
    read = lambda array: [r.file for r in heads if (r.c == "[") == array]
    parts = [spark.read.schema(TRAJECTORY).option("multiLine", array).json(files).withColumn("file", F.col("_metadata.file_path")) for array in (True, False) if (files := read(array))]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_meta_outputs(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (rel_path) with exists, non_empty and valid_json of the file under ``root``.

    valid_json is null unless the name ends in .json.  A null path exists
    nowhere.  Files of no bytes exist, and are neither non-empty nor JSON.
    """
    there = spark.createDataFrame([(p, n) for p, n, folder in listing(spark, root) if not folder], "rel_path string, size bigint")
    wanted = paths.select("rel_path").where("rel_path is not null").distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.when(F.endswith("rel_path", F.lit(".json")), F.decode("content", "UTF-8"))
    read = files.withColumn("rel_path", relative("path", root)).join(wanted, "rel_path", "left_semi").select("rel_path", F.try_parse_json(text).isNotNull().alias("ok"))
    found = there.select("rel_path", F.lit(True).alias("exists"), (F.col("size") > 0).alias("non_empty")).join(read, "rel_path", "left")
    x = paths.join(found, "rel_path", "left").fillna(False, ["exists", "non_empty"])
    return x.withColumn("valid_json", F.when(F.endswith("rel_path", F.lit(".json")), F.coalesce("ok", F.lit(False)))).drop("ok")


def slice_by_name(df: DataFrame, name: str, first: str, last: str, expected: int | None = None) -> DataFrame:
    """Rows whose ``name`` lies from ``first`` to ``last``, both of which must occur; ``expected`` is the number of names, if stated."""
    if first > last:
        raise ValueError(f"the range begins at {first}, after its end {last}")
    part = df.where(F.col(name).between(first, last))
    seen = part.agg(F.count_if(F.col(name) == first).alias("a"), F.count_if(F.col(name) == last).alias("b"), F.count_distinct(name).alias("n")).first()
    if not (seen.a and seen.b):
        raise ValueError(f"no {name} {last if seen.a else first}")
    if expected is not None and seen.n != expected:
        raise ValueError(f"{seen.n} names in the range, not {expected}")
    return part


def raw_folder(path: Column) -> Column:
    """The folder of raw files of a dataset."""
    x = F.rtrim(path, F.lit("/"))
    return F.when(F.regexp_extract(x, r"([^/]*)$", 1) == "raw", x).otherwise(F.concat(x, F.lit("/raw")))


def summarize_jsonl(spark: SparkSession, path: str, head: int = 50, names: int = 100) -> DataFrame:
    """One row: keys of the first ``head`` objects of a file, sorted, up to ``names``, and its number of lines that aren't blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = lines.limit(head).select(F.explode(F.json_object_keys("value")).alias("k"))
    columns = keys.agg(F.slice(F.array_sort(F.collect_set("k")), 1, names).alias("columns"), F.lit(None).cast("bigint").alias("rows"))
    rows = lines.agg(F.lit(None).cast("array<string>").alias("columns"), F.count("*").alias("rows"))
    return columns.unionByName(rows).agg(F.max("columns").alias("columns"), F.max("rows").alias("rows"))


def env_substituted(value: object, env: dict[str, str]) -> object:
    """Settings with every ``${NAME}`` that ``env`` has filled in, others left as they are; lists of strings stay lists."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: env_substituted(v, env) for k, v in value.items()}
    return [env_substituted(v, env) for v in value] if isinstance(value, list) else value


def read_settings(spark: SparkSession, path: str, env: dict[str, str]) -> dict:
    """The settings of a JSON or YAML file with ``env`` filled in; lists of tips become lines."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    if path.endswith((".yaml", ".yml")):
        yaml = importlib.import_module("yaml")
        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text or "{}")
    out = env_substituted(raw, env)
    return {k: "\n".join(v) if k.endswith("_tips") and isinstance(v, list) else v for k, v in out.items()}


def resolved(path: str | None, home: str = "~", base: str = ".") -> str | None:
    """A path in full, with its home and without . and .. steps; None of an empty one."""
    if not path:
        return None
    path = home + path[1:] if path.startswith("~") else path
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return f"{scheme}://{posixpath.normpath(rest)}"
    return posixpath.normpath(posixpath.join(base, path))
