"""Evidence in trace steps, claims in answers, and how the two stand to each other and to a manifest.

Facts are rows (kind, label, value) of the kinds path, extension, count and
column.  They meet on keys that depend on their kind, so that every match is
one equi-join of a sample's keys, however many kinds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import parsers
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import blocks

#: Tools that run code, operations that list a folder, words that tell of an inventory, and labels of a table's size.
CODE_TAGS = ("bash", "sql", "code", "calculator")
LISTING = ("walk", "listdir", "glob", "scan_dir")
INVENTORY_WORDS = ("extension", "directory", "folder", "file")
INVENTORY_LABELS, TABLE_LABELS = ("file_count", "dir_count"), ("row_count", "column_count")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last extension of a path in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def primary_path(paths: Column) -> Column:
    """The first path of a table, else the first."""
    return F.coalesce(F.get(F.filter(paths, lambda p: suffix(p).isin(*parsers.TABLE_SUFFIXES)), F.lit(0)), F.get(paths, F.lit(0)))


def analysed(steps: DataFrame) -> DataFrame:
    """``steps`` (tool_tag, tool_content) with operations, path_candidates, primary_path, strict_signature and loose_signature."""
    tag, body = F.col("tool_tag"), F.coalesce("tool_content", F.lit(""))
    x = steps.withColumns({"_a": parsers.python_accesses(F.when(tag == "python", body)), "_s": parsers.signatures(tag, body)})
    other = F.when(tag.isin(*T.SEARCH_TAGS), "search").when(tag.isin(*CODE_TAGS), "execute_code").otherwise(F.concat(F.lit("use_"), tag))
    python = tag == "python"
    x = x.withColumn("operations", F.when(python, F.col("_a.operations")).otherwise(F.array(other))).withColumn("path_candidates", F.when(python, F.col("_a.paths")).otherwise(T.path_tokens(body)))
    return x.withColumns({"primary_path": primary_path(F.col("path_candidates")), "strict_signature": F.col("_s.strict"), "loose_signature": F.col("_s.loose")}).drop("_a", "_s")


def trace_steps(parsed: DataFrame, sample: str) -> DataFrame:
    """Steps of ``parsed`` (sample, blocks): those of ``blocks.steps`` with their analysis, success, informative_result and evidence.

    evidence: array<struct<kind, label, value, rel_path, source>> of the
    result; counts and columns belong to the step's primary path.
    """
    x = analysed(blocks.steps(parsed, sample))
    result = F.col("result_content")
    said = F.transform(
        parsers.facts(result),
        lambda f: F.struct(f["kind"].alias("kind"), f["label"].alias("label"), f["value"].alias("value"), F.when(f["kind"].isin("count", "column"), F.col("primary_path")).alias("rel_path"), F.concat(F.lit("R"), F.col("step_index").cast("string")).alias("source")),
    )
    x = x.withColumn("evidence", F.when(result.isNotNull(), said).otherwise(F.filter(said, lambda _: F.lit(False))))
    good = result.isNotNull() & ~F.col("result_error")
    return x.withColumns({"success": good, "informative_result": good & ((F.size("evidence") > 0) | (parsers.normalize_free_text(result) != ""))})


def answer_claims(answers: DataFrame, sample: str, answer: str) -> DataFrame:
    """(sample, kind, label, value, weight, critical): the distinct facts that answers state."""
    x = answers.select(sample, F.explode(parsers.facts(F.col(answer))).alias("f")).select(sample, "f.*")
    return x.withColumns({"weight": S.claim_weight(F.col("kind")), "critical": F.col("kind").isin(*S.CRITICAL)})


def keys(kind: Column, label: Column, value: Column) -> Column:
    """The keys under which a fact is found: a path by itself or its last name, a count by label and value."""
    path = F.array(F.concat(F.lit("path "), value), F.concat(F.lit("name "), basename(value)))
    count = F.array(F.concat(F.lit("count "), label, F.lit(" "), value))
    return F.when(kind == "path", path).when(kind == "count", count).otherwise(F.array(F.concat(kind, F.lit(" "), value)))


def _keyed(facts: DataFrame, sample: str, *more: str) -> DataFrame:
    return facts.select(sample, *more, F.explode(keys(F.col("kind"), F.col("label"), F.col("value"))).alias("key"))


def matched(claims: DataFrame, evidence: DataFrame, manifest: DataFrame, sample: str) -> DataFrame:
    """``claims`` with supported_by_evidence, supported_by_manifest and contradicted.

    evidence: (sample, kind, label, value); manifest: the same with exact, for
    the sample's dataset.  Contradicted is a count that neither bears out
    while evidence has other values of its label, or, where it has none, the
    manifest an exact one.
    """
    columns = [c for c in claims.columns if c != sample]
    known = _keyed(evidence, sample).distinct().withColumn("e", F.lit(True))
    listed = _keyed(manifest, sample).distinct().withColumn("m", F.lit(True))
    asked = claims.select(sample, F.struct(*columns).alias("c")).distinct()
    asked = asked.select("*", F.explode(keys(F.col("c.kind"), F.col("c.label"), F.col("c.value"))).alias("key"))
    found = asked.join(known, [sample, "key"], "left").join(listed, [sample, "key"], "left").groupBy(sample, "c")
    found = found.agg(F.coalesce(F.max("e"), F.lit(False)).alias("supported_by_evidence"), F.coalesce(F.max("m"), F.lit(False)).alias("supported_by_manifest")).withColumn("count_label", F.when(F.col("c.kind") == "count", F.col("c.label")))
    counted = lambda df, name: df.where("kind = 'count'").select(sample, F.col("label").alias("count_label")).distinct().withColumn(name, F.lit(True))
    x = found.join(counted(evidence, "said"), [sample, "count_label"], "left").join(counted(manifest.where("exact"), "exact"), [sample, "count_label"], "left")
    none = ~F.col("supported_by_evidence") & ~F.col("supported_by_manifest")
    return x.select(sample, "c.*", "supported_by_evidence", "supported_by_manifest", (none & (F.coalesce("said", F.lit(False)) | F.coalesce("exact", F.lit(False)))).alias("contradicted"))


def support_summary(matches: DataFrame, sample: str) -> DataFrame:
    """Counts and weights of matched claims by sample."""
    e, m, w = F.col("supported_by_evidence"), F.col("supported_by_manifest"), F.col("weight")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))
    return matches.groupBy(sample).agg(
        F.count("*").alias("claim_count"), F.count_if(e | m).alias("supported_claim_count"), F.count_if("contradicted").alias("contradicted_claim_count"), F.count_if(~e & ~m).alias("unsupported_claim_count"),
        F.sum(w).alias("total_weight"), part(e).alias("supported_weight"), part(~e & m).alias("manifest_only_weight"), part(F.col("contradicted")).alias("contradicted_weight"), part(F.col("critical") & ~e & ~m).alias("unsupported_critical_weight"),
    )


def distinct_counts(claims: DataFrame, sample: str) -> DataFrame:
    """(sample, paths, extensions, counts, columns): different claims of each kind."""
    of = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.struct(F.coalesce("label", F.lit("")), "value")))
    return claims.groupBy(sample).agg(of("path").alias("paths"), of("extension").alias("extensions"), of("count").alias("counts"), of("column").alias("columns"))


def trace_keys(steps: DataFrame, sample: str) -> DataFrame:
    """(sample, trace): what a trace touched, as keys; steps: those of ``trace_steps``."""
    first = lambda p: F.when(F.contains(p, F.lit("/")), F.concat(F.lit("dir "), F.split_part(p, F.lit("/"), F.lit(1))))
    path = lambda p: F.array(F.concat(F.lit("path "), p), F.concat(F.lit("name "), basename(p)), first(p))
    own = F.flatten(F.transform("path_candidates", lambda p: F.concat(path(p), F.array(F.when(suffix(p) != "", F.concat(F.lit("ext "), suffix(p)))))))

    def said(f: Column) -> Column:
        table = (f["kind"] == "column") | ((f["kind"] == "count") & f["label"].isin(*TABLE_LABELS))
        return F.when(f["kind"] == "path", path(f["value"])).when(f["kind"] == "extension", F.array(F.concat(F.lit("ext "), f["value"]))).when(table, F.array(F.concat(F.lit("path "), f["rel_path"]))).otherwise(F.array().cast("array<string>"))

    listing = F.when(F.exists("operations", lambda o: o.isin(*LISTING)), F.array(F.lit("inventory"))).otherwise(F.array().cast("array<string>"))
    all_ = F.array_compact(F.concat(own, F.flatten(F.transform("evidence", said)), listing))
    return steps.select(sample, F.explode(all_).alias("k")).groupBy(sample).agg(F.collect_set("k").alias("trace"))


def answer_keys(claims: DataFrame, sample: str) -> DataFrame:
    """(sample, told): what an answer names, as keys."""
    kind, value = F.col("kind"), F.col("value")
    path = F.array(F.concat(F.lit("path "), value), F.concat(F.lit("name "), basename(value)), F.concat(F.lit("dir "), F.split_part(value, F.lit("/"), F.lit(1))))
    k = F.when(kind == "path", path).when(kind == "extension", F.array(F.concat(F.lit("ext "), value))).when(kind == "column", F.array(F.concat(F.lit("column "), value))).otherwise(F.array(F.concat(F.lit("label "), F.col("label"))))
    return claims.select(sample, F.explode(k).alias("k")).groupBy(sample).agg(F.collect_set("k").alias("told"))


def target_hits(targets: DataFrame, steps: DataFrame, claims: DataFrame, answers: DataFrame, sample: str, answer: str) -> DataFrame:
    """``targets`` (sample, target_id, type, name, columns, weight) with trace_hit and answer_hit."""
    none = F.array().cast("array<string>")
    lower = parsers.normalize_free_text(F.coalesce(F.col(answer), F.lit("")))
    x = targets.join(trace_keys(steps, sample), sample, "left").join(answer_keys(claims, sample), sample, "left").join(answers.select(sample, T.folded(lower).alias("low")), sample, "left")
    trace, told, low, name = F.coalesce("trace", none), F.coalesce("told", none), F.coalesce("low", F.lit("")), F.col("name")
    has = lambda a, prefix, v: F.array_contains(a, F.concat(F.lit(prefix), v))
    labels = F.arrays_overlap(told, F.array(*[F.lit(f"label {v}") for v in INVENTORY_LABELS]))
    columns = F.arrays_overlap(told, F.transform(F.coalesce("columns", none), lambda c: F.concat(F.lit("column "), c)))
    kind = F.col("type")
    file = lambda a: has(a, "path ", name) | has(a, "name ", basename(name))
    traced = F.when(kind == "inventory", F.array_contains(trace, "inventory") | labels).when(kind == "extension", has(trace, "ext ", name)).when(kind == "subtree", has(trace, "dir ", name)).otherwise(file(trace))
    spoken = F.when(kind == "inventory", labels | low.rlike("|".join(INVENTORY_WORDS))).when(kind == "extension", has(told, "ext ", name) | F.contains(low, name)).when(kind == "subtree", F.contains(low, T.folded(name)) | has(told, "dir ", name)).otherwise(file(told) | columns)
    return x.select(*targets.columns, F.coalesce(traced, F.lit(False)).alias("trace_hit"), F.coalesce(spoken, F.lit(False)).alias("answer_hit"))


def coverage(hits: DataFrame, sample: str) -> DataFrame:
    """(sample, coverage_score, coverage_target_count, trace_hit_count, answer_hit_count, trace_weighted_recall, answer_weighted_recall)."""
    recall = lambda c: F.sum(F.when(F.col(c), F.col("weight")).otherwise(F.lit(0.0))) / F.sum("weight")
    return hits.groupBy(sample).agg(
        S.coverage(recall("trace_hit"), recall("answer_hit")).alias("coverage_score"), F.count("*").alias("coverage_target_count"), F.count_if("trace_hit").alias("trace_hit_count"), F.count_if("answer_hit").alias("answer_hit_count"),
        F.round(recall("trace_hit"), 4).alias("trace_weighted_recall"), F.round(recall("answer_hit"), 4).alias("answer_weighted_recall"),
    )


def recoveries(steps: DataFrame, sample: str, ahead: int = 3) -> DataFrame:
    """(sample, errors, recovered): failed steps, and those that one of the next ``ahead`` makes good: a success that shares a path or an operation."""
    from pyspark.sql import Window as W

    near = W.partitionBy(sample).orderBy("step_index").rowsBetween(1, ahead)
    later = F.collect_list(F.when(F.col("success"), F.struct("operations", "path_candidates"))).over(near)
    x = steps.withColumn("later", later)
    good = F.exists("later", lambda s: F.arrays_overlap(s["operations"], F.col("operations")) | F.arrays_overlap(s["path_candidates"], F.col("path_candidates")))
    return x.groupBy(sample).agg(F.count_if("result_error").alias("errors"), F.count_if(F.col("result_error") & F.coalesce(good, F.lit(False))).alias("recovered"))
