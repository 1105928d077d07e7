"""Joins, upserts, duplicates, manifests and selection as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    row = F.struct(order, *[c for c in df.columns if c not in (key, order)])
    return df.groupBy(key).agg(F.min_by(row, F.col(order)).alias("r")).select(key, "r.*")


def lookup(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join with the first row of each key on the right."""
    return left.join(first_of(right, key, order).drop(order), key, "left")


def upsert(old: DataFrame, new: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Old rows whose key was not processed again (null keys stay), and all new rows."""
    return old.join(processed.select(key).distinct(), key, "left_anti").unionByName(new)


def duplicate_excess(df: DataFrame, group: str, strict: str, loose: str) -> DataFrame:
    """(group, calls, dup_calls, near_dup_calls)."""
    agg = df.groupBy(group).agg(F.count("*").alias("calls"), F.count_distinct(strict).alias("s"), F.count_distinct(loose).alias("l"))
    return agg.select(group, "calls", (F.col("calls") - F.col("s")).alias("dup_calls"), F.greatest(F.col("s") - F.col("l"), F.lit(0)).alias("near_dup_calls"))


def histogram(files: DataFrame, group: list[str], value: str, top: int | None = None, size: str | None = None) -> DataFrame:
    """Files by value within a group, with share and bytes; the ``top`` most frequent, ties by value."""
    aggs = [F.count("*").alias("n")] + ([F.sum(size).alias("bytes")] if size else [])
    x = files.groupBy(*group, value).agg(*aggs)
    x = x.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*group)), 4))
    if top is None:
        return x
    return x.withColumn("rk", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), value))).where(F.col("rk") <= top)


def support(claims: DataFrame, evidence: DataFrame, manifest: DataFrame, sample: str) -> DataFrame:
    """Claims (sample, label, value, weight, critical) with supported, in_manifest and contradicted."""
    exact = evidence.select(sample, "label", "value").distinct().withColumn("supported", F.lit(True))
    labels = evidence.select(sample, "label").distinct().withColumn("label_seen", F.lit(True))
    known = manifest.select("value").distinct().withColumn("in_manifest", F.lit(True))
    x = claims.join(exact, [sample, "label", "value"], "left").join(labels, [sample, "label"], "left").join(known, "value", "left")
    x = x.fillna(False, ["supported", "label_seen", "in_manifest"])
    return x.withColumn("contradicted", ~F.col("supported") & F.col("label_seen")).drop("label_seen")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def greedy_diverse(paths: DataFrame, group: str, score: str, order: str, nodes: str, most: int = 3, limit: float = 0.7) -> DataFrame:
    """Of each group's paths, best score first, those that overlap no chosen one by more than the limit, up to ``most``."""
    item = F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"), F.col(nodes).alias("x"))
    ordered = paths.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("p"))
    # The accumulator holds the chosen paths; it never grows beyond ``most``.
    start = F.filter("p", lambda _: F.lit(False))
    fits = lambda acc, x: (F.size(acc) < most) & F.forall(acc, lambda y: jaccard(x["x"], y["x"]) <= limit)
    chosen = F.aggregate("p", start, lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ordered.select(group, F.posexplode(chosen).alias("rk", "c")).select(group, F.col("c.o").alias(order), (F.col("rk") + 1).alias("rk"))


def recoveries(steps: DataFrame, sample: str, order: list[str], failed: str, op: str, ahead: int = 3) -> DataFrame:
    """Failed steps by sample and how many are made good by a success of the same operation within ``ahead`` steps."""
    frame = W.partitionBy(sample).orderBy(*order).rowsBetween(1, ahead)
    good = F.collect_list(F.when(~F.col(failed), F.col(op))).over(frame)
    x = steps.withColumn("made_good", F.col(failed) & F.array_contains(good, F.col(op)))
    return x.groupBy(sample).agg(F.count_if(failed).alias("errors"), F.count_if("made_good").alias("recovered"))


def tool_threshold(counts: DataFrame, group: str, count: str, base: int = 10) -> DataFrame:
    """The call threshold of each group: the order statistic at 0.8, or the maximum of three or fewer, within base..15.

    Counts are few, however many there are of each: the statistic is read off
    their running numbers.
    """
    x = counts.where(F.col(count) > 0).groupBy(group, F.col(count).alias("c")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy(group).orderBy("c"))
    total = F.sum("k").over(W.partitionBy(group))
    wanted = F.when(total <= 3, total).otherwise(F.bround(0.8 * (total - 1)) + 1)
    x = x.select(group, "c", (upto >= wanted).alias("reached")).where("reached").groupBy(group).agg(F.min("c").alias("anchor"))
    return x.select(group, F.greatest(F.lit(base), F.least(F.lit(15), F.col("anchor"))).cast("bigint").alias("threshold"))


def sibling_bias(nodes: DataFrame, family: str, visits: str, q: str, prior: str) -> DataFrame:
    """``nodes`` with bias, the mean of q less prior over the visited of their family (null if none is), and family_visits."""
    by_family = nodes.groupBy(family).agg(F.avg(F.when(F.col(visits) > 0, F.col(q) - F.col(prior))).alias("bias"), F.sum(visits).alias("family_visits"))
    return nodes.join(by_family, family)


def diverse_top(rows: DataFrame, group: str, kind: str, best: list, most: int) -> DataFrame:
    """The best ``most`` rows of each group, the best one of each kind first."""
    x = rows.withColumn("_rn", F.row_number().over(W.partitionBy(group, kind).orderBy(*best)))
    x = x.withColumn("_rk", F.row_number().over(W.partitionBy(group).orderBy((F.col("_rn") > 1), *best)))
    return x.where(F.col("_rk") <= most).drop("_rn", "_rk")


def zipped(a: Column, b: Column) -> Column:
    """array<struct> of the elements of two arrays at the same place, as far as both go."""
    return F.slice(F.arrays_zip(a, b), F.lit(1), F.greatest(F.lit(0), F.least(F.size(a), F.size(b))))


def by_score(rows: DataFrame, group: str, score: str, order: str, most: int | None = None) -> DataFrame:
    """``rows`` with rank (from 1) within their group by falling score, equal ones as they came; up to ``most``."""
    x = rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last(score), order)))
    return x if most is None else x.where(F.col("rank") <= most)


def distinct_tools(steps: DataFrame, path: str, tool: str) -> DataFrame:
    """(path, tools): different tools on each path; steps without a name are one."""
    return steps.groupBy(path).agg(F.count_distinct(F.coalesce(tool, F.lit(""))).alias("tools"))
