"""Fields of records under any of their names, and records for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strandline.functions import parsers
from strandline.functions import text as T
from strandline.operators.relational import first_of
from strandline.sources.records import KEYS

#: Bodies that stand for a missing answer.
PLACEHOLDERS = ("", "answer here", "the final answer is")


def first_nonempty(df: DataFrame, *keys: str) -> Column:
    """The first of the columns of ``df`` among ``keys`` that isn't null or empty, as text (arrays joined by lines); null if none is.

    A text of white space is a value, as in the records' own rules; where it
    mustn't be, callers trim.
    """

    def text(name: str) -> Column:
        return F.array_join(name, "\n") if isinstance(df.schema[name].dataType, ArrayType) else F.col(name).cast("string")

    return F.coalesce(F.lit(None).cast("string"), *[F.nullif(text(k), F.lit("")) for k in keys if k in df.columns])


def sample_id(df: DataFrame, ordinal: str) -> Column:
    """The id, else the MD5 of the normalised query, else ``sample_`` and the ordinal."""
    query = parsers.normalize_free_text(F.coalesce(first_nonempty(df, *KEYS["query"]), F.lit("")))
    return F.coalesce(first_nonempty(df, *KEYS["id"]), F.md5(F.nullif(query, F.lit(""))), F.concat(F.lit("sample_"), F.col(ordinal).cast("string")))


def base_prompt(df: DataFrame) -> Column:
    """What was asked, '' if nothing was."""
    return F.coalesce(first_nonempty(df, *KEYS["query"]), F.lit(""))


def prediction(df: DataFrame) -> Column:
    """The prediction if not blank, else the last answer of the trajectory."""
    said = first_nonempty(df, *KEYS["prediction"])
    return F.coalesce(F.nullif(T.strip(said), F.lit("")), T.last_answer(first_nonempty(df, *KEYS["trajectory"])))


def reference(df: DataFrame) -> Column:
    """The reference answer of a record, trimmed; null where there is none or a blank one."""
    return F.nullif(T.strip(first_nonempty(df, *KEYS["reference"])), F.lit(""))


def with_reference(records: DataFrame, references: DataFrame, key: str, order: str) -> DataFrame:
    """``records`` with reference: their own, else that of the first row of ``references`` with their key; null if neither has one."""
    index = first_of(references.select(key, order, reference(references).alias("_indexed")), key, order).drop(order)
    own = records.withColumn("_own", reference(records))
    return own.join(index, key, "left").withColumn("reference", F.coalesce("_own", "_indexed")).drop("_own", "_indexed")


def with_direct(records: DataFrame, direct: DataFrame, key: str, order: str) -> DataFrame:
    """``records`` (reference, tir_prediction) with the direct prediction and reference of their key, both matches and the difficulty."""
    d = first_of(direct.select(key, order, prediction(direct).alias("dr_prediction"), reference(direct).alias("_dr_reference")), key, order).drop(order)
    x = records.join(d, key, "left").withColumn("reference", F.coalesce("reference", "_dr_reference")).drop("_dr_reference")
    x = x.withColumns({"tir_correct": T.answers_match(F.col("tir_prediction"), F.col("reference")), "dr_correct": T.answers_match(F.col("dr_prediction"), F.col("reference"))})
    return x.withColumn("difficulty_category", difficulty(F.col("dr_correct"), F.col("tir_correct")))


def difficulty(direct: Column, with_tools: Column) -> Column:
    """The class of a sample by which of two predictions is right; null if either is unknown."""
    word = lambda c: F.when(c, "correct").otherwise("wrong")
    n = F.when(direct & with_tools, "1").when(direct, "2").when(with_tools, "3").otherwise("4")
    label = F.concat(F.lit("category_"), n, F.lit("_dr_"), word(direct), F.lit("_tir_"), word(with_tools))
    return F.when(direct.isNotNull() & with_tools.isNotNull(), label)


def log_only(trees: DataFrame, ordinal: str) -> DataFrame:
    """(trajectory_id, source_id, seed_data, total_depth, logs) of stored trees, with defaults for what is missing; logs: those of all nodes in order."""
    none = F.array().cast("array<string>")
    logs = F.flatten(F.transform(F.coalesce("nodes", F.array().cast(trees.schema["nodes"].dataType)), lambda n: F.coalesce(n["logs"], none)))
    ids = F.coalesce(F.nullif("trajectory_id", F.lit("")), F.concat(F.lit("traj_"), F.col(ordinal).cast("string")))
    return trees.select(ids.alias("trajectory_id"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("seed_data", F.lit("")).alias("seed_data"), F.coalesce(F.nullif("total_depth", F.lit(0)), F.greatest(F.size("nodes"), F.lit(0))).alias("total_depth"), logs.alias("logs"))


def is_placeholder(answer: Column) -> Column:
    """Whether an answer is blank or a template not filled in."""
    x = F.lower(T.strip(F.coalesce(answer, F.lit(""))))
    return x.isin(*PLACEHOLDERS) | F.contains(x, F.lit("boxed{answer here}")) | x.rlike(r"boxed\s*\{\s*\}")


def final_think_answer(reply: Column) -> Column:
    """struct<think, answer>: the first think body; the first answer body, else what follows the last think without tags."""
    body = lambda tag: T.strip(F.regexp_extract(reply, rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    rest = F.regexp_replace(F.regexp_replace(reply, r"(?is)^.*</think>", ""), r"(?i)</?(?:think|python|result|answer)>", "")
    answer = F.when(reply.rlike(r"(?is)<answer>.*?</answer>"), body("answer")).otherwise(T.strip(rest))
    return F.struct(F.coalesce(body("think"), F.lit("")).alias("think"), F.coalesce(answer, F.lit("")).alias("answer"))


SCORES_V1 = ("format", "execution", "completion", "efficiency", "coherence")
SCORES_V2 = ("grounding", "coverage", "execution", "efficiency", "answer_quality")


def training_record(scored: DataFrame, split: str, scores: tuple[str, ...] = SCORES_V2, detail: bool = True, normalized: bool = False) -> DataFrame:
    """Records of the rows routed to ``split``: sample_id, input, output, prediction, composite_score, reward (rl alone), quality_detail, split, and reference, difficulty_category and normalized_output where there are such columns. Writers leave null fields out."""
    reward = [F.round(F.col("composite_score") / 100, 4).alias("reward")] if split == "rl" else []
    parts = [F.struct(*[f"{n}_score" for n in scores]).alias("quality_detail")] if detail else []
    more = [c for c in ("reference", "difficulty_category", *(("normalized_output",) if normalized else ())) if c in scored.columns]
    return scored.where(F.col("split") == split).select("sample_id", "input", "output", "prediction", "composite_score", *reward, *parts, "split", *more)


def sft_record(scored: DataFrame, **options: object) -> DataFrame:
    return training_record(scored, "sft", **options)


def rl_record(scored: DataFrame, **options: object) -> DataFrame:
    return training_record(scored, "rl", **options)


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """(reason, n) over all arrays of reasons, by reason."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def report(scored: DataFrame, scores: list[str], flags: list[str]) -> DataFrame:
    """One row: rows, rows by split, means of scores (0 where there are none) and rows with each flag."""
    by_split = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("sft", "rl", "discard")]
    means = [F.coalesce(F.round(F.avg(s), 2), F.lit(0.0)).alias(f"mean_{s}") for s in scores]
    return scored.agg(F.count("*").alias("n"), *by_split, *means, *[F.count_if(f).alias(f"n_{f}") for f in flags])


def counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n) by value, null left out."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
