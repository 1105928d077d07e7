"""Tagged step text as blocks, their validity, and the steps of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import parsers
from strandline.functions import text as T

TAGS = (*T.CORE_TAGS, *T.TOOL_TAGS)
_ONE = "|".join(rf"<{t}>.*?(?:</{t}>|\z)" for t in TAGS)
BLOCK = rf"(?s)(?:{_ONE})"


def parse(text: Column) -> Column:
    """array<struct<tag, content, closed>>: in a tag only its own closer ends it, an unclosed one takes the rest."""
    return parse_rewritten(T.rewrite_tags(text))


def parse_rewritten(text: Column) -> Column:
    """``parse`` of text whose tags are canonical."""
    raw = F.regexp_extract_all(text, F.lit(BLOCK), 0)

    def block(x: Column) -> Column:
        tag = F.regexp_extract(x, r"^<([a-z]+)>", 1)
        closed = F.endswith(x, F.concat(F.lit("</"), tag, F.lit(">")))
        body = F.substr(x, F.length(tag) + 3)
        return F.struct(tag.alias("tag"), F.when(closed, F.substr(body, F.lit(1), F.length(body) - F.length(tag) - 3)).otherwise(body).alias("content"), closed.alias("closed"))

    return F.transform(raw, block)


def outside(text: Column) -> Column:
    """What is left of the text without its blocks."""
    return F.btrim(F.regexp_replace(T.rewrite_tags(text), BLOCK, ""))


def count_tag(blocks: Column, *tags: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["tag"].isin(*tags)))


def broken_rules(tags: Column, faults: Column) -> Column:
    """Names of the rules that a sequence of tags breaks, the parser's faults first, each once."""
    n = F.size(tags)
    count = lambda name: F.size(F.filter(tags, lambda t: t == name))
    answers, thinks, results = count("answer"), count("think"), count("result")
    tools = n - answers - thinks - results
    thought, answer = F.array_position(tags, "think").cast("int"), F.array_position(tags, "answer").cast("int")
    # What stands before the first thought, and after the first answer.
    early = F.when(thought > 0, F.slice(tags, F.lit(1), thought - 1)).otherwise(tags)
    late = F.when(answer > 0, F.slice(tags, answer + 1, n)).otherwise(F.slice(tags, 1, 0))
    has_tool = lambda a: F.size(F.array_except(a, F.array(*[F.lit(t) for t in T.CORE_TAGS]))) > 0
    rules = [
        (F.array_contains(late, "think"), "think_after_answer"),
        (F.array_contains(early, "result"), "result_before_think"),
        (F.array_contains(late, "result"), "result_after_answer"),
        (F.size(late) > 0, "answer_not_last"),
        (has_tool(early), "tool_before_think"),
        (has_tool(late), "tool_after_answer"),
        (n == 0, "no_blocks"),
        (answers != 1, "answer_count"),
        (thinks == 0, "no_think"),
        (F.coalesce(F.try_element_at(tags, F.lit(-1)), F.lit("")) != "answer", "last_not_answer"),
        ((tools > 0) & (tools != results), "tool_result_mismatch"),
        ((tools == 0) & (results > thinks), "more_results_than_thinks"),
    ]
    return F.array_distinct(F.concat(faults, F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))))


def tags_of(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: b["tag"])


def tolerant_faults(blocks: Column, rest: Column) -> Column:
    """Faults of the tolerant parser: text outside of blocks, closers without opener, blocks left open."""
    stray = rf"</(?:{'|'.join(TAGS)})>"
    loose = F.btrim(F.regexp_replace(rest, stray, ""))
    rules = [(rest.rlike(stray), "stray_closer"), (loose != "", "outside_text"), (F.exists(blocks, lambda b: ~b["closed"]), "unclosed")]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def format_errors(blocks: Column, rest: Column) -> Column:
    """Names of the rules that blocks of the tolerant grammar break; rest: the text outside of them."""
    return broken_rules(tags_of(blocks), tolerant_faults(blocks, rest))


def parsed_strict(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with blocks and errors by the strict grammar, in which tags nest and every closer ends the innermost."""
    x = rows.withColumn("_p", parsers.parse_strict(T.rewrite_tags(F.col(text))))
    x = x.withColumns({"blocks": F.col("_p.blocks"), "_tags": tags_of(F.col("_p.blocks"))})
    return x.withColumn("errors", broken_rules(F.col("_tags"), F.col("_p.faults"))).drop("_p", "_tags")


def parsed_tolerant(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with blocks and errors by the tolerant grammar; tags are rewritten once."""
    x = rows.withColumn("_t", T.rewrite_tags(F.col(text)))
    x = x.withColumns({"blocks": parse_rewritten(F.col("_t")), "_rest": F.btrim(F.regexp_replace("_t", BLOCK, ""))})
    x = x.withColumns({"_tags": tags_of(F.col("blocks")), "_faults": tolerant_faults(F.col("blocks"), F.col("_rest"))})
    return x.withColumn("errors", broken_rules(F.col("_tags"), F.col("_faults"))).drop("_t", "_rest", "_tags", "_faults")


def steps(parsed: DataFrame, sample: str) -> DataFrame:
    """One row per tool block: (sample, step_index, think_before, tool_tag, tool_content, result_content, result_error)."""
    rows = parsed.select(sample, F.posexplode("blocks").alias("pos", "b")).select(sample, "pos", "b.*")
    order = W.partitionBy(sample).orderBy("pos")
    rows = rows.withColumn("think_before", F.last(F.when(F.col("tag") == "think", F.col("content")), True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("next_tag", F.lead("tag").over(order)).withColumn("next", F.lead("content").over(order))
    tools = rows.where(F.col("tag").isin(*T.TOOL_TAGS))
    result = F.when(F.col("next_tag") == "result", F.col("next"))
    return tools.select(sample, F.row_number().over(order).alias("step_index"), "think_before", F.col("tag").alias("tool_tag"), F.col("content").alias("tool_content"), result.alias("result_content"), F.coalesce(T.has_error(result), F.lit(False)).alias("result_error"))
