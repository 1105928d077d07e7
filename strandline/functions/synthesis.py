"""Questions and answers made from trajectories: reasoning steps, validation, prompts and what a model is asked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import text as T

#: Limits of a question, sentences that stand for a missing thought, and what an action is for.
MAX_WORDS, MAX_CHARS = 85, 500
WORD = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"
NO_THOUGHT = "I have gathered enough metadata from the previous exploration steps; let me compile everything into the final answer."
THOUGHT = "Now I have all the information needed to answer the question. Let me compile the metadata summary: "
NO_STEPS = "(no prior code steps yet)"
DIRECT = "<think>Based on the evidence, I can answer directly.</think>"
NO_REASONS = "<think>No valid reasoning steps were provided.</think>\n<answer></answer>"
START, DATASET = "Starting point: ", "\nDataset root path: "
EARLIER, RECENT = "[Earlier step summaries]\n", "[Recent detailed steps]\n"
STEP = "struct<text: string, think: string, python: string, result: string, answer: string>"


def tag_text(step: Column, tag: str) -> Column:
    """The first body of a tag in a step, whatever its case, trimmed; '' if there is none."""
    return T.strip(F.regexp_extract(F.coalesce(step, F.lit("")), rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1))


def reasoning_steps(steps: Column) -> Column:
    """array<string> of steps (structs of STEP): texts trimmed, objects as tags, blank ones left out; null as none."""
    block = lambda s, t: F.when(T.strip(s[t]) != "", F.concat(F.lit(f"<{t}>\n"), T.strip(s[t]), F.lit(f"\n</{t}>")))
    one = lambda s: F.coalesce(T.strip(s["text"]), F.concat_ws(" ", *[block(s, t) for t in ("think", "python", "result", "answer")]))
    return F.filter(F.transform(F.coalesce(steps, F.array().cast(f"array<{STEP}>")), one), lambda x: x != "")


def step_fault(steps: Column) -> Column:
    """``step N`` of the first step before the last that isn't thought, call and result alone, ``final`` if the last isn't thought and answer alone; else null."""
    has = lambda s, t: tag_text(s, t) != ""
    middle = lambda s: has(s, "think") & has(s, "python") & has(s, "result") & ~has(s, "answer")
    n = F.size(steps)
    bad = F.array_compact(F.transform(steps, lambda s, i: F.when((i < n - 1) & ~middle(s), i + 1)))
    last = F.get(steps, n - 1)
    ends = has(last, "think") & has(last, "answer") & ~has(last, "python") & ~has(last, "result")
    return F.when(F.size(bad) > 0, F.concat(F.lit("step "), F.get(bad, F.lit(0)).cast("string"))).when(~ends, "final")


def qa_verdict(question: Column, answer: Column, steps: Column) -> Column:
    """The first rule that a question with its answer and reasoning steps breaks, else ok."""
    q, a = T.strip(F.coalesce(question, F.lit(""))), T.strip(F.coalesce(answer, F.lit("")))
    plain = lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")
    fault = step_fault(steps)
    return (
        F.when((q == "") | (a == ""), "empty")
        .when(F.contains(plain(q), plain(a)), "answer_leak")
        .when((F.length(q) > MAX_CHARS) | (F.regexp_count(q, F.lit(WORD)) > MAX_WORDS), "too_verbose")
        .when(F.size(steps) < 2, "too_few_steps")
        .when(fault.isNotNull(), F.concat(F.lit("structure: "), fault))
        .when(tag_text(F.element_at(steps, -1), "answer") != a, "answers_differ")
        .otherwise("ok")
    )


def synthesized(qa: DataFrame) -> DataFrame:
    """The valid rows of ``qa`` (trajectory_id, source_id, qa_index, question, answer, steps) with qa_id and reasoning_steps."""
    x = qa.withColumn("reasoning_steps", reasoning_steps(F.col("steps")))
    x = x.where(qa_verdict(F.col("question"), F.col("answer"), F.col("reasoning_steps")) == "ok")
    return x.select(F.concat_ws("_qa_", "trajectory_id", F.col("qa_index").cast("string")).alias("qa_id"), T.strip(F.col("question")).alias("question"), T.strip(F.col("answer")).alias("answer"), "trajectory_id", "source_id", "reasoning_steps")


def chat_answer(steps: Column, answer: Column) -> Column:
    """The model's turn of a question: its steps by lines, with the answer after them if none of them has one; stock text without steps."""
    a, said = T.strip(F.coalesce(answer, F.lit(""))), T.strip(F.coalesce(F.array_join(steps, "\n"), F.lit("")))
    tagged = F.concat(F.lit("\n<answer>"), a, F.lit("</answer>"))
    alone = F.when(a != "", F.concat(F.lit(DIRECT), tagged)).otherwise(NO_REASONS)
    return F.when(said == "", alone).when((a != "") & ~said.rlike(r"(?is)<answer>.*?</answer>"), F.concat(said, tagged)).otherwise(said)


def chat_id(dataset: Column, *ids: Column, by_dataset: bool = False) -> Column:
    """The sample id of a question: its dataset and its first id that isn't blank, or the dataset alone."""
    return dataset if by_dataset else F.concat_ws("__", dataset, F.coalesce(*[F.nullif(i.cast("string"), F.lit("")) for i in ids]))


def fallback_thought(answer: Column, markup: bool = False) -> Column:
    """A thought that leads to the answer, with its first 200 characters on one line; ``markup``: drop signs of headings and lists before it."""
    x = T.squeeze(F.coalesce(answer, F.lit("")))
    x = F.regexp_replace(x, r"^[#>*\-\s]+", "") if markup else x
    shown = F.regexp_replace(F.substring(x, 1, 200), r"\s+\z", "")
    return F.when(x == "", NO_THOUGHT).otherwise(F.concat(F.lit(THOUGHT), shown, F.when(F.length(x) > F.length(shown), "...").otherwise("")))


def root_observation(seed: Column, dataset: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(seed, F.lit("")), F.when(F.coalesce(dataset, F.lit("")) != "", F.concat(F.lit(DATASET), dataset)).otherwise(""))


def action_catalog(types: dict[str, str] | list[str]) -> str:
    """Actions and what they are for, one a line."""
    known = types if isinstance(types, dict) else dict.fromkeys(types, "(custom action)")
    return "\n".join(f"- {k}: {v}" for k, v in known.items())


def one_line(text: Column, most: int) -> Column:
    x = T.squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def path_context(steps: DataFrame, sample: str, recent: int = 2, code_chars: int = 1200, observation_chars: int = 2500, total: int = 12_000) -> DataFrame:
    """(sample, context) of ``steps`` (sample, step, action_type, code, observation): older steps on a line each, the last ``recent`` clipped, all of it within ``total`` characters."""
    back = F.row_number().over(W.partitionBy(sample).orderBy(F.desc("step")))
    kind, number = F.coalesce(F.nullif(F.trim("action_type"), F.lit("")), F.lit("unknown")), F.col("step").cast("string")
    brief = F.concat(F.lit("- Step "), number, F.lit(" ["), kind, F.lit("] code="), one_line(F.col("code"), 180), F.lit(" | obs="), one_line(F.col("observation"), 240))
    full = F.concat(F.lit("Step "), number, F.lit(" ["), kind, F.lit("] code:\n"), T.clip(F.coalesce("code", F.lit("")), code_chars), F.lit("\n\nobservation:\n"), T.clip(F.coalesce("observation", F.lit("")), observation_chars))
    x = steps.withColumn("back", back).withColumn("shown", F.when(F.col("back") > recent, brief).otherwise(full))
    x = x.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("step", "back", "shown"))).alias("s"))
    part = lambda cond, head, by: F.when(F.exists("s", cond), F.concat(F.lit(head), F.array_join(F.transform(F.filter("s", cond), lambda e: e["shown"]), by)))
    whole = F.concat_ws("\n\n", part(lambda e: e["back"] > recent, EARLIER, "\n"), part(lambda e: e["back"] <= recent, RECENT, "\n\n"))
    return x.select(sample, F.coalesce(F.nullif(T.clip(whole, total), F.lit("")), F.lit(NO_STEPS)).alias("context"))


def node_id(prefix: str, *parts: Column) -> Column:
    """An id of a prefix and eight hexadecimal digits: of the parts' hash, so that it can be made again, or random without parts."""
    seed = F.concat_ws(":", *[p.cast("string") for p in parts]) if parts else F.uuid()
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(seed), 1, 8))


def rollout_temperature(rollout: Column) -> Column:
    return F.least(F.lit(0.85), 0.55 + 0.03 * rollout)


def chain_temperature(chain: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 + 0.05 * chain)


def attempt_temperature(attempt: Column) -> Column:
    return 0.7 + 0.1 * (attempt - 1)


def reduced_tokens(message: Column, current: Column) -> Column:
    """max_tokens after an overflow: half, or what the message says is left less 64, but 32 at least."""
    number = lambda pattern: F.regexp_extract(F.lower(message), pattern, 1).try_cast("bigint")
    room = number(r"maximum context length is ([0-9]+)") - number(r"contains at least ([0-9]+) input tokens") - 64
    half = F.floor(current / 2).cast("bigint")
    return F.greatest(F.lit(32), F.when(room.isNotNull(), F.least(half, F.greatest(F.lit(32), room))).otherwise(half))
