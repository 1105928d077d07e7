"""Score formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights, thresholds and floors of the scores.
V1_WEIGHTS = {"format": 0.20, "execution": 0.35, "completion": 0.25, "efficiency": 0.10, "coherence": 0.10}
V2_WEIGHTS = {"grounding": 0.30, "coverage": 0.25, "execution": 0.20, "answer_quality": 0.15, "efficiency": 0.10}
PROFILES = {"strict": (80, 40, 60, 55, 55), "lenient": (30, 12, 0, 0, 0)}


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def grounding(total: Column, supported: Column, manifest_only: Column, contradicted: Column, unsupported_critical: Column, claims: Column) -> Column:
    none = clamp(10.0 + 6.0 * claims, 0, 35)
    return F.when(total <= 0, none).otherwise(clamp(100.0 * (supported + 0.4 * manifest_only) / total - 35.0 * contradicted / total - 20.0 * unsupported_critical / total))


def coverage(trace_recall: Column, answer_recall: Column) -> Column:
    return F.round(100.0 * (0.7 * trace_recall + 0.3 * answer_recall), 2)


def execution(steps: Column, succeeded: Column, informative: Column, errors: Column, recovered: Column) -> Column:
    recovery = F.when(errors == 0, F.lit(1.0)).otherwise(ratio(recovered, errors))
    return F.when(steps == 0, F.lit(0.0)).otherwise(100.0 * (0.5 * ratio(succeeded, steps) + 0.35 * ratio(informative, steps) + 0.15 * recovery))


def efficiency(calls: Column, budget: Column, duplicates: Column, informative: Column, threshold: Column) -> Column:
    over_budget = calls / F.greatest(budget, F.lit(1))
    over = F.greatest(calls - threshold, F.lit(0))
    cost = (
        F.when(over_budget > 1, F.least(F.lit(30.0), 25.0 * (over_budget - 1))).otherwise(F.lit(0.0))
        + F.least(F.lit(25.0), 35.0 * ratio(duplicates, calls))
        + F.least(F.lit(35.0), 35.0 * ratio(calls - informative, calls))
        + F.when(over > 0, F.least(F.lit(15.0), 2.0 * over)).otherwise(F.lit(0.0))
    )
    return F.when(calls == 0, F.lit(0.0)).otherwise(clamp(100.0 - cost))


def composite(parts: dict[str, Column]) -> Column:
    """Weighted geometric mean, every part at least 1."""
    total = sum((w * F.log(F.greatest(F.lit(1.0), parts[k]) / 100.0) for k, w in V2_WEIGHTS.items()), F.lit(0.0))
    return F.round(F.exp(total) * 100.0, 2)


def composite_v1(parts: dict[str, Column]) -> Column:
    return F.round(sum((w * parts[k] for k, w in V1_WEIGHTS.items()), F.lit(0.0)), 2)


def split_v1(score: Column, sft: float = 80, rl: float = 40) -> Column:
    return F.when(score >= sft, "sft").when(score >= rl, "rl").otherwise("discard")


def split_v2(gate: Column, score: Column, ground: Column, cover: Column, quality: Column, profile: str = "strict") -> Column:
    sft, rl, g, c, q = PROFILES[profile]
    good = gate & (score >= sft) & (ground >= g) & (cover >= c) & (quality >= q)
    return F.when(good, "sft").when(gate & (score >= rl), "rl").otherwise("discard")


def tool_budget(files: Column, extensions: Column, subtrees: Column, tables: Column, truncated: Column) -> Column:
    depth = F.when(files > 0, F.least(F.lit(6), F.ceil(F.log2(files + 1)))).otherwise(0)
    return F.least(F.lit(24), F.greatest(F.lit(4), 3 + depth + F.least(F.lit(4), extensions) + F.least(F.lit(4), subtrees) + F.least(F.lit(4), tables) + F.when(truncated, 2).otherwise(0))).cast("bigint")


def target_weight(share: Column) -> Column:
    return F.round(1.0 + F.least(F.lit(1.5), 3.0 * share), 2)


def uct(visits: Column, parent_visits: Column, q: Column, prior: Column, depth: Column, bias: Column, rate: float = 1.0, first: float = 0.1, deep: float = 0.05, decay: str = "sqrt") -> Column:
    log_n = F.sqrt(F.log(F.greatest(parent_visits, F.lit(1)) + 1.0))
    bonus = deep * depth
    fresh = F.greatest(prior + F.coalesce(bias, F.lit(0.0)) - first, F.lit(0.0)) + rate * prior * log_n + bonus
    falls = F.sqrt(1.0 + visits) if decay == "sqrt" else 1.0 + visits
    return F.when(visits == 0, fresh).otherwise(q + rate * prior * log_n / falls + bonus)


def prior_entropy(priors: Column, temperature: float = 0.3) -> Column:
    """Entropy of the softmax of priors over the temperature, as a share of its maximum.

    One pass: with e = exp((p - top) / T) it is ln(sum e) - sum(e (p - top) / T) / sum e.
    """
    if temperature <= 0:
        return F.lit(0.0)
    top = F.array_max(priors)

    def add(acc: Column, p: Column) -> Column:
        z = (p - acc["top"]) / temperature
        return F.struct((acc["e"] + F.exp(z)).alias("e"), (acc["ez"] + F.exp(z) * z).alias("ez"), acc["top"].alias("top"))

    start = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("ez"), top.cast("double").alias("top"))
    h = F.aggregate(priors, start, add, lambda a: F.log(a["e"]) - a["ez"] / a["e"])
    return F.when(F.size(priors) <= 1, F.lit(0.0)).otherwise(clamp(h / F.log(F.size(priors).cast("double")), 0, 1))


def token_entropy(logprobs: Column, tokens: int = 20) -> Column:
    """Entropy of the first tokens' alternatives as a share of its maximum.

    logprobs: array of structs with ``logprob`` and ``top_logprobs``, an array
    of structs with ``logprob``.  A token without alternatives counts by its
    own logprob, one without either not at all.  Null or empty gives 0.
    """
    known = lambda a: F.filter(a, lambda v: v.isNotNull())
    own = lambda t: F.array(t["logprob"].cast("double"))
    each = F.transform(
        F.slice(logprobs, 1, tokens),
        lambda t: known(F.when(F.coalesce(F.size(t["top_logprobs"]), F.lit(0)) > 0, F.transform(t["top_logprobs"], lambda x: x["logprob"].cast("double"))).otherwise(own(t))),
    )
    n = F.size(F.filter(each, lambda a: F.size(a) > 0)).cast("double")
    flat = F.flatten(each)
    h = F.aggregate(flat, F.lit(0.0), lambda a, v: a - F.exp(v) * v)
    width = F.size(flat) / n
    most = F.when(width > 1, n * F.log(width)).otherwise(n * F.exp(F.lit(-1.0)))
    return F.coalesce(F.when(n > 0, clamp(h / most, 0, 1)), F.lit(0.0))


def step_entropy(prior: Column, token: Column, prior_weight: float = 0.5, token_weight: float = 0.5) -> Column:
    """Weighted mean of the two entropies; the prior's alone where ``token`` is null or no weight is left."""
    both = prior_weight + token_weight
    mean = clamp((prior_weight * prior + token_weight * clamp(token, 0, 1)) / both, 0, 1) if both > 0 else prior
    return F.when(token.isNull(), clamp(prior, 0, 1) if prior_weight > 0 else prior).otherwise(mean)


def branches(entropy: Column, n: Column, most: int, least: int = 1) -> Column:
    cap = F.least(F.lit(most), n)
    floor = F.greatest(F.lit(1), F.least(F.lit(least), cap))
    return F.when(n <= 0, 0).otherwise(F.greatest(floor, F.least(cap, F.bround(floor + (cap - floor) * entropy)))).cast("bigint")


def path_score(length: Column, avg_obs: Column, low: Column, high: Column, tools: Column, all_tools: Column, leaf_q: Column) -> Column:
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return 40.0 * F.least(length / 20.0, F.lit(1.0)) + 30.0 * (avg_obs - low) / span + 30.0 * tools / F.greatest(all_tools, F.lit(1)) + 25.0 * F.greatest(leaf_q, F.lit(0.0))


#: Weights of claims by kind, those that are critical, and the words of a section.
CLAIM_WEIGHTS = {"path": 1.0, "extension": 0.7, "count": 1.4, "column": 1.1}
CRITICAL = ("path", "count", "column")
SECTIONS = {
    "inventory": ("file", "directory", "folder", "extension", "subdir", "subdirectory"),
    "schema": ("schema", "column", "field", "row", "record", "dtype"),
    "summary": ("summary", "metadata", "dataset", "structure"),
    "calibration": ("uncertain", "unable", "not inspected", "not available", "could not", "missing"),
}


def claim_weight(kind: Column) -> Column:
    return sum((F.when(kind == k, F.lit(w)).otherwise(0.0) for k, w in CLAIM_WEIGHTS.items()), F.lit(0.0))


def section_hits(lower: Column) -> Column:
    """How many groups of section words a lower-case text touches."""
    return sum((lower.rlike("|".join(words)).cast("int") for words in SECTIONS.values()), F.lit(0))


def paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), lambda x: x.rlike(r"\S")))


def structure(is_json: Column, n_paragraphs: Column, n_sections: Column, meta_json: Column) -> Column:
    share = lambda n: F.least(F.lit(1.0), n / 3.0)
    parts = 0.15 + 0.40 * is_json.cast("int") + 0.20 * share(n_paragraphs) + 0.20 * share(n_sections) + 0.05 * meta_json.cast("int")
    return F.least(F.lit(1.0), parts)


def specificity(paths: Column, extensions: Column, counts: Column, columns: Column) -> Column:
    return F.least(F.lit(1.0), (paths + extensions + 1.2 * counts + 0.5 * columns) / 8.0)


def consistency(total: Column, contradicted: Column, unsupported_critical: Column, answered: Column) -> Column:
    held = F.greatest(F.lit(0.0), 1.0 - 0.9 * ratio(contradicted, total) - 0.4 * ratio(unsupported_critical, total))
    return F.when(total > 0, held).when(answered, F.lit(0.35)).otherwise(F.lit(0.0))


def calibration(cover: Column, uncertain: Column, contradictions: Column) -> Column:
    low = F.when(uncertain, F.lit(1.0)).otherwise(F.lit(0.30))
    return F.when(cover < 60, low).when(contradictions == 0, F.lit(0.90)).otherwise(F.lit(0.50))


def answer_quality(structured: Column, specific: Column, consistent: Column, calibrated: Column) -> Column:
    return clamp(100.0 * (0.35 * structured + 0.25 * specific + 0.25 * consistent + 0.15 * calibrated))


def coverage_without_targets(operations: Column, paths: Column, claims: Column) -> Column:
    return F.round(clamp(15.0 + 12.0 * operations + 4.0 * paths + 3.0 * claims), 2)


def tokens_used(exact: Column, characters: Column) -> Column:
    """Counted tokens, else a quarter of the characters, one at least."""
    return F.coalesce(exact.cast("bigint"), F.greatest(F.lit(1), F.floor(characters / 4)).cast("bigint"))


def judge_score(reply: Column) -> Column:
    """``score`` of a reply's JSON object, 0 where it is no number, within 0 and 1."""
    return clamp(F.coalesce(F.get_json_object(reply, "$.score").try_cast("double"), F.lit(0.0)), 0, 1)


def strategy_prior(prior: Column, confidence: Column) -> Column:
    return clamp(prior * clamp(confidence, 0, 1), 0, 1)


def warnings(manifest: Column, steps: Column, errors: Column, duplicates: Column, near: Column, threshold: Column, unsupported: Column, contradicted: Column, cover: Column) -> Column:
    """Names of what is doubtful about a trajectory."""
    rules = {
        "manifest_unavailable": ~manifest, "no_tool_calls": steps == 0, "result_errors": errors > 0, "duplicate_tool_calls": duplicates > 0,
        "near_duplicate_tool_calls": near > 0, "tool_frequency_exceeded": steps > threshold, "unsupported_answer_claims": unsupported > 0,
        "answer_evidence_conflict": contradicted > 0, "underexplored_dataset": cover < 50,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def warnings_v1(valid: Column, answered: Column, calls: Column, threshold: Column, duplicates: Column) -> Column:
    """Names of what is doubtful about a trajectory by the format-centred rules."""
    rules = {"format_invalid": ~valid, "empty_answer": ~answered, "tool_frequency_exceeded": calls > threshold, "duplicate_tool_calls": duplicates > 0}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def parts_v1(errors: Column, results: Column, succeeded: Column, answered: Column, over: Column, duplicates: Column, thinks: Column, said: Column) -> dict[str, Column]:
    """The five parts of the format-centred score."""
    return {
        "format": F.greatest(F.lit(0.0), 100.0 - 20.0 * errors),
        "execution": F.when(results == 0, F.lit(50.0)).otherwise(100.0 * succeeded / results),
        "completion": F.when(answered, F.lit(100.0)).otherwise(F.lit(0.0)),
        "efficiency": F.greatest(F.lit(0.0), 100.0 - F.least(F.lit(50.0), 10.0 * F.greatest(over, F.lit(0))) - F.least(F.lit(40.0), 15.0 * duplicates)),
        "coherence": F.when(thinks == 0, F.lit(0.0)).otherwise(100.0 * said / thinks),
    }


#: Tools that run programs, and the calls that are usual with them alone and else.
RUNS = ("python", "bash", "sql", "code", "calculator")
USUAL_RUNS, USUAL = 10, 7


def usual_calls(tags: Column) -> Column:
    """Calls that are usual for the tools seen: more where all of them run programs."""
    only = (F.size(tags) > 0) & (F.size(F.array_except(tags, F.array(*[F.lit(t) for t in RUNS]))) == 0)
    return F.when(F.coalesce(only, F.lit(False)), F.lit(USUAL_RUNS)).otherwise(F.lit(USUAL))
