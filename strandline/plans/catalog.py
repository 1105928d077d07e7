"""All named queries over the driver's tables, each with an independent SQL version for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import blocks, graph
from strandline.operators import projections as P
from strandline.operators import relational as R
from strandline.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: object) -> object:
    return F.round(c, 4)


# Trajectories made of conversations: user turns think, assistant turns are a python call with its result,
# the last turn, if an assistant's, is the answer.
TURNS = """
turns as (select conv_id, turn, role, text, max(turn) over (partition by conv_id) as last from conversations),
tagged as (select conv_id, turn, case when role <> 'assistant' then '<think>' || text || '</think>'
  when turn = last then '<answer>' || text || '</answer>'
  else '<python>' || text || '</python><result>' || text || '</result>' end as block from turns),
traj as (select conv_id, string_agg(block, '' order by turn, block) as body from tagged group by conv_id)"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, body)."""
    t = table(spark, sf_dir, "conversations")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
    t = t.join(last, "conv_id")
    tag = lambda n: F.concat(F.lit(f"<{n}>"), F.col("text"), F.lit(f"</{n}>"))
    block = F.when(F.col("role") != "assistant", tag("think")).when(F.col("turn") == F.col("last"), tag("answer")).otherwise(F.concat(tag("python"), tag("result")))
    rows = t.select("conv_id", F.struct("turn", block.alias("block")).alias("s")).groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["block"]), "").alias("body"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.parsed_tolerant(trajectories(spark, sf_dir), "body")


COUNTS = """
counts as (select t.conv_id, t.role, t.text, t.turn, t.last,
  case when role <> 'assistant' then 1 else 0 end as thinks,
  case when role = 'assistant' and turn = last then 1 else 0 end as answers,
  case when role = 'assistant' and turn < last then 1 else 0 end as tools,
  case when role = 'assistant' and turn < last and regexp_matches(lower(text), 'traceback|exception|error|failed|not found|timeout') then 1 else 0 end as bad,
  case when role <> 'assistant' and trim(text) <> '' then 1 else 0 end as said
  from turns t),
per as (select conv_id, sum(thinks) as thinks, sum(answers) as answers, sum(tools) as tools, sum(bad) as bad, sum(said) as said,
  min(case when thinks = 1 then turn end) as first_think, min(case when tools = 1 then turn end) as first_tool from counts group by conv_id),
rules as (select *, (case when answers <> 1 then 1 else 0 end + case when thinks = 0 then 1 else 0 end + case when answers <> 1 then 1 else 0 end
  + case when first_tool is not null and (first_think is null or first_tool < first_think) then 2 else 0 end) as n_errors from per)"""


@query(f"with {TURNS}, {COUNTS} select conv_id, thinks::bigint as n_think, tools::bigint as n_tool, answers::bigint as n_answer, n_errors::bigint as n_errors from rules")
def format_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each trajectory and how many format rules it breaks."""
    b = F.col("blocks")
    return parsed(spark, sf_dir).select("conv_id", blocks.count_tag(b, "think").cast("bigint").alias("n_think"), blocks.count_tag(b, *T.TOOL_TAGS).cast("bigint").alias("n_tool"), blocks.count_tag(b, "answer").cast("bigint").alias("n_answer"), F.size("errors").cast("bigint").alias("n_errors"))


def scored_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("blocks")
    results, thinks = F.filter(b, lambda x: x["tag"] == "result"), F.filter(b, lambda x: x["tag"] == "think")
    good = F.size(F.filter(results, lambda x: ~T.has_error(x["content"])))
    said = F.size(F.filter(thinks, lambda x: F.btrim(x["content"]) != ""))
    answered = F.exists(b, lambda x: (x["tag"] == "answer") & (F.btrim(x["content"]) != ""))
    parts = S.parts_v1(F.size("errors"), F.size(results), good, answered, blocks.count_tag(b, *T.TOOL_TAGS) - 7, F.lit(0), F.size(thinks), said)
    return parsed(spark, sf_dir).select("conv_id", *[v.alias(k) for k, v in parts.items()]).withColumn("composite", S.composite_v1({k: F.col(k) for k in parts}))


V1 = f"""with {TURNS}, {COUNTS}, parts as (select conv_id, greatest(0.0, 100.0 - 20.0 * n_errors)::double as format,
  case when tools = 0 then 50.0 else 100.0 * (tools - bad) / tools end::double as execution,
  case when answers = 1 then 100.0 else 0.0 end::double as completion,
  (100.0 - least(50.0, 10.0 * greatest(tools - 7, 0)))::double as efficiency,
  case when thinks = 0 then 0.0 else 100.0 * said / thinks end::double as coherence from rules),
v1 as (select *, round(0.2 * format + 0.35 * execution + 0.25 * completion + 0.1 * efficiency + 0.1 * coherence, 2) as composite from parts)"""


@query(V1 + " select conv_id, round(format, 4) as format, round(execution, 4) as execution, round(completion, 4) as completion, round(efficiency, 4) as efficiency, round(coherence, 4) as coherence, composite from v1")
def v1_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five parts and the composite of the format-centred score."""
    return scored_v1(spark, sf_dir).select("conv_id", *[r4(c).alias(c) for c in S.V1_WEIGHTS], "composite")


@query(V1 + " select case when composite >= 80 then 'sft' when composite >= 40 then 'rl' else 'discard' end as split, count(*) as n, round(avg(composite), 2) as mean_composite from v1 group by 1")
def v1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories by training split."""
    x = scored_v1(spark, sf_dir).withColumn("split", S.split_v1(F.col("composite")))
    return x.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("composite"), 2).alias("mean_composite"))


@query(f"""with {TURNS} select t.conv_id, row_number() over (partition by t.conv_id order by t.turn) as step_index, md5(t.text) as tool_md5,
  (select md5(u.text) from turns u where u.conv_id = t.conv_id and u.turn < t.turn and u.role <> 'assistant' order by u.turn desc limit 1) as think_md5,
  regexp_matches(lower(t.text), 'traceback|exception|error|failed|not found|timeout') as result_error
  from turns t where t.role = 'assistant' and t.turn < t.last""")
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with the last thought before and whether the result is an error."""
    x = blocks.steps(parsed(spark, sf_dir), "conv_id")
    return x.select("conv_id", "step_index", F.md5("tool_content").alias("tool_md5"), F.md5("think_before").alias("think_md5"), "result_error")


EVENTS = "ev as (select *, user_id::varchar || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') as sid, event_type = 'error' as failed, event_type || ':' || props as strict from events)"


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sid = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    return e.select(sid.alias("sid"), "ts", "event_id", "user_id", "event_type", (F.col("event_type") == "error").alias("failed"), F.concat_ws(":", "event_type", "props").alias("strict"), "props", "value")


@query(f"with {EVENTS} select sid, count(*) as calls, count(*) - count(distinct strict) as dup_calls, greatest(count(distinct strict) - count(distinct event_type), 0) as near_dup_calls from ev group by sid")
def dup_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated calls of each trace."""
    return R.duplicate_excess(event_steps(spark, sf_dir), "sid", "strict", "event_type")


@query(f"""with {EVENTS}, o as (select *, row_number() over (partition by sid order by ts, event_id) as i from ev)
  select a.sid, count(*) filter (where a.failed) as errors, count(*) filter (where a.failed and exists (select 1 from o b where b.sid = a.sid and b.i between a.i + 1 and a.i + 3 and not b.failed and b.props = a.props)) as recovered from o a group by a.sid""")
def recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and those made good within three steps by the same payload."""
    return R.recoveries(event_steps(spark, sf_dir), "sid", ["ts", "event_id"], "failed", "props")


EXEC = f"""with {EVENTS}, o as (select *, row_number() over (partition by sid order by ts, event_id) as i from ev),
 s as (select a.sid, count(*) as steps, count(*) filter (where not a.failed) as ok, count(*) filter (where not a.failed and a.value > 50) as inf, count(*) filter (where a.failed) as errors,
  count(*) filter (where a.failed and exists (select 1 from o b where b.sid = a.sid and b.i between a.i + 1 and a.i + 3 and not b.failed and b.props = a.props)) as rec,
  count(*) - count(distinct strict) as dups from o a group by a.sid)"""


def exec_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_steps(spark, sf_dir)
    agg = e.groupBy("sid").agg(F.count("*").alias("steps"), F.count_if(~F.col("failed")).alias("ok"), F.count_if(~F.col("failed") & (F.col("value") > 50)).alias("inf"))
    return agg.join(R.recoveries(e, "sid", ["ts", "event_id"], "failed", "props"), "sid").join(R.duplicate_excess(e, "sid", "strict", "event_type").drop("calls"), "sid")


@query(EXEC + " select sid, round(100.0 * (0.5 * ok / steps + 0.35 * inf / steps + 0.15 * case when errors = 0 then 1.0 else rec * 1.0 / errors end), 4) as score from s")
def exec_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution score of each trace."""
    c = F.col
    return exec_parts(spark, sf_dir).select("sid", r4(S.execution(c("steps"), c("ok"), c("inf"), c("errors"), c("recovered"))).alias("score"))


@query(EXEC + """ select sid, round(greatest(0.0, least(100.0, 100.0 - case when steps / 8.0 > 1 then least(30.0, 25.0 * (steps / 8.0 - 1)) else 0 end - least(25.0, 35.0 * dups / steps)
  - least(35.0, 35.0 * (steps - inf) / steps) - case when steps > 10 then least(15.0, 2.0 * (steps - 10)) else 0 end)), 4) as score from s""")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficiency score of each trace, with a budget of 8 calls and a threshold of 10."""
    c = F.col
    return exec_parts(spark, sf_dir).select("sid", r4(S.efficiency(c("steps"), F.lit(8), c("dup_calls"), c("inf"), F.lit(10))).alias("score"))


@query("""with c as (select event_type, user_id, count(*) as n from events group by all),
  l as (select event_type, list_sort(list(n)) as c, count(*) as k from c group by 1)
  select event_type, greatest(10, least(15, case when k <= 3 then list_max(c) else c[(round_even(0.8 * (k - 1), 0))::int + 1] end))::bigint as threshold from l""")
def tool_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call thresholds from the order statistic of calls by user."""
    return R.tool_threshold(table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")), "event_type", "n")


@query(r"""with t as (select page_id, unnest(regexp_extract_all(url, '\.[A-Za-z0-9]{1,8}\b')) as e from pages) select page_id, string_agg(distinct lower(e), ',' order by lower(e)) as exts from t group by 1""")
def ext_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension tokens of page addresses."""
    x = table(spark, sf_dir, "pages").select("page_id", F.array_join(T.extension_tokens(F.col("url")), ",").alias("exts"))
    return x.where("exts <> ''")


@query(r"""with t as (select page_id, list_concat(regexp_extract_all(url, '(?:[A-Za-z]:)?(?:[/\\][^\s<>''"`]+)+'), regexp_extract_all(url, '\b[\w.\-]+\.[A-Za-z0-9]{1,8}\b')) as p from pages),
 n as (select page_id, list_transform(p, lambda x: ltrim(regexp_replace(rtrim(replace(trim(x, '''"` '), '\', '/'), '.,;:'), '^file://', ''), './')) as p from t)
 select page_id, array_to_string(list_sort(list_distinct(list_filter(p, lambda x: x <> ''))), ',') as paths from n""")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path tokens of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.path_tokens(F.col("url")), ",").alias("paths"))


@query("""select o_orderkey, 'row_count' as label, o_custkey as value from orders union all select o_orderkey, 'row_count', 3 from orders where o_custkey <> 3 union all select o_orderkey, 'column_count', o_orderkey % 7 from orders""")
def count_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts stated in text made of orders."""
    said = F.concat(F.lit("rows: "), F.col("o_custkey").cast("string"), F.lit("\nshape = (3, "), (F.col("o_orderkey") % 7).cast("string"), F.lit(")"))
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.count_facts(said)).alias("f"))
    return x.select("o_orderkey", "f.label", "f.value")


CLAIMS = """with ev as (select distinct l_orderkey as sid, l_returnflag as label, l_partkey as value from lineitem where l_linenumber <= 2),
 man as (select p_partkey as value from part where p_size >= 25),
 cl as (select distinct l_orderkey as sid, l_returnflag as label, l_partkey as value, l_linestatus = 'O' as critical, 1.0 + l_linenumber * 0.1 as weight from lineitem where l_linenumber >= 2),
 m as (select c.*, exists (select 1 from ev e where e.sid = c.sid and e.label = c.label and e.value = c.value) as supported, exists (select 1 from man where man.value = c.value) as in_manifest,
   exists (select 1 from ev e where e.sid = c.sid and e.label = c.label) as seen from cl c)"""


def claim_support_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("value"), (F.col("l_linestatus") == "O").alias("critical"), (1.0 + F.col("l_linenumber") * 0.1).alias("weight"), "l_linenumber")  # noqa: E741
    man = table(spark, sf_dir, "part").where("p_size >= 25").select(F.col("p_partkey").alias("value"))
    claims = l.where("l_linenumber >= 2").drop("l_linenumber").distinct()
    return R.support(claims, l.where("l_linenumber <= 2"), man, "sid")


@query(CLAIMS + " select count(*) as claims, count(*) filter (where supported) as supported, count(*) filter (where not supported and in_manifest) as manifest_only, count(*) filter (where not supported and seen) as contradicted, count(*) filter (where not supported and critical) as unsupported_critical from m")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How claims stand against evidence and manifest."""
    s = F.col("supported")
    return claim_support_rows(spark, sf_dir).agg(F.count("*").alias("claims"), F.count_if(s).alias("supported"), F.count_if(~s & F.col("in_manifest")).alias("manifest_only"), F.count_if("contradicted").alias("contradicted"), F.count_if(~s & F.col("critical")).alias("unsupported_critical"))


GROUND = CLAIMS + """, g as (select sid, count(*) as n, sum(weight) as w, coalesce(sum(weight) filter (where supported), 0) as s, coalesce(sum(weight) filter (where not supported and in_manifest), 0) as mo,
  coalesce(sum(weight) filter (where not supported and seen), 0) as c, coalesce(sum(weight) filter (where not supported and not in_manifest and critical), 0) as uc from m group by sid),
 gs as (select sid, n, greatest(0.0, least(100.0, 100.0 * (s + 0.4 * mo) / w - 35.0 * c / w - 20.0 * uc / w))::double as score from g)"""


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, w = F.col("supported"), F.col("weight")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))
    g = claim_support_rows(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("n"), F.sum(w).alias("w"), part(s).alias("s"), part(~s & F.col("in_manifest")).alias("mo"), part(F.col("contradicted")).alias("c"), part(~s & ~F.col("in_manifest") & F.col("critical")).alias("uc"))
    return g.select("sid", "n", S.grounding(F.col("w"), F.col("s"), F.col("mo"), F.col("c"), F.col("uc"), F.col("n")).alias("score"))


@query(GROUND + " select sid, n, round(score + 1e-9, 4) as score from gs")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounding score of each order's claims."""
    return grounded(spark, sf_dir).select("sid", "n", F.round(F.col("score") + 1e-9, 4).alias("score"))


@query(GROUND + """, x as (select sid, score, 40.0 + sid % 60 as cover, 50.0 + sid % 50 as ex, 45.0 + sid % 55 as aq, 100.0 - sid % 30 as ef from gs),
 y as (select *, round(exp(0.3 * ln(greatest(1.0, score) / 100) + 0.25 * ln(cover / 100) + 0.2 * ln(ex / 100) + 0.15 * ln(aq / 100) + 0.1 * ln(ef / 100)) * 100, 2) as comp from x),
 z as (select *, case when comp >= 80 and score >= 60 and cover >= 55 and aq >= 55 and sid % 10 > 0 then 'sft' when comp >= 40 and sid % 10 > 0 then 'rl' else 'discard' end as split from y)
 select split, count(*) as n, round(avg(comp), 2) as mean_composite from z group by split""")
def split_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by the geometric composite, the gate and the floors; all parts but grounding made from the key."""
    x = grounded(spark, sf_dir).withColumns({"cover": 40.0 + F.col("sid") % 60, "ex": 50.0 + F.col("sid") % 50, "aq": 45.0 + F.col("sid") % 55, "ef": 100.0 - F.col("sid") % 30})
    comp = S.composite({"grounding": F.col("score"), "coverage": F.col("cover"), "execution": F.col("ex"), "answer_quality": F.col("aq"), "efficiency": F.col("ef")})
    x = x.withColumn("comp", comp)
    x = x.withColumn("split", S.split_v2(F.col("sid") % 10 > 0, F.col("comp"), F.col("score"), F.col("cover"), F.col("aq")))
    return x.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("comp"), 2).alias("mean_composite"))


@query("""with h as (select p_brand, p_type, count(*) as n from part group by all), r as (select *, n * 1.0 / sum(n) over (partition by p_brand) as share, row_number() over (partition by p_brand order by n desc, p_type) as rk from h)
 select p_brand, p_type, n, round(share, 4) as share, rk::int as rk, round(1.0 + least(1.5, 3.0 * round(share, 4)), 2)::double as weight from r where rk <= 3""")
def manifest_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent extensions of each dataset, with target weights."""
    return R.histogram(table(spark, sf_dir, "part"), ["p_brand"], "p_type", 3).withColumn("weight", S.target_weight(F.col("share")))


@query("select p_brand, split_part(p_name, ' ', 1) as subtree, count(*) as n, round(sum(p_retailprice), 2) as bytes from part group by all")
def manifest_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each subtree."""
    p = table(spark, sf_dir, "part").withColumn("subtree", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return p.groupBy("p_brand", "subtree").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("bytes"))


@query("select p_brand, p_type, p_partkey from (select *, row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) as rk from part) where rk = 1")
def manifest_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest file of each extension."""
    largest = F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(largest.alias("p_partkey"))


@query("""select p_brand, count(*) as files, least(24, greatest(4, 3 + least(6, ceil(log2(count(*) + 1))) + least(4, count(distinct p_type)) + least(4, count(distinct split_part(p_name, ' ', 1))) + least(4, count(*) filter (where p_size > 45))))::bigint as budget from part group by p_brand""")
def tool_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call budget of each dataset."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("files"), F.count_distinct("p_type").alias("e"), F.count_distinct(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("s"), F.count_if(F.col("p_size") > 45).alias("t"))
    return g.select("p_brand", "files", S.tool_budget(F.col("files"), F.col("e"), F.col("s"), F.col("t"), F.lit(False)).alias("budget"))


@query("""with t as (select p_brand, p_type, 1.0 + least(1.5, 3.0 * count(*) / sum(count(*)) over (partition by p_brand)) as w from part group by 1, 2),
 h as (select distinct p.p_brand, p.p_type from lineitem l join part p on p.p_partkey = l.l_partkey where l.l_quantity > 49)
 select t.p_brand, round(7e-9 + 100.0 * (0.7 * sum(case when h.p_type is not null then w else 0 end) / sum(w) + 0.3 * sum(case when h.p_type is not null and t.p_type > 'M' then w else 0 end) / sum(w)), 2) as coverage from t left join h on h.p_brand = t.p_brand and h.p_type = t.p_type group by t.p_brand""")
def coverage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted recall of coverage targets by what order lines touched."""
    p = table(spark, sf_dir, "part")
    t = R.histogram(p, ["p_brand"], "p_type").withColumn("w", 1.0 + F.least(F.lit(1.5), 3.0 * F.col("n") / F.sum("n").over(W.partitionBy("p_brand"))))
    hit = table(spark, sf_dir, "lineitem").where("l_quantity > 49").join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_type").distinct().withColumn("hit", F.lit(True))
    x = t.join(hit, ["p_brand", "p_type"], "left")
    part = lambda c: F.sum(F.when(c, F.col("w")).otherwise(F.lit(0.0))) / F.sum("w")
    return x.groupBy("p_brand").agg(S.coverage(part(F.col("hit")) + 1e-10, part(F.col("hit") & (F.col("p_type") > "M"))).alias("coverage"))


@query("""select d.doc_id, case when l.quality is null then null else (l.quality::varchar = (d.n_chars % 2)::varchar) end as tir_correct,
 case when l.quality is null then null when l.quality = d.doc_id % 2 and l.quality = d.n_chars % 2 then 'category_1_dr_correct_tir_correct' when l.quality = d.doc_id % 2 then 'category_2_dr_correct_tir_wrong' when l.quality = d.n_chars % 2 then 'category_3_dr_wrong_tir_correct' else 'category_4_dr_wrong_tir_wrong' end as difficulty
 from documents d left join (select doc_id, min(quality) as quality from labels group by 1) l using (doc_id)""")
def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictions against the reference: three-valued matches and the difficulty class."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))  # noqa: E741
    x = d.select("doc_id", "n_chars").join(l, "doc_id", "left")
    ref = F.col("quality").cast("string")
    tir, dr = T.answers_match((F.col("n_chars") % 2).cast("string"), ref), T.answers_match((F.col("doc_id") % 2).cast("string"), ref)
    x = x.select("doc_id", tir.alias("tir_correct"), dr.alias("dr"))
    return x.select("doc_id", "tir_correct", P.difficulty(F.col("dr"), F.col("tir_correct")).alias("difficulty"))


@query("""select c_custkey, o_orderkey, o_orderpriority from customer left join (select *, row_number() over (partition by o_custkey order by o_orderkey) as rk from orders) o on o.o_custkey = c_custkey and rk = 1""")
def ref_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join in which the first duplicate wins."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("ordinal"), "o_orderpriority")
    return R.lookup(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "ordinal")


@query("select o_orderkey, o_totalprice from orders where o_orderkey % 3 <> 0 and o_orderkey % 2 <> 0 union all select o_orderkey, o_totalprice + 1 from orders where o_orderkey % 2 = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental merge by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return R.upsert(o.where("o_orderkey % 3 <> 0"), new, new, "o_orderkey")


SETS = "s as (select o.o_custkey as src, l.l_orderkey as cand, list_sort(list(distinct l_linenumber)) as x from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by all)"


def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")  # noqa: E741
    x = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("x"))
    return x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_orderkey").alias("cand"), "x", F.col("o_totalprice").alias("score"))


@query(f"with {SETS} select a.src, a.cand as a, b.cand as b, round(len(list_intersect(a.x, b.x)) * 1.0 / len(list_distinct(list_concat(a.x, b.x))), 4) as j from s a join s b on a.src = b.src and a.cand < b.cand where len(list_intersect(a.x, b.x)) * 1.0 / len(list_distinct(list_concat(a.x, b.x))) > 0.7")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a source's candidates that overlap by more than 0.7."""
    x = path_sets(spark, sf_dir).drop("score")
    y = x.select("src", F.col("cand").alias("b"), F.col("x").alias("y"))
    p = x.withColumnRenamed("cand", "a").join(y, "src").where("a < b").withColumn("j", R.jaccard(F.col("x"), F.col("y")))
    return p.where("j > 0.7").select("src", "a", "b", r4(F.col("j")).alias("j"))


@query("""with s as (select o.o_custkey as src, l.l_orderkey as cand, list(distinct l_linenumber) as x, any_value(o_totalprice) as score from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by 1, 2),
 r as (select *, row_number() over (partition by src order by score desc, cand) as n from s), a as (select src, x, n from r where n = 1),
 b as (select r.src, r.x, r.n from r join a using (src) where r.n > 1 and len(list_intersect(r.x, a.x)) * 1.0 / len(list_distinct(list_concat(r.x, a.x))) <= 0.7 qualify row_number() over (partition by r.src order by r.n) = 1),
 c as (select r.src, r.x, r.n from r join a using (src) join b using (src) where r.n > b.n and len(list_intersect(r.x, a.x)) * 1.0 / len(list_distinct(list_concat(r.x, a.x))) <= 0.7 and len(list_intersect(r.x, b.x)) * 1.0 / len(list_distinct(list_concat(r.x, b.x))) <= 0.7 qualify row_number() over (partition by r.src order by r.n) = 1),
 u as (select src, n, 1 as rk from a union all select src, n, 2 from b union all select src, n, 3 from c) select src, cand, rk from u join r using (src, n)""")
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three diverse candidates of each source."""
    return R.greedy_diverse(path_sets(spark, sf_dir), "src", "score", "cand", "x")


TREE = "nodes as (select event_id as node, case when event_id > 1 then event_id // 2 end as parent, value from events where event_id >= 1)"


def heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a binary heap: 1 is the root, and 0 has no place in one."""
    e = table(spark, sf_dir, "events").where("event_id >= 1")
    return e.select(F.col("event_id").alias("node"), F.when(F.col("event_id") > 1, F.expr("event_id div 2")).alias("parent"), "value")


@query("with n as (select event_id as node, event_id // 2 as parent, event_type from events where event_id > 1) select node, event_type as action from n where event_type <> 'error' and node % 7 <> 0 and node not in (select parent from n)")
def pending_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the tree of all events that have no answer yet."""
    e = table(spark, sf_dir, "events").where("event_id >= 1")
    nodes = e.select(F.col("event_id").alias("node"), F.expr("case when event_id > 1 then event_id div 2 end").alias("parent"), F.col("event_type").alias("action"), F.expr("event_id % 7 = 0").alias("answered"))
    return graph.pending_leaves(nodes, "error").select("node", "action")


@query(f"with recursive {TREE}, up as (select node as leaf, node, node::varchar as path, 1 as n from nodes where node not in (select parent from nodes where parent is not null) union all select leaf, p.parent, p.parent::varchar || '>' || path, n + 1 from up join nodes p on p.node = up.node where p.parent is not null) select leaf, n::bigint as length, path from up where node = 1")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root-to-leaf paths of a tree of events."""
    return graph.root_paths(heap(spark, sf_dir).select("node", "parent"))


@query(f"with recursive {TREE}, up as (select node, node as anc, value from nodes union all select up.node, p.parent, up.value from up join nodes p on p.node = up.anc where p.parent is not null) select anc as node, count(*) as visits, sum(round(value * 10000)::bigint)::bigint as total from up group by anc")
def backprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and the sum of rewards (in ten-thousandths) of every node from those below."""
    n = heap(spark, sf_dir)
    x = graph.backpropagate(n.select("node", "parent"), n.select("node", F.round(F.col("value") * 10_000).cast("bigint").alias("reward")))
    return x.select("node", "visits", "total")


@query("select distinct c_custkey as node from customer where c_custkey not in (select o_custkey from orders)")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that no edge enters."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.roots(e, c)


@query("with m as (select o_custkey as node, min_by(o_orderstatus, o_orderkey) as parent, min(o_orderkey) as depth from orders group by 1) select node, parent, depth from m")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes merged over several trees."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderstatus").alias("parent"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("depth"))
    return graph.merge_nodes(o)


@query("""with p as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), m as (select *, list_max(e) as top from p), w as (select vec_id, list_transform(e, lambda x: exp((x - top) / 0.3)) as w from m),
 s as (select *, list_sum(w) as t from w), h as (select vec_id, greatest(0.0, least(1.0, -list_sum(list_transform(w, lambda x: (x / t) * ln(x / t + 1e-12))) / ln(64.0))) as h from s)
 select vec_id, round(h, 4) as entropy, greatest(1, least(6, round_even(1 + 5 * round(h, 4), 0)))::bigint as k from h""")
def prior_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of priors and the number of branches it calls for."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    x = x.select("vec_id", r4(S.prior_entropy(F.col("p"))).alias("entropy"), F.size("p").alias("n"))
    return x.select("vec_id", "entropy", S.branches(F.col("entropy"), F.col("n"), 6).alias("k"))


@query("""with l as (select vec_id, list_transform(embedding, lambda x: -abs(x::double) * 10) as l from embeddings),
 h as (select vec_id, case when vec_id % 3 = 0 then list_sum(list_transform(l[1:20], lambda x: -exp(x) * x)) / (20 / exp(1)) else list_sum(list_transform(l, lambda x: -exp(x) * x)) / (16 * ln(4)) end as h from l)
 select vec_id, round(least(1, h), 4) as token, round((0.25 + least(1, h)) / 2, 4) as step from h""")
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of tokens with four alternatives or none, and of the step with a prior's entropy of 0.25."""
    kind = "array<struct<logprob: double, top_logprobs: array<struct<logprob: double>>>>"
    x = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, x -> -abs(cast(x as double)) * 10) as l")
    alone = F.expr(f"cast(transform(l, x -> struct(x, cast(null as array<struct<logprob: double>>))) as {kind})")
    fours = F.expr(f"cast(transform(sequence(0, 15), i -> struct(cast(null as double), transform(slice(l, i * 4 + 1, 4), x -> struct(x)))) as {kind})")
    h = S.token_entropy(F.when(F.col("vec_id") % 3 == 0, alone).otherwise(fours))
    return x.select("vec_id", r4(h).alias("token"), r4(S.step_entropy(F.lit(0.25), h)).alias("step"))


@query("""with n as (select *, p_partkey % 4 as v, p_retailprice / 2000 as q, p_size / 50.0 as r from part), b as (select p_brand, avg(q - r) filter (where v > 0) as bias, sum(v) as pv from n group by 1)
 select p_partkey, round(case when v = 0 then greatest(r + coalesce(bias, 0) - 0.1, 0) + r * sqrt(ln(greatest(pv, 1) + 1)) + 0.1 else q + r * sqrt(ln(greatest(pv, 1) + 1)) / sqrt(1 + v) + 0.1 end, 4) as uct from n join b using (p_brand)""")
def uct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection value of siblings, with the bias of those visited."""
    c = F.col
    n = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (c("p_partkey") % 4).alias("v"), (c("p_retailprice") / 2000).alias("q"), (c("p_size") / 50.0).alias("r"))
    n = R.sibling_bias(n, "p_brand", "v", "q", "r")
    return n.select("p_partkey", r4(S.uct(c("v"), c("family_visits"), c("q"), c("r"), F.lit(2), c("bias"))).alias("uct"))


@query("""with r as (select *, row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) as rn from part), k as (select *, row_number() over (partition by p_brand order by (rn > 1), p_retailprice desc, p_partkey) as rk from r)
 select p_brand, p_partkey, p_type from k where rk <= 5""")
def diversity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each group, one of each type first."""
    return R.diverse_top(table(spark, sf_dir, "part"), "p_brand", "p_type", [F.desc("p_retailprice"), "p_partkey"], 5).select("p_brand", "p_partkey", "p_type")


@query("""with o as (select o_custkey, o_orderkey, o_totalprice, min(o_totalprice) over (partition by o_custkey) as lo, max(o_totalprice) over (partition by o_custkey) as hi, o_orderkey % 9 as tools, o_orderkey % 23 as len from orders)
 select o_orderkey, round(40 * least(len / 20.0, 1) + 30 * (o_totalprice - lo) / case when hi > lo then hi - lo else 1 end + 30.0 * tools / 9 + 25 * 0.4, 4) as score from o""")
def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of paths, normalised within their seed."""
    seed, c = W.partitionBy("o_custkey"), F.col
    o = table(spark, sf_dir, "orders").withColumn("lo", F.min("o_totalprice").over(seed)).withColumn("hi", F.max("o_totalprice").over(seed))
    return o.select("o_orderkey", r4(S.path_score(c("o_orderkey") % 23, c("o_totalprice"), c("lo"), c("hi"), c("o_orderkey") % 9, F.lit(9), F.lit(0.4))).alias("score"))


QA = """qa as (select conv_id, turn, role, text as q, lead(text) over (partition by conv_id order by turn) as a, lead(role) over (partition by conv_id order by turn) as next_role from conversations)"""


@query(f"""with {QA}, n as (select conv_id, turn, q, a, lower(trim(regexp_replace(q, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as nq, lower(trim(regexp_replace(a, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as na from qa where role = 'user' and next_role = 'assistant')
 select conv_id, turn, case when nq = '' or na = '' then 'empty' when contains(nq, na) then 'answer_leak' when length(q) > 500 or len(string_split(nq, ' ')) > 85 then 'too_verbose' else 'ok' end as verdict from n""")
def qa_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a question and answer breaks."""
    order = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("a", F.lead("text").over(order)).withColumn("next_role", F.lead("role").over(order))
    t = t.where("role = 'user' and next_role = 'assistant'")
    t = t.withColumn("nq", F.lower(T.squeeze(F.col("text")))).withColumn("na", F.lower(T.squeeze(F.col("a"))))
    long = (F.length("text") > 500) | (F.size(F.split("nq", " ")) > 85)
    verdict = F.when((F.col("nq") == "") | (F.col("na") == ""), "empty").when(F.contains("nq", "na"), "answer_leak").when(long, "too_verbose").otherwise("ok")
    return t.select("conv_id", "turn", verdict.alias("verdict"))


@query("""select 'conv_' || conv_id::varchar as sample_id, string_agg((case role when 'assistant' then 'gpt' when 'user' then 'human' else 'system' end) || ':' || md5(text), '|' order by turn, text) as conversations from conversations group by conv_id""")
def sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in chat form, texts by digest."""
    t = table(spark, sf_dir, "conversations")
    who = F.when(F.col("role") == "assistant", "gpt").when(F.col("role") == "user", "human").otherwise("system")
    x = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", who.alias("who")))).alias("s"))
    return x.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("sample_id"), F.array_join(F.transform("s", lambda m: F.concat(m["who"], F.lit(":"), F.md5(m["text"]))), "|").alias("conversations"))


@query("select md5(text) as code_md5, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def dedup_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each digest."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("code_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("select doc_id, case when length(text) > 1200 then md5(substr(text, 1, 590) || '...<truncated>...' || right(text, 590)) else md5(text) end as clipped from documents")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts clipped to 1200 characters, by digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clip(F.col("text"), 1200)).alias("clipped"))


@query("""select doc_id, case when length(text) > 6000 then md5(substr(text, 1, 4000) || chr(10) || '...[truncated original_length=' || length(text)::varchar || ' dropped=' || (length(text) - 5500)::varchar || ']...' || chr(10) || right(text, 1500)) else md5(text) end as shown from documents""")
def truncate_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations with head, notice and tail, by digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate_observation(F.col("text"))).alias("shown"))


@query("select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '={6,}', '===', 'g'), '-{6,}', '---', 'g'), '_{6,}', '___', 'g')) as shown from documents")
def separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorative runs shortened, by digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.shorten_separators(F.col("text"))).alias("shown"))


@query("select doc_id, printf('src_%04d_', doc_id + 1) || substr(md5(text), 1, 8) as source_id from documents")
def source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of ordinal and digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.format_string("src_%04d_", F.col("doc_id") + 1), F.substring(F.md5("text"), 1, 8)).alias("source_id"))


@query("select page_id, substr(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 80) || '__' || substr(sha1(url), 1, 10) || '.json' as name from pages")
def manifest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of manifests."""
    return table(spark, sf_dir, "pages").select("page_id", sinks.manifest_name(F.col("url")).alias("name"))


@query("select event_type as reason, count(*) as n from events group by 1")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by value, null left out."""
    return P.counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("reason")), "reason")


@query("select event_id, (props::json ->> 'k')::bigint as k, 'step ' || (props::json ->> 'k') as thought from events")
def react_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thought and action of text in reasoning-and-acting form, made of event payloads."""
    k = F.get_json_object("props", "$.k")
    said = F.concat(F.lit("Thought: step "), k, F.lit("\nAction: "), F.col("props"))
    x = table(spark, sf_dir, "events").select("event_id", said.alias("s"))
    thought = F.regexp_extract("s", r"(?s)Thought:\s*(.*?)(?=\nAction:|\z)", 1)
    action = F.regexp_extract("s", r"(?s)Action:\s*(\{.*\})", 1)
    return x.select("event_id", F.get_json_object(action, "$.k").cast("bigint").alias("k"), thought.alias("thought"))


def queries() -> dict[str, Query]:
    for name in ("records", "evidence"):
        importlib.import_module(f"strandline.plans.{name}")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    for name in ("records", "evidence"):
        importlib.import_module(f"strandline.plans.{name}")
    return dict(_ORACLE)
