"""Queries on records, answers, reports and trees; ``catalog`` has the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import parsers
from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import graph
from strandline.operators import projections as P
from strandline.plans.catalog import heap, query, r4, table

c = F.col


@query("select doc_id, case when doc_id % 3 = 0 then 's' || doc_id::varchar when doc_id % 3 = 1 and regexp_matches(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]') then md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) else 'sample_' || doc_id::varchar end as sample_id from documents")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of records: given, from the query, or from the ordinal."""
    d = table(spark, sf_dir, "documents")
    given = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("s"), c("doc_id").cast("string"))).otherwise("")
    x = d.select("doc_id", given.alias("task_id"), F.when(c("doc_id") % 3 == 1, c("text")).alias("question"))
    return x.select("doc_id", P.sample_id(x, "doc_id").alias("sample_id"))


@query("select conv_id, turn, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) as prediction from conversations where text is not null and trim(text) <> ''")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: given on even turns, else the last answer of the trajectory; by digest."""
    t = table(spark, sf_dir, "conversations").where("text is not null and trim(text) <> ''")
    x = t.select("conv_id", "turn", F.when(c("turn") % 2 == 0, c("text")).otherwise(" ").alias("pred"), F.concat(F.lit("<think>a</think><answer>x</answer><answer>"), c("text"), F.lit("</answer>")).alias("output"))
    return x.select("conv_id", "turn", F.md5(F.btrim(P.prediction(x), F.lit(" \t\n\r"))).alias("prediction"))


@query("select o_orderkey, o_orderkey % 5 < 4 as placeholder from orders")
def placeholder_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are templates not filled in."""
    texts = F.array(*[F.lit(s) for s in (" ", r"\boxed{Answer here}", r"so \boxed{ }", "Answer here", "42 rows")])
    return table(spark, sf_dir, "orders").select("o_orderkey", P.is_placeholder(F.get(texts, (c("o_orderkey") % 5).cast("int"))).alias("placeholder"))


@query("select event_id, 'why ' || event_type as think, case when event_id % 3 = 0 then props when event_id % 3 = 1 then event_type else '' end as answer from events")
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thought and answer of final replies: tagged, after the thought, or missing."""
    body = F.when(c("event_id") % 3 == 0, F.concat(F.lit("<Answer> "), c("props"), F.lit(" </answer> x"))).when(c("event_id") % 3 == 1, F.concat(F.lit("\n<result>"), c("event_type"))).otherwise("")
    said = F.concat(F.lit("<THINK> why "), c("event_type"), F.lit(" </think>"), body)
    return table(spark, sf_dir, "events").select("event_id", P.final_think_answer(said).alias("r")).select("event_id", "r.think", "r.answer")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'open_file,walk' when o_orderkey % 3 = 1 then 'read_table,sample_rows' else 'execute_code' end as operations,
 case when o_orderkey % 3 < 2 then 't' || o_custkey::varchar || '.csv' else 'x.py' end as primary_path from orders""")
def python_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations and primary path of programs made of orders; one kind doesn't parse."""
    name = F.concat(F.lit("t"), c("o_custkey").cast("string"), F.lit(".csv"))
    walk = F.concat(F.lit("for r in walk('data'):\n    open('"), name, F.lit("')"))
    read = F.concat(F.lit("d = read_csv('"), name, F.lit("')\nhead(d)"))
    x = table(spark, sf_dir, "orders").select("o_orderkey", parsers.python_accesses(F.when(c("o_orderkey") % 3 == 0, walk).when(c("o_orderkey") % 3 == 1, read).otherwise("run x.py (")).alias("a"))
    return x.select("o_orderkey", F.array_join(F.array_sort(F.col("a.operations")), ",").alias("operations"), "a.primary_path")


@query("""with x as (select event_id, (props::json ->> 'k')::bigint as k from events)
 select event_id, 'count' as kind, 'row_count' as label, k::varchar as value from x union all select event_id, 'column', null, 'c' || k::varchar from x union all select event_id, 'column', null, 'id' from x""")
def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and columns of nested data, as JSON or as a Python literal in a fence."""
    k = F.get_json_object("props", "$.k")
    data = F.concat(F.lit('{"info": [{"rows": '), k, F.lit(', "column_names": ["id", "c'), k, F.lit('", 7]}]}'))
    python = F.concat(F.lit("see\n```json\n"), F.translate(data, '"', "'"), F.lit("\n```"))
    x = table(spark, sf_dir, "events").select("event_id", F.explode(parsers.structured_facts(F.when(c("event_id") % 2 == 0, data).otherwise(python))).alias("f"))
    return x.select("event_id", "f.kind", "f.label", "f.value")


@query("select event_id, '{\"a\": \"}\", \"p\": ' || props || '}' as object, '[1, [2], \"]\"]' as array from events")
def first_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First balanced object and array in talk, brackets in strings left alone."""
    said = F.concat(F.lit('so: {"a": "}", "p": '), c("props"), F.lit('} then [1, [2], "]"] and {'))
    return table(spark, sf_dir, "events").select("event_id", parsers.first_json_object(said).alias("object"), parsers.first_json_array(F.concat(F.lit("x "), F.regexp_extract(said, r"then (.*)", 1))).alias("array"))


@query("select p_partkey, 'brand,' || lower(p_brand) || ',size' as columns from part")
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names stated in lists, JSON or unquoted in part."""
    listed = F.concat(F.lit('Columns: ["size", "'), F.lower("p_brand"), F.lit('"]\nschema = [\'brand\', oops]'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(parsers.column_tokens(listed)), ",").alias("columns")).withColumn("columns", F.array_join(F.array_sort(F.split("columns", ",")), ","))


QUALITY = """with t as (select doc_id, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as low, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S'))) as paras from documents where text is not null),
 h as (select *, regexp_matches(low, 'file|directory|folder|extension|subdir|subdirectory')::int + regexp_matches(low, 'schema|column|field|row|record|dtype')::int + regexp_matches(low, 'summary|metadata|dataset|structure')::int
  + regexp_matches(low, 'uncertain|unable|not inspected|not available|could not|missing')::int as hits from t),
 p as (select doc_id, least(1.0, 0.15 + 0.4 * (doc_id % 2) + 0.2 * least(1.0, paras / 3.0) + 0.2 * least(1.0, hits / 3.0) + 0.05 * (doc_id % 3 = 0)::int) as st, least(1.0, (doc_id % 4 + doc_id % 3 + 1.2 * (doc_id % 5) + 0.5 * (doc_id % 2)) / 8.0) as sp,
  case when doc_id % 7 = 0 then 0.35 else greatest(0.0, 1 - 0.9 * (doc_id % 3) / (doc_id % 7) - 0.4 * (doc_id % 2) / (doc_id % 7)) end as co,
  case when doc_id % 100 < 60 then case when regexp_matches(text, '(?i)\\b(uncertain|unsure|unable|not inspected|not available|could not|may contain|likely|appears to)\\b') then 1.0 else 0.3 end when doc_id % 3 = 0 then 0.9 else 0.5 end as ca from h)"""


@query(QUALITY + " select doc_id, round(greatest(0.0, least(100.0, 100.0 * (0.35 * st + 0.25 * sp + 0.25 * co + 0.15 * ca))) + 1e-7, 3) as score from p")
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer quality of whole texts; the figures of claims are made from the id."""
    d, n = table(spark, sf_dir, "documents").where("text is not null"), c("doc_id")
    st = S.structure(n % 2 == 1, S.paragraphs(c("text")), S.section_hits(F.lower(T.squeeze(c("text")))), n % 3 == 0)
    sp, co = S.specificity(n % 4, n % 3, n % 5, n % 2), S.consistency(n % 7, n % 3, n % 2, F.lit(True))
    return d.select("doc_id", F.round(S.answer_quality(st, sp, co, S.calibration(n % 100, c("text").rlike(T.UNCERTAIN), n % 3)) + 1e-7, 3).alias("score"))


@query("""select o_orderkey, concat_ws(',', case when o_orderkey % 2 = 0 then 'manifest_unavailable' end, case when o_orderkey % 12 = 0 then 'no_tool_calls' end, case when o_orderkey % 3 > 0 then 'result_errors' end, case when o_orderkey % 4 > 0 then 'duplicate_tool_calls' end,
 case when o_orderkey % 5 > 0 then 'near_duplicate_tool_calls' end, case when o_orderkey % 12 > 10 then 'tool_frequency_exceeded' end, case when o_orderkey % 6 > 0 then 'unsupported_answer_claims' end, case when o_orderkey % 7 > 0 then 'answer_evidence_conflict' end, case when o_orderkey % 100 < 50 then 'underexplored_dataset' end) as warnings from orders""")
def warning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is doubtful about trajectories whose figures are made from the key."""
    k = c("o_orderkey")
    w = S.warnings(k % 2 == 1, k % 12, k % 3, k % 4, k % 5, F.lit(10), k % 6, k % 7, k % 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(w, ",").alias("warnings"))


@query("""select count(*) as n, count(*) filter (where o_totalprice >= 300000) as n_sft, count(*) filter (where o_totalprice >= 150000 and o_totalprice < 300000) as n_rl, count(*) filter (where o_totalprice < 150000) as n_discard,
 round(avg(o_orderkey % 100), 2) as mean_score, count(*) filter (where o_orderstatus = 'F') as n_gate_pass from orders""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a scoring run."""
    split = F.when(c("o_totalprice") >= 300000, "sft").when(c("o_totalprice") >= 150000, "rl").otherwise("discard")
    x = table(spark, sf_dir, "orders").select(split.alias("split"), (c("o_orderkey") % 100).alias("score"), (c("o_orderstatus") == "F").alias("gate_pass"))
    return P.report(x, ["score"], ["gate_pass"])


@query("select o_orderkey::varchar as sample_id, o_comment as input, round((40 + o_orderkey % 40) / 100.0, 4) as reward, (o_orderkey % 90)::bigint as grounding from orders where o_orderkey % 3 = 0".replace("o_comment", "o_orderpriority"))
def rl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the rows that go to reinforcement learning."""
    k = c("o_orderkey")
    parts = {f"{n}_score": k % (90 + i) for i, n in enumerate(("grounding", "coverage", "execution", "efficiency", "answer_quality"))}
    x = table(spark, sf_dir, "orders").select(k.cast("string").alias("sample_id"), c("o_orderpriority").alias("input"), F.lit("").alias("output"), F.lit("").alias("prediction"), (40 + k % 40).alias("composite_score"), F.when(k % 3 == 0, "rl").otherwise("sft").alias("split"), *[v.alias(n) for n, v in parts.items()])
    return P.rl_record(x).select("sample_id", "input", "reward", c("quality_detail.grounding_score").alias("grounding"))


@query("select user_id, sum(case when event_id % 4 = 0 then event_id % 50 else greatest(1, length(props) // 4) end)::bigint as tokens from events group by user_id")
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens used by user: counted where known, else estimated from characters."""
    exact = F.when(c("event_id") % 4 == 0, c("event_id") % 50)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(S.tokens_used(exact, F.length("props"))).alias("tokens"))


@query("select event_id, round(case when event_id % 3 = 0 then 0.0 else greatest(0.0, least(1.0, value / 50)) end, 4) as score, round(greatest(0.0, least(1.0, 0.5 * greatest(0.0, least(1.0, value / 50)))), 4) as prior from events")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' replies as scores, and priors of strategies with the confidence in them."""
    v = c("value") / 50
    reply = F.concat(F.lit('{"score": '), F.when(c("event_id") % 3 == 0, '"bad"').otherwise(v.cast("string")), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", r4(S.judge_score(reply)).alias("score"), r4(S.strategy_prior(F.lit(0.5), v)).alias("prior"))


@query("select o_custkey as src, count(*) as n, count(*) filter (where l_returnflag = 'R') as critical from (select distinct o_custkey, l_returnflag, l_partkey from lineitem join orders on o_orderkey = l_orderkey) group by 1")
def distinct_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct facts of a source, and those of one kind."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("src"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey").join(o, c("l_orderkey") == c("o_orderkey")).select("src", "l_returnflag", "l_partkey").distinct()
    return x.groupBy("src").agg(F.count("*").alias("n"), F.count_if(c("l_returnflag") == "R").alias("critical"))


@query("""with n as (select conv_id, turn, turn * 2 as node, case when turn % 3 = 0 then -1 else (turn - 2) * 2 end as parent, lag(turn * 2) over w as prev, lead(turn * 2) over w as next, min(turn) over (partition by conv_id) as first from (select distinct conv_id, turn from conversations) window w as (partition by conv_id order by turn))
 select conv_id, turn, node, case when prev is null then null when exists (select 1 from conversations k where k.conv_id = n.conv_id and k.turn * 2 = n.parent) then parent else prev end as parent, next as child from n""")
def chain_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths exported as chains of their own."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    x = t.select("conv_id", "turn", (c("turn") * 2).alias("node"), F.when(c("turn") % 3 == 0, F.lit(-1)).otherwise((c("turn") - 2) * 2).cast("bigint").alias("parent"))
    return graph.chain(x, "conv_id", "turn").select("conv_id", "turn", "node", "parent", F.get("children", F.lit(0)).alias("child"))


@query("with recursive nodes as (select event_id as node, case when event_id > 1 then event_id // 2 end as parent from events where event_id >= 1), down as (select node, 0 as level from nodes where parent is null union all select n.node, level + 1 from down d join nodes n on n.parent = d.node) select level::bigint as level, count(*) as n from down group by 1")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by level of a tree of events."""
    return graph.levels(heap(spark, sf_dir).select("node", "parent")).groupBy(c("level").cast("bigint").alias("level")).agg(F.count("*").alias("n"))


@query("select distinct event_id // 2 as src, event_id as dst from events where event_id > 1 union select event_id, event_id * 3 from events where event_id % 5 = 0")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from parents and children."""
    e, n = table(spark, sf_dir, "events"), c("event_id")
    kids = F.when(n % 5 == 0, F.array(n * 3)).otherwise(F.array().cast("array<bigint>"))
    return graph.edges(e.select(n.alias("node"), F.when(n > 1, F.expr("event_id div 2")).alias("parent"), kids.alias("children")))


@query("""with n as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as pos from events), l as (select * from n where event_id % 3 = 0 and pos > 1)
 select user_id, event_id as node from (select *, row_number() over (partition by user_id order by pos % 8 desc, pos) as rk from l where not exists (select 1 from n k where k.user_id = l.user_id and k.pos > 1 and k.pos // 2 = l.pos)) where rk = 1""")
def bad_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest leaf of each tree whose answer has to be made again."""
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    n = table(spark, sf_dir, "events").select("user_id", "event_id", pos.cast("bigint").alias("pos"))
    x = n.select("user_id", c("pos").alias("node"), F.when(c("pos") > 1, F.expr("pos div 2")).alias("parent"), (c("pos") % 8).alias("depth"), "pos", "event_id")
    best = graph.deepest(x, "user_id", c("event_id") % 3 == 0)
    return best.withColumnRenamed("node", "pos").join(n, ["user_id", "pos"]).select("user_id", c("event_id").alias("node"))


@query("select user_id, event_id from (select *, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from events) where coalesce(before, 0) < 3")
def max_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file up to its third repair."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (c("event_type") == "error").alias("fixed"))
    return graph.until(e, "user_id", "event_id", "fixed", 3).select("user_id", "event_id")


@query("""select conv_id, turn, md5(case when row_number() over (partition by conv_id order by turn desc, text desc) <= 2 then text else substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) end) as shown from conversations""")
def context_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps as shown in a prompt: the last two whole, older ones short; by digest."""
    t = table(spark, sf_dir, "conversations").withColumn("o", F.struct("turn", "text"))
    return graph.context(t, "conv_id", "o", "text").select("conv_id", "turn", F.md5("shown").alias("shown"))


@query("select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rk from part where p_size > 10) where rk = 1")
def best_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child that a descent goes to."""
    return graph.best_child(table(spark, sf_dir, "part").withColumn("expandable", c("p_size") > 10), "p_brand", "p_retailprice", "p_partkey")
