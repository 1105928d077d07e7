"""Queries on parsers, evidence, manifests, trees and synthesis; ``catalog`` and ``records`` have the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import parsers
from strandline.functions import synthesis as Y
from strandline.functions import text as T
from strandline.operators import blocks, evidence, graph, manifests, trees
from strandline.operators import projections as P
from strandline.plans.catalog import query, table

c = F.col

TAGGED = (
    "<think>a<python>b</python></think><answer>x</answer>",
    "<THINK>a</python><answer>x</answer>",
    "</think><Thought>a</thought><final>x</final>",
    "<think>a<answer>x</answer>",
    "<think>a</think><answer>p<think>q</answer>",
    "hi <python>c</python><result>r</result><answer>x</answer> bye",
    "<think>a</think><python>c</python><answer>x</answer><think>b</think>",
)


def pick(texts: tuple[str, ...], n: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(t) for t in texts]), F.pmod(n, F.lit(len(texts))).cast("int"))


@query("""select o_orderkey, case o_orderkey % 7 when 0 then 'think,answer' when 1 then 'think,answer' when 2 then 'think,answer' when 3 then '' when 4 then 'think,answer' when 5 then 'python,result,answer' else 'think,python,answer,think' end as tags,
 case o_orderkey % 7 when 1 then 'mismatch:think:python' when 2 then 'stray_closer:think' when 3 then 'unclosed:think trailing_text no_blocks answer_count no_think last_not_answer' when 5 then 'outside_text trailing_text result_before_think tool_before_think no_think'
  when 6 then 'think_after_answer answer_not_last last_not_answer tool_result_mismatch' else '' end as errors from orders""")
def strict_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and broken rules of nested, mismatched, stray and open tags by the strict grammar."""
    x = blocks.parsed_strict(table(spark, sf_dir, "orders").select("o_orderkey", pick(TAGGED, c("o_orderkey")).alias("s")), "s")
    return x.select("o_orderkey", F.array_join(F.transform("blocks", lambda b: b["tag"]), ",").alias("tags"), F.array_join("errors", " ").alias("errors"))


@query("""select o_orderkey, case o_orderkey % 7 when 3 then 'think' when 5 then 'python,result,answer' when 6 then 'think,python,answer,think' when 1 then 'think' else 'think,answer' end as tags,
 case o_orderkey % 7 when 1 then 'unclosed answer_count last_not_answer' when 2 then 'stray_closer' when 3 then 'unclosed answer_count last_not_answer' when 5 then 'outside_text result_before_think tool_before_think no_think'
  when 6 then 'think_after_answer answer_not_last last_not_answer tool_result_mismatch' else '' end as errors from orders""")
def tolerant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts by the tolerant grammar."""
    x = blocks.parsed_tolerant(table(spark, sf_dir, "orders").select("o_orderkey", pick(TAGGED, c("o_orderkey")).alias("s")), "s")
    return x.select("o_orderkey", F.array_join(F.transform("blocks", lambda b: b["tag"]), ",").alias("tags"), F.array_join("errors", " ").alias("errors"))


@query("select event_id, '<think>' || event_type || '</x-y_1> < Z><result>' || props || '</answer>' as s from events")
def tag_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in lower case and under their canonical names, known or not."""
    said = F.concat(F.lit("<ReAsoning>"), c("event_type"), F.lit("</X-Y_1> < Z><OBS>"), c("props"), F.lit("</FinalAnswer>"))
    return table(spark, sf_dir, "events").select("event_id", T.rewrite_tags(said).alias("s"))


@query("""select event_id, case event_id % 3 when 0 then 'google:<a1 ss> ' || event_type when 1 then 'bash:ls <A1>' || chr(10) || 'cd ' || event_type else 'python:f("A1", ' || event_id::varchar || ')' end as strict,
 case event_id % 3 when 0 then 'google:<a1 ss> ' || event_type when 1 then 'bash:ls <a1> cd ' || event_type else 'python:f(__STR__, __NUM__)' end as loose from events""")
def tool_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of calls with full-width forms, character references, sharp s, blank lines, strings and numbers."""
    n = c("event_id")
    body = F.when(n % 3 == 0, F.concat(F.lit(" &lt;Ａ１\n  ß&gt;\t"), c("event_type"))).when(n % 3 == 1, F.concat(F.lit("ls \t &lt;Ａ１&gt; \n\n  cd "), c("event_type"))).otherwise(F.concat(F.lit('f("Ａ１", '), n.cast("string"), F.lit(")")))
    x = table(spark, sf_dir, "events").select("event_id", parsers.signatures(F.when(n % 3 == 0, "google").when(n % 3 == 1, "bash").otherwise("python"), body).alias("s"))
    return x.select("event_id", "s.strict", "s.loose")


FACTS = """with raw as (select l_orderkey as sid, l_partkey as p, l_suppkey as s, l_linenumber as n from lineitem),
 cl as (select distinct sid, case n % 4 when 0 then 'path' when 1 then 'extension' when 2 then 'count' else 'column' end as kind, case when n % 4 = 2 then case when p % 2 = 0 then 'row_count' else 'file_count' end end as label,
  case n % 4 when 0 then 'c/p' || (p % 9)::varchar || '.csv' when 1 then '.x' || (p % 5)::varchar when 2 then (s % 4)::varchar else 'col' || (p % 3)::varchar end as value from raw where n >= 2),
 ev as (select distinct sid, case (n + 1) % 4 when 0 then 'path' when 1 then 'extension' when 2 then 'count' else 'column' end as kind, case when (n + 1) % 4 = 2 then case when p % 2 = 0 then 'row_count' else 'file_count' end end as label,
  case (n + 1) % 4 when 0 then case when s % 2 = 0 then 'c' else 'e/f' end || '/p' || (p % 9)::varchar || '.csv' when 1 then '.x' || (p % 5)::varchar when 2 then (s % 4)::varchar else 'col' || (p % 3)::varchar end as value from raw where n <= 5),
 man as (select o_orderkey as sid, 'count' as kind, 'file_count' as label, (o_orderkey % 4)::varchar as value, o_orderkey % 2 = 0 as exact from orders union all select o_orderkey, 'extension', null, '.x' || (o_orderkey % 5)::varchar, true from orders union all select o_orderkey, 'path', null, 'm/p' || (o_orderkey % 9)::varchar || '.csv', true from orders),
 fit as (select c.*, exists (select 1 from ev e where e.sid = c.sid and e.kind = c.kind and (e.value = c.value or (c.kind = 'path' and split_part(reverse(e.value), '/', 1) = split_part(reverse(c.value), '/', 1))) and (c.kind <> 'count' or e.label = c.label)) as e,
  exists (select 1 from man m where m.sid = c.sid and m.kind = c.kind and (m.value = c.value or (c.kind = 'path' and split_part(reverse(m.value), '/', 1) = split_part(reverse(c.value), '/', 1))) and (c.kind <> 'count' or m.label = c.label)) as m,
  exists (select 1 from ev e where e.sid = c.sid and e.kind = 'count' and e.label = c.label) as said, exists (select 1 from man m where m.sid = c.sid and m.kind = 'count' and m.label = c.label and m.exact) as listed from cl c)"""


def fact_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("sid"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_linenumber").alias("n"))
    text = lambda x: x.cast("string")

    def facts(rows: DataFrame, turn: F.Column, folder: F.Column) -> DataFrame:
        kind = F.when(turn == 0, "path").when(turn == 1, "extension").when(turn == 2, "count").otherwise("column")
        label = F.when(turn == 2, F.when(c("p") % 2 == 0, "row_count").otherwise("file_count"))
        value = F.when(turn == 0, F.concat(folder, F.lit("/p"), text(c("p") % 9), F.lit(".csv"))).when(turn == 1, F.concat(F.lit(".x"), text(c("p") % 5))).when(turn == 2, text(c("s") % 4)).otherwise(F.concat(F.lit("col"), text(c("p") % 3)))
        return rows.select("sid", kind.alias("kind"), label.alias("label"), value.alias("value")).distinct()

    claims = facts(raw.where("n >= 2"), c("n") % 4, F.lit("c"))
    found = facts(raw.where("n <= 5"), (c("n") + 1) % 4, F.when(c("s") % 2 == 0, "c").otherwise("e/f"))
    o = c("o_orderkey")
    said = F.array(
        F.struct(F.lit("count").alias("kind"), F.lit("file_count").alias("label"), text(o % 4).alias("value"), (o % 2 == 0).alias("exact")),
        F.struct(F.lit("extension").alias("kind"), F.lit(None).cast("string").alias("label"), F.concat(F.lit(".x"), text(o % 5)).alias("value"), F.lit(True).alias("exact")),
        F.struct(F.lit("path").alias("kind"), F.lit(None).cast("string").alias("label"), F.concat(F.lit("m/p"), text(o % 9), F.lit(".csv")).alias("value"), F.lit(True).alias("exact")),
    )
    return claims, found, table(spark, sf_dir, "orders").select(o.alias("sid"), F.inline(said))


@query(FACTS + " select kind, count(*) as n, count(*) filter (where e) as supported, count(*) filter (where m) as in_manifest, count(*) filter (where kind = 'count' and not e and not m and (said or listed)) as contradicted from fit group by kind")
def claim_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every kind against evidence and manifests: paths also by their last name, counts by label and value."""
    x = evidence.matched(*fact_tables(spark, sf_dir), "sid")
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("supported_by_evidence").alias("supported"), F.count_if("supported_by_manifest").alias("in_manifest"), F.count_if("contradicted").alias("contradicted"))


@query(FACTS + " select sid, count(distinct case when kind = 'path' then value end) as paths, count(distinct case when kind = 'extension' then value end) as extensions, count(distinct case when kind = 'count' then label || value end) as counts, count(distinct case when kind = 'column' then value end) as columns from cl group by sid")
def claim_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different claims of each kind in an answer."""
    return evidence.distinct_counts(fact_tables(spark, sf_dir)[0], "sid")


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("p_partkey")
    name = F.concat(F.when(n % 4 > 0, F.concat(F.lower("p_brand"), F.lit("/"))).otherwise(""), F.when(n % 4 > 1, F.concat((n % 3).cast("string"), F.lit("/"))).otherwise(""), F.lit("f"), n.cast("string"), pick((".csv", ".TSV", "", ".json.gz"), n))
    return table(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("data"), (c("p_size") % 7).cast("string")).alias("input_path"), name.alias("rel_path"), c("p_size").cast("bigint").alias("size"))


FILES = """with f as (select 'data/' || (p_size % 7)::varchar as input_path, case when p_partkey % 4 > 0 then lower(p_brand) || '/' else '' end || case when p_partkey % 4 > 1 then (p_partkey % 3)::varchar || '/' else '' end || 'f' || p_partkey::varchar || case p_partkey % 4 when 0 then '.csv' when 1 then '.TSV' when 2 then '' else '.json.gz' end as rel_path, p_size::bigint as size,
  case p_partkey % 4 when 0 then '.csv' when 1 then '.tsv' when 2 then '<no_ext>' else '.gz' end as ext from part),
 d as (select distinct input_path, array_to_string(string_split(rel_path, '/')[1:k], '/') as dir from f, unnest(range(0, len(string_split(rel_path, '/')))) as t(k)),
 dd as (select input_path, count(*) as num_dirs, max(case when dir = '' then 0 else len(string_split(dir, '/')) end)::bigint as max_depth from d group by 1)"""


@query(FILES + """, e as (select input_path, ext, count(*) as n, row_number() over (partition by input_path order by count(*) desc, ext) as rk from f group by 1, 2),
 s as (select input_path, case when contains(rel_path, '/') then split_part(rel_path, '/', 1) else '<root>' end as top, count(*) as n from f group by 1, 2), st as (select *, row_number() over (partition by input_path order by n desc, top) as rk from s),
 b as (select input_path, string_agg(rel_path, ',' order by ext) as best from (select *, row_number() over (partition by input_path, ext order by size desc, rel_path) as r from f) where r = 1 group by 1),
 t as (select input_path, string_agg(rel_path, ',' order by rk) as tables from (select *, row_number() over (partition by input_path order by size desc, rel_path desc) as rk from f where ext in ('.csv', '.tsv')) where rk <= 8 group by 1)
 select input_path, count(*) as num_files, sum(size)::bigint as total_bytes, any_value(num_dirs) as num_dirs, any_value(max_depth) as max_depth, (select string_agg(ext || ':' || n::varchar, ',' order by rk) from e where e.input_path = f.input_path) as extensions,
  (select string_agg(top || ':' || n::varchar, ',' order by rk) from st where st.input_path = f.input_path and rk <= 8) as subtrees, any_value(best) as best, any_value(tables) as tables from f join dd using (input_path) join b using (input_path) join t using (input_path) group by input_path""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of datasets made of parts: totals, frequent extensions and subtrees, largest files and tables."""
    m = manifests.manifests(file_rows(spark, sf_dir), max_files=1_000_000)
    listed = lambda a, *f: F.array_join(F.transform(a, lambda x: F.concat_ws(":", *[x[k].cast("string") for k in f])), ",")
    return m.select("input_path", "num_files", "total_bytes", "num_dirs", c("max_depth").cast("bigint").alias("max_depth"), listed("major_extensions", "ext", "count").alias("extensions"), listed("dominant_subtrees", "name", "count").alias("subtrees"), listed("representative_files", "rel_path").alias("best"), listed("table_summaries", "rel_path").alias("tables"))


@query(FILES + """, n as (select input_path, count(*) as n from f group by 1), e as (select input_path, 'ext::' || ext as target_id, round(1.0 + least(1.5, 3.0 * round(count(*) * 1.0 / any_value(n), 4)), 2)::double as weight from f join n using (input_path) group by input_path, ext)
 select input_path, target_id, weight from e union all select input_path, 'inventory', 2.0 from n union all select input_path, 'schema::' || rel_path, 1.75 from (select *, row_number() over (partition by input_path order by size desc, rel_path desc) as rk from f where ext in ('.csv', '.tsv')) where rk <= 8""")
def coverage_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that a trace should touch; those of subtrees left to ``manifest_subtree``."""
    x = manifests.coverage_targets(manifests.manifests(file_rows(spark, sf_dir), max_files=1_000_000))
    return x.where("type <> 'subtree'").select("input_path", "target_id", "weight")


CONV_TREE = """n as (select conv_id, turn, md5(string_agg(text, '' order by text)) as h, row_number() over (partition by conv_id order by turn) as pos, count(*) over (partition by conv_id) as size from conversations where text is not null group by conv_id, turn),
 l as (select *, case when pos = 1 then '' when pos % 5 = 0 then '<think>' || h || '</think> <answer>' || h || '</answer>' else '<think>' || h || '</think> <python>run</python><result>===' || h || '</result>' end as shown from n)"""


def conversation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each conversation: its turns as a binary heap, right child first, behind an empty root."""
    from pyspark.sql import Window as W

    t = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id", "turn").agg(F.md5(F.array_join(F.array_sort(F.collect_list("text")), "")).alias("h"))
    t = t.withColumns({"pos": F.row_number().over(W.partitionBy("conv_id").orderBy("turn")), "size": F.count("*").over(W.partitionBy("conv_id"))})
    pos, tag = c("pos"), lambda n, x: F.concat(F.lit(f"<{n}>"), x, F.lit(f"</{n}>"))
    step = F.array(tag("think", c("h")), tag("python", F.lit("run")), tag("result", F.concat(F.lit("========"), c("h"))))
    logs = F.when(pos == 1, F.array(F.lit("<think> Root: start exploration of it</think>"))).when(pos % 5 == 0, F.array(tag("think", c("h")), tag("answer", c("h")))).otherwise(step)
    kids = F.transform(F.filter(F.array(pos * 2 + 1, pos * 2), lambda k: k <= c("size")), lambda k: k.cast("string"))
    node = F.struct(pos.cast("string").alias("node_id"), F.when(pos > 1, F.expr("pos div 2").cast("string")).alias("parent_id"), kids.alias("children_ids"), F.lit(0).alias("depth"), logs.alias("logs"))
    x = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", node.alias("n")))).alias("s"))
    return x.select("conv_id", F.lit("seed").alias("seed_data"), F.transform("s", lambda e: e["n"]).alias("nodes"))


@query(f"""with recursive {CONV_TREE}, up as (select conv_id, pos as leaf, pos, shown as output, case when pos % 5 = 0 and pos > 1 then h else '' end as prediction, case when pos > 1 and pos % 2 = 0 then '1' else '0' end as turns from l where pos * 2 > size
  union all select u.conv_id, leaf, p.pos, p.shown || output, case when prediction = '' and p.pos % 5 = 0 then p.h else prediction end, case when p.pos > 1 and p.pos % 2 = 0 then '1' else '0' end || turns from up u join l p on p.conv_id = u.conv_id and p.pos = u.pos // 2 where u.pos > 1)
 select u.conv_id, row_number() over (partition by u.conv_id order by case when leaf = 1 then '0' when (leaf // 2) * 2 + 1 > size and leaf % 2 = 0 then substr(turns, 1, length(turns) - 1) || '0' else turns end) - 1 as path_index, md5(output) as output, prediction from up u join l r on r.conv_id = u.conv_id and r.pos = 1 where u.pos = 1""")
def tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all root-to-leaf paths of trees, depth first, by digest."""
    x = trees.records(conversation_trees(spark, sf_dir), "conv_id", F.lit("t"), F.lit("p"))
    return x.select("conv_id", c("path_index").cast("bigint").alias("path_index"), F.md5("output").alias("output"), "prediction")


@query("""select event_id, case event_id % 6 when 0 then 'empty' when 1 then 'answer_leak' when 2 then 'too_few_steps' when 3 then 'structure: step 1' when 4 then 'answers_differ' else 'ok' end as verdict from events""")
def qa_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that questions with reasoning steps break; steps are texts or objects."""
    n = c("event_id")
    made = lambda **f: F.struct(*[F.lit(f.get(k)).cast("string").alias(k) if not isinstance(f.get(k), F.Column) else f[k].alias(k) for k in ("text", "think", "python", "result", "answer")])
    good, bad = made(think="t", python="p", result="r"), made(text=" <think>t</think> ")
    last = made(text=F.concat(F.lit("<Think>t</Think><answer>\n"), F.when(n % 6 == 4, "other").otherwise(c("event_type")), F.lit(" </answer>")))
    steps = F.when(n % 6 == 2, F.array(last)).when(n % 6 == 3, F.array(bad, last)).otherwise(F.array(good, made(text="  "), last))
    question = F.when(n % 6 == 1, F.concat(F.lit("Is it  "), F.upper("event_type"))).otherwise("What is it?")
    verdict = Y.qa_verdict(question, F.when(n % 6 == 0, " ").otherwise(c("event_type")), Y.reasoning_steps(steps))
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


@query("select event_id, 'go ' || event_type as thought, 'tool' as tool_name, case when event_id % 4 = 2 then '{}' else '{\"k\": ' || (props::json ->> 'k') || '}' end as parameters from events")
def xml_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions in XML: nested, flat, without a response, and with parameters that don't read."""
    n, p = c("event_id"), F.when(c("event_id") % 4 == 2, "{").otherwise(c("props"))
    call = F.concat(F.lit("<tool_name> tool</tool_name><parameters>"), p, F.lit("</parameters>"))
    said = F.concat(F.lit("<thought>go "), c("event_type"), F.lit(" </thought>"))
    reply = F.when(n % 4 == 0, F.concat(F.lit("so <response a='1'>"), said, F.lit("<action>"), call, F.lit("</action></response>"))).when(n % 4 == 1, F.concat(F.lit("<response>"), F.replace(said, F.lit("thought>"), F.lit("intent>")), call, F.lit("</response>"))).otherwise(F.concat(said, call))
    return table(spark, sf_dir, "events").select("event_id", parsers.xml_action(reply).alias("a")).select("event_id", "a.thought", "a.tool_name", "a.parameters")


@query("select event_id, 'see' as thought, case when event_id % 3 < 2 then 'py' end as tool_name, case when event_id % 3 < 2 then 'x = ' || (props::json ->> 'k') end as code from events")
def react_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions in JSON: in a fence, with a trailing comma, and broken."""
    k, n = F.get_json_object("props", "$.k"), c("event_id")
    plain = F.concat(F.lit('{"tool_name": "py", "code": "x = '), k, F.lit('"'))
    action = F.when(n % 3 == 0, F.concat(F.lit("```json\n"), plain, F.lit("}\n``` and so on"))).when(n % 3 == 1, F.concat(plain, F.lit(", } then"))).otherwise(plain)
    return table(spark, sf_dir, "events").select("event_id", parsers.react_action(F.concat(F.lit("Thought:  see \nAction: "), action)).alias("a")).select("event_id", "a.thought", "a.tool_name", "a.code")


@query("""with recursive n as (select p_partkey as node, p_partkey // 2 as parent, p_retailprice as v, p_size > 5 as ok from part), b as (select parent, min_by(node, struct_pack(a := -v, b := node)) as node from n where ok and parent >= 1 group by parent),
 d as (select 1::bigint as node, '1' as path union all select b.node, path || '>' || b.node::varchar from d join b on b.parent = d.node) select max_by(path, length(path)) as path from d""")
def descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection in a tree of parts: always on to the best child that can be expanded."""
    n = c("p_partkey")
    nodes = table(spark, sf_dir, "part").select(F.lit(0).alias("tree"), n.alias("node"), F.when(n > 1, F.expr("p_partkey div 2")).alias("parent"), c("p_retailprice").alias("value"), (c("p_size") > 5).alias("expandable"))
    x = trees.descents(nodes, nodes.where("node = 1"))
    return x.select(F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"))


@query("select reason, count(*) as n from (select unnest(case when o_orderkey % 3 = 0 then ['a', 'b'] when o_orderkey % 3 = 1 then ['b', 'b', o_orderstatus] else [] end) as reason from orders) group by reason")
def hard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons counted over arrays of them."""
    k = c("o_orderkey")
    r = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("b"), F.lit("b"), c("o_orderstatus"))).otherwise(F.array().cast("array<string>"))
    return P.reason_counts(table(spark, sf_dir, "orders").select(r.alias("r")), "r")


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'own' when o_orderkey % 2 = 0 then 'c' || o_custkey::varchar end as reference from orders""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference answers: a record's own, else those of an index, of which the first row counts; blank ones are none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = o.select("o_orderkey", F.when(c("o_orderkey") % 4 == 0, " own ").otherwise(" ").alias("gold"))
    row = lambda k, text: o.select("o_orderkey", F.lit(k).alias("ordinal"), text.alias("target"))
    index = row(0, F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("c"), c("o_custkey").cast("string"))).otherwise("  ")).unionByName(row(1, F.lit("late")))
    return P.with_reference(own, index, "o_orderkey", "ordinal").select("o_orderkey", "reference")


@query("select event_id, greatest(32, case when event_id % 2 = 0 then least(event_id // 2, greatest(32, 4096 - event_id - 64)) else event_id // 2 end)::bigint as tokens, round(least(0.85, 0.55 + 0.03 * (event_id % 20)), 4) as temperature from events")
def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_tokens after an overflow, with and without a message that tells the limits, and temperatures of rollouts."""
    n = c("event_id")
    said = F.when(n % 2 == 0, F.concat(F.lit("Maximum context length is 4096 tokens; it contains at least "), n.cast("string"), F.lit(" input tokens"))).otherwise("too long")
    return table(spark, sf_dir, "events").select("event_id", Y.reduced_tokens(said, n).cast("bigint").alias("tokens"), F.round(Y.rollout_temperature(n % 20), 4).alias("temperature"))


@query("select conv_id, turn, case when turn % 3 = 0 then 'd__' || conv_id::varchar else 'd' end as sample_id, md5(case when turn % 3 = 0 then 'step' || chr(10) || '<answer>' || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || '</answer>' when turn % 3 = 1 then '<think>Based on the evidence, I can answer directly.</think>' || chr(10) || '<answer>' || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || '</answer>' else 'a <answer>b</answer>' end) as said from conversations where text is not null and regexp_matches(text, '\\S')")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's turn of questions: steps and answer, answer alone, or steps that have one."""
    n = c("turn")
    steps = F.when(n % 3 == 0, F.array(F.lit("step"))).when(n % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a <answer>b</answer>")))
    x = table(spark, sf_dir, "conversations").where(r"text is not null and text rlike '\\S'")
    own = F.when(n % 3 == 0, Y.chat_id(F.lit("d"), F.lit(""), c("conv_id"))).otherwise(Y.chat_id(F.lit("d"), c("conv_id"), by_dataset=True))
    return x.select("conv_id", "turn", own.alias("sample_id"), F.md5(Y.chat_answer(steps, c("text"))).alias("said"))
