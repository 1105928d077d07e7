"""Evidence, coverage, manifests, trees and synthesis on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import parsers
from strandline.functions import scores as S
from strandline.functions import synthesis as Y
from strandline.functions import text as T
from strandline.operators import blocks, evidence, manifests, trees
from strandline.operators import projections as P
from strandline.sources import records, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_trace_steps_and_coverage(spark):
    body = (
        "<think>look</think><python>import os\nos.walk('data')</python><result>/data/a.csv has columns: [\"x\", \"y\"]\nrows: 12</result>"
        "<bash>cat /sub/b.json</bash><result>Traceback: ＥＲＲＯＲ</result><search>/sub/b.json  Now</search><result>  </result><answer>files: 3 in /data/a.csv, column list: columns = ['x']. The folder sub.</answer>"
    )
    parsed = blocks.parsed_tolerant(spark.createDataFrame([("s", body)], "sid string, body string"), "body")
    steps = evidence.trace_steps(parsed, "sid").cache()
    got = {r.step_index: r for r in steps.collect()}
    assert [got[i].operations for i in (1, 2, 3)] == [["walk"], ["execute_code"], ["search"]]
    assert [(got[i].success, got[i].informative_result, got[i].result_error) for i in (1, 2, 3)] == [(True, True, False), (False, False, True), (True, False, False)]
    assert got[2].primary_path == "b.json" and got[3].strict_signature == "search:/sub/b.json now" and got[1].think_before == "look"
    facts = {(f.kind, f.label, f.value, f.rel_path, f.source) for f in got[1].evidence}
    assert {("path", None, "data/a.csv", None, "R1"), ("count", "row_count", "12", "data", "R1"), ("column", None, "x", "data", "R1")} <= facts
    assert evidence.recoveries(steps, "sid").first().asDict() == {"sid": "s", "errors": 1, "recovered": 1}
    answers = parsed.select("sid", T.last_answer(F.col("body")).alias("a"))
    claims = evidence.answer_claims(answers, "sid", "a").cache()
    weights = {(r.kind, r.value): (r.weight, r.critical) for r in claims.collect()}
    assert weights["count", "3"] == (1.4, True) and weights["extension", ".csv"] == (0.7, False) and weights["column", "x"] == (1.1, True)
    rows = [("s", "inventory", "inventory", None, None, 2.0), ("s", "ext::.csv", "extension", ".csv", None, 1.5), ("s", "ext::.pdf", "extension", ".pdf", None, 1.0), ("s", "subtree::sub", "subtree", "sub", None, 1.2), ("s", "schema::q/b.json", "schema", "q/b.json", ["k"], 1.75), ("s", "schema::z.csv", "schema", "z.csv", ["x"], 1.75)]
    targets = spark.createDataFrame(rows, "sid string, target_id string, type string, name string, columns array<string>, weight double")
    hits = evidence.target_hits(targets, steps, claims, answers, "sid", "a")
    assert {r.target_id: (r.trace_hit, r.answer_hit) for r in hits.collect()} == {"inventory": (True, True), "ext::.csv": (True, True), "ext::.pdf": (False, False), "subtree::sub": (True, True), "schema::q/b.json": (True, False), "schema::z.csv": (False, True)}
    c = evidence.coverage(hits, "sid").first()
    trace, answer = (2.0 + 1.5 + 1.2 + 1.75) / 9.2, (2.0 + 1.5 + 1.2 + 1.75) / 9.2
    assert c.trace_weighted_recall == round(trace, 4) and c.coverage_score == pytest.approx(100 * (0.7 * trace + 0.3 * answer), abs=0.01)


def test_manifest_support_and_missing(spark):
    files = spark.createDataFrame([("d", "a.csv", 5), ("d", "s/b.csv", 9), ("d", "s/t/c.TXT", 1), ("d", "x", 0)], "input_path string, rel_path string, size bigint")
    summaries = spark.createDataFrame([("d", "s/b.csv", ["k"], 7, False)], "input_path string, rel_path string, columns array<string>, row_count bigint, truncated boolean")
    paths = spark.createDataFrame([("d",), ("gone",)], "input_path string")
    m = manifests.manifests(files, paths, summaries, table_limit=1).cache()
    got = {r.input_path: r for r in m.collect()}
    d = got["d"]
    assert (d.num_files, d.num_dirs, d.max_depth, d.total_bytes, d.truncated) == (4, 3, 2, 15, False)
    assert [(e.ext, e["count"], e.share) for e in d.major_extensions] == [(".csv", 2, 0.5), (".txt", 1, 0.25), ("<no_ext>", 1, 0.25)]
    assert [(t.rel_path, t.row_count) for t in d.table_summaries] == [("s/b.csv", 7)] and d.expected_tool_budget == 3 + 3 + 3 + 2 + 1
    assert (got["gone"].available, got["gone"].expected_tool_budget) == (False, 4)
    facts = {(r.kind, r.label, r.value, r.exact) for r in manifests.manifest_facts(m).collect()}
    assert {("count", "file_count", "4", True), ("count", "dir_count", "3", True), ("count", "row_count", "7", True), ("column", None, "k", True), ("extension", None, ".txt", True)} <= facts
    assert manifests.manifests(files, max_files=3).first().truncated
    assert {r.target_id for r in manifests.coverage_targets(m).collect()} == {"inventory", "ext::.csv", "ext::.txt", "ext::<no_ext>", "subtree::s", "subtree::x", "schema::s/b.csv"} - {"subtree::x"}
    assert manifests.with_manifest(spark.createDataFrame([("d",), ("no",)], "input_path string"), m).where("available").count() == 1


def test_tree_pieces(spark):
    rows = [("t", '{"tool_name": "py"}', "py", "saw", None), ("t", '{"tool_name": "STOP"}', "stop", "o", None), (" ", None, None, None, " fin "), ("only", None, None, None, None)]
    logs = [r.l for r in (lambda d: d.select(trees.tagged_logs(d).alias("l")))(spark.createDataFrame(rows, "thought string, action string, tool_name string, observation string, final_answer string").coalesce(1)).collect()]
    assert logs == [["<think>\nt\n</think>", '<python>\n{"tool_name": "py"}\n</python>', "<result>\nsaw\n</result>"], ["<think>\nt\n</think>", '<python>\n{"tool_name": "STOP"}\n</python>', "<answer>\nt\n</answer>"], ["<answer>\nfin\n</answer>"], ["<think>\nonly\n</think>"]]
    nodes = spark.createDataFrame([(1, None, 0, 0.9, None, True), (2, 1, 1, 0.2, 0.9, True), (3, 1, 1, 0.8, 0.1, True)], "node int, parent int, depth int, r_pre double, r_post double, expandable boolean")
    assert {(r.node, r.expandable) for r in trees.pruned(nodes, 0.5, 0.3).collect()} == {(1, True), (3, False)}
    assert {r.node for r in trees.selectable_leaves(nodes, 1).collect()} == {2, 3}
    kept = nodes.select("node", "parent", "depth", F.array(F.lit("x")).alias("logs"))
    more = trees.answer_leaves(kept, spark.createDataFrame([(3, "t", "a")], "node int, think string, answer string"), (F.col("node") + 100).cast("int")).where("node > 100").first()
    assert (more.parent, more.depth, more.logs) == (3, 2, ["<think>\nt\n</think>", "<answer>\na\n</answer>"])
    code = spark.createDataFrame([(0, [{"logs": ["x"]}]), (1, [{"logs": ["root_path = '/d/raw'\nroot_path='/e'"]}])], "o int, nodes array<struct<logs: array<string>>>")
    assert trees.dataset_path(code, "o").first().path == "/d/raw" and trees.dataset_path(code.limit(0), "o").first().path is None


def test_trees_with_gaps(spark):
    node = "struct<node_id: string, parent_id: string, children_ids: array<string>, depth: int, logs: array<string>>"
    tree = [("r", None, ["a", "gone", "b"], 0, ["<think>Root: start exploration now</think>"]), ("a", "r", [], 1, ["<think>1</think><answer> A </answer>"]), ("b", "r", ["gone"], 1, ["<think>2</think>"]), ("z", "q", None, 1, ["<answer>Z</answer>"])]
    x = spark.createDataFrame([(1, None, tree), (2, "s", [])], f"id int, seed_data string, nodes array<{node}>")
    got = trees.records(x, "id", F.lit("task"), F.lit("/d"), "go").collect()
    assert [(r.id, r.path_index, r.prediction, r.output, r.input, r.instruction) for r in got] == [(1, 0, "A", "<think>1</think> <answer> A </answer>", "", "go")]


def test_synthesis(spark):
    steps = spark.createDataFrame([("s", i, "stats" if i else None, f"code  {i}\n x" + "y" * 300, "o" * 3000) for i in range(4)], "sid string, step int, action_type string, code string, observation string")
    text = Y.path_context(steps, "sid").first().context
    assert text.startswith("[Earlier step summaries]\n- Step 0 [unknown] code=code 0 x") and "[Recent detailed steps]\nStep 2 [stats] code:\ncode  2\n x" in text and "...<truncated>..." in text
    assert len(Y.path_context(steps, "sid", recent=4, total=5000).first().context) <= 5020
    r = one(spark, a=Y.fallback_thought(F.lit("# * Head\n " + "z" * 300), markup=True), b=Y.fallback_thought(F.lit(None).cast("string")), c=Y.root_observation(F.lit("q"), F.lit("")), d=Y.node_id("node", F.lit(1)), e=Y.node_id("react"))
    assert r.a == Y.THOUGHT + ("Head " + "z" * 195) + "..." and r.b == Y.NO_THOUGHT and r.c == "Starting point: q" and r.d.startswith("node_") and len(r.e) == 14
    qa = spark.createDataFrame([("t", "s", 1, "What?", "42", [(None, "a", "b", "c", None), ("<think>x</think><answer>42</answer>", None, None, None, None)]), ("t", "s", 2, "Why?", "7", None)], f"trajectory_id string, source_id string, qa_index int, question string, answer string, steps array<{Y.STEP}>")
    got = Y.synthesized(qa).collect()
    assert [(g.qa_id, len(g.reasoning_steps)) for g in got] == [("t_qa_1", 2)]
    assert Y.action_catalog({"a": "does it"}) == "- a: does it" and Y.action_catalog(["b"]) == "- b: (custom action)"
    assert one(spark, t=Y.chain_temperature(F.lit(9)), u=Y.attempt_temperature(F.lit(2))).asDict() == {"t": 1.0, "u": pytest.approx(0.8)}


def test_small_functions(spark):
    reply = '<think>[1]</think> so [{"action_type": "stats", "code": " x ", "prior": "0.5"}, {"action_type": "odd", "code": "y", "prior": 7}, {"code": " "}, {"code": "z"}]'
    got = one(spark, c=parsers.candidates(F.lit(reply), ("list_dir", "stats"), "code", "prior", 2)).c
    assert [(x.action_type, x.text, x.score) for x in got] == [("stats", "x", 0.5), ("list_dir", "y", 1.0)]
    r = one(spark, f=T.folded(F.lit("Ａ&lt;ß&amp;lt;")), n=T.paired_tags(F.lit("<a></a><a>"), "a"), w=T.without_results(F.lit("x<result>1</result>y")), o=T.outer_block(F.lit("p<a>1</a>2</a>q"), "a"), e=T.has_error(F.lit("ＥＲＲＯＲ")), m=T.answers_match(F.lit("１２"), F.lit("12")))
    assert (r.f, r.n, r.w, r.o, r.e, r.m) == ("a<ss&lt;", 1, "xy", "<a>1</a>2</a>", True, True)
    assert parsers.strict_blocks("<think>a</think>\n<answer>b</answer>") == ([("think", "a"), ("answer", "b")], [])
    w = one(spark, w=S.warnings_v1(F.lit(False), F.lit(False), F.lit(9), F.lit(7), F.lit(0))).w
    assert w == ["format_invalid", "empty_answer", "tool_frequency_exceeded"]
    x = spark.createDataFrame([("1", "q", "42 ", None, "x"), ("2", "q", " ", ["a", "<answer>7</answer>"], None)], "id string, question string, pred string, logs array<string>, gold string")
    y = P.with_direct(x.select("id", P.base_prompt(x).alias("prompt"), P.prediction(x).alias("tir_prediction"), P.reference(x).alias("reference")), spark.createDataFrame([("2", 0, "8", "7"), ("2", 1, "7", "9")], "id string, n int, prediction string, answer string"), "id", "n")
    assert [(r.id, r.reference, r.difficulty_category) for r in y.orderBy("id").collect()] == [("1", "x", None), ("2", "7", "category_3_dr_wrong_tir_correct")]
    t = spark.createDataFrame([(0, None, None, None, None, [(["a"],), (None,)])], "o int, trajectory_id string, source_id string, seed_data string, total_depth int, nodes array<struct<logs: array<string>>>")
    assert P.log_only(t, "o").first().asDict() == {"trajectory_id": "traj_0", "source_id": "", "seed_data": "", "total_depth": 2, "logs": ["a"]}
    scored = spark.createDataFrame([("1", "i", "o", "p", 85.0, "sft", "r", 1.0)], "sample_id string, input string, output string, prediction string, composite_score double, split string, reference string, format_score double")
    assert P.sft_record(scored, scores=("format",)).first().asDict(True) == {"sample_id": "1", "input": "i", "output": "o", "prediction": "p", "composite_score": 85.0, "quality_detail": {"format_score": 1.0}, "split": "sft", "reference": "r"}


def test_scans_and_sinks(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n[2]\n{"x": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x"\n')
    (tmp_path / "c.json").write_text('[{"x": 5}]')
    (tmp_path / "d.json").write_text('{"y": 5}')
    (tmp_path / "empty").mkdir()
    (tmp_path / "zero.txt").write_text("")
    xs = lambda df: sorted(r.x for r in df.collect())
    assert xs(records.read_objects(spark, f"{d}/a.jsonl", "x int")) == [1, 3]
    with pytest.raises(Exception, match="no JSON"):
        records.read_objects(spark, f"{d}/b.jsonl", "x int").collect()
    assert xs(records.read_objects(spark, f"{d}/b.jsonl", "x int", safe=True)) == xs(records.read_objects(spark, f"{d}/none", "x int", safe=True)) == []
    assert xs(records.read_array(spark, f"{d}/c.json", "x int")) == [5] and xs(records.read_array(spark, f"{d}/d.json", "x int")) == xs(records.read_array(spark, f"{d}/none", "x int")) == []
    with pytest.raises(ValueError, match="no table"):
        records.read_records(spark, f"{d}/d.json")
    assert xs(records.read_records(spark, f"{d}/c.json")) == [5]
    assert {r.rel_path: r["size"] for r in records.inventory(spark, d).collect()}["zero.txt"] == 0
    assert records.inventory_totals(spark, d, 3) == {"num_files": 3, "num_dirs": 2, "total_bytes": 22 + 14 + 10, "max_depth": 1, "truncated": True} or records.inventory_totals(spark, d, 3)["truncated"]
    assert records.summarize_table(spark, f"{d}/c.json") == {"columns": ["x"], "rows": 1, "truncated": False, "error": None}
    assert records.summarize_table(spark, f"{d}/d.json")["columns"] == ["y"] and records.summarize_table(spark, f"{d}/c.json", most_bytes=3)["truncated"]
    assert records.summarize_table(spark, f"{d}/b.jsonl")["rows"] == 2 and records.summarize_table(spark, f"{d}/none.json")["error"]
    for name in ("t1", "t2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trajectories.jsonl").write_text('[{"trajectory_id": "%s"}]' % name if name == "t1" else '{"trajectory_id": "t2"}\n')
    assert [p.rsplit("/", 2)[1] for p in records.trajectory_files(spark, d)] == ["t1", "t2"] and len(records.trajectory_files(spark, f"{d}/t1")) == 1
    assert sorted(r.trajectory_id for r in records.discover(spark, d, f"{d}/missing").collect()) == ["t1", "t2"]
    assert records.discover(spark, f"{d}/missing").count() == 0
    (tmp_path / "s.json").write_text('{"a_tips": ["x", "${V}"], "n": 1}')
    assert records.read_settings(spark, f"{d}/s.json", {"V": "v"}) == {"a_tips": "x\nv", "n": 1}
    assert records.resolved("~/a/../b", home="/h") == "/h/b" and records.resolved("") is None and records.resolved("c", base="/w") == "/w/c"
    df = spark.createDataFrame([(1,)], "x int")
    sinks.append_jsonl(df, f"{d}/out")
    sinks.append_jsonl(df, f"{d}/out")
    assert spark.read.json(f"{d}/out").count() == 2
    sinks.append_array(df.withColumn("y", F.lit(1)), df, f"{d}/arr")
    assert spark.read.option("multiLine", True).json(f"{d}/arr").count() == 2
    sinks.write_pretty(df, f"{d}/pretty")
    assert "\n" in "".join(p.read_text() for p in (tmp_path / "pretty").glob("part-*")).strip()
