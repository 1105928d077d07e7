"""Hand-checked values of the formulas and parsers."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import scores as S
from strandline.functions import text as T
from strandline.operators import blocks
from strandline.operators import relational as R
from strandline.sources import records
from strandline.streaming.upserts import score_stream


@pytest.fixture
def value(spark):
    return lambda col: spark.range(1).select(col.alias("x")).first().x


L = F.lit


def test_composite(value):
    parts = {"grounding": L(80.0), "coverage": L(60.0), "execution": L(90.0), "answer_quality": L(70.0), "efficiency": L(100.0)}
    assert value(S.composite(parts)) == 76.4
    assert value(S.composite(parts | {"grounding": L(0.0)})) == 20.52


def test_scores(value):
    assert value(S.grounding(L(6.6), L(3.5), L(1.0), L(1.4), L(1.4), L(5))) == pytest.approx(47.4242, abs=1e-4)
    assert value(S.grounding(L(0.0), L(0.0), L(0.0), L(0.0), L(0.0), L(0))) == 10
    assert value(S.efficiency(L(12), L(8), L(2), L(9), L(10))) == pytest.approx(68.9166, abs=1e-3)
    assert value(S.tool_budget(L(100), L(3), L(2), L(1), L(False))) == 15
    assert value(S.target_weight(L(0.5))) == 2.5 and value(S.target_weight(L(0.1))) == 1.3
    assert value(S.uct(L(0), L(3), L(0.0), L(0.6), L(2), L(0.5 - 0.7))) == pytest.approx(1.1064460, abs=1e-6)
    assert value(S.uct(L(2), L(3), L(0.5), L(0.7), L(2), L(None).cast("double"))) == pytest.approx(1.0758446, abs=1e-6)
    assert value(S.prior_entropy(F.array(L(0.9), L(0.1)))) == pytest.approx(0.346863, abs=1e-5)
    assert value(S.branches(L(0.346863), L(2), 3)) == 1 and value(S.branches(L(0.757679), L(3), 3)) == 3


def test_answers(value):
    m = lambda a, b: value(T.answers_match(L(a), L(b)))
    assert m("1,000", "1000.0") and m("1/2", "0.5") and m("The answer is 5.", "5")
    assert m("", "5") is None and m("12", "13") is False


def test_text(value):
    assert value(T.shorten_separators(L("========x"))) == "===x"
    assert value(T.path_tokens(L("value 3.14"))) == ["3.14"] and value(T.extension_tokens(L("value 3.14"))) == [".14"]
    facts = value(T.count_facts(L("rows: 12\nshape = (3, 7)\nnrow: 4")))
    assert sorted((f.label, f.value) for f in facts) == [("column_count", 7), ("row_count", 3), ("row_count", 12)]


def test_blocks(value):
    text = L("<think>a<answer>b</answer></think><answer>c")
    found = value(blocks.parse(text))
    assert [(b.tag, b.content, b.closed) for b in found] == [("think", "a<answer>b</answer>", True), ("answer", "c", False)]
    assert "unclosed" in value(blocks.format_errors(blocks.parse(text), blocks.outside(text)))


def test_threshold_and_upsert(spark):
    t = lambda c: R.tool_threshold(spark.createDataFrame([("g", x) for x in c], "g string, n bigint"), "g", "n").first().threshold
    assert t([1, 2, 3, 4, 10]) == 10 and t([12, 12, 14, 20, 20]) == 15
    df = lambda rows: spark.createDataFrame(rows, "k string, v string")
    out = R.upsert(df([("a", "a"), ("b", "b"), (None, "n")]), df([("b", "b'")]), df([("b", ""), ("c", "")]), "k")
    assert {(r.k, r.v) for r in out.collect()} == {("a", "a"), ("b", "b'"), (None, "n")}


def test_sources(spark, tmp_path):
    rows = [{"sample_id": "a", "answer": "1"}, {"sample_id": "b", "answer": "2"}]
    (tmp_path / "x.json").write_text(json.dumps({"results": rows}))
    (tmp_path / "y.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "z.jsonl").write_text(json.dumps(rows))
    for name in ("x.json", "y.jsonl", "z.jsonl"):
        assert records.read_records(spark, str(tmp_path / name)).count() == 2
    (tmp_path / "t.jsonl").write_text(json.dumps([{"trajectory_id": "t", "nodes": [{"node_id": "n", "depth": 0}]}]))
    assert records.read_trajectories(spark, str(tmp_path / "t.jsonl")).first().nodes[0].node_id == "n"
    files = records.inventory(spark, str(tmp_path)).collect()
    assert [f.rel_path for f in files] == ["t.jsonl", "x.json", "y.jsonl", "z.jsonl"] and files[0].suffix == ".jsonl"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"sample_id": "a", "v": 1}\n{"sample_id": "b", "v": 2}\n')
    q = score_stream(spark, str(tmp_path / "in"), "sample_id string, v int", lambda d: d.withColumn("s", F.col("v") * 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.sample_id, r.s) for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()} == {("a", 2), ("b", 4)}


def test_entropies(spark, value):
    kind = "array<struct<logprob: double, top_logprobs: array<struct<logprob: double>>>>"
    made = lambda sql: F.expr(f"cast({sql} as {kind})")
    half = "ln(cast(0.5 as double))"
    assert value(S.token_entropy(made(f"array(struct({half}, array(struct({half}), struct({half}))))"))) == pytest.approx(1.0)
    assert value(S.token_entropy(made("array(struct(cast(-1 as double), cast(null as array<struct<logprob: double>>)))"))) == pytest.approx(1.0)
    assert value(S.token_entropy(made("null"))) == 0 and value(S.token_entropy(made("array()"))) == 0
    assert value(S.step_entropy(L(0.2), L(0.6))) == pytest.approx(0.4)
    assert value(S.step_entropy(L(0.2), L(None).cast("double"))) == pytest.approx(0.2)
