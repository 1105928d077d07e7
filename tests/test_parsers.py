"""Parsers and record operators on small cases, nulls and broken input among them."""

from pyspark.sql import functions as F

from strandline.functions import parsers
from strandline.operators import graph
from strandline.operators import projections as P


def test_balanced():
    assert parsers.balanced(r'x {"a": "}\"", "b": {"c": 1}} y', "{") == r'{"a": "}\"", "b": {"c": 1}}'
    assert parsers.balanced('{"a": 1', "{") is None and parsers.balanced(None, "[") is None and parsers.balanced("", "{") is None
    assert parsers.balanced("a [1, [2]] b", "[") == "[1, [2]]"


def test_lenient():
    assert parsers.lenient("```json\n{'a': True,}\n```") == {"a": True}
    assert parsers.lenient("[1, 2") is None and parsers.lenient(None) is None and parsers.lenient("12") is None


def test_nested_facts():
    found = list(parsers.nested_facts({"Rows": True, "n": 4, "fields": ["a", " b ", 3, ""], "x": [{"files": 2.9}, "d/e.csv"]}))
    assert found == [("count", "row_count", "1"), ("column", None, "a"), ("column", None, "b"), ("count", "file_count", "2"), ("text", None, "d/e.csv")]
    deep = {"a": {"a": {"a": {"a": {"a": {"rows": 1}}}}}}
    assert list(parsers.nested_facts(deep)) == [] and list(parsers.nested_facts(deep["a"])) == [("count", "row_count", "1")]
    assert len(list(parsers.nested_facts([f"f{i}" for i in range(25)]))) == 20
    assert list(parsers.nested_facts({"rows": float("nan")})) == []


def test_python_accesses(spark):
    df = spark.createDataFrame([("import os\nfor a in os.walk('d/e'):\n    open('x.csv').read()",), ("run (",), ("",), (None,)], "code string")
    got = [r.a for r in df.select(parsers.python_accesses(F.col("code")).alias("a")).collect()]
    assert got[0].operations == ["open_file", "walk"] and got[0].primary_path == "x.csv" and "d/e" in got[0].paths
    assert all(a.operations == ["execute_code"] and a.primary_path is None for a in got[1:])


def test_facts(spark):
    df = spark.createDataFrame([("rows: 5, columns = ['a', 'b']",), (None,)], "t string")
    got = [r.f for r in df.select(parsers.facts(F.col("t")).alias("f")).collect()]
    assert {(f.kind, f.value) for f in got[0]} == {("count", "5"), ("column", "a"), ("column", "b")} and got[1] == []
    assert spark.range(1).select(parsers.normalize_free_text(F.lit("１２ &amp;  x ")).alias("x")).first().x == "12 & x"


def test_records(spark):
    df = spark.createDataFrame([(0, "a", None, "q  1"), (1, "", "b", "q"), (2, None, "", " q  1 "), (3, None, None, " ")], "i int, task_id string, uid string, question string")
    ids = [r.x for r in df.orderBy("i").select(P.sample_id(df, "i").alias("x")).collect()]
    assert ids[:2] == ["a", "b"] and len(ids[2]) == 32 and ids[3] == "sample_3"
    r = spark.range(1).select(P.final_think_answer(F.lit("<think>a\n</think>\n <result>b")).alias("r"), P.final_think_answer(F.lit("")).alias("e")).first()
    assert (r.r.think, r.r.answer, r.e.think, r.e.answer) == ("a", "b", "", "")


def test_empty_report(spark):
    df = spark.createDataFrame([], "split string, s double, gate boolean")
    assert P.report(df, ["s"], ["gate"]).first().asDict() == {"n": 0, "n_sft": 0, "n_rl": 0, "n_discard": 0, "mean_s": 0.0, "n_gate": 0}


def test_until(spark):
    df = spark.createDataFrame([("f", 1, True), ("f", 2, False), ("f", 3, True), ("f", 4, True)], "g string, i int, ok boolean")
    assert [r.i for r in graph.until(df, "g", "i", "ok", 2).orderBy("i").collect()] == [1, 2, 3]
