"""Small operators, the command line and logs."""

from pyspark.sql import functions as F

from strandline import __main__ as cli
from strandline.agent import logs
from strandline.functions import scores as S
from strandline.operators import relational as R


def test_small_operators(spark):
    x = spark.createDataFrame([(1, ["a", "b"], [1, 2, 3]), (2, None, [1])], "i int, a array<string>, b array<int>")
    got = {r.i: r.z for r in x.select("i", R.zipped(F.col("a"), F.col("b")).alias("z")).collect()}
    assert [tuple(e) for e in got[1]] == [("a", 1), ("b", 2)] and not got[2]
    rows = spark.createDataFrame([("g", 0.5, 1, "x"), ("g", 0.9, 2, None), ("g", 0.9, 0, "x"), ("h", None, 3, None)], "g string, s double, o int, t string")
    assert [(r.g, r.o) for r in R.by_score(rows, "g", "s", "o", 2).orderBy("g", "rank").collect()] == [("g", 0), ("g", 2), ("h", 3)]
    assert {(r.g, r.tools) for r in R.distinct_tools(rows, "g", "t").collect()} == {("g", 2), ("h", 1)}
    tags = spark.createDataFrame([(["python", "sql"],), (["python", "search"],), ([],), (None,)], "t array<string>")
    assert [r.n for r in tags.coalesce(1).select(S.usual_calls(F.col("t")).alias("n")).collect()] == [10, 7, 7, 7]
    counts = spark.createDataFrame([("a", n) for n in (1, 2, 3, 4, 10)] + [("b", n) for n in (12, 12, 14, 20, 20)] + [("c", 0)], "g string, n int")
    assert {(r.g, r.threshold) for r in R.tool_threshold(counts, "g", "n").collect()} == {("a", 10), ("b", 15)}


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["--list"]) == 0 and "v1_split:" in capsys.readouterr().out
    assert cli.main(["nothing", "here"]) == 2 and cli.main([]) == 2
    out = str(tmp_path / "out")
    assert cli.main(["manifest_name", "/root/testdata/sf0.001", "--out", out, "--format", "json"]) == 0
    assert spark.read.json(out).count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_logged(tmp_path, capsys):
    with logs.logged(str(tmp_path / "log")):
        print("said")
    assert (tmp_path / "log").read_text() == "said\n" and "said" in capsys.readouterr().out
