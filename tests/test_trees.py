"""Tree queries read the whole tree, whatever its size and depth."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.plans import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("trees"))
    spark.range(5000).select(F.col("id").alias("event_id"), (F.col("id") % 97 / 4).alias("value")).write.parquet(f"{d}/events.parquet")
    return d


def brute():
    """Path of every node from 1 to 4999."""
    out = {}
    for n in range(1, 5000):
        out[n] = [*out.get(n // 2, []), n]
    return out


def test_whole_tree(spark, folder):
    want, run = brute(), lambda name: catalog.queries()[name](spark, folder).collect()
    inner = {n // 2 for n in want}
    assert {(r.leaf, r.length, r.path) for r in run("tree_paths")} == {(n, len(p), ">".join(map(str, p))) for n, p in want.items() if n not in inner}
    under = {}
    for n, p in want.items():
        for a in p:
            under.setdefault(a, []).append(n % 97 / 4)
    got = {r.node: (r.visits, r.total) for r in run("backprop")}
    assert got == {n: (len(v), round(sum(v) * 10_000)) for n, v in under.items()}
    assert {r.level: r.n for r in run("tree_levels")} == {k: min(2**k, 5000 - 2**k) for k in range(13)}


@pytest.mark.parametrize("name", ["tree_paths", "backprop", "tree_levels"])
def test_same_as_sql_of_all_ids(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name].replace("event_id between 1 and 2000", "event_id >= 1"))
    got = catalog.queries()[name](spark, folder).select(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_deep_orphans_and_cycles(spark):
    rows = [(n, n - 1 if n else None) for n in range(50)] + [(100, 99), (101, 100)]
    nodes = spark.createDataFrame(rows, "node bigint, parent bigint")
    got = {r.node: r.path for r in graph.paths(nodes).collect()}
    assert got == {n: list(range(n + 1)) for n in range(50)} | {100: [100], 101: [100, 101]}
    assert {(r.ancestor, r.hops) for r in graph.ancestors(nodes).where("node = 3").collect()} == {(0, 3), (1, 2), (2, 1), (3, 0)}
    with pytest.raises(ValueError, match="cycle"):
        graph.paths(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "node bigint, parent bigint"))
