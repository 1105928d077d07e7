"""Runs a query from the command line: ``python -m strandline QUERY FOLDER [--out PATH]``, or ``--list``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandline.plans import catalog


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    p.add_argument("query", nargs="?", help="name of a query")
    p.add_argument("folder", nargs="?", help="folder of the tables, each NAME.parquet")
    p.add_argument("--list", action="store_true", help="list the queries and what they give")
    p.add_argument("--out", help="folder to write to; without it rows are shown")
    p.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    p.add_argument("--mode", default="error", choices=("error", "overwrite", "append"))
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    a, queries = arguments(args), catalog.queries()
    if a.list or not (a.query and a.folder):
        for name, query in queries.items():
            print(f"{name}: {query.__doc__}")
        return 0 if a.list else 2
    if a.query not in queries:
        print(f"no query {a.query}")
        return 2
    df = queries[a.query](SparkSession.builder.getOrCreate(), a.folder)
    if a.out:
        df.write.mode(a.mode).format(a.format).save(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
