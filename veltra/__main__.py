"""python -m veltra "SQL" [--parquet FOLDER TABLE ...] [--root FOLDER] [--strict]: run a script and print its rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from veltra.session import Engine


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="veltra", description=__doc__)
    args.add_argument("sql")
    args.add_argument("--parquet", nargs="+", metavar=("FOLDER", "TABLE"), default=[])
    args.add_argument("--root")
    args.add_argument("--strict", action="store_true")
    given = args.parse_args(argv)
    spark = SparkSession.builder.appName("veltra").getOrCreate()
    engine = Engine(spark, given.root, given.strict)
    if given.parquet:
        engine.register_parquet(*given.parquet)
    for out in engine.script(given.sql):
        if out is not None:
            out.show(1000, truncate=False)


if __name__ == "__main__":
    main()
