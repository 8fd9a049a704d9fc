"""Jobs from a command line: ``python -m rainloom list`` and ``python -m rainloom run NAME --data DIR --out PATH``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import analysis, basics, registry, reports  # noqa: F401  they register their queries


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Lists the registered queries, or runs one of them and writes its result as Parquet. Runs in the session that
    ``spark-submit`` sets up."""
    parser = argparse.ArgumentParser(prog="rainloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    chosen = parser.parse_args(arguments)
    if chosen.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = spark or SparkSession.builder.appName(f"rainloom {chosen.name}").getOrCreate()
    registry.QUERIES[chosen.name](spark, chosen.data).write.mode("overwrite").parquet(chosen.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
