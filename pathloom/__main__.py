"""``python -m pathloom query QUERY FOLDER [OUT]`` runs a registered query over a folder of tables; all else are commands over a snapshot (``--help``)."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import cli
from .plans.queries import QUERIES


def main(args: list[str]) -> int:
    if args[:1] == ["query"] or args[:1] and args[0] in QUERIES:
        args = args[1:] if args[0] == "query" else args
        if len(args) not in (2, 3) or args[0] not in QUERIES:
            print(f"{__doc__}\n\nQueries: {', '.join(sorted(QUERIES))}")
            return 2
        result = QUERIES[args[0]](SparkSession.builder.appName("pathloom").getOrCreate(), args[1])
        result.write.parquet(args[2]) if len(args) == 3 else result.show(50, truncate=80)
        return 0
    cli.parser().parse_args(args)  # mistakes are told before a session starts
    for path in cli.run(SparkSession.builder.appName("pathloom").getOrCreate(), args):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
