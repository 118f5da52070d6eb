"""A thin command line: ``python -m aeonframe.cli SF_DIR QUERY`` prints a query's rows as JSON lines;
``--ql TEXT [name=value ...]`` runs a query text; ``--list`` names the queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import catalog, ql


def main(args: list[str]) -> int:
    if args == ["--list"]:
        print("\n".join(sorted(catalog.queries())))
        return 0
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[1] == "--ql":
        given = dict(a.split("=", 1) for a in args[3:])
        df = ql.run(args[2], catalog.tables(spark, args[0]), {k: int(v) if v.isdigit() else v for k, v in given.items()})
    else:
        df = catalog.queries()[args[1]](spark, args[0])
    for line in df.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
