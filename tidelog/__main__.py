"""python -m tidelog QUERY FOLDER [OUTPUT]: runs a query over a folder of parquet tables; shows it, or writes it as parquet."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.queries import QUERIES


def main(args: list[str]) -> int:
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(__doc__, "Queries: " + " ".join(sorted(QUERIES)), sep="\n")
        return 2
    spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = QUERIES[args[0]](spark, args[1])
    if len(args) == 3:
        found.write.mode("errorifexists").parquet(args[2])
    else:
        found.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
