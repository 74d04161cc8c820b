"""Functions of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def united(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, by name.

    Spark 4.1 takes a union of equally partitioned parts for partitioned itself and plans joins and groups without a
    shuffle on that, but may still run it part behind part: twice the partitions, "Can't zip RDDs with unequal numbers
    of partitions".  It happens wherever no side of a join is small enough for a broadcast, so the session goes without.
    """
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
