"""Membership counts kept up to date as runs arrive.

Ensembles are batches and need no stream; but counts of memberships add up, so a folder that runs are written to can be followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow_counts(bridge: DataFrame, member: str, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A query whose in-memory table `name` has (key, counts) of a streaming bridge; with once, it ends when all is read."""
    counts = bridge.groupBy(F.col(member).alias("key")).agg(F.count("*").alias("counts"))
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
