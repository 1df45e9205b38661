"""Joins with stored tables whose files are much smaller than their rows.

Spark plans a broadcast by the size of files, of which the columns that are read have a
share. Packed columns of millions of rows take a few megabytes there and a hundred times
that in the driver, so such tables are sized by their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# A plan may still drop columns, which leaves so small a part of the files at least.
PRUNED = 1 / 64


def too_large(rows: DataFrame) -> bool:
    """Whether rows that are read from files, which Spark might take for small enough, are too large for a broadcast.

    They are counted, from the footers of the files.
    """
    limit = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    planned = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if planned * PRUNED > limit:
        return False
    # A header and each column's usual size.
    return rows.count() * (8 + rows._jdf.schema().defaultSize()) > limit


def sized(rows: DataFrame) -> DataFrame:
    """A side of a join that is read from files; if its rows are too large for a broadcast, both sides move."""
    return rows.hint("merge") if too_large(rows) else rows
