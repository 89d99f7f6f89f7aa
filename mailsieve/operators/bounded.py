"""Tables that are small by their meaning, sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 50_000


def broadcast_bounded(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Evaluate a narrow table of one row per class or the like once and mark it for broadcast.

    The plan is the same at every size; a table that is not as small as its meaning says is an error.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"over {max_rows} rows in a table of {', '.join(df.columns)}: too many groups")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
