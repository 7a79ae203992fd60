"""The audit of capability requests as a stream: requests stream, grants are static."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import decisions


def audit_stream(requests: DataFrame, grants: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends (ctx, seq, cap, granted) for every request read so far, exactly once."""
    return decisions(requests, grants).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
