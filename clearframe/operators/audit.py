"""Runtime checks: requests of a context against its grants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import capability_parts, glob_matches


def decisions(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """(ctx, seq, cap, granted) of requests in a context that has grants; others leave no row.

    The join is on the context, resource and action; only the target needs the pattern.  The side
    of the grants is static, so the same plan serves a stream of requests.
    """
    give = grants.withColumn("g", capability_parts(F.col("cap"))).select(F.col("ctx").alias("g_ctx"), F.col("g.resource").alias("r"), F.col("g.action").alias("a"), F.col("g.target").alias("t"))
    give = give.groupBy("g_ctx").agg(F.collect_set(F.struct("r", "a", "t")).alias("gs"))
    need = requests.withColumn("n", capability_parts(F.col("cap")))
    fits = F.exists("gs", lambda g: (g["r"] == F.col("n.resource")) & (g["a"] == F.col("n.action")) & glob_matches(g["t"], F.col("n.target")))
    return need.join(give, F.col("ctx") == F.col("g_ctx")).select("ctx", "seq", "cap", F.coalesce(fits, F.lit(False)).alias("granted"))


def first_denials(decided: DataFrame) -> DataFrame:
    """(ctx, seq, cap, denied): of each context the first denial, and how many there were."""
    return decided.where("not granted").groupBy("ctx").agg(F.min("seq").alias("seq"), F.min_by("cap", "seq").alias("cap"), F.count("*").alias("denied"))


def over_time(requests: DataFrame, limit_seconds: float) -> DataFrame:
    """(ctx, seconds) of contexts that lasted longer than allowed."""
    spent = requests.groupBy("ctx").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return spent.where(F.col("seconds") > limit_seconds)
