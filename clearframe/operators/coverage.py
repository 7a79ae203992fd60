"""Coverage of an analysis: counts, rates and the names that stay unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .propagate import UNKNOWN, Propagation

TOP_NAMES = 10


def _counted_calls(p: Propagation) -> DataFrame:
    """Calls outside boundaries: a boundary's body is not analysed."""
    return p.calls.where("snap = 'all'").join(p.fn.where("snap = 'all' and bnd_kind = 'declared'").select("sym"), "sym", "left_anti")


def scalars(p: Propagation) -> DataFrame:
    unknown = p.state.where((F.col("token") == UNKNOWN) & (F.col("lattice") == "e") & (F.col("snap") == "all")).select("sym", F.lit(True).alias("u"))
    n = lambda c: F.count_if(c).alias
    fn = p.fn.where("snap = 'all'").join(unknown, "sym", "left")
    out = fn.agg(
        F.count("*").alias("functions"),
        n(F.col("eff_kind") == "declared")("declared"),
        n((F.col("eff_kind") == "declared") & ~F.col("by_config"))("by_jsdoc"),
        n((F.col("eff_kind") == "declared") & F.col("by_config"))("by_config"),
        n(F.col("bnd_kind") == "declared")("boundary"),
        n(F.col("entrypoint"))("entrypoints"),
        n(F.col("entrypoint") & (F.col("cap_kind") != "declared"))("entrypoints_without_caps"),
        n(F.coalesce("u", F.lit(False)))("unknown"),
    )
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("functions")), F.lit(0.0)), 6)
    return out.withColumn("unknown_rate", rate("unknown")).withColumn("boundary_rate", rate("boundary"))


def by_kind(p: Propagation) -> DataFrame:
    return _counted_calls(p).groupBy("kind").agg(F.count("*").alias("n"))


def by_reason(p: Propagation) -> DataFrame:
    return _counted_calls(p).where("kind = 'unresolved'").groupBy("reason").agg(F.count("*").alias("n"))


def top_names(p: Propagation, k: int = TOP_NAMES) -> DataFrame:
    names = _counted_calls(p).where("kind = 'unresolved' and operation is not null").groupBy(F.col("operation").alias("name")).agg(F.count("*").alias("n"))
    return names.orderBy(F.desc("n"), F.collate("name", "UNICODE")).limit(k)
