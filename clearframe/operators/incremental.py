"""What an edit can affect, and recomputing only that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed, closure, fixed_point
from .propagate import TOKEN, Propagation, direct_tokens, masked, unmasked


def summary_hashes(p: Propagation) -> DataFrame:
    """(snap, sym, hash) over everything a function's summary holds; call order counts, set order not.

    Calls are hashed one by one, with their place among the function's calls, and the hashes are
    combined by sums, so no function's calls meet in one row.
    """
    fields = ["body_ix", "kind", "callee", "effect", "req_cap", "cap_target_unknown", "reason", "operation", "escaping", "unknown_callback"]
    place = F.row_number().over(W.partitionBy("snap", "sym").orderBy("call_ord"))
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in fields])
    each = p.calls.select("snap", "sym", place.alias("place"), *fields)
    sums = lambda df, *of: df.groupBy("snap", "sym").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(k), *of).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)])
    calls = sums(each, "place", nulls, *[F.col(c) for c in fields]).withColumnsRenamed({"n": "calls", "h1": "c1", "h2": "c2"})
    declared = sums(p.declared, "lattice", "token").withColumnsRenamed({"n": "tokens", "h1": "d1", "h2": "d2"})
    own = p.fn.join(calls, ["snap", "sym"], "left").join(declared, ["snap", "sym"], "left")
    return own.select("snap", "sym", F.sha2(F.to_json(F.struct("eff_kind", "cap_kind", "bud_kind", "bnd_kind", "entrypoint", "by_config", "tokens", "d1", "d2", "calls", "c1", "c2")), 256).alias("hash"))


def summaries_equal(p: Propagation) -> DataFrame:
    """(sym, equal) of functions on both sides."""
    h = summary_hashes(p)
    base, head = (h.where(F.col("snap") == s).select("sym", F.col("hash").alias(s)) for s in ("base", "head"))
    return base.join(head, "sym").select("sym", (F.col("base") == F.col("head")).alias("equal"))


def changed_symbols(p: Propagation) -> DataFrame:
    """Symbols that are new, deleted or have another summary."""
    h = summary_hashes(p)
    base = h.where("snap = 'base'").select("sym", F.col("hash").alias("b"))
    head = h.where("snap = 'head'").select("sym", F.col("hash").alias("h"))
    return base.join(head, "sym", "full_outer").where(~F.col("b").eqNullSafe(F.col("h"))).select("sym")


def impact(p: Propagation, changed: DataFrame) -> DataFrame:
    """The changed symbols and all their callers, over the old and the new graph together."""
    reverse = p.calls.where("kind = 'resolved' and snap in ('base', 'head')").select(F.col("callee").alias("src"), F.col("sym").alias("dst")).distinct()
    return closure(changed.select(F.col("sym").alias("node")), reverse, []).withColumnRenamed("node", "sym")


def scoped_state(before: Propagation, after: Propagation, impacted: DataFrame) -> DataFrame:
    """State of a snapshot from the one before: impacted functions start empty, others keep their rows.

    Only the state of the earlier snapshot is computed in full (or read, where it was kept); calls,
    edges and seeds of the later one are restricted to the impacted functions before any join.
    """
    snap = after.snaps[0]
    impacted = checkpointed(impacted.select("sym").distinct())
    head = after.nodes
    again = head.join(impacted, "sym", "left_semi")
    frozen = before.state.withColumn("snap", F.lit(snap)).join(impacted, "sym", "left_anti").join(head, ["snap", "lattice", "sym"], "left_semi")
    frozen = checkpointed(frozen.select(*TOKEN))
    pinned = again.where("boundary").join(after.declared, ["snap", "lattice", "sym"], "left").where("declared = (token is not null)")
    pinned = pinned.select("snap", "lattice", "sym", F.when(F.col("declared"), F.col("token")).otherwise("?").alias("token"))
    inner = again.where("not boundary").select("snap", "lattice", "sym")
    calls = after.calls.join(impacted, "sym", "left_semi")
    own = direct_tokens(calls).join(inner, ["snap", "lattice", "sym"], "left_semi")
    resolved = calls.where("kind = 'resolved'").select("snap", F.col("sym").alias("caller"), "callee").distinct()
    edges = checkpointed(resolved.join(inner.withColumnRenamed("sym", "caller"), ["snap", "caller"]))
    undeclared = head.where("not declared").select("snap", "lattice", "sym")
    given = after.declared.unionByName(frozen.join(undeclared, ["snap", "lattice", "sym"], "left_semi"))
    constant = edges.join(given.withColumnRenamed("sym", "callee"), ["snap", "lattice", "callee"]).select("snap", "lattice", F.col("caller").alias("sym"), "token")
    open_ = again.where("not declared").select("snap", "lattice", F.col("sym").alias("callee"))
    moving = edges.join(open_, ["snap", "lattice", "callee"]).select("snap", "lattice", F.col("callee").alias("src"), F.col("caller").alias("dst"))
    fresh = unmasked(fixed_point(masked(pinned.unionByName(own).unionByName(constant)), moving, ["snap", "lattice", "grp"]))
    return fresh.select(*TOKEN).unionByName(frozen)


def importer_closure(imports: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): everything that imports a seed, directly or not; ``imports`` is (file, target)."""
    reverse = imports.select(F.col("target").alias("src"), F.col("file").alias("dst"))
    return closure(seeds.select(F.col("file").alias("seed"), F.col("file").alias("node")), reverse, ["seed"])
