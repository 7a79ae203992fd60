"""What a change added or removed, and whether each addition was approved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import capability_parts, glob_matches
from ..plans.lineage import checkpointed
from ..sources.facts import Facts
from .propagate import SHARE, UNKNOWN, Propagation, unresolved_operations


def holdings(p: Propagation) -> DataFrame:
    """(snap, sym, body_ix, lattice, token): by body where a function has several, else whole."""
    bodies = p.split
    whole = p.contribution.join(bodies.select("snap", "sym").distinct(), ["snap", "sym"], "left_anti").withColumn("body_ix", F.lit(0))
    return bodies.unionByName(whole)


def holders(held: DataFrame, refs: DataFrame) -> DataFrame:
    """The refs (sym, lattice, token, ..) with base and head: in how many bodies of each snapshot they are held.

    An effect is held by an equal one, a capability also by one that covers it.  One join serves both snapshots.
    """
    own = held.where(F.col("token") != UNKNOWN).select("sym", "lattice", F.col("snap").alias("side"), "body_ix", F.col("token").alias("have"))
    grant = capability_parts(F.col("have"))
    need = capability_parts(F.col("token"))
    covers = (grant["resource"] == need["resource"]) & (grant["action"] == need["action"]) & glob_matches(grant["target"], need["target"])
    match = (F.col("have") == F.col("token")) | ((F.col("lattice") == "c") & F.coalesce(covers, F.lit(False)))
    bodies = lambda side: F.size(F.collect_set(F.when(match & (F.col("side") == side), F.col("body_ix")))).cast("long").alias(side)
    return refs.join(own, ["sym", "lattice"], "left").groupBy(*refs.columns).agg(bodies("base"), bodies("head"))


def authority_changes(p: Propagation) -> DataFrame:
    """(sym, lattice, token, status, change) with change added or removed, over base and head.

    New functions add all they hold, deleted ones remove it; others compare in how many bodies a
    ref is held, so that narrowing a pattern is no addition.  The rows are kept: what is computed
    from them starts with a small plan, and comparisons of one session share them.
    """
    if p.changes is None:
        p.changes = checkpointed(_changes(p), SHARE)
    return p.changes


def _changes(p: Propagation) -> DataFrame:
    held = holdings(p).where("snap in ('base', 'head')")
    present = p.fn.where("snap in ('base', 'head')").groupBy("sym").agg(F.bool_or(F.col("snap") == "base").alias("in_base"), F.bool_or(F.col("snap") == "head").alias("in_head"))
    status = F.when(~F.col("in_base"), "new").when(~F.col("in_head"), "deleted").otherwise("present")
    refs = p.contribution.where((F.col("token") != UNKNOWN) & F.col("snap").isin("base", "head")).select("snap", "sym", "lattice", "token")
    owned = refs.groupBy("sym", "lattice", "token").agg(F.bool_or(F.col("snap") == "base").alias("of_base"), F.bool_or(F.col("snap") == "head").alias("of_head"))
    rows = holders(held, owned).join(present, "sym").withColumn("status", status)
    change = F.when(F.col("of_head") & (F.col("head") > F.col("base")), "added").when(F.col("of_base") & (F.col("base") > F.col("head")), "removed")
    return rows.withColumn("change", change).where("change is not null").select("sym", "lattice", "token", "status", "change")


def unchanged(p: Propagation) -> DataFrame:
    """(sym, lattice, token) that functions on both sides hold in head and that were not added."""
    both = p.fn.groupBy("sym").agg(F.countDistinct("snap").alias("n")).where("n = 2").select("sym")
    head = p.contribution.where((F.col("snap") == "head") & (F.col("token") != UNKNOWN)).select("sym", "lattice", "token").distinct()
    added = authority_changes(p).where("change = 'added'").select("sym", "lattice", "token")
    return head.join(both, "sym", "left_semi").join(added, ["sym", "lattice", "token"], "left_anti")


def unresolved_gains(p: Propagation) -> DataFrame:
    """(sym, reason, operation, gained): positive part of the multiset difference, null a key too."""
    ops = unresolved_operations(p)
    both = p.fn.where("snap = 'base'").select("sym").join(p.fn.where("snap = 'head'").select("sym"), "sym")
    base = ops.where("snap = 'base'").select(F.col("sym").alias("s"), F.col("reason").alias("r"), F.col("operation").alias("o"), F.col("n").alias("had"))
    head = ops.where("snap = 'head'").join(both, "sym", "left_semi")
    joined = head.join(base, (F.col("sym") == F.col("s")) & F.col("reason").eqNullSafe(F.col("r")) & F.col("operation").eqNullSafe(F.col("o")), "left")
    return joined.select("sym", "reason", "operation", (F.col("n") - F.coalesce("had", F.lit(0))).alias("gained")).where("gained > 0")


def unknown_changes(p: Propagation) -> DataFrame:
    """(sym, gained, lost) of functions on both sides, by the number of unknown bodies."""
    held = holdings(p).where((F.col("token") == UNKNOWN) & F.col("snap").isin("base", "head"))
    n = held.groupBy("sym").agg(F.countDistinct(F.when(F.col("snap") == "base", F.col("body_ix"))).alias("b"), F.countDistinct(F.when(F.col("snap") == "head", F.col("body_ix"))).alias("h"))
    both = p.fn.where("snap = 'base'").select("sym").join(p.fn.where("snap = 'head'").select("sym"), "sym")
    return n.join(both, "sym").select("sym", (F.col("h") > F.col("b")).alias("gained"), (F.col("b") > F.col("h")).alias("lost")).where("gained or lost")


def in_force(ledger: DataFrame) -> DataFrame:
    """Head lines beyond as many as base has with the same key; the first ones are spent."""
    key = ["symbol", "kind", "name"]
    base = ledger.where("side = 'base'").groupBy(*key).agg(F.count("*").alias("spent"))
    order = W.partitionBy(*key).orderBy("line")
    head = ledger.where("side = 'head'").withColumn("n", F.row_number().over(order)).join(base, key, "left")
    return head.where(F.col("n") > F.coalesce("spent", F.lit(0))).select(*key, "line", (F.col("n") - F.coalesce("spent", F.lit(0))).alias("slot"))


def review(increases: DataFrame, ledger: DataFrame) -> DataFrame:
    """(symbol, kind, name, status, line): approved, unapproved, and unused ledger lines.

    The nth increase of a key takes the nth line in force; keys are compared as text.
    """
    key = ["symbol", "kind", "name"]
    asked = increases.withColumn("slot", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(1))))
    joined = asked.withColumn("asked", F.lit(True)).join(in_force(ledger), [*key, "slot"], "full_outer")
    status = F.when(F.col("asked").isNull(), "unused").when(F.col("line").isNull(), "unapproved").otherwise("approved")
    return joined.select(*key, status.alias("status"), "line")


def increases(p: Propagation) -> DataFrame:
    added = authority_changes(p).where("change = 'added'")
    return added.select(F.col("sym").alias("symbol"), F.when(F.col("lattice") == "e", "effect").otherwise("capability").alias("kind"), F.col("token").alias("name"))


def ledger_rows(facts: Facts) -> DataFrame:
    return facts.ledger.withColumnRenamed("sym", "symbol")


def parse_ledger(lines: DataFrame) -> DataFrame:
    """(side, line, symbol, kind, name, reason, malformed) from Markdown lines (side, line, text).

    List items after the first heading ``Approvals`` count, of the whole file if it has none.
    """
    heading = F.col("text").rlike(r"^#{1,6}\s+Approvals\s*$")
    whole = W.partitionBy("side")
    marked = lines.withColumn("heading", heading.cast("int"))
    marked = marked.withColumn("any", F.max("heading").over(whole)).withColumn("on", F.max("heading").over(whole.orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)))
    items = marked.where(((F.col("any") == 0) | (F.col("on") == 1)) & F.col("text").rlike(r"^\s*[-*]\s+`"))
    shape = r"^\s*[-*]\s+`([^`]+)`\s+`(effect|capability):([^`]+)`\s+—\s+(\S.*)$"
    part = lambda i: F.nullif(F.regexp_extract("text", shape, i), F.lit(""))
    return items.select("side", "line", part(1).alias("symbol"), part(2).alias("kind"), part(3).alias("name"), part(4).alias("reason"), (~F.col("text").rlike(shape)).alias("malformed"))
