"""Rules that read raw tags, names and update plans: effects tags, constructions, clients, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONSTRUCTORS, EFFECTS, HIGHER_ORDER_CONSTRUCTORS, NULLARY_CONSTRUCTORS, PURE_CONSTRUCTORS, SQL_METHODS, client_rows
from ..functions.scalars import _escaped, sql_direction


def effects_tag(text: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Effects in canonical order, or null where a token is neither an effect nor an alias.

    ``pure`` alone is the empty set.  An alias stands for its effects and is not expanded further;
    ``llm`` implies ``network``.
    """
    names = {**{e: (e,) for e in EFFECTS}, **{a: tuple(e for e in own if e in EFFECTS) for a, own in aliases.items() if a not in EFFECTS}}
    table = F.create_map(*[x for name, own in names.items() for x in (F.lit(name), F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))])
    tokens = F.transform(F.split(F.trim(text), ","), lambda t: table[F.trim(t)])
    said = F.flatten(tokens)
    closed = F.when(F.array_contains(said, "llm"), F.array_append(said, F.lit("network"))).otherwise(said)
    ordered = F.filter(F.array(*map(F.lit, EFFECTS)), lambda e: F.array_contains(closed, e))
    return F.when(F.trim(text) == "pure", F.array().cast("array<string>")).when(F.forall(tokens, lambda t: t.isNotNull()), ordered)


def construction(name: Column, arguments: Column) -> Column:
    """What ``new X`` does: an effect, ``higher-order``, ``pure``, or null where it is not known."""
    effects = F.create_map(*[F.lit(x) for pair in CONSTRUCTORS.items() for x in pair])
    bare = F.create_map(*[F.lit(x) for pair in NULLARY_CONSTRUCTORS.items() for x in pair])
    pure = name.isin(*[f"new {n}" for n in PURE_CONSTRUCTORS]) | name.isin(*NULLARY_CONSTRUCTORS)
    return F.coalesce(effects[name], F.when(arguments == 0, bare[name]), F.when(name.isin(*HIGHER_ORDER_CONSTRUCTORS), "higher-order"), F.when(pure, "pure"))


def client_effects(calls: DataFrame) -> DataFrame:
    """Calls (name, statement, ..) with ``effects``: of SQL methods by the statement's direction, of
    others by the first matching pattern, in which ``*`` is exactly one dotted segment; else null."""
    rows = calls.sparkSession.createDataFrame(client_rows(), "rank int, pattern string, found string")
    regex = F.concat(F.lit("^"), F.replace(_escaped(F.col("pattern")), F.lit("*"), F.lit("[^.]+")), F.lit(r"\z"))
    distinct = calls.select("name").distinct()
    matched = distinct.join(F.broadcast(rows), F.regexp_like("name", regex)).groupBy("name").agg(F.min_by("found", "rank").alias("found"))
    direction = sql_direction(F.col("statement"))
    by_sql = F.when(direction == "both", "db_read,db_write").otherwise(F.concat(F.lit("db_"), direction))
    return calls.join(matched, "name", "left").withColumn("effects", F.when(F.col("name").isin(*SQL_METHODS), by_sql).otherwise(F.col("found"))).drop("found")


def update_plan(updates: DataFrame) -> DataFrame:
    """Adds ``plan`` (full, partial or none) and ``narrow`` to update requests.

    Columns: first, failed, told (a change set was given), reusable (the fingerprint allows it),
    added, deleted, edited, configs (numbers of paths), unknown (a path nobody knows).
    """
    full = F.col("first") | F.col("failed") | ~F.col("told") | ~F.col("reusable") | (F.col("added") > 0) | F.col("unknown")
    partial = (F.col("deleted") + F.col("edited") + F.col("configs")) > 0
    narrow = ~full & (F.col("deleted") == 0) & (F.col("configs") == 0) & (F.col("edited") > 0)
    return updates.withColumn("plan", F.when(full, "full").when(partial, "partial").otherwise("none")).withColumn("narrow", narrow)


def fingerprint_reusable(before: Column, after: Column, open_before: Column, open_after: Column) -> Column:
    """Equal fingerprints permit reuse only where neither side left anything undecided."""
    return (open_before == 0) & (open_after == 0) & before.eqNullSafe(after)
