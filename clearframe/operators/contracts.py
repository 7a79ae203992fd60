"""Contracts of three sources: doc comments, the config file and runtime wrappers' specs.

A comment beats the config and the config beats a spec, tag by tag; a config value that differs from
a declared one is a divergence.  All inputs are long tables, one row for each symbol and tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import path_glob_pattern


def config_matches(config: DataFrame, fn: DataFrame) -> DataFrame:
    """(sym, key, exact, ambiguous): the config entry of each symbol that has any.

    Entries meet symbols by name, then by the glob of their path.  An exact key beats globs; two
    entries of the better kind are ambiguous, and then ``key`` is the smaller one.
    """
    entries = config.select("key", "exact", "decl_sym", path_glob_pattern(F.col("decl_path")).alias("regex"))
    named = fn.select("sym", "file", F.substring_index("sym", "#", -1).alias("decl_sym"))
    met = named.join(entries, "decl_sym").where(F.regexp_like("file", F.col("regex")))
    best = met.groupBy("sym").agg(F.max("exact").alias("exact"), F.count_if("exact").alias("e"), F.count("*").alias("n"), F.min_by("key", F.struct(~F.col("exact"), "key")).alias("key"))
    return best.select("sym", "key", "exact", F.when(F.col("exact"), F.col("e") > 1).otherwise(F.col("n") > 1).alias("ambiguous"))


def unmatched_exact(config: DataFrame, fn: DataFrame) -> DataFrame:
    """Exact keys that name no symbol."""
    return config.where("exact").select("key").distinct().join(fn.select(F.col("sym").alias("key")), "key", "left_anti")


def first_specs(specs: DataFrame) -> DataFrame:
    """(sym, tag, value): of several specs of a handler the first in source order."""
    first = specs.groupBy("sym").agg(F.min_by(F.struct("caps", "budget"), "ord").alias("s"))
    tags = F.explode(F.array(F.struct(F.lit("capabilities").alias("tag"), F.col("s.caps").alias("value")), F.struct(F.lit("budget").alias("tag"), F.col("s.budget").alias("value"))))
    return first.select("sym", tags.alias("t")).select("sym", "t.*").where("value is not null")


def merged(contracts: DataFrame, matches: DataFrame, config_tags: DataFrame, specs: DataFrame) -> DataFrame:
    """(sym, tag, kind, value, origin, diverges); ambiguous config entries give nothing."""
    config = matches.where("not ambiguous").join(config_tags, "key").select("sym", "tag", F.col("value").alias("c"))
    both = contracts.join(config, ["sym", "tag"], "left").join(first_specs(specs).withColumnRenamed("value", "s"), ["sym", "tag"], "left")
    none, declared = F.col("kind") == "none", F.col("kind") == "declared"
    # a config that says "not an entrypoint" adds nothing to a symbol that is none
    usable = F.col("c").isNotNull() & ((F.col("tag") != "entrypoint") | (F.col("c") == "true"))
    origin = F.when(declared, "jsdoc").when(none & usable, "config").when(none & F.col("s").isNotNull(), "spec")
    return both.select(
        "sym", "tag", F.when(none & origin.isNotNull(), "declared").otherwise(F.col("kind")).alias("kind"),
        F.when(none & usable, F.col("c")).when(none, F.col("s")).otherwise(F.col("value")).alias("value"),
        origin.alias("origin"), (declared & F.col("c").isNotNull() & (F.col("value") != F.col("c"))).alias("diverges"),
    )


def wrapper_findings(wrappers: DataFrame, contracts: DataFrame) -> DataFrame:
    """(wrapper, rule, cause): wrappers that disagree with their handler's contract or can't be compared."""
    of = lambda tag: F.max(F.when(F.col("tag") == tag, F.struct("kind", "value"))).alias(tag)
    handlers = contracts.groupBy(F.col("sym").alias("handler")).agg(of("capabilities"), of("budget"), of("entrypoint"))
    w = wrappers.join(handlers, "handler", "left")
    found, known = F.col("capabilities").isNotNull(), lambda tag: F.col(f"{tag}.kind") != "invalid"
    caps_none = (F.col("capabilities.kind") == "none") & (F.col("entrypoint.kind") == "none")
    sorted_text = lambda c: F.array_join(F.array_sort(F.split(F.coalesce(c, F.lit("")), ",")), ",")
    same_caps = sorted_text(F.col("caps")) == sorted_text(F.col("capabilities.value"))
    same_budget = F.nullif(F.col("w_budget"), F.lit("none")).eqNullSafe(F.col("budget.value"))
    caps = F.when(F.col("caps").isNull(), "AMB-W004:caps-not-literal").when(caps_none, "AMB-W004:nothing-declared").when(~same_caps, "AMB-E010:caps-differ")
    budget = F.when(F.col("w_budget").isNull(), "AMB-W004:budget-not-literal").when(~same_budget, "AMB-E011:budget-differs")
    rules = F.when(~found, F.array(F.lit("AMB-W004:no-handler"))).otherwise(F.array(F.when(known("capabilities"), caps), F.when(known("budget"), budget)))
    each = w.select("wrapper", F.explode(F.array_compact(rules)).alias("r"))
    return each.select("wrapper", F.substring_index("r", ":", 1).alias("rule"), F.substring_index("r", ":", -1).alias("cause"))


def approval_region(lines: DataFrame) -> DataFrame:
    """The lines after the first heading of each file, or the whole file where there is none."""
    first = lines.where("heading").groupBy("side").agg(F.min("line").alias("first"))
    return lines.join(first, "side", "left").where(F.col("first").isNull() | (F.col("line") > F.col("first"))).drop("first")


def numbered_keys(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``key`` made unique: the second row of a key gets `` #2`` and so on."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("n", n).withColumn(key, F.when(F.col("n") > 1, F.concat(F.col(key), F.lit(" #"), F.col("n").cast("string"))).otherwise(F.col(key))).drop("n")
