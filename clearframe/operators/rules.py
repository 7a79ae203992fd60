"""The findings: one frame for each rule, with the rule's id, symbol and subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EFFECTS
from ..plans.lineage import checkpointed
from .propagate import TOKEN, UNKNOWN, Propagation, excess, excess_capabilities, leaves_unknown

SEVERITY = {"E": "error", "W": "warning", "I": "info"}
#: Rules that strict mode turns into errors.
STRICT = ("AMB-W001", "AMB-W003")


def finding(df: DataFrame, rule: str, subject=None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), "sym", (subject if subject is not None else F.lit("")).alias("subject"))


def effect_rank(column: str):
    return F.create_map(*[F.lit(x) for i, e in enumerate(EFFECTS) for x in (e, i)])[F.col(column)]


def excess_effects(p: Propagation) -> DataFrame:
    """R01: the first excess effect in canonical order, and how many there are."""
    over = excess(p).where("snap = 'all' and lattice = 'e'")
    return over.groupBy("sym").agg(F.min_by("token", effect_rank("token")).alias("subject"), F.count("*").alias("n"))


def literal_excess(p: Propagation) -> DataFrame:
    """R07: call sites whose own literal target no grant covers (sym, call_ord, token)."""
    inner = p.nodes.where("lattice = 'c' and declared and not boundary and snap = 'all'").select("snap", "sym")
    calls = p.calls.where("req_cap is not null").join(inner, ["snap", "sym"], "left_semi").select("snap", F.lit("c").alias("lattice"), "sym", "call_ord", F.col("req_cap").alias("token"))
    return excess_capabilities(calls, p.declared.where("lattice = 'c'"), ["snap", "lattice", "sym"]).select("sym", "call_ord", "token")


def inherited_excess(p: Propagation) -> DataFrame:
    """R06: excess capabilities not reported at a call site, or reported there and also inherited."""
    over = excess(p).where("snap = 'all' and lattice = 'c'")
    literal = literal_excess(p).select("sym", "token").distinct().withColumn("literal", F.lit(True))
    seen = p.witnesses().where("snap = 'all' and lattice = 'c'").select("sym", "token").withColumn("witnessed", F.lit(True))
    joined = over.join(literal, ["sym", "token"], "left").join(seen, ["sym", "token"], "left")
    return joined.where("literal is null or witnessed").select("sym", "token")


def unknown_cause(p: Propagation) -> DataFrame:
    """R08: why a declared capability set is not fully known.

    The boundary at the end of the witness chain, else a target the source does not fix (if nothing
    is unresolved), else an unresolved call.
    """
    from .propagate import witness_paths

    inner = p.nodes.where("snap = 'all' and lattice = 'c' and declared and not boundary").select("snap", "lattice", "sym")
    open_ = p.state.where((F.col("token") == UNKNOWN) & (F.col("lattice") == "c")).join(inner, ["snap", "lattice", "sym"], "left_semi")
    paths = witness_paths(p.witnesses().where((F.col("snap") == "all") & (F.col("lattice") == "c") & (F.col("token") == UNKNOWN)), open_)
    last = paths.groupBy(*TOKEN).agg(F.max_by("hop", "hop_ix").alias("hop"))
    boundary = p.fn.where("snap = 'all' and bnd_kind = 'declared'").select(F.col("sym").alias("hop"), F.lit(True).alias("at_boundary"))
    own = p.calls.where("snap = 'all'").groupBy("sym").agg(F.bool_or(leaves_unknown()).alias("blocked"), F.bool_or("cap_target_unknown").alias("dynamic"))
    rows = open_.join(last, TOKEN, "left").join(boundary, "hop", "left").join(own, "sym", "left")
    cause = F.when(F.col("at_boundary"), "boundary").when(~F.coalesce("blocked", F.lit(False)) & F.coalesce("dynamic", F.lit(False)), "dynamic-target").otherwise("unresolved")
    return rows.select("sym", cause.alias("cause"))


def proposals(p: Propagation) -> DataFrame:
    """R18: the exact effects of functions that declare nothing, are known and can hold a contract."""
    free = p.fn.where("snap = 'all' and eff_kind = 'none' and bnd_kind <> 'declared' and not undeclarable")
    known = free.join(p.state.where((F.col("token") == UNKNOWN) & (F.col("lattice") == "e") & (F.col("snap") == "all")).select("sym"), "sym", "left_anti")
    held = p.state.where("snap = 'all' and lattice = 'e'").groupBy("sym").agg(F.array_sort(F.collect_list(F.struct(effect_rank("token").alias("r"), "token"))).alias("x"))
    text = F.coalesce(F.array_join(F.transform("x", lambda e: e["token"]), ", "), F.lit("pure"))
    return known.join(held, "sym", "left").select("sym", F.concat(F.lit("@effects "), text).alias("subject"))


def blocked(p: Propagation) -> DataFrame:
    """R19: undeclared functions that are unknown through calls of their own, and how many."""
    free = p.fn.where("snap = 'all' and eff_kind = 'none' and bnd_kind <> 'declared'").select("sym")
    unknown = p.state.where((F.col("token") == UNKNOWN) & (F.col("lattice") == "e") & (F.col("snap") == "all")).select("sym")
    own = p.calls.where("snap = 'all'").where(leaves_unknown()).groupBy("sym").agg(F.count("*").alias("n"))
    return free.join(unknown, "sym", "left_semi").join(own, "sym").select("sym", "n")


def report(p: Propagation) -> DataFrame:
    """All findings of a check in one frame (rule, sym, subject), one scan of the functions."""
    fn = p.fn.where("snap = 'all'")
    declared = "bnd_kind <> 'declared' and eff_kind = 'declared'"
    unknown = p.state.where((F.col("token") == UNKNOWN) & (F.col("snap") == "all"))
    open_effects = fn.where(declared).join(unknown.where("lattice = 'e'").select("sym"), "sym", "left_semi")
    parts = [
        excess_effects(p).select(F.lit("AMB-E001").alias("rule"), "sym", "subject"),
        finding(fn.where("eff_kind = 'invalid'"), "AMB-E002"),
        finding(open_effects, "AMB-W001"),
        finding(fn.where("cap_kind = 'invalid'"), "AMB-E004"),
        finding(inherited_excess(p), "AMB-E005", F.col("token")),
        finding(literal_excess(p), "AMB-E009", F.concat_ws("@", "token", F.col("call_ord").cast("string"))),
        finding(unknown_cause(p), "AMB-W003", F.col("cause")),
        finding(fn.where("bnd_kind = 'invalid'"), "AMB-E006"),
        finding(fn.where("bnd_kind = 'declared' and eff_kind = 'none'"), "AMB-E007"),
        finding(fn.where("bud_kind = 'invalid'"), "AMB-E008"),
        finding(fn.where("entrypoint and cap_kind = 'none'"), "AMB-W002"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_severity(findings: DataFrame, strict_files=None) -> DataFrame:
    """Severity by the rule's letter; strict files turn exactly the STRICT rules into errors."""
    letter = F.substring("rule", 5, 1)
    base = F.when(letter == "E", "error").when(letter == "W", "warning").otherwise("info")
    strict = strict_files if strict_files is not None else F.lit(False)
    return findings.withColumn("severity", F.when(F.col("rule").isin(*STRICT) & strict, "error").otherwise(base))


def exit_codes(findings: DataFrame) -> DataFrame:
    """(rule, n, exit_code) of each rule and of ``all``: 1 where an error is among the findings."""
    code = F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).cast("int").alias("exit_code")
    n = F.count("*").alias("n")
    return findings.groupBy("rule").agg(n, code).unionByName(findings.agg(n, code).withColumn("rule", F.lit("all")))


def ranked(findings: DataFrame, fn: DataFrame) -> DataFrame:
    """T01: canonical order of the whole report by file, line, rule, symbol and subject, as a rank.

    The rows are sorted by ranges; a row's rank is its place in its partition after the rows of the
    partitions before, whose counts are all that the driver learns.
    """
    order = ["file", "line", "rule", "sym", "subject"]
    placed = findings.join(fn.where("snap = 'all'").select("sym", "file", "line"), "sym")
    placed = checkpointed(placed.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    numbered = placed.withColumn("part", F.shiftright(at, 33).cast("int")).withColumn("place", at.bitwiseAND(F.lit((1 << 33) - 1)))
    before, offsets = 0, []
    for r in numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["n"]
    start = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    return numbered.withColumn("rank", (start + F.col("place") + 1).cast("long")).drop("part", "place")
