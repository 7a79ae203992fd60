"""What every function may do, transitively.

Two lattices over one call graph: effects (``e``) and required capabilities (``c``); ``?`` stands for
unknown in either.  All tables carry ``snap``, so several snapshots run in one job.  A callee with
a valid declaration contributes that and nothing else; a boundary is pinned to its declaration, and
is unknown where it has none.  The result is the least fixed point.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EFFECTS
from ..plans.lineage import checkpointed, closure, fixed_point, trim
from ..sources.facts import Facts

UNKNOWN = "?"
#: The statements here are few and large: the driver is trimmed after each that leaves its heap past a fourth of its limit.
SHARE = 4
TOKEN = ["snap", "lattice", "sym", "token"]


def leaves_unknown() -> Column:
    return (F.col("kind") == "unresolved") | F.coalesce((F.col("kind") == "mutation") & F.col("unknown_callback"), F.lit(False))


SNAPSHOTS = ("all", "base", "head")


def in_snapshot(snap: str, fn: DataFrame) -> DataFrame:
    """The functions of a snapshot: base and head lack different ones."""
    rest = {"all": F.lit(True), "base": F.col("id") % 20 != 0, "head": F.col("id") % 20 != 1}[snap]
    return fn.where(rest).withColumn("snap", F.lit(snap))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Columns of a call that decide what it gives or brings.
READ = ("kind", "callee", "effect", "req_cap", "cap_target_unknown", "escaping", "unknown_callback")


def direct_tokens(calls: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(snap, lattice, sym, token) that a function's own calls give; ``llm`` implies ``network``."""
    token = lambda lattice, name, when: F.when(when, F.struct(F.lit(lattice).alias("lattice"), name.alias("token")))
    stub, effect = F.col("kind") == "stub", F.col("effect")
    parts = F.array(
        token("e", effect, stub),
        token("e", F.lit("network"), stub & (effect == "llm")),
        token("e", F.lit("state_write"), (F.col("kind") == "mutation") & F.col("escaping")),
        token("e", F.lit(UNKNOWN), leaves_unknown()),
        token("c", F.lit(UNKNOWN), leaves_unknown() | F.col("cap_target_unknown")),
        token("c", F.col("req_cap"), F.col("req_cap").isNotNull()),
    )
    return calls.select("snap", "sym", *extra, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("t")).select("snap", "t.lattice", "sym", *extra, "t.token").distinct()


def declared_tokens(facts: Facts) -> DataFrame:
    """(lattice, sym, token) of valid declarations."""
    effects = facts.declared_effects.select(F.lit("e").alias("lattice"), "sym", "token")
    caps = facts.declared_caps.select(F.lit("c").alias("lattice"), "sym", F.concat_ws(":", "resource", "action", "target").alias("token"))
    return effects.unionByName(caps)


def nodes(fn: DataFrame) -> DataFrame:
    """(snap, lattice, sym, declared, boundary), one row for each lattice."""
    kinds = F.array(F.struct(F.lit("e").alias("lattice"), F.col("eff_kind").alias("kind")), F.struct(F.lit("c").alias("lattice"), F.col("cap_kind").alias("kind")))
    return fn.select("snap", "sym", (F.col("bnd_kind") == "declared").alias("boundary"), F.explode(kinds).alias("k")).select("snap", "k.lattice", "sym", (F.col("k.kind") == "declared").alias("declared"), "boundary")


#: Effects travel as one mask a function; the last bit is unknown.
_BITS = (*EFFECTS, UNKNOWN)


def masked(tokens: DataFrame) -> DataFrame:
    """Tokens (snap, lattice, sym, token) as (snap, lattice, grp, node, mask).

    The effects of a function are one row, grp empty; every other token is a row with one bit.
    """
    bits = F.create_map(*[F.lit(x) for i, e in enumerate(_BITS) for x in (e, 1 << i)])
    bit = F.when(F.col("lattice") == "e", bits[F.col("token")])
    return tokens.select("snap", "lattice", F.when(bit.isNotNull(), F.lit("")).otherwise(F.col("token")).alias("grp"), F.col("sym").alias("node"), F.coalesce(bit, F.lit(1)).cast("long").alias("mask"))


def unmasked(rows: DataFrame) -> DataFrame:
    names = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(e)) for i, e in enumerate(_BITS)])
    tokens = F.when(F.col("grp") == "", F.filter(names, lambda t: t.isNotNull())).otherwise(F.array("grp"))
    return rows.select("snap", "lattice", F.col("node").alias("sym"), F.explode(tokens).alias("token"))


class Program:
    """The facts of a program; call sites are classified once and kept, snapshots share them."""

    def __init__(self, facts: Facts):
        self.facts, self._at = facts, {}

    @cached_property
    def calls(self) -> DataFrame:
        trim(self.facts.spark, SHARE)  # what queries before left in the driver would stay until the first checkpoint is over
        return checkpointed(self.facts.calls, SHARE)

    def at(self, *snaps: str) -> Propagation:
        if snaps not in self._at:
            self._at[snaps] = Propagation(self, snaps)
        return self._at[snaps]


class Propagation:
    """Direct tokens, state, contributions and witnesses of some snapshots, each made when asked for."""

    def __init__(self, program: Program, snaps: tuple[str, ...]):
        self.program, self.facts, self.snaps = program, program.facts, snaps
        #: Rows of ``diff.authority_changes`` once they were made.
        self.changes: DataFrame | None = None

    @cached_property
    def fn(self) -> DataFrame:
        return _union([in_snapshot(s, self.facts.fn) for s in self.snaps])

    @cached_property
    def calls(self) -> DataFrame:
        parts = []
        for snap in self.snaps:
            own = self.program.calls.withColumn("snap", F.lit(snap))
            if snap != "all":
                own = own.join(in_snapshot(snap, self.facts.fn).select("sym"), "sym", "left_semi")
            parts.append(own.where(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp")) if snap == "base" else own)
        return _union(parts)

    @cached_property
    def nodes(self) -> DataFrame:
        return nodes(self.fn)

    @cached_property
    def declared(self) -> DataFrame:
        """Kept: the state and the contributions read it three times."""
        return checkpointed(self.nodes.where("declared").join(declared_tokens(self.facts), ["lattice", "sym"]).select(*TOKEN), SHARE)

    @cached_property
    def direct(self) -> DataFrame:
        return direct_tokens(self.calls)

    @cached_property
    def edges(self) -> DataFrame:
        inner = self.nodes.where("not boundary").select("snap", "lattice", F.col("sym").alias("caller"))
        resolved = self.calls.where("kind = 'resolved'").select("snap", F.col("sym").alias("caller"), "callee").distinct()
        return resolved.join(inner, ["snap", "caller"])

    @cached_property
    def state(self) -> DataFrame:
        pinned = self.nodes.where("boundary").join(self.declared, ["snap", "lattice", "sym"], "left").where("declared = (token is not null)")
        pinned = pinned.select("snap", "lattice", "sym", F.when(F.col("declared"), F.col("token")).otherwise(UNKNOWN).alias("token"))
        own = self.direct.join(self.nodes.where("not boundary"), ["snap", "lattice", "sym"]).select(*TOKEN)
        edges = checkpointed(self.edges, SHARE)
        trusted = edges.join(self.declared.withColumnRenamed("sym", "callee"), ["snap", "lattice", "callee"]).select("snap", "lattice", F.col("caller").alias("sym"), "token")
        open_ = self.nodes.where("not declared").select("snap", "lattice", F.col("sym").alias("callee"))
        moving = edges.join(open_, ["snap", "lattice", "callee"]).select("snap", "lattice", F.col("callee").alias("src"), F.col("caller").alias("dst"))
        return unmasked(fixed_point(masked(pinned.unionByName(own).unionByName(trusted)), moving, ["snap", "lattice", "grp"]))

    @cached_property
    def contribution(self) -> DataFrame:
        undeclared = self.state.join(self.nodes.where("not declared"), ["snap", "lattice", "sym"], "left_semi")
        return checkpointed(undeclared.unionByName(self.declared), SHARE)

    def inherited(self, *extra: str) -> DataFrame:
        """(snap, lattice, sym, extra.., token, call_ord, callee): what each resolved call brings."""
        calls = self.calls.where("kind = 'resolved'").select("snap", "sym", "callee", "call_ord", *extra)
        inner = self.nodes.where("not boundary").select("snap", "lattice", "sym")
        got = self.contribution.withColumnRenamed("sym", "callee")
        return calls.join(inner, ["snap", "sym"]).join(got, ["snap", "lattice", "callee"])

    def witnesses(self) -> DataFrame:
        """(snap, lattice, sym, token, callee): the first call, in source order, that brings a token.

        Effects that are direct, and unknown where it is direct, have none; capabilities do.
        """
        first = self.inherited().groupBy(*TOKEN).agg(F.min_by("callee", "call_ord").alias("callee"))
        hidden = self.direct.where((F.col("lattice") == "e") | (F.col("token") == UNKNOWN))
        return first.join(hidden, TOKEN, "left_anti")

    def bodies(self) -> DataFrame:
        """(snap, lattice, sym, body_ix, token) of undeclared functions with two bodies or more.

        Their calls are picked and kept before they meet any contribution; such a function has no
        boundary, so that all its calls bring what their callees hold.
        """
        several = self.calls.groupBy("snap", "sym").agg(F.min("body_ix").alias("low"), F.max("body_ix").alias("high")).where("low <> high").select("snap", "sym")
        free = self.nodes.where("not declared and not boundary").groupBy("snap", "sym").count().where("count = 2").select("snap", "sym")
        calls = checkpointed(self.calls.select("snap", "sym", "body_ix", *READ).join(several.join(free, ["snap", "sym"]), ["snap", "sym"], "left_semi"), SHARE)
        brought = calls.where("kind = 'resolved'").select("snap", "sym", "body_ix", "callee").distinct().join(self.contribution.withColumnRenamed("sym", "callee"), ["snap", "callee"])
        return direct_tokens(calls, ("body_ix",)).unionByName(brought.select("snap", "lattice", "sym", "body_ix", "token")).distinct()

    @cached_property
    def split(self) -> DataFrame:
        """The rows of ``bodies``, kept: comparisons read them several times."""
        return checkpointed(self.bodies(), SHARE)


def witness_paths(witnesses: DataFrame, starts: DataFrame) -> DataFrame:
    """(start columns.., hop_ix, hop): each start followed along its witnesses, no node twice.

    A node has one witness for a token, so what a start reaches in round n is its nth hop.
    """
    step = witnesses.select("snap", "lattice", "token", F.col("sym").alias("src"), F.col("callee").alias("dst"))
    seeds = starts.select(*TOKEN, F.col("sym").alias("node"))
    return closure(seeds, step, TOKEN, born=True).where("born > 0").select(*TOKEN, F.col("node").alias("hop"), F.col("born").alias("hop_ix"))


def excess_capabilities(required: DataFrame, granted: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows (keys.., token) that no grant (keys.., token) of the same keys covers."""
    from ..functions.scalars import capability_parts, glob_matches

    split = lambda df, p: df.withColumn(p, capability_parts(F.col("token")))
    need = split(required, "n").select(*required.columns, F.col("n.resource").alias("resource"), F.col("n.action").alias("action"), F.col("n.target").alias("need_target"))
    give = split(granted, "g").select(*keys, F.col("g.resource").alias("resource"), F.col("g.action").alias("action"), F.col("g.target").alias("target"))
    on = [need[c] == give[c] for c in [*keys, "resource", "action"]] + [glob_matches(give["target"], need["need_target"])]
    return need.join(give, on, "left_anti").select(*required.columns)


def excess(p: Propagation) -> DataFrame:
    """(snap, lattice, sym, token): held or required beyond a valid declaration; unknown never counts."""
    inner = p.nodes.where("declared and not boundary").select("snap", "lattice", "sym")
    held = p.state.where(F.col("token") != UNKNOWN).join(inner, ["snap", "lattice", "sym"], "left_semi")
    effects = held.where("lattice = 'e'").join(p.declared, TOKEN, "left_anti")
    caps = excess_capabilities(held.where("lattice = 'c'"), p.declared.where("lattice = 'c'"), ["snap", "lattice", "sym"])
    return effects.unionByName(caps)


def records(p: Propagation) -> DataFrame:
    """One row for each function: effective authority as sorted texts, unknown flags, kinds."""
    rank = F.create_map(*[F.lit(x) for i, e in enumerate(EFFECTS) for x in (e, i)])
    known = F.col("token") != UNKNOWN
    held = p.contribution.groupBy("snap", "sym").agg(
        F.array_sort(F.collect_list(F.when(known & (F.col("lattice") == "e"), F.struct(rank[F.col("token")].alias("r"), F.col("token").alias("t"))))).alias("effects"),
        F.array_sort(F.collect_list(F.when(known & (F.col("lattice") == "c"), F.col("token")))).alias("capabilities"),
    )
    flags = p.state.where(F.col("token") == UNKNOWN).groupBy("snap", "sym").agg(F.bool_or(F.col("lattice") == "e").alias("eff_unknown"), F.bool_or(F.col("lattice") == "c").alias("cap_unknown"))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return (
        p.fn.join(held, ["snap", "sym"], "left").join(flags, ["snap", "sym"], "left")
        .select("snap", "sym", "eff_kind", "cap_kind", "entrypoint", text(F.transform("effects", lambda x: x["t"])).alias("effects"), text(F.col("capabilities")).alias("capabilities"),
                F.coalesce("eff_unknown", F.lit(False)).alias("eff_unknown"), F.coalesce("cap_unknown", F.lit(False)).alias("cap_unknown"))
    )


def unresolved_operations(p: Propagation) -> DataFrame:
    """(snap, sym, reason, operation, n): a multiset without positions; none below a boundary."""
    inner = p.fn.where("bnd_kind <> 'declared'").select("snap", "sym")
    reason = F.when(F.col("kind") == "mutation", "callback-by-reference").otherwise(F.col("reason"))
    return p.calls.where(leaves_unknown()).join(inner, ["snap", "sym"], "left_semi").groupBy("snap", "sym", reason.alias("reason"), "operation").agg(F.count("*").alias("n"))
