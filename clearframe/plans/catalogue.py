"""Every query with its DuckDB statement, under the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import requirements as Q
from ..functions.fixed import BUILTIN_STUBS, CONSTRUCTORS, EFFECTS, FS_RULES, HTTP, NULLARY_CONSTRUCTORS, PREFIXABLE, SQL_METHODS, SQL_READ, SQL_WRITE, client_rows, stub_rows
from ..operators import audit, contracts, coverage, diff, incremental, rules, tags, workload
from ..operators import propagate as P

from ..sources.facts import Facts
from .oracle import glob, statement

_MEMO: dict[tuple, P.Program] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Files of the fact tables with their lengths and times."""
    out, jvm = [], spark._jvm
    for name in ("lineitem", "part", "pages", "orders"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            files = fs.listFiles(path, True)
            while files.hasNext():
                f = files.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def program(spark: SparkSession, sf_dir: str) -> P.Program:
    """The program in a folder; kept for the session as long as its files stay the same."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = P.Program(Facts(spark, sf_dir))
    return _MEMO[key]


#: Snapshots of a comparison.
BOTH = ("base", "head")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def over_facts(key: str, sql: str | None):
    def take(build: Callable[[Facts], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(Facts(spark, sf_dir))
        if sql:
            ORACLES[key] = statement(sql)

    return take


def over_state(key: str, sql: str | None, snaps: tuple[str, ...] = ("all",)):
    """Registers a query over the propagation of the snapshots it reads."""

    def take(build: Callable[[P.Propagation], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(program(spark, sf_dir).at(*snaps))
        if sql:
            ORACLES[key] = statement(sql)

    return take


def _values(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _text(column: str):
    return F.coalesce(F.col(column), F.lit("")).alias(column)


# --- projections and predicates -------------------------------------------------------------

over_facts("p01_known_effect", f"SELECT event_type, event_type IN {_in(EFFECTS)} OR event_type || '' = 'env' AS known, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda f: f.events.groupBy("event_type", F.col("event_type").isin(*EFFECTS).alias("known")).agg(F.count("*").alias("n"))
)
over_state("p02_leaves_unknown", "SELECT kind, blocks AS leaves_unknown, count(*) AS n FROM scalls WHERE snap = 'all' GROUP BY ALL")(
    lambda p: p.calls.where("snap = 'all'").groupBy("kind", P.leaves_unknown().alias("leaves_unknown")).agg(F.count("*").alias("n"))
)
over_state("p03_blocking_reason", "SELECT reason, sum(n)::BIGINT AS n FROM ops WHERE snap = 'all' GROUP BY 1")(
    lambda p: P.unresolved_operations(p).where("snap = 'all'").groupBy("reason").agg(F.sum("n").alias("n"))
)
over_state("p04_effective_authority", "SELECT snap, lattice, sym, token FROM contribution WHERE token <> '?' AND snap = 'all'")(
    lambda p: p.contribution.where("token <> '?' and snap = 'all'").select("snap", "lattice", "sym", "token")
)
over_state("p05_holds_authority", "SELECT f.sym, EXISTS (SELECT 1 FROM contribution k WHERE k.snap = 'all' AND k.sym = f.sym AND k.token <> '?') AS holds FROM snapfn f WHERE f.snap = 'all'")(
    lambda p: p.fn.where("snap = 'all'").select("sym").join(p.contribution.where("snap = 'all' and token <> '?'").select("sym", F.lit(True).alias("h")).distinct(), "sym", "left").select("sym", F.coalesce("h", F.lit(False)).alias("holds"))
)
over_state("p06_body_view", "SELECT sym, body_ix::INTEGER AS body_ix, lattice, token FROM holdings WHERE snap = 'head'", ("head",))(
    lambda p: diff.holdings(p).where("snap = 'head'").select("sym", F.col("body_ix").cast("int").alias("body_ix"), "lattice", "token")
)
_RECORDS = """SELECT f.sym, f.eff_kind, f.cap_kind, f.entrypoint,
  coalesce((SELECT string_agg(k.token, ',' ORDER BY e.ord) FROM contribution k JOIN effects e ON e.token = k.token WHERE k.snap = 'all' AND k.lattice = 'e' AND k.sym = f.sym), '') AS effects,
  coalesce((SELECT string_agg(k.token, ',' ORDER BY k.token) FROM contribution k WHERE k.snap = 'all' AND k.lattice = 'c' AND k.sym = f.sym AND k.token <> '?'), '') AS capabilities,
  coalesce(g.eff_unknown, false) AS eff_unknown, coalesce(g.cap_unknown, false) AS cap_unknown
FROM snapfn f LEFT JOIN flags g ON g.snap = 'all' AND g.sym = f.sym WHERE f.snap = 'all'"""
over_state("p07_authority_records", _RECORDS)(lambda p: P.records(p).where("snap = 'all'").drop("snap"))
over_state("p08_diff_views", "SELECT status, change, count(DISTINCT sym) AS symbols, count(*) AS refs FROM changes GROUP BY ALL", BOTH)(
    lambda p: diff.authority_changes(p).groupBy("status", "change").agg(F.countDistinct("sym").alias("symbols"), F.count("*").alias("refs"))
)
over_state("p09_diff_verdict", "SELECT coalesce(bool_or(change = 'added'), false) AS increase, (SELECT count(*) > 0 FROM ops) AS any_unresolved FROM changes", P.SNAPSHOTS)(
    lambda p: diff.authority_changes(p).agg(F.coalesce(F.bool_or(F.col("change") == "added"), F.lit(False)).alias("increase")).crossJoin(P.unresolved_operations(p).agg((F.count("*") > 0).alias("any_unresolved")))
)
_STRICT_GLOB = "lib/1*.ts"
_W001 = "SELECT f.sym, f.file FROM snapfn f WHERE f.snap = 'all' AND f.bnd_kind <> 'declared' AND f.eff_kind = 'declared' AND EXISTS (SELECT 1 FROM state s WHERE s.snap = 'all' AND s.lattice = 'e' AND s.sym = f.sym AND s.token = '?')"
over_state("p10_strict_promotion", f"SELECT sym, CASE WHEN regexp_matches(file, '^lib/1[^/]*\\.ts$') THEN 'error' ELSE 'warning' END AS severity FROM ({_W001})")(
    lambda p: rules.with_severity(
        p.fn.where("snap = 'all' and bnd_kind <> 'declared' and eff_kind = 'declared'").join(p.state.where("snap = 'all' and lattice = 'e' and token = '?'").select("sym"), "sym", "left_semi").select(F.lit("AMB-W001").alias("rule"), "sym", "file"),
        F.col("file").rlike(S.path_glob_regex(_STRICT_GLOB)),
    ).select("sym", "severity")
)
over_state("p11_comparable", "SELECT in_base AND in_head AS comparable, count(*) AS n FROM presence GROUP BY 1", BOTH)(
    lambda p: p.fn.where("snap <> 'all'").groupBy("sym").agg((F.count("*") == 2).alias("comparable")).groupBy("comparable").agg(F.count("*").alias("n"))
)

# --- joins ----------------------------------------------------------------------------------

over_state("j01_call_callee", "SELECT c.sym, c.call_ord, c.callee, f.eff_kind FROM scalls c JOIN snapfn f ON f.snap = c.snap AND f.sym = c.callee WHERE c.snap = 'all' AND c.kind = 'resolved'")(
    lambda p: p.calls.where("snap = 'all' and kind = 'resolved'").select("sym", "call_ord", "callee").join(p.fn.where("snap = 'all'").select(F.col("sym").alias("callee"), "eff_kind"), "callee").select("sym", "call_ord", "callee", "eff_kind")
)
over_state("j03_full_outer_records", "SELECT coalesce(b.sym, h.sym) AS sym, b.sym IS NOT NULL AS in_base, h.sym IS NOT NULL AS in_head FROM (SELECT sym FROM snapfn WHERE snap = 'base') b FULL JOIN (SELECT sym FROM snapfn WHERE snap = 'head') h ON b.sym = h.sym", BOTH)(
    lambda p: p.fn.where("snap = 'base'").select("sym", F.lit(True).alias("b")).join(p.fn.where("snap = 'head'").select("sym", F.lit(True).alias("h")), "sym", "full_outer").select("sym", F.col("b").isNotNull().alias("in_base"), F.col("h").isNotNull().alias("in_head"))
)


def _renamed(p: P.Propagation) -> DataFrame:
    """Base ids under new file names; an id that would collide with another base id is dropped."""
    base = p.fn.where("snap = 'base'").select("sym", "file")
    renames = base.select("file").distinct().where("file like 'lib/2%'").withColumn("to", F.replace(F.col("file"), F.lit("lib/2"), F.lit("lib/1")))
    moved = base.join(F.broadcast(renames), "file").select(F.col("sym").alias("old"), F.concat("to", F.lit("#"), F.substring_index("sym", "#", -1)).alias("sym"))
    return moved.join(base.select("sym"), "sym", "left_anti").select("old", "sym")


over_state("j04_renamed_symbols", "SELECT sym AS old, replace(file, 'lib/2', 'lib/1') || '#' || split_part(sym, '#', 2) AS sym FROM snapfn f WHERE snap = 'base' AND file LIKE 'lib/2%' AND NOT EXISTS (SELECT 1 FROM snapfn g WHERE g.snap = 'base' AND g.sym = replace(f.file, 'lib/2', 'lib/1') || '#' || split_part(f.sym, '#', 2))", ("base",))(_renamed)
over_state("j05_capability_excess", "SELECT sym, token FROM excess WHERE snap = 'all' AND lattice = 'c'")(lambda p: P.excess(p).where("snap = 'all' and lattice = 'c'").select("sym", "token"))
over_facts("j07_strict_files", "SELECT sym FROM fn WHERE regexp_matches(file, '^lib/(?:.*/)?[^/]*4\\.ts$')")(lambda f: f.fn.where(F.col("file").rlike(S.path_glob_regex("lib/**/*4.ts"))).select("sym"))
over_facts("j08_unmatched_config", "SELECT 'lib/' || CAST(p_size AS VARCHAR) || '.ts#f' || CAST(p_partkey AS VARCHAR) AS key FROM part WHERE NOT EXISTS (SELECT 1 FROM fn WHERE sym = 'lib/' || CAST(p_size AS VARCHAR) || '.ts#f' || CAST(p_partkey AS VARCHAR))")(
    lambda f: f.part.select(F.format_string("lib/%s.ts#f%s", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("key")).join(f.fn.select(F.col("sym").alias("key")), "key", "left_anti")
)
over_state("j09_ledger_match", "SELECT coalesce(i.sym, f.sym) AS symbol, coalesce(i.kind, f.kind) AS kind, coalesce(i.name, f.name) AS name, CASE WHEN i.sym IS NULL THEN 'unused' WHEN f.line IS NULL THEN 'unapproved' ELSE 'approved' END AS status, coalesce(f.line, -1) AS line FROM (SELECT *, row_number() OVER (PARTITION BY sym, kind, name) AS slot FROM increase) i FULL JOIN force f ON f.sym = i.sym AND f.kind = i.kind AND f.name = i.name AND f.slot = i.slot", BOTH)(
    lambda p: diff.review(diff.increases(p), diff.ledger_rows(p.facts)).withColumn("line", F.coalesce("line", F.lit(-1)))
)
over_state("j13_direct_callers", "SELECT callee AS sym, count(DISTINCT sym) AS callers FROM scalls WHERE snap = 'all' AND kind = 'resolved' GROUP BY 1")(
    lambda p: p.calls.where("snap = 'all' and kind = 'resolved'").groupBy(F.col("callee").alias("sym")).agg(F.countDistinct("sym").alias("callers")).select("sym", "callers")
)
over_state("j14_parity", "SELECT coalesce(b.sym, h.sym) AS sym, coalesce(b.call_ord, h.call_ord) AS call_ord, CASE WHEN b.sym IS NULL THEN 'head-only' WHEN h.sym IS NULL THEN 'base-only' WHEN b.kind = h.kind AND b.callee IS NOT DISTINCT FROM h.callee THEN 'agreed' ELSE 'disagreed' END AS parity FROM (SELECT * FROM scalls WHERE snap = 'base') b FULL JOIN (SELECT * FROM scalls WHERE snap = 'head') h ON b.sym = h.sym AND b.call_ord = h.call_ord", BOTH)(
    lambda p: _parity(p)
)


def _parity(p: P.Propagation) -> DataFrame:
    side = lambda s, t: p.calls.where(F.col("snap") == s).select("sym", "call_ord", F.struct("kind", "callee").alias(t))
    both = side("base", "b").join(side("head", "h"), ["sym", "call_ord"], "full_outer")
    verdict = F.when(F.col("b").isNull(), "head-only").when(F.col("h").isNull(), "base-only").when(F.col("b").eqNullSafe(F.col("h")), "agreed").otherwise("disagreed")
    return both.select("sym", "call_ord", verdict.alias("parity"))



# --- aggregates -----------------------------------------------------------------------------

over_state("a01_direct_effects", "SELECT sym, token FROM direct WHERE snap = 'all' AND lattice = 'e'")(lambda p: p.direct.where("snap = 'all' and lattice = 'e'").select("sym", "token"))
over_state("a02_direct_capabilities", "SELECT sym, token FROM direct WHERE snap = 'all' AND lattice = 'c'")(lambda p: p.direct.where("snap = 'all' and lattice = 'c'").select("sym", "token"))
over_state("a03_unresolved_operations", "SELECT sym, reason, coalesce(operation, '') AS operation, n FROM ops WHERE snap = 'all'")(lambda p: P.unresolved_operations(p).where("snap = 'all'").select("sym", "reason", _text("operation"), "n"))
_COVERAGE = """SELECT count(*) AS functions, count(*) FILTER (WHERE eff_kind = 'declared') AS declared, count(*) FILTER (WHERE eff_kind = 'declared' AND NOT by_config) AS by_jsdoc,
  count(*) FILTER (WHERE eff_kind = 'declared' AND by_config) AS by_config, count(*) FILTER (WHERE bnd_kind = 'declared') AS boundary, count(*) FILTER (WHERE entrypoint) AS entrypoints,
  count(*) FILTER (WHERE entrypoint AND cap_kind <> 'declared') AS entrypoints_without_caps, count(*) FILTER (WHERE u) AS unknown,
  round(count(*) FILTER (WHERE u) / count(*), 6) AS unknown_rate, round(count(*) FILTER (WHERE bnd_kind = 'declared') / count(*), 6) AS boundary_rate
FROM (SELECT f.*, EXISTS (SELECT 1 FROM state s WHERE s.snap = 'all' AND s.lattice = 'e' AND s.token = '?' AND s.sym = f.sym) AS u FROM snapfn f WHERE f.snap = 'all')"""
over_state("a04_coverage_scalars", _COVERAGE)(coverage.scalars)
over_state("a05_coverage_rates", f"SELECT unknown_rate, boundary_rate FROM ({_COVERAGE})")(lambda p: coverage.scalars(p).select("unknown_rate", "boundary_rate"))
_COUNTED = "FROM scalls c JOIN snapfn f ON f.snap = c.snap AND f.sym = c.sym WHERE c.snap = 'all' AND f.bnd_kind <> 'declared'"
over_state("a06_callsites_by_kind", f"SELECT c.kind, count(*) AS n {_COUNTED} GROUP BY 1")(coverage.by_kind)
over_state("a07_unresolved_by_reason", f"SELECT c.reason, count(*) AS n {_COUNTED} AND c.kind = 'unresolved' GROUP BY 1")(coverage.by_reason)
over_facts("a08_skipped_by_kind", "SELECT event_type AS kind, sum(user_id)::BIGINT AS n FROM events GROUP BY 1")(lambda f: f.events.groupBy(F.col("event_type").alias("kind")).agg(F.sum("user_id").alias("n")))
over_state("a09_bodies_holding", "SELECT sym, lattice, token, base, head FROM counts WHERE base <> head", BOTH)(
    lambda p: diff.holders(diff.holdings(p).where("snap <> 'all'"), p.contribution.where("token <> '?' and snap <> 'all'").select("sym", "lattice", "token").distinct()).where("base <> head").select("sym", "lattice", "token", "base", "head")
)
over_state("a10_unknown_bodies", "SELECT snap, sym, count(DISTINCT body_ix) AS n FROM holdings WHERE token = '?' AND snap <> 'all' GROUP BY ALL", BOTH)(
    lambda p: diff.holdings(p).where("token = '?' and snap <> 'all'").groupBy("snap", "sym").agg(F.countDistinct("body_ix").alias("n"))
)
over_state("a11_callers_affected", "SELECT e.sym, count(DISTINCT c.sym) AS callers FROM (SELECT DISTINCT sym FROM excess WHERE snap = 'all' AND lattice = 'e') e JOIN scalls c ON c.snap = 'all' AND c.callee = e.sym GROUP BY 1")(
    lambda p: P.excess(p).where("snap = 'all' and lattice = 'e'").select("sym").distinct().join(p.calls.where("snap = 'all'").select(F.col("callee").alias("sym"), F.col("sym").alias("caller")), "sym").groupBy("sym").agg(F.countDistinct("caller").alias("callers"))
)
over_state("a12_parity_counts", "SELECT parity, count(*) AS n FROM (SELECT CASE WHEN b.sym IS NULL THEN 'head-only' WHEN h.sym IS NULL THEN 'base-only' WHEN b.kind = h.kind AND b.callee IS NOT DISTINCT FROM h.callee THEN 'agreed' ELSE 'disagreed' END AS parity FROM (SELECT * FROM scalls WHERE snap = 'base') b FULL JOIN (SELECT * FROM scalls WHERE snap = 'head') h ON b.sym = h.sym AND b.call_ord = h.call_ord) GROUP BY 1", BOTH)(
    lambda p: _parity(p).groupBy("parity").agg(F.count("*").alias("n"))
)
over_facts("a14_median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")(lambda f: f.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median")))
over_facts("a15_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1")(
    lambda f: f.events.groupBy("event_type").agg(F.percentile("value", [0.25, 0.75]).alias("q"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")).select("event_type", F.round(F.col("q")[0], 6).alias("p25"), F.round(F.col("q")[1], 6).alias("p75"), "low", "high")
)
over_facts("a16_nearest_rank", "SELECT event_type, quantile_disc(event_id, 0.9) AS p90 FROM events GROUP BY 1")(lambda f: f.events.groupBy("event_type").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY event_id)").cast("long").alias("p90")))
_SHAPES = "SELECT shape, count(*) AS n, round(sum(cost), 4) AS cost FROM (SELECT stream, batch, string_agg(DISTINCT file, '+' ORDER BY file) AS shape, sum(cost) AS cost FROM batch_rows GROUP BY ALL) GROUP BY 1"
_BATCH = "(SELECT * FROM (SELECT *, count(*) FILTER (WHERE kind = 'command') OVER (PARTITION BY stream ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS batch FROM log_events) WHERE kind = 'edit')"
over_facts("a17_top_shapes", f"SELECT shape, n FROM ({_SHAPES.replace('batch_rows', _BATCH)}) ORDER BY n DESC, shape LIMIT 3")(lambda f: workload.shapes(f.log_events).orderBy(F.desc("n"), "shape").limit(3).select("shape", "n"))
over_state("a18_rollup", "SELECT coalesce(kind, 'total') AS kind, count(*) AS n FROM (SELECT kind FROM scalls WHERE snap = 'all') GROUP BY ROLLUP (kind)")(
    lambda p: p.calls.where("snap = 'all'").rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")
)
over_facts("a19_batch_class", f"SELECT stream, batch, CASE WHEN bool_or(file = 'f0') THEN 'config' WHEN bool_or(file IN ('f1', 'f2')) THEN 'shared' WHEN count(DISTINCT file) > 1 THEN 'mixed' ELSE 'single' END AS cls FROM {_BATCH} GROUP BY ALL")(
    lambda f: workload.batches(f.log_events).groupBy("stream", "batch").agg(F.when(F.bool_or(F.col("file") == "f0"), "config").when(F.bool_or(F.col("file").isin("f1", "f2")), "shared").when(F.countDistinct("file") > 1, "mixed").otherwise("single").alias("cls"))
)
over_facts("a20_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda f: f.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"))
over_state("a21_tallies", "SELECT change, count(*) FILTER (WHERE lattice = 'e') AS effects, count(*) FILTER (WHERE lattice = 'c') AS capabilities FROM changes GROUP BY 1", BOTH)(
    lambda p: diff.authority_changes(p).groupBy("change").agg(F.count_if(F.col("lattice") == "e").alias("effects"), F.count_if(F.col("lattice") == "c").alias("capabilities"))
)
over_facts("e12_unique_symbols", "SELECT sym, count(*) AS n FROM fn GROUP BY 1 HAVING count(*) > 1")(lambda f: f.fn.groupBy("sym").agg(F.count("*").alias("n")).where("n > 1"))

# --- order ----------------------------------------------------------------------------------

over_state("w01_first_witness", "SELECT lattice, sym, token, callee FROM witness WHERE snap = 'all'")(lambda p: p.witnesses().where("snap = 'all'").select("lattice", "sym", "token", "callee"))
over_facts("w02_lines_in_force", "SELECT sym AS symbol, kind, name, line FROM force")(lambda f: diff.in_force(diff.ledger_rows(f)).select("symbol", "kind", "name", "line"))
over_facts("w04_site_ordinals", "SELECT l_partkey, l_linenumber, call_ord, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY call_ord) - 1 AS ordinal FROM line")(
    lambda f: f.line.select("l_partkey", "l_linenumber", "call_ord", (F.row_number().over(W.partitionBy("l_partkey", "l_linenumber").orderBy("call_ord")) - 1).cast("long").alias("ordinal"))
)
over_state("w06_operation_site", "SELECT sym, effect, arg_min(call_ord, call_ord) AS call_ord FROM scalls WHERE snap = 'all' AND kind = 'stub' GROUP BY ALL")(
    lambda p: p.calls.where("snap = 'all' and kind = 'stub'").groupBy("sym", "effect").agg(F.min("call_ord").alias("call_ord"))
)
over_state("w08_primary_excess", "SELECT x.sym, arg_min(x.token, e.ord) AS subject, count(*) AS n FROM excess x JOIN effects e ON e.token = x.token WHERE x.snap = 'all' AND x.lattice = 'e' GROUP BY 1")(rules.excess_effects)
over_state("w09_body_split", "SELECT snap, lattice, sym, body_ix, token FROM bodies", P.SNAPSHOTS)(lambda p: p.bodies().select("snap", "lattice", "sym", "body_ix", "token"))
over_state("t04_top_unresolved", f"SELECT c.operation AS name, count(*) AS n {_COUNTED} AND c.kind = 'unresolved' AND c.operation IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 10")(coverage.top_names)
over_state("t05_top15", f"SELECT c.operation AS name, count(*) AS n {_COUNTED} AND c.kind = 'unresolved' AND c.operation IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 15")(lambda p: coverage.top_names(p, 15))

# --- sets -----------------------------------------------------------------------------------

over_state("u02_implied_effects", "SELECT sym FROM direct WHERE snap = 'all' AND token = 'llm' INTERSECT SELECT sym FROM direct WHERE snap = 'all' AND token = 'network'")(lambda p: p.direct.where("snap = 'all' and token = 'llm'").select("sym"))
over_state("u03_effect_equality", "SELECT f.sym, coalesce((SELECT string_agg(token, ',' ORDER BY token) FROM state s WHERE s.snap = 'all' AND s.lattice = 'e' AND s.sym = f.sym), '') = coalesce((SELECT string_agg(token, ',' ORDER BY token) FROM direct s WHERE s.snap = 'all' AND s.lattice = 'e' AND s.sym = f.sym), '') AS same FROM snapfn f WHERE f.snap = 'all'")(
    lambda p: _same_sets(p)
)


def _same_sets(p: P.Propagation, lattice: str = "e") -> DataFrame:
    sets = lambda df, name: df.where((F.col("lattice") == lattice) & ((F.col("token") != P.UNKNOWN) | F.lit(lattice == "e"))).groupBy("sym").agg(F.sort_array(F.collect_set("token")).alias(name))
    joined = p.fn.select("sym").join(sets(p.state, "a"), "sym", "left").join(sets(p.direct, "b"), "sym", "left")
    return joined.select("sym", F.col("a").eqNullSafe(F.col("b")).alias("same"))


over_state("u06_capability_equality", "SELECT f.sym, coalesce((SELECT string_agg(token, ',' ORDER BY token) FROM state s WHERE s.snap = 'all' AND s.lattice = 'c' AND s.sym = f.sym AND token <> '?'), '') = coalesce((SELECT string_agg(token, ',' ORDER BY token) FROM direct s WHERE s.snap = 'all' AND s.lattice = 'c' AND s.sym = f.sym AND token <> '?'), '') AS same FROM snapfn f WHERE f.snap = 'all'")(
    lambda p: _same_sets(p, "c")
)
over_state("u10_unchanged", "SELECT r.sym, r.lattice, r.token FROM refs r JOIN presence p ON p.sym = r.sym AND p.in_base AND p.in_head WHERE r.of_head AND NOT EXISTS (SELECT 1 FROM changes c WHERE c.sym = r.sym AND c.lattice = r.lattice AND c.token = r.token AND c.change = 'added')", BOTH)(
    lambda p: diff.unchanged(p)
)
over_state("u04_excess_effects", "SELECT sym, token FROM excess WHERE snap = 'all' AND lattice = 'e'")(lambda p: P.excess(p).where("snap = 'all' and lattice = 'e'").select("sym", "token"))
over_state("u08_unresolved_gain", "SELECT h.sym, h.reason, coalesce(h.operation, '') AS operation, h.n - coalesce(b.n, 0) AS gained FROM (SELECT * FROM ops WHERE snap = 'head') h LEFT JOIN (SELECT * FROM ops WHERE snap = 'base') b ON b.sym = h.sym AND b.reason = h.reason AND b.operation IS NOT DISTINCT FROM h.operation JOIN presence p ON p.sym = h.sym AND p.in_base WHERE h.n > coalesce(b.n, 0)", BOTH)(
    lambda p: diff.unresolved_gains(p).withColumn("operation", _text("operation"))
)
_FIELDS = ("body_ix", "kind", "callee", "effect", "req_cap", "cap_target_unknown", "reason", "operation", "escaping", "unknown_callback")
_SUMMARY = f"""SELECT f.snap, f.sym, concat_ws('|', f.eff_kind, f.cap_kind, f.bud_kind, f.bnd_kind, f.entrypoint, f.by_config, coalesce(c.calls, ''), coalesce(d.tokens, '')) AS summary FROM snapfn f
LEFT JOIN (SELECT snap, sym, string_agg(concat_ws('/', {", ".join(f"coalesce({c}::VARCHAR, 'null')" for c in _FIELDS)}), ';' ORDER BY call_ord) AS calls FROM scalls GROUP BY ALL) c ON c.snap = f.snap AND c.sym = f.sym
LEFT JOIN (SELECT snap, sym, string_agg(lattice || token, ';' ORDER BY lattice, token) AS tokens FROM decl GROUP BY ALL) d ON d.snap = f.snap AND d.sym = f.sym WHERE f.snap <> 'all'"""
_SIDES = f"SELECT coalesce(b.sym, h.sym) AS sym, b.summary AS b, h.summary AS h FROM (SELECT * FROM ({_SUMMARY}) WHERE snap = 'base') b FULL JOIN (SELECT * FROM ({_SUMMARY}) WHERE snap = 'head') h ON b.sym = h.sym"
over_state("u12_changed_symbols", f"SELECT sym FROM ({_SIDES}) WHERE b IS DISTINCT FROM h", BOTH)(incremental.changed_symbols)

# --- scalars --------------------------------------------------------------------------------

_CAP_TEXT = "CASE WHEN event_id % 5 = 0 THEN ' http:get:' || event_type || ' ' WHEN event_id % 5 = 1 THEN 'db:' || event_type WHEN event_id % 5 = 2 THEN 'h*:get:x' WHEN event_id % 5 = 3 THEN 'http:get:a:b' ELSE 'http::x' END"
over_facts("f01_parse_capability", f"SELECT event_id, coalesce(regexp_extract(trim(t), '^([A-Za-z0-9_.?@/-]+):([A-Za-z0-9_.?@/-]+):([^,]+)$', 3), '') AS target FROM (SELECT event_id, {_CAP_TEXT} AS t FROM events)")(
    lambda f: f.events.select("event_id", F.expr(_CAP_TEXT).alias("t")).select("event_id", F.coalesce(S.capability_parts(F.col("t"))["target"], F.lit("")).alias("target"))
)
_GLOBS = "CASE WHEN page_id % 4 = 0 THEN '*.example.com' WHEN page_id % 4 = 1 THEN 'm.*' WHEN page_id % 4 = 2 THEN '?????*.org' ELSE host END"
over_facts("f04_glob_matches", f"SELECT page_id, {glob('g', 'host')} AS matches FROM (SELECT page_id, host, {_GLOBS} AS g FROM hosts)")(
    lambda f: f.hosts.withColumn("g", F.expr(_GLOBS)).select("page_id", S.glob_matches(F.col("g"), F.col("host")).alias("matches"))
)
over_facts("f05_path_glob", "SELECT sym, regexp_matches(file, '^(?:.*/)?2[^/]*\\.ts$') AS matches FROM fn")(lambda f: f.fn.select("sym", F.col("file").rlike(S.path_glob_regex("**/2*.ts")).alias("matches")))
_SQL_TEXT = "CASE WHEN item_id % 8 = 0 THEN 'SELECT ' WHEN item_id % 8 = 1 THEN ' ( select ' WHEN item_id % 8 = 2 THEN 'Insert into ' WHEN item_id % 8 = 3 THEN 'WITH x ' WHEN item_id % 8 = 4 THEN 'drop ' WHEN item_id % 8 = 5 THEN 'explain ' WHEN item_id % 8 = 6 THEN '' ELSE 'MERGE ' END || text"
over_facts("f10_sql_direction", f"SELECT item_id, CASE WHEN w IN {_in(SQL_READ)} THEN 'read' WHEN w IN {_in(SQL_WRITE)} THEN 'write' ELSE 'both' END AS direction FROM (SELECT item_id, lower(regexp_extract({_SQL_TEXT}, '^[\\s(]*([A-Za-z]+)', 1)) AS w FROM benchmark)")(
    lambda f: f.benchmark.select("item_id", S.sql_direction(F.expr(_SQL_TEXT)).alias("direction"))
)
over_facts("f11_host_of", "SELECT page_id, CASE WHEN contains(url, '://') AND h <> '' THEN h ELSE '' END AS host FROM (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', '')) AS h FROM pages)")(
    lambda f: f.pages.select("page_id", F.coalesce(S.host_of(F.col("url")), F.lit("")).alias("host"))
)
_NAMES = sorted({n for n, _ in stub_rows()} | {n.replace("node:", "") for n, _ in stub_rows()} | {"lodash.map", "fsx.readFile"})
_NAMED = f"SELECT l_orderkey, l_linenumber, l_suppkey, n.name FROM lineitem JOIN (SELECT row_number() OVER (ORDER BY name) - 1 AS i, name FROM (VALUES {_values(_NAMES)}) AS t(name)) n ON n.i = l_suppkey % {len(_NAMES)}"
_PREFIXED = f"CASE WHEN regexp_extract(name, '^([^.]*)\\.', 1) IN {_in(PREFIXABLE)} THEN 'node:' || name ELSE name END"


def _named_calls(f: Facts) -> DataFrame:
    names = f.spark.createDataFrame(list(enumerate(sorted(_NAMES))), "i int, name string")
    return f.lineitem.join(F.broadcast(names), F.col("i") == F.col("l_suppkey") % len(_NAMES))


over_facts("f13_node_prefix", f"SELECT full_name, count(*) AS n FROM (SELECT {_PREFIXED} AS full_name FROM ({_NAMED})) GROUP BY 1")(lambda f: _named_calls(f).groupBy(S.with_node_prefix(F.col("name")).alias("full_name")).agg(F.count("*").alias("n")))
over_facts("f14_stub_effect", f"SELECT coalesce(e.effect, 'none') AS effect, count(*) AS n FROM (SELECT {_PREFIXED} AS full_name FROM ({_NAMED})) c LEFT JOIN (VALUES {', '.join(repr(r) for r in stub_rows())}) e(name, effect) ON e.name = c.full_name GROUP BY 1")(
    lambda f: _named_calls(f).withColumn("full", S.with_node_prefix(F.col("name"))).join(F.broadcast(f.spark.createDataFrame(stub_rows(), "stub string, effect string")), F.col("full") == F.col("stub"), "left").groupBy(F.coalesce("effect", F.lit("none")).alias("effect")).agg(F.count("*").alias("n"))
)
_CLIENT_NAMES = sorted({p.replace("*", "order") for _, p, _ in client_rows()} | {p.replace("*", "a.b") for _, p, _ in client_rows() if "*" in p} | set(SQL_METHODS) | {"pg.Pool.end", "knex.QueryBuilder.where"})
_CLIENT_CALLS = f"(SELECT n.name, CASE l_linenumber WHEN 1 THEN 'select 1' WHEN 2 THEN ' ( INSERT x' WHEN 3 THEN 'with y' WHEN 4 THEN 'drop t' ELSE '' END AS statement FROM lineitem JOIN (SELECT row_number() OVER (ORDER BY name) - 1 AS i, name FROM (VALUES {_values(_CLIENT_NAMES)}) t(name)) n ON n.i = l_suppkey % {len(_CLIENT_NAMES)})"


def _client_calls(f: Facts) -> DataFrame:
    names = f.spark.createDataFrame(list(enumerate(_CLIENT_NAMES)), "i int, name string")
    statement = F.expr("CASE l_linenumber WHEN 1 THEN 'select 1' WHEN 2 THEN ' ( INSERT x' WHEN 3 THEN 'with y' WHEN 4 THEN 'drop t' ELSE '' END")
    return f.lineitem.join(F.broadcast(names), F.col("i") == F.col("l_suppkey") % len(_CLIENT_NAMES)).select("name", statement.alias("statement"))


_PATTERNS = ", ".join(repr((i, p, e)) for i, p, e in client_rows())
over_facts(
    "f15_client_effects",
    f"""SELECT c.name, c.statement, coalesce(CASE WHEN c.name IN {_in(SQL_METHODS)} THEN (CASE WHEN contains(lower(c.statement), 'select') THEN 'db_read' WHEN contains(lower(c.statement), 'insert') OR contains(lower(c.statement), 'drop') THEN 'db_write' ELSE 'db_read,db_write' END)
  ELSE (SELECT arg_min(r.effect, r.rank) FROM (VALUES {_PATTERNS}) r(rank, pattern, effect) WHERE len(string_split(r.pattern, '.')) = len(string_split(c.name, '.')) AND len(list_filter(list_zip(string_split(r.pattern, '.'), string_split(c.name, '.')), lambda z: z[1] <> '*' AND z[1] <> z[2])) = 0) END, 'none') AS effects, c.n
FROM (SELECT name, statement, count(*) AS n FROM {_CLIENT_CALLS} GROUP BY ALL) c""",
)(lambda f: tags.client_effects(_client_calls(f).groupBy("name", "statement").agg(F.count("*").alias("n"))).select("name", "statement", F.coalesce("effects", F.lit("none")).alias("effects"), "n"))
_MADE = sorted([*CONSTRUCTORS, *NULLARY_CONSTRUCTORS, "new Map", "new Promise", "new URL", "new Widget", "new Float64Array"])
_CONSTRUCTIONS = f"(SELECT n.name, l_linenumber % 2 AS arguments FROM lineitem JOIN (SELECT row_number() OVER (ORDER BY name) - 1 AS i, name FROM (VALUES {_values(_MADE)}) t(name)) n ON n.i = l_suppkey % {len(_MADE)})"
over_facts(
    "f17_constructions",
    f"""SELECT name, arguments::INTEGER AS arguments, CASE WHEN name LIKE 'new node:worker%' THEN 'process' WHEN name LIKE 'new node:%' OR name = 'new WebSocket' THEN 'network' WHEN name = 'new Date' AND arguments = 0 THEN 'env'
  WHEN name = 'new Promise' THEN 'higher-order' WHEN name = 'new Widget' THEN 'none' ELSE 'pure' END AS result, count(*) AS n FROM {_CONSTRUCTIONS} GROUP BY ALL""",
)(
    lambda f: f.lineitem.join(F.broadcast(f.spark.createDataFrame(list(enumerate(_MADE)), "i int, name string")), F.col("i") == F.col("l_suppkey") % len(_MADE))
    .groupBy("name", (F.col("l_linenumber") % 2).cast("int").alias("arguments")).agg(F.count("*").alias("n"))
    .withColumn("result", F.coalesce(tags.construction(F.col("name"), F.col("arguments")), F.lit("none")))
)
_ALIASES = {"web": ("network", "env"), "store": ("db_read", "db_write")}
_TAGS = "CASE event_id % 9 WHEN 0 THEN ' pure ' WHEN 1 THEN 'network, db_read' WHEN 2 THEN 'llm' WHEN 3 THEN 'web' WHEN 4 THEN 'store ,env' WHEN 5 THEN 'nothing' WHEN 6 THEN 'network,,env' WHEN 7 THEN 'pure, env' ELSE 'process,env,web' END"
over_facts(
    "f06_effects_tag",
    f"""SELECT event_id, CASE WHEN trim(tag) = 'pure' THEN 'pure' WHEN EXISTS (SELECT 1 FROM (SELECT unnest(list_transform(string_split(tag, ','), lambda t: trim(t))) AS t) WHERE t NOT IN (SELECT token FROM effects) AND t NOT IN ('web', 'store')) THEN 'invalid'
  ELSE (SELECT string_agg(e.token, ',' ORDER BY e.ord) FROM effects e WHERE list_contains(list_transform(string_split(tag, ','), lambda t: trim(t)), e.token) OR (e.token = 'network' AND contains(tag, 'llm')) OR (e.token IN ('network', 'env') AND contains(tag, 'web')) OR (e.token IN ('db_read', 'db_write') AND contains(tag, 'store'))) END AS effects
FROM (SELECT event_id, {_TAGS} AS tag FROM events)""",
)(
    lambda f: f.events.select("event_id", F.expr(_TAGS).alias("tag")).withColumn("got", tags.effects_tag(F.col("tag"), _ALIASES))
    .select("event_id", F.when(F.col("got").isNull(), "invalid").when(F.size("got") == 0, "pure").otherwise(F.array_join("got", ",")).alias("effects"))
)
_UPDATES = """SELECT o_orderkey AS id, o_orderkey % 11 = 0 AS first, o_orderkey % 13 = 0 AS failed, o_custkey % 7 <> 0 AS told, o_custkey % 5 <> 0 AS reusable, CAST(o_orderkey % 17 = 0 AS INT) AS added,
  CAST(o_custkey % 3 = 0 AS INT) AS deleted, CAST(o_orderkey % 4 AS INT) AS edited, CAST(o_custkey % 11 = 0 AS INT) AS configs, o_custkey % 19 = 0 AS unknown FROM orders"""
over_facts(
    "d11_update_plan",
    f"SELECT id, CASE WHEN first OR failed OR NOT told OR NOT reusable OR added > 0 OR unknown THEN 'full' WHEN deleted + edited + configs > 0 THEN 'partial' ELSE 'none' END AS plan FROM ({_UPDATES})",
)(lambda f: tags.update_plan(f.spark.sql(_UPDATES.replace("FROM orders", "FROM {orders}"), orders=f.orders)).select("id", "plan"))
over_facts("d12_narrow_offer", f"SELECT id FROM ({_UPDATES}) WHERE NOT first AND NOT failed AND told AND reusable AND added = 0 AND NOT unknown AND deleted = 0 AND configs = 0 AND edited > 0")(
    lambda f: tags.update_plan(f.spark.sql(_UPDATES.replace("FROM orders", "FROM {orders}"), orders=f.orders)).where("narrow").select("id")
)
over_facts("p13_fingerprint_reuse", "SELECT o_orderkey AS id, o_custkey % 4 <> 0 AND o_orderkey % 4 <> 0 AND (o_custkey % 2 = o_orderkey % 2) AS reusable FROM orders")(
    lambda f: f.orders.select(F.col("o_orderkey").alias("id"), tags.fingerprint_reusable(F.col("o_custkey") % 2, F.col("o_orderkey") % 2, (F.col("o_custkey") % 4 == 0).cast("int"), (F.col("o_orderkey") % 4 == 0).cast("int")).alias("reusable"))
)
over_facts("f12_http_capability", f"SELECT page_id, 'http:' || action || ':' || host AS cap FROM hosts JOIN (SELECT row_number() OVER (ORDER BY name) - 1 AS i, name, action FROM (VALUES {', '.join(repr((n, a)) for n, (a, _) in HTTP.items())}) t(name, action)) r ON r.i = page_id % {len(HTTP)} WHERE host <> ''")(
    lambda f: f.pages.select("page_id", S.host_of(F.col("url")).alias("host")).join(F.broadcast(f.spark.createDataFrame([(i, n, HTTP[n][0]) for i, n in enumerate(sorted(HTTP))], "i int, name string, action string")), F.col("i") == F.col("page_id") % len(HTTP)).where("host is not null").select("page_id", S.format_capability(F.lit("http"), F.col("action"), F.col("host")).alias("cap"))
)
over_facts("f22_display_name", "SELECT sym, split_part(sym, '#', 2) AS name FROM fn")(lambda f: f.fn.select("sym", S.display_name(F.col("sym")).alias("name")))
over_facts("f23_approval_symbol", "SELECT sym, 'pkg/a/' || sym AS full_sym FROM fn")(lambda f: f.fn.select("sym", S.approval_symbol(F.lit("./pkg//a/."), F.col("sym")).alias("full_sym")))
over_facts("f24_authority_ref", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'effect' WHEN event_id % 3 = 1 THEN 'capability' ELSE '' END AS kind FROM events")(
    lambda f: f.events.select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN 'effect:' WHEN event_id % 3 = 1 THEN 'capability:' ELSE 'other:' END || event_type").alias("t")).select("event_id", F.coalesce(S.authority_ref(F.col("t"))["kind"], F.lit("")).alias("kind"))
)
over_facts("f31_annotation_escape", "SELECT doc_id, length(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'))::INTEGER AS n FROM documents")(lambda f: f.documents.select("doc_id", F.length(S.annotation_data(F.col("text"))).alias("n")))
over_facts("f32_hash", "SELECT page_id, sha256(url) AS hash FROM pages")(lambda f: f.pages.select("page_id", F.sha2("url", 256).alias("hash")))

# --- graph ----------------------------------------------------------------------------------

over_state("g01_propagate", "SELECT lattice, sym, token FROM state WHERE snap = 'all'")(lambda p: p.state.where("snap = 'all'").select("lattice", "sym", "token"))
over_state("g02_scoped_fixpoint", "SELECT lattice, sym, token FROM state WHERE snap = 'head'", BOTH)(
    lambda p: incremental.scoped_state(p.program.at("base"), p.program.at("head"), incremental.impact(p, incremental.changed_symbols(p))).select("lattice", "sym", "token")
)
_WALK = """SELECT sym, token, hop_ix::INTEGER AS hop_ix, here AS hop FROM (
WITH RECURSIVE walk AS (
  SELECT x.sym, x.token, x.sym AS here, 0 AS hop_ix, [x.sym] AS seen FROM excess x WHERE x.snap = 'all' AND x.lattice = 'e'
  UNION ALL SELECT w.sym, w.token, n.callee, w.hop_ix + 1, list_append(w.seen, n.callee) FROM walk w JOIN witness n ON n.snap = 'all' AND n.lattice = 'e' AND n.token = w.token AND n.sym = w.here WHERE NOT list_contains(w.seen, n.callee))
SELECT * FROM walk) WHERE hop_ix > 0"""
over_state("g03_witness_paths", _WALK)(
    lambda p: P.witness_paths(p.witnesses().where("snap = 'all' and lattice = 'e'"), P.excess(p).where("snap = 'all' and lattice = 'e'")).select("sym", "token", F.col("hop_ix").cast("int").alias("hop_ix"), "hop")
)
_IMPORTS = "SELECT DISTINCT split_part(c.sym, '#', 1) AS file, split_part(c.callee, '#', 1) AS target FROM scalls c WHERE c.snap = 'all' AND c.kind = 'resolved' AND c.call_ord = 1"


def _imports(p: P.Propagation) -> DataFrame:
    part = lambda c: F.substring_index(c, "#", 1)
    return p.calls.where("snap = 'all' and kind = 'resolved' and call_ord = 1").select(part("sym").alias("file"), part("callee").alias("target")).distinct()


_CLOSED = f"WITH RECURSIVE imp AS ({_IMPORTS}), reach AS (SELECT DISTINCT file AS seed, file AS node FROM fn UNION SELECT r.seed, i.file FROM reach r JOIN imp i ON i.target = r.node) SELECT seed, node FROM reach"
over_state("g04_importer_closure", f"SELECT node FROM ({_CLOSED}) WHERE seed = (SELECT min(file) FROM fn)")(
    lambda p: incremental.importer_closure(_imports(p), p.fn.groupBy().agg(F.min("file").alias("file"))).select("node")
)
over_state("g05_impact_closure", "SELECT sym FROM (WITH RECURSIVE reach AS (SELECT DISTINCT sym FROM excess WHERE snap = 'all' UNION SELECT c.sym FROM reach r JOIN scalls c ON c.snap IN ('base', 'head') AND c.kind = 'resolved' AND c.callee = r.sym) SELECT sym FROM reach)")(
    lambda p: incremental.impact(p.program.at(*BOTH), P.excess(p).select("sym").distinct())
)
over_state("g06_reverse_calls", "SELECT DISTINCT callee, sym AS caller FROM scalls WHERE snap = 'all' AND kind = 'resolved'")(lambda p: p.calls.where("snap = 'all' and kind = 'resolved'").select("callee", F.col("sym").alias("caller")).distinct())
over_state("g09_closure_sizes", f"SELECT seed, count(*) AS n FROM ({_CLOSED}) GROUP BY 1")(lambda p: incremental.importer_closure(_imports(p), p.fn.where("snap = 'all'").select("file").distinct()).groupBy("seed").agg(F.count("*").alias("n")))

# --- findings -------------------------------------------------------------------------------

over_state("r01_excess_effects", "SELECT x.sym, arg_min(x.token, e.ord) AS subject FROM excess x JOIN effects e ON e.token = x.token WHERE x.snap = 'all' AND x.lattice = 'e' GROUP BY 1")(lambda p: rules.excess_effects(p).select("sym", "subject"))
for _key, _where in (
    ("r02_invalid_effects", "eff_kind = 'invalid'"),
    ("r05_invalid_capabilities", "cap_kind = 'invalid'"),
    ("r09_boundary_without_reason", "bnd_kind = 'invalid'"),
    ("r10_boundary_without_effects", "bnd_kind = 'declared' AND eff_kind = 'none'"),
    ("r11_invalid_budget", "bud_kind = 'invalid'"),
    ("r12_entrypoint_without_caps", "entrypoint AND cap_kind = 'none'"),
):
    over_facts(_key, f"SELECT sym FROM fn WHERE {_where}")(lambda f, w=_where: f.fn.where(w).select("sym"))
over_state("r04_declared_unknown", f"SELECT sym FROM ({_W001})")(
    lambda p: p.fn.where("snap = 'all' and bnd_kind <> 'declared' and eff_kind = 'declared'").select("sym").join(p.state.where("snap = 'all' and lattice = 'e' and token = '?'").select("sym"), "sym", "left_semi")
)
_LITERAL = f"""SELECT c.sym, c.call_ord, c.req_cap AS token FROM scalls c JOIN node n ON n.snap = 'all' AND n.lattice = 'c' AND n.sym = c.sym AND n.declared AND NOT n.boundary
WHERE c.snap = 'all' AND c.req_cap IS NOT NULL AND NOT EXISTS (SELECT 1 FROM decl d WHERE d.snap = 'all' AND d.lattice = 'c' AND d.sym = c.sym AND split_part(d.token, ':', 2) = split_part(c.req_cap, ':', 2)
  AND {glob("regexp_replace(d.token, '^[^:]*:[^:]*:', '')", "regexp_replace(c.req_cap, '^[^:]*:[^:]*:', '')")})"""
over_state("r07_literal_excess", _LITERAL)(rules.literal_excess)
over_state("r06_inherited_excess", f"SELECT sym, token FROM excess x WHERE snap = 'all' AND lattice = 'c' AND (NOT EXISTS (SELECT 1 FROM ({_LITERAL}) l WHERE l.sym = x.sym AND l.token = x.token) OR EXISTS (SELECT 1 FROM witness w WHERE w.snap = 'all' AND w.lattice = 'c' AND w.sym = x.sym AND w.token = x.token))")(rules.inherited_excess)
_CAUSE = """SELECT o.sym, CASE WHEN b.sym IS NOT NULL THEN 'boundary' WHEN NOT coalesce(w.blocked, false) AND coalesce(w.dynamic, false) THEN 'dynamic-target' ELSE 'unresolved' END AS cause
FROM (SELECT s.sym FROM state s JOIN node n ON n.snap = s.snap AND n.lattice = s.lattice AND n.sym = s.sym WHERE s.snap = 'all' AND s.lattice = 'c' AND s.token = '?' AND n.declared AND NOT n.boundary) o
LEFT JOIN (SELECT sym, arg_max(here, hop_ix) AS hop FROM (
  WITH RECURSIVE chain AS (
    SELECT s.sym, s.sym AS here, 0 AS hop_ix, [s.sym] AS seen FROM state s JOIN node n ON n.snap = s.snap AND n.lattice = s.lattice AND n.sym = s.sym WHERE s.snap = 'all' AND s.lattice = 'c' AND s.token = '?' AND n.declared AND NOT n.boundary
    UNION ALL SELECT c.sym, n.callee, c.hop_ix + 1, list_append(c.seen, n.callee) FROM chain c JOIN witness n ON n.snap = 'all' AND n.lattice = 'c' AND n.token = '?' AND n.sym = c.here WHERE NOT list_contains(c.seen, n.callee))
  SELECT * FROM chain) WHERE hop_ix > 0 GROUP BY 1) l ON l.sym = o.sym
LEFT JOIN (SELECT sym FROM snapfn WHERE snap = 'all' AND bnd_kind = 'declared') b ON b.sym = l.hop
LEFT JOIN (SELECT sym, bool_or(blocks) AS blocked, bool_or(cap_target_unknown) AS dynamic FROM scalls WHERE snap = 'all' GROUP BY 1) w ON w.sym = o.sym"""
over_state("r08_unknown_cause", _CAUSE)(rules.unknown_cause)
over_state("r18_proposals", "SELECT f.sym, '@effects ' || coalesce((SELECT string_agg(s.token, ', ' ORDER BY e.ord) FROM state s JOIN effects e ON e.token = s.token WHERE s.snap = 'all' AND s.lattice = 'e' AND s.sym = f.sym), 'pure') AS subject FROM snapfn f WHERE f.snap = 'all' AND f.eff_kind = 'none' AND f.bnd_kind <> 'declared' AND NOT f.undeclarable AND NOT EXISTS (SELECT 1 FROM state s WHERE s.snap = 'all' AND s.lattice = 'e' AND s.sym = f.sym AND s.token = '?')")(rules.proposals)
over_state("r19_blocked", "SELECT f.sym, count(*) AS n FROM snapfn f JOIN scalls c ON c.snap = 'all' AND c.sym = f.sym AND c.blocks WHERE f.snap = 'all' AND f.eff_kind = 'none' AND f.bnd_kind <> 'declared' GROUP BY 1")(rules.blocked)
_INHERITED = f"SELECT sym, token FROM excess x WHERE snap = 'all' AND lattice = 'c' AND (NOT EXISTS (SELECT 1 FROM ({_LITERAL}) l WHERE l.sym = x.sym AND l.token = x.token) OR EXISTS (SELECT 1 FROM witness w WHERE w.snap = 'all' AND w.lattice = 'c' AND w.sym = x.sym AND w.token = x.token))"
_REPORT = f"""SELECT 'AMB-E001' AS rule, x.sym, arg_min(x.token, e.ord) AS subject FROM excess x JOIN effects e ON e.token = x.token WHERE x.snap = 'all' AND x.lattice = 'e' GROUP BY x.sym
UNION ALL SELECT 'AMB-E002', sym, '' FROM fn WHERE eff_kind = 'invalid'
UNION ALL SELECT 'AMB-W001', sym, '' FROM ({_W001})
UNION ALL SELECT 'AMB-E004', sym, '' FROM fn WHERE cap_kind = 'invalid'
UNION ALL SELECT 'AMB-E005', sym, token FROM ({_INHERITED})
UNION ALL SELECT 'AMB-E009', sym, token || '@' || call_ord FROM ({_LITERAL})
UNION ALL SELECT 'AMB-W003', sym, cause FROM ({_CAUSE})
UNION ALL SELECT 'AMB-E006', sym, '' FROM fn WHERE bnd_kind = 'invalid'
UNION ALL SELECT 'AMB-E007', sym, '' FROM fn WHERE bnd_kind = 'declared' AND eff_kind = 'none'
UNION ALL SELECT 'AMB-E008', sym, '' FROM fn WHERE bud_kind = 'invalid'
UNION ALL SELECT 'AMB-W002', sym, '' FROM fn WHERE entrypoint AND cap_kind = 'none'"""
_SEVERITY = "CASE substr(rule, 5, 1) WHEN 'E' THEN 'error' WHEN 'W' THEN 'warning' ELSE 'info' END"
over_state("t01_ranked_report", f"SELECT file, row_number() OVER (ORDER BY file, line, rule, sym, subject) AS rank, rule, sym, subject FROM (SELECT r.*, f.file, f.line FROM ({_REPORT}) r JOIN fn f ON f.sym = r.sym)")(
    lambda p: rules.ranked(rules.report(p), p.fn).select("file", "rank", "rule", "sym", "subject")
)
over_state("k07_exit_decision", "SELECT 1::INTEGER AS exit_code")(lambda p: rules.with_severity(rules.report(p)).agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).cast("int").alias("exit_code")))
over_state("k07_exit_codes", f"SELECT rule, count(*) AS n, CASE WHEN {_SEVERITY} = 'error' THEN 1 ELSE 0 END AS exit_code FROM ({_REPORT}) GROUP BY rule UNION ALL SELECT 'all', count(*), CASE WHEN bool_or({_SEVERITY} = 'error') THEN 1 ELSE 0 END FROM ({_REPORT})")(
    lambda p: rules.exit_codes(rules.with_severity(rules.report(p)))
)
over_state("k01_ndjson", f"SELECT '{{\"rule\":\"' || rule || '\",\"sym\":\"' || sym || '\",\"subject\":\"' || subject || '\"}}' AS line FROM ({_REPORT})")(lambda p: rules.report(p).select(F.to_json(F.struct("rule", "sym", "subject")).alias("line")))
over_state(
    "k03_annotations",
    f"SELECT '::' || {_SEVERITY} || ' file=' || f.file || ',line=' || f.line || ',title=' || rule || '::' || r.sym || ' ' || subject AS line FROM ({_REPORT}) r JOIN fn f ON f.sym = r.sym",
)(
    lambda p: rules.with_severity(rules.report(p)).join(p.fn.where("snap = 'all'").select("sym", "file", F.col("line").alias("at")), "sym").select(
        F.concat(F.lit("::"), "severity", F.lit(" file="), S.annotation_property(F.col("file")), F.lit(",line="), F.col("at").cast("string"), F.lit(",title="), "rule", F.lit("::"), S.annotation_data(F.concat_ws(" ", "sym", "subject"))).alias("line")
    )
)
over_facts("k06_approval_lines", "SELECT '- `' || sym || '` `' || kind || ':' || name || '` — reviewed' AS line FROM ledger")(lambda f: f.ledger.select(F.format_string("- `%s` `%s:%s` — reviewed", "sym", "kind", "name").alias("line")))
over_facts("s10_ledger_parse", "SELECT side, line, sym AS symbol, kind, name FROM ledger")(
    lambda f: diff.parse_ledger(f.ledger.select("side", "line", F.format_string("- `%s` `%s:%s` — reviewed", "sym", "kind", "name").alias("text"))).where("not malformed").select("side", "line", "symbol", "kind", "name")
)

# --- changes --------------------------------------------------------------------------------

over_state("d01_authority_diff", "SELECT sym, lattice, token, status, change FROM changes", BOTH)(diff.authority_changes)
over_state("d02_status", "SELECT CASE WHEN NOT in_base THEN 'new' WHEN NOT in_head THEN 'deleted' ELSE 'present' END AS status, count(*) AS n FROM presence GROUP BY 1", BOTH)(
    lambda p: p.fn.where("snap <> 'all'").groupBy("sym").agg(F.when(F.count("*") == 2, "present").when(F.max("snap") == "head", "new").otherwise("deleted").alias("status")).groupBy("status").agg(F.count("*").alias("n"))
)
over_state("d03_unknown_changes", "SELECT * FROM (SELECT h.sym, count(DISTINCT CASE WHEN snap = 'head' THEN body_ix END) > count(DISTINCT CASE WHEN snap = 'base' THEN body_ix END) AS gained, count(DISTINCT CASE WHEN snap = 'head' THEN body_ix END) < count(DISTINCT CASE WHEN snap = 'base' THEN body_ix END) AS lost FROM holdings h JOIN presence p ON p.sym = h.sym AND p.in_base AND p.in_head WHERE snap <> 'all' AND token = '?' GROUP BY 1) WHERE gained OR lost", BOTH)(diff.unknown_changes)
over_state("d05_increases", "SELECT sym AS symbol, kind, name FROM increase", BOTH)(diff.increases)
over_state("d06_review", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN i.sym IS NULL THEN 'unused' WHEN f.line IS NULL THEN 'unapproved' ELSE 'approved' END AS status FROM (SELECT *, 1 AS slot FROM increase) i FULL JOIN force f ON f.sym = i.sym AND f.kind = i.kind AND f.name = i.name AND f.slot = i.slot) GROUP BY 1", BOTH)(
    lambda p: diff.review(diff.increases(p), diff.ledger_rows(p.facts)).groupBy("status").agg(F.count("*").alias("n"))
)
over_state("d08_summaries_equal", f"SELECT sym, b = h AS equal FROM ({_SIDES}) WHERE b IS NOT NULL AND h IS NOT NULL", BOTH)(incremental.summaries_equal)
over_state(
    "d10_scope",
    f"SELECT sym FROM (WITH RECURSIVE reach AS (SELECT sym FROM ({_SIDES}) WHERE b IS DISTINCT FROM h UNION SELECT c.sym FROM reach r JOIN scalls c ON c.snap IN ('base', 'head') AND c.kind = 'resolved' AND c.callee = r.sym) SELECT sym FROM reach)",
    BOTH,
)(lambda p: incremental.impact(p, incremental.changed_symbols(p)))

# --- runtime and logs -----------------------------------------------------------------------

_DECIDED = f"""SELECT r.ctx, r.seq, r.cap, bool_or(split_part(g.cap, ':', 2) = split_part(r.cap, ':', 2) AND {glob("regexp_replace(g.cap, '^[^:]*:[^:]*:', '')", "regexp_replace(r.cap, '^[^:]*:[^:]*:', '')")}) AS granted FROM audit_req r JOIN grants g ON g.ctx = r.ctx GROUP BY ALL"""
over_facts("x03_audit_decision", _DECIDED)(lambda f: audit.decisions(f.audit_req, f.grants))
over_facts("x04_first_denial", f"SELECT ctx, min(seq) AS seq, arg_min(cap, seq) AS cap, count(*) AS denied FROM ({_DECIDED}) WHERE NOT granted GROUP BY 1")(lambda f: audit.first_denials(audit.decisions(f.audit_req, f.grants)))
over_facts("x05_over_time", "SELECT ctx, seconds FROM (SELECT ctx, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS seconds FROM audit_req GROUP BY 1) WHERE seconds > 2500000")(lambda f: audit.over_time(f.audit_req, 2_500_000))
over_facts("l01_stream_id", "SELECT page_id, substr(sha1(url), 1, 10) AS id FROM pages")(lambda f: f.pages.select("page_id", F.substring(F.sha1("url"), 1, 10).alias("id")))
over_facts("l03_known_state", "SELECT stream, ord, file, epoch, coalesce(lag(ord) OVER (PARTITION BY stream, file, epoch ORDER BY ts, ord), -1) AS known FROM (SELECT *, count(*) FILTER (WHERE touches_src AND kind = 'command') OVER (PARTITION BY stream ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS epoch FROM log_events) WHERE kind = 'edit'")(
    lambda f: workload.known_state(f.log_events).withColumn("known", F.coalesce("known", F.lit(-1)))
)
over_facts("l05_batches", f"SELECT stream, batch, min(ts) AS start_at, max(ts) AS end_at, count(*) AS edits, count(DISTINCT file) AS files, round(sum(cost), 4) AS cost FROM {_BATCH} GROUP BY ALL")(lambda f: workload.batch_table(f.log_events))
over_facts("l06_file_fold", f"SELECT stream, batch, file, arg_min(ord, (ts, ord)) AS first_ord, arg_max(ord, (ts, ord)) AS last_ord, count(*) AS n FROM {_BATCH} GROUP BY ALL")(lambda f: workload.file_folds(f.log_events))
over_facts("l09_shapes", _SHAPES.replace("batch_rows", _BATCH))(lambda f: workload.shapes(f.log_events))
_TABLE = f"(SELECT stream, batch, min(ts) AS start_at, max(ts) AS end_at, count(*) AS edits FROM {_BATCH} GROUP BY ALL)"
over_facts("l11_gaps", f"SELECT stream, batch, epoch(date_trunc('second', start_at))::BIGINT - epoch(date_trunc('second', pe))::BIGINT AS gap FROM (SELECT *, lag(stream) OVER w AS ps, lag(end_at) OVER w AS pe FROM {_TABLE} WINDOW w AS (ORDER BY start_at, stream, batch)) WHERE ps = stream AND pe <= start_at")(
    lambda f: workload.gaps(workload.batch_table(f.log_events))
)
over_facts("l12_class_table", f"SELECT cls, count(*) AS n, quantile_disc(edits, 0.5) AS p50, quantile_disc(edits, 0.75) AS p75, quantile_disc(edits, 0.9) AS p90, max(edits) AS most, sum(edits)::BIGINT AS edits, round(count(*) / any_value(total), 6) AS share FROM (SELECT *, CASE WHEN edits = 1 THEN 'one' WHEN edits <= 5 THEN 'few' ELSE 'many' END AS cls, count(*) OVER () AS total FROM {_TABLE}) GROUP BY 1")(
    lambda f: workload.class_table(f.log_events)
)

# --- contracts of three sources -------------------------------------------------------------

_MATCHES = """(SELECT sym, arg_min(key, (NOT exact, key)) AS key, bool_or(exact) AS exact, CASE WHEN bool_or(exact) THEN count(*) FILTER (WHERE exact) > 1 ELSE count(*) > 1 END AS ambiguous
FROM fn f JOIN config c ON c.decl_sym = split_part(f.sym, '#', 2) AND (CASE c.decl_path WHEN 'lib/1*.ts' THEN regexp_matches(f.file, '^lib/1[^/]*\\.ts$') WHEN 'lib/**.ts' THEN regexp_matches(f.file, '^lib/.*\\.ts$') ELSE f.file = c.decl_path END) GROUP BY sym)"""
_MERGED = f"""(SELECT t.sym, t.tag, CASE WHEN t.kind = 'none' AND coalesce(g.value, s.value) IS NOT NULL THEN 'declared' ELSE t.kind END AS kind,
  CASE WHEN t.kind = 'none' THEN coalesce(g.value, s.value) ELSE t.value END AS value,
  CASE WHEN t.kind = 'declared' THEN 'jsdoc' WHEN t.kind = 'none' AND g.value IS NOT NULL THEN 'config' WHEN t.kind = 'none' AND s.value IS NOT NULL THEN 'spec' END AS origin,
  coalesce(t.kind = 'declared' AND t.value <> d.value, false) AS diverges
FROM contract_tags t LEFT JOIN {_MATCHES} m ON m.sym = t.sym AND NOT m.ambiguous
LEFT JOIN config_tags d ON d.key = m.key AND d.tag = t.tag LEFT JOIN config_tags g ON g.key = m.key AND g.tag = t.tag AND NOT (g.tag = 'entrypoint' AND g.value = 'false')
LEFT JOIN (SELECT sym, tag, value FROM (SELECT sym, arg_min_null(caps, ord) AS capabilities, arg_min_null(budget, ord) AS budget FROM specs GROUP BY 1) UNPIVOT (value FOR tag IN (capabilities, budget))) s ON s.sym = t.sym AND s.tag = t.tag)"""
_matches = lambda f: contracts.config_matches(f.config, f.fn)
_merged = lambda f: contracts.merged(f.contract_tags, _matches(f), f.config_tags, f.specs)
over_facts("j06_config_match", f"SELECT sym, key, exact, ambiguous FROM {_MATCHES}")(_matches)
over_facts("j11_first_spec", "SELECT sym, tag, value FROM (SELECT sym, arg_min_null(caps, ord) AS capabilities, arg_min_null(budget, ord) AS budget FROM specs GROUP BY 1) UNPIVOT (value FOR tag IN (capabilities, budget))")(lambda f: contracts.first_specs(f.specs))
_plain = lambda df: df.select("sym", "tag", "kind", _text("value"), _text("origin"), "diverges")
over_facts("j12_merged_contracts", f"SELECT sym, tag, kind, coalesce(value, '') AS value, coalesce(origin, '') AS origin, diverges FROM {_MERGED}")(lambda f: _plain(_merged(f)))
_WRAPPED = f"""(SELECT w.wrapper, w.caps, w.w_budget, c.sym IS NOT NULL AS found, c.kind AS ck, c.value AS cv, b.kind AS bk, b.value AS bv, e.kind AS ek FROM wrappers w
LEFT JOIN merged c ON c.sym = w.handler AND c.tag = 'capabilities' LEFT JOIN merged b ON b.sym = w.handler AND b.tag = 'budget' LEFT JOIN merged e ON e.sym = w.handler AND e.tag = 'entrypoint')"""
_FINDINGS = f"""WITH merged AS MATERIALIZED (SELECT * FROM {_MERGED}), w AS (SELECT * FROM {_WRAPPED})
SELECT wrapper, 'AMB-W004' AS rule, 'no-handler' AS cause FROM w WHERE NOT found
UNION ALL SELECT wrapper, 'AMB-W004', 'caps-not-literal' FROM w WHERE found AND ck <> 'invalid' AND caps IS NULL
UNION ALL SELECT wrapper, 'AMB-W004', 'nothing-declared' FROM w WHERE found AND caps IS NOT NULL AND ck = 'none' AND ek = 'none'
UNION ALL SELECT wrapper, 'AMB-E010', 'caps-differ' FROM w WHERE found AND caps IS NOT NULL AND ck <> 'invalid' AND NOT (ck = 'none' AND ek = 'none') AND caps <> coalesce(cv, '')
UNION ALL SELECT wrapper, 'AMB-W004', 'budget-not-literal' FROM w WHERE found AND bk <> 'invalid' AND w_budget IS NULL
UNION ALL SELECT wrapper, 'AMB-E011', 'budget-differs' FROM w WHERE found AND bk <> 'invalid' AND w_budget IS NOT NULL AND nullif(w_budget, 'none') IS DISTINCT FROM bv"""
_wrapped = lambda f: contracts.wrapper_findings(f.wrappers, _merged(f))
over_facts("j10_wrapper_handler", f"SELECT * FROM ({_FINDINGS})")(_wrapped)
for _key, _rule in (("r13_wrapper_not_comparable", "AMB-W004"), ("r14_wrapper_capabilities", "AMB-E010"), ("r15_wrapper_budget", "AMB-E011")):
    over_facts(_key, f"SELECT wrapper, cause FROM ({_FINDINGS}) WHERE rule = '{_rule}'")(lambda f, r=_rule: _wrapped(f).where(F.col("rule") == r).select("wrapper", "cause"))
over_facts("r16_divergence", f"SELECT sym, tag FROM {_MERGED} WHERE diverges")(lambda f: _merged(f).where("diverges").select("sym", "tag"))
over_facts("r17_unmatched_key", "SELECT DISTINCT key FROM config WHERE exact AND key NOT IN (SELECT sym FROM fn)")(lambda f: contracts.unmatched_exact(f.config, f.fn))
over_facts("w03_approval_region", "SELECT side, line, sym FROM ledger_lines l WHERE line > coalesce((SELECT min(line) FROM ledger_lines h WHERE h.side = l.side AND h.heading), -1)")(lambda f: contracts.approval_region(f.ledger_lines).select("side", "line", "sym"))
over_facts("w05_numbered_keys", "SELECT key || CASE WHEN n > 1 THEN ' #' || n ELSE '' END AS key, call_ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY call_ord) AS n FROM (SELECT sym || ':' || kind AS key, call_ord FROM calls))")(
    lambda f: contracts.numbered_keys(f.calls.select(F.concat_ws(":", "sym", "kind").alias("key"), "call_ord"), "key", "call_ord")
)

# --- runtime requirements -------------------------------------------------------------------

_BUILTINS = ["DateConstructor.now", "Math.random", "Math.max", "JSON.parse"]
over_facts("f16_builtin_effect", f"SELECT name, count(*) AS n, CASE WHEN name IN ('Math.max', 'JSON.parse') THEN 'none' ELSE 'env' END AS effect FROM (SELECT CASE l_suppkey % 4 WHEN 0 THEN 'DateConstructor.now' WHEN 1 THEN 'Math.random' WHEN 2 THEN 'Math.max' ELSE 'JSON.parse' END AS name FROM lineitem) GROUP BY 1")(
    lambda f: f.lineitem.select(F.get(F.array(*map(F.lit, _BUILTINS)), (F.col("l_suppkey") % 4).cast("int")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    .withColumn("effect", F.coalesce(F.create_map(*[F.lit(x) for pair in BUILTIN_STUBS.items() for x in pair])[F.col("name")], F.lit("none")))
)
over_facts("f33_fetch_requirement", "SELECT page_id, 'http:get:' || regexp_replace(host, CASE WHEN starts_with(url, 'https:') THEN ':443$' ELSE ':80$' END, '') AS cap FROM hosts JOIN pages USING (page_id) WHERE host <> '' AND contains(url, '://')")(
    lambda f: f.pages.select("page_id", Q.fetch_requirement(F.lit("GET"), F.col("url")).alias("cap")).where("cap is not null")
)
_RESOLVED = "CASE WHEN event_id % 3 = 0 THEN '/srv/a/' WHEN event_id % 3 = 1 THEN '/srv/' ELSE '/' END || substr(path_a, CASE WHEN event_id % 3 = 0 THEN 11 WHEN event_id % 3 = 1 THEN 11 ELSE 2 END)"
_OPS = sorted(FS_RULES)


def _needs(*verbs: str) -> str:
    rows = [(name, verb, position) for name in _OPS for verb in verbs for position in FS_RULES[name].get(verb, ())]
    return "(VALUES " + ", ".join(repr(r) for r in rows) + ") r(name, verb, position)"


over_facts("f34_file_requirements", f"SELECT event_id, 'fs:' || verb || ':' || CASE WHEN position = 0 THEN {_RESOLVED} ELSE path_b END AS cap FROM runtime_calls JOIN (VALUES {', '.join(repr(x) for x in enumerate(_OPS))}) o(i, opname) ON i = op JOIN {_needs('read', 'write')} ON name = opname")(
    lambda f: f.runtime_calls.withColumn("opname", F.get(F.array(*map(F.lit, _OPS)), F.col("op").cast("int"))).select("event_id", F.explode(Q.file_requirements(F.col("opname"), F.array("path_a", "path_b"))).alias("cap"))
)
over_facts("f34_open_requirements", f"SELECT event_id, 'fs:' || verb || ':' || {_RESOLVED} AS cap FROM runtime_calls, (VALUES ('read'), ('write')) v(verb) WHERE (verb = 'read' AND (flags IS NULL OR flags <> 'w')) OR (verb = 'write' AND flags IN ('w', 'a+', 'r+'))")(
    lambda f: f.runtime_calls.select("event_id", F.explode(Q.open_requirements(F.col("path_a"), F.col("flags"))).alias("cap"))
)
over_facts("f35_spawn_requirement", "SELECT event_id, 'proc:spawn:' || CASE WHEN kind = 'fork' THEN '/usr/bin/node' WHEN shell NOT IN ('true', 'false') THEN shell WHEN shell = 'true' OR kind = 'exec' THEN '/bin/sh' ELSE coalesce(command, 'unknown') END AS cap FROM runtime_calls")(
    lambda f: f.runtime_calls.select("event_id", Q.spawn_requirement(F.col("kind"), F.col("command"), F.col("shell"), "/usr/bin/node").alias("cap"))
)
over_facts("f36_database_requirements", "SELECT event_id, 'db:' || verb || ':' || coalesce(nullif(db, ''), nullif(split_part(connection, '/', 4), ''), 'unknown') AS cap FROM runtime_calls, (VALUES ('read'), ('write')) v(verb) WHERE event_id % 3 = 2 OR (event_id % 3 = 0) = (verb = 'read')")(
    lambda f: f.runtime_calls.select("event_id", F.explode(Q.database_requirements(F.col("db"), F.col("connection"), F.col("statement"))).alias("cap"))
)
