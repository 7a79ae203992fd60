"""Fact tables of a program, derived from the star-schema tables.

Each view is one SQL text in the dialect that Spark and DuckDB share, so that a query and its
oracle start from the same facts.  A real installation replaces the views by tables an extractor
writes (``read_facts``); the operators see only their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import EFFECTS

_EFFECTS_TEXT = "concat_ws(',', " + ", ".join(f"max(CASE WHEN d.ord = {i} THEN d.token END)" for i in range(len(EFFECTS))) + ")"
_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

VIEWS: dict[str, str] = {
    "effects": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(EFFECTS)) + ") AS t(ord, token)",
    "fn": """
SELECT p_partkey AS id, 'lib/' || substr(p_brand, 7) || '.ts#f' || CAST(p_partkey AS STRING) AS sym, 'lib/' || substr(p_brand, 7) || '.ts' AS file,
  CAST(p_partkey % 400 + 1 AS INT) AS line, p_size,
  CASE WHEN p_size <= 10 THEN 'declared' WHEN p_size = 11 THEN 'invalid' ELSE 'none' END AS eff_kind,
  CASE WHEN p_size BETWEEN 5 AND 20 THEN 'declared' WHEN p_size = 21 THEN 'invalid' ELSE 'none' END AS cap_kind,
  CASE WHEN p_size BETWEEN 30 AND 33 THEN 'declared' WHEN p_size = 34 THEN 'invalid' ELSE 'none' END AS bud_kind,
  CASE WHEN p_size IN (3, 50) AND p_partkey % 3 <> 0 THEN 'declared' WHEN p_size = 50 THEN 'invalid' ELSE 'none' END AS bnd_kind,
  p_size = 49 OR p_size = 8 AS entrypoint, p_partkey % 6 = 5 AS by_config, p_partkey % 29 = 7 AS undeclarable
FROM part""",
    "declared_effects": """
SELECT DISTINCT f.sym, e.ord, e.token FROM fn f JOIN effects e
  ON e.ord = f.id % 9 OR (f.id % 4 = 0 AND e.ord = (f.id + 3) % 9) OR (e.ord = 0 AND (f.id % 9 = 6 OR (f.id % 4 = 0 AND (f.id + 3) % 9 = 6)))
WHERE f.eff_kind = 'declared' AND f.id % 10 <> 3""",
    "declared_caps": """
SELECT sym, CAST(1 AS INT) AS ord, 'http' AS resource, CASE WHEN id % 4 = 2 THEN 'post' WHEN id % 4 = 3 THEN 'put' ELSE 'get' END AS action,
  CASE WHEN id % 4 = 0 THEN '*' WHEN id % 4 = 1 THEN '*.example.com' WHEN id % 4 = 2 THEN '*' ELSE 'm.t?*.example.org' END AS target
FROM fn WHERE cap_kind = 'declared'""",
    "hosts": "SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages",
    "line": f"""
SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_shipdate,
  CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS INT) AS call_ord
FROM lineitem WHERE l_tax > 0.075 OR l_tax < 0.005""",
    "calls": """
SELECT f.sym, l.call_ord, CAST(CASE WHEN f.id % 7 = 0 THEN l.l_linenumber % 3 ELSE 0 END AS INT) AS body_ix, l.l_shipdate,
  CASE WHEN l.l_returnflag = 'R' AND l.l_tax > 0.075 THEN 'resolved' WHEN l.l_returnflag = 'A' AND l.l_tax < 0.005 THEN 'stub' WHEN l.l_returnflag = 'N' AND l.l_tax > 0.075 THEN 'unresolved'
       WHEN l.l_returnflag = 'A' THEN 'mutation' WHEN l.l_returnflag = 'R' THEN 'known-pure' ELSE 'inlined' END AS kind,
  CASE WHEN l.l_returnflag = 'R' AND l.l_tax > 0.075 THEN g.sym END AS callee,
  CASE WHEN l.l_returnflag = 'A' AND l.l_tax < 0.005 THEN e.token END AS effect,
  CASE WHEN l.l_returnflag = 'A' AND l.l_tax < 0.005 AND e.ord = 0 AND l.l_linenumber < 6 THEN 'http:' || (CASE WHEN l.l_linenumber = 1 THEN 'post' WHEN l.l_linenumber = 2 THEN 'put' ELSE 'get' END) || ':' || h.host END AS req_cap,
  l.l_returnflag = 'A' AND l.l_tax < 0.005 AND e.ord = 0 AND l.l_linenumber >= 6 AS cap_target_unknown,
  CASE WHEN l.l_returnflag = 'N' AND l.l_tax > 0.075 THEN 'reason-' || CAST(l.l_suppkey % 12 AS STRING) END AS reason,
  CASE WHEN l.l_returnflag = 'N' AND l.l_tax > 0.075 AND l.l_suppkey % 5 <> 0 THEN 'op' || CAST(l.l_orderkey % 23 AS STRING) END AS operation,
  l.l_returnflag = 'A' AND l.l_tax > 0.075 AND l.l_quantity > 40 AS escaping,
  l.l_returnflag = 'A' AND l.l_tax > 0.075 AND l.l_discount > 0.095 AS unknown_callback
FROM line l JOIN fn f ON f.id = l.l_partkey
JOIN fn g ON g.id = (l.l_orderkey + l.l_suppkey * 7) % (SELECT count(*) FROM part)
JOIN effects e ON e.ord = l.l_suppkey % 9
JOIN hosts h ON h.page_id = l.l_suppkey % (SELECT count(*) FROM pages)""",
    "ledger": """
SELECT CASE WHEN o.o_orderstatus = 'F' THEN 'base' ELSE 'head' END AS side, o.o_orderkey AS line, f.sym, 'effect' AS kind, e.token AS name
FROM orders o JOIN fn f ON f.id = o.o_custkey % (SELECT count(*) FROM part) JOIN effects e ON e.ord = o.o_orderkey % 9""",
    "config": """
SELECT id, sym AS key, file AS decl_path, 'f' || CAST(id AS STRING) AS decl_sym, TRUE AS exact FROM fn WHERE id % 11 = 0
UNION ALL SELECT id, 'lib/1*.ts#f' || CAST(id AS STRING), 'lib/1*.ts', 'f' || CAST(id AS STRING), FALSE FROM fn WHERE id % 3 = 0
UNION ALL SELECT id, 'lib/**.ts#f' || CAST(id AS STRING), 'lib/**.ts', 'f' || CAST(id AS STRING), FALSE FROM fn WHERE id % 26 = 0
UNION ALL SELECT id, 'src/x.ts#f' || CAST(id AS STRING), 'src/x.ts', 'f' || CAST(id AS STRING), TRUE FROM fn WHERE id % 17 = 0""",
    "config_tags": """
SELECT key, 'effects' AS tag, CASE WHEN id % 2 = 0 THEN 'network' ELSE 'db_read,fs_read' END AS value FROM config WHERE id % 5 <> 0
UNION ALL SELECT key, 'capabilities', 'http:get:*' FROM config WHERE id % 4 <> 1
UNION ALL SELECT key, 'budget', 'timeMs=' || CAST(id % 2 * 1000 AS STRING) FROM config WHERE id % 5 <> 1
UNION ALL SELECT key, 'boundary', CASE WHEN id % 2 = 0 THEN 'vendor' ELSE 'reviewed' END FROM config WHERE id % 7 = 0
UNION ALL SELECT key, 'entrypoint', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END FROM config WHERE id % 4 < 2""",
    "contract_tags": f"""
SELECT f.sym, 'effects' AS tag, f.eff_kind AS kind, CASE WHEN f.eff_kind = 'declared' THEN {_EFFECTS_TEXT} END AS value FROM fn f LEFT JOIN declared_effects d ON d.sym = f.sym GROUP BY f.sym, f.eff_kind
UNION ALL SELECT f.sym, 'capabilities', f.cap_kind, d.resource || ':' || d.action || ':' || d.target FROM fn f LEFT JOIN declared_caps d ON d.sym = f.sym
UNION ALL SELECT sym, 'budget', bud_kind, CASE WHEN bud_kind = 'declared' THEN 'timeMs=' || CAST(id % 3 * 1000 AS STRING) END FROM fn
UNION ALL SELECT sym, 'boundary', bnd_kind, CASE WHEN bnd_kind = 'declared' THEN 'reviewed' END FROM fn
UNION ALL SELECT sym, 'entrypoint', CASE WHEN entrypoint THEN 'declared' ELSE 'none' END, CASE WHEN entrypoint THEN 'true' END FROM fn""",
    "specs": """
SELECT sym, CAST(1 AS INT) AS ord, 'http:put:*' AS caps, 'timeMs=9000' AS budget FROM fn WHERE id % 6 = 1
UNION ALL SELECT sym, CAST(2 AS INT), 'http:get:*', CASE WHEN id % 2 = 0 THEN 'timeMs=100' END FROM fn WHERE id % 3 = 1""",
    "wrappers": """
SELECT id AS wrapper, CASE WHEN id % 10 = 3 THEN 'gone#x' WHEN id % 10 <> 4 THEN sym END AS handler,
  CASE WHEN id % 7 <> 2 THEN 'http:' || (CASE WHEN id % 2 = 0 THEN 'put' ELSE 'get' END) || ':*' END AS caps,
  CASE WHEN id % 5 = 0 THEN 'none' WHEN id % 5 < 4 THEN 'timeMs=' || CAST(id % 3 * 1000 AS STRING) END AS w_budget
FROM fn WHERE id % 4 < 2""",
    "ledger_lines": "SELECT side, line, sym, line % 1000 = 17 AND side = 'head' AS heading FROM ledger",
    "runtime_calls": """
SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN '/srv/./a//' WHEN event_id % 3 = 1 THEN '/srv/b/../' ELSE '/' END || CAST(user_id AS STRING) AS path_a, '/out/' || event_type AS path_b,
  CASE WHEN event_id % 5 = 0 THEN 'r' WHEN event_id % 5 = 1 THEN 'w' WHEN event_id % 5 = 2 THEN 'a+' WHEN event_id % 5 = 3 THEN 'r+' END AS flags,
  CASE WHEN event_id % 3 = 0 THEN 'spawn' WHEN event_id % 3 = 1 THEN 'exec' ELSE 'fork' END AS kind,
  CASE WHEN event_id % 4 < 3 THEN event_type END AS command, CASE WHEN event_id % 7 = 0 THEN 'true' WHEN event_id % 7 = 1 THEN '/bin/zsh' WHEN event_id % 7 = 2 THEN 'false' END AS shell,
  CASE WHEN event_id % 4 = 0 THEN 'main' WHEN event_id % 4 = 1 THEN '' END AS db, CASE WHEN event_id % 5 < 3 THEN 'pg://u@h:5432/' || (CASE WHEN event_id % 5 = 2 THEN '' ELSE event_type END) END AS connection,
  CASE WHEN event_id % 3 = 0 THEN 'select 1' WHEN event_id % 3 = 1 THEN 'INSERT x' ELSE 'with y' END AS statement, event_id % 19 AS op
FROM events""",
    "audit_req": """
SELECT user_id AS ctx, event_id AS seq, ts, value AS cost, 'http:' || (CASE WHEN event_type = 'purchase' THEN 'post' ELSE 'get' END) || ':' ||
  (CASE WHEN event_id % 3 = 0 THEN 'api.example.com' WHEN event_id % 3 = 1 THEN 'cdn.example.org' ELSE 'localhost:8080' END) AS cap FROM events""",
    "grants": """
SELECT DISTINCT user_id AS ctx, CASE WHEN user_id % 3 = 0 THEN 'http:get:*' WHEN user_id % 3 = 1 THEN 'http:get:*.example.com' ELSE 'http:post:api.?xample.com' END AS cap
FROM events WHERE user_id % 5 <> 4""",
    "log_events": """
SELECT user_id AS stream, event_id AS ord, ts, CASE WHEN event_type = 'error' THEN 'command' ELSE 'edit' END AS kind, 'f' || CAST(event_id % 25 AS STRING) AS file,
  event_type = 'error' AND event_id % 2 = 0 AS touches_src, CAST(value AS DOUBLE) AS cost FROM events""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def with_views(body: str) -> str:
    """The DuckDB statement: all views as common table expressions, then the body."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items()) + body


class Facts:
    """The views over one folder of tables, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                import re

                text = VIEWS[name]
                needs = [n for n in [*VIEWS, *TABLES] if n != name and re.search(rf"(?:FROM|JOIN) {n}\b", text)]
                for n in needs:
                    text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
                self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in needs})
        return self._made[name]


def read_facts(spark: SparkSession, folder: str, name: str, snapshot: str | None = None) -> DataFrame:
    """A fact table an extractor wrote, of one snapshot where it is partitioned by snapshot."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df.where(df["snapshot"] == snapshot) if snapshot is not None else df
