"""The same results as DuckDB SQL: shared common table expressions, then one body for each query."""

from __future__ import annotations

from ..sources.facts import VIEWS

_GLOB = r"regexp_matches({value}, '(?s)^' || replace(replace(regexp_replace({pattern}, '([\\.\[\]{{}}()+^$|/-])', '\\\1', 'g'), '*', '.*'), '?', '.') || '$')"


def glob(pattern: str, value: str) -> str:
    return f"({pattern} = {value} OR {_GLOB.format(pattern=pattern, value=value)})"


STATE: dict[str, str] = {
    "snapfn": "SELECT f.*, s.snap FROM fn f, (VALUES ('all'), ('base'), ('head')) s(snap) WHERE s.snap = 'all' OR (s.snap = 'base' AND f.id % 20 <> 0) OR (s.snap = 'head' AND f.id % 20 <> 1)",
    "scalls": "SELECT c.*, s.snap, c.kind = 'unresolved' OR (c.kind = 'mutation' AND c.unknown_callback) AS blocks FROM calls c JOIN snapfn s ON s.sym = c.sym WHERE s.snap <> 'base' OR c.l_shipdate < TIMESTAMP '2001-01-01'",
    "node": """SELECT snap, 'e' AS lattice, sym, eff_kind = 'declared' AS declared, bnd_kind = 'declared' AS boundary FROM snapfn
UNION ALL SELECT snap, 'c', sym, cap_kind = 'declared', bnd_kind = 'declared' FROM snapfn""",
    "decl": """SELECT n.snap, n.lattice, n.sym, d.token FROM node n JOIN (SELECT 'e' AS lattice, sym, token FROM declared_effects UNION ALL
SELECT 'c', sym, resource || ':' || action || ':' || target FROM declared_caps) d ON d.sym = n.sym AND d.lattice = n.lattice WHERE n.declared""",
    "direct_by_body": """SELECT DISTINCT snap, 'e' AS lattice, sym, body_ix, effect AS token FROM scalls WHERE kind = 'stub'
UNION SELECT snap, 'e', sym, body_ix, 'network' FROM scalls WHERE kind = 'stub' AND effect = 'llm'
UNION SELECT snap, 'e', sym, body_ix, 'state_write' FROM scalls WHERE kind = 'mutation' AND escaping
UNION SELECT snap, l, sym, body_ix, '?' FROM scalls, (VALUES ('e'), ('c')) t(l) WHERE blocks
UNION SELECT snap, 'c', sym, body_ix, req_cap FROM scalls WHERE req_cap IS NOT NULL
UNION SELECT snap, 'c', sym, body_ix, '?' FROM scalls WHERE cap_target_unknown""",
    "direct": "SELECT DISTINCT snap, lattice, sym, token FROM direct_by_body",
    "edge": "SELECT DISTINCT n.snap, n.lattice, c.callee, c.sym AS caller FROM scalls c JOIN node n ON n.snap = c.snap AND n.sym = c.sym WHERE c.kind = 'resolved' AND NOT n.boundary",
    "state": """SELECT n.snap, n.lattice, n.sym, CASE WHEN n.declared THEN d.token ELSE '?' END AS token FROM node n
  LEFT JOIN decl d ON d.snap = n.snap AND d.lattice = n.lattice AND d.sym = n.sym WHERE n.boundary AND (d.token IS NOT NULL OR NOT n.declared)
UNION SELECT d.snap, d.lattice, d.sym, d.token FROM direct d JOIN node n ON n.snap = d.snap AND n.lattice = d.lattice AND n.sym = d.sym WHERE NOT n.boundary
UNION SELECT e.snap, e.lattice, e.caller, d.token FROM edge e JOIN decl d ON d.snap = e.snap AND d.lattice = e.lattice AND d.sym = e.callee
UNION SELECT e.snap, e.lattice, e.caller, s.token FROM state s JOIN edge e ON e.snap = s.snap AND e.lattice = s.lattice AND e.callee = s.sym
  JOIN node n ON n.snap = s.snap AND n.lattice = s.lattice AND n.sym = s.sym AND NOT n.declared""",
    "contribution": "SELECT s.* FROM state s JOIN node n ON n.snap = s.snap AND n.lattice = s.lattice AND n.sym = s.sym WHERE NOT n.declared UNION ALL SELECT * FROM decl",
    "inherited": """SELECT c.snap, n.lattice, c.sym, c.body_ix, c.call_ord, c.callee, k.token FROM scalls c JOIN node n ON n.snap = c.snap AND n.sym = c.sym AND NOT n.boundary
JOIN contribution k ON k.snap = c.snap AND k.lattice = n.lattice AND k.sym = c.callee WHERE c.kind = 'resolved'""",
    "witness": """SELECT snap, lattice, sym, token, arg_min(callee, call_ord) AS callee FROM inherited i
WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.snap = i.snap AND d.lattice = i.lattice AND d.sym = i.sym AND d.token = i.token AND (d.lattice = 'e' OR d.token = '?')) GROUP BY ALL""",
    "held": "SELECT s.* FROM state s JOIN node n ON n.snap = s.snap AND n.lattice = s.lattice AND n.sym = s.sym WHERE n.declared AND NOT n.boundary AND s.token <> '?'",
    "excess": f"""SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.snap = h.snap AND d.lattice = h.lattice AND d.sym = h.sym AND
  ((h.lattice = 'e' AND d.token = h.token) OR (h.lattice = 'c' AND split_part(d.token, ':', 1) = split_part(h.token, ':', 1) AND split_part(d.token, ':', 2) = split_part(h.token, ':', 2)
   AND {glob("regexp_replace(d.token, '^[^:]*:[^:]*:', '')", "regexp_replace(h.token, '^[^:]*:[^:]*:', '')")})))""",
    "ops": """SELECT c.snap, c.sym, CASE WHEN c.kind = 'mutation' THEN 'callback-by-reference' ELSE c.reason END AS reason, c.operation, count(*) AS n
FROM scalls c JOIN snapfn f ON f.snap = c.snap AND f.sym = c.sym WHERE c.blocks AND f.bnd_kind <> 'declared' GROUP BY ALL""",
    "bodies": """SELECT DISTINCT b.* FROM (SELECT snap, lattice, sym, body_ix, token FROM direct_by_body UNION SELECT snap, lattice, sym, body_ix, token FROM inherited) b
WHERE (SELECT count(DISTINCT body_ix) FROM scalls c WHERE c.snap = b.snap AND c.sym = b.sym) > 1
  AND (SELECT count(*) FROM node n WHERE n.snap = b.snap AND n.sym = b.sym AND NOT n.declared AND NOT n.boundary) = 2""",
    "holdings": "SELECT * FROM bodies UNION ALL SELECT k.snap, k.lattice, k.sym, 0, k.token FROM contribution k WHERE NOT EXISTS (SELECT 1 FROM bodies b WHERE b.snap = k.snap AND b.sym = k.sym)",
    "presence": "SELECT sym, bool_or(snap = 'base') AS in_base, bool_or(snap = 'head') AS in_head FROM snapfn WHERE snap IN ('base', 'head') GROUP BY sym",
    "refs": "SELECT sym, lattice, token, bool_or(snap = 'base') AS of_base, bool_or(snap = 'head') AS of_head FROM contribution WHERE token <> '?' AND snap IN ('base', 'head') GROUP BY ALL",
    "counts": f"""SELECT r.sym, r.lattice, r.token, count(DISTINCT CASE WHEN h.snap = 'base' THEN h.body_ix END) AS base, count(DISTINCT CASE WHEN h.snap = 'head' THEN h.body_ix END) AS head
FROM refs r LEFT JOIN holdings h ON h.sym = r.sym AND h.lattice = r.lattice AND h.token <> '?' AND h.snap IN ('base', 'head') AND (h.token = r.token OR (r.lattice = 'c'
  AND split_part(h.token, ':', 1) = split_part(r.token, ':', 1) AND split_part(h.token, ':', 2) = split_part(r.token, ':', 2)
  AND {glob("regexp_replace(h.token, '^[^:]*:[^:]*:', '')", "regexp_replace(r.token, '^[^:]*:[^:]*:', '')")})) GROUP BY ALL""",
    "changes": """SELECT * FROM (SELECT r.sym, r.lattice, r.token, CASE WHEN NOT p.in_base THEN 'new' WHEN NOT p.in_head THEN 'deleted' ELSE 'present' END AS status,
  CASE WHEN r.of_head AND c.head > c.base THEN 'added' WHEN r.of_base AND c.base > c.head THEN 'removed' END AS change
FROM refs r JOIN counts c ON c.sym = r.sym AND c.lattice = r.lattice AND c.token = r.token JOIN presence p ON p.sym = r.sym) WHERE change IS NOT NULL""",
    "force": """SELECT sym, kind, name, line, n - coalesce(spent, 0) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY sym, kind, name ORDER BY line) AS n FROM ledger WHERE side = 'head') h
LEFT JOIN (SELECT sym AS s, kind AS k, name AS m, count(*) AS spent FROM ledger WHERE side = 'base' GROUP BY ALL) b ON s = sym AND k = kind AND m = name WHERE n > coalesce(spent, 0)""",
    "increase": "SELECT sym, CASE WHEN lattice = 'e' THEN 'effect' ELSE 'capability' END AS kind, token AS name FROM changes WHERE change = 'added'",
    "flags": "SELECT snap, sym, coalesce(bool_or(lattice = 'e'), false) AS eff_unknown, coalesce(bool_or(lattice = 'c'), false) AS cap_unknown FROM state WHERE token = '?' GROUP BY ALL",
}

#: Expressions that are read more than once and worth keeping.
_KEEP = {"line", "calls", "scalls", "contribution", "inherited", "direct_by_body", "holdings", "bodies", "counts"}


def statement(body: str) -> str:
    parts = {**VIEWS, **STATE}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS {'MATERIALIZED ' if name in _KEEP else ''}({text})" for name, text in parts.items()) + "\n" + body
