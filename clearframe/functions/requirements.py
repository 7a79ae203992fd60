"""Capabilities that a runtime call requires, as arrays of Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FS_RULES
from .scalars import format_capability, host_of, sql_direction


def fetch_requirement(method: Column, url: Column) -> Column:
    """``http:<method>:<host>``; the host has no port that is its scheme's default."""
    port = F.when(url.startswith("https:"), ":443").when(url.startswith("http:"), ":80")
    host = host_of(url)
    return format_capability(F.lit("http"), F.lower(method), F.when(F.endswith(host, port), F.substring_index(host, ":", 1)).otherwise(host))


def resolved_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def file_requirements(operation: Column, args: Column) -> Column:
    """Reads, then writes, of the path arguments an operation names; null arguments need nothing."""
    needed = []
    for verb in ("read", "write"):
        for position in (0, 1):
            names = [n for n, rule in FS_RULES.items() if position in rule.get(verb, ())]
            if names:
                needed.append(F.when(operation.isin(*names), F.concat(F.lit(f"fs:{verb}:"), resolved_path(F.get(args, position)))))
    return F.array_compact(F.array(*needed))


def open_requirements(path: Column, flags: Column) -> Column:
    """By flags: ``r`` first or ``+`` reads; ``w``, ``a`` or ``+`` writes; no flags read."""
    flags = F.coalesce(flags, F.lit("r"))
    reads, writes = flags.startswith("r") | flags.contains("+"), F.regexp_like(flags, F.lit("[wa+]"))
    need = lambda verb: F.concat(F.lit(f"fs:{verb}:"), resolved_path(path))
    return F.array_compact(F.array(F.when(reads, need("read")), F.when(writes, need("write"))))


def spawn_requirement(kind: Column, command: Column, shell: Column, own_binary: str, default_shell: str = "/bin/sh") -> Column:
    """The program as written; through a shell the shell; a fork is the own binary.

    ``shell`` is null or ``false`` for none, ``true`` for the default one, else its path.
    """
    named = F.when(shell == "true", default_shell).when(shell != "false", shell)
    named = F.when(kind == "exec", F.coalesce(named, F.lit(default_shell))).otherwise(named)
    return F.concat(F.lit("proc:spawn:"), F.when(kind == "fork", own_binary).otherwise(F.coalesce(named, command, F.lit("unknown"))))


def database_requirements(database: Column, connection: Column, statement: Column) -> Column:
    """Reads, writes or both of the database that is named or is the path of the connection."""
    path = F.nullif(F.regexp_extract(connection, r"^[a-z]+://[^/?#]*/([^?#]*)", 1), F.lit(""))
    target = F.coalesce(F.nullif(database, F.lit("")), F.try_url_decode(path), F.lit("unknown"))
    way = F.coalesce(sql_direction(statement), F.lit("both"))
    return F.array_compact(F.array(*[F.when(way.isin(verb, "both"), F.concat(F.lit(f"db:{verb}:"), target)) for verb in ("read", "write")]))
