"""Scalar rules as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import PREFIXABLE, SQL_READ, SQL_WRITE

_NAME = r"[A-Za-z0-9_.?\[\]{}@/-]+"


def capability_parts(token: Column) -> Column:
    """Struct (resource, action, target), or null: two names without ``*`` and a free target."""
    text = F.trim(token)
    shape = rf"^({_NAME}):({_NAME}):([^,\x00-\x1f\x7f]+)\z"
    part = lambda i: F.regexp_extract(text, shape, i)
    return F.when(text.rlike(shape), F.struct(part(1).alias("resource"), part(2).alias("action"), part(3).alias("target")))


def capabilities_tag(text: Column) -> Column:
    """Array of texts if every comma-separated token is a capability, else null; duplicates stay."""
    tokens = F.transform(F.split(text, ","), lambda t: F.trim(t))
    return F.when(F.forall(tokens, lambda t: capability_parts(t).isNotNull()), tokens)


def format_capability(resource: Column, action: Column, target: Column) -> Column:
    return F.concat(resource, F.lit(":"), action, F.lit(":"), target)


def _escaped(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|/-])", r"\\$1")


def glob_regex(pattern: Column) -> Column:
    """Target globs: ``*`` is any run and crosses slashes, ``?`` exactly one character."""
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(_escaped(pattern), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def glob_matches(pattern: Column, value: Column) -> Column:
    return (pattern == value) | F.regexp_like(value, glob_regex(pattern))


def path_glob_regex(pattern: str) -> str:
    """Path globs: ``*`` within a segment, ``**`` across, ``**/`` any directories; ``?`` is itself."""
    out, i = "", 0
    while i < len(pattern):
        for mark, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*")):
            if pattern.startswith(mark, i):
                out, i = out + regex, i + len(mark)
                break
        else:
            out, i = out + ("\\" if pattern[i] in r"\.[]{}()+^$|?" else "") + pattern[i], i + 1
    return rf"^{out}\z"


def path_glob_pattern(glob: Column) -> Column:
    """The same for a column of globs."""
    text = F.replace(_escaped(glob), F.lit("?"), F.lit("\\?"))
    for mark, regex in (("**\\/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        text = F.replace(text, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), text, F.lit(r"\z"))


def sql_direction(text: Column) -> Column:
    word = F.lower(F.regexp_extract(text, r"(?i)^[\s(]*([a-z]+)", 1))
    return F.when(word.isin(*SQL_READ), "read").when(word.isin(*SQL_WRITE), "write").otherwise("both")


def host_of(url: Column, complete: Column | None = None) -> Column:
    """The authority as written, port kept, user part gone; null if the text does not fix it."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    authority = F.lower(F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), r"(?s)^.*@", ""))
    fixed = F.contains(url, F.lit("://")) & (F.regexp_like(rest, F.lit(r"[/?#]")) | (complete if complete is not None else F.lit(True)))
    return F.when(fixed & (authority != ""), authority)


def with_node_prefix(name: Column) -> Column:
    module = F.regexp_extract(name, r"^([^.]*)\.", 1)
    return F.when(module.isin(*PREFIXABLE), F.concat(F.lit("node:"), name)).otherwise(name)


def display_name(sym: Column) -> Column:
    path = F.element_at(F.split(sym, "#"), -1)
    parts = F.split(path, r"\.")
    last = F.element_at(parts, -1)
    return F.when((last == "constructor") & (F.size(parts) > 1), F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(last)


def approval_symbol(subdir: Column, sym: Column) -> Column:
    parts = F.filter(F.split(F.concat(subdir, F.lit("/"), sym), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(parts, "/")


def boundary_reason(text: Column) -> Column:
    part = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.coalesce(part(r'reason="([^"]*)"'), part(r"reason='([^']*)'"), part(r"reason=([^\s\"']+)"))


def budget_fields(text: Column) -> Column:
    """Struct (time_ms, cost_usd, llm_calls, on_exceed), or null if any token is wrong."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    key = lambda t: F.substring_index(t, "=", 1)
    number = lambda k: F.regexp_extract(text, rf"(?:^|\s){k}=(\S+)", 1).try_cast("double")
    on = F.regexp_extract(text, r"(?:^|\s)onExceed=(\S+)", 1)
    names = F.transform(tokens, key)
    known = F.forall(tokens, lambda t: t.rlike(r"^(?:timeMs|costUsd|llmCalls)=[0-9]+(?:\.[0-9]+)?$|^onExceed=(?:throw|warn)$"))
    whole = F.coalesce(number("llmCalls") == F.floor(number("llmCalls")), F.lit(True))
    limited = F.exists(names, lambda n: n != "onExceed")
    good = known & whole & limited & (F.size(names) == F.size(F.array_distinct(names)))
    return F.when(good, F.struct(number("timeMs").alias("time_ms"), number("costUsd").alias("cost_usd"), number("llmCalls").alias("llm_calls"), F.when(on == "", "throw").otherwise(on).alias("on_exceed")))


def annotation_data(text: Column) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotation_property(text: Column) -> Column:
    return F.replace(F.replace(annotation_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def authority_ref(token: Column) -> Column:
    shape = r"(?s)^(effect|capability):(.+)\z"
    return F.when(token.rlike(shape), F.struct(F.regexp_extract(token, shape, 1).alias("kind"), F.regexp_extract(token, shape, 2).alias("name")))
