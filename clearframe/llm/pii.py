"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Generators with high recall propose spans that may overlap: the four base formats, and looser ones
(assigned secrets, key identifiers, local telephone numbers, spelled-out addresses).  Boosted trees
score each candidate from its format and the words before it; a threshold for each kind, calibrated
on labelled examples (``pii_fit``), selects.  Base spans that pass their checks always stay; what
overlaps them, or a better candidate, goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pii_trees import BASE_SCORE, THRESHOLDS, TREES

#: Base formats.  Possessive runs and the look-behind keep them linear on long texts; a run that
#: fails at its start fails everywhere inside, so they match what the plain patterns match.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions; most documents stop here.
_GATES = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "secret": r"(?i)(?:passw|pwd|secret|token|api.?key)[a-z]{0,4}\s{0,3}[=:]",
    "key": r"[A-Z]{4}[A-Z0-9]{12}",
    "local_phone": r"(?:\(0?[0-9]{2,4}\)|0[0-9]{2,4})[\x20./-]?[0-9]{3}",
    "spelled_email": r"(?i)[\[(]\s?at\s?[\])]",
}
LOOSE = {
    "secret": r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9+/_-]{8,}+\"?",
    "key": r"(?<![A-Za-z0-9])[A-Z]{4}[A-Z0-9]{12,28}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+.-])(?:\(0?[0-9]{2,4}\)|0[0-9]{2,4})[\x20./-]?[0-9]{3}[\x20./-]?[0-9]{3,4}(?![0-9])",
    "spelled_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[a-z0-9-]{1,63}){1,5}",
}
KINDS = [*BASE, *LOOSE]
_CUES = r"(?i)(?:phone|tel|call|fax|mobile|contact|mail|card|account|login|key|credential|passw|secret|token)[^\n]{0,12}$"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "cue", "valid", "hexes", "runs")


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Matches of a pattern as structs (kind, start, end, value), in code points, end exclusive.

    The pieces between the matches give their places, so two passes of the pattern are enough.
    """
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    pairs = F.arrays_zip(hits.alias("h"), F.slice(between, 1, F.size(between) - 1).alias("b"))
    start = lambda acc, x: acc["at"] + F.length(x["b"])
    end = lambda acc, x: start(acc, x) + F.length(x["h"])
    placed = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            end(acc, x).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start(acc, x).alias("start"), end(acc, x).alias("end"), x["h"].alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(_GATES[kind]), placed).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    total = F.aggregate(F.transform(F.split(digits, "(?!$)"), lambda c, i: doubled(F.ascii(c) - 48, i)), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The checks a base match must pass."""
    count = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(count.between(13, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda s: valid(kind, s["value"])


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def features(text: Column, span: Column) -> dict[str, Column]:
    value = span["value"]
    gone = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    before = F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24)))
    n = F.length(_digits(value))
    sound = F.when(F.lower(span["kind"]) == "key", n >= 1).when(span["kind"] == "secret", n >= 1).when(span["kind"] == "local_phone", n.between(9, 11)).otherwise(True)
    return {
        "length": F.length(value),
        "digits": n,
        "uppers": gone("[A-Z]"),
        "lowers": gone("[a-z]"),
        "marks": gone("[A-Za-z0-9]"),
        "cue": before.rlike(_CUES).cast("int"),
        "valid": sound.cast("int"),
        "hexes": F.length(F.regexp_extract(value, r"[0-9a-f]{8,}+", 0)),
        "runs": F.size(F.split(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) - 1,
    }


def score(values: dict[str, Column]) -> Column:
    """Probability from the boosted trees: each is (split, its left and right splits, four leaves)."""
    total = F.lit(float(BASE_SCORE))
    for (f0, t0), (f1, t1), (f2, t2), leaves in TREES:
        low = F.when(values[f1] <= t1, leaves[0]).otherwise(leaves[1])
        high = F.when(values[f2] <= t2, leaves[2]).otherwise(leaves[3])
        total = total + F.when(values[f0] <= t0, low).otherwise(high)
    return 1 / (1 + F.exp(-total))


def candidates(docs: DataFrame) -> DataFrame:
    """The documents with ``pii_base`` (checked base spans) and ``pii_loose`` (all other candidates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({f"pii_{kind}": F.filter(_found(text, kind, pattern), _passes(kind)) for kind, pattern in BASE.items()})
    found = found.withColumns({f"pii_{kind}": _found(text, kind, pattern) for kind, pattern in LOOSE.items()})
    found = found.withColumn("pii_base", F.concat(*[F.col(f"pii_{k}") for k in BASE])).withColumn("pii_loose", F.concat(*[F.col(f"pii_{k}") for k in LOOSE]))
    return found.drop(*[f"pii_{k}" for k in KINDS])


def detected(docs: DataFrame) -> DataFrame:
    """The documents with ``pii_base`` and ``pii_spans``: arrays of (kind, start, end, value).

    A null text counts as empty.  Spans are in the order of the kinds, then of their starts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = candidates(docs)
    chance = F.transform("pii_loose", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score(features(text, s)).alias("p")))
    found = found.withColumn("pii_loose", F.when(F.size("pii_loose") > 0, chance))
    cut = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    good = F.filter("pii_loose", lambda s: (s["p"] >= cut[s["kind"]]) & ~F.exists("pii_base", lambda b: meets(s, b)))
    found = found.withColumn("pii_loose", good)
    rank = lambda s: F.struct(-s["p"], s["start"], s["end"], s["kind"])
    best = F.filter("pii_loose", lambda s: ~F.exists("pii_loose", lambda o: meets(s, o) & (rank(o) < rank(s))))
    plain = F.transform(best, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    spans = F.when(F.size("pii_loose") > 0, F.concat("pii_base", plain)).otherwise(F.col("pii_base"))
    return found.withColumn("pii_spans", spans).drop("pii_loose")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base kinds, base_sha256 and all spans as text."""
    found = detected(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("pii_base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed("pii_base"), 256).alias("base_sha256"), _listed("pii_spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans join.

    All columns stay; ``n_chars``, where present, follows the new text.  A null text stays null.
    """
    places = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"), last(acc)["kind"].alias("kind"))))
    merged = F.aggregate(places, none, lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), joined(acc, s)).otherwise(F.concat(acc, F.array(s))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = detected(docs.select(row.alias("row"), F.col("text"))).withColumn("pii_merged", F.when(F.size("pii_spans") > 0, merged))
    text = F.col("text")
    done = lambda i: F.coalesce(F.get("pii_merged", i - 1)["end"], F.lit(0))
    piece = lambda s, i: F.concat(F.substring(text, done(i) + 1, s["start"] - done(i)), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    tail = F.substring(text, F.element_at("pii_merged", -1)["end"] + 1, F.length(text))
    new = F.concat(F.array_join(F.transform("pii_merged", piece), ""), tail)
    new = F.when(F.col("pii_merged").isNotNull(), new).otherwise(text)
    follow = {"text": new, "n_chars": F.length(new)}
    kept = [follow[f.name].cast(f.dataType).alias(f.name) if f.name in follow else F.col("row").getField(f.name).alias(f.name) for f in docs.schema.fields]
    return found.select(*kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))
