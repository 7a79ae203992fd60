"""Language identification by Bayesian evidence fusion.

Four kinds of evidence multiply: the likelihood of the text under byte-trigram models, the declared
markup language, the suffix of the address, and a prior for the host.  Host priors are smoothed
hierarchically: a host leans on its site, a site on the whole corpus.  They come from grouped sums
of the posteriors that text and declarations give, so no host's rows meet in one task.

The trigram models are fitted on a bounded sample of labelled rows (``SAMPLE`` of each language);
priors and reliabilities are counted over all rows.  Documents have no address: there the suffix is
silent and the host prior has two levels, source and corpus; pages use all four kinds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table, unused

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled rows of each language that fit the trigram models.
SAMPLE = 500
#: Strength, in rows, of a site's prior over a host's counts, and of the corpus over a site's.
HOST_STRENGTH, SITE_STRENGTH = 20.0, 50.0
#: What a declaration or suffix is worth is counted over all rows; before any is counted it is right
#: this often, and that weighs as much as so many rows.
RIGHT, STRENGTH = 0.9, 50.0
#: Trigrams of one text are not independent: their joint log likelihood counts this much of its sum,
#: and no text counts as more than so many trigrams.
TEMPER, MOST_TRIGRAMS = 0.3, 400.0
#: Fit is the mean log likelihood per trigram against a uniform model.  A text is in no known language
#: where it is below this share of the fit that all but the lowest part of the declared rows reach; texts
#: in two of the languages fit about half as well.  The bar rises with length: half of it at SHORT trigrams.
FLOOR, LOWEST, SHORT = 0.3, 0.05, 20.0
_BINS = 1 << 16


def _codes(data: np.ndarray) -> np.ndarray:
    """Bins of all byte trigrams of a lower-cased byte string padded with spaces."""
    x = data.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


def _letters() -> np.ndarray:
    """Byte map: letters lower-cased, bytes of longer characters kept, all else a space."""
    out = np.full(256, 32, np.uint8)
    for b in range(256):
        if chr(b).isalpha() and b < 128 or b >= 128:
            out[b] = ord(chr(b).lower()) if b < 128 else b
    return out


_MAP = _letters()


def _text_codes(text: bytes) -> np.ndarray:
    data = _MAP[np.frombuffer(b" " + text + b" ", np.uint8)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)  # runs of spaces count once
    data = data[keep]
    return _codes(data) if len(data) > 3 else np.zeros(0, np.int64)


def _folded(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((len(LANGUAGES), _BINS), np.int64)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = _text_codes(_folded(text))
            totals[LANGUAGES.index(lang)] += np.bincount(codes, minlength=_BINS)
    which, code = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(code, pa.int32()), pa.array(totals[which, code])], ["which", "code", "n"])


def trigram_model(labelled: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log likelihood ratios of bins against a uniform model, one row for each language.

    ``labelled`` has doc_id, text, lang.  The sample is drawn by a hash of doc_id; the collected
    table has at most one entry for each language and bin.
    """
    spark = labelled.sparkSession
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))  # limited before the exchange
    drawn = labelled.where(F.col("lang").isin(*LANGUAGES)).select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("place", place).where(F.col("place") <= sample)
    ids = sorted({r["doc_id"] for r in drawn.select("doc_id").collect() if r["doc_id"] is not None})
    chosen = spark.createDataFrame([(i,) for i in ids], "chosen long")
    rows = labelled.where(F.col("lang").isin(*LANGUAGES)).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi")
    counts = rows.select("lang", F.col("text").cast("string")).mapInArrow(_counted, "which int, code int, n long").groupBy("which", "code").agg(F.sum("n").alias("n")).toPandas()
    table_ = np.full((len(LANGUAGES), _BINS), 0.5)
    table_[counts["which"].to_numpy(int), counts["code"].to_numpy(int)] += counts["n"].to_numpy()
    return np.log(table_ / table_.sum(1, keepdims=True) * _BINS).astype(np.float32)


def _scored(model: np.ndarray):
    columns = np.ascontiguousarray(model.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = np.zeros((batch.num_rows, len(LANGUAGES))), np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                codes = _text_codes(_folded(text.as_py()))
                n[i] = len(codes)
                if len(codes):
                    used = np.bincount(codes, minlength=_BINS) if len(codes) > 4 * _BINS else None
                    sums[i] = used @ columns if used is not None else columns[codes].sum(0, dtype=np.float64)
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            scale = TEMPER * np.minimum(1, MOST_TRIGRAMS / np.maximum(n, 1))
            logs = pa.array((sums * scale[:, None]).tolist(), pa.list_(pa.float64()))
            fit = pa.array(np.where(n > 0, sums.max(1) / np.maximum(n, 1), 0.0))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), fit, logs], [*(c for c in batch.schema.names if c != "text"), "n_trigrams", "fit", "logs"])

    return run


def _said(column: str) -> Column:
    said = F.lower(F.substring(F.col(column), 1, 2))
    return F.when(said.isin(*LANGUAGES), said)


def _reliability(scored: DataFrame, column: str) -> dict[str, list[float]]:
    """For each language said, the log likelihood of saying it under each language.

    Counted over all rows: grouped sums of the posteriors that the text alone gives.
    """
    text = _normal([F.col("logs")[i] for i in range(len(LANGUAGES))])
    own = scored.where("n_trigrams > 0").select(_said(column).alias("said"), text.alias("p")).where("said is not null")
    sums = {r["said"]: r for r in own.groupBy("said").agg(*[F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(len(LANGUAGES))]).collect()}
    count = np.array([[float(sums[s][f"n{i}"]) if s in sums else 0.0 for i in range(len(LANGUAGES))] for s in LANGUAGES])
    before = np.where(np.eye(len(LANGUAGES)) > 0, RIGHT, (1 - RIGHT) / (len(LANGUAGES) - 1))
    rate = (count + STRENGTH * before) / (count.sum(0, keepdims=True) + STRENGTH)
    return {s: np.log(rate[i]).tolist() for i, s in enumerate(LANGUAGES)}


def _named(column: str, table_: dict[str, list[float]]) -> list[Column]:
    """Log likelihood of what a declaration says, under each language; null says nothing."""
    said = _said(column)
    out = []
    for i in range(len(LANGUAGES)):
        value = F.lit(0.0)
        for s in LANGUAGES:
            value = F.when(said == s, F.lit(table_[s][i])).otherwise(value)
        out.append(value)
    return out


def _normal(logs: list[Column]) -> Column:
    """Posterior array from log terms, shifted by the largest."""
    top = F.greatest(*logs)
    parts = F.array(*[F.exp(x - top) for x in logs])
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def fused(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Adds lang_id, posterior, accepted to rows of (key columns, text, declared, suffix, host, site).

    * a null or empty text has no trigrams: the other evidence decides, and it is not accepted;
    * nulls among declared, suffix, host and site are no evidence; a null host takes the site's
      prior, a null site the corpus's;
    * ties go to the language first in the alphabet.
    """
    keys = [c for c in rows.columns if c not in ("text", "declared", "suffix", "host", "site")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [*keys, "declared", "suffix", "host", "site"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_trigrams long, fit double, logs array<double>"
    scored = checkpointed(rows.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(_scored(model), schema))
    own = [F.col("logs")[i] + d + s for i, (d, s) in enumerate(zip(_named("declared", _reliability(scored, "declared")), _named("suffix", _reliability(scored, "suffix"))))]
    belief = scored.select("host", "site", _normal(own).alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(len(LANGUAGES))]
    by_host = checkpointed(belief.groupBy("host", "site").agg(*sums))
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(LANGUAGES))]
    total = by_host.agg(*again).first()
    world = np.array([float(x or 0) + 1.0 for x in total])
    world = world / world.sum()
    by_site = by_host.where("site is not null").groupBy("site").agg(*again)
    mass = sum((F.col(f"n{i}") for i in range(1, len(LANGUAGES))), F.col("n0"))
    site_prior = F.array(*[(F.col(f"n{i}") + SITE_STRENGTH * float(world[i])) / (mass + SITE_STRENGTH) for i in range(len(LANGUAGES))])
    sites = by_site.select(F.col("site").alias("prior_site"), site_prior.alias("site_prior"))
    hosts = by_host.where("host is not null").join(sites, F.col("site") == F.col("prior_site"), "left")
    base = F.coalesce("site_prior", F.array(*[F.lit(float(w)) for w in world]))
    prior = F.array(*[F.log((F.col(f"n{i}") + HOST_STRENGTH * base[i]) / (mass + HOST_STRENGTH)) for i in range(len(LANGUAGES))])
    hosts = hosts.select(F.col("host").alias("prior_host"), F.col("site").alias("host_site"), prior.alias("host_logs"))
    joined = scored.join(hosts, (F.col("host") == F.col("prior_host")) & F.col("site").eqNullSafe(F.col("host_site")), "left")
    joined = joined.join(sites.withColumnRenamed("prior_site", "own_site").withColumnRenamed("site_prior", "own_prior"), F.col("site") == F.col("own_site"), "left")
    fallback = F.coalesce(F.transform("own_prior", lambda x: F.log(x)), F.array(*[F.lit(float(np.log(w))) for w in world]))
    logs = F.coalesce("host_logs", fallback)
    joined = joined.withColumn("posterior_all", _normal([x + logs[i] for i, x in enumerate(own)]))
    best = F.array_max("posterior_all")
    place = F.array_position("posterior_all", best).cast("int")
    usual = scored.where((F.col("n_trigrams") >= SHORT) & _said("declared").isNotNull()).agg(F.percentile_approx("fit", LOWEST)).first()[0]
    bar = F.lit(FLOOR * max(0.0, usual or 0.0)) * F.col("n_trigrams") / (F.col("n_trigrams") + SHORT)
    accepted = (F.col("n_trigrams") > 0) & (F.col("fit") > bar)
    return (
        joined.withColumn("posterior", best)
        .withColumn("lang_id", F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), place))
        .withColumn("accepted", accepted)
        .select(*keys, "lang_id", "posterior", "accepted", "n_trigrams", "fit")
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the declared language is ``lang``, the host is ``source``."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("site"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: markup language, language in the address, host and its site."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[^?#]*?/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    none_if_empty = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").cast("long"),
        bare.alias("text"),
        none_if_empty(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)).alias("declared"),
        F.coalesce(none_if_empty(path), none_if_empty(top)).alias("suffix"),
        none_if_empty(host).alias("host"),
        none_if_empty(F.regexp_extract(host, r"([^.]+\.[^.:]+)(?::[0-9]+)?$", 1)).alias("site"),
    )


def accepted_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents whose language is accepted, with their own columns.

    Rows are matched by doc_id: rows that share one are kept if any of them is accepted, and rows
    without one are kept.
    """
    result = fused(document_rows(docs), trigram_model((labelled if labelled is not None else docs).select("doc_id", "text", "lang")))
    bad = result.groupBy("doc_id").agg(F.max("accepted").alias("ok")).where("not ok and doc_id is not null")
    name = unused(docs, "bad_id")
    return docs.join(bad.select(F.col("doc_id").alias(name)), docs["doc_id"] == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fused(document_rows(docs), trigram_model(docs.select("doc_id", "text", "lang")))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fused(page_rows(table(spark, sf_dir, "pages")), trigram_model(docs.select("doc_id", "text", "lang")))
