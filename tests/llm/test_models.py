"""Language and quality models: what they reject, edge cases, and a dual tree that leaves pairs out."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clearframe.llm import covertree, language, quality

SENTENCES = {
    "en": "the weather in the town was fine and people walked along the river to see the old bridge",
    "de": "das wetter in der stadt war schön und die leute gingen am fluss entlang zur alten brücke",
    "fr": "le temps dans la ville était beau et les gens marchaient le long de la rivière vers le pont",
    "es": "el tiempo en la ciudad era bueno y la gente caminaba por el río para ver el puente viejo",
}


def labelled(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(400):
        lang = sorted(SENTENCES)[i % 4]
        w = SENTENCES[lang].split()
        rows.append((i, " ".join(r.permutation(w).tolist() + r.permutation(w).tolist()), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_texts_in_no_known_language_go_and_bilingual_ones_stay(spark):
    docs = labelled(spark)
    extra = [
        (1000, "qzx wwkk lpp zzzt kkq xjqk vvv bbn mqw zxcv qqpl kkjh", "en"),
        (1001, SENTENCES["en"] + " " + SENTENCES["fr"], "en"),
        (1002, SENTENCES["de"], None),
        (1003, None, "en"),
        (1004, "", "de"),
        (1005, SENTENCES["es"] * 3000, "es"),
        (1005, SENTENCES["es"] * 3000, "es"),
    ]
    both = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("source", F.lit("s"))
    out = language.fused(language.document_rows(both), language.trigram_model(docs)).collect()
    got = {x["doc_id"]: x for x in out}
    assert len(out) == 407 and all(x["accepted"] for x in out if x["doc_id"] < 1000)
    assert [got[i]["accepted"] for i in range(1000, 1006)] == [False, True, True, False, False, True]
    assert got[1002]["lang_id"] == "de" and got[1005]["lang_id"] == "es"


def test_reliabilities_are_counted(spark):
    docs = labelled(spark).withColumn("declared", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("en"))
    rows = docs.select("doc_id", "text", "declared", F.lit(None).cast("string").alias("suffix"), F.lit("h").alias("host"), F.lit(None).cast("string").alias("site"))
    model = language.trigram_model(docs.select("doc_id", "text", "lang"))
    scored = rows.select("doc_id", "declared", "text").mapInArrow(language._scored(model), "doc_id long, declared string, n_trigrams long, fit double, logs array<double>")
    table = language._reliability(scored, "declared")
    de, en = language.LANGUAGES.index("de"), language.LANGUAGES.index("en")
    # de is the language of even rows here, which declare it; en is declared in the odd rows of others
    assert np.exp(table["de"][de]) > 0.8 and np.exp(table["en"][en]) > 0.8
    es = language.LANGUAGES.index("fr")
    assert np.exp(table["en"][language.LANGUAGES.index("es")]) > 0.05 or np.exp(table["en"][es]) > 0.05


def test_quality_takes_edge_cases(spark):
    good, bad = "a thoughtful essay on rivers and the people who live beside them number ", "buy now click here cheap cheap offer win win "
    rows = [(i, (good if i % 2 else bad) * (2 + i % 5) + str(i)) for i in range(80)] + [(900, None), (901, ""), (902, good * 20000), (903, "x"), (904, good), (904, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    out = quality.scores(docs, labels).collect()
    got = {x["doc_id"]: x["score"] for x in out}
    assert len(out) == 86 and all(0 <= x["score"] <= 1 for x in out) and got[900] == got[901]
    assert got[902] > 0.5 and np.mean([got[i] > got[i - 1] for i in range(1, 80, 2)]) > 0.95
    assert {x["score"] for x in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scores(docs.limit(0), labels).collect() == []


def test_dual_tree_leaves_pairs_out_on_clustered_rows(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 16)) * 8
    x = np.floor(256 * (np.repeat(centres, 100, 0) + 0.05 * r.standard_normal((1200, 16))))
    vectors = spark.createDataFrame([(int(i), [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, v array<double>")
    share = covertree.compared_share(vectors, F.col("vec_id") % 4 == 0, k=3, data_block=128, query_block=64)
    assert share < 0.5
    got = {(z["query_id"], z["rank"]): (z["vec_id"], z["score"]) for z in covertree.top_k(vectors, F.col("vec_id") % 4 == 0, 3, 128, 64).collect()}
    for q in range(0, 1200, 60):
        s = x @ x[q]
        want = sorted(((-s[i], i) for i in range(1200) if i != q))[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -v) for v, i in want]


def test_dual_tree_moves_rows_by_shelf_and_not_by_pair_of_blocks(spark, monkeypatch):
    n, r = 3000, np.random.default_rng(4)
    x = np.floor(64 * r.standard_normal((n, 16)))
    vectors = spark.createDataFrame([(int(i), [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, v array<double>")
    real = covertree._search

    def counting(k):
        search = real(k)

        def run(left, right):
            out = search(left, right)
            return out.set_column(1, "node", pa.concat_arrays([out["node"].combine_chunks()[:-1], pa.array([right.num_rows], pa.int64())]))

        return run

    monkeypatch.setattr(covertree, "_search", counting)
    nodes, asked = covertree._distinct(vectors, F.col("vec_id") % 5 == 0, 3)
    moved = covertree.search(nodes, asked, 4, 128, 16).where("q is null").agg(F.sum("node")).first()[0]
    assert moved <= 2 * n  # once for the best blocks and once for the others, whatever the number of query blocks


def test_shelves_hold_blocks_that_lie_close():
    centres = np.array([[9.0, 0], [-9, 0], [9, 1], [-9, 1], [8, 0], [-8, 0]])
    got = covertree.shelves(centres, np.full(6, 10), 30).tolist()
    assert got[0] == got[2] == got[4] != got[1] == got[3] == got[5]
    sizes = np.array([10, 10, 10, 50, 10, 10])
    got = covertree.shelves(centres, sizes, 30)
    assert all(sizes[got == g].sum() <= 30 or (got == g).sum() == 1 for g in got)


def test_dual_tree_is_exact_in_either_precision():
    r = np.random.default_rng(6)
    for scale in (20, 1e5):  # products beyond 2^24 need double precision
        x = np.floor(scale * r.standard_normal((600, 8)))
        ids = r.permutation(600)
        q, floor = x[:90], np.sort(x[:90] @ x[300:].T, 1)[:, -3]
        parts = np.array_split(np.arange(600), 4)
        forest = covertree.Flat([covertree.cover_tree(x, ids, points=p) for p in parts], x, ids)
        for given in (None, floor):
            best, names, _ = covertree.dual_tree(q, forest, 3, given)
            for i, s in enumerate(q @ x.T):
                want = np.lexsort((ids, -s))[:3]
                assert names[i].tolist() == ids[want].tolist() and best[i].tolist() == s[want].tolist()
