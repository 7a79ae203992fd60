"""Fits the trees in ``pii_trees`` on labelled examples made from templates.

``python -m clearframe.llm.pii_fit`` prints the module.  The features come from the same
expressions the operator uses.  Depth-two trees, logistic loss, shrinkage; the threshold of a kind
is the lowest score at which 98 of 100 held-out selections are right.
"""

from __future__ import annotations

import random
import string

import numpy as np

ROUNDS, RATE = 12, 0.5


def examples(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """(text, label) pairs; each text holds about one candidate."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick("aeiorstnlmdu", r.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 9)))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    local = lambda: f"0{pick(string.digits, 3)} {pick(string.digits, 3)} {pick(string.digits, 4)}"
    good = (
        lambda: f"{r.choice(['password', 'pwd', 'secret', 'token', 'api_key'])}{r.choice(['=', ' = ', ': '])}{r.choice([pick(hexes, r.randint(12, 40)), pick(mixed, r.randint(12, 40))])}",
        lambda: f'token = "{pick(hexes, 40)}"',
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: f"{r.choice(['phone', 'tel', 'call', 'fax'])} {r.choice([local(), '(0' + pick(string.digits, 2) + ') 555-' + pick(string.digits, 4)])}",
        lambda: f"{word()} [at] {word()}.{r.choice(['com', 'org', 'net'])}",
        lambda: f"{word()} (at) {word()} (dot) com",
    )
    bad = (
        lambda: f"{r.choice(['token', 'secret', 'password'])}: {pick(string.ascii_lowercase, r.randint(8, 14))}",
        lambda: f"{r.choice(['token', 'secret'])} = {word()}{word()}{word()}",
        lambda: pick(string.ascii_uppercase, r.randint(16, 24)),
        lambda: f"{r.choice(['no.', 'item', 'ref', 'vol.', 'order'])} {local()}",
        lambda: f"{r.choice(['no.', 'lot', 'page'])} 0{pick(string.digits, 2)}-{pick(string.digits, 3)}-{pick(string.digits, 3)}",
    )
    out = []
    for i in range(n):
        label = i % 2
        out.append((f"{prose()} {r.choice(good if label else bad)()} {prose()}.", label))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
    base = float(np.log(y.mean() / (1 - y.mean())))
    f, trees = np.full(len(y), base), []

    def split(rows, g, h):
        best = (-1.0, 0, 0.0)
        for k in range(x.shape[1]):
            v = x[rows, k]
            for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 19), method="lower")):
                a = v <= t
                if 10 <= a.sum() <= len(a) - 10:
                    gain = g[rows][a].sum() ** 2 / (h[rows][a].sum() + 1) + g[rows][~a].sum() ** 2 / (h[rows][~a].sum() + 1)
                    best = max(best, (gain, k, float(t)))
        return best[1:]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        top = split(np.arange(len(y)), g, h)
        side = x[:, top[0]] <= top[1]
        under = [split(np.flatnonzero(s), g, h) if s.any() else (0, 0.0) for s in (side, ~side)]
        leaves = []
        for s, (k, t) in zip((side, ~side), under):
            for part in (s & (x[:, k] <= t), s & (x[:, k] > t)):
                leaf = rate * g[part].sum() / (h[part].sum() + 1)
                leaves.append(round(float(leaf), 3))
                f[part] += leaves[-1]
        trees.append((top, *under, leaves))
    return base, trees, f


def fit(spark):
    from pyspark.sql import functions as F

    from . import pii

    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(examples())], "doc_id long, text string, label int")
    flat = pii.candidates(rows).select("doc_id", "text", "label", F.explode("pii_loose").alias("s"))
    data = flat.select("label", F.col("s.kind").alias("kind"), *[v.alias(k) for k, v in pii.features(F.col("text"), F.col("s")).items()]).toPandas()
    x, y = data[list(pii.FEATURES)].to_numpy(float), data["label"].to_numpy(float)
    train = np.arange(len(y)) % 3 > 0
    base, trees, _ = boost(x[train], y[train])
    total = np.full(len(y), base)
    for (k, t), (k1, t1), (k2, t2), leaves in trees:
        low = np.where(x[:, k1] <= t1, leaves[0], leaves[1])
        high = np.where(x[:, k2] <= t2, leaves[2], leaves[3])
        total += np.where(x[:, k] <= t, low, high)
    p = 1 / (1 + np.exp(-total))
    cuts = {}
    for kind in pii.LOOSE:
        own = ~train & (data["kind"] == kind).to_numpy()
        levels = [c for c in np.linspace(0.5, 0.95, 10) if (own & (p >= c)).any() and y[own & (p >= c)].mean() >= 0.98]
        cuts[kind] = round(float(min(levels, default=2.0)), 2)
    name = lambda s: (pii.FEATURES[s[0]], s[1])
    right = ((p > 0.5) == (y > 0.5))[~train].mean()
    return base, [(name(a), name(b), name(c), d) for a, b, c, d in trees], cuts, right, data["kind"].value_counts().to_dict()


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    base, trees, cuts, right, kinds = fit(SparkSession.builder.master("local[4]").getOrCreate())
    print('"""Boosted trees that ``pii_fit`` fitted: fixed values, held-out accuracy %.3f."""\n' % right)
    print(f"BASE_SCORE = {base:.4f}\nTHRESHOLDS = {cuts}\n#: (feature, threshold) at the top, left and right, then the four leaves.\nTREES = [")
    print("".join(f"    {t},\n" for t in trees) + "]")
    print("#", kinds)
