"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character 3- to 5-grams (with word borders) and
itself, hashed into a table of vectors; a word's vector is their mean, a
document's the mean of its words', and a linear softmax reads it.  Vectors and
softmax are trained jointly in numpy on a bounded sample of labelled documents.
An unseen misspelling shares most of its n-grams with the word it bends.

At scoring time a word's contribution is one number, so a batch of documents is
its distinct words, scored once, averaged by document.  Whole texts are read.

The only bounded part is the training sample: of each class the documents with
the smallest hashes of id and content, at most ``MAX_DOCS`` documents and
``MAX_CHARS`` characters.  A document brings its distinct words, at most
``DOC_CHARS`` characters of them, again by hash.  ``FOLD`` fits, each without one
part of the documents, set how far the scores are moved: the cut with the largest
F-measure on the parts left out (``BETA`` below 1: clean documents left alone count more than toxic ones
caught), at the classes' sizes before sampling, becomes ``CUT``.

Defined cases: a null or empty text has the score of a document without words
(the classifier's bias); without labels of both classes every score is the
share of label 1 (0 without any label); a null label is no label; a document
with both labels counts once for each; repeated rows are scored each and learned
from once; an empty table gives an empty result.  Null ids have no label.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import map_texts

BUCKETS, DIM = 1 << 16, 8
#: bounds of the training sample: documents of each class, characters of each class
MAX_DOCS, MAX_CHARS, DOC_CHARS = (3000, 1500), 6_000_000, 100_000
#: parts that are left out in turn; the score that the best cut moves to; its F-measure
FOLD, CUT, BETA = 4, 0.7, 0.5
STEPS, RATE, INIT = 450, 0.05, 0.01
#: neutral words that every average holds besides the text's own
PRIOR = 20
PUNCT = ".,;:!?\"'()[]{}"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat bucket ids of the words' subwords, and where each word's begin."""
    framed = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, framed), np.int64, len(framed))
    first = np.concatenate([[0], np.cumsum(length)])
    c = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    left = np.repeat(first[1:], length) - np.arange(len(c))  # characters up to the word's end
    owner = np.repeat(np.arange(len(framed)), length)
    h, ids, who = c.copy(), [], []
    for n in range(2, 6):
        h = h[:-1] * np.uint32(0x01000193) ^ c[n - 1:]
        if n >= 3:
            ok = left[:len(h)] >= n
            x = h[ok] ^ (h[ok] >> np.uint32(15))
            ids.append((x * np.uint32(0x2C1B3C6D)) >> np.uint32(16))
            who.append(owner[:len(h)][ok])
    ids.append(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & 0xFFFF for w in framed),
                           np.uint32, len(framed)))
    who.append(np.arange(len(framed)))
    ids, who = np.concatenate(ids), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return ids[order].astype(np.int64), np.searchsorted(who[order], np.arange(len(framed)))


def bag(texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all texts; each text's distinct words by number, and where they begin."""
    seen: dict[str, int] = {}
    ids, first = [], [0]
    for t in texts:
        w = dict.fromkeys(t.lower().split()) if isinstance(t, str) else ()
        a = np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w))
        ids.append(a)
        first.append(first[-1] + len(a))
    return [w.strip(PUNCT) or w for w in seen], np.concatenate([*ids, np.zeros(0, np.int64)]), np.array(first)


def mean_by(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean of each run of rows and PRIOR zero rows."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return (sums[first + n] - sums[first]) / (n + PRIOR).reshape(-1, *[1] * (values.ndim - 1))


def slices(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of the runs [first, first + n), one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def fit(texts: list[str], y: np.ndarray, steps: int = STEPS, batch: int = 32, seed: int = 3) -> dict:
    """Joint training of the vectors and the softmax by Adam."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-INIT, INIT, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [table, out, bias]
    mom = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    share = (len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1))[y]
    words, all_ids, first = bag(texts)
    size = np.diff(first)
    if not words:
        return {"weight": np.zeros(BUCKETS), "bias": 0.0}
    all_sub, sub_first = subwords(words)
    sub_size = np.diff(np.append(sub_first, len(all_sub)))
    order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-steps * batch // len(y)))])
    for step in range(1, steps + 1):
        pick = order[(step - 1) * batch:step * batch]
        n_words = size[pick]
        own, ids = np.unique(all_ids[slices(first[pick], n_words)], return_inverse=True)
        n_sub = sub_size[own]
        sub = all_sub[slices(sub_first[own], n_sub)]
        starts = np.concatenate([[0], np.cumsum(n_sub)[:-1]]).astype(np.int64)
        if not len(own):
            continue
        vec = np.add.reduceat(table[sub], starts, axis=0) / n_sub[:, None]
        doc = mean_by(vec[ids], np.concatenate([[0], np.cumsum(n_words)[:-1]]), n_words)
        z = doc @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), y[pick]] -= 1
        p *= share[pick][:, None] / len(pick)
        g_doc = (p @ out.T) / (n_words + PRIOR)[:, None]
        owner = np.repeat(np.arange(len(pick)), n_words)
        g_vec = np.stack([np.bincount(ids, g_doc[owner, d], len(own)) for d in range(DIM)], 1) / n_sub[:, None]
        of = np.repeat(np.arange(len(own)), n_sub)
        g_table = np.stack([np.bincount(sub, g_vec[of, d], BUCKETS) for d in range(DIM)], 1)
        rate = RATE * (1 - step / (steps + 1))
        for q, g, m in zip(params, (g_table.astype(np.float32), doc.T @ p, p.sum(0)), mom, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            q -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    return {"weight": (table @ (out[:, 1] - out[:, 0])).astype(np.float64), "bias": float(bias[1] - bias[0])}


def scores(model: dict, texts: list) -> np.ndarray:
    words, ids, first = bag(texts)
    n = np.diff(first)
    if not words:
        return np.full(len(texts), 1 / (1 + np.exp(-model["bias"])))
    sub, start = subwords(words)
    word = np.add.reduceat(model["weight"][sub], start) / np.diff(np.append(start, len(sub)))
    z = mean_by(word[ids], first[:-1], n) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logit(p: np.ndarray | float):
    return np.log(p) - np.log1p(-p)


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit, midway between two rows, at which the F-measure of "at least" is largest (the middle of ties)."""
    order = np.argsort(-z, kind="stable")
    z, hit, w = z[order], (y * weight)[order], weight[order]
    f = (1 + BETA ** 2) * np.cumsum(hit) / (np.cumsum(w) + BETA ** 2 * hit.sum())
    f[:-1][z[:-1] == z[1:]] = -1  # a cut cannot part equal scores
    best = np.flatnonzero(f >= f.max() - 1e-12)
    k = best[len(best) // 2]
    return float(z[k] if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def fit_moved(texts: list[str], y: np.ndarray, n: dict[int, int]) -> dict:
    """A fit on all documents, its scores moved as fits without each part ask for; ``n``: the
    classes' sizes before sampling, so that the cut is that of all rows."""
    model, fold, z = fit(texts, y), np.arange(len(y)) % FOLD, np.zeros(len(y))
    for f in range(FOLD):
        held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if not len(held) or len(set(y[rest])) < 2:
            return model
        p = scores(fit([texts[i] for i in rest], y[rest]), [texts[i] for i in held])
        z[held] = logit(np.clip(p, 1e-12, 1 - 1e-12))
    weight = np.array([n[k] / (y == k).sum() for k in (0, 1)])[y]
    return model | {"bias": model["bias"] + float(logit(CUT)) - best_cut(z, y, weight)}


def some_words(text: str) -> str:
    """The distinct words of a text, where they are too long in all those with the smallest checksums."""
    words = list(dict.fromkeys(text.lower().split()))
    if sum(map(len, words)) + len(words) <= DOC_CHARS:
        return " ".join(words)
    out, room = set(), DOC_CHARS
    for k in sorted(range(len(words)), key=lambda i: (zlib.crc32(words[i].encode("utf-8", "surrogatepass")), i)):
        if len(words[k]) < room:
            out.add(k)
            room -= len(words[k]) + 1
    return " ".join(words[k] for k in sorted(out))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
          learn: Column) -> dict:
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")) \
        .where("y in (0, 1)").distinct()
    rows = docs.where(learn & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(text_col).alias("t"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    sizes = rows.select("i", "h", F.least(F.length("t"), F.lit(DOC_CHARS)).alias("c")).join(marks, "i")
    size = {r.y: (r.n, r.d) for r in sizes.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).collect()}
    if len(size) < 2:
        return {"flat": float(1 in size)}
    # a first cut leaves about twice the wanted documents, the second counts them and their characters
    span, cut = float(1 << 63), F.lit(0).cast("long")
    for k, (_, d) in size.items():
        at = 2 * span * (min(1.0, 2 * (MAX_DOCS[k] + 20) / max(d, 1)) - 0.5)
        cut = F.when(F.col("y") == k, F.lit(int(max(-span, min(span - 1024, at))))).otherwise(cut)
    by_hash = Window.partitionBy("y").orderBy("h", "i")
    chosen = sizes.where(F.col("h") <= cut).distinct() \
        .withColumn("r", F.row_number().over(by_hash)).where(
            F.when(F.col("y") == 1, MAX_DOCS[1]).otherwise(MAX_DOCS[0]) >= F.col("r")) \
        .withColumn("s", F.sum("c").over(by_hash)).where((F.col("s") <= MAX_CHARS) | (F.col("r") == 1)) \
        .select("i", "h", "y")  # at most MAX_DOCS rows of each class: small enough to broadcast
    shorter = F.pandas_udf(lambda t: t.map(some_words), "string")
    pdf = rows.join(F.broadcast(chosen), ["i", "h"]).groupBy("i", "h", "y").agg(F.min("t").alias("t")) \
        .select("h", "i", "y", shorter("t").alias("t")).toPandas() \
        .sort_values(["h", "i", "y"], kind="stable")
    return fit_moved(pdf["t"].to_list(), pdf["y"].to_numpy(), {k: n for k, (n, _) in size.items()})


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", learn: Column | None = None) -> DataFrame:
    """Per document: id, score."""
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    model = train(docs, labels, id_col, text_col, label_col, learn)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t"))

    def make():
        m = shared.value
        return lambda texts: [scores(m, texts) if "weight" in m else np.full(len(texts), m["flat"])]

    return map_texts(rows, "_t", [T.StructField("score", T.DoubleType())], make, step=512)
