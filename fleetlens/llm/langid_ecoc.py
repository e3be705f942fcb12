"""Language identification with error-correcting output codes.

Languages get binary codewords (exhaustive codes for few languages, the best of
many random codes for more).  One logistic classifier over hashed character 2-
and 3-grams per bit is trained on a bounded sample of labelled documents.  A
document is decoded to the language whose codeword has the least weighted
logistic loss; a bit's weight for a language is its accuracy on that language's
validation documents.  Near-equal losses flag the document as ambiguous.

Whole texts are read, in pieces, so memory is bounded by the piece.  Only the
text decides a prediction.  The only bounded part is the training sample: of each
language the ``PER_LANG`` documents (``SAMPLE`` by the number of languages, if that
is less, but ``LEAST`` at any rate) with the smallest hashes of id, content and
language, so neither null or repeated ids nor the layout of the files decide.  No
language is left out; the model, and what the driver holds, has a codeword and
``LEAST`` sparse rows for each.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any labelled document every text is ``und``; with one language it is
that language; repeated rows are predicted each and learned from once; an empty
table gives an empty result.  Ids may be of any type; ``carry`` columns keep their
names, also those that this operator uses itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import map_texts

BUCKETS, PIECE = 1 << 13, 1 << 20
#: bounds of the training sample: documents of each language, of all together, of each at least
PER_LANG, SAMPLE, LEAST = 500, 20_000, 20
#: training rows that are dense at once
BATCH = 8192
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> is it a letter; built once per worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(text: str) -> tuple[np.ndarray, bool]:
    """Counts of hashed 2- and 3-grams over letters and single gaps; has it a letter."""
    is_letter, counts, found = letters(), np.zeros(BUCKETS), False
    text = text.lower()
    for a in range(0, max(len(text), 1), PIECE):
        c = np.frombuffer(text[max(a - 2, 0):a + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        real = is_letter[np.minimum(c, 0x10FFFF)]
        if not real.any():
            continue
        found = True
        c = np.concatenate([[32], np.where(real, c, 32), [32]]).astype(np.uint32)
        gap = c == 32
        c = c[~(gap & np.concatenate([[False], gap[:-1]]))]
        two = c[:-1] * np.uint32(0x01000193) + c[1:]
        three = two[:-1] * np.uint32(0x01000193) + c[2:]
        for h in (two, three + np.uint32(0x9E3779B9)):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts, found


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of square roots with norm 1; in place, as the training rows are many."""
    np.sqrt(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """+-1 codewords, one row a language."""
    if n <= 7:  # exhaustive: every way to split the languages in two
        bits = [[1 if m >> i & 1 else -1 for i in range(n)] for m in range(1, 2 ** n - 1, 2)]
        return np.array(bits).T if bits else np.ones((n, 1), int)
    rng, best, far = np.random.default_rng(seed), None, -1.0
    width = math.ceil(10 * math.log2(n))
    for _ in range(200):  # dense random codes; the one whose closest rows are farthest apart
        code = rng.choice([-1, 1], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        d = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * width
        if d.min() > far:
            best, far = code, d.min()
    return best


def fit(x: "Rows", y: np.ndarray, langs: list[str], steps: int = 150) -> dict:
    """Bit classifiers (all bits at once, Adam on the logistic loss) and decoding weights.
    Where the rows are more than a batch, each step takes the next batch of a shuffled order."""
    code = codebook(len(langs))
    hold = np.arange(len(y)) % 5 == 0
    if len(set(y[~hold])) < len(langs):
        hold[:] = False
    learn, check = np.flatnonzero(~hold), np.flatnonzero(hold if hold.any() else ~hold)
    per = np.bincount(y[learn], minlength=len(langs))
    share = ((1.0 / np.maximum(per, 1))[y[learn]] / len(langs)).astype(np.float32)
    n_batches = -(-len(learn) // BATCH)
    order = np.random.default_rng(13).permutation(len(learn)) if n_batches > 1 else np.arange(len(learn))
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mom = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    xs = None
    for i in range(1, steps + 1):  # all single: a double would copy xs each step
        if xs is None or n_batches > 1:
            pick = order[(i - 1) % n_batches::n_batches]
            xs, t = x.dense(learn[pick]), code[y[learn[pick]]].astype(np.float32)
            part = share[pick][:, None] * np.float32(n_batches)
        g = -t / (1 + np.exp(np.clip(t * (xs @ w + b), -30, 30))) * part
        for p, grad, m in zip((w, b), (xs.T @ g + 1e-6 * w, g.sum(0)), mom, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.99 * m[1] + 0.01 * grad * grad
            p -= 0.3 * (m[0] / (1 - 0.9 ** i)) / (np.sqrt(m[1] / (1 - 0.99 ** i)) + 1e-8)
    del xs
    right = np.zeros((len(langs), code.shape[1]))
    for a in range(0, len(check), BATCH):
        part = check[a:a + BATCH]
        np.add.at(right, y[part], np.sign(x.dense(part) @ w + b) == code[y[part]])
    seen = np.bincount(y[check], minlength=len(langs))[:, None]
    acc = np.maximum(np.where(seen > 0, right / np.maximum(seen, 1), 1.0), 1e-3)
    return {"w": w, "b": b, "code": code, "weight": acc / acc.sum(1, keepdims=True) * code.shape[1]}


class Rows:
    """Sparse training rows: bucket ids and scaled counts."""

    def __init__(self, at: list[np.ndarray], n: list[np.ndarray]):
        self.at, self.n = at, n

    def dense(self, pick: np.ndarray) -> np.ndarray:
        x = np.zeros((len(pick), BUCKETS), np.float32)
        for k, i in enumerate(pick):
            x[k, self.at[i]] = self.n[i]
        return scaled(x)


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score (0 to 1), margin to the second (0 to 1)."""
    m = x @ model["w"] + model["b"]
    one, weight = model["code"] > 0, model["weight"]  # the loss of a bit that should be 1, and -1
    loss = np.logaddexp(0, -m) @ (weight * one).T + np.logaddexp(0, m) @ (weight * ~one).T
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, axis=1)
    margin = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
    return p.argmax(1), top[:, -1], margin


def train(docs: DataFrame, text_col: str, lang_col: str, id_col: str, learn: Column) -> dict | None:
    """Model from a bounded sample of the rows where ``learn`` holds."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("t"), F.col(lang_col).alias("l"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col, lang_col).alias("h"))
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()  # as many as codewords
    if not sizes:
        return None
    per = max(LEAST, min(PER_LANG, SAMPLE // len(sizes)))
    # a first cut leaves about twice the wanted rows, the second counts them; small beside the model
    span = float(1 << 63)
    cuts = docs.sparkSession.createDataFrame(
        [(r.l, int(max(-span, min(span - 1024, 2 * span * (min(1.0, 2 * (per + 20) / max(r.n, 1)) - 0.5)))))
         for r in sizes], "l string, cut long")
    some = rows.join(F.broadcast(cuts), "l").where("h <= cut").select("l", "h").distinct()
    last = some.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(
        F.col("r") <= per).groupBy("l").agg(F.max("h").alias("cut")).collect()
    cuts = docs.sparkSession.createDataFrame([(r.l, r.cut) for r in last], "l string, cut long")
    sample = rows.join(F.broadcast(cuts), "l").where("h <= cut").groupBy("l", "h").agg(F.min("t").alias("t"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(t)[0] for t in b["t"]]
            at = [np.flatnonzero(x) for x in got]
            yield pd.DataFrame({"h": b["h"], "l": b["l"], "at": [a.astype(np.int32) for a in at],
                                "n": [x[a].astype(np.float32) for x, a in zip(got, at, strict=True)]})

    pdf = sample.mapInPandas(counted, "h long, l string, at array<int>, n array<float>").toPandas()
    pdf = pdf[pdf["at"].map(len) > 0].sort_values(["l", "h"], kind="stable")
    langs = sorted(pdf["l"].unique())
    if not langs:
        return None
    y = pdf["l"].map({lang: k for k, lang in enumerate(langs)}).to_numpy()
    return fit(Rows(pdf["at"].to_list(), pdf["n"].to_list()), y, langs) | {"langs": langs}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             learn: Column | None = None, ambiguous_below: float = 0.2,
             carry: tuple[str, ...] = (), known_only: bool = False) -> DataFrame:
    """Per document: id, lang_pred, score, margin, ambiguous, and the ``carry`` columns (of an
    own and a carried column with one name, the carried one stays).  ``known_only`` leaves out
    the documents that are ``und``."""
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    model = train(docs, text_col, lang_col, id_col, learn)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS x bits
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"),
                       *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)])

    def make():
        m = shared.value

        def predict(texts: list) -> list:
            got = [features(t) if t else (None, False) for t in texts]
            ok = np.array([found for _, found in got], bool)
            lang = np.full(len(texts), UNKNOWN, object)
            score, margin = np.zeros(len(texts)), np.zeros(len(texts))
            if m is not None and ok.any():
                best, score[ok], margin[ok] = decode(m, scaled(np.stack([x for x, f in got if f])))
                lang[ok] = np.array(m["langs"], object)[best]
            return [lang, score, margin, margin < ambiguous_below]

        return predict

    out = map_texts(rows, "_t", [T.StructField("_lang", T.StringType()),
                                 T.StructField("_score", T.DoubleType()),
                                 T.StructField("_margin", T.DoubleType()),
                                 T.StructField("_ambiguous", T.BooleanType())], make)
    if known_only:
        out = out.where(F.col("_lang") != UNKNOWN)
    own = {"lang_pred": "_lang", "score": "_score", "margin": "_margin", "ambiguous": "_ambiguous"}
    return out.select(F.col("_id").alias(id_col), *[F.col(v).alias(k) for k, v in own.items() if k not in carry],
                      *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)])
