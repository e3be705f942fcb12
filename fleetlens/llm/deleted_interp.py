"""Language-model scoring by deleted interpolation.

P(w | h) = l2(b) f(w | h) + l1(b) f(w) + l0(b) / (V + 1), with maximum-likelihood
estimates f from the training documents and weights l by bucket b of the
context's frequency (powers of two).  The weights come from expectation-
maximisation on deleted counts: every training token is held out once and is
predicted from the counts without it.

Counts cover the whole corpus and never meet in one place.  Documents are read
in blocks; a block asks for the counts of its distinct words and word pairs
(64-bit hashes, sorted, one blob for each range of the hash space) and sends its
own training counts along; each hash range sums all blocks' counts and answers
every block; each block then scores its documents.  A word or pair that makes up
a third of the corpus is one key a block.  Nothing but the weights (3 for each of
about 40 buckets) and the bounded table they are learned from (bins of the two
estimates by bucket) reaches the driver.

The rows must read back in the same order each time, as a table does, since two
scans build the same blocks; a block that differs is noticed and raises.

Defined cases: a null text is empty: its only token is the end; documents that
are not ``learn`` rows (or whose condition is null) are scored only; without
training documents N and V are 0 and every token has probability 1 / (V + 1);
repeated rows count and are scored each; an empty table gives an empty result.
Two words or pairs that share a 64-bit hash would share counts (about 1e-4
chances at 1e8 distinct keys).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept, mix64, squeeze, squeeze_sorted, stretch, stretch_sorted

BLOCK_TOKENS, CHARS_PER_RANGE, FINE = 800_000, 8_000_000, 4
END, START = b"", b" "  # no word is empty or holds white space
REQUEST = "block long, bucket int, words binary, word_n binary, pairs binary, pair_n binary"
ANSWER = "block long, bucket int, words binary, pairs binary, types long"
STATE = ("block long, ids array<long>, held array<boolean>, lens array<int>, words binary, seq binary, "
         "train_tokens long")


class Block:
    """Documents as numbered words; numbers follow the order of the words' hashes."""

    def __init__(self) -> None:
        self.vocab: dict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.vocab[END]
        self.ids, self.held, self.seqs, self.tokens = [], [], [], 0

    def add(self, doc_id, held: bool, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, on bytes
        seq = np.zeros(len(words) + 1, np.int32)
        seq[:-1] = np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words))
        self.ids.append(doc_id)
        self.held.append(held)
        self.seqs.append(seq)
        self.tokens += len(seq)

    def close(self, nth: int) -> None:
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocab), np.uint64, len(self.vocab))
        order = np.argsort(keys, kind="stable")
        number = np.empty(len(keys), np.int32)
        number[order] = np.arange(len(keys), dtype=np.int32)
        self.keys, self.lens = keys[order], np.fromiter(map(len, self.seqs), np.int64, len(self.seqs))
        self.seq = number[np.concatenate(self.seqs)]
        task = TaskContext.get()
        seal = xxhash.xxh64(self.seq.tobytes(), seed=nth)
        seal.update(f"{task.partitionId() if task else 0}:{self.ids}")
        self.number = int(np.uint64(seal.intdigest()).astype(np.int64))


def pairs_of(keys: np.ndarray, seq: np.ndarray, lens: np.ndarray):
    """Distinct (previous, word) pairs in the order of their hashes: hashes, previous
    words (-1 at a start), words; and each token's pair."""
    ends = np.cumsum(lens)
    prev = np.concatenate([[-1], seq[:-1]]).astype(np.int64)
    prev[ends[:-1]] = -1
    codes, inverse = np.unique((prev + 1) << 32 | seq, return_inverse=True)
    p, w = (codes >> 32) - 1, codes & 0xFFFFFFFF
    start = np.uint64(xxhash.xxh3_64_intdigest(START))
    with np.errstate(over="ignore"):
        hashes = mix64(np.where(p < 0, start, keys[np.maximum(p, 0)]) * np.uint64(0x9E3779B97F4A7C15)
                       + keys[w])
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return hashes[order], p[order], w[order], place[inverse]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block, nth = Block(), 0
    for b in batches:
        for doc_id, held, text in zip(*(b.column(c).to_pylist() for c in ("_id", "_held", "_t")), strict=True):
            block.add(doc_id, held, text)
            if block.tokens >= BLOCK_TOKENS:
                block.close(nth)
                yield block
                block, nth = Block(), nth + 1
    if block.ids:
        block.close(nth)
        yield block


def ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each hash range begins among sorted keys."""
    edges = (np.arange(buckets + 1, dtype=object) * (1 << 64)) // buckets
    return np.append(np.searchsorted(keys, np.array(edges[:-1], np.uint64)), len(keys))


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            keys, _, _, of = pairs_of(b.keys, b.seq, b.lens)
            learn = np.repeat(~np.array(b.held, bool), b.lens)
            word_n = np.bincount(b.seq[learn], minlength=len(b.keys)).astype(np.uint32)
            pair_n = np.bincount(of[learn], minlength=len(keys)).astype(np.uint32)
            rw, rp = ranges(b.keys, buckets), ranges(keys, buckets)
            out = [(b.number, i, squeeze_sorted(b.keys[rw[i]:rw[i + 1]]), squeeze(word_n[rw[i]:rw[i + 1]]),
                    squeeze_sorted(keys[rp[i]:rp[i + 1]]), squeeze(pair_n[rp[i]:rp[i + 1]]))
                   for i in range(buckets) if rw[i] < rw[i + 1] or rp[i] < rp[i + 1]]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["block", "bucket", "words", "word_n", "pairs", "pair_n"])
    return run


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([b.number], pa.int64()), pa.array([b.ids], pa.list_(pa.int64())),
             pa.array([b.held], pa.list_(pa.bool_())), pa.array([b.lens.tolist()], pa.list_(pa.int32())),
             pa.array([squeeze_sorted(b.keys)], pa.binary()), pa.array([squeeze(b.seq)], pa.binary()),
             pa.array([int(b.lens[~np.array(b.held, bool)].sum())], pa.int64())],
            names=["block", "ids", "held", "lens", "words", "seq", "train_tokens"])


def _answers(asked: pd.DataFrame) -> pd.DataFrame:
    """Sum one hash range's counts over all blocks and answer each of them."""
    out = {"block": asked["block"], "bucket": asked["bucket"]}
    for name, n in (("words", "word_n"), ("pairs", "pair_n")):
        keys = [stretch_sorted(x) for x in asked[name]]
        counts = np.concatenate([stretch(x, np.uint32) for x in asked[n]])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        if name == "words":
            out["types"] = np.where(np.arange(len(asked)) == 0, (total > 0).sum(), 0)
        cut = np.cumsum([len(k) for k in keys])[:-1]
        out[name] = [squeeze(x) for x in np.split(total[inverse], cut)]
    return pd.DataFrame(out)[["block", "bucket", "words", "pairs", "types"]]


class Answered:
    """A block with the corpus counts of its words and pairs."""

    def __init__(self, row: dict) -> None:
        if row["answers"] is None:
            raise ValueError("the documents read back differently; write them to a table first")
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lens, seq = np.array(row["lens"], np.int64), stretch(row["seq"], np.int32)
        keys = stretch_sorted(row["words"])
        word, pair = (np.concatenate([stretch(a[k], np.int64) for a in row["answers"]])
                      for k in ("words", "pairs"))
        hashes, prev, w, self.of = pairs_of(keys, seq, self.lens)
        if len(word) != len(keys) or len(pair) != len(hashes):
            raise ValueError("the documents read back differently; write them to a table first")
        end = np.searchsorted(keys, np.uint64(xxhash.xxh3_64_intdigest(END)))
        self.c1, self.c2 = word[w], pair  # by pair
        self.ch = np.where(prev < 0, word[end], word[np.maximum(prev, 0)])
        self.of_c1 = word[seq]  # by token


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[Answered]:
    for b in batches:
        for i in range(b.num_rows):
            yield Answered(b.slice(i, 1).to_pylist()[0])


def bucket_of(ch: np.ndarray) -> np.ndarray:
    return np.where(ch > 0, np.floor(np.log2(np.maximum(ch, 1))) + 1, 0).astype(np.int64)


def _bin(f: np.ndarray) -> np.ndarray:
    """Logarithmic bins, FINE to an octave; 0 holds zero."""
    return np.where(f > 0, 1 + np.floor(-FINE * np.log2(np.where(f > 0, f, 1))), 0).astype(np.int64)


def _held_out_counts(n_train: int):
    """Per (context bucket, bins of both estimates): tokens, and sums of the estimates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _answered(batches):
            n = np.bincount(b.of[np.repeat(~b.held, b.lens)], minlength=len(b.c2))
            at = n > 0
            n, c2, c1, ch = n[at], b.c2[at] - 1, b.c1[at] - 1, b.ch[at] - 1
            f2 = np.where(ch > 0, c2 / np.maximum(ch, 1), 0.0)
            f1 = c1 / max(n_train - 1, 1)
            code, inverse = np.unique(bucket_of(ch) << 40 | _bin(f2) << 20 | _bin(f1), return_inverse=True)
            sums = [np.bincount(inverse, weights=x, minlength=len(code)) for x in (n, n * f2, n * f1)]
            yield pa.RecordBatch.from_arrays([pa.array(code), *[pa.array(s, pa.float64()) for s in sums]],
                                             names=["code", "n", "s2", "s1"])
    return run


def em(code: np.ndarray, n: np.ndarray, s2: np.ndarray, s1: np.ndarray, types: int,
       rounds: int = 200) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) by context bucket."""
    bucket, weights = code >> 40, np.zeros((64, 3))
    f = np.stack([s2 / n, s1 / n, np.full(len(n), 1.0 / (types + 1))], 1) if len(n) else np.zeros((0, 3))

    def solve(at: np.ndarray, no_context: bool) -> np.ndarray:
        lam = np.array([0.0, 0.5, 0.5]) if no_context else np.full(3, 1 / 3)
        for _ in range(rounds):
            post = lam * f[at]
            post *= (n[at] / np.maximum(post.sum(1), 1e-300))[:, None]
            new = post.sum(0) + 0.5 * (lam > 0)  # half a token each: no weight vanishes
            new /= new.sum()
            if np.abs(new - lam).max() < 1e-9:
                return new
            lam = new
        return lam

    everything = solve(np.ones(len(n), bool), False)
    for b in range(64):
        at = bucket == b
        weights[b] = solve(at, b == 0) if at.any() or b == 0 else everything
    return weights


def _scores(n_train: int, types: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _answered(batches):
            lam = weights[bucket_of(b.ch)]
            p = (lam[:, 0] * np.where(b.ch > 0, b.c2 / np.maximum(b.ch, 1), 0.0)
                 + lam[:, 1] * (b.c1 / max(n_train, 1)) + lam[:, 2] / (types + 1))
            first = np.concatenate([[0], np.cumsum(b.lens)[:-1]])
            total = [np.add.reduceat(x, first) for x in (
                (b.of_c1 > 0).astype(np.int64),
                np.log10(b.of_c1 + 1.0) - math.log10(n_train + types + 1), np.log10(p)[b.of])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lens), pa.array(total[0]),
                 pa.array(np.full(len(b.lens), n_train)), pa.array(total[1]), pa.array(total[2])],
                names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def lm_scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(held, F.lit(True)).alias("_held"),
                       F.col(text_col).alias("_t"))
    chars = rows.agg(F.sum(F.length("_t"))).first()[0] or 0
    buckets = max(1, math.ceil(chars / CHARS_PER_RANGE))
    answers = rows.mapInArrow(_requests(buckets), REQUEST).groupBy("bucket").applyInPandas(_answers, ANSWER)
    by_block = answers.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "words", "pairs"))).alias("answers"),
        F.sum("types").alias("types"))
    table = kept(rows.mapInArrow(_states, STATE).join(by_block, "block", "left"), "lm-blocks")
    sums = table.agg(F.sum("train_tokens").alias("n"), F.sum("types").alias("v")).first()
    n_train, types = int(sums.n or 0), int(sums.v or 0)
    stats = table.mapInArrow(_held_out_counts(n_train), "code long, n double, s2 double, s1 double") \
        .groupBy("code").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")) \
        .orderBy("code").toPandas()
    weights = em(*(stats[c].to_numpy() for c in ("code", "n", "s2", "s1")), types)
    out = table.mapInArrow(_scores(n_train, types, weights),
                           "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                           "base_score double, score double")
    return out.withColumnRenamed("_id", id_col)
