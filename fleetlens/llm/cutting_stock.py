"""Packing token sequences by cutting-stock column generation.

Every document is cut into full sequences and a remainder; a remainder longer
than half a sequence is cut once more at half, so that two halves or several
small pieces fill a sequence.  The pieces below a full sequence are the items of
a cutting-stock problem over their length histogram: a restricted
linear program over patterns (multisets of lengths that fit a sequence), whose
duals price new patterns by an unbounded-knapsack dynamic program, until no
pattern improves (or Farley's bound shows that 0.02 % or half a sequence is left).  The pattern
counts are rounded down; what is left is packed sequence by sequence, each
filled as full as a subset-sum program can.  The histogram has at most
``size / 2`` lengths whatever the corpus, so the program runs on the driver in
bounded time and memory.

Pieces meet their patterns by rank: they are range-sorted by (length, id), so the
rank of a piece among its length is its place in its partition plus the
partition's start, and (length, rank) names a pattern, a copy of it and an
offset.  Full sequences are pieces of the full length, one pattern of their own.

Token ids never leave the task that made them; only lengths and checksums do.

Defined cases: a null text is empty and has one token, the closing id; repeated
rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import kept, map_texts

SIZE, CLOSING_ID = 1024, 0
CACHED_CHUNKS = 1_000_000
#: beyond these characters (or with a special token's text) only the tokenizer itself decides
RARE = re.compile("[^\x00-\u024f\u2000-\u206f\u20ac]|<[|]")
#: the linear program stops this close to its bound (and at half a sequence)
GAP = 2e-4


class Encoder:
    """Text -> little-endian 32-bit token ids, with the ids of recent chunks at hand.

    A single space between two non-space characters always begins a new
    pre-token, so texts are cut there and equal chunks are encoded once.  The same
    vocabulary as byte-pair ranks (``ranks_path``) encodes common chunks faster.
    """

    def __init__(self, path: str, ranks_path: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.fast = Tokenizer.from_file(path), {}, None
        if ranks_path:
            import public_tokenizers
            import tiktoken
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={}).encode_ordinary

    def _ids(self, text: str) -> bytes:
        if self.fast and not RARE.search(text):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list) -> list[bytes]:
        split = [(t or "").split(" ") for t in texts]
        used = {c for chunks in split for c in chunks[1:]}
        if len(self.known) + len(used) > CACHED_CHUNKS:
            self.known.clear()
        # None: white space beside the cut, which does not begin a pre-token there
        self.known.update((c, self._ids(f" {c}") if c and not (c[0].isspace() or c[-1].isspace()) else None)
                          for c in used if c not in self.known)
        closing, get = array("I", [CLOSING_ID]).tobytes(), self.known.__getitem__
        out = []
        for text, chunks in zip(texts, split, strict=True):
            ids = list(map(get, chunks[1:]))
            whole = None in ids or (len(chunks) > 1 and chunks[0][-1:].isspace())
            out.append(self._ids(text) + closing if whole else self._ids(chunks[0]) + b"".join(ids) + closing)
        return out


def cuts(tokens: int, size: int) -> list[int]:
    """Where a document's pieces begin."""
    out = list(range(0, tokens, size))
    if tokens % size > size // 2:
        out.append(tokens - tokens % size + size // 2)
    return out


def token_pieces(path: str, ranks_path: str | None, size: int):
    """Texts -> token counts and their pieces (start, length, checksum)."""
    def make():
        encode = Encoder(path, ranks_path)

        def run(texts: list) -> list:
            tokens, pieces = [], []
            for raw in encode(texts):
                n = len(raw) // 4
                at = cuts(n, size)
                tokens.append(n)
                pieces.append([(a, b - a, zlib.crc32(raw[4 * a:4 * b]))
                               for a, b in zip(at, [*at[1:], n], strict=True)])
            return [tokens, pieces]

        return run
    return make


def best_pattern(lengths: np.ndarray, value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of lengths worth most within ``size``."""
    use = np.flatnonzero(value > 1e-12)
    s, y = lengths[use], value[use]
    worth, last = np.zeros(size + 1), np.full(size + 1, -1)
    upto = np.searchsorted(s, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        worth[c] = worth[c - 1]
        if upto[c]:
            options = worth[c - s[:upto[c]]] + y[:upto[c]]
            k = int(options.argmax())
            if options[k] > worth[c]:
                worth[c], last[c] = options[k], k
    pattern, c = np.zeros(len(lengths)), size
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[use[last[c]]] += 1
            c -= s[last[c]]
    return worth[size], pattern


def greedy(lengths: np.ndarray, left: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and copies that use up ``left``: the longest item with the fullest
    subset of the rest, as often as it lasts."""
    left, out = left.astype(np.int64).copy(), []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        pattern = np.zeros(len(lengths), np.int64)
        pattern[first] = 1
        room, stages, reach = size - int(lengths[first]), [], 1
        mask = (1 << (room + 1)) - 1
        for i in np.flatnonzero(left - pattern > 0)[::-1]:
            for _ in range(min(int(left[i] - pattern[i]), room // int(lengths[i]))):
                stages.append((int(i), reach))
                reach |= (reach << int(lengths[i])) & mask
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        for i, before in reversed(stages):
            if not before >> total & 1:
                total -= int(lengths[i])
                pattern[i] += 1
        used = pattern > 0
        copies = int((left[used] // pattern[used]).min())
        left -= copies * pattern
        out.append((pattern, copies))
    return out


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int,
                      rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """LP of the cutting-stock problem: basic patterns (columns) and their amounts.

    The greedy patterns are offered first; the knapsack prices the rest.
    """
    fit = (size // lengths).astype(float)
    basis, inverse, amount = np.diag(fit), np.diag(1 / fit), demand / fit
    pool = np.array([p for p, _ in greedy(lengths, demand, size)], float).T
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        offered = duals @ pool
        k = int(offered.argmax())
        worth, column = float(offered[k]), pool[:, k]
        if worth <= 1 + 1e-6:
            worth, column = best_pattern(lengths, duals, size)
        if worth <= 1 + 1e-9 or amount.sum() * (1 - 1 / worth) <= max(0.5, GAP * amount.sum()):
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        least = ratio[r]
        amount = np.maximum(amount - least * step, 0)
        amount[r] = least
        inverse[r] /= step[r]
        step[r] = 0
        inverse -= np.outer(step, inverse[r])
        basis[:, r] = column
    return basis, amount


def packing_plan(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(length -> pieces, copies) of every pattern used; meets the histogram exactly."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in lengths], np.int64)
    if not len(lengths):
        return []
    basis, amount = column_generation(lengths, demand.astype(float), size)
    plan, left = [], demand.copy()
    for j in np.argsort(-(amount - np.floor(amount)), kind="stable"):
        column = basis[:, j].astype(np.int64)
        copies = int(np.floor(amount[j] + 1e-9))
        used = column > 0
        copies = min(copies, int((left[used] // column[used]).min()))
        if copies > 0:
            left -= copies * column
            plan.append((column, copies))
    for j in np.argsort(-(amount - np.floor(amount)), kind="stable"):
        column = basis[:, j].astype(np.int64)
        if amount[j] > 1e-9 and (left >= column).all() and column @ lengths > 0.99 * size:
            left -= column
            plan.append((column, 1))
    plan += greedy(lengths, left, size)
    return [({int(lengths[i]): int(c[i]) for i in np.flatnonzero(c)}, n) for c, n in plan]


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[dict[int, tuple], int]:
    """length -> (first rank, pieces a copy, first sequence, offset) of its patterns; sequences."""
    of, sequence = {}, 0
    taken: dict[int, int] = {}
    for pattern, copies in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            per = pattern[length]
            of.setdefault(length, []).append((taken.get(length, 0), per, sequence, offset))
            taken[length] = taken.get(length, 0) + per * copies
            offset += per * length
        sequence += copies
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in of.items()}, sequence


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id",
         text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``ranks_path`` may name a file that holds the tokenizer's own vocabulary as ranks.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    piece = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    counted = map_texts(rows, "_t", [T.StructField("doc_tokens", T.LongType()),
                                     T.StructField("pieces", T.ArrayType(piece))],
                        token_pieces(tokenizer_path, ranks_path, size))
    pieces = kept(counted.select("_id", "doc_tokens", F.inline("pieces")), "pack-pieces")
    order = ["length", "_id", "start"]
    ranked = kept(pieces.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_row", F.monotonically_increasing_id()), "pack-ranked") \
        .withColumn("_pid", F.shiftright("_row", 33))
    # one row for each partition and length: at most partitions + size, as both are sorted
    parts = ranked.groupBy("_pid", "length").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first"))
    ahead = Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_pid", "length", (F.coalesce(F.sum("n").over(ahead), F.lit(0))
                                             - F.col("_first")).alias("_shift"))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(size, 0)
    of, _ = slots([*packing_plan(histogram, size), *([({size: 1}, full)] if full else [])])
    shared = docs.sparkSession.sparkContext.broadcast(of)  # bounded by the patterns of ``size`` lengths
    r = ranked.join(F.broadcast(starts), ["_pid", "length"]).withColumn("_rank", F.col("_row") + F.col("_shift"))
    names = r.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            lengths, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence_id, offset = np.zeros((2, len(rank)), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, per, sequence, at = table[int(length)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                copy, nth = np.divmod(rank[own] - first[k], per[k])
                sequence_id[own], offset[own] = sequence[k] + copy, at[k] + nth * length
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence_id), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    placed = r.mapInArrow(assign, T.StructType([*r.schema.fields, T.StructField("sequence_id", T.LongType()),
                                                T.StructField("offset", T.LongType())]))
    return placed.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")
