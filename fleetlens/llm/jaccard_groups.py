"""N-gram Jaccard self-join with a token-group matrix.

Links (set overlap of word shingles at or above a threshold) are found exactly;
what comes out are the links' components.

1. Every text becomes a set of 64-bit shingle hashes; equal sets collapse to one
   representative, keyed by a hash of its fingerprint and its smallest id (salted
   anew until no two keys are equal), so that an id may stand at several sets.
2. Shingles are ordered by how many sets hold them, rarest first.  The order
   uses the shingles below a hash threshold (a fixed share of all, counted over
   all documents; the rest follow by hash), so one order holds everywhere.  Two
   sets at the threshold share a shingle among the first few of each (prefix
   filter), and the shorter one needs still fewer (its index prefix).
3. Partition: a set is compared with the hub (smallest key) of each shared shingle
   of its prefix; documents of one component of the links found, or else of one
   hub, are similar and are dealt into groups of about ``GROUP`` members.
   Each group that is not one component is compared with itself first.
4. Matrix: (shingle, group) for the prefixes of a group's members.  Two groups
   meet if they share a prefix shingle, hold fitting lengths and are not all one
   component.  A document opens the other group only if its overlap with the
   group's union of shingles reaches the least overlap a link needs.
5. Opened groups are compared member by member, exactly, until all is one
   component.  What comes out of a comparison are edges between components, fewer
   than it has components, so very many near copies give few rows however many of
   their pairs link; documents that share much but do not link are compared within
   pairs of groups, never as rows.

Shingle counts go through hash ranges that sum and answer blocks of sorted
hashes; only sets that share a prefix shingle are built a second time.  The
Bloom filter that selects them has a fixed size and only saves work.

Defined cases: a text that is null or has no word has an empty set and links with
nothing; with fewer words than a shingle has the whole sequence is the one
shingle; a null id is a document that links with nothing and whose component is
null; rows that repeat an id each get their own set's component, and an id links
nothing: unlinked components may have the same smallest id; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import (kept, map_texts, mix64, squeeze, squeeze_sorted, stretch,
                                  stretch_sorted)
from fleetlens.llm.components import components
from fleetlens.llm.exact_dedup import md5_128

WORDS, PERCENT = 3, 90
GROUP = 64
#: share of the hash space whose shingles are counted for the order
COUNTED = 0.3
BLOCK_KEYS, KEYS_PER_RANGE, BLOOM_BITS = 500_000, 1_000_000, 1 << 23
PAIRS_AT_ONCE = 500


def shingle_sets(texts: list, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    vocab: dict[bytes, int] = defaultdict()
    vocab.default_factory = vocab.__len__
    seqs = []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        seqs.append(np.fromiter(map(vocab.__getitem__, w), np.int64, len(w)))
    vocab.default_factory = None  # it holds the vocabulary: a cycle that stays until the collector runs
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))
    out = []
    for seq in seqs:
        h, n = keys[seq], min(words, len(seq))
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        with np.errstate(over="ignore"):
            s = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
        out.append(np.unique(s))
    return out


def least_overlap(n: int, percent: int) -> int:
    """Shingles a set of n shares with any set it links to, at least."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def index_length(n: int, percent: int) -> int:
    """Prefix that suffices for the shorter set of a link."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def set_key(fp: Column, least_id: Column, salt: int) -> Column:
    return F.xxhash64(fp, least_id, F.lit(salt))


def _set_rows(words: int, percent: int):
    """Texts -> size, set fingerprint, the shingles that can enter the prefix (sorted)."""
    edge = np.uint64(int(COUNTED * 2 ** 64))

    def make():
        def run(texts: list) -> list:
            sizes, prints, listed = [], [], []
            for s in shingle_sets(texts, words):
                n = len(s)
                sizes.append(n)
                prints.append(fingerprint(s) if n else None)
                upto = max(int(np.searchsorted(s, edge)), prefix_length(n, percent) if n else 0)
                listed.append(squeeze_sorted(s[:upto]))  # sorted, so the counted ones come first
            return [sizes, prints, listed]
        return run
    return make


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Sets in blocks: number, rows, all their listed shingles, where each set's begin."""
    rows, n, nth = [], 0, 0

    def close():
        lists = [r[2] for r in rows]
        flat = np.concatenate(lists)
        seal = xxhash.xxh64(flat.tobytes(), seed=nth)
        task = TaskContext.get()
        seal.update(f"{task.partitionId() if task else 0}:{[r[0] for r in rows]}")
        return int(np.uint64(seal.intdigest()).astype(np.int64)), rows, flat, [len(x) for x in lists]

    for b in batches:
        for rep, size, listed in zip(*(b.column(c).to_pylist() for c in ("rep", "n", "listed")), strict=True):
            rows.append((rep, size, stretch_sorted(listed)))
            n += len(rows[-1][2])
            if n >= BLOCK_KEYS:
                yield close()
                rows, n, nth = [], 0, nth + 1
    if rows:
        yield close()


def range_edges(ranges: int, percent: int) -> np.ndarray:
    """Where hash ranges begin: ``ranges`` over the share of the hash space that is listed of every set
    and as many over the rest, where only the prefixes of short sets lie."""
    low = int(min(max(COUNTED, 1 - percent / 100), 0.9) * 2 ** 64)
    return np.array([i * low // ranges for i in range(ranges)]
                    + [low + i * (2 ** 64 - low) // ranges for i in range(ranges)], np.uint64)


def _ask(ranges: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = range_edges(ranges, percent)
        for number, _, flat, _ in _blocks(batches):
            keys, n = np.unique(flat, return_counts=True)
            cut = np.append(np.searchsorted(keys, edges), len(keys))
            out = [(number, i, squeeze_sorted(keys[cut[i]:cut[i + 1]]),
                    squeeze(n[cut[i]:cut[i + 1]].astype(np.uint32)))
                   for i in range(len(edges)) if cut[i] < cut[i + 1]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["block", "range", "keys", "n"])
    return run


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    keys = [stretch_sorted(x) for x in asked["keys"]]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([stretch(x, np.uint32) for x in asked["n"]]),
                        minlength=len(distinct)).astype(np.uint32)
    cut = np.cumsum([len(k) for k in keys])[:-1]
    return pd.DataFrame({"block": asked["block"], "range": asked["range"],
                         "n": [squeeze(x) for x in np.split(total[inverse], cut)]})


def _state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, rows, flat, lens in _blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
             pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())),
             pa.array([squeeze(flat)], pa.binary())], names=["block", "reps", "ns", "lens", "flat"])


def _prefixes(percent: int):
    """Answered blocks -> the shared shingles of every set's prefix."""
    edge = np.uint64(int(COUNTED * 2 ** 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["answers"] is None:
                    raise ValueError("the sets read back differently; write them to a table first")
                flat = stretch(row["flat"], np.uint64)
                keys, inverse = np.unique(flat, return_inverse=True)
                df = np.concatenate([stretch(a["n"], np.uint32) for a in row["answers"]])
                if len(df) != len(keys):
                    raise ValueError("the sets read back differently; write them to a table first")
                cols, at = [[], [], [], []], 0
                for rep, n, size in zip(row["reps"], row["ns"], row["lens"], strict=True):
                    own, held = flat[at:at + size], df[inverse[at:at + size]].astype(np.int64)
                    at += size
                    order = np.lexsort((own, np.where(own < edge, held, np.iinfo(np.int64).max)))
                    order = order[:prefix_length(n, percent)]
                    short = index_length(n, percent)
                    place = np.flatnonzero(held[order] > 1)
                    for c, v in zip(cols, (own[order[place]].astype(np.int64), np.full(len(place), rep),
                                           np.full(len(place), n), place < short), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 names=["token", "rep", "n", "indexed"])
    return run


def prefix_entries(sets: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n, indexed): shared shingles of the sets' prefixes, by the global order."""
    total = sets.agg(F.sum("listed_n")).first()[0] or 0
    asked = sets.select("rep", "n", "listed").mapInArrow(
        _ask(max(1, math.ceil(total / KEYS_PER_RANGE)), percent), "block long, range int, keys binary, n binary")
    answers = asked.groupBy("range").applyInPandas(_answer, "block long, range int, n binary") \
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "n"))).alias("answers"))
    state = sets.select("rep", "n", "listed").mapInArrow(
        _state, "block long, reps array<long>, ns array<long>, lens array<long>, flat binary")
    return state.join(answers, "block", "left").mapInArrow(
        _prefixes(percent), "token long, rep long, n long, indexed boolean")


def bloom(ids: DataFrame) -> np.ndarray:
    """Bits of a fixed-size Bloom filter over ``_id`` (two positions an id)."""
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("_id", F.lit(i)), F.lit(BLOOM_BITS))
                                           for i in range(2)])).alias("p"))
    words = spots.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, salt: int) -> DataFrame:
    """(rep, keys), once for each of the wanted (rep, fp, _id), and some others that the
    Bloom filter over the ids lets through."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(bloom(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(bits.value).astype(bool)
        for b in batches:
            hit = on[b.column("_p").to_numpy(zero_copy_only=False)] & on[b.column("_q").to_numpy(zero_copy_only=False)]
            b = b.filter(pa.array(hit))
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                sets = shingle_sets(part.column("_t").to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array([fingerprint(s) for s in sets], pa.binary()),
                     pa.array([squeeze_sorted(s) for s in sets], pa.binary())], names=["_id", "fp", "keys"])

    spot = [F.pmod(F.xxhash64("_id", F.lit(i)), F.lit(BLOOM_BITS)).alias(c) for i, c in enumerate(("_p", "_q"))]
    found = docs.where(F.col("_id").isNotNull()).select("_id", "_t", *spot) \
        .mapInArrow(run, "_id long, fp binary, keys binary")
    found = kept(found.select(set_key(F.col("fp"), F.col("_id"), salt).alias("rep"), "fp", "keys"), "jaccard-full")
    # rows that repeat an id with its set, and others that fall on a wanted key
    again = kept(found.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("rep"), "jaccard-again")
    if again.isEmpty():
        return found.select("rep", "keys")
    once = found.join(again, "rep", "left_semi").groupBy("rep", "fp").agg(F.first("keys").alias("keys")) \
        .join(wanted.select("rep", "fp"), ["rep", "fp"], "left_semi")
    return kept(found.join(again, "rep", "left_anti").select("rep", "keys").unionByName(
        once.select("rep", "keys")), "jaccard-full")


def _tested(pairs: DataFrame, left: DataFrame, right: DataFrame, keep) -> DataFrame:
    """The (a, b) pairs whose shingle arrays pass ``keep``; left and right are (id, keys)."""
    joined = pairs.join(left.select(F.col("rep").alias("a"), F.col("keys").alias("ka")), "a") \
        .join(right.select(F.col("rep").alias("b"), F.col("keys").alias("kb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
                part = whole.slice(at, PAIRS_AT_ONCE)
                known: dict[bytes, np.ndarray] = {}  # arrays unpacked once
                ok = []
                for pair in zip(part.column("ka").to_pylist(), part.column("kb").to_pylist(), strict=True):
                    for x in pair:
                        if x not in known:
                            known[x] = stretch_sorted(x)
                    ok.append(keep(known[pair[0]], known[pair[1]]))
                out = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])

    return joined.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def _unpacked(sets: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.array([s["component"] for s in sets]), [stretch_sorted(s["keys"]) for s in sets]


def group_links(one: tuple, two: tuple, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two groups, as edges between components."""
    (ca, ka), (cb, kb) = one, two
    union, spot = np.unique(np.concatenate(kb), return_inverse=True)
    na, nb = np.array([len(k) for k in ka]), np.array([len(k) for k in kb])
    # the bound: a document opens the group only if it shares enough with the group's union
    inside = [k[np.isin(k, union, assume_unique=True)] for k in ka]
    open_ = np.flatnonzero([len(k) >= least_overlap(n, percent) for k, n in zip(inside, na, strict=True)])
    owner = np.repeat(np.arange(len(kb)), nb)
    # the component that each one has become part of, as a place in names
    names, place = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    place_a, place_b = place[:len(ca)], place[len(ca):]
    now = np.arange(len(names))
    out = []
    for i in open_:
        apart = now[place_b] != now[place_a[i]]
        if not apart.any():
            continue
        own = np.zeros(len(union), bool)
        own[np.searchsorted(union, inside[i])] = True
        same = np.bincount(owner, weights=own[spot], minlength=len(kb)).astype(np.int64)
        for j in np.flatnonzero(apart & (100 * same >= percent * (na[i] + nb - same))):
            x, y = now[place_a[i]], now[place_b[j]]
            if x != y:
                now[now == y] = x
                out.append((int(ca[i]), int(cb[j])))
    return out


def _group_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                one = _unpacked(row["sa"])
                got = group_links(one, _unpacked(row["sb"]) if "sb" in row else one, percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)],
                                                 names=["a", "b"])
    return run


def _gathered(members: DataFrame, found: DataFrame) -> DataFrame:
    """(g, sets): the sets of each group, at most a few times ``GROUP`` of them."""
    return members.join(found, "rep").groupBy("g").agg(
        F.collect_list(F.struct("component", "keys")).alias("sets"))


def _joined(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members after the components between which there are edges have become one."""
    if edges.isEmpty():
        return members
    new = components(edges).select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return members.join(new, "component", "left").select(
        "rep", "n", F.coalesce("_new", "component").alias("component"), "g")


def _linked_rows(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(_id, _d, _t) rows -> _id, _d, n and their component's smallest (_id, _d) as ``top``."""
    sets = kept(map_texts(rows, "_t", [T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()),
                                       T.StructField("listed", T.BinaryType())],
                          _set_rows(words, percent)), "jaccard-sets")
    real = sets.where("fp is not null and _id is not null")
    size = F.greatest(F.ceil(F.col("n") * F.lit(COUNTED)), F.col("n") * F.lit(1 - percent / 100) + 1)
    plain = kept(real.groupBy("fp").agg(F.min(F.struct("_id", "_d")).alias("top"), F.first("n").alias("n"),
                                        F.first("listed").alias("listed"))
                 .withColumn("listed_n", size.cast("long")), "jaccard-reps")
    for salt in count():
        reps = plain.withColumn("rep", set_key(F.col("fp"), F.col("top._id"), salt))
        if reps.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty():
            break
    entries = kept(prefix_entries(reps, percent), "jaccard-entries")

    # partition: compare every set with the hubs of its prefix shingles
    hubs = entries.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("m")) \
        .where("m > 1").select("token", F.col("hub.rep").alias("b"), F.col("hub.n").alias("nb"))
    fits = F.expr(f"100 * least(n, nb) >= {percent} * greatest(n, nb)")
    star = kept(entries.join(hubs, "token").where((F.col("rep") != F.col("b")) & fits)
                .select(F.col("rep").alias("a"), "b").distinct(), "jaccard-star")
    shared = entries.join(hubs.select("token"), "token", "left_semi")
    wanted = reps.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "fp", "top._id")
    found = full_sets(rows, wanted, words, salt)

    def link(a, b):
        return linked(a, b, percent)

    links = kept(_tested(star, found, found, link), "jaccard-links")
    first = components(links)

    # groups of similar documents: linked ones, or those that share a hub
    near = entries.join(hubs, "token").groupBy("rep").agg(F.min("b").alias("home"))
    members = shared.select("rep", "n").distinct().join(first.withColumnRenamed("node", "rep"), "rep", "left") \
        .join(near, "rep").withColumn("home", F.coalesce("component", "home")) \
        .withColumn("component", F.coalesce("component", "rep"))
    sized = members.groupBy("home").agg(F.count(F.lit(1)).alias("m"))
    members = kept(members.join(sized, "home").select("rep", "n", "component", F.xxhash64("home", F.pmod(
        F.xxhash64("rep"), F.ceil(F.col("m") / GROUP))).alias("g")), "jaccard-members")
    several = members.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo < hi").select("g")
    inner = _gathered(members.join(several, "g", "left_semi"), found).select(F.col("sets").alias("sa"))
    inner = kept(inner.mapInArrow(_group_links(percent), "a long, b long"), "jaccard-inner")
    members = kept(_joined(members, inner), "jaccard-members")
    known = shared.drop("n").join(members, "rep")
    mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo < hi").select("token")
    matrix = kept(known.join(mixed, "token", "left_semi").groupBy("token", "g").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("indexed").alias("indexed"),
        F.min("component").alias("lo"), F.max("component").alias("hi")), "jaccard-matrix")
    short = matrix.where("indexed").select("token", *[F.col(c).alias(f"_{c}") for c in ("g", "least", "most", "lo", "hi")])
    # a longer set probes a shorter one's index prefix; groups that are one component need no test
    pairs = matrix.join(short, "token").where(
        (F.col("most") >= F.col("_least")) & (F.col("least") * percent <= F.col("_most") * 100)
        & (F.least("lo", "_lo") < F.greatest("hi", "_hi"))) \
        .select(F.least("g", "_g").alias("a"), F.greatest("g", "_g").alias("b")).where("a <> b").distinct()
    pairs = kept(pairs, "jaccard-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    groups = kept(_gathered(members.join(needed, "g"), found), "jaccard-groups")
    more = pairs.join(groups.select(F.col("g").alias("a"), F.col("sets").alias("sa")), "a") \
        .join(groups.select(F.col("g").alias("b"), F.col("sets").alias("sb")), "b") \
        .select("sa", "sb").mapInArrow(_group_links(percent), "a long, b long")
    last = kept(more, "jaccard-more")
    final = _joined(members, last).select("rep", "component")

    own = kept(final.join(reps.select("rep", "fp", "top"), "rep"), "jaccard-own")
    tops = own.groupBy("component").agg(F.min("top").alias("_top"))
    moved = own.join(tops, "component").select("fp", "_top")
    own = reps.select("fp", "top").join(moved, "fp", "left").select("fp", F.coalesce("_top", "top").alias("top"))
    return sets.select("_id", "_d", "n", "fp").join(own, "fp", "left").select("_id", "_d", "n", "top")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    out = _linked_rows(docs.select(F.col(id_col).cast("long").alias("_id"), F.lit(None).cast("binary").alias("_d"),
                                   F.col(text_col).alias("_t")), words, percent)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("_id").isNotNull(), F.coalesce("top._id", "_id")).alias("component_id"))


def text_digest(text: Column) -> Column:
    return md5_128(F.coalesce(text, F.lit("")))


def surplus_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(_id, _d): id and text digest of all rows but the smallest of each component."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_digest(F.col(text_col)).alias("_d"),
                       F.col(text_col).alias("_t"))
    return _linked_rows(rows, words, percent).where(
        F.col("_id").isNotNull() & (F.struct("_id", "_d") != F.col("top"))).select("_id", "_d").distinct()
