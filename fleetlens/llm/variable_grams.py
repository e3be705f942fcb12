"""Spelling variants of a corpus' words by a variable-length gram index.

* **Dictionary.**  All grams of 2 to ``Q_MAX`` symbols of the words (between two
  boundary marks) are counted; of those longer than 2 the frequent ones stay:
  at least one in ``GRAMS`` of all their occurrences, so there are at most ``GRAMS``
  of them whatever the vocabulary.  Grams of 2 always count as present.
* **Decomposition.**  At each place a word takes the longest gram of the dictionary,
  unless an earlier one covers it: frequent beginnings go on in longer grams, rare
  ones stay short.
* **Affected grams.**  For each place of an edit the grams are counted that it may
  change: those that cover it, those before it that could grow over it (their text
  up to the edit begins a longer gram), and those behind it that could be covered by
  one (their text from the edit ends a longer gram).  The largest count bounds how
  many grams of the word a word one edit away can lack.
* **List merging.**  With grams in one order, rarest first, two words one edit apart
  share one among the first (bound + 1) of each, at the same place for a replaced
  symbol and at the same or the next for an inserted one.  Lists are kept under
  (gram, place, length), merged by an equi-join, and each pair that meets is
  verified by its distance within the join, so no unverified pair leaves it.

Longer grams suit longer words: of a word of n symbols they have at most (n + 2) // 2,
which leaves its first or its last gram untouched by any edit, so the bound is always
below the number of grams and no word needs another path.  A word and a longer one are
compared in the gram length of the shorter.

Defined cases: a null text has no words; a null id counts as the empty text in
the hash that alters runs; rows count as often as they occur; an empty table or one
without words gives an empty result.  Columns beyond id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, kept

LETTERS = r"A-Za-zÀ-ÿ"
#: shortest word, fewest occurrences, and one in how many runs is altered
SHORTEST, FEWEST, ALTERED = 5, 3, 97
Q_MIN, Q_MAX = 2, 6
#: most grams of more than two symbols in the dictionary
GRAMS = 50_000
#: words decomposed at once
STEP = 4096
HEAD, TAIL = "^", "$"


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the distinct words of all texts, after the contract's alterations."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run.alias("_run")) \
        .select("_id", ascii_lower(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = F.pmod(F.col("_h"), F.char_length("_run").cast("long")).cast("int")
    rest = F.concat(F.left("_run", at), F.substring("_run", at + F.lit(2), F.char_length("_run")))
    word = F.when(F.col("_h") % ALTERED == 0, rest).otherwise(F.col("_run"))
    return rows.withColumn("_h", h).select(word.alias("word")).where(F.char_length("word") >= SHORTEST) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEWEST)


def longest(n: int) -> int:
    """The longest gram that a word of ``n`` symbols is taken apart into."""
    return min(Q_MAX, (n + 2) // 2)


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, n: how often each gram of 2 to ``Q_MAX`` symbols occurs in the distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                c: Counter = Counter()
                for w in whole.slice(a, STEP).column(0).to_pylist():
                    s = HEAD + w + TAIL
                    for q in range(Q_MIN, Q_MAX + 1):
                        c.update(s[i:i + q] for i in range(len(s) - q + 1))
                yield pa.RecordBatch.from_pydict({"gram": list(c), "n": list(c.values())})

    return words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Dictionary:
    """The kept grams, what begins and ends them, and the order of the lists."""

    def __init__(self, counts: dict[str, int]):
        self.grams = {g for g in counts if len(g) > Q_MIN}
        sizes = range(Q_MIN, Q_MAX + 1)
        # what begins and what ends a gram of at most q symbols that is longer
        self.begins = {q: {g[:k] for g in self.grams if len(g) <= q for k in range(1, len(g))} for q in sizes}
        self.ends = {q: {g[-k:] for g in self.grams if len(g) <= q for k in range(1, len(g))} for q in sizes}
        # occurrences that do not go on in a longer gram
        net = dict(counts)
        for g in self.grams:
            if g[:-1] in net:
                net[g[:-1]] -= counts[g]
        self.rank = {g: i for i, g in enumerate(sorted(net, key=lambda g: (net[g], g)))}

    def decompose(self, s: str, q: int) -> list[tuple[int, int]]:
        """(from, to) of the grams of the marked word ``s``."""
        out, covered = [], 0
        for p in range(len(s) - Q_MIN + 1):
            e = next((p + k for k in range(min(q, len(s) - p), Q_MIN, -1) if s[p:p + k] in self.grams), p + Q_MIN)
            if e > covered:
                out.append((p, e))
                covered = e
        return out

    def affected(self, s: str, spans: list[tuple[int, int]], q: int) -> tuple[int, int]:
        """Most grams that one edit may change: a replaced or deleted symbol, an inserted one."""
        begins, ends, size, total = self.begins[q], self.ends[q], len(s), len(spans)
        # both ends of the grams rise, so those that begin (end) before a place come first
        starting, ending = [0] * (size + 2), [0] * (size + 2)
        for p, e in spans:
            starting[p + 1] += 1
            ending[e] += 1
        for i in range(1, size + 2):
            starting[i] += starting[i - 1]  # grams that begin before i
            ending[i] += ending[i - 1]  # grams that end at i or before
        before, behind = [0] * (size + 1), [0] * (size + 1)
        for i in range(1, size):
            # untouched before an edit at i: ended, and begun before all that could grow over it
            first = i
            for p in range(max(0, i - q + 1), i):
                if s[p:i] in begins:
                    first = p
                    break
            before[i] = min(ending[i], starting[first])
            # untouched behind what stands from i on: begun, and ending after all that could cover it
            last = i
            for e in range(min(size, i + q - 1), i, -1):
                if s[i:e] in ends:
                    last = e
                    break
            behind[i] = total - max(starting[i], ending[last])
        changed = total - min(before[i] + behind[i + 1] for i in range(1, size - 1))
        return changed, total - min(before[i] + behind[i] for i in range(1, size))

    def rarest(self, s: str, spans: list[tuple[int, int]]) -> list[tuple[str, int]]:
        """(gram, place) in the order of the lists."""
        rank = self.rank
        return [(g, p) for _, g, p in sorted([(rank.get(s[p:e], -1), s[p:e], p) for p, e in spans])]

    def lists(self, word: str) -> Iterator[tuple[str, str]]:
        """(role, key) under which a word is listed: ``=`` with words of its length,
        ``<`` with longer ones, ``>`` with shorter ones."""
        s, n = HEAD + word + TAIL, len(word)
        q = longest(n)
        spans = self.decompose(s, q)
        changed, inserted = self.affected(s, spans, q)
        order = self.rarest(s, spans)
        for g, p in order[:changed + 1]:
            yield "=", f"{g}{p}:{n}"
        for g, p in order[:inserted + 1]:
            yield "<", f"{g}{p}:{n + 1}"
            yield "<", f"{g}{p + 1}:{n + 1}"
        if longest(n - 1) != q:
            q = longest(n - 1)
            spans = self.decompose(s, q)
            changed, order = self.affected(s, spans, q)[0], self.rarest(s, spans)
        for g, p in order[:changed + 1]:
            yield ">", f"{g}{p}:{n}"


def letters(word: str) -> int:
    """Which of 63 classes of letters a word holds; one edit changes at most two of them."""
    mask = 0
    for c in word:
        mask |= 1 << ord(c) % 63
    return mask


def dictionary(words: DataFrame) -> Dictionary:
    """At most ``GRAMS`` grams, and one for each two symbols, come to the driver."""
    counts = kept(gram_counts(words), "gram-counts")
    long = F.char_length("gram") > Q_MIN
    total = counts.where(long).agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // GRAMS))
    return Dictionary({r["gram"]: r["n"] for r in counts.where(~long | (F.col("n") >= least)).toLocalIterator()})


def gram_lists(words: DataFrame, grams: Dictionary) -> DataFrame:
    """role, key, word, n, mask: every word under its first (bound + 1) grams, for each role."""
    held = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                part = whole.slice(a, STEP).to_pydict()
                rows = [(*x, w, n, m) for w, n in zip(part["word"], part["n"]) for m in [letters(w)] for x in d.lists(w)]
                yield pa.RecordBatch.from_pydict(dict(zip(("role", "key", "word", "n", "mask"), map(list, zip(*rows)))))

    return words.select("word", "n").where(F.char_length("word") >= 1) \
        .mapInArrow(run, "role string, key string, word string, n long, mask long")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: both directions of every two words one edit apart."""
    if words.isEmpty():
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    lists = kept(gram_lists(words, dictionary(words)), "gram-lists")

    def side(role: str, word: str, n: str) -> DataFrame:
        return lists.where(F.col("role") == role).select("key", F.col("word").alias(word), F.col("n").alias(n), F.col("mask").alias(f"{word}_mask"))

    # most pairs that meet differ in more letters than one edit can change, which is cheaper to see
    one = (F.bit_count(F.col("word_mask").bitwiseXOR(F.col("other_mask"))) <= 2) & (F.levenshtein("word", "other", 1) == 1)
    same = side("=", "word", "n").join(side("=", "other", "other_n"), "key").where((F.col("word") < F.col("other")) & one)
    longer = side("<", "word", "n").join(side(">", "other", "other_n"), "key").where(one)
    pairs = same.unionByName(longer).select("word", "n", "other", "other_n").distinct()
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"),
                             F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                      F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("_p")).select("_p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: follow ``form`` to its end; each round doubles the steps taken."""
    at = kept(forms.select("word", F.coalesce("form", "word").alias("root")), "word-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = kept(at.join(ahead, "root").select("word", F.col("_next").alias("root"),
                                                 (F.col("_next") != F.col("root")).alias("_moved")), "word-roots")
        at = new.select("word", "root")
        if new.where("_moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    words = kept(corpus_words(docs, id_col, text_col), "corpus-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    fits = -F.col("_best.less") >= 2 * F.col("n")
    forms = kept(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("_best.other")).alias("form"), F.when(fits, -F.col("_best.less")).alias("form_n")), "word-forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
