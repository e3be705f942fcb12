"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text is read as units: what stands between spaces; of more than 24 bytes, runs of at
most 12 ASCII letters or digits and every other code point alone.  Of its k-mers (``K`` units in a row)
those are anchors whose smallest inner substring (``S`` units, ordered by their
hash) is the first or the last one.  Whether a k-mer is an anchor depends on its
own units and on nothing around it, so an edit moves no anchor that it does not
touch, and of ``K - S + 1`` k-mers in a row one at least is an anchor.  The
fingerprint lists, in text order, the hash of every anchor together with its
distance to the next one: two anchors match when their units and the position of
what follows agree, wherever the passage stands.  The likeness of two fingerprints
is 2 * (common anchors) / (anchors of both).

Every document is compared with the document that follows it and with its own
edited text, whose last quarter is the head of that document.  Rows are put in
order on a narrow table of ids and digests; a document's head and anchors then
travel to the one before it by an equi-join on the digest, and texts move once.

Defined cases: a null text counts as empty; a text without an anchor (one of fewer
than ``K`` units) has its units as one anchor, and one without a unit the whole
text; the empty text has the empty fingerprint, alike (1) to an empty one and
unlike (0) to any other.  Null ids come first; rows that repeat an id come in the
order of their digests, and of rows that repeat id and text each is followed by
the next of them.  The last document is followed by the first, a single one by
itself.  An empty table gives an empty result.  Memory is linear in the longest
text.  Columns beyond id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import kept

UNIT, UNIT_BYTES = r"[0-9A-Za-z]{1,12}|[^0-9A-Za-z]", 24
#: units of a k-mer and of the inner substrings that are compared; K - S + 1 must be 8
K, S = 9, 2
WINDOW = K - S + 1
#: copies of one row that are expanded at once
COPIES = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a lambda would compute it for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(text: Column) -> Column:
    """The units of a text (a plain split is several times cheaper than a pattern over all of it)."""
    return F.flatten(F.transform(F.split(text, " "), lambda u: F.when(u == "", F.array().cast("array<string>")).when(
        F.octet_length(u) <= UNIT_BYTES, F.array(u)).otherwise(F.regexp_extract_all(u, F.lit(UNIT), F.lit(0)))))


def anchors(text: Column) -> Column:
    """The fingerprint of a text as array<int>, in text order."""
    def least(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.least(x, F.get(h, i + F.lit(step))))

    def chosen(h: Column) -> Column:
        edge = lambda m: F.filter(  # noqa: E731  the smallest of 8 is the first or the last of them
            F.sequence(F.lit(0), F.size(h) - F.lit(WINDOW)),
            lambda p: (F.get(h, p) == F.get(m, p)) | (F.get(h, p + F.lit(WINDOW - 1)) == F.get(m, p)))
        return _let(least(h, 1), lambda two: _let(least(two, 2), lambda four: _let(least(four, 4), edge)))

    def of(us: Column) -> Column:
        inner = F.transform(F.slice(us, F.lit(1), F.size(us) - F.lit(S - 1)),
                            lambda u, i: F.xxhash64(u, *[F.get(us, i + F.lit(j)) for j in range(1, S)]))
        marks = lambda at: F.transform(at, lambda p, i: F.hash(
            F.slice(us, p + F.lit(1), F.lit(K)), F.coalesce(F.get(at, i + F.lit(1)) - p, F.lit(0))))
        return F.when(F.size(us) >= K, _let(_let(inner, chosen), marks)) \
            .when(F.size(us) > 0, F.array(F.hash(us, F.lit(0))))

    none = F.when(text == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
    return F.coalesce(_let(units(text), of), none)


def written(marks: Column) -> Column:
    """A fingerprint as text: 8 hex digits for each anchor."""
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common anchors, 0 to 1, of two sets of anchors."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(
        F.lit(2.0) * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def succession(rows: DataFrame) -> DataFrame:
    """(_h, _m, _before, _give): for each distinct row its number of copies, the row before
    it, and how many code points that one takes; the first row follows the last."""
    ordered = rows.groupBy("_h").agg(F.min("_id").alias("_id"), F.min("_n").alias("_n"),
                                     F.count(F.lit(1)).alias("_m"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = kept(ordered.repartitionByRange(parts, F.col("_id").asc_nulls_first(), "_h")
                 .sortWithinPartitions(F.col("_id").asc_nulls_first(), "_h")
                 .select("_h", "_n", "_m", F.monotonically_increasing_id().alias("_at")), "syncmer-order")
    part = F.shiftright("_at", 33)
    # one row for each partition of the table above
    ends = lined.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", F.coalesce(F.sum("_c").over(so_far), F.lit(0)).alias("_first"),
                       F.sum("_c").over(Window.partitionBy()).alias("_all"))
    dense = lined.withColumn("_part", part).join(ends, "_part").select(
        "_h", "_n", "_m", "_all", (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("_at"))
    after = dense.select(F.pmod(F.col("_at") + 1, F.col("_all")).alias("_at"), F.col("_h").alias("_before"),
                         F.floor(F.col("_n") / 4).alias("_give"))
    return dense.select("_h", "_m", "_at").join(after, "_at").select("_h", "_m", "_before", "_give")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, next_id (the id of the document that follows)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    digest = F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("")),
                                     F.lit("\u0000"), F.col("_text")).cast("binary"), 256))
    rows = rows.withColumn("_h", digest)
    order = kept(succession(rows.select("_h", "_id", F.char_length("_text").cast("long").alias("_n"))), "syncmer-next")
    most = order.agg(F.max("_m")).first()[0] or 0
    whole = rows if most < 2 else rows.dropDuplicates(["_h"])
    whole = whole.select("_h", "_id", "_text", anchors(F.col("_text")).alias("_marks")).join(order, "_h")
    head = F.left("_text", F.col("_give").cast("int"))
    given = whole.select(F.col("_before").alias("_h"), head.alias("_head"), F.array_distinct("_marks").alias("_next"),
                         F.col("_id").alias("_next_id"))
    own = whole.select("_h", "_id", "_text", "_marks", F.char_length("_text").alias("_n"), F.lit(1).cast("long").alias("_times"),
                       *(["_m"] if most > 1 else []))
    pairs = own.join(given, "_h")
    if most > 1:  # every copy but the last is followed by a copy
        take = F.left("_text", F.floor(F.col("_n") / 4).cast("int"))
        again = own.where("_m > 1").withColumns({
            "_times": F.col("_m") - 1, "_head": take, "_next": F.array_distinct("_marks"), "_next_id": F.col("_id")})
        pairs = pairs.unionByName(again)
    cut = (F.col("_n") - F.floor(F.col("_n") / 4)).cast("int")
    edited = pairs.withColumn("_edited", F.concat(F.left("_text", cut), "_head")) \
        .withColumn("_edited_marks", anchors(F.col("_edited"))).withColumn("_set", F.array_distinct("_marks"))
    out = edited.select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("_marks")).alias("fingerprint"),
        written(F.col("_edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("_set"), F.array_distinct("_edited_marks")).alias("near_edited"),
        likeness(F.col("_set"), F.col("_next")).alias("near_next"), F.col("_next_id").alias("next_id"), "_times")
    if most > 1:
        out = out.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / COPIES)))) \
            .repartition("_chunk", "edited_sha256") \
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(
                F.lit(COPIES).cast("long"), F.col("_times") - F.col("_chunk") * COPIES)))).drop("_chunk", "_copy")
    return out.drop("_times")
