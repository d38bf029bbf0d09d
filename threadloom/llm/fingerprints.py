"""Document fingerprints by one-permutation MinHash; DataFrame functions only.

A text is lower-cased (A-Z) and split on ASCII white space; its shingles of five words (the whole sequence, if shorter)
are hashed once and binned by the range their hash falls into, so that after one sort of the hashes the first of each
bin is its minimum. Empty bins are filled by optimal densification: each takes the value of the first filled bin in a
random order of its own, the same for all documents. Of each bin, hashed with its number, the low-order bits are kept,
packed sixteen bins of four bits to a long; likeness corrects the share of equal bins for chance.

Null texts count as empty, very long ones count whole; there are no ties but of equal hashes, which are one; texts without
words have the empty fingerprint, alike to one another (1) and to nothing else
(0). Equal texts have equal fingerprints. Other columns are carried along, whatever their names; rows are fingerprinted one
by one, repeated ones alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import BLANKS, written

SHINGLE, BINS, BITS, PROBES = 5, 256, 4, 12
_PER_LONG = 64 // BITS
RUN = 4000  # ids in a sorted run


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    split = F.filter(F.split(_lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")
    return F.transform(split, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column) -> Column:
    """From word hashes, the sorted hashes of their shingles."""
    n = F.size(hashes)
    shingles = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]))
    short = F.when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    ordered = F.sort_array(F.when(n >= SHINGLE, shingles).otherwise(short))
    return ordered


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - (BINS.bit_length() - 1)).cast("int") + BINS // 2  # rising with the hash


def fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """df with the fingerprint as an array of longs (empty for texts without words), each step computed once for a row."""
    low = F.lit((1 << BITS) - 1)
    out = df.withColumn("_tl_w", word_hashes(F.col(text)))
    out = out.withColumn("_tl_s", shingle_hashes(F.col("_tl_w"))).drop("_tl_w")
    out = out.withColumn("_tl_m", F.filter("_tl_s", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get("_tl_s", i - 1))))).drop("_tl_s")
    out = out.withColumn("_tl_k", F.transform("_tl_m", _bin))
    out = out.withColumn("_tl_d", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get("_tl_m", (F.array_position("_tl_k", i) - 1).cast("int"))))

    def borrowed(i: Column) -> Column:  # beyond the probes: the filled bin of least hash
        return F.get(F.array_min(F.transform("_tl_k", lambda k: F.array(F.xxhash64(i, F.lit(-1), k), F.get("_tl_d", k)))), 1)

    def value(i: Column) -> Column:
        probes = [F.get("_tl_d", F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        # hashed with the bin, so that two values that many bins hold don't agree by chance in all of them
        return F.xxhash64(i, F.coalesce(F.get("_tl_d", i), *probes, borrowed(i))).bitwiseAND(low)

    out = out.withColumn("_tl_f", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value))
    longs = F.array(*[
        F.aggregate(F.slice("_tl_f", j * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v))
        for j in range(BINS // _PER_LONG)
    ])
    return out.withColumn(to, F.when(F.size("_tl_m") > 0, longs).otherwise(F.array().cast("array<bigint>"))).drop("_tl_m", "_tl_k", "_tl_d", "_tl_f")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of equal bins, less what chance makes equal."""
    def equal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for by in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        return F.lit(_PER_LONG) - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    share = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), (share - F.lit(chance)) / F.lit(1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def spelled(a: Column) -> Column:
    """A fingerprint as hexadecimal digits, one for each bin."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and likeness to these and to the next document.

    The next document is that of the next greater doc_id, after the last the first; of repeated ids the least text
    stands for all. The edit replaces the last quarter of code points by as many from the start of the next document.
    Rows without doc_id share one next document, the first; they are nobody's next unless nothing else is there.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    base = base.withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int")).withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    following = _following(base.groupBy("doc_id").agg(F.max("quarter").alias("quarter")))
    held = fingerprint(base.drop("quarter"), "text", "own").repartition("k")  # texts move once, and are read twice
    heads = held.groupBy("k").agg(F.min(F.struct("text", "own", "n_chars", "doc_id")).alias("head"))
    sent = heads.join(following, heads["k"] == following["next"]).select(
        F.col("to").alias("k"), F.expr("substring(head.text, 1, quarter)").alias("start"), F.col("head.own").alias("after")
    )
    rows = held.join(sent, "k").withColumn("q", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - q), substring(start, 1, q))"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "start")
    rows = fingerprint(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )


def _following(ids: DataFrame) -> DataFrame:
    """(to, quarter, next): for each id, spelled, the id after it; ids: (doc_id, quarter), one row each.

    Ids are cut into sorted runs, written so that every reader sees the same runs; the last of a run is followed by the
    first of the next, the last of all by the first of all.
    """
    known = ids.where("doc_id IS NOT NULL")
    count, first = known.agg(F.count("*"), F.min("doc_id")).first()
    runs = max(1, -(-count // RUN))
    known = written(known.repartitionByRange(runs, "doc_id").withColumn("run", F.spark_partition_id()), "ids")
    firsts = known.groupBy("run").agg(F.min("doc_id").alias("first"))
    firsts = firsts.select("run", F.lead("first").over(Window.orderBy("run")).alias("beyond"))  # a row for each run
    after = F.lead("doc_id").over(Window.partitionBy("run").orderBy("doc_id"))
    known = known.withColumn("after", after).join(firsts, "run")
    next_id = F.coalesce("after", "beyond", F.lit(first)).cast("string")
    known = known.select(F.col("doc_id").cast("string").alias("to"), "quarter", next_id.alias("next"))
    none = ids.where("doc_id IS NULL").select(F.lit("none").alias("to"), "quarter", F.lit("none" if first is None else str(first)).alias("next"))
    return known.union(none)
