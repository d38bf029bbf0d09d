"""Mixing sources to target weights, by blocks of fixed length.

Each source's documents, in an order by hash, are one stream of words, packed into blocks of fixed length (the last may
be short). A source's target says how many words it gives: whole rounds over its blocks and a part of one. Output shards
draw multinomial counts of slots over what the sources still have to give, so that the totals come out as planned; the
slots of a source are numbered through the shards, and a slot's block is that number's image under a pseudorandom
permutation of the source's block numbers, one for each round. Slots then join the blocks by index. The last slot of a
source is cut to what its target leaves. A block thus serves at most ceil(target / size) times.

What the driver holds: a row for each source, and one for each source and shard, MOST_CELLS together at most.
Null or empty texts have size 0 and give nothing, very long ones span as many blocks as it takes; null sources are a
source of their own; doc_id may be null or repeat, each row is packed on its own and equal rows are interchangeable, as
are rows of one hash; other columns are carried along, those named source_size, target or taken are replaced; an empty
table mixes to none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import WORD, in_batches, offsets, small_table, tidied, written

BLOCK, SHARD_SLOTS, BUCKET_ROWS = 512, 4096, 64
MOST_CELLS = 4_000_000  # of the matrix of shards and sources that the driver draws; beyond, shards have more slots


def targets(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Shares of total by weight; those above limit times their size stop there, and the excess is shared again."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > limit * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = limit * sizes[i]
        left -= sum(out[i] for i in sorted(over))
        free -= over
    return out


def shard_counts(slots: list[int], per_shard: int, seed: int) -> list[list[int]]:
    """For each shard, how many slots of each source: multinomial draws by what is left, until nothing is."""
    rng = np.random.default_rng(seed)
    left, out = np.array(slots, np.int64), []
    while left.sum():
        row, room = np.zeros_like(left), min(per_shard, int(left.sum()))
        while room:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
            row, left, room = row + drawn, left - drawn, room - int(drawn.sum())
        out.append(row.tolist())
    return out


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of i under a pseudorandom permutation of 0 .. n - 1: a Feistel network over the least even number of
    bits that hold n, walked until the image is below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), i.astype(np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (right + np.uint64((seed * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    x = network(x)
    while (out := x >= np.uint64(n)).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def _slots(block: int):
    """From runs of a source's slot numbers to the blocks they take."""
    import pyarrow as pa

    def make(batches):
        for batch in batches:
            for run in batch.to_pylist():
                size, take = run["size"], run["take"]
                full, wide = size // block, -(-size // block)
                for lo in range(run["first"], run["last"], 100_000):
                    i = np.arange(lo, min(lo + 100_000, run["last"]), dtype=np.int64)
                    turn, j = i // wide, i % wide
                    blocks, words = np.full(len(i), full, np.int64), np.full(len(i), size % block, np.int64)
                    for t in np.unique(turn).tolist():
                        mine = (turn == t) & (j < full)
                        if mine.any():
                            blocks[mine], words[mine] = permuted(j[mine], full, run["seed"] + 7919 * t), block
                    rest = take - (take // size) * size
                    cut = (turn == take // size) & (j == rest // block)
                    words[cut] = rest % block
                    n = len(i)
                    cols = [pa.array([run["shard"]] * n, pa.int32()), pa.array(i), pa.array(turn.astype(np.int32)), pa.array([run["key"]] * n, pa.string()), pa.array(blocks), pa.array(words)]
                    yield pa.RecordBatch.from_arrays(cols, names=["shard", "number", "turn", "_tl_key", "_tl_block", "words"])

    return make


class Mix:
    """A mix of docs(doc_id, source, size, and whatever else) by sources.

    documents: the rows with _tl_key, _tl_bucket and _tl_rn (which together name a row), _tl_start (in the source's
    stream), source_size, target. slots: shard, number, turn, _tl_key, _tl_block, words: the blocks that each shard takes.
    """

    def __init__(self, docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = BLOCK, seed: int = 4):
        docs = docs.drop("source_size", "target", "taken")  # replaced
        spark, self.block = docs.sparkSession, block
        held = docs.withColumn("_tl_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_tl_h", F.xxhash64(F.lit(seed), *docs.columns))
        stats = held.groupBy("source", "_tl_key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
        stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in stats]
        goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), limit)
        self.stats = {r["source"]: (r["size"], goal) for r, goal in zip(stats, goals, strict=True)}
        takes = [min(int(goal + 0.5), int(limit * size)) for goal, size in zip(goals, sizes, strict=True)]
        slots = [(take // size) * -(-size // block) + -(-(take % size) // block) if size else 0 for take, size in zip(takes, sizes, strict=True)]
        per_shard = max(SHARD_SLOTS, -(-sum(slots) * max(1, len(slots)) // MOST_CELLS))
        runs, first = [], [0] * len(slots)
        for shard, row in enumerate(shard_counts(slots, per_shard, seed)):
            for s, n in enumerate(row):
                if n:
                    runs.append((shard, stats[s]["_tl_key"], seed + 104729 * s, sizes[s], takes[s], first[s], first[s] + n))
                    first[s] += n
        runs = small_table(spark, runs, "shard int, key string, seed long, size long, take long, first long, last long")
        self.slots = runs.mapInArrow(tidied(_slots(block)), "shard int, number long, turn int, _tl_key string, _tl_block long, words long")
        # every document's place in its source's stream, summed by bucket first; buckets of all sources are alike in rows
        known = [(r["_tl_key"], size, float(goal), max(1, -(-r["n"] // BUCKET_ROWS))) for r, size, goal in zip(stats, sizes, goals, strict=True)]
        held = held.join(small_table(spark, known, "_tl_key string, source_size long, target double, _tl_buckets long"), "_tl_key")
        held = held.withColumn("_tl_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_tl_h"), F.col("_tl_buckets"))).drop("_tl_buckets")
        starts = offsets(held.groupBy("_tl_key", "_tl_bucket").agg(F.sum("size").alias("n")), "_tl_bucket", "n", ["_tl_key"])
        inside = Window.partitionBy("_tl_key", "_tl_bucket").orderBy("_tl_h", "size")
        before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = held.withColumn("_tl_rn", F.row_number().over(inside)).withColumn("_tl_before", before)
        held = held.join(starts.select("_tl_key", "_tl_bucket", F.col("before").alias("_tl_first")).hint("merge"), ["_tl_key", "_tl_bucket"])
        self.documents = held.withColumn("_tl_start", F.col("_tl_first") + F.col("_tl_before")).drop("_tl_first", "_tl_before", "_tl_h")

    def pieces(self, *columns: str) -> DataFrame:
        """Each document's words block by block: columns, _tl_key, _tl_block, _tl_lo and _tl_hi (words in the block),
        _tl_word (its first). Documents without words have one row, with null block."""
        start, end = F.col("_tl_start"), F.col("_tl_start") + F.col("size")
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(start / self.block), F.floor((end - 1) / self.block)))
        out = self.documents.withColumn("_tl_block", F.explode_outer(blocks))
        at = F.col("_tl_block") * self.block
        lo, hi = F.greatest(start, at), F.least(end, at + self.block)
        return out.select(*columns, "_tl_key", "_tl_block", (lo - at).alias("_tl_lo"), (hi - at).alias("_tl_hi"), (lo - start).alias("_tl_word"))

    def spans(self, *columns: str) -> DataFrame:
        """What the mix takes, shard by shard: columns, shard, number and turn of the slot, words first to last - 1 of
        the document."""
        # slots come out of a small table that grows in a function, so their size must not be guessed from it
        taken = self.pieces(*columns).where("_tl_block IS NOT NULL").join(self.slots.hint("merge"), ["_tl_key", "_tl_block"]).where("_tl_lo < words")
        return taken.select(*columns, "shard", "number", "turn", F.col("_tl_word").alias("first"), (F.col("_tl_word") + F.least("_tl_hi", "words") - F.col("_tl_lo")).alias("last"))

    def taken(self, *columns: str) -> DataFrame:
        """columns and taken (words the mix takes, repeats counted) of every document; slots join blocks by index."""
        whole = F.sum(F.when(F.col("words") >= self.block, 1).otherwise(0))
        uses = self.slots.groupBy("_tl_key", "_tl_block").agg(whole.alias("_tl_whole"), F.collect_list(F.when(F.col("words") < self.block, F.col("words"))).alias("_tl_cuts"))  # a cut a turn at most
        row = ["_tl_key", "_tl_bucket", "_tl_rn"]
        pieces = self.pieces(*columns, "_tl_bucket", "_tl_rn").join(uses.hint("merge"), ["_tl_key", "_tl_block"], "left")
        wide = F.col("_tl_hi") - F.col("_tl_lo")
        cut = F.aggregate("_tl_cuts", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(0), F.least(F.col("_tl_hi"), w) - F.col("_tl_lo")))
        return pieces.groupBy(*row, *columns).agg(F.sum(F.coalesce(F.col("_tl_whole") * wide + cut, F.lit(0))).alias("taken")).select(*columns, "taken")


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The words that a mix takes, as rows with the columns of docs (doc_id, text, source, n_chars and others).

    What a turn takes of a document in one run is one row: its words from first to last with the white space between
    them (what precedes the first and follows the last word of the document goes with these)."""
    columns = docs.columns
    keyed = docs.withColumn("_tl_row", F.xxhash64(F.lit(44), *columns))
    mix = Mix(keyed.select("_tl_row", "source", word_count("text").alias("size")), **options)
    spans = mix.spans("_tl_row", "size").groupBy("_tl_row").agg(F.collect_list(F.struct("turn", "first", "last")).alias("_tl_spans"), F.max("size").alias("_tl_size"))
    texts = in_batches(keyed).join(spans.hint("shuffle_hash"), "_tl_row").select("_tl_row", *columns, "_tl_size", "_tl_spans")
    # equal rows share their spans, and one of them carries them all; texts are sorted only where there are such rows
    twice = written(keyed.groupBy("_tl_row").agg(F.count("*").alias("n")).where("n > 1").select("_tl_row"), "equal_rows")
    if not twice.isEmpty():
        first = F.row_number().over(Window.partitionBy("_tl_row").orderBy("_tl_row"))
        once = texts.join(twice, "_tl_row", "left_semi").withColumn("_tl_copy", first).where("_tl_copy = 1").drop("_tl_copy")
        texts = texts.join(twice, "_tl_row", "left_anti").unionByName(once)
    texts = texts.drop("_tl_row")

    def cut(batches):
        import re

        import pyarrow as pa

        find = re.compile(WORD)
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            made = []
            for r in batch.to_pylist():
                runs, words = [], None
                for turn, first, last in sorted((x["turn"], x["first"], x["last"]) for x in r["_tl_spans"]):
                    if runs and runs[-1][0] == turn and runs[-1][2] == first:
                        runs[-1][2] = last
                    else:
                        runs.append([turn, first, last])
                for _, first, last in runs:
                    text = r["text"]
                    if (first, last) != (0, r["_tl_size"]):
                        words = words or [m.span() for m in find.finditer(text)]
                        text = text[0 if first == 0 else words[first][0] : len(text) if last == r["_tl_size"] else words[last - 1][1]]
                    made.append({c: r[c] for c in columns} | {"text": text} | ({"n_chars": len(text)} if "n_chars" in columns else {}))
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema([batch.schema.field(c) for c in columns]))

    return texts.mapInArrow(tidied(cut), docs.schema)
