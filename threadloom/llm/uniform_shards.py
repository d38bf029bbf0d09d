"""Uniform shuffle into shards of exact sizes, by a drawn partition-to-shard matrix; DataFrame operations only.

Rows fall by hash into partitions that a task can hold. How many rows each partition sends to each shard is drawn from
the multivariate hypergeometric law, top-down: the counts of all shards are dealt to runs of FAN partitions each, those
of a run to its parts, until single partitions are left. Each draw takes a shard's part of what is left to deal, by the
inverse of the hypergeometric distribution from its mode outwards, so that rows and columns of the matrix have their
exact sums: partitions give all they have, shards' counts are at most one apart. Only partitions and counts take part,
a row each. Each partition then permutes its rows, sends runs of them to the shards as the matrix says, and each shard
permutes what it gets, in sub-buckets by hash. All of this moves row hashes only; rows meet their places at the end.

Draws depend on the rows' contents and the seed alone, not on how files are split or which executor works, so a
recomputed partition agrees with what others have read. Rows equal in all columns are told apart by numbers, given to
each task's share of them in turn, so that even a third of all rows may be equal without meeting in one task. Nulls hash
as such, empty and very long texts are hashed like others and move once; there are no ties, for equal hashes are ordered
by number; other columns are carried along, those named shard or slot are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import offsets, written

ROWS = 2048  # in a partition, and in a sub-bucket of a shard
FAN = 16  # parts of a run of partitions, for each of which a vector of counts is drawn


def _walk(steps: Column, ratio, target: Column) -> tuple[Column, Column]:
    """From the mode (weight 1) outwards, step 1, 2, ...: the sum of weights, and how many steps until it passes target."""
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, i: Column) -> Column:
        w = s["w"] * ratio(i)
        return F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), (s["at"] + F.when(s["sum"] < target, 1).otherwise(0)).alias("at"))

    end = F.aggregate(steps, begin, step)
    return end["sum"], end["at"]


def _up_to(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """How many of `draws` taken without replacement from `total` are among the `good`; u is uniform in [0, 1).

    Weights are taken from the mode outwards, as far as ten standard deviations and ten more: beyond, no double tells
    the sum from 1. All arguments are used more than once and should be plain columns or fields."""
    g, n, k = (c.cast("double") for c in (good, total, draws))
    lowest = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    highest = F.least(draws, good)
    mode = F.least(F.greatest(F.floor((k + 1) * (g + 1) / (n + 2)), lowest), highest)
    share = g / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), k * share * (1 - share) * (n - k) / F.greatest(n - 1, F.lit(1.0))))
    wide = F.ceil(spread * 10) + 10
    held = F.transform(F.array(F.struct(mode.alias("m"), F.least(wide, highest - mode).alias("up"), F.least(wide, mode - lowest).alias("down"))), lambda x: _drawn(u, g, n, k, x))
    return held[0]


def _drawn(u: Column, g: Column, n: Column, k: Column, x: Column) -> Column:
    m = x["m"].cast("double")

    def rise(i: Column) -> Column:  # weight of m + i over that of m + i - 1
        at = m + i - 1
        return (g - at) * (k - at) / ((at + 1) * (n - g - k + at + 1))

    def fall(i: Column) -> Column:
        at = m - i + 1
        return at * (n - g - k + at) / ((g - at + 1) * (k - at + 1))

    def chosen(s: Column) -> Column:
        target = u * (1 + s["above"] + s["below"])
        over = target - 1
        up = x["m"] + F.least(F.greatest(_walk(_up_to(x["up"]), rise, over)[1], F.lit(1).cast("long")), x["up"])
        down = x["m"] - F.least(F.greatest(_walk(_up_to(x["down"]), fall, over - s["above"])[1], F.lit(1).cast("long")), x["down"])
        return F.when((over < 0) | (s["above"] + s["below"] == 0), x["m"]).when((over < s["above"]) | (x["down"] < 1), F.when(x["up"] >= 1, up).otherwise(x["m"])).otherwise(down)

    sums = F.struct(_walk(_up_to(x["up"]), rise, F.lit(0.0))[0].alias("above"), _walk(_up_to(x["down"]), fall, F.lit(0.0))[0].alias("below"))
    return F.transform(F.array(sums), chosen)[0].cast("long")


def dealt(node: Column, size: Column, left: Column, seed: int) -> Column:
    """A vector of counts with sum `size`, drawn without replacement from the vector `left`: shard by shard."""
    zero = F.lit(0).cast("long")
    begin = F.struct(F.aggregate(left, zero, lambda a, c: a + c).alias("rest"), size.cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def shard(s: Column, x: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, F.size(s["out"])), 11) / F.lit(float(2**53))
        took = F.transform(F.array(F.struct(u.alias("u"))), lambda z: hypergeometric(z["u"], x, s["rest"], s["draws"]))
        return F.transform(took, lambda t: F.struct((s["rest"] - x).alias("rest"), (s["draws"] - t).alias("draws"), F.concat(s["out"], F.array(t)).alias("out")))[0]

    return F.aggregate(left, begin, shard, lambda s: s["out"])


def _given(level: int, seed: int):
    """One step of a run of partitions: a child draws its counts from what its older siblings have left."""

    def give(s: Column, c: Column) -> Column:
        drawn = F.array(F.struct(dealt(c["child"] * 64 + level, c["n"], s["left"], seed).alias("g")))

        def after(x: Column) -> Column:
            child = F.struct(c["child"].alias("node"), x["g"].alias("counts"))
            return F.struct(F.zip_with(s["left"], x["g"], lambda a, b: a - b).alias("left"), F.concat(s["out"], F.array(child)).alias("out"))

        return F.transform(drawn, after)[0]

    return give


def communication_matrix(partitions: DataFrame, total: int, shards: int, seed: int, fan: int = FAN) -> DataFrame:
    """(part, counts): how many rows each partition sends to each shard, in turn; partitions: (part, n), numbered from 0."""
    spark = partitions.sparkSession
    whole = [total // shards + (i < total % shards) for i in range(shards)]
    most = partitions.agg(F.max("part")).first()[0] or 0
    levels = 1
    while fan**levels <= most:
        levels += 1
    nodes = spark.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(c).cast("long") for c in whole]).alias("counts"))
    for level in range(levels - 1, -1, -1):
        child = F.floor(F.col("part") / fan**level).cast("long").alias("child")
        sizes = partitions.groupBy(child).agg(F.sum("n").cast("long").alias("n"))
        sizes = sizes.groupBy(F.floor(F.col("child") / fan).cast("long").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"))  # at most fan
        begin = F.struct(F.col("counts").alias("left"), F.array().cast("array<struct<node:bigint,counts:array<bigint>>>").alias("out"))

        held = nodes.hint("merge").join(sizes, nodes["node"] == sizes["parent"])
        given = F.aggregate("children", begin, _given(level, seed), lambda s: s["out"])
        nodes = held.select(F.explode(given).alias("x")).select("x.node", "x.counts")
        nodes = written(nodes, "matrix")
    return nodes.withColumnRenamed("node", "part")


def _numbered(df: DataFrame, hashed: Column, twice: DataFrame) -> DataFrame:
    """df with _tl_hash and _tl_turn, a number from 0 among rows of one hash: hashes in `twice` are numbered task by task."""
    df = df.withColumn("_tl_hash", hashed)
    if twice.isEmpty():
        return df.withColumn("_tl_turn", F.lit(0).cast("long"))
    named = twice.select(F.col("h").alias("_tl_same"))
    single = df.join(named, F.col("_tl_hash") == F.col("_tl_same"), "left_anti").withColumn("_tl_turn", F.lit(0).cast("long"))
    # a task's share of equal rows, written so that every reader sees the same shares
    equal = df.join(named, F.col("_tl_hash") == F.col("_tl_same"), "left_semi").withColumn("_tl_task", F.spark_partition_id().cast("long") * 4096 + F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    equal = written(equal, "equal_rows")
    starts = offsets(equal.groupBy("_tl_hash", "_tl_task").agg(F.count("*").alias("n")), "_tl_task", "n", ["_tl_hash"])
    starts = starts.select(F.col("_tl_hash").alias("_tl_same"), F.col("_tl_task").alias("_tl_of"), "before")
    inside = F.row_number().over(Window.partitionBy("_tl_hash", "_tl_task").orderBy("_tl_hash"))
    equal = equal.withColumn("_tl_turn", inside.cast("long")).join(starts, (F.col("_tl_hash") == F.col("_tl_same")) & (F.col("_tl_task") == F.col("_tl_of")))
    equal = equal.withColumn("_tl_turn", F.col("before") + F.col("_tl_turn") - 1)
    return single.unionByName(equal.select(*single.columns))


def uniform_shards(df: DataFrame, shards: int = 40, seed: int = 8, rows: int = ROWS) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard), a uniform shuffle of its rows.

    The draw, both permutations and the exchange between them run on row hashes alone; the rows themselves, texts and
    all, move once, to meet their places. A writer that wants a file per shard range-partitions by shard and slot.
    """
    df = df.drop("shard", "slot")  # columns of these names are replaced
    columns = df.columns
    hashed = F.xxhash64(F.lit(seed), *columns)
    counted = written(df.select(hashed.alias("h")).groupBy("h").agg(F.count("*").alias("c")), "row_hashes")
    total = counted.agg(F.sum("c")).first()[0] or 0
    parts, subs = max(1, -(-total // rows)), max(1, -(-total // (rows * shards)))
    slim = counted.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("i"))
    held = slim.withColumn("part", F.pmod(F.xxhash64("h", "i"), F.lit(parts)))
    matrix = communication_matrix(held.groupBy("part").agg(F.count("*").alias("n")), total, shards, seed + 1)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("counts", F.lit(1), j), F.lit(0).cast("long"), lambda a, c: a + c))
    runs = matrix.select("part", ends.alias("ends")).hint("merge")
    # permute locally, and cut into runs
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 2), "h", "i"), "h", "i")
    sent = held.withColumn("rank", F.row_number().over(local)).join(runs, "part")
    sent = sent.select("h", "i", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"))
    sent = sent.withColumn("sub", F.pmod(F.xxhash64(F.lit(seed + 3), "h", "i"), F.lit(subs)))
    # exchange, and permute again
    starts = offsets(sent.groupBy("shard", "sub").agg(F.count("*").alias("n")), "sub", "n", ["shard"])
    again = Window.partitionBy("shard", "sub").orderBy(F.xxhash64(F.lit(seed + 4), "h", "i"), "h", "i")
    placed = sent.withColumn("at", F.row_number().over(again)).join(starts.select("shard", "sub", "before").hint("merge"), ["shard", "sub"])
    places = placed.select(F.col("h").alias("_tl_h"), F.col("i").alias("_tl_i"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
    found = _numbered(df, hashed, counted.where("c > 1"))
    return found.join(places.hint("merge"), (F.col("_tl_hash") == F.col("_tl_h")) & (F.col("_tl_turn") == F.col("_tl_i"))).select(*columns, "shard", "slot")
