"""Vectors: similarity, top-k search, cells, clusters, health, graph embeddings.

vectors: (vec_id long, embedding array<float>, ...). Products accumulate in doubles. Searches of a stated query set go
block by block over the vectors; nothing is paired with everything in one table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import values as N


def dot(a, b) -> Column:
    """Inner product, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v) -> Column:
    """A vector of unit length; zero vectors stay."""
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, F.col(v).cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / length))


BLOCK_VECTORS = 16_384
MATCH_BLOCK = 65_536  # vectors of either set that meet in one task
PRODUCT_ROWS, PRODUCT_COLUMNS = 1024, 8192  # of the products that are held at once


def block_count(vectors: DataFrame) -> int:
    """How many blocks vectors are cut into: one for each core, and no block of more than BLOCK_VECTORS."""
    return max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // BLOCK_VECTORS))


def query_scores(vectors: DataFrame, queries: DataFrame, blocks: int | None = None) -> DataFrame:
    """(query_id, vec_id, score) of every query against every vector but its own, by blocks of vectors and queries.

    The pairs are what was asked for: queries (query_id, q) are a stated set. Each query goes to every block of vectors
    once, by an equi join on the block; where the k best follow, each task keeps its k best of a query before the shuffle."""
    n = blocks or block_count(vectors)
    v = vectors.select("vec_id", "embedding").withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    q = queries.select("query_id", "q").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return v.join(q, "_b").where("vec_id <> query_id").select("query_id", "vec_id", dot("q", "embedding").alias("score"))


def top_k(scores: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query (of at least a score), ties to the smaller id."""
    if least is not None:
        scores = scores.where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    return top_k(query_scores(vectors, queries), k, least)


def block_matches(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y, and products of at least a score, of two blocks of vectors of one length.

    Products of single precision, with a bound on their error, leave the pairs that may reach the score; theirs are added
    in doubles from the first dimension on, as `dot` does."""
    length = [float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max(initial=0)) for m in (x, y)]
    kind = np.float32 if all(v < 1e15 for v in length) else np.float64  # nor where something is no number
    error = 2 * (x.shape[1] + 4) * float(np.finfo(kind).eps) * length[0] * length[1]
    left, right = x.astype(kind), np.ascontiguousarray(y.astype(kind).T)
    for lo in range(0, len(left), PRODUCT_ROWS):
        for at in range(0, right.shape[1], PRODUCT_COLUMNS):
            s = left[lo : lo + PRODUCT_ROWS] @ right[:, at : at + PRODUCT_COLUMNS]
            i, j = np.divmod(np.flatnonzero(~(s < least - error)), s.shape[1])
            for k in range(0, len(i), PRODUCT_COLUMNS):
                p, q = i[k : k + PRODUCT_COLUMNS] + lo, j[k : k + PRODUCT_COLUMNS] + at
                exact = np.cumsum(x[p].astype(float) * y[q].astype(float), axis=1)[:, -1] if x.shape[1] else np.zeros(len(p))
                keep = ~(exact < least)  # what is no number is the greatest, as in SQL
                yield p[keep], q[keep], exact[keep]


def _by_length(batches: list[pa.RecordBatch]) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Ids and matrix of the vectors, by their length."""
    parts: dict = {}
    for batch in batches:
        ids, vectors = batch.column("id"), batch.column("v")
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for n in np.unique(lengths).tolist():
            at = pa.array(np.flatnonzero(lengths == n))
            parts.setdefault(int(n), []).append((ids.take(at), vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(n))))
    return {n: (pa.concat_arrays([x for x, _ in p]), np.concatenate([v for _, v in p])) for n, p in parts.items()}


def cross_matches(a: DataFrame, b: DataFrame, least: float = 0.7) -> DataFrame:
    """(a_id, b_id, score) of at least a score between two sets of unit vectors (vec_id, embedding): a is the stated set.

    Both sets are cut into blocks of MATCH_BLOCK vectors at most, and each two blocks meet in one task as matrices: each
    vector moves once for each block of the other set, and the work is the product of the sets' sizes. Vectors that are null
    or hold null match nothing, nor do those of different lengths."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    a, b = (d.where(whole).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")) for d in (a, b))
    n, m = (max(1, -(-d.count() // MATCH_BLOCK)) for d in (a, b))
    m = max(m, -(-a.sparkSession.sparkContext.defaultParallelism // n))  # small sets: work for each core
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = a.withColumn("_i", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("_j", every(m)).withColumn("first", F.lit(True))
    right = b.withColumn("_j", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(m)).cast("int")).withColumn("_i", every(n)).withColumn("first", F.lit(False))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: [], False: []}
        for batch in batches:
            for side in held:
                held[side].append(batch.filter(pc.equal(batch.column("first"), side)))
        x, y = _by_length(held.pop(True)), _by_length(held.pop(False))
        for length in sorted(x.keys() & y.keys()):
            for i, j, s in block_matches(x[length][1], y[length][1], least):
                yield pa.RecordBatch.from_arrays([x[length][0].take(pa.array(i)), y[length][0].take(pa.array(j)), pa.array(s)], names=["a_id", "b_id", "score"])

    kind = a.schema["id"].dataType.simpleString()
    return left.unionByName(right).groupBy("_i", "_j").applyInArrow(matched, f"a_id {kind}, b_id {kind}, score double")


def cells(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """vectors with cell: the centroid of highest product, ties to the lower number; centroids are few by definition."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    scored = F.transform(table, lambda c, i: F.struct(F.aggregate(F.zip_with("embedding", c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x).alias("s"), (-i).alias("i")))
    return vectors.withColumn("cell", -F.array_max(scored)["i"])


def probe_search(vectors: DataFrame, queries: DataFrame, centroids: list[list[float]], k: int, probes: int = 10) -> DataFrame:
    """Approximate top-k: each query looks into its best `probes` cells, all where there are no more, joined by cell."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    scored = F.transform(table, lambda c, i: F.struct((-F.aggregate(F.zip_with("q", c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)).alias("s"), i.alias("i")))
    q = queries.withColumn("cell", F.explode(F.transform(F.slice(F.array_sort(scored), 1, probes), lambda x: x["i"])))
    pairs = cells(vectors, centroids).join(q, "cell").where("vec_id <> query_id")
    return top_k(pairs.select("query_id", "vec_id", dot("q", "embedding").alias("score")), k)


def kmeans(vectors: DataFrame, k: int, seed: int = 13, steps: int = 20) -> tuple[DataFrame, list]:
    """vectors with cluster, by cosine k-means, and the centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    held = vectors.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=steps, distanceMeasure="cosine", featuresCol="_v", predictionCol="cluster").fit(held)
    return model.transform(held).drop("_v"), [c.tolist() for c in model.clusterCenters()]


def cluster_count(n: int) -> int:
    """One cluster for a hundred vectors, 1 to 500."""
    return max(1, min(500, n // 100))


def mean_cosine(vectors: DataFrame) -> DataFrame:
    """n and the mean cosine of different vectors, from sums alone: (|sum u|^2 - n) / (n (n - 1)) for unit vectors u."""
    unit = vectors.select("vec_id", F.posexplode(normalised("embedding")).alias("i", "x"))
    sums = unit.groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("m"))
    own = vectors.agg(F.count("*").alias("n"), F.count_if(dot("embedding", "embedding") > 0).alias("u"))
    both = own.withColumn("m", sums.scalar())
    return both.select("n", N.rate(F.col("m") - F.col("u"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


def effective_dimensions(vectors: DataFrame, shares=(0.9, 0.95)) -> list[int]:
    """How many principal components hold each share of the variance; the covariance has the dimension's size alone."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    held = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    width = len(vectors.first()["embedding"])
    share = np.cumsum(PCA(k=width, inputCol="v", outputCol="p").fit(held).explainedVariance.toArray())
    return [int(np.searchsorted(share, s - 1e-12) + 1) for s in shares]


def label_agreement(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, agreement: share of the k nearest with the query's label. queries: (query_id, q, label)."""
    found = nearest(vectors, queries.select("query_id", "q"), k)
    labels = vectors.select("vec_id", F.col("label").alias("found_label"))
    j = found.join(labels, "vec_id").join(queries.select("query_id", "label"), "query_id")
    return j.groupBy("query_id").agg(F.avg((F.col("label") == F.col("found_label")).cast("double")).alias("agreement"))


def neighbour_tag_agreement(neighbours: DataFrame, tags: DataFrame) -> DataFrame:
    """query_id, mean_jaccard of the tags of a query and of its neighbours; tags: (vec_id, tags)."""
    a, b = tags.select(F.col("vec_id").alias("query_id"), F.col("tags").alias("_a")), tags.select("vec_id", F.col("tags").alias("_b"))
    return neighbours.join(a, "query_id").join(b, "vec_id").groupBy("query_id").agg(F.avg(N.jaccard("_a", "_b")).alias("mean_jaccard"))


def cross_domain(neighbours: DataFrame, tags: DataFrame, least: float = 0.7, most: float = 0.1) -> DataFrame:
    """Neighbours of high score that share hardly a tag."""
    a, b = tags.select(F.col("vec_id").alias("query_id"), F.col("tags").alias("_a")), tags.select("vec_id", F.col("tags").alias("_b"))
    j = neighbours.join(a, "query_id").join(b, "vec_id").withColumn("jaccard", N.jaccard("_a", "_b"))
    return j.where((F.col("score") > least) & (F.col("jaccard") < most)).select("query_id", "vec_id", "score", "jaccard")


def retrieval_metrics(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: acc_at_1, acc_at_5, mrr of the true partner's rank; scores (query_id, vec_id, score), truth (query_id, vec_id)."""
    partner = scores.join(truth, ["query_id", "vec_id"]).select("query_id", F.col("vec_id").alias("_v"), F.col("score").alias("_s"))
    better = (F.col("score") > F.col("_s")) | (F.col("score") == F.col("_s")) & (F.col("vec_id") < F.col("_v"))
    ranked = scores.join(partner, "query_id").groupBy("query_id", "_v").agg((F.count_if(better) + 1).alias("rank"))
    share = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranked.agg(share(1).alias("acc_at_1"), share(5).alias("acc_at_5"), F.avg(1 / F.col("rank")).alias("mrr"))


def validation_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 1337) -> DataFrame:
    """df with validation, a share by hash of the key."""
    return df.withColumn("validation", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000))


def hashed_text_vectors(texts: DataFrame, width: int = 64) -> DataFrame:
    """vec_id, embedding: signed hashed counts of words as unit vectors, an offline stand-in for a text model."""
    from threadloom.functions.text import tokens

    t = texts.select("vec_id", F.explode(tokens("text")).alias("w")).withColumn("h", F.xxhash64("w"))
    parts = t.groupBy("vec_id", F.pmod("h", F.lit(width)).cast("int").alias("i")).agg(F.sum(F.when(F.pmod(F.shiftright("h", 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    packed = parts.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    dense = packed.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))
    return dense.withColumn("embedding", normalised("embedding"))


def entry_text(title, keywords, defines, entry_id) -> Column:
    """What is embedded of an entry: title, ten keywords, five defined terms; its id, if there is none."""
    text = F.concat_ws(". ", F.nullif(F.col(title), F.lit("")), F.nullif(F.array_join(F.slice(keywords, 1, 10), ", "), F.lit("")), F.nullif(F.array_join(F.slice(defines, 1, 5), ", "), F.lit("")))
    return F.when(text == "", F.col(entry_id)).otherwise(text)


# graphs as (graph_id, node, type_idx, bucket) and (graph_id, relation, src, dst)


def graph_features(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Node features (type number, md5 bucket of the subtype) and edges: a single end as a loop, two ends both ways."""
    kinds = F.array(*map(F.lit, types))
    feats = nodes.select("graph_id", F.col("id").alias("node"), (F.array_position(kinds, F.col("type")) - 1).cast("int").alias("type_idx"), N.subtype_bucket("subtype").alias("bucket"))
    both = F.when(F.size("ends") == 1, F.array(F.struct(F.get("ends", 0).alias("src"), F.get("ends", 0).alias("dst")))).otherwise(
        F.array(F.struct(F.get("ends", 0).alias("src"), F.get("ends", 1).alias("dst")), F.struct(F.get("ends", 1).alias("src"), F.get("ends", 0).alias("dst")))
    )
    return feats, edges.select("graph_id", F.col("type").alias("relation"), F.explode(both).alias("e")).select("graph_id", "relation", "e.src", "e.dst")


def augmented(nodes: DataFrame, edges: DataFrame, node_drop: float = 0.1, edge_drop: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Graphs without a share of nodes (two stay at least) and of edges, by hash of seed and names."""
    chance = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_000)) / 1e6
    order = Window.partitionBy("graph_id").orderBy(F.desc(chance("graph_id", "node")), "node")
    kept = nodes.withColumn("_r", F.row_number().over(order)).where((chance("graph_id", "node") >= node_drop) | (F.col("_r") <= 2)).drop("_r")
    names = kept.select("graph_id", "node")
    e = edges.where(chance("graph_id", "relation", "src", "dst") >= edge_drop)
    for end in ("src", "dst"):
        e = e.join(names.withColumnRenamed("node", end), ["graph_id", end], "left_semi")
    return kept, e


def collated(nodes: DataFrame, edges: DataFrame, graphs_per_batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with batch, and their places in it: graphs of a batch follow one another, so a node's index is its
    place in its graph behind all graphs before. graph_id and node stay the keys; indices are for dense libraries alone."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.ceil(F.count("*") / graphs_per_batch)).scalar()
    sizes = sizes.withColumn("batch", F.pmod(F.xxhash64("graph_id"), F.greatest(total, F.lit(1))))
    before = Window.partitionBy("batch").orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("graph_id").orderBy("node")
    placed = nodes.join(sizes, "graph_id").withColumn("index", F.col("_before") + F.row_number().over(inside) - 1).drop("_before")
    at = lambda end: placed.select("graph_id", F.col("node").alias(end), F.col("index").alias(f"{end}_index"))
    return placed, edges.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"])


def message_pass(states: DataFrame, edges: DataFrame, weights: dict[str, list[list[float]]], own: list[list[float]], bias: list[float]) -> DataFrame:
    """One relational layer: relu(sum over in-edges of W_relation h / in-degree + W_own h + bias).

    states: (graph_id, node, h array<double>). Products with the small weight matrices stay in the row; messages meet
    by a join on the source and a sum by the target."""
    def times(matrix, h):
        return F.array(*[F.aggregate(F.zip_with(h, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in matrix])

    sent = edges.join(states.withColumnRenamed("node", "src"), ["graph_id", "src"])
    message = None
    for relation, matrix in weights.items():
        made = F.when(F.col("relation") == relation, times(matrix, F.col("h")))
        message = made if message is None else F.coalesce(message, made)
    parts = sent.select("graph_id", F.col("dst").alias("node"), F.posexplode(message).alias("i", "x"))
    degree = edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count("*").alias("degree"))
    sums = parts.groupBy("graph_id", "node", "i").agg(F.sum("x").alias("x")).groupBy("graph_id", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    out = states.join(sums, ["graph_id", "node"], "left").join(degree, ["graph_id", "node"], "left")
    zero = F.array(*[F.lit(0.0) for _ in bias])
    mean = F.transform(F.coalesce("m", zero), lambda x: x / F.coalesce("degree", F.lit(1)))
    total = F.zip_with(F.zip_with(mean, times(own, F.col("h")), lambda a, b: a + b), F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: F.greatest(F.lit(0.0), a + b))
    return out.select("graph_id", "node", total.alias("h"))


def encoded(states: DataFrame, edges: DataFrame, layers: list[tuple[dict, list, list]], projection: list[list[float]] | None = None) -> DataFrame:
    """graph_id, embedding of graphs: relational layers (weights by relation, own weights, bias) one after the other, the
    mean of the states, put through a projection if there is one, as a unit vector. Layers are few; each is written, so
    the plan doesn't grow with them."""
    from threadloom.plans.tables import written

    for weights, own, bias in layers:
        states = written(message_pass(states, edges, weights, own, bias), "layer")
    out = pooled(states)
    if projection is not None:
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in projection])
        put = F.transform(rows, lambda row: F.aggregate(F.zip_with("embedding", row, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        out = out.withColumn("embedding", put).withColumn("embedding", normalised("embedding"))
    return out


def pooled(states: DataFrame) -> DataFrame:
    """graph_id, embedding: the mean of a graph's states as a unit vector."""
    m = states.select("graph_id", F.posexplode("h").alias("i", "x")).groupBy("graph_id", "i").agg(F.avg("x").alias("x"))
    m = m.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    return m.withColumn("embedding", normalised("embedding"))


def contrastive_loss(a: np.ndarray, b: np.ndarray, temperature: float = 0.1) -> float:
    """NT-Xent over paired rows of two views."""
    z = np.concatenate([a, b])
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    top = s.max(axis=1, keepdims=True)
    log = (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)))[:, 0]
    n = len(a)
    pair = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    return float(np.mean(log - s[np.arange(2 * n), pair]))


def contrastive_loss_sparse(df: DataFrame, group: str, temperature: float = 0.1) -> DataFrame:
    """group, loss: as `contrastive_loss_by`, of views that are maps from dimension to value, with few views to a dimension.

    Only views that share a dimension meet; all others are at right angles, and counted. So no batch lies in one task, and
    what is held grows with the meetings, not with the square of a batch. Every exponent is taken less by 1 / temperature,
    the greatest there is."""
    if temperature < 0.003:
        raise ValueError("below 0.003 exponents leave the range of doubles")
    rows = df.select(group, "a", "b", F.monotonically_increasing_id().alias("_row"))
    length = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    views = rows.select(group, F.explode(F.array(*(F.struct((2 * F.col("_row") + i).alias("v"), F.col(c).alias("m"), length(c).alias("l")) for i, c in enumerate("ab")))).alias("x"))
    entries = views.where("x.l > 0").select(group, "x.v", "x.l", F.explode("x.m").alias("dim", "x"))
    held = entries.groupBy(group, "dim").agg(F.collect_list(F.struct("v", (F.col("x") / F.col("l")).alias("x"))).alias("held"))
    pairs = held.select(group, "held", F.explode("held").alias("i")).select(group, "i", F.explode("held").alias("j")).where("i.v <> j.v")
    scores = pairs.groupBy(group, F.col("i.v").alias("v"), F.col("j.v").alias("w")).agg(F.sum(F.col("i.x") * F.col("j.x")).alias("s"))
    away = math.exp(-1 / temperature)
    sums = scores.groupBy(group, "v").agg(F.sum(F.exp((F.col("s") - 1) / temperature) - away).alias("z"), F.coalesce(F.sum(F.when(F.col("w") == F.col("v").bitwiseXOR(F.lit(1)), F.col("s"))), F.lit(0.0)).alias("own"))
    sizes = df.groupBy(F.col(group).alias("_group")).agg((2 * F.count("*")).alias("n"))
    met = sizes.join(sums, F.col("_group").eqNullSafe(F.col(group)), "left")
    loss = F.when(F.col("z").isNotNull(), F.log(F.col("z") + (F.col("n") - 1) * away) + (1 - F.col("own")) / temperature)
    total = met.groupBy("_group", "n").agg(F.sum(loss).alias("t"), F.count("z").alias("k"))
    # a view of zeros is at right angles to all
    return total.select(F.col("_group").alias(group), ((F.coalesce("t", F.lit(0.0)) + (F.col("n") - F.col("k")) * F.log(F.col("n") - 1)) / F.col("n")).alias("loss"))


def contrastive_loss_by(df: DataFrame, group: str, temperature: float = 0.1) -> DataFrame:
    """group, loss: the loss of each batch of paired views (a, b arrays), one batch a group, which one task holds with the
    square of its size; large sparse batches have `contrastive_loss_sparse`."""
    kind = df.schema[group].dataType.simpleString()

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{group: pdf[group].iloc[0], "loss": contrastive_loss(np.stack(pdf["a"]), np.stack(pdf["b"]), temperature)}])

    return df.groupBy(group).applyInPandas(loss, f"{group} {kind}, loss double")
