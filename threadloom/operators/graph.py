"""Graphs as vertex and edge tables: link and co-occurrence graphs, paths, neighbourhoods, flow topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import values as N


GRAIN = 1000  # terms of an entity that are paired with all its others in one place


def link_graph(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between known pages, by lower-cased name, without loops.

    pages: (name); links: (source, target)."""
    names = pages.select(F.lower("name").alias("n")).distinct()
    e = links.select(F.lower("source").alias("src"), F.lower("target").alias("dst")).where("src <> dst").distinct()
    return e.join(names.select(F.col("n").alias("src")), "src", "left_semi").join(names.select(F.col("n").alias("dst")), "dst", "left_semi").select("src", "dst")


def shared_terms(pages: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """edges with n_shared and the first shared terms of their ends; pages: (name, terms)."""
    a, b = pages.select(F.col("name").alias("src"), F.col("terms").alias("_a")), pages.select(F.col("name").alias("dst"), F.col("terms").alias("_b"))
    both = F.array_sort(F.array_intersect("_a", "_b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.size(both).alias("n_shared"), F.slice(both, 1, most).alias("shared"))


def cooccurrence(mentions: DataFrame, least: int = 3, most_terms: int | None = 30) -> DataFrame:
    """(src, dst, n) of terms that share at least `least` entities, in both directions.

    mentions: (entity, term); those without entity take no part. most_terms: of an entity's terms only the first by name take part, as the definition has
    it; None takes all."""
    m = mentions.select("entity", "term").distinct()
    if most_terms:
        order = Window.partitionBy("entity").orderBy("term")
        m = m.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most_terms).drop("_r")
    # an entity's terms meet in grains of GRAIN, so that no entity's pairs lie in one task or one row
    sizes = m.groupBy("entity").agg(F.ceil(F.count("*") / GRAIN).cast("int").alias("grains"))
    m = m.join(sizes, "entity")
    left = m.select("entity", F.pmod(F.xxhash64("term"), F.col("grains")).cast("int").alias("grain"), F.col("term").alias("src"))
    right = m.select("entity", F.explode(F.sequence(F.lit(0), F.col("grains") - 1)).alias("grain"), F.col("term").alias("dst"))
    pairs = left.join(right, ["entity", "grain"]).where("src < dst").select(F.struct("src", "dst").alias("p"))
    counts = pairs.groupBy("p.src", "p.dst").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.select(F.explode(F.array(F.struct("src", "dst", "n"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))).alias("e")).select("e.*")


def term_profiles(mentions: DataFrame, tags: DataFrame, least: int = 5, share: float = 0.25, top: int = 5) -> DataFrame:
    """term, df, tags (the most frequent): terms of at least `least` entities but at most a share of all."""
    total = mentions.agg(F.countDistinct("entity")).scalar()
    df = mentions.groupBy("term").agg(F.countDistinct("entity").alias("df"))
    kept = df.where((F.col("df") >= least) & (F.col("df") <= share * total))
    counts = mentions.join(tags, "entity").groupBy("term", "tag").agg(F.countDistinct("entity").alias("n"))
    order = Window.partitionBy("term").orderBy(F.desc("n"), "tag")
    best = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    best = best.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "tag"))), lambda x: x["tag"]).alias("tags"))
    return kept.select("term", "df").join(best, "term", "left")


def shared_instances(instances: DataFrame) -> DataFrame:
    """Distinct (a, b) of patterns that share an instance, each with itself; instances: (pattern, instance).

    Patterns are a bank, so an instance's set of them is small, and equal sets count once."""
    sets = instances.groupBy("instance").agg(F.array_sort(F.collect_set("pattern")).alias("s")).select("s").distinct()
    return sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).distinct()


def bridges(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """entry_id, object, match_type: entries whose title, else whose first defined term, is an object's name.

    entries: (id, title, defines); objects: (name)."""
    o = objects.select(F.lower("name").alias("key"), F.col("name").alias("object")).dropDuplicates(["key"])
    t = entries.select("id", F.lower("title").alias("key"), F.lit(0).alias("rank"))
    d = entries.select("id", F.posexplode("defines")).select("id", F.lower("col").alias("key"), (F.col("pos") + 1).alias("rank"))
    hits = t.union(d).join(o, "key")
    best = hits.groupBy("id").agg(F.min(F.struct("rank", "object")).alias("b"))
    return best.select(F.col("id").alias("entry_id"), "b.object", F.when(F.col("b.rank") == 0, "title").otherwise("defines").alias("match_type"))


def bridge_neighbours(edges: DataFrame, term: str, other: DataFrame) -> DataFrame:
    """Names among a term and its neighbours that another dictionary (name) knows."""
    near = edges.where(F.col("src") == term).select(F.col("dst").alias("name"))
    return near.union(edges.sparkSession.createDataFrame([(term,)], "name string")).distinct().join(other.select("name").distinct(), "name", "left_semi")


def question_bridges(mentions: DataFrame) -> DataFrame:
    """(thread_id, term) of terms that the question and an answer mention; mentions: (thread_id, kind, term)."""
    g = mentions.groupBy("thread_id", "term").agg(F.max((F.col("kind") == "question").cast("int")).alias("q"), F.max((F.col("kind") == "answer").cast("int")).alias("a"))
    return g.where("q = 1 AND a = 1").select("thread_id", "term")


def lookup(names: DataFrame, term: str, most: int = 15) -> DataFrame:
    """The name itself (case aside), else the first names that hold it: a report of at most so many."""
    low = term.lower()
    exact = names.where(F.lower("name") == low)
    part = names.where(F.lower("name").contains(low) & (F.lower("name") != low))
    both = exact.select("name", F.lit(0).alias("_r")).union(part.select("name", F.lit(1).alias("_r")))
    return both.orderBy("_r", "name").limit(most).select("name")


def layers(edges: DataFrame, source: str, depth: int) -> DataFrame:
    """(node, distance) of what a source reaches within so many steps: each step joins the last layer's edges and drops
    what is known; layers are written, so the plan doesn't grow with the depth."""
    from threadloom.plans.tables import written

    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(source, 0)], "node string, distance int")
    layer = seen
    for d in range(1, depth + 1):
        reached = layer.join(e, layer["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        layer = written(reached.withColumn("distance", F.lit(d)), "layer")
        if layer.isEmpty():
            break
        seen = seen.union(layer)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 6) -> DataFrame:
    """(step, node) of a shortest directed path, none if the target is further than depth; of equal paths that whose
    nodes are least, from the target back. Parents are kept layer by layer."""
    from threadloom.plans.tables import written

    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(source, 0, None)], "node string, distance int, parent string")
    layer, found = seen, source == target
    for d in range(1, depth + 1):
        if found:
            break
        step = layer.select(F.col("node").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        layer = written(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("distance"), "parent"), "layer")
        seen = seen.union(layer)
        found = not layer.where(F.col("node") == target).isEmpty()
        if not found and layer.isEmpty():
            break
    path, node = [], target if found else None
    while node is not None:  # at most depth + 1 look-ups of one row
        row = seen.where(F.col("node") == node).first()
        path.append((row["distance"], node))
        node = row["parent"]
    return spark.createDataFrame(path, "step int, node string").orderBy("step")


def flow_topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, role: root (no edge in), sink (none out), orphan (neither) or inner."""
    ins, outs = edges.select(F.col("dst").alias("node")).distinct().withColumn("i", F.lit(1)), edges.select(F.col("src").alias("node")).distinct().withColumn("o", F.lit(1))
    j = nodes.join(ins, "node", "left").join(outs, "node", "left")
    role = F.when(F.col("i").isNull() & F.col("o").isNull(), "orphan").when(F.col("i").isNull(), "root").when(F.col("o").isNull(), "sink").otherwise("inner")
    return j.select("node", role.alias("role"))


def reach(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Distinct nodes that any root reaches, in any number of steps unless a depth is given: written layers, until one is
    empty. What is known is written anew every 20 layers, so the plan doesn't grow with the depth."""
    from threadloom.plans.tables import written

    e = written(edges.select("src", "dst").distinct(), "edges")
    layer = seen = written(roots.select("node").distinct(), "reached")
    d = 0
    while depth is None or d < depth:
        d += 1
        step = layer.join(e, layer["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        layer = written(step.join(seen, "node", "left_anti"), "layer")
        if layer.isEmpty():
            break
        seen = seen.union(layer)
        if d % 20 == 0:
            seen = written(seen, "reached")
    return seen.distinct()


def role_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of roots, sinks and orphans."""
    n = lambda r: F.count_if(F.col("role") == r)
    return flow_topology(nodes, edges).agg(n("root").alias("roots"), n("sink").alias("sinks"), n("orphan").alias("orphans"))


def well_formed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of roots, sinks, orphans and of stuck roots, which reach no sink, and well_formed: there is a node
    without an edge in and one without an edge out, at most half of the nodes (rounded down) are orphans, and at most half
    of the nodes without an edge in (rounded down) are stuck.

    A root reaches a sink if the sinks reach it against the edges, so one search answers for every root. An orphan is its
    own sink, so it isn't stuck."""
    t = flow_topology(nodes, edges)
    back = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), t.where("role = 'sink'"))
    t = t.join(back.withColumn("_reaches", F.lit(True)), "node", "left")
    n = lambda r: F.count_if(F.col("role") == r)
    counts = t.agg(n("root").alias("roots"), n("sink").alias("sinks"), n("orphan").alias("orphans"), F.count_if((F.col("role") == "root") & F.col("_reaches").isNull()).alias("stuck"), F.count("*").alias("_n"))
    first, last = F.col("roots") + F.col("orphans"), F.col("sinks") + F.col("orphans")
    rules = (first > 0) & (last > 0) & (F.col("orphans") <= F.floor(F.col("_n") / 2)) & (F.col("stuck") <= F.floor(first / 2))
    return counts.withColumn("well_formed", rules).drop("_n")


def merged_counts(counts: list[DataFrame], key: str, value: str = "n") -> DataFrame:
    """Counts of shards added up by key."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy(key).agg(F.sum(value).alias(value))


def edge_type_counts(edges: DataFrame, group: list[str]) -> DataFrame:
    return N.frequency_map(edges, group, "edge_type", "edge_types")
