"""Analysis of encyclopaedia entries and proofs: what is defined, of what, and with which marks.

entries: (entity_id, title, name, defines, related, body), a row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import fixed_values as V
from threadloom.functions import spans as S


def conclusions(text: str):
    """(type, match, position) of the places where an entry concludes."""
    for kind, pattern in V.CONCLUSIONS:
        for m in S._compiled(pattern, 0).finditer(text):
            yield kind, m.group()[:100], m.start()


def defined_concept(entries: DataFrame) -> DataFrame:
    """entity_id, term, source, arity: the first defined term, else the title, else the canonical name; arity counts what
    is let at the top."""
    first = F.get("defines", 0)
    title, name = F.nullif("title", F.lit("")), F.nullif("name", F.lit(""))
    source = F.when(first.isNotNull(), "pmdefines").when(title.isNotNull(), "pmtitle").when(name.isNotNull(), "pmcanonicalname")
    return entries.select("entity_id", F.coalesce(first, title, name).alias("term"), source.alias("source"), F.coalesce(F.regexp_count("body", F.lit(V.LET_BINDING)), F.lit(0)).alias("arity"))


def conclude_positions(entries: DataFrame) -> DataFrame:
    return S.span_rows(entries, "body", conclusions, S.MATCH, ["entity_id"])


def domain_terms(entries: DataFrame, most: int = 10) -> DataFrame:
    """entity_id, term, n, rank: what the formulas of an entry are about, made plain; the `most` most frequent, ties to
    the one that comes first."""
    inside = entries.select("entity_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"\$([^$]+)\$"), 1)).alias("pos", "t"))
    plain = F.col("t")
    for pattern, by in V.DOMAIN_REWRITES:
        plain = F.regexp_replace(plain, pattern, by)
    t = inside.select("entity_id", "pos", F.regexp_replace(plain, r"^\s+|\s+$", "").alias("term"))
    t = t.where(F.length("term").between(2, 40) & ~F.lower("term").isin(V.DOMAIN_NOISE) & F.col("term").rlike("[a-zA-Z]"))
    counts = t.groupBy("entity_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    order = Window.partitionBy("entity_id").orderBy(F.desc("n"), "pos")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("entity_id", "term", "n", "rank")


def coherence(entries: DataFrame, most: int = 5, listed: int = 3) -> DataFrame:
    """entity_id, term, n, in_related, matches: whether an entry's central terms appear in what it is related to; entries
    without relations have none. matches: the first `listed`, lower-cased."""
    related = F.array_distinct(F.transform("related", lambda r: F.lower(r)))
    held = domain_terms(entries, most).join(entries.where(F.size("related") > 0).select("entity_id", related.alias("related")), "entity_id")
    found = F.filter("related", lambda r: F.contains(r, F.lower(F.trim("term"))))
    return held.select("entity_id", "term", "n", (F.size(found) > 0).alias("in_related"), F.slice(F.array_sort(found), 1, listed).alias("matches"))


def proof_marks(text: str):
    """(type, match, position): connectives, anaphora, labels, the marks of proofs and the first colon, by place."""
    rows = [*S.matches([*V.WIRES, *V.PORTS, *V.LABELS, *V.PROOF_MARKS])(text)]
    if ":" in text:
        rows.append(("wire/clarifying", ":", text.index(":")))
    return sorted(rows, key=lambda r: r[2])


def proof_discourse(nodes: DataFrame) -> DataFrame:
    """node_id, hx_type, match, position of the scopes and marks of proof nodes (node_id, text)."""
    scopes = S.span_rows(nodes, "text", S.scopes(), S.SCOPE, ["node_id"]).select("node_id", F.col("type").alias("hx_type"), "match", "position")
    marks = S.span_rows(nodes, "text", proof_marks, S.MATCH, ["node_id"]).select("node_id", F.col("type").alias("hx_type"), "match", "position")
    return scopes.union(marks)


def relevant_patterns(questions: DataFrame, links: DataFrame, top: int = 3) -> DataFrame:
    """id, pattern, score, rank: the patterns whose links a question holds, 2 for a required and 1 for a typical one; the
    `top` of each question, ties by name. questions: (id, text); links: (pattern, term, kind)."""
    from threadloom.operators.lexicon import substring_join

    low = questions.select("id", F.lower("text").alias("low"))
    hits = substring_join(low, links.select("pattern", "term", "kind").distinct())
    scored = hits.groupBy("id", "pattern").agg(F.sum(F.when(F.col("kind") == "required", 2).otherwise(1)).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "pattern")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def payloads(entities: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """entities with a stage's list under `key`: missing entities and lists are empty, the last record of an entity counts.

    entities: (entity_id, ...); stage: (entity_id, seq, key array)."""
    last = stage.where("entity_id IS NOT NULL AND entity_id <> ''").groupBy("entity_id").agg(F.max_by(F.struct(key), "seq").alias("_p"))
    empty = F.array().cast(stage.schema[key].dataType)
    return entities.join(last, "entity_id", "left").withColumn(key, F.coalesce(F.col(f"_p.{key}"), empty)).drop("_p")


def wired_threads(threads: DataFrame, wirings: DataFrame) -> DataFrame:
    """Threads with their wiring: thread ids are numbers on one side and numbers behind a `t` on the other; threads without
    wiring go, of repeated wirings one counts. threads: (thread_id long, ...); wirings: (thread_id string, ...)."""
    number = F.regexp_extract("thread_id", r"^t?(\d+)$", 1).try_cast("long")
    w = wirings.withColumn("thread_id", number).where("thread_id IS NOT NULL").dropDuplicates(["thread_id"])
    return threads.join(w, "thread_id")


def wiring_totals(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: threads, nodes, edges, diagrams, port matches, categorical marks, classical edges (neither assert nor
    clarify), their rate, and how many acts there are.

    graphs: (thread_id, n_nodes, n_edges, n_categorical, n_diagrams, n_port_matches); edges: (thread_id, act)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    plain = edges.agg(F.count_if(F.col("act").isin("assert", "clarify"))).scalar()
    acts = edges.agg(F.countDistinct("act")).scalar()
    sums = graphs.agg(F.count("*").alias("threads"), *[total(c) for c in ("n_nodes", "n_edges", "n_categorical", "n_diagrams", "n_port_matches")])
    out = sums.withColumn("structural", plain).withColumn("unique_acts", acts).withColumn("classical", F.col("n_edges") - F.col("structural"))
    return out.withColumn("classical_rate", F.when(F.col("n_edges") > 0, F.col("classical") / F.col("n_edges")).otherwise(0.0))
