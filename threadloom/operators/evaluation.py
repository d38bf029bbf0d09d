"""Evaluation: gates, probes, rates, wiring checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.functions import values as N
from threadloom.operators.intervals import first_containing
from threadloom.operators.lexicon import substring_join


def accepted_rank(answers: DataFrame) -> DataFrame:
    """thread_id, rank: the accepted answer's rank from 0 by falling score, then order; answers: (thread_id, answer_id, score, accepted, seq)."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("score"), "seq")
    return answers.withColumn("rank", F.row_number().over(order) - 1).where("accepted").select("thread_id", "answer_id", "rank")


def ranking_summary(answers: DataFrame) -> DataFrame:
    """One row: threads with an accepted answer, share ranked first, mean scores of accepted and other answers."""
    ranks = accepted_rank(answers).agg(F.count("*").alias("threads"), F.coalesce(F.avg((F.col("rank") == 0).cast("double")), F.lit(0.0)).alias("accuracy"))
    means = answers.agg(F.coalesce(F.avg(F.when(F.col("accepted"), F.col("score"))), F.lit(0.0)).alias("mean_accepted"), F.coalesce(F.avg(F.when(~F.col("accepted"), F.col("score"))), F.lit(0.0)).alias("mean_other"))
    return ranks.select("*", *[means.select(c).scalar().alias(c) for c in means.columns])


def quality_summary(graphs: DataFrame) -> DataFrame:
    """Mean, median, 95th percentile of node and edge counts, and empty graphs; graphs: (graph_id, n_nodes, n_edges)."""
    of = lambda c: [F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}"), F.percentile(c, 0.95).alias(f"p95_{c}")]
    return graphs.agg(F.count("*").alias("graphs"), *of("n_nodes"), *of("n_edges"), F.count_if(F.col("n_nodes") == 0).alias("empty"))


def gate(value: Column, good: float, fair: float, lower_is_better: bool = False) -> Column:
    """pass, warn or fail by two thresholds; fail for null."""
    at = (lambda v, t: v <= t) if lower_is_better else (lambda v, t: v >= t)
    return F.when(at(value, good), "pass").when(at(value, fair), "warn").otherwise("fail")


def health_gates(stats: DataFrame) -> DataFrame:
    """(gate, status) from one row: parse_rate, assembly_rate, backed_edges."""
    return stats.select(F.explode(F.array(
        F.struct(F.lit("parse").alias("gate"), F.when(F.col("parse_rate") >= 0.80, "pass").otherwise("fail").alias("status")),
        F.struct(F.lit("assembly").alias("gate"), F.when(F.col("assembly_rate") >= 0.95, "pass").otherwise("fail").alias("status")),
        F.struct(F.lit("backed").alias("gate"), F.when(F.col("backed_edges") > 0, "pass").otherwise("fail").alias("status")),
    )).alias("g")).select("g.*")


def internal_gates(stats: DataFrame) -> DataFrame:
    """(gate, status) from one row: scope_coverage, empty_rate, ready_terms."""
    return stats.select(F.explode(F.array(
        F.struct(F.lit("scope_coverage").alias("gate"), F.when(F.col("scope_coverage") >= 0.05, "pass").otherwise("warn").alias("status")),
        F.struct(F.lit("empty_rate").alias("gate"), gate(F.col("empty_rate"), 0.05, 0.20, True).alias("status")),
        F.struct(F.lit("ready_terms").alias("gate"), F.when(F.col("ready_terms") >= 20, "pass").otherwise("warn").alias("status")),
    )).alias("g")).select("g.*")


def document_frequency(mentions: DataFrame) -> DataFrame:
    """term, df over papers; mentions: (paper_id, term)."""
    return mentions.groupBy("term").agg(F.countDistinct("paper_id").alias("df"))


def candidate_quality(scores: DataFrame) -> DataFrame:
    """One row: terms, share of several words, share of two entities or more ('ready'), ready terms."""
    return scores.agg(F.count("*").alias("terms"), N.rate(F.count_if(F.col("term").contains(" ")), F.count("*")).alias("phrase_share"), N.rate(F.count_if(F.col("entities") >= 2), F.count("*")).alias("ready_share"), F.count_if(F.col("entities") >= 2).alias("ready"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """label, hits, entities, mean confidence; hits: (entity_id, label, confidence)."""
    return hits.groupBy("label").agg(F.count("*").alias("hits"), F.countDistinct("entity_id").alias("entities"), F.avg("confidence").alias("mean_confidence"))


def signature_delta(a: DataFrame, b: DataFrame, kind: str, chars_a: float, chars_b: float) -> DataFrame:
    """kind, n_a, n_b, delta and densities per 1000 characters, of all kinds of either; a, b: (kind)."""
    x, y = a.groupBy(kind).agg(F.count("*").alias("n_a")), b.groupBy(kind).agg(F.count("*").alias("n_b"))
    j = x.join(y, kind, "full").fillna(0, ["n_a", "n_b"])
    per = lambda c, chars: N.rate(F.col(c) * 1000.0, F.lit(float(chars)))
    return j.select(kind, "n_a", "n_b", (F.col("n_b") - F.col("n_a")).alias("delta"), per("n_a", chars_a).alias("density_a"), per("n_b", chars_b).alias("density_b"))


def keyword_tracks(texts: DataFrame, terms: dict[str, list[str]], anchors: list[str], k: int) -> DataFrame:
    """track, id, terms, title_hits, strong, anchored, rank: the k best texts of each track by terms, title hits, score.

    texts: (id, title, body, score); a text is weak with a term, strong with two, anchored with an anchor word."""
    low = texts.select("id", "score", X.normalise("title").alias("t"), X.normalise("body").alias("b"))
    out = None
    for track, words in sorted(terms.items()):
        patterns = [X.word_pattern(w) for w in words]
        hits = sum(((F.col("t").rlike(p) | F.col("b").rlike(p)).cast("int") for p in patterns), F.lit(0))
        titles = sum((F.col("t").rlike(p).cast("int") for p in patterns), F.lit(0))
        anchored = F.lit(False)
        for w in anchors:
            anchored = anchored | F.col("t").rlike(X.word_pattern(w)) | F.col("b").rlike(X.word_pattern(w))
        one = low.select(F.lit(track).alias("track"), "id", "score", hits.alias("terms"), titles.alias("title_hits"), anchored.alias("anchored")).where("terms >= 1")
        out = one if out is None else out.union(one)
    order = Window.partitionBy("track").orderBy(F.desc("terms"), F.desc("title_hits"), F.desc("score"), "id")
    ranked = out.withColumn("strong", F.col("terms") >= 2).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("track", "id", "terms", "title_hits", "strong", "anchored", "rank")


def response_quality(responses: DataFrame) -> DataFrame:
    """dimension and counts of good, weak, broken and unreadable responses."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return responses.groupBy("dimension").agg(n("good"), n("weak"), n("broken"), n("parse_error"))


def route_balance(routes: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """route, a count of texts with a keyword for each class, and balance = least / greatest."""
    low = F.lower("text")
    counts = [F.count_if(F.greatest(*[low.contains(w) for w in words], F.lit(False))).alias(c) for c, words in sorted(classes.items())]
    g = routes.groupBy("route").agg(*counts)
    names = sorted(classes)
    return g.withColumn("balance", N.rate(F.least(*names), F.greatest(*names)))


def search_merge(results: DataFrame) -> DataFrame:
    """paper_id, sets of queries and gaps, score = weights summed over distinct queries; results: (paper_id, query_id, gap, weight)."""
    once = results.groupBy("paper_id", "query_id").agg(F.max("weight").alias("weight"), F.collect_set("gap").alias("gaps"))
    return once.groupBy("paper_id").agg(F.array_sort(F.collect_set("query_id")).alias("queries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("gaps")))).alias("gaps"), F.sum("weight").alias("score"))


def port_compatible(source: Column, target: Column, known: Column | None = None) -> Column:
    """Whether a port of one type may feed one of another: equal types, families that FEEDS allows, or pairs that the
    reference knows together; a missing type feeds nothing."""
    family = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    rule = source == target
    for s, targets in V.FEEDS.items():
        rule = rule | ((family(source) == s) & family(target).isin(*targets))
    there = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "")
    return there & (F.coalesce(rule, F.lit(False)) | (F.coalesce(known, F.lit(False)) if known is not None else F.lit(False)))


def node_completeness(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, pattern, completeness): 0.7 of the required and 0.3 of the typical links that the text holds; no link
    of a kind counts as all of them. nodes: (node_id, pattern, text); links: (pattern, term, kind)."""
    j = nodes.join(links, "pattern", "left").withColumn("_in", F.lower("text").contains(F.lower("term")).cast("double"))
    share = lambda k: F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("_in"))), F.lit(1.0))
    return j.groupBy("node_id", "pattern").agg((0.7 * share("required") + 0.3 * share("typical")).alias("completeness"))


def act_fits(act: Column, detected: Column, discourse: Column, text: Column, node_type: Column) -> Column:
    """Whether an edge's act suits its source: the text names the act, or shows what ACT_NEEDS asks for; acts without
    a rule fit, no act doesn't."""
    out = F.lit(True)
    for name, (marks, pattern, question) in V.ACT_NEEDS.items():
        ok = F.arrays_overlap(discourse, F.array(*map(F.lit, marks))) if marks else F.lit(False)
        if pattern:
            ok = ok | text.rlike("(?i)" + pattern)
        if question:
            ok = ok | (node_type == "question") | text.contains("?")
        out = F.when(act == name, ok).otherwise(out)
    return F.coalesce(act, F.lit("")).isNotNull() & (F.coalesce(act, F.lit("")) != "") & (F.array_contains(detected, act) | F.coalesce(out, F.lit(False)))


def category_consistent(a: Column, b: Column, known: Column) -> Column:
    """Whether two ends share a categorical pattern, or hold patterns known together (an array of `a|b`)."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("|"), y))))
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.arrays_overlap(a, b) | F.arrays_overlap(pairs, known))


def verify_wiring(edges: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """thread_id, rates of edges with consistent categories, compatible ports and fitting acts, mean completeness of
    nodes, and the mean of the four.

    edges: (thread_id, edge_type, source_type, target_type, consistent, fits); nodes: (thread_id, completeness); known:
    (a, b) pairs of port types known together."""
    pairs = known.select(F.col("a").alias("source_type"), F.col("b").alias("target_type"), F.lit(True).alias("_known")).distinct()
    j = edges.join(pairs, ["source_type", "target_type"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    e = j.groupBy("thread_id").agg(share(F.col("consistent")).alias("categorical_rate"), share(port_compatible(F.col("source_type"), F.col("target_type"), F.col("_known"))).alias("port_rate"), share(F.col("fits")).alias("act_rate"))
    n = nodes.groupBy("thread_id").agg(F.avg("completeness").alias("completeness"))
    out = e.join(n, "thread_id", "full").fillna(0.0)
    return out.withColumn("overall", (F.col("categorical_rate") + F.col("port_rate") + F.col("act_rate") + F.col("completeness")) / 4)


def page_patterns(pages: DataFrame, links: DataFrame, patterns: dict = V.CATEGORICAL) -> DataFrame:
    """page_id, pattern, score: a point for a link that signals it, one more if a definition holds the link, one for each
    text signal, three for the page's name; patterns short of their least score go.

    pages: (page_id, name, content); links: (page_id, target, link_type)."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(p, s.lower()) for p, (signals, _, _) in patterns.items() for s in signals], "pattern string, target string")
    own = links.select("page_id", F.lower("target").alias("target"), (F.col("link_type") == "link/definition-ref").cast("int").alias("d")).groupBy("page_id", "target").agg(F.max("d").alias("d"))
    by_link = own.join(wanted, "target").groupBy("page_id", "pattern").agg(F.sum(1 + F.col("d")).alias("score"))
    plain = pages.select("page_id", F.lower("name").alias("name"), X.strip_wiki("content").alias("text"))
    scored = []
    for p, (_, texts, _) in patterns.items():
        key = p.split("/")[1]
        points = sum((F.col("text").rlike("(?i)" + t).cast("long") for t in texts), F.lit(0).cast("long"))
        named = F.col("name").contains(key) | F.col("name").contains(key.replace("-", " "))
        scored.append(F.struct(F.lit(p).alias("pattern"), (points + F.when(named, 3).otherwise(0)).alias("score")))
    by_text = plain.select("page_id", F.explode(F.array(*scored)).alias("s")).select("page_id", "s.*").where("score > 0")
    least = spark.createDataFrame([(p, n) for p, (_, _, n) in patterns.items()], "pattern string, least int")
    total = by_link.union(by_text).groupBy("page_id", "pattern").agg(F.sum("score").alias("score"))
    return total.join(least, "pattern").where("score >= least").select("page_id", "pattern", "score")


def scope_neighbours(papers: DataFrame, sample: int | None = 800, seed: int = 13) -> DataFrame:
    """paper_id, neighbour, jaccard, same_category: each sampled paper's most similar other by its set of scopes.

    papers: (paper_id, category, scopes array). The sample is the definition's: the first papers by hash, all with None; a paper meets
    those that share a scope with it, others being at 0."""
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("paper_id").cast("string")).cast("binary"), 256)
    p = papers if sample is None else papers.orderBy(order, "paper_id").limit(sample)
    p = p.withColumn("scopes", F.array_distinct("scopes"))
    one = p.select("paper_id", "category", F.size("scopes").alias("n"), F.explode("scopes").alias("s"))
    other = one.select(F.col("paper_id").alias("neighbour"), F.col("category").alias("c2"), F.col("n").alias("n2"), "s")
    both = one.join(other, "s").where("paper_id <> neighbour").groupBy("paper_id", "category", "n", "neighbour", "c2", "n2").agg(F.count("*").alias("k"))
    scored = both.withColumn("jaccard", F.col("k") / (F.col("n") + F.col("n2") - F.col("k")))
    best = Window.partitionBy("paper_id").orderBy(F.desc("jaccard"), "neighbour")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("paper_id", "neighbour", "jaccard", (F.col("category") == F.col("c2")).alias("same_category"))


def concept_probe(mentions: DataFrame, texts: DataFrame, least: int = 2, most: int = 200) -> DataFrame:
    """term, processed, raw, lift: papers found by processing and by plain substring, of terms of a middling df.

    mentions: (paper_id, term); texts: (paper_id, text). The terms probed are a stated set."""
    df = document_frequency(mentions).where(F.col("df").between(least, most))
    held = substring_join(texts.select("paper_id", F.lower("text").alias("low")), df.select(F.lower("term").alias("term"), F.col("term").alias("spelled")))
    raw = held.groupBy(F.col("spelled").alias("term")).agg(F.countDistinct("paper_id").alias("raw"))
    return df.select("term", F.col("df").alias("processed")).join(raw, "term", "left").fillna(0, ["raw"]).withColumn("lift", N.rate("processed", F.greatest(F.col("raw"), F.lit(1))))


def reference_dictionary(pages: DataFrame, links: DataFrame, top: int = 10, typical: int = 20) -> DataFrame:
    """pattern, instances, required (linked by a tenth of the instances, the first `top`) and typical links (a twentieth).

    pages: (page, pattern); links: (page, term)."""
    p = pages.distinct()
    n = p.groupBy("pattern").agg(F.count("*").alias("instances"))
    counts = p.join(links.distinct(), "page").groupBy("pattern", "term").agg(F.count("*").alias("c")).join(n, "pattern")
    order = Window.partitionBy("pattern").orderBy(F.desc("c"), "term")
    ranked = counts.withColumn("_r", F.row_number().over(order))
    listed = lambda share, k: F.transform(F.array_sort(F.collect_list(F.when((F.col("c") >= F.greatest(F.lit(1.0), share * F.col("instances"))) & (F.col("_r") <= k), F.struct("_r", "term")))), lambda x: x["term"])
    out = ranked.groupBy("pattern").agg(listed(F.lit(0.1), top).alias("required"), listed(F.lit(0.05), typical).alias("typical"))
    return n.join(out, "pattern", "left")


def scope_audit(variables: DataFrame, ranges: DataFrame) -> DataFrame:
    """entity_id, variables, scoped, rate: variables (entity_id, pos) inside any range (entity_id, start, end)."""
    held = first_containing(variables.select("entity_id", "pos"), ranges.select("entity_id", "start", "end", F.lit(True).alias("_in")), "entity_id", ["_in"])
    return held.groupBy("entity_id").agg(F.count("*").alias("variables"), F.count("_in").alias("scoped")).withColumn("rate", N.rate("scoped", "variables"))
