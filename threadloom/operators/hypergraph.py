"""Typed hypergraphs of threads and papers as a node and an edge table, keyed by graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import spans as S
from threadloom.functions import values as N
from threadloom.functions.latex import to_sexp

NODE = ["graph_id", "id", "type", "subtype", "attrs"]
EDGE = ["graph_id", "type", "ends", "attrs"]


def _attrs(**columns) -> F.Column:
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[c.cast("string") for c in columns.values()]))


def parsed_expressions(texts: DataFrame, curated: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep..., latex, position, display, sexp of the distinct formulas of each text; curated(latex, sexp) go first,
    white space aside, and only what they lack is parsed."""
    keep = keep or ["graph_id", "post_id"]
    found = S.span_rows(texts, "text", S.expressions, S.FRAGMENT, keep)
    if curated is None:
        return found.withColumn("sexp", to_sexp("latex"))
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    known = curated.select(bare("latex").alias("_l"), F.col("sexp").alias("_s")).dropDuplicates(["_l"])
    out = found.withColumn("_l", bare("latex")).join(known, "_l", "left")
    return out.withColumn("sexp", F.coalesce("_s", to_sexp(F.when(F.col("_s").isNull(), F.col("latex"))))).drop("_l", "_s")


def assemble(posts: DataFrame, acts: DataFrame, mentions: DataFrame, scopes: DataFrame, marks: DataFrame, categories: DataFrame, expressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of threads.

    posts: (graph_id, post_id, subtype, score); acts: (graph_id, source, target, act); mentions: (graph_id, post_id,
    term, canon); scopes: (graph_id, post_id, hx_id, type, match); marks: (graph_id, post_id, hx_id, role, type, match);
    categories: (graph_id, post_id, concept, score); expressions: (graph_id, post_id, latex, sexp, display, position).
    Nodes of an id are one, terms with all their surface forms."""
    term = F.concat(F.lit("term:"), "canon")
    terms = mentions.groupBy("graph_id", "canon").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("forms"))
    expr = N.expression_id("post_id", "latex")
    nodes = (
        posts.select("graph_id", F.col("post_id").alias("id"), F.lit("post").alias("type"), "subtype", _attrs(score=F.col("score")).alias("attrs"))
        .union(terms.select("graph_id", term.alias("id"), F.lit("term"), "canon", _attrs(surface_forms=F.col("forms"))))
        .union(scopes.select("graph_id", F.col("hx_id"), F.lit("scope"), "type", _attrs(match=F.col("match"))))
        .union(expressions.select("graph_id", expr, F.lit("expression"), F.lit("math"), _attrs(latex=F.col("latex"), sexp=F.col("sexp"), display=F.col("display"))))
    )
    nodes = nodes.groupBy("graph_id", "id").agg(*[F.min_by(c, F.struct("type", "subtype")).alias(c) for c in ("type", "subtype", "attrs")])
    edges = (
        acts.select("graph_id", F.lit("iatc").alias("type"), F.array("source", "target").alias("ends"), _attrs(act=F.col("act")).alias("attrs"))
        .union(mentions.select("graph_id", F.lit("mention"), F.array("post_id", term), _attrs(surface=F.col("term"))))
        .union(scopes.select("graph_id", F.lit("scope"), F.array("hx_id", "post_id"), _attrs(binding_type=F.col("type"))))
        .union(marks.select("graph_id", F.lit("discourse"), F.array("post_id"), _attrs(hx_id=F.col("hx_id"), role=F.col("role"), dtype=F.col("type"), match=F.col("match"))))
        .union(categories.select("graph_id", F.lit("categorical"), F.array("post_id"), _attrs(concept=F.col("concept"), score=F.col("score"))))
        .union(expressions.select("graph_id", F.lit("surface"), F.array(expr, F.col("post_id")), _attrs(position=F.col("position"))))
    )
    return nodes.select(*NODE), edges.select(*EDGE)


def paper_graph(papers: DataFrame, mentions: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of papers (graph_id, text): the paper as a post, its terms, scopes and formulas."""
    found = S.span_rows(papers, "text", S.paper_expressions(), S.FRAGMENT, ["graph_id"]).withColumn("sexp", to_sexp("latex"))
    posts = papers.select("graph_id", F.concat(F.lit("paper:"), F.col("graph_id").cast("string")).alias("post_id"))
    expr = F.concat(F.lit("expr:"), F.substring(F.sha1(F.col("latex").cast("binary")), 1, 12))
    term = F.concat(F.lit("term:"), "canon")
    own = F.concat(F.lit("paper:"), F.col("graph_id").cast("string"))
    m, s = mentions.select("graph_id", "canon").distinct(), scopes
    nodes = posts.select("graph_id", F.col("post_id").alias("id"), F.lit("post").alias("type"), F.lit("paper").alias("subtype")).union(m.select("graph_id", term, F.lit("term"), "canon")).union(s.select("graph_id", "hx_id", F.lit("scope"), "type")).union(found.select("graph_id", expr, F.lit("expression"), F.lit("math")))
    edges = m.select("graph_id", F.lit("mention").alias("type"), F.array(own, term).alias("ends")).union(s.select("graph_id", F.lit("scope"), F.array(F.col("hx_id"), own))).union(found.select("graph_id", F.lit("surface"), F.array(expr, own)))
    return nodes.distinct(), edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, n_nodes, n_edges, counts of node types, map of edge types."""
    kinds = [F.count_if(F.col("type") == t).alias(f"n_{t}s") for t in ("post", "term", "expression", "scope")]
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), *kinds)
    e = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")).join(N.frequency_map(edges, ["graph_id"], "type", "edge_types"), "graph_id")
    return n.join(e, "graph_id", "left").fillna(0, ["n_edges"])


def parse_stats(expressions: DataFrame) -> DataFrame:
    """One row: formulas, parsed, fallbacks (in quotes), rate."""
    bad = F.col("sexp").startswith('"')
    return expressions.agg(F.count("*").alias("total"), F.count_if(~bad).alias("parsed"), F.count_if(bad).alias("fallback")).withColumn("rate", N.rate("parsed", "total"))


def node_ports(scopes: DataFrame, wires: DataFrame) -> DataFrame:
    """(node_id, hx_id, direction, type, label, position): scopes before a node's first consequence or cause are inputs,
    of binding kinds; those behind it outputs. Labels put together what is bound; else 40 characters of the match."""
    first = wires.where(F.col("type").isin("wire/consequential", "wire/causal")).groupBy("node_id").agg(F.min("position").alias("_first"))
    named = F.transform(F.filter("ends", lambda e: e["role"].isin("symbol", "type", "description", "value", "condition", "object")), lambda e: e["value"])
    j = scopes.join(first, "node_id", "left")
    before = F.col("_first").isNull() | (F.col("position") < F.col("_first"))
    way = F.when(before & F.split_part("type", F.lit("/"), F.lit(1)).isin("bind", "assume", "quant", "constrain"), "input").when(~before, "output")
    label = F.when(F.size(named) > 0, F.array_join(named, " : ")).otherwise(F.substring("match", 1, 40))
    return j.select("node_id", "hx_id", way.alias("direction"), "type", label.alias("label"), "position").where("direction IS NOT NULL")


def distinct_ports(ports: DataFrame) -> DataFrame:
    """The first port by position of each type and label, case aside."""
    g = ports.groupBy("node_id", "direction", "type", F.lower("label").alias("_l")).agg(F.min(F.struct("position", "hx_id", "label")).alias("f"))
    return g.select("node_id", "f.hx_id", "direction", "type", "f.label", "f.position")


def match_ports(outputs: DataFrame, inputs: DataFrame, pairs: DataFrame, weights: DataFrame, top: int | None = None) -> DataFrame:
    """(source, target, out_id, in_id, score): label words shared, plus half a point for each that the reference weighs.

    outputs, inputs: (node_id, hx_id, label); pairs: (source, target) of nodes; weights: (term). Words meet by equality,
    so nothing is compared that shares none. top: the best so many of each pair of nodes."""
    words = lambda d, n, i: d.select(F.col("node_id").alias(n), F.col("hx_id").alias(i), F.explode(F.array_distinct(F.split(F.lower("label"), r"\s+"))).alias("w")).where("w <> ''")
    o, t = words(outputs, "source", "out_id"), words(inputs, "target", "in_id")
    j = o.join(pairs.distinct(), "source").join(t, ["target", "w"]).join(weights.select(F.lower("term").alias("w"), F.lit(0.5).alias("_b")).distinct(), "w", "left")
    scored = j.groupBy("source", "target", "out_id", "in_id").agg(F.round(F.count("*") + F.coalesce(F.sum("_b"), F.lit(0.0)), 2).alias("score"))
    if top is None:
        return scored
    from pyspark.sql.window import Window

    order = Window.partitionBy("source", "target").orderBy(F.desc("score"), "out_id", "in_id")
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def merged_matches(a: DataFrame, b: DataFrame, top: int = 12) -> DataFrame:
    """The best score of each pair of ports in either, the first `top` of each pair of nodes."""
    from pyspark.sql.window import Window

    best = a.unionByName(b).groupBy("source", "target", "out_id", "in_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("source", "target").orderBy(F.desc("score"), "out_id", "in_id")
    return best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def dominant_act(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, act): the most frequent act of a node, ties to the earliest; assert or clarify where none is.

    hits: (node_id, type, position); nodes: (node_id, node_type)."""
    g = hits.groupBy("node_id", "type").agg(F.count("*").alias("c"), F.min("position").alias("p"))
    best = g.groupBy("node_id").agg(F.max_by("type", F.struct("c", -F.col("p"))).alias("act"))
    return nodes.join(best, "node_id", "left").select("node_id", F.coalesce("act", F.when(F.col("node_type") == "comment", "clarify").otherwise("assert")).alias("act"))


def theorem_records(papers: DataFrame) -> DataFrame:
    """Theorem-like statements of papers (paper_id, source) with number, section, proof and identity."""
    from threadloom.fixed_values import STATEMENTS
    from threadloom.operators import intervals as I

    blocks = S.span_rows(papers, "source", S.theorem_blocks, S.THEOREM, ["paper_id"])
    heads = S.span_rows(papers, "source", S.sections, S.SECTION, ["paper_id"]).select("paper_id", F.col("start").alias("pos"), "section")
    numbered = I.numbered(blocks, ["paper_id", "env"], ["start"]).withColumnRenamed("number", "number_hint")
    sourced = numbered.join(papers.select("paper_id", "source"), "paper_id")
    from pyspark.sql.window import Window

    order = Window.partitionBy("paper_id").orderBy("start")
    after = F.lead("start").over(order)
    between = F.substring("source", F.col("end") + 1, F.col("_next") - F.col("end"))
    plain = F.length(F.trim(F.regexp_replace(between, r"(?m)(?<!\\)%.*$", "")))
    proofs = sourced.withColumn("_next", after).withColumn("_env", F.lead("env").over(order)).withColumn("_proof", F.lead("statement").over(order))
    proofs = proofs.withColumn("proof", F.when((F.col("_env") == "proof") & (plain < 50), F.col("_proof")).otherwise(F.lit("")))
    kept = proofs.where(F.col("env").isin(*STATEMENTS)).withColumn("pos", F.col("start")).drop("source", "_next", "_env", "_proof")
    out = I.enclosing(kept, heads, "paper_id", "section")
    refs = lambda c: F.regexp_extract_all(c, F.lit(r"\\(?:eq)?ref\{([^}]+)\}"), 1)
    return out.select("paper_id", N.theorem_id("paper_id", "label", "env", "statement").alias("theorem_id"), "env", "name", "label", "number_hint", "statement", "proof", F.coalesce("section", F.lit("")).alias("section"), refs("statement").alias("refs"), refs("proof").alias("proof_refs"), F.col("start").alias("char_offset"), N.statement_hash("statement").alias("statement_hash"), (F.trim("proof") != "").alias("has_proof"))


def extraction_stats(theorems: DataFrame) -> DataFrame:
    """env, n, with_proof, named, labelled."""
    return theorems.groupBy("env").agg(F.count("*").alias("n"), F.count_if("has_proof").alias("with_proof"), F.count_if(F.col("name") != "").alias("named"), F.count_if(F.col("label") != "").alias("labelled"))


def missions(theorems: DataFrame, least: int = 40, need_proof: bool = False) -> DataFrame:
    """Statements of a length (with proof, if asked) as nested missions: canonical, ledger of five steps, queries, source."""
    kept = theorems.where((F.length("statement") >= least) & (F.col("has_proof") | F.lit(not need_proof)))
    steps = ["setup", "strategy", "key_step", "verification", "conclusion"]  # fixed values
    ledger = F.array(*[F.struct(F.lit(s).alias("id"), F.array(*[F.lit(p) for p in steps[max(0, i - 1) : i]]).cast("array<string>").alias("depends_on")) for i, s in enumerate(steps)])
    title = F.coalesce(F.nullif("name", F.lit("")), F.concat_ws(" ", F.initcap("env"), F.col("number_hint").cast("string")))
    return kept.select(F.col("theorem_id").alias("mission_id"), F.struct(title.alias("title"), "statement", "env").alias("canonical"), ledger.alias("ledger_template"), F.filter(F.array(F.nullif("name", F.lit("")), F.nullif("section", F.lit(""))), lambda q: q.isNotNull()).alias("corpus_queries"), F.struct("paper_id", "char_offset", "statement_hash").alias("source"))
