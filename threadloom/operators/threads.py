"""Questions, answers and comments: best answers, threads, wiring diagrams.

posts: (id, kind 'question' or 'answer', parent_id, accepted_id, score, seq, body, tags, title); comments: (id, post_id,
score, text). `seq` is the order that breaks ties; where a dump has none, ids do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as X
from threadloom.functions import values as N


def last_by_id(posts: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row for each id, the last in order."""
    order = Window.partitionBy(key).orderBy(F.desc(seq))
    return posts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def lowest(posts: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n lowest ids: a limit asked for, 0 being none at all."""
    return posts.orderBy(key).limit(n)


def in_shard(df: DataFrame, key: str, index: int, shards: int) -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(shards)) == index)


def best_answers(posts: DataFrame, least: int = 0, any_accepted: bool = False) -> DataFrame:
    """question_id, answer_id, answer_score: the accepted answer, else that of highest score, first in order.

    Questions and answers of a score below `least` take no part. any_accepted: an accepted id counts if any post has
    it, even one that isn't an answer to the question (which must have one)."""
    kept = posts.where(F.col("score") >= least)
    q = kept.where("kind = 'question'").select(F.col("id").alias("question_id"), "accepted_id")
    a = kept.where("kind = 'answer'").select(F.col("id").alias("answer_id"), F.col("parent_id").alias("question_id"), F.col("score").alias("answer_score"), "seq")
    pairs = q.join(a, "question_id")
    order = Window.partitionBy("question_id").orderBy(F.desc(F.coalesce(F.col("answer_id") == F.col("accepted_id"), F.lit(False))), F.desc("answer_score"), "seq")
    best = pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    if any_accepted:
        other = kept.select(F.col("id").alias("_id"), F.col("score").alias("_score"))
        best = best.join(other, best["accepted_id"] == other["_id"], "left")
        best = best.withColumn("answer_id", F.coalesce("_id", "answer_id")).withColumn("answer_score", F.when(F.col("_id").isNotNull(), F.col("_score")).otherwise(F.col("answer_score")))
    return best.select("question_id", "answer_id", "answer_score")


def assemble_threads(posts: DataFrame, comments: DataFrame, least: int = 0) -> DataFrame:
    """question_id, answers (array of id, score by falling score, then order), comments (array of id, post_id by id).

    Questions need the least score, answers none; questions without answers stay; comments of other posts drop out."""
    q = posts.where((F.col("kind") == "question") & (F.col("score") >= least)).select(F.col("id").alias("question_id"))
    a = posts.where("kind = 'answer'").select(F.col("parent_id").alias("question_id"), F.col("id").alias("answer_id"), "score", "seq").join(q, "question_id", "left_semi")
    answers = a.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_k"), "seq", F.col("answer_id").alias("id"), "score"))).alias("answers"))
    answers = answers.withColumn("answers", F.transform("answers", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))))
    owners = q.select("question_id", F.col("question_id").alias("post_id")).union(a.select("question_id", F.col("answer_id").alias("post_id")))
    c = comments.select(F.col("id").alias("comment_id"), "post_id").join(owners, "post_id")
    c = c.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(F.col("comment_id").alias("id"), "post_id"))).alias("comments"))
    empty_a, empty_c = F.array().cast(answers.schema["answers"].dataType), F.array().cast(c.schema["comments"].dataType)
    out = q.join(answers, "question_id", "left").join(c, "question_id", "left")
    return out.select("question_id", F.coalesce("answers", empty_a).alias("answers"), F.coalesce("comments", empty_c).alias("comments"))


def needed_only(df: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is needed."""
    return df.join(needed.select(key).distinct(), key, "left_semi")


def flat_comments(question_comments: Column, answer_comments: Column) -> Column:
    """Comments of the question, then those of its answers (a map by answer)."""
    return F.concat(F.coalesce(question_comments, F.array().cast("array<string>")), F.coalesce(F.flatten(F.map_values(answer_comments)), F.array().cast("array<string>")))


def target_node(question_id, post_id, is_answer) -> Column:
    """The node a comment points to: its question's, an answer's, or that of an unknown post."""
    q, p = X.as_column(question_id), X.as_column(post_id)
    return F.when(p == q, F.concat(F.lit("q-"), q.cast("string"))).when(X.as_column(is_answer), F.concat(F.lit("a-"), p.cast("string"))).otherwise(F.concat(F.lit("post-"), p.cast("string")))


def question_entities(pairs: DataFrame, site: str) -> DataFrame:
    """Entities of answered questions: pairs(question_id, title, question_body, answer_body, tags, score, answer_score)."""
    return pairs.select(
        X.entity_id(F.lit(site), "question_id").alias("entity_id"), F.lit("qa-pair").alias("entity_type"), F.lit(site).alias("entity_source"),
        "title", X.strip_html("question_body").alias("question_text"), X.strip_html("answer_body").alias("answer_text"),
        X.latex_fragments("question_body").alias("question_latex"), X.latex_fragments("answer_body").alias("answer_latex"), "tags", "score", "answer_score",
    )


def wiring_nodes(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """thread_id, node_id, node_type, post_id, parent_id, text for questions, answers and comments."""
    q = posts.where("kind = 'question'").select("id", "body")
    a = posts.where("kind = 'answer'").join(q.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", "parent_id", "body")
    thread = lambda x: F.concat(F.lit("t"), F.col(x).cast("string"))
    owners = q.select(F.col("id").alias("parent_id"), F.col("id").alias("thread")).union(a.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("thread")))
    c = comments.select("id", F.col("post_id").alias("parent_id"), "text").join(owners, "parent_id")
    return (
        q.select(thread("id").alias("thread_id"), F.concat(thread("id"), F.lit("-q")).alias("node_id"), F.lit("question").alias("node_type"), F.col("id").alias("post_id"), F.lit(None).cast("long").alias("parent_id"), F.col("body").alias("text"))
        .unionByName(a.select(thread("parent_id").alias("thread_id"), F.concat(thread("parent_id"), F.lit("-a"), F.col("id").cast("string")).alias("node_id"), F.lit("answer").alias("node_type"), F.col("id").alias("post_id"), "parent_id", F.col("body").alias("text")))
        .unionByName(c.select(thread("thread").alias("thread_id"), F.concat(thread("thread"), F.lit("-c"), F.col("id").cast("string")).alias("node_id"), F.lit("comment").alias("node_type"), F.col("id").alias("post_id"), "parent_id", "text"))
    )


def wiring_edges(nodes: DataFrame, bank=None) -> DataFrame:
    """Edges from answers to questions and from comments to their posts: the first speech act that the text shows
    ('classical', with its evidence), else 'assert' or 'comment-on' ('structural')."""
    act = X.performative("text", bank) if bank else X.performative("text")
    targets = nodes.where("node_type <> 'comment'").select(F.col("thread_id").alias("_t"), F.col("post_id").alias("_p"), F.col("node_id").alias("target"))
    out = nodes.where("node_type <> 'question'").withColumn("_act", act)
    out = out.join(targets, (F.col("thread_id") == F.col("_t")) & (F.col("parent_id") == F.col("_p")))
    plain = F.when(F.col("node_type") == "answer", "assert").otherwise("comment-on")
    return out.select("thread_id", F.col("node_id").alias("source"), "target", F.coalesce("_act.act", plain).alias("edge_type"), F.coalesce("_act.evidence", F.lit("")).alias("evidence"), F.when(F.col("_act").isNull(), "structural").otherwise("classical").alias("detection"))


VALID_ACTS = ("assert", "challenge", "query", "clarify", "reform", "exemplify", "reference", "agree", "retract")


def merge_judged_edges(edges: DataFrame, judged: DataFrame) -> DataFrame:
    """Edges with the acts of judged(source, target, edge_type, reasoning, seq): valid acts replace what was found, the
    last of a pair, with 120 characters of reasoning; pairs that are no edge pass."""
    valid = judged.where(F.col("edge_type").isin(*VALID_ACTS))
    order = Window.partitionBy("source", "target").orderBy(F.desc("seq"))
    valid = valid.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("source", "target", F.col("edge_type").alias("_type"), F.substring("reasoning", 1, 120).alias("_why"))
    out = edges.join(valid, ["source", "target"], "left")
    found = F.col("_type").isNotNull()
    return out.select("thread_id", "source", "target", F.coalesce("_type", "edge_type").alias("edge_type"), F.when(found, F.coalesce("_why", F.lit(""))).otherwise(F.col("evidence")).alias("evidence"), F.when(found, "llm").otherwise(F.col("detection")).alias("detection"))


def hyperedges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """hx_id, hx_type, ends (role, ident, node_type), evidence, labels; ids number a thread's edges by source."""
    kind = nodes.groupBy("node_id").agg(F.min("node_type").alias("t"))
    out = edges.join(kind.select(F.col("node_id").alias("source"), F.col("t").alias("_s")), "source", "left").join(kind.select(F.col("node_id").alias("target"), F.col("t").alias("_t")), "target", "left")
    number = F.row_number().over(Window.partitionBy("thread_id").orderBy("source", "target")) - 1
    end = lambda role, node, t: F.struct(F.lit(role).alias("role"), F.col(node).alias("ident"), F.coalesce(t, F.lit("unknown")).alias("node_type"))
    return out.select("thread_id", F.concat("thread_id", F.lit(":edge-"), F.format_string("%03d", number)).alias("hx_id"), F.concat(F.lit("thread/"), "edge_type").alias("hx_type"), F.array(end("source", "source", F.col("_s")), end("target", "target", F.col("_t"))).alias("ends"), "evidence", F.array(F.lit("thread"), "edge_type", "detection").alias("labels"))


def diagram_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """thread_id, n_nodes, n_edges and maps of counts by node type, edge type and detection."""
    n = nodes.groupBy("thread_id").agg(F.count("*").alias("n_nodes")).join(N.frequency_map(nodes, ["thread_id"], "node_type", "node_types"), "thread_id")
    e = edges.groupBy("thread_id").agg(F.count("*").alias("n_edges"))
    for value, to in (("edge_type", "edge_types"), ("detection", "detection_types")):
        e = e.join(N.frequency_map(edges, ["thread_id"], value, to), "thread_id")
    return n.join(e, "thread_id", "left").fillna(0, ["n_edges"])


def performative_summary(edges: DataFrame) -> DataFrame:
    """One row: edges, classical ones and their rate."""
    return edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("detection") == "classical").alias("n_classical")).withColumn("classical_rate", N.rate("n_classical", "n_edges"))


def normal_edges(edges: DataFrame, source=("source", "from"), target=("target", "to"), kind=("iatc", "edge_type", "type")) -> DataFrame:
    """source, target, edge_type from whichever columns are there; rows without both ends go."""
    pick = lambda names: F.coalesce(*[F.col(f"`{c}`") for c in names if c in edges.columns], F.lit(None).cast("string"))
    return edges.select(pick(source).alias("source"), pick(target).alias("target"), pick(kind).alias("edge_type")).where("source IS NOT NULL AND target IS NOT NULL")


def corpus_stats(pairs: DataFrame) -> DataFrame:
    """Counts over answered questions (question_id, answer_id, score, answer_score, tags, latex, accepted)."""
    tags = pairs.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag")).scalar()
    out = pairs.agg(
        F.count("*").alias("pairs"), F.coalesce(F.sum(F.size("latex")), F.lit(0)).alias("latex_fragments"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), F.coalesce(F.avg("answer_score"), F.lit(0.0)).alias("avg_answer_score"), F.count_if("accepted").alias("with_accepted"),
    )
    return out.withColumn("unique_tags", tags).select("pairs", "unique_tags", "latex_fragments", "avg_score", "avg_answer_score", "with_accepted")


def tag_entities(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("name")).where("name <> ''").distinct().select(F.concat(F.lit("tag-"), "name").alias("entity_id"), "name")


#: Kinds of prompts; responses come back by `values.json_part` and `number_list`, and join by entity.
PROMPTS = {
    "morphogenesis": "Question: %s\nAnswer: %s\nFrom which simpler questions could this answer have grown? Reply with a JSON object with the keys seeds, steps and result.",
    "pattern": "Title: %s\nQuestion: %s\nAnswer: %s\nWhich of the listed reasoning patterns does the answer use? Reply with a list of numbers.",
    "performative": "Source (%s): %s\nTarget (%s): %s\nWhich speech act links the source to the target? Reply with a JSON object.",
}


def prompts(df: DataFrame, kind: str, *columns: tuple[str, int]) -> DataFrame:
    """df with prompt: the template of a kind filled with columns, each cut at its length."""
    return df.withColumn("prompt", F.format_string(PROMPTS[kind], *[F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in columns]))
