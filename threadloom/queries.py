"""Registered queries of the library's own operators, and the SQL they are held against.

The driver's tables stand in for dumps: orders and line items for questions and answers, customers for users, benchmark
and part names for dictionaries, events for histories, conversations for threads, pages for wiki pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import spans as S
from threadloom.functions import text as X
from threadloom.functions import values as N
from threadloom.functions.latex import to_sexp
from threadloom.operators import evaluation as E
from threadloom.operators import events as H
from threadloom.operators import graph as G
from threadloom.operators import hypergraph as Y
from threadloom.operators import intervals as I
from threadloom.operators import lexicon as L
from threadloom.operators import sampling as P
from threadloom.operators import threads as T
from threadloom.operators import vectors as V
from threadloom.plans.tables import dealt, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the driver's; small ones of texts are dealt out, for their functions are slow."""
    t = spark.read.parquet(f"{sf}/{name}.parquet")
    return dealt(t) if name in ("documents", "pages", "conversations") else t


# questions and answers ------------------------------------------------------------------------------------------------

POSTS_SQL = """
a AS (SELECT l_orderkey AS q, l_linenumber AS n, CAST(max(l_quantity) AS INT) AS score, min(l_returnflag) AS rf, min(l_shipdate) AS ts, min(l_suppkey) AS owner FROM lineitem GROUP BY 1, 2),
acc AS (SELECT q, min(q * 10 + n) AS acc FROM a WHERE rf = 'R' GROUP BY 1),
posts AS (
  SELECT o_orderkey * 10 AS id, 'question' AS kind, NULL::BIGINT AS parent_id, acc AS accepted_id, CAST(floor(o_totalprice / 10000) AS INT) AS score, o_orderkey * 10 AS seq, o_custkey AS owner_id, o_orderdate AS ts, o_orderpriority AS body
  FROM orders LEFT JOIN acc ON q = o_orderkey
  UNION ALL SELECT q * 10 + n, 'answer', q * 10, NULL, score, n, owner, ts, rf FROM a
)
"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as questions (score: price in ten thousands), line items as answers (score: quantity; those returned are
    accepted, the first of them)."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("n")).agg(
        F.max("l_quantity").cast("int").alias("score"), F.min("l_returnflag").alias("rf"), F.min("l_shipdate").alias("ts"), F.min("l_suppkey").alias("owner")
    )
    aid = F.col("q") * 10 + F.col("n")
    acc = a.where("rf = 'R'").groupBy("q").agg(F.min(aid).alias("acc"))
    o = table(spark, sf, "orders").join(acc, F.col("q") == F.col("o_orderkey"), "left")
    none = F.lit(None).cast("long")
    return o.select((F.col("o_orderkey") * 10).alias("id"), F.lit("question").alias("kind"), none.alias("parent_id"), F.col("acc").alias("accepted_id"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("score"), (F.col("o_orderkey") * 10).alias("seq"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("body")).unionByName(
        a.select(aid.alias("id"), F.lit("answer").alias("kind"), (F.col("q") * 10).alias("parent_id"), none.alias("accepted_id"), "score", F.col("n").cast("long").alias("seq"), F.col("owner").alias("owner_id"), "ts", F.col("rf").alias("body"))
    )


@query(f"""WITH {POSTS_SQL} SELECT q.id AS question_id, a.id AS answer_id, a.score AS answer_score FROM posts q JOIN posts a ON a.parent_id = q.id
WHERE q.kind = 'question' AND q.score >= 5 AND a.score >= 5
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY coalesce(a.id = q.accepted_id, false) DESC, a.score DESC, a.seq) = 1""")
def qa_best_answer(spark, sf):
    """Each question's accepted answer, else its best."""
    return T.best_answers(posts(spark, sf), least=5)


@query(f"""WITH {POSTS_SQL}, b AS (SELECT q.id AS question_id, q.accepted_id, a.id, a.score FROM posts q JOIN posts a ON a.parent_id = q.id
WHERE q.kind = 'question' AND q.score >= 5 AND a.score >= 5 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY coalesce(a.id = q.accepted_id, false) DESC, a.score DESC, a.seq) = 1)
SELECT question_id, coalesce(o.id, b.id) AS answer_id, coalesce(o.score, b.score) AS answer_score FROM b LEFT JOIN (SELECT id, score FROM posts WHERE score >= 5) o ON o.id = b.accepted_id""")
def qa_any_accepted(spark, sf):
    """The accepted id counts wherever it is found."""
    return T.best_answers(posts(spark, sf), least=5, any_accepted=True)


@query(f"""WITH {POSTS_SQL}, c AS (SELECT event_id, event_id * 7 % 150000 AS post_id FROM events), qs AS (SELECT id FROM posts WHERE kind = 'question' AND score >= 10)
SELECT qs.id AS question_id, (SELECT count(*) FROM posts a WHERE a.parent_id = qs.id) AS n_answers,
(SELECT arg_min(a.id, struct_pack(s := -a.score, q := a.seq)) FROM posts a WHERE a.parent_id = qs.id) AS first_answer,
(SELECT count(*) FROM c WHERE c.post_id = qs.id OR c.post_id IN (SELECT a.id FROM posts a WHERE a.parent_id = qs.id)) AS n_comments FROM qs""")
def thread_assembly(spark, sf):
    """Questions with their answers in order and the comments of either."""
    comments = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.pmod(F.col("event_id") * 7, F.lit(150000)).alias("post_id"))
    t = T.assemble_threads(posts(spark, sf), comments, least=10)
    return t.select("question_id", F.size("answers").cast("long").alias("n_answers"), F.get("answers", 0)["id"].alias("first_answer"), F.size("comments").cast("long").alias("n_comments"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def needed_id_semi(spark, sf):
    """Only what is needed."""
    needed = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.needed_only(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), needed, "l_orderkey")


@query("SELECT o_orderkey % 8 AS shard, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def shard_partition_counts(spark, sf):
    """Shards by id, and their union."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = None
    for i in range(8):
        part = T.in_shard(o, "o_orderkey", i, 8).withColumn("shard", F.lit(i).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {POSTS_SQL} SELECT id, score FROM posts WHERE kind = 'question' ORDER BY id LIMIT 25")
def lowest_threads(spark, sf):
    """The lowest ids, a limit asked for."""
    return T.lowest(posts(spark, sf).where("kind = 'question'").select("id", "score"), 25)


@query("""WITH p AS (SELECT d.doc_id, string_split(d.source || '|' || d.lang, '|') AS tags, d.n_chars % 50 AS score, l.quality FROM documents d JOIN labels l USING (doc_id))
SELECT count(*) AS pairs, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM p)) AS unique_tags, count(*) AS latex_fragments, avg(score) AS avg_score, avg(score) AS avg_answer_score, count(*) FILTER (quality = 1) AS with_accepted FROM p""")
def corpus_stats(spark, sf):
    """Counts and means over pairs."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = d.select(X.tags(F.concat("source", F.lit("|"), "lang")).alias("tags"), F.pmod("n_chars", F.lit(50)).alias("score"), F.array("lang").alias("latex"), (F.col("quality") == 1).alias("accepted"))
    return T.corpus_stats(p.withColumn("answer_score", F.col("score")))


@query("SELECT DISTINCT 'tag-' || t AS entity_id, t AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part) WHERE t <> ''")
def tag_entities(spark, sf):
    """Distinct tags as entities."""
    return T.tag_entities(table(spark, sf, "part").select(X.tags(F.concat(F.lit("|"), F.translate("p_name", " ", "|"), F.lit("|"))).alias("tags")))


@query("""SELECT DISTINCT 'related-to' AS type, p_brand AS src, p_type AS dst FROM part
UNION SELECT DISTINCT 'defines', p_brand, 'term-' || substr(replace(replace(lower(p_name), ' ', '-'), '/', '-'), 1, 80) FROM part UNION SELECT DISTINCT 'classified-by', p_brand, 'msc-' || CAST(p_size AS VARCHAR) FROM part""")
def distinct_relations(spark, sf):
    """Relations of entries, once each."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.array("p_type").alias("related"), F.array("p_name").alias("defines"), F.array(F.col("p_size").cast("string")).alias("codes"))
    return L.relations(p)


CONV_SQL = """c AS (SELECT conv_id, turn, role, text, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations)"""
ACT_BANK = [("challenge", [r"(?:^|[^A-Za-z])(the [a-z]+)"]), ("query", [r"(?:^|[^A-Za-z])(de [a-z]+)"]), ("clarify", [r"(?:^|[^A-Za-z])(der [a-z]+)"])]


def conversation_posts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """First turns as questions, assistant turns as answers, other later turns as comments on the question."""
    c = table(spark, sf, "conversations").withColumn("t0", F.min("turn").over(Window.partitionBy("conv_id")))
    q = c.where("turn = t0").select((F.col("conv_id") * 100).alias("id"), F.lit("question").alias("kind"), F.lit(None).cast("long").alias("parent_id"), F.col("text").alias("body"))
    a = c.where("turn > t0 AND role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn") + 1).alias("id"), F.lit("answer").alias("kind"), (F.col("conv_id") * 100).alias("parent_id"), F.col("text").alias("body"))
    m = c.where("turn > t0 AND role <> 'assistant'").select((F.col("conv_id") * 100 + F.col("turn") + 1).alias("id"), (F.col("conv_id") * 100).alias("post_id"), "text")
    return q.unionByName(a), m


@query(f"""WITH {CONV_SQL} SELECT 't' || (conv_id * 100) AS thread_id, 't' || (conv_id * 100) || CASE WHEN role = 'assistant' THEN '-a' ELSE '-c' END || (conv_id * 100 + turn + 1) AS source, 't' || (conv_id * 100) || '-q' AS target,
CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(the [a-z]+)') THEN 'challenge' WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(de [a-z]+)') THEN 'query' WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(der [a-z]+)') THEN 'clarify' WHEN role = 'assistant' THEN 'assert' ELSE 'comment-on' END AS edge_type,
CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(?:the|de|der) [a-z]+') THEN 'classical' ELSE 'structural' END AS detection FROM c WHERE turn > t0""")
def performative_edges(spark, sf):
    """Wiring edges with a bank of acts that this text shows."""
    q, m = conversation_posts(spark, sf)
    return T.wiring_edges(T.wiring_nodes(q, m), ACT_BANK).select("thread_id", "source", "target", "edge_type", "detection")


@query(f"""WITH {CONV_SQL}, e AS (SELECT conv_id, CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(?:the|de|der) [a-z]+') THEN 1 ELSE 0 END AS k FROM c WHERE turn > t0)
SELECT count(*) AS n_edges, count(*) FILTER (k = 1) AS n_classical, count(*) FILTER (k = 1) / count(*) AS classical_rate FROM e""")
def performative_summary(spark, sf):
    """G04, M02."""
    q, m = conversation_posts(spark, sf)
    return T.performative_summary(T.wiring_edges(T.wiring_nodes(q, m), ACT_BANK))


@query(f"""WITH {CONV_SQL}, n AS (SELECT conv_id, CASE WHEN turn = t0 THEN 'question' WHEN role = 'assistant' THEN 'answer' ELSE 'comment' END AS k FROM c)
SELECT 't' || (conv_id * 100) AS thread_id, count(*) AS n_nodes, count(*) - 1 AS n_edges, count(*) FILTER (k = 'answer') AS n_answers, count(*) FILTER (k = 'comment') AS n_comments FROM n GROUP BY 1""")
def diagram_stats(spark, sf):
    """Counts by thread."""
    q, m = conversation_posts(spark, sf)
    nodes = T.wiring_nodes(q, m)
    s = T.diagram_stats(nodes, T.wiring_edges(nodes, ACT_BANK))
    n = lambda k: F.coalesce(F.element_at("node_types", F.lit(k)), F.lit(0)).cast("long")
    return s.select("thread_id", "n_nodes", "n_edges", n("answer").alias("n_answers"), n("comment").alias("n_comments"))


@query(f"""WITH {CONV_SQL}, e AS (SELECT 't' || (conv_id * 100) AS thread_id, 't' || (conv_id * 100) || CASE WHEN role = 'assistant' THEN '-a' ELSE '-c' END || (conv_id * 100 + turn + 1) AS source, 't' || (conv_id * 100) || '-q' AS target, CASE WHEN role = 'assistant' THEN 'answer' ELSE 'comment' END AS source_type,
CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(the [a-z]+)') THEN 'challenge' WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(de [a-z]+)') THEN 'query' WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(der [a-z]+)') THEN 'clarify' WHEN role = 'assistant' THEN 'assert' ELSE 'comment-on' END AS act,
CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])(?:the|de|der) [a-z]+') THEN 'classical' ELSE 'structural' END AS detection FROM c WHERE turn > t0), n AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY source, target) - 1 AS n FROM e)
SELECT thread_id || ':edge-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS hx_id, 'thread/' || act AS hx_type, source, source_type, target, 'question' AS target_type, 'thread,' || act || ',' || detection AS labels FROM n""")
def hyperedge_records(spark, sf):
    """Hyperedges of threads, their ends laid open."""
    q, m = conversation_posts(spark, sf)
    nodes = T.wiring_nodes(q, m)
    h, end = T.hyperedges(T.wiring_edges(nodes, ACT_BANK), nodes), lambda i: F.get("ends", i)
    return h.select("hx_id", "hx_type", end(0)["ident"].alias("source"), end(0)["node_type"].alias("source_type"), end(1)["ident"].alias("target"), end(1)["node_type"].alias("target_type"), F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {CONV_SQL}, e AS (SELECT 't' || (conv_id * 100) || CASE WHEN role = 'assistant' THEN '-a' ELSE '-c' END || (conv_id * 100 + turn + 1) AS source, conv_id, turn, role FROM c WHERE turn > t0)
SELECT source, CASE WHEN turn % 2 = 1 THEN 'agree' WHEN role = 'assistant' THEN 'assert' ELSE 'comment-on' END AS edge_type, CASE WHEN turn % 2 = 1 THEN 'llm' ELSE 'structural' END AS detection, CASE WHEN turn % 2 = 1 THEN 'because of ' || turn ELSE '' END AS evidence FROM e""")
def merged_judgements(spark, sf):
    """Judged acts over found ones; acts that aren't valid change nothing."""
    q, m = conversation_posts(spark, sf)
    edges = T.wiring_edges(T.wiring_nodes(q, m), [("none", ["\\x00"])])
    turn = F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("long"), F.lit(100)) - 1
    judged = edges.select("source", "target", F.when(turn % 2 == 1, "agree").otherwise("nonsense").alias("edge_type"), F.concat(F.lit("because of "), turn.cast("string")).alias("reasoning"), F.lit(1).alias("seq"))
    return T.merge_judged_edges(edges, judged).select("source", "edge_type", "detection", "evidence")


@query("""WITH r AS (SELECT l_orderkey AS thread_id, l_orderkey * 10 + l_linenumber AS answer_id, max(l_quantity) AS score, bool_or(l_returnflag = 'R') AS accepted, l_linenumber AS seq FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY score DESC, seq) - 1 AS rank FROM r) SELECT thread_id, answer_id, CAST(rank AS INT) AS rank FROM k WHERE accepted""")
def accepted_rank(spark, sf):
    """Ranks of accepted answers."""
    return E.accepted_rank(ranked_answers(spark, sf))


def ranked_answers(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("score"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("acc"))
    return li.select(F.col("l_orderkey").alias("thread_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer_id"), "score", (F.col("acc") == 1).alias("accepted"), F.col("l_linenumber").alias("seq"))


@query("""WITH r AS (SELECT l_orderkey AS t, max(l_quantity) AS score, bool_or(l_returnflag = 'R') AS accepted, l_linenumber AS seq FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, seq) AS rank FROM r)
SELECT count(*) FILTER (accepted) AS threads, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (accepted) AS accuracy, avg(score) FILTER (accepted) AS mean_accepted, avg(score) FILTER (NOT accepted) AS mean_other FROM k""")
def ranking_summary(spark, sf):
    """G16, M03."""
    return E.ranking_summary(ranked_answers(spark, sf))


# texts -----------------------------------------------------------------------------------------------------------------

ENT = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
STRIP = "trim(regexp_replace(" + ENT.format("regexp_replace(html, '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
STRIP_DECODED = "trim(regexp_replace(regexp_replace(" + ENT.format("html") + ", '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {STRIP} AS text FROM pages")
def html_strip(spark, sf):
    """tags go first, entities after."""
    return table(spark, sf, "pages").select("page_id", X.strip_html("html").alias("text"))


@query(f"SELECT page_id, {STRIP_DECODED} AS text FROM pages")
def html_strip_decoded(spark, sf):
    """entities first."""
    return table(spark, sf, "pages").select("page_id", X.strip_html("html", decode_first=True).alias("text"))


@query("""WITH t AS (SELECT doc_id, text FROM documents), d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s)\\$\\$(.*?)\\$\\$', 1), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))) AS disp, list_transform(regexp_extract_all(text, '\\$([^\\$]+?)\\$', 1), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS inl FROM (SELECT doc_id, """ + ENT.format("text") + """ AS text FROM documents))
SELECT doc_id, len(disp) AS n_display, len(list_distinct(list_filter(inl, lambda s: s <> '' AND NOT list_contains(disp, s)))) AS n_inline FROM d WHERE len(disp) + len(inl) > 0""")
def latex_fragments(spark, sf):
    """display and inline fragments."""
    f = table(spark, sf, "documents").select("doc_id", X.latex_fragments("text").alias("f"), X.decode_entities("text").alias("t"))
    display = F.size(F.regexp_extract_all("t", F.lit(r"(?s)\$\$(.*?)\$\$"), 1))
    inline = F.size(F.regexp_extract_all("t", F.lit(r"\$([^\$]+?)\$"), 1))
    return f.where(display + inline > 0).select("doc_id", display.cast("long").alias("n_display"), (F.size("f") - display).cast("long").alias("n_inline"))


TOK = "list_filter(list_transform(regexp_split_to_array(lower({0}), '\\s+'), lambda w: regexp_replace(w, '^[.,;:!?()\\[\\]\"'']+|[.,;:!?()\\[\\]\"'']+$', '', 'g')), lambda w: w <> '')"
KERNEL_SQL = "k AS (SELECT DISTINCT w AS term_lower FROM (SELECT unnest(" + TOK.format("text") + ") AS w FROM benchmark) WHERE length(w) >= 5 AND substr(w, 1, 1) NOT IN ('$', '(', '\"', '-'))"


def word_kernel(spark, sf) -> DataFrame:
    w = table(spark, sf, "benchmark").select(F.explode(X.tokens("text")).alias("w"))
    return L.kernel(w.select(F.col("w").alias("term_lower"), F.col("w").alias("term"), F.col("w").alias("canon")), shortest=5)


def page_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), X.strip_html("html").alias("text"))


@query(f"WITH {KERNEL_SQL}, p AS (SELECT page_id, {STRIP} AS text FROM pages), h AS (SELECT DISTINCT page_id, w FROM (SELECT page_id, unnest({TOK.format('text')}) AS w FROM p) JOIN k ON w = term_lower) "
       "SELECT (SELECT count(*) FROM pages) AS texts, count(*) AS hits, count(DISTINCT page_id) AS covered, count(DISTINCT page_id) / (SELECT count(*) FROM pages) AS coverage FROM h")
def lexicon_coverage(spark, sf):
    """Flagship: F01, J10, G07: pages, stripped, spotted with a dictionary, counted."""
    t = page_texts(spark, sf)
    return L.coverage(t, L.spot(t, word_kernel(spark, sf)))


@query(f"WITH {KERNEL_SQL} SELECT DISTINCT doc_id AS id, w AS term_lower FROM (SELECT doc_id, unnest({TOK.format('text')}) AS w FROM documents) JOIN k ON w = term_lower")
def lexicon_single(spark, sf):
    """J10."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.spot(t, word_kernel(spark, sf)).select("id", "term_lower")


PHRASE_SQL = "w AS (SELECT list_filter(" + TOK.format("text") + ", lambda x: true) AS t FROM benchmark), k AS (SELECT DISTINCT t[1] || ' ' || t[2] AS term_lower FROM w WHERE len(t) > 1)"


@query(f"""WITH {PHRASE_SQL}, f AS (SELECT term_lower, coalesce(list_filter(string_split(term_lower, ' '), lambda x: length(x) >= 3)[1], string_split(term_lower, ' ')[1]) AS first_key FROM k WHERE length(term_lower) >= 3),
d AS (SELECT doc_id, lower(text) AS low, {TOK.format('text')} AS t FROM documents) SELECT doc_id AS id, term_lower FROM d JOIN f ON list_contains(t, first_key) AND contains(low, term_lower)""")
def lexicon_phrase(spark, sf):
    """Phrases by their first word, then as substrings."""
    w = table(spark, sf, "benchmark").select(X.tokens("text").alias("t")).where(F.size("t") > 1).select(F.concat_ws(" ", F.get("t", 0), F.get("t", 1)).alias("p"))
    terms = L.kernel(w.select(F.col("p").alias("term_lower"), F.col("p").alias("term"), F.col("p").alias("canon")))
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.spot(t, terms).select("id", "term_lower")


@query(f"WITH {KERNEL_SQL} SELECT DISTINCT w AS term FROM (SELECT unnest({TOK.format('text')}) AS w FROM documents) WHERE length(w) >= 5 AND w NOT IN (SELECT term_lower FROM k)")
def unknown_terms_anti(spark, sf):
    """J13, U14."""
    d = table(spark, sf, "documents").select(F.explode(X.tokens("text")).alias("term")).where(F.length("term") >= 5).distinct()
    return L.unknown(d, word_kernel(spark, sf).select(F.col("term_lower").alias("term")), "term")


@query(f"""WITH t AS (SELECT DISTINCT source AS pattern, w AS term FROM (SELECT source, unnest({TOK.format('text')}) AS w FROM documents)), n AS (SELECT count(DISTINCT pattern) AS n FROM t)
SELECT term, count(DISTINCT pattern) AS df, greatest(0.0, 1 - (count(DISTINCT pattern) - 1) / greatest(any_value(n) - 1, 1)) AS idf FROM t, n GROUP BY term""")
def term_idf(spark, sf):
    """G15."""
    return L.pattern_idf(table(spark, sf, "documents").select(F.col("source").alias("pattern"), F.explode(F.array_distinct(X.tokens("text"))).alias("term")))


@query("""WITH c AS (SELECT DISTINCT doc_id, lower(w) AS term, s AS source FROM (
SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS w, 'capital' AS s FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]{7,})\\.', 1)), 'final' FROM documents))
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS entities, count(*) + 0.5::DOUBLE * count(DISTINCT doc_id) + 0.2::DOUBLE * count(*) AS score FROM c GROUP BY term HAVING count(DISTINCT doc_id) >= 2""")
def open_term_scores(spark, sf):
    """G08."""
    return L.term_scores(open_candidates(spark, sf)).select("term", "occurrences", "entities", "score")


def open_candidates(spark, sf, context=None):
    d, context = table(spark, sf, "documents"), F.lit("") if context is None else context
    one = lambda p, g, s: d.select(F.col("doc_id").alias("entity_id"), F.posexplode(F.regexp_extract_all("text", F.lit(p), g)).alias("seq", "w"), "doc_id").select("entity_id", F.lower("w").alias("term"), F.lit(s).alias("source"), context.alias("context"), "seq")
    return one("[A-Z][a-z]{5,}", 0, "capital").union(one(r"([a-z]{7,})\.", 1, "final"))


@query("""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS l, 'capital' AS source FROM documents UNION ALL SELECT doc_id, regexp_extract_all(text, '([a-z]{7,})\\.', 1), 'final' FROM documents),
c AS (SELECT doc_id, source, lower(w) AS term, i - 1 AS seq, w || ' in ' || doc_id AS context FROM (SELECT doc_id, source, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM l)),
f AS (SELECT doc_id, source, term, min(seq) AS seq, arg_min(context, struct_pack(s := seq, c := context)) AS context FROM c GROUP BY ALL)
SELECT term, arg_min(context, struct_pack(s := seq, d := doc_id, t := source, c := context)) AS context FROM f GROUP BY term HAVING count(DISTINCT doc_id) >= 2""")
def first_examples(spark, sf):
    """Each discovered term with the context of its first example."""
    c = open_candidates(spark, sf, F.concat("w", F.lit(" in "), F.col("doc_id").cast("string")))
    return L.term_scores(c).select("term", "context")


@query(ORACLE["open_term_scores"] + " ORDER BY score DESC, entities DESC, occurrences DESC, term LIMIT 20")
def top_open_terms(spark, sf):
    """T05."""
    return L.top_terms(L.term_scores(open_candidates(spark, sf)), 20).select("term", "occurrences", "entities", "score")


@query(f"WITH s AS ({ORACLE['open_term_scores']}) SELECT count(*) AS terms, 0.0::DOUBLE AS phrase_share, 1.0::DOUBLE AS ready_share, count(*) AS ready FROM s")
def candidate_quality(spark, sf):
    """G18."""
    return E.candidate_quality(L.term_scores(open_candidates(spark, sf)))


@query("SELECT doc_id, 2.0::DOUBLE * (CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'der') AS INT)) AS score FROM documents")
def hotword_score(spark, sf):
    """F50."""
    return table(spark, sf, "documents").select("doc_id", X.hotword_score("text", ["License", "the", "der"]).alias("score"))


@query(f"""WITH x AS (SELECT doc_id, 2.0::DOUBLE * (CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'der') AS INT)) + 0.5::DOUBLE * len(list_intersect(list_distinct({TOK.format('text')}), ['the', 'that', 'is', 'de'])) AS score FROM documents) SELECT doc_id, score FROM x WHERE score >= 3.0""")
def rationale_score(spark, sf):
    """F51."""
    return table(spark, sf, "documents").select("doc_id", X.rationale_score("text", ["license", "der"], ["the", "that", "is", "de"], 3.0).cast("double").alias("score")).where("score IS NOT NULL")


@query("SELECT doc_id, trim(regexp_replace(lower(replace(regexp_replace(" + ENT.format("text") + ", '<[^>]+>', ' ', 'g'), '|', ' ')), '\\s+', ' ', 'g')) AS norm FROM documents")
def normalised_text(spark, sf):
    """F48."""
    return table(spark, sf, "documents").select("doc_id", X.normalise("text").alias("norm"))


@query("SELECT doc_id, substr(replace(replace(lower(text), ' ', '-'), '/', '-'), 1, 80) AS slug, md5(source) AS m, CAST(('0x' || right(md5(source), 2)) AS INT) AS bucket, 'expr:' || lang || ':' || substr(sha1(text), 1, 8) AS expr_id, substr(sha256(text), 1, 16) AS statement_hash, source || '::' || lang || '-' || substr(sha256(text), 1, 8) AS theorem_id FROM documents")
def identities(spark, sf):
    """F08, M05, M06, M07."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.slug("text").alias("slug"), F.md5(F.col("source").cast("binary")).alias("m"), N.subtype_bucket("source").alias("bucket"), N.expression_id("lang", "text").alias("expr_id"), N.statement_hash("text").alias("statement_hash"), N.theorem_id("source", F.lit(""), "lang", "text").alias("theorem_id"))


@query("SELECT DISTINCT 'se-' || split_part(regexp_extract(url, '://([^/]+)', 1), '.', 1) || '-' || page_id AS entity_id, page_id FROM pages")
def entity_ids(spark, sf):
    """P02."""
    return table(spark, sf, "pages").select(X.entity_id(F.regexp_extract("url", "://([^/]+)", 1), "page_id").alias("entity_id"), "page_id").distinct()


@query("""SELECT event_id, len(regexp_extract_all(s, 'd')) - len(regexp_extract_all(s, 'u')) AS rows, len(regexp_extract_all(s, 'r')) - len(regexp_extract_all(s, 'l')) AS cols FROM (SELECT event_id, event_type || props AS s FROM events)""")
def direction_codes(spark, sf):
    """F31."""
    d = table(spark, sf, "events").select("event_id", X.direction(F.concat("event_type", "props")).alias("d"))
    return d.select("event_id", F.col("d.rows").cast("long").alias("rows"), F.col("d.cols").cast("long").alias("cols"))


@query("""WITH c AS (SELECT doc_id, strpos(text, 'License') - 1 AS s, text FROM documents WHERE contains(text, 'License'))
SELECT doc_id, CASE WHEN s > 120 THEN '... ' ELSE '' END || trim(regexp_replace(substr(text, greatest(0, s - 120) + 1, s - greatest(0, s - 120)) || '<<License>>' || substr(text, s + 8, least(length(text), s + 7 + 120) - s - 7), '\\s+', ' ', 'g')) || CASE WHEN s + 7 + 120 < length(text) THEN ' ...' ELSE '' END AS context FROM c""")
def term_contexts(spark, sf):
    """F10."""
    c = table(spark, sf, "documents").where(F.col("text").contains("License")).withColumn("s", F.instr("text", "License") - 1)
    return c.select("doc_id", X.context("text", F.col("s"), F.col("s") + 7).alias("context"))


@query()
def discovered_terms(spark, sf):
    """Candidates of marked contexts, made plain."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    from threadloom import fixed_values as V0

    marked = S.span_rows(d, "text", S.introductions, S.INTRODUCTION, ["doc_id"]).select("doc_id", "raw")
    capitals = S.span_rows(d, "text", S.matches([("capitals", r"\b[A-Z][a-z]+(?: [a-z]+){1,2}")], 0), S.MATCH, ["doc_id"]).select("doc_id", F.col("match").alias("raw"))
    return marked.union(capitals).select("doc_id", X.discovered_term("raw", V0.DISCOVERY_STOPWORDS, V0.DISCOVERY_GENERIC).alias("term")).where("term IS NOT NULL").distinct()


@query()
def marks(spark, sf):
    """connectives, anaphora, labels and acts with positions."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    from threadloom import fixed_values as V0

    return S.span_rows(d, "text", S.matches([*V0.WIRES, *V0.PORTS, *V0.LABELS, *V0.ACTS]), S.MATCH, ["doc_id"])


@query()
def expression_surfaces(spark, sf):
    """formulas and their s-expressions."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return Y.parsed_expressions(d, keep=["doc_id"])


@query("SELECT page_id, len(regexp_extract_all(html, '<h1>')) AS heads, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links FROM pages")
def page_marks(spark, sf):
    """Counts of tags, without positions."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf, "pages").select("page_id", n("<h1>").alias("heads"), n("<p>").alias("paragraphs"), n('<a href="[^"]*"').alias("links"))


@query()
def page_wiring(spark, sf):
    """Scopes, connectives, anaphora, labels and links of whole pages, counted by type."""
    from threadloom import fixed_values as V0

    p = table(spark, sf, "pages")
    found = S.type_counts(p.select("page_id", X.strip_html("html").alias("text")), "text", [S.matches([*V0.WIRES, *V0.PORTS, *V0.LABELS]), S.typed_scopes()], ["page_id"])
    links = p.select("page_id", F.lit("link").alias("type"), F.regexp_count("html", F.lit('<a href="[^"]*"')).cast("long").alias("n")).where("n > 0")
    return found.union(links)


# sets and numbers ------------------------------------------------------------------------------------------------------


REPLY_SQL = f"""t AS (SELECT conv_id, turn, list_distinct({TOK.format('text')}) AS a FROM conversations), j AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)"""


def replies(spark, sf) -> DataFrame:
    """(conv_id, turn, a, b): distinct words of every turn and of the turn that follows it."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.tokens("text")).alias("a"))
    return t.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")


@query(f"""WITH {REPLY_SQL} SELECT conv_id, turn, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jaccard, len(list_intersect(a, b)) / len(a) AS precision, len(list_intersect(a, b)) / len(b) AS recall FROM j WHERE len(a) > 0 AND len(b) > 0""")
def set_similarity(spark, sf):
    """How alike a turn and its reply are."""
    j = replies(spark, sf).where("size(a) > 0 AND size(b) > 0").withColumn("pr", N.precision_recall("a", "b"))
    return j.select("conv_id", "turn", N.jaccard("a", "b").alias("jaccard"), F.col("pr.precision").alias("precision"), F.col("pr.recall").alias("recall"))


@query(f"""WITH {REPLY_SQL} SELECT conv_id, turn, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS rest FROM j WHERE b IS NOT NULL""")
def negative_space(spark, sf):
    """What a turn says and its reply doesn't."""
    return replies(spark, sf).select("conv_id", "turn", F.size(F.array_except("a", "b")).cast("long").alias("rest"))


@query("""SELECT event_type, list(n ORDER BY k) AS counts FROM (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def frequency_maps(spark, sf):
    """M13, G30."""
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    m = N.frequency_map(e, ["event_type"], "k")
    return m.select("event_type", F.transform(F.array_sort(F.map_entries("counts")), lambda x: x["value"]).alias("counts"))


@query("SELECT event_id, CASE WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'medium' WHEN value >= 10 THEN 'low-medium' ELSE 'low' END AS label, epoch_us(ts) / 86400e6 AS days, coalesce(value / nullif(event_id % 3, 0), 0.0) AS rate, [CAST(json_extract_string(props, '$.k') AS INT)] AS numbers FROM events")
def scalar_ladders(spark, sf):
    """M01, M02, M04, M10."""
    e = table(spark, sf, "events")
    return e.select("event_id", N.confidence("value").alias("label"), N.days(F.col("ts")).alias("days"), N.rate("value", F.pmod("event_id", F.lit(3))).alias("rate"), N.number_list(F.concat(F.lit("x ["), F.get_json_object("props", "$.k"), F.lit("]"))).alias("numbers"))


@query("SELECT event_id, props AS part, NULL::VARCHAR AS error FROM events")
def json_answers(spark, sf):
    """Objects out of free text."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("so: "), "props", F.lit(" and } more")).alias("t"))
    e = e.select("event_id", N.json_part("t").alias("part"))
    return e.select("event_id", "part", N.strict_object("part")["error"].alias("error"))


@query("SELECT metric, round(sum(value), 2) AS value FROM (SELECT o_orderstatus || '-rows' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus || '-total', sum(o_totalprice) FROM orders GROUP BY 1) GROUP BY 1")
def merged_stats(spark, sf):
    """shards' numbers added up."""
    from threadloom.plans.stages import merged_stats as merge

    o = table(spark, sf, "orders").withColumn("shard", F.pmod("o_orderkey", F.lit(4)))
    s = o.groupBy("shard", "o_orderstatus").agg(F.count("*").cast("double").alias("rows"), F.sum("o_totalprice").alias("total"))
    long = s.select(F.lit("run").alias("stage"), F.explode(F.array(F.struct(F.concat("o_orderstatus", F.lit("-rows")).alias("metric"), F.col("rows").alias("value")), F.struct(F.concat("o_orderstatus", F.lit("-total")).alias("metric"), F.col("total").alias("value")))).alias("p")).select("stage", "p.*")
    return merge(long).select("metric", F.round("value", 2).alias("value"))


# events ----------------------------------------------------------------------------------------------------------------

USES_SQL = "u AS (SELECT user_id, json_extract_string(props, '$.k') AS term, ts, event_id AS entry_id FROM events)"


def uses(spark, sf):
    return table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("term"), "ts", F.col("event_id").alias("entry_id"))


@query(f"WITH {USES_SQL} SELECT user_id, term, ts, entry_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id, term ORDER BY ts, entry_id) = 1")
def first_use_events(spark, sf):
    """W01."""
    return H.first_uses(uses(spark, sf))


VOCAB_SQL = f"WITH {USES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, term ORDER BY ts, entry_id) = 1 AS is_first FROM u) SELECT user_id, entry_id, ts, CAST(sum(CAST(is_first AS INT)) OVER (PARTITION BY user_id ORDER BY ts, entry_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS vocabulary FROM f"


@query(VOCAB_SQL)
def vocab_trajectory(spark, sf):
    """W02."""
    return H.vocabulary(uses(spark, sf))


@query(f"WITH v AS ({VOCAB_SQL}), l AS (SELECT user_id, max(vocabulary) AS v, count(*) AS n FROM v GROUP BY 1) SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS entries, avg(v) AS avg_final, max(v) AS max_final, (SELECT list_sort(list(v))[count(*) // 2 + 1] FROM l) AS median_final FROM l")
def vocab_report(spark, sf):
    """G24."""
    return H.vocabulary_report(H.vocabulary(uses(spark, sf)))


@query(f"""WITH {POSTS_SQL}, c AS (SELECT event_id * 7 % 150000 AS post_id, user_id, ts FROM events)
SELECT q.owner_id AS user_id, a.ts, 'answer_received' AS kind FROM posts a JOIN posts q ON a.parent_id = q.id WHERE q.owner_id <> a.owner_id
UNION ALL SELECT a.owner_id, a.ts, 'answer_accepted' FROM posts q JOIN posts a ON a.id = q.accepted_id AND a.kind = 'answer'
UNION ALL SELECT p.owner_id, c.ts, 'comment_received' FROM c JOIN posts p ON p.id = c.post_id WHERE p.owner_id <> c.user_id""")
def treatment_union(spark, sf):
    """J15."""
    c = table(spark, sf, "events").select(F.pmod(F.col("event_id") * 7, F.lit(150000)).alias("post_id"), "user_id", "ts")
    return H.treatments(posts(spark, sf), c)


@query("""WITH b AS (SELECT user_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1), d AS (SELECT user_id, lo, unnest(generate_series(0, (hi - lo) // 604800000000)) AS bin FROM b)
SELECT d.user_id, d.bin, count(e.event_id) AS n FROM d LEFT JOIN events e ON e.user_id = d.user_id AND (epoch_us(e.ts) - d.lo) // 604800000000 = d.bin GROUP BY 1, 2""")
def weekly_bins(spark, sf):
    """W07."""
    return H.weekly_bins(table(spark, sf, "events"))


@query()
def impulse_fits(spark, sf):
    """Mean-reverting fits of daily events with impulses."""
    e = table(spark, sf, "events")
    b = H.weekly_bins(e, days=1).withColumnRenamed("n", "x")
    t = H.weekly_bins(e.where("event_type = 'purchase'"), days=1).withColumnRenamed("n", "treated")
    return H.impulse_fit(b.join(t, ["user_id", "bin"], "left").fillna(0, ["treated"]))


# samples ---------------------------------------------------------------------------------------------------------------


@query("SELECT lang, doc_id, CAST(rank AS INT) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('13|' || lang || '|' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 20")
def stable_hash_sample(spark, sf):
    """W06."""
    return P.hash_sample(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 20, "13")


@query("SELECT stratum, doc_id, CAST(rank AS INT) AS rank FROM (SELECT CASE WHEN n_chars % 40 >= 20 THEN 'easy' WHEN n_chars % 40 >= 5 THEN 'medium' ELSE 'hard' END AS stratum, doc_id, row_number() OVER (PARTITION BY CASE WHEN n_chars % 40 >= 20 THEN 'easy' WHEN n_chars % 40 >= 5 THEN 'medium' ELSE 'hard' END ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 50")
def stratified_topk(spark, sf):
    """T03, T06."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", P.strata(F.pmod("n_chars", F.lit(40))).alias("stratum"))
    return P.stratified_top(d, "stratum", [F.desc("n_chars"), "doc_id"], 50).select("stratum", "doc_id", "rank")


@query("SELECT p_partkey, p_type, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 30 // 3 + 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def diversity_cap(spark, sf):
    """T04."""
    return P.capped_selection(table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice"), "p_type", "p_retailprice", "p_partkey", 30)


@query("SELECT DISTINCT p_type AS topic, p_partkey AS id FROM part WHERE p_size >= 10 AND p_type IN ('PROMO', 'SMALL')")
def eligible_questions(spark, sf):
    """P05."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("question").alias("kind"), F.col("p_size").alias("score"), F.lit(1).alias("answer_count"), F.array("p_type", "p_brand").alias("tags"))
    topics = spark.createDataFrame([("PROMO", "PROMO"), ("SMALL", "SMALL")], "topic string, tag string")
    return P.eligible_questions(p, topics, 10)


@query("""WITH a AS (SELECT p_partkey, p_size, p_retailprice, CAST(length(p_name) AS INT) AS p_width FROM part), x AS (SELECT *, 'p_size' AS criterion FROM a ORDER BY p_size DESC, p_partkey LIMIT 1),
y AS (SELECT *, 'p_retailprice' AS criterion FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM x) ORDER BY p_retailprice DESC, p_partkey LIMIT 1), z AS (SELECT *, 'p_width' AS criterion FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM x UNION SELECT p_partkey FROM y) ORDER BY p_width DESC, p_partkey LIMIT 1)
SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z""")
def showcase_picks(spark, sf):
    """T07."""
    return P.showcases(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("p_width")), "p_partkey", ["p_size", "p_retailprice", "p_width"])


# intervals -------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS pos, event_type FROM events)
SELECT user_id, event_id, pos, (SELECT arg_max(h.event_id, struct_pack(a := h.pos, b := h.event_id)) FROM e h WHERE h.user_id = e.user_id AND h.event_type = 'signup' AND h.pos <= e.pos) AS section FROM e WHERE event_type <> 'signup'""")
def enclosing_section(spark, sf):
    """The last heading at or before."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), "event_type")
    return I.enclosing(e.where("event_type <> 'signup'").drop("event_type"), e.where("event_type = 'signup'").select("user_id", "pos", F.col("event_id").alias("section")), "user_id", "section")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, CASE event_type WHEN 'purchase' THEN 'proof' ELSE event_type END AS env FROM events),
n AS (SELECT *, lead(env) OVER w AS ne, lead(s) OVER w AS ns FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s * 100000 + event_id))
SELECT user_id, event_id, CASE WHEN ne = 'proof' AND ns - s < 7200 THEN ns END AS proof_start FROM n""")
def next_proof(spark, sf):
    """A proof that follows at once."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"), F.when(F.col("event_type") == "purchase", "proof").otherwise(F.col("event_type")).alias("env"))
    b = e.withColumn("start", F.col("s") * 100000 + F.col("event_id")).withColumn("end", F.col("start"))
    # ids beyond 100,000 reach into the seconds of start, which therefore only orders; what it leaves open the ids decide
    order = Window.partitionBy("user_id").orderBy("start", "event_id")
    b = b.withColumn("gap", F.lead("s").over(order) - F.col("s"))
    out = I.next_proof(b, "user_id", gap="gap", most=7200, ties=("event_id",))
    return out.select("user_id", "event_id", F.when(F.col("proof_start").isNotNull(), F.col("s") + F.col("gap")).alias("proof_start"))


@query("""WITH p AS (SELECT user_id, epoch_us(ts) AS pos, event_id FROM events WHERE event_type = 'view'), w AS (SELECT user_id, epoch_us(ts) AS pos, event_id FROM events WHERE event_type = 'error'),
b AS (SELECT w.*, p.event_id AS src FROM w ASOF JOIN p ON w.user_id = p.user_id AND w.pos > p.pos), a AS (SELECT b.*, p.event_id AS dst FROM b ASOF JOIN p ON b.user_id = p.user_id AND b.pos < p.pos)
SELECT user_id, CAST(event_id AS VARCHAR) AS wire_id, CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target FROM a""")
def nearest_before_after(spark, sf):
    """Wires between components."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), "event_type")
    return I.between_neighbours(e.where("event_type = 'view'").select("user_id", "pos", F.col("event_id").alias("point_id")), e.where("event_type = 'error'").select("user_id", "pos", F.col("event_id").alias("wire_id")), "user_id")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS pos, event_type FROM events), r AS (SELECT user_id, pos AS s, pos + 36000000000 AS e, event_id AS idx FROM e WHERE event_type = 'signup')
SELECT p.user_id, p.event_id, p.pos, (SELECT arg_min(idx, struct_pack(a := s, b := e)) FROM r WHERE r.user_id = p.user_id AND r.s <= p.pos AND p.pos < r.e) AS idx FROM e p WHERE p.event_type = 'click'""")
def interval_parent(spark, sf):
    """The first range that holds a point."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), "event_type")
    r = e.where("event_type = 'signup'").select("user_id", F.col("pos").alias("start"), (F.col("pos") + 36000000000).alias("end"), F.col("event_id").alias("idx"))
    return I.first_containing(e.where("event_type = 'click'").drop("event_type"), r, "user_id", ["idx"])


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS pos, event_type FROM events), r AS (SELECT user_id, pos AS s, pos + 36000000000 AS e FROM e WHERE event_type = 'signup'), v AS (SELECT p.user_id, EXISTS (SELECT 1 FROM r WHERE r.user_id = p.user_id AND r.s <= p.pos AND p.pos < r.e) AS i FROM e p WHERE event_type = 'click')
SELECT user_id AS entity_id, count(*) AS variables, count(*) FILTER (i) AS scoped, count(*) FILTER (i) / count(*) AS rate FROM v GROUP BY 1""")
def scope_audit(spark, sf):
    """J23, G28."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), "event_type")
    return E.scope_audit(e.where("event_type = 'click'"), e.where("event_type = 'signup'").select("entity_id", F.col("pos").alias("start"), (F.col("pos") + 36000000000).alias("end")))


@query("SELECT event_id, user_id || ':scope-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS hx_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) - 1 AS n FROM events)")
def sequence_ids(spark, sf):
    """W05."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type")
    return I.sequence_ids(e, "user_id", ["event_type", "event_id"], "scope").select("event_id", "hx_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS number FROM events")
def environment_numbers(spark, sf):
    """W04."""
    e = I.numbered(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return e.select("event_id", F.col("number").cast("long").alias("number"))


# graphs ----------------------------------------------------------------------------------------------------------------

MENTION_SQL = "m AS (SELECT DISTINCT l_orderkey AS entity, 's' || l_suppkey AS term FROM lineitem)"
CO_SQL = f"{MENTION_SQL}, e AS (SELECT a.term AS src, b.term AS dst, count(*) AS n FROM m a JOIN m b ON a.entity = b.entity AND a.term <> b.term GROUP BY 1, 2 HAVING count(*) >= {{least}})"


def mentions(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("term"))


@query(f"WITH {CO_SQL.format(least=3)} SELECT src, dst, n FROM e")
def cooccurrence_graph(spark, sf):
    """J28."""
    return G.cooccurrence(mentions(spark, sf), 3, most_terms=None)


@query(f"""WITH {MENTION_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY term) AS k FROM m), t AS (SELECT entity, term FROM r WHERE k <= 4)
SELECT a.term AS src, b.term AS dst, count(*) AS n FROM t a JOIN t b ON a.entity = b.entity AND a.term <> b.term GROUP BY 1, 2 HAVING count(*) >= 3""")
def cooccurrence_first_terms(spark, sf):
    """J28 with the definition's limit of an entity's terms."""
    return G.cooccurrence(mentions(spark, sf), 3, most_terms=4)


@query(f"""WITH {MENTION_SQL}, d AS (SELECT term, count(DISTINCT entity) AS df FROM m GROUP BY 1 HAVING count(DISTINCT entity) >= 5 AND count(DISTINCT entity) <= 0.25 * (SELECT count(DISTINCT entity) FROM m)),
g AS (SELECT o_orderkey AS entity, o_orderpriority AS tag FROM orders), c AS (SELECT term, tag, count(DISTINCT entity) AS n FROM m JOIN g USING (entity) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, tag) AS r FROM c)
SELECT d.term, d.df, list(k.tag ORDER BY r) AS tags FROM d JOIN k ON d.term = k.term AND r <= 3 GROUP BY 1, 2""")
def term_profiles(spark, sf):
    """G23, G17."""
    tags = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("tag"))
    return G.term_profiles(mentions(spark, sf), tags, top=3)


TRADE_SQL = "e AS (SELECT DISTINCT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_quantity >= 49)"


def trade_edges(spark, sf):
    """Nations to suppliers to parts of large orders."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"))
    li = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return s.union(li).distinct()


@query(f"WITH RECURSIVE {TRADE_SQL}, r AS (SELECT 'n1' AS node, 0 AS distance UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 3) SELECT node, CAST(min(distance) AS INT) AS distance FROM r GROUP BY 1")
def k_hop(spark, sf):
    """V23."""
    return G.layers(trade_edges(spark, sf), "n1", 3)


@query(f"WITH RECURSIVE {TRADE_SQL}, r AS (SELECT 'n1' AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def reachable(spark, sf):
    """Reachability, layer by layer."""
    return G.reach(trade_edges(spark, sf), spark.createDataFrame([("n1",)], "node string"))


@query(f"""WITH {TRADE_SQL}, t AS (SELECT min(dst) AS t FROM e WHERE src IN (SELECT dst FROM e WHERE src = 'n1') AND dst LIKE 'p%')
SELECT * FROM (SELECT 0 AS step, 'n1' AS node UNION ALL SELECT 1, min(a.dst) FROM e a JOIN e b ON b.src = a.dst, t WHERE a.src = 'n1' AND b.dst = t.t UNION ALL SELECT 2, t FROM t) WHERE (SELECT t FROM t) IS NOT NULL""")
def shortest_path(spark, sf):
    """V22."""
    e = trade_edges(spark, sf)
    near = e.where("src = 'n1'").select(F.col("dst").alias("src"))
    target = e.join(near, "src").where("dst LIKE 'p%'").agg(F.min("dst")).first()[0]
    return G.shortest_path(e, "n1", target)


@query(f"""WITH {TRADE_SQL}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'p' || p_partkey FROM part)
SELECT node, CASE WHEN node NOT IN (SELECT dst FROM e) AND node NOT IN (SELECT src FROM e) THEN 'orphan' WHEN node NOT IN (SELECT dst FROM e) THEN 'root' WHEN node NOT IN (SELECT src FROM e) THEN 'sink' ELSE 'inner' END AS role FROM n""")
def flow_topology(spark, sf):
    """Roots, sinks, orphans."""
    return G.flow_topology(trade_nodes(spark, sf), trade_edges(spark, sf))


def trade_nodes(spark, sf):
    e = trade_edges(spark, sf)
    more = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node")).union(table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return e.select(F.col("src").alias("node")).union(e.select("dst")).union(more).distinct()


@query(f"WITH t AS ({ORACLE['flow_topology']}) SELECT count(*) FILTER (role = 'root') AS roots, count(*) FILTER (role = 'sink') AS sinks, count(*) FILTER (role = 'orphan') AS orphans, count(*) FILTER (role = 'root') > 0 AND count(*) FILTER (role = 'sink') > 0 AND count(*) FILTER (role = 'orphan') = 0 AS well_formed FROM t")
def well_formed(spark, sf):
    """V24 by the short rule of its SQL: a root, a sink and no orphan; flow_rules has the whole rules."""
    return G.role_counts(trade_nodes(spark, sf), trade_edges(spark, sf)).withColumn("well_formed", (F.col("roots") > 0) & (F.col("sinks") > 0) & (F.col("orphans") == 0))


@query(f"""WITH RECURSIVE t AS ({ORACLE['flow_topology']}), {TRADE_SQL}, r AS (SELECT node AS root, node FROM t WHERE role = 'root' UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node),
s AS (SELECT count(*) AS stuck FROM t WHERE role = 'root' AND node NOT IN (SELECT root FROM r JOIN t USING (node) WHERE role = 'sink')),
c AS (SELECT count(*) FILTER (role = 'root') AS roots, count(*) FILTER (role = 'sink') AS sinks, count(*) FILTER (role = 'orphan') AS orphans, count(*) AS n FROM t)
SELECT roots, sinks, orphans, stuck, roots + orphans > 0 AND sinks + orphans > 0 AND orphans <= n // 2 AND stuck <= (roots + orphans) // 2 AS well_formed FROM c, s""")
def flow_rules(spark, sf):
    """Well-formed by the rules on roots, sinks, orphans and reachability."""
    return G.well_formed(trade_nodes(spark, sf), trade_edges(spark, sf))


LINK_SQL = "l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"/]*)\"', 1)) AS target FROM pages), p AS (SELECT page_id, regexp_extract(html, '<a href=\"/([^\"/]*)\"', 1) AS name FROM pages)"


@query(f"""WITH {LINK_SQL}, n AS (SELECT DISTINCT lower(name) AS n FROM p WHERE name <> '')
SELECT DISTINCT lower(p.name) AS src, lower(l.target) AS dst FROM l JOIN p USING (page_id) WHERE lower(p.name) <> lower(l.target) AND lower(l.target) IN (SELECT n FROM n) AND lower(p.name) IN (SELECT n FROM n)""")
def wiki_link_graph(spark, sf):
    """Links between known pages."""
    p = table(spark, sf, "pages").select(F.regexp_extract("html", '<a href="/([^"/]*)"', 1).alias("name"), F.regexp_extract_all("html", F.lit('<a href="/([^"/]*)"'), 1).alias("links"))
    links = p.select(F.col("name").alias("source"), F.explode("links").alias("target"))
    return G.link_graph(p.where("name <> ''").select("name"), links)


@query("""WITH o AS (SELECT lower(w) AS k, min(w) AS object FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1), e AS (SELECT p_partkey AS id, p_brand AS title, string_split(p_name, ' ') AS d FROM part),
h AS (SELECT id, 0 AS r, object FROM e JOIN o ON lower(title) = k UNION ALL SELECT id, i, object FROM (SELECT id, unnest(d) AS x, generate_subscripts(d, 1) AS i FROM e) JOIN o ON lower(x) = k)
SELECT id AS entry_id, arg_min(object, r) AS object, CASE WHEN min(r) = 0 THEN 'title' ELSE 'defines' END AS match_type FROM h GROUP BY 1""")
def bridge_concepts(spark, sf):
    """J17."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.split("p_name", " ").alias("defines"))
    return G.bridges(p, p.select(F.explode("defines").alias("name")).distinct())


@query(f"WITH {MENTION_SQL}, q AS (SELECT l_orderkey AS t, 's' || l_suppkey AS term, l_returnflag = 'R' AS isq FROM lineitem) SELECT t AS thread_id, term FROM q GROUP BY 1, 2 HAVING bool_or(isq) AND bool_or(NOT isq)")
def question_bridges(spark, sf):
    """J29."""
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("thread_id"), F.when(F.col("l_returnflag") == "R", "question").otherwise("answer").alias("kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("term"))
    return G.question_bridges(m)


@query("""WITH l AS (SELECT DISTINCT page_id, lower(t) AS t FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"/]*)"', 1)) AS t FROM pages)), k AS (SELECT page_id, 'cat/the' AS pattern, 2 * count(*) AS s FROM l WHERE lower(t) IN ('the', 'and') GROUP BY 1 UNION ALL SELECT page_id, 'cat/der', 2 * count(*) FROM l WHERE lower(t) IN ('der') GROUP BY 1),
x AS (SELECT page_id, 'cat/the' AS pattern, CAST(regexp_matches(html, '(?i)ing[^a-z]') AS INT) + CAST(contains(lower(url), 'the') AS INT) * 3 AS s FROM pages UNION ALL SELECT page_id, 'cat/der', CAST(regexp_matches(html, '(?i)lich[^a-z]') AS INT) + CAST(contains(lower(url), 'der') AS INT) * 3 FROM pages)
SELECT page_id, pattern, CAST(sum(s) AS BIGINT) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM x) GROUP BY 1, 2 HAVING sum(s) >= CASE pattern WHEN 'cat/the' THEN 2 ELSE 1 END""")
def page_patterns(spark, sf):
    """F32: patterns of pages by links, texts and names, with a bank that these pages show."""
    p = table(spark, sf, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"/]*)"'), 1)).alias("target"), F.lit("link/definition-ref").alias("link_type"))
    bank = {"cat/the": (["The", "and"], ["ing[^a-z]"], 2), "cat/der": (["der"], ["lich[^a-z]"], 1)}
    return E.page_patterns(p.select("page_id", F.col("url").alias("name"), F.col("html").alias("content")), links, bank)


@query("SELECT DISTINCT a.p_type AS a, b.p_type AS b FROM part a JOIN part b ON a.p_brand = b.p_brand")
def pattern_cooccurrence(spark, sf):
    """J27."""
    return G.shared_instances(table(spark, sf, "part").select(F.col("p_type").alias("pattern"), F.col("p_brand").alias("instance")))


@query("SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) WHERE contains(lower(name), 'ring') ORDER BY lower(name) <> 'ring', name LIMIT 15")
def name_lookup(spark, sf):
    """F47."""
    return G.lookup(table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct(), "ring")


@query("SELECT c_nationkey AS k, coalesce(s, c) AS v FROM (SELECT c_nationkey, max(c_name) AS c FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey, max(s_name) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON c_nationkey = s_nationkey")
def kernel_merge(spark, sf):
    """J32."""
    under = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_name").alias("v"))
    over = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("v"))
    return L.merge_precedence(under, over, "k")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE tag NOT IN ('ring') GROUP BY 1 HAVING count(*) >= 5")
def tag_kernel(spark, sf):
    """G26."""
    return L.tag_kernel(table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("tag")), ["ring"])


@query("SELECT p_name AS term, list_sort(list(DISTINCT p_brand)) AS sources, list_sort(list(DISTINCT p_type)) AS kinds, CASE WHEN max(p_size) >= 40 THEN 'high' ELSE 'low' END AS confidence FROM part GROUP BY 1")
def domain_dictionary(spark, sf):
    """G25."""
    p = table(spark, sf, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("source"), F.col("p_name").alias("canonical"), F.col("p_type").alias("kind"), F.col("p_type").alias("domain"), F.col("p_size").cast("string").alias("code"), (F.col("p_size") >= 40).alias("structured"))
    return L.domain_dictionary(p).select("term", "sources", "kinds", "confidence")


@query("SELECT DISTINCT p_name AS term FROM part WHERE length(p_name) BETWEEN 3 AND 100 AND NOT regexp_matches(p_name, '^[\\d.\\s]+$') AND lower(p_name) NOT IN ('red ring') AND NOT contains(lower(p_name), 'widget')")
def useful_terms(spark, sf):
    """P09, P10."""
    return L.useful(table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct(), ["red ring"], bad_parts=["widget"])


@query(f"""WITH t AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{8,}}')) AS w FROM documents) GROUP BY 1, 2)
SELECT w AS token, CAST(sum(n) AS BIGINT) AS n, list_sort(list(doc_id))[1:2] AS samples FROM t GROUP BY 1""")
def token_samples(spark, sf):
    """G33."""
    return L.token_counts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "[A-Z][a-z]{8,}")


@query("""WITH l AS (SELECT DISTINCT p_brand AS page, p_type AS pattern FROM part), k AS (SELECT DISTINCT p_brand AS page, unnest(string_split(p_name, ' ')) AS term FROM part), n AS (SELECT pattern, count(*) AS instances FROM l GROUP BY 1),
c AS (SELECT pattern, term, count(*) AS c FROM l JOIN k USING (page) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY c DESC, term) AS r FROM c JOIN n USING (pattern))
SELECT pattern, any_value(instances) AS instances, list(term ORDER BY r) FILTER (r <= 10 AND c >= greatest(1.0, 0.1 * instances)) AS required, list(term ORDER BY r) FILTER (r <= 20 AND c >= greatest(1.0, 0.05 * instances)) AS typical FROM r GROUP BY 1""")
def reference_dictionary(spark, sf):
    """G14."""
    p = table(spark, sf, "part")
    return E.reference_dictionary(p.select(F.col("p_brand").alias("page"), F.col("p_type").alias("pattern")), p.select(F.col("p_brand").alias("page"), F.explode(F.split("p_name", " ")).alias("term")))


# wiring ----------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT 'p' || p_size AS source, 'o' || p_partkey AS out_id, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part WHERE p_type = 'PROMO'), i AS (SELECT 'q' || p_size AS target, 'i' || p_partkey AS in_id, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part WHERE p_type = 'SMALL'),
s AS (SELECT source, target, out_id, in_id, round(count(*) + 0.5::DOUBLE * count(*) FILTER (o.w IN ('red', 'ring')), 2) AS score FROM o JOIN i ON o.w = i.w AND substr(source, 2) = substr(target, 2) GROUP BY 1, 2, 3, 4)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY score DESC, out_id, in_id) <= 3""")
def port_matching(spark, sf):
    """J20."""
    p = table(spark, sf, "part")
    o = p.where("p_type = 'PROMO'").select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("node_id"), F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("hx_id"), F.col("p_name").alias("label"))
    i = p.where("p_type = 'SMALL'").select(F.concat(F.lit("q"), F.col("p_size").cast("string")).alias("node_id"), F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("hx_id"), F.col("p_name").alias("label"))
    pairs = o.select(F.col("node_id").alias("source"), F.concat(F.lit("q"), F.substring("node_id", 2, 9)).alias("target")).distinct()
    return Y.match_ports(o, i, pairs, spark.createDataFrame([("red",), ("ring",)], "term string"), top=3)


@query("""WITH h AS (SELECT user_id AS node_id, event_type AS type, event_id AS position FROM events), g AS (SELECT node_id, type, count(*) AS c, min(position) AS p FROM h GROUP BY 1, 2)
SELECT CAST(n.c_custkey AS BIGINT) AS node_id, coalesce((SELECT type FROM g WHERE g.node_id = n.c_custkey ORDER BY c DESC, p LIMIT 1), CASE WHEN n.c_custkey % 2 = 0 THEN 'clarify' ELSE 'assert' END) AS act FROM customer n""")
def dominant_acts(spark, sf):
    """F14."""
    h = table(spark, sf, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("type"), F.col("event_id").alias("position"))
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 2 == 0, "comment").otherwise("answer").alias("node_type"))
    return Y.dominant_act(h, n)


@query("""WITH t(a) AS (VALUES ('bind/let'), ('bind/define'), ('assume/explicit'), ('quant/universal'), ('constrain/where'), ('env/theorem'))
SELECT s.a AS source, t.a AS target, s.a = t.a OR CASE split_part(s.a, '/', 1) WHEN 'bind' THEN split_part(t.a, '/', 1) IN ('bind', 'assume', 'constrain') WHEN 'assume' THEN split_part(t.a, '/', 1) IN ('assume', 'constrain') WHEN 'constrain' THEN split_part(t.a, '/', 1) IN ('constrain', 'quant') WHEN 'quant' THEN split_part(t.a, '/', 1) IN ('quant', 'constrain') ELSE false END AS ok FROM t s, t""")
def port_compat(spark, sf):
    """V28."""
    kinds = ["bind/let", "bind/define", "assume/explicit", "quant/universal", "constrain/where", "env/theorem"]
    pairs = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "source string, target string")
    return pairs.withColumn("ok", E.port_compatible(F.col("source"), F.col("target")))


@query("""WITH n AS (SELECT p_partkey AS node_id, p_type AS pattern, p_name AS text FROM part), l AS (SELECT DISTINCT p_type AS pattern, 'red' AS term, 'required' AS kind FROM part UNION ALL SELECT DISTINCT p_type, 'ring', 'typical' FROM part UNION ALL SELECT DISTINCT p_type, 'blue', 'required' FROM part WHERE p_type <> 'PROMO')
SELECT node_id, n.pattern, 0.7::DOUBLE * coalesce(avg(CAST(contains(lower(text), term) AS INT)) FILTER (kind = 'required'), 1) + 0.3::DOUBLE * coalesce(avg(CAST(contains(lower(text), term) AS INT)) FILTER (kind = 'typical'), 1) AS completeness FROM n LEFT JOIN l USING (pattern) GROUP BY 1, 2""")
def node_completeness(spark, sf):
    """V29."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("pattern"), F.col("p_name").alias("text"))
    t = p.select("pattern").distinct()
    links = t.select("pattern", F.lit("red").alias("term"), F.lit("required").alias("kind")).union(t.select("pattern", F.lit("ring"), F.lit("typical"))).union(t.where("pattern <> 'PROMO'").select("pattern", F.lit("blue"), F.lit("required")))
    return E.node_completeness(p, links)


@query("""WITH e AS (SELECT l_orderkey AS thread_id, l_returnflag, l_linestatus, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'bind/let' ELSE 'assume/explicit' END AS s, CASE l_linestatus WHEN 'O' THEN 'env/theorem' ELSE 'constrain/where' END AS t FROM lineitem),
c AS (SELECT thread_id, avg(CASE WHEN l_linenumber > 3 THEN 1.0::DOUBLE ELSE 0 END) AS cr, avg(CASE WHEN t = 'constrain/where' OR (s = 'assume/explicit' AND t = 'env/theorem') THEN 1.0::DOUBLE ELSE 0 END) AS pr, avg(CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS ar FROM e GROUP BY 1)
SELECT thread_id, round(cr, 9) AS categorical_rate, round(pr, 9) AS port_rate, round(ar, 9) AS act_rate, round((cr + pr + ar + 0.5) / 4, 9) AS overall FROM c""")
def wiring_verification(spark, sf):
    """V27, V30."""
    li = table(spark, sf, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("thread_id"), F.lit("assert").alias("edge_type"), F.when(F.col("l_returnflag") == "R", "bind/let").otherwise("assume/explicit").alias("source_type"), F.when(F.col("l_linestatus") == "O", "env/theorem").otherwise("constrain/where").alias("target_type"), E.act_fits(F.lit("assert"), F.array(F.lit("query")), F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("wire/causal"))).otherwise(F.array(F.lit("wire/intuitive"))), F.lit("so"), F.lit("answer")).alias("fits"), E.category_consistent(F.array(F.when(F.col("l_linenumber") > 3, "x").otherwise("y")), F.array(F.lit("z")), F.array(F.lit("x|z"))).alias("consistent"))
    nodes = li.select(F.col("l_orderkey").alias("thread_id"), F.lit(0.5).alias("completeness"))
    known = spark.createDataFrame([("assume/explicit", "env/theorem")], "a string, b string")
    v = E.verify_wiring(edges, nodes, known)
    return v.select("thread_id", *[F.round(c, 9).alias(c) for c in ("categorical_rate", "port_rate", "act_rate", "overall")])


@query("""SELECT coalesce(a.k, b.k) AS kind, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, coalesce(a.n, 0) * 1000.0::DOUBLE / 50000 AS density_a, coalesce(b.n, 0) * 1000.0::DOUBLE / 20000 AS density_b
FROM (SELECT source AS k, count(*) AS n FROM documents WHERE lang = 'en' AND source <> 'src3' GROUP BY 1) a FULL JOIN (SELECT source AS k, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1) b ON a.k = b.k""")
def signature_delta(spark, sf):
    """G27."""
    d = table(spark, sf, "documents").withColumnRenamed("source", "kind")
    return E.signature_delta(d.where("lang = 'en' AND kind <> 'src3'").select("kind"), d.where("lang = 'de'").select("kind"), "kind", 50000, 20000)


@query("SELECT count(*) AS graphs, avg(n) AS mean_n_nodes, median(n) AS median_n_nodes, quantile_cont(n, 0.95) AS p95_n_nodes, avg(e) AS mean_n_edges, median(e) AS median_n_edges, quantile_cont(e, 0.95) AS p95_n_edges, count(*) FILTER (n = 0) AS empty FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1)")
def graph_quality(spark, sf):
    """G21."""
    return E.quality_summary(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.count("*").alias("n_nodes"), F.countDistinct("l_suppkey").alias("n_edges")))


@query("SELECT * FROM (VALUES ('parse', 'pass'), ('assembly', 'fail'), ('backed', 'pass'), ('scope_coverage', 'pass'), ('empty_rate', 'warn'), ('ready_terms', 'warn')) t(gate, status)")
def gates(spark, sf):
    """P17, P18."""
    one = spark.createDataFrame([(0.9, 0.9, 3, 0.06, 0.1, 12)], "parse_rate double, assembly_rate double, backed_edges int, scope_coverage double, empty_rate double, ready_terms int")
    return E.health_gates(one).union(E.internal_gates(one))


@query("SELECT event_type AS label, count(*) AS hits, count(DISTINCT user_id) AS entities, round(avg(value), 6) AS mean_confidence FROM events GROUP BY 1")
def hit_summary(spark, sf):
    """G19."""
    h = E.hit_summary(table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("label"), F.col("value").alias("confidence")))
    return h.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("SELECT CAST(user_id AS VARCHAR) AS dimension, count(*) FILTER (event_type = 'view') AS good, count(*) FILTER (event_type = 'click') AS weak, count(*) FILTER (event_type = 'purchase') AS broken, count(*) FILTER (event_type = 'error') AS parse_error FROM events GROUP BY 1")
def response_quality(spark, sf):
    """G30."""
    status = F.element_at(F.create_map(*map(F.lit, ("view", "good", "click", "weak", "purchase", "broken", "error", "parse_error", "signup", "other"))), F.col("event_type"))
    return E.response_quality(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("dimension"), status.alias("status")))


@query("""SELECT source AS route, count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'and')) AS english, count(*) FILTER (contains(lower(text), 'der') OR contains(lower(text), 'und')) AS german,
CASE WHEN greatest(count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'and')), count(*) FILTER (contains(lower(text), 'der') OR contains(lower(text), 'und'))) = 0 THEN 0 ELSE least(count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'and')), count(*) FILTER (contains(lower(text), 'der') OR contains(lower(text), 'und'))) / greatest(count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'and')), count(*) FILTER (contains(lower(text), 'der') OR contains(lower(text), 'und'))) END AS balance FROM documents GROUP BY 1""")
def route_balance(spark, sf):
    """G31."""
    return E.route_balance(table(spark, sf, "documents").select(F.col("source").alias("route"), "text"), {"english": ["the", "and"], "german": ["der", "und"]})


@query("""WITH o AS (SELECT l_partkey AS paper_id, l_suppkey AS query_id, max(l_tax) AS w, list(DISTINCT l_returnflag) AS g FROM lineitem GROUP BY 1, 2)
SELECT paper_id, list_sort(list(query_id)) AS queries, list_sort(list_distinct(flatten(list(g)))) AS gaps, round(sum(w), 6) AS score FROM o GROUP BY 1""")
def search_merge(spark, sf):
    """G32."""
    r = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("query_id"), F.col("l_returnflag").alias("gap"), F.col("l_tax").alias("weight"))
    return E.search_merge(r).withColumn("score", F.round("score", 6))


@query("""WITH n AS (SELECT doc_id AS id, n_chars AS score, lower(text) AS b FROM (SELECT doc_id, n_chars, trim(regexp_replace(replace(regexp_replace(""" + ENT.format("text") + """, '<[^>]+>', ' ', 'g'), '|', ' '), '\\s+', ' ', 'g')) AS text FROM documents)),
x AS (SELECT id, score, CAST(regexp_matches(b, '(^|[^a-z0-9])license([^a-z0-9]|$)') AS INT) + CAST(regexp_matches(b, '(^|[^a-z0-9])version([^a-z0-9]|$)') AS INT) AS terms, regexp_matches(b, '(^|[^a-z0-9])apache([^a-z0-9]|$)') AS anchored FROM n)
SELECT 'legal' AS track, id, CAST(terms AS INT) AS terms, terms >= 2 AS strong, anchored, CAST(row_number() OVER (ORDER BY terms DESC, score DESC, id) AS INT) AS rank FROM x WHERE terms >= 1 QUALIFY rank <= 10""")
def keyword_tracks(spark, sf):
    """G29, F49, T06."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("body"), F.col("n_chars").alias("score"))
    return E.keyword_tracks(d, {"legal": ["license", "version"]}, ["apache"], 10).select("track", "id", "terms", "strong", "anchored", "rank")


@query(f"""WITH {MENTION_SQL}, d AS (SELECT term, count(DISTINCT entity) AS df FROM m GROUP BY 1 HAVING count(DISTINCT entity) BETWEEN 2 AND 600), t AS (SELECT p_partkey AS paper_id, 's' || (p_partkey % 90) || ' ' || p_name AS text FROM part), r AS (SELECT d.term, count(DISTINCT paper_id) AS raw FROM d JOIN t ON contains(lower(t.text), d.term) GROUP BY 1)
SELECT d.term, d.df AS processed, coalesce(raw, 0) AS raw, d.df / greatest(coalesce(raw, 0), 1) AS lift FROM d LEFT JOIN r USING (term)""")
def concept_probe(spark, sf):
    """V32, G17."""
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.concat(F.lit("s"), F.pmod("p_partkey", F.lit(90)).cast("string"), F.lit(" "), "p_name").alias("text"))
    return E.concept_probe(mentions(spark, sf).withColumnRenamed("entity", "paper_id"), t, 2, 600)


@query("""WITH p AS (SELECT p_partkey AS id, p_type AS c, list_distinct(string_split(p_name, ' ')) AS s FROM part ORDER BY sha256('13|' || p_partkey), p_partkey LIMIT 800),
j AS (SELECT a.id, b.id AS nb, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS jaccard, a.c = b.c AS same FROM p a JOIN p b ON a.id <> b.id AND len(list_intersect(a.s, b.s)) > 0)
SELECT id AS paper_id, nb AS neighbour, jaccard, same AS same_category FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, nb) = 1""")
def scope_neighbours(spark, sf):
    """V31."""
    return E.scope_neighbours(table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_type").alias("category"), F.split("p_name", " ").alias("scopes")))


# vectors ---------------------------------------------------------------------------------------------------------------

DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
KNN_SQL = f"s AS (SELECT q.vec_id AS query_id, v.vec_id, round({DOT.format('q.embedding', 'v.embedding')}, 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"


def knn_scores(spark, sf):
    """Products of the stated queries, ids divisible by 100, with all other vectors."""
    v = table(spark, sf, "embeddings")
    s = V.query_scores(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    return s.withColumn("score", F.round("score", 9))


@query(f"WITH {KNN_SQL} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s WHERE score >= 0.1 QUALIFY rank <= 10")
def topk_similar(spark, sf):
    """T01, T02, J31, V19, W08."""
    return V.top_k(knn_scores(spark, sf), 10, 0.1)


@query(f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({DOT.format('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a JOIN embeddings b ON a.label = 0 AND b.label <> 0 WHERE {DOT.format('a.embedding', 'b.embedding')} >= 0.3")
def cross_match(spark, sf):
    """J19."""
    v = table(spark, sf, "embeddings")
    return V.cross_matches(v.where("label = 0"), v.where("label <> 0"), 0.3).withColumn("score", F.round("score", 9))


@query(f"""WITH {KNN_SQL}, r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS acc_at_1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS acc_at_5, round(avg(1.0::DOUBLE / rank), 9) AS mrr FROM r WHERE vec_id = query_id + 1""")
def knn_eval(spark, sf):
    """V14."""
    s = knn_scores(spark, sf)
    truth = s.where("vec_id = query_id + 1").select("query_id", "vec_id")
    return V.retrieval_metrics(s, truth).withColumn("mrr", F.round("mrr", 9))


@query(f"WITH {KNN_SQL}, r AS (SELECT query_id, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10) SELECT query_id, avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0 END) AS agreement FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = r.vec_id GROUP BY 1")
def neighbour_label_agreement(spark, sf):
    """G22."""
    v = table(spark, sf, "embeddings")
    return V.label_agreement(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label"))


@query(f"SELECT (SELECT count(*) FROM embeddings) AS n, round(avg({DOT.format('a.embedding', 'b.embedding')} / sqrt({DOT.format('a.embedding', 'a.embedding')}) / sqrt({DOT.format('b.embedding', 'b.embedding')})), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id")
def embedding_health(spark, sf):
    """The mean off-diagonal cosine, from sums."""
    return V.mean_cosine(table(spark, sf, "embeddings")).withColumn("mean_cosine", F.round("mean_cosine", 6))


@query()
def effective_dimensions(spark, sf):
    """Dimensions for 90 and 95 % of the variance."""
    a, b = V.effective_dimensions(table(spark, sf, "embeddings"))
    return spark.createDataFrame([(a, b)], "d90 int, d95 int")


@query()
def vector_clusters(spark, sf):
    """Cosine k-means."""
    v = table(spark, sf, "embeddings")
    return V.kmeans(v, V.cluster_count(v.count()))[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {KNN_SQL} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10")
def probed_neighbours(spark, sf):
    """Inverted lists: cells by centroid, the best min(10, cells) probed, which here are all."""
    v = table(spark, sf, "embeddings")
    _, centres = V.kmeans(v, 8, steps=5)
    found = V.probe_search(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), centres, 10)
    return found.withColumn("score", F.round("score", 9))


@query()
def text_vectors(spark, sf):
    """Hashed text vectors."""
    return V.hashed_text_vectors(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"), "text"))


@query()
def thread_hypergraphs(spark, sf):
    """Nodes and edges of conversations, counted."""
    q, m = conversation_posts(spark, sf)
    n = T.wiring_nodes(q, m)
    # read six times below, so written once
    n = written(n, "nodes")
    e = T.wiring_edges(n, ACT_BANK)
    p = dealt(n.select(F.col("thread_id").alias("graph_id"), F.col("node_id").alias("post_id"), F.col("node_type").alias("subtype"), F.lit(0).alias("score"), "text"))
    spotted = L.spot(p.select(F.col("post_id").alias("id"), "text"), word_kernel(spark, sf)).join(p.select("graph_id", F.col("post_id").alias("id")), "id").select("graph_id", F.col("id").alias("post_id"), "term", "canon")
    keep = ["graph_id", "post_id"]
    found = S.span_rows(p, "text", S.scopes(), S.SCOPE, keep).withColumn("hx_id", F.concat("post_id", F.lit(":scope-"), F.format_string("%03d", "seq")))
    from threadloom import fixed_values as V0

    signs = S.span_rows(p, "text", S.matches([*V0.WIRES, *V0.PORTS, *V0.LABELS]), S.MATCH, keep).withColumn("hx_id", F.concat_ws(":", "post_id", "type", F.col("position").cast("string"))).withColumn("role", F.split_part("type", F.lit("/"), F.lit(1)))
    none = p.select("graph_id", "post_id", F.lit("").alias("concept"), F.lit(0.0).alias("score")).where(F.lit(False))
    nodes, edges = Y.assemble(p, e.select(F.col("thread_id").alias("graph_id"), "source", "target", F.col("edge_type").alias("act")), spotted, found, signs, none, Y.parsed_expressions(p))
    return Y.graph_stats(nodes, edges)


@query()
def graph_embeddings(spark, sf):
    """One relational layer over order graphs, pooled."""
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    nodes = li.select(F.col("l_orderkey").alias("graph_id"), name.alias("id"), F.lit("term").alias("type"), name.alias("subtype")).union(li.select("l_orderkey", F.lit("post"), F.lit("post"), F.lit("question"))).distinct()
    edges = li.select(F.col("l_orderkey").alias("graph_id"), F.lit("mention").alias("type"), F.array(F.lit("post"), name).alias("ends")).distinct()
    feats, e = V.graph_features(nodes, edges, ["post", "term", "expression", "scope"])
    states = feats.select("graph_id", "node", F.array(F.col("type_idx").cast("double"), F.col("bucket") / 255.0, F.lit(1.0)).alias("h"))
    w = [[0.5, 0.1, 0.2], [0.0, 1.0, -0.3], [0.3, -0.2, 0.4]]
    return V.pooled(V.message_pass(states, e, {"mention": w}, w, [0.1, 0.0, 0.1]))


@query("""SELECT * FROM (VALUES ('X(\\gamma):=\\mathrm{id}_{X(v)}', '(:= (X γ) (sub id (X v)))'), ('\\frac{a}{b}', '(/ a b)'), ('a \\leq b', 'a'), ('', '""')) t(latex, sexp)""")
def formula_records(spark, sf):
    """s-expressions of formulas held in a table."""
    d = spark.createDataFrame([(r"X(\gamma):=\mathrm{id}_{X(v)}",), (r"\frac{a}{b}",), (r"a \leq b",), ("",)], "latex string")
    return d.select("latex", to_sexp("latex").alias("sexp"))


# the other modules of queries register theirs here
from threadloom import file_queries as _files  # noqa: E402,F401
from threadloom import text_queries as _texts  # noqa: E402,F401
