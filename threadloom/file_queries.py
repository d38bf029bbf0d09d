"""Registered queries of sources, sinks and stages: the driver's tables are written in a source's form, and read back.

Each writes below the shared folder, under a name of its own, and is held against SQL on the table it came from.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from threadloom.operators import sampling as P
from threadloom.operators import threads as T
from threadloom.plans import stages as A
from threadloom.plans.tables import shared_folder
from threadloom.queries import CONV_SQL, POSTS_SQL, conversation_posts, posts, query, table
from threadloom.sources import dumps as D
from threadloom.sources import files as R
from threadloom.sources import sinks as K
from threadloom.sources.fetch import put
from threadloom.streaming import watch as W


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def element(tag: str, **attributes: Column) -> Column:
    """An XML element without content; null attributes are left out."""
    escaped = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat_ws(" ", F.lit(f"  <{tag}"), *[F.concat(F.lit(f'{k}="'), escaped(c), F.lit('"')) for k, c in attributes.items()], F.lit("/>"))


def nations(spark: SparkSession, sf: str) -> list:
    return table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 by definition of the table


# dumps -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {POSTS_SQL} SELECT id, kind, parent_id, accepted_id, score, CASE kind WHEN 'question' THEN 'Title "' || id || '"' ELSE '' END AS title, body || ' & <b> $x_' || id || '$' AS text,
CASE kind WHEN 'question' THEN 'a,b-' || body ELSE '' END AS tags, 'x_' || id AS latex, owner_id FROM posts""")
def posts_xml(spark, sf):
    """Posts out of XML rows, split across tasks."""
    p, path = posts(spark, sf), place(spark, "posts")
    asked = F.col("kind") == "question"
    body = F.concat(F.lit("<p>"), "body", F.lit(" &amp; &lt;b&gt; $x_"), F.col("id").cast("string"), F.lit("$</p>"))
    title = F.when(asked, F.concat(F.lit('Title "'), F.col("id").cast("string"), F.lit('"')))
    row = element("row", Id=F.col("id"), PostTypeId=F.when(asked, 1).otherwise(2), ParentId=F.col("parent_id"), AcceptedAnswerId=F.col("accepted_id"), Score=F.col("score"), Title=title, Body=body, Tags=F.when(asked, F.concat(F.lit("|a|b-"), "body", F.lit("|"))), OwnerUserId=F.col("owner_id"))
    other = element("row", Id=F.lit(0), PostTypeId=F.lit(5))
    p.select(row).union(spark.range(1).select(other)).write.text(path)
    return D.posts(spark, path).select("id", "kind", "parent_id", "accepted_id", "score", "title", "text", F.array_join("tags", ",").alias("tags"), F.array_join("latex", ",").alias("latex"), "owner_id")


@query(f"WITH {POSTS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN -score ELSE score END AS score FROM posts")
def latest_posts(spark, sf):
    """One post for each id, the last."""
    p = posts(spark, sf).select("id", "score", "seq")
    return T.last_by_id(p.union(p.where("id % 3 = 0").select("id", -F.col("score"), F.col("seq") + 1))).select("id", "score")


@query("SELECT event_id AS id, event_id * 7 % 150000 AS post_id, CAST(floor(value) AS INT) AS score, props || ' <&>' AS text, user_id FROM events")
def comments_xml(spark, sf):
    """Comments out of XML rows."""
    path = place(spark, "comments")
    e = table(spark, sf, "events")
    e.select(element("row", Id=F.col("event_id"), PostId=F.pmod(F.col("event_id") * 7, F.lit(150000)), Score=F.floor("value"), Text=F.concat("props", F.lit(" <&>")), UserId=F.col("user_id"))).write.text(path)
    return D.comments(spark, path).select("id", "post_id", "score", "text", "user_id")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS post_id, props AS text FROM events WHERE event_type IN ('view', 'click') AND event_id % 5 > 0")
def history_xml(spark, sf):
    """First texts and edits of bodies by known users, out of XML rows."""
    path = place(spark, "history")
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "2").when(F.col("event_type") == "click", "5").otherwise("4")
    e.select(element("row", Id=F.col("event_id"), PostHistoryTypeId=kind, UserId=F.when(F.col("event_id") % 5 > 0, F.col("user_id")), PostId=F.col("event_id"), Text=F.col("props"))).write.text(path)
    return D.history(spark, path).select("user_id", "post_id", "text")


@query("SELECT 'arxiv-a/' || doc_id AS entity_id, source AS title, source AS question_text, md5(text) AS answer, lang || ',x' AS tags FROM documents")
def metadata_json(spark, sf):
    """Paper records of JSON lines; a line that isn't JSON goes."""
    path = place(spark, "metadata")
    d = table(spark, sf, "documents")
    made = d.select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.array("lang", F.lit("x")).alias("categories"))
    made.select(F.to_json(F.struct("*"))).union(spark.range(1).select(F.lit("{broken"))).write.text(path)
    return D.paper_metadata(spark, path).where("entity_id IS NOT NULL").select("entity_id", "title", "question_text", F.md5(F.col("answer_text").cast("binary")).alias("answer"), F.array_join("tags", ",").alias("tags"))


THREAD_SQL = f"""WITH {CONV_SQL} SELECT conv_id * 100 AS id, 'T' || conv_id AS title, md5(any_value(text) FILTER (turn = t0)) AS body, count(*) FILTER (turn > t0 AND role = 'assistant') AS n_answers, count(*) FILTER (turn > t0 AND role <> 'assistant') AS n_comments FROM c GROUP BY conv_id"""


def thread_lines(spark, sf) -> DataFrame:
    """Threads of conversations as JSON: question, answers and comments nested."""
    q, m = conversation_posts(spark, sf)
    a = q.where("kind = 'answer'").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "body", F.lit(1).alias("score")))).alias("answers"))
    c = m.groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "post_id", F.lit(0).alias("score"), "text"))).alias("question"))
    t = q.where("kind = 'question'").select("id", "body").join(a, "id", "left").join(c.select("id", F.struct("question").alias("comments")), "id", "left")
    return t.select(F.to_json(F.struct("id", F.concat(F.lit("T"), (F.col("id") / 100).cast("long").cast("string")).alias("title"), "body", F.lit(3).alias("score"), F.lit("x.org").alias("site"), "answers", "comments")).alias("value"))


def thread_summary(t: DataFrame) -> DataFrame:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return t.select("id", "title", F.md5(F.col("body").cast("binary")).alias("body"), n("answers").alias("n_answers"), n("comments").alias("n_comments"))


@query(THREAD_SQL)
def threads_json(spark, sf):
    """Threads of JSON lines with answers and comments."""
    path = place(spark, "threads")
    thread_lines(spark, sf).write.text(path)
    return thread_summary(D.json_threads(spark, path))


@query(f"WITH t AS ({THREAD_SQL}) SELECT id, rank FROM (SELECT id, CAST(row_number() OVER (ORDER BY sha256('7|x.org|' || id), id) AS INT) AS rank FROM t) WHERE rank <= 10")
def thread_sample(spark, sf):
    """The sampled threads of a site."""
    path = place(spark, "threads")
    thread_lines(spark, sf).write.text(path)
    return P.hash_sample(D.json_threads(spark, path).select("site", "id"), ["site"], "id", 10, "7").select("id", "rank")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, 'b' || n_regionkey AS body, CAST(n_regionkey AS INT) AS score FROM nation")
def threads_array(spark, sf):
    """One array of threads whose question is nested."""
    import json

    path = place(spark, "array")
    put(spark, f"{path}/threads.json", json.dumps([{"question": {"id": r.n_nationkey, "title": r.n_name, "body": f"b{r.n_regionkey}", "score": r.n_regionkey}} for r in nations(spark, sf)], indent=1).encode())
    return D.json_threads(spark, path, lines=False).select("id", "title", "body", "score")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 7 > 0")
def lenient_lines(spark, sf):
    """JSON lines, of which broken ones go."""
    path = place(spark, "lines")
    p = table(spark, sf, "part")
    good = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    p.select(F.when(F.col("p_partkey") % 7 > 0, good).otherwise(F.concat(F.lit("{broken "), "p_name"))).write.text(path)
    return D.json_lines(spark, path, "id bigint, name string").where("id IS NOT NULL")


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def array_lines(spark, sf):
    """An array with an object a line, read without being held whole."""
    path = place(spark, "array-lines")
    p = table(spark, sf, "part")
    first = spark.range(2).select(F.when(F.col("id") == 0, "[").otherwise("]").alias("v"))
    p.select(F.concat(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))), F.lit(",")).alias("v")).union(first).write.text(path)
    return D.json_array_lines(spark, path, "id bigint, name string")


@query("SELECT 'e-' || n_nationkey AS id FROM nation")
def ids_only(spark, sf):
    """Ids of an array of entities, without the rest."""
    import json

    path = place(spark, "ids")
    put(spark, f"{path}/entities.json", json.dumps([{"entity/id": f"e-{r.n_nationkey}", "entity/text": "long " * 100} for r in nations(spark, sf)]).encode())
    return D.entity_ids(spark, path)


TERM_FILE_SQL = """t AS (SELECT DISTINCT lower(p_name) AS term_lower, p_name AS term, 'c-' || p_name AS canon FROM part UNION SELECT DISTINCT lower(w), w, 'w-' || w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"""


def term_file(spark, sf) -> DataFrame:
    path = place(spark, "terms")
    p = table(spark, sf, "part").select(F.col("p_name").alias("t"), F.lit("c-").alias("k")).union(table(spark, sf, "part").select(F.explode(F.split("p_name", " ")), F.lit("w-"))).distinct()
    lines = p.select(F.concat_ws("\t", F.lower("t"), "t", F.lit("src"), F.concat("k", "t")).alias("v")).union(spark.range(1).select(F.lit("just one column")))
    # a header in each file, as each is read alone
    lines.repartition(1).sortWithinPartitions("v").select("v").write.option("header", False).text(f"{path}/body")
    body = spark.read.text(f"{path}/body").select("value")
    body.coalesce(1).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").csv(f"{path}/file")
    return D.term_file(spark, f"{path}/file")


@query(f"WITH {TERM_FILE_SQL} SELECT term_lower, term, canon FROM t")
def term_dictionary(spark, sf):
    """A tab-separated dictionary with a header; lines without a canonical name go."""
    return term_file(spark, sf)


@query(f"WITH {TERM_FILE_SQL} SELECT term_lower, max(struct_pack(a := term, b := canon)).b AS canon FROM t WHERE NOT contains(term_lower, ' ') AND length(term_lower) >= 3 GROUP BY 1")
def single_word_terms(spark, sf):
    """The dictionary's single words."""
    from threadloom.operators.lexicon import kernel

    return D.single_terms(kernel(term_file(spark, sf))).select("term_lower", "canon")


@query("SELECT 'p' || p_partkey AS id, p_name AS title, p_type || ' & ' || p_brand AS abstract, p_brand || ',' || p_type AS categories, '2020-01-02' AS date FROM part")
def atom_feed(spark, sf):
    """Entries of saved feed pages."""
    path = place(spark, "feed")
    p = table(spark, sf, "part")
    text = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    entry = F.concat(
        F.lit("<entry>"), text("id", F.concat(F.lit("http://x.org/abs/p"), F.col("p_partkey").cast("string"), F.lit("v2"))), text("title", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")))),
        text("summary", F.concat("p_type", F.lit(" &amp; "), "p_brand")), text("published", F.lit("2020-01-02T03:04:05Z")), element("category", term=F.col("p_brand")), element("category", term=F.col("p_type")), F.lit("</entry>"),
    )
    ends = spark.range(2).select(F.when(F.col("id") == 0, "<feed>").otherwise("</feed>").alias("v"), (F.col("id") * 2).alias("k"))
    p.select(entry.alias("v"), F.lit(1).cast("long").alias("k")).union(ends).repartition(1).sortWithinPartitions("k").select("v").write.text(path)
    return D.atom_entries(spark, path).select("id", "title", "abstract", F.array_join("categories", ",").alias("categories"), "date")


# files -----------------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal > 0 AS rich, 'a \"b\" \\ ' || s_name AS said FROM supplier")
def edn_round_trip(spark, sf):
    """EDN maps with keywords, numbers, booleans and quoted strings."""
    path = place(spark, "edn")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("rich"), F.concat(F.lit('a "b" \\ '), "s_name").alias("said"))
    maps = K.edn_maps(s, "entity").agg(F.array_join(F.array_sort(F.collect_list("edn")), "\n ").alias("v"))
    maps.select(F.concat(F.lit("["), "v", F.lit("]"))).coalesce(1).write.text(path)
    return R.edn_records(spark, path, "id bigint, name string, rich boolean, said string")


@query("SELECT n_name AS name, 'The ' || n_name AS title, 'Definition' AS type, 'r' || n_regionkey AS related, 'syn,d-' || n_name AS defines, CAST(18 + n_regionkey AS VARCHAR) || 'A05' AS codes, 'Text of ' || n_name AS body, CAST(18 + n_regionkey AS VARCHAR) AS parent FROM nation")
def tex_directory(spark, sf):
    """Encyclopaedia sources by their preambles; files without a name go."""
    path = place(spark, "tex")
    for r in nations(spark, sf):
        source = f"\\pmcanonicalname{{{r.n_name}}}\n\\pmtitle{{The {r.n_name}}}\n\\pmtype{{Definition}}\n\\pmrelated{{ r{r.n_regionkey} }}\n\\pmsynonym{{syn}}\n\\pmdefines{{d-{r.n_name}}}\n\\pmclassification{{msc}}{{{18 + r.n_regionkey}A05}}\n\\begin{{document}}\n Text of {r.n_name}\n\\end{{document}}"
        put(spark, f"{path}/{r.n_regionkey}/{r.n_nationkey}.tex", source.encode())
    put(spark, f"{path}/0/none.tex", b"\\begin{document}nameless\\end{document}")
    put(spark, f"{path}/0/other.txt", b"\\pmcanonicalname{other}")
    from threadloom.functions.values import class_parent

    code = F.get("codes", 0)
    return R.tex_entries(spark, path).select("name", "title", "type", F.array_join("related", ",").alias("related"), F.array_join("defines", ",").alias("defines"), code.alias("codes"), "body", class_parent(code).alias("parent"))


@query("SELECT 'p' || n_nationkey AS page_id, n_name AS name, '# ' || n_name || chr(10) || '[[link]]' AS content FROM nation WHERE n_nationkey % 5 > 0")
def page_directories(spark, sf):
    """Pages as directories of a name and a content; those that lack one go."""
    path = place(spark, "pages")
    for r in nations(spark, sf):
        put(spark, f"{path}/{r.n_regionkey}/p{r.n_nationkey}/name", f"{r.n_name} \n".encode())
        if r.n_nationkey % 5:
            put(spark, f"{path}/{r.n_regionkey}/p{r.n_nationkey}/content.md", f"# {r.n_name}\n[[link]]".encode())
    return R.sharded_pages(spark, path)


def _tar(members: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    return raw.getvalue()


def paper_folder(spark, sf) -> str:
    """Archives, single sources, compressed ones and what can't be read, by region."""
    path = place(spark, "papers")
    for r in nations(spark, sf):
        main = f"\\begin{{document}}{r.n_name}\n\\input{{part}}\\end{{document}}"
        kinds = [lambda: ("tar.gz", _tar({"part.tex": "inner", "main.tex": main, "fig.png": "x"})), lambda: ("tex", main.encode()), lambda: ("bin", gzip.compress(main.encode())), lambda: ("pdf", b"%PDF-1.4 \\x"), lambda: ("tar.gz", _tar({"readme.txt": "none"}))]  # noqa: B023
        ext, raw = kinds[r.n_regionkey % 5]()
        put(spark, f"{path}/{r.n_nationkey}.{ext}", raw)
    return path


@query("""SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'ok' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN 'unreadable' ELSE 'no_tex' END AS status, CASE n_regionkey WHEN 0 THEN 'main.tex' END AS main,
CASE WHEN n_regionkey = 0 THEN '\\begin{document}' || n_name || chr(10) || 'inner\\end{document}' WHEN n_regionkey < 3 THEN '\\begin{document}' || n_name || chr(10) || '\\input{part}\\end{document}' END AS text, CAST(CASE n_regionkey WHEN 0 THEN 2 ELSE 0 END AS INT) AS members FROM nation""")
def paper_archives(spark, sf):
    """Main sources of archives with their inputs put in; a file that fails is a row."""
    a = R.archives(spark, paper_folder(spark, sf))
    return a.select(F.regexp_extract("path", r"/(\d+)\.[a-z.]+$", 1).cast("int").alias("id"), "status", "main", "text", "members")


@query("SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'ok' WHEN 4 THEN 'no_tex' ELSE 'tar_error' END AS status, CASE n_regionkey WHEN 0 THEN left('\\begin{document}' || n_name || chr(10) || '\\input{part}\\end{document}', 30) ELSE '' END AS text FROM nation")
def archive_budget(spark, sf):
    """The largest member of each archive, 30 characters of it, which is the budget asked for."""
    a = R.archives(spark, paper_folder(spark, sf), budget=(30, 1))
    return a.select(F.regexp_extract("path", r"/(\d+)\.[a-z.]+$", 1).cast("int").alias("id"), "status", "text")


@query("SELECT 'arxiv-' || CASE WHEN p_partkey % 2 = 0 THEN 'a/' ELSE '' END || p_partkey AS entity_id, CASE p_partkey % 4 WHEN 0 THEN '/d/a_' || p_partkey || '.tex' WHEN 1 THEN '/d/' || p_partkey || '.tar.gz' WHEN 2 THEN '/d/a_' || p_partkey || '.bin' END AS path FROM part")
def paper_lookup(spark, sf):
    """Each paper's best file by kind; papers without one stay."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("s"))
    odd = F.col("p_partkey") % 2 == 1
    e = p.select(F.concat(F.lit("arxiv-"), F.when(odd, "").otherwise("a/"), "s").alias("entity_id"))
    name = F.concat(F.lit("/d/"), F.when(odd, "").otherwise("a_"), "s")
    f = p.select(F.explode(F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(".bin"), F.lit(".tex"), F.lit(".pdf"))).when(F.col("p_partkey") % 4 == 1, F.array(F.lit(".tar"), F.lit(".tar.gz"))).when(F.col("p_partkey") % 4 == 2, F.array(F.lit(".bin"))).otherwise(F.array(F.lit(".pdf")))).alias("x"), name.alias("n"))
    return R.paper_files(e, f.select(F.concat("n", "x").alias("path")))


# sinks -----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS text, lang, n_chars FROM documents")
def json_sink(spark, sf):
    """JSON lines, read back."""
    path = place(spark, "json")
    K.json_lines(table(spark, sf, "documents"), path)
    return spark.read.schema("doc_id bigint, text string, lang string, n_chars bigint").json(path).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("SELECT 'table' AS form, user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 2 UNION ALL SELECT 'lines', user_id, count(*), round(sum(value), 6) FROM events GROUP BY 2")
def table_and_lines(spark, sf):
    """A table and JSON lines made from it."""
    path = place(spark, "both")
    K.both(table(spark, sf, "events").select("user_id", "value"), f"{path}/table", f"{path}/lines")
    forms = spark.read.parquet(f"{path}/table").withColumn("form", F.lit("table")).unionByName(spark.read.schema("user_id bigint, value double").json(f"{path}/lines").withColumn("form", F.lit("lines")))
    return forms.groupBy("form", "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT vec_id, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def vector_round_trip(spark, sf):
    """Vectors by id, written and read."""
    path = place(spark, "vectors")
    K.vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(total, 5).alias("total"))


@query("SELECT * FROM (SELECT 'orders' AS stage, 'rows' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'orders', 'customers', count(DISTINCT o_custkey)::DOUBLE FROM orders UNION ALL SELECT 'parts', 'rows', count(*)::DOUBLE FROM part)")
def run_manifest(spark, sf):
    """Numbers of stages appended to a run's manifest."""
    path = place(spark, "manifest")
    K.append_manifest(K.manifest(table(spark, sf, "orders").agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers")), "orders"), path)
    K.append_manifest(K.manifest(table(spark, sf, "part").agg(F.count("*").alias("rows")), "parts"), path)
    return spark.read.schema("stage string, metric string, value double").json(path)


@query("""SELECT 'p' || p_partkey AS entity_id, p_partkey AS question_id, 'pattern' AS stage, 'Title: ' || left(p_name, 10) || chr(10) || 'Question: ' || p_type || chr(10) || 'Answer: ' || p_brand || chr(10) || 'Which of the listed reasoning patterns does the answer use? Reply with a list of numbers.' AS prompt FROM part
UNION ALL SELECT 'p' || p_partkey, p_partkey, 'performative', 'Source (answer): ' || p_type || chr(10) || 'Target (question): ' || p_name || chr(10) || 'Which speech act links the source to the target? Reply with a JSON object.' FROM part""")
def prompt_files(spark, sf):
    """Prompts as JSON lines, each text cut at its length."""
    path = place(spark, "prompts")
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_partkey").alias("question_id"), "p_name", "p_type", "p_brand", F.lit("answer").alias("a"), F.lit("question").alias("q"))
    one = T.prompts(p.withColumn("stage", F.lit("pattern")), "pattern", ("p_name", 10), ("p_type", 100), ("p_brand", 100))
    two = T.prompts(p.withColumn("stage", F.lit("performative")), "performative", ("a", 100), ("p_type", 100), ("q", 100), ("p_name", 100))
    K.prompt_lines(one.union(two), path)
    return spark.read.schema("entity_id string, question_id bigint, stage string, prompt string").json(path)


@query("SELECT '# Run' || chr(10) || chr(10) || '| gate | status |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || CASE WHEN r_regionkey > 1 THEN 'pass' ELSE 'fail' END || ' |', chr(10) ORDER BY r_name) || chr(10) AS report FROM region")
def gate_report(spark, sf):
    """A report of gates."""
    g = table(spark, sf, "region").select(F.col("r_name").alias("gate"), F.when(F.col("r_regionkey") > 1, "pass").otherwise("fail").alias("status"))
    return spark.createDataFrame([(K.markdown(g, "Run"),)], "report string")


CHART_SQL = f"""{CONV_SQL}, n AS (SELECT 't' || (conv_id * 100) AS thread_id, 't' || (conv_id * 100) || CASE WHEN turn = t0 THEN '-q' WHEN role = 'assistant' THEN '-a' || (conv_id * 100 + turn + 1) ELSE '-c' || (conv_id * 100 + turn + 1) END AS node, CASE WHEN turn = t0 THEN 'question' WHEN role = 'assistant' THEN 'answer' ELSE 'comment' END AS kind, turn > t0 AS later FROM c)"""


def chart_parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    q, m = conversation_posts(spark, sf)
    nodes = T.wiring_nodes(q, m)
    edges = nodes.where("node_type <> 'question'").select("thread_id", F.col("node_id").alias("source"), F.concat("thread_id", F.lit("-q")).alias("target"), F.lit("to").alias("edge_type"))
    return nodes, edges


@query(f"""WITH {CHART_SQL} SELECT thread_id, 'flowchart TD' || chr(10) || string_agg('  ' || replace(node, '-', '_') || '["' || kind || '"]', chr(10) ORDER BY '  ' || replace(node, '-', '_') || '["' || kind || '"]')
|| coalesce(chr(10) || string_agg('  ' || replace(node, '-', '_') || ' -->|to| ' || thread_id || '_q', chr(10) ORDER BY '  ' || replace(node, '-', '_') || ' -->|to| ') FILTER (later), '') AS mermaid FROM n GROUP BY thread_id""")
def flow_charts(spark, sf):
    """Threads as flow charts."""
    return K.mermaid(*chart_parts(spark, sf))


@query(f"""WITH {CHART_SQL} SELECT thread_id, 'digraph {{' || chr(10) || string_agg('  "' || node || '" [label=' || '"' || kind || '"];', chr(10) ORDER BY '  "' || node || '" [label=' || '"' || kind || '"];')
|| chr(10) || coalesce(string_agg('  "' || node || '" -> "' || thread_id || '-q" [label="to"];', chr(10) ORDER BY '  "' || node || '" -> ') FILTER (later), '') || chr(10) || '}}' AS dot FROM n GROUP BY thread_id""")
def dot_graphs(spark, sf):
    """Threads for Graphviz."""
    return K.graphviz(*chart_parts(spark, sf))


# stages and streams ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS status FROM orders")
def shard_tables(spark, sf):
    """shards' tables as one read; columns that a shard lacks are null."""
    path, o = place(spark, "shards"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    for i in range(3):
        (T.in_shard(o, "id", i, 3) if i == 2 else T.in_shard(o, "id", i, 3).drop("status")).write.parquet(f"{path}/{i}")
    return A.shard_union(spark, [f"{path}/{i}" for i in range(3)]).select("id", "customer", "status")


@query("SELECT 'c' || c_custkey AS entity_id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier")
def entity_union(spark, sf):
    """Entities of several stages under one schema."""
    path = place(spark, "entities")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind")).write.parquet(f"{path}/a")
    s.select(F.lit("supplier").alias("kind"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("name")).write.parquet(f"{path}/b")
    return A.shard_union(spark, [f"{path}/a", f"{path}/b"]).select("entity_id", "name", "kind")


@query("SELECT o_orderpriority AS priority, count(*) AS n, 1 AS runs FROM orders GROUP BY 1")
def resumed_stages(spark, sf):
    """A stage whose table is there is passed over: the counting stage runs once in two runs of the plan."""
    path, ran = place(spark, "run"), []
    stages = [
        ("orders", lambda t: table(spark, sf, "orders").select("o_orderpriority")),
        ("counts", lambda t: ran.append(1) or t["orders"].groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))),
    ]
    A.run_stages(spark, path, stages)
    return A.run_stages(spark, path, stages)["counts"].withColumn("runs", F.lit(len(ran)))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def directory_reports(spark, sf):
    """A report for each batch of new files; what was read stays read."""
    path, e = place(spark, "watched"), table(spark, sf, "events").select("event_id", "event_type")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").json(f"{path}/in")
        W.watched(spark, f"{path}/in", "event_id bigint, event_type string", lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def harvested_once(spark, sf):
    """Records of a key once, over harvests that go on where the last one stopped."""
    path, e = place(spark, "harvest"), table(spark, sf, "events")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).select("user_id").write.mode("append").json(f"{path}/in")
        W.harvested(spark, f"{path}/in", "user_id bigint", "user_id", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("user_id bigint").parquet(f"{path}/out")



