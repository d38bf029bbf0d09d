"""Readers of question-and-answer dumps, metadata, threads and dictionaries, with explicit schemas throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import text as X

POSTS = "_Id long, _PostTypeId int, _ParentId long, _AcceptedAnswerId long, _Score int, _Title string, _Body string, _Tags string, _AnswerCount int, _OwnerUserId long, _CreationDate string"
COMMENTS = "_Id long, _PostId long, _Score int, _Text string, _CreationDate string, _UserId long"
HISTORY = "_Id long, _PostHistoryTypeId string, _UserId string, _PostId string, _CreationDate string, _Text string"


def xml_rows(spark: SparkSession, path: str, schema: str, tag: str = "row") -> DataFrame:
    """Attributes of `<row .../>` elements, one a line as dumps have them, so that one large file is split across tasks;
    lines without such an element go."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith(f"<{tag} "))
    return lines.select(F.from_xml(F.trim("value"), schema, {"rowTag": tag}).alias("r")).select("r.*")


def xml_elements(spark: SparkSession, path: str, schema: str, tag: str) -> DataFrame:
    """Elements that may span lines, of files that are each read as a whole."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def posts(spark: SparkSession, path: str, least: int | None = None) -> DataFrame:
    """(id, kind, parent_id, accepted_id, score, title, body, text, latex, tags, answer_count, owner_id, ts, seq) of
    questions and answers, of a score if asked; seq is the id, by which dumps are ordered."""
    kind = F.when(F.col("_PostTypeId") == 1, "question").when(F.col("_PostTypeId") == 2, "answer")
    out = xml_rows(spark, path, POSTS).select(
        F.col("_Id").alias("id"), kind.alias("kind"), F.col("_ParentId").alias("parent_id"), F.col("_AcceptedAnswerId").alias("accepted_id"), F.coalesce("_Score", F.lit(0)).alias("score"),
        F.coalesce("_Title", F.lit("")).alias("title"), F.coalesce("_Body", F.lit("")).alias("body"), X.strip_html(F.coalesce("_Body", F.lit(""))).alias("text"), X.latex_fragments(F.coalesce("_Body", F.lit(""))).alias("latex"),
        X.tags("_Tags").alias("tags"), F.coalesce("_AnswerCount", F.lit(0)).alias("answer_count"), F.col("_OwnerUserId").alias("owner_id"), F.try_to_timestamp("_CreationDate").alias("ts"), F.col("_Id").alias("seq"),
    ).where("kind IS NOT NULL")
    return out if least is None else out.where(F.col("score") >= least)


def comments(spark: SparkSession, path: str) -> DataFrame:
    return xml_rows(spark, path, COMMENTS).select(F.col("_Id").alias("id"), F.col("_PostId").alias("post_id"), F.coalesce("_Score", F.lit(0)).alias("score"), F.coalesce("_Text", F.lit("")).alias("text"), F.try_to_timestamp("_CreationDate").alias("ts"), F.col("_UserId").alias("user_id"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """First texts and edits of bodies (types 2 and 5) of known users."""
    h = xml_rows(spark, path, HISTORY).where(F.col("_PostHistoryTypeId").isin("2", "5") & F.col("_UserId").isNotNull())
    return h.select(F.col("_UserId").alias("user_id"), F.col("_PostId").alias("post_id"), F.try_to_timestamp("_CreationDate").alias("ts"), F.col("_Text").alias("text"))


def paper_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Paper records of JSON lines in the shape of answered questions: title and abstract stand for both sides,
    categories for tags; the id is the paper's, with a stable hash beside it."""
    schema = "id string, title string, abstract string, authors array<string>, categories array<string>, date string, url string, eprint_url string"
    p = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return p.select(F.xxhash64("id").alias("question_id"), F.concat(F.lit("arxiv-"), "id").alias("entity_id"), "title", F.col("title").alias("question_text"), F.col("abstract").alias("answer_text"), F.col("categories").alias("tags"), "date", "url", "eprint_url")


def json_threads(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Threads of either shape: JSON lines, or one array of objects."""
    answer = "struct<id:bigint,body:string,body_html:string,score:int,is_accepted:boolean>"
    comment = "struct<id:bigint,post_id:bigint,score:int,text:string>"
    schema = f"id bigint, thread_id string, title string, body string, body_html string, tags array<string>, score int, site string, topic string, question struct<id:bigint,title:string,body:string,body_html:string,score:int,tags:array<string>>, answers array<{answer}>, comments struct<question:array<{comment}>,answers:map<string,array<{comment}>>,total:int>"
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    return raw.select(
        F.coalesce("id", "question.id").alias("id"), F.coalesce("title", "question.title").alias("title"), F.coalesce("body", "body_html", "question.body", "question.body_html").alias("body"), F.coalesce("tags", "question.tags").alias("tags"),
        F.coalesce("score", "question.score", F.lit(0)).alias("score"), "site", "topic", "answers", F.concat(F.coalesce("comments.question", F.array().cast(f"array<{comment}>")), F.coalesce(F.flatten(F.map_values("comments.answers")), F.array().cast(f"array<{comment}>"))).alias("comments"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; lines that aren't JSON go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array written with one object a line: brackets and commas go, so the file needn't be read as a whole."""
    line = F.regexp_replace(F.regexp_replace("value", r"^\s*[\[,]?\s*", ""), r"\s*,?\s*\]?\s*$", "")
    rows = spark.read.text(path).select(line.alias("v")).where("v <> ''")
    return rows.select(F.from_json("v", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL").select("r.*")


def entity_ids(spark: SparkSession, path: str, key: str = "entity/id") -> DataFrame:
    """The ids alone."""
    return spark.read.schema(T.StructType([T.StructField(key, T.StringType())])).option("multiLine", True).json(path).select(F.col(f"`{key}`").alias("id"))


def wanted(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Records with wanted ids."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def term_file(spark: SparkSession, path: str) -> DataFrame:
    """(term_lower, term, canon) of a tab-separated dictionary with a header and four columns at least."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("term_lower string, term string, source string, canon string").csv(path)
    return raw.where("term_lower IS NOT NULL AND canon IS NOT NULL").select("term_lower", "term", "canon")


def single_terms(kernel: DataFrame) -> DataFrame:
    return kernel.where("first_key IS NULL")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """(id without version, title, abstract, categories, date) of saved feed pages."""
    schema = "id string, title string, summary string, published string, category array<struct<_term:string>>"
    e = xml_elements(spark, path, schema, "entry")
    return e.select(F.regexp_replace(F.regexp_extract("id", r"abs/(.+)$", 1), r"v\d+$", "").alias("id"), X.collapse("title").alias("title"), X.collapse("summary").alias("abstract"), F.transform("category", lambda c: c["_term"]).alias("categories"), F.substring("published", 1, 10).alias("date"))
