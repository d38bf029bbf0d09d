"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORACLE: dict[str, str] = {}

ORACLE["op1_exact_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(max(list_inner_product(q.v, c.v)) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v) GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS node, doc_id AS id FROM documents UNION SELECT l.b, r.id FROM r JOIN l ON l.a = r.node
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.id) AS component_id FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.exact_topk import exact_topk

    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = _table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & finite).select("vec_id", whole.alias("vec"))
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of each document: a third in, 12 code points become its first 20; a half in, a remark goes in; three
    quarters in, 30 code points go."""
    import public_tokenizers

    from threadloom.llm.edit_token_counts import count_after_edits

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n", F.char_length(F.coalesce("text", F.lit(""))))

    def change(share: float, deleted: int, inserted):
        return F.struct(F.floor(F.col("n") * share).cast("int").alias("start"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))

    edits = F.array(change(1 / 3, 12, F.substring("text", 1, 20)), change(0.5, 0, F.lit(" (see note 42, it's new) ")), change(0.75, 30, F.lit("")))
    docs = docs.withColumn("edits", edits).drop("n")
    return count_after_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/d<thousands of doc_id>/d<hundreds>/<doc_id>.txt; each tenth is its directory's LICENSE,
    which speaks for the directory where a licence is found in it."""
    from threadloom.llm.license_scan import license_scan, notices

    none = F.lit("none")
    part = lambda wide: F.coalesce(F.concat(F.lit("d"), F.floor(F.col("doc_id") / wide).cast("string")), none)
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), none), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", none), part(1000), part(100), name)
    files = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan(files, notices(spark))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.source_mix import Mix, word_count

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return Mix(docs).taken("doc_id", "size", "source_size", "target")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.fingerprints import edited_and_next

    return edited_and_next(_table(spark, sf_dir, "documents"))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm import ordinal_toxicity as o

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = o.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))
    return o.score(docs, model).select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm import weak_quality as w

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return w.score(docs, w.fit(docs)).select("doc_id", "quality", (F.col("quality") >= 0.5).alias("keep"))


def op8_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.uniform_shards import uniform_shards

    placed = uniform_shards(_table(spark, sf_dir, "documents"), shards=40)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    none = F.lit(None).cast("int")
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), length=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from threadloom.llm.word_bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=())


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
