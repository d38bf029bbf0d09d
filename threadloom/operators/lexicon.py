"""Dictionary joins: terms in texts, discovered terms, term dictionaries.

kernel: (term_lower, term, canon, first_key): one row for a term; first_key is the first word of three letters or more
of a phrase (its first word, if none is), null for single words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as X
from threadloom.functions import values as N


def kernel(terms: DataFrame, stopwords: DataFrame | None = None, shortest: int = 3) -> DataFrame:
    """From (term_lower, term, canon): terms that start with a sign or are too short go, the last of equals stays."""
    t = terms.select(F.trim("term_lower").alias("term_lower"), F.trim("term").alias("term"), F.trim("canon").alias("canon"))
    t = t.where((F.length("term_lower") >= shortest) & ~F.substring("term_lower", 1, 1).isin("$", "(", '"', "-"))
    if stopwords is not None:
        t = t.join(stopwords.select(F.col("word").alias("term_lower")), "term_lower", "left_anti")
    t = t.groupBy("term_lower").agg(F.max(F.struct("term", "canon")).alias("_x")).select("term_lower", "_x.term", "_x.canon")
    words = F.split("term_lower", r"\s+")
    key = F.coalesce(F.get(F.filter(words, lambda w: F.length(w) >= 3), 0), F.get(words, 0))
    return t.withColumn("first_key", F.when(F.size(words) > 1, key))


def spot(texts: DataFrame, terms: DataFrame, all_words: bool = False) -> DataFrame:
    """id, term_lower, term, canon: single words as tokens, phrases as substrings of texts that hold their first word.

    texts: (id, text). all_words: a phrase's other words of three letters or more must be tokens too. Tokens are made
    distinct for each text, and join the kernel by word; the larger side decides how."""
    low = texts.select("id", F.lower("text").alias("low"))
    words = low.select("id", F.explode(F.array_distinct(X.tokens("low"))).alias("token"))
    singles = words.join(terms.where("first_key IS NULL"), words["token"] == F.col("term_lower")).select("id", "term_lower", "term", "canon")
    phrases = words.join(terms.where("first_key IS NOT NULL"), words["token"] == F.col("first_key"))
    asked = phrases.groupBy("id").agg(F.collect_set(F.struct("term_lower", "term", "canon")).alias("asked"))  # a text moves once
    found = asked.join(low, "id").withColumn("asked", F.filter("asked", lambda t: F.contains(F.col("low"), t["term_lower"])))
    if all_words:
        held = F.regexp_extract_all("low", F.lit(r"[a-z0-9]{3,}"), 0)
        found = found.withColumn("_held", held)
        rest = lambda t: F.filter(F.split(t["term_lower"], r"\s+"), lambda w: F.length(w) >= 3)
        found = found.withColumn("asked", F.filter("asked", lambda t: F.size(F.array_except(rest(t), F.col("_held"))) == 0))
    return singles.union(found.select("id", F.inline("asked")))


def substring_join(texts: DataFrame, terms: DataFrame, longest: int = 3) -> DataFrame:
    """Columns of texts (low, ...) and terms (term, ...) for each term that a text holds anywhere, inside words too.

    A text that holds a term holds its first characters (`longest` of them, or all). These grams meet without the texts,
    by hash; then each text moves once, to the terms that it may hold, and is searched for them."""
    known = terms.select("term").distinct().where("term <> ''")
    known = known.withColumn("_g", F.substring("term", 1, longest))
    low = texts.select("low").distinct().withColumn("_h", F.xxhash64("low")).withColumn("_c", F.split("low", ""))
    at = lambda i, n: F.concat(*[F.coalesce(F.get("_c", i + k), F.lit("")) for k in range(n)])
    grams = F.concat(*[F.transform("_c", lambda c, i: at(i, n)) for n in range(1, longest + 1)])  # noqa: B023
    met = low.select("_h", F.explode(F.array_distinct(grams)).alias("_g")).join(known, "_g")
    asked = met.groupBy("_h").agg(F.collect_set("term").alias("_asked"))
    keyed = texts.withColumn("_h", F.xxhash64("low")).join(asked, "_h").drop("_h")
    held = keyed.withColumn("_t", F.explode(F.filter("_asked", lambda t: F.contains(F.col("low"), t)))).drop("_asked")
    return held.join(terms, F.col("_t") == F.col("term")).drop("_t")


def coverage(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: texts, texts with a hit, hits, coverage."""
    h = hits.agg(F.count("*").alias("hits"), F.countDistinct("id").alias("covered"))
    n = texts.agg(F.count("*")).scalar()
    return h.select(n.alias("texts"), "hits", "covered").withColumn("coverage", N.rate("covered", "texts"))


def term_scores(candidates: DataFrame, least_entities: int = 2) -> DataFrame:
    """Discovered terms: candidates (entity_id, term, source, context, seq) count once for a source and entity.

    term, occurrences, entities, sources (map), example (first in order), score = occurrences + 0.5 entities +
    0.2 occurrences in definitions (all sources are)."""
    once = candidates.groupBy("entity_id", "term", "source").agg(F.min(F.struct("seq", "context")).alias("first"))
    out = once.groupBy("term").agg(F.count("*").alias("occurrences"), F.countDistinct("entity_id").alias("entities"), F.min(F.struct("first.seq", "entity_id", "source", "first.context")).alias("example"))
    out = out.where(F.col("entities") >= least_entities).join(N.frequency_map(once, ["term"], "source", "sources"), "term")
    score = F.col("occurrences") + 0.5 * F.col("entities") + 0.2 * F.col("occurrences")
    return out.withColumn("score", score).select("term", "occurrences", "entities", "sources", "example.context", "score")


def top_terms(scores: DataFrame, n: int) -> DataFrame:
    """The n best candidate terms, which is the report asked for."""
    return scores.orderBy(F.desc("score"), F.desc("entities"), F.desc("occurrences"), "term").limit(n)


def unknown(terms: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key no known row has."""
    return terms.join(known.select(key).distinct(), key, "left_anti")


def merge_precedence(under: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Two dictionaries of the same columns, the second before the first."""
    cols = [c for c in under.columns if c != key]
    a, b = under.alias("a"), over.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    there = F.col(f"b.{key}").isNotNull()
    return joined.select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), *[F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in cols])


def useful(terms: DataFrame, stoplist: list[str], column: str = "term", bad_parts: list[str] | None = None) -> DataFrame:
    """Without terms that are short or long, numbers, listed, start with a formula, or hold a bad part."""
    c = F.col(column)
    out = terms.where(F.length(c).between(3, 100) & ~c.rlike(r"^[\d.\s]+$") & ~F.lower(c).isin(*stoplist) & ~F.substring(c, 1, 1).isin("$", "\\"))
    for part in bad_parts or []:
        out = out.where(~F.lower(c).contains(part))
    return out


def tag_kernel(tags: DataFrame, meta: list[str], least: int = 5) -> DataFrame:
    """(tag, n): tags of at least so many uses, but meta tags."""
    return tags.groupBy("tag").agg(F.count("*").alias("n")).where((F.col("n") >= least) & ~F.col("tag").isin(*meta))


def domain_dictionary(mentions: DataFrame) -> DataFrame:
    """term with the sets of its sources, canonical names, kinds, domains and codes; high confidence if structured."""
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("source", "canonical", "kind", "domain", "code")]
    return mentions.groupBy("term").agg(*sets, F.when(F.max(F.col("structured").cast("int")) == 1, "high").otherwise("low").alias("confidence"))


def pattern_idf(links: DataFrame) -> DataFrame:
    """term, df, idf from links(pattern, term): 1 for terms of one pattern, falling to 0 for those of all."""
    low = links.select("pattern", F.lower("term").alias("term")).distinct()
    n = links.agg(F.countDistinct("pattern")).scalar()
    df = low.groupBy("term").agg(F.count("pattern").alias("df"))
    return df.select("term", "df", F.greatest(F.lit(0.0), 1 - (F.col("df") - 1) / F.greatest(n - 1, F.lit(1))).alias("idf"))


def categorical(texts: DataFrame, links: DataFrame, tags: DataFrame, signals: DataFrame, least: float = 3.0) -> DataFrame:
    """id, pattern, score: patterns of a text by idf-weighted links (required 2, typical 1), tags (2) and text signals (1.5).

    texts: (id, text); links: (pattern, term, kind); tags: (id, tag); signals: (pattern, regex). A pattern needs the
    least score and one telling sign: a link of idf 0.5 or more, a tag or a signal."""
    low = texts.select("id", F.lower(X.strip_wiki("text")).alias("low"))
    weighted = links.select("pattern", F.lower("term").alias("term"), "kind").join(pattern_idf(links).select("term", "idf"), "term")
    found = substring_join(low, weighted)
    a = found.select("id", "pattern", (F.when(F.col("kind") == "required", 2.0).otherwise(1.0) * F.col("idf")).alias("w"), (F.col("idf") >= 0.5).alias("telling"))
    names = links.select("pattern").distinct().withColumn("name", F.translate(F.split_part("pattern", F.lit("/"), F.lit(-1)), "-", " "))
    plain = tags.select("id", F.translate(F.lower("tag"), "-", " ").alias("tag"))
    wider = substring_join(plain.withColumnRenamed("tag", "low"), names.withColumnRenamed("name", "term")).select("id", "pattern", F.col("low").alias("tag"))
    narrower = substring_join(names.withColumnRenamed("name", "low"), plain.withColumnRenamed("tag", "term")).select("id", "pattern", F.col("term").alias("tag"))
    b = wider.union(narrower).distinct().select("id", "pattern", F.lit(2.0).alias("w"), F.lit(True).alias("telling"))
    # the signals are a bank of patterns, a few for each: they are tried on each text in its row
    bank = F.array(*[F.when(F.col("low").rlike("(?i)" + r["regex"]), F.lit(r["pattern"])) for r in signals.select("pattern", "regex").collect()]).cast("array<string>")
    c = low.select("id", F.explode(F.filter(bank, lambda p: p.isNotNull())).alias("pattern")).select("id", "pattern", F.lit(1.5).alias("w"), F.lit(True).alias("telling"))
    out = a.union(b).union(c).groupBy("id", "pattern").agg(F.sum("w").alias("score"), F.max("telling").alias("telling"))
    return out.where((F.col("score") >= least) & F.col("telling")).select("id", "pattern", F.round("score", 1).alias("score"))


def enrich(entries: DataFrame) -> DataFrame:
    """Entries (id, body, related, defines) with extracted terms, cross references, environments, implicit relations and
    new terms."""
    out = entries.withColumn("extracted_terms", X.emphasis_terms("body")).withColumn("extracted_xrefs", X.cross_references("body")).withColumn("extracted_envs", X.environments("body"))
    known = F.transform(F.coalesce("defines", F.array().cast("array<string>")), lambda d: F.lower(d))
    related = F.coalesce("related", F.array().cast("array<string>"))
    out = out.withColumn("_known", known).withColumn("_related", related)
    out = out.withColumn("implicit_relations", F.filter("extracted_xrefs", lambda x: ~F.array_contains("_related", x["target"])))
    return out.withColumn("new_terms", F.filter("extracted_terms", lambda t: ~F.array_contains("_known", F.lower(t)))).drop("_known", "_related")


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    return enriched.agg(F.count("*").alias("entries"), total("extracted_xrefs").alias("xrefs"), total("implicit_relations").alias("implicit"), F.count_if(F.size("implicit_relations") > 0).alias("with_implicit"), total("new_terms").alias("new_terms"), total("extracted_envs").alias("environments"))


def relations(entries: DataFrame) -> DataFrame:
    """Distinct (type, src, dst) of entries (id, related, defines, codes)."""
    def of(kind: str, column: str, prefix: str) -> DataFrame:
        return entries.select(F.lit(kind).alias("type"), F.col("id").alias("src"), F.explode(column).alias("_d")).select("type", "src", F.concat(F.lit(prefix), X.slug("_d") if prefix == "term-" else F.col("_d")).alias("dst"))

    return of("related-to", "related", "").union(of("defines", "defines", "term-")).union(of("classified-by", "codes", "msc-")).distinct()


def merged_bodies(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries (id, body, related, defines) with bodies, synonyms and relations of sources (name, body, related, synonyms)."""
    out = entries.join(sources.select(F.col("name").alias("id"), F.col("body").alias("_b"), F.col("related").alias("_r"), F.col("synonyms").alias("_s")), "id", "left")
    none = F.array().cast("array<string>")
    plus = lambda a, b: F.concat(F.coalesce(a, none), F.array_except(F.coalesce(b, none), F.coalesce(a, none)))
    return out.select("id", F.coalesce("_b", "body").alias("body"), plus(F.col("related"), F.col("_r")).alias("related"), plus(F.col("defines"), F.col("_s")).alias("defines"))


def term_entities(entries: DataFrame) -> DataFrame:
    """Distinct defined terms by slug, the least entry's spelling."""
    t = entries.select("id", F.explode("defines").alias("name")).withColumn("slug", X.slug("name"))
    return t.groupBy("slug").agg(F.min(F.struct("id", "name")).alias("f")).select(F.concat(F.lit("term-"), "slug").alias("entity_id"), "f.name")


def class_entities(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("codes").alias("code")).distinct().select(F.concat(F.lit("msc-"), "code").alias("entity_id"), "code", N.class_parent("code").alias("parent"))


def token_counts(texts: DataFrame, pattern: str, samples: int = 2) -> DataFrame:
    """token, n and the first samples (id) of a pattern's matches."""
    t = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("token"))
    per = t.groupBy("token", "id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("token").orderBy("id")
    first = per.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= samples).groupBy("token").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return per.groupBy("token").agg(F.sum("n").alias("n")).join(first, "token")
