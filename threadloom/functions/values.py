"""Functions of sets, numbers, hashes and semi-structured texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import as_column


def jaccard(a, b, empty: float = 0.0) -> Column:
    """Share of the union that both hold; `empty` for two empty sets."""
    a, b = as_column(a), as_column(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def precision_recall(found, gold) -> Column:
    """struct<precision, recall>: (1, 1) for two empty sets, (0, 0) where nothing was found, (0, 1) where nothing was due."""
    f, g = F.array_distinct(as_column(found)), F.array_distinct(as_column(gold))
    hit = F.size(F.array_intersect(f, g))
    p = F.when(F.size(f) == 0, F.when(F.size(g) == 0, 1.0).otherwise(0.0)).otherwise(hit / F.nullif(F.size(f), F.lit(0)))
    r = F.when(F.size(g) == 0, 1.0).otherwise(hit / F.nullif(F.size(g), F.lit(0)))
    return F.struct(p.alias("precision"), r.alias("recall"))


def rate(part, whole) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(as_column(part).cast("double"), as_column(whole).cast("double")), F.lit(0.0))


def days(timestamp) -> Column:
    """Days since the epoch, null for what isn't a timestamp."""
    x = as_column(timestamp)
    return F.unix_micros(F.try_to_timestamp(x.cast("string"))) / F.lit(86_400e6)


def confidence(strong_hits) -> Column:
    """high from 80, medium from 30, low-medium from 10, else low."""
    n = as_column(strong_hits)
    return F.when(n >= 80, "high").when(n >= 30, "medium").when(n >= 10, "low-medium").otherwise("low")


def subtype_bucket(x) -> Column:
    """md5 modulo 256."""
    return F.conv(F.right(F.md5(as_column(x).cast("binary")), F.lit(2)), 16, 10).cast("int")


def expression_id(post_id, latex) -> Column:
    return F.concat(F.lit("expr:"), as_column(post_id), F.lit(":"), F.substring(F.sha1(as_column(latex).cast("binary")), 1, 8))


def statement_hash(x) -> Column:
    return F.substring(F.sha2(as_column(x).cast("binary"), 256), 1, 16)


def theorem_id(paper, label, env, statement) -> Column:
    """paper::label, or the environment with the statement's hash."""
    label = as_column(label)
    own = F.concat(as_column(env), F.lit("-"), F.substring(statement_hash(statement), 1, 8))
    return F.concat(as_column(paper), F.lit("::"), F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(own))


def class_parent(code) -> Column:
    """The two-character parent of a longer classification code."""
    c = as_column(code)
    return F.when(F.length(c) > 2, F.substring(c, 1, 2))


def frequency(values) -> Column:
    """An aggregate: map from value (`?` for null) to count is built from entries by `frequency_map`."""
    return F.coalesce(as_column(values).cast("string"), F.lit("?"))


def frequency_map(df, group: list[str], value: str, to: str = "counts"):
    """For each group a map from value to count; null values count as `?`."""
    counts = df.groupBy(*group, frequency(value).alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(to))


def number_list(x) -> Column:
    """Numbers of the first bracketed list; else every whole number from 1 to 25 that the text holds."""
    x = as_column(x)
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), 0), lambda n: n.try_cast("int"))
    listed = F.regexp_extract(x, r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]", 0)
    loose = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"\b\d+\b"), 0), lambda n: n.try_cast("int")), lambda n: n.between(1, 25))
    return F.when(listed != "", numbers(listed)).otherwise(loose)


def json_part(x, opening: str = "{", closing: str = "}") -> Column:
    """The first balanced part between the signs, which count inside strings too; null for none."""
    x = as_column(x)
    tail = F.expr("1") * 0 + F.instr(x, opening)
    text = F.when(tail > 0, F.substring(x, tail, F.length(x)))
    signs = F.regexp_replace(text, f"[^\\{opening}\\{closing}]", " ")
    step = F.transform(F.split(signs, ""), lambda c: F.when(c == opening, 1).when(c == closing, -1).otherwise(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    walked = F.aggregate(step, start, lambda a, s: F.struct((a["depth"] + s).alias("depth"), (a["at"] + 1).alias("at"), F.when((a["end"] == 0) & (a["depth"] + s == 0), a["at"] + 1).otherwise(a["end"]).alias("end")))
    return F.when(walked["end"] > 0, F.substring(text, F.lit(1), walked["end"]))


def strict_object(x) -> Column:
    """struct<value variant, error>: a JSON object, or what is wrong with it."""
    parsed = F.try_parse_json(as_column(x))
    kind = F.schema_of_variant(parsed)
    good = parsed.isNotNull() & kind.startswith("OBJECT")
    return F.struct(F.when(good, parsed).alias("value"), F.when(parsed.isNull(), "parse_error").when(~good, "not_an_object").alias("error"))
