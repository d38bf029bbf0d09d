"""Scalar text functions as column expressions; all but full entity decoding stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import fixed_values as V

EDGE = r"[^\p{L}\p{N}_]"  # what may stand beside a word


def as_column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(as_column(x), r"\s+", " "))


def decode_entities(x) -> Column:
    """The common entities; `decode_all_entities` knows every one."""
    x = as_column(x)
    for name, char in V.ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


@F.pandas_udf(T.StringType())
def decode_all_entities(x: pd.Series) -> pd.Series:
    import html

    return x.map(lambda s: None if s is None else html.unescape(s))


def strip_html(x, decode_first: bool = False) -> Column:
    """Tags as spaces and entities decoded, in that order (so that encoded tags survive), or the other."""
    x = as_column(x)
    if decode_first:
        return collapse(F.regexp_replace(decode_entities(x), "<[^>]+>", " "))
    return collapse(decode_entities(F.regexp_replace(x, "<[^>]+>", " ")))


def latex_fragments(x) -> Column:
    """Display fragments, all of them, then inline ones not yet listed; an inline one may lie between two displays."""
    x = decode_entities(x)
    display = F.transform(F.regexp_extract_all(x, F.lit(r"(?s)\$\$(.*?)\$\$"), 1), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    inline = F.transform(F.regexp_extract_all(x, F.lit(r"\$([^\$]+?)\$"), 1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.concat(display, F.array_except(F.filter(inline, lambda s: s != ""), display))


def tags(x) -> Column:
    """Tags of `|a|b|` or `<a><b>`."""
    x = F.coalesce(as_column(x), F.lit(""))
    piped = F.filter(F.split(x, r"\|"), lambda t: t != "")
    return F.when(x.contains("|"), piped).otherwise(F.regexp_extract_all(x, F.lit("<([^>]+)>"), 1))


def emphasis_terms(x) -> Column:
    """Emphasised terms and link targets, pattern by pattern, longer than a character, once each."""
    found = F.concat(*[F.regexp_extract_all(as_column(x), F.lit(p), 1) for p in V.EMPHASIS])
    found = F.transform(found, lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.startswith("\\")))


def cross_references(x) -> Column:
    """array<struct<display, target>> of both link commands, command by command."""
    def of(command: str) -> Column:
        pattern = F.lit(r"\\" + command + r"\{([^}]*)\}\{([^}]+)\}")
        pairs = F.arrays_zip(F.regexp_extract_all(as_column(x), pattern, 1).alias("display"), F.regexp_extract_all(as_column(x), pattern, 2).alias("target"))
        return F.transform(pairs, lambda p: F.struct(F.trim(p["display"]).alias("display"), F.trim(p["target"]).alias("target")))

    return F.concat(of("PMlinkname"), of("PMlinkid"))


def environments(x, names=("theorem", "lemma", "proposition", "corollary", "definition", "example", "remark", "proof")) -> Column:
    """array<struct<environment, content>> of named environments, contents cut at 200 characters."""
    pattern = F.lit(r"(?s)\\begin\{(\w+)\}(.*?)\\end\{\1\}")
    pairs = F.arrays_zip(F.regexp_extract_all(as_column(x), pattern, 1).alias("environment"), F.regexp_extract_all(as_column(x), pattern, 2).alias("content"))
    kept = F.filter(pairs, lambda p: p["environment"].isin(*names))
    return F.transform(kept, lambda p: F.struct(p["environment"].alias("environment"), F.substring(F.regexp_replace(p["content"], r"^\s+|\s+$", ""), 1, 200).alias("content")))


def slug(x) -> Column:
    return F.substring(F.translate(F.lower(as_column(x)), " /", "--"), 1, 80)


def preamble_field(x, field: str) -> Column:
    return F.regexp_extract(as_column(x), r"\\" + field + r"\{([^}]*)\}", 1)


def site_slug(site) -> Column:
    """What stands before the first dot; a default for none."""
    return F.coalesce(F.nullif(F.split_part(as_column(site), F.lit("."), F.lit(1)), F.lit("")), F.lit("stackexchange"))


def entity_id(site, question_id) -> Column:
    return F.concat(F.lit("se-"), site_slug(site), F.lit("-"), as_column(question_id).cast("string"))


def direction(x) -> Column:
    """struct<rows, cols> of a diagram's direction code (l, r, u, d)."""
    n = lambda c: F.regexp_count(as_column(x), F.lit(c))
    return F.struct((n("d") - n("u")).alias("rows"), (n("r") - n("l")).alias("cols"))


def bound_symbol(x) -> Column:
    """The symbol a subscript binds: what stands before = or membership, else its first symbol."""
    x = as_column(x)
    first = F.nullif(F.regexp_extract(x, rf"({V.BOUND_SYMBOL})\s*(?:=|\\in|∈)", 1), F.lit(""))
    return F.coalesce(first, F.nullif(F.regexp_extract(x, V.BOUND_SYMBOL, 0), F.lit("")))


def integral_symbol(tail) -> Column:
    return F.nullif(F.regexp_extract(as_column(tail), V.DIFFERENTIAL, 1), F.lit(""))


def strip_wiki(x) -> Column:
    """Prose of a wiki page: blocks, includes, headings, attributes, emphasis marks and diagrams go, link texts stay."""
    x = as_column(x)
    for pattern, by in V.WIKI_MARKUP:
        x = F.regexp_replace(x, pattern, by)
    return x


def normalise(x) -> Column:
    """Decoded, without tags and bars, lower-cased, collapsed."""
    return collapse(F.lower(F.translate(F.regexp_replace(decode_entities(x), "<[^>]+>", " "), "|", " ")))


def word_pattern(term: str) -> str:
    """A pattern that finds a term between others than ASCII letters and digits, any white space between its words."""
    import re

    return r"(^|[^a-z0-9])" + r"\s+".join(re.escape(w) for w in term.lower().split()) + r"([^a-z0-9]|$)"


def discovered_term(x, stopwords: list[str], generic: list[str]) -> Column:
    """A candidate term made plain, or null: LaTeX and punctuation go, stop words go at both ends; of one to four words
    none may be a single letter, one must have four, the whole 3 to 80."""
    x = F.regexp_replace(as_column(x), r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ")
    x = F.regexp_replace(F.translate(x, "{}$", "   "), r"[^A-Za-z\-\s']", " ")
    x = F.regexp_replace(F.lower(collapse(x)), r"^[ \-']+|[ \-']+$", "")
    stop = F.array(*map(F.lit, stopwords))
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    bad = lambda w: F.array_contains(stop, w)
    first = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("lead")), lambda a, w: F.struct((a["n"] + (a["lead"] & bad(w)).cast("int")).alias("n"), (a["lead"] & bad(w)).alias("lead")))["n"]
    last = F.aggregate(F.reverse(words), F.struct(F.lit(0).alias("n"), F.lit(True).alias("lead")), lambda a, w: F.struct((a["n"] + (a["lead"] & bad(w)).cast("int")).alias("n"), (a["lead"] & bad(w)).alias("lead")))["n"]
    kept = F.slice(words, first + 1, F.greatest(F.lit(0), F.size(words) - first - last))
    term = F.array_join(kept, " ")
    fine = F.size(kept).between(1, 4) & ~F.exists(kept, lambda w: F.length(w) == 1) & F.exists(kept, lambda w: F.length(w) >= 4) & F.length(term).between(3, 80)
    lone = (F.size(kept) == 1) & F.array_contains(F.array(*map(F.lit, generic)), F.get(kept, 0))
    return F.when(fine & ~lone, term)


def tokens(x, strip: str = ".,;:!?()[]\"'") -> Column:
    """Lower-cased words split on white space, without the given characters at their ends."""
    import re

    ends = re.escape(strip)
    # one pass: a word is what stands between the marks at its ends; white space parts words, the marks don't
    inner = rf"[^\s{ends}](?:\S*[^\s{ends}])?"
    return F.regexp_extract_all(F.lower(as_column(x)), F.lit(inner), F.lit(0))


def hotword_score(x, hotwords: list[str], weight: float = 2.0) -> Column:
    """weight for each hotword that the lower-cased text holds."""
    low = F.lower(as_column(x))
    return sum((F.when(low.contains(w.lower()), F.lit(weight)).otherwise(F.lit(0.0)) for w in hotwords), F.lit(0.0))


def rationale_score(x, hotwords: list[str], rationale: list[str], least: float = 4.0) -> Column:
    """Hotwords count 2, words shared with the rationale 0.5; null below the least."""
    shared = F.size(F.array_intersect(tokens(x), F.array(*map(F.lit, rationale))))
    score = hotword_score(x, hotwords) + F.lit(0.5) * shared
    return F.when(score >= least, score)


def context(x, start, end, window: int = 120) -> Column:
    """A match (code points start to end, from 0) in its surroundings, marked, collapsed."""
    x, start, end = as_column(x), as_column(start), as_column(end)
    low, high = F.greatest(F.lit(0), start - window), F.least(F.length(x), end + window)
    inner = F.concat(F.substring(x, low + 1, start - low), F.lit("<<"), F.substring(x, start + 1, end - start), F.lit(">>"), F.substring(x, end + 1, high - end))
    return F.concat(F.when(low > 0, "... ").otherwise(""), collapse(inner), F.when(high < F.length(x), " ...").otherwise(""))


def same_skeleton(a, b) -> Column:
    """Whether two s-expressions differ in atoms alone."""
    bare = lambda x: F.regexp_replace(as_column(x), r"[^\s()]+", "_")
    return bare(a) == bare(b)


def performative(x, bank=V.PERFORMATIVES) -> Column:
    """struct<act, evidence> of the first class with a match, null for none."""
    x = as_column(x)
    acts = []
    for act, patterns in bank:
        hits = [F.nullif(F.regexp_extract(x, ("" if p.startswith("(?m)") else "(?i)") + p.replace("(?m)", "(?dm)"), 0), F.lit("")) for p in patterns]
        hit = F.coalesce(*hits) if len(hits) > 1 else hits[0]
        acts.append(F.when(hit.isNotNull(), F.struct(F.lit(act).alias("act"), hit.alias("evidence"))))
    return F.coalesce(*acts) if len(acts) > 1 else acts[0]
