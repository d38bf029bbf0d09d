"""Readers of texts in directories, archives and EDN."""

from __future__ import annotations

import io
import json
import re
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of files, whole."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tex_entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, title, type, related, defines, codes, keywords, body) of encyclopaedia sources with a canonical name."""
    t = whole_texts(spark, path, "*.tex")
    many = lambda f: F.transform(F.regexp_extract_all("text", F.lit(r"\\" + f + r"\{([^}]*)\}"), 1), lambda v: F.trim(v))
    body = F.regexp_extract("text", r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1)
    return t.select(
        X.preamble_field("text", "pmcanonicalname").alias("name"), X.preamble_field("text", "pmtitle").alias("title"), X.preamble_field("text", "pmtype").alias("type"), many("pmrelated").alias("related"),
        F.concat(many("pmsynonym"), many("pmdefines")).alias("defines"), F.transform(F.regexp_extract_all("text", F.lit(r"\\pmclassification\{msc\}\{([^}]*)\}"), 1), lambda v: F.trim(v)).alias("codes"), many("pmkeywords").alias("keywords"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"),
    ).where("name <> ''")


def sharded_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, name, content) of directories that hold `name` and `content.md`; others go."""
    files = whole_texts(spark, path)
    part = lambda n: F.get(F.reverse(F.split("path", "/")), n)
    f = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), part(0).alias("file"), part(1).alias("page_id"), "text")
    names = f.where("file = 'name'").select("dir", "page_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("name"))
    return names.join(f.where("file = 'content.md'").select("dir", F.col("text").alias("content")), "dir").select("page_id", "name", "content")


ARCHIVE = "path string, status string, main string, text string, members int"


def _archived(raw: bytes) -> dict[str, str]:
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as tar:
        return {m.name: tar.extractfile(m).read().decode("utf-8", "replace") for m in tar.getmembers() if m.isfile() and m.name.endswith(".tex")}


def main_source(raw: bytes) -> tuple[str, str | None, str | None, int]:
    """(status, main file, text, members): the first member with a document, else the largest, its inputs put in one
    level deep; what isn't an archive is a text, if it looks like one."""
    try:
        members = _archived(raw)
    except (tarfile.TarError, EOFError, OSError):
        import gzip

        try:
            text = gzip.decompress(raw).decode("utf-8", "replace")
        except (OSError, EOFError):
            text = raw.decode("utf-8", "replace")
        return ("text", None, text, 0) if "\\" in text and not text.startswith("%PDF") else ("unreadable", None, None, 0)
    if not members:
        return "no_tex", None, None, 0
    main = next((n for n in sorted(members) if "\\begin{document}" in members[n]), None) or max(sorted(members), key=lambda n: len(members[n]))

    def put(m: re.Match) -> str:
        name = m.group(1).strip()
        return next((members[k] for k in (name, f"{name}.tex", f"./{name}.tex") if k in members), m.group())

    return "ok", main, re.sub(r"\\(?:input|include)\{([^}]+)\}", put, members[main]), len(members)


def budgeted_source(raw: bytes, most_chars: int, most_members: int) -> tuple[str, str, int]:
    """(status, text, members): the largest members, joined up to a number of characters, which is the feature."""
    try:
        members = _archived(raw)
    except (tarfile.TarError, EOFError, OSError):
        return "tar_error", "", 0
    kept = sorted(members.items(), key=lambda kv: (-len(kv[1]), kv[0]))[:most_members]
    return ("ok" if kept else "no_tex"), "\n".join(t for _, t in kept)[:most_chars], len(kept)


def archives(spark: SparkSession, path: str, budget: tuple[int, int] | None = None, glob: str = "*") -> DataFrame:
    """(path, status, main, text, members) of paper sources; a file that fails has a status and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")

    def read(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if budget:
                        status, text, n = budgeted_source(raw.as_py(), *budget)
                        main = None
                    else:
                        status, main, text, n = main_source(raw.as_py())
                except Exception as e:  # one bad file is a row, not a failed job
                    status, main, text, n = f"error: {type(e).__name__}", None, None, 0
                rows.append((path, status, main, text, n))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int32())], names=["path", "status", "main", "text", "members"])

    return files.mapInArrow(read, ARCHIVE)


def paper_files(entities: DataFrame, files: DataFrame) -> DataFrame:
    """entity_id, path of each paper's best file: tex before tar.gz before tar before bin; entities without one stay.

    entities: (entity_id); files: (path)."""
    stem = F.regexp_replace(F.regexp_replace("entity_id", "^arxiv-", ""), r"[^A-Za-z0-9._-]", "_")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.when(name.endswith(".tar.gz"), "tar.gz").otherwise(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, ("tex", "tar.gz", "tar", "bin"))), ext)
    f = files.select("path", F.regexp_replace(name, r"(\.tar\.gz|\.[^.]+)$", "").alias("stem"), rank.alias("rank")).where("rank > 0")
    best = f.groupBy("stem").agg(F.min(F.struct("rank", "path")).alias("b")).select("stem", "b.path")
    return entities.withColumn("stem", stem).join(best, "stem", "left").select("entity_id", "path")


_EDN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\](){}]|#\{|[^\s,\[\](){}"]+')


def edn(text: str):
    """EDN as Python values: keywords without namespace, sets and lists as lists."""
    pieces, at = _EDN.findall(text), 0

    def value():
        nonlocal at
        p = pieces[at]
        at += 1
        if p in ("[", "(", "#{"):
            close, out = {"[": "]", "(": ")", "#{": "}"}[p], []
            while pieces[at] != close:
                out.append(value())
            at += 1
            return out
        if p == "{":
            out = {}
            while pieces[at] != "}":
                k = value()
                out[str(k)] = value()
            at += 1
            return out
        if p[0] == '"':
            return json.loads(p.replace("\n", "\\n"))
        if p[0] == ":":
            return p[1:].rpartition("/")[2]
        if p in ("nil", "true", "false"):
            return {"nil": None, "true": True, "false": False}[p]
        try:
            return int(p)
        except ValueError:
            try:
                return float(p)
            except ValueError:
                return p

    return value()


def edn_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Maps of an EDN list as rows of a schema."""
    texts = whole_texts(spark, path)

    def read(batches):
        for batch in batches:
            for text in batch.column(1):
                rows = [json.dumps(r) for r in edn(text.as_py())]
                for lo in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[lo : lo + 1000], pa.string())], names=["v"])

    return texts.mapInArrow(read, "v string").select(F.from_json("v", schema).alias("r")).select("r.*")
