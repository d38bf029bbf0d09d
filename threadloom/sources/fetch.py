"""Ingestion from outside: feed pages and paper files, fetched one after the other by the driver as their hosts ask for,
and put where Spark reads them. What is there already isn't fetched again.

`get` takes an address and returns bytes; it is a parameter so that mirrors, caches and tests can stand in.
"""

from __future__ import annotations

import hashlib
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from threadloom.sources.sinks import append_manifest

# The feed's address, rows of a page, seconds between requests.
FEED = "http://export.arxiv.org/api/query"
PAGE, PAUSE = 100, 3.0


def from_web(address: str) -> bytes:
    with urllib.request.urlopen(address, timeout=60) as response:
        return response.read()


def page_address(category: str, start: int, size: int = PAGE) -> str:
    asked = {"search_query": f"cat:{category}", "start": start, "max_results": size, "sortBy": "submittedDate", "sortOrder": "ascending"}
    return f"{FEED}?{urllib.parse.urlencode(asked, quote_via=urllib.parse.quote)}"


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, wherever Spark can write: whole or not at all, for it gets its name last."""
    fs, target = _file(spark, path)
    part = target.suffix(".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def there(spark: SparkSession, path: str) -> bool:
    fs, target = _file(spark, path)
    return fs.exists(target)


def fetch_feed(spark: SparkSession, category: str, folder: str, get: Callable[[str], bytes] = from_web, size: int = PAGE, pause: float = PAUSE) -> int:
    """Pages of a category as files start-<n>.xml under the folder, until the feed's total is reached; whole pages that are
    there are passed over, the last one, which may have grown, isn't. Returns how many were fetched."""
    start, fetched, total = 0, 0, None
    while total is None or start < total:
        path, following = f"{folder}/start-{start:09d}.xml", f"{folder}/start-{start + size:09d}.xml"
        if not (there(spark, path) and there(spark, following)):
            if fetched:
                time.sleep(pause)
            page = get(page_address(category, start, size))
            put(spark, path, page)
            fetched += 1
            found = re.search(rb"totalResults[^>]*>\s*(\d+)", page)
            total = int(found[1]) if found else 0
        start += size
    return fetched


def fetch_papers(spark: SparkSession, papers: Iterable[tuple[str, str]], folder: str, manifest: str, get: Callable[[str], bytes] = from_web, pause: float = PAUSE) -> DataFrame:
    """Files of papers (id, address) under the folder by the id's stem, .tar.gz for archives, .bin else; every attempt is a
    row of the manifest (id, status, path, bytes, sha256). A paper with a file is passed over. Returns the new rows."""
    rows = []
    for paper, address in papers:
        stem = re.sub(r"[^A-Za-z0-9._-]", "_", paper)
        if any(there(spark, f"{folder}/{stem}{end}") for end in (".tar.gz", ".bin")):
            continue
        if rows:
            time.sleep(pause)
        try:
            raw = get(address)
            path = f"{folder}/{stem}{'.tar.gz' if raw[:2] == b'\x1f\x8b' else '.bin'}"
            put(spark, path, raw)
            rows.append((paper, "ok", path, len(raw), hashlib.sha256(raw).hexdigest()))
        except OSError as e:  # a paper that can't be had is a row, and is tried again by the next run
            rows.append((paper, f"error: {type(e).__name__}", None, None, None))
    new = spark.createDataFrame(rows, "paper_id string, status string, path string, bytes long, sha256 string")
    if rows:
        append_manifest(new, manifest)
    return new


def fetch_archive(spark: SparkSession, address: str, folder: str, get: Callable[[str], bytes] = from_web, unpack: Callable[[bytes], dict[str, bytes]] | None = None) -> list[str]:
    """An archive's members as files under the folder; nothing is fetched where its mark is. `unpack` gives members by name;
    by default tar archives, compressed or not."""
    import io
    import tarfile

    def tar(raw: bytes) -> dict[str, bytes]:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
            return {m.name: t.extractfile(m).read() for m in t.getmembers() if m.isfile() and ".." not in m.name.split("/")}

    mark = f"{folder}/_FETCHED"
    if there(spark, mark):
        return []
    members = (unpack or tar)(get(address))
    for name, content in members.items():
        put(spark, f"{folder}/{name.lstrip('/')}", content)
    put(spark, mark, address.encode())
    return sorted(members)
