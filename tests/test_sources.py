import gzip
import io
import json
import tarfile

from threadloom.sources import dumps as D
from threadloom.sources import files as R
from threadloom.sources import sinks as K


def test_posts(spark, tmp_path):
    (tmp_path / "Posts.xml").write_text(
        '<?xml version="1.0"?>\n<posts>\n'
        '  <row Id="1" PostTypeId="1" AcceptedAnswerId="2" Score="3" Title="T" Body="&lt;p&gt;Is $x$ &amp;lt; 1?&lt;/p&gt;" Tags="|a|b|" AnswerCount="1" CreationDate="2020-01-01T00:00:00.000" />\n'
        '  <row Id="2" PostTypeId="2" ParentId="1" Score="-1" Body="no" CreationDate="bad" />\n  <row Id="3" PostTypeId="4" Body="wiki" />\n</posts>\n'
    )
    rows = {r.id: r for r in D.posts(spark, str(tmp_path / "Posts.xml")).collect()}
    assert set(rows) == {1, 2} and rows[1].tags == ["a", "b"] and rows[1].latex == ["x"] and rows[1].text == "Is $x$ < 1?"
    assert rows[2].ts is None and rows[2].parent_id == 1 and rows[2].score == -1
    assert D.posts(spark, str(tmp_path / "Posts.xml"), least=0).count() == 1


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"id": 1},\n{"id": 2}\n]\n')
    assert {r.id for r in D.json_array_lines(spark, str(tmp_path / "a.json"), "id long").collect()} == {1, 2}
    (tmp_path / "t.jsonl").write_text(json.dumps({"id": 5, "title": "x", "body": "b", "tags": ["t"], "score": 2, "answers": [{"id": 6, "body": "y"}], "comments": {"question": [{"id": 7, "text": "c"}], "answers": {"6": [{"id": 8, "text": "d"}]}}}) + "\nnot json\n")
    r = D.json_threads(spark, str(tmp_path / "t.jsonl")).where("id IS NOT NULL").collect()
    assert [(x.id, [c.id for c in x.comments]) for x in r] == [(5, [7, 8])]


def test_terms(spark, tmp_path):
    (tmp_path / "k.tsv").write_text("term_lower\tterm\tsource\tcanon\nring\tRing\tx\tRing\nshort\n")
    assert [tuple(r) for r in D.term_file(spark, str(tmp_path / "k.tsv")).collect()] == [("ring", "Ring", "Ring")]


def archive(**files) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name.replace("__", "."))
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(archive(main__tex=r"\begin{document}\input{b}\end{document}", b__tex="inside", c__txt="no"))
    (tmp_path / "b.gz").write_bytes(gzip.compress(rb"\section{x}"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 \\x")
    (tmp_path / "d.bin").write_bytes(b"\x00\x01")
    rows = {r.path.rsplit("/", 1)[1]: r for r in R.archives(spark, str(tmp_path)).collect()}
    assert rows["a.tar.gz"].text == r"\begin{document}inside\end{document}" and rows["a.tar.gz"].main == "main.tex"
    assert rows["b.gz"].status == "text" and rows["c.pdf"].status == "unreadable" and rows["d.bin"].text is None
    assert R.budgeted_source(archive(a__tex="12345", b__tex="1"), 3, 1) == ("ok", "123", 1)


def test_pages_and_edn(spark, tmp_path):
    for n, both in (("1", True), ("2", False)):
        (tmp_path / "p" / n).mkdir(parents=True)
        (tmp_path / "p" / n / "name").write_text(f"Page {n}\n")
        if both:
            (tmp_path / "p" / n / "content.md").write_text("text")
    assert [tuple(r) for r in R.sharded_pages(spark, str(tmp_path / "p")).collect()] == [("1", "Page 1", "text")]
    assert R.edn('[{:entity/id "a" :tags #{:x/y "b"} :n 3 :ok true :none nil}]') == [{"id": "a", "tags": ["y", "b"], "n": 3, "ok": True, "none": None}]
    (tmp_path / "e.edn").write_text('[{:a/id "x" :a/n 1} {:a/id "y"}]')
    assert [tuple(r) for r in R.edn_records(spark, str(tmp_path / "e.edn"), "id string, n int").collect()] == [("x", 1), ("y", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', ["x"], True)], "id long, t string, l array<string>, b boolean")
    assert K.edn_maps(df).first()["edn"] == '{:id 1, :t "a \\"q\\"", :l ["x"], :b true}'
    K.both(df, str(tmp_path / "t"), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 1
    n = spark.createDataFrame([("t1", "t1-q", "question"), ("t1", "t1-a2", "answer")], "thread_id string, node_id string, node_type string")
    e = spark.createDataFrame([("t1", "t1-a2", "t1-q", "assert")], "thread_id string, source string, target string, edge_type string")
    assert K.mermaid(n, e).first()["mermaid"].splitlines()[0] == "flowchart TD" and "-->|assert|" in K.mermaid(n, e).first()["mermaid"]
    assert '"t1-a2" -> "t1-q"' in K.graphviz(n, e).first()["dot"]
    assert "| parse | pass |" in K.markdown(spark.createDataFrame([("parse", "pass")], "gate string, status string"), "Run")


def test_feeds_and_papers_are_fetched_once(spark, tmp_path):
    """A feed that grows between two harvests, a paper that can't be had at first, an archive."""
    import io
    import tarfile
    import urllib.parse

    from threadloom.sources import dumps, fetch

    asked, total = [], 5

    def feed(address):
        asked.append(address)
        q = urllib.parse.parse_qs(urllib.parse.urlparse(address).query)
        start, size = int(q["start"][0]), int(q["max_results"][0])
        assert q["search_query"] == ["cat:math.CT"] and q["sortOrder"] == ["ascending"]
        entry = "<entry><id>http://x.org/abs/{0}v1</id><title>T {0}</title><summary>S</summary><published>2020-01-01T00:00:00Z</published><category term='math.CT'/></entry>"
        return f"<feed><os:totalResults xmlns:os='o'>{total}</os:totalResults>{''.join(entry.format(i) for i in range(start, min(total, start + size)))}</feed>".encode()

    assert fetch.fetch_feed(spark, "math.CT", f"{tmp_path}/feed", feed, size=2, pause=0) == 3
    assert fetch.fetch_feed(spark, "math.CT", f"{tmp_path}/feed", feed, size=2, pause=0) == 1 and len(asked) == 4
    total = 7
    fetch.fetch_feed(spark, "math.CT", f"{tmp_path}/feed", feed, size=2, pause=0)
    assert sorted(r.id for r in dumps.atom_entries(spark, f"{tmp_path}/feed").collect()) == [str(i) for i in range(7)]

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        info = tarfile.TarInfo("sub/a.xml")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    broken = {"http://x/b"}

    def get(address):
        if address in broken:
            raise OSError("no")
        return raw.getvalue() if address == "http://x/a" else b"plain"

    papers = [("a/1", "http://x/a"), ("b", "http://x/b")]
    rows = fetch.fetch_papers(spark, papers, f"{tmp_path}/papers", f"{tmp_path}/manifest", get, pause=0).collect()
    assert [(r.paper_id, r.status) for r in rows] == [("a/1", "ok"), ("b", "error: OSError")] and rows[0].path.endswith("a_1.tar.gz")
    broken.clear()
    again = fetch.fetch_papers(spark, papers, f"{tmp_path}/papers", f"{tmp_path}/manifest", get, pause=0).collect()
    assert [(r.paper_id, r.status, r.bytes) for r in again] == [("b", "ok", 5)]
    assert spark.read.json(f"{tmp_path}/manifest").count() == 3
    assert fetch.fetch_papers(spark, papers, f"{tmp_path}/papers", f"{tmp_path}/manifest", get, pause=0).count() == 0
    assert fetch.fetch_archive(spark, "http://x/a", f"{tmp_path}/dump", get) == ["sub/a.xml"] and fetch.fetch_archive(spark, "http://x/a", f"{tmp_path}/dump", get) == []
    assert spark.read.text(f"{tmp_path}/dump/sub").first().value == "abc"
