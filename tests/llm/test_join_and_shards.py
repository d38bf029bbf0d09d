"""Jaccard join, components, shards, mix."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from brute import AWKWARD, awkward, components, shingles
from pyspark.sql import functions as F

from threadloom.llm import components as cc
from threadloom.llm import jaccard_join as J
from threadloom.llm import queries
from threadloom.llm import source_mix as M
from threadloom.llm.uniform_shards import communication_matrix, hypergeometric, uniform_shards


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    want = {}
    for a, b in links:
        for x in (a, b):
            want.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(want[a], want[b])
            if want[a] != m or want[b] != m:
                want[a] = want[b] = m
                changed = True
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {n: m for n, m in want.items() if n != m}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def groups(rows: list[tuple[int, str]], seed: int):
    """Documents with near copies of several distances, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 5000}"
    passage = [word() for _ in range(30)]
    for g in range(25):
        base = [word() for _ in range(rng.choice([2, 4, 9, 40, 150]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = [w if rng.random() > rng.choice([0, 0.005, 0.02, 0.05]) else word() for w in base]
            if rng.random() < 0.3:
                copy = passage + copy
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("length,num,cell", [(3, 90, 4096), (3, 90, 8), (5, 80, 4096), (5, 80, 8), (2, 100, 4096), (3, 50, 16)])
def test_join_equals_brute_force(spark, monkeypatch, length, num, cell):
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "BUCKET", max(4, cell // 2))
    monkeypatch.setattr(J, "LIST", 512 if cell > 8 else 2)  # 2: nearly all lists are cut into ranges
    rows = groups([], length * num)
    want = components(rows, length, num)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, num).collect()}
    assert got == {i: (want[i], len(shingles(t, length))) for i, t in rows}


def test_hot_tokens_are_dealt_out(spark, monkeypatch):
    """A token of every second document, and many others, counted as hot: links are those of brute force."""
    monkeypatch.setattr(J, "HOT_PART", 1)
    monkeypatch.setattr(J, "HOT_ROWS", 6)
    rows = [(i, t if i % 2 else f"alpha beta gamma delta epsilon {t}") for i, t in groups([], 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(J.hot_tokens(df, J.Rule(80, 100), 3)) > 5
    want = components(rows, 3, 80)
    assert {r.doc_id: r.component_id for r in J.jaccard_components(df, 3, 80).collect()} == {i: want[i] for i, _ in rows}


def test_runs_of_hot_tokens():
    """Whole, in parts, in one batch and in many: all rows of a hot token are kept, with the greatest count."""
    import pyarrow as pa

    rows = sorted([(5, h) for h in range(4)] + [(7, 1)] + [(8, 2), (8, 2)] + [(9, 3), (9, 4)] + [(11, 6)])
    for size in (1, 2, 3, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in b], pa.int64()), pa.array([h for _, h in b], pa.int64())], names=["token", "h"]) for b in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = sorted((r["token"], r["h"], r["cnt"]) for out in J._shared_runs(batches, np.array([7, 9, 11])) for r in out.to_pylist())
        most = J.MOST_COUNTED
        assert got == [(5, 0, 4), (5, 1, 4), (5, 2, 4), (5, 3, 4), (7, 1, most), (9, 3, most), (9, 4, most), (11, 6, most)]


def test_join_of_awkward_rows(spark):
    root = components(AWKWARD, 5, 80)
    least = {}
    for i, r in root.items():
        if AWKWARD[i][0] is not None and shingles(AWKWARD[i][1], 5):
            least[r] = min(least.get(r, 2**63), AWKWARD[i][0])
    want = sorted((str(d), str(least.get(root[i]) if shingles(t, 5) else d), len(shingles(t, 5))) for i, (d, t, *_) in enumerate(AWKWARD))
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in J.jaccard_components(awkward(spark)).collect()) == want
    assert J.jaccard_components(awkward(spark).limit(0)).count() == 0
    kept = J.one_of_each(awkward(spark)).collect()
    assert len(kept) == len({root[i] for i, (_, t, *_) in enumerate(AWKWARD) if shingles(t, 5)}) + sum(not shingles(t, 5) for _, t, *_ in AWKWARD)
    assert kept[0].label == 7


def test_index_skips_nothing_that_links():
    rng = np.random.default_rng(2)
    rule = J.Rule(80, 100)
    base = np.unique(rng.integers(0, 2**40, 60))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 2**40, rng.integers(0, 8))])) for _ in range(120)]
    prefixes = [(s[: rule.prefix(len(s))], np.arange(rule.prefix(len(s)))) for s in sets]
    index = J.Index(sets, prefixes, rule)
    nodes = np.arange(120)
    a, b = J.search(index, [(s, *p) for s, p in zip(sets, prefixes, strict=True)], True, nodes, nodes, nodes.copy(), nodes)
    rows = [(i, " ".join(f"{x}" for x in s)) for i, s in enumerate(sets)]
    got = {n: int(m) for n, m in zip(*(x.tolist() for x in cc.contract(np.array(a), np.array(b))), strict=True)} if a else {}
    want = components(rows, 1, 80)
    assert {i: got.get(i, i) for i in range(120)} == want


@pytest.mark.parametrize("kept", [256, 1])
def test_answers_are_derived_from_similar_sets(monkeypatch, kept):
    """Two families that share much but don't link: a copy's overlaps with the other family come from its twin's."""
    monkeypatch.setattr(J, "KEPT", kept)
    rng, rule = np.random.default_rng(7), J.Rule(80, 100)
    core = rng.integers(0, 2**40, 70)
    sets = [np.unique(np.concatenate([core, rest])) for rest in (rng.integers(0, 2**40, 20) for _ in range(6)) for _ in range(1)]
    sets = [np.unique(np.append(s, rng.integers(0, 2**40, 2))) for s in sets for _ in range(5)]
    prefixes = [(s[: rule.prefix(len(s))], np.arange(rule.prefix(len(s)))) for s in sets]
    nodes, tally = np.arange(len(sets)), collections.Counter()
    a, b = J.search(J.Index(sets, prefixes, rule), [(s, *p) for s, p in zip(sets, prefixes, strict=True)], True, nodes, nodes, nodes.copy(), nodes, tally)
    got = {n: int(m) for n, m in zip(*(x.tolist() for x in cc.contract(np.array(a), np.array(b))), strict=True)}
    assert {i: got.get(i, i) for i in nodes.tolist()} == components([(i, " ".join(map(str, s))) for i, s in enumerate(sets)], 1, 80)
    assert tally["derived"] > 0 and (kept == 1 or tally["derived"] > tally["counted"] / 2)


def test_answers_are_derived_on_the_documents(sf):
    """The sets of the given documents in one cell, as the query has them: some answers come from similar sets."""
    import pyarrow.parquet as pq

    rule, tally, sets = J.Rule(90, 100), collections.Counter(), {}
    for t in pq.read_table(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")["text"].to_pylist():
        s = J.shingle_set(t, 3)
        if len(s):
            sets[s.tobytes()] = s
    sets = sorted(sets.values(), key=lambda s: (s[:2].tolist(), len(s)))
    prefixes = [(s[: rule.prefix(len(s))], np.arange(rule.prefix(len(s)))) for s in sets]
    nodes = np.arange(len(sets))
    J.search(J.Index(sets, prefixes, rule), [(s, *p) for s, p in zip(sets, prefixes, strict=True)], True, nodes, nodes, nodes.copy(), nodes, tally)
    print(tally)
    assert tally["derived"] > 0


def test_join_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    root = components(rows, 3, 90)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = sorted((d, len(shingles(t, 3)), least[root[i]]) for i, (d, t) in enumerate(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op9_jaccard_join(spark, sf).collect()) == want


def test_cells_are_cut_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL_TOKENS", 300)
    monkeypatch.setattr(J, "BUCKET_TOKENS", 100)
    rows = groups([], 11)
    want = components(rows, 3, 80)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 80).collect()}
    assert got == {i: want[i] for i, _ in rows}


def test_shards(spark):
    rows = uniform_shards(awkward(spark), 4).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [3, 3, 4, 4] and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t, *_ in AWKWARD)
    assert uniform_shards(awkward(spark).limit(0), 4).count() == 0 and uniform_shards(awkward(spark).limit(1), 4).count() == 1


def test_shards_agree_and_spread(spark):
    df = spark.range(9000).withColumn("text", F.concat(F.lit("t"), (F.col("id") % 7).cast("string")))
    a = {r.id: (r.shard, r.slot) for r in uniform_shards(df.repartition(3), 40, rows=512).collect()}
    assert a == {r.id: (r.shard, r.slot) for r in uniform_shards(df.repartition(11), 40, rows=512).collect()}
    counts = collections.Counter(s for s, _ in a.values())
    assert set(counts.values()) == {225}
    assert abs(np.corrcoef(list(a), [s for s, _ in a.values()])[0, 1]) < 0.05 and abs(np.corrcoef(list(a), [s for _, s in a.values()])[0, 1]) < 0.05


def test_matrix_has_exact_margins_and_hypergeometric_spread(spark):
    parts = spark.createDataFrame([(i, 100 + i) for i in range(50)], "part long, n long")
    total = sum(100 + i for i in range(50))
    m = {r.part: r.counts for r in communication_matrix(parts, total, 10, seed=3).collect()}
    assert {p: sum(c) for p, c in m.items()} == {i: 100 + i for i in range(50)}
    assert np.sum(list(m.values()), axis=0).tolist() == [total // 10 + (s < total % 10) for s in range(10)]
    z = [(n - (100 + p) / 10) / np.sqrt((100 + p) * 0.09 * (1 - (100 + p) / total)) for p, c in m.items() for n in c]
    assert 0.8 < np.std(z) < 1.2
    uneven = communication_matrix(spark.createDataFrame([(0, 1), (300, 2), (4999, 0)], "part long, n long"), 3, 2, seed=1).collect()
    assert {r.part: sum(r.counts) for r in uneven} == {0: 1, 300: 2, 4999: 0}


def test_draws_have_the_law_of_the_urn(spark):
    """Against the probabilities by binomial coefficients, small and lopsided urns."""
    n = 8000
    for good, total, draws in [(20, 100, 30), (1, 7, 3), (5, 5, 2), (0, 9, 4), (999, 1000, 500), (3, 10, 10)]:
        u = F.col("id") / n  # evenly spread: counts come out as the law has them
        held = spark.range(n).select(u.alias("u"), *(F.lit(x).cast("long").alias(c) for c, x in (("g", good), ("t", total), ("k", draws))))
        counts = {r["x"]: r["count"] for r in held.select(hypergeometric(*map(F.col, "ugtk")).alias("x")).groupBy("x").count().collect()}
        law = {i: math.comb(good, i) * math.comb(total - good, draws - i) / math.comb(total, draws) for i in range(good + 1) if 0 <= draws - i <= total - good}
        assert set(counts) <= set(law) and all(abs(counts.get(i, 0) / n - p) < 1.1 / n for i, p in law.items())


def test_shards_of_rows_that_are_all_equal(spark):
    """A third of all rows, in many tasks; every row keeps a place of its own."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit("t").alias("text")).repartition(6)
    rows = uniform_shards(df, 7, rows=512).collect()
    assert sum(r.id == -1 for r in rows) == 3000 and len({(r.shard, r.slot) for r in rows}) == 9000
    assert collections.Counter(r.shard for r in rows if r.id == -1).most_common()[0][1] < 600


def test_targets():
    assert M.targets([10, 10], [1, 1], 30, 2) == [15, 15]
    assert M.targets([1, 100], [3, 1], 150, 2) == [2, 148]
    assert M.targets([0, 0], [3, 1], 0, 2) == [0, 0] and M.targets([], [], 0, 2) == []


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(M.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_shard_counts_spend_everything():
    c = M.shard_counts([100, 0, 900], 64, 1)
    assert np.sum(c, axis=0).tolist() == [100, 0, 900] and {sum(r) for r in c[:-1]} == {64}


@pytest.mark.parametrize("block", [4, 512])
def test_mix(spark, block):
    df = awkward(spark).drop("size").withColumn("size", M.word_count("text")).select("doc_id", "source", "size", "lang")
    rows = M.Mix(df, block=block).taken("doc_id", "source", "size", "source_size", "target").collect()
    again = M.Mix(df.repartition(5), block=block).taken("doc_id", "source", "size", "source_size", "target").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(AWKWARD) and all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sizes == {s: sum(len((t or "").encode().split()) for _, t, _, x in AWKWARD if x == s) for s in sizes}
    names = sorted([s for s in sizes if s is not None]) + [None]
    assert [target[s] for s in names] == pytest.approx(M.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert M.Mix(df.limit(0)).taken("doc_id").count() == 0


def test_mix_equals_brute_force(spark, sf):
    """The query against words counted one by one: every slot's block of its source's stream, in order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", M.word_count("text").alias("size"))
    mix = M.Mix(docs)
    streams, taken = collections.defaultdict(list), collections.Counter()
    for r in mix.documents.orderBy("_tl_key", "_tl_start").collect():
        assert r["_tl_start"] == len(streams[r["_tl_key"]])
        streams[r["_tl_key"]] += [r.doc_id] * r.size
    for s in mix.slots.collect():
        taken.update(streams[s["_tl_key"]][s["_tl_block"] * M.BLOCK :][: s.words])
    rows = queries.op4_source_mix(spark, sf).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: taken[r.doc_id] for r in rows}
    total, names = sum(r.size for r in rows), sorted({r.source for r in docs.collect()})
    sizes = {n: sum(r.size for r in docs.collect() if r.source == n) for n in names}
    want = dict(zip(names, M.targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * total, 2), strict=True))
    of = {r.doc_id: r.source for r in docs.collect()}
    assert all(r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == sizes[of[r.doc_id]] and r.taken <= 2 * r.size for r in rows)


def test_mix_texts(spark):
    df = awkward(spark).withColumn("n_chars", F.length("text").cast("long"))
    rows = M.mix_texts(df, block=5).collect()
    whole = {(str(i), t) for i, t, *_ in AWKWARD}
    words = collections.Counter()
    for r in rows:
        assert any(i == str(r.doc_id) and t and r.text in t for i, t in whole) and r.n_chars == len(r.text) and r.label == 7
        words[r.source] += len(r.text.encode().split())
    taken = collections.Counter()
    for r in M.Mix(df.select("source", M.word_count("text").alias("size")), block=5).taken("source").collect():
        taken[r.source] += r.taken
    assert {s: n for s, n in taken.items() if n} == dict(words)
    assert M.mix_texts(df.limit(0)).count() == 0


def test_shard_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_uniform_shards(spark, sf).collect():
        assert r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.size == len(docs[r.doc_id].encode()) + 16 and r.law == "rows" and r.grown_shard is None


def test_join_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE["op9_jaccard_join"]).fetchall()
    assert sorted(map(tuple, queries.op9_jaccard_join(spark, sf).collect())) == sorted(want)


@pytest.mark.parametrize("num", [75, 80, 90, 95])
def test_linked_sets_share_a_signature(num):
    """Pairs at the rule's very bound, of all sizes, also across intervals: one signature at least in common."""
    rng, rule, crossed = np.random.default_rng(num), J.Rule(num, 100), 0
    for n in [*range(1, 60), 100, 333, 1000, *rng.integers(60, 3000, 40).tolist()]:
        for m in {n, n * 100 // num, int(rng.integers(n, n * 100 // num + 1))}:
            both = rule.least_overlap(n, m)
            a = rng.integers(-(2**63), 2**63 - 1, n)
            b = np.concatenate([a[:both], rng.integers(-(2**63), 2**63 - 1, m - both)])
            a, b = np.sort(a), np.sort(b)
            if both <= n and 100 * both >= num * (n + m - both) and a.tolist() != b.tolist():
                assert np.intersect1d(rule.signatures(a), rule.signatures(b)).size, (n, m)
                crossed += J.bisect_right(rule.bounds, n) != J.bisect_right(rule.bounds, m)
    assert crossed > 20


def test_sets_of_chance_tokens_share_no_signature():
    """Sets of a small vocabulary, whose tokens are all shared: by single tokens they would make one group."""
    rng, rule = np.random.default_rng(3), J.Rule(90, 100)
    words = np.unique(rng.integers(-(2**63), 2**63 - 1, 20_000))
    sets = [np.sort(rng.choice(words, n, replace=False)) for n in rng.integers(100, 800, 400)]
    seen = collections.Counter(x for s in sets for x in rule.signatures(s).tolist())
    assert sum(n > 1 for n in seen.values()) < 0.001 * len(seen)
