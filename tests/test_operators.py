import math

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import events as H
from threadloom.operators import evaluation as E
from threadloom.operators import graph as G
from threadloom.operators import hypergraph as Y
from threadloom.operators import intervals as I
from threadloom.operators import lexicon as L
from threadloom.operators import sampling as P
from threadloom.operators import threads as T
from threadloom.operators import vectors as V

POSTS = [
    (1, "question", None, 2, 10, 1, "q1"), (2, "answer", 1, None, 7, 2, "a"), (3, "answer", 1, None, 9, 3, "However, no"), (4, "question", None, None, 5, 4, "q4"),
    (5, "answer", 4, None, 3, 5, "x"), (6, "answer", 4, None, 3, 6, "y"), (7, "question", None, None, -2, 7, "low"), (8, "question", None, 3, 1, 8, "foreign"), (9, "answer", 8, None, 0, 9, "z"),
]
SCHEMA = "id long, kind string, parent_id long, accepted_id long, score int, seq long, body string"


def test_best_answers(spark):
    p = spark.createDataFrame(POSTS, SCHEMA)
    assert {tuple(r)[:2] for r in T.best_answers(p).collect()} == {(1, 2), (4, 5), (8, 9)}
    assert {tuple(r)[:2] for r in T.best_answers(p, any_accepted=True).collect()} == {(1, 2), (4, 5), (8, 3)}
    assert T.best_answers(p.limit(0)).count() == 0


def test_threads(spark):
    p = spark.createDataFrame(POSTS, SCHEMA)
    c = spark.createDataFrame([(101, 1), (102, 3), (103, 99)], "id long, post_id long")
    t = {r.question_id: r for r in T.assemble_threads(p, c).collect()}
    assert [a.id for a in t[1].answers] == [3, 2] and [x.id for x in t[1].comments] == [101, 102]
    assert 7 not in t and t[8].comments == []


def test_wiring(spark):
    p = spark.createDataFrame(POSTS, SCHEMA)
    c = spark.createDataFrame([(101, 1, "for example"), (102, 3, "plain")], "id long, post_id long, text string")
    n = T.wiring_nodes(p, c)
    e = T.wiring_edges(n)
    got = {(r.source, r.target): (r.edge_type, r.detection) for r in e.collect()}
    assert got["t1-a3", "t1-q"] == ("challenge", "classical") and got["t1-a2", "t1-q"] == ("assert", "structural")
    assert got["t1-c101", "t1-q"] == ("exemplify", "classical") and got["t1-c102", "t1-a3"] == ("comment-on", "structural")
    assert T.hyperedges(e, n).where("hx_id = 't1:edge-000'").count() == 1


def test_spotting(spark):
    k = L.kernel(spark.createDataFrame([("ring", "Ring", "Ring"), ("of rings", "of rings", "X"), ("$x", "x", "x"), ("ab", "ab", "ab"), ("kan extension", "Kan extension", "KE")], "term_lower string, term string, canon string"))
    t = spark.createDataFrame([(1, "A ring, a Kan extension."), (2, "kan extensions of rings"), (3, None), (4, "")], "id long, text string")
    assert {tuple(r)[:2] for r in L.spot(t, k).collect()} == {(1, "ring"), (1, "kan extension"), (2, "kan extension"), (2, "of rings")}
    assert L.coverage(t, L.spot(t, k)).first()["coverage"] == 0.5


def test_intervals(spark):
    heads = spark.createDataFrame([("p", 0, "One"), ("p", 10, "Two")], "k string, pos long, section string")
    rows = spark.createDataFrame([("p", 10), ("p", 9), ("q", 3)], "k string, pos long")
    assert {(r.k, r.pos): r.section for r in I.enclosing(rows, heads, "k", "section").collect()} == {("p", 10): "Two", ("p", 9): "One", ("q", 3): None}
    ranges = spark.createDataFrame([("p", 0, 20, "a"), ("p", 5, 12, "b")], "k string, start long, end long, name string")
    got = I.first_containing(rows, ranges, "k", ["name"]).collect()
    assert {(r.k, r.pos): r.name for r in got} == {("p", 10): "a", ("p", 9): "a", ("q", 3): None}


def test_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert [r.node for r in G.shortest_path(e, "a", "d").collect()] == ["a", "b", "c", "d"]
    assert G.shortest_path(e, "a", "y").count() == 0
    assert {r.node: r.distance for r in G.layers(e, "a", 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node for r in G.reach(e, spark.createDataFrame([("c",)], "node string"), 10).collect()} == {"a", "b", "c", "d"}


def test_cooccurrence(spark):
    m = spark.createDataFrame([(i, t) for i in range(3) for t in "ab"] + [(9, "c"), (9, "a")], "entity long, term string")
    assert {tuple(r) for r in G.cooccurrence(m, 3).collect()} == {("a", "b", 3), ("b", "a", 3)}


def test_impulse_fit_converges(spark):
    rng = np.random.default_rng(1)
    x, rows = 5.0, []
    for b in range(120):
        t = int(rng.random() < 0.3)
        rows.append((7, b, float(x), t))
        x = x + 0.6 * (4 - x) + 2.0 * t + rng.normal(0, 0.3)
    r = H.impulse_fit(spark.createDataFrame(rows, "user_id long, bin long, x double, treated int")).first()
    assert r.converged and abs(r.kick - 2) < 0.4 and abs(r.theta - 0.6) < 0.2


def test_capped_selection_is_greedy(spark):
    rows = [(i, "k" + str(i % 2 if i < 15 else 2), float(100 - i)) for i in range(30)]
    got = {r.id for r in P.capped_selection(spark.createDataFrame(rows, "id long, kind string, score double"), "kind", "score", "id", 9).collect()}
    want, seen = [], {}
    for i, k, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(want) < 9 and seen.get(k, 0) < 4:
            want.append(i)
            seen[k] = seen.get(k, 0) + 1
    assert got == set(want)


def test_theorems(spark):
    source = r"\section{Intro}\begin{lemma}\label{l}Body \ref{x}\end{lemma} % note" "\n" r"\begin{proof}Yes\end{proof}\begin{theorem}[Big]T\end{theorem} and now a long stretch of text that keeps the next proof far away \begin{proof}No\end{proof}"
    t = {r.env: r for r in Y.theorem_records(spark.createDataFrame([("p", source)], "paper_id string, source string")).collect()}
    assert t["lemma"].proof == "Yes" and t["lemma"].theorem_id == "p::l" and t["lemma"].refs == ["x"] and t["lemma"].section == "Intro"
    assert t["theorem"].name == "Big" and not t["theorem"].has_proof and t["theorem"].number_hint == 1


def test_message_passing(spark):
    s = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 2.0])], "graph_id long, node string, h array<double>")
    e = spark.createDataFrame([(1, "r", "a", "b")], "graph_id long, relation string, src string, dst string")
    out = {r.node: r.h for r in V.message_pass(s, e, {"r": [[2.0, 0.0], [0.0, 1.0]]}, [[1.0, 0.0], [0.0, 1.0]], [0.0, -1.0]).collect()}
    assert out == {"a": [1.0, 0.0], "b": [2.0, 1.0]}
    assert V.contrastive_loss(np.eye(4), np.eye(4)) < V.contrastive_loss(np.eye(4), np.eye(4)[::-1])


def test_gates(spark):
    one = spark.createDataFrame([(0.01, 0.3, 25)], "scope_coverage double, empty_rate double, ready_terms int")
    assert {tuple(r) for r in E.internal_gates(one).collect()} == {("scope_coverage", "warn"), ("empty_rate", "fail"), ("ready_terms", "pass")}


def test_lexicon_relations(spark):
    e = spark.createDataFrame([("a", ["b"], ["Big Ring"], ["18A"])], "id string, related array<string>, defines array<string>, codes array<string>")
    assert {tuple(r) for r in L.relations(e).collect()} == {("related-to", "a", "b"), ("defines", "a", "term-big-ring"), ("classified-by", "a", "msc-18A")}
    assert L.class_entities(e).first()["parent"] == "18"
    assert L.categorical(spark.createDataFrame([(1, "an adjoint functor of a monad")], "id long, text string"), spark.createDataFrame([("cat/adjunction", "adjoint", "required"), ("cat/adjunction", "functor", "typical"), ("cat/monad", "functor", "typical")], "pattern string, term string, kind string"), spark.createDataFrame([(1, "adjunction")], "id long, tag string"), spark.createDataFrame([("cat/adjunction", "adjoint functor")], "pattern string, regex string")).where(F.col("pattern") == "cat/adjunction").first()["score"] == 5.5


def test_acts_and_ports(spark):
    rows = [("assert", ["wire/causal"], "x", True), ("assert", [], "x", False), ("challenge", [], "why?", True), ("clarify", [], "In other words", True), ("query", [], "x", True), ("", [], "x", False), (None, [], "x", False), ("retract", [], "my mistake", True), ("reference", [], "x", False)]
    df = spark.createDataFrame(rows, "act string, d array<string>, t string, want boolean")
    got = df.select("want", E.act_fits(F.col("act"), F.array(F.lit("none")), F.col("d"), F.col("t"), F.lit("answer")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    pairs = [("bind/let", "assume/x", True), ("assume/x", "bind/let", False), ("quant/a", "constrain/b", True), ("env/a", "env/b", False), ("", "", False), (None, "bind/let", False)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", E.port_compatible(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_enrichment(spark):
    e = spark.createDataFrame([("a", r"\emph{ring} \emph{Group} \PMlinkname{x}{Known} \PMlinkname{y}{New}", ["Known"], ["group"]), ("b", "", None, None)], "id string, body string, related array<string>, defines array<string>")
    r = {x.id: x for x in L.enrich(e).collect()}
    assert r["a"].new_terms == ["ring", "Known", "New"] and [x.target for x in r["a"].implicit_relations] == ["New"] and r["b"].new_terms == []
    assert L.enrichment_stats(L.enrich(e)).first()["with_implicit"] == 1


def test_probed_neighbours_are_found(spark, sf):
    """At least 0.9 of the true ten nearest."""
    from threadloom.queries import QUERIES

    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    true = {(r.query_id, r.vec_id) for r in V.nearest(v, q, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in QUERIES["probed_neighbours"](spark, sf).collect()}
    assert true and len(true & got) >= 0.9 * len(true), len(true & got) / len(true)


def test_reach_has_no_bound(spark):
    e = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(23)] + [("c23", "c0"), ("x", "y")], "src string, dst string")
    assert {r.node for r in G.reach(e, spark.createDataFrame([("c0",)], "node string")).collect()} == {f"c{i}" for i in range(24)}


def test_well_formed_follows_each_root(spark):
    def ruled(nodes, edges):
        r = G.well_formed(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")).first()
        return r.well_formed, r.asDict().get("stuck")

    cycles = [("r1", "a"), ("r2", "a"), ("a", "b"), ("b", "a")]
    assert ruled("r1 r2 a b r3 s".split(), [*cycles, ("r3", "s")]) == (False, 2)  # two of three roots end in a cycle
    assert ruled("r1 a b r3 s".split(), [("r1", "a"), ("a", "b"), ("b", "a"), ("r3", "s")]) == (True, 1)  # half of the roots
    assert ruled("r s o".split(), [("r", "s")]) == (True, 0)  # one orphan of three
    assert ruled("r s o p q".split(), [("r", "s")]) == (False, 0)  # three of five
    assert ruled("a b".split(), [("a", "b"), ("b", "a")]) == (False, 0)
    assert ruled([], [("a", "b")])[0] is False


def test_impulse_fit_relaxes_where_nobody_has_enough(spark):
    """Six events and three treatments for user 1, fewer for the others; with a user of 20 and 10, only that one."""
    few = [(1, i, float(i % 2), int(i in (1, 4, 9))) for i in range(12)] + [(2, i, float(i < 4), int(i in (1, 4, 9))) for i in range(12)] + [(3, i, 1.0, int(i == 5)) for i in range(12)]
    many = [(4, i, 2.0 - i % 2, i % 2) for i in range(24)]
    users = lambda rows: {r.user_id for r in H.impulse_fit(spark.createDataFrame(rows, "user_id long, bin long, x double, treated int")).collect()}
    assert users(few) == {1}
    assert users(few + many) == {4}


def test_one_entity_with_many_terms(spark, monkeypatch):
    """Pairs of an entity in several grains equal those of a plain double loop."""
    from collections import Counter
    from itertools import permutations

    from threadloom.operators import graph as G

    monkeypatch.setattr(G, "GRAIN", 7)
    rows = [("big", f"t{i}") for i in range(60)] + [(f"e{i}", f"t{j}") for i in range(9) for j in range(i, i + 4)] + [("big", "t1"), (None, "t1"), (None, "t2")]
    want = Counter(p for e in {r[0] for r in rows} - {None} for p in permutations({t for x, t in rows if x == e}, 2))
    got = {(r.src, r.dst): r.n for r in G.cooccurrence(spark.createDataFrame(rows, "entity string, term string"), 2, most_terms=None).collect()}
    assert got == {p: n for p, n in want.items() if n >= 2} and got


def test_points_in_nested_and_repeated_ranges(spark):
    import random

    from threadloom.operators.intervals import first_containing

    rng = random.Random(4)
    ranges = [(rng.randrange(3), a, a + rng.choice([0, 1, 3, 8, 30]), i) for i in range(60) for a in [rng.randrange(50)]]
    ranges += ranges[:5] + [(0, 0, 100, 99), (0, 0, 100, 98)]
    points = [(rng.randrange(4), rng.randrange(-2, 60), i % 50) for i in range(300)]
    want = sorted((k, p, i, min(((a, b, c) for q, a, b, c in ranges if q == k and a <= p < b), default=(0, 0, -1))[2]) for k, p, i in points)
    found = first_containing(spark.createDataFrame(points, "k int, pos int, id int"), spark.createDataFrame(ranges, "k int, start int, end int, idx int"), "k", ["idx"])
    assert found.columns == ["k", "pos", "id", "idx"] and sorted((r.k, r.pos, r.id, -1 if r.idx is None else r.idx) for r in found.collect()) == want


def test_substrings_meet_by_their_first_characters(spark):
    from threadloom.operators.lexicon import substring_join

    texts = [(1, "the cat, the car"), (2, "é ab"), (3, ""), (4, "aaab"), (5, None), (1, "the cat, the car")]
    terms = [("a", 1), ("ab", 2), ("car", 3), ("e ca", 4), ("é", 5), ("", 6), ("the cat, the car!", 7), ("ab", 8)]
    got = sorted((r.id, r.term, r.n) for r in substring_join(spark.createDataFrame(texts, "id int, low string"), spark.createDataFrame(terms, "term string, n int")).collect())
    assert got == sorted((i, t, n) for i, x in texts for t, n in terms if t and t in (x or ""))


def test_words_are_trimmed_in_one_pass(spark):
    import re

    from threadloom.functions.text import tokens

    texts = ["(a) 'b.c', [D]!\n\t..x..y..  ''  e;f 1.5.", "", "  ", ".", "don't \"stop\"", "é. Ünder x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens("t").alias("w"))
    want = {i: [w for w in (x.strip(".,;:!?()[]\"'") for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower())) if w] for i, t in enumerate(texts)}
    assert {r.i: r.w for r in df.collect()} == want


def test_metrics_count_the_better(spark):
    from threadloom.operators.vectors import retrieval_metrics

    scores = [(0, 1, 0.9), (0, 2, 0.9), (0, 3, 0.1), (1, 1, 0.5), (1, 2, 0.7), (2, 9, 0.1)]
    got = retrieval_metrics(spark.createDataFrame(scores, "query_id int, vec_id int, score double"), spark.createDataFrame([(0, 2), (1, 2), (2, 7)], "query_id int, vec_id int")).first()
    assert (got.acc_at_1, got.acc_at_5, got.mrr) == (0.5, 1.0, 0.75)


def test_all_papers_take_part_without_a_sample(spark):
    from threadloom.operators.evaluation import scope_neighbours

    rows = [(i, "x", [f"s{i // 2}"]) for i in range(900)]
    assert scope_neighbours(spark.createDataFrame(rows, "paper_id int, category string, scopes array<string>"), sample=None).count() == 900


def test_graph_encoder_equals_plain_matrices(spark):
    """Two relational layers, mean, projection and unit length, against numpy."""
    import numpy as np

    from threadloom.operators import vectors as V

    rng = np.random.default_rng(2)
    sizes, relations = {0: 4, 1: 1, 2: 7}, ["a", "b"]
    states = {(g, i): rng.normal(size=3) for g, n in sizes.items() for i in range(n)}
    edges = [(g, relations[int(rng.integers(2))], int(rng.integers(n)), int(rng.integers(n))) for g, n in sizes.items() for _ in range(2 * n - 2)]
    layers = [({r: rng.normal(size=(3, 3)).tolist() for r in relations}, rng.normal(size=(3, 3)).tolist(), rng.normal(size=3).tolist()) for _ in range(2)]
    projection = rng.normal(size=(2, 3))
    h = dict(states)
    for weights, own, bias in layers:
        new = {}
        for (g, i), x in h.items():
            into = [np.array(weights[r]) @ h[g, s] for q, r, s, d in edges if (q, d) == (g, i)]
            new[g, i] = np.maximum(0, (sum(into) / len(into) if into else 0) + np.array(own) @ x + np.array(bias))
        h = new
    want = {}
    for g, n in sizes.items():
        mean = np.mean([h[g, i] for i in range(n)], axis=0)
        mean = mean / (np.linalg.norm(mean) or 1)
        z = projection @ mean
        want[g] = z / (np.linalg.norm(z) or 1)
    s = spark.createDataFrame([(g, str(i), x.tolist()) for (g, i), x in states.items()], "graph_id int, node string, h array<double>")
    e = spark.createDataFrame([(g, r, str(a), str(b)) for g, r, a, b in edges], "graph_id int, relation string, src string, dst string")
    got = {r.graph_id: r.embedding for r in V.encoded(s, e, layers, projection.tolist()).collect()}
    assert all(np.allclose(got[g], want[g]) for g in sizes) and len(got) == 3


def test_clusters_and_fits_find_what_is_there(spark):
    """Three bundles of directions; users whose events jump after a treatment and fall back."""
    import numpy as np

    from threadloom.operators import vectors as V

    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(6)[i % 3] + rng.normal(size=6) * 0.05).tolist()) for i in range(90)]
    found = V.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3)[0].collect()
    assert len({(r.vec_id % 3, r.cluster) for r in found}) == 3
    flat = [(i, np.concatenate([rng.normal(size=2) * 10, rng.normal(size=4) * 0.01]).tolist()) for i in range(300)]
    assert V.effective_dimensions(spark.createDataFrame(flat, "vec_id long, embedding array<double>")) == [2, 2]
    texts = [(1, "alpha beta gamma"), (2, "beta alpha gamma"), (3, "other words entirely")]
    v = {r.vec_id: np.array(r.embedding) for r in V.hashed_text_vectors(spark.createDataFrame(texts, "vec_id int, text string")).collect()}
    assert np.allclose(v[1], v[2]) and abs(v[1] @ v[3]) < 0.5 and abs(np.linalg.norm(v[1]) - 1) < 1e-9


def test_encoder_training(spark):
    """Gradients against differences; the loss falls; the weights give the same vectors in Spark."""
    import numpy as np

    from threadloom.operators import training as R
    from threadloom.operators import vectors as V

    rng = np.random.default_rng(1)
    nodes, edges = [], []
    for g in range(60):
        n = 3 + g % 7
        nodes += [(g, str(i), (i + g) % 3, int(rng.integers(256))) for i in range(n)]
        edges += [(g, "ab"[i % 2], str(i), str((i * (1 + g % 3) + 1) % n)) for i in range(n)]
    feats = spark.createDataFrame(nodes, "graph_id int, node string, type_idx int, bucket int")
    states, e = R.initial_states(feats, 3), spark.createDataFrame(edges, "graph_id int, relation string, src string, dst string")
    graphs, held = R.sampled_graphs(states, e, ["a", "b"], 50)
    assert len(graphs) + len(held) == 50 and held
    how = {"width": 6, "out": 4, "batch": 16, "most": 60}
    model = R.train(states, e, ["a", "b"], epochs=40, **how)
    of = lambda m: R.metrics(m, graphs, 3, (0.1, 0.2), 0.1)["loss"]  # noqa: E731  on other views than those trained on
    assert len(model.history) == 40 and of(model) < 0.8 * of(R.train(states, e, ["a", "b"], epochs=0, **how))
    two = [R.view(g, rng, 0.1, 0.2) for _ in range(2) for g in graphs[:5]]
    loss = lambda: V.contrastive_loss(*np.split(R.forward(model, two)[0], 2), 0.1)
    for x, g in zip((model.weights, model.bias, model.projection), R.gradients(model, *R.forward(model, two), 0.1), strict=True):
        flat, at = x.reshape(-1), int(rng.integers(x.size))
        flat[at] += 1e-5
        up = loss()
        flat[at] -= 2e-5
        down = loss()
        flat[at] += 1e-5
        assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-4
    got = {r.graph_id: r.embedding for r in V.encoded(states, e, model.layers(), model.projection.tolist()).collect()}
    whole, _ = R.sampled_graphs(states, e, ["a", "b"], 60, share=0.0)
    want, _ = R.forward(model, whole)
    assert np.allclose(np.array([got[g] for g in sorted(got, key=str)]), want)
    assert R.train(states.limit(0), e.limit(0), ["a"], epochs=1).history == [{"loss": 0.0, "acc_at_1": 0.0}]


def test_sparse_contrastive_loss_equals_the_dense_one(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label, n in ((1, 1), (2, 7), (None, 12)):
        for _ in range(n):
            a, b = (np.where(rng.random(9) < 0.3, rng.normal(size=9), 0.0) for _ in range(2))
            rows.append((label, a.tolist(), b.tolist()))
    want = {g: V.contrastive_loss(*(np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))) for g in (1, 2, None)}
    maps = [(g, *({i: x for i, x in enumerate(v) if x} for v in ab)) for g, *ab in rows]
    got = {r.label: r.loss for r in V.contrastive_loss_sparse(spark.createDataFrame(maps, "label int, a map<long,double>, b map<long,double>").repartition(3), "label").collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_contrastive_losses_of_a_large_batch(spark, tmp_path):
    """A batch whose square no task holds."""
    from threadloom.queries import QUERIES

    n = 60_000
    spark.range(n).selectExpr("id AS vec_id", "array(1.0f) AS embedding", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    (r,) = QUERIES["contrastive_losses"](spark, str(tmp_path)).collect()
    assert abs(r.loss - (math.log(math.exp(10) + 2 * (n - 1)) - 10)) < 1e-6


def test_cross_matches_equal_brute_force(spark, monkeypatch):
    """In several blocks, with scores at the very bound, nulls, zeros, another length and what is no number."""
    monkeypatch.setattr(V, "MATCH_BLOCK", 20)
    rng = np.random.default_rng(8)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(90, 6)))]
    rows += [(90, None), (91, [1.0, None] + [0.0] * 4), (92, [0.0] * 6), (93, [1.0]), (94, [float("nan")] * 6), (95, [1e20] * 6), (96, [0.5] + [0.0] * 5), (97, [1.0] + [0.0] * 5), (98, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.a_id, r.b_id): r.score for r in V.cross_matches(df.where("vec_id % 3 = 0"), df.where("vec_id % 3 > 0"), 0.5).collect()}
    pairs = df.where("vec_id % 3 = 0").alias("a").crossJoin(df.where("vec_id % 3 > 0").alias("b")).select("a.vec_id", "b.vec_id", V.dot("a.embedding", "b.embedding").alias("s"))
    want = {(a, b): s for a, b, s in pairs.where("s >= 0.5").collect()}
    assert (96, 97) in got and want.keys() == got.keys()
    assert all(got[k] == want[k] or math.isnan(want[k]) and math.isnan(got[k]) for k in want)
    assert V.cross_matches(df.limit(0), df, 0.5).count() == 0


def test_cross_matches_are_products_of_blocks(spark):
    """52 million pairs, as matrices and not pair by pair."""
    df = spark.range(24_000).selectExpr("id AS vec_id", "transform(sequence(0, 63), k -> CAST(sin(id * (k + 1)) / 5.7 AS FLOAT)) AS embedding")
    plan = V.cross_matches(df.where("vec_id % 10 = 0"), df.where("vec_id % 10 > 0"), 0.9)
    assert "FlatMapGroupsInArrow" in plan._jdf.queryExecution().toString()
    rows = plan.collect()
    x = np.array([np.sin(np.arange(24_000) * (k + 1)) / 5.7 for k in range(64)]).T.astype(np.float32).astype(float)
    s = x[::10] @ np.delete(x, np.s_[::10], axis=0).T
    assert len(rows) == (s >= 0.9).sum() > 0


def test_next_proof_equals_its_sql_beyond_100_000_events(spark, sf, tmp_path):
    import duckdb

    from threadloom.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (event_id * 7 + 99_990 AS event_id) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLE["next_proof"]).fetchall()
    assert any(r[2] for r in want)
    assert sorted(map(tuple, QUERIES["next_proof"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
