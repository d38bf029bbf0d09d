"""Contrastive training of the graph encoder on a bounded sample; the weights then run over all graphs (`vectors.encoded`).

Two views of each graph, without some nodes and edges, shall be nearer to one another than to the views of other graphs of
the batch (NT-Xent). One relational layer, the mean of its states and a projection are fitted by Adam with exact gradients.
The sample is at most `most` graphs by hash of their id; a share of it by hash is held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import vectors as V


@dataclass
class Graph:
    states: np.ndarray  # nodes by features
    src: np.ndarray
    dst: np.ndarray
    relation: np.ndarray


@dataclass
class Encoder:
    relations: list[str]
    weights: np.ndarray  # relation, out, in; the last is a node's own
    bias: np.ndarray
    projection: np.ndarray
    history: list[dict[str, float]] = field(default_factory=list)  # by epoch

    def layers(self) -> list[tuple[dict, list, list]]:
        """As `vectors.encoded` takes them."""
        return [(dict(zip(self.relations, self.weights[:-1].tolist(), strict=True)), self.weights[-1].tolist(), self.bias.tolist())]


def initial_states(feats: DataFrame, types: int) -> DataFrame:
    """graph_id, node, h: the node's type as one of `types` and its subtype's bucket as a share."""
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(types - 1)), lambda i: F.when(i == F.col("type_idx"), 1.0).otherwise(0.0))
    return feats.select("graph_id", "node", F.concat(one_hot, F.array(F.col("bucket") / 255.0)).alias("h"))


def sampled_graphs(states: DataFrame, edges: DataFrame, relations: list[str], most: int, share: float = 0.1) -> tuple[list[Graph], list[Graph]]:
    """At most `most` graphs on the driver: those to train on, and those held out."""
    ids = states.select("graph_id").distinct().orderBy(F.xxhash64("graph_id"), "graph_id").limit(most)
    held = {r["graph_id"]: r["validation"] for r in V.validation_split(ids, "graph_id", share).collect()}
    ids = F.broadcast(ids)  # of `most` rows
    nodes: dict = {}
    for r in states.join(ids, "graph_id").orderBy("graph_id", "node").collect():
        nodes.setdefault(r["graph_id"], ([], {}))
        rows, at = nodes[r["graph_id"]]
        at[r["node"]] = len(rows)
        rows.append(r["h"])
    number = {r: i for i, r in enumerate(relations)}
    links: dict = {}
    for r in edges.join(ids, "graph_id").where(F.col("relation").isin(relations)).orderBy("graph_id", "relation", "src", "dst").collect():
        at = nodes[r["graph_id"]][1]
        if r["src"] in at and r["dst"] in at:
            links.setdefault(r["graph_id"], []).append((at[r["src"]], at[r["dst"]], number[r["relation"]]))
    out: tuple[list, list] = ([], [])
    for g in sorted(nodes, key=str):
        e = np.array(links.get(g, []), np.int64).reshape(-1, 3)
        out[bool(held[g])].append(Graph(np.array(nodes[g][0], float), e[:, 0], e[:, 1], e[:, 2]))
    return out


def view(g: Graph, rng: np.random.Generator, node_drop: float, edge_drop: float) -> Graph:
    """A graph without some nodes (two stay, if there are two) and edges."""
    chance = rng.random(len(g.states))
    keep = (chance >= node_drop) | (chance >= np.sort(chance)[-min(2, len(chance))])
    index = np.cumsum(keep) - 1
    e = keep[g.src] & keep[g.dst] & (rng.random(len(g.src)) >= edge_drop)
    return Graph(g.states[keep], index[g.src[e]], index[g.dst[e]], g.relation[e])


def forward(model: Encoder, graphs: list[Graph]) -> tuple[np.ndarray, tuple]:
    """Unit vectors of graphs, and what the gradients need."""
    sizes = np.array([len(g.states) for g in graphs])
    first = np.cumsum(sizes) - sizes
    h = np.concatenate([g.states for g in graphs])
    src, dst = (np.concatenate([getattr(g, c) + o for g, o in zip(graphs, first, strict=True)]) for c in ("src", "dst"))
    relation = np.concatenate([g.relation for g in graphs])
    degree = np.maximum(1, np.bincount(dst, minlength=len(h)))[:, None]
    inputs = np.zeros((len(model.relations) + 1, *h.shape))
    np.add.at(inputs, (relation, dst), h[src])
    inputs[:-1] /= degree
    inputs[-1] = h
    pre = np.einsum("rni,roi->no", inputs, model.weights) + model.bias
    owner = np.repeat(np.arange(len(graphs)), sizes)
    mean = np.zeros((len(graphs), pre.shape[1]))
    np.add.at(mean, owner, np.maximum(pre, 0))
    mean /= sizes[:, None]
    raw = mean @ model.projection.T
    norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return raw / norm, (inputs, pre, owner, sizes, mean, norm)


def gradients(model: Encoder, z: np.ndarray, kept: tuple, temperature: float) -> list[np.ndarray]:
    """Of the loss by weights, bias and projection; z: first views, then second ones."""
    inputs, pre, owner, sizes, mean, norm = kept
    m = len(z)
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(m), (np.arange(m) + m // 2) % m] -= 1
    by_z = (p + p.T) @ z / (m * temperature)
    by_raw = (by_z - z * (z * by_z).sum(axis=1, keepdims=True)) / norm
    by_pre = (by_raw @ model.projection / sizes[:, None])[owner] * (pre > 0)
    return [np.einsum("no,rni->roi", by_pre, inputs), by_pre.sum(axis=0), by_raw.T @ mean]


def metrics(model: Encoder, graphs: list[Graph], seed: int, drops: tuple[float, float], temperature: float) -> dict[str, float]:
    """Loss, and how often a graph's other view is the nearest, of views drawn by the seed."""
    if len(graphs) < 2:
        return {"loss": 0.0, "acc_at_1": 0.0}
    rng = np.random.default_rng(seed)
    z, _ = forward(model, [view(g, rng, *drops) for _ in range(2) for g in graphs])
    a, b = np.split(z, 2)
    return {"loss": V.contrastive_loss(a, b, temperature), "acc_at_1": float(((a @ b.T).argmax(axis=1) == np.arange(len(a))).mean())}


def train(
    states: DataFrame, edges: DataFrame, relations: list[str], width: int = 16, out: int = 16, epochs: int = 20, batch: int = 64, rate: float = 0.01,
    most: int = 2000, seed: int = 1337, node_drop: float = 0.1, edge_drop: float = 0.2, temperature: float = 0.1,
) -> Encoder:
    """An encoder for states (graph_id, node, h) and edges (graph_id, relation, src, dst), with the held-out loss and
    retrieval of each epoch."""
    graphs, held = sampled_graphs(states, edges, relations, most)
    rng = np.random.default_rng(seed)
    dim = graphs[0].states.shape[1] if graphs else 1
    model = Encoder(relations, rng.normal(size=(len(relations) + 1, width, dim)) / np.sqrt(dim), np.zeros(width), rng.normal(size=(out, width)) / np.sqrt(width))
    parameters = [model.weights, model.bias, model.projection]
    first, second = [np.zeros_like(x) for x in parameters], [np.zeros_like(x) for x in parameters]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(graphs))
        for lo in range(0, len(order) - 1, batch):
            some = [graphs[i] for i in order[lo : lo + batch]]
            if len(some) < 2:
                continue
            z, kept = forward(model, [view(g, rng, node_drop, edge_drop) for _ in range(2) for g in some])
            step += 1
            for x, g, a, b in zip(parameters, gradients(model, z, kept, temperature), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        model.history.append(metrics(model, held or graphs, seed, (node_drop, edge_drop), temperature))
    return model
