"""N-gram Jaccard join with set-relation skipping: the components of documents whose shingle sets are alike.

1. Each document's set of word shingles is hashed; documents with equal sets are one class (a 128-bit digest).
2. Two sets that link differ in at most d tokens. Hashes are cut into k > d ranges, so that k - d ranges at least hold the
   same tokens in both; a set's signatures are its d + 1 fullest ranges (ties by hash), of which two such sets share one.
   The cut depends on the size: a set takes part in that of its interval of sizes, and in that of the next one if a
   partner may lie there. A signature stands for several tokens, so sets that share passages or chance shingles, and more
   of these the larger the table, mostly share none. Below a likeness of 3/4, where ranges would hold a token or none,
   signatures are the tokens of the prefix by hash (p = size - ceil(t size) + 1).
3. Sets that share a signature are candidates of one group; groups by connected components hold every possible link. The
   holders of a signature are contracted in the task that sees them. Signatures that very many documents hold are known
   from a sample and dealt among several tasks.
4. Groups are searched in cells that a task can hold, by sets and by tokens. In a cell the index lists hold blocks of sets
   by size and position, and blocks that fail the length or position bound are skipped. A set that is already known to
   be connected with all its candidates needs no answers, so near copies cost little; else its overlaps are derived from
   the answers of a similar set already searched, by the lists of the tokens in which the two differ, and counted only
   for candidates that the similar set had no answer for. Sets are searched in the order of their least token hashes,
   so that similar ones follow one another.
5. Groups beyond a cell are cut into tiles: links inside the tiles come first; then what isn't in a group's largest
   component is searched against the whole group.

Links are exact: den * intersection >= num * union. Shingle and class hashes are 64 bits long; classes 128 bits.
Null and empty texts, and those without words, have empty sets and link with nothing. doc_id may be null or repeat:
rows are documents; a component's id is its smallest doc_id, null if it has none. Very long texts count whole; a set that
is longer than a cell's tokens is searched in a cell that its hash names, with others. Equally full ranges and equally
frequent tokens are ordered by hash, so ties don't matter; repeated rows are one class. Other columns take no part; an empty table gives none.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import CACHES, apart, hand_back, in_batches, tidied, written
from threadloom.llm.components import components, contract

CELL, CELL_TOKENS = 4096, 4_000_000  # sets of a group that are searched at once, and their tokens (8 bytes each)
BUCKET, BUCKET_TOKENS = 1024, 1_000_000  # of small groups that share a cell
LIST = 512  # thousands of links between holders of signatures that are contracted at once
FEW, KEPT = 8, 256  # sets that are met one by one; searches whose answers are kept
BROADCAST_KEYS = 2_000_000  # of 8 bytes, beyond which keys are joined by shuffle
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 120_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()
CACHES.append(_words)


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """The sorted hashes (signed) of a text's distinct runs of `length` words; of the whole sequence, if it is shorter."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, split), np.uint64, len(split))
    runs = max(1, len(h) - length + 1)
    s = np.full(runs, min(length, len(h)), np.uint64)
    for i in range(min(length, len(h))):
        s = (s ^ h[i : i + runs]) * _MIX[0]
        s = (s ^ (s >> np.uint64(29))) * _MIX[1]
    s = (s ^ (s >> np.uint64(32))) * _MIX[2]
    return np.unique((s ^ (s >> np.uint64(29))).view(np.int64))


class Rule:
    """When two sets link, and what follows for signatures and prefixes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]  # where intervals of sizes begin: partners of a set lie in its own one and those beside it
        while num < den and self.bounds[-1] < 2**40:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * den**3 // num**3)))
        self.cuts: dict[int, np.ndarray] = {}  # of the hashes, by interval

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def least_overlap(self, n: int, m):
        return -(-self.num * (n + m) // (self.num + self.den))

    def most_apart(self, n: int) -> int:
        """In how many tokens a set of this size and one that links with it differ at most."""
        return (self.den - self.num) * (n + n * self.den // self.num) // (self.num + self.den)

    def _cut(self, interval: int) -> np.ndarray:
        if interval not in self.cuts:
            k = -(-7 * (self.most_apart(self.bounds[interval + 1] - 1) + 1) // 5)
            self.cuts[interval] = (np.arange(1, k, dtype=np.uint64) * np.uint64(2**64 // k) ^ np.uint64(2**63)).view(np.int64)
        return self.cuts[interval]

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """Of sorted tokens; two different sets that link share one at least."""
        n = len(tokens)
        if 4 * self.num < 3 * self.den:
            return tokens[: self.prefix(n)]
        most = self.most_apart(n)
        if not most:
            return np.empty(0, np.int64)
        own = bisect_right(self.bounds, n) - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((tokens.view(np.uint64) ^ (tokens.view(np.uint64) >> np.uint64(31))) * _MIX[1], out=sums[1:])
        out = []
        for interval in (own, own + 1) if n * self.den // self.num >= self.bounds[own + 1] else (own,):
            edges = np.concatenate([[0], np.searchsorted(tokens, self._cut(interval)), [n]])
            sig = (np.diff(sums[edges]) ^ (np.arange(1, len(edges), dtype=np.uint64) * _MIX[0])) + np.uint64(interval)
            sig = (sig ^ (sig >> np.uint64(29))) * _MIX[2]
            sig = (sig ^ (sig >> np.uint64(32))).view(np.int64)
            out.append(sig[np.lexsort((sig, -np.diff(edges)))[: most + 1]])
        return np.concatenate(out)


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _head(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _postings(rule: Rule, length: int):
    """(token, h) for the signatures of every set; copies within a task are counted once."""

    def make(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                tokens, owners = [], []
                for text in batch.column(0).slice(lo, 1000):
                    own = shingle_set(text.as_py(), length)
                    if not len(own):
                        continue
                    h = _head(_digest(own))
                    if h in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(h)
                    tokens.append(rule.signatures(own))
                    owners.append(np.full(len(tokens[-1]), h, np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], names=["token", "h"])

    return make


MOST_COUNTED = 65_536  # a signature's count above is this
HOT_PART, HOT_ROWS, MOST_HOT, GRAINS = 64, 4096, 10_000, 64


def hot_tokens(docs: DataFrame, rule: Rule, length: int) -> np.ndarray:
    """Signatures whose rows are dealt among GRAINS tasks instead of one: those of HOT_ROWS rows in one of HOT_PART
    documents, MOST_HOT at most. They decide where rows lie; no row is left out, so it doesn't matter to the links which
    they are."""
    part = docs.select("text").sample(1.0 / HOT_PART, seed=9).mapInArrow(tidied(_postings(rule, length)), "token long, h long")
    counts = part.groupBy("token").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).where((F.col("n") >= HOT_ROWS) & (F.col("a") < F.col("b")))
    most = counts.orderBy(F.desc("n"), "token").limit(MOST_HOT)
    return np.sort(np.array([r["token"] for r in most.collect()], np.int64))


def _candidates(hot: np.ndarray, size: int):
    """(a, b): links that connect all holders of each signature, to the first of them that the task sees; holders of hot
    ones, of which other tasks see more, to the signature itself. `size` links at once are contracted."""

    def make(batches):
        a, b, held = [], [], 0
        token = head = None

        def flush():
            x, y = contract(np.concatenate(a), np.concatenate(b))
            a.clear(), b.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for batch in _shared_runs(batches, hot):
            hs, tokens = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            heads = np.where(np.isin(tokens[starts], hot), tokens[starts], hs[starts])
            if tokens[0] == token:  # the run goes on
                heads[0] = head
            token, head = tokens[-1], heads[-1]
            a.append(hs)
            b.append(np.repeat(heads, np.diff(np.append(starts, len(tokens)))))
            held += len(hs)
            if held >= size:
                yield flush()
                held = 0
        if held:
            yield flush()

    return make


def _shared_runs(batches, hot: np.ndarray):
    """From (token, h) sorted by token: (h, token, count) of tokens with two different h. Runs may span batches; of a
    run no more rows are held than it takes to know its count, as far as it matters. Of hot tokens, which two sets hold
    for certain, a task may see a part: they are shared, and their count is the greatest."""
    held: list[np.ndarray] = []  # rows of the open run
    token, count, low, high = None, 0, 0, 0
    known = set(hot.tolist())

    def made(tokens, hs, counts):
        return pa.RecordBatch.from_arrays([pa.array(hs), pa.array(tokens), pa.array(counts.astype(np.int32))], names=["h", "token", "cnt"])

    def closed():
        hs = np.concatenate(held) if held else np.empty(0, np.int64)
        held.clear()
        often = token in known
        if len(hs) and (low != high or often):
            yield made(np.full(len(hs), token, np.int64), hs, np.full(len(hs), MOST_COUNTED if often else min(count, MOST_COUNTED)))

    for batch in batches:
        tokens, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(tokens):
            continue
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        if tokens[0] != token:
            yield from closed()
            token, count, low, high = tokens[0], 0, hs[0], hs[0]
        # the first run goes on with the open one, the last stays open, those between are whole
        first = starts[1] if len(starts) > 1 else len(tokens)
        held.append(hs[:first])
        count, low, high = count + first, min(low, hs[:first].min()), max(high, hs[:first].max())
        if count > MOST_COUNTED and low != high:
            yield from closed()
        if len(starts) == 1:
            continue
        yield from closed()
        if len(starts) > 2:
            inner = starts[1:]
            lows, highs = np.minimum.reduceat(hs, inner), np.maximum.reduceat(hs, inner)
            sizes = np.diff(np.append(inner, len(tokens)))
            often = np.isin(tokens[inner], hot)
            keep = np.repeat(((lows != highs) | often)[:-1], sizes[:-1])
            counts = np.where(often, MOST_COUNTED, np.minimum(sizes, MOST_COUNTED))
            part = slice(inner[0], inner[-1])
            if keep.any():
                yield made(tokens[part][keep], hs[part][keep], np.repeat(counts[:-1], sizes[:-1])[keep])
        last = starts[-1]
        token, count, low, high = tokens[last], len(tokens) - last, hs[last:].min(), hs[last:].max()
        held.append(hs[last:])
    yield from closed()


def _prefixes(rule: Rule, *cells: list[np.ndarray]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each set of some lists of sets, that are searched together: the tokens of its prefix that another holds, and
    their positions, in the order rare before frequent, hash."""
    every = [s for sets in cells for s in sets]
    flat = np.concatenate(every) if every else np.empty(0, np.int64)
    order = np.argsort(flat, kind="stable")
    edges = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1])) if len(flat) else np.empty(0, np.int64)
    counts = np.empty(len(flat), np.int32)
    counts[order] = np.repeat(np.diff(np.append(edges, len(flat))), np.diff(np.append(edges, len(flat))))
    del order, edges
    out, end = [], 0
    for sets in cells:
        out.append([])
        for s in sets:
            begin, end = end, end + len(s)
            c = counts[begin:end]
            first = np.argsort(c, kind="stable")[: rule.prefix(len(s))]
            place = np.flatnonzero(c[first] > 1)
            out[-1].append((s[first[place]], place))
    return out


def _described(length: int):
    """One row for each document: its set's digest and size."""

    def make(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), length)
                rows.append((_digest(own) if len(own) else None, len(own)))
            sig, n = zip(*rows, strict=True) if rows else ((), ())
            cols = [pa.array(sig, pa.binary()), pa.array([s and _head(s) for s in sig], pa.int64()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "row", "sig", "h", "n"])

    return make


def _sets(length: int):
    def make(batches):
        for batch in batches:
            own = [shingle_set(t.as_py(), length) for t in batch.column(0)]
            cols = [pa.array([_head(_digest(s)) if len(s) else None for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "tokens"])

    return make


class Index:
    """Sets in one task: index lists over their prefixes for candidates, and over all tokens for overlaps."""

    def __init__(self, sets: list[np.ndarray], prefixes: list[tuple[np.ndarray, np.ndarray]], rule: Rule):
        self.sets, self.prefixes, self.rule = sets, prefixes, rule
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(t) for t, _ in prefixes])
        token = np.concatenate([t for t, _ in prefixes]) if sets else np.empty(0, np.int64)
        position = np.concatenate([p for _, p in prefixes]) if sets else np.empty(0, np.int64)
        order = np.lexsort((position, self.size[owner], token))
        self.token, self.owner, self.position = token[order], owner[order], position[order]
        # blocks: runs of equal token, size and position
        size = self.size[self.owner]
        edge = np.ones(len(order), bool)
        edge[1:] = (self.token[1:] != self.token[:-1]) | (size[1:] != size[:-1]) | (self.position[1:] != self.position[:-1])
        self.start = np.append(np.flatnonzero(edge), len(order))
        first = self.start[:-1]
        self.block_token, self.block_size, self.block_position = self.token[first], size[first], self.position[first]
        self.tokens = None

    def candidates(self, tokens: np.ndarray, positions: np.ndarray, n: int) -> np.ndarray:
        """Sets that share a prefix token with a set of size n and pass the length and position bounds of its block."""
        found = []
        lo, hi = np.searchsorted(self.block_token, tokens), np.searchsorted(self.block_token, tokens, "right")
        for j, a, b in zip(positions.tolist(), lo.tolist(), hi.tolist(), strict=True):
            if a == b:
                continue
            m = self.block_size[a:b]
            keep = (self.rule.den * m >= self.rule.num * n) & (self.rule.den * n >= self.rule.num * m)
            keep &= 1 + np.minimum(m - self.block_position[a:b] - 1, n - j - 1) >= self.rule.least_overlap(n, m)
            for k in (np.flatnonzero(keep) + a).tolist():
                found.append(self.owner[self.start[k] : self.start[k + 1]])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def _lists(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        if self.tokens is None:
            flat = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets), dtype=np.int32), self.size)
            order = np.argsort(flat, kind="stable")
            self.tokens, self.owners = flat[order], owner[order]
        lo, hi = np.searchsorted(self.tokens, tokens), np.searchsorted(self.tokens, tokens, "right")
        parts = [self.owners[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate(parts), minlength=len(self.sets)) if parts else np.zeros(len(self.sets), np.int64)

    def overlaps(self, own: np.ndarray, others: np.ndarray, near: Answers | None, tally: Counter) -> np.ndarray:
        """Overlap of own with each of the others: derived from a similar set's answers, by the tokens in which the two
        sets differ, where that set has answers for them; counted for the rest."""
        both, todo = np.empty(len(others), np.int64), np.ones(len(others), bool)
        if near is not None:
            less, more = np.setdiff1d(near.own, own, assume_unique=True), np.setdiff1d(own, near.own, assume_unique=True)
            at = np.minimum(np.searchsorted(near.others, others), len(near.others) - 1)
            held = near.others[at] == others
            if held.any() and len(less) + len(more) < len(own):
                both[held] = near.both[at[held]] - self._lists(less)[others[held]] + self._lists(more)[others[held]]
                todo = ~held
                tally["derived"] += int(held.sum())
        rest = others[todo]
        tally["counted"] += len(rest)
        if len(rest) <= FEW:
            both[todo] = [len(np.intersect1d(own, self.sets[o], assume_unique=True)) for o in rest.tolist()]
        else:
            both[todo] = self._lists(own)[rest]
        return both


@dataclass
class Answers:
    """What the search of a set has found: its overlaps with others of the index, which are sorted."""

    own: np.ndarray
    others: np.ndarray
    both: np.ndarray


def search(index: Index, queries, same: bool, nodes: np.ndarray, query_nodes: np.ndarray, labels: np.ndarray, query_labels: np.ndarray, tally: Counter | None = None):
    """Links that connect queries with the index, as nodes: pairs already connected are passed over.

    queries: (set, prefix tokens, positions); same: they are the index's own sets, in order. labels: what is known to be
    connected already. A query's answers are derived from those of the last set that was found to link with it, or else
    of the query before it that is connected with it; tally counts answers derived and answers counted."""
    parent: dict = {}
    tally = Counter() if tally is None else tally

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    a, b = [], []
    root = labels.copy()  # of the index's sets, renewed as they are joined
    kept: dict[int, Answers] = {}  # of the last KEPT searches; older ones are counted anew
    like: dict[int, int] = {}  # query -> search that linked it
    last: dict[int, int] = {}  # component -> its last search
    for q, (own, tokens, positions) in enumerate(queries):
        mine = find(query_labels[q])
        others = index.candidates(tokens, positions, len(own))
        others = others[nodes[others] != query_nodes[q]]
        others = others[root[others] != mine]
        if len(others):
            fresh = np.array([find(x) for x in root[others].tolist()])
            root[others] = fresh
            others = others[fresh != mine]
        if not len(others):
            continue
        near = kept.get(like.get(q, -1)) or kept.get(last.get(mine, -1))
        both = index.overlaps(own, others, near, tally)
        kept[q] = Answers(own, others, both)
        if len(kept) > KEPT:
            del kept[next(iter(kept))]
        n, m = len(own), index.size[others]
        hit = others[index.rule.den * both >= index.rule.num * (n + m - both)]
        if same:
            like.update(dict.fromkeys(hit.tolist(), q))
        for other in np.unique(root[hit]).tolist():  # one link for each component met
            a.append(int(query_nodes[q]))
            b.append(int(nodes[hit[np.flatnonzero(root[hit] == other)[0]]]))
            x, y = find(other), find(query_labels[q])
            if x != y:
                parent[x] = y
        root[hit] = find(query_labels[q])
        last[find(query_labels[q])] = q
    return a, b


def _unpacked(table: pa.Table):
    """Sets, nodes and labels, in the order of the sets' least tokens: similar sets mostly share theirs, and so follow one
    another."""
    raw = [np.frombuffer(x.as_py(), "<i8") for x in table.column("tokens")]
    order = sorted(range(len(raw)), key=lambda i: (raw[i][:2].tolist(), len(raw[i])))
    h, label = (table.column(c).to_numpy()[order] for c in ("h", "label"))
    return [raw[i] for i in order], h, label


def _links(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _search_cell(rule: Rule):
    def within(table: pa.Table) -> pa.Table:
        sets, nodes, _ = _unpacked(table)
        (prefixes,) = _prefixes(rule, sets)
        index = Index(sets, prefixes, rule)
        queries = [(s, *p) for s, p in zip(sets, prefixes, strict=True)]
        found = _links(*search(index, queries, True, nodes, nodes, nodes.copy(), nodes))
        del index, queries, sets, prefixes
        hand_back()
        return found

    return within


def _search_cells(rule: Rule):
    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _links([], [])
        sets, query_nodes, query_labels = _unpacked(left)
        held, nodes, labels = _unpacked(right)
        prefixes, own = _prefixes(rule, sets, held)
        queries = [(s, *p) for s, p in zip(sets, prefixes, strict=True)]
        return _links(*search(Index(held, own, rule), queries, False, nodes, query_nodes, labels, query_labels))

    return across


def jaccard_components(docs: DataFrame, length: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, row, n_shingles, component_id, component for each row of docs(doc_id, text); row is a hash of both, component
    names the component also where no row of it has a doc_id.

    Two documents link when den * intersection >= num * union of their sets of `length`-word shingles."""
    rule = Rule(num, den)
    docs = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = written(docs.mapInArrow(tidied(_described(length)), "doc_id long, row long, sig binary, h long, n int"), "sets")
    classes = rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("row"), F.first("h").alias("h"), F.first("n").alias("n"))
    links = _all_links(docs, classes, rule, length)
    joined = components(links)
    key = F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.concat(F.lit("s"), F.hex("sig")))
    heads = joined.select(F.col("label").alias("node"), "label").distinct()
    named = rows.where("n > 0").join(joined.unionByName(heads), F.col("h") == F.col("node"), "left").select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), key.alias("key"))
    ids = named.groupBy("key").agg(F.min("doc_id").alias("component_id")).select(F.concat(F.lit("="), "key").alias("_key"), "component_id")
    alone = rows.where("n = 0").select("doc_id", "row", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.concat(F.lit("e"), F.col("row").cast("string")))
    return named.join(ids, F.concat(F.lit("="), "key") == F.col("_key")).select("doc_id", "row", "n_shingles", "component_id", F.col("key").alias("component")).union(alone)


def one_of_each(docs: DataFrame, length: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs (doc_id, text and others) without all but one of each component: that of least doc_id stays.

    Rows without words stay, each for itself; of rows equal in doc_id and text one stays."""
    found = written(jaccard_components(docs, length, num, den).where("n_shingles > 0").select("doc_id", "row", "component"), "found")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.row")
    # fewer go than stay, so those that go are sought
    gone = written(found.select("row").distinct().join(kept, "row", "left_anti"), "gone")
    twice = found.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row").join(kept, "row", "left_semi")
    keyed = docs.withColumn("_tl_row", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    n = gone.count()
    gone = F.broadcast(gone) if n <= BROADCAST_KEYS else gone
    out = keyed.join(gone, keyed["_tl_row"] == gone["row"], "left_anti") if n else keyed
    twice = written(twice, "twice")
    m = twice.count()
    if m:
        twice = F.broadcast(twice) if m <= BROADCAST_KEYS else twice
        once = out.join(twice, out["_tl_row"] == twice["row"], "left_semi").dropDuplicates(["_tl_row"])
        out = out.join(twice, out["_tl_row"] == twice["row"], "left_anti").unionByName(once)
    return out.drop("_tl_row")


def _all_links(docs: DataFrame, classes: DataFrame, rule: Rule, length: int) -> DataFrame:
    """(a, b): links between classes' heads that connect all that link."""
    # signatures that two different sets hold; each one's rows are neighbours in a sorted partition
    hot = hot_tokens(docs, rule, length)
    place = F.col("token")
    if len(hot):
        place = F.when(place.isin(hot.tolist()), F.xxhash64("token", F.pmod("h", F.lit(GRAINS)))).otherwise(place)
    postings = docs.select("text").mapInArrow(tidied(_postings(rule, length)), "token long, h long").repartition(place).sortWithinPartitions("token")
    # candidate groups; written, for contracting them across tasks needs a worker of its own
    pairs = written(postings.mapInArrow(tidied(_candidates(hot, LIST * 1000)), "a long, b long"), "pairs")
    groups = components(pairs)
    groups = groups.unionByName(groups.select(F.col("label").alias("node"), "label").distinct())
    named = groups.join(classes.select("h", "row", "n"), F.col("node") == F.col("h"))
    sizes = named.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    tiles = F.greatest(F.ceil(F.col("sets") / CELL), F.ceil(F.col("tokens") / CELL_TOKENS)).cast("int")
    sizes = sizes.select(F.col("label").alias("_label"), tiles.alias("tiles"))
    members = written(named.join(sizes, apart(F.col("label")) == apart(F.col("_label"))).select("h", "label", "tiles", "n", "row"), "members")
    small = F.col("tiles") <= 1
    count, large, sets_, tokens_ = members.agg(F.count("*"), F.max("tiles"), F.sum(small.cast("long")), F.sum(F.when(small, F.col("n")))).first()
    # their whole sets, from their texts
    keys = members.select("row")
    texts = docs.join(F.broadcast(keys) if count <= BROADCAST_KEYS else keys, "row", "left_semi").select("text")
    sets = texts.mapInArrow(tidied(_sets(length)), "h long, tokens binary").dropDuplicates(["h"])
    whole = sets.join(members.withColumnRenamed("h", "node"), F.col("h") == F.col("node"))
    whole = whole.select("h", "n", "tokens", "label", "tiles")
    large = (large or 0) > 1
    if large:
        whole = written(whole, "whole_sets")
    buckets = max(1, math.ceil((sets_ or 0) / BUCKET), math.ceil((tokens_ or 0) / BUCKET_TOKENS))
    tile = F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int")
    cell = F.when(small, F.pmod(F.xxhash64("label"), F.lit(buckets))).otherwise(F.lit(-1) - F.pmod(F.xxhash64("label", tile), F.lit(2**40)))
    # links are written, or contracting them would run beside the search, in a second worker for each task
    found = whole.withColumn("cell", cell).select("cell", "h", "label", "tokens").groupBy("cell").applyInArrow(_search_cell(rule), "a long, b long")
    links = written(found, "first_links")
    if not large:
        return links
    # groups beyond a cell: what isn't in their largest component yet, against all of them
    big = whole.where("tiles > 1")
    known = components(links).withColumnRenamed("label", "part")
    parts = big.select("h", "n", "label").join(known, F.col("h") == F.col("node"), "left").select("h", "n", "label", F.coalesce("part", "h").alias("part"))
    parts = written(parts, "parts")
    most = parts.groupBy("label", "part").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    most = most.groupBy("label").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.max_by("t", F.struct("c", "part")).alias("t"), F.max("c").alias("c"), F.sum("c").alias("all"), F.sum("t").alias("all_t"))
    lefts = F.greatest(F.ceil((F.col("all") - F.col("c")) / (CELL // 2)), F.ceil((F.col("all_t") - F.col("t")) / (CELL_TOKENS // 2))).cast("int")
    most = most.select(F.col("label").alias("_label"), "main", lefts.alias("lefts")).where("lefts > 0")
    split = written(parts.select("h", "label", "part").join(most, apart(F.col("label")) == apart(F.col("_label"))).select(F.col("h").alias("node"), "part", "main", "lefts"), "split")
    right = big.join(split, F.col("h") == F.col("node"))
    left = right.where("part <> main")
    left = left.withColumn("l", F.pmod(F.xxhash64("h", F.lit(1)), F.col("lefts")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    right = right.withColumn("r", tile).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
    cols = [F.col("label").alias("grp"), F.col("part").alias("label"), *(F.col(c).alias(c) for c in ("l", "r", "h", "tokens"))]
    more = left.select(*cols).groupBy("grp", "l", "r").cogroup(right.select(*cols).groupBy("grp", "l", "r")).applyInArrow(_search_cells(rule), "a long, b long")
    return links.union(written(more, "more_links"))
