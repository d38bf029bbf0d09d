"""Token counts that follow edits: pre-token segment trees, re-encoded only where an edit reaches.

A text is cut by the tokenizer's pre-token pattern. Leaves of its tree are runs of pre-tokens with their code points
and tokens; inner nodes hold the sums. An edit (start, deleted, inserted) goes down the tree to the leaf that holds its
start; pre-tokens from two before it on are cut and counted anew, until a new boundary behind the edit meets an old
one: from there on the cut depends on the text behind alone, and old leaves stand. The new leaves replace the old and
the sums above them follow. A tree whose leaves went far beyond their number is levelled.

Null texts count as empty, with no tokens, very long ones have trees as deep as the logarithm of their length; there are
no ties; repeated rows are counted each. Edits beyond the text's end are clipped to it; edits of one document apply
in the order given, each to the text that the last one left; null parts of an edit count as 0 or empty. Other columns
are carried along, those of the names that are output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.llm.common import in_batches, tidied

LEAF = 8  # pre-tokens: three edits of a document of the given tables recount 7 % of it (with 64: 40 %), and take less time
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 200_000  # pre-tokens whose counts a worker remembers


class Counter:
    """Counts of tokens by pre-token; pre-tokens are cut by pattern, encoded by the vocabulary's ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        # white space as Unicode has it, which this library takes more widely
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + BLANK).replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]"))
        self.known = _Counts(self.encoding)

    def cut(self, text: str, start: int = 0) -> list[str]:
        return self.find.findall(text, start)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


class _Counts(dict):
    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n = len(self.encode(piece))
        return n


@functools.lru_cache(maxsize=2)
def _counter(ranks: bytes, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class Tree:
    """Sums of code points and tokens over a text's leaves, as a binary tree in one array of pairs."""

    def __init__(self, chars, tokens):
        self.level(np.asarray(chars, np.int64), np.asarray(tokens, np.int64))

    @classmethod
    def of(cls, pieces: list[str], counter: Counter) -> Tree:
        return cls(*leaves(pieces, counter))

    def level(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = max(1, len(chars))
        self.width = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars)] = np.stack([chars, tokens], axis=1)
        w = self.width
        while w > 1:
            self.sums[w // 2 : w] = self.sums[w : 2 * w : 2] + self.sums[w + 1 : 2 * w : 2]
            w //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at` (the last, if none does), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.sums[i, 0] and self.sums[i + 1, 0]:
                start += int(self.sums[i, 0])
                i += 1
        return i - self.width, start

    def put(self, i: int, chars: int, tokens: int) -> None:
        i += self.width
        change = np.array([chars, tokens]) - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2

    def replace(self, first: int, last: int, chars, tokens) -> None:
        """Leaves first to last - 1 become those given: in place where they fit, else the tree is levelled."""
        if len(chars) <= last - first:
            for k in range(first, last):
                j = k - first
                self.put(k, int(chars[j]) if j < len(chars) else 0, int(tokens[j]) if j < len(chars) else 0)
            return
        old = self.sums[self.width : self.width + self.n]
        old = np.concatenate([old[:first], np.stack([chars, tokens], axis=1), old[last:]])
        old = old[old[:, 0] > 0]
        self.level(old[:, 0], old[:, 1])


def leaves(pieces: list[str], counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tokens = np.fromiter(map(counter.known.__getitem__, pieces), np.int64, len(pieces))
    at = np.arange(0, len(pieces), LEAF)
    return (np.add.reduceat(chars, at), np.add.reduceat(tokens, at)) if len(pieces) else (chars, tokens)


def edit(tree: Tree, text: str, start: int, deleted: int, inserted: str, counter: Counter) -> tuple[str, int]:
    """The text after the edit, and how many code points were cut anew; the tree follows."""
    start = max(0, min(start, len(text)))
    deleted = max(0, min(deleted, len(text) - start))
    new = text[:start] + inserted + text[start + deleted :]
    shift = len(inserted) - deleted
    # boundary context: what ends two code points before the edit sees nothing of it
    first, base = tree.leaf(max(0, start - 2))
    i, end, pos, pieces, last = first, base, base, [], tree.n
    for m in counter.find.finditer(new, base):
        if pos > base and pos >= start + len(inserted):
            while end + shift < pos and i < tree.n:
                end += int(tree.sums[tree.width + i, 0])
                i += 1
            if end + shift == pos:  # the cut meets an old leaf's boundary behind the edit
                last = i
                break
        pieces.append(m.group())
        pos = m.end()
    tree.replace(first, last, *leaves(pieces, counter))
    return new, pos - base


def count_after_edits(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs with n_tokens (of text), n_tokens_edited, n_chars_edited, recounted (code points cut anew).

    docs: text, edits array<struct<start, deleted, inserted>> and others; ranks: path of a file of BPE ranks."""
    with open(ranks, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())  # of the vocabulary's size
    docs = docs.drop("n_tokens", "n_tokens_edited", "n_chars_edited", "recounted")  # replaced
    kept = [c for c in docs.columns if c not in ("text", "edits")]
    names = docs.columns

    def run(batches):
        counter = _counter(table.value, pattern)
        for batch in batches:
            made = []
            for text, edits in zip(batch.column(names.index("text")), batch.column(names.index("edits")), strict=True):
                text = text.as_py() or ""
                tree = Tree.of(counter.cut(text), counter)
                before, again = tree.tokens, 0
                for e in edits.as_py() or []:
                    if e:
                        text, n = edit(tree, text, e["start"] or 0, e["deleted"] or 0, e["inserted"] or "", counter)
                        again += n
                made.append((before, tree.tokens, tree.chars, again))
            cols = [pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else ((), (), (), ()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), *cols], names=[*kept, "n_tokens", "n_tokens_edited", "n_chars_edited", "recounted"])

    fields = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_tokens_edited", "n_chars_edited", "recounted")]
    return in_batches(docs).mapInArrow(tidied(run), T.StructType([*(docs.schema[c] for c in kept), *fields]))
