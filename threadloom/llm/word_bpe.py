"""BPE encoding and decoding through a table of distinct words.

Texts are split on ASCII white space into blocks of documents. A block keeps its words as positions in its own
list of distinct words; the lists of all blocks meet by word hash, where each distinct word is encoded once; the
ids go back to the blocks and are joined to the words by position. Ids are decoded through an id-to-piece table.
Blocks are written once, as a table bucketed by block in the shared folder, so that the last join moves ids only.

White space never survives this vocabulary's pre-tokenizer and nothing composes, lower-cases or merges across it,
so the ids of a text are those of its words in turn; every word goes through the tokenizer itself, special tokens
and Unicode normalisation included. Null texts count as empty, very long ones are a block of their own; there are no ties;
doc_id may be null or repeat, each row stays a row; other columns take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import hand_back, in_batches, shared_dir, tidied

BLOCK_BYTES = 14 << 20  # of text in a block of documents
MOST_BUCKETS = 100_000  # of the written table, as Spark has it; beyond it a bucket holds more blocks
BUCKET_BYTES = 16 << 20  # of text for each bucket of words

PACKED = "kind int, block bigint, bucket int, n array<int>, docs array<bigint>, seats binary, payload binary"


@functools.lru_cache(maxsize=4)
def _tokenizer(config: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(config)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@functools.lru_cache(maxsize=4)
def pieces(config: str) -> list[str]:
    """The id-to-piece table, added tokens included."""
    tokenizer = _tokenizer(config)
    by_id = {i: p for p, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)]


class _Index(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _squeezed(x: np.ndarray, squeeze) -> bytes:
    """Mostly small numbers: what is above the lowest byte, then the lowest bytes of small ones, then of others."""
    high, low = x >> 8, (x & 255).astype(np.uint8)
    parts = [squeeze(_planes(high)), squeeze(low[high == 0].tobytes()), low[high > 0].tobytes()]
    return struct.pack("<3I", *map(len, parts)) + b"".join(parts)


def _unsqueezed(raw: bytes, unzip) -> np.ndarray:
    a, b, c = struct.unpack_from("<3I", raw)
    high = _unplaned(unzip(raw[12 : 12 + a]))
    low = np.empty(len(high), np.uint32)
    low[high == 0] = np.frombuffer(unzip(raw[12 + a : 12 + a + b]), np.uint8)
    low[high > 0] = np.frombuffer(raw[12 + a + b : 12 + a + b + c], np.uint8)
    return (high << 8) | low


def _packer(buckets: int, block_bytes: int):
    def pack(batches):
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1).compress
        part, made = TaskContext.get().partitionId(), 0
        docs, counts, index, chunks, held = [], [], _Index(), [], 0

        def flush():
            words, positions = list(index), np.concatenate(chunks) if chunks else np.empty(0, np.uint32)
            chunks.clear()
            # distinct words are listed by bucket, so that answers come back as runs; positions count by falling
            # frequency, which leaves little to store
            bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            often = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")
            rank, seat = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words), dtype=np.uint32)
            seat[order] = np.arange(len(words), dtype=np.uint32)
            name = (part << 24) + made
            rows = [(0, name, None, counts, docs, squeeze(_planes(seat[often])), _squeezed(rank[positions], squeeze))]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                mine = [words[i] for i in order[ends[b] : ends[b + 1]]]
                rows.append((1, name, int(b), None, None, None, squeeze(b"\n".join(mine))))
            cols = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["kind", "block", "bucket", "n", "docs", "seats", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                split = raw.split()
                docs.append(doc)
                counts.append(len(split))
                if split:
                    chunks.append(np.fromiter(map(index.__getitem__, split), np.uint32, len(split)))
                held += len(raw) + 64
                if held >= block_bytes:
                    yield flush()
                    made += 1
                    docs, counts, index, chunks, held = [], [], _Index(), [], 0
        if docs:
            yield flush()

    return pack


def _encoder(config):
    def encode(table: pa.Table) -> pa.Table:
        unzip, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        lists = [unzip(x.as_py()).split(b"\n") for x in table.column("payload")]
        index = _Index()
        at = [np.fromiter(map(index.__getitem__, words), np.int64, len(words)) for words in lists]
        ids, words = [], [w.decode() for w in index]
        for i in range(0, len(words), 20_000):
            ids += [e.ids for e in _tokenizer(config.value).encode_batch(words[i : i + 20_000], add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.cumsum(lens) - lens
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        out = []
        for a in at:
            out.append(squeeze(lens[a].astype("<u4").tobytes() + flat[_spans(starts[a], lens[a])].astype("<u4").tobytes()))
        del ids, words, index, lists
        hand_back()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array([len(a) for a in at], pa.int32()), "payload": pa.array(out, pa.binary())})

    return encode


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + lens[i] - 1, for each i in turn."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)


def _joiner(config, outputs: tuple[str, ...]):
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor().decompress
        lens, flat = [], []
        for row in sorted(right.select(["bucket", "n", "payload"]).to_pylist(), key=lambda r: r["bucket"]):
            raw = np.frombuffer(unzip(row["payload"]), "<u4")
            lens.append(raw[: row["n"]])
            flat.append(raw[row["n"] :])
        lens = np.concatenate(lens).astype(np.int64) if lens else np.empty(0, np.int64)
        flat = np.concatenate(flat) if flat else np.empty(0, "<u4")
        starts = np.cumsum(lens) - lens
        piece = pieces(config.value)
        spelled = [" ".join(map(piece.__getitem__, flat[s : s + n].tolist())) for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]
        made: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for row in left.to_pylist():  # one
            words = _unplaned(unzip(row["seats"])).astype(np.int64)[_unsqueezed(row["payload"], unzip)]
            at = 0
            for doc, n in zip(row["docs"], row["n"], strict=True):
                own = words[at : at + n]
                at += n
                ids = flat[_spans(starts[own], lens[own])].astype("<u4")
                decoded = " ".join(x for x in map(spelled.__getitem__, own.tolist()) if x)
                made["doc_id"].append(doc)
                made["n_tokens"].append(len(ids))
                made["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if "ids" in outputs:
                    made["ids"].append(ids.astype(np.int32))
                if "decoded" in outputs:
                    made["decoded"].append(decoded)
        out = {k: pa.array(made[k], pa.int64()) for k in ("doc_id", "n_tokens")}
        out |= {k: pa.array(made[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")}
        if "ids" in outputs:
            ends = np.cumsum([0, *made["n_tokens"]])
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made["ids"]) if made["ids"] else np.empty(0, np.int32)))
        if "decoded" in outputs:
            out["decoded"] = pa.array(made["decoded"], pa.string())
        del made, spelled
        hand_back()
        return pa.table(out)

    return join


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df as a table in the shared folder, partitioned by kind and bucketed by block."""
    name = f"word_blocks_{uuid.uuid4().hex}"
    df.write.partitionBy("kind").bucketBy(buckets, "block").option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def encode_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the outputs asked for (ids array<int>, decoded text), for each row.

    tokenizer: path of a tokenizers JSON file whose pre-tokenizer drops white space and that has no decoder.
    """
    with open(tokenizer, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())  # of the vocabulary's size, whatever the input
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    packed = _bucketed(in_batches(slim).mapInArrow(tidied(_packer(buckets, block_bytes)), PACKED), min(MOST_BUCKETS, 2 * math.ceil(total / block_bytes) + 8))
    words = packed.where("kind = 1").select("block", "bucket", "payload")
    answers = words.groupBy("bucket").applyInArrow(_encoder(config), "block bigint, bucket int, n int, payload binary")
    blocks = packed.where("kind = 0").select("block", "n", "docs", "seats", "payload")
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in outputs) + ", decoded string" * ("decoded" in outputs)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joiner(config, outputs), schema)
