"""Token counts after edits, licences, word BPE, fingerprints."""

import collections
import hashlib
import math
import random
import re
import struct

import pytest
from brute import AWKWARD, awkward, shingles
from pyspark.sql import functions as F

from threadloom.llm import edit_token_counts as C
from threadloom.llm.fingerprints import edited_and_next
from threadloom.llm.license_scan import license_scan, notices
from threadloom.llm.word_bpe import encode_documents

P = pytest.importorskip("public_tokenizers")


def counter():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return C.Counter(f.read(), P.PATTERN)


def test_trees_follow_edits():
    c, rng = counter(), random.Random(3)
    parts = ["the ", "word", " ", "  ", "\n", "'s", "'", "re", "é", "12", "!?", "\x1c", "　", "\U0001F600", "don't", " a"]
    leaf = C.LEAF
    try:
        for _ in range(300):
            C.LEAF = rng.choice([1, 2, 8, 64])
            text = "".join(rng.choices(parts, k=rng.choice([0, 1, 5, 300])))
            tree = C.Tree.of(c.cut(text), c)
            assert (tree.tokens, tree.chars) == (c.count(text), len(text))
            for _ in range(4):
                text, _ = C.edit(tree, text, rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 30, 2000]), "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 40]))), c)
                assert (tree.tokens, tree.chars) == (c.count(text), len(text))
    finally:
        C.LEAF = leaf


def test_edits_touch_little():
    c = counter()
    text = "some words of a long text " * 5000
    tree = C.Tree.of(c.cut(text), c)
    _, again = C.edit(tree, text, 60_000, 5, "new", c)
    assert again < 2000


def test_edit_counts_of_awkward_rows(spark):
    c = counter()
    df = awkward(spark).withColumn("edits", F.expr("array(named_struct('start', 2, 'deleted', 3, 'inserted', 'new word'), named_struct('start', 99999999, 'deleted', 5, 'inserted', null), named_struct('start', null, 'deleted', 1, 'inserted', ' '), null)"))
    rows = C.count_after_edits(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_tokens_edited) for r in rows)
    want = []
    for i, t, *_ in AWKWARD:
        t = t or ""
        new = t[: min(2, len(t))] + "new word" + t[5:]
        want.append((i or 0, c.count(t), c.count(" " + new[1:])))
    assert got == sorted(want) and rows[0].label == 7
    assert C.count_after_edits(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert C.count_after_edits(df.withColumn("edits", F.lit(None).cast(df.schema["edits"].dataType)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where("n_tokens <> n_tokens_edited").count() == 0


def test_word_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in AWKWARD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    for block in (30_000, 14 << 20):
        rows = encode_documents(awkward(spark), P.path("word_bpe_49k.json"), block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in rows) == sorted(want)
    assert encode_documents(awkward(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_every_character_is_encoded_as_the_library_does(spark):
    """Words of one odd character, and white space of every kind between two."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    chars = [chr(c) for c in [*range(1, 0x3000, 7), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0xFEFF, 0x1F600] if not 0xD800 <= c < 0xE000]
    rows = [(i, f"a{c}b {c} {c}{c}Á") for i, c in enumerate(chars)]
    got = {r.doc_id: r.ids for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()}
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in rows)


def test_fingerprints(spark):
    rows = {}
    for r in edited_and_next(awkward(spark)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    ids = sorted({i for i, *_ in AWKWARD if i is not None})
    least = {i: min((t or "") for j, t, *_ in AWKWARD if j == i) for i in ids}
    assert sum(map(len, rows.values())) == len(AWKWARD)
    for i, text, *_ in AWKWARD:
        text = text or ""
        after = least[ids[0] if i is None else ids[(ids.index(i) + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        r = next(r for r in rows[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text))
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text, 5), shingles(other, 5)
            true = 1.0 if not a | b else len(a & b) / len(a | b)
            assert 0 <= value <= 1 and abs(value - true) < 0.2
        assert (r.fingerprint == "") == (not text.split()) or text.strip("\x00 \t\n\r\x0b\x0c") != ""
    assert len({r.fingerprint for r in rows[1]} | {r.fingerprint for r in rows[6]}) == 2
    assert edited_and_next(awkward(spark).limit(0)).count() == 0
    one = edited_and_next(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def plain_fingerprint(text: str | None) -> str:
    """One-permutation MinHash in plain Python: bins' least hashes, empty bins by optimal densification, four bits each."""
    import xxhash

    def mixed(*values, wide):
        h = 42
        for v, fmt in zip(values, wide, strict=True):
            h = xxhash.xxh64_intdigest(struct.pack(fmt, v), seed=h)
        return h - 2**64 if h >= 2**63 else h

    w = [xxhash.xxh64_intdigest(x, seed=42) for x in (text or "").encode().lower().split()]
    w = [h - 2**64 if h >= 2**63 else h for h in w]
    runs = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    least = {}
    for run in runs:
        h = mixed(*run, wide=["<q"] * len(run))
        b = (h >> 56) + 128
        least[b] = min(least.get(b, h), h)
    if not least:
        return ""
    out = ""
    for i in range(256):
        v = least.get(i)
        for t in range(12):
            v = least.get(mixed(i, t, wide=["<i", "<i"]) % 256) if v is None else v
        if v is None:
            v = min((mixed(i, -1, k, wide=["<i"] * 3), least[k]) for k in least)[1]
        out += f"{mixed(i, v, wide=['<i', '<q']) & 15:x}"
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["", None, "One", "a b c d", "a B c D e", *(" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (5, 6, 9, 40, 300, 3000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "none " * 9), (None, "other none of all")]
    for r in edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id IS NOT NULL").collect():
        assert r.fingerprint == plain_fingerprint(texts[r.doc_id])
        text, after = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        assert r.edited_fingerprint == plain_fingerprint(text[: len(text) - len(text) // 4] + after[: len(text) // 4])


def test_queries_of_edits_and_encodings_equal_brute_force(spark, sf):
    """op2, op5 and op10 on the given table."""
    from tokenizers import Tokenizer

    from threadloom.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c, t = counter(), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in queries.op2_edit_token_counts(spark, sf).collect():
        text, n = texts[r.doc_id], len(texts[r.doc_id])
        assert r.n_tokens == c.count(text)
        for at, gone, put in ((int(n * (1 / 3)), 12, text[:20]), (n // 2, 0, " (see note 42, it's new) "), (int(n * 0.75), 30, "")):
            text = text[:at] + put + text[at + gone :]
        assert (r.n_tokens_edited, r.n_chars_edited) == (c.count(text), len(text))
    for r in queries.op10_word_bpe(spark, sf).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    ids = sorted(texts)
    for r in queries.op5_fingerprints(spark, sf).collect():
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        assert r.fingerprint == plain_fingerprint(text)
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 4] + after[: len(text) // 4]).encode()).hexdigest()


def test_fingerprints_estimate_without_bias(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 30, 120, 600]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(w if rng.random() > 0.03 else "x" for w in words))]
    got = {r.doc_id: r for r in edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    errors = []
    for i in range(0, 240, 2):
        a, b = shingles(texts[i], 5), shingles(texts[i + 1], 5)
        errors.append(got[i].near_next - len(a & b) / len(a | b))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def test_licences(spark):
    files = [
        (1, "src/LICENSE", "Released under the MIT License."), (2, "src/a/b/x.txt", "nothing"), (3, "src/gpl/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "src/gpl/deep/y.txt", "text\nmore"),
        (5, "src/gpl/deep/z.txt", "long text " * 100 + "\nLicensed under the Apache License, Version 2.0."), (6, "top.txt", "plain the work is"), (7, None, None), (8, "", ""), (9, "src/gpl/deep/y.txt", "text\nmore"), (10, "other/x", "All rights reserved."), (11, "other/y", "rights"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumns({c: F.lit(1) for c in ("n", "license", "row", "dir", "near", "_n", "up", "words", "level", "salt", "w")})
    assert [c for c in license_scan(df, notices(spark)).columns if c != "license"][:12] == [c for c in df.columns if c not in ("text", "license")]
    got = {r.doc_id: (r.origin, r.effective_license, r.from_dir) for r in license_scan(df, notices(spark)).collect()}
    assert got == {
        1: ("own", "MIT", None), 2: ("inherited", "MIT", "src"), 3: ("own", "GPL-3.0", None), 4: ("inherited", "GPL-3.0", "src/gpl"), 5: ("own", "Apache-2.0", None), 6: ("none", None, None),
        7: ("none", None, None), 8: ("none", None, None), 9: ("inherited", "GPL-3.0", "src/gpl"), 10: ("own", "Proprietary", None), 11: ("inherited", "Proprietary", "other"),
    }
    assert license_scan(df.limit(0), notices(spark)).count() == 0


@pytest.mark.parametrize("size", [40, 4000])
def test_licences_share_their_line_with_common_words(spark, size):
    """Words that all documents hold weigh least, whatever the number of documents; rare ones weigh most."""
    common = "Copyright Acme, see by of x"
    lines = {0: "Copyright Acme, all rights reserved", 1: "See Acme: licensed under the Apache License, version 2.0, by copyright of x", 2: "zork quux released blah blub foo under bar baz qux quuz corge grault the mit license"}
    rows = [(i, f"d{i}/x", f"{common}\n{lines[i]}" if i in lines else common) for i in range(size)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), notices(spark)).where("license is not null").collect()}
    assert {i: r.license for i, r in got.items()} == {0: "Proprietary", 1: "Apache-2.0"}
    # by hand: copyright and acme are in all documents (idf 1), all, rights and reserved in one
    rare = math.log((1 + size) / 2) + 1
    assert abs(got[0].similarity - 3 * rare**2 / math.sqrt((3 * rare**2 + 2) * 3 * rare**2)) < 1e-9


MIT = """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included."""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
package x;
class Y {}"""
SPDX = "// SPDX-License-Identifier: GPL-3.0-only\nint main() { return 0; }"


def windows(text, words, seeds):
    """All windows of a text in plain Python, each with whether it is the whole text."""
    import regex

    units = [u for u in (set(words(u)) for u in regex.split(r"[\n\r]|(?<=[.;!?])[\x20\x09]+", text or "")) if u]
    for i, u in enumerate(units):
        for k in range(1, 13):
            if i + k <= len(units) and u & seeds and units[i + k - 1] & seeds:
                yield frozenset().union(*units[i : i + k]), (i, k) == (0, len(units))


def test_licences_equal_brute_force(spark):
    """Real headers among invented prose: every window against every template, weights from counts of all texts."""
    import regex

    from threadloom.llm import license_scan as L

    words = lambda t: regex.findall(r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?", (t or "").lower())
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["the", "of", "software", "copy", "license", "work", "file", "rights", f"w{rng.randrange(300)}"]) for _ in range(n))
    texts = [MIT, APACHE, SPDX, prose(30) + "\n" + MIT + "\n" + prose(50), prose(20) + ". All rights reserved. " + prose(9), "", None, "x" * 50_000, prose(20_000) + "\n" + APACHE]
    texts += [prose(rng.choice([5, 40])) + rng.choice([".\n", " ", "; "]) + rng.choice([n for _, n in L.NOTICES]) + rng.choice(["", " ", ". "]) + prose(rng.choice([0, 3, 10])) for _ in range(60)]
    rows = [(i, f"d/{i}", t) for i, t in enumerate(texts)]
    bank = [(r.license, r.notice) for r in notices(spark).collect()]
    df = collections.Counter(w for t in texts for w in set(words(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    norm = lambda ws: math.sqrt(sum(idf(w) ** 2 for w in ws))
    lists = [(name, set(words(n))) for name, n in bank]
    seeds = L.anchors([sorted(ws) for _, ws in lists], {w: idf(w) for _, ws in lists for w in ws}, L.THRESHOLD)
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), notices(spark)).collect()}
    found = 0
    for i, t in enumerate(texts):
        best = min(((-round(sum(idf(w) ** 2 for w in ws & xs) / norm(ws) / norm(xs), 9), name) for ws, _ in windows(t, words, seeds) for name, xs in lists), default=(0, ""))
        want = best if best[0] <= -L.THRESHOLD else (None, None)
        assert (got[i].similarity and -round(got[i].similarity, 9), got[i].license) == want, (i, t)
        found += want[0] is not None
    assert (got[0].license, got[1].license, got[2].license, got[3].license, got[4].license) == ("MIT", "Apache-2.0", "GPL-3.0", "MIT", "Proprietary") and found > 40
    # no window without an anchor reaches the threshold
    for t in texts:
        for ws, _ in windows(t, words, set(df)):
            assert ws & seeds or all(sum(idf(w) ** 2 for w in ws & xs) < L.THRESHOLD * norm(ws) * norm(xs) for _, xs in lists)


def test_licences_are_inherited_from_the_nearest_directory(spark, sf):
    """The query against nearest ancestors in plain Python, from the licences that it found itself."""
    from threadloom.llm import queries

    big = sf.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op3_license_scan(spark, big).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    speaks = {}
    for i, r in rows.items():
        head, _, name = r.path.rpartition("/")
        if r.license and (name == "LICENSE" or len([x for x in re.split(r"[\n\r]|(?<=[.;!?])[ \t]+", texts[i]) if re.search(r"\w", x)]) == 1):
            speaks[head] = min(speaks.get(head, (9, "")), (-r.similarity, r.license))
    inherited = 0
    for r in rows.values():
        up = r.path
        near = None
        while up and near is None:
            up = up.rpartition("/")[0]
            near = speaks.get(up)
        want = ("own", r.license, None) if r.license else ("inherited", near[1], up) if near else ("none", None, None)
        assert (r.origin, r.effective_license, r.from_dir) == want
        inherited += want[0] == "inherited"
    known = r"Licensed under the Apache License, Version 2.0.|Released under the MIT License.|GNU General Public License, version 3|All rights reserved.|Licensed under CC BY-NC 4.0."
    assert {i for i, r in rows.items() if r.license} == {i for i, t in texts.items() if re.search(known, t or "")} and inherited > 0


def test_root_and_hot_directories_speak(spark):
    rows = [(0, "LICENSE", "Released under the MIT License.")] + [(1, "hot/LICENSE", "All rights reserved.")] + [(i, f"{'hot/' if i % 2 else 'cold'}{i}/x", "text") for i in range(2, 400)]
    got = collections.Counter((r.origin, r.effective_license, r.from_dir) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), notices(spark)).collect())
    assert got == {("own", "MIT", None): 1, ("own", "Proprietary", None): 1, ("inherited", "Proprietary", "hot"): 199, ("inherited", "MIT", ""): 199}
