"""Plain Python versions and awkward rows, shared by the tests of this folder."""

AWKWARD = [
    (1, "The cat sat on the mat and looked at the dog for a long while", "en", "a"), (2, "The cat sat on the mat and looked at the dog for a long while", "en", "a"), (2, "Other text", "de", None),
    (3, None, None, "b"), (4, "", "en", "b"), (5, " \n\t ", "en", None), (None, "No id here at all, none", "fr", "c"), (None, None, None, None), (6, "one", "en", "a"), (6, "one", "en", "a"),
    (7, "word " * 30_000, "en", "a"), (8, "é́ß İ ΣΣ 　x \U0001F600 don't a<|endoftext|>b", "en", "c"), (-9, "a b c d e f g h", "en", "c"), (2**62, "x\x00y z", "en", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def awkward(spark, extra: bool = True):
    """The rows, with columns whose names operators use inside themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("h", "n", "row", "token", "label", "size", "key", "block", "part", "rank", "slot_", "n_chars")}) if extra else df


def shingles(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple], n: int, num: int, den: int = 100) -> dict[int, int]:
    """Row number -> least row number of its component."""
    sets = [shingles(t, n) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in range(len(rows))}
