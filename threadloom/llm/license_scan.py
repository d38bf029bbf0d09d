"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor
directory. DataFrame functions only.

Texts are cut into lines and sentences. A window is a run of at most WINDOW of them that begins and ends with one that
holds an anchor word; every window is weighed against every template by the words they share. idf comes from document
counts of all words over all whole texts, and every word of a window counts into its length. Anchor words are the
heaviest words of each template, as many as it takes: the others together weigh less than any window needs to share.
A file's licence is its best window's template (ties to the smaller name). A licence file, one whose name says so or
whose whole text is one window, gives its licence to its directory; files without one of their own take that of the
nearest ancestor directory that has one, by joining paths on directories.

A window that couldn't reach the threshold even if all documents held its other words is dropped by that bound; the other
words of the rest meet their counts by shuffle. Templates are a small table (MOST_TEMPLATES at most, checked) of literals;
all else is joined by shuffle, ancestors with salt, so that a directory of a third of all directories splits.

Null and empty texts have no licence of their own, very long ones count whole, however long their lines; null paths are
files of the root directory; paths may repeat, each row is answered and equal rows alike; ties between directory's files go
to the greater similarity, then the smaller name; columns of the names that are output are replaced, others are carried
along, whatever their names; an empty table gives an empty result, an empty bank no licences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import apart, written

#: What is left of a word without the punctuation at its ends.
BARE = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"
#: Where units part: ends of lines, and white space after the end of a sentence.
UNIT_END = r"[\n\r]|(?<=[.;!?])[\x20\x09]+"
MOST_TEMPLATES = 1000
THRESHOLD = 0.6
WINDOW = 12  # lines or sentences in a window
SALTS = 16
LICENSE_FILE = r"^(license|licence|copying|notice|unlicense)"

#: How texts declare a licence: short notices, and the openings of licences and of their headers in files.
NOTICES = [
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("AGPL-3.0", "this program is free software you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"),
    ("Apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("Apache-2.0", "apache license version 2.0 january 2004 http://www.apache.org/licenses terms and conditions for use reproduction and distribution"),
    ("Artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms under which a given free software package may be copied modified distributed and/or redistributed the artistic license 2.0"),
    ("BSD-2-Clause", "bsd 2-clause license"),
    ("BSD-3-Clause", "bsd 3-clause license"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSL-1.0", "boost software license version 1.0"),
    ("BSL-1.0", "distributed under the boost software license version 1.0 see accompanying file license_1_0.txt or copy at http://www.boost.org/license_1_0.txt"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-2.0", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("ISC", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("LGPL-3.0", "this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https://mozilla.org/mpl/2.0"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("PostgreSQL", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("Proprietary", "all rights reserved"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("WTFPL", "do what the fuck you want to public license"),
    ("Zlib", "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications"),
]
#: Further spellings of a licence's name in SPDX lines, beside the name itself.
SPDX_SPELLINGS = ["-only", "-or-later"]


def notices(spark: SparkSession) -> DataFrame:
    """The bank: NOTICES, and the SPDX line of every licence in them (GNU licences with their two endings)."""
    names = sorted({name for name, _ in NOTICES} - {"Proprietary"})
    lines = [(name, f"spdx-license-identifier: {name}{end}") for name in names for end in ("", *(SPDX_SPELLINGS if "GPL" in name else []))]
    return _literals(spark, [*NOTICES, *lines], ["license", "notice"])


def _literals(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def line_words(line: Column) -> Column:
    """Distinct words, lower-cased, without punctuation at their ends."""
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(BARE), F.lit(0)))


def directory(path: Column) -> Column:
    """The directory of a path, without the last slash; empty for the root."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def anchors(templates: list[list[str]], idf: dict[str, float], threshold: float) -> set[str]:
    """Words of which every window that reaches the threshold holds one. Such a window's cosine is at most the root of the
    share of the template's squared weights that it shares; so the lightest words, as far as their share stays below the
    threshold's square, don't suffice."""
    out: set[str] = set()
    for words in templates:
        ranked = sorted(words, key=lambda w: (-idf[w], w))
        left = whole = sum(idf[w] ** 2 for w in words)
        for w in ranked:
            if left < whole * threshold**2 * (1 - 1e-9):
                break
            out.add(w)
            left -= idf[w] ** 2
    return out


def license_scan(files: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file columns (but text), license (own), similarity, origin: own, inherited or none, effective_license, from_dir.

    files: (path, text) and whatever names a row; templates: (license, notice), as many for a licence as there are ways
    to declare it."""
    files = files.drop("license", "similarity", "origin", "effective_license", "from_dir")  # replaced
    spark, keys = files.sparkSession, [c for c in files.columns if c != "text"]
    listed = templates.select("license", line_words(F.col("notice")).alias("words")).where(F.size("words") > 0).limit(MOST_TEMPLATES + 1).collect()
    if len(listed) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    held = files.withColumn("_tl_row", F.xxhash64(*files.columns))
    total = files.count()
    counts = written(files.select(F.explode(line_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("df")), "document_counts")
    best = _best_windows(held.select("_tl_row", "text"), [(r["license"], list(r["words"])) for r in listed], counts, total, threshold)
    own = held.select(*keys, "_tl_row").join(best, "_tl_row", "left")
    own = own.select(*keys, F.col("_tl_best.license").alias("license"), (-F.col("_tl_best.s")).alias("similarity"), F.col("_tl_best.whole").alias("_tl_whole"), directory(F.col("path")).alias("_tl_dir"))
    own = written(own, "own_licenses")
    # directories that a licence file speaks for
    named = F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).rlike(LICENSE_FILE)
    spoken = own.where(F.col("license").isNotNull() & (named | F.col("_tl_whole")))
    spoken = spoken.groupBy(F.col("_tl_dir").alias("up")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b")).select("up", F.col("b.license").alias("given"))
    spoken = written(spoken, "spoken_for")
    # each directory's ancestors, itself first; all are below the root, which is no join
    parts = F.split("dir", "/")
    below = own.select(F.col("_tl_dir").alias("dir")).distinct().where("dir <> ''")
    above = below.withColumn("level", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("path", F.array_join(F.slice(parts, F.lit(1), F.col("level")), "/"))
    above = above.withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int"))
    salted = spoken.where("up <> ''").withColumn("grain", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nearest = above.join(salted, (F.col("path") == F.col("up")) & (F.col("salt") == F.col("grain"))).groupBy(F.col("dir").alias("_tl_of")).agg(F.max_by(F.struct("up", "given"), "level").alias("_tl_near"))
    out = own.join(nearest, F.concat(F.lit("="), "_tl_dir") == F.concat(F.lit("="), "_tl_of"), "left")
    root = spoken.where("up = ''").first()
    given = F.coalesce(F.col("_tl_near.given"), F.lit(root["given"] if root else None).cast("string"))
    origin = F.when(F.col("license").isNotNull(), "own").when(given.isNotNull(), "inherited").otherwise("none")
    from_dir = F.when(F.col("license").isNull() & given.isNotNull(), F.coalesce("_tl_near.up", F.lit("")))
    return out.select(*keys, "license", "similarity", origin.alias("origin"), F.coalesce("license", given).alias("effective_license"), from_dir.alias("from_dir"))


def _best_windows(texts: DataFrame, templates: list[tuple[str, list[str]]], counts: DataFrame, total: int, threshold: float) -> DataFrame:
    """_tl_row, _tl_best: struct(s: negative similarity, license, whole: whether the window is all of the text); of equally
    similar windows one that is the whole text goes first, should there be one.

    texts: (_tl_row, text); counts: (w, df) of all words."""
    spark = texts.sparkSession
    vocabulary = sorted({w for _, words in templates for w in words})
    literal = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    df = {r["w"]: r["df"] for r in counts.where(F.col("w").isin(vocabulary)).collect()}  # a row for each template word at most
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    anchor = literal(sorted(anchors([words for _, words in templates], idf, threshold)))
    weigh = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf[w] ** 2)]) if vocabulary else F.create_map().cast("map<string,double>")
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + F.element_at(weigh, w))
    # texts with an anchor word, as units with words
    seeds = texts.where(F.arrays_overlap(line_words(F.col("text")), anchor))
    units = F.filter(F.transform(F.split("text", UNIT_END), line_words), lambda u: F.size(u) > 0)
    seeds = seeds.select("_tl_row", units.alias("units"))
    seeds = seeds.select("_tl_row", F.size("units").alias("n"), F.posexplode(F.transform("units", lambda u, i: F.struct(F.arrays_overlap(u, anchor).alias("anchored"), F.slice(F.col("units"), i + 1, F.lit(WINDOW)).alias("run")))).alias("at", "u"))
    seeds = seeds.where("u.anchored").select("_tl_row", "n", "at", "u.run")
    ends = F.filter(F.sequence(F.lit(1), F.size("run")), lambda k: F.arrays_overlap(F.get("run", k - 1), anchor))
    windows = seeds.withColumn("k", F.explode(ends))
    windows = windows.select("_tl_row", ((F.col("at") == 0) & (F.col("k") == F.col("n"))).alias("whole"), F.array_distinct(F.flatten(F.slice("run", F.lit(1), F.col("k")))).alias("words")).distinct()
    known = literal(vocabulary)
    windows = windows.select("_tl_row", "whole", F.array_intersect("words", known).alias("hits"), F.array_sort(F.array_except("words", known)).alias("others"))
    # the bound: no idf is below 1, the idf of a word that all documents hold, so no window is shorter than this
    windows = windows.withColumn("mass", squares(F.col("hits"))).withColumn("least", F.sqrt(F.col("mass") + F.size("others")))
    near = F.lit(threshold * (1 - 1e-9))
    windows = windows.where(F.sqrt("mass") >= near * F.col("least"))
    # every template that could be reached: literals, so no join
    scores = [F.struct(F.lit(name).alias("license"), (squares(F.array_intersect("hits", literal(words))) / F.lit(math.sqrt(sum(idf[w] ** 2 for w in words)))).alias("part")) for name, words in templates]
    bank = F.filter(F.array(*scores), lambda t: t["part"] >= near * F.col("least")) if scores else F.array().cast("array<struct<license:string,part:double>>")
    pairs = windows.withColumn("t", F.explode(bank)).groupBy("_tl_row", "whole", "others", "mass", "t.license").agg(F.max("t.part").alias("part"))
    pairs = written(pairs, "licence_windows")
    # the other words' weights, once for each set of them
    sets = pairs.where(F.size("others") > 0).select("others").distinct().withColumn("key", F.xxhash64("others"))
    rest = F.sum(F.pow(F.log(F.lit(1.0 + total) / (F.col("df") + 1)) + 1, F.lit(2.0)))
    sets = sets.select("key", "others", F.explode("others").alias("word")).join(counts, F.concat(F.lit("="), "word") == F.concat(F.lit("="), "w")).groupBy("key", "others").agg(rest.alias("rest"))
    alone = pairs.where(F.size("others") == 0).withColumn("rest", F.lit(0.0))
    mixed = pairs.where(F.size("others") > 0).withColumn("key", F.xxhash64("others"))
    mixed = mixed.join(sets.select(apart(F.col("key")).alias("k"), F.col("others").alias("o"), "rest"), (apart(F.col("key")) == F.col("k")) & (F.col("others") == F.col("o")))
    scored = alone.unionByName(mixed.select(*alone.columns))
    scored = scored.withColumn("similarity", F.round(F.col("part") / F.sqrt(F.col("mass") + F.col("rest")), 12)).where(F.col("similarity") >= threshold)
    first = F.min(F.struct((-F.col("similarity")).alias("s"), "license", (~F.col("whole")).alias("inside")))
    best = scored.groupBy("_tl_row").agg(first.alias("b"))
    return best.select("_tl_row", F.struct("b.s", "b.license", (~F.col("b.inside")).alias("whole")).alias("_tl_best"))
