"""License notices in documents, by MinHash bands over overlapping windows; DataFrame functions only.

Texts and templates are lower-cased words and their five-word shingles. A template of t shingles
belongs to the least window length L (a power of two) of at least 2 t shingles. Windows of L
shingles start every L / 2, so any stretch of t shingles lies whole in one of them.

1. Anchors: every template shingle holds one of a few words, chosen to cover all shingles. A
   text without any of them holds no shingle of any template. This loses nothing.
2. Windows: only windows around a shingle of some template are built; others share
   no shingle, and so no MinHash value, with any template.
3. Bands: each window and template gets ``BANDS`` MinHash values, each a band of its own. A window
   that holds 0.8 of a template has a Jaccard likeness of at least 0.19 with it (0.8 t shared
   of at most L + 0.2 t, with t above L / 4), so that all bands miss with a chance below
   ``(1 - 0.19) ** 64``, about one in 700,000.
4. Verification: the exact share of the template's distinct shingles that the window holds.
5. Families: of the shingles that a template has and one of another license lacks, the window must hold half, for each
   such other one. So a notice that differs from another in one sentence or number counts by that part.

Templates are a parameter, bounded by ``MOST_TEMPLATE_WORDS``; their tables are broadcast. Texts
are read whole. A frequent license makes many rows, but none meets another: all joins are with
the templates.

Defined results: null and empty texts and those of fewer than five words hold no license, nor do
templates of fewer than five words; rows with one id are taken together; a null id is a group of its
own; an empty table gives an empty table. Extra columns are not used.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcount.llm.common import text_of

SHINGLE = 5
LEAST = 0.8
OWN = 0.5
BANDS = 64
MOST_TEMPLATE_WORDS = 200_000
# Words that most English texts hold; the list changes no result.
FREQUENT = frozenset("a an and any as by do for if in is it not of or that the this to under was what with you".split())
BREAK = r"[^\p{L}\p{N}]+"

# Notices as their licenses word them.
TEMPLATES = (
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-notice",
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("mit-line", "MIT", "Released under the MIT License."),
    (
        "mit-grant",
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-notice",
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "cc-by-4.0-notice",
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "gpl-2.0-notice",
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "lgpl-2.0-notice",
        "LGPL-2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "lgpl-2.1-notice",
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "lgpl-3.0-notice",
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "agpl-3.0-notice",
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "cc-by-sa-4.0-notice",
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "cc-by-nc-4.0-notice",
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    (
        "cc-by-nd-4.0-notice",
        "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    (
        "cc-by-nc-sa-4.0-notice",
        "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    (
        "cc-by-nc-nd-4.0-notice",
        "CC-BY-NC-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    (
        "bsd-2-clause-conditions",
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY",
    ),
    (
        "bsd-3-clause-conditions",
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names "
        "of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission. THIS SOFTWARE IS PROVIDED BY",
    ),
    (
        "isc-grant",
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0bsd-grant",
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    ),
    (
        "zlib-grant",
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "bsl-1.0-line",
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    (
        "bsl-1.0-grant",
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    (
        "unlicense-grant",
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "cc0-1.0-notice",
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    (
        "wtfpl-notice",
        "WTFPL",
        "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can "
        "redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2",
    ),
    (
        "epl-1.0-notice",
        "EPL-1.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License v1.0 which accompanies this distribution, and is available at "
        "http://www.eclipse.org/legal/epl-v10.html",
    ),
    (
        "epl-2.0-notice",
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "mpl-2.0-notice",
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def window_length(shingles: int) -> int:
    """Least power of two of at least twice as many shingles."""
    return 1 << max(1, (2 * shingles - 1).bit_length())


def anchors(shingles: set[tuple[str, ...]]) -> list[str]:
    """Words of which every shingle holds one, few and long."""
    left, chosen = set(shingles), []
    while left:
        count: dict[str, int] = {}
        for shingle in left:
            # Short and common words are in most texts, so they serve only shingles without another one.
            telling = [w for w in shingle if w not in FREQUENT] or shingle
            longest = min(5, max(map(len, telling)))
            for word in {w for w in telling if len(w) >= longest}:
                count[word] = count.get(word, 0) + 1
        best = max(sorted(count), key=lambda w: count[w] * max(1, len(w) - 2))
        chosen.append(best)
        left = {s for s in left if not any(best in w for w in s)}
    return chosen


def once(df: DataFrame, name: str, value: Column, *kept: str) -> DataFrame:
    """doc_id, ``kept`` and a computed column, as a one-element explode: later filters and projections
    read the value and don't compute it again."""
    return df.select("doc_id", *kept, F.explode(F.array(value)).alias(name))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """Hash of every run of ``SHINGLE`` words."""
    starts = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(
        F.size(words) >= SHINGLE, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    ).otherwise(F.array().cast("array<bigint>"))


def min_hashes(shingles: Column) -> Column:
    """(band, value) of every band."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.struct(
            band.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band))).alias("value")
        ),
    )


def differences(templates, least: float) -> dict[str, list[list[int]]]:
    """Per template, first places of the shingles that one of another license lacks, where ``least`` alone doesn't tell."""
    first = {}
    for name, license_id, text in templates:
        words = words_of(text)
        places: dict[tuple[str, ...], int] = {}
        for i in range(len(words) - SHINGLE + 1):
            places.setdefault(tuple(words[i : i + SHINGLE]), i)
        first[name] = (license_id, places)
    found = {}
    for name, (license_id, mine) in first.items():
        found[name] = kept = []
        for other_id, theirs in first.values():
            own = [i for run, i in mine.items() if run not in theirs]
            # Where more differs, a share of ``least`` holds enough of it.
            if other_id != license_id and own and (1 - OWN) * len(own) < (1 - least) * len(mine):
                kept.append(own)
    return found


def template_table(spark: SparkSession, templates, least: float = LEAST) -> tuple[DataFrame, list[str], list[int]]:
    """(template, license, length, wanted, parts), and the anchors and window lengths."""
    rows, covered = [], set()
    total = 0
    own = differences(templates, least)
    for name, license_id, text in templates:
        words = words_of(text)
        total += len(words)
        runs = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        if runs:
            covered |= runs
            rows.append((name, license_id, window_length(len(words) - SHINGLE + 1), words, own[name]))
    if total > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have {total} words; scan them in parts of at most {MOST_TEMPLATE_WORDS}")
    table = spark.createDataFrame(
        rows, "template string, license string, length int, words array<string>, places array<array<int>>"
    )
    table = table.withColumn("runs", shingle_hashes(F.col("words")))
    parts = F.transform("places", lambda part: F.transform(part, lambda i: F.get(F.col("runs"), i)))
    table = table.select("template", "license", "length", F.array_distinct("runs").alias("wanted"), parts.alias("parts"))
    return table, anchors(covered), sorted({r[2] for r in rows})


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, template, license, start_word, containment): first place and best share of each template.

    Names of templates are distinct.
    """
    spark = docs.sparkSession
    table, words_to_seek, lengths = template_table(spark, templates, least)
    vocabulary = sorted({h for r in table.select("wanted").collect() for h in r["wanted"]})
    if not vocabulary:
        return docs.select("doc_id").where("false").selectExpr(
            "doc_id", "'' as template", "'' as license", "0L as start_word", "0D as containment"
        )
    low = once(docs.select("doc_id", text_of().alias("text")), "__low", F.lower("text"))
    seeks = reduce(lambda a, b: a | b, [F.contains(F.col("__low"), F.lit(w)) for w in words_to_seek])
    words = once(low.where(seeks), "__words", word_array(F.col("__low")))
    hashed = once(words, "__s", shingle_hashes(F.col("__words")))
    places = F.filter(F.transform("__s", lambda s, i: F.when(s.isin(vocabulary), i)), lambda i: i.isNotNull())
    hashed = once(hashed, "__hits", places, "__s")

    def windows(length: int) -> Column:
        half = length // 2
        places = F.flatten(F.transform("__hits", lambda p: F.array(F.floor(p / half), F.floor(p / half) - 1)))
        return F.transform(
            F.filter(F.array_distinct(places), lambda k: k >= 0),
            lambda k: F.struct(F.lit(length).alias("length"), (k * half).cast("int").alias("start")),
        )

    cut = hashed.select("doc_id", "__s", F.explode(F.concat(*[windows(n) for n in lengths])).alias("w")).select(
        "doc_id",
        F.col("w.length").alias("length"),
        F.col("w.start").alias("start"),
        F.slice("__s", F.col("w.start") + 1, F.col("w.length")).alias("held"),
    )
    bands = cut.select("*", F.explode(min_hashes(F.col("held"))).alias("b")).select(
        "doc_id", "length", "start", "held", "b.band", "b.value"
    )
    wanted = F.broadcast(table)
    of_templates = F.broadcast(
        table.select("template", "length", F.explode(min_hashes(F.col("wanted"))).alias("b")).select(
            "template", "length", "b.band", "b.value"
        )
    )
    found = bands.join(of_templates, ["length", "band", "value"]).join(wanted, ["template", "length"])
    share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
    first = F.get(
        F.filter(
            F.transform("held", lambda s, i: F.when(F.array_contains("wanted", s), i)), lambda i: i.isNotNull()
        ),
        0,
    )
    return (
        found.withColumn("containment", share)
        .where(F.col("containment") >= least)
        .where(F.forall("parts", lambda part: F.size(F.array_intersect(part, F.col("held"))) >= OWN * F.size(part)))
        .withColumn("start_word", (F.col("start") + first).cast("long"))
        .groupBy("doc_id", "template", "license")
        .agg(F.min("start_word").alias("start_word"), F.max("containment").alias("containment"))
    )
