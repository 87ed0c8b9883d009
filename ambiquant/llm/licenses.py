"""License scans: MinHash bands over overlapping windows, then exact containment (DataFrame functions only).

A template is looked for by its 5-word shingles (words are runs of a-z and 0-9 after
lower-casing).  Templates fall in classes by length; a class of up to S words has windows
of 2 S shingles at a stride of S, so every span of S words lies in some window.  A class
has `bands` one-row bands, each with a hash function of its own (xxhash64 of the band's seed
and the shingle): a window retrieves a template if they have a minimum in common.
A window that contains 75% of a template's shingles has at least a known Jaccard
similarity with it, J, and the number of bands makes 1 - (1 - J) ** bands at least
`recall`, for the worst template of the class.  A retrieved template is a match if the
window holds 75% of its shingles, counted exactly.

A window that matches lacks at most a quarter of a template's shingles, so it holds one of
any set of more than a quarter; documents that hold no shingle of such a set of any template, or not
even the longest word of one, are passed over first, which loses nothing.  There is no shuffle: a document is scanned by itself.

Defined results: null and empty texts match nothing; repeated rows and any doc_id, null
too, are scanned each; an empty table gives an empty result; extra columns are ignored.
The templates are a parameter, whole license texts too; as they are part of the plan there may be at most
MOST_SHINGLES shingles in all.  More, or a template of fewer than five words, raise an error.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
CONTAINED = 0.75
MOST_SHINGLES = 100_000
#: Notices by which public licenses ask to be named.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: The short public licenses as a whole, without names and years.
FULL_TEXTS = {
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "bsd-3-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law.""",
}


def templates_in(folder: str) -> dict[str, str]:
    """Templates from the .txt files of a folder that the driver can read, by their names."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted(Path(folder).glob("*.txt"))}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")


def shingles_of(words: Column) -> Column:
    """Hashes of the 5-word shingles of an array of words.

    The array is bound to a variable, so it is made once and not for each shingle, wherever
    the expression is moved in a plan.
    """
    gram = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: gram(w, i))
    return F.flatten(F.transform(F.filter(F.array(words), lambda w: F.size(w) >= WORDS), grams))


def bands_for(shingles: int, span: int, recall: float) -> int:
    """One-row bands that make a collision as likely as `recall` at the least similarity of a match."""
    common = math.ceil(CONTAINED * shingles)
    least = common / (2 * span + shingles - common)
    return 1 if least >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - least))


def _longs(values: list[int]) -> Column:
    """A literal array; one expression, parsed at once."""
    return F.expr("array(" + ", ".join(f"bigint('{v}')" for v in values) + ")")


def _minima(grams: Column, seeds: Column) -> Column:
    """The least hash of the shingles in each band."""
    return F.transform(seeds, lambda s: F.array_min(F.transform(grams, lambda h: F.xxhash64(s, h))))


def _window(j: Column, span: int) -> Column:
    return F.slice("_grams", j * span + 1, F.lit(2 * span))


def _matches(keys: str, name: str, grams: list[int], minima: list[int], span: int) -> Column:
    """Windows that share a band with a template and hold enough of it; keys: their places and minima."""
    lowest = _longs(minima)
    wanted = _longs(grams)

    def held(k: Column) -> Column:
        common = F.size(F.array_intersect(wanted, _window(k["j"], span)))
        share = F.when(F.arrays_overlap(k["m"], lowest), common / F.lit(len(grams))).otherwise(F.lit(0.0))
        return F.struct(F.lit(name).alias("license"), share.alias("containment"))

    return F.filter(F.transform(keys, held), lambda m: m["containment"] >= CONTAINED)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """doc_id, license, containment (best of the document's windows), n_windows (that match)."""
    words = {k: template_words(v) for k, v in sorted((TEMPLATES | FULL_TEXTS if templates is None else templates).items())}
    if any(len(w) < WORDS for w in words.values()) or sum(map(len, words.values())) > MOST_SHINGLES:
        raise ValueError("too many templates, or one of fewer than five words")
    spark = docs.sparkSession
    hashed: dict[str, list[int]] = {}
    hashed_grams: dict[str, dict[tuple, int]] = {}
    if words:
        t = spark.createDataFrame(list(words.items()), "name string, words array<string>")
        for r in t.select("name", shingles_of(F.col("words")).alias("s")).collect():
            w = words[r["name"]]
            hashed_grams[r["name"]] = {tuple(w[i : i + WORDS]): h for i, h in enumerate(r["s"])}
            hashed[r["name"]] = list(dict.fromkeys(r["s"]))
    # of each template one shingle more than a matching window may lack, and of each of these its longest word
    needed, marks = set(), set()
    for name, w in words.items():
        grams = sorted({tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}, key=lambda g: (-max(map(len, g)), g))
        some = grams[: len(grams) - math.ceil(CONTAINED * len(grams)) + 1]
        marks |= {max(g, key=lambda x: (len(x), x)) for g in some}
        needed |= {h for g, h in hashed_grams[name].items() if g in set(some)}
    # a generator makes its array once, whatever is read of it above
    once = lambda made, passes: F.explode(F.filter(F.array(made), passes))
    word_set = F.array(*map(F.lit, sorted(marks))) if marks else F.array().cast("array<string>")
    d = docs.select("doc_id", once(words_of(F.col("text")), lambda w: F.arrays_overlap(w, word_set)).alias("_words"))
    d = d.select("doc_id", once(shingles_of(F.col("_words")), lambda g: F.arrays_overlap(g, _longs(sorted(needed)))).alias("_grams"))
    found = F.array().cast("array<struct<license:string,containment:double>>")
    signed = lambda x: int(np.int64(np.uint64(x)))
    rng = np.random.default_rng(seed)
    spans = sorted({max(8, 1 << (len(w) - 1).bit_length()) for w in words.values()})
    parts = []
    for span in spans:
        own = {k: hashed[k] for k, w in words.items() if max(8, 1 << (len(w) - 1).bit_length()) == span}
        bands = max(bands_for(len(s), span, recall) for s in own.values())
        seeds = [signed(x) for x in rng.integers(0, 1 << 64, bands, dtype=np.uint64)]
        seed_array = _longs(seeds)
        keys = f"_keys{span}"
        # a window is two neighbouring blocks of `span` shingles; only those that hold a needed one can match
        open_ = _longs(sorted({h for k in own for h in hashed[k] if h in needed}))
        last = F.floor(F.greatest(F.size("_grams") - 1, F.lit(0)) / span).cast("int")
        places = F.filter(F.sequence(F.lit(0), last), lambda j: F.arrays_overlap(_window(j, span), open_))
        d = d.withColumn(keys, F.transform(places, lambda j: F.struct(j.alias("j"), _minima(_window(j, span), seed_array).alias("m"))))
        t = spark.createDataFrame(list(own.items()), "name string, s array<bigint>")
        lowest = {r["name"]: r["m"] for r in t.select("name", _minima(F.col("s"), seed_array).alias("m")).collect()}
        parts += [_matches(keys, name, grams, lowest[name], span) for name, grams in own.items()]
    found = F.concat(found, *parts) if parts else found
    rows = d.withColumn("_found", found).select("doc_id", "_found")
    # a document's matches are put together within its row; a filter on arrays would be
    # pushed down and compute them again for each element, so empty ones go after explode
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["license"])))
    best = lambda n: F.filter("_found", lambda m: m["license"] == n)
    rows = rows.withColumn("_name", F.explode_outer(names)).filter("_name is not null")
    return rows.select(
        "doc_id",
        F.col("_name").alias("license"),
        F.array_max(F.transform(best(F.col("_name")), lambda m: m["containment"])).alias("containment"),
        F.size(best(F.col("_name"))).cast("bigint").alias("n_windows"),
    )
