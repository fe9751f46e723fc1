"""License scan by diagonal voting.

Words of a document and of each license template become rolling k-gram hashes. Document k-grams
whose hash and words are those of a template k-gram leave the workers and are joined with the
template positions of equal hash; a match at document position d and template position t votes
for the diagonal d - t. Votes are counted per document, template
and diagonal (each template position once), diagonals that lie within a few words of each other
are merged, and a merged band becomes a span if the template words under its matches reach a
share of the template, all of it if it is short.

Templates are a parameter of the operator, a short fixed list, so their k-grams may be broadcast
after a check of their number; a longer list is joined by a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import id_text, rolling, word_hashes

K = 3
MIN_SHARE = 0.8
#: Notices up to this many words must stand whole: the word that is missing would be the license's name.
SHORT = 12
#: Diagonals at most this far apart belong to one span (a few words put in or left out).
BAND = 4
#: Template k-grams up to this number are broadcast (16 bytes each).
BROADCAST_GRAMS = 200_000

#: Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Names of the licenses in identifier lines.
IDENTIFIERS = {
    "mit": ["MIT"], "apache": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "isc": ["ISC"], "zlib": ["Zlib"], "boost": ["BSL-1.0"],
    "gpl": ["GPL-2.0", "GPL-3.0"], "lgpl": ["LGPL-2.1", "LGPL-3.0"], "agpl": ["AGPL-3.0"], "mpl": ["MPL-2.0"], "epl": ["EPL-2.0"],
    "unlicense": ["Unlicense"], "cc0": ["CC0-1.0"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"],
}

#: Notices and grants as their licenses word them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mit", "is MIT licensed"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "Licensed under the BSD 2-Clause License"),
    ("mpl", "Licensed under the Mozilla Public License 2.0"),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0"),
    ("isc", "Licensed under the ISC License"),
    ("epl", "Licensed under the Eclipse Public License 2.0"),
    ("unlicense", "Released under the Unlicense"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc-by", "Creative Commons Attribution 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    *((label, f"SPDX-License-Identifier: {name}") for label, names in IDENTIFIERS.items() for name in names),
]

_FOLD = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _places(words: list[bytes], whole: bytes) -> tuple[list[int], set[str]]:
    """Word positions and labels of the base phrases."""
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        if b" ".join(parts) in whole:
            found = [i for i in range(len(words) - len(parts) + 1) if words[i] == parts[0] and words[i : i + len(parts)] == parts]
            if found:
                at += found
                labels.add(label)
    return at, labels


BASE = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, key binary"
SCHEMA = BASE + ", hits array<struct<d:int,gram:long>>"


def gram_words(templates=TEMPLATES, k: int = K) -> dict[int, set[tuple[bytes, ...]]]:
    """The words of the templates' k-grams by their hash."""
    out: dict[int, set[tuple[bytes, ...]]] = {}
    for _, text in templates:
        words = words_of(text)
        for t, g in enumerate(rolling(word_hashes(b" ".join(words)), k).view(np.int64).tolist()):
            out.setdefault(g, set()).add(tuple(words[t : t + k]))
    return out


def _scan(templates, k: int):
    known = gram_words(templates, k)
    keys = np.array(sorted(known), np.int64)

    def run(batches):
        for batch in batches:
            rows, hits, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                whole = b" ".join(words)
                at, labels = _places(words, whole)
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), hashlib.sha256(whole).digest()[:16]))
                grams = rolling(word_hashes(whole), k).view(np.int64)
                near = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
                at_ = np.flatnonzero(keys[near] == grams) if len(keys) else near[:0]
                # equal hashes are compared word by word
                found = [(d, g) for d, g in zip(at_.tolist(), grams[at_].tolist(), strict=True) if tuple(words[d : d + k]) in known[g]]
                hits += found
                sizes.append(len(found))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], pa.int64())], names=["d", "gram"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(offsets), struct)],
                names=[c.split()[0] for c in BASE.split(", ")] + ["hits"],
            )

    return run


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """gram, template, label, t (position), size (words) of every template k-gram."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = words_of(text)
        grams = rolling(word_hashes(b" ".join(words)), k).view(np.int64).tolist()
        rows += [(g, number, label, t, len(words)) for t, g in enumerate(grams)]
    frame = spark.createDataFrame(rows, "gram long, template int, label string, t int, size int")
    return F.broadcast(frame) if len(rows) <= BROADCAST_GRAMS else frame


def spans(scanned: DataFrame, templates=TEMPLATES, k: int = K, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, key, label, template, first and last document word, share of each verified span."""
    grams = template_grams(scanned.sparkSession, templates, k)
    found = scanned.select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.*").join(grams, "gram")
    votes = found.groupBy("doc_id", "key", "template", "label", "size", (F.col("d") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("at"))
    one = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > BAND, F.lit(True))
    banded = votes.withColumn("far", far.cast("int")).withColumn("band", F.sum("far").over(one))
    merged = banded.groupBy("doc_id", "key", "template", "label", "size", "band").agg(
        F.flatten(F.collect_list("at")).alias("at"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("at") + k - 1).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + k - 1)))))
    verified = merged.withColumn("share", covered / F.col("size")).where(F.col("share") >= F.when(F.col("size") <= SHORT, 1.0).otherwise(min_share))
    return verified.select("doc_id", "key", "template", "label", "first", "last", "share")


def scan(docs: DataFrame, templates=TEMPLATES, k: int = K, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of docs: n_words, the base phrases' places and labels, labels, score.

    score is the share of the best span's template, 1 where a base phrase stands, else 0. A null
    text is empty: no words, no places, empty label lists. Templates of fewer than k words give
    no k-grams and match nothing. Very long texts are read whole. Repeated rows are scanned alike;
    rows with a null doc_id keep their base columns and labels. An empty table gives an empty
    result; further columns of docs are ignored, whatever their names.
    """
    common.prepare(docs.sparkSession)
    scanned = common.cut(id_text(docs).mapInArrow(_scan(templates, k), SCHEMA), "scanned")
    by_row = spans(scanned, templates, k, min_share).groupBy("doc_id", "key").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("best")
    )
    by_row = common.cut(by_row, "licenses").select(F.col("doc_id").alias("of"), F.col("key").alias("ofkey"), "found", "best")
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    joined = scanned.drop("hits").join(by_row, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("ofkey")), "left")
    labels = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
