"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents meet the positions of the templates' k-grams in a Spark
join; hits are counted by document, template and offset diagonal, neighbouring diagonals are merged, and a
span counts when enough of its template's words are covered in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BitmapFilter, Scratch, map_arrow, list_array, slices, text_column, utf8
from .textcore import ALNUM, ALNUM_RE, U, Words, fold, grams, text_words

GRAM = 3
#: Diagonals this near are one span (so many words put in or left out); the share of a template's words to be covered,
#: and of its own: those in k-grams that no other label's template has. Short templates must be covered whole.
NEAR, COVER, SHORT = 12, 0.6, 10
#: Phrases that are labels by themselves.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Customary notices and short licences, by label, each with the name that tells it from its like
#: (empty where the wording is its own). A text must have the name's words one after another, as the template has.
TEMPLATES = (
    ("gpl", "gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gnu general public license", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "gnu lesser general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "gnu lesser general public license", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl", "gnu lesser general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "gnu affero general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0."),
    ("apache", "", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "mit license", "Released under the MIT License."),
    ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl", "eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("epl", "eclipse public license", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("unlicense", "public domain", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "creative commons attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "attribution noncommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd", "attribution noderivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-nd", "attribution noncommercial noderivatives", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by", "creative commons attribution 3", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("cc-by-sa", "attribution sharealike 3", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("cc-by-nc", "attribution noncommercial 3", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License."),
    ("cc-by-nd", "attribution noderivs 3", "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License."),
    ("cc0", "cc0 1 0 universal", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("cc0", "", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
)


class Template:
    """Label, number of words, the places and number of words of the telling name, and the words in k-grams that no other
    label's template has."""

    def __init__(self, at: int, templates, k: int):
        self.label, name, text = templates[at]
        found = ALNUM_RE.findall(fold(text))
        runs = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        others = {g for label, _, t in templates if label != self.label for g in runs(ALNUM_RE.findall(fold(t)))}
        self.length, name = len(found), ALNUM_RE.findall(fold(name))
        self.names, self.name_words = [i for i in range(len(found)) if name and found[i : i + len(name)] == name], len(name)
        self.own = {i + j for i, g in enumerate(runs(found)) if g not in others for j in range(k)}
        self.cover = COVER if self.length >= SHORT else 1.0

    def named(self, hits: list[tuple[int, int]], k: int) -> bool:
        """Whether hits (place, template's place) have the whole name on one diagonal, so that its words follow each other."""
        diagonals: dict[int, set[int]] = {}
        for at, p in hits:
            diagonals.setdefault(at - p, set()).add(p)
        for at in self.names:
            last = at + self.name_words - k
            for found in diagonals.values():
                if set(range(at, last + 1)) <= found if last >= at else not found.isdisjoint(range(last, at + 1)):
                    return True
        return not self.names


def prepared(templates=TEMPLATES, k: int = GRAM) -> list[Template]:
    return [Template(i, templates, k) for i in range(len(templates))]


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """h, template, tpos: every k-gram position of the templates; as many rows as their words."""
    rows = []
    for i, (_, _, text) in enumerate(templates):
        rows += [(int(g), i, at) for at, g in enumerate(grams(text_words(text).hash, k).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "h long, template int, tpos int")


def _base(words: Words, d: int) -> tuple[list[int], set[str]]:
    """Places and labels of the base phrases in one text, from equal hashes confirmed on the words."""
    h = words.hash[words.first[d] : words.first[d + 1]]
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = _phrase_hashes()[phrase]
        if len(h) < len(p):
            continue
        hit = h[: len(h) - len(p) + 1] == p[0]
        if not hit.any():
            continue
        for j in range(1, len(p)):
            hit = hit & (h[j : len(h) - len(p) + 1 + j] == p[j])
        for at in np.flatnonzero(hit).tolist():
            span = words.first[d] + at, words.first[d] + at + len(p) - 1
            text = fold(words.raw[words.start[span[0]] : words.end[span[1]]].tobytes().decode("utf-8", "replace"))
            if ALNUM_RE.findall(text) == phrase.split():
                places.append(at)
                labels.add(label)
    return places, labels


_hashes: dict[str, np.ndarray] = {}


def _phrase_hashes() -> dict[str, np.ndarray]:
    if not _hashes:
        _hashes.update({p: text_words(p).hash for p, _ in PHRASES})
    return _hashes


def document_grams(docs: DataFrame, member, k: int = GRAM) -> DataFrame:
    """doc_id, the base columns, and the k-grams (h, pos) that the templates' bitmap can't rule out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            raw, offsets = utf8(batch.column(1))
            w = Words(raw, offsets, ALNUM, lower=True)
            g = grams(w.hash, k)
            n = batch.num_rows
            at = np.flatnonzero(member.value.has(g))
            doc = np.searchsorted(w.first, at, side="right") - 1
            inside = at + k <= w.first[doc + 1]
            at, doc = at[inside], doc[inside]
            places, first, last, labels = np.zeros(n, np.int64), [None] * n, [None] * n, [""] * n
            for d in range(n):
                found, names = _base(w, d)
                if found:
                    places[d], first[d], last[d], labels[d] = len(found), min(found), max(found), ",".join(sorted(names))
            lengths = np.bincount(doc, minlength=n)
            columns = [batch.column(0), pa.array(w.counts, pa.int64()), pa.array(places), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(labels), list_array(g[at].view(np.int64), lengths, pa.int64()), list_array(at - w.first[doc], lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "h", "pos"])

    return map_arrow(docs.select("doc_id", text_column().alias("text")), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, h array<long>, pos array<long>")


def verify_spans(diagonals: list[dict], templates: list[Template], k: int = GRAM, near: int = NEAR) -> list[tuple[int, int, int, float]]:
    """(template, from, to, share of its words covered) of the verified spans of one text.

    ``diagonals``: template, diagonal and the template positions hit on it. Diagonals within ``near`` of the
    one before are merged. Hits that go on in text and template make a span; a step back or a gap as long as the
    template begins the next. A span counts when it covers enough of the template's words, enough of its own words and
    its telling name, whole and word after word. Of spans that overlap by half, that with most words stays.
    """
    found, group = [], []

    def judge(t: int, hits: list[tuple[int, int]]) -> None:
        x, covered = templates[t], {p + j for _, p in hits for j in range(k)}
        if len(covered) >= x.cover * x.length and x.named(hits, k) and len(covered & x.own) >= x.cover * len(x.own):
            found.append((t, hits[0][0], hits[-1][0] + k, len(covered) / x.length, len(covered)))

    def close() -> None:
        if group:
            t = group[0]["template"]
            part: list[tuple[int, int]] = []
            for at, p in sorted((p + x["diagonal"], p) for x in group for p in x["tpos"]):
                if part and (p < part[-1][1] - k or at - part[-1][0] > templates[t].length):
                    judge(t, part)
                    part = []
                part.append((at, p))
            judge(t, part)
            group.clear()

    for x in sorted(diagonals, key=lambda x: (x["template"], x["diagonal"])):
        if group and (x["template"] != group[-1]["template"] or x["diagonal"] - group[-1]["diagonal"] > near):
            close()
        group.append(x)
    close()
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[4], -x[3], x[0], x[1])):
        if all(2 * (min(x[2], y[2]) - max(x[1], y[1])) < min(x[2] - x[1], y[2] - y[1]) for y in out):
            out.append(x)
    return sorted(x[:4] for x in out)


def scan(docs: DataFrame, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, for every row.

    ``templates``: (label, telling name or empty, text), of any length. score: 1 with a base phrase, else the largest covered share of a verified span, else 0. Null texts have
    no words and no labels; repeated rows get equal results; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    wanted = template_grams(spark, templates, k)
    member = scratch.share(BitmapFilter.of(wanted, "h"))
    known = prepared(templates, k)
    rows = scratch.table(document_grams(docs, member, k)).withColumn("row", F.monotonically_increasing_id())
    base = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    spans = "array<struct<label:string,from:bigint,to:bigint,share:double>>"
    none = F.array().cast(spans)
    hits = rows.where(F.size("h") > 0).select("row", *base, F.explode(F.arrays_zip("h", "pos")).alias("x")).select("row", *base, "x.h", "x.pos")
    # the templates are a constant of this module, so this broadcast is bounded
    voted = hits.join(F.broadcast(wanted), "h", "left").groupBy("row", *base, "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("tpos").alias("tpos"))
    gathered = voted.groupBy("row", *base).agg(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "tpos"))).alias("diagonals"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*base).schema) + f", spans {spans}"
    kind = pa.list_(pa.struct([("label", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[{"label": known[t].label, "from": a, "to": b, "share": s} for t, a, b, s in verify_spans(x, known, k)] for x in batch.column(len(base)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(base))), pa.array(found, kind)], [*base, "spans"])

    out = rows.where(F.size("h") == 0).select(*base, none.alias("spans")).unionByName(map_arrow(gathered.select(*base, "diagonals"), run, schema))
    own = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_join(F.array_sort(F.array_union(own, F.transform("spans", lambda x: x["label"]))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)))
    return out.select(*base, labels.alias("labels"), score.alias("score"), "spans")
