"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Every term weighs by its inverse document frequency among all files. Tasks know those of templates and of the most frequent
others; as rarer terms weigh at least as much as the rarest of these, that gives the least norm of a segment, so the candidates
that reach the threshold by it are all there can be. Their other terms are looked up by a shuffle, and exact scores decide. A file is cut into segments: lines (comment marks cut off), paragraphs (wrapped lines joined), runs of up to three sentences
of a paragraph and runs of up to eight paragraphs, so that notices on one line, wrapped headers and whole licence texts all
meet their template. Terms of lines and sentences are counted once and added up for runs. An SPDX expression is read id by id.
Of the segments that reach the threshold, the one that shares most weight with its template names the licence. A segment
can only reach the threshold if it has one of a template's markers (its rarest terms, without which the rest of the
template is too light), so others are passed over; nothing is lost by that.
A file without a licence of its own takes that of the nearest directory above it with a licence file, by joins on paths.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import materialize, read_table, sliced, tidy

THRESHOLD = 0.8
#: Terms besides the templates' whose document frequency every task knows; results don't depend on it.
COMMON = 20_000
#: Terms that a task holds before it sends on their counts.
HELD = 200_000
#: Sentences and paragraphs of a run at most; the longest template has five paragraphs.
RUN_SENTENCES, RUN_PARAGRAPHS = 3, 8
TERM = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
MARK = re.compile(r"""^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--+|\"{3}|'{3}|REM\b|dnl\b)?\s*|\s*(?:\*+/|--+>|\"{3}|'{3})?\s*$""")
SPDX = re.compile(r"spdx-license-identifier:\s*([^\n]+)", re.IGNORECASE)
SPDX_TERM = re.compile(r"\(|\)|[^\s()]+")
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([.\-_].*)?$"

# Texts and notices of public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, {which}."
LATER = "either version {n} of the License, or (at your option) any later version"
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: The copyleft notices: name, what it is about, kind, version.
GNU_LICENCES = (("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3"))
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE.split("\n")[0].split(". You")[0]),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", MIT.split("\n")[0]),
    ("MIT", MIT),
    *((f"{name}-or-later", GNU.format(what=what, kind=kind, which=LATER.format(n=n))) for name, what, kind, n in GNU_LICENCES),
    *((name, GNU.format(what=what, kind=kind, which=f"version {n} of the License")) for name, what, kind, n in GNU_LICENCES),
    *((name, f"This {word} is licensed under the GNU {kind}General Public License, version {n}.") for name, what, kind, n in GNU_LICENCES for word in (what, "work")),
    *((name, f"GNU {kind}GENERAL PUBLIC LICENSE Version {n}, {day}") for (name, _, kind, n), day in zip(GNU_LICENCES, ("June 1991", "29 June 2007", "February 1999", "29 June 2007", "19 November 2007"), strict=True)),
    ("BSD-3-Clause", "\n".join((BSD_START, BSD_THIRD, BSD_END))),
    ("BSD-2-Clause", "\n".join((BSD_START, BSD_END))),
    ("BSD-3-Clause", "\n".join((BSD_START, BSD_THIRD))),
    ("BSD-2-Clause", BSD_START),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD", BSD_START.split("\n")[0]),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", ISC),
    ("ISC", ISC.split("\n")[0]),
    ("ISC", "ISC License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", UNLICENSE.split("\n")[0]),
    ("Unlicense", UNLICENSE),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Proprietary", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Zlib", "BSL-1.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name, *_ in GNU_LICENCES for end in ("", "-only")),
    *((f"{name}-or-later", f"SPDX-License-Identifier: {name}-or-later") for name, *_ in GNU_LICENCES),
)


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def paragraphs(text: str) -> list[list[str]]:
    """The lines of each paragraph, without comment marks; lines of those alone, and empty ones, part paragraphs."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        line = MARK.sub("", line)
        if line:
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def segments(text: str) -> Iterator[str]:
    """Lines, paragraphs, runs of sentences and runs of paragraphs of a text."""
    return (words() for _, words in counted_segments(text, lambda counts: True))


def counted_segments(text: str, marked: Callable[[Counter], bool]) -> Iterator[tuple[Counter, Callable[[], str]]]:
    """How often each term occurs in a segment, and how to get its words: those segments that are ``marked`` or hold such."""
    blocks = paragraphs(text)
    each = [[Counter(terms(x)) for x in lines] for lines in blocks]
    whole = [added(x) for x in each]
    marks = [marked(x) for x in whole]
    for k, lines in enumerate(blocks):
        if marks[k]:
            joined = " ".join(lines)
            if len(lines) > 1:
                yield from ((c, lambda x=x: x) for c, x in zip(each[k], lines, strict=True) if marked(c))
            sentences = SENTENCE.split(joined)
            counts = [Counter(terms(x)) for x in sentences] if len(sentences) > 1 else whole[k : k + 1]
            hits = [marked(x) for x in counts]
            for i in range(len(sentences)):
                for j in range(i + 1, min(len(sentences), i + RUN_SENTENCES) + 1):
                    if any(hits[i:j]) and j - i < len(sentences):
                        yield added(counts[i:j]), lambda i=i, j=j, x=sentences: " ".join(x[i:j])
        for j in range(k + 1, min(len(blocks), k + RUN_PARAGRAPHS) + 1):
            if any(marks[k:j]):
                yield added(whole[k:j]), lambda j=j, k=k: " ".join(itertools.chain.from_iterable(blocks[k:j]))


def added(counts: list[Counter]) -> Counter:
    if len(counts) == 1:
        return counts[0]
    out: Counter = Counter()
    for x in counts:
        for t, n in x.items():
            out[t] += n
    return out


class Templates:
    """Weighted term vectors of the templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[str, int], files: int, threshold: float, common: int = COMMON):
        self.threshold = threshold
        vocabulary = {t for _, text in templates for t in terms(text)}
        idf = lambda n: math.log((1 + files) / (1 + n)) + 1
        others = [n for t, n in frequency.items() if t not in vocabulary]
        #: What a term weighs at least that isn't known: no other is in more files than the rarest of a full list, and none is left out of a short one.
        self.other = idf(min(others) if others and len(others) >= common else 0)
        self.weight = {t: idf(n) for t, n in frequency.items()} | {t: idf(frequency.get(t, 0)) for t in vocabulary}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.names, self.markers = [], set()
        for k, (name, text) in enumerate(templates):
            vector = {t: n * self.weight[t] for t, n in Counter(terms(text)).items()}
            total = sum(x * x for x in vector.values())
            rest = total
            for t in sorted(vector, key=lambda t: (frequency.get(t, 0), -vector[t], t)):
                self.postings.setdefault(t, []).append((k, vector[t] / math.sqrt(total)))
                if rest >= threshold * threshold * total:
                    self.markers.add(t)
                    rest -= vector[t] ** 2
            self.names.append(name)
        self.pattern = "|".join(map(re.escape, sorted(self.markers)))
        self.finder = ahocorasick.Automaton()
        for marker in self.markers:
            self.finder.add_word(marker, marker)
        if self.markers:
            self.finder.make_automaton()

    def best(self, counts: Counter) -> tuple[float, float, str] | None:
        """What a segment of these terms shares with the template that is closest to it, the cosine and the licence, if that reaches the threshold."""
        if self.markers.isdisjoint(counts):
            return None
        norm, dots = 0.0, Counter()
        for t, n in counts.items():
            w = n * self.weight.get(t, self.other)
            norm += w * w
            for k, x in self.postings.get(t, ()):
                dots[k] += w * x
        k, dot = min(dots.items(), key=lambda d: (-round(d[1], 9), d[0]))
        score = dot / math.sqrt(norm)
        return (dot, min(1.0, score), self.names[k]) if score >= self.threshold else None

    def expression(self, written: str) -> tuple[float, float, str] | None:
        """The same for an SPDX expression: each id is a header of its own; null unless all are known. What WITH names is left as it is."""
        parts, dots, scores, after = [], 0.0, [], ""
        for x in SPDX_TERM.findall(MARK.sub("", written)):
            if x in ("(", ")") or x.upper() in ("AND", "OR", "WITH") or after == "WITH":
                parts.append(x.upper() if x.upper() in ("AND", "OR", "WITH") else x)
            else:
                name = f"{x[:-1]}-or-later" if x.endswith("+") else x
                found = self.best(Counter(["spdx-license-identifier", *terms(name)]))
                if not found:
                    return None
                parts.append(found[2])
                dots += found[0]
                scores.append(found[1])
            after = x.upper()
        return (dots, min(scores), " ".join(parts).replace("( ", "(").replace(" )", ")")) if scores else None

    def marked(self, counts: Counter) -> bool:
        return not self.markers.isdisjoint(counts)

    def parts(self, counts: Counter) -> tuple[float, dict[str, int]]:
        """The squared norm of a segment's terms that are known, and how often each other one occurs."""
        other = {t: n for t, n in counts.items() if t not in self.weight}
        return sum((n * self.weight[t]) ** 2 for t, n in counts.items() if t not in other), other

    def headers(self, written: str) -> tuple[float, str, list[tuple[float, Counter]]] | None:
        """What an SPDX expression shares in all, how it reads, and what each of its ids shares, with its terms; null as for ``expression``."""
        found = self.expression(written)
        if not found:
            return None
        parts, after = [], ""
        for x in SPDX_TERM.findall(MARK.sub("", written)):
            if x not in ("(", ")") and x.upper() not in ("AND", "OR", "WITH") and after != "WITH":
                counts = Counter(["spdx-license-identifier", *terms(f"{x[:-1]}-or-later" if x.endswith("+") else x)])
                parts.append((self.best(counts)[0], counts))
            after = x.upper()
        return found[0], found[2], parts

    def candidates(self, text: str | None) -> list[tuple[float, str, str, list[tuple[float, float, dict[str, int]]]]]:
        """(shared, licence, segment, parts of shared, known squared norm and other terms) of all that may reach the threshold, in order.

        Nothing comes after the first of those that share most whose score is exact: what shares less can't be chosen.
        """
        if not text or not self.markers or next(self.finder.iter(text.lower()), None) is None:
            return []
        found = []
        for m in SPDX.finditer(text):
            if named := self.headers(m[1]):
                found.append((named[0], named[1], m.group, named[2]))
        for counts, words in counted_segments(text, self.marked):
            if best := self.best(counts):
                found.append((best[0], best[2], words, [(best[0], counts)]))
        out: list = []
        sure = -math.inf
        for dot, name, words, parts in found:
            if dot + 2e-9 >= sure:
                known = [(share, *self.parts(counts)) for share, counts in parts]
                if all(not other for *_, other in known):
                    sure = max(sure, dot)
                out.append((dot, name, words, known))
        return [(dot, name, words(), known) for dot, name, words, known in out if dot + 2e-9 >= sure]

    def scan(self, text: str | None) -> tuple[str, float, str] | None:
        """The licence of a whole text, its score and the segment: the one that shares most, then the higher score, then the first."""
        if not text or not self.markers or next(self.finder.iter(text.lower()), None) is None:
            return None
        named = ((self.expression(m[1]), m.group) for m in SPDX.finditer(text))
        plain = ((self.best(counts), words) for counts, words in counted_segments(text, self.marked))
        found = None
        for best, words in itertools.chain(named, plain):
            if best and (found is None or (round(best[0], 9), best[1]) > (round(found[0], 9), found[1])):
                found = (*best, words)
        return (found[2], found[1], found[3]()) if found else None


def counted(files: DataFrame) -> DataFrame:
    """(term, n): in how many files each term occurs; that of the empty term is the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for x in batch.column("text"):
                found.update({"", *terms(x.as_py() or "")})
                if len(found) > HELD:
                    yield sent()
                    found.clear()
        yield sent()

    return materialize(files.select("text").mapInArrow(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")


def known_frequencies(counts: DataFrame, vocabulary: set[str], common: int = COMMON) -> tuple[dict[str, int], int]:
    """In how many files each term of the vocabulary and each of the most frequent others occurs, and how many files there are."""
    own = counts.join(F.broadcast(counts.sparkSession.createDataFrame([("",), *((t,) for t in sorted(vocabulary))], "term string")), "term")
    others = counts.filter("term <> ''").join(own.select("term"), "term", "left_anti").orderBy(F.desc("n"), "term").limit(common)
    found = {r.term: r.n for r in own.unionByName(others).collect()}  # a row for each term of the templates, and ``common``
    return found, found.pop("", 0)


def frequencies(files: DataFrame, vocabulary: set[str], common: int = COMMON) -> tuple[dict[str, int], int]:
    """``known_frequencies`` of files."""
    return known_frequencies(counted(files), vocabulary, common)


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, common: int = COMMON) -> DataFrame:
    """(doc_id, path, license, score, evidence) of every file (doc_id, path, text); license is null where no segment comes close."""
    vocabulary = {t for _, text in templates for t in terms(text)}
    counts = counted(files)
    known = known_frequencies(counts, vocabulary, common)
    schema = "doc_id long, path string, found array<struct<dot: double, license: string, evidence: string, parts: array<struct<dot: double, norm: double, other: map<string,int>>>>>"
    part = pa.struct([("dot", pa.float64()), ("norm", pa.float64()), ("other", pa.map_(pa.string(), pa.int32()))])
    kind = pa.list_(pa.struct([("dot", pa.float64()), ("license", pa.string()), ("evidence", pa.string()), ("parts", pa.list_(part))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Templates(templates, *known, threshold, common)
        for batch in sliced(batches):
            text = batch.column("text")
            maybe = pc.match_substring_regex(text, model.pattern, ignore_case=True) if model.markers else pa.nulls(len(text), pa.bool_())
            found = [model.candidates(x.as_py()) if y else [] for x, y in zip(text, maybe.to_pylist(), strict=True)]
            rows = [[{"dot": d, "license": name, "evidence": words, "parts": [{"dot": p, "norm": n, "other": list(other.items())} for p, n, other in parts]} for d, name, words, parts in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(rows, kind)], names=["doc_id", "path", "found"])

    found = files.select("doc_id", "path", "text").mapInArrow(tidy(run), schema)
    found = materialize(found.withColumn("file", F.monotonically_increasing_id()), "candidates")
    return decided(found, counts, known[1], threshold)


def decided(found: DataFrame, counts: DataFrame, files: int, threshold: float) -> DataFrame:
    """The choice among the candidates of each file by exact scores: most shared, then the higher score, then the first."""
    idf = F.log((1.0 + files) / (1.0 + F.coalesce("n", F.lit(0)))) + 1
    each = found.select("file", F.posexplode("found").alias("k", "c")).select("file", "k", F.posexplode("c.parts").alias("part", "p"))
    other = each.select("file", "k", "part", F.explode("p.other").alias("term", "times"))
    heavy = other.join(counts, "term", "left").groupBy("file", "k", "part").agg(F.sum(F.pow(F.col("times") * idf, F.lit(2.0))).alias("rest"))
    cosine = F.least(F.lit(1.0), F.col("p.dot") / F.sqrt(F.col("p.norm") + F.coalesce("rest", F.lit(0.0))))
    scores = each.join(heavy, ["file", "k", "part"], "left").groupBy("file", "k").agg(F.min(cosine).alias("score")).filter(F.col("score") >= threshold)
    scores = scores.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "score"))).alias("scores"))
    ranked = F.transform("found", lambda c, k: F.struct((-F.round(c["dot"], 9)).alias("dot"), (-F.col("scores")[k]).alias("less"), k.alias("k"), c["license"].alias("license"), c["evidence"].alias("evidence")))
    best = F.array_min(F.filter(ranked, lambda c: c["less"].isNotNull()))
    return found.join(scores, "file", "left").withColumn("best", best).select("doc_id", "path", "best.license", (-F.col("best.less")).alias("score"), "best.evidence")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds origin (own, inherited or none) and license_dir, the directory that an inherited licence comes from.

    A directory's licence is that of its licence file with the highest score (then the first name). Licences go down:
    each directory with files is joined, ancestor by ancestor, with the licensed ones, and the nearest wins.
    """
    scanned = materialize(scanned.withColumn("dir", parent(F.col("path"))), "scanned")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    first = F.min(F.struct((-F.col("score")).alias("score"), "path", "license"))
    licensed = scanned.filter(F.col("license").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("dir").agg(first.alias("best"))
    licensed = licensed.select(F.col("dir").alias("ancestor"), F.col("best.license").alias("dir_license"), F.col("best.score").alias("dir_score"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = scanned.filter("dir is not null").select("dir").distinct().select("dir", F.posexplode(up).alias("depth", "ancestor"))
    nearest = above.join(licensed, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license", "dir_score")).alias("near"))
    nearest = materialize(nearest, "nearest")
    own = F.col("license").isNotNull()
    return scanned.join(nearest, "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "near.dir_license").alias("license"),
        F.when(own, F.col("score")).otherwise(-F.col("near.dir_score")).alias("score"),
        "evidence",
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.ancestor")).alias("license_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: /source/thousands/hundreds/id.txt; every twentieth is its directory's LICENSE file."""
    thousands, hundreds = (F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100))
    place = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), thousands)
    name = F.when(F.pmod("doc_id", F.lit(20)) == 0, F.concat(F.lit("/LICENSE-"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("/"), hundreds, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    )
    return docs.select("doc_id", "text", F.concat(place, name).alias("path"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """The licence of every document: doc_id, path, license, score, evidence, origin, license_dir.

    A null or empty text has no licence of its own; a row with a null doc_id has no path and inherits nothing. Repeated rows
    come back as often as they are there; an empty table gives an empty result. Other columns are not looked at.
    """
    return inherit(scan(document_paths(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"))))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their licence."""
    return scan_documents(read_table(spark, sf_dir, "documents"))
