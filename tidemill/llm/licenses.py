"""License notices: fixed phrases, and text blocks that contain most of a known notice.

The second is an exact set-similarity join of all lines with the templates. Template words are ordered by their
frequency in the whole corpus; a line is a candidate only if it has one of the rarest words of a template (prefix
filter), has enough different words (length filter) and can still reach the threshold from the place of the first
shared word on (positional filter). Candidates are then counted in full. Notices in wrapped lines are found in runs of
words that go on over line ends, each as long as the template and a quarter more.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed, tune
from .text import LOWER, NOT_ALNUM, hash_of, span_hashes, spans

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening words of public license notices, then whole notices.
OPENINGS = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
NOTICES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
TEMPLATES = OPENINGS + NOTICES
CONTAINED = 0.9
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Index:
    """Templates over their vocabulary, rarest word first."""

    def __init__(self, templates, counts: dict[int, int], contained: float):
        self.vocabulary = np.array(sorted({hash_of(w) for _, t in templates for w in words_of(t)}), np.uint64)
        rank = {h: i for i, h in enumerate(sorted(self.vocabulary.tolist(), key=lambda h: (counts.get(h, 0), h)))}
        self.rank = np.array([rank[h] for h in self.vocabulary.tolist()])
        self.templates, self.prefix, self.runs = [], {}, []
        for k, (label, text) in enumerate(templates):
            own = sorted({rank[hash_of(w)] for w in words_of(text)})
            needed = math.ceil(contained * len(own) - 1e-9)
            self.templates.append((label, frozenset(own), needed))
            size = len(words_of(text))
            self.runs.append((np.isin(np.arange(len(rank)), own), size + max(4, size // 4)))
            for place, r in enumerate(own[: len(own) - needed + 1]):
                self.prefix.setdefault(r, []).append((k, place))
        self.opens = np.zeros(len(self.vocabulary), bool)
        self.opens[list(self.prefix)] = True

    def found(self, block: list[int], distinct: int) -> list[tuple[int, str, float]]:
        """Places, labels and containments of the templates in a block: its sorted template words, and all its different words."""
        out, seen = [], set()
        for j, r in enumerate(block):
            for k, place in self.prefix.get(r, ()):
                label, own, needed = self.templates[k]
                if k in seen or distinct < needed:
                    continue
                seen.add(k)
                if 1 + min(len(own) - place - 1, len(block) - j - 1) < needed:
                    continue
                shared = len(own.intersection(block))
                if shared >= needed:
                    out.append((k, label, shared / len(own)))
        return out

    def wrapped(self, rank: np.ndarray, place: np.ndarray, line: np.ndarray, hits: dict[int, set[int]]) -> list[tuple[int, str, float]]:
        """First lines, labels and containments of the templates in runs of words over line ends.

        Of one text: its template words, their places among all words, and their lines; hits has by template the lines
        that hold it alone. Of overlapping runs with a template the first with the most of it counts.
        """
        out, there = [], np.zeros(len(self.rank), bool)
        there[rank] = True
        for k in sorted({k for r in np.flatnonzero(there & self.opens).tolist() for k, _ in self.prefix[r]}):
            label, own, needed = self.templates[k]
            mine, longest = self.runs[k]
            if int((there & mine).sum()) < needed:
                continue
            some = mine[rank]
            words = list(zip(rank[some].tolist(), place[some].tolist(), line[some].tolist(), strict=True))
            counts: dict[int, int] = {}
            i, best, until = 0, None, -1
            for r, at, y in words:
                counts[r] = counts.get(r, 0) + 1
                while at - words[i][1] >= longest:
                    old = words[i][0]
                    counts[old] -= 1
                    if not counts[old]:
                        del counts[old]
                    i += 1
                x = words[i][2]
                if len(counts) < needed or x == y or any(x <= z <= y for z in hits.get(k, ())):
                    continue
                if best and words[i][1] > until:
                    out.append(best)
                    best = None
                if not best:
                    until = at
                if not best or len(counts) / len(own) > best[2]:
                    best, until = (x, label, len(counts) / len(own)), at
            if best:
                out.append(best)
        return sorted(out)


def _words(data: np.ndarray, at: np.ndarray):
    low = LOWER[data]
    starts, ends, of = spans(low, at, NOT_ALNUM)
    return starts, of, span_hashes(low, starts, ends), ends, low


def _counted(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each template word stands in all texts."""

    def run(batches):
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                h = _words(data, at)[2]
                i = np.searchsorted(vocabulary, h)
                i[i == len(vocabulary)] = 0
                counts += np.bincount(i[vocabulary[i] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(counts)], ["h", "c"])

    rows = docs.select("text").mapInArrow(trimmed(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).collect()
    return {r["h"] % (1 << 64): r["c"] for r in rows}


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks for every row of docs.

    blocks lists (line, label, containment) of the lines that hold `contained` of a template's different words or more,
    then of runs of words over line ends that do, by the line of the run's first template word.
    score is 1 with a phrase, else the largest containment found, else 0. Null and empty texts have no words and no
    labels ('' and null places). Repeated rows give equal rows, an empty table an empty result; columns other than
    doc_id and text are ignored.
    """
    tune(docs.sparkSession)
    wanted = [([hash_of(w) for w in words_of(p)], [w.encode() for w in words_of(p)], label) for p, label in (phrases or PHRASES).items()]
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, _counted(docs, Index(templates, {}, contained).vocabulary), contained))

    def scan(doc: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        ix, n = index.value, len(at) - 1
        starts, of, h, ends, low = _words(data, at)
        text_of = np.repeat(np.arange(n), np.diff(of))
        base, labels, score, blocks = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n), [[] for _ in range(n)]
        places = np.zeros(n, np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for phrase, spelled, label in wanted:
            m = len(phrase)
            if len(h) < m:
                continue
            hit = text_of[: len(h) - m + 1] == text_of[m - 1 :]
            for j, x in enumerate(phrase):
                hit &= h[j : len(h) - m + 1 + j] == np.uint64(x)
            for i in np.flatnonzero(hit).tolist():
                if any(low[starts[i + j] : ends[i + j]].tobytes() != w for j, w in enumerate(spelled)):
                    continue  # equal hashes of other words
                t = int(text_of[i])
                k = i - int(of[t])
                places[t] += 1
                first[t], last[t] = min(first[t], k), max(last[t], k)
                base[t].add(label)
                score[t] = 1
        breaks = np.cumsum(data == 10)
        line = breaks[starts] + text_of if len(h) else np.zeros(0, np.int64)  # differs between lines and between texts
        i = np.searchsorted(ix.vocabulary, h)
        i[i == len(ix.vocabulary)] = 0
        known = ix.vocabulary[i] == h
        rank = ix.rank[i]
        opening = np.unique(line[known & ix.opens[rank]])
        hits: list[dict[int, set[int]]] = [{} for _ in range(n)]
        for x in opening.tolist():
            lo, hi = np.searchsorted(line, [x, x + 1])
            block = np.unique(rank[lo:hi][known[lo:hi]]).tolist()
            t = int(text_of[lo])
            for k, label, share in ix.found(block, len(np.unique(h[lo:hi]))):
                labels[t].add(label)
                score[t] = max(score[t], share)
                blocks[t].append({"line": int(breaks[starts[lo]] - (breaks[at[t] - 1] if at[t] else 0)), "label": label, "containment": share})
                hits[t].setdefault(k, set()).add(x)
        for t in np.unique(text_of[known & ix.opens[rank]]).tolist():
            lo, hi = int(of[t]), int(of[t + 1])
            if line[lo] == line[hi - 1]:
                continue
            some = np.flatnonzero(known[lo:hi]) + lo
            for x, label, share in ix.wrapped(rank[some], some, line[some], hits[t]):
                labels[t].add(label)
                score[t] = max(score[t], share)
                blocks[t].append({"line": x - t - int(breaks[at[t] - 1] if at[t] else 0), "label": label, "containment": share})
        none = places == 0
        joined = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
        kind = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [doc, pa.array(np.diff(of)), pa.array(places), pa.array(first, mask=none), pa.array(last, mask=none), joined(base), joined(a | b for a, b in zip(base, labels, strict=True)), pa.array(score), pa.array(blocks, kind)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
        )

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(1)):
                yield scan(batch.column(0).slice(lo, hi - lo), data, at)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: long, label: string, containment: double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), schema)
