"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds all template texts and the base phrases. Each document is streamed through it,
which gives matching statistics (at each word the longest suffix that occurs in some template); a
vectorised filter on template word triples skips the parts where no match reaches three words.
Maximal matches of MIN_MATCH words or more are chained per template (increasing in the document and in
the template, each word counted once, no gap over GAP words), and a template whose chain covers enough of it and holds the words
that tell it from its relatives, unedited, labels the document. Base phrases are found at states of the same walk.

Defined results: a null text is an empty text: no words, no places, empty labels, score 0; repeated rows
are scanned again; an empty table gives no rows; other columns are not read. score is the largest
share of a template or phrase that is covered (1 where a base phrase stands whole).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.kernels import ALNUM, Words, grams, slices, texts
from lorewell.llm.shared import narrow_batches, table

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public licence notices in the licences' own words: label, words that tell it from its relatives, text.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mit", "mit license", "this project is licensed under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("isc", "and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "isc license", "licensed under the isc license"),
    ("0bsd", "with or without fee is hereby granted the software is provided as is", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "alter it and redistribute it freely", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "boost software license version 1 0", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "waived all copyright and related or neighboring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "cc0 1 0 universal", "this work is dedicated to the public domain under cc0 1 0 universal"),
    ("gpl", "the gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "the gnu lesser general public license", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl", "under the terms of the gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "the gnu affero general public license", "this work is licensed under the gnu affero general public license version 3"),
    ("mpl-2", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www mozilla org mpl"),
    ("epl-1", "the eclipse public license v1 0", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"),
    ("epl-2", "the eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("epl-2", "the eclipse public license v 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd 4 0", "licensed under cc by nd 4 0"),
    ("cc-by-nc", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "cc by nc sa 4 0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd 4 0", "licensed under cc by nc nd 4 0"),
    ("cc-by", "creative commons attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
]

#: Words of a match that chains, words between two matches of a chain, and the share or the words that label.
MIN_MATCH, GAP, SHARE, ENOUGH = 3, 40, 0.7, 30


class Automaton:
    """Suffix automaton of several token sequences; each state knows where its suffixes end in the templates."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((t, i + 1))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def _state(self, length: int) -> int:
        self.next.append({})
        self.len.append(length)
        self.link.append(0)
        self.ends.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        there = self.next[last].get(c)
        if there is not None:
            return there if self.len[there] == self.len[last] + 1 else self._split(last, there, c)
        cur, p = self._state(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        new = self._state(self.len[p] + 1)
        self.next[new], self.link[new] = dict(self.next[q]), self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    def __init__(self) -> None:
        seqs = [(label, text.split()) for label, _, text in TEMPLATES]
        #: First and last place (exclusive) in each template of the words that tell it
        self.keys = [((at := len(f" {text} ".partition(f" {key} ")[0].split())), at + len(key.split())) for _, key, text in TEMPLATES]
        self.labels = [label for label, _ in seqs]
        self.sizes = [len(s) for _, s in seqs]
        phrases = [(label, p.split()) for p, label in PHRASES.items()]
        self.ids: dict[bytes, int] = {}
        number = lambda s: [self.ids.setdefault(w.encode(), len(self.ids)) for w in s]
        numbered = [number(s) for _, s in seqs] + [number(s) for _, s in phrases]
        self.auto = a = Automaton(numbered)
        own: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for (label, words), seq in zip(phrases, numbered[len(seqs) :], strict=True):
            s = 0
            for c in seq:
                s = a.next[s][c]
            own[s].append((label, len(words)))
        self.found: list[list[tuple[str, int]]] = [[] for _ in a.len]
        for s in sorted(range(1, len(a.len)), key=a.len.__getitem__):
            self.found[s] = self.found[a.link[s]] + own[s]
        triples = []
        for s in [s for _, s in seqs + phrases]:
            raw = np.frombuffer(" ".join(s).encode(), np.uint8)
            triples.append(grams(Words(raw, np.array([0, len(raw)]), ALNUM).hash, 3))
        self.triples = np.unique(np.concatenate(triples))

    def runs(self, words: Words) -> list[tuple[int, int]]:
        """[first, end) of the word ranges all of whose triples occur in templates."""
        g = grams(words.hash, 3)
        if not len(g):
            return []
        at = np.flatnonzero(self.triples[np.minimum(np.searchsorted(self.triples, g), len(self.triples) - 1)] == g)
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
        return list(zip(first.tolist(), (last + 3).tolist(), strict=True))

    def scan(self, tokens: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], dict[str, float], set[str]]:
        """Base places (first word, label), the covered share of each label, and the labels that the method gives."""
        base, matches = [], defaultdict(list)
        a = self.auto
        for first, run in tokens:
            state = length = 0
            for i, c in enumerate(run):
                nxt, more = a.step(state, length, c)
                if length >= MIN_MATCH and more <= length:
                    self._keep(matches, first + i, state, length)
                state, length = nxt, more
                for label, n in self.found[state]:
                    if length >= n:
                        base.append((first + i - n + 1, label))
            if length >= MIN_MATCH:
                self._keep(matches, first + len(run), state, length)
        share: dict[str, float] = {label: 1.0 for _, label in base}
        extra = set()
        for t, found in matches.items():
            words, told = chained(found, self.keys[t])
            label = self.labels[t]
            share[label] = max(share.get(label, 0.0), words / self.sizes[t])
            if told >= SHARE * self.sizes[t] or told >= ENOUGH:
                extra.add(label)
        return base, share, extra - ({"bsd"} if "bsd-3" in extra else set())

    def _keep(self, matches: dict, end: int, state: int, length: int) -> None:
        for t, e in self.auto.ends[state]:
            if t < len(self.labels):
                matches[t].append((end - length, end, e - length, e))


def chained(found: list[tuple[int, int, int, int]], key: tuple[int, int]) -> tuple[int, int]:
    """The most template words that a chain of matches (start, end, first, last in the template) covers, and the most with ``key`` in one match.

    A chain goes on in the text and in the template, with at most GAP words of the text between two matches; of matches that
    overlap, the later one counts what the earlier lacks.
    """
    found = sorted(found, key=lambda m: (m[1], m[3]))
    ends = [m[1] for m in found]
    best: list[tuple[int, int]] = []
    for start, end, p, q in found:
        n, told = q - p, q - p if p <= key[0] and q >= key[1] else 0
        k = bisect_left(ends, start - GAP)
        for (_, e, _, r), (w, v) in zip(found[k : len(best)], best[k:], strict=True):
            new = q - p - max(0, e - start, r - p)
            if new > 0 and r < q and e < end:
                n = max(n, w + new)
                told = max(told, v + new if v else 0, w + new if p <= key[0] and q >= key[1] else 0)
        best.append((n, told))
    return max((n for n, _ in best), default=0), max((v for _, v in best), default=0)


@cache
def scanner() -> Scanner:
    return Scanner()


FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = scanner()
    for b in batches:
        buf, offs = texts(b.column(1))
        for i, j in slices(offs):
            part = buf[offs[i] : offs[j]]
            w = Words(part, offs[i : j + 1] - offs[i], ALNUM)
            raw = part.tobytes().lower()
            n = j - i
            runs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
            doc_of = lambda k: int(np.searchsorted(w.first, k, "right")) - 1  # noqa: B023, E731
            for p, q in s.runs(w):
                d, at = doc_of(p), p
                for k in range(p, q):  # a run may go over documents' ends; a word is told by its bytes
                    token = s.ids.get(raw[w.start[k] : w.end[k]])
                    if k >= w.first[d + 1] or token is None:
                        d, at = doc_of(k), k + (token is None)
                        if token is None:
                            continue
                    if at == k:
                        runs[d].append((k - int(w.first[d]), []))
                    runs[d][-1][1].append(token)
            n_base, first, last, base_labels, labels, score = [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n
            for d, tokens in runs.items():
                base, share, extra = s.scan(tokens)
                if base:
                    n_base[d], first[d], last[d] = len(base), min(base)[0], max(base)[0]
                own = {label for _, label in base}
                base_labels[d], labels[d] = ",".join(sorted(own)), ",".join(sorted(own | extra))
                score[d] = max(share.values(), default=0.0)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, n), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n_base, long), pa.array(first, long), pa.array(last, long), pa.array(base_labels), pa.array(labels), pa.array(score, pa.float64())],
                [f.split()[0] for f in FIELDS.split(", ")],
            )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    narrow_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_scan, FIELDS)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
