"""Licence scan with a positional index of rare words.

Templates are phrases or notices with mandatory key phrases.  Document
frequencies of all template words are counted over the whole corpus, and the
index maps a word to its postings (template, position).

Of each file the licence words it holds are ranked by inverse document
frequency.  A template is in question only if the file holds all words of its
key phrases; then the file's own ``LOOKED_UP`` highest-ranked words of that
template are looked up, a posting places the template at a start in the file,
and the starts are intersected.  A phrase is verified word by word where its
two rarest words agree on the start (one word that stands alone: at each of its
places).  A notice needs two postings that agree on its start within ``DRIFT``
words, all its key phrases near that place, and ``COVERAGE`` of its words there.

Every place of a phrase holds its two rarest words, so none is missed.

Defined results: null and empty texts have no words, places or labels and the
score 0; repeated rows each get a row; other columns are ignored; on an empty
table there is nothing to count and nothing to return.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelwise.llm.common import alnum_words, ids_and_texts, map_batches, texts_of

DRIFT = 4
COVERAGE = 0.6
LOOKED_UP = 6

#: Phrase -> label: places of these are counted as the base (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further phrase -> label (fixed values).
PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "bsd 3 clause license": "bsd-3",
    "bsd 2 clause license": "bsd-2",
    "the unlicense": "unlicense",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2": "apache-2",
    "all rights reserved": "all-rights-reserved",
}
#: Label, notice, mandatory key phrases (fixed values).
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 "http www apache org licenses LICENSE-2.0", ["except in compliance with the license", "apache org licenses"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation", ["gnu general public license", "free software foundation"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
     ["gnu general public license as published by the free software foundation", "either version 2 of the license"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     ["gnu general public license as published by the free software foundation", "either version 3 of the license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
     "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
     ["gnu lesser general public license as published by the free software foundation", "either version 2 1 of the license"]),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     ["gnu affero general public license as published by the free software foundation", "either version 3 of the license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at http://mozilla.org/MPL/2.0/", ["subject to the terms of the mozilla public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "conditions are met"]),
    ("bsd-2", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
              "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
              "and/or other materials provided with the distribution", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
              "without specific prior written permission", ["may be used to endorse or promote products", "specific prior written permission"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
                  "this software, either in source code form or as a compiled binary, for any purpose", ["free and unencumbered software", "into the public domain"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
             "use of this software", ["in no event will the authors be held liable"]),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
              "this license to use, reproduce, display, distribute, execute, and transmit the Software", ["to any person or organization", "reproduce display distribute execute and transmit"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international license"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["creative commons attribution noderivatives 4 0"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
]


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(alnum_words(text.encode()))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool = False


def templates() -> list[Template]:
    out = [Template(label, _words(p), (_words(p),), True) for p, label in BASE.items()]
    out += [Template(label, _words(p), (_words(p),)) for p, label in PHRASES.items()]
    return out + [Template(label, _words(text), tuple(_words(k) for k in keys)) for label, text, keys in NOTICES]


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Of each template word the number of documents that hold it, over all documents."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                found.update(vocabulary.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}  # at most the words of the templates


class Index:
    """Template words -> postings (template number, position), the words ranked by rarity."""

    def __init__(self, frequencies: dict[bytes, int]):
        self.templates = templates()
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(self.templates):
            for p, word in enumerate(template.words):
                self.postings[word].append((t, p))
        self.vocabulary = frozenset(self.postings)
        self.rank = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (frequencies.get(w, 0), w)))}
        self.phrase = [template.words == template.keys[0] for template in self.templates]
        self.mandatory = [frozenset(w for key in template.keys for w in key) for template in self.templates]

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, score."""
        places: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        score = 0.0
        held = self.vocabulary.intersection(words)
        in_question = [t for t, mandatory in enumerate(self.mandatory) if mandatory <= held]
        if not in_question:
            return places, base, labels, score
        looked_up: dict[bytes, set[int]] = defaultdict(set)  # word -> templates that it is looked up for
        for t in in_question:
            own = sorted(held.intersection(self.templates[t].words), key=self.rank.__getitem__)
            for word in own[:2 if self.phrase[t] else LOOKED_UP]:
                looked_up[word].add(t)
        starts: dict[int, list[tuple[int, int]]] = defaultdict(list)  # template -> (start, position of the posting)
        for i, word in enumerate(words):
            if word in looked_up:
                wanted = looked_up[word]
                for t, p in self.postings[word]:
                    if t in wanted:
                        starts[t].append((i - p, p))
        for t, found in starts.items():
            template = self.templates[t]
            if self.phrase[t]:
                at = self._phrase(words, template, found)
                cover = 1.0 if at else 0.0
                if template.base and at:
                    places += at
                    base.add(template.label)
            else:
                cover = self._notice(words, template, sorted(found))
            if cover >= COVERAGE:
                labels.add(template.label)
                score = max(score, cover)
        return places, base, labels, score

    @staticmethod
    def _phrase(words: list[bytes], template: Template, found: list[tuple[int, int]]) -> list[int]:
        """Starts on which all postings looked up agree, verified word by word."""
        agreeing = Counter(start for start, _ in found)
        needed = len({p for _, p in found})
        size = len(template.words)
        return [a for a, n in agreeing.items() if n == needed and a >= 0 and tuple(words[a:a + size]) == template.words]

    @staticmethod
    def _notice(words: list[bytes], template: Template, starts: list[tuple[int, int]]) -> float:
        """Best coverage over the places where two postings agree and all key phrases stand."""
        best, size, last = 0.0, len(template.words), None
        for (a, p), (b, q) in zip(starts, starts[1:]):
            if p == q or b - a > DRIFT or last is not None and a - last <= DRIFT:
                continue
            last = a
            near = words[max(0, a - DRIFT):max(0, a + size + 2 * DRIFT)]
            text = b" " + b" ".join(near) + b" "
            if all(b" " + b" ".join(k) + b" " in text for k in template.keys):
                have, want = Counter(near), Counter(template.words)
                best = max(best, (have & want).total() / size)
        return best


def scan(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = frozenset(w for t in templates() for w in t.words)
    frequencies = document_frequencies(docs, vocabulary)

    def task():
        index = Index(frequencies)

        def run(batch: pa.RecordBatch) -> dict:
            out = []
            for text in texts_of(batch):
                words = alnum_words(text)
                places, base, labels, score = index.scan(words)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*out))
            return dict(zip(("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), (batch.column(0), *columns)))

        return run

    return map_batches(ids_and_texts(docs), task,
                       "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", per_task=True)
