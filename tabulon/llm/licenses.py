"""Licence scans with a positional index of rare words.

The templates (the notices by which files refer to a licence, and passages of the licences that no other one has) are indexed by word: postings (template, position).
A word's weight is its inverse document frequency over all scanned documents, counted for the words of the templates only, so the table
has the size of the templates.  Of each template the ``RARE`` words with the highest weights are indexed, so what a template needs never
depends on what else stands in a file.  Of templates up to ``WHOLE_UPTO`` words every word must stand in place.  All of a file's words are looked up; a posting votes with its weight for (template,
document position - template position), and places where enough weight agrees are verified: the template's mandatory key phrases must
stand there, word by word.

Base labels come from fixed phrases, found as consecutive words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

# Phrases and their labels, as the contract gives them.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> (text, mandatory key phrases within it): short notices, and passages of the licences: what a licence says of others (the GPL names the lesser
#: and the Affero one) is no label.
TEMPLATES = {
    "agpl": [
        ("the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software", ["specifically designed to ensure cooperation with the community in the case of network server software"]),
        ("licensed under the gnu affero general public license version 3", ["affero general public license"]),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license"]),
    ],
    "apache-2.0": [
        ("license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license", ["as defined by sections 1 through 9 of this document"]),
        ("grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ["each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"]),
        ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["except in compliance with the license", "without warranties or conditions of any kind"]),
    ],
    "bsd": [
        ("licensed under the bsd 3 clause license", ["bsd 3 clause"]),
        ("licensed under the bsd 2 clause license", ["bsd 2 clause"]),
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
        ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ],
    "bsl-1.0": [("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ["obtaining a copy of the software and accompanying documentation"])],
    "cc-by-4.0": [("licensed under cc by 4 0", ["cc by 4 0"]), ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"])],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", ["cc by nc 4 0"]), ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0"])],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", ["cc by sa 4 0"]), ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0"])],
    "cc0": [
        ("dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
        ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ],
    "gpl-2.0": [
        ("the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users", ["general public license is intended to guarantee your freedom to share and change free software"]),
        ("licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
        ("free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["gnu general public license", "either version 2"]),
    ],
    "gpl-3.0": [
        ("the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works", ["the gnu general public license is a free copyleft license for software and other kinds of works"]),
        ("licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
        ("free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["gnu general public license", "either version 3"]),
    ],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["and or distribute this software for any purpose"])],
    "lgpl": [
        ("this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it", ["the lesser general public license applies to some specially designated software packages"]),
        ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below", ["this version of the gnu lesser general public license"]),
        ("licensed under the gnu lesser general public license", ["lesser general public license"]),
        ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ],
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission is hereby granted free of charge", "and associated documentation files"]),
    ],
    "mpl-2.0": [("contributor means each individual or legal entity that creates contributes to the creation of or owns covered software contributor version means the combination of the contributions of others if any used by a contributor and that particular contributor s contribution", ["creates contributes to the creation of or owns covered software"]), ("mozilla public license version 2 0", ["mozilla public license version 2 0"]), ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license"])],
    "proprietary": [("all rights reserved no part of this software may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the copyright holder", ["no part of this software may be reproduced"]), ("this software is proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited", ["proprietary and confidential"])],
    "unlicense": [("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software"])],
    "zlib": [("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["alter it and redistribute it freely"])],
}

#: Indexed words of each template.
RARE = 24
#: Templates up to so many words have to stand there word by word.
WHOLE_UPTO = 12
#: The weight that must agree, as a share.
AGREEMENT = 0.5


class LicenceIndex:
    def __init__(self, templates: dict[str, list[tuple[str, list[str]]]], phrases: dict[str, str]) -> None:
        self.labels, self.words, self.keys = [], [], []
        for label, passages in sorted(templates.items()):
            for passage, keys in passages:
                own = tk.hash_words([passage], tk.ALNUM_FOLDED)[0].tolist()
                self.labels.append(label)
                self.words.append(own)
                found = [(0, np.array(own, np.uint64))] if len(own) <= WHOLE_UPTO else []
                for k in tk.hash_words(keys, tk.ALNUM_FOLDED):
                    at = [i for i in range(len(own) - len(k) + 1) if own[i : i + len(k)] == k.tolist()]
                    if not at:
                        raise ValueError(f"a key phrase of {label} isn't in its passage")
                    found.append((at[0], k))
                self.keys.append(found)
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], np.uint64))
        self.phrases = [(tk.hash_words([p], tk.ALNUM_FOLDED)[0], label) for p, label in phrases.items()]

    def weigh(self, df: dict[int, int], documents: int) -> None:
        """Sets the weights from the number of documents that have each word, and indexes each template's rarest words."""
        weight = np.array([math.log((1 + documents) / (1 + df.get(i, 0))) for i in range(len(self.vocabulary))])
        rows, self.total = [], np.zeros(len(self.words))
        for t, own in enumerate(self.words):
            entry = np.searchsorted(self.vocabulary, np.array(own, np.uint64))
            rare = np.lexsort((np.arange(len(own)), -weight[entry]))[:RARE]
            self.total[t] = max(float(weight[entry[rare]].sum()), 1e-9)
            rows += [(int(entry[i]), t, int(i), float(weight[entry[i]])) for i in rare.tolist()]
        rows.sort()
        # Postings of a word: template, position and weight, at first[word]:first[word + 1].
        self.template, self.place, self.weight = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
        self.first = np.searchsorted([r[0] for r in rows], np.arange(len(self.vocabulary) + 1))

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and vocabulary entries of the licence words."""
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        hit = np.flatnonzero(self.vocabulary[at] == h)
        return hit, at[hit]

    def match(self, w: tk.Words, position: np.ndarray, entry: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(document, label, share of the template's weight that agrees in place) of a group of documents."""
        many = self.first[entry + 1] - self.first[entry]
        at = np.repeat(self.first[entry] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        doc = np.searchsorted(w.first, position, "right") - 1
        # A place is where the template would begin, in words of the group; its document is that of the words which vote.
        begin = np.repeat(position, many) - self.place[at]
        vote = np.stack([np.repeat(doc, many), self.template[at], begin], axis=1)
        places, which = np.unique(vote, axis=0, return_inverse=True) if len(vote) else (vote, np.empty(0, np.int64))
        share = np.minimum(1.0, np.bincount(which.ravel(), self.weight[at], len(places)) / self.total[places[:, 1]] if len(places) else np.empty(0))
        for i in np.flatnonzero(share >= AGREEMENT).tolist():
            d, t, begin = places[i].tolist()
            low, high = int(w.first[d]), int(w.first[d + 1])
            if all(begin + k >= low and begin + k + len(key) <= high and np.array_equal(w.h[begin + k : begin + k + len(key)], key) for k, key in self.keys[t]):
                yield d, self.labels[t], float(share[i])


def _frequencies(docs: DataFrame, index: LicenceIndex) -> tuple[dict[int, int], int]:
    """In how many documents each licence word stands, over all documents (a table as small as the templates)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(shared.value.vocabulary), np.int64), 0
        for batch in batches:
            for w in tk.words(tk.column(batch.column(1)), tk.ALNUM_FOLDED):
                at, entry = shared.value.found(w.h)
                doc = np.searchsorted(w.first, at, "right") - 1
                total += np.bincount(np.unique(doc * len(total) + entry) % len(total), minlength=len(total))
                n += w.hi - w.lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.concatenate([[n], total]))], names=["entry", "n"])

    rows = docs.mapInArrow(scan, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect()
    df = {r.entry: r.n for r in rows}
    return df, df.pop(-1, 0)


def scan_licences(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[tuple[str, list[str]]]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest
    and largest start of one, else null), base_labels, labels (distinct, sorted, comma-joined), score.

    Words are ASCII letters and digits, with A-Z folded, and all beyond ASCII.  A null or empty text has no words, no
    labels and score 0.  The score is 1 with a base phrase, else the largest share of a template's rare words that
    stands in place.  Repeated rows are scanned each on its own; other columns are ignored.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = LicenceIndex(TEMPLATES if templates is None else templates, BASE_PHRASES if phrases is None else phrases)
    index.weigh(*_frequencies(docs, index))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for w in tk.words(tk.column(batch.column(1)), tk.ALNUM_FOLDED):
                n = w.hi - w.lo
                places: list[list[int]] = [[] for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in index.phrases:
                    starts = tk.gram_starts(w.first, len(phrase))
                    ok = w.h[starts] == phrase[0]
                    for j in range(1, len(phrase)):
                        ok &= w.h[starts + j] == phrase[j]
                    at = starts[ok]
                    for d, p in zip((np.searchsorted(w.first, at, "right") - 1).tolist(), at.tolist(), strict=True):
                        places[d].append(p - int(w.first[d]))
                        base[d].add(label)
                labels, score = [set(x) for x in base], [1.0 if x else 0.0 for x in base]
                position, entry = index.found(w.h)
                for d, label, share in index.match(w, position, entry):
                    labels[d].add(label)
                    score[d] = max(score[d], share)
                arrays = [
                    batch.column(0).slice(w.lo, n),
                    pa.array(np.diff(w.first)),
                    pa.array([len(x) for x in places], pa.int64()),
                    pa.array([min(x) if x else None for x in places], pa.int64()),
                    pa.array([max(x) if x else None for x in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(score, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
