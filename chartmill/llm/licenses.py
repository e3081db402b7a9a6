"""License scans with a positional index of each template's rarest words.

A word's rarity falls with its document frequency, counted over all documents, and is never 0.  A template is found where
words that hold at least MATCH of its rarity stand at their places relative to one another, up to SLACK inserted or lost
words, and one of its mandatory phrases stands there whole.  Such a place can lack little of the rarity, so it has at
least two of the template's rarest words, as many of them as hold more than the rest may lack.  The index has the
(template, position) postings of those words alone: a file's words are looked up, postings are intersected by relative
position, and what has two of them is compared word by word, and its phrases are verified.

Documents are scanned where they are, twice: once to count the few licence words, once to look them up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import ALNUM, double, emit, long, split_words, starts_of, string, with_columns

#: Phrases whose places are always reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences and paragraphs of public licences and their notices, as words, with the phrases that must
#: stand in them (one of them is enough).
TEMPLATES = {
    "mit": [("released under the mit license", ["mit license"]), ("licensed under the mit license", ["mit license"]), ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["free of charge to any person"]), ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included in all copies or substantial portions"])],
    "apache-2.0": [("licensed under the apache license version 2 0", ["apache license"]), ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]), ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["specific language governing permissions and limitations"])],
    "gpl": [("this work is licensed under the gnu general public license version", ["general public license"]), ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]), ("you should have received a copy of the gnu general public license along with this program if not see", ["copy of the gnu general public license"])],
    "lgpl": [("under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]), ("you should have received a copy of the gnu lesser general public license along with this library if not see", ["gnu lesser general public license"])],
    "agpl": [("under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]), ("you should have received a copy of the gnu affero general public license along with this program if not see", ["gnu affero general public license"])],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]), ("licensed under the bsd license", ["bsd license"]), ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]), ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"])],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"])],
    "zlib": [("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["alter it and redistribute it freely"])],
    "bsl-1.0": [("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", ["any person or organization obtaining a copy"]), ("distributed under the boost software license version 1 0", ["boost software license"])],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]), ("if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl was not distributed"])],
    "epl-2.0": [("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"])],
    "ofl-1.1": [("this font software is licensed under the sil open font license version 1 1", ["sil open font license"])],
    "cc-by-4.0": [("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"])],
    "cc-by-nc": [("licensed under cc by nc", ["cc by nc"]), ("licensed under a creative commons attribution noncommercial international license", ["creative commons attribution noncommercial"])],
    "cc-by-sa": [("licensed under cc by sa", ["cc by sa"]), ("licensed under a creative commons attribution sharealike international license", ["creative commons attribution sharealike"])],
    "cc-by-nd": [("licensed under cc by nd", ["cc by nd"])],
    "cc0": [("released under the cc0 public domain dedication", ["cc0"]), ("to the extent possible under law the author has waived all copyright and related rights", ["waived all copyright and related"])],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["released into the public domain"]), ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy modify publish use compile sell or distribute"])],
}
#: Short names of public licences, as words; each is looked for as an SPDX tag and as the title after it.
NAMES = {
    "mit": ("mit", "mit license"), "apache-2.0": ("apache 2 0", "apache license"), "gpl": ("gpl", "gnu general public license"), "lgpl": ("lgpl", "gnu lesser general public license"), "agpl": ("agpl", "gnu affero general public license"),
    "bsd": ("bsd", "bsd license"), "isc": ("isc", "isc license"), "zlib": ("zlib", "zlib license"), "bsl-1.0": ("bsl 1 0", "boost software license"), "mpl-2.0": ("mpl 2 0", "mozilla public license"), "epl-2.0": ("epl 2 0", "eclipse public license"),
    "ofl-1.1": ("ofl 1 1", "sil open font license"), "cc-by-4.0": ("cc by 4 0", "creative commons attribution 4 0"), "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial"), "cc-by-sa": ("cc by sa", "creative commons attribution sharealike"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives"), "cc0": ("cc0 1 0", "creative commons zero"), "unlicense": ("unlicense", "the unlicense"),
}
#: Titles that differ in more than a word.
TITLES = {"bsd": ["bsd 2 clause license", "bsd 3 clause license", "2 clause bsd license", "3 clause bsd license", "simplified bsd license", "new bsd license"], "lgpl": ["gnu library general public license"]}
for _label, (_tag, _title) in NAMES.items():
    TEMPLATES[_label] = TEMPLATES[_label] + [(x, [x]) for x in (f"spdx license identifier {_tag}", _title, *TITLES.get(_label, []))]
#: An alignment counts from this share of its template's rarity, and may have so many words more or fewer between two.
MATCH, SLACK = 0.6, 3


class Index:
    """Postings of all templates; the rarity of words comes from the corpus."""

    def __init__(self, templates: dict, base: dict) -> None:
        self.rows = [(label, text.split(), [p.split() for p in phrases]) for label, texts in templates.items() for text, phrases in texts]
        self.base = [(phrase.split(), label) for phrase, label in base.items()]
        words = sorted({w for _, text, phrases in self.rows for w in [*text, *(x for p in phrases for x in p)]} | {w for phrase, _ in self.base for w in phrase})
        self.words, self.code = pa.array(words, pa.string()), {w: i for i, w in enumerate(words)}
        self.rarity = np.zeros(len(words))

    def weigh(self, documents: int, frequency: dict[str, int]) -> Index:
        """The index with rarities from document frequencies; a word that no document has is rarest, one that all have keeps a share."""
        self.rarity = np.array([np.log1p((documents + 1) / (frequency.get(w, 0) + 1)) for w in self.words.to_pylist()])
        self.texts = [np.array([self.code[w] for w in text], np.int64) for _, text, _ in self.rows]
        # the first place of each mandatory phrase in its template, and its length
        self.phrases = [[(next(i for i in range(len(text)) if text[i : i + len(p)] == p), len(p)) for p in phrases] for _, text, phrases in self.rows]
        self.rarest, self.least = [], []
        for words in self.texts:
            order = np.argsort(-self.rarity[words], kind="stable")
            held = np.cumsum(self.rarity[words][order])
            spare = (1 - MATCH) * held[-1] * (1 + 1e-9)
            # more than may lack stands in all but one of these, so two are there; else in one
            two = np.flatnonzero(held - held[0] > spare)
            self.least.append(2 if len(two) else 1)
            self.rarest.append(order[: (two[0] if len(two) else np.flatnonzero(held > spare)[0]) + 1])
        self.posting = np.array(sorted({(int(self.texts[t][p]), t, int(p)) for t, places in enumerate(self.rarest) for p in places}), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.posting[:, 0], np.arange(len(self.words) + 1))
        return self

    def codes(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def phrase_at(self, code: np.ndarray, phrase: list[str], owner: np.ndarray) -> np.ndarray:
        """Whether a phrase begins at each word, within one text."""
        n, m = len(code), len(phrase)
        out = np.zeros(n, bool)
        if n >= m:
            out[: n - m + 1] = owner[: n - m + 1] == owner[m - 1 :]
            for k, w in enumerate(phrase):
                out[: n - m + 1] &= code[k : n - m + 1 + k] == self.code[w]
        return out

    def alignments(self, code: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(row, template, start, share of its rarity) of verified alignments: the words that count, and a phrase, are at
        their place from start, or up to SLACK words after it."""
        at = np.flatnonzero(code >= 0)
        sizes = self.first[code[at] + 1] - self.first[code[at]]
        which = np.repeat(self.first[code[at]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        at = np.repeat(at, sizes)
        _, template, position = self.posting[which].T
        out = []
        for t in np.unique(template).tolist():
            here, words = template == t, self.texts[t]
            starts = (at[here] - position[here])[:, None] - np.arange(SLACK + 1)
            row, start = np.unique(np.stack([np.repeat(owner[at[here]], SLACK + 1), starts.ravel()]), axis=1)  # start may lie before the text

            def stands(p: int, shift: int) -> np.ndarray:
                place = start + p + shift  # noqa: B023
                inside = (place >= first[row]) & (place < first[row + 1])  # noqa: B023
                inside[inside] = code[place[inside]] == words[p]  # noqa: B023
                return inside

            shifts = range(SLACK + 1)
            found = {int(p): np.any([stands(int(p), d) for d in shifts], axis=0) for p in self.rarest[t]}
            enough = sum(x.astype(int) for x in found.values()) >= self.least[t]
            row, start, found = row[enough], start[enough], {p: x[enough] for p, x in found.items()}
            if not len(row):
                continue
            found |= {p: np.any([stands(p, d) for d in shifts], axis=0) for p in range(len(words)) if p not in found}
            share = sum(self.rarity[words[p]] * found[p] for p in range(len(words))) / self.rarity[words].sum()
            whole = np.any([np.all([stands(p, d) for p in range(k, k + m)], axis=0) for k, m in self.phrases[t] for d in shifts], axis=0)
            out += [(int(row[i]), t, int(start[i] - first[row[i]]), float(share[i])) for i in np.flatnonzero(whole & (share >= MATCH)).tolist()]
        return out


def frequencies(df: DataFrame, text: str, index: Index) -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents with each licence word, over all rows."""

    def kernel():
        def work(part: pa.RecordBatch):
            words, counts = split_words(part.column(0), ALNUM)
            code = index.codes(words)
            owner = np.repeat(np.arange(len(counts)), counts)
            real = code >= 0
            pairs = np.unique(owner[real] * len(index.words) + code[real]) % max(1, len(index.words))
            df_ = np.bincount(pairs, minlength=len(index.words))
            yield pa.RecordBatch.from_arrays([pa.array([None, *index.words.to_pylist()], pa.string()), pa.array([len(counts), *df_.tolist()], pa.int64())], names=["word", "n"])

        return work

    rows = emit(df, [text], text, "word string, n long", kernel).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found.pop(None, 0), found


def scan(df: DataFrame, text: str = "text", templates: dict | None = None, base: dict | None = None) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words are runs of lower-cased ASCII letters, digits and non-ASCII characters.  n_base counts all places of the
    base phrases; first_word and last_word are the least and greatest start among them, from 0, else null.  labels
    are the base labels and those of verified templates; both lists are distinct, sorted and comma-joined.  score is
    the best share of a template's rarity at a verified place, 1 if a base phrase stands alone, 0 without a label.
    Null and empty texts have no words and no label; very long texts are scanned whole.  Equally rare words are
    looked up in their order, which changes no result.  Repeated rows count in the frequencies and are scanned
    each.  No rows in, no rows out.  Columns with a result's name, in any case, are replaced.
    """
    index = Index(TEMPLATES if templates is None else templates, BASE if base is None else base)
    index.weigh(*frequencies(df, text, index))
    fields = [long("n_words"), long("n_base"), long("first_word"), long("last_word"), string("base_labels"), string("labels"), double("score")]
    return with_columns(df, text, fields, scanner(index, text))


def scanner(index: Index, text: str) -> Callable:
    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            words, counts = split_words(part.column(part.schema.get_field_index(text)), ALNUM)
            code, first = index.codes(words), starts_of(counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            n = len(counts)
            n_base, low, high = np.zeros(n, np.int64), [None] * n, [None] * n
            fixed, found, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for phrase, label in index.base:
                for at in np.flatnonzero(index.phrase_at(code, phrase, owner)).tolist():
                    row = int(owner[at])
                    place = at - int(first[row])
                    n_base[row] += 1
                    low[row] = place if low[row] is None else min(low[row], place)
                    high[row] = place if high[row] is None else max(high[row], place)
                    fixed[row].add(label)
            for row, t, _, share in index.alignments(code, owner, first):
                found[row].add(index.rows[t][0])
                score[row] = max(score[row], share)
            score = [float(s) if s else 1.0 if f else 0.0 for s, f in zip(score, fixed, strict=True)]
            both = [",".join(sorted(a | b)) for a, b in zip(fixed, found, strict=True)]
            return [pa.array(counts), pa.array(n_base), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([",".join(sorted(x)) for x in fixed], pa.string()), pa.array(both, pa.string()), pa.array(score, pa.float64())]

        return work

    return kernel
