"""Licence scan with a positional index of rare words.

Every licence template is a run of words with a mandatory key phrase in it.  The index
posts each template under all words of its key phrase, with their offsets.  A file
takes those of its words that the index has, from the one that is rarest in the
corpus (of the highest inverse document frequency, counted over all documents) on;
each hit proposes a place where the template would start.  A template's proposals
from its ``LOOKUPS`` rarest words in the file are intersected by relative position,
and what is left is verified: the key phrase must stand there word by word, and
the rest of the template is then compared at the same alignment for the score.

A phrase stands where all of its words stand, so the proposals of any of them have
every place: intersecting loses none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

#: Key phrases and their labels that must be reported wherever they stand (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Openings and headings of public licences: (label, template, mandatory key phrase in it that no other of these licences has), fixed values.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "free of charge to any person obtaining a copy of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "free of charge to any person or organization obtaining a copy"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license", "terms of the eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", "creative commons attribution sharealike"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives license", "creative commons attribution noderivatives"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike license", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives license", "creative commons attribution noncommercial noderivatives"),
]
#: Share of a template that has to stand around its key phrase for a label beyond the base ones.
LEAST = 0.5
#: Words that deny what follows them, within so many words before the key phrase.
DENIALS, BEFORE = frozenset(w.encode() for w in ("not", "never", "neither", "nor", "no", "isn", "aren", "wasn", "don", "doesn", "cannot", "unlike")), 6

#: Rare words of a template whose proposals are intersected.
LOOKUPS = 2

#: Bytes of a word, lower-cased; every other byte becomes a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words over digits, a-z and all characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_WORD).split()


class Index:
    """Postings (template, offset) of the key phrases' words."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int):
        self.templates: list[tuple[str, list[bytes], list[bytes], int, bool]] = []
        for label, full, key, is_base in [*((label, key, key, True) for key, label in BASE.items()), *((*t, False) for t in TEMPLATES)]:
            whole, part = full.encode().split(), key.encode().split()
            shift = next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)
            self.templates.append((label, whole, part, shift, is_base))
        self.keys = [frozenset(key) for _, _, key, _, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, _, key, shift, _) in enumerate(self.templates):
            for i, word in enumerate(key):
                self.postings.setdefault(word, []).append((t, shift + i))
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for w in self.postings}

    def starts(self, words: list[bytes]) -> dict[int, set[int]]:
        """Each template's starts that its rarest words in this file agree on."""
        present = self.postings.keys() & set(words)
        possible = {t for t, key in enumerate(self.keys) if key <= present}
        proposed: dict[int, set[int]] = {}
        looked = dict.fromkeys(possible, 0)
        for rare in sorted(present, key=lambda w: (-self.idf[w], w)) if possible else ():
            wanted = [(t, offset) for t, offset in self.postings[rare] if t in possible and looked[t] < LOOKUPS]
            if not wanted:
                continue
            places, at = [], -1
            for _ in range(words.count(rare)):
                at = words.index(rare, at + 1)
                places.append(at)
            for t, offset in wanted:
                own = {at - offset for at in places}
                proposed[t] = proposed[t] & own if looked[t] else own
                looked[t] += 1
        return proposed

    def scan(self, text: str) -> dict:
        words = words_of(text)
        places: list[tuple[int, int]] = []
        found: list[tuple[int, int, str, float]] = []  # where a key phrase begins and ends, its label, and the share of its template
        base: set[str] = set()
        score = 0.0
        for t, proposed in self.starts(words).items():
            label, full, key, shift, is_base = self.templates[t]
            for start in proposed:
                at, end = start + shift, start + shift + len(key)
                if words[at:end] != key:
                    continue
                if is_base:
                    base.add(label)
                    places.append((start, t))
                    score = 1.0
                    continue
                same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(full))
                if same / len(full) >= LEAST and not DENIALS & set(words[max(0, at - BEFORE) : at]):
                    found.append((at, end, label, same / len(full)))
        # of key phrases at one place the longest one names the licence
        longest = {}
        for at, end, _, _ in found:
            longest[at] = max(end, longest.get(at, 0))
        found = [f for f in found if f[1] == longest[f[0]]]
        labels = base | {label for _, _, label, _ in found}
        score = max([score, *(share for _, _, _, share in found)])
        starts = [p for p, _ in places]
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": score,
        }


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def word_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the key phrases stands, over all of
    ``docs``, and their number.  The result is as long as the index's list of words."""
    names = sorted(Index({}, 0).postings)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(names)}
        total, n = np.zeros(len(names), dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for text in batch.column(0).slice(at, 1024).to_pylist():
                    total[[number[w] for w in number.keys() & set(words_of(text or ""))]] += 1
                    n += 1
        yield pa.RecordBatch.from_pydict({"word": [*range(len(names)), -1], "n": [*total.tolist(), n]})

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return {w: found.get(i, 0) for i, w in enumerate(names)}, found.get(-1, 0)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence phrases of every whole text, one output row a row.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (word numbers of the first and last place, null without one),
    base_labels and labels (distinct, sorted, comma-joined; empty without any)
    and score (the best share of a template that stands where its key phrase
    does; 0 without a label).  A label beyond the base ones takes LEAST of its template, and
    no denial in the BEFORE words before its key phrase; where the key phrase of a longer
    relative begins at the same word, that one names the licence.

    A null text counts as empty, a text of any length is scanned as a whole.  A null
    doc_id is kept; equal rows each get a row; an empty table gives an empty one; no
    other column is read.  Two labels of one text are both reported.  Rows don't
    move: the only shuffle sums the frequencies of the templates' words.
    """
    frequency, n_docs = word_frequencies(docs)

    def make() -> Callable[[list[str]], dict[str, list]]:
        index = Index(frequency, n_docs)

        def work(texts: list[str]) -> dict[str, list]:
            rows = [index.scan(t) for t in texts]
            return {f.name: [r[f.name] for r in rows] for f in FIELDS}

        return work

    return map_texts(docs, make, FIELDS)
