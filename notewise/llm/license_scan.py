"""Licence notes in texts: phrases, and an exact set-similarity join with licence templates."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.frames import picked, slices, text_of

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Usual wordings of licence notes.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
CONTAINMENT = 0.8
#: bytes of word characters after lower-casing A-Z
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: bytes) -> list[bytes]:
    return WORDS(text.lower())


def needed(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


class TemplateIndex:
    """Templates as word sets in the global order, rarest first, with the postings of their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: Mapping[bytes, int], containment: float):
        self.containment = containment
        vocabulary = {w for _, t in templates for w in words(t.encode())}
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets = [(label, sorted({self.rank[w] for w in words(t.encode())})) for label, t in templates]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, tokens) in enumerate(self.sets):
            for i, token in enumerate(tokens[: len(tokens) - needed(len(tokens), containment) + 1]):
                self.postings[token].append((k, i))
        self.spans = [math.ceil(len(words(t.encode())) / containment) for _, t in templates]
        by_rank = {r: w for w, r in self.rank.items()}
        self.prefix_words = frozenset(by_rank[r] for r in self.postings)

    def matches(self, block: Sequence[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that the block contains to the wanted degree."""
        if self.prefix_words.isdisjoint(block):
            return
        tokens = sorted({self.rank[w] for w in block if w in self.rank})
        seen: set[int] = set()
        for j, token in enumerate(tokens):
            for k, i in self.postings.get(token, ()):
                if k in seen:
                    continue
                label, own = self.sets[k]
                least = needed(len(own), self.containment)
                # length filter, and what either side can still share from here on
                if len(tokens) < least or 1 + min(len(own) - i - 1, len(tokens) - j - 1) < least:
                    continue
                seen.add(k)
                shared = len(set(own).intersection(tokens))
                if shared >= least:
                    yield label, shared / len(own)


    def windows(self, tokens: Sequence[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that some run of words contains to the wanted degree, wherever lines end.

        A template's runs have its number of words divided by the wanted containment; every placement is looked at.
        """
        if self.prefix_words.isdisjoint(tokens):
            return
        places = [(i, self.rank[w]) for i, w in enumerate(tokens) if w in self.rank]
        for k in sorted({k for r in {r for _, r in places} for k, _ in self.postings.get(r, ())}):
            label, own = self.sets[k]
            least, mine = needed(len(own), self.containment), frozenset(own)
            at = [(i, r) for i, r in places if r in mine]
            if len({r for _, r in at}) < least:
                continue
            held: Counter = Counter()
            first = best = 0
            for i, r in at:
                held[r] += 1
                while at[first][0] <= i - self.spans[k]:
                    held[at[first][1]] -= 1
                    if not held[at[first][1]]:
                        del held[at[first][1]]
                    first += 1
                best = max(best, len(held))
            if best >= least:
                yield label, best / len(own)


def template_frequencies(texts: DataFrame, templates: Sequence[tuple[str, str]]) -> dict[bytes, int]:
    """How often each template word stands in all texts.  As many numbers as the templates have words."""
    vocabulary = frozenset(w for _, t in templates for w in words(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, "text"):
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                total.update(filter(vocabulary.__contains__, words(value)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def phrase_places(tokens: list[bytes], phrases: Mapping[str, str]) -> list[tuple[int, str]]:
    split = [(p.encode().split(), label) for p, label in phrases.items()]
    last = defaultdict(list)
    for parts, label in split:
        last[parts[-1]].append((parts, label))
    out = []
    for i, w in enumerate(tokens):
        for parts, label in last.get(w, ()):
            start = i - len(parts) + 1
            if start >= 0 and tokens[start:i + 1] == parts:
                out.append((start, label))
    return out


def license_marks(records: DataFrame, key: str = "key", text: str = "text", phrases: Mapping[str, str] = PHRASES,
                  templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Licence labels of whole texts.

    The library's own records hold notes, so the operator is general: ``records`` is any table with a ``key`` and a ``text`` (rights
    lines and notes that come with scores).  A-Z lower-cased; words are runs of digits, letters and characters beyond ASCII.
    A base label stands where a phrase's words follow each other.  Further labels come from blocks (lines, and
    for each template all runs of words of its length by the containment, across line ends): a template is found in every block that holds at least ``containment`` of its word set; words are ordered by their frequency in all texts, and
    the prefix, length and positional filters leave out no such block.

    Returns per row: the key, ``n_words``, ``n_base``, ``first_word`` and ``last_word`` (smallest and largest start, null without
    any), ``base_labels``, ``labels`` (distinct, sorted, comma-joined), ``score`` (largest containment found; 1 with a
    base label; else 0).  A null text is empty.  Every row returns, repeated or not; null keys stay null; other columns are not
    looked at.  Two passes over the texts, no shuffle of them.
    """
    src = picked(records, key=key, text=text).select("key", text_of("text").alias("text"))
    index = TemplateIndex(templates, template_frequencies(src, templates), containment)
    final_words = [p.encode().split()[-1] for p in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                lower = value.lower()
                found: dict[str, float] = {}
                tokens = WORDS(lower)
                n = len(tokens)
                if not index.prefix_words.isdisjoint(tokens):
                    lines = (m for line in lower.split(b"\n") for m in index.matches(WORDS(line)))
                    for label, share in chain(lines, index.windows(tokens)):
                        found[label] = max(found.get(label, 0.0), share)
                base = phrase_places(tokens, phrases) if any(w in lower for w in final_words) else []
                starts = [s for s, _ in base]
                base_labels = {label for _, label in base}
                score = 1.0 if base else max(found.values(), default=0.0)
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
                             ",".join(sorted(base_labels | set(found))), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["key", *names])

    kind = src.schema["key"].dataType.simpleString()
    out = src.mapInArrow(run, f"key {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    return out.withColumnRenamed("key", key)
