"""License scans: an exact set-similarity join of text blocks with license templates, and base phrases.

A template and a block (a line of a document, or a window of the template's length that may cross line breaks) are sets of words. Words are ordered by their frequency over all
documents; a block joins a template only through the template's prefix, the rarest words of which a block at the
containment threshold cannot lack all. Bounds on length and position drop what cannot reach the threshold, and what is
left is verified exactly.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.llm.common import append_columns, pieces

#: Phrases that count wherever their words stand consecutively, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and first paragraphs of common licenses, in words, with their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this work is dedicated to the public domain": "public-domain",
    "copyright all rights reserved": "reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software": "bsl-1.0",
}
#: Share of a template's words that a block must have.
CONTAINMENT = 0.9


def _hash(word: str) -> int:
    data, offsets = arrays.buffer(pa.array([word]))
    return int(arrays.words_hash(data, *arrays.words(data, offsets, arrays.NOT_ALNUM)[:2])[0])


@dataclasses.dataclass(frozen=True)
class Plan:
    """Templates over numbered words: word hashes (sorted), each word's place in the order of rarity, each template's
    words as numbers in that order, its label, its length in words, and base phrases as hash sequences with labels."""

    hashes: np.ndarray
    order: np.ndarray
    templates: list[tuple[np.ndarray, str]]
    needed: list[int]
    lengths: list[int]
    prefixes: dict[int, list[tuple[int, int]]]
    phrases: list[tuple[np.ndarray, str]]


def word_counts(docs: DataFrame, hashes: np.ndarray, text_col: str) -> dict[int, int]:
    """How often each of the (sorted) word hashes stands in all texts; as many rows as there are hashes."""

    def run(batches):
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            column = batch.column(0)
            for start, stop in pieces(column, 2 << 20):
                data, offsets = arrays.buffer(column.slice(start, stop - start))
                starts, ends, _ = arrays.words(data, offsets, arrays.NOT_ALNUM)
                found = arrays.words_hash(data, starts, ends, lower=True)
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                total += np.bincount(at[hashes[at] == found], minlength=len(hashes))
        yield pa.RecordBatch.from_pydict({"hash": hashes.view(np.int64), "n": total})

    counted = docs.select(text_col).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    return {r.hash & (1 << 64) - 1: r.n for r in counted.collect()}


def plan(docs: DataFrame, templates: dict[str, str], containment: float, text_col: str) -> Plan:
    """Words in order of frequency over docs, and with it each template's prefix and least overlap."""
    vocabulary = {w: _hash(w) for t in [*templates, *BASE_PHRASES] for w in t.split()}
    hashes = np.array(sorted(set(vocabulary.values())), np.uint64)
    counts = word_counts(docs, hashes, text_col)
    rarity = {w: (counts.get(h, 0), w) for w, h in vocabulary.items()}
    number = {w: int(np.searchsorted(hashes, np.uint64(h))) for w, h in vocabulary.items()}
    made, needed, prefixes = [], [], {}
    for i, (text, label) in enumerate(templates.items()):
        ordered = sorted(set(text.split()), key=rarity.__getitem__)
        least = max(1, math.ceil(containment * len(ordered) - 1e-9))
        made.append((np.array([number[w] for w in ordered]), label))
        needed.append(least)
        for position, w in enumerate(ordered[: len(ordered) - least + 1]):
            prefixes.setdefault(number[w], []).append((i, position))
    order = np.zeros(len(hashes), np.int64)
    for place, w in enumerate(sorted(vocabulary, key=rarity.__getitem__)):
        order[number[w]] = place
    phrases = [(np.array([vocabulary[w] for w in text.split()], np.uint64), label) for text, label in BASE_PHRASES.items()]
    return Plan(hashes, order, made, needed, [len(t.split()) for t in templates], prefixes, phrases)


def scan_piece(data: np.ndarray, offsets: np.ndarray, rules: Plan, wrapped: bool = False) -> dict[str, list]:
    """The result's columns for the texts of one piece."""
    starts, ends, bounds = arrays.words(data, offsets, arrays.NOT_ALNUM)
    hashes = arrays.words_hash(data, starts, ends, lower=True)
    texts = len(offsets) - 1
    doc = np.repeat(np.arange(texts), np.diff(bounds))
    places, labels_at = [], []
    for sequence, label in rules.phrases:
        k = len(sequence)
        if len(hashes) < k:
            continue
        hit = np.ones(len(hashes) - k + 1, bool)
        for j, h in enumerate(sequence):
            hit &= hashes[j : len(hashes) - k + 1 + j] == h
        at = np.flatnonzero(hit)
        at = at[doc[at] == doc[at + k - 1]]
        places.append(at)
        labels_at.append((at, label))
    every = np.sort(np.concatenate(places)) if places else np.empty(0, np.int64)
    n_base = np.bincount(doc[every], minlength=texts)
    first, last = [None] * texts, [None] * texts
    for at in every.tolist():
        d = int(doc[at])
        where = at - int(bounds[d])
        if first[d] is None:
            first[d] = where
        last[d] = where
    base: dict[int, set[str]] = {}
    for at, label in labels_at:
        for d in np.unique(doc[at]).tolist():
            base.setdefault(d, set()).add(label)
    # blocks: lines; of each, the template words in it
    known = np.minimum(np.searchsorted(rules.hashes, hashes), len(rules.hashes) - 1)
    inside = np.flatnonzero(rules.hashes[known] == hashes)
    breaks = np.flatnonzero(data == 0x0A)
    block, owner_doc = np.searchsorted(breaks, starts[inside]), doc[inside]
    number = known[inside]
    starts_prefix = np.isin(number, np.fromiter(rules.prefixes, np.int64))
    labels: dict[int, set[str]] = {}
    score = np.zeros(texts)
    edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (owner_doc[1:] != owner_doc[:-1])])) if len(inside) else np.empty(0, np.int64)
    ends_ = np.append(edges[1:], len(inside))
    owner = np.repeat(np.arange(len(edges)), ends_ - edges)
    for b in np.unique(owner[starts_prefix]).tolist():
        ordered = np.unique(number[edges[b] : ends_[b]])
        ordered = ordered[np.argsort(rules.order[ordered])].tolist()  # rarest first, as templates are
        words = set(ordered)
        d = int(doc[inside[edges[b]]])
        tried = set()
        for place, w in enumerate(ordered):
            for i, position in rules.prefixes.get(w, ()):
                template, label = rules.templates[i]
                # length: the block has words enough; position: if this is the first word both have, so many at most are
                # left to meet on either side (if it isn't, the pair has been tried at the first one)
                if i in tried or len(words) < rules.needed[i] or min(len(template) - position, len(ordered) - place) < rules.needed[i]:
                    continue
                tried.add(i)
                share = len(words.intersection(template.tolist()))
                if share >= rules.needed[i]:
                    labels.setdefault(d, set()).add(label)
                    score[d] = max(score[d], share / len(template))
    if wrapped:
        # windows of a template's length over the whole text: one that reaches the threshold does so from its first template word on
        for i, (template, label) in enumerate(rules.templates):
            member = np.zeros(len(rules.hashes), bool)
            member[template] = True
            own = member[number]
            at, which, of = inside[own], number[own], owner_doc[own]
            stop = np.searchsorted(at, np.minimum(at + rules.lengths[i], bounds[of + 1]))
            for j in np.flatnonzero(stop - np.arange(len(at)) >= rules.needed[i]).tolist():
                share = len(set(which[j : stop[j]].tolist()))
                if share >= rules.needed[i]:
                    d = int(of[j])
                    labels.setdefault(d, set()).add(label)
                    score[d] = max(score[d], share / len(template))
    out: dict[str, list] = {"n_words": np.diff(bounds).tolist(), "n_base": n_base.tolist(), "first_word": first, "last_word": last, "base_labels": [], "labels": [], "score": []}
    for d in range(texts):
        own = base.get(d, set())
        out["base_labels"].append(",".join(sorted(own)))
        out["labels"].append(",".join(sorted(own | labels.get(d, set()))))
        out["score"].append(1.0 if own else float(score[d]))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of the base phrases; first_word and last_word are their smallest and largest start (null
    if there is none); labels are those of base phrases and of templates a line contains to the threshold, distinct,
    sorted and comma-joined; score is 1 where a base phrase stands, else the best containment. With ``wrapped``, blocks
    are besides lines all windows of a template's number of words, across line breaks. The templates are a
    fixed list, so their counts, prefixes and words go to all tasks; documents aren't shuffled.
    Null and empty texts have no words, empty labels and score 0. Repeated rows and further columns pass through;
    columns with the result's names are replaced. An empty table gives an empty one.
    """
    rules = plan(docs, TEMPLATES if templates is None else templates, containment, text_col)
    kinds = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def make():
        def run(texts: pa.Array) -> dict[str, pa.Array]:
            found = scan_piece(*arrays.buffer(texts), rules, wrapped)
            return {name: pa.array(found[name], types[kind]) for name, kind in kinds.items()}

        return run

    return append_columns(docs, make, list(kinds.items()), text_col, piece_bytes=2 << 20)
