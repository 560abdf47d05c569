"""License scans by templates with optional and replaceable regions.

A template's text is marked up as in published license lists: `<<beginOptional>>` to
`<<endOptional>>` may be absent, `<<var;name=..;words=N>>` stands for one to N words. Each is
compiled to a token automaton; a text is accepted where all mandatory wording stands exactly.
Words are lower-case runs of ASCII letters and digits and of characters beyond ASCII.

Cases: a null text counts as an empty one (no words, score 0); places may overlap and all count;
texts of any length are read whole, in one pass for each template whose mandatory words all
occur; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, tidy

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, marked-up text), in the order of the labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License<<endOptional>>"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted<<beginOptional>> provided that the following conditions are met<<endOptional>>"),
    ("cc-by", "<<beginOptional>>This work is <<endOptional>>licensed under <<beginOptional>>a <<endOptional>>Creative Commons Attribution <<var;name=version;words=2>> International License"),
    ("cc-by-nc", "<<beginOptional>>This work is <<endOptional>>Licensed under CC BY-NC <<var;name=version;words=2>>"),
    ("gpl", "<<beginOptional>>This work is <<endOptional>>licensed under the GNU General Public License<<beginOptional>>, version <<var;name=version;words=1>><<endOptional>>"),
    ("gpl", "This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "<<beginOptional>>Released <<endOptional>>under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


@dataclass(frozen=True)
class Automaton:
    """moves[state]: (word or None for any, next state) pairs and states reached without a word; the last state accepts."""

    label: str
    words: tuple[tuple[tuple[bytes | None, int], ...], ...]
    free: tuple[tuple[int, ...], ...]
    mandatory: frozenset[bytes]
    n_mandatory: int

    def closed(self, states: set[int]) -> set[int]:
        found, rest = set(states), list(states)
        while rest:
            for s in self.free[rest.pop()]:
                if s not in found:
                    found.add(s)
                    rest.append(s)
        return found

    def first_words(self) -> set[bytes | None]:
        return {w for s in self.closed({0}) for w, _ in self.words[s]}

    def end_of(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from start, if there is one."""
        states, end = self.closed({0}), None
        for i in range(start, len(words) + 1):
            if len(self.words) - 1 in states:
                end = i
            if i == len(words):
                break
            states = self.closed({t for s in states for w, t in self.words[s] if w is None or w == words[i]})
            if not states:
                break
        return end


def compile_template(label: str, marked: str) -> Automaton:
    moves: list[list[tuple[bytes | None, int]]] = [[]]
    free: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory: list[bytes] = []

    def state() -> int:
        moves.append([])
        free.append([])
        return len(moves) - 1

    for k, part in enumerate(MARK.split(marked)):
        at = len(moves) - 1
        if k % 2 == 0:
            for w in words_of(part):
                moves[at].append((w, state()))
                at = len(moves) - 1
                if not opened:
                    mandatory.append(w)
        elif part == "beginOptional":
            opened.append(at)
            free[at].append(state())
        elif part == "endOptional":
            begin, end = opened.pop(), state()
            free[at].append(end)
            free[begin].append(end)
        else:
            most = int(dict(x.split("=", 1) for x in part.split(";")[1:]).get("words", 1))
            places = [at] + [state() for _ in range(most)]
            for a, b in zip(places, places[1:], strict=False):
                moves[a].append((None, b))
            for p in places[1:-1]:
                free[p].append(places[-1])
    return Automaton(label, tuple(map(tuple, moves)), tuple(map(tuple, free)), frozenset(mandatory), len(mandatory))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place of a phrase."""
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                found.append((at, label))
    return sorted(found)


def template_matches(words: list[bytes], automata: list[Automaton]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the accepted runs, the longest of each start."""
    present, found = set(words), []
    for a in automata:
        if not a.mandatory <= present:
            continue
        first, taken = a.first_words(), 0
        for i, w in enumerate(words):
            if i >= taken and (w in first or None in first) and (end := a.end_of(words, i)) is not None:
                found.append((i, end, a.label))
                taken = end
    return sorted(found)


MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
PLACE = pa.struct([("start", pa.int64()), ("label", pa.string())])
SCHEMA = "n_words long, places array<struct<start:long,label:string>>, matches array<struct<start:long,end:long,label:string>>"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places of phrases, matches of templates) of every row; places in words from 0."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(*t) for t in templates]
        for batch in batches:
            sizes, places, matches = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                sizes.append(len(words))
                places.append([{"start": s, "label": x} for s, x in base_places(words)])
                matches.append([{"start": s, "end": e, "label": x} for s, e, x in template_matches(words, automata)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(PLACE)), pa.array(matches, pa.list_(MATCH))], names=["doc_id", "n_words", "places", "matches"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), f"doc_id {kind}, {SCHEMA}")


def license_digest(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query; score: 1 for an accepted template, 0.5 for phrases alone."""
    starts = F.col("places.start")
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("places.label")).alias("base_labels"),
        labels(F.concat(F.col("places.label"), F.col("matches.label"))).alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"),
    )
