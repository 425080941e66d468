"""License scans: exact phrases, and a fuzzy search for short notices.

A text is brought to its words in lower case, joined by one blank, so that line breaks, comment marks and punctuation don't count.
A notice that may have k errors is split into k + 1 pieces, of which any match holds at least one unchanged (pigeonhole). One
automaton finds the pieces of all notices exactly; around each find the ``regex`` library matches the notice with at most k
insertions, deletions and substitutions of characters, at word bounds, and reports the span and the errors of the best match.

Null and empty texts have no words and no labels. Texts may be of any length and are scanned whole. Repeated rows are rows of their own, and ids may be null.
Columns of the input may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import WORD, words


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    errors: int = 0


#: Phrases that stand for a license wherever their words follow each other.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices as words, with the errors that they may have.
NOTICES = (
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("apache", "under the apache license", 2),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-nc", "cc by nc"),
    Notice("cc-by-nc", "creative commons attribution non commercial", 3),
    Notice("cc-by-nd", "cc by nd"),
    Notice("cc-by-sa", "cc by sa"),
    Notice("epl", "eclipse public license", 2),
    Notice("gpl", "gnu general public license", 2),
    Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", 8),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 8),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 8),
    Notice("mit", "under the mit license", 1),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
)


@dataclass(frozen=True)
class Found:
    """A notice in the joined words: from character ``begin`` to ``end``."""

    notice: Notice
    begin: int
    end: int
    errors: int


class Search:
    """The pieces of all notices in one automaton, and a pattern for each notice."""

    def __init__(self, notices: Sequence[Notice]) -> None:
        self.notices = tuple(notices)
        self.patterns = [regex.compile(rf"(?b)\b(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.errors}}}\b") for n in notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            cuts = [len(n.words) * k // (n.errors + 1) for k in range(n.errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(n.words[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the stretches of the text that hold every possible match; those that overlap are one."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text) if self.notices else ():
            for i, at in where:
                n = self.notices[i]
                begin = last + 1 - size - at - n.errors
                end = begin + len(n.words) + 2 * n.errors
                of = out.setdefault(i, [])
                # Finds of one notice come in the order of their ends, not of their windows' beginnings.
                if of and begin <= of[-1][1]:
                    of[-1] = [min(begin, of[-1][0]), max(end, of[-1][1])]
                else:
                    of.append([begin, end])
        return out

    def __call__(self, text: str) -> list[Found]:
        """Matches that don't overlap others of the same notice, by begin and notice."""
        out = []
        for i, stretches in self.windows(text).items():
            behind = 0
            for begin, end in stretches:
                at = max(begin, behind, 0)
                while (m := self.patterns[i].search(text, at, min(end, len(text)))) is not None:
                    out.append(Found(self.notices[i], m.start(), m.end(), sum(m.fuzzy_counts)))
                    at = behind = max(m.end(), at + 1)
        return sorted(out, key=lambda f: (f.begin, f.notice.words))


def places(joined: bytes, phrase: bytes) -> list[int]:
    """The numbers of the words at which the words of a phrase begin."""
    inside, wanted, out, at, n, counted = b" " + joined + b" ", b" " + phrase + b" ", [], 0, 0, 0
    while (at := inside.find(wanted, at)) >= 0:
        n += inside.count(b" ", counted, at)
        out.append(n)
        counted, at = at, at + 1
    return out


def _labels(found: set[str]) -> str:
    return ",".join(sorted(found))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Every row: key, n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``n_base`` counts the places of all phrases; ``score`` is 1 for a phrase, else the share of a notice's characters that its best match leaves
    unchanged, 0 if nothing is found.
    """
    phrases = PHRASES if phrases is None else phrases
    exact = [(p.encode(), label) for p, label in phrases.items()]
    kind = dict(docs.dtypes)[key]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                found = words(value, WORD)
                joined = b" ".join(found)
                at, base = [], set()
                for phrase, label in exact:
                    if starts := places(joined, phrase):
                        at += starts
                        base.add(label)
                fuzzy = search(joined.decode("utf-8", "surrogatepass"))
                close = max((1 - f.errors / len(f.notice.words) for f in fuzzy), default=0.0)
                rows.append((len(found), len(at), min(at, default=None), max(at, default=None), _labels(base), _labels(base | {f.notice.label for f in fuzzy}), 1.0 if base else close))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    done = rows.mapInArrow(of, f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return done.withColumnRenamed("key", key)


#: A word in the text itself, at any case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row for each fuzzy match: key, label, notice, begin and end (characters of the text), errors and the text found."""
    kind = dict(docs.dtypes)[key]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(notices)
        for pdf in batches:
            out = []
            for k, value in zip(pdf["key"], pdf["text"], strict=True):
                joined = b" ".join(words((value or "").encode("utf-8", "surrogatepass"))).decode("utf-8", "surrogatepass")
                found = search(joined)
                at = [m.span() for m in _WORD.finditer(value)] if found else []
                for f in found:
                    # A match begins and ends with a word; errors at its ends may take in a blank.
                    first, last = joined.count(" ", 0, f.begin + 1), joined.count(" ", 0, f.end - 1)
                    begin, end = at[first][0], at[last][1]
                    out.append((k, f.notice.label, f.notice.words, begin, end, f.errors, value[begin:end]))
            yield pd.DataFrame(out, columns=["key", "label", "notice", "begin", "end", "errors", "found"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    done = rows.mapInPandas(of, f"key {kind}, label string, notice string, begin long, end long, errors int, found string")
    return done.withColumnRenamed("key", key)
