"""Words of whole texts, as bytes of UTF-8, and their counts within tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

from gridloom.llm.common import TEXT_ROWS

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}


def _table(kept: set[int]) -> bytes:
    """Bytes that aren't kept become blanks, A-Z become a-z."""
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in kept else 0x20 for b in range(256))


#: Runs of letters, digits and anything beyond ASCII are words; runs of letters and anything beyond ASCII are terms.
WORD, TERM = _table(_LETTERS | {*range(0x30, 0x3A)}), _table(_LETTERS)


def words(text: bytes | None, table: bytes = WORD) -> list[bytes]:
    return text.translate(table).split() if text else []


def ngrams(found: Sequence[bytes], low: int, high: int) -> list[bytes]:
    """All runs of ``low`` to ``high`` consecutive words, each joined by one blank."""
    if (low, high) == (1, 1):
        return list(found)
    return [b" ".join(found[i : i + n]) for n in range(low, high + 1) for i in range(len(found) - n + 1)]


def strings(values: Sequence[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


class Tally:
    """Counts by key that a task adds up; they are handed on whenever there are many, so a task's memory is bounded."""

    def __init__(self, kinds: int, most: int = 400_000) -> None:
        self.counts: list[dict] = [{} for _ in range(kinds)]
        self.most, self.kinds = most, kinds

    def add(self, kind: int, group: tuple, values: Sequence[bytes] | set[bytes]) -> None:
        self.counts[kind].setdefault(group, Counter()).update(values)

    def full(self) -> bool:
        return sum(map(len, self.counts[0].values())) > self.most

    def take(self) -> Iterator[tuple[tuple, list[bytes], list[list[int]]]]:
        """A group, its strings and their counts of each kind."""
        first = self.counts[0]
        for group, counter in first.items():
            names = list(counter)
            yield group, names, [[c.get(group, {}).get(n, 0) for n in names] for c in self.counts]
        self.counts = [{} for _ in range(self.kinds)]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While whole texts go to Python workers, Arrow batches have at most ``TEXT_ROWS`` rows; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)
