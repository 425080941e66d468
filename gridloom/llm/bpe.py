"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves, the halves into halves, and so on. The pieces of a very long text are rows that
are encoded in parallel by whichever tasks get them; those of others are encoded by the task that reads the text,
as it costs more to move them than to encode them. Then neighbours are joined bottom-up: a window of tokens around
each join is encoded again and grown until it agrees with both sides on tokens away from the cuts; from there on
each side is taken as it is. Two adjacent tokens of a valid encoding stay valid whatever surrounds them, so the
agreement of whole tokens makes the joined ids equal to those of the whole text. A window that has grown
over both sides is the encoding of the whole. Spans of characters are worked out next to the cuts, and for all
tokens of a piece only when a window grows beyond that.

Null text counts as empty. A row per input row comes back, repeated rows included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import parallelism, slices, text_batches
from gridloom.llm.tokenization import FieldEncoder, field_encoder

#: Longer texts are cut; with 4096 characters that is a fifth of the documents of web text, which hold three fifths of it.
LEAF_CHARS = 4096
#: The pieces of longer texts are dealt out to tasks. One of this length takes about 50 ms to encode.
DEALT_CHARS = 65_536
#: Fields next to each cut whose spans are worked out at first.
EDGE_FIELDS = 32
WINDOW_TOKENS = 24
#: Characters next to a cut in which a pre-token may still change.
MARGIN = 4
_FIELD = re.compile("[^ \t\n\r]+")


@dataclass
class Encoded:
    """A piece of text with its ids and the spans of characters of the first ``head`` and the last ``tail`` of them."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    head: int
    tail: int


def _all_known(text: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Encoded:
    return Encoded(text, ids, starts, ends, len(ids), len(ids))


def _pack_spans(x: Encoded) -> bytes:
    """The known spans of a piece as bytes: the counts, then head and tail."""
    n = len(x.ids)
    tail = min(x.tail, n - x.head)
    parts = [[x.head, tail], x.starts[: x.head], x.ends[: x.head], x.starts[n - tail :], x.ends[n - tail :]]
    return np.concatenate(parts).astype("<i4").tobytes()


def _unpack_spans(text: str, ids: np.ndarray, spans: bytes) -> Encoded:
    head, tail, *_ = values = np.frombuffer(spans, dtype="<i4")
    n, at = len(ids), np.cumsum([2, head, head, tail])
    starts, ends = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    starts[:head], ends[:head] = values[at[0] : at[1]], values[at[1] : at[2]]
    starts[n - tail :], ends[n - tail :] = values[at[2] : at[3]], values[at[3] :]
    return Encoded(text, ids, starts, ends, int(head), n if head == n else int(tail))


class PieceEncoder:
    """Encodes pieces with spans and joins neighbours exactly."""

    def __init__(self, encoder: FieldEncoder) -> None:
        self.encoder, self.tokenizer = encoder, encoder.tokenizer
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "</w>"
        self.ends_word = np.array([w.endswith(suffix) for w in encoder.words], dtype=bool)

    def leaf(self, text: str) -> Encoded:
        """Ids of a piece, with spans next to its ends at least."""
        if len(text) < 16 * EDGE_FIELDS or not self.encoder.by_fields(text):
            return self.encode(text)
        rest = text.rsplit(None, EDGE_FIELDS)
        begin = len(rest[0]) if len(rest) > EDGE_FIELDS else 0
        front = [f.end() for f in islice(_FIELD.finditer(text), EDGE_FIELDS)]
        if not front or front[-1] >= begin:
            return self.encode(text)
        head, tail = self._fields(text[: front[-1]]), self._fields(text[begin:])
        ids = np.frombuffer(self.encoder.encode(text), dtype="<u4")
        h, t = len(head.ids), len(tail.ids)
        starts, ends = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids), dtype=np.int32)
        starts[:h], ends[:h] = head.starts, head.ends
        starts[len(ids) - t :], ends[len(ids) - t :] = tail.starts + begin, tail.ends + begin
        return Encoded(text, ids, starts, ends, h, t)

    def encode(self, text: str) -> Encoded:
        """The same with all spans."""
        if self.encoder.by_fields(text):
            return self._fields(text)
        found = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, dtype=np.int32).reshape(-1, 2)
        return _all_known(text, np.array(found.ids, dtype=np.uint32), spans[:, 0], spans[:, 1])

    def _fields(self, text: str) -> Encoded:
        """The same from cached encodings of the fields between white space."""
        begins, found = [], []
        for field in _FIELD.finditer(text):
            begins.append(field.start())
            found.append(self.encoder.spans[field.group()])
        if not found:
            return _all_known(text, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))
        joined = np.concatenate(found, axis=1)
        shift = np.repeat(np.array(begins, dtype=np.int32), [x.shape[1] for x in found])
        return _all_known(text, joined[0].astype(np.uint32), joined[1] + shift, joined[2] + shift)

    def _safe_start(self, x: Encoded, i: int) -> bool:
        """Whether encoding from token i on scans the text as encoding from the start does."""
        s = int(x.starts[i])
        if x.ends[i - 1] > s:
            return False
        return bool(self.ends_word[x.ids[i - 1]]) or x.ends[i - 1] < s or (s >= 3 and x.text[s - 3 : s + 1].isalpha())

    def _safe_pair(self, x: Encoded, k: int) -> bool:
        """Whether tokens k and k + 1 fix how the text after them is scanned."""
        return bool(self.ends_word[x.ids[k]]) or x.text[int(x.starts[k]) : int(x.ends[k + 1])].isalpha()

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        if not left.text or not right.text:
            return right if not left.text else left
        shift, n = len(left.text), WINDOW_TOKENS
        while True:
            # A window starts behind a token whose span is known, and ends with one.
            if n + 1 > left.tail and left.tail < len(left.ids):
                left = self.encode(left.text)
            if n > right.head and right.head < len(right.ids):
                right = self.encode(right.text)
            i = max(0, len(left.ids) - n)
            while i > 0 and not self._safe_start(left, i):
                i -= 1
                if len(left.ids) - i >= left.tail and left.tail < len(left.ids):
                    left = self.encode(left.text)
            lo = int(left.starts[i]) if i else 0
            j = min(len(right.ids), n)
            hi = int(right.ends[j - 1]) if j < len(right.ids) else len(right.text)
            window = self.encode(left.text[lo:] + right.text[:hi])
            starts, ends = window.starts + lo, window.ends + lo
            agrees = i == 0 or (
                len(window.ids) > 1 and i + 2 <= len(left.ids) and int(left.ends[i + 1]) <= shift - MARGIN and np.array_equal(window.ids[:2], left.ids[i : i + 2]) and np.array_equal(starts[:2], left.starts[i : i + 2]) and np.array_equal(ends[:2], left.ends[i : i + 2])
            )
            if agrees:
                cut = self._right_agreement(window, starts - shift, ends - shift, right, j, hi)
                if cut is None and j == len(right.ids):
                    cut = (len(window.ids), len(right.ids))
                if cut is not None:
                    b, k = cut
                    rest, before = len(right.ids) - k, len(left.ids) - i
                    return Encoded(
                        left.text + right.text,
                        np.concatenate([left.ids[:i], window.ids[:b], right.ids[k:]]),
                        np.concatenate([left.starts[:i], starts[:b], right.starts[k:] + shift]),
                        np.concatenate([left.ends[:i], ends[:b], right.ends[k:] + shift]),
                        left.head if left.head < i else i + b + max(0, right.head - k),
                        right.tail if right.tail < rest else rest + b + max(0, left.tail - before),
                    )
            n *= 4

    def _right_agreement(self, window: Encoded, starts: np.ndarray, ends: np.ndarray, right: Encoded, j: int, hi: int) -> tuple[int, int] | None:
        """The latest place from which the window and the right side agree on two tokens away from both cuts."""
        at = {int(s): k for k, s in enumerate(right.starts[: max(0, j - 1)])}
        for b in range(len(window.ids) - 2, -1, -1):
            if starts[b] < MARGIN:
                return None
            k = at.get(int(starts[b]))
            if k is None or ends[b + 1] > hi - MARGIN:
                continue
            same = window.ids[b] == right.ids[k] and window.ids[b + 1] == right.ids[k + 1] and ends[b] == right.ends[k] and starts[b + 1] == right.starts[k + 1] and ends[b + 1] == right.ends[k + 1]
            if same and (k == 0 or right.ends[k - 1] <= right.starts[k]) and self._safe_pair(right, k):
                return b, k
        return None

    def by_tree(self, text: str, leaf_chars: int) -> Encoded:
        """Cut a text into leaves, encode and join them."""
        size = math.ceil(len(text) / _n_pieces(len(text), leaf_chars)) or 1
        return self.tree([self.leaf(text[i : i + size]) for i in range(0, max(1, len(text)), size)])

    def tree(self, pieces: list[Encoded]) -> Encoded:
        """Join neighbours level by level until one is left."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0]


def encode_by_tree(text: str, path: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
    """The same on one machine, for tests and small texts."""
    return PieceEncoder(field_encoder(path)).by_tree(text, leaf_chars).ids


def _n_pieces(chars: int, leaf_chars: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, chars) / leaf_chars)))


def encode(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS, dealt_chars: int = DEALT_CHARS, decoded: bool = False
) -> DataFrame:
    """Encode every whole text: columns ``key`` and ``ids`` (little-endian unsigned 32-bit integers).

    With ``decoded`` a column of that name holds what the ids decode to, worked out by the same worker.

    Texts of at most ``leaf_chars`` characters are one leaf, longer ones are cut into leaves that are joined again.
    Up to ``dealt_chars`` characters this happens where a text is read, without a shuffle; the leaves of longer texts
    are dealt out and meet again by row, never more than one row's text.
    """
    text_batches(docs.sparkSession)
    dealt_chars = max(leaf_chars, dealt_chars)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def finished(encoder: FieldEncoder, keys: list, ids: list[bytes]) -> pd.DataFrame:
        out = pd.DataFrame({"key": pd.Series(keys, dtype=object), "ids": ids})
        return out.assign(decoded=[encoder.decode(i) for i in ids]) if decoded else out

    def as_bytes(encoder: PieceEncoder, text: str) -> bytes:
        return encoder.encoder.encode(text) if len(text) <= leaf_chars else encoder.by_tree(text, leaf_chars).ids.astype("<u4").tobytes()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(field_encoder(path))
        for pdf in slices(batches):
            yield finished(encoder.encoder, pdf["key"].tolist(), [as_bytes(encoder, t) for t in pdf["text"]])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(field_encoder(path))
        for pdf in slices(batches, 64):
            done = [encoder.leaf(t) for t in pdf["text"]]
            yield pdf.assign(ids=[x.ids.astype("<u4").tobytes() for x in done], spans=[_pack_spans(x) for x in done])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder = PieceEncoder(field_encoder(path))
        copies = int((pdf["piece"] == 0).sum())
        one = pdf.drop_duplicates("piece").sort_values("piece")
        pieces = [_unpack_spans(t, np.frombuffer(ids, dtype="<u4"), spans) for t, ids, spans in zip(one["text"], one["ids"], one["spans"], strict=True)]
        ids = encoder.tree(pieces).ids.astype("<u4").tobytes()
        return finished(encoder.encoder, [pdf["key"].iloc[0]] * copies, [ids] * copies)

    schema = f"key {kind}, ids binary" + ", decoded string" * decoded
    short = rows.where(F.length("text") <= dealt_chars).mapInPandas(whole, schema)
    n = F.pow(F.lit(2), F.ceil(F.log2(F.length("text") / F.lit(leaf_chars)))).cast("int")
    size = F.ceil(F.length("text") / n).cast("int")
    pieces = (
        rows.where(F.length("text") > dealt_chars)
        .select("key", F.sha2("text", 256).alias("digest"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * size + 1, size))).alias("piece", "text"))
        .repartition(parallelism(docs.sparkSession), "digest", "piece")
        .mapInPandas(leaves, f"key {kind}, digest string, piece int, text string, ids binary, spans binary")
    )
    long = pieces.groupBy("key", "digest").applyInPandas(joined, schema)
    return short.unionByName(long).withColumnRenamed("key", key)


def decode(ids: Column | str, path: str) -> Column:
    """Decode a column of ids made by :func:`encode`; special tokens stay in the text."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        encoder = field_encoder(path)
        return column.map(encoder.decode, na_action="ignore")

    return text(ids)
