"""Packed token output: best-fit-decreasing packing with a segment tree, written as id matrices.

Texts are encoded where they are read, an end token is added, and what is longer than a row of the matrix is cut
without loss. Each task packs its own pieces in groups of bounded size, longest first, into the row whose free
space is smallest but sufficient; a segment tree over the capacities finds it. So nothing is shuffled, and a lost task
is repeated alone. Rows are written as Parquet: ids (a matrix row, padded), cumulative segment lengths, and
positions that start anew at each segment.

Null text counts as empty (the end token alone). Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import new_path
from gridloom.llm.packing import tokenized_pieces

CAPACITY, GROUP_PIECES = 1024, 8192
ROW_SCHEMA = "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, pieces array<int>, starts array<long>"


class CapacityTree:
    """Rows by their free space: finds the smallest free space that is at least as large as asked for."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, free: int, by: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest free space of at least ``least`` and that space; None if there is none."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Rows of piece numbers in the order in which they stand in the row."""
    tree, rows = CapacityTree(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[piece]
        if not 1 <= length <= capacity:
            raise ValueError(f"piece lengths must be between 1 and {capacity}")
        found = tree.take(length)
        if found is None:
            rows.append([piece])
            row, free = len(rows) - 1, capacity
        else:
            row, free = found
            rows[row].append(piece)
        tree.put(row, free - length)
    return rows


def packed_rows(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 2, pad_id: int = 0, id_type: str = "uint16", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each row of the id matrix: the columns of ROW_SCHEMA, and ``keys`` with the key of each segment."""
    pieces = tokenized_pieces(docs, path, capacity=capacity, end_id=end_id, key=key, text=text)
    kind = dict(docs.dtypes)[key]
    most = np.iinfo(id_type).max

    def pack(group: list[tuple], first: int) -> pd.DataFrame:
        out = []
        for n, row in enumerate(best_fit_decreasing([p[3] for p in group], capacity)):
            parts = [np.frombuffer(group[i][4], dtype="<u4") for i in row]
            ids = np.full(capacity, pad_id, dtype="<u4")
            positions = np.zeros(capacity, dtype="<u2" if capacity <= 1 << 16 else "<u4")
            bounds = np.cumsum([0, *map(len, parts)])
            ids[: bounds[-1]] = np.concatenate(parts)
            positions[: bounds[-1]] = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
            if ids.max() > most:
                raise ValueError(f"an id doesn't fit {id_type}")
            out.append((first + n, int(bounds[-1]), ids.astype(np.dtype(id_type).newbyteorder("<")).tobytes(), positions.tobytes(), bounds.tolist(), [group[i][1] for i in row], [group[i][2] for i in row], [group[i][0] for i in row]))
        return pd.DataFrame(out, columns=["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "pieces", "starts", "keys"])

    def pack_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, first = [], TaskContext.get().partitionId() << 32
        for pdf in batches:
            for piece in zip(pdf[key], pdf["piece"], pdf["start"], pdf["length"], pdf["ids"], strict=True):
                group.append((None if pd.isna(piece[0]) else piece[0], *piece[1:]))
                if len(group) == group_pieces:
                    done, group = pack(group, first), []
                    first += len(done)
                    for i in range(0, len(done), 500):
                        yield done.iloc[i : i + 500]
        if group:
            done = pack(group, first)
            for i in range(0, len(done), 500):
                yield done.iloc[i : i + 500]

    safe = pieces.withColumn(key, F.col(key).cast("string"))
    return safe.mapInPandas(pack_all, f"{ROW_SCHEMA}, keys array<string>").withColumn("keys", F.col("keys").cast(f"array<{kind}>"))


def write_packed(docs: DataFrame, path: str, *, name: str = "packed", to: str | None = None, **options) -> str:
    """Write :func:`packed_rows` as Parquet (to a new path of the shared folder, unless ``to`` says where) and return the path."""
    to = to or new_path(docs.sparkSession, name)
    packed_rows(docs, path, **options).write.option("compression", "zstd").parquet(to)
    return to


def segments(spark: SparkSession, path: str, *, key: str = "doc_id", id_type: str = "uint16") -> DataFrame:
    """Read packed output back: one row for each segment, with its ids, its place and the positions at its ends."""
    rows = spark.read.parquet(path)
    kind = dict(rows.dtypes)["keys"].removeprefix("array<").removesuffix(">")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sequence, ids, positions, bounds, pieces, starts, keys in zip(pdf["sequence_id"], pdf["ids"], pdf["positions"], pdf["cu_seqlens"], pdf["pieces"], pdf["starts"], pdf["keys"], strict=True):
                row = np.frombuffer(ids, dtype=np.dtype(id_type).newbyteorder("<")).astype("<u4")
                place = np.frombuffer(positions, dtype="<u2" if len(positions) == 2 * len(row) else "<u4")
                for k, p, s, a, b in zip(keys, pieces, starts, bounds, bounds[1:], strict=False):
                    restarts = bool((place[a:b] == np.arange(b - a)).all())
                    out.append((None if k is None else str(k), p, s, b - a, zlib.crc32(row[a:b].tobytes()), sequence, a, restarts))
            yield pd.DataFrame(out, columns=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "restarts"])

    found = rows.withColumn("keys", F.col("keys").cast("array<string>")).mapInPandas(cut, "key string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, restarts boolean")
    return found.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
