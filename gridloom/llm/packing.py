"""Best-fit packing of documents into fixed-length sequences by linear grouping.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` counts, whatever the input.
On it the plan is made. Lengths above ``small`` are sorted and cut into groups of equal cardinality, each
length is rounded up to the largest of its group, and column generation finds which configurations of the few sizes that are left meet
all demand with the fewest sequences. Then actual documents take the places of the rounded ones; the last place of a sequence goes to the
longest that fits, which takes up what rounding left free. As that changes what is left, the fuller half of the configurations is filled at a time and
the rest is grouped anew. What still is free is given to the small lengths by best fit. Plans with several bounds of what is small are made
and the one with the fewest sequences is taken. A plan
consists of runs of equal sequences, so it is as small as the histogram. Spark ranks the pieces of
each length and every piece looks its place up.

Null text counts as empty (the end token alone). Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, fresh, slices, text_batches
from gridloom.llm.tokenization import byte_level_encoder

CAPACITY = 1024
#: Groups that lengths are rounded in.
GROUPS = 48
#: Plans that are made: lengths up to this part of the capacity are small, and large ones are grouped at most so often (None: until none is left). With half
#: the capacity every large length has a sequence of its own, which is what rounding up can lose against where lengths are spread evenly.
TRIALS = ((2, None), (16, None), (16, 1), (4, None))


def tokenized_pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and cut what is longer than ``capacity``.

    The first piece takes the remainder, the others are full. Columns: ``key``, piece, start, length and
    ids (little-endian unsigned 32-bit integers). No shuffle.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_level_encoder(path)
        for pdf in slices(batches):
            out = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                ids = encoder.encode(t) + end
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                bounds = [0, *range(first, total + 1, capacity)]
                out += [(k, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            yield pd.DataFrame(out, columns=["key", "piece", "start", "length", "ids"])

    return rows.mapInPandas(cut, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


def equal_groups(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count) runs in descending order into at most ``groups`` groups of equal cardinality; with no more lengths than groups, one a length."""
    if len(counts) <= groups:
        return [[x] for x in counts]
    total = sum(n for _, n in counts)
    size = max(1, -(-total // groups))
    out, room = [[]], size
    for length, n in counts:
        while n:
            if not room:
                out.append([])
                room = size
            k = min(n, room)
            out[-1].append((length, k))
            n, room = n - k, room - k
    return out if counts else []


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: np.ndarray) -> tuple[np.ndarray, float]:
    """How many of each size are worth most within ``capacity``, at most ``most`` of each (knapsack over all sums)."""
    best = np.zeros(capacity + 1)
    taken = []
    for size, w, n in zip(sizes.tolist(), worth.tolist(), most.tolist(), strict=True):
        counts = np.zeros(capacity + 1, dtype=np.int64)
        if w > 1e-9:
            base = best
            for k in range(1, min(n, capacity // size) + 1):
                better = base[: capacity + 1 - k * size] + k * w > best[k * size :] + 1e-12
                if not better.any():
                    break
                best = best.copy()
                at = np.flatnonzero(better) + k * size
                best[at], counts[at] = base[at - k * size] + k * w, k
        taken.append(counts)
    out, room = np.zeros(len(sizes), dtype=np.int64), int(best.argmax())
    value = float(best[room])
    for s in range(len(sizes) - 1, -1, -1):
        out[s] = taken[s][room]
        room -= int(out[s] * sizes[s])
    return out, value


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Configurations of sizes and how often each is used, so that all demand is met with few sequences.

    The linear programme over all configurations is solved by column generation: a simplex basis of one configuration a
    size, to which the most valuable one at the current prices of the sizes is brought in until none helps. Its whole
    parts are taken, and what demand is left is solved anew; a demand too small for whole parts takes the configuration of
    the largest size still wanted that is worth most.
    """
    demand, out = demand.astype(np.int64).copy(), []
    while demand.any():
        used = np.flatnonzero(demand)
        some, want = sizes[used], demand[used]
        basis = np.diag(np.minimum(capacity // some, want)).astype(float)
        inverse = np.linalg.inv(basis)
        for turn in range(rounds):
            prices = inverse.sum(axis=0)
            column, value = _best_column(some, prices, capacity, want)
            if value <= 1 + 1e-3:
                break
            step, level = inverse @ column, inverse @ want
            ratio = np.full(len(some), np.inf)
            np.divide(level, step, out=ratio, where=step > 1e-9)
            out_row = int(ratio.argmin())
            basis[:, out_row] = column
            pivot = inverse[out_row] / step[out_row]
            inverse = inverse - np.outer(step, pivot)
            inverse[out_row] = pivot
            if turn % 50 == 49:  # rounding errors don't pile up
                inverse = np.linalg.inv(basis)
        times = np.floor(np.maximum(inverse @ want, 0) + 1e-6).astype(np.int64)
        order = np.argsort(-(some @ basis))
        taken = False
        for i in order[times[order] > 0]:
            column = np.rint(basis[:, i]).astype(np.int64)
            n = int(min(times[i], (demand[used][column > 0] // column[column > 0]).min()))
            if n:
                whole = np.zeros(len(sizes), dtype=np.int64)
                whole[used] = column
                demand -= n * whole
                out.append((whole, n))
                taken = True
        if not taken:
            first = used[int(some.argmax())]
            rest = demand.copy()
            rest[first] -= 1
            column, _ = _best_column(sizes, sizes * (rest > 0) / capacity, capacity - int(sizes[first]), rest)
            column[first] += 1
            n = int((demand[column > 0] // column[column > 0]).min())
            demand -= n * column
            out.append((column, n))
    return out


def plan(histogram: dict[int, int], *, capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """The plan of the fewest sequences among those of :data:`TRIALS`; one that no plan can beat ends the search."""
    best, fewest = np.zeros((0, 5), dtype=np.int64), None
    for share, rounds in TRIALS:
        places, sequences = grouped_plan(histogram, capacity=capacity, groups=groups, small=capacity // share, rounds=rounds)
        if fewest is None or sequences < fewest:
            best, fewest = places, sequences
        if fewest <= -(-sum(x * n for x, n in histogram.items()) // capacity):
            break
    return best


def grouped_plan(histogram: dict[int, int], *, capacity: int = CAPACITY, groups: int = GROUPS, small: int = CAPACITY // 16, rounds: int | None = None) -> tuple[np.ndarray, int]:
    """Places for ranks: rows (length, first rank, number of ranks, first sequence, offset), one for each run; and how many sequences there are.

    The rank r of a run belongs in sequence ``first sequence + r - first rank``. After ``rounds`` groupings the large lengths that are left go to the best fit as well.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n if length > small else 0
    ranks = dict.fromkeys(histogram, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[list[int]]] = {}
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, ranks[length], n, sequence, offset))
        ranks[length] += n

    def substitute(alike: list[list[int]], limit: int | None) -> tuple[list[list[int]], list[list[int]]]:
        """Give each sequence the longest piece left within ``limit``, or within its room; those that got one and those that didn't."""
        given, full = [], []
        for first, n, filled in alike:
            while n:
                fits = np.flatnonzero(left[: (capacity - filled if limit is None else limit) + 1])
                if not len(fits):
                    full.append([first, n, filled])
                    break
                length = int(fits[-1])
                k = int(min(n, left[length]))
                left[length] -= k
                place(length, k, first, filled)
                given.append([first, k, filled + length])
                first, n = first + k, n - k
        return given, full

    turns = 0
    while left.any() and (rounds is None or turns < rounds):
        turns += 1
        grouped = equal_groups([(int(x), int(left[x])) for x in np.flatnonzero(left)[::-1]], groups)
        sizes = np.array([g[0][0] for g in grouped], dtype=np.int64)
        demand = np.array([sum(n for _, n in g) for g in grouped], dtype=np.int64)
        chosen = sorted(configurations(sizes, demand, capacity), key=lambda c: -int(c[0] @ sizes))
        # The fuller half of the sequences is made, then the rest is grouped anew, for shorter pieces than planned are left.
        planned, made = sum(times for _, times in chosen), 0
        for column, times in chosen:
            times = min(times, max(1, (planned + 1) // 2 - made)) if planned > 16 else times
            alike = [[sequences, times, 0]]
            slots = [int(x) for x in np.repeat(sizes, column)]
            for size in slots[:-1]:
                alike = [x for some in substitute(alike, size) for x in some]
            while alike:  # the last place goes to the longest piece that fits, and so does any room after it
                alike, full = substitute(alike, None)
                for first, n, filled in full:
                    if filled:
                        free.setdefault(capacity - filled, []).append([first, n])
            sequences += times
            made += times
            if not left.any() or planned > 16 and made >= planned // 2:
                break
    for length in sorted(histogram, reverse=True):
        n = histogram[length] if length <= small else int(left[length])
        while n:
            fits = [f for f in free if f >= length and free[f]]
            if fits:
                room = min(fits)
                first, there = free[room].pop()
                k = min(n, there)
                if there > k:
                    free[room].append([first + k, there - k])
            else:
                room, first, k = capacity, sequences, -(-n // (capacity // length))
                sequences += k
            place(length, k, first, capacity - room)
            free.setdefault(room - length, []).append([first, k])
            n -= k
    return np.array(rows, dtype=np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice, so it should be a stored table. Ranks within a length are dealt over buckets
    of a hash, so that a length which a third of all pieces have is spread over many tasks.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"piece lengths must be between 1 and {capacity}")
    places = plan(histogram, capacity=capacity, groups=groups)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    buckets = blocks(sum(histogram.values()), 200_000, 64)
    bucket, n, ahead, row, rank = (fresh(c, pieces.columns) for c in ("bucket", "n", "before", "row", "rank"))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", bucket).agg(F.count("*").alias(n))
    before = counts.select("length", bucket, (F.sum(n).over(W.partitionBy("length").orderBy(bucket)) - F.col(n)).alias(ahead))
    inner = W.partitionBy("length", bucket).orderBy(*order)
    ranked = dealt.withColumn(row, F.row_number().over(inner)).join(before, ["length", bucket])
    ranked = ranked.select(*pieces.columns, (F.col(ahead) + F.col(row) - 1).alias(rank))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = int(places[:, 1].max(initial=0)) + 1
        keys = places[:, 0] * width + places[:, 1]
        for pdf in batches:
            ranks = pdf[rank].to_numpy()
            at = np.searchsorted(keys, pdf["length"].to_numpy() * width + np.minimum(ranks, width - 1), side="right") - 1
            yield pdf.drop(columns=rank).assign(sequence_id=places[at, 3] + ranks - places[at, 1], offset=places[at, 4])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInPandas(look_up, schema)
