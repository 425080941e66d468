"""Interpolation in time and space.

Bracketing points in time are found by windows within chunks of time, with the nearest points outside a chunk carried
in from a table of one row a chunk: a single long series is many tasks. Neighbours in space are found by equi-joins on a
grid of bins, whose ring widens only for points that need it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import nan
from gridloom.functions.distance import planar
from gridloom.functions.joins import spread
from gridloom.functions.time import micros

#: Seconds that a chunk of time covers.
CHUNK_SECONDS = 30 * 86_400


def bracket(df: DataFrame, keys: Sequence[str], at: str, points: dict[str, Column], order: Sequence[Column], chunk: float) -> DataFrame:
    """For every row and every name of ``points`` the last point before or at it and the first at or after it.

    A point is a struct that begins with its place on the numeric axis ``at``, or null. Adds columns <name>_before and
    <name>_after. ``order`` breaks ties between rows at one place.
    """
    rows = df.withColumns({"_chunk": F.floor(F.col(at) / chunk), **{f"_{n}": p for n, p in points.items()}})
    ends = rows.groupBy(*keys, "_chunk").agg(*(f(F.col(f"_{n}")).alias(f"_{n}_{e}") for n in points for e, f in (("low", F.min), ("high", F.max))))
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    carried = ends.select(
        *keys,
        "_chunk",
        *(F.last(f"_{n}_high", ignorenulls=True).over(by_chunk.rowsBetween(W.unboundedPreceding, -1)).alias(f"_{n}_left") for n in points),
        *(F.first(f"_{n}_low", ignorenulls=True).over(by_chunk.rowsBetween(1, W.unboundedFollowing)).alias(f"_{n}_right") for n in points),
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(at, *order)
    joined = rows.join(carried, [*keys, "_chunk"])
    found = {}
    for n in points:
        found[f"{n}_before"] = F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col(f"_{n}_left"))
        found[f"{n}_after"] = F.coalesce(F.first(f"_{n}", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)), F.col(f"_{n}_right"))
    return joined.withColumns(found).drop("_chunk", *(f"_{n}{e}" for n in points for e in ("", "_left", "_right")))


def between_points(before: Column, after: Column, at: Column, item: str, method: str) -> Column:
    """The value at ``at`` between two points (structs of us and items)."""
    span = (after["us"] - before["us"]).cast("double")
    share = (at - before["us"]).cast("double") / F.when(span == 0, F.lit(1.0)).otherwise(span)
    a, b = before[item], after[item]
    if method == "linear":
        inner = a + (b - a) * share
    elif method == "nearest":
        inner = F.when(share <= 0.5, a).otherwise(b)
    elif method in ("previous", "zero"):
        inner = a
    elif method == "next":
        inner = b
    else:
        raise ValueError(f"unknown method {method!r}")
    exact = F.when(before["us"] == at, a).when(after["us"] == at, b)
    return F.coalesce(exact, inner)


def interp_time(df: DataFrame, targets: DataFrame, keys: Sequence[str], items: Sequence[str], *, time: str = "time", method: str = "linear", fill_value: float = nan.NAN, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Items at the times of ``targets`` (a table with the column ``time``), for each of ``keys``.

    Times outside the range of a key's data get ``fill_value``. NaN in a bracketing point gives NaN.
    """
    source = df.select(*keys, time, micros(time).alias("_us"), F.struct(micros(time).alias("us"), *(nan.num(i).alias(i) for i in items)).alias("point"), F.lit(False).alias("_target"))
    wanted = targets.select(time).distinct()
    if keys:
        wanted = df.select(*keys).distinct().crossJoin(F.broadcast(wanted)) if wanted_is_small(wanted) else df.select(*keys).distinct().crossJoin(wanted)
    wanted = wanted.select(*keys, time, micros(time).alias("_us"), F.lit(None).cast(source.schema["point"].dataType).alias("point"), F.lit(True).alias("_target"))
    found = bracket(source.unionByName(wanted), keys, "_us", {"p": F.col("point")}, [F.col("_target")], chunk_seconds * 1e6).where("_target")
    before, after = F.col("p_before"), F.col("p_after")
    inside = (before.isNotNull() & after.isNotNull()) | (before["us"] == F.col("_us")) | (after["us"] == F.col("_us"))
    values = [F.when(inside, between_points(before, after, F.col("_us"), i, method)).otherwise(F.lit(float(fill_value))).alias(i) for i in items]
    return found.select(*keys, time, *values)


def wanted_is_small(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a table has few rows (an action that stops early)."""
    return df.limit(most + 1).count() <= most


def interp_na(df: DataFrame, keys: Sequence[str], items: Sequence[str], *, time: str = "time", extrapolate: bool = False, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """NaN becomes the linear interpolation of the valid neighbours in time; at the ends it stays, unless extrapolated."""
    rows = df.withColumn("_us", micros(time))
    points = {f"_p{n}": F.when(~F.isnan(nan.num(i)), F.struct(F.col("_us").alias("us"), nan.num(i).alias("v"))) for n, i in enumerate(items)}
    found = bracket(rows, keys, "_us", points, [], chunk_seconds * 1e6)
    columns = {}
    for n, i in enumerate(items):
        before, after = F.col(f"_p{n}_before"), F.col(f"_p{n}_after")
        value = F.when(before.isNotNull() & after.isNotNull(), between_points(before, after, F.col("_us"), "v", "linear"))
        columns[i] = F.when(~F.isnan(nan.num(i)), nan.num(i)).otherwise(nan.or_nan(value))
    done = found.withColumns(columns)
    if extrapolate:
        done = _extend(done, keys, items, time)
    return done.select(*df.columns)


def _extend(df: DataFrame, keys: Sequence[str], items: Sequence[str], time: str) -> DataFrame:
    """Continue the line through the two first and the two last valid points of each key."""
    lines = []
    for n, i in enumerate(items):
        point = F.when(~F.isnan(F.col(i)), F.struct(F.col("_us").alias("us"), F.col(i).alias("v")))
        lines += [F.slice(F.array_sort(F.collect_list(point)), 1, 2).alias(f"_first{n}"), F.slice(F.array_sort(F.collect_list(point)), -2, 2).alias(f"_last{n}")]
    # Only rows next to an end count, so two valid points on either side are enough.
    rank = lambda d, i: F.row_number().over(W.partitionBy(*keys).orderBy(F.isnan(F.col(i)), d("_us")))
    near = df.withColumns({f"_n{n}{k}": rank(d, i) for n, i in enumerate(items) for k, d in (("a", F.asc), ("b", F.desc))})
    keep = F.lit(False)
    for n in range(len(items)):
        keep = keep | (F.col(f"_n{n}a") <= 2) | (F.col(f"_n{n}b") <= 2)
    ends = near.where(keep).groupBy(*keys).agg(*lines) if keys else near.where(keep).agg(*lines)
    joined = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))  # one row
    columns = {}
    for n, i in enumerate(items):
        def line(pair: Column) -> Column:
            a, b = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
            return a["v"] + (b["v"] - a["v"]) * (F.col("_us") - a["us"]) / (b["us"] - a["us"])

        first, last = F.col(f"_first{n}"), F.col(f"_last{n}")
        enough = F.size(first) == 2
        columns[i] = F.when(F.isnan(F.col(i)) & enough, F.when(F.col("_us") < F.get(first, F.lit(0))["us"], line(first)).otherwise(line(last))).otherwise(F.col(i))
    return joined.withColumns(columns)


# neighbours in space


#: How much wider bins get from level to level, and how many of them a point looks through at most.
COARSER, MOST_BINS = 4, 64


def _bin_size(elements: DataFrame, box: Sequence[float], n: int, k: int, x: str, y: str) -> float:
    """The side of square bins that hold about ``2 k`` elements where there are any.

    Elements that fill their box get it from their number. Those of a long band or line leave most of the box empty: the bins in use are counted and
    made smaller, at most four times.
    """
    left, bottom, right, top = box
    width, height = right - left, top - bottom
    least = max(width, height, 1e-292) / 2**30  # numbers of bins are integers
    size = max(math.sqrt(width * height * 2 * k / n), max(width, height) * 2 * k / n if min(width, height) == 0 else 0.0, least)
    for _ in range(4):
        used = elements.select(F.floor((F.col(x) - left) / size).alias("_i"), F.floor((F.col(y) - bottom) / size).alias("_j")).agg(F.approx_count_distinct(F.struct("_i", "_j"))).first()[0]
        many = n / max(1, used) / (2 * k)
        if many <= 4 or size <= least:
            break
        size = max(size / math.sqrt(many), least)
    return size


def nearest(points: DataFrame, elements: DataFrame, k: int, *, point: str = "point", element: str = "element", x: str = "x", y: str = "y", box: Sequence[float] | None = None, n_elements: int | None = None) -> DataFrame:
    """The ``k`` nearest elements of every point: point, element, distance and rank (from 1); ties go to the smaller element.

    Elements lie in bins of about ``2 k``, and in coarser ones 4 times as wide from level to level. First each place gets a bound: it meets ``k`` elements of each bin around
    it (of the elements' box, if it lies outside) on all levels, a few dozen rows, and its neighbours can't be further than the k-th of these. Then it
    looks through the bins that its circle touches, on the finest level on which they are few. Points at one place are looked for once. Extent and number are
    worked out unless given.
    """
    if k < 1:
        raise ValueError("at least one neighbour")
    if box is None or n_elements is None:
        e = elements.agg(F.min(x), F.min(y), F.max(x), F.max(y), F.count("*")).first()
        box, n_elements = e[:4], e[4]
        if not n_elements:
            return points.select(point).limit(0).crossJoin(elements.select(element).limit(0)).select(point, element, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    left, bottom, right, top = map(float, box)
    size = _bin_size(elements, (left, bottom, right, top), n_elements, k, x, y)
    nx, ny = (max(1, math.ceil((high - low) / size)) for low, high in ((left, right), (bottom, top)))
    levels = [1]
    while (max(nx, ny) - 1) // levels[-1]:
        levels.append(levels[-1] * COARSER)
    on_levels = F.explode(F.array(*map(F.lit, levels)))
    along_x = lambda v: F.greatest(F.lit(0), F.least(F.lit(nx - 1), F.floor((v - left) / size))).cast("int")
    along_y = lambda v: F.greatest(F.lit(0), F.least(F.lit(ny - 1), F.floor((v - bottom) / size))).cast("int")
    up = lambda c: F.floor(F.col(c) / F.col("_c")).cast("int")

    held = elements.select(F.col(element).alias("_e"), F.col(x).alias("_ex"), F.col(y).alias("_ey"), along_x(F.col(x)).alias("_i0"), along_y(F.col(y)).alias("_j0"))
    held = held.withColumn("_c", on_levels).select("_e", "_ex", "_ey", "_c", up("_i0").alias("_i"), up("_j0").alias("_j"))
    named = points.select(F.col(point).alias("_point"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("_p"))
    asked = named.select("_p").distinct().select("_p", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    d = planar(F.col("_x"), F.col("_y"), F.col("_ex"), F.col("_ey"))

    # Spark keeps the first k of each bin in every task before anything moves.
    few = held.withColumn("_n", F.row_number().over(W.partitionBy("_c", "_i", "_j").orderBy("_e"))).where(F.col("_n") <= k).drop("_n")
    placed = asked.withColumns({"_i0": along_x(F.col("_x")), "_j0": along_y(F.col("_y"))}).withColumn("_c", on_levels)
    beside = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), up(c) - 1), F.least(F.floor(F.lit(n - 1) / F.col("_c")).cast("int"), up(c) + 1)))
    met = placed.withColumn("_i", beside("_i0", nx)).withColumn("_j", beside("_j0", ny)).join(spread(few), ["_c", "_i", "_j"]).select("_p", "_x", "_y", "_e", d.alias("_d"))
    found = F.array_sort(F.collect_set(F.struct("_d", "_e")))  # some 9 k a level at most
    bound = met.groupBy("_p", "_x", "_y").agg(found.alias("_f")).select("_p", "_x", "_y", (F.element_at("_f", F.least(F.lit(k), F.size("_f")))["_d"] * (1 + 1e-9) + 1e-300).alias("_u"))

    ends = {"_i1": along_x(F.col("_x") - F.col("_u")), "_i2": along_x(F.col("_x") + F.col("_u")), "_j1": along_y(F.col("_y") - F.col("_u")), "_j2": along_y(F.col("_y") + F.col("_u"))}
    width = lambda a, b, c: F.floor(F.col(b) / c) - F.floor(F.col(a) / c) + 1
    finest = F.coalesce(*(F.when(width("_i1", "_i2", c) * width("_j1", "_j2", c) <= MOST_BINS, F.lit(c)) for c in levels), F.lit(levels[-1]))
    circles = bound.withColumns(ends).withColumn("_c", finest)
    circles = circles.withColumn("_i", F.explode(F.sequence(up("_i1"), up("_i2")))).withColumn("_j", F.explode(F.sequence(up("_j1"), up("_j2"))))

    def off(v: str, at: str, low: float) -> Column:
        """How far a coordinate is from a bin's side, with room for rounding."""
        first = F.col(at) * F.col("_c") * size + low
        return F.greatest(F.lit(0.0), first - F.col(v), F.col(v) - (first + F.col("_c") * size)) * (1 - 1e-9)

    dx, dy = off("_x", "_i", left), off("_y", "_j", bottom)
    touched = circles.where(F.sqrt(dx * dx + dy * dy) <= F.col("_u"))
    close = touched.join(spread(held), ["_c", "_i", "_j"]).select("_p", "_e", "_u", d.alias("distance")).where(F.col("distance") <= F.col("_u"))
    ranked = close.withColumn("rank", F.row_number().over(W.partitionBy("_p").orderBy("distance", "_e"))).where(F.col("rank") <= k)
    return named.join(spread(ranked), "_p").select(F.col("_point").alias(point), F.col("_e").alias(element), "distance", "rank")


def idw_weights(neighbours: DataFrame, *, p: float = 2, radius: float | None = None, point: str = "point") -> DataFrame:
    """Adds ``weight``: inverse distances to the power p, summing to 1; a point closer than 1e-8 has all the weight.

    Neighbours beyond ``radius`` have the weight NaN, which makes the point's value NaN.
    """
    w = W.partitionBy(point)
    exact = F.min("distance").over(w) < 1e-8
    inverse = F.pow(F.greatest(F.col("distance"), F.lit(1e-300)), F.lit(-float(p)))
    weighted = neighbours.withColumn("_exact", exact).withColumn("_inverse", inverse)
    weight = F.when(F.col("_exact"), (F.col("rank") == 1).cast("double")).otherwise(F.col("_inverse") / F.sum("_inverse").over(w))
    if radius is not None:
        weight = F.when(F.col("distance") > radius, F.lit(nan.NAN)).otherwise(weight)
    return weighted.withColumn("weight", weight).drop("_exact", "_inverse")


def apply_weights(df: DataFrame, weights: DataFrame, items: Sequence[str], *, keys: Sequence[str] = ("time",), element: str = "element", point: str = "point") -> DataFrame:
    """Values at points: the weighted sum over the elements of a weights table (point, element, weight)."""
    joined = df.join(spread(weights.select(point, element, "weight")), element)
    return joined.groupBy(*keys, point).agg(*(F.sum(nan.num(i) * F.col("weight")).alias(i) for i in items))


def interp_grid(df: DataFrame, points: DataFrame, grid, items: Sequence[str], *, keys: Sequence[str] = ("time",), point: str = "point") -> DataFrame:
    """Bilinear values at points; points outside the outermost centres get no row."""
    corners = points.select(point, F.explode(grid.bilinear(F.col("x"), F.col("y"))).alias("c")).select(point, "c.*")
    joined = df.join(corners, ["x_idx", "y_idx"])
    return joined.groupBy(*keys, point).agg(*(F.sum(nan.num(i) * F.col("weight")).alias(i) for i in items))


def interp_line(df: DataFrame, points: DataFrame, grid, items: Sequence[str], *, keys: Sequence[str] = ("time",), point: str = "point") -> DataFrame:
    """Values at points between the two nearest centres of a line; NaN outside the outermost ones. ``points`` has point and the line's coordinate."""
    ends = points.select(point, F.explode(grid.linear(F.col(grid.name))).alias("c")).select(point, "c.*")
    joined = df.join(ends, f"{grid.name}_idx")
    return joined.groupBy(*keys, point).agg(*(F.sum(nan.num(i) * F.col("weight")).alias(i) for i in items))


def extract_track(df: DataFrame, track: DataFrame, elements: DataFrame, items: Sequence[str], *, method: str = "nearest", step_seconds: float, time: str = "time", p: float = 2, wrap: bool = False) -> DataFrame:
    """Values along a moving point: ``track`` has time, x and y; ``df`` time, element and items; times ``step_seconds`` apart or less.

    Between two steps values are interpolated in time, in space by the nearest element or the inverse distances of five.
    Every track row comes back; outside the time range, or between steps further apart, its items are NaN.
    """
    from gridloom.functions.distance import wrap_longitude

    if method not in ("nearest", "inverse_distance"):
        raise ValueError(f"unknown method {method!r}")
    rows = track.withColumn("_us", micros(time)).withColumn("_id", F.struct("_us", "x", "y"))
    if wrap:
        rows = rows.withColumn("x", wrap_longitude(F.col("x")))
    asked = rows.select(F.col("_id").alias("point"), F.struct("x", "y").alias("_at"), "x", "y", "_us").distinct()
    # Neighbours are looked for once a place, however often the track is there.
    places = asked.select(F.col("_at").alias("point"), "x", "y").distinct()
    weights = idw_weights(nearest(places, elements, 1 if method == "nearest" else 5), p=p).select(F.col("point").alias("_at"), "element", "weight")
    step = round(step_seconds * 1e6)
    values = df.select(micros(time).alias("_t"), "element", *items).withColumn("_b", F.floor(F.col("_t") / (2 * step)))
    # Steps within one of a time lie in one or two stretches of two steps.
    stretches = F.array_distinct(F.array(*(F.floor((F.col("_us") + d * step) / (2 * step)) for d in (-1, 1))))
    near = asked.select("point", "_at", "_us").join(weights, "_at").withColumn("_b", F.explode(stretches))
    hits = near.join(values, ["element", "_b"]).where(F.abs(F.col("_t") - F.col("_us")) <= step)
    frames = hits.groupBy("point", "_us", "_t").agg(*(F.sum(nan.num(i) * F.col("weight")).alias(i) for i in items))
    value = F.struct(F.col("_t").alias("us"), *items)
    ends = frames.groupBy("point", "_us").agg(F.max(F.when(F.col("_t") <= F.col("_us"), value)).alias("before"), F.min(F.when(F.col("_t") >= F.col("_us"), value)).alias("after"))
    done = ends.select("point", *(between_points(F.col("before"), F.col("after"), F.col("_us"), i, "linear").alias(i) for i in items))
    return rows.join(done, rows["_id"] == done["point"], "left").select(*(rows[c] for c in track.columns), *(nan.or_nan(done[i]).alias(i) for i in items))
