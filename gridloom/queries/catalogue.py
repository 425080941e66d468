"""All queries on the tables, each with its SQL. Times come out as microseconds, NaN as -9999, doubles rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.frame import Frame
from gridloom.functions import distance, nan
from gridloom.functions import time as times
from gridloom.functions.time import micros
from gridloom.geometry.grid import Axis, Grid2D
from gridloom.operators import aggregate, combine, interpolate, layered, mesh, select, spectral
from gridloom.plans import pipeline
from gridloom.queries import datasets as ds
from gridloom.queries.datasets import out, sql_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def T() -> Column:
    return micros("time").alias("time")


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# selection


@query("SELECT epoch_us(ts) AS time, event_id, value FROM events")
def read_items(spark, sf):
    return ds.table(spark, sf, "events").select(micros("ts").alias("time"), "event_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem")
def wildcard_items(spark, sf):
    li = ds.table(spark, sf, "lineitem")
    return pipeline.select_items(li, ["l_orderkey", "l_linenumber"], ["*price", "l_disc*"])


@query("SELECT epoch_us(o_orderdate) AS time, o_orderkey FROM orders WHERE o_orderdate >= '1996-03-01' AND o_orderdate < '1996-04-01'")
def sel_time_partial(spark, sf):
    return select.at_time(ds.table(spark, sf, "orders"), "1996-03", "o_orderdate").select(micros("o_orderdate").alias("time"), "o_orderkey")


@query("SELECT epoch_us(o_orderdate) AS time, o_orderkey FROM orders WHERE o_orderdate >= '1996-03-05' AND o_orderdate < '1997-01-01'")
def sel_time_slice(spark, sf):
    return select.time_slice(ds.table(spark, sf, "orders"), "1996-03-05", "1996", "o_orderdate").select(micros("o_orderdate").alias("time"), "o_orderkey")


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('quantity')} AS quantity FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS step FROM {ds.GRID1}) WHERE step >= 2 AND step < 60 AND (step - 2) % 5 = 0")
def isel_time_every_nth(spark, sf):
    return select.steps_at(ds.grid1(spark, sf), slice(2, 60, 5)).select(T(), "x_idx", out("quantity").alias("quantity"))


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('discount')} AS discount FROM (SELECT *, dense_rank() OVER (ORDER BY time DESC) AS back FROM {ds.GRID1}) WHERE back IN (1, 3)")
def isel_negative(spark, sf):
    return select.steps_at(ds.grid1(spark, sf), [-1, -3]).select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('discount')} AS discount FROM {ds.GRID1} WHERE time = (SELECT max(date_trunc('month', l_shipdate)) FROM lineitem)")
def isel_last(spark, sf):
    return select.last_step(ds.grid1(spark, sf)).select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT element, {sql_out('value')} AS value FROM {ds.CENTRES} WHERE x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.2 AND 0.05")
def sel_area(spark, sf):
    return select.in_box(ds.centres(spark, sf), (-0.1, -0.2, 0.15, 0.05)).select("element", out("value").alias("value"))


@query(f"SELECT epoch_us(time) AS time, y_idx, x_idx, {sql_out('price', 4)} AS price FROM {ds.GRID2} WHERE 100 + x_idx * 10 BETWEEN 115 AND 145 AND y_idx * 5 + 3 BETWEEN 10 AND 40")
def sel_area_grid(spark, sf):
    grid = Grid2D(Axis(100.0, 10.0, 7), Axis(3.0, 5.0, 10))
    f = Frame.of(ds.grid2(spark, sf), ("time", "y_idx", "x_idx"), geometry=grid)
    found = f.sel(area=(115, 10, 145, 40))
    first = {d: grid.axes[d].nearest(found.geometry.axes[d].x0) for d in ("x", "y")}  # numbers in the whole grid are wanted
    return found.df.select(T(), (F.col("y_idx") + first["y"]).alias("y_idx"), (F.col("x_idx") + first["x"]).alias("x_idx"), out("price", 4).alias("price"))


@query(f"SELECT epoch_us(time) AS time, y_idx, {sql_out('price', 4)} AS price FROM {ds.GRID2} WHERE x_idx = 6")
def isel_cells_negative(spark, sf):
    f = Frame.of(ds.grid2(spark, sf), ("time", "y_idx", "x_idx"), geometry=Grid2D(Axis(100.0, 10.0, 7), Axis(3.0, 5.0, 10)))
    return f.isel(x_idx=-1).df.select(T(), "y_idx", out("price", 4).alias("price"))


@query(f"SELECT epoch_us(time) AS time, y_idx - 2 AS y_idx, x_idx // 2 AS x_idx, {sql_out('price', 4)} AS price FROM {ds.GRID2} WHERE x_idx % 2 = 0 AND y_idx BETWEEN 2 AND 8")
def isel_cells_step(spark, sf):
    f = Frame.of(ds.grid2(spark, sf), ("time", "y_idx", "x_idx"), geometry=Grid2D(Axis(100.0, 10.0, 7), Axis(3.0, 5.0, 10)))
    return f.isel(x_idx=slice(None, None, 2), y_idx=slice(2, -1)).df.select(T(), "y_idx", "x_idx", out("price", 4).alias("price"))


def _mesh_frame(spark: SparkSession, sf: str) -> Frame:
    """One value for each element of the mesh, at one time."""
    from gridloom.geometry.mesh import TableMesh

    nodes, elements = ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)
    values = elements.select(F.expr("timestamp_ntz'2024-01-01'").alias("time"), "element", (F.col("element") * 2.0).alias("value"))
    return Frame.of(values, ("time", "element"), geometry=TableMesh(nodes, elements))


_CENTRED = f"(SELECT e.element, avg(m.x) AS x, avg(m.y) AS y FROM (SELECT element, unnest(nodes) AS node FROM {ds.ELEMENTS}) e JOIN {ds.NODES} m USING (node) GROUP BY e.element)"


@query(f"SELECT element, {sql_out('element * 2.0')} AS value FROM {_CENTRED} WHERE x BETWEEN 3.0 AND 9.5 AND y BETWEEN 1.0 AND 4.2")
def sel_mesh_area(spark, sf):
    return _mesh_frame(spark, sf).sel(area=(3.0, 1.0, 9.5, 4.2)).df.select("element", out("value").alias("value"))


@query(f"SELECT element, {sql_out('element * 2.0')} AS value FROM {_CENTRED} WHERE x > 2.05 AND y > 0.53 AND y < 4.03 AND x + 2 * y < 14.07")
def sel_mesh_polygon(spark, sf):
    return _mesh_frame(spark, sf).sel(area=[(2.05, 0.53), (13.01, 0.53), (6.01, 4.03), (2.05, 4.03)]).df.select("element", out("value").alias("value"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('price', 4)} AS price FROM {ds.GRID2} WHERE x_idx = 3 AND y_idx = 4")
def sel_nearest_cell(spark, sf):
    grid = Grid2D(Axis(100.0, 10.0, 7), Axis(3.0, 5.0, 10))
    f = Frame.of(ds.grid2(spark, sf), ("time", "y_idx", "x_idx"), geometry=grid)
    return f.sel(x=131.0, y=24.9).df.select(T(), out("price", 4).alias("price"))


@query(f"SELECT element, {sql_out('value')} AS value FROM {ds.CENTRES} ORDER BY (x - 0.05) * (x - 0.05) + (y + 0.02) * (y + 0.02), element LIMIT 1")
def sel_nearest_element(spark, sf):
    return select.nearest_cell(ds.centres(spark, sf), {"x": 0.05, "y": -0.02}, ["element"]).select("element", out("value").alias("value"))


@query("SELECT s_suppkey AS point, CASE WHEN x >= -0.25 AND x <= 0.15 THEN least(floor((x + 0.25) / 0.1), 3)::INT END AS x_idx, x >= -0.25 AND x <= 0.15 AS inside FROM (SELECT s_suppkey, (s_suppkey * 37 % 101) / 101.0 * 0.4 - 0.2 AS x FROM supplier)")
def find_cell(spark, sf):
    axis = Axis(-0.2, 0.1, 4)
    return ds.stations(spark, sf).select("point", axis.cell(F.col("x")).alias("x_idx"), axis.contains(F.col("x")).alias("inside"))


@query(f"SELECT event_id, {sql_out('CASE WHEN value > 50 AND NOT isnan(value) THEN 50 ELSE value END')} AS value FROM {ds.EVENTS}")
def mask_fill(spark, sf):
    return select.where(ds.events(spark, sf), ["value"], nan.greater(F.col("value"), F.lit(50.0)), 50.0).select("event_id", out("value").alias("value"))


@query(f"SELECT event_id, CASE WHEN isnan(value) THEN 0 ELSE round(value, 6) END AS value FROM {ds.EVENTS}")
def fillna(spark, sf):
    return select.fillna(ds.events(spark, sf), ["value"]).select("event_id", F.round("value", 6).alias("value"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('total', 2)} AS total FROM {ds.DAILY} WHERE NOT isnan(total)")
def dropna(spark, sf):
    return select.dropna(ds.daily(spark, sf), ["total", "n"]).select(T(), out("total", 2).alias("total"))


@query(f"SELECT element, {sql_out('value')} AS value FROM {ds.CENTRES} WHERE (CASE WHEN (-0.1 > y) <> (-0.2 > y) AND x < 0.3 * (y + 0.2) / 0.1 - 0.1 THEN 1 ELSE 0 END + CASE WHEN (0.2 > y) <> (-0.1 > y) AND x < -0.15 * (y + 0.1) / 0.3 + 0.2 THEN 1 ELSE 0 END + CASE WHEN (-0.2 > y) <> (0.2 > y) AND x < -0.15 * (y - 0.2) / -0.4 + 0.05 THEN 1 ELSE 0 END) % 2 = 1")
def point_in_polygon(spark, sf):
    polygon = [(-0.1, -0.2), (0.2, -0.1), (0.05, 0.2)]
    c = ds.centres(spark, sf)
    return c.where(select.inside_polygon(F.col("x"), F.col("y"), polygon)).select("element", out("value").alias("value"))


# reductions

_AGG_SQL = {
    "mean": "avg(V)", "std": "stddev_pop(V)", "max": "max(V)", "min": "CASE WHEN bool_or(isnan(V)) THEN 'NaN'::DOUBLE ELSE min(V) END",
    "ptp": "CASE WHEN bool_or(isnan(V)) THEN 'NaN'::DOUBLE ELSE max(V) - min(V) END",
    "nanmean": "avg(V) FILTER (WHERE NOT isnan(V))", "nanstd": "stddev_pop(V) FILTER (WHERE NOT isnan(V))", "nanmax": "max(V) FILTER (WHERE NOT isnan(V))", "nanmin": "min(V) FILTER (WHERE NOT isnan(V))",
}
#: A standard deviation of NaN is an error in the SQL engine, so it is guarded there.
_AGG_SQL["std"] = "CASE WHEN bool_or(isnan(V)) THEN 'NaN'::DOUBLE ELSE stddev_pop(CASE WHEN isnan(V) THEN NULL ELSE V END) END"


def _reductions() -> None:
    for how, sql in _AGG_SQL.items():
        for axis, keys in (("time", ["x_idx"]), ("space", ["time"])):
            shown = ", ".join("epoch_us(time) AS time" if k == "time" else k for k in keys)
            text = f"SELECT {shown}, {sql_out(sql.replace('V', 'quantity'))} AS quantity, {sql_out(sql.replace('V', 'discount'))} AS discount FROM {ds.GRID1} GROUP BY {', '.join(keys)}"

            def run(spark: SparkSession, sf: str, how: str = how, axis: str = axis, keys: list[str] = keys) -> DataFrame:
                f = Frame.of(ds.grid1(spark, sf), ("time", "x_idx")).aggregate(how, axis)
                return f.df.select(*(T() if k == "time" else k for k in keys), out("quantity").alias("quantity"), out("discount").alias("discount"))

            run.__name__ = f"{how}_{axis}"
            query(text)(run)


_reductions()


@query(f"SELECT {sql_out('avg(quantity) FILTER (WHERE NOT isnan(quantity))', 4)} AS quantity, {sql_out('avg(discount)')} AS discount FROM {ds.GRID1}")
def nanmean_total(spark, sf):
    f = Frame.of(ds.grid1(spark, sf), ("time", "x_idx")).nanmean(None)
    return f.df.select(out("quantity", 4).alias("quantity"), out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('sum(quantity * (x_idx + 1)) FILTER (WHERE NOT isnan(quantity)) / sum(x_idx + 1) FILTER (WHERE NOT isnan(quantity))')} AS quantity FROM {ds.GRID1} WHERE NOT isnan(quantity) GROUP BY time")
def average_space(spark, sf):
    g = ds.grid1(spark, sf).where(~F.isnan("quantity"))
    return aggregate.average(g, ["time"], ["quantity"], F.col("x_idx") + 1).select(T(), out("quantity").alias("quantity"))


@query(f"SELECT x_idx, {sql_out('sum(discount * quantity) / sum(quantity)')} AS discount FROM {ds.GRID1} WHERE NOT isnan(quantity) GROUP BY x_idx")
def average_time(spark, sf):
    return aggregate.average(ds.grid1(spark, sf).where(~F.isnan("quantity")), ["x_idx"], ["discount"], "quantity").select("x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('(total + n) / 2', 4)} AS mean, {sql_out('CASE WHEN isnan(total) THEN total ELSE greatest(total, n) END', 4)} AS max, {sql_out('CASE WHEN isnan(total) THEN total ELSE least(total, n) END', 4)} AS min, {sql_out('CASE WHEN isnan(total) THEN n ELSE greatest(total, n) END', 4)} AS nanmax FROM {ds.DAILY}")
def across_items(spark, sf):
    cols = [nan.row_reduce([F.col("total"), F.col("n")], how) for how in ("mean", "max", "min", "nanmax")]
    return ds.daily(spark, sf).select(T(), *(out(c, 4).alias(n) for c, n in zip(cols, ("mean", "max", "min", "nanmax"), strict=True)))


@query(f"SELECT x_idx, {', '.join(sql_out(f'quantile_cont(discount, {q})') + f' AS q{int(q * 100)}' for q in (0.1, 0.5, 0.9))} FROM {ds.GRID1} GROUP BY x_idx")
def quantile_list(spark, sf):
    q = aggregate.quantile(ds.grid1(spark, sf), ["x_idx"], ["discount"], [0.1, 0.5, 0.9])
    return q.select("x_idx", *(out(F.col(f"`Quantile {v}, discount`")).alias(f"q{int(v * 100)}") for v in (0.1, 0.5, 0.9)))


@query(f"""SELECT x_idx, CASE WHEN bool_or(isnan(quantity)) THEN {ds.MISSING} ELSE round(quantile_cont(CASE WHEN isnan(quantity) THEN NULL ELSE quantity END, 0.25), 6) END AS quantity,
  {sql_out('quantile_cont(CASE WHEN isnan(quantity) THEN NULL ELSE quantity END, 0.25)')} AS skipped FROM {ds.GRID1} GROUP BY x_idx""")
def nanquantile(spark, sf):
    return ds.grid1(spark, sf).groupBy("x_idx").agg(out(nan.agg_quantile(F.col("quantity"), 0.25)).alias("quantity"), out(nan.agg_nanquantile(F.col("quantity"), 0.25)).alias("skipped"))


@query(f"SELECT epoch_us(time) AS time, {sql_out('quantile_cont(discount, 0.75)')} AS discount FROM {ds.GRID1} GROUP BY time")
def quantile_space(spark, sf):
    return aggregate.quantile(ds.grid1(spark, sf), ["time"], ["discount"], 0.75).select(T(), out("discount").alias("discount"))


def _describe_sql(item: str) -> str:
    v = f"CASE WHEN isnan({item}) THEN NULL ELSE {item} END"
    stats = {"count": f"count({v})::DOUBLE", "mean": f"avg({v})", "std": f"stddev_samp({v})", "min": f"min({v})", "p25": f"quantile_cont({v}, 0.25)", "p50": f"quantile_cont({v}, 0.5)", "p75": f"quantile_cont({v}, 0.75)", "max": f"max({v})"}
    return f"SELECT '{item}' AS item, " + ", ".join(f"{sql_out(s, 4)} AS {k}" for k, s in stats.items()) + f" FROM {ds.GRID1}"


@query(_describe_sql("quantity") + " UNION ALL " + _describe_sql("discount"))
def describe(spark, sf):
    d = aggregate.describe(ds.grid1(spark, sf), ["quantity", "discount"])
    return d.select("item", *(out(F.col(f"`{c}`"), 4).alias(n) for c, n in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("max", "max"))))


@query(f"SELECT least(floor(value / 10), 9)::INT AS bin, count(*) AS n FROM {ds.EVENTS} WHERE NOT isnan(value) AND value BETWEEN 0 AND 100 GROUP BY 1")
def histogram(spark, sf):
    return aggregate.histogram(ds.events(spark, sf), "value", 0, 100, 10)


@query(f"SELECT event_id, {sql_out('avg(CASE WHEN isnan(value) THEN NULL ELSE value END) OVER (PARTITION BY user_id ORDER BY time RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)')} AS value FROM {ds.EVENTS}")
def rolling_mean(spark, sf):
    e = ds.events(spark, sf)
    rolled = aggregate.rolling(e, ["user_id"], ["value"], "time", 86_400)
    return rolled.join(e.select("user_id", "time", "event_id"), ["user_id", "time"]).select("event_id", out("value").alias("value"))


@query(f"SELECT user_id, {sql_out('avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT isnan(value))')} AS value FROM {ds.EVENTS} GROUP BY user_id")
def exceedance(spark, sf):
    return aggregate.exceedance(ds.events(spark, sf), ["user_id"], ["value"], 30.0).select("user_id", out("value").alias("value"))


# arithmetic

_OPS_SQL = {
    "add": ("+", "a + b"), "sub": ("-", "a - b"), "mul": ("*", "a * b"),
    "div": ("/", "CASE WHEN isnan(a) OR isnan(b) THEN 'NaN'::DOUBLE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'NaN'::DOUBLE WHEN a > 0 THEN 1e300 ELSE -1e300 END ELSE a / b END"),
    "floordiv": ("//", "CASE WHEN isnan(a) OR isnan(b) THEN 'NaN'::DOUBLE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'NaN'::DOUBLE WHEN a > 0 THEN 1e300 ELSE -1e300 END ELSE floor(a / b) END"),
    "mod": ("%", "CASE WHEN isnan(a) OR isnan(b) OR b = 0 THEN 'NaN'::DOUBLE ELSE CASE WHEN (a % b) <> 0 AND ((a % b) < 0) <> (b < 0) THEN (a % b) + b ELSE a % b END END"),
    "pow": ("**", "CASE WHEN isnan(a) OR isnan(b) THEN 'NaN'::DOUBLE ELSE pow(a, 2) END"),
    "less": ("<", "NOT isnan(a) AND NOT isnan(b) AND a < b"), "less_equal": ("<=", "NOT isnan(a) AND NOT isnan(b) AND a <= b"),
    "greater": (">", "NOT isnan(a) AND NOT isnan(b) AND a > b"), "greater_equal": (">=", "NOT isnan(a) AND NOT isnan(b) AND a >= b"),
    "equal": ("==", "NOT isnan(a) AND a = b"), "not_equal": ("!=", "isnan(a) OR isnan(b) OR a <> b"),
}
_PAIR = f"(SELECT event_id, value - 40 AS a, (user_id % 5 - 2)::DOUBLE AS b FROM {ds.EVENTS})"


def _arithmetic() -> None:
    for name, (op, sql) in _OPS_SQL.items():
        compares = op[0] in "<>=!"

        def run(spark: SparkSession, sf: str, op: str = op, compares: bool = compares) -> DataFrame:
            e = ds.events(spark, sf)
            a, b = F.col("value") - 40, (F.col("user_id") % 5 - 2).cast("double")
            c = combine.BINARY[op](a, F.lit(2.0) if op == "**" else b)
            c = F.when(F.isnan(b), F.lit(nan.NAN)).otherwise(c) if op == "**" else c
            if compares:
                return e.select("event_id", c.alias("r"))
            limited = F.when(F.isnan(c), c).when(c > 1e300, F.lit(1e300)).when(c < -1e300, F.lit(-1e300)).otherwise(c)
            return e.select("event_id", out(limited).alias("r"))

        run.__name__ = f"math_{name}"
        query(f"SELECT event_id, {sql if compares else sql_out(sql)} AS r FROM {_PAIR}")(run)


_arithmetic()


@query(f"SELECT event_id, {sql_out('abs(value - 40)')} AS r, {sql_out('-(value - 40)')} AS m FROM {ds.EVENTS}")
def math_abs_neg(spark, sf):
    v = F.col("value") - 40
    return ds.events(spark, sf).select("event_id", out(F.abs(v)).alias("r"), out(-v).alias("m"))


@query(f"SELECT epoch_us(a.time) AS time, a.x_idx, {sql_out('a.quantity - b.quantity')} AS quantity, {sql_out('a.discount - b.discount')} AS discount FROM {ds.GRID1} a JOIN (SELECT x_idx, CASE WHEN bool_or(isnan(quantity)) THEN 'NaN'::DOUBLE ELSE avg(CASE WHEN isnan(quantity) THEN NULL ELSE quantity END) END AS quantity, avg(discount) AS discount FROM {ds.GRID1} GROUP BY x_idx) b USING (x_idx)")
def anomaly(spark, sf):
    f = Frame.of(ds.grid1(spark, sf), ("time", "x_idx"))
    return (f - f.mean()).df.select(T(), "x_idx", out("quantity").alias("quantity"), out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('discount')} AS discount, {sql_out('tax')} AS tax FROM {ds.GRID1} JOIN (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS time, l_linenumber - 1 AS x_idx, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2) USING (time, x_idx)")
def merge(spark, sf):
    li = ds.table(spark, sf, "lineitem")
    tax = li.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), (F.col("l_linenumber") - 1).alias("x_idx")).agg(F.avg("l_tax").alias("tax"))
    merged = combine.merge([ds.grid1(spark, sf).drop("quantity"), tax], ["time", "x_idx"])
    return merged.select(T(), "x_idx", out("discount").alias("discount"), out("tax").alias("tax"))


_PARTS = f"(SELECT time, x_idx, discount, 0 AS s FROM {ds.GRID1} WHERE time < '1999-06-01' UNION ALL SELECT time, x_idx, discount + 1, 1 FROM {ds.GRID1} WHERE time >= '1997-01-01')"


def _parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    g = ds.grid1(spark, sf).drop("quantity")
    return [g.where("time < timestamp_ntz'1999-06-01'"), g.where("time >= timestamp_ntz'1997-01-01'").withColumn("discount", F.col("discount") + 1)]


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('arg_max(discount, s)')} AS discount FROM {_PARTS} GROUP BY time, x_idx")
def concat_last(spark, sf):
    return combine.concat(_parts(spark, sf), ["time", "x_idx"]).select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('arg_min(discount, s)')} AS discount FROM {_PARTS} GROUP BY time, x_idx")
def concat_first(spark, sf):
    return combine.concat(_parts(spark, sf), ["time", "x_idx"], keep="first").select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('avg(discount)')} AS discount FROM {_PARTS} GROUP BY time, x_idx")
def concat_average(spark, sf):
    return combine.concat(_parts(spark, sf), ["time", "x_idx"], keep="average").select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, epoch_us(next_time) AS next_time, (epoch_us(next_time) - epoch_us(time)) / 1e6 AS gap FROM (SELECT time, lead(time) OVER (ORDER BY time) AS next_time FROM {ds.DAILY}) WHERE epoch_us(next_time) - epoch_us(time) > 86400000000")
def gap_check(spark, sf):
    return combine.gaps(ds.daily(spark, sf), 86_400).select(T(), micros("next_time").alias("next_time"), "gap")


# whole datasets


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('discount * 100 + 2.5')} AS discount FROM {ds.GRID1}")
def scale(spark, sf):
    return pipeline.scale(ds.grid1(spark, sf), ["discount"], factor=100, offset=2.5).select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(a.time) AS time, a.x_idx, {sql_out('a.discount - b.discount')} AS discount FROM {ds.GRID1} a JOIN {_PARTS} b ON a.time = b.time AND a.x_idx = b.x_idx AND b.s = 1")
def diff(spark, sf):
    return pipeline.diff(ds.grid1(spark, sf), _parts(spark, sf)[1], ["time", "x_idx"], ["discount"]).select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(a.time) AS time, a.x_idx, {sql_out('a.discount + b.discount')} AS discount FROM {ds.GRID1} a JOIN {_PARTS} b ON a.time = b.time AND a.x_idx = b.x_idx AND b.s = 0")
def add(spark, sf):
    return pipeline.add(ds.grid1(spark, sf), _parts(spark, sf)[0], ["time", "x_idx"], ["discount"]).select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT epoch_us(time) AS time, x_idx, {sql_out('discount')} AS discount FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS step FROM {ds.GRID1}) WHERE step >= 10 AND time < '1999-01-01' AND (step - 10) % 3 = 0")
def extract(spark, sf):
    return pipeline.extract(ds.grid1(spark, sf), start=10, stop="1998", step=3).select(T(), "x_idx", out("discount").alias("discount"))


@query(f"SELECT x_idx, CASE WHEN count(*) FILTER (WHERE NOT isnan(quantity)) = (SELECT count(DISTINCT date_trunc('month', l_shipdate)) FROM lineitem) THEN round(avg(CASE WHEN isnan(quantity) THEN NULL ELSE quantity END), 6) ELSE {ds.MISSING} END AS quantity FROM {ds.GRID1} GROUP BY x_idx")
def mean_time_all_valid(spark, sf):
    return pipeline.mean_time(ds.grid1(spark, sf), ["x_idx"], ["quantity"], require_all_valid=True).select("x_idx", out("quantity").alias("quantity"))


@query(f"SELECT x_idx, {sql_out('avg(CASE WHEN isnan(quantity) THEN NULL ELSE quantity END)')} AS quantity FROM {ds.GRID1} GROUP BY x_idx")
def mean_time_skip(spark, sf):
    return pipeline.mean_time(ds.grid1(spark, sf), ["x_idx"], ["quantity"]).select("x_idx", out("quantity").alias("quantity"))


@query(f"SELECT element, {sql_out('sqrt(x * x + y * y)')} AS speed, {sql_out('(90 - degrees(atan2(y, x))) - 360 * floor((90 - degrees(atan2(y, x))) / 360)', 4)} AS direction FROM {ds.CENTRES}")
def speed_direction(spark, sf):
    return pipeline.speed_and_direction(ds.centres(spark, sf), ["element"], "x", "y").select("element", out("speed").alias("speed"), out("direction", 4).alias("direction"))


@query(f"SELECT element, {sql_out('value')} AS value, {sql_out('value * 2 + x')} AS made FROM {ds.CENTRES}")
def transform(spark, sf):
    made = pipeline.transform(ds.centres(spark, sf), ["value", "x"], [pipeline.Derived("made", lambda c: c["value"] * 2 + c["x"])], keys=["element"])
    return made.select("element", out("value").alias("value"), out("made").alias("made"))


# time


@query(f"""WITH d AS (SELECT time, n FROM {ds.DAILY}), t AS (SELECT unnest(generate_series((SELECT min(time) FROM d), (SELECT max(time) FROM d), INTERVAL 6 HOUR)) AS time)
SELECT epoch_us(t.time) AS time, {sql_out('a.n + (b.n - a.n) * (CASE WHEN a.time = b.time THEN 0.0 ELSE (epoch_us(t.time) - epoch_us(a.time)) / (epoch_us(b.time) - epoch_us(a.time))::DOUBLE END)')} AS n
FROM t ASOF JOIN d a ON t.time >= a.time ASOF JOIN d b ON t.time <= b.time""")
def interp_time_regular(spark, sf):
    f = Frame.of(ds.daily(spark, sf).select("time", "n"))
    return f.interp_time("6h").df.select(T(), out("n").alias("n"))


def _method_sql(value: str) -> str:
    return f"""WITH d AS (SELECT time, n FROM {ds.DAILY}), t AS (SELECT DISTINCT l_shipdate + INTERVAL 7 HOUR AS time FROM lineitem)
SELECT epoch_us(t.time) AS time, {sql_out(f'CASE WHEN a.time IS NULL OR b.time IS NULL THEN -1 ELSE {value} END')} AS n
FROM t ASOF LEFT JOIN d a ON t.time >= a.time ASOF LEFT JOIN d b ON t.time <= b.time"""


def _to_other_axis(spark: SparkSession, sf: str, method: str) -> DataFrame:
    target = ds.table(spark, sf, "lineitem").select((F.col("l_shipdate") + F.expr("INTERVAL 7 HOURS")).alias("time"))
    return interpolate.interp_time(ds.daily(spark, sf), target, [], ["n"], method=method, fill_value=-1.0).select(T(), out("n").alias("n"))


@query(_method_sql("a.n + (b.n - a.n) * ((epoch_us(t.time) - epoch_us(a.time)) / (epoch_us(b.time) - epoch_us(a.time))::DOUBLE)"))
def interp_time_other_axis(spark, sf):
    return _to_other_axis(spark, sf, "linear")


@query(_method_sql("a.n"))
def interp_time_previous(spark, sf):
    return _to_other_axis(spark, sf, "previous")


@query(_method_sql("CASE WHEN 2 * (epoch_us(t.time) - epoch_us(a.time)) <= epoch_us(b.time) - epoch_us(a.time) THEN a.n ELSE b.n END"))
def interp_time_nearest(spark, sf):
    return _to_other_axis(spark, sf, "nearest")


@query(f"""WITH g AS (SELECT time, x_idx, discount FROM {ds.GRID1}), t AS (SELECT DISTINCT o_orderdate AS time FROM orders), c AS (SELECT DISTINCT x_idx FROM g)
SELECT epoch_us(t.time) AS time, c.x_idx, {sql_out("CASE WHEN a.time IS NULL OR b.time IS NULL THEN 'NaN'::DOUBLE WHEN a.time = b.time THEN a.discount ELSE a.discount + (b.discount - a.discount) * ((epoch_us(t.time) - epoch_us(a.time)) / (epoch_us(b.time) - epoch_us(a.time))::DOUBLE) END")} AS discount
FROM t CROSS JOIN c ASOF LEFT JOIN g a ON c.x_idx = a.x_idx AND t.time >= a.time ASOF LEFT JOIN g b ON c.x_idx = b.x_idx AND t.time <= b.time""")
def interp_time_cells(spark, sf):
    target = ds.table(spark, sf, "orders").select(F.col("o_orderdate").alias("time"))
    g = interpolate.interp_time(ds.grid1(spark, sf), target, ["x_idx"], ["discount"])
    return g.select(T(), "x_idx", out("discount").alias("discount"))


@query(f"""WITH d AS (SELECT time, total FROM {ds.DAILY}), v AS (SELECT * FROM d WHERE NOT isnan(total))
SELECT epoch_us(d.time) AS time, {sql_out('CASE WHEN NOT isnan(d.total) THEN d.total WHEN a.time IS NULL OR b.time IS NULL THEN NULL ELSE a.total + (b.total - a.total) * ((epoch_us(d.time) - epoch_us(a.time)) / (epoch_us(b.time) - epoch_us(a.time))::DOUBLE) END', 3)} AS total
FROM d ASOF LEFT JOIN v a ON d.time >= a.time ASOF LEFT JOIN v b ON d.time <= b.time""")
def interp_na(spark, sf):
    return interpolate.interp_na(ds.daily(spark, sf), [], ["total"]).select(T(), out("total", 3).alias("total"))


@query(f"SELECT count(DISTINCT g) = 1 AS is_equidistant, count(*) AS n_steps, (SELECT (epoch_us(b) - epoch_us(a)) / 1e6 FROM (SELECT time AS a, lead(time) OVER (ORDER BY time) AS b FROM {ds.DAILY}) ORDER BY a LIMIT 1) AS timestep FROM (SELECT epoch_us(time) - lag(epoch_us(time)) OVER (ORDER BY time) AS g FROM {ds.DAILY})")
def is_equidistant(spark, sf):
    return times.is_equidistant(ds.daily(spark, sf))


@query(f"WITH v AS (SELECT time, n FROM {ds.DAILY}), o AS (SELECT time + INTERVAL 12 HOUR AS time, n FROM {ds.DAILY}) SELECT {sql_out('avg(abs(a.n + (b.n - a.n) * (epoch_us(o.time) - epoch_us(a.time)) / (epoch_us(b.time) - epoch_us(a.time))::DOUBLE - o.n))')} AS mae FROM o ASOF JOIN v a ON o.time >= a.time ASOF JOIN v b ON o.time <= b.time")
def model_error(spark, sf):
    observed = ds.daily(spark, sf).select((F.col("time") + F.expr("INTERVAL 12 HOURS")).alias("time"), "n")
    model = interpolate.interp_time(ds.daily(spark, sf).select("time", "n"), observed, [], ["n"])
    return pipeline.mean_absolute_error(model, observed, ["time"], "n").select(out("mae").alias("mae"))


# distance and neighbours

_PATH = "(SELECT event_id, user_id, ts, (event_id * 37 % 101)::DOUBLE AS x, (event_id * 53 % 89)::DOUBLE AS y FROM events)"


def _path(spark: SparkSession, sf: str) -> DataFrame:
    e = ds.table(spark, sf, "events")
    return e.select("event_id", "user_id", "ts", (F.col("event_id") * 37 % 101).cast("double").alias("x"), (F.col("event_id") * 53 % 89).cast("double").alias("y"))


@query(f"SELECT event_id, {sql_out('sum(step) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)', 4)} AS distance FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM {_PATH} WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def cumulative_distance(spark, sf):
    return distance.cumulative(_path(spark, sf), ["user_id"], "ts", "x", "y").select("event_id", out("distance", 4).alias("distance"))


@query(f"SELECT event_id, {sql_out('sum(step) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)', 1)} AS distance FROM (SELECT *, coalesce(6371000 * sqrt(pow(radians(CASE WHEN abs(x - lag(x) OVER w) > 180 THEN 360 - abs(x - lag(x) OVER w) ELSE abs(x - lag(x) OVER w) END) * cos(radians((y + lag(y) OVER w) / 2)), 2) + pow(radians(y - lag(y) OVER w), 2)), 0) AS step FROM {_PATH} WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def cumulative_distance_geo(spark, sf):
    return distance.cumulative(_path(spark, sf), ["user_id"], "ts", "x", "y", is_geo=True).select("event_id", out("distance", 1).alias("distance"))


@query(f"SELECT {', '.join(sql_out(c) + ' AS ' + n for c, n in (('min(x) - 0.5', 'left_'), ('min(y) - 0.5', 'bottom'), ('max(x) + 0.5', 'right_'), ('max(y) + 0.5', 'top')))} FROM {ds.CENTRES}")
def bounding_box(spark, sf):
    b = distance.bounds(ds.centres(spark, sf), "x", "y", 0.5)
    return b.select(*(out(F.col(c)).alias(n) for c, n in (("left", "left_"), ("bottom", "bottom"), ("right", "right_"), ("top", "top"))))


def _knn_sql(k: int) -> str:
    return f"(SELECT s.point, e.element, e.value, sqrt((s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y)) AS distance, row_number() OVER (PARTITION BY s.point ORDER BY sqrt((s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y)), e.element) AS rank FROM {ds.STATIONS} s, {ds.CENTRES} e QUALIFY rank <= {k})"


@query(f"SELECT point, element, {sql_out('distance')} AS distance FROM {_knn_sql(1)}")
def nearest_element(spark, sf):
    return interpolate.nearest(ds.stations(spark, sf), ds.centres(spark, sf), 1).select("point", "element", out("distance").alias("distance"))


@query(f"SELECT point, element, {sql_out('distance')} AS distance, rank::INT AS rank FROM {_knn_sql(5)}")
def knn5(spark, sf):
    return interpolate.nearest(ds.stations(spark, sf), ds.centres(spark, sf), 5).select("point", "element", out("distance").alias("distance"), "rank")


@query(f"SELECT point, {sql_out('sum(value / (distance * distance)) / sum(1 / (distance * distance))')} AS value FROM {_knn_sql(5)} GROUP BY point")
def idw(spark, sf):
    c = ds.centres(spark, sf)
    w = interpolate.idw_weights(interpolate.nearest(ds.stations(spark, sf), c, 5))
    return interpolate.apply_weights(c, w, ["value"], keys=[]).select("point", out("value").alias("value"))


@query(f"SELECT point, {sql_out('CASE WHEN max(distance) > 0.03 THEN NULL ELSE sum(value / distance) / sum(1 / distance) END')} AS value FROM {_knn_sql(3)} GROUP BY point")
def idw_radius(spark, sf):
    c = ds.centres(spark, sf)
    w = interpolate.idw_weights(interpolate.nearest(ds.stations(spark, sf), c, 3), p=1, radius=0.03)
    return interpolate.apply_weights(c, w, ["value"], keys=[]).select("point", out("value").alias("value"))


@query(f"""WITH s AS (SELECT point, (x + 0.2) / 0.4 * 6 AS fx, (y + 0.2) / 0.4 * 9 AS fy FROM {ds.STATIONS}),
c AS (SELECT point, least(floor(fx), 5) AS ix, least(floor(fy), 8) AS iy, fx - least(floor(fx), 5) AS wx, fy - least(floor(fy), 8) AS wy FROM s WHERE fx BETWEEN 0 AND 6 AND fy BETWEEN 0 AND 9)
SELECT epoch_us(g.time) AS time, point, {sql_out('sum(price * CASE WHEN g.x_idx = ix THEN 1 - wx ELSE wx END * CASE WHEN g.y_idx = iy THEN 1 - wy ELSE wy END)', 3)} AS price
FROM c JOIN {ds.GRID2} g ON g.x_idx BETWEEN ix AND ix + 1 AND g.y_idx BETWEEN iy AND iy + 1 GROUP BY g.time, point""")
def interp_grid_bilinear(spark, sf):
    grid = Grid2D(Axis(-0.2, 0.4 / 6, 7), Axis(-0.2, 0.4 / 9, 10))
    return interpolate.interp_grid(ds.grid2(spark, sf), ds.stations(spark, sf), grid, ["price"]).select(T(), "point", out("price", 3).alias("price"))


_FIELD = f"(SELECT d.time, e.element, d.n * e.value + e.code AS value FROM (SELECT TIMESTAMP '2024-01-01' + to_days(i::INT) AS time, i::DOUBLE AS n FROM range(0, 31) t(i)) d, {ds.CENTRES} e)"
_TRACK = "(SELECT event_id, ts AS time, (event_id * 37 % 101) / 101.0 * 0.4 - 0.2 AS x, (event_id * 53 % 97) / 97.0 * 0.4 - 0.2 AS y FROM events)"


def _field(spark: SparkSession, sf: str) -> DataFrame:
    """A daily field over the mesh: 31 steps of every element."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(30))).alias("n")
    e = ds.centres(spark, sf).select("element", "value", "code", steps)
    return e.select(F.timestamp_add("DAY", F.col("n"), F.expr("timestamp_ntz'2024-01-01'")).alias("time"), "element", (F.col("n") * F.col("value") + F.col("code")).alias("value"))


def _track(spark: SparkSession, sf: str) -> DataFrame:
    e = ds.table(spark, sf, "events")
    return e.select("event_id", F.col("ts").alias("time"), ((F.col("event_id") * 37 % 101) / 101.0 * 0.4 - 0.2).alias("x"), ((F.col("event_id") * 53 % 97) / 97.0 * 0.4 - 0.2).alias("y"))


def _track_sql(k: int) -> str:
    weight = "1.0" if k == 1 else "1 / (d * d)"
    return f"""WITH p AS (SELECT DISTINCT x, y FROM {_TRACK}),
w AS (SELECT p.x, p.y, e.element, e.value, e.code, sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y)) AS d, row_number() OVER (PARTITION BY p.x, p.y ORDER BY sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y)), e.element) AS r FROM p, {ds.CENTRES} e QUALIFY r <= {k}),
v AS (SELECT x, y, sum(value * {weight}) / sum({weight}) AS value, sum(code * {weight}) / sum({weight}) AS code FROM w GROUP BY x, y)
SELECT event_id, {sql_out("(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 * value + code")} AS value FROM {_TRACK} JOIN v USING (x, y)"""


@query(_track_sql(1))
def track_nearest(spark, sf):
    t = interpolate.extract_track(_field(spark, sf), _track(spark, sf), ds.centres(spark, sf), ["value"], step_seconds=86_400)
    return t.select("event_id", out("value").alias("value"))


@query(_track_sql(5))
def track_idw(spark, sf):
    t = interpolate.extract_track(_field(spark, sf), _track(spark, sf), ds.centres(spark, sf), ["value"], method="inverse_distance", step_seconds=86_400)
    return t.select("event_id", out("value").alias("value"))


# meshes

_CORNERS = f"(SELECT e.element, len(e.nodes) AS n, i, m.x, m.y, m.z FROM (SELECT element, nodes, unnest(range(1, len(nodes) + 1)) AS i FROM {ds.ELEMENTS}) e JOIN {ds.NODES} m ON m.node = e.nodes[i])"


@query(f"SELECT element, {sql_out('avg(x)')} AS x, {sql_out('avg(y)')} AS y, {sql_out('avg(z)')} AS z FROM {_CORNERS} GROUP BY element")
def mesh_centroids(spark, sf):
    from gridloom.geometry.mesh import centroids

    return centroids(ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)).select("element", *(out(c).alias(c) for c in "xyz"))


_NEXT = f"(SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM {_CORNERS} WINDOW w AS (PARTITION BY element ORDER BY i))"


@query(f"SELECT element, {sql_out('abs(sum(x * y2 - x2 * y)) / 2')} AS area FROM {_NEXT} GROUP BY element")
def element_area(spark, sf):
    return mesh.element_area(ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)).select("element", out("area").alias("area"))


@query(f"SELECT element, {sql_out('abs(sum(radians(x) * radians(y2) - radians(x2) * radians(y))) / 2 * 6366707.0 * 6366707.0 * cos(radians(avg(y))) / 1e6', 3)} AS area FROM {_NEXT} GROUP BY element")
def element_area_geo(spark, sf):
    return mesh.element_area(ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf), is_geo=True).select("element", out(F.col("area") / 1e6, 3).alias("area"))


@query(f"SELECT least(a, b) AS a, greatest(a, b) AS b, min(element) AS element FROM (SELECT element, nodes[i] AS a, nodes[i % len(nodes) + 1] AS b FROM (SELECT element, nodes, unnest(range(1, len(nodes) + 1)) AS i FROM {ds.ELEMENTS})) GROUP BY 1, 2 HAVING count(*) = 1")
def boundary_faces(spark, sf):
    return mesh.boundary_faces(ds.mesh_elements(spark, sf))


_PROBES = "(SELECT c_custkey AS point, (c_custkey * 37 % 101) / 101.0 * 24 - 1 AS x, (c_custkey * 53 % 97) / 97.0 * 40 - 1 AS y FROM customer)"


@query(f"""WITH s AS (SELECT p.point, n.element, (n.x2 - n.x) * (p.y - n.y) - (n.y2 - n.y) * (p.x - n.x) AS side FROM {_PROBES} p, {_NEXT} n),
h AS (SELECT point, element FROM s GROUP BY point, element HAVING min(side) >= 0 OR max(side) <= 0)
SELECT p.point, min(h.element) AS element FROM {_PROBES} p LEFT JOIN h USING (point) GROUP BY p.point""")
def find_elements(spark, sf):
    c = ds.table(spark, sf, "customer")
    k = F.col("c_custkey")
    points = c.select(k.alias("point"), ((k * 37 % 101) / 101.0 * 24 - 1).alias("x"), ((k * 53 % 97) / 97.0 * 40 - 1).alias("y"))
    return mesh.find_elements(points, ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf))


@query(f"""WITH c AS (SELECT element, avg(x) AS ex, avg(y) AS ey, avg(z) AS v FROM {_CORNERS} GROUP BY element),
a AS (SELECT n.node, c.ex - n.x AS dx, c.ey - n.y AS dy, c.v FROM (SELECT element, unnest(nodes) AS node FROM {ds.ELEMENTS}) e JOIN c USING (element) JOIN {ds.NODES} n ON n.node = e.node),
m AS (SELECT node, sum(dx * dx) AS ixx, sum(dy * dy) AS iyy, sum(dx * dy) AS ixy FROM a GROUP BY node),
l AS (SELECT *, ixx * iyy - ixy * ixy AS lam FROM m),
w AS (SELECT a.node, a.v, CASE WHEN lam > 1e-10 * ixx * iyy THEN 1 + (2 * ixy * dx * dy - iyy * dx * dx - ixx * dy * dy) / lam ELSE 0 END AS w, 1 / sqrt(dx * dx + dy * dy) AS i FROM a JOIN l USING (node))
SELECT node, {sql_out('CASE WHEN sum(w) > 1e-9 THEN sum(v * w) / sum(w) ELSE sum(v * i) / sum(i) END', 8)} AS v FROM w GROUP BY node""")
def node_centred(spark, sf):
    from gridloom.geometry.mesh import centroids

    nodes, elements = ds.mesh_nodes(spark, sf), ds.mesh_elements(spark, sf)
    values = centroids(nodes, elements).select("element", F.col("z").alias("v"))
    return mesh.node_centred(nodes, elements, values, "v").select("node", out("v", 8).alias("v"))


@query(f"SELECT s.point, {sql_out('min(sqrt(pow(s.x - n.x, 2) + pow(s.y - n.y, 2)))')} AS distance FROM {ds.STATIONS} s, {ds.NODES} n WHERE n.code > 0 GROUP BY s.point")
def distance_to_boundary(spark, sf):
    return mesh.distance_to_boundary(ds.stations(spark, sf), ds.mesh_nodes(spark, sf)).select("point", out("distance").alias("distance"))


# layers and spectra


@query("SELECT l_orderkey, arg_max(l_extendedprice, l_discount * 1000000 + l_partkey * 10 + l_linenumber + l_extendedprice / 10000000) AS top, arg_min(l_extendedprice, l_discount * 1000000 + l_partkey * 10 + l_linenumber + l_extendedprice / 10000000) AS bottom FROM lineitem GROUP BY l_orderkey")
def top_and_bottom(spark, sf):
    li = ds.table(spark, sf, "lineitem").withColumn("layer", F.col("l_discount") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 10_000_000)
    top = layered.end_values(li, ["l_orderkey"], ["l_extendedprice"]).withColumnRenamed("l_extendedprice", "top")
    bottom = layered.end_values(li, ["l_orderkey"], ["l_extendedprice"], top=False).withColumnRenamed("l_extendedprice", "bottom")
    return top.join(bottom, "l_orderkey")


@query(f"SELECT element, {sql_out('avg(z) FILTER (WHERE i > 2) - avg(z) FILTER (WHERE i <= 2)')} AS thickness, {sql_out('avg(z)')} AS z FROM {_CORNERS} WHERE n = 4 GROUP BY element")
def layer_thickness(spark, sf):
    z = layered.element_z(ds.mesh_elements(spark, sf).where("size(nodes) = 4"), ds.mesh_nodes(spark, sf).select("node", "z"), keys=[])
    return z.select("element", out("thickness").alias("thickness"), out("z").alias("z"))


_FREQUENCIES = [0.05 * 1.2**i for i in range(8)]
_F = "[" + ", ".join(repr(f) for f in _FREQUENCIES) + "]"
_W = f"({_F}[frequency_idx + 1] * (1.2 - 1 / 1.2) / 2)"


@query(f"WITH e AS (SELECT point, frequency_idx, sum(energy) * radians(45) AS e FROM {ds.SPECTRA} GROUP BY 1, 2) SELECT point, {sql_out(f'sum(e * {_W}) + max(CASE WHEN frequency_idx = 7 THEN e END) * {_FREQUENCIES[7]!r} * 0.25')} AS m0 FROM e GROUP BY point")
def zeroth_moment(spark, sf):
    s = spectral.with_widths(ds.spectra(spark, sf), _FREQUENCIES)
    return spectral.zeroth_moment(s, ["point"], "energy", direction_step=45).select("point", out("m0").alias("m0"))


@query(f"WITH e AS (SELECT point, frequency_idx, sum(energy) * radians(45) AS e FROM {ds.SPECTRA} GROUP BY 1, 2) SELECT point, {sql_out(f'4 * sqrt(sum(e * {_W}))')} AS hm0 FROM e GROUP BY point")
def wave_height(spark, sf):
    s = spectral.with_widths(ds.spectra(spark, sf), _FREQUENCIES)
    return spectral.significant_wave_height(s, ["point"], "energy", direction_step=45, tail=False).select("point", out("Hm0").alias("hm0"))


# documents of parameters: built from the suppliers, one section each


_SECTION = "'[S]\n  name = ''' || s_name || '''\n  nation = ' || s_nationkey || ', ' || (s_nationkey % 3 = 0) || '\n  [POINT_1]\n    x = ' || s_suppkey || '\n  EndSect\n  [POINT_2]\n    x = ' || (s_suppkey + 1) || ' // next\n  EndSect\nEndSect\n'"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.sources import params

    s = ds.table(spark, sf, "supplier")
    return params.parse_documents(s.select(F.col("s_suppkey").alias("doc"), F.expr(_SECTION.replace("'''", "\\''").replace("\n", "\\n").replace("\\'' || s_name || \\''", "\\'' || s_name || '\\'")).alias("text")))


@query("SELECT s_suppkey::VARCHAR AS doc, n AS number, (s_suppkey + n - 1)::BIGINT AS x FROM supplier, (SELECT unnest([1, 2]) AS n)")
def parameter_points(spark, sf):
    from gridloom.sources import params

    return params.numbered_sections(_documents(spark, sf), "POINT", ["x"]).select("doc", "number", F.col("x").cast("long").alias("x"))


@query("SELECT s_suppkey::VARCHAR AS doc, s_nationkey::BIGINT AS nation, s_nationkey % 3 = 0 AS third FROM supplier WHERE s_nationkey % 3 = 0")
def parameter_search(spark, sf):
    from gridloom.sources import params

    return params.search(_documents(spark, sf), param=True).select("doc", params.value("int").alias("nation"), params.value("bool", 1).alias("third"))


# streams (run as a batch here; the plan is the same)


@query(f"SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, time)) AS start, user_id % 10 AS cell, {sql_out('avg(CASE WHEN isnan(value) THEN NULL ELSE value END)')} AS value FROM {ds.EVENTS} GROUP BY 1, 2")
def windowed_mean(spark, sf):
    from gridloom.streaming.windows import windowed

    e = ds.events(spark, sf).withColumn("cell", F.col("user_id") % 10)
    return windowed(e, ["cell"], ["value"], size="6 hours").select(micros("start").alias("start"), "cell", out("value").alias("value"))
