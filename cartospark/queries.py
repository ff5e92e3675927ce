"""Registered queries of the spatial engine over the test tables, and their SQL.

Tables become spatial like this: a line item is the point (extended price, quantity); suppliers, parts and customers are boxes
or points with integer coordinates made from their keys, so that both engines compute the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geodesic, geometry as G
from .functions import st
from .operators import canvas, generators, join, partition, relational, synopses, tiles, trajectory, vector
from .operators.store import Folder
from .operators.synopses import Grid
from .sources import binary, facade
from .sources.text import st_asgeojson, st_fromgeojson

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "join_pbsm"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the tables as geometries -------------------------------------------------------------------------

ITEM_ID = "l_orderkey * 8 + l_linenumber"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Points, about 100,000 wide and 50 high."""
    t = _read(spark, d, "lineitem")
    return t.select(F.expr(ITEM_ID).alias("item"), "l_quantity", st.st_point("l_extendedprice", "l_quantity").alias("geom"))


_ITEMS = f"SELECT {ITEM_ID} AS item, l_extendedprice AS x, l_quantity AS y, l_quantity FROM lineitem"


def zones(spark: SparkSession, d: str) -> DataFrame:
    """Supplier boxes over the items' area."""
    x1, y1 = F.expr("(s_suppkey * 7919) % 1000 * 100"), F.expr("(s_suppkey * 31) % 45 + 1")
    t = _read(spark, d, "supplier")
    return t.select("s_suppkey", st.st_makebox(x1, y1, x1 + F.expr("(s_suppkey % 17 + 1) * 150"), y1 + F.expr("s_suppkey % 5 + 1")).alias("geom"))


_ZONES = """SELECT s_suppkey, (s_suppkey * 7919) % 1000 * 100 AS x1, (s_suppkey * 31) % 45 + 1 AS y1,
    (s_suppkey * 7919) % 1000 * 100 + (s_suppkey % 17 + 1) * 150 AS x2, (s_suppkey * 31) % 45 + 1 + s_suppkey % 5 + 1 AS y2 FROM supplier"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Part boxes on a grid of 1000 x 1000."""
    x1, y1 = F.expr("(p_partkey * 7919) % 1000"), F.expr("(p_partkey * 104729) % 1000")
    t = _read(spark, d, "part")
    return t.select("p_partkey", st.st_makebox(x1, y1, x1 + F.expr("p_partkey % 13 + 1"), y1 + F.expr("p_partkey % 7 + 1")).alias("geom"))


_BOXES = """SELECT p_partkey, (p_partkey * 7919) % 1000 AS x1, (p_partkey * 104729) % 1000 AS y1,
    (p_partkey * 7919) % 1000 + p_partkey % 13 + 1 AS x2, (p_partkey * 104729) % 1000 + p_partkey % 7 + 1 AS y2 FROM part"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customer points on the same grid."""
    t = _read(spark, d, "customer")
    return t.select("c_custkey", st.st_point(F.expr("(c_custkey * 613) % 1000"), F.expr("(c_custkey * 389) % 1000")).alias("geom"))


_PLACES = "SELECT c_custkey, (c_custkey * 613) % 1000 AS x, (c_custkey * 389) % 1000 AS y FROM customer"

ITEM_GRID = Grid(0.0, 0.0, 110000.0, 64.0, 64, 32)
BOX_GRID = Grid(0.0, 0.0, 1024.0, 1024.0, 32, 32)
AREA = (0.0, 0.0, 1024.0, 1024.0)


# --- range query and joins ----------------------------------------------------------------------------


@query(f"SELECT item, x, y FROM ({_ITEMS}) WHERE x BETWEEN 20000 AND 45000 AND y BETWEEN 5 AND 20")
def range_query(spark, d):
    found = join.range_query(items(spark, d), G.box(20000, 5, 45000, 20), simple=True)
    return found.select("item", st.st_xmin("geom").alias("x"), st.st_ymin("geom").alias("y"))


_ZONE_JOIN = f"SELECT s_suppkey, count(*) AS n, sum(item) AS items, sum(l_quantity) AS quantity FROM ({_ZONES}) z JOIN ({_ITEMS}) i ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY s_suppkey"
_ZONE_JOIN = _ZONE_JOIN.replace("sum(item)", "CAST(sum(item) AS BIGINT)")


def _zone_join(method: str, **more) -> Callable:
    def run(spark, d):
        pairs = join.spatial_join(items(spark, d), zones(spark, d), "intersects", method, **more)
        return pairs.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("item").alias("items"), F.sum("l_quantity").alias("quantity"))

    run.__name__ = f"join_{method}"
    return run


for _method in ("auto", "bnlj", "broadcast", "pbsm", "sjmr", "sj1d"):
    query(_ZONE_JOIN)(_zone_join(_method))


def _cell_join(method: str, left: str, right: str | None) -> Callable:
    def run(spark, d):
        a, b = items(spark, d), zones(spark, d)
        l_cells = partition.make_cells(a, left, 48)
        r_cells = partition.make_cells(b, right, 48) if right else None
        pairs = join.spatial_join(a, b, "intersects", method, left_cells=l_cells, right_cells=r_cells)
        return pairs.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("item").alias("items"), F.sum("l_quantity").alias("quantity"))

    run.__name__ = f"join_{method}"
    return run


query(_ZONE_JOIN)(_cell_join("dj", "rsgrove", "kdtree"))
query(_ZONE_JOIN)(_cell_join("repj", "str", None))

_MEET = "a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"
_INNER = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
_HOLDS = "a.x1 <= b.x1 AND b.x2 <= a.x2 AND a.y1 <= b.y1 AND b.y2 <= a.y2"
_HELD = "b.x1 <= a.x1 AND a.x2 <= b.x2 AND b.y1 <= a.y1 AND a.y2 <= b.y2"


@query(f"SELECT a.p_partkey AS l_id, b.p_partkey AS r_id FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.p_partkey < b.p_partkey AND {_MEET}")
def self_join(spark, d):
    return join.self_join(boxes(spark, d), "p_partkey").select(F.col("l_p_partkey").alias("l_id"), F.col("r_p_partkey").alias("r_id"))


_PREDICATE_SQL = {
    "contains": _HOLDS, "within": _HELD, "covers": _HOLDS, "coveredby": _HELD, "touches": f"{_MEET} AND NOT ({_INNER})", "overlaps": f"{_INNER} AND NOT ({_HOLDS}) AND NOT ({_HELD})",
    "equals": "a.x1 = b.x1 AND a.x2 = b.x2 AND a.y1 = b.y1 AND a.y2 = b.y2", "mbrintersects": _MEET,
}


def _predicate_join(name: str) -> Callable:
    def run(spark, d):
        pairs = join.spatial_join(boxes(spark, d), boxes(spark, d), name, "pbsm")
        return pairs.select(F.col("l_p_partkey").alias("l_id"), F.col("r_p_partkey").alias("r_id"))

    run.__name__ = f"join_{name}"
    return run


for _name, _sql in _PREDICATE_SQL.items():
    if _name == "touches":
        continue
    query(f"SELECT a.p_partkey AS l_id, b.p_partkey AS r_id FROM ({_BOXES}) a JOIN ({_BOXES}) b ON {_sql}")(_predicate_join(_name))


def crowded(spark: SparkSession, d: str) -> DataFrame:
    """Part boxes on a small grid, where many touch."""
    x1, y1 = F.expr("(p_partkey * 7919) % 150"), F.expr("(p_partkey * 104729) % 150")
    return _read(spark, d, "part").select("p_partkey", st.st_makebox(x1, y1, x1 + F.expr("p_partkey % 3 + 1"), y1 + F.expr("p_partkey % 2 + 1")).alias("geom"))


_CROWDED = "SELECT p_partkey, (p_partkey * 7919) % 150 AS x1, (p_partkey * 104729) % 150 AS y1, (p_partkey * 7919) % 150 + p_partkey % 3 + 1 AS x2, (p_partkey * 104729) % 150 + p_partkey % 2 + 1 AS y2 FROM part"


@query(f"SELECT a.p_partkey AS l_id, b.p_partkey AS r_id FROM ({_CROWDED}) a JOIN ({_CROWDED}) b ON {_PREDICATE_SQL['touches']}")
def join_touches(spark, d):
    pairs = join.spatial_join(crowded(spark, d), crowded(spark, d), "touches", "pbsm")
    return pairs.select(F.col("l_p_partkey").alias("l_id"), F.col("r_p_partkey").alias("r_id"))


def streets(spark: SparkSession, d: str) -> DataFrame:
    """Level lines from the suppliers, half a unit above whole numbers."""
    t = _read(spark, d, "supplier").selectExpr("s_suppkey", "double((s_suppkey * 613) % 900) AS x", "(s_suppkey * 389) % 1000 + 0.5D AS y", "double(s_suppkey % 60 + 5) AS w")
    return t.select("s_suppkey", st.st_createline(F.array("x", "y", F.col("x") + F.col("w"), "y")).alias("geom"))


_STREETS = "SELECT s_suppkey, (s_suppkey * 613) % 900 AS x1, (s_suppkey * 389) % 1000 + 0.5 AS y, (s_suppkey * 613) % 900 + s_suppkey % 60 + 5 AS x2 FROM supplier"


@query(f"SELECT s_suppkey, p_partkey FROM ({_STREETS}) s JOIN ({_BOXES}) b ON s.y > b.y1 AND s.y < b.y2 AND s.x1 < b.x2 AND s.x2 > b.x1 AND (s.x1 < b.x1 OR s.x2 > b.x2)")
def join_crosses(spark, d):
    return join.spatial_join(streets(spark, d), boxes(spark, d), "crosses", "broadcast").select("s_suppkey", "p_partkey")


@query(f"SELECT a.p_partkey AS l_id, b.p_partkey AS r_id FROM ({_CROWDED}) a JOIN ({_CROWDED}) b ON a.p_partkey < b.p_partkey AND {_PREDICATE_SQL['equals']}")
def join_orderingequals(spark, d):
    return join.self_join(crowded(spark, d), "p_partkey", "orderingequals").select(F.col("l_p_partkey").alias("l_id"), F.col("r_p_partkey").alias("r_id"))


query(_ZONE_JOIN)(_zone_join("inlj"))


@query(f"SELECT a.s_suppkey AS l_id, count(*) AS n FROM ({_ZONES}) a JOIN ({_ZONES}) b ON NOT ({_MEET}) GROUP BY a.s_suppkey")
def join_disjoint(spark, d):
    pairs = join.spatial_join(zones(spark, d), zones(spark, d), "disjoint")
    return pairs.groupBy(F.col("l_s_suppkey").alias("l_id")).agg(F.count("*").alias("n"))


@query(f"SELECT a.c_custkey AS l_id, b.c_custkey AS r_id FROM ({_PLACES}) a JOIN ({_PLACES}) b ON a.c_custkey < b.c_custkey AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225")
def join_within_distance(spark, d):
    return join.self_join(places(spark, d), "c_custkey", "withindistance", distance=15.0).select(F.col("l_c_custkey").alias("l_id"), F.col("r_c_custkey").alias("r_id"))


_BOX_PLACE = "p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2"


@query(f"SELECT c_custkey, p_partkey FROM ({_PLACES}) p LEFT JOIN ({_BOXES}) b ON {_BOX_PLACE}")
def join_left(spark, d):
    return join.spatial_join(places(spark, d), boxes(spark, d), how="left").select("c_custkey", "p_partkey")


@query(f"SELECT c_custkey FROM ({_PLACES}) p WHERE EXISTS (SELECT 1 FROM ({_BOXES}) b WHERE {_BOX_PLACE})")
def join_semi(spark, d):
    return join.spatial_join(places(spark, d), boxes(spark, d), how="semi").select("c_custkey")


@query(f"SELECT c_custkey FROM ({_PLACES}) p WHERE NOT EXISTS (SELECT 1 FROM ({_BOXES}) b WHERE {_BOX_PLACE})")
def join_anti(spark, d):
    return join.spatial_join(places(spark, d), boxes(spark, d), how="anti").select("c_custkey")


@query(
    f"""SELECT s_suppkey AS driver_id, 0 AS source, list(p_partkey ORDER BY p_partkey) AS ids FROM (SELECT s_suppkey, (s_suppkey * 13) % 900 AS x1, (s_suppkey * 17) % 900 AS y1 FROM supplier) s
    JOIN ({_BOXES}) b ON b.x1 <= s.x1 + 50 AND s.x1 <= b.x2 AND b.y1 <= s.y1 + 50 AND s.y1 <= b.y2 GROUP BY s_suppkey
    UNION ALL SELECT s_suppkey, 1, list(c_custkey ORDER BY c_custkey) FROM (SELECT s_suppkey, (s_suppkey * 13) % 900 AS x1, (s_suppkey * 17) % 900 AS y1 FROM supplier) s
    JOIN ({_PLACES}) p ON p.x > s.x1 AND p.x < s.x1 + 50 AND p.y > s.y1 AND p.y < s.y1 + 50 GROUP BY s_suppkey"""
)
def multi_way_join(spark, d):
    x, y = F.expr("(s_suppkey * 13) % 900"), F.expr("(s_suppkey * 17) % 900")
    drivers = _read(spark, d, "supplier").select("s_suppkey", st.st_makebox(x, y, x + 50, y + 50).alias("geom"))
    return join.multi_way_join(drivers, [(boxes(spark, d), "p_partkey", "intersects"), (places(spark, d), "c_custkey", "contains")], "s_suppkey")


@query(
    f"""WITH p AS ({_PLACES}), m AS (SELECT a.c_custkey AS l_id, b.c_custkey AS r_id, CAST(abs(a.x - b.x) + abs(a.y - b.y) AS DOUBLE) AS distance FROM p a JOIN p b ON a.c_custkey < b.c_custkey)
    SELECT * FROM m WHERE distance = (SELECT min(distance) FROM m)"""
)
def closest_pairs(spark, d):
    p = places(spark, d).select("c_custkey", st.st_xmin("geom").alias("x"), st.st_ymin("geom").alias("y"))
    return join.closest_pairs(p, "c_custkey", "x", "y")


@query(
    f"""SELECT s_suppkey AS left_id, c_custkey AS right_id, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))::DOUBLE AS distance, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), c_custkey) AS INTEGER) AS rank
    FROM ({_PLACES}) p CROSS JOIN (SELECT s_suppkey, (s_suppkey * 613) % 1200 - 100 AS sx, (s_suppkey * 389) % 1200 - 100 AS sy FROM supplier) s QUALIFY rank <= 5"""
)
def nearest_places(spark, d):
    s = _read(spark, d, "supplier").select("s_suppkey", st.st_point(F.expr("(s_suppkey * 613) % 1200 - 100"), F.expr("(s_suppkey * 389) % 1200 - 100")).alias("geom"))
    return join.knn_join(s, places(spark, d), 5, "s_suppkey", "c_custkey")


# --- synopses -----------------------------------------------------------------------------------------


@query(f"SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, count(*) AS num_features, count(*) AS num_nonempty, count(*) AS num_points, count(*) * 80 AS size, 0.0::DOUBLE AS sum_x, 0.0::DOUBLE AS sum_y, 0.0::DOUBLE AS sum_area, 'POINT' AS kind FROM ({_ITEMS})")
def summary(spark, d):
    return synopses.summary(items(spark, d), simple=True)


_CENTRES = f"SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM ({_BOXES})"


@query(
    f"""SELECT i0, i1, min(greatest(x1, i0 * 32.0))::DOUBLE AS xmin, min(greatest(y1, i1 * 32.0))::DOUBLE AS ymin, max(least(x2, (i0 + 1) * 32.0))::DOUBLE AS xmax, max(least(y2, (i1 + 1) * 32.0))::DOUBLE AS ymax,
    count(*) AS num_features, count(*) AS num_nonempty, count(*) * 5 AS num_points, count(*) * 96 AS size, sum(least(x2, (i0 + 1) * 32.0) - greatest(x1, i0 * 32.0))::DOUBLE AS sum_x,
    sum(least(y2, (i1 + 1) * 32.0) - greatest(y1, i1 * 32.0))::DOUBLE AS sum_y, sum((least(x2, (i0 + 1) * 32.0) - greatest(x1, i0 * 32.0)) * (least(y2, (i1 + 1) * 32.0) - greatest(y1, i1 * 32.0)))::DOUBLE AS sum_area
    FROM (SELECT *, CAST(floor(cx / 32) AS BIGINT) AS i0, CAST(floor(cy / 32) AS BIGINT) AS i1 FROM ({_CENTRES})) GROUP BY i0, i1"""
)
def gridded_summary(spark, d):
    return synopses.gridded_summary(boxes(spark, d), BOX_GRID)


_CELL = "CAST(floor(x * 64 / 110000.0) AS BIGINT) AS col, CAST(floor(y * 32 / 64.0) AS BIGINT) AS row"


@query(f"SELECT col, row, count(*) AS value FROM (SELECT {_CELL} FROM ({_ITEMS})) GROUP BY col, row")
def uniform_histogram(spark, d):
    return synopses.uniform_histogram(items(spark, d), ITEM_GRID)


@query(f"SELECT col, row, sum(l_quantity) AS value FROM (SELECT l_quantity, {_CELL} FROM ({_ITEMS})) GROUP BY col, row")
def value_histogram(spark, d):
    return synopses.uniform_histogram(items(spark, d), ITEM_GRID, value=F.col("l_quantity"))


_ALL_CELLS = f"SELECT c.col, r.row, coalesce(value, 0) AS value FROM (SELECT unnest(range(64)) AS col) c CROSS JOIN (SELECT unnest(range(32)) AS row) r LEFT JOIN (SELECT col, row, count(*) AS value FROM (SELECT {_CELL} FROM ({_ITEMS})) GROUP BY col, row) h USING (col, row)"


@query(f"SELECT col, row, value, CAST(sum(across) OVER (PARTITION BY col ORDER BY row) AS BIGINT) AS prefix FROM (SELECT *, sum(value) OVER (PARTITION BY row ORDER BY col) AS across FROM ({_ALL_CELLS}))")
def prefix_histogram(spark, d):
    return synopses.prefix_sums(synopses.uniform_histogram(items(spark, d), ITEM_GRID, zeros=True))


@query(f"SELECT count(*) AS value FROM (SELECT {_CELL} FROM ({_ITEMS})) WHERE col BETWEEN 10 AND 29 AND row BETWEEN 4 AND 15")
def rectangle_sum(spark, d):
    return synopses.rectangle_sum(prefix_histogram(spark, d), 10, 4, 20, 12)


_SPANS = f"SELECT least(floor(x1 / 32), 31)::BIGINT AS a, least(floor(x2 / 32), 31)::BIGINT AS b, least(floor(y1 / 32), 31)::BIGINT AS c, least(floor(y2 / 32), 31)::BIGINT AS d FROM ({_BOXES})"


@query(
    f"""SELECT col, row, count(*) AS c1, count(*) FILTER (col = a) AS c2, count(*) FILTER (row = c) AS c3, count(*) FILTER (col = a AND row = c) AS c4
    FROM (SELECT *, unnest(range(c, d + 1)) AS row FROM (SELECT *, unnest(range(a, b + 1)) AS col FROM ({_SPANS}))) GROUP BY col, row"""
)
def euler_histogram(spark, d):
    return synopses.euler_histogram(boxes(spark, d), BOX_GRID)


@query(f"SELECT count(*) AS value FROM ({_SPANS}) WHERE a <= 19 AND b >= 5 AND c <= 24 AND d >= 8")
def euler_count(spark, d):
    return synopses.euler_count(synopses.euler_histogram(boxes(spark, d), BOX_GRID), 5, 8, 15, 17)


@query(
    f"""WITH l AS (SELECT unnest(range(6)) AS level), s AS (SELECT level, least(floor(x1 * (1 << level) / 1024.0), (1 << level) - 1)::BIGINT AS a, least(floor(x2 * (1 << level) / 1024.0), (1 << level) - 1)::BIGINT AS b,
    least(floor(y1 * (1 << level) / 1024.0), (1 << level) - 1)::BIGINT AS c, least(floor(y2 * (1 << level) / 1024.0), (1 << level) - 1)::BIGINT AS d FROM ({_BOXES}) CROSS JOIN l),
    v AS (SELECT level, col, row, count(*) AS v FROM (SELECT level, col, unnest(range(c, d + 1)) AS row FROM (SELECT *, unnest(range(a, b + 1)) AS col FROM s)) GROUP BY level, col, row)
    SELECT CAST(level AS INTEGER) AS level, CAST(sum(v * v) AS DOUBLE) AS total, 1024.0::DOUBLE / (1 << level) AS side FROM v GROUP BY level"""
)
def box_counting(spark, d):
    return synopses.box_counts(boxes(spark, d), BOX_GRID, 5, 2)


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, true AS inside FROM (SELECT * FROM ({_ITEMS}) LIMIT 1000)")
def point_sample(spark, d):
    """A sampling operator: 1000 of the points."""
    s = synopses.point_sample(items(spark, d), 1000, 7)
    return s.agg(F.count("*").alias("n"), F.min(ITEM_GRID.inside(F.col("x"), F.col("y"))).alias("inside"))


# --- partitioners -------------------------------------------------------------------------------------


@query(f"SELECT CAST(floor(cx * 8 / 1024) + 8 * floor(cy * 8 / 1024) AS INTEGER) AS cell_id, count(*) AS n FROM ({_CENTRES}) GROUP BY 1")
def grid_partition(spark, d):
    cells = partition.grid_cells(Grid(0.0, 0.0, 1024.0, 1024.0, 8, 8))
    return partition.spatial_partition(boxes(spark, d), cells, replicate=False).groupBy("cell_id").agg(F.count("*").alias("n"))


@query(
    f"""SELECT CAST(c + 8 * r AS INTEGER) AS cell_id, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS parts FROM (SELECT *, unnest(range(CAST(floor(y1 / 128) AS BIGINT), CAST(floor(y2 / 128) AS BIGINT) + 1)) AS r
    FROM (SELECT *, unnest(range(CAST(floor(x1 / 128) AS BIGINT), CAST(floor(x2 / 128) AS BIGINT) + 1)) AS c FROM ({_BOXES}))) GROUP BY 1"""
)
def grid_copies(spark, d):
    """Every record in every cell that it meets; cells hold their lower borders."""
    cells = partition.grid_cells(Grid(0.0, 0.0, 1024.0, 1024.0, 8, 8))
    return partition.spatial_partition(boxes(spark, d), cells).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("parts"))


@query(f"SELECT p_partkey, x1::DOUBLE AS xmin, y2::DOUBLE AS ymax FROM ({_BOXES}) WHERE x1 <= 420 AND x2 >= 300 AND y1 <= 260 AND y2 >= 100")
def index_scan(spark, d):
    """A part of a written index: cells by the manifest, rows by their bounds, copies dropped."""
    df = boxes(spark, d)
    cells, path = partition.make_cells(df, "kdtree", 12), Folder(df, "index").path
    partition.write_index(df, path, cells, simple=True)
    found = partition.read_index(spark, path, (300.0, 100.0, 420.0, 260.0), cells)
    return found.select("p_partkey", st.st_xmin("geom").alias("xmin"), st.st_ymax("geom").alias("ymax"))


def _partitioned(name: str) -> Callable:
    """Rows, the sum of their keys, the rows whose own cell holds their smaller corner (or centre), and whether no cell is over-full."""

    def run(spark, d):
        df = boxes(spark, d)
        cells = partition.make_cells(df, name, 16)
        placed = partition.spatial_partition(df, cells)
        placed = partition.without_copies(placed, cells) if cells.disjoint else placed
        bounds = spark.createDataFrame(cells.bounds, "cell_id int, x1 double, y1 double, x2 double, y2 double")
        x, y = (F.col("geom.xmin"), F.col("geom.ymin")) if cells.disjoint else ((F.col("geom.xmin") + F.col("geom.xmax")) / 2, (F.col("geom.ymin") + F.col("geom.ymax")) / 2)
        grown = 0.0 if cells.disjoint else 1100.0 if cells.curve is None else 0.0
        inside = (x >= F.col("x1") - grown) & (x <= F.col("x2") + grown) & (y >= F.col("y1") - grown) & (y <= F.col("y2") + grown)
        loads = placed.join(F.broadcast(bounds), "cell_id").groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("parts"), F.sum(inside.cast("long")).alias("inside"))  # 16 cells
        return loads.agg(F.sum("n").alias("n"), F.sum("parts").alias("parts"), F.sum("inside").alias("inside"), (F.max("n") * 4 < F.sum("n") * 3).alias("balanced"))

    run.__name__ = f"partition_{name}"
    return run


for _name in partition.PARTITIONERS:
    query("SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS parts, count(*) AS inside, true AS balanced FROM part")(_partitioned(_name))

_SPREAD = " | ".join(f"(((v >> {b}) & 1) << {2 * b})" for b in range(10))


@query(f"SELECT c_custkey, CAST(({_SPREAD.replace('v', 'x')}) | (({_SPREAD.replace('v', 'y')}) << 1) AS BIGINT) AS z FROM ({_PLACES})")
def z_curve(spark, d):
    return places(spark, d).select("c_custkey", partition.z_key(F.col("geom.xmin").cast("long"), F.col("geom.ymin").cast("long")).alias("z"))


def _hilbert_sql(bits: int) -> str:
    """One level of the curve a subquery, from the highest bit."""
    q = f"SELECT c_custkey, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, 0::BIGINT AS h FROM ({_PLACES})"
    for b in range(bits - 1, -1, -1):
        side = 1 << b
        q = f"SELECT *, CASE WHEN x & {side} > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & {side} > 0 THEN 1 ELSE 0 END AS ry FROM ({q})"
        flip = lambda v: f"CASE WHEN ry = 0 AND rx = 1 THEN {side - 1} - ({v} & {side - 1}) ELSE {v} & {side - 1} END"  # noqa: E731, B023
        q = f"SELECT c_custkey, h + {side * side}::BIGINT * xor(3 * rx, ry) AS h, ry, {flip('x')} AS u, {flip('y')} AS v FROM ({q})"
        q = f"SELECT c_custkey, h, CASE WHEN ry = 0 THEN v ELSE u END AS x, CASE WHEN ry = 0 THEN u ELSE v END AS y FROM ({q})"
    return f"SELECT c_custkey, h FROM ({q})"


@query(_hilbert_sql(10))
def hilbert_curve(spark, d):
    return places(spark, d).select("c_custkey", partition.hilbert_key(F.col("geom.xmin").cast("long"), F.col("geom.ymin").cast("long"), 10).alias("h"))


# --- measures, vector analysis ------------------------------------------------------------------------


@query(f"SELECT p_partkey, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area, CAST(2 * (x2 - x1 + y2 - y1) AS DOUBLE) AS length, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, 5 AS points FROM ({_BOXES})")
def measures(spark, d):
    """The kernel's measures over WKB polygons, not the native ones of boxes."""
    g = boxes(spark, d).select("p_partkey", st.st_fromwkb(st.st_towkb(F.col("geom"))).alias("geom"))
    c = st.st_centroid("geom")
    return g.select("p_partkey", st.st_area("geom").alias("area"), st.st_length("geom").alias("length"), c["xmin"].alias("cx"), c["ymin"].alias("cy"), st.st_numpoints("geom").alias("points"))


@query(
    """WITH v AS (SELECT o_orderkey, 1000 + (o_orderkey * 31) % 500 AS x0, (o_orderkey * 17) % 500 AS y0, o_orderkey % 40 + 10 AS a, o_orderkey % 30 + 10 AS b FROM orders)
    SELECT o_orderkey, CAST(a * b / 2.0 AS DOUBLE) AS area, round(a + b + sqrt(a * a + b * b), 6) AS length, round(x0 + a / 3.0, 6)::DOUBLE AS cx, round(y0 + b / 3.0, 6)::DOUBLE AS cy FROM v"""
)
def polygon_measures(spark, d):
    """Triangles built from coordinate arrays."""
    v = _read(spark, d, "orders").selectExpr("o_orderkey", "1000 + (o_orderkey * 31) % 500 AS x0", "(o_orderkey * 17) % 500 AS y0", "o_orderkey % 40 + 10 AS a", "o_orderkey % 30 + 10 AS b")
    coords = F.expr("transform(array(x0, y0, x0 + a, y0, x0, y0 + b, x0, y0), v -> double(v))")
    t = v.select("o_orderkey", st.st_createpolygon(coords).alias("geom"))
    c = st.st_centroid("geom")
    return t.select("o_orderkey", st.st_area("geom").alias("area"), F.round(st.st_length("geom"), 6).alias("length"), F.round(c["xmin"], 6).alias("cx"), F.round(c["ymin"], 6).alias("cy"))


@query(f"SELECT a.p_partkey AS left_id, b.s_suppkey AS right_id, CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS area FROM ({_BOXES}) a JOIN (SELECT s_suppkey, (s_suppkey * 13) % 900 AS x1, (s_suppkey * 17) % 900 AS y1, (s_suppkey * 13) % 900 + 60 AS x2, (s_suppkey * 17) % 900 + 40 AS y2 FROM supplier) b ON {_INNER}")
def overlay_intersection(spark, d):
    x, y = F.expr("(s_suppkey * 13) % 900"), F.expr("(s_suppkey * 17) % 900")
    s = _read(spark, d, "supplier").select("s_suppkey", st.st_makebox(x, y, x + 60, y + 40).alias("geom"))
    out = vector.overlay(boxes(spark, d), s, "p_partkey", "s_suppkey")
    return out.select("left_id", "right_id", F.round(st.st_area("geom", simple=True), 6).alias("area")).where("area > 0")  # boxes that share an area share a box


_CLUSTERED = "SELECT s_suppkey AS id, (s_suppkey * 37) % 200 AS x1, (s_suppkey * 53) % 200 AS y1, (s_suppkey * 37) % 200 + s_suppkey % 5 + 3 AS x2, (s_suppkey * 53) % 200 + s_suppkey % 7 + 3 AS y2 FROM supplier"


def _clustered(spark, d):
    x, y = F.expr("(s_suppkey * 37) % 200"), F.expr("(s_suppkey * 53) % 200")
    return _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), st.st_makebox(x, y, x + F.expr("s_suppkey % 5 + 3"), y + F.expr("s_suppkey % 7 + 3")).alias("geom"))


@query(
    f"""WITH RECURSIVE b AS ({_CLUSTERED}), e AS (SELECT a.id AS u, b.id AS v FROM b a JOIN b ON {_MEET}),
    r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT component, count(*) AS members FROM (SELECT u, min(v) AS component FROM r GROUP BY u) GROUP BY component"""
)
def dissolve_groups(spark, d):
    return vector.dissolve(_clustered(spark, d), "id").select("component", "members")


@query(
    f"""WITH RECURSIVE b AS ({_CLUSTERED}), e AS (SELECT a.id AS u, b.id AS v FROM b a JOIN b ON {_MEET}),
    r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), c AS (SELECT u, min(v) AS component FROM r GROUP BY u)
    SELECT component, count(DISTINCT 10000 * cx + cy)::DOUBLE AS area FROM (SELECT component, cx, unnest(range(y1, y2)) AS cy FROM (SELECT component, y1, y2, unnest(range(x1, x2)) AS cx FROM b JOIN c ON b.id = c.u)) GROUP BY component"""
)
def dissolve_area(spark, d):
    return vector.dissolve(_clustered(spark, d), "id").select("component", F.round(st.st_area("geom"), 6).alias("area"))


@query()
def buffer_dissolve(spark, d):
    some = places(spark, d)
    return vector.buffer_dissolve(some, "c_custkey", 6.0).select("component", "members", F.round(st.st_area("geom"), 4).alias("area"))


@query("SELECT c_custkey, round(c_acctbal / 100.0 * pi() / 180 * 6378137.0, 4) AS mx, round(ln(tan(pi() / 4 + (c_nationkey * 3 - 30) * pi() / 360)) * 6378137.0, 4) AS my FROM customer WHERE c_acctbal / 100.0 BETWEEN -180 AND 180")
def reproject(spark, d):
    t = _read(spark, d, "customer").where("c_acctbal / 100.0 between -180 and 180")
    mx, my = geodesic.mercator_x(F.col("c_acctbal") / 100.0), geodesic.mercator_y(F.col("c_nationkey") * 3.0 - 30)
    return t.select("c_custkey", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


@query()
def quad_split(spark, d):
    g = generators.generate(spark, "uniform", 50, 3, (0.0, 0.0, 100.0, 100.0), "polygon", (20.0, 20.0), (40, 80))
    return g.select("id", F.explode(st.st_quadsplit("geom", 16)).alias("p")).groupBy("id").agg(F.count("*").alias("parts"), F.max(st.st_numpoints("p")).alias("most"))


# --- trajectories -------------------------------------------------------------------------------------


def _tracks(spark, d):
    return _read(spark, d, "events").selectExpr("user_id", "ts", "event_id", "value / 10 AS lng", "(event_id % 600) / 10 - 30 AS lat")


_TRACKS = "SELECT user_id, ts, event_id, value / 10 AS lng, (event_id % 600) / 10.0 - 30 AS lat FROM events"
_KM = "CASE WHEN plng IS NOT NULL THEN 2 * 6371.0087714 * asin(least(1.0, sqrt(power(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin((radians(lng) - radians(plng)) / 2), 2)))) END"


@query(
    f"""SELECT user_id, count(*) AS num_points, min(lng) AS xmin, max(lng) AS xmax, round(min(lat), 6)::DOUBLE AS ymin, round(max(lat), 6)::DOUBLE AS ymax, round(coalesce(sum({_KM}), 0), 4) AS length_km,
    round(coalesce(sum({_KM}), 0) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600), 4) AS speed_kmh
    FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM ({_TRACKS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, lng, lat)) GROUP BY user_id"""
)
def trajectory_features(spark, d):
    f = trajectory.features(_tracks(spark, d), "user_id", "ts")
    return f.select("user_id", "num_points", "xmin", "xmax", F.round("ymin", 6).alias("ymin"), F.round("ymax", 6).alias("ymax"), F.round("length_km", 4).alias("length_km"), F.round("speed_kmh", 4).alias("speed_kmh"))


@query(
    f"""WITH s AS (SELECT *, CASE WHEN plng IS NULL OR {_KM} > 500 THEN 1 ELSE 0 END AS far FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM ({_TRACKS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, lng, lat))),
    r AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts, lng, lat ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT user_id, count(*) AS num_points, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS stay_s FROM r GROUP BY user_id, run HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 1200"""
)
def stay_points(spark, d):
    return trajectory.stay_points(_tracks(spark, d), "user_id", "ts", radius_km=500.0).select("user_id", "num_points", F.round("stay_s", 6).alias("stay_s"))


# --- tiles --------------------------------------------------------------------------------------------


def _tile_sql(z: int) -> str:
    n, w = 1 << z, 1024.0 / (1 << z)
    col = lambda c: f"least(floor({c} / {w}), {n - 1})::BIGINT"
    spans = f"SELECT {col('x1')} AS a, {col('x2')} AS b, {n - 1} - {col('y2')} AS c, {n - 1} - {col('y1')} AS d FROM ({_BOXES})"
    return f"SELECT ({z}::BIGINT << 52) | (col << 26) | row AS tile, count(*) AS count FROM (SELECT col, unnest(range(c, d + 1)) AS row FROM (SELECT *, unnest(range(a, b + 1)) AS col FROM ({spans}))) GROUP BY col, row"


@query(" UNION ALL ".join(_tile_sql(z) for z in (0, 3, 6)))
def tile_counts(spark, d):
    return tiles.tile_counts(boxes(spark, d), AREA, [0, 3, 6])


_POINT_TILE = "(({z}::BIGINT << 52) | ((x * {n} // 1024) << 26) | ({n} - 1 - y * {n} // 1024))"


@query(" UNION ALL ".join(f"SELECT {_POINT_TILE.format(z=z, n=1 << z)} AS tile, count(*) AS count FROM ({_PLACES}) GROUP BY 1" for z in range(3, 7)))
def tile_pyramid(spark, d):
    return tiles.pyramid_counts(tiles.tile_counts(places(spark, d), AREA, [6]), 3)


@query(f"SELECT x * 64 // 1024 AS px, 63 - y * 64 // 1024 AS py, count(*) AS count FROM ({_PLACES}) GROUP BY 1, 2")
def pixel_counts(spark, d):
    return tiles.pixel_counts(places(spark, d), AREA, 64, 64)


@query()
def image_pyramid(spark, d):
    return tiles.plot_pyramid(places(spark, d), AREA, [0, 1, 2], 64).select("tile", F.length("png").alias("bytes"))


@query()
def vector_tiles(spark, d):
    return tiles.vector_tiles(boxes(spark, d), AREA, [0, 2], attributes=["p_partkey"]).select("tile", "part", F.length("mvt").alias("bytes"))


# --- generators and formats ---------------------------------------------------------------------------


#: Mean and spread of x over the unit square, and the tolerance of 5,000 draws; parcels fill it evenly.
_MOMENTS = {"uniform": (0.5, 0.2887), "diagonal": (0.5, 0.288), "gaussian": (0.5, 0.1), "bit": (0.2, 0.231), "sierpinski": (0.5, 0.236), "parcel": (0.5, None)}


def _generated(name: str) -> Callable:
    """Distinct ids, and whether the first two moments of the centres are those of the distribution, the same from any partitioning."""

    def run(spark, d):
        g = generators.generate(spark, name, 5000, 42, shape="box")
        x = (F.col("geom.xmin") + F.col("geom.xmax")) / 2
        mean, spread = _MOMENTS[name]
        near = lambda c, v: F.lit(True) if v is None else F.abs(c - v) < 0.02
        apart = g.repartition(7).agg(F.sum(F.round(x * 1e6).cast("long"))).first()[0]
        same = F.sum(F.round(x * 1e6).cast("long")) == F.lit(apart)
        return g.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), near(F.avg(x), mean).alias("mean"), near(F.stddev(x), spread).alias("spread"), (F.countDistinct(x) > 100).alias("varied"), same.alias("stable"))

    run.__name__ = f"generate_{name}"
    return run


for _name in generators.DISTRIBUTIONS:
    query("SELECT 5000::BIGINT AS n, 5000::BIGINT AS ids, true AS mean, true AS spread, true AS varied, true AS stable")(_generated(_name))


@query(f"SELECT p_partkey, 'POLYGON ((' || x1 || ' ' || y1 || ', ' || x2 || ' ' || y1 || ', ' || x2 || ' ' || y2 || ', ' || x1 || ' ' || y2 || ', ' || x1 || ' ' || y1 || '))' AS wkt FROM ({_BOXES})")
def wkt_codec(spark, d):
    g = boxes(spark, d).select("p_partkey", st.st_fromwkt(st.st_astext(F.col("geom"))).alias("geom"))
    return g.select("p_partkey", st.st_astext("geom").alias("wkt"))


@query(f"SELECT p_partkey, x1::DOUBLE AS xmin, y2::DOUBLE AS ymax FROM ({_BOXES})")
def spatial_parquet_codec(spark, d):
    g = boxes(spark, d).select("p_partkey", st.st_fromspatialparquet(st.st_tospatialparquet(F.col("geom"))).alias("geom"))
    return g.select("p_partkey", st.st_xmin("geom").alias("xmin"), st.st_ymax("geom").alias("ymax"))


_BOUNDS = f"SELECT p_partkey, x1::DOUBLE AS xmin, y1::DOUBLE AS ymin, x2::DOUBLE AS xmax, y2::DOUBLE AS ymax FROM ({_BOXES})"


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), *[F.col(f"geom.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _round_trip(name: str, write: dict, read: dict, format: str) -> Callable:  # noqa: A002
    """Boxes written in a format and read back."""

    def run(spark, d):
        df = boxes(spark, d)
        path = Folder(df, f"sink-{name}").path
        facade.write_spatial(df, path, format, **write)
        back = facade.read_spatial(spark, path, **({"format": format} | read))
        return _bounds(back.withColumnRenamed("_c4", "p_partkey").withColumnRenamed("_c1", "p_partkey"))

    run.__name__ = f"round_trip_{name}"
    return run


for _name, _write, _readback, _format in (
    ("csv_envelope", {"encoder": "envelope", "separator": ","}, {"spec": "envelope(0,1,2,3)"}, "csv"), ("csv_wkt", {"encoder": "wkt"}, {"spec": "wkt(0)", "separator": "\t"}, "csv"),
    ("json_wkt", {}, {}, "jsonwkt"), ("geojson", {}, {"properties": "p_partkey long"}, "geojson"), ("geoparquet", {}, {}, "geoparquet"), ("spatialparquet", {}, {}, "spatialparquet"),
):
    query(_BOUNDS)(_round_trip(_name, _write, _readback, _format))


@query(f"SELECT c_custkey, x::DOUBLE AS x, y::DOUBLE AS y FROM ({_PLACES})")
def round_trip_csv_points(spark, d):
    """Points with a header, whose columns the reader finds by itself."""
    df = places(spark, d)
    path = Folder(df, "sink-points").path
    facade.write_spatial(df, path, "csv", encoder="point", separator=",", header=True)
    back = facade.read_spatial(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), st.st_xmin("geom").alias("x"), st.st_ymin("geom").alias("y"))


@query(_BOUNDS)
def round_trip_shapefile(spark, d):
    """Zipped shapefiles, one for every partition, read back."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("p_partkey", T.LongType())])
    return _bounds(binary.read_shapefile_parts(binary.shapefile_parts(boxes(spark, d)), schema))


@query(f"SELECT p_partkey, x1::DOUBLE AS xmin, y2::DOUBLE AS ymax FROM ({_BOXES})")
def geojson_codec(spark, d):
    g = boxes(spark, d).select("p_partkey", st_fromgeojson(st_asgeojson(F.col("geom"))).alias("geom"))
    return g.select("p_partkey", st.st_xmin("geom").alias("xmin"), st.st_ymax("geom").alias("ymax"))


# --- functions ----------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS hull, CAST(2 * (x2 - x1 + y2 - y1) AS DOUBLE) AS border, 'LINESTRING' AS border_kind, true AS rectangle, true AS valid, 1 AS parts, 2 AS dimension, 4326 AS srid, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS reversed, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS normed FROM ({_BOXES})")
def shape_functions(spark, d):
    g = boxes(spark, d).select("p_partkey", st.st_fromwkb(st.st_towkb(F.col("geom"))).alias("geom"))
    b = st.st_boundary("geom")
    return g.select(
        "p_partkey", st.st_area(st.st_convexhull("geom")).alias("hull"), st.st_length(b).alias("border"), st.st_geometrytype(b).alias("border_kind"), st.st_isrectangle("geom").alias("rectangle"), st.st_isvalid("geom").alias("valid"),
        st.st_numgeometries("geom").alias("parts"), st.st_dimension("geom").alias("dimension"), st.st_srid("geom").alias("srid"), st.st_area(st.st_reverse("geom")).alias("reversed"), st.st_area(st.st_norm("geom")).alias("normed"),
    )


_PAIR = "SELECT s_suppkey, s_suppkey % 7 + 2 AS w, s_suppkey % 5 + 2 AS h, s_suppkey % 3 + 1 AS dx, s_suppkey % 2 + 1 AS dy FROM supplier"
_SHARED = "greatest(0, w - dx) * greatest(0, h - dy)"


@query(f"SELECT s_suppkey, ({_SHARED})::DOUBLE AS shared, (2 * w * h - {_SHARED})::DOUBLE AS joined, (w * h - {_SHARED})::DOUBLE AS rest, (2 * (w * h - {_SHARED}))::DOUBLE AS odd FROM ({_PAIR})")
def set_functions(spark, d):
    """A box and the same one moved, as general polygons."""
    t = _read(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 7 + 2 AS w", "s_suppkey % 5 + 2 AS h", "s_suppkey % 3 + 1 AS dx", "s_suppkey % 2 + 1 AS dy")
    ring = lambda x, y: F.array(*[c.cast("double") for c in (x, y, x + F.col("w"), y, x + F.col("w"), y + F.col("h"), x, y + F.col("h"), x, y)])
    g = t.select("s_suppkey", st.st_createpolygon(ring(F.lit(0), F.lit(0))).alias("a"), st.st_createpolygon(ring(F.col("dx"), F.col("dy"))).alias("b"))
    size = lambda f, name: F.round(F.coalesce(st.st_area(f("a", "b")), F.lit(0.0)), 6).alias(name)
    return g.select("s_suppkey", size(st.st_intersection, "shared"), size(lambda x, y: st.st_union(F.col(x), F.col(y)), "joined"), size(lambda x, y: st.st_difference(F.col(x), F.col(y)), "rest"), size(lambda x, y: st.st_symdifference(F.col(x), F.col(y)), "odd"))


@query(f"SELECT s_suppkey, CAST(x2 - x1 AS DOUBLE) AS length, 2 AS points, 1::BIGINT AS pieces, 1 AS dimension, 0 AS border_dimension FROM ({_STREETS})")
def line_functions(spark, d):
    g = streets(spark, d)
    return g.select("s_suppkey", st.st_length("geom").alias("length"), st.st_numpoints("geom").alias("points"), F.size(st.st_breakline(F.col("geom"))).cast("long").alias("pieces"), st.st_dimension("geom").alias("dimension"), st.st_boundarydimension("geom").alias("border_dimension"))


_SPOTS = "SELECT c_custkey, c_acctbal / 100.0 AS lng, CAST(c_nationkey * 3 - 30 AS DOUBLE) AS lat FROM customer"
_ANGLE = "2 * asin(least(1.0, sqrt(power(sin((radians(20.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * power(sin((radians(10.0) - radians(lng)) / 2), 2))))"


@query(
    f"""SELECT c_custkey, round({_ANGLE} * 6371.0087714, 5) AS km, round({_ANGLE} * 6371008.7714, 2) AS m, round(lng * 6371.0087714 * pi() / 180, 6) AS wide, round(lat / (6371.0087714 * pi() / 180), 9) AS narrow,
    round(degrees(asin(sin(radians(lat)) * cos(100 / 6371.0087714) + cos(radians(lat)) * sin(100 / 6371.0087714) * cos(radians(30.0)))), 7) AS north, round(sqrt((lng - 10) * (lng - 10) + (lat - 20) * (lat - 20)), 6) AS planar FROM ({_SPOTS})"""
)
def geodesic_functions(spark, d):
    t = _read(spark, d, "customer").selectExpr("c_custkey", "c_acctbal / 100.0D AS lng", "double(c_nationkey * 3 - 30) AS lat")
    away = geodesic.point_on_bearing("lng", "lat", 30.0, 100.0)
    return t.select(
        "c_custkey", F.round(geodesic.haversine_km("lng", "lat", 10.0, 20.0), 5).alias("km"), F.round(geodesic.distance_in("m", "lng", "lat", 10.0, 20.0), 2).alias("m"), F.round(geodesic.degree_to_km("lng"), 6).alias("wide"),
        F.round(geodesic.km_to_degree("lat"), 9).alias("narrow"), F.round(away["lat"], 7).alias("north"), F.round(geodesic.planar_distance("lng", "lat", 10.0, 20.0), 6).alias("planar"),
    )


@query(f"SELECT c_custkey, abs((300 * (y - 0) - 200 * (x - 0)))::DOUBLE / 2 AS area, CAST(sign(300 * y - 200 * x) AS INTEGER) AS side, 300 * y = 200 * x AND x BETWEEN 0 AND 300 AND y BETWEEN 0 AND 200 AS touching FROM ({_PLACES})")
def planar_functions(spark, d):
    p = places(spark, d).select("c_custkey", st.st_xmin("geom").alias("x"), st.st_ymin("geom").alias("y"))
    line = (0.0, 0.0, 300.0, 200.0, "x", "y")
    return p.select("c_custkey", geodesic.triangle_area(*line).alias("area"), geodesic.side_of_line(*line).alias("side"), geodesic.on_segment(*line).alias("touching"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS shown, o_orderdate = o_orderdate AS back FROM orders")
def date_functions(spark, d):
    from .functions import dates

    t = _read(spark, d, "orders")
    shown = dates.format_time("o_orderdate", "dd/MM/yyyy HH:mm")
    return t.select("o_orderkey", shown.alias("shown"), (dates.parse_time(dates.format_time("o_orderdate", "yyyy-MM-dd HH:mm:ss")) == F.date_trunc("second", "o_orderdate")).alias("back"))


@query("SELECT s_suppkey, true AS utm, true AS ellipsoid, true AS web FROM supplier")
def crs_round_trips(spark, d):
    """Longitude and latitude through other systems and back, to a millionth of a degree; the true place of a UTM zone's middle line."""
    t = _read(spark, d, "supplier").select("s_suppkey", st.st_point(F.expr("double(s_suppkey % 5) + 7"), F.expr("double(s_suppkey % 120) - 60")).alias("geom"))

    def near(srid: int):
        back = vector.reproject(vector.reproject(t, srid), 4326).select("s_suppkey", F.col("geom").alias("back"))
        return t.join(back, "s_suppkey").select("s_suppkey", ((F.abs(F.col("geom.xmin") - F.col("back.xmin")) < 1e-6) & (F.abs(F.col("geom.ymin") - F.col("back.ymin")) < 1e-6)).alias(str(srid)))

    out = near(32632).join(near(3395), "s_suppkey").join(near(3857), "s_suppkey")
    return out.toDF("s_suppkey", "utm", "ellipsoid", "web")


@query(
    f"""SELECT px, py, count(*) AS count FROM (SELECT px, unnest(range(CAST(ceil((1024 - y2) / 8.0 - 0.5) AS BIGINT), CAST(ceil((1024 - y1) / 8.0 - 0.5) AS BIGINT))) AS py FROM (
    SELECT *, unnest(range(CAST(ceil(x1 / 8.0 - 0.5) AS BIGINT), CAST(ceil(x2 / 8.0 - 0.5) AS BIGINT))) AS px FROM ({_BOXES}))) GROUP BY px, py"""
)
def drawn_boxes(spark, d):
    """Pixels whose centres lie in boxes; the picture's y runs downwards, so a centre on an upper edge counts."""
    return canvas.covered_pixels(boxes(spark, d), AREA, 128, 128)


# --- relational ---------------------------------------------------------------------------------------


@query(f"SELECT col, item, rank FROM (SELECT col, item, CAST(row_number() OVER (PARTITION BY col ORDER BY y DESC, item) AS INTEGER) AS rank FROM (SELECT *, CAST(floor(x * 64 / 110000.0) AS BIGINT) AS col FROM ({_ITEMS}))) WHERE rank <= 3")
def top_items_of_columns(spark, d):
    t = items(spark, d).select(ITEM_GRID.column(F.col("geom.xmin")).alias("col"), "item", F.col("geom.ymin").alias("y"))
    return relational.top_by_group(t, ["col"], [F.desc("y"), F.col("item")], 3).select("col", "item", "rank")


def _totals(how: str) -> Callable:
    def run(spark, d):
        t = _read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).alias("band"), "l_quantity")
        return relational.grouped_totals(t, ["l_returnflag", "l_linestatus", "band"], how, F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_quantity").alias("kinds"))

    run.__name__ = f"totals_{how}"
    return run


for _how in ("rollup", "cube"):
    query(f"SELECT l_returnflag, l_linestatus, band, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_quantity) AS kinds FROM (SELECT *, CAST(floor(l_quantity / 10) AS BIGINT) AS band FROM lineitem) GROUP BY {_how.upper()} (l_returnflag, l_linestatus, band)")(_totals(_how))


@query(
    """WITH e AS (SELECT *, event_id % 3 = 0 AS asked FROM events)
    SELECT l.event_id, (SELECT r.event_id FROM e r WHERE NOT r.asked AND r.user_id = l.user_id AND r.ts <= l.ts ORDER BY r.ts DESC, r.event_id DESC LIMIT 1) AS r_event_id FROM e l WHERE l.asked"""
)
def asof_events(spark, d):
    e = _read(spark, d, "events").select("event_id", "user_id", "ts")
    found = relational.asof_join(e.where("event_id % 3 = 0"), e.where("event_id % 3 != 0"), "user_id", "ts", "event_id")
    return found.select("event_id", "r_event_id")


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def event_sessions(spark, d):
    return relational.sessions(_read(spark, d, "events"), "user_id", "ts", "6 hours", F.count("*").alias("n")).select("user_id", "start", "n")


_CELLS_OF = "SELECT DISTINCT CAST(floor(x * 64 / 110000.0) AS BIGINT) AS col, CAST(floor(y * 32 / 64.0) AS BIGINT) AS row FROM"


def _cell_sets(how: str) -> Callable:
    def run(spark, d):
        of = lambda df: df.select(ITEM_GRID.column(F.col("geom.xmin")).alias("col"), ITEM_GRID.row(F.col("geom.ymin")).alias("row"))
        return getattr(of(items(spark, d)), how)(of(zones(spark, d))).distinct()

    run.__name__ = f"cells_{how}"
    return run


for _how, _set in (("intersect", "INTERSECT"), ("subtract", "EXCEPT"), ("union", "UNION")):
    query(f"{_CELLS_OF} ({_ITEMS}) {_set} {_CELLS_OF} (SELECT x1 AS x, y1 AS y FROM ({_ZONES}))")(_cell_sets(_how))
