import math
import re

import pytest
from pyspark.sql import functions as F

from cartospark.functions import geodesic, geometry as G, st
from cartospark.operators import generators, join, partition, synopses, tiles, trajectory, vector
from cartospark.operators.synopses import Grid
from cartospark.plans import explain

R = ["POLYGON((0 0,4 0,4 4,0 4,0 0))", "POINT(1 1)", "POINT(7 7)", "LINESTRING(3 1,9 1)", "POLYGON((8 0,12 0,10 3,8 0))", "POINT(20 20)"]
S = ["POLYGON((2 2,6 2,6 6,2 6,2 2))", "POLYGON((7 -1,13 -1,13 5,7 5,7 -1))", "POLYGON((0.5 0.5,1.5 0.5,1.5 1.5,0.5 1.5,0.5 0.5))"]


def wkt(spark, texts, name):
    return spark.createDataFrame(list(enumerate(texts)), f"{name} int, w string").select(name, st.st_fromwkt("w").alias("geom"))


def rects(spark, rows, name="id"):
    df = spark.createDataFrame(rows, f"{name} int, x1 double, y1 double, x2 double, y2 double")
    return df.select(name, st.st_makebox("x1", "y1", "x2", "y2").alias("geom"))


def pairs(df, a, b):
    return sorted((r[a], r[b]) for r in df.select(a, b).collect())


@pytest.mark.parametrize("method", ["auto", "bnlj", "broadcast", "inlj", "pbsm", "sjmr", "sj1d"])
def test_golden_join(spark, method):
    r, s = wkt(spark, R, "r"), wkt(spark, S, "s")
    assert pairs(join.spatial_join(r, s, "intersects", method), "r", "s") == [(0, 0), (0, 2), (1, 2), (3, 1), (4, 1)]
    assert pairs(join.spatial_join(s, r, "contains", method), "s", "r") == [(1, 4), (2, 1)]


@pytest.mark.parametrize("left,right,method", [("rsgrove", "kdtree", "dj"), ("str", "grid", "dj"), ("grid", None, "repj")])
def test_cell_joins(spark, left, right, method):
    r, s = wkt(spark, R, "r"), wkt(spark, S, "s")
    lc, rc = partition.make_cells(r, left, 4), partition.make_cells(s, right, 3) if right else None
    assert pairs(join.spatial_join(r, s, "intersects", method, left_cells=lc, right_cells=rc), "r", "s") == [(0, 0), (0, 2), (1, 2), (3, 1), (4, 1)]


def test_boxes_that_only_touch(spark):
    up = math.nextafter(1e9, math.inf)
    a = rects(spark, [(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 1e9, 1e9)], "a")
    b = rects(spark, [(1, 2.0, 2.0, 3.0, 3.0), (2, up, up, up + 1, up + 1)], "b")
    assert pairs(join.spatial_join(a, b, "intersects", "pbsm"), "a", "b") == [(1, 1), (2, 1)]
    assert pairs(join.spatial_join(a, b, "disjoint"), "a", "b") == [(1, 2), (2, 2)]


def test_grid_join_equals_brute_force(spark):
    a = generators.generate(spark, "uniform", 300, 1, shape="box", max_size=(0.1, 0.1)).withColumn("geom", st.st_makebox(*[F.round(F.col(f"geom.{c}") * 20) / 20 for c in ("xmin", "ymin", "xmax", "ymax")]))
    b = generators.generate(spark, "diagonal", 200, 2, shape="box", max_size=(0.2, 0.2))
    l, r = [x.geom for x in a.orderBy("id").collect()], [x.geom for x in b.orderBy("id").collect()]
    want = sorted((i, j) for i, p in enumerate(l) for j, q in enumerate(r) if p.xmin <= q.xmax and q.xmin <= p.xmax and p.ymin <= q.ymax and q.ymin <= p.ymax)
    for grid in (None, Grid(0.2, 0.1, 0.7, 0.8, 7, 3), Grid(0, 0, 1, 1, 1, 40)):
        if grid is None or grid.xmin == 0:
            assert pairs(join.spatial_join(a, b, "mbrintersects", "pbsm", grid=grid), "l_id", "r_id") == want


def test_outer_forms_and_clashing_names(spark):
    a = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, None, 1.0)], "id int, x double, y double").select("id", st.st_point("x", "y").alias("geom"))
    b = rects(spark, [(7, 0.0, 0.0, 2.0, 2.0), (8, 0.0, 0.0, 3.0, 3.0)])
    got = join.spatial_join(a, b, how="left")
    assert got.columns == ["l_id", "l_geom", "r_id", "r_geom"]
    assert sorted((r.l_id, r.r_id or 0) for r in got.collect()) == [(1, 7), (1, 8), (2, 0), (3, 0)]
    assert [r.id for r in join.spatial_join(a, b, how="semi").collect()] == [1]
    assert sorted(r.id for r in join.spatial_join(a, b, how="anti").collect()) == [2, 3]
    with pytest.raises(ValueError):
        join.spatial_join(a, b, "near")


def test_empty_inputs(spark):
    none = rects(spark, [], "n")
    some = rects(spark, [(1, 0.0, 0.0, 1.0, 1.0)], "m")
    for method in ("auto", "pbsm", "sj1d", "bnlj"):
        assert join.spatial_join(none, some, "intersects", method).count() == 0
    assert synopses.summary(none).first().kind == "EMPTY"
    assert synopses.grid_of(none, 4) is None
    for name in partition.PARTITIONERS:
        assert len(partition.make_cells(none, name, 4).bounds) == 1


def test_distance_and_self_joins(spark):
    p = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(60)], "id int, x double, y double").select("id", st.st_point("x", "y").alias("geom"))
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if math.hypot(i % 10 - j % 10, i // 10 - j // 10) <= 1.5)
    assert pairs(join.self_join(p, "id", "withindistance", distance=1.5), "l_id", "r_id") == want
    near = join.closest_pairs(p.select("id", F.col("geom.xmin").alias("x"), F.col("geom.ymin").alias("y")), "id", "x", "y", 2.0)
    assert {r.distance for r in near.collect()} == {1.0} and near.count() == 104


def test_split_join(spark):
    r, s = wkt(spark, [G.to_wkt(G.disc(0, 0, 5, 40)), "POINT(20 20)"], "r"), wkt(spark, [G.to_wkt(G.disc(4, 4, 5, 40)), G.to_wkt(G.disc(30, 30, 5, 40))], "s")
    assert pairs(join.join_with_splits(r, s, "r", "s", threshold=16), "left_id", "right_id") == [(0, 0)]
    assert pairs(join.join_with_splits(r, s, "r", "s", threshold=16, adaptive=True), "left_id", "right_id") == [(0, 0)]


def test_summaries(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (3.0, 1.0), (2.0, 10.0)], "x double, y double").select(st.st_point("x", "y").alias("geom"))
    s = synopses.summary(pts).first()
    assert (s.num_features, s.num_points, s.xmin, s.ymin, s.xmax, s.ymax, s.kind) == (3, 3, 0, 0, 3, 10, "POINT")
    gaps = spark.createDataFrame([(None, None), (3.0, 1.0), (2.0, 10.0)], "x double, y double").select(st.st_point("x", "y").alias("geom"))
    s = synopses.summary(gaps).first()
    assert (s.num_features, s.num_nonempty, s.xmin, s.ymin) == (3, 2, 2, 1)
    mixed = wkt(spark, ["POINT(1 1)", "MULTIPOINT((1 1),(2 2))"], "i")
    assert synopses.summary(mixed).first().kind == "MULTIPOINT"
    assert synopses.summary(wkt(spark, R, "r")).first().kind == "GEOMETRYCOLLECTION"


def test_euler_golden(spark):
    grid = Grid(0.0, 0.0, 4.0, 4.0, 4, 4)
    rows = [(1, 0.0, 0.0, 1.5, 1.5)] * 3 + [(2, 2.0, 0.0, 3.5, 1.5)] * 5 + [(3, 0.0, 1.0, 2.5, 1.5)] * 7
    h = synopses.euler_histogram(rects(spark, rows), grid)
    count = lambda *r: synopses.euler_count(h, *r).first().value
    assert (count(0, 0, 4, 4), count(1, 1, 2, 1), count(1, 0, 2, 1)) == (15, 15, 8)


def test_histograms_agree(spark):
    df = generators.generate(spark, "gaussian", 2000, 9)
    grid = Grid(0.0, 0.0, 1.0, 1.0, 8, 8)
    h = synopses.uniform_histogram(df, grid, zeros=True)
    assert h.count() == 64
    p = synopses.prefix_sums(h)
    want = h.where("col >= 2 and col < 5 and row >= 1 and row < 7").agg(F.sum("value")).first()[0]
    assert synopses.rectangle_sum(p, 2, 1, 3, 6).first().value == want
    doubled = synopses.merge_histograms(h, h)
    assert doubled.agg(F.sum("value")).first()[0] == 2 * h.agg(F.sum("value")).first()[0]
    coarse = synopses.merge_unaligned(h, grid, Grid(0.0, 0.0, 1.0, 1.0, 4, 4))
    assert coarse.agg(F.sum("value")).first()[0] == h.agg(F.sum("value")).first()[0]
    assert abs(synopses.box_count_slope([(2.0**-k, 4.0**k) for k in range(6)]) + 2) < 1e-9
    s = synopses.synopsis(df, buckets=256, sample=100)
    assert s["sample"].count() == 100 and -2.5 < s["e0"] < 0


@pytest.mark.parametrize("name", partition.PARTITIONERS)
def test_partitioners_keep_every_record_once(spark, name):
    df = generators.generate(spark, "gaussian", 800, 4, shape="box", max_size=(0.1, 0.1))
    cells = partition.make_cells(df, name, 8, sample=300)
    placed = partition.spatial_partition(df, cells)
    once = partition.without_copies(placed, cells) if cells.disjoint else placed
    assert once.count() == 800 and once.select("id").distinct().count() == 800
    assert 2 <= placed.select("cell_id").distinct().count() <= 16


def test_grid_edges():
    grid = Grid(0.0, 0.0, 0.9, 0.9, 14, 14)
    assert grid.bounds()[13][3] == 0.9 and len(grid.bounds()) == 196
    assert synopses.near_square(100, 100, 100) == (10, 10) and synopses.near_square(10, 0, 5) == (5, 1)


def test_index_prunes(spark, tmp_path):
    df = generators.generate(spark, "uniform", 1000, 5, shape="box", max_size=(0.05, 0.05))
    cells = partition.make_cells(df, "rsgrove", 8)
    path = str(tmp_path / "index")
    partition.write_index(df, path, cells)
    manifest = partition.read_manifest(spark, path)
    assert manifest.agg(F.sum("num_features")).first()[0] >= 1000
    assert partition.read_index(spark, path, cells=cells).count() == 1000
    q = (0.1, 0.1, 0.2, 0.3)
    found = partition.read_index(spark, path, q, cells)
    want = df.where("geom.xmin <= 0.2 and geom.xmax >= 0.1 and geom.ymin <= 0.3 and geom.ymax >= 0.1")
    assert sorted(r.id for r in partition.read_index(spark, path, q).select("id").distinct().collect()) == sorted(r.id for r in want.collect())
    assert found.count() <= want.count()
    assert synopses.summary_from_manifest(manifest).first().xmin == synopses.summary(df).first().xmin


def test_range_query_is_pushed_down(spark, tmp_path):
    df = generators.generate(spark, "uniform", 500, 6)
    df.write.parquet(str(tmp_path / "p"))
    found = join.range_query(spark.read.parquet(str(tmp_path / "p")), G.box(0.2, 0.2, 0.4, 0.5), simple=True)
    assert any("geom.xmin" in f for f in explain.pushed_filters(found))
    assert "Exchange" not in explain.operators(found)
    exact = join.range_query(df, G.from_wkt("POLYGON((0 0,1 0,0 1,0 0))"))
    assert sorted(r.id for r in exact.collect()) == sorted(r.id for r in df.where("geom.xmin + geom.ymin <= 1").collect())


def test_dissolve_and_overlay(spark):
    df = rects(spark, [(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0), (3, 3.0, 3.0, 4.0, 4.0), (9, 8.0, 8.0, 9.0, 9.0)])
    out = {r.component: (r.members, round(r.a, 6)) for r in vector.dissolve(df, "id").withColumn("a", st.st_area("geom")).collect()}
    assert out == {1: (3, 8.0), 9: (1, 1.0)}
    area = vector.overlay(df, df.withColumnRenamed("id", "other"), "id", "other", "union").where("left_id = 1 and right_id = 2").select(st.st_area("geom")).first()[0]
    assert area == pytest.approx(7)
    far = vector.reproject(df, 3857).select("geom.srid", "geom.xmax").first()
    assert far.srid == 3857 and far.xmax == pytest.approx(222638.98, abs=0.01)


def test_trajectories(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", -1.0 - 0.01 * m, -2.0) for m in range(0, 60, 10)]
    df = spark.createDataFrame(rows, "id int, t string, lng double, lat double").withColumn("t", F.to_timestamp("t"))
    f = trajectory.features(df, "id", "t").first()
    assert f.num_points == 6 and f.xmax == -1.0 and f.ymax == -2.0
    assert f.length_km == pytest.approx(55.56, abs=0.01) and f.detour_ratio == pytest.approx(1, abs=1e-6)
    assert f.speed_kmh == pytest.approx(f.length_km / (50 / 60))
    stays = trajectory.stay_points(df, "id", "t", radius_km=20.0, least_s=1200).collect()
    assert len(stays) == 1 and stays[0].stay_s == 3000
    assert trajectory.passing(df, "id", "lng", "lat", -1.0, -2.0, 1.0).count() == 1
    assert len(trajectory.linestrings(df, "id", "t").first().coords) == 12


def test_geodesic(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(geodesic.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.195, abs=0.01)
    there = value(geodesic.point_on_bearing(F.lit(10.0), F.lit(20.0), F.lit(90.0), F.lit(50.0)))
    assert value(geodesic.haversine_km(F.lit(10.0), F.lit(20.0), F.lit(there.lng), F.lit(there.lat))) == pytest.approx(50)
    assert value(geodesic.turning_angle(*map(F.lit, (0, 0, 1, 0, 1, 1)))) == pytest.approx(90)
    assert value(geodesic.segments_meet(*map(F.lit, (0, 0, 2, 2, 0, 2, 2, 0)))) and not value(geodesic.segments_meet(*map(F.lit, (0, 0, 1, 1, 2, 2, 3, 4))))
    assert value(geodesic.mercator_x(F.lit(180.0))) == pytest.approx(20037508.34, abs=0.01)


def test_tiles(spark):
    assert tiles.tile_bounds(10, 100, 1024 - 1 - 100, (0, 0, 1024, 1024)) == (100, 100, 101, 101)
    t = spark.range(1).select(tiles.tile_id(3, F.lit(5), F.lit(2)).alias("t"))
    r = t.select(tiles.tile_z(F.col("t")), tiles.tile_x(F.col("t")), tiles.tile_y(F.col("t")), tiles.tile_x(tiles.tile_parent(F.col("t"))), tiles.tile_y(tiles.tile_flipped(F.col("t")))).first()
    assert tuple(r) == (3, 5, 2, 2, 5)
    df = generators.generate(spark, "uniform", 500, 2)
    area = (0.0, 0.0, 1.0, 1.0)
    deep = tiles.tile_counts(df, area, [4])
    both = tiles.pyramid_counts(deep, 4)
    assert both.where(tiles.tile_z(F.col("tile")) == 0).first()["count"] == 500
    assert tiles.deepest_level(both, 100) == 1
    assert {r.kind for r in tiles.classify_tiles(both, 100).collect()} <= {"image", "shallow", "data"}
    assert tiles.plot_image(df, area, 32, 32).startswith(b"\x89PNG")
    assert tiles.plot_pyramid(df, area, [0, 1], 16).count() == 5
    assert tiles.vector_tiles(df, area, [1], attributes=["id"]).count() == 4
    assert tiles.svg_path(G.box(0, 0, 1, 1), area, 10, 10) == "M0 10L10 10L10 0L0 0Z"


def test_curves(spark):
    cells = [(x, y) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(cells, "x int, y int").select("x", "y", partition.hilbert_key(F.col("x"), F.col("y"), 3).alias("h"), partition.z_key(F.col("x"), F.col("y")).alias("z"))
    rows = sorted((r.h, r.x, r.y) for r in df.collect())
    assert [r[0] for r in rows] == list(range(64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))
    assert sorted(r.z for r in df.collect()) == list(range(64))


@pytest.mark.parametrize("name", generators.DISTRIBUTIONS)
def test_generators_are_seeded(spark, name):
    one, two = (generators.generate(spark, name, 200, 11).select("id", "geom.xmin", "geom.ymin").orderBy("id").collect() for _ in range(2))
    other = generators.generate(spark, name, 200, 12).select("geom.xmin").orderBy("id").collect()
    assert one == two and [r.xmin for r in one] != [r.xmin for r in other]
    assert generators.generate(spark, "uniform", 20, 1, shape="polygon").where(st.st_isvalid("geom")).count() == 20


def test_functions(spark):
    df = wkt(spark, ["POLYGON((0 0,4 0,4 4,0 4,0 0))", "LINESTRING(0 0,3 4)", "POINT(1 1)", "POINT EMPTY", "junk"], "i")
    rows = df.select("i", st.st_area("geom").alias("a"), st.st_length("geom").alias("l"), st.st_dimension("geom").alias("d"), st.st_isempty("geom").alias("e"), st.st_numpoints("geom").alias("n"), F.size(st.st_breakline("geom")).alias("b")).orderBy("i").collect()
    assert [(r.a, r.l, r.d, r.e, r.n) for r in rows[:3]] == [(16, 16, 2, False, 5), (0, 5, 1, False, 2), (0, 0, 0, False, 1)]
    assert rows[0].b == 4 and rows[3].e and rows[4].a is None
    assert df.where("i = 0").select(st.st_isrectangle("geom")).first()[0]
    three = spark.createDataFrame([([0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 0.0], None, None), ([0.0, 0.0, 1.0, 1.0], None, None), ([0.0, 0.0, 5.0, 5.0, 1.0, 1.0], None, [1, 3, 2])], "c array<double>, i array<long>, p array<long>")
    made = [r.w for r in three.select(st.st_astext(st.st_createlinepolygon("c", "i", "p")).alias("w")).collect()]
    assert made == ["POLYGON ((0 0, 2 0, 2 2, 0 0))", "POINT (0 0)", "LINESTRING (0 0, 1 1, 5 5)"]
    again = df.select(st.st_astext(st.st_fromspatialparquet(st.st_tospatialparquet("geom"))).alias("w")).collect()
    assert [r.w for r in again[:3]] == ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "LINESTRING (0 0, 3 4)", "POINT (1 1)"]
    part = df.where("i = 1").select(st.st_geometryn("geom", 0)["kind"]).first()[0]
    assert part == "LINESTRING"


def test_sql_names(spark):
    from cartospark.functions.register import register

    names = register(spark)
    assert {"ST_Area", "ST_Intersects", "ST_CreatePointZM", "ST_MBR", "ST_Intersection", "ST_GeometryN"} <= set(names)
    r = spark.sql("SELECT ST_Area(ST_CreateBox(0, 0, 2, 3)) AS a, ST_Intersects(ST_CreatePoint(1, 1), ST_CreateBox(0, 0, 2, 2)) AS i, ST_XMax(ST_Extent(array(ST_CreatePoint(1, 5), ST_CreatePoint(7, 2)))) AS x, ST_AsText(ST_FromWKT('POINT (1 2)')) AS w, ST_WithinDistance(ST_CreatePoint(0, 0), ST_CreatePoint(3, 4), 5) AS d").first()
    assert (r.a, r.i, r.x, r.w, r.d) == (6, True, 7, "POINT (1 2)", True)


def test_observed_and_partition_summaries(spark):
    df = generators.generate(spark, "uniform", 100, 1)
    seen_df, seen = synopses.observed_summary(df, "s1")
    assert seen_df.where("id < 10").count() == 10 and seen.get["num_features"] == 100
    assert synopses.partition_summary(df.repartition(3)).agg(F.sum("num_features")).first()[0] == 100


def test_dates(spark):
    from cartospark.functions import dates

    r = spark.range(1).select(dates.parse_time(F.lit("2024-05-01 08:00:00"), zone="Asia/Shanghai").cast("string").alias("t"), dates.parse_time(F.lit("no")).alias("n")).first()
    assert r.t == "2024-05-01 00:00:00" and r.n is None


def test_k_nearest_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    a = [(i, rng.uniform(-30, 130), rng.uniform(-30, 130)) for i in range(40)]
    b = [(i, float(rng.choice([50, rng.uniform(0, 100)])), rng.uniform(0, 100) ** 2 / 100) for i in range(150)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, x double, y double").select(name, st.st_point("x", "y").alias("geom"))
    want = {i: [j for _, j in sorted((math.dist((x, y), (u, v)), j) for j, u, v in b)[:4]] for i, x, y in a}
    rows = join.knn_join(frame(a, "l"), frame(b, "r"), 4, "l", "r").collect()
    got = {i: [r.right_id for r in sorted(rows, key=lambda r: r["rank"]) if r.left_id == i] for i in want}
    assert got == want
    assert join.knn_join(frame(a, "l"), frame(b[:2], "r"), 4, "l", "r").count() == 80


def test_closest_pairs_far_apart_and_on_one_place(spark):
    near = lambda rows, **more: sorted((r.l_id, r.r_id, r.distance) for r in join.closest_pairs(spark.createDataFrame(rows, "id int, x double, y double"), "id", "x", "y", **more).collect())
    assert near([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 5000.0, 0.0)], cell=64.0) == [(1, 2, 1000.0)]
    assert near([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 3.0, 0.0), (4, None, 1.0)]) == [(2, 3, 0.0)]
    assert near([(1, 0.0, 0.0)]) == []


def test_metrics_and_plane_sweep(spark):
    import numpy as np

    m = join.JoinMetrics()
    r, s = wkt(spark, R, "r"), wkt(spark, S, "s")
    assert join.spatial_join(r, s, "intersects", "pbsm", metrics=m).count() == 5
    assert (m.left_count, m.right_count, m.result_count) == (6, 3, 5) and m.mbr_count >= 5
    rng = np.random.default_rng(1)
    a, b = (np.concatenate([c, c + rng.integers(0, 4, c.shape)], axis=1) for c in (rng.integers(0, 20, (50, 2)), rng.integers(0, 20, (60, 2))))
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    assert sorted(join.plane_sweep(a, b)) == want


def test_systems_and_bounds():
    import numpy as np

    from cartospark.functions import crs

    to, back = crs.system(32632)
    c = to(np.array([[9.0, 45.0], [9.0, 0.0], [12.0, 60.0]]))
    assert c[0] == pytest.approx([500_000, 0.9996 * 4_984_944.378], abs=0.01) and c[1] == pytest.approx([500_000, 0], abs=1e-6)
    assert back(c) == pytest.approx(np.array([[9.0, 45.0], [9.0, 0.0], [12.0, 60.0]]), abs=1e-8)
    assert crs.system(32732)[0](np.array([[9.0, -45.0]]))[0, 1] == pytest.approx(10_000_000 - 0.9996 * 4_984_944.378, abs=0.01)
    x1, _, x2, y2 = vector.reproject_bounds((8.0, 40.0, 12.0, 50.0), 4326, 32632)
    assert x1 < 420_000 and x2 > 710_000 and y2 > to(np.array([[9.0, 50.0]]))[0, 1]
    with pytest.raises(ValueError):
        crs.system(1)
    assert vector.reproject_geom(G.point(9, 45), 3395).data[0] == pytest.approx(math.radians(9) * crs.A)


def test_canvas():
    from cartospark.operators.canvas import rasterize

    area = (0.0, 0.0, 8.0, 8.0)
    assert rasterize(G.box(1, 1, 3, 2), area, 8, 8).sum() == 2 and rasterize(G.point(0.5, 7.5), area, 8, 8)[0, 0]
    ring = G.from_wkt("POLYGON((0 0,8 0,8 8,0 8,0 0),(2 2,6 2,6 6,2 6,2 2))")
    assert rasterize(ring, area, 8, 8).sum() == 64 - 16 and rasterize(ring, area, 8, 8, outline=True).sum() < 48
    line = rasterize(G.line([(0.5, 0.5), (7.5, 0.5)]), area, 8, 8)
    assert line.sum() == 8 and line[7].all()
    assert rasterize(G.line([(0, 0), (8, 8)]), area, 8, 8).diagonal().sum() in (0, 8) and rasterize(G.line([(0, 8), (8, 0)]), area, 8, 8).diagonal().all()
    disc = G.disc(4, 4, 3, 64)
    assert abs(rasterize(disc, area, 200, 200).sum() / 625 - disc.area) < 0.2


def test_options():
    from cartospark.options import Options

    o = Options({"Size": "32m", "n": "3", "flag": "yes", "path[1]": "b", "path": "a"}, ratio=0.5)
    assert (o.size("size"), o.integer("N"), o.flag("flag"), o.number("ratio"), o.text("none", "x"), o.size("none", 7)) == (32 << 20, 3, True, 0.5, "x", 7)
    assert o.of_input(1).text("path") == "b" and o.of_input(0).text("path") == "a"
    with pytest.raises(ValueError):
        o.size("path")


def test_new_partitioners():
    import numpy as np

    rng = np.random.default_rng(2)
    points = rng.random((400, 2))
    quad = partition.quad_cells(points, 13)
    assert quad.disjoint and 10 <= len(quad.bounds) <= 16
    for cells in (partition.rstar_cells(points, 9), partition.rstar_cells(points, 9, revised=True)):
        assert len(cells.bounds) == 9 and not cells.disjoint
    assert len(partition.quad_cells(np.ones((5, 2)), 8).bounds) == 1


def test_asof_join_with_tolerance(spark):
    from cartospark.operators import relational

    l = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 7, "c"), (None, 3, "d"), (1, None, "e")], "k int, t int, v string")
    r = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (1, 9, 3), (2, 8, 4), (None, 3, 5)], "k int, t int, w int")
    rows = {x.v: x.r_w for x in relational.asof_join(l, r, "k", "t", "w").collect()}
    assert rows == {"a": 3, "b": 1, "c": None, "d": 5, "e": None}
    assert {x.v: x.r_w for x in relational.asof_join(l, r, "k", "t", "w", tolerance=F.lit(0)).collect()}["a"] is None


def test_equal_geometries_are_compared_once(spark, monkeypatch):
    """Repeated boxes, lines and places, in lists cut small: all pairs of rows, by way of pairs of geometries."""
    monkeypatch.setattr(join, "LIST_ROWS", 3)
    box = lambda i: (i % 7 * 3, i % 5 * 3, i % 7 * 3 + 4, i % 5 * 3 + 4)
    df = spark.range(105).select("id", st.st_makebox(*[F.expr(e).cast("double") for e in ("id % 7 * 3", "id % 5 * 3", "id % 7 * 3 + 4", "id % 5 * 3 + 4")]).alias("geom"))
    meet = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    want = {(i, j) for i in range(105) for j in range(105) if meet(box(i), box(j))}
    for method in ("pbsm", "sj1d", "bnlj", "broadcast"):
        metrics = join.JoinMetrics()
        pairs = join.spatial_join(df, df, "intersects", method, metrics=metrics).select("l_id", "r_id")
        assert "inline" in pairs._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(want) and set(got) == want
    apart = join.spatial_join(df, df, "disjoint").select("l_id", "r_id")
    assert "Python" not in apart._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in apart.collect()} == {(i, j) for i in range(105) for j in range(105)} - want
    cut = vector.overlay(df, df, "id", "id").select("left_id", "right_id").collect()
    assert len(cut) == len(want) and {tuple(r) for r in cut} == want
    sums = {r.component: r.members for r in vector.buffer_dissolve(df, "id", 0.1).collect()}
    assert sums == {0: 105}
    near = join.knn_join(df, df, 4, "id", "id").groupBy("left_id").agg(F.array_sort(F.collect_list("right_id")).alias("ids")).collect()
    assert {r.left_id: r.ids for r in near if r.left_id < 35} == {i: sorted([i, i + 35, i + 70, min(j for j in range(105) if j % 35 != i and (abs(box(j)[0] - box(i)[0]) + abs(box(j)[1] - box(i)[1]) == 3))]) for i in range(35)}


def test_nested_loop_and_strips_have_a_bound(spark, monkeypatch):
    df = spark.range(300).select("id", st.st_point(F.col("id").cast("double"), (F.col("id") % 9).cast("double")).alias("geom"))
    monkeypatch.setattr(join, "NESTED_PAIRS", 1000, raising=False)
    pairs = join.spatial_join(df, df, "intersects", "bnlj")
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() == 300
    side = join.Side(10**7, 0.0, 0.0, 1e5, 50.0, 1300.0, 3.0, True)
    assert join.join_grid(side, side, 8, strips=True).nx > 10


def test_large_side_of_repeated_geometries_is_joined_by_geometry(spark, monkeypatch):
    """Beyond GATHER_ROWS a side is gathered if each geometry has MANY_ROWS rows or more, and not below; pairs are the same."""
    monkeypatch.setattr(join, "GATHER_ROWS", 50)
    boxes = spark.range(4).select(F.col("id").alias("box"), st.st_makebox(F.col("id") * 2, F.lit(0), F.col("id") * 2 + 2, F.lit(2)).alias("geom"))
    for distinct, many in ((5, True), (20, False)):
        points = spark.range(100).select(F.col("id").alias("point"), st.st_point(F.col("id") % distinct, F.lit(1)).alias("geom"))
        found = join.spatial_join(points, boxes, "intersects", "sj1d").select("point", "box")
        assert ("collect_list" in found._jdf.queryExecution().toString()) == many
        want = [(p, b) for p in range(100) for b in range(4) if 2 * b <= p % distinct <= 2 * b + 2]
        assert sorted(map(tuple, found.collect())) == want


def test_lists_of_equal_geometries_leave_in_stages_of_their_own(spark, monkeypatch):
    """A generated stage holds all rows of one input row: a pair of lists that spreads in one stage would be held as all pairs of its rows."""
    monkeypatch.setattr(join, "LIST_ROWS", 16)
    df = spark.range(120).select("id", st.st_makebox(F.col("id") % 3 * 5, F.lit(0), F.col("id") % 3 * 5 + 2, F.lit(2)).alias("geom"))
    found = join.self_join(df, "id", "orderingequals").select("l_id", "r_id")
    assert sorted(map(tuple, found.collect())) == [(i, j) for i in range(120) for j in range(i + 1, 120) if i % 3 == j % 3]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    stages = re.findall(r"\*\((\d+)\) Generate inline", plan)
    assert plan.count("Generate inline") == 2 and len(stages) == 1


def test_lists_are_filled_evenly_where_geometries_come_in_step(spark, monkeypatch):
    monkeypatch.setattr(join, "LIST_ROWS", 100)
    df = spark.range(0, 900, 1, 1).select("id", st.st_point(F.col("id") % 3, F.lit(0)).alias("geom"))
    sizes = [r.n for r in join.gathered(df, "geom", "rows").select(F.size("rows").alias("n")).collect()]
    assert sum(sizes) == 900 and len(sizes) == 9 and max(sizes) < 150
