import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from cartospark.functions import geometry as G

R = [G.from_wkt(x) for x in ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POINT(1 1)", "POINT(7 7)", "LINESTRING(3 1,9 1)", "POLYGON((8 0,12 0,10 3,8 0))", "POINT(20 20)")]
S = [G.from_wkt(x) for x in ("POLYGON((2 2,6 2,6 6,2 6,2 2))", "POLYGON((7 -1,13 -1,13 5,7 5,7 -1))", "POLYGON((0.5 0.5,1.5 0.5,1.5 1.5,0.5 1.5,0.5 0.5))")]


def test_golden_pairs():
    assert [(i, j) for i in range(6) for j in range(3) if G.intersects(R[i], S[j])] == [(0, 0), (0, 2), (1, 2), (3, 1), (4, 1)]
    assert [(j, i) for j in range(3) for i in range(6) if G.contains(S[j], R[i])] == [(1, 4), (2, 1)]


@pytest.mark.parametrize(
    "text",
    ["POINT (1 2)", "POINT EMPTY", "LINESTRING (0 0, 1.5 2)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))", "MULTIPOINT ((1 2), (3 4))",
     "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "GEOMETRYCOLLECTION EMPTY"],
)
def test_codecs(text):
    g = G.from_wkt(text)
    assert G.to_wkt(g) == text
    assert G.to_wkt(G.from_wkb(G.to_wkb(g))) == text


def test_wkt_errors_and_dimensions():
    assert G.to_wkt(G.from_wkt("SRID=3857;POINT Z (1 2 3)")) == "POINT (1 2)"
    assert G.from_wkt("SRID=3857;POINT (1 2)").srid == 3857
    for bad in ("POINT (1)", "CIRCLE (1 2)", "POINT (1 2) x", "POLYGON ((0 0"):
        with pytest.raises(ValueError):
            G.from_wkt(bad)


def test_measures():
    p = G.from_wkt("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))")
    assert (p.area, p.length, p.n_points, p.dimension) == (15, 20, 10, 2)
    assert G.to_wkt(G.centroid(G.box(0, 0, 4, 2))) == "POINT (2 1)"
    assert math.isnan(G.distance(p, G.empty()))
    assert G.distance(G.point(0, 0), G.point(3, 4)) == 5
    assert G.is_rectangle(G.box(0, 0, 2, 1)) and not G.is_rectangle(R[4])
    assert not G.is_valid(G.from_wkt("POLYGON((0 0,2 2,2 0,0 2,0 0))"))
    assert not G.is_simple(G.from_wkt("LINESTRING(0 0,2 2,2 0,0 2)"))


def test_overlay_areas():
    a, b = G.box(0, 0, 4, 4), G.box(2, 2, 6, 6)
    assert [G.overlay(a, b, h).area for h in ("intersection", "union", "difference", "symdifference")] == [4, 28, 12, 24]
    assert G.overlay(a, G.box(1, 1, 2, 2), "difference").area == 15
    assert G.to_wkt(G.overlay(G.line([(0, 0), (10, 0)]), G.box(2, -1, 4, 1), "intersection")) == "LINESTRING (2 0, 4 0)"
    assert G.overlay(a, G.box(9, 9, 10, 10), "intersection").is_empty


def test_quad_split_date_line_and_connect():
    parts = G.quad_split(G.disc(0, 0, 10, 64), 20)
    assert all(p.n_points <= 20 for p in parts) and sum(p.area for p in parts) == pytest.approx(G.disc(0, 0, 10, 64).area)
    split = G.split_at_date_line(G.from_wkt("POLYGON((175 10,-165 10,-175 20,175 10))"))  # a triangle of 20 by 10 degrees
    assert sorted(round(p.area, 6) for p in split) == [12.5, 87.5] and sorted(p.n_points for p in split) == [4, 5]
    ring = G.connect_lines([1, 3], [2, 2], [G.line([(0, 0), (1, 0)]), G.line([(1, 1), (1, 0)])])
    assert G.to_wkt(ring) == "LINESTRING (0 0, 1 0, 1 1)"
    assert G.connect_lines([1, 2, 3], [2, 3, 1], [G.line([(0, 0), (1, 0)]), G.line([(1, 0), (1, 1)]), G.line([(1, 1), (0, 0)])]).kind == "POLYGON"
    with pytest.raises(ValueError):
        G.connect_lines([], [], [])


def test_buffer_and_hull():
    b = G.buffer(G.line([(0, 0), (10, 0)]), 1)
    assert 22.9 < b.area < 20 + math.pi
    assert G.buffer(G.box(0, 0, 4, 4), -1).area == pytest.approx(4)
    assert G.convex_hull(G.from_wkt("MULTIPOINT((0 0),(2 0),(1 1),(1 3),(1 0.5))")).area == 3
    cells = G.voronoi(G.from_wkt("MULTIPOINT((0 0),(2 0),(0 2),(2 2))"))
    assert len(cells.data) == 4 and sum(c.area for c in cells.data) == pytest.approx(2.4**2)


coordinate = hs.integers(0, 8)
box = hs.tuples(coordinate, coordinate, hs.integers(1, 4), hs.integers(1, 4)).map(lambda v: G.box(v[0], v[1], v[0] + v[2], v[1] + v[3]))
triangle = hs.tuples(*[hs.tuples(coordinate, coordinate)] * 3).map(lambda v: np.array([*v, v[0]], float)).filter(lambda r: abs(G.ring_area(r)) > 0.1).map(lambda r: G.polygon([r]))


@settings(max_examples=60, deadline=None)
@given(hs.one_of(box, triangle), hs.one_of(box, triangle))
def test_overlay_identities(a, b):
    both, either, left, odd = (G.overlay(a, b, h).area for h in ("intersection", "union", "difference", "symdifference"))
    assert either == pytest.approx(a.area + b.area - both, abs=1e-6)
    assert left == pytest.approx(a.area - both, abs=1e-6)
    assert odd == pytest.approx(either - both, abs=1e-6)
    assert (both > 1e-9) == (G.relate(a, b)[0, 0] == 2)
    assert G.contains(a, b) == G.within(b, a) and G.covers(a, b) == G.covered_by(b, a) and G.touches(a, b) == G.touches(b, a)


def test_against_the_bundled_oracle(spark):
    """Random shapes against the geometry library on Spark's own class path, called on the driver."""
    import random

    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(5)
    spot = lambda: (rng.randint(0, 10), rng.randint(0, 10))

    def shape():
        kind = rng.choice(["POINT", "LINE", "POLY", "POLY"])
        if kind == "POINT":
            return "POINT(%d %d)" % spot()
        if kind == "LINE":
            a, b = spot(), spot()
            return f"LINESTRING({a[0]} {a[1]}, {b[0] + 1} {b[1]}, {a[0] + 2} {b[1] + 3})"
        while True:
            g = G.convex_hull(G.line([spot() for _ in range(6)]))
            if g.kind == "POLYGON":
                return G.to_wkt(g)

    names = {"intersects": "intersects", "contains": "contains", "within": "within", "covers": "covers", "covered_by": "coveredBy", "touches": "touches", "crosses": "crosses", "overlaps": "overlaps", "equals": "equalsTopo", "disjoint": "disjoint"}
    for _ in range(80):
        x, y = shape(), shape()
        a, b, ja, jb = G.from_wkt(x), G.from_wkt(y), reader.read(x), reader.read(y)
        for ours, theirs in names.items():
            assert getattr(G, ours)(a, b) == getattr(ja, theirs)(jb), (ours, x, y)
        for how, theirs in (("intersection", "intersection"), ("union", "union"), ("difference", "difference"), ("symdifference", "symDifference")):
            mine, other = G.overlay(a, b, how), getattr(ja, theirs)(jb)
            assert mine.area == pytest.approx(other.getArea(), abs=1e-6) and mine.length == pytest.approx(other.getLength(), abs=1e-6), (how, x, y)
        assert G.distance(a, b) == pytest.approx(ja.distance(jb), abs=1e-9)
