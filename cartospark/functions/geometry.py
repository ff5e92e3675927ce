"""Planar geometry kernel in numpy: values, WKT/WKB codecs, measures, relations, overlay, buffer.

A geometry is a `Geom(kind, data, srid)`:

    POINT               data: (2,) array, or None if empty
    LINESTRING          data: (n, 2) array
    POLYGON             data: list of closed rings, shell first
    MULTIPOINT / MULTILINESTRING / MULTIPOLYGON / GEOMETRYCOLLECTION   data: list of Geom

Relations and overlay rest on one idea: cut all segments where they meet, then ask each resulting vertex, open segment and
side of a segment where it lies in either geometry.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
DEFAULT_SRID = 4326


@dataclass
class Geom:
    kind: str
    data: object
    srid: int = field(default=DEFAULT_SRID)

    # -- parts ------------------------------------------------------------------------------------

    def simple(self) -> Iterable[Geom]:
        """The non-empty points, lines and polygons that it's made of."""
        if self.kind.startswith("MULTI") or self.kind == "GEOMETRYCOLLECTION":
            for part in self.data:
                yield from part.simple()
        elif not self.is_empty:
            yield self

    @property
    def is_empty(self) -> bool:
        if self.kind == "POINT":
            return self.data is None or bool(np.isnan(self.data).any())
        if self.kind == "LINESTRING":
            return len(self.data) == 0
        if self.kind == "POLYGON":
            return not self.data or len(self.data[0]) == 0
        return all(p.is_empty for p in self.data)

    @property
    def parts(self) -> list[Geom]:
        return list(self.data) if self.kind.startswith("MULTI") or self.kind == "GEOMETRYCOLLECTION" else [self]

    def coords(self) -> np.ndarray:
        """All vertices in order, closing points included."""
        out = []
        for g in self.simple():
            out += [g.data[None]] if g.kind == "POINT" else [g.data] if g.kind == "LINESTRING" else g.data
        return np.concatenate(out) if out else np.zeros((0, 2))

    @property
    def dimension(self) -> int:
        return max(({"POINT": 0, "LINESTRING": 1, "POLYGON": 2}[g.kind] for g in self.simple()), default={"POINT": 0, "MULTIPOINT": 0, "LINESTRING": 1, "MULTILINESTRING": 1, "POLYGON": 2, "MULTIPOLYGON": 2}.get(self.kind, -1))

    def bounds(self) -> tuple[float, float, float, float] | None:
        c = self.coords()
        return (*c.min(axis=0).tolist(), *c.max(axis=0).tolist()) if len(c) else None

    # -- measures ---------------------------------------------------------------------------------

    @property
    def area(self) -> float:
        return float(sum(abs(ring_area(g.data[0])) - sum(abs(ring_area(h)) for h in g.data[1:]) for g in self.simple() if g.kind == "POLYGON"))

    @property
    def length(self) -> float:
        total = 0.0
        for g in self.simple():
            for path in [g.data] if g.kind == "LINESTRING" else g.data if g.kind == "POLYGON" else []:
                total += float(np.hypot(*np.diff(path, axis=0).T).sum())
        return total

    @property
    def n_points(self) -> int:
        return len(self.coords())


# --- constructors -----------------------------------------------------------------------------------


def point(x: float, y: float, srid: int = DEFAULT_SRID) -> Geom:
    return Geom("POINT", np.array([x, y], float), srid)


def box(x1: float, y1: float, x2: float, y2: float, srid: int = DEFAULT_SRID) -> Geom:
    return Geom("POLYGON", [np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)], float)], srid)


def line(coords, srid: int = DEFAULT_SRID) -> Geom:
    return Geom("LINESTRING", np.asarray(coords, float).reshape(-1, 2), srid)


def polygon(rings, srid: int = DEFAULT_SRID) -> Geom:
    return Geom("POLYGON", [np.asarray(r, float).reshape(-1, 2) for r in rings], srid)


def collect(parts: list[Geom], srid: int = DEFAULT_SRID) -> Geom:
    """One part as it is, parts of one kind as a multi-geometry, others as a collection."""
    flat = [g for p in parts for g in p.simple()]
    if len(flat) == 1:
        return flat[0]
    kinds = {g.kind for g in flat}
    return Geom("MULTI" + kinds.pop() if len(kinds) == 1 else "GEOMETRYCOLLECTION", flat, srid)


def empty(srid: int = DEFAULT_SRID) -> Geom:
    return Geom("GEOMETRYCOLLECTION", [], srid)


def ring_area(ring: np.ndarray) -> float:
    """Signed; positive for counter-clockwise rings."""
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


# --- WKT --------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|(?i:nan|inf))|[(),;=]")


def from_wkt(text: str, srid: int = DEFAULT_SRID) -> Geom:
    """WKT or EWKT; Z and M values are read and left out."""
    tokens = _TOKEN.findall(text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        got = peek()
        if want is not None and got != want:
            raise ValueError(f"expected {want!r}, found {got!r} in {text[:60]!r}")
        at += 1
        return got

    def is_empty() -> bool:
        while peek().upper() in ("Z", "M", "ZM"):
            take()
        if peek().upper() == "EMPTY":
            take()
            return True
        return False

    def coordinate() -> list[float]:
        out = []
        while peek() not in (",", ")", ""):
            out.append(float(take()))
        if len(out) < 2:
            raise ValueError(f"a coordinate needs two numbers: {text[:60]!r}")
        return out[:2]

    def listed(item: Callable) -> list:
        take("(")
        out = [item()]
        while peek() == ",":
            take()
            out.append(item())
        take(")")
        return out

    def path() -> np.ndarray:
        return np.array(listed(coordinate), float)

    def loose_point() -> Geom:
        if peek() == "(":
            return Geom("POINT", path()[0], srid)
        return Geom("POINT", np.array(coordinate()), srid)

    def shape(kind: str) -> Geom:
        if kind not in KINDS and kind != "LINEARRING":
            raise ValueError(f"unknown geometry type {kind!r}")
        kind = "LINESTRING" if kind == "LINEARRING" else kind
        if is_empty():
            return Geom(kind, None if kind == "POINT" else np.zeros((0, 2)) if kind == "LINESTRING" else [], srid)
        if kind == "POINT":
            return Geom(kind, path()[0], srid)
        if kind == "LINESTRING":
            return Geom(kind, path(), srid)
        if kind == "POLYGON":
            return Geom(kind, listed(path), srid)
        inner = {"MULTIPOINT": loose_point, "MULTILINESTRING": lambda: Geom("LINESTRING", path(), srid), "MULTIPOLYGON": lambda: Geom("POLYGON", listed(path), srid), "GEOMETRYCOLLECTION": lambda: shape(take().upper())}[kind]
        return Geom(kind, listed(inner), srid)

    if peek().upper() == "SRID":
        take()
        take("=")
        srid = int(take())
        take(";")
    out = shape(take().upper())
    if at != len(tokens):
        raise ValueError(f"more text after the geometry: {text[:60]!r}")
    return out


def _number(x: float) -> str:
    return repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def to_wkt(g: Geom) -> str:
    pair = lambda c: f"{_number(c[0])} {_number(c[1])}"
    path = lambda p: "(" + ", ".join(map(pair, p)) + ")"
    rings = lambda rs: "(" + ", ".join(map(path, rs)) + ")"

    def body(h: Geom) -> str:
        if h.kind == "POINT":
            return f"({pair(h.data)})"
        return path(h.data) if h.kind == "LINESTRING" else rings(h.data)

    if g.is_empty and g.kind != "GEOMETRYCOLLECTION" or g.kind == "GEOMETRYCOLLECTION" and not g.data:
        return f"{g.kind} EMPTY"
    if g.kind == "GEOMETRYCOLLECTION":
        return f"{g.kind} ({', '.join(map(to_wkt, g.data))})"
    if g.kind.startswith("MULTI"):
        return f"{g.kind} ({', '.join(body(p) for p in g.data if not p.is_empty)})"
    return f"{g.kind} {body(g)}"


# --- WKB --------------------------------------------------------------------------------------------


def from_wkb(data: bytes, srid: int = DEFAULT_SRID) -> Geom:
    """WKB or EWKB of either byte order; Z and M values are left out."""
    out, end = _read_wkb(memoryview(data), 0, srid)
    if end != len(data):
        raise ValueError("more bytes after the geometry")
    return out


def _read_wkb(b: memoryview, at: int, srid: int) -> tuple[Geom, int]:
    order = "<" if b[at] else ">"
    (code,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if code & 0x20000000:
        (srid,) = struct.unpack_from(order + "i", b, at)
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0xFFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
    kind = KINDS[code % 1000 - 1]

    def path(at: int, n: int) -> tuple[np.ndarray, int]:
        a = np.frombuffer(b, order + "f8", n * dims, at).reshape(n, dims)
        return a[:, :2].astype(float), at + 8 * n * dims

    if kind == "POINT":
        p, at = path(at, 1)
        return Geom(kind, None if np.isnan(p).all() else p[0], srid), at
    (n,) = struct.unpack_from(order + "I", b, at)
    at += 4
    if kind == "LINESTRING":
        p, at = path(at, n)
        return Geom(kind, p, srid), at
    out = []
    for _ in range(n):
        if kind == "POLYGON":
            (m,) = struct.unpack_from(order + "I", b, at)
            item, at = path(at + 4, m)
        else:
            item, at = _read_wkb(b, at, srid)
        out.append(item)
    return Geom(kind, out, srid), at


def to_wkb(g: Geom) -> bytes:
    head = struct.pack("<BI", 1, KINDS.index(g.kind) + 1)
    flat = lambda a: np.ascontiguousarray(a, "<f8").tobytes()
    count = lambda n: struct.pack("<I", n)
    if g.kind == "POINT":
        return head + flat(np.full(2, np.nan) if g.data is None else g.data)
    if g.kind == "LINESTRING":
        return head + count(len(g.data)) + flat(g.data)
    if g.kind == "POLYGON":
        return head + count(len(g.data)) + b"".join(count(len(r)) + flat(r) for r in g.data)
    return head + count(len(g.data)) + b"".join(map(to_wkb, g.data))


# --- locating points --------------------------------------------------------------------------------

INSIDE, BORDER, OUTSIDE = 0, 1, 2


def segments(g: Geom) -> np.ndarray:
    """(n, 4) segments of lines and rings; zero-length ones are left out."""
    out = []
    for s in g.simple():
        for path in [s.data] if s.kind == "LINESTRING" else s.data if s.kind == "POLYGON" else []:
            out.append(np.concatenate([path[:-1], path[1:]], axis=1))
    seg = np.concatenate(out) if out else np.zeros((0, 4))
    return seg[(seg[:, :2] != seg[:, 2:]).any(axis=1)]


def point_segment_distance(p: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """(points, segments) distances."""
    a, d = seg[None, :, :2], (seg[:, 2:] - seg[:, :2])[None]
    rel = p[:, None] - a
    len2 = (d**2).sum(-1)
    t = np.clip((rel * d).sum(-1) / np.where(len2 == 0, 1, len2), 0, 1)
    return np.hypot(*np.moveaxis(rel - t[..., None] * d, -1, 0))


def _crossings(p: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Whether a ray to the right of each point crosses the segments an odd number of times."""
    x, y = p[:, 0, None], p[:, 1, None]
    x1, y1, x2, y2 = seg.T
    spans = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return ((spans & (x < at)).sum(axis=1) % 2).astype(bool)


def locate(p: np.ndarray, g: Geom, tol: float) -> np.ndarray:
    """INSIDE, BORDER or OUTSIDE of each point (n, 2)."""
    inside, border = np.zeros(len(p), bool), np.zeros(len(p), bool)
    ends = []
    for s in g.simple():
        if s.kind == "POINT":
            inside |= np.hypot(*(p - s.data).T) <= tol
            continue
        seg = segments(s)
        near = (point_segment_distance(p, seg) <= tol).any(axis=1) if len(seg) else np.hypot(*(p - s.coords()[0]).T) <= tol
        if s.kind == "POLYGON":
            border |= near
            inside |= ~near & _crossings(p, seg)
        else:
            inside |= near
            if len(s.data) and not np.array_equal(s.data[0], s.data[-1]):
                ends += [s.data[0], s.data[-1]]
    if ends:
        e = np.array(ends)
        odd = (np.hypot(*(p[:, None] - e[None]).transpose(2, 0, 1)) <= tol).sum(axis=1) % 2 == 1
        border |= odd
        inside &= ~odd
    return np.where(inside, INSIDE, np.where(border, BORDER, OUTSIDE))


# --- arrangement ------------------------------------------------------------------------------------


def _scale(*geoms: Geom) -> float:
    return max([1e-300, *(float(np.abs(c).max()) for g in geoms if len(c := g.coords()))])


def tolerance(*geoms: Geom) -> float:
    return 1e-11 * _scale(*geoms)


def _near_pairs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of boxes that meet, by a sweep along x."""
    order = np.argsort(lo[:, 0], kind="stable")
    ends = np.searchsorted(lo[order, 0], hi[order, 0], "right")
    n = ends - np.arange(len(order)) - 1
    i = np.repeat(np.arange(len(order)), n)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    i, j = order[i], order[j]
    meet = (lo[i, 1] <= hi[j, 1]) & (lo[j, 1] <= hi[i, 1])
    return i[meet], j[meet]


def split_segments(seg: np.ndarray, tol: float, extra: np.ndarray | None = None) -> np.ndarray:
    """The segments cut wherever two of them (or one and an extra point) meet; each piece once, ends snapped."""
    if not len(seg):
        return seg
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]) - tol, np.maximum(seg[:, :2], seg[:, 2:]) + tol
    own = np.arange(len(seg))
    owners, points = [own, own], [seg[:, :2], seg[:, 2:]]
    i, j = _near_pairs(lo, hi)
    for k in range(0, len(i), 500_000):
        for o, p in _meetings(seg, i[k : k + 500_000], j[k : k + 500_000], tol):
            owners.append(o)
            points.append(p)
    if extra is not None and len(extra):
        e, o = np.nonzero(point_segment_distance(extra, seg) <= tol)
        owners.append(o)
        points.append(extra[e])
    owner, pts = np.concatenate(owners), np.concatenate(points)
    t = ((pts - seg[owner, :2]) * (seg[owner, 2:] - seg[owner, :2])).sum(axis=1)
    order = np.lexsort((t, owner))
    owner, pts = owner[order], pts[order]
    same = owner[1:] == owner[:-1]
    out = np.concatenate([pts[:-1][same], pts[1:][same]], axis=1)
    # ends within the grid's reach become one
    out = snap(out.reshape(-1, 2), max(tol * 8, 1e-300)).reshape(-1, 4)
    out = out[(out[:, :2] != out[:, 2:]).any(axis=1)]
    flip = (out[:, 0] > out[:, 2]) | ((out[:, 0] == out[:, 2]) & (out[:, 1] > out[:, 3]))
    out[flip] = out[flip][:, [2, 3, 0, 1]]
    return np.unique(out, axis=0)


def snap(p: np.ndarray, grid: float) -> np.ndarray:
    """Points closer than the grid in both axes share coordinates (sorted sweep, per axis)."""
    out = p.copy()
    for axis in (0, 1):
        order = np.argsort(p[:, axis], kind="stable")
        v = p[order, axis]
        if len(v):
            group = np.cumsum(np.concatenate([[0], np.diff(v) > grid]))
            first = np.concatenate([[True], group[1:] != group[:-1]])
            out[order, axis] = v[first][group]
    return out


def _meetings(seg: np.ndarray, i: np.ndarray, j: np.ndarray, tol: float):
    """(owners, points) of the cuts that pairs of segments make in each other."""
    p, r = seg[i, :2], seg[i, 2:] - seg[i, :2]
    q, s = seg[j, :2], seg[j, 2:] - seg[j, :2]
    cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    qp = q - p
    size_r, size_s = np.hypot(*r.T), np.hypot(*s.T)
    flat = np.abs(cross) <= 1e-14 * size_r * size_s
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (qp[:, 0] * s[:, 1] - qp[:, 1] * s[:, 0]) / cross
        u = (qp[:, 0] * r[:, 1] - qp[:, 1] * r[:, 0]) / cross
    et, eu = tol / np.maximum(size_r, 1e-300), tol / np.maximum(size_s, 1e-300)
    hit = np.flatnonzero(~flat & (t >= -et) & (t <= 1 + et) & (u >= -eu) & (u <= 1 + eu))
    at = p[hit] + np.clip(t[hit], 0, 1)[:, None] * r[hit]
    free = np.ones(len(hit), bool)
    for corner in (seg[i[hit], :2], seg[i[hit], 2:], seg[j[hit], :2], seg[j[hit], 2:]):
        close = free & (np.hypot(*(corner - at).T) <= 4 * tol)
        at[close] = corner[close]
        free &= ~close
    yield i[hit], at
    yield j[hit], at
    for a, b in ((i[flat], j[flat]), (j[flat], i[flat])):
        d = seg[a, 2:] - seg[a, :2]
        len2 = np.maximum((d**2).sum(axis=1), 1e-300)
        for ends in (seg[b, :2], seg[b, 2:]):
            rel = ends - seg[a, :2]
            along = np.clip((rel * d).sum(axis=1) / len2, 0, 1)
            on = np.hypot(*(rel - along[:, None] * d).T) <= tol
            yield a[on], ends[on]


# --- relations --------------------------------------------------------------------------------------


def relate(a: Geom, b: Geom) -> np.ndarray:
    """DE-9IM as a 3 x 3 array of dimensions, -1 for none; rows: interior, border, exterior of a."""
    m = np.full((3, 3), -1, int)
    m[OUTSIDE, OUTSIDE] = 2
    tol = tolerance(a, b)
    points = [g.data for x in (a, b) for g in x.simple() if g.kind == "POINT"]
    spots = np.array(points).reshape(-1, 2)
    pieces = split_segments(np.concatenate([segments(a), segments(b)]), tol, spots)
    vertices = np.unique(np.concatenate([spots, pieces[:, :2], pieces[:, 2:], a.coords(), b.coords()]), axis=0)
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    d = pieces[:, 2:] - pieces[:, :2]
    size = np.hypot(*d.T)
    step = np.minimum(size * 1e-4, 1e-6 * _scale(a, b))
    off = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.maximum(size, 1e-300)[:, None] * np.maximum(step, 64 * tol)[:, None]
    for dim, samples in ((0, vertices), (1, middle), (2, np.concatenate([middle + off, middle - off]))):
        if not len(samples):
            continue
        x, y = locate(samples, a, 8 * tol), locate(samples, b, 8 * tol)
        for i in range(3):
            for j in range(3):
                if (i, j) != (OUTSIDE, OUTSIDE) and ((x == i) & (y == j)).any():
                    # a side sample can lie on a line only by chance, never inside one's interior
                    real = min(dim, a.dimension if i == INSIDE else a.dimension - 1 if i == BORDER else 2, b.dimension if j == INSIDE else b.dimension - 1 if j == BORDER else 2)
                    m[i, j] = max(m[i, j], real)
    return m


def _bounds_meet(a: Geom, b: Geom) -> bool:
    p, q = a.bounds(), b.bounds()
    return p is not None and q is not None and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]


def _relation(test: Callable[[np.ndarray, Geom, Geom], bool]) -> Callable[[Geom, Geom], bool]:
    def run(a: Geom, b: Geom) -> bool:
        return _bounds_meet(a, b) and bool(test(relate(a, b), a, b))

    return run


def _met(m: np.ndarray) -> bool:
    return (m[:2, :2] >= 0).any()


def _crosses(m: np.ndarray, a: Geom, b: Geom) -> bool:
    if a.dimension == b.dimension == 1:
        return m[0, 0] == 0
    if a.dimension < b.dimension:
        return m[0, 0] >= 0 and m[0, 2] >= 0
    return a.dimension > b.dimension and m[0, 0] >= 0 and m[2, 0] >= 0


def _overlaps(m: np.ndarray, a: Geom, b: Geom) -> bool:
    same = a.dimension == b.dimension
    return same and m[0, 2] >= 0 and m[2, 0] >= 0 and (m[0, 0] == 1 if a.dimension == 1 else m[0, 0] >= 0)


def intersects(a: Geom, b: Geom) -> bool:
    """A clear crossing or a clear distance decides; only touches are looked at through the arrangement."""
    if not _bounds_meet(a, b):
        return False
    p, q = segments(a), segments(b)
    if not len(p) or not len(q) or len(p) * len(q) > 4_000_000:
        return bool(_met(relate(a, b)))
    side = lambda s, c: (s[:, None, 2] - s[:, None, 0]) * (c[None, :, 1] - s[:, None, 1]) - (s[:, None, 3] - s[:, None, 1]) * (c[None, :, 0] - s[:, None, 0])
    d1, d2, d3, d4 = side(p, q[:, :2]), side(p, q[:, 2:]), side(q, p[:, :2]).T, side(q, p[:, 2:]).T
    if ((d1 * d2 < 0) & (d3 * d4 < 0)).any():
        return True
    eps = 1e-9 * _scale(a, b) ** 2
    lo1, hi1, lo2, hi2 = (f(x[:, :2], x[:, 2:]) for x in (p, q) for f in (np.minimum, np.maximum))
    close = ((lo1[:, None] <= hi2[None]) & (lo2[None] <= hi1[:, None])).all(axis=2)
    if (close & (np.minimum(np.minimum(abs(d1), abs(d2)), np.minimum(abs(d3), abs(d4))) <= eps)).any() or a.dimension == 0 or b.dimension == 0:
        return bool(_met(relate(a, b)))
    for x, y in ((a, b), (b, a)):
        if y.dimension == 2:
            firsts = np.array([s.coords()[0] for s in x.simple()])
            if any((_crossings(firsts, segments(s))).any() for s in y.simple() if s.kind == "POLYGON"):
                return True
    return any(s.kind == "POINT" for x in (a, b) for s in x.simple()) and bool(_met(relate(a, b)))


contains = _relation(lambda m, a, b: m[0, 0] >= 0 and (m[2, :2] < 0).all())
within = _relation(lambda m, a, b: m[0, 0] >= 0 and (m[:2, 2] < 0).all())
covers = _relation(lambda m, a, b: _met(m) and (m[2, :2] < 0).all())
covered_by = _relation(lambda m, a, b: _met(m) and (m[:2, 2] < 0).all())
touches = _relation(lambda m, a, b: m[0, 0] < 0 and _met(m))
crosses = _relation(_crosses)
overlaps = _relation(_overlaps)
equals = _relation(lambda m, a, b: m[0, 0] >= 0 and (m[2, :2] < 0).all() and (m[:2, 2] < 0).all())


def disjoint(a: Geom, b: Geom) -> bool:
    return not intersects(a, b)


def mbr_intersects(a: Geom, b: Geom) -> bool:
    return _bounds_meet(a, b)


def distance(a: Geom, b: Geom) -> float:
    """0 where they meet; NaN if either is empty."""
    if a.is_empty or b.is_empty:
        return math.nan
    if _bounds_meet(a, b) and intersects(a, b):
        return 0.0
    best = math.inf
    for x, y in ((a, b), (b, a)):
        p, seg = x.coords(), segments(y)
        if len(seg):
            best = min(best, float(point_segment_distance(p, seg).min()))
        q = y.coords()
        best = min(best, float(np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1)).min()))
    return best


# --- overlay ----------------------------------------------------------------------------------------

_OPS = {
    "intersection": lambda x, y: x & y, "union": lambda x, y: x | y,
    "difference": lambda x, y: x & ~y, "symdifference": lambda x, y: x ^ y,
}


def _polygons(g: Geom) -> Geom:
    return Geom("MULTIPOLYGON", [s for s in g.simple() if s.kind == "POLYGON"], g.srid)


def _area_result(pieces: np.ndarray, inside: Callable[[np.ndarray], np.ndarray], scale: float, tol: float, srid: int) -> list[Geom]:
    """Polygons of the region that `inside` says, whose border is among the pieces."""
    if not len(pieces):
        return []
    d = pieces[:, 2:] - pieces[:, :2]
    size = np.hypot(*d.T)
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    step = np.maximum(np.minimum(size * 1e-4, 1e-7 * scale), 32 * tol)
    off = np.stack([-d[:, 1], d[:, 0]], axis=1) / size[:, None] * step[:, None]
    left, right = inside(middle + off), inside(middle - off)
    border = left != right
    edges = np.where(left[border][:, None], pieces[border], pieces[border][:, [2, 3, 0, 1]])
    rings = _trace(edges)
    shells = [r for r in rings if ring_area(r) > 0]
    holes = [r for r in rings if ring_area(r) < 0]
    shells.sort(key=ring_area)
    groups: list[list[np.ndarray]] = [[s] for s in shells]
    for h in holes:
        spot = _inner_spot(h, tol, scale)
        for g in groups:
            if ring_area(g[0]) > -ring_area(h) and _crossings(spot[None], segments(Geom("LINESTRING", g[0])))[0]:
                g.append(h)
                break
    return [Geom("POLYGON", g, srid) for g in groups]


def _inner_spot(ring: np.ndarray, tol: float, scale: float) -> np.ndarray:
    """A point just inside the ring."""
    d = ring[1:] - ring[:-1]
    k = int(np.argmax(np.hypot(*d.T)))
    n = np.array([-d[k][1], d[k][0]]) / np.hypot(*d[k])
    side = 1 if ring_area(ring) > 0 else -1
    return (ring[k] + ring[k + 1]) / 2 + side * n * max(32 * tol, min(1e-7 * scale, 1e-4 * np.hypot(*d[k])))


def _trace(edges: np.ndarray) -> list[np.ndarray]:
    """Rings of directed edges with the region on their left; at a vertex the sharpest left turn."""
    start: dict[tuple, list[int]] = {}
    for k, e in enumerate(edges):
        start.setdefault((e[0], e[1]), []).append(k)
    used = np.zeros(len(edges), bool)
    angle = np.arctan2(edges[:, 3] - edges[:, 1], edges[:, 2] - edges[:, 0]) if len(edges) else np.zeros(0)
    rings = []
    for first in range(len(edges)):
        if used[first]:
            continue
        path, k = [], first
        while not used[k]:
            used[k] = True
            path.append(k)
            options = [j for j in start.get((edges[k][2], edges[k][3]), []) if not used[j]]
            if not options:
                break
            back = angle[k] + math.pi
            k = min(options, key=lambda j: (back - angle[j]) % (2 * math.pi) or 2 * math.pi)
        pts = [tuple(edges[j][:2]) for j in path] + [tuple(edges[path[-1]][2:])]
        rings += _loops(pts)
    return [_straight(r) for r in rings if len(r) > 3]


def _loops(pts: list[tuple]) -> list[np.ndarray]:
    """A closed walk as simple loops."""
    out, stack, seen = [], [], {}
    for p in pts:
        if p in seen:
            at = seen[p]
            loop = stack[at:] + [p]
            out.append(np.array(loop))
            for q in stack[at + 1 :]:
                del seen[q]
            del stack[at + 1 :]
        else:
            seen[p] = len(stack)
            stack.append(p)
    return out


def _straight(ring: np.ndarray) -> np.ndarray:
    """The ring without vertices in the middle of a straight run."""
    p = ring[:-1]
    before, after = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
    u, v = p - before, after - p
    cross = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    keep = np.abs(cross) > 1e-13 * np.hypot(*u.T) * np.hypot(*v.T)
    q = p[keep] if keep.sum() >= 3 else p
    return np.concatenate([q, q[:1]])


def overlay(a: Geom, b: Geom, how: str) -> Geom:
    """Set operation of two geometries, parts of every dimension."""
    op = _OPS[how]
    tol, scale = tolerance(a, b), _scale(a, b)
    pa, pb = _polygons(a), _polygons(b)
    spots = np.array([g.data for x in (a, b) for g in x.simple() if g.kind == "POINT"]).reshape(-1, 2)
    pieces = split_segments(np.concatenate([segments(a), segments(b)]), tol, spots)
    within_of = lambda p, g: locate(p, g, 0.0) == INSIDE
    areas = _area_result(pieces, lambda p: op(within_of(p, pa), within_of(p, pb)), scale, tol, a.srid) if len(pieces) else []
    out = list(areas)
    region = Geom("MULTIPOLYGON", areas, a.srid)
    if a.dimension < 2 or b.dimension < 2 or how == "intersection":
        covered = lambda p: locate(p, region, 8 * tol) != OUTSIDE if areas else np.zeros(len(p), bool)
        on = lambda p, g: locate(p, g, 8 * tol) != OUTSIDE
        if len(pieces):
            middle = (pieces[:, :2] + pieces[:, 2:]) / 2
            keep = op(on(middle, a), on(middle, b)) & ~covered(middle)
            paths = _join_paths(pieces[keep])
            out += [Geom("LINESTRING", p, a.srid) for p in paths]
        else:
            paths = []
        lone = np.unique(np.concatenate([spots, pieces[:, :2], pieces[:, 2:]]), axis=0)
        if len(lone):
            lines = Geom("MULTILINESTRING", [Geom("LINESTRING", p) for p in paths])
            free = op(on(lone, a), on(lone, b)) & ~covered(lone) & (locate(lone, lines, 8 * tol) == OUTSIDE)
            if how != "intersection":
                free &= (locate(lone, Geom("MULTIPOINT", [Geom("POINT", s) for s in spots]), 8 * tol) == INSIDE) if len(spots) else False
            out += [Geom("POINT", p, a.srid) for p in lone[free]]
    return collect(out, a.srid) if out else empty(a.srid)


def _join_paths(pieces: np.ndarray) -> list[np.ndarray]:
    """Pieces joined end to end where exactly two meet."""
    ends: dict[tuple, list[int]] = {}
    for k, p in enumerate(pieces):
        ends.setdefault(tuple(p[:2]), []).append(k)
        ends.setdefault(tuple(p[2:]), []).append(k)
    used, out = np.zeros(len(pieces), bool), []

    def walk(k: int, at: tuple) -> list[tuple]:
        path = [at]
        while True:
            used[k] = True
            p = pieces[k]
            at = tuple(p[2:]) if tuple(p[:2]) == at else tuple(p[:2])
            path.append(at)
            onward = [j for j in ends[at] if not used[j]]
            if len(ends[at]) != 2 or not onward:
                return path
            k = onward[0]

    for at, ks in ends.items():
        if len(ks) != 2:
            for k in ks:
                if not used[k]:
                    out.append(np.array(walk(k, at)))
    for k in range(len(pieces)):
        if not used[k]:
            out.append(np.array(walk(k, tuple(pieces[k][:2]))))
    return out


def union_all(geoms: list[Geom]) -> Geom:
    """Union of polygons, in one arrangement; other parts are added as they are where not covered."""
    polys = [p for g in geoms for p in g.simple() if p.kind == "POLYGON"]
    rest = [p for g in geoms for p in g.simple() if p.kind != "POLYGON"]
    srid = geoms[0].srid if geoms else DEFAULT_SRID
    out: Geom = empty(srid)
    if len(polys) == 1:
        out = polys[0]
    elif polys:
        tol, scale = tolerance(*polys), _scale(*polys)
        segs = [segments(p) for p in polys]
        boxes = np.array([p.bounds() for p in polys])

        def inside(p: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(p), bool)
            for s, bx in zip(segs, boxes):
                near = np.flatnonzero(~hit & (p[:, 0] >= bx[0]) & (p[:, 0] <= bx[2]) & (p[:, 1] >= bx[1]) & (p[:, 1] <= bx[3]))
                if len(near):
                    hit[near] = _crossings(p[near], s)
            return hit

        out = collect(_area_result(split_segments(np.concatenate(segs), tol), inside, scale, tol, srid), srid)
    for g in rest:
        out = overlay(out, g, "union") if not out.is_empty else g
    return out


# --- derived shapes ---------------------------------------------------------------------------------


def convex_hull(g: Geom) -> Geom:
    p = np.unique(g.coords(), axis=0)
    if len(p) == 0:
        return empty(g.srid)
    if len(p) == 1:
        return Geom("POINT", p[0], g.srid)

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    ring = half(p)[:-1] + half(p[::-1])[:-1]
    if len(ring) == 2:
        return Geom("LINESTRING", np.array(ring), g.srid)
    return Geom("POLYGON", [np.array([*ring, ring[0]])], g.srid)


def envelope(g: Geom) -> Geom:
    b = g.bounds()
    if b is None:
        return empty(g.srid)
    if b[0] == b[2] and b[1] == b[3]:
        return point(b[0], b[1], g.srid)
    if b[0] == b[2] or b[1] == b[3]:
        return line([b[:2], b[2:]], g.srid)
    return box(*b, g.srid)


def centroid(g: Geom) -> Geom:
    """Of the parts of highest dimension."""
    if g.is_empty:
        return Geom("POINT", None, g.srid)
    total, weight = np.zeros(2), 0.0
    dim = g.dimension
    for s in g.simple():
        if dim == 2 and s.kind == "POLYGON":
            for k, ring in enumerate(s.data):
                o, r = ring[0], ring - ring[0]
                cross = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
                area = cross.sum() / 2
                if area:
                    c = o + ((r[:-1] + r[1:]) * cross[:, None]).sum(axis=0) / (6 * area)
                    w = abs(area) * (1 if k == 0 else -1)
                    total, weight = total + c * w, weight + w
        elif dim == 1 and s.kind == "LINESTRING":
            size = np.hypot(*np.diff(s.data, axis=0).T)
            total, weight = total + ((s.data[:-1] + s.data[1:]) / 2 * size[:, None]).sum(axis=0), weight + size.sum()
        elif dim == 0:
            total, weight = total + s.data, weight + 1
    c = total / weight if weight else g.coords().mean(axis=0)
    return Geom("POINT", c, g.srid)


def boundary(g: Geom) -> Geom:
    out = []
    ends: dict[tuple, int] = {}
    for s in g.simple():
        if s.kind == "POLYGON":
            out += [Geom("LINESTRING", r, g.srid) for r in s.data]
        elif s.kind == "LINESTRING":
            for e in (tuple(s.data[0]), tuple(s.data[-1])):
                ends[e] = ends.get(e, 0) + 1
    out += [Geom("POINT", np.array(e), g.srid) for e, n in sorted(ends.items()) if n % 2]
    return collect(out, g.srid) if out else empty(g.srid)


def reverse(g: Geom) -> Geom:
    if g.kind == "POINT":
        return g
    if g.kind == "LINESTRING":
        return Geom(g.kind, g.data[::-1].copy(), g.srid)
    if g.kind == "POLYGON":
        return Geom(g.kind, [r[::-1].copy() for r in g.data], g.srid)
    return Geom(g.kind, [reverse(p) for p in g.data], g.srid)


def normalize(g: Geom) -> Geom:
    """Rings begin at their smallest vertex, shells clockwise, holes counter-clockwise; lines run from their smaller end; parts fall in order."""
    if g.kind == "POINT":
        return g
    if g.kind == "LINESTRING":
        return g if not len(g.data) or tuple(g.data[0]) <= tuple(g.data[-1]) else reverse(g)
    if g.kind == "POLYGON":
        rings = []
        for k, r in enumerate(g.data):
            k0 = min(range(len(r) - 1), key=lambda i: tuple(r[i])) if len(r) > 1 else 0  # noqa: B023
            q = np.concatenate([r[k0:-1], r[: k0 + 1]]) if len(r) > 1 else r
            if (ring_area(q) > 0) == (k == 0):
                q = q[::-1]
            rings.append(q)
        return Geom(g.kind, rings[:1] + sorted(rings[1:], key=lambda r: r.tolist()), g.srid)
    return Geom(g.kind, sorted((normalize(p) for p in g.data), key=lambda p: (KINDS.index(p.kind), p.coords().tolist())), g.srid)


def is_simple(g: Geom) -> bool:
    """No line meets itself or another but at end points; points are distinct."""
    tol = tolerance(g)
    pts = [tuple(s.data) for s in g.simple() if s.kind == "POINT"]
    if len(set(pts)) != len(pts):
        return False
    for s in g.simple():
        paths = [s.data] if s.kind == "LINESTRING" else s.data if s.kind == "POLYGON" else []
        for path in paths:
            seg = segments(Geom("LINESTRING", path))
            pieces = split_segments(seg, tol)
            closed = len(path) > 2 and np.array_equal(path[0], path[-1])
            inner = [tuple(p) for p in (path[:-1] if closed else path)]
            clean = [p for k, p in enumerate(inner) if k == 0 or p != inner[k - 1]]
            size = lambda x: np.hypot(*(x[:, 2:] - x[:, :2]).T).sum()
            if len(pieces) != len(seg) or len(set(clean)) != len(clean) or size(pieces) < size(seg) * (1 - 1e-9):
                return False
    lines = [s for s in g.simple() if s.kind == "LINESTRING"]
    for i, x in enumerate(lines):
        for y in lines[:i]:
            if _bounds_meet(x, y):
                m = relate(x, y)
                if max(m[INSIDE, INSIDE], m[INSIDE, BORDER], m[BORDER, INSIDE]) >= 0:
                    return False
    return True


def is_valid(g: Geom) -> bool:
    """Finite coordinates; closed rings of an area that don't cross themselves or each other; holes in their shell."""
    c = g.coords()
    if not np.isfinite(c).all():
        return False
    polys = []
    for s in g.simple():
        if s.kind == "LINESTRING" and len(np.unique(s.data, axis=0)) < 2:
            return False
        if s.kind != "POLYGON":
            continue
        polys.append(s)
        for r in s.data:
            if len(r) < 4 or not np.array_equal(r[0], r[-1]) or not is_simple(Geom("LINESTRING", r)) or ring_area(r) == 0:
                return False
        shell = Geom("POLYGON", s.data[:1])
        holes = [Geom("POLYGON", [h]) for h in s.data[1:]]
        if not all(covers(shell, h) and relate(Geom("LINESTRING", h.data[0]), boundary(shell))[0, 0] < 1 for h in holes):
            return False
        if any(relate(x, y)[0, 0] >= 0 for i, x in enumerate(holes) for y in holes[:i]):
            return False
    if g.kind == "MULTIPOLYGON":
        for i, x in enumerate(polys):
            if any(_bounds_meet(x, y) and (relate(x, y)[0, 0] >= 0 or relate(x, y)[1, 1] == 1) for y in polys[:i]):
                return False
    return True


def is_rectangle(g: Geom) -> bool:
    b = g.bounds()
    if g.kind != "POLYGON" or len(g.data) != 1 or b is None or len(g.data[0]) != 5:
        return False
    r = g.data[0]
    on_corner = np.isin(r[:, 0], (b[0], b[2])) & np.isin(r[:, 1], (b[1], b[3]))
    return bool(on_corner.all() and (np.diff(r, axis=0) == 0).any(axis=1).all() and g.area == (b[2] - b[0]) * (b[3] - b[1]) > 0)


def disc(x: float, y: float, radius: float, quadrant: int = 8, srid: int = DEFAULT_SRID) -> Geom:
    t = np.arange(4 * quadrant) * (math.pi / 2 / quadrant)
    ring = np.stack([x + radius * np.cos(t), y + radius * np.sin(t)], axis=1)
    return Geom("POLYGON", [np.concatenate([ring, ring[:1]])], srid)


def regular_polygon(x: float, y: float, radius: float, sides: int, srid: int = DEFAULT_SRID) -> Geom:
    t = np.arange(sides) * (2 * math.pi / sides)
    ring = np.stack([x + radius * np.cos(t), y + radius * np.sin(t)], axis=1)
    return Geom("POLYGON", [np.concatenate([ring, ring[:1]])], srid)


def buffer(g: Geom, radius: float, quadrant: int = 8) -> Geom:
    """All within the radius, arcs in `quadrant` steps a quarter; a negative radius shrinks polygons."""
    if g.is_empty or radius == 0 and g.dimension < 2:
        return Geom("POLYGON", [], g.srid)
    if radius == 0:
        return union_all(list(g.simple()))
    r, step = abs(radius), math.pi / 2 / quadrant
    capsules = []
    for s in segments(g):
        d = s[2:] - s[:2]
        base = math.atan2(d[1], d[0])
        t = np.arange(2 * quadrant + 1) * step
        tail = s[:2] + r * np.stack([np.cos(base + math.pi / 2 + t), np.sin(base + math.pi / 2 + t)], axis=1)
        head = s[2:] + r * np.stack([np.cos(base - math.pi / 2 + t), np.sin(base - math.pi / 2 + t)], axis=1)
        capsules.append(Geom("POLYGON", [np.concatenate([tail, head, tail[:1]])], g.srid))
    capsules += [disc(*s.data, r, quadrant, g.srid) for s in g.simple() if s.kind == "POINT"]
    rim = union_all(capsules)
    if radius < 0:
        return overlay(_polygons(g), rim, "difference")
    return union_all([rim, *(s for s in g.simple() if s.kind == "POLYGON")])


def clip_to_box(g: Geom, x1: float, y1: float, x2: float, y2: float) -> Geom:
    """Polygons cut at a box edge by edge; other parts through overlay."""
    out = []
    for s in g.simple():
        if s.kind != "POLYGON":
            out.append(overlay(s, box(x1, y1, x2, y2, g.srid), "intersection"))
            continue
        b = s.bounds()
        if b[0] >= x1 and b[2] <= x2 and b[1] >= y1 and b[3] <= y2:
            out.append(s)
            continue
        rings = [_clip_ring(r, x1, y1, x2, y2) for r in s.data]
        if not _connected_clip(rings):
            out.append(overlay(s, box(x1, y1, x2, y2, g.srid), "intersection"))
        elif len(rings[0]) > 3:
            out.append(Geom("POLYGON", [r for r in rings if len(r) > 3 and ring_area(r)], g.srid))
    parts = [p for o in out for p in o.simple() if p.kind != "POLYGON" or p.area > 0]
    return collect(parts, g.srid) if parts else empty(g.srid)


def _clip_ring(ring: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    for axis, limit, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        if not len(ring):
            return ring
        p, q = ring[:-1], ring[1:]
        dp, dq = sign * (p[:, axis] - limit), sign * (q[:, axis] - limit)
        out = []
        for a, b, da, db in zip(p, q, dp, dq):
            if (da < 0) != (db < 0):
                c = a + (b - a) * (da / (da - db))
                c[axis] = limit
                out.append(c)
            if db >= 0:
                out.append(b)
        ring = np.array([out[-1], *out]) if out else np.zeros((0, 2))
    return ring


def _connected_clip(rings: list[np.ndarray]) -> bool:
    """Whether clipped rings neither retrace an edge (several pieces) nor touch the box with a hole."""
    if len(rings) > 1:
        return False
    ring = rings[0]
    seen = {tuple(map(float, e)) for e in np.concatenate([ring[:-1], ring[1:]], axis=1)} if len(ring) > 1 else set()
    pts = [tuple(p) for p in ring[:-1]]
    return not any((c, d, a, b) in seen for a, b, c, d in seen) and len(set(pts)) == len(pts)


def quad_split(g: Geom, threshold: int) -> list[Geom]:
    """Cut by the quadrants of the bounds until no part has more vertices than the threshold."""
    out: list[Geom] = []
    todo = [(s, 0) for s in g.simple()]
    while todo:
        s, depth = todo.pop()
        b = s.bounds()
        if s.n_points <= threshold or depth >= 40 or b[0] == b[2] and b[1] == b[3]:
            out.append(s)
            continue
        mx, my = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        for q in ((b[0], b[1], mx, my), (mx, b[1], b[2], my), (b[0], my, mx, b[3]), (mx, my, b[2], b[3])):
            part = clip_to_box(s, *q)
            todo += [(p, depth + 1) for p in part.simple() if p.dimension == s.dimension]
    return out


def split_at_date_line(g: Geom) -> list[Geom]:
    """Parts on either side of the date line of longitude-latitude polygons wider than 180 degrees."""
    b = g.bounds()
    if b is None or b[2] - b[0] <= 180:
        return [g]
    moved = Geom(g.kind, [np.where(r[:, :1] < 0, r + [360.0, 0.0], r) for r in g.data], g.srid)
    west = clip_to_box(moved, 0, -90, 180, 90)
    east = clip_to_box(moved, 180, -90, 540, 90)
    east = collect([Geom("POLYGON", [r - [360.0, 0.0] for r in p.data], g.srid) for p in east.simple()], g.srid)
    return [p for p in (west, east) if not p.is_empty]


def connect_lines(first_ids: list, last_ids: list, lines: list[Geom]) -> Geom:
    """Lines joined end to end by the ids of their ends, reversed where needed; closed runs of four points or more are polygons."""
    left = [(a, b, g.data) for a, b, g in zip(first_ids, last_ids, lines) if not g.is_empty]
    if not left:
        raise ValueError("no lines to connect")
    out = []
    while left:
        a, b, path = left.pop(0)
        grown = True
        while grown and a != b:
            grown = False
            for k, (c, d, p) in enumerate(left):
                if b in (c, d):
                    p, e = (p, d) if b == c else (p[::-1], c)
                    path, b = np.concatenate([path, p[1:]]), e
                elif a in (c, d):
                    p, e = (p, c) if a == d else (p[::-1], d)
                    path, a = np.concatenate([p[:-1], path]), e
                else:
                    continue
                left.pop(k)
                grown = True
                break
        closed = a == b and len(path) >= 4
        if closed and not np.array_equal(path[0], path[-1]):
            path = np.concatenate([path, path[:1]])
        out.append(Geom("POLYGON", [path]) if closed else Geom("LINESTRING", path))
    return out[0] if len(out) == 1 else Geom("GEOMETRYCOLLECTION", out)


def transform(g: Geom, f: Callable[[np.ndarray], np.ndarray], srid: int | None = None) -> Geom:
    """f over all coordinate arrays."""
    srid = g.srid if srid is None else srid
    if g.kind == "POINT":
        return Geom(g.kind, None if g.data is None else f(g.data[None])[0], srid)
    if g.kind == "LINESTRING":
        return Geom(g.kind, f(g.data), srid)
    if g.kind == "POLYGON":
        return Geom(g.kind, [f(r) for r in g.data], srid)
    return Geom(g.kind, [transform(p, f, srid) for p in g.data], srid)


def voronoi(g: Geom, clip: Geom | None = None) -> Geom:
    """Cells of the distinct vertices, cut to the clip's bounds or to the bounds grown by a tenth."""
    p = np.unique(g.coords(), axis=0)
    if not len(p):
        return empty(g.srid)
    if clip is not None and clip.bounds():
        x1, y1, x2, y2 = clip.bounds()
    else:
        x1, y1, x2, y2 = g.bounds()
        pad = max(x2 - x1, y2 - y1, 1e-9) / 10
        x1, y1, x2, y2 = x1 - pad, y1 - pad, x2 + pad, y2 + pad
    cells = []
    for k, c in enumerate(p):
        ring = np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])
        for o in p[np.argsort(np.hypot(*(p - c).T))][1:]:
            if np.hypot(*(o - c)) > 2 * np.hypot(*(ring - c).T).max(initial=0):
                break
            normal, middle = o - c, (o + c) / 2
            side = (ring - middle) @ normal
            out = []
            for a, b, da, db in zip(ring, np.roll(ring, -1, axis=0), side, np.roll(side, -1)):
                if da <= 0:
                    out.append(a)
                if (da < 0 < db) or (db < 0 < da):
                    out.append(a + (b - a) * (da / (da - db)))
            ring = np.array(out).reshape(-1, 2)
            if not len(ring):
                break
        if len(ring) >= 3:
            cells.append(Geom("POLYGON", [np.concatenate([ring, ring[:1]])], g.srid))
    return Geom("GEOMETRYCOLLECTION", cells, g.srid)
