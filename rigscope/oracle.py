"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from rigscope.functions.kernels import CIRCLE, shares
from rigscope.functions.stats import RANGE_EDGES
from rigscope.operators.fusion import BANDS, band_edges
from rigscope.operators.gpsimu import PACKET
from rigscope.operators.lidar import SECTORS
from rigscope.queries import BOX, DIGITS, FIRST_SENSOR, NUDGE, REFERENCE, RIG


def r(e: str, name: str) -> str:
    return f"round({e} + {NUDGE}, {DIGITS}) + 0.0 AS {name}"


def spread(e: str, prefix: str, *which: str) -> str:
    f = {"min": "min({})", "max": "max({})", "mean": "avg({})", "std": "stddev_pop({})", "median": "quantile_cont({}, 0.5)", "p25": "quantile_cont({}, 0.25)", "p75": "quantile_cont({}, 0.75)", "range": "max({0}) - min({0})"}
    return ", ".join(r(f[w].format(e), f"{prefix}_{w}") for w in which)


def bins(e: str, prefix: str) -> str:
    out = []
    for i, (a, b) in enumerate(zip(RANGE_EDGES[:-1], RANGE_EDGES[1:], strict=True)):
        out.append(f"count(*) FILTER (WHERE {e} >= {a} AND {e} {'<=' if i == len(RANGE_EDGES) - 2 else '<'} {b}) AS {prefix}_{a}_{b}m")
    return ", ".join(out)


P = """p AS (
  SELECT 'drive_' || CAST((l_orderkey // 1000) % 3 AS VARCHAR) AS drive, CAST(l_orderkey // 1000 AS INTEGER) AS frame_idx,
         ((l_orderkey * 31 + l_linenumber) * 1000003 + l_partkey * 7919 + l_suppkey * 104729 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 4294967291 AS point_key,
         (l_quantity - 25.5::DOUBLE) * 2 AS x, (l_extendedprice - 53000) / 1000 AS y, (l_tax - 0.04::DOUBLE) * 50 AS z, l_discount * 10 AS reflectance
  FROM lineitem)"""
G = P + """, g AS (
  SELECT *, sqrt(x * x + y * y + z * z) AS dist, degrees(atan2(y + 0.0, x)) AS azimuth, degrees(atan2(z, sqrt(x * x + y * y))) AS elevation FROM p)"""
RANGE = spread("dist", "range", "min", "max", "mean", "median", "std", "p25", "p75")
COORDS = ", ".join(spread(a, a, "min", "max", "mean", "std", "range") for a in "xyz")
SECTOR = ", ".join(
    f"count(*) FILTER (WHERE azimuth >= {lo} OR azimuth <= {-lo}) AS sector_{n}" if n == "rear" else f"count(*) FILTER (WHERE azimuth >= {lo} AND azimuth < {hi}) AS sector_{n}" for n, (lo, hi) in SECTORS.items()
)
BINS = bins("dist", "bin")
REFLECT = spread("reflectance", "reflectance", "min", "max", "mean", "median", "std") + ", " + r("100.0 * count(*) FILTER (WHERE reflectance = 0) / count(*)", "zero_reflectance_pct")
FOV = r("max(azimuth) - min(azimuth)", "horizontal_fov") + ", " + r("max(elevation) - min(elevation)", "vertical_fov")
DENSITY = f"count(*) AS num_points, {r('abs(min(z))', 'sensor_height')}, {r('CASE WHEN avg(dist) > 0 THEN count(*) / (avg(dist) * 7) ELSE 0 END', 'mean_point_density')}"
LIDAR_FLAGS = """count(*) > 50000 AS sufficient_points, max(azimuth) - min(azimuth) > 355 AS full_horizontal_coverage, max(elevation) - min(elevation) > 20 AS good_vertical_coverage,
  avg(dist) < 30 AS reasonable_range, 100.0 * count(*) FILTER (WHERE reflectance = 0) / count(*) < 50 AS good_reflectance"""


def lidar(what: str) -> str:
    return f"WITH {G} SELECT drive, frame_idx, {what} FROM g GROUP BY drive, frame_idx"


def resolution(n: int) -> str:
    return f"""s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drive, frame_idx ORDER BY ((point_key % 2147483648) * 2654435761) % 4294967296, point_key, x, y, z) AS sample_rank FROM p) WHERE sample_rank <= {n}),
    nn AS (SELECT a.drive, a.frame_idx, a.sample_rank, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2
           FROM s a JOIN s b ON a.drive = b.drive AND a.frame_idx = b.frame_idx AND a.sample_rank <> b.sample_rank GROUP BY ALL),
    res AS (SELECT drive, frame_idx, count(*) AS sampled, avg(sqrt(d2)) * 100 AS cm FROM nn GROUP BY ALL)"""


T = """t AS (
  SELECT CAST(user_id // 10 AS VARCHAR) AS drive, event_type AS sensor, CAST(row_number() OVER (PARTITION BY user_id // 10, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx, epoch_us(ts) * 1000 AS ns
  FROM events)"""
ROW = "OVER (PARTITION BY drive, sensor ORDER BY frame_idx)"
MISSING = """m AS (SELECT drive, sensor, max(max(frame_idx) + 1) OVER (PARTITION BY drive) AS frames, max(max(frame_idx) + 1) OVER (PARTITION BY drive) - count(*) AS missing FROM t GROUP BY drive, sensor)"""
OFF = f"""o AS (SELECT s.drive, s.sensor, s.frame_idx, (s.ns - q.ns) / 1e6 AS off FROM t s LEFT JOIN t q ON s.drive = q.drive AND s.frame_idx = q.frame_idx AND q.sensor = '{REFERENCE}' WHERE s.sensor <> '{REFERENCE}')"""
OSTAT = """os AS (SELECT drive, sensor, avg(off) AS mean_o, stddev_samp(off) AS std_o, max_by(off, frame_idx) FILTER (WHERE off IS NOT NULL) - min_by(off, frame_idx) FILTER (WHERE off IS NOT NULL) AS drift FROM o GROUP BY ALL)"""
SYNC = f"""WITH {T}, {MISSING}, {OFF}, {OSTAT}, j AS (SELECT drive, greatest(coalesce(max(std_o), 0), 0) AS jit, max(abs(drift)) AS dr FROM os GROUP BY drive),
    mt AS (SELECT drive, CAST(sum(missing) AS BIGINT) AS missing_total FROM m GROUP BY drive),
    q AS (SELECT mt.drive, missing_total, coalesce(jit, 0) AS jit, dr, CASE WHEN coalesce(jit, 0) < 2 THEN 'Excellent' WHEN coalesce(jit, 0) < 5 THEN 'Good' ELSE 'High' END AS grade, missing_total = 0 AS complete FROM mt LEFT JOIN j USING (drive))"""

O = """o AS (
  SELECT CAST(user_id AS VARCHAR) AS drive, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx, epoch_us(ts) / 1e6 AS timestamp,
         49.0::DOUBLE + event_id * 1e-6 AS lat, 8.4::DOUBLE + value * 1e-6 AS lon, value / 10 + 100 AS alt, k * 1e-3 AS roll, k * -1e-3 AS pitch, radians(k * 3.6::DOUBLE - 180) AS yaw,
         value / 10 AS vn, k / 10 AS ve, 0.1::DOUBLE AS vu, (value - 50) / 20 AS ax, (k - 50) / 20 AS ay, 9.8::DOUBLE AS az, CAST(event_id % 12 AS INTEGER) AS num_sats
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events)),
f AS (
  SELECT *, (lon - first_value(lon) OVER w) * 111320 * cos(radians(first_value(lat) OVER w)) AS east, (lat - first_value(lat) OVER w) * 111320 AS north, alt - first_value(alt) OVER w AS up,
         sqrt(vn * vn + ve * ve) AS s2
  FROM o WINDOW w AS (PARTITION BY drive ORDER BY frame_idx)),
sg AS (SELECT *, sqrt(power(east - lag(east) OVER w, 2) + power(north - lag(north) OVER w, 2)) AS seg FROM f WINDOW w AS (PARTITION BY drive ORDER BY frame_idx))"""


def drive(what: str) -> str:
    return f"WITH {O} SELECT drive, {what} FROM sg GROUP BY drive"


W, H = RIG.width, RIG.height
PR = RIG.p_rect
PROJ = (
    P
    + f""", c AS (SELECT *, -y AS cx, -z - 0.08::DOUBLE AS cy, x - 0.27::DOUBLE AS cz FROM p),
h AS (SELECT *, {PR[0]}::DOUBLE * cx + 0 * cy + {PR[2]}::DOUBLE * cz + {PR[3]}::DOUBLE AS h0, {PR[5]}::DOUBLE * cy + {PR[6]}::DOUBLE * cz + {PR[7]}::DOUBLE AS h1, cz + {PR[11]}::DOUBLE AS h2 FROM c WHERE cz > 0),
fr AS (SELECT drive, frame_idx, point_key, h0 / nullif(h2, 0) AS u, h1 / nullif(h2, 0) AS v, cz AS depth FROM h),
j AS (SELECT * FROM fr WHERE u >= 0 AND u < {W} AND v >= 0 AND v < {H})"""
)


def quality(what: str) -> str:
    return f"""WITH {PROJ}, tot AS (SELECT drive, frame_idx, count(*) AS total_points FROM p GROUP BY ALL), fc AS (SELECT drive, frame_idx, count(*) AS nf FROM fr GROUP BY ALL),
    js AS (SELECT tot.drive, tot.frame_idx, total_points, coalesce(nf, 0) AS nf, u, v, depth FROM tot LEFT JOIN fc USING (drive, frame_idx) LEFT JOIN j USING (drive, frame_idx))
    SELECT drive, frame_idx, {what} FROM js GROUP BY drive, frame_idx, total_points, nf"""


def _bands() -> str:
    out = []
    for n in BANDS:
        a, b = band_edges(H)[n]
        inside = f"v >= {a} AND v < {b}"
        out += [
            f"count(*) FILTER (WHERE {inside}) AS {n}_count",
            r(f"coalesce(100.0 * count(*) FILTER (WHERE {inside}) / nullif(count(u), 0), 0)", f"{n}_pct"),
            r(f"coalesce(avg(depth) FILTER (WHERE {inside}), 0)", f"{n}_avg_depth"),
            r(f"coalesce(stddev_pop(depth) FILTER (WHERE {inside}), 0)", f"{n}_std_depth"),
        ]
    return ", ".join(out)


REGION = f"""{PROJ}, fs AS (SELECT DISTINCT drive, frame_idx FROM p),
b AS (SELECT drive, frame_idx, count(*) AS n, avg(depth) AS a, stddev_pop(depth) AS s, min(depth) AS lo, max(depth) AS hi FROM j WHERE u BETWEEN {BOX[0]} AND {BOX[2]} AND v BETWEEN {BOX[1]} AND {BOX[3]} GROUP BY ALL),
rg AS (SELECT drive, frame_idx, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(s, 0) AS s, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM fs LEFT JOIN b USING (drive, frame_idx))"""
COV = f"coalesce((max(u) - min(u)) / {W} * 100, 0)", f"coalesce((max(v) - min(v)) / {H} * 100, 0)"
RATE = "100.0 * count(u) / total_points"

I = """i AS (
  SELECT 'cam_' || CAST(label AS VARCHAR) AS drive, CAST(vec_id AS INTEGER) AS frame_idx, list_transform(embedding, lambda x: round((x::DOUBLE + 1) * 127.5::DOUBLE)) AS lum FROM embeddings),
px AS (SELECT drive, frame_idx, unnest(range(0, 64)) AS k, unnest(lum) AS v FROM i)"""
EXPO = """ex AS (SELECT drive, frame_idx, 100.0 * count(*) FILTER (WHERE v > 240) / count(*) AS over, 100.0 * count(*) FILTER (WHERE v < 15) / count(*) AS under FROM px GROUP BY ALL)"""
MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= {1} THEN 2 * {1} - 2 - ({0}) ELSE {0} END"


def lap(n: int, lum: str, source: str, keys: str) -> str:
    at = lambda dy, dx: f"{lum}[({MIRROR.format(f'(k // {n} + {dy})', n)}) * {n} + ({MIRROR.format(f'(k % {n} + {dx})', n)}) + 1]"
    return f"""lp AS (SELECT {keys}, {at(-1, 0)} + {at(1, 0)} + {at(0, -1)} + {at(0, 1)} - 4 * {at(0, 0)} AS l FROM (SELECT *, unnest(range(0, {n * n})) AS k FROM {source})),
    sh AS (SELECT {keys}, var_pop(l) AS sharp FROM lp GROUP BY ALL)"""


TILE = """i AS (SELECT vec_id // 16 AS frame_idx, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY vec_id // 16) AS n,
  list_transform(embedding, lambda x: greatest(0, least(255, round((x::DOUBLE + 1) * 127.5::DOUBLE)))) AS lum FROM embeddings),
tl AS (SELECT i.frame_idx, tile, lum FROM i JOIN (SELECT unnest(range(0, 16)) AS tile) ON tile % n = nth),
e AS (SELECT frame_idx, tile, unnest(range(0, 64)) AS k, unnest(lum) AS v FROM tl),
px AS (SELECT CAST(frame_idx AS INTEGER) AS frame_idx, ((tile // 4) * 8 + k // 8) * 32 + (tile % 4) * 8 + k % 8 AS pos, v FROM e),
im AS (SELECT frame_idx, list(v ORDER BY pos) AS lum FROM px GROUP BY frame_idx)"""
SIDE = 32
# Colour images: the gray values, and those a third and two thirds of the image on; then px and im of their gray values.
COLOUR = f"""{TILE.replace("px AS (", "p0 AS (").replace("im AS (SELECT frame_idx, list(v ORDER BY pos) AS lum FROM px", "g AS (SELECT frame_idx, list(v ORDER BY pos) AS lum FROM p0")},
c AS (SELECT frame_idx, pos, lum[pos + 1] AS r, lum[(pos + 341) % 1024 + 1] AS g, lum[(pos + 682) % 1024 + 1] AS b FROM (SELECT *, unnest(range(0, 1024)) AS pos FROM g)),
px AS (SELECT frame_idx, pos, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM c),
im AS (SELECT frame_idx, list(((r * 4899 + g * 9617 + b * 1868 + 8192)::BIGINT >> 14)::DOUBLE ORDER BY pos) AS lum FROM c GROUP BY frame_idx)"""


def near(values: str, dy: int, dx: int, n: int = SIDE) -> str:
    """The value of a list next to place k, mirrored at the borders."""
    return f"{values}[({MIRROR.format(f'(k // {n} + {dy})', n)}) * {n} + ({MIRROR.format(f'(k % {n} + {dx})', n)}) + 1]"


def around(values: str, reach: tuple[int, ...]) -> list[str]:
    return [near(values, dy, dx) for dy in reach for dx in reach]


def each(source: str) -> str:
    return f"(SELECT *, unnest(range(0, {SIDE * SIDE})) AS k FROM {source})"


_gx = " + ".join(f"{w} * {near('lum', dy, dx)}" for dy, dx, w in ((-1, 1, 1), (0, 1, 2), (1, 1, 1), (-1, -1, -1), (0, -1, -2), (1, -1, -1)))
_gy = " + ".join(f"{w} * {near('lum', dy, dx)}" for dy, dx, w in ((1, -1, 1), (1, 0, 2), (1, 1, 1), (-1, -1, -1), (-1, 0, -2), (-1, 1, -1)))
GRADIENT = f"so AS MATERIALIZED (SELECT frame_idx, k, {_gx} AS gx, {_gy} AS gy FROM {each('im')})"
PRODUCTS = "pl AS MATERIALIZED (SELECT frame_idx, list(gx * gx ORDER BY k) AS xx, list(gx * gy ORDER BY k) AS xy, list(gy * gy ORDER BY k) AS yy FROM so GROUP BY frame_idx)"


def structure(name: str, reach: tuple[int, ...], response: str) -> str:
    """A response at each pixel from the products' sums over a window, as a list, and its largest value nearby."""
    sums = ", ".join(f"{' + '.join(around(p, reach))} AS {a}" for p, a in (("xx", "a"), ("xy", "b"), ("yy", "c")))
    return f"""{name}1 AS MATERIALIZED (SELECT frame_idx, k, {response} AS r FROM (SELECT frame_idx, k, {sums} FROM {each('pl')})),
    {name}2 AS MATERIALIZED (SELECT frame_idx, list(r ORDER BY k) AS rs, max(r) AS top FROM {name}1 GROUP BY frame_idx),
    {name} AS (SELECT frame_idx, k, top, rs[k + 1] AS r, greatest({", ".join(around("rs", (-1, 0, 1)))}) AS most FROM {each(f'{name}2')})"""


HARRIS = structure("hr", (-1, 0), "a * c - b * b - 0.04::DOUBLE * ((a + c) * (a + c))") + ", harris AS (SELECT frame_idx, count(*) FILTER (WHERE top > 0 AND most > 0.01::DOUBLE * top) AS n FROM hr GROUP BY frame_idx)"
SHI = (
    structure("sh", (-1, 0, 1), "(a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)")
    + f""", cd AS MATERIALIZED (SELECT frame_idx, k // {SIDE} AS y, k % {SIDE} AS x, row_number() OVER (PARTITION BY frame_idx ORDER BY r DESC, k) AS q FROM sh WHERE r > 0 AND r >= 0.01::DOUBLE * top AND r = most),
    gr AS (SELECT frame_idx, 0::BIGINT AS q, CAST([] AS STRUCT(y BIGINT, x BIGINT)[]) AS kept FROM im
      UNION ALL SELECT gr.frame_idx, cd.q, CASE WHEN len(kept) < 1000 AND len(list_filter(kept, lambda p: (p.y - cd.y) * (p.y - cd.y) + (p.x - cd.x) * (p.x - cd.x) < 100)) = 0 THEN list_append(kept, {{'y': cd.y, 'x': cd.x}}) ELSE kept END
      FROM gr JOIN cd ON cd.frame_idx = gr.frame_idx AND cd.q = gr.q + 1),
    shi AS (SELECT frame_idx, max(len(kept)) AS n FROM gr GROUP BY frame_idx)"""
)
_out = lambda dy, dx: f"CASE WHEN k // {SIDE} + {dy} BETWEEN 0 AND {SIDE - 1} AND k % {SIDE} + {dx} BETWEEN 0 AND {SIDE - 1} THEN ms[k + {dy * SIDE + dx} + 1] ELSE 0 END"
_flat, _steep = "abs(gy) < abs(gx) * tan(pi() / 8)", "abs(gy) > abs(gx) * tan(3 * pi() / 8)"
_beside = lambda a, b, c, d: f"CASE WHEN {_flat} THEN {_out(*a)} WHEN {_steep} THEN {_out(*b)} WHEN gx * gy >= 0 THEN {_out(*c)} ELSE {_out(*d)} END"
CANNY = f"""mg AS MATERIALIZED (SELECT frame_idx, list(abs(gx) + abs(gy) ORDER BY k) AS ms FROM so GROUP BY frame_idx),
    nb AS (SELECT so.frame_idx, k, ms[k + 1] AS m, {_flat} OR {_steep} AS straight, {_beside((0, -1), (-1, 0), (-1, -1), (-1, 1))} AS f1, {_beside((0, 1), (1, 0), (1, 1), (1, -1))} AS f2 FROM so JOIN mg USING (frame_idx)),
    pk AS MATERIALIZED (SELECT frame_idx, k // {SIDE} AS y, k % {SIDE} AS x, m FROM nb WHERE m > f1 AND (m > f2 OR straight AND m = f2) AND m > 50),
    eg AS (SELECT frame_idx, y, x FROM pk WHERE m > 150 UNION SELECT pk.frame_idx, pk.y, pk.x FROM eg JOIN pk ON pk.frame_idx = eg.frame_idx AND abs(pk.y - eg.y) <= 1 AND abs(pk.x - eg.x) <= 1),
    canny AS (SELECT im.frame_idx, count(eg.y) AS n FROM im LEFT JOIN eg USING (frame_idx) GROUP BY im.frame_idx)"""


def pyramid(levels: int = 8, scale: float = 1.2, border: int = 31) -> str:
    """Corners (frame_idx, level, y, x, oy, ox, inside) at every level of a tile image, and counts at the first and at all.

    The levels' limits of keypoints lie above what images of this size can hold.
    """
    rows = []
    for i in range(levels):
        n = int(round(SIDE / scale**i))
        if n >= 7:
            rows.append(f"({i}, {n}, {scale**i!r}::DOUBLE, {min(border, max(3, n // 8))})")
    place = lambda c: f"greatest(0, least({SIDE - 1}, ({c} + 0.5::DOUBLE) * f - 0.5::DOUBLE))"
    ring = ", ".join(f"vs[k + ({dy}) * n + ({dx}) + 1]" for dx, dy in CIRCLE)
    steps = ", ".join(f"({dy}, {dx})" for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    at = lambda y, x: f"lum[{y} * {SIDE} + {x} + 1]"
    return f"""lv(level, n, f, edge) AS (VALUES {", ".join(rows)}),
    p1 AS (SELECT frame_idx, lum, level, n, f, edge, k // n AS y, k % n AS x FROM (SELECT im.*, lv.*, unnest(range(0, n * n)) AS k FROM im CROSS JOIN lv)),
    p2 AS (SELECT *, {place("y")} AS sy, {place("x")} AS sx FROM p1),
    p3 AS (SELECT *, CAST(least(floor(sy), {SIDE - 2}) AS BIGINT) AS y0, CAST(least(floor(sx), {SIDE - 2}) AS BIGINT) AS x0 FROM p2),
    p4 AS (SELECT frame_idx, level, n, f, edge, y, x, sy - y0 AS fy, sx - x0 AS fx, {at("y0", "x0")} AS v00, {at("y0", "(x0 + 1)")} AS v01, {at("(y0 + 1)", "x0")} AS v10, {at("(y0 + 1)", "(x0 + 1)")} AS v11 FROM p3),
    lp AS MATERIALIZED (SELECT frame_idx, level, n, f, edge, list(round_even((v00 * (1 - fx) + v01 * fx) * (1 - fy) + (v10 * (1 - fx) + v11 * fx) * fy, 0) ORDER BY y * n + x) AS vs FROM p4 GROUP BY ALL),
    rg AS (SELECT frame_idx, level, n, f, edge, k, list_transform([{ring}], lambda v: v - vs[k + 1]) AS d
      FROM (SELECT *, unnest(range(0, n * n)) AS k FROM lp) WHERE k // n BETWEEN 3 AND n - 4 AND k % n BETWEEN 3 AND n - 4),
    ar AS (SELECT * EXCLUDE (d), list_concat(d, d[1:8]) AS d FROM rg),
    sc AS MATERIALIZED (SELECT * FROM (SELECT frame_idx, level, n, f, edge, k // n AS y, k % n AS x,
        greatest(list_max(list_transform(range(1, 17), lambda i: list_min(d[i:i + 8]))), list_max(list_transform(range(1, 17), lambda i: -list_max(d[i:i + 8])))) AS s FROM ar) WHERE s > 20),
    ot AS (SELECT frame_idx, level, y + dy AS y, x + dx AS x, max(s) AS m FROM sc CROSS JOIN (VALUES {steps}) o(dy, dx) GROUP BY ALL),
    kp AS MATERIALIZED (SELECT sc.frame_idx, sc.level, sc.y, sc.x, (sc.y + 0.5::DOUBLE) * f - 0.5::DOUBLE AS oy, (sc.x + 0.5::DOUBLE) * f - 0.5::DOUBLE AS ox, sc.y >= edge AND sc.y < n - edge AND sc.x >= edge AND sc.x < n - edge AS inside
      FROM sc LEFT JOIN ot ON sc.frame_idx = ot.frame_idx AND sc.level = ot.level AND sc.y = ot.y AND sc.x = ot.x WHERE s > coalesce(m, 0)),
    fast AS (SELECT im.frame_idx, count(kp.y) FILTER (WHERE level = 0) AS n FROM im LEFT JOIN kp USING (frame_idx) GROUP BY im.frame_idx),
    orb AS (SELECT im.frame_idx, count(kp.y) FILTER (WHERE inside) AS n FROM im LEFT JOIN kp USING (frame_idx) GROUP BY im.frame_idx)"""


CAM = "'cam' AS drive, frame_idx"


def large(side: int) -> str:
    """Pixels (frame_idx, id, y, x, v) of images of side x side vectors."""
    tiles, size = side * side, 8 * side
    return f"""i AS (SELECT vec_id // {tiles} AS frame_idx, row_number() OVER (PARTITION BY vec_id // {tiles} ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY vec_id // {tiles}) AS n,
      list_transform(embedding, lambda x: greatest(0, least(255, round((x::DOUBLE + 1) * 127.5::DOUBLE)))) AS lum FROM embeddings),
    e AS (SELECT frame_idx, tile, unnest(range(0, 64)) AS k, unnest(lum) AS v FROM i JOIN (SELECT unnest(range(0, {tiles})) AS tile) ON tile % n = nth),
    py AS (SELECT CAST(frame_idx AS INTEGER) AS frame_idx, tile // {side} * 8 + k // 8 AS y, tile % {side} * 8 + k % 8 AS x, v FROM e),
    px AS MATERIALIZED (SELECT frame_idx, frame_idx * {size * size} + y * {size} + x AS id, y, x, v FROM py)"""


def places(at: list[tuple[int, int]]) -> str:
    """Steps (x, y) as a list of numbers; DX and DY read them."""
    return f"[{', '.join(str((x + 100) * 1000 + y + 100) for x, y in at)}]"


DX, DY = "(p // 1000 - 100)", "(p % 1000 - 100)"
SQUARE = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]


def tiled(side: int = 32) -> str:
    """Sharpness, corners and edges of whole images: pixels joined with those around them, mirrored at the borders."""
    size = 8 * side
    to = lambda a, at, cond="": f"(SELECT *, unnest({places(at)}) AS p FROM {a}{cond})"
    mirrored = lambda at: f"(SELECT *, {MIRROR.format(f'(y + {DY})', size)} AS qy, {MIRROR.format(f'(x + {DX})', size)} AS qx FROM {to('px', at)}) c JOIN px q ON q.id = c.frame_idx * {size * size} + qy * {size} + qx"
    flat, steep, down = "abs(gy) < abs(gx) * tan(pi() / 8)", "abs(gy) > abs(gx) * tan(3 * pi() / 8)", "gx * gy >= 0"
    beside = lambda s, a: f"LEFT JOIN so {a} ON {a}.frame_idx = c.frame_idx AND {a}.y = c.y {s} c.sy AND {a}.x = c.x {s} c.sx"
    return f"""WITH RECURSIVE {large(side)},
    lp AS (SELECT c.id, c.frame_idx, sum(CASE WHEN p = {places([(0, 0)])[1:-1]} THEN -4 ELSE 1 END * q.v) AS l FROM {mirrored([(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)])} GROUP BY ALL),
    sharp AS (SELECT frame_idx, count(*) AS num_pixels, var_pop(l) AS s FROM lp GROUP BY frame_idx),
    r1 AS (SELECT c.frame_idx, c.y, c.x, list(q.v - c.v ORDER BY list_position({places(CIRCLE)}, p)) AS d FROM {to("px", CIRCLE, f" WHERE y BETWEEN 3 AND {size - 4} AND x BETWEEN 3 AND {size - 4}")} c JOIN px q ON q.id = c.id + {DY} * {size} + {DX} GROUP BY ALL),
    r2 AS (SELECT * EXCLUDE (d), list_concat(d, d[1:8]) AS d FROM r1),
    sc AS MATERIALIZED (SELECT * FROM (SELECT frame_idx, y, x, greatest(list_max(list_transform(range(1, 17), lambda i: list_min(d[i:i + 8]))), list_max(list_transform(range(1, 17), lambda i: -list_max(d[i:i + 8])))) AS s FROM r2) WHERE s > 20),
    ot AS (SELECT c.frame_idx, c.y, c.x, any_value(c.s) AS s, max(q.s) FILTER (WHERE q.y <> c.y OR q.x <> c.x) AS m FROM {to("sc", SQUARE)} c JOIN sc q ON q.frame_idx = c.frame_idx AND q.y = c.y + {DY} AND q.x = c.x + {DX} GROUP BY ALL),
    fast AS (SELECT frame_idx, count(*) AS n FROM ot WHERE s > coalesce(m, 0) GROUP BY frame_idx),
    gr AS (SELECT c.frame_idx, c.y, c.x, sum({DX} * (2 - abs({DY})) * q.v) AS gx, sum({DY} * (2 - abs({DX})) * q.v) AS gy FROM {mirrored(SQUARE)} GROUP BY ALL),
    so AS MATERIALIZED (SELECT *, abs(gx) + abs(gy) AS m, {flat} OR {steep} AS straight, CASE WHEN {flat} THEN 0 ELSE 1 END AS sy, CASE WHEN {flat} THEN 1 WHEN {steep} THEN 0 WHEN {down} THEN 1 ELSE -1 END AS sx FROM gr),
    pk AS MATERIALIZED (SELECT c.frame_idx, c.y, c.x, c.m FROM so c {beside("-", "a")} {beside("+", "b")} WHERE c.m > coalesce(a.m, 0) AND (c.m > coalesce(b.m, 0) OR c.straight AND c.m = coalesce(b.m, 0)) AND c.m > 50),
    eg AS (SELECT frame_idx, y, x FROM pk WHERE m > 150 UNION SELECT pk.frame_idx, pk.y, pk.x FROM {to("eg", SQUARE)} c JOIN pk ON pk.frame_idx = c.frame_idx AND pk.y = c.y + {DY} AND pk.x = c.x + {DX}),
    ec AS (SELECT frame_idx, count(*) AS n FROM eg GROUP BY frame_idx)
    SELECT {CAM}, num_pixels, {r("s", "sharpness")}, coalesce(fast.n, 0) AS fast_keypoints, coalesce(ec.n, 0) AS edge_pixels, {r("100.0 * coalesce(ec.n, 0) / num_pixels", "edge_density")}
    FROM sharp LEFT JOIN fast USING (frame_idx) LEFT JOIN ec USING (frame_idx)"""


def oriented(side: int = 32, most: int = 2000, levels: int = 8, scale: float = 1.2, border: int = 31, radius: int = 15) -> str:
    """Keypoints of images of side x side vectors: every step a join of pixels with places around them."""
    size = 8 * side
    rows = []
    for i, want in enumerate(shares(most, levels, scale)):
        n = int(round(size / scale**i))
        rows.append(f"({i}, {n}, {scale**i!r}::DOUBLE, {min(border, max(3, n // 8))}, {want})")
    place = lambda c: f"greatest(0, least({size - 1}, ({c} + 0.5::DOUBLE) * f - 0.5::DOUBLE))"
    key = "frame_idx, level"
    around = lambda a, at, b: f"(SELECT *, unnest({places(at)}) AS p FROM {a}) c JOIN {b} q ON q.frame_idx = c.frame_idx AND q.level = c.level AND q.y = c.y + {DY} AND q.x = c.x + {DX}"
    square = lambda reach: [(x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1)]
    disc = [(x, y) for x, y in square(radius) if x * x + y * y <= radius * radius]
    corner = lambda step, a: f"JOIN px {a} ON {a}.id = g2.id + {step}"
    return f"""WITH {large(side)},
    lv(level, n, f, edge, want) AS (VALUES {", ".join(rows)}),
    g1 AS (SELECT frame_idx, level, k // n AS y, k % n AS x, {place("(k // n)")} AS sy, {place("(k % n)")} AS sx FROM (SELECT im.frame_idx, lv.*, unnest(range(0, n * n)) AS k FROM (SELECT DISTINCT frame_idx FROM px) im CROSS JOIN lv)),
    g0 AS (SELECT *, CAST(least(floor(sy), {size - 2}) AS BIGINT) AS y0, CAST(least(floor(sx), {size - 2}) AS BIGINT) AS x0 FROM g1),
    g2 AS (SELECT *, frame_idx * {size * size} + y0 * {size} + x0 AS id FROM g0),
    g3 AS (SELECT g2.frame_idx, level, g2.y, g2.x, sy - y0 AS fy, sx - x0 AS fx, a.v AS v00, b.v AS v01, c.v AS v10, d.v AS v11 FROM g2 {corner(0, "a")} {corner(1, "b")} {corner(size, "c")} {corner(size + 1, "d")}),
    lp AS MATERIALIZED (SELECT {key}, y, x, CAST(round_even((v00 * (1 - fx) + v01 * fx) * (1 - fy) + (v10 * (1 - fx) + v11 * fx) * fy, 0) AS BIGINT) AS v FROM g3),
    r1 AS (SELECT c.frame_idx, c.level, c.y, c.x, list(q.v - c.v ORDER BY list_position({places(CIRCLE)}, p)) AS d FROM {around("lp", CIRCLE, "lp")} GROUP BY ALL HAVING count(*) = 16),
    r2 AS (SELECT * EXCLUDE (d), list_concat(d, d[1:8]) AS d FROM r1),
    sc AS MATERIALIZED (SELECT * FROM (SELECT {key}, y, x, greatest(list_max(list_transform(range(1, 17), lambda i: list_min(d[i:i + 8]))), list_max(list_transform(range(1, 17), lambda i: -list_max(d[i:i + 8])))) AS s FROM r2) WHERE s > 20),
    ot AS (SELECT c.frame_idx, c.level, c.y, c.x, max(q.s) FILTER (WHERE q.y <> c.y OR q.x <> c.x) AS m FROM {around("sc", square(1), "sc")} GROUP BY ALL),
    kp AS MATERIALIZED (SELECT {key}, y, x, want FROM sc JOIN ot USING ({key}, y, x) JOIN lv USING (level) WHERE s > coalesce(m, 0) AND y >= edge AND y < n - edge AND x >= edge AND x < n - edge),
    so AS MATERIALIZED (SELECT c.frame_idx, c.level, c.y, c.x, sum({DX} * (2 - abs({DY})) * q.v) AS gx, sum({DY} * (2 - abs({DX})) * q.v) AS gy FROM {around("lp", square(1), "lp")} GROUP BY ALL),
    st AS (SELECT c.frame_idx, c.level, c.y, c.x, want, CAST(sum(gx * gx) AS DOUBLE) AS a, CAST(sum(gx * gy) AS DOUBLE) AS b, CAST(sum(gy * gy) AS DOUBLE) AS d FROM {around("kp", square(3), "so")} GROUP BY ALL),
    rk AS MATERIALIZED (SELECT {key}, y, x, want, rank() OVER (PARTITION BY {key} ORDER BY a * d - b * b - 0.04::DOUBLE * ((a + d) * (a + d)) DESC) AS rank FROM st),
    kept AS (SELECT * FROM rk WHERE rank <= want),
    mo AS (SELECT c.frame_idx, c.level, c.y, c.x, rank, CAST(sum({DX} * q.v) AS DOUBLE) AS mx, CAST(sum({DY} * q.v) AS DOUBLE) AS my FROM {around("kept", disc, "lp")} GROUP BY ALL)
    SELECT 'cam' AS drive, frame_idx, level, y, x, rank, {r("degrees(atan2(my, mx))", "angle_deg")} FROM mo"""


ORB = pyramid()
DETECTORS = {"harris": "harris.n", "orb": "orb.n", "fast": "fast.n", "shi_tomasi": "shi.n", "canny": "canny.n"}
ALL_KERNELS = f"WITH RECURSIVE {TILE}, {GRADIENT}, {PRODUCTS}, {HARRIS}, {SHI}, {CANNY}, {ORB}"
JOINED = "harris JOIN shi USING (frame_idx) JOIN canny USING (frame_idx) JOIN fast USING (frame_idx) JOIN orb USING (frame_idx)"
LIGHT = f"""li AS (SELECT frame_idx, avg(v) AS m, stddev_pop(v) AS sd, 100.0 * count(*) FILTER (WHERE v > 240) / count(*) AS ov, 100.0 * count(*) FILTER (WHERE v < 15) / count(*) AS un FROM px GROUP BY frame_idx), {lap(SIDE, "lum", "im", "frame_idx").replace("lp AS", "lq AS").replace("FROM lp", "FROM lq").replace("sh AS", "sg AS")}"""


def camera_sequence(key: str) -> str:
    return f"""WITH {TILE}, {ORB}, {LIGHT}, q AS (SELECT count(*) AS num_frames, avg(m) AS ba, stddev_pop(m) AS bd, avg(sharp) AS sa, stddev_pop(sharp) AS sv, avg(100 - ov - un) AS ea, avg(orb.n) AS oa, stddev_pop(orb.n) AS od
        FROM li JOIN sg USING (frame_idx) JOIN orb USING (frame_idx)),
      w AS (SELECT *, CASE WHEN ba > 0 THEN bd * 100 / ba ELSE 0 END AS bc, CASE WHEN sa > 0 THEN sv * 100 / sa ELSE 0 END AS sc FROM q)
      SELECT {key}, num_frames, {r("ba", "brightness_avg")}, {r("bd", "brightness_dev")}, {r("sa", "sharpness_avg")}, {r("sv", "sharpness_dev")}, {r("ea", "exposure_quality_avg")}, {r("oa", "orb_avg")}, {r("od", "orb_dev")}, {r("bc", "brightness_cv")}, {r("sc", "sharpness_cv")},
             bc < 10 AS consistent_brightness, sc < 20 AS consistent_sharpness, ea > 80 AS good_exposure, oa >= 500 AS sufficient_features FROM w"""


CAL = """s AS (SELECT CAST(s_suppkey AS VARCHAR) AS date, s_suppkey, CAST(s_suppkey % 7 AS DOUBLE) AS k FROM supplier)"""
_d4 = lambda e: f"CAST(CAST(round({e}, 4) AS DECIMAL(20, 4)) AS VARCHAR)"

SQL: dict[str, str] = {
    "lidar_range_stats": lidar(RANGE),
    "lidar_coord_stats": lidar(COORDS),
    "lidar_azimuth": lidar(SECTOR),
    "lidar_range_hist": lidar(BINS),
    "lidar_reflectance": lidar(REFLECT),
    "lidar_fov": lidar(FOV),
    "lidar_density": lidar(DENSITY),
    "lidar_flags": lidar(LIDAR_FLAGS),
    "lidar_frame_metrics": lidar(", ".join([DENSITY, RANGE, COORDS, SECTOR, BINS, REFLECT, FOV, LIDAR_FLAGS])),
    "lidar_spatial_resolution": f"WITH {P}, {resolution(5000)} SELECT drive, frame_idx, sampled, {r('cm', 'spatial_resolution_cm')} FROM res",
    "lidar_sequence": f"""WITH {G}, {resolution(5000)}, fm AS (SELECT drive, frame_idx, count(*)::DOUBLE AS n, avg(dist) AS rm, max(azimuth) - min(azimuth) AS hf FROM g GROUP BY ALL),
      a AS (SELECT fm.*, cm FROM fm LEFT JOIN res USING (drive, frame_idx))
      SELECT drive, count(*) AS num_frames, {spread("n", "points", "mean", "std", "min", "max")}, {r("stddev_pop(n) * 100 / nullif(avg(n), 0)", "points_cv")}, {spread("rm", "range", "mean", "std")},
             {r("stddev_pop(cm) * 100 / nullif(avg(cm), 0)", "resolution_cv")}, avg(n) > 50000 AS sufficient_density, coalesce(stddev_pop(n) * 100 / nullif(avg(n), 0) < 5, false) AS consistent_points,
             coalesce(stddev_pop(cm) * 100 / nullif(avg(cm), 0) < 20, false) AS consistent_resolution, bool_and(hf > 355) AS full_coverage FROM a GROUP BY drive""",
    "lidar_all_neighbours": f"""WITH {P}, q AS (SELECT *, row_number() OVER () AS i FROM p),
      nn AS (SELECT a.drive, a.frame_idx, a.i, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2 FROM q a JOIN q b ON a.drive = b.drive AND a.frame_idx = b.frame_idx AND a.i <> b.i GROUP BY ALL),
      n AS (SELECT drive, frame_idx, count(*) AS points FROM p GROUP BY ALL)
      SELECT drive, frame_idx, points, {r('avg(sqrt(d2)) * 100', 'spatial_resolution_cm')} FROM n LEFT JOIN nn USING (drive, frame_idx) GROUP BY ALL""",
    "lidar_percentiles": lidar(", ".join(r(f"quantile_cont(dist, {q})", f"range_{n}") for n, q in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)))),
    "lidar_files": f"""WITH {P}, f AS (SELECT drive, frame_idx, {", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("x", "y", "z", "reflectance"))} FROM p)
      SELECT drive, frame_idx, count(*) AS num_points, count(*) AS indexed, {", ".join(spread(c, c, "min", "max", "mean") for c in ("x", "y", "z", "reflectance"))} FROM f GROUP BY ALL""",
    "lidar_frame_sample": f"""WITH {P}, ids AS (SELECT DISTINCT drive, frame_idx FROM p), ch AS (SELECT drive, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY (frame_idx::BIGINT * 2654435761) % 4294967296, frame_idx) AS q FROM ids) WHERE q <= 5)
      SELECT drive, frame_idx, count(*) AS num_points FROM p JOIN ch USING (drive, frame_idx) GROUP BY ALL""",
    "lidar_point_sample": f"WITH {P}, {resolution(15000)} SELECT drive, frame_idx, point_key, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, {r('reflectance', 'reflectance')}, CAST(sample_rank AS INTEGER) AS sample_rank FROM s",
    "lidar_sector_plot": f"WITH {G}, c AS (SELECT drive, frame_idx, count(*) AS num_points, {SECTOR} FROM g GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT drive, frame_idx, '{n}' AS sector, sector_{n} AS points, {r(f'100.0 * sector_{n} / num_points', 'pct')} FROM c" for n in SECTORS),
    "ts_elapsed": f"WITH {T} SELECT drive, sensor, frame_idx, {r(f'(ns - first_value(ns) {ROW}) / 1e9', 'elapsed_s')} FROM t",
    "ts_intervals": f"WITH {T} SELECT drive, sensor, frame_idx, {r(f'(ns - lag(ns) {ROW}) / 1e9', 'interval_s')} FROM t",
    "ts_block_intervals": f"WITH {T} SELECT drive, sensor, frame_idx, {r(f'(ns - first_value(ns) {ROW}) / 1e9', 'elapsed_s')}, {r(f'(ns - lag(ns) {ROW}) / 1e9', 'interval_s')} FROM t",
    "drive_missing_files": f"""WITH {P}, s AS (SELECT unnest(['gray_left', 'gray_right', 'color_left', 'color_right', 'lidar', 'gps_imu']) AS sensor), g AS (SELECT drive, max(frame_idx) AS last FROM p GROUP BY drive)
      SELECT drive, sensor, 'timestamps.txt' AS file FROM g, s UNION ALL SELECT drive, sensor, 'data' FROM g, s WHERE sensor <> 'lidar'
      UNION ALL SELECT drive, 'lidar', 'data/' || lpad(CAST(i AS VARCHAR), 10, '0') || '.bin' FROM (SELECT drive, unnest(range(0, last + 1)) AS i FROM g) q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.drive = q.drive AND p.frame_idx = q.i)""",
    "ts_aligned": f"""WITH {T}, n AS (SELECT drive, max(frame_idx) AS last FROM t GROUP BY drive), sp AS (SELECT drive, sensor, CAST(unnest(range(0, last + 1)) AS INTEGER) AS frame_idx FROM (SELECT DISTINCT drive, sensor FROM t) JOIN n USING (drive))
      SELECT drive, frame_idx, count(*) AS sensors, count(ns) AS present FROM sp LEFT JOIN t USING (drive, sensor, frame_idx) GROUP BY ALL""",
    "ts_completeness": f"WITH {T}, {MISSING} SELECT drive, sensor, CAST(frames AS BIGINT) AS frames, CAST(missing AS BIGINT) AS missing FROM m",
    "ts_frame_rates": f"""WITH {T}, iv AS (SELECT drive, sensor, ns - lag(ns) {ROW} AS i FROM t)
      SELECT drive, sensor, count(*) AS num_frames, {r("sum(i)::DOUBLE / (count(i) * 1e6)", "mean_interval_ms")}, {r("stddev_samp(i) / 1e6", "std_interval_ms")}, {r("min(i) / 1e6", "min_interval_ms")}, {r("max(i) / 1e6", "max_interval_ms")},
             {r("CASE WHEN sum(i) > 0 THEN count(i) * 1e9 / sum(i)::DOUBLE ELSE 0 END", "frame_rate_hz")} FROM iv GROUP BY ALL""",
    "ts_offsets": f"WITH {T}, {OFF} SELECT drive, sensor, frame_idx, {r('off', 'offset_ms')} FROM o",
    "ts_offset_stats": f"WITH {T}, {OFF}, {OSTAT} SELECT drive, sensor, {r('mean_o', 'mean_offset_ms')}, {r('std_o', 'std_offset_ms')}, {r('drift', 'drift_ms')} FROM os",
    "ts_jitter_grade": f"{SYNC} SELECT drive, missing_total, {r('jit', 'max_jitter_ms')}, {r('dr', 'max_drift_ms')}, grade, complete FROM q",
    "ts_summary": f"""{SYNC}, n AS (SELECT drive, count(DISTINCT sensor) AS num_sensors, CAST(max(frame_idx) + 1 AS BIGINT) AS num_frames FROM t GROUP BY drive),
      d AS (SELECT drive, frame_idx + 1 AS num_frames, (ns - first_value(ns) {ROW}) / 1e9 AS el FROM t WHERE sensor = '{FIRST_SENSOR}')
      SELECT n.drive, num_sensors, n.num_frames, {r("round(el + 1e-6, 2)", "duration_sec")}, {r("round(jit + 1e-6, 2)", "max_jitter_ms")}, {r("round(dr + 1e-6, 2)", "max_drift_ms")}, missing_total, grade, complete
      FROM n JOIN q USING (drive) LEFT JOIN d ON n.drive = d.drive AND n.num_frames = d.num_frames""",
    "ts_parse": """SELECT CAST(user_id AS VARCHAR) AS drive, 'lidar' AS sensor, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
      strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS ts_raw, epoch_us(ts) * 1000 + event_id % 1000 AS ts_ns FROM events""",
    "oxts_parse": "SELECT 'packets' AS drive, CAST(vec_id AS INTEGER) AS frame_idx, " + ", ".join(f"CAST(round(embedding[{i + 1}]::DOUBLE * 1000) AS {'INTEGER' if n == 'num_sats' else 'DOUBLE'}) {'' if n == 'num_sats' else '+ 0.0'} AS {n}" for n, i in PACKET.items()) + " FROM embeddings",
    "oxts_enu": f"WITH {O} SELECT drive, frame_idx, {r('east', 'east')}, {r('north', 'north')}, {r('up', 'up')} FROM f",
    "oxts_frame": f"""WITH {O} SELECT drive, frame_idx, {r("lat", "latitude")}, {r("lon", "longitude")}, {r("alt", "altitude")}, {r("s2", "speed_2d_ms")}, {r("sqrt(vn * vn + ve * ve + vu * vu)", "speed_3d_ms")}, {r("s2 * 3.6::DOUBLE", "speed_kmh")},
      {r("degrees(roll)", "roll_deg")}, {r("degrees(pitch)", "pitch_deg")}, {r("degrees(yaw)", "yaw_deg")}, num_sats FROM f""",
    "oxts_trajectory": drive(f"count(*) AS num_frames, {r('max_by(timestamp, frame_idx) - min_by(timestamp, frame_idx)', 'duration_sec')}, {r('coalesce(sum(seg), 0)', 'total_distance_m')}, {r('max(sqrt(east * east + north * north))', 'max_displacement_m')}, {r('max(alt) - min(alt)', 'altitude_change_m')}"),
    "oxts_speed": drive(spread("s2", "speed_ms", "min", "max", "mean", "std") + ", " + spread("(s2 * 3.6::DOUBLE)", "speed_kmh", "min", "max", "mean")),
    "oxts_orientation": drive(", ".join(spread(f"degrees({a})", a, "min", "max", "range") for a in ("roll", "pitch", "yaw")) + ", " + r("max(degrees(yaw)) - min(degrees(yaw))", "heading_change_deg")),
    "oxts_accel": drive(", ".join(spread(a, a, "min", "max", "mean", "std") for a in ("ax", "ay", "az"))),
    "oxts_position_range": drive(", ".join(spread(a, n, "min", "max") for a, n in (("lat", "latitude"), ("lon", "longitude"), ("alt", "altitude")))),
    "oxts_flags": f"""WITH {O}, q AS (SELECT drive, coalesce(sum(seg), 0) > 10 AS has_significant_motion, max(degrees(yaw)) - min(degrees(yaw)) > 30 AS has_turns, min(s2) < 0.5 AS has_stops, max(s2) > 10 AS has_high_speed,
        abs(max(alt) - min(alt)) > 2 AS altitude_variation, max(s2) * 3.6 < 150 AS reasonable_speeds, max(abs(ax)) < 10 AND max(abs(ay)) < 10 AS reasonable_accelerations,
        coalesce(stddev_pop(seg) / nullif(avg(seg), 0) < 0.5, false) AS smooth_trajectory FROM sg GROUP BY drive)
      SELECT *, CASE WHEN reasonable_speeds AND reasonable_accelerations AND smooth_trajectory THEN 'GOOD' ELSE 'CHECK' END AS verdict FROM q""",
    "oxts_series": f"""WITH {O} SELECT drive, frame_idx, {r("east", "east")}, {r("north", "north")}, {r("s2 * 3.6::DOUBLE", "speed_kmh")}, {r("avg(s2 * 3.6::DOUBLE) OVER (PARTITION BY drive)", "mean_speed_kmh")}, {r("alt", "altitude")},
      {r("max(alt) OVER (PARTITION BY drive) - min(alt) OVER (PARTITION BY drive)", "altitude_range")}, {r("degrees(yaw)", "yaw_deg")} FROM f""",
    "ts_report": f"{SYNC} SELECT m.drive, grade, m.sensor, n.num_frames, CAST(m.missing AS BIGINT) AS missing FROM m JOIN q USING (drive) JOIN (SELECT drive, sensor, count(*) AS num_frames FROM t GROUP BY ALL) n ON m.drive = n.drive AND m.sensor = n.sensor",
    "calib_parse": f"""WITH {CAL}
      SELECT date, 'calib_time' AS key, NULL::VARCHAR AS nums, '09-Jan-2012 13:57:' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') AS text FROM s
      UNION ALL SELECT date, 'R', '0.0000 -1.0000 0.0000 0.0000 0.0000 -1.0000 1.0000 0.0000 0.0000', NULL FROM s
      UNION ALL SELECT date, 'T', {_d4("k / 8")} || ' -0.0800 -0.2700', NULL FROM s
      UNION ALL SELECT date, 'P_rect_02', {_d4("k + 720.5")} || ' 0.0000 609.5593 44.8573 0.0000 ' || {_d4("k + 720.5")} || ' 172.8540 0.2164 0.0000 0.0000 1.0000 0.0027', NULL FROM s
      UNION ALL SELECT date, 'R_rect_02', '1.0000 0.0000 0.0000 0.0000 1.0000 0.0000 0.0000 0.0000 1.0000', NULL FROM s
      UNION ALL SELECT date, 'S_rect_02', '1242.0000 375.0000', NULL FROM s
      UNION ALL SELECT date, 'empty', '', NULL FROM s""",
    "calib_matrices": f"""WITH {CAL} SELECT date, k + 720.5 AS fx, k + 720.5 AS fy, 609.5593::DOUBLE AS cx, 172.854::DOUBLE AS cy, 1242 AS width, 375 AS height, {r("sqrt(k / 8 * k / 8 + 0.08 * 0.08 + 0.27 * 0.27)", "t_norm")},
      0.0::DOUBLE AS m0, k / 8 AS m3, 0.0::DOUBLE AS m5, -0.08::DOUBLE AS m7, 1.0::DOUBLE AS m8, -0.27::DOUBLE AS m11, 1.0::DOUBLE AS m15 FROM s""".replace("k / 8 AS m3", r("k / 8", "m3")),
    "calib_missing": "SELECT CAST(s_suppkey AS VARCHAR) AS date, 'calib_imu_to_velo.txt' AS file FROM supplier WHERE s_nationkey % 2 <> 0",
    "calib_missing_full": "SELECT CAST(s_suppkey AS VARCHAR) AS date, 'calib_imu.txt' AS file FROM supplier",
    "calib_imu": f"""WITH {CAL} SELECT date, {r("sqrt(0.8125::DOUBLE * 0.8125 + k / 4 * k / 4 + 0.75 * 0.75)", "imu_t_norm")}, 1.0::DOUBLE AS m0, -0.8125::DOUBLE AS m3, 1.0::DOUBLE AS m5, k / 4 AS m7, 1.0::DOUBLE AS m10, -0.75::DOUBLE AS m11, 1.0::DOUBLE AS m15
      FROM s JOIN supplier USING (s_suppkey) WHERE s_nationkey % 2 = 0""",
    "calib_transforms": f"""WITH {CAL} SELECT date, {r("k / 8", "lidar_x")}, -1.0::DOUBLE AS lidar_r01, CASE WHEN s_nationkey % 2 = 0 THEN -0.8125::DOUBLE END AS imu_x, CASE WHEN s_nationkey % 2 = 0 THEN k / 4 END AS imu_y, CASE WHEN s_nationkey % 2 = 0 THEN 1.0::DOUBLE END AS imu_r00,
      k + 701.5 AS k11, -0.5::DOUBLE AS d4, k + 720.5 AS p00, 1242 AS width, 375 AS height FROM s JOIN supplier USING (s_suppkey)""",
    "calib_summary": f"""WITH {CAL} SELECT date, 1242 AS width, 375 AS height, k + 720.5 AS fx, k + 720.5 AS fy, 609.5593::DOUBLE AS cx, 172.854::DOUBLE AS cy, {r("sqrt(k / 8 * k / 8 + 0.08 * 0.08 + 0.27 * 0.27)", "lidar_to_camera_m")},
      CASE WHEN s_nationkey % 2 = 0 THEN {r("sqrt(0.8125::DOUBLE * 0.8125 + k / 4 * k / 4 + 0.75 * 0.75)", "x").removesuffix(" AS x")} END AS imu_to_lidar_m FROM s JOIN supplier USING (s_suppkey)""",
    "proj_points": f"WITH {PROJ} SELECT drive, frame_idx, point_key, {r('u', 'u')}, {r('v', 'v')}, {r('depth', 'depth')} FROM j",
    "proj_by_date": f"""WITH {P}, {CAL}, c AS (SELECT date, -y + k / 8 AS cx, -z - 0.08::DOUBLE AS cy, x - 0.27::DOUBLE AS cz, k + 720.5 AS fl FROM p JOIN s ON s.date = CAST(point_key % 10 AS VARCHAR)),
      q AS (SELECT date, (fl * cx + 609.5593::DOUBLE * cz + 44.85728::DOUBLE) / (cz + 0.002745884::DOUBLE) AS u, (fl * cy + 172.854::DOUBLE * cz + 0.2163791::DOUBLE) / (cz + 0.002745884::DOUBLE) AS v, cz AS depth FROM c WHERE cz > 0)
      SELECT date, count(*) AS n, {r("avg(u)", "u_mean")}, {r("avg(v)", "v_mean")}, {r("avg(depth)", "depth_mean")} FROM q WHERE u >= 0 AND u < {W} AND v >= 0 AND v < {H} GROUP BY date""",
    "proj_quality": quality(
        f"total_points, nf AS in_front_count, count(u) AS points_in_image, count(u) AS points_in_camera_fov, {r(RATE, 'fov_rate')}, {r(RATE, 'image_rate')}, {spread('depth', 'depth', 'min', 'max', 'mean', 'median', 'std', 'p25', 'p75')}, "
        f"{RATE} > 60 AS sufficient_projection_rate, {COV[0]} > 90 AS good_horizontal_coverage, {COV[1]} > 50 AS good_vertical_coverage, coalesce(avg(depth) < 30, false) AS balanced_depth_distribution"
    ),
    "proj_depth_hist": quality(bins("depth", "depth_bin")),
    "proj_coverage": quality(f"{r(COV[0], 'horizontal_coverage')}, {r(COV[1], 'vertical_coverage')}"),
    "proj_bands": quality(_bands()),
    "region_frame": f"WITH {REGION} SELECT drive, frame_idx, n AS point_count, {r('a', 'avg_depth')}, {r('s', 'std_depth')}, {r('lo', 'min_depth')}, {r('hi', 'max_depth')} FROM rg",
    "region_temporal": f"""WITH {REGION}, q AS (SELECT drive, count(*) AS num_frames, avg(n) AS cm, stddev_pop(n) AS cs, min(n) AS count_min, max(n) AS count_max, coalesce(avg(a) FILTER (WHERE a > 0), 0) AS dm, coalesce(stddev_pop(a) FILTER (WHERE a > 0), 0) AS ds FROM rg GROUP BY drive),
      w AS (SELECT *, CASE WHEN cm > 0 THEN cs * 100 / cm ELSE 0 END AS cc, CASE WHEN dm > 0 THEN ds * 100 / dm ELSE 0 END AS dc FROM q)
      SELECT drive, num_frames, {r("cm", "count_mean")}, {r("cs", "count_std")}, count_min, count_max, {r("dm", "depth_mean")}, {r("ds", "depth_std")}, {r("cc", "count_cv")}, {r("dc", "depth_cv")}, cc < 20 AS consistent_count, dc < 10 AS stable_depth, count_min > 0 AS always_visible FROM w""",
    "region_grid": f"""WITH {PROJ} SELECT drive, frame_idx, n_name AS region, count(*) AS point_count, {r("avg(depth)", "avg_depth")} FROM j JOIN nation ON u >= n_nationkey * 50 AND u <= n_nationkey * 50 + 60 AND v >= 50 AND v <= 320 GROUP BY ALL""",
    "fusion_motion_join": f"""WITH {REGION}, {O.replace("o AS (", "oo AS (", 1).replace("FROM o WINDOW", "FROM oo WINDOW")}
      SELECT rg.drive, rg.frame_idx, rg.n AS point_count, {r("s2 * 3.6::DOUBLE", "speed_kmh")}, {r("degrees(yaw)", "yaw_deg")} FROM rg LEFT JOIN f ON rg.drive = 'drive_' || f.drive AND rg.frame_idx = f.frame_idx""",
    "fusion_overlay": f"WITH {PROJ} SELECT drive, frame_idx, count(*) AS n, {spread('(least(greatest(depth, 0), 50) / 50)', 'shade', 'min', 'max', 'mean')} FROM j GROUP BY ALL",
    "fusion_overlay_frames": f"WITH {PROJ}, mm AS (SELECT drive, frame_idx, min(depth) AS lo, max(depth) AS hi FROM j GROUP BY ALL) SELECT drive, frame_idx, count(*) AS n, {spread('coalesce((depth - lo) / nullif(hi - lo, 0), 0)', 'shade', 'min', 'max', 'mean')} FROM j JOIN mm USING (drive, frame_idx) GROUP BY ALL",
    "fusion_zbuffer": f"WITH {PROJ} SELECT drive, frame_idx, CAST(floor(u) AS INTEGER) AS px, CAST(floor(v) AS INTEGER) AS py, {r('min(depth)', 'depth')}, count(*) AS hits FROM j GROUP BY ALL",
    "fusion_images": f"""WITH {PROJ}, z AS (SELECT drive, frame_idx, floor(u) AS px, floor(v) AS py, min(depth) AS depth FROM j GROUP BY ALL)
      SELECT drive, frame_idx, CAST({W} AS BIGINT) AS width, CAST({H} AS BIGINT) AS height, count(*) AS lit, CAST(sum(255 - floor(least(greatest(depth, 0), 50) / 50 * 254 + 0.5)) AS BIGINT) AS total FROM z GROUP BY ALL""",
    "fusion_image_join": f"""WITH {PROJ}, sz AS (SELECT 'drive_' || CAST(vec_id % 3 AS VARCHAR) AS drive, CAST(vec_id AS INTEGER) AS frame_idx, CAST(1000 + label * 50 AS INTEGER) AS width FROM embeddings WHERE vec_id % 10 <> 7)
      SELECT drive, frame_idx, 'image_02' AS camera_id, width, count(*) AS n, {spread('u', 'u', 'max', 'mean')}, {spread('depth', 'depth', 'mean')} FROM fr JOIN sz USING (drive, frame_idx) WHERE u >= 0 AND u < width AND v >= 0 AND v < 375 GROUP BY ALL""",
    "cam_brightness": f"WITH {I} SELECT drive, frame_idx, {spread('v', 'brightness', 'min', 'max', 'mean', 'std', 'median')}, {r('stddev_pop(v)', 'contrast')}, {r('max(v) - min(v)', 'dynamic_range')} FROM px GROUP BY ALL",
    "cam_exposure": f"WITH {I}, {EXPO} SELECT drive, frame_idx, {r('over', 'overexposed_pct')}, {r('under', 'underexposed_pct')}, {r('100 - over - under', 'exposure_quality')} FROM ex",
    "cam_sharpness": f"WITH {I}, {lap(8, 'lum', 'i', 'drive, frame_idx')} SELECT drive, frame_idx, {r('sharp', 'sharpness')} FROM sh",
    "cam_lum_hist": f"WITH {I} SELECT drive, frame_idx, CAST(least(floor(v / 5.1::DOUBLE), 49) AS INTEGER) AS bin, count(*) AS n FROM px WHERE v BETWEEN 0 AND 255 GROUP BY ALL",
    "cam_kernel_brightness": f"WITH {TILE} SELECT frame_idx, {spread('v', 'brightness', 'min', 'max', 'mean', 'std', 'median')}, {r('100.0 * count(*) FILTER (WHERE v > 240) / count(*)', 'overexposed_pct')}, {r('100.0 * count(*) FILTER (WHERE v < 15) / count(*)', 'underexposed_pct')} FROM px GROUP BY frame_idx",
    "cam_kernel_sharpness": f"WITH {TILE}, {lap(32, 'lum', 'im', 'frame_idx')} SELECT frame_idx, {r('sharp', 'sharpness')} FROM sh",
    "cam_colour": f"""WITH RECURSIVE {COLOUR}, {GRADIENT}, {CANNY}, {lap(32, 'lum', 'im', 'frame_idx')},
      li AS (SELECT frame_idx, {spread('v', 'brightness', 'min', 'max', 'mean', 'std', 'median')}, {r('100.0 * count(*) FILTER (WHERE v > 240) / count(*)', 'overexposed_pct')}, {r('100.0 * count(*) FILTER (WHERE v < 15) / count(*)', 'underexposed_pct')} FROM px GROUP BY frame_idx)
      SELECT {CAM}, 'image_02' AS camera_id, li.* EXCLUDE (frame_idx), {r('sharp', 'sharpness')}, canny.n AS edge_pixels FROM li JOIN sh USING (frame_idx) JOIN canny USING (frame_idx)""",
    "cam_colour_flags": f"""WITH {COLOUR}, {lap(32, 'lum', 'im', 'frame_idx')},
      li AS (SELECT frame_idx, avg(v) AS me, stddev_pop(v) AS sd, max(v) - min(v) AS dr, 100.0 * count(*) FILTER (WHERE v > 240) / count(*) AS ov, 100.0 * count(*) FILTER (WHERE v < 15) / count(*) AS un FROM px GROUP BY frame_idx)
      SELECT {CAM}, {r('me', 'brightness_mean')}, {r('sd', 'contrast')}, {r('dr', 'dynamic_range')}, ov < 5 AND un < 10 AS good_exposure, sd >= 30 AS sufficient_contrast, sharp >= 100 AS sharp_image FROM li JOIN sh USING (frame_idx)""",
    "cam_canny": f"WITH RECURSIVE {TILE}, {GRADIENT}, {CANNY} SELECT {CAM}, n AS edge_pixels, {r('100.0 * n / 1024', 'edge_density')} FROM canny",
    "cam_harris": f"WITH {TILE}, {GRADIENT}, {PRODUCTS}, {HARRIS} SELECT {CAM}, n AS harris_corners FROM harris",
    "cam_shi_tomasi": f"WITH RECURSIVE {TILE}, {GRADIENT}, {PRODUCTS}, {SHI} SELECT {CAM}, n AS shi_tomasi_corners FROM shi",
    "cam_fast": f"WITH {TILE}, {ORB} SELECT {CAM}, n AS fast_keypoints FROM fast",
    "cam_orb": f"WITH {TILE}, {ORB} SELECT {CAM}, n AS orb_keypoints FROM orb",
    "cam_oriented_keypoints": oriented(),
    "cam_tiled_metrics": tiled(),
    "cam_features": f"{ALL_KERNELS} SELECT {CAM}, canny.n AS edge_pixels, {r('100.0 * canny.n / 1024', 'edge_density')}, harris.n AS harris_corners, fast.n AS fast_keypoints, shi.n AS shi_tomasi_corners, orb.n AS orb_keypoints FROM {JOINED}",
    "cam_method_plot": f"{ALL_KERNELS}, one AS MATERIALIZED (SELECT frame_idx, {', '.join(f'{n} AS {m}_n' for m, n in DETECTORS.items())} FROM {JOINED}) " + " UNION ALL ".join(f"SELECT {CAM}, '{m}' AS method, {m}_n AS n FROM one" for m in DETECTORS),
    "cam_feature_strips": f"""WITH {TILE}, {ORB}, st AS (SELECT frame_idx, unnest(range(0, 5)) AS strip FROM im), ct AS (SELECT frame_idx, least(CAST(floor(oy) AS BIGINT) // 6, 4) AS strip, count(*) AS m FROM kp WHERE inside GROUP BY ALL)
      SELECT 'cam' AS drive, st.frame_idx, CAST(st.strip AS INTEGER) AS strip, coalesce(m, 0) AS n, {r("coalesce(100.0 * m / nullif(orb.n, 0), 0)", "pct")} FROM st JOIN orb USING (frame_idx) LEFT JOIN ct ON ct.frame_idx = st.frame_idx AND ct.strip = st.strip""",
    "cam_keypoint_grid": f"""WITH {TILE}, {ORB}, q AS (SELECT frame_idx, ox, oy, min(ox) OVER w AS x0, max(ox) OVER w AS x1, min(oy) OVER w AS y0, max(oy) OVER w AS y1 FROM kp WHERE inside WINDOW w AS (PARTITION BY frame_idx)),
      c AS (SELECT frame_idx, CAST(least(coalesce(floor((ox - x0) * 50 / nullif(x1 - x0, 0)), 25), 49) AS INTEGER) AS gx, CAST(least(coalesce(floor((oy - y0) * 15 / nullif(y1 - y0, 0)), 7), 14) AS INTEGER) AS gy FROM q)
      SELECT {CAM}, gx, gy, count(*) AS n FROM c GROUP BY ALL""",
    "cam_flags": f"""WITH RECURSIVE {TILE}, {GRADIENT}, {CANNY}, {ORB}, {LIGHT}, q AS (SELECT frame_idx, ov < 5 AND un < 10 AS good_exposure, sd >= 30 AS sufficient_contrast, sharp >= 100 AS sharp_image, 100.0 * canny.n / 1024 >= 2 AS sufficient_edges, orb.n >= 500 AS sufficient_features
        FROM li JOIN sg USING (frame_idx) JOIN canny USING (frame_idx) JOIN orb USING (frame_idx))
      SELECT 'cam' AS drive, *, CASE WHEN good_exposure AND sufficient_contrast AND sharp_image AND sufficient_edges AND sufficient_features THEN 'GOOD' ELSE 'CHECK' END AS verdict FROM q""",
    "cam_sequence": camera_sequence("'cam' AS drive"),
    "cam_sequence_full": camera_sequence("'image_00' AS camera_id"),
}
SQL |= {
    "lidar_spatial_resolution_full": SQL["lidar_spatial_resolution"],  # frames here hold fewer points than either sample
    "lidar_sequence_full": SQL["lidar_sequence"],
    "lidar_json_reports": SQL["lidar_sequence"],
    "lidar_point_sample_full": SQL["lidar_point_sample"],
}
_RANGES = {"latitude": "lat", "longitude": "lon", "altitude": "alt"}
_MOTION = ", ".join(
    [
        f"count(*) AS num_frames, {r('max_by(timestamp, frame_idx) - min_by(timestamp, frame_idx)', 'duration_sec')}, {r('coalesce(sum(seg), 0)', 'total_distance_m')}, {r('max(sqrt(east * east + north * north))', 'max_displacement_m')}, {r('max(alt) - min(alt)', 'altitude_change_m')}",
        *(spread(e, n, "min", "max") for n, e in _RANGES.items()),
        spread("s2", "speed_ms", "min", "max", "mean", "std"),
        spread("(s2 * 3.6::DOUBLE)", "speed_kmh", "min", "max", "mean"),
        *(spread(f"degrees({a})", a, "min", "max", "range") for a in ("roll", "pitch", "yaw")),
        *(spread(a, a, "min", "max", "mean", "std") for a in ("ax", "ay", "az")),
        r("max(degrees(yaw)) - min(degrees(yaw))", "heading_change_deg"),
    ]
)
_GPS = f"SELECT m.*, q.* EXCLUDE (drive, verdict) FROM ({drive(_MOTION)}) m JOIN ({SQL['oxts_flags']}) q USING (drive)"
_FUSION = quality(
    f"total_points, nf AS in_front_count, count(u) AS points_in_image, count(u) AS points_in_camera_fov, {r(RATE, 'fov_rate')}, {r(RATE, 'image_rate')}, {spread('depth', 'depth', 'min', 'max', 'mean', 'median', 'std', 'p25', 'p75')}, {bins('depth', 'depth_bin')}, "
    f"{r(COV[0], 'horizontal_coverage')}, {r(COV[1], 'vertical_coverage')}, {_bands()}, {RATE} > 60 AS sufficient_projection_rate, {COV[0]} > 90 AS good_horizontal_coverage, {COV[1]} > 50 AS good_vertical_coverage, coalesce(avg(depth) < 30, false) AS balanced_depth_distribution"
)


def digest(source: str, sql: str, *left_out: str) -> str:
    """(source, metric, n, mean, least, most) of the columns of a query."""
    return f"""SELECT '{source}' AS source, metric, count(value) AS n, {r("avg(value)", "mean")}, {r("min(value)", "least")}, {r("max(value)", "most")}
      FROM (SELECT CAST(COLUMNS(* EXCLUDE ({", ".join(left_out)})) AS DOUBLE) FROM ({sql})) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*))) GROUP BY metric"""


SQL["run_summary"] = " UNION ALL ".join(
    [
        digest("timestamps", SQL["ts_jitter_grade"], "drive", "grade"),
        digest("lidar", SQL["lidar_frame_metrics"], "drive", "frame_idx"),
        digest("fusion", _FUSION, "drive", "frame_idx"),
        digest("gps_imu", _GPS, "drive"),
        digest("camera", SQL["cam_sequence"], "drive"),
    ]
)
