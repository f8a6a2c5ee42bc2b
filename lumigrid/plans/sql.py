"""SQL statements of the catalogue's results, for another engine to check."""

from __future__ import annotations

import math

import numpy as np

from lumigrid.model import CHANNELS, COLOUR, NORMAL, POSITION, Camera

#: Logarithm of the sum of k^n / (n! (2 n + 1)), the Watson normaliser in three dimensions.
LOG_M = lambda k: math.log(sum(k**n / (math.factorial(n) * (2 * n + 1)) for n in range(120)))
_E = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(9)]
_NORM = f"sqrt({_E[6]} * {_E[6]} + {_E[7]} * {_E[7]} + {_E[8]} * {_E[8]})"
_CHANNELS = (
    ", ".join(f"{_E[i]} AS c{i + 1}" for i in range(3))
    + f", {_E[3]} AS x, {_E[4]} AS y, 2 + {_E[5]} AS z, "
    + ", ".join(f"{_E[6 + i]} / {_NORM} AS {n}" for i, n in enumerate(NORMAL))
)
PX = f"""px AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST((vec_id % 20) * h + vec_id // 20 + 1 AS BIGINT) AS pid,
  CAST(vec_id // 20 + 1 AS INTEGER) AS "row", CAST(vec_id % 20 + 1 AS INTEGER) AS col, {_CHANNELS}, label
  FROM embeddings, (SELECT count(*) // 20 AS h FROM embeddings))"""
PM = f"""pm AS (SELECT vec_id // 100 AS image_id, CAST((vec_id % 10) * 10 + vec_id % 100 // 10 + 1 AS BIGINT) AS pid,
  CAST(vec_id % 100 // 10 + 1 AS INTEGER) AS "row", CAST(vec_id % 10 + 1 AS INTEGER) AS col, {_CHANNELS}, label FROM embeddings)"""
PE = """pe AS (SELECT event_id // 1000 AS image_id, CAST(event_id % 1000 % 40 * 25 + event_id % 1000 // 40 + 1 AS BIGINT) AS pid,
  CAST(event_id % 1000 // 40 + 1 AS INTEGER) AS "row", CAST(event_id % 1000 % 40 + 1 AS INTEGER) AS col,
  CAST(value AS DOUBLE) / 500 AS c1, 1 + CAST(value AS DOUBLE) / 100 AS z, CAST(user_id % 8 + 1 AS INTEGER) AS label FROM events)"""
BL = """bl AS (SELECT * REPLACE (CAST(("row" // 5) * 4 + col // 5 AS INTEGER) AS label) FROM px)"""
MR = """mr AS (SELECT event_id AS image_id, event_type AS algorithm, 'm' || CAST(user_id % 7 AS VARCHAR) AS metric,
  CASE WHEN event_id % 11 <> 0 THEN CAST(value AS DOUBLE) END AS value FROM events)"""


def r(x: str, name: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0 AS {name}"


def rs(names, n: int = 6) -> str:
    return ", ".join(r(c, c, n) for c in names)


def select(table: str, keys: str, *names: str) -> str:
    return f"WITH {PX} SELECT {keys}, {rs(names)} FROM {table}"


def squares(names, a: str = "a", b: str = "b") -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in names)


def offsets(pairs) -> str:
    return "(VALUES " + ", ".join(f"({i}, {j})" for i, j in pairs) + ") AS o(dr, dc)"


def window(w: int):
    return [(i, j) for i in range(-w, w + 1) for j in range(-w, w + 1)]


HALF = ((1, 0), (-1, 1), (0, 1), (1, 1))


def near(table: str, pairs, clamp: bool = False) -> str:
    """Pixels ``a`` with their neighbours ``b``."""
    if clamp:
        size = f'(SELECT image_id, max("row") AS h, max(col) AS w FROM {table} GROUP BY image_id) AS s'
        return (
            f"{table} AS a JOIN {size} ON s.image_id = a.image_id CROSS JOIN {offsets(pairs)} JOIN {table} AS b ON b.image_id = a.image_id "
            'AND b."row" = greatest(1, least(a."row" + dr, h)) AND b.col = greatest(1, least(a.col + dc, w))'
        )
    return f'{table} AS a CROSS JOIN {offsets(pairs)} JOIN {table} AS b ON b.image_id = a.image_id AND b."row" = a."row" + dr AND b.col = a.col + dc'


EDGES = f", e AS (SELECT a.image_id, a.pid AS src, b.pid AS dst FROM {near('px', HALF)})"
_LEN = lambda p="": f"sqrt({p}nx * {p}nx + {p}ny * {p}ny + {p}nz * {p}nz)"
_SUM = ", ".join(f"a.{c} + b.{c} AS {c}" for c in CHANNELS)
ELEMENT_SUM = f"""WITH {PX}, s AS (SELECT a.image_id, a.pid, {_SUM} FROM px a JOIN px b ON b.pid = a.pid + 1)
SELECT image_id, pid, {rs(COLOUR + POSITION)}, {", ".join(r(f"{n} / nullif({_LEN()}, 0)", n) for n in NORMAL)} FROM s"""
ELEMENT_HALF = f"WITH {PX} SELECT image_id, pid, {', '.join(r(f'{c} / 2', c) for c in COLOUR + POSITION)}, {', '.join(r(f'{n} / {_LEN()}', n) for n in NORMAL)} FROM px"
ASSEMBLED = f'WITH {PX} SELECT image_id, "row", col, {rs(CHANNELS)} FROM px'
DEPTH = f"""WITH {PX} SELECT image_id, pid, {r("(col - 313.04475870804731) * z / 582.62448167737955", "x")},
  {r('("row" - 238.44389626620386) * z / 582.69103270988637', "y")}, {r("z", "z")} FROM px"""
MASK = f'WITH {PX} SELECT image_id, pid, "row" BETWEEN 3 AND 20 AND col BETWEEN 4 AND 17 AS inside FROM px'


def _f(t: str, exponent: str) -> str:
    return f"CASE WHEN {t} > 0.008856 THEN pow({t}, {exponent}) ELSE 7.787 * {t} + 16.0 / 116 END"


_LIN = lambda c: f"100 * CASE WHEN abs({c}) > 0.04045 THEN pow((abs({c}) + 0.055) / 1.055, 2.4) ELSE abs({c}) / 12.92 END"
LAB = f"""WITH {PX}, l AS (SELECT image_id, pid, {_LIN("c1")} AS r, {_LIN("c2")} AS g, {_LIN("c3")} AS b FROM px),
w AS (SELECT image_id, pid, (0.4124 * r + 0.3576 * g + 0.1805 * b) / 95.047 AS x, (0.2126 * r + 0.7152 * g + 0.0722 * b) / 100 AS y, (0.0193 * r + 0.1192 * g + 0.9505 * b) / 108.883 AS z FROM l),
f AS (SELECT image_id, pid, {_f("x", "0.3333333333333333")} AS x, {_f("y", "0.3333333333333333")} AS y, {_f("z", "0.3333333333333333")} AS z FROM w)
SELECT image_id, pid, {r("116 * y - 16", "c1")}, {r("500 * (x - y)", "c2")}, {r("200 * (y - z)", "c3")} FROM f"""
LAB_IMAGE = f"""WITH {PM}, q AS (SELECT image_id, pid, 4 * abs(c1) AS r, 4 * abs(c2) AS g, 4 * abs(c3) AS b FROM pm),
t AS (SELECT *, CASE WHEN max(greatest(r, g, b)) OVER (PARTITION BY image_id) > 1 THEN 255.0 ELSE 1.0 END AS k FROM q),
w AS (SELECT image_id, pid, (0.412453 * r + 0.357580 * g + 0.180423 * b) / k / 0.950456 AS x, (0.212671 * r + 0.715160 * g + 0.072169 * b) / k AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / k / 1.088754 AS z FROM t),
f AS (SELECT image_id, pid, y AS v, {_f("x", "1.0 / 3")} AS x, {_f("y", "1.0 / 3")} AS y, {_f("z", "1.0 / 3")} AS z FROM w)
SELECT image_id, pid, {r("CASE WHEN v > 0.008856 THEN 116 * pow(v, 1.0 / 3) - 16 ELSE 903.3 * v END", "c1")}, {r("500 * (x - y)", "c2")}, {r("200 * (y - z)", "c3")} FROM f"""
CROP = f"""WITH {PX}, s AS (SELECT *, max("row") OVER () AS h, max(col) OVER () AS w FROM px)
SELECT image_id, CAST((col - 3) * (h - 5) + "row" - 2 AS BIGINT) AS pid, "row" - 2 AS "row", col - 2 AS col, label + 1 AS label
FROM s WHERE "row" BETWEEN 3 AND h - 3 AND col BETWEEN 3 AND w - 3"""
_SPREAD = lambda names: " + ".join(f"stddev_samp({c})" for c in names)
SCALED = f"""WITH {PX}, s AS (SELECT 3 / ({_SPREAD(COLOUR)}) AS sc, 0.1 * 3 / ({_SPREAD(POSITION)}) AS sp FROM px)
SELECT image_id, pid, {", ".join(r(f"{c} * sc", c) for c in COLOUR)}, {", ".join(r(f"{c} * sp", c) for c in POSITION)} FROM px, s"""
_T = ("nx * nx", "ny * ny", "nz * nz", "sqrt(2) * nx * ny", "sqrt(2) * nx * nz", "sqrt(2) * ny * nz")
STATISTICS = f"""WITH {PX} SELECT image_id, pid, {r("-c1 * c1", "c1_c1")}, {r("-c1 * c2", "c1_c2")}, {r("-c3 * c3", "c3_c3")}, {r("-x * x", "x_x")}, {r("-y * z", "y_z")}, {r("-z * z", "z_z")},
  {", ".join(r(t, f"t{i + 1}") for i, t in enumerate(_T))} FROM px"""
PAINTED = f"""WITH {PX}, m AS (SELECT label, avg(c1) AS p1, avg(c2) AS p2, avg(c3) AS p3 FROM px GROUP BY label)
SELECT image_id, label, pid, {rs(("p1", "p2", "p3"))} FROM px JOIN m USING (label)"""
_TARGET = lambda s: (
    f't AS (SELECT s.image_id, s.h, s.w, s.th, tr.v AS trow, tc.v AS tcol FROM (SELECT image_id, max("row") AS h, max(col) AS w, CAST(floor(max("row") * {s}) AS INTEGER) AS th, CAST(floor(max(col) * {s}) AS INTEGER) AS tw FROM px GROUP BY image_id) s, '
    "(SELECT CAST(unnest(range(1, 2000)) AS INTEGER) AS v) tr, (SELECT CAST(unnest(range(1, 2000)) AS INTEGER) AS v) tc WHERE tr.v <= th AND tc.v <= tw)"
)
NEAREST = f"""WITH {PX}, {_TARGET(0.5)}
SELECT t.image_id, CAST((tcol - 1) * th + trow AS BIGINT) AS pid, trow AS "row", tcol AS col, {r("c1", "c1")}, {r("z", "z")}, label
FROM t JOIN px p ON p."row" = CAST(floor((trow - 0.5) / 0.5) + 1 AS INTEGER) AND p.col = CAST(floor((tcol - 0.5) / 0.5) + 1 AS INTEGER)"""
_WT = "(CASE WHEN dr = 1 THEN fr ELSE 1 - fr END) * (CASE WHEN dc = 1 THEN fc ELSE 1 - fc END)"
BILINEAR = f"""WITH {PX}, {_TARGET(0.4)},
u AS (SELECT *, (trow - 0.5::DOUBLE) / 0.4::DOUBLE + 0.5::DOUBLE AS p, (tcol - 0.5::DOUBLE) / 0.4::DOUBLE + 0.5::DOUBLE AS q FROM t),
v AS (SELECT *, CAST(floor(p) AS INTEGER) AS r0, CAST(floor(q) AS INTEGER) AS q0, p - floor(p) AS fr, q - floor(q) AS fc FROM u)
SELECT v.image_id, CAST((tcol - 1) * th + trow AS BIGINT) AS pid, trow AS "row", tcol AS col, {r(f"sum({_WT} * c1)", "c1")}, {r(f"sum({_WT} * z)", "z")}, {r(f"sum({_WT} * nx)", "nx")},
  CAST(round_even(sum({_WT} * label), 0) AS INTEGER) AS label
FROM v CROSS JOIN {offsets(((0, 0), (0, 1), (1, 0), (1, 1)))} JOIN px b ON b."row" = greatest(1, least(r0 + dr, h)) AND b.col = greatest(1, least(q0 + dc, w))
GROUP BY v.image_id, th, trow, tcol"""
_DOT = "a.nx * b.nx + a.ny * b.ny + a.nz * b.nz"
_W = f"""SELECT a.image_id, a.pid AS src, b.pid AS dst, sqrt({squares(COLOUR)}) AS w_rgb, sqrt({squares(POSITION)}) AS w_xyz,
  acos(greatest(0.0, least(1.0, {_DOT}))) AS w_n FROM {near("px", HALF)}"""
WEIGHTS = f"WITH {PX}, w AS ({_W}) SELECT image_id, src, dst, {rs(('w_rgb', 'w_xyz', 'w_n'))} FROM w"
BY_RGB = f"""WITH {PX}, w AS ({_W}), e AS (SELECT image_id, src, dst, {r('w_rgb', 'w_rgb')} FROM w)
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w_rgb, src, dst) AS rank FROM e"""
_DEPTH = lambda t: f"FROM {near('px', window(2))} WHERE abs(b.z - a.z) {t} GROUP BY a.image_id, a.pid"
NEIGHBOURS = f"WITH {PX} SELECT a.image_id, a.pid, count(*) AS n {_DEPTH('< a.z * 0.05')}"
ABSOLUTE = f"WITH {PX} SELECT a.image_id, a.pid, count(*) AS n {_DEPTH('<= 0.05')}"
_MOM = ", ".join(r(f"sum(b.{p[0]} * b.{p[1]})", f"s{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")) + ", " + ", ".join(r(f"sum(b.{c})", f"s{c}") for c in POSITION)
MOMENTS = f"WITH {PX} SELECT a.image_id, a.pid, {_MOM}, count(*) AS n {_DEPTH('< a.z * 0.05')} HAVING count(*) >= 3"
EVENT_MOMENTS = f"WITH {PE} SELECT a.image_id, a.pid, count(*) AS n, {r('sum(b.z)', 'sz')} FROM {near('pe', window(1))} WHERE abs(b.z - a.z) < a.z * 0.2 GROUP BY a.image_id, a.pid"
FILLED = f"""WITH {PX}, h AS (SELECT image_id, pid, "row", col, {", ".join(f"CASE WHEN pid % 7 = 0 THEN 0.0 ELSE {n} END AS {n}" for n in NORMAL)} FROM px),
s AS (SELECT a.image_id, a.pid, sum(b.nx) AS nx, sum(b.ny) AS ny, sum(b.nz) AS nz FROM {near("h", window(1))} WHERE {_LEN("a.")} < 1e-6 GROUP BY a.image_id, a.pid)
SELECT h.image_id, h.pid, {", ".join(r(f"coalesce(s.{n} / {_LEN('s.')}, h.{n})", n) for n in NORMAL)} FROM h LEFT JOIN s USING (image_id, pid)"""
MEDIAN = f"WITH {PX} SELECT a.image_id, a.pid, CAST(median(b.label) AS INTEGER) AS label FROM {near('px', window(1), True)} GROUP BY a.image_id, a.pid"


def _gradient(table: str, names) -> str:
    k = lambda x, y: f"{x} * (2 - abs({y}))"
    g = ", ".join(f"sqrt(pow(sum({k('dc', 'dr')} * b.{c}), 2) + pow(sum({k('dr', 'dc')} * b.{c}), 2)) AS g_{c}" for c in names)
    most = f"greatest({', '.join('g_' + c for c in names)})" if len(names) > 1 else f"g_{names[0]}"
    return f"g0 AS (SELECT a.image_id, a.pid, {g} FROM {near(table, window(1), True)} GROUP BY a.image_id, a.pid), g AS (SELECT *, {most} / max({most}) OVER (PARTITION BY image_id) AS mog FROM g0)"


SOBEL = f"WITH {PX}, {_gradient('px', ['c1', 'z'])} SELECT image_id, pid, {rs(('g_c1', 'g_z', 'mog'))} FROM g"
_BD = f"bd AS (SELECT DISTINCT a.image_id, a.pid, unnest([a.label, b.label]) AS label FROM {near('bl', window(1))} WHERE a.label <> b.label)"
BOUNDARIES = f"WITH {PX}, {BL}, {_BD} SELECT image_id, pid, label FROM bd"
_MEANS = ", ".join(r(f"avg({c})", f"m{c}") for c in COLOUR + POSITION)
_NL = "sqrt(sum(nx) * sum(nx) + sum(ny) * sum(ny) + sum(nz) * sum(nz))"
SUMMARY = f"WITH {PX} SELECT image_id, label, count(*) AS cnt, {_MEANS}, {', '.join(r(f'sum({n}) / nullif({_NL}, 0)', f'm{n}') for n in NORMAL)} FROM px GROUP BY image_id, label"
AREAS = f"WITH {PE} SELECT image_id, label, count(*) AS cnt, {r('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY image_id)', 'share')} FROM pe GROUP BY image_id, label"
WATSON_MEANS = f"WITH {PX} SELECT image_id, label, {', '.join(r(f'avg({t})', f't{i + 1}') for i, t in enumerate(_T))}, count(*) AS cnt FROM px GROUP BY image_id, label"
_ADJ = lambda t: f"SELECT a.image_id, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS n_edges FROM {near(t, HALF)} WHERE a.label <> b.label GROUP BY 1, 2, 3"
ADJACENCY = f"WITH {PX} {_ADJ('px')}"
STRENGTH = f"""WITH {PX}, {BL}, {_BD}, {_gradient("bl", ["c1"])}
SELECT l.image_id, l.label AS a, q.label AS b, {r("avg(mog)", "wb")}, count(*) AS n FROM bd l JOIN bd q ON q.image_id = l.image_id AND q.pid = l.pid AND l.label < q.label
JOIN g ON g.image_id = l.image_id AND g.pid = l.pid GROUP BY 1, 2, 3"""
_FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))
COMPONENTS = lambda cte, t: f"""WITH RECURSIVE {cte}, same AS (SELECT a.image_id, a.pid AS a, b.pid AS b FROM {near(t, _FOUR)} WHERE a.label = b.label),
reach(image_id, pid, other) AS (SELECT image_id, pid, pid FROM {t} UNION SELECT r.image_id, r.pid, s.b FROM reach r JOIN same s ON s.image_id = r.image_id AND s.a = r.other),
root AS (SELECT image_id, pid, min(other) AS root FROM reach GROUP BY 1, 2)
SELECT image_id, pid, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM root"""  # noqa: E731
RENUMBERED = f"""WITH {PX}, f AS (SELECT label, dense_rank() OVER (ORDER BY min(pid)) AS n FROM px GROUP BY label)
SELECT image_id, pid, CAST(n AS INTEGER) AS label FROM px JOIN f USING (label)"""
PRUNED = f"""WITH {PX}, n AS (SELECT label, count(*) AS cnt FROM px GROUP BY label), adj AS ({_ADJ("px")}),
p AS (SELECT a AS label, b AS near FROM adj UNION ALL SELECT b, a FROM adj),
i AS (SELECT p.label, near, row_number() OVER (PARTITION BY p.label ORDER BY m.cnt DESC, near) AS k FROM p JOIN n m ON m.label = p.near JOIN n o ON o.label = p.label WHERE o.cnt < 50)
SELECT image_id, pid, "row", col, coalesce(near, px.label) AS label FROM px LEFT JOIN (SELECT * FROM i WHERE k = 1) i ON i.label = px.label"""


def assign(centres, update: bool = False) -> str:
    def far(names, c):
        return "sqrt(" + " + ".join(f"({n} - ({c[n]})) * ({n} - ({c[n]}))" for n in names) + ")"

    def one(c):
        dot = " + ".join(f"{n} * ({c[n]})" for n in NORMAL)
        size = math.sqrt(sum(c[n] ** 2 for n in NORMAL))
        return f"{far(COLOUR, c)} + {far(POSITION, c)} + 1 - ({dot}) / ({_LEN()} * {size})"

    names = ", ".join(f"{one(c)} AS d{j}" for j, c in enumerate(centres))
    least = "least(" + ", ".join(f"d{j}" for j in range(len(centres))) + ")"
    which = "CASE " + " ".join(f"WHEN d{j} = {least} THEN {j}" for j in range(len(centres))) + " END"
    head = f"WITH {PX}, q AS (SELECT *, {names} FROM px), k AS (SELECT *, CAST({which} AS INTEGER) AS cluster, {least} AS distance FROM q)"
    if not update:
        return f"{head} SELECT image_id, pid, cluster, {r('distance', 'distance')} FROM k"
    means = ", ".join(r(f"avg({c})", c) for c in COLOUR + POSITION)
    return f"{head} SELECT image_id, cluster, count(*) AS cnt, {means}, {', '.join(r(f'sum({n}) / {_NL}', n) for n in NORMAL)} FROM k GROUP BY image_id, cluster"


def _gauss(names, mu, cov) -> str:
    s, det = np.linalg.inv(np.array(cov)), float(np.linalg.det(np.array(cov)))
    form = " + ".join(f"({float(s[i, j])!r}) * ({names[i]} - ({mu[i]})) * ({names[j]} - ({mu[j]}))" for i in range(3) for j in range(3))
    return f"(-0.5 * ({form} + ({math.log(det) + 3 * math.log(2 * math.pi)!r})))"


def _wat(axis, kappa) -> str:
    dot = " + ".join(f"{n} * {a}" for n, a in zip(NORMAL, axis))
    return f"({kappa} * ({dot}) * ({dot}) - ({LOG_M(kappa)!r}))"


def gaussian(mu, cov) -> str:
    return f"WITH {PX} SELECT image_id, pid, {r(_gauss(COLOUR, mu, cov), 'logpdf')} FROM px"


def watson(axis, kappa) -> str:
    return f"WITH {PX} SELECT image_id, pid, {r(_wat(axis, kappa), 'logpdf')} FROM px"


def em(parts, what: str) -> str:
    l = ", ".join(f"ln({p['weight']}) + {_gauss(COLOUR, p['mu_c'], p['cov_c'])} + {_gauss(POSITION, p['mu_p'], p['cov_p'])} + {_wat(p['axis'], p['kappa'])} AS l{j}" for j, p in enumerate(parts))
    head = f"""WITH {PX}, q AS (SELECT *, {l} FROM px), s AS (SELECT *, greatest(l0, l1) AS top FROM q),
k AS (SELECT *, exp(l0 - top) / (exp(l0 - top) + exp(l1 - top)) AS p0, exp(l1 - top) / (exp(l0 - top) + exp(l1 - top)) AS p1, top + ln(exp(l0 - top) + exp(l1 - top)) AS ll FROM s)"""
    if what == "e":
        return f"{head} SELECT image_id, pid, {rs(('p0', 'p1', 'll'))} FROM k"
    if what == "nll":
        return f"{head} SELECT image_id, {r('-sum(ll)', 'nll', 4)} FROM k GROUP BY image_id"
    if what == "hard":
        return f"{head} SELECT image_id, pid, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS cluster FROM k"
    pairs = [("c1", "c1"), ("c1", "c2"), ("c1", "c3"), ("c2", "c2"), ("c2", "c3"), ("c3", "c3"), ("x", "x"), ("y", "y"), ("z", "z")]
    cols = ", ".join(r(f"sum(p * {c}) / sum(p)", c) for c in COLOUR + POSITION)
    cols += ", " + ", ".join(r(f"sum(p * {a} * {b}) / sum(p)", f"{a}_{b}") for a, b in pairs)
    cols += ", " + ", ".join(r(f"sum(p * {t}) / sum(p)", f"t{i + 1}") for i, t in enumerate(_T))
    return f"{head}, u AS (SELECT 0 AS comp, p0 AS p, * FROM k UNION ALL SELECT 1, p1, * FROM k) SELECT image_id, comp, {cols}, {r('sum(p) / (SELECT count(*) FROM px)', 'weight')} FROM u GROUP BY image_id, comp"


_MARKS = """marks AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS place FROM px) WHERE place IN
  (SELECT CAST(floor(k * n::DOUBLE / m) AS BIGINT) FROM (SELECT n, m, unnest(range(0, m)) AS k FROM (SELECT count(*) AS n, greatest(2, CAST(round_even(count(*) * 0.03, 0) AS BIGINT)) AS m FROM px))))"""
LANDMARKS = f"WITH {PX}, {_MARKS} SELECT image_id, pid, {rs(('c1', 'z'))} FROM marks"
AFFINITY = f"WITH {PX}, {_MARKS} SELECT a.image_id, a.pid, b.pid AS mark, {r(f'exp(-({squares(COLOUR + POSITION)}))', 'a')} FROM px a CROSS JOIN marks b"


def _frc(place: int, side: int) -> str:
    """Disparity of square blocks of each image, as one row for each image."""
    parts = []
    for names in (COLOUR, ("z",)):
        off = "sqrt(" + " + ".join(f"({c} - m_{c}) * ({c} - m_{c})" for c in names) + ")"
        d = "sqrt(" + " + ".join(f"(u.{c} - v.{c}) * (u.{c} - v.{c})" for c in names) + ")"
        own = ", ".join(f"avg({c}) OVER (PARTITION BY image_id, label) AS m_{c}" for c in names)
        parts.append(f"""(SELECT x.image_id, (inter / n - intra) / 2 AS v FROM
  (SELECT image_id, avg({off}) AS intra, count(*) AS n FROM (SELECT *, {own} FROM b) GROUP BY image_id) x JOIN
  (SELECT image_id, sum(x) AS inter FROM (SELECT u.image_id, u.label, sum({d}) / greatest(count(*) - 1, 1) * max(u.n) AS x FROM g u JOIN g v ON u.image_id = v.image_id GROUP BY u.image_id, u.label) GROUP BY image_id) y
  ON x.image_id = y.image_id)""")
    means = ", ".join(f"avg({c}) AS {c}" for c in (*COLOUR, "z"))
    return f"""SELECT c.image_id, {place} AS place, round((c.v + z.v) / 2, 9) AS score FROM
 (WITH b AS (SELECT * REPLACE (CAST((("row" - 1) // {side}) * 10 + (col - 1) // {side} AS INTEGER) AS label) FROM pm), g AS (SELECT image_id, label, count(*) AS n, {means} FROM b GROUP BY 1, 2) SELECT * FROM {parts[0]}) c JOIN
 (WITH b AS (SELECT * REPLACE (CAST((("row" - 1) // {side}) * 10 + (col - 1) // {side} AS INTEGER) AS label) FROM pm), g AS (SELECT image_id, label, count(*) AS n, {means} FROM b GROUP BY 1, 2) SELECT * FROM {parts[1]}) z ON c.image_id = z.image_id"""


BEST = f"""WITH {PM}, s AS ({" UNION ALL ".join(_frc(p, s) for p, s in enumerate((2, 3, 5)))}),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, place) AS n FROM s)
SELECT image_id, place, {r("score", "score")} FROM k WHERE n = 1"""
_PAIRS = [(a, b) for i, a in enumerate(COLOUR) for b in COLOUR[i:]]
COVARIANCE = f"WITH {PX} SELECT image_id, label, {', '.join(r(f'covar_samp({a}, {b})', f'{a}_{b}') for a, b in _PAIRS)} FROM px GROUP BY image_id, label"
_CT = f"{PX}, {BL}, t AS (SELECT a.image_id, a.label AS a, b.label AS b, count(*) AS n FROM bl a JOIN px b ON b.pid = a.pid GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS tot FROM t)"


def metric(text: str) -> str:
    return f"WITH {_CT} {text}"


def _pairs(expression: str) -> str:
    return metric(f""", p AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS cells,
  (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS ina, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS inb,
  (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM t) AS pairs) SELECT CAST(0 AS BIGINT) AS image_id, {r(expression, "value")} FROM p""")


def _value(x: str) -> str:
    return f"SELECT image_id, {r(x, 'value')}"


_OTHER = 'tr AS (SELECT * REPLACE (CAST(("row" // 7) * 3 + col // 8 AS INTEGER) AS label) FROM px)'
_RIM = lambda t, name: f"{name} AS (SELECT DISTINCT a.image_id, a.pid, a.\"row\", a.col FROM {near(t, window(1))} WHERE a.label <> b.label)"
_RIMS = f"WITH {PX}, {BL}, {_OTHER}, {_RIM('bl', 'ra')}, {_RIM('tr', 'rb')}"
_HIT = lambda x, y: f"(SELECT count(*) FROM {x} p WHERE EXISTS (SELECT 1 FROM {y} q WHERE abs(q.\"row\" - p.\"row\") <= 1 AND abs(q.col - p.col) <= 1))"
_FAR = lambda x, y: f"(SELECT avg(d) FROM (SELECT p.pid, min(sqrt(pow(q.\"row\" - p.\"row\", 2) + pow(q.col - p.col, 2))) AS d FROM {x} p CROSS JOIN {y} q GROUP BY p.pid))"
_ERR = f"WITH {PX}, {BL}, e AS (SELECT image_id, label, count(*) AS area, {' + '.join(f'var_pop({c}) * count(*)' for c in COLOUR)} AS e2 FROM bl GROUP BY image_id, label), s AS (SELECT *, count(*) OVER (PARTITION BY area) AS same FROM e)"
_MD = lambda names: f"d AS (SELECT bl.*, {', '.join(f'avg({c}) OVER (PARTITION BY label) AS m_{c}' for c in names)} FROM bl)"
_OFF = lambda names: "sqrt(" + " + ".join(f"({c} - m_{c}) * ({c} - m_{c})" for c in names) + ")"


def _disparity(names) -> str:
    d = "sqrt(" + " + ".join(f"(u.{c} - v.{c}) * (u.{c} - v.{c})" for c in names) + ")"
    means = ", ".join(f"avg({c}) AS {c}" for c in names)
    return f"""(WITH {_MD(names)}, g AS (SELECT label, count(*) AS n, {means} FROM bl GROUP BY label),
 h AS (SELECT u.label, sum({d}) / greatest(count(*) - 1, 1) * max(u.n) AS x FROM g u CROSS JOIN g v GROUP BY u.label)
 SELECT ((SELECT sum(x) FROM h) / (SELECT count(*) FROM bl) - (SELECT avg({_OFF(names)}) FROM d)) / 2)"""


def _zeboudj(names, radius: int) -> str:
    one = lambda c: f"""SELECT a.image_id, a.pid, a.label, '{c}' AS c, max(CASE WHEN b.label = a.label THEN abs(b.{c} - a.{c}) END) AS i, max(CASE WHEN b.label <> a.label THEN abs(b.{c} - a.{c}) END) AS e FROM {near("bl", window(radius))} GROUP BY 1, 2, 3"""
    return f"""WITH {PX}, {BL}, p AS ({" UNION ALL ".join(one(c) for c in names)}),
 q AS (SELECT image_id, label, c, count(*) AS area, avg(i) AS i, coalesce(avg(e), 0.0) AS e FROM p GROUP BY 1, 2, 3),
 s AS (SELECT image_id, c, sum(area * CASE WHEN i > 0 AND i < e THEN 1 - i / e WHEN i = 0 THEN e ELSE 0.0 END) / sum(area) AS value FROM q GROUP BY 1, 2)
 {_value("avg(value)")} FROM s GROUP BY image_id"""


METRICS = {
    "rand_index": _pairs("(pairs + 2 * cells - ina - inb) / pairs"),
    "pair_precision": _pairs("cells / ina"),
    "pair_f_measure": _pairs("2 * cells / (ina + inb)"),
    "variation_of_information": metric(_value("-sum(n::DOUBLE / tot * (ln(n::DOUBLE / na) + ln(n::DOUBLE / nb)))") + " FROM m GROUP BY image_id"),
    "segmentation_covering": metric(
        f", c AS (SELECT image_id, b, max(n::DOUBLE / (na + nb - n)) AS iou, max(nb) AS nb, max(tot) AS tot FROM m GROUP BY image_id, b) {_value('sum(nb * iou) / max(tot)')} FROM c GROUP BY image_id"
    ),
    "region_f_measure": metric(_value("2.0 * count(*) FILTER (WHERE n > 0.5 * na AND n > 0.5 * nb) / (count(DISTINCT a) + count(DISTINCT b))") + " FROM m GROUP BY image_id"),
    "objects_and_parts": metric(f""", k AS (SELECT *, CASE WHEN n >= 0.9 * na AND n >= 0.9 * nb THEN 1.0 WHEN greatest(n::DOUBLE / na, n::DOUBLE / nb) >= 0.9 AND least(n::DOUBLE / na, n::DOUBLE / nb) >= 0.25 THEN 0.1 ELSE 0.0 END::DOUBLE AS hit FROM m),
 s AS (SELECT (SELECT avg(h) FROM (SELECT max(hit) AS h FROM k GROUP BY a)) AS sa, (SELECT avg(h) FROM (SELECT max(hit) AS h FROM k GROUP BY b)) AS sb)
 SELECT CAST(0 AS BIGINT) AS image_id, {r("CASE WHEN sa + sb > 0 THEN 2 * sa * sb / (sa + sb) ELSE 0.0 END", "value")} FROM s"""),
    "boundary_f_measure": f"""{_RIMS}, s AS (SELECT {_HIT("ra", "rb")}::DOUBLE / (SELECT count(*) FROM ra) AS p, {_HIT("rb", "ra")}::DOUBLE / (SELECT count(*) FROM rb) AS q)
 SELECT CAST(0 AS BIGINT) AS image_id, {r("CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END", "value")} FROM s""",
    "boundary_displacement": f"{_RIMS} SELECT CAST(0 AS BIGINT) AS image_id, {r('(' + _FAR('ra', 'rb') + ' + ' + _FAR('rb', 'ra') + ') / 2', 'value')}",
    "liu_yang_f": f"{_ERR} {_value('sqrt(count(*)) * sum(e2 / sqrt(area))')} FROM e GROUP BY image_id",
    "fprime": f"{_ERR} {_value('sqrt(sum(pow(same, 1 + 1.0 / area) / same)) * sum(e2 / sqrt(area)) / (1000 * sum(area))')} FROM s GROUP BY image_id",
    "q_metric": f"{_ERR} {_value('sqrt(count(*)) * sum(e2 / (1 + ln(area)) + pow(same::DOUBLE / area, 2)) / (1000 * sum(area))')} FROM s GROUP BY image_id",
    "values_entropy": f"""WITH {PX}, {BL}, v AS (SELECT image_id, label, floor(c1 * 16) AS v, count(*) AS n FROM bl GROUP BY 1, 2, 3),
 w AS (SELECT *, sum(n) OVER (PARTITION BY label) AS area, sum(n) OVER () AS tot FROM v) {_value("-sum(n::DOUBLE / tot * ln(n::DOUBLE / area))")} FROM w GROUP BY image_id""",
    "zeboudj": _zeboudj(("c1",), 2),
    "zeboudj_colour": _zeboudj(COLOUR, 5),
    "values_entropy_colour": f"""WITH {PX}, {BL}, q AS (SELECT image_id, label, unnest(['c1', 'c2', 'c3']) AS c, floor(unnest([c1, c2, c3]) * 16) AS v FROM bl),
 v AS (SELECT image_id, label, c, v, count(*) AS n FROM q GROUP BY 1, 2, 3, 4), w AS (SELECT *, sum(n) OVER (PARTITION BY c, label) AS area, sum(n) OVER (PARTITION BY c) AS tot FROM v),
 x AS (SELECT image_id, c, -sum(n::DOUBLE / tot * ln(n::DOUBLE / area)) AS value FROM w GROUP BY 1, 2) {_value("avg(value)")} FROM x GROUP BY image_id""",
    "ecw": f"""WITH {PX}, {BL}, {_MD(COLOUR)} SELECT CAST(0 AS BIGINT) AS image_id, {r(f"(SELECT avg(CASE WHEN {_OFF(COLOUR)} > 0.2 THEN 1.0 ELSE 0.0 END) FROM d) + (SELECT avg(CASE WHEN sqrt({squares(['m_' + c for c in COLOUR])}) < 0.2 THEN 1.0 ELSE 0.0 END) FROM {near('d', HALF)} WHERE a.label <> b.label)", "value")}""",
    "frc_rgbd": f"WITH {PX}, {BL} SELECT CAST(0 AS BIGINT) AS image_id, {r('(' + _disparity(COLOUR) + ' + ' + _disparity(('z',)) + ') / 2', 'value')}",
}
_SOME = "FROM mr WHERE value IS NOT NULL"
SUMMARISED = f"WITH {MR} SELECT algorithm, metric, {r('avg(value)', 'mean')}, count(*) AS n {_SOME} GROUP BY algorithm, metric"
PIVOTED = f"WITH {MR} SELECT algorithm, {', '.join(r(f'''avg(value) FILTER (WHERE metric = '{m}')''', m) for m in ('m0', 'm1', 'm2'))} FROM mr GROUP BY algorithm"
ROLLED = f"WITH {MR} SELECT algorithm, metric, {r('avg(value)', 'mean')}, count(*) AS n {_SOME} GROUP BY ROLLUP (algorithm, metric)"
ALL_METRICS = f"WITH {MR} SELECT algorithm, metric, {r('max(value)', 'value')} {_SOME} GROUP BY algorithm, metric"
LOOKUP = f"WITH {MR} SELECT image_id, algorithm, metric FROM mr WHERE metric = 'm3' AND value IS NULL"
UPSERT = f"WITH {MR} SELECT image_id, algorithm, metric, CASE WHEN image_id % 10 = 0 THEN -1.0 ELSE round(value, 6) + 0.0 END::DOUBLE AS value FROM mr"
INSERT = f"WITH {MR} SELECT image_id, algorithm, metric, CASE WHEN image_id % 2 = 0 THEN round(value, 6) + 0.0 ELSE 0.5 END::DOUBLE AS value FROM mr"
PENDING = f"WITH {MR} SELECT image_id, algorithm FROM mr WHERE value IS NULL"
FK = f"WITH {MR} SELECT upper(algorithm) AS name, count(DISTINCT image_id) AS images FROM mr GROUP BY 1"

# Whole algorithms on images of four far blocks: each block is one segment, numbered by its first pixel
_BLOCK = "CAST((\"row\" - 1) // 5 * 2 + (col - 1) // 5 AS INTEGER)"
FLAT = f"""WITH {PM}, b AS (SELECT image_id, pid, {_BLOCK} AS block FROM pm), f AS (SELECT image_id, block, min(pid) AS first FROM b GROUP BY 1, 2),
k AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY first) AS n FROM f)
SELECT b.image_id, b.pid, CAST(k.n AS INTEGER) AS label FROM b JOIN k ON k.image_id = b.image_id AND k.block = b.block"""
HALVES = f"WITH {PM} SELECT image_id, pid, CAST((col - 1) // 5 + 1 AS INTEGER) AS label FROM pm"
OBJECTIVE = f"WITH {PM} SELECT image_id, CAST((col - 1) // 5 + 1 AS INTEGER) AS cluster, count(*) AS n, 1.0::DOUBLE AS objective FROM pm GROUP BY 1, 2"
# The plane z = 2 + x / 2 - y / 4 has the direction (1/2, -1/4, -1)
_TILT = [x / math.sqrt(0.25 + 0.0625 + 1) for x in (0.5, -0.25, -1.0)]
SVD_FLAT = f"WITH {PX} SELECT image_id, pid, {', '.join(f'round({x!r}::DOUBLE, 5) AS {n}' for x, n in zip(_TILT, NORMAL))} FROM px"
PLANES_FLAT = SVD_FLAT
# The least eigenvalue of a symmetric 3 by 3 matrix in closed form; its direction is the longest cross product of two rows without it
_SYM = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
_CROSS = lambda a, b: ", ".join(f"{a}{i} * {b}{j} - {a}{j} * {b}{i} AS {a}{b}{k}" for k, (i, j) in enumerate(((2, 3), (3, 1), (1, 2)), 1))
_SIZE = lambda v: " + ".join(f"{v}{k} * {v}{k}" for k in (1, 2, 3))
SVD = f"""WITH {PX}, m AS (SELECT a.image_id, a.pid, count(*) AS n, {", ".join(f"sum(b.{p} * b.{q}) AS s{p}{q}" for p, q in _SYM)}, {", ".join(f"sum(b.{p}) AS s{p}" for p in POSITION)}
  FROM {near("px", window(2))} WHERE abs(b.z - a.z) <= 0.3 GROUP BY 1, 2 HAVING count(*) > 3),
c AS (SELECT image_id, pid, {", ".join(f"s{p}{q} - s{p} * s{q} / n AS {p}{q}" for p, q in _SYM)} FROM m),
d AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), e AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM d),
f AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM e),
g AS (SELECT *, q + 2 * p * cos(acos(greatest(-1.0, least(1.0, r))) / 3 + 2 * pi() / 3) AS l FROM f),
h AS (SELECT image_id, pid, xx - l AS u1, xy AS u2, xz AS u3, xy AS v1, yy - l AS v2, yz AS v3, xz AS w1, yz AS w2, zz - l AS w3 FROM g),
i AS (SELECT image_id, pid, {_CROSS("u", "v")}, {_CROSS("u", "w")}, {_CROSS("v", "w")} FROM h),
j AS (SELECT *, {_SIZE("uv")} AS a, {_SIZE("uw")} AS b, {_SIZE("vw")} AS c FROM i),
k AS (SELECT image_id, pid, {", ".join(f"CASE WHEN a >= b AND a >= c THEN uv{n} / sqrt(a) WHEN b >= c THEN uw{n} / sqrt(b) ELSE vw{n} / sqrt(c) END AS n{n}" for n in (1, 2, 3))} FROM j)
SELECT image_id, pid, {", ".join(r(f"CASE WHEN n3 > 0 THEN -n{k} ELSE n{k} END", n, 4) for k, n in enumerate(NORMAL, 1))} FROM k"""
_APART = 'CASE WHEN "row" % 4 = 0 AND col % 4 = 0 THEN 0.0 ELSE'
FILL_ONE = f"""WITH {PX}, h AS (SELECT image_id, pid, "row", col, {", ".join(f"{_APART} {n} END AS {n}" for n in NORMAL)} FROM px),
s AS (SELECT a.image_id, a.pid, sum(b.nx) AS nx, sum(b.ny) AS ny, sum(b.nz) AS nz FROM {near("h", window(1))} WHERE {_LEN("a.")} < 1e-6 GROUP BY a.image_id, a.pid)
SELECT h.image_id, h.pid, {", ".join(r(f"coalesce(s.{n} / {_LEN('s.')}, h.{n})", n) for n in NORMAL)} FROM h LEFT JOIN s USING (image_id, pid)"""
CLEANED = f"""WITH {PX}, h AS (SELECT image_id, pid, "row", col, CASE WHEN pid % 11 = 0 OR pid % 13 = 0 THEN NULL ELSE nx END AS nx, ny, nz FROM px),
s AS (SELECT a.image_id, a.pid, avg(b.nx) AS nx FROM {near("h", window(3))} WHERE a.nx IS NULL GROUP BY a.image_id, a.pid),
m AS (SELECT h.image_id, h.pid, coalesce(h.nx, s.nx) AS nx, h.ny, h.nz, s.nx IS NOT NULL AS mended FROM h LEFT JOIN s USING (image_id, pid))
SELECT image_id, pid, {", ".join(r(f"{n} / CASE WHEN mended THEN {_LEN()} ELSE 1 END", n) for n in NORMAL)} FROM m"""
SMALL = f"""WITH {PM}, b AS (SELECT image_id, pid, ("row" - 1) // 2 AS stripe FROM pm)
SELECT image_id, pid, CAST(stripe + 1 AS INTEGER) AS label FROM b"""

# Distributions: Kummer's series, term by term, at numbers that come from the regions' normals
_SPREADS = "q AS (SELECT label, count(*) AS cnt, avg(nx * nx) AS a1, avg(ny * ny) AS a2, avg(nz * nz) AS a3 FROM px GROUP BY label)"
SCALES = ((-8, "a1"), (-0.5, "a2"), (0.5, "a3"), (3, "a1"), (25, "a2"), (60, "a3"), (400, "a1"), (600, "a2"))
_XS = "xs AS (SELECT DISTINCT x FROM (" + " UNION ALL ".join(f"SELECT round({s}::DOUBLE * {c}, 3) + 0.0 AS x FROM q" for s, c in SCALES) + "))"
PARAMETERS_AB = ((0.5, 1.5), (1.5, 2.5), (1.5, 1.5), (2.5, 1.5), (1.0, 2.0), (3.0, 1.0))
_SERIES = lambda grid, a, b: f"""t(a, b, x, k, term, total) AS (  -- e^x 1F1(b - a; b; -x) for negative x keeps all terms of one sign
  SELECT a, b, x, 0, 1.0::DOUBLE, 1.0::DOUBLE FROM {grid}
  UNION ALL SELECT a, b, x, k + 1, term * (CASE WHEN x < 0 THEN {b} - {a} ELSE {a} END + k) / ({b} + k) * abs(x) / (k + 1), total + term * (CASE WHEN x < 0 THEN {b} - {a} ELSE {a} END + k) / ({b} + k) * abs(x) / (k + 1)
  FROM t WHERE k < 1500),
s AS (SELECT a, b, x, CASE WHEN x < 0 THEN exp(x) ELSE 1 END * total AS m FROM t WHERE k = 1500)"""  # noqa: E731
_AB = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in PARAMETERS_AB)
KUMMER = f"""WITH RECURSIVE {PX}, {_SPREADS}, {_XS}, g AS (SELECT a, b, x FROM (VALUES {_AB}) AS p(a, b) CROSS JOIN xs),
{_SERIES("g", "a", "b")} SELECT a, b, x, {r("ln(abs(m))", "log_m")} FROM s"""
KUMMER_RATIO = f"""WITH RECURSIVE {PX}, {_SPREADS}, {_XS}, g AS (SELECT c, x FROM (VALUES (1.5::DOUBLE), (2.0::DOUBLE)) AS p(c) CROSS JOIN xs),
w AS (SELECT 0.5::DOUBLE + d AS a, c + d AS b, x, d FROM g, (VALUES (0), (1)) AS v(d)),
{_SERIES("w", "a", "b")} SELECT 0.5::DOUBLE AS a, p.b AS c, p.x, {r("0.5 / p.b * q.m / p.m", "ratio")} FROM s p JOIN s q ON q.x = p.x AND q.b = p.b + 1 AND q.a = p.a + 1 WHERE p.a = 0.5"""
_R = f"""t AS (SELECT label, {", ".join(f"avg({t}) AS t{i + 1}" for i, t in enumerate(_T))} FROM px GROUP BY 1),
m AS (SELECT label, unnest([sqrt({" + ".join(f"t{i} * t{i}" for i in range(1, 7))}), t1, t2, t3]) AS r FROM t)"""
CONCENTRATION = f"WITH {PX}, {_R} SELECT label, {r('r', 'r', 4)}, {r('r', 'back', 4)} FROM m"
_BOUND = lambda four: f"(r * 1.5 - 0.5) / (2 * r * (1 - r)) * (1 + sqrt(1 + {four} * 2.5 * r * (1 - r) / 0.5))"
BOUNDS = f"""WITH {PX}, {_R}, b AS (SELECT label, r, (r * 1.5 - 0.5) / (r * (1 - r)) * (1 + (1 - r) / 1.0) AS low, {_BOUND("4")} AS middle, {_BOUND("r")} AS other,
  (r * 1.5 - 0.5) / (r * (1 - r)) * (1 + r / 0.5) AS high FROM m)
SELECT label, {rs(("r", "low", "middle", "other", "high"), 5)}, {r("CASE WHEN r < 0.5 / 1.5 THEN low WHEN r < 1 / sqrt(1.5) THEN middle ELSE high END", "chosen", 5)},
  {r("CASE WHEN r < 0.5 / 3 THEN high WHEN r < 0.5 / sqrt(1.5) THEN other ELSE low END", "chosen_source", 5)} FROM b"""
GAMMA = f"WITH {PX}, {_SPREADS} SELECT label, {r('lgamma(cnt / 2.0::DOUBLE)', 'log_gamma')}, (label + 1) + (label + 1) * label / 2 AS dimension FROM q"
_KAPPA = "round(2 + 5 * abs(nx), 3)"
DIVERGENCES = f"""WITH RECURSIVE {PX}, k AS (SELECT image_id, pid, nx, ny, nz, {_KAPPA} AS x FROM px),
t(x, n, m, d, term) AS (SELECT DISTINCT x, 0, 1.0::DOUBLE, 1 / 3.0::DOUBLE, 1.0::DOUBLE FROM k  -- M = sum of x^n / (n! (2 n + 1)), its slope is the sum of x^n / (n! (2 n + 3))
  UNION ALL SELECT x, n + 1, m + term * x / (n + 1) / (2 * n + 3), d + term * x / (n + 1) / (2 * n + 5), term * x / (n + 1) FROM t WHERE n < 80),
w AS (SELECT k.*, ln(m) AS lm, d / m AS ratio FROM k JOIN t ON t.x = k.x AND t.n = 80),
p AS (SELECT a.image_id, a.pid, a.x AS k1, b.x AS k2, a.lm AS l1, b.lm AS l2, a.ratio AS r1, b.ratio AS r2, pow({_DOT}, 2) AS c2 FROM w a JOIN w b ON b.pid = a.pid + 1)
SELECT image_id, pid, {r("l1 - l2 - (k1 * c2 - k2) * r2", "parameters", 4)}, {r("k1 * r1 - l1 - (k2 * r2 - l2) - (r1 * k2 * c2 - r2 * k2)", "means", 4)} FROM p"""
GAUSSIAN_OF = f"""WITH {PX}, g AS (SELECT image_id, label, avg(c1) AS m1, avg(c2) AS m2, avg(c3) AS m3, var_samp(c1) AS a, covar_samp(c1, c2) AS b, covar_samp(c1, c3) AS c, var_samp(c2) AS d, covar_samp(c2, c3) AS e, var_samp(c3) AS f FROM px GROUP BY 1, 2),
h AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g)
SELECT image_id, label, {rs(("m1", "m2", "m3"))}, {r("a", "s11")}, {r("b", "s12")}, {r("e", "s23")}, {r("-0.5 * (ln(det) + 3 * ln(2 * pi()))", "at_mean")}, {r("-0.5 * (ln(det) + 3 * ln(2 * pi() * exp(1)))", "dual")}, 3 AS dim,
  {r("a * a + d * d + f * f + 2 * (b * b + c * c + e * e) + a * m1 * m1 + d * m2 * m2 + f * m3 * m3 + 2 * (b * m1 * m2 + c * m1 * m3 + e * m2 * m3)", "trace")} FROM h"""
SCATTER_OF = f"""WITH {PX} SELECT image_id, label, {r("avg(nx * nx)", "sxx")}, {r("avg(nx * ny)", "sxy")}, {r("avg(ny * nz)", "syz")},
  {r(f"sum(5.0 * pow(0.6 * ny + 0.8 * nz, 2) - ({LOG_M(5.0)!r}))", "ll")} FROM px GROUP BY 1, 2"""
WATSON_OF = f"""WITH {PX}, t AS (SELECT image_id, label, {", ".join(f"avg({t}) AS t{i + 1}" for i, t in enumerate(_T))} FROM px GROUP BY 1, 2),
s AS (SELECT *, sqrt({" + ".join(f"t{i} * t{i}" for i in range(1, 7))}) AS size FROM t)
SELECT image_id, label, {r("size", "length")}, {r("size", "back")}, 0.0::DOUBLE AS own, 1.0::DOUBLE AS trace FROM s"""
MLE = f"""WITH {PM} SELECT DISTINCT image_id, {_BLOCK} AS label, CASE {_BLOCK} WHEN 0 THEN 1.0 WHEN 3 THEN 0.6 ELSE 0.0 END::DOUBLE AS ax, CASE {_BLOCK} WHEN 1 THEN 1.0 WHEN 3 THEN 0.6 ELSE 0.0 END::DOUBLE AS ay,
  CASE {_BLOCK} WHEN 2 THEN 1.0 WHEN 3 THEN 0.53 ELSE 0.0 END::DOUBLE AS az, true AS sharp FROM pm"""

# Data set, files and store
DDL = f"WITH {MR} SELECT image_id, algorithm, metric, {r('value', 'value')} FROM mr"
PARAMETERS = f"""WITH {PX}, n AS (SELECT label, count(*) AS cnt FROM px GROUP BY 1),
t AS (SELECT label, 'CDNGraph' AS name, '{{"min_size":"' || cnt || '","scale_k":"2.0","update_sizes":"False"}}' AS text FROM n
  UNION ALL SELECT label, 'Diametrical', '{{"k":"' || (label + 1) || '","max_iterations":"200","seed":"0","threshold":"0.001"}}' FROM n),
k AS (SELECT label, name, text, unnest(json_keys(text)) AS key FROM t)
SELECT label, name, text, key, json_extract_string(text, '$.' || key) AS value FROM k"""
FILE_NAMES = f"""WITH {PM} SELECT DISTINCT image_id, 'NYU_' || image_id || '_seg' AS segments, '/data/raw/nyu_depth_v2_labeled.mat' AS raw, '/data/transformed/image_nyu_v2_' || image_id || '.fits' AS transformed FROM pm"""
FITS = f'WITH {PM} SELECT image_id, "row", col, {rs(COLOUR + POSITION)}, label FROM pm'
DATASET = f"WITH {PM} SELECT image_id, count(*) AS n, CAST((SELECT count(DISTINCT image_id) FROM pm) AS INTEGER) AS size, 'NYU' AS name FROM pm GROUP BY image_id"
IMAGE = f"""WITH {PM} SELECT image_id, CAST((col - 2) * 7 + "row" - 1 AS BIGINT) AS pid, "row" - 1 AS "row", col - 1 AS col, {r("c1", "c1")}, label + 1 AS label, {', '.join(f'round({x!r}::DOUBLE, 5) AS {n}' for x, n in zip(_TILT, NORMAL))}
FROM pm WHERE image_id = 2 AND "row" BETWEEN 2 AND 8 AND col BETWEEN 2 AND 8"""
SAVED = f"WITH {PM} SELECT image_id, pid, label FROM pm WHERE image_id = 1"
UPDATED = f"WITH {MR} SELECT image_id, algorithm, metric, CASE WHEN image_id % 2 = 0 THEN 9.0 ELSE round(value, 6) + 0.0 END::DOUBLE AS value FROM mr"
FIRST = f"WITH {MR} SELECT image_id, algorithm, true AS other, false AS none FROM mr WHERE image_id = 7"
MERGED_MAPS = f"""WITH {MR}, m AS (SELECT DISTINCT algorithm, metric FROM mr WHERE value IS NOT NULL AND metric IN ('m0', 'm1', 'm2'))
SELECT algorithm, metric, CASE WHEN metric = 'm0' THEN 1.0 ELSE 2.0 END::DOUBLE AS value FROM m"""
RESIZED_MEANS = f"""WITH {PX}, {_TARGET(0.5)}, n AS (SELECT p.* FROM t JOIN px p ON p."row" = CAST(floor((trow - 0.5) / 0.5) + 1 AS INTEGER) AND p.col = CAST(floor((tcol - 0.5) / 0.5) + 1 AS INTEGER))
SELECT image_id, label, count(*) AS cnt, {r("avg(c1)", "mc1")}, {r("avg(x)", "mx")}, {r("avg(z)", "mz")} FROM n GROUP BY 1, 2"""
RESIZED_ALL = f"""WITH {PX}, {_TARGET(0.4)},
u AS (SELECT *, (trow - 0.5::DOUBLE) / 0.4::DOUBLE + 0.5::DOUBLE AS p, (tcol - 0.5::DOUBLE) / 0.4::DOUBLE + 0.5::DOUBLE AS q FROM t),
v AS (SELECT *, CAST(floor(p) AS INTEGER) AS r0, CAST(floor(q) AS INTEGER) AS q0, p - floor(p) AS fr, q - floor(q) AS fc FROM u)
SELECT v.image_id, CAST((tcol - 1) * th + trow AS BIGINT) AS pid, {", ".join(r(f"sum({_WT} * {c})", c) for c in CHANNELS)}
FROM v CROSS JOIN {offsets(((0, 0), (0, 1), (1, 0), (1, 1)))} JOIN px b ON b."row" = greatest(1, least(r0 + dr, h)) AND b.col = greatest(1, least(q0 + dc, w))
GROUP BY v.image_id, th, trow, tcol"""
# Segmentations that equal the ground truth have the best value of every metric
_BEST = ", ".join(f"('{m}', {0.0 if m in ('BoundaryDisplacementError', 'VariationOfInformation') else 1.0}::DOUBLE)" for m in ("RandIndex", "SegmentationCovering", "Precision", "FMeasure", "FMeasureRegions", "PRObjectsAndParts", "FBoundary", "BoundaryDisplacementError", "VariationOfInformation"))
# One segment against four blocks of 25 pixels
_ONE = {"RandIndex": 1200 / 4950, "SegmentationCovering": 0.25, "Precision": 1200 / 4950, "FMeasure": 2400 / 6150, "FMeasureRegions": 0.0, "PRObjectsAndParts": 0.1, "VariationOfInformation": math.log(4)}
HARNESS = f"""WITH {PM}, n AS (SELECT count(DISTINCT image_id) AS n FROM pm), m AS (
  SELECT 'first' AS batch, algorithm, metric, mean FROM (VALUES ('CDNGraph'), ('DepthWMM')) AS a(algorithm) CROSS JOIN (VALUES {_BEST}) AS m(metric, mean)
  UNION ALL SELECT 'second', 'CDNGraph', metric, mean FROM (VALUES {", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in _ONE.items())}) AS m(metric, mean))
SELECT batch, algorithm, metric, {r("mean", "mean")}, n FROM m, n"""
WIDE = f"WITH {PX} SELECT image_id, pid, CAST((col - 1) // 10 + 1 AS INTEGER) AS label FROM px"
MERGED_RIMS = f"""WITH {PM}, bm AS (SELECT * REPLACE ({_BLOCK} AS label) FROM pm),
d AS (SELECT DISTINCT a.image_id, a.pid, unnest([a.label, b.label]) AS label FROM {near("bm", window(1))} WHERE a.label <> b.label),
m AS (SELECT DISTINCT image_id, pid, CASE WHEN label < 2 THEN 9 ELSE label END AS label FROM d)
SELECT x.image_id, least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, count(*) AS n, {r("sum(c1)", "total")} FROM m x JOIN m y ON y.image_id = x.image_id AND y.pid = x.pid AND x.label < y.label
JOIN pm p ON p.image_id = x.image_id AND p.pid = x.pid GROUP BY 1, 2, 3"""
_ODD = 'CASE WHEN col > 5 THEN ("row" - 1) % 5 IN (1, 3) ELSE pid % 5 = 0 END'
CONSISTENT = f"""WITH {PM}, c AS (SELECT image_id, {_BLOCK} AS label, avg(CASE WHEN {_ODD} THEN 0.0 ELSE 1.0 END) AS share FROM pm GROUP BY 1, 2)
SELECT image_id, label, {r("share", "share")}, share > 0.75 AS planar FROM c"""
# Holes in pairs: the first is filled from the snapshot, the second with the first as it is then
_PAIR = '"row" % 4 = 0 AND col % 6 IN (2, 3)'
_SUMS = lambda t, cond: f"SELECT a.image_id, a.pid, sum(b.nx) AS nx, sum(b.ny) AS ny, sum(b.nz) AS nz FROM {near(t, window(1))} WHERE {cond} GROUP BY 1, 2"
_PUT = lambda t, s: f'SELECT t.image_id, t.pid, t."row", t.col, {", ".join(f"coalesce(s.{n} / {_LEN("s.")}, t.{n}) AS {n}" for n in NORMAL)} FROM {t} t LEFT JOIN {s} s ON s.image_id = t.image_id AND s.pid = t.pid'
FEEDING = f"""WITH {PX}, h AS (SELECT image_id, pid, "row", col, {", ".join(f"CASE WHEN {_PAIR} THEN 0.0 ELSE {n} END AS {n}" for n in NORMAL)} FROM px),
s1 AS ({_SUMS("h", 'a."row" % 4 = 0 AND a.col % 6 = 2')}), h1 AS ({_PUT("h", "s1")}),
s2 AS ({_SUMS("h1", 'a."row" % 4 = 0 AND a.col % 6 = 3')}), h2 AS ({_PUT("h1", "s2")})
SELECT image_id, pid, {rs(NORMAL)} FROM h2"""
ELEMENT_LESS = f"""WITH {PX}, s AS (SELECT a.image_id, a.pid, {", ".join(f"a.{c} - b.{c} AS {c}" for c in CHANNELS)} FROM px a JOIN px b ON b.pid = CASE WHEN a.pid % 3 = 0 THEN a.pid ELSE a.pid + 1 END)
SELECT image_id, pid, {rs(COLOUR + POSITION)}, {", ".join(f"CASE WHEN pid % 3 = 0 THEN 'NaN'::DOUBLE ELSE round({n} / {_LEN()}, 6) + 0.0 END AS {n}" for n in NORMAL)} FROM s"""
_SQUARES = [(a, b) for g in (COLOUR, POSITION) for i, a in enumerate(g) for b in g[i:]]
MODEL = f"""WITH {PX} SELECT image_id, CAST(label % 3 AS INTEGER) AS comp, {r("count(*)::DOUBLE / (SELECT count(*) FROM px)", "weight")}, {", ".join(r(f"avg({c})", c) for c in COLOUR + POSITION)},
  {", ".join(r(f"avg({a} * {b})", f"{a}_{b}") for a, b in _SQUARES)}, {", ".join(r(f"avg({t})", f"t{i + 1}") for i, t in enumerate(_T))} FROM px GROUP BY 1, 2"""
ERROR_OF = f"""WITH {PX}, e AS (SELECT image_id, label % 3 AS cluster, CASE label % 3 WHEN 0 THEN nx WHEN 1 THEN 0.6 * ny + 0.8 * nz ELSE nz END AS c FROM px)
SELECT image_id, CAST(cluster AS INTEGER) AS cluster, count(*) AS n, {r("sum(c * c)", "error")} FROM e GROUP BY 1, 2"""


def distances(centres) -> str:
    return f"WITH d AS ({assign(centres)}) SELECT image_id, {r('sum(distance)', 'objective', 2)} FROM d GROUP BY 1"


def loss(parts) -> str:
    return f"WITH {PX} SELECT image_id, {r('ln(-sum(' + ' + '.join(_wat(p['axis'], p['kappa']) for p in parts) + '))', 'loss')} FROM px GROUP BY 1"


def density(axis, kappa) -> str:
    return f"WITH {PX} SELECT image_id, pid, {r('exp(' + _wat(axis, kappa) + ')', 'density')} FROM px"


_TURN = np.linalg.inv(-np.array(Camera().turned).reshape(3, 3)).tolist()
_MOVE = [" + ".join(f"({m!r}) * {c}" for m, c in zip(row, POSITION)) + f" + ({t!r})" for row, t in zip(_TURN, Camera().translation)]
COLOUR_CAMERA = f"""WITH {PX}, m AS (SELECT image_id, pid, {_MOVE[0]} AS a, {_MOVE[1]} AS b, {_MOVE[2]} AS w FROM px)
SELECT image_id, pid, {r("a / w * 518.85790117450188 + 325.58244941119034", "u", 4)}, {r("b / w * 519.46961112127485 + 253.73616633400465", "v", 4)}, {r("w", "w")} FROM m"""
_METRES = "351.3::DOUBLE / (1092.5::DOUBLE - (600 + 400 * abs(c1)))"
RAW_DEPTH = f"WITH {PX} SELECT image_id, pid, round(CASE WHEN {_METRES} < 0 OR {_METRES} > 10 THEN 10.0 ELSE {_METRES} END, 6) AS z FROM px"
IMAGE_FILES = f'WITH {PM} SELECT image_id, pid, "row", col, {rs(COLOUR + POSITION)}, label FROM pm'
STORED = f"WITH {PM} SELECT DISTINCT image_id FROM pm WHERE image_id % 2 = 0"
# Ten rows of 4, 1 and 5 columns: the middle stripe goes to the largest neighbour, or by the rule to the smallest
PRUNED_BY = f"WITH {PM} SELECT image_id, pid, CAST(CASE WHEN col < 5 THEN 1 WHEN col > 5 THEN 3 WHEN image_id % 2 = 0 THEN 3 ELSE 1 END AS INTEGER) AS label FROM pm"
