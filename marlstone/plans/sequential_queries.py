"""Registered queries over order-dependent models. Their SQL shares no code with the kernels: models that sum over the
past are windows there, and models whose weights move are recursive queries over the samples of a plane."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import analysis, blocks, color, predict, sequential
from ..operators.predict import Text
from ..sources import views as v
from .context_queries import running_sql
from .registry import register

DIGEST = "CAST(sum(res * (k + 1)) AS BIGINT) AS digest, CAST(sum(abs(res)) AS BIGINT) AS magnitude, CAST(0 AS BIGINT) AS mismatches"


def near_sql(names, source: str = "planes") -> str:
    """Neighbours by name as columns, 0 outside."""
    at = {k: sequential.offset_of(k) for k in names}
    step = lambda e, d, by: e if not d else f"{'lag' if d > 0 else 'lead'}({e}, {abs(d)}, 0) OVER {by}"
    inner = ", ".join(f"{step('v', dx, '(PARTITION BY image_id, y ORDER BY x)')} AS s{dx + 9}" for dx in sorted({dx for _, dx in at.values()}))
    outer = ", ".join(f'{step(f"s{dx + 9}", dy, "(PARTITION BY image_id, x ORDER BY y)")} AS "{k}"' for k, (dy, dx) in at.items())
    return f"SELECT image_id, y, x, y * 8 + x AS k, v, {outer} FROM (SELECT image_id, y, x, v, {inner} FROM {source})"


def wrapped(p: str, sample: str = "v") -> str:
    return f"((({sample} - ({p})) + 128) & 255) - 128"


def _register(name: str, sql: str) -> None:
    register(f"{name}_roundtrip", lambda s, d: sequential.roundtrip(v.plane_bytes(s, d), name), sql)


def _windowed(name: str, near: tuple[str, ...], ctes: str, p: str) -> None:
    """`ctes` end in a table `m` with the columns that the prediction `p` names."""
    _register(
        name,
        f"WITH {v.PLANES}, n AS ({near_sql(near)}), {ctes}, r AS (SELECT image_id, k, {wrapped(p)} AS res FROM m) SELECT image_id, {DIGEST} FROM r GROUP BY image_id",
    )


def _recursive(name: str, near: tuple[str, ...], sample: str, state: dict[str, str], steps: list[str], p: str, after: dict[str, str]) -> None:
    """A model over the samples of a plane in order: `sample` is a struct of what each sample offers, `state` the first
    values, `steps` are selects of what follows from state and sample `c`, `p` predicts and `after` is the next state."""
    inner = "SELECT *, cs[i + 1] AS c FROM st WHERE i < 64"
    for more in steps:
        inner = f"SELECT *, {more} FROM ({inner})"
    _register(name, f"""WITH RECURSIVE {v.PLANES}, n AS ({near_sql(near)}), cs AS (SELECT image_id, list({{{sample}}} ORDER BY k) AS cs FROM n GROUP BY image_id),
        st AS (SELECT image_id, 0 AS i, cs, CAST(0 AS BIGINT) AS res, {', '.join(f'{e} AS {k}' for k, e in state.items())} FROM cs
            UNION ALL SELECT image_id, i + 1, cs, CAST({wrapped(p, 'c.v')} AS BIGINT), {', '.join(after.values())} FROM ({inner})),
        r AS (SELECT image_id, i - 1 AS k, res FROM st WHERE i > 0) SELECT image_id, {DIGEST} FROM r GROUP BY image_id""")


class _Names(dict):
    """Any neighbour as SQL text; remembers which were asked for."""

    def __missing__(self, name: str) -> Text:
        self[name] = text = Text(f'"{name}"')
        return text


def _mix(name: str) -> None:
    terms, shift, first, step = sequential.MIXES[name]
    names = _Names()
    parts = list(map(str, terms(names)))
    among = ("N", "W", "NE", "NEEE")
    bounds = ", ".join(f'"{k}"' for k in among)
    places = range(1, len(parts) + 1)
    _recursive(
        name, tuple(dict.fromkeys([*names, *among])), f"'v': v, 'p': [{', '.join(f'CAST({e} AS BIGINT)' for e in parts)}], 'lo': least({bounds}), 'hi': greatest({bounds})",
        {"w": f"CAST([{', '.join([str(first)] * len(parts))}] AS BIGINT[])", "bias": f"CAST({1 << shift >> 1} AS BIGINT)"},
        [f"(bias + {' + '.join(f'w[{k}] * c.p[{k}]' for k in places)}) >> {shift} AS p", "CAST(sign(c.v - p) AS BIGINT) AS sg"], "least(c.hi, greatest(c.lo, p))",
        {"w": f"[{', '.join(f'w[{k}] + sg * c.p[{k}]' for k in places)}]", "bias": f"bias + sg * {step}"},
    )


for _name in sequential.MIXES:
    _mix(_name)

_names = _Names()
_parts = list(map(str, sequential.error_mix_terms(_names)))
_E = range(1, 9)
_recursive(
    "t67_wgrad3", tuple(_names), f"'v': v, 'p': [{', '.join(f'CAST({e} AS BIGINT)' for e in _parts)}]", {"e": "CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])"},
    ["CASE WHEN i % 8 = 0 THEN CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) ELSE e END AS f", ", ".join(f"1.0::DOUBLE / (f[{k}] + 1) AS w{k}" for k in _E)],
    f"CAST(trunc(({' + '.join(f'w{k} * c.p[{k}]' for k in _E)}) / ({' + '.join(f'w{k}' for k in _E)})) AS BIGINT)", {"e": f"[{', '.join(f'((f[{k}] + abs(c.v - c.p[{k}])) * 230) >> 8' for k in _E)}]"},
)
_T71 = "N", "W", "3 * (N - NN) + NNN", "3 * (W - WW) + WWW", "W + NE - N", "(WWWW + WWW + NNN + NEE + NEEE + NEEEE - 2 * NW) // 4", "N + W - NW", "N + NE - NNE"
_EIGHT, _ZEROS = "[1, 2, 3, 4, 5, 6, 7, 8]", "CAST([0 FOR z IN range(72)] AS BIGINT[])"
_fold = lambda t: f"(({t(3)} + {t(7)}) + ({t(4)} + {t(8)})) + (({t(1)} + {t(5)}) + ({t(2)} + {t(6)}))"
_recursive(
    "t71_wgrad5", ("N", "W", "NE", "NW", "NN", "NNN", "WW", "WWW", "WWWW", "NEE", "NEEE", "NEEEE", "NNE"),
    f"'v': v, 'p': [{', '.join(f'CAST({e} AS BIGINT)' for e in _T71)}], 'lo': least(N, W, NE), 'hi': greatest(N, W, NE)",
    {"faded": "CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])", "far": _ZEROS, "above": _ZEROS, "here": "CAST([] AS BIGINT[])"},
    ["i % 8 AS x", f"[CAST([{', '.join(map(str, sequential.FadedMix.WEIGHTS))}][j] AS DOUBLE) / (faded[j] + CASE WHEN x > 0 THEN above[8 * x - 8 + j] ELSE 0 END + 2 * above[8 * x + j] + above[8 * x + 8 + j] + far[8 * x + 8 + j] + 1) FOR j IN {_EIGHT}] AS w, [abs(c.v - c.p[j]) * 2 FOR j IN {_EIGHT}] AS error",
     f"list_concat(here, [(2 * CASE WHEN x > 0 THEN here[8 * x - 8 + j] ELSE 0 END + error[j] + above[8 * x + 8 + j]) >> 2 FOR j IN {_EIGHT}]) AS grown, list_concat(list_concat(above[1:8 * x + 8], [above[8 * x + 8 + j] + error[j] FOR j IN {_EIGHT}]), above[8 * x + 17:]) AS raised"],
    f"least(c.hi, greatest(c.lo, CAST(round_even(({_fold(lambda k: f'w[{k}] * c.p[{k}]')}) / ({_fold(lambda k: f'w[{k}]')}), 0) AS BIGINT)))",
    {"faded": f"[((faded[j] + error[j]) * 97) >> 7 FOR j IN {_EIGHT}]", "far": "CASE WHEN x = 7 THEN raised ELSE far END", "above": "CASE WHEN x = 7 THEN list_concat(grown, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])) ELSE raised END", "here": "CASE WHEN x = 7 THEN CAST([] AS BIGINT[]) ELSE grown END"},
)
_recursive(
    "t65_wp", ("W", "NE", "N", "NW"), "'v': v, 'x': [CAST(e AS DOUBLE) FOR e IN [W + NE - N, N, W, N + W - NW]]", {"e": "CAST([1, 1, 1, 1] AS DOUBLE[])"}, [", ".join(f"1 / (e[{k}] + 1) AS w{k}" for k in range(1, 5))],
    f"CAST(round_even(least(127, greatest(-128, ({' + '.join(f'w{k} * c.x[{k}]' for k in range(1, 5))}) / ({' + '.join(f'w{k}' for k in range(1, 5))}))), 0) AS BIGINT)",
    {"e": f"[{', '.join(f'e[{k}] * 0.75::DOUBLE + abs(c.x[{k}] - c.v)' for k in range(1, 5))}]"},
)

_R = range(1, 5)
_recursive(
    "t26_rls", ("N", "W", "NW", "NE"), "'v': v, 'x': [CAST(e AS DOUBLE) FOR e IN [N, W, N + W - NW, NE]]",
    {"w": "CAST([0.25, 0.25, 0.25, 0.25] AS DOUBLE[])", "q": f"CAST([{', '.join('0.01' if i == j else '0.0' for i in _R for j in _R)}] AS DOUBLE[])"},
    [f"{' + '.join(f'w[{i}] * c.x[{i}]' for i in _R)} AS p, " + ", ".join("(" + " + ".join(f"q[{4 * (i - 1) + j}] * c.x[{j}]" for j in _R) + f") AS g{i}" for i in _R), f"0.998::DOUBLE + ({' + '.join(f'g{i} * c.x[{i}]' for i in _R)}) AS norm", ", ".join(f"g{i} / norm AS k{i}" for i in _R)],
    "CAST(round_even(least(127, greatest(-128, p)), 0) AS BIGINT)",
    {"w": f"[{', '.join(f'w[{i}] + k{i} * (c.v - p)' for i in _R)}]", "q": f"[{', '.join(f'(q[{4 * (i - 1) + j}] - k{i} * g{j}) / 0.998::DOUBLE' for i in _R for j in _R)}]"},
)


def _least_squares(since: str = "UNBOUNDED") -> str:
    """The normal equations are sums over the past; elimination step by step."""
    x = ("N", "W", "NW", "NE")
    past = f"OVER (PARTITION BY image_id ORDER BY k ROWS BETWEEN {since} PRECEDING AND 1 PRECEDING)"
    cells = [f"CAST({8 if i == j else 0} + coalesce(sum({x[i]} * {x[j]}) {past}, 0) AS DOUBLE) AS a{i}{j}" for i in range(4) for j in range(4)]
    cells += [f"CAST({4 if i < 2 else 0} + coalesce(sum({x[i]} * v) {past}, 0) AS DOUBLE) AS b{i}" for i in range(4)]
    sql = f"SELECT image_id, k, v, {', '.join(x)}, {', '.join(cells)} FROM n"
    for i in range(3):
        for r in range(i + 1, 4):
            sql = f"SELECT *, a{r}{i} / a{i}{i} AS f FROM ({sql})"
            changed = [f"a{r}{j} - f * a{i}{j} AS a{r}{j}" for j in range(i + 1, 4)] + [f"b{r} - f * b{i} AS b{r}"]
            sql = f"SELECT * EXCLUDE (f) REPLACE ({', '.join(changed)}) FROM ({sql})"
    for i in reversed(range(4)):
        rest = f"b{i}" + "".join(f" - a{i}{j} * w{j}" for j in range(i + 1, 4))
        sql = f"SELECT *, ({rest}) / a{i}{i} AS w{i} FROM ({sql})"
    return f"m AS ({sql})"


_windowed("t86_ols", ("N", "W", "NW", "NE"), _least_squares(), "CAST(round_even(least(127, greatest(-128, w0 * N + w1 * W + w2 * NW + w3 * NE)), 0) AS BIGINT)")
_windowed(
    "t87_ols2",
    ("N", "W", "NW", "NE"),
    _least_squares(str(sequential.RecentOls.LAST)),
    "CAST(round_even(least(127, greatest(-128, w0 * N + w1 * W + w2 * NW + w3 * NE)), 0) AS BIGINT)",
)
_PAST = "ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_windowed(
    "t66_wgrad",
    ("N", "W", "NW", "NE", "NN", "WW", "NNE", "NNW", "NWW"),
    "m AS (SELECT *, abs(N - NW) + abs(W - WW) + abs(NE - N) + abs(NW - NWW) + 1 AS gx, abs(N - NN) + abs(W - NW) + abs(NE - NNE) + abs(NW - NNW) + 1 AS gy FROM n)",
    "(gx * N + gy * W) // (gx + gy)",
)
_windowed(
    "t92_table",
    ("N", "W", "NE", "NW"),
    "m AS (SELECT *, " + " + ".join(f"lag(v, 1, {k}) OVER (PARTITION BY image_id, {k} ORDER BY k)" for k in ("N", "W", "NE", "NW")) + " AS followers FROM n)",
    "followers >> 2",
)
_windowed("t74_sse", ("N", "W", "NW"), f"""g AS (SELECT *, greatest(least(N, W), least(greatest(N, W), N + W - NW)) AS base, (N - NW) >> 4 AS c1, (W - NW) >> 4 AS c2 FROM n),
    m AS (SELECT *, sum(v - base) OVER w AS total, count(*) OVER w AS seen FROM g WINDOW w AS (PARTITION BY image_id, c1, c2 {_PAST}))""", "least(127, greatest(-128, base + CASE WHEN seen > 0 THEN CAST(floor(total / CAST(seen AS DOUBLE)) AS BIGINT) ELSE 0 END))")  # fmt: skip
_windowed("t42_calic", ("N", "W", "NW", "NE", "NN", "WW", "NNE"), f"""g AS (SELECT *, abs(W - WW) + abs(N - NW) + abs(NE - N) AS dh, abs(W - NW) + abs(N - NN) + abs(NE - NNE) AS dv, (W + N) / 2.0::DOUBLE + (NE - NW) / 4.0::DOUBLE AS mid FROM n),
    q AS (SELECT *, CASE WHEN dv - dh > 80 THEN W WHEN dv - dh < -80 THEN N WHEN dv - dh > 32 THEN (mid + W) / 2 WHEN dv - dh > 8 THEN (3 * mid + W) / 4 WHEN dv - dh < -32 THEN (mid + N) / 2 WHEN dv - dh < -8 THEN (3 * mid + N) / 4 ELSE mid END AS p FROM g),
    t AS (SELECT *, CAST(floor(p) AS BIGINT) AS base, least(3, (dh + dv) // 32) AS busy, {' || '.join(f"CASE WHEN {k} < p THEN '1' ELSE '0' END" for k in ('N', 'W', 'NW', 'NE', 'NN', 'WW'))} AS texture FROM q),
    m AS (SELECT *, sum(v - base) OVER w AS total, count(*) OVER w AS seen FROM t WINDOW w AS (PARTITION BY image_id, texture, busy {_PAST}))""", "least(127, greatest(-128, base + CASE WHEN seen > 0 THEN CAST(trunc(total / CAST(seen AS DOUBLE)) AS BIGINT) ELSE 0 END))")  # fmt: skip

_phases = _Names()
_PHASE_CASES = " ".join(f"WHEN y % 2 = {a} AND x % 2 = {b} THEN {sequential.phase_prediction(_phases, (a, b), lambda *e: Text(f'least({", ".join(map(str, e))})'), lambda *e: Text(f'greatest({", ".join(map(str, e))})'))}" for a, b in sequential.PHASES)
_windowed("t59_cgplus", tuple(_phases), f"m AS (SELECT *, CASE {_PHASE_CASES} END AS p FROM n)", "p")
# a level's rank is the number of levels seen since it was last; of one never seen, its place and the larger levels seen
_register("t55_mtf", f"""WITH {v.PLANES}, p AS (SELECT image_id, y * 8 + x AS k, v, lag(y * 8 + x) OVER (PARTITION BY image_id, v ORDER BY y, x) AS before FROM planes),
    r AS (SELECT a.image_id, a.k, any_value(CASE WHEN a.before IS NULL THEN a.v + 128 ELSE 0 END) + count(DISTINCT CASE WHEN a.before IS NULL THEN CASE WHEN b.v > a.v THEN b.v END WHEN b.k > a.before THEN b.v END) AS res
        FROM p a LEFT JOIN p b ON a.image_id = b.image_id AND b.k < a.k GROUP BY a.image_id, a.k) SELECT image_id, {DIGEST} FROM r GROUP BY image_id""")  # fmt: skip
_register("t97_squeeze", f"""WITH {v.PLANES}, pair AS (SELECT image_id, (y * 8 + x) // 2 AS j, max(CASE WHEN x % 2 = 0 THEN v END) AS even, max(CASE WHEN x % 2 = 1 THEN v END) AS odd FROM planes GROUP BY ALL),
    m AS (SELECT image_id, j, odd, even - odd AS d, odd + ((even - odd) >> 1) AS mean FROM pair), s AS (SELECT *, lag(odd, 1, 0) OVER w AS b, lead(mean, 1, 0) OVER w AS a FROM m WINDOW w AS (PARTITION BY image_id ORDER BY j)),
    t AS (SELECT *, CASE WHEN b >= mean AND mean >= a THEN 1 WHEN b <= mean AND mean <= a THEN -1 ELSE 0 END AS way, abs(b - mean) AS f, abs(mean - a) AS g FROM s), u AS (SELECT *, (4 * f + 3 * g + 6) // 12 AS e FROM t),
    q AS (SELECT *, CASE WHEN e - (e & 1) > 2 * f THEN 2 * f + 1 ELSE e END AS e2 FROM u), z AS (SELECT *, way * CASE WHEN e2 + (e2 & 1) > 2 * g THEN 2 * g ELSE e2 END AS lean FROM q),
    r AS (SELECT image_id, j AS k, mean AS res FROM z UNION ALL SELECT image_id, j + 32 AS k, d - lean AS res FROM z) SELECT image_id, {DIGEST} FROM r GROUP BY image_id""")  # fmt: skip


def _digest(fn):
    weighted = "aggregate(transform(px, (p, i) -> p * (i + 1)), 0L, (a, p) -> a + p)"
    return lambda s, d: sequential.apply(v.plane_bytes(s, d), fn).select("image_id", F.expr(weighted).alias("digest"))


register("t28_grfilt", _digest(sequential.activity), f"""WITH RECURSIVE {v.PLANES}, px AS (SELECT image_id, list(v ORDER BY y, x) AS vs FROM planes GROUP BY image_id),
    st AS (SELECT image_id, 0 AS k, vs, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS above, CAST(0 AS BIGINT) AS state FROM px
        UNION ALL SELECT image_id, k + 1, vs, list_concat(list_concat(above[1:k % 8], [after]), above[k % 8 + 2:]), CASE WHEN (k + 1) % 8 = 0 THEN 0 ELSE after END
        FROM (SELECT *, CAST((state + least(state, coalesce(above[k % 8 + 2], 0)) + abs(vs[k + 1]) * 64 + greatest(coalesce(above[k % 8 + 3], 0), coalesce(above[k % 8 + 4], 0))) >> 2 AS BIGINT) AS after FROM st WHERE k < 64))
    SELECT image_id, CAST(sum((state >> 6) * (k + 1)) AS BIGINT) AS digest FROM st WHERE k < 64 GROUP BY image_id""")  # fmt: skip
register(
    "t51_quant",
    _digest(lambda p: sequential.halve(sequential.halve(p), True)),
    f"WITH {v.PLANES}, h AS (SELECT image_id, y * 8 + x AS k, v // 2 AS h FROM planes) SELECT image_id, CAST(sum(least(127, greatest(-128, (2 * h) | ((h + 128) >> 7))) * (k + 1)) AS BIGINT) AS digest FROM h GROUP BY image_id",
)


def _layers_sql() -> str:
    ctes, source = "", "planes"
    for i, (weights, bounds) in enumerate(sequential.LAYERS):
        mean = f"(({' + '.join(f'{k} * \"{name}\"' for name, k in weights.items())}) + 16) >> 5"
        if bounds:  # every sample has a neighbour among them; those outside are null there
            here = {"N": "y > 0", "W": "x > 0", "S": "y < 7", "E": "x < 7"}
            among = [f'CASE WHEN {here[b]} THEN "{b}" END' for b in bounds]
            mean = f"least(greatest({mean}, least({', '.join(among)})), greatest({', '.join(among)}))"
        ctes += f", n{i} AS ({near_sql(tuple(weights), source)}), l{i} AS (SELECT image_id, y, x, {wrapped(f'least(128, greatest(-128, {mean if bounds else f"least(127, greatest(-128, {mean}))"}))')} AS v FROM n{i})"
        source = f"l{i}"
    return f"WITH {v.PLANES}{ctes} SELECT image_id, CAST(sum(v * (y * 8 + x + 1)) AS BIGINT) AS digest FROM {source} GROUP BY image_id"


register("t81_custom4", _digest(sequential.convolve), _layers_sql())


def _dct_sql() -> str:
    """The fast DCT over eight columns of one row each, in single precision."""
    root, turns = "CAST(0.7071067811865475 AS FLOAT)", ((2, 6, "0.9238795325112868", "0.3826834323650898", "b1", "b0"), (1, 7, "0.19509032201612827", "0.9807852804032304", "e0", "e1"), (5, 3, "0.8314696123025453", "0.5555702330196022", "f0", "f1"))
    f = lambda c: f"CAST({c} AS FLOAT)"

    def lanes(source: str, shift: int) -> str:
        two = f("2")
        sql = f"SELECT image_id, line, {', '.join(f('x[' + str(k + 1) + ']') + f' AS t{k}' for k in range(8))} FROM {source}"
        for more in (
            ", ".join(f"t{k} - t{7 - k} AS d{k}" for k in range(4)), ", ".join(f"{two} * t{k} - d{k} AS a{k}" for k in range(4)),
            f"(-d2 + d1) * {root} AS m0, (d2 + d1) * {root} AS m1, a0 - a3 AS b0, a1 - a2 AS b1", f"{two} * a0 - b0 AS c0, {two} * a1 - b1 AS c1, d3 - m0 AS f0, d0 - m1 AS f1", f"{two} * d3 - f0 AS e0, {two} * d0 - f1 AS e1",
        ):
            sql = f"SELECT *, {more} FROM ({sql})"
        out = {0: f"(c0 + c1) * {root}", 4: f"(c0 - c1) * {root}"}
        for i, j, c, s, u, w in turns:
            out[i], out[j] = f"{u} * {f(c)} + {w} * {f(s)}", f"{u} * {f('-' + s)} + {w} * {f(c)}"
        values = ", ".join(f"CAST(round_even({out[k]}, 0) AS BIGINT) >> {shift}" for k in range(8))
        return f"SELECT image_id, line, unnest([{values}]) AS v, unnest(range(0, 8)) AS lane FROM ({sql})"

    return f"""WITH {v.PLANES}, lines AS (SELECT image_id, y AS line, list(v ORDER BY x) AS x FROM planes GROUP BY ALL), a AS ({lanes('lines', 0)}),
        columns_ AS (SELECT image_id, lane AS line, list(v ORDER BY line) AS x FROM a GROUP BY image_id, lane), b AS ({lanes('columns_', 3)})
        SELECT image_id, CAST(sum(v * (lane * 8 + line + 1)) AS BIGINT) AS digest FROM b GROUP BY image_id"""


register("t106_fdct8", _digest(blocks.fast_dct2d), _dct_sql())


def _quincunx_sql(levels: int = 2) -> str:
    """Each turn is a window over the grid of its level; samples off the grid pass."""
    sql = "SELECT image_id, y, x, v FROM planes"
    for level in range(levels):
        g = 1 << level
        grid = f"(y % {g} = 0 AND x % {g} = 0)"
        for turn in range(4):
            row, col = f"OVER (PARTITION BY image_id, {grid}, y ORDER BY x)", f"OVER (PARTITION BY image_id, {grid}, x ORDER BY y)"
            if turn < 2:
                sides = f"coalesce(lag(v) {col}, lead(v) {col}) + coalesce(lead(v) {col}, lag(v) {col}) + coalesce(lag(v) {row}, lead(v) {row}) + coalesce(lead(v) {row}, lag(v) {row})"
                mine = f"((y + x) // {g}) % 2 = {1 - turn}"
                inner = f"SELECT *, {sides} AS around FROM ({sql})"
            else:
                ends = f"SELECT *, coalesce(lag(v) {row}, lead(v) {row}) + coalesce(lead(v) {row}, lag(v) {row}) AS e FROM ({sql})"
                mine = f"(x // {g}) % 2 = {3 - turn}"
                inner = f"SELECT *, coalesce(lag(e) {col}, lead(e) {col}) + coalesce(lead(e) {col}, lag(e) {col}) AS around FROM ({ends})"
            sql = f"SELECT image_id, y, x, CASE WHEN {grid} AND {mine} THEN v {'+' if turn % 2 else '-'} least(127, greatest(-128, around >> 2)) ELSE v END AS v FROM ({inner})"
    return f"WITH {v.PLANES}, r AS (SELECT image_id, y * 8 + x AS k, v AS res FROM ({sql})) SELECT image_id, {DIGEST} FROM r GROUP BY image_id"


_register("t100_awav", _quincunx_sql())

def _error_at(name: str, held: str = "e") -> str:
    """A residual by the name of its place, of a list of 64 in raster order at sample `q`; 0 outside."""
    up, left = sequential.offset_of(name)
    return f"(CASE WHEN q // 8 BETWEEN {max(0, up)} AND {7 + min(0, up)} AND q % 8 BETWEEN {max(0, left)} AND {7 + min(0, left)} THEN {held}[q + 1 - {8 * up + left}] ELSE 0 END)"


def _change(*pairs: tuple[str, str]) -> str:
    return " + ".join(f"abs({_error_at(a)} - {_error_at(b)})" for a, b in pairs)


def _over_residuals(sample: str, table: str, backwards: bool, update: str, p: str) -> str:
    """r (image_id, k, res): residuals that follow from residuals already there; `c` is the sample's struct."""
    q = "63 - i" if backwards else "i"
    return f"""cs AS (SELECT image_id, list({{{sample}}} ORDER BY k) AS cs FROM ({table}) GROUP BY image_id),
        st AS (SELECT image_id, 0 AS i, cs, CAST([0 FOR z IN range(64)] AS BIGINT[]) AS e FROM cs
            UNION ALL SELECT image_id, i + 1, cs, list_concat(list_concat(e[1:q], [CAST({wrapped(p, 'c.t')} AS BIGINT)]), e[q + 2:])
            FROM (SELECT *, {update} AS update FROM (SELECT *, cs[q + 1] AS c FROM (SELECT *, {q} AS q FROM st WHERE i < 64)))),
        r AS (SELECT image_id, unnest(range(0, 64)) AS k, unnest(e) AS res FROM st WHERE i = 64)"""


_m = {k: _error_at(k) for k in ("N", "W", "NW", "NE", "NN", "WW", "NNN", "WWW", "NNE")}
_T72 = [
    f"c.N + (23 * {_m['N']} - 2 * ({_m['NN']} + {_m['NW']}) + 9 * {_m['W']}) // 110", f"c.W + (23 * {_m['W']} - 2 * ({_m['WW']} + {_m['NW']}) + 9 * {_m['N']}) // 110",
    f"3 * (c.N - c.NN) + c.NNN + ({_m['N']} // 2 + {_m['NN']} // 2 + {_m['NNN']}) // 3", f"3 * (c.W - c.WW) + c.WWW + ({_m['W']} // 2 + {_m['WW']} // 2 + {_m['WWW']}) // 3",
    f"c.W + c.NE - c.N + ((-13 * {_m['N']}) >> 4) + ({_m['W']} * 13) // 32 - ({_m['W']} >> 7)",
    f"(c.WWW + c.NN - 2 * c.NW + c.NEE + c.NEEE + c.NEEEE + (c.N - c.W) // 6 + (c.NNN - c.NE - (5 * ({_m['N']} + {_m['W']}) + {_m['WW']})) // 2) // 3",
    f"c.N + c.W - c.NW + ({_m['N']} + {_m['W']} - {_m['NW']}) // 3", f"c.N + c.NE - c.NNE + (({_m['N']} + {_m['NE']} + {_m['NNE']} + 4) >> 3)",
]
_near72 = ("N", "W", "NN", "WW", "NNN", "WWW", "NE", "NW", "NEE", "NEEE", "NEEEE", "NNE")
_lg = lambda e: f"CAST(floor(log2({e})) AS INT)"
_recursive(
    "t72_wgrad6", _near72, "'v': v, " + ", ".join(f"'{k}': \"{k}\"" for k in _near72),
    {"e": "CAST([0 FOR z IN range(64)] AS BIGINT[])", "mean": "CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])", "far": _ZEROS, "above": _ZEROS, "here": "CAST([] AS BIGINT[])"},
    ["i AS q, i % 8 AS x", f"[{', '.join(f'CAST({t} AS BIGINT)' for t in _T72)}] AS p",
     f"[(mean[j] >> 3) + 2 * (CASE WHEN x > 0 THEN above[8 * x - 8 + j] + here[8 * x - 8 + j] ELSE 0 END + above[8 * x + j]) + far[8 * x + j] + far[8 * x + 8 + j] + above[8 * x + 8 + j] + CASE WHEN x > 1 THEN here[8 * x - 16 + j] ELSE 0 END + 1 FOR j IN {_EIGHT}] AS error",
     f"[greatest(0, {_lg('t + 1')} - 6) FOR t IN error] AS sh", f"[((CAST([{', '.join(map(str, sequential.ShiftMix.WEIGHTS))}] AS BIGINT[])[j] * (32768 // ((error[j] >> sh[j]) + 1))) >> sh[j]) + 4 FOR j IN {_EIGHT}] AS w0",
     f"[t >> ({_lg('CAST(list_sum(w0) AS BIGINT)')} - 5) FOR t IN w0] AS w", f"({' + '.join(f'w[{j}] * p[{j}]' for j in range(1, 9))}) AS total, CAST(list_sum(w) AS BIGINT) AS ws",
     "least(greatest(c.N, c.W, c.NE), greatest(least(c.N, c.W, c.NE), (total * (32768 // ws)) >> 15)) AS pp", f"[abs(c.v - p[j]) FOR j IN {_EIGHT}] AS miss", f"[miss[j] - list_min(miss) FOR j IN {_EIGHT}] AS over_best"],
    "pp",
    {"e": "list_concat(list_concat(e[1:q], [c.v - pp]), e[q + 2:])", "mean": f"[mean[j] + ((over_best[j] * 64 - mean[j] + 4) >> 3) FOR j IN {_EIGHT}]", "far": "CASE WHEN x = 7 THEN above ELSE far END",
     "above": "CASE WHEN x = 7 THEN list_concat(list_concat(here, over_best), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])) ELSE above END", "here": "CASE WHEN x = 7 THEN CAST([] AS BIGINT[]) ELSE list_concat(here, over_best) END"},
)
_m70 = {k: _error_at(k) for k in ("N", "W", "NW", "NE", "NN", "WW", "NNN", "WWW", "NEE", "NEEE")}
_T70 = [
    *_T72, f"(4 * (c.N + c.NNN) - 6 * c.NN + c.NNNW + c.NNNE - (c.NNWW + c.NNEE) // 2 + c.NNE + c.NNW - c.NE - c.NW - {_m70['N']} - {_m70['NN']} + {_m70['NNN']}) // 3",
    f"(6 * (c.W + c.WWW) + 20 * c.WW + ({_m70['W']} - {_m70['WW']} + {_m70['WWW']}) // 3) // 32", f"(c.W + 3 * c.NW - c.NWW - c.NNWW) // 2 + {_m70['NW']} // 4 + {_m70['W']} // 6",
    f"(3 * c.NE + c.NEE + c.NEEEE - c.NNEE - c.NNEEE + (3 * {_m70['NE']} + 6 * {_m70['NEE']} + 3 * {_m70['NEEE']}) // 2) // 3",
]
_near70 = (*_near72, "NNNW", "NNNE", "NNWW", "NNEE", "NNW", "NWW", "NNEEE")
_TWELVE, _ZEROS108 = "[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]", "CAST([0 FOR z IN range(108)] AS BIGINT[])"
_lanes = lambda t: " + ".join("(" + " + ".join(f"(({t(k)} + {t(k + 4)}) + {t(k + 8)})" for k in two) + ")" for two in ((3, 4), (1, 2)))
_recursive(
    "t70_wgrad4", _near70, "'v': v, " + ", ".join(f"'{k}': \"{k}\"" for k in _near70),
    {"e": "CAST([0 FOR z IN range(64)] AS BIGINT[])", "faded": "CAST([0 FOR z IN range(12)] AS BIGINT[])", "far": _ZEROS108, "above": _ZEROS108, "here": "CAST([] AS BIGINT[])"},
    ["i AS q, i % 8 AS x", f"[{', '.join(f'CAST({t} AS BIGINT)' for t in _T70)}] AS p",
     f"[CAST([{', '.join(map(str, sequential.FadedMixOfMore.WEIGHTS))}][j] AS DOUBLE) / (((faded[j] + CASE WHEN x > 0 THEN above[12 * x - 12 + j] ELSE 0 END + 2 * above[12 * x + j] + above[12 * x + 12 + j] + far[12 * x + 12 + j]) >> 1) + 1) FOR j IN {_TWELVE}] AS w, [abs(c.v - p[j]) * 2 FOR j IN {_TWELVE}] AS error",
     f"list_concat(here, [(2 * CASE WHEN x > 0 THEN here[12 * x - 12 + j] ELSE 0 END + error[j] + above[12 * x + 12 + j]) >> 2 FOR j IN {_TWELVE}]) AS grown, list_concat(list_concat(above[1:12 * x + 12], [above[12 * x + 12 + j] + error[j] FOR j IN {_TWELVE}]), above[12 * x + 25:]) AS raised",
     f"least(greatest(c.N, c.W, c.NE, c.NEEE), greatest(least(c.N, c.W, c.NE, c.NEEE), CAST(round_even(({_lanes(lambda k: f'w[{k}] * p[{k}]')}) / ({_lanes(lambda k: f'w[{k}]')}), 0) AS BIGINT))) AS pp"],
    "pp",
    {"e": "list_concat(list_concat(e[1:q], [c.v - pp]), e[q + 2:])", "faded": f"[((faded[j] + error[j]) * 97) >> 7 FOR j IN {_TWELVE}]", "far": "CASE WHEN x = 7 THEN raised ELSE far END",
     "above": "CASE WHEN x = 7 THEN list_concat(grown, CAST([0 FOR z IN range(12)] AS BIGINT[])) ELSE raised END", "here": "CASE WHEN x = 7 THEN CAST([] AS BIGINT[]) ELSE grown END"},
)


def _errors_at(name: str) -> str:
    """The error of predictor j at a place, of a list `m` of five for each of 64 samples."""
    up, left = sequential.offset_of(name)
    return f"(CASE WHEN q // 8 BETWEEN {max(0, up)} AND {7 + min(0, up)} AND q % 8 BETWEEN {max(0, left)} AND {7 + min(0, left)} THEN m[(q - {8 * up + left}) * 5 + j] ELSE 0 END)"


_FIVE = "[1, 2, 3, 4, 5]"
_e = {k: _error_at(k) for k in ("N", "W", "NW", "NE", "NEEE")}
_T93 = [
    "greatest(least(c.N, c.W), least(greatest(c.N, c.W), c.N + c.W - c.NW))", "c.W + c.NE - c.N", f"c.N - ((({_e['N']} + {_e['W']} + {_e['NE']}) * -92) >> 8)", f"c.W - ((({_e['N']} + {_e['W']} + {_e['NW']}) * -91) >> 8)",
    f"c.N - ((223 * {_e['NW']} + 81 * {_e['N']} + 189 * {_e['NE']} + 92 * (c.NN - c.N) - 258 * (c.NW - c.W)) >> 8)",
]
_FOUR, _ZEROS36 = "[1, 2, 3, 4]", "CAST([0 FOR z IN range(36)] AS BIGINT[])"
_recursive(
    "t73_wgrad7", ("N", "W", "NW", "NE", "NN", "NEEE"), "'v': v, " + ", ".join(f"'{k}': \"{k}\"" for k in ("N", "W", "NW", "NE", "NN", "NEEE")),
    {"e": "CAST([0 FOR z IN range(64)] AS BIGINT[])", "mean": "CAST([0, 0, 0, 0] AS BIGINT[])", "above": _ZEROS36, "here": "CAST([] AS BIGINT[])"},
    ["i AS q, i % 8 AS x", f"[{', '.join(f'CAST({t} AS BIGINT)' for t in _T93[1:])}] AS p",
     f"[(CAST([{', '.join(map(str, sequential.CorrectedMix.WEIGHTS))}] AS BIGINT[])[j] * 256) // ((mean[j] >> 4) + CASE WHEN x > 0 THEN above[4 * x - 4 + j] ELSE 0 END + above[4 * x + j] + above[4 * x + 4 + j] + 2) FOR j IN {_FOUR}] AS w",
     "least(greatest(c.N, c.W, c.NE, c.NEEE), greatest(least(c.N, c.W, c.NE, c.NEEE), (" + " + ".join(f"w[{j}] * p[{j}]" for j in range(1, 5)) + ") // greatest(1, w[1] + w[2] + w[3] + w[4]))) AS pp", f"[(abs(c.v - p[j]) + 4) >> 3 FOR j IN {_FOUR}] AS miss", f"[miss[j] - list_min(miss) FOR j IN {_FOUR}] AS over_best"],
    "pp",
    {"e": "list_concat(list_concat(e[1:q], [c.v - pp]), e[q + 2:])", "mean": f"[mean[j] + ((over_best[j] * 64 - mean[j] + 4) >> 3) FOR j IN {_FOUR}]",
     "above": f"CASE WHEN x = 7 THEN list_concat(list_concat(here, over_best), CAST([0, 0, 0, 0] AS BIGINT[])) ELSE list_concat(list_concat(above[1:4 * x + 4], [above[4 * x + 4 + j] + over_best[j] FOR j IN {_FOUR}]), above[4 * x + 9:]) END", "here": "CASE WHEN x = 7 THEN CAST([] AS BIGINT[]) ELSE list_concat(here, over_best) END"},
)


def _parametric(name: str, values: tuple[int, ...]) -> None:
    """T-78 for one channel: neighbours come in 1/256; `e` is what was missed so far, `above` and `here` hold 20 errors a place."""
    f, n = values[20:], {k: f'c."{k}"' for k in sequential.PARAMETRIC_NEAR}
    held = lambda t, *more: "least(greatest({0}), greatest(least({0}), {1}))".format(", ".join(n[k] for k in ("W", "N", "NE", *more)), t)
    t = "{N} - ((enw * %d + en * %d + ene * %d + ({NN} - {N}) * %d + ({NW} - {W}) * %d) >> 8)" % f[:5]
    terms = [
        t, f"{{W}} - (((en + ew + enw) * {f[5]}) >> 8)", f"{{N}} - (((en + ew + ene) * {f[6]}) >> 8)", "{W} + {NE} - {N}", f"{{W}} - ((ew * {f[7]}) >> 8)", f"{{N}} - ((en * {f[8]}) >> 8)", f"{{NW}} - ((enw * {f[9]}) >> 8)", f"{{NE}} - ((ene * {f[10]}) >> 8)",
        held("{W} + {N} - {NW}", "NW"), held("{W} + {NE} - {N}", "NW"), held("{N} + {NW} - {NNW}", "NW"), held("{N} + {NE} - {NNE}", "NEE"), "({W} + {NEE}) >> 1", "{NNNNNN}", "({NEEEE} + {NEEEEEE}) >> 1", "({WWWW} + {WWWWWW}) >> 1",
        "({W} + {N} + {NEEEEE} + {NEEEEEEE}) >> 2", held("2 * {N} - {NN}", "NEE"), "({N} + {NNN}) >> 1", "(3 * {W} + 3 * {N} - 2 * {NW}) >> 2",
    ]
    places, zeros = "range(1, 21)", "CAST([0 FOR z IN range(20)] AS BIGINT[])"
    _recursive(
        name, sequential.PARAMETRIC_NEAR, "'v': v, " + ", ".join(f"'{k}': CAST(\"{k}\" AS BIGINT) * 256" for k in sequential.PARAMETRIC_NEAR),
        {"e": "CAST([0 FOR z IN range(64)] AS BIGINT[])", "above": "CAST([0 FOR z IN range(180)] AS BIGINT[])", "here": "CAST([] AS BIGINT[])"},
        ["i AS q, i % 8 AS x", "CASE WHEN q > 7 THEN e[q - 7] ELSE 0 END AS en, CASE WHEN x > 0 THEN e[q] ELSE 0 END AS ew, CASE WHEN q > 7 AND x > 0 THEN e[q - 8] ELSE 0 END AS enw, CASE WHEN q > 7 AND x < 7 THEN e[q - 6] ELSE 0 END AS ene",
         f"[{', '.join(f'CAST({t.format(**n)} AS BIGINT)' for t in terms)}] AS p",
         f"[(CAST([{', '.join(map(str, values[:20]))}] AS BIGINT[])[j] * 256) // (CASE WHEN x > 0 THEN above[20 * x - 20 + j] ELSE 0 END + above[20 * x + j] + above[20 * x + 20 + j] + 1) FOR j IN {places}] AS w",
         "CAST(list_sum(w) AS BIGINT) AS s, " + " + ".join(f"w[{j}] * p[{j}]" for j in range(1, 21)) + " AS wp", held("CASE WHEN s = 0 THEN p[1] ELSE ((s >> 1) - 1 + wp) // (CASE WHEN s = 0 THEN 1 ELSE s END) END") + " AS pp", f"[abs(c.v * 256 - p[j]) FOR j IN {places}] AS miss"],
        "(pp + 127) >> 8",
        {"e": "list_concat(list_concat(e[1:q], [c.v * 256 - pp]), e[q + 2:])",
         "above": f"CASE WHEN x = 7 THEN list_concat(list_concat(here, miss), {zeros}) WHEN q < 8 THEN above ELSE list_concat(list_concat(above[1:20 * x + 20], [above[20 * x + 20 + j] + miss[j] FOR j IN {places}]), above[20 * x + 41:]) END", "here": "CASE WHEN x = 7 THEN CAST([] AS BIGINT[]) ELSE list_concat(here, miss) END"},
    )


for _k, _name in enumerate(("t78_mm", "t78_mm_second", "t78_mm_third")):
    _parametric(_name, sequential.ParametricMix.PARAMETERS[_k])


#: T-85's directions: the changes that count, and the samples ahead.
_CHANGES = (
    ("2 * (abs(W - WW) + abs(NW - NWW) + abs(N - NW) + abs(NE - N))", "2 * W"), ("2 * (abs(W - NW) + abs(NW - NNW) + abs(N - NN) + abs(NE - NNE))", "2 * N"),
    ("2 * (abs(W - NWW) + abs(NW - NNWW) + abs(N - NNW) + abs(NE - NN))", "2 * NW"), ("2 * (abs(W - N) + abs(NW - NN) + abs(N - NNE) + abs(NE - NNEE))", "2 * NE"),
    ("abs(2 * W - WW - NWW) + abs(2 * NW - NNW - NNWW) + abs(2 * N - NW - NNW) + abs(2 * NE - N - NN)", "W + NW"),
    ("abs(2 * W - NWW - NW) + abs(2 * NW - NNWW - NNW) + abs(2 * N - NNW - NN) + abs(2 * NE - NN - NNE)", "NW + N"),
    ("abs(2 * W - NW - N) + abs(2 * NW - NNW - NN) + abs(2 * N - NN - NNE) + abs(2 * NE - NNE - NNEE)", "N + NE"),
)
_recursive(
    "t85_angles", ("N", "W", "NW", "NE", "NN", "WW", "NNW", "NNE", "NWW", "NNWW", "NNEE"),
    f"'v': v, 'cost': [{', '.join(f'CAST({c} AS BIGINT)' for c, _ in _CHANGES)}], 'ahead': [{', '.join(f'CAST({a} AS BIGINT)' for _, a in _CHANGES)}], 'linear': least(2048, greatest(-2048, 9 * (N + W) + 2 * (NE - NW) - NN - WW)),"
    " 'active': abs(W - WW) + abs(N - NW) + abs(N - NE) + abs(W - NW) + abs(N - NN) + abs(NE - NNE), 'over': [2 * N - NN, 2 * W - WW, NN, WW, NE, NW, N, W]",
    {"e": "CAST(0 AS BIGINT)", "seen": "CAST([] AS BIGINT[])", "learned": "CAST([] AS BIGINT[])"},
    ["list_min(c.cost) AS m, c.active + 2 * abs(CASE WHEN i % 8 = 0 THEN 0 ELSE e END) AS active",
     f"CAST(list_sum([CASE WHEN t * 255 <= 8 * (list_sum(c.cost) - 7 * m) THEN 1 ELSE 0 END FOR t IN [{', '.join(map(str, sequential.Angles.THRESHOLDS))}]]) AS BIGINT) AS share, CAST(list_sum([CASE WHEN t <= active THEN 1 ELSE 0 END FOR t IN [{', '.join(map(str, sequential.Angles.ACTIVITY))}]]) - 1 AS BIGINT) AS level",
     "CAST(8 * share * c.ahead[list_position(c.cost, m)] + (8 - share) * c.linear + 64 AS BIGINT) >> 7 AS p0",
     "(level >> 1) * 256 + CAST(list_sum([CASE WHEN p0 > c.over[j] THEN 1 << (8 - j) ELSE 0 END FOR j IN range(1, 9)]) AS BIGINT) AS ctx",
     "coalesce(learned[list_max([j FOR j IN range(1, i + 1) IF seen[j] = ctx])], 0) AS corr", "least(128, greatest(-128, p0 + (corr >> 8))) AS pp"],
    "pp", {"e": "c.v - pp", "seen": "list_append(seen, ctx)", "learned": "list_append(learned, corr + (((c.v - pp) * 128 - corr + 64) >> 7))"},
)


class _As(dict):
    """Neighbours as SQL text by a form; remembers which were asked for."""

    def __init__(self, form):
        super().__init__()
        self.form = form

    def __missing__(self, name: str) -> Text:
        self[name] = text = Text(self.form(name))
        return text


_here32 = _As(lambda k: f"c.{k}")
_first32, _second32 = list(map(str, sequential.ols8_terms(_here32))), list(map(str, sequential.ols8_terms(_As(lambda k: _error_at(k, "r")))))
_TWENTY_ONE = "[" + ", ".join(map(str, range(1, 22))) + "]"
_sum32 = lambda w, p: " + ".join(f"{w}[{k}] * {p}[{k}]" for k in range(1, 22))
_SAMPLE32 = "'v': v, " + ", ".join(f"'{k}': \"{k}\"" for k in _here32)
_STATE32 = {"r": "CAST([0 FOR z IN range(64)] AS BIGINT[])", "w": "CAST([0 FOR z IN range(21)] AS BIGINT[])", "u": "CAST([0 FOR z IN range(336)] AS BIGINT[])"}
_STEPS32 = [
    "i AS q, 21 * (((((c.N + c.W) // 2) * 16) >> 8) & 15) AS place", f"[CAST(greatest(least(c.N, c.W), least(greatest(c.N, c.W), {_first32[0]})) AS BIGINT), {', '.join(f'CAST({t} AS BIGINT)' for t in _first32[1:])}, 1] AS p, [{', '.join(f'CAST({t} AS BIGINT)' for t in _second32)}, 1] AS p2, u[place + 1:place + 21] AS w2",
    f"{_sum32('w2', 'p2')} AS raw", f"({_sum32('w', 'p')} + raw * 8 + 262144) >> 19 AS p1, (raw + 65536) >> 17 AS more", "p1 + more AS pp", "CAST(sign(c.v - p1) AS BIGINT) AS s1, CAST(sign(c.v - pp) AS BIGINT) AS s2",
]
_P32 = "least(greatest(c.N, c.W, c.NE, c.NEEE), greatest(least(c.N, c.W, c.NE, c.NEEE), pp))"
_AFTER32 = {"r": "list_concat(list_concat(r[1:q], [c.v - p1]), r[q + 2:])", "w": f"[w[j] + s1 * p[j] FOR j IN {_TWENTY_ONE}]", "u": f"list_concat(list_concat(u[1:place], [w2[j] + s2 * p2[j] FOR j IN {_TWENTY_ONE}]), u[place + 22:])"}
_recursive("t32_ols8", tuple(_here32), _SAMPLE32, _STATE32, _STEPS32, _P32, _AFTER32)
_near93 = ("N", "W", "NW", "NE", "NN")
_recursive(
    "t93_lwav", _near93, "'v': v, " + ", ".join(f"'{k}': \"{k}\" * 256" for k in _near93), {"e": "CAST([0 FOR z IN range(64)] AS BIGINT[])", "m": "CAST([0 FOR z IN range(320)] AS BIGINT[])", "f": "CAST([65536, 65536, 65536, 65536, 65536] AS BIGINT[])"},
    ["i AS q", f"[{', '.join(f'CAST({t} AS BIGINT)' for t in _T93)}] AS p", f"[(f[j] * CAST([8448, 3512, 3618, 6175, 3059] AS BIGINT[])[j]) // ({' + '.join(_errors_at(k) for k in ('NW', 'N', 'NE', 'WW', 'W'))} + 1) FOR j IN {_FIVE}] AS w",
     "w[1] + w[2] + w[3] + w[4] + w[5] AS ws", "CASE WHEN ws = 0 THEN p[1] ELSE (" + " + ".join(f"w[{j}] * p[{j}]" for j in range(1, 6)) + " + (ws >> 1)) // ws END AS mean", "least(greatest(c.N, c.W, c.NE), greatest(least(c.N, c.W, c.NE), mean)) AS pp",
     f"2 * {_e['W']} + (c.v * 256 - pp) + {_e['N']} + {_e['NE']} + {_e['NEEE']} AS change"],
    "((pp + 128) >> 8)",
    {"e": "list_concat(list_concat(e[1:q], [c.v * 256 - pp]), e[q + 2:])", "m": f"list_concat(list_concat(m[1:5 * q], [abs(c.v * 256 - p[j]) FOR j IN {_FIVE}]), m[5 * q + 6:])", "f": f"[least(65536, greatest(-65536, f[j] + ((change * p[j]) >> 8))) FOR j IN {_FIVE}]"},
)
_GRADIENT = "greatest(least(N, W), least(greatest(N, W), N + W - NW))"
_south = f"(CASE WHEN {_change(('SSW', 'SW'), ('SS', 'S'), ('SE', 'E'))} > {_change(('E', 'EE'), ('S', 'SE'), ('S', 'SW'))} THEN {_error_at('S')} ELSE {_error_at('E')} END) // 4"
_register("t94_zipper", f"""WITH RECURSIVE {v.PLANES}, n AS ({near_sql(('N', 'W', 'NW'))}), {_over_residuals(f"'t': v, 'm': {_GRADIENT}", 'n', True, _south, 'least(127, greatest(-128, c.m + update))')}
    SELECT image_id, {DIGEST} FROM r GROUP BY image_id""")  # fmt: skip

def _quantiser_sql() -> str:
    terms = [_error_at("W"), f"{_error_at('N')} + {_error_at('W')} - {_error_at('NW')}", f"2 * {_error_at('N')} - {_error_at('NN')}", _error_at("NE")]
    sides = ", ".join(map(_error_at, ("N", "W", "NE", "NEEE")))
    steps = [
        "i AS q, vs[i + 1] AS v", f"[{', '.join(f'CAST({t} AS BIGINT)' for t in terms)}] AS p, least({sides}) AS lo, greatest({sides}) AS hi, {_error_at('W', 'm')} AS west, {_error_at('NEEE', 'm')} AS far",
        f"({' + '.join(f'w[{k}] * p[{k}]' for k in _R)}) >> {sequential.QUANT_SHIFT} AS free, least(west + 1, {1 << sequential.QUANT_DISTANCE}) AS divisor", "least(hi, greatest(lo, free)) AS pp", "(v - pp) // divisor AS level",
        "least(127, greatest(-128, level * divisor + pp)) AS back", "CAST(sign(back - free) AS BIGINT) AS sg",
    ]
    inner = "SELECT * FROM st WHERE i < 64"
    for more in steps:
        inner = f"SELECT *, {more} FROM ({inner})"
    zeros = "CAST([0 FOR z IN range(64)] AS BIGINT[])"
    put = lambda held, e: f"list_concat(list_concat({held}[1:q], [{e}]), {held}[q + 2:])"
    running = f"(2 * west + (CASE WHEN level < 0 THEN -2 * level - 1 ELSE 2 * level END) * {1 << sequential.QUANT_DISTANCE} + far) >> 2"
    return f"""WITH RECURSIVE {v.PLANES}, px AS (SELECT image_id, list(v ORDER BY y, x) AS vs FROM planes GROUP BY image_id),
        st AS (SELECT image_id, 0 AS i, vs, CAST(0 AS BIGINT) AS got, {zeros} AS e, {zeros} AS m, CAST([{', '.join([str(sequential.QUANT_FIRST)] * 4)}] AS BIGINT[]) AS w FROM px
            UNION ALL SELECT image_id, i + 1, vs, CAST(level AS BIGINT), {put('e', 'CAST(back AS BIGINT)')}, {put('m', f'CAST({running} AS BIGINT)')}, [{', '.join(f'w[{k}] + sg * p[{k}]' for k in _R)}] FROM ({inner}))
        SELECT image_id, CAST(sum(got * i) AS BIGINT) AS levels, CAST(max(CASE WHEN i = 64 THEN list_sum([e[j] * j FOR j IN range(1, 65)]) END) AS BIGINT) AS restored FROM st GROUP BY image_id"""


def _quantiser(s, d):
    def run(batches):
        for ids, p in sequential._planes(batches):
            place = np.arange(1, p[0].size + 1)
            levels, back = (a.reshape(len(p), -1) @ place for a in sequential.adaptive_quantiser(p))
            yield pa.RecordBatch.from_arrays([ids, pa.array(levels), pa.array(back)], ["image_id", "levels", "restored"])

    return v.plane_bytes(s, d).select("image_id", "px").mapInArrow(run, "image_id long, levels long, restored long")


register("t27_adaquant", _quantiser, _quantiser_sql())

def _impulse(s, d):
    """T-43, T-44: what the inverse of a linear predictor makes of one sample of 64 in an empty plane, per predictor."""
    names = ("t83_custom", "c18_av5", "c18_avb")
    rows = s.createDataFrame([(n, i) for i, n in enumerate(names)], "predictor string, image_id long")

    def run(batches):
        for b in batches:
            for n in b["predictor"].to_pylist():
                plane = np.zeros((1, 8, 8), dtype=np.int64)
                plane[0, 0, 0] = 64
                back = predict.inverse(plane, n).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([int(back @ np.arange(1, 65))]), pa.array([int(np.abs(back).sum())])], ["predictor", "digest", "magnitude"])

    return rows.select("predictor").mapInArrow(run, "predictor string, digest long, magnitude long")


def _impulse_sql() -> str:
    kernels = {"t83_custom": (5, {"N": 13, "W": 14, "NW": -5, "NE": 8, "NN": 1, "WW": 1}), "c18_av5": (3, {"N": 5, "W": 8, "NW": -5, "NE": 1, "WW": -1}), "c18_avb": (8, {"NNWW": 4, "NNW": 3, "NN": -31, "NNE": -38, "NWW": 7, "NW": -158, "N": 219, "NE": 30, "NEE": 19, "WW": -42, "W": 243})}
    case = " ".join(f"WHEN '{n}' THEN ({' + '.join(f'{w} * {_error_at(k)}' for k, w in taps.items())}) >> {shift}" for n, (shift, taps) in kernels.items())
    sides = ", ".join(map(_error_at, ("N", "W", "NE")))
    return f"""WITH RECURSIVE st AS (SELECT unnest([{', '.join(map(repr, kernels))}]) AS predictor, 0 AS i, CAST([0 FOR z IN range(64)] AS BIGINT[]) AS e
            UNION ALL SELECT predictor, i + 1, list_concat(list_concat(e[1:q], [CAST((((CASE WHEN q = 0 THEN 64 ELSE 0 END) + least(greatest({sides}), greatest(least({sides}), p)) + 128) & 255) - 128 AS BIGINT)]), e[q + 2:])
            FROM (SELECT *, CASE predictor {case} END AS p FROM (SELECT *, i AS q FROM st WHERE i < 64)))
        SELECT predictor, CAST(list_sum([e[j] * j FOR j IN range(1, 65)]) AS BIGINT) AS digest, CAST(list_sum([abs(t) FOR t IN e]) AS BIGINT) AS magnitude FROM st WHERE i = 64"""


register("t43_t44_impulse", _impulse, _impulse_sql())

# --- models over the channels of an image: the SQL numbers planes 3 * image + channel in coding order

CHANNELS = "SELECT image_id // 3 AS image_id, CAST(sum(res * (k + 1) * (image_id % 3 + 1)) AS BIGINT) AS digest, CAST(sum(abs(res)) AS BIGINT) AS magnitude, CAST(0 AS BIGINT) AS mismatches FROM r GROUP BY 1"


def _chosen_sql() -> str:
    """sig (image_id, y, x, t, o, v): targets, offsets and what these leave, by the recipe of the least changes."""
    signals = ("r", "g", "b", "(r - g)", "(g - b)", "(b - r)")
    lags = ", ".join(f"abs({x} - lag({x}, 1, 0) OVER w) AS q{i}" for i, x in enumerate(signals))
    costs = "[" + ", ".join(" + ".join(f"q{analysis.SIGNAL_OF[c]}" for c in r) for r in color.RECIPES) + "]"
    rows = []
    for k, recipe in enumerate(color.RECIPES):
        for c, name in enumerate(recipe):
            t, _, o = name.partition("-")
            rows.append(f"SELECT image_id * 3 + {c} AS image_id, y, x, {t} AS t, {o or 0} AS o, {t} - {o or 0} AS v FROM rgb JOIN chosen USING (image_id) WHERE recipe = {k}")
    return f"""{v.RGB}, moves AS (SELECT image_id, {lags} FROM rgb WINDOW w AS (PARTITION BY image_id ORDER BY y, x)),
        changes AS (SELECT image_id, {', '.join(f'CAST(sum(q{i}) AS BIGINT) AS q{i}' for i in range(6))} FROM moves GROUP BY image_id),
        chosen AS (SELECT image_id, CAST(list_position({costs}, list_min({costs})) - 1 AS INT) AS recipe FROM changes), sig AS ({' UNION ALL '.join(rows)})"""


def _by_channel(name: str, sql: str) -> None:
    register(f"{name}_roundtrip", lambda s, d: analysis.channel_roundtrip(v.rgb_bytes(s, d), name), sql)


_by_channel("t37_cgcrct", f"""WITH {_chosen_sql()}, n AS ({near_sql(('N', 'W', 'NW'), 'sig')}), m AS (SELECT n.*, t, o FROM n JOIN sig USING (image_id, y, x)),
    r AS (SELECT image_id, k, {wrapped('least(127, greatest(-128, greatest(least(N, W), least(greatest(N, W), N + W - NW)) + o))', 't')} AS res FROM m) {CHANNELS}""")  # fmt: skip


def _signs_sql(parts: list[str], near: str, first: int, shift: int, step: int, bias: int) -> str:
    """r (image_id, k, res): a mix whose weights move by signs, over cs of samples with target t and offset o."""
    places = range(1, len(parts) + 1)
    bounds = ", ".join(f'"{k}"' for k in ("N", "W", "NE", "NEEE"))
    return f"""cs AS (SELECT image_id, list({{'v': v, 't': t, 'o': o, 'p': [{', '.join(f'CAST({e} AS BIGINT)' for e in parts)}], 'lo': least({bounds}), 'hi': greatest({bounds})}} ORDER BY k) AS cs FROM ({near}) GROUP BY image_id),
        st AS (SELECT image_id, 0 AS i, cs, CAST(0 AS BIGINT) AS res, CAST([{', '.join([str(first)] * len(parts))}] AS BIGINT[]) AS w, CAST({bias} AS BIGINT) AS bias FROM cs
            UNION ALL SELECT image_id, i + 1, cs, CAST({wrapped('least(127, greatest(-128, least(c.hi, greatest(c.lo, p)) + c.o))', 'c.t')} AS BIGINT), [{', '.join(f'w[{k}] + sg * c.p[{k}]' for k in places)}], bias + sg * {step}
            FROM (SELECT *, CAST(sign(c.v - p) AS BIGINT) AS sg FROM (SELECT *, (bias + {' + '.join(f'w[{k}] * c.p[{k}]' for k in places)}) >> {shift} AS p FROM (SELECT *, cs[i + 1] AS c FROM st WHERE i < 64)))),
        r AS (SELECT image_id, i - 1 AS k, res FROM st WHERE i > 0)"""


_terms, _shift, _first, _step = sequential.MIXES["t30_ols7"]
_l1 = _Names()
_l1_parts = list(map(str, _terms(_l1)))
_by_channel(
    "t29_l1crct",
    f"WITH RECURSIVE {_chosen_sql()}, n AS ({near_sql(tuple(dict.fromkeys([*_l1, 'N', 'W', 'NE', 'NEEE'])), 'sig')}), {_signs_sql(_l1_parts, 'SELECT n.*, t, o FROM n JOIN sig USING (image_id, y, x)', _first, _shift, _step, 1 << _shift >> 1)} {CHANNELS}",
)


def _two_stages_sql() -> str:
    inner = "SELECT *, cs[i + 1] AS c FROM st WHERE i < 64"
    for more in _STEPS32:
        inner = f"SELECT *, {more} FROM ({inner})"
    return f"""WITH RECURSIVE {_chosen_sql()}, n AS ({near_sql(tuple(_here32), 'sig')}), cs AS (SELECT image_id, list({{{_SAMPLE32}, 't': t, 'o': o}} ORDER BY k) AS cs FROM (SELECT n.*, t, o FROM n JOIN sig USING (image_id, y, x)) GROUP BY image_id),
        st AS (SELECT image_id, 0 AS i, cs, CAST(0 AS BIGINT) AS res, {', '.join(f'{e} AS {k}' for k, e in _STATE32.items())} FROM cs
            UNION ALL SELECT image_id, i + 1, cs, CAST({wrapped(f'least(127, greatest(-128, {_P32} + c.o))', 'c.t')} AS BIGINT), {', '.join(_AFTER32.values())} FROM ({inner})),
        r AS (SELECT image_id, i - 1 AS k, res FROM st WHERE i > 0) {CHANNELS}"""


_by_channel("t31_l1bcrct", _two_stages_sql())


def _cross_sql() -> str:
    names = _Names()
    parts = list(map(str, sequential.mixnc_terms(names)))
    plain = tuple(dict.fromkeys([*(k for k in names if not k.startswith("known")), "N", "W", "NE", "NEEE"]))
    planes = " UNION ALL ".join(f"SELECT image_id * 3 + {i} AS image_id, y, x, {c} AS v FROM rgb" for i, c in enumerate("rgb"))
    known = "SELECT image_id, y, x, g AS known, lag(g, 1, 0) OVER (PARTITION BY image_id, y ORDER BY x) AS \"knownW\", lag(g, 1, 0) OVER (PARTITION BY image_id, x ORDER BY y) AS \"knownN\" FROM rgb"
    green = list(map(str, sequential.mixn_terms(_Names())))
    mixed = _signs_sql(parts, "SELECT n.*, n.v AS t, 0 AS o, q.known, q.\"knownW\", q.\"knownN\" FROM n JOIN q ON q.image_id = n.image_id // 3 AND q.y = n.y AND q.x = n.x WHERE n.image_id % 3 <> 1", (1 << 18) // 8, 18, 0, 1 << 17)
    other = _signs_sql(green, "SELECT n.*, n.v AS t, 0 AS o FROM n WHERE n.image_id % 3 = 1", (1 << 18) // 6, 18, 0, 1 << 17)
    other = other.replace("cs AS (", "cs1 AS (", 1).replace("st AS (", "st1 AS (", 1).replace("FROM cs\n", "FROM cs1\n").replace("FROM st WHERE i < 64", "FROM st1 WHERE i < 64").replace("r AS (SELECT image_id, i - 1 AS k, res FROM st WHERE i > 0)", "r1 AS (SELECT image_id, i - 1 AS k, res FROM st1 WHERE i > 0)")
    mixed = mixed.replace("r AS (SELECT image_id, i - 1 AS k, res FROM st", "r0 AS (SELECT image_id, i - 1 AS k, res FROM st")
    return f"WITH RECURSIVE {v.RGB}, chan AS ({planes}), n AS ({near_sql(plain, 'chan')}), q AS ({known}), {mixed}, {other}, r AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1) {CHANNELS}"


_by_channel("t24_mixnc", _cross_sql())


_north = f"(CASE WHEN {_change(('W', 'WW'), ('N', 'NW'), ('NE', 'N'))} < {_change(('W', 'NW'), ('N', 'NN'), ('NE', 'NNE'))} THEN {_error_at('N')} ELSE {_error_at('W')} END) // 4"
_PU_PLANES = " UNION ALL ".join(f"SELECT image_id * 3 + {i} AS image_id, y, x, {c} AS t, {o} AS o, {c} - {o} AS v FROM rgb" for i, (c, o) in enumerate((("r", "g"), ("g", "0"), ("b", "g"))))
_PU_P = "CASE WHEN c.luma THEN c.m + update ELSE least(127, greatest(-128, c.m + update + c.o)) END"
_by_channel("t61_pu", f"""WITH RECURSIVE {v.RGB}, sig AS ({_PU_PLANES}), n AS ({near_sql(('N', 'W', 'NW'), 'sig')}),
    {_over_residuals(f"'t': t, 'o': o, 'luma': luma, 'm': {_GRADIENT}", 'SELECT n.*, t, o, n.image_id % 3 = 1 AS luma FROM n JOIN sig USING (image_id, y, x)', False, _north, _PU_P).replace("r AS (SELECT image_id, unnest", "r0 AS (SELECT image_id, unnest")},
    w AS (SELECT image_id // 3 AS image_id, k, max(CASE WHEN image_id % 3 = 0 THEN res END) AS a, max(CASE WHEN image_id % 3 = 1 THEN res END) AS b, max(CASE WHEN image_id % 3 = 2 THEN res END) AS c FROM r0 GROUP BY 1, 2),
    r AS (SELECT image_id * 3 AS image_id, k, a AS res FROM w UNION ALL SELECT image_id * 3 + 1, k, ((b + ((a + c) >> 2) + 128) & 255) - 128 FROM w UNION ALL SELECT image_id * 3 + 2, k, c FROM w) {CHANNELS}""")  # fmt: skip


# --- estimators over the same residuals

#: In the SQL of a size: bits a sample of r (image_id, k, res), whose planes are 3 * image + channel.
def _sized_sql(name: str, table: str = "r") -> str:
    state = running_sql(f"zs_{name}").replace("st AS (", f"run_{name} AS (", 1).replace("FROM st WHERE k < 64", f"FROM run_{name} WHERE k < 64")
    return f"""zs_{name} AS (SELECT image_id, list(CAST(CASE WHEN res < 0 THEN -2 * res - 1 ELSE 2 * res END AS BIGINT) ORDER BY k) AS zs FROM {table} GROUP BY image_id), {state},
        c_{name} AS (SELECT image_id, least(17, CAST(floor(log2(state * state + 1)) AS INT)) AS ctx, zs[k + 1] AS sym, count(*) AS f FROM run_{name} WHERE k < 64 GROUP BY ALL),
        size_{name} AS (SELECT image_id // 3 AS image_id, round(sum(-f * log2(f / n)) / 192, 6) AS size FROM (SELECT *, sum(f) OVER (PARTITION BY image_id, ctx) AS n FROM c_{name}) GROUP BY 1)"""


def _renamed(sql: str, name: str) -> str:
    """The recursive tables of a model under names of their own."""
    for old in ("cs", "st", "r"):
        sql = sql.replace(f"{old} AS (", f"{old}_{name} AS (").replace(f"FROM {old} ", f"FROM {old}_{name} ").replace(f"FROM {old}\n", f"FROM {old}_{name}\n")
    return sql


_OFFSET = "SELECT n.*, t, o FROM n JOIN sig USING (image_id, y, x)"
_WP_W = " + ".join(f"w{k} * c.x[{k}]" for k in range(1, 5)), " + ".join(f"w{k}" for k in range(1, 5))
_WP = _renamed(f"""cs AS (SELECT image_id, list({{'v': v, 't': t, 'o': o, 'x': [CAST(e AS DOUBLE) FOR e IN [W + NE - N, N, W, N + W - NW]]}} ORDER BY k) AS cs FROM ({_OFFSET}) GROUP BY image_id),
        st AS (SELECT image_id, 0 AS i, cs, CAST(0 AS BIGINT) AS res, CAST([1, 1, 1, 1] AS DOUBLE[]) AS e FROM cs
            UNION ALL SELECT image_id, i + 1, cs, CAST({wrapped(f"least(127, greatest(-128, CAST(round_even(least(127, greatest(-128, ({_WP_W[0]}) / ({_WP_W[1]}))), 0) AS BIGINT) + c.o))", 'c.t')} AS BIGINT), [{', '.join(f'e[{k}] * 0.75::DOUBLE + abs(c.x[{k}] - c.v)' for k in range(1, 5))}]
            FROM (SELECT *, {', '.join(f'1 / (e[{k}] + 1) AS w{k}' for k in range(1, 5))} FROM (SELECT *, cs[i + 1] AS c FROM st WHERE i < 64))),
        r AS (SELECT image_id, i - 1 AS k, res FROM st WHERE i > 0)""", "wp")
_L1 = _renamed(_signs_sql(_l1_parts, _OFFSET, _first, _shift, _step, 1 << _shift >> 1), "l1")
_OLS_P = "CAST(round_even(least(127, greatest(-128, w0 * N + w1 * W + w2 * NW + w3 * NE)), 0) AS BIGINT)"
_OLS = f"{_least_squares()}, r_ols AS (SELECT m.image_id, m.k, {wrapped(f'least(127, greatest(-128, {_OLS_P} + o))', 't')} AS res FROM m JOIN sig ON sig.image_id = m.image_id AND sig.y * 8 + sig.x = m.k)"
_ALL_NEAR = near_sql(tuple(dict.fromkeys([*_l1, "N", "W", "NE", "NEEE", "NW"])), "sig")
for _name, _models in (("c21_ols_or_wp", {"ols": _OLS, "wp": _WP}), ("c22_wp_or_l1", {"wp": _WP, "t29_l1crct": _L1})):
    _short = {"ols": "ols", "wp": "wp", "t29_l1crct": "l1"}
    _x, _y = _models
    register(_name, lambda s, d, names=tuple(_models): analysis.model_sizes(v.rgb_bytes(s, d), names), f"""WITH RECURSIVE {_chosen_sql()}, n AS ({_ALL_NEAR}), {', '.join(_models.values())}, {', '.join(_sized_sql(_short[k], f'r_{_short[k]}') for k in _models)}
        SELECT image_id, a.size AS {_x}, b.size AS {_y}, CASE WHEN a.size <= b.size THEN '{_x}' ELSE '{_y}' END AS best FROM size_{_short[_x]} a JOIN size_{_short[_y]} b USING (image_id)""")

_LEVELS = 1 << analysis.GRID_BITS
register("c23_blend_choices", lambda s, d: analysis.blend_choices(v.plane_bytes(s, d)), f"""WITH {v.PLANES}, n AS ({near_sql(('N', 'W', 'NW', 'NE'))}), inside AS (SELECT image_id, k, v, N, W, NE, (N + W) >> 1 AS e1, N + W - NW AS e2, W + NE - N AS e3 FROM n WHERE y >= 2 AND x BETWEEN 1 AND 6),
    tried AS (SELECT image_id, k, a, b, abs(v - greatest(least(N, W, NE), least(greatest(N, W, NE), (a * e1 + b * e2 + ({_LEVELS >> 2} - a - b) * e3) >> {analysis.GRID_BITS - 2}))) AS e FROM inside, (SELECT unnest(range(1, {_LEVELS + 1}))::INT AS a), (SELECT unnest(range(1, {_LEVELS + 1}))::INT AS b)),
    best AS (SELECT image_id, k, min(e * {_LEVELS * _LEVELS} + (b - 1) * {_LEVELS} + a - 1) % {_LEVELS * _LEVELS} AS place FROM tried GROUP BY image_id, k)
    SELECT CAST(place % {_LEVELS} + 1 AS INT) AS a, CAST(place // {_LEVELS} + 1 AS INT) AS b, count(*) AS n FROM best GROUP BY 1, 2""")  # fmt: skip
