"""Queries on generated sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import tables as tb
from checks.splits import _SEQ_HEAD, seeds_sql
from odorframe.functions.arrays import spline_basis
from odorframe.operators import augment, shape, split
from odorframe.operators.mixture import LATENT_MIN_ROWS
from odorframe.plans.grid import METHOD_MIN_SEEDS

Q = {}
SQL = {}
T8 = 64  # one channel of 64 steps


def long(df, extra=()):
    keep = ["measurement_id", "copy", *extra]
    return shape.as_long(df, keep).withColumn("value", tb.r6("value"))


def one(spark, sf):
    return tb.sequences(spark, sf, channels=1)


_CELL = f"WITH {tb.cells_sql()}"
_CELL1 = f"WITH {tb.cells_sql(1)}"
_OUT = "CAST(copy AS INTEGER) AS copy, CAST(c AS INTEGER) AS channel, CAST(t AS INTEGER) AS t"


def _copies_sql(s: int) -> str:
    return f"cp AS (SELECT *, unnest(range({s})) AS copy FROM cell)"


def copied(spark, sf):
    out = augment.copies(tb.sequences(spark, sf), 3, "none")
    return out.groupBy("label", "copy", "scale_factor").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


Q["scale_factor_copies"] = copied
SQL["scale_factor_copies"] = f"""{_CELL} SELECT label, CAST(copy AS INTEGER) AS copy, 3 AS scale_factor, count(*) AS n, count(*) AS sources
FROM (SELECT *, unnest(range(3)) AS copy FROM seq) GROUP BY 1, 2"""

Q["jitter"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "Jittering", 3))
SQL["jitter"] = f"""{_CELL}, {_copies_sql(3)},
h AS (SELECT *, {tb.md5_sql('jitter', 'id', 'copy', 'c', 't // 4')} AS h, t % 4 AS lane FROM cp)
SELECT id AS measurement_id, {_OUT}, round(CASE WHEN copy = 0 THEN v ELSE v + 0.03::DOUBLE * {tb.normal_sql('h', 'lane')} END, 6) + 0 AS value FROM h"""

Q["scaling"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "Scaling", 3))
SQL["scaling"] = f"""{_CELL}, {_copies_sql(3)},
h AS (SELECT *, {tb.md5_sql('scaling', 'id', 'copy', 'c')} AS h FROM cp)
SELECT id AS measurement_id, {_OUT}, round(CASE WHEN copy = 0 THEN v ELSE v * (1 + 0.1::DOUBLE * {tb.normal_sql('h', '0')}) END, 6) + 0 AS value FROM h"""


def _basis_sql(steps: int, rows: np.ndarray) -> str:
    """basis(t, j, b) from the spline matrix, one list per step."""
    lists = ", ".join("[" + ", ".join(repr(float(v)) + "::DOUBLE" for v in r) + "]" for r in rows)
    return f"""basis AS (SELECT t, CAST(j AS INTEGER) AS j, b[t + 1][j + 1] AS b
  FROM (SELECT b, CAST(unnest(range({steps})) AS INTEGER) AS t FROM (SELECT [{lists}] AS b)), (SELECT unnest(range(6)) AS j))"""


def _knots_sql(purpose: str) -> str:
    return f"""kn AS (SELECT id, copy, c, j, 1 + 0.2::DOUBLE * {tb.normal_sql('h', '(j % 4)')} AS w FROM (
  SELECT *, {tb.md5_sql(purpose, 'id', 'copy', 'c', 'j // 4')} AS h
  FROM (SELECT DISTINCT id, copy, c FROM cp WHERE copy > 0), (SELECT unnest(range(6)) AS j)))"""


Q["magnitude_warping"] = lambda s, sf: long(augment.generate(one(s, sf), "Magnitude_Warping", 2))
SQL["magnitude_warping"] = f"""{_CELL1}, {_copies_sql(2)}, {_basis_sql(T8, spline_basis(T8, 6))}, {_knots_sql('magnitude')},
cv AS (SELECT id, copy, c, t, sum(b * w) AS f FROM kn JOIN basis USING (j) GROUP BY 1, 2, 3, 4)
SELECT id AS measurement_id, {_OUT}, round(v * coalesce(f, 1), 6) + 0 AS value FROM cp LEFT JOIN cv USING (id, copy, c, t)"""

Q["time_warping"] = lambda s, sf: long(augment.generate(one(s, sf), "Time_Warping", 2))
SQL["time_warping"] = f"""{_CELL1}, {_copies_sql(2)}, {_basis_sql(T8, spline_basis(T8, 6))}, {_knots_sql('time')},
tw AS (SELECT id, copy, c, t, sum(b * w * j * {(T8 - 1) / 5}::DOUBLE) AS p FROM kn JOIN basis USING (j) GROUP BY 1, 2, 3, 4),
wp AS (SELECT a.id, a.copy, a.c, a.t AS s,
  max(greatest(0, least({T8 - 1}, a.p * ({T8 - 1} / z.p)))) OVER (PARTITION BY a.id, a.copy, a.c ORDER BY a.t) AS p
  FROM tw a JOIN tw z ON a.id = z.id AND a.copy = z.copy AND a.c = z.c AND z.t = {T8 - 1}),
br AS (SELECT g.id, g.copy, g.c, g.t, max(w.s) FILTER (w.p <= g.t) AS lo
  FROM cp g JOIN wp w USING (id, copy, c) GROUP BY 1, 2, 3, 4),
iv AS (SELECT br.*, pl.p AS p0, ph.p AS p1, vl.v AS v0, vh.v AS v1 FROM br
  JOIN wp pl ON pl.id = br.id AND pl.copy = br.copy AND pl.c = br.c AND pl.s = lo
  LEFT JOIN wp ph ON ph.id = br.id AND ph.copy = br.copy AND ph.c = br.c AND ph.s = lo + 1
  JOIN cell vl ON vl.id = br.id AND vl.c = br.c AND vl.t = lo
  LEFT JOIN cell vh ON vh.id = br.id AND vh.c = br.c AND vh.t = lo + 1)
SELECT cp.id AS measurement_id, CAST(cp.copy AS INTEGER) AS copy, cp.c AS channel, cp.t,
  round(CASE WHEN cp.copy = 0 THEN v WHEN p1 IS NULL THEN v0 ELSE v0 + (cp.t - p0) / (p1 - p0) * (v1 - v0) END, 6) + 0 AS value
FROM cp LEFT JOIN iv USING (id, copy, c, t)"""

Q["permutation"] = lambda s, sf: long(augment.generate(one(s, sf), "Permutation", 2))
_SPARE = T8 - 4 * 10 - 1
_dr = lambda i: f"CAST(floor({tb.uniform_sql(tb.md5_sql('cut', 'id', 'copy', str(i)))} * {_SPARE + 3 - i}) AS INTEGER)"
SQL["permutation"] = f"""{_CELL1},
d AS (SELECT id, copy, {_dr(0)} AS a, {_dr(1)} AS b0, {_dr(2)} AS c0 FROM (SELECT id, unnest([1]) AS copy FROM seq)),
d2 AS (SELECT *, b0 + CASE WHEN a <= b0 THEN 1 ELSE 0 END AS b FROM d),
d3 AS (SELECT *, c0 + CASE WHEN least(a, b) <= c0 THEN 1 ELSE 0 END AS c1 FROM d2),
d4 AS (SELECT *, list_sort([a, b, c1 + CASE WHEN greatest(a, b) <= c1 THEN 1 ELSE 0 END]) AS s FROM d3),
cut AS (SELECT id, copy, [0, s[1] + 10, s[2] - 1 + 20, s[3] - 2 + 30, {T8}] AS cuts FROM d4),
seg AS (SELECT id, copy, g, cuts[g + 1] AS lo, cuts[g + 2] AS hi,
  row_number() OVER (PARTITION BY id, copy ORDER BY {tb.md5_sql('segment', 'id', 'copy', 'g')}) AS o
  FROM cut, (SELECT unnest(range(4)) AS g)),
pos AS (SELECT *, coalesce(sum(hi - lo) OVER (PARTITION BY id, copy ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM seg)
SELECT id AS measurement_id, 0 AS copy, c AS channel, t, round(v, 6) + 0 AS value FROM cell
UNION ALL SELECT p.id, 1, c, CAST(base + t - lo AS INTEGER), round(v, 6) + 0 FROM pos p JOIN cell ON cell.id = p.id AND t >= lo AND t < hi"""

Q["window_slicing"] = lambda s, sf: long(augment.generate(one(s, sf), "Window_Slicing", 3))
_L = 58  # ceil(0.9 * 64)
SQL["window_slicing"] = f"""{_CELL1}, {_copies_sql(3)},
st AS (SELECT id, copy, CAST(floor({tb.uniform_sql(tb.md5_sql('window', 'id', 'copy'))} * {T8 - _L}) AS INTEGER) AS s
  FROM (SELECT DISTINCT id, copy FROM cp WHERE copy > 0)),
ps AS (SELECT cp.*, s, t * {_L} / {T8 - 1}.0::DOUBLE AS p FROM cp LEFT JOIN st USING (id, copy)),
lo AS (SELECT *, CAST(least(floor(p), {_L - 1}) AS INTEGER) AS l FROM ps)
SELECT lo.id AS measurement_id, CAST(lo.copy AS INTEGER) AS copy, lo.c AS channel, lo.t,
  round(CASE WHEN lo.copy = 0 THEN lo.v WHEN l >= {_L - 1} THEN a.v ELSE a.v + (p - l) * (b.v - a.v) END, 6) + 0 AS value
FROM lo LEFT JOIN cell a ON a.id = lo.id AND a.c = lo.c AND a.t = s + l
LEFT JOIN cell b ON b.id = lo.id AND b.c = lo.c AND b.t = s + least(l + 1, {_L - 1})"""

Q["mixup"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "Mixup", 3))
_bt = ", ".join(
    f"[pow({tb.open_uniform_sql(h, 0)}, 5), pow({tb.open_uniform_sql(h, 1)}, 5)]"
    for h in (tb.md5_sql("lambda", "id", "copy", str(i)) for i in range(8))
)
SQL["mixup"] = f"""{_CELL},
rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {tb.md5_sql('rank', 'id')}) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM seq),
b AS (SELECT id, copy, label, 1 + CAST(floor({tb.uniform_sql(tb.md5_sql('partner', 'id', 'copy'))} * n) AS BIGINT) AS pr,
  list_filter([{_bt}], lambda p: p[1] + p[2] <= 1)[1] AS pq FROM (SELECT *, unnest([1, 2]) AS copy FROM rk)),
p AS (SELECT b.id, b.copy, k.id AS partner, coalesce(pq[1] / (pq[1] + pq[2]), 0.5) AS lam
  FROM b JOIN rk k ON k.label = b.label AND k.r = b.pr)
SELECT id AS measurement_id, 0 AS copy, c AS channel, t, round(v, 6) + 0 AS value FROM cell
UNION ALL SELECT p.id, p.copy, x.c, x.t, round(y.v + lam * (x.v - y.v), 6) + 0
FROM p JOIN cell x ON x.id = p.id JOIN cell y ON y.id = p.partner AND y.c = x.c AND y.t = x.t"""


def outcomes(spark, sf):
    seqs = tb.sequences(spark, sf)
    sets = split.seed_sets(split.assign_folds(split.measurements(seqs)), selections=2)
    return augment.eligibility(sets, ["run_fold", "selection"], "n_seeds", METHOD_MIN_SEEDS)


Q["method_outcomes"] = outcomes
SQL["method_outcomes"] = f"""{_SEQ_HEAD}, {seeds_sql(selections=2)},
sz AS (SELECT run_fold, selection, n_seeds, label, count(*) AS n FROM seeds GROUP BY ALL),
g AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {k})" for m, k in METHOD_MIN_SEEDS.items())}) v(method, k))
SELECT run_fold, selection, n_seeds, label, n, min(n) OVER (PARTITION BY run_fold, selection, n_seeds) AS smallest_class, method,
  CASE WHEN n_seeds < k THEN 'seed size below gate'
       WHEN method IN ('SMOTE', 'ADASYN') AND min(n) OVER (PARTITION BY run_fold, selection, n_seeds) <= 1 THEN 'a class has one member'
       ELSE 'ok' END AS outcome FROM sz, g"""


# Fitted generators are iterative: who is grown, by how much, and values near the source's.
def _fitted(method, channels=8):
    def query(spark, sf):
        out = augment.generate(tb.sequences(spark, sf, channels), method, 2)
        cells = long(out, ["label"]).groupBy("label", "copy", "channel").agg(
            F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max(F.isnan("value")).alias("bad")
        )
        source = cells.filter("copy = 0").select("label", "channel", F.col("m").alias("m0"), F.col("s").alias("s0"))
        near = ~F.col("bad") & (F.abs(F.col("m") - F.col("m0")) <= F.col("s0")) & F.col("s").between(F.col("s0") / 3, F.col("s0") * 3)
        return cells.join(source, ["label", "channel"]).select("label", "copy", "channel", "n", near.alias("near"))

    return query


def _fitted_sql(least=1):
    return f"""{_CELL} SELECT label, CAST(copy AS INTEGER) AS copy, c AS channel, count(*) AS n, true AS near
FROM cell, (SELECT unnest([0, 1]) AS copy) GROUP BY ALL HAVING copy = 0 OR count(DISTINCT id) >= {least}"""


Q["gaussian_mixture"] = _fitted("GMM")
Q["hidden_markov"] = _fitted("HMM_GMM")
Q["latent_gaussian"] = _fitted("TimeVAE")
SQL["gaussian_mixture"] = SQL["hidden_markov"] = _fitted_sql()
SQL["latent_gaussian"] = _fitted_sql(LATENT_MIN_ROWS)

# Cross-channel behaviour at the data's own length, and other mixing weights.
Q["magnitude_warping_channels"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "Magnitude_Warping", 2))
SQL["magnitude_warping_channels"] = f"""{_CELL}, {_copies_sql(2)}, {_basis_sql(8, spline_basis(8, 6))}, {_knots_sql('magnitude')},
cv AS (SELECT id, copy, c, t, sum(b * w) AS f FROM kn JOIN basis USING (j) GROUP BY 1, 2, 3, 4)
SELECT id AS measurement_id, {_OUT}, round(v * coalesce(f, 1), 6) + 0 AS value FROM cp LEFT JOIN cv USING (id, copy, c, t)"""

Q["window_slicing_channels"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "Window_Slicing", 2, ratio=0.6))
SQL["window_slicing_channels"] = (
    SQL["window_slicing"].replace(_CELL1, _CELL).replace(_copies_sql(3), _copies_sql(2)).replace(f"* {T8 - _L})", "* 3)")
    .replace(f"t * {_L} / {T8 - 1}.0", "t * 5 / 7.0").replace(f"{_L - 1}", "4")
)

_MIX = f"""{_CELL},
rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {tb.md5_sql('rank', 'id')}) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM seq),
b AS (SELECT *, 1 + CAST(floor({tb.uniform_sql(tb.md5_sql('partner', 'id', 'copy'))} * n) AS BIGINT) AS pr FROM (SELECT *, unnest([1]) AS copy FROM rk)),
{{lam}},
p AS (SELECT l.id, l.copy, k.id AS partner, lam FROM l JOIN rk k ON k.label = l.label AND k.r = l.pr)
SELECT id AS measurement_id, 0 AS copy, c AS channel, t, round(v, 6) + 0 AS value FROM cell
UNION ALL SELECT p.id, p.copy, x.c, x.t, round(y.v + lam * (x.v - y.v), 6) + 0
FROM p JOIN cell x ON x.id = p.id JOIN cell y ON y.id = p.partner AND y.c = x.c AND y.t = x.t"""

Q["mixup_even"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "Mixup", 2, alpha=1.0))
_pair = f"[{tb.open_uniform_sql('h', 0)}, {tb.open_uniform_sql('h', 1)}]"
SQL["mixup_even"] = _MIX.format(
    lam=f"""tr AS (SELECT id, copy, i, {_pair} AS pq FROM (SELECT id, copy, i, {tb.md5_sql('lambda', 'id', 'copy', 'i')} AS h FROM b, (SELECT unnest(range(64)) AS i))),
l AS (SELECT b.*, pq[1] / (pq[1] + pq[2]) AS lam FROM b JOIN (SELECT id, copy, arg_min(pq, i) AS pq FROM tr WHERE pq[1] + pq[2] <= 1 GROUP BY 1, 2) USING (id, copy))"""
)

Q["mixup_centred"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "Mixup", 2, alpha=2.0))
_D, _C = f"({2.0 - 1.0 / 3.0!r}::DOUBLE)", f"({1.0 / (9.0 * (2.0 - 1.0 / 3.0)) ** 0.5!r}::DOUBLE)"


def _gamma_sql(side):
    return f"""t{side} AS (SELECT id, copy, i, x, u, pow(1 + {_C} * x, 3) AS v FROM (SELECT id, copy, i, {tb.normal_sql('h', '0')} AS x, {tb.open_uniform_sql('h', 2)} AS u
  FROM (SELECT id, copy, i, {tb.md5_sql(f'lambda|{side}', 'id', 'copy', 'i')} AS h FROM b, (SELECT unnest(range(16)) AS i)))),
g{side} AS (SELECT id, copy, arg_min(v, i) AS v{side} FROM t{side}
  WHERE CASE WHEN v > 0 THEN ln(u) < 0.5::DOUBLE * x * x + {_D} - {_D} * v + {_D} * ln(v) ELSE false END GROUP BY 1, 2)"""


SQL["mixup_centred"] = _MIX.format(lam=f"{_gamma_sql('a')}, {_gamma_sql('b')}, l AS (SELECT b.*, va / (va + vb) AS lam FROM b JOIN ga USING (id, copy) JOIN gb USING (id, copy))")
