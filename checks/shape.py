"""Queries on sequence shaping and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as tb
from odorframe.operators import shape

Q = {}
SQL = {}


def _shaped(spark, sf, how, gaps=True):
    return shape.shape_points(tb.points(spark, sf, gaps=gaps), tb.SENSORS, tb.DAY_US, how)


def _seqs(spark, sf, gaps=True, n=100):
    return shape.to_sequences(tb.points(spark, sf, gaps=gaps), tb.SENSORS, tb.DAY_US, n)


_SHAPED = f"""WITH {tb.points_sql(gaps=True)},
num AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY id) AS length,
    first_value(label) OVER w AS first_label,
    last_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fv,
    first_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY time, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bv
  FROM pts WINDOW w AS (PARTITION BY id ORDER BY time, seq))"""


def sorted_points(spark, sf):
    return _shaped(spark, sf, "none").select("measurement_id", "label", "seq", "pos", "length", "value", "k")


Q["sorted_points"] = sorted_points
SQL["sorted_points"] = f"""{_SHAPED} SELECT id AS measurement_id, first_label AS label, seq, pos, length, value, k FROM num"""

for _name, _how, _expr in (
    ("impute_ffill", "ffill", "fv"),
    ("impute_bfill", "bfill", "bv"),
    ("impute_ffill_bfill", "ffill_bfill", "coalesce(fv, bv)"),
    ("impute_ffill_bfill_zero", "ffill_bfill_zero", "coalesce(fv, bv, 0)"),
):
    Q[_name] = lambda spark, sf, how=_how: _shaped(spark, sf, how).select("measurement_id", "seq", "pos", "value", "k")
    SQL[_name] = f"{_SHAPED} SELECT id AS measurement_id, seq, pos, {_expr} AS value, k FROM num"


def _resampled_sql(n: int, gaps: bool = True) -> str:
    """rs(id, label, c, k, v): linear resampling by definition, one row pair per grid step."""
    base = _SHAPED if gaps else _SHAPED.replace(tb.points_sql(gaps=True), tb.points_sql(gaps=False))
    return f"""{base},
imp AS (SELECT id, first_label AS label, pos, length, [coalesce(fv, bv, 0), k] AS v FROM num),
ch AS (SELECT id, label, pos, length, unnest([0, 1]) AS c, unnest(v) AS v FROM imp),
grid AS (SELECT DISTINCT id, label, length, unnest(range({n})) AS k FROM imp),
gp AS (SELECT id, label, k, length, (k * (length - 1)) // {n - 1} AS lo,
         ((k * (length - 1)) % {n - 1}) / {n - 1}.0::DOUBLE AS w FROM grid),
rs AS (SELECT a.id, a.label, l.c, a.k, l.v + a.w * (h.v - l.v) AS v
  FROM gp a JOIN ch l ON l.id = a.id AND l.pos = a.lo
  JOIN ch h ON h.id = a.id AND h.pos = least(a.lo + 1, a.length - 1) AND h.c = l.c)"""


def resampled_sequences(spark, sf):
    return shape.as_long(_seqs(spark, sf)).select(
        "measurement_id", "label", "channel", F.col("t").alias("step"), tb.r6("value")
    )


Q["resampled_sequences"] = resampled_sequences
SQL["resampled_sequences"] = f"""{_resampled_sql(100)}
SELECT id AS measurement_id, label, CAST(c AS INTEGER) AS channel, CAST(k AS INTEGER) AS step, round(v, 6) + 0 AS value FROM rs"""


def resampled_short(spark, sf):
    return shape.as_long(_seqs(spark, sf, n=8)).select(
        "measurement_id", "label", "channel", F.col("t").alias("step"), tb.r6("value")
    )


Q["resampled_short"] = resampled_short
SQL["resampled_short"] = SQL["resampled_sequences"].replace(_resampled_sql(100), _resampled_sql(8))


def mean_curve(spark, sf):
    return (
        shape.as_long(_seqs(spark, sf))
        .groupBy("label", "channel", F.col("t").alias("step"))
        .agg(F.count("*").alias("n_sequences"), tb.r6(F.avg("value"), "mean_value"))
    )


Q["mean_curve"] = mean_curve
SQL["mean_curve"] = f"""{_resampled_sql(100)}
SELECT label, CAST(c AS INTEGER) AS channel, CAST(k AS INTEGER) AS step, count(*) AS n_sequences,
  round(avg(v), 6) + 0 AS mean_value FROM rs GROUP BY 1, 2, 3"""


def sequence_points(spark, sf):
    return shape.as_points(_seqs(spark, sf)).select(
        "measurement_id", "label", "t", tb.r6(F.col("v")[0], "value"), tb.r6(F.col("v")[1], "k")
    )


Q["sequence_points"] = sequence_points
SQL["sequence_points"] = f"""{_resampled_sql(100)}
SELECT a.id AS measurement_id, a.label, CAST(a.k AS INTEGER) AS t, round(a.v, 6) + 0 AS value, round(b.v, 6) + 0 AS k
FROM rs a JOIN rs b ON a.id = b.id AND a.k = b.k WHERE a.c = 0 AND b.c = 1"""


def flat_vectors(spark, sf):
    return shape.flatten_sequences(tb.sequences(spark, sf)).select(
        "measurement_id", F.posexplode("flat").alias("i", "value")
    )


Q["flat_vectors"] = flat_vectors
SQL["flat_vectors"] = f"""WITH {tb.cells_sql()} SELECT id AS measurement_id, CAST(t * 8 + c AS INTEGER) AS i, v AS value FROM cell"""


def flat_round_trip(spark, sf):
    flat = shape.flatten_sequences(tb.sequences(spark, sf)).drop("x")
    return shape.as_long(shape.unflatten_sequences(flat, 8))


Q["flat_round_trip"] = flat_round_trip
SQL["flat_round_trip"] = f"""WITH {tb.cells_sql()} SELECT id AS measurement_id, label, c AS channel, t, v AS value FROM cell"""


def fidelity_series(spark, sf):
    shaped = _shaped(spark, sf, "ffill_bfill_zero")
    seqs = shape.resample(shaped, tb.SENSORS)
    return shape.fidelity_series(shaped, seqs, tb.SENSORS).select(
        "measurement_id", "kind", "channel", tb.r6("u"), tb.r6("value")
    )


Q["fidelity_series"] = fidelity_series
SQL["fidelity_series"] = f"""{_resampled_sql(100)}
SELECT id AS measurement_id, 'original' AS kind, CAST(c AS INTEGER) AS channel,
  round(CASE WHEN length > 1 THEN pos / (length - 1)::DOUBLE ELSE 0 END, 6) + 0 AS u, round(v, 6) + 0 AS value FROM ch
UNION ALL
SELECT id, 'resampled', CAST(c AS INTEGER), round(k / 99.0::DOUBLE, 6) + 0, round(v, 6) + 0 FROM rs"""


def fidelity_rmse(spark, sf):
    shaped = _shaped(spark, sf, "ffill_bfill_zero")
    seqs = shape.resample(shaped, tb.SENSORS, 8)
    return shape.fidelity_rmse(shaped, seqs, tb.SENSORS, 8).select(
        "measurement_id", "channel", "n_rows", tb.r6("rmse")
    )


Q["fidelity_rmse"] = fidelity_rmse
SQL["fidelity_rmse"] = f"""{_resampled_sql(8)},
q AS (SELECT *, pos * 7 / (length - 1)::DOUBLE AS p FROM ch),
e AS (SELECT q.id, q.c, q.v - (a.v + (q.p - floor(q.p)) * (b.v - a.v)) AS d
  FROM q JOIN rs a ON a.id = q.id AND a.c = q.c AND a.k = floor(q.p)
  JOIN rs b ON b.id = q.id AND b.c = q.c AND b.k = least(floor(q.p) + 1, 7))
SELECT id AS measurement_id, CAST(c AS INTEGER) AS channel, count(*) AS n_rows, round(sqrt(avg(d * d)), 6) + 0 AS rmse FROM e GROUP BY 1, 2"""
