"""Queries on folds, seed sets, caps and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as tb
from odorframe.functions.draws import key_hash
from odorframe.operators import scale, shape, split

Q = {}
SQL = {}


def folds(spark, sf):
    return split.assign_folds(tb.groups(spark, sf))


_FOLD = f"""fld AS (SELECT id, label, CAST((row_number() OVER (ORDER BY label, {tb.md5_sql('fold', 'id')}, id) - 1) % 10 + 1 AS INTEGER) AS fold
  FROM grp)"""
_HEAD = f"WITH {tb.GROUPS_SQL}, {_FOLD}"
_SEQ_HEAD = f"WITH {tb.cells_sql()}, {_FOLD.replace('FROM grp', 'FROM seq')}"

Q["stratified_folds"] = folds
SQL["stratified_folds"] = f"{_HEAD} SELECT id AS measurement_id, label, fold FROM fld"


def fold_balance(spark, sf):
    return folds(spark, sf).groupBy("label", "fold").agg(F.count("*").alias("n"))


Q["fold_balance"] = fold_balance
SQL["fold_balance"] = f"{_HEAD} SELECT label, fold, count(*) AS n FROM fld GROUP BY 1, 2"

Q["train_test_parts"] = lambda s, sf: split.train_test(folds(s, sf)).select("measurement_id", "run_fold", "part")
SQL["train_test_parts"] = f"""{_HEAD} SELECT id AS measurement_id, CAST(r AS INTEGER) AS run_fold,
  CASE WHEN fold = r THEN 'test' ELSE 'train' END AS part FROM fld, (SELECT unnest(range(1, 11)) AS r)"""


def seeds_sql(sizes="[1, 2, 5, 10, 20]", selections=10, source="fld") -> str:
    return f"""seeds AS (
  SELECT CAST(r AS INTEGER) AS run_fold, CAST(s AS INTEGER) AS selection, n AS n_seeds, label, id, n_available
  FROM (SELECT *, row_number() OVER (PARTITION BY r, s, label ORDER BY {tb.md5_sql('seeds', 's', 'label', 'id')}, id) AS rn,
          count(*) OVER (PARTITION BY r, s, label) AS n_available
        FROM {source}, (SELECT unnest(range(1, 11)) AS r), (SELECT unnest(range(1, {selections + 1})) AS s)
        WHERE fold <> r) q,
    (SELECT unnest({sizes}) AS n) WHERE rn <= n)"""


Q["seed_sets"] = lambda s, sf: split.seed_sets(folds(s, sf))
SQL["seed_sets"] = f"""{_HEAD}, {seeds_sql()}
SELECT run_fold, selection, n_seeds, label, id AS measurement_id, n_available FROM seeds"""


def seed_sets_large(spark, sf):
    """More seeds than some labels have: all available ones are taken."""
    f = split.assign_folds(split.measurements(tb.sequences(spark, sf)))
    sets = split.seed_sets(f, sizes=(40, 60), selections=2)
    return sets.groupBy("run_fold", "selection", "n_seeds", "label", "n_available").agg(F.count("*").alias("taken"))


Q["seed_sets_take_all"] = seed_sets_large
SQL["seed_sets_take_all"] = f"""{_SEQ_HEAD}, {seeds_sql('[40, 60]', 2)}
SELECT run_fold, selection, n_seeds, label, n_available, count(*) AS taken FROM seeds GROUP BY ALL"""


def row_cap(spark, sf):
    return split.cap_rows(tb.points(spark, sf).select("measurement_id", "seq", "value"), ["measurement_id", "seq"], cap=5000)


Q["row_cap"] = row_cap
SQL["row_cap"] = f"""WITH {tb.points_sql()}
SELECT id AS measurement_id, seq, value FROM pts ORDER BY {tb.md5_sql('cap', 'id', 'seq')} LIMIT 5000"""


def row_cap_by_run(spark, sf):
    pts = tb.points(spark, sf).select("label", "measurement_id", "seq", "value")
    return split.cap_rows(pts, ["measurement_id", "seq"], cap=1995, run=["label"])


Q["row_cap_by_run"] = row_cap_by_run
SQL["row_cap_by_run"] = f"""WITH {tb.points_sql()}
SELECT label, id AS measurement_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY {tb.md5_sql('cap', 'label', 'id', 'seq')}) AS rn FROM pts) WHERE rn <= 1995"""

Q["cv_folds"] = lambda s, sf: split.cv_folds(
    split.seed_sets(split.assign_folds(split.measurements(tb.sequences(s, sf))))
).select("run_fold", "selection", "n_seeds", "measurement_id", "cv_k", "cv_fold", "grouped")
SQL["cv_folds"] = f"""{_SEQ_HEAD}, {seeds_sql()},
cv AS (SELECT *, CAST(CASE WHEN n_seeds < 2 THEN 2 ELSE least(5, n_seeds) END AS INTEGER) AS cv_k,
  row_number() OVER (PARTITION BY run_fold, selection, n_seeds
    ORDER BY label, {tb.md5_sql('cv', 'run_fold', 'selection', 'n_seeds', 'id')}) AS rn FROM seeds)
SELECT run_fold, selection, n_seeds, id AS measurement_id, cv_k, CAST((rn - 1) % cv_k + 1 AS INTEGER) AS cv_fold,
  n_seeds >= 2 AS grouped FROM cv"""


def _train_runs(spark, sf):
    """Embedding sequences of every run fold with their part."""
    seqs = tb.sequences(spark, sf)
    parts = split.train_test(split.assign_folds(split.measurements(seqs)))
    return parts.join(seqs.drop("label"), "measurement_id")


def scaler_fit(spark, sf):
    runs = _train_runs(spark, sf)
    sc = scale.fit_scaler(runs.filter(F.col("part") == "train"), ["run_fold"])
    return sc.select("run_fold", F.posexplode(F.arrays_zip("mean", "std")).alias("channel", "z")).select(
        "run_fold", "channel", tb.r6("z.mean", "mean"), tb.r6("z.std", "std")
    )


_SCALER = f"""{_SEQ_HEAD},
tr AS (SELECT r, c, avg(v) AS m, stddev_pop(v) AS s FROM cell JOIN fld USING (id), (SELECT unnest(range(1, 11)) AS r)
  WHERE fold <> r GROUP BY 1, 2)"""
Q["scaler_fit"] = scaler_fit
SQL["scaler_fit"] = f"""{_SCALER} SELECT CAST(r AS INTEGER) AS run_fold, c AS channel, round(m, 6) + 0 AS mean, round(s, 6) + 0 AS std FROM tr"""


def scaled_test(spark, sf):
    runs = _train_runs(spark, sf)
    sc = scale.fit_scaler(runs.filter(F.col("part") == "train"), ["run_fold"])
    out = scale.apply_scaler(runs.filter(F.col("part") == "test"), sc, ["run_fold"])
    return shape.as_long(out, ["run_fold", "measurement_id"]).withColumn("value", tb.r6("value"))


Q["scaled_test_fold"] = scaled_test
SQL["scaled_test_fold"] = f"""{_SCALER} SELECT CAST(r AS INTEGER) AS run_fold, id AS measurement_id, cell.c AS channel, t,
  round((v - m) / s, 6) + 0 AS value FROM cell JOIN fld USING (id) JOIN tr ON tr.r = fold AND tr.c = cell.c"""


def draws(spark, sf):
    """Uniform, normal and index draws keyed by event."""
    h = key_hash(tb.SEED, "demo", "event_id")
    from odorframe.functions import draws as d

    return tb.table(spark, sf, "events").select(
        "event_id", tb.r6(d.uniform(h, 0), "u"), tb.r6(d.normal(h, 0), "n0"), tb.r6(d.normal(h, 3), "n3"),
        d.index(h, 7, 2).alias("i"),
    )


Q["keyed_draws"] = draws
_h = tb.md5_sql("demo", "event_id")
SQL["keyed_draws"] = f"""SELECT event_id, round({tb.uniform_sql('h')}, 6) + 0 AS u, round({tb.normal_sql('h', '0')}, 6) + 0 AS n0,
  round({tb.normal_sql('h', '3')}, 6) + 0 AS n3, CAST(floor({tb.uniform_sql('h', 2)} * 7) AS BIGINT) AS i
FROM (SELECT event_id, {_h} AS h FROM events)"""
