"""Queries on the results ledger and the experiment plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as tb
from odorframe.plans import grid, ledger

Q = {}
SQL = {}

GENERATED = [m for m in tb.METHODS if m not in ("Baseline", "Tuned_Baseline")]


def near(col, name=None):
    """Six places, nudged off exact halves so that summation order cannot flip a digit."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.round(c + F.lit(1e-9), 6) + F.lit(0.0)).alias(name or col)


def near_sql(expr):
    return f"(round({expr} + 1e-9::DOUBLE, 6) + 0)"


def averaged(spark, sf):
    return ledger.average_selections(tb.ledger(spark, sf))


_AVG = f"""WITH {tb.LEDGER_SQL},
av AS (SELECT "Dataset", "Fold", "SeedsPerLabel", "ScaleFactor", "Model", "Method",
    avg("Accuracy") AS "Accuracy", avg("F1_Score") AS "F1_Score",
    avg("ExecutionTime_Sec") AS "ExecutionTime_Sec", min("Hyperparameters") AS "Hyperparameters"
  FROM led GROUP BY 1, 2, 3, 4, 5, 6)"""
_BASE = f"""{_AVG},
bm AS (SELECT "Dataset", "Model", "SeedsPerLabel", "Method", avg("Accuracy") AS "Accuracy"
  FROM av WHERE "Method" IN ('Baseline', 'Tuned_Baseline') GROUP BY 1, 2, 3, 4),
bb AS (SELECT * FROM bm b WHERE "Method" = 'Tuned_Baseline' OR NOT EXISTS (
    SELECT 1 FROM bm t WHERE t."Dataset" = b."Dataset" AND t."Model" = b."Model"
      AND t."SeedsPerLabel" = b."SeedsPerLabel" AND t."Method" = 'Tuned_Baseline'))"""
_CHANGE = f"""{_AVG},
base AS (SELECT * FROM av WHERE "Method" IN ('Baseline', 'Tuned_Baseline')),
bf AS (SELECT * FROM base b WHERE "Method" = 'Tuned_Baseline' OR NOT EXISTS (
    SELECT 1 FROM base t WHERE t."Dataset" = b."Dataset" AND t."Model" = b."Model" AND t."Fold" = b."Fold"
      AND t."SeedsPerLabel" = b."SeedsPerLabel" AND t."Method" = 'Tuned_Baseline')),
chg AS (SELECT g.*, b."Accuracy" AS "Baseline_Accuracy", g."Accuracy" - b."Accuracy" AS "Accuracy_Change"
  FROM av g JOIN bf b USING ("Dataset", "Model", "SeedsPerLabel", "Fold")
  WHERE g."Method" NOT IN ('Baseline', 'Tuned_Baseline'))"""
_CURVE = f"""{_AVG},
anchor AS (SELECT * REPLACE (1 AS "ScaleFactor") FROM av WHERE "Method" =
  CASE WHEN (SELECT count(*) FROM av WHERE "Method" = 'Tuned_Baseline') > 0 THEN 'Tuned_Baseline' ELSE 'Baseline' END),
gen AS (SELECT * FROM av WHERE "Method" NOT IN ('Baseline', 'Tuned_Baseline')),
anc AS (SELECT a.* REPLACE (m."Method" AS "Method") FROM anchor a, (SELECT DISTINCT "Method" FROM gen) m),
cur AS (SELECT "Model", "Method", "SeedsPerLabel", "ScaleFactor", avg("Accuracy") AS "Accuracy"
  FROM (SELECT * FROM anc UNION ALL SELECT * FROM gen) GROUP BY 1, 2, 3, 4)"""


def ledger_union(spark, sf):
    """Current rows with an older ledger that has no selection column, as counts by presence."""
    cur = tb.ledger(spark, sf)
    old = cur.drop("SeedFoldSelection")
    both = ledger.union_ledgers(cur, old)
    return both.groupBy("Dataset", F.col("SeedFoldSelection").isNull().alias("old")).agg(
        F.count("*").alias("n"), F.min("Accuracy").alias("low"), F.max("Accuracy").alias("high")
    )


Q["ledger_union"] = ledger_union
SQL["ledger_union"] = f"""WITH {tb.LEDGER_SQL}
SELECT "Dataset", o AS old, count(*) AS n, min("Accuracy") AS low, max("Accuracy") AS high
FROM led, (SELECT unnest([true, false]) AS o) GROUP BY 1, 2"""

def ledger_average(spark, sf):
    return averaged(spark, sf).select(
        "Dataset", "Fold", "SeedsPerLabel", "ScaleFactor", "Model", "Method", "Hyperparameters",
        near("Accuracy"), near("F1_Score"), near("ExecutionTime_Sec"),
    )


Q["ledger_average"] = ledger_average
SQL["ledger_average"] = f"""{_AVG} SELECT "Dataset", "Fold", "SeedsPerLabel", "ScaleFactor", "Model", "Method", "Hyperparameters",
  {near_sql('"Accuracy"')} AS "Accuracy", {near_sql('"F1_Score"')} AS "F1_Score",
  {near_sql('"ExecutionTime_Sec"')} AS "ExecutionTime_Sec" FROM av"""


def ledger_dedup(spark, sf):
    return ledger.dedup(tb.ledger(spark, sf), F.col("ExecutionTime_Sec"))


Q["ledger_dedup"] = ledger_dedup
SQL["ledger_dedup"] = f"""WITH {tb.LEDGER_SQL}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY "Dataset", "Fold", "SeedsPerLabel", "SeedFoldSelection", "ScaleFactor", "Model", "Method"
  ORDER BY "ExecutionTime_Sec" DESC, "Accuracy" DESC, "F1_Score" DESC, "Hyperparameters" DESC) AS rn FROM led) WHERE rn = 1"""


def baseline_split(spark, sf):
    led = averaged(spark, sf)
    tag = lambda df, t: df.groupBy("Method").agg(F.count("*").alias("n")).withColumn("part", F.lit(t))
    return tag(ledger.baselines(led), "baseline").unionByName(tag(ledger.generated(led), "generated"))


Q["baseline_split"] = baseline_split
SQL["baseline_split"] = f"""{_AVG} SELECT "Method", count(*) AS n,
  CASE WHEN "Method" IN ('Baseline', 'Tuned_Baseline') THEN 'baseline' ELSE 'generated' END AS part FROM av GROUP BY 1"""

Q["baseline_means"] = lambda s, sf: ledger.baseline_means(averaged(s, sf)).withColumn("Accuracy", near("Accuracy"))
SQL["baseline_means"] = f"""{_BASE} SELECT * REPLACE ({near_sql('"Accuracy"')} AS "Accuracy") FROM bm"""

Q["best_baseline"] = lambda s, sf: ledger.best_baseline(averaged(s, sf)).withColumn("Accuracy", near("Accuracy"))
SQL["best_baseline"] = f"""{_BASE} SELECT * REPLACE ({near_sql('"Accuracy"')} AS "Accuracy") FROM bb"""

Q["best_baseline_by_fold"] = lambda s, sf: (
    ledger.prefer_tuned(ledger.baselines(averaged(s, sf)), [*ledger.GROUP, "Fold"])
    .select(*ledger.GROUP, "Fold", "Method", near("Accuracy"))
)
SQL["best_baseline_by_fold"] = f"""{_CHANGE} SELECT "Dataset", "Model", "SeedsPerLabel", "Fold", "Method",
  {near_sql('"Accuracy"')} AS "Accuracy" FROM bf"""

Q["overall_baseline"] = lambda s, sf: ledger.overall_baseline(averaged(s, sf)).withColumn("Accuracy", near("Accuracy"))
SQL["overall_baseline"] = f"""{_BASE} SELECT "Model", "SeedsPerLabel", {near_sql('avg("Accuracy")')} AS "Accuracy"
FROM bb GROUP BY 1, 2"""

Q["dataset_tables"] = lambda s, sf: ledger.dataset_tables(averaged(s, sf)).withColumn("Accuracy", near("Accuracy"))
SQL["dataset_tables"] = SQL["best_baseline"]

Q["accuracy_change"] = lambda s, sf: ledger.accuracy_change(averaged(s, sf)).select(
    *ledger.GROUP, "Fold", "Method", "ScaleFactor", near("Accuracy"), near("Baseline_Accuracy"), near("Accuracy_Change")
)
SQL["accuracy_change"] = f"""{_CHANGE} SELECT "Dataset", "Model", "SeedsPerLabel", "Fold", "Method", "ScaleFactor",
  {near_sql('"Accuracy"')} AS "Accuracy", {near_sql('"Baseline_Accuracy"')} AS "Baseline_Accuracy",
  {near_sql('"Accuracy_Change"')} AS "Accuracy_Change" FROM chg"""


def change_table(spark, sf):
    out = ledger.change_table(averaged(spark, sf), GENERATED)
    return out.select("Model", *[near(m) for m in GENERATED])


Q["change_table"] = change_table
SQL["change_table"] = f"""{_CHANGE} SELECT "Model", {", ".join(
    near_sql(f'''avg("Accuracy_Change") FILTER ("Method" = '{m}')''') + f' AS "{m}"' for m in GENERATED)}
FROM chg GROUP BY 1"""

Q["scale_one_anchor"] = lambda s, sf: ledger.scale_one_anchor(averaged(s, sf)).select(
    *ledger.GROUP, "Fold", "ScaleFactor", "Method", near("Accuracy")
)
SQL["scale_one_anchor"] = f"""{_CURVE} SELECT "Dataset", "Model", "SeedsPerLabel", "Fold", "ScaleFactor", "Method",
  {near_sql('"Accuracy"')} AS "Accuracy" FROM anc"""

Q["scaling_curve"] = lambda s, sf: ledger.scaling_curve(averaged(s, sf)).withColumn("Accuracy", near("Accuracy"))
SQL["scaling_curve"] = f"""{_CURVE} SELECT * REPLACE ({near_sql('"Accuracy"')} AS "Accuracy") FROM cur"""

Q["series_by_method"] = lambda s, sf: ledger.series_by_method(averaged(s, sf)).withColumn("accuracy", near("accuracy"))
SQL["series_by_method"] = f"""{_CURVE} SELECT "Model" AS panel_model, "SeedsPerLabel" AS panel_seeds, "Method" AS series,
  "ScaleFactor" AS scale, {near_sql('"Accuracy"')} AS accuracy FROM cur"""

Q["series_by_seed_size"] = lambda s, sf: ledger.series_by_seed_size(averaged(s, sf)).withColumn("accuracy", near("accuracy"))
SQL["series_by_seed_size"] = f"""{_CURVE} SELECT "Model" AS panel_model, "Method" AS panel_method,
  CAST("SeedsPerLabel" AS VARCHAR) AS series, "SeedsPerLabel" AS series_order, "ScaleFactor" AS scale,
  {near_sql('"Accuracy"')} AS accuracy FROM cur"""

Q["headline_table"] = lambda s, sf: ledger.headline(tb.ledger(s, sf)).withColumn("Accuracy", near("Accuracy"))
SQL["headline_table"] = f"""WITH {tb.LEDGER_SQL} SELECT "Method", "Model", {near_sql('avg("Accuracy")')} AS "Accuracy"
FROM led WHERE "SeedsPerLabel" = 20 AND "ScaleFactor" = 10 GROUP BY 1, 2"""

Q["distinct_sets"] = lambda s, sf: ledger.distinct_sets(tb.ledger(s, sf))
SQL["distinct_sets"] = f"""WITH {tb.LEDGER_SQL}
SELECT DISTINCT 'dataset' AS kind, "Dataset" AS value, 0 AS rank FROM led
UNION ALL SELECT DISTINCT 'model', "Model", 0 FROM led
UNION ALL SELECT DISTINCT 'seed_size', CAST("SeedsPerLabel" AS VARCHAR), "SeedsPerLabel" FROM led
UNION ALL SELECT DISTINCT 'method', "Method", 0 FROM led WHERE "Method" NOT IN ('Baseline', 'Tuned_Baseline')"""


def _grid_sql(spec: grid.GridSpec, name: str = "grid") -> str:
    gates = ", ".join(f"('{m}', {n})" for m, n in spec.min_seeds)
    lit = tb._sql_list
    return f"""{name} AS (
  WITH base AS (SELECT d."Dataset", f."Fold", n."SeedsPerLabel", s."SeedFoldSelection", o."Model"
    FROM (SELECT DISTINCT "Dataset" FROM led) d, (SELECT CAST(unnest(range(1, {spec.folds + 1})) AS INTEGER) AS "Fold") f,
      (SELECT unnest({lit(list(spec.seed_sizes))}) AS "SeedsPerLabel") n,
      (SELECT CAST(unnest(range(1, {spec.selections + 1})) AS INTEGER) AS "SeedFoldSelection") s,
      (SELECT unnest({lit(list(spec.models))}) AS "Model") o)
  SELECT b.*, 1 AS "ScaleFactor", m."Method" FROM base b, (SELECT unnest(['Baseline', 'Tuned_Baseline']) AS "Method") m
  UNION ALL
  SELECT b.*, k."ScaleFactor", g."Method" FROM base b, (SELECT unnest({lit(list(spec.scales))}) AS "ScaleFactor") k
    JOIN (VALUES {gates}) g("Method", min_seeds) ON b."SeedsPerLabel" >= g.min_seeds)"""


Q["experiment_grid"] = lambda s, sf: grid.experiment_grid(tb.ledger(s, sf))
SQL["experiment_grid"] = f"WITH {tb.LEDGER_SQL}, {_grid_sql(grid.CURRENT)} SELECT * FROM grid"

Q["experiment_grid_archived"] = lambda s, sf: grid.experiment_grid(tb.ledger(s, sf), grid.ARCHIVED)
SQL["experiment_grid_archived"] = f"WITH {tb.LEDGER_SQL}, {_grid_sql(grid.ARCHIVED)} SELECT * FROM grid"

Q["experiment_subset"] = lambda s, sf: grid.subset(
    grid.experiment_grid(tb.ledger(s, sf)), datasets=["1-URGENT", "5-LOW"], folds=[1, 3], seed_sizes=[5, 20], selections=5
)
SQL["experiment_subset"] = f"""WITH {tb.LEDGER_SQL}, {_grid_sql(grid.CURRENT)} SELECT * FROM grid
WHERE "Dataset" IN ('1-URGENT', '5-LOW') AND "Fold" IN (1, 3) AND "SeedsPerLabel" IN (5, 20) AND "SeedFoldSelection" <= 5"""

Q["pending_runs"] = lambda s, sf: grid.pending(grid.experiment_grid(tb.ledger(s, sf)), tb.ledger(s, sf))
SQL["pending_runs"] = f"""WITH {tb.LEDGER_SQL}, {_grid_sql(grid.CURRENT)}
SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM led l WHERE {" AND ".join(f'l."{c}" = g."{c}"' for c in ledger.KEY)})"""


def run_accounting(spark, sf):
    led = tb.ledger(spark, sf)
    out = None
    for name, spec in grid.SCENARIOS.items():
        part = grid.accounting(grid.experiment_grid(led, spec), led, ["Dataset"]).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


Q["run_accounting"] = run_accounting
SQL["run_accounting"] = f"""WITH {tb.LEDGER_SQL}, {_grid_sql(grid.SCENARIOS["short"], "g1")}, {_grid_sql(grid.SCENARIOS["full"], "g2")},
done AS (SELECT DISTINCT {", ".join(f'"{c}"' for c in ledger.KEY)}, 1 AS d FROM led)
""" + " UNION ALL ".join(
    f"""SELECT "Dataset", '{n}' AS scenario, count(*) AS planned, count(d) AS done, count(*) - count(d) AS pending
FROM {g} LEFT JOIN done USING ({", ".join(f'"{c}"' for c in ledger.KEY)}) GROUP BY 1""" for n, g in (("short", "g1"), ("full", "g2"))
)
