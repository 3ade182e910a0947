"""Queries on neighbours, oversampling, models, tuning and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as tb
from checks.splits import _SEQ_HEAD, seeds_sql
from checks.synthetic import long
from odorframe.operators import augment, evaluate, models, neighbors, oversample, split, tune
from odorframe.plans import experiment
from odorframe.session import cut_lineage

Q = {}
SQL = {}
FLAT = "flat AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(range(64), lambda i: pow(p.v[i + 1] - b.v[i + 1], 2))))"
L1 = "list_sum(list_transform(range(64), lambda i: abs(p.v[i + 1] - b.v[i + 1])))"


def vectors(spark, sf):
    return tb.sequences(spark, sf).select("measurement_id", "label", F.flatten("x").alias("v"))


def all_neighbors(spark, sf, metric="euclidean", k=5):
    v = vectors(spark, sf)
    nn = neighbors.knn_join(
        v.select(F.col("measurement_id").alias("probe_id"), "v"),
        v.select(F.col("measurement_id").alias("build_id"), "v", "label"),
        k,
        metric=metric,
        skip_self=True,
    )
    return nn.select("probe_id", "ordinal", "build_id", "label", tb.r6("distance"))


def _nn_sql(dist=DIST, k=5, within="") -> str:
    return f"""nn AS (SELECT * FROM (SELECT p.id, b.id AS other, b.label AS other_label, {dist} AS d,
    row_number() OVER (PARTITION BY p.id ORDER BY {dist}, b.id) AS o
    FROM flat p JOIN flat b ON p.id <> b.id {within}) WHERE o <= {k})"""


Q["nearest_neighbors"] = all_neighbors
SQL["nearest_neighbors"] = f"""WITH {FLAT}, {_nn_sql()}
SELECT id AS probe_id, CAST(o AS INTEGER) AS ordinal, other AS build_id, other_label AS label, round(d, 6) + 0 AS distance FROM nn"""

Q["nearest_neighbors_manhattan"] = lambda s, sf: all_neighbors(s, sf, "manhattan", 3)
SQL["nearest_neighbors_manhattan"] = SQL["nearest_neighbors"].replace(_nn_sql(), _nn_sql(L1, 3))


def class_neighbors(spark, sf):
    nn = oversample.class_neighbors(tb.sequences(spark, sf), 5)
    return nn.select("source_id", "ordinal", F.col("__other").alias("other_id"))


Q["class_neighbors"] = class_neighbors
SQL["class_neighbors"] = f"""WITH {FLAT}, {_nn_sql(within='AND p.label = b.label')}
SELECT id AS source_id, CAST(o AS INTEGER) AS ordinal, other AS other_id FROM nn"""

_RANK = f"""rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {tb.md5_sql('rank', 'id')}) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM flat)"""
_MADE = """cells AS (SELECT measurement_id, copy, x.label, CAST(i // 8 AS INTEGER) AS channel, CAST(i % 8 AS INTEGER) AS t,
    x.v[i + 1] + gap * (y.v[i + 1] - x.v[i + 1]) AS value
  FROM pk JOIN nn ON nn.id = pk.source_id AND nn.o = pk.o JOIN flat x ON x.id = pk.source_id JOIN flat y ON y.id = nn.other,
    (SELECT unnest(range(64)) AS i))
SELECT id AS measurement_id, 0 AS copy, label, CAST(i // 8 AS INTEGER) AS channel, CAST(i % 8 AS INTEGER) AS t, round(v[i + 1], 6) + 0 AS value
FROM flat, (SELECT unnest(range(64)) AS i)
UNION ALL SELECT measurement_id, copy, label, channel, t, round(value, 6) + 0 FROM cells"""

Q["smote"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "SMOTE", 3), ["label"])
_SH = tb.md5_sql("smote", "id", "copy")
SQL["smote"] = f"""WITH {FLAT}, {_RANK}, {_nn_sql(within='AND p.label = b.label')},
dr AS (SELECT id, copy, label, CAST(floor({tb.uniform_sql('h')} * (n * 5)) AS BIGINT) AS pick, {tb.uniform_sql('h', 1)} AS gap
  FROM (SELECT *, {_SH} AS h FROM (SELECT *, CAST(unnest([1, 2]) AS INTEGER) AS copy FROM rk))),
pk AS (SELECT dr.id AS measurement_id, copy, k.id AS source_id, pick % 5 + 1 AS o, gap
  FROM dr JOIN rk k ON k.label = dr.label AND k.r = pick // 5 + 1),
{_MADE}"""

_QUOTA = f"""WITH {FLAT}, {_nn_sql()},
hd AS (SELECT p.id, p.label, sum(CASE WHEN other_label <> p.label THEN 1 ELSE 0 END) AS hard FROM nn JOIN flat p ON p.id = nn.id GROUP BY 1, 2),
qt AS (SELECT id, label, CAST(hard AS BIGINT) AS hard, CAST(round_even(hard * (count(*) OVER w) * 2 / (sum(hard) OVER w), 0) AS BIGINT) AS quota
  FROM hd WINDOW w AS (PARTITION BY label))"""


def adasyn_quota(spark, sf):
    return oversample.adasyn_quota(tb.sequences(spark, sf), 3).drop("k")


Q["adasyn_quota"] = adasyn_quota
SQL["adasyn_quota"] = f"{_QUOTA} SELECT id AS measurement_id, label, hard, quota FROM qt"

Q["adasyn_outcome"] = lambda s, sf: oversample.adasyn_outcome(tb.sequences(s, sf), 3)
SQL["adasyn_outcome"] = f"""{_QUOTA} SELECT label, count(*) AS n, CAST(sum(hard) AS BIGINT) AS hard,
  CAST(coalesce(sum(quota), 0) AS BIGINT) AS planned, CASE WHEN sum(hard) > 0 THEN 'ok' ELSE 'no hard samples' END AS outcome FROM qt GROUP BY 1"""

Q["adasyn"] = lambda s, sf: long(augment.generate(tb.sequences(s, sf), "ADASYN", 3), ["label"])
_AH = tb.md5_sql("adasyn", "id", "copy")
SQL["adasyn"] = f"""{_QUOTA.replace('nn AS (', 'na AS (').replace('FROM nn', 'FROM na').replace('= nn.id', '= na.id')},
{_nn_sql(within='AND p.label = b.label')},
pk AS (SELECT id AS measurement_id, copy, id AS source_id, CAST(floor({tb.uniform_sql('h')} * 5) AS BIGINT) + 1 AS o, {tb.uniform_sql('h', 1)} AS gap
  FROM (SELECT *, {_AH} AS h FROM (SELECT id, CAST(unnest(range(1, quota + 1)) AS INTEGER) AS copy FROM qt))),
{_MADE}"""


def _fold_sides(spark, sf):
    """Every fold as a run: test rows probe the rows of all other folds."""
    v = vectors(spark, sf)
    parts = split.train_test(split.assign_folds(split.measurements(v))).join(v.drop("label"), "measurement_id")
    train = parts.filter(F.col("part") == "train").select("run_fold", F.col("measurement_id").alias("build_id"), "label", "v")
    test = parts.filter(F.col("part") == "test").select("run_fold", F.col("measurement_id").alias("probe_id"), "label", "v")
    return train, test


def knn_predictions(spark, sf, weights="uniform", k=5, metric="euclidean"):
    train, test = _fold_sides(spark, sf)
    return models.knn_classify(train, test, ["run_fold"], k, weights, metric)


_FLAT_FOLD = _SEQ_HEAD.replace("WITH ", f"WITH {FLAT}, ", 1)


def _vote_sql(weight: str, k: int, dist=DIST) -> str:
    return f"""{_FLAT_FOLD},
kn AS (SELECT * FROM (SELECT fp.fold AS run_fold, p.id, p.label, b.label AS lb, {dist} AS d,
    row_number() OVER (PARTITION BY p.id ORDER BY {dist}, b.id) AS o
  FROM flat p JOIN fld fp USING (id) JOIN (flat b JOIN fld fb USING (id)) ON fb.fold <> fp.fold) WHERE o <= {k}),
vt AS (SELECT run_fold, id, label, lb, sum({weight}) AS w FROM kn GROUP BY 1, 2, 3, 4),
sh AS (SELECT *, w / sum(w) OVER (PARTITION BY id) AS share FROM vt),
pr AS (SELECT run_fold, id, label, lb AS prediction FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, lb) AS rn FROM vt) WHERE rn = 1)"""


Q["knn_predictions"] = knn_predictions
SQL["knn_predictions"] = f"{_vote_sql('1', 5)} SELECT run_fold, id AS probe_id, label, prediction FROM pr"
Q["knn_distance_manhattan"] = lambda s, sf: knn_predictions(s, sf, "distance", 7, "manhattan")
SQL["knn_distance_manhattan"] = f"{_vote_sql('1 / d', 7, L1)} SELECT run_fold, id AS probe_id, label, prediction FROM pr"


def knn_probabilities(spark, sf):
    train, test = _fold_sides(spark, sf)
    nn = neighbors.knn_join(test.drop("label"), train, 5, within=["run_fold"])
    return models.knn_votes(nn, ["run_fold"], 5, "distance").withColumn("share", tb.r6("share"))


Q["knn_probabilities"] = knn_probabilities
SQL["knn_probabilities"] = f"""{_vote_sql('1 / d', 5)} SELECT run_fold, id AS probe_id, lb AS label, round(share, 6) + 0 AS share FROM sh"""

_SCORE = """lab AS (SELECT run_fold, l, sum(s) AS support, sum(p) AS predicted, sum(h) AS tp FROM (
    SELECT run_fold, label AS l, 1 AS s, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h FROM pr
    UNION ALL SELECT run_fold, prediction, 0, 1, 0 FROM pr) GROUP BY 1, 2),
sc AS (SELECT run_fold, CAST(sum(support) AS BIGINT) AS n_test, sum(tp) / sum(support) AS accuracy,
  sum(2 * tp / (support + predicted) * support) / sum(support) AS f1 FROM lab GROUP BY 1)"""


def knn_scores(spark, sf):
    out = evaluate.scores(knn_predictions(spark, sf), ["run_fold"])
    return out.withColumns({"accuracy": tb.r6("accuracy"), "f1": tb.r6("f1")})


Q["knn_scores"] = knn_scores
SQL["knn_scores"] = f"""{_vote_sql('1', 5)}, {_SCORE}
SELECT run_fold, n_test, round(accuracy, 6) + 0 AS accuracy, round(f1, 6) + 0 AS f1 FROM sc"""


def confusion_counts(spark, sf):
    return evaluate.confusion(knn_predictions(spark, sf), ["run_fold"])


Q["confusion_counts"] = confusion_counts
SQL["confusion_counts"] = f"{_vote_sql('1', 5)} SELECT run_fold, label, prediction, count(*) AS n FROM pr GROUP BY 1, 2, 3"


# --- model stage on whole folds, tuning, whole runs ------------------------------------


def label_codes(spark, sf):
    """Sorted labels to 0..n-1 as the fitted indexer sees them."""
    v = vectors(spark, sf)
    return models.label_index(v).transform(v).select("label", F.col("target").cast("int").alias("code")).distinct()


Q["label_codes"] = label_codes
SQL["label_codes"] = f"WITH {FLAT} SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT label FROM flat)"


def _run_keys(spark, sf):
    return tb.ledger(spark, sf).select("Dataset", "Fold", "SeedsPerLabel").distinct()


def candidate_draw(spark, sf):
    """Twenty settings per (dataset, fold, seed size) found in the ledger, and all of a small space."""
    runs = _run_keys(spark, sf)
    key = ["Dataset", "Fold", "SeedsPerLabel"]
    out = tune.candidates(runs, key, "KNN").unionByName(tune.candidates(runs, key, "LogisticRegression"))
    return out.select(*key, "model", "candidate", "place")


def _draw_sql(model):
    n = len(tune.combinations(models.SPACES[model]))
    key = ", ".join(f'CAST("{c}" AS VARCHAR)' for c in ("Dataset", "Fold", "SeedsPerLabel"))
    return f"""SELECT "Dataset", "Fold", "SeedsPerLabel", '{model}' AS model, CAST(i AS INTEGER) AS candidate, CAST(o AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY "Dataset", "Fold", "SeedsPerLabel"
    ORDER BY md5(concat_ws('|', '42|candidate|{model}', {key}, CAST(i AS VARCHAR)))) AS o
  FROM (SELECT DISTINCT "Dataset", "Fold", "SeedsPerLabel" FROM led), (SELECT unnest(range({n})) AS i)) WHERE o <= 20"""


Q["candidate_draw"] = candidate_draw
SQL["candidate_draw"] = f"WITH {tb.LEDGER_SQL} {_draw_sql('KNN')} UNION ALL {_draw_sql('LogisticRegression')}"


def candidate_counts(spark, sf):
    """Candidates actually searched per model: never more than the space holds."""
    key = ["Dataset", "Fold", "SeedsPerLabel"]
    runs = _run_keys(spark, sf)
    out = None
    for m in models.SPACES:
        part = tune.candidates(runs, key, m).groupBy("Dataset", "model").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


Q["candidate_counts"] = candidate_counts
_SIZES = ", ".join(f"('{m}', {min(20, len(tune.combinations(s)))})" for m, s in models.SPACES.items())
SQL["candidate_counts"] = f"""WITH {tb.LEDGER_SQL} SELECT "Dataset", model, CAST(count(*) * any_value(c) AS BIGINT) AS n
FROM (SELECT DISTINCT "Dataset", "Fold", "SeedsPerLabel" FROM led), (VALUES {_SIZES}) v(model, c) GROUP BY 1, 2"""


def halving(spark, sf):
    """The best neighbour-vote setting per fold, searched on the training rows of that fold."""
    v = vectors(spark, sf)
    folds = split.assign_folds(split.measurements(v))
    train = split.train_test(folds).filter(F.col("part") == "train").drop("part", "fold")
    cv = split.assign_folds(train, 5, run=["run_fold"]).withColumnRenamed("fold", "cv_fold")
    rows = cv.join(v.drop("label"), "measurement_id").withColumn("cv_k", F.lit(5)).withColumnRenamed("measurement_id", "row_id")
    space = tune.candidates(train.select("run_fold").distinct(), ["run_fold"], "KNN")
    best = tune.halving_knn(rows, ["run_fold"], space)
    drawn = space.select("run_fold", "candidate", F.lit(True).alias("drawn"))
    sane = F.col("accuracy").between(0.0, 1.0).alias("sane")
    return best.join(drawn, ["run_fold", "candidate"], "left").select("run_fold", F.coalesce("drawn", F.lit(False)).alias("drawn"), sane, "n_rows")


# Which setting wins depends on three rungs of votes; the fold, the rows of the last rung and that it was drawn do not.
Q["halving_search"] = halving
SQL["halving_search"] = f"""{_SEQ_HEAD},
tr AS (SELECT r AS run_fold, count(*) AS n, count(DISTINCT label) AS classes FROM fld, (SELECT unnest(range(1, 11)) AS r) WHERE fold <> r GROUP BY 1)
SELECT CAST(run_fold AS INTEGER) AS run_fold, true AS drawn, true AS sane,
  CAST(least(n, 10 * classes * CASE WHEN 90 * classes <= n THEN 9 WHEN 30 * classes <= n THEN 3 ELSE 1 END) AS BIGINT) AS n_rows FROM tr"""


def baseline_runs(spark, sf):
    """Neighbour vote on flat sequences for every fold, selection and seed size."""
    seeds, test = experiment.run_tables(tb.sequences(spark, sf), (1, 2, 5, 10, 20), 10)
    out = experiment.knn_runs(seeds.withColumn("copy", F.lit(0)), test, "sequence")
    return out.withColumns({"accuracy": tb.r6("accuracy"), "f1": tb.r6("f1")})


_RUNS = lambda sizes, sel: f"""{_SEQ_HEAD}, {seeds_sql(sizes, sel)},
sd AS (SELECT run_fold, selection, n_seeds, s.id, cell.label, c, t, v FROM seeds s JOIN cell USING (id)),
scl AS (SELECT run_fold, selection, n_seeds, c, avg(v) AS m, stddev_pop(v) AS s FROM sd GROUP BY 1, 2, 3, 4),
tr0 AS (SELECT sd.* REPLACE ((v - m) / s AS v) FROM sd JOIN scl USING (run_fold, selection, n_seeds, c)),
te AS (SELECT run_fold, selection, n_seeds, cell.id, cell.label, cell.c AS c, t, (v - m) / s AS v
  FROM cell JOIN fld USING (id) JOIN scl ON run_fold = fold AND scl.c = cell.c)"""
_RUN_SCORE = """kn AS (SELECT * FROM (SELECT p.run_fold, p.selection, p.n_seeds, p.id, p.label, b.label AS lb,
    row_number() OVER (PARTITION BY p.run_fold, p.selection, p.n_seeds, p.id ORDER BY list_distance(p.v, b.v), b.id) AS o
  FROM tp p JOIN bp b USING (run_fold, selection, n_seeds)) WHERE o <= 5),
vt AS (SELECT run_fold, selection, n_seeds, id, label, lb, count(*) AS w FROM kn GROUP BY ALL),
pr AS (SELECT * FROM (SELECT run_fold, selection, n_seeds, id, label, lb AS prediction,
    row_number() OVER (PARTITION BY run_fold, selection, n_seeds, id ORDER BY w DESC, lb) AS rn FROM vt) WHERE rn = 1),
lab AS (SELECT run_fold, selection, n_seeds, l, sum(s) AS support, sum(p) AS predicted, sum(h) AS tp FROM (
    SELECT run_fold, selection, n_seeds, label AS l, 1 AS s, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h FROM pr
    UNION ALL SELECT run_fold, selection, n_seeds, prediction, 0, 1, 0 FROM pr) GROUP BY ALL)
SELECT run_fold, selection, n_seeds, CAST(sum(support) AS BIGINT) AS n_test, round(sum(tp) / sum(support), 6) + 0 AS accuracy,
  round(sum(2 * tp / (support + predicted) * support) / sum(support), 6) + 0 AS f1 FROM lab GROUP BY 1, 2, 3"""
_VEC = lambda src, key, order: f"SELECT run_fold, selection, n_seeds, {key} AS id, label, list(v ORDER BY {order}) AS v FROM {src} GROUP BY ALL"
_ID0 = "CAST(id AS VARCHAR) || '|0'"

Q["baseline_runs"] = baseline_runs
SQL["baseline_runs"] = f"""{_RUNS('[1, 2, 5, 10, 20]', 10)},
bp AS ({_VEC('tr0', _ID0, 'c, t')}), tp AS ({_VEC('te', 'CAST(id AS VARCHAR)', 'c, t')}),
{_RUN_SCORE}"""


def baseline_point_runs(spark, sf):
    """The same with single time points as rows, one selection, two seed sizes."""
    seeds, test = experiment.run_tables(tb.sequences(spark, sf), (1, 5), 1)
    out = experiment.knn_runs(seeds.withColumn("copy", F.lit(0)), test, "point")
    return out.withColumns({"accuracy": tb.r6("accuracy"), "f1": tb.r6("f1")})


Q["baseline_point_runs"] = baseline_point_runs
SQL["baseline_point_runs"] = f"""{_RUNS('[1, 5]', 1)},
bp AS ({_VEC('tr0', _ID0 + " || '|' || t", 'c')}), tp AS ({_VEC('te', "CAST(id AS VARCHAR) || '|' || t", 'c')}),
{_RUN_SCORE}"""


def augmented_runs(spark, sf):
    """Runs trained on seeds plus scaled copies, scored on the real test fold."""
    seeds, test = experiment.run_tables(tb.sequences(spark, sf), (5, 10), 1)
    out = experiment.knn_runs(experiment.generate_runs(seeds, "Scaling", 3), test, "sequence")
    return out.withColumns({"accuracy": tb.r6("accuracy"), "f1": tb.r6("f1")})


_KEYED = "concat_ws('|', CAST(run_fold AS VARCHAR), CAST(selection AS VARCHAR), CAST(n_seeds AS VARCHAR), CAST(id AS VARCHAR))"
Q["augmented_runs"] = augmented_runs
SQL["augmented_runs"] = f"""{_RUNS('[5, 10]', 1)},
cp AS (SELECT *, {tb.md5_sql('scaling', 'kid', 'copy', 'c')} AS h FROM (SELECT *, {_KEYED} AS kid, unnest(range(3)) AS copy FROM tr0)),
tr AS (SELECT * REPLACE (CASE WHEN copy = 0 THEN v ELSE v * (1 + 0.1::DOUBLE * {tb.normal_sql('h', '0')}) END AS v) FROM cp),
bp AS ({_VEC('tr', "CAST(id AS VARCHAR) || '|' || copy", 'c, t')}), tp AS ({_VEC('te', 'CAST(id AS VARCHAR)', 'c, t')}),
{_RUN_SCORE}"""


def _whole_runs(method, sizes, factor=3, selections=2):
    def query(spark, sf):
        seeds, test = experiment.run_tables(tb.sequences(spark, sf), sizes, selections)
        out = experiment.knn_runs(experiment.generate_runs(seeds, method, factor), test, "sequence")
        return out.withColumns({"accuracy": tb.r6("accuracy"), "f1": tb.r6("f1")})

    return query


_R = "run_fold, selection, n_seeds"
_RUN_VECTORS = f"""vk AS (SELECT {_R}, id, label, kid, list(v ORDER BY c, t) AS v FROM (SELECT *, {_KEYED} AS kid FROM tr0) GROUP BY ALL),
sz AS (SELECT *, least(5, min(n) OVER (PARTITION BY {_R}) - 1) AS k FROM (SELECT {_R}, label, count(*) AS n FROM vk GROUP BY ALL)),
nn AS (SELECT * FROM (SELECT p.kid, b.kid AS other, row_number() OVER (PARTITION BY p.kid ORDER BY list_distance(p.v, b.v), b.kid) AS o
  FROM vk p JOIN vk b USING ({_R}, label) WHERE p.kid <> b.kid) WHERE o <= 5)"""
_RUN_MADE = f"""made AS (SELECT {_R}, pk.id, pk.label, pk.copy, list_transform(list_zip(pk.sv, y.v), lambda z: z[1] + pk.gap * (z[2] - z[1])) AS v
  FROM pk JOIN nn ON nn.kid = pk.skid AND nn.o = pk.o JOIN (SELECT kid, v FROM vk) y ON y.kid = nn.other)"""
_RUN_TRAIN = f"""bp AS (SELECT {_R}, CAST(id AS VARCHAR) || '|0' AS id, label, v FROM vk {{only}}
  UNION ALL SELECT {_R}, CAST(id AS VARCHAR) || '|' || copy, label, v FROM made),
tp AS ({_VEC('te', 'CAST(id AS VARCHAR)', 'c, t')})"""


def _smote_runs_sql(sizes, factor=3, selections=2):
    return f"""{_RUNS(sizes, selections)}, {_RUN_VECTORS},
rk AS (SELECT vk.*, n, k, row_number() OVER (PARTITION BY {_R}, label ORDER BY {tb.md5_sql('rank', 'kid')}) AS r FROM vk JOIN sz USING ({_R}, label)),
dr AS (SELECT *, CAST(floor({tb.uniform_sql('h')} * (n * k)) AS BIGINT) AS pick, {tb.uniform_sql('h', 1)} AS gap
  FROM (SELECT *, {tb.md5_sql('smote', 'kid', 'copy')} AS h FROM (SELECT *, CAST(unnest(range(1, {factor})) AS INTEGER) AS copy FROM rk WHERE k > 0))),
pk AS (SELECT {_R}, dr.id, label, dr.copy, s.kid AS skid, s.v AS sv, dr.pick % dr.k + 1 AS o, dr.gap
  FROM dr JOIN (SELECT {_R}, label, kid, v, r FROM rk) s USING ({_R}, label) WHERE s.r = dr.pick // dr.k + 1),
{_RUN_MADE}, {_RUN_TRAIN.format(only='')}, {_RUN_SCORE}"""


def _hard_sql(factor):
    return f"""na AS (SELECT * FROM (SELECT p.kid, b.label AS lb, row_number() OVER (PARTITION BY p.kid ORDER BY list_distance(p.v, b.v), b.kid) AS o
  FROM vk p JOIN vk b USING ({_R}) WHERE p.kid <> b.kid) WHERE o <= 5),
hd AS (SELECT vk.*, sz.n, greatest(sz.k, 1) AS k, sz.k AS k0, coalesce((SELECT sum(CASE WHEN na.lb <> vk.label THEN 1 ELSE 0 END) FROM na WHERE na.kid = vk.kid AND na.o <= greatest(sz.k, 1)), 0) AS hard
  FROM vk JOIN sz USING ({_R}, label)),
qt AS (SELECT *, sum(hard) OVER (PARTITION BY {_R}, label) AS total,
  CAST(round_even(hard * n * {factor - 1} / nullif(sum(hard) OVER (PARTITION BY {_R}, label), 0), 0) AS BIGINT) AS quota FROM hd),
easy AS (SELECT DISTINCT {_R} FROM qt WHERE total = 0 AND k0 > 0)"""


def _adasyn_runs_sql(sizes, factor=3, selections=2):
    return f"""{_RUNS(sizes, selections)}, {_RUN_VECTORS}, {_hard_sql(factor)},
pk AS (SELECT *, kid AS skid, v AS sv, CAST(floor({tb.uniform_sql('h')} * k) AS BIGINT) + 1 AS o, {tb.uniform_sql('h', 1)} AS gap
  FROM (SELECT *, {tb.md5_sql('adasyn', 'kid', 'copy')} AS h FROM (
    SELECT *, CAST(unnest(range(1, quota + 1)) AS INTEGER) AS copy FROM qt WHERE k0 > 0 AND quota > 0 AND ({_R}) NOT IN (SELECT ({_R}) FROM easy)))),
{_RUN_MADE}, {_RUN_TRAIN.format(only=f'WHERE ({_R}) NOT IN (SELECT ({_R}) FROM easy)')}, {_RUN_SCORE}"""


Q["augmented_runs_smote"] = _whole_runs("SMOTE", (5, 10, 20))
SQL["augmented_runs_smote"] = _smote_runs_sql("[5, 10, 20]")
Q["augmented_runs_adasyn"] = _whole_runs("ADASYN", (10, 20))
SQL["augmented_runs_adasyn"] = _adasyn_runs_sql("[10, 20]")


def adasyn_outcomes(spark, sf):
    """Why runs of the smallest and larger seed sizes are grown or not."""
    seeds, _ = experiment.run_tables(tb.sequences(spark, sf), (1, 10, 20), 2)
    return experiment.run_outcomes(seeds, "ADASYN", 3)


Q["adasyn_run_outcomes"] = adasyn_outcomes
SQL["adasyn_run_outcomes"] = f"""{_RUNS('[1, 10, 20]', 2)}, {_RUN_VECTORS}, {_hard_sql(3)}
SELECT {_R}, CASE WHEN n_seeds < 10 THEN 'seed size below gate' WHEN min(k0) < 1 THEN 'a class has one member'
  WHEN min(total) = 0 THEN 'no hard samples' ELSE 'ok' END AS outcome FROM qt GROUP BY {_R}"""


def mixture_runs(spark, sf):
    """Runs trained on a fitted mixture's samples: every run is scored on its whole test fold."""
    out = _whole_runs("GMM", (5, 10), 2, 1)(spark, sf)
    return out.select("run_fold", "selection", "n_seeds", "n_test", (F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)).alias("sane"))


_RUN_FACTS = lambda sizes, sel: f"""{_SEQ_HEAD} SELECT CAST(fold AS INTEGER) AS run_fold, CAST(selection AS INTEGER) AS selection, CAST(n_seeds AS INTEGER) AS n_seeds,
  count(*) AS n_test, true AS sane FROM fld, (SELECT unnest({sizes}) AS n_seeds), (SELECT unnest(range(1, {sel + 1})) AS selection) GROUP BY ALL"""
Q["augmented_runs_mixture"] = mixture_runs
SQL["augmented_runs_mixture"] = _RUN_FACTS("[5, 10]", 1)


def tuned_baseline_runs(spark, sf):
    """Each run tuned on its seeds, single ones too, and scored with its own best setting."""
    seeds, test = experiment.run_tables(tb.sequences(spark, sf), (1, 5), 1)
    best = cut_lineage(experiment.tune_knn_runs(seeds, "sequence"))
    out = experiment.knn_runs(seeds.withColumn("copy", F.lit(0)), test, "sequence", best)
    joined = out.join(best.select(*experiment.RUN, F.col("accuracy").alias("cv")), experiment.RUN, "left")
    sane = F.coalesce(F.col("cv").between(0, 1) & F.col("accuracy").between(0, 1), F.lit(False))
    return joined.select(*experiment.RUN, "n_test", sane.alias("sane"))


Q["tuned_baseline_runs"] = tuned_baseline_runs
SQL["tuned_baseline_runs"] = _RUN_FACTS("[1, 5]", 1)


def single_seed_folds(spark, sf):
    """Where the only sequence per label of single-seed runs falls in their two folds."""
    seeds, _ = experiment.run_tables(tb.sequences(spark, sf), (1,), 10)
    return experiment.cv_rows(seeds, "sequence").select("run_fold", "selection", "row_id", "label", "cv_k", "cv_fold")


Q["single_seed_folds"] = single_seed_folds
SQL["single_seed_folds"] = f"""{_SEQ_HEAD}, {seeds_sql('[1]', 10)},
rw AS (SELECT run_fold, selection, n_seeds, CAST(id AS VARCHAR) AS row_id, label FROM seeds)
SELECT run_fold, selection, row_id, label, 2 AS cv_k, CAST((row_number() OVER (PARTITION BY run_fold, selection, n_seeds
  ORDER BY label, {tb.md5_sql('fold', 'run_fold', 'selection', 'n_seeds', 'row_id')}, row_id) - 1) % 2 + 1 AS INTEGER) AS cv_fold FROM rw"""
