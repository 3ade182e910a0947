"""The given tables seen as points, sequences, groups and a results ledger.

Every mapping exists twice: as a DataFrame and as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SENSORS = ["value", "k"]
SEED = 42

# Element lists of the ledger mapping and the experiment grid.
SEED_SIZES = [1, 2, 5, 10, 20]
SCALES = [2, 3, 5, 10]
MODELS = ["KNN", "RandomForest", "LinearSVC", "LogisticRegression", "RNN"]
METHODS = [
    "Baseline",
    "Tuned_Baseline",
    "Jittering",
    "Scaling",
    "Magnitude_Warping",
    "Time_Warping",
    "SMOTE",
    "ADASYN",
    "Mixup",
    "GMM",
    "HMM_GMM",
    "TimeVAE",
]
LEDGER_COLUMNS = [
    "Dataset",
    "Fold",
    "SeedsPerLabel",
    "SeedFoldSelection",
    "ScaleFactor",
    "Model",
    "Method",
    "Accuracy",
    "F1_Score",
    "Hyperparameters",
    "ExecutionTime_Sec",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str, gaps: bool = False) -> DataFrame:
    """Events as points: user = measurement, event type = label, value and props.k = sensors."""
    value = F.col("value")
    if gaps:
        value = F.when((F.col("event_id") % 7 != 0) & (F.col("user_id") % 50 != 0), value)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("measurement_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("time"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("label"),
        value.alias("value"),
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("double").alias("k"),
    )


def points_sql(gaps: bool = False) -> str:
    value = (
        "CASE WHEN event_id % 7 <> 0 AND user_id % 50 <> 0 THEN value END" if gaps else "value"
    )
    return f"""pts AS (
  SELECT user_id AS id, epoch_us(ts) AS time, event_id AS seq, event_type AS label, {value} AS value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k
  FROM events)"""


def sequences(spark: SparkSession, sf: str, channels: int = 8) -> DataFrame:
    """Embeddings as sequences: 64 values cut into ``channels`` equal channels."""
    steps = 64 // channels
    d = F.transform("embedding", lambda v: v.cast("double"))
    x = F.array(*[F.slice(d, c * steps + 1, steps) for c in range(channels)])
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("measurement_id"), F.col("label").cast("string").alias("label"), x.alias("x")
    )


def cells_sql(channels: int = 8) -> str:
    """seq(id, label) and cell(id, label, c, t, v) for the same cut."""
    steps = 64 // channels
    return f"""seq AS (
  SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cell AS (
  SELECT id, label, CAST(i // {steps} AS INTEGER) AS c, CAST(i % {steps} AS INTEGER) AS t, e[i + 1] AS v
  FROM (SELECT id, label, e, unnest(range(64)) AS i FROM seq))"""


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders as measurements, market segment as label."""
    return (
        table(spark, sf, "orders")
        .select(F.col("o_custkey").alias("c_custkey"))
        .join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
        .groupBy(F.col("c_custkey").alias("measurement_id"))
        .agg(F.min("c_mktsegment").alias("label"))
    )


GROUPS_SQL = """grp AS (
  SELECT o_custkey AS id, min(c_mktsegment) AS label
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""


def _pick(items: list, pos) -> F.Column:
    return F.get(F.lit(items), pos.cast("int"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as results rows."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    method = _pick(METHODS, F.col("l_quantity").cast("int") % 12)
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .withColumn("Method", method)
        .select(
            F.col("o_orderpriority").alias("Dataset"),
            (F.col("l_orderkey") % 10 + 1).cast("int").alias("Fold"),
            _pick(SEED_SIZES, F.col("l_suppkey") % 5).alias("SeedsPerLabel"),
            (F.col("l_partkey") % 10 + 1).cast("int").alias("SeedFoldSelection"),
            F.when(F.col("Method").isin("Baseline", "Tuned_Baseline"), F.lit(1))
            .otherwise(_pick(SCALES, F.floor(F.col("l_orderkey") / 10) % 4))
            .alias("ScaleFactor"),
            _pick(MODELS, F.col("l_linenumber") % 5).alias("Model"),
            "Method",
            F.round(F.col("l_discount") * 10, 2).alias("Accuracy"),
            F.round(F.col("l_tax") * 10, 2).alias("F1_Score"),
            F.concat(F.lit("p"), F.col("l_suppkey")).alias("Hyperparameters"),
            F.col("l_quantity").alias("ExecutionTime_Sec"),
        )
    )


def _sql_list(items: list) -> str:
    return "[" + ", ".join(f"'{i}'" if isinstance(i, str) else str(i) for i in items) + "]"


LEDGER_SQL = f"""led AS (
  SELECT o_orderpriority AS "Dataset", CAST(l_orderkey % 10 + 1 AS INTEGER) AS "Fold",
    ({_sql_list(SEED_SIZES)})[CAST(l_suppkey % 5 AS INTEGER) + 1] AS "SeedsPerLabel",
    CAST(l_partkey % 10 + 1 AS INTEGER) AS "SeedFoldSelection",
    CASE WHEN m IN ('Baseline', 'Tuned_Baseline') THEN 1
         ELSE ({_sql_list(SCALES)})[CAST((l_orderkey // 10) % 4 AS INTEGER) + 1] END AS "ScaleFactor",
    ({_sql_list(MODELS)})[CAST(l_linenumber % 5 AS INTEGER) + 1] AS "Model", m AS "Method",
    round(l_discount * 10, 2) AS "Accuracy", round(l_tax * 10, 2) AS "F1_Score",
    'p' || l_suppkey AS "Hyperparameters", l_quantity AS "ExecutionTime_Sec"
  FROM (SELECT *, ({_sql_list(METHODS)})[CAST(l_quantity AS INTEGER) % 12 + 1] AS m
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def r6(col, name: str | None = None):
    """Rounded to 6 places; adding 0 turns a negative zero into zero."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.round(c, 6) + F.lit(0.0)).alias(name or col)


def md5_sql(purpose: str, *key: str, seed: int = SEED) -> str:
    """The SQL twin of ``draws.key_hash``."""
    return f"md5(concat_ws('|', '{seed}|{purpose}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)}))"


def word_sql(h: str, lane: int) -> str:
    return f"CAST(('0x' || substr({h}, {8 * lane + 1}, 8)) AS BIGINT)"


def uniform_sql(h: str, lane: int = 0) -> str:
    return f"({word_sql(h, lane)} / 4294967296.0::DOUBLE)"


def open_uniform_sql(h: str, lane: int = 0) -> str:
    return f"(({word_sql(h, lane)} + 1) / 4294967297.0::DOUBLE)"


def normal_sql(h: str, lane: str) -> str:
    """Standard normal from hash ``h``; ``lane`` is an SQL integer expression 0..3."""
    w1 = f"CASE WHEN {lane} < 2 THEN {open_uniform_sql(h, 0)} ELSE {open_uniform_sql(h, 2)} END"
    w2 = f"CASE WHEN {lane} < 2 THEN {uniform_sql(h, 1)} ELSE {uniform_sql(h, 3)} END"
    trig = f"CASE WHEN {lane} % 2 = 0 THEN cos(2 * pi() * ({w2})) ELSE sin(2 * pi() * ({w2})) END"
    return f"(sqrt(-2 * ln({w1})) * ({trig}))"
