"""Points to fixed-length sequences.

One measurement may be longer than a task can hold, so nothing here sorts or
collects a whole measurement. Rows are cut into time blocks; window functions run
per (measurement, block); one small summary row per block carries values and row
counts across block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odorframe.functions.arrays import bind, flat_time_major, unflatten_time_major

ID, TIME, SEQ, LABEL = "measurement_id", "time", "seq", "label"
KEY = (ID, "__block")


def _blocked(points: DataFrame, features: list[str], block: Column | float) -> DataFrame:
    """Adds the time block; NaN becomes NULL; rows without a measurement are dropped."""
    b = block if isinstance(block, Column) else F.floor(F.col(TIME) / F.lit(block))
    clean = {
        f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features
    }
    return points.filter(F.col(ID).isNotNull()).withColumns({**clean, "__block": b.cast("bigint")})


def _block_summary(blocked: DataFrame, features: list[str], carry: bool) -> DataFrame:
    """One row per (measurement, block): rows before, total rows, label, carried values."""
    order = F.struct(TIME, SEQ)
    aggs = [
        F.count("*").alias("__n"),
        F.min(F.struct(TIME, SEQ, LABEL)).alias("__first_row"),
    ]
    if carry:
        for i, f in enumerate(features):
            known = F.when(F.col(f).isNotNull(), order)
            aggs += [F.min_by(f, known).alias(f"__first{i}"), F.max_by(f, known).alias(f"__last{i}")]
    whole = Window.partitionBy(ID)
    before = whole.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # Looking back over the reversed order is incremental; a frame up to the following
    # end would be computed anew for every row.
    after = whole.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        *KEY,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("length"),
        F.min("__first_row").over(whole)[LABEL].alias(LABEL),
    ]
    if carry:
        for i in range(len(features)):
            cols += [
                F.col(f"__first{i}"),
                F.last(f"__last{i}", ignorenulls=True).over(before).alias(f"__prev{i}"),
                F.last(f"__first{i}", ignorenulls=True).over(after).alias(f"__next{i}"),
            ]
    return blocked.groupBy(*KEY).agg(*aggs).select(*cols)


def shape_points(
    points: DataFrame, features: list[str], block: Column | float, how: str = "ffill_bfill_zero"
) -> DataFrame:
    """Imputed, numbered points: ``measurement_id, label, time, seq, pos, length, <features>``.

    ``how`` is one of ``none``, ``ffill``, ``bfill``, ``ffill_bfill`` and
    ``ffill_bfill_zero`` (forward fill, then backward fill, then 0). ``pos`` is the
    0-based index in (time, seq) order; ``label`` is the measurement's first label.
    ``block`` is the width of a time block, or an expression that never decreases
    with time; a block should hold what one task can sort.
    """
    if how not in ("none", "ffill", "bfill", "ffill_bfill", "ffill_bfill_zero"):
        raise ValueError(f"unknown imputation {how!r}")
    blocked = _blocked(points, features, block)
    summary = _block_summary(blocked, features, carry=how != "none")
    in_block = Window.partitionBy(*KEY).orderBy(TIME, SEQ)
    back = in_block.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*KEY).orderBy(F.desc(TIME), F.desc(SEQ)).rowsBetween(Window.unboundedPreceding, 0)
    local = {"__in": F.row_number().over(in_block)}
    for i, f in enumerate(features):
        if "ffill" in how:
            local[f"__f{i}"] = F.last(f, ignorenulls=True).over(back)
        if how == "bfill":
            local[f"__b{i}"] = F.last(f, ignorenulls=True).over(ahead)
    numbered = blocked.drop(LABEL).withColumns(local).join(summary, list(KEY))
    out = []
    for i, f in enumerate(features):
        parts = [F.col(f)]
        if "ffill" in how:
            parts += [F.col(f"__f{i}"), F.col(f"__prev{i}")]
        if how == "bfill":
            parts += [F.col(f"__b{i}"), F.col(f"__next{i}")]
        elif "bfill" in how:
            # Still empty means no value before this row: the first value of its block is the next one.
            parts += [F.col(f"__first{i}"), F.col(f"__next{i}")]
        if how.endswith("zero"):
            parts.append(F.lit(0.0))
        out.append(F.coalesce(*parts).alias(f))
    pos = (F.col("__before") + F.col("__in") - 1).cast("bigint").alias("pos")
    return numbered.select(ID, LABEL, TIME, SEQ, pos, F.col("length").cast("bigint").alias("length"), *out)


def _grid_range(q: Column, last: Column, m: int) -> tuple[Column, Column]:
    """First and last grid step k with floor(k * last / m) == q; empty where first > last."""
    gaps = F.nullif(last, F.lit(0))
    lo = F.floor((q * m + last - 1) / gaps).cast("bigint")
    hi = F.least(F.lit(m).cast("bigint"), F.floor(((q + 1) * m - 1) / gaps).cast("bigint"))
    return lo, hi


def on_grid(n: int) -> Column:
    """Whether a row at ``pos`` of ``length`` rows lies next to any of n grid steps.

    Plain arithmetic, so the rows between grid steps of a long measurement are
    dropped in generated code before anything is built for them.
    """
    p, last = F.col("pos"), F.col("length") - 1
    if n == 1:
        return p == 0
    below, above = _grid_range(p, last, n - 1), _grid_range(p - 1, last, n - 1)
    return (last == 0) | (below[0] <= below[1]) | ((p > 0) & (above[0] <= above[1]))


def resample_grid(n: int) -> Column:
    """Grid steps that a row at ``pos`` of ``length`` rows contributes to, with its weight.

    Grid step k of n sits at k(L-1)/(n-1) on the rows. The row below it gets weight
    1-w, the row above it w. All bounds are integer arithmetic; in total a measurement
    sends at most 2n entries, whatever its length.
    """
    p, last = F.col("pos"), F.col("length") - 1
    if n == 1:
        return F.when(p == 0, F.array(F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(1.0).alias("w"))))
    m = F.lit(n - 1).cast("bigint")

    def steps(q: Column) -> Column:
        lo, hi = _grid_range(q, last, n - 1)
        return F.when((q >= 0) & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    def entry(k: Column, up: bool) -> Column:
        w = (k * last % m).cast("double") / m
        return F.struct(k.alias("k"), (w if up else 1.0 - w).alias("w"))

    own = F.transform(steps(p), lambda k: entry(k, False))
    upper = F.transform(steps(p - 1), lambda k: entry(k, True))
    alone = F.transform(
        F.sequence(F.lit(0).cast("bigint"), m), lambda k: F.struct(k.alias("k"), F.lit(1.0).alias("w"))
    )
    return F.when(last == 0, alone).otherwise(F.filter(F.concat(own, upper), lambda e: e["w"] > 0))


def resample(shaped: DataFrame, features: list[str], n: int = 100) -> DataFrame:
    """Fixed-length sequences ``measurement_id, label, x`` by linear resampling to n steps.

    Only the rows next to a grid step leave their task (at most 2n per
    measurement), so the arrays built at the end have a fixed size.
    """
    hit = shaped.filter(on_grid(n)).withColumn("__e", F.explode(resample_grid(n)))
    grid = hit.groupBy(ID, LABEL, F.col("__e.k").alias("k")).agg(
        *[F.sum(F.col("__e.w") * F.col(f)).alias(f"v{i}") for i, f in enumerate(features)]
    )
    rows = F.array_sort(F.collect_list(F.struct("k", *[f"v{i}" for i in range(len(features))])))
    return (
        grid.groupBy(ID, LABEL)
        .agg(rows.alias("__r"))
        .select(ID, LABEL, F.array(*[F.col("__r")[f"v{i}"] for i in range(len(features))]).alias("x"))
    )


def to_sequences(points: DataFrame, features: list[str], block: Column | float, n: int = 100) -> DataFrame:
    """Impute, order and resample in one plan."""
    return resample(shape_points(points, features, block), features, n)


def as_points(seqs: DataFrame, keep: list[str] = (ID, LABEL)) -> DataFrame:
    """One row per (sequence, t) with the channel vector ``v``; label and id repeated."""
    vectors = bind(
        F.col("x"),
        lambda x: F.transform(
            F.sequence(F.lit(0), F.size(x[0]) - 1), lambda t: F.transform(x, lambda c: F.get(c, t))
        ),
    )
    return seqs.select(*keep, F.posexplode(vectors).alias("t", "v"))


def as_long(seqs: DataFrame, keep: list[str] = (ID, LABEL)) -> DataFrame:
    """One row per (sequence, channel, t)."""
    return seqs.select(*keep, F.posexplode("x").alias("channel", "__c")).select(
        *keep, "channel", F.posexplode("__c").alias("t", "value")
    )


def flatten_sequences(seqs: DataFrame) -> DataFrame:
    """Adds ``flat``, the time-major vector of length T*F."""
    return seqs.withColumn("flat", flat_time_major(F.col("x")))


def unflatten_sequences(flat: DataFrame, channels: int) -> DataFrame:
    """Rebuilds ``x`` from ``flat``."""
    return flat.withColumn("x", unflatten_time_major(F.col("flat"), channels))


def fidelity_series(shaped: DataFrame, seqs: DataFrame, features: list[str], n: int = 100) -> DataFrame:
    """Original and resampled curves on the unit interval, in long form.

    ``kind`` is ``original`` or ``resampled``; ``u`` runs from 0 to 1.
    """
    stacked = F.array(*[F.col(f) for f in features])
    original = shaped.select(
        ID,
        F.lit("original").alias("kind"),
        F.when(F.col("length") > 1, F.col("pos") / (F.col("length") - 1)).otherwise(F.lit(0.0)).alias("u"),
        F.posexplode(stacked).alias("channel", "value"),
    )
    again = as_long(seqs).select(
        ID,
        F.lit("resampled").alias("kind"),
        (F.col("t") / F.lit(max(n - 1, 1))).alias("u"),
        "channel",
        "value",
    )
    return original.unionByName(again)


def fidelity_rmse(shaped: DataFrame, seqs: DataFrame, features: list[str], n: int = 100) -> DataFrame:
    """RMSE per (measurement, channel) between each row and the resampled curve at its place.

    The join side ``seqs`` has one bounded row per measurement; the long side of a
    hot measurement is split by AQE, and the averages combine map-side.
    """
    p = F.when(F.col("length") > 1, F.col("pos") * (n - 1) / (F.col("length") - 1)).otherwise(F.lit(0.0))
    lo = F.floor(F.col("__p")).cast("int")
    x = F.col("x")
    joined = shaped.join(seqs.select(ID, "x"), ID).withColumn("__p", p).withColumn("__lo", lo)
    errs = []
    for i, f in enumerate(features):
        a = F.get(x[i], F.col("__lo"))
        b = F.get(x[i], F.least(F.col("__lo") + 1, F.lit(n - 1)))
        errs.append(F.col(f) - (a + (F.col("__p") - F.col("__lo")) * (b - a)))
    squares = F.array(*[e * e for e in errs])
    return (
        joined.select(ID, F.posexplode(squares).alias("channel", "__sq"))
        .groupBy(ID, "channel")
        .agg(F.count("*").alias("n_rows"), F.sqrt(F.avg("__sq")).alias("rmse"))
    )
