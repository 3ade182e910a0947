"""Generators that interpolate between nearest neighbours of a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.functions import draws
from odorframe.functions.arrays import lerp_channels
from odorframe.functions.ranking import number_rows
from odorframe.operators.augment import ID, LABEL, copies, register
from odorframe.operators.neighbors import knn_join
from odorframe.session import cut_lineage, small_side

# The most neighbours the two methods look at.
MAX_NEIGHBORS = 5
# Why a run or class isn't grown.
ALONE = "a class has one member"
NO_HARD = "no hard samples"
CHUNK = 10_000


def _vectors(seqs: DataFrame, run: list[str] = ()) -> DataFrame:
    return seqs.select(*run, ID, LABEL, F.flatten("x").alias("v"))


def run_sizes(seqs: DataFrame, run: list[str] = ()) -> DataFrame:
    """``run..., label, n, k``: class sizes and the neighbours looked at in each run.

    k = min(5, smallest class of the run - 1): 0 where a class has a single member. Without
    ``run`` columns the whole table is one run.
    """
    key = list(run) or ["__all"]
    keyed = seqs if run else seqs.withColumn("__all", F.lit(0))
    sizes = keyed.groupBy(*key, LABEL).agg(F.count("*").alias("n"))
    k = F.least(F.lit(MAX_NEIGHBORS), F.min("n") - 1).cast("int").alias("k")
    facts = sizes.join(sizes.groupBy(*key).agg(k), key).select(*run, LABEL, "n", "k")
    return small_side(facts, len(run) + 3)


def class_neighbors(seqs: DataFrame, k: int, run: list[str] = ()) -> DataFrame:
    """``source_id, ordinal, __other``: the k nearest of the same class (and run)."""
    v = _vectors(seqs, run)
    nn = knn_join(
        v.select(*run, LABEL, F.col(ID).alias("probe_id"), "v"),
        v.select(*run, LABEL, F.col(ID).alias("build_id"), "v"),
        k,
        within=[*run, LABEL],
        skip_self=True,
    )
    return nn.select(F.col("probe_id").alias("source_id"), "ordinal", F.col("build_id").alias("__other"))


def _interpolate(picks: DataFrame, nn: DataFrame, seqs: DataFrame, method: str, scale_factor: int) -> DataFrame:
    """Picks ``id, copy, source_id, ordinal, __gap`` to sequences, after the originals."""
    base = seqs.select(F.col(ID).alias("source_id"), LABEL, F.col("x").alias("__bx"))
    other = seqs.select(F.col(ID).alias("__other"), F.col("x").alias("__ox"))
    made = (
        picks.join(nn, ["source_id", "ordinal"])
        .join(base, "source_id")
        .join(other, "__other")
        .withColumn("x", lerp_channels(F.col("__bx"), F.col("__ox"), F.col("__gap")))
        .withColumns({"method": F.lit(method), "scale_factor": F.lit(scale_factor)})
    )
    whole = copies(seqs.select(ID, LABEL, "x"), 1, method).withColumn("scale_factor", F.lit(scale_factor))
    return whole.unionByName(made.select(*whole.columns))


def smote(seqs: DataFrame, scale_factor: int = 2, seed: int = 42, run: list[str] = ()) -> DataFrame:
    """Every class grown to ``scale_factor`` times its size.

    Each new sequence lies at a random place between a random member and a random one
    of its k nearest class members, k being that of its run. The member is drawn by its
    rank in the class, an equi-join over keys that stays even for a class of any size. Ids
    are unique over all runs. A run with a class of one member keeps its originals only.
    """
    keys = seqs.select(*run, ID, LABEL)
    group = [*run, LABEL]
    ranks = number_rows(keys, draws.key_hash(seed, "rank", ID), tie=ID, partition=group)
    sizes = run_sizes(seqs, run)
    h = draws.key_hash(seed, "smote", ID, "copy")
    picks = (
        copies(keys, scale_factor, "SMOTE").filter(F.col("copy") > 0).join(sizes, group).filter(F.col("k") > 0)
        .withColumn("__h", h)
        .withColumn("__pick", draws.index(F.col("__h"), F.col("n") * F.col("k")))
        .withColumn("rank", (F.floor(F.col("__pick") / F.col("k")) + 1).cast("bigint"))
        .withColumn("ordinal", (F.col("__pick") % F.col("k") + 1).cast("int"))
        .withColumn("__gap", draws.uniform(F.col("__h"), 1))
        .drop("source_id")
        .join(ranks.select(*group, "rank", F.col(ID).alias("source_id")), [*group, "rank"])
        .select(ID, "copy", "source_id", "ordinal", "__gap")
    )
    # The list of the five nearest holds that of any smaller k.
    return _interpolate(picks, class_neighbors(seqs, MAX_NEIGHBORS, run), seqs, "SMOTE", scale_factor)


def hardness(seqs: DataFrame, run: list[str] = (), k: int | None = None) -> DataFrame:
    """``run..., measurement_id, label, n, k, hard``: how many of the k nearest of the run are of another class.

    k is that of the run (at least 1), or the one given.
    """
    v = _vectors(seqs, run)
    nn = knn_join(
        v.select(*run, F.col(ID).alias("probe_id"), "v"),
        v.select(*run, F.col(ID).alias("build_id"), "v", LABEL),
        k or MAX_NEIGHBORS,
        within=list(run),
        skip_self=True,
    ).select(F.col("probe_id").alias(ID), "ordinal", F.col(LABEL).alias("__nl"))
    sizes = run_sizes(seqs, run)
    sizes = sizes.withColumn("k", F.lit(k).cast("int") if k else F.greatest("k", F.lit(1)))
    own = v.drop("v").join(sizes, [*run, LABEL])
    # A run of a single row has no neighbour: its row stays, with nothing hard around it.
    near = own.join(nn, ID, "left").filter(F.col("ordinal").isNull() | (F.col("ordinal") <= F.col("k")))
    other = F.coalesce((F.col("__nl") != F.col(LABEL)).cast("int"), F.lit(0))
    return near.groupBy(*run, ID, LABEL, "n", "k").agg(F.sum(other).alias("hard"))


def adasyn_quota(seqs: DataFrame, scale_factor: int, run: list[str] = (), k: int | None = None) -> DataFrame:
    """``run..., measurement_id, label, k, hard, quota``: new sequences per member, half-even rounded.

    A class is to grow by ``n * (scale_factor - 1)``, shared out in proportion to the
    hardness of its members. ``quota`` is NULL in a class without hard members.
    """
    hard = cut_lineage(hardness(seqs, run, k))
    group = [*run, LABEL]
    totals = small_side(hard.groupBy(*group).agg(F.sum("hard").alias("__t")), len(run) + 2)
    share = F.col("hard") * F.col("n") * (scale_factor - 1) / F.nullif(F.col("__t"), F.lit(0))
    return hard.join(totals, group).select(*run, ID, LABEL, "k", "hard", F.rint(share).cast("bigint").alias("quota"))


def adasyn_outcome(seqs: DataFrame, scale_factor: int = 2, run: list[str] = ()) -> DataFrame:
    """Per (run and) class: hard neighbours, planned new sequences, and whether the class can be grown."""
    quota = adasyn_quota(seqs, scale_factor, run)
    outcome = F.when(F.sum("hard") > 0, F.lit("ok")).otherwise(F.lit(NO_HARD))
    alone = run_sizes(seqs, run).select(*run, LABEL, (F.col("k") < 1).alias("__alone"))
    return (
        quota.join(alone, [*run, LABEL])
        .groupBy(*run, LABEL)
        .agg(
            F.count("*").alias("n"),
            F.sum("hard").alias("hard"),
            F.coalesce(F.sum("quota"), F.lit(0)).alias("planned"),
            F.when(F.max("__alone"), F.lit(ALONE)).otherwise(outcome).alias("outcome"),
        )
    )


def adasyn(seqs: DataFrame, scale_factor: int = 2, seed: int = 42, run: list[str] = ()) -> DataFrame:
    """Like SMOTE, with more new sequences around members that sit among other classes.

    Other classes are looked for inside the same ``run`` columns. The method is undefined for a
    class without any hard member: such a run is left out whole, and without ``run`` columns
    that is an error. A run with a class of one member keeps its originals only.
    """
    sizes = run_sizes(seqs, run)
    quota = cut_lineage(adasyn_quota(seqs, scale_factor, run))
    grown = quota.join(sizes.filter(F.col("k") > 0).select(*run, LABEL), [*run, LABEL], "left_semi")
    easy = grown.filter(F.col("quota").isNull())
    if run:
        easy = small_side(easy.select(*run).distinct(), len(run))
        seqs = seqs.join(easy, list(run), "left_anti")
        grown = grown.join(easy, list(run), "left_anti")
    else:
        first = easy.select(LABEL).limit(1).collect()
        if first:
            raise ValueError(f"{NO_HARD} in class {first[0][0]!r}")
    # Two explodes: one member may owe its whole class, so its copies come in chunks.
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / CHUNK).cast("bigint"))
    first = F.col("__chunk") * CHUNK + 1
    picks = (
        grown.filter(F.col("quota") > 0)
        .withColumn("__chunk", F.explode(chunks))
        .withColumn("__copy", F.explode(F.sequence(first, F.least(first + CHUNK - 1, F.col("quota")))))
        .withColumn("copy", F.col("__copy").cast("int"))
        .withColumn("__h", draws.key_hash(seed, "adasyn", ID, "copy"))
        .select(
            ID,
            "copy",
            F.col(ID).alias("source_id"),
            (draws.index(F.col("__h"), F.col("k")) + 1).cast("int").alias("ordinal"),
            draws.uniform(F.col("__h"), 1).alias("__gap"),
        )
    )
    return _interpolate(picks, class_neighbors(seqs, MAX_NEIGHBORS, run), seqs, "ADASYN", scale_factor)


register("SMOTE", smote)
register("ADASYN", adasyn)
