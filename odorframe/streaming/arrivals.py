"""The raw folder layout read as files arrive.

The same labelled-CSV scan and the same combined columns as the batch reader, except
that a file's relative path stands in for its number: numbers are consecutive over all
files, which only a finished set of files has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from odorframe.schema import LABEL, DatasetProfile, normalise_time
from odorframe.sources.raw import glob_path, name_problem, relative_path, source_path, with_names


def arriving_csv(
    spark: SparkSession, root: str, schema: T.StructType, profile: DatasetProfile, levels: int = 1, files_per_batch: int = 1000
) -> DataFrame:
    """``file, <columns>, Label`` as a stream; each new file is read once."""
    scanned = (
        spark.readStream.schema(schema)
        .options(header=True, sep=profile.sep, enforceSchema=False, maxFilesPerTrigger=files_per_batch)
        .csv(glob_path(root, levels))
        .withColumn("file", relative_path(source_path(), levels))
    )
    named = with_names(scanned).filter(name_problem(profile).isNull())
    return normalise_time(named.select("file", *schema.names, LABEL))


def append_to(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet table partitioned by label, then stops.

    The checkpoint records the files already taken, so a rerun after a lost cluster adds nothing twice.
    """
    return (
        points.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(LABEL)
        .trigger(availableNow=True)
        .start(path)
    )
