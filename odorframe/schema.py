"""Dataset profiles and column roles of a points table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column names of the combined table and the columns that are never features.
MEASUREMENT = "Measurement_Number"
TIME = "Time"
LABEL = "Label"
INDICATOR = "Label_Indicator"
ID_COLUMNS = (MEASUREMENT, TIME, LABEL)


@dataclass(frozen=True)
class DatasetProfile:
    """How one dataset's raw files look and where its combined table lives."""

    name: str
    table: str
    sep: str = ","
    header: bool = True
    sensors: tuple[str, ...] = ()
    width: str = "at_least"
    drop_empty_cols: bool = False
    interval: float | None = None
    suffixes: tuple[str, ...] = (".csv", ".txt")
    hidden: tuple[str, ...] = (".", "~$")
    indicator: bool = False


# Logical dataset names, combined table names, sensor lists and sampling intervals.
PROFILES: dict[str, DatasetProfile] = {
    p.name: p
    for p in (
        DatasetProfile("Plant_oil", "combined_oil_dataset.csv"),
        DatasetProfile(
            "Brewed_vinegar",
            "combined_vinegar_dataset.csv",
            header=False,
            sensors=("MQ136", "MQ9B", "MQ7B", "MQ2", "MQ8", "MQ138", "MQ137", "MQ5"),
            interval=0.05,
            hidden=(".",),
            indicator=True,
        ),
        DatasetProfile(
            "Wine_spoilage",
            "combined_wine_dataset.csv",
            sep="\t",
            header=False,
            sensors=(
                "Relative Humidity",
                "Temperature",
                "MQ-3_1",
                "MQ-4_1",
                "MQ-6_1",
                "MQ-3_2",
                "MQ-4_2",
                "MQ-6_2",
            ),
            width="exact",
            interval=1.0,
        ),
        DatasetProfile("Chinese_wine", "combined_chinese_wine_dataset.csv", interval=1.0),
        DatasetProfile(
            "Coffee",
            "combined_coffee_dataset.csv",
            sep="\t",
            header=False,
            sensors=("SP-12A", "SP-31", "TGS-813", "TGS-842", "SP-AQ3", "TGS-823", "ST-31", "TGS-800"),
            drop_empty_cols=True,
            interval=1.0,
        ),
    )
}


@dataclass
class Catalog:
    """Logical dataset names to combined tables under one root folder."""

    root: str
    profiles: dict[str, DatasetProfile] = field(default_factory=lambda: dict(PROFILES))
    format: str = "csv"

    def load(self, spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The combined table of one dataset, time column normalised."""
        path = f"{self.root.rstrip('/')}/{self.profiles[name].table}"
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if self.format == "csv":
            # enforceSchema off: a file whose header differs fails instead of being misread.
            reader = reader.options(header=True, enforceSchema=False, inferSchema=schema is None)
        return normalise_time(reader.format(self.format).load(path))


def normalise_time(df: DataFrame) -> DataFrame:
    """Rename the first column that mentions ``Time`` without being it."""
    other = next((c for c in df.columns if TIME in c and c != TIME), None)
    if other is None:
        return df
    if TIME in df.columns:
        raise ValueError(f"renaming {other!r} would give a second {TIME!r} column")
    return df.withColumnRenamed(other, TIME)


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = (*ID_COLUMNS, INDICATOR)) -> list[str]:
    """Numeric columns that are not identifiers.

    The label indicator is left out, as it repeats the label; pass
    ``exclude=ID_COLUMNS`` to treat it as a feature.
    """
    return [
        f.name for f in df.schema.fields if f.name not in exclude and isinstance(f.dataType, T.NumericType)
    ]
