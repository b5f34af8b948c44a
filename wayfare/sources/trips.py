"""Reading trip records and zones, writing result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a trip record; the tip may be missing.
REQUIRED = ("tpep_pickup_datetime", "tpep_dropoff_datetime", "PULocationID", "DOLocationID", "trip_distance", "fare_amount")
OPTIONAL = "tip_amount"


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Fails before any job when columns are missing, naming them."""
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_trips(spark: SparkSession, months: dict[str, str]) -> DataFrame:
    """One file or folder per month (month name to path, Parquet or CSV), only the needed columns, with source_month."""
    if not months:
        raise ValueError("no trip files")

    def one(month: str, path: str) -> DataFrame:
        df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
        require_columns(df)
        tip = F.col(OPTIONAL) if OPTIONAL in df.columns else F.lit(0.0).alias(OPTIONAL)
        return coerce_types(df.select(*REQUIRED, tip)).withColumn("source_month", F.lit(month))

    return reduce(DataFrame.unionByName, (one(*m) for m in sorted(months.items())))


def coerce_types(df: DataFrame) -> DataFrame:
    """Timestamps and numbers; what can't be read becomes null. The clock has no zone."""
    kinds = {"tpep_pickup_datetime": "timestamp_ntz", "tpep_dropoff_datetime": "timestamp_ntz", "PULocationID": "int", "DOLocationID": "int", "trip_distance": "double", "fare_amount": "double", "tip_amount": "double"}
    return df.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def read_zones(spark: SparkSession, lookup_path: str, centroids: DataFrame) -> DataFrame:
    """Zones that have a centroid, with names from the lookup; unmatched names are "Unknown"."""
    names = spark.read.csv(lookup_path, header=True).select(F.col("LocationID").try_cast("int").alias("zone_id"), F.col("Borough").alias("borough"), F.col("Zone").alias("zone_name"), F.col("service_zone"))
    text = [F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("borough", "zone_name", "service_zone")]
    return centroids.join(names, "zone_id", "left").select(*centroids.columns, *text)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)


def write_observed_od(observed: DataFrame, folder: str) -> None:
    """The observed cells as a table of their own, one folder for each time bin."""
    write_table(observed, f"{folder}/observed_od", "time_bin")
