"""Reading tables with column lists and filters, schema checks, cached results, and sinks for aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Filters with more values than this become semi-joins instead of IN lists.
IN_LIST = 1_000


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: dict[str, Sequence] | None = None, sample: int | None = None, string_ids: Sequence[str] = ()) -> DataFrame:
    """Parquet or CSV (by the path's ending) with the columns asked for and the rows whose columns hold the listed values."""
    df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    for name, values in (filters or {}).items():
        values = list(values)
        if len(values) <= IN_LIST:
            df = df.where(F.col(name).isin(values))
        else:
            listed = spark.createDataFrame([(v,) for v in values], f"{name} {df.schema[name].dataType.simpleString()}")
            df = df.join(listed.distinct(), name, "left_semi")
    if columns is not None:
        df = df.select(*columns)
    df = df.withColumns({c: F.col(c).cast("string") for c in string_ids if c in df.columns})
    return df if sample is None else df.limit(sample)


def read_entity(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """One entity's rows; the filter reaches the scan, and files sorted by the key are skipped by their statistics."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value))


@dataclass
class TableSpec:
    """What a table must and may have: required columns raise, optional ones are added with their default."""

    required: Sequence[str]
    optional: dict[str, object] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.required if c not in df.columns]:
            raise ValueError(f"missing required columns: {missing}")
        return df.withColumns({c: F.lit(v) for c, v in self.optional.items() if c not in df.columns})


def read_external(spark: SparkSession, path: str, spec: TableSpec, cohort: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A precomputed table cut to the cohort, and one row with the share of the cohort that it covers."""
    df = spec.apply(spark.read.parquet(path)).join(cohort.select(key).distinct(), key, "left_semi")
    return df, coverage(df, cohort, key)


def coverage(df: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    marked = cohort.select(key).distinct().join(df.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("n_cohort"), F.count("_in").alias("n_covered")).withColumn("ratio", F.try_divide(F.col("n_covered"), F.col("n_cohort")))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The Parquet result at `path`, made first where it is missing or to be rebuilt."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if rebuild or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_events(df: DataFrame, path: str, key: str, time: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet clustered by the entity and sorted by time, so that later reads of one entity touch few row groups."""
    df.repartition(key).sortWithinPartitions(key, time).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_aggregate_csv(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """One CSV file of an aggregate; row-level tables are refused by size."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError("only aggregates are written as one CSV file")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_json(df: DataFrame, most_rows: int = 10_000) -> str:
    """A small aggregate as a JSON list."""
    rows = [r[0] for r in df.limit(most_rows + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(rows) > most_rows:
        raise ValueError("only aggregates are written as JSON")
    return "[" + ",".join(rows) + "]"


def described(df: DataFrame) -> DataFrame:
    """column_name and data_type of every column, as rows."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, data_type string")


def query(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """SQL over frames that the text names in braces; nothing stays registered in the session."""
    return spark.sql(sql, **frames)


def site_labels(sites: DataFrame, name: str) -> DataFrame:
    """Anonymous labels (Site A to Z, AA to ZZ) in the order of the names; names with a leading underscore are no sites."""
    from pyspark.sql import Window

    letters = lambda i: F.concat(F.when(i >= 26, F.char(F.floor(i / 26) + 64)).otherwise(""), F.char(F.pmod(i, F.lit(26)) + 65))
    named = sites.where(F.col(name).isNotNull() & ~F.col(name).startswith("_")).select(name).distinct()
    return named.withColumn("label", F.concat(F.lit("Site "), letters(F.row_number().over(Window.orderBy(name)) - 1)))
