"""Catalog statements over delimited tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def create_table(spark: SparkSession, name: str, ddl: str, location: str, sep: str = ",") -> None:
    """Drop and create a delimited text table in a folder of the shared file system."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING csv OPTIONS (sep '{sep}') LOCATION '{location}'")


def load_file(spark: SparkSession, name: str, path: str, sep: str = ",") -> None:
    """Append the rows of a delimited file to a table."""
    spark.read.schema(spark.table(name).schema).csv(path, sep=sep).write.insertInto(name)


def show_tables(spark: SparkSession, like: str) -> DataFrame:
    """Names of tables like a pattern."""
    return spark.sql(f"SHOW TABLES LIKE '{like}'").select("tableName")


def describe(spark: SparkSession, name: str) -> DataFrame:
    """Column names and types of a table."""
    return spark.sql(f"DESCRIBE {name}").select("col_name", "data_type")


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as a table."""
    from pyspark.sql import functions as F

    return df.agg(F.count("*").alias("n"))
