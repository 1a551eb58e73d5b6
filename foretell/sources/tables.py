"""Inputs and outputs: a table is a DataFrame, a registered name, or a path with a known suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Suffix of a path and the reader it stands for.
READERS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json", ".csv": "csv", ".txt": "text"}


def session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active SparkSession")
    return spark


def resolve(table: DataFrame | str) -> DataFrame:
    """The DataFrame of a table: itself, a path such as ``s3://bucket/t.parquet``, or a name in the catalog."""
    if isinstance(table, DataFrame):
        return table
    spark = session()
    for suffix, kind in READERS.items():
        if table.rstrip("/").endswith(suffix):
            reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
            return reader.format(kind).load(table)
    return spark.table(table)


#: Table property that names a table's key columns, separated by commas.
KEY_PROPERTY = "foretell.key"


def key_of(table: str) -> list[str]:
    """The key columns that a saved table's properties name; none for paths, views and tables without the property."""
    spark = session()
    if "/" in table or not spark.catalog.tableExists(table) or spark.catalog.getTable(table).tableType in ("VIEW", "TEMPORARY"):
        return []
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return [c.strip() for c in found.get(KEY_PROPERTY, "").split(",") if c.strip()]


def columns_of(table: DataFrame | str) -> DataFrame:
    """(name, type, kind, is_key, place): a table's columns as the catalog knows them; kind is what encoding makes of the type."""
    from foretell.plans.encode import kind_of

    df = resolve(table)
    keys = key_of(table) if isinstance(table, str) else []
    rows = [(f.name, f.dataType.simpleString(), kind_of(f.dataType), f.name in keys, i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, kind string, is_key boolean, place int")


def save(df: DataFrame, target: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write to a path, or as a catalog table where ``target`` has no slash."""
    writer = df.write.mode(mode).format(kind)
    writer = writer.option("header", True) if kind == "csv" else writer
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target) if "/" in target else writer.saveAsTable(target)
