"""Connectors to catalogs of tables: a folder of Parquet tables, or a Spark catalog's database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class ParquetCatalog:
    """The tables of one folder as database `prod`. Only schemas and file footers are read, and five rows for a sample."""

    def __init__(self, spark: SparkSession, folder: str, tables=TABLES, database: str = "prod"):
        self.spark, self.folder, self.names, self.database = spark, folder, list(tables), database

    def databases(self) -> list[str]:
        return [self.database]

    def tables(self) -> list[str]:
        return sorted(self.names)

    def frame(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def schema(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.frame(name).schema]

    def count(self, name: str) -> int:
        return self.frame(name).count()

    def sample(self, name: str, rows: int = 5) -> DataFrame:
        """A few rows as JSON, the smallest by the first column that can be ordered, so that they are the same in each run."""
        df = self.frame(name)
        key = next((f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")), None)
        df = (df.orderBy(*[key, *[c for c in df.columns[:3] if c != key]]) if key else df).limit(rows)
        return df.select(F.to_json(F.struct(*df.columns)).alias("row"))

    def snapshot(self) -> DataFrame:
        """database, table_name, columns (name, type) of each table; a row a table, from schemas alone."""
        rows = [(self.database, t, self.schema(t)) for t in self.tables()]
        return self.spark.createDataFrame(rows, "database string, table_name string, columns array<struct<name:string,type:string>>")

    def relationships(self, keys) -> DataFrame:
        """Declared foreign keys (table, column, referenced, referenced_column) between tables that are there."""
        there = set(self.names)
        rows = [k for k in keys if k[0] in there and k[2] in there]
        return self.spark.createDataFrame(rows, "table string, column string, referenced string, referenced_column string")

    def changes(self, since: float) -> list[str]:
        """Tables with files newer than a time in seconds."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for t in self.tables():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{t}.parquet")
            fs = path.getFileSystem(conf)
            if max((s.getModificationTime() for s in [fs.getFileStatus(path), *(fs.listStatus(path))]), default=0) > since * 1000:
                out.append(t)
        return out


class SparkCatalog(ParquetCatalog):
    """A04 over the session's own catalog."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        super().__init__(spark, "", [t.name for t in spark.catalog.listTables(database)], database)

    def databases(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def frame(self, name: str) -> DataFrame:
        return self.spark.table(name if self.database == "default" else f"{self.database}.{name}")
