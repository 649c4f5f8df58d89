"""Stored artefacts: a folder of Parquet tables and JSON files; what is missing is made again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        system, path = self._file(name)
        return system.exists(path)

    def put(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Store a table, or append to it."""
        df.write.mode(mode).parquet(f"{self.folder}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def table(self, name: str, make) -> DataFrame:
        """The stored table, or what ``make()`` returns, stored first."""
        return self.get(name) if self.has(f"{name}/_SUCCESS") else self.put(name, make())

    def put_json(self, name: str, value) -> None:
        system, path = self._file(f"{name}.json")
        out = system.create(path, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def get_json(self, name: str):
        rows = self.spark.read.text(f"{self.folder}/{name}.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def json(self, name: str, make):
        if not self.has(f"{name}.json"):
            self.put_json(name, make())
        return self.get_json(name)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8", compression=compression or "none")


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
