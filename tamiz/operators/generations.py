"""Tables kept as generations under one folder: a commit writes only its own rows, and the last manifest names the generations
that count. A reader sees whole commits only; a commit that failed half-way leaves folders that no manifest names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _where(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> str | None:
        where, fs = self._where("manifest")
        if not fs.exists(where):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return max((n for n in names if n.isdigit()), default=None)

    def live(self) -> list[int]:
        """Numbers of the generations that count, oldest first."""
        last = self._last()
        if last is None:
            return []
        where, fs = self._where("manifest", last)
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def next(self) -> int:
        return int(self._last() or 0) + 1

    def write(self, number: int, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}/gen={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(self, name: str, numbers: list[int], ddl: str | None = None) -> DataFrame | None:
        """Rows of one table with their generation in ``gen``; None where no generation has it. Without ``ddl`` the
        generations' columns are merged."""
        paths = []
        for n in numbers:
            where, fs = self._where(name, f"gen={n}")
            if fs.exists(where):
                paths.append(where.toString())
        if not paths:
            return None
        reader = self.spark.read.option("basePath", f"{self.path}/{name}")
        reader = reader.schema(f"{ddl}, gen INT") if ddl else reader.option("mergeSchema", len(paths) > 1)
        return reader.parquet(*paths)

    def commit(self, number: int, numbers: list[int]) -> None:
        """Publish ``numbers`` as manifest ``number``; of two writers with one number the second fails."""
        draft, fs = self._where("manifest", f".draft{number}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(numbers).encode()))
        stream.close()
        final, _ = self._where("manifest", f"{number:09d}")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{self.path}: another writer has published {number}")


def newest(rows: DataFrame, newer: DataFrame | None, key: str) -> DataFrame:
    """``rows`` (with ``gen``) without those that ``newer`` (``key``, ``gen``) names in a later generation."""
    if newer is None:
        return rows
    last = newer.groupBy(F.col(key).alias("__key")).agg(F.max("gen").alias("__gen"))
    return rows.join(last, (F.col(key) == F.col("__key")) & (F.col("gen") < F.col("__gen")), "left_anti")
