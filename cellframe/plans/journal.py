"""Logs that only grow, of which a reader of the latest state reads a bounded number of files."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class Journal:
    """Entries of one ``schema`` under ``root``, in blocks of ``per_block`` writes.

    Every block but the first begins with what ``state`` keeps of the block before, so the last block says all that
    later entries need. It is found by asking for about 2 * log2(blocks) folders, never by listing all of them. A new
    block comes into being with the write that begins it, so a reader sees the old state or the new one. One writer at
    a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, state: Callable[[DataFrame], DataFrame], per_block: int = 64) -> None:
        self.spark = spark
        self.root = root
        self.schema = schema
        self.state = state
        self.per_block = per_block

    def recent(self) -> DataFrame:
        """The entries of the last block: what was kept of all earlier ones, and what came since."""
        return self._read(self._path(max(0, self._blocks() - 1)))

    def all(self) -> DataFrame:
        """Every entry, kept ones once."""
        return self._read(self.root).distinct()

    def append(self, rows: DataFrame) -> None:
        """Add the entries of one write, which is one file."""
        last, rows = self._blocks() - 1, rows.coalesce(1)
        if last < 0:
            rows.write.json(self._path(0))
        elif self._writes(last) < self.per_block:
            rows.write.mode("append").json(self._path(last))
        else:
            whole = self.state(self._read(self._path(last))).select(*self.schema.names).unionByName(rows.select(*self.schema.names))
            # one file, since a block without all of its state would be taken for whole
            whole.coalesce(1).write.mode("overwrite").json(self._path(last + 1))

    def _path(self, block: int) -> str:
        return os.path.join(self.root, f"block={block}")

    def _read(self, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).json(path).select(*self.schema.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def _blocks(self) -> int:
        """Number of blocks that have been written whole."""
        high = 1
        while self._exists(high - 1):
            high *= 2
        low = high // 2  # block low - 1 is there (or low is 0), block high - 1 is not
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._exists(middle - 1) else (low, middle)
        return low

    def _exists(self, block: int) -> bool:
        return self._hadoop(block, lambda files, path: files.exists(path) and any(s.getPath().getName().startswith("part-") for s in files.listStatus(path)))

    def _writes(self, block: int) -> int:
        return self._hadoop(block, lambda files, path: sum(s.getPath().getName().startswith("part-") for s in files.listStatus(path)))

    def _hadoop(self, block: int, ask: Callable):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(block))
        return ask(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path)


def newest(column: str, *per: str) -> Callable[[DataFrame], DataFrame]:
    """A state of the entry with the greatest ``column``, and with ``per`` also that of each of these columns' values."""

    def state(entries: DataFrame) -> DataFrame:
        row = F.struct(*entries.columns)
        kept = entries.agg(F.max_by(row, column).alias("e"))
        if per:
            kept = kept.union(entries.groupBy(*per).agg(F.max_by(row, column).alias("e")).select("e"))
        return kept.select("e.*").distinct()

    return state
