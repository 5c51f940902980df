"""Access to the input tables of one data directory, with memoised sizes and time blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators.ordered import Blocks, rows_per_block, settled, written

_SIZES: dict[tuple[str, str], int] = {}
_BLOCKS: dict[tuple[str, str, str, int], Blocks] = {}


class Tables:
    """``t.events`` and the like read parquet lazily; ``blocks`` cuts an ordering axis once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count from parquet footers."""
        key = (self.root, name)
        if key not in _SIZES:
            _SIZES[key] = self.read(name).count()
        return _SIZES[key]

    def settled(self, df: DataFrame, name: str, blocks: Blocks) -> DataFrame:
        return settled(df, name, blocks)

    def written_if_large(self, df: DataFrame, name: str, table: str) -> DataFrame:
        """``df`` itself, or written once if its source ``table`` doesn't fit one block: whoever cuts such a frame into
        blocks reads it for the cuts, for their totals and for their rows."""
        return written(df, name) if self.rows(table) > rows_per_block(self.spark) else df

    def blocks(self, df: DataFrame, col: str, table: str, per_row: float = 1.0, tag: str = "", tie: str | None = None) -> Blocks:
        """Blocks of ``df.col``, a frame with at most ``per_row`` rows per row of ``table``.

        ``tag`` names an axis that several queries share, so that it is sampled once. ``tie`` orders equal values.
        """
        spark_rows = rows_per_block(self.spark)
        key = (self.root, table, tag or "", spark_rows)
        if tag and key in _BLOCKS:
            return _BLOCKS[key]
        got = Blocks.fit(df, col, bound=int(self.rows(table) * per_row), tie=tie, python=tag == "ts_us")
        if tag:
            _BLOCKS[key] = got
        return got
