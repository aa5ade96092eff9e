"""Published table versions on shared storage.

A version is a set of parquet folders plus one small pointer file.  The pointer
is written last, under the next number, by renaming: readers only ever see
complete versions, a crashed writer leaves nothing visible, and two writers
cannot publish the same number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.snapshots import _fs, exists, rename

POINTERS = "_versions"


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _pointer_names(self) -> list[str]:
        folder = f"{self.root}/{POINTERS}"
        if not exists(self.spark, folder):
            return []
        fs, path = _fs(self.spark, folder)
        # One small file per published version; old ones may be deleted.
        return sorted(s.getPath().getName() for s in fs.listStatus(path))

    def current(self) -> dict:
        """The newest pointer: {"version": n, "batch": id, "tables": {name: folder}}."""
        names = self._pointer_names()
        if not names:
            return {"version": 0, "batch": None, "tables": {}}
        text = self.spark.read.text(f"{self.root}/{POINTERS}/{names[-1]}", wholetext=True).first()
        return json.loads(text[0])

    def read(self, name: str) -> DataFrame:
        folder = self.current()["tables"].get(name)
        if folder is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def read_all(self) -> dict[str, DataFrame]:
        tables = self.current()["tables"]
        return {name: self.spark.read.parquet(f"{self.root}/{folder}") for name, folder in tables.items()}

    def publish(
        self,
        tables: dict[str, DataFrame],
        batch: int | None = None,
        layout: dict[str, list[str]] | None = None,
    ) -> bool:
        """Write new versions of ``tables``, keeping the others; False if ``batch`` was published.

        ``layout`` gives clustering columns per table: rows are range-placed
        by them so parquet statistics can prune point and range filters.
        """
        before = self.current()
        if batch is not None and before["batch"] is not None and batch <= before["batch"]:
            return False
        version = before["version"] + 1
        pointer = dict(before["tables"])
        for name, df in tables.items():
            folder = f"{name}/v={version:08d}-{uuid.uuid4().hex[:8]}"
            keys = (layout or {}).get(name)
            placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
            placed.write.parquet(f"{self.root}/{folder}")
            pointer[name] = folder
        done = {"version": version, "batch": batch if batch is not None else before["batch"], "tables": pointer}
        side = f"{self.root}/_writing-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.text(side)
        fs, path = _fs(self.spark, side)
        part = next(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
        rename(self.spark, part, f"{self.root}/{POINTERS}/{version:08d}.json")
        fs.delete(path, True)
        return True


# How the library's own tables are best clustered for its queries.
LAYOUT = {
    "entries": ["feed_id", "published_at"],
    "state": ["user_id", "published_at"],
    "pins": ["user_id"],
    "subscriptions": ["feed_id", "user_id"],
}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table, one aggregation each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables given")
    return out
