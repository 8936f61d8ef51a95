"""A table of Parquet files whose versions are lists of folders: writes are staged, and a new list makes them count.

`data/` holds folders that are never changed, `versions/N/` the list of version N: which folder holds which partition, and which loads are
done. A list counts once Spark has marked it as complete, so a write that fails leaves the version before it; two writers of
one version collide on the folder of the list, and the second fails. Rows meet only rows of their own partition: a merge reads and
writes the partitions that its keys touch, the others stay in their folders.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "__part"
_LIST = "part int, folder string, load string"


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    parts: int = 16

    # Versions

    def version(self) -> int:
        """The newest complete version; 0 is the empty table."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/versions")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return max((int(n) for n in names if n.isdigit() and fs.exists(hadoop.Path(f"{self.path}/versions/{n}/_SUCCESS"))), default=0)

    def entries(self, version: int | None = None) -> list:
        """The list of a version: partitions with their folders, and loads. As many rows as there are partitions and loads."""
        v = self.version() if version is None else version
        return self.spark.read.schema(_LIST).parquet(f"{self.path}/versions/{v}").collect() if v else []

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its partitions: other folders are not listed."""
        folders = [f"{self.path}/data/{e.folder}/{PART}={e.part}" for e in self.entries(version) if e.folder and (only is None or e.part in only)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def loads(self, version: int | None = None) -> set[str]:
        return {e.load for e in self.entries(version) if e.load}

    # Writes

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _stage(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows to a new folder; the partitions that it has."""
        folder = uuid.uuid4().hex
        kinds = self.spark.createDataFrame([], self.schema).schema
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in kinds))  # sums of decimals are wider than the table's
        rows.withColumn(PART, self.part_of()).repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/data/{folder}")
        if self._no_files(folder):
            return folder, []
        have = self.spark.read.parquet(f"{self.path}/data/{folder}").select(PART).distinct().collect()
        return folder, sorted(r[0] for r in have)

    def _no_files(self, folder: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/data/{folder}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return not any(s.getPath().getName().startswith(PART) for s in fs.listStatus(root))

    def _commit(self, base: int, folder: str, staged: list[int], replaced: list[int], load: str | None) -> int:
        """Makes version base + 1: folders of untouched partitions as they were, staged ones anew, and the load as done."""
        old = self.entries(base)
        rows = [(e.part, e.folder, None) for e in old if e.folder and e.part not in replaced] + [(p, folder, None) for p in staged] + [(None, None, e.load) for e in old if e.load]
        rows += [(None, None, load)] if load else []
        rows = rows or [(None, None, None)]
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/{base + 1}")
        return base + 1

    def merge(self, rows: DataFrame, load: str | None = None, how: dict[str, str] | None = None, delete: Column | None = None) -> int:
        """Rows by key: new ones take the place of stored ones. The version after it.

        load: a name under which the merge is noted in the same list; a load that is there already does nothing. how: columns that are not
        replaced but `sum`med or kept at their `max` or `min`. delete: a condition on the new rows under which a key goes. Of new rows that share a key the
        greatest stays. Null keys are equal to each other.
        """
        base = self.version()
        if load is not None and load in self.loads(base):
            return base
        new = rows.select(*(F.col(c) for c in self._columns()), (delete if delete is not None else F.lit(False)).alias("__delete")).withColumn(PART, self.part_of())
        touched = sorted(r[0] for r in new.select(PART).distinct().collect())
        values = [c for c in self._columns() if c not in self.keys]
        new = new.groupBy(*self.keys).agg(F.max(F.struct("__delete", *values)).alias("n"))
        old = self.read(base, touched)
        on = [F.col(f"o.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.keys]
        both = old.withColumn("__have", F.lit(True)).alias("o").join(new.alias("w"), on, "full").filter("not coalesce(w.n.__delete, false)")
        there, come = F.col("o.__have").isNotNull(), F.col("w.n").isNotNull()
        out = [F.when(there, F.col(f"o.{k}")).otherwise(F.col(f"w.{k}")).alias(k) for k in self.keys]
        fold = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
        for c in values:
            value = F.when(come, F.col(f"w.n.{c}")).otherwise(F.col(f"o.{c}"))
            if how and c in how:
                both_there = F.col(f"o.{c}").isNotNull() & F.col(f"w.n.{c}").isNotNull()
                value = F.when(both_there, fold[how[c]](F.col(f"o.{c}"), F.col(f"w.n.{c}"))).otherwise(F.coalesce(f"w.n.{c}", f"o.{c}"))
            out.append(value.alias(c))
        folder, staged = self._stage(both.select(*out))
        return self._commit(base, folder, staged, touched, load)

    def delete(self, condition: Column, load: str | None = None) -> int:
        """The rows that meet the condition go; partitions without such rows stay as they are."""
        base = self.version()
        if load is not None and load in self.loads(base):
            return base
        hit = self.read(base).filter(condition).select(self.part_of().alias(PART)).distinct()
        touched = sorted(r[0] for r in hit.collect())
        if not touched:
            return base if load is None else self._commit(base, "", [], [], load)
        folder, staged = self._stage(self.read(base, touched).filter(~F.coalesce(condition, F.lit(False))))
        return self._commit(base, folder, staged, touched, load)

    def patch(self, values: dict[str, Column], condition: Column) -> int:
        """Columns of the rows that meet the condition get new values; other partitions stay as they are."""
        base = self.version()
        touched = sorted(r[0] for r in self.read(base).filter(condition).select(self.part_of().alias(PART)).distinct().collect())
        if not touched:
            return base
        hit = F.coalesce(condition, F.lit(False))
        rows = self.read(base, touched).withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
        folder, staged = self._stage(rows)
        return self._commit(base, folder, staged, touched, None)

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def sink(self, how: dict[str, str] | None = None):
        """For foreachBatch: a batch is a load by its number, so a batch that is given again changes nothing."""
        return lambda batch, number: self.merge(batch, load=f"batch-{number}", how=how)
