"""Tables as append-only change logs in a folder; the latest line of a key counts.

Every change is a folder of its own, and counts from the moment the table's log
names it: a reader never sees half a change, a lost writer leaves nothing that
counts, and two writers at a time erase nothing of each other (of two changes with
the same number the one with the larger writer id is the later one).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.operators.relational import first_wins, latest

LOG = "change long, writer string, base boolean"


class Table:
    """One keyed table: schema, key columns, and a folder of changes."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: str, key: Sequence[str]):
        self.spark, self.path, self.key = spark, f"{folder.rstrip('/')}/{name}", list(key)
        self.schema = T.StructType.fromDDL(schema)
        self.log_schema = T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_change", T.LongType()), T.StructField("_writer", T.StringType())])

    def _changes(self) -> list:
        """The changes that count, from the last base on."""
        try:
            done = self.spark.read.schema(LOG).json(f"{self.path}/log").orderBy("change", "writer").collect()
        except AnalysisException:
            return []
        first = max((i for i, r in enumerate(done) if r.base), default=0)
        return done[first:]

    def _log(self) -> DataFrame:
        changes = self._changes()
        if not changes:
            return self.spark.createDataFrame([], self.log_schema)
        # A column that older files lack reads as null.
        return self.spark.read.schema(self.log_schema).parquet(*[f"{self.path}/rows/{r.change}-{r.writer}" for r in changes])

    def _write(self, rows: DataFrame, deleted: bool, base: bool = False) -> None:
        number = max((r.change for r in self._changes()), default=0) + 1
        writer = uuid.uuid4().hex
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        out = out.withColumns({"_deleted": F.lit(deleted), "_change": F.lit(number).cast("long"), "_writer": F.lit(writer)})
        out.write.parquet(f"{self.path}/rows/{number}-{writer}")
        self.spark.createDataFrame([(number, writer, base)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def rows(self) -> DataFrame:
        now = latest(self._log(), self.key, ["_change", "_writer"])
        return now.where("not _deleted").select(*self.schema.names)

    def get(self, *key: object) -> DataFrame:
        """The row with this key, or none."""
        return self._only(self.rows(), *key)

    def _only(self, rows: DataFrame, *key: object) -> DataFrame:
        for name, value in zip(self.key, key, strict=True):
            rows = rows.where(F.col(name) == F.lit(value))
        return rows

    def ordered(self, *by: Column) -> DataFrame:
        """All rows in an order, the key last."""
        return self.rows().orderBy(*by, *self.key)

    def insert(self, rows: DataFrame) -> None:
        """Rows with new keys; a key that is there, or comes twice, is an error, and nothing is written."""
        twice = rows.groupBy(*self.key).count().where("count > 1").select(*self.key)
        known = rows.join(self.rows().select(*self.key), self.key, "left_semi").select(*self.key)
        clash = twice.unionByName(known).first()
        if clash is not None:
            raise ValueError(f"duplicate key {clash.asDict()}")
        self._write(rows, False)

    def upsert(self, rows: DataFrame, order: Sequence[str] = ()) -> None:
        """Last wins: the last row of a key by ``order`` (by its values where that is not said) replaces what is there."""
        rest = [c for c in self.schema.names if c not in self.key and c in rows.columns]
        self._write(latest(rows.select(*self.key, *rest, *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]), self.key, [f"_by{i}" for i in range(len(order))]), False)

    def insert_or_ignore(self, rows: DataFrame, order: Sequence[str]) -> None:
        """First wins: keys that are there, and later rows of a key, are left out."""
        self._write(first_wins(self.rows(), rows, self.key, order), False)

    def update(self, rows: DataFrame, revision: str | None = None) -> None:
        """Sets the columns ``rows`` has on the keys that are there, one row a key; ``revision`` goes up by one."""
        new = rows.select(*self.key, *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c not in self.key])
        changed = self.rows().join(new, self.key)
        for c in self.schema.names:
            if c not in self.key and c in rows.columns:
                changed = changed.withColumn(c, F.col(f"_new_{c}"))
        if revision:
            changed = changed.withColumn(revision, F.coalesce(revision, F.lit(0)) + 1)
        self._write(changed, False)

    def delete(self, keys: DataFrame) -> None:
        self._write(keys.select(*self.key).distinct(), True)

    def compact(self) -> None:
        """Writes the rows as they are now; earlier changes are no longer read."""
        self._write(self.rows(), False, base=True)
