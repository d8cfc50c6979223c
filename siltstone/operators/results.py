"""Results of queries that are kept: pages back and forth, row windows, aliases, resuming.

A result is written once, ordered and numbered, so every page is a range of row numbers and a later session
can go on where an earlier one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.lang.jexl import QueryError
from siltstone.operators.cachedsql import cached_query
from siltstone.storage import SnapshotStore, delete, fresh_path, stage

ROW = "_row"


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_row``, from 1: a range sort, then each partition's rows behind those of the partitions before."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()), "rows")
    counts = placed.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    offset = counts.select("_p", before.alias("_before"))
    own = F.col("_k") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    return placed.join(F.broadcast(offset), "_p").withColumn(ROW, F.col("_before") + own + 1).drop("_p", "_k", "_before")


class CachedResult:
    """A kept result under an alias."""

    def __init__(self, spark: SparkSession, path: str | None = None, page_size: int = 100):
        self.spark, self.page_size = spark, page_size
        self.store = SnapshotStore(spark, path or fresh_path(spark, "result"))
        self.alias = self.store.manifest["meta"].get("alias")
        self.position = self.store.manifest["meta"].get("position", 0)

    def load(self, df: DataFrame, order: list[str], alias: str | None = None) -> CachedResult:
        folder = self.store.next_dir("rows")
        number_rows(df, order).write.parquet(folder)
        rows = self.spark.read.parquet(folder)
        self.alias, self.position = alias, 0
        self.store.commit({"rows": {"all": {"dir": folder}}}, {"alias": alias, "position": 0, "schema": rows.schema.json()})
        return self

    @property
    def rows(self) -> DataFrame:
        parts = self.store.parts("rows")
        if not parts:
            raise QueryError("nothing is loaded")
        return self.spark.read.parquet(parts["all"]["dir"])

    def describe(self) -> dict:
        return {"alias": self.alias, "columns": [c for c in self.rows.columns if c != ROW], "rows": self.rows.count(), "position": self.position}

    def set_alias(self, alias: str) -> None:
        self.alias = alias
        self._keep()

    def get_rows(self, first: int, last: int) -> DataFrame:
        """Rows first to last, counted from 1."""
        return self.rows.where(F.col(ROW).between(first, last)).orderBy(ROW).drop(ROW)

    def next(self) -> list:
        """The next page; an empty one behind the last."""
        page = self.get_rows(self.position + 1, self.position + self.page_size).collect()
        if page:
            self.position += self.page_size
            self._keep()
        return page

    def previous(self) -> list:
        """The page before the one that was read last."""
        self.position = max(0, self.position - 2 * self.page_size)
        return self.next()

    def reset(self) -> None:
        self.position = 0
        self._keep()

    def close(self) -> None:
        delete(self.spark, self.store.path)

    def query(self, fields: str = "*", where: str = "", group_by: str = "", order_by: str = "") -> DataFrame:
        """The restricted SQL over the rows, in their order unless another is given."""
        return cached_query(self.rows.drop(ROW), fields, where, group_by, order_by)

    def stream(self) -> Iterator:
        """All rows one by one, without holding them all."""
        return self.rows.orderBy(ROW).drop(ROW).toLocalIterator()

    def _keep(self) -> None:
        self.store.commit({}, {"alias": self.alias, "position": self.position})


class QueryModels:
    """Named mappings from a query's field names to those of the data."""

    def __init__(self) -> None:
        self.models: dict[str, dict[str, list[str]]] = {}

    def names(self) -> list[str]:
        return sorted(self.models)

    def import_model(self, name: str, mapping: dict[str, list[str]]) -> None:
        if name in self.models:
            raise QueryError(f"the model {name} exists")
        self.models[name] = {k.upper(): [x.upper() for x in v] for k, v in mapping.items()}

    def clone(self, name: str, new: str) -> None:
        self.import_model(new, self.get(name))

    def get(self, name: str) -> dict[str, list[str]]:
        if name not in self.models:
            raise QueryError(f"no model {name}")
        return self.models[name]

    def insert(self, name: str, field: str, target: str) -> None:
        have = self.get(name).setdefault(field.upper(), [])
        if target.upper() not in have:
            have.append(target.upper())

    def delete(self, name: str, field: str | None = None) -> None:
        if field is None:
            self.get(name)
            del self.models[name]
        else:
            self.get(name).pop(field.upper(), None)
