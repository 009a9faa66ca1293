"""Paged tracker exports as a Spark data source that takes a search's conditions.

An export is a folder of JSON pages as a tracker's search gives them, each {"start_at", "total", "issues": [{"key", "fields"}]}, and a table
of the pages with the range of every field in them. The source lists that table, drops the pages that no issue of a search can be in,
deals the others to tasks by runs of pages, and reads each page once, keeping the issues that meet the pushed conditions.

Pages are opened with pyarrow's file systems, so an export may lie in any store these reach.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.cdc import ranked

#: Types whose ranges are kept for a page.
ORDERED = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.DateType, T.DecimalType, T.TimestampNTZType)


def export_pages(rows: DataFrame, path: str, key: str, page: int = 1000) -> None:
    """Write rows as an export of pages of `page` issues in order of their key (unique), one file a page, under path.

    No task sees more than a part of the order; a page is collected from its own rows alone.
    """
    fields = [c for c in rows.columns if c != key]
    total = rows.count()
    placed = ranked(rows, key, "nth").withColumn("page", F.floor((F.col("nth") - 1) / page))
    kept = [f for f in rows.schema.fields if isinstance(f.dataType, ORDERED)]
    ranges = [g(f.name).alias(f"{n}_{f.name}") for f in kept for n, g in (("min", F.min), ("max", F.max))] + [F.count(f.name).alias(f"count_{f.name}") for f in kept]
    issue = F.struct("nth", F.col(key).cast("string").alias("key"), F.struct(*fields).alias("fields"))
    pages = placed.groupBy("page").agg(F.sort_array(F.collect_list(issue)).alias("issues"), F.count(F.lit(1)).alias("rows"), *ranges)
    body = F.to_json(F.struct((F.col("page") * page).alias("start_at"), F.lit(total).alias("total"), F.transform("issues", lambda i: F.struct(i["key"].alias("key"), i["fields"].alias("fields"))).alias("issues")))
    pages.select(body.alias("value"), "page").write.partitionBy("page").text(f"{path}/pages")
    spark = rows.sparkSession
    files = spark.read.text(f"{path}/pages").select("page", F.input_file_name().alias("file"))
    pages.drop("issues").join(files.withColumn("page", F.col("page").cast("long")), "page").orderBy("page").coalesce(1).write.parquet(f"{path}/index")  # a row a page


def _value(kind: pa.DataType) -> Callable[[Any], Any]:
    """What turns a JSON value into one of the Arrow type."""
    if pa.types.is_decimal(kind):
        return lambda v: None if v is None else Decimal(str(v)).quantize(Decimal(1).scaleb(-kind.scale))
    if pa.types.is_date(kind):
        return lambda v: None if v is None else date.fromisoformat(v[:10])
    if pa.types.is_timestamp(kind):
        return lambda v: None if v is None else datetime.fromisoformat(v)
    if pa.types.is_floating(kind):
        return lambda v: None if v is None else float(v)
    return lambda v: v


def may_hold(test: ds.Filter, low: Any, high: Any, count: int, rows: int) -> bool:
    """Whether a page whose field spans low to high, in `count` of its `rows`, may hold an issue that passes."""
    if isinstance(test, ds.IsNull):
        return count < rows
    if count == 0:
        return False
    if isinstance(test, ds.IsNotNull):
        return True
    if isinstance(test, ds.In):
        return any(v is not None and low <= v <= high for v in test.value)
    if isinstance(test, ds.EqualTo):
        return low <= test.value <= high
    if isinstance(test, (ds.GreaterThan, ds.GreaterThanOrEqual)):
        return high > test.value or (isinstance(test, ds.GreaterThanOrEqual) and high == test.value)
    if isinstance(test, (ds.LessThan, ds.LessThanOrEqual)):
        return low < test.value or (isinstance(test, ds.LessThanOrEqual) and low == test.value)
    if isinstance(test, ds.StringStartsWith):
        return high >= test.value and low[: len(test.value)] <= test.value
    return True


def passes(test: ds.Filter, column: pa.Array) -> pa.Array:
    """Which values pass; null where the answer is unknown."""
    if isinstance(test, ds.IsNull):
        return pc.is_null(column)
    if isinstance(test, ds.IsNotNull):
        return pc.is_valid(column)
    if isinstance(test, ds.In):
        return pc.and_(pc.is_valid(column), pc.is_in(column, value_set=pa.array([v for v in test.value if v is not None], column.type)))
    if isinstance(test, ds.StringContains):
        return pc.match_substring(column, test.value)
    if isinstance(test, ds.StringStartsWith):
        return pc.starts_with(column, test.value)
    compare = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}
    return compare[type(test)](column, pa.scalar(test.value, column.type))


PUSHED = (ds.IsNull, ds.IsNotNull, ds.In, ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringContains, ds.StringStartsWith)


@dataclass
class PageRun(ds.InputPartition):
    """A task's pages."""

    files: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(self.files[0] if self.files else None)


class TrackerReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, key: str, pages_a_task: int) -> None:
        self.schema, self.path, self.key, self.pages_a_task = schema, path.rstrip("/"), key, pages_a_task
        self.tests: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802
        """Conditions on one field by value are taken; others stay with Spark."""
        ordered = {f.name for f in self.schema.fields if isinstance(f.dataType, ORDERED)}
        for f in filters:
            if isinstance(f, PUSHED) and len(f.attribute) == 1 and f.attribute[0] in ordered:
                self.tests.append(f)
            else:
                yield f

    def pages(self) -> list[str]:
        """The files of the pages that an issue of the search may be in, in order."""
        fs, root = pyarrow.fs.FileSystem.from_uri(f"{self.path}/index")
        index = pq.read_table(root, filesystem=fs).sort_by("page")
        keep = [
            all(may_hold(t, r[f"min_{n}"], r[f"max_{n}"], r[f"count_{n}"], r["rows"]) for t in self.tests if f"count_{(n := t.attribute[0])}" in r)
            for r in index.drop_columns(["file"]).to_pylist()
        ]
        return [f for f, k in zip(index["file"].to_pylist(), keep) if k]

    def partitions(self) -> list[PageRun]:
        found = self.pages()
        return [PageRun(found[k : k + self.pages_a_task]) for k in range(0, len(found), self.pages_a_task)] or [PageRun([])]

    def read(self, partition: PageRun) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        makers = [(f.name, f.type, _value(f.type)) for f in schema]
        for file in partition.files:
            fs, name = pyarrow.fs.FileSystem.from_uri(file)
            with fs.open_input_stream(name) as stream:
                issues = json.loads(stream.read(), parse_float=Decimal)["issues"]
            columns = []
            for name, kind, make in makers:
                raw = [i["key"] if name == self.key else i["fields"].get(name) for i in issues]
                columns.append(pa.array([make(int(v) if name == self.key and pa.types.is_integer(kind) else v) for v in raw], kind))
            batch = pa.RecordBatch.from_arrays(columns, schema=schema)
            for t in self.tests:
                batch = batch.filter(passes(t, batch.column(t.attribute[0])))
            if batch.num_rows:
                yield batch


class TrackerSource(ds.DataSource):
    """spark.read.format("tracker").schema(...).option("key", ...).load(path); option pages_a_task, 16 where it is not given."""

    @classmethod
    def name(cls) -> str:
        return "tracker"

    def reader(self, schema: T.StructType) -> TrackerReader:
        return TrackerReader(schema, self.options["path"], self.options["key"], int(self.options.get("pages_a_task", 16)))


def search(spark: SparkSession, path: str, schema: str | T.StructType, key: str, condition: Column | None = None) -> DataFrame:
    """The issues of an export that meet a condition; its parts on single fields reach the reader.

    Spark keeps what was pushed with the relation, not with the plan, so one relation under two conditions would read the pages of
    either for both. Therefore each search has a relation of its own, always a condition (a key is never null), and is
    closed by a projection that later conditions don't pass. Turns the session's filter pushdown to Python sources on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrackerSource)
    found = spark.read.format("tracker").schema(schema).option("key", key).load(path)
    found = found.where(F.col(key).isNotNull() if condition is None else F.col(key).isNotNull() & condition)
    return found.select(F.inline(F.array(F.struct(*found.columns))))
