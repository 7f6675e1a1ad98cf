"""Arrow IPC files as a Spark data source: tasks of a few record batches, only the columns asked for, and filters
applied as batches are read."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Record batches of a task.
BATCHES = 8


def _open(uri: str, fields: list[int] | None = None):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(store.open_input_file(path), options=pa.ipc.IpcReadOptions(included_fields=fields))


@dataclass
class Batches(InputPartition):
    uri: str
    first: int
    end: int


def condition(f: Filter, schema: pa.Schema) -> pc.Expression | None:
    """What a filter says of a batch; None for filters that are left to Spark: of parts of columns, and comparisons of
    fractions, whose order of not-a-number is Spark's own."""
    if len(f.attribute) != 1 or f.attribute[0] not in schema.names:
        return None
    column = pc.field(f.attribute[0])
    if isinstance(f, IsNull):
        return column.is_null()
    if isinstance(f, IsNotNull):
        return column.is_valid()
    kind = schema.field(f.attribute[0]).type
    if not (pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_boolean(kind) or pa.types.is_date(kind)):
        return None
    if isinstance(f, EqualNullSafe):
        return column.is_null() if f.value is None else column.is_valid() & (column == f.value)
    if isinstance(f, In):
        return column.isin([v for v in f.value if v is not None])
    if isinstance(f, (StringContains, StringStartsWith, StringEndsWith)):
        by = {StringContains: pc.match_substring, StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with}[type(f)]
        return by(column, f.value)
    made = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}.get(type(f))
    return getattr(column, made)(pa.scalar(f.value)) if made else None


class ArrowReader(DataSourceReader):
    def __init__(self, uris: Sequence[str], columns: Sequence[str], batches: int):
        self.uris, self.columns, self.batches, self.filters = list(uris), list(columns), batches, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        schema = _open(self.uris[0]).schema if self.uris else pa.schema([])
        for f in filters:
            if condition(f, schema) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for uri in self.uris:
            n = _open(uri).num_record_batches
            out += [Batches(uri, i, min(i + self.batches, n)) for i in range(0, n, self.batches)]
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        whole = _open(partition.uri).schema
        needed = {*self.columns, *(f.attribute[0] for f in self.filters)}
        reader = _open(partition.uri, [i for i, n in enumerate(whole.names) if n in needed])
        keep = None
        for f in self.filters:
            said = condition(f, whole)
            keep = said if keep is None else keep & said
        for i in range(partition.first, partition.end):
            t = pa.Table.from_batches([reader.get_batch(i)])
            t = t.filter(keep) if keep is not None else t
            yield from t.select(self.columns).to_batches()


class ArrowFiles(DataSource):
    """Format arrow_ipc; options: uris (JSON list), columns (JSON list; all of the first file if absent), batches (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _uris(self) -> list[str]:
        return json.loads(self.options["uris"])

    def schema(self) -> StructType:
        found = from_arrow_schema(_open(self._uris()[0]).schema)
        columns = json.loads(self.options["columns"]) if "columns" in self.options else found.names
        if lack := [c for c in columns if c not in found.names]:
            raise ValueError(f"columns lack: {', '.join(lack)}")
        return StructType([found[c] for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self._uris(), schema.names, int(self.options.get("batches", BATCHES)))


def arrow_scan(spark: SparkSession, uris: Sequence[str], columns: Sequence[str] | None = None, batches: int = BATCHES) -> DataFrame:
    """The rows of Arrow IPC files in a store that pyarrow reaches. Only the columns named are read, and those that filters
    name; filters on them are applied batch by batch before rows reach Spark."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_ipc").option("uris", json.dumps(list(uris))).option("batches", batches)
    return (reader.option("columns", json.dumps(list(columns))) if columns else reader).load()
