"""Helpers shared by the operators of this subpackage: Arrow mapping, checkpoints, size checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType

from granary.session import bound_batches, shared_folder

#: Rows, and bytes, of an Arrow batch that Python holds as objects at once.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20
#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 64 << 20


def others(df: DataFrame, taken: Sequence[str]) -> list[str]:
    """The columns of ``df`` but those that an operator writes anew (case does not count, as in Spark)."""
    lower = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in lower]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def append_columns(df: DataFrame, reads: Sequence[str], make: Callable[[], Callable[..., list[list]]], fields: str) -> DataFrame:
    """``df`` with the columns ``fields`` (a DDL string), computed from the columns ``reads``.

    ``make()`` runs once in each Python worker's task and returns a function from lists of values,
    one list a column of ``reads``, to lists of results, one a field. Columns of ``df`` that bear a
    field's name are replaced; all others are carried under places of their own, so any name will do.
    Rows go through in slices, so a task holds a few MB of text.

    A session that has Spark's own bounds of an Arrow batch gets smaller ones (rows and bytes); bounds
    that the session has set stay.
    """
    bound_batches(df)
    added = StructType.fromDDL(fields)
    keep = others(df, added.fieldNames())
    carried = [f"k{i}" for i in range(len(keep))]
    given = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(keep, carried, strict=True)], *[F.col(quoted(c)).alias(f"in{i}") for i, c in enumerate(reads)])
    n_keep, n_in = len(keep), len(reads)
    made = [StructField(f"out{i}", f.dataType, f.nullable) for i, f in enumerate(added.fields)]
    schema = StructType(given.schema.fields[:n_keep] + made)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch):
                ins = [part.column(n_keep + i).to_pylist() for i in range(n_in)]
                outs = fn(*ins)
                arrays = [part.column(i) for i in range(n_keep)] + [pa.array(o, type=k) for o, k in zip(outs, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return given.mapInArrow(run, schema).toDF(*keep, *added.fieldNames())


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(SLICE_ROWS, int(n * most_bytes / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def written(df: DataFrame, **options: object) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives the loss of executors."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> Column:
    """What a row of ``df`` holds in memory, about: its texts and arrays, and 16 bytes a column."""

    def held(value: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
                return F.coalesce(F.aggregate(value, F.lit(16).cast("bigint"), lambda s, x: s + held(x, kind.elementType)), F.lit(16).cast("bigint"))
            return F.coalesce(F.size(value) * 8, F.lit(0)).cast("bigint") + 16
        if isinstance(kind, StructType):
            return sum((held(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
        return F.lit(16).cast("bigint")

    return sum((held(F.col(quoted(f.name)), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))


def small(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, a written table, has at most ``most_rows`` rows of at most ``most_bytes`` bytes together; the bytes are read only if the rows are few."""
    few = df.limit(most_rows + 1).agg(F.count("*")).first()[0] <= most_rows
    return few and (df.agg(F.sum(bytes_of(df))).first()[0] or 0) <= most_bytes
