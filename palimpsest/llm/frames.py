"""Shared DataFrame plumbing: tables, lineage cuts and row-wise Arrow maps over text."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text handed to numpy at once. One document is never cut, so a longer one is a piece of its own.
PIECE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one that the context has.

    Only a local master, whose executors are the driver, gets a temporary folder where neither is set; on a cluster that
    would be lost with a machine, so it is an error there.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared checkpoint folder, so that a lost executor costs a reread only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Most keys that are sent to all executors rather than shuffled with what they are joined to: some 10 MB.
BROADCAST_KEYS = 500_000


def counted(keys: DataFrame) -> DataFrame:
    """keys (stored, so that counting is cheap), to be broadcast in a join if they are BROADCAST_KEYS at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of a key in one partition, for maps over partitions, which ask the planner for no distribution.

    repartition(*keys) doesn't promise that: over a join on the same keys the planner takes the join's partitioning for
    it and drops the exchange, and may then read that join locally or split its skew. By a hash of the keys it is kept.
    """
    return df.repartition(F.xxhash64(*keys))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, without making Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return at - at[0], np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0]))


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def column_array(values, kind: T.DataType) -> pa.Array:
    arrow = to_arrow_schema(T.StructType([T.StructField("x", kind)])).field(0).type
    return values.cast(arrow) if isinstance(values, pa.Array) else pa.array(values, type=arrow)


def map_text(
    df: DataFrame,
    text_col: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., dict]],
    keep: Sequence[str] | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """df's columns `keep` (default: all) and `fields` computed from the text of each row.

    make() runs once in each worker and returns f(offsets, bytes, *columns of `also`) -> {field name: one value a row}.
    An input column with the name of a computed field is replaced. Rows are neither moved nor reordered: no shuffle.
    """
    made = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in kept] + list(fields))
    source = "text of the map"  # a name of its own, as the text column may be kept, too
    df = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text_col}`"].cast("string").alias(source), *[df[f"`{c}`"].alias(f"{source} {k}") for k, c in enumerate(also)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        arrow = to_arrow_schema(schema)
        for batch in batches:
            work = work or make()
            offsets, data = utf8(batch.column(len(kept)))
            for i, j in pieces(offsets):
                at = offsets[i : j + 1]
                got = work(at - at[0], data[at[0] : at[-1]], *[batch.column(len(kept) + 1 + k).slice(i, j - i) for k in range(len(also))])
                columns = [batch.column(k).slice(i, j - i) for k in range(len(kept))]
                columns = [c if c.type == arrow.field(k).type else c.cast(arrow.field(k).type) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(columns + [column_array(got[f.name], f.dataType) for f in fields], schema=arrow)

    return df.mapInArrow(run, schema)
