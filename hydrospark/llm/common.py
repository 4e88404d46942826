"""Helpers shared by the text operators: slices of Arrow batches, table access, size-checked broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from hydrospark.session import cut, shared_dir

__all__ = ["bounded_broadcast", "cut", "free_name", "map_slices", "read_table", "shared_dir"]

#: Bytes of text handled at once inside a task; a single longer text is a slice of its own.
SLICE_BYTES = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows holding at most ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def map_slices(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str,
               keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to bounded slices of ``df``; it returns the new columns by name.

    ``keep`` names the input columns passed through untouched, before the new ones.
    """
    kept = df.columns if keep is None else keep
    keep_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    ddl = ", ".join(x for x in (keep_ddl, schema) if x)
    empty = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type
    fields = [(f.name, to_arrow_type(f.dataType)) for f in empty]

    def run(batches):
        for part in slices(batches, text, limit):
            new = fn(part)
            arrays = [part.column(c) for c in kept]
            arrays += [new[name] if isinstance(new[name], pa.Array) else pa.array(new[name], type=kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(name for name, _ in fields)])

    return df.mapInArrow(run, ddl)


def bounded_broadcast(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Hint a broadcast for a written table whose row count proves it small; otherwise leave it to the optimiser.

    ``df`` must be the result of ``cut`` or a file scan, so that counting reads only footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base
