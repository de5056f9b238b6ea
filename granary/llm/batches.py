"""Small helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Run a function over column lists, batch by batch.

    ``make`` is called once per task and gives the function from input lists to output lists, so that what is
    costly to set up is set up once.  The output lists may differ from the input in length.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in pieces(batch):
                out = function(part.to_pydict())
                made = [pa.array(out.pop(field.name), type=field.type) for field in arrow]
                del out, part  # Python lists do not wait while Spark takes the rows
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return df.mapInArrow(run, schema)


PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about 2 MB, so that texts do not pile up as Python objects."""
    rows = max(1, min(batch.num_rows, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes))))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


ARROW_TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema given as ``name type, name type``."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in fields])


def crc_fold(column: str, parts: int) -> Column:
    """Remainder of the CRC-32 of a column's text, which deals rows to folds; null gives null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def read(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
