"""Streams dealt out by a key: each key's events, in order, go to one function call on the executors, which decides them one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a result that are sent back at a time.
BATCH = 10_000


def by_key(rows: DataFrame, key: str, order: str, work: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]], schema: str) -> DataFrame:
    """The tuples that a function gives for each key's rows, which it gets as an iterator, in order.

    ``work()`` is called once for each task and gives the function. A task holds a batch of rows and what the function keeps of one key, whatever the number of
    keys. Null is a key of its own. One key's rows are one task's work, as its events are one stream.
    """
    fields = T._parse_datatype_string(schema)
    at = rows.columns.index(key)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, each, out = to_arrow_schema(fields), work(), []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        flat = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for _, group in groupby(flat, key=lambda r: r[at]):
            for row in each(group):
                out.append(row)
                if len(out) >= BATCH:
                    yield packed()
                    out.clear()
        yield packed()

    # By a hash of the key: Spark leaves a repartition by the key itself out behind a join on it, and then reads the join's input in parts that break keys up
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, order).mapInArrow(run, fields)
