"""Sequential folds over each key's rows in order, in bounded memory: rows are dealt by key, sorted (with spill) and read as a
stream, so that only the fold's state is held. A fold is sequential by nature: one key is one task's work."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: One row's step: (state or None, row) to (new state, output rows). At a key's end: (state) to output rows.
Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]
End = Callable[[Any], list[tuple]]


def ordered_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, end: End, schema: str | T.StructType, *, at_once: int = 5000) -> DataFrame:
    """The outputs of the fold over rows, whose first columns are the keys; a row reaches step as a tuple."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, n = [f.name for f in schema], len(keys)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], arrow.field(k).type) for k in range(len(names))], names=names)
            out.clear()
            return got

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:n] != now:
                    if now is not None:
                        out += end(state)
                    now, state = row[:n], None
                state, more = step(state, row)
                out += more
                if len(out) >= at_once:
                    yield batch()
        if now is not None:
            out += end(state)
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)
