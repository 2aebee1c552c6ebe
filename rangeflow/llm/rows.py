"""Adds columns that are computed from whole texts, keeping every row and column where it is (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prefix of added columns, so that they never clash with a table's own.
OWN = "_rangeflow_"


def with_text_columns(docs: DataFrame, fields: str, compute: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], inputs: list) -> DataFrame:
    """``docs`` with the columns of ``fields`` (names get the prefix ``OWN``).

    ``compute`` gets the batches of ``inputs`` (names of columns, which are sent once, or expressions) and yields, for each, arrays of as many rows.
    """
    added = [f.strip() for f in fields.split(";")]
    names = [OWN + f.split(" ")[0] for f in added]
    kept = docs.columns
    made = [c for c in inputs if not isinstance(c, str)]
    beyond = iter(range(len(kept), len(kept) + len(made)))
    at = [kept.index(c) if isinstance(c, str) else next(beyond) for c in inputs]
    fed = docs.select(*kept, *[c.alias(f"{OWN}in{k}") for k, c in enumerate(made)])
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"{OWN}{f}" for f in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def feed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                passed.append(batch)
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in at], names=[str(k) for k in range(len(at))])

        for arrays in compute(feed()):
            batch = passed.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, *names])

    return fed.mapInArrow(run, schema)


def own(name: str):
    return F.col(OWN + name)
