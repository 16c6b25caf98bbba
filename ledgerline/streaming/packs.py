"""Rows of a key in packs, for a stateful processor to take up and hand on as columns.

A processor gets its rows, and hands on its own, one by one as Python objects, and Spark holds all that it hands on for a key
at once. A pack holds many rows of a key as one value in Arrow's format, so that a key's rows of a micro-batch take what
their columns take.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row

from ..operators.replay import key_runs

#: Rows that a task holds before it packs them, and those of a pack that a processor hands on.
HELD = 131_072
PACK = "pack binary"


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def packed(rows: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """rows in packs (keys, pack), several for each key; with `time`, a column of whole numbers, also its largest in a pack."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    def dealt(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        table = table.sort_by([(c, "ascending") for c in keys]).combine_chunks()
        runs = key_runs(table, keys)
        own = table.select([c for c in table.column_names if c not in keys])
        firsts = table.select(keys).take([a for a, _, _ in runs]).combine_chunks()
        values = pa.array([pack(own.slice(a, b - a)) for a, b, _ in runs], pa.binary())
        newest = [pa.array([pc.max(own.column(time).slice(a, b - a)).as_py() for a, b, _ in runs], pa.int64())] if time else []
        return pa.RecordBatch.from_arrays([*[firsts.column(c).combine_chunks() for c in keys], *newest, values], names=[*keys, *([time] if time else []), "pack"])

    schema = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keys)
    return rows.mapInArrow(packs, f"{schema}{f'{time} bigint, ' if time else ''}{PACK}")


def given(rows: Iterator[Row]) -> pa.Table:
    """All rows of the packs that a processor gets for a key."""
    return pa.concat_tables([unpack(r["pack"]) for r in rows]).combine_chunks()


def handed(table: pa.Table, key: dict[str, Any]) -> Iterator[Row]:
    """A processor's rows for a key, in packs."""
    for first in range(0, table.num_rows, HELD):
        yield Row(**key, pack=pack(table.slice(first, HELD)))


def unpacked(out: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """The rows of packs (keys, pack) that a processor handed on, keys first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column("pack")):
                for own in unpack(value.as_buffer()).to_batches():
                    same = [batch.column(c).take(pa.array([i] * own.num_rows)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*same, *own.columns], names=[*keys, *own.schema.names])

    return out.mapInArrow(rows, schema)
