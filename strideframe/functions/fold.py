"""Ordered state machines over keys that are split into blocks, so that one key with very many rows runs in many tasks.

A block holds ``length`` consecutive numbers of the order. The first pass reads each block of the keys that have several and
writes what the block does to any state that could enter it (``summary``); these small summaries are chained, a key at a
time (``after``); the second pass runs every block from the state that enters it. Keys of one block need one pass. Rows
are streamed: an Arrow batch at a time is in memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from strideframe.functions.ranks import hinted
from strideframe.functions.tables import stored

BLOCK = 1 << 16


class Carried:
    """Stands in a state for the value that the entering state has at a place."""

    def __init__(self, place: int):
        self.place = place

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Carried) and other.place == self.place

    def __hash__(self) -> int:
        return hash(("carried", self.place))


class Machine:
    """A state machine by rows, ``__call__(state, row) -> (state, outputs)``; it starts with state None.

    ``entries()`` gives one state for each way in which the future can depend on what enters a block, with ``Carried`` where
    a value is only passed on, and ``entry(state)`` the number of the one that stands for a state. That makes a summary:
    where each entry leads. Machines with other states give ``summary`` and ``after`` themselves."""

    def __call__(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        raise NotImplementedError

    def entries(self) -> list[tuple]:
        raise NotImplementedError

    def entry(self, state: tuple) -> int:
        return self.entries().index(state)

    def lead(self, states: list[tuple], rows: Iterator[tuple]) -> list[tuple]:
        """Where the rows lead from each of the states; states that meet go on as one."""
        at = list(range(len(states)))
        for row in rows:
            where: dict = {}
            new = [where.setdefault(self(s, row)[0], len(where)) for s in states]
            states, at = list(where), [new[i] for i in at]
        return [states[i] for i in at]

    def summary(self, rows: Iterator[tuple]) -> Any:
        return self.lead(self.entries(), rows)

    def after(self, summary: Any, state: Any) -> Any:
        return bound(summary[self.entry(state)], state)

    def first(self, rows: Iterator[tuple]) -> Any:
        """The state after a key's first block."""
        state = None
        for row in rows:
            state = self(state, row)[0]
        return state

    # -- the same over Arrow columns; machines that work on whole arrays replace these

    def run(self, state: Any, columns: list[pa.Array]) -> tuple[Any, list]:
        made = []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            state, out = self(state, row)
            made.append(out)
        return state, list(zip(*made, strict=True))

    def summarise(self, pieces: Iterator[list[pa.Array]], opening: bool) -> Any:
        rows = (row for columns in pieces for row in zip(*(c.to_pylist() for c in columns), strict=True))
        return self.first(rows) if opening else self.summary(rows)


class Plain(Machine):
    """A step function whose states can't be summed up."""

    def __init__(self, step: Callable):
        self.step = step

    def __call__(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        return self.step(state, row)


def bound(state: tuple, entering: tuple) -> tuple:
    """The state with what it carries from the entering one."""
    return tuple(entering[x.place] if isinstance(x, Carried) else x for x in state)


def _starts(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Rows of a batch at which one of the columns changes, and its first row."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in columns:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _pieces(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal ``by``, cut at batches: the values and the rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, by).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(batch.column(c)[a].as_py() for c in by), batch.slice(a, b - a)


class _Ahead:
    """An iterator of (key, piece) read one group of equal keys at a time."""

    def __init__(self, pieces: Iterator[tuple[tuple, pa.RecordBatch]]):
        self.pieces, self.held = pieces, next(pieces, None)

    def group(self) -> Iterator[pa.RecordBatch]:
        key = self.held[0]
        while self.held is not None and self.held[0] == key:
            piece = self.held[1]
            self.held = next(self.pieces, None)
            yield piece


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: StructType, machine: Machine | Callable, length: int | None = BLOCK) -> DataFrame:
    """Adds ``outputs`` to every row. Blocks are runs of ``length`` of the first of ``order``, a whole number; a plain function
    ``step(state, inputs) -> (state, outputs)``, whose states have no summary, reads a key in one task."""
    if not isinstance(machine, Machine):
        machine, length = Plain(machine), None
    columns, by = df.columns, [*keys, "_block"]
    placed = df.withColumn("_block", F.floor(F.col(order[0]) / length) if length else F.lit(0).cast("bigint"))
    enters = None
    if length:
        placed = stored(placed, "blocks")
        long = placed.groupBy(*keys).agg(F.min("_block").alias("_from"), F.max("_block").alias("_to")).where("_from < _to")
        long = stored(long, "long_keys")
        if long.limit(1).count():
            enters = entering(placed, long, keys, order, inputs, machine)
    if enters is None:
        rows = placed.withColumn("_enters", F.lit(None).cast("binary"))
    else:
        rows = placed.join(hinted(enters), by, "left")
    schema = StructType([*df.schema.fields, *outputs.fields])
    names = [*columns, *outputs.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            made: list[list] = [[] for _ in outputs.fields]
            for key, piece in _pieces(iter([batch]), by):
                if key != at:
                    begins = piece.column("_enters")[0].as_py()
                    at, state = key, pickle.loads(begins) if begins is not None else None
                state, out = machine.run(state, [piece.column(c) for c in inputs])
                for column, values, f in zip(made, out, outputs.fields, strict=True):
                    column.append(pa.array(values, to_arrow_type(f.dataType), from_pandas=True))
            if batch.num_rows:
                new = [pa.chunked_array(m).combine_chunks() for m in made]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], names=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def entering(placed: DataFrame, long: DataFrame, keys: list[str], order: list[str], inputs: list[str], machine: Machine) -> DataFrame:
    """keys, _block, _enters: the state that enters each block but the first of the keys that have several."""
    by = [*keys, "_block"]
    of_long = placed.select(*by, *[c for c in dict.fromkeys([*order, *inputs]) if c not in by]).join(hinted(long), keys)
    schema = StructType([*(placed.schema[c] for c in by), StructField("_summary", BinaryType())])

    def rows(at: list[tuple], values: list[bytes]) -> pa.RecordBatch:
        arrays = [pa.array([a[i] for a in at], to_arrow_type(schema[c].dataType)) for i, c in enumerate(by)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(values, pa.binary())], names=schema.names)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = _Ahead(_pieces(batches, [*by, "_from", "_to"]))
        while ahead.held is not None:
            (*at, opens, closes) = ahead.held[0]
            pieces = ([piece.column(c) for c in inputs] for piece in ahead.group())
            done = machine.summarise(pieces, at[-1] == opens) if at[-1] < closes else None
            for _ in pieces:  # what enters the last block alone matters
                pass
            yield rows([tuple(at)], [pickle.dumps(done)])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            at, values = [], []
            for *mine, summary in zip(*(batch.column(c).to_pylist() for c in (*by, "_summary")), strict=True):
                done = pickle.loads(summary)
                if mine[:-1] != key:  # the first block: its summary is the state after it
                    key, state = mine[:-1], done
                    continue
                at.append(tuple(mine))
                values.append(pickle.dumps(state))
                state = machine.after(done, state) if done is not None else None
            if at:
                yield rows(at, values)

    summaries = stored(of_long.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(summarise, schema), "summaries")
    chained = summaries.repartition(*keys).sortWithinPartitions(*by).mapInArrow(chain, schema)
    return stored(chained.withColumnRenamed("_summary", "_enters"), "entering")


def scan(a: np.ndarray, b: np.ndarray, chunk: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Of y = a * y_before + b (a: rows; b: columns x rows) the product of all a up to each row, and y if 0 enters. Chunks are scanned by doubling, all at once; a = 0 forgets all before it, nan too."""
    n, width = len(a), len(b)
    pad = -n % chunk
    a, b = np.pad(a, (0, pad), constant_values=1.0).reshape(-1, chunk), np.pad(b, ((0, 0), (0, pad))).reshape(width, -1, chunk)
    step = 1
    while step < chunk:
        head = a[:, step:]
        b = np.concatenate([b[..., :step], b[..., step:] + np.where(head == 0, 0.0, head * b[..., :-step])], -1)
        a = np.concatenate([a[:, :step], head * a[:, :-step]], -1)
        step *= 2
    gone, kept = 1.0, np.zeros(width)
    for k in range(len(a)):  # one step a chunk
        b[:, k] += np.where(a[k] == 0, 0.0, a[k] * kept[:, None])
        a[k] *= gone
        gone, kept = a[k, -1], b[:, k, -1]
    return a.ravel()[:n], b.reshape(width, -1)[:, :n]


class Total(Machine):
    """Running sum of one column."""

    def run(self, state: Any, columns: list[pa.Array]) -> tuple[Any, list]:
        sums = np.cumsum(columns[0].to_numpy(zero_copy_only=False)) + (state or 0)
        return sums[-1].item(), [sums]

    def summarise(self, pieces: Iterator[list[pa.Array]], opening: bool) -> Any:
        return sum(pc.sum(columns[0]).as_py() for columns in pieces)

    def after(self, summary: Any, state: Any) -> Any:
        return state + summary


class Smoothing(Machine):
    """y = share * x + (1 - share) * y_before of each column, begun anew where the first column, a run's number, changes."""

    def __init__(self, share: float):
        self.share = share if 0 < share < 1 else 1.0

    def _scan(self, before: Any, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        run = columns[0].to_numpy(zero_copy_only=False)
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns[1:]])
        same = np.concatenate([[before is not None and run[0] == before], run[1:] == run[:-1]])
        return scan(np.where(same, 1 - self.share, 0.0), np.where(same, self.share * x, x))

    def run(self, state: Any, columns: list[pa.Array]) -> tuple[Any, list]:
        before, last = state if state is not None else (None, [0.0] * (len(columns) - 1))
        a, b = self._scan(before, columns)
        y = b + np.where(a == 0, 0.0, a * np.array(last)[:, None])
        return (columns[0][-1].as_py(), y[:, -1].tolist()), list(y)

    def summarise(self, pieces: Iterator[list[pa.Array]], opening: bool) -> Any:
        """The state if the block begins a run; its first run, and product and state if that run goes on from 0."""
        state = going = run = None
        product = 1.0
        for columns in pieces:
            if run is None:
                run = columns[0][0].as_py()
                going = (run, [0.0] * (len(columns) - 1))
            a, _ = self._scan(going[0], columns)
            product *= float(a[-1])
            going, state = self.run(going, columns)[0], self.run(state, columns)[0]
        return state if opening else (state, run, product, going)

    def after(self, summary: Any, state: Any) -> Any:
        begun, run, product, going = summary
        if state[0] != run:
            return begun
        return going[0], [g if product == 0 else g + product * s for g, s in zip(going[1], state[1], strict=True)]
