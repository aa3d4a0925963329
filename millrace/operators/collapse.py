"""Merging of neighbouring rows, in place: no shuffle, no sort, and no group of rows in one value."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import is_scan
from millrace.session import cut

_KEY = "__k"


class _Open:
    """A merged row that may still take in rows: which of the columns it has (as bits), and for each column the row of the window at hand that its cell comes from."""

    __slots__ = ("has", "source")

    def __init__(self, has: int, source: list[int]) -> None:
        self.has, self.source = has, source

    def takes(self, mask: int) -> bool:
        return not self.has & mask

    def add(self, mask: int, at: int, places: list[int]) -> None:
        self.has |= mask
        while mask:
            low = mask & -mask
            self.source[places[low.bit_length() - 1]] = at
            mask ^= low


def _masks(batch: pa.RecordBatch, places: list[int]) -> list[int]:
    """Which of the columns each row has a value in, as bits."""
    valid = np.stack([np.asarray(batch.column(p).is_valid()) for p in places], 1)
    return [int.from_bytes(r.tobytes(), "little") for r in np.packbits(valid, axis=1, bitorder="little")]


def _rows(window: pa.Table, sources: list[list[int]]) -> pa.Table:
    """Rows made of cells of a window."""
    columns = [window.column(c).take(pa.array([s[c] for s in sources], pa.int64())) for c in range(window.num_columns)]
    return pa.Table.from_arrays(columns, schema=window.schema)


def _window(carried: pa.Table | None, batch: pa.RecordBatch) -> pa.Table:
    own = pa.Table.from_batches([batch])
    return own if carried is None else pa.concat_tables([carried.cast(own.schema), own])


def _survey(batches: Iterator[pa.RecordBatch], places: list[int]) -> Iterator[pa.RecordBatch]:
    """What the driver needs to know of a partition: its first and last key, and how it ends, by how it is entered.

    A merged row that comes from before ends at the first row with a column that it has, or where the merged row that begins with this partition's first row would end, whichever comes first. So
    there is one way to go on from the first row, and one for each column from the first row with that column: all there are, whatever came before. From the first change of the key on they are one.
    """
    first: object = None
    last: object = None
    changed, at, seen = False, 0, 0
    ways: dict[int, _Open] = {}  # by column, -1 from the first row
    begun: dict[int, int] = {}  # where each begins; -1: where the first merged row ends
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        window, opens = _window(carried, batch), [*dict.fromkeys(ways.values())]
        width = window.num_columns
        for j, o in enumerate(opens):
            o.source = [j] * width
        for i, (key, mask) in enumerate(zip(batch.column(batch.num_columns - 1).to_pylist(), _masks(batch, places)), len(opens)):
            fresh: _Open | None = None  # all ways that begin a row here go on as one
            if not at:
                first, fresh = key, _Open(mask, [i] * width)
                ways[-1] = fresh
            elif key != last:
                changed, ways = True, {-1: _Open(mask, [i] * width)}
            else:
                for o in [*dict.fromkeys(ways.values())]:
                    if o.takes(mask):
                        o.add(mask, i, places)
                    else:
                        fresh = fresh or _Open(mask, [i] * width)
                        ways = {name: fresh if x is o else x for name, x in ways.items()}
                if ways[-1] is fresh and not changed:
                    begun.setdefault(-1, at)
            if not changed and mask & ~seen:
                fresh = fresh or _Open(mask, [i] * width)
                for b in range(len(places)):
                    if (mask & ~seen) >> b & 1:
                        begun[b], ways[b] = at, fresh
                seen |= mask
            last = key
            at += 1
        carried = _rows(window, [o.source for o in dict.fromkeys(ways.values())])
    if at:
        left = [*dict.fromkeys(ways.values())]
        ends = pickle.dumps((first, last, changed, begun, {name: (o.has, left.index(o)) for name, o in ways.items()}, carried))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ends], pa.binary())], names=["part", "ends"])


def _merge(batches: Iterator[pa.RecordBatch], places: list[int], plan: dict[int, tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of a partition, going on with what came from before; what goes on in a later one isn't given out here."""
    before, hands_on = plan.get(TaskContext.get().partitionId(), (None, False))
    key, has, carried = before if before is not None else (None, 0, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        window = _window(carried, batch)
        now = None if carried is None else _Open(has, [0] * window.num_columns)
        out: list[list[int]] = []
        for i, (k, mask) in enumerate(zip(batch.column(batch.num_columns - 1).to_pylist(), _masks(batch, places)), 0 if carried is None else 1):
            if now is None or k != key or not now.takes(mask):
                if now is not None:
                    out.append(now.source)
                now, key = _Open(mask, [i] * window.num_columns), k
            else:
                now.add(mask, i, places)
        carried, has = _rows(window, [now.source]), now.has
        if out:
            yield from _rows(window, out).select(names).to_batches()
    if carried is not None and not hands_on:
        yield from carried.select(names).to_batches()


def _joined(a: pa.Table, b: pa.Table, has: int, places: list[int]) -> pa.Table:
    """The row ``a`` with those cells of ``b`` that it lacks."""
    both = pa.concat_tables([a.cast(b.schema), b])
    source = [0] * both.num_columns
    for bit, p in enumerate(places):
        if not has >> bit & 1:
            source[p] = 1
    return _rows(both, [source])


def collapse(df: DataFrame, columns: list[str]) -> DataFrame:
    """Merge neighbouring rows that agree in all other columns, as long as no listed column has a value twice.

    Rows stay in their partitions and in order. A first pass tells how each partition ends, for each way in which it can be entered (:func:`_survey`); from that the driver, which gets a row or
    a few of each partition, finds what is handed on from one to the next; a second pass merges. Both read a row at a time, so a run of neighbours may be as long as the table. A table that is
    more than a scan is checkpointed first, so that both passes see the same partitions.
    """
    rest = [c for c in df.columns if c not in columns]
    names = [*rest, *columns]
    places = [names.index(c) for c in columns]
    src = df if is_scan(df) else cut(df)
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("")
    rows = src.select(*[F.col(f"`{c}`") for c in names], key.alias(_KEY))
    found = rows.mapInArrow(partial(_survey, places=places), "part int, ends binary").collect()

    plan: dict[int, list] = {}
    open_: tuple | None = None  # key, columns, row
    holder = None
    for part, ends in sorted((r["part"], bytes(r["ends"])) for r in found):
        first, last, changed, begun, ways, kept = pickle.loads(ends)  # noqa: S301 - written by the pass above
        plan[part] = [None, False]
        way = -1
        if open_ is not None and open_[0] == first:
            plan[part][0], plan[holder][1] = open_, True
            stops = [(begun[b], b) for b in begun if b < 0 or open_[1] >> b & 1]
            if not changed:
                way = min(stops)[1] if stops else None
        if way is None:
            open_ = (last, open_[1] | ways[-1][0], _joined(open_[2], kept.slice(ways[-1][1], 1), open_[1], places))
        else:
            open_ = (last, ways[way][0], kept.slice(ways[way][1], 1))
        holder = part
    passed = {p: tuple(x) for p, x in plan.items()}
    schema = rows.drop(_KEY).schema
    return rows.mapInArrow(partial(_merge, places=places, plan=passed, names=names), schema)
