"""Folds, and the two-phase run of aggregates that Catalyst has no expression for.

The first phase folds rows where they are, one state per group; the second folds the states of a group. States travel pickled,
sorted by group, so that neither phase holds more than its own states."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa

#: States a task of the first phase holds before it hands them on; a group may then have several, which the second phase takes.
HELD_GROUPS = 100_000
ROWS = 1000


@dataclass(frozen=True)
class Fold:
    """step(state, item) from start() on, and what done makes of the last state."""

    start: Callable[[], Any]
    step: Callable[[Any, Any], Any]
    done: Callable[[Any], Any] = lambda state: state

    def over(self, items: Iterable) -> Any:
        state = self.start()
        for item in items:
            state = self.step(state, item)
        return self.done(state)


def partial_phase(partials: list[Fold], keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of key columns, then for each fold a value and whether it counts, to key columns and a pickled list of states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[bytes, tuple[tuple, list]] = {}
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            held = list(states.values())
            for i in range(0, len(held), ROWS):
                part = held[i : i + ROWS]
                columns = [pa.array([key[k] for key, _ in part], schema.field(k).type) for k in range(keys)]
                payload = pa.array([pickle.dumps([f.done(s) for f, s in zip(partials, each, strict=True)]) for _, each in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, payload], [*schema.names[:keys], "payload"])
            states.clear()

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                key = tuple(c[i] for c in columns[:keys])
                name = pickle.dumps(key)
                if name not in states:
                    states[name] = key, [f.start() for f in partials]
                each = states[name][1]
                for n, fold in enumerate(partials):
                    if columns[keys + 2 * n + 1][i]:
                        each[n] = fold.step(each[n], columns[keys + 2 * n][i])
            if len(states) > HELD_GROUPS:
                yield from flush()
        if schema is not None:
            yield from flush()

    return run


def final_phase(finals: list[Fold], keys: int, types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by key, of key columns and payload, to key columns and a result of each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = key_now = states = schema = None
        done: list[tuple[tuple, list]] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([key[k] for key, _ in done], schema.field(k).type) for k in range(keys)]
            results = [pa.array([each[n] for _, each in done], t) for n, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, *results], [*schema.names[:keys], *(f"leaf_{n}" for n in range(len(types)))])

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                key = tuple(c[i] for c in columns[:keys])
                name = pickle.dumps(key)
                if name != now:
                    if states is not None:
                        done.append((key_now, [f.done(s) for f, s in zip(finals, states, strict=True)]))
                    now, key_now, states = name, key, [f.start() for f in finals]
                states = [f.step(s, x) for f, s, x in zip(finals, states, pickle.loads(columns[keys][i]), strict=True)]
            if len(done) >= ROWS:
                yield out()
                done = []
        if states is not None:
            done.append((key_now, [f.done(s) for f, s in zip(finals, states, strict=True)]))
            yield out()

    return run
