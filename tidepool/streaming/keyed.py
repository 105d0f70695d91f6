"""Machines over keyed state with event-time timers: held stories, beats that count once within a window, runs that go quiet.

Rows of a key wait in its state until the watermark has passed them and are then taken in event-time order, so what a machine
decides doesn't depend on how rows were cut into batches or in what order they came. Its next deadline is the key's timer.
Only what is still open stays: a key whose machine has nothing open leaves the state. Keys are dealt into buckets, whose calls
and states they share.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_DAY = 86_400_000_000


class Machine:
    """What happens to the rows of one key, in order. Times are microseconds; state is a JSON value, None where nothing is open."""

    out = ""  # the schema of what it gives, after the key

    def take(self, at: int, kind: str, ref: int, state) -> tuple[list[list], object]:
        """What a row gives, and the state after it. Deadlines before the row have been met."""
        raise NotImplementedError

    def due(self, state) -> int | None:
        """The next deadline; it is met once time has passed it."""
        raise NotImplementedError

    def expire(self, now: int, state) -> tuple[list[list], object]:
        """What deadlines before now give, and the state after them."""
        raise NotImplementedError


class Holds(Machine):
    """Stories that wait for a change of their film: created if one came within the window before, confirmed by the first within
    the window after, expired otherwise. Rows of kind change confirm, all others are stories."""

    out = "story_id long, outcome string, change_id long, at timestamp"

    def __init__(self, days: int = 14):
        self.window = days * _DAY

    def take(self, at, kind, ref, state):
        held, change = state or ([], None)
        if kind == "change":
            return [[story, "confirmed", ref, at] for story, _ in held], ([], [ref, at])
        if change and at - change[1] <= self.window:
            return [[ref, "created", change[0], at]], (held, change)
        return [], ([*held, [ref, at]], change)

    def due(self, state):
        held, change = state
        return min([x[1] + self.window for x in held] + ([change[1] + self.window] if change else []), default=None)

    def expire(self, now, state):
        held, change = state
        gone = [[story, "expired", None, at + self.window] for story, at in held if at + self.window < now]
        held = [x for x in held if x[1] + self.window >= now]
        change = change if change and change[1] + self.window >= now else None
        return gone, (held, change) if held or change else None


class Once(Machine):
    """The first row of a key, and none within the window after it; a row that returns after the window comes out again."""

    out = "ref long, at timestamp"

    def __init__(self, days: int = 14):
        self.window = days * _DAY

    def take(self, at, kind, ref, state):
        return ([], state) if state is not None else ([[ref, at]], at)

    def due(self, state):
        return state + self.window

    def expire(self, now, state):
        return [], None if state + self.window < now else state


class Beats(Machine):
    """Progress rows of a run as heartbeats, at most one in every seconds (the first row gives one), and quiet once none has come for limit seconds."""

    out = "ref long, beat string, at timestamp"

    def __init__(self, every: int = 60, limit: int = 1800):
        self.every, self.limit = every * 1_000_000, limit * 1_000_000

    def take(self, at, kind, ref, state):
        beat = None if state is None else state[0]
        if beat is None or at - beat >= self.every:
            return [[ref, "heartbeat", at]], [at, at, ref]
        return [], [beat, at, ref]

    def due(self, state):
        return state[1] + self.limit

    def expire(self, now, state):
        return ([[state[2], "quiet", state[1] + self.limit]], None) if state[1] + self.limit < now else ([], state)


def advance(machine: Machine, rows: Iterable[list], state, mark: int) -> tuple[list[list], object]:
    """What rows (at, kind, ref) and the deadlines before mark give, in order of time; among rows of one time changes go first."""
    out = []

    def until(now):
        nonlocal state
        while state is not None and (due := machine.due(state)) is not None and due < now:
            # one deadline at a time, so that what comes out is in order
            more, state = machine.expire(due + 1, state)
            out.extend(more)

    for at, kind, ref in sorted(rows, key=lambda r: (r[0], r[1] != "change", r[2])):
        until(at)
        more, state = machine.take(at, kind, ref, state)
        out += more
    until(mark)
    return out, state


def run(rows: DataFrame, key: str, at: str, kind: Column, ref: str, machine: Machine, delay: str = "1 day", buckets: int = 4096) -> DataFrame:
    """(key, what the machine gives) for a stream of rows; rows without a time or a key take no part.

    delay: how late a row may come behind the latest one; the state holds the rows of that time.
    buckets: keys are dealt into so many by their hash, and a bucket's keys share one state and one call, which cost the same for one key as for many.
    It stays the same as long as the stream's state does; more of them suit more keys.
    """
    own = rows.select(F.col(key).alias("key")).schema
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    ready = rows.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(F.col(key).alias("key")), form).alias("key"),
        F.col(at).alias("at"), F.unix_micros(at).alias("us"), kind.cast("string").alias("kind"), F.col(ref).cast("long").alias("ref"))
    names = [x.split()[0] for x in machine.out.split(", ")]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = json.loads(state.get[0]) if state.exists else {}
        for pdf in frames:
            for k, a, x, r in zip(*(pdf[c].tolist() for c in ("key", "us", "kind", "ref")), strict=True):
                keys.setdefault(k, ([], None))[0].append([int(a), x, int(r)])
        mark = max(0, state.getCurrentWatermarkMs())
        out, open_, timers = [], {}, []
        for k, (waiting, inner) in keys.items():
            # a time is passed once its millisecond lies before the watermark
            more, inner = advance(machine, (r for r in waiting if r[0] // 1000 < mark), inner, mark * 1000)
            out += [[k, *x] for x in more]
            waiting = [r for r in waiting if r[0] // 1000 >= mark]
            if waiting or inner is not None:
                open_[k] = (waiting, inner)
                timers += [r[0] for r in waiting] + ([machine.due(inner)] if inner is not None else [])
        if timers:
            state.update((json.dumps(open_),))
            state.setTimeoutTimestamp(max(min(timers) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        if out:
            pdf = pd.DataFrame(out, columns=["key", *names])
            pdf["at"] = pd.to_datetime(pdf["at"], unit="us")
            for c, t in (x.split() for x in machine.out.split(", ")):
                if t == "long":
                    pdf[c] = pdf[c].astype("Int64")
            yield pdf

    out = ready.withWatermark("at", delay).groupBy("bucket").applyInPandasWithState(
        step, f"key string, {machine.out}", "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("key", own, form)["key"].alias(key), *names)
