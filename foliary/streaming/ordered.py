"""Streams whose rows come late or out of order: they wait in state until the watermark has passed them, and act in order of time.

What is made of them is then the same however the rows are dealt to batches. A machine is what acts: `first` is the state of a new run,
`step` takes a row, `tick` is told how far time has come, `wake` says when it next wants to be told (microseconds, or None), and `shown`
is what it shows once it has acted. State holds a tuple for each run and the rows that the watermark has not passed; a timer for each run
wakes it. Rows without a run are a run, rows without a time or an order are passed over, and so are those that come after a later one of
their run has acted (the watermark's delay is how late a row may be). Rows with the time and order of another are the same row again.
Needs the RocksDB state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliary.operators.progress import EVENT, GIVE_UP_SECONDS, OUTAGE_AFTER, PROBE_WAITS, events_of
from foliary.streaming import events

_SECOND, _NEVER = 1_000_000, -(2**62)


class Machine:
    """fields are the columns that a row has beside its run, time and order; state and out are schemas."""

    fields: list[tuple[str, str]]
    state: str
    out: str
    first: tuple

    def step(self, state: tuple, row: Row) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def tick(self, state: tuple, until: int) -> tuple[tuple, list[tuple]]:
        return state, []

    def wake(self, state: tuple) -> int | None:
        return None

    def shown(self, state: tuple) -> list[tuple]:
        return []


class Released(StatefulProcessor):
    """Holds rows back until the watermark has passed them and hands them to a machine in order of (_us, _order)."""

    def __init__(self, machine: Machine, shape: list[str]) -> None:
        self.machine, self.shape = machine, shape
        self.names = [*(n for n, _ in machine.fields), "_us", "_order"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in [*self.machine.fields, ("_us", "bigint"), ("_order", "bigint")]))
        self.state = handle.getValueState("state", f"{self.machine.state}, acted_us bigint, acted_order bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        *_, us, order = self._state()
        fresh = [tuple(r[n] for n in self.names) for r in rows if (r["_us"], r["_order"]) > (us, order)]
        if fresh:
            self.waiting.appendList(fresh)
            self._call_at(min(r[-2] for r in fresh))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        later = [r for r in held if r[-2] > until]
        *state, us, order = self._state()
        state, made, acted, shape = tuple(state), [], False, Row(*self.names)
        for row in sorted((r for r in held if r[-2] <= until), key=lambda r: r[-2:]):
            if row[-2:] > (us, order):
                state, before = self.machine.tick(state, row[-2] - 1)
                state, out = self.machine.step(state, shape(*row))
                made += before + out
                (us, order), acted = row[-2:], True
        state, out = self.machine.tick(state, until)
        made += out + (self.machine.shown(state) if acted else [])
        if later:
            self.waiting.put(later)
        elif held:
            self.waiting.clear()
        self.state.update((*state, us, order))
        calls = [r[-2] for r in later] + [x for x in (self.machine.wake(state),) if x is not None]
        if calls:
            self._call_at(min(calls), expiredTimerInfo.getExpiryTimeInMs())
        told = Row(*self.shape)
        yield from (told(key[0], *out) for out in made)

    def close(self) -> None:
        pass

    def _state(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (*self.machine.first, _NEVER, _NEVER)

    def _call_at(self, us: int, passed: int | None = None) -> None:
        """A timer for the millisecond by which that time has passed, unless one comes before it anyway."""
        ms = -(-us // 1000)
        if not any(t <= ms for t in self.handle.listTimers() if t != passed):
            self.handle.registerTimer(ms)


def released(rows: DataFrame, run: str, at: str, order: str, machine: Machine, late: str) -> DataFrame:
    """What a machine makes of a stream's rows; at is a timestamp, order a whole number that tells apart what happens at one time."""
    timed = rows.where(F.col(at).isNotNull() & F.col(order).isNotNull()).withWatermark(at, late)
    own = [F.col(n).cast(t).alias(n) for n, t in machine.fields]
    shaped = timed.select(F.col(run).cast("string").alias("_run"), F.col(at).alias("_at"), F.unix_micros(at).alias("_us"), F.col(order).cast("bigint").alias("_order"), *own)
    out = f"{run} string, {machine.out}"
    return shaped.groupBy("_run").transformWithState(Released(machine, [x.split(" ", 1)[0] for x in out.split(", ")]), out, "Append", "EventTime")


class Fold(Machine):
    """The fold of progress events: a snapshot of the run whenever events of it have acted."""

    fields = [tuple(x.split(" ", 1)) for x in EVENT.split(", ") if not x.startswith("run ")]
    state, first = events._STATE, tuple(events._FIRST.values())
    out = events.SNAPSHOT.removeprefix("run string, ")

    def __init__(self, floor: float) -> None:
        self.floor = floor

    def step(self, state, row):
        after = events.advance(events._kept(state), row, self.floor)
        return tuple(after[n] for n in events._NAMES), []

    def shown(self, state):
        return [tuple(events.snapshot(events._kept(state), self.floor).values())]


class Throttle(Machine):
    """Lets a run's first row through, then every nth since the last, or the first after so many seconds, as progress.throttled does."""

    state, first = "since bigint, last_us bigint", (0, None)

    def __init__(self, fields: list[tuple[str, str]], every: int, at_least: float) -> None:
        self.fields, self.every, self.at_least = fields, every, at_least
        self.out = ", ".join(f"{n} {t}" for n, t in fields)

    def step(self, state, row):
        since, last = state[0] + 1, state[1]
        if last is None or since >= self.every or row["_us"] - last >= self.at_least * _SECOND:
            return (0, row["_us"]), [tuple(row)[: len(self.fields)]]
        return (since, last), []


class Breaker(Machine):
    """Pauses a run after OUTAGE_AFTER failures in a row, probes after each of PROBE_WAITS and gives up after GIVE_UP_SECONDS.

    Rows say what came of an item ("ok" or "failed") or what a look at the site found ("up" or "down"); others change nothing. A
    probe finds what the last row since the probe before it said, and a site of which nothing is known is down. Told are: deferred (a failure that
    pauses nothing), paused, probing (seconds down and to the next probe), recovered and gave_up. A run that gave up says no more.
    """

    fields = [("outcome", "string")]
    state = "failures bigint, paused boolean, gave_up boolean, up boolean, waited bigint, probes bigint, probe_us bigint"
    first = (0, False, False, False, 0, 0, None)
    out = "at_us bigint, seq bigint, told string, failures bigint, down_seconds bigint, probe_in_seconds bigint"

    def step(self, state, row):
        failures, paused, gave_up, *_ = state
        good, bad = row["outcome"] in ("ok", "up"), row["outcome"] in ("failed", "down")
        if gave_up or not (good or bad):
            return state, []
        if paused:
            return (*state[:3], good, *state[4:]), []
        if row["outcome"] == "failed" and failures + 1 >= OUTAGE_AFTER:
            state, told = self._probe((failures + 1, True, False, False, 0, 0, row["_us"]))
            return state, [(row["_us"], row["_order"], "paused", failures + 1, 0, None), *told]
        if row["outcome"] == "failed":
            return (failures + 1, *state[1:]), [(row["_us"], row["_order"], "deferred", failures + 1, None, None)]
        return (0 if row["outcome"] == "ok" else failures, *state[1:]), []

    def tick(self, state, until):
        told = []
        while state[1] and state[6] <= until:
            failures, _, _, up, waited, probes, at = state
            waited += self._wait(waited, probes)
            if up:
                state = self.first
                told.append((at, None, "recovered", failures, waited, None))
            elif waited >= GIVE_UP_SECONDS:
                state = (failures, False, True, False, waited, probes, None)
                told.append((at, None, "gave_up", failures, waited, None))
            else:
                state, more = self._probe((failures, True, False, False, waited, probes + 1, at))
                told += more
        return state, told

    def wake(self, state):
        return state[6] if state[1] else None

    def _wait(self, waited: int, probes: int) -> int:
        return min(PROBE_WAITS[min(probes, len(PROBE_WAITS) - 1)], GIVE_UP_SECONDS - waited)

    def _probe(self, state):
        """The next probe's time, and the word of it."""
        failures, *_, waited, probes, at = state
        wait = self._wait(waited, probes)
        return (*state[:6], at + wait * _SECOND), [(at, None, "probing", failures, waited, wait)]


def ordered_fold(rows: DataFrame, at: str, delay: float, jitter: float, late: str = "10 minutes") -> DataFrame:
    """Snapshots as live_fold gives them, for events that may come out of order between batches; at is the column of their time."""
    return released(events_of(rows), "run", at, "seq", Fold(delay + jitter / 2), late)


def throttled(rows: DataFrame, run: str, at: str, order: str, columns: list[str], every: int, at_least: float, late: str = "10 minutes") -> DataFrame:
    """The rows that a throttle lets through, with the run and these columns; they may not be timestamps, dates or decimals."""
    kinds = dict(rows.dtypes)
    return released(rows, run, at, order, Throttle([(c, kinds[c]) for c in columns], every, at_least), late)


def breaker(rows: DataFrame, run: str, at: str, order: str, late: str = "10 minutes") -> DataFrame:
    """What an outage breaker says of each run; rows have `outcome`. seq is the order of the row that it is said of, null for probes."""
    return released(rows, run, at, order, Breaker(), late).withColumn("at_us", F.timestamp_micros("at_us")).withColumnRenamed("at_us", "at")
