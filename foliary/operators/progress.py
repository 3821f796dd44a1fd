"""Progress events: folds, paces, outages and milestones, as batch plans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.operators.scans import Running, previous, running

# What counts as an outage, the waits between probes, when to give up, when the observed pace counts.
OUTAGE_AFTER, PROBE_WAITS, GIVE_UP_SECONDS, BLEND_AFTER, MILESTONE = 3, (60, 120, 300), 3600, 20, 500


def outages(rows: DataFrame, by: list[str], order: list[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures of at least OUTAGE_AFTER, and the pauses they lead to: the tally starts anew after each."""
    bad = F.coalesce(failed, F.lit(False))
    marked = running(rows.withColumn("_bad", bad).select(*by, *order, "_bad"), by, order, {"island": Running("sum", F.when(F.col("_bad"), 0).otherwise(1))})
    runs = marked.where("_bad").groupBy(*by, "island").agg(F.count("*").alias("failures"))
    return runs.where(F.col("failures") >= OUTAGE_AFTER).withColumn("pauses", F.floor(F.col("failures") / OUTAGE_AFTER))


def probe_schedule(limit: int = GIVE_UP_SECONDS) -> list[tuple[int, int]]:
    """(wait, seconds down after it) of the probes of one outage until it is given up."""
    out, down = [], 0
    while down < limit:
        wait = PROBE_WAITS[min(len(out), len(PROBE_WAITS) - 1)]
        down += wait
        out.append((wait, down))
    return out


def pace(delay: Column, jitter: Column, requests: Column, elapsed: Column) -> Column:
    """Seconds a request: the configured floor, half and half with what is observed once there is enough of it."""
    floor = delay + jitter / 2
    return F.when(requests >= BLEND_AFTER, (floor + elapsed / requests) / 2).otherwise(floor)


def eta(estimated: Column, requests: Column, pace_seconds: Column, finished: Column) -> Column:
    """Seconds left; null once finished or without an estimate."""
    return F.when(finished | (estimated <= 0), F.lit(None).cast("double")).otherwise(F.greatest(estimated - requests, F.lit(0)) * pace_seconds)


def rate_per_minute(requests: Column, elapsed: Column) -> Column:
    return F.when((requests > 0) & (elapsed > 0), requests * 60.0 / elapsed)


#: What an event may hold. event_type names the event; phases are those of RunStarted, in their order; until is on mono's clock.
EVENT = (
    "run string, seq bigint, mono double, event_type string, phase string, phases array<string>, items bigint, label string, status string, reason string, seconds double, until double, "
    "est_total_requests bigint, down_seconds double, probe_in_seconds double, incomplete boolean"
)
# How an item may end, as events say it, and the counters of it.
OUTCOMES = {"ok": "ok", "skipped_no_citation": "skipped", "error": "error", "deferred": "deferred"}
#: What each event does to its run: a column is set to a value ("is"), takes a field of the event or else a value ("of"), or counts up ("plus").
#: The batch fold and the live one are both made from this table.
_IDLE = {"requesting": ("is", False), "wait_reason": ("is", None), "wait_until": ("is", None)}
TRANSITIONS = {
    "RunStarted": {"est_total_requests": ("of", "est_total_requests", 0)},
    "PhaseStarted": {"phase_name": ("of", "phase", ""), "phase_items": ("of", "items", 0), "phase_done": ("is", 0), "current_label": ("is", "")},
    "ItemStarted": {"current_label": ("of", "label", "")},
    "ItemFinished": {**_IDLE, "phase_done": ("plus", 1)},
    "RequestStarted": {**_IDLE, "requesting": ("is", True), "requests_done": ("plus", 1)},
    "WaitStarted": {"requesting": ("is", False), "wait_reason": ("of", "reason", None), "wait_until": ("of", "until", None)},
    "RetryScheduled": {"retry": ("plus", 1)},
    "OutagePaused": {"outage_state": ("is", "paused")},
    "OutageProbing": {"outage_state": ("is", "probing"), "outage_down": ("of", "down_seconds", 0.0), "outage_probe_in": ("of", "probe_in_seconds", 0.0)},
    "OutageRecovered": {"outage_state": ("is", ""), "outage_down": ("is", 0.0), "outage_probe_in": ("is", 0.0)},
    "OutageGaveUp": {"outage_state": ("is", "gave_up"), "outage_down": ("of", "down_seconds", 0.0)},
    "Cancelled": {"cancelled": ("is", True)},
    "RunFinished": {**_IDLE, "finished": ("is", True), "incomplete": ("of", "incomplete", False)},
}
#: The columns of a run's state that the table sets, with their types and first values.
REGISTERS = {
    "phase_name": ("string", ""), "phase_items": ("bigint", 0), "current_label": ("string", ""), "wait_reason": ("string", None), "wait_until": ("double", None), "requesting": ("boolean", False), "outage_state": ("string", ""),
    "outage_down": ("double", 0.0), "outage_probe_in": ("double", 0.0), "cancelled": ("boolean", False), "finished": ("boolean", False), "incomplete": ("boolean", False), "est_total_requests": ("bigint", 0),
}
COUNTERS = ("requests_done", "retry")


def _register(column: str, order: Column) -> Column:
    """The value of a column after the last event that touches it."""
    kind, (of, first) = F.col("event_type"), REGISTERS[column]
    touching = {event: does[column] for event, does in TRANSITIONS.items() if column in does}
    value = F.lit(None).cast(of)
    for event, (how, x, *other) in touching.items():
        value = F.when(kind == event, F.lit(x).cast(of) if how == "is" else F.coalesce(F.col(x).cast(of), F.lit(other[0]).cast(of))).otherwise(value)
    return F.coalesce(F.max_by(F.struct(value.alias("value")), F.when(kind.isin(list(touching)), order))["value"], F.lit(first).cast(of)).alias(column)


def _counter(column: str, only: Column | None = None) -> Column:
    counted = F.col("event_type").isin([event for event, does in TRANSITIONS.items() if does.get(column, ("",))[0] == "plus"])
    return F.count_if(counted if only is None else counted & only).alias(column)


def events_of(rows: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """Rows with all columns that an event may have; what they lack is null, other columns stay."""
    have = set(rows.columns)
    kinds = dict(x.split(" ", 1) for x in EVENT.split(", "))
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in have and c not in ("run", "seq")})


def fold(events: DataFrame, run: str, order: str) -> DataFrame:
    """One row per run: outcomes, requests, retries, phase, label, wait and outage, as the events leave them.

    Two aggregations that combine before they shuffle, so a run with very many events is not sorted in one task.
    """
    rows = events_of(events, run, order)
    kind, at = F.col("event_type"), F.col(order)
    begun = rows.groupBy(run).agg(
        F.max_by("phases", F.when(kind == "RunStarted", at)).alias("_phases"),
        F.max(F.when(kind == "PhaseStarted", at)).alias("_phase_at"),
    )
    rows = rows.join(begun.select(F.col(run).alias("_run"), "_phases", "_phase_at"), F.col(run).eqNullSafe(F.col("_run")))
    listed = F.coalesce(F.array_position("_phases", F.col("phase")), F.lit(0))
    last_listed = rows.where((kind == "PhaseStarted") & (listed > 0)).groupBy(run).agg(F.max(order).alias("_listed_at"), F.max_by(listed, at).alias("_index"))
    rows = rows.join(last_listed.select(F.col(run).alias("_run2"), "_listed_at", "_index"), F.col(run).eqNullSafe(F.col("_run2")), "left")
    now = F.col("_phase_at").isNull() | (at > F.col("_phase_at"))
    out = rows.groupBy(run).agg(
        *[F.count_if((kind == "ItemFinished") & (F.col("status") == said)).alias(name) for said, name in OUTCOMES.items()],
        *[_counter(c) for c in COUNTERS],
        _counter("phase_done", now),
        *[_register(c, at) for c in REGISTERS],
        (F.coalesce(F.max("_index"), F.lit(0)) + F.count_if((kind == "PhaseStarted") & (F.col("_listed_at").isNull() | (at > F.col("_listed_at"))))).alias("phase_index"),
        F.coalesce(F.nullif(F.max(F.coalesce(F.size("_phases"), F.lit(0))), F.lit(0)), F.lit(None)).cast("bigint").alias("_known"),
        (F.max("mono") - F.min("mono")).alias("elapsed_seconds"),
    )
    return out.withColumn("phase_total", F.coalesce("_known", "phase_index")).drop("_known")


def spacing(requests: DataFrame, by: list[str], at: str, floor: float) -> DataFrame:
    """Requests that came sooner after the one before than a rate gate of `floor` seconds lets through; the first is free."""
    out = running(requests, by, [at], {"_before": previous(F.col(at))})
    return out.withColumn("gap", F.col(at) - F.col("_before.value")).where(F.col("gap") < floor).drop("_before")


def milestones(rows: DataFrame, by: list[str], order: list[str], counted: Column, every: int = MILESTONE) -> DataFrame:
    """Rows at which the running count reaches another multiple of `every`."""
    out = running(rows.withColumn("_c", counted), by, order, {"reached": Running("sum", F.when(F.col("_c"), 1).otherwise(0))})
    return out.where(F.col("_c") & (F.col("reached") % every == 0)).drop("_c")


def throttled(rows: DataFrame, by: list[str], order: str, seconds: str, every: int, at_least: float) -> DataFrame:
    """Rows that a throttle lets through: every nth since the last one, or the first after so many seconds.

    Groups are sorted by Spark and stream through one pass that holds a batch and two numbers, however long they are.
    """
    key = F.struct(*by)
    dealt = rows.withColumn("_g", key).repartition(*by).sortWithinPartitions(*by, order)

    def walk(batches):
        group, since, last = None, 0, None
        for batch in batches:
            keep = []
            for g, t in zip(batch.column("_g").to_pylist(), batch.column(seconds).to_pylist(), strict=True):
                if g != group:
                    group, since, last = g, 0, None
                since += 1
                emit = last is None or since >= every or t - last >= at_least
                keep.append(emit)
                if emit:
                    since, last = 0, t
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["_g"])

    return dealt.mapInArrow(walk, rows.schema)


def order_faults(events: DataFrame, run: str, order: str) -> DataFrame:
    """Events that break the protocol: an item outside a phase, or a finish or request without its start."""
    kind = F.col("event_type")
    open_phases = F.when(kind == "PhaseStarted", 1).when(kind == "PhaseFinished", -1).otherwise(0)
    of_item = kind.isin("ItemStarted", "ItemFinished", "RequestStarted")
    opening = F.when(kind.isin("ItemStarted", "ItemFinished", "PhaseStarted"), kind)
    marked = running(events, [run], [order], {"_p": Running("sum", open_phases), "_s": Running("last", opening, before=True)})
    fault = F.when(of_item & (F.col("_p") < 1), "outside a phase").when((kind == "ItemFinished") & (F.coalesce("_s", F.lit("")) != "ItemStarted"), "finish without start")
    return marked.withColumn("fault", fault).where("fault is not null").drop("_p", "_s")


def event_text(kind: Column, label: Column, status: Column, reason: Column, seconds: Column) -> Column:
    """The line that a log shows for an event; null for those it passes over."""
    from foliary.functions.dates import duration_text

    wait = duration_text(F.coalesce(seconds, F.lit(0.0)))
    return (
        F.when(kind == "PhaseStarted", F.concat(F.lit("started: "), label))
        .when(kind == "PhaseFinished", F.concat(F.lit("finished: "), label))
        .when((kind == "ItemFinished") & (status != "ok"), F.concat_ws(" ", status, label, F.when(reason.isNotNull(), F.concat(F.lit("("), reason, F.lit(")")))))
        .when(kind == "RetryScheduled", F.concat(F.lit("retry in "), wait))
        .when(kind == "OutagePaused", F.lit("site down, paused"))
        .when(kind == "OutageProbing", F.concat(F.lit("site down, next look in "), wait))
        .when(kind == "OutageGaveUp", F.concat(F.lit("given up after "), wait))
        .when(kind == "Cancelled", F.lit("stopping after the current item"))
        .when(kind == "OutageRecovered", F.concat(F.lit("site back after "), wait))
        .when(kind == "RunFinished", F.concat(F.lit("run finished in "), wait))
    )


def countdown_text(reason: Column, until: Column, now: Column) -> Column:
    """What is being waited for and how long still, to a tenth of a second; null without a wait."""
    left = F.format_number(F.greatest(until - now, F.lit(0.0)), 1)
    name = F.when(reason == "politeness", "next request").when(reason == "retry_backoff", "next try").when(reason == "outage_probe", "next look at the site").otherwise(reason)
    return F.when(reason.isNotNull() & until.isNotNull(), F.concat(name, F.lit(" in "), left, F.lit("s")))


def eta_text(seconds: Column) -> Column:
    """Time left in words; an ellipsis while it is unknown."""
    from foliary.functions.dates import duration_text

    return F.coalesce(F.concat(F.lit("~"), duration_text(seconds), F.lit(" left")), F.lit("…"))


def final_elapsed(event_seconds: Column, model_seconds: Column) -> Column:
    """The finishing event's own elapsed time, or the model's where it says 0."""
    return F.coalesce(F.nullif(event_seconds, F.lit(0.0)), model_seconds)


def done_at(rows: DataFrame, by: list[str], order: str, now: str, left: str, outage: str) -> DataFrame:
    """When the run will be done, frozen at its last value while an outage is on (paused or probing)."""
    fresh = F.when(~F.coalesce(F.col(outage), F.lit("")).isin("paused", "probing"), F.col(now) + F.col(left))
    return running(rows, by, [order], {"done_at": Running("last", fresh)})
