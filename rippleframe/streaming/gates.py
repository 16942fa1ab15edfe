"""Stateful operators on streams: the review gate, file collection, windows and corrections by id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATE_STATE = "attempts int, seen array<string>, complexity int, plan_hash string"
GATE_OUT = "session string, seq long, attempts int, allowed boolean, why string"
GIVE_UP = 3
#: How long a session without evaluations is remembered.
SESSION_MS = 24 * 3_600_000


def rounds_needed(complexity: int, p_failed: float, novelty: float) -> int:
    n = 1 if complexity <= 4 else 2 if complexity <= 10 else 3 if complexity <= 20 else 4
    n += p_failed > 0.4 and n < 4
    return int(n + (novelty > 0.5 and n < 4))


def gate_step(state: tuple | None, row: dict) -> tuple[tuple | None, bool, str]:
    """One evaluation: (state after, None when the session is over; allowed; why).

    ``row`` has check_id, readable, missing, steps, files, plan_hash, p_failed and novelty.
    """
    attempts, seen, complexity, plan = state or (0, [], 0, "")
    attempts, seen = attempts + 1, list(seen)
    if not row["check_id"]:
        over = attempts >= GIVE_UP
        return (None if over else (attempts, seen, complexity, plan)), over, "no check after several attempts" if over else "no check yet"
    if not row["readable"]:
        return None, True, "result unreadable"
    if plan and row["plan_hash"] and plan != row["plan_hash"]:
        seen, complexity = [], 0
    plan = row["plan_hash"] or plan
    if row["missing"]:
        return (attempts, seen, complexity, plan), False, "files missing"
    if row["check_id"] not in seen:
        seen.append(row["check_id"])
        complexity = max(row["steps"], row["files"])
    needed = rounds_needed(complexity, row["p_failed"], row["novelty"])
    if len(seen) < needed:
        return (attempts, seen, complexity, plan), False, f"round {len(seen)} of {needed}"
    return None, True, "done"


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    out = []
    # Evaluations of a session within a micro-batch are taken in their order.
    for row in pd.concat(list(frames)).sort_values("seq").to_dict("records"):
        attempts = (held[0] if held else 0) + 1
        held, allowed, why = gate_step(held, row)
        out.append((key[0], row["seq"], attempts, allowed, why))
    if held is None:
        state.remove() if state.exists else None
    else:
        state.update(held)
        state.setTimeoutDuration(SESSION_MS)
    yield pd.DataFrame(out, columns=["session", "seq", "attempts", "allowed", "why"])


def gate(evaluations: DataFrame) -> DataFrame:
    """A stream of evaluations (session, seq, and what ``gate_step`` reads) -> one verdict each; state is kept by session, for a day after its last one."""
    return evaluations.groupBy("session").applyInPandasWithState(_gate, GATE_OUT, GATE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


EDITS_OUT = "project string, n int, files array<string>"


def _collect(keep: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # When each file was last edited, in milliseconds.
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        mark, before = state.getCurrentWatermarkMs(), set(last)
        for frame in frames if not state.hasTimedOut else ():
            at = frame.dropna(subset=["file", "ts"])
            for f, t in zip(at["file"], at["ts"], strict=True):
                last[f] = max(last.get(f, 0), int(t.timestamp() * 1000))
        # A batch may be far ahead of its watermark, so the newest edit counts too.
        held = {f: t for f, t in last.items() if t + keep > max(mark, *last.values())}
        if held:
            names = sorted(held)
            state.update((names, [held[f] for f in names]))
            state.setTimeoutTimestamp(max(mark + 1, min(held.values()) + keep))
        elif state.exists:
            state.remove()
        if len(held) >= 2 and set(held) - before:
            yield pd.DataFrame([(key[0], len(held), sorted(held))], columns=["project", "n", "files"])

    return run


def edited_files(edits: DataFrame, keep: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A stream of edits (project, file, ts) -> the distinct files of a project each time they grow, from two on.

    A file is forgotten once the watermark, or the project's newest edit, has passed its last edit
    by ``keep``, and a project once it has no file: timers on event time see to it, so state does not grow with the
    stream. Edits later than the watermark are left out; repeated ones change nothing.
    """
    n, unit = keep.split()
    ms = int(n) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    marked = edits.withWatermark("ts", late)
    return marked.groupBy("project").applyInPandasWithState(_collect(ms), EDITS_OUT, "files array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_counts(events: DataFrame, size: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events (ts, kind) counted by sliding window; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "kind").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "kind", "n")


def decayed_churn(changes: DataFrame, days: int = 90, late: str = "1 day") -> DataFrame:
    """Changes (ts, file) counted over the last days, day by day."""
    return sliding_counts(changes.select("ts", F.col("file").alias("kind")), f"{days} days", "1 day", late).withColumnRenamed("kind", "file")


def corrected(checks: DataFrame, outcomes: DataFrame, within: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Checks (id, ts) with outcomes (id, ts, outcome) that follow within a time, null when none came: a stream join with watermarks.

    Of checks and of outcomes that repeat an id the first stays, as long as the watermark has
    not passed it by; outcomes that come later than the watermark or the time allows are left
    out, and so is state that neither can need any more.
    """
    c = checks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]).alias("c")
    o = outcomes.select(F.col("id").alias("o_id"), F.col("ts").alias("o_ts"), "outcome").withWatermark("o_ts", late).dropDuplicatesWithinWatermark(["o_id"])
    return c.join(o, (F.col("id") == F.col("o_id")) & F.expr(f"o_ts >= ts AND o_ts <= ts + INTERVAL {within}"), "left_outer").select("id", "ts", "outcome")


def bounded_log(rows: DataFrame, key: str, most: int = 200, keep: int = 100) -> DataFrame:
    """Rows of keys, cut to the newest ``keep`` once there are more than ``most``; for use on each micro-batch's log."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    marked = rows.withColumn("n_", F.count(F.lit(1)).over(w)).withColumn("r_", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))))
    return marked.filter(f"n_ <= {most} OR r_ <= {keep}").drop("n_", "r_")
