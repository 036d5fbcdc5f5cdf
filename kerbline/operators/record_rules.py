"""Records cut by the labels seen so far: a scan over state transitions, so that a report may span any number of slices.

Whether a row starts a record depends on the labels since the last start, so a plain window can't tell.  But what a
stretch of rows does to *any* state before it is a small table: up to its first certain start, each known label
occurs at most once, and a start there leads to one outcome.  Slices are summed up this way, the tables of slices that
share a report are applied one after another, and then every slice is labelled from the state it really begins with.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import scan, slice_rows
from kerbline.session import cut_lineage, parallelism

#: Codes of rows that are no known label.
HEADING, UNKNOWN = -2, -1
#: The state of a report: the bits of the labels that its open record holds, or no open record.
CLOSED = -1


def step(state: int, code: int) -> tuple[int, bool]:
    """State after a row, and whether the row starts a record."""
    if code == HEADING:
        return CLOSED, False
    bit = 1 << code if code >= 0 else 0
    if state == CLOSED or state & bit:
        return bit, True
    return state | bit, False


@dataclass
class Transition:
    """What a stretch of rows does: from an open record with some labels, or from none."""

    closed: tuple[int, int] = (CLOSED, 0)  # state and records started, when nothing was open before
    hits: list[tuple[int, int, int]] = field(default_factory=list)  # bit, and state and starts if the record ends at that label
    own: int = 0  # labels before the first certain start
    forced: tuple[int, int] | None = None  # state and starts when no label before it repeats one held before

    def apply(self, state: int) -> tuple[int, int]:
        if state == CLOSED:
            return self.closed
        for bit, after, starts in self.hits:
            if state & bit:
                return after, starts
        return self.forced if self.forced is not None else (state | self.own, 0)


def transition(codes: Sequence[int]) -> Transition:
    """The table of a stretch.  Chains of starts meet again soon, so known outcomes are reused."""
    known: dict[int, tuple[int, int]] = {}

    def outcome(at: int, state: int) -> tuple[int, int]:
        """State and starts when a record starts at row ``at``, or when nothing is open there."""
        chain, starts, i = [], 0, at
        while i < len(codes):
            state, new = step(state, codes[i])
            if new:
                if i in known:
                    state, more = known[i]
                    starts += more
                    break
                chain.append((i, starts))
                starts += 1
            i += 1
        for i, before in chain:
            known[i] = (state, starts - before)
        return state, starts

    made = Transition(closed=outcome(0, CLOSED))
    for i, code in enumerate(codes):
        if code == HEADING:
            made.forced = outcome(i, CLOSED)
            break
        if code >= 0:
            bit = 1 << code
            if made.own & bit:
                made.forced = outcome(i, CLOSED)
                break
            made.hits.append((bit, *outcome(i, CLOSED)))
            made.own |= bit
    return made


def rename_follow_ups(rows: DataFrame, report: str, pos: Sequence[str], label: str, follow_up: Column, suffix: str) -> DataFrame:
    """A repeated question takes its name from the label before it: ``<label> :: <suffix>``."""
    asked = scan(rows, list(pos), [report], last_known={"__asked": F.when(~follow_up, F.col(label))})
    named = F.concat(F.col("__asked"), F.lit(f" :: {suffix}"))
    return asked.withColumn(label, F.when(follow_up, F.coalesce(named, F.col(label))).otherwise(F.col(label))).drop("__asked")


def cut_records(rows: DataFrame, report: str, pos: Sequence[str], label: str, heading: Column, known: Sequence[str], name: str = "record_no") -> DataFrame:
    """Label rows with the number of their record in the report, from 1; headings go.

    A record starts at the first label after a heading or of a report, and where a known label would repeat in the
    record (the start label is one of them).  Labels that are not ``known`` (at most 60) never cut.  Rows are cut into
    range slices of (report, pos), so a report with any share of all rows is spread; only one small table per slice
    and report that spans slices reaches the driver, two a slice at most.
    """
    if len(known) > 60:
        raise ValueError("at most 60 known labels")
    code = F.when(heading, HEADING)
    for i, text in enumerate(known):
        code = code.when(F.col(label) == text, i)
    order = [f"__p{i}" for i in range(len(pos))]
    coded = rows.withColumns({"__code": code.otherwise(UNKNOWN), **{o: F.col(p) for o, p in zip(order, pos)}})
    slices = parallelism(rows.sparkSession)
    sliced = slice_rows(coded, F.struct(report, *order), slices)
    ready = cut_lineage(sliced.repartition(slices, "__slice").sortWithinPartitions("__slice", report, *order))

    def summed_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at, codes in _stretches(frames, report):
            t = transition(codes)
            flat = [list(x) for x in t.hits]
            yield pd.DataFrame({"slice": [at[0]], "report": [at[1]], "closed": [list(t.closed)], "hits": [flat], "own": [t.own], "forced": [list(t.forced or ())]})

    kind = rows.schema[report].dataType.simpleString()
    spanning = ready.groupBy(report).agg(F.countDistinct("__slice").alias("n")).filter("n > 1").select(report)
    shared = ready.join(F.broadcast(spanning), report, "left_semi").sortWithinPartitions("__slice", report, *order)  # fewer reports than slices
    shape = f"slice int, report {kind}, closed array<bigint>, hits array<array<bigint>>, own bigint, forced array<bigint>"
    tables = shared.select("__slice", report, "__code").mapInPandas(summed_up, shape).orderBy("report", "slice").collect()
    begins, state, number, last = {}, CLOSED, 0, object()
    for r in tables:
        if r.report != last:
            state, number, last = CLOSED, 0, r.report
        begins[r.slice, r.report] = (state, number)
        t = Transition(tuple(r.closed), [tuple(h) for h in r.hits], r.own, tuple(r.forced) or None)
        state, starts = t.apply(state)
        number += starts

    def labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, number = None, CLOSED, 0
        for frame in frames:
            numbers = []
            for s, r, c in zip(frame["__slice"], frame[report], frame["__code"]):
                if (s, r) != at:
                    at = (s, r)
                    state, number = begins.get(at, (CLOSED, 0))
                state, new = step(state, c)
                number += new
                numbers.append(number)
            yield frame.assign(**{name: numbers})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)
    done = ready.mapInPandas(labelled, f"{fields}, `{name}` bigint")
    return done.filter(F.col("__code") != HEADING).select(*[c for c in rows.columns if c != name], name)


def _stretches(frames: Iterable[pd.DataFrame], report: str) -> Iterator[tuple[tuple, list[int]]]:
    """Codes of each (slice, report) of sorted rows."""
    at, codes = None, []
    for frame in frames:
        for s, r, c in zip(frame["__slice"], frame[report], frame["__code"]):
            if (s, r) != at:
                if at is not None:
                    yield at, codes
                at, codes = (s, r), []
            codes.append(c)
    if at is not None:
        yield at, codes
