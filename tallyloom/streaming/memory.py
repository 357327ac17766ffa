"""What templates have taught, as a stream of reviewers' corrections."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of events that are no rules: a page with a backend's or a model's share of corrected rows, and a page seen.
RATES, PAGE = ("backend", "model"), "page"
_EVENT = "kind string, trigger string, at timestamp, value string"
#: What the memory holds; uses and rate of a backend or model (trigger), uses of a page are how often the template was seen.
MEMORY = "signature string, kind string, trigger string, value string, contradicted long, confirmed long, first_seen timestamp, last_confirmed timestamp, uses long, rate double"
_COLUMNS = [c.split()[0] for c in MEMORY.split(", ")]
_ENTRY = "value string, contradicted long, confirmed long, first_seen timestamp, last_confirmed timestamp, uses long, rate double"


def _applied(entry: tuple | None, kind: str, at: datetime.datetime, value: str | None) -> tuple | None:
    """An entry (value, contradicted, confirmed, first_seen, last_confirmed, uses, rate) after one more event; None where there is still none."""
    if kind == PAGE or kind in RATES:
        _, _, _, first, _, uses, rate = entry or (None, 0, 0, at, at, 0, None)
        mean = None if kind == PAGE else ((rate or 0.0) * uses + float(value)) / (uses + 1)
        return None, 0, 0, first, at, uses + 1, mean
    if entry is None:
        return None if value is None else (value, 0, 0, at, at, 0, None)
    known, contradicted, confirmed, first, last, uses, rate = entry
    if value is None:
        return known, contradicted, confirmed + 1, first, at, uses, rate
    return entry if value == known else (value, contradicted + 1, 0, first, at, uses, rate)


class TemplateMemory(StatefulProcessor):
    """One template's rules, rates and occurrences. Events wait until the watermark has passed them, and are then applied in the order of time, confirmations first, then by value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "kind string, trigger string", _ENTRY)
        self.waiting = handle.getListState("waiting", _EVENT)
        self.due = handle.getValueState("due", "ms long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState[_COLUMNS].itertuples(index=False):
            blank = lambda v: None if pd.isna(v) else v
            self.known.updateValue((r.kind, r.trigger), (blank(r.value), int(r.contradicted), int(r.confirmed), r.first_seen.to_pydatetime(), r.last_confirmed.to_pydatetime(), int(r.uses), blank(r.rate)))

    def _due(self, at: int | None) -> None:
        """One timer, at the earliest event that waits."""
        if self.due.exists():
            if at is not None and self.due.get()[0] <= at:
                return
            self.handle.deleteTimer(self.due.get()[0])
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        events = [(k, t, a.to_pydatetime(), None if pd.isna(v) else v) for k, t, a, v in zip(new["kind"], new["trigger"], new["at"], new["value"])]
        if events:
            self.waiting.appendList(events)
            self._due(min(_ms(e[2]) for e in events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(e) for e in self.waiting.get()]
        ripe, rest = [e for e in waiting if _ms(e[2]) <= passed], [e for e in waiting if _ms(e[2]) > passed]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.due.clear()
        self._due(min((_ms(e[2]) for e in rest), default=None))
        changed: dict[tuple[str, str], tuple | None] = {}
        for kind, trigger, at, value in sorted(ripe, key=lambda e: (e[2], e[3] is not None, e[3] or "")):
            at_key = (kind, trigger)
            entry = changed[at_key] if at_key in changed else tuple(self.known.getValue(at_key)) if self.known.containsKey(at_key) else None
            changed[at_key] = _applied(entry, kind, at, value)
        out = [(key[0], *k, *entry) for k, entry in changed.items() if entry is not None]
        for r in out:
            self.known.updateValue((r[1], r[2]), r[3:])
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def _ms(at: datetime.datetime) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def memory_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Events of one shape from correction_events' and from pages (signature, at, backend, model, corrected, rows): each page is seen, and where it has rows, the share of them that was corrected is its backend's and its model's."""
    share = F.when(F.col("rows") > 0, (F.col("corrected") / F.col("rows")).cast("string"))
    listed = F.array(F.struct(F.lit(PAGE).alias("kind"), F.lit("").alias("trigger"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(k).alias("kind"), F.col(k).alias("trigger"), share.alias("value")) for k in RATES))
    seen = pages.where("signature is not null").select("signature", "at", F.explode(listed).alias("e")).select("signature", "e.kind", "e.trigger", "at", "e.value").where((F.col("kind") == PAGE) | ((F.col("trigger") != "") & F.col("value").isNotNull()))
    return events.select("signature", "kind", "trigger", "at", "value").unionByName(seen)


def stream_template_memory(events: DataFrame, known: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """MEMORY's rows, those that changed with each batch, of a stream of events (signature, kind, trigger, at timestamp, value; value null: a confirmation; see memory_events).

    As operators.templates.fold_rules and correction_rates over all events that are no more than `late` behind the newest, in whatever order they come; later ones go. An
    event counts once the watermark has passed it. known: MEMORY's rows to begin with, from the batch tables. A template is one group: its state is a row for each of its
    rules and rates, and what waits. Needs the RocksDB state store.
    """
    rows = events.select(events["signature"].cast("string").alias("signature"), "kind", "trigger", "at", events["value"].cast("string").alias("value")).where("signature is not null")
    keyed = rows.withWatermark("at", late).groupBy("signature")
    begun = None if known is None else known.select(*_COLUMNS).groupBy("signature")
    return keyed.transformWithStateInPandas(TemplateMemory(), MEMORY, "Update", "EventTime", begun)
