"""The quality gate as a stream: the last good rows of a venue are carried as state from run to run."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from placard.operators.gate import OK

ROW = "pos bigint, source_url string, title string, opens string, closes string"
RUNS = f"venue_id string, run bigint, {ROW}"
#: A run of a venue as one row: its rows as the text of a JSON list.
TURNS = "venue_id string, run bigint, records string"
_JUDGED = "venue_id string, run bigint, verdict string, had bigint, got bigint, consecutive_failures bigint, status string"
GATED = f"{_JUDGED}, {ROW}"
VENUES_OF_A_KEY = 50
_FIELDS = [f.split()[0] for f in ROW.split(", ")]


def verdict(fresh: list[tuple], kept: list[tuple], fewest: int) -> str:
    """As ``operators.gate.verdicts`` has it, for one venue's fresh and kept rows (pos, source_url, title, opens, closes)."""
    if not kept or not fresh:
        return "emptied" if kept else OK
    old = {r[1]: r for r in sorted(kept, key=lambda r: r[0]) if r[1] is not None}
    pairs = [(r, old[r[1]]) for r in fresh if r[1] in old]
    if len(pairs) < fewest:
        return OK
    if all(a[3:] != b[3:] for a, b in pairs):
        return "dates_shifted"
    return "retitled" if all(a[2] != b[2] for a, b in pairs) else OK


def _parsed(text: str) -> list[tuple]:
    rows = [tuple(map(r.get, _FIELDS)) for r in json.loads(text)]
    rows.sort(key=lambda r: r[0])
    return rows


class Gate(StatefulProcessor):
    """State of a key's venues: the last good rows of each, as the text that they came in, and how many runs in a row have failed.

    A call to the state is a message to the JVM, a key's rows are a batch of their own there, and each value of a row is turned by
    itself; so a key may have many venues, one value holds their whole state, and one text holds a run's rows, which Spark takes apart.
    """

    def __init__(self, fewest: int = 3, stale_at: int = 3):
        self.fewest, self.stale_at = fewest, stale_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "venue_ids array<string>, failures array<bigint>, kept array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        venues: dict[str, dict[int, list[str]]] = {}
        for r in rows:
            fresh = venues.setdefault(r.venue_id, {}).setdefault(r.run, [])
            if r.records != "[]":
                fresh.append(r.records)
        was = self.state.get()
        state = {v: (n, text) for v, n, text in zip(*was, strict=True)} if was else {}
        changed = False
        for venue_id, runs in venues.items():
            failures, shown = state.get(venue_id, (0, "[]"))
            kept = _parsed(shown)
            for run in sorted(runs):
                text = f"[{','.join(t[1:-1] for t in runs[run])}]"
                fresh = _parsed(text)
                said = verdict(fresh, kept, self.fewest)
                had = len(kept)
                if said == OK:
                    kept, shown = fresh, text
                failures = 0 if said == OK else failures + 1
                status = "ok" if said == OK else "stale" if failures >= self.stale_at else "suspect"
                yield Row(venue_id=venue_id, run=run, verdict=said, had=had, got=len(fresh), consecutive_failures=failures, status=status, records=shown)
            if state.get(venue_id) != (failures, shown):
                state[venue_id], changed = (failures, shown), True
        if changed:
            self.state.update((list(state), [n for n, _ in state.values()], [text for _, text in state.values()]))

    def close(self) -> None:
        pass


def _titled() -> Column:
    return F.when(F.coalesce(F.col("title") != "", F.lit(False)), F.struct(*_FIELDS))


def turns(rows: DataFrame, runs: int) -> DataFrame:
    """``TURNS`` of a table of ``RUNS`` that has the runs 0 to ``runs`` - 1: each venue has a turn in every one."""
    lists = [F.to_json(F.collect_list(F.when(F.col("run") == run, _titled()))) for run in range(runs)]
    return rows.groupBy("venue_id").agg(F.array(*lists).alias("lists")).select("venue_id", F.posexplode("lists").alias("run", "records")).withColumn("run", F.col("run").cast("bigint"))


def gated(runs: DataFrame, fewest: int = 3, stale_at: int = 3) -> DataFrame:
    """A stream of ``runs`` (``RUNS``) to what each run publishes (``GATED``), as ``gate.published`` and ``gate.next_health`` would
    have it run after run.

    A venue that has a turn in a run has a row of it, with a null title if it gave nothing. Each published row comes with the verdict
    and health of its venue; a venue that publishes nothing has one row without a title. The runs of one batch are taken in
    order; a run must not be split over batches. A key's state is its venue's rows. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    return gated_turns(runs.select("venue_id", "run", F.to_json(F.array_compact(F.array(_titled()))).alias("records")), fewest, stale_at)


def gated_turns(turns: DataFrame, fewest: int = 3, stale_at: int = 3, keys: int | None = None) -> DataFrame:
    """As ``gated``, for a stream of ``TURNS``: far fewer values pass through Python, as a venue's rows of a run are one text.

    ``keys``: so many keys share the venues, if not each has its own. A key costs some milliseconds a batch, whatever it has; about
    ``VENUES_OF_A_KEY`` venues make that little, and the state that is written anew when one of them changes still small. It holds as
    long as the checkpoint.
    """
    key = F.col("venue_id") if keys is None else F.pmod(F.xxhash64("venue_id"), F.lit(keys))
    judged = turns.withColumn("key", key).groupBy("key").transformWithState(Gate(fewest, stale_at), f"{_JUDGED}, records string", "Append", "None")
    shown = F.explode_outer(F.from_json("records", f"array<struct<{ROW}>>")).alias("r")
    return judged.select(*(c for c in judged.columns if c != "records"), shown).select("*", "r.*").drop("r")
