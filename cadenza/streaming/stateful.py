"""Reviews and budgets as keyed state on `transformWithState`, and the same steps over sorted tables.

On a stream, members of a bank, first decisions and reservations are map state, so a step touches only the entries it needs, and what a batch has found out is the initial state. In batch, rows sorted by
key and seq pass through the same steps, batch by batch of Arrow, so no group lies in memory as a whole. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Store(Protocol):
    """Entries by name: a dict, or map state."""

    def get(self, key: str): ...

    def put(self, key: str, value) -> None: ...


class Held(dict):
    """A store in memory."""

    def put(self, key: str, value) -> None:
        self[key] = value


class Kept:
    """A store in map state of one value column."""

    def __init__(self, state):
        self.state = state

    def get(self, key: str):
        found = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return None if found is None else found[0]

    def put(self, key: str, value) -> None:
        self.state.updateValue((key,), (value,))


@dataclass
class Reviewing:
    """Where an arm stands: the stage that is due, the query that is open, reviews asked of people, version and size of the bank, the last seq."""

    stage: str = "summary"
    query: str | None = None
    reviews: int = 0
    version: int = 0
    members: int = 0
    last: int = -1


def review_step(at: Reviewing, row: dict, bank: Store, decided: Store, adaptive: bool, budget: int) -> str:
    """What comes of a row (seq, query, stage, action, label), and `at`, bank and decided as it leaves them.

    A summary that needs review goes to retrieval; a retrieval that needs it goes to a person while the budget lasts. The person's label joins the bank of an adaptive arm. A query's first decision stands. Rows that
    are late, of another stage or query than is due, of a query decided or in the bank, of no known action, or without the label they need are refused and change nothing.
    """
    query, stage = row["query"], row["stage"]
    labelled = isinstance(row["label"], str) and row["label"] != ""
    wrong = row["seq"] <= at.last or stage != at.stage or query is None or (at.query is not None and query != at.query)
    if wrong or bank.get(query) is not None or decided.get(query) is not None or (stage == "human" or row["action"] == "accept") and not labelled or stage != "human" and row["action"] not in ("accept", "review"):
        return "refused"
    at.last = row["seq"]
    if stage == "human":
        decided.put(query, row["label"])
        at.stage, at.query, at.reviews = "summary", None, at.reviews + 1
        if adaptive:
            bank.put(query, row["label"])
            at.version, at.members = at.version + 1, at.members + 1
        return "labelled"
    if row["action"] == "accept":
        decided.put(query, row["label"])
        at.stage, at.query = "summary", None
        return "accepted"
    if stage == "summary":
        at.stage, at.query = "retrieval", query
        return "retrieve"
    if at.reviews >= budget:
        decided.put(query, "")
        at.stage, at.query = "summary", None
        return "budget_exhausted"
    at.stage, at.query = "human", query
    return "ask"


_REVIEWED = "arm string, seq long, query string, stage string, outcome string, reviews int, version int, members int"


def _reviewed(arm: str, at: Reviewing, row: dict, bank: Store, decided: Store, budget: int) -> tuple:
    came = review_step(at, row, bank, decided, arm.startswith("adaptive"), budget)
    return arm, row["seq"], row["query"], row["stage"], came, at.reviews, at.version, at.members


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=names)


def _plain(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows as dicts; what is missing is None."""
    return (r for r in frame.astype(object).where(frame.notna(), None).to_dict("records"))


class Review(StatefulProcessor):
    """`review_step` on a stream. Initial state are rows (arm, member, label) of the bank."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "stage string, query string, reviews int, version int, members int, last long")
        self.bank = handle.getMapState("bank", "member string", "label string")
        self.decided = handle.getMapState("decided", "query string", "label string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        at = Reviewing(*self.head.get()) if self.head.exists() else Reviewing()
        bank = Kept(self.bank)
        for row in _plain(initialState):
            at.members += bank.get(row["member"]) is None
            bank.put(row["member"], row["label"])
        self.head.update(tuple(vars(at).values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = Reviewing(*self.head.get()) if self.head.exists() else Reviewing()
        bank, decided = Kept(self.bank), Kept(self.decided)
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [_reviewed(key[0], at, row, bank, decided, self.budget) for row in _plain(frame)]
        self.head.update(tuple(vars(at).values()))
        yield _frame(out, _REVIEWED)

    def close(self) -> None:
        pass


def stream_reviews(events: DataFrame, bank: DataFrame, budget: int) -> DataFrame:
    """events (arm, seq, query, stage, action, label) of a stream with what came of each, arms beginning with the members of bank (arm, member, label). The session's state store must be STATE_STORE."""
    return events.groupBy("arm").transformWithStateInPandas(Review(budget), _REVIEWED, "Append", "None", bank.select("arm", "member", "label").groupBy("arm"))


def _folded(events: DataFrame, key: str, schema: str, start: Callable, step: Callable, end: Callable) -> DataFrame:
    """Rows sorted by key and seq, through a state that starts anew with each key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out: list[tuple] = []
            for row in _plain(frame):
                if state is None or row[key] != now:
                    if state is not None:
                        out += end(now, state)
                    now, state = row[key], start()
                out += step(now, state, row)
            if out:
                yield _frame(out, schema)
        if state is not None and (out := end(now, state)):
            yield _frame(out, schema)

    return events.repartition(key).sortWithinPartitions(key, "seq").mapInPandas(run, schema)


def run_reviews(events: DataFrame, bank: DataFrame, budget: int) -> DataFrame:
    """`stream_reviews` over a table. Members of an arm come before its rows; an arm without rows gives none."""
    seeds = bank.select("arm", F.lit(-1).cast("long").alias("seq"), F.col("member").alias("query"), F.lit("seed").alias("stage"), F.lit(None).cast("string").alias("action"), "label")

    def step(arm: str, state: tuple, row: dict) -> list[tuple]:
        at, members, decided = state
        if row["stage"] == "seed":
            at.members += members.get(row["query"]) is None
            members.put(row["query"], row["label"])
            return []
        return [_reviewed(arm, at, row, members, decided, budget)]

    return _folded(seeds.unionByName(events.select(*seeds.columns)), "arm", _REVIEWED, lambda: (Reviewing(), Held(), Held()), step, lambda arm, state: [])


@dataclass(frozen=True)
class Budget:
    """Requests of a run at most; cents that each reserves; milliseconds after which one that hasn't ended counts as lost."""

    most: int
    reserve: int
    lost: int


@dataclass
class Spending:
    requests: int = 0
    spent: int = 0
    last: int = -1


def ledger_step(at: Spending, row: dict, requests: Store, limit: Budget) -> list[tuple]:
    """(seq, request, outcome, requests, spent) of an event (seq, millis, kind, request, cost); requests holds `seq:millis:state` of each request, for ever.

    A reservation costs its reserve at once: `reserved`, or `over_cap`, or `repeated` where the request was tried before. Its end gives back what wasn't spent: `settled`; `kept` if the cost isn't known;
    `excess` if it is more than the reserve or below 0, which changes nothing. An end of no reservation is `unknown`, a second one `repeated`. One that comes after the request was lost is `late`; each lost request
    has one row `lost`, with no counters, as it comes when time has passed and not in the order of seq. Reserves of lost requests stay spent. Rows out of order are `refused`.
    """
    out: list[tuple] = []
    held = requests.get(row["request"])
    since, opened, state = (held.split(":") if held else (None, None, None))
    if row["seq"] <= at.last:
        came = "refused"
    else:
        at.last = row["seq"]
        if row["kind"] == "reserve":
            came = "repeated" if held else "over_cap" if at.requests >= limit.most else "reserved"
            if came == "reserved":
                at.requests, at.spent = at.requests + 1, at.spent + limit.reserve
                requests.put(row["request"], f"{row['seq']}:{row['millis']}:open")
        elif held is None:
            came = "unknown"
        elif state == "done":
            came = "repeated"
        elif state == "lost" or row["millis"] > int(opened) + limit.lost:
            if state == "open":
                out.append((int(since), row["request"], "lost", None, None))
            came = "late"
            requests.put(row["request"], f"{since}:{opened}:done")
        elif row["cost"] is not None and not 0 <= row["cost"] <= limit.reserve:
            came = "excess"
        else:
            came = "kept" if row["cost"] is None else "settled"
            at.spent += 0 if row["cost"] is None else int(row["cost"]) - limit.reserve
            requests.put(row["request"], f"{since}:{opened}:done")
    return [*out, (row["seq"], row["request"], came, at.requests, at.spent)]


_LEDGER = "run string, seq long, request string, outcome string, requests long, spent long"


class Ledger(StatefulProcessor):
    """`ledger_step` on a stream. A timer for each reservation says when it is lost, as far as the watermark has come."""

    def __init__(self, limit: Budget):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "requests long, spent long, last long")
        self.requests = handle.getMapState("requests", "request string", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = Spending(*self.head.get()) if self.head.exists() else Spending()
        store, out = Kept(self.requests), []
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for row in _plain(frame):
            found = ledger_step(at, row, store, self.limit)
            out += found
            if found[-1][2] == "reserved":
                self.handle.registerTimer(row["millis"] + self.limit.lost)
        self.head.update(tuple(vars(at).values()))
        yield _frame([(key[0], *r) for r in out], _LEDGER)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (request,), (held,) in list(self.requests.iterator()):
            since, opened, state = held.split(":")
            if state == "open" and int(opened) + self.limit.lost <= due:
                self.requests.updateValue((request,), (f"{since}:{opened}:lost",))
                out.append((key[0], int(since), request, "lost", None, None))
        if out:
            yield _frame(out, _LEDGER)

    def close(self) -> None:
        pass


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("millis", F.unix_millis("time"))


def stream_ledger(events: DataFrame, limit: Budget, delay: str = "10 minutes") -> DataFrame:
    """events (run, seq, time, kind, request, cost) of a stream with what came of each, and of lost requests; see `ledger_step`. The session's state store must be STATE_STORE."""
    return _timed(events.withWatermark("time", delay)).groupBy("run").transformWithStateInPandas(Ledger(limit), _LEDGER, "Append", "EventTime")


def run_ledger(events: DataFrame, limit: Budget, until: int | None) -> DataFrame:
    """`stream_ledger` over a table, as if the watermark had come to `until` in the end, in milliseconds; None for no lost requests but those whose end came late."""

    def end(run: str, state: tuple) -> list[tuple]:
        parts = ((request, *held.split(":")) for request, held in state[1].items())
        return [(run, int(since), request, "lost", None, None) for request, since, opened, kind in parts if kind == "open" and until is not None and int(opened) + limit.lost < until]

    return _folded(_timed(events).drop("time"), "run", _LEDGER, lambda: (Spending(), Held()), lambda run, state, row: [(run, *r) for r in ledger_step(state[0], row, state[1], limit)], end)
