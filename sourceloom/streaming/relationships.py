"""Relationships of statements that arrive in any order, closed by timers.

A cursor's or transaction's statements may lie in different arrivals, and a late DECLARE
or COMMIT changes the groups around it. So each key keeps what has arrived of it, as
small rows of lines and kinds, and gives its groups once nothing has come for a
while: when the watermark is ``idle`` beyond its last arrival. They equal those of the
batch operators over the same statements, whatever the order of arrival. Statements
of a key that come after its groups are given start anew, as a file that is sent again does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relations import _CURSOR, BOUNDARIES
from ..session import ship

_STATE = "lines array<long>, kinds array<string>, places array<string>, last long"
CURSOR_GROUPS = "file_id {key}, name string, decl long, declare_line long, open_line long, close_line long, fetches long, is_loop boolean, reads_rows boolean, relationship_id string"
TRANSACTIONS = "file_id {key}, function string, boundary_line long, statements long, has_rollback boolean, is_commit boolean, relationship_id string"


def cursor_rows(key: tuple, events: list[tuple[int, str, str]]) -> Iterator[tuple]:
    """Groups of one cursor name in a file from its (line, kind, whether it has outputs)."""
    groups: list[dict] = []
    for line, kind, out in sorted(events):
        if kind == "declare_cursor":
            groups.append({"declare": line, "open": None, "close": None, "fetches": 0, "out": False})
        elif groups:
            g = groups[-1]
            if kind == "fetch_into":
                g["fetches"] += 1
                g["out"] |= out == "out"
            elif kind == "open_cursor":
                g["open"] = line if g["open"] is None else g["open"]
            else:
                g["close"] = line if g["close"] is None else g["close"]
    for k, g in enumerate(groups, 1):
        loop = g["fetches"] > 1
        yield (*key, k, g["declare"], g["open"], g["close"], g["fetches"], loop, loop or g["out"], f"cursor_{key[1]}_{k:03d}")


def transaction_rows(key: tuple, events: list[tuple[int, str, str]]) -> Iterator[tuple]:
    """Transactions of a file from its statements' (line, kind, function)."""
    ends = sorted((line, kind, function) for line, kind, function in events if kind in BOUNDARIES)
    number = {line: k for k, (line, _, _) in enumerate(ends, 1)}
    for function in sorted({f for _, _, f in events}):
        own = [(line, kind) for line, kind, f in ends if f == function]
        last_rollback = max((line for line, kind in own if kind == "rollback"), default=None)
        counts: dict[int, int] = {}
        for line, kind, f in events:
            if f == function and kind not in BOUNDARIES and kind != "connect":
                after = next((b for b, _ in own if b > line), None)
                if after is not None:
                    counts[after] = counts.get(after, 0) + 1
        for boundary, kind in own:
            if boundary in counts:
                yield (*key, function, boundary, counts[boundary], last_rollback is not None and last_rollback > boundary, kind == "commit", f"transaction_{number[boundary]:03d}")


def _closing(stmts: DataFrame, keys: list[str], rows: Callable[[tuple, list], Iterator[tuple]], schema: str, late: str, idle: timedelta) -> DataFrame:
    """Rows (keys, line_start, kind, place, arrived) by key, held until the key is idle."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(stmts.sparkSession)
    wait = int(idle.total_seconds() * 1000)
    names = [c.split()[0] for c in schema.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            lines, kinds, places, _ = state.get
            state.remove()
            yield pd.DataFrame(list(rows(key, list(zip(lines, kinds, places)))), columns=names)
            return
        lines, kinds, places, last = state.get if state.exists else ([], [], [], 0)
        lines, kinds, places = list(lines), list(kinds), list(places)
        for frame in frames:
            lines += frame["line_start"].tolist()
            kinds += frame["kind"].tolist()
            places += frame["place"].tolist()
            last = max(last, int(frame["arrived"].max().timestamp() * 1000))
        state.update((lines, kinds, places, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(columns=names)

    watched = stmts.withWatermark("arrived", late)
    return watched.groupBy(*keys).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def arriving_cursor_groups(stmts: DataFrame, late: str = "1 minute", idle: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Cursor groups of arriving statements (file_id, line_start, sql_type, sql_text, arrived), as ``relations.cursor_groups`` has them."""
    kept = stmts.where(F.col("sql_type").isin("declare_cursor", "open_cursor", "fetch_into", "close_cursor")).select(
        "file_id",
        F.lower(F.regexp_extract("sql_text", _CURSOR, 1)).alias("name"),
        F.col("line_start").cast("long").alias("line_start"),
        F.col("sql_type").alias("kind"),
        F.when(F.regexp_like("sql_text", F.lit(r"(?is)\bINTO\s+:")), "out").otherwise("").alias("place"),
        "arrived",
    )
    key = stmts.schema["file_id"].dataType.simpleString()
    return _closing(kept.where("name <> ''"), ["file_id", "name"], cursor_rows, CURSOR_GROUPS.format(key=key), late, idle)


def arriving_transactions(stmts: DataFrame, late: str = "1 minute", idle: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Transactions of arriving statements (file_id, function, line_start, sql_type, arrived), as ``relations.transactions`` has them; a file is a key."""
    kept = stmts.select("file_id", F.col("line_start").cast("long").alias("line_start"), F.col("sql_type").alias("kind"), F.coalesce("function", F.lit("")).alias("place"), "arrived")
    key = stmts.schema["file_id"].dataType.simpleString()
    return _closing(kept, ["file_id"], transaction_rows, TRANSACTIONS.format(key=key), late, idle)
