"""A player as a stateful stream: commands and ticks in, the frame on screen out.

Input rows: session, at (order), kind and t_ns. Kinds: 'packet' (frame n with its pts), 'play', 'pause', 'seek' (to
t_ns; starts a new generation), 'tick' (the wall clock) and 'end' (no more packets of the generation). State of a session: the frames that wait, the
frame on screen, the clock and the generation. Rows of an older generation are dropped, whatever the arrival order
across micro-batches. One row comes out for each tick.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session long, at long, t_ns long, shown long, changed boolean, status string, dropped long"
STATE = "frames string, shown long, clock long, wall long, status string, gen long, ended boolean"
INPUT = "session long, at long, kind string, t_ns long, n long, gen long"


class Player:
    """Paused, playing or stopped. The newest frame at or before the clock is shown; frames that it passes are dropped."""

    def __init__(self, saved: tuple | None = None) -> None:
        frames, self.shown, self.clock, self.wall, self.status, self.gen, self.ended = saved or ("", -1, 0, 0, "paused", 0, False)
        self.frames = [tuple(map(int, x.split(":"))) for x in frames.split(",") if x]
        self.dropped = 0

    def saved(self) -> tuple:
        return ",".join(f"{p}:{n}" for p, n in self.frames), self.shown, self.clock, self.wall, self.status, self.gen, self.ended

    def _advance(self) -> bool:
        """Shows the newest frame that is due."""
        due = bisect.bisect_right(self.frames, (self.clock, 1 << 62))
        if not due and self.shown < 0 and self.frames:
            due = 1  # the first frame is shown before its time
        if due:
            self.dropped += due - 1
            self.shown = self.frames[due - 1][1]
            del self.frames[:due]
        if self.ended and not self.frames and self.status == "playing":
            self.status = "stopped"
        return bool(due)

    def feed(self, kind: str, t_ns: int, n: int, gen: int) -> tuple | None:
        if kind == "seek":
            self.gen, self.clock, self.frames, self.shown, self.ended = gen, t_ns, [], -1, False
            self.status = "paused" if self.status == "stopped" else self.status
            return None
        if kind in ("packet", "end") and gen != self.gen:
            return None
        if kind == "packet":
            bisect.insort(self.frames, (t_ns, n))
        elif kind == "end":
            self.ended = True
        elif kind in ("play", "pause"):
            if self.status != "stopped":
                self.status = "playing" if kind == "play" else "paused"
            self.wall = t_ns
        elif kind == "tick":
            if self.status == "playing":
                self.clock += max(0, t_ns - self.wall)
            self.wall = t_ns
            changed = self._advance()
            out = t_ns, self.shown, changed, self.status, self.dropped
            self.dropped = 0
            return out
        return None


def _run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    player = Player(tuple(state.get) if state.exists else None)
    out = []
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")
    for at, kind, t_ns, n, gen in zip(rows["at"], rows["kind"], rows["t_ns"], rows["n"].fillna(-1), rows["gen"].fillna(0), strict=True):
        found = player.feed(kind, int(t_ns), int(n), int(gen))
        if found:
            out.append((key[0], int(at), *found))
    state.update(player.saved())
    yield pd.DataFrame(out, columns=["session", "at", "t_ns", "shown", "changed", "status", "dropped"])


def play(stream: DataFrame) -> DataFrame:
    """The player over a streaming frame of INPUT rows; append mode."""
    return stream.groupBy("session").applyInPandasWithState(_run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
