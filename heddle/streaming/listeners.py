"""Hooks around streams: what a middleware sees of a call, a listener sees of a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Call:
    """One streaming query: its name, rows read so far, and, when it has ended, its error or None."""

    name: str | None
    rows: int = 0
    ended: bool = False
    error: str | None = None


@dataclass
class Calls(StreamingQueryListener):
    """Keeps a Call for each query; ``hook`` hears of ("started" | "progress" | "ended", call)."""

    hook: Callable[[str, Call], None] | None = None
    calls: dict[str, Call] = field(default_factory=dict)

    def _told(self, what: str, call: Call) -> None:
        if self.hook:
            self.hook(what, call)

    def onQueryStarted(self, event) -> None:
        call = self.calls[str(event.runId)] = Call(event.name)
        self._told("started", call)

    def onQueryProgress(self, event) -> None:
        call = self.calls.setdefault(str(event.progress.runId), Call(event.progress.name))
        call.rows += event.progress.numInputRows
        self._told("progress", call)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        call = self.calls.setdefault(str(event.runId), Call(None))
        call.ended, call.error = True, event.exception
        self._told("ended", call)


@contextmanager
def listening(spark: SparkSession, hook: Callable[[str, Call], None] | None = None) -> Iterator[Calls]:
    """A listener for the streams that run inside the block."""
    calls = Calls(hook)
    spark.streams.addListener(calls)
    try:
        yield calls
    finally:
        spark.streams.removeListener(calls)
