"""What runs the engine beside its tables: the queue of documents, the switch of models, events, and caches with a lifetime.

All of it is the driver's, small, and takes its clock as an argument, so tests need no waiting. Work itself is Spark jobs.
"""

from __future__ import annotations

import os
import time
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Hashable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("index", "indexer", "model", "models", "history", "duplicates")
#: A task silent for so many seconds is stalled.
SILENT = 180


class Events:
    """Listeners by channel. One that fails doesn't keep the others from hearing."""

    def __init__(self, failed: Callable[[str, Exception], Any] = lambda channel, error: None):
        self.listeners: dict[str, list[Callable]] = defaultdict(list)
        self.failed = failed

    def on(self, channel: str, listener: Callable[..., Any]) -> Callable[[], None]:
        """Listen; the answer ends it."""
        if channel not in CHANNELS:
            raise ValueError(f"no channel {channel}")
        self.listeners[channel].append(listener)

        def off() -> None:
            if listener in self.listeners[channel]:
                self.listeners[channel].remove(listener)

        return off

    def emit(self, channel: str, *args: Any) -> int:
        """Tell all; how many heard it."""
        heard = 0
        for f in list(self.listeners[channel]):
            try:
                f(*args)
                heard += 1
            except Exception as e:  # noqa: BLE001 - a listener's failure is its own
                self.failed(channel, e)
        return heard


class Queue:
    """Documents to index, each with the models that want it. Asked for twice, a document's models are united."""

    def __init__(self, events: Events | None = None):
        self.waiting: OrderedDict[str, set[str]] = OrderedDict()
        self.running: dict[str, set[str]] = {}
        self.paused, self.group = False, "glossator-index"
        self.events = events or Events()

    def add(self, documents: Iterable[tuple[str, Iterable[str]]], first: bool = False) -> None:
        """first: before all that wait, in the order given."""
        new = []
        for key, models in documents:
            wanted = set(models) - self.running.get(key, set())
            if wanted:
                new.append(key)
                self.waiting.setdefault(key, set()).update(wanted)
        for key in reversed(new) if first else ():
            self.waiting.move_to_end(key, last=False)
        self.events.emit("indexer")

    def take(self, n: int = 1) -> list[tuple[str, list[str]]]:
        """The next n documents, now running; none while paused."""
        out = []
        while self.waiting and len(out) < n and not self.paused:
            key, models = self.waiting.popitem(last=False)
            self.running[key] = models
            out.append((key, sorted(models)))
        return out

    def done(self, key: str) -> bool:
        """A document has ended; whether the pass is complete."""
        self.running.pop(key, None)
        self.events.emit("indexer")
        return not self.waiting and not self.running

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def cancel(self, spark: SparkSession | None = None) -> list[str]:
        """Empty the queue and end what runs; the running documents."""
        gone = list(self.running)
        self.waiting.clear()
        self.running.clear()
        self.paused = False
        if spark is not None:
            spark.sparkContext.cancelJobGroup(self.group)
        self.events.emit("indexer")
        return gone

    def drop_target(self, model: str) -> None:
        """Nothing waits for that model any more."""
        for key in list(self.waiting):
            self.waiting[key].discard(model)
            if not self.waiting[key]:
                del self.waiting[key]


class Switch:
    """The active model, and the one that is being built to follow it.

    choose: missing files are fetched, then passages built beside the active ones; the pointer moves when a whole pass is done.
    """

    def __init__(self, active: str, events: Events | None = None):
        self.active, self.building, self.state = active, None, "ready"
        self.events = events or Events()

    def choose(self, model: str, ready: bool, indexed: bool = False) -> str:
        if model == self.active:
            self.building, self.state = None, "ready"
        elif indexed and ready:  # its passages are complete already
            self._promote(model)
        else:
            self.building, self.state = model, "building" if ready else "downloading"
        self.events.emit("models")
        return self.state

    def downloaded(self, fine: bool = True) -> str:
        if self.building and self.state == "downloading":
            self.state = "building" if fine else "error"
            self.events.emit("models")
        return self.state

    def pass_complete(self) -> bool:
        """A pass over the library has ended; whether the model changed."""
        if self.building and self.state == "building":
            self._promote(self.building)
            return True
        return False

    def use_now(self) -> None:
        """Before the pass is complete."""
        if self.building and self.state == "building":
            self._promote(self.building)

    def cancel(self) -> str | None:
        """The model that isn't built any more."""
        gone, self.building, self.state = self.building, None, "ready"
        self.events.emit("models")
        return gone

    def _promote(self, model: str) -> None:
        self.active, self.building, self.state = model, None, "ready"
        self.events.emit("model", model)

    def targets(self) -> list[str]:
        """The models that new documents are indexed for."""
        return [self.active] + ([self.building] if self.building and self.state == "building" else [])

    def deletable(self, model: str) -> bool:
        return model not in (self.active, self.building)


class Active:
    """Stands for whatever ``target`` gives at the time of use; own attributes come first."""

    def __init__(self, target: Callable[[], Any], **own: Any):
        self.__dict__.update(own, _target=target)

    def __getattr__(self, name: str) -> Any:
        return getattr(self._target(), name)


class Remembered:
    """Values with a lifetime, the latest used ``most`` of them."""

    def __init__(self, seconds: float = 300, most: int = 200, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.held: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            self.held.move_to_end(key)
            return self.held[key][1]
        value = make()
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return value


def readiness(folder: str, files: dict[str, int]) -> tuple[str, list[str]]:
    """ready or missing, and the files to fetch, the smallest first. files: exact size by name."""
    lacking = [n for n, size in files.items() if not os.path.isfile(p := os.path.join(folder, n)) or os.path.getsize(p) != size]
    return ("missing" if lacking else "ready"), sorted(lacking, key=lambda n: (files[n], n))


def stalled(beats: DataFrame, now: Column, seconds: int = SILENT) -> DataFrame:
    """(worker, last): workers of beats (worker, ts) that have said nothing for that long."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last"))
    return last.where(F.unix_seconds(now) - F.unix_seconds("last") >= seconds)


def within_budget(documents: DataFrame, seconds: float, cost: str = "seconds") -> DataFrame:
    """documents (id, place, text, seconds): texts that are known cost nothing, others are read in order until the time is up;
    the rest stays null and is marked pending. One request's documents; place is their order."""
    from pyspark.sql import Window

    before = Window.partitionBy("request").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("cached"), 0.0).otherwise(F.col(cost))
    late = ~F.col("cached") & (F.coalesce(F.sum(own).over(before), F.lit(0.0)) >= seconds)
    return documents.withColumn("text_pending", late).withColumn("text", F.when(~F.col("text_pending"), F.col("text")))
