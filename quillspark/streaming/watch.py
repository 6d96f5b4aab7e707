"""Incremental work: watched folders, rate limits over request streams, schedules and background tasks."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt", "html")) -> DataFrame:
    """Files that appear below a folder, as a stream ``(path, modificationTime, length, content)``."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def debounced(events: DataFrame, key: str = "path", ts: str = "ts", gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row ``(key, fired_at, events)`` for each run of events of a key that are less than ``gap`` apart; works on streams and tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.end").alias("fired_at"), "events")


def file_actions(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """``(path, action)`` of watched files ``(path, content)`` against what is indexed ``(path, raw_hash)``: index, reindex, skip or delete."""
    now = current.select("path", F.sha2("content", 256).alias("now"))
    joined = now.join(tracked.select("path", "raw_hash"), "path", "full")
    return joined.select("path", F.when(F.col("now").isNull(), "delete").when(F.col("raw_hash").isNull(), "index").when(F.col("now") == F.col("raw_hash"), "skip").otherwise("reindex").alias("action"))


def watch(spark: SparkSession, folder: str, state: str, on_index: Callable[[DataFrame], None], on_error: Callable[[Exception], None] = lambda e: None, extensions: tuple[str, ...] = ("md", "txt", "html")):
    """Hand new files of a folder to ``on_index``, batch by batch, over all that is there; ``state`` remembers what was seen.

    An error of a batch goes to ``on_error`` and does not end the watch.
    """

    def take(batch: DataFrame, _: int) -> None:
        try:
            if batch.limit(1).count():
                on_index(batch)
        except Exception as problem:
            on_error(problem)

    query = file_stream(spark, folder, extensions).writeStream.option("checkpointLocation", state).foreachBatch(take).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fixed_window_limit(requests: DataFrame, key: str = "user_id", ts: str = "ts", most: int = 120, window: str = "60 seconds") -> DataFrame:
    """``(key, window_start, requests, refused)`` of requests by fixed windows of time: those beyond ``most`` are refused."""
    counted = requests.groupBy(F.window(ts, window), key).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("window.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - most).alias("refused"))


def sliding_gate(requests: DataFrame, key: str = "user_id", ts: str = "ts", most: int = 50, seconds: int = 60) -> DataFrame:
    """Requests with ``in_window``, how many of the key's lie in the last ``seconds``, and ``waits``: whether there were ``most`` before it."""
    by = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, Window.currentRow)
    return requests.withColumn("in_window", F.count("*").over(by)).withColumn("waits", F.col("in_window") > most)


def high_water(rows: DataFrame, last: str | None, column: str) -> tuple[DataFrame, str | None]:
    """Rows changed after the mark ``last``, and the next mark."""
    new = rows if last is None else rows.where(F.col(column) > F.to_timestamp(F.lit(last)))
    mark = new.agg(F.date_format(F.max(column), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first()["m"]
    return new, mark or last


def cron_due(expression: str, when: time.struct_time) -> bool:
    """Whether a cron expression of five fields (lists, ranges, steps, *) holds for a minute."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    now = (when.tm_min, when.tm_hour, when.tm_mday, when.tm_mon, (when.tm_wday + 1) % 7)
    for field, value, (low, high) in zip(fields, now, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))):
        hit = False
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
            if not (low <= first <= last <= high) or (step and int(step) < 1):
                raise ValueError(f"bad field {field}")
            hit = hit or any(v == value or (high == 7 and v == 7 and value == 0) for v in range(first, last + 1, int(step or 1)))
        if not hit:
            return False
    return True


class Scheduler:
    """Runs jobs on cron schedules, each at most once at a time; ``stop`` waits for those that run."""

    def __init__(self):
        self.jobs: dict[str, tuple[str, Callable[[], None]]] = {}
        self.running: dict[str, threading.Thread] = {}
        self.failures: dict[str, Exception] = {}

    def add(self, name: str, schedule: str, job: Callable[[], None]) -> None:
        cron_due(schedule, time.gmtime(0))
        self.jobs[name] = (schedule, job)

    def tick(self, when: time.struct_time) -> list[str]:
        """Start what is due; the names started. A job that still runs is passed over."""
        started = []
        for name, (schedule, job) in self.jobs.items():
            if cron_due(schedule, when) and not (name in self.running and self.running[name].is_alive()):
                self.running[name] = threading.Thread(target=self._run, args=(name, job), daemon=True)
                self.running[name].start()
                started.append(name)
        return started

    def _run(self, name: str, job: Callable[[], None]) -> None:
        try:
            job()
        except Exception as problem:
            self.failures[name] = problem

    def stop(self, seconds: float = 30) -> bool:
        """Wait for running jobs, ``seconds`` at most; whether all ended."""
        end = time.monotonic() + seconds
        for thread in self.running.values():
            thread.join(max(0.0, end - time.monotonic()))
        return not any(t.is_alive() for t in self.running.values())


class Tasks:
    """Background tasks by number: state, result, cancelling; those that ended are forgotten after ``keep`` seconds."""

    def __init__(self, keep: float = 3600, now: Callable[[], float] = time.monotonic):
        self.keep, self.now, self.tasks, self.lock = keep, now, {}, threading.Lock()

    def start(self, work: Callable[[threading.Event], object]) -> str:
        name, stop = uuid.uuid4().hex[:12], threading.Event()
        task = {"state": "running", "result": None, "ended": None, "stop": stop}
        with self.lock:
            self.tasks[name] = task

        def run() -> None:
            try:
                result, state = work(stop), "completed"
            except Exception as problem:
                result, state = str(problem), "failed"
            with self.lock:
                task.update(state="cancelled" if stop.is_set() else state, result=result, ended=self.now())

        task["thread"] = threading.Thread(target=run, daemon=True)
        task["thread"].start()
        return name

    def get(self, name: str) -> dict:
        with self.lock:
            for n in [n for n, t in self.tasks.items() if t["ended"] is not None and self.now() - t["ended"] > self.keep]:
                del self.tasks[n]
            if name not in self.tasks:
                raise LookupError(f"Task not found: {name}")
            return {k: self.tasks[name][k] for k in ("state", "result")}

    def cancel(self, name: str) -> bool:
        self.get(name)
        self.tasks[name]["stop"].set()
        return self.tasks[name]["state"] == "running"

    def wait(self, name: str) -> dict:
        self.tasks[name]["thread"].join()
        return self.get(name)
