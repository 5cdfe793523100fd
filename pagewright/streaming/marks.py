"""Page marks and captures as streams with keyed state and event-time timers.

``settled`` keeps the last status of each key while marks of it keep coming and gives it
out once the event time has passed its last mark by ``patience``: runs of marks, as
``settled_batch`` finds them in a table.  A mark that is repeated (same id) counts once,
marks may come in any order within the watermark's delay, and a mark that comes after
its run was given out is late: the watermark drops it.

``ends_of_books`` finds where repeated captures end a book whose captures come out of
order: a book's pages wait in state until all before them have come, or until the event
time has passed the arrival of the oldest waiting page by ``patience``, when what is
missing before it is given up.

Both need the RocksDB state store (see ``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def with_state_store(spark: SparkSession) -> None:
    """State with timers lives in RocksDB: on disk, with change logs in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


SETTLED = "key string, first_ts timestamp, last_ts timestamp, status string, n_marks long"


class Settling(StatefulProcessor):
    """Waiting marks of a key in one value, read and written once a call; a timer where the earliest run may be complete."""

    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "timer long, ids array<long>, us array<long>, statuses array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, marks = self.held()
        for batch in rows:
            for i, us, status in zip(batch["id"].tolist(), batch["ts"].to_numpy("datetime64[us]").astype("int64").tolist(), batch["status"].tolist()):
                marks.setdefault(i, (us, status))
        yield from self.settle(key, timer, marks, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, None, self.held()[1], timerValues.getCurrentWatermarkInMs())

    def held(self) -> tuple[int | None, dict[int, tuple]]:
        """The timer that is set, and the waiting marks by id."""
        timer, ids, us, statuses = self.waiting.get() or (None, [], [], [])
        return timer, dict(zip(ids, zip(us, statuses)))

    def settle(self, key, timer: int | None, marks: dict[int, tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Gives out complete runs, oldest first, and sets the timer for the next."""
        waiting = sorted((us, i) for i, (us, _) in marks.items())
        runs: list[list[tuple]] = []
        for mark in waiting:
            if not runs or mark[0] - runs[-1][-1][0] > self.patience * 1000:
                runs.append([])
            runs[-1].append(mark)
        # Beyond the patience after its last mark no mark of a run can come any more.
        ends = [run[-1][0] // 1000 + self.patience + 1 for run in runs]
        done = [run for run, end in zip(runs, ends) if end <= watermark]
        left = [mark for run in runs[len(done):] for mark in run]
        due = ends[len(done)] if left else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if left:
            self.waiting.update((due, [i for _, i in left], [us for us, _ in left], [marks[i][1] for _, i in left]))
        else:
            self.waiting.clear()
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), "first_ts": pd.to_datetime([r[0][0] for r in done], unit="us"), "last_ts": pd.to_datetime([r[-1][0] for r in done], unit="us"),
                                "status": [marks[r[-1][1]][1] for r in done], "n_marks": [len(r) for r in done]})


def settled(marks: DataFrame, patience: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of a stream of marks (key, id, ts, status) once they are complete: (key, first_ts, last_ts, status, n_marks)."""
    with_state_store(marks.sparkSession)
    rows = marks.where("key IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL").select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(
        Settling(int(pd.Timedelta(patience).total_seconds() * 1000)), outputStructType=SETTLED, outputMode="append", timeMode="EventTime")


def settled_batch(marks: DataFrame, patience: str = "30 minutes") -> DataFrame:
    """The same of a table of marks."""
    once = marks.withColumn("ts", F.col("ts").cast("timestamp")).where("key IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL").dropDuplicates(["key", "id"])
    order = Window.partitionBy("key").orderBy("ts", "id")
    gap = F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {patience}")
    runs = once.withColumn("begins", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("begins").over(order))
    return runs.groupBy("key", "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("status", F.struct("ts", "id")).alias("status"), F.count(F.lit(1)).alias("n_marks")).drop("run")


ENDED = "book string, last_page int"
#: Next page, digest, start, repeats and whether the book has ended, before its first capture.
NO_RUN = (1, None, 0, 0, False)


class Ending(StatefulProcessor):
    """A run of equal digests, and the captures that wait for those before them, in one value that is read and written once a call."""

    def __init__(self, stop: int, patience_ms: int) -> None:
        self.stop, self.patience = stop, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "next int, digest string, start int, repeats int, done boolean, timer long, pages array<int>, digests array<string>, arrived array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, timer, waiting = self.held()
        due = run[0] if run else None
        for batch in rows:
            for page, digest, ts in zip(batch["page_num"].tolist(), batch["digest"].tolist(), batch["ts"]):
                if due is None or page >= due:
                    waiting.setdefault(page, (digest, millis(ts)))
        yield from self.advance(key, run, timer, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, _, waiting = self.held()
        yield from self.advance(key, run, None, waiting, timerValues.getCurrentWatermarkInMs())

    def held(self) -> tuple[tuple | None, int | None, dict[int, tuple]]:
        """The run of equal digests, the timer that is set, and the waiting captures by page."""
        known = self.run.get()
        *run, timer, pages, digests, arrived = known or (*NO_RUN, None, [], [], [])
        return tuple(run) if known else None, timer, dict(zip(pages, zip(digests, arrived)))

    def advance(self, key, run: tuple | None, timer: int | None, waiting: dict[int, tuple], watermark: int) -> Iterator[pd.DataFrame]:
        due, digest, start, repeats, done = run or NO_RUN
        wake, ended = None, None
        for page in sorted(waiting):
            shot, arrived = waiting[page]
            if page > due and arrived + self.patience > watermark:
                # Something is missing before it: wait, until the patience with this page ends.
                wake = arrived + self.patience
                break
            del waiting[page]
            due = page + 1
            if done or self.stop < 1:
                continue
            if shot is not None and shot == digest:
                repeats += 1
                if repeats >= self.stop:
                    done, ended = True, start
            else:
                digest, start, repeats = shot, page, 0
        if timer != wake:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        self.run.update((due, digest, start, repeats, done, wake, list(waiting), [d for d, _ in waiting.values()], [at for _, at in waiting.values()]))
        if ended is not None:
            yield pd.DataFrame({"book": [key[0]], "last_page": [ended]})


def ends_of_books(captures: DataFrame, stop: int = 2, patience: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(book, last_page) from a stream of captures (book, page_num, digest, ts) in any order, as soon as a digest has repeated ``stop`` times in a row.

    Pages count from 1; of a page that comes again the first capture counts, and one that
    comes after it was given up is ignored.
    """
    with_state_store(captures.sparkSession)
    rows = captures.where("book IS NOT NULL AND page_num IS NOT NULL AND ts IS NOT NULL").select("book", "page_num", "digest", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy("book").transformWithStateInPandas(
        Ending(stop, int(pd.Timedelta(patience).total_seconds() * 1000)), outputStructType=ENDED, outputMode="append", timeMode="EventTime")


def fed(spark: SparkSession, chunks: list[DataFrame], end: DataFrame, made, base: str) -> DataFrame:
    """What the stream ``made`` (of a stream of such rows) gives out when the chunks arrive one after the other, and at last ``end``.

    Each chunk is one micro-batch of a query that starts anew from its checkpoint, as after a loss of the driver.
    """
    schema = end.schema
    for chunk in (*chunks, end):
        chunk.select(*schema.names).write.mode("append").parquet(f"{base}/in")
        made(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.outputMode("append").option("checkpointLocation", f"{base}/log").trigger(
            availableNow=True).format("parquet").start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out")
