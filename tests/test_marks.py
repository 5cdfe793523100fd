"""Streams with timers: any split into micro-batches gives the batch result; late and repeated marks."""

import datetime
import random

import pandas as pd
import pytest

from pagewright.operators.planning import truncate_repeats
from pagewright.streaming import marks

BEGIN = datetime.datetime(2024, 5, 1)
SCHEMA = "key string, id long, ts timestamp, status string"


def at(minutes: float) -> datetime.datetime:
    return BEGIN + datetime.timedelta(minutes=minutes)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1])
def test_any_split_gives_the_batch_result(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(f"k{rnd.randrange(4)}", i, at(rnd.randrange(600)), rnd.choice(["done", "failed", None])) for i in range(120)] + [(None, 500, at(3), "x"), ("k1", None, at(3), "x"), ("k1", 501, None, "x")]
    rows += rnd.sample(rows, 20)  # repeated marks, perhaps in another micro-batch
    # Disorder of less than the delay, then cuts at random places.
    rows.sort(key=lambda r: (r[2] or BEGIN) + datetime.timedelta(minutes=rnd.random() * 55))
    cuts = sorted(rnd.sample(range(1, len(rows)), 3))
    chunks = [frame(spark, rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    got = marks.fed(spark, chunks, frame(spark, [("end", -1, at(9000), "x")]), lambda s: marks.settled(s, "20 minutes", "1 hour"), str(tmp_path)).where("key <> 'end'")
    want = marks.settled_batch(frame(spark, rows), "20 minutes")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 8


def test_a_mark_after_its_run_was_given_out_is_late(spark, tmp_path):
    chunks = [frame(spark, [("a", 1, at(0), "running"), ("a", 2, at(5), "done")]), frame(spark, [("b", 3, at(300), "x")]), frame(spark, [("a", 4, at(6), "late")])]
    got = marks.fed(spark, chunks, frame(spark, [("end", -1, at(900), "x")]), lambda s: marks.settled(s, "20 minutes", "10 minutes"), str(tmp_path)).where("key = 'a'").collect()
    assert [(r["status"], r["n_marks"], r["last_ts"]) for r in got] == [("done", 2, at(5))]


def test_captures_out_of_order_and_missing_pages(spark, tmp_path):
    rnd = random.Random(4)
    digests = {"early": "ABCCCDDD", "none": "ABABAB", "nulls": [None] * 5, "gap": ["A", "B", "-", "B", "B", "B"]}
    rows = [(b, n + 1, d, at(rnd.random() * 30)) for b, ds in digests.items() for n, d in enumerate(ds) if d != "-"]
    rows += [("early", 3, "Z", at(31))]  # page 3 again: the first capture counts
    rows.sort(key=lambda r: (r[3] > at(30), rnd.random()))
    schema = "book string, page_num int, digest string, ts timestamp"
    make = lambda x: spark.createDataFrame(x, schema)
    got = marks.fed(spark, [make(rows[:7]), make(rows[7:15]), make(rows[15:])], make([("end", 1, None, at(9000))]), lambda s: marks.ends_of_books(s, 2, "2 hours", "1 hour"), str(tmp_path)).collect()
    want = truncate_repeats(make([r for r in rows if r[3] <= at(30)]).select("book", "page_num", "digest"), 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("early", 3), ("gap", 2)]


class Handle:
    """A state store that counts the calls to it."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            if name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.remove)(args[0])
            return self if name.startswith("getV") else self.value is not None

        return call


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_state_is_read_and_written_once_a_call_whatever_the_rows():
    """Each mark was a call or two to the state store, and a few hundred marks a key took most of the time."""
    day = pd.Timestamp("2024-05-01")
    batch = pd.DataFrame({"id": range(1000), "ts": [day + pd.Timedelta(hours=i) for i in range(1000)], "status": ["x"] * 1000})
    handle, process = Handle(), marks.Settling(6 * 3_600_000)
    process.init(handle)
    end = int((day + pd.Timedelta(hours=2000)).value // 1_000_000)
    assert list(process.handleInputRows(("k",), iter([batch, batch]), Watermark(0))) == [] and handle.calls <= 6 and len(handle.timers) == 1
    out = list(process.handleExpiredTimer(("k",), Watermark(end), None))
    assert out[0]["n_marks"].tolist() == [1000] and handle.value is None and handle.calls <= 10
    shots = pd.DataFrame({"page_num": range(2, 1002), "digest": [str(i // 500) for i in range(1000)], "ts": [day] * 1000})
    handle, process = Handle(), marks.Ending(2, 3_600_000)
    process.init(handle)
    assert list(process.handleInputRows(("b",), iter([shots]), Watermark(0))) == [] and handle.calls <= 6 and len(handle.timers) == 1
    out = list(process.handleExpiredTimer(("b",), Watermark(end), None))
    assert out[0]["last_page"].tolist() == [2] and handle.calls <= 10
