"""What Python workers hold: an executor keeps its workers, so their number and size add up over a pipeline's stages."""

import random
import tracemalloc

import numpy as np
import pandas as pd

from pagewright.llm import decontamination, minhash


def test_decontamination_takes_one_worker_a_task(spark, monkeypatch):
    """The cut was a second Arrow pass on top of the search, so every task had two workers."""
    phrase = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"before {i}, {phrase if i % 3 else 'no'} x; after", 0) for i in range(40)] + [(None, None, None), (77, phrase, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame([(i, f"{phrase} q{i}" if i else phrase) for i in range(60)], "item_id long, text string")
    clean = decontamination.decontaminate(docs, bench)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    cut = lambda i: f"before {i}, {'' if i % 3 else 'no'} x; after"
    want = sorted([(i, cut(i), len(cut(i)) if i % 3 else 0) for i in range(40)] + [(None, None, None)], key=str)
    assert sorted(map(tuple, clean.collect()), key=str) == want
    monkeypatch.setattr(decontamination, "GROUP_CHARS", 700)
    assert sorted(map(tuple, decontamination.decontaminate(docs, bench).collect()), key=str) == want


def test_shingles_are_made_in_runs_of_texts(monkeypatch):
    """A whole batch of 8 MB was shingled at once, and a million word codes were remembered."""
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(1 << 30)}" for _ in range(5000)) for _ in range(100)]
    texts[3], texts[50], texts[-1] = "", None, texts[5]

    def of(batch):
        return next(minhash.measure(iter([batch]))), next(minhash.collect_sets(iter([batch])))

    batch = pd.DataFrame({"node": [str(i) for i in range(len(texts))], "text": texts})
    tracemalloc.start()
    cut = of(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20, peak
    monkeypatch.setattr(minhash, "RUN_CHARS", 1 << 30)
    for got, want in zip(cut, of(batch)):
        assert list(got.columns) == list(want.columns) and got.dtypes.equals(want.dtypes)
        for column in got:
            assert all(np.array_equal(a, b) for a, b in zip(got[column], want[column]))
    empty = of(batch[:0])
    assert [len(x) for x in empty] == [0, 0] and empty[0]["n"].dtype == np.int32
