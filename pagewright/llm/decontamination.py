"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents.  Its words become symbols: words of the
test phrases have one each, every run of other words is one separator, as no phrase
can reach across it.  All windows of the test items are searched backward at once
through wavelet-tree ranks, their occurrences located by sampled suffix positions,
and overlapping ones merged into removal spans.  Nothing is shuffled.

Test items reach the workers in groups of about GROUP_CHARS, by hash, each in blocks of
BLOCK_CHARS: the size of the benchmark is measured first, only one group is read by the
driver and broadcast at a time, and where there are several, the documents pass them one
after the other, gathering spans in a table that is written between the passes.  A task
builds each block's phrases once, as arrays.

Defined cases: null text has no words; an item without words has no window; an
item of fewer than 10 words is one window; items with a null id mark words but are
not listed; repeated items count once; repeated documents each get their result; an
empty benchmark leaves every document clean; other columns are kept out.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.fm_index import FMIndex
from pagewright.llm.shared import bound_batches, cut, stored, table

WINDOW = 10
BLOCK_CHARS = 4_000_000
#: Characters of test items that are broadcast at once, about.
GROUP_CHARS = 16_000_000
#: Words are runs of digits, letters and anything beyond ASCII; A-Z are lowered. On UTF-8 bytes.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Phrases:
    """The windows of a block of test items, as rows of symbols, and the items of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for number, (_, text) in enumerate(items):
            words = np.array([self.symbols.setdefault(w, len(self.symbols) + 2) for w in words_of(text)], np.int32)
            size = min(len(words), window)
            if size:
                made = np.lib.stride_tricks.sliding_window_view(words, size)
                rows.setdefault(size, []).append(made)
                owners.setdefault(size, []).append(np.full(len(made), number))
        self.sigma = len(self.symbols) + 2
        #: (patterns, begin of each pattern's items, items) by length.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted(rows):
            patterns, which = np.unique(np.concatenate(rows[size]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.ravel(), np.concatenate(owners[size]))), axis=1)
            self.by_length.append((patterns.astype(np.int64), np.searchsorted(pairs[0], np.arange(len(patterns) + 1)), pairs[1]))


def search(texts: list, phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
    """For each text: its number of words, merged [start, end) word spans, and ids of the items that occur."""
    counts, pieces = [], []
    get = phrases.symbols.get
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        pieces.append(np.fromiter(map(get, words, itertools.repeat(1)), np.int64, len(words)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if not phrases.by_length or not any(counts):
        return counts, spans, items
    sizes = np.array(counts, np.int64)
    symbols = np.ones(int(sizes.sum()) + len(texts), np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # one separator after each text
    for at, piece in zip(starts, pieces):
        symbols[at: at + len(piece)] = piece
    keep = np.concatenate(([True], (symbols[1:] != 1) | (symbols[:-1] != 1)))
    where = np.flatnonzero(keep)
    index = FMIndex(symbols[where], phrases.sigma)
    edges = np.zeros(len(symbols) + 1, np.int64)
    for patterns, begins_of, owners in phrases.by_length:
        which, low, high = index.find(patterns)
        if not len(which):
            continue
        many = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        at = where[index.locate(rows)]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + patterns.shape[1], -1)
        pairs = np.unique(np.stack((np.searchsorted(starts, at, side="right") - 1, np.repeat(which, many))), axis=1)
        for document, window in pairs.T.tolist():
            items[document].update(phrases.names[i] for i in owners[begins_of[window]: begins_of[window + 1]])
    hit = np.diff(np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0])))
    begins, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    for document, a, b in zip((np.searchsorted(starts, begins, side="right") - 1).tolist(), begins.tolist(), ends.tolist()):
        spans[document].append((a - int(starts[document]), b - int(starts[document])))
    return counts, spans, items


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Items (id, text) in blocks of about ``size`` characters, read one partition at a time."""
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((None if row[0] is None else str(row[0]), row[1]))
        chars += len(row[1] or "")
        if chars >= size:
            yield block
            block, chars = [], 0
    if block:
        yield block


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Searcher:
    """Searches texts for all blocks of a group, on a worker."""

    def __init__(self, sent: list):
        self.phrases = [Phrases(block.value) for block in sent]

    def __call__(self, texts: list) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
        counts, spans, items = search(texts, self.phrases[0])
        for phrases in self.phrases[1:]:
            _, more, named = search(texts, phrases)
            spans = [merge([*x, *y]) for x, y in zip(spans, more)]
            items = [x | y for x, y in zip(items, named)]
        return counts, spans, items


FOUND = "n_words long, span_words array<int>, items array<string>"


def searched(rows: DataFrame, benchmark: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, made: T.StructType | None = None) -> DataFrame:
    """(row, text) rows with n_words, span_words (start, end, start, end, ...) and the sorted items found in the text.

    Items are sent to the workers in groups of a bounded size, one after the other.  With
    several groups the texts are written once; each group then gives narrow rows for the
    texts that it hits, and these are joined back at last.  ``then`` makes rows of the schema
    ``made`` of the result; with one group it does so in the search's own pass, as a second
    one beside it would give every task two workers, which stay for all later stages.
    """
    bound_batches(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    items = benchmark.select("item_id", "text").distinct()
    groups = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / GROUP_CHARS))

    def find(batches: Iterator[pa.RecordBatch], sent: list) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(sent)
        for batch in batches:
            counts, spans, named = searcher(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(counts, pa.int64()), pa.array([[x for s in m for x in s] for m in spans], pa.list_(pa.int32())),
                pa.array([sorted(x for x in m if x is not None) for m in named], pa.list_(pa.string()))], [*batch.schema.names, "n_words", "span_words", "items"])

    def found_in(texts: DataFrame, mine: DataFrame, then: Callable = iter, made: T.StructType | None = None) -> tuple[DataFrame, list]:
        sent = [context.broadcast(b) for b in blocks(mine)] or [context.broadcast([])]
        schema = made or T.StructType([*texts.schema.fields, *T.StructType.fromDDL(FOUND).fields])
        return texts.mapInArrow(lambda batches: then(find(batches, sent)), schema), sent

    if groups == 1:
        return found_in(rows.select("row", "text"), items, then or iter, made)[0]
    texts = cut(rows.select(F.monotonically_increasing_id().alias("id"), "row", "text"))
    hits = None
    for group in range(groups):
        part, sent = found_in(texts.select("id", "text"), items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group))
        part = stored(part.drop("text").where("size(span_words) > 0" if group else "true"))  # the first says the number of words of every text
        hits = part if hits is None else hits.unionByName(part)
        for block in sent:
            block.unpersist()
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    whole = hits.groupBy("id").agg(F.max("n_words").alias("n_words"), joined(F.flatten(F.collect_list("span_words"))).alias("span_words"), named.alias("items"))
    found = texts.join(whole, "id").drop("id")
    return found.mapInArrow(then, made) if then else found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def joined(spans: pd.Series) -> pd.Series:
    """Spans (start, end, start, end, ...) sorted, with overlapping and touching ones joined."""
    return spans.map(lambda s: [x for m in merge([*zip(s[::2].tolist(), s[1::2].tolist())]) for x in m])


def find_contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, span_words, items) of each row of (key, text); spans as start, end, start, end, ..."""
    rows = documents.select(F.struct(F.col(key).alias("key")).alias("row"), "text")
    return searched(rows, benchmark).select(F.col("row.key").alias(key), "n_words", "span_words", "items")


def without_spans(text: str, span_words: list[int]) -> str:
    """The text without the words of the spans and what stands between them inside a span."""
    raw = text.encode("utf-8")
    plain = raw.translate(_TABLE)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, last = [], 0
    for a, b in zip(span_words[::2], span_words[1::2]):
        out.append(raw[last: starts[a]])
        last = ends[b - 1]
    return b"".join([*out, raw[last:]]).decode("utf-8")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the removal spans, n_chars (where it is a column) brought up to date.

    Rows without a hit stay as they are; rows of which no word is left go.
    """
    names = documents.columns
    others = [n for n in names if n != "text"]
    rows = documents.select((F.struct(*(F.col(f"`{n}`") for n in others)) if others else F.struct(F.lit(0).alias("none"))).alias("row"), "text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("span_words").to_pylist()
            cleaned = [without_spans(t, s) if s else t for t, s in zip(texts, spans)]
            gone = pa.array([bool(s) and not words_of(t) for t, s in zip(cleaned, spans)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cleaned, pa.string()), pa.array([bool(s) for s in spans]), gone], ["row", "text", "hit", "gone"])

    made = T.StructType([*rows.schema.fields, T.StructField("hit", T.BooleanType()), T.StructField("gone", T.BooleanType())])
    kept = searched(rows, benchmark, clean, made).where("NOT gone")

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col(f"row.`{name}`")
        if name == "n_chars":
            own = F.when(F.col("hit"), F.length("text").cast(documents.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return kept.select(*map(column, names))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(documents, table(spark, sf_dir, "benchmark"))
    hits = F.expr("aggregate(transform(span_words, (x, i) -> CASE WHEN i % 2 = 0 THEN -x ELSE x END), 0L, (a, x) -> a + x)")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("span_words") > 0).alias("contaminated"))


ORACLE = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters),
lengths AS (SELECT DISTINCT least(len(w), 10) AS k FROM items WHERE len(w) > 0),
tests AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM items JOIN lengths ON k = least(len(w), 10)),
windows AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'pos': i, 'phrase': array_to_string(w[i:i + k - 1], ' ')})) AS x
  FROM docs JOIN lengths ON len(w) >= k),
found AS (SELECT doc_id, windows.k, x.pos AS pos, item_id FROM windows JOIN tests ON windows.k = tests.k AND x.phrase = tests.phrase),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
