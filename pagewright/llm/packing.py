"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

A piece's place depends on its length alone, and lengths are at most the capacity, so
the instance is a histogram of at most ``capacity`` counts whatever the corpus' size.
``plan`` solves it on the driver with multiplicities: sets of one to three lengths that
dominate every other set with the same largest length are fixed for good (a larger
piece with exactly what fills its sequence, a piece that nothing fits beside, and so
on), until none is left; the rest is packed best-fit, longest first.  Pieces then find
their place from their rank among the pieces of their length, found with counts per
task and prefix sums, so no length's pieces are ever gathered.

Defined cases: a null text is empty, and an empty text is the end token alone; equal
texts and repeated rows are pieces of their own, in any order among those of a length;
null ids stay null; an empty table gives no pieces; other columns are not looked at.
Texts of any length are encoded in bounded chunks, cut where no token can reach across.
Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import bound_batches, stored, table

CAPACITY = 2048
END = 0
#: The same vocabulary for two libraries: the first defines the ids, the second gives the same ones several times faster.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Characters encoded at a time.
CHUNK = 1 << 20
#: Before a single space between two other characters a token always ends.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The faster library can't match runs of white space of any length.
_LONG_SPACE = re.compile(r"\s{1000}")

PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"


@functools.cache
def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """Token ids of a text as little-endian 32-bit numbers; the files default to the public tokenizers'."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY))
    plain.encode_special_tokens = True
    fast = None
    if vocabulary is None or ranks is not None:
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(text: str) -> list[int]:
        if fast is None or _LONG_SPACE.search(text):
            return plain.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    def encode(text: str) -> np.ndarray:
        found, at = [], 0
        while at < len(text) or not found:
            end = _CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            stop = end.start() if end else len(text)
            found.append(np.array(ids(text[at:stop]), "<u4"))
            at = stop
        return np.concatenate(found)

    return encode


def cut_lengths(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the rest first, then full ones."""
    full, rest = divmod(tokens, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def tokenized(documents: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of (doc_id, text) rows; ``rank`` counts the pieces of a length within the task ``part``."""
    bound_batches(documents.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, ranks_used = encoder(vocabulary, ranks), TaskContext.get().partitionId(), np.zeros(capacity + 1, "int64")
        last = np.array([end], "<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids, start = np.concatenate([encode(text or ""), last]), 0
                for piece, length in enumerate(cut_lengths(len(ids), capacity)):
                    own = ids[start:start + length].tobytes()
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), own if keep_ids else None, part, ranks_used[length]))
                    ranks_used[length] += 1
                    start += length
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, PIECE)


@dataclass
class Bins:
    """``count`` equal sequences; ``layout`` lists (length, pieces of it in each) from the front."""

    count: int
    layout: list[tuple[int, int]]


def dominating(counts: dict[int, int], j: int, capacity: int) -> tuple[int, ...] | None:
    """The others of a set with a piece of length ``j`` that dominates all sets holding such a piece; None if none is proven.

    A set dominates another if the other's pieces can be split into groups, each no longer
    than a piece of the first; then some best packing contains it.
    """
    free = capacity - j
    spare = sorted((s, n - (s == j)) for s, n in counts.items() if s <= free and n > (s == j))
    if not spare:
        return ()
    smallest = [s for s, n in spare for _ in range(min(n, 3))][:3]
    most = next((k for k in (3, 2, 1) if len(smallest) >= k and sum(smallest[:k]) <= free), 0)
    largest = spare[-1][0]
    if most == 1 or largest == free:
        return (largest,)
    if most != 2:
        return None
    pair = best_pair(spare, free)
    if largest >= sum(pair):
        return (largest,)
    if largest != pair[0]:
        return None
    # Any two other pieces that fit must not both be longer than the pair's shorter one.
    longer = [s for s, n in spare if s > pair[1] for _ in range(min(n - (s == pair[0]), 2))][:2]
    return pair if len(longer) < 2 or sum(longer) > free else None


def best_pair(spare: list[tuple[int, int]], free: int) -> tuple[int, int]:
    """The two pieces with the largest sum within ``free`` (one pair at least fits), the longer first; of equal sums the longest."""
    best, low, high = (0, 0), 0, len(spare) - 1
    while low <= high:
        total = spare[low][0] + spare[high][0]
        if total > free:
            high -= 1
        else:
            if (low < high or spare[low][1] > 1) and total > sum(best):
                best = (spare[high][0], spare[low][0])
            low += 1
    return best


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Sets fixed for good, and what is left: longest first, passes until one fixes nothing."""
    left, fixed, changed = dict(counts), [], True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j, 0) and (others := dominating(left, j, capacity)) is not None:
                # What dominates stays dominating while its lengths last, as pieces only go.
                need = Counter((j, *others))
                times = min(left[s] // n for s, n in need.items())
                fixed.append(Bins(times, sorted(need.items(), reverse=True)))
                for s, n in need.items():
                    left[s] -= times * n
                changed = True
            if not left.get(j, 0):
                left.pop(j, None)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit, longest first: a piece goes where the least room is left that holds it, else into a new sequence.

    Equal sequences are kept as one entry, so the work is bounded by the square of the
    capacity, not by the pieces.
    """
    room: list[list[Bins]] = [[] for _ in range(capacity)]

    def add(r: int, count: int, layout: list[tuple[int, int]], s: int, used: int) -> None:
        if count and used:
            room[r - used * s].append(Bins(count, [*layout, (s, used)]))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        for r in range(s, capacity):
            while n and room[r]:
                bins = room[r].pop()
                full, some = (bins.count, 0) if n >= bins.count * (r // s) else divmod(n, r // s)
                add(r, full, bins.layout, s, r // s)
                add(r, 1, bins.layout, s, some)
                n -= full * (r // s) + some
                if rest := bins.count - full - (some > 0):
                    room[r].append(Bins(rest, bins.layout))
        full, some = divmod(n, capacity // s)
        add(capacity, full, [], s, capacity // s)
        add(capacity, 1, [], s, some)
    return [bins for waiting in room for bins in waiting]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    fixed, left = reduced({s: n for s, n in counts.items() if n}, capacity)
    return fixed + best_fit(left, capacity)


def slots(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: one entry for a length in a kind of sequence, in order of ``key``."""
    rows, used, sequence = [], Counter(), 0
    for kind in bins:
        offset = 0
        for s, each in kind.layout:
            rows.append((s << 48 | used[s], used[s], each, sequence, offset))
            used[s] += each * kind.count
            offset += each * s
        sequence += kind.count
    rows.sort()
    columns = zip(*rows) if rows else [()] * 5
    return {name: np.array(values, "int64") for name, values in zip(("key", "first", "each", "sequence", "offset"), columns)}


def pack(documents: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of (doc_id, text) rows; ``ids`` only if asked for."""
    kind = documents.schema["doc_id"].dataType
    pieces = stored(tokenized(documents, capacity, end, vocabulary, ranks, keep_ids))
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    where = slots(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy("int64"), rank.to_numpy("int64")
        slot = np.searchsorted(where["key"], length << 48 | rank, "right") - 1
        each, within = where["each"][slot], rank - where["first"][slot]
        return pd.DataFrame({"sequence_id": where["sequence"][slot] + within // each, "offset": where["offset"][slot] + within % each * length})

    # A row a task and length: more tasks, more rows, so they are never broadcast.
    ranked = pieces.join(first.hint("merge"), ["part", "length"]).withColumn("at", place("length", F.col("before") + F.col("rank")))
    return ranked.select(F.col("doc_id").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from pieces packed with their ids; a sequence is at most the capacity."""
    @F.pandas_udf("array<long>")
    def joined(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda own: np.frombuffer(b"".join(own), "<u4").astype("int64"))

    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(ordered, lambda p: p["ids"]).alias("pieces")).select("sequence_id", joined("pieces").alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
