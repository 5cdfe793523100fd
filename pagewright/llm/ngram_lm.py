"""Language-model scores from sharded Elias-Fano n-gram tries trained on the corpus.

The model interpolates bigrams with the add-half unigrams of the contract:
P(w | v) = (c(v w) + K P(w)) / (c(v) + K).

Documents are worked on in chunks of about CHUNK_BYTES of text.  Each chunk is read once
and written to the shared folder as packed word numbers, so later passes see the same
chunks whatever is lost.  A chunk sends each shard its words and the distinct pairs that
fall there, with their training counts (one packed row per chunk and shard).  A shard adds the counts of all
chunks, builds its trie (contexts, then their successors) and looks up what the chunks
sent; the answers go back as 16-bit codes on one scale, and the chunk's tokens are scored
with them.  How many tokens and distinct words the corpus has is counted before, from the
chunks' distinct words alone.  Nothing is pruned or capped.

Pairs are dealt to shards by their first word.  Words that alone would fill a good part of
a shard are dealt by both words, with their exact counts; a sample that grows with the
corpus only finds them (a hint for balance).

Words have 64-bit codes; a shard numbers them by 48 of these bits, by which the successors
of one context are told apart (two of a million clash with a chance of 0.002).

Defined cases: null or empty text is one end token; null ids count as text ''
for the fold; repeated rows count and score each; an empty table gives an empty
result; with no training rows P(w) is 1; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.elias_fano import Trie, log_values
from pagewright.llm.shared import NOT_SPACE, bound_batches, cut, fold, table

SMOOTHING = 20.0
CHUNK_BYTES = 14 << 20
#: Training tokens of a shard, and shards at least.
SHARD_TOKENS, LEAST_SHARDS = 1_500_000, 8
#: Letters and space of a token, about.
TOKEN_CHARS = 6
#: Documents of the sample at least, and its share of the documents; the share of a shard that makes a word heavy.
SAMPLE, SAMPLE_SHARE, HEAVY = 5_000, 1 / 20_000, 0.125

BEGIN, END = 0, 1
_CODES = (xxhash.xxh3_64_intdigest(b"begin of text", 7), xxhash.xxh3_64_intdigest(b"end of text", 7))


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + len(_CODES)
        return number


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


class Chunk:
    """Tokens of some documents as word numbers by order of appearance, the words' codes, and the documents' lengths."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
        self.ids, self.codes, self.lengths = ids, codes, lengths

    @classmethod
    def of(cls, texts: list) -> Chunk:
        vocabulary = _Vocabulary()
        number, parts, lengths = vocabulary.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = (text or "").encode("utf-8", "replace").lower().split()
            lengths[i] = len(words) + 1
            part = np.full(len(words) + 1, END, np.int32)
            part[:-1] = np.fromiter(map(number, words), np.int32, len(words))
            parts.append(part)
        codes = np.fromiter((*_CODES, *map(xxhash.xxh3_64_intdigest, vocabulary)), np.uint64, len(vocabulary) + len(_CODES))
        return cls(np.concatenate(parts), codes, lengths)

    def word_order(self, shards: int) -> np.ndarray:
        """Words by shard."""
        return np.argsort((self.codes % np.uint64(shards)).astype(np.int32), kind="stable")


class Layout:
    """A chunk's distinct (context, word) pairs in order of shard and context.

    ``pair`` is the place of each token's pair; ``many`` counts the pairs of each context (of a shard).
    """

    def __init__(self, chunk: Chunk, shards: int, heavy: np.ndarray):
        starts = np.cumsum(chunk.lengths) - chunk.lengths
        before = np.empty_like(chunk.ids)
        before[1:], before[starts] = chunk.ids[:-1], BEGIN
        pairs, pair = np.unique((before.astype(np.int64) << 32) | chunk.ids, return_inverse=True)
        first, second = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        code = chunk.codes[first]
        both = (code ^ (chunk.codes[second] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)
        shard = (np.where(np.isin(chunk.codes, heavy)[first], both, code) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.pair, self.second = rank[pair], second[order]
        shard, first = shard[order], first[order]
        fresh = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (shard[1:] != shard[:-1]))))
        self.first, self.first_shard, self.many = first[fresh], shard[fresh], np.diff(np.append(fresh, len(order))).astype(np.uint32)


def chunks_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list, np.ndarray, list]]:
    """(chunk number, texts, which train, keys) of consecutive rows (key, text, train) of this partition."""
    base, count = TaskContext.get().partitionId() << 24, 0
    keys, texts, train, size = [], [], [], 0
    for batch in batches:
        for key, text, t in zip(batch["key"], batch["text"], batch["train"]):
            keys.append(key)
            texts.append(text)
            train.append(t)
            size += len(text or "") + 8
            if size >= CHUNK_BYTES:
                yield base + count, texts, np.array(train, bool), keys
                keys, texts, train, size, count = [], [], [], 0, count + 1
    if texts:
        yield base + count, texts, np.array(train, bool), keys


def planes(numbers: np.ndarray, size: int = 4) -> np.ndarray:
    """The low ``size`` bytes of the numbers by significance, which compress better apart."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)


def numbers(planes_: np.ndarray) -> np.ndarray:
    out = np.zeros((planes_.shape[1], 8), np.uint8)
    out[:, : planes_.shape[0]] = planes_.T
    return out.view("<u8").ravel()


def count_heavy(batches: Iterator[pd.DataFrame], words: list[bytes]) -> Iterator[pd.DataFrame]:
    """Exact training counts of the heavy contexts in this partition, the begin mark's first."""
    sums = np.zeros(len(words) + 1, np.int64)
    for batch in batches:
        texts = [t for t, train in zip(batch["text"], batch["train"]) if train]
        counts = Counter()
        for t in texts:
            counts.update((t or "").encode("utf-8", "replace").lower().split())
        sums += [len(texts), *(counts[w] for w in words)]
    yield pd.DataFrame({"place": np.arange(len(sums)), "count": sums})


def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(chunk, payload): the chunks' tokens, packed."""
    for number, texts, train, keys in chunks_of(batches):
        chunk = Chunk.of(texts)
        yield pd.DataFrame({"chunk": [number], "payload": [pack(planes(chunk.ids), chunk.codes, chunk.lengths, train, keys)]})


def held(payload: bytes) -> tuple[Chunk, np.ndarray, list]:
    """The chunk, which of its documents train, and their keys."""
    ids, codes, lengths, train, keys = unpack(payload)
    return Chunk(numbers(ids).astype(np.int32), codes, lengths), train, keys


def send_words(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """The distinct words of each chunk's training texts by shard, and on one of its rows their tokens."""
    for batch in batches:
        rows = []
        for payload in batch["payload"]:
            chunk, train, _ = held(payload)
            words = np.unique(chunk.codes[np.unique(chunk.ids[np.repeat(train, chunk.lengths)])])
            place = (words % np.uint64(shards)).astype(np.int64)
            tokens = int(chunk.lengths[train].sum())
            for k, s in enumerate(np.unique(place).tolist()):
                rows.append((s, words[place == s].tobytes(), 0 if k else tokens))
        yield pd.DataFrame(rows, columns=["shard", "words", "tokens"])


def count_words(group: pd.DataFrame) -> pd.DataFrame:
    """Training tokens and distinct words of a shard."""
    words = np.concatenate([np.frombuffer(w, np.uint64) for w in group["words"]])
    return pd.DataFrame({"tokens": [int(group["tokens"].sum())], "distinct": [len(np.unique(words))]})


def send(batches: Iterator[pd.DataFrame], shards: int, heavy: np.ndarray) -> Iterator[pd.DataFrame]:
    """What each chunk asks of and tells each shard that has words or pairs of it."""
    for batch in batches:
        for number, payload in zip(batch["chunk"], batch["payload"]):
            chunk, train, _ = held(payload)
            layout, order, codes = Layout(chunk, shards, heavy), chunk.word_order(shards), chunk.codes
            trained = np.repeat(train, chunk.lengths)
            words = np.bincount(chunk.ids[trained], minlength=len(codes)).astype(np.uint32)
            counts = np.bincount(layout.pair[trained], minlength=len(layout.second)).astype(np.uint32)
            word_shard = (codes[order] % np.uint64(shards)).astype(np.int64)
            met = np.union1d(layout.first_shard, word_shard)
            edges = np.append(met, shards)
            w, c = np.searchsorted(word_shard, edges), np.searchsorted(layout.first_shard, edges)
            p = np.concatenate(([0], np.cumsum(layout.many.astype(np.int64))))[c]
            rows = [(s, number, pack(codes[order[w[i]: w[i + 1]]], words[order[w[i]: w[i + 1]]], codes[layout.first[c[i]: c[i + 1]]], layout.many[c[i]: c[i + 1]],
                                     planes(codes[layout.second[p[i]: p[i + 1]]] >> np.uint64(16), 6), counts[p[i]: p[i + 1]]))
                    for i, s in enumerate(met.tolist())]
            yield pd.DataFrame(rows, columns=["shard", "chunk", "payload"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def build(asked: list[tuple], heavy: dict[int, int]) -> Trie:
    """The trie of a shard from what the chunks sent: (word codes, counts, contexts, many, successors, counts) each."""
    contexts = np.unique(np.concatenate([a[2] for a in asked]))
    words = np.unique(np.concatenate([a[4] for a in asked]))
    bits = np.uint64(max(1, len(words).bit_length()))
    keys, counts = [], []
    for a in asked:
        seen = a[5] > 0
        keys.append((np.repeat(np.searchsorted(contexts, a[2]), a[3])[seen].astype(np.uint64) << bits) | np.searchsorted(words, a[4][seen]).astype(np.uint64))
        counts.append(a[5][seen])
    key, count = _summed(np.concatenate(keys), np.concatenate(counts))
    context = (key >> bits).astype(np.int64)
    totals = np.bincount(context, count, minlength=len(contexts))
    for i in np.flatnonzero(np.isin(contexts, np.array(list(heavy), np.uint64))):
        totals[i] = heavy[int(contexts[i])]
    # Contexts that training texts lack are left out; a query for one has weight code 0.
    known = np.flatnonzero(totals > 0)
    renumber = np.full(len(contexts), -1, np.int64)
    renumber[known] = np.arange(len(known))
    return Trie(contexts[known], words, renumber[context], key & ((np.uint64(1) << bits) - np.uint64(1)), count, totals[known], SMOOTHING)


def answer(group: pd.DataFrame, heavy: dict[int, int]) -> pd.DataFrame:
    """A shard: adds the counts, builds the trie, and answers every chunk in the order it asked."""
    asked = [unpack(p) for p in group["payload"]]
    asked = [(*a[:4], numbers(a[4]), a[5]) for a in asked]
    words, sums = _summed(np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]))
    trie = build(asked, heavy)
    rows = [(chunk, int(group["shard"].iloc[0]), pack(sums[np.searchsorted(words, a[0])].astype(np.int64), *trie.lookup(*a[2:5])))
            for chunk, a in zip(group["chunk"], asked)]
    return pd.DataFrame(rows, columns=["chunk", "shard", "payload"])


SCORES = "key string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(kept: pd.DataFrame, answers: pd.DataFrame, shards: int, heavy: np.ndarray, tokens: int, distinct: int) -> pd.DataFrame:
    chunk, train, keys = held(kept["payload"].iloc[0])
    layout, order, lengths = Layout(chunk, shards, heavy), chunk.word_order(shards), chunk.lengths
    replies = [unpack(p) for _, p in sorted(zip(answers["shard"], answers["payload"]))]
    sums, weights, codes = (np.concatenate(x) for x in zip(*replies))
    counts = np.empty(len(order), np.int64)
    counts[order] = sums
    unigram = (counts + 0.5) / (tokens + 0.5 * (distinct + 1))
    of_pair = np.log10(log_values(codes, 0.0) + np.repeat(log_values(weights, 1.0), layout.many) * unigram[layout.second])
    starts = np.cumsum(lengths) - lengths
    each = lambda x: np.add.reduceat(x, starts)
    return pd.DataFrame({
        "key": pd.Series(keys, dtype=object),
        "held_out": ~train, "n_tokens": lengths, "n_known": each((counts[chunk.ids] > 0).astype(np.int64)), "train_tokens": tokens,
        "base_score": each(np.log10(unigram)[chunk.ids]), "score": each(of_pair[layout.pair])})


def heavy_words(documents: DataFrame, shards: int) -> dict[int, int]:
    """Codes of the begin mark and of the words that would fill HEAVY of a shard, by a sample, with their exact training counts.

    There are shards / HEAVY such words at most.
    """
    rows = documents.count()
    every = max(1, rows // max(SAMPLE, int(rows * SAMPLE_SHARE)))
    sample = documents.where(F.pmod(F.xxhash64("key", "text"), F.lit(every)) == 0)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = cut(sample.select(F.explode(F.regexp_extract_all(lower, F.lit(NOT_SPACE), F.lit(0))).alias("word")).groupBy("word").count())
    total = found.agg(F.sum("count")).first()[0] or 0
    words = [r["word"].encode("utf-8", "replace") for r in found.where(F.col("count") > HEAVY * total / shards).orderBy("word").collect()]
    sums = documents.mapInPandas(lambda b: count_heavy(b, words), "place long, count long").groupBy("place").agg(F.sum("count").alias("count"))
    counts = {r["place"]: r["count"] for r in sums.collect()}
    return {code: counts.get(i, 0) for i, code in enumerate((_CODES[0], *map(xxhash.xxh3_64_intdigest, words)))}


def language_scores(documents: DataFrame) -> DataFrame:
    """Scores of (doc_id, text, train) rows, learning from those where train is true."""
    bound_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType
    # Ids cross to Python as text, so large integers beside nulls stay exact.
    documents = documents.select(F.col("doc_id").cast("string").alias("key"), "text", "train")
    size = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // (TOKEN_CHARS * SHARD_TOKENS)))
    totals = heavy_words(documents, shards)
    heavy = np.sort(np.array(list(totals), np.uint64))
    chunks = cut(documents.mapInPandas(hold, "chunk long, payload binary"))
    sent = chunks.mapInPandas(lambda b: send(b, shards, heavy), "shard int, chunk long, payload binary")
    # The sums of the whole corpus come first, so the answers go from their shards to their chunks with no table of them between.
    words = chunks.mapInPandas(lambda b: send_words(b, shards), "shard int, words binary, tokens long")
    sums = words.groupBy("shard").applyInPandas(count_words, "tokens long, distinct long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = int(sums[0]), int(sums[1])
    answers = sent.groupBy("shard").applyInPandas(lambda g: answer(g, totals), "chunk long, shard int, payload binary")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda k, a: score(k, a, shards, heavy, tokens, distinct), SCORES)
    return scored.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", "doc_id")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id") != 1).alias("train"))
    return language_scores(documents)
