"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

A text's elements are its distinct shingles of five lower-cased words, weighted by
the length of their middle word (longer words are rarer; bounded, so that texts whose
shingle sets overlap by 0.8 surely overlap in weight, too).  Each element is a Poisson process of arrivals at
random slots whose rate is its weight; a slot keeps the first arrival, so two texts
agree in a slot with their probability Jaccard.  Generation stops early: arrivals
after a time by which all slots are filled almost surely (it shrinks with the text's
total weight) are never made.  Slots are banded in threes; texts that share a band
are candidates, and a pair is a link if the Jaccard of its shingle sets, which is the
similarity asked for, is at least 0.8, computed exactly.  Shingles and arrivals are numpy work on Arrow batches;
buckets, verification and components are DataFrame operations.

Equal texts are one node from the start.  In a bucket of at most SMALL nodes all
pairs are compared; in a larger one every member is compared with the bucket's few most
central nodes, and what is still apart from the first of them with some more, so work
stays linear in the bucket.  What then is outside a bucket's
main component is compared with all its members, in blocks of bounded size and by
bitmaps that bound the overlap of two sets; of the pairs that may be links those come out
and are verified that join components (forests of a block), until none is left that could
join any.  Classes are the connected components of the links.  Hot buckets, pivots
of many pairs and texts of many copies are joined in salted parts (shared.spread_join).

Defined cases: null text is the empty text, and equal texts without words are copies
like any others; 1 to 4 words are one shingle; repeated rows and ids share their
text's class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.graph import components
from pagewright.llm.shared import HOT_SHARE, LEAST_HOT, bound_batches, cut, hot_keys, spread_join, stored, table

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 20, 3
SLOTS = BANDS * ROWS
#: A slot stays empty with probability exp(-EXTRA) / SLOTS; a band with an empty slot is left out.
EXTRA = 2.0
SMALL = 8
#: Pivots of a larger bucket that all its members meet, those that its rest meets, and places of the bitmaps that the exact way compares.
FIRST, PIVOTS, BITS = 2, 16, 4096
#: Queries and members that meet in one block of the exact way at most, about.
QUERIES, MEMBERS = 1024, 8192
#: Characters of texts whose shingles are made at once, about, and word codes that a worker remembers.
RUN_CHARS, MOST_CODES = 1_000_000, 100_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LENGTH = np.uint64(63)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Codes(dict):
    """Word codes: a hash with the word's length (63 at most) in the low bits."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word) & ~63 | min(len(word), 63)
        return code


def shingle_sets(texts: list, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, by text and sorted, and the [start, end) bounds of each text.

    A shingle's low bits are the length of its middle word.
    """
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").lower().encode("utf-8", "replace").split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)))
    # Short texts are filled up to one shingle with zeros.
    room = np.where(sizes > 0, np.maximum(sizes, WORDS), 0)
    flat = np.zeros(int(room.sum()) + WORDS, np.uint64)
    starts = np.cumsum(room) - room
    for at, part in zip(starts.tolist(), parts):
        flat[at: at + len(part)] = part
    n = len(flat) - WORDS + 1
    hashed = np.zeros(n, np.uint64)
    for k in range(WORDS):
        hashed = mix(hashed + flat[k: n + k] + _M1)
    hashed = (hashed & ~_LENGTH) | (flat[WORDS // 2: n + WORDS // 2] & _LENGTH)
    counts = np.maximum(room - WORDS + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    hashed = hashed[at]
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    fresh = np.concatenate(([True], (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, bool)
    hashed, owner = hashed[fresh], owner[fresh]
    return hashed, np.searchsorted(owner, np.arange(len(texts) + 1))


def weights(shingles: np.ndarray) -> np.ndarray:
    return 0.6 + np.minimum((shingles & _LENGTH).astype(float), 27) / 30


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signature codes (texts by SLOTS); the largest code where a slot had no arrival."""
    n = len(bounds) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * SLOTS, none, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    weight = weights(shingles)
    total = np.bincount(owner, weight, minlength=n)
    until = SLOTS * (math.log(SLOTS) + EXTRA) / np.maximum(total, 1e-9)
    time, element, j = np.zeros(len(shingles)), shingles, 0
    while len(element):
        j += 1
        h = mix(element ^ np.uint64(j * int(_M1) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((h >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)) / weight
        alive = time < until[owner]
        h, time, element, owner, weight = h[alive], time[alive], element[alive], owner[alive], weight[alive]
        # The arrival's code: its time, then bits that tell elements apart.
        code = ((time * float(1 << 36)).astype(np.uint64) << np.uint64(16)) | (mix(h) & np.uint64(0xFFFF))
        slot = ((h & np.uint64(0xFFF)) % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(out, owner * SLOTS + slot, code)
    return out.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> list[np.ndarray]:
    """For each text, the keys of its bands whose slots are all filled."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _M1, (len(signature), BANDS))
    for r in range(ROWS):
        key = mix(key + parts[:, :, r] + _M1)
    full = (parts != np.uint64(0xFFFFFFFFFFFFFFFF)).all(2)
    return [k[f] for k, f in zip(key.view(np.int64), full)]


def shingle_runs(texts: list, codes: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingle_sets of one run of texts after the other, so that a worker's memory is that of a run and not of a batch."""
    begin, chars = 0, 0
    for end, text in enumerate(texts, 1):
        chars += len(text or "")
        if chars >= RUN_CHARS or end == len(texts):
            if len(codes) > MOST_CODES:
                codes.clear()
            yield shingle_sets(texts[begin:end], codes)
            begin, chars = end, 0


def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds n (distinct shingles) and bands to (.., text)."""
    codes = _Codes()
    for batch in batches:
        sizes, bands = [], []
        for shingles, bounds in shingle_runs(batch["text"].tolist(), codes):
            sizes += np.diff(bounds).tolist()
            bands += band_keys(signatures(shingles, bounds))
        yield batch.drop(columns="text").assign(n=np.array(sizes, np.int32), bands=bands)


def collect_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, shingles, bits) of (node, text)."""
    codes = _Codes()
    for batch in batches:
        sets = [shingles[a:b] for shingles, bounds in shingle_runs(batch["text"].tolist(), codes) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pd.DataFrame({"node": batch["node"], "shingles": [s.view(np.int64) for s in sets], "bits": [bitmap(s) for s in sets]})


def node_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The stored pairs (a, b) whose shingle sets in ``sets`` (node, shingles) have a Jaccard of at least ``least``."""
    left = spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    full = spread_join(left, sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b", hot=hot_keys(pairs, "b"), by=["a", "b"])
    common = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb") - common).alias("u")).where(F.col("c") >= least * F.col("u")).select("a", "b")


def hot_bands(members: DataFrame) -> DataFrame | bool:
    """(band, _hot) of the buckets of (band, size) rows that hold more than HOT_SHARE of them; False if none does."""
    seen = members.agg(F.count(F.lit(1)).alias("all"), F.max("size").alias("most")).first()
    least = max(seen["all"] * HOT_SHARE, LEAST_HOT)
    return (seen["most"] or 0) > least and stored(members.where(F.col("size") > least).select("band", F.lit(True).alias("_hot")).distinct())


def central_nodes(large: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(band, a, n) of members of large buckets, and (band, b, n2, rank) of each bucket's ``count`` most central nodes.

    A node's centrality is the size of all its buckets; a text that many others are
    copies of shares most slots with them.  Of nodes in the same buckets one stands
    for all.  A fifth of the buckets, chosen by key, is enough for this pass.
    """
    node = large.groupBy("node").agg(F.sum("size").alias("c"), F.xxhash64(F.array_sort(F.collect_list("band"))).alias("same"))
    fifth = large.where(F.pmod("band", F.lit(5)) == 0).join(node, "node")
    heads = fifth.groupBy("band", "same").agg(F.max(F.struct("c", F.xxhash64("node").alias("h"), "node", "n")).alias("p"))
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("p.c"), F.desc("p.h"), "p.node"))
    pivots = heads.withColumn("rank", rank).where(F.col("rank") <= count).select("band", F.col("p.node").alias("b"), F.col("p.n").alias("n2"), "rank")
    return fifth.select("band", F.col("node").alias("a"), "n"), pivots


def central_pairs(large: DataFrame) -> DataFrame:
    """Members of large buckets with each bucket's FIRST most central nodes: (a, n, b, n2)."""
    members, pivots = central_nodes(large, FIRST)
    return spread_join(members, pivots.drop("rank"), "band", hot=hot_bands(large))


def apart_pairs(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Members outside the component of their bucket's first central node with the PIVOTS central nodes of other components than theirs: (a, n, b, n2)."""
    members, pivots = central_nodes(large, PIVOTS)
    labelled = lambda rows, end, name: rows.join(labels.select(F.col("node").alias(end), F.col("label").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    pivots = cut(labelled(pivots, "b", "label2"))
    first = pivots.where("rank = 1").select("band", F.col("label2").alias("main"))
    apart = spread_join(labelled(members, "a", "label"), first, "band", hot=hot_bands(large), by=["a"]).where("label <> main")
    return apart.join(pivots, "band").where("label <> label2").select("a", "n", "b", "n2")


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' counts at BITS places; two bitmaps differ in no more places than the sets do."""
    counts = np.bincount((mix(shingles) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def open_blocks(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, dealt to (band, i, j) blocks of bounded size.

    Nodes outside a bucket's main component are the queries, dealt to blocks i; all its
    members are dealt to blocks j, and every i meets every j.
    """
    labelled = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("count"))
    bands = parts.groupBy("band").agg(F.max(F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("all")).where("parts > 1")
    bands = bands.select("band", F.col("main.label").alias("main"), F.ceil((F.col("all") - F.col("main.count")) / QUERIES).cast("int").alias("is"),
                         F.ceil(F.col("all") / MEMBERS).cast("int").alias("js"))
    open_ = spread_join(labelled, bands, "band", hot=hot_bands(large), by=["node"]).where("main IS NOT NULL").withColumn("query", F.col("label") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("band", "node", "n", "label", "query")
    asked = open_.where("query").select(*kept, place("is").alias("i"), every("js").alias("j"))
    met = open_.withColumn("query", F.lit(False)).select(*kept, every("is").alias("i"), place("js").alias("j"))
    return asked.unionByName(met)


def likely_links(block: pd.DataFrame, least: float, forests: int) -> pd.DataFrame:
    """Pairs (a, b) of a block that may be links: queries against members of other components, by the bound of their bitmaps.

    Only ``forests`` forests of them are given: were the pairs of one all links, no other
    pair would join anything more.  A row of nulls says that pairs were left out.
    """
    block = block.sort_values("node", ignore_index=True)  # alike in all bands, so that their pairs are mostly the same
    bits = np.frombuffer(b"".join(block["bits"]), np.uint64).reshape(len(block), -1)
    nodes, n, query = block["node"].to_numpy(), block["n"].to_numpy(), block["query"].to_numpy()
    labels = pd.factorize(block["label"])[0].astype(np.int32)
    members, trees, out, left_out = np.flatnonzero(~query), [], [], False
    for i in np.flatnonzero(query).tolist():
        size = n[members]
        near = members[(labels[members] != labels[i]) & (np.minimum(size, n[i]) >= least * np.maximum(size, n[i]))]
        differ = np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64)
        # At a Jaccard of `least` the sets differ in (1 - least) / (1 + least) of both sizes at most.
        share = differ / (n[near] + n[i])
        close = share * (1 + least) <= (1 - least) + 1e-9
        near = near[close][np.argsort(share[close], kind="stable")]
        for f in range(forests):
            if not len(near):
                break
            if f == len(trees):
                trees.append(labels.copy())
            tree = trees[f]
            apart = np.flatnonzero(tree[near] != tree[i])
            chosen = apart[np.unique(tree[near[apart]], return_index=True)[1]]
            out += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for j in near[chosen].tolist()]
            tree[np.isin(tree, tree[near[chosen]])] = tree[i]
            near = np.delete(near, chosen)
        left_out |= len(near) > 0
    return pd.DataFrame(out + [(None, None)] * left_out, columns=["a", "b"], dtype=object)


def links_left(large: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The exact way for what pivots leave: ``labels`` joined by the links between components of a bucket.

    Where pairs fail that forests rely on, more forests are tried, until none is left out.
    """
    forests = 1
    while True:
        blocks = open_blocks(large, labels).join(sets.select("node", "bits"), "node")
        likely = cut(blocks.groupBy("band", "i", "j").applyInPandas(lambda g: likely_links(g, least, forests), "a string, b string").distinct())  # noqa: B023
        given = likely.where("a IS NOT NULL")
        links = cut(verified(given, sets, least))
        found = links.count()
        if found:
            labels = components(links, labels)
        if likely.where("a IS NULL").isEmpty() or found == given.count():
            return labels
        forests *= 32


def text_classes(documents: DataFrame, key: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, node, n) for each row, and (node, label, first) for each distinct text, ``first`` being its least key."""
    bound_batches(documents.sparkSession)
    texts = documents.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))
    # Keys stay on the JVM's side: a node's signature is that of its text, whichever row it comes from.
    kind = texts.schema["key"].dataType.simpleString()
    text_key = texts.select(F.col("key").cast("string").alias("key"), "node", "text")
    rows = cut(text_key.mapInPandas(measure, "key string, node string, n int, bands array<long>").withColumn("key", F.col("key").cast(kind)))
    nodes = rows.groupBy("node").agg(F.min("key").alias("first"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    members = nodes.select("node", "n", F.explode("bands").alias("band"))
    sizes = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    many = max((sizes.agg(F.sum("size")).first()[0] or 0) * HOT_SHARE, LEAST_HOT)
    hot = sizes.where(F.col("size") > many).select("band", F.lit(True).alias("_hot"))
    members = cut(spread_join(members, sizes, "band", hot=hot, by=["node"]).where("size IS NOT NULL"))
    candidates = members.select("node").distinct()
    sets = cut(texts.select("node", "text").join(candidates, "node", "left_semi").mapInPandas(collect_sets, "node string, shingles array<long>, bits binary")
               .groupBy("node").agg(F.max("shingles").alias("shingles"), F.max("bits").alias("bits")))
    alike = (F.least("n", "n2") >= least * F.greatest("n", "n2")) & (F.col("a") != F.col("b"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    small = members.where(F.col("size") <= SMALL)
    one, two = small.select("band", F.col("node").alias("a"), "n"), small.select("band", F.col("node").alias("b"), F.col("n").alias("n2"))
    pairs = one.join(two, "band").where(alike & (F.col("a") < F.col("b"))).select("a", "b")
    large = members.where(F.col("size") > SMALL)

    dealt = central_pairs(large).where(alike).select(*ordered)
    labels = components(cut(verified(cut(pairs.unionByName(dealt).distinct()), sets, least)))
    apart = cut(apart_pairs(large, labels).where(alike).select(*ordered).distinct())
    if not apart.isEmpty():
        more = cut(verified(apart, sets, least))
        labels = labels if more.isEmpty() else components(more, labels)
    labels = links_left(large, labels, sets, least)
    of_node = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return rows.select("key", "node", "n"), of_node


def near_duplicates(documents: DataFrame, key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(key, class_id, n_shingles) for every row of (key, text); class_id is the least key of its class."""
    rows, of_node = text_classes(documents, key, least)
    classes = of_node.groupBy("label").agg(F.min("first").alias("class_id"))
    of_node = of_node.join(classes, "label").select("node", "class_id")
    return spread_join(rows, of_node, "node").select(F.col("key").alias(key), "class_id", F.col("n").alias("n_shingles"))


def one_of_each(documents: DataFrame, key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row of ``documents`` for each class: that of the least key, all columns as they are."""
    _, of_node = text_classes(documents, key, least)
    best = of_node.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("best"))
    exact = lambda k: F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("")).alias("exact")
    stays = best.select(F.col("best.node").alias("node"), exact(F.col("best.first")))
    # Copies of a text differ in their keys, so they are spread over tasks. Rows travel as one column, whatever their names.
    rows = documents.select(F.struct("*").alias("row"), exact(F.col(key)), node_of(F.col("text")).alias("node"))
    return rows.join(stays, ["node", "exact"], "left_semi").dropDuplicates(["node", "exact"]).select("row.*")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
