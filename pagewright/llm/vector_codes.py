"""Product codes of vectors: codebooks of 64 entries for each of 16 parts, by Yinyang Lloyd rounds in whole numbers.

The entries of a part's codebook are clustered into groups once.  Each vector part
carries an upper bound of the distance to its entry and one lower bound a group of the
distance to the group's other entries.  After an update the bounds drift with the
entries, and only groups whose lower bound may be reached are scanned; scans compare
squared distances as integers, so ties fall to the lower index and codes are exactly
those of plain rounds.  Bounds travel as half floats, rounded away from the truth's
harm, beside the vectors in a table a round; sums are made per task, so a round's
shuffle is tasks x parts x entries rows, and codebooks are the only thing collected
(16 x 64 entries, whatever the table).

Defined cases: a vector counts if it is not null, holds no null or non-finite component,
no component beyond ``LARGEST`` (its error would fit no long), and has the length most
such vectors have (of equal counts the longest), which 16 must divide; other rows have no
code and are left out.  Null ids are coded but come last as seeds; of equal ids each row
is a vector, ties among seeds go by components.  With fewer than 64 vectors the
codebooks have as many entries; an empty table gives no rows.  Null labels are one label.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import bound_batches, spread_join, stored, table

PARTS, ENTRIES, GROUPS, ROUNDS, SCALE = 16, 64, 6, 2, 256
#: 16 squared distances of components within it add up to less than 2 ** 63 for vectors of up to 1,024 components.
LARGEST = 2.0 ** 17
STATE = "vec_id string, label string, vector binary, entry binary, upper binary, lower binary"


@dataclass
class Codebooks:
    """``entries`` int64 [part, entry, place]; ``groups`` int [part, entry]; ``drift`` float [part, entry], since the round before."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def cluster_entries(entries: np.ndarray) -> np.ndarray:
    """Groups of each part's entries: a few plain rounds over at most 64 entries, from evenly spaced seeds."""
    parts, count, _ = entries.shape
    groups = np.zeros((parts, count), int)
    for p in range(parts if count else 0):
        centres = entries[p, np.linspace(0, count - 1, min(GROUPS, count)).astype(int)].astype(float)
        for _ in range(5):
            groups[p] = ((entries[p][:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            for g in range(len(centres)):
                if (groups[p] == g).any():
                    centres[g] = entries[p][groups[p] == g].mean(0)
    return groups


def half(values: np.ndarray, up: bool) -> np.ndarray:
    """Half floats not below (``up``) or not above the values."""
    values = np.asarray(values, float)
    with np.errstate(over="ignore"):
        near = values.astype(np.float16)
        wrong = near.astype(float) < values if up else near.astype(float) > values
        return np.where(wrong, np.nextafter(near, np.float16(np.inf if up else -np.inf)), near)


#: Float distances of integers are off by far less than this factor.
SLACK = 1e-9


def squared(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances [vector, entry]; by a float product where all its terms are whole numbers that floats hold."""
    largest = int(max(np.abs(vectors).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * vectors.shape[1] * largest ** 2 >= 1 << 53:
        return ((vectors[:, None] - entries[None]) ** 2).sum(-1)
    product = vectors.astype(float) @ entries.T.astype(float)
    return (vectors ** 2).sum(1)[:, None] + (entries ** 2).sum(1)[None] - 2 * product.astype(np.int64)


def assign(vectors: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, upper and lower bounds of vectors [n, part, place] without bounds so far: every group is scanned."""
    n, parts, _ = vectors.shape
    entry = np.zeros((n, parts), np.uint8)
    upper, lower = np.zeros((n, parts)), np.full((n, parts, GROUPS), np.inf)
    for p in range(parts):
        d = squared(vectors[:, p], books.entries[p])
        entry[:, p] = d.argmin(1)
        upper[:, p] = np.sqrt(d[np.arange(n), entry[:, p]])
        d = d.astype(float)
        d[np.arange(n), entry[:, p]] = np.inf
        for g in range(GROUPS):
            of_group = books.groups[p] == g
            if of_group.any():
                lower[:, p, g] = np.sqrt(d[:, of_group].min(1))
    return entry, half(upper * (1 + SLACK), True), half(lower * (1 - SLACK), False)


def reassign(vectors: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved by ``books.drift``; scans only groups whose bound fails. Last: distances computed."""
    entry, upper, lower, computed = entry.copy(), upper.astype(float), lower.astype(float), 0
    for p in range(vectors.shape[1]):
        x, entries, groups, drift = vectors[:, p], books.entries[p], books.groups[p], books.drift[p] * (1 + SLACK)
        up = upper[:, p] + drift[entry[:, p]]
        low = lower[:, p] - np.array([drift[groups == g].max(initial=0) for g in range(GROUPS)])
        # A group may hold a nearer entry, or an equally near one of a lower index, only if its bound doesn't exceed the upper one.
        rows = np.flatnonzero(low.min(1) <= up)
        best = ((x[rows] - entries[entry[rows, p]]) ** 2).sum(-1)
        computed += len(rows)
        up[rows] = np.sqrt(best) * (1 + SLACK)
        chosen = entry[:, p].astype(int)
        nearest = np.zeros(len(x), np.int64)
        nearest[rows] = best
        for g in range(GROUPS):
            of_group = np.flatnonzero(groups == g)
            failing = rows[low[rows, g] <= up[rows]]
            if not len(failing) or not len(of_group):
                continue
            d = squared(x[failing], entries[of_group])
            computed += d.size
            own = chosen[failing]
            apart = np.where(of_group[None] == own[:, None], np.iinfo(np.int64).max, d)
            place = apart.argmin(1)
            least, index = apart[np.arange(len(failing)), place], of_group[place]
            won = (least < nearest[failing]) | (least == nearest[failing]) & (index < own)
            # The beaten entry now counts among its group's others; the winner no longer does.
            second = apart.copy()
            second[np.arange(len(failing)), place] = np.iinfo(np.int64).max
            others = np.where(won, second.min(1, initial=np.iinfo(np.int64).max), least)
            low[failing, g] = np.where(others == np.iinfo(np.int64).max, np.inf, np.sqrt(others.astype(float)) * (1 - SLACK))
            lost = failing[won]
            before = groups[chosen[lost]]
            low[lost, before] = np.minimum(low[lost, before], np.sqrt(nearest[lost].astype(float)) * (1 - SLACK))
            nearest[lost], chosen[lost] = least[won], index[won]
            up[lost] = np.sqrt(nearest[lost].astype(float)) * (1 + SLACK)
        entry[:, p], upper[:, p], lower[:, p] = chosen, up, low
    return entry, half(upper, True), half(lower, False), computed


def unpacked(column: pd.Series, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), *shape)


def packed_rows(values: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(values)]


def vectors_of(column: pd.Series, parts: int, places: int) -> np.ndarray:
    return unpacked(column, "<i4", parts, places).astype(np.int64)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) rows with a vector that can be coded."""
    sound = F.expr(f"embedding IS NOT NULL AND size(embedding) > 0 AND size(embedding) % {PARTS} = 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= {LARGEST}D)")
    rows = embeddings.select("vec_id", "label", "embedding").where(sound)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def seeds(rows: DataFrame) -> np.ndarray:
    """Entries [part, entry, place] from the parts of the vectors of the least ids (at most 64 rows are collected)."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    first = rows.select("vec_id", whole.alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2) if first else np.zeros((PARTS, 0, 0), np.int64)


def sums_of(state: DataFrame, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts assigned to each entry; each task adds up its own first."""
    parts, count, places = entries.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((parts * count, places), np.int64), np.zeros(parts * count, np.int64)
        for batch in batches:
            if len(batch):
                at = (unpacked(batch["entry"], "u1", parts).astype(int) + np.arange(parts) * count).ravel()
                np.add.at(total, at, vectors_of(batch["vector"], parts, places).reshape(-1, places))
                n += np.bincount(at, minlength=parts * count)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"at": used, "n": n[used], "total": list(total[used])})

    summed = state.select("vector", "entry").mapInPandas(add, "at long, n long, total array<long>")
    each = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(places)]
    total, n = np.zeros((parts * count, places), np.int64), np.zeros(parts * count, np.int64)
    for r in summed.groupBy("at").agg(F.sum("n").alias("n"), *each).collect():  # at most parts x entries rows
        n[r["at"]], total[r["at"]] = r["n"], [r[f"t{i}"] for i in range(places)]
    return total.reshape(entries.shape), n.reshape(parts, count)


def moved(books: Codebooks, total: np.ndarray, n: np.ndarray) -> Codebooks:
    """Each entry at the floor of its parts' mean; unused entries stay."""
    entries = np.where(n[..., None] > 0, total // np.maximum(n, 1)[..., None], books.entries)
    return Codebooks(entries, books.groups, np.sqrt(((entries - books.entries) ** 2).sum(-1).astype(float)))


def encode(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id string, label string, vector, entry, upper, lower) in the shared folder, and the codebooks; see the module."""
    bound_batches(embeddings.sparkSession)
    rows = usable(embeddings)
    entries = seeds(rows)
    books = Codebooks(entries, cluster_entries(entries), np.zeros(entries.shape[:2]))
    places = entries.shape[2]
    columns = [c.split()[0] for c in STATE.split(", ")]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = np.floor(np.stack(batch["embedding"].to_numpy()).astype(float) * SCALE).astype(np.int64)
                entry, upper, lower = assign(v.reshape(len(batch), PARTS, places), books)
                yield pd.DataFrame(dict(zip(columns, (batch["vec_id"], batch["label"], packed_rows(v.astype("<i4")), *map(packed_rows, (entry, upper, lower))))))

    def again(books: Codebooks):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    v = vectors_of(batch["vector"], PARTS, places)
                    bounds = unpacked(batch["upper"], "<f2", PARTS), unpacked(batch["lower"], "<f2", PARTS, GROUPS)
                    entry, upper, lower, _ = reassign(v, unpacked(batch["entry"], "u1", PARTS), *bounds, books)
                    yield batch.assign(entry=packed_rows(entry), upper=packed_rows(upper), lower=packed_rows(lower))
        return step

    as_text = [F.col(c).cast("string").alias(c) for c in ("vec_id", "label")]
    state = stored(rows.select(*as_text, "embedding").mapInPandas(begin, STATE))
    for _ in range(rounds if entries.size else 0):
        books = moved(books, *sums_of(state, books.entries))
        state = stored(state.mapInPandas(again(books), STATE))
    return state, books


def codes(state: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id string, label string, code, error): two hex digits a part, and the squared distance summed over parts."""
    entries = books.entries

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                entry = unpacked(batch["entry"], "u1", PARTS)
                apart = vectors_of(batch["vector"], PARTS, entries.shape[2]) - entries[np.arange(PARTS)[None], entry]
                yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "code": [e.tobytes().hex() for e in entry], "error": (apart ** 2).sum((1, 2))})

    return state.select("vec_id", "label", "vector", "entry").mapInPandas(read, "vec_id string, label string, code string, error long")


def decoded(code: str, books: Codebooks) -> np.ndarray:
    """The vector that a code stands for, in the units of the embeddings."""
    return (books.entries[np.arange(PARTS), list(bytes.fromhex(code))].ravel() + 0.5) / SCALE


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    state, books = encode(given)
    coded = stored(codes(state, books).withColumn("of", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))))
    of_label = coded.groupBy("of").agg(F.sum("error").alias("label_error"))
    return spread_join(coded, of_label, "of", by=["vec_id", "code"]).select(
        F.col("vec_id").cast(given.schema["vec_id"].dataType).alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, p, any_value(x) AS x, min(struct_pack(d := {distance}, k := k)) AS best FROM parts JOIN c{r} USING (p) GROUP BY rid, p)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT p, best.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, len(x) + 1) AS places(i) GROUP BY ALL)")
            steps.append(f"u{r} AS (SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY p, k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(u{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN u{r} USING (p, k))")
    last = ROUNDS
    return f"""
WITH sound AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND list_count(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) <= {LARGEST})) = len(embedding)),
usual AS (SELECT len(v) AS n FROM sound GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM sound WHERE len(v) = (SELECT n FROM usual)),
parts AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) AS numbers(p)),
c0 AS (SELECT p, rid - 1 AS k, x AS c FROM parts WHERE rid <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{last}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""


ORACLE = _oracle()
