"""Which of many needles occur in which texts, case folded, by one automaton instead of a comparison for each pair.

Needles are folded, made distinct and dealt to groups of a bounded size in characters (a
measured sum, so a larger list only makes more groups); each task builds the Aho-Corasick
automaton of its group once and reads its share of the texts once, in time linear in
their characters and the matches found.  Texts are not shuffled: each group is one pass.

Defined cases: null texts and needles match nothing, the empty needle matches nothing;
equal needles are one; a needle longer than a group's bound is a group of its own;
repeated texts are rows each; other columns of texts are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Characters of a group's needles: an automaton takes some hundred bytes each.
GROUP = 1 << 20


def folded(text: str) -> str:
    """Full case folding, so that texts which differ in case alone are equal."""
    return text.casefold()


@F.pandas_udf(StringType())
def fold_udf(text):
    return text.map(lambda x: None if x is None else folded(x))


def needle_groups(needles: DataFrame, column: str, most: int) -> Iterator[list[str]]:
    """Distinct folded needles, group by group; only one group is held by the driver at a time."""
    distinct = needles.select(fold_udf(F.col(column)).alias("needle")).where("length(needle) > 0").distinct()
    group, size = [], 0
    for row in distinct.toLocalIterator(prefetchPartitions=True):
        if group and size + len(row["needle"]) > most:
            yield group
            group, size = [], 0
        group.append(row["needle"])
        size += len(row["needle"])
    if group:
        yield group


def automaton(needles: list[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for needle in needles:
        built.add_word(needle, needle)
    built.make_automaton()
    return built


def matches(texts: DataFrame, column: str, needles: DataFrame, needle: str, most: int = GROUP) -> DataFrame:
    """Rows of ``texts`` (all columns but ``column``) with each folded ``needle`` that occurs in ``column``, and ``n`` its occurrences."""
    rest = [f for f in texts.schema if f.name != column]
    schema = StructType([*rest, StructField("found", ArrayType(StringType())), StructField("counts", ArrayType(texts.sparkSession.range(1).schema["id"].dataType))])
    passes = []
    for group in needle_groups(needles, needle, most):

        def search(batches: Iterator[pa.RecordBatch], group: list[str] = group) -> Iterator[pa.RecordBatch]:
            built = automaton(group)
            for batch in batches:
                found, counts = [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    seen: dict[str, int] = {}
                    for _, hit in built.iter(folded(text)) if text else ():
                        seen[hit] = seen.get(hit, 0) + 1
                    found.append(list(seen))
                    counts.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                                                 [*batch.schema.names[:-1], "found", "counts"])

        hit = texts.select(*(F.col(f"`{f.name}`") for f in rest), column).mapInArrow(search, schema)
        passes.append(hit.select(*(F.col(f"`{f.name}`") for f in rest), F.explode(F.arrays_zip("found", "counts")).alias("m")).select(
            *(F.col(f"`{f.name}`") for f in rest), F.col("m.found").alias("needle"), F.col("m.counts").alias("n")))
    if not passes:
        return texts.select(*(F.col(f"`{f.name}`") for f in rest), F.lit("").alias("needle"), F.lit(0).cast("long").alias("n")).limit(0)
    whole = passes[0]
    for more in passes[1:]:
        whole = whole.unionByName(more)
    return whole
