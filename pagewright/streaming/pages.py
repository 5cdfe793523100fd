"""Pages as a stream: new page files are cleansed as they arrive; repeated captures are found per book with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.sections import merge_within, prepare, reflow_sections
from pagewright.sources.pages import decoded_name, ocr_pages


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (book, page_num, file_name, sections) from page files that arrive under ``path``."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    return ocr_pages(files.select(decoded_name().alias("file_name"), "value"))


def prepared_pages(pages: DataFrame) -> DataFrame:
    """Everything that concerns one page alone; stateless, so it runs in a stream as in a batch."""
    merged = pages.withColumn("sections", F.expr(reflow_sections("sections"))).withColumn("sections", F.expr(merge_within("sections")))
    return merged.withColumn("prepared", F.expr(prepare("sections")))


def ends_of_books(captures: DataFrame, stop: int = 2) -> DataFrame:
    """(book, last_page) as soon as a digest has repeated ``stop`` times in a row.

    The state of a book is three values: last digest, start of its run, and repeats.
    Captures of a book must arrive in page order.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, start, repeats, done = state.get if state.exists else (None, 0, 0, False)
        for batch in batches:
            for page, shot in batch.sort_values("page_num")[["page_num", "digest"]].itertuples(index=False):
                if done or stop < 1:
                    continue
                if shot is not None and shot == digest:
                    repeats += 1
                    if repeats >= stop:
                        done = True
                        yield pd.DataFrame({"book": [key[0]], "last_page": [int(start)]})
                else:
                    digest, start, repeats = shot, int(page), 0
        state.update((digest, int(start), int(repeats), done))

    return captures.groupBy("book").applyInPandasWithState(
        update, "book string, last_page int", "digest string, start int, repeats int, done boolean", "append", GroupStateTimeout.NoTimeout)
