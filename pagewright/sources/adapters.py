"""Boundaries to things outside Spark: OCR calls and PDF files. The default OCR reads replies that exist already."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pagewright.sources.pdf_read import page_count, page_slice

# Retry policy of remote calls.
ATTEMPTS, BASE_SECONDS = 5, 2.0
TRANSIENT = ("429", "quota", "rate", "temporarily", "json")


def with_retry(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
    """``call`` up to ATTEMPTS times, waiting 2, 4, 8, 16 seconds after transient failures; others raise at once."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except Exception as error:
            if attempt == ATTEMPTS - 1 or not (isinstance(error, ValueError) or any(w in str(error).lower() for w in TRANSIENT)):
                raise
            sleep(BASE_SECONDS * 2**attempt)
    raise AssertionError


def ocr(pages: DataFrame, call: Callable[[bytes, str], str]) -> DataFrame:
    """(book, page_num, reply) of (book, page_num, image, prompt); ``call`` is shipped to the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [with_retry(lambda i=i, p=p: call(i, p)) for i, p in zip(batch["image"], batch["prompt"])]
            yield batch[["book", "page_num"]].assign(reply=replies)

    return pages.select("book", "page_num", "image", "prompt").mapInPandas(run, "book string, page_num int, reply string")


def pdf_page_count(data: bytes) -> int:
    """Pages of a PDF; ValueError if there is none. For tables of files see pdf_read.pdf_pages."""
    count = page_count(data)
    if count is None:
        raise ValueError("the PDF has no pages")
    return count


def pdf_page_slice(data: bytes, index: int) -> bytes:
    """A one-page PDF of the page at ``index``; IndexError beyond the last. For tables of files see pdf_read.sliced."""
    found = page_slice(data, index)
    if found is None:
        raise IndexError(index)
    return found
