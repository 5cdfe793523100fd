"""Sinks: one Markdown, structure or combined text per book, a state log, and atomic small files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(books: DataFrame, column: str, path: str) -> None:
    """One folder per book under ``path``, committed by Spark as a whole."""
    text = F.regexp_replace(column, "\n$", "").alias("value")  # the writer ends each text with a newline
    books.select("book", text).write.mode("overwrite").partitionBy("book").text(path)


def append_state(events: DataFrame, path: str) -> None:
    """(book, phase, page_num, status, path, error, seq) events; the state is the last of each page."""
    events.write.mode("append").parquet(path)


def atomic_text(path: str, text: str) -> None:
    """A small driver-side file, whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, suffix=".part", delete=False) as part:
        part.write(text)
    os.replace(part.name, path)


def atomic_json(path: str, value) -> None:
    atomic_text(path, json.dumps(value, ensure_ascii=False, indent=2))
