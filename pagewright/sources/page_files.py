"""Page files as a Spark data source: a reader that opens only the pages asked for, and a writer that commits whole files.

``page_files`` reads ``{base}/{title}/tmp/{title}_{page:04d}{suffix}`` (titles may hold
slashes when written by us) as rows (book, page_num, file_name, value).  Planning looks at
names only: each book's files are cut into runs of pages, and short runs, of many small
books, share a partition, so tasks grow with the files and not with the books.  Filters on
book and page_num are taken over: folders of other books are not listed, and files of
other pages are not opened.

``whole_files`` writes rows (file, value), one file each, in two phases: tasks write
``.part`` files beside their targets, the driver renames them when all tasks are done, or
removes them; what a lost attempt left behind goes, too.  Readers never see half a file.
A part's name says its attempt, so a task's message to the driver has the same size for any
number of files, and the driver goes through the folders one at a time: its memory grows
with the tasks, the folders and the largest folder, not with the files.

Paths are anything pyarrow's file systems reach.  Defined cases: names of another form are
skipped; equal page numbers are rows each; a null value is an empty file; rows of equal
file write one file, the last renamed; an empty table writes nothing.
"""

from __future__ import annotations

import bisect
import itertools
import operator
import os
import posixpath
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Page files of a partition.
RUN = 256
#: Threads of a commit, and the files that each is given at once.
THREADS = 16
GIVEN = 64
TEMPORARY = ".part"


def place_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def listed(files: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


def by_folder(files: pafs.FileSystem, base: str) -> Iterator[list[str]]:
    """The files of ``base`` and of every folder below it, one folder at a time."""
    waiting = [base]
    while waiting:
        found = listed(files, waiting.pop())
        waiting.extend(i.path for i in found if i.type == pafs.FileType.Directory)
        yield [i.path for i in found if i.type == pafs.FileType.File]


@dataclass(slots=True)
class Run:
    """Pages ``low`` to ``high`` of a book."""

    book: str
    low: int
    high: int


@dataclass
class Runs(D.InputPartition):
    """Runs that one task reads."""

    runs: list[Run]


_COMPARED = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le,
             D.StringStartsWith: str.startswith}


def as_test(f: D.Filter):
    """(column, predicate) of a filter that names decide, else None."""
    inner = f.child if isinstance(f, D.Not) else f
    column = getattr(inner, "attribute", None)
    if column not in (("book",), ("page_num",)):
        return None
    if isinstance(inner, D.IsNotNull):
        test = lambda v: True
    elif isinstance(inner, D.In):
        test = lambda v, known=set(inner.value): v in known
    elif type(inner) in _COMPARED and inner.value is not None:
        test = lambda v, same=_COMPARED[type(inner)], x=inner.value: same(v, x)
    else:
        return None
    return column[0], (lambda v: not test(v)) if isinstance(f, D.Not) else test


class PageFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "book string, page_num int, file_name string, value string"

    def reader(self, schema) -> "PageReader":
        return PageReader(self.options)


class PageReader(D.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.suffix = options["path"], options.get("suffix", ".ocr.json")
        self.run = int(options.get("run", RUN))
        self.tests: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            test = as_test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def wanted(self, column: str, value) -> bool:
        return all(test(value) for c, test in self.tests if c == column)

    def books(self, files: pafs.FileSystem, folder: str, name: str = "") -> Iterator[tuple[str, str]]:
        """(book, folder of its page files) below ``folder``, names only."""
        for info in sorted(listed(files, folder), key=lambda i: i.path):
            if info.type != pafs.FileType.Directory:
                continue
            if info.base_name == "tmp" and name:
                if self.wanted("book", name):
                    yield name, info.path
            else:
                yield from self.books(files, info.path, f"{name}/{info.base_name}".lstrip("/"))

    def numbers(self, files: pafs.FileSystem, book: str, folder: str) -> list[tuple[int, str]]:
        pattern = re.compile(re.escape(book.rsplit("/", 1)[-1]) + r"_(\d+)" + re.escape(self.suffix))
        found = ((pattern.fullmatch(i.base_name), i.path) for i in listed(files, folder))
        return sorted((int(m[1]), path) for m, path in found if m and int(m[1]) < 1 << 31 and self.wanted("page_num", int(m[1])))

    def partitions(self) -> list[Runs]:
        files, base = place_of(self.base)
        parts, room = [], 0
        for book, folder in self.books(files, base):
            numbers = [n for n, _ in self.numbers(files, book, folder)]
            starts = sorted({numbers[i] for i in range(0, len(numbers), self.run)})
            for low, high in zip(starts, [*starts[1:], 1 << 31]):
                size = bisect.bisect_left(numbers, high) - bisect.bisect_left(numbers, low)
                if size > room:
                    parts.append(Runs([]))
                    room = self.run
                parts[-1].runs.append(Run(book, low, high - 1))
                room -= size
        return parts

    def read(self, partition: Runs | None) -> Iterator[tuple]:
        files, base = place_of(self.base)
        for run in partition.runs if partition else ():  # None: nothing to read
            for number, path in self.numbers(files, run.book, f"{base}/{run.book}/tmp"):
                if run.low <= number <= run.high:
                    with files.open_input_stream(path) as f:
                        yield run.book, number, path.rsplit("/", 1)[-1], f.read().decode("utf-8", "replace")


@dataclass
class Written(D.WriterCommitMessage):
    """An attempt of a task, and the numbers of the files that it made."""

    attempt: str
    files: range


class Attempt:
    """Parts that one attempt of a task makes: ``{file}.{job}-{attempt}-{number}.part`` beside their targets."""

    def __init__(self, path: str, job: str) -> None:
        self.files, self.base = place_of(path)
        self.job, self.name, self.made = job, uuid.uuid4().hex[:16], 0
        self.folders: set[str] = set()

    def opened(self, file: str) -> pa.NativeFile:
        """A stream into the next part."""
        if posixpath.normpath(f"./{file}").split("/")[0] == "..":
            raise ValueError(f"{file!r} lies outside the folder")
        target = f"{self.base}/{file}"
        folder = target.rsplit("/", 1)[0]
        if folder not in self.folders:
            self.files.create_dir(folder, recursive=True)
            self.folders.add(folder)
        self.made += 1
        return self.files.open_output_stream(f"{target}.{self.job}-{self.name}-{self.made - 1}{TEMPORARY}")

    def written(self) -> Written:
        return Written(self.name, range(self.made))

    def undone(self) -> None:
        for folder in self.folders:
            remove(self.files, [i.path for i in listed(self.files, folder) if f".{self.job}-{self.name}-" in i.base_name])


def remove(files: pafs.FileSystem, paths: Iterable[str]) -> None:
    for path in paths:
        if files.get_file_info(path).type == pafs.FileType.File:
            files.delete_file(path)


class WholeFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> "FileWriter":
        return FileWriter(self.options["path"], overwrite)


class FileWriter(D.DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        attempt = Attempt(self.path, self.job)
        try:
            for file, value in rows:
                with attempt.opened(file) as f:
                    f.write((value or "").encode("utf-8"))
        except BaseException:
            attempt.undone()
            raise
        return attempt.written()

    def parts(self, paths: list[str]) -> Iterator[tuple[str, str, int, str]]:
        """(target, attempt, number, path) of this job's parts among ``paths``."""
        pattern = re.compile(rf"(.*)\.{self.job}-([0-9a-f]+)-(\d+){re.escape(TEMPORARY)}", re.DOTALL)
        for path in paths:
            if m := pattern.fullmatch(path):
                yield m[1], m[2], int(m[3]), path

    def steps(self, folders: Iterable[list[str]], places: dict[str, int], overwrite: bool) -> Iterator[tuple[str, str | None]]:
        """(path, target) of each file to rename, (path, None) of each to remove; ``places`` is the order of the attempts that count."""
        for paths in folders:
            parts = list(self.parts(paths))
            # Of equal targets the last one counts, so only it is renamed over what may stand there.
            last = {target: path for _, _, target, path in sorted((places[a], n, target, path) for target, a, n, path in parts if a in places)}
            for target, _, _, path in parts:
                yield path, target if last.get(target) == path else None
            if overwrite:
                yield from ((path, None) for path in paths if path not in last and not path.endswith(TEMPORARY))

    def settle(self, places: dict[str, int], overwrite: bool) -> None:
        files, base = place_of(self.path)

        def take(given: list[tuple[str, str | None]]) -> None:
            for path, target in given:
                if target is None:
                    remove(files, [path])
                else:
                    files.move(path, target)

        steps = self.steps(by_folder(files, base), places, overwrite)
        with ThreadPoolExecutor(THREADS) as pool:
            while ahead := list(itertools.islice(steps, THREADS * GIVEN)):
                for _ in pool.map(take, (ahead[i::THREADS] for i in range(THREADS))):
                    pass

    def commit(self, messages: list) -> None:
        found = Counter(attempt for paths in by_folder(*place_of(self.path)) for _, attempt, _, _ in self.parts(paths))
        gone = sum(len(m.files) - found[m.attempt] for m in messages if m)
        if gone:
            raise FileNotFoundError(f"{gone} files of this job are gone from {self.path}")
        self.settle({m.attempt: place for place, m in enumerate(messages) if m}, self.overwrite)

    def abort(self, messages: list) -> None:
        self.settle({}, False)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters be pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)
    spark.dataSource.register(WholeFiles)


def read_page_files(spark: SparkSession, base: str, suffix: str = ".ocr.json", run: int = RUN) -> DataFrame:
    """(book, page_num, file_name, value) of the page files under ``base``."""
    register(spark)
    return spark.read.format("page_files").option("suffix", suffix).option("run", str(run)).load(base)


def write_whole_files(rows: DataFrame, base: str, mode: str = "overwrite") -> None:
    """One file a row of (file, value) under ``base``; with overwrite, other files there go when all are written."""
    register(rows.sparkSession)
    rows.select("file", "value").write.format("whole_files").mode(mode).save(base)


def page_file_rows(pages: DataFrame) -> DataFrame:
    """(file, value) of pages (book, page_num, sections), as the layout and the JSON of page files have them."""
    title = F.element_at(F.split("book", "/"), -1)
    name = F.format_string("%s/tmp/%s_%04d.ocr.json", "book", title, "page_num")
    body = F.struct(F.col("page_num").alias("page"), F.col("sections"))
    return pages.select(name.alias("file"), F.to_json(body).alias("value"))
