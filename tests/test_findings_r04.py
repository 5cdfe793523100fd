"""Rules that the fourth round's findings led to."""

import pickle
import tracemalloc
from pathlib import Path

import pytest

from pagewright.sources import page_files
from pagewright.sources.pdf_write import PieceWriter


def standing(base: Path) -> dict[str, str]:
    return {str(p.relative_to(base)): p.read_text() for p in base.rglob("*") if p.is_file()}


@pytest.mark.parametrize("kind, value", [(page_files.FileWriter, "x"), (PieceWriter, b"x")])
def test_what_the_driver_holds_of_a_job_does_not_grow_with_its_files(tmp_path, kind, value):
    """The driver held two paths of every file, several times over, and a future for every rename."""
    peaks = []
    for books in (40, 400):
        base = tmp_path / str(books)
        writer = kind(str(base), True)
        done = [writer.write((f"s/b{b}/tmp/b{b}_{p:04d}.ocr.json", value) for b in range(t, books, 4) for p in range(25)) for t in range(4)]
        assert sum(len(m.files) for m in done) == books * 25 and max(len(pickle.dumps(m)) for m in done) < 300
        tracemalloc.start()
        writer.commit(done)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        files = [p.name for p in base.rglob("*") if p.is_file()]
        assert len(files) == books * 25 and all(f.endswith(".ocr.json") for f in files)
    # Ten times the files: what is planned ahead is bounded, folders' names and a few more remain.
    assert peaks[1] < 6e6 and peaks[1] < 6 * peaks[0]


def test_of_equal_files_the_last_message_counts_and_lost_attempts_do_not(tmp_path):
    page_files.FileWriter(str(tmp_path), True).commit([])
    old = page_files.FileWriter(str(tmp_path), True)
    old.commit([old.write(iter([("a/x.md", "old"), ("a/gone.md", "old"), ("top.md", "old"), ("other.part", "kept")]))])
    writer = page_files.FileWriter(str(tmp_path), True)
    one = writer.write(iter([("a/x.md", "one"), ("a/x.md", "one again"), ("a/new\nline.md", "n"), ("a/x.md.part", "p")]))
    two = writer.write(iter([("a/x.md", f"two {i}") for i in range(12)] + [("b.md", "b")]))
    writer.write(iter([("a/x.md", "lost"), ("c/lost.md", "lost")]))
    writer.commit([one, None, two])
    assert standing(tmp_path) == {"a/x.md": "two 11", "a/new\nline.md": "n", "a/x.md.part": "p", "b.md": "b", "other.part": "kept"}


def test_a_part_that_is_gone_fails_the_job_before_anything_changes(tmp_path):
    old = page_files.FileWriter(str(tmp_path), True)
    old.commit([old.write(iter([("a.md", "old"), ("s/b.md", "old")]))])
    writer = page_files.FileWriter(str(tmp_path), True)
    done = writer.write(iter([("a.md", "new"), ("s/c.md", "new")]))
    next((tmp_path / "s").glob("c.md.*.part")).unlink()
    with pytest.raises(FileNotFoundError):
        writer.commit([done])
    writer.abort([done])
    assert standing(tmp_path) == {"a.md": "old", "s/b.md": "old"}


@pytest.mark.parametrize("kind", [page_files.FileWriter, PieceWriter])
def test_files_outside_the_folder_are_refused(tmp_path, kind):
    value = "x" if kind is page_files.FileWriter else b"x"
    writer = kind(str(tmp_path / "in"), True)
    for name in ("../x.md", "a/../../x.md", ".."):
        with pytest.raises(ValueError):
            writer.write(iter([("a/first.md", value), (name, value)]))
    assert standing(tmp_path) == {}
    writer.commit([writer.write(iter([("a/../b.md", value), ("..c/d.md", value), ("./e.md", value)]))])
    assert standing(tmp_path) == {"in/b.md": "x", "in/..c/d.md": "x", "in/e.md": "x"}
