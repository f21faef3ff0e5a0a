"""Files of documents as a Spark data source.

`spark.dataSource.register(DocumentFiles)`, then `spark.read.format("documents").option(...).load(folder)`. The driver
lists names and sizes only; a partition is a group of files of bounded size, and its task reads them page by page, so
that a file is never held whole unless its reader does so. What a file's format is, a reader says: a function from a
binary stream to a description and an iterator of pages, named by its import path. The one for plain text, with a form
feed between pages, is here; others plug in the same way.

Options: `pattern` (of names), `reader` (module:function), `detail` (`pages` gives a row a page, `files` one a file, and
then no page after the first three is read), `maxBytes` (a larger file isn't read), `partitionBytes`.

A file that can't be read gives one row with the error, after the pages that could.
"""

from __future__ import annotations

import fnmatch
import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import IO, Any

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "path string, page_number int, text string, error string"
FILES = "path string, size long, title string, author string, creator string, page_count int, pages array<string>, error string"
#: Pages that a file's own row shows; bytes read at once.
SHOWN_PAGES, READ_BYTES = 3, 1 << 16


@dataclass
class Document:
    """What a reader gives of a file: pages as an iterator, which may read on as it goes, and what is known without them."""

    pages: Iterator[str]
    title: str | None = None
    author: str | None = None
    creator: str | None = None
    page_count: int | None = None


def plain_text(stream: IO[bytes]) -> Document:
    """UTF-8 text with a form feed between pages. Leading lines `%Title: x`, `%Author: x` and `%Creator: x` describe it."""
    parts = _split(iter(lambda: stream.read(READ_BYTES), b""), b"\f")
    first = next(parts, b"").decode()
    said: dict[str, str] = {}
    while first.startswith("%") and ": " in (line := first.split("\n", 1)[0]):
        name, _, value = line[1:].partition(": ")
        said[name.lower()] = value.strip()
        first = first[len(line) + 1 :]

    def pages() -> Iterator[str]:
        yield first
        for p in parts:
            yield p.decode()

    return Document(pages(), *[said.get(n) for n in ("title", "author", "creator")])


def _split(blocks: Iterator[bytes], mark: bytes) -> Iterator[bytes]:
    """What stands between marks, one part held at a time."""
    rest: list[bytes] = []
    for block in blocks:
        head, *more = block.split(mark)
        rest.append(head)
        for part in more:
            yield b"".join(rest)
            rest = [part]
    yield b"".join(rest)


@dataclass
class Group(InputPartition):
    """Files that one task reads: (path, size)."""

    files: list[tuple[str, int]] = field(default_factory=list)


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*")
        self.reader = options.get("reader", "foliant.sources.documents:plain_text")
        self.detail = options.get("detail", "pages")
        self.most = int(options.get("maxbytes", 100 * 1024 * 1024))
        self.together = int(options.get("partitionbytes", 64 * 1024 * 1024))

    def partitions(self) -> list[InputPartition]:
        system, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        listed = system.get_file_info(pyarrow.fs.FileSelector(root))
        files = sorted((f.path, f.size or 0) for f in listed if f.type == pyarrow.fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))
        groups, size = [Group()], 0
        for path, n in files:
            if groups[-1].files and size + n > self.together:
                groups.append(Group())
                size = 0
            groups[-1].files.append((path, n))
            size += n
        return groups

    def read(self, partition: InputPartition) -> Iterator[tuple[Any, ...]]:
        module, _, name = self.reader.partition(":")
        reader: Callable[[IO[bytes]], Document] = getattr(importlib.import_module(module), name)
        system, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
        for path, size in partition.files:
            if size > self.most:
                yield self._bad(path, size, "too_large")
                continue
            try:
                with system.open_input_stream(path) as stream:
                    yield from self._rows(path, size, reader(stream))
            except Exception as e:  # noqa: BLE001  a file that can't be read is a row, not a failed job
                yield self._bad(path, size, str(e))

    def _rows(self, path: str, size: int, found: Document) -> Iterator[tuple[Any, ...]]:
        if self.detail == "pages":
            for i, text in enumerate(found.pages):
                yield path, i + 1, text.strip(), None
            return
        shown = list(islice(found.pages, SHOWN_PAGES))
        count = found.page_count if found.page_count is not None else len(shown) + sum(1 for _ in found.pages)
        yield path, size, found.title, found.author, found.creator, count, shown, None

    def _bad(self, path: str, size: int, error: str) -> tuple[Any, ...]:
        return (path, None, None, error) if self.detail == "pages" else (path, size, None, None, None, 0, None, error)


class DocumentFiles(DataSource):
    """The format `documents`."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return PAGES if self.options.get("detail", "pages") == "pages" else FILES

    def reader(self, schema: Any) -> DocumentReader:
        return DocumentReader(dict(self.options))
