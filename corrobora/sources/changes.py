"""Recent changes as a Python data source, read in pages.

``spark.read.format("recent_changes")`` and ``spark.readStream`` take the name
of a module-level function that returns a page of changes, so tests and other
wikis need no network here: ``module:function(wiki, start, end, token)`` ->
``(rows, next token or None)``; the newest change comes first.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corrobora.sources.fetch import with_retry

SCHEMA = "wiki string, revid long, old_revid long, pageid long, title string, user string, timestamp string, comment string, size_delta int, is_new_page boolean, is_minor boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def pages(function: str, wiki: str, start: str, end: str) -> Iterator[dict]:
    """All changes of a wiki in [start, end], page after page; a page that fails for a while is asked for three times."""
    module, _, name = function.partition(":")
    call, token = getattr(importlib.import_module(module), name), None
    while True:
        rows, token = with_retry(lambda t=token: call(wiki, start, end, t), 3)
        yield from rows
        if not token:
            return


def change(wiki: str, raw: dict) -> tuple:
    """A change as a row; its size difference only where both lengths are numbers."""
    old, new = raw.get("oldlen"), raw.get("newlen")
    row = {
        "wiki": wiki, "revid": raw.get("revid"), "old_revid": raw.get("old_revid"), "pageid": raw.get("pageid"), "title": raw.get("title"), "user": raw.get("user"), "timestamp": raw.get("timestamp"),
        "comment": raw.get("comment") or "", "size_delta": new - old if isinstance(old, int) and isinstance(new, int) else None, "is_new_page": bool(raw.get("new")), "is_minor": bool(raw.get("minor")),
    }
    return tuple(row[c] for c in _COLUMNS)


class _Wiki(InputPartition):
    def __init__(self, wiki: str):
        self.value = wiki


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Wiki(w) for w in self.options["wikis"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for raw in pages(self.options["pages"], partition.value, self.options["start"], self.options["end"]):
            yield change(partition.value, raw)


def _shifted(stamp: str, seconds: int) -> str:
    """A timestamp so many seconds earlier; one that is none stays."""
    try:
        return (datetime.fromisoformat(stamp.replace("Z", "+00:00")) - timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return stamp


class _Window(InputPartition):
    def __init__(self, wiki: str, after: str | None, end: str):
        super().__init__(wiki)
        self.after, self.end = after, end


class _Stream(DataSourceStreamReader):
    """An offset for each wiki: the timestamp of its newest change; each wiki is a partition, read by a task.

    The driver asks a wiki for one page only, to see how far it has come. A wiki
    that can't be asked keeps its offset and gives nothing in that batch, while
    the others go on; one that fails later fails the batch, which is read again
    between the same offsets. A window is (offset, newest]; ``overlap`` seconds
    before it (60) are read again, for changes of the offset's own second or
    listed late, and come again for a sink that keeps each key once; with 0
    nothing comes again. A wiki that can't be asked right after a restart has no
    offset in that batch and goes on later from the one before; only a second
    restart before then reads it again from ``start``.
    """

    def __init__(self, options: dict):
        self.options, self.known, self.done = options, {}, {}
        self.overlap = int(options.get("overlap", 60))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        module, _, name = self.options["pages"].partition(":")
        call = getattr(importlib.import_module(module), name)
        for wiki in self.options["wikis"].split(","):
            try:
                rows, _ = call(wiki, self.known.get(wiki, self.options["start"]), self.options["end"], None)
            except Exception:  # asked again in the next batch
                continue
            newest = max((r["timestamp"] for r in rows if r.get("timestamp")), default=None)
            if newest and newest > self.known.get(wiki, ""):
                self.known[wiki] = newest
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.done.update(start)  # also of wikis that this batch passes over
        for wiki, stamp in start.items():
            self.known[wiki] = max(stamp, self.known.get(wiki, ""))
        return [_Window(w, self.done.get(w), to) for w, to in sorted(end.items()) if self.done.get(w) != to]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start = _shifted(partition.after, self.overlap) if partition.after else self.options["start"]
        for raw in pages(self.options["pages"], partition.value, start, partition.end):
            if partition.after and not self.overlap and (raw.get("timestamp") or "") <= partition.after:
                continue
            if (raw.get("timestamp") or "") <= partition.end:
                yield change(partition.value, raw)


class RecentChanges(DataSource):
    """Options: wikis (comma-separated), pages, start, end; for streams overlap (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "recent_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
