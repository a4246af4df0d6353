"""Notes as files: a Spark sink that writes pages with a two-phase commit.

``df.write.format("note_pages").option("path", vault).mode("append").save()`` takes rows (rel, text). A task reads the page
that is there, keeps its editable region, and writes what has changed as a temporary file below ``.pending`` of
the vault, with a list of its moves; its message to the driver is that list's name and three counts. On commit each
list's files are renamed over their pages (a page is whole before and after, never half) and the action of each page is appended to
the manifest; on abort, and after a commit, ``.pending`` of this write is deleted. A task that is killed or run
twice leaves temporary files only, which nothing names. A commit that is cut off is finished by writing again: pages that are as they
should be are left alone.

Options: path; start and end, the marks of the editable region (none: pages are replaced whole); plan=true tells what
would happen and writes no page; manifest, a folder for JSON lines (rel, action: create, update or same; sha256), one file
a write.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship


@dataclass
class Moves(WriterCommitMessage):
    """What a task did: the list of its moves, and how many pages it found new, changed and as they should be."""

    listed: str
    created: int
    updated: int
    same: int


def _region(text: str, start: str, end: str) -> re.Match | None:
    return re.search(rf"{re.escape(start)}[^\S\n]*\n(.*?)\n[^\S\n]*{re.escape(end)}", text, re.DOTALL)


def kept(new: str, old: str | None, start: str | None, end: str | None) -> str:
    """new with old's editable region, where both have one."""
    if not (old and start and end):
        return new
    mine, theirs = _region(new, start, end), _region(old, start, end)
    return new[: mine.start(1)] + theirs[1] + new[mine.end(1) :] if mine and theirs else new


def safe(rel: str) -> str:
    """A page's place inside the vault; names that lead out of it, or into hidden folders, are errors."""
    parts = rel.split("/")
    if not rel or rel.startswith("/") or any(p in ("", "..") or p.startswith(".") for p in parts):
        raise ValueError(f"not a page's place: {rel!r}")
    return rel


class NotePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "note_pages"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"rel", "text"} <= set(schema.fieldNames()):
            raise ValueError("pages are rows (rel, text)")
        if overwrite:
            raise ValueError("note_pages merges pages: use mode append")
        return PageWriter({k.lower(): v for k, v in self.options.items()})


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.where, self.start, self.end = options["path"].rstrip("/"), options.get("start"), options.get("end")
        self.plan, self.manifest = options.get("plan", "false").lower() == "true", options.get("manifest")
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[pafs.FileSystem, str, str]:
        """(file system, the vault's folder, this write's temporary one)"""
        store, top = pafs.FileSystem.from_uri(self.where if "://" in self.where else f"file://{self.where}")
        return store, top, f"{top}/.pending/{self.job}"

    def write(self, iterator: Iterator) -> Moves:
        store, top, pending = self._store()
        mine = f"{pending}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        counts = {"create": 0, "update": 0, "same": 0}
        with store.open_output_stream(f"{mine}/moves") as moves:
            for i, row in enumerate(iterator):
                rel, old = safe(row["rel"]), None
                with contextlib.suppress(FileNotFoundError), store.open_input_stream(f"{top}/{rel}") as f:
                    old = f.read().decode()
                text = kept(row["text"] or "", old, self.start, self.end)
                action = "create" if old is None else "same" if old == text else "update"
                counts[action] += 1
                line = {"rel": rel, "action": action, "sha256": hashlib.sha256(text.encode()).hexdigest()}
                if action != "same" and not self.plan:
                    line["from"] = f"{mine}/{i}"
                    with store.open_output_stream(line["from"]) as f:
                        f.write(text.encode())
                moves.write(json.dumps(line).encode() + b"\n")
        return Moves(f"{mine}/moves", counts["create"], counts["update"], counts["same"])

    def commit(self, messages: list) -> None:
        store, top, pending = self._store()
        with contextlib.ExitStack() as stack:
            log = None
            if self.manifest:
                target, folder = pafs.FileSystem.from_uri(self.manifest if "://" in self.manifest else f"file://{self.manifest}")
                target.create_dir(folder, recursive=True)
                log = stack.enter_context(target.open_output_stream(f"{folder}/{self.job}.json"))
            for m in messages:
                with store.open_input_stream(m.listed) as f:
                    rest = b""
                    while data := f.read(1 << 20):
                        *lines, rest = (rest + data).split(b"\n")
                        for line in lines:
                            move = json.loads(line)
                            if source := move.pop("from", None):
                                page = f"{top}/{move['rel']}"
                                store.create_dir(page.rpartition("/")[0], recursive=True)
                                store.move(source, page)
                            if log:
                                log.write(json.dumps(move).encode() + b"\n")
        store.delete_dir(pending)

    def abort(self, messages: list) -> None:
        store, _, pending = self._store()
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(pending)


def save(pages: DataFrame, path: str, start: str | None = None, end: str | None = None, manifest: str | None = None, plan: bool = False) -> None:
    """Write pages (rel, text), a row a page, as notes below path."""
    ship(pages.sparkSession)
    pages.sparkSession.dataSource.register(NotePages)
    options = {"path": path, "plan": str(plan).lower(), "start": start, "end": end, "manifest": manifest}
    pages.select("rel", "text").write.format("note_pages").options(**{k: v for k, v in options.items() if v is not None}).mode("append").save()
