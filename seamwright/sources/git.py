"""Files of a git revision as a data source: `spark.read.format("git_files").option("repository", ...).option("revision", ...).load()`.

The driver lists names, ids and sizes of the revision's files (git ls-tree) and deals them to partitions of about SHARE bytes; tasks
read the contents (git cat-file --batch), so no source passes through the driver and nothing is checked out. The repository
lies where all executors find it, as any input does.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes and files of a partition, about.
SHARE, FILES = 16 << 20, 5000
_SCHEMA = "snapshot string, path string, lang string, text string"


def is_empty(revision: str) -> bool:
    """EMPTY, or an id of zeros only, is an empty tree."""
    return revision == "EMPTY" or set(revision) == {"0"}


def kept(path: str) -> str | None:
    """The language of a source or settings file; None for others and for files in ignored folders."""
    from .files import IGNORED, LANGUAGES

    p = PurePosixPath(path)
    if any(part in IGNORED or part.startswith(".") for part in p.parts[:-1]):
        return None
    if p.name.startswith("tsconfig") and p.suffix == ".json":
        return "tsconfig"
    return LANGUAGES.get(p.suffix[1:])


@dataclass
class _Blobs(InputPartition):
    files: list[tuple[str, str, str]]  # id, path, language


class _Reader(DataSourceReader):
    def __init__(self, repository: str, revision: str, folder: str, share: int):
        self.repository, self.revision, self.folder, self.share = repository, revision, folder, share

    def partitions(self) -> list[_Blobs]:
        parts: list[_Blobs] = [_Blobs([])]
        if is_empty(self.revision):
            return parts
        command = ["git", "-C", self.repository, "ls-tree", "-r", "-z", "-l", "--full-tree", self.revision]
        listed = subprocess.run([*command, *(["--", self.folder] if self.folder else [])], check=True, capture_output=True).stdout
        size = 0
        for entry in listed.decode("utf-8", "surrogateescape").split("\0")[:-1]:
            facts, path = entry.split("\t", 1)
            mode, kind, ident, length = facts.split()
            path = path[len(self.folder) + 1 :] if self.folder else path
            lang = kept(path)
            if kind != "blob" or mode == "120000" or lang is None:  # submodules and links hold no source
                continue
            if parts[-1].files and (size + int(length) > self.share or len(parts[-1].files) >= FILES):
                parts.append(_Blobs([]))
                size = 0
            parts[-1].files.append((ident, path, lang))
            size += int(length)
        return parts

    def read(self, partition: _Blobs) -> Iterator[tuple[str, str, str, str]]:
        if not partition.files:
            return
        with subprocess.Popen(["git", "-C", self.repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            assert git.stdin is not None and git.stdout is not None
            for ident, path, lang in partition.files:
                git.stdin.write(f"{ident}\n".encode())
                git.stdin.flush()
                head = git.stdout.readline().split()
                if len(head) != 3:
                    raise ValueError(f"git has no object {ident} for {path}")
                text = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                yield self.revision, path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), lang, text.decode("utf-8", "replace")
            git.stdin.close()


class GitSource(DataSource):
    """Options: repository, revision, folder (below the repository's root), share (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["repository"], self.options.get("revision", "HEAD"), self.options.get("folder", "").strip("/"), int(self.options.get("share", SHARE)))


def register(spark: SparkSession) -> None:
    """Make format("git_files") known to a session."""
    spark.dataSource.register(GitSource)
