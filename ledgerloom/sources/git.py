"""Git as a source of Spark: the two sides of a diff in partitions of files, and moves of HEAD as a stream.

The driver lists names and object ids; contents are read in the tasks, one blob at a time, by one `git cat-file` a partition. The
repository is a folder that all executors see.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SIDES = "side string, path string, change string, content binary"
HEADS = "root string, before string, head string, path string, complete boolean"
LINK, MODULE, NOTHING = "120000", "160000", "000000"
FILES, BUDGET = 256, 3


def run(root: str, *args: str, timeout: float = 60) -> bytes:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=timeout).stdout


class Part(InputPartition):
    def __init__(self, value):
        super().__init__(value)


class _Blobs:
    """Blobs of a repository by id, through one process."""

    def __init__(self, root: str):
        self.git = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self) -> _Blobs:
        return self

    def __exit__(self, *_) -> None:
        self.git.stdin.close()
        self.git.stdout.close()
        self.git.wait()

    def read(self, blob: str) -> bytes:
        self.git.stdin.write(blob.encode() + b"\n")
        self.git.stdin.flush()
        head = self.git.stdout.readline().split()
        if len(head) != 3:
            raise OSError(f"git has no object {blob}")
        content = self.git.stdout.read(int(head[2]))
        self.git.stdout.read(1)
        return content


def changes(root: str, ref: str, staged: bool, suffix: str) -> list[tuple[str, str, str, str, str, str]]:
    """(change, path, mode and blob of the old side, mode and blob of the new one) between a revision and the work tree or the index. Names are bytes
    to git: ones that are no UTF-8 keep theirs as lone surrogates."""
    if ref.startswith("-"):
        raise ValueError(f"{ref!r} is no revision")
    out = run(root, "diff", "--raw", "-z", "--no-renames", "--no-abbrev", *(["--cached"] if staged else []), ref, "--").split(b"\0")
    found = []
    for head, path in zip(out[::2], out[1::2], strict=False):
        old_mode, new_mode, old, new, change = head.decode().lstrip(":").split()
        name = path.decode("utf-8", "surrogateescape")
        if name.endswith(suffix):
            found.append((change, name, old_mode, old, new_mode, new))
    return found


class SidesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.ref, self.suffix = options["root"], options.get("ref", "HEAD"), options.get("suffix", "")
        self.staged, self.files = options.get("staged", "false").lower() == "true", int(options.get("files", FILES))

    def partitions(self) -> Sequence[InputPartition]:
        found = changes(self.root, self.ref, self.staged, self.suffix)
        return [Part(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.value:
            return
        with _Blobs(self.root) as blobs:
            for change, path, old_mode, old, new_mode, new in partition.value:
                shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                if old_mode not in (NOTHING, MODULE):
                    yield "old", shown, change, blobs.read(old)
                if new_mode in (NOTHING, MODULE):
                    continue
                if set(new) != {"0"}:
                    yield "new", shown, change, blobs.read(new)
                    continue
                at = os.path.join(self.root, path)
                try:
                    if new_mode == LINK:
                        content = os.readlink(at).encode("utf-8", "surrogateescape")
                    else:
                        with open(at, "rb") as f:
                            content = f.read()
                except FileNotFoundError:  # deleted since the names were listed
                    continue
                yield "new", shown, change, content


class Sides(DataSource):
    """Options: root, ref (HEAD), staged (false), suffix (all names), files (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "git_sides"

    def schema(self) -> str:
        return SIDES

    def reader(self, schema) -> SidesReader:
        return SidesReader(self.options)


class HeadsReader(DataSourceStreamReader):
    """Offsets are the HEAD of each root, empty for one that has none."""

    def __init__(self, options: dict):
        self.roots, self.budget = options["roots"].split("\n"), float(options.get("seconds", BUDGET))

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.roots, "")

    def latestOffset(self) -> dict:  # noqa: N802
        heads = {}
        for r in self.roots:
            try:
                heads[r] = run(r, "rev-parse", "--verify", "-q", "HEAD", timeout=self.budget).decode().strip()
            except (OSError, subprocess.SubprocessError):
                heads[r] = ""
        return heads

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Part((r, start.get(r, ""), head)) for r, head in end.items() if head and head != start.get(r, "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        root, before, head = partition.value
        paths, complete = [], True
        if before:
            try:
                out = run(root, "diff", "--name-only", "-z", "--no-renames", before, head, "--", timeout=self.budget)
                paths = sorted({p for p in out.decode("utf-8", "replace").split("\0") if p})
            except subprocess.SubprocessError:
                complete = False
        for p in paths or [None]:
            yield root, before or None, head, p, complete

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Heads(DataSource):
    """Options: roots (one a line), seconds (that git may take for a diff)."""

    @classmethod
    def name(cls) -> str:
        return "git_heads"

    def schema(self) -> str:
        return HEADS

    def streamReader(self, schema) -> HeadsReader:  # noqa: N802
        return HeadsReader(self.options)


def read_sides(spark: SparkSession, root: str, ref: str = "HEAD", staged: bool = False, suffix: str = ".md", files: int = FILES) -> DataFrame:
    """(side, path, change, content) of files that differ between a revision and the work tree or index: old and new side."""
    spark.dataSource.register(Sides)
    return spark.read.format("git_sides").options(root=os.path.abspath(root), ref=ref, staged=str(staged).lower(), suffix=suffix, files=files).load()


def stream_heads(spark: SparkSession, roots: list[str], seconds: float = BUDGET) -> DataFrame:
    """A stream of (root, before, head, path, complete): the paths of each move of a HEAD, or one row without a path where there is none, where the
    root is new (before is null), or where the diff took too long (complete is false)."""
    spark.dataSource.register(Heads)
    return spark.readStream.format("git_heads").options(roots="\n".join(os.path.abspath(r) for r in roots), seconds=seconds).load()
