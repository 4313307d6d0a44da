"""Git histories as a Python data source: spark.read.format("git_commits").option("repo", ...).load().

Every row is a commit with its diff against the first parent (or all of it, for a root commit).
Commits are listed on the driver; diffs are read by the executors, a block of commits a task, so
the repository must lie where they can reach it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "commit string, parent string, author string, subject string, message string, raw string, changed_files array<string>"
COMMITS_A_TASK = 200
TIMEOUT_S = 60


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=TIMEOUT_S, check=True)
    return done.stdout.decode("utf-8", "replace")


def resolve(repo: str, ref: str = "HEAD") -> str | None:
    """The full hash of a ref; null where there is no such commit, repository or git."""
    try:
        return git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


class _Block(InputPartition):
    def __init__(self, commits: list[str]):
        self.commits = commits


class _Reader(DataSourceReader):
    def __init__(self, repo: str, ref: str, most: int | None):
        self.repo, self.ref, self.most = repo, ref, most

    def partitions(self) -> list[InputPartition]:
        limit = [f"-n{self.most}"] if self.most else []
        commits = git(self.repo, "rev-list", *limit, self.ref).split()
        return [_Block(commits[i : i + COMMITS_A_TASK]) for i in range(0, len(commits), COMMITS_A_TASK)]

    def read(self, partition: _Block) -> Iterator[tuple]:
        # What commits say of themselves comes from one process a block.
        told = git(self.repo, "log", "--no-walk=unsorted", "--format=%P%x00%an%x00%s%x00%B%x00%x01", *partition.commits).split("\0\x01")
        for commit, row in zip(partition.commits, told):
            parents, author, subject, message = row.lstrip("\n").split("\0", 3)
            parent = parents.split()[0] if parents.split() else None
            if parent:
                raw = git(self.repo, "diff", "--no-color", "--no-ext-diff", parent, commit)
                names = git(self.repo, "diff", "--name-only", "-z", parent, commit)
            else:
                raw = git(self.repo, "show", "--no-color", "--no-ext-diff", "--format=", commit)
                names = git(self.repo, "show", "--name-only", "-z", "--format=", commit)
            yield commit, parent, author, subject, message.strip("\n"), raw, [n for n in names.strip("\n").split("\0") if n]


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("limit")
        return _Reader(self.options["repo"], self.options.get("ref", "HEAD"), int(most) if most else None)


class _TreeReader(DataSourceReader):
    def __init__(self, repo: str, ref: str):
        self.repo, self.ref = repo, ref

    def partitions(self) -> list[InputPartition]:
        rows = git(self.repo, "ls-tree", "-r", "-z", "--format=%(objecttype) %(objectname) %(path)", self.ref).split("\0")
        blobs = [r.split(" ", 2)[1:] for r in rows if r.startswith("blob ")]
        return [_Block(blobs[i : i + COMMITS_A_TASK]) for i in range(0, len(blobs), COMMITS_A_TASK)]

    def read(self, partition: _Block) -> Iterator[tuple]:
        # One process a block, and one file in memory at a time.
        with subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as cat:
            for blob, path in partition.commits:
                cat.stdin.write(f"{blob}\n".encode())
                cat.stdin.flush()
                size = int(cat.stdout.readline().split()[2])
                source = cat.stdout.read(size)
                cat.stdout.read(1)
                yield path, size, source.decode("utf-8", "replace")


class GitTree(DataSource):
    """The files of one commit, without a checkout: options repo and ref."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "rel_path string, byte_count long, source string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["repo"], self.options.get("ref", "HEAD"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitCommits)
    spark.dataSource.register(GitTree)
