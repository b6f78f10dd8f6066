"""A repository of snapshots in a shared folder, committed to under a guard.

path/trees/commit=... (path, blob_sha, size) and path/blobs/commit=... (blob_sha, content) are Parquet tables,
path/heads/BRANCH/N one small file for each time the branch moved, holding the commit.  A commit writes its
tables first and then creates the next head file, which only one of several writers can; who comes second
finds the branch moved, and its tables are of no commit that a branch has.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import is_relative_path
from loomgraph.sources.files import commit as next_snapshot

TREE = "commit_sha string, path string, blob_sha string, size bigint"
BLOBS = "blob_sha string, content string"


class BranchMoved(RuntimeError):
    """Someone else moved the branch; head is where it is now."""

    def __init__(self, head: str | None) -> None:
        super().__init__(f"the branch moved to {head}")
        self.head = head


class NothingToCommit(ValueError):
    """The changes leave the tree as it is."""


@dataclass(frozen=True)
class Committed:
    commit: str
    parent: str | None
    #: Where the branch had moved meanwhile, if the commit was put on top of that.
    reparented_onto: str | None = None


@dataclass(frozen=True)
class Repository:
    spark: SparkSession
    path: str

    def _hadoop(self, at: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def head(self, branch: str) -> tuple[int, str | None]:
        """How often the branch moved, and its commit; none for a branch that nobody has committed to."""
        files, where = self._hadoop(f"heads/{branch}")
        if not files.exists(where):
            return 0, None
        last = max((int(f.getPath().getName()) for f in files.listStatus(where) if f.getPath().getName().isdigit()), default=0)
        if not last:
            return 0, None
        stream = files.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, str(last)))
        try:
            return last, bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def tree(self, commit: str | None) -> DataFrame:
        """(commit_sha, path, blob_sha, size) of a commit."""
        if commit is None:
            return self.spark.createDataFrame([], TREE)
        return self.spark.read.schema("path string, blob_sha string, size bigint").parquet(f"{self.path}/trees/commit={commit}").select(F.lit(commit).alias("commit_sha"), "path", "blob_sha", "size")

    def files(self, commit: str | None) -> DataFrame:
        """(path, content) of a commit."""
        if commit is None:
            return self.spark.createDataFrame([], "path string, content string")
        blobs = self.spark.read.schema(BLOBS).parquet(f"{self.path}/blobs")
        return self.tree(commit).join(blobs.dropDuplicates(["blob_sha"]), "blob_sha").select("path", "content")

    def _move(self, branch: str, number: int, commit: str) -> bool:
        files, where = self._hadoop(f"heads/{branch}/{number}")
        try:
            stream = files.create(where, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(commit.encode()))
        stream.close()
        return True

    def _attempt(self, branch: str, changes: DataFrame, expected: str | None, checked: bool) -> Committed:
        number, parent = self.head(branch)
        if checked and parent != expected:
            raise BranchMoved(parent)
        old = self.tree(parent)
        gone = changes.where("kind = 'delete'").select("path").unionByName(changes.where("from_path is not null").select(F.col("from_path").alias("path")))
        written = changes.where("kind <> 'delete'").select("path", "content")
        fresh, blobs = next_snapshot(old, written, parent or "", "new")
        kept = old.join(gone.unionByName(written.select("path")), "path", "left_anti").select("path", "blob_sha", "size")
        tree = kept.unionByName(fresh.select("path", "blob_sha", "size"))
        told = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "blob_sha").cast("decimal(38,0)"))).first()
        mark = told(tree)
        if mark == told(old.select("path", "blob_sha", "size")):
            raise NothingToCommit("the changes leave the tree as it is")
        commit = self.spark.range(1).select(F.sha1(F.lit(f"{parent} {number} {mark[0]} {mark[1]}").cast("binary")).alias("c")).first().c
        tree.write.mode("overwrite").parquet(f"{self.path}/trees/commit={commit}")
        blobs.write.mode("overwrite").parquet(f"{self.path}/blobs/commit={commit}")
        if not self._move(branch, number + 1, commit):
            raise BranchMoved(self.head(branch)[1])
        return Committed(commit, parent)

    def commit(self, branch: str, changes: DataFrame, expected: str | None = None, checked: bool = False, on_moved: str = "reparent") -> Committed:
        """Commits changes (path, kind: add, modify, delete or rename, from_path, content) to a branch.

        checked: only on top of `expected`.  If the branch moves meanwhile, the changes are put on top of its
        new head, once; a second time, or with on_moved "refuse", BranchMoved tells where it is.  Of files
        that both changed, these changes win.  Paths that leave the project are refused, and nothing is written.
        """
        bad = changes.where(~is_relative_path(F.col("path")))
        if not bad.isEmpty():
            raise ValueError(f"{bad.first().path} leaves the project")
        try:
            return self._attempt(branch, changes, expected, checked)
        except BranchMoved as moved:
            if on_moved != "reparent":
                raise
            again = self._attempt(branch, changes, moved.head, True)
            return Committed(again.commit, again.parent, moved.head)
