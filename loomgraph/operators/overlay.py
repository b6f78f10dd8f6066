"""A base snapshot and its pending changes, read as one relation.

base: path, content.  pending: path, kind (add, modify, delete, rename), content, from_path; one row a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import matches_glob


def gone(pending: DataFrame) -> DataFrame:
    """Paths that no longer read: deleted ones, and those renamed away, even if added again."""
    deleted = pending.where(F.col("kind") == "delete").select("path")
    moved = pending.where(F.col("kind") == "rename").select(F.col("from_path").alias("path"))
    return deleted.union(moved).distinct()


def listing(base: DataFrame, pending: DataFrame, pattern: str | None = None) -> DataFrame:
    """The paths that exist; a glob is pushed into both sides."""
    ours, theirs = base.select("path"), pending.where(F.col("kind") != "delete").select("path")
    if pattern is not None:
        ours, theirs = (x.where(matches_glob(F.col("path"), pattern)) for x in (ours, theirs))
    dropped = gone(pending)
    return ours.join(dropped, "path", "left_anti").unionByName(theirs.join(dropped, "path", "left_anti")).distinct()


def read(base: DataFrame, pending: DataFrame) -> DataFrame:
    """(path, content, origin): a change's content before the base's; a rename without content reads its old path."""
    dropped = gone(pending)
    live = pending.where(F.col("kind") != "delete").join(dropped, "path", "left_anti")
    source = F.when(F.col("kind") == "rename", F.coalesce("from_path", "path")).otherwise(F.col("path"))
    wanted = live.select("path", F.col("kind").alias("origin"), F.col("content").alias("new"), source.alias("source"))
    old = base.select(F.col("path").alias("source"), F.col("content").alias("old"))
    changed = wanted.join(old, "source", "left").select("path", F.coalesce("new", "old").alias("content"), "origin")
    kept = base.select("path", "content").join(dropped, "path", "left_anti").join(live.select("path"), "path", "left_anti")
    return kept.withColumn("origin", F.lit("base")).unionByName(changed)


def exists(base: DataFrame, pending: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path) with exists: as a file, or as a directory of one.  A directory of the base still exists
    when all its files are deleted.  Directories are made from paths once, so this is an equi-join."""
    def directories(paths: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        return paths.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("path"))

    here = listing(base, pending)
    known = here.unionByName(directories(here)).unionByName(directories(base.select("path"))).distinct().withColumn("found", F.lit(True))
    return asked.join(known, "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("exists"))


def status(pending: DataFrame) -> DataFrame:
    return pending.select("path", "kind")


def counts(pending: DataFrame) -> DataFrame:
    """(files, added, modified, deleted, renamed): what a commit would hold."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return pending.agg(F.count(F.lit(1)).alias("files"), of("add").alias("added"), of("modify").alias("modified"), of("delete").alias("deleted"), of("rename").alias("renamed"))


def in_order(pending: DataFrame) -> DataFrame:
    return pending.orderBy("path")


def emitted(memos: DataFrame, files: str) -> DataFrame:
    """(path): every path of any memo's map of files."""
    return memos.select(F.explode(F.map_keys(files)).alias("path")).distinct()


def diff(base: DataFrame, pending: DataFrame) -> DataFrame:
    """(path, kind, before, after) of each change; a delete has nothing after."""
    before = base.select("path", F.col("content").alias("before"))
    after = F.when(F.col("kind") != "delete", F.col("content"))
    return pending.join(before, "path", "left").select("path", "kind", "before", after.alias("after"))


def to_hydrate(asked: DataFrame, pending: DataFrame) -> DataFrame:
    """Base paths whose content a read of asked (path) needs: changes with content need none, renames their old path."""
    met = asked.join(pending, "path", "left")
    need = F.when(F.col("kind").isNull(), F.col("path")).when((F.col("kind") == "rename") & F.col("content").isNull(), F.col("from_path"))
    return met.select(need.alias("path")).where("path is not null").distinct()


def upsert(pending: DataFrame, saves: DataFrame) -> DataFrame:
    """pending with saves (path, kind, content, from_path): an old row keeps its kind, but a saved delete becomes a modify."""
    old, new = pending.alias("o"), saves.alias("n")
    kind = F.when(F.col("o.kind") == "delete", "modify").otherwise(F.coalesce("o.kind", "n.kind"))
    merged = old.join(new, "path", "full")
    saved = F.col("n.kind").isNotNull()
    return merged.select("path", F.when(saved, kind).otherwise(F.col("o.kind")).alias("kind"), F.when(saved, F.col("n.content")).otherwise(F.col("o.content")).alias("content"), F.when(saved & (F.col("o.kind") != "rename"), F.lit(None)).otherwise(F.coalesce("o.from_path", "n.from_path")).alias("from_path"))


def remove(pending: DataFrame, paths: DataFrame) -> DataFrame:
    """pending with paths deleted: an added one is forgotten, the others become deletes."""
    kept = pending.join(paths, "path", "left_anti")
    added = pending.where(F.col("kind") == "add").select("path")
    marks = paths.join(added, "path", "left_anti").select("path", F.lit("delete").alias("kind"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("from_path"))
    return kept.unionByName(marks)


def revert(pending: DataFrame, paths: DataFrame) -> DataFrame:
    return pending.join(paths, "path", "left_anti")


def insert_absent(memo: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """memo with the rows whose key it lacks; of rows with one key, the least stays."""
    fresh = rows.join(memo.select(*key), list(key), "left_anti")
    rest = [c for c in rows.columns if c not in key]
    once = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*")
    return memo.unionByName(once.select(*memo.columns))


def violations(pending: DataFrame) -> DataFrame:
    """(path, rule) of changes that break a table constraint."""
    c = F.col
    rules = {
        "kind": ~c("kind").isin("add", "modify", "delete", "rename"),
        "delete has no content": (c("kind") == "delete") & c("content").isNotNull(),
        "change has content": c("kind").isin("add", "modify") & c("content").isNull(),
        "rename has an old path": (c("kind") == "rename") & (c("from_path").isNull() | (c("from_path") == c("path"))),
        "relative path": ~((c("path") != "") & ~c("path").startswith("/") & ~c("path").contains("..")),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return pending.select("path", F.explode(broken).alias("rule"))
