"""Small deterministic folds: capped selection, fingerprints, numbering, grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_select(files: DataFrame, group: list[str], path: str, size: Column, most_each: int, most_total: int) -> DataFrame:
    """files with included: in path order, a file goes in if it is small enough and still fits; a later, smaller one may.

    A fold, not a running sum: what is left out takes no room.  A group's paths and sizes stream through one task.
    """
    narrow = _in_order(files.select(*group, path, size.cast("bigint").alias("__size")), group, path, "__size").select(*group, F.col(path).cast("string").alias(path), "__size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for batch in batches:
            taken = []
            for key, n in zip(_keys(batch, len(group)), batch.column(len(group) + 1).to_pylist(), strict=True):
                if key != now:
                    now, total = key, 0
                fits = n is not None and n <= most_each and total + n <= most_total
                total += n if fits else 0
                taken.append(fits)
            yield batch.select([*range(len(group) + 1)]).filter(pa.array(taken, pa.bool_()))

    return narrow.mapInArrow(run, narrow.drop("__size").schema)


def _in_order(rows: DataFrame, group: list[str], *order: str) -> DataFrame:
    """rows with each group in one partition and in order there, for Arrow batches of at most 8 MB."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return rows.repartition(*group).sortWithinPartitions(*group, *order)


def _keys(batch: pa.RecordBatch, n: int) -> Iterator[tuple]:
    """The first n columns by row; they are never None as a whole, nulls in them equal each other."""
    return zip(*[batch.column(k).to_pylist() for k in range(n)], strict=True)


def first_n(files: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return files.withColumn("place", place).where(F.col("place") <= most).drop("place")


# Extensions of files that are bytes, and directories that never travel.
BINARY = r"(?i)\.(png|jpe?g|gif|webp|ico|icns|bmp|pdf|zip|gz|tgz|tar|woff2?|ttf|otf|eot|mp[34]|mov|avi|wasm|pyc|so|dylib|dll|jar|class|sqlite|db)$"
SKIPPED = r"(^|/)(node_modules|\.git)/"


def session_files(files: DataFrame, path: str, content: str, most: int = 400, most_bytes: int = 200 * 1024) -> DataFrame:
    """The first text files by path that a session gets; the limit counts after the filters."""
    p, c = F.col(path), F.col(content)
    text = ~p.rlike(BINARY) & (F.octet_length(c) <= most_bytes) & (F.instr(c, "\0") == 0)
    return files.where(~p.rlike(SKIPPED) & text).orderBy(path).limit(most)


def fingerprint(files: DataFrame, group: list[str], path: str, content: str, patterns: str, model: str, version: str) -> DataFrame:
    """(group, input_hash): SHA-256 over the sorted path\\0content\\0 pairs, then patterns\\0model\\0version.

    A group's texts stream in order through one task, as the hash is of them all in a row; a row without path or content adds nothing.
    """
    rows = _in_order(files.select(*group, path, content), group, path, content)
    texts = rows.select(*group, F.col(path).cast("string").alias("__path"), F.col(content).cast("string").alias("__content"))
    end = "\0".join((patterns, model, version)).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, head = None, None, None

        def done() -> pa.RecordBatch:
            digest.update(end)
            return pa.RecordBatch.from_arrays([*head.columns, pa.array([digest.hexdigest()])], names=[*head.schema.names, "input_hash"])

        for batch in batches:
            for k, key in enumerate(_keys(batch, len(group))):
                if key != now:
                    if digest:
                        yield done()
                    # A copy of the one row, which does not hold its batch.
                    now, digest, head = key, hashlib.sha256(), batch.select([*range(len(group))]).take(pa.array([k]))
                p, c = batch.column(len(group))[k].as_py(), batch.column(len(group) + 1)[k].as_py()
                if p is not None and c is not None:
                    for part in (p.encode(), b"\0", c.encode(), b"\0"):
                        digest.update(part)
        if digest:
            yield done()

    return texts.mapInArrow(run, files.select(*group, F.lit("").alias("input_hash")).schema)


def ports(rows: DataFrame, group: str, base: Column, *order: str | Column) -> DataFrame:
    """rows with port: the group's base and the place in order."""
    return rows.withColumn("port", (base + F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("bigint"))


def next_id(taken: DataFrame, group: str, number: str) -> DataFrame:
    """(group, next): the smallest number from 1 that is not taken: where the sorted distinct numbers first leave their places."""
    own = taken.where(F.col(number) >= 1).select(group, number).distinct()
    place = F.row_number().over(Window.partitionBy(group).orderBy(number))
    run = own.withColumn("place", place).groupBy(group).agg(F.max(F.when(F.col("place") == F.col(number), F.col("place"))).alias("upto"))
    return taken.select(group).distinct().join(run, group, "left").select(group, (F.coalesce("upto", F.lit(0)) + 1).cast("bigint").alias("next"))


def by_directory(files: DataFrame, path: str) -> DataFrame:
    """(dir, files, place): files by directory in path order, the root first."""
    directory = F.regexp_extract(path, r"^(.*)/", 1)
    grouped = files.select(directory.alias("dir"), path).groupBy("dir").agg(F.sort_array(F.collect_list(path)).alias("files"))
    return grouped.orderBy(F.col("dir") != "", "dir")


def session_phase(processes: DataFrame, group: str, state: str) -> DataFrame:
    """(group, phase): running if any process runs, exited if all have."""
    running, exited = F.bool_or(F.col(state) == "running"), F.bool_and(F.col(state) == "exited")
    return processes.groupBy(group).agg(F.when(running, "running").when(exited, "exited").otherwise("starting").alias("phase"))


def best_branch(issues: DataFrame, case: str, branch: str, order: str | None = None) -> DataFrame:
    """(case, branch, issues): of a union's branches the one with the fewest issues; on ties the first in order, by default of names."""
    place = order or branch
    counts = issues.groupBy(case, branch).agg(F.sum("n").cast("bigint").alias("issues"), F.min(place).alias("__place"))
    return counts.groupBy(case).agg(F.min_by(branch, F.struct("issues", "__place", branch)).alias(branch), F.min("issues").alias("issues"))


def distinct_cycles(cycles: DataFrame, path: str) -> DataFrame:
    """One cycle for each set of nodes."""
    return cycles.withColumn("key", F.array_sort(path)).groupBy("key").agg(F.min(path).alias(path)).drop("key")


def stale(rows: DataFrame) -> Column:
    """A memo is stale without state, when flagged, when the head moved, or without patterns."""
    return F.coalesce(F.col("state").isNull() | F.coalesce("flagged", F.lit(False)) | ~F.col("seen_head").eqNullSafe(F.col("head")) | F.col("patterns").isNull(), F.lit(True))
