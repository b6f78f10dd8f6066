"""Which of a project's files a reader of its code is given: documents, context, and all code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import glob_prefix, glob_regex_of

#: Code by its extension.
CODE = r"\.(py|tsx?|js)$"
MOST_FILES, MOST_BYTES = 60, 200 * 1024


def is_document(path: Column) -> Column:
    """A graph, an agent's manifest or its prompt, by the shape of its path."""
    return path.rlike(r"^(graphs/[^/]+\.ya?ml|agents/[^/]+/(agent\.ya?ml|prompt\.md))$")


def code_files(files: DataFrame, written: DataFrame, own: str) -> DataFrame:
    """Code that people maintain: not under the own directory, and not among what was written (path) before."""
    code = files.where(F.col("path").rlike(CODE) & ~F.col("path").startswith(f"{own}/"))
    return code.join(written.select("path").distinct(), "path", "left_anti")


def referenced(files: DataFrame, paths: DataFrame, directories: DataFrame) -> DataFrame:
    """The files that paths (path) names, or that are under one of directories (path, ending in a slash).

    A file's directories are made from its path, so that both ways are equi-joins.
    """
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    under = files.select("path", F.explode(above).alias("dir")).join(directories.select(F.col("path").alias("dir")), "dir", "left_semi").select("path")
    hit = files.select("path").join(paths.select("path"), "path", "left_semi").union(under).distinct()
    return files.join(hit, "path", "left_semi")


def capped(files: DataFrame, most: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The first files by path that are not too large."""
    return files.where(F.octet_length("content") <= most_bytes).orderBy("path").limit(most)


def glob_matches(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, path) of the files (path) that patterns (pattern) match.

    A pattern meets the files below the directory above its first wildcard, by an equal join on that
    directory; its regular expression is applied to those alone.  Patterns of no directory meet all files.
    """
    asked = patterns.select("pattern").distinct().select("pattern", glob_prefix(F.col("pattern")).alias("above"), glob_regex_of(F.col("pattern")).alias("regex"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    below = files.select("path").distinct().select("path", F.explode(above).alias("above"))
    return below.join(asked, "above").where(F.rlike("path", F.col("regex"))).select("pattern", "path")
