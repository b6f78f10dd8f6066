"""Changes of texts by spans: many edits of many files at once, all characters outside the spans unchanged.

Files are (path, content).  An edit (path, start, end, text, and ord for edits at one place) puts text in
the place of the code points from start up to end; an empty span is an insertion.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import pointer_escape

SPANS = "path string, pointer string, start int, end int, kind string"
#: Words that YAML reads as something else than a string.
NOT_TEXT = ("true", "false", "null", "yes", "no", "on", "off", "y", "n")


def refusals(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, refusal) of the files whose edits cannot all be made: no such file, a span outside the text, or spans that overlap."""
    placed = edits.join(files.select("path", F.length("content").alias("size")), "path", "left")
    order = Window.partitionBy("path").orderBy("start", "end", "ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    wrong = (
        F.when(F.col("size").isNull(), "no such file")
        .when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("size")), "a span is outside the text")
        .when(reach > F.col("start"), "spans overlap")
    )
    return placed.withColumn("refusal", wrong).where("refusal is not null").groupBy("path").agg(F.min("refusal").alias("refusal"))


def spliced(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files after the edits; a file with a refusal is as it was.  Edits at one place come in the order of ord."""
    able = edits.join(refusals(files, edits).select("path"), "path", "left_anti")
    by_file = able.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "ord", "text"))).alias("e"))
    met = files.join(by_file, "path", "left")

    def piece(e: Column, k: Column) -> Column:
        before = F.when(k == 0, 0).otherwise(F.get("e", k - 1)["end"])
        return F.concat(F.substring(F.col("content"), before + 1, e["start"] - before), e["text"])

    last = F.element_at("e", -1)["end"]
    whole = F.concat(F.array_join(F.transform("e", piece), ""), F.substring(F.col("content"), last + 1, F.length("content") - last))
    return met.withColumn("content", F.when(F.col("e").isNull(), F.col("content")).otherwise(whole)).drop("e")


def value_spans(files: DataFrame) -> DataFrame:
    """(path, pointer, start, end, kind) of the values of YAML files (path, content): scalars, and lists and maps in
    brackets, which alone have an end of their own.  A file that does not parse has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for part in parts:
            rows: list[tuple[Any, ...]] = []
            for path, text in zip(part["path"], part["content"], strict=True):
                try:
                    waiting = [("", yaml.compose(text, Loader=yaml.SafeLoader))] if text else []
                except yaml.YAMLError:
                    continue
                while waiting:
                    pointer, node = waiting.pop()
                    if node is None:
                        continue
                    flow = getattr(node, "flow_style", False)
                    if isinstance(node, yaml.ScalarNode) or flow:
                        start, end = node.start_mark.index, node.end_mark.index
                        end -= len(text[start:end]) - len(text[start:end].rstrip())
                        rows.append((path, pointer, start, end, node.id))
                    if isinstance(node, yaml.SequenceNode):
                        waiting += [(f"{pointer}/{k}", x) for k, x in enumerate(node.value)]
                    elif isinstance(node, yaml.MappingNode):
                        waiting += [(f"{pointer}/{k.value.replace('~', '~0').replace('/', '~1')}", v) for k, v in node.value if isinstance(k, yaml.ScalarNode)]
            yield pd.DataFrame(rows, columns=["path", "pointer", "start", "end", "kind"])

    return files.where("content is not null").select("path", "content").mapInPandas(run, SPANS)


def yaml_text(value: Column) -> Column:
    """A string as a YAML scalar: plain where that reads as the same string, else quoted."""
    plain = value.rlike(r"^[A-Za-z_][A-Za-z0-9_./-]*( [A-Za-z0-9_./-]+)*$") & ~F.lower(value).isin(*NOT_TEXT)
    quoted = F.to_json(F.array(value))
    return F.when(plain, value).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def set_values(files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, outcome): YAML files with changes (path, pointer, value) of scalars made in place, comments and layout
    untouched; outcome (path, pointer, refusal) says which pointers name no scalar.  Values are strings."""
    known = value_spans(files.join(changes.select("path").distinct(), "path", "left_semi")).where("kind = 'scalar'")
    met = changes.join(known, ["path", "pointer"], "left")
    edits = met.where("start is not null").select("path", "start", "end", F.lit(0).alias("ord"), yaml_text(F.col("value")).alias("text"))
    outcome = met.select("path", "pointer", F.when(F.col("start").isNull(), "no such value").alias("refusal"))
    return spliced(files, edits), outcome


def pointer_of(*parts: Column) -> Column:
    return F.concat(*[F.concat(F.lit("/"), pointer_escape(p)) for p in parts])
