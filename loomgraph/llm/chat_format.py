"""Chat formatting into budgeted windows; DataFrame functions only.

A conversation's turns get prefix sums of their tokens.  The sums, cut on a grid, give turn-aligned spans:
the turns that begin in one cell are new in one window.  The grid leaves room for the system turn, for
HISTORY and for the last turn of a cell, so that a window keeps to the budget; a turn for which there is
no such room has a window of its own.  A window repeats the system turn and up to HISTORY tokens of the
turns before it; repeated turns are never under the loss mask, so each assistant text is a target once.

Template: a header line and a closing mark around each turn, with every character that could begin a
control string escaped inside roles and texts, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written

BUDGET = 1024
HISTORY = 256
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: What is escaped, in this order; undone in the other.  With '<' and '[' gone no control string of this
#: or of the usual other templates is left; the ampersand goes first, so that undoing is exact.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a turn's marks: the header's and the closing one.
MARKS = 2
#: Turn numbers of a conversation that are summed in one task; prefix sums are then carried over.
PART = 256
ASSISTANT = "assistant"
SYSTEM = "system"


def escaped(text: Column) -> Column:
    for plain, marked in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescaped(text: Column) -> Column:
    for plain, marked in reversed(ESCAPES):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def escaped_role(role: Column) -> Column:
    """A role is one line of the template, so its line breaks are escaped too."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(rid, conv, turn, role, text, size): size in tokens with the marks; null roles and texts are empty."""
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.regexp_count("role", F.lit(WORD)) + F.regexp_count("text", F.lit(WORD)) + MARKS
    return written(plain.withColumn("size", size.cast("bigint")).withColumn("rid", F.monotonically_increasing_id()), "turns")


def _same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """An inner join on keys, of which nulls are equal; the keys are left's."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"__{k}"])
    return left.join(other, on).drop(*[f"__{k}" for k in keys])


def _carried(rows: DataFrame, **sums: Column) -> DataFrame:
    """rows (conv, part, ...) with the sums of all earlier parts of the conversation."""
    by_part = rows.groupBy("conv", "part").agg(*[c.alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return _same(rows, by_part.select("conv", "part", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums]), "conv", "part")


def spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Turns (rid, conv, turn, role, text, size) to (rid, conv, n, window, repeated): which windows show which turns.

    Of the room beside the system turn and HISTORY, a cell of the grid takes what the longest turn leaves,
    at least half; so the turns that begin in a cell fit into the room.  A turn of over half the room stands
    alone.  Only a window of the system turn and one turn that don't fit together passes the budget.
    """
    part = F.coalesce(F.expr(f"CAST(floor(turn / {PART}) AS BIGINT)"), F.lit(-(1 << 62)))
    narrow = turns.select("rid", "conv", "turn", "role", F.md5("text").alias("tie"), "size", part.alias("part"))
    inside = Window.partitionBy("conv", "part").orderBy("turn", "role", "tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    counted = _carried(narrow, count=F.count(F.lit(1)), tokens=F.sum("size"))
    numbered = counted.withColumn("n", F.col("count") + F.row_number().over(inside)).withColumn("is_system", (F.col("n") == 1) & (F.col("role") == SYSTEM))
    numbered = numbered.withColumn("behind", F.col("tokens") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    numbered = written(numbered.select("rid", "conv", "part", "turn", "role", "tie", "size", "n", "is_system", "behind"), "numbered-turns")

    own, most = F.coalesce(F.max(F.when(F.col("is_system"), F.col("size"))), F.lit(0)), F.coalesce(F.max(F.when(~F.col("is_system"), F.col("size"))), F.lit(1))
    room = numbered.groupBy("conv").agg(own.alias("system"), most.alias("most"))
    room = room.withColumn("half", F.expr(f"greatest(({budget} - system - {history}) div 2, 1)")).withColumn("least_long", F.least("most", "half"))
    room = room.withColumn("stride", F.greatest(F.lit(budget - history) - F.col("system") - F.col("least_long"), F.lit(1))).withColumn("back", F.least(F.lit(history), "half"))
    known = _same(numbered, room.drop("most", "half"), "conv")
    known = known.withColumn("before", F.when(F.col("n") > 1, F.col("behind") - F.col("system")).otherwise(0)).withColumn("long", ~F.col("is_system") & (F.col("size") > F.col("least_long")))
    known = _carried(known, longs=F.count_if("long")).withColumn("nth_long", F.col("longs") + F.sum(F.col("long").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cell = F.struct("nth_long", (~F.col("long")).alias("among"), F.when(F.col("long"), F.lit(0)).otherwise(F.expr("before div stride")).alias("at"))
    known = written(known.select("rid", "conv", "n", "is_system", "size", "before", "least_long", "stride", "back", cell.alias("cell")), "placed-turns")
    placed = known.where(~F.col("is_system"))

    along = Window.partitionBy("conv").orderBy("cell")
    cells = placed.groupBy("conv", "cell").agg(F.min("before").alias("begin"), F.sum("size").alias("fresh")).withColumn("window", F.row_number().over(along).cast("bigint"))
    here = F.struct("begin", "fresh", "window")
    cells = written(cells.withColumn("x1", F.lead(here, 1).over(along)).withColumn("x2", F.lead(here, 2).over(along)), "windows")

    def repeat(x: str) -> Column:
        near = (F.col(f"{x}.begin") - F.col("before") <= F.col("back")) & (F.col(f"{x}.fresh") <= F.col("stride") + F.col("least_long"))
        return F.when(near, F.struct(F.col(f"{x}.window").alias("window"), F.lit(True).alias("repeated")))

    # `back` tokens reach over no more than two starts of windows.
    shown = F.filter(F.array(F.struct("window", F.lit(False).alias("repeated")), repeat("x1"), repeat("x2")), lambda x: x.isNotNull())
    turns_in = _same(placed, cells.select("conv", "cell", "window", "x1", "x2"), "conv", "cell").withColumn("shown", F.explode(shown)).select("rid", "conv", "n", "shown.window", "shown.repeated")
    system = known.where("is_system").select("rid", "conv", "n")
    first = system.select("rid", "conv", "n", F.lit(1).cast("bigint").alias("window"), F.lit(False).alias("repeated"))
    heads = _same(system, cells.where("window > 1").select("conv", "window"), "conv").select("rid", "conv", "n", "window", F.lit(True).alias("repeated"))
    return turns_in.unionByName(first).unionByName(heads)


def windows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, window, n_repeated, formatted, loss): loss is an array of (start, length) in formatted, by code point from 1.

    Turns are in order of turn (nulls first), then role and the text's md5; repeated rows are turns of their
    own.  The first turn, if its role is system, is the system turn and heads every window; a conversation
    of it alone is one window.  A turn is never cut.  A token is a word of a role or text, or a mark.
    """
    turns = _turns(rows, conv, turn, role, text)
    shown = spans(turns, budget, history)
    return _formatted(shown.join(turns.select("rid", "role", "text"), "rid").select("conv", "window", "repeated", "n", "role", "text"))


def _formatted(rows: DataFrame) -> DataFrame:
    """Turns (conv, window, repeated, n, role, text) to one formatted string for each window, and its loss mask."""
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    target = (F.col("role") == ASSISTANT) & ~F.col("repeated")
    pieces = rows.select("conv", "window", F.struct("n", "repeated", head.alias("head"), body.alias("body"), target.alias("target")).alias("piece"))
    ordered = pieces.groupBy("conv", "window").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    shown = F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))
    measured = ordered.select("conv", "window", F.size(F.filter("p", lambda x: x["repeated"])).alias("n_repeated"), F.array_join(shown, "").alias("formatted"), F.transform("p", lambda x: F.struct(F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), x["target"].alias("target"))).alias("sizes"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    step = lambda acc, x: F.struct((acc["at"] + x["head"] + x["body"] + len(CLOSE)).alias("at"), F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length"))))).otherwise(acc["loss"]).alias("loss"))
    return measured.select("conv", "window", "n_repeated", "formatted", F.aggregate("sizes", start, step)["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its windows: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed out of the formatted strings and unescaped; repeated ones are passed over.
    """
    marks = F.split(F.col("formatted"), r"\Q" + OPEN + r"\E")  # the first part is empty
    turns = F.slice(marks, F.col("n_repeated") + 2, F.size(marks))
    turn = lambda x: F.concat(unescaped_role(F.substring_index(x, MIDDLE, 1)), F.lit("\n"), unescaped(_body(x)), F.lit("\n"))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"], s["length"])))
    parts = formatted.select("conv", "window", F.length("formatted").cast("bigint").alias("chars"), F.size(turns).alias("n"), F.array_join(F.transform(turns, turn), "").alias("turns"), F.array_join(masked, "").alias("loss"))
    joined = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = joined.select("conv", "n_turns", "formatted_chars", F.array_join(F.transform("w", lambda x: x["turns"]), "").alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"))
    return whole.select("conv", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


def _body(turn: Column) -> Column:
    """The escaped text of `role line break text closing mark`."""
    from_ = F.length(F.substring_index(turn, MIDDLE, 1)) + len(MIDDLE) + 1
    return F.substring(turn, from_, F.length(turn) - from_ - len(CLOSE) + 1)


def formatted_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **settings: int) -> DataFrame:
    """The digest of each conversation, read back from its formatted windows."""
    return read_back(windows(rows, conv, turn, role, text, **settings)).withColumnRenamed("conv", conv)


def report_sql(rows: str) -> str:
    """DuckDB SQL of the report over `rows`, a query that gives conv_id, turn, role, text."""
    escape = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"
    frame = len(OPEN) + len(MIDDLE) + len(CLOSE)
    count = f"len(regexp_extract_all({{x}}, '{WORD}'))"
    return f"""WITH r AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM ({rows})),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM r),
s AS (SELECT *, n = 1 AND role = '{SYSTEM}' AS sys, {count.format(x='role')} + {count.format(x='text')} + {MARKS} AS size,
  length(replace({escape.format(x='role')}, chr(10), '&nl;')) + length({escape.format(x='text')}) + {frame} AS chars FROM t),
g AS (SELECT conv_id, COALESCE(MAX(size) FILTER (sys), 0) AS head, COALESCE(MAX(size) FILTER (NOT sys), 1) AS most FROM s GROUP BY conv_id),
h AS (SELECT *, least(most, half) AS long, greatest({BUDGET - HISTORY} - head - least(most, half), 1) AS stride, least({HISTORY}, half) AS back FROM (SELECT *, greatest(({BUDGET} - head - {HISTORY}) // 2, 1) AS half FROM g)),
b AS (SELECT s.*, long, stride, back, COALESCE(SUM(CASE WHEN sys THEN 0 ELSE size END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s JOIN h USING (conv_id)),
p AS (SELECT *, SUM(CASE WHEN NOT sys AND size > long THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS k1, (size <= long)::INT AS k2, CASE WHEN size > long THEN 0 ELSE before // stride END AS k3 FROM b),
w AS (SELECT *, row_number() OVER o AS nth, lead(lo) OVER o AS x1, lead(fresh) OVER o AS f1, lead(lo, 2) OVER o AS x2, lead(fresh, 2) OVER o AS f2
  FROM (SELECT conv_id, k1, k2, k3, min(before) AS lo, SUM(size) AS fresh FROM p WHERE NOT sys GROUP BY ALL) WINDOW o AS (PARTITION BY conv_id ORDER BY k1, k2, k3)),
own AS (SELECT conv_id, SUM(chars * (1 + CASE WHEN x1 - before <= back AND f1 <= stride + long THEN 1 ELSE 0 END + CASE WHEN x2 - before <= back AND f2 <= stride + long THEN 1 ELSE 0 END)) AS chars FROM p JOIN w USING (conv_id, k1, k2, k3) WHERE NOT sys GROUP BY conv_id),
heads AS (SELECT p.conv_id, SUM(p.chars * greatest(COALESCE(c.n, 1), 1)) AS chars FROM p LEFT JOIN (SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id) c ON c.conv_id = p.conv_id WHERE p.sys GROUP BY p.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns, COALESCE(string_agg(text, '' ORDER BY n) FILTER (role = '{ASSISTANT}'), '') AS loss FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (COALESCE(own.chars, 0) + COALESCE(heads.chars, 0))::BIGINT AS formatted_chars
FROM d LEFT JOIN own USING (conv_id) LEFT JOIN heads USING (conv_id)"""
