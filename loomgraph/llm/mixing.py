"""Mixing sources to target weights: a token budget handed down a domain-language-source tree.

Everything is DataFrame work.  A node's budget goes to its children by weight, each up to what it can give
(its tokens times MOST_EPOCHS); what a child cannot give goes to its siblings, and only what all of them
cannot give stays with the parent's own siblings, because a node's capacity is known before it is asked.
A leaf's budget takes whole seeded epochs, then the prefix of the next epoch's order that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import text_hash, written

#: Whole numbers from 1 to 1000; names that are not listed weigh DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"web": 40, "forum": 20, "books": 25, "code": 15}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
SOURCE_WEIGHTS: dict[str, int] = {}
DEFAULT_WEIGHT = 5
MOST_EPOCHS = 2
#: The budget as a share, in thousandths, of all tokens.
BUDGET_PER_MILLE = 700
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Sources by their number: five to a domain.
DOMAIN_SQL = """CASE WHEN {source} IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'web'
WHEN {source} IN ('src5', 'src6', 'src7', 'src8', 'src9') THEN 'forum'
WHEN {source} IN ('src10', 'src11', 'src12', 'src13', 'src14') THEN 'books'
WHEN {source} IN ('src15', 'src16', 'src17', 'src18', 'src19') THEN 'code' ELSE 'other' END"""
LEVELS = ("domain", "lang", "source")
#: Hex digits of an epoch key that name its bucket: 4096 buckets for each leaf.
BUCKET = 3


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def hand_down(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """children with columns parents, name, weight, cap and budget (of the parent) to the same with share.

    Water filling: in order of cap over weight, a child that the level reaches gives its cap; the others
    split what is left by weight, and what the division leaves over goes to the largest remainders, one
    each.  Whole numbers throughout, products in 38 digits; the shares add up to the budget or to all caps.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    own = Window.partitionBy(*parents)
    order = own.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = children.withColumn("w_left", F.sum("weight").over(own) - F.coalesce(F.sum("weight").over(before), F.lit(0))).withColumn("b_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    full = left.withColumn("is_full", wide(F.col("cap")) * wide(F.col("w_left")) <= wide(F.col("weight")) * wide(F.col("b_left")))
    rest = full.withColumn("b_rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(own), F.lit(0))).withColumn("w_rest", F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(own))
    product = wide(F.col("b_rest")) * wide(F.col("weight"))
    rest = rest.withColumn("product", product).withColumn("part", F.expr("CAST(product div w_rest AS BIGINT)")).withColumn("remainder", F.expr("product - CAST(part AS DECIMAL(38,0)) * CAST(w_rest AS DECIMAL(38,0))"))
    rest = rest.withColumn("over", F.col("b_rest") - F.sum(F.when(~F.col("is_full"), F.col("part"))).over(own)).withColumn("nth", F.row_number().over(own.orderBy("is_full", F.desc("remainder"), name)))
    share = F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("part") + (F.col("nth") <= F.col("over")).cast("bigint"))
    return rest.withColumn("share", share).select(*children.columns, "share")


def leaf_budgets(leaves: DataFrame, per_mille: int, most_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (domain, lang, source, tokens) with share: the tokens that each leaf is to give."""
    caps = leaves.withColumn("cap", F.col("tokens") * most_epochs)
    root = caps.agg(F.sum("tokens").alias("t"), F.sum("cap").alias("c")).select(F.least(F.expr(f"(t * {per_mille}) div 1000"), "c").alias("budget"))
    budget = root.withColumn("all", F.lit(1))
    up: list[str] = ["all"]
    tree = caps.withColumn("all", F.lit(1))
    for level in LEVELS:
        nodes = tree.groupBy(*up, level).agg(F.sum("cap").alias("cap"))
        asked = nodes.join(F.broadcast(budget) if level == "domain" else budget, up).withColumn("weight", _weight(level, weights[level]))
        budget = hand_down(asked, up, level).select(*up, level, F.col("share").alias("budget"))
        up = [*up, level]
    return leaves.join(budget.drop("all").withColumnRenamed("budget", "share"), list(LEVELS))


def epochs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", per_mille: int = BUDGET_PER_MILLE, most_epochs: int = MOST_EPOCHS, seed: int = SEED, weights: dict[str, dict[str, int]] | None = None, domain: str = DOMAIN_SQL) -> DataFrame:
    """(i, h, domain, lang, source, tokens, copies) of each row: how many epochs take the document.

    domain: SQL of a source's domain, with {source} in its place.  A null language or source is the leaf
    'unknown'; a null text has no tokens; a null id is told by the text's md5.  In a partial epoch the
    documents are in order of the md5 of seed, epoch and id (ties: id, text hash), and those are taken up
    to which the tokens fit.  The running sums are exact without one task for a leaf: sums by bucket of
    the key first, and rows are only looked at in the bucket where the budget ends.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": SOURCE_WEIGHTS}
    source = F.coalesce(F.col(source_col), F.lit("unknown"))
    rows = docs.select(F.col(id_col).alias("i"), text_hash(text_col).alias("h"), F.coalesce(F.col(lang_col), F.lit("unknown")).alias("lang"), source.alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("name"))
    rows = written(rows.withColumn("domain", F.expr(domain.format(source="source"))), "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    shares = leaf_budgets(leaves, per_mille, most_epochs, weights).select(*LEVELS, F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0)).alias("whole"), F.when(F.col("tokens") > 0, F.expr("share % tokens")).otherwise(F.lit(0)).alias("part"))
    shares = written(shares, "shares")
    dealt = rows.join(shares, list(LEVELS)).withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), "name"))).withColumn("bucket", F.substring("key", 1, BUCKET))
    sums = dealt.groupBy(*LEVELS, "bucket", "part").agg(F.sum("tokens").alias("in_bucket"))
    so_far = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0))).select(*LEVELS, "bucket", "before", (F.col("before") + F.col("in_bucket")).alias("end"))
    placed = dealt.join(edges, [*LEVELS, "bucket"])
    last = (F.col("part") > 0) & (F.col("before") <= F.col("part")) & (F.col("end") > F.col("part"))
    narrow = ["i", "h", *LEVELS, "tokens"]
    clear = placed.where(~last).select(*narrow, (F.col("whole") + ((F.col("part") > 0) & (F.col("end") <= F.col("part"))).cast("int")).alias("copies"))
    within = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "i", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where(last).withColumn("run", F.col("before") + F.sum("tokens").over(within)).select(*narrow, (F.col("whole") + (F.col("run") <= F.col("part")).cast("int")).alias("copies"))
    return clear.unionByName(edge)


def mixture(docs: DataFrame, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """One row per row of docs: id, domain, lang, source, n_tokens, copies (0: not taken).  Empty docs: empty."""
    done = epochs(docs, id_col, **settings)
    return done.select(F.col("i").alias(id_col), *LEVELS, F.col("tokens").alias("n_tokens"), F.col("copies").cast("bigint").alias("copies"))


def take_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: object) -> DataFrame:
    """The rows of docs that the mixture takes, with n_epochs, the times that each is to be read."""
    taken = epochs(docs, id_col, text_col, **settings).where("copies > 0").groupBy(F.col("i").alias("__loom_i"), F.col("h").alias("__loom_hh")).agg(F.max("copies").cast("bigint").alias("__loom_copies"))
    keyed = docs.withColumn("__loom_h", text_hash(text_col))
    met = keyed.join(taken, F.col(id_col).eqNullSafe(F.col("__loom_i")) & (F.col("__loom_h") == F.col("__loom_hh")))
    return met.select(*[docs[c] for c in docs.columns if c != "n_epochs"], F.col("__loom_copies").alias("n_epochs"))


def _cases(column: str, weights: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items())} ELSE {DEFAULT_WEIGHT} END" if weights else str(DEFAULT_WEIGHT)


def _sql_level(level: str, up: list[str], before: str) -> str:
    """CTEs that hand the budgets of `before` down to one level."""
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": SOURCE_WEIGHTS}[level]
    keys, part = ", ".join(up), f"PARTITION BY {', '.join(up)}"
    return f"""
{level}_asked AS (SELECT n.*, {_cases(level, weights)} AS weight, b.budget FROM (SELECT {keys}, {level}, SUM(cap)::BIGINT AS cap FROM caps GROUP BY ALL) n JOIN {before} b USING ({keys})),
{level}_left AS (SELECT *, SUM(weight) OVER ({part}) - COALESCE(SUM(weight) OVER w, 0) AS w_left, budget - COALESCE(SUM(cap) OVER w, 0) AS b_left
  FROM {level}_asked WINDOW w AS ({part} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{level}_full AS (SELECT *, cap * w_left <= weight * b_left AS is_full FROM {level}_left),
{level}_rest AS (SELECT *, budget - COALESCE(SUM(cap) FILTER (is_full) OVER ({part}), 0) AS b_rest, SUM(weight) FILTER (NOT is_full) OVER ({part}) AS w_rest FROM {level}_full),
{level}_part AS (SELECT *, (b_rest * weight) // w_rest AS part, (b_rest * weight) % w_rest AS remainder FROM {level}_rest),
{level}_over AS (SELECT *, b_rest - SUM(part) FILTER (NOT is_full) OVER ({part}) AS over_, row_number() OVER ({part} ORDER BY is_full, remainder DESC, {level}) AS nth FROM {level}_part),
{level}_budget AS (SELECT {keys}, {level}, (CASE WHEN is_full THEN cap ELSE part + (nth <= over_)::INT END)::BIGINT AS budget FROM {level}_over)"""


def mixture_sql(table: str = "documents", columns: str = "doc_id, domain, lang, source, tokens::BIGINT AS n_tokens, copies::BIGINT AS copies", tail: str = "") -> str:
    """DuckDB SQL for mixture() with the production parameters."""
    return f"""WITH rows AS (SELECT *, {DOMAIN_SQL.format(source='source')} AS domain FROM (SELECT doc_id, COALESCE(doc_id::VARCHAR, md5(COALESCE(text, ''))) AS name, COALESCE(lang, 'unknown') AS lang, COALESCE(source, 'unknown') AS source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens FROM {table})),
leaves AS (SELECT domain, lang, source, SUM(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
caps AS (SELECT 1 AS root, *, tokens * {MOST_EPOCHS} AS cap FROM leaves),
root_budget AS (SELECT 1 AS root, LEAST(SUM(tokens) * {BUDGET_PER_MILLE} // 1000, SUM(cap))::BIGINT AS budget FROM caps),{_sql_level('domain', ['root'], 'root_budget')},{_sql_level('lang', ['root', 'domain'], 'domain_budget')},{_sql_level('source', ['root', 'domain', 'lang'], 'lang_budget')},
shares AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part FROM leaves l JOIN source_budget b USING (domain, lang, source)),
runs AS (SELECT rows.*, whole, part, SUM(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{SEED}', whole, name)), doc_id ROWS UNBOUNDED PRECEDING) AS run FROM rows JOIN shares USING (domain, lang, source)),
done AS (SELECT *, whole + CASE WHEN part > 0 AND run <= part THEN 1 ELSE 0 END AS copies FROM runs)
SELECT {columns} FROM done{tail}"""
