"""Graph tables: nodes (id, ...) and edges (id, kind, src, dst, ...), as joins and walks.

Walks are rounds of joins over the whole table.  What has one predecessor follows from it, so such nodes
jump to the predecessor's predecessor, then twice as far, and so on: trees, chains and rings of any length
take as many rounds as their length has binary digits.  Only where several ways meet again and again, one
behind the other, does each such meeting cost a round.  Every round cuts the lineage.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import stored as _kept


#: MB of shuffled rows that Spark may put into one task.
TASK_MB = 8


def bounded_tasks(spark: SparkSession, mb: int = TASK_MB) -> None:
    """Small partitions of a shuffle are merged up to so many MB in this session, or to less where it says so.

    Ids are compressed to a few bytes, so 64 MB, Spark's own bound, are over ten million rows for a task to sort or to
    hash; in a union of joins it comes to that early, as they share the session's parallelism.
    """
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    size = re.fullmatch(r"(\d+)([bkmgtp]?)b?", spark.conf.get(name).strip().lower())
    if size is None or int(size[1]) << 10 * "bkmgtp".index(size[2]) > mb << 20:
        spark.conf.set(name, f"{mb}m")


def _jumped(up: DataFrame) -> DataFrame:
    """up (id, to, w, c) of nodes with one predecessor, as max(c, x + w) of its x, to the same with the last
    predecessor that has none itself in up.  Nodes on a ring of such, or behind it, are left out.
    """
    now, size, reach, open_ = _kept(up), None, 1, True
    while open_:
        size = now.count() if size is None else size
        above = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"), F.col("c").alias("above"))
        met = now.join(above, "to", "left")
        far = F.col("next").isNotNull()
        now = _kept(met.select("id", F.when(far, F.col("next")).otherwise(F.col("to")).alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.greatest("c", F.col("above") + F.col("w")).alias("c"), far.alias("moved")))
        reach *= 2
        open_ = not now.where("moved").isEmpty()
        now = now.drop("moved")
        if open_ and reach > size:
            return now.join(now.select(F.col("id").alias("to")), "to", "left_anti").select("id", "to", "w", "c")
    return now


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in), zero for a node that nothing flows into."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_in"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): the longest way from a node without incoming edge; nodes on or behind a cycle are absent.

    A round takes the nodes with one open predecessor to where their ways begin, then settles the nodes
    whose predecessors are all settled.  What is settled counts in the others as a least depth c.
    """
    left = _kept(edges.select("src", "dst").distinct().withColumns({"w": F.lit(1).cast("bigint"), "c": F.lit(None).cast("bigint")}))
    done = _kept(nodes.select("id").distinct().join(left.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("depth")))
    waiting: DataFrame | None = None
    while not left.isEmpty():
        size = left.count()
        # What comes from settled nodes is a least depth; a row without src holds it where nothing else is open.
        known = left.join(done.withColumnsRenamed({"id": "src", "depth": "d"}), "src", "left")
        known = known.select(F.when(F.col("d").isNull(), F.col("src")).alias("src"), "dst", "w", F.greatest("c", F.col("d") + F.col("w")).alias("c"))
        into = known.groupBy("dst").agg(F.count_distinct("src").alias("n"), F.max("src").alias("src"), F.max(F.when(F.col("src").isNotNull(), F.col("w"))).alias("w"), F.max("c").alias("c"))
        into = _kept(into)
        fresh = into.where("n = 0").select(F.col("dst").alias("id"), F.col("c").alias("depth"))
        single = into.where("n = 1").select(F.col("dst").alias("id"), F.col("src").alias("to"), "w", "c")
        joins = _kept(known.join(into.where("n > 1").select("dst"), "dst", "left_semi").groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("c").alias("c")))
        done = _kept(done.unionByName(fresh))
        jumped = _jumped(single)
        placed = jumped.join(done.withColumnsRenamed({"id": "to", "depth": "d"}), "to", "left")
        placed = _kept(placed.select("id", "to", "w", "c", "d"))
        done = _kept(done.unionByName(placed.where("d is not null").select("id", F.greatest("c", F.col("d") + F.col("w")).alias("depth"))))
        later = placed.where("d is null").select("id", "to", "w", "c")
        waiting = later if waiting is None else waiting.unionByName(later)
        # An edge from a node that waits for another one starts at that one.
        via = later.select(F.col("id").alias("src"), "to", F.col("w").alias("more"), F.col("c").alias("least"))
        moved = joins.join(via, "src", "left")
        moved = moved.select(F.coalesce("to", "src").alias("src"), "dst", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.greatest("c", F.col("least") + F.col("w")).alias("c"))
        left = _kept(moved.groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("c").alias("c")))
        if left.count() == size and placed.isEmpty() and fresh.isEmpty() and left.join(done.select(F.col("id").alias("src")), "src", "left_semi").isEmpty():
            break  # what is left is on or behind a cycle, or behind an end that is no node
    if waiting is not None:
        rest = waiting.join(done.withColumnsRenamed({"id": "to", "depth": "d"}), "to")
        more = rest.select("id", F.greatest("c", F.col("d") + F.col("w")).alias("depth"))
        while not more.isEmpty():
            done = _kept(done.unionByName(more))
            waiting = _kept(waiting.join(done.select("id"), "id", "left_anti"))
            more = _kept(waiting.join(done.withColumnsRenamed({"id": "to", "depth": "d"}), "to").select("id", F.greatest("c", F.col("d") + F.col("w")).alias("depth")))
    return done


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth) of everything that the seeds (id) reach, the shortest way; cycles end by themselves.

    Nodes with one predecessor jump to where their ways begin; the rest is found round by round.
    """
    start = _kept(seeds.select("id", F.lit(0).cast("bigint").alias("depth")).distinct())
    open_ = _kept(edges.select("src", "dst").distinct().join(start.select(F.col("id").alias("dst")), "dst", "left_anti"))
    into = _kept(open_.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.max("src").alias("src")))
    single = into.where("n = 1").select(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(1).cast("bigint").alias("w"), F.lit(None).cast("bigint").alias("c"))
    jumped = _jumped(single).drop("c")
    via = jumped.select(F.col("id").alias("src"), "to", F.col("w").alias("more"))
    joins = open_.join(into.where("n > 1").select("dst"), "dst", "left_semi").join(via, "src", "left")
    joins = _kept(joins.groupBy(F.coalesce("to", "src").alias("src"), "dst").agg(F.min(F.coalesce("more", F.lit(0)) + 1).alias("w")))
    found, front = start, start
    while not front.isEmpty():
        come = joins.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        old = found.withColumnRenamed("depth", "known")
        front = _kept(come.join(old, "id", "left").where("known is null or depth < known").select("id", "depth"))
        found = _kept(found.join(front.select("id"), "id", "left_anti").unionByName(front))
    behind = jumped.join(found.withColumnRenamed("id", "to"), "to").select("id", (F.col("depth") + F.col("w")).alias("depth"))
    return found.unionByName(behind)


def _grown(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """start with what step adds, until it adds nothing."""
    all_, fresh = start, start
    while not fresh.isEmpty():
        fresh = _kept(step(fresh).join(all_, all_.columns, "left_anti").distinct())
        all_ = _kept(all_.unionByName(fresh))
    return all_


def _coloured(core: DataFrame) -> DataFrame:
    """(id, component) of one part of the strongly connected components: a node has the colour of the largest
    node that reaches it, and those of a colour that reach its namesake are a component."""
    colours = _kept(core.select(F.col("src").alias("id")).union(core.select("dst")).distinct().withColumn("colour", F.col("id")))
    while True:
        come = core.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("new"))
        more = _kept(colours.join(come, "id", "left").select("id", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("changed")))
        colours = more.select("id", "colour")
        if more.where("changed").isEmpty():
            break
    inside = core.join(colours.withColumnsRenamed({"id": "src", "colour": "c"}), "src").join(colours.withColumnsRenamed({"id": "dst", "colour": "d"}), "dst").where("c = d").select("src", "dst", F.col("c").alias("colour"))
    heads = _kept(colours.where("id = colour"))
    back = lambda fresh: inside.join(fresh.withColumnRenamed("id", "dst"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour")
    return _grown(heads, back).select("id", F.col("colour").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges without those at whose ends a way begins or stops."""
    return edges.join(edges.select(F.col("dst").alias("src")), "src", "left_semi").join(edges.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


def _contracted(core: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """core with one edge for each chain of nodes that have one edge in and one out: (core, members (id, first),
    chains (first, head, tail), rings (id, component)); None if there is no such node."""
    one_in = core.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.max("src").alias("before")).where("n = 1").select(F.col("dst").alias("id"), "before")
    one_out = core.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("after")).where("n = 1").select(F.col("src").alias("id"), "after")
    unary = _kept(one_in.join(one_out, "id"))
    if unary.isEmpty():
        return None
    own = unary.select(F.col("id").alias("before"), F.lit(True).alias("inner"))
    # low is the least (inner, id) of what a node has jumped over, a chain's head being the least of its chain.  A round
    # that lowers nothing ends it: nothing falls from a node to the one it points at, so all have their chain's or ring's least.
    place = F.struct(F.coalesce("inner", F.lit(False)).alias("inner"), "id")
    now = _kept(unary.join(own, "before", "left").select("id", F.when(F.col("inner"), F.col("before")).otherwise(F.col("id")).alias("first"), place.alias("low")))
    open_ = True
    while open_:
        above = now.select(F.col("id").alias("first"), F.col("first").alias("next"), F.col("low").alias("lower"))
        now = _kept(now.join(above, "first").select("id", F.col("next").alias("first"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("lowered")))
        open_ = not now.where("lowered").isEmpty()
    heads = unary.join(own, "before", "left_anti").select(F.col("id").alias("first"), F.col("before").alias("head"))
    members = now.where("not low.inner").select("id", F.col("low.id").alias("first"))
    rings = now.where("low.inner").select("id", F.col("low.id").alias("component"))
    last = unary.join(unary.select(F.col("id").alias("after")), "after", "left_anti").join(members, "id").select("first", F.col("after").alias("tail"))
    chains = _kept(heads.join(last, "first").select("first", "head", "tail"))
    rest = core.join(unary.select(F.col("id").alias("src")), "src", "left_anti").join(unary.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    short = chains.select(F.col("head").alias("src"), F.col("tail").alias("dst")).where("src <> dst")
    return _kept(rest.unionByName(short).distinct()), _kept(members), chains, _kept(rings)


#: The share of the edges that a round of trims and contractions may leave, so that another one is worth it.
STEADY = 0.8


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of components with more than one node; component is one of them.

    Edges that lead nowhere or come from nowhere go, and chains become edges, as long as that takes a good part of
    the edges a round; the rest is coloured.  Then each chain gets the component of its ends, if they have the same one.
    """
    bounded_tasks(edges.sparkSession)
    kind = edges.schema["src"].dataType.simpleString()
    core = _kept(edges.select("src", "dst").where("src <> dst").distinct())
    found = edges.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    layers: list[tuple[DataFrame, DataFrame]] = []
    while not core.isEmpty():
        size = core.count()
        core = _kept(_trimmed(_trimmed(core)))
        shorter = _contracted(core)
        if shorter is not None:
            core, members, chains, rings = shorter
            found = found.unionByName(rings)
            layers.append((members, chains))
        if core.count() <= STEADY * size:
            continue
        part = _kept(_coloured(core))
        found = found.unionByName(part)
        gone = part.select("id")
        core = _kept(core.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    found = _kept(found)
    for members, chains in reversed(layers):
        named = chains.join(found.withColumnsRenamed({"id": "head", "component": "a"}), "head", "left").join(found.withColumnsRenamed({"id": "tail", "component": "b"}), "tail", "left")
        named = _kept(named.select("first", "head", F.coalesce("a", "head").alias("component"), F.coalesce("b", "tail").alias("other")).where("component = other"))
        inner = members.join(named.select("first", "component"), "first").select("id", "component")
        ends = named.where("head = component").select(F.col("head").alias("id"), "component")
        found = _kept(found.unionByName(inner).unionByName(ends).distinct())
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return found.join(several, "component", "left_semi").select("id", "component")


def _links(rows: Iterable[tuple]) -> dict[Hashable, list]:
    after: dict[Hashable, list] = defaultdict(list)
    for src, dst in rows:
        after[src].append(dst)
    return after


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id) of the nodes that reach themselves."""
    own = edges.where("src = dst").select(F.col("src").alias("id"))
    return strong_components(edges).select("id").union(own).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """(path): for each cycle that a walk in order of ids closes, its nodes from the smallest one back to it.

    Of cycles with the same nodes one is given.  Components are walked side by side; one is a task's work,
    as a cycle is one row: its task holds the component's edges.
    """
    kind = edges.schema["src"].dataType.simpleString()
    parts = strong_components(edges)
    own = edges.where("src = dst").select("src").distinct().select(F.array("src", "src").alias("path"))
    inside = edges.select("src", "dst").where("src <> dst").distinct().join(parts.withColumnRenamed("id", "src"), "src").join(parts.withColumnsRenamed({"id": "dst", "component": "c"}), "dst").where("component = c")

    sorted_ = inside.select("component", "src", "dst").repartition("component").sortWithinPartitions("component", "src", "dst")
    return sorted_.mapInArrow(_ways_of_components, f"path array<{kind}>").unionByName(own)


def _ways_of_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in order of component, src and dst to the components' closed ways."""
    now, waiting, kind = None, [], None
    for batch in batches:
        kind = pa.list_(batch.schema.field("src").type)
        paths: list[list] = []
        for component, src, dst in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if component != now and waiting:
                paths += _closed_ways(_links(waiting))
                waiting = []
            now = component
            waiting.append((src, dst))
        yield pa.RecordBatch.from_arrays([pa.array(paths, kind)], names=["path"])
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(list(_closed_ways(_links(waiting))), kind)], names=["path"])


def _closed_ways(after: dict[Hashable, list]) -> Iterable[list]:
    seen: set[frozenset] = set()
    done: set = set()
    for root in sorted(after):
        if root in done:
            continue
        way, place, walk = [root], {root: 0}, [iter(after[root])]
        while walk:
            to = next(walk[-1], None)
            if to is None:
                walk.pop()
                last = way.pop()
                del place[last]
                done.add(last)
            elif to in place:
                ring = way[place[to] :]
                if frozenset(ring) not in seen:
                    seen.add(frozenset(ring))
                    at = ring.index(min(ring))
                    yield [*ring[at:], *ring[:at], ring[at]]
            elif to not in done:
                place[to] = len(way)
                way.append(to)
                walk.append(iter(after.get(to, ())))


def ports(nodes: DataFrame) -> DataFrame:
    """(graph_path, place, name, direction): a graph's io nodes as its ports, inputs first, else in the graph's order."""
    from pyspark.sql import Window

    own = nodes.where("type = 'io'")
    place = F.row_number().over(Window.partitionBy("graph_path").orderBy(F.col("direction") != "in", "ord")) - 1
    return own.select("graph_path", place.cast("bigint").alias("place"), F.coalesce("name", "id").alias("name"), "direction")


def faces(nodes: DataFrame, contracts: DataFrame) -> DataFrame:
    """nodes (graph_path, id) with contract and error of contracts (graph_path, id, contract, error), null where none was read."""
    return nodes.join(contracts.select("graph_path", "id", "contract", "error"), ["graph_path", "id"], "left")


def laid_out(nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """nodes (id, ord) with x and y: the layout's (id, x, y), else a diagonal by order."""
    own = layout.select("id", F.col("x").alias("own_x"), F.col("y").alias("own_y"))
    x, y = F.lit(60.0) + F.col("ord") * 200, F.lit(60.0) + F.col("ord") % 3 * 120
    met = nodes.join(own, "id", "left")
    return met.select(*nodes.columns, F.when(F.col("own_x").isNotNull(), F.col("own_x")).otherwise(x).alias("x"), F.when(F.col("own_x").isNotNull(), F.col("own_y")).otherwise(y).alias("y"))


def new_entrypoints(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, entrypoint): the step files that new flow edges (kind, src, dst) ask for at code nodes (id, type, include,
    entrypoint) without one, in the directory of the first include; a path of files is never taken."""
    ends = edges.where("kind = 'flow'").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    bare = nodes.where("type = 'code' AND entrypoint IS NULL").join(ends, "id", "left_semi")
    head = F.regexp_extract(F.get("include", F.lit(0)), r"^([^*?\[]+)[*?\[]", 1)
    home = F.when(head != "", head).otherwise(F.concat(F.lit("src/"), F.replace("id", F.lit("-"), F.lit("_"))))
    asked = bare.select("id", F.concat(F.regexp_replace(F.coalesce(home, F.concat(F.lit("src/"), F.replace("id", F.lit("-"), F.lit("_")))), "/+$", ""), F.lit("/main.py")).alias("path"))
    return asked.join(files.select("path"), "path", "left_anti").select("id", F.col("path").alias("entrypoint"))


def tools_of_agents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(agent, tools): what an agent's capability edges grant, in edge order; targets that are missing are left out."""
    own = edges.where(F.col("kind") == "capability").join(nodes.select(F.col("id").alias("dst"), "entrypoint"), "dst")
    tool = F.struct("ord", F.struct(F.col("dst").alias("node"), "entrypoint", "function").alias("tool"))
    return own.groupBy(F.col("src").alias("agent")).agg(F.transform(F.sort_array(F.collect_list(tool)), lambda x: x["tool"]).alias("tools"))


def contract_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, function): the function that the last capability edge to a node names."""
    named = edges.where((F.col("kind") == "capability") & F.col("function").isNotNull()).groupBy(F.col("dst").alias("id")).agg(F.max_by("function", "ord").alias("function"))
    return nodes.select("id").join(named, "id", "left")


def composition_edge_kind(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (id, src, dst) with the kind that their ends imply, or the reason for refusing."""
    a, b = F.col("from_type"), F.col("to_type")
    refusal = (
        F.when(a.isNull() | b.isNull(), "an end is missing")
        .when(b == "client", "clients have no callers")
        .when(b == "process", "processes have no callers")
        .when((a == "client") & (b != "boundary"), "clients call boundaries only")
        .when((a == "boundary") & (b != "service"), "boundaries call services only")
        .when(~a.isin("client", "boundary") & (b != "service"), "dependencies are services")
    )
    kind = F.when(refusal.isNotNull(), "").when(a.isin("client", "boundary"), "routes-to").otherwise("depends-on")
    return with_ends(edges, nodes).select("id", "src", "dst", "from_type", "to_type", kind.alias("kind"), refusal.alias("refusal"))


def with_ends(edges: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """edges with from_type and to_type, null for an end that is no node.  Spark broadcasts nodes if they are small."""
    ends = nodes.select("id", "type", *more)
    left = ends.select(F.col("id").alias("src"), F.col("type").alias("from_type"), *[F.col(c).alias(f"from_{c}") for c in more])
    right = ends.select(F.col("id").alias("dst"), F.col("type").alias("to_type"), *[F.col(c).alias(f"to_{c}") for c in more])
    return edges.join(left, "src", "left").join(right, "dst", "left")
