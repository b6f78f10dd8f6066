"""Projects, runs and sessions as keyed tables: owner isolation, upserts, cancellation, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import port_base, stem
from loomgraph.operators.folds import ports

LIVE = ("queued", "running")


def owned(rows: DataFrame, owner: str) -> DataFrame:
    """Only the owner's rows; an owner that is no id gives none rather than an error."""
    return rows.where(F.col("owner_id") == F.lit(owner).try_cast(rows.schema["owner_id"].dataType))


def with_id(rows: DataFrame, column: str, asked: DataFrame, text: str) -> DataFrame:
    """asked with the rows whose id its text names; a text that is no id of the column's type finds nothing, and is no error."""
    kind = rows.schema[column].dataType
    typed = asked.withColumn("__id", F.col(text).try_cast(kind))
    return typed.join(rows, typed["__id"] == rows[column]).drop("__id")


def in_order(projects: DataFrame) -> DataFrame:
    return projects.orderBy("created_at", "id")


def sync(projects: DataFrame, heads: DataFrame) -> DataFrame:
    """projects with the heads (id, head) that were found, and whether they moved."""
    found = heads.select("id", F.col("head").alias("found"))
    moved = F.col("found").isNotNull() & ~F.col("found").eqNullSafe(F.col("head"))
    met = projects.join(found, "id", "left").withColumn("moved", moved)
    return met.withColumn("head", F.coalesce("found", "head")).drop("found")


def project_key(kind: Column) -> Column:
    """What makes a project unique within its owner: a repository, a path or an example's slug."""
    return F.when(kind == "github", F.concat_ws("/", "repo_owner", "repo_name")).when(kind == "local", F.col("root")).when(kind == "example", F.col("slug"))


def upsert_projects(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """projects with rows put in or over by owner, kind and key; the old id and creation time stay.

    Both have owner_id, kind, key, id, name, head, created_at.
    """
    by = ["owner_id", "kind", "key"]
    o, n = projects.alias("o"), rows.alias("n")
    either = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    first = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    return o.join(n, by, "full").select(*by, first("id"), either("name"), either("head"), first("created_at"))


def cancel(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """runs with those of ids (id) cancelled that still wait or run."""
    asked = ids.select("id").distinct().withColumn("asked", F.lit(True))
    hit = F.coalesce("asked", F.lit(False)) & F.col("status").isin(*LIVE)
    return runs.join(asked, "id", "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("asked")


def new_runs(requests: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(runs, tokens): queued runs hold only the hash of a token; the tokens themselves are handed out once."""
    made = requests.withColumn("token", tokens)
    runs = made.select("id", "owner_id", "graph", F.lit("queued").alias("status"), F.sha2("token", 256).alias("token_hash"))
    return runs, made.select("id", "token")


def touch(sessions: DataFrame, users: DataFrame, now: Column, keep: Column) -> DataFrame:
    """Sessions that have not expired, prolonged, with their users; the others join nothing."""
    live = sessions.where(F.col("expires_at") > now).withColumn("expires_at", keep)
    return live.join(users, live["user_id"] == users["id"]).drop(users["id"])


def upsert_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """users (sub, id, email, name, last_login) with those seen (the same) put in or over; a known one keeps its id."""
    o, n = users.alias("o"), seen.alias("n")
    later = lambda c: F.when(F.col("n.last_login").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return o.join(n, "sub", "full").select("sub", F.coalesce("o.id", "n.id").alias("id"), later("email"), later("name"), later("last_login"))


def without_expired(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def process_issue(spec: Column) -> Column:
    """The first thing wrong with a process (name, cwd, cmd, port), or null."""
    inside = lambda c: (c != "") & ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    cwd, cmd = spec["cwd"], spec["cmd"]
    return (
        F.when(bad(F.length(spec["name"]) > 0), "name")
        .when(bad((cwd == ".") | inside(cwd)), "cwd")
        .when(bad((F.size(cmd) > 0) & ~F.exists(cmd, lambda a: a.isNull())), "cmd")
        .when(spec["port"].isNotNull() & bad(spec["port"].try_cast("int").isNotNull()), "port")
    )


def first_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the first in order."""
    rest = [c for c in rows.columns if c not in key and c != order]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def flagged(rows: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a flag: whether others has the key."""
    return rows.join(others.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def merged_files(left: Column, right: Column) -> Column:
    """Two maps of path to content; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def processes(clients: DataFrame, servers: DataFrame, boundaries: DataFrame, files: DataFrame) -> DataFrame:
    """(project, name, cwd, command, install, port): what a session runs.

    First the web clients (project, id, path, dev) with a dev command, by id, then the emitted servers
    (project, path), by path; ports count up from the project's base.  A project's only server is named
    after its only api boundary (project, id), any other after its file.  files: (project, path).
    """
    home = F.regexp_replace(F.regexp_replace("path", "/+$", ""), r"^(\./+|\.$)", "")
    package = F.concat(F.when(home != "", F.concat(home, F.lit("/"))).otherwise(""), F.lit("package.json"))
    web = clients.where("dev <> ''").select("project", F.lit(0).alias("kind"), F.col("id").alias("name"), F.regexp_replace("path", "/+$", "").alias("cwd"), F.col("dev").alias("command"), package.alias("package"))
    present = files.select("project", F.col("path").alias("package"), F.lit(True).alias("install"))
    web = web.join(present, ["project", "package"], "left").select("project", "kind", F.col("name").alias("by"), "name", "cwd", "command", F.coalesce("install", F.lit(False)).alias("install"))
    one = boundaries.groupBy("project").agg(F.count(F.lit(1)).alias("apis"), F.min("id").alias("api"))
    many = servers.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    named = servers.join(many, "project").join(one, "project", "left")
    name = F.when((F.col("n") == 1) & (F.col("apis") == 1), F.col("api")).otherwise(stem(F.col("path")))
    served = named.select("project", F.lit(1).alias("kind"), F.col("path").alias("by"), name.alias("name"), F.lit(".").alias("cwd"), F.concat(F.lit("python "), "path").alias("command"), F.lit(False).alias("install"))
    return ports(web.unionByName(served), "project", port_base(F.col("project")), "kind", "by").select("project", "name", "cwd", "command", "install", "port")
