"""Identity stitching over chains of links: connected components of anonymous ids and users."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import not_blank

#: Users beyond which an anonymous id is a device that many share.
SHARED_BEYOND = 3
NODE = ["workspace_id", "node"]


def links(events: DataFrame, folder: str) -> DataFrame:
    """workspace_id, anonymous_id, user_id, n_users and least_user of each pair that was seen together; blank ids link nothing.

    Events are read once: the distinct pairs are a table in `folder`, which all machines share, and so are the links.
    """
    spark, root, pair = events.sparkSession, f"{folder.rstrip('/')}/links-{uuid.uuid4().hex}", ["workspace_id", "anonymous_id", "user_id"]
    seen = events.where(not_blank("user_id") & not_blank("anonymous_id")).select(*[F.col(c).cast("string").alias(c) for c in pair]).distinct()
    seen.write.parquet(f"{root}/pairs")
    seen = spark.read.schema(", ".join(f"{c} string" for c in pair)).parquet(f"{root}/pairs")
    users = seen.groupBy("workspace_id", "anonymous_id").agg(F.count("*").alias("n_users"), F.min("user_id").alias("least_user"))
    seen.join(users, ["workspace_id", "anonymous_id"]).write.parquet(f"{root}/links")
    return spark.read.schema("workspace_id string, anonymous_id string, user_id string, n_users long, least_user string").parquet(f"{root}/links")


def user_roots(own: DataFrame, folder: str) -> DataFrame:
    """workspace_id, user_id and _root, the least user of the person, of users whom links connect with others; others are their own.

    Anonymous ids are no nodes: each joins its users to the least of them, and is of the person of that one. So the turns
    of the components carry users that were seen with another one, and not all pairs.
    """
    edges = own.where("user_id <> least_user").select("workspace_id", F.col("user_id").alias("node"), F.col("least_user").alias("other"))
    return components(edges, folder).select("workspace_id", F.col("node").alias("user_id"), F.col("root").alias("_root"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("workspace_id", F.col("other").alias("node"), F.col("node").alias("other")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = _both(edges)
    least = both.groupBy(*NODE).agg(F.min("other").alias("_m")).select(*NODE, F.least("_m", "node").alias("_m"))
    return both.where("other > node").join(least, NODE).select("workspace_id", F.col("other").alias("node"), F.col("_m").alias("other")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select("workspace_id", F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).where("node <> other")
    least = down.groupBy(*NODE).agg(F.min("other").alias("_m"))
    rows = down.join(least, NODE).select("workspace_id", F.col("other").alias("node"), F.col("_m").alias("other")).where("node <> other")
    return rows.unionByName(least.select(*NODE, F.col("_m").alias("other"))).distinct()


def components(edges: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """workspace_id, node, root: the least node that each node is connected with, over edges (workspace_id, node, other).

    Large and small stars in turn (Kiveris et al., 2014), until nothing changes: about the square of the logarithm of a
    component's size in turns, usually far fewer. Each turn is written to `folder`, which all machines share: a table
    cuts the lineage and outlives a lost executor. Nodes are not gathered: each star is a sum that is combined before the
    shuffle, and a join with one row a node on one side. Null nodes link nothing.
    """
    spark, root = edges.sparkSession, f"{folder.rstrip('/')}/stars-{uuid.uuid4().hex}"
    schema, before = "workspace_id string, node string, other string", None
    rows = edges.select("workspace_id", "node", "other").dropna(subset=["node", "other"]).where("node <> other").distinct()
    for turn in range(most):
        path = f"{root}/{turn}"
        (rows if turn == 0 else _small_star(_large_star(rows))).write.parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        now = tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("workspace_id", "node", "other").cast("decimal(38,0)"))).first())
        if turn and now == before:
            roots = rows.select(*NODE, F.col("other").alias("root"))
            return roots.unionByName(rows.select("workspace_id", F.col("other").alias("node"), F.col("other").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most} turns")


def stitch_chains(events: DataFrame, folder: str, shared_beyond: int = SHARED_BEYOND) -> DataFrame:
    """Adds person_id and identity to events (workspace_id, anonymous_id, user_id): who, and by which rule.

    An anonymous id and a user seen together are one person, and so is all that a chain of such links connects, within a
    workspace. The person is named by the least user (u:). identity is "linked" then.

    An anonymous id with more than `shared_beyond` users is a shared device: it links nobody. Its events belong to the
    user that they name ("shared_named"), others to the device itself (a:, "shared"). An anonymous id that was never seen
    with a user is a person of its own (a:, "anonymous"). An event without an anonymous id belongs to the person of its
    user ("linked"), and to nobody where it has neither (null, "unknown").
    """
    found = links(events, folder)
    shared = F.col("n_users") > shared_beyond
    roots = user_roots(found.where(~shared), folder)
    least = found.where("user_id = least_user").join(roots, ["workspace_id", "user_id"], "left")  # a row an anonymous id
    of_visitor = least.select("workspace_id", "anonymous_id", shared.alias("_shared"), F.when(~shared, F.concat(F.lit("u:"), F.coalesce("_root", "least_user"))).alias("_by_visitor"))
    of_user = roots.select("workspace_id", "user_id", F.concat(F.lit("u:"), "_root").alias("_by_user"))
    rows = events.join(of_visitor, ["workspace_id", "anonymous_id"], "left").join(of_user, ["workspace_id", "user_id"], "left")
    named, seen = F.coalesce(not_blank("user_id"), F.lit(False)), F.coalesce(not_blank("anonymous_id"), F.lit(False))
    by_user = F.coalesce("_by_user", F.concat(F.lit("u:"), "user_id"))  # a user that no anonymous id connects with another one
    kind = (
        F.when(F.col("_shared") & named, "shared_named").when(F.col("_shared"), "shared").when(F.col("_by_visitor").isNotNull() | (named & ~seen), "linked").when(seen, "anonymous").otherwise("unknown")
    )
    own = F.concat(F.lit("a:"), "anonymous_id")
    who = F.when(kind == "shared_named", by_user).when(kind.isin("shared", "anonymous"), own).when(kind == "linked", F.coalesce("_by_visitor", by_user))
    return rows.withColumns({"person_id": who, "identity": kind}).select(*events.columns, "person_id", "identity")
