"""Trees and components over links between rows. Nothing is collected, no depth is cut.

Every step is written to the shared folder and read again, so that plans stay small and lost executors cost tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.sources.shared import Scratch


def descendants(links: DataFrame, roots: DataFrame) -> DataFrame:
    """id and depth of the roots (depth 0) and all below them. `links` has child and parent, `roots` has id; a cycle is walked once.

    One turn for each level; each level's fresh rows are a table of their own.
    """
    space = Scratch(links.sparkSession, "tree")
    links = space.table(links.select("child", "parent").where("child is not null and parent is not null").distinct(), "links")
    frontier = space.table(roots.select("id").distinct().withColumn("depth", F.lit(0)), "level/n=0")
    schema, depth = frontier.schema, 0
    while not frontier.isEmpty():
        depth += 1
        seen = space.read("level/*", schema)
        below = links.join(frontier.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct()
        frontier = space.table(below.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), f"level/n={depth}")
    return space.read("level/*", schema)


def ancestors(links: DataFrame, leaves: DataFrame) -> DataFrame:
    """id and depth of the leaves and all above them."""
    return descendants(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")), leaves)


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reached) over undirected edges (a, b), by minimum labels with pointer jumping."""
    space = Scratch(edges.sparkSession, "components")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = space.table(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    turn = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("to"))
        up = labels.select(F.col("id").alias("to"), F.col("component").alias("top"))
        step = space.table(hooked.join(up, "to").select("id", "old", F.least("to", "top").alias("component")), f"labels{turn}")
        labels, turn = step.select("id", "component"), turn + 1
        if step.where("old != component").isEmpty():
            return labels


def session_tree(sessions: DataFrame, session_id: str) -> DataFrame:
    roots = sessions.where(F.col("session_id") == session_id).select(F.col("session_id").alias("id"))
    return descendants(sessions.select(F.col("session_id").alias("child"), F.col("parent_session_id").alias("parent")), roots)


def without_tree(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.join(session_tree(sessions, session_id).select(F.col("id").alias("session_id")), "session_id", "left_anti")


def active_path(nodes: DataFrame, leaf: str = "is_leaf") -> DataFrame:
    """session and node of the main chain: from the marked leaf of each session up to its root.

    By doubling: tables of the pointers 1, 2, 4, ... steps up are made until none is left; from the longest to the shortest,
    each adds what it reaches from the nodes that are marked so far. A chain of n nodes takes 2 log2(n) joins on (session,
    node), whatever the number of sessions, and a cycle ends when steps are as many as the largest session has nodes.
    """
    space = Scratch(nodes.sparkSession, "path")
    chosen = nodes.where(leaf).select("session", "node").distinct()
    up = nodes.where("parent is not null").join(chosen.select("session").distinct(), "session", "left_semi").groupBy("session", "node").agg(F.min("parent").alias("up"))
    up = space.table(up, "up0")
    longest = up.groupBy("session").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps = [up]
    while 1 << len(jumps) <= longest:
        last = jumps[-1]
        further = last.select("session", "node", F.col("up").alias("via")).join(last.select("session", F.col("node").alias("via"), "up"), ["session", "via"]).select("session", "node", "up")
        further = space.table(further, f"up{len(jumps)}")
        if further.isEmpty():
            break
        jumps.append(further)
    marked = space.table(chosen, "marked")
    for k in range(len(jumps) - 1, -1, -1):
        reached = marked.join(jumps[k], ["session", "node"]).select("session", F.col("up").alias("node"))
        marked = space.table(marked.unionByName(reached).distinct(), f"marked{k}")
    return marked.join(nodes.select("session", "node").distinct(), ["session", "node"], "left_semi")
