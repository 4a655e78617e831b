"""Reads of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.sources.graph import LABELS, Graph
from veriloom.sources.staging import broadcast_if, staged


def summary(g: Graph) -> DataFrame:
    """``kind, name, n``: nodes per label, edges per type, and the two totals."""
    nodes = g.nodes().groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    edges = g.edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    every = nodes.unionByName(edges)
    return every.unionByName(every.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("(all)").alias("name"), "n"))


def person_roles(g: Graph) -> DataFrame:
    """Roles of every person with the company, if any; ``place`` is by start date, missing ones first, then by id."""
    had = g.edge("HAD_ROLE").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("role_id"))
    at = g.edge("AT").select(F.col("src_key").alias("role_id"), F.col("dst_key").alias("company"))
    one = had.join(g.role, "role_id").join(at, "role_id", "left")
    w = Window.partitionBy("person_id").orderBy(F.coalesce("start_date", F.lit("0000")), "role_id", F.coalesce("company", F.lit("")))
    return one.select("person_id", "role_id", "title", "company", "start_date", F.row_number().over(w).alias("place"))


def person_projects(g: Graph) -> DataFrame:
    """Projects that each person built, by name."""
    built = g.edge("BUILT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("project_id"))
    w = Window.partitionBy("person_id").orderBy("name", "project_id")
    return built.join(g.project, "project_id").select("person_id", "project_id", "name", F.row_number().over(w).alias("place"))


def person_education(g: Graph) -> DataFrame:
    """Every person with the educations they studied at; people without any stay."""
    studied = g.edge("STUDIED_AT").select(F.col("src_key").alias("person_id"), F.col("dst_key").alias("education_id"))
    one = studied.join(g.education, "education_id").select("person_id", "education_id", "institution", "program")
    return g.person.join(one, "person_id", "left")


def ranked(df: DataFrame, key: str, by: str) -> DataFrame:
    """Rows with ``place``, their number within ``key`` in the order of ``by``, whatever share of the rows a key has.

    Rows are sorted over range partitions; a row's place is the number of its key's rows in the partitions before, plus
    its place in its own, so no task sees a key whole.
    """
    part = staged(df.repartitionByRange(key, by).select("*", F.spark_partition_id().alias("_part")), "ranked")
    sizes = part.groupBy(key, "_part").agg(F.count("*").alias("_n"))  # one row for each key and partition it reaches into
    before = sizes.select(key, "_part", (F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(by))
    return part.join(before, [key, "_part"]).select(*df.columns, (F.col("_before") + own).alias("place"))


def curriculum_projects(g: Graph) -> DataFrame:
    """``institution, name, place``: the projects of each education by name, one row each; a sink may nest them."""
    part = g.edge("PART_OF").join(g.project.select(F.col("project_id").alias("src_key"), "name"), "src_key")
    part = part.join(g.education.select(F.col("education_id").alias("dst_key"), "institution"), "dst_key")
    return ranked(part.select("institution", "name").distinct(), "institution", "name")


def nodes_of(g: Graph, label: str) -> DataFrame:
    """Nodes of one label in the order of their keys; an unknown label is an error."""
    if label not in LABELS:
        raise ValueError(f"unknown label {label!r}")
    return getattr(g, label.lower()).orderBy(LABELS[label])


def neighbours(g: Graph) -> DataFrame:
    """Every node's out- and in-edges with the other end; a loop appears on both sides."""
    e = g.edges
    out = e.select(F.col("src_label").alias("label"), F.col("src_key").alias("key"), F.lit("out").alias("direction"), "type", F.col("dst_label").alias("other_label"), F.col("dst_key").alias("other_key"))
    back = e.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"), F.lit("in").alias("direction"), "type", F.col("src_label").alias("other_label"), F.col("src_key").alias("other_key"))
    return out.unionByName(back)


def node_ref(label, key):
    """``label:key``."""
    return F.concat_ws(":", label, key)


def display_label(g: Graph) -> DataFrame:
    """``label, key, shown``: the first of title, name, display name, institution, the start of the description, the label."""
    p = F.col("props")
    return g.nodes().select("label", "key", F.coalesce(p["title"], p["name"], p["display_name"], p["institution"], F.substring(p["description"], 1, 46), F.col("label")).alias("shown"))


def standalone_projects(g: Graph) -> DataFrame:
    """Projects that are part of no education."""
    return g.project.join(g.edge("PART_OF").select(F.col("src_key").alias("project_id")), "project_id", "left_anti").select("project_id", "name")


def vocabulary(g: Graph, category: str | None = None) -> DataFrame:
    """Skills by name, of one category or all."""
    chosen = g.skill if category is None else g.skill.where(F.col("category") == category)
    return chosen.orderBy("name")


#: Parts of a node's edges of which each gives its own first neighbours.
PARTS = 64


def first_neighbours(links: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """``label, key, type, other_label, other_key``: the first ``k`` different neighbours of every node by (smallest) edge
    type, label and key. Each of a node's parts gives its first ``k`` and the node's are among these, so a task reads a
    part of a hot node and never the whole."""
    node, order = ["label", "key"], ["type", "other_label", "other_key"]
    one = links.groupBy(*node, "other_label", "other_key").agg(F.min("type").alias("type")).withColumn("part", F.pmod(F.xxhash64("other_label", "other_key"), F.lit(parts)))
    for keys in ([*node, "part"], node):
        one = one.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= k)
    return one.select(*node, *order)


def expand(g: Graph, start: DataFrame, hops: int = 1, cap: int = 10) -> DataFrame:
    """``start(label, key)`` -> ``root_label, root_key, label, key, hop``: each start node's surroundings.

    From every node of a frontier at most ``cap`` neighbours that its root hasn't seen are added, by edge type, then
    label and key. Before the last hop a root has seen 1 + cap + ... nodes at most, so no more than that many of a node's
    first neighbours, and ``cap``, can matter: only these meet the frontier, however many edges a node has. Of the graph,
    only edges at a node of the frontier are shuffled at all. The result of a hop is checkpointed, so lineage doesn't grow.
    """
    node = ["root_label", "root_key", "label", "key"]
    seen = start.select(F.col("label").alias("root_label"), F.col("key").alias("root_key"), "label", "key", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        ends = broadcast_if(front.select("label", "key").distinct(), row_bytes=100)
        links = first_neighbours(neighbours(g).join(ends, ["label", "key"], "left_semi"), cap + sum(cap**i for i in range(hops)))
        near = front.select(*node).join(links, ["label", "key"])
        fresh = near.join(seen.select("root_label", "root_key", F.col("label").alias("other_label"), F.col("key").alias("other_key")), ["root_label", "root_key", "other_label", "other_key"], "left_anti")
        w = Window.partitionBy(*node).orderBy("type", "other_label", "other_key")
        one = fresh.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
        front = one.select("root_label", "root_key", F.col("other_label").alias("label"), F.col("other_key").alias("key")).distinct().withColumn("hop", F.lit(hop))
        if hop < hops:
            front = front.checkpoint()
        seen = seen.unionByName(front)
    return seen
