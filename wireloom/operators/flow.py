"""Who led to whom: edges between hosts, one parent each, and the paths from the client."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import drop, written


def authority(url):
    return F.coalesce(F.try_parse_url(F.lower(url), F.lit("AUTHORITY")), F.lit(""))


def flow_candidates(convs: DataFrame) -> DataFrame:
    """(capture, pass, id, parent, child, kind): from the referer's host to the host where they differ and the referer's was visited, and from the host to where it redirects.

    convs: capture, id, host, referer, redirect_to. pass: 0 for redirects, else from 1 the place of the referer's host among
    the capture's hosts as first seen. Hosts are in lower case; redirects to the same host are none.
    """
    rows = convs.select("capture", "id", F.lower("host").alias("host"), authority(F.col("referer")).alias("ref"), authority(F.col("redirect_to")).alias("to"))
    seen = rows.groupBy("capture", "host").agg(F.min("id").alias("first_id"))
    seen = seen.withColumn("pass", F.row_number().over(Window.partitionBy("capture").orderBy("first_id"))).select("capture", F.col("host").alias("ref"), "pass")
    refs = rows.where("ref <> '' and ref <> host").join(seen, ["capture", "ref"]).select("capture", F.col("pass").cast("long"), "id", F.col("ref").alias("parent"), F.col("host").alias("child"), F.lit("referer").alias("kind"))
    moved = rows.where("to <> '' and to <> host").select("capture", F.lit(0).cast("long").alias("pass"), "id", F.col("host").alias("parent"), F.col("to").alias("child"), F.lit("redirect").alias("kind"))
    return moved.unionByName(refs)


def flow_edges(candidates: DataFrame) -> DataFrame:
    """(capture, idx, parent, child, kind): the first edge into each child by (pass, id), numbered in that order. A combinable minimum, then numbers over the few edges left."""
    first = candidates.groupBy("capture", "child").agg(F.min(F.struct("pass", "id", "parent", "kind")).alias("e"))
    idx = F.row_number().over(Window.partitionBy("capture").orderBy("e.pass", "e.id", "child")).cast("long")
    return first.select("capture", idx.alias("idx"), F.col("e.parent").alias("parent"), "child", F.col("e.kind").alias("kind"))


def isolated_hosts(convs: DataFrame, edges: DataFrame) -> DataFrame:
    """(capture, host) of hosts in no edge."""
    hosts = convs.select("capture", F.lower("host").alias("host")).distinct()
    used = edges.select("capture", F.col("parent").alias("host")).unionByName(edges.select("capture", F.col("child").alias("host"))).distinct()
    return hosts.join(used, ["capture", "host"], "left_anti")


def flow_roots(edges: DataFrame) -> DataFrame:
    """Edges whose parent has not come up as a child before them: children of the client's node."""
    above = edges.select("capture", F.col("child").alias("parent"), F.col("idx").alias("above"))
    return edges.join(above, ["capture", "parent"], "left").where("above is null or above >= idx").select("capture", "idx", "parent", "child")


def flow_paths(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(capture, depth, path): paths from Client to every host; an edge hangs below its parent's own edge if that has a lower index.

    Every edge holds the part of its path that is known and the edge above that part; each round puts the part of the
    edge above before its own, so parts double and a chain of n hosts takes about log2(n) rounds. Indexes rise along a
    path, so this ends even on cycles. A round is one join of edges by (capture, index), written; the table of the round
    before goes. A host has at most one edge as a child, as flow_edges gives them; give edges that are written or cached.
    """
    above = edges.select("capture", F.col("child").alias("parent"), F.col("idx").alias("over"))
    rows = edges.join(above, ["capture", "parent"], "left").withColumn("up", F.when(F.col("over") < F.col("idx"), F.col("over")))
    head = F.when(F.col("up").isNull(), F.array(F.lit("Client"), "parent", "child")).otherwise(F.array("child"))
    rows = written(rows.select("capture", "idx", "up", head.alias("path")), "flow-paths")
    while not rows.where("up is not null").isEmpty():
        upper = rows.select("capture", F.col("idx").alias("up"), F.col("up").alias("next_up"), F.col("path").alias("before"))
        longer = F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path"))
        longer = written(rows.join(upper, ["capture", "up"], "left").select("capture", "idx", F.col("next_up").alias("up"), longer.alias("path")), "flow-paths")
        drop(rows)
        rows = longer
    top = rows.select("capture", F.get("path", F.lit(1)).alias("parent")).distinct()
    if isolated is not None:
        top = top.unionByName(isolated.select("capture", F.col("host").alias("parent"))).distinct()
    out = top.select("capture", F.lit(1).alias("depth"), F.array(F.lit("Client"), "parent").alias("path"))
    return out.unionByName(rows.select("capture", (F.size("path") - 1).alias("depth"), "path"))


def flow_size(edges: DataFrame, isolated: DataFrame) -> DataFrame:
    """(capture, size): 45 for each child of the client's node."""
    roots = flow_roots(edges).select("capture", F.col("parent").alias("host")).distinct().unionByName(isolated.select("capture", "host")).distinct()
    return roots.groupBy("capture").agg((45 * F.count(F.lit(1))).alias("size"))
