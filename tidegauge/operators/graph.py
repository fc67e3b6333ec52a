"""Typed graphs of nodes and edge-entities: ownership, neighbours, reachability."""

from pyspark.sql import Window, functions as F

from tidegauge.session import materialize

# Edges are rows ``edge, source, target, relation``; an edge is an entity too.


def bind_features(features, bindings):
    """Owner of every declared feature, with its slot inside the owner.

    Feature lists are declared, so a window over an entity's features is small.
    """
    w = Window.partitionBy("entity").orderBy("feature")
    return features.join(bindings, "feature").withColumn("slot", F.row_number().over(w) - 1)


def binding_violations(features, bindings):
    """Unbound and unexpected features, and features with more than one owner."""
    unbound = features.select("feature").join(bindings, "feature", "left_anti")
    extra = bindings.select("feature").join(features, "feature", "left_anti")
    shared = bindings.groupBy("feature").agg(F.count_distinct("entity").alias("n")).where("n > 1")
    tag = lambda df, why: df.select("feature", F.lit(why).alias("problem"))
    return tag(unbound, "unbound").unionByName(tag(extra, "unexpected")).unionByName(
        tag(shared, "shared")
    )


def neighbours(edges):
    """One hop both ways: node - edge and edge - node."""
    pair = lambda a, b: edges.select(F.col(a).alias("entity"), F.col(b).alias("neighbour"))
    return (
        pair("source", "edge").unionByName(pair("target", "edge"))
        .unionByName(pair("edge", "source")).unionByName(pair("edge", "target")).distinct()
    )


def incoming_sources(edges, nodes):
    """Inputs of each entity: an edge's source, a node's incoming edges, always itself."""
    pair = lambda a, b: edges.select(F.col(a).alias("entity"), F.col(b).alias("source_entity"))
    itself = nodes.select("entity", F.col("entity").alias("source_entity")).unionByName(
        pair("edge", "edge")
    )
    return pair("edge", "source").unionByName(pair("target", "edge")).unionByName(itself).distinct()


def reachable(edges):
    """All (source, target) pairs joined by a directed path, cycles included.

    Each round joins the found pairs with themselves, so path length doubles and
    rounds grow with the logarithm of the diameter. Every round is written, which
    keeps the plan short and a lost executor cheap.
    """
    found = materialize(edges.select("source", "target").distinct())
    size = found.count()
    while True:
        hop = found.select(F.col("source").alias("target"), F.col("target").alias("_far"))
        longer = found.join(hop, "target").select("source", F.col("_far").alias("target"))
        found = materialize(found.unionByName(longer).distinct())
        grown = found.count()
        if grown == size:
            return found
        size = grown


def resolve_entity(events, by_service_event, by_event, by_service):
    """Entity of an event: (service, event), then event, then service; else NULL.

    Override tables are declared lists; ``event:`` prefixes are aliases.
    """
    name = F.regexp_replace("event", "^event:", "")
    rows = events.withColumn("event", name)
    rows = rows.join(F.broadcast(by_service_event.withColumnRenamed("entity", "_a")), ["service", "event"], "left")
    rows = rows.join(F.broadcast(by_event.withColumnRenamed("entity", "_b")), "event", "left")
    rows = rows.join(F.broadcast(by_service.withColumnRenamed("entity", "_c")), "service", "left")
    return rows.withColumn("entity", F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")
