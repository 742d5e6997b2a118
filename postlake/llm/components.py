"""Connected components of a table of links, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in `links` (a, b). Each round gives an id its smallest
    neighbour and goes on with links between those, so the links at least halve;
    what a round found is written to the shared folder. Its files are small for their rows,
    so nothing is broadcast by the size of them."""
    rounds: list[DataFrame] = []
    edges = links.select("a", "b").where("a <> b").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        parents = materialise(near.select(F.col("a").alias("id"), F.least("a", "b").alias("parent")), "parents")
        if parents.isEmpty():
            break
        rounds.append(parents)
        up = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        over = parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        edges = materialise(
            edges.join(up.hint("merge"), "a").join(over.hint("merge"), "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not rounds:
        return links.sparkSession.createDataFrame([], "id bigint, root bigint")
    found = rounds[-1].select("id", F.col("parent").alias("root"))
    for parents in reversed(rounds[:-1]):
        above = found.select(F.col("id").alias("parent"), "root")
        found = parents.join(above.hint("merge"), "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))
    return found
