"""Header groups that differ by a character or two are one group.

Two normalized texts of a document's side are near if taking at most one character out
of each leaves the same text: a letter added, lost, exchanged or moved. What is near to
something near belongs together. Every text is keyed by all that is left of it without
one character, so near texts meet under equal keys and no pairs are tried; texts are
at most as long as a region, which bounds their keys. A key links its texts to the least
of them, which is as many links as texts, however many share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.tables import stored

GROUP = ["doc_id", "region"]


def connected(links: DataFrame) -> DataFrame:
    """(node, least): every node of the links (a, b) with the smallest node that links lead to.

    Each round takes the least of a node and its neighbours and then follows that node's
    own least, so rounds grow with the logarithm of a chain's length.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    at = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    while True:
        seen = at.select(F.col("node").alias("_node"), F.col("least").alias("_least"))
        beside = both.join(seen, F.col("b") == F.col("_node")).groupBy("a").agg(F.min("_least").alias("_beside"))
        nearer = at.join(beside, F.col("node") == F.col("a")).select("node", "least", F.least("least", "_beside").alias("_new"))
        ahead = nearer.join(seen, F.col("_new") == F.col("_node"))
        moved = stored(ahead.select("node", F.least("_new", "_least").alias("least"), F.col("least").alias("_old")), "least")
        at = moved.select("node", "least")
        if moved.filter(F.col("least") != F.col("_old")).isEmpty():
            return at


def _keys(groups: DataFrame) -> DataFrame:
    """(node, key): what is left of every text without one character, and the text itself, as 128 bits."""
    norm = F.col("norm")
    without = F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: F.concat(F.substring(norm, F.lit(1), i - 1), F.substring(norm, i + 1, F.length(norm))))
    texts = F.concat(F.array(norm), F.when(F.length(norm) > 0, without).otherwise(F.array().cast("array<string>")))
    place = [F.col(c) for c in GROUP]
    hashed = F.transform(F.array_distinct(texts), lambda t: F.struct(F.xxhash64(*place, t).alias("x"), F.xxhash64(t, *place).alias("y")))
    return groups.select("node", F.explode(hashed).alias("key")).select("node", "key.x", "key.y")


def hf_variants(groups: DataFrame) -> DataFrame:
    """Every group with the group that it is merged into: doc_id, region, variant, norm and the columns of the group.

    ``norm`` is the variant on most pages, of equal ones the first in code point order.
    """
    numbered = stored(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    keys = _keys(numbered)
    shared = keys.groupBy("x", "y").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter(F.col("n") > 1)
    shared = stored(shared.drop("n"), "shared-keys")
    links = keys.join(shared, ["x", "y"]).filter(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    parts = connected(links.distinct())
    placed = numbered.join(parts, "node", "left").withColumn("part", F.coalesce("least", "node"))
    best = placed.groupBy("part").agg(F.min(F.struct(-F.col("page_count"), "norm")).alias("best"))
    named = placed.join(best.select("part", F.col("best.norm").alias("merged")), "part")
    return named.select(*GROUP, F.col("norm").alias("variant"), F.col("merged").alias("norm"), "text", "first_page", "page_count")


def hf_similar_groups(variants: DataFrame) -> DataFrame:
    """The merged groups, in the columns of groups, with how many variants each has."""
    own = F.when(F.col("variant") == F.col("norm"), F.col("text"))
    return variants.groupBy(*GROUP, "norm").agg(
        F.max(own).alias("text"), F.min("first_page").alias("first_page"), F.sum("page_count").alias("page_count"), F.count("*").alias("n_variants")
    )
