"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step attaches every neighbour of a node to the smallest node it knows; the rounds end when the
links no longer change, as stars around the smallest node of each component. A round is a few
aggregations and joins on the node, so that a node of high degree is pre-aggregated and its join can
be split, and each round's links are a table in the shared folder. The driver sees two numbers a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.common import written

MAX_ROUNDS = 60
#: Links that one task takes: a round of so few needs no shuffle.
ONE_TASK = 200_000
#: Places of 24 bytes that may be broadcast; beyond it the join shuffles.
BROADCAST_PLACES = 500_000
#: Parts in which posts are dealt.
PARTS = 4


def meetings(posts: DataFrame, name: str) -> DataFrame:
    """posts: no, place. A table of those at places where more than one no is, with the place's lo and hi,
    the least and the greatest no there. lo and hi are summed up before they are dealt, and written before they
    are joined: a join with no aggregation in its tasks can be split, however many share a place. The places are
    dealt in PARTS, one after the other, so that little is on disk at once."""
    met = []
    for part in range(PARTS):
        some = posts.filter(F.pmod("place", F.lit(PARTS)) == part)
        hubs = written(some.groupBy("place").agg(F.min("no").alias("lo"), F.max("no").alias("hi")).filter(F.col("lo") < F.col("hi")), f"{name}-hubs")
        met.append(written(some.join(F.broadcast(hubs) if hubs.count() <= BROADCAST_PLACES else hubs, "place"), name))
    return reduce(DataFrame.unionByName, met)


def stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of every no of meetings() with its place's lo and hi: two at most a post."""
    return met.select(F.col("no").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).filter(F.col("a") != F.col("b"))


def mixed(met: DataFrame, comp: DataFrame, name: str) -> DataFrame:
    """A table of place, no and root of the posts of meetings() at places where comp, the components of the links
    found so far, leaves more than one group. What has not been compared there are the pairs of different roots:
    the caller compares them all, in a join on place alone, which can be split."""
    roots = comp.withColumnRenamed("node", "no")
    rooted = written(met.select("place", "no").join(roots, "no", "left").select("place", "no", F.coalesce("root", "no").alias("root")), f"{name}-rooted")
    many = written(rooted.groupBy("place").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter(F.col("lo") < F.col("hi")).select("place"), f"{name}-mixed")
    return written(rooted.join(many, "place", "left_semi"), f"{name}-rest")


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v. Large: every larger neighbour of a node goes to its smallest one; small: the smaller ones do."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    met = near.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("w").alias("v"))
    else:
        out = met.filter(F.col("v") != F.col("w")).select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(
            least.select("u", F.col("w").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of links with the smallest node of its component. Loops and nulls are
    left out; a table without links gives no rows."""
    now = written(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = state(now)
    for _ in range(MAX_ROUNDS):
        if not last[0]:
            break
        few = now.coalesce(1) if last[0] <= ONE_TASK else now
        now = written(_step(_step(few, True), False), "links", 2 * last[0])
        if (found := state(now)) == last:
            break
        last = found
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
