"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Links contracted at once in a task; bounds its memory.
LOCAL_LINKS = 500_000


def forest(pairs) -> dict[int, int]:
    """node -> smallest node reachable by the pairs."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: root(x) for x in parent}


def _contract(batches):
    held, size = [], 0

    def stars():
        links = pd.concat(held)
        f = forest(zip(links.u.tolist(), links.v.tolist()))
        return pd.DataFrame([(a, b) for a, b in f.items() if a != b], columns=["u", "v"], dtype="int64")

    for b in batches:
        held.append(b)
        size += len(b)
        if size >= LOCAL_LINKS:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every node of ``links`` (u, v: long); label is the component's smallest id.

    Links of each task are contracted to stars first. Then large-star and small-star rounds
    run until the link table stays as it is, a logarithmic number of them. Nodes of very many
    links are handled by partial minima and by joins whose hot side Spark splits.
    An empty table gives an empty table; self links are dropped; repeated links count once.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    e = stored(e.mapInPandas(_contract, "u long, v long").distinct(), "links")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = stored(small.mapInPandas(_contract, "u long, v long").distinct(), "small")
        last, mark = mark, _mark(e)
        if mark == last:
            break
    node = e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return node.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
