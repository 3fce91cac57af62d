"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import saved


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node's neighbourhood."""
    both = _symmetric(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


#: Edges that one task may settle by itself.
SMALL = 100_000


def _settled(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges, in one task."""
    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField(c, kind) for c in ("node", "component")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        parent: dict = {}
        named = isinstance(kind, T.StructType)
        key = (lambda x: tuple(x.values())) if named else (lambda x: x)

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = root(key(u)), root(key(v))
                if a != c:
                    parent[max(a, c)] = min(a, c)
        rows = [(x, root(x)) for x in list(parent)]
        back = (lambda x: dict(zip(kind.names, x, strict=True))) if named else (lambda x: x)
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array([back(r[k]) for r in rows], arrow.field(k).type) for k in (0, 1)], schema=arrow)

    return edges.coalesce(1).mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", *, rounds: int = 64, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Null ends and self loops make no link. Each round is written to the shared folder. As soon as no more than small edges
    are left, which each round counts, one task settles them; small 0 leaves all to the rounds."""
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    now = saved(now, "edges")
    state = _state(now)
    for _ in range(rounds):
        if state[0] <= small:
            return saved(_settled(now), "components")
        if not state[0]:
            break
        now = saved(_small_star(_large_star(now)), "edges")
        if (after := _state(now)) == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
