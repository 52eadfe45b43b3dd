"""Approximate nearest neighbours: NN-descent graphs, greedy graph search.

Equal vectors are one node. Nodes are dealt by a hash of their vector into shards, of at most about
SHARD nodes; each has a graph of its own, made in one task. A graph starts from random-projection
blocks: in each of a few trees, nodes are ordered along random directions and cut into blocks, and the
nearest nodes within a block become neighbours. Each round then joins every node's neighbours (both
directions) with each other: a neighbour of a neighbour that is nearer replaces the farthest. Rounds go
on until next to none is replaced. Every query searches every shard: it starts at entry nodes, and at
its own node if it has one, and repeatedly expands the nearest nodes not yet expanded, until none of its
best is left; how many best these are is settled by the recall of a sample of the queries, for which
all nodes are measured.

Distances within the graphs are in single precision, from differences of scaled components; the
distances returned are in double precision. Nodes that single precision can't tell from the last
one that is kept or measured are kept and measured too. Components that all fit single precision are
scaled without loss; others are taken relative to one of the vectors.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part; ties go to the smaller id; of equal vectors, as many members
are kept per node as a result can hold; repeated rows are one; fewer candidates than asked for give shorter lists; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shard_graph
from .common import map_arrow, released, stored

SAMPLE = 2048  # entry points of searches over all shards, at most about
SHARD = 1 << 17  # nodes of a shard, at most about
PARTS = 12  # shards of a table that is large enough for them, at least
ASKED = 1 << 17  # queries that a pass over the graphs takes


def _clean(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col(column).cast("array<double>")
    sound = F.col(column).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(sound, F.lit(False)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _packed(v: pa.Array, centre: np.ndarray, scale: float) -> pa.Array:
    """Vectors of one length less the centre, scaled, in single precision, as bytes."""
    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) * scale - centre
    return pa.array([x.tobytes() for x in flat.astype(np.float32)], pa.binary())


def _unpacked(packed: pa.ChunkedArray | pa.Array) -> np.ndarray:
    held = packed.to_pylist()
    return np.frombuffer(b"".join(held), dtype=np.float32).reshape(len(held), -1)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """A task's shards, each whole and in order of its nodes."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        held.clear()
        for shard in table.column("shard").unique().sort().to_pylist():
            yield shard, table.filter(pa.compute.equal(table.column("shard"), shard)).sort_by("node").combine_chunks()


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """One partition a shard."""
    return rows.repartitionById(shards, F.col("shard"))


def index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", degree: int = 24, inward: int = 32, trees: int = 4, settled: float = 0.02, k: int = 10, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """The nodes and the neighbour graphs of all vectors.

    nodes: node (the smallest id of equal vectors), v (components), members (the first ids of the equal
    vectors, as many as lists of k can need; search takes no greater k), shard. graph: shard, shards
    (their number), node, packed (components less a centre, scaled, in single precision), near
    (neighbours in either direction, as places in the shard in order of node: `degree` own ones and at
    most `inward` others that name it). Rounds end when one replaces at most the share `settled` of all
    neighbours.
    """
    clean = _clean(vectors, key, column)
    size = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    clean = clean.where(F.size("v") == (size.n if size else 0))
    # Equal vectors meet by their hash; each task passes on k + 1 of them at most.
    first = Window.partitionBy("hash", "v").orderBy("vec_id")
    ranked = clean.withColumn("hash", F.xxhash64("v")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    alike = ranked.groupBy("hash", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    shards = max(1, -(-(size["count"] if size else 0) // SHARD), min(PARTS, (size["count"] if size else 0) // 4096))
    nodes = stored(alike.select(F.col("members")[0].alias("node"), "v", "members", F.lit(k + 1).alias("room"), F.pmod("hash", F.lit(shards)).cast("int").alias("shard")), "nodes")
    centre, scale = _scaling(nodes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("node"), _packed(b.column("v"), centre, scale)], names=["shard", "node", "packed"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in _by_shard(batches):
            near = shard_graph.descend(_unpacked(table.column("packed")), degree, inward, trees, settled, (seed, shard))
            for at in range(0, len(near), 4096):
                rows = near[at : at + 4096]
                ends = np.concatenate([[0], np.cumsum((rows >= 0).sum(axis=1))])
                part = table.slice(at, 4096).combine_chunks()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows[rows >= 0], pa.int32()))
                columns = [part.column(c).chunk(0) for c in ("shard", "node", "packed")]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(np.full(len(rows), shards), pa.int32()), *columns[1:], lists], names=["shard", "shards", "node", "packed", "near"])

    placed = map_arrow(nodes.select("shard", "node", "v"), pack, "shard int, node long, packed binary")
    graph = stored(map_arrow(_dealt(placed, shards), descend, "shard int, shards int, node long, packed binary, near array<int>"), "graph")
    released(vectors.sparkSession)
    return nodes, graph


def _scaling(nodes: DataFrame) -> tuple[np.ndarray, float]:
    """What is taken from scaled components, and the power of two that scales them to at most 1."""
    row = nodes.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"), F.bool_and(F.forall("v", lambda x: x.cast("float").cast("double") == x)).alias("single")).first()
    scale = float(np.ldexp(1.0, -int(np.clip(np.frexp(row.top or 1.0)[1], -1000, 1000))))
    if row.top is None or row.single:
        return np.zeros(1), scale
    return np.array(nodes.orderBy(F.xxhash64("node"), "node").first().v) * scale, scale


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = 200, step: int = 100, starts: int = 8, entries: int = SAMPLE, rerank: int = 64, recall: float = 0.95, probes: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each of queries (query_id, v).

    Greedy search: `entries` nodes are the bounded set of entry points, of which a query takes the
    nearest `starts` of a shard; of its best `beam` nodes up to `step` not yet expanded are expanded at a
    time, until all are. `entries`, `beam` and `step` are shared equally by the shards. For `probes` of
    the queries the nearest of all nodes are measured; `beam` is doubled until it finds the share `recall`
    of these, or holds all nodes. The best `rerank` nodes, and all that tie with the last, are measured in
    double precision. A query's own id isn't a candidate.
    """
    room = nodes.agg(F.min("room")).first()[0]
    if room is not None and k >= room:
        raise ValueError(f"the index keeps members for lists of {room - 1}, not {k}")
    one = graph.select("shards", F.length("packed").alias("bytes")).head()
    shards, width = (one.shards, one.bytes // 4) if one else (1, 0)
    centre, scale = _scaling(nodes)
    # Rounding moves a scaled vector by less than this; sums of squares are off by less than a ten-thousandth.
    blur = 0.0 if not centre.any() else 2.0**-22 * math.sqrt(width)
    share = lambda n: -(-n // shards)
    stride, starting = share(step), share(entries)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, _packed(b.column("v"), centre, scale)], names=["query_id", "v", "shard", "packed"])

    fitting = queries.where(F.size("v") == width).select("query_id", "v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    state = stored(map_arrow(fitting, enter, "query_id long, v array<double>, shard int, packed binary"), "queries", few=True)
    asked = state.select("query_id", "v")

    def collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = rows.select("query_id", "shard", "packed").toArrow()
        return table.column("query_id").to_numpy(), table.column("shard").to_numpy(), _unpacked(table.column("packed")) if table.num_rows else np.zeros((0, width), np.float32)

    def searched(asking: tuple[np.ndarray, np.ndarray, np.ndarray], run, schema: str) -> DataFrame:
        """run(ids, x, walk of a beam) of every shard; walk gives places of queries and nodes, and distances."""
        ids, home, q = asking

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, table in _by_shard(batches):
                names, x, lists = table.column("node").to_numpy(), _unpacked(table.column("packed")), table.column("near").combine_chunks()
                ends = lists.offsets.to_numpy()
                count = np.diff(ends)
                near = np.full((len(x), max(1, int(count.max()))), -1, np.int32)
                near[np.arange(near.shape[1]) < count[:, None]] = lists.values.to_numpy()[ends[0] : ends[-1]]
                mine = np.flatnonzero(home == shard)
                places = {bytes(v): at for at, v in enumerate(x)} if len(mine) else {}
                own = np.full(len(q), -1)
                own[mine] = [places.get(bytes(v), -1) for v in q[mine]]
                points = np.random.default_rng((1, shard)).permutation(len(x))[:starting]
                yield from run(names, x, lambda wide: shard_graph.walk(x, near, q, own, points, wide, stride, starts, k + 1, blur))

        return map_arrow(_dealt(graph.select("shard", "node", "packed", "near"), shards), task, schema)

    some = collected(state.orderBy(F.xxhash64(F.lit(2), "query_id"), "query_id").limit(probes))

    def probe(names: np.ndarray, x: np.ndarray, walk) -> Iterator[pa.RecordBatch]:
        """The nearest of a shard, each with the first doubling of the beam that finds it."""
        ids, _, q = some
        at, d = shard_graph.scan(x, q, k + 1)
        level, doubling = np.full(at.shape, 99), 0
        while (level == 99).any():
            wide = share(beam << doubling)
            got = walk(wide)
            hit = np.isin(np.arange(len(q))[:, None] * len(x) + at, got[0] * len(x) + got[1])
            level[hit & (level == 99)] = doubling
            if wide >= len(x):
                level[level == 99] = doubling
            doubling += 1
        flat = [pa.array(np.repeat(ids, at.shape[1]), pa.int64()), pa.array(names[at].ravel(), pa.int64()), pa.array(d.ravel(), pa.float32()), pa.array(level.ravel(), pa.int32())]
        yield pa.RecordBatch.from_arrays(flat, names=["query_id", "node", "d", "level"])

    def walked(names: np.ndarray, ids: np.ndarray, got: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        rows, at, d = got
        order = np.argsort(rows, kind="stable")
        rows, at, d = rows[order], at[order], d[order]
        own, start = np.unique(rows, return_index=True)
        ends = pa.array(np.append(start, len(rows)), pa.int32())
        pool = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(d, pa.float32()), pa.array(names[at], pa.int64())], names=["d", "node"]))
        batch = pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pool], names=["query_id", "pool"])
        for k0 in range(0, batch.num_rows, 4096):
            yield batch.slice(k0, 4096)

    def first(pool: Column, n: int) -> Column:
        """The n nearest of a pool in order, and those that rounding may have put behind the last."""
        last = F.sqrt(F.try_element_at(pool, F.lit(n))["d"].cast("double")) * 1.0001 + blur
        return F.filter(pool, lambda e: F.coalesce(F.sqrt(e["d"].cast("double")) <= last, F.lit(True)))

    order = Window.partitionBy("query_id").orderBy("d", "node")
    tried = searched(some, probe, "query_id long, node long, d float, level int").where("node <> query_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    levels = sorted(r.level for r in tried.select("level").collect()) if len(some[0]) else []
    wide = share(beam << (levels[max(0, math.ceil(recall * len(levels)) - 1)] if levels else 0))

    parts = max(1, -(-state.count() // ASKED))
    pools = []
    for part in range(parts):
        asking = collected(state.where(F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(parts)) == part))
        ids = asking[0]
        pools.append(searched(asking, lambda names, x, walk, ids=ids: walked(names, ids, walk(wide)), "query_id long, pool array<struct<d:float,node:long>>"))
        if parts > 1:
            pools[-1] = stored(pools[-1], "pools")
            released(nodes.sparkSession)
    whole = pools[0]
    for more in pools[1:]:
        whole = whole.union(more)
    merged = whole.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("pool"))).alias("pool"))
    best = merged.select("query_id", F.explode(first(F.col("pool"), rerank)).alias("e")).select("query_id", F.col("e.node").alias("node"))
    pairs = best.join(nodes.select("node", F.col("v").alias("w"), "members"), "node").join(asked, "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("members"), pa.array(np.sqrt(((x * scale - y * scale) ** 2).sum(axis=1)) / scale, pa.float64())], names=["query_id", "members", "score"])

    measured = map_arrow(pairs.select("query_id", "v", "w", "members"), exact, "query_id long, members array<long>, score double")
    each = measured.select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def own_queries(vectors: DataFrame, every: int = 100, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, v: the stated query set, rows whose id is divisible by `every`, each id once."""
    clean = _clean(vectors, key, column)
    return clean.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
