"""Near duplicates among embeddings: a graph index for each shard, audited beams, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, scratch_path
from .components import components
from .hnsw import BEAM_BYTES, CELLS, Hnsw
from .text import give_back, released, short_batches

SHARDS = 8
SHARD_ROWS = 250_000  # more vectors get more shards
QUERIES = 100_000  # of one search task, on average; as many bytes as an index has, or some more
SHARD_BYTES = 160 << 20  # that a task holds to build a shard's graph; wide vectors get more shards
PIECE = 1 << 16  # bytes of one value: of a graph, or nodes with their vectors
SPREAD = 2000  # partitions that fewer search tasks are dealt to, four for each at most
BYTES = 4 << 20  # that go to a Python worker at once
GROUP_BYTES = 8 << 20  # of pieces that are read from a written table at once
BEAM, WIDEST = 48, 1024
AUDIT = 1024  # queries that are compared with all nodes of all shards, on average
RECALL = 0.98  # of the links of the audited queries with other nodes
LINKS = 100  # with fewer links among the audited queries, their nearest other nodes are judged in place of links
NEAREST, NEAR_RECALL = 3, 0.9
ENLARGED = 8  # times the audited queries at most, to reach enough links
AUDIT_CELLS = 2 << 20  # cosines that are judged at once
BLOCK = 512  # members of a ball that are compared at once
EDGE = 1e-9  # angles are summed with this margin


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for (x, y) and (y, x)."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(data):
        return np.zeros((0, 1))
    return np.asarray(data.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(data), -1)


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as they are, in single or double precision."""
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return data.flatten().to_numpy(zero_copy_only=False).reshape(len(data), -1)


def units(v: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    out = np.empty(v.shape, dtype=np.float32)
    for i in range(0, len(v), BLOCK):
        out[i:i + BLOCK] = unit(v[i:i + BLOCK].astype(np.float64))
    return out


def pair_cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the rows ``i`` of ``x`` with the rows ``j`` of ``y``, some at a time."""
    out, step = np.empty(len(i)), max(1, (1 << 20) // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        out[k:k + step] = cosines(x[i[k:k + step]].astype(np.float64), y[j[k:k + step]].astype(np.float64))
    return out


def _nodes(n: int, dim: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, radii and vectors of a value with ``n`` nodes."""
    kind = np.float32 if len(data) == n * (16 + 4 * dim) else np.float64
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, n, 8 * n), np.frombuffer(data, kind, n * dim, 16 * n).reshape(n, dim)


class Shard:
    """A shard's graph and nodes, of values (kind, place, number of nodes, bytes): pieces of the graph (0), and nodes (1)."""

    def __init__(self, dim: int, values: Iterable[tuple[int, int, int, bytes]]) -> None:
        values = sorted(values, key=lambda x: x[:2])
        blocks = [_nodes(n, dim, data) for kind, _, n, data in values if kind]
        self.ids, self.radius, self.exact = (np.concatenate(x) for x in zip(*blocks))
        del blocks
        graph = b"".join(data for kind, _, _, data in values if not kind)
        values.clear()
        self.graph, _ = Hnsw.load(graph, units(self.exact))


BUILT = "dim int, shard int, row bigint, leader bigint, angle double, kind int, place int, n int, data binary"


def _built(dim: int, shard: int, size: int, /, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "leader": pa.int64(), "angle": pa.float64(), "kind": pa.int32(), "place": pa.int32(), "n": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_pydict({"dim": pa.array([dim] * size, pa.int32()), "shard": pa.array([shard] * size, pa.int32()),
                                       **{c: columns.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()}})


def _build(absorb: float):
    """A row for each vector, with its leader; then values of the graph (see ``Shard``)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(np.array(batch.column("row")))
                parts.append(_flat(batch.column("v")).copy())
                dim, shard = batch.column("dim")[0].as_py(), batch.column("shard")[0].as_py()
                del batch
        if not ids:
            return
        rows, v = np.concatenate(ids), np.concatenate(parts)
        parts.clear()
        order = np.argsort(rows)
        rows, v = rows[order], v[order]
        graph = Hnsw(units(v), absorb)
        cos = pair_cosines(v, np.arange(len(v)), v, graph.leader)
        cos[graph.leader == np.arange(len(v))] = 1.0
        angle, radius = np.arccos(np.clip(cos, -1, 1)), np.zeros(len(v))
        np.maximum.at(radius, graph.leader, angle)
        for i in range(0, len(rows), 10_000):
            own = slice(i, i + 10_000)
            yield _built(dim, shard, len(rows[own]), row=pa.array(rows[own]), leader=pa.array(rows[graph.leader[own]]), angle=pa.array(angle[own]))
        data = graph.save(vectors=False)
        for place, i in enumerate(range(0, len(data), PIECE)):
            yield _built(dim, shard, 1, **_value(0, place, 0, data[i:i + PIECE]))
        step = max(1, PIECE // (16 + v.itemsize * dim))
        for place, i in enumerate(range(0, graph.size, step)):
            own = graph.node[i:i + step]
            yield _built(dim, shard, 1, **_value(1, place, len(own), rows[own].tobytes() + radius[own].tobytes() + v[own].tobytes()))
    return build


def _written(df: DataFrame) -> DataFrame:
    """Like ``materialise``; a reader that takes thousands of rows at once takes a row group at most."""
    path = scratch_path(df.sparkSession, "step")
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _value(kind: int, place: int, n: int, data: bytes) -> dict[str, pa.Array]:
    return {"kind": pa.array([kind], pa.int32()), "place": pa.array([place], pa.int32()), "n": pa.array([n], pa.int32()), "data": pa.array([data], pa.binary())}


def _reach(graph: Hnsw, q: np.ndarray, far: np.ndarray, beam: int, best: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries and nodes with cosines of ``far`` or more, some queries at a time; ``best`` gets each query's best of the first beam.
    A beam that ends among what counts is widened; 0 reads all nodes, in blocks."""
    if not beam:
        step = max(1, min(256, CELLS // graph.size))
        for i in range(0, len(q), step):
            a, c = np.nonzero(q[i:i + step] @ graph.v.T >= far[i:i + step][:, None])
            yield a + i, c
        return
    todo, b = np.arange(len(q)), beam
    while len(todo):
        b, full = min(b, graph.size), []
        step = max(8, CELLS // (BEAM_BYTES * b))
        for i in range(0, len(todo), step):
            part = todo[i:i + step]
            found, sims = graph.search(q[part], b)
            if best is not None:
                best[part, :b] = found[:, :best.shape[1]]
            more = (sims[:, -1] >= far[part]) & (b < graph.size)  # the beam ended among what counts
            hit = (sims >= far[part][:, None]) & (found >= 0) & ~more[:, None]
            yield np.broadcast_to(part[:, None], hit.shape)[hit], found[hit]
            full.append(part[more])
        todo, b, best = np.concatenate(full), b * 4, None


def _audit(limit: float, beam: int):
    """Links of the audited queries with a shard's other nodes, and their nearest other nodes; how many of both the beam finds."""
    def audit(index: pa.Table, queries: pa.Table) -> pa.Table:
        tally = np.zeros(4, dtype=np.int64)
        if index.num_rows and queries.num_rows:
            shard = Shard(index.column("dim")[0].as_py(), zip(*[index.column(c).to_pylist() for c in ("kind", "place", "n", "data")]))
            del index
            graph, ids, radius = shard.graph, shard.ids, shard.radius
            q_ids, r = queries.column("leader").to_numpy(), queries.column("radius").to_numpy()
            every = units(_flat(queries.column("v")))
            k, step = min(NEAREST, graph.size), max(1, AUDIT_CELLS // graph.size)
            for i in range(0, len(every), 128):
                q, own, rad = every[i:i + 128], q_ids[i:i + 128], r[i:i + 128]
                top = np.full((len(q), NEAREST + 1), -1, dtype=np.int64)
                reached = list(_reach(graph, q, np.cos(np.minimum(limit + rad + radius.max() + 1e-6, math.pi)), beam, top))
                line, node = (np.concatenate(x) for x in zip(*reached))
                for j in range(0, len(q), step):
                    at = slice(j, j + step)
                    sims = q[at] @ graph.v.T
                    sims[own[at][:, None] == ids] = -2.0
                    links = (sims >= np.cos(np.minimum(limit + rad[at][:, None] + radius, math.pi))) & (sims > -2.0)
                    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    real = np.take_along_axis(sims, near, axis=1) > -2.0
                    got, here = np.zeros(links.shape, dtype=bool), (line >= j) & (line < j + step)
                    got[line[here] - j, node[here]] = True
                    tally += (links.sum(), (links & got).sum(), real.sum(),
                              ((near[:, :, None] == top[at][:, None, :]).any(axis=2) & real).sum())
            del shard, graph
        give_back()
        return pa.table([pa.array([x], pa.int64()) for x in tally.tolist()], names=["links", "found", "near", "near_found"])
    return audit


def suffices(links: int, found: int, near: int, near_found: int) -> bool:
    """Whether the audit over all tasks shows enough recall."""
    if links >= LINKS:
        return found >= RECALL * links
    return found == links and near_found >= NEAR_RECALL * near


def fitting_beam(whole: DataFrame, sample: Callable[[int], DataFrame], limit: float, beam: int) -> int:
    """The narrowest beam, of ``beam`` and each half as wide again, that suffices for the audited queries; 0 if none does.
    ``sample``: queries, so many times the usual number.  One that fails with too few links to judge by is enlarged once."""
    some, enlarged = materialise(sample(1)), False
    while 0 < beam <= WIDEST:
        tally = whole.groupBy("dim", "shard").cogroup(some.groupBy("dim", "shard")).applyInArrow(
            _audit(limit, beam), "links bigint, found bigint, near bigint, near_found bigint")
        links, *found = tally.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in tally.columns]).first()
        if suffices(links, *found):
            return beam
        if links < LINKS and not enlarged:
            some, enlarged = materialise(sample(min(ENLARGED, -(-2 * LINKS // max(links, 1))))), True
        else:
            beam += max(1, beam // 2)
    return 0


def _search(limit: float, beam: int):
    """Pairs of balls that can hold a link: angle of the leaders at most ``limit`` plus both radii.
    Rows of a shard (kinds 0 and 1) come first, then nodes of all shards that look for theirs in it (2), which a task holds some at a time."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, shard = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, blocks = batch.column("dim")[0].as_py(), []
            for kind, place, n, data in zip(*[batch.column(c).to_pylist() for c in ("kind", "place", "n", "data")]):
                if kind < 2:
                    if shard is not None:
                        raise RuntimeError("rows of the shard came after its queries")
                    values.append((kind, place, n, data))
                else:
                    blocks.append(_nodes(n, dim, data))
            if not blocks or shard is None and not values:  # no vector of this length in the shard
                continue
            if shard is None:
                shard = Shard(dim, values)
                values.clear()
            q_ids, r, q = (np.concatenate(x) for x in zip(*blocks))
            far = np.cos(np.minimum(limit + r + shard.radius.max() + 1e-6, math.pi))  # below this cosine nothing counts
            for line, node in _reach(shard.graph, units(q), far, beam):
                other = q_ids[line] != shard.ids[node]
                line, node = line[other], node[other]
                cos = pair_cosines(q, line, shard.exact, node)
                near = np.arccos(np.clip(cos, -1, 1)) <= limit + r[line] + shard.radius[node] + EDGE
                a, b = q_ids[line[near]], shard.ids[node[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cos[near])], names=["a", "b", "cos"])
    return search


def _count(least: float):
    """Links between the members of two blocks."""
    def count(rows: pa.Table) -> pa.Table:
        out_row, out_n, a_out, b_out = [], [], [], []
        for r in rows.to_pylist():
            x, y = (np.frombuffer(r[k], dtype=np.float64).reshape(-1, r["dim"]) for k in ("vx", "vy"))
            norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))
            dots = np.stack([(x * z).sum(axis=1) for z in y], axis=1)
            hit = dots / norm >= least
            for ids, n in ((r["ix"], hit.sum(axis=1)), (r["iy"], hit.sum(axis=0))):
                out_row += np.frombuffer(ids, dtype=np.int64)[n > 0].tolist()
                out_n += n[n > 0].tolist()
            a_out += [r["a"]] * (len(out_row) - len(a_out))
            b_out += [r["b"]] * (len(out_row) - len(b_out))
        return pa.table({"row": pa.array(out_row, pa.int64()), "n": pa.array(out_n, pa.int64()),
                         "a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})
    return count


def _pack(rows: pa.Table) -> pa.Table:
    v = _matrix(rows.column("v"))
    return pa.table({"leader": rows.column("leader").slice(0, 1), "block": rows.column("block").slice(0, 1),
                     "dim": pa.array([v.shape[1]], pa.int32()), "ids": pa.array([rows.column("row").to_numpy().tobytes()], pa.binary()),
                     "vs": pa.array([v.tobytes()], pa.binary())})


def near_duplicate_components(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding",
                              shards: int = SHARDS, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """Components of vectors linked by a cosine of at least ``least`` (over 0, below 1).

    One row per input row: the key, ``n_links`` (other rows linked directly), ``component_id`` (smallest key
    reachable, its own included), ``kept`` (key = component_id).  Vectors that are null, empty or zero, or hold a null, NaN
    or infinity, link with nothing; so do vectors of different lengths with each other.  Null keys are never the smallest.
    Rows that repeat a key are rows of their own.  Other columns are not read.

    Rows are dealt to shards by hash.  A shard's graph takes as nodes the vectors that are not within a quarter
    of the linking angle (and a little less) of a node; these join the node's ball, whose members are thus all linked.  So
    thousands of near copies are one node for each shard.  Every node is searched in every shard; beams widen until they reach past
    what can be linked.  Before, a sample of the nodes is compared with all nodes of all shards: the narrowest beam that finds
    ``RECALL`` of their links with other nodes, over all tasks together, serves the search.  A sample with fewer than ``LINKS`` links
    is judged by its nearest other nodes, too, and enlarged before beams widen for it; where no beam suffices, the search reads all nodes.  Balls that lie wholly
    within the angle count by their sizes; balls at its edge are compared member by member, in blocks.  Vectors may
    have any length: shards have so few rows that a task that builds a graph holds ``SHARD_BYTES`` or less.  Graphs and vectors move in
    values of ``PIECE`` bytes, and a search task holds one graph and the queries of a batch.
    """
    limit = math.acos(least)
    absorb = math.cos(limit / 2 - 1e-3)  # two members are at most twice this angle apart
    own = vectors.select(F.col(vector)).schema[0].dataType
    kind = "float" if isinstance(own, T.ArrayType) and isinstance(own.elementType, T.FloatType) else "double"
    width = 4 if kind == "float" else 8
    inf = F.lit(float("inf")).cast(kind)
    fit = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(F.col("v"), lambda x: x != 0)
    base = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"),
                                      F.col(vector).cast(f"array<{kind}>").alias("v"))
                       .withColumn("ok", F.coalesce(fit, F.lit(False))))
    good = base.filter("ok")
    size = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // ((width + 8) * size["dim"] + 300)))
    shards = max(shards, -(-size["n"] // shard_rows))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    spark = vectors.sparkSession
    with short_batches(spark, max(1, BYTES // max(1, width * size["dim"]))):
        built = _written(good.select("row", "v", F.size("v").alias("dim"), shard).repartition(4 * shards, "dim", "shard")
                         .groupBy("dim", "shard").applyInArrow(released(_build(absorb)), BUILT))
    members = built.filter("data is null").select("row", "leader", "angle", "dim")
    balls = materialise(members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius"),
                                                      F.max("dim").alias("dim")))
    nodes = balls.count()
    groups = max(1, -(-nodes // QUERIES))
    whole = built.filter("data is not null").select("dim", "shard", "kind", "place", "n", "data")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")

    def sample(times: int) -> DataFrame:
        own = F.pmod(F.xxhash64(F.lit("audit"), "leader"), F.lit(max(1, nodes // (AUDIT * times)))) == 0
        return balls.filter(own).join(good.select(F.col("row").alias("leader"), "v"), "leader").select("dim", "leader", "radius", "v", every)
    turn = F.pmod(F.xxhash64("shard", "place"), F.lit(groups)).cast("int").alias("turn")
    turns = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("turn")
    keys, rest = ["dim", "shard", "turn"], ["kind", "place", "n", "data"]
    moved = whole.select("dim", "shard", turns, *rest).unionByName(
        whole.filter("kind = 1").withColumn("kind", F.lit(2)).select("dim", turn, every, *rest))
    tasks = shards * groups
    with short_batches(spark, max(1, BYTES // max(PIECE, 16 + width * size["dim"]))):
        beam = fitting_beam(whole, sample, limit, beam)
        pairs = materialise(moved.repartition(max(tasks, min(4 * tasks, SPREAD)), *keys).sortWithinPartitions(*keys, "kind").groupBy(*keys).applyInArrow(
            released(_search(limit, beam)), "a bigint, b bigint, cos double").groupBy("a", "b").agg(F.max("cos").alias("cos")))
    side = [balls.select(F.col("leader").alias(c), F.col("size").alias(f"size_{c}"), F.col("radius").alias(f"radius_{c}")) for c in "ab"]
    angle, reach = F.acos(F.least(F.col("cos"), F.lit(1.0))), F.col("radius_a") + F.col("radius_b")
    single = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    judged = materialise(pairs.join(side[0], "a").join(side[1], "b").select(
        "a", "b", "size_a", "size_b", F.when(single, F.when(F.col("cos") >= F.lit(least), "all").otherwise("none"))
        .when(angle + reach <= F.lit(limit - EDGE), "all").otherwise("some").alias("links")))
    inside = judged.filter("links = 'all'")
    block = F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / F.lit(BLOCK))).cast("int").alias("block")
    edge = judged.filter("links = 'some'")
    rim = edge.select(F.col("a").alias("leader")).union(edge.select("b")).distinct()
    packed = materialise(members.join(rim, "leader", "left_semi").join(balls.select("leader", "size"), "leader")
                         .join(good.select("row", "v"), "row").select("leader", block, "row", "v")
                         .groupBy("leader", "block").applyInArrow(_pack, "leader bigint, block int, dim int, ids binary, vs binary"))
    x = packed.select(F.col("leader").alias("a"), F.col("block").alias("ba"), "dim", F.col("ids").alias("ix"), F.col("vs").alias("vx"))
    y = packed.select(F.col("leader").alias("b"), F.col("block").alias("bb"), F.col("ids").alias("iy"), F.col("vs").alias("vy"))
    found = materialise(edge.select("a", "b").join(x, "a").join(y, "b").groupBy("a", "ba", "b", "bb").applyInArrow(
        _count(least), "row bigint, n bigint, a bigint, b bigint"))
    root = components(inside.select("a", "b").union(found.select("a", "b").distinct()))
    more = materialise(inside.select(F.col("a").alias("leader"), F.col("size_b").alias("n")).union(inside.select("b", "size_a"))
                       .groupBy("leader").agg(F.sum("n").alias("by_ball")))
    each = materialise(found.groupBy("row").agg(F.sum("n").alias("by_row")))
    ball = materialise(balls.join(more, "leader", "left").join(root.withColumnRenamed("node", "leader"), "leader", "left").select(
        "leader", (F.col("size") - F.lit(1) + F.coalesce("by_ball", F.lit(0))).alias("by_ball"), F.coalesce("root", "leader").alias("root")))
    rows = materialise(members.select("row", "leader").join(ball, "leader").join(each, "row", "left").select(
        "row", "root", (F.col("by_ball") + F.coalesce("by_row", F.lit(0))).alias("n_links")))
    named = materialise(base.select("row", "_key").join(rows, "row", "left"))
    least_key = materialise(named.filter("root is not null").groupBy("root").agg(F.min("_key").alias("least")))
    out = named.join(least_key, "root", "left").select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("root").isNull(), F.col("_key")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
