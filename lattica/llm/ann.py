"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors are dealt to shards by a hash of their components. For each shard a task builds a graph: vectors come in growing
batches; a greedy search over the graph so far, from the shard's medoid, proposes neighbours of each; robust pruning keeps
of them those that no kept one is closer to by the factor of slack, which leaves a few diverse edges; and edges are added
backwards, a node being pruned again when its edges no longer fit into its room. Queries come in blocks and are searched
by narrow beams in every shard; the nearest of all shards are ranked by their exact cosines in double precision. A beam
evaluates a small share of a full shard; the column evaluated says how many vectors a query was compared with.

All searches of a round advance together, a step of all beams being one gather and one matrix product, so the work is
done in array operations.

Every vector is indexed; nothing is sampled. Equal vectors are one node that knows as many of its smallest ids as a query
can ask for, one more for the query itself, so a vector on a third of all rows is one node and ties are resolved exactly.
What leaves a shard is the asked-for number of rows for each query.

A task gets one shard's graph and at most QUERY_BLOCKS blocks of queries; with more queries a shard's graph goes to several
tasks, so no task grows with the number of queries or of vectors.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components take no
part, neither as queries nor as candidates; vectors of different lengths are not compared; ties go to the smaller id;
repeated rows (same id and vector) are one, and of an id with several vectors the nearest counts; a null
id takes no part; other columns are ignored; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import bound_batches, written

#: Distinct vectors of a shard, about; edges a node keeps when it is pruned, and has room for before it is pruned again;
#: width of the beam when building and when searching; slack factor.
SHARD, DEGREE, ROOM, BUILD, BEAM, SLACK = 32_768, 48, 64, 48, 56, 1.2
#: Queries that are searched together, rows of a stored block of queries, and blocks that one task searches.
TOGETHER, BLOCK, QUERY_BLOCKS = 256, 1024, 64


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, similarities) of the beams of all queries, best first (a missing node is -1), and how many nodes each query
    was compared with. x and q have unit rows; edges holds -1 where a node has fewer."""
    n, m = len(q), len(x)
    nodes = np.full((n, width), -1)
    near = np.full((n, width), -np.inf, np.float32)
    done = np.zeros((n, width), bool)
    nodes[:, 0], near[:, 0] = entry, q @ x[entry]
    seen = np.zeros((n, m), bool)
    seen[:, entry] = True
    while True:
        open_ = ~done & (nodes >= 0)
        busy = np.flatnonzero(open_.any(1))
        if not len(busy):
            return nodes, near, seen.sum(1)
        at = open_[busy].argmax(1)  # beams are sorted, so this is the nearest node not yet expanded
        done[busy, at] = True
        new = edges[nodes[busy, at]]
        fresh = (new >= 0) & ~seen[busy[:, None], new]
        rows, cols = np.nonzero(fresh)
        seen[busy[rows], new[rows, cols]] = True
        score = np.full(new.shape, -np.inf, np.float32)
        score[rows, cols] = np.einsum("ij,ij->i", q[busy[rows]], x[new[rows, cols]])
        all_nodes = np.concatenate([nodes[busy], np.where(fresh, new, -1)], 1)
        all_near = np.concatenate([near[busy], score], 1)
        all_done = np.concatenate([done[busy], np.zeros(new.shape, bool)], 1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        nodes[busy], near[busy], done[busy] = (np.take_along_axis(a, order, 1) for a in (all_nodes, all_near, all_done))


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Edges of the nodes `of`, from their rows of candidates (-1: none). A candidate goes if a kept one is nearer to it
    than the node is, by the factor of slack. Distances are squared Euclidean ones of unit vectors."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == of[:, None]] = -1
    v = x[c]
    gap = np.where(c >= 0, 2 - 2 * np.matmul(v, x[of][:, :, None])[:, :, 0], np.inf)
    order = np.argsort(gap, axis=1, kind="stable")
    c, gap, v = np.take_along_axis(c, order, 1), np.take_along_axis(gap, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    apart = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))  # of each two candidates of a node
    kept = np.full((len(of), degree), -1)
    alive, each = np.isfinite(gap), np.arange(len(of))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        kept[:, k] = np.where(some, c[each, at], -1)
        alive &= slack * slack * apart[each, at] > gap
        alive[each, at] = False
    return kept


def add_backwards(x: np.ndarray, edges: np.ndarray, of: np.ndarray, degree: int, slack: float) -> None:
    """Gives each neighbour of the nodes `of` an edge back, and prunes those whose room is full."""
    source, target = np.repeat(of, edges.shape[1]), edges[of].ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.lexsort((source, target))
    source, target = source[by], target[by]
    starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    times = np.diff(np.r_[starts, len(target)])
    nodes = target[starts]
    more = np.full((len(nodes), int(times.max())), -1)
    more[np.repeat(np.arange(len(nodes)), times), np.arange(len(target)) - np.repeat(starts, times)] = source
    merged = np.sort(np.concatenate([edges[nodes], more], 1), axis=1)[:, ::-1]
    merged[:, 1:][merged[:, 1:] == merged[:, :-1]] = -1
    merged = np.sort(merged, axis=1)[:, ::-1]
    room = edges.shape[1]
    fits = (merged >= 0).sum(1) <= room
    edges[nodes[fits]] = merged[fits][:, :room]
    full, crowded = nodes[~fits], merged[~fits]
    for at in range(0, len(full), TOGETHER * 2):
        some = full[at : at + TOGETHER * 2]
        edges[some] = -1
        edges[some, :degree] = robust_prune(x, some, crowded[at : at + TOGETHER * 2], degree, slack)


def build_graph(x: np.ndarray, degree: int = DEGREE, room: int = ROOM, width: int = BUILD, slack: float = SLACK, seed: int = 5) -> tuple[np.ndarray, int]:
    """(edges, entry) over unit rows x."""
    n = len(x)
    entry = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    edges = np.full((n, room), -1)
    at = 1
    while at < n:  # as many as the graph has already, up to a batch
        of = order[at : at + min(at, TOGETHER * 2)]
        found, _, _ = beam_search(x, edges, entry, x[of], min(width, at))
        edges[of, :degree] = robust_prune(x, of, found, degree, slack)
        add_backwards(x, edges, of, degree, slack)
        at += len(of)
    return edges, entry


def usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix in double precision) of the vectors that take part, for each length of vectors."""
    at = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    starts, sizes = at[:-1], np.diff(at)
    counted = lambda x: np.concatenate([[0], np.cumsum(x)])
    odd, filled = counted(~np.isfinite(values)), counted(values != 0)
    ok = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False) & (odd[at[1:]] == odd[starts]) & (filled[at[1:]] > filled[starts])
    numbers = ids.fill_null(0).to_numpy()
    for size in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == size))
        yield numbers[rows], values[starts[rows][:, None] + np.arange(size)] + 0.0  # no negative zeros


NODE = "digest binary, vector binary, vec_id long"


def _distinct(vectors: DataFrame, most: int) -> DataFrame:
    """digest, vector (its components in double precision) and vec_id of usable vectors; of equal ones at most `most`
    rows of each batch, the smallest ids."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, rows in usable(b.column(0), b.column(1)):
                held: dict[bytes, list[int]] = {}
                for i, v in zip(ids.tolist(), rows):
                    held.setdefault(v.tobytes(), []).append(i)
                out = [(hashlib.blake2b(v, digest_size=16).digest(), v, i) for v, own in held.items() for i in sorted(set(own))[:most]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), [pa.binary(), pa.binary(), pa.int64()])], names=["digest", "vector", "vec_id"])

    return vectors.mapInArrow(of, NODE)


FOUND = "query_id long, vec_id long, score double, evaluated long"
GRAPH = "shard int, n long, raw binary, edges binary, node_ids binary, known binary, entry long"
GRAPH_NAMES = [x.split()[0] for x in GRAPH.split(", ")]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) and evaluated (vectors that the query was compared with, in all
    shards together) of the k nearest found of each row of queries among the rows of vectors with another id. Both tables
    have the columns id_col and vector_col."""
    bound_batches(vectors.sparkSession)
    pair = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")]
    nodes = _distinct(vectors.select(*pair), k + 1)
    # the k + 1 smallest ids of each distinct vector; batches have left few rows of one vector
    ranked = nodes.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id")))
    groups = ranked.where(f"r <= {k + 1}").groupBy("digest").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    groups = written(groups)
    count = groups.count()
    shards = max(1, -(-count // shard))
    dealt = groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")).select("shard", "digest", "vector", "ids")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        for b in batches:
            for s, _, vector, ids in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault((s, len(vector)), []).append((vector, ids))
        for s, size in sorted(held):  # vectors of one length form a graph
            these = held.pop((s, size))
            raw = np.frombuffer(b"".join(v for v, _ in these)).reshape(len(these), -1)
            unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
            edges, entry = build_graph(unit)
            ids = np.array([(own + [-1] * (k + 1))[: k + 1] for _, own in these], np.int64)
            known = np.array([len(own) for _, own in these], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(these)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (raw, edges.astype(np.int32), ids, known)), pa.array([entry], pa.int64())], names=GRAPH_NAMES)

    placed = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "digest")
    graphs = written(placed.mapInArrow(build, GRAPH))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, rows in usable(b.column(0), b.column(1)):
                for at in range(0, len(ids), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at : at + BLOCK].tobytes()], pa.binary()), pa.array([rows[at : at + BLOCK].tobytes()], pa.binary())], names=["ids", "block"])

    asked = written(queries.select(*pair).mapInArrow(blocks, "ids binary, block binary"))
    # every block of the stated queries meets every shard; a task gets a shard's graph and a bounded number of blocks
    parts = max(1, -(-asked.count() // QUERY_BLOCKS))
    task = lambda part: (F.col("shard") * parts + part).cast("int").alias("task")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = graphs.withColumn("part", upto(parts)).select(task(F.col("part")), F.lit(0).alias("kind"), "n", "raw", "edges", "node_ids", "known", "entry", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("block"))
    every = asked.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts))).withColumn("shard", upto(shards))
    every = every.select(task(F.col("part")), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("binary").alias(x) for x in ("raw", "edges", "node_ids", "known")), F.lit(0).cast("long").alias("entry"), "ids", "block")
    tasks = some.union(every).repartitionById(shards * parts, "task").sortWithinPartitions("task", "kind").drop("task")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: list[Shard] = []
        after = False
        for b in batches:
            for kind, n, raw, edges, node_ids, known, entry, ids, block in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    if after:  # the next task's graphs begin
                        graphs, after = [], False
                    graphs.append(Shard(np.frombuffer(raw).reshape(n, -1), np.frombuffer(edges, np.int32).reshape(n, -1), np.frombuffer(node_ids, np.int64).reshape(n, -1), np.frombuffer(known, np.int64), entry))
                    continue
                after, own = True, np.frombuffer(ids, np.int64)
                q = np.frombuffer(block).reshape(len(own), -1)
                for g in graphs:
                    if g.raw.shape[1] == q.shape[1] and len((rows := g.search(own, q, k, beam))[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["query_id", "vec_id", "score", "evaluated"])

    by_query = Window.partitionBy("query_id")
    found = tasks.mapInArrow(search, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("evaluated").alias("evaluated"))
    found = found.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).withColumn("evaluated", F.sum("evaluated").over(by_query))
    return found.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score", "evaluated")


class Shard:
    """A shard's vectors and graph, ready for searches."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, node_ids: np.ndarray, known: np.ndarray, entry: int):
        self.raw, self.edges, self.node_ids, self.known, self.entry = raw, edges, node_ids, known, entry
        self.norms = np.linalg.norm(raw, axis=1)
        self.unit = (raw / self.norms[:, None]).astype(np.float32)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, ...]:
        """(query ids, vector ids, cosines, vectors evaluated): at most k rows for each query, its own id left out; the
        last is told on a query's first row and is 0 on others."""
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q), TOGETHER):
            some, mine = q[at : at + TOGETHER], own[at : at + TOGETHER]
            sizes = np.linalg.norm(some, axis=1)
            nodes, _, evaluated = beam_search(self.unit, self.edges, self.entry, (some / sizes[:, None]).astype(np.float32), min(beam, len(self.raw)))
            rows, cols = np.nonzero(nodes >= 0)
            hit = nodes[rows, cols]
            score = np.einsum("ij,ij->i", some[rows], self.raw[hit]) / (sizes[rows] * self.norms[hit])
            # the ids of a node, as often as it has them
            times = self.known[hit]
            first = np.repeat(np.cumsum(times) - times, times)
            rows, score = np.repeat(rows, times), np.repeat(score, times)
            ids = self.node_ids[np.repeat(hit, times), np.arange(len(first)) - first]
            keep = ids != mine[rows]
            rows, score, ids = rows[keep], score[keep], ids[keep]
            order = np.lexsort((ids, -score, rows))
            rows, score, ids = rows[order], score[order], ids[order]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
            rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
            keep = rank < k
            out.append((mine[rows[keep]], ids[keep], score[keep], np.where(rank[keep] == 0, evaluated[rows[keep]], 0)))
        return tuple(np.concatenate(c) for c in zip(*out))


def nearest_of_table(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The five nearest of the rows whose id is divisible by `every`, among all rows."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % every == 0))
