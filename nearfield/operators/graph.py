"""Graph indexes. A graph is built for each shard of bounded size and kept as a table (shard, node, level, neighbors,
embedding, entry); a search walks every shard's graph for the stated queries and merges, so no task holds all vectors."""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import pairwise
from nearfield.operators.search import _best, dimension, query_blocks


def exact_neighbors(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    n = len(x)
    out = np.zeros((n, min(k, n - 1)), dtype=np.int64)
    sq = (x * x).sum(1)
    for i in range(0, n, block):
        d = sq[i : i + block, None] + sq[None] - 2 * x[i : i + block] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        at = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < n - 1 else np.argsort(d, axis=1)[:, : out.shape[1]]
        out[i : i + block] = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)
    return out


def descend_neighbors(x: np.ndarray, k: int, rounds: int = 8, sample: int = 8, seed: int = 1) -> np.ndarray:
    """Approximate neighbours: in each round every point meets its neighbours' neighbours and keeps its k nearest."""
    n, rng = len(x), np.random.default_rng(seed)
    k = min(k, n - 1)
    near = np.stack([rng.choice(n - 1, k, replace=False) for _ in range(n)])
    near += near >= np.arange(n)[:, None]
    for _ in range(rounds):
        change = 0
        back = [[] for _ in range(n)]
        for i in range(n):
            for j in near[i, :sample]:
                back[j].append(i)
        for i in range(n):
            own = near[i]
            meet = np.unique(np.concatenate([own, near[own[:sample]].ravel(), near[back[i][:sample]].ravel() if back[i] else own]))
            meet = meet[meet != i]
            d = ((x[meet] - x[i]) ** 2).sum(1)
            best = meet[np.argsort(d, kind="stable")[:k]]
            change += len(np.setdiff1d(best, own))
            near[i] = best
        if change < 0.001 * n * k:
            break
    return near


def prune(x: np.ndarray, at: int, candidates: list[int], degree: int) -> list[int]:
    """Keeps a candidate if no kept one is nearer to it than the point itself is; nearest first."""
    return prune_all(x, [at], [candidates], degree)[0]


def prune_all(x: np.ndarray, points: list[int], candidates: list, degree: int, block: int = 256) -> list[list[int]]:
    """prune() of each of the points, which go through their candidates side by side."""
    out: list[list[int]] = []
    for lo in range(0, len(points), block):
        at, some = np.array(points[lo : lo + block]), candidates[lo : lo + block]
        sizes = np.array([len(c) for c in some])
        c = np.repeat(at[:, None], max(1, sizes.max()), axis=1)
        c[np.arange(c.shape[1]) < sizes[:, None]] = np.concatenate([np.asarray(own, np.int64) for own in some])
        own = x[c]
        d = ((own - x[at][:, None]) ** 2).sum(2)
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        own = np.take_along_axis(own, order[:, :, None], 1)
        sq = (own * own).sum(2)
        between = np.maximum(sq[:, :, None] + sq[:, None] - 2 * (own @ own.transpose(0, 2, 1)), 0.0)
        # of each candidate, the distance to the nearest that was kept; the point itself fills lists up and is never kept
        nearest = np.where(c == at[:, None], -np.inf, np.inf)
        kept, n = np.zeros(c.shape, bool), np.zeros(len(at), np.int64)
        for i in range(c.shape[1]):
            keep = np.flatnonzero((nearest[:, i] >= d[:, i]) & (n < degree))
            kept[keep, i] = True
            n[keep] += 1
            nearest[keep] = np.minimum(nearest[keep], between[keep, i])
            again = c[keep] == c[keep, i][:, None]
            nearest[keep] = np.where(again, -np.inf, nearest[keep])
        out.extend(row[k].tolist() for row, k in zip(c, kept, strict=True))
    return out


def link(x: np.ndarray, near: np.ndarray, degree: int) -> list[list[int]]:
    """Pruned neighbours with links back, pruned again where a point has too many; every point is reached from point 0's
    component by a link from its nearest neighbour in it."""
    n = len(x)
    out = prune_all(x, list(range(n)), list(near), degree)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own:
            back[j].append(i)
    both = [list(dict.fromkeys([*a, *b])) for a, b in zip(out, back, strict=True)]
    full = sorted((i for i in range(n) if len(both[i]) > degree), key=lambda i: len(both[i]))  # lists of like lengths together
    for i, own in zip(full, prune_all(x, full, [both[i] for i in full], degree), strict=True):
        both[i] = own
    return both


def connect(x: np.ndarray, links: list[list[int]], entry: int) -> None:
    """Adds links until the entry reaches every point (the tree that a navigating graph is grown by)."""
    seen = np.zeros(len(x), dtype=bool)

    def walk(start: int) -> None:
        todo = [start]
        seen[start] = True
        while todo:
            for j in links[todo.pop()]:
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)

    walk(entry)
    while not seen.all():
        i = int(np.flatnonzero(~seen)[0])
        inside = np.flatnonzero(seen)
        links[int(inside[((x[inside] - x[i]) ** 2).sum(1).argmin()])].append(i)
        walk(i)


def level_of(ids: np.ndarray, m: int) -> np.ndarray:
    """Levels of exponential law with 1 / ln(m), drawn from a hash of the id, so that a rebuild gives the same graph."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.floor(-np.log(u) / np.log(m)).astype(int)


@dataclass
class Shard:
    """ids, vectors, links of each level from 0, and the entry point."""

    ids: np.ndarray
    x: np.ndarray
    levels: list[dict[int, list[int]]]
    entry: int


def build_shard(ids: np.ndarray, x: np.ndarray, m: int, kind: str = "hnsw", build_k: int = 48, descend: bool = False) -> Shard:
    neighbors = descend_neighbors if descend and len(x) > 2 * build_k else exact_neighbors
    if len(x) == 1:
        return Shard(ids, x, [{0: []}], 0)
    if kind == "nsg":
        entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        links = link(x, neighbors(x, build_k), m)
        connect(x, links, entry)
        return Shard(ids, x, [dict(enumerate(links))], entry)
    level = level_of(ids, m)
    levels = []
    for lev in range(int(level.max()) + 1):
        at = np.flatnonzero(level >= lev)
        if len(at) == 1:
            levels.append({int(at[0]): []})
            continue
        links = link(x[at], neighbors(x[at], build_k), 2 * m if lev == 0 else m)
        connect(x[at], links, 0)
        levels.append({int(at[i]): [int(at[j]) for j in own] for i, own in enumerate(links)})
    return Shard(ids, x, levels, int(np.flatnonzero(level == level.max())[0]))


def build(vectors: DataFrame, m: int = 16, kind: str = "hnsw", shard_points: int = 20_000, **how) -> DataFrame:
    """The graphs' table. shard_points bounds a shard; their number follows the table's size."""
    n = vectors.count()
    shards = max(1, -(-n // shard_points))
    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")).repartition(shards, "shard").sortWithinPartitions("shard", "vec_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def pack(shard: int, rows: list) -> object:
            g = build_shard(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64), m, kind, **how)
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for lev, own in enumerate(g.levels):
                for i, links in own.items():
                    for c, v in zip(cols, (shard, int(g.ids[i]), lev, [int(g.ids[j]) for j in links], rows[i][1] if not lev else None, i == g.entry), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.float32())), pa.array(cols[5], pa.bool_())], ["shard", "node", "level", "neighbors", "embedding", "entry"])

        now, rows = None, []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[2] != now:
                    if rows:
                        yield pack(now, rows)
                    now, rows = r[2], []
                rows.append(r)
        if rows:
            yield pack(now, rows)

    return dealt.mapInArrow(run, "shard int, node long, level int, neighbors array<long>, embedding array<float>, entry boolean")


def in_degree(graph: DataFrame, level: int = 0) -> DataFrame:
    return graph.where(F.col("level") == level).select(F.explode("neighbors").alias("node")).groupBy("node").agg(F.count("*").alias("n"))


@dataclass
class State:
    """What a stop policy may look at while a search runs."""

    k: int
    ef: int
    query: np.ndarray
    step: int = 0
    ndis: int = 0
    inserts: int = 0
    first: float = 0.0
    best: list[tuple[float, int]] = field(default_factory=list)  # (-distance, node), a heap of the ef nearest
    expanded: set = field(default_factory=set)
    predicted: float = -1.0
    memory: dict = field(default_factory=dict)
    within: list[tuple[float, int]] = field(default_factory=list)  # (distance, node) inside a range search's radius
    near: list[tuple[float, int]] | None = None  # the k nearest in order, where a walk keeps them
    wide: list[float] = field(default_factory=list)  # distances of the ef nearest nodes that were met, in order

    def ranked(self) -> list[tuple[float, int]]:
        return sorted((-d, i) for d, i in self.best)[: self.k] if self.near is None else self.near

    def top(self) -> np.ndarray:
        return np.array([d for d, _ in self.ranked()])

    def nearest(self) -> list[int]:
        return [i for _, i in self.ranked()]


Policy = Callable[[State, float], bool]


def walk(g: Shard, query: np.ndarray, k: int, ef: int, policy: Policy | None = None, admit: np.ndarray | None = None, radius: float | None = None) -> State:
    """Greedy descent through the upper levels, then a best-first walk of level 0 with a queue of `ef`. policy(state,
    distance of the node about to be expanded) ends the walk by returning True and may change state.ef. admit: which
    nodes may be results; all are walked through."""
    x, at = g.x, g.entry
    d = float(((x[at] - query) ** 2).sum())
    s = State(k, max(ef, k), query, first=d)
    for level in reversed(g.levels[1:]):
        while True:
            own = level.get(at, [])
            if not own:
                break
            ds = ((x[own] - query) ** 2).sum(1)
            s.ndis += len(own)
            j = int(ds.argmin())
            if ds[j] >= d:
                break
            at, d = own[j], float(ds[j])
    seen = {at}
    todo, base = [(d, at)], g.levels[0]
    s.near = []
    if admit is None or admit[at]:
        s.best, s.near = [(-d, at)], [(d, at)]
        if radius is not None and d < radius:
            s.within.append((d, at))
    wide = s.wide = [d]  # the queue's own bound is the last
    while todo:
        d, at = heapq.heappop(todo)
        if len(wide) >= s.ef and d > wide[-1] and (radius is None or d >= radius):
            break
        if policy is not None and policy(s, d):
            break
        s.step += 1
        s.expanded.add(at)
        own = [j for j in base[at] if j not in seen]
        if not own:
            continue
        seen.update(own)
        gap = x.take(own, axis=0)
        gap -= query
        gap *= gap
        ds = np.add.reduce(gap, 1)
        s.ndis += len(own)
        met = zip(own, ds.tolist(), strict=True)
        if radius is None and len(wide) >= s.ef and len(s.best) >= s.ef:
            bound = max(wide[-1], -s.best[0][0])  # most are beyond it, and it only shrinks
            met = [p for p in met if p[1] < bound]
        for j, v in met:
            inside = radius is not None and v < radius
            if inside and (admit is None or admit[j]):
                s.within.append((v, j))
            if inside or len(wide) < s.ef or v < wide[-1]:
                heapq.heappush(todo, (v, j))
                insort(wide, v)
                del wide[s.ef :]
            if (admit is None or admit[j]) and (len(s.best) < s.ef or v < -s.best[0][0]):
                if len(s.near) < k or v < s.near[-1][0]:
                    s.inserts += 1
                    insort(s.near, (v, j))
                    del s.near[k:]
                heapq.heappush(s.best, (-v, j))
                while len(s.best) > s.ef:
                    heapq.heappop(s.best)
    return s


def load_shards(rows: Iterator, names: list[str]) -> Iterator[tuple[int, Shard]]:
    """Shards from batches of the graph table, sorted by (shard, level, node)."""
    for shard, _, g in load_slices(rows):
        yield shard, g


def slices(graph: DataFrame) -> int:
    """How many tasks are to share a shard's queries, so that few shards keep all cores busy: for search() and for traces
    of a graph that is kept, as its shards are counted."""
    shards = graph.select("shard").distinct().count()
    return max(1, -(-graph.sparkSession.sparkContext.defaultParallelism // max(1, shards)))


def width(ef: int, n: int, shard_points: int = 20_000, points: int = 2_000) -> int:
    """The queue for a table of n rows, whose shards have at most shard_points: `ef` where a shard has at most `points`, and
    by the root of the ratio wider where it has more, as the same recall takes. Bounded, as shards are."""
    shards = max(1, -(-n // shard_points))
    return max(ef, math.ceil(ef * math.sqrt(n / shards / points)))


def dealt(graph: DataFrame, slices: int = 1) -> DataFrame:
    """The graph's shards, each in one task, or once in each slice's task, for a graph that is kept: its shards are counted,
    so that there is a task for each slice and no other, where a hash would deal some of them to one task."""
    order = ["shard", "level", "node"]
    if slices == 1:
        return graph.repartition("shard").sortWithinPartitions(*order)
    shards = graph.agg(F.max("shard")).first()[0]
    each = graph.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return each.repartitionById(slices * (1 + (shards or 0)), F.col("shard") * slices + F.col("slice")).sortWithinPartitions("slice", *order)


def load_slices(rows: Iterator) -> Iterator[tuple[int, int, Shard]]:
    """(shard, slice, graph) from batches of dealt(), or of the graph table with slice 0, sorted by (shard, level, node)."""
    import pyarrow as pa

    def made(now: tuple[int, int], own: list) -> tuple[int, int, Shard]:
        t = pa.Table.from_batches(own)
        node, level, entry = (t.column(c).to_numpy() for c in ("node", "level", "entry"))
        ids = node[level == 0]
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("embedding").filter(pa.array(level == 0)).chunks])
        links = np.concatenate([c.flatten().to_numpy() for c in t.column("neighbors").chunks])
        ends = np.cumsum(np.concatenate([c.value_lengths().to_numpy() for c in t.column("neighbors").chunks])).tolist()
        links, at = np.searchsorted(ids, links).tolist(), np.searchsorted(ids, node).tolist()
        lists = [links[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        first = np.searchsorted(level, np.arange(level[-1] + 2)).tolist()
        levels = [dict(zip(at[a:b], lists[a:b], strict=True)) for a, b in zip(first[:-1], first[1:], strict=True)]
        return *now, Shard(ids, x.astype(np.float64).reshape(len(ids), -1), levels, at[int(entry.argmax())])

    now, own = None, []
    for batch in rows:
        names = batch.schema.names
        keys = np.stack([batch.column(names.index(c)).to_numpy() if c in names else np.zeros(batch.num_rows, np.int32) for c in ("shard", "slice")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if (key := (int(keys[0, a]), int(keys[1, a]))) != now:
                if own:
                    yield made(now, own)
                now, own = key, []
            own.append(batch.slice(a, b - a))
    if own:
        yield made(now, own)


def search(graph: DataFrame, queries: DataFrame, k: int, ef: int = 64, policy: Callable[[], Policy] | None = None, selector: Callable[[np.ndarray], np.ndarray] | None = None, radius: float | None = None, slices: int = 1) -> DataFrame:
    """(query_id, vec_id, distance, ndis, nstep, predicted, shard) of every shard's walk, k a shard; merge with merged(). Queries
    are broadcast in blocks of checked size, each a pass over the graph; a column `ef` of theirs is each query's own width.

    With a radius, all nodes met within it are results, however many: the walk ends when the nearest node that is not
    expanded yet is beyond the radius and beyond the ef nearest. slices: how many tasks share a shard's queries.
    """
    out = None
    for block in query_blocks(queries, dimension(queries, "q")):
        part = _search(graph, block, k, ef, policy, selector, radius, slices)
        out = part if out is None else out.unionByName(part)
    return out


def _search(graph: DataFrame, queries: DataFrame, k: int, ef: int, policy, selector, radius: float | None, slices: int) -> DataFrame:
    rows = queries.orderBy("query_id").collect()  # at most BLOCK_BYTES, see query_blocks
    wide = [r["ef"] if "ef" in queries.columns else ef for r in rows]
    sent = graph.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["q"] for r in rows], dtype=np.float64), wide))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, q, wide = sent.value
        for shard, own, g in load_slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            admit = None if selector is None else selector(g.ids)
            for qid, v, width in zip(ids[own::slices], q[own::slices], wide[own::slices], strict=True):
                s = walk(g, v, k, width, policy() if policy else None, admit, None if radius is None else radius + 1e-6)
                found = sorted((-a, int(g.ids[i])) for a, i in s.best)[:k] if radius is None else sorted((a, int(g.ids[i])) for a, i in s.within)
                for a, i in found:
                    a = round(a, 6)
                    if radius is not None and a >= radius:
                        continue  # as exact search, which compares rounded distances
                    for c, val in zip(out, (qid, i, a, s.ndis, s.step, s.predicted, shard), strict=True):
                        c.append(val)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.float64()), pa.array(out[6], pa.int32())], ["query_id", "vec_id", "distance", "ndis", "nstep", "predicted", "shard"])

    return dealt(graph, slices).mapInArrow(run, "query_id long, vec_id long, distance double, ndis long, nstep long, predicted double, shard int")


def cost(found: DataFrame) -> float:
    """Distances that a search took a query, on average: the sum of its walks' in all shards."""
    own = found.groupBy("query_id", "shard").agg(F.max("ndis").alias("n")).groupBy("query_id").agg(F.sum("n").alias("n"))
    return own.agg(F.avg("n")).first()[0]


def merged(found: DataFrame, k: int) -> DataFrame:
    return _best(found.select("query_id", "vec_id", "distance"), k, False)


def knn_graph(vectors: DataFrame, k: int, shard_points: int = 20_000) -> DataFrame:
    """(vec_id, rank, neighbor, distance): every vector's k exact nearest others, by distances of six digits, then ids.

    Shards of bounded size meet pair by pair, each pair in a task of its own; a vector travels once for each shard. There
    are as many shards as the cores need, of 1,000 points at least.
    """
    n, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_points), min(-(-n // 1000), math.isqrt(2 * cores) + 1))
    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("s"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    low, high = F.least("s", "t"), F.greatest("s", "t")
    # pairs low <= high in order, so that there is a task for each and no other
    unit = (low * shards - F.floor(low * (low - 1) / 2) + high - low).cast("int")
    units = dealt.select("vec_id", "embedding", unit.alias("unit"), (F.col("s") > F.col("t")).alias("side"), (F.col("s") == F.col("t")).alias("one"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def near(batches: list) -> Iterator:
            t = pa.Table.from_batches(batches)
            ids, side, one = (t.column(c).to_numpy() for c in ("vec_id", "side", "one"))
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("embedding").chunks]).astype(np.float64).reshape(len(ids), -1)
            pairs = [(np.arange(len(ids)),) * 2] if one[0] else [(np.flatnonzero(side), np.flatnonzero(~side)), (np.flatnonzero(~side), np.flatnonzero(side))]
            for a, b in pairs:
                best = pairwise.Nearest(x[a], k, "l2", False)
                best.meet(ids[b], x[b], admit=lambda at, rows, a=a, b=b: ids[a][at][:, None] != ids[b][rows][None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a][best.at]), pa.array(best.ids), pa.array(best.d)], ["query_id", "vec_id", "distance"])

        now, own = None, []
        for batch in batches:
            unit = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if unit[a] != now:
                    if own:
                        yield from near(own)
                    now, own = unit[a], []
                own.append(batch.slice(a, b - a))
        if own:
            yield from near(own)

    found = units.repartitionById(shards * (shards + 1) // 2, F.col("unit")).sortWithinPartitions("unit", "side", "vec_id").mapInArrow(run, "query_id long, vec_id long, distance double")
    best = _best(found.withColumn("distance", F.round("distance", 6)), k, False)
    return best.select(F.col("query_id").alias("vec_id"), "rank", F.col("vec_id").alias("neighbor"), "distance")
