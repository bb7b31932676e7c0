"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Rows are dealt to shards of bounded size by a hash. A shard's graph is built once, by insertion: levels are drawn per
distinct vector, and on every level each vector searches what stands already, links to diverse near ones, and they link
back. The index is a table of flat neighbour arrays, a row per node. Queries, in blocks, descend every shard's levels and
run a beam search at the bottom; shard results are merged by exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SHARD = 8_192
BLOCK = 65_536
LINKS = 16
BEAM = 192


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a length above zero and only finite components, not all zero, and whose id isn't null."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ok.where(~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def _diverse(unit: np.ndarray, near: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row than to any chosen before; then the rest."""
    n, c = near.shape
    out = np.full((n, links), -1, np.int32)
    for lo in range(0, n, 512):
        at, s = near[lo : lo + 512], sims[lo : lo + 512]
        v = unit[at]
        gram = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(at.shape, bool)
        for k in range(c):
            worst = np.where(chosen, gram[:, k, :], -2).max(axis=1)
            chosen[:, k] = (s[:, k] > worst) & (chosen.sum(axis=1) < links) & (at[:, k] >= 0)
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :links]
        picked = np.take_along_axis(at, order, axis=1)
        out[lo : lo + 512, : picked.shape[1]] = picked
    return out


def _row_wise(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(a, order, axis=1)


def _first_links(unit: np.ndarray, links: int) -> np.ndarray:
    """A small set, each linked to diverse ones among all the others."""
    n = len(unit)
    out = np.full((n, 2 * links), -1, np.int32)
    if n < 2:
        return out
    s = unit @ unit.T
    np.fill_diagonal(s, -3)
    c = min(3 * links, n - 1)
    near = np.argsort(-s, axis=1, kind="stable")[:, :c].astype(np.int32)
    out[:, :links] = _diverse(unit, near, _row_wise(s, near), links)
    return out


def _link_back(unit: np.ndarray, out: np.ndarray, new: np.ndarray) -> None:
    """Links from what the new rows chose back to them; rows with more links than they hold keep diverse near ones."""
    width = out.shape[1]
    i, j = np.nonzero(out[new] >= 0)
    source, to = new[i].astype(np.int32), out[new][i, j]
    order = np.lexsort((source, to))
    source, to = source[order], to[order]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    held = (out[targets] >= 0).sum(axis=1)
    fits = held + count <= width
    place = np.arange(len(to)) - np.repeat(first, count) + np.repeat(held, count)
    ok = np.repeat(fits, count)
    # a row's links stand to the left without gaps
    out[to[ok], place[ok]] = source[ok]
    full = np.flatnonzero(~fits)
    full = full[np.argsort(count[full], kind="stable")]
    at = 0
    while at < len(full):
        most = int(count[full[min(at + 255, len(full) - 1)]])
        part = full[at : at + max(1, min(256, 200_000 // (width + most)))]
        at += len(part)
        wide = int(count[part].max())
        more = np.full((len(part), wide), -1, np.int32)
        for r, t in enumerate(part):
            more[r, : count[t]] = source[first[t] : first[t] + count[t]]
        near = np.concatenate((out[targets[part]], more), axis=1)
        s = np.where(near >= 0, np.einsum("td,tkd->tk", unit[targets[part]], unit[near]), -9)
        rank = np.argsort(-s, axis=1, kind="stable")[:, : 3 * width]
        out[targets[part]] = _diverse(unit, _row_wise(near, rank), _row_wise(s, rank), width)


def grown(unit: np.ndarray, links: int, beam: int = 96) -> np.ndarray:
    """Neighbour rows of each row, -1 where there are fewer. Rows are inserted in their order: a small first lot is linked
    among itself; each further lot, no larger than what stands, searches the graph so far, looks at itself, and links to
    diverse near ones, which link back. The work is in proportion to the rows."""
    n = len(unit)
    out = np.full((n, 2 * links), -1, np.int32)
    at = min(n, 512)
    out[:at] = _first_links(unit[:at], links)
    _link_back(unit, out, np.arange(at))
    while at < n:
        lot = np.arange(at, min(n, at + min(1_024, at, max(64, (64 << 20) // n))))  # bounds what is kept of the rows seen
        v = unit[lot]
        entry = np.argsort(-(v @ unit[: min(at, 256)].T), axis=1, kind="stable")[:, :4].astype(np.int32)
        found, s = search_beam(unit, out[:at], v, entry, beam)
        own = v @ v.T
        np.fill_diagonal(own, -9)
        k = min(links, len(lot) - 1)
        mates = np.argsort(-own, axis=1, kind="stable")[:, :k]
        near = np.concatenate((found, lot[mates].astype(np.int32)), axis=1)
        s = np.concatenate((s, _row_wise(own, mates)), axis=1)
        rank = np.argsort(-s, axis=1, kind="stable")[:, : 3 * links]
        out[lot, :links] = _diverse(unit, _row_wise(near, rank), _row_wise(s, rank), links)
        _link_back(unit, out, lot)
        at = int(lot[-1]) + 1
    return _joined(unit, out)


def search_beam(unit: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the best found for each query, all queries at once, best first (-1: fewer), and their similarities."""
    q, n = len(queries), len(neighbours)
    found = np.full((q, beam), -1, np.int32)
    score = np.full((q, beam), -9.0, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    width = min(start.shape[1], beam)
    found[:, :width] = start[:, :width]
    score[:, :width] = np.where(start[:, :width] >= 0, np.einsum("qd,qkd->qk", queries, unit[start[:, :width]]), -9)
    r, c = np.nonzero(found >= 0)
    seen[r, found[r, c]] = True
    every = np.arange(q)
    while True:
        todo = np.where(done | (found < 0), -9, score)
        best = np.argmax(todo, axis=1)
        live = np.flatnonzero(todo[every, best] > -9)
        if not len(live):
            break
        done[live, best[live]] = True
        near = neighbours[found[live, best[live]]]
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # a neighbour listed twice counts once
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        s = np.full(near.shape, -9.0, np.float32)
        s[r, c] = np.einsum("kd,kd->k", queries[live[r]], unit[near[r, c]])
        all_s = np.concatenate((score[live], s), axis=1)
        all_n = np.concatenate((found[live], np.where(fresh, near, -1)), axis=1)
        all_d = np.concatenate((done[live], np.zeros(near.shape, bool)), axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        score[live], found[live], done[live] = (_row_wise(x, top) for x in (all_s, all_n, all_d))
    order = np.argsort(-score, axis=1, kind="stable")
    return _row_wise(found, order), _row_wise(score, order)


def _joined(unit: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Links every part of the graph that is cut off to its nearest vector in the largest part, both ways."""
    n = len(out)
    i, j = np.nonzero(out >= 0)
    a, b = i, out[i, j]
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    parts, counts = np.unique(label, return_counts=True)
    main = parts[np.argmax(counts)]
    inside = np.flatnonzero(label == main)
    for part in parts[parts != main]:
        members = np.flatnonzero(label == part)
        s = unit[members[:256]] @ unit[inside].T
        x, y = np.unravel_index(np.argmax(s), s.shape)
        u, v = members[x], inside[y]
        out[u, -1] = v
        free = np.flatnonzero(out[v] < 0)
        wide = free[0] if len(free) else -1 - int(part) % max(1, out.shape[1] // 2)
        out[v, wide] = u
    return out


class Graph:
    """Flat arrays of a shard: distinct vectors in the order of their insertion, the ids of each (ascending, by offsets),
    the level that each reaches, and per level the neighbour rows of the nodes that reach it."""

    def __init__(self, exact: np.ndarray, ids: np.ndarray, offsets: np.ndarray, top: np.ndarray, links: list[np.ndarray]) -> None:
        self.exact, self.ids, self.offsets, self.top, self.links = exact, ids, offsets, top, links
        self.norms = np.linalg.norm(exact, axis=1)
        self.unit = (exact / self.norms[:, None]).astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, links: int = LINKS) -> Graph:
        distinct, of = np.unique(vectors, axis=0, return_inverse=True)
        of = of.reshape(-1)
        n = len(distinct)
        rng = np.random.default_rng(n)
        place = rng.permutation(n)  # the order of insertion says nothing about where a vector lies
        exact = np.empty_like(distinct)
        exact[place] = distinct
        order = np.lexsort((ids, place[of]))
        ids, of = ids[order], place[of][order]
        keep = np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(of) != 0))) if len(ids) else np.zeros(0, bool)
        ids, of = ids[keep], of[keep]
        top = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(links)).astype(np.int32)
        g = cls(exact, ids, np.searchsorted(of, np.arange(n + 1)), top, [])
        for level in range(int(top.max(initial=0)) + 1):
            nodes = np.flatnonzero(top >= level)
            near = grown(g.unit[nodes], links)
            g.links.append(np.where(near >= 0, nodes[near], -1).astype(np.int32))
        return g

    def to_table(self) -> pa.Table:
        """A row per node: its number, ids, vector, level, and its neighbour rows from level 0 up, one after another."""
        n, width = len(self.exact), self.links[0].shape[1] if self.links else 0
        flat = np.concatenate([x for x in self.links]) if self.links else np.zeros((0, 0), np.int32)
        node = np.concatenate([np.flatnonzero(self.top >= k) for k in range(len(self.links))]) if self.links else np.zeros(0, int)
        flat = flat[np.argsort(node, kind="stable")]
        ends = np.concatenate(([0], np.cumsum((self.top + 1) * width)))
        dim = self.exact.shape[1]
        return pa.table({
            "node": pa.array(np.arange(n), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.ids, pa.int64())),
            "vector": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(self.exact.reshape(-1), pa.float64())),
            "top": pa.array(self.top, pa.int32()), "links": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.reshape(-1), pa.int32())),
        })

    @classmethod
    def from_table(cls, t: pa.Table) -> Graph:
        t = t.sort_by("node").combine_chunks()
        column = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        n, top = t.num_rows, column("top").to_numpy()
        exact = column("vector").flatten().to_numpy().reshape(n, -1)
        ids, links = column("ids"), column("links")
        flat = links.flatten().to_numpy()
        width = len(flat) // int((top + 1).sum())
        flat = flat.reshape(-1, width)
        first = np.cumsum(top + 1) - (top + 1)
        per_level = [flat[first[top >= k] + k] for k in range(int(top.max()) + 1)]
        offsets = ids.offsets.to_numpy()
        return cls(exact, ids.flatten().to_numpy(), offsets - offsets[0], top, per_level)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, beam: int = BEAM) -> list[tuple[int, int, float]]:
        """(query id, vec_id, cosine in double precision) of the k best of each query, the query's own id left out."""
        out = []
        if not len(self.exact):
            return out
        levels = []
        for level, near in enumerate(self.links):
            nodes = np.flatnonzero(self.top >= level)
            levels.append((nodes, np.where(near >= 0, np.searchsorted(nodes, near), -1).astype(np.int32)))
        lot = max(16, min(512, (64 << 20) // len(self.exact)))  # bounds what is kept of the nodes seen
        for lo in range(0, len(queries), lot):
            exact = queries[lo : lo + lot]
            unit = (exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32)
            start = np.zeros((len(unit), 1), np.int32)
            for level in range(len(levels) - 1, -1, -1):
                nodes, near = levels[level]
                got, _ = search_beam(self.unit[nodes], near, unit, start, max(beam, 2 * k) if not level else 8)
                if level:
                    start = np.where(got >= 0, np.searchsorted(levels[level - 1][0], nodes[np.maximum(got, 0)]), -1).astype(np.int32)
            for x, own, row in zip(exact, query_ids[lo : lo + lot].tolist(), got, strict=True):
                row = row[row >= 0]
                s = (self.exact[row] @ x) / (self.norms[row] * np.sqrt(x @ x))
                hits = []
                for node, value in zip(row.tolist(), s.tolist(), strict=True):
                    ids = self.ids[self.offsets[node] : min(self.offsets[node + 1], self.offsets[node] + k + 1)].tolist()
                    hits += [(-value, i) for i in ids if i != own]
                out += [(own, i, -value) for value, i in sorted(hits)[:k]]
        return out


INDEX = "dim int, shard long, node int, ids array<long>, vector array<double>, top int, links array<int>"


def shard_rows(rows: int) -> int:
    """Rows of a shard: so that there are a few hundred shards, within what one task holds."""
    return min(max(rows // 256, SHARD), 32 * SHARD)


def index(vectors: DataFrame, shard: int | None = None, links: int = LINKS) -> DataFrame:
    """INDEX, a row per node of each shard's graph, written once. vectors have vec_id and embedding; null ids, and vectors
    that are null, empty, zero, or hold null or non-finite components are left out, repeated rows count once."""
    base = usable(vectors).withColumn("dim", F.size("embedding")).dropDuplicates(["vec_id", "embedding"])
    base = staged(base, "vectors")
    rows = base.count()
    n_shards = max(1, -(-rows // (shard or shard_rows(rows))))
    base = base.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_shards)))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        (dim, number), t = (k.as_py() for k in key), t.combine_chunks()
        x = np.asarray(t.column("embedding").combine_chunks().flatten()).reshape(-1, dim)
        g = Graph.build(t.column("vec_id").to_numpy(), x, links).to_table()
        return g.add_column(0, "shard", pa.array([number] * g.num_rows, pa.int64())).add_column(0, "dim", pa.array([dim] * g.num_rows, pa.int32()))

    return staged(base.groupBy("dim", "shard").applyInArrow(run, INDEX), "hnsw-index")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int | None = None, block: int = BLOCK, links: int = LINKS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score for each distinct query id: its k nearest by cosine, ties to the smaller vec_id.

    vectors and queries have vec_id and embedding; index() says which take no part. A vector meets only vectors of its own
    length. Of a repeated vec_id each different vector is a candidate, but an id is returned once per query; of a repeated
    query the smallest vector is asked. Each shard's graph is built once; blocks of about ``block`` queries go to every
    shard, since a hash deals near vectors to any of them, and what shards return is merged.
    """
    nodes = index(vectors, shard, links)
    ask = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    ask = staged(ask.withColumn("dim", F.size("embedding")), "queries")
    n_blocks = max(1, -(-ask.count() // block))
    shards = nodes.select(F.col("dim").alias("d_"), F.col("shard").alias("shard")).distinct()
    ask = ask.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).join(shards, F.col("dim") == F.col("d_")).drop("d_")
    nodes = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hits: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            y = np.asarray(right.column("embedding").combine_chunks().flatten()).reshape(right.num_rows, -1)
            hits = Graph.from_table(left).search(y, right.column("vec_id").to_numpy(), k, beam)
        cols = list(zip(*hits, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    key = ["dim", "shard", "block"]
    found = nodes.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every vector whose id is divisible by 50, against all; ties and repeats as in nearest()."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
