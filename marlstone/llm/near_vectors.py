"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Equal vectors count as one with a weight. The vectors of one length are dealt into shards of at most about
``SHARD_ROWS``, each of which builds a graph; every vector is then searched in every shard, in batches that advance side by side in
numpy. A search that meets a near vector goes on through all near ones around it, so a large group of
copies is walked, not cut off by the beam. Each block of searches is audited against brute force on a
sample of its queries and its beam is doubled until the audit passes. The audit judges the links of queries
with one, two or three, four to seven ... links apart, so that a large group of copies does not outweigh
small ones. Links are verified by cosine in doubles; only their numbers and the edges that tie components
together leave a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.shared import batches_of, saved
from marlstone.llm.vectors import ROWS_AT_ONCE, blocks, lengths, meet, met, valid
from marlstone.llm.worker import only

SHARD_ROWS, LEAST_ROWS, SMALL_SHARDS = 65_536, 1_024, 8  # small tables have up to SMALL_SHARDS shards of LEAST_ROWS
QUERY_ROWS, QUERY_BLOCKS = 8_192, 4
SHARD_BYTES = 64 << 20  # the doubles of a shard's vectors, whatever their length
HOT_ROWS, HOT_LIST = 1_024, 10_000  # equal vectors are a hot group from so many rows on; at most HOT_LIST groups are
LINKS, LINKS_0, SPARE, FEW, NEAR_COPY = 12, 24, 8, 6, 0.8
BEAM, BUILD_BEAM = 24, 40
BATCH = 256
SLACK = 0.04  # a search also goes on from vectors that are a little less near
AUDIT_QUERIES, AUDIT_RECALL = 1_024, 0.999
WALK_SHARE, VERIFY_PAIRS = 8, 1 << 16


def _along(a: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The elements of each row in its ``columns``."""
    return a.take(columns + (np.arange(len(a)) * a.shape[1])[:, None])


def _diverse(near: np.ndarray, x: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Of each row of candidates (best first, -1 none) those nearer to the node than to a chosen one, then the best others."""
    v = x[ids]
    pair = np.einsum("acd,aed->ace", v, v)
    chosen = np.zeros(ids.shape, bool)
    full = np.zeros(len(ids), np.int64)
    for r in range(ids.shape[1]):
        ok = (ids[:, r] >= 0) & (full < keep) & ~(chosen & (pair[:, r, :] >= near[:, r, None])).any(1)
        chosen[:, r] = ok
        full += ok
    rank = np.where(ids < 0, 3, np.where(chosen, 0, 1)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1)


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all nodes."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(x)
        self.x = x.astype(np.float32)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 6)
        self.links = [np.full((n, LINKS if i else LINKS_0), -1, np.int32) for i in range(int(level.max(initial=0)) + 1)]
        order = rng.permutation(n)
        # The highest nodes come first, so that searches can always start from one of them.
        order = order[np.argsort(-level[order], kind="stable")]
        self.entry = order[: min(n, 8)]
        self.entry = self.entry[level[self.entry] == level.max(initial=0)] if n else self.entry
        at, size = 0, 32
        while at < n:
            self._insert(order[at : at + size], level, order[:at])
            at, size = at + size, min(512, 2 * size)
        self._reach()

    def _reach(self) -> None:
        """Further links of layer 0, so that no group of near copies is an island.

        Pruning drops links to a copy where another one is as near. Nodes that few of their copies, or few
        others, link to get links back from those they link to; nodes that cannot be reached even then are
        tied to the nearest nodes that can.
        """
        n, own = len(self.x), self.links[0].shape[1]
        links = np.concatenate([self.links[0], np.full((n, SPARE), -1, np.int32)], 1)
        used = np.zeros(n, np.int64)
        far = np.zeros((n, own), bool)
        for i in range(0, n, 2048):
            to = self.links[0][i : i + 2048]
            far[i : i + 2048] = np.einsum("acd,ad->ac", self.x[to], self.x[i : i + 2048]) < NEAR_COPY
        linked = self.links[0] >= 0

        def tie(host: np.ndarray, guest: np.ndarray) -> None:
            host, first = np.unique(host, return_index=True)  # one new link for each host at a time
            ok = ~(links[host] == guest[first][:, None]).any(1)
            host, guest = host[ok], guest[first][ok]
            links[host, own + used[host]] = guest
            used[host] += 1
            inward[guest] += 1

        for kind, few in ((linked & ~far, 2), (linked & far, FEW)):  # from its copies, then from others
            inward = np.bincount(self.links[0][kind], minlength=n)
            for k in range(own):
                needy = np.flatnonzero((inward < few) & kind[:, k])
                host = self.links[0][needy, k]
                ok = used[host] < SPARE
                tie(host[ok], needy[ok])
        while True:
            reached = np.zeros(n, bool)
            front = self.entry
            while front.size:
                reached[front] = True
                front = np.unique(links[front])
                front = front[front >= 0]
                front = front[~reached[front]]
            lost, can = np.flatnonzero(~reached), np.flatnonzero(reached & (used < SPARE))
            if not lost.size or not can.size:
                break
            host = can[np.argsort(-(self.x[can] @ self.x[lost[0]]), kind="stable")[:FEW]]
            tie(host, np.full(host.size, lost[0]))
        self.links[0] = links

    def _insert(self, new: np.ndarray, level: np.ndarray, there: np.ndarray) -> None:
        q = self.x[new]
        mates = q @ q.T
        np.fill_diagonal(mates, -2)
        entry = np.tile(self.entry, (len(new), 1)) if len(there) else None
        for layer in range(len(self.links) - 1, -1, -1):
            rows = np.flatnonzero(level[new] >= layer)
            ids, sims = np.full((len(new), 0), -1), np.full((len(new), 0), -2.0)
            if entry is not None:
                ids, sims, _ = self._beam(q, entry, layer, BUILD_BEAM if layer == 0 else 12)
                entry = ids[:, :4]
            if not rows.size:
                continue
            m = mates[np.ix_(rows, rows)]
            k = min(16, rows.size - 1)
            if k > 0:
                best = np.argpartition(-m, k - 1, axis=1)[:, :k]
                more, s = new[rows][best], np.take_along_axis(m, best, 1)
            else:
                more, s = np.full((rows.size, 0), -1), np.zeros((rows.size, 0))
            c, s = np.concatenate([ids[rows], more], 1), np.concatenate([sims[rows], s], 1)
            order = np.argsort(-s, axis=1, kind="stable")
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            if not c.shape[1]:
                continue
            links = self.links[layer]
            got = _diverse(s, self.x, c, LINKS)
            links[new[rows], : got.shape[1]] = got
            self._back(layer, np.repeat(new[rows], got.shape[1]), got.ravel())

    def _back(self, layer: int, frm: np.ndarray, to: np.ndarray) -> None:
        """Links back from ``to`` to ``frm``; lists that grow too long are chosen anew."""
        links = self.links[layer]
        ok = to >= 0
        frm, to = frm[ok], to[ok]
        sim = np.einsum("ad,ad->a", self.x[frm], self.x[to])
        order = np.lexsort((-sim, to))
        frm, to = frm[order], to[order]
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        place = np.arange(to.size) - np.repeat(head, np.diff(np.append(head, to.size)))
        most = links.shape[1]
        ok = place < most
        nodes = to[head]
        row = np.repeat(np.arange(nodes.size), np.diff(np.append(head, to.size)))
        fresh = np.full((nodes.size, most), -1, np.int64)
        fresh[row[ok], place[ok]] = frm[ok]
        for i in range(0, nodes.size, 2048):
            u, c = nodes[i : i + 2048], np.concatenate([links[nodes[i : i + 2048]], fresh[i : i + 2048]], 1)
            again = (c[:, :most, None] == c[:, None, most:]).any(1) & (c[:, most:] >= 0)
            c[:, most:][again] = -1
            s = np.where(c >= 0, np.einsum("acd,ad->ac", self.x[c], self.x[u]), -2)
            order = np.argsort(-s, axis=1, kind="stable")
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            width = int((c >= 0).sum(1).max(initial=1))
            few = (c >= 0).sum(1) <= most
            links[u[few]] = c[few][:, :most]
            if (~few).any():
                links[u[~few]] = _diverse(s[~few][:, :width], self.x, c[~few][:, :width], most)

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, beam: int, near: float = 3.0, wide: int = 3):
        """The best ``beam`` nodes met from ``entry``, and all pairs (query, node) met with similarity ``near``."""
        n, links, size = len(self.x), self.links[layer], len(q)
        seen = np.zeros(size * n, bool)
        ids, sims = np.full((size, beam), -1, np.int64), np.full((size, beam), -2.0, np.float32)
        done = np.ones((size, beam), bool)
        met: list[np.ndarray] = []
        opened: list[np.ndarray] = []
        rows = np.arange(size)
        fresh = entry
        while rows.size:
            ok, key = np.zeros(fresh.shape, bool), rows[:, None] * n + fresh
            step = links.shape[1] if fresh is not entry else 1
            for j in range(0, fresh.shape[1], step):  # a node listed twice counts once
                part = key[:, j : j + step]
                new = (fresh[:, j : j + step] >= 0) & ~seen.take(part)
                seen[part[new]] = True
                ok[:, j : j + step] = new
            key = key[ok]
            who = key // n
            s = np.full(fresh.shape, -2.0, np.float32)
            s[ok] = np.einsum("ad,ad->a", self.x.take(key - who * n, 0), q.take(who, 0))
            if near <= 1:
                met.append(key[s[ok] >= near])
            all_ids, all_sims = np.concatenate([ids[rows], fresh], 1), np.concatenate([sims[rows], s], 1)
            all_done = np.concatenate([done[rows], ~ok], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[rows], sims[rows], done[rows] = (_along(a, top) for a in (all_ids, all_sims, all_done))
            open_ = np.where(done, -2.0, sims)
            rows = np.flatnonzero((open_ > -2).any(1))
            if not rows.size:
                break
            open_ = open_[rows]
            pick = np.argpartition(-open_, min(wide, beam) - 1, axis=1)[:, : min(wide, beam)]
            use = _along(open_, pick) > -2
            chosen = np.where(use, _along(ids[rows], pick), -1)
            rr, cc = np.nonzero(use)
            done[rows[rr], pick[rr, cc]] = True
            opened.append(rows[rr] * n + chosen[rr, cc])
            fresh = np.where((chosen >= 0)[:, :, None], links[chosen], -1).reshape(rows.size, -1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[sims <= -2] = -1
        if near > 1:
            return ids, sims, None
        return ids, sims, self._walk(q, seen, np.concatenate(met), np.concatenate(opened) if opened else np.zeros(0, np.int64), near)

    def _walk(self, q: np.ndarray, seen: np.ndarray, met: np.ndarray, opened: np.ndarray, near: float) -> np.ndarray:
        """All near pairs, going on from those that the beam met and did not open.

        Where the queries at the front share most of its nodes, as in a large group of copies, the neighbours of
        all are compared with all of these queries at once, as one matrix product.
        """
        n, links = len(self.x), self.links[0]
        found = np.zeros(seen.size, bool)
        found[met] = True
        front = np.setdiff1d(met, opened)
        while front.size:
            who, nodes = np.unique(front // n), np.unique(front % n)
            if WALK_SHARE * front.size >= who.size * nodes.size:
                front = []
                for i in range(0, nodes.size, 1024):
                    nb = np.unique(links[nodes[i : i + 1024]])
                    nb = nb[nb >= 0]
                    key = who[:, None] * n + nb
                    hit = q[who] @ self.x[nb].T >= near
                    hit &= ~found.take(key)
                    seen[key] = True
                    key = key[hit]
                    found[key] = True
                    front.append(key)
                front = np.concatenate(front)
                continue
            part, front = front[:20_000], front[20_000:]
            nb = links[part % n]
            key = (part // n)[:, None] * n + nb
            key = np.unique(key[nb >= 0])
            key = key[~seen[key]]
            seen[key] = True
            key = key[np.einsum("ad,ad->a", self.x[key % n], q[key // n]) >= near]
            found[key] = True
            front = np.concatenate([front, key])
        return np.flatnonzero(found)

    def homes(self, q: np.ndarray) -> np.ndarray:
        """The nodes of layer 0 from which a search of each query starts, nearest first."""
        entry = np.tile(self.entry, (len(q), 1))
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self._beam(q, entry, layer, max(4, entry.shape[1]))[0][:, :4]
        return entry

    def search(self, q: np.ndarray, homes: np.ndarray, beam: int, near: float) -> np.ndarray:
        """All pairs (query number * nodes + node) found as near as ``near``, in order."""
        return self._beam(q, homes, 0, max(beam, self.entry.size), near)[2]


def _audit(graph: Graph, q: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The true pairs (query number * nodes + node) of some queries but for their own nodes, and the class of each by its query's links."""
    pairs = []
    for i in range(0, len(q), 64):
        a, b = np.nonzero(q[i : i + 64] @ graph.x.T >= cosine)
        other = ids[b] != q_ids[i + a]
        pairs.append((i + a[other]) * len(ids) + b[other])
    true = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    of = true // len(ids)
    return true, np.log2(np.bincount(of, minlength=len(q))[of]).astype(np.int64)


def _worst(true: np.ndarray, kind: np.ndarray, found: np.ndarray) -> float:
    """The recall of the class of which the least share was found."""
    if not true.size:
        return 1.0
    all_, got = np.bincount(kind), np.bincount(kind, np.isin(true, found))
    return float((got[all_ > 0] / all_[all_ > 0]).min())


def _links(graph: Graph, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, cosine: float, unit: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, nodes) of the verified links of each batch of queries; queries that start in one place share a batch.

    ``unit`` is ``x`` at length 1, where the caller has it.
    """
    if unit is None:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q_unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    q32 = q_unit.astype(np.float32)
    beam, near = BEAM, cosine - SLACK
    homes = np.concatenate([graph.homes(q32[i : i + BATCH]) for i in range(0, len(q), BATCH)])
    order = np.argsort(homes[:, 0], kind="stable")
    some = order[np.linspace(0, len(q) - 1, min(len(q), AUDIT_QUERIES)).astype(np.int64)]
    true, kind = _audit(graph, q32[some], ids, q_ids[some], cosine)
    while beam < len(x):  # beyond that the beam is the whole shard
        found = [i * len(x) + graph.search(q32[k], homes[k], beam, near) for i in range(0, len(some), BATCH) for k in (some[i : i + BATCH],)]
        if _worst(true, kind, np.concatenate(found)) >= AUDIT_RECALL:
            break
        beam *= 2
    for i in range(0, len(q), BATCH):
        k = order[i : i + BATCH]
        if beam < len(x):
            key = graph.search(q32[k], homes[k], beam, near)
        else:  # the beam is the whole shard
            key = np.flatnonzero((q32[k] @ graph.x.T).ravel() >= near)
        for j in range(0, key.size, VERIFY_PAIRS):
            a, b = np.divmod(key[j : j + VERIFY_PAIRS], len(x))
            a = k[a]
            ok = (q_unit[a] * unit[b]).sum(1) >= cosine
            yield a[ok], b[ok]


def _search(each: DataFrame, size: int, count: int, cosine: float, shards: int | None) -> DataFrame:
    """(a, null, n): the number of links of a vector; (a, b, 0): edges that tie linked vectors together."""
    most = max(1, SHARD_BYTES // (8 * size))
    parts = shards or max(-(-count // min(SHARD_ROWS, most)), min(SMALL_SHARDS, -(-count // LEAST_ROWS)))
    sets = -(-count // min(QUERY_ROWS, most))

    def graph(x: np.ndarray) -> bytes:
        g = Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
        return pickle.dumps((g.links, g.entry))

    graphs = saved(blocks(each, parts, size, graph), "graphs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vectors")
        part = None
        for of, side, *block in met(batches, size):
            if not side:
                part, (ids, weight, x, made) = of, block
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                g = Graph.__new__(Graph)
                g.links, g.entry = pickle.loads(made)
                g.x = unit.astype(np.float32)
                del block, x, made
            elif of == part:
                q_ids, _, q, _ = block
                label, own, count, edges = ids.copy(), q_ids.copy(), np.zeros(q_ids.size, np.int64), []
                for a, b in _links(g, ids, unit, q_ids, q, cosine, unit):
                    other = ids[b] != q_ids[a]
                    a, b = a[other], b[other]
                    np.add.at(count, a, weight[b])
                    while a.size:  # the least label of a query and its links, until nothing changes
                        low, lower = own.copy(), label.copy()
                        np.minimum.at(low, a, label[b])
                        np.minimum.at(lower, b, low[a])
                        moved, moved_q = lower < label, low < own
                        if not (moved.any() or moved_q.any()):
                            break
                        edges.append(np.unique(np.concatenate([np.stack([label[moved], lower[moved]], 1), np.stack([own[moved_q], low[moved_q]], 1)]), axis=0))
                        own, label = low, lower
                has = np.flatnonzero(count)
                e = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
                a = pa.array(np.concatenate([q_ids[has], e[:, 0]]))
                b = pa.array(np.concatenate([np.zeros(has.size, np.int64), e[:, 1]]), mask=np.arange(has.size + len(e)) < has.size)
                yield pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([count[has], np.zeros(len(e), np.int64)]))], ["a", "b", "n"])

    return meet(graphs, blocks(each, sets, size), parts, sets, QUERY_BLOCKS).mapInArrow(run, "a long, b long, n long")


def _names(v: str) -> list:
    """Two hashes that stand for a vector, null for none, so that rows find their group without sending vectors."""
    return [F.when(F.col(v).isNotNull(), F.xxhash64(v)).alias("h1"), F.when(F.col(v).isNotNull(), F.xxhash64(F.lit(1), F.reverse(v), F.lit("vector"))).alias("h2")]


def near_vectors(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """Links and components of the vectors with a cosine of ``cosine`` at least.

    Returns one row per row with a key: the key, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest key reachable) and ``kept`` (the row is its component's first). Vectors
    that are null, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Rows with a null key are left out; a repeated key is a vector each time; other
    columns are ignored; an empty table gives no rows. ``shards`` is the number for each length of vectors,
    by default as the number of rows asks.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL")
    rows = rows.withColumn("v", F.when(valid(F.col("v")), F.col("v")))
    each = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("extra"))
    each = saved(each, "distinct-vectors")
    found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    for size, count in lengths(each):
        found = found.unionByName(_search(each.filter(F.size("v") == size), size, count, cosine, shards))
    with batches_of(vectors.sparkSession, ROWS_AT_ONCE):
        found = saved(found, "links")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "rep")
    groups = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
    facts = each.select(*_names("v"), F.col("id").alias("rep"), F.col("extra").alias("weight")).join(counts, "rep", "left").join(groups, "rep", "left")
    own = rows.select("id", *_names("v"))
    on = ["h1", "h2"]
    total = each.agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0]
    hot = [(r["h1"], r["h2"], r["parts"]) for r in each.filter(F.col("extra") > max(HOT_ROWS, total // HOT_LIST)).select(*_names("v"), F.ceil(F.col("extra") / HOT_ROWS).alias("parts")).collect()]
    if hot:  # the rows of a hot group are dealt out, and its facts sent to each part
        dealt = F.broadcast(vectors.sparkSession.createDataFrame(hot, "h1 long, h2 long, parts long"))
        own = own.join(dealt, on, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0))).drop("parts")
        facts = facts.join(dealt, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        on = [*on, "salt"]
    out = own.join(facts, on, "left").select(
        F.col("id").alias(key),
        (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("component_id") == F.col(key))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all ``embeddings``; nulls, repeated rows and lengths as ``near_vectors`` says."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
