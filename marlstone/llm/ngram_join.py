"""Join of documents by the Jaccard similarity of their word n-gram sets, with prefix trees.

1. Equal sets count once: their smallest document stands for them.
2. A filter. An inverted index of shortened n-gram hashes, dealt out in numpy blocks, tells which n-grams
   other documents may have too and how many; a shortened hash can only make two n-grams look the same,
   never apart. Links need ``threshold`` of a set in common, so a document of which fewer n-grams may be
   shared is done with. The texts of the others are read once more for their full 64-bit n-gram sets, in the
   global order: by document frequency (its logarithm), then by hash.
3. Documents that share one of the n-grams at the head of their order are candidates. Each is compared with
   the smallest document of each such n-gram; links found so tie most copies together.
4. Candidates that are connected by head n-grams form clusters. Clusters that are not tied in full are joined
   in tries of their ordered sets: documents with a common head share its overlaps; a subtree is left when
   the overlap so far and what remains below it (or of the query) cannot reach the overlap that its smallest
   set needs. Documents that are known to be in one component are not compared again. Clusters are dealt out
   in blocks of like set sizes, big tied groups in blocks of their own; only pairs of blocks that can hold
   links between different groups meet.

n-grams that a large share of all documents holds are counted before and sent by no index block, so no
block grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.shared import saved, slices
from marlstone.llm.worker import only

CHUNK = 1 << 20
BUCKET_ENTRIES = 3_000_000
BLOCK_DOCS = 256
TIE_DOCS = 128
# An n-gram is frequent if it is met so often in chunks where it is met so often.
LOCAL_COUNT, FREQUENT_SHARE = 16, 512
SHORT = 32  # bits of a hash that the index keeps beside its bucket
# Odd multipliers of the hashes.
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = np.cumprod(np.full(256, _A))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def ngram_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct word n-grams of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SPACE[b]
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if not start.size:
        return [np.zeros(0, np.uint64) for _ in texts]
    stop = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    at = np.arange(b.size) - np.repeat(start, np.diff(np.append(start, b.size))).astype(np.int64) if start[0] == 0 else np.concatenate(
        [np.zeros(start[0], np.int64), np.arange(start[0], b.size) - np.repeat(start, np.diff(np.append(start, b.size)))]
    )
    value = np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * _PLACE[at & 255] + (at >> 8).astype(np.uint64) * _B, np.uint64(0))
    word = _mixed(np.add.reduceat(value, start) + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    last = np.searchsorted(start, ends)
    n = max(0, word.size - size + 1)
    gram = np.zeros(n, np.uint64)
    for j in range(size):
        gram = gram * _A + word[j : j + n] * _B
    gram = _mixed(gram)
    out = []
    for a, z in zip(first.tolist(), last.tolist()):
        if z - a >= size:
            out.append(np.unique(gram[a : z - size + 1]))
        elif z > a:
            h = np.uint64(z - a)
            with np.errstate(over="ignore"):
                for w in word[a:z]:
                    h = h * _A + w * _B
            out.append(_mixed(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    only("n-grams")
    keys, texts, size = [], [], 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys.append(k)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= CHUNK or len(keys) >= 60_000:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _set_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _facts(size: int):
    """(doc, n, k1, k2) of every document, and (null, count, n-gram, null) of n-grams frequent in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _chunks(batches):
            sets = ngram_sets(texts, size)
            rows = [(k, s.size, *_set_key(s)) for k, s in zip(keys, sets)]
            h = np.sort(np.concatenate(sets))
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, np.int64)
            count = np.diff(np.append(head, h.size))
            often = np.flatnonzero(count >= max(LOCAL_COUNT, len(keys) // (2 * FREQUENT_SHARE)))
            rows += [(None, int(c), int(x), None) for c, x in zip(count[often], h[head[often]].view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "n", "k1", "k2"])

    return run


def _index(size: int, buckets: int, bits: int, frequent):
    """Blocks (bucket, chunk, shortened n-gram hashes, document numbers) of the index.

    A chunk is a batch of documents. Its table of documents (key, set key, set size) and a mark (-1) for each
    of its frequent n-grams go back to it as they are, in one row of a negative bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_count = frequent.value
        chunk = TaskContext.get().partitionId() << 32
        for keys, texts in _chunks(batches):
            sets = ngram_sets(texts, size)
            seen: set[tuple[int, int]] = set()
            mine, table = [], []
            for i in sorted(range(len(keys)), key=keys.__getitem__):  # of equal sets only the smallest document can stand for them
                k = _set_key(sets[i])
                if sets[i].size and k not in seen:
                    seen.add(k)
                    mine.append(i)
                    table.append((keys[i], *k, sets[i].size))
            if not mine:
                continue
            chunk += 1
            h = np.concatenate([sets[i] for i in mine])
            d = np.repeat(np.arange(len(mine)), [sets[i].size for i in mine]).astype(np.uint16)
            is_hot = np.zeros(h.size, bool)
            first = np.zeros(0, np.int64)
            if hot.size:
                at = np.minimum(np.searchsorted(hot, h), hot.size - 1)
                is_hot = hot[at] == h
                first = np.full(int(is_hot.sum()), -1, np.int64)
            rows = [(-1 - chunk % buckets, chunk, first.tobytes(), d[is_hot].tobytes(), np.array(table, "<i8").tobytes())]
            h, d = h[~is_hot], d[~is_hot]
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            low = _short(h, bits)
            by = np.lexsort((low, bucket))
            bucket, low, d = bucket[by], low[by], d[by]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            for j in np.flatnonzero(np.diff(edge)).tolist():
                rows.append((j, chunk, low[edge[j] : edge[j + 1]].tobytes(), d[edge[j] : edge[j + 1]].tobytes(), None))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000]), kinds)], ["bucket", "chunk", "h", "number", "docs"])

    return run


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def _order_of(count: np.ndarray) -> np.ndarray:
    """Classes of document frequencies, 0 to 60."""
    return np.minimum(np.log2(np.maximum(count, 1)) * 2, 60).astype(np.int64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block (chunk, number, grams, docs) of the n-grams that more than one document may have; input is sorted by bucket."""
    names, kinds = ["chunk", "number", "grams", "docs"], (pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def emit(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(h, "<u4") for _, h, _ in held]
        low = np.concatenate(parts)
        order = np.argsort(low, kind="stable")
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], low[order[1:]] != low[order[:-1]]])), low.size))
        count = np.empty(low.size, np.int64)
        count[order] = np.repeat(size, size)
        gram = bucket << 38 | low.astype(np.int64) << 6 | _order_of(count)
        out, at = [], 0
        for (chunk, _, number), part in zip(held, parts):
            again = count[at : at + part.size] > 1
            if again.any():
                out.append((chunk, np.frombuffer(number, "<u2")[again].tobytes(), gram[at : at + part.size][again].tobytes(), None))
            at += part.size
        for i in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 500]), kinds)], names)

    held, last = [], None
    for b in batches:
        for bucket, chunk, h, number, docs in zip(*(b.column(i).to_pylist() for i in range(5))):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((chunk, number, h, docs), kinds)], names)
                continue
            if held and bucket != last:
                yield from emit(last, held)
                held = []
            last = bucket
            held.append((chunk, h, number))
    if held:
        yield from emit(last, held)


def _left(threshold: int):
    """(doc, k1, k2, n, coarse) of the documents of which enough n-grams may be shared, from all blocks of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for numbers, grams, docs in zip(*(b.column(i).to_pylist() for i in range(3))):
                table = np.frombuffer(docs[0], "<i8").reshape(-1, 4)
                number = np.concatenate([np.frombuffer(n, "<u2") for n in numbers])
                gram = np.concatenate([np.frombuffer(g, "<i8") for g in grams])
                by = np.lexsort((gram, number))
                number, gram = number[by], gram[by]
                edge = np.searchsorted(number, np.arange(len(table) + 1))
                enough = np.flatnonzero(100 * np.diff(edge) >= threshold * table[:, 3])
                if enough.size:
                    cols = [*(pa.array(table[enough, j]) for j in range(4)), pa.array([gram[edge[i] : edge[i + 1]].tobytes() for i in enough.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc", "k1", "k2", "n", "coarse"])

    return run


def _exact(size: int, buckets: int, bits: int, threshold: int, frequent):
    """(doc, n, grams, classes, head) of rows (doc, text, k1, k2, n, coarse): the full hashes of what may be shared, in global order."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("n-grams")
        hot, hot_count = frequent.value
        for whole in batches:
            for b in slices(whole, 256):
                out = []
                rows = list(zip(*(b.column(i).to_pylist() for i in range(6))))
                for (doc, _, k1, k2, n, coarse), h in zip(rows, ngram_sets([r[1] for r in rows], size)):
                    if _set_key(h) != (k1, k2):
                        continue  # another text under the same key
                    known = np.frombuffer(coarse, "<i8")
                    known = np.append(known[known >= 0], np.iinfo(np.int64).max)
                    mine = (h % np.uint64(buckets)).astype(np.int64) << 32 | _short(h, bits)
                    at = np.minimum(np.searchsorted(known >> 6, mine), known.size - 1)
                    may, kind = (known >> 6)[at] == mine, known[at] & 63
                    if hot.size:  # the class of an n-gram is its own, not that of one which looks the same
                        at = np.minimum(np.searchsorted(hot, h), hot.size - 1)
                        may |= hot[at] == h
                        kind = np.where(hot[at] == h, _order_of(hot_count[at]), kind)
                    h, kind = h[may], kind[may]
                    by = np.lexsort((h, kind))
                    least = -(-threshold * n // 100)  # n-grams in common that any link needs
                    if by.size >= least:
                        h, kind = h[by], kind[by]
                        out.append((doc, n, h.tobytes(), kind.astype(np.uint8).tobytes(), h[: by.size - least + 1].view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc", "n", "grams", "classes", "head"])

    return run


def links_needed(a: int, b: int, overlap: int, threshold: int) -> bool:
    """Whether sets of ``a`` and ``b`` n-grams with ``overlap`` in common link: 100 * intersection >= threshold * union."""
    return (100 + threshold) * overlap >= threshold * (a + b)


def _ties(threshold: int):
    """True links (a, b) of rows (b, part, side, doc, n, grams) sorted by these; side 0 holds the sets of ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            a, z = [], []
            for b, part, side, doc, n, grams in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (b, part) != last:
                    last, own = (b, part), []
                h = np.frombuffer(grams, "<u8")
                if not side:
                    own.append((n, h))
                elif any(links_needed(n, m, np.intersect1d(h, g, assume_unique=True).size, threshold) for m, g in own):
                    a.append(doc)
                    z.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return run


class Trie:
    """The ordered sets of some documents, level by level; a node covers a range of the sorted documents."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray):
        size = np.array([s.size for s in sets], np.int64)
        depth = int(size.max(initial=0))
        table = np.full((len(sets), depth), -1, np.int32)
        for i, s in enumerate(sets):
            table[i, : s.size] = s
        self.order = np.lexsort(table.T[::-1]) if depth else np.arange(len(sets))
        table, size, self.n = table[self.order], size[self.order], n[self.order]
        # Of each node: element, first document, last + 1, documents that end in it (its first ones), the
        # smallest set below it and the most elements left below it.
        self.levels: list[tuple[np.ndarray, ...]] = []
        begin = np.zeros(len(sets), bool)
        begin[:1] = True
        for d in range(depth):
            begin[1:] |= table[1:, d] != table[:-1, d]
            lo = np.flatnonzero(begin)
            hi = np.append(lo[1:], len(sets))
            least, most = np.minimum.reduceat(self.n, lo), np.maximum.reduceat(size, lo) - d - 1
            ended = np.add.reduceat((size == d + 1).astype(np.int64), lo)
            ok = table[lo, d] >= 0  # documents that ended above are in no node
            self.levels.append((table[lo[ok], d], lo[ok], hi[ok], ended[ok], least[ok], most[ok]))

    def links(self, grams: list[np.ndarray], sizes: np.ndarray, alive: np.ndarray, threshold: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, sorted document) pairs that link, among the documents that are ``alive``."""
        has = np.zeros((len(grams), vocabulary), bool)
        for i, g in enumerate(grams):
            has[i, g] = True
        left = np.array([g.size for g in grams])[:, None] - has.cumsum(1, dtype=np.int32)
        live = np.concatenate([[0], np.cumsum(alive)])
        found_q, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # The frontier: a query, the range of documents of its node, and the overlap so far.
        q, start, stop, overlap = np.arange(len(grams)), np.zeros(len(grams), np.int64), np.full(len(grams), alive.size), np.zeros(len(grams), np.int64)
        for element, lo, hi, ended, least, most in self.levels:
            a, z = np.searchsorted(lo, start), np.searchsorted(lo, stop)
            parent = np.repeat(np.arange(q.size), z - a)
            node = np.arange(parent.size) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[parent]
            keep = live[hi[node]] > live[lo[node]]
            parent, node = parent[keep], node[keep]
            q = q[parent]
            overlap = overlap[parent] + has[q, element[node]]
            reach = overlap + np.minimum(left[q, element[node]], most[node])
            keep = (100 + threshold) * reach >= threshold * (sizes[q] + least[node])
            q, node, overlap = q[keep], node[keep], overlap[keep]
            if not q.size:
                break
            e = ended[node]
            k = np.flatnonzero(e)
            if k.size:
                who = np.repeat(k, e[k])
                d = lo[node[who]] + np.arange(who.size) - np.repeat(np.cumsum(e[k]) - e[k], e[k])
                fine = alive[d] & ((100 + threshold) * overlap[who] >= threshold * (sizes[q[who]] + self.n[d]))
                found_q.append(q[who[fine]])
                found_d.append(d[fine])
            start, stop = lo[node] + e, hi[node]
        return np.concatenate(found_q), np.concatenate(found_d)


def linked(docs: np.ndarray, n: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], ties: np.ndarray, sides: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that tie together the documents which links connect, unless they are tied already.

    ``sets`` are hashes and classes in global order; equal ``ties`` are known to be one component. Where
    there are two ``sides``, only documents of different sides are compared.
    """
    size = len(sets)
    h, which = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
    kind = np.zeros(h.size, np.uint8)
    kind[which] = np.concatenate([c for _, c in sets])
    rank = np.empty(h.size, np.int64)
    rank[np.lexsort((h, kind))] = np.arange(h.size)
    ranked = np.split(rank[which], np.cumsum([x.size for x, _ in sets])[:-1])
    trie = Trie(ranked, n)
    ranked, n, docs, sides = [ranked[i] for i in trie.order.tolist()], n[trie.order], docs[trie.order], sides[trie.order]
    group = np.unique(ties[trie.order], return_inverse=True)[1]
    batch = max(4, min(64, 6_000_000 // max(1, h.size)))
    two = sides.min() < sides.max()
    asks = 0 if (sides == 0).sum() <= (sides == 1).sum() else 1
    open_ = sides == asks if two else np.ones(size, bool)
    edges = []
    while open_.any():
        waiting = np.flatnonzero(open_)
        # Many documents of one group are asked together: those of that group need not be found again.
        counts = np.bincount(group[waiting], minlength=size)
        big = int(counts.argmax())
        some = waiting[group[waiting] == big][:batch] if counts[big] > 1 else waiting[:batch]
        alive = sides != asks if two else open_.copy()
        if counts[big] > 1:
            alive &= group != big
        if alive.any():
            a, d = trie.links([ranked[i] for i in some.tolist()], n[some], alive, threshold, h.size)
            for x, y in zip(some[a].tolist(), d.tolist()):
                gx, gy = group[x], group[y]
                if gx != gy:
                    edges.append((int(docs[x]), int(docs[y])))
                    group[group == gy] = gx
        open_[some] = False
    return edges


def _join(threshold: int):
    """Edges (a, b) of rows (task, side, doc, tie, n, grams, classes), sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                side, doc, tie, n, grams, classes = zip(*held)
                sets = [(np.frombuffer(g, "<u8"), np.frombuffer(c, np.uint8)) for g, c in zip(grams, classes)]
                e = linked(np.array(doc, np.int64), np.array(n, np.int64), sets, np.array(tie, np.int64), np.array(side), threshold)
                if e:
                    a, b = zip(*e)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        only("n-grams")
        held, last = [], None
        for b in batches:
            for task, *rest in zip(*(b.column(i).to_pylist() for i in range(7))):
                if task != last:
                    yield from emit(held)
                    held, last = [], task
                held.append(tuple(rest))
        yield from emit(held)

    return run


def _tied(ready: DataFrame, candidates: DataFrame, threshold: int) -> DataFrame:
    """The links among candidate pairs (a, b); those of one ``b`` are dealt out by ``TIE_DOCS``, each part with the set of ``b``."""
    parts = candidates.groupBy("b").agg((F.floor(F.count("*") / TIE_DOCS) + 1).cast("long").alias("parts"))
    asks = candidates.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), "parts").alias("part"), F.lit(1).alias("side"), F.col("a").alias("doc"))
    asked = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("b").alias("doc"))
    rows = asks.unionByName(asked).join(ready.select("doc", "n", "grams"), "doc").select("b", "part", "side", "doc", "n", "grams")
    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "side").mapInArrow(_ties(threshold), "a long, b long")


def _dealt(members: DataFrame, threshold: int) -> DataFrame:
    """Rows (task, side, doc, n, tie) of the pairs of blocks of members (doc, n, cluster, tie) that may hold new links.

    Sets that link have sizes in one class or in adjacent ones. A tied group of more than ``BLOCK_DOCS``
    documents of one class has blocks of its own, which need not meet one another.
    """
    width = float(np.log(100 / threshold) * 1.0001) if threshold < 100 else 1.0
    members = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / width))
    groups = members.groupBy("cluster", "class", "tie").agg(F.count("*").alias("size")).withColumn("own", F.when(F.col("size") > BLOCK_DOCS, F.col("tie")))
    blocks = groups.groupBy("cluster", "class", "own").agg(F.sum("size").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK_DOCS))
    same = (F.col("cluster") == F.col("c2")) & (F.col("class") == F.col("k2")) & F.col("own").eqNullSafe(F.col("o2"))
    far = blocks.select(F.col("cluster").alias("c2"), F.col("class").alias("k2"), F.col("own").alias("o2"), "blocks")
    homes = groups.join(far, same).select("cluster", "class", "tie", "own", "blocks")
    place = members.join(homes, ["cluster", "class", "tie"])
    # Small groups stay whole, so that their documents meet in one block only.
    place = place.withColumn("sub", F.pmod(F.when(F.col("own").isNull(), F.xxhash64("tie")).otherwise(F.xxhash64("doc")), "blocks"))
    place = place.select("doc", "n", "tie", "cluster", F.concat_ws(" ", "class", F.coalesce(F.col("own").cast("string"), F.lit("-")), "sub").alias("block"), "class", "own")
    place = saved(place, "blocks")
    each = place.select("cluster", "class", "own", "block").distinct()
    other = each.select("cluster", F.col("class").alias("k2"), F.col("own").alias("o2"), F.col("block").alias("other"))
    pairs = each.join(other, "cluster").filter((F.col("k2") - F.col("class")).isin(0, 1) & ~((F.col("class") == F.col("k2")) & (F.col("block") > F.col("other"))))
    pairs = pairs.filter(F.col("own").isNull() | ~F.col("own").eqNullSafe(F.col("o2")))
    pairs = pairs.select("cluster", "block", "other", F.concat_ws("/", "cluster", "block", "other").alias("task"))
    sides = pairs.select("cluster", "task", F.lit(0).alias("side"), "block")
    sides = sides.unionByName(pairs.filter("block <> other").select("cluster", "task", F.lit(1).alias("side"), F.col("other").alias("block")))
    return place.join(sides, ["cluster", "block"]).select("task", "side", "doc", "n", "tie")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, threshold: int = 85, bits: int = SHORT) -> DataFrame:
    """The components of documents that are linked by their sets of ``size``-word n-grams.

    Words are runs other than space and \\t to \\r, A-Z lower-cased; a shorter document's whole sequence is
    its one n-gram. Two documents link when 100 * intersection >= ``threshold`` * union. Returns one row for
    each row: the key, ``n_shingles`` and ``component_id`` (smallest key reachable). Null, empty and blank
    texts have no n-grams and link with nothing. Rows with a null key link with nothing and have a null
    component; rows that share a key are one node, whatever their texts. Other columns are ignored. ``bits``
    (at most 32) of a hash are kept by the filter, which lets more through where they are few.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    facts = saved(rows.mapInArrow(_facts(size), "doc long, n long, k1 long, k2 long"), "sets")
    each = facts.filter("k2 IS NOT NULL")
    sums = each.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    buckets = 1 + sums["grams"] // BUCKET_ENTRIES
    # Frequent n-grams: at most FREQUENT_SHARE times the n-grams of an average document.
    often = facts.filter("k2 IS NULL AND k1 IS NOT NULL").groupBy("k1").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(256, sums["docs"] // FREQUENT_SHARE))
    got = often.collect()
    hot = np.array([r["k1"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(hot)
    frequent = spark.sparkContext.broadcast((hot[order], np.array([r["n"] for r in got], np.int64)[order]))

    keyed = each.filter("n > 0 AND doc IS NOT NULL")
    standing = keyed.groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"))
    index = rows.filter("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(_index(size, buckets, bits, frequent), "bucket long, chunk long, h binary, number binary, docs binary")
    shared = index.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "chunk long, number binary, grams binary, docs binary")
    # A chunk's blocks: one for each bucket at most, together no larger than the sets of its documents.
    chunks = shared.groupBy("chunk").agg(*[F.collect_list(c).alias(c) for c in ("number", "grams", "docs")]).drop("chunk")
    left = chunks.mapInArrow(_left(threshold), "doc long, k1 long, k2 long, n long, coarse binary")
    left = saved(left.join(standing.withColumnRenamed("rep", "doc"), ["k1", "k2", "n", "doc"]).dropDuplicates(["doc", "k1", "k2"]), "left")
    texts = rows.join(saved(left.select("doc").distinct(), "left-keys"), "doc", "left_semi")
    exact = texts.join(left, "doc").select("doc", "text", "k1", "k2", "n", "coarse").mapInArrow(_exact(size, buckets, bits, threshold, frequent), "doc long, n long, grams binary, classes binary, head array<long>")
    ready = saved(exact, "ordered-sets")

    heads = ready.select("doc", "n", F.explode("head").alias("gram"))
    least = heads.groupBy("gram").agg(F.min(F.struct("doc", "n")).alias("b"), F.count("*").alias("c")).filter("c > 1").select("gram", F.col("b.doc").alias("b"), F.col("b.n").alias("m"))
    near = saved(heads.join(least, "gram").filter("doc <> b").select(F.col("doc").alias("a"), "b", "n", "m").distinct(), "candidates")
    like = near.filter((100 * F.least("n", "m") >= threshold * F.greatest("n", "m"))).select("a", "b").distinct()
    ties = saved(_tied(ready, like, threshold), "ties")
    tied = components(ties).select(F.col("id").alias("doc"), F.col("component").alias("tie"))
    clusters = components(near.select("a", "b")).select(F.col("id").alias("doc"), F.col("component").alias("cluster"))
    members = ready.select("doc", "n").join(clusters, "doc").join(tied, "doc", "left").select("doc", "n", "cluster", F.coalesce("tie", "doc").alias("tie"))
    members = saved(members, "members")
    unsettled = members.groupBy("cluster").agg(F.min("tie").alias("x"), F.max("tie").alias("y")).filter("x <> y").select("cluster")
    dealt = _dealt(members.join(unsettled, "cluster", "left_semi"), threshold).join(ready.select("doc", "n", "grams", "classes"), ["doc", "n"])
    # A number of partitions that is named is not lowered where the rows are few; their work is in pairs.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = dealt.select("task", "side", "doc", "tie", "n", "grams", "classes").repartition(parts, "task").sortWithinPartitions("task")
    links = saved(joined.mapInArrow(_join(threshold), "a long, b long"), "links")
    # Keys with several sets tie what stands for these together.
    several = keyed.groupBy("doc").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x <> y").select("doc")
    same_key = keyed.join(several, "doc", "left_semi").join(standing, ["k1", "k2", "n"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    nodes = components(ties.unionByName(links).unionByName(same_key)).withColumnRenamed("id", "rep")
    named = standing.join(nodes, "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    return each.join(named, ["k1", "k2", "n"], "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id")
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-gram components of all ``documents``, four words and 85 %; nulls and repeated rows as ``ngram_components`` says."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
