"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus. Every
string (window) is filed under its anchor: of its ``GRAM``-byte grams the one with the least hash, the
leftmost of several. Equal windows have equal anchors at equal places, so a window needs to be compared
only with those of its anchor's hash. Adjacent windows with one anchor form a segment.

1. Segments that repeat one that starts earlier are removed whole: first within a batch of documents,
   so that a very frequent one leaves a task only once, then, after a shuffle by anchor, in one pass
   over sorted rows.
2. Segments whose anchor has several different segments are cut out of their texts and dealt out by
   anchor. There the suffixes at the starts of windows are sorted (a suffix array, compared on
   ``LENGTH`` bytes), and the previous and next smaller positions in suffix order give the longest
   previous factor of each; where it reaches ``LENGTH``, the window is removed.
3. Anchors whose different segments hold more than ``HOT_BYTES`` are not compared in one task: their
   windows are dealt out one by one, by the hash of the window, and treated as the segments of step 1.

Only rows of a fixed size and segments of at most some hundred bytes are shuffled besides the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.llm.shared import saved, slices
from marlstone.llm.worker import kept, only

LENGTH = 100
GRAM = 24
CHUNK = 1 << 20
PART = 1 << 17  # bytes of which prefix sums, grams and anchors are held at once; some 100 bytes a byte
SORTED_BYTES = 1 << 18
TEXTS = 512  # texts held as Python objects at once
HOT_BYTES = 2 << 20


def _powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(m, -1, 1 << 64)
    both = []
    for x in (m, inverse):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


class _Hashes:
    """Hashes of substrings from prefix sums; the powers are made once in a worker."""

    # Odd multipliers.
    FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self, b: np.ndarray, m: int):
        n = max(2 * (PART + LENGTH), b.size + 1)
        power, self.inverse = kept("suffixes", (m, n), lambda: _powers(m, n))
        self.sums = np.zeros(b.size + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: b.size], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = self.sums.size - size
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of its least one, the leftmost of several."""
    value, place, have = grams, np.arange(grams.size, dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        take = value[step:] < value[:-step]
        value, place = np.where(take, value[step:], value[:-step]), np.where(take, place[step:], place[:-step])
        have += step
    return place


def segments(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Piece number, first window, windows, anchor hash and content hash of the segments of some byte strings."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    b = np.frombuffer(b"".join(pieces), np.uint8)
    none = np.zeros(0, np.int64)
    if b.size < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    first = _Hashes(b, _Hashes.FIRST)
    grams = first.grams(GRAM)
    at = anchors(grams, LENGTH - GRAM + 1)
    ends = np.repeat(np.cumsum(sizes), sizes)[: at.size]
    start = np.flatnonzero(np.arange(at.size) + LENGTH <= ends)
    if not start.size:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (at[start[1:]] != at[start[:-1]]) | (start[1:] != start[:-1] + 1)]))
    n = np.diff(np.append(new, start.size))
    s = start[new]
    content = _Hashes(b, _Hashes.SECOND).of(s, s + n + LENGTH - 1) ^ n.astype(np.uint64)
    piece = np.searchsorted(np.cumsum(sizes), s, side="right")
    return piece, s - (np.cumsum(sizes) - sizes)[piece], n, grams[at[s]], content


def merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they touch or overlap within a key."""
    if not key.size:
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    # Later keys are shifted beyond all stops of earlier ones, so that one running maximum serves all.
    shift = (np.cumsum(head) - 1) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    new = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > reach[:-1]]))
    last = np.append(new[1:], key.size) - 1
    return key[new], start[new], (reach - shift)[last]


def _smaller_before(place: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it with a smaller value, -1 if there is none, by pointer jumping."""
    found = np.arange(place.size) - 1
    while True:
        bad = np.flatnonzero((found >= 0) & (place[found] >= place))
        if not bad.size:
            return found
        found[bad] = found[found[bad]]


def previous_factors(windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The longest previous factor of each window (rows of ``LENGTH`` bytes), cut at ``LENGTH``.

    ``order`` is the place of each in the corpus; a window met twice has one place. The windows are the
    suffixes at their places. Of the suffixes at smaller places, the longest common prefix is that of the
    nearest one before or after in suffix order.
    """
    w = np.ascontiguousarray(windows)
    suffix = np.argsort(w.view(f"S{LENGTH}")[:, 0], kind="stable")
    place = order[suffix]
    longest = np.zeros(place.size, np.int64)
    before, after = _smaller_before(place), place.size - 1 - _smaller_before(place[::-1])[::-1]
    for other, has in ((before, before >= 0), (after, after < place.size)):
        i = np.flatnonzero(has)
        for j in range(0, i.size, 8192):
            k = i[j : j + 8192]
            same = w[suffix[k]] == w[suffix[other[k]]]
            longest[k] = np.maximum(longest[k], np.where(same.all(1), LENGTH, same.argmin(1)))
    result = np.zeros(place.size, np.int64)
    result[suffix] = longest
    return result


_ROWS = ["h", "s", "doc", "at", "n"]


def _batch(h, s, doc, at, n) -> pa.RecordBatch:
    """Rows of segments; those without a content hash are removed spans of n bytes."""
    s = pa.nulls(len(doc), pa.int64()) if s is None else pa.array(s.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), s, pa.array(doc), pa.array(at), pa.array(n)], _ROWS)


def _firsts(h, s, doc, at, n) -> Iterator[pa.RecordBatch]:
    """The first of equal segments, which come by document and place; the others as spans."""
    both = s ^ (h * np.uint64(_Hashes.SECOND))
    by = np.argsort(both, kind="stable")
    new = np.concatenate([[True], both[by[1:]] != both[by[:-1]]])[: by.size]
    first = by[np.maximum.accumulate(np.where(new, np.arange(by.size), 0))]
    keep, later = np.zeros(by.size, bool), np.zeros(by.size, bool)
    keep[by[new]] = True
    later[by] = (doc[by] != doc[first]) | (at[by] != at[first])  # else it is the first one's row again
    yield _batch(h[keep], s[keep], doc[keep], at[keep], n[keep])
    if later.any():
        d, a, b = merged(doc[later], at[later], at[later] + n[later] + LENGTH - 1)
        yield _batch(_mixed(d.view(np.uint64) * np.uint64(3) + a.view(np.uint64)), None, d, a, b - a)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of texts (doc, text, base), and spans already known to be repeats; places count from ``base``."""
    only("suffixes")
    keys, offsets, pieces, size = [], [], [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(keys)), key=lambda i: (keys[i], offsets[i]))
        got, i = [], 0
        while i < len(order):  # segments of some PART bytes of pieces at a time
            j, held = i, 0
            while j < len(order) and held < PART:
                held, j = held + len(pieces[order[j]]), j + 1
            piece, *rest = segments([pieces[k] for k in order[i:j]])
            got.append((piece + i, *rest))
            i = j
        piece, at, n, h, s = (np.concatenate(x) for x in zip(*got))
        yield from _firsts(h, s, np.array([keys[i] for i in order], np.int64)[piece], at + np.array([offsets[i] for i in order], np.int64)[piece], n)

    for b in (x for whole in batches for x in slices(whole, TEXTS)):
        for k, t, base in zip(*(b.column(i).to_pylist() for i in range(3))):
            raw = t.encode("utf-8", "surrogatepass")
            step = min(PART, CHUNK)
            for o in range(0, max(1, len(raw) - LENGTH + 1), step):
                part = raw[o : o + step + LENGTH - 1]
                keys.append(k)
                offsets.append(base + o)
                pieces.append(part)
                size += len(part)
                if size >= CHUNK:
                    yield from emit()
                    keys, offsets, pieces, size = [], [], [], 0
    if keys:
        yield from emit()


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, content, document and place: repeats as spans, rivals of an anchor as segments."""
    only("suffixes")
    last_h = last_s = last_doc = last_at = None
    wait: tuple | None = None  # the last first-of-its-content row, and whether it has gone out

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]

    for b in batches:
        span = np.array(b.column(1).is_null())
        if span.any():
            some = b.filter(pa.array(span))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.nulls(some.num_rows, pa.int64()), *some.columns[2:]], _ROWS)
            b = b.filter(pa.array(~span))
        if not b.num_rows:
            continue
        h, s, doc, at, n = columns(b)
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        new[0] = last_h is None or h[0] != last_h or s[0] != last_s
        head = np.maximum.accumulate(np.where(new, np.arange(h.size), -1))
        first_doc, first_at = np.where(head < 0, last_doc or 0, doc[head]), np.where(head < 0, last_at or 0, at[head])
        last_h, last_s, last_doc, last_at = int(h[-1]), int(s[-1]), int(first_doc[-1]), int(first_at[-1])
        k = ~new & ((doc != first_doc) | (at != first_at))  # else it is the first one's row again
        if k.any():
            d, a, e = merged(doc[k], at[k], at[k] + n[k] + LENGTH - 1)
            yield _batch(_mixed(d.view(np.uint64) * np.uint64(3) + a.view(np.uint64)), None, d, a, e - a)
        f = np.stack([h, s, doc, at, n])[:, new]
        gone = np.zeros(f.shape[1], bool)
        if wait is not None:
            f, gone = np.concatenate([wait[0][:, None], f], 1), np.concatenate([[wait[1]], gone])
        if not f.shape[1]:
            continue
        same = f[0, 1:] == f[0, :-1]
        out = np.zeros(f.shape[1], bool)
        out[1:] |= same
        out[:-1] |= same
        put = out & ~gone
        wait = (f[:, -1], bool(out[-1] | gone[-1]))
        if put.any():
            yield _batch(*(np.ascontiguousarray(x) for x in f[:, put]))


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc, at, bytes) of the segments of each text."""
    only("suffixes")
    for b in (x for whole in batches for x in slices(whole, TEXTS)):
        for doc, text, base, rivals in zip(*(b.column(i).to_pylist() for i in range(4))):
            raw = text.encode("utf-8", "surrogatepass")
            h, at, n = zip(*((r["h"], r["at"], r["n"]) for r in rivals))
            cols = [pa.array(h, pa.int64()), pa.array([doc] * len(h), pa.int64()), pa.array(at, pa.int64()), pa.array([raw[a - base : a - base + m + LENGTH - 1] for a, m in zip(at, n)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["h", "doc", "at", "raw"])


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments (h, doc, at, raw) as segments of one window each, and spans already known to be repeats."""
    only("suffixes")
    held, size = [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        rows = sorted(held, key=lambda x: x[1:3])
        n = np.array([len(x[3]) - LENGTH + 1 for x in rows], np.int64)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n) + inside
        s = _Hashes(np.frombuffer(b"".join(x[3] for x in rows), np.uint8), _Hashes.SECOND).of(begin, begin + LENGTH)
        h, doc, at = (np.repeat(np.array([x[i] for x in rows], np.int64), n) for i in range(3))
        yield from _firsts(h.view(np.uint64), s, doc, at + inside, np.ones(at.size, np.int64))

    for b in batches:
        for row in zip(*(b.column(j).to_pylist() for j in range(4))):
            held.append(row)
            size += len(row[3])
            if size >= CHUNK:
                yield from emit()
                held, size = [], 0
    if held:
        yield from emit()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans (doc, at, n) of segments sorted by anchor; whole anchors are compared together."""
    only("suffixes")
    doc, at, raw, size, last = [], [], [], 0, None

    def emit() -> pa.RecordBatch:
        d, a, n = np.array(doc, np.int64), np.array(at, np.int64), np.array([len(r) - LENGTH + 1 for r in raw], np.int64)
        text = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(n.size), n)
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[begin[of] + inside]
        place = a[of] + inside
        by = np.lexsort((place, d[of]))
        new = np.concatenate([[True], (d[of][by[1:]] != d[of][by[:-1]]) | (place[by[1:]] != place[by[:-1]])])
        order = np.empty(place.size, np.int64)
        order[by] = np.cumsum(new)  # a place met twice is one place
        gone = np.flatnonzero(previous_factors(windows, order) >= LENGTH)
        x, y, z = merged(d[of[gone]], place[gone], place[gone] + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(z - y)], ["doc", "at", "n"])

    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            for h, *rest in zip(*(part.column(j).to_pylist() for j in range(4))):
                if h != last and size >= SORTED_BYTES:
                    yield emit()
                    doc, at, raw, size = [], [], [], 0
                last = h
                for held, x in zip((doc, at, raw), rest):
                    held.append(x)
                size += len(rest[2])
    if doc:
        yield emit()


def with_bases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``__base``, where the places of each row's text begin.

    It is 0 but for keys that several different texts share: these are told apart by multiples of 2^32, in
    the order of a hash of the text, so that they are different documents of one key.
    """
    each = docs.select(F.col(key).cast("long").alias("__key"), F.xxhash64(text).alias("__hash"))
    shared = each.filter("__key IS NOT NULL").groupBy("__key").agg(F.min("__hash").alias("lo"), F.max("__hash").alias("hi")).filter("lo <> hi").select("__key")
    shared = saved(shared, "shared-keys")
    if shared.isEmpty():
        return docs.withColumn("__base", F.lit(0).cast("long"))
    # Two longs a text of a shared key; the window numbers them without holding them.
    texts = each.join(shared, "__key", "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("__hash")) - 1
    bases = texts.withColumn("__base", F.shiftleft(rank.cast("long"), 32))
    out = docs.withColumn("__key", F.col(key).cast("long")).withColumn("__hash", F.xxhash64(text)).join(bases, ["__key", "__hash"], "left")
    return out.withColumn("__base", F.coalesce("__base", F.lit(0).cast("long"))).select(*[docs[c] for c in docs.columns], "__base")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", base: str = "__base") -> DataFrame:
    """Spans of bytes (``doc``, ``at``, ``n``) that repeat; they may overlap, together they are complete.

    ``docs`` come from ``with_bases``, and places count from the base. Rows with equal keys and bases count
    as one document. Rows with a null key or text have no spans and are no earlier copies. Two strings are
    taken to be equal where 64 bits of their anchor and 64 bits of their content agree.
    """
    whole = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.col(base).alias("base")).filter("doc IS NOT NULL AND text IS NOT NULL")
    long_enough = whole.filter(F.octet_length("text") >= LENGTH)
    rows = long_enough.mapInArrow(_cut, "h long, s long, doc long, at long, n long")
    rows = rows.repartition("h").sortWithinPartitions("h", "s", "doc", "at")
    sifted = saved(rows.mapInArrow(_sift, "h long, s long, doc long, at long, n long"), "segments")
    spans = sifted.filter("s IS NULL").select("doc", "at", "n")
    rival = sifted.filter("s IS NOT NULL")
    hot = rival.groupBy("h").agg(F.sum(F.col("n") + LENGTH - 1).alias("bytes")).filter(F.col("bytes") > HOT_BYTES)
    base_of = F.shiftleft(F.shiftright("at", 32), 32).alias("base")
    rivals = rival.groupBy("doc", base_of).agg(F.collect_list(F.struct("h", "at", "n")).alias("rivals"))  # as many as a text has
    cut = whole.join(rivals, ["doc", "base"]).select("doc", "text", "base", "rivals").mapInArrow(_texts_of, "h long, doc long, at long, raw binary")
    many = [r["h"] for r in hot.select("h").collect()]  # one of each HOT_BYTES of segments at most
    if many:
        cut = saved(cut, "hot-segments")
        of = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in many], "h long"))
        dealt = cut.join(of, "h", "left_semi").select("h", "doc", "at", "raw").mapInArrow(_windows_of, "h long, s long, doc long, at long, n long")
        dealt = dealt.repartition("h", "s", F.when(F.col("s").isNull(), F.col("doc"))).sortWithinPartitions("h", "s", "doc", "at")
        spans = spans.unionByName(dealt.mapInArrow(_sift, "h long, s long, doc long, at long, n long").filter("s IS NULL").select("doc", "at", "n"))
        cut = cut.join(of, "h", "left_anti").select("h", "doc", "at", "raw")
    found = cut.repartition("h").sortWithinPartitions("h", "doc", "at").mapInArrow(_compare, "doc long, at long, n long")
    return spans.unionByName(found)


def _apply(digest: bool, at: int):
    """Adds the outcome to rows whose last column is the list of spans and whose column ``at`` is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffixes")
        for b in (x for whole in batches for x in slices(whole, TEXTS)):
            out: list[list] = [[], [], [], []]
            spans = b.column(b.num_columns - 1)
            for text, own in zip(b.column(at).to_pylist(), spans.to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, n, here = [], 0, 0, 0
                if own:
                    a = np.array([x["at"] for x in own], np.int64)
                    _, start, stop = merged(np.zeros_like(a), a, a + np.array([x["n"] for x in own], np.int64))
                    for s, e in zip(start.tolist(), np.minimum(stop, len(raw)).tolist()):
                        if s < e:
                            kept.append(raw[here:s])
                            removed, n, here = removed + e - s, n + 1, e
                kept.append(raw[here:])
                rest = b"".join(kept)
                last = hashlib.sha256(rest).hexdigest() if digest else None if text is None else rest.decode("utf-8", "ignore")
                for held, x in zip(out, (len(raw), removed, n, last)):
                    held.append(x)
            cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], "n_bytes", "n_removed", "n_spans", "last"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with repeated bytes removed from ``text``; the first copy of each string stays.

    Adds ``n_bytes`` (UTF-8 bytes before), ``n_removed``, ``n_spans`` (maximal removed runs) and, with
    ``digest``, ``kept_sha256`` of the remaining bytes, the text staying as it was. A character of which
    bytes remain only in part is dropped from the text. Null texts count as empty and stay null; columns
    of these names are replaced; all others and repeated rows are kept. Equal rows count as one document;
    different texts of one key are documents of their own, in the order of a hash of the text.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "__spans", "__base", "__key", "__hash")
    based = with_bases(docs, key, text)
    place = F.struct((F.col("at") - F.shiftleft(F.shiftright("at", 32), 32)).alias("at"), "n")
    spans = repeated_spans(based, key, text).groupBy("doc", F.shiftleft(F.shiftright("at", 32), 32).alias("base"))
    spans = spans.agg(F.collect_list(place).alias("__spans"))  # as many as a text has
    joined = based.join(spans, (based[key].cast("long") == spans["doc"]) & (based["__base"] == spans["base"]), "left").select(*[based[c] for c in docs.columns], "__spans")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    done = joined.mapInArrow(_apply(digest, docs.columns.index(text)), ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long, last string"]))
    if digest:
        return done.withColumnRenamed("last", "kept_sha256")
    return done.withColumn(text, F.col("last")).drop("last")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats in all ``documents``; nulls, repeated rows and shared keys as ``remove_repeats`` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text"), digest=True).drop("text")
