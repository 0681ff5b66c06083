"""Phrases whose words keep company, found by count-min sketches and one exact count of the phrases that these let through.

Texts are dealt into compressed chunks of a MiB of one language. First pass: each chunk counts its n-grams and adds them to
the cells of a count-min sketch of two rows. The sketch grows with the corpus, so that a cell holds few n-grams
whatever the size; it is cut into blocks, and the cells that chunks touch are sent to the task that merges a block.
Each chunk gets back one bit for each cell it touched: whether the cell reached the least count. A cell counts all
n-grams that fall into it, so no frequent one is lost. Second pass: the n-grams whose cells have all reached it are counted
exactly; few others are among them. Scores and subsumption need the exact counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import saved
from marlstone.llm.tokenize import text_slices
from marlstone.llm.words import coded, spans
from marlstone.llm.worker import only

LEAST, LONGEST, TOP, SUBSUMED = 10, 3, 2_000, 50
UNKNOWN = "und"
CHUNK_BYTES, HELD_BYTES = 1 << 20, 16 << 20
BLOCK_BITS, CELL_WORDS, TASK_WORDS = 20, 2, 8 << 20  # a cell of each row for so many words; words of a task of the second pass
HOT_SHARE = 100_000  # phrases with more than one in so many words are hot; no more than so many of each length can be
FOUND_ROWS, BUCKET_WORDS = 1_500_000, 1 << 20
RANK_SALTS = (512, 8, 1)
COUNT_LIMIT = 255
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 32, 10, 11, 12, 13, *b".,;:!?"]] = False
_BREAK = ~_INSIDE
_BREAK[[9, 32]] = False

CHUNKS = "lang string, chunk long, n long, skip int, text binary"
_CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("skip", pa.int32()), ("text", pa.binary())])


def cut(raw: bytes, limit: int, longest: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text of about ``limit`` bytes; each but the first repeats up to ``longest - 1`` words, whose number comes with it."""
    if len(raw) <= limit:
        yield 0, raw
        return
    begin, end = spans(_INSIDE[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
    first = skip = 0
    at = 0
    while len(raw) - at > limit:
        last = max(int(np.searchsorted(end, at + limit, side="right")), first + skip + 1)
        if last >= end.size:
            break
        yield skip, raw[at : int(end[last - 1])]
        first = max(0, last - longest + 1)
        at, skip = int(begin[first]) if first < last else int(end[last - 1]), last - first
    yield skip, raw[at:]


def _chunks(longest: int, limit: int):
    """Rows (lang, text) as chunks; texts of a chunk are divided by line ends, which no n-gram crosses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        task, made, compress = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=4).compress
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def chunk(lang: str, skip: int, raw: bytes) -> pa.RecordBatch:
            nonlocal made
            made += 1
            words = spans(_INSIDE[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))[0].size - skip
            packed = compress(raw)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((lang, task + made, words, skip, packed), _CHUNKS.types)], schema=_CHUNKS)

        for whole in batches:
            for b in text_slices(whole, 1):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
                    if not raw:
                        held.setdefault(lang, [])
                        size.setdefault(lang, 0)
                        continue
                    if len(raw) > limit:
                        for skip, part in cut(raw, limit, longest):
                            yield chunk(lang, skip, part)
                        continue
                    held.setdefault(lang, []).append(raw)
                    size[lang] = size.get(lang, 0) + len(raw) + 1
                    if size[lang] > limit:
                        yield chunk(lang, 0, b"\n".join(held.pop(lang)))
                        size.pop(lang)
                while sum(size.values()) > HELD_BYTES:
                    lang = max(size, key=size.get)
                    yield chunk(lang, 0, b"\n".join(held.pop(lang)))
                    size.pop(lang)
        for lang, parts in held.items():
            yield chunk(lang, 0, b"\n".join(parts))

    return run


class Grams:
    """The distinct n-grams of a chunk by length: the words of each (columns of numbers), its count and its hash."""

    def __init__(self, lang: str, raw: bytes, skip: int, longest: int):
        data = np.frombuffer(raw, np.uint8)
        begin, end = spans(_INSIDE[data], np.array([0, data.size]))
        words, self.vocabulary = coded(data, begin, end)
        piece = np.cumsum(_BREAK[data])[begin]
        kinds = max(1, len(self.vocabulary))
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        one = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary.to_pylist()], np.uint64)
        self.words, self.counts, hashes = [np.arange(len(one))[:, None]], [np.bincount(words[skip:], minlength=len(one))], [one]
        at = words  # the number of the n-gram that begins at each word
        for k in range(2, longest + 1):
            begins = np.flatnonzero(piece[: 1 - k] == piece[k - 1 :]) if piece.size >= k else np.zeros(0, np.int64)
            key, number = np.unique(at[begins] * kinds + words[begins + k - 1], return_inverse=True)
            self.counts.append(np.bincount(number[begins >= skip - k + 1], minlength=key.size))
            before, last = key // kinds, key % kinds
            self.words.append(np.concatenate([self.words[-1][before], last[:, None]], 1))
            hashes.append(_mixed(hashes[-1][before], one[last]))
            at = np.full(words.size, -1)
            at[begins] = number
        self.hash = np.concatenate(hashes)
        self.count = np.concatenate(self.counts)

    def cells(self, row: int, blocks: int) -> np.ndarray:
        """The cell of each n-gram in a row of the sketch: its block, then its place in the block."""
        x = self.hash * _ROWS[row]
        block = (x >> np.uint64(8) & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)
        return block << np.uint64(BLOCK_BITS) | x >> np.uint64(64 - BLOCK_BITS)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _pack(place: np.ndarray, count: np.ndarray) -> bytes:
    """Rising places below 2^24 as byte planes of their differences, and counts, compressed."""
    d = np.diff(place, prepend=np.uint64(0))
    planes = [(d >> np.uint64(s) & np.uint64(255)).astype(np.uint8) for s in (0, 8, 16)]
    return zstandard.compress(np.concatenate([*planes, count.astype(np.uint8)]).tobytes(), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, mid, high, count = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).astype(np.int64)
    return np.cumsum(low | mid << 8 | high << 16), count


def _unit(least: int) -> int:
    """Counts are kept in units, rounded up, so that the least count is at most ``COUNT_LIMIT`` of them."""
    return -(-least // COUNT_LIMIT)


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one at a time, for its texts are large."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _touched(longest: int, blocks: int, least: int):
    """Chunks as the cells that they touch: one row (block, chunk, cells) for each block of the sketch."""
    unit = _unit(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in batches:
            for lang, chunk, skip, raw in _each(batch):
                g = Grams(lang, zstandard.decompress(raw), skip, longest)
                count = np.minimum(-(-g.count // unit), COUNT_LIMIT).astype(np.uint64)
                for row in range(len(_ROWS)):
                    both = np.sort(g.cells(row, blocks) << np.uint64(8) | count)
                    cell = both >> np.uint64(8)
                    block = cell >> np.uint64(BLOCK_BITS)
                    edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [cell.size]]).tolist() if cell.size else [0]
                    place, packed = cell & np.uint64((1 << BLOCK_BITS) - 1), []
                    for a, z in zip(edge, edge[1:]):
                        packed.append(_pack(place[a:z], both[a:z] & np.uint64(255)))
                    if packed:
                        keys = block[edge[:-1]].astype(np.int64) + (row << 44)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(keys.size, chunk)), pa.array(packed, pa.binary())], ["block", "chunk", "cells"])

    return run


def _merged(least: int):
    """Rows (block, chunk, cells) in the order of blocks, answered by whether each cell reached the least count over all chunks."""
    goal = -(-least // _unit(least))

    def answer(block: int, chunks: list[int], raw: list[bytes]) -> pa.RecordBatch:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for r in raw:
            place, count = _unpack(r)
            np.add.at(total, place, count)
        bits = [np.packbits(total[_unpack(r)[0]] >= goal).tobytes() for r in raw]
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([block] * len(chunks), pa.int64()), pa.array(bits, pa.binary())], ["chunk", "block", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        now, chunks, raw = None, [], []
        for batch in batches:
            for block, chunk, cells in _each(batch):
                if block != now and chunks:
                    yield answer(now, chunks, raw)
                    chunks, raw = [], []
                now = block
                chunks.append(chunk)
                raw.append(cells)
        if chunks:
            yield answer(now, chunks, raw)

    return run


def _kept(g: Grams, blocks: int, answers: list[bytes]) -> np.ndarray:
    """Whether all cells of each n-gram reached the least count."""
    keep = g.count > 0
    given = iter(answers)
    for row in range(len(_ROWS)):
        cell = g.cells(row, blocks)
        order = np.argsort(cell)
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(cell[order] >> np.uint64(BLOCK_BITS))) + 1, [cell.size]])) if cell.size else []
        for at, n in zip(np.cumsum(sizes) - sizes, sizes):
            keep[order[at : at + n]] &= np.unpackbits(np.frombuffer(next(given), np.uint8), count=int(n)).astype(bool)
    return keep


def _phrases(g: Grams, keep: np.ndarray) -> pa.Table:
    vocabulary, at, out = g.vocabulary.cast(pa.string()), 0, []
    for k, (words, counts) in enumerate(zip(g.words, g.counts), 1):
        own = np.flatnonzero(keep[at : at + counts.size])
        parts = [vocabulary.take(pa.array(words[own, i])) for i in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        out.append(pa.table({"phrase": phrase, "hash": pa.array(g.hash[at + own]), "n": pa.array(counts[own].astype(np.int64))}))
        at += counts.size
    return pa.concat_tables(out)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["phrase", "hash"]).aggregate([("n", "sum")]).rename_columns(["phrase", "hash", "n"])


def _survivors(longest: int, blocks: int, buckets: int):
    """Each chunk followed by its answers, as the counts of its n-grams whose cells all reached the least count.

    The counts of a task's chunks are added up; rows (lang, bucket, phrases, counts) hold sorted phrases, compressed.
    """

    def emit(lang: str, found: pa.Table) -> pa.RecordBatch:
        found = found.sort_by("phrase")
        bucket = (found.column("hash").to_numpy() % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, first = np.unique(bucket[order], return_index=True)
        phrases, n, ends = found.column("phrase").combine_chunks(), found.column("n").to_numpy(), [*first[1:].tolist(), order.size]
        cols: list[list] = [[], []]
        for a, z in zip(first.tolist(), ends):
            cols[0].append(zstandard.compress("\n".join(phrases.take(pa.array(order[a:z])).to_pylist()).encode(), 9))
            cols[1].append(zstandard.compress(n[order[a:z]].astype("<i8").tobytes(), 3))
        return pa.RecordBatch.from_arrays([pa.array([lang] * keys.size, pa.string()), pa.array(keys), *(pa.array(c, pa.binary()) for c in cols)], ["lang", "bucket", "phrases", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        chunk, answers, held = None, [], {}

        def add() -> Iterator[pa.RecordBatch]:
            lang, raw, skip = chunk
            g = Grams(lang, zstandard.decompress(raw), skip, longest)
            tables = held.setdefault(lang, [])
            tables.append(_phrases(g, _kept(g, blocks, answers)))
            if sum(t.num_rows for x in held.values() for t in x) > FOUND_ROWS:
                for x in held.values():
                    x[:] = [_summed(x)]
                while 2 * sum(x[0].num_rows for x in held.values()) > FOUND_ROWS:
                    most = max(held, key=lambda x: held[x][0].num_rows)
                    yield emit(most, held.pop(most)[0])

        for batch in batches:
            for lang, skip, raw, given in _each(batch):
                if raw is None:
                    answers.append(given)
                    continue
                if chunk:
                    yield from add()
                chunk, answers = (lang, raw, skip), []
        if chunk:
            yield from add()
        for lang, tables in held.items():
            yield emit(lang, _summed(tables))

    return run


def _exact(least: int):
    """Rows (lang, bucket, phrases, counts) in the order of lang and bucket, added up to those found often enough."""

    def total(lang: str, tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).group_by("phrase").aggregate([("n", "sum")])
        t = t.filter(pc.greater_equal(t.column("n_sum"), least))
        phrase = t.column("phrase").combine_chunks()
        size = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([lang] * t.num_rows, pa.string()), size, phrase, t.column("n_sum").combine_chunks()], ["lang", "size", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        now, tables = None, []
        for batch in batches:
            for lang, bucket, phrases, counts in _each(batch):
                if (lang, bucket) != now and tables:
                    yield total(now[0], tables)
                    tables = []
                now, n = (lang, bucket), np.frombuffer(zstandard.decompress(counts), "<i8")
                if n.size:
                    tables.append(pa.table({"phrase": pa.array(zstandard.decompress(phrases).decode().split("\n"), pa.string()), "n": pa.array(n)}))
        if tables:
            yield total(now[0], tables)

    return run


def frequent(docs: DataFrame, least: int, longest: int, lang: str, text: str, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Exact counts ``f`` of all n-grams of up to ``longest`` words found ``least`` times (lang, size, phrase), and words ``n`` by lang."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    chunks = saved(rows.mapInArrow(_chunks(longest, chunk_bytes), CHUNKS), "chunks")
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks, buckets = max(1, -(-total // (CELL_WORDS << BLOCK_BITS))), max(64, -(-total // BUCKET_WORDS))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_WORDS))  # large tasks, so that the counts of many chunks are added up in each
    cells = chunks.select("lang", "chunk", "skip", "text").mapInArrow(_touched(longest, blocks, least), "block long, chunk long, cells binary")
    cells = cells.repartition("block").sortWithinPartitions("block", "chunk")
    answers = cells.mapInArrow(_merged(least), "chunk long, block long, bits binary")
    # The chunk comes before its answers, for its block is the least.
    each = chunks.select("chunk", F.lit(-1).cast("long").alias("block"), "lang", "skip", "text", F.lit(None).cast("binary").alias("bits"))
    given = answers.select("chunk", "block", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("skip"), F.lit(None).cast("binary").alias("text"), "bits")
    met = each.unionByName(given).repartition(tasks, "chunk").sortWithinPartitions("chunk", "block").select("lang", "skip", "text", "bits")
    found = met.mapInArrow(_survivors(longest, blocks, buckets), "lang string, bucket long, phrases binary, counts binary")
    found = found.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_exact(least), "lang string, size int, phrase string, f long")
    return saved(found, "counts"), chunks.groupBy("lang").agg(F.sum("n").alias("n"))


def _counted(rows: DataFrame, part, counts: DataFrame, hot: DataFrame, out: str) -> DataFrame:
    """``rows`` with the count of a part of their phrase; hot parts, which are few, do not take part in the shuffle."""
    few = F.broadcast(hot.select("lang", F.col("phrase").alias("part"), F.col("f").alias("few")))
    all_ = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias(out))
    met = rows.withColumn("part", part).join(few, ["lang", "part"], "left")
    done = met.filter("few IS NOT NULL").select(*rows.columns, F.col("few").alias(out))
    return done.unionByName(met.filter("few IS NULL").select(*rows.columns, "part").join(all_, ["lang", "part"]).select(*rows.columns, out))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsumed: int = SUBSUMED, lang: str = "lang", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into words.
    Phrases found ``least`` times within pieces are candidates. A cut divides a candidate into two parts with counts
    ``l`` and ``r``; its score is ``floor(1000000 * a * a / (l * r))`` for the candidate's count ``a``. The cut with the
    lowest score counts, ties to the shortest first part. Candidates that lie in a longer one with ``subsumed`` % of their
    count at least are dropped. Returns the first ``top`` of each language by score and count, both falling, then phrase
    (by bytes): ``lang``, ``rank`` from 1, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the language) and ``score``.

    Null texts are empty, a null language is ``und``; repeated rows count each; an empty table gives no rows; other
    columns are ignored. A long text is cut between words, and no phrase is lost at a cut. Counts up to 3e15 are exact.
    """
    counts, n = frequent(docs, least, longest, lang, text, chunk_bytes)
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.filter((F.col("size") < longest) & (F.col("f") * HOT_SHARE > total))  # fewer than HOT_SHARE of each length
    own = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    longer = own.filter("size > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = own.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * subsumed)).drop("longer")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    words = F.split("phrase", " ")
    cuts = _counted(cuts, F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), counts, hot, "l")
    cuts = _counted(cuts, F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " "), counts, hot, "r")
    exact = "CAST((CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS LONG)"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    best = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    for salts in RANK_SALTS:  # the best of parts of a language, then of fewer, so that no task sorts a whole one
        parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*best)
        scored = scored.withColumn("rank", F.row_number().over(parts).cast("long")).filter(F.col("rank") <= top)
    return scored.join(n, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of all ``documents``; nulls and repeated rows as ``collocations`` says."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, UNNEST(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT COALESCE(lang, 'und') AS lang, text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k))),
n AS (SELECT lang, COUNT(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, COUNT(*) AS f FROM g GROUP BY ALL HAVING COUNT(*) >= 10),
c AS (
  SELECT lang, phrase, f AS a, k AS size, UNNEST(range(1, k)) AS cut, w FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, 1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
b AS (SELECT lang, phrase, a, FIRST({'l': l, 'r': r, 'score': score} ORDER BY score, cut) AS b FROM s GROUP BY ALL),
o AS (SELECT lang, phrase, MAX(f) AS f FROM (SELECT lang, f, UNNEST([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM f WHERE k = 3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, CAST(b.score AS BIGINT) AS score FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""
