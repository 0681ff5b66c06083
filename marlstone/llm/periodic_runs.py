"""Runs of words that repeat with a period, found by counting matches at every lag.

The words of a text that stand ``q`` apart and are identical are its matches at lag ``q``. Rare words give
theirs by the differences of their pairs of places; frequent ones, of which pairs are many, by an exact
autocorrelation of their places with a fast Fourier transform. A run of period ``q`` needs a number of matches
at lag ``q``, so only lags with that many are scanned for islands of consecutive matches, over the whole text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from marlstone.llm.shared import with_fields
from marlstone.llm.tokenize import text_slices
from marlstone.llm.words import coded, flat, spans
from marlstone.llm.worker import only

LEAST_WORDS, LEAST_REPEATS = 6, 4
WORD = r"([^\x20\x09-\x0D]+)"
PAIRS = 1 << 21
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False
RUN = StructType().add("start", "long").add("length", "long").add("period", "long")
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def least_length(period: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_WORDS, LEAST_REPEATS * period)


def heavy_from(words: np.ndarray) -> np.ndarray:
    """The count of a word, in a text of so many, from which its pairs cost more than a transform."""
    return np.maximum(8.0, np.sqrt(words * np.log2(words + 2.0)))


def _pairs(place: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, lag) of all pairs of one word, about ``PAIRS`` at once: the element at an index with each of the ``rank`` before it."""
    total = np.cumsum(rank)
    at = 0
    while at < rank.size:
        done = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        r = rank[at:end]
        j = np.repeat(np.arange(at, end), r)
        back = np.arange(j.size) - np.repeat(total[at:end] - r - done, r) + 1
        yield j, place[j] - place[j - back]
        at = end


def lag_matches(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matches of each text at lags 0 to a quarter of its words, and where each text's counts begin.

    ``words`` holds the numbers of the words of all texts, text ``i`` from ``off[i]`` to ``off[i + 1]``.
    """
    n = np.diff(off)
    base = np.concatenate([[0], np.cumsum(n // LEAST_REPEATS + 1)])
    matches = np.zeros(base[-1], np.int64)
    if not words.size:
        return matches, base
    text = np.repeat(np.arange(n.size), n)
    order = np.argsort(text * (words.max() + 1) + words, kind="stable")
    place, text, word = order - off[:-1][text[order]], text[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])]))
    count = np.diff(np.concatenate([first, [place.size]]))
    heavy = count > heavy_from(n)[text[first]]

    rank = np.arange(place.size) - np.repeat(first, count)
    rank[np.repeat(heavy, count)] = 0
    for j, lag in _pairs(place, rank):
        near = lag <= n[text[j]] // LEAST_REPEATS
        matches += np.bincount(base[text[j[near]]] + lag[near], minlength=matches.size)

    of = text[first[heavy]]
    for t in np.unique(of).tolist():
        size = 1 << int(2 * n[t] - 1).bit_length()
        power = np.zeros(size // 2 + 1)
        for g in np.flatnonzero(heavy)[of == t].tolist():
            line = np.zeros(size)
            line[place[first[g] : first[g] + count[g]]] = 1
            f = np.fft.rfft(line)
            power += f.real**2 + f.imag**2
        lags = base[t + 1] - base[t]
        matches[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, size)[:lags]).astype(np.int64)
    return matches, base


def islands(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches with this period, long enough for a run."""
    same = np.concatenate([[0], (words[period:] == words[:-period]).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(same))
    begin, end = edge[::2], edge[1::2] + period
    fine = end - begin >= least_length(period)
    return begin[fine], end[fine]


def runs_of(words: np.ndarray, periods: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period, given the periods that may have some."""
    found: dict[int, tuple[list[int], list[int]]] = {}
    for q in sorted(periods):
        begin, end = islands(words, q)
        own: tuple[list[int], list[int]] = ([], [])
        parts = [d for d in found if q % d == 0]
        for b, e in zip(begin.tolist(), end.tolist()):
            # A stretch with a smaller period lies in a run of that period, which divides q.
            for d in parts:
                k = bisect_right(found[d][0], b)
                if k and found[d][1][k - 1] >= e:
                    break
            else:
                own[0].append(b)
                own[1].append(e)
        if own[0]:
            found[q] = own
    return sorted((b, e - b, q) for q, (bs, es) in found.items() for b, e in zip(bs, es))


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _texts(texts: pa.Array) -> tuple[list, list, list]:
    """Number of words, runs and collapsed text of each text."""
    data, off = flat(texts)
    begin, end = spans(_INSIDE[data], off)
    words, vocabulary = coded(data, begin, end)
    vocabulary = vocabulary.cast(pa.string()).to_pylist()
    at = np.searchsorted(begin, off)
    matches, base = lag_matches(words, at)
    which = np.repeat(np.arange(base.size - 1), np.diff(base))
    lag = np.arange(matches.size) - base[which]
    enough = np.flatnonzero((lag > 0) & (matches >= least_length(lag) - lag))
    periods: dict[int, list[int]] = {}
    for t, q in zip(which[enough].tolist(), lag[enough].tolist()):
        periods.setdefault(t, []).append(q)
    runs, collapsed = [], []
    for t in range(len(texts)):
        own = words[at[t] : at[t + 1]]
        got = runs_of(own, periods[t]) if t in periods else []
        if got:
            change = np.zeros(own.size + 1, np.int64)
            start, length, period = np.array(got).T
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            own = own[np.cumsum(change)[:-1] == 0]
        runs.append(got)
        collapsed.append(" ".join(map(vocabulary.__getitem__, own.tolist())))
    return np.diff(at).tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The periodic runs of the words ``[^\\x20\\x09-\\x0D]+`` of every text.

    A run is a stretch of consecutive words, numbered from 0, with the smallest period ``q`` and at least
    ``max(6, 4 * q)`` words, that no neighbouring word extends keeping that period. Returns one row per row: the
    key, ``n_words``, ``runs`` (start, length, period; by start, then period), ``strongest`` (the run with the greatest
    length for its period, ties to the smallest start, then period; null without runs) and ``collapsed`` (the
    words joined by one space, without those that a run contains after its first ``q`` words).

    A null text has no words; null and repeated keys are rows like others; an empty table gives no rows; other
    columns are ignored. A text is held whole by a task, in arrays of some 100 bytes for each of its words.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in batches:
            for part in text_slices(batch, 1):
                n, runs, collapsed = _texts(part.column(1))
                named = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
                best = [dict(zip(("start", "length", "period"), _strongest(x))) if x else None for x in runs]
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(named, RUNS), pa.array(best, RUNS.value_type), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "n_words", "runs", "strongest", "collapsed"])

    schema = with_fields(rows.select("key"), n_words="long", runs=ArrayType(RUN), strongest=RUN, collapsed="string")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten its words with a tail that repeats, by a checksum of the id; null ids are left."""
    words = F.regexp_extract_all(text, F.lit(WORD), 1)
    check = F.crc32(doc_id.cast("string").cast("binary"))
    n = F.size(words).cast("long")
    step = F.floor(check / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = step % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + step % 8))
        index = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(index, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    tail = F.element_at(F.transform(F.array(words), repeated), 1)
    return F.when((check % 10 == 0) & (n > 0), tail).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the words of all ``documents``, digested; nulls, repeated rows and empty texts as ``periodic_runs`` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.floor(F.lit(1000) * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32} AS h FROM documents),
a AS (SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turned, h // 10 AS g, (h // 10) % GREATEST(len(w), 1) AS a FROM d),
w AS (
  SELECT rid, doc_id, n, CASE WHEN turned THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
x AS (SELECT rid, n, UNNEST(w) AS word, UNNEST(range(n)) AS i FROM w),
m AS (SELECT x.rid, y.i - x.i AS q, x.i FROM x JOIN x y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM m),
s AS (SELECT rid, q, MIN(i) AS b, COUNT(*) + q AS n FROM k GROUP BY rid, q, k HAVING COUNT(*) + q >= GREATEST(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.rid = s.rid AND t.q < s.q AND s.q % t.q = 0 AND t.b <= s.b AND t.b + t.n >= s.b + s.n)),
f AS (
  SELECT rid, COUNT(*) AS n_runs, string_agg(b || ',' || n || ',' || q || chr(10), '' ORDER BY b, q) AS listed,
    FIRST({{'b': b, 'n': n, 'q': q}} ORDER BY CAST(n AS DOUBLE) / q DESC, b, q) AS best FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, UNNEST(range(b + q, b + n)) AS i FROM r),
c AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS words FROM x ANTI JOIN gone USING (rid, i) GROUP BY x.rid)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, best.b AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
  sha256(COALESCE(listed, '')) AS runs_sha256, sha256(COALESCE(words, '')) AS collapsed_sha256
FROM w LEFT JOIN f USING (rid) LEFT JOIN c USING (rid)"""
