"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public model file. Where its scores are merge ranks (a BPE file), the log score
of the piece of rank r is that of Zipf's law, -log(r + 2); log scores of a unigram file are taken as they
are. A text gets one white-space marker in front, and each space becomes a marker. The best segmentation
has the largest sum of scores; of equal ones, the longest last piece wins. A character that is no piece
costs ``FALLBACK`` more than the worst piece and is written as its UTF-8 byte pieces. A marker that the
text itself holds is written as bytes too, so that decoding gives every text back.

No piece reaches over the start of a run of markers or over a character that occurs in no piece, so words
between them are segmented on their own; each worker keeps the ids of words that it has met.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import slices
from marlstone.llm.worker import kept

MARK = "▁"
_OWN_MARK = "\ud800"  # a marker of the text itself; it is in no piece and no valid text
FALLBACK = 10.0
CACHE = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """Trie of code sequences: the child of node s by code c is base[s] + c where check there is s."""

    def __init__(self, keys: list[tuple[int, ...]]):
        nodes: list[dict[int, int]] = [{}]
        value = [-1]
        for k, key in enumerate(keys):
            s = 0
            for c in key:
                if c not in nodes[s]:
                    nodes[s][c] = len(nodes)
                    nodes.append({})
                    value.append(-1)
                s = nodes[s][c]
            value[s] = k
        top = max((max(n) for n in nodes if n), default=0)
        size = len(nodes) + 2 * top + 2
        base, check, leaf = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        place = {0: 0}
        check[0] = 0
        low, queue = 1, [0]
        for s in queue:  # breadth first
            codes = np.array(sorted(nodes[s]), np.int64)
            at = place[s]
            leaf[at] = value[s]
            if not codes.size:
                continue
            while check[low] >= 0:
                low += 1
            free = low
            while True:
                b = free - codes[0]
                if b >= 0:
                    if b + codes[-1] >= check.size:
                        more = max(check.size // 2, int(b + codes[-1] + 1 - check.size))
                        base = np.concatenate([base, np.zeros(more, np.int64)])
                        check, leaf = (np.concatenate([a, np.full(more, -1, np.int64)]) for a in (check, leaf))
                    if (check[b + codes] < 0).all():
                        break
                free += 1
                while free < check.size and check[free] >= 0:
                    free += 1
            base[at] = b
            check[b + codes] = at
            for c in codes.tolist():
                place[nodes[s][c]] = b + c
                queue.append(nodes[s][c])
        pad = np.full(top + 1, -1, np.int64)
        self.base, self.check, self.leaf = np.concatenate([base, pad * 0]), np.concatenate([check, pad]), np.concatenate([leaf, pad])


class PieceModel:
    """Pieces, their log scores and the double array; small enough to be built by every worker."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(text[i][1:-1], 16)] = i
        usual = [i for i in range(n) if text[i] and not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = np.array([sp.get_score(i) for i in usual])
        ranks = raw.size > 1 and (raw == np.round(raw)).all()
        self._build([text[i] for i in usual], np.array(usual), -np.log(np.argsort(np.argsort(-raw, kind="stable"), kind="stable") + 2.0) if ranks else raw, n, text)

    def _build(self, pieces: list[str], ids: np.ndarray, score: np.ndarray, n: int, text: list[str]) -> None:
        self.pieces, self.ids, self.score = pieces, ids, score
        chars = sorted({c for p in pieces for c in p})
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        self.longest = max(map(len, pieces), default=1)
        self.trie = DoubleArray([tuple(self.code[c] for c in p) for p in pieces])
        self.unknown = float(score.min()) - FALLBACK if score.size else -FALLBACK
        whole = any(MARK in p.lstrip(MARK) for p in pieces)
        line = "" if "\n" in self.code else "\n"
        self.words = re.compile(r"(?s).+" if whole else f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else "")).findall
        lookup = np.zeros(0x110000, np.int32)
        lookup[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.lookup = lookup
        self.bytes = [b""] * n
        for i in range(n):
            self.bytes[i] = text[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_id.tolist()):
            if i >= 0:
                self.bytes[i] = bytes([b])
        self.cache: dict[str, bytes] = {}

    def _fallback(self, char: str) -> list[int]:
        return self.byte_id[list((MARK if char == _OWN_MARK else char).encode("utf-8", "replace"))].tolist()

    def segment(self, words: list[str]) -> list[bytes]:
        """The ids of each (non-empty) word as little-endian uint32; all words advance together."""
        joined = "".join(words)
        length = np.array([len(w) for w in words], np.int64)
        c = self.lookup[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        first = np.cumsum(length) - length
        of = np.repeat(np.arange(length.size), length)
        left = np.repeat(first + length, length) - np.arange(c.size)
        # Edges: every piece that starts at every character, found by one step of all walks at a time.
        t, at, node = self.trie, np.arange(c.size), np.zeros(c.size, np.int64)
        starts, sizes, leaves = [], [], []
        single = np.zeros(c.size, bool)
        for d in range(self.longest):
            ok = left[at] > d
            at, node = at[ok], node[ok]
            nxt = t.base[node] + c[at + d]
            ok = (c[at + d] > 0) & (t.check[nxt] == node)
            at, node = at[ok], nxt[ok]
            hit = t.leaf[node] >= 0
            starts.append(at[hit])
            sizes.append(np.full(int(hit.sum()), d + 1))
            leaves.append(t.leaf[node[hit]])
            if d == 0:
                single[at[hit]] = True
        lone = np.flatnonzero(~single)
        start = np.concatenate([*starts, lone])
        size = np.concatenate([*sizes, np.ones(lone.size, np.int64)])
        leaf = np.concatenate([*leaves, np.full(lone.size, -1)])
        score = np.where(leaf >= 0, self.score[leaf] if self.score.size else 0.0, self.unknown)
        # Viterbi, by the place within the word where an edge ends.
        w = of[start]
        stop = start - first[w] + size
        order = np.lexsort((start, w, stop))
        start, size, leaf, score, w, stop = (a[order] for a in (start, size, leaf, score, w, stop))
        cell = start + w  # position 0 of every word has a cell of its own
        best, edge = np.zeros(c.size + length.size), np.zeros(c.size + length.size, np.int64)
        bounds = np.searchsorted(stop, np.arange(1, int(length.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if lo == hi:
                continue
            total = best[cell[lo:hi]] + score[lo:hi]
            head = np.flatnonzero(np.concatenate([[True], w[lo + 1 : hi] != w[lo : hi - 1]]))
            most = np.maximum.reduceat(total, head)
            group = np.repeat(np.arange(head.size), np.diff(np.append(head, hi - lo)))
            won = np.flatnonzero(total == most[group])
            won = won[np.concatenate([[True], group[won[1:]] != group[won[:-1]]])]  # the smallest start
            target = cell[lo + won] + size[lo + won]
            best[target], edge[target] = most, lo + won
        # Back from the ends, one piece of every word at a time.
        here, word = first + np.arange(length.size) + length, np.arange(length.size)
        base = first + np.arange(length.size)
        got_word, got_start, got_leaf = [], [], []
        while here.size:
            e = edge[here]
            got_word.append(word)
            got_start.append(start[e])
            got_leaf.append(leaf[e])
            here = here - size[e]
            more = here > base[word]
            here, word = here[more], word[more]
        ww, ss, ll = np.concatenate(got_word), np.concatenate(got_start), np.concatenate(got_leaf)
        order = np.argsort(ss)
        ww, ss, ll = ww[order], ss[order], ll[order]
        out = self.ids[np.maximum(ll, 0)].astype("<u4") if self.ids.size else np.zeros(ll.size, "<u4")
        ends = np.cumsum(np.bincount(ww, minlength=length.size))
        unknown = np.flatnonzero(ll < 0)
        if unknown.size:
            spelt = [self._fallback(joined[i]) for i in ss[unknown].tolist()]
            n = np.ones(ll.size, np.int64)
            n[unknown] = [len(x) for x in spelt]
            out = np.repeat(out, n)
            places = np.cumsum(n) - n
            out[np.concatenate([p + np.arange(len(x)) for p, x in zip(places[unknown].tolist(), spelt)])] = np.concatenate(spelt)
            ends = np.cumsum(n)[ends - 1]
        raw, ends = out.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every whole text; null and empty texts have none."""
        split = [self.words(MARK + t.replace(MARK, _OWN_MARK).replace(" ", MARK)) if t else [] for t in texts]
        new = list({w for s in split for w in s}.difference(self.cache))
        for i in range(0, len(new), 20_000):
            self.cache.update(zip(new[i : i + 20_000], self.segment(new[i : i + 20_000])))
        get = self.cache.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        if len(self.cache) > CACHE:  # frequent words are met early, so the older half stays
            self.cache = dict(islice(self.cache.items(), CACHE // 2))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that ``encode`` gave; the marker put in front is taken off again."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def piece_model(path: str) -> PieceModel:
    """The model of this worker process for ``path``."""
    return kept("pieces", path, lambda: PieceModel(path))


def encode_pieces(docs: DataFrame, text: str = "text", path: str | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with the piece ids of every whole text.

    Adds ``n_pieces``, ``n_bytes`` (byte pieces among them) and ``decodes`` (decoding gives the text
    back), and either ``piece_ids`` or, with ``digest``, ``ids_crc32`` (unsigned, of the ids as
    little-endian uint32) in place of text and ids. Null texts count as empty and have no pieces.
    Columns of these names are replaced; all others, nulls and repeated rows are kept.
    """
    path = path or default_path()
    docs = docs.drop("n_pieces", "n_bytes", "decodes", "piece_ids", "ids_crc32")
    docs = docs.select(text, *[c for c in docs.columns if c != text])
    skip = 1 if digest else 0
    last = "ids_crc32" if digest else "piece_ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        is_byte = np.isin(np.arange(len(model.bytes)), model.byte_id[model.byte_id >= 0])
        for whole in batches:
            for b in slices(whole, 256):
                texts = [t or "" for t in b.column(0).to_pylist()]
                raw = model.encode(texts)
                ids = [np.frombuffer(x, "<u4") for x in raw]
                same = [model.decode(i) == t for i, t in zip(ids, texts)]
                tail = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))
                new = [pa.array([i.size for i in ids], pa.int64()), pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()), pa.array(same), tail]
                yield pa.RecordBatch.from_arrays([*b.columns[skip:], *new], [*b.schema.names[skip:], "n_pieces", "n_bytes", "decodes", last])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[skip:]]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_pieces long, n_bytes long, decodes boolean", f"{last} " + ("long" if digest else "array<long>")]))


def decode_pieces(rows: DataFrame, ids: str = "piece_ids", path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of the piece ids; null ids give null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def decoded(col):
        return col.map(lambda x: None if x is None else piece_model(path).decode(np.asarray(x, np.int64)))

    return rows.withColumn("decoded", decoded(F.col(ids)))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
