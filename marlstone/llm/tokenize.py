"""Fast whole-text encoding with a byte-level BPE file of the ``tokenizers`` library.

The library spends most of its time on words it has met before. Byte-level BPE never merges across the
boundaries of its pre-tokenizer, and most of these boundaries can be told from two adjacent ASCII characters:
white space ends a pre-token, a run of it gives up its last character, a space belongs to what follows, and
letters, digits and signs do not mix. So a text is the concatenation of independently encoded chunks, which
are cut in numpy over many texts at once, made distinct by Arrow, and gathered from the ids of the chunks that
this worker has met; only new ones reach the library, many in one call.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlstone.llm.worker import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Characters whose class does not depend on a Unicode version, none of them white space but ASCII's; a text
# with others is encoded by the library as a whole.
UNCOMMON = r"[^\t\n\r -~\x{A1}-\x{24F}\x{391}-\x{3C9}\x{410}-\x{44F}\x{2010}-\x{2027}\x{20AC}]"
SLICE_BYTES = 2 << 20
CACHE_BYTES = 96 << 20
LONGEST_KEPT = 64
_OTHER, _BLANK, _LINE, _LETTER, _DIGIT, _SIGN, _QUOTE = range(7)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[33:127] = _SIGN
    for i in range(128):
        if chr(i).isalnum():
            kind[i] = _DIGIT if chr(i).isdigit() else _LETTER
    kind[[32, 39]] = _BLANK, _QUOTE
    kind[[9, 10, 13]] = _LINE
    return kind


def _boundaries() -> np.ndarray:
    """Whether a boundary lies between two adjacent characters, by their classes; bytes beyond ASCII tell nothing."""
    cut = np.zeros((7, 7), bool)
    white, word = (_BLANK, _LINE), (_LETTER, _DIGIT)
    for a in range(7):
        for b in range(7):
            if b in white:
                cut[a, b] = a not in white
            else:
                # A quotation mark may begin a contraction, so nothing is cut behind one.
                cut[a, b] = a == _LINE or a in word and b in (*word, _SIGN, _QUOTE) and a != b or a == _SIGN and b in word
    return cut.ravel()


_CLASS, _CUT = _classes(), _boundaries()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes in a column of texts, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


class Encoder:
    """Encodes texts to ids; ``cache`` bounds the bytes of kept chunks and of their ids, counted with their objects."""

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.line_end = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        # The empty chunk, which stands for the end of a text, always has slot 0 and no ids.
        self.index: dict[bytes, int] = {b"": 0}
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.entries, self.used, self.held = 1, 0, 0

    def _library(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def _lines(self, chunks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of chunks without line ends and the number of each one's, many of them joined to a line for the library.

        A line that does not come back with one line end between each two chunks is encoded chunk by chunk.
        """
        ids, sizes = [], []
        for i in range(0, len(chunks), 4096):
            lines = [chunks[j : min(j + 256, i + 4096)] for j in range(i, min(i + 4096, len(chunks)), 256)]
            for line, got in zip(lines, self._library([b"\n".join(x) for x in lines])):
                ends = got == self.line_end
                if np.count_nonzero(ends) == len(line) - 1:
                    ids.append(got[~ends])
                    sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(ends), [got.size]])) - 1)
                else:
                    each = self._library(line)
                    ids.extend(each)
                    sizes.append(np.array([x.size for x in each], np.int64))
        size = np.concatenate(sizes)
        if size.size != len(chunks) or int(size.sum()) != sum(x.size for x in ids):
            raise ValueError(f"{size.size} sizes of {len(chunks)} chunks")
        return ids, size

    def _add(self, ids: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """Slots of further entries; without keys they are forgotten when ``entries`` and ``used`` are set back."""
        n, m = self.entries + size.size, self.used + int(size.sum())
        if n > self.start.size:
            self.start, self.size = (np.concatenate([a, np.zeros(max(a.size, n - a.size), a.dtype)]) for a in (self.start, self.size))
        if m > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros(max(self.flat.size, m - self.flat.size), np.uint32)])
        self.start[self.entries : n] = self.used + np.cumsum(size) - size
        self.size[self.entries : n] = size
        if ids:
            np.concatenate(ids, out=self.flat[self.used : m])
        slots = np.arange(self.entries, n)
        self.entries, self.used = n, m
        return slots

    def _slots(self, chunks: list[bytes], odd: set[int]) -> tuple[np.ndarray, tuple[int, int]]:
        """The slot of each distinct chunk, and (entries, used) without those that are not kept."""
        slot = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(slot < 0).tolist()
        back = self.entries, self.used
        short, alone = [], []
        for i in new:
            c = chunks[i]
            (alone if len(c) > LONGEST_KEPT or i in odd or c.isspace() else short).append(i)
        if short:
            ids, size = self._lines([chunks[i] for i in short])
            slot[short] = self._add(ids, size)
            self.index.update(zip((chunks[i] for i in short), slot[short].tolist()))
            self.held += 160 * len(short) + sum(map(len, map(chunks.__getitem__, short))) + 4 * int(size.sum())
            back = self.entries, self.used
        for i in range(0, len(alone), 1024):
            ids = self._library([chunks[j] for j in alone[i : i + 1024]])
            slot[alone[i : i + 1024]] = self._add(ids, np.array([x.size for x in ids], np.int64))
        return slot, back

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of an array of texts, ``add_special_tokens=False``, and the number of each text's.

        Null counts as empty; ``end`` is appended to each text.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, offsets, raw = texts.buffers()
        off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
        off = off.astype(np.int64) - off[0]
        odd = pc.match_substring_regex(texts, UNCOMMON)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd_texts = np.flatnonzero(odd.to_numpy(zero_copy_only=False))

        kind = _CLASS[data]
        cut = np.zeros(data.size, bool)
        np.take(_CUT, kind[:-1] * np.uint8(7) + kind[1:], out=cut[1:])
        white = (kind == _BLANK) | (kind == _LINE)
        last = white[1:-1] & white[:-2] & ~white[2:]  # the last of a run
        ends = off[1:][np.diff(off) > 0]
        last[ends[(ends > 1) & (ends < data.size)] - 2] = False  # a run that ends its text stays whole
        cut[1:-1] |= last
        for i in odd_texts.tolist():
            cut[off[i] : off[i + 1]] = False
        cut[off[:-1][np.diff(off) > 0]] = True
        # After the chunks of each text comes an empty chunk that stands for its end.
        begin = np.flatnonzero(cut)
        place = np.searchsorted(begin, off[1:])
        stops = place + np.arange(n)
        begin = np.append(np.insert(begin, place, off[1:]), off[-1]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), begin.size - 1, [None, pa.py_buffer(begin), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        which = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        first = np.concatenate([[0], stops[:-1] + 1])
        slot, back = self._slots(distinct, set(which[first[odd_texts]].tolist()) if odd_texts.size else set())
        slot = slot[which]
        size = self.size[slot].astype(np.int64)
        start = self.start[slot]
        if end is not None:  # one id at the end of what is held
            tail = self._add([np.array([end], np.uint32)], np.ones(1, np.int64))
            size[stops], start[stops] = 1, self.start[tail[0]]
        else:
            size[stops] = 0
        total = np.cumsum(size)
        out = self.flat[np.repeat(start - (total - size), size) + np.arange(total[-1])]
        self.entries, self.used = back
        if self.held > self.cache:
            self._clear()
        return out, np.diff(np.concatenate([[0], total[stops]]))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        ids, size = self.encode(pa.array(texts, pa.string()))
        at = np.cumsum(size)
        return [ids[z - n : z].astype("<u4").tobytes() for z, n in zip(at.tolist(), size.tolist())]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for ``path``."""
    return kept("encoder", path, lambda: Encoder(path))
