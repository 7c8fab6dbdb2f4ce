"""Token ids of whole texts, word by word from a bounded cache.

Both kinds of vocabulary cut a text at white space before any merge, so the ids of a text are the ids of its chunks in
order: words (white space separates only), or words with the white space before them (byte-level). Words repeat far more
often than texts do, so a worker keeps the ids of chunks it has met, by 64-bit hash in flat numpy arrays, and asks the
tokenizer for new ones only. The cache is bounded and starts afresh when full; results do not depend on its state.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa

from quarterdeck.llm.words import Run, runs

#: Chunks whose ids a worker remembers (about 40 bytes each).
CACHE_CHUNKS = 1_500_000

#: White space of the byte-level cutting pattern that is not a single byte in UTF-8, and U+001C to U+001F, which some
#: libraries count as white space. A text with any of them is handed over whole.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Letters of ASCII and Latin-1, then marks of ASCII other than the apostrophe.
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
_KEPT_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: How byte-level vocabularies spell bytes: those that print as themselves, the others by characters from U+0100 on.
_SPELT = "".join(chr(b if b in _KEPT_BYTES else 256 + sum(c not in _KEPT_BYTES for c in range(b))) for b in range(256))


class ChunkTokenizer:
    """Ids of texts. spaced: white space belongs to the word after it (byte-level), else it only separates words."""

    def __init__(self, path: str, spaced: bool, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced, self.cache_chunks = spaced, cache_chunks
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of one letter run or mark run: one merge unit of the vocabulary."""
        ids = self.pieces.get(text)
        if ids is None:
            if len(self.pieces) >= self.cache_chunks // 10:
                self.pieces.clear()
            if not text.isascii():
                spelt = text.encode().decode("latin-1").translate(_SPELT)
            else:  # letters and marks stand for themselves
                spelt = _SPELT[32] + text[1:] if text[0] == " " else text
            ids = self.pieces[text] = tuple([t.id for t in self.model.tokenize(spelt)])
        return ids

    def _chunk_ids(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Plain letters followed by plain marks go to the merges at once; anything else takes the whole tokenizer."""
        out: list = [None] * len(chunks)
        other = []
        for k, chunk in enumerate(chunks):
            plain = _PLAIN.fullmatch(chunk)
            if plain is None or "<|" in chunk:
                other.append(k)
                continue
            space, letters, marks = plain.groups()
            if self.spaced:
                if letters:
                    out[k] = self._piece(space + letters) + (self._piece(marks) if marks else ())
                elif marks:
                    out[k] = self._piece(space + marks)
                else:
                    other.append(k)
            else:
                out[k] = (self._piece(letters.lower()) if letters else ()) + (self._piece(marks) if marks else ())
        for k in range(0, len(other), 10_000):
            part = other[k : k + 10_000]
            coded = self.tokenizer.encode_batch([chunks[i] for i in part], add_special_tokens=False)
            for i, x in zip(part, coded, strict=True):
                out[i] = tuple(x.ids)
        return out

    def _learn(self, run: Run, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.cache_chunks:
            self.forget()
        data = run.data.tobytes()
        learnt = self._chunk_ids([data[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        size = np.fromiter(map(len, learnt), np.int32, len(learnt))
        ids = np.fromiter((i for x in learnt for i in x), np.uint32, int(size.sum()))
        begin = len(self.ids) + np.cumsum(size) - size
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.begin, self.size = np.insert(self.begin, where, begin), np.insert(self.size, where, size)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, each row's followed by end_id, as unsigned 32-bit values; ids of each row."""
        all_ids, all_counts = [], []
        for run in runs(column):
            rows = len(run.offsets) - 1
            start, end, row = run.start, run.end, run.row
            if self.spaced:
                start, end, row = self._with_space(run)
            if len(start):
                hashes = run.hashes(start, end)
                keys, first, code = np.unique(hashes, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
                new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
                if new.any():
                    before = self.keys
                    self._learn(run, keys[new], start[first[new]], end[first[new]])
                    if len(self.keys) < len(before) + new.sum():  # began afresh: the known ones are gone as well
                        old = ~new
                        self._learn(run, keys[old], start[first[old]], end[first[old]])
                at = np.searchsorted(self.keys, keys)
                begin, size = self.begin[at][code], self.size[at][code]
            else:
                begin, size = np.zeros(0, np.int64), np.zeros(0, np.int32)
            # the end of each row is one more chunk, whose id stands at the end of the store
            count = np.bincount(row, minlength=rows)
            last = np.cumsum(count)
            begin = np.insert(begin, last, len(self.ids))
            size = np.insert(size, last, 1).astype(np.int64)
            store = np.append(self.ids, np.uint32(end_id))
            stop = np.cumsum(size)
            ids = store[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
            counts = np.add.reduceat(size, np.concatenate([[0], last[:-1] + np.arange(1, rows)])) if rows else size
            if self.spaced:
                ids, counts = self._whole(run, column, ids, counts, end_id)
            all_ids.append(ids)
            all_counts.append(counts)
        if not all_ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(all_ids), np.concatenate(all_counts)

    def _with_space(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of a word and the white space before it; white space at a row's end is a chunk of its own."""
        count = run.counts()
        last = np.cumsum(count)
        first = last - count
        start = np.concatenate([[0], run.end[:-1]]) if len(run.end) else run.start
        some = count > 0
        start[first[some]] = run.offsets[:-1][some]
        left_at = run.offsets[:-1].copy()
        left_at[some] = run.end[last[some] - 1]
        tail = np.flatnonzero(run.offsets[1:] > left_at)
        at = last[tail]
        return (
            np.insert(start, at, left_at[tail]),
            np.insert(run.end, at, run.offsets[1:][tail]),
            np.insert(run.row, at, tail),
        )

    def _whole(self, run: Run, column: pa.Array, ids: np.ndarray, counts: np.ndarray, end_id: int):
        """Rows with wide white space, encoded as they are."""
        odd = [k for k in range(len(counts)) if (t := column[run.first + k].as_py()) and _WIDE_SPACE.search(t)]
        if not odd:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in odd:
            coded = self.tokenizer.encode(column[run.first + k].as_py(), add_special_tokens=False).ids
            parts[k] = np.array([*coded, end_id], np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
