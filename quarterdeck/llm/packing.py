"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed to the smallest context tier that holds them; longer ones fill windows of the longest tier and
route their rest. Each tier packs its documents whole, largest first; the gap of a long window is filled with whole
documents of the shorter tiers, and what then remains of it takes the beginning of one more document, whose rest is
routed anew. So windows are full; only the last of a partition is padded. Sequences are dealt to step groups of equal
token counts, each of one window length; windows of the shorter tiers that are too few for a group at a partition's end
are joined to longer ones, so only its last group, of the longest windows, can be short.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.token_files import tokenizer
from quarterdeck.llm.tokens import crc32

#: Window lengths, powers of two.
TIERS = (256, 512, 1024, 2048)
#: Documents are packed together in blocks of about so many tokens, which bounds a task's memory.
BLOCK_TOKENS = 2_000_000
#: Tokens of a step group: eight of the longest windows, sixteen of the next, and so on.
STEP_TOKENS = 8 * TIERS[-1]

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window long, step_group long"
)


class _Pieces:
    """Pieces (length, document, start) that wait in one tier, by length: a tier has at most as many lengths as tokens, so
    taking one costs the same however many wait."""

    def __init__(self):
        self.of_length: dict[int, list[tuple[int, int, int]]] = {}
        self.lengths: list[int] = []  # those that wait, ascending

    def add(self, piece: tuple[int, int, int]) -> None:
        same = self.of_length.setdefault(piece[0], [])
        if not same:
            insort(self.lengths, piece[0])
        same.append(piece)

    def _take(self, at: int) -> tuple[int, int, int]:
        same = self.of_length[self.lengths[at]]
        piece = same.pop()
        if not same:
            del self.lengths[at]
        return piece

    def largest(self, room: int) -> tuple[int, int, int] | None:
        """Takes the largest piece of room tokens at most."""
        at = bisect_right(self.lengths, room)
        return self._take(at - 1) if at else None

    def smallest(self, least: int) -> tuple[int, int, int] | None:
        """Takes the smallest piece of least tokens at least."""
        at = bisect_left(self.lengths, least)
        return self._take(at) if at < len(self.lengths) else None

    def all(self) -> list[tuple[int, int, int]]:
        return [piece for n in reversed(self.lengths) for piece in self.of_length[n]]


def pack_block(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list]], list]:
    """Full windows as (window, [(length, document, start)]), and the pieces that no window could be filled from.

    pieces: (length, document, start), of any length. The rest has fewer tokens than the longest window.
    """
    windows: list[tuple[int, list]] = []
    top = tiers[-1]
    waiting = {t: _Pieces() for t in tiers}
    amount = dict.fromkeys(tiers, 0)

    def route(length: int, doc: int, start: int) -> None:
        while length >= top:
            windows.append((top, [(top, doc, start)]))
            length, start = length - top, start + top
        if length:
            tier = next(t for t in tiers if t >= length)
            waiting[tier].add((length, doc, start))
            amount[tier] += length

    for piece in pieces:
        route(*piece)
    for at in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[at], tiers[: at + 1][::-1]
        while amount[tier] and sum(amount[t] for t in below) >= tier:
            window, room = [], tier
            for source in below:  # own documents first, then the gap from shorter tiers
                while room and (piece := waiting[source].largest(room)):
                    window.append(piece)
                    amount[source] -= piece[0]
                    room -= piece[0]
            if room:  # nothing whole fits any more: cut the smallest that waits
                source = next(t for t in below[::-1] if waiting[t].lengths)
                length, doc, start = waiting[source].smallest(1)
                amount[source] -= length
                window.append((room, doc, start))
                rest = next(t for t in tiers if t >= length - room)
                waiting[rest].add((length - room, doc, start + room))
                amount[rest] += length - room
            windows.append((tier, window))
    return windows, [piece for tier in tiers[::-1] for piece in waiting[tier].all()]


def joined_up(windows: dict[int, list[list]], tiers: tuple[int, ...]) -> tuple[list[list], list]:
    """Full windows (lists of pieces) of a few of each tier as windows of the longest, and the pieces of those left over,
    which are fewer tokens than one such window: two windows of a tier make one of the next."""
    carried: list[list] = []
    left: list = []
    for tier, longer in zip(tiers, tiers[1:]):
        mine, per = carried + windows.get(tier, []), longer // tier
        whole = len(mine) // per * per
        carried = [[piece for w in mine[k : k + per] for piece in w] for k in range(0, whole, per)]
        left += [piece for w in mine[whole:] for piece in w]
    return windows.get(tiers[-1], []) + carried, left


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    spaced: bool = False,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    Reads doc_id and text of each row (null text: empty, so the end id alone; null doc_id stays null; equal rows are
    packed one by one). Each partition packs what it has, in bounded blocks, and carries what fills no window over to
    its next block; nothing is shuffled, and a lost task packs again from its input. window is what a sequence is padded
    to: full windows of any tier need none, and the only padded sequence of a partition is its last, to the longest. All step
    groups have step_tokens but a partition's last.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, prefix = tokenizer(vocabulary, spaced), TaskContext.get().partitionId() << 40
        made = groups = 0
        waiting: dict[int, list[list]] = {t: [] for t in tiers}  # full windows whose step group is not yet full
        held: list[tuple] = []  # (doc_id, tokens, ids) of the block's documents
        carried: list[tuple[int, int, int]] = []
        tokens = 0

        def read(piece: tuple[int, int, int]) -> tuple[int, int, int, int, int]:
            length, doc, start = piece
            doc_id, total, ids, base = held[doc]
            return doc_id, start, length, crc32(ids[start - base : start - base + length]), total

        def emit(parts: list[tuple[int, list[list]]]) -> Iterator[pa.RecordBatch]:
            """Step groups, each of windows of one length."""
            nonlocal made, groups
            columns: list[list] = [[] for _ in range(9)]
            for window, group in parts:
                for pieces in group:
                    offset = 0
                    for doc_id, start, length, crc, total in pieces:
                        row = (doc_id, start, length, crc, total, prefix + made, offset, window, prefix + groups)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                        offset += length
                    made += 1
                groups += 1
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def full_groups(windows: list[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
            parts = []
            for window, pieces in windows:
                waiting[window].append([read(p) for p in pieces])
                if len(waiting[window]) * window >= step_tokens:
                    parts.append((window, waiting[window]))
                    waiting[window] = []
            if parts:
                yield from emit(parts)

        def last_groups() -> Iterator[pa.RecordBatch]:
            """What is left of the partition: longest windows, the last of them padded."""
            top = tiers[-1]
            windows, last = joined_up(waiting, tiers)
            room = top - sum(p[2] for p in last)
            for length, doc, start in carried:
                while length:
                    part = min(length, room)
                    last.append(read((part, doc, start)))
                    length, start, room = length - part, start + part, room - part
                    if not room:
                        windows.append(last)
                        last, room = [], top
            if last:
                windows.append(last)
            size = max(step_tokens // top, 1)
            if windows:
                yield from emit([(top, windows[k : k + size]) for k in range(0, len(windows), size)])

        def close_block() -> Iterator[pa.RecordBatch]:
            nonlocal held, carried, tokens
            windows, rest = pack_block(carried, tiers)
            yield from full_groups(windows)
            # only the ids that wait are kept on
            firsts: dict[int, int] = {}
            for _, doc, start in rest:
                firsts[doc] = min(start, firsts.get(doc, start))
            kept, moved = [], {}
            for doc, first in sorted(firsts.items()):
                doc_id, total, ids, base = held[doc]
                moved[doc] = len(kept)
                kept.append((doc_id, total, ids[first - base :].copy(), first))
            held, carried = kept, [(length, moved[doc], start) for length, doc, start in rest]
            tokens = sum(x[0] for x in carried)

        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                ids, counts = coder.encode(batch.column(1), end_id)
                stops = np.cumsum(counts).tolist()
                for doc_id, stop, count in zip(batch.column(0).to_pylist(), stops, counts.tolist(), strict=True):
                    held.append((doc_id, count, ids[stop - count : stop], 0))
                    carried.append((count, len(held) - 1, 0))
                    tokens += count
                    if tokens >= block_tokens:
                        yield from close_block()
        yield from close_block()
        yield from last_groups()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA)
