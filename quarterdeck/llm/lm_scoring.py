"""Log-likelihood of whole documents under a small gated recurrent network, with counts of all training text.

A word's probability is factored: its class given all words before it, then the word given its class and all words before
it, both by a softmax of the network's state. The most frequent words are classes of their own; the others share classes by
their first and last two bytes, so a word never seen has a class too. Inside a class the frequent words have vectors of
their own; all further words of the class share one, and counts over all training documents with one added tell them apart.
The network is a GRU in numpy, trained by truncated backpropagation in all partitions at once, with weights averaged after
each round. Scoring carries the state from window to window, so a document is scored as a whole. Words are known by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.shared import written
from quarterdeck.llm.words import Run, mix, runs

#: Frequent words whose counts travel with the tasks; all others are joined.
HEAD_WORDS = 200_000
#: Classes: this many single words (the end of a text is the first), then so many by bytes.
SINGLE_CLASSES, SHAPE_CLASSES = 32, 64
CLASSES = SINGLE_CLASSES + SHAPE_CLASSES
#: So many of the words that follow in frequency have vectors inside their class, which has at most SLOTS - 1 of them; slot 0
#: is that of all its other words.
FREQUENT_WORDS, SLOTS = 1024, 32
#: Head words are looked up by so many leading bits of their hashes first.
PREFIX_BITS = 18
#: Inputs: so many single words, then so many by bytes.
SINGLE_INPUTS, SHAPE_INPUTS = 512, 256
HIDDEN = 16
#: Training documents are dealt to ROUNDS rounds; each trains the network once.
ROUNDS = 2
LANES, WINDOW, RATE = 256, 16, 0.02
#: Documents are laid in lanes in pools of about so many tokens (a few bytes each), so that beside a long one there are many lanes.
POOL_TOKENS = 2_000_000
SCORE_LANES, SCORE_WINDOW = 512, 64
#: Tokens whose softmax over the classes is taken at a time.
BLOCK = 1024
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def shapes(run: Run, some: np.ndarray | slice = slice(None)) -> np.ndarray:
    """64-bit hash of the first and last two bytes of each word, or of some."""
    data, first, last = run.data, run.start[some], run.end[some] - 1
    before = np.maximum(last - 1, first)
    return mix(_LOWER[data[first]] << np.uint64(16) | _LOWER[data[before]] << np.uint64(8) | _LOWER[data[last]])


@dataclass
class Vocabulary:
    """What all tasks know: the head words' hashes in ascending order, with ranks and counts, and the classes' totals."""

    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    class_log: np.ndarray  # log10(N_c + V_c + 1) of each class over its words without a vector; log10(c + 1) where it is one word
    class_share: np.ndarray
    total: int  # N
    distinct: int  # V
    ends: int  # count of the end token
    slots: np.ndarray | None = None  # of each head word in its class
    slot_log: np.ndarray | None = None  # logarithm of each slot's share of its class, by class

    @cached_property
    def _first(self) -> np.ndarray:
        """Position of the first hash with each value of the leading PREFIX_BITS bits, or of the next hash."""
        return np.searchsorted(self.hashes, np.arange(1 << PREFIX_BITS, dtype=np.uint64) << np.uint64(64 - PREFIX_BITS)).astype(np.int32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of head words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at, last = self._first[hashes >> np.uint64(64 - PREFIX_BITS)], len(self.hashes) - 1
        np.minimum(at, last, out=at)
        met = self.hashes[at]
        behind = np.flatnonzero(met < hashes)  # few words share their leading bits, so few steps remain
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            met[behind] = self.hashes[at[behind]]
            behind = behind[met[behind] < hashes[behind]]
        return np.where(met == hashes, at, -1)

    def tokens(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and slot (class + CLASSES * slot) and input of each word, and its head position."""
        at = self.place(run.words(lower=True))
        shape = shapes(run)
        rank = np.where(at >= 0, self.ranks[at] if len(self.ranks) else 0, HEAD_WORDS)
        kind = np.where(rank < SINGLE_CLASSES - 1, rank + 1, SINGLE_CLASSES + (shape % np.uint64(SHAPE_CLASSES)).astype(np.int64))
        if self.slots is not None and len(self.slots):
            kind += CLASSES * np.where(at >= 0, self.slots[at], 0)
        given = np.where(rank < SINGLE_INPUTS, rank, SINGLE_INPUTS + (mix(shape) % np.uint64(SHAPE_INPUTS)).astype(np.int64))
        return kind, given, at


class Network:
    """A GRU over inputs with a softmax over classes and one over the slots of each shape class. Arrays are in one flat vector, so that weights add up as rows."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        shape = {"E": (SINGLE_INPUTS + SHAPE_INPUTS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "W": (HIDDEN, CLASSES), "c": (CLASSES,),
                 "S": (SHAPE_CLASSES, HIDDEN, SLOTS), "d": (SHAPE_CLASSES, SLOTS)}
        for name, size in shape.items():
            setattr(self, name, flat[at : at + int(np.prod(size))].reshape(size))
            at += int(np.prod(size))
        self.size = at

    @staticmethod
    def fresh(class_share: np.ndarray, slot_log: np.ndarray | None = None) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(7))
        size = Network(np.zeros(1 << 20, np.float32)).size
        flat = (rng.standard_normal(size) * 0.1).astype(np.float32)
        net = Network(flat)
        net.b[:] = 0
        net.c[:] = np.log(class_share)
        net.d[:] = 0 if slot_log is None else slot_log
        return flat

    def states(self, given: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The state before each step of a window (HIDDEN + 1 by time by lane, the last row all ones), that after the window
        (HIDDEN by lane), and what the way back needs. Lanes come last, so that an operation runs over whole rows of them."""
        steps, width, n = *given.shape, HIDDEN
        table = self.E + self.b
        table[:, : 2 * n] *= -1  # 1 / (1 + exp(-v)), the sign taken once
        x = np.ascontiguousarray(np.take(table, given.ravel(), axis=0).reshape(steps, width, -1).transpose(0, 2, 1))
        gates, inner = -self.U[:, : 2 * n].T, np.ascontiguousarray(self.U[:, 2 * n :].T)
        kept = {k: np.empty((steps, n, width), x.dtype) for k in ("h", "rh", "m")}
        begins, goes_on = fresh.any(axis=1).tolist(), (~fresh).astype(x.dtype)
        h, zr_part, m_part = np.array(h, x.dtype, order="C"), np.empty((2 * n, width), x.dtype), np.empty((n, width), x.dtype)
        with np.errstate(over="ignore"):  # a gate of exactly 0
            for t in range(steps):
                h0, rh, m, zr = kept["h"][t], kept["rh"][t], kept["m"][t], x[t, : 2 * n]
                if begins[t]:
                    h *= goes_on[t]
                h0[:] = h
                zr += np.matmul(gates, h, out=zr_part)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[n:], h, out=rh)
                np.matmul(inner, rh, out=m_part)
                np.add(m_part, x[t, 2 * n :], out=m)
                np.tanh(m, out=m)
                np.subtract(m, h, out=m_part)
                m_part *= zr[:n]
                h += m_part
        before = np.ones((n + 1, steps, width), x.dtype)
        before[:n] = kept["h"].transpose(1, 0, 2)
        return before, h, (x[:, :n], x[:, n : 2 * n], kept)

    def class_weights(self) -> np.ndarray:
        """W and c as one matrix, for states with a last row of ones."""
        return np.concatenate([self.W, self.c[None]])

    def slot_weights(self) -> np.ndarray:
        """S and d as one matrix a class."""
        return np.concatenate([self.S, self.d[:, None]], axis=1)

    def inside(self, states: np.ndarray, classes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """For the tokens of shape classes: their positions by class, their states (token by HIDDEN + 1), the logits of the slots
        of their classes, and (class, first, last) of each class among them. weights: slot_weights()."""
        order = np.flatnonzero(classes >= SINGLE_CLASSES)
        own = classes[order] - SINGLE_CLASSES
        by_class = np.argsort(own, kind="stable")
        order = order[by_class]
        x, q = np.take(states.T, order, axis=0), np.empty((len(order), SLOTS), states.dtype)
        edges = np.searchsorted(own[by_class], np.arange(SHAPE_CLASSES + 1)).tolist()
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        for k, a, b in spans:
            np.dot(x[a:b], weights[k], out=q[a:b])
        if not tame(weights):
            q -= q.max(axis=1, keepdims=True) if len(q) else 0
        return order, x, q, spans

    def train_window(self, kinds: np.ndarray, given: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray, grad: "Network") -> np.ndarray:
        """Adds the gradients of a window (time by lane) to grad; the state after it. The window's first state is taken as given."""
        n, steps, width = HIDDEN, *kinds.shape
        before, after, (z, r, kept) = self.states(given, fresh, h.T)
        s, outer, slot_weights = before.reshape(n + 1, -1), self.class_weights(), self.slot_weights()
        valid, kinds = valid.ravel(), kinds.ravel()
        classes, slots, share = kinds % CLASSES, kinds // CLASSES, np.float32(1 / max(valid.sum(), 1))
        each, plain, across = valid * share, tame(outer), np.ascontiguousarray(outer.T)
        from_out, to_classes = np.empty((n, len(kinds)), s.dtype), np.zeros_like(across)
        for first in range(0, len(kinds), BLOCK):  # as much as stays in the processor's cache
            some = slice(first, first + BLOCK)
            p = across @ s[:, some]
            if not plain:
                p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= each[some] / column_sums(p)
            p[classes[some], np.arange(p.shape[1])] -= each[some]
            to_classes += p @ s[:, some].T
            from_out[:, some] = self.W @ p
        grad.W += to_classes[:, :n].T
        grad.c += to_classes[:, n]
        order, x, q, spans = self.inside(s, np.where(valid, classes, 0), slot_weights)
        np.exp(q, out=q)
        q *= (share / row_sums(q))[:, None]
        q[np.arange(len(q)), slots[order]] -= share
        back, to_slots = np.empty((len(q), n), q.dtype), np.zeros_like(slot_weights)
        for k, a, b in spans:
            np.dot(x[a:b].T, q[a:b], out=to_slots[k])
            np.dot(q[a:b], self.S[k].T, out=back[a:b])
        grad.S += to_slots[:, :n]
        grad.d += to_slots[:, n]
        from_out[:, order] += back.T
        from_out = from_out.reshape(n, steps, width)
        h0, rh, m = kept["h"], kept["rh"], kept["m"]
        # what the way back multiplies by, for all steps at once
        by_z, by_m, by_r, stays = (m - h0) * z * (1 - z), z * (1 - m * m), h0 * r * (1 - r), 1 - z
        dx = np.empty((steps, 3 * n, width), s.dtype)
        dh = np.zeros((n, width), s.dtype)  # of the state after step t
        gates, inner = np.ascontiguousarray(self.U[:, : 2 * n]), np.ascontiguousarray(self.U[:, 2 * n :])
        begins, goes_on, drh, part = fresh.any(axis=1).tolist(), (~fresh).astype(s.dtype), np.empty_like(dh), np.empty_like(dh)
        for t in range(steps - 1, -1, -1):
            dzr, dm = dx[t, : 2 * n], dx[t, 2 * n :]
            np.multiply(dh, by_z[t], out=dzr[:n])
            np.multiply(dh, by_m[t], out=dm)
            np.matmul(inner, dm, out=drh)
            np.multiply(drh, by_r[t], out=dzr[n:])
            dh *= stays[t]
            drh *= r[t]
            dh += drh
            dh += np.matmul(gates, dzr, out=part)
            dh += from_out[:, t]
            if begins[t]:
                dh *= goes_on[t]
        dx = dx.transpose(0, 2, 1).reshape(-1, 3 * n)
        to_gates = s @ dx[:, : 2 * n]
        grad.U[:, : 2 * n] += to_gates[:n]
        grad.U[:, 2 * n :] += rh.transpose(1, 0, 2).reshape(n, -1) @ dx[:, 2 * n :]
        grad.b += s[n] @ dx
        at = given.ravel()
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        grad.E[at[first]] += np.add.reduceat(np.take(dx, order, axis=0), first, axis=0)
        return after.T


def tame(weights: np.ndarray) -> bool:
    """Whether exp of the logits that these weights (their last row for the row of ones) give states, all between -1 and 1, can
    neither overflow nor vanish for all outputs at once, so that a softmax needs no maximum."""
    inner, middle = weights[..., :-1, :], weights[..., -1, :]
    reach = inner.shape[-2] * max(inner.max(), -inner.min())
    return bool(middle.max() + reach < 80 and middle.max(axis=-1).min() - reach > -80)


def column_sums(p: np.ndarray) -> np.ndarray:
    return np.ones(len(p), p.dtype) @ p


def row_sums(q: np.ndarray) -> np.ndarray:
    return q @ np.ones(q.shape[1], q.dtype)


def lanes(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of so many tokens laid end to end in lanes of about equal length: positions (time by lane) of their
    tokens in document order, -1 for none, and whether a document begins there; lane count is `most` at most."""
    longest = int(counts.max())
    width = int(max(1, min(most, counts.sum() // max(longest, 1))))
    filled, lane, at = np.zeros(width, np.int64), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    import heapq

    heap = [(0, k) for k in range(width)]
    for doc in np.argsort(-counts, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        lane[doc], at[doc] = k, used
        heapq.heappush(heap, (used + int(counts[doc]), k))
        filled[k] = used + counts[doc]
    place = np.full((int(filled.max()), width), -1, np.int32 if counts.sum() < 1 << 31 else np.int64)
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    inside = np.arange(len(of)) - first[of]
    place[at[of] + inside, lane[of]] = np.arange(len(of))
    fresh = np.zeros(place.shape, bool)
    fresh[at, lane] = True
    return place, fresh, of


def held_out():
    """crc32 of the id as text, modulo 7, is 2; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts hashes; where each value begins in it; the values."""
    order = np.argsort(hashes)
    in_order = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]])) if len(order) else order
    return order, first, in_order[first]


def word_counts(docs: DataFrame) -> DataFrame:
    """h, shape, c of the distinct words of docs (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []  # of each run, which is sorted within the processor's cache
            for run in runs(batch.column(0)):
                order, first, h = distinct(run.words(lower=True))
                kinds = (shapes(run, order[first]) % np.uint64(SHAPE_CLASSES)).astype(np.int32)
                found.append((h, kinds, np.diff(np.append(first, len(order)))))
            if found:
                hashes, kinds, times = map(np.concatenate, zip(*found, strict=True))
                order, first, h = distinct(hashes)
                n = np.add.reduceat(times[order], first) if len(first) else times
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kinds[order[first]]), pa.array(n)], ["h", "shape", "c"])

    return docs.select("text").mapInArrow(count, "h long, shape int, c long").groupBy("h").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From the written counts; HEAD_WORDS and SHAPE_CLASSES rows come to the driver at most."""
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD_WORDS).collect()
    h = np.array([r["h"] for r in head], np.int64).view(np.uint64)
    c, shape = np.array([r["c"] for r in head], np.int64), np.array([r["shape"] for r in head], np.int64)
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[SINGLE_CLASSES + r["shape"]], v[SINGLE_CLASSES + r["shape"]] = r["n"], r["v"]
    distinct, total = int(v.sum()) + (ends > 0), int(n.sum()) + ends
    n[0], v[0] = ends, ends > 0
    for k in range(min(SINGLE_CLASSES - 1, len(c))):
        n[1 + k], v[1 + k] = c[k], 1
        n[SINGLE_CLASSES + shape[k]] -= c[k]
        v[SINGLE_CLASSES + shape[k]] -= 1
    share = (n + 1) / (n + 1).sum()
    slots, used, slot_counts = np.zeros(len(c), np.int64), np.zeros(SHAPE_CLASSES, np.int64), np.full((SHAPE_CLASSES, SLOTS), -1.0)
    for k in range(SINGLE_CLASSES - 1, min(SINGLE_CLASSES - 1 + FREQUENT_WORDS, len(c))):
        if used[shape[k]] < SLOTS - 1:
            used[shape[k]] += 1
            slots[k] = used[shape[k]]
            slot_counts[shape[k], slots[k]] = c[k]
            n[SINGLE_CLASSES + shape[k]] -= c[k]
            v[SINGLE_CLASSES + shape[k]] -= 1
    slot_counts[:, 0] = n[SINGLE_CLASSES:]
    there = slot_counts >= 0
    slot_share = (slot_counts + 1) / (slot_counts + 1).sum(axis=1, keepdims=True)
    slot_log = np.where(there, np.log(np.where(there, slot_share, 1)), -1e4)  # a slot without a word has no part
    class_log = np.log10(n + v + 1)
    class_log[:SINGLE_CLASSES] = np.log10(n[:SINGLE_CLASSES] + 1)  # the one word of its class
    order = np.argsort(h)
    return Vocabulary(h[order], order, c[order], class_log, share, total, distinct, ends, slots[order], slot_log)


def trained(docs: DataFrame, words, class_share: np.ndarray) -> np.ndarray:
    """The network's weights after ROUNDS rounds, which together take every row of docs (doc_id, text) once; words: the
    broadcast vocabulary. The state runs through all windows of a document."""
    context, flat = docs.sparkSession.sparkContext, Network.fresh(class_share, words.value.slot_log)
    for turn in range(ROUNDS):
        sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)
        start = context.broadcast(flat.copy())

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            known, net = words.value, Network(start.value.copy())
            first, second, steps, seen = np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0
            grad, move, spread = Network(np.zeros_like(net.flat)), np.empty_like(net.flat), np.empty_like(net.flat)
            for kinds, given, counts in pools(known, batches):
                place, fresh, _ = lanes(counts, LANES)
                h = np.zeros((place.shape[1], HIDDEN), np.float32)
                for t in range(0, len(place), WINDOW):
                    at = place[t : t + WINDOW]
                    grad.flat[:] = 0
                    h = net.train_window(kinds[at], given[at], fresh[t : t + WINDOW], at >= 0, h, grad)
                    steps += 1
                    # first += 0.1 * (grad - first), second += 0.01 * (grad**2 - second), in place
                    np.subtract(grad.flat, first, out=move)
                    move *= 0.1
                    first += move
                    np.square(grad.flat, out=spread)
                    spread -= second
                    spread *= 0.01
                    second += spread
                    np.divide(second, 1 - 0.99**steps, out=spread)
                    np.sqrt(spread, out=spread)
                    spread += 1e-6
                    np.multiply(first, RATE / (1 + turn) / (1 - 0.9**steps), out=move)
                    move /= spread
                    net.flat -= move
                seen += int(counts.sum())
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(net.size)), pa.array(net.flat[: net.size].astype(float) * seen), pa.array(np.full(net.size, float(seen)))], ["k", "value", "weight"]
                )

        learnt = sample.select("text").mapInArrow(learn, "k long, value double, weight double")
        for r in learnt.groupBy("k").agg((F.sum("value") / F.sum("weight")).alias("value")).collect():  # one row a weight
            flat[r["k"]] = r["value"]
        start.destroy()
    return flat


def sequences(known: Vocabulary, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and slot, and input, of every token of a run, ends included, and the tokens of each row."""
    kinds, given, _ = known.tokens(run)
    return with_ends(run, kinds, given)


def with_ends(run: Run, kinds: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = run.counts()
    last = np.cumsum(count)
    return np.insert(kinds, last, 0), np.insert(given, last, 0), count + 1


def pools(known: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Class and input of every token of whole documents (column 0), and their token counts, POOL_TOKENS or a little more at a time."""
    held: list[tuple] = []
    tokens = 0
    for batch in batches:
        for run in runs(batch.column(0)):
            kinds, given, counts = sequences(known, run)
            held.append((kinds.astype(np.int16), given.astype(np.int16), counts))
            tokens += len(kinds)
            if tokens >= POOL_TOKENS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, tokens = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (null text: its end only).

    Rows whose id's crc32 modulo 7 is 2 are held out, all others are learnt from. Equal rows are scored alike.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    own = own.withColumn("row_key", F.xxhash64("doc_id", "text"))
    training = own.where("not held_out")
    counts = written(word_counts(training))
    vocab = vocabulary(counts, training.count())
    context = docs.sparkSession.sparkContext
    words = context.broadcast(vocab)
    weights = context.broadcast(trained(training, words, vocab.class_share))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for run in runs(batch.column(1)):
                hashes = run.words(lower=True)
                other = words.value.place(hashes) < 0
                row, hashes = run.row[other], hashes[other]
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])) if len(row) else row
                times = np.diff(np.append(first, len(row))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[run.first + row[first]]), pa.array(hashes[first].view(np.int64)), pa.array(times)], ["row_key", "h", "times"]
                )

    found = own.select("row_key", "text").mapInArrow(rare, "row_key long, h long, times int").join(counts.select("h", "c"), "h")
    once = found.groupBy("h", "row_key").agg(F.max("times").alias("times"), F.max("c").alias("c"))  # equal rows count once
    tails = once.groupBy("row_key").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("times").alias("rare_known"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = words.value, Network(weights.value)
        log_counts = np.log10(known.counts + 1.0)
        held: list[tuple] = []  # of each run: classes and inputs, token counts, the rows' columns
        tokens = 0

        def pooled() -> pa.RecordBatch:
            kinds, given, counts, parts = zip(*held, strict=True)
            outer = class_log_likelihood(net, np.concatenate(kinds), np.concatenate(given), np.concatenate(counts))
            made = pa.concat_arrays(c for *_, c in parts).to_numpy()  # what the counts say within the classes
            columns = [pa.concat_arrays(c) for c in list(zip(*parts, strict=True))[:-1]]
            names = ["row_key", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "model"]
            return pa.RecordBatch.from_arrays([*columns, pa.array(outer - made)], names)

        for batch in batches:
            for run in runs(batch.column(3)):
                kinds, given, at = known.tokens(run)
                there, rows = at >= 0, len(run.offsets) - 1
                head_log = np.bincount(run.row[there], log_counts[at[there]], rows)
                head_known = np.bincount(run.row[there], minlength=rows)
                within = known.class_log[kinds % CLASSES]
                vector = kinds >= CLASSES  # the network's state tells these words apart, not their counts
                within[vector] = log_counts[at[vector]]
                inner = np.bincount(run.row, within, rows) + known.class_log[0]
                kinds, given, counts = with_ends(run, kinds.astype(np.int16), given.astype(np.int16))
                columns = [batch.column(k).slice(run.first, rows) for k in range(3)]
                held.append((kinds, given, counts, [*columns, pa.array(counts), pa.array(head_known), pa.array(head_log), pa.array(inner)]))
                tokens += len(kinds)
                if tokens >= POOL_TOKENS:
                    yield pooled()
                    held, tokens = [], 0
        if held:
            yield pooled()

    schema = "row_key long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, model double"
    rows = own.select("row_key", "doc_id", "held_out", "text").mapInArrow(score, schema)
    rows = written(rows)
    # rounding differs with a row's place in its run: equal rows take one of their values
    alike = rows.groupBy("row_key").agg(F.min("model").alias("model")).join(tails, "row_key", "left")
    met = rows.drop("model").join(alike, "row_key")
    end_log, end_known = float(np.log10(vocab.ends + 1)), int(vocab.ends > 0)
    log_counts = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(end_log)
    return met.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(end_known)).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.lit(float(np.log10(vocab.total + vocab.distinct + 1)))).alias("base_score"),
        (log_counts + F.col("model")).alias("score"),
    )


def class_log_likelihood(net: Network, kinds: np.ndarray, given: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each document's classes and slots; the state runs through all windows of a document."""
    place, fresh, of = lanes(counts, SCORE_LANES)
    total, h = np.zeros(len(counts)), np.zeros((HIDDEN, place.shape[1]), np.float32)
    outer, slot_weights = net.class_weights(), net.slot_weights()
    plain, across = tame(outer), np.ascontiguousarray(outer.T)
    for t in range(0, len(place), SCORE_WINDOW):
        at = place[t : t + SCORE_WINDOW]
        before, h, _ = net.states(given[at], fresh[t : t + SCORE_WINDOW], h)
        reached, mine, there = before.reshape(HIDDEN + 1, -1), at.ravel(), at.ravel() >= 0
        if not there.all():
            reached, mine = reached[:, there], mine[there]
        classes, slots, value = kinds[mine] % CLASSES, kinds[mine] // CLASSES, np.empty(len(mine), np.float32)
        for first in range(0, len(mine), BLOCK):  # as much as stays in the processor's cache
            some = slice(first, first + BLOCK)
            logits = across @ reached[:, some]
            if not plain:
                logits -= logits.max(axis=0)
            chosen = logits[classes[some], np.arange(logits.shape[1])]
            np.exp(logits, out=logits)
            value[some] = chosen - np.log(column_sums(logits))
        order, _, q, _ = net.inside(reached, classes, slot_weights)
        chosen = q[np.arange(len(q)), slots[order]]
        np.exp(q, out=q)
        value[order] += chosen - np.log(row_sums(q))
        total += np.bincount(of[mine], value, len(counts))
    return total / np.log(10)
