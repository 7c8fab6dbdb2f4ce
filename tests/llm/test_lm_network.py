"""The network's arithmetic against a plain one, a token's lane a row; its processor time; the lookup of head words."""

import os
import subprocess
import sys
import time
from pathlib import Path

import numpy as np

from quarterdeck.llm import lm_scoring as lm

N = lm.HIDDEN


def plain_step(net, given, h):
    x = net.E[given] + net.b
    zr = 1 / (1 + np.exp(-np.clip(x[:, : 2 * N] + h @ net.U[:, : 2 * N], -30, 30)))
    z, r = zr[:, :N], zr[:, N:]
    m = np.tanh(x[:, 2 * N :] + (r * h) @ net.U[:, 2 * N :])
    return h + z * (m - h), (z, r, m, h)


def plain_inside(net, states, classes):
    order = np.flatnonzero(classes >= lm.SINGLE_CLASSES)
    order = order[np.argsort(classes[order], kind="stable")]
    own, x, q = classes[order] - lm.SINGLE_CLASSES, states[order], np.empty((len(order), lm.SLOTS), np.float32)
    edges = np.searchsorted(own, np.arange(lm.SHAPE_CLASSES + 1)).tolist()
    spans = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
    for k, a, b in spans:
        q[a:b] = x[a:b] @ net.S[k] + net.d[k]
    return order, x, q - q.max(axis=1, keepdims=True), spans


def plain_window(net, kinds, given, fresh, valid, h, grad):
    states, kept = [], []
    for t in range(len(kinds)):
        h = np.where(fresh[t][:, None], 0, h).astype(np.float32)
        states.append(h)
        h, back = plain_step(net, given[t], h)
        kept.append(back)
    s = np.concatenate(states)
    logits = s @ net.W + net.c
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    classes, slots, share = kinds.ravel() % lm.CLASSES, kinds.ravel() // lm.CLASSES, np.float32(1 / max(valid.sum(), 1))
    p[np.arange(len(p)), classes] -= 1
    p *= valid.ravel()[:, None] * share
    grad.W += s.T @ p
    grad.c += p.sum(axis=0)
    from_out = p @ net.W.T
    order, x, q, spans = plain_inside(net, s, np.where(valid.ravel(), classes, 0))
    q = np.exp(q)
    q /= q.sum(axis=1, keepdims=True)
    q[np.arange(len(q)), slots[order]] -= 1
    q *= share
    back = np.empty_like(x)
    for k, a, b in spans:
        grad.S[k] += x[a:b].T @ q[a:b]
        grad.d[k] += q[a:b].sum(axis=0)
        back[a:b] = q[a:b] @ net.S[k].T
    from_out[order] += back
    from_out = from_out.reshape(len(kinds), -1, N)
    dh, inputs = np.zeros_like(h), []
    for t in range(len(kinds) - 1, -1, -1):
        z, r, m, h0 = kept[t]
        dm = dh * z * (1 - m * m)
        drh = dm @ net.U[:, 2 * N :].T
        dzr = np.concatenate([dh * (m - h0) * z * (1 - z), drh * h0 * r * (1 - r)], axis=1)
        grad.U[:, : 2 * N] += h0.T @ dzr
        grad.U[:, 2 * N :] += (r * h0).T @ dm
        dx = np.concatenate([dzr, dm], axis=1)
        grad.b += dx.sum(axis=0)
        inputs.append(dx)
        dh = dh * (1 - z) + drh * r + dzr @ net.U[:, : 2 * N].T + from_out[t]
        dh = np.where(fresh[t][:, None], 0, dh).astype(np.float32)
    at, dx = given[::-1].ravel(), np.concatenate(inputs)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
    grad.E[at[order][first]] += np.add.reduceat(dx[order], first)
    return h


def plain_likelihood(net, kinds, given, counts):
    place, fresh, of = lm.lanes(counts, lm.SCORE_LANES)
    total, h = np.zeros(len(counts)), np.zeros((place.shape[1], N), np.float32)
    for t in range(0, len(place), lm.SCORE_WINDOW):
        at = place[t : t + lm.SCORE_WINDOW]
        states = np.empty((*at.shape, N), np.float32)
        for k in range(len(at)):
            h = np.where(fresh[t + k][:, None], np.float32(0), h)
            states[k] = h
            h, _ = plain_step(net, given[at[k]], h)
        mine = at[at >= 0]
        reached, classes, slots = states[at >= 0], kinds[mine] % lm.CLASSES, kinds[mine] // lm.CLASSES
        logits = reached @ net.W + net.c
        logits -= logits.max(axis=1, keepdims=True)
        value = logits[np.arange(len(mine)), classes] - np.log(np.exp(logits).sum(axis=1))
        order, _, q, _ = plain_inside(net, reached, classes)
        value[order] += q[np.arange(len(q)), slots[order]] - np.log(np.exp(q).sum(axis=1))
        total += np.bincount(of[mine], value, len(counts))
    return total / np.log(10)


def network(scale):
    rng = np.random.default_rng(5)
    flat = lm.Network.fresh(np.full(lm.CLASSES, 1 / lm.CLASSES), np.zeros((lm.SHAPE_CLASSES, lm.SLOTS)))
    return lm.Network(flat + rng.standard_normal(len(flat)).astype(np.float32) * np.float32(scale))


def tokens(counts):
    """Classes and slots, and inputs, frequent ones often."""
    rng = np.random.default_rng(6)
    kinds = np.minimum(rng.pareto(0.7, counts.sum()) * 4, lm.CLASSES - 1).astype(np.int16)
    kinds += np.int16(lm.CLASSES) * np.where(kinds >= lm.SINGLE_CLASSES, rng.integers(0, lm.SLOTS, len(kinds)), 0).astype(np.int16)
    return kinds, np.minimum(rng.pareto(0.7, len(kinds)) * 4, lm.SINGLE_INPUTS + lm.SHAPE_INPUTS - 1).astype(np.int16)


def seconds(call, other):
    """The least processor time of each, taken in turns."""
    least = [np.inf, np.inf]
    for _ in range(7):
        for k, f in enumerate((call, other)):
            begun = time.process_time()
            f()
            least[k] = min(least[k], time.process_time() - begun)
    return least


def windows(net, learn, kinds, given, place, fresh):
    """Each window's gradients and the state after it."""
    h, found = np.zeros((place.shape[1], N), np.float32), []
    for t in range(0, len(place), lm.WINDOW):
        at, grad = place[t : t + lm.WINDOW], lm.Network(np.zeros_like(net.flat))
        h = learn(net, kinds[at], given[at], fresh[t : t + lm.WINDOW], at >= 0, h, grad)
        found.append((grad.flat, h))
    return found


def test_network_is_plain_arithmetic():
    """Gradients, states and likelihoods, for weights small enough to leave a softmax's maximum out and for large ones."""
    counts = np.array([90, 1, 33, 64, 2, 17, 80, 5, 1, 40])
    kinds, given = tokens(counts)
    place, fresh, _ = lm.lanes(counts, 3)
    for scale in (0.3, 12):
        net = network(scale)
        assert lm.tame(net.class_weights()) == lm.tame(net.slot_weights()) == (scale < 1)
        for (grad, h), (plain_grad, plain_h) in zip(*(windows(net, f, kinds, given, place, fresh) for f in (lm.Network.train_window, plain_window)), strict=True):
            assert np.allclose(h, plain_h, atol=1e-4) and np.allclose(grad, plain_grad, rtol=1e-3, atol=1e-4 * np.abs(plain_grad).max())
        assert np.allclose(lm.class_log_likelihood(net, kinds, given, counts), plain_likelihood(net, kinds, given, counts), rtol=1e-4)


def costs():
    """Processor time of learning and of scoring, each with that of plain arithmetic, over lanes of documents of a usual length."""
    net, counts = network(0.3), np.random.default_rng(7).integers(100, 900, 400)
    kinds, given = tokens(counts)
    place, fresh, _ = lm.lanes(counts, lm.LANES)
    learn = [lambda f=f: windows(net, f, kinds, given, place, fresh) for f in (lm.Network.train_window, plain_window)]
    score = [lambda f=f: f(net, kinds, given, counts) for f in (lm.class_log_likelihood, plain_likelihood)]
    return [*seconds(*learn), *seconds(*score)]


def test_network_costs_less_than_plain_arithmetic():
    """In a process of its own, whose matrix products have one thread as in a task."""
    root = Path(__file__).resolve().parents[2]
    ran = subprocess.run([sys.executable, __file__], env=os.environ | {"PYTHONPATH": str(root), "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=120, check=True)
    learn, plain_learn, score, plain_score = map(float, ran.stdout.split())
    assert learn < 0.85 * plain_learn and score < 0.85 * plain_score, ran.stdout


def test_head_words_are_found_by_whole_hashes():
    """Also where many share their leading bits, at both ends of the range and beyond the last."""
    low = np.arange(0, 60, 3, dtype=np.uint64)
    top = np.uint64(1 << 63) + low
    hashes = np.sort(np.concatenate([low, top, np.random.default_rng(8).integers(0, 1 << 62, 500, dtype=np.uint64)]))
    known = lm.Vocabulary(hashes, np.arange(len(hashes)), np.ones(len(hashes), np.int64), np.zeros(lm.CLASSES), np.zeros(lm.CLASSES), 0, 0, 0)
    asked = np.concatenate([hashes, low + np.uint64(1), top + np.uint64(1), np.array([2**64 - 1, 2**63 - 1], np.uint64)])
    where = {h: k for k, h in enumerate(hashes.tolist())}
    assert known.place(asked).tolist() == [where.get(h, -1) for h in asked.tolist()]
    assert known.place(asked[:0]).tolist() == []


if __name__ == "__main__":
    print(*costs())
