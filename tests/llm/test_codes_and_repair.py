"""Golay fingerprints, whitening and conversation repair against plain versions, by method, and on edge cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarterdeck.llm import conversation_repair, golay_simhash, whitening
from quarterdeck.llm.words import runs
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
CLASHES = ("fp", "key", "root", "members", "fingerprint", "n", "i", "j", "squares", "total", "turn_", "signature", "copies", "kind", "audit", "cost", "damage")


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


# fingerprints


def plain_fingerprint(text):
    w = brute.words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values):
    """Smallest id reachable, for values by id."""
    ids, top = sorted(values), {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (values[i] ^ values[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_of_random_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["A", "b", "é", " ", "\n", "\t", "Z", "  ", "\x0b"]) for _ in range(rng.randint(0, 90))) for _ in range(400)] + [None, "", " \n"]
    made = np.concatenate([golay_simhash.run_fingerprints(run) for run in runs(pa.array(texts))])
    assert made.tolist() == [plain_fingerprint(t) for t in texts]


def test_code_is_perfect_and_near_segments_share_an_index():
    rng = np.random.default_rng(5)
    _, _, errors, found = golay_simhash._decoder()
    assert sorted(set(found.tolist())) == [1, 6] and all(e.bit_count() <= 3 for e in errors[:, 0].tolist())
    words = rng.integers(0, 1 << 23, 3000)
    for flips in (1, 2):
        other = words.copy()
        for k in range(len(other)):
            for p in rng.choice(23, flips, replace=False):
                other[k] ^= 1 << int(p)
        (a, na), (b, nb) = golay_simhash.codeword_indices(words), golay_simhash.codeword_indices(other)
        for k in range(len(words)):
            assert set(a[k, : na[k]]) & set(b[k, : nb[k]])
            if flips == 1:
                assert a[k, 0] in b[k, : nb[k]] and b[k, 0] in a[k, : na[k]]


@pytest.mark.parametrize("flips", range(5))
def test_fingerprints_within_four_bits_share_a_key(flips):
    rng = np.random.default_rng(flips)
    values = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000, dtype=np.uint64)
    other = values.copy()
    for k in range(len(other)):
        for p in rng.choice(64, flips, replace=False):
            other[k] ^= np.uint64(1 << int(p))
    keys = []
    for x in (values, other):
        parts = [golay_simhash.whole_segment_keys(x), golay_simhash.two_error_keys(x)]
        key, of = (np.concatenate(c) for c in zip(*parts, strict=True))
        assert len(set(zip(key.tolist(), of.tolist(), strict=True))) == len(key)
        keys.append([set(p.tolist()) for p in np.split(key[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(x)))[:-1])])
    assert all(a & b for a, b in zip(*keys, strict=True))


def test_components_of_dense_groups(spark, monkeypatch):
    """Groups whose members mostly link over others, small and large keys, against all pairs."""
    monkeypatch.setattr(golay_simhash, "SMALL", 6)
    monkeypatch.setattr(golay_simhash, "BLOCK", 10)
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(100)]
    for centre in (rng.getrandbits(64), 0):
        places = rng.sample(range(64), 14)
        for _ in range(250):
            v = centre
            for p in rng.sample(places, rng.randint(0, 7)):
                v ^= 1 << p
            values.append(v)
    own = dict(enumerate(dict.fromkeys(values)))
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in own.items()}
    links = golay_simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
    at, top = {v: i for i, v in signed.items()}, {i: i for i in own}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in links:
        a, b = find(at[r.a]), find(at[r.b])
        top[max(a, b)] = min(a, b)
    assert {i: find(i) for i in own} == plain_components(own)


def test_near_copies(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    expected = plain_components(prints)
    rows = golay_simhash.near_copies(docs).collect()
    assert sorted(rows) == sorted((i, f"{prints[i]:016x}", expected[i]) for i in texts)


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{k % 700}" for k in range(60_000))
    given = [(None, None), (None, "a b c d e"), (3, ""), (2, " \t"), (5, "A b C d e"), (5, "A b C d e"), (9, "one"), (8, "ONE"), (20, long), (21, long + " end"), (None, "alone here")]
    rows = golay_simhash.near_copies(with_clashes(spark.createDataFrame(given, "doc_id long, text string"))).collect()
    prints = [plain_fingerprint(t) for _, t in given]
    comps = plain_components(dict(enumerate(prints)))
    least = {}
    for (i, _), c in zip(given, comps.values(), strict=True):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(i, least[c])
    expected = [(i, f"{p:016x}", least[c]) for (i, _), p, c in zip(given, prints, comps.values(), strict=True)]
    assert sorted(rows, key=str) == sorted(expected, key=str)
    assert golay_simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# whitening


def test_square_sums_are_exact():
    rng = np.random.default_rng(0)
    for most in (1 << 20, 1 << 31, 1 << 61):
        t = rng.integers(-most, most, (300, 5))
        assert whitening.square_sums(t) == [sum(int(a) ** 2 for a in t[:, k]) for k in range(5)]


def check_whitened(rows, given):
    good = [(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    plain = np.array(y, float) / n @ vectors / np.sqrt(values)
    expected = {(i, k): (sum(a * a for a in y[r]), abs(plain[r, k])) for r, (i, _) in enumerate(good) for k in range(min(32, width))}
    assert len(rows) == len(expected)
    for r in rows:
        deviation, value = expected[r.vec_id, r.component - 1]
        assert r.n == n and r.deviation == deviation and abs(abs(r.whitened) - value) < 1e-6 * (1 + value)
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 and r.identity_error < 1e-8


def test_whitened(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    check_whitened(whitening.whitened(table).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitened_leaves_out_unusable_vectors_only(spark):
    rng = random.Random(1)
    given = [(k, [rng.uniform(-2, 2) for _ in range(5)]) for k in range(40)]
    given += [(50, None), (51, [None] * 5), (52, [1.0, float("nan"), 0.0, 0.0, 0.0]), (53, [float("inf"), *[0.0] * 4]), (54, [1.0, 2.0]), (55, [])]
    frame = with_clashes(spark.createDataFrame(given, "vec_id long, embedding array<double>")).repartition(3)
    check_whitened(whitening.whitened(frame).collect(), given)


@pytest.mark.parametrize("given", [[], [(1, None)], [(1, []), (None, [])]])
def test_nothing_to_whiten(spark, given):
    assert whitening.whitened(spark.createDataFrame(given, "vec_id long, embedding array<float>")).collect() == []


def test_components_without_variance(spark):
    rows = whitening.whitened(spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in rows] == [(5, k, 1, 0, None, None, None) for k in (1, 2)]
    rows = whitening.whitened(spark.createDataFrame([(None, [3e38, 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert len(rows) == 6 and all((r.whitened is None) == (r.component == 2) for r in rows) and all(r.identity_error < 1e-9 for r in rows)


# conversation repair


def plain_repair(rows):
    """Cheapest audit and repaired rows of damaged rows (role, text, must go, truncated), by uniform cost search."""
    keeps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    todo, seen = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, at, q, out = heapq.heappop(todo)
        if (at, q) in seen:
            continue
        seen.add((at, q))
        if at == len(rows) and q in ("", "a"):
            return cost, audit, out
        heapq.heappush(todo, (cost + 3, audit + "I", at, after[q][0], (*out, f"{after[q]}:")))
        if at < len(rows):
            role, text, must, late = rows[at]
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, q, out))
            if not must:
                heapq.heappush(todo, (cost + 3 + 3 * late, audit + "R", at + 1, after[q][0], (*out, f"{after[q]}:{text}")))
                if (q, role[:1]) in keeps:
                    heapq.heappush(todo, (cost + 3 * late, audit + "K", at + 1, keeps[q, role[:1]], (*out, f"{role}:{text}")))


def plain_conversations(given):
    by = {}
    for conv, turn, role, text in given:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        name = hashlib.sha256(f"{' ' if conv is None else conv}:{len(role)}:{role}{text}".encode()).digest()
        own += [((turn is not None, turn or 0, name), turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in by.items():
        seen, marked, blank, again, late = set(), [], 0, 0, 0
        for _, _, role, text in sorted(rows):
            bare = text.strip(" \t\n\x0b\x0c\r")
            is_blank, is_again, is_late = not bare, bool(bare) and (role, text) in seen, bool(bare) and (role, text) not in seen and bare[-1] not in ".!?"
            seen.add((role, text))
            blank, again, late = blank + is_blank, again + is_again, late + is_late
            marked.append((role, text, is_blank or is_again, is_late))
        turns = {t for _, t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, repaired = plain_repair(marked)
        out.append((conv, gaps, blank, again, late, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_of_random_conversations(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", "Well! ", "", " \n", None, "a.b", "Is it?\t", "x" * 50]
    given = [
        (conv, rng.choice([None, *range(9)]) if conv % 3 else turn, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts))
        for conv in range(150) for turn in range(rng.randint(1, 9))
    ] + [(None, k, "user", "Hello.") for k in range(5)] + [(-4, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(400)]
    frame = with_clashes(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).repartition(3)
    rows = conversation_repair.repaired(frame).collect()
    assert sorted(map(tuple, rows), key=str) == plain_conversations(given)


def test_nothing_left_after_damage_and_empty_tables(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"7:{k}".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    rows = conversation_repair.repaired(spark.createDataFrame([(7, gone, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in rows] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.repaired(spark.createDataFrame([], schema)).collect() == []


def test_nodes_are_distinct_suffixes():
    rng = random.Random(2)
    signatures = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 12))) + rng.choice(["ua", "uau", "xx"]) for _ in range(500)]
    automaton = conversation_repair.SuffixAutomaton()
    for backwards in sorted({s[::-1] for s in signatures}):
        automaton.read(backwards)
    assert automaton.made == len({s[k:] for s in signatures for k in range(len(s))})
    assert len(automaton.classes) < automaton.made  # nodes that act alike are computed once
