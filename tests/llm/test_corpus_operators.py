"""The corpus operators against plain versions on the small tables, and by method."""

import collections
import math
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarterdeck.llm import decontamination, html_text, line_dedup, lm_scoring, ngram_join, packing, quality_rules, resampling, token_files, warc
from quarterdeck.llm.queries import ORACLES, QUERIES
from quarterdeck.llm.shared import shared_folder, written
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def encoded(vocabulary, texts, end):
    coder = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return [np.array(e.ids + [end], "<u4") for e in coder.encode_batch(list(texts), add_special_tokens=False)]


def plain_rows(frame):
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return int(v) if isinstance(v, float | np.integer) and v == int(v) else v

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert plain_rows(QUERIES[name](spark, FOLDER).toPandas()) == plain_rows(con.execute(ORACLES[name]).df())


def test_decontamination_finds_short_items(spark):
    """Items of every size class, whole and with a word changed, inside a long text; one with too much changed is not found."""
    filler = [f"w{k * 7919 % 4001}" for k in range(20_000)]
    items, texts = {}, {}
    for n in (3, 5, 6, 9, 14, 30, 80):
        words = [f"item{n}x{k}" for k in range(n)]
        items[n] = " ".join(words)
        texts[n] = " ".join(filler[:9000] + words + filler[9000:])
        near = words[: n // 8] + ["other"] + words[n // 8 + 1 :] if n >= 9 else words
        texts[100 + n] = " ".join(filler[:50] + near + filler[50:90])
        texts[200 + n] = " ".join(x if k % 3 else "other" for k, x in enumerate(words))
    texts[300] = items[3]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == brute.contained(texts, items)
    assert {(n, n) for n in (5, 6, 9, 14, 30, 80)} <= found and (300, 3) in found


def test_decontamination_of_long_items_alone(spark):
    """With no short item in the table: words inserted or doubled at every place, passages repeated, pieces far apart."""
    items, texts = {}, {}
    for n in (20, 21, 22, 28, 40):
        words = [f"i{n}x{k}" for k in range(n)]
        items[n] = " ".join(words)
        for k in range(1, n):
            texts[1000 * n + k] = words[:k] + ["new"] + words[k:]
            texts[1000 * n + 100 + k] = words[:k] + words[k - 1 :]
            for j in range(k + 4, n, 5):
                texts[1000 * n + 200 + n * k + j] = words[:k] + words[k - 1 : j] + words[j - 1 :]
        texts[n] = [w for k in range(0, n - 4) for w in [*words[k : k + 5], "gap"]]
    texts = {i: " ".join(["before", *ws, "after"]) for i, ws in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == brute.contained(texts, items)
    assert {(1000 * n + k, n) for n in items for k in range(1, n)} <= found and {(n, n) for n in items} <= found


def test_line_dedup(spark, documents):
    texts = dict(zip(documents.doc_id, documents.text.fillna(""), strict=True))
    made = QUERIES["op10_line_dedup"](spark, FOLDER).where("text is not null").collect()
    expected = brute.without_repeats(texts)
    assert {r.doc_id: (r.text, r.n_removed) for r in made} == {i: expected[i] for i in (r.doc_id for r in made)}


def test_line_dedup_merges_windows(spark):
    block = "one\ntwo\n\nthree\nfour"
    docs = spark.createDataFrame([(1, block), (2, f"head\n{block}\ntail"), (3, "one\ntwo"), (4, f"{block}\n{block}")], "doc_id long, text string")
    rows = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert rows[1] == (block, 0) and rows[2] == ("head\ntail", 5) and rows[3] == ("one\ntwo", 0)
    assert rows[4] == brute.without_repeats({1: block, 4: f"{block}\n{block}"})[4]


def test_quality_counts(spark, documents):
    rows = QUERIES["op2_quality_rules"](spark, FOLDER).collect()
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = brute.counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (r.kept and r.base_failed)


def test_quality_outliers(spark):
    """A covariance fitted on the nearest three quarters rejects texts of another kind, also when they are a fifth of a group."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(80, 200))]
        odd = k % 5 == 4
        words = [w.upper() + "#$%&" if odd else w for w in words]
        rows.append((k, "\n".join(" ".join(words[i : i + 10]) for i in range(0, len(words), 10)), "en", "hot"))
    kept = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[k] for k in range(4, 400, 5))
    assert sum(kept[k] for k in range(400) if k % 5 != 4) >= 318


def test_warc_revisits_and_ranges(spark):
    rows = [(1, "http://a/ b", "<p>x"), (2, None, "<p>x"), (3, "http://b", None), (4, "http://b", ""), (5, "u", "é\r\n" * 5000), (None, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = shared_folder(spark)
    index = written(warc.write_warc(warc.with_revisits(pages), f"{folder}/a"))
    got = {r.page_id: r for r in warc.read_warc(spark, f"{folder}/a", index).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert got[5].html == rows[4][2] and got[5].payload_bytes == 20_000 and got[1].payload_bytes == 4
    some = warc.read_warc(spark, f"{folder}/a", index.where("page_id in (2, 5)")).collect()
    assert sorted(r.page_id for r in some) == [2, 5]
    assert warc.coalesced([(0, 10), (10, 5), (100, 5)], gap=20, most=1000) == [(0, 15, [0, 1]), (100, 5, [2])]


def test_packing(spark, documents):
    got = QUERIES["op4_packing"](spark, FOLDER).toPandas()
    ids = dict(zip(documents.doc_id, encoded("word_bpe_49k.json", documents.text.fillna(""), 1), strict=True))
    check_pieces(got, ids)
    assert set(got.window) <= set(packing.TIERS)


def test_packing_of_very_many_short_texts():
    """A block of 400,000 pieces of five tokens, in seconds; nothing is lost."""
    pieces = [(5, k, 0) for k in range(400_000)]
    began = time.perf_counter()
    windows, rest = packing.pack_block(pieces, packing.TIERS)
    assert time.perf_counter() - began < 5
    assert all(sum(p[0] for p in w) == size for size, w in windows) and sum(p[0] for _, w in windows for p in w) + sum(p[0] for p in rest) == 2_000_000
    assert sum(p[0] for p in rest) < packing.TIERS[0]


def test_packing_step_groups(spark):
    """Groups have the same number of tokens and windows of one length; only a partition's last may be short."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["word"] * int(n))) for k, n in enumerate(rng.choice([3, 40, 200, 400, 900, 3000], 4000, p=[0.1, 0.6, 0.1, 0.1, 0.08, 0.02]))]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), public_tokenizers.path("word_bpe_49k.json"), 1).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == got.groupby("doc_id").doc_tokens.first().to_dict()
    assert (got.groupby("step_group").window.nunique() == 1).all() and got.window.nunique() == len(packing.TIERS)
    tokens = got.groupby("step_group").length.sum()
    short = tokens[tokens != packing.STEP_TOKENS]
    assert len(short) <= 3 and set(got[got.step_group.isin(short.index)].window) == {packing.TIERS[-1]}
    lengths = got.groupby("sequence_id").agg(n=("length", "sum"), window=("window", "first"))
    assert (lengths.n != lengths.window).sum() <= 3


def check_pieces(got, ids):
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
    by_doc = got.sort_values(["doc_id", "start"])
    assert (by_doc.start == by_doc.groupby("doc_id").length.cumsum() - by_doc.length).all()
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    by_sequence = got.sort_values(["sequence_id", "offset"])
    assert (by_sequence.offset == by_sequence.groupby("sequence_id").length.cumsum() - by_sequence.length).all()
    lengths = got.groupby("sequence_id").length.sum()
    assert lengths.max() <= 2048
    assert sum(n & (n - 1) != 0 for n in lengths) <= 4  # one a partition


def test_ngram_join(spark, documents):
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_ngram_join"](spark, FOLDER).collect()}
    assert got == brute.components(texts)


def test_ngram_join_near_copies(spark):
    """A large group of near copies with chains, very frequent words, and sets right at the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(300):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            words[at] = f"x{rng.integers(0, 30)}"
        texts[k] = " ".join(words)
    for k in range(300, 400):
        texts[k] = " ".join(rng.choice(["the", "a", "of"], 12))
    seven = [f"t{k}" for k in range(11)]
    texts[400], texts[401] = " ".join(seven), " ".join([*seven[:10], "other"])  # 6 of 8 shingles
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(docs).collect()}
    assert got == brute.components(texts) and got[401][1] == 400


def test_resampling(spark):
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    taken = QUERIES["op6_resampling"](spark, FOLDER).toPandas()
    good = (labels.quality == 1) & (labels.toxic.fillna(0) == 0)
    assert len(taken) == round(good.mean() * len(pd.read_parquet(f"{FOLDER}/documents.parquet", columns=["doc_id"])))
    share = labels.doc_id.isin(taken.doc_id)
    assert share[good].mean() > share[~good].mean()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    table = spark.read.parquet(f"{FOLDER}/labels.parquet")
    keyed = resampling.weights(docs, resampling.log_ratios(docs, table)).withColumn("key", F.col("log_weight") + resampling.gumbel(F.col("doc_id"), F.col("text_hash")))
    order = keyed.toPandas().sort_values("key", ascending=False)
    assert set(taken.doc_id) == set(order.doc_id[: len(taken)])


def test_gumbel_sample_is_in_proportion(spark):
    """The most probable of three weights is first as often as its share says."""
    draws = spark.range(20_000).select(*[(F.lit(math.log(p)) + resampling.gumbel(F.col("id"), F.lit(k))).alias(f"k{k}") for k, p in enumerate((0.6, 0.3, 0.1))])
    first = draws.agg(F.avg((F.col("k0") == F.greatest("k0", "k1", "k2")).cast("int"))).first()[0]
    assert abs(first - 0.6) < 0.015


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, documents, encoding):
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 2, encoding=encoding, files=3)
    got = token_files.token_digests(token_files.read_token_files(spark, folder)).toPandas().sort_values("doc_id").reset_index(drop=True)
    own = documents.sort_values("doc_id")
    ids = encoded("byte_bpe_50k.json", own.text.fillna(""), 2)
    n = np.array([len(x) for x in ids])
    expected = pd.DataFrame({"doc_id": own.doc_id.to_numpy(), "start": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x) for x in ids]})
    assert (got[expected.columns].to_numpy() == expected.to_numpy()).all()
    for file in Path(folder.removeprefix("file://")).glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        column = next(group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema.startswith("ids"))
        assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
        assert column.has_dictionary_page == (encoding == "dictionary") and column.has_offset_index


def test_lm_scoring(spark, documents):
    got = QUERIES["op8_lm_scoring"](spark, FOLDER).toPandas().set_index("doc_id")
    tokens = {i: [*brute.words(t), None] for i, t in zip(documents.doc_id, documents.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-6)
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def test_lm_gradient():
    """Gradients through time against differences of the log-likelihood, with documents that begin inside a window."""
    rng = np.random.default_rng(2)
    flat = lm_scoring.Network.fresh(np.full(lm_scoring.SINGLE_CLASSES + lm_scoring.SHAPE_CLASSES, 1 / 96))
    flat += rng.standard_normal(len(flat)).astype(np.float32) * 0.2
    net = lm_scoring.Network(flat)
    counts = np.array([5, 3, 8, 1, 7])
    kinds, given = rng.integers(0, 96, counts.sum()), rng.integers(0, 20, counts.sum())
    kinds += lm_scoring.CLASSES * np.where(kinds >= lm_scoring.SINGLE_CLASSES, rng.integers(0, lm_scoring.SLOTS, counts.sum()), 0)
    place, fresh, _ = lm_scoring.lanes(counts, 3)
    grad = lm_scoring.Network(np.zeros_like(flat))
    net.train_window(kinds[place], given[place], fresh, place >= 0, np.zeros((place.shape[1], lm_scoring.HIDDEN), np.float32), grad)

    def loss():
        return -lm_scoring.class_log_likelihood(net, kinds, given, counts).sum() * math.log(10) / counts.sum()

    picks = [*rng.integers(0, net.size, 20), *np.argsort(-np.abs(grad.flat))[:20]]
    for k in picks:
        kept = flat[k]
        flat[k] = kept + 0.01
        above = loss()
        flat[k] = kept - 0.01
        below = loss()
        flat[k] = kept
        assert abs((above - below) / 0.02 - grad.flat[k]) < 2e-3 + 0.02 * abs(grad.flat[k])


def test_lm_score_against_plain_steps(spark, monkeypatch):
    """With given weights, scores are those of one step a token in plain arithmetic; words of a class add up to one at most."""
    rng = np.random.default_rng(12)
    names = [f"w{k}" for k in range(300)]
    weights = np.array([1 / (k + 3) for k in range(300)])
    texts = [" ".join(rng.choice(names, int(rng.integers(0, 60)), p=weights / weights.sum())) for _ in range(120)] + ["never seen words", None]
    held = {}

    def given_weights(docs, words, share):
        flat = lm_scoring.Network.fresh(share, words.value.slot_log)
        flat += rng.standard_normal(len(flat)).astype(np.float32) * 0.3
        held.update(flat=flat, vocab=words.value)
        return flat

    monkeypatch.setattr(lm_scoring, "trained", given_weights)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.scored(docs).collect()}
    net, vocab = lm_scoring.Network(held["flat"].astype(float)), held["vocab"]
    training = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    count = collections.Counter(w for t in training for w in brute.words(t))

    def token(word):
        run = next(iter(lm_scoring.runs(pa.array([word]))))
        kind, x, _ = vocab.tokens(run)
        return int(kind[0]) % lm_scoring.CLASSES, int(kind[0]) // lm_scoring.CLASSES, int(x[0])

    of = {w: token(w) for w in {*names, "never", "seen", "words"}}
    shared = collections.defaultdict(list)  # the counts of the words of a class without a vector
    for w, c in count.items():
        if of[w][0] >= lm_scoring.SINGLE_CLASSES and not of[w][1]:
            shared[of[w][0]].append(c)

    def softmax(v):
        e = np.exp(v - v.max())
        return e / e.sum()

    n = lm_scoring.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for k, text in enumerate(texts):
        h, total = np.zeros(n), 0.0
        for w in [*brute.words(text), None]:
            kind, slot, x = (0, 0, 0) if w is None else of[w]
            chance = softmax(h @ net.W + net.c)[kind]
            if kind >= lm_scoring.SINGLE_CLASSES:
                chance *= softmax(h @ net.S[kind - lm_scoring.SINGLE_CLASSES] + net.d[kind - lm_scoring.SINGLE_CLASSES])[slot]
                if not slot:
                    chance *= (count[w] + 1) / (sum(shared[kind]) + len(shared[kind]) + 1)
            total += math.log10(chance)
            a = net.E[x] + net.b
            zr = a[: 2 * n] + h @ net.U[:, : 2 * n]
            z, r = (np.array([sigmoid(v) for v in part]) for part in (zr[:n], zr[n:]))
            h = (1 - z) * h + z * np.tanh(a[2 * n :] + (r * h) @ net.U[:, 2 * n :])
        assert math.isclose(got[k], total, rel_tol=1e-4, abs_tol=1e-4), k
    assert any(slot for _, slot, _ in of.values()) and shared


def test_lm_learns_words_inside_classes(spark):
    """Two words of one class that only the word before tells apart: the text's likelihood is better than any counts could make it."""
    singles = [f"s{k}" for k in range(40)]  # more frequent than the pair, which so is not among the classes of one word
    pairs = (["red", "abxyz"], ["blue", "abqyz"])
    text = lambda k: " ".join(w for j in range(15) for w in (*(singles[(k * 7 + j * 24 + i) % 40] for i in range(24)), *pairs[(k + j) % 2]))
    docs = spark.createDataFrame([(k, text(k)) for k in range(4000)], "doc_id long, text string").repartition(1)
    context = spark.sparkContext
    counts = written(lm_scoring.word_counts(docs))
    vocab = lm_scoring.vocabulary(counts, docs.count())
    net = lm_scoring.Network(lm_scoring.trained(docs, context.broadcast(vocab), vocab.class_share))
    run = next(iter(lm_scoring.runs(pa.array(["abxyz", "abqyz"]))))
    kinds = vocab.tokens(run)[0]
    assert kinds[0] != kinds[1] and kinds[0] % lm_scoring.CLASSES == kinds[1] % lm_scoring.CLASSES >= lm_scoring.SINGLE_CLASSES

    def log_chance(words):
        run = next(iter(lm_scoring.runs(pa.array([words]))))
        kinds, given, count = lm_scoring.sequences(vocab, run)
        return lm_scoring.class_log_likelihood(net, kinds, given, count)[0]

    assert log_chance("s1 red abxyz") > log_chance("s1 red abqyz") + 0.5 and log_chance("s1 blue abqyz") > log_chance("s1 blue abxyz") + 0.5


def test_lm_trains_on_every_document(spark, monkeypatch):
    """Whatever its id, a training document moves the weights; a long one is learnt from as a whole."""
    share = np.full(lm_scoring.SINGLE_CLASSES + lm_scoring.SHAPE_CLASSES, 1 / 96)
    none = np.array([], np.int64)
    vocab = lm_scoring.Vocabulary(none.view(np.uint64), none, none, np.zeros(96), share, 0, 0, 0)
    words = spark.sparkContext.broadcast(vocab)
    fresh = lm_scoring.Network.fresh(share)
    for k in range(1, 13):
        docs = spark.createDataFrame([(k, f"some words of text {k}")], "doc_id long, text string")
        assert (lm_scoring.trained(docs, words, share) != fresh).any(), k
    monkeypatch.setattr(lm_scoring, "POOL_TOKENS", 4000)
    texts = ["a b c", "long " * 3000, None, "", "long " * 2500, "end"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])] * 2
    counts = [c.tolist() for _, _, c in lm_scoring.pools(vocab, batches)]
    assert sum(counts, []) == [4, 3001, 1, 1, 2501, 2] * 2


def test_html_text(spark):
    """Markup that is named goes everywhere; what recurs on a host goes from its pages, but not an article's paragraphs."""
    rows = []
    for k in range(12):
        body = f"<nav>Menu</nav><div class=box><b>Site of the week</b> offers</div><article><h1>Title &amp; {k}</h1><p>First\n  text {k}<p>Same words<script>x<y</script></article><footer>End</footer>"
        rows.append((k, f"http://Host.example/{k}", f"<html><body>{body}</body></html>"))
    for k in range(12, 24):
        rows.append((k, f"http://two.example/{k}", f"<body><div class=box>Site of the week</div><div>Own {k}<br>line</div><div class=comments>no</div></body>"))
    rows += [(30, None, None), (31, "http://x", ""), (32, "http://x", "a &lt; b &#233;"), (33, "http://x", "<p>" * 3000 + "deep")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[k].text == f"Title & {k}\nFirst text {k}\nSame words"
    for k in range(12, 24):
        assert got[k].text == f"Own {k}\nline"
    assert got[30].text == got[31].text == "" and got[32].text == "a < b é" and got[33].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_template_of_unnamed_parts(spark):
    """Pages without article, names or roles: what recurs on five different pages of a host goes, copies of a page count once."""
    page = "page_id long, url string, html string"
    rows = [(k, f"http://a/{k}", f"<body><div><div>Our site</div><div><div>Own text {k}</div>{'<p>Soon back</p>' if k < 17 else ''}</div></div></body>") for k in range(200)]
    rows += [(300 + k, f"http://b/{k}", "<body><p>A copied page</p></body>") for k in range(6)] + [(310 + k, f"http://b/x{k}", f"<p>other {k}</p>") for k in range(14)]
    rows += [(400 + k, f"http://c/{k}", "<article><div class=entry>Copied entry</div></article>") for k in range(6)]
    rows += [(500 + k, f"http://d/{k}", f"<div>Rare part</div><div>text {k}</div>") for k in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, page)).collect()}
    assert all(got[k] == f"Own text {k}" for k in range(200))
    assert all(got[300 + k] == "A copied page" and got[400 + k] == "Copied entry" for k in range(6))
    assert all(got[500 + k] == f"Rare part\ntext {k}" for k in range(4))


def test_html_names():
    """Names go by whole words, never those of text; an article's own header keeps its title; an empty main is no article."""
    text = lambda html: html_text.main_text(html_text.parse(html), set())
    assert text('<article class="post sidebar-left"><p>a</p></article>') == "a"
    assert text('<div class="no-sidebar">a</div>') == text('<p class="share price">a</p>') == text('<section id="comments-on-policy">a</section>') == "a"
    assert text("<main></main><p>a</p>") == text("<main><nav>m</nav></main><p>a</p>") == "a"
    assert text("<article><header><h1>Title</h1></header><p>a</p></article>") == "Title\na"
    assert text("<header><h1>Site</h1></header><p>a</p>") == "a"
    for name in ("sidebar-left", "siteFooter", "cookie-banner", "related-posts", "ad", "comments", "comment-list ad-slot", "share-buttons"):
        assert text(f'<div class="{name}">b</div><p>a</p>') == "a", name
    assert text('<div class="widget"><h1>t</h1><p>a</p></div>') == "t\na"
    assert text('<article><p>a</p></article><article class="comment"><p>b</p></article>') == "a"


def test_html_templates_against_all_pages(spark):
    """Random pages without names, against subtrees counted as text over all pages of a host."""
    draw = random.Random(9)

    def element(depth):
        if depth == 0 or draw.random() < 0.3:
            return f"<div>{draw.choice(['one', 'two words', 'three', 'some more', 'x'])} {draw.randrange(4)}</div>"
        return "<div>" + "".join(element(depth - 1) for _ in range(draw.randrange(1, 4))) + "</div>"

    pages = [(k, f"http://h{draw.randrange(3)}/", element(3) + (f"<div>{k}</div>" if draw.random() < 0.7 else "")) for k in range(120)]
    leaves = re.compile(r"<div>([^<]+)</div>")

    def subtrees(html):
        opened, found = [], []
        for m in re.finditer(r"<(/?)div>", html):
            if m[1]:
                found.append((opened.pop(), m.end()))
            else:
                opened.append(m.start())
        return found

    standing = {}
    for _, host, html in pages:
        for a, b in subtrees(html):
            standing.setdefault((host, html[a:b]), set()).add("\n".join(leaves.findall(html)))
    wanted = {}
    for k, host, html in pages:
        gone = [(a, b) for a, b in subtrees(html) if len(standing[host, html[a:b]]) >= 5]
        wanted[k] = "\n".join(m[1] for m in leaves.finditer(html) if not any(a <= m.start() < b for a, b in gone))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == wanted and any(t != "\n".join(leaves.findall(h)) for t, (_, _, h) in zip(wanted.values(), pages))


def plain_mcd(x, words, starts):
    """Minimum covariance determinant by sorting the rows: the least determinant over many random starts, then reweighted."""
    p = x.shape[1]
    floors = np.diag(quality_rules.least_spreads(np.median(x, axis=0)) ** 2)
    known = np.column_stack([np.ones(len(x))] + [np.sqrt(words / (words + quality_rules.PRIOR_WORDS))] * (p - 1))

    def distances(centre, spread):
        away = (x - centre) * known
        return np.einsum("ij,jk,ik->i", away, np.linalg.inv(spread), away)

    def fit(chosen, share):
        return x[chosen].mean(axis=0), np.cov(x[chosen].T, bias=True) * quality_rules.consistency(share, p) + floors

    best = None
    for seed in range(starts):
        now = fit(np.random.default_rng(seed).choice(len(x), 3 * p, replace=False), 0.75)
        for _ in range(40):
            now = fit(np.argsort(distances(*now))[: math.ceil(0.75 * len(x))], 0.75)
        size = np.linalg.slogdet(now[1])[1]
        if best is None or size < best[0]:
            best = size, now
    inliers = distances(*best[1]) <= quality_rules.chi_square(0.975, p)
    return distances(*fit(np.flatnonzero(inliers), 0.975))


def test_quality_of_correlated_statistics(spark):
    """Texts whose capitals and marks each lie within what ordinary texts have, but not together, are found; the distances
    agree with a plain estimate over many starts, and far fewer rows are found where the covariances are left out."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(300):
        odd = k % 10 == 9
        level = rng.uniform(0.05, 0.6)
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
        capitals, marked = rng.permutation(400), rng.permutation(400)
        for i in capitals[: int(400 * level)]:
            words[i] = words[i].capitalize()
        for i in marked[: int(400 * (0.65 - level if odd else level))]:
            words[i] += ","
        if not odd or abs(level - 0.325) > 0.15:
            rows.append((k, " ".join(words), "en", "one"))
    made = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().sort_values("doc_id")
    odd = (made.doc_id % 10 == 9).to_numpy()
    kept = made.kept.to_numpy()
    assert odd.sum() > 10 and kept[odd].sum() == 0 and kept[~odd].mean() > 0.98
    x = made[[f"x_{n}" for n in quality_rules.FEATURES]].to_numpy()
    for k in range(x.shape[1]):  # no statistic tells them apart by itself
        assert x[odd, k].min() >= x[~odd, k].min() - 0.2 and x[odd, k].max() <= x[~odd, k].max() + 0.2
    plain = plain_mcd(x, made.n_words.to_numpy(), 30)
    limit = quality_rules.chi_square(1 - quality_rules.TAIL, x.shape[1])
    assert ((plain <= limit) == kept).mean() > 0.99
    assert np.corrcoef(np.log(plain), np.log(made.distance))[0, 1] > 0.98
