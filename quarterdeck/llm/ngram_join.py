"""Exact Jaccard self-join of shingle sets by prefix trees, and the groups of linked documents.

1. Each document is its set of 64-bit shingle hashes. Documents with equal sets are one class.
2. How many classes have a shingle is counted by ranges of hash values, in packed arrays of a few bytes an entry. Only
   shingles of two classes or more go on; a class that has not three quarters of its shingles among these links with none.
3. The sets left are ordered globally, rare shingles first. Two sets that link share a shingle of both their prefixes.
4. The sets of one prefix shingle are compared. First each with the most ordinary one there (that with the fewest
   shingles of its own), which joins most of a group of near copies with one row a copy. Where a prefix shingle still has
   sets of different components, the sets that such shingles hold together make a cluster; all of it is stored in
   prefix trees, and the sets outside its largest component are probed through them, level by level: sets with a common
   beginning share its overlap, and a subtree goes when its remaining length cannot reach the overlap that a link
   takes. Both sides of a cluster are cut into blocks, so a task has a bounded number of sets.
5. Links make components by repeated minima over neighbours and grandparents.

Nothing is left out to save work: a pair is skipped only if its documents are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarterdeck.llm.shared import joined_on_groups, written
from quarterdeck.llm.words import mix, release, runs, shingles

#: Shingles counted by one task at a time.
BUCKET_ENTRIES = 1_000_000
#: Sets of a prefix shingle that are compared in one task.
BLOCK_SETS = 500
#: Shingles that so large a share of a sample of so many documents has come last in the order, uncounted. This bounds what one
#: value can add to a task; which shingles are marked changes the order only, never a result.
COMMON_SAMPLE, COMMON_SHARE = 20_000, 1000
COMMON_DF = 2**31 - 1
_OTHER = np.uint64(0xA0761D6478BD642F)


def document_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the distinct shingles of that and the following rows, sorted), run by run. A-Z count as a-z."""
    for run in runs(column):
        rows = len(run.offsets) - 1
        hashes, row = shingles(run.words(lower=True), run.row, rows)
        parts = np.split(hashes, np.cumsum(np.bincount(row, minlength=rows))[:-1])
        out = []
        for part in parts:
            part = np.sort(part)
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part)
        yield run.first, out


def set_key(hashes: np.ndarray) -> int:
    """Equal for equal sets (64 bits: among ten billion sets, three pairs of different ones are expected to share one)."""
    return int((mix(hashes ^ _OTHER).sum(dtype=np.uint64)).view(np.int64))


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text as it is), n_shingles, set_key (null for an empty set) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, sets in document_sets(batch.column(1)):
                sizes += [len(s) for s in sets]
                keys += [set_key(s) if len(s) else None for s in sets]
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key"])

    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(measure, "doc_id long, text_hash long, n_shingles long, set_key long")


def common_shingles(docs: DataFrame, rows: int) -> np.ndarray:
    """Sorted hashes of shingles that one in COMMON_SHARE documents of a sample has; at most COMMON_SHARE times the mean size."""
    sample = docs if rows <= COMMON_SAMPLE else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (COMMON_SAMPLE << 20) // rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in document_sets(batch.column(0)):
                flat, count = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(count)], ["h", "n"])

    least = max(COMMON_SAMPLE // COMMON_SHARE, 2)
    found = sample.select("text").mapInArrow(hashed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["h"] for r in found.select("h").collect()], np.int64).view(np.uint64))


def shared_shingles(docs: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """set_key, token, df: the shingles of each class that another class has too (or that are marked common).

    A token is the range of hash values it was counted in and the 32 bits below; two shingles may share one, which makes
    no false links of note as it adds one to an overlap at most where 2^32 values hold BUCKET_ENTRIES."""
    packed = "bucket int, low binary, of binary, keys binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            keys, sets, held = [], [], 0
            for _, run in document_sets(batch.column(0)):
                for hashes in run:
                    if len(hashes) and (key := set_key(hashes)) not in seen:
                        seen.add(key)
                        keys.append(key)
                        sets.append(hashes)
                        held += len(hashes)
                if held >= 1_000_000:
                    yield from packed_rows(np.array(keys, np.int64), sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield from packed_rows(np.array(keys, np.int64), sets)

    def packed_rows(keys: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            # common ones are dealt by class, not by value; their bucket is kept in the token
            known = common[at] == flat
        else:
            known = np.zeros(len(flat), bool)
        low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        if known.any():
            spread = buckets + (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)[of[known]]
            yield rows_of(spread, flat[known], of[known], keys)
        yield rows_of(bucket[~known], low[~known], of[~known], keys)

    def rows_of(bucket: np.ndarray, low: np.ndarray, of: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket, low, of = bucket[order], low[order], of[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        lows, ofs, owners = [], [], []
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            mine, place = np.unique(of[a:b], return_inverse=True)
            lows.append(low[a:b].tobytes())
            ofs.append(place.astype(np.uint16 if len(mine) < 65536 else np.uint32).tobytes())
            owners.append(keys[mine].tobytes())
        firsts = bucket[[0, *cuts]] if len(bucket) else bucket[:0]
        if not len(bucket):
            lows, ofs, owners = [], [], []
        return pa.RecordBatch.from_arrays(
            [pa.array(firsts.astype(np.int32)), pa.array(lows, pa.binary()), pa.array(ofs, pa.binary()), pa.array(owners, pa.binary())],
            ["bucket", "low", "of", "keys"],
        )

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        kind = np.uint64 if bucket >= buckets else np.uint32
        lows, keys = [], []
        for low, of, own in zip(group.column("low"), group.column("of"), group.column("keys"), strict=True):
            own = np.frombuffer(own.as_py(), np.int64)
            lows.append(np.frombuffer(low.as_py(), kind))
            keys.append(own[np.frombuffer(of.as_py(), np.uint16 if len(own) < 65536 else np.uint32)])
        low, key = np.concatenate(lows), np.concatenate(keys)
        if bucket >= buckets:  # every class's common shingles as they are, once
            order = np.lexsort((key, low))
            low, key = low[order], key[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (key[1:] != key[:-1])
            low, key = low[new], key[new]
            token = ((low >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32)) | (low & np.uint64(0xFFFFFFFF))
            return pa.table({"set_key": key, "token": token.view(np.int64), "df": np.full(len(key), COMMON_DF, np.int32)})
        order = np.argsort(low)
        low, key = low[order], key[order]
        same = low[1:] == low[:-1]
        twice = np.zeros(len(low), bool)
        twice[1:] |= same
        twice[:-1] |= same
        low, key = low[twice], key[twice]
        order = np.lexsort((key, low))
        low, key = low[order], key[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (key[1:] != key[:-1])
        low, key = low[new], key[new]
        _, place, df = np.unique(low, return_inverse=True, return_counts=True)
        df = df[place]
        low, key, df = low[df > 1], key[df > 1], df[df > 1]
        release()
        token = (np.int64(bucket) << 32) | low.astype(np.int64)
        return pa.table({"set_key": key, "token": token, "df": df.astype(np.int32)})

    return docs.select("text").mapInArrow(pack, packed).groupBy("bucket").applyInArrow(count, "set_key long, token long, df int")


def needed(size):
    """Least overlap of a set of that size with any set it links with: three quarters, rounded up."""
    return (3 * size + 3) // 4


def tree_links(
    probes: list[np.ndarray], probe_sizes: np.ndarray, probe_group: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, group: np.ndarray
) -> list[tuple[int, int]]:
    """Links (probe, set) that join different groups, as few as join what they join.

    Each is given by its tokens in global order (without those that no other set has), the size of the whole set, and the group
    it is in already. The sets are rows sorted as a tree's leaves are; a node is known by the first row below it.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
    length = np.array([len(sets[k]) for k in order])
    common = np.zeros(len(sets), np.int64)  # tokens at the beginning shared with the row before
    for k in range(1, len(sets)):
        a, b = sets[order[k - 1]], sets[order[k]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        common[k] = differ[0] if len(differ) else n
    own, own_group = sizes[order], group[order]
    # an overlap o is enough if 100 o >= 75 (x + y - o)
    need = -(-3 * (probe_sizes[:, None] + own[None, :]) // 7)
    alive = probe_group[:, None] != own_group[None, :]
    alive &= np.minimum(probe_sizes[:, None], own[None, :]) * 4 >= 3 * np.maximum(probe_sizes[:, None], own[None, :])
    flat = np.concatenate([sets[k] for k in order])
    values, code = np.unique(flat, return_inverse=True)
    start = np.cumsum(length) - length
    # which probes have a token
    tokens, prober = np.concatenate(probes), np.repeat(np.arange(len(probes)), [len(p) for p in probes])
    at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
    known = values[at] == tokens
    at, prober = at[known], prober[known]
    by_value = np.argsort(at, kind="stable")
    having, first = prober[by_value], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(values)))])
    overlap = np.zeros((len(probes), len(sets)), np.int32)
    for depth in range(int(length.max())):
        rows = np.flatnonzero((length > depth) & alive.any(axis=0))
        if not len(rows):
            break
        # rows below one node follow each other: a node begins where depth tokens at most are shared
        begins = np.maximum.accumulate(np.where(common <= depth, np.arange(len(sets)), 0))
        nodes, below = np.unique(begins[rows], return_inverse=True)
        token = code[start[rows[np.searchsorted(below, np.arange(len(nodes)))]] + depth]
        gained = np.zeros((len(probes), len(nodes)), bool)
        for k, t in enumerate(token):
            gained[having[first[t] : first[t + 1]], k] = True
        overlap[:, rows] += gained[:, below]
        left = length[rows] - depth - 1
        alive[:, rows] &= overlap[:, rows] + left >= need[:, rows]
    found = list(zip(*(x.tolist() for x in np.nonzero((overlap >= need) & alive)), strict=True))
    # a spanning forest of the links over the groups
    root: dict[int, int] = {}

    def top(g: int) -> int:
        while (up := root.get(g, g)) != g:
            root[g] = root.get(up, up)
            g = up
        return g

    kept = []
    for x, y in found:
        a, b = top(int(probe_group[x])), top(int(own_group[y]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((x, order[y]))
    return kept


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for the nodes of links (a, b). Each round is a table in the shared folder,
    and counts the nodes it moved while it is written."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"))
    parents = written(edges.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("over"))
        lifted = parents.join(above, "root").select("node", "root", "over")
        beside = edges.join(lifted.select(F.col("node").alias("other"), F.col("over").alias("beside")), "other")
        lowest = beside.groupBy("node").agg(F.min("beside").alias("low"))
        met = lifted.join(lowest, "node").select("node", "root", F.least("over", "low").alias("low"))
        offers = met.select("node", F.explode(F.array(F.struct("node", "root"), F.struct(F.col("root").alias("node"), F.lit(None).cast("long").alias("root")))).alias("to"), "low")
        after = offers.groupBy(F.col("to.node").alias("node")).agg(F.min("low").alias("root"), F.max("to.root").alias("before"))
        moved = Observation()
        parents = written(after.observe(moved, F.count_if(F.col("root") != F.col("before")).alias("moved")).select("node", "root"))
        if not moved.get["moved"]:
            return parents


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by the overlap of their tokens."""
    a = sets.select(F.col("set_key").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    with_a = pairs.join(a, "a")
    b = sets.select(F.col("set_key").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    counted = pairs.groupBy("b").agg(F.count("*").alias("members")).join(b, "b")
    both = joined_on_groups(with_a, counted, "b")
    overlap = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * overlap >= 75 * (F.col("a_n") + F.col("b_n") - overlap)).select("a", "b")


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component, component_id of every row: documents link at a Jaccard similarity of 0.75 or more.

    Words are what white space (space, tab to carriage return) separates, A-Z in lower case; a text of fewer than five
    is one shingle; without words, or null, it is empty and alone. component_id is the smallest doc_id of those
    reachable by links; a null doc_id is nobody's smallest (a component of nulls only has null). component names the
    component whatever the ids are (null for an empty set); text_hash is the xxhash64 of the text. Equal rows come out alike, each with its row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = written(set_sizes(docs))
    classes = written(sized.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.count("*").alias("members")
    ))
    total = sized.agg(F.sum("n_shingles").alias("entries"), F.count("*").alias("rows")).first()
    buckets = max((total["entries"] or 0) // BUCKET_ENTRIES + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    common = common_shingles(docs, total["rows"])
    entries = shared_shingles(docs, buckets, common)
    gathered = entries.groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    sets = written(
        gathered.join(classes.select("set_key", "n"), "set_key").where(100 * F.size("tokens") >= 75 * F.col("n"))
        .select("set_key", "n", F.col("tokens.token").alias("tokens"))
    )
    least = F.expr("(3 * n + 3) div 4").cast("int")
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)
    prefixes = written(sets.select("set_key", (F.col("n") - F.size("tokens")).alias("alone"), F.explode(prefix).alias("token")))

    # each set with the most ordinary one of its prefix shingles
    hubs = prefixes.groupBy("token").agg(F.min(F.struct("alone", "set_key")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    pairs = joined_on_groups(prefixes, hubs, "token").where("set_key <> hub.set_key").select(F.col("set_key").alias("a"), F.col("hub.set_key").alias("b"))
    first_links = written(verified(written(pairs.distinct()), sets))
    joined = components(first_links)

    # clusters by prefix shingles that still have several components
    placed = written(
        prefixes.drop("alone").join(joined.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    )
    open_tokens = placed.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("set_key").alias("hub"), F.count("*").alias("members")
    ).where("low <> high and members > 2").drop("low", "high")
    held = written(joined_on_groups(placed, open_tokens, "token").select("set_key", "root", "hub").distinct())
    clusters = components(held.select(F.col("set_key").alias("a"), F.col("hub").alias("b"))).toDF("set_key", "cluster")
    members = written(held.select("set_key", "root").distinct().join(clusters, "set_key").join(sets.select("set_key", "n"), "set_key"))
    parts = members.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    largest = parts.groupBy("cluster").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("members"))
    largest = largest.select("cluster", "members", F.col("members").alias("all"), F.col("most.root").alias("main"), (F.col("members") - F.col("most.size")).alias("rest"))
    dealt = joined_on_groups(members, largest, "cluster")
    blocks = dealt.select(
        "set_key", "root", "cluster", (F.col("root") != F.col("main")).alias("probe"),
        F.ceil(F.col("rest") / BLOCK_SETS).cast("int").alias("probe_blocks"), F.ceil(F.col("all") / BLOCK_SETS).cast("int").alias("blocks"),
    )

    def block(count: str):
        return F.pmod(F.xxhash64("set_key"), F.greatest(F.col(count), F.lit(1))).cast("int")

    as_sets = blocks.where("probe_blocks > 0").select(
        "set_key", "root", "cluster", F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1)).alias("i"), block("blocks").alias("j")
    )
    as_probes = blocks.where("probe").select(
        "set_key", "root", "cluster", "probe", block("probe_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    )
    full = as_sets.unionByName(as_probes).join(sets, "set_key")

    def compare(group: pa.Table) -> pa.Table:
        keys, roots, sizes = (np.asarray(group.column(c)) for c in ("set_key", "root", "n"))
        lists = group.column("tokens").combine_chunks()
        values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
        tokens = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        probe = np.asarray(group.column("probe").combine_chunks().cast(pa.int8())).astype(bool)
        p, t = np.flatnonzero(probe), np.flatnonzero(~probe)
        if not len(p) or not len(t):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        found = tree_links([tokens[k] for k in p], sizes[p], roots[p], [tokens[k] for k in t], sizes[t], roots[t])
        return pa.table({"a": pa.array([keys[p[x]] for x, _ in found], pa.int64()), "b": pa.array([keys[t[y]] for _, y in found], pa.int64())})

    last_links = full.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")
    links = written(first_links.union(last_links.distinct()))
    roots = components(links).withColumnRenamed("node", "set_key")
    placed_classes = classes.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    smallest = placed_classes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    of_class = joined_on_groups(placed_classes.select("set_key", "root", F.col("members").alias("copies")), smallest, "root")
    of_class = written(of_class.select("set_key", F.col("root").alias("component"), "component_id", F.col("copies").alias("members")))
    met = joined_on_groups(sized.where("n_shingles > 0"), of_class, "set_key").select("doc_id", "text_hash", "n_shingles", "component", "component_id")
    alone = sized.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return met.unionByName(alone)
