"""Near duplicates by SimHash fingerprints, found with the binary Golay code.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the perfect (23, 12) Golay code with leading
zeros. Decoding gives the indices of all codewords within four bits of a segment: one where the nearest codeword is up to two
bits away, six where it is three bits away. Two properties follow (tests/llm checks both on all syndromes):

- segments that differ in two bits or fewer have an index in common;
- if they differ in one bit, their parities differ, and the nearest codeword of either is among the indices of the other.

Fingerprints that link differ in four bits or fewer. Let a <= b <= c be the errors of their segments. Either a is 0, then b
is 2 at most; or a and b are both 1. So they have one of these keys in common:

- one segment as it is, with an index of another segment: six families of 33 or 34 bits, 32 keys on average;
- indices of two segments, only the nearest where the segment's parity is even, with the bit by which the parities differ and
  one third of the remaining segment: it has two errors at most, so one of its thirds has none. Nine families of 32 or 33
  bits, 90 keys on average.

A fingerprint has a key once, and one in each family at least, so no key has more than one in six of all rows of keys. Fingerprints
with a common key are joined and verified on all 64 bits, first by the keys with a whole segment, then by the others. Each is
compared with the least of its key; links make components; then only keys that still hold several components are compared in
full, in blocks, and a block hands on a spanning forest, so a group of copies costs links in proportion to its size.
Nothing is left out: a pair goes unverified only if its fingerprints are in one component already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.ngram_join import components
from quarterdeck.llm.shared import joined_on_groups, written
from quarterdeck.llm.words import Run, runs

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: The generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and its length.
GENERATOR, LENGTH = 0b110001110101, 23
#: Widths of the segments, from the lowest bit.
WIDTHS = (22, 21, 21)
#: Shingles handled at a time.
STEP = 1 << 16
#: Sets of fingerprints of one key up to this size are joined as they are; larger ones in blocks. Results do not depend on it.
SMALL, BLOCK = 64, 1000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _joined(run: Run) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The run's words in lower case with one space between, and where each begins and ends."""
    length = run.end - run.start
    start = np.cumsum(length + 1) - (length + 1)
    at = np.repeat(run.start - start, length + 1) + np.arange(int((length + 1).sum()))
    data = _LOWER[run.data[np.minimum(at, len(run.data) - 1)]]
    data[start + length] = 32
    return data.tobytes(), start, start + length


def run_fingerprints(run: Run) -> np.ndarray:
    """Fingerprints of the rows of a run, as unsigned 64-bit values."""
    rows = len(run.offsets) - 1
    out = np.zeros(rows, np.uint64)
    if not len(run.start):
        return out
    data, start, end = _joined(run)
    count = run.counts()
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(rows), shingles)
    begin = first[row] + np.arange(len(row)) - (np.cumsum(shingles) - shingles)[row]
    last = np.minimum(begin + SHINGLE, first[row] + count[row]) - 1
    a, b = start[begin].tolist(), end[last].tolist()
    votes = np.zeros((rows, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(row), STEP):
        hashes = np.array([digest(data[x:y], SEED) for x, y in zip(a[k : k + STEP], b[k : k + STEP], strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = row[k : k + STEP]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        votes[of[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (64 bits as a long) of every row; a text without words, or null, has 0."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [run_fingerprints(run) for run in runs(batch.column(1))]
            values = np.concatenate(made) if made else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, fingerprint long")


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits of a word; for each remainder its errors of up to four bits, the
    lightest first, and how many these are (1 or 6)."""
    low = np.array([_remainder(k) for k in range(1 << 12)], np.int64)
    high = np.array([_remainder(k << 12) for k in range(1 << 11)], np.int64)
    errors = np.zeros((1 << 11, 6), np.int64)
    found = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            error = sum(1 << p for p in places)
            s = _remainder(error)
            errors[s, found[s]] = error
            found[s] += 1
    return low, high, errors, found


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits of each 23-bit word, the nearest first, six columns; how many count."""
    low, high, errors, found = _decoder()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ errors[s]) >> 11, found[s]


def _segments(values: np.ndarray) -> list[np.ndarray]:
    shift, parts = 0, []
    for width in WIDTHS:
        parts.append((values >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    return parts


def whole_segment_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the fingerprints (unsigned) with a whole segment, and the position of the fingerprint that each belongs to."""
    own, parts = np.arange(len(values)), _segments(values)
    decoded = [codeword_indices(p) for p in parts]
    near = [np.arange(6) < found[:, None] for _, found in decoded]
    keys, of = [], []
    for family, (exact, other) in enumerate(permutations(range(3), 2)):
        keys.append((family << 40 | parts[exact][:, None] << 12 | decoded[other][0])[near[other]])
        of.append(np.broadcast_to(own[:, None], near[other].shape)[near[other]])
    return np.concatenate(keys), np.concatenate(of)


def two_error_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys with indices of two segments, and the position of the fingerprint that each belongs to."""
    own, parts = np.arange(len(values)), _segments(values)
    decoded = [codeword_indices(p) for p in parts]
    odd = [np.bitwise_count(p) & 1 for p in parts]
    near = [(np.arange(6) < found[:, None]) & ((np.arange(6) == 0) | (o[:, None] == 1)) for (_, found), o in zip(decoded, odd, strict=True)]
    keys, of, family = [], [], 6
    for a, b, rest in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        both = near[a][:, :, None] & near[b][:, None, :]
        differ = (odd[a] ^ odd[b]).astype(np.int64)[:, None, None]
        pair = (decoded[a][0][:, :, None] << 13 | decoded[b][0][:, None, :] << 1 | differ)[both]
        of_pair = np.broadcast_to(own[:, None, None], both.shape)[both]
        for third in (parts[rest] & 0x7F, parts[rest] >> 7 & 0x7F, parts[rest] >> 14):  # 7, 7 and the last 7 or 8 bits
            keys.append(family << 40 | pair << 8 | third[of_pair])
            of.append(of_pair)
            family += 1
    return np.concatenate(keys), np.concatenate(of)


def keyed(values: DataFrame, keys_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """key, fp, root: keys of the distinct fingerprints of values (fp, root)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4000):
                fp, root = (np.asarray(whole.column(c))[k : k + 4000] for c in (0, 1))
                keys, of = keys_of(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[of]), pa.array(root[of])], ["key", "fp", "root"])

    return values.select("fp", "root").mapInArrow(spread, "key long, fp long, root long")


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS


def forest(values: np.ndarray, roots: np.ndarray, others: np.ndarray, other_roots: np.ndarray) -> list[tuple[int, int]]:
    """Links (position, other position) of fingerprints of different components, as few as join what they join."""
    up: dict[int, int] = {}

    def top(g: int) -> int:
        while (over := up.get(g, g)) != g:
            up[g] = up.get(over, over)
            g = over
        return g

    kept = []
    for k in range(len(values)):
        for other in np.flatnonzero((np.bitwise_count(others ^ values[k]) <= MOST_BITS) & (other_roots != roots[k])).tolist():
            x, y = top(int(roots[k])), top(int(other_roots[other]))
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append((k, other))
    return kept


def _links_of_large_keys(rows: DataFrame) -> DataFrame:
    """a, b: links between the components of each key of rows (key, fp, root, members), compared in blocks of BLOCK rows."""
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("fp"), count).cast("int")).withColumn("blocks", count)
    first = own.select("key", "fp", "root", F.lit(True).alias("first"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    second = own.select("key", "fp", "root", F.lit(False).alias("first"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        fp, root = (np.asarray(group.column(c)) for c in ("fp", "root"))
        left = np.asarray(group.column("first").combine_chunks().cast(pa.int8())).astype(bool)
        a, b = fp[left], fp[~left]
        found = forest(a, root[left], b, root[~left])
        return pa.table({"a": pa.array([a[x] for x, _ in found], pa.int64()), "b": pa.array([b[y] for _, y in found], pa.int64())})

    return first.unionByName(second).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def fingerprint_links(values: DataFrame) -> DataFrame:
    """a, b: links between the distinct fingerprints of values (column fp) that make the same components as all links.

    First over the keys with a whole segment, then over the others, of which only those matter that hold several of the
    components known by then."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, found = values.select("fp", F.col("fp").alias("root")), []
    for keys_of in (whole_segment_keys, two_error_keys):
        dealt = keyed(placed, keys_of).repartition(parts, "key")
        hubs = dealt.groupBy("key").agg(
            F.min("fp").alias("hub"), F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")
        ).where("low <> high").drop("low", "high")
        met = written(dealt.drop("root").join(hubs, "key"))
        near = met.where((F.col("fp") != F.col("hub")) & _close(F.col("fp"), F.col("hub")))
        found.append(written(near.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()))
        roots = components(reduce(DataFrame.unionByName, found)).withColumnRenamed("node", "fp")
        placed = written(values.select("fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        found.append(written(_links_of_open_keys(met, placed)))
    return reduce(DataFrame.unionByName, found)


def _links_of_open_keys(met: DataFrame, placed: DataFrame) -> DataFrame:
    """a, b: links between the fingerprints of each key of met (key, fp, members) that are in different components (fp, root)."""
    rows = written(met.where("members > 2").select("key", "fp").join(placed, "fp"))
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high")
    left = written(rows.join(several.select("key", "members"), "key"))
    few = left.where(F.col("members") <= SMALL).select("key", "fp", "root")
    other = few.select(F.col("key").alias("of_key"), F.col("fp").alias("b"), F.col("root").alias("of_root"))
    near = (F.col("key") == F.col("of_key")) & (F.col("fp") < F.col("b")) & (F.col("root") != F.col("of_root")) & _close(F.col("fp"), F.col("b"))
    in_small = few.join(other, near).select(F.col("fp").alias("a"), "b")
    return in_small.unionByName(_links_of_large_keys(left.where(F.col("members") > SMALL))).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id of every row of docs (doc_id, text).

    Whole texts; A-Z in lower case; words are what white space (space, tab to carriage return) separates; shingles are runs of
    four words, repeats included, fewer words are one shingle. A bit is 1 if more than half of the shingles' XXH64 values have
    it. Texts without words, and nulls, have fingerprint 0, which links like any other. Documents link at four differing bits
    or fewer; component_id is the smallest doc_id reachable, null doc_ids aside (a component of nulls only has null). Equal
    rows come out alike, each with its row; an empty table gives no rows; other columns are not read.
    """
    own = written(fingerprints(docs))
    classes = written(own.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("members")))
    roots = components(fingerprint_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    placed = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = written(placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")))
    named = joined_on_groups(placed.select("fp", "root", F.col("members").alias("copies")), least, "root")
    named = written(named.select(F.col("fp").alias("fingerprint"), "component_id", F.col("copies").alias("members")))
    met = joined_on_groups(own, named, "fingerprint")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
