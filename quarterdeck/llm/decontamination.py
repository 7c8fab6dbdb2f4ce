"""Short benchmark items inside long documents: bottom-k MinHash sketches sized by the item, verified by exact containment.

MinHash of whole sets is blind here: an item of thirty shingles is a thousandth of a long document. So the sketch is
asymmetric: an item has the k smallest hashes of its own shingles, a document has the hashes of all of its shingles, and
a pair is compared where one hash of the sketch is the document's. An item of m shingles of which r must be there can miss
m - r of them, so with k = m - r + 1 at least one of the sketch is in every document that contains the item, however the
words were changed, inserted, doubled or moved, and whatever other items are in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CONTAINMENT = 0.75
#: A table of so many rows (16 bytes each) may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[ \\t-\\r]+"), "")


def shingle_hashes(words: str) -> Column:
    """64-bit hashes of the runs of five words in the array column; of all words as one where there are fewer."""
    size = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), size - SHINGLE_WORDS), lambda k: F.xxhash64(*(F.get(words, k + i) for i in range(SHINGLE_WORDS)))
    )
    return F.when(size >= SHINGLE_WORDS, runs).when(size > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))


def shingle_texts(words: str) -> Column:
    """The distinct shingles themselves."""
    size = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), size - SHINGLE_WORDS), lambda k: F.array_join(F.slice(words, k + 1, SHINGLE_WORDS), " "))
    whole = F.when(size > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(size >= SHINGLE_WORDS, runs).otherwise(whole))


def sketch(shingles: str, hashes: str, containment: float) -> Column:
    """The smallest hashes, one more than there are shingles that may be missing."""
    size = F.size(shingles)
    missing = size - F.ceil(F.lit(containment) * size).cast("int")
    return F.slice(F.sort_array(F.array_distinct(hashes)), F.lit(1), F.greatest(missing + 1, F.lit(1)))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its rows, as counted, are few; else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_table(benchmark: DataFrame) -> DataFrame:
    """item (a struct of item_id, which may be null), words and shingles (distinct, as texts) of the items that have a word."""
    items = benchmark.select(F.struct("item_id").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return items.distinct().select("item", "words", shingle_texts("words").alias("shingles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_hash, item_id, item_shingles, shared_shingles: the items found in each document, one row a pair.

    Words are what white space (space, tab to carriage return) separates, in lower case; an item is found if `containment`
    of its distinct five-word shingles are among the document's. A text of fewer words is one shingle, so such an item
    is found in documents of just these words only. Null or wordless texts contain nothing and are found nowhere. Rows that
    share doc_id and text are one document, equal items are one item; a null doc_id or item_id is an id like others.
    """
    items = item_table(benchmark)
    hashed = items.select("item", "shingles", shingle_hashes("words").alias("hashes"))
    lookup = hashed.select("item", F.explode(sketch("shingles", "hashes", containment)).alias("hash"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    entries = lookup.count()

    cut = own.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    signed = cut.select("doc_id", "text_hash", F.array_distinct(shingle_hashes("words")).alias("hashes"))
    # the outer form, as the filter that Spark adds to the inner one would take the hashes a second time
    each = signed.select("doc_id", "text_hash", F.explode_outer("hashes").alias("hash"))
    found = each.join(sized(lookup, entries), "hash")
    candidates = found.groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("found_items"))

    # exact: the shingles of both, as texts
    wanted = candidates.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "found_items")
    met = own.join(wanted, own["doc_id"].eqNullSafe(F.col("of_id")) & (F.xxhash64(own["text"]) == F.col("of_hash")))
    met = met.dropDuplicates(["of_id", "of_hash"]).select(
        "doc_id", F.col("of_hash").alias("text_hash"), "found_items", words_of(F.col("text")).alias("words")
    )
    pairs = met.select("doc_id", "text_hash", F.explode("found_items").alias("item"), shingle_texts("words").alias("own_shingles"))
    pairs = pairs.join(sized(items.select("item", "shingles"), entries), "item")
    counted = pairs.select(
        "doc_id", "text_hash", "item.item_id", F.size("shingles").cast("long").alias("item_shingles"),
        F.size(F.array_intersect("shingles", "own_shingles")).cast("long").alias("shared_shingles"),
    )
    return counted.where(F.col("shared_shingles") >= containment * F.col("item_shingles"))
