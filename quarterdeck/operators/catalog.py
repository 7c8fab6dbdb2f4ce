"""Registry and company documents: listing, lookup, counts, assembly, upsert."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck import schemas as S
from quarterdeck.functions import text as X
from quarterdeck.operators.shared import ordered_list


class CompanyNotFound(ValueError):
    """No registered company has the key; ``available`` is the table of names."""

    def __init__(self, key: str, available: DataFrame):
        super().__init__(f"Company '{key}' not found")
        self.available = available


def list_companies(registry: DataFrame) -> DataFrame:
    return registry.orderBy("pos").select("name")


def _by_key(registry: DataFrame) -> DataFrame:
    """One row per name or ticker in lower case: the first registry entry that has it."""
    entry = F.struct(*[F.col(c) for c in registry.columns])
    keys = F.array_distinct(F.array(F.lower("name"), F.lower("ticker")))
    return registry.select(F.explode(keys).alias("lookup_key"), entry.alias("entry")).groupBy("lookup_key").agg(
        F.min_by("entry", "entry.pos").alias("entry")
    )


def lookup_batch(registry: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Each key with the first entry whose name or ticker it is, in any case.

    The registry side has one row per key, so the join neither multiplies rows
    nor needs an OR condition; keys without a match stay with ``found = false``.
    """
    named = keys.withColumn("lookup_key", F.lower(key))
    # missing keys match nothing and would all meet in one task
    some, none = named.filter("lookup_key is not null"), named.filter("lookup_key is null")
    found = some.join(_by_key(registry), "lookup_key", "left")
    entry = found.schema["entry"].dataType
    found = found.unionByName(none.withColumn("entry", F.lit(None).cast(entry)))
    return found.drop("lookup_key").select(
        *keys.columns, "entry.*", F.col("entry").isNotNull().alias("found")
    )


def lookup(registry: DataFrame, key: str) -> DataFrame:
    """The first entry whose name or ticker equals the key, in any case (one row or none)."""
    matches = (F.lower("name") == key.lower()) | (F.lower("ticker") == key.lower())
    return registry.filter(matches).orderBy("pos").limit(1)


def company_document(registry: DataFrame, docs: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """The whole document of one company.

    ``docs`` with a ``bucket`` (``sinks.write_company_table``, with the same
    number of buckets) are pruned by the file that the lookup finds: the scan
    reads one folder. Documents that are still to be made are best made of one
    company only: see ``one_company``.
    """
    found = lookup(registry, key).select("file")
    if "bucket" not in docs.columns:
        return docs.join(found, "file", "left_semi")
    placed = found.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int"))
    return docs.join(F.broadcast(placed), ["bucket", "file"], "left_semi")  # one row at most


def one_company(registry: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """The rows of ``companies`` (with ``file``) that the key finds: one, to make one document of instead of all."""
    return companies.join(F.broadcast(lookup(registry, key).select("file")), "file", "left_semi")


def require_company(registry: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """As ``company_document``, but an unknown key is an error."""
    if lookup(registry, key).isEmpty():
        raise CompanyNotFound(key, list_companies(registry))
    return company_document(registry, docs, key)


def registered(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents joined to their registry row by file name."""
    return docs.join(registry.select("file", "pos"), "file", "inner")


def unregistered(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that no registry row points to, and so cannot be looked up."""
    return docs.join(registry.select("file"), "file", "left_anti")


def company_detail(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Name, ticker, sector and list sizes of every registered document, with registry order."""
    return registered(registry, docs).select(
        "pos",
        F.col("company").alias("name"),
        "ticker",
        F.coalesce("sector", F.lit("")).alias("sector"),
        F.coalesce(F.size("transcripts"), F.lit(0)).cast("long").alias("transcript_count"),
        F.coalesce(F.size("news"), F.lit(0)).cast("long").alias("news_count"),
    )


def count_by_company(companies: DataFrame, quarters: DataFrame, news: DataFrame) -> DataFrame:
    """Quarters and news per company from flat tables; counts are combined before the shuffle."""
    n_quarters = quarters.groupBy("ticker").agg(F.count("*").alias("transcript_count"))
    n_news = news.groupBy("ticker").agg(F.count("*").alias("news_count"))
    return companies.join(n_quarters, "ticker", "left").join(n_news, "ticker", "left").na.fill(
        0, ["transcript_count", "news_count"]
    )


def _items(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    element = docs.schema[column].dataType
    listed = F.coalesce(F.col(column), F.array().cast(element))
    return docs.select(*keep, F.posexplode(listed).alias("pos", "item"))


def news_of(docs: DataFrame) -> DataFrame:
    """Every news item in document order; a missing list is an empty one."""
    return _items(docs, "news", "ticker").select("ticker", "pos", "item.*")


def quarters_of(docs: DataFrame) -> DataFrame:
    """Every quarter record; ``pos`` is its place in the document."""
    return _items(docs, "transcripts", "ticker", "company").select("ticker", "company", "pos", "item.*")


def annual_filings_of(docs: DataFrame) -> DataFrame:
    return _items(docs, "annual_filings", "ticker").select("ticker", "pos", "item.*")


def collect_quarters(quarters: DataFrame, ord_by: Column, record: Column) -> DataFrame:
    """Quarter records of a company as one ordered list. Limit the quarters first."""
    return quarters.groupBy("ticker").agg(ordered_list(ord_by, record).alias("transcripts"))


def quarter_record(**columns: Column) -> Column:
    """A quarter struct with every field of the schema; fields not given are null."""
    return F.struct(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.QUARTER.fields
    ])


def fetcher_block(tier: int, method: str, model: str, note: str) -> Column:
    """Provenance of a document: how it was collected and with which model."""
    return F.struct(
        F.lit(tier).alias("tier"), F.lit(method).alias("method"), F.lit(model).alias("model"), F.lit(note).alias("note")
    )


def assemble_company(
    info: DataFrame, *lists: DataFrame, last_updated: Column | None = None, fetcher: Column | None = None
) -> DataFrame:
    """Company documents from info and tables of collected lists (one row per ticker each).

    A list that a company has no row for is empty; a list that no table brings
    is left out (null), as in documents that never had it.
    """
    docs = info
    for part in lists:
        docs = docs.join(part, "ticker", "left")
    made = {
        "last_updated": F.current_date() if last_updated is None else last_updated,
        "fetcher": F.lit(None) if fetcher is None else fetcher,
    }

    def column(field):
        brought = field.name in docs.columns
        value = made.get(field.name, F.col(field.name) if brought else F.lit(None)).cast(field.dataType)
        if isinstance(field.dataType, T.ArrayType) and (brought or field.name == "transcripts"):
            value = F.coalesce(value, F.array().cast(field.dataType))
        return value.alias(field.name)

    return docs.select(*[column(f) for f in S.COMPANY_DOC.fields])


def upsert_registry(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Registry after a batch of updates (ticker, name, transcript_count, news_items, update_no).

    A known ticker gets a new name, file and counts, and keeps all else; an
    unknown one is appended with empty note, labels and themes. Of several
    updates of one ticker the last counts. Appended rows are marked and ordered
    by ``pos`` among themselves, which needs no global numbering.
    """
    fresh = updates.groupBy("ticker").agg(
        F.max_by(F.struct("name", "transcript_count", "news_items"), "update_no").alias("new"),
        F.min("update_no").alias("first_no"),
    )
    old = registry.select("ticker", F.struct(*[F.col(c) for c in registry.columns]).alias("old"))
    both = old.join(fresh, "ticker", "full_outer")
    is_new, updated = F.col("old").isNull(), F.col("new").isNotNull()
    no_texts = F.array().cast("array<string>")

    def either(name: str, value: Column) -> Column:
        return F.when(updated, value).otherwise(F.col(f"old.{name}")).alias(name)

    return both.select(
        is_new.alias("appended"),
        F.when(is_new, F.col("first_no")).otherwise(F.col("old.pos")).cast("long").alias("pos"),
        either("name", F.col("new.name")),
        "ticker",
        either("file", X.document_file(F.col("ticker"))),
        F.when(is_new, F.lit("")).otherwise(F.col("old.fiscal_year_note")).alias("fiscal_year_note"),
        F.when(is_new, no_texts).otherwise(F.col("old.transcripts")).alias("transcripts"),
        either("transcript_count", F.col("new.transcript_count")),
        either("news_items", F.col("new.news_items")),
        F.col("old.next_earnings").alias("next_earnings"),
        F.when(is_new, no_texts).otherwise(F.col("old.primary_themes")).alias("primary_themes"),
    )
