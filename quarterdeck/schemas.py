"""Declared types of the research tables; nothing is inferred from files."""

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
FIGURES = T.MapType(T.StringType(), T.StringType())


def _struct(**fields):
    return T.StructType([T.StructField(n, t if isinstance(t, T.DataType) else t()) for n, t in fields.items()])


QUOTE = _struct(speaker=T.StringType, theme=T.StringType, text=T.StringType)
NEWS_ITEM = _struct(date=T.StringType, source=T.StringType, headline=T.StringType, snippet=T.StringType, tags=TEXTS)
ANNUAL = _struct(form=T.StringType, filing_date=T.StringType, period_end=T.StringType, financials=FIGURES)
FETCHER = _struct(tier=T.IntegerType, method=T.StringType, model=T.StringType, note=T.StringType)
QUARTER = _struct(
    quarter=T.StringType, fiscal_year=T.StringType, date=T.StringType, period_end=T.StringType, speakers=TEXTS,
    financials=FIGURES, key_quotes=T.ArrayType(QUOTE), key_themes=TEXTS, risks=TEXTS, tone=T.StringType,
    source=T.StringType, source_url=T.StringType, data_quality=T.StringType, error=T.StringType,
)
COMPANY_DOC = _struct(
    company=T.StringType, ticker=T.StringType, sector=T.StringType, industry=T.StringType,
    last_updated=T.StringType, fetcher=FETCHER, annual_filings=T.ArrayType(ANNUAL),
    transcripts=T.ArrayType(QUARTER), news=T.ArrayType(NEWS_ITEM),
)
REGISTRY_ENTRY = _struct(
    name=T.StringType, ticker=T.StringType, file=T.StringType, fiscal_year_note=T.StringType, transcripts=TEXTS,
    transcript_count=T.LongType, news_items=T.LongType, next_earnings=T.StringType, primary_themes=TEXTS,
)
REGISTRY_FILE = T.StructType([T.StructField("companies", T.ArrayType(REGISTRY_ENTRY))])
RAW_TRANSCRIPT = _struct(
    company=T.StringType, ticker=T.StringType, year=T.IntegerType, quarter=T.IntegerType,
    quarter_label=T.StringType, conference_date=T.StringType, speakers=TEXTS, transcript_length=T.LongType,
    key_numbers=FIGURES, full_text=T.StringType, prepared_remarks=T.StringType,
    questions_and_answers=T.StringType, fetched_at=T.TimestampType, source=T.StringType, event_no=T.LongType,
)
FACT = _struct(
    accession=T.StringType, ord=T.LongType, label=T.StringType, abstract=T.BooleanType, dim=T.StringType,
    period=T.StringType, period_pos=T.IntegerType, val=T.DoubleType,
)
