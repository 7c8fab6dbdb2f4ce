"""Call events to raw transcript records and indexes."""

from pyspark.sql import Column, DataFrame

from quarterdeck import fixed_values as V
from quarterdeck.operators import calls as CA
from quarterdeck.sources.tables import read_transcript_events


def call_records(
    events: DataFrame, transcripts: DataFrame, n: int = V.QUARTERS, fetched_at: Column | None = None
) -> DataFrame:
    return CA.raw_transcripts(read_transcript_events(events, transcripts, n), fetched_at)
