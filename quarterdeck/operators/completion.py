"""Batch completion of prompts by a function that the caller supplies."""

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck import fixed_values as V
from quarterdeck.operators.shared import exists

OUTCOME = [
    T.StructField("reply", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("tokens_in", T.LongType()),
    T.StructField("tokens_out", T.LongType()),
]


def _ask(fn, system, user, max_retries, wait, clock):
    for attempt in range(1, max_retries + 2):
        started = clock()
        try:
            answer = fn(system, user)
        except Exception:  # whatever a service may raise counts as a failed attempt
            if attempt <= max_retries:
                time.sleep(wait * attempt)
            continue
        text, tokens_in, tokens_out = answer if isinstance(answer, tuple) else (answer, 0, 0)
        return text or "", attempt, clock() - started, tokens_in or 0, tokens_out or 0
    return "", max_retries + 1, None, 0, 0


def complete(
    prompts: DataFrame,
    fn: Callable[[str, str], str | tuple],
    max_retries: int = V.RETRIES,
    wait: float = V.RETRY_WAIT_SECONDS,
    parallelism: int | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """Prompts (system, user, any flat key columns) with a reply for each.

    ``fn(system, user)`` gives the reply, or (reply, tokens in, tokens out). A
    failing call is tried again after ``wait`` seconds, then twice that and so
    on; when all fail the reply is an empty text. ``parallelism`` spreads the
    prompts evenly over so many tasks, and no more calls than that run at once.
    A lost task calls ``fn`` again for its rows: many small tasks lose little,
    and costly replies should be settled before they are used twice, or kept
    in a store (``complete_stored``). ``clock`` tells the seconds.
    """
    names = [*prompts.columns, *[f.name for f in OUTCOME]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [_ask(fn, s, u, max_retries, wait, clock) for s, u in zip(batch["system"], batch["user"])]
            outcome = pd.DataFrame(answers, columns=names[-len(OUTCOME):], index=batch.index)
            yield pd.concat([batch, outcome], axis=1)

    spread = prompts.repartition(parallelism) if parallelism else prompts
    return spread.mapInPandas(run, T.StructType([*prompts.schema.fields, *OUTCOME])).withColumn(
        "result_chars", F.length("reply").cast("long")
    )


def prompt_key(label: Column, system: Column, user: Column) -> Column:
    """What a reply is stored under: equal for equal prompts (SHA-256 of label, system and user, each with its length)."""
    parts = [F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (label, system, user)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


STORED = T.StructType([T.StructField("prompt_key", T.StringType()), *OUTCOME])


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """The replies in a store, one for each prompt: an answer rather than a failure, of several the longest.

    Every run has a folder of its own: scans of one folder before and after it was written to would count as the same to
    Spark, which then reuses the earlier one."""
    if not exists(spark, f"{store}/run-*"):
        return spark.createDataFrame([], STORED)
    outcome = F.struct(*[F.col(f.name) for f in OUTCOME])
    best = F.max_by(outcome, F.struct(F.col("latency").isNotNull(), F.length("reply"), "reply"))
    return spark.read.schema(STORED).parquet(f"{store}/run-*").groupBy("prompt_key").agg(best.alias("_o")).select("prompt_key", "_o.*")


def complete_stored(
    prompts: DataFrame, fn: Callable[[str, str], str | tuple], store: str, parts: int = 200, **completion
) -> DataFrame:
    """As ``complete``, with replies kept in a store, so that a run that failed asks only for the rest.

    Prompts need a ``label``. Each distinct (label, system, user) is asked once;
    those that the store has an answer for are not asked, those whose calls all
    failed are asked again. What is asked is dealt to ``parts`` tasks, and the
    replies of a task are in the store as soon as it ends, whatever becomes of
    the others: a run that stops loses the tasks at work. A task that ran twice
    leaves two rows for a prompt, of which one counts.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("prompt_key", prompt_key(F.col("label"), F.col("system"), F.col("user")))
    known = stored_replies(spark, store).filter("latency is not null").select("prompt_key")
    distinct = keyed.select("prompt_key", "system", "user").dropDuplicates(["prompt_key"])
    asked = distinct.join(known, "prompt_key", "left_anti").repartition(parts, "prompt_key")
    replies = complete(asked, fn, **completion).select(*STORED.names)
    # version 2 of the commit algorithm moves a task's files when the task commits, not when the job does
    replies.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{store}/run-{uuid.uuid4().hex}")
    found = keyed.join(stored_replies(spark, store), "prompt_key", "left").drop("prompt_key")
    return found.withColumn("result_chars", F.length("reply").cast("long"))


def run_stats(replies: DataFrame) -> DataFrame:
    """Per label: calls, failures, tokens, characters and seconds with one decimal."""
    seconds = F.coalesce("latency", F.lit(0.0))
    return replies.groupBy("label").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("reply") == "").alias("empty_replies"),
        F.sum("attempts").alias("attempts"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("result_chars").alias("result_chars"),
        F.max("result_chars").alias("longest_result"),
        F.round(F.sum(seconds), 1).alias("elapsed_seconds"),
        F.round(F.avg(seconds), 1).alias("average_seconds"),
        F.round(F.max(seconds), 1).alias("slowest_seconds"),
    )


METRICS = ("calls", "empty_replies", "attempts", "tokens_in", "tokens_out", "result_chars", "longest_result", "seconds", "slowest")


def observed(replies: DataFrame, labels: list[str]) -> tuple[DataFrame, Observation]:
    """The replies, and an observation that counts them by label while whatever is done with them runs.

    ``run_stats`` would read or compute the replies once more; this adds no
    shuffle and no pass. Put the returned rows to use (write them), then read
    the counts with ``observed_stats``.
    """
    seconds = F.coalesce("latency", F.lit(0.0))
    counts = []
    for i, label in enumerate(labels):
        own = F.col("label") == label
        of = [
            F.count_if(own), F.count_if(own & (F.col("reply") == "")), *[F.sum(F.when(own, F.col(c))) for c in METRICS[2:6]],
            F.max(F.when(own, F.col("result_chars"))), F.sum(F.when(own, seconds)), F.max(F.when(own, seconds)),
        ]
        counts += [c.alias(f"{name}_{i}") for name, c in zip(METRICS, of)]
    observation = Observation()
    return replies.observe(observation, *counts), observation


def observed_stats(spark: SparkSession, observation: Observation, labels: list[str]) -> DataFrame:
    """The rows of ``run_stats`` from an observation; labels without a call are left out. Waits until the rows were used."""
    got = observation.get
    rows = [(label, *[got[f"{name}_{i}"] for name in METRICS]) for i, label in enumerate(labels)]
    kinds = "label string, calls long, empty_replies long, attempts long, tokens_in long, tokens_out long, result_chars long, longest_result long, seconds double, slowest double"
    return spark.createDataFrame(rows, kinds).filter("calls > 0").select(
        *["label", *METRICS[:7]], F.round("seconds", 1).alias("elapsed_seconds"),
        F.round(F.col("seconds") / F.col("calls"), 1).alias("average_seconds"), F.round("slowest", 1).alias("slowest_seconds"),
    )
