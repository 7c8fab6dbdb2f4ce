"""Documents whose statistics are outliers for their language and source, by minimum covariance determinant.

Each text gives a vector of statistics, transformed so that ordinary texts lie about symmetrically. For the texts of each
language and source, the centre and covariance are those of the three quarters of rows whose covariance has the least
determinant, sought from several starts by concentration steps: distances under the last estimate, the nearest three
quarters, their mean and covariance. Two steps from every start, then up to three more from the best one until no determinant falls
further, then once more over all rows that are no outliers under that estimate (reweighting). Rows far away by Mahalanobis
distance are rejected. All steps are aggregates over a table of statistics; the share of nearest rows is taken from counts of
finely binned distances, so no group is gathered anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm.shared import joined_on_groups, written
from quarterdeck.llm.words import SHINGLE_WORDS, Run, runs, shingles

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_stutters")
FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "stutters")
#: Statistics that are zero in most ordinary texts. The nearest three quarters show no spread of them at all, so these standard
#: deviations stand in for it. The others get the variance of rounding to one word or character in a text of the group's
#: median length, which only keeps the matrix invertible.
MOSTLY_ZERO = {"symbols": 0.5, "dup_lines": 1.2, "repeats": 1.2, "digits": 2.0}
#: A text of n words has its deviations (but that of length) multiplied by sqrt(n / (n + PRIOR_WORDS)), as rates over few words vary more.
PRIOR_WORDS = 30
#: Rows a language and source must have for an estimate of their own; smaller ones are taken together by language, and
#: languages with too few even then with each other.
LEAST_ROWS = 100
NEAREST = 0.75
#: Steps from each start, and at most from the best; the steps end when no group's log determinant falls by more than LEAST_FALL.
FIRST_STEPS, MORE_STEPS, LEAST_FALL = 2, 3, 0.05
#: Share of ordinary rows that the reweighting step takes.
REWEIGHTED = 0.975
#: Chance of a larger distance for an ordinary row, under normal statistics.
TAIL = 1e-6
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def _mask(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOLS = _mask("#*$%&|<>")
_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _mask("0123456789")
_MARKS = _mask("!\"'(),-./:;?@[\\]^_`{}~+=")
_CHAR_START = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values in ascending groups: those equal to another of their group, and those equal to an earlier one."""
    order = np.lexsort((np.arange(len(values)), values, groups))
    same = (values[order][1:] == values[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    later = np.zeros(len(values), bool)
    later[1:] = same
    either = later.copy()
    either[:-1] |= same
    out = np.zeros((2, len(values)), bool)
    out[0, order], out[1, order] = either, later
    return out[0], out[1]


def run_counts(run: Run) -> dict[str, np.ndarray]:
    """The counts of each row of a run."""
    rows, data, own = len(run.offsets) - 1, run.data, run.offsets
    edges = np.zeros(len(data) + 1, np.int64)
    np.add.at(edges, run.start, 1)
    np.add.at(edges, run.end, -1)
    inside = np.cumsum(edges[:-1]) > 0
    count = run.counts()

    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([own[:-1], breaks + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(own, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = own[row + 1]
    same = row[1:] == row[:-1]
    end[:-1][same] = start[1:][same] - 1
    worded = np.searchsorted(run.start, start) < np.searchsorted(run.start, end)
    start, end, row = start[worded], end[worded], row[worded]
    _, later = repeated(row, run.hashes(start, end))

    words = run.words()
    stutter = run.row[1:][(words[1:] == words[:-1]) & (run.row[1:] == run.row[:-1])]
    total = np.zeros(rows, np.int64)
    if len(run.start) >= SHINGLE_WORDS:
        at = np.flatnonzero(run.row[: len(run.row) - SHINGLE_WORDS + 1] == run.row[SHINGLE_WORDS - 1 :])
        long = count >= SHINGLE_WORDS
        mine = long[run.row]
        hashes, of = shingles(words[mine], run.row[mine], rows)
        either, _ = repeated(of, hashes)
        marks = np.zeros(len(run.start) + 1, np.int64)
        np.add.at(marks, at[either], 1)
        np.add.at(marks, at[either] + SHINGLE_WORDS, -1)
        total = np.bincount(run.row[np.cumsum(marks[:-1]) > 0], minlength=rows)
    return {
        "n_words": count, "word_chars": _per_row(inside & _CHAR_START[data], own), "n_symbols": _per_row(_SYMBOLS[data], own),
        "n_dup_lines": np.bincount(row[later], minlength=rows), "n_repeat_words": total, "n_lines": np.bincount(row, minlength=rows),
        "n_upper": _per_row(_UPPER[data], own), "n_marks": _per_row(_MARKS[data], own), "n_digits": _per_row(_DIGITS[data], own),
        "n_stutters": np.bincount(stutter, minlength=rows),
    }


def text_counts(docs: DataFrame, passed: tuple[str, ...] = ()) -> DataFrame:
    """The passed columns and COUNTS of every row's whole text (null: none of anything)."""
    fields = [docs.schema[n] for n in passed]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} long" for n in COUNTS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [run_counts(run) for run in runs(batch.column(0))]
            if parts:
                counts = [pa.array(np.concatenate([p[n] for p in parts]).astype(np.int64)) for n in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(1 + k) for k in range(len(passed))] + counts, [*passed, *COUNTS])

    return docs.select("text", *passed).mapInArrow(measure, schema)


def with_features(counts: DataFrame) -> DataFrame:
    """counts and a column x_<statistic> for each of FEATURES."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))

    def share(name: str, of):
        return F.log1p(100 * F.col(name) / of)

    return counts.withColumns({
        "x_length": F.log(words), "x_word_length": F.col("word_chars") / words, "x_symbols": share("n_symbols", words),
        "x_dup_lines": share("n_dup_lines", F.greatest("n_lines", F.lit(1))), "x_repeats": share("n_repeat_words", words),
        "x_upper": share("n_upper", chars), "x_marks": share("n_marks", words), "x_digits": share("n_digits", words),
        "x_stutters": share("n_stutters", words),
    })


def chi_square(share: float, freedom: int) -> float:
    """Quantile, by Wilson and Hilferty."""
    spread = 2 / (9 * freedom)
    return freedom * (1 - spread + NormalDist().inv_cdf(share) * math.sqrt(spread)) ** 3


def consistency(share: float, freedom: int) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to be that of all."""
    spread, x = 2 / (9 * (freedom + 2)), chi_square(share, freedom)
    return share / NormalDist().cdf(((x / (freedom + 2)) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """rows with `peers`, the name of the group whose estimate a row is held against: language and source, the language, or all,
    the first of these that has least_rows rows. Rows of a group with a large part of the table stay where they are."""
    lang = F.coalesce("lang", F.lit(""))
    rows = rows.withColumn("own_group", F.concat_ws("\x1f", lang, F.coalesce("source", F.lit(""))))
    sizes = rows.groupBy("own_group").agg(F.min(lang).alias("lang"), F.count("*").alias("members"), F.count_if(~F.col("base_failed")).alias("size"))
    named = sizes.withColumn("name", F.when(F.col("size") >= least_rows, F.col("own_group")).otherwise(F.concat("lang", F.lit("\x1f\x1f"))))
    pools = named.groupBy("name").agg(F.sum("size").alias("pool"))
    named = named.join(pools, "name").select("own_group", "members", F.when(F.col("pool") >= least_rows, F.col("name")).otherwise("\x1f\x1f\x1f").alias("peers"))
    return joined_on_groups(rows, written(named), "own_group").drop("own_group")


FITTED = "peers string, start int, centre array<double>, inverse array<double>, floors array<double>, log_det double"
_NAMES = [f"x_{n}" for n in FEATURES]
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i, len(_NAMES))]


def least_spreads(medians: np.ndarray) -> np.ndarray:
    """Standard deviations that are added to the estimate's, for a group of these medians of FEATURES."""
    words = math.exp(medians[0])
    chars = words * max(medians[1], 1)
    units = {"length": 1 / words, "word_length": 1 / words, "upper": math.log1p(100 / chars)}
    return np.array([MOSTLY_ZERO.get(n, units.get(n, math.log1p(100 / words)) / math.sqrt(12)) for n in FEATURES])


def _symmetric(products, rows: int) -> np.ndarray:
    made = np.zeros((len(_NAMES), len(_NAMES)))
    for (i, j), value in zip(_PAIRS, products, strict=True):
        made[i, j] = made[j, i] = value / rows
    return made


def _fit(peers: str, start: int, centre: np.ndarray, spread: np.ndarray, floors: np.ndarray) -> tuple:
    spread = spread + np.diag(floors**2)
    inverse = np.linalg.inv(spread)
    return peers, start, centre.tolist(), [float(inverse[i, j]) for i, j in _PAIRS], floors.tolist(), float(np.linalg.slogdet(spread)[1])


def _frame(fits: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(fits, columns=["peers", "start", "centre", "inverse", "floors", "log_det"])


def starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of each group about its medians: the quartiles' spreads alone, the covariance of all rows, and that of
    all rows after each value is bounded by tanh."""

    def from_quarters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            quarters = [np.array([list(q) for q in r]) for r in frame["quarters"]]
            spreads = [(q[:, 2] - q[:, 0]) / 1.349 for q in quarters]
            columns = {"peers": frame["peers"], "medians": [q[:, 1].tolist() for q in quarters], "spreads": [x.tolist() for x in spreads]}
            yield pd.DataFrame({**columns, "floors": [least_spreads(q[:, 1]).tolist() for q in quarters]})

    def from_products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = []
            for r in frame.itertuples(index=False):
                centre, spreads, floors = (np.array(list(x)) for x in (r.medians, r.spreads, r.floors))
                scale = spreads + floors
                found = [np.diag(spreads**2)] + [_symmetric(x, r.rows) * np.outer(scale, scale) for x in (r.plain, r.bounded)]
                fits += [_fit(r.peers, k, centre, spread, floors) for k, spread in enumerate(found)]
            yield _frame(fits)

    quarters = F.array(*(F.percentile_approx(n, [0.25, 0.5, 0.75], 2000) for n in _NAMES))
    shape = "peers string, medians array<double>, spreads array<double>, floors array<double>"
    about = written(rows.groupBy("peers").agg(quarters.alias("quarters")).mapInPandas(from_quarters, shape))
    scaled = [(F.col(n) - F.get("medians", F.lit(k))) / (F.get("spreads", F.lit(k)) + F.get("floors", F.lit(k))) for k, n in enumerate(_NAMES)]
    met = rows.select("peers", *_NAMES).join(about, "peers").select(
        "peers", *(u.alias(f"u{k}") for k, u in enumerate(scaled)), *(F.tanh(u).alias(f"t{k}") for k, u in enumerate(scaled))
    )
    products = [F.array(*(F.sum(F.col(f"{c}{i}") * F.col(f"{c}{j}")) for i, j in _PAIRS)).alias(n) for c, n in (("u", "plain"), ("t", "bounded"))]
    made = met.groupBy("peers").agg(F.count("*").alias("rows"), *products)
    return written(made.join(about, "peers").mapInPandas(from_products, FITTED))


def refitted(chosen: DataFrame, share: float) -> DataFrame:
    """Mean and covariance of the chosen rows of each group and start, made consistent for the nearest share of normal rows."""
    factor = consistency(share, len(_NAMES))

    def from_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = []
            for r in frame.itertuples(index=False):
                centre = np.array(r.sums) / r.rows
                spread = (_symmetric(r.products, r.rows) - np.outer(centre, centre)) * factor
                fits.append(_fit(r.peers, int(r.start), centre, spread, np.array(list(r.floors))))
            yield _frame(fits)

    sums = F.array(*(F.sum(n) for n in _NAMES)).alias("sums")
    products = F.array(*(F.sum(F.col(_NAMES[i]) * F.col(_NAMES[j])) for i, j in _PAIRS)).alias("products")
    made = chosen.groupBy("peers", "start").agg(F.count("*").alias("rows"), sums, products, F.first("floors").alias("floors"))
    return written(made.mapInPandas(from_sums, FITTED))


def concentrated(rows: DataFrame, fitted: DataFrame, nearest: float) -> DataFrame:
    """The next estimates, of the nearest share of each group's rows under the fitted ones (whole bins of distance)."""
    near = with_distance(rows, fitted).withColumn("bin", F.floor(32 * F.log2(F.col("distance") + 1e-6)).cast("int"))
    bins = near.groupBy("peers", "start", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("peers", "start").orderBy("bin")
    counted = bins.withColumn("below", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("peers", "start")))
    limits = counted.where(F.col("below") < nearest * F.col("all")).groupBy("peers", "start").agg(F.max("bin").alias("last"))
    return refitted(near.join(limits, ["peers", "start"]).where("bin <= last"), nearest)


def estimates(rows: DataFrame, nearest: float = NEAREST) -> DataFrame:
    """FITTED: centre and inverse (upper triangle of the inverse covariance, row by row) of each group of rows."""
    now = starts(rows)
    for _ in range(FIRST_STEPS):
        now = concentrated(rows, now, nearest)
    place = Window.partitionBy("peers").orderBy("log_det", "start")
    now = written(now.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place"))
    for _ in range(MORE_STEPS):
        then, now = now.select("peers", F.col("log_det").alias("before")), concentrated(rows, now, nearest)
        if now.join(then, "peers").where(F.col("before") - F.col("log_det") > LEAST_FALL).isEmpty():
            break
    inliers = with_distance(rows, now).where(F.col("distance") <= chi_square(REWEIGHTED, len(_NAMES)))
    return refitted(inliers, REWEIGHTED)


def with_distance(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows with start, floors and `distance`, the squared Mahalanobis distance from their group's centre, short texts' rates drawn in."""
    known = F.sqrt(F.col("n_words") / (F.col("n_words") + PRIOR_WORDS))
    away = [(F.col(n) - F.get("centre", F.lit(k))) * (F.lit(1.0) if n == "x_length" else known) for k, n in enumerate(_NAMES)]
    terms = [
        (1 if i == j else 2) * F.get("inverse", F.lit(k)) * F.col(f"_d{i}") * F.col(f"_d{j}") for k, (i, j) in enumerate(_PAIRS)
    ]
    met = rows.join(fitted.drop("log_det"), "peers", "left").withColumns({f"_d{k}": a for k, a in enumerate(away)})
    return met.withColumn("distance", reduce(lambda a, b: a + b, terms)).drop("centre", "inverse", *(f"_d{k}" for k in range(len(_NAMES))))


def judged(docs: DataFrame, least_rows: int = LEAST_ROWS, tail: float = TAIL) -> DataFrame:
    """doc_id, text_hash, COUNTS, base_failed, distance, kept of every row of docs (doc_id, text, lang, source).

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT of them in repeated five-word windows; these are
    not kept and fit nothing. Null text has no words; null lang or source is a group like others. Equal rows are judged alike.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "lang", "source", "text")
    counts = text_counts(own, ("doc_id", "text_hash", "lang", "source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = written(with_features(counts.withColumn("base_failed", failed)))
    rows = written(grouped(rows, least_rows))
    fitted = estimates(rows.where("not base_failed"))
    limit = chi_square(1 - tail, len(FEATURES))
    held = with_distance(rows, fitted)
    kept = ~F.col("base_failed") & (F.col("distance") <= limit)
    return held.select("doc_id", "text_hash", *COUNTS, "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"), *(f"x_{n}" for n in FEATURES))
