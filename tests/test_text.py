"""Text and number columns against a few lines of plain Python on hand-made and random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import text as X


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


PIECES = [
    "we will now open the line for question", "Q&A session", "QUEſTION and answer session", "Operator: first question",
    "question and answer portion", "\n", "\r", "😀", " ", "  ", "revenue of $1,234.5 billion", "revenue of 7 b",
    "revenue of 1.2.3 million", "Revenue Of 5 M", "EPS of $2.50", "earnings per share\nof 3", "diluted earnings were .",
    "turn the call over to Ann Lee", "Thank you, John Smith.", "Thanks, Al ", "Jane Q. Doe, CFO", "Omar Reed — President",
    "Max Power -- x", "Call Participants", "CEO — Sundar Roe", "Ruth M. Lane -- CFO", "KEY", "\n\n\n", "é", " ",
    "Total revenues ", "Chief Financial Officer", "consolidated Revenue", "İ", "ı", "we'll take your queſtions",
]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", ". ", "\n"]) for _ in range(rng.randint(0, 14)))
            for _ in range(n)]


TEXTS = ["", "Q&A session first", *random_texts(400)]


def split_model(text, pattern):
    found = re.search(pattern, text, re.IGNORECASE)
    return (text[: found.start()].strip(), text[found.start():].strip()) if found else (text, "")


@pytest.mark.parametrize("build, pattern", [
    (X.call_sections, V.CALL_QUESTIONS_START), (X.page_sections, V.PAGE_QUESTIONS_START),
])
def test_sections(spark, build, pattern):
    ours = [tuple(s) for s in column(spark, TEXTS, build)]
    assert ours == [split_model(t, pattern) for t in TEXTS]


def test_call_speakers(spark):
    def model(text):
        names = {m.strip() for m in re.findall(V.HANDED_OVER_TO, text)}
        names |= {m.strip() for m in re.findall(V.THANKED, text) if len(m.split()) >= 2}
        return sorted(names | {m.strip() for m in re.findall(V.NAME_AND_TITLE, text[:3000])})

    assert column(spark, TEXTS, X.call_speakers) == [model(t) for t in TEXTS]


def test_speakers_are_introduced_early(spark):
    late = "x" * 3000 + " Jane Doe, CEO. I turn it over to Tom Hill."
    assert column(spark, [late], X.call_speakers) == [["Tom Hill"]]


def test_page_speakers(spark):
    def model(text):
        block = re.search(V.PARTICIPANTS_BLOCK, text, re.IGNORECASE)
        names = set()
        if block:
            names |= set(re.findall(V.NAME_AFTER_DASH, block[1])) | set(re.findall(V.NAME_BEFORE_DASH, block[1]))
        return sorted(names | {n for n in re.findall(V.NAME_DASH_WORD, text) if len(n) < 40})

    assert column(spark, TEXTS, X.page_speakers) == [model(t) for t in TEXTS]


def test_key_numbers(spark):
    def model(text):
        found = {}
        revenue = re.search(V.REVENUE_FIGURE, text, re.IGNORECASE)
        if revenue:
            try:
                value = float(revenue[1].replace(",", ""))
                found["revenue_mentioned"] = f"${value}{revenue[2][0].upper()}"
            except ValueError:
                pass
        eps = re.search(V.EPS_FIGURE, text[:5000], re.IGNORECASE)
        if eps:
            found["eps_mentioned"] = f"${eps[1]}"
        return found

    extra = ["revenue of 12345678 basis", "revenue of $100000000000000000 million", "revenue of 0.00001 B",
             "x" * 4990 + "EPS was 3", "EPS was " + "y" * 4990 + "3"]
    assert column(spark, TEXTS + extra, X.key_numbers) == [model(t) for t in TEXTS + extra]


def test_financials_chunk(spark):
    def model(text):
        for marker in V.FINANCIALS_MARKERS:
            found = re.search(marker, text)
            if found:
                start = max(0, found.start() - 200)
                return text[start:start + 3000]
        return text[:3000]

    long = ["😀" * 300 + "Total revenue x" + "é" * 4000, "a" * 5000, "b" * 150 + "earnings per share" + "c" * 9000]
    assert column(spark, TEXTS + long, X.financials_chunk) == [model(t) for t in TEXTS + long]


def test_strip_cuts_every_white_space(spark):
    values = ["  x\n ", "\x1c\x85a b\t", "", " \n", "no"]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


def test_rounding_is_by_the_binary_value(spark):
    rng = random.Random(3)
    values = [0.35, 2.65, 0.25, 0.75, -0.25, -2.65, 1.05, 0.05, 0.0, 124.3, -0.04, 383.285, 2.675]
    values += [k / 20 for k in range(-4001, 4001, 2)] + [k / 20 * 1e3 for k in range(1, 4001, 2)]
    values += [rng.uniform(-1e4, 1e4) for _ in range(2000)] + [rng.randint(0, 10**13) / 1e9 for _ in range(2000)]
    assert column(spark, values, X.round_to_tenth, "double") == [round(v, 1) for v in values]


def test_billions(spark):
    values = [124300000000.0, 2650000000.0, 0.0, None]
    assert column(spark, values, X.to_billions, "double") == [124.3, round(2.65, 1), None, None]


def test_float_text(spark):
    rng = random.Random(5)
    values = [0.0, 5.0, 12345678.0, 1e16, 1.5e17, 1e-5, 0.00012, 102.3, -7.25, 1e15, 9999999.5, 0.001]
    values += [round(rng.uniform(0, 1e6), 2) for _ in range(500)]
    assert column(spark, values, X.float_text, "double") == [repr(v) for v in values]


def test_file_names(spark):
    row = spark.sql("SELECT 'AbC' t, 2024 y, 3 q, timestamp'2024-05-06 07:08:09' at").select(
        X.document_file(F.col("t")).alias("d"), X.transcript_file(F.col("y"), F.col("q")).alias("f"),
        X.memo_file(F.col("t"), F.col("at")).alias("m"), X.upper_ticker(F.col("t")).alias("u"),
    ).first()
    assert tuple(row) == ("abc.json", "Q3_2024.json", "AbC_memo_20240506_070809.md", "ABC")
