"""Quality rules under weak supervision.

Each rule votes for (1) or against (-1) a document or abstains (0). Expectation-maximisation over the counts of vote
patterns estimates how often each rule's votes are right and the share of good documents; a document stays when its
posterior probability of being good is at least ``threshold``. The patterns number 3^rules at most, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import row_runs, stage, texts_of
from axistab.llm.textstats import NAMES, statistics

def _share(top: str, base: str):
    return lambda c: c[top] / np.maximum(c[base], 1)


def _letters(c: dict[str, np.ndarray]) -> np.ndarray:
    """Letters among what is neither space nor digit, so that this rule and that of digits judge different things."""
    return (c["n_upper"] + c["n_lower"] + c["n_wide"]) / np.maximum(c["n_chars"] - c["n_space"] - c["n_digits"], 1)


#: (name, value from the counts of textstats, votes against when below, .. or above, votes for when within).
RULES = (
    ("words", lambda c: c["n_words"], 10, math.inf, (20, math.inf)),
    ("word_length", _share("word_chars", "n_words"), 2.2, 14, (2.8, 11)),
    ("symbols", _share("n_symbols", "n_words"), -1, 0.12, (0, 0.02)),
    ("same_lines", _share("n_dup_lines", "n_lines"), -1, 0.5, (0, 0.1)),
    ("repeats", _share("n_repeat_words", "n_words"), -1, 0.2, (0, 0.05)),
    ("upper", _share("n_upper", "n_chars"), -1, 0.3, (0, 0.1)),
    ("end_marks", _share("n_end_marks", "n_words"), -1, 0.2, (0, 0.05)),
    ("top_word", _share("n_top_word", "n_words"), -1, 0.3, (0, 0.18)),
    ("digits", _share("n_digits", "n_chars"), -1, 0.25, (0, 0.06)),
    ("stutter", _share("n_same_next", "n_words"), -1, 0.3, (0, 0.05)),
    ("letters", _letters, 0.75, math.inf, (0.88, math.inf)),
)
THRESHOLD = 0.5


def votes(counts: np.ndarray) -> np.ndarray:
    """Votes of every rule (columns) on every document (rows of ``counts``, columns ``NAMES``)."""
    c = {n: counts[:, i].astype(float) for i, n in enumerate(NAMES)}
    out = np.zeros((len(counts), len(RULES)), np.int8)
    for i, (_, value_of, least, most, (lo, hi)) in enumerate(RULES):
        value = value_of(c)
        out[:, i] = np.where((value < least) | (value > most), -1, np.where((value >= lo) & (value <= hi), 1, 0))
    return out


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return (vote.astype(np.int64) + 1) @ (3 ** np.arange(vote.shape[1]))


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeats = counts[:, 0], counts[:, NAMES.index("n_repeat_words")]
    return (n < 10) | (100 * repeats > 20 * n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_runs(batch, "_text"):
            counts = np.array([statistics(t) for t in texts_of(part.column("_text"))], np.int64).reshape(-1, len(NAMES))
            cols = [
                part.column("_id"), *(pa.array(counts[:, i]) for i in range(5)), pa.array(base_failed(counts)), pa.array(pattern_of(votes(counts))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", *NAMES[:5], "base_failed", "_pattern"])


def _table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fields = [
        T.StructField("_id", df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in NAMES[:5]),
        T.StructField("base_failed", T.BooleanType()), T.StructField("_pattern", T.LongType()),
    ]
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(_count, T.StructType(fields))


#: Where the estimates start: the share of votes against among a rule's votes, on good and on bad documents.
START = (0.013, 0.32)
#: Share of good documents to start from, and how many documents stand behind each value that estimates start from.
GOOD, STRENGTH = 0.8, 20.0


def _weights(against: np.ndarray) -> np.ndarray:
    """What a rule's vote (rows: against, abstaining, for) adds to the log-odds of good; an abstention says nothing.

    A rule never counts against its own vote: what it adds has the vote's sign or is 0.
    """
    return np.stack(
        [np.minimum(np.log(against[0] / against[1]), 0), np.zeros(against.shape[1]), np.maximum(np.log((1 - against[0]) / (1 - against[1])), 0)]
    )


def fit_votes(
    patterns: list[tuple[int, int]], rounds: int = 300, good: float = GOOD, strength: float = STRENGTH,
) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-odds of good before any vote, what each rule (column) adds to them: against, abstaining (0), for (rows), and
    the share of votes against among each rule's votes on good and on bad documents (rows).

    ``patterns`` has the number of documents of each vote pattern. The estimates are those of maximum posterior under
    independent votes, with ``strength`` documents as in ``START`` behind each.
    """
    m, prior = len(RULES), good
    number = np.array([n for _, n in patterns], float)
    vote = np.array([p for p, _ in patterns], np.int64).reshape(-1, 1) // 3 ** np.arange(m) % 3
    each, against = [vote == v for v in range(3)], np.repeat(np.array(START)[:, None], m, axis=1)
    for _ in range(rounds):
        odds = math.log(good / (1 - good)) + sum(e @ w for e, w in zip(each, _weights(against), strict=True))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        before, good = good, ((number * p).sum() + prior * strength) / (number.sum() + strength)
        for k, w in enumerate((number * p, number * (1 - p))):
            against[k] = (w @ each[0] + strength * START[k]) / (w @ (each[0] + each[2]) + strength)
        if abs(good - before) < 1e-12:
            break
    return math.log(good / (1 - good)), _weights(against), against


def odds_of(vote: np.ndarray, start: float, weights: np.ndarray) -> np.ndarray:
    return start + sum((vote == v) @ w for v, w in zip((-1, 0, 1), weights, strict=True))


def _odds(pattern: Column, start: float, weights: np.ndarray) -> Column:
    out = F.lit(start)
    for i in range(len(RULES)):
        out = out + F.element_at(F.lit([float(w) for w in weights[:, i]]).cast("array<double>"), (F.floor(pattern / F.lit(3**i)) % 3 + 1).cast("int"))
    return out


def _posterior(pattern: Column, start: float, weights: np.ndarray) -> Column:
    return 1 / (1 + F.exp(-_odds(pattern, start, weights)))


def _fitted(counted: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    return fit_votes([(r["_pattern"], r["n"]) for r in counted.groupBy("_pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("_pattern").collect()])


def rule_accuracies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rule, against_good, against_bad``: estimated share of votes against among each rule's votes on good and bad documents."""
    against = _fitted(_table(df, id_col, text_col))[2]
    rows = [(r[0], float(a), float(b)) for r, a, b in zip(RULES, *against, strict=True)]
    return df.sparkSession.createDataFrame(rows, "rule string, against_good double, against_bad double")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality`` of each row.

    ``quality`` is the posterior probability that the document is good. A null text has no words and fails the base rules.
    Rows are judged one by one: repeated rows and ids come out as often as they come in; other columns are not read; an
    empty table gives no rows.
    """
    counted = stage(_table(df, id_col, text_col), "votes")
    start, weights, _ = _fitted(counted)
    out = counted.withColumn("quality", _posterior(F.col("_pattern"), start, weights)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return out.select(F.col("_id").alias("doc_id"), *NAMES[:5], "base_failed", "kept", "quality")


def drop_low_quality(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, that ``quality_rules`` keeps; each text is judged once and none is shuffled.

    A null text fails the base rules and goes, whatever ``threshold`` (0 keeps all that pass them). Repeated rows are judged one
    by one; ids and other columns are not read; an empty table gives no rows.
    """
    names = df.columns
    at = f"c{names.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, "_text"):
                counts = np.array([statistics(t) for t in texts_of(part.column("_text"))], np.int64).reshape(-1, len(NAMES))
                part = part.append_column("_pattern", pa.array(pattern_of(votes(counts)))).append_column("_failed", pa.array(base_failed(counts)))
                yield part.drop_columns(["_text"])

    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    fields = [*plain.schema, T.StructField("_pattern", T.LongType()), T.StructField("_failed", T.BooleanType())]
    judged = stage(plain.withColumn("_text", F.col(at).cast("string")).mapInArrow(run, T.StructType(fields)), "judged")
    start, weights, _ = _fitted(judged)
    kept = judged.filter(~F.col("_failed") & (_posterior(F.col("_pattern"), start, weights) >= threshold))
    return kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
