"""Quality by a regularised quadratic discriminant.

Transformed document statistics of each class are modelled as a normal distribution whose covariance is shrunk towards the
pooled one and towards its diagonal. The score comes from the difference of the two log densities, Mahalanobis distances
through Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import row_runs, stage, texts_of
from axistab.llm.textstats import NAMES, statistics

SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3


def transform(counts: np.ndarray) -> np.ndarray:
    """Logarithms of sizes and square roots of shares."""
    c = {n: counts[:, i].astype(float) for i, n in enumerate(NAMES)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"] + c["n_wide"], 1)
    shares = [
        (c["n_symbols"], words), (c["n_dup_lines"], lines), (c["n_repeat_words"], words), (c["n_upper"], letters), (c["n_digits"], chars), (c["n_punct"], chars),
        (c["n_top_word"], words), (c["n_capital_words"], words), (c["n_end_marks"], words), (c["n_repeat_pairs"], words), (c["n_long_words"], words), (c["n_same_chars"], chars), (c["n_stop_lines"], lines), (c["n_same_next"], words),
    ]
    sizes = [
        np.log1p(c["n_words"]), np.log1p(c["word_chars"] / words), np.log1p(words / lines),
        np.log(np.maximum(c["n_distinct"], 1)) / np.log(words + 1.0),
    ]
    return np.stack([*(np.sqrt(np.minimum(a / b, 4.0)) for a, b in shares), *sizes], axis=1)


DIMENSIONS = transform(np.zeros((0, len(NAMES)), np.int64)).shape[1]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_runs(batch, "_text"):
            x = transform(np.array([statistics(t) for t in texts_of(part.column("_text"))], np.int64).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))],
                names=["_id", "_x"],
            )


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_x", T.ArrayType(T.DoubleType()))])
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(_features, schema)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sum and sum of outer products of ``_x`` for each ``_y``: partial sums in the tasks, summed in the shuffle."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            x, y = _matrix(b.column("_x")), b.column("_y").to_numpy(zero_copy_only=False)
            for k in np.unique(y):
                own = np.c_[np.ones(int((y == k).sum())), x[y == k]]
                sums[int(k)] = sums.get(int(k), 0) + own.T @ own
        flat = [(k, i, v) for k, s in sums.items() for i, v in enumerate(s.ravel())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[j] for f in flat], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["y", "i", "v"],
        )

    rows = labelled.select("_x", "_y").mapInArrow(part, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out, width = {}, DIMENSIONS + 1
    for k in {r["y"] for r in rows}:
        s = np.zeros(width * width)
        for r in rows:
            if r["y"] == k:
                s[r["i"]] = r["v"]
        s = s.reshape(width, width)
        out[k] = (s[0, 0], s[0, 1:], s[1:, 1:])
    return out


class Discriminant:
    """Two normal densities; ``score`` gives the probability of class 1 (0.5 for all if nothing was learned)."""

    def __init__(
        self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL,
        ridge: float = RIDGE,
    ):
        n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        self.models = []
        if min(n.values()) == 0:
            return
        total, s1, s2 = (sum(sums[k][i] for k in (0, 1)) for i in range(3))
        self.mean = s1 / total
        self.scale = np.sqrt(np.maximum(np.diag(s2) / total - self.mean**2, 1e-9))
        own = {}
        for k in (0, 1):
            mean = sums[k][1] / n[k]
            own[k] = (sums[k][2] / n[k] - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
        common = sum(n[k] * own[k] for k in (0, 1)) / total
        for k in (0, 1):
            share = min(1.0, pooled + DIMENSIONS / (n[k] + DIMENSIONS))
            cov = (1 - share) * own[k] + share * common
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + ridge * np.eye(DIMENSIONS)
            factor = np.linalg.cholesky(cov)
            self.models.append(((sums[k][1] / n[k] - self.mean) / self.scale, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.models:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        z = (x - self.mean) / self.scale
        density = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - log_det for mean, inverse, log_det in self.models]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def quality_scores(
    df: DataFrame, labels: DataFrame, learn: str = "true", id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """``doc_id, score`` of each row of ``df``, learned from all rows of ``labels`` with label 0 or 1 that have a text in ``df``.

    ``learn`` is a condition on ``_id`` (the document's id) that rows to learn from meet. A null text is scored as an empty
    one. Labels other than 0 and 1, and null ids, teach nothing; a label given twice counts twice. Repeated rows come out as
    often as they come in; other columns are not read; an empty table gives no rows.
    """
    table = stage(features(df, id_col, text_col), "features")
    given = labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1)").filter(learn)
    model = Discriminant(moments(table.filter(learn).join(given.hint("merge"), "_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(model.score(_matrix(b.column("_x"))))], names=["doc_id", "score"])

    return table.mapInArrow(run, T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
