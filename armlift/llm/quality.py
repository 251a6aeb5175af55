"""Quality scores learnt from preference pairs (Bradley-Terry), thresholded at a score quantile.

A document's strength is linear in counts taken from its whole text. Pairs of one good and
one bad labelled document are drawn, and the weights minimise the logistic loss of the
difference of their features. The threshold is the quantile of the labelled scores at the
share of bad labels; a logistic curve through it maps strengths to 0 .. 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from armlift.llm.tables import byte_texts, documents, map_batches

# bounds of the fit: labelled rows, and pairs drawn from them
MAX_LABELLED = 20_000
MAX_PAIRS = 100_000
PREDICTED_FROM = 0.3

# Byte classes whose shares are features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?'\"()-",
    "exclamation": b"!",
    "symbol": b"#$%&*+=@^_~`<>\\/",
    "bracket": b"[]{}|",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "high": bytes(range(128, 256)),
}
CLASS_OF = np.zeros(256, np.int64)
for number, members in enumerate(CLASSES.values()):
    CLASS_OF[list(members)] = number
CHUNK_BYTES = 4_000_000


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Rows of counts: one per byte class, then words, lines, distinct words, distinct lines, repeated characters."""
    rows = np.zeros((len(texts), len(CLASSES) + 5))
    for i, text in enumerate(texts):
        for start in range(0, len(text), CHUNK_BYTES):
            part = np.frombuffer(text, np.uint8, min(CHUNK_BYTES, len(text) - start), start)
            rows[i, : len(CLASSES)] += np.bincount(CLASS_OF[part], minlength=len(CLASSES))
            rows[i, -1] += np.count_nonzero(part[1:] == part[:-1])
        words, lines = text.split(), text.split(b"\n")
        rows[i, -5:-1] = len(words), len(lines), len(set(words)), len(set(lines))
    return rows


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features per text; an empty text has those of zero counts."""
    counts = class_counts(texts)
    size = counts[:, : len(CLASSES)].sum(axis=1)
    shares = counts[:, : len(CLASSES)] / np.maximum(size, 1)[:, None]
    words, lines, kinds, line_kinds, doubled = counts[:, -5:].T
    letters = counts[:, 0] + counts[:, 1] + counts[:, -6]
    more = np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            size / np.maximum(words, 1) / 10,
            kinds / np.maximum(words, 1),
            line_kinds / np.maximum(lines, 1),
            np.log1p(size / np.maximum(lines, 1)),
            counts[:, 1] / np.maximum(letters, 1),
            doubled / np.maximum(size, 1),
            size == 0,
        ]
    )
    return np.hstack([shares, np.log(shares + 1e-3), more])


@dataclass(frozen=True)
class QualityModel:
    """Weights on standardised features, and the line from strength to the logit of the score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        # far outside the labelled texts a feature tells no more than at their edge
        spread = np.clip((features(texts) - self.centre) / self.scale, -8, 8)
        strength = spread @ self.weights
        logit = self.slope * (strength - self.threshold) + np.log(PREDICTED_FROM / (1 - PREDICTED_FROM))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fitted(x: np.ndarray, good: np.ndarray, seed: int = 1, ridge: float = 1e-3) -> QualityModel:
    """The model of labelled features; without pairs all scores lie at the threshold."""
    width = x.shape[1]
    centre = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(width)
    z = np.clip((x - centre) / scale, -8, 8)
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    weights = np.zeros(width)
    if not len(yes) or not len(no):
        return QualityModel(centre, scale, weights, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    n_pairs = min(MAX_PAIRS, len(yes) * len(no))
    difference = z[rng.choice(yes, n_pairs)] - z[rng.choice(no, n_pairs)]
    for _ in range(25):  # Newton steps on mean log(1 + exp(-w d)) + ridge |w|^2 / 2
        wins = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        slope = ridge * weights - difference.T @ (1 - wins) / n_pairs
        curve = (difference * (wins * (1 - wins))[:, None]).T @ difference / n_pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ weights
    ordered = np.sort(strength)
    cut = min(len(no), len(ordered) - 1)
    threshold = (ordered[cut - 1] + ordered[cut]) / 2
    # steepness that fits the labels best, the curve being fixed at the threshold
    base = np.log(PREDICTED_FROM / (1 - PREDICTED_FROM))
    options = np.geomspace(0.05, 20, 60)
    logits = np.clip(np.outer(options, strength - threshold) + base, -30, 30)
    losses = np.where(good, np.log1p(np.exp(-logits)), np.log1p(np.exp(logits))).mean(axis=1)
    return QualityModel(centre, scale, weights, float(options[losses.argmin()]), float(threshold))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 1) -> QualityModel:
    """Learn from labelled documents (doc_id, quality 0 or 1), at most ``max_labelled`` by hash of doc_id.

    Labels that are null or name no document are left out; a document labelled twice counts twice.
    Where a doc_id names several rows, all are measured, and of all rows again at most
    ``max_labelled`` by hash take part: that bounds what reaches the driver.
    """
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .selectExpr("doc_id", "cast(quality as int) as _quality")
        .orderBy(F.expr(f"xxhash64(doc_id, {seed}L)"), "doc_id", "_quality")
        .limit(max_labelled)
    )
    # the sample has at most max_labelled narrow rows
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = labelled.selectExpr("text", "_quality", f"xxhash64(doc_id, text, _quality, {seed}L) as _place")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(list(byte_texts(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_quality"), batch.column("_place"), pa.array(list(rows))], ["quality", "place", "x"]
            )

    narrow = map_batches(texts, measured, "quality int, place bigint, x array<double>")
    found = narrow.orderBy("place", "quality", "x").limit(max_labelled).toArrow()
    quality = np.array(found["quality"].to_pylist(), int)
    x = np.array(found["x"].to_pylist(), float).reshape(len(quality), features([b""]).shape[1])
    # rows come in any order; sorted, the draws repeat
    order = np.lexsort([*x.T[::-1], quality])
    return fitted(x[order], quality[order] == 1, seed)


def with_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from 0.3 on) to every row, from the whole text; null counts as empty."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    fields = [docs.schema[c] for c in kept]
    rows = docs.select(*[f"`{c}`" for c in kept])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(list(byte_texts(batch)))
            predicted = (scores >= PREDICTED_FROM).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array(predicted)], [*kept, "score", "predicted"]
            )

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return map_batches(rows, scored, StructType([*fields, *added]))


def held_out(column: str = "doc_id") -> str:
    return f"coalesce(crc32(cast(cast({column} as string) as binary)) % 5 = 0, false)"


def training_model(spark: SparkSession, folder: str) -> QualityModel:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return fit(documents(spark, folder), labels.where(f"not {held_out()}"))


def op8_score_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the doc_ids is held out from the fit."""
    docs = documents(spark, folder).select("doc_id", "text")
    scored = with_quality(docs, training_model(spark, folder))
    return scored.selectExpr("doc_id", f"{held_out()} as held_out", "score", "predicted")
