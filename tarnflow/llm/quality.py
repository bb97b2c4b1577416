"""A quality classifier with supervised subword embeddings.

Words, the runs of characters within words, and the pairs of neighbouring words are hashed into buckets, each with a learned
vector.  A pair's hash is the difference of its words' hashes: words that repeat, seen before or not, share a vector.  A document is the mean of the vectors of all its features; a linear layer and a softmax over the two labels follow.
Vectors and layer are trained together, by stochastic gradient descent in numpy.

The model is fitted on a bounded sample: at most 3/2 * SAMPLE_PER_LABEL ids of each label, drawn by a hash of the id, of which
SAMPLE_PER_LABEL that have a text are used.  Executors count the features, the driver gets each sampled document's distinct
buckets and their counts.  For scoring, vectors and layer collapse into one number a bucket: the mean of the vectors, put
through a linear layer, is the mean of the vectors each put through it.  Scoring is one pass over the documents without a
shuffle; the broadcast table has a fixed size.

Defined cases.  Null and empty texts have no features; their score is what the layer's bias says.  Documents with a null label
or a null id teach nothing; an id that is labelled several times alike counts once, one that is labelled both ways once for
each; of several texts of an id the first in order is learned.  Texts of any length are scored whole.  Repeated rows get a score
each.  Without any labels every score is 0.5.  An empty table gives no rows.  Other columns stay, whatever their names, but those
called like a result (score, predicted) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._features import SubwordFeatures, parts, release_memory, texts_of
from ._tables import bound_batches

BUCKETS = 1 << 16  # for words and runs of characters, and as many for pairs of words
ORDERS = (3, 4)
DIMENSIONS = 12
SAMPLE_PER_LABEL = 1500
LABELS = 2


@dataclass
class Model:
    vectors: np.ndarray  # 2 * BUCKETS x DIMENSIONS
    layer: np.ndarray  # DIMENSIONS x labels
    bias: np.ndarray  # labels

    def collapsed(self) -> tuple[np.ndarray, float]:
        """For each bucket, and for the bias: how much it speaks for label 1 over label 0."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: np.ndarray, epochs: int = 12, rate: float = 2.0, seed: int = 3) -> Model:
    """rows: buckets and counts of each document.  prior: the share of each label among all labelled documents, which
    the balanced sample does not show."""
    if not rows:
        return Model(np.zeros((2 * BUCKETS, DIMENSIONS), dtype=np.float32), np.zeros((DIMENSIONS, LABELS), dtype=np.float32), np.zeros(LABELS, dtype=np.float32))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (2 * BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = draw.normal(0, 0.1, (DIMENSIONS, LABELS)).astype(np.float32), np.zeros(LABELS, dtype=np.float32)
    layer -= layer.mean(axis=1, keepdims=True)
    weights = [(c / c.sum()).astype(np.float32) for _, c in rows]
    steps = epochs * len(rows)
    for epoch in range(epochs):
        for t, i in enumerate(draw.permutation(len(rows))):
            step = rate * (1 - (epoch * len(rows) + t) / steps)
            bucket, weight = rows[i][0], weights[i]
            part = vectors[bucket]
            mean = weight @ part
            p = np.exp((z := mean @ layer + bias) - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # now the slope of the loss
            # Each feature moves by the document's slope times its share, scaled up by the number of features.
            vectors[bucket] = part - (step * min(50.0, 1 / weight.max()) * weight)[:, None] * (layer @ p)[None, :]
            layer -= 0.1 * step * np.outer(mean, p)
            bias -= 0.1 * step * p
    seen = np.bincount(labels, minlength=LABELS) if len(labels) else np.zeros(LABELS)
    if (seen > 0).all():
        bias = bias + np.log(prior / (seen / seen.sum())).astype(np.float32)
    elif len(labels):
        bias = np.where(seen > 0, 5.0, -5.0).astype(np.float32)
    return Model(vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fits a model on a bounded sample of the labelled docs, the same for the same rows whatever their order."""
    bound_batches(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).agg(F.first(F.xxhash64(id_col)).alias("draw"))
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if not sizes:
        return fit([], np.zeros(0, dtype=np.int64), np.full(LABELS, 0.5))
    # More are drawn than needed, since labels may lack their document; what is over is left out below.
    most = SAMPLE_PER_LABEL * 3 // 2
    share = F.create_map(*[F.lit(v) for label, n in sizes.items() for v in (label, min(1.0, 1.2 * most / n))])
    some = marks.where(F.pmod("draw", F.lit(1 << 30)) < F.element_at(share, F.col("label")) * (1 << 30))
    drawn = some.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))).where(F.col("nth") <= most).drop("nth")
    # LABELS * most rows at most, so it may be broadcast.
    met = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    sample = met.groupBy("id", "label", "draw").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts(texts_of(batch.column("text"))):
                features, rows = SubwordFeatures(part, ORDERS, BUCKETS), []
                for d in range(len(part)):
                    word, times = np.unique(features.word[features.first[d] : features.first[d + 1]], return_counts=True)
                    n = features.begin[word + 1] - features.begin[word]
                    where = np.repeat(features.begin[word] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(n.sum())
                    mine = slice(features.first[d], features.first[d + 1])
                    pairs = features.pair[mine][features.paired[mine]]
                    bucket, which = np.unique(np.concatenate((features.bucket[where], pairs)), return_inverse=True)
                    counts = np.bincount(which, weights=np.concatenate((np.repeat(times, n), np.ones(len(pairs)))), minlength=len(bucket))
                    rows.append(bucket.astype("<i4").tobytes() + counts.astype("<f4").tobytes())
                piece = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_pydict({"label": piece.column("label"), "draw": piece.column("draw"), "features": pa.array(rows, pa.binary())})

    held: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for r in sample.select("text", "label", "draw").mapInArrow(count, "label int, draw long, features binary").toLocalIterator():
        held[r["label"]].append((r["draw"], bytes(r["features"])))
    rows, labels_of = [], []
    for label in (0, 1):
        for _, raw in sorted(held[label])[:SAMPLE_PER_LABEL]:
            if n := len(raw) // 8:
                rows.append((np.frombuffer(raw, dtype="<i4", count=n), np.frombuffer(raw, dtype="<f4", offset=4 * n)))
                labels_of.append(label)
    prior = np.array([sizes.get(0, 0), sizes.get(1, 0)], dtype=np.float64)
    held.clear()
    model = fit(rows, np.array(labels_of, dtype=np.int64), np.maximum(prior, 1) / prior.sum())
    release_memory()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs, without the text, with score (the probability of label 1) and predicted (1 if it reaches the threshold)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.collapsed())
    columns = [c for c in docs.columns if c not in (text_col, "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, bias = shared.value
        for batch in batches:
            scores = []
            for part in parts(texts_of(batch.column(text_col))):
                f = SubwordFeatures(part, ORDERS, BUCKETS)
                running = np.concatenate(([0.0], np.cumsum(by_bucket[f.bucket])))
                word_sum, word_n = running[f.begin[1:]] - running[f.begin[:-1]], np.diff(f.begin)
                total = np.concatenate(([0.0], np.cumsum(word_sum[f.word] + f.paired * by_bucket[f.pair])))
                count = np.concatenate(([0], np.cumsum(word_n[f.word] + f.paired)))
                logit = (total[f.first[1:]] - total[f.first[:-1]]) / np.maximum(count[f.first[1:]] - count[f.first[:-1]], 1) + bias
                scores.append(1 / (1 + np.exp(-np.clip(logit, -50, 50))))
            p = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], [*columns, "score", "predicted"])

    schema = docs.select(*columns).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*columns, text_col).mapInArrow(run, schema)
