"""Language identification with error-correcting output codes.

Every language has a codeword; each bit of the codewords has a binary classifier of its own, a logistic regression on
hashed runs of bytes.  A text's margins for all bits are held against each codeword: the loss of a bit is logistic, it
is weighted by how well that bit's classifier did in training, and the codeword of least total loss wins.  Where the
two best codewords are nearly as good as each other, the text is flagged as ambiguous.

The model is fitted on a bounded sample: SAMPLE_PER_LANGUAGE different texts of each language, or fewer of each where there are
so many languages that the sample would have more than SAMPLE_TEXTS.  Every language is learned; a column of more than
MAX_LANGUAGES different values is an error, since labels of that many kinds aren't languages.  Texts are drawn by a hash of
the text, so ids have no say, and copies of a text are one.  The sample's features are counted on the executors, and the
driver gets one row of BUCKETS counts for each text of the sample, 64 MB at most.  Prediction is one pass over the texts
without a shuffle; the broadcast model has a fixed size.

Defined cases.  Null texts and texts without any letter are ``und``, with score 0 and not ambiguous.  Rows with a null
language teach nothing.  Texts of any length are used whole.  Repeated rows, null ids among them, get a result each.  Other
columns stay, whatever their names, but those called like a result (lang_pred, score, ambiguous) are replaced by it.  An empty
table gives no rows.  With a single language, that is the prediction for every text with letters; with none, ``und`` is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._features import character_counts, parts, release_memory, texts_of
from ._tables import bound_batches

BUCKETS = 4096
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 500
SAMPLE_TEXTS = 8_000
MAX_LANGUAGES = 4096
AMBIGUOUS_MARGIN = 0.05  # of the probability of the best and the second-best codeword
_LETTER = regex.compile(r"\p{L}")


def codewords(languages: int) -> np.ndarray:
    """A matrix of +1 and -1, languages x bits: all two-way splits for up to 5 languages, else the best of several
    random codes by the least distance of two codewords."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        bits = np.arange(1, 1 << (languages - 1))
        rows = [np.ones(len(bits))] + [np.where(bits >> i & 1, -1.0, 1.0) for i in range(languages - 1)]
        return np.array(rows)
    draw, best = np.random.default_rng(7), (-1, None)
    for _ in range(100):
        code = draw.choice([-1.0, 1.0], size=(languages, 15 + 5 * math.ceil(math.log2(languages))))
        if not (np.abs(code.sum(axis=0)) < languages).all():
            continue
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(languages) * code.shape[1]
        if apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def normalised(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit; they sum to the number of bits

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Of each language, for each row of counts; a softmax of the weighted losses."""
        margin = normalised(counts) @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(counts: np.ndarray, labels: list[str], epochs: int = 200, rate: float = 30.0, decay: float = 1e-5) -> Model:
    """One logistic regression for each bit, by gradient descent with momentum; classes weigh the same."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    x = normalised(counts)
    place = {y: i for i, y in enumerate(languages)}
    which = np.array([place[y] for y in labels], dtype=np.int64)
    share = (1.0 / np.maximum(np.bincount(which, minlength=len(languages)), 1))[which] / max(1, len(languages)) if labels else np.empty(0)
    target = code[which] if labels else np.empty((0, 1))
    weights, bias = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    speed, speed_bias = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(epochs if len(languages) > 1 else 0):
        margin = x @ weights + bias
        slope = (-target / (1 + np.exp(np.clip(target * margin, -30, 30))) * share[:, None]).astype(np.float32)
        speed = 0.9 * speed - rate * 0.1 * (x.T @ slope + decay * weights)
        speed_bias = 0.9 * speed_bias - 0.1 * slope.sum(axis=0)
        weights, bias = weights + speed, bias + speed_bias
    right = ((x @ weights + bias) * target > 0).T @ share if labels else np.ones(code.shape[1])
    trust = np.log(np.clip(right, 0.55, 0.995) / (1 - np.clip(right, 0.55, 0.995)))
    return Model(languages, code, weights, bias, trust / trust.sum() * len(trust))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fits a model on a bounded sample of docs, the same for the same rows whatever their order."""
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("draw"))
    sizes = {r["lang"]: max(1, r["n"]) for r in labelled.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} different values")
    if not sizes:
        return fit(np.zeros((0, BUCKETS)), [])
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS // len(sizes)))
    # The drawn share of each language is a little larger than needed, by more where few are needed, so that none is left
    # without a text; copies of a text are one before they are ranked, and what is over is left out.
    share = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, max(1.3 * most, most + 20) / n))])
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    sample = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("nth") <= most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts(texts_of(batch.column("text"))):
                counts = np.minimum(character_counts(part, ORDERS, BUCKETS), 65535).astype("<u2")
                piece = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_pydict({"lang": piece.column("lang"), "draw": piece.column("draw"), "counts": pa.array([c.tobytes() for c in counts], pa.binary())})

    held: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.select("text", "lang", "draw").mapInArrow(count, "lang string, draw long, counts binary").toLocalIterator():
        held.setdefault(r["lang"], []).append((r["draw"], bytes(r["counts"])))
    rows = [(lang, c) for lang in sorted(held) for _, c in sorted(held[lang])]
    held.clear()
    model = fit(np.array([np.frombuffer(c, dtype="<u2") for _, c in rows]).reshape(len(rows), BUCKETS), [lang for lang, _ in rows])
    release_memory()
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without the text, unless keep_text) with lang_pred, score (the chosen language's probability) and ambiguous."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    out = [c for c in columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = texts_of(batch.column(text_col))
            names, scores, unsure = [], [], []
            for part in parts(texts):
                letters = np.array([_LETTER.search(t.decode("utf-8", "replace")) is not None for t in part])
                if model.languages:
                    p = model.probabilities(character_counts(part, ORDERS, BUCKETS))
                    ranked = np.sort(p, axis=1)
                    close = ranked[:, -1] - ranked[:, -2] < AMBIGUOUS_MARGIN if p.shape[1] > 1 else np.zeros(len(part), dtype=bool)
                    best = p.argmax(axis=1)
                    names += [model.languages[b] if yes else "und" for b, yes in zip(best, letters, strict=True)]
                    scores.append(np.where(letters, ranked[:, -1], 0.0))
                    unsure.append(close & letters)
                else:
                    names += ["und"] * len(part)
                    scores.append(np.zeros(len(part)))
                    unsure.append(np.zeros(len(part), dtype=bool))
            found = [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(unsure) if unsure else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in out] + found, [*out, "lang_pred", "score", "ambiguous"])

    kept = docs.select(*columns)
    schema = kept.select(*out).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return kept.mapInArrow(run, schema)
