"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader (FTRL-proximal) under elastic-net penalties, with a
temperature fitted on held-back rows.

Features are hashed 1- to 3-grams of the lower-cased text, whole texts always. Document
frequencies are counted over all training rows in distributed passes; the classifier itself is
fitted on a bounded sample of labelled rows (``SAMPLE`` rows per language, chosen by a hash of
id and text, ``MAX_SAMPLE`` in all) in one task. Predictions read the text only.

Defined cases: null texts and texts without a letter give ``und`` with score 0; without any
labelled row everything is ``und``; rows without an id count as training rows; repeated rows
count in the frequencies, enter the sample once at most, and are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 1 << 15
SAMPLE = 1000          # training rows per language, about
MAX_SAMPLE = 8000      # training rows in all, about
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
PIECE = 1 << 20        # characters turned into features at once


def grams(text: str) -> np.ndarray:
    """Counts of the text's hashed character 1- to 3-grams."""
    out = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        first = 2 if at else 0
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(5) + one[1:] * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + one[2:]
        for h in (one[first:], two[max(0, first - 1) :], three):
            out += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF values (sublinear term frequency, unit length)."""
    counts = grams(text)
    at = np.flatnonzero(counts)
    v = (1.0 + np.log(counts[at])) * idf[at]
    return at, v / max(np.sqrt(v @ v), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights from the gradient sums: zero inside the L1 ball."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (bucket x label) after ``epochs`` passes in the given order."""
    z, n = np.zeros((BUCKETS, n_labels)), np.zeros((BUCKETS, n_labels))
    for _ in range(epochs):
        for (at, v), y in zip(rows, labels, strict=True):
            za, na = z[at], n[at]
            w = weights_of(za, na)
            p = softmax(v @ w)
            p[y] -= 1.0
            g = v[:, None] * p
            step = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at] = za + g - step * w
            n[at] = na + g * g
    return weights_of(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-back rows."""
    tried = np.exp(np.linspace(np.log(0.02), np.log(20.0), 120))
    loss = [-np.mean(np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-300))) for t in tried]
    return float(tried[int(np.argmin(loss))])


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> dict:
    """Labels, TF-IDF weights folded with the classifier's, and temperature, from the labelled rows."""
    usable = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column("t").to_pylist():
                df += grams(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at], pa.int32()), pa.array([n, *df[at]], pa.int64())], names=["bucket", "n"]
        )

    # at most BUCKETS + 1 rows, whatever the input
    counted = {r.bucket: r.n for r in usable.mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = counted.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(counted)] = list(counted.values())
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    per_label = usable.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    spread = per_label.withColumn("labels", F.count(F.lit(1)).over(Window.partitionBy()))  # one row per label
    quota = F.least(F.lit(float(SAMPLE)), F.lit(float(MAX_SAMPLE)) / F.col("labels"))
    # one row per label, fewer than the columns of the model that is held anyway; unhinted, a frequent label is one task's
    chosen = usable.join(F.broadcast(spread.select(F.col("y").alias("y2"), (quota / F.col("n")).alias("part"))), F.expr("y = y2"))
    # a row's place follows from its id and text, so rows without an id spread; of equal rows one is taken
    order = F.pmod(F.xxhash64(F.col("k").cast("string"), "t"), F.lit(1 << 60))
    chosen = chosen.withColumn("o", order).where(F.col("o") < F.col("part") * float(1 << 60)).select("o", "t", "y")
    chosen = chosen.dropDuplicates(["o", "y"]).orderBy("o", "y").limit(2 * MAX_SAMPLE)  # about MAX_SAMPLE rows; the limit is a proof, not a cut

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, y, t) for b in batches for o, t, y in zip(*(b.column(c).to_pylist() for c in ("o", "t", "y")), strict=True))
        if not rows:
            return
        labels = sorted({y for _, y, _ in rows})
        x = [features(t, idf) for _, _, t in rows]
        y = np.array([labels.index(v) for _, v, _ in rows])
        back = np.arange(len(rows)) % 5 == 4
        w = fit([r for r, b in zip(x, back, strict=True) if not b], y[~back], len(labels))
        heat = temperature(np.array([v @ w[at] for (at, v), b in zip(x, back, strict=True) if b]), y[back]) if back.any() else 1.0
        folded = (w / heat).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.string()), pa.array([folded[:, i].tobytes() for i in range(len(labels))], pa.binary()), pa.array([heat] * len(labels))],
            names=["label", "weights", "temperature"],
        )

    model = chosen.repartition(1).mapInArrow(learn, "label string, weights binary, temperature double").orderBy("label").collect()
    w = np.stack([np.frombuffer(r.weights, np.float32) for r in model], axis=1) if model else np.zeros((BUCKETS, 0), np.float32)
    return {"labels": [r.label for r in model], "idf": idf, "weights": w, "temperature": model[0].temperature if model else 1.0}


def predict(docs: DataFrame, model: dict, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` without its text, with the predicted label and its calibrated probability."""
    rest = [c for c in docs.columns if c not in (text, label, score)]
    schema = docs.select(*rest).schema.add(label, "string").add(score, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, idf, w = (shared.value[k] for k in ("labels", "idf", "weights"))
        for batch in batches:
            names, scores = [], []
            for t in batch.column(text).to_pylist():
                if not labels or not has_letter(t):
                    names.append("und")
                    scores.append(0.0)
                    continue
                at, v = features(t, idf)
                p = softmax(v @ w[at])
                names.append(labels[int(p.argmax())])
                scores.append(float(min(p.max(), 1.0)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names
            )

    return docs.select(*rest, text).mapInArrow(run, schema)
