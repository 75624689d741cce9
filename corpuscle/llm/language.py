"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are fitted by follow-the-regularised-leader (FTRL-proximal) with an
elastic-net penalty on a bounded, documented sample of labelled documents;
document frequencies come from all documents that may be learned from. A
temperature is then fitted on labelled documents that the weights have not seen.
Prediction is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.llm import _arrays as A

N_FEATURES = 1 << 14
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point: its lower-case code point if it is a letter, else a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low[0])
    return out


def feature_counts(column: pa.Array, block_bytes: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For each row: indices of its hashed 1-, 2- and 3-grams, their counts, and if it has a letter.

    Runs of other characters count as one space; texts begin and end with one.
    """
    for i, j, data, offs in A.blocks(column, block_bytes):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs] if len(data) else np.zeros(len(offs), np.int64)
        plain = _letters()[points]
        for r in range(j - i):
            row = plain[at[r] : at[r + 1]]
            letter = row != 32
            if not letter.any():
                yield np.zeros(0, np.int64), np.zeros(0), False
                continue
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            x = np.concatenate([[np.uint32(32)], row[keep], [np.uint32(32)]]).astype(np.uint32)
            one = x * np.uint32(0x9E3779B1)
            two = one[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))
            three = two[:-1] ^ (x[2:] * np.uint32(0xC2B2AE3D))
            h = np.concatenate([one, two + np.uint32(0x27D4EB2F), three + np.uint32(0x165667B1)])
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts = np.bincount(h >> np.uint32(18), minlength=N_FEATURES)
            index = np.flatnonzero(counts)
            yield index, counts[index], True


def weights_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length-one TF-IDF values: (1 + log count) times idf."""
    x = (1 + np.log(counts)) * idf
    return x / max(1e-12, float(np.sqrt(x @ x)))


@dataclass
class Model:
    """Learned languages, idf, weights (feature, language), and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = (weights_of(counts, self.idf[index]) @ self.weights[index] + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


class Ftrl:
    """FTRL-proximal for softmax regression with L1 and L2 penalties."""

    def __init__(self, n_classes: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((N_FEATURES + 1, n_classes)), np.zeros((N_FEATURES + 1, n_classes))

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, index: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(index)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def fit(
    labelled: DataFrame, max_docs: int = 2000, least_docs: int = 5, epochs: int = 3, alpha: float = 0.5,
    beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> Model | None:
    """A model from (doc_id, text, lang); rows with a null in any of them teach nothing.

    Every label that occurs is learned, and document frequencies count every row.
    The weights see at most max_docs rows, spread evenly over the labels, or
    least_docs rows for each label where that is more; one in five of them is kept
    for the temperature. Rows are chosen by a hash of doc_id and text, so the choice
    does not hang on how rows are dealt out: rows of one doc_id with other texts
    are rows of their own, rows that agree in doc_id, text and lang count once.
    None if there is no row to learn from.
    """
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    quota = max(least_docs, max_docs // len(langs))
    share = {r["lang"]: min(1.0, 1.5 * quota / r["n"] + 0.0) if r["n"] > 3 * quota else 1.0 for r in sizes}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(N_FEATURES, dtype=np.int64), 0
        for batch in batches:
            for index, _, _ in feature_counts(batch.column(0)):
                df[index] += 1
                n += 1
        A.release()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["feature", "n"])

    df = np.zeros(N_FEATURES + 1, dtype=np.int64)
    for r in rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    limits = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    near = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit(17))).where(F.pmod("h", F.lit(1 << 20)) / (1 << 20) < limits[F.col("lang")])
    ranked = near.select("doc_id", "lang", "h").distinct().withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id")))
    chosen = ranked.where(F.col("k") <= quota)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, counts = [], []
            for a, b, _ in feature_counts(batch.column(3)):
                index.append(a.astype(np.int32))
                counts.append(b.astype(np.int32))
            kinds = [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(index, kinds[0]), pa.array(counts, kinds[1])], names=["doc_id", "lang", "k", "index", "counts"])

    near = near.join(chosen, ["doc_id", "lang", "h"]).select("doc_id", "lang", "k", "text")
    sample = near.mapInArrow(features, "doc_id long, lang string, k int, index array<int>, counts array<int>").toPandas()
    sample = sample.sort_values(["k", "lang"]).drop_duplicates(["k", "lang"])  # rows of one rank agree in all that is learned
    sample = [(np.asarray(i, dtype=np.int64), np.asarray(c), langs.index(g), k) for i, c, g, k in zip(sample["index"], sample["counts"], sample["lang"], sample["k"], strict=True) if len(i)]
    learner = Ftrl(len(langs), alpha, beta, l1, l2)
    ready = [(np.append(i, N_FEATURES), np.append(weights_of(c, idf[i]), 1.0), y, k) for i, c, y, k in sample]
    for _ in range(epochs):
        for i, x, y, k in ready:
            if k % 5:
                learner.step(i, x, y)
    w = learner.weights(slice(None))
    held = [(x @ w[i], y) for i, x, y, k in ready if k % 5 == 0]
    return Model(langs, idf, w[:-1], w[-1], _temperature(held))


def _temperature(held: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of least log loss on held rows, by golden-section search on its logarithm."""
    if not held:
        return 1.0
    logits, y = np.array([x for x, _ in held]), np.array([y for _, y in held])

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs with a language and a score under the given names, from whole texts alone.

    A null text, a text without a letter, and any text where no model could be
    learned give lang_pred ``und`` and score 0.
    """
    keep = keep or ["doc_id"]
    text = keep.index("text") if "text" in keep else len(keep)
    columns = keep if "text" in keep else [*keep, "text"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            langs, scores = [], []
            for index, counts, letters in feature_counts(batch.column(text)):
                p = own.probabilities(index, counts) if letters and own else None
                k = int(p.argmax()) if p is not None else 0
                langs.append(own.langs[k] if p is not None else UNKNOWN)
                scores.append(float(p[k]) if p is not None else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*columns).mapInArrow(run, ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double"]))


def held_out() -> Column:
    """Documents that are never learned from: crc32 of doc_id as text leaves 1 modulo 3; so are those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those not held out."""
    model = fit(docs.where(~held_out()), **options)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """The documents whose language is recognised with at least least_score, all columns unchanged."""
    model = fit(docs.where(~held_out()), **options)
    columns = docs.columns
    names = ("_corpuscle_language", "_corpuscle_score")
    scored = predict(docs, model, columns, names)
    return scored.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score)).select(*columns)
