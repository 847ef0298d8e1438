"""Toxicity by multiple-instance learning.

A document is toxic if one of its sentences is. Each sentence gets a chance from
its words and their beginnings, by a logistic model over hashed features; a
noisy-or joins the chances of a document's sentences. Only documents carry
labels: the weights are fitted by gradient steps on the likelihood of those,
through the noisy-or, on a bounded sample of each label, weighted back to the
labels' shares. The fitted sentence chances then point at the offending
sentences.

Null and empty texts have no sentences and score 0. Labels, language, source and
id are never read for a score. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .sampling import bounded_sample, held_out

TRAIN_ROWS, TRAIN_BYTES = 4000, 32 << 20
BITS = 20
BEGINNINGS = (3, 4, 5, 6)  # bytes
CUT = 0.3
OFFENDING = 0.5
_STEPS, _RATE, _DECAY = 200, 0.1, 1e-3
_LEAST_DOCS, _LIFT = 3, 5.0

_WORD = tx.LETTER_DIGIT
_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True  # newline, return, ! . ?


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


class Sentences(NamedTuple):
    slots: np.ndarray     # of each word, a row for the word and one for each beginning
    sentence: np.ndarray  # of each word
    text: np.ndarray      # of each sentence
    start: np.ndarray     # of each sentence, bytes
    end: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Sentences that hold a word, of all texts of a buffer."""
    low = tx.LOWER[data]
    found = tx.words(low, offsets, _WORD)
    n = len(found.starts)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_END[data], out=ends[1:])
    stops = ends[found.starts]
    new = np.ones(n, bool)
    new[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], n)[:len(heads)] - 1
    shift = np.uint64(64 - BITS)
    slots = np.empty((1 + len(BEGINNINGS), n), np.int32)
    slots[0] = found.hashes >> shift
    sums = tx.prefix_sums(low) if n else None
    for row, size in enumerate(BEGINNINGS, 1):
        # A word that is no longer than its beginning stands for itself.
        slots[row] = tx.mix(tx.span_hashes(sums, found.starts, np.minimum(found.starts + size, found.ends)) + np.uint64(row)) >> shift if n else 0
    return Sentences(slots, sentence, text[heads], found.starts[heads], found.ends[tails] if n else heads)


def sentence_logits(model: Model, s: Sentences) -> np.ndarray:
    return model.bias + np.bincount(s.sentence, model.weights[s.slots].sum(axis=0), len(s.text))


def document_scores(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or: one minus the product of the chances of being harmless."""
    harmless = np.bincount(text, -np.logaddexp(0, logits), n)
    return -np.expm1(harmless)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, sentence) of every feature and the text of every sentence."""
    slots, sents, owners, base = [], [], [], 0
    raw = [t.encode() for t in texts]
    for at in range(0, len(raw), 256):
        part = raw[at:at + 256]
        s = sentences(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
        slots.append(s.slots.ravel()), sents.append(np.tile(s.sentence + base, len(s.slots))), owners.append(s.text + at)
        base += len(s.text)
    return tuple(map(np.concatenate, (slots, sents, owners)))


def fit(sample: list[tuple[str, int]], toxic_share: float | None = None) -> Model:
    """Adam steps on the mean log-likelihood of the document labels, weighted so
    that ``toxic_share`` of the weight is toxic.

    Only features that are in several toxic documents, and more common there
    than elsewhere, get a weight.
    """
    y = np.array([int(label) for _, label in sample], float)
    if not len(y) or not y.any():
        return Model(np.zeros(1 << BITS, np.float32), -50.0)
    if y.all():
        y, sample = np.append(y, 0.0), [*sample, ("", 0)]
    share = y.mean() if toxic_share is None else min(max(toxic_share, 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum())
    slot, sentence, text = _features([t for t, _ in sample])
    size = 1 << BITS
    pairs = np.unique(text[sentence] * size + slot)
    toxic = y[pairs // size] > 0
    loud, calm = (np.bincount(pairs[m] % size, minlength=size) for m in (toxic, ~toxic))
    chosen = (loud >= min(_LEAST_DOCS, y.sum())) & (loud / y.sum() >= _LIFT * calm / (1 - y).sum())
    used = chosen[slot]
    columns, slot = np.unique(slot[used], return_inverse=True)
    sentence = sentence[used]
    w, b = np.zeros(len(columns)), -6.0
    m, v = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    for step in range(1, _STEPS + 1):
        z = b + np.bincount(sentence, w[slot], len(text))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        chance = np.clip(document_scores(z, text, len(y)), 1e-9, 1 - 1e-9)
        pull = np.where(y[text] > 0, -p * ((1 - chance) / chance)[text], p) * weight[text]
        g = np.append(np.bincount(slot, pull[sentence], len(columns)) + _DECAY * share * w, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = _RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size, np.float32)
    weights[columns] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``TRAIN_ROWS`` labelled rows that are not held out. A
    document with several labels counts as toxic if one of them says so."""
    marks = labels.select(F.col(key).alias("key"), (F.col(label).cast("int") > 0).cast("int").alias("label")) \
        .filter("key is not null and label is not null").filter(~held_out("key")).groupBy("key").agg(F.max("label").alias("label"))
    share = marks.agg(F.avg("label")).first()[0]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body")).filter(~held_out("key"))
    return fit(bounded_sample(rows, "body", TRAIN_ROWS, TRAIN_BYTES, marks=marks, key="key"), share)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, data, offsets in tx.slices(batch, "text"):
                s = sentences(data, offsets)
                z = sentence_logits(model, s)
                chance = document_scores(z, s.text, len(part))
                bad = np.flatnonzero(z >= np.log(OFFENDING / (1 - OFFENDING)))
                starts = tx.char_positions(data, offsets, s.start[bad], s.text[bad])
                ends = tx.char_positions(data, offsets, s.end[bad], s.text[bad])
                edges = pa.array(np.searchsorted(s.text[bad], np.arange(len(part) + 1)).astype(np.int32))
                spans = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], names=["start", "end"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.clip(chance, 0, 1)), spans], names=["doc_id", "held_out", "score", "offending"])
    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, offending): chance that a document is toxic and
    the code-point spans of its sentences that are toxic on their own."""
    spark = docs.sparkSession
    tx.text_batch(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^BITS weights
    source = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(_scored(shared), f"doc_id {kind}, held_out boolean, score double, offending array<struct<start: bigint, end: bigint>>")
