"""Language identification with a string kernel.

The kernel of two texts counts the letter n-grams, of one to four bytes of the
lower-cased UTF-8 text, that are present in both, over the geometric mean of
what is present in each. N-grams longer than one byte live in hashed slots.
Landmark texts span a Nystroem approximation; one-versus-rest ridge regression
is solved on it, on a bounded sample of labelled rows. A text's score is a
product of its presence row with the landmarks' rows, folded into one weight per
slot and language, so whole batches are scored by one matrix product.

A null text, and a text without a letter, is ``und`` with score 0. Language,
source and id are never read for a prediction. Repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .sampling import bounded_sample, held_out

UNKNOWN = "und"
TRAIN_ROWS, TRAIN_BYTES = 3000, 32 << 20
LANDMARKS = 160
RIDGE = 1e-3
# Slots of each length of n-gram.
_BITS = {1: 8, 2: 14, 3: 15, 4: 16}
_STARTS = {n: sum(1 << b for m, b in _BITS.items() if m < n) for n in _BITS}
SLOTS = sum(1 << b for b in _BITS.values())
_ROWS = 48

# ASCII that is no letter counts as a space; letters beyond ASCII stay.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # slots x languages
    calm: float          # kernel mass that a text of a known language has at least


def _mark(present: np.ndarray, row: np.ndarray | int, data: np.ndarray) -> None:
    """Set the slots of all n-grams of ``data``; ``row`` is the text of each byte.

    An n-gram that would reach over the end of its text is not one.
    """
    code = np.zeros(len(data), np.uint32)
    for n, bits in _BITS.items():
        if len(data) < n:
            return
        code = (code[:len(data) - n + 1] << np.uint32(8)) | data[n - 1:]
        slot = code if n == 1 else (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        if isinstance(row, int):
            present[row, _STARTS[n] + slot] = 1
        else:
            same = row[:len(code)] == row[n - 1:]
            present[row[:len(code)][same], _STARTS[n] + slot[same]] = 1


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 0 and 1 per text, normalised to length 1."""
    present = np.zeros((len(offsets) - 1, SLOTS), np.float32)
    folded = _LETTERS[data]
    if len(data) <= 2 * tx.SLICE_BYTES:
        _mark(present, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), folded)
    else:  # one long text
        for t, (a, b) in enumerate(zip(offsets, offsets[1:])):
            for at in range(int(a), int(b), tx.SLICE_BYTES):
                _mark(present, t, folded[at:min(int(b), at + tx.SLICE_BYTES + 3)])
    norms = np.sqrt(np.einsum("ij,ij->i", present, present))
    present /= np.maximum(norms, 1)[:, None]
    return present


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regression of language indicators on the landmarks' feature space."""
    languages = sorted({lang for _, lang in sample})
    by_lang = {lang: [t for t, x in sample if x == lang] for lang in languages}
    share = max(1, landmarks // max(1, len(languages)))
    chosen = [t for lang in languages for t in by_lang[lang][:share]]
    if not chosen:
        return Model([], np.zeros((SLOTS, 0), np.float32), 0.0)
    marks = presence(*_buffer(chosen))
    gram = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    width = root.shape[1] + 1
    left, right = np.zeros((width, width)), np.zeros((width, len(languages)))
    mass = []
    where = {lang: i for i, lang in enumerate(languages)}
    for at in range(0, len(sample), _ROWS):
        part = sample[at:at + _ROWS]
        kernel = (presence(*_buffer([t for t, _ in part])) @ marks.T).astype(np.float64)
        mass += kernel.max(axis=1).tolist()
        x = np.hstack([kernel @ root, np.ones((len(part), 1))])
        y = np.zeros((len(part), len(languages)))
        y[np.arange(len(part)), [where[lang] for _, lang in part]] = 1
        # Each language weighs the same, however many rows it has.
        w = np.array([len(sample) / len(languages) / len(by_lang[lang]) for _, lang in part])[:, None]
        left += x.T @ (x * w)
        right += x.T @ (y * w)
    solved = np.linalg.solve(left + ridge * len(sample) * np.eye(width), right)
    # scores = presence @ (marks.T @ root @ solved[:-1]) + bias; the bias rides
    # along as a last row.
    weights = np.vstack([marks.T @ (root @ solved[:-1]).astype(np.float32), solved[-1:].astype(np.float32)])
    return Model(languages, weights, float(np.min(mass)))


def has_letter(text: str) -> bool:
    return re.search("[A-Za-z]", text) is not None or any(c.isalpha() for c in text)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return presence(data, offsets) @ model.weights[:-1] + model.weights[-1]


def _predicted(shared):
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lowered = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pc.utf8_lower(batch.column(2))], names=["key", "held", "text", "low"])
            for at in range(0, len(batch), _ROWS):
                for part, data, offsets in tx.slices(lowered.slice(at, _ROWS), "low"):
                    raw = scores(model, data, offsets) if model.languages else np.zeros((len(part), 0))
                    letters = np.array([t is not None and has_letter(t) for t in part.column(2).to_pylist()], bool)
                    clipped = np.clip(raw, 0, None) + 1e-9
                    best = clipped.argmax(axis=1) if model.languages else np.zeros(len(part), int)
                    sure = clipped[np.arange(len(part)), best] / clipped.sum(axis=1) if model.languages else np.zeros(len(part))
                    known = letters & bool(model.languages)
                    langs = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), part.column(1), pa.array(langs, pa.string()),
                        pa.array(np.where(known, sure, 0.0).astype(np.float64)),
                        pa.array(np.where(known, raw.max(axis=1, initial=0.0), 0.0).astype(np.float64))],
                        names=["doc_id", "held_out", "lang_pred", "score", "strength"])
    return run


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most ``TRAIN_ROWS`` rows that are not held out, shared equally
    by the languages."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("body"), F.col(lang).cast("string").alias("label")) \
        .filter(~held_out(key)).filter(F.col("body").rlike(r"\p{L}"))
    return fit(bounded_sample(rows, "body", TRAIN_ROWS, TRAIN_BYTES, label="label"))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, strength). ``score`` is the best
    language's share of all languages' outputs, ``strength`` its output itself."""
    spark = docs.sparkSession
    tx.text_batch(spark)
    # Slots and languages are fixed, so the model's size is.
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(_predicted(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, strength double")


def filter_known(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """Documents in a learned language: those with a letter whose best language
    reaches ``least``. Columns stay as they are. A model of no language keeps
    nothing."""
    spark = docs.sparkSession
    tx.text_batch(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(batch.schema.get_field_index(text))
            asked = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), pa.nulls(len(batch), pa.bool_()), body], names=["doc_id", "held_out", "text"])
            keep = np.zeros(len(batch), bool)
            for found in _predicted(shared)(iter([asked])):
                good = [lang != UNKNOWN and s >= least for lang, s in zip(found.column(2).to_pylist(), found.column(4).to_pylist())]
                keep[found.column(0).to_numpy(zero_copy_only=False)] = good
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
