"""Benchmark decontamination with a generalised suffix automaton.

The automaton of the benchmark items' words has one state for every set of
places that the same word sequences end at. Document words stream through it;
at each word the state and the length of the longest match that ends there are
known. Where that length reaches a window, the last words of the match are hit,
and the state tells which items hold them. Documents whose words cannot reach a
window are told apart before, by a vectorised look at runs of benchmark words.

Words are lower-cased runs of ASCII letters and digits and of everything beyond
ASCII. A window is ten words of an item in a row, or a whole shorter item.
A null or empty text has no words; a null item id is matched but not listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .names import spare

WINDOW = 10
BLOCK_BYTES = 8 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """Generalised suffix automaton over words, with the items of each window."""

    def __init__(self, items: list[tuple[list[str], str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.length, self.link = [0], [-1]
        texts = [(w, name) for w, name in items if w]
        for found, _ in texts:
            last = 0
            for word in found:
                last = self._extend(last, word)
        self.least = min((min(len(w), window) for w, _ in texts), default=0)
        # State that stands for the last ``window`` words of every state's match.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        short: dict[tuple[int, int], set[str]] = {}
        for found, name in texts:
            state = 0
            for i, word in enumerate(found):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.items.setdefault(self.at_window(state), set()).update([] if name is None else [name])
            if len(found) < window:
                # The prefix walk stops in the state that holds the whole item.
                short.setdefault((state, len(found)), set()).update([] if name is None else [name])
        for (state, n), names in short.items():
            self.short.setdefault(state, []).append((n, names))
        self.vocabulary = {word for found, _ in texts for word in found}
        ordered = sorted(self.vocabulary)
        raw = [w.encode() for w in ordered]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        hashed = tx.words(data, np.array([0, len(data)]), tx.LETTER_DIGIT).hashes if raw else np.zeros(0, np.uint64)
        self.hashes = np.sort(hashed)

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: str, target: int) -> int:
        """A copy of ``target`` that keeps only matches through ``state``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: str) -> int:
        target = self.next[last].get(word)
        if target is not None:  # another item came this way
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def at_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, found: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word intervals, merged and in order, and the names of the items
        whose windows occur."""
        state = length = 0
        spans: list[tuple[int, int]] = []
        names: set[str] = set()

        def hit(begin: int, end: int) -> None:
            while spans and spans[-1][1] >= begin:
                begin = min(begin, spans.pop()[0])
            spans.append((begin, end))

        for i, word in enumerate(found):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= self.window:
                hit(i + 1 - self.window, i + 1)
                names |= self.items.get(self.at_window(state), set())
            if self.short and length:
                up = state
                while up > 0:
                    for n, owners in self.short.get(up, ()):
                        if n <= length:
                            hit(i + 1 - n, i + 1)
                            names |= owners
                    up = self.link[up]
        return spans, names


def _runs(known: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of benchmark words, inside texts, that reach ``least``."""
    n = len(known)
    if not n or not least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = known.copy(), known.copy()
    begins[1:] &= ~(known[:-1] & (text[1:] == text[:-1]))
    ends[:-1] &= ~(known[1:] & (text[1:] == text[:-1]))
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = b - a >= least
    return a[keep], b[keep]


def _hits(shared, names: list[str]):
    """Per text: (id, text hash, words, hit spans in words and code points, items)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            for part, data, offsets in tx.slices(batch, "text"):
                low = tx.LOWER[data]
                found = tx.words(low, offsets, tx.LETTER_DIGIT)
                counts = np.diff(found.first)
                text = np.repeat(np.arange(len(part)), counts)
                place = np.minimum(np.searchsorted(auto.hashes, found.hashes), max(0, len(auto.hashes) - 1))
                known = auto.hashes[place] == found.hashes if len(auto.hashes) else np.zeros(len(text), bool)
                spans: list[list[dict]] = [[] for _ in range(len(part))]
                items: list[set[str]] = [set() for _ in range(len(part))]
                for a, b in zip(*_runs(known, text, auto.least)):
                    t, raw = int(text[a]), low[found.starts[a]:found.ends[b - 1]].tobytes()
                    base = found.starts[a]
                    seen = [raw[s - base:e - base].decode() for s, e in zip(found.starts[a:b], found.ends[a:b])]
                    hit, owners = auto.scan(seen)
                    if hit:
                        edges = np.array(hit) + a
                        starts = tx.char_positions(data, offsets, found.starts[edges[:, 0]], np.full(len(edges), t))
                        ends = tx.char_positions(data, offsets, found.ends[edges[:, 1] - 1], np.full(len(edges), t))
                        first = found.first[t]
                        spans[t] += [dict(first=int(x - first), last=int(y - first), start=int(p), end=int(q))
                                     for (x, y), p, q in zip(edges, starts, ends)]
                        items[t] |= owners
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(spans, kind),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=names)
    return run


_SPANS = "array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>"


def _merged_spans(spans: str):
    """Overlapping spans of several benchmark blocks become one."""
    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"),
                          last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) for every document.

    The benchmark goes to the workers in automata of ``block_bytes`` of text
    each; a larger benchmark takes several passes over the documents.
    """
    spark = docs.sparkSession
    tx.text_batch(spark)
    questions = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("body")) \
        .filter("body is not null").distinct()
    size = questions.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    names = ["doc_id", "text_hash", "n_words", "spans", "items"]
    schema = f"doc_id {kind}, text_hash long, n_words long, spans {_SPANS}, items array<string>"
    passes = []
    for block in range(blocks):
        rows = questions.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block).collect()
        auto = Automaton([(words_of(r["body"]), r["item"]) for r in rows], window)
        shared = spark.sparkContext.broadcast(auto)
        passes.append(source.mapInArrow(_hits(shared, names), schema))
    if blocks == 1:
        return passes[0]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    hit = every.filter(F.size("spans") > 0).distinct().groupBy(F.col("doc_id").alias("key_hit"), F.col("text_hash").alias("hash_hit")).agg(
        _merged_spans(F.flatten(F.collect_list("spans"))).alias("more_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("more_items"))
    same = F.col("doc_id").eqNullSafe(F.col("key_hit")) & (F.col("text_hash") == F.col("hash_hit"))
    return passes[0].join(hit, same, "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("more_spans", "spans").alias("spans"), F.coalesce("more_items", "items").alias("items"))


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"])


def remove_spans(docs: DataFrame, found: DataFrame, longest: int = WINDOW, coverage: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without their contamination: spans of ``longest`` words or more
    are cut out, and a document whose hit words exceed ``coverage`` of all its
    words goes as a whole. Columns stay as they are."""
    key_found, hash_found, spans_found, words_found = spare(docs.columns, "key_found", "hash_found", "spans_found", "words_found")
    verdict = found.filter(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias(spans_found), F.first("n_words").alias(words_found)) \
        .withColumnsRenamed({"doc_id": key_found, "text_hash": hash_found})
    same = F.col(key).eqNullSafe(F.col(key_found)) & (F.xxhash64(F.col(text).cast("string")) == F.col(hash_found))
    joined = docs.join(verdict, same, "left")
    kept = joined.filter(F.col(key_found).isNull() | F.col(hash_found).isNull() | (n_hit(spans_found) <= coverage * F.col(words_found)))
    long = F.filter(spans_found, lambda x: x["last"] - x["first"] >= longest)
    cut = F.aggregate(long, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
                      lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("out")),
                      lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(F.col(text)))))
    return kept.withColumn(text, F.when(F.col(spans_found).isNotNull(), cut).otherwise(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns])
