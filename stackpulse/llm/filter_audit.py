"""How text filters interact, with duplicates found in radix tries.

Copies are found by their whole text. Texts are dealt to ranges whose borders
are the shortest prefixes that tell neighbours of a size-weighted sample apart,
so crowded prefixes get longer borders and more ranges. Equal texts of a task
are folded, with their least id, before they travel. Inside a range the texts
come sorted and are put whole into compressed tries, whose terminals hold the
least id; a trie is closed between two different texts once it holds
``TRIE_BYTES``, so memory stays bounded however full a range is. Walking the
tries gives one least id for each text; every other row of that text, with a
larger id, is a duplicate.

Each row's failures then become a mask. Masks are counted by part, and the
counts, not the rows, are put through all orders of the filters.

A null text counts as empty, a null part as the empty string. A null id is no
smaller than any other and has none that is smaller, so such rows are never
duplicates; rows that repeat an id are not duplicates of each other. Labels that
repeat an id count if any of them says so. Very long texts are taken whole. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from . import text as tx

FILTERS = "ABCDE"
SPECIAL = b"#$%&*|"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
SAMPLE = 8192            # sampled texts, on average
BORDER_CHARS = 2048      # of a sampled text
RANGE_BYTES, MOST_RANGES = 32 << 20, 4096
TRIE_BYTES, FOLD_BYTES = 32 << 20, 16 << 20


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of the filters A to D that a text fails."""
    upper, special = np.zeros(256, bool), np.zeros(256, bool)
    upper[0x41:0x5B] = True
    special[list(SPECIAL)] = True
    for batch in batches:
        for part, data, offsets in tx.slices(batch, "text"):
            found = tx.words(data, offsets, tx.SPACE)
            n_words = np.diff(found.first)
            owner = np.repeat(np.arange(len(n_words)), n_words)
            order = np.lexsort((found.hashes, owner))
            new = np.ones(len(order), bool)
            new[1:] = (owner[order][1:] != owner[order][:-1]) | (found.hashes[order][1:] != found.hashes[order][:-1])
            distinct = np.bincount(owner[order][new], minlength=len(n_words))

            def count(flags: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flags)])
                return sums[offsets[1:]] - sums[offsets[:-1]]

            chars = count((data & 0xC0) != 0x80)
            fails = [n_words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n_words, 100 * count(upper[data]) > UPPER_PERCENT * chars, count(special[data]) > 0]
            letters = ["".join(x for x, bad in zip(FILTERS, row) if bad) for row in zip(*fails)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(letters, pa.string())], names=["doc_id", "part", "text_key", "fails"])


def borders(sample: list[bytes], ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 borders at quantiles of the sample, each cut to
    the shortest prefix that is above the sampled text before it."""
    ordered = sorted(set(sample))
    out = []
    for k in range(1, ranges):
        at = k * len(ordered) // ranges
        if not 0 < at < len(ordered):
            continue
        before, here = ordered[at - 1], ordered[at]
        border = here[:_shared(before, here, 0) + 1]
        if not out or border > out[-1]:
            out.append(border)
    return out


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie of byte strings with the least id at each terminal.

    A node is [edges, least id]; an edge, kept by its first byte, is (label,
    node). Null stands for no terminal.
    """

    def __init__(self) -> None:
        self.root: list = [{}, None]
        self.held = 0

    def insert(self, text: bytes, least) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                node[0][text[at]] = (text[at:], [{}, least])
                self.held += len(text) - at + 200
                return
            label, child = edge
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, text, at)
            fork: list = [{label[n]: (label[n:], child)}, None]
            node[0][text[at]] = (label[:n], fork)
            self.held += 200
            node, at = fork, at + n
        node[1] = least if node[1] is None else min(node[1], least)

    def terminals(self) -> Iterator[tuple[str, object]]:
        """(digest of the whole text, least id) of every text held."""
        stack = [(self.root, hashlib.md5())]
        while stack:
            (edges, least), digest = stack.pop()
            if least is not None:
                yield digest.hexdigest(), least
            for label, child in edges.values():
                below = digest.copy()
                below.update(label)
                stack.append((child, below))


def _dealt(shared):
    """(range, text, least id), equal texts of a stretch of a task folded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        held: dict[bytes, object] = {}
        n = 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            texts = list(held)
            return pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, t) for t in texts], pa.int32()), pa.array(texts, pa.binary()), pa.array(list(held.values()), kind)], names=["range", "text", "least"])

        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for least, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                known = held.get(raw)
                if known is None:
                    n += len(raw) + 100
                    held[raw] = least
                elif least < known:
                    held[raw] = least
                if n >= FOLD_BYTES:
                    yield flush(kind)
                    held, n = {}, 0
        if held:
            yield flush(kind)
    return run


def _walked(most: int):
    """Terminals of the tries of a partition, whose texts come sorted."""
    def emit(trie: Trie, kind: pa.DataType) -> pa.RecordBatch:
        rows = list(trie.terminals())
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.string()), pa.array([i for _, i in rows], kind)], names=["text_key", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, kind = Trie(), None, pa.null()
        for batch in batches:
            kind = batch.column(1).type
            for text, least in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py()
                if trie.held >= most and raw != last:
                    yield emit(trie, kind)
                    trie = Trie()
                trie.insert(raw, least)
                last = raw
        if last is not None:
            yield emit(trie, kind)
    return run


def first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(text_key, least): the least id of every different text; the key is the
    MD5 of the text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("least"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("least is not null")
    size = F.octet_length("text") + 1
    total = rows.agg(F.coalesce(F.sum(size.cast("double")), F.lit(0.0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(min(MOST_RANGES, max(4 * parts, total // range_bytes + 1)))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    # A text is drawn by its size and hash, so copies are drawn together and
    # count once; no more than the bound are sent, each cut to its start.
    drawn = rows.filter(place * F.lit(total) < size * SAMPLE).select(F.substring("text", 1, BORDER_CHARS).alias("start")).distinct().limit(4 * SAMPLE).collect() if total else []
    cuts = spark.sparkContext.broadcast(borders([r["start"].encode() for r in drawn], ranges))  # ``MOST_RANGES`` borders at most
    kind = docs.schema[key].dataType.simpleString()
    dealt = rows.select("least", F.col("text").cast("binary").alias("text")).mapInArrow(_dealt(cuts), f"range int, text binary, least {kind}")
    deal = dealt.repartition(max(parts, ranges // 4), "range").sortWithinPartitions("text").select("text", "least")
    return deal.mapInArrow(_walked(trie_bytes), f"text_key string, least {kind}")


def failing_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, fails): the letters of the filters that each row fails."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.md5(whole.cast("binary")).alias("text_key"), whole.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    masks = rows.mapInArrow(_failures, f"doc_id {kind}, part string, text_key string, fails string")
    firsts = first_copies(docs, key, text).withColumnRenamed("text_key", "first_key")
    joined = masks.join(firsts, (F.col("doc_id") == F.col("least")) & (F.col("text_key") == F.col("first_key")), "left")
    return joined.select("doc_id", "part", F.when(F.col("doc_id").isNotNull() & F.col("least").isNull(), F.concat("fails", F.lit("E"))).otherwise(F.col("fails")).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    marks = labels.select(F.col("doc_id").alias("marked"), "quality", "toxic").filter("marked is not null").groupBy("marked") \
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    failing = failing_filters(docs, key, text, part)
    marked = failing.join(marks, F.col("doc_id") == F.col("marked"), "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    masks = materialise(marked.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n")), "filter-masks")
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = masks.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))) \
        .withColumn("letter", F.expr("substring(filter_order, step, 1)")) \
        .withColumn("before", F.expr("substring(filter_order, 1, step - 1)")) \
        .withColumn("gone", F.expr("translate(before, fails, '') <> before")) \
        .withColumn("failing", F.expr("instr(fails, letter) > 0"))

    def total(condition: str, name: str, weight: str = "n") -> F.Column:
        return F.sum(F.expr(f"case when {condition} then cast({weight} as long) else 0L end")).alias(name)

    return steps.groupBy("part", "filter_order", "step").agg(
        total("not gone and not failing", "kept"), total("failing and not gone", "removed"), total("failing and gone", "redundant"),
        total("fails = letter", "unique_fails"), total("failing and not gone and good", "good_lost"), total("failing and not gone and toxic", "toxic_lost"),
        total("failing", "shapley", f"n * {len(list(itertools.permutations(FILTERS)))} div length(fails)"))
