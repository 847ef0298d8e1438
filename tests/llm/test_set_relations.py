"""The n-gram join, the filter audit and the vector codes against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackpulse.llm import ball_codes, filter_audit, set_join

from . import brute
from .conftest import read, rows


def classes(docs, numerator=80):
    return sorted(((d, n, c) for d, n, c, _ in brute.near_duplicates(docs, numerator)), key=repr)


def family(rng, size, edits, words=90):
    """Near copies of one text, each with some words replaced."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def crowded():
    """A large family around the limit, a passage in unlike texts, short texts."""
    rng = random.Random(11)
    texts = family(rng, 150, 3) + family(rng, 60, 2, 30)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 12))) + " " + passage for _ in range(60)]
    texts += [passage] * 40 + ["a b c", "A  b c", "a b", "", None]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    return docs


def test_join_of_odd_rows(odd, odd_docs):
    got = rows(set_join.jaccard_classes(odd))
    assert got == classes(odd_docs)


@pytest.mark.parametrize("numerator", [80, 90])
@pytest.mark.parametrize("heavy", [8, 10**6])
def test_join_of_crowded_lists(spark, crowded, heavy, numerator):
    """Long lists by differences to hubs, or all lists entry by entry."""
    docs = spark.createDataFrame(crowded, "doc_id long, text string").repartition(6)
    assert rows(set_join.jaccard_classes(docs, numerator=numerator, heavy=heavy)) == classes(crowded, numerator)


def test_join_without_broadcast(spark, crowded):
    docs = spark.createDataFrame(crowded, "doc_id long, text string").repartition(6)
    assert rows(set_join.jaccard_classes(docs, heavy=8, most_broadcast=0)) == classes(crowded)


def test_classes_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(set_join, "TASK_LINKS", 7)
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a long, b long").repartition(9)
    assert {r["node"]: r["component"] for r in set_join.classes_of(links).collect()} == {i: i - i % 20 for i in range(60)}


def test_join_of_nothing(nothing):
    assert rows(set_join.jaccard_classes(nothing)) == []


def test_size_classes_cover_every_link():
    """Sets that can link share a block, whatever their sizes."""
    for x in list(range(1, 400)) + [5000, 5001, 6250, 6251]:
        for y in {x, -(-80 * x // 100)}:
            need = set_join.needed(x, y, 80, 100)
            # The first common shingle of a link is as far back as this, at most.
            got = []
            for n, low in ((x, True), (y, y == x)):
                batch = set_join._pack(np.array([7 << 32], np.uint64), np.array([99]), np.array([n]), np.array([n]), np.array([n - need]))
                got.append({r["class"] for out in set_join._long_entries(80, 100)(iter([batch])) for r in out.to_pylist()})
            assert got[0] & got[1], (x, y)


def test_audit_of_documents(spark, sf):
    docs = read(sf, "documents", "doc_id, text, lang")
    labels = read(sf, "labels", "doc_id, quality, toxic")
    got = rows(filter_audit.audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    assert got == sorted(brute.audit(docs, labels), key=repr)


def test_audit_of_odd_rows(odd, odd_docs, spark):
    """Null ids, repeated ids, copies, clashing names; tries closed early."""
    parts = odd.withColumn("lang", F.when(F.length("text") % 3 == 0, F.lit("xx"))).withColumn("fails", F.lit("q")).withColumn("least", F.lit(0))
    listed = [(d, t, "xx" if t is not None and len(t) % 3 == 0 else None) for d, t in odd_docs]
    assert rows(filter_audit.failing_filters(parts)) == sorted(brute.failing(listed), key=repr)
    small = filter_audit.first_copies(odd, trie_bytes=1)
    assert rows(small) == rows(filter_audit.first_copies(odd))
    labels = [(d, i % 2, i % 3 == 0 and 1 or 0) for i, (d, _) in enumerate(odd_docs)] + [(odd_docs[0][0], None, None), (None, 1, 1)]
    got = rows(filter_audit.audit(parts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == sorted(brute.audit(listed, [x for x in labels if x[0] is not None]), key=repr)


def test_audit_of_nothing(nothing, spark):
    assert rows(filter_audit.audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == []


def test_trie_against_a_dictionary():
    rng = random.Random(3)
    trie, plain = filter_audit.Trie(), {}
    for i in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        trie.insert(text, i)
        plain.setdefault(text, i)
    found = list(trie.terminals())
    assert len(found) == len(plain)
    assert Counter(i for _, i in found) == Counter(plain.values())


def test_borders_are_short_and_even():
    sample = [f"common start {i:04d} and more".encode() for i in range(1000)]
    cuts = filter_audit.borders(sample, 10)
    assert len(cuts) == 9 and max(map(len, cuts)) <= len("common start 0000")
    share = Counter(sum(c <= s for c in cuts) for s in sample)
    assert max(share.values()) <= 120


def coded(vectors, **options):
    out, books = ball_codes.vector_codes(vectors, **options)
    return sorted(((r[0], r[1].hex(), r[2]) for r in out.select("vec_id", "codes", "error").collect()), key=repr), books.tolist()


def test_codes_of_embeddings(spark, sf):
    got, books = coded(spark.read.parquet(f"{sf}/embeddings.parquet"))
    want, want_books = brute.vector_codes(read(sf, "embeddings", "vec_id, embedding, label"))
    assert got == sorted(want, key=repr) and books == want_books


def test_codes_of_odd_vectors(spark):
    rng = random.Random(4)
    listed = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(32)], i % 3 or None) for i in range(90)]
    listed += [(i, [0.0] * 32, None) for i in range(200, 230)]  # ties throughout
    listed += [listed[5], listed[5], (None, [9.0] * 32, 1), (300, [1e6] * 32, 1), (301, [-3e5] * 32, 1)]
    odd = [(400, None, 1), (401, [None] * 32, 1), (402, [math.nan] * 32, 1), (403, [math.inf] + [0.0] * 31, 1), (404, [], 1), (405, [1.0] * 31, 1)]
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in listed + odd], "vec_id long, embedding array<double>, label int, error int, codes string, whole int").repartition(4)
    want, want_books = brute.vector_codes([(i, [min(max(x, -524288.0), 524288.0) for x in v], y) for i, v, y in listed])
    got, books = coded(df)
    assert books == want_books and got == sorted(want, key=repr)
    of_label: dict = {}
    errors = {}
    for (i, code, error), (_, _, label) in zip(want, listed):
        of_label[label] = of_label.get(label, 0) + error
    for few in (10, 0):
        out = ball_codes.with_label_error(ball_codes.vector_codes(df)[0], few).collect()
        assert len(out) == len(listed) and all(r["label_error"] == of_label[r["label"]] for r in out)


def test_lengths_that_do_not_divide(spark):
    rng = random.Random(6)
    listed = [(i, [rng.uniform(-1, 1) for _ in range(20)], 0) for i in range(70)]
    got, _ = coded(spark.createDataFrame(listed, "vec_id long, embedding array<double>, label int"))
    assert got == sorted(brute.vector_codes([(i, v + [0.0] * 12, y) for i, v, y in listed])[0], key=repr)


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out, books = ball_codes.vector_codes(empty)
    assert ball_codes.with_label_error(out).collect() == [] and books.size == 0


def test_balls_save_distances():
    """On clustered parts most distances are never worked out, and every code
    equals that of the plain search."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))
    own = ball_codes.search_all(x, centres)
    book = centres + rng.integers(-15, 15, centres.shape)
    far = ((x - centres[own]) ** 2).sum(1)
    radii = [float(np.max(far[own == k], initial=0)) ** 0.5 + float(((book[k] - centres[k]) ** 2).sum()) ** 0.5 for k in range(64)]
    found, work = ball_codes.search_balls(x, own, book, ball_codes.neighbours(book, radii))
    assert (found == ball_codes.search_all(x, book)).all()
    assert work < 0.2 * x.shape[0] * 64
