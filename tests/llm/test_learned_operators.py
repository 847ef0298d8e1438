"""Language, toxicity and licences on held-out rows; shards and vector search
against their laws; the pipeline against its stages."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from stackpulse.llm import bpe, language, licences, multi_index, sampling, shards, toxicity

from . import brute
from .conftest import read, rows

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    ids = [0, 1, 2, 17, 123456789, -5, None]
    got = rows(spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", sampling.held_out()))
    assert got == sorted([(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i in ids], key=repr)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(f"{i} " * (i % 7 + 1), str(i % 3)) for i in range(500)] + [("x" * 10_000, "0"), (None, "1"), ("y", None)], "text string, lang string")
    got = sampling.bounded_sample(docs, "text", 90, 100_000, label="lang")
    assert len(got) == 90 and {x for _, x in got} == {"0", "1", "2"} and all(len(t) < 1000 for t, _ in got)
    assert got == sampling.bounded_sample(docs.repartition(7), "text", 90, 100_000, label="lang")
    assert sum(len(t) for t, _ in sampling.bounded_sample(docs, "text", 400, 1200 * 3, label="lang")) <= 3600


def test_language_kernel():
    """Presence rows are unit vectors, and their product is the kernel."""
    texts = ["the cat and the dog", "the cat", "", "über straße", "x" * 100]
    p = language.presence(*language._buffer(texts))
    assert np.allclose((p * p).sum(1), [1, 1, 0, 1, 1], atol=1e-5)

    def grams(t):
        raw = "".join(c if c.isalpha() else " " for c in t.lower()).encode()
        return {raw[i:i + n] for n in (1, 2, 3, 4) for i in range(len(raw) - n + 1)}

    a, b = map(grams, texts[:2])
    assert abs(float(p[0] @ p[1]) - len(a & b) / (len(a) * len(b)) ** 0.5) < 0.02


def test_long_texts_are_read_whole():
    long = "lorem ipsum " * 200_000 + "zyxwvq"
    whole = language.presence(*language._buffer([long]))
    assert (whole > 0).sum() == (language.presence(*language._buffer(["lorem ipsum " * 10 + "zyxwvq"])) > 0).sum()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in entry.queries()["op4_language"](spark, SF).collect()}
    truth = dict(read(SF, "documents", "doc_id, lang"))
    held = [d for d, r in got.items() if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 150
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_reads_text_only(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    base = rows(language.predict(docs, model).select("doc_id", "lang_pred", "score"))
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert rows(language.predict(other, model).select("doc_id", "lang_pred", "score")) == base
    got = rows(language.predict(odd, model))
    assert len(got) == odd.count()
    blank = {t for t in (None, "", " \n\t ", "...", "12345")}
    bad = {r["doc_id"] for r in odd.collect() if r["text"] in blank and r["doc_id"] is not None}
    assert all((p == "und") == (s == 0) for _, _, p, s, _ in got) and {d for d, _, p, _, _ in got if p == "und"} >= bad
    assert language.predict(nothing, model).count() == 0
    empty = language.train(nothing)
    assert empty.languages == [] and {r[2] for r in rows(language.predict(odd, empty))} == {"und"}
    kept = language.filter_known(docs, model, corpus_pipeline.LEAST_STRENGTH)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()
    assert language.filter_known(odd, empty, 0.1).count() == 0


def test_toxicity(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op5_toxicity"](spark, SF).collect()}
    truth = dict(read(SF, "labels", "doc_id, toxic"))
    held = [d for d in truth if d in got and got[d]["held_out"]]
    right = sum(got[d]["predicted"] == truth[d] for d in held)
    assert right / len(held) > 0.95
    texts = dict(read(SF, "documents", "doc_id, text"))
    found = [texts[d][s["start"]:s["end"]] for d, r in got.items() if truth.get(d) == 1 for s in r["offending"]]
    assert found and all("\n" not in f for f in found)


def test_noisy_or():
    model = toxicity.fit([("Good day. You are rotten. Fine weather.", 1), ("Good day. Fine weather.", 0), ("Rotten. Good.", 1), ("Fine. Good weather day.", 0),
                          ("A rotten day", 1), ("Weather you are", 0)] * 5)
    raw = ["Good day. Rotten egg.", "Fine. Weather.", ""]
    data = [t.encode() for t in raw]
    s = toxicity.sentences(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    z = toxicity.sentence_logits(model, s)
    p = 1 / (1 + np.exp(-z))
    chance = toxicity.document_scores(z, s.text, 3)
    assert len(z) == 4 and p[1] == p.max() and chance[0] > 0.5 > chance[1] and chance[2] == 0
    assert abs(chance[0] - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-9


def test_toxicity_odd_rows(spark, odd, nothing):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = rows(toxicity.score(odd, model))
    assert len(got) == odd.count() and all(0 <= r[2] <= 1 for r in got)
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.train(nothing, labels)
    assert all(r[2] < 1e-6 for r in rows(toxicity.score(odd, none)))


def test_licences(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, classes, cut = licences.train(docs)
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licences.scan(docs, model, classes, cut).collect()}
    planted = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
               "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0"}
    want = {(d, i): planted[line] for d, t in read(SF, "documents", "doc_id, text") for i, line in enumerate((t or "").split("\n")) if line in planted}
    assert want and {k: v for k, v in got.items() if v != licences.UNKNOWN} == want
    extra = spark.createDataFrame([
        (1, "Some words.\nthis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
        (2, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (3, None), (4, ""), (5, "\n\n"), (6, "Licensed to kill, under the sea.")], "doc_id long, text string")
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(extra, model, classes, cut).filter("confirmed").collect()} == {(1, 1, "gpl-3.0"), (2, 0, "bsd-3-clause")}
    assert licences.scan(nothing, model, classes, cut).count() == 0
    assert licences.scan(odd, model, classes, cut).filter("confirmed").count() >= 0


def test_runs_are_looked_for_where_pairs_are(spark):
    """Runs of three words are built for lines with two pairs of a template only,
    and the lines that go are those that hold a whole run."""
    texts = ["this work is licensed to kill", "released under the mit licence of the license", "under the MIT, license", "the sea", "a license, a license", None,
             "released under the and under the mit", "you may not; use this", "any person; person obtaining a", "\u00dcber the License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = set(licences._template_runs(3))

    def holds(text):
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        return any(" ".join(w[i:i + 3]) in runs for i in range(len(w) - 2))

    got = licences.other_lines(docs)
    kept = [t for t in texts if t and not holds(t)]
    assert 0 < len(kept) < len(texts) - 1 and got.agg(F.sum("n")).first()[0] == len(kept)
    tests = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "arrays_overlap" in x]
    assert tests and all("CASE WHEN" in x.split("arrays_overlap")[0] for x in tests)


def test_licences_learn_from_all_lines(spark, nothing):
    """No different line is left out of the training and the cut, however many or
    long they are; copies count once."""
    import re

    texts = [f"row {i} of a licence\r\nunder water {i % 3}\n\n--" for i in range(6000)]
    texts += ["word " * 3000 + "end", None, "", "Released under the MIT License.\nsoftware"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x for t in texts for x in re.split(r"\r?\n", t or "") if re.search(r"\w", x)} - {"Released under the MIT License."}
    got = licences.other_lines(docs)
    assert got.agg(F.sum("n")).first()[0] == len(want) == 6005
    assert got.count() < 20
    p = [i / 4000 for i in range(4000)]
    scored = spark.createDataFrame([(x, 1 + (i % 2)) for i, x in enumerate(p)], "p double, n long")
    assert licences.passing_cut(scored) == p[-4] and licences.passing_cut(scored.limit(0)) == 0.5
    model, classes, cut = licences.train(nothing)
    found = licences.scan(docs, model, classes, cut).filter("confirmed").collect()
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in found] == [(6003, 0, "mit")]


def test_wrapped_licences(spark):
    """Notices broken at 60 to 80 columns, as plain blocks and as comments."""
    import textwrap

    model, classes, cut = licences.train(spark.read.parquet(f"{SF}/documents.parquet"))
    docs, want = [], {}
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            if len(t.split()) < 17:
                continue
            for width in (60, 70, 80):
                for mark in ("", "# "):
                    wrapped = textwrap.fill(t, width, initial_indent=mark, subsequent_indent=mark)
                    want[len(docs)] = family
                    docs.append((len(docs), f"Some words that come before.\n\n{wrapped}\n\nAnd some that come after."))
    found = licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), model, classes, cut).filter("confirmed").collect()
    assert {r["doc_id"]: r["family"] for r in found} == want
    assert all(r["paragraph"] >= 2 for r in found)


@pytest.mark.parametrize("ranges", [None, 3, 200])
def test_shards(spark, odd, odd_docs, ranges):
    copies = odd.select("doc_id", "text").union(spark.range(3000).select((F.col("id") + 50_000).alias("doc_id"), F.lit("the same text everywhere").alias("text")))
    copies = copies.union(spark.createDataFrame([(7, "one row again")] * 900, "doc_id long, text string"))
    all_rows = [*odd_docs, *[(50_000 + i, "the same text everywhere") for i in range(3000)], *[(7, "one row again")] * 900]
    got = shards.shard_records(copies, ranges=ranges).collect()
    body = [(d, (t or "").encode()) for d, t in all_rows]
    assert sorted([tuple(r)[:3] for r in got], key=repr) == sorted([(d, len(b) + 1, zlib.crc32(b)) for d, b in body], key=repr)
    total, largest = sum(len(b) + 1 for _, b in body), max(len(b) + 1 for _, b in body)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) <= set(range(16))
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 16) <= largest


def test_shard_query(spark, nothing):
    got = entry.queries()["op8_sharding"](spark, SF).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(got) == len(read(SF, "documents", "doc_id")) and set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    assert shards.shard_records(nothing).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards.write_shards(docs, shards.shard_records(docs), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 16


def nearest(vectors, queries, k=10):
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in good:
        if i in queries:
            out[i] = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i)[:k]
    return out


def test_search_is_exact_when_all_is_visited(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(150)]  # ties
    vectors += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] + [1.0] * 7), (2300, [None] + [1.0] * 7), (2400, [float("inf")] * 8), (None, [1.0] * 8), (2500, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, 1.5) for i, v in vectors], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in multi_index.search(frame, frame.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = nearest(vectors[:-1], {0, 100, 200, 300, 1000, 1100})
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert [v for _, _, v in sorted(found)] == [v for _, v in want[q]]
        assert np.allclose([s for _, s, _ in sorted(found)], [s for s, _ in want[q]], atol=1e-12)


def test_search_among_vectors_of_large_norm(spark):
    """Rounding of large squared norms drops no neighbour that was visited."""
    rng = np.random.default_rng(9)
    vectors = [(i, (1e5 + 1e-3 * rng.normal(size=16)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.search(frame, frame.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {q: [v for _, v in w] for q, w in nearest(vectors, {0, 100, 200}).items()}


def test_search_of_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (100, [2.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert multi_index.search(frame, frame.filter("vec_id % 100 = 0")).count() == 4
    assert multi_index.search(frame.limit(0), frame.limit(0)).count() == 0
    assert multi_index.search(frame.filter("vec_id = 0"), frame.filter("vec_id = 0")).count() == 0


def test_recall(spark):
    """Of the ten true neighbours, at least nine tenths are found when cells are
    left out."""
    sf = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = read(sf, "embeddings", "vec_id, embedding")
    queries = {i for i, _ in vectors if i % 100 == 0}
    want = nearest(vectors, queries)
    found = {}
    for r in multi_index.search(frame, frame.filter("vec_id % 100 = 0"), least=1).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {v for _, v in want[q]}) for q in want)
    assert hits / sum(len(w) for w in want.values()) >= 0.9


def test_walk_order():
    left, right = np.array([3.0, 1.0, 2.0]), np.array([0.5, 4.0])
    counts = np.ones((3, 2), int)
    sums = [left[a] + right[b] for a, b in multi_index.walk(left, right, counts, 6)]
    assert sums == sorted(sums) and len(sums) == 6
    counts[1, 0] = 0
    assert multi_index.walk(left, right, counts, 2) == [(2, 0), (0, 0)]


def test_pipeline(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = stage["language"](spark, docs, SF).cache()
    assert known.columns == docs.columns and 0.97 * docs.count() < known.count() <= docs.count()
    texts = [(r["doc_id"], r["text"]) for r in known.collect()]
    single = stage["near duplicates"](spark, known, SF).cache()
    kept = {r[0] for r in brute.near_duplicates(texts) if r[3]}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == kept
    clean = stage["decontamination"](spark, single, SF).cache()
    items = read(SF, "benchmark", "item_id, text")
    dirty = {r[0] for r in brute.contamination([t for t in texts if t[0] in kept], items) if r[-1]}
    assert clean.columns == docs.columns and dirty and {r["doc_id"] for r in clean.collect()} == kept - dirty
    safe = stage["secrets"](spark, clean, SF).cache()
    want = {d: brute.redacted(t) for d, t in texts if d in kept - dirty}
    assert safe.columns == docs.columns and {r["doc_id"]: r["text"] for r in safe.collect()} == want
    assert safe.filter("n_chars <> length(text)").count() == 0
    tool = bpe.ForcedBoundaryCoder(bpe.default_path())
    assert {r["doc_id"]: r["ids"] for r in stage["encoding"](spark, safe, SF).collect()} == {d: tool.encode(t) for d, t in want.items()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_with_odd_rows(spark, odd, nothing):
    sf = "/root/testdata/sf0.001"
    docs = odd.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() <= docs.count()
        if name != "encoding":
            assert out.columns == docs.columns and stage(spark, nothing, sf).count() == 0


def test_near_duplicate_stage_keeps_rows_by_id_and_text(spark):
    """Null ids and ids that repeat with different texts, row by row."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = text["a"].replace("a59", "other")
    docs = [(1, text["a"]), (2, near), (2, text["b"]), (3, text["c"]), (3, text["d"]), (3, text["d"]), (None, text["e"]), (None, text["f"]), (None, text["f"]), (None, near), (None, None), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = [(1, text["a"]), (2, text["b"]), (3, text["c"]), (3, text["d"]), (None, text["e"]), (None, text["f"]), (None, None), (4, None)]
    assert rows(corpus_pipeline.drop_near_duplicates(spark, frame, "")) == sorted(want, key=repr)


def test_stages_with_columns_named_like_helpers(spark):
    """Every stage gives the same rows as without the extra columns, and keeps these."""
    names = ["key_found", "blob_found", "Hash_Found", "spans_found", "words_found", "text_hash", "_text_hash", "kept_hash", "kept_id", "row", "blob", "spans",
             "kind", "start", "node", "bands", "held_out", "strength", "path", "path_hash", "n_words", "items", "component_id", "kept", "ids", "n_shingles"]
    plain = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    plain = plain.unionByName(plain.filter("doc_id % 9 = 0"))
    wide = plain.select("*", *[F.lit("x").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, wide, SF), stage(spark, plain, SF)
        if name != "encoding":
            assert got.columns == wide.columns and {tuple(r) for r in got.select(*names).distinct().collect()} == {("x",) * len(names)}
            got = got.select(*plain.columns)
        assert rows(got) == rows(want)


def test_near_duplicate_stage_chooses_by_the_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (1, text, None), (2, text, "a")], "doc_id long, text string, mark string").repartition(3)
    assert rows(corpus_pipeline.drop_near_duplicates(spark, frame, "")) == [(1, text, "a")]
