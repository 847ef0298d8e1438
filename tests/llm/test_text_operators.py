"""Encoding, secrets, contamination and near duplicates against plain versions."""

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stackpulse.llm import bpe, decontaminate, links, near_dup, passages, secret_scan, text as tx

from . import brute
from .conftest import read, rows


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library(odd, odd_docs):
    t = tokenizer()
    want = []
    for doc, text in odd_docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, ids, t.decode(ids, skip_special_tokens=False)))
    got = rows(bpe.encode_documents(odd, decode=True))
    assert got == sorted(want, key=repr)
    coded = bpe.encode_documents(odd)
    back = rows(bpe.decode_documents(coded))
    assert back == sorted([(d, x) for d, _, x in want], key=repr)


def test_encoding_query(spark, sf):
    t = tokenizer()
    want = []
    for doc, text in read(sf, "documents", "doc_id, text"):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
    assert rows(entry.queries()["op1_bpe_round_trip"](spark, sf)) == sorted(want, key=repr)


def test_splitting_of_every_character():
    tool, t = bpe.ForcedBoundaryCoder(bpe.default_path()), tokenizer().pre_tokenizer
    rng = random.Random(1)
    for code in [*range(0x3000), *rng.sample(range(0x3000, 0xD800), 4000), *rng.sample(range(0xE000, 0x110000), 3000)]:
        text = f"a{chr(code)}1{chr(code)}! {chr(code)}{chr(code)} b"
        assert tool.split(text) == [text[a:b] for _, (a, b) in t.pre_tokenize_str(text)], hex(code)


def test_cuts_are_between_pairs_of_no_token():
    tool = bpe.ForcedBoundaryCoder(bpe.default_path())
    raw = b"thequzzxjqhouse"
    cuts = tool.cuts(raw)
    assert len(cuts) and all(raw[c - 1:c + 1] not in b"".join(x) for c in cuts for x in [tool.token_bytes[i:i + 1] for i in range(0, 50256, 7)])
    inside = {raw[i:i + 2] for token in tool.token_bytes for i in range(len(raw) - 1) if raw[i:i + 2] in token}
    assert {int(c) for c in cuts} == {i + 1 for i in range(len(raw) - 1) if raw[i:i + 2] not in inside}


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    tool, t = bpe.ForcedBoundaryCoder(bpe.default_path()), tokenizer()
    for text in ["the cat sat on the mat and the hat", "entirely different words come next, the end"]:
        assert tool.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_secrets(odd, odd_docs, spark):
    findings = secret_scan.scan_versions(odd, secret_scan.fresh_ledger(spark), path="doc_id")
    found = secret_scan.findings_of_paths(odd, findings, path="doc_id")
    got = rows(found.select("doc_id", F.transform("spans", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])).alias("s")))
    got = sorted([(d, [tuple(x) for x in s]) for d, s in got], key=repr)
    assert got == sorted([(d, brute.secrets(t)) for d, t in odd_docs], key=repr)
    assert sum(len(s) for _, s in got) > 8


def test_ledger_scans_only_what_is_new(spark):
    ledger = secret_scan.fresh_ledger(spark)
    first = spark.createDataFrame([("a", "password=hunter22"), ("b", "nothing"), ("c", "password=hunter22")], "path string, text string")
    assert secret_scan.scan_versions(first, ledger).count() == 1
    scanned = spark.read.parquet(f"{ledger}/scanned")
    assert scanned.count() == 2 * len(secret_scan.RULES)
    more = spark.createDataFrame([("d", "password=hunter22"), ("e", "token=abcdefgh")], "path string, text string")
    found = secret_scan.scan_versions(more, ledger)
    assert scanned.count() == 6 and spark.read.parquet(f"{ledger}/scanned").count() == 9
    assert {r["path"]: len(r["spans"]) for r in secret_scan.findings_of_paths(first.union(more), found).collect()} == dict(a=1, b=0, c=1, d=1, e=1)
    # A new version of one rule scans every blob for that rule again.
    newer = (secret_scan.RULES[0]._replace(version=2, least=9), *secret_scan.RULES[1:])
    assert secret_scan.scan_versions(first.union(more), ledger, newer).count() == 0
    assert spark.read.parquet(f"{ledger}/scanned").count() == 12


def test_scan_after_an_interrupted_one(spark):
    """Findings were written, but what had been scanned was not."""
    docs = spark.createDataFrame([("a", "password=hunter22"), ("b", "token=abcdefgh token=abcdefgh"), ("c", None)], "path string, text string")
    whole, broken = secret_scan.fresh_ledger(spark), secret_scan.fresh_ledger(spark)
    want = rows(secret_scan.findings_of_paths(docs, secret_scan.scan_versions(docs, whole)))
    spark.read.parquet(f"{whole}/findings").write.parquet(f"{broken}/findings")
    for _ in range(2):
        assert rows(secret_scan.findings_of_paths(docs, secret_scan.scan_versions(docs, broken))) == want
    assert spark.read.parquet(f"{broken}/findings").count() == 6
    assert secret_scan.scan_versions(docs.limit(0), secret_scan.fresh_ledger(spark)).count() == 0


def test_secret_query(spark, sf):
    want = []
    for doc, text in read(sf, "documents", "doc_id, text"):
        spans = brute.secrets(text)
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        kinds = [k for _, _, k, _ in spans]
        want.append((doc, *(kinds.count(k) for k in ("assign", "access", "hex")), brute.sha(listed), listed))
    assert rows(entry.queries()["op2_secret_scan"](spark, sf)) == sorted(want, key=repr)


def test_redaction(odd, odd_docs):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    out = secret_scan.redact_documents(docs)
    assert out.columns == docs.columns
    assert rows(out.select("doc_id", "text", "n_chars")) == sorted([(d, brute.redacted(t), None if t is None else len(brute.redacted(t))) for d, t in odd_docs], key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 6000])
def test_contamination(spark, odd, odd_docs, items, block_bytes):
    words = " ".join(f"w{i}" for i in range(40))
    more = [*items, (900, "one two three"), (901, "a"), (None, words), (902, words), (902, "w3 w4"), (903, ""), (904, None), (905, "...")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in more], "item_id long, text string, n_words int")
    docs = [*odd_docs, (77_001, "x " + words + " y"), (77_002, "w8 " * 20 + words[:60])]
    frame = odd.select("doc_id", "text", "n_tokens").union(spark.createDataFrame([(d, t, "") for d, t in docs[len(odd_docs):]], "doc_id long, text string, n_tokens string"))
    found = decontaminate.find_contamination(frame, bench, block_bytes=block_bytes)
    got = rows(found.select("doc_id", "n_words", decontaminate.n_hit(), F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.size("spans") > 0))
    assert got == sorted(brute.contamination(docs, more), key=repr)
    # Spans in code points hold the hit words.
    texts = dict(docs)
    for r in found.filter(F.size("spans") > 0).collect():
        for s in r["spans"]:
            if r["doc_id"] in texts and r["doc_id"] is not None:
                assert brute.bench_words(texts[r["doc_id"]][s["start"]:s["end"]]) == brute.bench_words(texts[r["doc_id"]])[s["first"]:s["last"]]


def test_contamination_query(spark, sf):
    want = brute.contamination(read(sf, "documents", "doc_id, text"), read(sf, "benchmark", "item_id, text"))
    got = rows(entry.queries()["op3_decontamination"](spark, sf))
    assert got == sorted(want, key=repr) and any(r[-1] for r in got)


def test_removal_of_spans(spark, items):
    passage = items[0][1]
    docs = spark.createDataFrame([(1, f"Keep this. {passage} And this, with a good many words that no test has ever seen before, not once, "
                                      "since they were made up for the occasion and then again for another one and so on and so forth."), (2, passage), (3, "clean text"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench)
    out = dict(rows(decontaminate.remove_spans(docs, found)))
    assert set(out) == {1, 3, 4} and out[3] == "clean text" and out[4] is None
    assert out[1].startswith("Keep this. ") and "And this" in out[1] and passage not in out[1]
    assert {r[0] for r in rows(decontaminate.remove_spans(docs, found, coverage=0.0))} == {3, 4}


def test_near_duplicates(odd, odd_docs):
    got = rows(near_dup.near_duplicates(odd))
    assert got == sorted(brute.near_duplicates(odd_docs), key=repr)
    assert sum(not r[3] for r in got) > 40


def test_near_duplicate_query(spark, sf):
    want = brute.near_duplicates(read(sf, "documents", "doc_id, text"))
    assert rows(entry.queries()["op7_near_duplicates"](spark, sf)) == sorted(want, key=repr)


def test_circulant_signature():
    """Coordinates are minima under one shifted permutation, and agree about as
    often as the sets are alike."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64) << np.uint64(1)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    shifts = np.arange(1, 2001, dtype=np.uint32)[:, None]
    agree = (near_dup.signature(a, shifts) == near_dup.signature(b, shifts)).mean()
    assert abs(agree - 0.8) < 0.05
    low = near_dup.scatter((a >> np.uint64(32)).astype(np.uint32))
    assert near_dup.signature(a)[6] == near_dup.order(low + np.uint32(7)).min()


def test_links_lose_nothing(spark):
    """A bucket whose hub is linked to no one, and chains through buckets."""
    good = {(2, 3), (3, 4), (5, 6), (4, 9)}
    members = [(1, n, 1) for n in range(1, 7)] + [(2, 4, 1), (2, 9, 1)]
    frame = spark.createDataFrame(members, "bucket long, node long, weight long")
    ok = spark.createDataFrame(sorted(good), "a long, b long")
    got = dict(rows(links.link(frame, lambda pairs: pairs.join(F.broadcast(ok), ["a", "b"], "left_semi"), links.size_ratio(85, 100))))
    assert {got.get(n, n) for n in (2, 3, 4, 9)} == {2} and got.get(5, 5) == got.get(6, 6) == 5 and got.get(1, 1) == 1


def test_links_of_a_large_bucket(spark):
    """Random cells and the last round reach what the hub does not, and pairs of
    unequal sizes are spared."""
    rng = random.Random(8)
    n = 300
    good = {(a, b) for a in range(1, n) for b in range(a + 1, n) if rng.random() < 0.02 and a != 5 and b != 5}
    frame = spark.createDataFrame([(7, i, 100 if i != 9 else 50) for i in range(n)], "bucket long, node long, weight long")
    ok = spark.createDataFrame(sorted(good), "a long, b long")
    got = dict(rows(links.link(frame, lambda pairs: pairs.join(F.broadcast(ok), ["a", "b"], "left_semi"), links.size_ratio(85, 100))))
    want = brute.least_reachable(n, [e for e in good if 9 not in e])
    assert [got.get(i, i) for i in range(n)] == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i + 1000, i + 1001) for i in range(200)]
    got = dict(rows(links.components(spark.createDataFrame(edges, "a long, b long"))))
    want = brute.least_reachable(1300, edges)
    assert all(got.get(i, i) == want[i] for i in range(1300))


def passage_docs(plain_docs, n_copies=3):
    rng = random.Random(11)
    texts = [t for _, t in plain_docs if t and len(t.split()) > 120]
    docs, planted = [(i, t) for i, t in enumerate(texts[:60])], []
    for k in range(12):
        passage = " ".join(f"p{k}x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(51, 90)))
        hosts = rng.sample(range(60, 60 + 40), n_copies)
        planted.append((passage, hosts))
    for host in range(60, 100):
        words = texts[host % len(texts)].split(" ")[::-1]
        for passage, hosts in planted:
            if host in hosts:
                at = rng.randrange(len(words))
                words[at:at] = [passage]
        docs.append((host, " ".join(words)))
    return docs, planted


def test_repeated_passages(spark, plain_docs):
    docs, planted = passage_docs(plain_docs)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(900, None, 1), (901, "", 1), (None, docs[0][1], 1), (docs[0][0], docs[0][1], 1)], "doc_id long, text string, node int")
    got = passages.repeated_passages(frame)
    texts, by_doc = dict(docs), {}
    for r in got.collect():
        by_doc.setdefault(r["doc_id"], []).append((r["para_start"], r["para_end"], r["kept_doc_id"], r["kept"]))
    for passage, hosts in planted:
        for host in hosts:
            at = texts[host].index(passage)
            inside = [x for x in by_doc[host] if at <= x[0] and x[1] <= at + len(passage)]
            assert inside and all(x[2] == min(hosts) for x in inside)
            assert all(x[3] == (host == min(hosts)) for x in inside)
    # Every reported paragraph has a like in another document.
    sets = {d: brute.shingle_set(t) for d, t in docs}
    for d, spans in by_doc.items():
        for s, e, _, _ in spans:
            own = brute.shingle_set(texts[d][s:e])
            assert any(len(own & other) * 2 >= len(own) for x, other in sets.items() if x != d)
    spans = passages.removal_spans(got)
    assert spans.count() and spans.filter("start >= end").count() == 0


def test_spans_cover_whole_passages(spark, plain_docs):
    """From the first word of a planted passage to its last, in every host."""
    docs, planted = passage_docs(plain_docs)
    texts, covered = dict(docs), {}
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    for r in got.collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["para_start"], r["para_end"]))
    for passage, hosts in planted:
        for host in hosts:
            at = texts[host].index(passage)
            assert set(range(at, at + len(passage))) - covered[host] <= {at + i for i, c in enumerate(passage) if c == " "}
    for own, other, left, right in ((b"a B c ", b"x b  C\n", (b"B c ", b"b  C\n"), (b"", b"")), (b" a b", b"\tA  b c", (b"", b""), (b" a b", b"\tA  b")), (b"", b"a", (b"", b""), (b"", b""))):
        assert passages._before(own, other) == left and passages._after(own, other) == right


def test_exact_copies_of_short_texts(spark):
    """A copy of any length from five words on is reported, from end to end."""
    sizes = [*range(5, 50), 80, 200]
    texts = {n: " ".join(f"s{n}x{i}" for i in range(n)) for n in sizes}
    frame = spark.createDataFrame([(1000 * k + n, t) for n, t in texts.items() for k in (1, 2)], "doc_id long, text string")
    ends = {}
    for r in passages.repeated_passages(frame).collect():
        low, high = ends.get(r["doc_id"], (10 ** 9, 0))
        ends[r["doc_id"]] = min(low, r["para_start"]), max(high, r["para_end"])
        assert r["kept_doc_id"] == 1000 + r["doc_id"] % 1000 and r["kept"] == (r["doc_id"] < 2000)
    assert ends == {1000 * k + n: (0, len(t)) for n, t in texts.items() for k in (1, 2)}


def test_near_copies_of_paragraphs(spark):
    """Near copies whose first, middle or last word is another, as whole texts
    and as lines or blank-line blocks inside unlike texts."""
    def words(tag, n):
        return [f"{tag}w{i}" for i in range(n)]

    docs, pairs = [], []
    for n, changes in ((19, [[0], [18]]), (20, [[0], [19]]), (100, [[0], [50], [99], [30, 70]])):
        for change in changes:
            for shape in ("{}", "{1}\n{0}\n{2}", "{1}\n\n{0}\n\n{2}"):
                own = words(f"n{n}c{'x'.join(map(str, change))}s{len(shape)}", n)
                other = ["changed" if i in change else w for i, w in enumerate(own)]
                k = len(docs)
                for i, body in enumerate((own, other)):
                    if "\n\n" in shape:  # broken as notices are, at other words in the copy
                        body = [w + "\n" * (j % (9 + i) == 8 and j < n - 1) for j, w in enumerate(body)]
                    body = " ".join(body)
                    docs.append((k + i, shape.format(body, " ".join(words(f"before{k + i}", 30)), " ".join(words(f"after{k + i}", 30)))))
                    at = docs[-1][1].index(body)
                    pairs.append((k + i, k, at, at + len(body)))
    got = {tuple(r) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "kept_doc_id", "para_start", "para_end").collect()}
    assert not [p for p in pairs if not any(p[:2] == g[:2] and g[2] <= p[2] and p[3] <= g[3] for g in got)]


def test_only_some_paragraphs_are_banded(spark, monkeypatch):
    """Paragraphs cut by content that share 19 words are links without bands or
    a look at their sets; those near a line of their size, and those of few
    different shingles, still get them. Tables that were read are gone."""
    def words(tag, n):
        return [f"{tag}w{i}" for i in range(n)]

    shared, line, dull = words("shared", 60), words("line", 22), ["ha", "ho"] * 30
    docs = [(i, " ".join(words(f"head{i}", 30) + shared + words(f"tail{i}", 30))) for i in (1, 2)]
    docs += [(i, " ".join(words(f"front{i}", 40)) + "\n" * (i < 5) + " " * (i > 4) + " ".join(line) + "\n" * (i < 5) + " " * (i > 4) + " ".join(words(f"back{i}", 40))) for i in (3, 4, 5, 6)]
    docs += [(i, " ".join(words(f"left{i}", 30) + dull + words(f"right{i}", 30))) for i in (7, 8)]
    banded, inner = [], passages.link
    monkeypatch.setattr(passages, "link", lambda members, *more: banded.extend(r[0] for r in members.select("node").distinct().collect()) or inner(members, *more))
    gone, drop = [], passages.drop
    monkeypatch.setattr(passages, "drop", lambda s, paths: gone.extend(paths) or drop(s, paths))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts, kept = dict(docs), {}
    for r in got:
        kept.setdefault(r["doc_id"], set()).add(r["kept_doc_id"])
    assert all(kept[i] == {1} for i in (1, 2)) and kept[7] == kept[8] == {7}
    for i in (1, 2):
        at = texts[i].index(" ".join(shared))
        assert (at, at + len(" ".join(shared))) in {(min(r["para_start"] for r in got if r["doc_id"] == i), max(r["para_end"] for r in got if r["doc_id"] == i))}
    assert 3 in kept[4] and len(banded) < len({r["component_id"] for r in got}) + 40
    assert len(gone) > 3 and not any(pathlib.Path(p.removeprefix("file:")).exists() for p in gone)


def test_cut_paragraphs_by_windows():
    """The same paragraphs as one window after the other would give."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 3, 5, 19, 20, 21, 34, 35, 36, 60, 200)]
    raw = [t.encode() for t in texts]
    found = tx.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), tx.SPACE)
    parts = tx.shingles(found.hashes, passages.SHINGLE)
    begin, size = passages.anchors(parts, found.first, np.repeat(np.arange(len(texts)), np.diff(found.first)))
    want = set()
    for a, b in zip(found.first.tolist(), found.first.tolist()[1:]):
        n, own = b - a, parts[a:b - passages.SHINGLE + 1]
        if passages.SHINGLE <= n < passages.WORDS:
            want.add((a, n))
        elif n >= passages.WORDS:
            ends = range(max(1, len(own) - passages.REACH + 1))
            at = {i + int(own[i:i + passages.REACH].argmin()) for i in ends}
            want |= {(a + i, passages.WORDS) for i in {0, n - passages.WORDS, *at} if i <= n - passages.WORDS}
    assert set(zip(begin.tolist(), size.tolist())) == want


def test_bands_reach_the_recall():
    for limit in (0.6, 0.8, 0.9):
        bands, per_band = passages.tune_bands(limit)
        assert 1 - (1 - limit ** per_band) ** bands >= passages.RECALL


def test_empty_tables(spark, nothing):
    bench = nothing.select(F.col("doc_id").alias("item_id"), "text")
    assert bpe.encode_documents(nothing).count() == 0
    found = secret_scan.scan_versions(nothing, secret_scan.fresh_ledger(spark), path="doc_id")
    assert found.count() == 0 and secret_scan.redact_documents(nothing).count() == 0
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert near_dup.near_duplicates(nothing).count() == 0
    assert passages.repeated_passages(nothing).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert rows(decontaminate.find_contamination(one, bench).select("n_words", F.size("spans"))) == [(2, 0)]


def test_words_of_a_buffer():
    texts = ["", "a b", "c", "", "é ü  x", "\x0b\x0c", "tail"]
    raw = [t.encode() for t in texts]
    found = tx.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), tx.SPACE)
    assert np.diff(found.first).tolist() == [0, 2, 1, 0, 3, 0, 1]
    assert len(set(found.hashes.tolist())) == 7
