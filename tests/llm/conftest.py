import random

import duckdb
import pytest

from . import brute


def read(sf, name, columns):
    return duckdb.connect().execute(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="session")
def plain_docs(sf):
    return read(sf, "documents", "doc_id, text")


@pytest.fixture(scope="session")
def items(sf):
    return read(sf, "benchmark", "item_id, text")


@pytest.fixture(scope="session")
def odd_docs(plain_docs, items):
    """Nulls, empty and long texts, copies, near copies, repeated rows, ties."""
    rng = random.Random(5)
    texts = [t for _, t in plain_docs if t][:40]
    out = [(d, t) for d, t in plain_docs]
    n = 10_000
    for t in [None, "", " \n\t ", "...", "12345", "a", "one two three", "one two three", "ONE two three", "héllo wörld ß 日本 <|endoftext|> x", "<|endoftext|>",
              "\U0001F600 ​﻿ \x00 \x1c\x85\xa0 ՘ ꟎", "  spaces   and\r\n\r\nreturns \t", "don't we'll I'm 'S 's", "x" * 5000, "qzx" * 700, "ab " * 30_000]:
        out.append((n, t))
        n += 1
    for t in texts:  # copies, and copies with a few words changed
        out.append((n, t))
        words = t.split(" ")
        for k in (1, 3):
            changed = list(words)
            for _ in range(k):
                changed[rng.randrange(len(changed))] = "altered"
            out.append((n + k, " ".join(changed)))
        n += 5
    for i, (_, passage) in enumerate(items[:12]):
        words = texts[i].split(" ")
        at = rng.randrange(len(words))
        out.append((n, " ".join(words[:at] + [passage] + words[at:])))
        out.append((n + 1, passage[: len(passage) // 2].upper()))
        n += 2
    for t in ['password = "hunter2x" and token:abc', "password=token:abcdefgh", 'API_KEY="sk-' + "a1" * 20 + '"', "AKIA" + "B" * 16, "AKIAAKIA" + "C" * 12, "AKIA" + "B" * 15,
              "0123456789abcdef01234567", "0123456789abcdef0123456", "äö secret: zzzzzz\nSecret=" + "f" * 30, "token==abcdef passwd:'q'", "ſecret=abcdefgh toKen=abcdefgh"]:
        out.append((n, t))
        n += 1
    out += [out[3], out[3], out[-1], (None, None), (None, texts[0])]
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_docs):
    """The odd rows with columns whose names clash with those of the results."""
    schema = "doc_id long, text string, n_tokens string, node string, text_hash string, start int, kept string, blob string, bands int"
    return spark.createDataFrame([(*r, "x", None, "y", 1, "no", "b", 3) for r in odd_docs], schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
