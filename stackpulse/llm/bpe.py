"""Byte-pair encoding and decoding with forced boundaries.

A merge only ever joins bytes that stand next to each other inside some token
of the vocabulary. A pair of neighbouring bytes that no token contains is
therefore a certain cut: the pieces on both sides can be encoded on their own
and their ids joined. The text is first cut into words as the vocabulary's
splitting pattern demands, every word is cut at its forced boundaries, and the
short fragments that result are encoded once and remembered.

Nulls count as empty texts; an empty text has no ids and decodes to an empty
text. Texts are never cut short. Repeated rows stay repeated.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .text import text_batch

REMEMBERED = 500_000
_GROUP_CHARS = 1 << 19

# The splitting pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""
# Outside these blocks the pattern engines may follow different editions of Unicode.
SETTLED = r"\x00-\u036f\u0391-\u0527\u2000-\u2064\u20a0-\u20ac\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ForcedBoundaryCoder:
    """Encodes and decodes one text at a time; fragments are remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models

        spec = json.loads(open(path, encoding="utf-8").read())
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        self.beside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(value[s] for s in token)
            self.token_bytes[i] = raw
            codes = np.frombuffer(raw, np.uint8)
            self.beside[codes[:-1], codes[1:]] = True
        for content, i in special.items():
            self.token_bytes[i] = content.encode()
        self.fragment_coder = Tokenizer(models.BPE(vocab=vocab, merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]))
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(symbols)})
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.words = regex.compile(PATTERN).findall
        self.ascii_words = re.compile(ASCII_PATTERN).findall
        self.unsettled = re.compile(f"[^{SETTLED}]").search
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text)
        if self.unsettled(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.words(text)

    def cuts(self, raw: bytes) -> np.ndarray:
        """Positions between neighbouring bytes that no token holds together."""
        codes = np.frombuffer(raw, np.uint8)
        return np.flatnonzero(~self.beside[codes[:-1], codes[1:]]) + 1

    def learn(self, fresh: list[str]) -> None:
        """Remember the ids of words, all cut at their forced boundaries at once."""
        raw = [word.encode() for word in fresh]
        blob = b"".join(raw)
        ends = np.cumsum([0, *map(len, raw)])
        edges = np.union1d(self.cuts(blob), ends)
        first = np.searchsorted(edges, ends).tolist()
        edges = edges.tolist()
        shown = blob.decode("latin-1").translate(self.symbols)
        pieces = [shown[a:b] for a, b in zip(edges, edges[1:])]
        unique = list(dict.fromkeys(pieces))
        ids = dict(zip(unique, [array("i", c.ids).tobytes() for c in self.fragment_coder.encode_batch_fast(unique, add_special_tokens=False)]))
        for word, a, b in zip(fresh, first, first[1:]):
            self.known[word] = ids[pieces[a]] if b == a + 1 else b"".join(map(ids.__getitem__, pieces[a:b]))

    def encode_words(self, listed: list[list[str]]) -> list[bytes]:
        distinct = set().union(*listed)
        fresh = distinct.difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh = distinct
            self.learn(list(fresh))
        return [b"".join(map(self.known.__getitem__, words)) for words in listed]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Special tokens in a text are themselves."""
        parts: list[str] = []
        owners: list[tuple[int, int | None]] = []  # (text, special id or None for ordinary text)
        for i, text in enumerate(texts):
            split = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
            for part in split:
                owners.append((i, self.special.get(part)))
                if owners[-1][1] is None:
                    parts.append(part)
        coded = iter(self.encode_words([self.split(p) for p in parts]))
        out: list[list[bytes]] = [[] for _ in texts]
        for i, special in owners:
            out[i].append(next(coded) if special is None else array("i", [special]).tobytes())
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.asarray(ids, np.int32).tolist())).decode("utf-8", "replace")


@functools.cache
def coder(path: str) -> ForcedBoundaryCoder:
    """One per Python worker."""
    return ForcedBoundaryCoder(path)


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``_GROUP_CHARS`` together."""
    at = 0
    while at < len(lengths):
        stop = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), _GROUP_CHARS, "right")))
        yield at, min(stop, len(lengths))
        at = stop


def _encoded(path: str, decode: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(np.array([len(t) for t in texts])):
                ids = tool.encode_all(texts[a:b])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if decode:
                    out.append(pa.array([tool.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)
    return run


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(key, ids, decoded): token ids of every text and, with ``decode``, the
    text decoded from them again. Other columns are left out."""
    text_batch(docs.sparkSession)
    source = docs.select(F.col(key), F.col(text).cast("string"))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decode:
        fields.append(T.StructField("decoded", T.StringType()))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    return source.mapInArrow(_encoded(path or default_path(), decode, to_arrow_schema(schema)), schema)


def decode_documents(coded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): texts of id lists; a null list is an empty text."""
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(where)
        for batch in batches:
            texts = [tool.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    schema = T.StructType([T.StructField(key, coded.schema[key].dataType), T.StructField("decoded", T.StringType())])
    return coded.select(key, F.col(ids).cast("array<int>")).mapInArrow(run, schema)
