"""Encoding with a public byte-level BPE vocabulary.

A text is cut into pretokens; each distinct pretoken is merged once and kept. Merging holds its symbols in a doubly
linked list and the mergeable neighbours in a priority queue by merge rank, then position; an entry whose symbols have
changed since is stale and skipped. A pretoken of n bytes so takes O(n log n) steps, however long it is.

Defined results: a null or an empty text gives an empty list; strings that look like special tokens are ordinary text;
lone surrogates, which UTF-8 cannot hold, are encoded as the replacement character.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestrata.session import spread

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed: the pretoken pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pretokens a worker keeps; beyond that it starts anew.
KEPT = 500_000


def bmp_class(property_: str) -> str:
    """The code points below 0x10000 with a property, as ranges for a character class."""
    p, out, start = regex.compile(property_), [], None
    for c in range(0x10001):
        ok = c < 0x10000 and p.match(chr(c)) is not None
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def splitter() -> Callable[[str], list[str]]:
    """PATTERN for any text; texts without astral characters take an equal pattern of explicit classes, twice as fast."""
    letter, number, blank = bmp_class(r"\p{L}"), bmp_class(r"\p{N}"), bmp_class(r"\s")
    narrow = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+").findall
    wide = regex.compile(PATTERN).findall
    return lambda text: narrow(text) if max(text, default="") <= "\uffff" else wide(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary string -> id, which is also the rank of the merge that makes it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    symbol = [piece[i : i + 1] for i in range(n)]  # b"" once merged into its left neighbour
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, length = heapq.heappop(queue)
        j = after[i]
        if not symbol[i] or j >= n or len(symbol[i]) + len(symbol[j]) != length:
            continue  # stale: one of the two was merged since; a longer pair at i has its own entry
        symbol[i] += symbol[j]
        symbol[j] = b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(symbol[i] + symbol[k])) is not None:
                heapq.heappush(queue, (r, i, len(symbol[i]) + len(symbol[k])))
        if (h := before[i]) >= 0 and (r := ranks.get(symbol[h] + symbol[i])) is not None:
            heapq.heappush(queue, (r, h, len(symbol[h]) + len(symbol[i])))
    return [ranks[s] for s in symbol if s]


class _Kept(dict):
    """Pretoken -> its ids as bytes of int32, merged on first use."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self[word] = array("i", merge(word.encode("utf-8", "replace") if word.isascii() else word.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode(), self.ranks)).tobytes()
        return ids


class Encoder:
    """Encodes and decodes with one vocabulary; build one per Python worker."""

    def __init__(self, name: str, folder: str = TOKENIZERS):
        self.ranks = read_ranks(f"{folder}/{name}.tiktoken")
        self.kept, self.split = _Kept(self.ranks), splitter()
        self._strings: dict[int, bytes] = {}

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as int32."""
        return np.frombuffer(b"".join(map(self.kept.__getitem__, self.split(text))) if text else b"", np.int32)

    def count(self, text: str | None) -> int:
        """Number of ids."""
        return sum(map(len, map(self.kept.__getitem__, self.split(text)))) // 4 if text else 0

    def decode(self, ids) -> str:
        """The text of ids: their vocabulary strings in a row."""
        if not self._strings:
            self._strings = {v: k for k, v in self.ranks.items()}
        return b"".join(self._strings[int(i)] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, folder: str = TOKENIZERS) -> Encoder:
    """The worker's encoder of a vocabulary, read once."""
    if (name, folder) not in _ENCODERS:
        _ENCODERS[name, folder] = Encoder(name, folder)
    return _ENCODERS[name, folder]


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids (list of int) of each row; no shuffle but to spread a small input; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder)
        for b in batches:
            rows = [e.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, "ids"])

    slim = spread(df.select(key, text))
    return slim.mapInArrow(run, f"{key} {slim.dtypes[0][1]}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, tokens (number of ids, int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.count(t) for t in b.column(1).to_pylist()], pa.int32())], names=[key, "tokens"])

    slim = spread(df.select(key, text))
    return slim.mapInArrow(run, f"{key} {slim.dtypes[0][1]}, tokens int")
