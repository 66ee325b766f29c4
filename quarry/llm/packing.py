"""Harmonic packing of tokenised documents into fixed-length training sequences.

Each worker packs its own partition; nothing is shuffled. A document is its token ids followed by
id 0. It is cut into full sequences and a rest; the rest is cut at capacity/2, /4 and /8, so that
those pieces fill their classes exactly. A piece of length l belongs to class j = capacity // l, and
a bin of class j closes when it holds j pieces. Pieces in bins still open at the end of a partition
are packed together, longest first, first fit.

Null texts are empty (one piece, the id 0). Empty tables give no rows, repeated rows are packed as
often as they occur, extra columns are ignored. A text of any length is processed whole; memory
holds its ids and the open bins, which have at most a few thousand pieces.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean

#: Chunks that no token crosses: a run of non-space with the space before it, or a run of white space.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python's \s has and Unicode's White_Space has not.
_ODD = re.compile("[\x1c-\x1f]")
_CACHED_CHUNKS, _CACHED_LENGTH = 100_000, 48
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, Encoder] = {}


class _Cache(dict):
    """Chunk to the bytes of its ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(chunk)).tobytes()
        if len(self) < _CACHED_CHUNKS and len(chunk) <= _CACHED_LENGTH:
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of a text as little-endian 32-bit words, equal to those of the tokenizer file.

    For a byte-level BPE whose merges are in id order, chunks are encoded by the same ranks and
    kept; any other tokenizer, and texts that hold special-token strings, go through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        ranks = self._ranks(spec)
        self.cache = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            self.cache = _Cache(tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)

    @functools.cached_property
    def tokenizer(self):
        """The tokenizer itself, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        """Bytes of each token by rank, if ids follow the order of merges."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or not before.get("use_regex", True):
            return None
        if model.get("byte_fallback") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary, added = model["vocab"], set(self.special)
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if vocabulary.get(a + b) != 256 + k:
                return None
        return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in added}

    def __call__(self, text: str) -> bytes:
        if self.cache is None or _ODD.search(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.cache.__getitem__, _CHUNK.findall(text)))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out, rest = [capacity] * (tokens // capacity), tokens % capacity
    for part in (capacity // 2, capacity // 4, capacity // 8):
        if part and rest >= part:
            out.append(part)
            rest -= part
    while rest >= capacity:  # capacities under 8
        out.append(capacity)
        rest -= capacity
    return out + [rest] if rest else out


class Bins:
    """Open bins by class; a piece is a row whose last two fields are set when its bin closes."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[list]] = defaultdict(list)
        self.done: list[list] = []

    def _close(self, pieces: list[list]) -> None:
        offset = 0
        for piece in pieces:
            piece[5:] = (self.next_id, offset)
            offset += piece[2]
        self.next_id += 1
        self.done += pieces

    def add(self, piece: list) -> None:
        count = self.capacity // piece[2]
        pieces = self.open[count]
        pieces.append(piece)
        if len(pieces) == count:
            self._close(pieces)
            self.open[count] = []

    def finish(self) -> None:
        bins: list[list] = []  # room left, pieces
        for piece in sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2]):
            for b in bins:
                if b[0] >= piece[2]:
                    b[0] -= piece[2]
                    b[1].append(piece)
                    break
            else:
                bins.append([self.capacity - piece[2], [piece]])
        for _, pieces in bins:
            self._close(pieces)
        self.open.clear()

    def take(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), _SCHEMA)] if done else [pa.array([], type=f.type) for f in _SCHEMA], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `capacity` ids.

    tokenizer: path of a tokenizer file, as executors see it.
    """

    def run(batches):
        encode = encoder(tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + b"\0\0\0\0")
                tokens, start, doc_id = len(ids) // 4, 0, doc_id.as_py()
                for length in cuts(tokens, capacity):
                    bins.add([doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens, 0, 0])
                    start += length
                if len(bins.done) > 20_000:
                    yield bins.take()
            yield bins.take()
        bins.finish()
        yield bins.take()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), DDL)
