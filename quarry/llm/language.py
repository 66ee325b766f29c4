"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts up to `order` bytes counts what followed. A byte that
followed the longest known context costs -log2(count / (total + distinct)); any other byte pays the
escape distinct / (total + distinct) and is coded in the next shorter context, down to 256 equally likely
bytes. The statistics are frozen after training and no symbols are excluded after an escape, so the
code length of each (context, byte) is a constant and a text's exact length is a sum of them.
The language with the shortest code wins; the score is its share of 2^-length.

Bytes are those of the text with A-Z lowered; before its first byte stand spaces. Only contexts that occur are stored, in sorted
arrays, so neither the order nor the bytes depend on the number of languages. Texts of any length teach: those of least
hash, at most `per_language` of each language and together `sample_mb`, of which each language has an equal share.
Null texts and texts without a letter are `und` with score 0. Ties go to the first language in byte order.
With nothing to learn from, every text is `und`. Empty tables give no rows, repeated rows are each predicted (and
teach once), extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, near_least
from .words import groups, text_buffers

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
DDL = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
_seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Ppm:
    """Context trees of all languages. A gram is a context and the byte after it, as one number."""

    def __init__(self, langs: list[str], texts: dict[str, list[bytes]], order: int = 4):
        self.langs, self.order, self.key = langs, order, uuid.uuid4().hex
        self.trees = []  # by language and context length: contexts, bits of their escapes, grams, their bits
        for lang in langs:
            data = b"".join(texts[lang])
            grams, n = np.unique(self.grams(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts[lang])])), return_counts=True)
            tree = []
            for k in range(order + 1):
                short, at = np.unique(grams & self._mask(k + 1), return_inverse=True)
                count = np.bincount(at, weights=n, minlength=len(short))
                contexts, owner = np.unique(short >> np.uint64(8), return_inverse=True)
                total, distinct = np.bincount(owner, weights=count, minlength=len(contexts)), np.bincount(owner, minlength=len(contexts))
                whole = np.log2(total + distinct)
                tree.append((contexts, (whole - np.log2(distinct)).astype(np.float32), short, (whole[owner] - np.log2(count)).astype(np.float32)))
            self.trees.append(tree)

    @staticmethod
    def _mask(n: int) -> np.uint64:
        return np.uint64((1 << 8 * n) - 1)

    def grams(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The gram that ends in each byte of some texts."""
        offsets = offsets - offsets[0]
        size = np.diff(offsets)
        at = np.arange(len(data)) + self.order * (1 + np.repeat(np.arange(len(size)), size))
        padded = np.full(len(data) + self.order * (len(size) + 1), 32, dtype=np.uint64)
        padded[at] = _LOWER[data]
        out = padded[at]
        for k in range(1, self.order + 1):
            out |= padded[at - k] << np.uint64(8 * k)
        return out

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte, by language."""
        out = np.zeros((len(grams), len(self.langs)), dtype=np.float32)
        for j, tree in enumerate(self.trees):
            left = np.arange(len(grams))
            for k in range(self.order, -1, -1):
                contexts, escapes, known, costs = tree[k]
                short = grams[left] & self._mask(k + 1)
                hit, context = _find(known, short), _find(contexts, short >> np.uint64(8))
                out[left, j] += np.where(hit >= 0, costs[hit], np.where(context >= 0, escapes[context], 0)) if len(known) else 0
                left = left[hit < 0]
            out[left, j] += 8
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray, most: int = 2_000_000) -> np.ndarray:
        """Code length in bits of each text, by language. A worker remembers the grams it met, up to about `most`."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        some = np.diff(offsets) > 0
        if not some.any():
            return out
        code, grams = pd.factorize(self.grams(data, offsets))
        if self.key not in _seen or len(_seen[self.key][0]) > most:
            _seen.clear()
            _seen[self.key] = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32)
        known, rows = _seen[self.key]
        at = _find(known, grams)
        if (new := np.flatnonzero(at < 0)).size:
            known, rows = np.concatenate([known, grams[new]]), np.concatenate([rows, self.bits(grams[new])])
            order = np.argsort(known)
            known, rows = known[order], rows[order]
            _seen[self.key] = known, rows
            at = _find(known, grams)
        first = (offsets - offsets[0])[:-1][some]
        out[some] = np.add.reduceat(rows[at][code], first, axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, learn: Column, per_language: int = 400, sample_mb: int = 16, order: int = 4) -> Ppm:
    """Learn from rows of `docs` (doc_id, lang, text) where `learn` holds."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).withColumn("own", F.xxhash64("doc_id", "text"))
    near = near_least(labelled.select("lang", "own", F.octet_length("text").alias("n")), "own", "lang", per_language).distinct().toArrow()  # little more than per_language rows of each language
    most = dict.fromkeys(sorted(set(near.column("lang").to_pylist())), per_language)
    chosen = least_hashed(near, "lang", most, sample_mb << 20).select(["lang", "own"])
    texts: dict[str, list[bytes]] = {}
    if len(chosen):  # broadcast: those rows
        rows = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(chosen)), ["lang", "own"]).select("lang", "own", "text").distinct().collect()
        for r in sorted(rows):
            texts.setdefault(r.lang, []).append(r.text.encode())
    return Ppm(sorted(texts, key=str.encode), texts, order)


def predict(docs: DataFrame, model: Ppm, held_out: Column) -> DataFrame:
    """docs: doc_id, text. The prediction reads the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ppm = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            langs, scores, rates = [], [], []
            for lo, hi in groups(offsets):
                bits = ppm.lengths(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1]) if ppm.langs else np.zeros((hi - lo, 0))
                for k, row in zip(range(lo, hi), bits):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    if not len(row) or not (_ASCII_LETTER.search(raw) or any(map(str.isalpha, raw.decode(errors="replace")))):
                        langs.append("und"), scores.append(0.0), rates.append(None)
                        continue
                    best = int(row.argmin())
                    langs.append(ppm.langs[best])
                    scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
                    rates.append(float(row[best] / len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(run, DDL)
