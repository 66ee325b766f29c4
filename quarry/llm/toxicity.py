"""Toxic spans and documents by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: a word or word beginning is a toxic key if
its documents, or those in which two different words have it, are toxic far more often than chance allows, and a token
with a key in a toxic document is toxic. The field has two tags; a token's emission is a sum of hashed weights of its word
and of its first 4, 5 and 6 bytes. It is trained by gradient ascent on a bounded number of segments around tokens with keys,
in toxic and in clean documents, and at random places of clean documents. Forward-backward runs exactly over whole texts:
blocks of tokens are multiplied out side by side, then chained. A document's evidence is the sum of -log(1 - marginal) over
its marginals from 0.1 up (a long clean text has many tiny ones); its score is the isotonic fit of the labels on the evidence, which two
fields trained on one half of the sample each give for the other. Tokens with marginals from 0.5 up are its offending
spans, as character offsets.

Tokens are runs of letters (A-Z lowered, and all characters beyond ASCII). Null texts and texts
without tokens have no evidence; their score is that of other texts without. Rows with another label than 0 or 1 teach nothing;
of several labels of a document the largest counts. Without toxic examples every score is 0. Empty tables give no rows,
repeated rows are each scored (and teach once), extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, least_hashed, near_least
from .quality_classifier import pool_adjacent_violators
from .words import groups, mix, run_hashes, spans, text_buffers

_GAP = np.ones(256, dtype=bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_PREFIXES = (4, 5, 6)
_BITS = 18
_BLOCK = 64
DDL = "doc_id long, held_out boolean, score double, spans array<struct<start:int,end:int>>"


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, first token of each text, and a row of feature hashes for each token."""
    starts, ends, first = spans(data, offsets, _GAP)
    hashes = run_hashes(data, starts, [ends, *[np.minimum(ends, starts + k) for k in _PREFIXES]])
    keys = np.stack([mix(h ^ np.uint64(j)) for j, h in enumerate(hashes)], axis=1) if len(starts) else np.zeros((0, 1 + len(_PREFIXES)), np.uint64)
    return starts, ends, first, keys


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    steps: np.ndarray  # log weight of a tag after another
    edges: np.ndarray = field(default_factory=lambda: np.zeros(1))  # evidence, and the score there
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return np.interp(evidence, self.edges, self.levels)

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        """Log weight of the toxic tag for each row of feature slots; the clean tag has 0."""
        return np.clip(self.weights[slots].sum(1) + self.bias, -30, 30)

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of the toxic tag of each token; a text is a chain that begins after a clean tag."""
        sizes = np.diff(first)
        per = -(-sizes // _BLOCK)
        n = int(per.sum())
        if not n:
            return np.zeros(len(e))
        doc = np.repeat(np.arange(len(sizes)), per)
        rank = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
        at = (first[:-1][doc] + rank * _BLOCK)[:, None] + np.arange(_BLOCK)
        real = at < first[1:][doc][:, None]
        x = np.exp(e[np.where(real, at, 0)])
        (a00, a01), (a10, a11) = np.exp(self.steps)

        def step(p0, p1, t):
            q0, q1 = p0 * a00 + p1 * a10, (p0 * a01 + p1 * a11) * x[:, t]
            return np.where(real[:, t], q0, p0), np.where(real[:, t], q1, p1)

        one, zero = np.ones(n), np.zeros(n)
        rows = [one, zero, zero, one]  # product of a block's matrices
        for t in range(_BLOCK):
            rows = [*step(rows[0], rows[1], t), *step(rows[2], rows[3], t)]
            total = sum(rows)
            rows = [r / total for r in rows]
        alpha, beta = np.stack([one, zero], 1), np.stack([one, one], 1)
        start = np.cumsum(per) - per
        for k in range(1, int(per.max())):  # into block k of each text
            b = start[per > k] + k
            p = b - 1
            alpha[b, 0], alpha[b, 1] = alpha[p, 0] * rows[0][p] + alpha[p, 1] * rows[2][p], alpha[p, 0] * rows[1][p] + alpha[p, 1] * rows[3][p]
            alpha[b] /= alpha[b].sum(1, keepdims=True)
        for k in range(int(per.max()) - 2, -1, -1):
            b = start[per > k + 1] + k
            f = b + 1
            beta[b, 0], beta[b, 1] = rows[0][f] * beta[f, 0] + rows[1][f] * beta[f, 1], rows[2][f] * beta[f, 0] + rows[3][f] * beta[f, 1]
            beta[b] /= beta[b].sum(1, keepdims=True)
        forward = np.empty((2, _BLOCK, n))
        p0, p1 = alpha[:, 0], alpha[:, 1]
        for t in range(_BLOCK):
            p0, p1 = step(p0, p1, t)
            total = p0 + p1
            p0, p1 = p0 / total, p1 / total
            forward[0, t], forward[1, t] = p0, p1
        out = np.empty((n, _BLOCK))
        b0, b1 = beta[:, 0], beta[:, 1]
        for t in range(_BLOCK - 1, -1, -1):
            toxic = forward[1, t] * b1
            out[:, t] = toxic / (forward[0, t] * b0 + toxic)
            c0, c1 = a00 * b0 + a01 * x[:, t] * b1, a10 * b0 + a11 * x[:, t] * b1
            total = c0 + c1
            b0, b1 = np.where(real[:, t], c0 / total, b0), np.where(real[:, t], c1 / total, b1)
        marginals = np.empty(len(e))
        marginals[at[real]] = out[real]
        return marginals


def _single(keys: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Documents with tokens, of those with the same least hash of four neighbouring tokens only one, so that copies don't add up."""
    runs = keys[:, 0].copy()
    for k in range(1, 4):
        runs[:-k] = mix(runs[:-k] + keys[k:, 0])
    size = np.diff(first)
    inside = np.ones(len(runs), dtype=bool)
    for k in range(1, 4):
        inside[first[1:][size > k] - k] = False
    held = np.flatnonzero(size > 0)
    least = np.minimum.reduceat(np.where(inside, runs, np.uint64(2**64 - 1)), first[held])
    least = np.where(size[held] > 3, least, keys[first[held], 0])
    _, chosen = np.unique(np.stack([least, y[held].astype(np.uint64)], 1), axis=0, return_index=True)
    return held[np.sort(chosen)]


def _keys_of_toxicity(keys: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Feature hashes whose documents are toxic more often than chance allows, given how many features there are.

    A feature is tested by the documents that have it, and by those in which two different words have it.
    """
    chosen = _single(keys, first, y)
    toxic, clean = max(1, int(y[chosen].sum())), max(1, int((1 - y[chosen]).sum()))
    p, out = toxic / (toxic + clean), []
    seen: list[list[np.ndarray]] = [[], []]  # features of each document, in one word and in two
    for d in chosen:
        words = keys[first[d] : first[d + 1]]
        words = words[np.unique(words[:, 0], return_index=True)[1]]
        found, n = np.unique(words, return_counts=True)
        seen[0].append(found)
        seen[1].append(found[n > 1])
    for k, often in enumerate(seen):
        feature, at = np.unique(np.concatenate(often), return_inverse=True)
        n1 = np.bincount(at, weights=np.repeat(y[chosen], [len(x) for x in often]), minlength=len(feature))
        n = np.bincount(at, minlength=len(feature))
        n0 = n - n1
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = np.where(n1 > 0, n1 * np.log(n1 / np.maximum(n, 1) / p), 0) + np.where(n0 > 0, n0 * np.log(n0 / np.maximum(n, 1) / (1 - p)), 0)
        rate = n1 / toxic >= 20 * (n0 + 0.05) / clean
        tested = np.cumsum(np.bincount(n, minlength=1)[::-1])[::-1]  # features of at least so many documents
        out.append(feature[rate & (evidence > np.log(np.maximum(2, tested[np.maximum(n, 4)] if len(tested) > 4 else tested[n])) + (1 if k else 2))] if len(feature) else feature)
    return np.unique(np.concatenate(out))


def _field(keys: np.ndarray, first: np.ndarray, y: np.ndarray, segments: int, rounds: int, rate: float, l2: float, length: int, seed: int) -> Field | None:
    toxic_keys = _keys_of_toxicity(keys, first, y) if len(keys) and 0 < y.sum() else []
    if not len(toxic_keys):
        return None
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    keyed = np.zeros(len(keys), dtype=bool)
    for column in keys.T:
        keyed |= np.isin(column, toxic_keys)
    tag = keyed & (y[doc] == 1)
    rng = np.random.default_rng(seed)
    clean = np.flatnonzero((y == 0) & (np.diff(first) > 0))
    around = np.flatnonzero(keyed)
    begin = np.concatenate([np.maximum(around - rng.integers(0, length, len(around)), first[:-1][doc[around]]), *[first[clean] + rng.integers(0, np.diff(first)[clean]) for _ in range(4)]])
    stop = np.minimum(begin + length, np.concatenate([first[1:][doc[around]], *[first[1:][clean]] * 4]))
    mixed = rng.permutation(len(begin))[:segments]
    begin, stop = begin[mixed], stop[mixed]
    at = begin[:, None] + np.arange(length)
    real = at < stop[:, None]
    at = np.where(real, at, 0)
    slots, z = _slots(keys[at[real]]), np.zeros(at.shape)
    z[real] = tag[at[real]]
    before = np.hstack([np.zeros((len(z), 1)), z[:, :-1]])
    counts = np.array([[((1 - before) * (1 - z))[real].sum(), ((1 - before) * z)[real].sum()], [(before * (1 - z))[real].sum(), (before * z)[real].sum()]])
    field = Field(np.zeros(1 << _BITS), -8.0, np.zeros((2, 2)))  # fixed: an unknown word is clean
    square, square_s = np.full(1 << _BITS, 1e-8), np.full((2, 2), 1e-8)
    total = len(slots)
    for _ in range(rounds):
        e = np.full(at.shape, 0.0)
        e[real] = field.emissions(slots)
        x, a = np.exp(e), np.exp(field.steps)
        alpha, b = np.zeros((length + 1, len(z), 2)), np.ones((len(z), 2))
        alpha[0, :, 0] = 1
        for t in range(length):
            q = alpha[t] @ a
            q[:, 1] *= x[:, t]
            alpha[t + 1] = np.where(real[:, t : t + 1], q / q.sum(1, keepdims=True), alpha[t])
        expected, m = np.zeros((2, 2)), np.zeros(at.shape)
        for t in range(length - 1, -1, -1):
            into = b * np.stack([np.ones(len(z)), x[:, t]], 1)
            pair = alpha[t][:, :, None] * a[None] * into[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            pair *= real[:, t, None, None]
            expected += pair.sum(0)
            m[:, t] = pair[:, :, 1].sum(1)
            c = into @ a.T
            b = np.where(real[:, t : t + 1], c / c.sum(1, keepdims=True), b)
        error = (z - m)[real]
        g = np.bincount(slots.reshape(-1), weights=np.repeat(error, slots.shape[1]), minlength=1 << _BITS) / total - l2 * field.weights
        gs = (counts - expected) / total
        square += g * g
        square_s += gs * gs
        field.weights += rate * g / np.sqrt(square)
        field.steps += rate / 20 * gs / np.sqrt(square_s)
    return field


def _evidence_of(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(np.where(m >= 0.1, -np.log1p(-np.minimum(m, 1 - 1e-4)), 0))])
    return total[first[1:]] - total[first[:-1]]


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray | None = None, segments: int = 6000, rounds: int = 60, rate: float = 0.5, l2: float = 1e-6, length: int = 24, seed: int = 5) -> Field:
    """A field from whole texts and their document labels; weight is how many documents each stands for."""
    data, offsets = text_buffers(texts)
    parts, n = [], 0
    for lo, hi in groups(offsets):
        _, _, first, keys = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
        parts.append((first[:-1] + n, keys))
        n += len(keys)
    y = np.asarray(y, dtype=float)
    first, keys = (np.concatenate([*[p[0] for p in parts], [n]]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(1, int), np.zeros((0, 1 + len(_PREFIXES)), np.uint64))
    del parts
    options = (segments, rounds, rate, l2, length, seed)
    whole = _field(keys, first, y, *options)
    if whole is None:
        return Field(np.zeros(1 << _BITS), -30.0, np.zeros((2, 2)))
    half, evidence = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        mine, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        cut = lambda docs: (np.concatenate([keys[first[d] : first[d + 1]] for d in docs]), np.concatenate([[0], np.cumsum(np.diff(first)[docs])]))
        if len(mine) and len(other) and (fitted := _field(*cut(other), y[other], *options)):
            k, f = cut(mine)
            evidence[mine] = _evidence_of(fitted.marginals(fitted.emissions(_slots(k)), f), f)
    whole.edges, whole.levels = _calibrated(evidence, y, np.ones(len(y)) if weight is None else weight)
    return whole


def _calibrated(evidence: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and score of the isotonic fit; the largest evidence also stands for one clean document that wasn't sampled."""
    values, at = np.unique(np.append(evidence, evidence.max()), return_inverse=True)
    w = np.bincount(at, weights=np.append(weight, weight.min() / 4))
    rate = np.bincount(at, weights=np.append(y * weight, 0)) / w
    return values, pool_adjacent_violators(rate, w)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, toxic_docs: int = 1500, clean_docs: int = 3000, sample_mb: int = 24) -> Field:
    """Learn from a sample of labelled rows for which `learn` (over doc_id) holds: those of least hash, at most so many of each label and so many bytes of text together."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("own"), F.octet_length("text").alias("n"))
    most, spark = {0: clean_docs, 1: toxic_docs}, docs.sparkSession
    known = Stage(spark, "toxicity").put(texts.join(y, "id").groupBy("id", "own", "n", "y").agg(F.count("*").alias("copies")), "known")
    near = near_least(known, "own", "y", F.when(F.col("y") == 1, toxic_docs).otherwise(clean_docs)).toArrow()
    total = dict(zip(near.column("y").to_pylist(), near.column("total").to_pylist()))
    chosen = least_hashed(near, "y", most, sample_mb << 20)
    own = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id", "text").alias("own"))
    single = np.asarray(chosen.column("copies")) == 1
    parts = []
    for mine, once in ((single, lambda df: df), (~single, lambda df: df.dropDuplicates(["id", "own"]))):
        if mine.any():  # broadcast: toxic_docs + clean_docs rows at most
            frame = spark.createDataFrame(chosen.filter(pa.array(mine)).select(["id", "own", "y"]))
            parts.append(once(own.join(F.broadcast(frame), ["id", "own"])).select("id", "text", "y").toArrow())
    if not parts:
        return train(pa.array([], pa.string()), np.zeros(0, int))
    sample = pa.concat_tables(parts)
    sample = sample.sort_by([("id", "ascending"), ("text", "ascending")])
    labels_of = np.asarray(sample.column("y"), dtype=int)
    taken = np.bincount(labels_of, minlength=2)
    weight = np.array([total.get(k, 0) / max(1, taken[k]) for k in (0, 1)])[labels_of]
    return train(sample.column("text").combine_chunks(), labels_of, weight)


def tag(docs: DataFrame, field: Field, held_out: Column) -> DataFrame:
    """docs: doc_id, text. Score and offending character spans of every text; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            scores, found = np.zeros(len(batch)), [[] for _ in range(len(batch))]
            for lo, hi in groups(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first, keys = tokens(part, own)
                m = shared.value.marginals(shared.value.emissions(_slots(keys)), first)
                scores[lo:hi] = shared.value.score(_evidence_of(m, first))
                for t in np.flatnonzero(m >= 0.5):
                    k = int(np.searchsorted(own, starts[t], side="right")) - 1
                    lead = len(part[own[k] : starts[t]].tobytes().decode(errors="ignore"))
                    found[lo + k].append({"start": lead, "end": lead + len(part[starts[t] : ends[t]].tobytes().decode(errors="ignore"))})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "held_out", "score", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(run, DDL)
