"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Every text becomes a short vector of statistics of its bytes, words and lines. Random Fourier
features approximate a Gaussian kernel on the standardised statistics. Each partition of labelled
rows sums its normal equations by fold, the sums are added up in Spark, and a ridge solution per
left-out fold gives out-of-fold scores; their counts by label on a fixed grid are fitted by
pool-adjacent-violators. The final weights use all folds.

Null texts have the statistics of the empty text. Rows with a null or other label than 0 or 1 teach
nothing; of several labels of a document the largest counts. Without labelled rows every score is 0.5.
Empty tables give no rows, repeated rows are each scored, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, lean
from .words import groups, spans, text_buffers, word_hashes

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "space": b"\t\n\x0b\x0c\r ", "line": b"\n", "high": range(128, 256)}
_CLASS = np.zeros((256, len(_CLASSES)), dtype=np.float64)
for _j, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes), _j] = 1
N_STATS = len(_CLASSES) + 11
GRID = 1000


def _repeats(h: np.ndarray) -> float:
    """Share of values that occurred before."""
    return 1 - len(np.unique(h)) / len(h) if len(h) else 0.0


def _one(text: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> list[float]:
    n = len(text)
    counts = np.bincount(text, minlength=256).astype(np.float64)
    share = counts / max(1, n)
    seen = share[share > 0]
    lines = np.diff(np.flatnonzero(np.concatenate([[True], text == 10, [True]])))
    triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else hashes[:0]
    return [
        *(share @ _CLASS), np.log1p(n), np.log1p(len(hashes)), float(-(seen * np.log2(seen)).sum()),
        float(lengths.mean()) if len(lengths) else 0.0, float(lengths.std()) if len(lengths) else 0.0, float(lengths.max(initial=0)) / 50,
        _repeats(hashes), _repeats(triples), float((hashes[1:] == hashes[:-1]).mean()) if len(hashes) > 1 else 0.0,
        np.log1p(len(lines)), np.log1p(float(lines.max(initial=0))),
    ]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of N_STATS statistics for each text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, N_STATS))
    for lo, hi in groups(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = spans(part, own)
        with np.errstate(over="ignore"):
            hashes = word_hashes(part, starts, ends)
            for k in range(hi - lo):
                a, b = first[k], first[k + 1]
                out[lo + k] = _one(part[own[k] : own[k + 1]], hashes[a:b], (ends - starts)[a:b])
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of text."""

    def run(batches):
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_STATS).cast(pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores at which the calibrated score steps
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.frequencies + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(stats), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), 0.5)
        return np.interp(self.features(stats) @ self.weights, self.edges, self.levels)


def pool_adjacent_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of y by weighted least squares."""
    blocks: list[list[float]] = []  # mean, weight, how many
    for value, weight in zip(y, w):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, n = blocks.pop()
            b = blocks[-1]
            b[:] = [(b[0] * b[1] + v * u) / (b[1] + u), b[1] + u, b[2] + n]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(labelled: DataFrame, features: int = 192, folds: int = 4, ridge: float = 1e-3, seed: int = 11) -> Model:
    """labelled: doc_id, stats, y (0 or 1). All rows are used; the driver gets folds x (features + 2)^2 sums at most."""
    columns = [F.expr(f"stats[{j}]") for j in range(N_STATS)]
    moments = labelled.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    rows = moments[0]
    none = np.zeros(0)
    if not rows:
        return Model(none, none, none, none, none, none, none)
    rng = np.random.default_rng(seed)
    mean, scale = np.array(moments[1 : 1 + N_STATS], dtype=float), np.maximum(np.array(moments[1 + N_STATS :], dtype=float), 1e-6)
    frequencies = rng.normal(size=(N_STATS, features)) / np.sqrt(N_STATS)
    model = Model(mean, scale, frequencies, rng.uniform(0, 2 * np.pi, features), none, none, none)
    width = features + 2  # bias and label
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def partial(batches):
        sums = np.zeros((folds, width, width))
        for b in batches:
            z = np.hstack([shared.value.features(_matrix(b.column("stats"))), np.asarray(b.column("y"), dtype=float)[:, None]])
            which = np.asarray(b.column("fold"))
            for k in range(folds):
                sums[k] += z[which == k].T @ z[which == k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(folds), width).astype(np.int32)), pa.array(np.tile(np.arange(width), folds).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1)), width).cast(pa.list_(pa.float64()))],
            names=["fold", "i", "sums"],
        )

    def added(key, table):
        total = _matrix(table.column("sums").combine_chunks()).sum(0)
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = labelled.select("stats", F.col("y").cast("double").alias("y"), fold.alias("fold")).mapInArrow(lean(partial), "fold int, i int, sums array<double>")
    sums = np.zeros((folds, width, width))
    for r in parts.groupBy("fold", "i").applyInArrow(added, "fold int, i int, sums array<double>").collect():  # folds x width rows
        sums[r.fold, r.i] = r.sums

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:-1, :-1] + ridge * max(1.0, s[-2, -2]) * np.eye(width - 1) / features, s[:-1, -1])

    whole = sums.sum(0)
    by_fold = labelled.sparkSession.sparkContext.broadcast(np.array([solve(whole - s) for s in sums]))

    def binned(batches):
        counts = np.zeros((GRID, 2))
        for b in batches:
            raw = (shared.value.features(_matrix(b.column("stats"))) * by_fold.value[np.asarray(b.column("fold"))]).sum(1)
            cell = np.clip(((raw + 0.5) / 2 * GRID).astype(int), 0, GRID - 1)
            np.add.at(counts, (cell, np.asarray(b.column("y"), dtype=int)), 1)
        cells = np.flatnonzero(counts.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells, 0]), pa.array(counts[cells, 1])], names=["cell", "n0", "n1"])

    grid = np.array([list(r) for r in labelled.select("stats", F.col("y").cast("double").alias("y"), fold.alias("fold")).mapInArrow(lean(binned), "cell int, n0 double, n1 double").groupBy("cell").agg(F.sum("n0"), F.sum("n1")).orderBy("cell").collect()])  # GRID rows at most
    weight = grid[:, 1] + grid[:, 2]
    model.weights, model.edges = solve(whole), (grid[:, 0] + 0.5) / GRID * 2 - 0.5
    model.levels = pool_adjacent_violators(grid[:, 2] / weight, weight)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """stats: doc_id, stats. Adds score from 0 to 1."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(_matrix(b.column("stats"))) if len(b) else [], pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(lean(run), "doc_id long, score double")


def fit_and_score(docs: DataFrame, labels: DataFrame, label: str, learn: Column, stage: Stage | None = None) -> DataFrame:
    """Scores of all docs by a model of those with a label for which `learn` (over doc_id) holds. The text is read once."""
    stage = stage or Stage(docs.sparkSession, "quality")
    stats = stage.put(with_statistics(docs), "stats")
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    labelled = stage.put(stats.join(y, "doc_id"), "labelled")
    return score(stats, fit(labelled))
