"""Language-model scores by class-based n-grams: P(word | previous) = P(class | previous class) P(word | class).

Words are counted over all training documents by 64-bit hash (two of n words collide with
probability n^2 / 2^65). Every training word gets its class by exchange, on its own bigrams, in
three steps. The `own` most frequent words are moved one by one on the driver, while rarer ones
share a symbol by their first two bytes. Then, in `sweeps` over the texts, the other words of
`local_words` move, each as if all else stayed, as long as the likelihood rises. Last, in one
sweep more, all other words do, down to those seen once. Only words never seen in training keep the
class of their symbol.

Class transitions, counted with the final class of every token, have additive smoothing; a word's
emission is (count + 1) / (class tokens + class words + 1). Classes and counts of the `local_words`
most frequent words travel to the workers; all other words of a text meet theirs in a join on the
word, once per text.

Null texts are empty: one end token. Empty tables give no rows; with nothing to learn from, the
model knows no word. Repeated rows are each scored and each train; extra columns are ignored. Whole
texts of any length are read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, lean
from .words import groups, run_hashes, spans, text_buffers

_END = np.int64(0x5E2D0F5E2D0F5E2D)  # the end token's hash
_FLUSH = 4_000_000
_BLOCK = 256  # words that are moved at once


@dataclass
class Words:
    """Counts of frequent words, and the symbols of the most frequent."""

    hashes: np.ndarray  # sorted, of the locally known words
    counts: np.ndarray
    buckets: np.ndarray  # shared symbol of each
    symbols: np.ndarray  # own symbol of each, or -1
    own: int
    shared: int

    @property
    def size(self) -> int:
        return self.own + self.shared

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def symbol(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.symbols[at], -1) if len(self.symbols) else at
        return np.where(own >= 0, own, self.own + bucket)


def _tokens(batch: pa.RecordBatch, shared: int):
    """Per group of texts: first text, hashes and buckets of all tokens with the end tokens, first token of each text (n + 1)."""
    data, offsets = text_buffers(batch.column("text"))
    for lo, hi in groups(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = spans(part, offsets[lo : hi + 1])
        whole, begin = run_hashes(part, starts, [ends, np.minimum(ends, starts + 2)])
        first = first + np.arange(hi - lo + 1)
        h, bucket = np.full(first[-1], _END), np.zeros(first[-1], dtype=np.int64)
        word = np.ones(first[-1], dtype=bool)
        word[first[1:] - 1] = False
        h[word] = whole.view(np.int64)
        bucket[word] = (begin % np.uint64(shared)).astype(np.int64)
        yield lo, h, bucket, first


def _before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What stands before each token; a text begins after its end token."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = x[first[1:] - 1]
    return out


def _after(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[:-1] = x[1:]
    out[first[1:] - 1] = x[first[:-1]]
    return out


def count_words(docs: DataFrame, shared: int) -> DataFrame:
    """h, bucket, c of all tokens of text; partial counts are made before the shuffle."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            h, bucket, n = (np.concatenate([*[x[j] for x in held], np.zeros(0, np.int64)]) for j in range(3))
            held.clear()
            values, index, inverse = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(bucket[index].astype(np.int32)), pa.array(np.bincount(inverse, weights=n, minlength=len(values)).astype(np.int64))], names=["h", "bucket", "c"])

        for batch in batches:
            for _, h, bucket, _ in _tokens(batch, shared):
                values, index, n = np.unique(h, return_index=True, return_counts=True)
                held.append((values, bucket[index], n))
            if sum(len(x[0]) for x in held) > _FLUSH:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "h long, bucket int, c long").groupBy("h").agg(F.max("bucket").alias("bucket"), F.sum("c").alias("c"))


def frequent(counts: DataFrame, own: int, local: int, shared: int) -> Words:
    """The words whose count is from a threshold up, where the threshold leaves at most `local` of them."""
    level = F.floor(F.log2("c") * 16)
    at_least, have = None, 0
    for r in counts.where(F.col("c") > 1).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 16 rows for each doubling
        have += r["count"]
        if have > local:
            break
        at_least = r.level
    table = counts.where(level >= F.lit(at_least)).select("h", "c", "bucket").toArrow() if at_least is not None else pa.table({x: pa.array([], pa.int64()) for x in ("h", "c", "bucket")})
    table = table.sort_by("h")
    h, c, bucket = (np.asarray(table.column(x)) for x in ("h", "c", "bucket"))
    symbols, top = np.full(len(h), -1), np.lexsort((h, -c))[:own]
    symbols[top] = np.arange(len(top))
    return Words(h, c, bucket, symbols, len(top), shared)


def _packed(values: np.ndarray, first: np.ndarray, kind) -> pa.Array:
    """The values of each text as bytes."""
    values = np.ascontiguousarray(values, dtype=kind)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and where each text's begin (n + 1)."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data.copy().view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """Each text's tokens as places among the local words, or -1, and hashes and buckets of the others: texts are cut into words once for all sweeps."""
    shared_words = docs.sparkSession.sparkContext.broadcast(words)

    @lean
    def run(batches):
        w = shared_words.value
        for batch in batches:
            for _, h, bucket, first in _tokens(batch, w.shared):
                at = w.look_up(h)
                rare = at < 0
                rare_first = np.append(0, np.cumsum(rare))[first]
                yield pa.RecordBatch.from_arrays([_packed(at, first, np.int32), _packed(h[rare], rare_first, np.int64), _packed(bucket[rare], rare_first, np.int32)], names=["at", "h", "bucket"])

    return docs.select("text").mapInArrow(run, "at binary, h binary, bucket binary")


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Place of each token among the local words, bucket and hash (0 for local words), first token of each text (n + 1)."""
    at, first = _unpacked(batch.column("at"), np.int32)
    rare, out = at < 0, []
    for name, kind in (("bucket", np.int32), ("h", np.int64)):
        values = np.zeros(len(at), dtype=np.int64)
        if name in batch.schema.names:
            values[rare] = _unpacked(batch.column(name), kind)[0]
        out.append(values)
    return at.astype(np.int64), *out, first


def bigrams(coded: DataFrame, words: Words) -> np.ndarray:
    """Counts of symbol pairs over all texts; a text begins after the end token."""
    shared_words = coded.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        w = shared_words.value
        total = np.zeros(w.size * w.size, dtype=np.int64)
        for batch in batches:
            at, bucket, _, first = _coded(batch)
            s = w.symbol(at, np.where(at >= 0, np.append(w.buckets, 0)[at], bucket))
            total += np.bincount(_before(s, first) * w.size + s, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    table = coded.select("at", "bucket").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size^2 rows
    out = np.zeros(words.size * words.size)
    out[np.asarray(table.column("cell"))] = np.asarray(table.column("n"))
    return out.reshape(words.size, words.size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 4) -> np.ndarray:
    """The class of each symbol: symbols move, in order of frequency, to the class that raises the bigram likelihood most."""
    n, weight = len(pairs), pairs.sum(0) + pairs.sum(1)
    by_weight = np.argsort(-weight, kind="stable")
    member = np.empty(n, dtype=np.int64)
    member[by_weight] = np.arange(n) % classes
    onto = np.zeros((n, classes))
    onto[np.arange(n), member] = 1
    joint = onto.T @ pairs @ onto
    for _ in range(sweeps):
        moved = 0
        for w in by_weight:
            if not weight[w]:
                continue
            old, self_pairs = member[w], pairs[w, w]
            right, left = np.bincount(member, weights=pairs[w], minlength=classes), np.bincount(member, weights=pairs[:, w], minlength=classes)
            right[old] -= self_pairs
            left[old] -= self_pairs
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= self_pairs
            rows, columns, f = joint.sum(1), joint.sum(0), _xlogx(joint)
            gain = (_xlogx(joint + right) - f).sum(1) + (_xlogx(joint + left[:, None]) - f).sum(0)
            d = np.arange(classes)
            own = joint[d, d]
            gain += _xlogx(own + right + left + self_pairs) - _xlogx(own + right) - _xlogx(own + left) + _xlogx(own)
            gain -= _xlogx(rows + right.sum() + self_pairs) - _xlogx(rows) + _xlogx(columns + left.sum() + self_pairs) - _xlogx(columns)
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            moved += new != old
            member[w] = new
            joint[new] += right
            joint[:, new] += left
            joint[new, new] += self_pairs
        if not moved:
            break
    return member


@dataclass
class State:
    """Classes of all words while they move: rarer words than the local ones have that of their symbol."""

    words: Words
    local: np.ndarray  # of each local word
    shared: np.ndarray  # of each shared symbol
    classes: int

    def codes(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The class of a local word, the class + classes of another."""
        return np.where(at >= 0, np.append(self.local, 0)[at], self.classes + self.shared[bucket])


def likelihood(joint: np.ndarray) -> float:
    """Of class bigrams, without what no move changes."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(0)).sum() - _xlogx(joint.sum(1)).sum())


def best(right: np.ndarray, left: np.ndarray, twice: np.ndarray, old: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most for each word, all others staying where they are.

    right, left: how often each class stands after and before each word; twice: how often the word itself does.
    """
    n, classes = right.shape
    w, gain, diagonal = np.arange(n), np.zeros(right.shape), np.tile(np.diagonal(joint), (n, 1))
    for side, other, cells, total in ((right, left, joint.T, joint.sum(1)), (left, right, joint, joint.sum(0))):
        at, k = np.nonzero(side)
        if len(at):
            times, base, back = side[at, k], cells[k], np.flatnonzero(k == old[at])
            base[np.arange(len(at)), old[at]] -= times  # the word leaves its class
            base[back] -= other[at[back]]
            base[back, old[at[back]]] -= twice[at[back]]
            start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            gain[at[start]] += np.add.reduceat(_xlogx(base + times[:, None]) - _xlogx(base), start)
        mine, rest = (side.sum(1) + twice)[:, None], np.tile(total, (n, 1))
        rest[w, old] -= mine[:, 0]
        gain -= _xlogx(rest + mine) - _xlogx(rest)
    diagonal[w, old] -= right[w, old] + left[w, old] + twice
    gain += _xlogx(diagonal + right + left + twice[:, None]) - _xlogx(diagonal + right) - _xlogx(diagonal + left) + _xlogx(diagonal)
    return np.where(gain.max(1) > gain[w, old] + 1e-9, gain.argmax(1), old)


def class_pairs(coded: DataFrame, state: State) -> np.ndarray:
    """Counts of pairs of codes over all texts."""
    shared_state, size = coded.sparkSession.sparkContext.broadcast(state), 2 * state.classes

    @lean
    def run(batches):
        s, total = shared_state.value, np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            at, bucket, _, first = _coded(batch)
            code = s.codes(at, bucket)
            total += np.bincount(_before(code, first) * size + code, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    table = coded.select("at", "bucket").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size^2 rows
    out = np.zeros(size * size)
    out[np.asarray(table.column("cell"))] = np.asarray(table.column("n"))
    return out.reshape(size, size)


def _folded(pairs: np.ndarray) -> np.ndarray:
    """Pairs of codes as pairs of classes."""
    n = len(pairs) // 2
    return pairs.reshape(2, n, 2, n).sum((0, 2))


def move_local(coded: DataFrame, state: State, joint: np.ndarray) -> np.ndarray:
    """New classes of the local words; those with symbols of their own stay."""
    shared_state, width = coded.sparkSession.sparkContext.broadcast((state, joint)), 2 * state.classes + 1

    @lean
    def gather(batches):
        s, _ = shared_state.value
        total, movable = np.zeros((len(s.words.hashes) + 1) * width, dtype=np.int32), np.append(s.words.symbols < 0, False)
        for batch in batches:
            at, bucket, _, first = _coded(batch)
            c, before, after = s.codes(at, bucket) % s.classes, _before(at, first) == at, _after(at, first) == at
            mine = movable[at]
            right, left = np.where(after, 2 * s.classes, _after(c, first)), s.classes + _before(c, first)
            np.add.at(total, at[mine] * width + right[mine], 1)
            mine &= ~before  # a pair with itself counts once
            np.add.at(total, at[mine] * width + left[mine], 1)
        cells = np.flatnonzero(total)
        cut = np.flatnonzero(np.append(True, np.diff(cells // (_BLOCK * width)) > 0)) if len(cells) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(cells))):
            block = int(cells[a]) // (_BLOCK * width)
            own = (cells[a:b] - block * _BLOCK * width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own.tobytes()]), pa.array([total[cells[a:b]].tobytes()])], names=["block", "cells", "n"])

    @lean
    def settle(batches):
        (s, joint), totals = shared_state.value, {}
        for batch in batches:
            for block, cells, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                totals.setdefault(block, np.zeros(_BLOCK * width))[np.frombuffer(cells, np.int32)] += np.frombuffer(n, np.int32)
        for block, total in totals.items():
            total = total.reshape(_BLOCK, width)
            mine = np.flatnonzero(total.any(1))
            at, total = block * _BLOCK + mine, total[mine]
            new = best(total[:, : s.classes], total[:, s.classes : -1], total[:, -1], s.local[at], joint)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(new.astype(np.int32))], names=["at", "class"])

    gathered = coded.select("at", "bucket").mapInArrow(gather, "block int, cells binary, n binary")
    table = gathered.repartition(F.col("block")).mapInArrow(settle, "at long, class int").toArrow()  # at most a row for each local word
    out = state.local.copy()
    out[np.asarray(table.column("at"))] = np.asarray(table.column("class"))
    return out


def move_rare(coded: DataFrame, state: State, joint: np.ndarray) -> DataFrame:
    """h, c, class, after of each word that isn't local: its count, its new class, and the other such words after it.

    Rows without h have the pairs of such words with local ones and with themselves: c of the cell `class` of class pairs.
    """
    shared_state = coded.sparkSession.sparkContext.broadcast((state, joint))
    width = 2 * state.classes + 1  # codes of what stands beside, or the word itself

    @lean
    def gather(batches):
        s, _ = shared_state.value
        for batch in batches:
            at, bucket, h, first = _coded(batch)
            code, after = s.codes(at, bucket), _after(h, first)
            right = np.where(after == h, width - 1, _after(code, first))
            left = np.where(_before(h, first) == h, width - 1, _before(code, first))
            mine = np.flatnonzero(code >= s.classes)
            right, linked = right[mine], (right[mine] >= s.classes) & (right[mine] < width - 1)
            packed = (bucket[mine] * width + left[mine]) * width + right
            for a in range(0, len(mine), 100_000):
                cut = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[mine][cut]), pa.array(packed[cut]), pa.array(after[mine][cut], mask=~linked[cut])], names=["h", "packed", "after"])

    @lean
    def settle(batches):
        s, joint = shared_state.value
        cells = np.zeros((s.classes, s.classes), dtype=np.int64)

        def settled(h, packed, after, linked):
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            word = np.cumsum(np.append(False, h[1:] != h[:-1]))
            right, left, old = packed % width, packed // width % width, s.shared[packed[start] // (width * width)]
            new = np.empty(len(start), dtype=np.int64)
            for a in range(0, len(start), _BLOCK):
                lo, hi = start[a], start[a + _BLOCK] if a + _BLOCK < len(start) else len(h)
                n, own = min(_BLOCK, len(start) - a), word[lo:hi] - a
                sides = []
                for x in (right[lo:hi], left[lo:hi]):
                    other = x < width - 1
                    sides.append(np.bincount(own[other] * s.classes + x[other] % s.classes, minlength=n * s.classes).reshape(n, s.classes).astype(float))
                twice = np.bincount(own[right[lo:hi] == width - 1], minlength=n).astype(float)
                new[a : a + n] = best(*sides, twice, old[a : a + n], joint)
            mine = new[word]
            for row, column in ((mine[right < s.classes], right[right < s.classes]), (left[left < s.classes], mine[left < s.classes]), (mine[right == width - 1],) * 2):
                cells.ravel()[:] += np.bincount(row * s.classes + column, minlength=cells.size)
            index = np.append(0, np.cumsum(np.bincount(word[linked], minlength=len(start)))).astype(np.int32)
            c = np.diff(np.append(start, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(h[start]), pa.array(c), pa.array(new.astype(np.int32)), pa.ListArray.from_arrays(pa.array(index), pa.array(after[linked]))], names=["h", "c", "class", "after"])

        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for batch in batches:  # in order of h; a word's rows may go on in the next batch
            new = (np.asarray(batch.column("h")), np.asarray(batch.column("packed")), np.asarray(batch.column("after").fill_null(0)), np.asarray(batch.column("after").is_valid()))
            held = [np.concatenate(x) for x in zip(held, new)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield settled(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield settled(*held)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(cells.ravel()[at]), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.list_(pa.int64()))], names=["h", "c", "class", "after"])

    gathered = coded.mapInArrow(gather, "h long, packed long, after long")
    return gathered.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(settle, "h long, c long, class int, after array<long>")


@dataclass
class Model:
    words: Words
    classes: np.ndarray  # of each local word
    unseen: np.ndarray  # classes of words not seen in training, by shared symbol
    transition: np.ndarray  # log10 P(class | previous class)
    emission_total: np.ndarray  # log10 of a class's tokens and words and 1
    tokens: int
    distinct: int


def fit(training: DataFrame, stage: Stage, own: int = 1500, shared: int = 64, local_words: int = 100_000, classes: int = 48, smoothing: float = 0.1, sweeps: int = 2) -> tuple[Model, DataFrame]:
    """The model, and the table of counts and classes (h, c, class) of all training words but the local ones."""
    counts = stage.put(count_words(training, shared), "counts")
    words = frequent(counts, own, local_words, shared)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    stage.drop("counts")
    coded = stage.put(encode(training, words), "coded")
    seed = bigrams(coded, words)
    classes = min(classes, words.size)
    member = exchange(seed, classes)
    state = State(words, member[np.where(words.symbols >= 0, words.symbols, words.own + words.buckets)], member[words.own :], classes)
    pairs = class_pairs(coded, state)
    for _ in range(sweeps if (words.symbols < 0).any() else 0):
        moved = replace(state, local=move_local(coded, state, _folded(pairs)))
        new = class_pairs(coded, moved)
        if likelihood(_folded(new)) <= likelihood(_folded(pairs)):
            break
        state, pairs = moved, new
    joint, distinct = pairs[:classes, :classes].copy(), np.bincount(state.local, minlength=classes).astype(float)
    rare = stage.put(move_rare(coded, state, _folded(pairs)), "rare")
    stage.drop("coded")
    for r in rare.where("h is null").groupBy("class").agg(F.sum("c").alias("n")).collect():  # classes^2 rows
        joint[divmod(r["class"], classes)] += r.n
    table = rare.where("h is not null").select("h", "c", "class")
    links = rare.where("size(after) > 0").select(F.col("class").alias("before"), F.explode("after").alias("h"))
    for r in links.join(table, "h").groupBy("before", "class").count().collect():  # classes^2 rows
        joint[r.before, r["class"]] += r["count"]
    for r in table.groupBy("class").count().collect():
        distinct[r["class"]] += r["count"]
    transition = np.log10((joint + smoothing) / (joint.sum(1, keepdims=True) + smoothing * classes))
    return Model(words, state.local, state.shared, transition, np.log10(joint.sum(0) + distinct + 1), int(total.n), int(total.v)), table


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    index = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(index), pa.array(np.concatenate(values) if values else [], kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    return np.asarray(column.flatten()), np.asarray(column.value_lengths())


def score(docs: DataFrame, model: Model, counts: DataFrame, held_out: Column, stage: Stage) -> DataFrame:
    """docs: doc_id, text. Every text's tokens, known tokens, base and class-model log10 probability."""
    shared_model, classes = docs.sparkSession.sparkContext.broadcast(model), len(model.transition)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, seen double, class_score double, tail array<long>, times array<int>, spare array<int>, codes array<int>"

    @lean
    def run(batches):
        m, row = shared_model.value, TaskContext.get().partitionId() << 36
        log_counts, local_class = np.append(np.log10(m.words.counts + 1.0), 0.0), np.append(m.classes, 0)
        for batch in batches:
            n_tokens, known, seen, class_score, tails, times, spares, codes = ([] for _ in range(8))
            for _, h, bucket, first in _tokens(batch, m.words.shared):
                at, begin = m.words.look_up(h), first[:-1]
                c, local, log_c = local_class[at], at >= 0, log_counts[at]
                before, both = _before(c, first), local & _before(local, first)
                n_tokens.append(np.diff(first))
                known.append(np.add.reduceat(local.astype(np.int64), begin))
                seen.append(np.add.reduceat(log_c, begin))
                class_score.append(np.add.reduceat(np.where(both, m.transition[before, c], 0) - np.where(local, m.emission_total[c], 0) + log_c, begin))
                missing = np.flatnonzero(~local)
                doc = np.searchsorted(first, missing, side="right") - 1
                order = np.lexsort((h[missing], doc))
                ordered, doc = missing[order], doc[order]
                new = np.ones(len(missing), dtype=bool)
                new[1:] = (h[ordered][1:] != h[ordered][:-1]) | (doc[1:] != doc[:-1])
                index = np.flatnonzero(new)
                cut = np.searchsorted(doc[index], np.arange(len(first)))
                values, n, spare = h[ordered][index], np.diff(np.append(index, len(missing))), m.unseen[bucket[ordered][index]]
                code = c.copy()
                code[ordered] = classes + np.cumsum(new) - 1 - cut[doc]  # its place in the text's tail
                kept = ~local | ~_before(local, first) | ~_after(local, first)  # pairs of two local words between them are skipped later
                ends = np.append(0, np.cumsum(kept))[first]
                code = code[kept]
                for k in range(len(begin)):
                    a, b = cut[k], cut[k + 1]
                    tails.append(values[a:b])
                    times.append(n[a:b].astype(np.int32))
                    spares.append(spare[a:b].astype(np.int32))
                    codes.append(code[ends[k] : ends[k + 1]].astype(np.int32))
            size = len(batch)
            column = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + size)), batch.column("doc_id"), batch.column("held_out"), column(n_tokens, pa.int64()), column(known, pa.int64()), column(seen, pa.float64()), column(class_score, pa.float64())]
                + [_list(tails, pa.int64()), _list(times, pa.int32()), _list(spares, pa.int32()), _list(codes, pa.int32())],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "seen", "class_score", "tail", "times", "spare", "codes"],
            )
            row += size

    @lean
    def finish(batches):
        m = shared_model.value
        for batch in batches:
            (spare, n_spare), (code, n_code), (found, n_found) = (_flat(batch.column(x)) for x in ("spare", "codes", "found"))
            text, words = np.repeat(np.arange(len(batch)), n_code), np.cumsum(n_spare) - n_spare
            tail = spare.astype(np.int64)
            tail[np.repeat(words, n_found) + found // classes] = found % classes
            first = np.append(0, np.cumsum(n_code))
            full = np.flatnonzero(n_code)
            first = np.append(first[full], first[-1])  # of the texts with codes
            rare = code >= classes
            c = code.astype(np.int64)
            c[rare] = tail[words[text[rare]] + code[rare] - classes]
            total = np.zeros(len(batch))
            if len(c):
                pair = rare | _before(rare, first)
                total[full] = np.add.reduceat(np.where(pair, m.transition[_before(c, first), c], 0) - np.where(rare, m.emission_total[c], 0), first[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "seen")), pa.array(np.asarray(batch.column("class_score")) + total)], names=["doc_id", "held_out", "n_tokens", "n_known", "seen", "class_score"])

    local = stage.put(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(run, schema), "local")
    tail = local.select("row", F.posexplode(F.arrays_zip("tail", "times")).alias("k", "x")).select("row", "k", F.col("x.tail").alias("h"), F.col("x.times").alias("times"))
    met = tail.join(counts, "h").groupBy("row").agg(
        F.sum("times").alias("known_tail"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("seen_tail"), F.collect_list(F.col("k").cast("long") * classes + F.col("class")).alias("found")
    )
    more = F.coalesce("seen_tail", F.lit(0.0))
    joined = local.drop("tail", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_tail", F.lit(0))).alias("n_known"), (F.col("seen") + more).alias("seen"), (F.col("class_score") + more).alias("class_score"),
        "spare", "codes", F.coalesce("found", F.array().cast("array<long>")).alias("found"),
    )
    done = joined.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, seen double, class_score double")
    base = F.col("seen") - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    scored = F.col("class_score")
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), scored.alias("score"), F.pow(F.lit(10.0), -scored / F.col("n_tokens")).alias("perplexity"),
    )
