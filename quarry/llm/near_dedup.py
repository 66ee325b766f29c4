"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct 5-word shingles (A-Z lowered; fewer words are one shingle). Rows
with equal sets become one class. A class's sketch has `BUCKETS` registers; shingle hashes are dealt to
buckets by their first bits, and a register holds the leading-zero count and the next mantissa bits of
the bucket's least hash. Empty registers borrow from a filled one by a fixed probe sequence. Bands of
registers are compressed to keys; classes that share a key are candidates.

Within a key, every member is first compared with the least member (a star, never all pairs). A
candidate passes if the sizes allow the similarity and the Jaccard estimate from equal registers,
corrected for expected register collisions, is not below the threshold by more than its error; then
the full sets decide. Connected classes need no further comparison: only keys that still hold
several components are searched again. Keys of few members are joined with themselves. In others, members outside the star's
component are compared with all others in blocks of bounded size, which hold the full sets and return only the
links that join components: first in the largest key of each star, then in all keys that are left. So a large group of
near copies costs no row for each of its pairs.

With 32 bands of 4 registers a link at similarity 0.75 is missed with probability 5e-6, at 0.8 with
5e-8. Documents without words have the empty set and are linked with nothing. Null ids can't be
linked and keep themselves. Rows that repeat an id count as one document with that id. Empty tables give no rows;
extra columns are ignored. Whole texts of any length are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, lean
from .components import components
from .words import grouped_words, mix

SHINGLE, BUCKETS, BAND = 5, 128, 4
_BUCKET_BITS, _MANTISSA = 7, 10
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
with np.errstate(over="ignore"):
    _PROBES = (mix(np.arange(BUCKETS * 256, dtype=np.uint64) + np.uint64(0xABCDEF)) % np.uint64(BUCKETS)).astype(np.int64).reshape(BUCKETS, 256)
#: Sets under this size have too correlated registers for the estimate to rule a candidate out.
_SMALL = 64
#: Bits of the candidate filter: 8 MB at any size of the corpus.
_FILTER_BITS = 1 << 26
_FEW, _LEFT, _ALL = 24, 256, 2048
#: Shingles of a block, so that its sets take tens of MB.
_LEFT_SHINGLES, _ALL_SHINGLES = 500_000, 2_000_000


def shingles(h: np.ndarray) -> np.ndarray:
    """The sorted set of shingle hashes of one text's word hashes."""
    n = len(h)
    if not n:
        return h
    with np.errstate(over="ignore"):
        width = min(n, SHINGLE)
        total = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for k in range(width):
            total = total + mix(h[k : n - width + 1 + k] + np.uint64(k)) * _FACTORS[k]
        return np.unique(mix(total))


def sketch(s: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a sorted set of hashes."""
    shift = np.uint64(64 - _BUCKET_BITS)
    first = np.searchsorted(s >> shift, np.arange(BUCKETS, dtype=np.uint64))
    bounded = np.minimum(first, len(s) - 1)
    filled = (first < len(s)) & ((s[bounded] >> shift) == np.arange(BUCKETS, dtype=np.uint64))
    low = s[bounded] & np.uint64((1 << (64 - _BUCKET_BITS)) - 1)
    _, length = np.frexp((low >> np.uint64(5)).astype(np.float64))  # bits of the value; 52 fit a double
    zeros = 52 - length
    lead = np.maximum(length - 1, 0)
    mantissa = ((low >> np.uint64(5)) << (52 - lead).astype(np.uint64)) >> np.uint64(52 - _MANTISSA) & np.uint64((1 << _MANTISSA) - 1)
    registers = (zeros.astype(np.uint64) << np.uint64(_MANTISSA) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        hit = filled[_PROBES[empty]]
        source = _PROBES[empty, hit.argmax(1)]
        none = ~hit.any(1)
        if none.any():
            where = np.flatnonzero(filled)
            source[none] = where[np.searchsorted(where, empty[none]) % len(where)]
        registers[empty] = registers[source]
    return registers


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows a and b of sets of n and m shingles, less the registers expected to agree by chance."""
    equal = (a == b).sum(-1)
    chance = 0.16991 * BUCKETS / 2**_MANTISSA * 4 * n * m / np.maximum(n + m, 1) ** 2
    return np.maximum(0, equal - chance) / (BUCKETS - chance)


def _sized(n, m, percent: int):
    """The smaller set is large enough for the similarity."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def sketches(docs: DataFrame) -> DataFrame:
    """id, n_shingles, digest of the set, registers (both null for the empty set)."""

    def run(batches):
        for batch in batches:
            sizes, digests, registers = [], [], []
            for _, h, first in grouped_words(batch.column("text")):
                for k in range(len(first) - 1):
                    s = shingles(h[first[k] : first[k + 1]])
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], names=["id", "n", "digest", "registers"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, n long, digest binary, registers binary")


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(-1, BUCKETS)


def band_keys(classes: DataFrame) -> DataFrame:
    """key, id, n: a row for each class and band."""

    def run(batches):
        for batch in batches:
            r = _registers(batch.column("registers").to_pylist())
            packed = r.reshape(len(r), -1, BAND).astype(np.uint64)
            with np.errstate(over="ignore"):
                value = sum(packed[:, :, j] << np.uint64(16 * j) for j in range(BAND))
                keys = mix(value + mix(np.arange(packed.shape[1], dtype=np.uint64) + np.uint64(77))[None, :])
            width = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), pa.array(np.repeat(np.asarray(batch.column("id")), width)), pa.array(np.repeat(np.asarray(batch.column("n")), width))], names=["key", "id", "n"])

    return classes.select("id", "n", "registers").mapInArrow(lean(run), "key long, id long, n long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, more columns) whose sketches don't rule them out, with their estimate."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(frames):
        for p in frames:
            if len(p):
                n, m = p.n_a.to_numpy(), p.n_b.to_numpy()
                p["est"] = estimate(_registers(p.r_a), _registers(p.r_b), n, m)
                p = p[_sized(n, m, percent) & ((p.est >= floor(percent)) | (np.minimum(n, m) < _SMALL))]
                yield p[["a", "b", *more, "est"]]

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(lean(run), ", ".join(["a long", "b long", *[f"{c} long" for c in more], "est double"]))


def floor(percent: int) -> float:
    """Five standard errors of the estimate below the threshold."""
    j = percent / 100
    return j - 5 * (j * (1 - j) / BUCKETS) ** 0.5


def _needed(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of ids and of few others: a bit map of bounded size goes to the workers, so no other text is moved."""
    slot = F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS))
    used = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()  # _FILTER_BITS / 64 rows at most
    words = np.zeros(_FILTER_BITS // 64, dtype=np.int64)
    words[np.asarray(used.column("w"))] = np.asarray(used.column("bits"))
    shared = ids.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            s = np.asarray(batch.column("s"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text")], names=["id", "text"]).filter(pa.array(shared.value[s // 64] >> (s % 64) & 1 == 1))

    return texts.select("id", "text", slot.alias("s")).mapInArrow(lean(run), "id long, text string")


def verified(pairs: DataFrame, texts: DataFrame, stage: Stage, name: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. Only texts of documents in a pair are moved."""
    pairs = stage.put(pairs, f"{name}-pairs")
    found = stage.put(_needed(pairs.select(F.explode(F.array("a", "b")).alias("id")), texts), f"{name}-texts")

    def compare(batches):
        kept: dict[int, np.ndarray] = {}

        def sets(ids, column):
            ids, fresh = ids.to_pylist(), {}
            for k, i in enumerate(ids):
                if i not in kept and i not in fresh:
                    fresh[i] = k
            if fresh:
                for lo, h, first in grouped_words(column.take(pa.array(list(fresh.values())))):
                    for k, i in enumerate(list(fresh)[lo : lo + len(first) - 1]):
                        kept[i] = shingles(h[first[k] : first[k + 1]])
            return [kept[i] for i in ids]

        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                good = []
                for x, y in zip(sets(batch.column("a"), batch.column("text_a")), sets(batch.column("b"), batch.column("text_b"))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
                while len(kept) > 64:
                    kept.pop(next(iter(kept)))

    both = pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    edges = stage.put(both.select("a", "b", "text_a", "text_b").mapInArrow(lean(compare), "a long, b long"), f"{name}-edges")
    stage.drop(f"{name}-texts", f"{name}-pairs")
    return edges


def _sizes(members: DataFrame) -> DataFrame:
    """Keys that hold several components, with how many rows and shingles are in all and outside the star's component; of keys with the same members one."""
    out = F.col("component") != F.col("lead")
    sizes = members.groupBy("key").agg(
        F.count("*").alias("all"), F.sum("n").alias("all_n"), F.count(F.when(out, 1)).alias("left"), F.sum(F.when(out, F.col("n"))).alias("left_n"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("same"), F.max("lead").alias("lead"),
    )
    return sizes.where("left > 0 and all > 2").groupBy("all", "all_n", "left", "left_n", "same", "lead").agg(F.min("key").alias("key")).drop("same")


def _few(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) across components in keys of at most _FEW members."""
    few = members.join(sizes.where(F.col("all") <= _FEW).select("key"), "key")
    mine = few.where("component != lead").select("key", F.col("id").alias("left"), F.col("component").alias("mine"))
    both = mine.join(few.select("key", F.col("id").alias("right"), F.col("component").alias("other")), "key").where("mine != other")
    return both.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct()


def _roots(n: int):
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def linked(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between rows of two blocks that join different components, until none is left: columns id, component, n, registers, shingles."""
    labels, local = np.unique(np.concatenate([left.component.to_numpy(), right.component.to_numpy()]), return_inverse=True)
    mine, theirs = local[: len(left)], local[len(left) :]
    parent, find = _roots(len(labels))
    registers, sizes, ids = _registers(right.registers), right.n.to_numpy(), right.id.to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in right.shingles]
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    out = []
    for r, n, i, c, own in zip(_registers(left.registers), left.n, left.id, mine, left.shingles):
        est = estimate(registers, r[None], sizes, n)
        open_ = np.flatnonzero(_sized(sizes, n, percent) & ((est >= floor(percent)) | (np.minimum(sizes, n) < _SMALL)))
        open_ = open_[np.argsort(-est[open_], kind="stable")]
        own = np.frombuffer(own, dtype=np.uint64)
        mark = np.zeros(len(values), dtype=bool)
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        mark[at[values[at] == own]] = True
        step = 8
        while len(open_):
            root = find(c)
            open_ = open_[[find(theirs[j]) != root for j in open_]]
            tried, open_, step = open_[:step], open_[step:], step * 4
            for j in tried:
                common = int(mark[flat[begin[j] : begin[j + 1]]].sum())
                if 100 * common >= percent * (n + sizes[j] - common) and find(theirs[j]) != find(c):
                    parent[find(theirs[j])] = find(c)
                    out.append((min(i, ids[j]), max(i, ids[j])))
    return out


def _many(members: DataFrame, sizes: DataFrame, classes: DataFrame, texts: DataFrame, stage: Stage, name: str, percent: int) -> DataFrame:
    """Links (a, b) across components in the keys of sizes, found in pairs of blocks."""
    blocks = lambda rows, most, n, most_n: F.ceil(F.greatest(F.col(rows) / most, F.col(n) / most_n)).cast("int")
    wanted = sizes.select("key", blocks("left", _LEFT, "left_n", _LEFT_SHINGLES).alias("lefts"), blocks("all", _ALL, "all_n", _ALL_SHINGLES).alias("alls"))
    dealt = stage.put(members.select("key", "id", "n", "component", "lead").join(wanted, "key"), f"{name}-dealt")

    def run(batches):
        for batch in batches:
            sets = [shingles(h[first[k] : first[k + 1]]).tobytes() for _, h, first in grouped_words(batch.column("text")) for k in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    sets = stage.put(_needed(dealt.select("id").distinct(), texts).mapInArrow(lean(run), "id long, shingles binary"), f"{name}-sets")
    full = dealt.join(classes.select("id", "registers"), "id").join(sets, "id")
    h, columns = F.xxhash64("id", "key"), ("id", "component", "n", "registers", "shingles")
    right = full.select("key", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.pmod(h, F.col("alls")).cast("int").alias("r"), *columns, F.lit(False).alias("build"))
    left = full.where("component != lead").select("key", F.pmod(h, F.col("lefts")).cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("r"), *columns, F.lit(True).alias("build"))

    def search(p: pd.DataFrame) -> pd.DataFrame:
        build, probe = p[p.build], p[~p.build]
        return pd.DataFrame(linked(build, probe, percent) if len(build) and len(probe) else [], columns=["a", "b"])

    found = stage.put(right.unionByName(left).groupBy("key", "l", "r").applyInPandas(search, "a long, b long"), f"{name}-edges")
    stage.drop(f"{name}-dealt", f"{name}-sets")
    return found


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's id, n_shingles, component_id and kept."""
    stage = Stage(docs.sparkSession, "neardup")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    rows = stage.put(sketches(texts), "sketches")
    classes = rows.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("registers").alias("registers"))
    classes = stage.put(classes, "classes")
    keyed = band_keys(classes)
    stars = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("star"), F.count("*").alias("members")).where("members > 1").select("key", F.col("star.id").alias("lead"), F.col("star.n").alias("lead_n"))
    members = stage.put(keyed.join(stars, "key"), "members")
    pairs = members.where("id != lead").where(f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    edges = verified(likely(pairs, classes, percent).select("a", "b"), texts, stage, "star", percent)
    placed_rows = rows.join(classes.select("digest", F.col("id").alias("class")), "digest", "left").select("id", "n", "class")
    several = placed_rows.where("class is not null and id is not null").groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("top")).where("a < top").select("id", "a")
    edges = edges.unionByName(placed_rows.join(several, "id").select("a", F.col("class").alias("b")).where("a != b").distinct())  # rows of one id are one document
    found = components(edges, stage, "first")

    def placed(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Members and keys with the components so far."""
        of = lambda x, c: found.select(F.col("id").alias(x), F.col("component").alias(c))
        now = members.select("key", "id", "n", F.col("lead").alias("star")).join(of("id", "component"), "id", "left").join(of("star", "lead"), "star", "left")
        now = stage.put(now.select("key", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("lead", "star").alias("lead")), f"{name}-members")
        return now, stage.put(_sizes(now), f"{name}-sizes")

    now, sizes = placed(found, "first")
    pairs = stage.put(likely(_few(now, sizes), classes, percent).select("a", "b"), "few")
    more = pairs if pairs.isEmpty() else verified(pairs, texts, stage, "few", percent)
    many = sizes.where(F.col("all") > _FEW)
    if not many.isEmpty():
        largest = many.groupBy("lead").agg(F.max_by("key", F.struct("all", "key")).alias("key")).select("key")
        edges = edges.unionByName(more).unionByName(_many(now, many.join(largest, "key", "left_semi"), classes, texts, stage, "largest", percent))
        found = components(edges, stage, "second")
        now, sizes = placed(found, "second")
        more = _many(now, sizes.where(F.col("all") > _FEW), classes, texts, stage, "rest", percent)
    if not more.isEmpty():
        edges = edges.unionByName(more)
        found = components(edges, stage, "final")
    placed_rows = placed_rows.join(found.select(F.col("id").alias("class"), "component"), "class", "left")
    whole = placed_rows.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "class", "id")).alias("component_id"))
    return whole.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
