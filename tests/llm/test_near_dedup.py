import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from quarry.llm import near_dedup as N
from quarry.llm.common import Stage
from quarry.llm.components import components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t))
    ids, parent = list(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if any(len(x & y) * 100 >= 75 * len(x | y) and x for x in sets[ids[a]] for y in sets[ids[b]]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: (max(map(len, sets[i])), find(i), find(i) == i) for i in ids}


def found(spark, rows):
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in out}) == len(out)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


def chain(n=40):
    """Copies that drift: neighbours are near, the ends are not, and the least id is at no centre."""
    rng = random.Random(8)
    words, rows = [f"w{rng.randrange(999)}" for _ in range(120)], []
    for k in range(n):
        words = [f"n{k}x{j}" if rng.random() < 0.02 else w for j, w in enumerate(words)]
        rows.append((rng.randrange(10_000), " ".join(words)))
    return rows


@pytest.mark.parametrize("few", [24, 4])
def test_equals_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(N, "_FEW", few)  # the small value searches even small keys in blocks
    monkeypatch.setattr(N, "_LEFT", 7)
    monkeypatch.setattr(N, "_ALL", 11)
    rng = random.Random(3)
    base = [f"b{rng.randrange(300)}" for _ in range(150)]
    star = [(20_000 + k, " ".join(w if rng.random() > 0.03 else f"e{k}" for w in base)) for k in range(60)]
    rows = chain() + star + [(30_000, "a b c"), (30_001, "A b  c"), (30_002, None), (30_003, ""), (30_004, "a b c d"), (50_000, star[0][1]), (50_000, star[0][1])]
    assert found(spark, rows) == brute(rows)


def test_odd_documents(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.doc_id is not None]
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd).collect()}
    null = out.pop(None)
    assert null[1] is None and null[2]
    assert out == brute(rows)
    assert N.near_duplicates(empty).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(5)
    errors = []
    for shared in (50, 200, 400, 800):
        a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)]))
        j = shared / (2000 - shared)
        errors.append(abs(N.estimate(N.sketch(a)[None], N.sketch(b)[None], np.array([1000]), np.array([1000]))[0] - j))
    assert max(errors) < 0.15
    tiny = N.sketch(np.array([7], dtype=np.uint64))
    assert len(tiny) == N.BUCKETS and (tiny == tiny[0]).all()


def test_blocks_link_only_what_joins():
    sets = {i: np.arange(k, k + 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i, k in ((1, 0), (2, 10), (3, 20), (4, 5000))}
    sets = {i: np.unique(s) for i, s in sets.items()}
    frame = pd.DataFrame({"id": list(sets), "component": list(sets), "n": 200, "registers": [N.sketch(s).tobytes() for s in sets.values()], "shingles": [s.tobytes() for s in sets.values()]})
    links = N.linked(frame, frame, 75)
    assert len(links) == 2 and {i for p in links for i in p} == {1, 2, 3}


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (1000, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "test"), "c")
    got = {r.id: r.component for r in out.collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, 5: 3, 9: 3, 1000: 7}
