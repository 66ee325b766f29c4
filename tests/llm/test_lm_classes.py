"""Word classes of the language model: moves against the recomputed likelihood, classes, transitions and scores against plain versions."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import lm
from quarry.llm.common import Stage

C = 6


def _pairs(texts):
    """Pairs of neighbours; a text begins after its last token."""
    return collections.Counter((t[k - 1], w) for t in texts for k, w in enumerate(t))


def _joint(pairs, member, classes):
    out = np.zeros((classes, classes))
    for (a, b), n in pairs.items():
        out[member[a], member[b]] += n
    return out


def _features(pairs, member, classes, words):
    right, left, twice = np.zeros((len(words), classes)), np.zeros((len(words), classes)), np.zeros(len(words))
    place = {w: k for k, w in enumerate(words)}
    for (a, b), n in pairs.items():
        if a == b and a in place:
            twice[place[a]] += n
        elif a != b:
            if a in place:
                right[place[a], member[b]] += n
            if b in place:
                left[place[b], member[a]] += n
    return right, left, twice


def test_a_move_is_the_best_by_the_recomputed_likelihood():
    rng = random.Random(4)
    texts = [[rng.choice("aabbbcdefghijklm") for _ in range(rng.randint(1, 9))] for _ in range(60)]
    pairs, words = _pairs(texts), sorted({w for t in texts for w in t})
    member = {w: rng.randrange(4) for w in words}
    joint = _joint(pairs, member, 4)
    new = lm.best(*_features(pairs, member, 4, words), np.array([member[w] for w in words]), joint)
    moved = 0
    for w, c in zip(words, new):
        by = [lm.likelihood(_joint(pairs, member | {w: k}, 4)) for k in range(4)]
        assert by[c] == pytest.approx(max(by), abs=1e-7)
        moved += c != member[w]
    assert moved


@pytest.mark.parametrize("own, local", [(50, 100_000), (50, 3), (4, 14), (0, 0)])
def test_classes_transitions_and_scores(spark, odd, own, local):
    training = odd.where("doc_id is null or doc_id % 5 != 0")
    stage = Stage(spark, "lm")
    model, rare = lm.fit(training, stage, own=own, shared=8, local_words=local, classes=C)
    table = {r.h: r for r in rare.collect()}
    known = dict(zip(model.words.hashes.tolist(), model.classes.tolist()))
    assert not set(table) & set(known)
    tokens = {}

    def texts(df):
        for r in df.select("doc_id", "text").collect():
            (_, h, bucket, _), = lm._tokens(pa.RecordBatch.from_arrays([pa.array([r.text], pa.string())], names=["text"]), 8)
            tokens.update(zip(h.tolist(), bucket.tolist()))
            yield r.doc_id, h.tolist()

    learned = [t for _, t in texts(training)]
    count, pairs = collections.Counter(w for t in learned for w in t), _pairs(learned)
    assert {h: r.c for h, r in table.items()} == {h: n for h, n in count.items() if h not in known}
    # words that aren't local move last, each by its own neighbours
    before = {w: known.get(w, int(model.unseen[tokens[w]])) for w in count}
    words = sorted(table)
    if words:
        want = lm.best(*_features(pairs, before, C, words), np.array([before[w] for w in words]), _joint(pairs, before, C))
        assert [table[w]["class"] for w in words] == want.tolist()
    final = known | {h: r["class"] for h, r in table.items()}
    joint = _joint(pairs, final, C)
    assert np.allclose(model.transition, np.log10((joint + 0.1) / (joint.sum(1, keepdims=True) + 0.1 * C)))
    size = [1 + sum(n for w, n in count.items() if final[w] == k) + sum(final[w] == k for w in count) for k in range(C)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 3)) for r in lm.score(odd, model, rare, F.lit(False), stage).collect())
    want = []
    for i, t in texts(odd):
        c = [final.get(w, int(model.unseen[tokens[w]])) for w in t]
        want.append((-1 if i is None else i, sum(model.transition[c[k - 1], c[k]] + math.log10((count[w] + 1) / size[c[k]]) for k, w in enumerate(t))))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(want)], atol=2e-3)


@pytest.mark.parametrize("local", [100_000, 20])
def test_rare_words_with_one_beginning_have_classes_of_their_own(spark, local):
    """Nouns and verbs of one beginning and one frequency: the model knows from their neighbours, which they share with frequent ones, where each belongs."""
    rng = random.Random(6)
    nouns, verbs = ([f"zz{kind}{k}" for k in range(30)] for kind in "nv")
    line = lambda n, v: f"the {n} of a {n} will {v} or must {v} ."
    pick = [(n, v) for _ in range(3) for n, v in zip(rng.sample(nouns, 30), rng.sample(verbs, 30))]
    pick += [(n, v) for _ in range(60) for n, v in zip("cat dog fox owl".split(), "eat lie nap sit".split())]
    rng.shuffle(pick)
    docs = spark.createDataFrame([(k, " ".join(line(n, v) for n, v in pick[k::20])) for k in range(20)], "doc_id long, text string")
    stage = Stage(spark, "lm")
    model, counts = lm.fit(docs, stage, own=16, shared=4, local_words=local, classes=8)
    probe = spark.createDataFrame([(k, line(n, v)) for k, (n, v) in enumerate(zip(nouns, verbs))] + [(100 + k, line(v, n)) for k, (n, v) in enumerate(zip(nouns, verbs))], "doc_id long, text string")
    s = {r.doc_id: r for r in lm.score(probe, model, counts, F.lit(True), stage).collect()}
    assert all(s[k].base_score == pytest.approx(s[100 + k].base_score) for k in range(30))
    assert sum(s[k].score > s[100 + k].score + 1 for k in range(30)) == 30
