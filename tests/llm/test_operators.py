"""Operators against plain versions, and on odd and empty tables."""

import collections
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, language, licenses, lm, packing, quality_classifier, quality_rules, queries, sharding, toxicity
from quarry.llm.common import Stage, remainder

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def _crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def test_oracles(spark, sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{sf}/{name}')")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, sf), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(want.select(*columns).fetchall())


# --- language -----------------------------------------------------------------------------------


def test_language(spark, sf, odd, empty):
    out = queries.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.fit(odd.select("doc_id", "lang", "text"), ~held_out)
    got = language.predict(odd, model, held_out).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 13)) and by[12].lang_pred != "und"
    assert all(r.held_out == (_crc(r.doc_id, 4) == 2) for r in got)
    assert language.predict(empty, model, held_out).count() == 0
    nothing = language.fit(empty.select("doc_id", "lang", "text"), ~held_out)
    assert {r.lang_pred for r in language.predict(odd, nothing, held_out).collect()} == {"und"}


def _bits(order, train, s):
    """Code length of s after the texts of train, by the definition."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        padded = b" " * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[padded[i - k : i]][padded[i]] += 1
    total, padded = 0.0, b" " * order + s
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            c = counts.get(padded[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                if padded[i] in c:
                    total -= math.log2(c[padded[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_follow_the_definition():
    rng = random.Random(8)
    alphabets = ["ab ", "abcdefghij ", "абвгд ", "漢字仮名 ", "αβγ .", "אבג "] + [f"{chr(97 + k)}{chr(98 + k)}xyz " for k in range(14)]
    texts = {f"l{k:02}": [" ".join("".join(rng.choice(a) for _ in range(30)) for _ in range(3)).encode() for _ in range(4)] for k, a in enumerate(alphabets)}
    model = language.Ppm(sorted(texts), texts)
    probes = [b"abba bab", b"", *(t[0][:57] + b"Z\xff" for t in texts.values()), "漢abв".encode(), b"x"]
    got = model.lengths(np.frombuffer(b"".join(probes), np.uint8), np.cumsum([0, *map(len, probes)]))
    assert model.order == 4 and got.shape == (len(probes), 20)
    for row, p in zip(got, probes):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in p)
        assert row == pytest.approx([_bits(4, texts[x], low) for x in sorted(texts)], abs=1e-2, rel=1e-4)


def test_language_learns_texts_of_any_length_and_breaks_ties(spark):
    words = {"aa": "ka lo mi", "bb": "zu zo zi", "cc": "pré tré fré", "dd": "ka lo mi"}
    rows = [(k, " ".join([words["aa"]] * 40), "aa") for k in range(5)] + [(10 + k, words["bb"][k % 2 :], "bb") for k in range(9)] + [(30, " ".join([words["cc"]] * 30_000), "cc")]
    rows += [(100 + k, t, x) for k, t, x in rows if x == "aa"]  # the same texts as dd
    rows = [(i, t, "dd" if i >= 100 else x) for i, t, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.langs == ["aa", "bb", "cc", "dd"]
    probes = spark.createDataFrame([(1, "lo mi ka"), (2, "zo zi"), (3, "tré pré")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(probes, model, F.lit(False)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["aa", "bb", "cc"] and got[1].score == pytest.approx(0.5, abs=0.01)


# --- quality rules ------------------------------------------------------------------------------


def _measures(t):
    w = [x for x in (t or "").encode().split()]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated)


def test_rules(spark, odd, empty):
    extra = [(100, "a b c a b c a b c x"), (101, "q r q r q r q"), (102, "one\none\n\n one\none"), (103, "# | < >\n* $ % &"), (104, "a b c d a b c e b c d")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect())
    want = collections.Counter()
    for r in docs.collect():
        m = _measures(r.text)
        want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    kept = {r.doc_id for r in quality_rules.keep(odd).collect()}
    assert kept == {r.doc_id for r in quality_rules.judge(odd).where("kept").collect()} and quality_rules.keep(odd).columns == odd.columns
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def _greedy_cost(rules, costs, patterns, order):
    """Seconds of the values that are computed when rules run in this order and stop at the first rejection."""
    total = 0.0
    for rejected, n in patterns.items():
        have = set()
        for name in order:
            have |= set(quality_rules.needs(next(r for r in rules if r.name == name).reject))
            if name in rejected:
                break
        total += n * sum(costs[v] for v in have)
    return total


def test_rules_are_ordered_by_rejections_per_cost(spark, sf):
    rules = quality_rules.RULES
    costs, patterns = quality_rules.measure(spark.read.parquet(f"{sf}/documents.parquet"))
    assert set(costs) == {v for r in rules for v in quality_rules.needs(r.reject)} and min(costs.values()) > 0
    ordered = quality_rules.order_rules(rules, costs, patterns)
    assert sorted(r.name for r, _, _ in ordered) == sorted(r.name for r in rules)
    rates = {r.name: sum(n for p, n in patterns.items() if r.name in p) / sum(costs[v] for v in quality_rules.needs(r.reject)) for r in rules}
    assert rates[ordered[0][0].name] == max(rates.values()) > 0
    # Evaluations as the cascade makes them cost less than all values, and less than with the rules turned round.
    every = sum(patterns.values()) * sum(costs.values())
    names = [r.name for r, _, _ in ordered]
    assert _greedy_cost(rules, costs, patterns, names) < every and _greedy_cost(rules, costs, patterns, names) <= _greedy_cost(rules, costs, patterns, names[::-1])


def test_cascade_computes_each_value_once_and_only_when_needed():
    sql = quality_rules.cascade(list(quality_rules.RULES))
    for value in quality_rules.VALUES:
        assert sql.count(f" q_{value} -> ") + sql.count(f"), q_{value} -> ") == 1 or sql.count(f"q_{value} ->") == 1, value
    places = [sql.index(f"then '{r.name}'") for r in quality_rules.RULES]
    assert places == sorted(places)
    assert sql.index("q_n_upper ->") > sql.index("then 'duplicate_lines'") and sql.index("q_lines ->") > sql.index("then 'word_length'")
    assert quality_rules.order_rules(quality_rules.RULES, {}, collections.Counter())[0][0] == quality_rules.RULES[0]


# --- language model -----------------------------------------------------------------------------


def test_lm(spark, odd, empty):
    held_out = remainder(F.col("doc_id"), 7) == 2
    for local in (100_000, 3):  # nearly all words through the join as well
        stage = Stage(spark, "lm")
        model, counts = lm.fit(odd.where(~held_out), stage, own=50, shared=8, local_words=local, classes=6)
        got = lm.score(odd, model, counts, held_out, stage).collect()
        tokens = lambda t: [*(t or "").encode().lower().split(), None]
        rows = odd.select("doc_id", "text").collect()
        c = collections.Counter(w for r in rows if _crc(r.doc_id, 7) != 2 for w in tokens(r.text))
        n, v = sum(c.values()), len(c)
        want = sorted((-1 if r.doc_id is None else r.doc_id, len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 3)) for r in rows for w in [tokens(r.text)])
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    stage = Stage(spark, "lm")
    model, counts = lm.fit(empty, stage)
    assert all(r.n_known == 0 and r.base_score == 0 for r in lm.score(odd, model, counts, held_out, stage).collect())
    assert lm.score(empty, model, counts, held_out, stage).count() == 0


def test_class_model_beats_words_on_held_out(spark, sf):
    r = queries.op4_lm_scoring(spark, sf).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r.s > r.b


def test_exchange_finds_classes():
    pairs = np.zeros((8, 8))
    for a in range(4):
        for b in range(4):
            pairs[2 * a, 2 * b + 1] = pairs[2 * a + 1, 2 * b] = 5 + a
    member = lm.exchange(pairs, 2)
    assert len(set(member[::2])) == 1 and len(set(member[1::2])) == 1 and member[0] != member[1]


# --- sharding and packing -----------------------------------------------------------------------


def test_sharding(spark, sf, odd, empty):
    for docs, shards in ((spark.read.parquet(f"{sf}/documents.parquet"), 40), (odd, 7)):
        out = sharding.shard(docs, shards).collect()
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows)
        ordered = sorted(out, key=lambda r: (r.shard, r.slot))
        ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
        assert ids == sorted(ids)  # contiguous
        by, sizes = collections.defaultdict(list), collections.Counter()
        for r in ordered:
            by[r.shard].append(r.slot)
            sizes[r.shard] += r.size
        assert all(s == list(range(len(s))) for s in by.values()) and by.keys() <= set(range(shards))
        target, largest = sum(sizes.values()) / shards, max(r.size for r in out)
        assert all(abs(sizes[s] - target) <= largest for s in range(shards))
    assert sharding.shard(empty).count() == 0


def _check_packing(pieces, docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for n in packing.cuts(len(ids), capacity):
            want[i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    bins = collections.defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    used = padded = 0
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else capacity)
    return padded / used


def test_packing(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert _check_packing(packing.pack(docs, TOKENIZER).collect(), rows, 1024) < 1.02
    _check_packing(packing.pack(odd, TOKENIZER).collect(), [(r.doc_id, r.text) for r in odd.collect()], 1024)
    _check_packing(packing.pack(docs.limit(20), TOKENIZER, capacity=24).collect(), [(r.doc_id, r.text) for r in docs.limit(20).collect()], 24)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_encoder_equals_tokenizer():
    rng = random.Random(6)
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    assert e.cache is not None
    for _ in range(400):
        s = "".join(rng.choice("ab Z9'’\n\t  é  漢!?-'s\x1d​") for _ in range(rng.randrange(60)))
        assert np.frombuffer(e(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


# --- decontamination ----------------------------------------------------------------------------

ITEMS = [
    (1, "If Anna buys 12 apples at 3 euros each and Ben buys 12 pears, how many euros does Anna pay for the apples in total?"),
    (2, "Short item here"),
    (3, None),
    (4, "..."),
    (5, "A train leaves Paris at 9 and drives 250 km to Lyon. How many km are left after 2 hours if Paris lies 100 km back?"),
]


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, key string")
    filler = "some clean words that nobody would ever ask in a question of this kind at all"
    other = ITEMS[0][1].replace("Anna", "Zoe").replace("12", "40").replace("Ben", "Max").replace(" 3 ", " 7 ")
    mixed = ITEMS[0][1].replace("Anna", "Zoe", 1).replace("12", "99", 1)
    docs = [(1, f"{filler}. {ITEMS[0][1]} {filler}"), (2, f"{filler} {other} {filler}"), (3, filler), (4, None), (5, f"{filler} short item here"), (6, ""), (7, "x short item there"), (8, f"{filler} {ITEMS[4][1].upper()}"), (9, mixed), (1, f"{filler}. {ITEMS[0][1]} {filler}")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, h string, t string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.matches(frame, bench).collect()}
    assert got.keys() == {(1, 1), (2, 1), (5, 2), (8, 5)}
    assert got[1, 1].changed_slots == 0 and got[2, 1].changed_slots >= 4 and got[2, 1].conflicts == 0
    kept = decontamination.remove(frame, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 9] and kept.columns == frame.columns
    assert decontamination.matches(odd, bench).count() == 0 and decontamination.remove(odd, bench).count() == odd.count()
    assert decontamination.matches(empty, bench).count() == 0 and decontamination.matches(frame, bench.where("false")).count() == 0


def test_decontamination_finds_all_copies(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in rows:
        w = (r.text or "").lower().split()
        held = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        want |= {(r.doc_id, i) for i, t in items.items() if any(tuple(t[k : k + 8]) in held for k in range(len(t) - 7))}
    assert {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, sf).collect()} == want and want


# --- licenses -----------------------------------------------------------------------------------


def test_alignment():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) == [1, 2, 4]


def test_licenses(spark, odd, empty):
    apache, mit = licenses.TEMPLATES["Apache-2.0 notice"], licenses.TEMPLATES["MIT grant"]
    docs = [(1, f"intro\n{apache}.\nmiddle {apache}"), (2, mit.replace("any person", "every single person")), (3, "the license of the version under which licensed"), (4, None), (5, "é " * 3000 + mit), (6, "All rights reserved.")]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r.doc_id, r.license].append((r.start, r.end, round(r.coverage, 2)))
    assert [docs[0][1][a:b] for a, b, _ in sorted(got[1, "Apache-2.0 notice"])] == [apache, apache]
    assert got[2, "MIT grant"][0][2] > 0.9 and got[5, "MIT grant"][0][:2] == (6000, 6000 + len(mit)) and (6, "Reserved") in got
    assert not any(i in (3, 4) for i, _ in got)
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


# --- classifiers --------------------------------------------------------------------------------


def _held_out(spark, d, name, label):
    out = queries.queries()[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out").toPandas()
    hits = int(((out.predicted == 1) & (out.y == 1)).sum())
    return hits / max(1, int(out.predicted.sum())), hits / int((out.y == 1).sum()), (out.predicted == out.y).mean(), out


def test_quality_on_held_out(spark):
    _, _, accuracy, out = _held_out(spark, "/root/testdata/sf0.01", "op10_quality_classifier", "quality")
    assert accuracy > 0.9 and out.score.between(0, 1).all()


# Of 14 held-out toxic documents of sf0.01 five are German or French, of which the 37 that teach have two and four: too few for any test of chance.
@pytest.mark.parametrize("size, precision, recall", [("sf0.01", 0.9, 0.6), ("sf0.1", 0.9, 0.9)])
def test_toxicity_on_held_out(spark, size, precision, recall):
    p, r, _, out = _held_out(spark, f"/root/testdata/{size}", "op8_toxicity", "toxic")
    assert out.score.between(0, 1).all()
    assert p >= precision and r >= recall, (p, r)


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, (i % 2), (i % 2), "x") for i in range(4, 50)] + [(4, None, None, "x"), (None, 1, 1, "x"), (5, 7, 7, "x"), (6, 1, 1, "x")], "doc_id long, quality int, toxic int, score string")
    held_out = remainder(F.col("doc_id"), 4) == 2
    for docs in (odd, empty):
        for known in (labels, labels.where("false"), labels.where("quality = 1")):
            q = quality_classifier.fit_and_score(docs, known, "quality", ~held_out).collect()
            t = toxicity.tag(docs, toxicity.fit(docs, known, "toxic", ~held_out), held_out).collect()
            assert len(q) == len(t) == docs.count() and all(0 <= r.score <= 1 for r in [*q, *t])


def test_isotonic():
    y, w = np.array([0.2, 0.1, 0.5, 0.4, 0.9]), np.array([1.0, 3.0, 1.0, 1.0, 2.0])
    assert quality_classifier.pool_adjacent_violators(y, w) == pytest.approx([0.125, 0.125, 0.45, 0.45, 0.9])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    field = toxicity.Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)))
    e, first = rng.normal(size=150) * 2, np.array([0, 9, 9, 19, 150])
    got = field.marginals(e, first)
    for a, b in ((0, 9), (9, 19)):
        total = np.zeros(b - a)
        z = 0.0
        for m in range(1 << (b - a)):
            tags = [(m >> k) & 1 for k in range(b - a)]
            w = math.exp(sum(e[a + k] * t for k, t in enumerate(tags)) + sum(field.steps[x, y] for x, y in zip([0, *tags], tags)))
            z += w
            total += w * np.array(tags)
        assert got[a:b] == pytest.approx(total / z)
    alpha, beta, x, t = np.array([1.0, 0.0]), [np.ones(2)], np.exp(e[19:]), np.exp(field.steps)
    forward = []
    for v in x:
        alpha = alpha @ t * np.array([1, v])
        alpha /= alpha.sum()
        forward.append(alpha)
    for v in x[:0:-1]:
        back = t @ (np.array([1, v]) * beta[-1])
        beta.append(back / back.sum())
    both = np.array(forward) * np.array(beta[::-1])
    assert got[19:] == pytest.approx(both[:, 1] / both.sum(1))


def test_toxic_spans(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "ka lo mi ru se".split() for b in "ba do fi gu te na".split() for c in "l r s t n m k p".split()]
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(40)]
        if i % 3 == 0:
            w[rng.randrange(40)] = "Vilé" + rng.choice(["x", "zo", "qua"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held_out = remainder(F.col("doc_id"), 4) == 2
    out = toxicity.tag(docs, toxicity.fit(docs, known, "toxic", ~held_out), held_out).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in out)
    assert all(rows[r.doc_id][1][s.start : s.end].startswith("Vilé") for r in out for s in r.spans) and all(r.spans for r in out if r.doc_id % 3 == 0)
