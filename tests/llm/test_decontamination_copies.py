"""Copies of items of all lengths in every layout, and whole texts against a plain version of the literal search."""

import random
import re

from quarry.llm import decontamination

WORDS = [a + b for a in "ka lo mi ru se to".split() for b in "ba do fi gu te na".split()]
FILLER = "some clean words that nobody would ever ask in a question"


def _items():
    rng = random.Random(3)
    items = []
    for n in (1, 2, 3, 5, 7, 8, 9, 12, 30, 200):
        words = [f"{rng.choice(WORDS)}{n}x".translate({ord(str(d)): "abcdefghij"[d] for d in range(10)}) for _ in range(n)]
        items.append(" ".join(w.capitalize() if rng.random() < 0.3 else w for w in words).capitalize() + "?")
    items += [" ".join(str(rng.randrange(1000, 9999)) for _ in range(n)) for n in (3, 8, 12)]
    return items + ["Anna has 3.5 kg. Ben has 1,200 km, Tom 7 days.", "What is 7 times 8"]


def test_every_item_is_found_in_every_layout(spark):
    items = _items()
    layouts = {
        "verbatim": lambda t: t,
        "wrapped": lambda t: re.sub(r" ", "\n", t),
        "spaced": lambda t: t.replace(" ", "  "),
        "lower": str.lower,
        "upper": str.upper,
        "quoted": lambda t: f"“{t}”",
    }
    docs, want = [(0, FILLER)], set()
    for k, item in enumerate(items):
        for change in layouts.values():
            for text in (f"{FILLER} {change(item)} {FILLER}", f"{FILLER}. {change(item)}", change(item)):
                want.add((len(docs), k))
                docs.append((len(docs), text))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert want <= got and not any(i == 0 for i, _ in got)


def test_other_values_are_found_and_mixed_ones_are_not(spark):
    item = "If Anna buys 12 apples at 3 euros each and Ben buys 12 pears, how many euros does Anna pay for the apples in total?"
    changed = item.replace("Anna", "Zoe").replace("12", "1,450").replace("Ben", "Max").replace(" 3 ", " 7 ")
    mixed = item.replace("Anna", "Zoe", 1).replace("12", "99", 1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, f"{FILLER} {changed} {FILLER}"), (2, f"{FILLER} {mixed}"), (3, changed.replace(" ", "\n\n")), (4, FILLER)]
    got = {r.doc_id: r for r in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got.keys() == {1, 3} and got[1].changed_slots >= 4 and got[1].conflicts == 0 and got[1].start_word == 11


def test_blocks_of_windows_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = set(map(tuple, decontamination.matches(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 600_000)
    assert set(map(tuple, decontamination.matches(docs, bench).collect())) == whole
