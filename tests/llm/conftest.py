import random

import pytest

#: Column names that operators use inside.
CLASH = "id key n size score row h t clean w registers digest shard slot range tie position c component stats y fold text_crc32 m rejected_by star lead held_out bucket own tail".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(2)
    words = [a + b for a in "ka lo mi ru se".split() for b in "ba do fi gu te na".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(80)
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, base, "en"), (5, base, "en"), (5, base, "en"), (6, base.upper(), "de"), (7, text(60_000), "en"), (8, "x" * 200_000, "de"), (None, text(90), None)]
    rows += [(9, base + " one more tail", "en"), (10, "a b", "en"), (11, "A  b", "en"), (12, "\x1c \x85 zwei drei", "de"), (13, "١٢٣ ... !!", "fr"), (14, "<|endoftext|> é", "fr")]
    rows += [(20 + k, text(100 + k) + "\n" + text(9), rng.choice(["en", "de"])) for k in range(30)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, x, None, None, *["clash"] * len(CLASH)) for i, t, x in rows], ddl)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
