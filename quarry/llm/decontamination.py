"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text's words are what stands between white space and punctuation. Each is a literal, its lower case, and a template
token: a word with a digit is a number, a known unit after a number is a unit, a word that begins with a capital and
isn't in `COMMON` is a name, all others are their literals. Both depend on the word alone (a unit also on the word
before), not on line breaks, spaces, quotes or sentences. A document holds a window of `WINDOW` words of an item where
the literals are equal, or where the tokens are and half of them at least are literals; windows with more
placeholders say too little, so that their copies are found, other values there aren't. Items are also
searched with the capitals of their sentence beginnings as words, and with a name as their first word.

Each window has an anchor, the longest three neighbouring words that are literals in it (two, or one, where there aren't
three). Documents are joined with the benchmark's windows on the hashes of their anchors; only what stands around an
anchor is canonicalised and compared as a whole, by the window's hashes.

Matches of one document and item on one diagonal are put together; where they cover enough of the item, the
values in the placeholders are compared: each value of the item has to stand for one value of the document, up to
one conflict in five, as it does in a copy (equal values) and in a re-parameterised question (consistently other
values).

Null and empty texts match nothing. Items without a word are ignored, items shorter than a window
are looked for as a whole. Empty tables give no rows. Rows without an id can't be reported and are kept by
`remove`. Rows that repeat an id are one document with several texts; its report is its best match.
Extra columns are kept by `remove` and ignored elsewhere. Whole texts are read, once for each `BROADCAST_BYTES` of
benchmark windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, base_columns

WINDOW, LONG_MATCH = 8, 13
NUMBER, NAME, UNIT = "₀", "₁", "₂"
#: Unit words that follow a number.
UNITS = """% percent mm cm m km in inch inches ft feet yd yards mi mile miles mg g kg t lb lbs oz ml l litre litres liter liters
s sec seconds second min minutes minute h hour hours day days week weeks month months year years ms hz khz mhz ghz w kw
mw v kv a b kb mb gb tb c f k pa bar j kj cal kcal eur usd gbp euro euros dollar dollars cent cents pound pounds jahre
stunden tage ans jours heures horas días años""".split()

#: Words that are no names where they begin with a capital: function words and the usual first words of questions.
COMMON = """a about after all an and any are as at be because before between both but by calculate can choose compute consider
continue could define describe determine did do does each every evaluate explain find for from give given had has have he
her here his how i if in into is it its let list many most much my name no not of on one or our please prove she should
show simplify since so solve some state suppose than that the their then there these they this those to under was we were
what when where which while who whom whose why will with without would write you your
aber alle als am an auf aus bei berechne bestimme bis das dass dem den der des die dies diese dieser ein eine einem einen einer
er es finde für gib hat im ist jede jeder mit nach nenne nicht oder sei sie sind über um und von vor wann warum was welche
welcher welches wenn wer wie wieviel wir wo zu zum zur
au aux avec calcule calculez ce ces cette combien comment dans de des donne donnez du elle elles en est et il ils la le les leur
lorsque mais ne nous on où ou par pas pour pourquoi quand que quel quelle quelles quels qui sa se ses si son sont sur trouve
trouvez un une vous
al calcula calcule como cómo con cuál cuáles cuando cuándo cuánta cuántas cuánto cuántos del dónde donde el ella ellos entre era es
esta este estos halla hay las los más no para pero por porque qué quién quiénes según ser sin su sus también tiene una unos y""".split()

#: Bytes up to which a side is broadcast. Beyond it windows are joined block by block, all else is shuffled.
BROADCAST_BYTES = 96 << 20
_WINDOW_BYTES, _ID_BYTES = 192, 48  # of a row in a broadcast table

# Anchors by kind, better ones last: the places of their words.
_ANCHORS = ((0,), (0, 3), (0, 2), (0, 1), (0, 1, 2))
# A dot, comma or colon before a digit belongs to a number. Quotes beyond Latin-1 would slow the pattern down.
_SEPARATOR = r"""[\x09-\x0D\x20\xA0\xAB\xBB!-#\x27()*,.:;?\[\]`{|}](?<![.,:](?=[0-9]))[\x09-\x0D\x20\xA0\xAB\xBB!-#\x27()*,.:;?\[\]`{|}]*+"""
_QUOTES = "“”„‘’…"


def _raw(text: str) -> str:
    """SQL for the words of a text; the first and the last are empty where it begins or ends with a separator."""
    quoted = " or ".join(f"contains({text}, '{q}')" for q in _QUOTES)
    return f"split(if({quoted}, translate({text}, '{_QUOTES}', '{' ' * len(_QUOTES)}'), coalesce({text}, '')), r'{_SEPARATOR}', -1)"


def _one_of(words: list[str], value: str) -> str:
    return f"{value} in ({', '.join(f"'{w}'" for w in words)})"


def _tokens(raw: str, before: str) -> str:
    """SQL for the template tokens of an array of words that stands after the word before."""
    digit = r"rlike r'\p{Nd}'"
    unit = f"{_one_of(UNITS, 'lower(x)')} and if(i > 0, get({raw}, i - 1), {before}) {digit}"
    return f"transform({raw}, (x, i) -> case when x {digit} then '{NUMBER}' when left(x, 1) != left(lower(x), 1) and not {_one_of(COMMON, 'lower(x)')} then '{NAME}' when {unit} then '{UNIT}' else lower(x) end)"


def _anchor(kind: int, words: str, at: str) -> str:
    """SQL for the hash of the anchor of a kind that begins at a place of an array of word hashes."""
    return f"xxhash64({kind}, {', '.join(f'get({words}, {at} + {d})' for d in _ANCHORS[kind])})"


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, braw, w (literals), t (tokens) and forms (all variants of t) of each item with a word; equal texts are searched once, as the least id."""
    one = benchmark.groupBy("text").agg(F.min("item_id").alias("item_id"))
    sentences = """array_join(transform(split(text, r'[.!?:;"]+[\\x09-\\x0D\\x20\\xA0]+', -1), s -> concat(lower(left(s, 1)), substr(s, 2))), ' . ')"""
    words = one.select("item_id", *[F.expr(f"filter({_raw(c)}, x -> x != '')").alias(n) for n, c in (("braw", "text"), ("blow", f"({sentences})"))]).where("size(braw) > 0")
    formed = words.select("item_id", "braw", F.expr("transform(braw, x -> lower(x))").alias("w"), F.expr(_tokens("braw", "''")).alias("t"), F.expr(_tokens("blow", "''")).alias("low"))
    first = F.when(~F.col("t")[0].isin(NUMBER, *COMMON), F.concat(F.array(F.lit(NAME)), F.expr("slice(t, 2, size(t))"))).otherwise(F.col("t"))
    return formed.select("item_id", "braw", "w", "t", F.array_distinct(F.array("t", "low", first)).alias("forms"))


def _windows(items: DataFrame) -> DataFrame:
    """h (of the anchor), kind, place (of the anchor in the window), item_id, bpos, width, literal and typed (hashes of the whole window) of each window of the items."""
    width = F.least(F.size("w"), F.lit(WINDOW)).alias("width")
    placed = items.select("item_id", "w", "forms", width).select("*", F.expr("explode(sequence(0, size(w) - width)) as bpos"))
    cut = placed.select("item_id", "bpos", "width", F.expr("slice(w, bpos + 1, width)").alias("w"), F.expr("array_distinct(transform(forms, f -> slice(f, bpos + 1, width)))").alias("forms"))
    placeholder = f"in ('{NUMBER}', '{NAME}', '{UNIT}')"
    cut = cut.withColumn("forms", F.expr(f"filter(forms, f -> 2 * size(filter(f, x -> x {placeholder})) <= width)"))
    # Without such a form the words themselves are the only form.
    cut = cut.select("*", F.expr("explode(if(size(forms) > 0, forms, array(w)))").alias("form"), F.expr("xxhash64(transform(w, x -> xxhash64(x)))").alias("literal"), F.expr("transform(forms, f -> xxhash64(transform(f, x -> xxhash64(x))))").alias("typed"))
    kinds = []
    for kind, places in enumerate(_ANCHORS):
        free = " and ".join(f"not form[j + {d}] {placeholder}" for d in places)
        letters = " + ".join(f"length(w[j + {d}])" for d in places)
        kinds.append(f"transform(filter(if(width > {places[-1]}, sequence(0, width - {places[-1] + 1}), cast(array() as array<int>)), j -> {free}), j -> struct({kind} as kind, {letters} as letters, -j as j))")
    best = cut.withColumn("a", F.expr(f"array_max(concat({', '.join(kinds)}))")).withColumn("wh", F.expr("transform(w, x -> xxhash64(x))"))
    h = f"case a.kind {' '.join(f'when {k} then {_anchor(k, "wh", "(-a.j)")}' for k in range(len(_ANCHORS)))} end"
    return best.select(F.expr(h).alias("h"), "a.kind", (-F.col("a.j")).alias("place"), "item_id", "bpos", "width", "literal", "typed").distinct()


def _broadcast(df: DataFrame, bytes: int) -> DataFrame:
    return F.broadcast(df) if bytes <= BROADCAST_BYTES else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not among ids, a written table of one column; rows without an id stay."""
    return docs.join(_broadcast(ids, ids.count() * _ID_BYTES), id_col, "left_anti").select(*docs.columns)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id and the extent of each consistent match of a document with an item."""
    stage = Stage(docs.sparkSession, "decontamination")
    items = stage.put(_items(benchmark.select(benchmark[item_col].alias("item_id"), benchmark[text_col].alias("text"))), "items")
    windows = stage.put(_windows(items), "windows")
    kinds = sorted(r.kind for r in windows.select("kind").distinct().collect()) or [len(_ANCHORS) - 1]  # of five
    blocks = -(-windows.count() * _WINDOW_BYTES // BROADCAST_BYTES) or 1

    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null")
    words = texts.select("doc_id", F.xxhash64("text").alias("own"), F.expr(_raw("text")).alias("raw"))
    hashed = words.select("doc_id", "own", "raw", F.expr("transform(raw, x -> xxhash64(lower(x)))").alias("wh"))
    every = hashed.select("*", F.expr(f"explode(sequence(0, {len(kinds)} * size(raw) - 1)) as k"))
    placed = every.select("doc_id", "own", "raw", "wh", F.expr(f"cast(k div {len(kinds)} as int)").alias("pos"), F.expr(f"k % {len(kinds)}").alias("nth"))
    probes = placed.select("doc_id", "own", "raw", "wh", "pos", F.expr(f"case nth {' '.join(f'when {n} then {_anchor(k, "wh", "pos")}' for n, k in enumerate(kinds))} end").alias("h"))

    def met(block: int) -> DataFrame:
        mine = [x.where(F.pmod("h", F.lit(blocks)) == block) if blocks > 1 else x for x in (probes, windows.drop("kind"))]
        near = mine[0].join(F.broadcast(mine[1]), "h").withColumn("start", F.col("pos") - F.col("place")).where("start >= 0 and start + width <= size(raw)")
        # Only slices leave the join, which has to stay one generated loop: a row for each place of a text would hold the text.
        near = near.select("doc_id", "own", "item_id", "bpos", "literal", "typed", (F.col("start") - F.col("bpos")).alias("shift"), F.expr("slice(raw, start + 1, width)").alias("words"), F.expr("if(start > 0, get(raw, start - 1), '')").alias("before"), F.expr("cast(get(raw, 0) = '' as int)").alias("lead"), F.expr("xxhash64(slice(wh, start + 1, width)) as found"))
        same = F.expr(f"found = literal or array_contains(typed, xxhash64(transform({_tokens('words', 'before')}, x -> xxhash64(x))))")
        kept = F.when(same, F.array(F.transform("words", F.lower))).otherwise(F.array().cast("array<array<string>>"))
        return near.select("doc_id", "own", "item_id", "shift", "bpos", "lead", F.explode(kept).alias("words"))  # a filter would be pushed into the join

    hits = reduce(DataFrame.unionByName, [met(b) for b in range(blocks)])
    grouped = hits.groupBy("doc_id", "own", "item_id", "shift").agg(F.collect_set(F.struct("bpos", "words")).alias("at"), F.max("lead").alias("lead"))  # an item's windows at most
    item_bytes = items.agg(F.coalesce(F.sum(F.expr("aggregate(braw, 64L, (n, x) -> n + 2 * (octet_length(x) + 16))")), F.lit(0))).first()[0]
    joined = grouped.join(_broadcast(items.select("item_id", "t", "braw"), item_bytes), "item_id")
    covered = joined.withColumn("covered", F.expr("array_sort(array_distinct(flatten(transform(at, x -> transform(x.words, (d, j) -> struct(x.bpos + j as p, d as d))))))"))
    slots = covered.withColumn("slots", F.expr(f"array_distinct(transform(filter(covered, c -> get(t, c.p) in ('{NUMBER}', '{NAME}', '{UNIT}')), c -> struct(lower(get(braw, c.p)) as b, c.d as d)))"))
    measured = slots.select(
        "doc_id", "item_id", (F.col("covered")[0]["p"] + F.col("shift") - F.col("lead")).cast("int").alias("start_word"), F.size("covered").alias("matched_words"), F.size("t").alias("item_words"), F.size("slots").alias("slots"),
        F.expr("size(slots) - size(array_distinct(transform(slots, x -> x.b)))").alias("conflicts"), F.expr("size(filter(slots, x -> not x.b <=> x.d))").alias("changed_slots"),
    )
    good = measured.where(((F.col("matched_words") >= LONG_MATCH) | (2 * F.col("matched_words") >= F.col("item_words"))) & (5 * F.col("conflicts") <= F.col("slots")))
    fields = ["matched_words", "start_word", "item_words", "slots", "conflicts", "changed_slots"]
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(*fields)).alias("m"))
    return best.select("doc_id", "item_id", *[F.col(f"m.{c}").alias(c) for c in fields])


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that match no item."""
    stage = Stage(docs.sparkSession, "decontaminated")
    ids = stage.put(matches(docs, base_columns(benchmark, "item_id", "text"), id_col).select(F.col("doc_id").alias(id_col)).distinct(), "ids")
    return without(docs, ids, id_col)
