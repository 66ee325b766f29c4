"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a predicate over values of the text that is true for a document to reject. On a bounded sample the time of
each value and the rejections of each rule are measured; the cascade takes next, again and again, the rule that rejects most
of the documents left per second of the values that aren't known yet. It is one nested expression: a value
is computed where its first rule needs it, at most once for a document, and not at all for a document that an earlier rule
rejects. The order changes the work, never the verdict.

Null texts have no words and are rejected by the word count. Empty tables give no rows (and the declared
order), repeated rows are each judged, extra columns are kept by `keep` and ignored elsewhere. Work
on a text of n words is of order n log n.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes value once and uses it as a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(ws: str) -> str:
    """SQL for the number of words in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes: where any two are equal, they are sorted with their positions; then each repeated window adds the words that the one before it doesn't cover.
    """
    hashes = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))"
    places = "array_sort(transform(filter(p, (x, k) -> x.h <=> get(p, k - 1).h or x.h <=> get(p, k + 1).h), x -> x.i))"
    covered = "aggregate(transform(q, (x, k) -> if(k + 1 < size(q), least(3, get(q, k + 1) - x), 3)), 0L, (a, x) -> a + x)"
    pairs = "array_sort(transform(h, (x, i) -> struct(x as h, i as i)))"
    exact = _let(pairs, "p", _let(places, "q", covered))
    return _let(ws, "w", _let(hashes, "h", f"if(size(array_distinct(h)) < size(h), {exact}, 0L)"))


def _count(characters: str) -> str:
    """SQL for the number of characters of a class."""
    return f"cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), r'{characters}', '')) as bigint)"


_BARE = r"trim(BOTH '\u0009\u000A\u000B\u000C\u000D\u0020' FROM coalesce(text, ''))"
#: Values by name, in SQL over the text and other values in braces; each is computed where a rule or the caller asks for it.
VALUES = {
    "words": _let(_BARE, "t", f"if(t = '', cast(array() as array<string>), split(t, r'{GAP}', -1))"),
    "lines": rf"filter(split(coalesce(text, ''), '\n', -1), l -> l rlike r'{WORD}')",
    "n_words": "cast(size({words}) as bigint)",
    "word_chars": "cast(length(array_join({words}, '')) as bigint)",
    "n_symbols": _count("[#*$%&|<>]+"),
    "n_lines": "cast(size({lines}) as bigint)",
    "n_dup_lines": "cast(size({lines}) - size(array_distinct({lines})) as bigint)",
    "n_repeat_words": repeat_words("{words}"),
    "n_upper": _count("[A-Z]+"),
    "n_letters": _count("[A-Za-z]+"),
    "n_marks": _count("[!?]+"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document is rejected where the predicate over values holds."""

    name: str
    reject: str


#: What is common in junk and far from prose in any of the languages.
RULES = (
    Rule("few_words", "{n_words} < 50"),
    Rule("repeats", "100 * {n_repeat_words} > 50 * {n_words}"),
    Rule("symbols", "5 * {n_symbols} > {n_words}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} or {word_chars} > 15 * {n_words}"),
    Rule("duplicate_lines", "2 * {n_dup_lines} > {n_lines}"),
    Rule("capitals", "2 * {n_upper} > {n_letters} and {n_letters} > 0"),
    Rule("marks", "3 * {n_marks} > {n_words}"),
)


def needs(template: str, known: tuple[str, ...] = ()) -> list[str]:
    """The values of a template that aren't known, each after those it needs itself."""
    out: list[str] = []
    for name in re.findall(r"{(\w+)}", template):
        if name not in known:
            out += [v for v in [*needs(VALUES[name], known), name] if v not in out]
    return out


def cascade(rules: list[Rule], known: tuple[str, ...] = ()) -> str:
    """SQL for the name of the first rule that rejects, or null. Known values are columns; later rules and their values are not evaluated."""

    def build(k: int, names: dict[str, str]) -> str:
        if k == len(rules):
            return "cast(null as string)"
        new = needs(rules[k].reject, tuple(names))
        inner = names | {v: f"q_{v}" for v in new}
        out = f"case when {rules[k].reject.format_map(inner)} then '{rules[k].name}' else {build(k + 1, inner)} end"
        for v in reversed(new):
            out = _let(VALUES[v].format_map(inner), f"q_{v}", out)
        return out

    return build(0, {v: v for v in known})


def _spread_sample(docs: DataFrame, rows: int, files: int = 16) -> DataFrame:
    """Some rows of up to `files` files that lie evenly among the table's."""
    paths = sorted(docs.inputFiles())
    if len(paths) < 2 or "_metadata" in docs.columns:
        return docs.select("text").limit(rows)
    chosen = [paths[k * len(paths) // min(files, len(paths))] for k in range(min(files, len(paths)))]
    try:
        parts = [docs.where(F.col("_metadata.file_path") == path).select("text").limit(-(-rows // len(chosen))) for path in chosen]
        parts[0].schema
    except Exception:  # rows that don't come straight from files
        return docs.select("text").limit(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.limit(rows)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = (), sample_rows: int = 500, rounds: int = 3) -> tuple[dict[str, float], Counter]:
    """Seconds of each unknown value on a sample, the least of some rounds, and how many of its rows each set of rules rejects."""
    texts = _spread_sample(docs, sample_rows).coalesce(1)
    shared = ("words", "lines")
    sample = texts.select("text", *[F.expr(VALUES[v]).alias(v) for v in shared]).cache()
    try:
        bits = [F.expr(r.reject.format_map({v: f"({VALUES[v].format_map({x: x for x in shared})})" for v in VALUES if v not in shared})).alias(r.name) for r in rules]
        patterns = Counter({frozenset(r.name for r in rules if row[r.name]): row["count"] for row in sample.select(*bits).groupBy(*[r.name for r in rules]).count().collect()})
        if not patterns:
            return {}, patterns

        def seconds(value: Column) -> float:
            query = sample.agg(F.max(F.xxhash64(value)))
            took = []
            for _ in range(rounds + 1):  # the first compiles
                began = time.perf_counter()
                query.first()
                took.append(time.perf_counter() - began)
            return min(took[1:])

        idle = seconds(F.lit(1))
        wanted = dict.fromkeys(v for r in rules for v in needs(r.reject, known))
        return {v: max(seconds(F.expr(VALUES[v].format_map({x: x for x in VALUES}))) - idle, 1e-4) for v in wanted}, patterns
    finally:
        sample.unpersist()


def order_rules(rules: tuple[Rule, ...], costs: dict[str, float], patterns: Counter, known: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """Rules with the seconds of their values that aren't known by then and the share of the documents left that they reject."""
    have, left, todo, out = set(known), Counter(patterns), list(rules), []
    while todo:
        total = sum(left.values())

        def gain(rule: Rule) -> tuple[float, float]:
            cost = sum(costs.get(v, 0.0) for v in needs(rule.reject, tuple(have))) or 1e-6
            return cost, sum(n for p, n in left.items() if rule.name in p) / total if total else 0.0

        best = max(todo, key=lambda r: (gain(r)[1] / gain(r)[0], -todo.index(r)))
        out.append((best, *gain(best)))
        todo.remove(best)
        have |= set(needs(best.reject, tuple(have)))
        left = Counter({p: n for p, n in left.items() if best.name not in p})
    return out


def _ordered(docs: DataFrame, rules: tuple[Rule, ...], known: tuple[str, ...] = ()) -> list[Rule]:
    return [x[0] for x in order_rules(rules, *measure(docs, rules, known), known)]


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    return docs.where(F.expr(cascade(_ordered(docs, rules))).isNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Every row's base measures, base_failed, kept and the rule that rejects it."""
    known = ("n_words", "word_chars", "n_repeat_words", "n_symbols", "n_lines", "n_dup_lines")
    texts = docs.select(docs[id_col].alias("doc_id"), docs["text"].alias("text"))

    def struct(shared: str, *values: str) -> Column:
        fields = ", ".join(f"{VALUES[v].format_map({shared: 'q'})} as {v}" for v in values)
        return F.expr(_let(VALUES[shared], "q", f"struct({fields})"))

    by = texts.select("doc_id", "text", struct("words", "n_words", "word_chars", "n_repeat_words").alias("m"), struct("lines", "n_lines", "n_dup_lines").alias("l"), F.expr(VALUES["n_symbols"]).alias("n_symbols"))
    measured = by.select("doc_id", "text", "m.*", "l.*", "n_symbols").withColumn("rejected_by", F.expr(cascade(_ordered(docs, rules, known), known)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
