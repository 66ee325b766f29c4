"""Text functions: JVM expressions wherever they can express the semantics, Arrow UDFs for full Unicode and edit distance."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _bare(s: str) -> str:
    """Compatibility decomposition without marks, in lower case, with one small sigma."""
    kept = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c)[0] != "M")
    return "".join(c.lower() for c in kept).replace("ς", "σ")


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Lower-case characters that fold to one other character, what they fold to, and those that fold to several; Hangul stays composed."""
    one, many = {}, {}
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(code)
        if not 0xD800 <= code < 0xE000 and c == c.lower() and unicodedata.category(c)[0] != "M" and (to := _bare(c)) != c:
            if len(to) == 1:
                one[c] = to
            elif to:
                many[c] = to
    return "".join(one), "".join(one.values()), many


def _ranges(characters) -> str:
    """A pattern's class of some characters, as ranges."""
    codes = sorted(map(ord, characters))
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


def fold_characters(c: Column) -> Column:
    """Characters of a search key by JVM expressions, in any script; plain ASCII only changes case."""
    low, (one, to, many) = F.lower(c), _tables()
    single = F.regexp_replace(F.translate(low, one, to), r"\p{M}+", "")
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in many.items())), F.lit("\x01"), F.lit("\x02"))
    several = F.array_join(F.transform(F.split(single, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    # Rare, so that most rows need no look at single characters; a long class is slow, so that a short one goes first.
    rare = single.rlike(r"[^\x00-\xBB\xBF-\xFF]") & single.rlike(_ranges(many)) | single.rlike(r"[\xBC-\xBE]")
    return F.when(F.length(c) == F.octet_length(c), low).when(rare, several).otherwise(single)


def fold_key(c: Column) -> Column:
    """Search key by JVM expressions: folded characters, white space collapsed."""
    return F.trim(F.regexp_replace(fold_characters(c), _BLANKS, " "))


def fold_text(s: str | None) -> str | None:
    """The same search key of a string on the driver."""
    if s is None:
        return None
    composed = "".join(c if 0xAC00 <= ord(c) < 0xD7A4 else _bare(c) for c in unicodedata.normalize("NFC", s))
    return " ".join(composed.split())


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


_LOWER = r"[\p{L}&&[^\p{Lu}]]"


def code_tokens(c: Column) -> Column:
    """Tokens of a name by JVM expressions: splits at what is neither letter nor number, at aB, ABc, a1 and 1a, in any script."""
    c = F.when(F.length(c) == F.octet_length(c), c).otherwise(F.regexp_replace(F.regexp_replace(c, r"(?<=\p{L})\p{M}+", ""), r"\p{M}+", " "))
    for pattern in (rf"({_LOWER})(\p{{Lu}})", rf"(\p{{Lu}})(\p{{Lu}}{_LOWER})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        c = F.regexp_replace(c, pattern, "$1 $2")
    return F.filter(F.split(fold_characters(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


def _kind(c: str) -> str:
    return "digit" if c.isnumeric() else "upper" if c.isupper() else "lower" if c.isalpha() else ""


def tokens_text(s: str | None) -> list[str]:
    """Tokens of a name in any script: runs of one kind, where an upper-case run gives its last letter to a lower-case run after it."""
    out: list[str] = []
    runs = [(k, "".join(g)) for k, g in groupby(unicodedata.normalize("NFC", s or ""), _kind)]
    carried = ""
    for n, (kind, run) in enumerate(runs):
        after = runs[n + 1][0] if n + 1 < len(runs) else ""
        if kind == "upper" and after == "lower":
            out.append(run[:-1])
            carried = run[-1]
        elif kind:
            out.append(carried + run)
            carried = ""
    return [t for t in map(fold_text, out) if t]


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(s: pd.Series) -> pd.Series:
    return s.map(tokens_text)


def stem(name: Column) -> Column:
    """A name without an extension of letters or digits of at most five bytes."""
    short = F.octet_length(F.regexp_extract(name, r"\.([\p{L}\p{N}]{0,5})$", 1)) <= 5
    return F.when(name.rlike(r"(?s)^.+\.[\p{L}\p{N}]{0,5}$") & short, F.regexp_replace(name, r"\.[\p{L}\p{N}]{0,5}$", "")).otherwise(name)


def name_parts(name: Column) -> Column:
    """Tokens of a name, the whole words they come from, and the initials of a stem of two or more words."""
    words = F.filter(F.split(fold_key(name), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    alphabetic = F.filter(code_tokens(stem(name)), lambda x: x.rlike(r"^\p{L}"))
    initials = F.when(F.size(alphabetic) >= 2, F.array(F.array_join(F.transform(alphabetic, lambda x: F.substring(x, 1, 1)), ""))).otherwise(F.array().cast("array<string>"))
    own = code_tokens(name)
    more = F.array_except(F.array_union(words, initials), own)
    return F.concat(own, more)


def path_tokens(path: Column, segments: int = 3) -> Column:
    """Tokens of the last parent folders of a path; drives don't count."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda x: (x != "") & ~x.endswith(":"))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    near = F.slice(folders, F.greatest(F.size(folders) - segments + 1, F.lit(1)), segments)
    return F.flatten(F.transform(near, code_tokens))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, part, F.lit(1))


def typo_budget(chars: Column) -> Column:
    return F.when(chars <= 3, 0).when(chars <= 7, 1).otherwise(2)


def osa(a: str, b: str, most: int) -> int | None:
    """Optimal string alignment distance, or None beyond `most`: cells off the diagonal band are not visited."""
    if abs(len(a) - len(b)) > most:
        return None
    far = most + 1
    two: dict[int, int] = {}
    one = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[0] = i
                continue
            cost = min(one.get(j, far) + 1, row.get(j - 1, far) + 1, one.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, two.get(j - 2, far) + 1)
            row[j] = min(cost, far)
        two, one = one, row
    found = one.get(len(b), far)
    return found if found <= most else None


@F.pandas_udf(T.IntegerType())
def typo_distance(key: pd.Series, candidates: pd.Series, most: pd.Series) -> pd.Series:
    """Least distance of a key from any candidate or a candidate's beginning of one more character; null beyond the budget."""

    def least(k: str, found, budget: int) -> int | None:
        best = None
        for c in found if budget > 0 else ():
            if len(c.encode()) + budget < len(k.encode()):
                continue
            d = osa(k, c, budget)
            if d is None and len(c) > len(k) + 1:
                d = osa(k, c[: len(k) + 1], budget)
            best = d if best is None or (d is not None and d < best) else best
        return best

    return pd.Series([least(*x) for x in zip(key, candidates, most)], dtype="Int32")


def search_terms(text: Column) -> Column:
    """Full-text terms: folded runs of letters and digits."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.array_remove(F.when(ascii_only, F.split(F.lower(text), "[^a-z0-9]+")).otherwise(F.split(fold_characters(text), r"[^\p{L}\p{N}]+")), "")


def estimate_tokens(text: Column) -> Column:
    """Model tokens without a tokenizer: one for each five letters or digits begun, one for any other visible character."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    other = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    return F.aggregate(runs, F.lit(0), lambda n, r: n + F.ceil(F.length(r) / 5).cast("int")) + other


def one_line(text: Column, chars: int = 160) -> Column:
    """The first characters on one line, with an ellipsis where there may be more."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) >= chars, F.concat(F.substring(flat, 1, chars), F.lit("…"))).otherwise(flat)


def fingerprint(size: Column, modified: Column) -> Column:
    return F.concat(F.coalesce(size.cast("string"), F.lit("")), F.lit(":"), F.coalesce(modified.cast("string"), F.lit("")))


def query_prompt(text: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), text)


def document_prompt(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("none")), F.lit(" | text: "), text)


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def extension(value: Column) -> Column:
    """A literal extension in lower case without its dot, or null if it can't be one."""
    bare = F.regexp_replace(F.trim(value), r"^\.", "")
    return F.when((bare != "") & (F.octet_length(bare) <= 255) & ~bare.rlike(r'[\p{Cc}\s./\\:*?"<>|]'), F.lower(bare))
