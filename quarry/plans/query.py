"""The query mini-language: text, quoted phrases and hard filters; full-text terms of its text.

Parsing is plain Python on the driver: a batch of queries becomes typed columns of a small DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import fold_text, tokens_text

DAY_MS = 86_400_000
MAX_FILTERS, MIN_PREFIX, PAIR_TERMS = 16, 3, 6
#: Extensions of each file category.
CATEGORIES = {
    "document": "txt md markdown pdf doc docx odt rtf csv xls xlsx ppt pptx".split(),
    "image": "jpg jpeg png gif bmp webp tif tiff heic avif svg".split(),
    "audio": "mp3 wav flac aac ogg m4a wma opus".split(),
    "video": "mp4 mkv avi mov wmv webm m4v mpeg mpg".split(),
    "code": "rs py js jsx ts tsx c h cpp hpp cs java go rb php swift kt kts sh ps1 sql html css scss vue svelte".split(),
}
KINDS = {"file": "file", "folder": "folder", "app": "application", "application": "application"}
#: Function words that content queries leave out.
STOPWORDS = frozenset(
    """a an and are as at be but by can did do does for from had has have how i if in into is it its me my no not of on or
    our so that the their them there this to too us was we were what when where which who why will with you your al como
    con cuando de del donde el en es esta este esto hay la las le les lo los mi mis muy ni nos o para pero por que se si
    sin sobre su sus te tu un una uno unos unas y ya""".split()
)
_TOKEN = re.compile(r'(?:[^\s"]|"[^"]*(?:"|$))+')
_OPERATOR = re.compile(r"(type|ext|in|before|after):(.*)", re.I | re.A | re.S)


@dataclass(frozen=True)
class Filter:
    op: str  # kind, category, ext, in, before, after
    value: str | int


@dataclass
class Query:
    text: str
    filters: list[Filter] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    valid: bool = True

    @property
    def reads_content(self) -> bool:
        """Folders and applications have no passages."""
        return not any(f.op == "kind" and f.value != "file" for f in self.filters)


def day(value: str) -> int | None:
    """The start of a strict ISO day in epoch milliseconds."""
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
        return None
    try:
        return int(datetime.combine(date.fromisoformat(value), datetime.min.time(), UTC).timestamp()) * 1000
    except ValueError:
        return None


def _filter(op: str, value: str) -> Filter | None:
    low = value.lower()
    if op == "type":
        return Filter("kind", KINDS[low]) if low in KINDS else Filter("category", low) if low in CATEGORIES else None
    if op == "ext":
        bare = value.removeprefix(".")
        return Filter("ext", bare.lower()) if bare.isalnum() else None
    if op == "in":
        path = low.replace("\\", "/")
        path = path if path == "/" else path.rstrip("/")
        return Filter("in", path) if path and '"' not in path and not {".", ".."} & set(path.split("/")) else None
    at = day(value)
    return None if at is None else Filter(op, at + (DAY_MS if op == "after" else 0))


def parse(text: str) -> Query:
    """Text with its filters and phrases taken out; a malformed filter makes the query invalid."""
    query, words, filtered = Query(text), [], False
    if not set(text) & {":", '"'}:
        return query
    for token in _TOKEN.findall(text):
        if m := _OPERATOR.fullmatch(token):
            filtered, raw = True, m[2]
            if raw.startswith('"'):
                raw = raw[1:-1] if len(raw) > 1 and raw.endswith('"') else ""
            found = _filter(m[1].lower(), raw) if raw else None
            if found and len(query.filters) < MAX_FILTERS:
                query.filters.append(found)
            else:
                query.valid = False
        else:
            words.append(token)
            query.phrases += [p for p in re.findall(r'"([^"]*)"', token) if p.strip()]
    if filtered:
        query.text = " ".join(words) + (" " if text[-1:].isspace() else "")
    return query


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool = False


def _clean(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text).split()


def terms(text: str, typing: bool = False) -> list[Term]:
    """Words and phrases; while typing, a last bare word of three characters up is a prefix and a shorter one waits."""
    pieces = text.split('"')
    quoted = [k % 2 == 1 and k < len(pieces) - 1 for k in range(len(pieces))]
    out: list[tuple[Term, bool]] = []
    for piece, phrase in zip(pieces, quoted):
        words = _clean(piece)
        if phrase:
            out += [(Term(tuple(words)), False)] if words else []
        else:
            out += [(Term((w,)), True) for w in words]
    if typing and out and out[-1][1] and not text[-1:].isspace():
        last = out.pop()[0]
        if len(last.words[0]) >= MIN_PREFIX:
            out.append((Term(last.words, True), True))
    return [t for t, _ in out]


def content_terms(text: str, typing: bool = False) -> list[Term]:
    """Terms without function words, unless nothing else is there."""
    every = terms(text, typing)
    return [t for t in every if " ".join(t.words).lower() not in STOPWORDS] or every


def pair_terms(text: str, typing: bool = False) -> list[Term]:
    """The terms of which any two have to match: the first six of three or more, else none."""
    found = content_terms(text, typing)
    return found[:PAIR_TERMS] if len(found) >= 3 else []


def name_batch(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """query_id, key, tokens, phrases of the queries that have searchable text."""
    rows = []
    for i, text in texts.items():
        q = parse(text)
        key, tokens = fold_text(q.text.replace('"', " ")), tokens_text(q.text)
        if q.valid and key and tokens:
            rows.append((i, key, tokens, [tokens_text(p) for p in q.phrases]))
    return spark.createDataFrame(rows, "query_id string, key string, tokens array<string>, phrases array<array<string>>")


def term_batch(spark: SparkSession, texts: dict[str, str], typing: bool = False, pairs: bool = False) -> DataFrame:
    """query_id, term, words, prefix, n_terms: the full-text terms of content queries."""
    rows = []
    for i, text in texts.items():
        q = parse(text)
        found = (pair_terms if pairs else content_terms)(q.text, typing) if q.valid and q.reads_content else []
        rows += [(i, k, [fold_text(w) for w in t.words], t.prefix, len(found)) for k, t in enumerate(found)]
    return spark.createDataFrame(rows, "query_id string, term int, words array<string>, prefix boolean, n_terms int")


def condition(filters: list[Filter], kind: Column, extension: Column, path: Column, modified: Column) -> Column:
    """All filters as one predicate; it comes before any ranking or limit."""
    out = F.lit(True)
    ext = F.lower(extension)
    for f in filters:
        if f.op == "kind":
            out &= kind == f.value
        elif f.op == "category":
            out &= (kind == "file") & ext.isin(*CATEGORIES[f.value])
        elif f.op == "ext":
            out &= (kind == "file") & (ext == f.value)
        elif f.op == "before":
            out &= modified < f.value
        elif f.op == "after":
            out &= modified >= f.value
        else:
            out &= inside(path, str(f.value), kind)
    return F.coalesce(out, F.lit(False))


def inside(path: Column, folder: str, kind: Column) -> Column:
    """An absolute folder itself or below it; or contiguous folder names anywhere, where a file's own name doesn't count."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    if folder.startswith("/") or re.match(r"[a-z]:", folder):
        return (low == folder) | low.startswith(folder if folder.endswith("/") else folder + "/")
    folders = F.when(kind == "folder", F.concat(low, F.lit("/"))).otherwise(F.regexp_replace(low, "[^/]*$", ""))
    return F.instr(F.concat(F.lit("/"), folders), f"/{folder}/") > 0
