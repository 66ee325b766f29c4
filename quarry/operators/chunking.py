"""Splitting documents into retrieval chunks of bounded size, with byte offsets, symbols and heading paths.

One ordered pass over each text, hence Python in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of text kinds that are not code, and languages by extension.
PROSE = "txt text log rst srt vtt tex org adoc".split()
MARKDOWN = "md markdown mdx".split()
DATA = "json jsonc csv tsv yaml yml toml ini cfg conf xml env properties".split()
LANGUAGES = {
    "rust": "rs", "python": "py pyw pyi", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts tsx", "csharp": "cs", "java": "java", "kotlin": "kt kts", "go": "go", "c": "c h",
    "cpp": "cc cpp cxx hpp hh hxx", "swift": "swift", "php": "php", "ruby": "rb", "lua": "lua", "sql": "sql", "shell": "sh bash zsh", "powershell": "ps1 psm1 psd1", "batch": "bat cmd",
    "html": "html htm vue svelte", "css": "css scss less",
}
_KINDS = {e: "prose" for e in PROSE} | {e: "markdown" for e in MARKDOWN} | {e: "data" for e in DATA} | {e: f"code:{n}" for n, es in LANGUAGES.items() for e in es.split()}
DDL = "item_id long, ordinal int, kind string, start long, end long, tokens int, symbol string, context string, text string"


def kind_of(extension: Column) -> Column:
    """prose, markdown, data or code:<language> of an extension; null if its files aren't plain text."""
    pairs = [F.lit(x) for kv in _KINDS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(extension))


@dataclass(frozen=True)
class Span:
    """Characters start to end of a text; spans of different groups never share a chunk."""

    start: int
    end: int
    group: int = 0
    context: str | None = None
    symbol: str | None = None


@dataclass(frozen=True)
class Limits:
    target: int = 128
    most: int = 192
    overlap_lines: int = 2


_COSTLY = re.compile(r"[^\W_]+|[^\w\s]|_")
_RUN, _VISIBLE = re.compile(r"[^\W_]+"), re.compile(r"[^\w\s]|_")
_PARAGRAPH, _SENTENCE, _LINE = re.compile(r"\n[^\S\n]*(?=\n)"), re.compile(r"[.!?…](?=\s|$)|\n"), re.compile(r"\n")
_WORD = re.compile(r"\S+")
_HEADING, _FENCE = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\s*(```+|~~~+)")
_CLOSER = re.compile(r"[})\]]|end\b|</|fi\b|done\b|esac\b|elif\b|else\b|except\b|finally\b|catch\b")
_MODIFIER = r"pub(?:\([a-z]+\))?|async|export|default|public|private|protected|static|final|abstract|override|unsafe|virtual|sealed|partial|readonly|data|open|internal|local|inline|extern(?:\s+\"[^\"]*\")?|declare|const(?=\s+(?:unsafe\s+|async\s+|extern\s+)*(?:fn|enum)\b)"
_DEFINITION = re.compile(
    rf"^\s*(?:(?:{_MODIFIER})\s+)*"
    r"(?:fn|def|class|struct|enum|union|trait|impl|mod|macro_rules!|function|func|interface|type|object|record|namespace|module|fun|protocol|extension|sub)(?:\b|(?<=!))\s*(?:<[^>]*>\s*)?(?:\([^)]*\)\s*)?\*?\s*([A-Za-z_$][\w$]*(?:(?:::|\.)[\w$]+)*)"
)
_ARROW = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>)")
_COMMENT = re.compile(r"\s*(?:#(?!\[)|//|/\*|\*|--|;|@|#\[|$)")
_CREATE = re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:unique\s+)?(?:table|view|index|function|procedure|trigger|type|schema)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", re.I)


def count_tokens(text: str) -> int:
    """Letters and digits cost one for each five begun in a run, other visible characters one."""
    return sum(-(-len(m) // 5) for m in _RUN.findall(text)) + len(_VISIBLE.findall(text))


class Chunker:
    def __init__(self, text: str, limits: Limits):
        self.text, self.limits = text, limits
        found = [(m.start(), m.end()) for m in _COSTLY.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self.before = [0, *accumulate(-(-(b - a) // 5) for a, b in found)]

    def size(self, a: int, b: int) -> int:
        """Tokens between two characters, by sums over the whole text; a run that is cut is counted anew."""
        i, j = bisect_left(self.starts, a), bisect_left(self.starts, b)
        if (i and self.ends[i - 1] > a) or (j and self.ends[j - 1] > b):
            return count_tokens(self.text[a:b])
        return self.before[j] - self.before[i]

    def trimmed(self, s: Span) -> Span | None:
        body = self.text[s.start : s.end]
        left = len(body) - len(body.lstrip())
        return replace(s, start=s.start + left, end=s.start + len(body.rstrip())) if body.strip() else None

    def pieces(self, s: Span, at: re.Pattern) -> Iterator[Span]:
        start = s.start
        for m in at.finditer(self.text, s.start, s.end):
            yield replace(s, start=start, end=m.end())
            start = m.end()
        yield replace(s, start=start, end=s.end)

    def fitting(self, s: Span, *levels: re.Pattern) -> Iterator[Span]:
        """Parts of s of at most the largest size: the span itself, or its pieces by the first level that divides it, and so on."""
        whole = self.trimmed(s)
        if whole is None:
            return
        if self.size(whole.start, whole.end) <= self.limits.most:
            yield whole
            return
        for k, level in enumerate(levels):
            parts = [p for p in map(self.trimmed, self.pieces(whole, level)) if p]
            if len(parts) > 1:
                for p in parts:
                    yield from self.fitting(p, *levels[k + 1 :])
                return
        yield from self.words(whole)

    def words(self, s: Span) -> Iterator[Span]:
        """Runs of whole words up to the largest size; a longer word is cut between characters."""
        start = end = None
        for m in _WORD.finditer(self.text, s.start, s.end):
            if start is not None and self.size(start, m.end()) > self.limits.most:
                yield replace(s, start=start, end=end)
                start = None
            if start is None and self.size(m.start(), m.end()) > self.limits.most:
                step = self.limits.most  # a character costs one at most
                yield from (replace(s, start=a, end=min(a + step, m.end())) for a in range(m.start(), m.end(), step))
                continue
            start, end = m.start() if start is None else start, m.end()
        if start is not None:
            yield replace(s, start=start, end=end)

    def prose(self, s: Span) -> Iterator[Span]:
        for p in self.pieces(s, _PARAGRAPH):
            yield from self.fitting(p, _SENTENCE)

    def data(self, s: Span) -> Iterator[Span]:
        for line in self.pieces(s, _LINE):
            yield from self.fitting(line)

    def markdown(self) -> Iterator[Span]:
        """Sections from heading to heading; a section of headings only joins the next; fenced blocks stay whole where they fit."""
        path: list[tuple[int, str]] = []
        group, fence, begin, fenced_at, body = 0, None, 0, None, False
        parts: list[tuple[Span, bool]] = []

        def close(end: int, fenced: bool = False) -> None:
            if end > begin:
                parts.append((Span(begin, end, group, " › ".join(t for _, t in path) or None), fenced))

        at = 0
        for line in self.text.splitlines(keepends=True):
            mark = _FENCE.match(line)
            heading = None if fence else _HEADING.match(line)
            if fence:
                if mark and mark[1].startswith(fence):
                    begin = fenced_at
                    close(at + len(line), True)
                    begin, fence = at + len(line), None
            elif mark:
                close(at)
                fence, fenced_at, begin, body = mark[1][:3], at, at, True
            elif heading:
                if body:
                    close(at)
                    group, begin, body = group + 1, at, False
                level = len(heading[1])
                path = [p for p in path if p[0] < level] + [(level, heading[2])]
            elif line.strip():
                body = True
            at += len(line)
        close(at)
        for s, fenced in parts:
            yield from self.fitting(s, _LINE) if fenced else self.prose(s)

    def code(self) -> Iterator[Span]:
        """Blocks that begin at the least indent; larger ones are cut at deeper indents, then in line windows that overlap."""
        yield from self.block(Span(0, len(self.text)), 0)

    def block(self, s: Span, depth: int) -> Iterator[Span]:
        lines = [p for p in self.pieces(s, _LINE) if p.end > p.start]
        bodies = [self.text[p.start : p.end] for p in lines]
        indents = [len(b) - len(b.lstrip()) for b in bodies if b.strip()]
        if not indents:
            return
        base, starts = min(indents), [0]
        for k, b in enumerate(bodies):
            opens = b.strip() and len(b) - len(b.lstrip()) == base and not _CLOSER.match(b.strip())
            if k and opens and (not bodies[k - 1].strip() or len(bodies[k - 1]) - len(bodies[k - 1].lstrip()) > base or _CLOSER.match(bodies[k - 1].strip())):
                starts.append(k)
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            whole = self.trimmed(Span(lines[a].start, lines[b - 1].end, s.group, s.context))
            if whole is None:
                continue
            symbol = symbol_of(self.text[whole.start : whole.end])
            if self.size(whole.start, whole.end) <= self.limits.most:
                yield replace(whole, symbol=symbol)
            elif depth < 4 and len(starts) > 1:
                yield from self.block(replace(whole, context=symbol or s.context), depth + 1)
            else:
                yield from self.windows(replace(whole, symbol=symbol, context=symbol or s.context))

    def windows(self, s: Span) -> Iterator[Span]:
        lines = [p for p in self.pieces(s, _LINE) if p.end > p.start]
        a = 0
        while a < len(lines):
            b = a + 1
            while b < len(lines) and self.size(lines[a].start, lines[b].end) <= self.limits.most:
                b += 1
            part = self.trimmed(replace(s, start=lines[a].start, end=lines[b - 1].end))
            if part:
                yield from self.fitting(part)
            if b >= len(lines):
                return
            a = max(a + 1, b - self.limits.overlap_lines)

    def packed(self, spans: Iterator[Span]) -> Iterator[Span]:
        """Neighbours of one group put together up to the target; definitions stay apart unless the first is small."""
        held: Span | None = None
        for s in spans:
            if held is not None:
                named = held.symbol and s.symbol and held.symbol != s.symbol and self.size(held.start, held.end) > self.limits.target // 4
                if held.group == s.group and s.start >= held.end and not named and self.size(held.start, s.end) <= self.limits.target:
                    held = replace(held, end=s.end, symbol=held.symbol or s.symbol)
                    continue
                yield held
            held = s
        if held is not None:
            yield held


def symbol_of(region: str) -> str | None:
    """What the first lines of a region define; comments, attributes and empty lines before it don't count."""
    lines = [line for line in region.splitlines() if not _COMMENT.match(line)]
    for line in lines[:6]:
        for pattern in (_DEFINITION, _ARROW, _CREATE):
            if m := pattern.match(line):
                return m[1].strip('"`')
    return None


def chunks(text: str, kind: str, limits: Limits = Limits()) -> list[Span]:
    c = Chunker(text, limits)
    spans = c.markdown() if kind == "markdown" else c.code() if kind.startswith("code") else c.data(Span(0, len(text))) if kind == "data" else c.prose(Span(0, len(text)))
    return list(c.packed(spans))


def chunk(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """items: item_id, kind, text. A row for each chunk, with byte offsets into the text."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, kind, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "kind", "text"))):
                at = size = 0
                for k, s in enumerate(chunks(text or "", kind or "prose", limits)):
                    if s.start < at:
                        at = size = 0
                    size += len(text[at : s.start].encode())
                    body = text[s.start : s.end]
                    end = size + len(body.encode())
                    rows.append((item, k, "code" if (kind or "").startswith("code") else "text", size, end, count_tokens(body), s.symbol, s.context, body))
                    at, size = s.end, end
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            names = ("item_id", "ordinal", "kind", "start", "end", "tokens", "symbol", "context", "text")
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    return items.select(F.col("item_id").cast("long"), "kind", "text").mapInArrow(run, DDL)


def changed(items: DataFrame, extractor: int) -> DataFrame:
    """Items whose content has to be read: never read, failed, by an older extractor, or with another fingerprint; not those stored elsewhere."""
    print_now = F.concat(F.coalesce(F.col("size").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("modified").cast("string"), F.lit("")))
    due = F.col("content_state").isNull() | (F.col("content_state") == "failed") | ~F.col("extractor").eqNullSafe(F.lit(extractor)) | ~F.col("fingerprint").eqNullSafe(print_now)
    return items.where((F.col("kind") == "file") & due & (F.col("attributes").bitwiseAND(4) == 0) & (F.col("status") != "error"))


def replaced(chunks_now: DataFrame, new: DataFrame, items: DataFrame) -> DataFrame:
    """The chunk table with those of items (item_id) replaced by new ones."""
    return chunks_now.join(items.select("item_id"), "item_id", "left_anti").unionByName(new)
