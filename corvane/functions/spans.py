"""Guarded spans: rules with patterns, and guards that look at the text around a match.

A guard can depend on matches that were rejected before it, which lookaround in a pattern cannot express, so matching
runs in Python over Arrow batches. Rows without a candidate do no such work: `prefilter`, an alternation of the rules that the
JVM evaluates, comes along as a flag. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<key:string,dim:string,start:int,end:int,match:string,snippet:string>>"
# How far guards look back and ahead, and how far back an explanation counts.
BEFORE, EMPTY_AFTER, EXCEPTION_AFTER, EXPLAINED_BEFORE = 40, 40, 80, 60
# Characters of a form label, commas of an option list, how far ahead a question mark counts.
LABEL_LINE, OPTION_COMMAS, QUESTION_AFTER = 48, 3, 200


@dataclass(frozen=True)
class Rule:
    """One lexicon row. `not_before` must end at the match, `not_after` must begin right behind it (within `ahead`
    characters), `not_near` may not occur in the `near` characters before the match or in it."""

    key: str
    pattern: str
    dim: str = ""
    not_before: str | None = None
    not_after: str | None = None
    not_near: str | None = None
    near: int = 60
    ahead: int = EMPTY_AFTER
    flags: int = re.IGNORECASE


@dataclass
class Engine:
    rules: Sequence[Rule]
    first_only: bool = True
    exclusive: bool = False
    width: int = 110
    #: Further guards (text, rule, start, end) that refuse a match.
    refuse: Sequence[Callable[[str, Rule, int, int], bool]] = ()
    _ready: list = field(default_factory=list, repr=False)

    def _compiled(self) -> list:
        if not self._ready:
            made = lambda p, r: re.compile(p, r.flags) if p else None
            for r in self.rules:
                before = made(f"(?:{r.not_before})$" if r.not_before else None, r)
                self._ready.append((r, re.compile(r.pattern, r.flags), before, made(r.not_after, r), made(r.not_near, r)))
        return self._ready

    def spans(self, text: str | None) -> list[dict]:
        """Genuine matches in rule order. first_only: one for each key. exclusive: none overlaps another of its dim."""
        found, taken = [], {}
        for rule, pattern, before, after, near in self._compiled() if text else ():
            for m in pattern.finditer(text):
                a, b = m.span()
                if before and before.search(text[max(0, a - BEFORE) : a]):
                    continue
                if after and after.match(text[b : b + rule.ahead]):
                    continue
                if near and near.search(text[max(0, a - rule.near) : b]):
                    continue
                if any(guard(text, rule, a, b) for guard in self.refuse):
                    continue
                if self.exclusive and any(a < y and x < b for x, y in taken.get(rule.dim, ())):
                    continue
                taken.setdefault(rule.dim, []).append((a, b))
                found.append({"key": rule.key, "dim": rule.dim, "start": a, "end": b, "match": m.group(),
                              "snippet": widened(text, a, b, self.width)})
                if self.first_only:
                    break
        return found

    def prefilter(self) -> str:
        return "|".join(f"(?:{r.pattern})" for r in self.rules)


def form_label(text: str, rule: Rule, start: int, end: int) -> bool:
    """The match stands in a printed label: a short line that ends in a colon or begins with a number or letter."""
    line = (text[:start].rpartition("\n")[2] + text[start:end] + text[end:].partition("\n")[0]).strip()
    return len(line) <= LABEL_LINE and (line.endswith(":") or numbered(line))


def numbered(line: str) -> bool:
    """The line begins with `1.`, `1)`, `(1)`, `a.` or `(a)` and a blank (letters up to h)."""
    mark = re.match(r"(\(?)(\w{1,2})(\s?)([.)])\s", line)
    if not mark:
        return False
    opened, name, apart, closed = mark.groups()
    figure, letter = name.isdigit(), len(name) == 1 and name.lower() in "abcdefgh"
    if closed == ".":
        return not opened and (figure or letter)
    return not apart and (figure or (bool(opened) and letter and name.islower()))


def option_list(text: str, rule: Rule, start: int, end: int) -> bool:
    """The match is one of several printed choices that end in `etc`."""
    head = re.split(r"\.|\n\n", text[:start])[-1]
    sentence = head + text[start:end] + text[end:].partition(".")[0]
    return sentence.count(",") >= OPTION_COMMAS and re.search(r"\betc\b", sentence) is not None


def question(text: str, rule: Rule, start: int, end: int) -> bool:
    stop = re.search(r"[.!?]", text[end : end + QUESTION_AFTER])
    return stop is not None and stop.group() == "?"


def explanation(dim: str, words: str) -> Callable[[str, Rule, int, int], bool]:
    """Guard for one dimension: the match is what somebody explains the thing as, not what was seen."""
    pattern = re.compile(words, re.IGNORECASE)
    return lambda text, rule, a, b: rule.dim == dim and pattern.search(text[max(0, a - EXPLAINED_BEFORE) : a]) is not None


@dataclass
class Tagger:
    """Tags of a passage: an exclusive engine with the form guards, a further finder (such as durations), and limits
    beyond which the tags of a dimension are a check list and not an answer."""

    rules: Sequence[Rule]
    explained: tuple[str, str] | None = None
    finder: Callable[[str], tuple[str, int, int] | None] | None = None
    limits: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        guards = [form_label, option_list, question, *([explanation(*self.explained)] if self.explained else [])]
        self.engine = Engine(self.rules, exclusive=True, refuse=guards)

    def tags(self, text: str | None) -> list[dict]:
        """(key, start, end) in order of place."""
        found = {s["key"]: (s["start"], s["end"], s["dim"]) for s in self.engine.spans(text)}
        if self.finder and text and (extra := self.finder(text)):
            found[extra[0]] = (*extra[1:], "")
        per = Counter(dim for _, _, dim in found.values())
        kept = {k: v for k, v in found.items() if per[v[2]] < self.limits.get(v[2], len(found) + 1)}
        return [{"key": k, "start": a, "end": b} for k, (a, b, _) in sorted(kept.items(), key=lambda kv: kv[1][0])]


def widened(text: str, start: int, end: int, width: int) -> str:
    """The text around a span, out to whole words, with an ellipsis where it was cut."""
    a, b = max(0, start - width), min(len(text), end + width)
    while a and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    return "…" * (a > 0) + " ".join(text[a:b].split()) + "…" * (b < len(text))


def merged(spans: Iterable[tuple[int, int]], width: int, size: int) -> list[tuple[int, int]]:
    """Windows of `width` around spans within a text of `size`, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a - width), min(size, b + width)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(w) for w in out]


def excerpt(text: str, spans: Iterable[tuple[int, int]], width: int = 160) -> str:
    """The windows around the spans, the spans marked, ellipses between and at cut ends."""
    spans = sorted(spans)
    out = []
    for a, b in merged(spans, width, len(text)):
        piece, at = "", a
        for x, y in spans:
            if a <= x and y <= b and x >= at:
                piece += text[at:x] + "<mark>" + text[x:y] + "</mark>"
                at = y
        out.append("…" * (a > 0) + piece + text[at:b] + "…" * (b < len(text)))
    return " ".join(out).replace("……", "…").replace("… …", " … ")


def map_column(df: DataFrame, column: str, out: str, kind: str, fn: Callable[[object], object], only: str | None = None) -> DataFrame:
    """df with fn(column) as a new column; every other column passes as Arrow data. Rows where the boolean column `only`
    is not true get fn(None)."""
    schema = df.limit(0).select("*", F.lit(None).cast(kind).alias(out)).schema
    at, flag = df.columns.index(column), df.columns.index(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow, blank = to_arrow_type(schema[out].dataType), fn(None)
        for batch in batches:
            wanted = batch.column(flag).to_pylist() if only else [True] * batch.num_rows
            column = batch.column(at)
            made = pa.array([fn(column[i].as_py()) if w else blank for i, w in enumerate(wanted)], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def find_spans(df: DataFrame, column: str, engine: Engine, out: str = "spans") -> DataFrame:
    """df with the spans of `column`; rows without a candidate get an empty array without being read in Python."""
    maybe = F.coalesce(F.col(column).rlike(f"(?iu){engine.prefilter()}"), F.lit(False))
    return map_column(df.withColumn("_maybe", maybe), column, out, SPAN, engine.spans, "_maybe").drop("_maybe")


def find_tags(df: DataFrame, column: str, tagger: Tagger, out: str = "tags") -> DataFrame:
    return map_column(df, column, out, "array<struct<key:string,start:int,end:int>>", tagger.tags)
