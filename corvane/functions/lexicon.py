"""Places, redaction marks, verdicts, encounters and quotes in text. Every word list is an argument."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.segments import distances
from corvane.functions.spans import Engine, Rule, map_column

# Closeness in feet, how far back a denial counts there.
CLOSE_FEET, DENIAL_BEFORE, DENIAL_REACH = 500, 30, 20
# Words that deny what follows them.
DENIALS = ("no", "not", "never", "without", "neither", "nor")
# How far back and ahead a verdict's sentence is judged, and how long it may be.
JUDGED_BEFORE, JUDGED_AFTER, SENTENCE = 60, 20, 400
# Words each text needs, shortest common run, share of the shorter text, for two copies of one report.
REPORT_WORDS, REPORT_RUN, REPORT_SHARE = 25, 3, 0.45


def vocabulary_hits(text: Column, words: str) -> Column:
    """Occurrences of a vocabulary (an alternation) between characters that are no ASCII letters."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?iu)(?<![A-Za-z])(?:{words})(?![A-Za-z])")), F.lit(0))


def places_of(text: Column, lexicon: Mapping[str, Sequence[tuple[str, bool]]]) -> Column:
    """Keys of the places a text names, in lexicon order. A place has patterns, each with whether case matters."""

    def named(patterns: Sequence[tuple[str, bool]]) -> Column:
        hits = [text.rlike(rf"{'' if exact else '(?iu)'}(?<![A-Za-z])(?:{p})(?![A-Za-z])") for p, exact in patterns]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    return F.array_compact(F.array(*[F.when(F.coalesce(named(p), F.lit(False)), key) for key, p in lexicon.items()]))


def location_places(location: Column, lexicon: Mapping, commands: Mapping[str, str], fallbacks: Sequence[tuple[str, str]]) -> Column:
    """Places of a published location: those it names, the regions of commands in it, then words for regions."""
    low = F.lower(location)
    by_command = [F.when(F.contains(low, F.lit(c.lower())), region) for c, region in commands.items()]
    by_word = [F.when(low.rlike(p), region) for p, region in fallbacks]
    found = F.concat(places_of(location, lexicon), F.array_compact(F.array(*by_command, *by_word)))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


# How a full code such as (b)(7)(C) and a margin stamp such as b7C are written.
_CODE = re.compile(r"\(\s?b\s?\)\s?\(\s?([1-9])\s?\)(?:\s?\(\s?[A-F]\s?\))?", re.IGNORECASE)
_STAMP = re.compile(r"(?<![A-Za-z0-9])b([1-7])(?:\s?[A-Fa-f])?(?![A-Za-z0-9])")
# Parts of a law a code can cite, and how a citation goes on.
LAW_PARTS = ["paragraph", "section", "subsection", "clause", "subparagraph", "subdivision", "item", "part"]
CITES = ["of", "in", "under", "to"]
CITED = ["this", "the", "such", "these", "those", "section", "paragraph"]
# Signs that black out (two or more), words that stand for a deletion in square and in round brackets.
BLACK, SQUARE, ROUND = "█▇▆■▪", ["redacted", "deleted", "withheld", "excised"], ["redacted", "deleted"]
BLOCK = "|".join([f"[{BLACK}]{{2,}}", "X{5,}", *(rf"\[{w}\]" for w in SQUARE), *(rf"\({w}\)" for w in ROUND)])


def _inside_citation(before: str, after: str) -> bool:
    """A letter or digit stands right before, or a part of a law with its number, or `of this section` follows."""
    if re.search(r"[A-Za-z0-9]$", before):
        return True
    going = re.findall(r"\w+", after)[:2] if re.match(r"\s*\w+\s", after) else []
    if len(going) == 2 and going[0].lower() in CITES and going[1].lower() in CITED:
        return True
    head = before.rstrip()
    while head.endswith(")") and "(" in head and re.fullmatch(r"\w+", head[head.rindex("(") + 1 : -1]):
        head = head[: head.rindex("(")].rstrip()
    words = re.findall(r"[\w.\-]+", head)[-2:] if re.search(r"[\w.\-]$", head) else []
    return any(w.lower().strip(".-").removesuffix("s") in LAW_PARTS for w in words)


def redactions(text: str | None, block: str = BLOCK) -> list[str]:
    """Codes b1 to b9 and `block`, one for each mark. Full codes inside a citation of law do not count; short stamps
    count where there are two of them or a full code beside them."""
    text = text or ""
    full = [
        f"b{m.group(1)}" for m in _CODE.finditer(text)
        if not _inside_citation(text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30])
    ]
    stamps = [f"b{m.group(1)}" for m in _STAMP.finditer(text)]
    trusted = stamps if full or len(stamps) > 1 else []
    return full + trusted + ["block"] * len(re.findall(block, text, re.IGNORECASE))


def with_redactions(df: DataFrame, column: str, out: str = "redactions") -> DataFrame:
    return map_column(df, column, out, "array<string>", redactions)


@dataclass(frozen=True)
class Statement:
    """A way to state a verdict. `weak`: beginnings of a match that only hedge; `unless`: what makes it say the opposite
    when it occurs in the match or in the 12 characters before."""

    group: str
    category: str
    pattern: str
    weak: str | None = None
    unless: str | None = None


VERDICT = "array<struct<group:string,category:string,start:int,end:int,strong:boolean,sentence:string>>"


def sentence_around(text: str, start: int, end: int) -> str:
    """The sentence of a span: between full stops, marks or blank lines, white space squeezed."""
    low = max(text.rfind(s, 0, start) + 1 for s in (".", "!", "?", "\n\n"))
    ends = [p for s in (".", "?", "\n\n") if (p := text.find(s, end)) >= 0]
    return " ".join(text[low : min(ends) + 1 if ends else len(text)].split())[:SENTENCE]


@dataclass
class Verdicts:
    """Stated verdicts; `doubt` ends before a statement in its sentence and `hypothetical` follows it when it is none."""

    statements: Sequence[Statement]
    doubt: str = r"(?!)"
    hypothetical: str = r"(?!)"

    def find(self, text: str | None) -> list[dict]:
        """Statements in order of place, none inside another; the longer one wins where two begin together."""
        text, found = text or "", []
        doubt, later = re.compile(f"(?:{self.doubt})$", re.I), re.compile(self.hypothetical, re.I)
        for s in self.statements:
            for m in re.finditer(s.pattern, text, re.IGNORECASE):
                a, b = m.span()
                begin = max(text.rfind(".", 0, a), text.rfind("\n\n", 0, a)) + 1
                sentence = sentence_around(text, a, b)
                if sentence.endswith("?") or later.match(text[b : b + JUDGED_AFTER]):
                    continue
                if doubt.search(text[max(begin, a - JUDGED_BEFORE) : a].replace("\n", " ")):
                    continue
                if s.unless and re.search(s.unless, text[max(0, a - 12) : b], re.I):
                    continue
                strong = not (s.weak and re.match(s.weak, m.group(), re.I))
                found.append({"group": s.group, "category": s.category, "start": a, "end": b, "strong": strong, "sentence": sentence})
        found.sort(key=lambda v: (v["start"], -v["end"]))
        reach = accumulate((v["end"] for v in found), max)
        return [v for v, before in zip(found, [0, *reach]) if v["start"] >= before]


def with_verdicts(df: DataFrame, column: str, finder: Verdicts, out: str = "verdicts") -> DataFrame:
    return map_column(df, column, out, VERDICT, finder.find)


def settled(verdicts: Column) -> Column:
    """The verdict a passage settles on: definite wording before hedges, the last of them; null without any."""
    by = F.transform(verdicts, lambda v: F.struct(v["strong"].alias("strong"), v["start"].alias("start"), v.alias("v")))
    return F.array_max(by)["v"]


@dataclass
class Encounters:
    """Kinds of encounter an account belongs to, from its text and its tags."""

    close: Sequence[str]
    occupants: Sequence[str]
    human: str = r"(?!)"
    denials: Sequence[str] = DENIALS
    landed: Sequence[str] = ("descend",)
    effects: Sequence[str] = ()

    def is_close(self, text: str | None) -> bool:
        """Within CLOSE_FEET, or in words that say so, unless denied just before."""
        text = text or ""
        denied = re.compile(rf"\b(?:{'|'.join(self.denials)})\b[^.;:\n]{{0,{DENIAL_REACH}}}$", re.IGNORECASE)
        begins = [at for feet, at in distances(text) if feet <= CLOSE_FEET]
        begins += [m.start() for p in self.close for m in re.finditer(p, text, re.IGNORECASE)]
        return any(not denied.search(text[max(0, at - DENIAL_BEFORE) : at]) for at in begins)

    def has_occupants(self, text: str | None) -> bool:
        """Someone in or beside the thing, not the people of a car or house named in the 60 characters before."""
        return bool(Engine([Rule("o", p, not_near=self.human) for p in self.occupants]).spans(text))

    def kinds(self, text: str | None, tags: Iterable[str] | None) -> list[str]:
        tags = set(tags or ())
        found = [("ce1", bool(tags & set(self.landed)) or self.is_close(text)), ("ce2", bool(tags & set(self.effects))),
                 ("ce3", self.has_occupants(text))]
        return [k for k, yes in found if yes]


def with_encounters(df: DataFrame, column: str, tags: str, words: Encounters, out: str = "kinds") -> DataFrame:
    both = df.withColumn("_both", F.struct(F.col(column).alias("text"), F.col(tags).alias("tags")))
    of = lambda v: words.kinds(v["text"], v["tags"]) if v else []
    return map_column(both, "_both", out, "array<string>", of).drop("_both")


def quote_span(text: str | None, quote: str | None) -> tuple[int, int] | None:
    """Where a quote stands, white space aside: all of it, else its first four words, else its first two."""
    words = (quote or "").split()
    for n in dict.fromkeys((len(words), 4, 2)):
        if words and n <= len(words):
            m = re.search(r"\s+".join(map(re.escape, words[:n])), text or "", re.IGNORECASE)
            if m:
                return m.span()
    return None


def same_report(a: str | None, b: str | None) -> bool:
    """Whether two passages are copies of one report: common runs of words cover enough of the shorter."""
    left, right = (re.findall(r"[a-z0-9]+", (t or "").lower()) for t in (a, b))
    if min(len(left), len(right)) < REPORT_WORDS:
        return False
    runs = difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks()
    return sum(r.size for r in runs if r.size >= REPORT_RUN) >= REPORT_SHARE * min(len(left), len(right))


def with_same_report(pairs: DataFrame, left: str, right: str, out: str = "same_report") -> DataFrame:
    """Pairs (already candidates) with whether their texts are one report."""
    both = pairs.withColumn("_both", F.struct(F.col(left).alias("a"), F.col(right).alias("b")))
    return map_column(both, "_both", out, "boolean", lambda v: same_report(v["a"], v["b"]) if v else False).drop("_both")


@dataclass
class Candidates:
    """Passages worth tagging: of units with enough vocabulary (or the description, page 0), with few words of a blank
    form, and with at least one tag of a core dimension."""

    tagger: object
    core: frozenset
    dim_of: Mapping[str, str]
    template: str = r"(?!)"
    # Template words that make a blank form; core tags an account needs to be compared.
    blank_form: int = 3
    comparable: int = 2

    def of_passage(self, passage: str | None) -> list[dict]:
        if not passage or len(re.findall(self.template, passage, re.IGNORECASE)) >= self.blank_form:
            return []
        tags = self.tagger.tags(passage)
        return tags if any(self.dim_of.get(t["key"]) in self.core for t in tags) else []

    def comparable_tags(self, tags: Column) -> Column:
        """Whether an account (array of tag structs) has enough core tags."""
        keys = [k for k, d in self.dim_of.items() if d in self.core]
        return F.size(F.filter(tags, lambda t: t["key"].isin(*keys))) >= self.comparable
