"""URL filter with a weighted vocabulary found by an Aho-Corasick automaton, behind host and path rules.

A vocabulary row is (term, class, weight). One strict term rejects; soft terms reject when the weights of the different ones add
up to SOFT_LIMIT, which no single one reaches. A term counts only between boundaries, i.e. where the characters beside it
are no ASCII letters or digits. The vocabulary is a parameter (TERMS, or any table's rows by `vocabulary`), compiled once
in each task. Rules come first: a rule fits its host and all subdomains when the path starts with the rule's; the longest
rule wins.

Defined results: null, empty or scheme-less urls have empty host and path; the vocabulary still judges what text there is, and a
null url is allowed. Each row is judged for itself, so repeated rows and null ids are results like others; of rules
of one length the last by name wins; urls of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

STRICT, SOFT = "strict", "soft"
#: (term, class, weight)
TERMS = (
    *((t, STRICT, 1.0) for t in (
        "camgirls", "casino", "crackz", "escort", "escorts", "gambling", "hentai", "keygen", "malware", "nsfw", "phishing", "porn",
        "pornhub", "roulette", "sportsbook", "torrentz", "viagra", "warez", "xvideos", "xxx")),
    *((t, SOFT, 1.5) for t in ("adult", "affiliate", "bet", "betting", "cialis", "erotic", "payday", "pills", "poker", "sexy", "slots", "spam")),
    *((t, SOFT, 1.0) for t in (
        "ads", "adserver", "banner", "bonus", "cheap", "clickbait", "coupon", "crack", "dating", "discount", "download", "free", "giveaway",
        "jackpot", "loan", "loans", "lottery", "popup", "promo", "replica", "serial", "singles", "sponsor", "tracker", "win", "winner")),
    *((t, SOFT, 0.5) for t in ("buy", "click", "deal", "deals", "offer", "offers", "redirect", "sale", "shop", "track", "utm")),
)
SOFT_LIMIT = 2.0

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_LOWER = {i: i + 32 for i in range(65, 91)}
_STOPS = "/?#"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((p for p in map(rest.find, _STOPS) if p >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((p for p in map(tail.find, "?#") if p >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str | None, str | None]:
    """The longest fitting rule as text, and its verdict."""
    best = max(
        (r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])),
        key=lambda r: (len(r[0]) + len(r[1]), r),
        default=None,
    )
    return (None, None) if best is None else (best[0] + best[1], best[2])


def vocabulary(table: DataFrame) -> list[tuple[str, str, float]]:
    """Rows (term, class, weight) of a vocabulary table, lower-cased; for tables of a size that fits a task."""
    return sorted((r["term"].translate(_LOWER), r["class"], float(r["weight"])) for r in table.filter("term <> ''").collect())


def compile_terms(terms: Sequence[tuple[str, str, float]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    # Of a term that is listed twice, the strict row or the greater weight counts.
    for term, kind, weight in sorted(terms, key=lambda t: (t[1] == STRICT, t[2])):
        automaton.add_word(term, (term, kind, weight))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def term_hits(url: str | None, automaton: ahocorasick.Automaton) -> tuple[set[str], dict[str, float]]:
    """Different strict terms, and soft terms with their weights, that stand between boundaries."""
    strict: set[str] = set()
    soft: dict[str, float] = {}
    if not url or not len(automaton):
        return strict, soft
    text = url.translate(_LOWER)
    inside = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    for end, (term, kind, weight) in automaton.iter(text):
        if not inside(end + 1) and not inside(end - len(term)):
            if kind == STRICT:
                strict.add(term)
            else:
                soft[term] = weight
    return strict, soft


def judge_urls(
    pages: DataFrame,
    terms: Sequence[tuple[str, str, float]] = TERMS,
    soft_limit: float = SOFT_LIMIT,
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight for every row; only page_id and url are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_terms(terms)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = rule_of(host, path, rules)
                hard, mild = term_hits(url, automaton)
                weight = sum(sorted(mild.values()))
                own = "block" if hard or weight >= soft_limit else "allow"
                for column, value in zip(out, (host, path, rule, verdict or own, len(hard), len(mild), weight), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
                names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(
        run,
        f"page_id {kind}, host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight double",
    )
