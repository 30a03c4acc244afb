"""Queries of the metadata and text functions. Their oracles are known answers: the inputs are dealt over a table by key,
and the SQL deals the expected outputs in the same way, so it repeats none of the expressions."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions import metadata as md
from corvane.functions import segments as sg
from corvane.functions import spans as sp
from corvane.functions import text as tx
from corvane.functions import wording as wd
from corvane.plans.catalog import query

KEY = "p_partkey"


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value).lower() if isinstance(value, bool) else repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]"
    text = str(value).replace("'", "''")
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


def answers(kind: str, /, **columns: list) -> str:
    """SQL that deals lists of answers over the parts."""
    picked = ", ".join(f"CAST(({_sql(v)})[1 + {KEY} % {len(v)}] AS {kind}) AS {c}" for c, v in columns.items())
    return f"SELECT {KEY}, {picked} FROM part"


def dealt(t, kind: str, /, **columns: list):
    """The parts with lists of inputs dealt over them."""
    n = {c: F.pmod(F.col(KEY), F.lit(len(v))).cast("int") for c, v in columns.items()}
    made = {c: F.get(F.array(*[F.lit(x).cast(kind) for x in v]), n[c]) for c, v in columns.items()}
    return t.part.select(KEY, *[m.alias(c) for c, m in made.items()])


def check(kind: str, inputs: dict[str, list], result, answer: list, source: str = "string", name: str = "out"):
    """Register a query that applies `result` to the dealt inputs; the function's name comes from the caller."""

    def register(f):
        def run(t):
            return dealt(t, source, **inputs).select(KEY, result(*[F.col(c) for c in inputs]).alias(name))

        run.__name__ = f
        query(answers(kind, **{name: answer}))(run)

    return register


SHAPE = r"^[A-Za-z]{1,2}-[A-Za-z]?\d+[a-z]?$"

check("VARCHAR", {"v": ["ab-12, second field", "Plain title, 1950", "XY-b7c", " no", ""]},
      lambda v: md.record_id(v, SHAPE), ["AB-12", "Plain title, 1950", "XY-B7C", " no", ""])("record_ids")
check("VARCHAR", {"a": ["ab-1, x| |zz", None, "q", "|"], "b": ["cd-2", "e-9,f|g", None, ""]},
      lambda a, b: F.array_join(md.paired_ids([a, b], SHAPE), ";"), ["AB-1;zz;CD-2", "E-9;g", "q", ""])("paired_ids")
check("VARCHAR", {"v": ["PDF", "vid", "Img", "AUD", "zip", "", None]}, md.media_kind,
      ["pdf", "video", "image", "audio", "other", "other", "other"])("media_kinds")
check("VARCHAR", {"k": ["video", "pdf", "audio", "pdf", "image"], "l": ["a.pdf", "b.pdf", "c", "", None], "i": ["77", "88", "", "9", "1"]},
      lambda k, l, i: md.media_address(k, l, i, "https://media.example/{id}"),
      ["https://media.example/77", "b.pdf", None, None, None])("media_addresses")
check("BOOLEAN", {"v": ["TRUE", "true ", "FALSE", "", None, "yes"]}, lambda v: md.flagged(v, "TRUE"),
      [True, True, False, False, False, False])("text_flags")
check("VARCHAR", {"v": ["18_6369445_General_1948_Vol_1", "65_HS1-834228961_62-HQ-83894_Section_009", "Plain Title_with", "12_", " 331_120752_box12 file",
                        "7_ _x", "", None, "1_part3-volume2"]},
      md.clean_title,
      ["General 1948 Vol 1", "62-HQ-83894 Section 009", "Plain Title_with", "12_", "Box 12 file", "X", "", "", "Part 3-volume 2"])("clean_titles")
check("VARCHAR", {"v": ["  Roswell,  New Mexico, U.S. ", "Washington, D.C.", "Washington DC", "n/a", "", None, "LEO", "Paris.", "Ohio, United States of America",
                        "U.S.", "indo-pacom;", "Utah, USA,"]},
      md.normal_place,
      ["Roswell, New Mexico", "Washington, D.C.", "Washington, D.C.", None, None, None, "Low Earth Orbit", "Paris", "Ohio", "U.S.", "INDOPACOM", "Utah"])(
    "normal_places")
check("VARCHAR", {"r": ["3/23/26", "3/23/2026", None, "N/A", "June 1952", "", "3/3/23", None], "p": ["2026", "2026", None, None, "1952", None, "2023", None],
                  "t": ["March 2023", "March 2023", "Report, 2026", "1947 and 2026", "1950", "No year", "In 2023", "Report, 2025"]},
      lambda r, p, t: (lambda y: F.concat_ws("|", F.coalesce(y["year"].cast("string"), F.lit("-")), y["keep_date"].cast("string")))(
          md.reconciled_year(r, p.cast("int"), t, F.lit(2026))),
      ["2023|false", "2026|true", "-|true", "1947|true", "1952|true", "-|true", "2023|true", "2025|true"])("reconciled_years")
check("INTEGER", {"y": [1999, 2027, None, 2026]}, lambda y: md.not_after(y, F.lit(2026)), [1999, None, None, 2026], "int")("years_until_release")
check("VARCHAR", {"t": ["Seen in 1947", "Seen in 1947", None, "No year", "1950 to 1952", "x19501"], "y": ["1947", "1950", "1950", "1950", "1952", "1"]},
      lambda t, y: md.date_note(t, y.cast("int")), [None, "the title says 1947", None, None, None, None])("date_notes")
check("VARCHAR", {"n": ["1", "12", None, "0"], "d": ["2026-07-02", "1999-12-31", "2026-01-09", "2026-10-10"]},
      lambda n, d: md.release_label(n.cast("int"), d.cast("date")),
      ["Release 01 · 2 Jul 2026", "Release 12 · 31 Dec 1999", "Release · 9 Jan 2026", "Release · 10 Oct 2026"])("release_labels")
check("VARCHAR", {"f": ["kind", "kind", "agency", "shape", "kind"], "v": ["memo", "new_KIND_x", "FBI_x", "disc", "memo"]},
      lambda f, v: md.label(f, v, {"kind": {"memo": "Memorandum"}, "shape": {"disc": "Disc"}}),
      ["Memorandum", "New kind x", "FBI_x", "Disc", "Memorandum"])("facet_labels")
check("VARCHAR", {"y": [1939, 1940, 1999, 2031, None, 2029]}, md.era, [None, "1940s", "1990s", "2020s", None, "2020s"], "int")("eras")
check("VARCHAR", {"y": [1939, 1940, 1999, 2031, None]}, tx.decade, [None, "1940s", "1990s", "2030s", None], "int")("decades")
check("VARCHAR", {"r": ["7/2/52", "1/2/47 - 1/5/47", "October, 2023", "N/A", "", None, "about  noon", "13/45/50", "x"], "p": [None, None, None, None, None, None, None, None, "1952-07-02"],
                  "y": [None, None, "2023", "1950", None, "1951", None, None, "1952"]},
      lambda r, p, y: md.shown_date(r, p.cast("date"), y.cast("int"), 2026),
      ["2 Jul 1952", "2 Jan 1947 – 5 Jan 1947", "October 2023", "1950", "—", "1951", "about noon", "13/45/50", "2 Jul 1952"])("shown_dates")
check("VARCHAR", {"k": ["correspondence", "report", None, "scientific_study"]}, md.date_heading,
      ["Document date", "Incident date", "Incident date", "Document date"])("date_headings")
check("VARCHAR", {"v": ["This is a 1952 case file", "this report is the  last one", "This is about x", None, "A file", "This image is an old one"]},
      md.without_opener, ["A 1952 case file", "The last one", "This is about x", None, "A file", "An old one"])("plain_openings")
check("VARCHAR", {"s": ["A file on  x…", "A (b) c", "Other", None, "all of it", "a.b"], "d": ["A file\non x, and more. ", "A (b)  c; then d", "Not it", "x", "all of it", "axb and"]},
      md.remainder, ["and more.", "then d", None, None, None, None])("description_rests")
check("VARCHAR", {"v": ["One two.  Three four. Five", "Short", "abcdefghij klm", "", None]}, lambda v: md.opening(v, 20, 5),
      ["One two.", "Short", "abcdefghij klm", "", None])("text_openings")
check("VARCHAR", {"v": ["One. Two! Three.", "one. two. Three? (Four)", "", None, "aaaa bbbb cccc dddd eeee"]}, lambda v: md.first_sentences(v, 2, 18),
      ["One. Two!", "one. two. Three?", "", "", "aaaa bbbb cccc…"])("first_sentences")
check("VARCHAR", {"v": ["a  short\ntext", "words that go, on and on", "", None, "abcdefghijklmnopqrst"]}, lambda v: md.meta_text(v, 14),
      ["a short text", "words that…", None, None, "abcdefghijklmn…"])("meta_texts")
check("VARCHAR", {"n": ["AB-1 #2", "é/x", "plain"], "u": ["http://a.b/c.PDF", None, "http://a.b/c"]},
      lambda n, u: md.file_path(F.lit("src"), n, u), ["src/AB-1_2.pdf", "src/_x.bin", "src/plain.bin"])("file_paths")
check("VARCHAR", {"r": ["12_AB-1_CD-2_x", "12_AB-1_CD-2_y", "REC-1", "REC-2"], "d": [None, "", "x", "x"], "s": ["false", "true", "true", "false"]},
      lambda r, d, s: F.regexp_replace(md.series_key(r, d, s.cast("boolean"), r"^([0-9]+(?:_[A-Z-]+[0-9]+){2})"), r"^desc:-?\d+$", "desc"),
      ["head:12_AB-1_CD-2", "head:12_AB-1_CD-2", "desc", "rec:REC-2"])("series_keys")
check("VARCHAR", {"d": ["a balloon", None, "nothing", "", "hoax or balloon"], "b": ["hoax", "a hoax", "x", "balloon then hoax", "z"]},
      lambda d, b: md.first_rule([("balloon", "resolved_balloon"), ("hoax", "hoax")], d, F.left(b, F.lit(50_000)), default="not_assessed"),
      ["resolved_balloon", "hoax", "not_assessed", "resolved_balloon", "resolved_balloon"])("first_assessments")
check("VARCHAR", {"l": ["Ohio", "Kyoto, Japan", "NORAD", "various places", "nowhere", None], "t": ["x", "x", "x", "x", "A Texas case", "Japan"]},
      lambda l, t: md.first_rule([("(?i)ohio|texas", "us"), ("(?i)japan", "asia"), ("(?i)norad|usa", "us_other"), ("(?i)various", "other")], l, t),
      ["us", "asia", "us_other", "other", "us", "asia"])("regions")
check("VARCHAR", {"t": ["Unresolved report", "Unresolved report", None, "A report", "unresolvedly"], "a": [None, "hoax", "not_assessed", None, "not_assessed"]},
      md.stated_assessment, ["unresolved", "hoax", "not_assessed", "not_assessed", "not_assessed"])("stated_assessments")
check("BOOLEAN", {"k": ["scientific_study", "report", None, "report"], "t": ["x", "A Literature Review of y", None, "surveys of"]},
      lambda k, t: md.research_record(k, t, r"(?i)literature review|\bsurvey of\b"), [True, True, False, False])("research_records")
check("VARCHAR", {"v": ["7/2/52", " 7/2/52 ", "3/23/26", "3/23/27", "2/30/20", "1/2/0099", "N/A", None]}, lambda v: tx.us_date(v, 2026).cast("string"),
      ["1952-07-02", "1952-07-02", "2026-03-23", "1927-03-23", None, "1999-01-02", None, None])("listing_dates")
check("VARCHAR", {"v": ["\n\n abc \n", "a\x00b\r\n\n\n\nc  d\t e", "  ", None, "x \n y"]}, tx.clean_text, ["abc", "ab\n\nc d e", "", None, "x\ny"])("clean_texts")
check("DOUBLE", {"v": ["$word #tag", "(Plain) words!", "a bc 12", "", "one two"]}, tx.text_quality, [0.0, 1.0, 1 / 3, 0.0, 1.0])("edge_qualities")
check("BIGINT", {"v": ["ab1-é", "", "Ⅷ ½x", "日本 !"]}, lambda v: tx.meaningful_chars(v).cast("long"), [4, 0, 3, 2])("meaningful_chars")
check("VARCHAR", {"a": ["clean words here", "x#", None, "same text"], "b": ["cl3an w#", "clean words", "some", "same text"]}, tx.better_layer,
      ["clean words here", "clean words", "some", "same text"])("better_layers")
check("BOOLEAN", {"v": ["short", "words " * 20, "words " * 20, None, "words " * 90], "s": ["0", "0.1", "0.9", None, "0.9"]},
      lambda v, s: tx.needs_scan(v, s.cast("double")), [True, False, True, True, False])("scan_needs")
check("VARCHAR", {"v": ["we saw a Tic Tac and a tic-tac", "none of it", "abc" * 100, "", None]}, lambda v: tx.highlight(v, ["tictac", "tic tac", "tic-tac"], 20),
      ["we saw a <mark>Tic Tac</mark> and…", "none of it", "abcabcabcabcabcabcab…", "", ""])("highlights")
check("VARCHAR", {"v": ["seen in Ohio and Mexico", "New Mexico", "ohioan", "Ill. today", "ill. today", "", None]},
      lambda v: F.coalesce(F.array_join(lx.places_of(v, {"US-OH": [("Ohio", False)], "US-NM": [("New Mexico", False)], "US-IL": [(r"Ill\.", True)], "Mexico": [("(?<!New )Mexico", True)]}), ","), F.lit("")),
      ["US-OH,Mexico", "US-NM", "", "US-IL", "", "", ""])("place_mentions")
check("VARCHAR", {"v": ["CENTCOM area", "the Middle East", "low orbit", "Ohio, Indian Ocean", None]},
      lambda v: F.array_join(lx.location_places(v, {"US-OH": [("Ohio", False)]}, {"CENTCOM": "Middle East (CENTCOM)"},
                                                [("middle east", "Middle East (CENTCOM)"), ("moon|orbit", "Moon / space"),
                                                 ("indian ocean", "Open ocean")]), ","),
      ["Middle East (CENTCOM)", "Middle East (CENTCOM)", "Moon / space", "US-OH,Open ocean", ""])("location_places")


def mapped(name: str, kind: str, inputs: list, result, answer: list):
    """Register a query whose operator runs over Arrow batches."""

    def run(t):
        return result(dealt(t, "string", v=inputs)).select(KEY, "out")

    run.__name__ = name
    query(answers(kind, out=answer))(run)


_AS_OF = datetime.date(2025, 6, 1)
_shown = lambda c: F.array_join(F.transform(c, lambda d: F.concat_ws("/", d["value"].cast("string"), d["precision"])), ",")
mapped("date_mentions", "VARCHAR",
       ["on July 7th, 1947 and 8 Jul 47", "in July 1947; 1947-07-01", "March 1952", "2/30/1950 and 13/1/1950", "3/4/24", "07JUL47 x", "May 5, 1939", "", None,
        "Sept. 3 1951", "1/2/3/50", "12 Marchs 1950"],
       lambda df: sg.with_dates(df, "v", _AS_OF).select(KEY, _shown(F.col("dates")).alias("out")),
       ["1947-07-07/day,1947-07-08/day", "1947-07-01/day", "1952-03-01/month", "", "2024-03-04/day", "1947-07-07/day", "", "", "", "1951-09-03/day", "", ""])
mapped("duration_classes", "VARCHAR",
       ["lasted about ten seconds", "for 20 minutes", "visible for two hours", "for a while", None, "lasted 0 seconds, then visible for 5 minutes"],
       lambda df: sg.with_duration(df, "v", "out"), ["brief", "minutes", "long", None, None, "minutes"])
mapped("redaction_marks", "VARCHAR",
       ["(b)(7)(C) and b6", "b6 alone", "b6 with b7C", "paragraph (b)(1) of this clause", "section 4 (a) (b)(2)", "██ and XXXXXX [redacted]", "", None, "withheld ( b ) (3) x"],
       lambda df: lx.with_redactions(df, "v").select(KEY, F.array_join("redactions", ",").alias("out")),
       ["b7,b6", "", "b6,b7", "", "", "block,block,block", "", "", "b3"])

_VERDICTS = lx.Verdicts(
    [lx.Statement("explained", "resolved_balloon", r"\bidentified as (?:a )?(?:probable |possible )?balloon\b", weak=r".*\b(?:probable|possible)\b"),
     lx.Statement("unresolved", "unresolved", r"\bremains? (?:unidentified|unexplained)\b", unless=r"\b(?:not|never) remain")],
    doubt=r"\b(?:not|if|whether|thought)\b[^.;]{0,35}", hypothetical=r"\W*(?:because|if)\b")
mapped("stated_verdicts", "VARCHAR",
       ["It was identified as a balloon. It remains unexplained.", "not identified as a balloon", "Was it identified as a balloon?",
        "identified as a possible balloon", "identified as a balloon, if seen", "It does not remain unexplained.", "", None,
        "First it remains unidentified. Then it was identified as a probable balloon."],
       lambda df: lx.with_verdicts(df, "v", _VERDICTS).select(
           KEY, F.coalesce(F.concat_ws("/", lx.settled(F.col("verdicts"))["category"], lx.settled(F.col("verdicts"))["strong"].cast("string")), F.lit("")).alias("out")),
       ["unresolved/true", "", "", "resolved_balloon/false", "", "", "", "", "unresolved/true"])

_ENCOUNTERS = lx.Encounters(close=[r"\bon the ground\b", r"\bat close range\b"], occupants=[r"\boccupants?\b", r"\bhumanoids?\b"],
                            human=r"\b(?:car|truck) and its occupants?\b", effects=["em_effects"])
mapped("encounter_kinds", "VARCHAR",
       ["It stood on the ground", "It was not on the ground", "fifty yards away", "900 feet away", "the occupants looked out", "the car and its occupants",
        "", None, "never within 100 feet"],
       lambda df: lx.with_encounters(df.withColumn("tags", F.array(F.lit("em_effects"))), "v", "tags", _ENCOUNTERS).select(KEY, F.array_join("kinds", ",").alias("out")),
       ["ce1,ce2", "ce2", "ce1,ce2", "ce2", "ce2,ce3", "ce2", "ce2", "ce2", "ce2"])

_TAGGER = sp.Tagger(
    [sp.Rule("disc", r"\bdis[ck]s?\b", "shape", not_before=r"\b(?:no|not)\b[^.;]{0,25}"), sp.Rule("sphere", r"\bspheres?\b", "shape"), sp.Rule("cigar", r"\bcigars?\b", "shape"),
     sp.Rule("hum", r"\bhumm?(?:ed|ing)?\b", "sound", not_after=r"[\s:]*none\b"), sp.Rule("hover", r"\bhover(?:ed|ing)?\b", "motion")],
    explained=("shape", r"\bidentified as\b"), finder=sg.duration_span, limits={"shape": 3})
mapped("account_tags", "VARCHAR",
       ["A disc hovered for 5 minutes.", "no sign of a disc, it hummed", "Did it hover?", "a. disc shape", "Hum: none. It hovered", "disc, sphere, cigar, all seen; it hovered",
        "identified as a disc", "disc, hover, hum, glow, etc.", "", None, "The Shape of the disc:"],
       lambda df: sp.find_tags(df, "v", _TAGGER).select(KEY, F.array_join(F.transform("tags", lambda s: s["key"]), ",").alias("out")),
       ["disc,hover,minutes", "hum", "", "", "hover", "hover", "", "", "", "", ""])
mapped("quote_places", "VARCHAR", ["It rose  straight\nup at once", "rose straight down", "nothing", "", None],
       lambda df: sp.map_column(df, "v", "out", "string", lambda v: "-".join(map(str, lx.quote_span(v, "rose straight up at dawn") or ()))),
       ["3-23", "0-13", "", "", ""])
mapped("excerpts", "VARCHAR", ["one two three four five six seven eight", "two", "", None],
       lambda df: sp.map_column(df, "v", "out", "string", lambda v: sp.excerpt(v, [m.span() for m in re.finditer("two|seven", v)], 4) if v else ""),
       ["one <mark>two</mark> thr … six <mark>seven</mark> eig…", "<mark>two</mark>", "", ""])

_NONE = r"[\s:.]*(?:none|n/a|not (?:observed|noted))"
_OBSERVABLES = sp.Engine(
    [sp.Rule("trail", r"(?<![A-Za-z])(?:fiery )?trails?(?![A-Za-z])", not_before=r"\b(?:no|without)\b[^.;]{0,25}", not_after=_NONE), sp.Rule("odor", r"(?<![A-Za-z])odou?r(?![A-Za-z])", not_after=_NONE),
     sp.Rule("silent", r"(?<![A-Za-z])(?:no sound|silent)(?![A-Za-z])", not_after=r"[^.;]*?\b(?:but|except)\b", ahead=sp.EXCEPTION_AFTER)])
mapped("observed_details", "VARCHAR",
       ["It left a trail and an odor", "without any single bit of the fiery trails of it", "Odor: none. A trail", "no sound, except a rumble", "silent; then but a hum", "no sound. But later", "Trailing off", "", None,
        "no trail, later a trail"],
       lambda df: sp.find_spans(df, "v", _OBSERVABLES).select(KEY, F.array_join(F.transform("spans", lambda s: F.concat_ws("@", s["key"], s["start"])), ",").alias("out")),
       ["trail@10,odor@23", "", "trail@14", "", "silent@0", "silent@0", "", "", "", ""])

_CANDIDATES = lx.Candidates(_TAGGER, frozenset({"shape", "motion"}), {"disc": "shape", "sphere": "shape", "cigar": "shape", "hum": "sound", "hover": "motion"}, template=r"\bplease\b|\bif any\b|\bdescribe\b")
mapped("candidate_tags", "VARCHAR",
       ["A disc that hovered.", "It hummed only.", "Please describe the disc, if any, and how it hovered.", "A disc. Please look.", "", None],
       lambda df: sp.map_column(df, "v", "tags", "array<struct<key:string,start:int,end:int>>", _CANDIDATES.of_passage).select(
           KEY, F.concat(F.array_join(F.transform("tags", lambda s: s["key"]), ","), F.when(_CANDIDATES.comparable_tags(F.col("tags")), "!").otherwise("")).alias("out")),
       ["disc,hover!", "", "", "disc", "", ""])
mapped("account_sentences", "VARCHAR",
       ["pilot disc white night hover hum", "pair glow minutes high_speed", "", None, "starlike radar photo brief silent em_effects heat", "metallic daylight formation climb", "oval driving"],
       lambda df: wd.with_sentences(df.withColumn("tags", F.split("v", " ")), "tags", "out"),
       ["A pilot saw a white disc-shaped object at night. It hovered and hummed.", "Witnesses saw two lights. They were glowing and moved at extreme speed, in view for some minutes.",
        "Witnesses saw an object.", "Witnesses saw an object.",
        "Witnesses saw a star-like light, tracked on radar and photographed. It made no sound, in view for a few seconds. Engines or electrics failed and heat was felt.",
        "Witnesses saw several silvery lights in daylight. They climbed vertically.", "A driver saw an oval object."])

_REPORT = "the crew of the first aircraft saw a bright round light cross the bay from west to east at great speed and then turn back over the water"
mapped("same_reports", "BOOLEAN", [_REPORT, "xx " + _REPORT.replace("great speed", "grat sped"), " ".join(reversed(_REPORT.split())), "the crew saw it", "", None],
       lambda df: lx.with_same_report(df.withColumn("w", F.lit(_REPORT)), "v", "w", "out"), [True, True, False, False, False, False])
