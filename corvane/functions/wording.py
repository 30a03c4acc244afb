"""A plain sentence or two about an account, put together from its tags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from corvane.functions.spans import map_column

# How tags are put into words, in the order in which they are looked up.
WITNESSES = {"pilot": "A pilot", "at_sea": "A ship's crew", "driving": "A driver", "many_witnesses": "Several witnesses"}
SHAPES = {
    "disc": "disc-shaped object", "sphere": "spherical object", "cigar": "cigar-shaped object", "oval": "oval object",
    "triangle": "triangular object", "chevron": "V-shaped object", "diamond": "box-like object", "fireball": "fireball",
    "starlike": "star-like light",
}
COLOURS = {"metallic": "silvery", "white": "white", "red_orange": "red-orange", "yellow": "yellow", "green": "green",
           "blue_white": "bluish", "dark": "dark", "colour_change": "colour-changing"}
LIGHTS = {"glow": "glowing", "halo": "haloed", "flashing": "flashing", "bright": "very bright", "beam": "beaming light"}
MOTIONS = {
    "hover": "hovered", "accelerate": "accelerated away suddenly", "high_speed": "moved at extreme speed", "maneuver": "made abrupt turns",
    "erratic": "moved erratically", "oscillate": "wobbled", "rotate": "spun", "climb": "climbed vertically", "descend": "descended or landed",
    "pacing": "paced a vehicle", "circling": "circled", "vanish": "vanished abruptly", "drift": "drifted slowly",
    "split_merge": "split or merged", "transmedium": "entered or left the water",
}
SOUNDS = {"silent": "made no sound", "hum": "hummed", "whoosh": "made a rushing sound", "roar": "roared", "whistle": "whistled",
          "bang": "was heard as a bang"}
PARTS = {"no_wings": "had no wings or exhaust", "trail": "left a trail", "sparks": "threw sparks or flame", "dome": "had a dome",
         "windows": "showed windows or a row of lights", "rim": "had a rim", "large": "was very large"}
EFFECTS = {
    "em_effects": "engines or electrics failed", "instruments": "instruments were disturbed", "physiological": "witnesses felt effects",
    "traces": "traces were left on the ground", "smell": "an odour was noticed", "heat": "heat was felt", "animals": "animals reacted",
}
TIMES = {"night": "at night", "twilight": "at dusk or dawn", "daylight": "in daylight"}
MEANS = {"radar": "tracked on radar", "infrared": "on infrared", "photo": "photographed", "instrument_obs": "through a telescope or theodolite"}
LENGTHS = {"brief": "for a few seconds", "minutes": "for some minutes", "long": "for half an hour or more"}
NUMBERS = {"pair": "two", "formation": "several"}


def said(tags: set[str], words: dict[str, str], most: int | None = None) -> list[str]:
    return [w for tag, w in words.items() if tag in tags][:most]


def listed(parts: list[str]) -> str:
    head, last = ", ".join(parts[:-1]), "".join(parts[-1:])
    return f"{head} and {last}" if head else last


def plural(noun: str, number: str) -> str:
    return f"{noun}s" if number else noun


def sentences(tags: Iterable[str] | None, structured: Iterable[str] = ()) -> str:
    """Who saw what, when and how; then what it did, for how long, and what it did to others. `structured` names the tags
    that make an unnamed thing an object even where it has a colour."""
    tags = set(tags or ())
    number = "".join(said(tags, NUMBERS, 1))
    colours, lights = said(tags, COLOURS, 2), said(tags, LIGHTS)
    bright = bool(lights) or (bool(colours) and tags.isdisjoint(structured))
    noun = plural("".join(said(tags, SHAPES, 1)) or ("light" if bright else "object"), number)
    thing = " ".join(filter(None, [number, *colours, noun]))
    article = "" if number else "an " if thing[0] in "aeiou" else "a "
    seen = " ".join(filter(None, ["".join(said(tags, WITNESSES, 1)) or "Witnesses", "saw", article + thing, *said(tags, TIMES, 1)]))
    out = [", ".join(filter(None, [seen, listed(said(tags, MEANS))])) + "."]
    looks = [w for w in lights if w != LIGHTS["beam"]]
    did = [f"{'were' if number else 'was'} {listed(looks)}"] if looks else []
    did += said(tags, MOTIONS, 3) + said(tags, SOUNDS, 1) + said(tags, PARTS, 2)
    if did:
        lasted = said(tags, LENGTHS, 1)
        out.append(f"{'They' if number else 'It'} {listed(did)}" + (f", in view {lasted[0]}" if lasted else "") + ".")
    if effects := listed(said(tags, EFFECTS, 2)):
        out.append(effects[0].upper() + effects[1:] + ".")
    return " ".join(out)


def with_sentences(df: DataFrame, tags: str, out: str = "summary") -> DataFrame:
    return map_column(df, tags, out, "string", sentences)
