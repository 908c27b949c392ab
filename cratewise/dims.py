"""The genre taxonomy's fixed tables, and dimension DataFrames over them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of keystone weight a runner-up needs to make a fusion.
FUSION_THRESHOLD = 0.35

# Electronic styles by keystone.
ELECTRONIC = {
    "House": [
        "house", "deep house", "tech house", "electro house", "progressive house", "garage house",
        "ghetto house", "ghetto", "tropical house", "italo house", "acid house", "hip-house",
        "speed garage", "uk garage", "bassline", "tribal house", "tribal", "disco polo", "beatdown",
        "euro house", "juke",
    ],
    "Techno": [
        "techno", "deep techno", "hard techno", "minimal techno", "dub techno", "schranz", "minimal",
        "acid", "bleep",
    ],
    "Trance": ["trance", "tech trance", "hard trance", "progressive trance", "goa trance", "psy-trance"],
    "Dubstep": ["dubstep", "grime"],
    "Drum n Bass": ["drum n bass", "jungle"],
    "Halftime": ["halftime"],
    "Hard Dance": [
        "hardstyle", "hardcore", "happy hardcore", "gabber", "speedcore", "makina", "jumpstyle",
        "hands up", "donk", "hard house",
    ],
    "Breakbeat": ["breakbeat", "breaks", "big beat", "broken beat", "progressive breaks", "breakcore"],
    "Electro": ["electro", "electroclash", "freestyle", "miami bass"],
    "Ambient": ["ambient", "dark ambient", "drone", "dungeon synth", "new age", "berlin-school"],
    "Downtempo": [
        "downtempo", "trip hop", "chillwave", "synthwave", "vaporwave", "illbient", "lounge",
        "future jazz", "jazzdance", "acid jazz", "dub",
    ],
    "Disco": [
        "disco", "nu-disco", "italo-disco", "euro-disco", "eurobeat", "hi nrg", "italodance", "eurodance",
    ],
    "Industrial": [
        "industrial", "ebm", "new beat", "power electronics", "rhythmic noise", "noise", "darkwave",
        "coldwave",
    ],
    "Experimental": [
        "experimental", "idm", "glitch", "abstract", "leftfield", "musique concrète", "sound collage",
        "chiptune",
    ],
}
# Styles whose keystone overrides their parent.
OVERRIDES = {
    "trap": "Trap", "hip hop": "Hip Hop", "new wave": "Rock", "neofolk": "Folk",
    "modern classical": "Classical", "latin": "Latin", "lo-fi": "Lo-Fi",
}
# Names only people type.
TYPED_NAMES = {
    "trap wave": "Dubstep", "phonk": "Trap", "drift phonk": "Trap", "wave": "Downtempo",
    "hardwave": "Hard Dance", "colour bass": "Dubstep", "color bass": "Dubstep",
    "melodic dubstep": "Dubstep", "riddim": "Dubstep", "tearout": "Dubstep", "liquid": "Drum n Bass",
    "neurofunk": "Drum n Bass", "jump up": "Drum n Bass", "afro house": "House", "amapiano": "House",
    "melodic techno": "Techno", "chillhop": "Lo-Fi",
}
# Rock styles that are metal or punk without saying so.
METAL_EXTRA = [
    "thrash", "sludge", "doom", "deathcore", "mathcore", "noisecore", "djent", "stoner rock",
    "crossover thrash",
]
PUNK_EXTRA = [
    "emo", "psychobilly", "oi", "crust", "hardcore", "post-hardcore", "melodic hardcore", "screamo",
    "powerviolence", "power violence",
]
# Parents that are keystones as they stand.
PARENT_KEYSTONES = [
    "Hip Hop", "Jazz", "Funk / Soul", "Pop", "Latin", "Reggae", "Blues", "Classical", "Stage & Screen",
    "Brass & Military", "Children's",
]
# Blends with a name of their own (unordered pairs).
FUSION_NAMES = [
    ("Dubstep", "Drum n Bass", "Drumstep"),
    ("House", "Disco", "Disco House"),
    ("Dubstep", "Trap", "Hybrid Trap"),
    ("House", "Breakbeat", "Breakbeat House"),
]
# The tiers above a keystone and their display order.
ARCHGENRE_OF = {
    "Dubstep": "Bass", "Drum n Bass": "Bass", "Halftime": "Bass", "Trap": "Bass", "Breakbeat": "Bass",
    "Ambient": "Chill", "Downtempo": "Chill", "Lo-Fi": "Chill",
    "Experimental": "Experimental", "Industrial": "Experimental",
}
STANDALONE = ["House", "Techno", "Trance", "Hard Dance", "Electro", "Disco"]
FAMILIES = {
    "Dance": ["House", "Techno", "Trance", "Hard Dance", "Disco", "Electro"],
    "Bass": ["Dubstep", "Drum n Bass", "Halftime", "Trap", "Breakbeat"],
    "Chill": ["Ambient", "Downtempo", "Lo-Fi"],
    "Experimental": ["Experimental", "Industrial"],
}
OTHER = "Other"
FAMILY_ORDER = ["Dance", "Bass", "Chill", "Experimental", "Other"]
# Conventional tempo range per keystone.
CANONICAL_BPM = {
    "House": (115, 132), "Techno": (130, 150), "Trance": (128, 150), "Dubstep": (138, 142),
    "Drum n Bass": (160, 180), "Halftime": (140, 175), "Hard Dance": (150, 200),
    "Breakbeat": (120, 140), "Electro": (110, 135), "Trap": (140, 160), "Downtempo": (80, 115),
    "Ambient": (60, 120), "Industrial": (110, 140), "Experimental": (90, 160), "Disco": (100, 125),
}
# Near-synonym styles pooled by the sibling lens.
SIBLINGS = {
    "House": [
        "House", "Tribal House", "Deep House", "Tech House", "Progressive House", "Electro House",
        "Garage House", "Italo House", "Euro House", "Hard House", "Ghetto House", "Speed Garage",
    ],
    "Trance": [
        "Trance", "Tech Trance", "Hard Trance", "Progressive Trance", "Goa Trance", "Psy-Trance", "Hands Up",
    ],
    "Techno": ["Techno", "Hard Techno", "Minimal Techno", "Dub Techno", "Deep Techno", "Schranz"],
    "Drum n Bass": ["Drum n Bass", "Jungle", "Halftime", "Breakcore", "Neurofunk"],
    "Hardcore": [
        "Hardcore", "Gabber", "Speedcore", "Happy Hardcore", "Makina", "Jumpstyle", "Hardstyle", "Terrorcore",
    ],
    "Breaks": ["Breaks", "Progressive Breaks", "Breakbeat"],
    "Dubstep": ["Dubstep", "Brostep"],
    "Ambient": ["Ambient", "Dark Ambient", "Drone", "Berlin-School", "New Age"],
}


def map_column(table: dict, kind: str = "string") -> Column:
    """A fixed table as one map literal: constant-folded, so it costs nothing per row to build."""
    return F.from_json(F.lit(json.dumps(table, sort_keys=True)), f"map<string,{kind}>")


def style_table() -> dict[str, str]:
    """Electronic style to keystone."""
    return {s: k for k, styles in ELECTRONIC.items() for s in styles}


def sibling_table() -> dict[str, str]:
    return {m.lower(): canon for canon, members in SIBLINGS.items() for m in members}


def family_table() -> dict[str, str]:
    return {k: f for f, ks in FAMILIES.items() for k in ks}


def archgenre_order(extra: list[str] | None = None, leading: list[str] | None = None) -> list[str]:
    """Display order of archgenres: the user's own order first, then the built-in one."""
    groups = list(dict.fromkeys([*ARCHGENRE_OF.values(), *(a for a in extra or [] if a)]))
    built_in = [*STANDALONE, *groups, OTHER]
    return list(dict.fromkeys([*(a for a in leading or [] if a != OTHER), *built_in]))


def canonical_bpm_dim(
    spark: SparkSession, table: dict[str, tuple[float, float]] = CANONICAL_BPM
) -> DataFrame:
    """Conventional tempo ranges, one row per keystone."""
    return spark.createDataFrame(
        [(k, float(lo), float(hi)) for k, (lo, hi) in sorted(table.items())], "keystone string, lo double, hi double"
    )
