"""Licence scan: known licence sentences become identifiers, and ordered rules match their sequence.

Everything happens inside the row, so the scan shuffles nothing. Only texts with
one of a few trigger words are split into sentences. Sentences may wrap: a single
line break, with comment marks or not, counts as a blank.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences after "licensed under the" and the like, normalised, and the licence they stand for.
TITLES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "MIT": ["mit license"],
    "ISC": ["isc license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "Unlicense": ["unlicense"],
    "EPL-1.0": ["eclipse public license v1 0", "eclipse public license 1 0", "eclipse public license version 1 0"],
    "EPL-2.0": ["eclipse public license v2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "eclipse public license version 2 0"],
    "MPL-1.1": ["mozilla public license version 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"],
    "EUPL-1.2": ["european union public licence 1 2", "european union public licence v 1 2", "european union public licence version 1 2"],
    "CDDL-1.0": ["common development and distribution license version 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "AFL-3.0": ["academic free license version 3 0"],
    "OSL-3.0": ["open software license version 3 0"],
    "ECL-2.0": ["educational community license version 2 0"],
    "OFL-1.1": ["sil open font license version 1 1"],
    "MS-PL": ["microsoft public license"],
    "PostgreSQL": ["postgresql license"],
    "UPL-1.0": ["universal permissive license version 1 0"],
    "ODbL-1.0": ["open database license", "open data commons open database license"],
    "MulanPSL-2.0": ["mulan psl v2"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
}
# Licences that come in versions, each alone or with all later ones.
GNU = {
    "GPL": ("gnu general public license", ["2.0", "3.0"]),
    "LGPL": ("gnu lesser general public license", ["2.1", "3.0"]),
    "AGPL": ("gnu affero general public license", ["3.0"]),
}
# Identifiers that "SPDX-License-Identifier" names, besides those above.
SPDX = ["0BSD", "Apache-1.1", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-4-Clause", "CDDL-1.1", "LGPL-2.0-or-later", "MIT-0", "NCSA", "Python-2.0", "WTFPL", "X11", "ZPL-2.1"]
# Normalised licence sentences (lower case, single blanks, letters and digits only) and their identifiers.
# A sentence of a text may contain several known ones.
PHRASES = [
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "distributed on an as is basis without warranties or conditions of any kind"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("AsIs", "the software is provided as is without warranty of any kind"),
    ("ISCGrant", "permission to use copy modify and or distribute this software for any purpose"),
    ("BSDIntro", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("BSDNames", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSLGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose"),
    ("Unencumbered", "free and unencumbered software released into the public domain"),
    ("GPLTerms", "under gnu general public license"),
    ("LGPLTerms", "under gnu lesser general public license"),
    ("AGPLTerms", "under gnu affero general public license"),
    ("GPL3Version", "either version 3 of the license or at your option any later version"),
    ("GPL2Version", "either version 2 of the license or at your option any later version"),
    ("LGPL21Version", "either version 2 1 of the license or at your option any later version"),
    ("MPL2", "subject to the terms of the mozilla public license v 2 0"),
    ("CC0", "dedicated to the public domain under cc0 1 0"),
]
# Identifiers of the names of some licences; those of others are made from the licence.
NAMED = {"Apache-2.0": "ApacheName", "MIT": "MITName", "CC-BY-4.0": "CCBY4", "CC-BY-SA-4.0": "CCBYSA4", "CC-BY-NC-4.0": "CCBYNC4", "GPL-2.0": "GPL2", "GPL-3.0": "GPL3", "LGPL-2.1": "LGPL21", "LGPL-3.0": "LGPL3", "AGPL-3.0": "AGPL3"}
IDENTIFIER = "spdx license identifier"


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def _versions() -> dict[str, list[str]]:
    """Titles of the licences that come in versions."""
    out = {}
    for family, (title, versions) in GNU.items():
        for version in versions:
            short = version.removesuffix(".0").replace(".", " ")
            alone = [f"{title} {v}" for v in (f"version {short}", f"version {_plain(version)}", f"v{short}", f"v{_plain(version)}")]
            out[f"{family}-{version}"] = list(dict.fromkeys(alone))
            later = [f"{x} {y}" for x in out[f"{family}-{version}"] for y in ("or later", "or any later version", "or at your option any later version")]
            out[f"{family}-{version}-or-later"] = later
    return out


def _identifier(licence: str) -> str:
    return NAMED.get(licence) or "Named" + re.sub("[^A-Za-z0-9]", "", licence)


_titles = TITLES | _versions()
_spdx = {name: name for name in [*_titles, *SPDX]} | {f"{name}-only": name for name in _versions() if not name.endswith("later")}
#: (identifier, sentence), long sentences before those they contain.
SENTENCES = sorted(
    [
        *PHRASES,
        *[(_identifier(name), f"under {title}") for name, titles in _titles.items() for title in titles],
        *[("Spdx" + re.sub("[^A-Za-z0-9]", "", name), f"{IDENTIFIER} {_plain(written)}") for written, name in _spdx.items()],
    ],
    key=lambda x: (-len(x[1]), x[1]),
)
# Sequences of identifiers and the licence they stand for. Earlier rules take their sentences first; the
# identifiers of a rule must follow each other in order, with other known sentences in between allowed only if repeated.
# Then every name and every SPDX identifier stands for its licence.
RULES = [
    (["BSDIntro", "BSDSource", "BSDBinary", "BSDNames"], "BSD-3-Clause"),
    (["BSDIntro", "BSDSource", "BSDBinary"], "BSD-2-Clause"),
    (["MITGrant", "MITNotice", "AsIs"], "MIT"),
    (["MITGrant", "MITNotice"], "MIT"),
    (["ISCGrant"], "ISC"),
    (["BSLGrant", "AsIs"], "BSL-1.0"),
    (["BSLGrant"], "BSL-1.0"),
    (["ZlibAsIs", "ZlibGrant"], "Zlib"),
    (["Unencumbered", "AsIs"], "Unlicense"),
    (["Unencumbered"], "Unlicense"),
    (["ApacheName", "ApacheCopy", "ApacheAsIs"], "Apache-2.0"),
    (["ApacheName", "ApacheCopy"], "Apache-2.0"),
    (["GPLTerms", "GPL3Version"], "GPL-3.0-or-later"),
    (["GPLTerms", "GPL2Version"], "GPL-2.0-or-later"),
    (["LGPLTerms", "LGPL21Version"], "LGPL-2.1-or-later"),
    (["LGPLTerms", "GPL3Version"], "LGPL-3.0-or-later"),
    (["LGPLTerms", "GPL2Version"], "LGPL-2.0-or-later"),
    (["AGPLTerms", "GPL3Version"], "AGPL-3.0-or-later"),
    (["MPL2"], "MPL-2.0"),
    (["CC0"], "CC0-1.0"),
    *[([_identifier(name)], name) for name in _titles],
    *[(["Spdx" + re.sub("[^A-Za-z0-9]", "", name)], name) for name in dict.fromkeys(_spdx.values())],
]
#: Every known sentence has one of these, so texts without them are not split.
TRIGGERS = r"(?i)licen[cs]e|permission|redistribution|warrant|public|\bcc\W+by\b|\bcc0\b|commons|mulan"
#: What comes before the name of a licence.
UNDER = r"\b((licensed|released|distributed|available|published) under ((the|a) )?(terms of )?|under the terms of )((the|a) )?"
#: Sentence punctuation, but for the stop of "v." and the colon of an SPDX line, and blank lines, which may have comment marks.
SENTENCE_END = r"(?i)(?<!\bv)(?<!-identifier)[.!?;:]+[ \t\r\n]|\n[^\p{L}\p{N}\n]*(?=\n)"


def normal(sentence: Column) -> Column:
    """Lower case, other characters than letters and digits as single blanks, a plus after a version in words, one form of "licensed under"."""
    later = F.regexp_replace(F.lower(sentence), r"([0-9])\+", "$1 or later")
    plain = F.regexp_replace(F.trim(F.regexp_replace(later, "[^a-z0-9]+", " ")), UNDER, "under ")
    # each identifier of an SPDX expression on its own
    each = F.regexp_replace(F.regexp_replace(plain, " (or|and) ", f" {IDENTIFIER} "), f" {IDENTIFIER} later", " or later")
    return F.when(F.contains(plain, F.lit(IDENTIFIER)), each).otherwise(plain)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    sentences = F.transform(F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(TRIGGERS)), normal)
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES for x in (sentence, name)])
    anyone = F.lit(r"\b(?:" + "|".join(sentence for _, sentence in SENTENCES) + r")\b")
    found = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, anyone, F.lit(0))))
    return F.transform(found, lambda s: known[s])


def apply_rules(ids: Column) -> Column:
    """(found, rest): licences in the order of the rules, and identifiers that no rule took.

    The sequence is written as ``<A><B>`` and rules take their parts out of it.
    """
    start = F.struct(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("rest"), F.lit("").alias("found"))
    rules = F.array(*[F.struct(F.lit("".join(f"(<{i}>)+" for i in seq)).alias("p"), F.lit(name).alias("n")) for seq, name in RULES])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.rlike(acc["rest"], rule["p"])
        more = F.concat(acc["found"], F.lit("|"), rule["n"], F.lit("|"))
        return F.struct(
            F.when(hit, F.regexp_replace(acc["rest"], rule["p"], F.lit("/"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit & ~F.contains(acc["found"], F.concat(F.lit("|"), rule["n"], F.lit("|"))), more).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(rules, start, step)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array), licences (array, in the order of the rules), leftover (known sentences no rule took).

    One row per row of ``docs``. Texts without known sentences, empty and null
    ones have empty arrays; ids may be null or repeated; an empty table gives no rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<string>")
    ids = docs.select(F.col(f"`{key}`").alias("doc_id"), F.when(body.rlike(TRIGGERS), identifiers(body)).otherwise(none).alias("sentence_ids"))
    ruled = ids.withColumn("_r", F.when(F.size("sentence_ids") > 0, apply_rules(F.col("sentence_ids"))))
    split = lambda c, by: F.when(F.col("_r").isNull(), none).otherwise(F.filter(F.split(c, by), lambda x: x != ""))
    return ruled.select(
        "doc_id", "sentence_ids", split(F.col("_r.found"), r"\|+").alias("licences"), split(F.col("_r.rest"), r"[<>/]+").alias("leftover")
    )
