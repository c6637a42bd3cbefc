"""Licence recognition by sentences and rules, in DataFrame operations only.

Wrapped lines are joined, without comment markers, unless only the line alone is a known sentence.
A text is cut into sentences, which are normalised (lower case, words and version numbers only) and
mapped to identifiers of known licence sentences; a run of other sentences becomes ``~``. Then the
rules are tried in their order on the sequence of identifiers. A rule that matches takes its
sentences away from later ones, so a full licence text is not reported again by a part of it.
Sentences that no rule explains are reported as ``UNKNOWN``.

The SQL is a simpler reading: it ends sentences at each newline, and needs the word licence or the
like. It gives equal results where no licence is wrapped or named by Creative Commons alone.

Texts without a trigger word are not cut at all, and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRANT = (
    "(?:this (?:work|file|software|program|project|code|library|document|text|content|page|article|package|module"
    "|repository|crate|plugin|tool|app|application|source code) is )?"
    "(?:licensed|released|distributed|published|available|made available|provided) under (?:the )?"
    "(?:terms (?:and conditions )?of )?(?:the )?(?:an? )?"
)
_SPDX = "spdx license identifier "
_CC = f"(?:{_GRANT})?creative commons attribution "

# Normalised sentences of licence notices, with what they are called; a group holds a
# version that becomes part of the name.
SENTENCES = (
    ("DUALREF", _GRANT + "(?:either of )?(?:the )?apache license (?:v|version )?2\\.0.* or .*mit license.*"),
    ("DUALREF", _GRANT + "(?:either of )?(?:the )?mit license.* or .*apache license (?:v|version )?2\\.0.*"),
    ("DUALREF", _SPDX + "(?:mit or apache 2\\.0|apache 2\\.0 or mit)"),
    ("APACHEREF", _SPDX + "apache ([12]\\.[01])"),
    ("MITREF", _SPDX + "mit"),
    ("ISCREF", _SPDX + "isc"),
    ("BSDREF", _SPDX + "bsd ([234]) clause"),
    ("LGPLREF", _SPDX + "lgpl ([23]\\.[01])(?: only| or later)?"),
    ("AGPLREF", _SPDX + "agpl ([13]\\.0)(?: only| or later)?"),
    ("GPLREF", _SPDX + "gpl ([123]\\.0)(?: only| or later)?"),
    ("MPLREF", _SPDX + "mpl ([12]\\.[01])"),
    ("EPLREF", _SPDX + "epl ([12]\\.0)"),
    ("BSLREF", _SPDX + "bsl (1\\.0)"),
    ("CC0REF", _SPDX + "cc0 (1\\.0)"),
    ("UNLICENSE", _SPDX + "unlicense"),
    ("APACHEREF", _GRANT + "apache(?: software)? license (?:v|version )?([12]\\.[01])"),
    ("APACHEREF", "licensed under the apache license version ([12]\\.[01]) the license"),
    ("APACHEUSE", "you may not use this file except in compliance with the license"),
    ("APACHECOPY", "you may obtain a copy of the license at.*"),
    ("APACHEBASIS", "unless required by applicable law or agreed to in writing.*distributed under the license.*"),
    ("APACHESEE", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITREF", _GRANT + "mit(?: open source)? license"),
    ("MITREF", "(?:the )?mit license(?: mit)?"),
    ("MITREF", "(?:this (?:project|software|package|code|library) is )?mit licensed"),
    ("ISCREF", _GRANT + "isc license"),
    ("MITGRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MITNOTICE", "the above copyright notice and this permission notice shall be included in all copies.*"),
    ("ISCGRANT", "permission to use copy modify and or distribute this software for any purpose.*"),
    ("BSDREF", _GRANT + "bsd ([234]) clause license"),
    ("BSDGRANT", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BSDSOURCE", "(?:[0-9. ]+)?redistributions of source code must retain the above copyright notice.*"),
    ("BSDBINARY", "(?:[0-9. ]+)?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDNAME", "(?:[0-9. ]+)?neither the names? of .* endorse or promote products.*"),
    ("ASIS", "th(?:e|is) software is provided (?:by .* )?as is .*"),
    ("NOLIABILITY", "in no event shall .* liable .*"),
    ("LGPLREF", _GRANT + "gnu (?:lesser|library) general public license (?:v|version )?([23](?:\\.[01])?)(?: or .*later.*)?"),
    ("AGPLREF", _GRANT + "gnu affero general public license (?:v|version )?([13](?:\\.0)?)(?: or .*later.*)?"),
    ("GPLREF", _GRANT + "gnu general public license (?:v|version )?([123](?:\\.0)?)(?: or .*later.*)?"),
    ("LGPLREF", f"(?:{_GRANT})?(?:gnu )?lgpl ?(?:v|version )?([23](?:\\.[01])?)(?: or .*later.*| only| license)?"),
    ("AGPLREF", f"(?:{_GRANT})?(?:gnu )?agpl ?(?:v|version )?([13](?:\\.0)?)(?: or .*later.*| only| license)?"),
    ("GPLREF", f"(?:{_GRANT})?(?:gnu )?gpl ?(?:v|version )?([123](?:\\.0)?)(?: or .*later.*| only| license)?"),
    ("GPLFREE", "this (?:program|library|file) is free software"),
    ("GPLTERMS", "you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("GPLVERSION", "either version ([23]) of the license or .*any later version"),
    ("GPLHOPE", "this (?:program|library|file) is distributed in the hope that it will be useful.*"),
    ("GPLSEE", "see the gnu general public license for more details"),
    ("GPLCOPY", "you should have received a copy of the gnu general public license.*"),
    ("MPLREF", _GRANT + "mozilla public license (?:v ?|version )?([12]\\.[01])"),
    ("EPLREF", _GRANT + "eclipse public license (?:v ?|version )?([12]\\.0)"),
    ("BSLREF", f"(?:{_GRANT})?boost software license (?:v|version )?(1\\.0)"),
    ("CCBYNCSAREF", _CC + "non ?commercial share ?alike ([1-4]\\.[05])(?: international| unported)?(?: license)?"),
    ("CCBYNCNDREF", _CC + "non ?commercial no ?derivat(?:ive|e)s ([1-4]\\.[05])(?: international| unported)?(?: license)?"),
    ("CCBYNCREF", _CC + "non ?commercial ([1-4]\\.[05])(?: international| unported)?(?: license)?"),
    ("CCBYSAREF", _CC + "share ?alike ([1-4]\\.[05])(?: international| unported)?(?: license)?"),
    ("CCBYNDREF", _CC + "no ?derivat(?:ive|e)s ([1-4]\\.[05])(?: international| unported)?(?: license)?"),
    ("CCBYREF", _CC + "([1-4]\\.[05])(?: international| unported)?(?: license)?"),
    ("CC0REF", _GRANT + "(?:creative commons )?cc0 ?(1\\.0).*"),
    ("CCBYNCSAREF", _GRANT + "(?:creative commons )?cc by nc sa ([1-4]\\.[05])(?: license)?"),
    ("CCBYNCNDREF", _GRANT + "(?:creative commons )?cc by nc nd ([1-4]\\.[05])(?: license)?"),
    ("CCBYNCREF", _GRANT + "(?:creative commons )?cc by nc ([1-4]\\.[05])(?: license)?"),
    ("CCBYSAREF", _GRANT + "(?:creative commons )?cc by sa ([1-4]\\.[05])(?: license)?"),
    ("CCBYNDREF", _GRANT + "(?:creative commons )?cc by nd ([1-4]\\.[05])(?: license)?"),
    ("CCBYREF", _GRANT + "(?:creative commons )?cc by ([1-4]\\.[05])(?: license)?"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("PUBLICDOMAIN", _GRANT.replace("under", "into") + "public domain"),
    ("RESERVED", "(?:copyright .*)?all rights reserved"),
    ("COPYRIGHT", "copyright (?:c )?[0-9].*"),
)

# Sequences of sentences (== stands between two licences of one notice), in the order in which they are tried, and the licence that they make.
RULES = (
    ("(?:COPYRIGHT )?(?:MITREF )?(?:COPYRIGHT )?MITGRANT MITNOTICE(?: ASIS)?(?: NOLIABILITY)?", "MIT"),
    ("(?:COPYRIGHT )?ISCGRANT(?: ASIS)?(?: NOLIABILITY)?", "ISC"),
    ("(?:COPYRIGHT |RESERVED )*BSDGRANT BSDSOURCE BSDBINARY BSDNAME(?: ASIS)?(?: NOLIABILITY)?", "BSD-3-Clause"),
    ("(?:COPYRIGHT |RESERVED )*BSDGRANT BSDSOURCE BSDBINARY(?: ASIS)?(?: NOLIABILITY)?", "BSD-2-Clause"),
    ("(?:COPYRIGHT )?APACHEREF-([0-9.]+) APACHEUSE(?: APACHECOPY)?(?: APACHEBASIS)?(?: APACHESEE)?", "Apache-{1}"),
    ("(?:COPYRIGHT )?GPLFREE GPLTERMS GPLVERSION-([23])(?: GPLHOPE)?(?: GPLSEE)?(?: GPLCOPY)?", "GPL-{1}.0-or-later"),
    ("UNLICENSE(?: ASIS)?(?: NOLIABILITY)?", "Unlicense"),
    ("DUALREF", "MIT==Apache-2.0"),
    ("APACHEREF-([0-9.]+)", "Apache-{1}"),
    ("MITREF", "MIT"),
    ("ISCREF", "ISC"),
    ("BSDREF-([234])", "BSD-{1}-Clause"),
    ("LGPLREF-([0-9.]+)", "LGPL-{1}"),
    ("AGPLREF-([0-9.]+)", "AGPL-{1}"),
    ("GPLREF-([0-9.]+)", "GPL-{1}"),
    ("MPLREF-([0-9.]+)", "MPL-{1}"),
    ("EPLREF-([0-9.]+)", "EPL-{1}"),
    ("BSLREF-([0-9.]+)", "BSL-{1}"),
    ("CC0REF-([0-9.]+)", "CC0-{1}"),
    ("CCBYNCSAREF-([0-9.]+)", "CC-BY-NC-SA-{1}"),
    ("CCBYNCNDREF-([0-9.]+)", "CC-BY-NC-ND-{1}"),
    ("CCBYNCREF-([0-9.]+)", "CC-BY-NC-{1}"),
    ("CCBYSAREF-([0-9.]+)", "CC-BY-SA-{1}"),
    ("CCBYNDREF-([0-9.]+)", "CC-BY-ND-{1}"),
    ("CCBYREF-([0-9.]+)", "CC-BY-{1}"),
    ("PUBLICDOMAIN", "Public-Domain"),
    ("RESERVED", "All-Rights-Reserved"),
    ("[A-Z0-9]{3,}(?:-[0-9.]+)?", "UNKNOWN"),
)

# Words of which each known sentence has one.
TRIGGERS = (
    "licen", "copyright", "redistribut", "permission", "as is", "liable", "free software",
    "public domain", "rights reserved", "endorse", "in the hope", "any later version",
)
# Those of sentences that name Creative Commons or the GPL without the word licence.
MORE_TRIGGERS = ("cc0", "cc by", "creative commons", "gpl")

# Steps from a wrapped text to sentences (between breaks), which may hold newlines. Paragraphs, list
# items and lines of copyright end a sentence; other newlines do not.
BREAK = "\x01"
UNWRAPPING = (
    ("\\r\\n?", "\n"),
    ("(?i)(spdx-license-identifier):[ \\t]*", "$1 "),
    ("(?m)^[ \\t]*(?:#+|/{2,}|/\\*+|\\*+/|\\*+(?=[ \\t]|$)|--+|;+|%+|<!--|-->|\\x22{3})[ \\t]*", ""),  # comment markers
    ("(?m)[ \\t]*(?:\\*+/|\\*+|#+|-->)[ \\t]*$", ""),
    ("\\b([Aa]t):?\\s+(?=https?://)", "$1 "),  # the address stands in a paragraph of its own
    (",\\s+(?=either\\s+version\\b)", "; "),  # one text of the GPL has a comma, another a semicolon
    (";\\s+(?=without\\s+even\\b)", ", "),
    (
        "(?m)^[ \\t]*((?i:copyright)[ \\t]+(?:(?:\\([cC]\\)|©)[ \\t]*)?[0-9](?:(?![.!?;:][ \\t])[^\\n])*)$",
        f"{BREAK}$1{BREAK}",
    ),
    ("(?m)^[ \\t]*(?=(?:Permission (?:is hereby|to use)|Redistribution and use|Licensed under|Released under)\\b)", BREAK),
    ("\\n[ \\t]*\\n\\s*", BREAK),
    ("\\n[ \\t]*(?:\\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]|[-*•+])[ \\t]+", BREAK),
    ("([.!?;:])[ \\t\\n]+", f"$1{BREAK}"),
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql(dialect: str) -> dict[str, str]:
    """The steps as expressions of Spark SQL or of DuckDB, from the same tables."""
    spark = dialect == "spark"
    raw = "r" if spark else ""
    group = "$" if spark else "\\"
    every = "" if spark else ", 'g'"

    def matches(x: str, pattern: str) -> str:
        return f"({x} RLIKE r{_quoted(pattern)})" if spark else f"regexp_matches({x}, {_quoted(pattern)})"

    def replaced(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {raw}{_quoted(pattern)}, {raw}{_quoted(by)}{every})"

    def extract(x: str, pattern: str) -> str:
        return f"regexp_extract({x}, {raw}{_quoted(pattern)}, 1)"

    words = (*TRIGGERS, *MORE_TRIGGERS) if spark else TRIGGERS
    trigger = " OR ".join(f"contains({{0}}, {_quoted(t)})" for t in words)
    if spark:  # in a text, a trigger of several words may be wrapped or have other signs between them
        phrases = "|".join(t.replace(" ", "[^a-z0-9.]+") for t in words if " " in t)
        wrapped = " OR ".join(f"contains({{0}}, {_quoted(t)})" for t in words if " " not in t)
        in_text = wrapped.format("lower(text)") + f" OR lower(text) RLIKE '{phrases}'"
    else:
        in_text = trigger.format("lower(text)")
    normal = replaced("lower(s)", "licence", "license")
    normal = replaced(normal, "[^a-z0-9.]+", " ")
    normal = replaced(normal, "^[ .]+|[ .]+$", "")
    cases = []
    for name, pattern in SENTENCES:
        whole = f"^(?:{pattern})$"
        with_version = re.compile(pattern).groups > 0 if spark else "([" in pattern.replace("(?:[", "")
        value = f"concat('{name}-', {extract('s', whole)})" if with_version else f"'{name}'"
        cases.append(f"WHEN {matches('s', whole)} THEN {value}")
    named = f"CASE WHEN NOT ({trigger.format('s')}) THEN '~' {' '.join(cases)} ELSE '~' END"
    if spark:
        text = "text"
        for pattern, by in UNWRAPPING:
            text = replaced(text, pattern, by)
        cut = lambda x: f"filter(transform({x}, s -> {normal}), s -> NOT s RLIKE '^[0-9]{{0,2}}$')"
        one_line = f"array_join(transform({cut('array(u)')}, s -> {named}), ' ')"
        # A sentence that is not known as a whole is taken line by line.
        lines = f"array_join(transform({cut('split(u, ' + chr(39) + chr(92) + 'n' + chr(39) + ')')}, s -> {named}), ' ')"
        unit = (
            f"element_at(transform(array({one_line}), "
            f"v -> if(v = '~' AND contains(u, '\\n'), {lines}, v)), 1)"
        )
        ids = f"array_join(filter(transform(split({text}, '{BREAK}'), u -> {unit}), v -> v <> ''), ' ')"
    else:
        lines = replaced("text", "([.!?;:])[ \\t\\n\\r]+", f"{group}1\n")
        sentences = f"list_filter(list_transform(string_split({lines}, chr(10)), lambda s: {normal}), lambda s: s <> '')"
        ids = f"array_to_string(list_transform({sentences}, lambda s: {named}), ' ')"
    sequence = replaced(ids, "~(?: ~)*", "~")
    found = "sequence"
    for pattern, licence in RULES:
        # Marks start with =, so that no later rule sees them as sentences.
        found = replaced(found, f"(^|[ ]){pattern}(?:$|(?=[ ]))" if spark else f"(^|[ ]){pattern}\\b",
                         f"{group}1=" + licence.replace("{1}", f"{group}2") + "=")
    return {
        "trigger": f"({in_text})",
        "sequence": sequence,
        "found": found,
    }


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (in order, joined by ;) and n_licenses of every row.

    A null or empty text has none, as has an ordinary one; repeated
    rows are kept; an empty table gives no rows; other columns are ignored.
    """
    steps = _sql("spark")
    none = F.lit("")
    rows = docs.select("doc_id", "text").withColumn("hit", F.coalesce(F.expr(steps["trigger"]), F.lit(False)))
    return (
        rows.withColumn("sequence", F.when(F.col("hit"), F.expr(steps["sequence"])).otherwise(none))
        .withColumn("found", F.when(F.col("hit"), F.expr(steps["found"])).otherwise(none))
        .withColumn("names", F.regexp_extract_all("found", F.lit("=([^=]+)="), F.lit(1)))
        .select(
            "doc_id",
            F.when(F.col("sequence") == "~", none).otherwise(F.col("sequence")).alias("sentence_ids"),
            F.array_join("names", ";").alias("licenses"),
            F.size("names").alias("n_licenses"),
        )
    )


_DUCK = _sql("duckdb")
SQL = f"""
WITH a AS (SELECT doc_id, text, coalesce({_DUCK["trigger"]}, false) AS hit FROM documents),
b AS (SELECT doc_id, hit, CASE WHEN hit THEN {_DUCK["sequence"]} ELSE '' END AS sequence FROM a),
c AS (SELECT doc_id, sequence, CASE WHEN hit THEN {_DUCK["found"]} ELSE '' END AS found FROM b),
d AS (SELECT doc_id, sequence, regexp_extract_all(found, '=([^=]+)=', 1) AS names FROM c)
SELECT doc_id, CASE WHEN sequence = '~' THEN '' ELSE sequence END AS sentence_ids,
  coalesce(array_to_string(names, ';'), '') AS licenses, CAST(len(names) AS INTEGER) AS n_licenses
FROM d
"""
