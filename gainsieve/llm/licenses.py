"""Licence scan by sentence rules: normalised sentences become identifiers, identifier sequences match ordered licence rules.

A text is cut into sentences, sentences are normalised (lower case, runs of anything but letters and digits become one
space), and a sentence that contains a known phrase gets that phrase's identifier. The identifiers in order of the text are
matched against the rules in order; what a rule matches is used up, so a general rule sees only what the specific ones
before it left. Everything is one expression for each row: no shuffle, and only DataFrame functions. Texts that hold none of a
few words are not cut into sentences at all, and a rule is matched in one pass over the identifiers without going back, so the
time for a text grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised, and their identifiers. Of the phrases that a
# sentence contains all count, in this order.
PHRASES: list[tuple[str, str]] = [
    ("under the apache license version 2 0", "apache2_notice"),
    ("under the terms of the apache license version 2 0", "apache2_notice"),
    ("you may not use this file except in compliance with the license", "apache2_comply"),
    ("you may obtain a copy of the license at", "obtain_copy"),
    ("distributed on an as is basis without warranties or conditions of any kind", "apache2_as_is"),
    ("under the gnu general public license version 3", "gpl3_notice"),
    ("under the gnu general public license version 2", "gpl2_notice"),
    ("under the gnu lesser general public license", "lgpl_notice"),
    ("under the gnu affero general public license", "agpl_notice"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl_terms"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl_terms"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl_terms"),
    ("either version 3 of the license or at your option any later version", "version3_later"),
    ("either version 2 of the license or at your option any later version", "version2_later"),
    ("without even the implied warranty of merchantability or fitness for a particular purpose", "gnu_no_warranty"),
    ("you should have received a copy of the gnu", "gnu_copy"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit_grant"),
    ("the above copyright notice and this permission notice shall be included in all copies", "mit_notice"),
    ("the software is provided as is without warranty of any kind", "mit_as_is"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc_grant"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd_grant"),
    ("redistributions of source code must retain the above copyright notice", "bsd_source"),
    ("redistributions in binary form must reproduce the above copyright notice", "bsd_binary"),
    ("may be used to endorse or promote products derived from this software", "bsd_endorse"),
    ("this software is provided by the copyright holders and contributors as is", "bsd_as_is"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl2_notice"),
    ("under the mozilla public license version 2 0", "mpl2_notice"),
    ("under the mit license", "mit_name"),
    ("under the mit licence", "mit_name"),
    ("under the terms of the mit license", "mit_name"),
    ("under the terms of the mit licence", "mit_name"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("spdx license identifier mit", "spdx_mit"),
    ("spdx license identifier apache 2 0", "spdx_apache2"),
    ("spdx license identifier gpl 3 0", "spdx_gpl3"),
    ("spdx license identifier mit or apache 2 0", "spdx_apache2"),
    ("spdx license identifier apache 2 0 or mit", "spdx_mit"),
    ("all rights reserved", "all_rights"),
    ("cc0 1 0", "cc0"),
    ("has waived all copyright and related or neighboring rights to", "cc0"),
]

# Creative Commons: code, the names of its conditions in the long form, and versions.
_NC, _SA, _ND = ["noncommercial", "non commercial"], ["sharealike", "share alike"], ["noderivatives", "no derivatives", "noderivs"]
CC_KINDS: dict[str, list[str]] = {
    "by": [""],
    "by nc": _NC,
    "by sa": _SA,
    "by nd": _ND,
    "by nc sa": [f"{a} {b}" for a in _NC for b in _SA],
    "by nc nd": [f"{a} {b}" for a in _NC for b in _ND],
}
CC_VERSIONS = ["4 0", "3 0", "2 5", "2 0"]
CC: list[tuple[str, str]] = [(k, v) for v in CC_VERSIONS for k in CC_KINDS]


def _cc_id(kind: str, version: str) -> str:
    return f"cc_{kind}_{version}".replace(" ", "_")


for _kind, _version in CC:
    _long = [" ".join(f"creative commons attribution {c} {_version}".split()) for c in CC_KINDS[_kind]]
    PHRASES += [(p, _cc_id(_kind, _version)) for p in (f"cc {_kind} {_version}", f"creative commons {_kind} {_version}", *_long)]

#: SPDX names besides the three above. A name that another begins with is known in that one too, so rules take the longer first.
SPDX = ["BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "GPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
SPDX_LONGER = {
    "MIT-0": "spdx_mit", "GPL-2.0-or-later": "spdx_gpl_2_0", "GPL-3.0-or-later": "spdx_gpl3", "LGPL-2.0-or-later": "spdx_lgpl_2_0",
    "LGPL-2.1-or-later": "spdx_lgpl_2_1", "LGPL-3.0-or-later": "spdx_lgpl_3_0", "AGPL-3.0-or-later": "spdx_agpl_3_0",
}


def _spdx_words(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


def _spdx_id(name: str) -> str:
    return f"spdx_{_spdx_words(name)}".replace(" ", "_")


PHRASES += [(f"spdx license identifier {_spdx_words(n)}", _spdx_id(n)) for n in [*SPDX, *SPDX_LONGER]]

# Rules in order: a licence and the identifiers that must follow each other, others between them allowed.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2_notice", "apache2_comply"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("Apache-2.0", ["spdx_apache2"]),
    ("AGPL-3.0-or-later", ["agpl_terms", "version3_later"]),
    ("AGPL", ["agpl_terms"]),
    ("AGPL", ["agpl_notice"]),
    ("LGPL", ["lgpl_terms"]),
    ("LGPL", ["lgpl_notice"]),
    ("GPL-3.0-or-later", ["gpl_terms", "version3_later"]),
    ("GPL-2.0-or-later", ["gpl_terms", "version2_later"]),
    ("GPL", ["gpl_terms"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("GPL-2.0", ["gpl2_notice"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is"]),
    ("MIT", ["mit_name"]),
    ("ISC", ["isc_grant"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MPL-2.0", ["mpl2_notice"]),
    *[(_cc_id(k, v).upper().replace("_", "-")[: -len(v)] + v.replace(" ", "."), [_cc_id(k, v)]) for k, v in CC],
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["all_rights"]),
    # after the rules above, so that hardly anything is left between a name and its longer form
    *[(n, [short, _spdx_id(n)]) for n, short in SPDX_LONGER.items()],
    ("MIT", ["spdx_mit"]),
    ("GPL-3.0", ["spdx_gpl3"]),
    *[(n, [_spdx_id(n)]) for n in SPDX],
]

#: Every phrase has one of these, which are looked for before a sentence is normalised: single words, or words with any gap
#: that normalising closes.
HINT = "(?i)licen[sc]|permission|redistribution|copyright|warrant|unencumbered|endorse|reserved|received|creative|cc0|cc[^A-Za-z0-9]+by"
#: A text in which HINT matches has one of these in lower case.
HINT_WORDS = ["licens", "licenc", "permission", "redistribution", "copyright", "warrant", "unencumbered", "endorse", "reserved", "received", "creative", "cc"]
#: Ends of sentences: a stop and space, or an empty line. A single line end is a space, so wrapped notices are whole. The
#: word 'v.' ends none ('Mozilla Public License, v. 2.0').
PARAGRAPH, STOP = r"[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*", r"([!?;]|(?:^|[^vV])\.|[A-Za-z0-9][vV]\.)[ \t\r\n]+"
MARK = "\x01"


def sentences(text: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(text, PARAGRAPH, MARK), STOP, f"$1{MARK}")
    return F.split(cut, MARK, -1)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in its order."""
    hinted = F.filter(sentences(F.coalesce(text, F.lit(""))), lambda s: s.rlike(HINT))
    known = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("id")) for p, i in PHRASES])
    padded = F.transform(hinted, lambda s: F.concat(F.lit(" "), normalised(s), F.lit(" ")))
    return F.flatten(F.transform(padded, lambda s: F.transform(F.filter(known, lambda k: F.contains(s, F.concat(F.lit(" "), k["phrase"], F.lit(" ")))), lambda k: k["id"])))


# Identifiers stand in a string with a comma on each side of every one (",a,,b,"), so neighbouring matches share none.


def _pattern(ids: list[str]) -> str:
    """The first identifier, and the nearest others in order, with anything between."""
    return ".*?".join(f",{i}," for i in ids)


def _one_pass(ids: list[str]) -> str:
    """As _pattern, for an engine that backtracks: what is found is kept, and where the others do not follow the first, they follow
    no later one either, so all the rest is taken as group 1, which replaces itself."""
    if len(ids) == 1:
        return f",{ids[0]},"
    return f",{ids[0]}," + "".join(f"(?>.*?,{i},)" for i in ids[1:]) + f"|(,{ids[0]},.*)"


def matched(df: DataFrame, ids: str, used: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """df with _licenses: names of the licences whose rules match the list column ids, each once, in order of the rules.

    Rules are applied one after the other to a string of the identifiers; a rule takes away all that it matches.
    """
    rest = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    zero = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f",{p[0]},").alias("first"), F.lit(_one_pass(p)).alias("pattern"), F.lit("$1" if len(p) > 1 else "").alias("left")) for n, p in used])

    def step(state: Column, rule: Column) -> Column:
        # bound to a name by a list of one, else the replacement would be made twice
        after = F.transform(F.array(F.regexp_replace(state["rest"], rule["pattern"], rule["left"])), lambda r: F.when(
            r != state["rest"], F.struct(r.alias("rest"), F.array_union(state["found"], F.array(rule["name"])).alias("found"))
        ).otherwise(state))[0]
        return F.when(F.contains(state["rest"], rule["first"]), after).otherwise(state)

    none = F.array().cast("array<string>")
    return df.withColumn("_licenses", F.when(F.size(ids) > 0, F.aggregate(rules, zero, step)["found"]).otherwise(none))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_known (known sentences), sentence_ids and licenses (comma-joined, empty if none).

    Null and empty texts have no sentence and no licence. Whole texts of any length are scanned; the same notice twice is two
    identifiers and one licence. Nothing is compared between rows, so there are no ties; repeated rows and null ids are rows like
    any other, an empty table gives none, and other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    hinted = F.lit(False)
    for word in HINT_WORDS:
        hinted = hinted | F.contains("low", F.lit(word))
    none = F.array().cast("array<string>")
    ids = own.select("doc_id", "text", hinted.alias("hinted")).select("doc_id", F.when(F.col("hinted"), sentence_ids(F.col("text"))).otherwise(none).alias("_ids"))
    return matched(ids, "_ids").select(
        "doc_id", F.size("_ids").cast("long").alias("n_known"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join("_licenses", ",").alias("licenses")
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"{{'phrase': {quote(p)}, 'id': {quote(i)}}}" for p, i in PHRASES)
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(RULES, 1):
        p = quote(_pattern(ids))
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, regexp_replace(rest, {p}, '', 'g') AS rest, CASE WHEN regexp_matches(rest, {p}) AND NOT list_contains(found, {quote(name)})"
            f" THEN list_append(found, {quote(name)}) ELSE found END AS found FROM r{k - 1})"
        )
        last = f"r{k}"
    return f"""
WITH s AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{PARAGRAPH}', chr(1), 'g'), '{STOP}', '\\1' || chr(1), 'g'), chr(1)) AS sentences FROM documents
), n AS (
  SELECT doc_id, list_transform(list_filter(sentences, lambda x: regexp_matches(x, '{HINT}')), lambda x: ' ' || trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) || ' ') AS padded FROM s
), i AS (
  SELECT doc_id, flatten(list_transform(padded, lambda x: list_transform(list_filter([{known}], lambda k: contains(x, ' ' || k.phrase || ' ')), lambda k: k.id))) AS ids FROM n
), r0 AS (
  SELECT doc_id, ids, ',' || array_to_string(ids, ',,') || ',' AS rest, []::VARCHAR[] AS found FROM i
), {', '.join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses FROM {last}
"""


LICENSE_SQL = _sql()
