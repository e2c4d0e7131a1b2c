"""Licence scans by sentence rules, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import text_or_empty

#: Normalised sentences of licences, by identifier. One identifier may have several.
SENTENCES = [
    ("MitRef", "released under the mit license"),
    ("MitRef", "licensed under the mit license"),
    ("MitRef", "this project is licensed under the mit license"),
    ("MitRef", "distributed under the mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitNotice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("AsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("NotLiable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("ApacheRef", "licensed under the apache license version 2 0"),
    ("ApacheRef", "this work is licensed under the apache license version 2 0"),
    ("ApacheRef", "released under the apache license version 2 0"),
    ("ApacheHead", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("ApacheHead2", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheCopy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheUnless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("BsdRedist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdNames", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdAds", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BsdRef", "licensed under the bsd license"),
    ("Bsd2Ref", "licensed under the bsd 2 clause license"),
    ("Bsd3Ref", "licensed under the bsd 3 clause license"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("IscRef", "licensed under the isc license"),
    ("GplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("Gpl2Free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("LgplFree", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GnuHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GnuSee", "see the gnu general public license for more details"),
    ("Gpl3Ref", "this work is licensed under the gnu general public license version 3"),
    ("Gpl3Ref", "licensed under the gnu general public license version 3"),
    ("Gpl2Ref", "this work is licensed under the gnu general public license version 2"),
    ("Gpl2Ref", "licensed under the gnu general public license version 2"),
    ("LgplRef", "licensed under the gnu lesser general public license version 3"),
    ("AgplRef", "licensed under the gnu affero general public license version 3"),
    ("MplRef", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MplRef", "licensed under the mozilla public license version 2 0"),
    ("CcByRef", "licensed under cc by 4 0"),
    ("CcByRef", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CcBySaRef", "licensed under cc by sa 4 0"),
    ("CcByNcRef", "licensed under cc by nc 4 0"),
    ("CcByNcSaRef", "licensed under cc by nc sa 4 0"),
    ("CcByNdRef", "licensed under cc by nd 4 0"),
    ("Cc0Ref", "licensed under cc0 1 0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Reserved", "all rights reserved"),
]

#: Licences as ordered identifiers; earlier rules take their sentences first.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "AsIs", "NotLiable"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("Apache-2.0", ["ApacheHead", "ApacheCopy", "ApacheUnless", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheHead2", "ApacheCopy", "ApacheUnless", "ApacheSee"]),
    ("BSD-4-Clause", ["BsdRedist", "BsdSource", "BsdBinary", "BsdAds", "BsdNames", "BsdAsIs"]),
    ("BSD-3-Clause", ["BsdRedist", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs"]),
    ("BSD-2-Clause", ["BsdRedist", "BsdSource", "BsdBinary", "BsdAsIs"]),
    ("ISC", ["IscGrant", "IscAsIs"]),
    ("GPL-3.0-or-later", ["GplFree", "GnuHope", "GnuSee"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-2.0-or-later", ["Gpl2Free", "GnuHope", "GnuSee"]),
    ("GPL-2.0-or-later", ["Gpl2Free"]),
    ("LGPL-3.0-or-later", ["LgplFree"]),
    ("MIT", ["MitRef"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("BSD-3-Clause", ["Bsd3Ref"]),
    ("BSD-2-Clause", ["Bsd2Ref"]),
    ("BSD", ["BsdRef"]),
    ("ISC", ["IscRef"]),
    ("GPL-3.0", ["Gpl3Ref"]),
    ("GPL-2.0", ["Gpl2Ref"]),
    ("LGPL-3.0", ["LgplRef"]),
    ("AGPL-3.0", ["AgplRef"]),
    ("MPL-2.0", ["MplRef"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSaRef"]),
    ("CC-BY-ND-4.0", ["CcByNdRef"]),
    ("CC0-1.0", ["Cc0Ref"]),
    ("Unlicense", ["Unlicense"]),
    ("All-rights-reserved", ["Reserved"]),
]

#: Where a sentence ends: at a line break, or at a mark that a blank follows.
SENTENCE_END = r"\n+|[.!?;:]+[ \t]+"
#: Words that only mark a line as a comment; marks without letters go with normalisation.
COMMENT_WORD = r"(?im)^[ \t]*(?:dnl|@?rem)[ \t]+"
#: A piece that is nothing but an address.
ADDRESS = r"^[^A-Za-z0-9]*(?:https?://|www\.)\S+\s*$"
#: Numbers of lists, within normalised text.
NUMBER = "(?:[0-9]{1,3}|[a-z]|[ivx]{2,4})"


def anchor_words(sentences: list[tuple[str, str]]) -> list[str]:
    """Few words that every given sentence contains one of, chosen greedily."""
    left, chosen = {s for _, s in sentences}, []
    while left:
        counts: dict[str, int] = {}
        for s in left:
            for w in {w for w in s.split() if len(w) >= 5} or set(s.split()):
                counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (-counts[w], w))
        chosen.append(best)
        left = {s for s in left if best not in s.split()}
    return chosen


def normalised(sentence: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _marks(identifiers: list[str]) -> str:
    return "".join(f"<{x}>" for x in identifiers)


def _pattern(sentences: list[str]) -> str:
    """Any of the sentences, the longest first, over any number of whole pieces."""
    longest = sorted(set(sentences), key=lambda x: (-len(x), x))
    spelled = "|".join(x.replace(" ", "(?: \\|)? ") for x in longest)
    return f"(?<=^|\\| )((?:{NUMBER} )?)({spelled})(?= \\||$)"


def _pieces(text: Column) -> Column:
    """Normalised pieces of a text with ' | ' between them; those without words are left out.

    Addresses are written as ~, so that they are not words.
    """
    lines = F.regexp_replace(F.regexp_replace(text, "[\\x0B\\f\\r]", "\n"), COMMENT_WORD, "")
    pieces = F.transform(
        F.split(lines, SENTENCE_END),
        lambda x: F.when(x.rlike(ADDRESS), F.lit("~")).otherwise(normalised(x)),
    )
    return F.array_join(F.filter(pieces, lambda x: x != ""), " | ")


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: list[tuple[str, str]] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
) -> DataFrame:
    """Licences of every row of ``docs``.

    Returns ``doc_id, sentence_ids, licenses, unmatched``: the identifiers found, in the order
    of the text, as ``<A><B>``, with ``<?>`` where other sentences stand between two; the
    licences whose rules they satisfy, in the order of the rules; and what no rule took. A
    NULL, empty or licence-free text has empty values.

    A known sentence may run over several pieces, as in wrapped and commented notices and where
    it holds marks itself; it starts and ends where pieces do, and the longest is taken. Numbers
    and addresses between two sentences are no other sentence.

    Rules are sequences without gaps. They are tried in their order, and each takes its sentences
    away, so a longer licence is not read as a shorter one. Most texts have none of a
    few words that every known sentence needs, and are not split. Nothing is shuffled. The
    tables of rules are constants and go into the plan.
    """
    text = text_or_empty(text_col)
    lower = F.lower(text)
    hopeful = reduce(lambda a, b: a | b, [lower.contains(w) for w in anchor_words(sentences)])
    pattern = _pattern([s for _, s in sentences])
    names = F.create_map(*[F.lit(x) for i, s in sentences for x in (s, i)])
    # what stands before, between and after the sentences is at the even places
    parts = F.split(F.regexp_replace("_pieces", pattern, "$1<$2<"), "<")
    gap = lambda i: F.get("_parts", i)
    strange = lambda g: F.exists(
        F.split(g, "\\|"), lambda x: ~F.btrim(x).rlike(f"^(?:[0-9~ ]*|{NUMBER})$")
    )
    marked = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.size("_parts") - 2, F.lit(2)),
            lambda i: F.concat(
                F.when((i > 1) & strange(gap(i - 1)), F.lit("<?>")).otherwise(""),
                F.lit("<"),
                F.element_at(names, F.replace(gap(i), F.lit(" |"), F.lit(""))),
                F.lit(">"),
            ),
        ),
        "",
    )
    sequences = (
        docs.select(F.col(id_col).alias("doc_id"), F.when(hopeful, _pieces(text)).alias("_pieces"))
        .select("doc_id", parts.alias("_parts"))
        .select("doc_id", F.when(F.size("_parts") > 2, marked).otherwise("").alias("sentence_ids"))
    )
    left, hits = F.col("sentence_ids"), []
    for name, identifiers in rules:
        marks = F.lit(_marks(identifiers))
        hits.append(F.when(left.contains(marks), F.lit(name)))
        left = F.replace(left, marks, F.lit("<|>"))
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    rest = F.regexp_replace(left, r"<[|?]>", "")
    some = F.col("sentence_ids") != ""
    return sequences.select(
        "doc_id",
        "sentence_ids",
        F.when(some, F.array_join(found, ",")).otherwise("").alias("licenses"),
        F.when(some, rest).otherwise("").alias("unmatched"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    """The same scan as one SQL statement."""
    values = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for i, s in SENTENCES)
    columns = ["ids AS s0"]
    for k, (name, identifiers) in enumerate(RULES):
        marks = _quoted(_marks(identifiers))
        columns.append(f"CASE WHEN contains(s{k}, {marks}) THEN {_quoted(name)} END AS h{k}")
        columns.append(f"replace(s{k}, {marks}, '<|>') AS s{k + 1}")
    last = len(RULES)
    names = ", ".join(f"h{k}" for k in range(last))
    # names keep the order of their first rule
    order = ", ".join(_quoted(n) for n in dict.fromkeys(n for n, _ in RULES))
    return f"""
    WITH t(sentence, identifier) AS (VALUES {values}),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
    a AS (SELECT r, string_split_regex(x, '\\n+|[.!?;:]+[ \\t]+') AS ss FROM d),
    b AS (SELECT r, unnest(ss) AS raw, generate_subscripts(ss, 1) AS pos FROM a),
    c AS (SELECT r, pos, identifier FROM b JOIN t
          ON t.sentence = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))),
    e AS (SELECT r, pos, identifier, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM c),
    f AS (SELECT r, string_agg(CASE WHEN pos - before > 1 THEN '<?>' ELSE '' END
                               || '<' || identifier || '>', '' ORDER BY pos) AS ids FROM e GROUP BY r),
    g AS (SELECT r, ids, {", ".join(columns)} FROM f)
    SELECT d.doc_id, coalesce(ids, '') AS sentence_ids,
           coalesce(array_to_string(list_filter([{order}], lambda n: list_contains([{names}], n)), ','), '')
               AS licenses,
           coalesce(regexp_replace(s{last}, '<[|?]>', '', 'g'), '') AS unmatched
    FROM d LEFT JOIN g ON g.r = d.r
    """
