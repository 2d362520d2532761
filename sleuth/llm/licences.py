"""Licence scan by sentence rules (SQL functions only).

A text is cut into sentences at full stops and other marks that end one, at blank
lines, and, in a first reading, at every line end; a second reading takes line
ends as spaces, as licence texts are often wrapped. Each sentence is normalised
(letters a-z and digits, single spaces) and looked up among the known licence
sentences; so a text becomes a sequence of sentence identifiers, with ``~`` for
unknown ones. Ordered rules are matched against the sequences: a rule's
identifiers must follow each other with at most ``GAP`` unknown sentences between
two. Texts without any of ``ANCHORS`` hold no known sentence and are not cut; anchors
are single words, as what stands between two words of a sentence may vary.

Defined results: null or empty text, and text without known sentences, has no
licence (empty strings); rows with the same id count each; an empty table gives
no rows; only the id and text columns are read, so others never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

GAP = 2

#: Words of which every known sentence has one.
ANCHORS = ("license", "licence", "copyright", "permission", "warrant", "redistribut", "reserved", "domain", "spdx", "liable", "software")

#: Normalised sentences of licences and notices.
SENTENCES = {
    "all-rights": "all rights reserved",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-notice-3": "this project is licensed under the mit license",
    "mit-title": "mit license",
    "mit-title-2": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-licensed": "licensed under the apache license version 2 0 the license",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-3-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-free": "this program is free software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "ccbync4-notice": "licensed under cc by nc 4 0",
    "ccby4-notice": "licensed under cc by 4 0",
    "ccbysa4-notice": "licensed under cc by sa 4 0",
    "ccby4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
}

#: Rule, licence, sentence identifiers in order.
RULES = (
    ("mit-text", "MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liable")),
    ("mit-text-short", "MIT", ("mit-grant", "mit-keep")),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-notice-2", "MIT", ("mit-notice-2",)),
    ("mit-notice-3", "MIT", ("mit-notice-3",)),
    ("mit-title", "MIT", ("mit-title", "mit-grant")),
    ("mit-title-2", "MIT", ("mit-title-2", "mit-grant")),
    ("mit-spdx", "MIT", ("spdx-mit",)),
    ("isc-text", "ISC", ("isc-grant", "isc-as-is")),
    ("apache-notice", "Apache-2.0", ("apache-notice",)),
    ("apache-header", "Apache-2.0", ("apache-licensed", "apache-may-not", "apache-obtain", "apache-as-is", "apache-see")),
    ("apache-header-short", "Apache-2.0", ("apache-licensed", "apache-may-not")),
    ("apache-spdx", "Apache-2.0", ("spdx-apache",)),
    ("gpl3-notice", "GPL-3.0", ("gpl3-notice",)),
    ("gpl2-notice", "GPL-2.0", ("gpl2-notice",)),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl-free", "gpl-3-or-later", "gpl-hope", "gpl-implied", "gpl-details")),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl-free", "gpl-2-or-later", "gpl-hope", "gpl-implied", "gpl-details")),
    ("gpl3-spdx", "GPL-3.0-or-later", ("spdx-gpl3",)),
    ("mpl2-notice", "MPL-2.0", ("mpl2-notice",)),
    ("bsd-3", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("bsd-2", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("bsd-3-spdx", "BSD-3-Clause", ("spdx-bsd3",)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("cc-by-nc-work", "CC-BY-NC-4.0", ("ccbync4-work",)),
    ("cc-by-notice", "CC-BY-4.0", ("ccby4-notice",)),
    ("cc-by-work", "CC-BY-4.0", ("ccby4-work",)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("cc-by-sa-work", "CC-BY-SA-4.0", ("ccbysa4-work",)),
    ("unlicense-text", "Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("all-rights", "proprietary", ("all-rights",)),
)

#: No sentence ends at the colon of an SPDX tag, nor at the full stop of "v." before a number.
_ENDS = r"(?!(?<=(?i:spdx-license-identifier)):\s)(?!(?<=\b[vV])\.\s+[0-9])[.!?;:]+(?=\s|$)|\n\s*\n"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentence_ids(text: Column, lines: bool) -> Column:
    """Identifiers of a text's sentences in order, joined with ``|`` (~: unknown)."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    cut = F.split(text, _ENDS + (r"|\n" if lines else ""))
    normal = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    found = F.transform(F.filter(normal, lambda s: s != ""), lambda s: F.coalesce(F.try_element_at(known, s), F.lit("~")))
    return F.concat(F.array_join(found, "|"), F.lit("|"))


def matched(sequence: Column) -> Column:
    """Names of the rules that a sequence of identifiers satisfies."""
    between = rf"(~\|){{0,{GAP}}}"
    patterns = [(name, r"(^|\|)" + (r"\|" + between).join(ids) + r"\|") for name, _, ids in RULES]
    return F.array_compact(F.array(*[F.when(sequence.rlike(p), F.lit(name)) for name, p in patterns]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``sentences`` (known ones of the reading by
    lines, in order), ``rules`` and ``licences`` (names joined with commas)."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    any_anchor = F.lit(False)
    for a in ANCHORS:
        any_anchor = any_anchor | low.contains(a)
    licence_of = F.create_map(*[F.lit(x) for name, licence, _ in RULES for x in (name, licence)])
    both = lambda a, b: F.struct(a.alias("seq"), F.array_sort(F.array_union(matched(a), matched(b))).alias("rules"))
    found = _let(sentence_ids(t, True), lambda a: _let(sentence_ids(t, False), lambda b: F.when(a.rlike("[a-z]") | b.rlike("[a-z]"), both(a, b))))
    rest = [c for c in docs.columns if c not in (text, "sentences", "rules", "licences")]
    x = docs.select(*rest, F.when(any_anchor, found).alias("_f"))
    known = F.filter(F.split(F.col("_f.seq"), r"\|"), lambda s: (s != "~") & (s != ""))
    licences = F.array_sort(F.array_distinct(F.transform("_f.rules", lambda r: F.element_at(licence_of, r))))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return x.select(*rest, joined(known).alias("sentences"), joined(F.col("_f.rules")).alias("rules"), joined(licences).alias("licences"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


OP9_SQL = rf"""
WITH known(sid, s) AS (VALUES {_values(SENTENCES.items())}),
rules(rule, licence, p) AS (VALUES {_values((n, lic, r"(^|\|)" + (r"\|(~\|){0,2}").join(ids) + r"\|") for n, lic, ids in RULES)}),
d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(spdx-license-identifier):(\s)', '\1 \2', 'g'), '\b([vV])\.(\s+[0-9])', '\1 \2', 'g') AS t,
             row_number() OVER () AS k FROM documents),
r AS (SELECT k, 1 AS reading, regexp_split_to_array(regexp_replace(t, '([.!?;:]+)(\s|$)', chr(1) || '\2', 'g'), chr(1) || '|\n\s*\n|\n') AS ss FROM d
      UNION ALL SELECT k, 2, regexp_split_to_array(regexp_replace(t, '([.!?;:]+)(\s|$)', chr(1) || '\2', 'g'), chr(1) || '|\n\s*\n') FROM d),
u AS (SELECT k, reading, i, trim(regexp_replace(lower(ss[i]), '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT k, reading, ss, unnest(range(1, len(ss) + 1)) AS i FROM r)),
n AS (SELECT k, reading, i, coalesce(sid, '~') AS sid FROM u LEFT JOIN known USING (s) WHERE u.s <> ''),
q AS (SELECT k, reading, string_agg(sid, '|' ORDER BY i) || '|' AS seq, string_agg(sid, ',' ORDER BY i) FILTER (sid <> '~') AS known FROM n GROUP BY k, reading),
m AS (SELECT DISTINCT k, rule, licence FROM q, rules WHERE known IS NOT NULL AND regexp_matches(seq, p)),
o AS (SELECT k, string_agg(rule, ',' ORDER BY rule) AS rules FROM m GROUP BY k),
l AS (SELECT k, string_agg(licence, ',' ORDER BY licence) AS licences FROM (SELECT DISTINCT k, licence FROM m) GROUP BY k)
SELECT doc_id, coalesce(q.known, '') AS sentences, coalesce(rules, '') AS rules, coalesce(licences, '') AS licences
FROM d LEFT JOIN q ON q.k = d.k AND reading = 1 LEFT JOIN o ON o.k = d.k LEFT JOIN l ON l.k = d.k
"""

QUERIES = {"op9_licences": op9_licences}
ORACLES = {"op9_licences": OP9_SQL}
