"""Licence recognition by sentence rules, in DataFrame functions only and without a shuffle.

Texts are normalised to lower-case words with marks where a sentence or a line ends. A known licence
sentence is recognised where it begins behind a mark and ends before one; line ends inside it don't
matter, so notices may be wrapped in any way and stand in comments. The identifiers found, in text
order, are matched against licence rules, each a sequence of identifiers; rules stand in order of
precedence.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Families of licence names: (name as written, licence), from which the one-line forms are made. Fixed values.
NAMED = {
    "mit": "MIT", "apache 2 0": "Apache-2.0", "apache license version 2 0": "Apache-2.0", "bsd": "BSD", "bsd 2 clause": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause", "simplified bsd": "BSD-2-Clause", "new bsd": "BSD-3-Clause", "modified bsd": "BSD-3-Clause", "isc": "ISC", "zlib": "Zlib",
    "boost software license version 1 0": "BSL-1.0", "mozilla public license 2 0": "MPL-2.0", "mozilla public license version 2 0": "MPL-2.0",
    "eclipse public license 2 0": "EPL-2.0", "eclipse public license version 2 0": "EPL-2.0", "eclipse public license 1 0": "EPL-1.0",
    "gnu general public license version 2": "GPL-2.0-only", "gnu general public license version 3": "GPL-3.0-only", "gpl v2": "GPL-2.0-only", "gpl v3": "GPL-3.0-only",
    "gnu general public license version 2 or later": "GPL-2.0-or-later", "gnu general public license version 3 or later": "GPL-3.0-or-later",
    "gnu lesser general public license version 2 1": "LGPL-2.1-only", "gnu lesser general public license version 3": "LGPL-3.0-only", "lgpl v2 1": "LGPL-2.1-only", "lgpl v3": "LGPL-3.0-only",
    "gnu affero general public license version 3": "AGPL-3.0-only", "agpl v3": "AGPL-3.0-only", "unlicense": "Unlicense", "artistic license 2 0": "Artistic-2.0",
}
#: What may stand before such a name. Fixed values.
LEADS = ("licensed under the", "released under the", "distributed under the", "this work is licensed under the", "this project is licensed under the", "this software is licensed under the", "available under the")
#: Creative Commons kinds, by abbreviation. Fixed values.
COMMONS = {
    "by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives",
}
VERSIONS = ("4 0", "3 0")

#: Known sentences of longer notices, normalised to lower-case letters and digits between single spaces. Fixed values.
NOTICES = {
    "apache-notice": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-obtain-s": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-none": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-event": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-none": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zero-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-free-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-only-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "gpl-only-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "lgpl-free-2": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-free-3": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-free-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-terms-1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "boost-see": "distributed under the boost software license version 1 0",
    "zlib-none": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "apache-line": "licensed under the apache license version 2 0",
    "rights-reserved": "all rights reserved",
}

#: (licence, identifiers that must follow one another among the known sentences) of notices, by precedence. Fixed values.
NOTICE_RULES = (
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-obtain", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-obtain-s", "apache-basis", "apache-see")),
    ("AGPL-3.0-or-later", ("agpl-free-3", "gpl-hope", "agpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-free-2", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl-free-3", "lgpl-hope", "lgpl-see")),
    ("GPL-3.0-or-later", ("gpl-free-3", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope", "gpl-see")),
    ("GPL-2.0-only", ("gpl-only-2", "gpl-hope", "gpl-see")),
    ("GPL-3.0-only", ("gpl-only-3", "gpl-hope", "gpl-see")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("zero-grant",)),
    ("MPL-2.0", ("mpl-terms", "mpl-copy")),
    ("MPL-2.0", ("mpl-terms", "mpl-copy-s")),
    ("EPL-2.0", ("epl-terms",)),
    ("EPL-1.0", ("epl-terms-1",)),
    ("BSL-1.0", ("boost-see",)),
    ("Zlib", ("zlib-none", "zlib-grant")),
    ("Unlicense", ("unlicense",)),
)
LAST_RULES = (("Apache-2.0", ("apache-line",)), ("BSD", ("bsd-grant",)), ("proprietary", ("rights-reserved",)))


def _tables() -> tuple[dict[str, str], tuple]:
    """(identifier: sentence, rules): the notices and every one-line form, which are made from the names."""
    sentences, lines = dict(NOTICES), []

    def add(words: str, licence: str) -> None:
        if words not in sentences.values():
            name = words.replace(" ", "-")
            sentences[name] = words
            lines.append((licence, (name,)))

    for lead in LEADS:
        for name, licence in NAMED.items():
            for end in ("",) if "license" in name or re.search(r" v\d", name) else (" license", " licence"):
                add(f"{lead} {name}{end}", licence)
    for short, kind in COMMONS.items():
        for version in VERSIONS:
            licence = f"CC-{short.upper().replace(' ', '-')}-{version.replace(' ', '.')}"
            add(f"licensed under cc {short} {version}", licence)
            for port in ("international", "unported"):
                add(f"this work is licensed under a creative commons {kind} {version} {port} license", licence)
                add(f"licensed under the creative commons {kind} {version} {port} license", licence)
    add("licensed under cc0 1 0", "CC0-1.0")
    add("this work is licensed under the gnu general public license version 3", "GPL-3.0-only")
    return sentences, (*NOTICE_RULES, *lines, *LAST_RULES)


SENTENCES, RULES = _tables()

#: Marks of ends of sentences and of lines, as tokens of their own.
_STOP, _LINE = "\u0001", "\u0002"


def _choice(sentences, gap: str) -> str:
    """A regular expression for any of the sentences, the longest first, with `gap` between words; common beginnings are tried once."""
    tree: dict = {}
    for s in sentences:
        at = tree
        for word in s.split(" "):
            at = at.setdefault(word, {})
        at[""] = {}

    def written(at: dict) -> str:
        ends = "" in at
        ways = [w + (gap + rest if (rest := written(below)) and "" not in below else f"(?:{gap}{rest})?" if rest else "") for w, below in sorted(at.items()) if w]
        return "" if not ways else ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return written(tree)


def _signs(sentences) -> list[str]:
    """A few beginnings of words of which every sentence holds one: a text without any of them holds no sentence."""
    left = [{w[:5] if len(w) > 5 else w for w in s.split(" ")} for s in sentences]
    out = []
    while left:
        words = sorted({w for s in left for w in s}, key=lambda w: (len(w) < 5 or w == "under", -sum(w in s for s in left), w))
        out.append(words[0])
        left = [s for s in left if out[-1] not in s]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """doc_id, n_known, sentence_ids, licenses and license of every row, from its whole text.

    A sentence ends at . ! or ? before a blank or the end, but not behind a single letter; lines end there and at : and ; too. A known sentence must begin and end at the end
    of a sentence or line, and the longest is taken.
    sentence_ids holds the identifiers in text order and licenses the licences of all rules that match,
    in order of precedence, both joined by commas; license is the first of them or null. Null and empty
    texts hold none. Repeated rows give a result row each, empty tables none; further columns don't
    matter. The sentence table is configuration: it is compiled into the plan and may hold some hundred
    entries.
    """
    known = sentences or SENTENCES
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("low"))
    shown = reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in _signs(known.values())])
    text = F.when(shown, F.col("low"))  # null, and null through all that follows, where no sentence can be
    text = F.regexp_replace(text, r"[.!?](?<![^a-z0-9_][a-z].)(?<!^[a-z].)[.!?]*(?=[ \t\n\r\f]|$)", _STOP)
    text = F.regexp_replace(text, r"[\n\r\f]+|[:;]+(?=[ \t\n\r\f]|$)", _LINE)
    text = F.regexp_replace(text, f"[^a-z0-9{_STOP}{_LINE}]+", " ")
    # runs of marks become one, a stop where there is one; each pass takes time in proportion to the text
    text = F.regexp_replace(text, f"{_LINE}[{_LINE} ]*+", f"{_LINE} ")
    text = F.regexp_replace(text, f"{_STOP}[{_STOP}{_LINE} ]*+", f"{_STOP} ")
    text = F.regexp_replace(text, f" ?{_LINE} ?{_STOP} ?", f"{_STOP} ")
    text = F.concat(F.lit(f"{_STOP} "), F.regexp_replace(text, f" ?([{_STOP}{_LINE}]) ?", " $1 "), F.lit(f" {_STOP}"))
    pattern = f"[{_STOP}{_LINE}] {{1,2}}({_choice(known.values(), f'(?: {_LINE})? ')})(?= {{1,2}}[{_STOP}{_LINE}])"
    found = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
    names = F.create_map(*[F.lit(x) for k, v in known.items() for x in (v, k)])
    rows = rows.select("doc_id", F.transform(found, lambda s: F.replace(s, F.lit(f" {_LINE}"), F.lit(""))).alias("found"))
    rows = rows.select("doc_id", F.array_compact(F.transform("found", lambda s: F.try_element_at(names, s))).alias("ids"))
    chain = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    rows = rows.withColumn("chain", chain)
    several = [F.when(F.contains("chain", F.lit("," + ",".join(seq) + ",")), F.lit(i)) for i, (_, seq) in enumerate(rules) if len(seq) > 1]
    # rules of one sentence are a lookup, which keeps the plan small
    single = {seq[0]: i for i, (_, seq) in reversed(list(enumerate(rules))) if len(seq) == 1}
    single = F.create_map(*[F.lit(x) for pair in (single or {"": 0}).items() for x in pair])
    places = F.concat(F.array_compact(F.array(*several, F.lit(None).cast("int"))), F.array_compact(F.transform("ids", lambda s: F.try_element_at(single, s))))
    titles = F.array(*[F.lit(name) for name, _ in rules])
    rows = rows.select("doc_id", "ids", F.array_distinct(F.transform(F.array_sort(places), lambda i: F.element_at(titles, i + 1))).alias("found"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("found", ",").alias("licenses"), F.try_element_at("found", F.lit(1)).alias("license"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned; nulls, repeats and empty tables as scan() says."""
    return scan(table(spark, sf_dir, "documents"))


def _duck() -> str:
    """The same in DuckDB, by another way: runs of lines of each sentence are looked up in a table of known sentences."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    rules = ", ".join(f"({i}, '{name}', ',{','.join(seq)},')" for i, (name, seq) in enumerate(RULES))
    most = max(len(s.split(" ")) for s in SENTENCES.values())
    return f"""
WITH known(id, words) AS (VALUES {known}), rules(place, license, chain) AS (VALUES {rules}),
s AS (
  SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z]|[a-z0-9_][a-z])[.!?]+([ \\t\\n\\r\\f]|$)', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents
), st AS (
  SELECT doc_id, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS sn FROM s
), ln AS (
  SELECT doc_id, sn, list_filter(list_transform(regexp_split_to_array(regexp_replace(s, '[:;]+([ \\t\\n\\r\\f]|$)', chr(10), 'g'), '[\\n\\r\\f]+'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS l FROM st
), a AS (
  SELECT doc_id, sn, l, unnest(range(1, len(l) + 1)) AS i FROM ln
), runs AS (
  SELECT doc_id, sn, i, unnest(range(i, least(len(l), i + {most}) + 1)) AS j, l FROM a
), hit AS (
  SELECT doc_id, sn, i, max(j) AS j, max_by(id, j) AS id FROM runs JOIN known ON known.words = array_to_string(l[i:j], ' ') GROUP BY doc_id, sn, i
), free AS (
  SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit g WHERE g.doc_id = h.doc_id AND g.sn = h.sn AND g.i < h.i AND g.j >= h.i)
), ids AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY sn, i) AS ids FROM free GROUP BY doc_id
), m AS (
  SELECT doc_id, license, min(place) AS place FROM ids JOIN rules ON contains(',' || ids || ',', chain) GROUP BY doc_id, license
), f AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY place) AS licenses, min_by(license, place) AS license FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, license
FROM documents d LEFT JOIN ids USING (doc_id) LEFT JOIN f USING (doc_id)
"""


OP4_SQL = _duck()
