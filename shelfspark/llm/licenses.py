"""Licence recognition: known sentences to identifiers, identifier sequences to licences.

A text is cut into pieces, each is normalised (lower case, only letters, digits and inner dots). A known
licence sentence is one piece, or several in a row where only a line end, ':' or ';' parts them, so that
wrapped texts and headers are read whole; a list number before it is passed over. What remains is a sequence of identifiers, 0 for any
other sentence, against which ordered rules are matched: a rule holds where its identifiers stand
side by side. Rules are tried in their order; where one has matched, its identifiers are used up, so
that a licence whose text includes another's is told from it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licences and of the notices that refer to them, in normalised form.
SENTENCES = {
    1: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    2: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    3: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    4: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    5: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    6: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    7: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    8: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    9: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    10: "licensed under the apache license version 2.0",
    11: "licensed under the apache license version 2.0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at",
    14: "released under the mit license",
    15: "licensed under the mit license",
    16: "this work is licensed under the gnu general public license version 3",
    17: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    18: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    19: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    20: "licensed under cc by nc 4.0",
    21: "licensed under cc by 4.0",
    22: "licensed under cc by sa 4.0",
    23: "this work is licensed under a creative commons attribution 4.0 international license",
    24: "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    25: "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    26: "this is free and unencumbered software released into the public domain",
    27: "spdx license identifier mit",
    28: "spdx license identifier apache 2.0",
    29: "spdx license identifier gpl 3.0 only",
    30: "spdx license identifier gpl 3.0 or later",
    31: "spdx license identifier gpl 2.0 only",
    32: "spdx license identifier bsd 3 clause",
    33: "spdx license identifier bsd 2 clause",
    34: "this source code form is subject to the terms of the mozilla public license v. 2.0",
    35: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
}
#: Licence and the identifiers that must follow one another; the first rule that matches uses them up.
RULES = (
    ("MIT", (1, 2, 3, 4)),
    ("BSD-3-Clause", (5, 6, 7, 8)),
    ("BSD-2-Clause", (5, 6, 7)),
    ("MIT", (1, 2)),
    ("ISC", (9,)),
    ("Apache-2.0", (11, 12, 13)),
    ("Apache-2.0", (11, 12)),
    ("Apache-2.0", (10,)),
    ("MIT", (14,)),
    ("MIT", (15,)),
    ("GPL-3.0-or-later", (17, 19)),
    ("GPL-3.0-or-later", (17,)),
    ("GPL-2.0-or-later", (18, 19)),
    ("GPL-2.0-or-later", (18,)),
    ("GPL-3.0-only", (16,)),
    ("CC-BY-NC-4.0", (20,)),
    ("CC-BY-4.0", (21,)),
    ("CC-BY-SA-4.0", (22,)),
    ("CC-BY-4.0", (23,)),
    ("CC-BY-NC-4.0", (24,)),
    ("CC-BY-SA-4.0", (25,)),
    ("Unlicense", (26,)),
    ("MIT", (27,)),
    ("Apache-2.0", (28,)),
    ("GPL-3.0-only", (29,)),
    ("GPL-3.0-or-later", (30,)),
    ("GPL-2.0-only", (31,)),
    ("BSD-3-Clause", (32,)),
    ("BSD-2-Clause", (33,)),
    ("MPL-2.0", (34,)),
)
#: Every known sentence holds one of these, so texts without any of them need not be cut.
ANCHORS = ("licen", "permi", "software", "redistribution", "warrant")

_BREAK, _OTHER = r"([.!?;:])[\x20\x09-\x0D]+", "[^a-z0-9.]+"


#: Any known sentence, whose words stand in one line or in lines that follow; the longest first.
_KNOWN = "|".join(re.escape(s.replace("v. 2.0", "v.2.0")).replace(r"\ ", r"[ \n]") for s in sorted(SENTENCES.values(), key=len, reverse=True))


def sentences(text: Column) -> Column:
    """Normalised sentences: cut after . ! ? : or ; before white space, and at line ends."""
    lines = F.split(F.regexp_replace(F.lower(text), _BREAK, "$1\n"), "\n")
    return F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _OTHER, " "), r"\.* *$", ""), r"^[ .]+", ""))


def _units(text: Column) -> Column:
    """Known sentences and other pieces in order; a known sentence in several pieces is one unit, list numbers are none.

    Sentence ends and blank lines leave an empty piece, which no known sentence spans.
    """
    ended = F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\n\n")
    pieces = F.concat(F.lit("\n"), F.array_join(sentences(ended), "\n"), F.lit("\n"))
    units = F.regexp_extract_all(pieces, F.lit(rf"(?<=\n)(?:[0-9]{{1,2}} )?({_KNOWN}|[^\n]+)(?=\n)"), F.lit(1))
    return F.filter(F.transform(units, lambda u: F.translate(u, "\n", " ")), lambda u: ~u.rlike("^[0-9]{1,2}$"))


def _without_v(text: Column) -> Column:
    """A version after "v." belongs to its sentence."""
    return F.regexp_replace(text, r"\b([vV])\.[\x20\x09-\x0D]+(?=[0-9])", "$1.")


def recognise(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_known (known sentences) and licences (names in order, `|` between).

    Licences are sorted, each once. Null and empty texts, and texts without a known sentence, have no
    licence: an empty string. A very long text is cut whole. Rows with equal ids stay apart. Other
    columns of docs are not looked at. A map over rows, without shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s.replace("v. 2.0", "v.2.0"), str(i))])
    anchored = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(a)) for a in ANCHORS))
    ids = F.transform(_units(_without_v(text)), lambda s: F.coalesce(F.element_at(known, s), F.lit("0")))
    df = docs.select("doc_id", F.when(anchored, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    df = df.select("doc_id", F.size(F.filter("ids", lambda i: i != "0")).cast("long").alias("n_known"), F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))
    for name, rule in RULES:
        wanted = F.lit("".join(f",{i}," for i in rule))
        df = df.select("doc_id", "n_known", F.when(F.contains("left", wanted), F.replace("left", wanted, F.lit(",;,"))).otherwise(F.col("left")).alias("left"), F.when(F.contains("left", wanted), F.array_append("found", F.lit(name))).otherwise(F.col("found")).alias("found"))
    return df.select("doc_id", "n_known", F.array_join(F.array_sort(F.array_distinct("found")), "|").alias("licences"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return recognise(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quoted = lambda s: "'" + s + "'"
    known = ", ".join(f"({quoted(s.replace('v. 2.0', 'v.2.0'))}, {i})" for i, s in SENTENCES.items())
    step, name = "CASE WHEN contains(left_{n}, {w}) THEN replace(left_{n}, {w}, ',;,') ELSE left_{n} END AS left_{m}", "CASE WHEN contains(left_{n}, {w}) THEN list_append(found_{n}, '{l}') ELSE found_{n} END AS found_{m}"
    steps = ""
    for n, (licence, rule) in enumerate(RULES):
        x = {"n": n, "m": n + 1, "w": quoted("".join(f",{i}," for i in rule)), "l": licence}
        steps += f", r{n + 1} AS (SELECT doc_id, n_known, {step.format(**x)}, {name.format(**x)} FROM r{n})"
    return rf"""
WITH known(s, i) AS (VALUES {known}), lines AS (
  SELECT doc_id, row_number() OVER () AS nr, string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''), '\b([vV])\.[\x20\x09-\x0D]+([0-9])', '\1.\2', 'g')), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS ls FROM documents
), cut AS (
  SELECT doc_id, nr, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM lines
), norm AS (
  SELECT doc_id, nr, pos, regexp_replace(regexp_replace(regexp_replace(l, '[^a-z0-9.]+', ' ', 'g'), '\.* *$', ''), '^[ .]+', '') AS s FROM cut
), seq AS (
  SELECT nr, string_agg(coalesce(i, 0)::VARCHAR, ',,' ORDER BY pos) AS ids, count(i) AS n FROM norm LEFT JOIN known USING (s) WHERE s <> '' GROUP BY nr
), r0 AS (
  SELECT doc_id, coalesce(n, 0) AS n_known, ',' || coalesce(ids, '') || ',' AS left_0, []::VARCHAR[] AS found_0 FROM lines LEFT JOIN seq USING (nr)
){steps}
SELECT doc_id, n_known, array_to_string(list_sort(list_distinct(found_{len(RULES)})), '|') AS licences FROM r{len(RULES)}
"""


ORACLE = _oracle()
