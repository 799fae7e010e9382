"""Licence recognition: sentences become identifiers, and sequences of identifiers are matched against ordered rules."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, in normalised form (lower case, runs of other characters as one blank).
SENTENCES = [
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "released under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "all rights reserved",
    "released under the apache license version 2 0",
    "licensed under the mit license",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "this work is licensed under the gnu general public license version 2",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "licensed under the gnu lesser general public license version 2 1",
    "licensed under the gnu lesser general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "licensed under the gnu affero general public license version 3",
    "this source code form is subject to the terms of the mozilla public license v",
    "if a copy of the mpl was not distributed with this file you can obtain one at",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "provided that the above copyright notice and this permission notice appear in all copies",
    "the software is provided as is and the author disclaims all warranties with regard to this software",
    "this is free and unencumbered software released into the public domain",
    "anyone is free to copy modify publish use compile sell or distribute this software",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "distributed under the boost software license version 1 0",
    "this software is provided as is without any express or implied warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "licensed under cc0 1 0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "licensed under cc by sa 4 0",
    "licensed under cc by nc sa 4 0",
    "licensed under cc by nd 4 0",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "the contents of this file are subject to the terms of the common development and distribution license",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
]
# Identifiers of an SPDX line.
SPDX = [
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "0BSD", "Unlicense", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "WTFPL", "CDDL-1.0", "PostgreSQL",
]
_FIRST = len(SENTENCES) + 1
SENTENCES += ["spdx license identifier " + " ".join(re.findall("[a-z0-9]+", x.lower())) for x in SPDX]
# Rules in order of precedence: licence, kind, and the sentences (1 is the first above) that must occur in this order.
RULES = [
    ("Apache-2.0", "header", [2, 3, 4, 5, 6]),
    ("Apache-2.0", "header", [2, 3, 5]),
    ("MIT", "text", [8, 9, 10]),
    ("MIT", "text", [8, 9]),
    ("BSD-3-Clause", "text", [18, 19, 20, 21]),
    ("BSD-2-Clause", "text", [18, 19, 20]),
    ("ISC", "text", [36, 37]),
    ("0BSD", "text", [36, 38]),
    ("Unlicense", "text", [39, 40]),
    ("Zlib", "text", [44, 45, 46]),
    ("PostgreSQL", "text", [55]),
    ("WTFPL", "text", [53]),
    ("GPL-3.0-or-later", "header", [12, 13, 14]),
    ("GPL-2.0-or-later", "header", [25, 13, 14]),
    ("MPL-2.0", "header", [34, 35]),
    *[(x, "identifier", [_FIRST + k]) for k, x in enumerate(SPDX)],
    ("Apache-2.0", "notice", [2]),
    ("Apache-2.0", "notice", [1]),
    ("Apache-2.0", "notice", [23]),
    ("MIT", "notice", [7]),
    ("MIT", "notice", [24]),
    ("GPL-3.0-or-later", "notice", [12]),
    ("GPL-2.0-or-later", "notice", [25]),
    ("GPL-2.0-only", "notice", [26]),
    ("GPL-3.0", "notice", [11]),
    ("GPL-2.0", "notice", [27]),
    ("LGPL-2.1-or-later", "notice", [28]),
    ("LGPL-3.0-or-later", "notice", [29]),
    ("LGPL-2.1", "notice", [30]),
    ("LGPL-3.0", "notice", [31]),
    ("AGPL-3.0-or-later", "notice", [32]),
    ("AGPL-3.0", "notice", [33]),
    ("MPL-2.0", "notice", [34]),
    ("Unlicense", "notice", [39]),
    ("EPL-1.0", "notice", [41]),
    ("EPL-2.0", "notice", [42]),
    ("BSL-1.0", "notice", [43]),
    ("CC0-1.0", "notice", [47]),
    ("CC0-1.0", "notice", [48]),
    ("CC-BY-NC-SA-4.0", "notice", [51]),
    ("CC-BY-NC-4.0", "notice", [15]),
    ("CC-BY-SA-4.0", "notice", [49]),
    ("CC-BY-SA-4.0", "notice", [50]),
    ("CC-BY-ND-4.0", "notice", [52]),
    ("CC-BY-4.0", "notice", [16]),
    ("CC-BY-4.0", "notice", [17]),
    ("CDDL-1.0", "notice", [54]),
    ("proprietary", "notice", [22]),
]


def sentences(text: Column) -> Column:
    """Normalised sentences: cut after . ! ? and white space, and at line ends; empty ones left out."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))), lambda s: s != "")


def known_pattern(known: list[str]) -> str:
    """A pattern that finds the longest known sentence at a place, as a tree of words."""
    tree: dict = {}
    for sentence in known:
        at = tree
        for word in sentence.split(" "):
            at = at.setdefault(word, {})
        at[""] = {}

    def of(node: dict, lead: str) -> str:
        each = [lead + w + of(rest, " ") for w, rest in sorted(node.items(), reverse=True) if w]
        if not each:
            return ""
        inside = each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"
        return f"(?:{inside})?" if "" in node else inside

    return rf"\b(?:{of(tree, '')})\b"


def gate_words(known: list[str]) -> list[str]:
    """A few words, of which every known sentence has one."""
    left, gate = [set(s.split(" ")) for s in known], []
    while left:
        count = Counter(w for s in left for w in s if len(w) > 5)  # short words are everywhere
        count = count or Counter(w for s in left for w in s)
        best = min(count, key=lambda w: (-count[w], w))
        gate.append(best)
        left = [s for s in left if best not in s]
    return gate


def identify(text: Column, known: list[str]) -> Column:
    """The identifier (from 1) of each known sentence, in order, the longest where several begin.

    A sentence may be wrapped over lines, with marks of comments before them, and be part of a longer one;
    only . ! ? before white space end it. Texts without any of a few words that known sentences have are
    not looked into.
    """
    if not known:
        return F.array().cast("array<int>")
    marked = F.regexp_replace(F.translate(text, "\x01", " "), r"([.!?])[\x20\x09-\x0D]+", "$1\x01")
    normalised = F.regexp_replace(F.lower(marked), "[^a-z0-9\x01]+", " ")
    found = F.regexp_extract_all(normalised, F.lit(known_pattern(known)), F.lit(0))
    table = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*[F.lit(i + 1) for i in range(len(known))]))
    gate = F.lower(text).rlike("|".join(gate_words(known)))
    return F.when(gate, F.transform(found, lambda s: F.element_at(table, s))).otherwise(F.array().cast("array<int>"))


def _matches(sequence: Column, ids: list[int]) -> Column:
    """Whether the identifiers occur in ``sequence`` (",1,5,") in this order, others between them allowed."""
    return sequence.rlike("," + ",(?:[0-9]+,)*".join(map(str, ids)) + ",")


def scan(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, known: list[str] = SENTENCES, rules: list[tuple] = RULES
) -> DataFrame:
    """Licences of each text: row (struct of ``keep``, all columns by default), n_sentences, sequence, licence, kind, licences.

    ``sequence`` holds the identifiers found, as ",1,5,"; ``licence`` and ``kind`` are of the first rule
    that matches (null if none), ``licences`` all licences with a matching rule, in the rules' order. A
    null text counts as empty and has none. Every row gives one row, repeated ones too; an empty table
    gives none. ``n_sentences`` counts line ends as ends of sentences, ``sequence`` does not. Nothing is shuffled; the tables of sentences and rules are part of the plan.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"),
        F.size(sentences(t)).cast("long").alias("n_sentences"),
        identify(t, known).alias("ids"),
    )
    joined = F.when(F.size("ids") > 0, F.concat(F.lit(","), F.array_join(F.col("ids").cast("array<string>"), ","), F.lit(","))).otherwise("")
    rows = rows.select("row", "n_sentences", joined.alias("sequence"))
    found = [F.when(_matches(F.col("sequence"), ids), F.struct(F.lit(name).alias("licence"), F.lit(kind).alias("kind"))) for name, kind, ids in rules]
    rows = rows.withColumn("found", F.when(F.col("sequence") != "", F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.select(
        "row",
        "n_sentences",
        "sequence",
        F.get("found", F.lit(0))["licence"].alias("licence"),
        F.get("found", F.lit(0))["kind"].alias("kind"),
        F.coalesce(F.array_join(F.array_distinct(F.transform("found", lambda x: x["licence"])), ","), F.lit("")).alias("licences"),
    )
