"""Licence scans by sentence rules (DataFrame functions only).

Texts are cut into normalised sentences. Known licence sentences have numbers, all others have 0; a
document becomes the sequence of its numbers, and ordered licence rules, each a run of numbers, are matched against it.
The table of sentences is of fixed size and stands in the plan as a literal map: nothing is shuffled.

Defined cases: null and empty texts have no sentences; repeated sentences count as often as they stand; sentences that are
part of a longer unknown sentence are not recognised; where a licence's run holds another's, the longer rule wins; very long texts are read whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, whole_text

# Sentences of public licences, normalised (lower case, words of letters and digits).
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    10: "licensed under the apache license version 2 0",
    11: "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    12: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    13: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    14: "see the license for the specific language governing permissions and limitations under the license",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    23: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    24: "see the gnu general public license for more details",
    25: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    26: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    27: "see the gnu lesser general public license for more details",
    28: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    29: "see the gnu affero general public license for more details",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    33: "this work is licensed under a creative commons attribution 4 0 international license",
    34: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    35: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    36: "this work is licensed under a creative commons attribution 3 0 unported license",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "this source code form is subject to the terms of the mozilla public license v",
    51: "2 0",
    60: "this is free and unencumbered software released into the public domain",
    70: "spdx license identifier mit",
    71: "spdx license identifier apache 2 0",
    72: "spdx license identifier gpl 3 0 only",
    73: "spdx license identifier gpl 3 0 or later",
    74: "spdx license identifier gpl 2 0 only",
    75: "spdx license identifier gpl 2 0 or later",
    76: "spdx license identifier bsd 3 clause",
    77: "spdx license identifier bsd 2 clause",
    78: "spdx license identifier mpl 2 0",
    79: "spdx license identifier unlicense",
    80: "spdx license identifier isc",
    81: "spdx license identifier cc by 4 0",
    82: "spdx license identifier cc by sa 4 0",
    83: "spdx license identifier mit or apache 2 0",
    84: "spdx license identifier lgpl 2 1 only",
    85: "spdx license identifier lgpl 2 1 or later",
    86: "spdx license identifier agpl 3 0 only",
    87: "spdx license identifier agpl 3 0 or later",
    88: "spdx license identifier bsl 1 0",
    89: "spdx license identifier zlib",
    90: "licensed under cc by nc sa 4 0",
    91: "licensed under cc by nd 4 0",
    92: "licensed under cc by nc nd 4 0",
    93: "licensed under cc0 1 0",
    100: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    101: "distributed under the boost software license version 1 0",
}
# Further published forms of a sentence, under its number.
FORMS = (
    (5, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement"),
    (12, "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    (33, "this work is licensed under the creative commons attribution 4 0 international license"),
    (35, "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    (43, "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (43, "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (43, "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (43, "neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (43, "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    (83, "spdx license identifier apache 2 0 or mit"),
    (100, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)
KNOWN = (*SENTENCES.items(), *FORMS)
# Ordered rules, licence and the run of sentence numbers that it asks for.
RULES = (
    ("mit", (1,)), ("mit", (2,)), ("mit", (3, 4, 5)),
    ("apache-2.0", (10,)), ("apache-2.0", (11, 12, 13, 14)),
    ("gpl-3.0", (20,)), ("gpl-3.0", (21, 23, 24)), ("gpl-2.0", (22, 23, 24)),
    ("cc-by-nc-4.0", (30,)), ("cc-by-nc-4.0", (34,)), ("cc-by-4.0", (31,)), ("cc-by-4.0", (33,)), ("cc-by-sa-4.0", (32,)),
    ("bsd-3-clause", (40, 41, 42, 43)), ("bsd-2-clause", (40, 41, 42)),
    ("mpl-2.0", (50, 51)), ("unlicense", (60,)),
    ("mit", (70,)), ("apache-2.0", (71,)), ("gpl-3.0", (72,)), ("gpl-3.0", (73,)), ("gpl-2.0", (74,)), ("gpl-2.0", (75,)),
    ("bsd-3-clause", (76,)), ("bsd-2-clause", (77,)), ("mpl-2.0", (78,)), ("unlicense", (79,)), ("isc", (80,)), ("isc", (100,)),
    ("cc-by-4.0", (81,)), ("cc-by-sa-4.0", (82,)), ("cc-by-nc-sa-4.0", (90,)), ("cc-by-nd-4.0", (91,)), ("cc-by-nc-nd-4.0", (92,)), ("cc0-1.0", (93,)),
    ("lgpl-2.1", (25, 26, 27)), ("lgpl-2.1", (84,)), ("lgpl-2.1", (85,)), ("agpl-3.0", (28, 23, 29)), ("agpl-3.0", (86,)), ("agpl-3.0", (87,)),
    ("cc-by-sa-4.0", (35,)), ("cc-by-3.0", (36,)), ("mit", (83,)), ("apache-2.0", (83,)), ("bsl-1.0", (88,)), ("bsl-1.0", (101,)), ("zlib", (89,)),
)
LICENCES = tuple(dict.fromkeys(name for name, _ in RULES))


def written_run(run: tuple[int, ...]) -> str:
    return "," + ",".join(map(str, run)) + ","


def longer_runs(name: str, run: tuple[int, ...]) -> list[str]:
    """Runs of other licences that hold this one: where they stand, the longer rule wins."""
    return [written_run(r) for n, r in RULES if n != name and len(r) > len(run) and written_run(run) in written_run(r)]


def sentences(text: Column) -> Column:
    """Normalised sentences in order, without empty ones. A sentence ends at a line's end, or at . ! ? before white space."""
    ends = F.regexp_replace(ascii_lower(text), r"[.!?]+[ \t\r\n]+|[.!?]+$|\n", "\u0001")
    return _pieces(ends)


def _pieces(ends: Column) -> Column:
    words = F.regexp_replace(ends, "[^a-z0-9\u0001]+", " ")
    return F.filter(F.transform(F.split(words, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def unwrapped_sentences(text: Column) -> Column:
    """Normalised sentences of hard-wrapped text: a line's end is a space, except at an empty line or after a colon.

    Comment marks, bullets and list numbers at the start of a line go, and a web address joins the line that leads to it.
    """
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(text), r"\r\n?", "\n"), r"(?m)^[ \t]*+(?:(?:/\*+|\*+/?|//+|#+|;+|--?|\u2022|>)(?=[ \t\n]|$))?[ \t]*+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?m)[ \t]++$", ""), r"(^|[.:;!?]\n|\n\n)\(?[0-9]{1,2}[.)][ \t]+", "$1")
    plain = F.regexp_replace(plain, r"\bat:?\n+(?=https?://)", "at ")
    return _pieces(F.regexp_replace(plain, r"[.!?]+[ \t\n]+|[.!?]+$|:\n|\n\n+", "\u0001"))


def numbers(found: Column) -> Column:
    """The number of each sentence: known ones theirs, others 0."""
    known = F.create_map(*chain.from_iterable((F.lit(s), F.lit(n)) for n, s in KNOWN))
    return F.transform(found, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, known (their numbers in order), licences (in rule order, comma-joined).

    Sentences and known ones are those of the reading by lines; a licence counts if a rule fits that reading or the unwrapped one.
    """
    numbered = docs.select(F.col("doc_id").cast("long"), numbers(sentences(whole_text())).alias("n"), numbers(unwrapped_sentences(whole_text())).alias("u"))

    # Each reading is one sequence per document, as text; a run of unknown sentences separates what stands around it.
    def sequence(n):
        return F.concat(F.lit(","), F.array_join(n, ","), F.lit(","))

    both = F.concat(sequence("n"), F.lit(";"), sequence("u"))
    table = numbered.select("doc_id", F.size("n").alias("n_sentences"), F.filter("n", lambda x: x != 0).alias("k"), both.alias("sequence"))

    def has(name, run):
        left = F.col("sequence")
        for longer in longer_runs(name, run):
            left = F.replace(left, F.lit(longer), F.lit(","))
        return F.contains(left, F.lit(written_run(run)))

    found = []
    for name in LICENCES:
        match = F.lit(False)
        for rule, run in RULES:
            match = match | has(name, run) if rule == name else match
        found.append(F.when(match, F.lit(name)))
    return table.select("doc_id", "n_sentences", F.array_join("k", ",").alias("known"), F.array_join(F.filter(F.array(*found), lambda x: x.isNotNull()), ",").alias("licences"))
