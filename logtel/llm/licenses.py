"""Licence scan by sentence rules.

A text is cut into sentences, and each is normalised: lower case, everything
but letters a to z and digits as one space. Sentences known from licences and
licence notices have identifiers; the others have none. What is left of a
text is its sequence of identifiers, and ordered rules turn parts of it into
licences: an earlier rule takes its identifiers, so a longer licence is not
also seen as the shorter one it contains. Known sentences that no rule takes
are counted as unmatched.

A sentence may end with its line or run over several, so a text is cut both
ways, and the licences of either sequence count.

DataFrame functions only, one pass, no shuffle. Results by case: a null text
is an empty one; a text without a known sentence has no licence; licences are
listed once, in order of name; repeated rows are scanned one by one; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of licences and notices, by identifier.
SENTENCES = {
    "mit-named": [
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the mit license",
        "this software is released under the mit license",
        "distributed under the mit license",
    ],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
        "so subject to the following conditions",
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement",
    ],
    "apache-named": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license 2 0",
        "this project is licensed under the apache license 2 0",
    ],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-as-is": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl3-named": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
        "this project is licensed under the gnu gpl v3",
    ],
    "gpl2-named": [
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
    ],
    "gpl-free": ["this program is free software"],
    "gpl3-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
    ],
    "gpl2-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version",
    ],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
    ],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
    ],
    "bsd-names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by-named": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-sa-named": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc-by-nc-named": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc0-named": ["licensed under cc0 1 0", "released under cc0 1 0 into the public domain"],
    "all-rights": ["all rights reserved"],
    "spdx": ["spdx license identifier"],
    "tag-mit": ["mit"],
    "tag-apache": ["apache 2 0"],
    "tag-gpl3": ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "tag-bsd3": ["bsd 3 clause"],
}

# Identifiers in order, and the licence they make; an earlier rule goes first.
RULES = [
    (["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], "BSD-3-Clause"),
    (["bsd-grant", "bsd-source", "bsd-binary"], "BSD-2-Clause"),
    (["mit-grant", "mit-notice", "mit-as-is"], "MIT"),
    (["mit-grant", "mit-notice"], "MIT"),
    (["apache-named", "apache-comply", "apache-as-is"], "Apache-2.0"),
    (["apache-named", "apache-comply"], "Apache-2.0"),
    (["gpl-free", "gpl3-terms"], "GPL-3.0-or-later"),
    (["gpl-free", "gpl2-terms"], "GPL-2.0-or-later"),
    (["spdx", "tag-mit"], "MIT"),
    (["spdx", "tag-apache"], "Apache-2.0"),
    (["spdx", "tag-gpl3"], "GPL-3.0"),
    (["spdx", "tag-bsd3"], "BSD-3-Clause"),
    (["mit-named"], "MIT"),
    (["apache-named"], "Apache-2.0"),
    (["gpl3-named"], "GPL-3.0"),
    (["gpl2-named"], "GPL-2.0"),
    (["isc-grant"], "ISC"),
    (["unlicense"], "Unlicense"),
    (["cc-by-nc-named"], "CC-BY-NC-4.0"),
    (["cc-by-sa-named"], "CC-BY-SA-4.0"),
    (["cc-by-named"], "CC-BY-4.0"),
    (["cc0-named"], "CC0-1.0"),
    (["all-rights"], "Proprietary"),
]

#: Where sentences end: at a sign before white space, and with every line or only at an empty line.
ENDS = (r"[.!?;:]+[ \t\r\n]+|\n", r"[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n")
#: The single-word tags count only in a text with one of these words, as has any with the sentence that their rules begin with.
#: All other sentences count in any text.
ANCHOR = "(?i)licen[sc]e|redistribut|permission|public domain|rights reserved|free software"


def rewritten(sequence: Column, replace) -> Column:
    """The sequence of identifiers after all rules; ``replace(text, old, new)`` replaces plain text."""
    return reduce(lambda text, rule: replace(text, "".join(f"[{i}]" for i in rule[0]), f"<{rule[1]}>"), RULES, sequence)


def _identifiers(text: Column, ends: str) -> Column:
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, f"[{name}]")])
    sentences = F.transform(F.split(text, ends), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.array_join(F.transform(sentences, lambda s: known[s]), "")  # unknown sentences are null and left out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``licenses`` (comma-joined), ``n_known`` licence sentences and ``n_unmatched`` of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"))
    every = rows.select("doc_id", "text", *[_identifiers(F.col("text"), ends).alias(f"ids{n}") for n, ends in enumerate(ENDS)])
    anchored = F.col("text").rlike(ANCHOR)

    def counted(ids: str) -> Column:
        lone = F.col(ids).contains("[tag-") & ~anchored
        return F.when(lone, F.regexp_replace(ids, r"\[tag-[^\]]*\]", "")).otherwise(F.col(ids)).alias(ids)

    found = every.select("doc_id", counted("ids0"), counted("ids1"))
    plain = lambda text, old, new: F.replace(text, F.lit(old), F.lit(new))
    ruled = found.select("*", *[rewritten(F.col(f"ids{n}"), plain).alias(f"ruled{n}") for n in (0, 1)])
    names = [F.regexp_extract_all(f"ruled{n}", F.lit("<([^>]*)>"), 1) for n in (0, 1)]

    def signs(column: str) -> Column:
        return (F.length(column) - F.length(F.replace(F.col(column), F.lit("["), F.lit("")))).cast("bigint")

    return ruled.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.concat(*names))), ",").alias("licenses"),
        F.greatest(signs("ids0"), signs("ids1")).alias("n_known"),
        F.least(signs("ruled0"), signs("ruled1")).alias("n_unmatched"),
    )
