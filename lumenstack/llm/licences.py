"""Licence scans by sentence rules.

Texts are cut in sentences and normalised; known sentences have identifiers, by their exact normalised form;
rules, each an order of identifiers, name a document's licences: all whose rule is met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of common licences, notices and tags as their publishers word them, normalised (lower case,
# punctuation as single spaces). Each has an identifier.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "this software is released under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-tag",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "licensed under the apache license version 2 0": "apache-2-ref",
    "released under the apache license version 2 0": "apache-2-ref",
    "licensed under the apache license version 2 0 the license": "apache-2-ref",
    "spdx license identifier apache 2 0": "apache-2-tag",
    "you may not use this file except in compliance with the license": "compliance",
    "you may obtain a copy of the license at": "obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "as-is-apache",
    "see the license for the specific language governing permissions and limitations under the license": "see-license",
    "this work is licensed under the gnu general public license version 3": "gpl-3-ref",
    "this program is licensed under the gnu general public license version 3": "gpl-3-ref",
    "licensed under the gnu general public license version 3": "gpl-3-ref",
    "licensed under the gnu general public license version 2": "gpl-2-ref",
    "spdx license identifier gpl 3 0 only": "gpl-3-tag",
    "spdx license identifier gpl 3 0 or later": "gpl-3-later-tag",
    "spdx license identifier gpl 2 0 only": "gpl-2-tag",
    "spdx license identifier gpl 2 0 or later": "gpl-2-later-tag",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later-grant",
    # The same grants and the notice of MPL as their marks cut them.
    "this program is free software": "free-software",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "either version 3 of the license or at your option any later version": "version-3-or-later",
    "either version 2 of the license or at your option any later version": "version-2-or-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-notice",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-no-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under the gnu lesser general public license version 3": "lgpl-3-ref",
    "licensed under the gnu lesser general public license version 2 1": "lgpl-2-1-ref",
    "licensed under the gnu affero general public license version 3": "agpl-3-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "spdx license identifier mpl 2 0": "mpl-2-tag",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "spdx license identifier bsd 2 clause": "bsd-2-tag",
    "spdx license identifier bsd 3 clause": "bsd-3-tag",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "spdx license identifier isc": "isc-tag",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "licensed under cc by 4 0": "cc-by-4-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-4-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-4-ref",
    "licensed under cc by nd 4 0": "cc-by-nd-4-ref",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4-ref",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-ref",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Rule:
    """A licence is recognised where the identifiers of `sentences` occur in this order, others in between allowed."""

    licence: str
    sentences: tuple[str, ...]


# SPDX names. Every rule that is met counts, a family's shorter form beside its longer one.
RULES = (
    Rule("MIT", ("mit-grant", "mit-condition")),
    Rule("MIT", ("mit-ref",)),
    Rule("MIT", ("mit-tag",)),
    Rule("Apache-2.0", ("apache-2-ref", "compliance", "obtain", "as-is-apache", "see-license")),
    Rule("Apache-2.0", ("apache-2-ref",)),
    Rule("Apache-2.0", ("apache-2-tag",)),
    Rule("GPL-3.0-or-later", ("gpl-3-later-grant", "gpl-no-warranty", "gpl-details")),
    Rule("GPL-3.0-or-later", ("gpl-3-later-grant",)),
    Rule("GPL-3.0-or-later", ("gpl-grant", "version-3-or-later")),
    Rule("GPL-3.0-or-later", ("gpl-3-later-tag",)),
    Rule("GPL-2.0-or-later", ("gpl-2-later-grant",)),
    Rule("GPL-2.0-or-later", ("gpl-grant", "version-2-or-later")),
    Rule("GPL-2.0-or-later", ("gpl-2-later-tag",)),
    Rule("GPL-3.0-only", ("gpl-3-ref",)),
    Rule("GPL-3.0-only", ("gpl-3-tag",)),
    Rule("GPL-2.0-only", ("gpl-2-ref",)),
    Rule("GPL-2.0-only", ("gpl-2-tag",)),
    Rule("LGPL-3.0-only", ("lgpl-3-ref",)),
    Rule("LGPL-2.1-only", ("lgpl-2-1-ref",)),
    Rule("AGPL-3.0-only", ("agpl-3-ref",)),
    Rule("MPL-2.0", ("mpl-2-notice",)),
    Rule("MPL-2.0", ("mpl-2-tag",)),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-3-Clause", ("bsd-3-tag",)),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("BSD-2-Clause", ("bsd-2-tag",)),
    Rule("ISC", ("isc-grant",)),
    Rule("ISC", ("isc-tag",)),
    Rule("Unlicense", ("unlicense-notice",)),
    Rule("CC-BY-4.0", ("cc-by-4-ref",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd-4-ref",)),
    Rule("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-ref",)),
    Rule("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-ref",)),
)

#: A sentence ends at ".", ";", ":", "!" or "?" before white space, or at a line's end; a point inside a version does not end
#: it, nor does the colon of an identifier tag.
SENTENCE_END = r"(?:[.!?;]|(?<!(?i:identifier)):)+(?=\s|$)|[\r\n]+"
#: Only sentences that hold one of these words are looked up.
CUE = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|reserved|public domain|free software|compliance|spdx|endorse"


def normalised(sentence: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentence_ids(text: Column) -> Column:
    """array<string>: the identifiers of a text's known sentences, in their order.

    Long licences are wrapped in lines, so a sentence is also sought in the text with its line ends as spaces.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def found(whole: Column) -> Column:
        cut = F.filter(F.split(whole, SENTENCE_END), lambda s: s.rlike(CUE))
        return F.filter(F.transform(cut, lambda s: F.element_at(known, normalised(s))), lambda i: i.isNotNull())

    lines = found(text)
    wrapped = found(F.regexp_replace(text, r"[\r\n]+[\s*#/]*", " "))
    return F.when(F.size(wrapped) > F.size(lines), wrapped).otherwise(lines)


def rule_pattern(rule: Rule) -> str:
    return f" {r' (?:[^ ]+ )*'.join(rule.sentences)} "


def matched(ids: Column, rule: Rule) -> Column:
    """True where the rule's identifiers occur in this order: a pattern over the joined identifiers."""
    return F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" ")).rlike(rule_pattern(rule))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs that has a known sentence: doc_id, sentence_ids, licences (sorted names, each once).

    Null and empty texts have none, and so no row. Sentences without a rule that matches leave licences empty.
    Repeated rows give a row each; null ids stay null. Work is per row: nothing is shuffled.
    """
    cued = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).filter(F.col("__text").rlike(CUE))
    ids = cued.select("doc_id", sentence_ids(F.col("__text")).alias("sentence_ids")).filter(F.size("sentence_ids") > 0)
    names = F.array(*[F.when(matched(F.col("sentence_ids"), rule), F.lit(rule.licence)) for rule in RULES])
    return ids.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull()))).alias("licences"))
