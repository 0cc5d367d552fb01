from lumenstack.llm.licences import RULES, SENTENCES, scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def names(spark, *texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return {r.doc_id: r.licences for r in rows}


def test_texts_notices_and_tags(spark):
    found = names(
        spark,
        "Some prose here. Released under the MIT License. More prose.",
        "// SPDX-License-Identifier: Apache-2.0\nint main",
        MIT,
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
        "A licence is a matter of permission, they said.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    )
    assert found == {0: ["MIT"], 1: ["Apache-2.0"], 2: ["MIT"], 3: ["CC-BY-NC-4.0", "GPL-3.0-only"], 5: []}


def test_rules_need_their_order(spark):
    first, second = MIT.split("\n\n")
    assert names(spark, f"{second}\n\n{first}") == {0: []}


def test_rules_and_sentences_agree():
    assert {i for rule in RULES for i in rule.sentences} <= set(SENTENCES.values())


def test_odd_rows(odd_rows, empty):
    assert [(r.doc_id, r.licences) for r in scan(odd_rows).collect()] == [(10, ["MIT"])]
    assert scan(empty).count() == 0


def test_published_grants_that_hold_marks(spark):
    gpl_2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.
"""
    gpl_3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
    found = names(spark, gpl_2, gpl_3, mpl, gpl_2.replace("version 2", "version 3"))
    assert found == {0: ["GPL-2.0-or-later"], 1: ["GPL-3.0-or-later"], 2: ["MPL-2.0"], 3: ["GPL-3.0-or-later"]}
