import re

import duckdb
import pyarrow as pa

from tagloom.llm import license_scan as s


def test_rules_are_many_and_keyed():
    rules = s.rules()
    assert len(rules) > 200
    for kw, _, _, rule in rules:
        assert f"@{kw}" in rule and kw.isalnum()


TEXTS = [
    None, "", " \n", "nothing here", "Licensed under the Apache License, Version 2.0.", "cc-by, CC BY-NC 4.0; All rights reserved. all RIGHTS-reserved",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-only", "Copyright (c) 2020 Some One. All rights reserved",
    "é cc by é", "occ by", "cc bye", "Released under the MIT License " * 400, "distributed as is without any warranty of any kind; see the MIT license file",
    "creative commons attribution share alike 4.0 and the gnu affero general public license", "general public license general public license", "placed in the public domain", "apacheé license 2.0",
]


def test_against_sql(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x"), (None, TEXTS[6], "x"), (77, "word " * 30000 + "cc by", "x")]
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(s.ORACLE_SQL["op5_license_scan"]).fetchall()
    got = s.scan(spark.createDataFrame(rows, "doc_id long, text string, h string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert by[4].labels == "apache-2" and by[4].score == 1.0
    assert by[5].base_labels == "cc-by,reserved" and by[5].n_base == 4 and by[5].labels == "cc-by,cc-by-nc,reserved"
    assert by[6].base_labels == "gpl" and by[6].labels == "gpl,gpl-3"
    assert by[10].labels == by[11].labels == by[17].labels == ""
    assert (by[77].first_word, by[77].n_words) == (30000, 30002)
    assert s.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def most_words(parsed) -> int:
    """The most spaces in what a parsed expression matches."""
    n = 0
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            n += arg == 32
        elif name == "MAX_REPEAT":
            n += arg[1] * most_words(arg[2])
        elif name == "SUBPATTERN":
            n += most_words(arg[3])
        elif name == "BRANCH":
            n += max(map(most_words, arg[1]))
        else:
            assert name in ("IN", "NOT_LITERAL"), name
    return n


def test_no_rule_reaches_beyond_a_context():
    parts = [r[3].removeprefix("(?:^| )").removesuffix("(?: |$)").split("@") for r in s.rules()]
    assert all(len(p) == 2 for p in parts)
    # One word more on each side shows that the match ends there.
    assert max(most_words(re._parser.parse(p[0])) for p in parts) < s.LEFT
    assert max(most_words(re._parser.parse(p[1])) + 1 for p in parts) < s.RIGHT


def test_base_phrases_hold_a_keyword():
    keys = {k for k, *_ in s.rules()}
    assert all(set(p.split(" ")) & keys for p, _ in s.BASE)


WANT = {
    "GNU General Public License as published by the Free Software Foundation either version 3.0 of the License or at your option any later version": "gpl,gpl-3",
    "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0)": "gpl-2-classpath",
    "SPDX-License-Identifier: MIT": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Licensed under the terms of the 3-clause BSD licence": "bsd-3",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
    "https://creativecommons.org/licenses/by-sa/4.0": "cc-by-sa",
    "Released into the public domain": "public-domain",
    "Mozilla Public Licence v2": "mpl-2",
    "Copyright (c) 2019 2021 the Spring Foo contributors": "copyright",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED": "as-is,no-warranty",
    "unauthorized copying of this file via any medium is strictly prohibited": "proprietary",
    "tous droits réservés": "reserved",
    "nothing of the kind, all as is": "",
}


def test_expected_labels(spark):
    rows = list(enumerate(WANT))
    got = s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {rows[r.doc_id][1]: r.labels for r in got} == WANT
    assert {r.doc_id: r.score for r in got}[0] == 1.0


def test_version_in_the_same_word(spark):
    want = {"GPLv3 licensed": "gpl-3", "Licensed under GPLv3": "gpl-3", "licensed under the GPLv2.0": "gpl-2", "GPL3": "gpl-3", "see GPL2": "gpl-2", "GPL v3": "gpl-3", "gpl version 2": "gpl-2", "GPL 3.0": "gpl-3", "LGPLv3": "lgpl-3", "LGPLv2.1": "lgpl-2.1", "under the AGPLv3": "agpl-3", "Apache2": "apache-2", "gplv4": "", "xgplv3": ""}
    rows = list(enumerate(want))
    got = s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {rows[r.doc_id][1]: r.labels for r in got} == want
    assert all((r.score > 0) == bool(r.labels) for r in got)
