from gainsieve.llm.licenses import PHRASES, RULES, scan

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
GPL = "This program is free software: redistribute it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version."
CASES = [
    (1, "Licensed under the Apache License, Version 2.0.", "Apache-2.0", 1),
    (2, "Prose. Licensed under the Apache License, Version 2.0. You may not use this\n * file except in compliance with the License. More.", "Apache-2.0", 2),
    (3, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 1),
    (4, MIT, "MIT", 3),
    (5, "\n\n".join(reversed(MIT.split("\n\n"))), "", 3),
    (6, GPL, "GPL-3.0-or-later", 2),
    (7, GPL + "\n\n" + MIT + "\n\n" + MIT, "GPL-3.0-or-later,MIT", 8),
    (8, "The licence of poets. No rights.", "", 0),
    (9, None, "", 0),
    (10, "", "", 0),
    (11, "word " * 50_000 + "\n\nLicensed under the Apache License, Version 2.0;\n\nAll rights reserved.", "Apache-2.0,Proprietary", 2),
    (None, "SPDX-License-Identifier: MIT\n", "MIT", 1),
    (1, "Licensed under the Apache License, Version 2.0.", "Apache-2.0", 1),
]


def test_scan(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in CASES], "doc_id long, text string, phrase string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["licenses"], r["n_known"]) for r in scan(df).collect()), key=str)
    want = sorted(((i or 0, lic, n) for i, _, lic, n in CASES), key=str)
    assert got == want
    assert scan(df.limit(0)).count() == 0


def test_every_rule_is_made_of_known_sentences():
    ids = {i for _, i in PHRASES}
    assert all(set(p) <= ids for _, p in RULES)


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
RESERVED = "All rights reserved."
AS_IS = 'The software is provided "as is", without warranty of any kind.'
NOTICE = "The above copyright notice and this permission notice shall be included in all copies."


def test_very_many_known_sentences(spark):
    cases = {
        1: [GRANT] + [RESERVED] * 200_000,
        2: [GRANT, RESERVED] * 100_000,
        3: [GRANT, NOTICE] * 60_000 + [AS_IS],
        4: [GRANT, NOTICE, AS_IS] * 40_000,
    }
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in cases.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    assert {i: r["n_known"] for i, r in got.items()} == {i: len(x) for i, x in cases.items()}
    assert {i: r["licenses"] for i, r in got.items()} == {1: "Proprietary", 2: "Proprietary", 3: "MIT", 4: "MIT"}


def test_neighbouring_notices_are_both_used_up(spark):
    gpl = "Use it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. "
    docs = spark.createDataFrame([(1, gpl), (2, gpl * 2), (3, gpl * 3)], "doc_id long, text string")
    assert {r["licenses"] for r in scan(docs).collect()} == {"GPL-3.0-or-later"}
