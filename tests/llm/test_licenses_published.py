"""Published notices and the licences expected of them, written down apart from the operator's tables."""

import re

import pytest

from gainsieve.llm.licenses import HINT, PHRASES, scan


def found(spark, texts: list[str]) -> list[str]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in scan(rows).orderBy("doc_id").collect()]


LINES = [
    ("Released under the MIT License.", "MIT"),
    ("Some prose here.\nDistributed under the MIT License. More prose.", "MIT"),
    ("It is available under the terms of the MIT licence.", "MIT"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Text and pictures: CC-BY-SA-3.0", "CC-BY-SA-3.0"),
    ("Except where noted, content is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under the Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("Licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", "CC-BY-NC-ND-3.0"),
    ("Creative Commons Attribution-Share Alike 2.5 Generic", "CC-BY-SA-2.5"),
    ("Creative Commons Attribution-NoDerivatives 4.0 (CC BY-ND 4.0)", "CC-BY-ND-4.0"),
    ("Dedicated to the public under CC0 1.0 Universal.", "CC0-1.0"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.", "CC0-1.0"),
    ("Released under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Distributed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("The attribution of the creative commons by 4 people.", ""),
    ("He was released under the terms of the agreement.", ""),
]
SPDX = [
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-ND-4.0", "GPL-2.0", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-or-later",
]


def test_lines_that_name_a_licence(spark):
    assert found(spark, [t for t, _ in LINES]) == [lic for _, lic in LINES]


def test_spdx_names(spark):
    assert found(spark, [f"# SPDX-License-Identifier: {n}\nimport os\n" for n in SPDX]) == SPDX
    assert found(spark, ["// SPDX-License-Identifier: GPL-2.0-only", "// SPDX-License-Identifier: LGPL-3.0-only"]) == ["GPL-2.0", "LGPL-3.0"]
    assert found(spark, ["// SPDX-License-Identifier: MIT OR Apache-2.0", "// SPDX-License-Identifier: Apache-2.0 OR MIT"]) == ["Apache-2.0,MIT"] * 2


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_every_licence_line_of_the_given_documents_is_found(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    lic = {r["doc_id"]: r["licenses"].split(",") for r in scan(docs).collect()}
    want = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    lines = [(r["doc_id"], want[w]) for r in docs.collect() for w in want if w in (r["text"] or "")]
    assert len(lines) == 21 and all(name in lic[i] for i, name in lines)


GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n"
GRANT = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
SOURCE = "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
BINARY = "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
ENDORSE = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
MPL = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
NOTICES = [
    ('   Licensed under the Apache License, Version 2.0 (the "License");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0', "Apache-2.0"),
    (GNU.format("Affero ", 3), "AGPL-3.0-or-later"),
    (GNU.format("Lesser ", 3), "LGPL"),
    (GNU.format("", 3), "GPL-3.0-or-later"),
    (GNU.format("", 2), "GPL-2.0-or-later"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.', "MIT"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    (GRANT + SOURCE + BINARY + ENDORSE + BSD_END, "BSD-3-Clause"),
    (GRANT + SOURCE + BINARY + BSD_END, "BSD-2-Clause"),
    (MPL, "MPL-2.0"),
    ("# This Source Code Form is subject to the terms of the Mozilla Public License,\n# V. 2.0.", "MPL-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Copyright (c) 2020 Acme Inc. All rights reserved.", "Proprietary"),
]


def test_published_notices(spark):
    assert found(spark, [t for t, _ in NOTICES]) == [lic for _, lic in NOTICES]
    assert found(spark, [". A dot first. Chapter IV. Licensed under the MIT License. V. All rights reserved."]) == ["MIT,Proprietary"]


WRAPPED = [
    ("Acme Inc. All\nrights reserved.", "all_rights"),
    ("All  rights\treserved.", "all_rights"),
    ("# All\n# rights\n# reserved", "all_rights"),
    ("The name may be used\n * to endorse or promote products derived from this software.", "bsd_endorse"),
    ("You should have received\n# a copy of the GNU manual.", "gnu_copy"),
    ("This is free  and unencumbered\nsoftware released into\nthe public domain.", "unlicense"),
    ("CC\n  BY 4.0", "cc_by_4_0"),
]


def test_wrapped_lines_are_hinted(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRAPPED)], "doc_id long, text string")
    assert [r["sentence_ids"] for r in scan(rows).orderBy("doc_id").collect()] == [i for _, i in WRAPPED]


@pytest.mark.parametrize("gap", [" ", "  ", "\n * ", "-", ", ", "é"])
def test_every_phrase_is_hinted_with_any_gap(gap):
    assert [p for p, _ in PHRASES if not re.search(HINT, p.replace(" ", gap))] == []
