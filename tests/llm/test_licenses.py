"""Published licence texts and headers, wrapped and in comments; the SQL says the same of every one."""

import itertools
import textwrap

import duckdb
import pandas as pd
import pytest

from weirstream.llm import license_rules

MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Copyright (c) 2019, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
KNOWN = {
    "MIT": (MIT, "MIT", "mit.grant,mit.condition,asis.warranty,asis.liability"),
    "Apache": (APACHE, "Apache-2.0", "apache2.header,apache2.copy,apache2.basis,apache2.language"),
    "BSD": (BSD, "BSD-3-Clause", "reserved,bsd.redistribute,bsd.source,bsd.binary,bsd.endorse"),
    "GPL": (GPL, "GPL-3.0-or-later", "gpl.free,gpl.hope,gpl.details,gpl.received"),
    "MPL": (MPL, "MPL-2.0", None),
    "ISC": (ISC, "ISC", "isc.grant"),
}


def wrapped(text, width, prefix, end):
    lines = [x for p in text.split("\n\n") for x in [*textwrap.wrap(p, width), ""]]
    return end.join((prefix + x).rstrip() for x in lines)


def both(spark, texts):
    """Rows of the operator and of the SQL."""
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.sql(license_rules.scan_sql()).df().sort_values("doc_id")
    assert len(documents) == len(want)
    found = license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")
    rows = [[tuple(None if pd.isna(v) else v for v in r) for r in f[sorted(want.columns)].itertuples(index=False)] for f in (found, want)]
    assert rows[0] == rows[1]
    return found


@pytest.mark.parametrize("name", KNOWN)
def test_published_texts(spark, name):
    text, license_, ids = KNOWN[name]
    forms = list(itertools.product((60, 72, 80, 10_000), ("", "# ", " * ", "// ", "> "), ("\n", "\r\n")))
    found = both(spark, ["Some tool\n\n" + wrapped(text, *f) + "\n\nand more words" for f in forms])
    assert set(found["license"]) == {license_}
    assert ids is None or set(found["sentence_ids"]) == {ids}


def test_odd_and_long_texts(spark):
    filler = "nothing of note is said here, and it goes on. " * 40_000
    texts = [None, "", " \n\n. ! ?\r\n", "SPDX-License-Identifier: MIT", "/* SPDX-License-Identifier: Apache-2.0 */", filler + "\n" + MIT + "\n" + filler, "x" * 1_000_000, "All rights reserved. All rights reserved", "ALL RIGHTS\nRESERVED .", "Released under the MIT. License", "a.\r\nAll rights reserved?\tMore"]
    found = both(spark, texts)
    assert found["license"].tolist() == [None, None, None, "MIT", "Apache-2.0", "MIT", None, "proprietary", "proprietary", None, "proprietary"]
    assert found["n_known"].tolist()[7] == 2


def test_families_names_tags_and_negations(spark):
    full_bsd = BSD + "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    cases = [
        (full_bsd, "BSD-3-Clause"),
        (full_bsd.replace("the copyright holder nor", "The Regents of Some University nor"), "BSD-3-Clause"),
        (full_bsd.replace("the copyright holder nor", "Foo Inc. nor"), "BSD-3-Clause"),
        (full_bsd[: full_bsd.index("3. Neither")], "BSD-2-Clause"),
        ("This code is not\nlicensed under the MIT License.", ""),
        ("This code is not licensed under the MIT License.", ""),
        ("Some tool\nLicensed under the MIT License\nSome more", "MIT"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Some Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n", "GPL-3.0-only"),
        ("# SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause"),
        ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"),
        ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC0-1.0 */", "MIT,Apache-2.0,CC0-1.0"),
        ("SPDX-License-Identifier: MIT\nAll rights reserved.", "MIT"),
        ("SPDX-License-Identifier: MIT and more words.", "MIT"),
        ("All rights reserved.", "proprietary"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ]
    found = both(spark, [t for t, _ in cases])
    assert found["licenses"].tolist() == [want for _, want in cases]


def test_many_sentences_and_kept_names(spark):
    known = {f"s{i}": [f"sentence number {i} of a long list"] for i in range(3_000)}
    docs = spark.createDataFrame([(1, "Sentence number 7 of a long list. Sentence number\n2999 of a long list!")], "doc_id long, text string")
    row = license_rules.scan(docs, known=known, rules=[("r", "L", ["s7", "s2999"])]).first()
    assert (row.sentence_ids, row.license) == ("s7,s2999", "L")
    with pytest.raises(ValueError, match="clash"):
        license_rules.scan(docs.withColumn("license", docs.text), keep=["license"])
