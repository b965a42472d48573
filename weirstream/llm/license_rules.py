"""Licence scan by sentence rules, with DataFrame expressions only.

A text is cut into sentences, each sentence is normalised (ASCII letters and digits in lower case, one
space between) and looked up among known licence sentences, in a hash set, so their number doesn't matter. A sentence may
be wrapped over lines of a paragraph. One that is unknown is read a second time in pieces, cut at the line ends behind which
no lower-case letter goes on, for headings and notices that have no full stop. The sequence of identifiers found, by
position, is then matched against ordered rules. A rule names identifiers that must follow each other among the known
sentences of the text (unknown ones in between are skipped); of a family of rules the first holds, so a full grant outranks
a mere notice and a longer text a shorter one, and any licence outranks reserved rights. SPDX tags are read beside the
sentences, with their expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices, by identifier; ``normal`` gives the form that is looked up.
SENTENCES = {
    "mit.notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "mit.grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit.condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit.spdx": ["SPDX-License-Identifier: MIT"],
    "asis.warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "asis.liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "apache2.notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Licensed under the Apache License, Version 2.0 the License", "Released under the Apache License, Version 2.0"],
    "apache2.comply": ["you may not use this file except in compliance with the License"],
    "apache2.header": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "apache2.copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2.basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2.language": ["See the License for the specific language governing permissions and limitations under the License"],
    "apache2.title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "apache2.copyright": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"],
    "apache2.trademarks": ["This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file"],
    "apache2.spdx": ["SPDX-License-Identifier: Apache-2.0"],
    "gpl3.notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License version 3", "Released under the GNU General Public License, version 3"],
    "gpl.free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2.free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "lgpl3.free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3.free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl.hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl.details": ["See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"],
    "gpl.received": ["You should have received a copy of the GNU General Public License along with this program", "You should have received a copy of the GNU Lesser General Public License along with this library", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "gpl3.title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2.title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl3.title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21.title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3.title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gpl.verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl3.preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl3.spdx": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "bsd.redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd.disclaimer": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2.subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl2.obtain": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "zlib.grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "unlicense.domain": ["This is free and unencumbered software released into the public domain"],
    "boost.notice": ["Distributed under the Boost Software License, Version 1.0"],
    "ccbync4.notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "ccby4.notice": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccbysa4.notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0.notice": ["Released under CC0 1.0", "This work is dedicated to the public domain"],
    "reserved": ["All rights reserved"],
}
#: Sentences with a name in the middle, by identifier: what stands before and behind it.
TEMPLATES = {"bsd.endorse": [("Neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"), ("The name of", "may not be used to endorse or promote products derived from this software without specific prior written permission")]}
#: Family of the rule that holds only where no other does, and no SPDX tag.
LAST = "reserved"
#: Fixed values: (rule, licence, identifiers in order, family if that isn't the licence); earlier rules come first, and one
#: rule of each family holds.
RULES = [
    ("mit-text", "MIT", ["mit.grant", "mit.condition", "asis.warranty"]),
    ("mit-grant", "MIT", ["mit.grant"]),
    ("mit-notice", "MIT", ["mit.notice"]),
    ("mit-spdx", "MIT", ["mit.spdx"]),
    ("apache-text", "Apache-2.0", ["apache2.title", "apache2.copyright"]),
    ("apache-title", "Apache-2.0", ["apache2.title"]),
    ("apache-header", "Apache-2.0", ["apache2.header", "apache2.copy"]),
    ("apache-header-lines", "Apache-2.0", ["apache2.notice", "apache2.comply", "apache2.copy"]),
    ("apache-header-short", "Apache-2.0", ["apache2.header"]),
    ("apache-notice", "Apache-2.0", ["apache2.notice"]),
    ("apache-spdx", "Apache-2.0", ["apache2.spdx"]),
    ("bsd-3-full", "BSD-3-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse"], "bsd"),
    ("bsd-3-text", "BSD-3-Clause", ["bsd.redistribute", "bsd.endorse"], "bsd"),
    ("bsd-2-text", "BSD-2-Clause", ["bsd.redistribute"], "bsd"),
    ("agpl-header", "AGPL-3.0-or-later", ["agpl3.free", "gpl.hope"]),
    ("lgpl-header", "LGPL-3.0-or-later", ["lgpl3.free", "gpl.hope"]),
    ("gpl-header", "GPL-3.0-or-later", ["gpl.free", "gpl.hope"], "gpl3"),
    ("gpl-spdx", "GPL-3.0-or-later", ["gpl3.spdx"], "gpl3"),
    ("gpl-2-header", "GPL-2.0-or-later", ["gpl2.free", "gpl.hope"]),
    ("gpl-notice", "GPL-3.0-only", ["gpl3.notice"], "gpl3"),
    ("agpl-text", "AGPL-3.0-only", ["agpl3.title", "gpl.verbatim"]),
    ("lgpl-text", "LGPL-3.0-only", ["lgpl3.title", "gpl.verbatim"]),
    ("lgpl-2.1-text", "LGPL-2.1-only", ["lgpl21.title", "gpl.verbatim"]),
    ("gpl-text", "GPL-3.0-only", ["gpl3.title", "gpl.verbatim"], "gpl3"),
    ("gpl-2-text", "GPL-2.0-only", ["gpl2.title", "gpl.verbatim"]),
    ("isc-text", "ISC", ["isc.grant"]),
    ("mpl-header", "MPL-2.0", ["mpl2.subject", "mpl2.obtain"]),
    ("zlib-text", "Zlib", ["zlib.grant"]),
    ("unlicense-text", "Unlicense", ["unlicense.domain"]),
    ("boost-notice", "BSL-1.0", ["boost.notice"]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ["ccbync4.notice"]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ["ccbysa4.notice"]),
    ("cc-by-notice", "CC-BY-4.0", ["ccby4.notice"]),
    ("cc0-notice", "CC0-1.0", ["cc0.notice"]),
    ("reserved", "proprietary", ["reserved"], LAST),
]


def normal(known: dict[str, list[str]]) -> dict[str, list[str]]:
    """Sentences as ``pieces`` leaves them: words of ASCII letters and digits in lower case, one space between."""
    return {k: list(dict.fromkeys(" ".join(re.findall("[a-z0-9]+", s.lower())) for s in own)) for k, own in known.items()}


#: Ends of sentences in normalised texts; line ends in them are those behind which no lower-case letter goes on.
END = "\x02"
#: An SPDX licence identifier, and an expression of them behind its tag.
SPDX_ID = "[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = rf"SPDX-License-Identifier:[ \t]*(\(*{SPDX_ID}\)*(?: +(?:AND|OR|WITH) +\(*{SPDX_ID}\)*)*)"
#: (pattern, replacement) in order; all of them mean the same in Java's and in RE2's syntax.
CUTS = [
    (r"\n(?:[^A-Za-z0-9\n]*\n)+", END),  # a line without a letter or digit ends a paragraph
    (r"[.!?][ \t\r]*\n", END),
    (r"[.!?][ \t]+", END),
    (rf"\n[^A-Za-z0-9\n{END}]*([a-z])", r" \1"),  # the sentence goes on; signs of comments go
    (rf"[^A-Za-z0-9\n{END}]+", " "),
    (rf" ?([\n{END}]) ?", r"\1"),
]


def pieces(text: Column) -> Column:
    """The text, normalised: sentences, with ``END`` between them; line ends stay where a sentence may have ended."""
    for pattern, by in CUTS:
        text = F.regexp_replace(text, pattern, by.replace("\\1", "$1"))
    return F.trim(F.lower(text))


def family(rule: tuple) -> str:
    return rule[3] if len(rule) > 3 else rule[1]


def reach_of(known: dict[str, list[str]], wide: list[tuple[str, str, str]]) -> int:
    """Characters at the end of a sentence in which a known one may lie: those of the longest, a name, and a sign more."""
    return max([len(s) for own in known.values() for s in own] + [len(b) + len(e) + 80 for _, b, e in wide]) + 2


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, known: dict[str, list[str]] | None = None, rules: list[tuple] | None = None, templates: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Licences that each text states, map-only.

    Returns the ``keep`` columns (default ``doc_id``) with n_sentences, n_known (long), sentence_ids
    (identifiers found, in order, joined by commas), rules and licenses (those that hold, in the order of
    ``rules``, then SPDX identifiers of other licences, joined by commas) and license (the first, else null). A notice counts
    if it is a whole sentence, or a line or more of a paragraph between line ends where no lower-case letter goes on. Null or
    empty text: no sentences, empty lists, null license. A sentence that comes again counts again; repeated rows repeat;
    other columns of the input are left out, and kept ones must not be named like results. ``known``, ``templates`` and
    ``rules`` are parameters, not data, so the literals that they become don't grow with the input.
    """
    keep = keep or ["doc_id"]
    if clash := set(keep) & {"n_sentences", "n_known", "sentence_ids", "rules", "licenses", "license"}:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    known, rules = normal(known or SENTENCES), rules or RULES
    names = [f"__k{i}" for i in range(len(keep))]
    of = F.create_map(*[F.lit(x) for k, own in known.items() for s in own for x in (s, k)])
    sentences = [s for own in known.values() for s in own]
    wide = [(k, *(next(iter(normal({"": [x]}).values()))[0] for x in pair)) for k, own in (TEMPLATES if templates is None else templates).items() for pair in own]

    reach = reach_of(known, wide)

    def identified(s: Column) -> Column:
        found = F.when(s.isin(*sentences), F.element_at(of, s))
        for k, begin, end in wide:
            found = found.when(F.startswith(s, F.lit(begin + " ")) & F.endswith(s, F.lit(" " + end)), F.lit(k))
        return found

    def lines(s: Column) -> Column:
        return F.transform(F.split(s, "\n"), identified)

    def read(s: Column) -> Column:
        """The whole sentence; else its longest end from a line on, and the lines before that one by one."""
        whole = F.array(identified(F.translate(s, "\n", " ")))
        last = F.split(F.right(s, F.lit(reach)), "\n")
        # the first of these lines may be cut, or is the whole
        ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(last), F.lit(2))), lambda i: F.array_join(F.slice(last, i, F.size(last)), " "))
        end = F.get(F.filter(ends, lambda e: identified(e).isNotNull()), F.lit(0))
        rest = F.concat(lines(F.substr(s, F.lit(1), F.length(s) - F.length(end))), F.array(identified(end)))
        return F.when(whole[0].isNotNull() | ~F.contains(s, F.lit("\n")), whole).when(end.isNotNull(), rest).otherwise(lines(s))

    all_rules = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("license"), F.lit("|" + "|".join(r[2]) + "|").alias("ids"), F.lit(family(r)).alias("family")) for r in rules])
    found = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    tagged = F.flatten(F.transform(F.regexp_extract_all("__t", F.lit(SPDX), F.lit(1)), lambda e: F.regexp_extract_all(F.regexp_replace(e, rf"WITH +{SPDX_ID}", ""), F.lit(SPDX_ID), F.lit(0))))
    found = found.select(*names, pieces(F.col("__t")).alias("__s"), F.array_distinct(F.filter(tagged, lambda t: ~t.isin("AND", "OR"))).alias("__tags"))
    ids = F.array_compact(F.flatten(F.transform(F.split("__s", END), read)))
    found = found.select(*names, "__tags", F.size(F.filter(F.split("__s", f"[\n{END}]"), lambda s: s != "")).cast("long").alias("n_sentences"), ids.alias("__ids"))
    matched = F.when(F.size("__ids") > 0, F.filter(all_rules, lambda r: F.contains(F.concat(F.lit("|"), F.array_join("__ids", "|"), F.lit("|")), r["ids"])))
    found = found.withColumn("__all", F.coalesce(matched, F.filter(all_rules, lambda r: F.lit(False))))
    # of each family the first rule that holds
    first = F.filter("__all", lambda r, i: F.array_position(F.transform("__all", lambda m: m["family"]), r["family"]) == i + 1)
    found = found.withColumn("__m", first)
    others = F.exists("__m", lambda m: m["family"] != LAST) | (F.size("__tags") > 0)
    found = found.withColumn("__m", F.filter("__m", lambda m: (m["family"] != LAST) | ~others))
    found = found.withColumn("__more", F.filter("__tags", lambda t: ~F.array_contains(F.transform("__m", lambda m: m["license"]), t)))
    licenses = F.concat(F.transform("__m", lambda m: m["license"]), "__more")
    return found.select(
        *names,
        "n_sentences",
        F.size("__ids").cast("long").alias("n_known"),
        F.array_join("__ids", ",").alias("sentence_ids"),
        F.array_join(F.concat(F.transform("__m", lambda m: m["rule"]), F.transform("__more", lambda t: F.lit("spdx"))), ",").alias("rules"),
        F.array_join(licenses, ",").alias("licenses"),
        F.get(licenses, F.lit(0)).alias("license"),
    ).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def scan_sql(known: dict[str, list[str]] | None = None, rules: list[tuple] | None = None) -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    known, rules = normal(known or SENTENCES), rules or RULES
    keys = ", ".join(f"'{s}'" for own in known.values() for s in own)
    values = ", ".join(f"'{k}'" for k, own in known.items() for _ in own)
    listed = ", ".join(f"{{'rule': '{r[0]}', 'license': '{r[1]}', 'ids': '|{'|'.join(r[2])}|', 'family': '{family(r)}'}}" for r in rules)
    wide = [(k, *(next(iter(normal({"": [x]}).values()))[0] for x in pair)) for k, own in TEMPLATES.items() for pair in own]

    def identified(s: str) -> str:
        return f"coalesce(element_at(m, {s})[1], " + "case " + " ".join(f"when starts_with({s}, '{b} ') and ends_with({s}, ' {e}') then '{k}'" for k, b, e in wide) + " end)"

    reach = reach_of(known, wide)
    whole = identified("replace(x, chr(10), ' ')")
    lines = lambda s: f"list_transform(string_split({s}, chr(10)), lambda y: {identified('y')})"
    cut = "coalesce(text, '')"
    for pattern, by in CUTS:
        cut = f"regexp_replace({cut}, '{pattern}', '{by}', 'g')"
    return rf"""
with cut as (select doc_id, coalesce(text, '') as t, trim(lower({cut}), ' ') as s, map([{keys}], [{values}]) as m from documents),
known as (select doc_id, len(list_filter(regexp_split_to_array(s, '[
{END}]'), lambda x: x <> '')) as n,
  list_filter(flatten(list_transform(list_transform(list_transform(string_split(s, '{END}'), lambda x: {{'x': x, 'l': string_split(right(x, {reach}), chr(10))}}),
      lambda z: {{'x': z.x, 'e': list_filter(list_transform(range(2, len(z.l) + 1), lambda i: array_to_string(z.l[i:], ' ')), lambda e: {identified("e")} is not null)[1]}}),
    lambda z: case when {whole.replace("x,", "z.x,")} is not null or not contains(z.x, chr(10)) then [{whole.replace("x,", "z.x,")}]
      when z.e is not null then list_concat({lines("substr(z.x, 1, length(z.x) - length(z.e))")}, [{identified("z.e")}]) else {lines("z.x")} end)), lambda x: x is not null) as ids,
  list_filter(flatten(list_transform(regexp_extract_all(t, '{SPDX}', 1), lambda e: regexp_extract_all(regexp_replace(e, 'WITH +{SPDX_ID}', '', 'g'), '{SPDX_ID}'))), lambda x: x not in ('AND', 'OR')) as spdx from cut),
tagged as (select *, list_filter(spdx, lambda x, i: list_position(spdx, x) = i) as tags from known),
matched as (select *, case when len(ids) > 0 then list_filter([{listed}], lambda r: contains('|' || array_to_string(ids, '|') || '|', r.ids)) else [] end as m from tagged),
firsts as (select *, list_filter(m, lambda r, i: list_position(list_transform(m, lambda x: x.family), r.family) = i) as f0 from matched),
granted as (select *, list_filter(f0, lambda r: r.family <> '{LAST}' or (len(tags) = 0 and len(list_filter(f0, lambda x: x.family <> '{LAST}')) = 0)) as f from firsts),
named as (select *, list_filter(tags, lambda x: not list_contains(list_transform(f, lambda r: r.license), x)) as more from granted)
select doc_id, n::bigint as n_sentences, len(ids)::bigint as n_known, coalesce(array_to_string(ids, ','), '') as sentence_ids,
  coalesce(array_to_string(list_concat(list_transform(f, lambda x: x.rule), list_transform(more, lambda x: 'spdx')), ','), '') as rules,
  coalesce(array_to_string(list_concat(list_transform(f, lambda x: x.license), more), ','), '') as licenses, list_concat(list_transform(f, lambda x: x.license), more)[1] as license
from named"""
