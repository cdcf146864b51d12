"""Quality rules, line dedup, mixing and licence scan."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeboard.llm import licences, lines, mixing, near_dups, quality, queries, texts
from tests.llm.brute import awkward, frame, prose, words


def base_statistics(text):
    w = [x.decode() for x in words(text)]
    held = {}
    for i in range(len(w) - 7):
        held.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for places in held.values() if len(places) > 1 for p in places for j in range(p, p + 8)}
    full = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(full) - len(set(full)), len(covered), failed


def test_base_statistics(spark):
    rows = [*awkward(), (None, "no id"), (20, "l1\nl1\n \nl1 #$%"), (21, f"{prose(9, 9)} {prose(9, 9)} end")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.judge(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: tuple(r[n] for n in names) for r in got}
    for doc_id, text in rows:
        assert found[doc_id] == base_statistics(text), doc_id
    assert all(r.kept != r.base_failed for r in got)  # nothing to learn from


def test_learned_list_rejects_what_labels_mark(spark):
    rows = [(i, prose(i, 60) if i % 3 else prose(i, 60).replace(" ", " ### ")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300)] + [(9999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows), labels).collect()}
    assert got == {i: i % 3 > 0 for i in range(300)}
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 3]


def test_quality_of_empty_tables(spark):
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, quality int")
    assert quality.judge(frame(spark, []), labels).count() == 0
    assert quality.keep_good(frame(spark, []), labels).count() == 0


def test_boilerplate_lines(spark):
    rows = [("a", f"menu\nown {i}\n menu \nend") for i in range(10)] + [("b", "menu\nx"), (None, "menu"), ("a", None), ("a", "")]
    pages = spark.createDataFrame(rows, "site string, text string").withColumn("_site", F.lit(1)).drop("_site")
    got = lines.drop_boilerplate(pages, "text", "site", 0.5, 5, removed="n").collect()
    assert sorted((r.site or "", r.text if r.text is not None else "-", r.n) for r in got) == sorted(
        [("a", f"own {i}", 3) for i in range(10)] + [("b", "menu\nx", 0), ("", "menu", 0), ("a", "-", 0), ("a", "", 0)]
    )
    assert lines.drop_boilerplate(pages.limit(0), "text", "site").count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_boilerplate_join_forms_agree(spark, limit, monkeypatch):
    monkeypatch.setattr("noticeboard.llm.texts.BROADCAST_BYTES", limit)
    pages = spark.createDataFrame([("s" if i % 2 else None, f"top\n{i}") for i in range(40)], "site string, text string")
    got = {r.text for r in lines.drop_boilerplate(pages, "text", "site").collect()}
    assert got == {str(i) for i in range(40)}


def test_page_lines_and_host(spark):
    html = '<html><head><style>p{}</style></head><body><!-- x --><p>One <b>two</b></p><script>var a="<p>";</script><br/>three</body></html>'
    row = spark.range(1).select(lines.page_lines(F.lit(html)).alias("t"), lines.host_of(F.lit("HTTPS://A.Example.com:80/x")).alias("h"), lines.host_of(F.lit(None).cast("string")).alias("n")).first()
    assert [x for x in row.t.split("\n") if x] == ["One two", "three"]
    assert (row.h, row.n) == ("a.example.com", "")


def fill(sizes):
    """Targets by the rounds of the definition."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, rest = {}, 1.5 * sum(sizes.values()), set(names)
    while rest:
        whole = sum(weight[s] for s in rest)
        over = {s for s in rest if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in rest}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        rest -= over
    return out


def test_mixing_targets_and_copies(spark):
    rows = [(i, prose(i, 5 + i % 40), ["a", "b", "c", "d", None][0 if i % 3 else i % 5]) for i in range(900)] + [(900, None, "e"), (901, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("mine"))
    plan = mixing.plan(docs).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = fill(sizes)
    taken = {}
    for r in plan:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 0.25 * want[s] for s in want if sizes[s])
    copies = {r.doc_id: r.copies for r in plan}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    assert {r.doc_id: r.copies for r in mixing.plan(docs).collect()} == copies


def test_mixing_of_odd_tables(spark):
    assert mixing.plan(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.plan(frame(spark, [(None, "a b"), (1, "a"), (1, "a")])).count() == 3


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included in all copies. The software is provided \"as is\", without warranty of any kind."
    rows = [
        (1, f"Some text.\n{mit}"),
        (2, "Text. Licensed under the Apache License, Version 2.0."),
        (3, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (4, "This software may be used to endorse or promote products derived from this software without specific prior written permission."),
        (5, "A licence is a licence."),
        (6, None),
        (7, ""),
        (None, "Released  under\tthe MIT license"),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licences, r.leftover) for r in licences.scan(frame(spark, rows)).collect()}
    assert got[1] == (["MITGrant", "MITNotice", "AsIs"], ["MIT"], [])
    assert got[2] == (["ApacheName"], ["Apache-2.0"], [])
    assert got[3] == (["CCBYNC4", "MITName"], ["MIT", "CC-BY-NC-4.0"], [])
    assert got[4] == (["BSDNames"], [], ["BSDNames"])
    assert got[5] == got[6] == got[7] == ([], [], [])
    assert got[None] == (["MITName"], ["MIT"], [])
    assert licences.scan(frame(spark, [])).count() == 0


def test_known_sentences_have_a_trigger():
    import re

    assert all(re.search(licences.TRIGGERS, s) for _, s in licences.SENTENCES)


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "AGPL-3.0": "Licensed under the GNU Affero General Public\nLicense, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public\nLicense, version 3.",
    "LGPL-2.1": "Licensed under the GNU Lesser General\nPublic License, version 2.1.",
    "GPL-3.0": "Licensed under the GNU General\nPublic License version 3.",
    "GPL-2.0": "Licensed under the GNU General\nPublic License version 2.",
    "CC-BY-NC-4.0": "Licensed under\nCC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC\nBY-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY\n4.0.",
    "CC0-1.0": "Dedicated to the public\ndomain under CC0 1.0.",
}
WRAPPED["BSD-3-Clause"] = WRAPPED["BSD-2-Clause"] + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
WRAPPED |= {
    "LGPL-2.1-or-later": LGPL,
    "LGPL-2.0-or-later": LGPL.replace("2.1", "2"),
    "LGPL-3.0-or-later": LGPL.replace("2.1", "3"),
    "AGPL-3.0-or-later": LGPL.replace("2.1", "3").replace("Lesser General", "Affero General"),
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0. (See
accompanying file LICENSE_1_0.txt or copy at the site.)""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use it.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC-BY-3.0": "This work is licensed under a Creative Commons\nAttribution 3.0 Unported License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 3.0 Unported License.",
    "CC-BY-ND-4.0": "This work is licensed under the Creative Commons\nAttribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Available under CC BY-NC-SA\n4.0.",
    "CC-BY-NC-ND-4.0": "Available under CC BY-NC-ND\n4.0.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font\nLicense, Version 1.1.",
    "EUPL-1.2": "Licensed under the European Union Public\nLicence v. 1.2.",
}


def scanned(spark, rows):
    found = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    return [(r.doc_id, r.licences, r.leftover) for r in found]


def test_wrapped_licences(spark):
    rows = []
    for name, text in WRAPPED.items():
        for mark, end in (("", "\n"), (" * ", "\n"), ("// ", "\r\n"), ("# ", "\n")):
            rows.append((name, end.join(mark + x for x in text.split("\n"))))
    assert scanned(spark, rows) == [(name, [name], []) for name, _ in rows]
    assert {name for _, name in licences.RULES} <= set(WRAPPED) | set(licences.SPDX) | set(licences.TITLES)
    assert len({name for _, name in licences.RULES}) >= 50


def test_every_name_and_spdx_line(spark):
    rows = [(name, f"Text before. Released under the {title}, as told.") for name, titles in licences._titles.items() for title in titles]
    rows += [(name, f"// SPDX-License-Identifier: {written}\nint main() {{ or and }}") for written, name in licences._spdx.items()]
    assert scanned(spark, rows) == [(name, [name], []) for name, _ in rows]


def test_spdx_expressions(spark):
    rows = [("a", "SPDX-License-Identifier: (MIT OR Apache-2.0)"), ("b", "# SPDX-License-Identifier: GPL-2.0+"), ("c", "SPDX-License-Identifier: GPL-2.0-or-later AND MIT")]
    assert scanned(spark, rows) == [("a", ["Apache-2.0", "MIT"], []), ("b", ["GPL-2.0-or-later"], []), ("c", ["MIT", "GPL-2.0-or-later"], [])]


def test_prose_about_licences(spark):
    said = ["The MIT license is short.", "She compared version 3 of the licence with the Apache License 2.0.", "A public licence needs no permission.",
            "The Mozilla Public License 2.0 was read aloud.", "Published under the mitigated license.", "CC by mail, 4.0 stars, public.", "SPDX license identifier: none"]
    assert scanned(spark, [(x, x) for x in said]) == [(x, [], []) for x in said]
    assert scanned(spark, [("x", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"), ("y", "modify it under the terms of the GNU General Public License version 2 as published by it")]) == [("x", ["GPL-2.0"], []), ("y", ["GPL-2.0"], [])]


def test_licence_sql_on_awkward_texts(spark, tmp_path):
    """The SQL of the query follows the same rule, wrapped notices included."""
    texts = [*WRAPPED.values(), "a v. b. license\n#\n#\n\npublic", "SPDX-License-Identifier: MIT OR GPL-2.0+", "x.\n\n\nreleased under the mit license v.. released", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op8_licence_scan"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(queries.ORACLES["op8_licence_scan"]).df().sort_values("doc_id")
    assert got.values.tolist() == expected[list(got.columns)].values.tolist()


def test_blank_lines_and_lines_without_stops(spark):
    rows = [(1, "released under the\n\nMIT license"), (2, "released under the MIT license\nlicensed under CC BY 4.0\nreleased under the MIT license")]
    rows += [(3, "# released under the\n#\n# MIT license"), (4, "released under the.\nMIT license")]
    got = {r.doc_id: r.sentence_ids for r in licences.scan(frame(spark, rows)).collect()}
    assert got == {1: [], 2: ["MITName", "CCBY4", "MITName"], 3: [], 4: []}


CLASHING = ["given", "site", "_site", "lines", "line", "_boilerplate", "held", "pages", "_on", "_salt", "_slot", "_s", "key", "kept", "_kept", "kept_id", "rep",
            "component", "component_id", "fingerprint", "_rn", "size", "_size", "source_size", "target", "_target", "_source", "copies", "_copy", "rate", "_row",
            "base_failed", "n_words", "quality", "bad", "with.dot", "col"]


def test_columns_with_names_used_inside_keep_their_values(spark, monkeypatch):
    """Each stage hands on every extra column, whatever its name, also where lookups are too large to broadcast."""
    rows = [(i, f"shared line\nown line {i} " + prose(i, 40), "ab"[i % 2]) for i in range(24)] + [(None, None, None), (3, "shared line\nown line 3 " + prose(3, 40), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHING])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stages = {
        "lines": lambda d: lines.drop_boilerplate(d, "text", "source"),
        "mix": lambda d: mixing.mixed(d),
        "near": lambda d: near_dups.keep_one(d),
        "good": lambda d: quality.keep_good(d, labels),
    }
    for limit in (texts.BROADCAST_BYTES, -1):
        monkeypatch.setattr(texts, "BROADCAST_BYTES", limit)
        for name, stage in stages.items():
            out = stage(docs)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert got and all(r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}" for r in got for c in CLASHING), name
    counted = lines.drop_boilerplate(docs, "text", "source", removed="held").collect()
    assert {r["held"] for r in counted if r.doc_id is not None} == {1} and all(r["lines"].startswith("lines:") for r in counted)
