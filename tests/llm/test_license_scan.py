import json

import duckdb
from pyspark.sql import functions as F

from cadenza.llm.license_scan import OP4_SQL, RULES, SENTENCES, scan

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """/*
 * Copyright 2019 The Authors. All rights reserved.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
int main() {}
"""
GPL = """# Copyright (C) 2011 Someone
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {n} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
BSD = """Copyright (c) 2015, Owner
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """;; This Source Code Form is subject to the terms of the Mozilla Public
;; License, v. 2.0. If a copy of the MPL was not distributed with this
;; file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
grant, keep = SENTENCES["mit-grant"], SENTENCES["mit-keep"]
CASES = [
    (1, f"Some intro.\n{grant.capitalize()}:\n\n{keep.replace(' ', '  ').capitalize()}. Done.", "MIT"), (2, "All rights\treserved.", "proprietary"),
    (3, "text. Licensed under CC-BY 4.0\nmore", "CC-BY-4.0"), (4, "we say all rights reserved here", None), (5, None, None), (6, "", None),
    (7, "word " * 50000 + ". All rights reserved! x", "proprietary"), (8, f"{keep}. {grant}.", None), (2, "All rights\treserved.", "proprietary"),
    (10, MIT, "MIT"), (11, APACHE, "Apache-2.0"), (12, GPL.format(n=3), "GPL-3.0-or-later"), (13, GPL.format(n=2), "GPL-2.0-or-later"), (14, BSD, "BSD-2-Clause"), (15, BSD3, "BSD-3-Clause"),
    (16, MPL, "MPL-2.0"), (17, ISC, "ISC"), (18, MIT.replace("\n", "\r\n"), "MIT"), (19, " ".join(MIT.split()), None), (20, "Released under the MIT License", "MIT"),
    (21, "x\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), (22, "Licensed under the GNU General Public License,\nversion 2 or later", "GPL-2.0-or-later"),
    (23, "Licensed under the GNU General Public License,\nversion 2\nor earlier", "GPL-2.0-only"), (24, "not licensed under the MIT license", None), (25, "# \n" * 20000 + "All rights reserved", "proprietary"),
    (26, "...!!! \n\n All rights reserved \n :::", "proprietary"), (None, "Licensed under the MIT license.", "MIT"),
]


def test_notices_as_they_are_written(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string, want string").withColumns({"ids": F.lit("clash"), "found": F.lit(1), "places": F.lit(2)})
    got = scan(df).collect()
    assert sorted((str(r.doc_id), r.license or "") for r in got) == sorted((str(i), w or "") for i, _, w in CASES)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].sentence_ids == "mit-grant,mit-keep" and by_id[8].n_known == 2
    assert by_id[11].sentence_ids == "rights-reserved,apache-notice,apache-comply,apache-obtain,apache-basis,apache-see"
    assert by_id[11].licenses == "Apache-2.0,proprietary"
    assert scan(df.where("false")).collect() == []


def test_sql_says_the_same(spark):
    rows = [(i, t) for i, t, _ in CASES if i is not None and i != 2]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(map(json.dumps, con.execute(OP4_SQL).fetchall()))
    assert sorted(json.dumps(tuple(r)) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_every_rule_is_found(spark):
    rows = [(i, ". ".join(SENTENCES[s] for s in seq) + ".", name) for i, (name, seq) in enumerate(RULES)]
    got = {r.doc_id: r.licenses.split(",") for r in scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert all(name in got[i] for i, _, name in rows)
