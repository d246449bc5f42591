"""License tags, headers and one-line notices as they stand in files, and the same by SQL with a reading of its own."""

from __future__ import annotations

import duckdb
import pytest
from check import differences
from test_wrapped_licenses import NAMED

from quantloom.llm import licenses
from quantloom.llm.catalog import op6_license_scan
from quantloom.llm.oracles import OP6

TEXTS = {
    "// SPDX-License-Identifier: MIT": ["MIT"],
    "/* SPDX-License-Identifier: Apache-2.0 */": ["Apache-2.0"],
    "# SPDX-License-Identifier:BSD-3-Clause": ["BSD-3-Clause"],
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib": ["Apache-2.0", "MIT", "Zlib"],
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": ["GPL-2.0"],
    "SPDX-License-Identifier: GPL-3.0-or-later\nint x;": ["GPL-3.0-or-later"],
    "SPDX-License-Identifier: LGPL-2.1+": ["LGPL-2.1-or-later"],
    "spdx-license-identifier: gpl-3.0": ["GPL-3.0"],
    "SPDX-License-Identifier: Some-Other-1.0": [],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": ["MPL-2.0"],
    "This project is licensed under the MIT License - see the LICENSE file for details": ["MIT"],
    "Licensed under the Apache License, Version 2.0 - see LICENSE": ["Apache-2.0"],
    "MIT License. Or the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
    "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0"],
    "Released under the GNU General Public License v3.0": ["GPL-3.0"],
    "GNU Affero General Public License v3.0 or later": ["AGPL-3.0-or-later"],
    "GNU Lesser General Public License v3.0 only": ["LGPL-3.0"],
    "This is free and unencumbered software released into the public domain.": ["Unlicense"],
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "made available under the terms of the Eclipse Public License v2.0": ["EPL-2.0"],
    "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:": ["Zlib"],
    "no word of it": [],
}


def test_tags_headers_and_notices(spark):
    rows = list(enumerate(TEXTS))
    found = {r.doc_id: r.licenses for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {text: sorted(found[i]) for i, text in rows} == {text: sorted(names) for text, names in TEXTS.items()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sql_with_its_own_reading_of_wrapped_lines(spark, tmp_path, end):
    texts = [*TEXTS, *NAMED.values(), *("/*\n" + "".join(f" * {line}\n" for line in t.split("\n")) + "*/" for t in NAMED.values()), None, "", ". . ."]
    rows = [(i, None if t is None else t.replace("\n", end)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert not differences(op6_license_scan(spark, str(tmp_path)).toPandas(), con.execute(OP6).df())
