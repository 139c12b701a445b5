"""op2, op4 and op6."""

import collections
import hashlib
import zlib

import duckdb
import pytest

from corrobora.llm.chat import CHAT_SQL, chat_digest, format_conversations, read_back, with_probe
from corrobora.llm.licenses import license_report, license_sql
from corrobora.llm.sharding import shard
from tests.llm.helpers import ODD, docs


def brute_shard(key, n):
    text = str(key) if key is not None else "\0null"
    draws = [int(hashlib.md5(f"{text}/{s}".encode()).hexdigest()[:13], 16) for s in range(n)]
    return max(range(n), key=lambda s: (draws[s], -s))


def test_shards_match_brute_force_and_slots_are_gapless(spark):
    rows = ODD + [(100 + i, f"text {i % 7}") for i in range(500)]
    got = shard(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert r["shard"] == brute_shard(r["doc_id"], 8) and r["grown_shard"] == brute_shard(r["doc_id"], 9) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want


def test_weights_set_the_shares_and_growth_moves_few(spark):
    rows = docs(spark, [(i, "x") for i in range(6000)])
    n = collections.Counter(r["shard"] for r in shard(rows, weights=(1, 2, 3)).collect())
    assert abs(n[2] / 6000 - 0.5) < 0.04 and abs(n[0] / 6000 - 1 / 6) < 0.04
    moved = sum(r["shard"] != r["grown_shard"] for r in shard(rows).collect())
    assert abs(moved / 6000 - 1 / 9) < 0.02


def test_sharding_runs_no_python(spark):
    plan = shard(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


LICENSED = [
    (1, "Code. Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies. The software is provided \"as is\", without warranty."),
    (2, "text\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at x. Unless required by applicable law or agreed to in writing, y."),
    (3, "Redistribution and use in source and binary forms are permitted. Redistributions of source code must retain it. Redistributions in binary form must reproduce it. Neither the name of x. All rights reserved."),
    (4, "This work is licensed under the GNU General Public License, version 3.\nOr any."), (5, "Licensed under CC BY-NC 4.0."), (6, "It is my licence to be odd. Nothing else"), (7, "no words of it"), (8, "Released under the MIT License."), *[(20 + i, t) for i, (_, t) in enumerate(ODD)],
]


def test_licenses(spark):
    got = {r["doc_id"]: r for r in license_report(docs(spark, LICENSED)).collect()}
    assert [got[i]["licenses"] for i in range(1, 9)] == ["MIT", "Apache-2.0", "BSD-3-Clause,Proprietary", "GPL-3.0", "CC-BY-NC", "", "", "MIT"]
    assert got[6]["n_unknown"] == 1 and got[7]["n_license_sentences"] == 0


def test_licenses_without_the_word_or_wrapped(spark):
    texts = {
        "Available under CC BY-SA 4.0.": "CC-BY-SA", "Released under the 3-clause BSD terms.": "BSD-3-Clause", "Creative Commons Attribution 4.0 International": "CC-BY", "Dedicated to the public\ndomain by us.": "Public-Domain", "(c) We. All rights\nreserved": "Proprietary",
        "In no event shall we pay.": "", "nothing of the kind": "",
    }
    got = {r["doc_id"]: r for r in license_report(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i]["licenses"] for i in range(len(texts))] == list(texts.values())
    assert got[5]["sentence_ids"] == "NO_LIABILITY" and got[6]["n_license_sentences"] == 0


def test_licenses_match_sql(spark):
    documents = docs(spark, LICENSED).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(license_sql()).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in license_report(docs(spark, LICENSED)).select(columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


TURNS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c\x01e\x02\x03\x04\x05\x01"), (1, 3, "user", None), (2, 0, "assistant", "x" * 1000), (2, 1, "user", "\x05\x02user\x03"), (None, 0, "user", "n"),
    (3, 1, "assistant", ""), (3, 1, "assistant", ""), (3, 0, None, "🙂é"), (3, None, "system", "s"), (4, 0, "we\x02ird", "t\x04"), (4, 1, "we\x02ird", "u"),
]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)


def ordered():
    out = collections.defaultdict(list)
    for c, t, r, x in sorted(TURNS, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        out[c].append((r or "", x or ""))
    return out


def test_chat_is_read_back_whole(turns):
    got = {r["conv_id"]: r for r in read_back(format_conversations(turns)).collect()}
    for conv, said in ordered().items():
        assert [tuple(t) for t in got[conv]["turns"]] == said
        assert got[conv]["loss"] == "".join(x for r, x in said if r == "assistant")


def test_same_role_turns_share_a_header(turns):
    text = {r["conv_id"]: r["formatted"] for r in format_conversations(turns).collect()}
    assert text[1].count("\x02") == 3 and text[3].count("\x02") == 3


def test_chat_digest_matches_sql_and_brute_force(spark, turns):
    conversations = turns.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(CHAT_SQL).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in chat_digest(with_probe(turns)).select(columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    probe = next(r for r in got if r[0] == -7)
    say = "\\### Assistant: </turn> ok"
    assert probe[1] == 2 and probe[2] == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest() and probe[3] == len(say)


def test_chat_of_nothing(turns):
    assert chat_digest(turns.limit(0)).count() == 0


def test_long_conversations_are_cut_in_chunks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "é" * (i % 5) + str(i)) for i in range(1500)] + [(2, i, "assistant", "\x05a") for i in range(256)] + [(3, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in read_back(format_conversations(turns)).collect()}
    for conv in (1, 2, 3):
        own = [r for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == [(r, x) for _, _, r, x in own]
        assert got[conv]["loss"] == "".join(x for _, _, r, x in own if r == "assistant")
    spans = {r["conv_id"]: (r["formatted"], r["spans"]) for r in format_conversations(turns).collect()}
    text, at = spans[1]
    assert [text[s["start"] : s["start"] + s["length"]] for s in at] == [x for c, _, r, x in rows if c == 1 and r == "assistant"]


def test_chat_runs_no_python(spark, sf_dir):
    plan = chat_digest(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_equal_rows_are_numbered_in_several_buckets(spark):
    got = shard(docs(spark, [(5, "same")] * 500)).collect()
    assert sorted(r["slot"] for r in got) == list(range(500)) and len({r["shard"] for r in got}) == 1


_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.'
_GNU_TAIL = "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {0}General Public License for more details.\n\nYou should have received a copy of the GNU {0}General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>."
_GNU = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {0}General Public License as published by\nthe Free Software Foundation; either version {1} of the License, or\n(at your option) any later version.\n\n" + _GNU_TAIL
_BSD = "Copyright (c) 2020, The Authors\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice.\n\n"
NOTICES = {
    "MIT License\n\nCopyright (c) 2020 The Authors\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n" + _AS_IS: "MIT",
    "Copyright 2020. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice shall be included in all copies. " + _AS_IS: "MIT",
    "# Copyright 2020 The Authors\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS.\n# See the License for the specific language governing permissions and\n# limitations under the License.": "Apache-2.0",
    "Apache License 1.1 of 2000": "Apache-1.1", "Licensed under Apache Software License v2": "Apache-2.0",
    _GNU.format("", "2"): "GPL-2.0-or-later", _GNU.format("", "3"): "GPL-3.0-or-later", _GNU.format("Lesser ", "2.1"): "LGPL-2.1-or-later", _GNU.format("Lesser ", "3"): "LGPL-3.0-or-later", _GNU.format("Library ", "2"): "LGPL-2.0-or-later", _GNU.format("Affero ", "3"): "AGPL-3.0-or-later",
    "Published under the GNU General Public License version 2.": "GPL-2.0", "Under the GNU Lesser General Public License v3.": "LGPL-3.0", "GNU General Public License": "GPL",
    _BSD + _AS_IS: "BSD-2-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used.\n\n" + _AS_IS: "BSD-3-Clause", _BSD + "3. All advertising materials mentioning features or use of this software must display this.\n\n" + _AS_IS: "BSD-4-Clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies. " + _AS_IS: "ISC",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS: "0BSD",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0", "Mozilla Public License 1.1, 2004": "MPL-1.1",
    "Made available under the Eclipse Public License 2.0 which is at hand.": "EPL-2.0", "Eclipse Public License - v 1.0": "EPL-1.0", "Common Development and Distribution License": "CDDL",
    "This is free and unencumbered software released into the public domain. " + _AS_IS: "Unlicense", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": "WTFPL",
    "This software is provided 'as-is', without any express or implied warranty. In no event shall the authors be held liable.\n\n1. The origin of this software must not be misrepresented; you must not claim it.\n\n2. Altered source versions must be plainly marked as such.\n\n3. This notice may not be removed or altered from any source distribution.": "Zlib",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "The Artistic License 2.0": "Artistic-2.0", "Python Software Foundation License": "PSF-2.0", "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1", "Licensed under the European Union Public Licence": "EUPL",
    "Microsoft Public License (Ms-PL)": "MS-PL", "Made available under the Open Database License.": "ODbL", "The PostgreSQL License": "PostgreSQL", "GNU Free Documentation License": "GFDL", "CC0 1.0 Universal": "CC0-1.0", "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA", "CC BY-NC-ND 4.0": "CC-BY-NC-ND", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": "GPL-3.0", "Apache License\nVersion 2.0, January 2004": "Apache-2.0",
    "Attribution-NonCommercial-NoDerivatives 4.0": "CC-BY-NC-ND", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "SPDX-License-Identifier: MIT": "MIT",
    "You must submit license forms": "", "A permit licence": "", "A permission licence of version 2": "", "Unlimited license": "", "The new BSD release": "", "It admits licence fees. Version 3 of any later version": "",
}


def test_canonical_notices(spark):
    got = {r["doc_id"]: r["licenses"] for r in license_report(docs(spark, list(enumerate(NOTICES)))).collect()}
    assert [(got[i], text[:40], text[-40:]) for i, text in enumerate(NOTICES)] == [(want, text[:40], text[-40:]) for text, want in NOTICES.items()]
    assert len(set(NOTICES.values())) > 30


def test_every_pattern_needs_its_stem(spark):
    import re

    from corrobora.llm.licenses import SENTENCES, SPEAKS, SPEAKS_STEMS, STEMS

    for name, stem, pattern in SENTENCES:
        for part in pattern.split("|") if "(" not in pattern else [pattern]:
            assert stem in re.sub(r"licen\[cs\]e", "license", part), name
    assert all(any(s in re.sub(r"\[cs\]", "s", x) for s in SPEAKS_STEMS) for x in SPEAKS.split("|")) and all(re.fullmatch("[a-z0-9]+", s) for s in STEMS)


def test_licenses_run_no_python(spark, sf_dir):
    from corrobora.llm.licenses import licenses_found

    plan = licenses_found(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
