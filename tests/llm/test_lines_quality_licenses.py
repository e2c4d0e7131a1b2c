import hashlib
import math
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from billspark.llm import quality
from billspark.llm.licenses import scan_licenses
from billspark.llm.lines import drop_repeated_lines
from tests.llm.conftest import collected

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_lines(rows, min_chars=20, min_docs=3):
    keys = lambda t: [x.strip(BLANKS).translate(LOWER) for x in (t or "").split("\n")]
    held, keeper = Counter(), {}
    for i, t in rows:
        for key in {k for k in keys(t) if len(k) >= min_chars}:
            held[key] += 1
            keeper[key] = max(keeper.get(key, -math.inf), -math.inf if i is None else i)
    out = []
    for i, t in rows:
        me = -math.inf if i is None else i
        stay = [
            x
            for x, k in zip((t or "").split("\n"), keys(t))
            if not (held[k] >= min_docs and keeper[k] != me)
        ]
        out.append((i, "\n".join(stay), len((t or "").split("\n")), len((t or "").split("\n")) - len(stay)))
    return out


def as_sorted(rows):
    return sorted(rows, key=repr)


def test_lines_match_brute_force(odd, plain):
    got = collected(drop_repeated_lines(odd))
    assert as_sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == as_sorted(
        kept_lines(plain)
    )
    assert {r["_row"] for r in got} == {"clash"}


def test_lines_ties_and_empty_table(spark, odd):
    line = "the same line in all of these rows"
    df = spark.createDataFrame([(1, line), (2, line), (2, line), (2, line + "\nmore")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in collected(drop_repeated_lines(df)))
    assert got == [(1, ""), (2, line), (2, line), (2, line + "\nmore")]
    assert drop_repeated_lines(odd.limit(0)).count() == 0


def test_license_rules_in_order(spark, odd):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    also = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [
        (1, f"Words.\n{notice}\n{also}\nReleased under the MIT License."),
        (2, f"{also}\n{notice}"),  # the wrong order is no licence
        (3, f"{notice}\nSomething between.\n{also}"),
        (4, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."),
        (5, None),
        (6, "a license, but none that is known"),
    ]
    got = {r["doc_id"]: r for r in collected(scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got[1]["licenses"] == "MIT"
    assert got[2]["licenses"] == "" and got[2]["unmatched"] == "<MitNotice><MitGrant>"
    assert got[3]["licenses"] == "" and got[3]["sentence_ids"] == "<MitGrant><?><MitNotice>"
    assert got[4]["licenses"] == "Apache-2.0,CC-BY-NC-4.0"
    assert got[5]["licenses"] == got[6]["sentence_ids"] == ""
    assert scan_licenses(odd).count() == odd.count()
    assert scan_licenses(odd.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES."""
ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software.\n\n"
NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
GPL = """This %s is free software%s you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation%s either version %s of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def test_full_license_texts_wrapped_and_commented(spark):
    notices = {
        "Apache-2.0": (APACHE, ""),
        "MIT": (MIT, ""),
        "BSD-2-Clause": (BSD % "", ""),
        "BSD-3-Clause": (BSD % NAMES, ""),
        "ISC": (ISC, ""),
        "GPL-3.0-or-later": (GPL % ("program", ":", "", ",", 3), ""),
        "GPL-2.0-or-later": (GPL % ("program", ";", "", ";", 2), ""),
        "LGPL-3.0-or-later": (GPL % ("library", ":", "Lesser ", ",", 3), "<GnuHope><GnuSee>"),
        "MPL-2.0": (MPL, ""),
    }
    rows, want = [], {}
    for name, (text, rest) in notices.items():
        for width in (10_000, 78, 72):
            for mark in ("", " * ", "# ", "// ", ";; ", "dnl "):
                lines = [x for p in text.split("\n") for x in textwrap.wrap(p, width) or [""]]
                for end in ("\n", "\r\n"):
                    want[len(rows)] = (name, rest)
                    rows.append((len(rows), end.join(["/*", mark + "Copyright (c) 2020 Someone", mark, *(mark + x for x in lines), " */", "int main() {}"])))
    got = collected(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in got} == want


def test_license_gaps_and_sentences_inside_lines(spark):
    four = BSD % (ADS + NAMES.replace("3.", "4."))
    rows = [
        (1, four),  # the acknowledgement itself is another sentence
        (2, "Licensed under the MIT License\nand something else"),
        (3, "We are not licensed under\nthe MIT License"),
        (4, "(a) Licensed under CC BY 4.0\n(b) Licensed under the ISC License"),
    ]
    got = {r["doc_id"]: r for r in collected(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[1]["sentence_ids"] == "<BsdRedist><BsdSource><BsdBinary><BsdAds><?><BsdNames><BsdAsIs>"
    assert got[2]["licenses"] == "MIT"
    assert got[3]["sentence_ids"] == ""
    assert got[4]["sentence_ids"] == "<CcByRef><IscRef>"


def test_measures_match_brute_force(odd, plain):
    rx = re.compile(r"[^\x20\x09-\x0D]+")

    def expected(text):
        text = text or ""
        words = rx.findall(text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if counts[g] > 1:
                hit.update(range(i, i + 5))
        lines = [x for x in text.split("\n") if rx.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text)
        return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit))

    again = [(i, (t or "") + "\n" + (t or "") + " #") for i, t in plain]
    df = odd.select("doc_id", "text").unionByName(
        odd.sparkSession.createDataFrame(again, "doc_id long, text string")
    )
    got = [(r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in collected(quality.measured(df))]
    assert as_sorted(got) == as_sorted((i, *expected(t)) for i, t in [*plain, *again])


@pytest.mark.parametrize(("k", "n", "p"), [(0, 30, 0.1), (3, 50, 0.05), (40, 40, 0.2), (7, 5000, 0.002)])
def test_binomial_tail_is_exact(spark, k, n, p):
    want = math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_cutoffs_hold_their_risk(spark):
    good = [(k, "word " * 3 + " ".join(f"w{k}x{j}" for j in range(20)), "en") for k in range(6000)]
    bad = [(10_000 + k, " ".join(f"w{k}x{j}###***" for j in range(20)), "en") for k in range(300)]
    few = [(20_000 + k, " ".join(f"w{k}x{j}###***" for j in range(20)), "xx") for k in range(10)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"))
    got = {r["doc_id"]: r["kept"] for r in collected(quality.judge(docs, labels))}
    assert all(got[i] for i, _, _ in good)
    assert not any(got[i] for i, _, _ in bad)
    assert all(got[i] for i, _, _ in few), "a stratum with few labels rejects nothing"


def test_small_strata_get_cutoffs(spark):
    rows = []
    for n, lang in enumerate(("en", "fr", "de", "es")):
        for k in range(330):
            words = " ".join(f"w{lang}{k}x{j}" for j in range(20))
            bad = k % 11 == 0
            rows.append((1000 * n + k, words + (" " + "#" * 200 if bad else ""), lang, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = {r["doc_id"]: r["kept"] for r in collected(quality.judge(docs.drop("quality"), docs.select("doc_id", "quality")))}
    assert all(got[i] == bool(good) for i, _, _, good in rows)


def test_joint_rule_keeps_to_its_share(spark):
    # every measure alone rejects 3 % of the good rows, together they would reject 12 %
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4000):
        good = k % 4 > 0
        values = [0.0] * len(quality.MEASURES)
        for m in range(4):
            values[m] = float(rng.random() < (0.03 if good else 0.4))
        rows.append((k, "xx", int(good), *values))
    names = ", ".join(f"{m} double" for m in quality.MEASURES)
    df = spark.createDataFrame(rows, f"doc_id long, lang string, quality int, {names}")
    got = collected(quality.cutoffs(df, "lang"))
    assert len(got) == 1 and 0 < got[0]["n_rejected"] <= 0.05 * got[0]["n_good"]


def test_judge_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = collected(quality.judge(odd, labels))
    assert len(got) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (0, 1, 2, 3))
    assert quality.judge(odd.limit(0), labels.limit(0)).count() == 0


def test_line_digest_of_query(spark, odd):
    text = drop_repeated_lines(odd.filter("doc_id = 0")).first()["text"]
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
