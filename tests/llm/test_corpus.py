"""Corpus operators against brute force on small fixtures with ties, nulls, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from collatio.llm import balltree, components, jaccard, langid, licences, matroska, quality, spans
from conftest import SF


def words(t):
    return [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]


def shingle_set(t, w=4):
    x = words(t)
    return frozenset(tuple(x[i : i + w]) for i in range(len(x) - w + 1)) if len(x) >= w else frozenset([tuple(x)] if x else [])


def linked(rows, w=4, percent=85):
    sets = [shingle_set(t, w) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows: list = []
    for size in (3, 8, 20, 60, 150, 60, 20):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.choice([1, 3, 9])):
            x = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                x[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    core = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(60):  # one large group of near copies
        x = list(core)
        for _ in range(rng.randint(0, 8)):
            x[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(x)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (5, "a"), (1005, "a"), (1006, "longer " * 5000)]


def test_op8(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(4)
    assert sorted(map(tuple, jaccard.digest(df).collect())) == linked(rows)


def test_op8_equals_its_sql(spark, duck):
    got = jaccard.digest(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(jaccard.ORACLE_SQL).fetchall())


def test_op8_a_near_copy_of_many_exact_ones(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 8)
    rng = random.Random(12)
    rows = []
    for g in range(12):  # the two sets of a group may have equal or unequal salts
        base = [f"g{g}w{rng.random()}" for _ in range(80)]
        rows += [(100 * g + k, " ".join(base)) for k in range(1, 21)] + [(100 * g + 50, " ".join([*base[:-1], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.digest(df).collect())) == linked(rows)


def test_op8_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    size, count = 60, 5000
    words = np.tile(np.arange(size), (count, 1))
    for row in words:
        at = rng.choice(size, rng.integers(0, 7), replace=False)
        row[at] = 1000 + rng.integers(0, 40, len(at))
    texts = [" ".join(f"w{x}" for x in row) for row in words.tolist()]
    known: dict = {}
    sets = [{known.setdefault(tuple(r[i : i + 4]), len(known)) for i in range(size - 3)} for r in words.tolist()]
    held = np.zeros((count, len(known)), np.float32)
    for i, x in enumerate(sets):
        held[i, list(x)] = 1
    held_by_two = held[:, held.sum(0) > 1]
    n = np.array([len(x) for x in sets])
    root = np.arange(count)
    for i in range(0, count, 500):
        both = held_by_two[i : i + 500] @ held_by_two.T
        a, b = np.nonzero(100 * both >= 85 * (n[i : i + 500, None] + n[None] - both))
        u, v = components.forest(np.concatenate([a + i, np.arange(count)]), np.concatenate([b, root]))
        root[u] = v
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.digest(df).collect()}
    assert got == {i: (int(n[i]), int(root[i])) for i in range(count)}


def test_op8_on_nothing(spark):
    assert jaccard.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.digest(only).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(5, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 62, 3).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            from collatio.llm.shingles import bitmap

            assert jaccard.may_link(bitmap(a), len(a), bitmap(b), len(b), 85)


@pytest.mark.parametrize("block", [200_000, 20])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)  # few links end in one task, more take the distributed steps
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)] + [(200, 200 + i) for i in range(1, 50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100} | {200 + i: 200 for i in range(1, 50)}


def spans_by_hand(rows):
    seen, gone = set(), collections.defaultdict(set)
    for d, h, t in sorted({(d, spans.text_hash(t), t) for d, t in rows if t}):
        u = [" ".join(x.translate(spans.ASCII_LOWER).split()) for x in spans.sentences(t)]
        for i in range(len(u) - spans.RUN + 1):
            run = tuple(u[i : i + spans.RUN])
            if run in seen:
                gone[d, h].update(range(i, i + spans.RUN))
            seen.add(run)
    out = []
    for d, t in rows:
        u = spans.sentences(t) if t else []
        g = gone.get((d, spans.text_hash(t or "")), set())
        out.append((d, "".join(x for i, x in enumerate(u) if i not in g) if t else t, len(u), len(g)))
    return sorted(out, key=str)


def test_op3(spark):
    rng = random.Random(3)
    rows = [(i, ". ".join(rng.choice(["aa bb", "cc", "Dd ee ff", "gg"]) for _ in range(rng.randint(0, 12))) + ".") for i in range(200)] + [(1, "aa bb. cc. gg. gg. cc."), (7, None), (8, ""), (9, "x" * 50_000), (10, "word " * 9000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int").repartition(5)
    got = sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in spans.digest(df).collect()), key=str)
    assert got == spans_by_hand(rows)


def test_a_long_passage_is_cut_whichever_way_it_is_written(spark):
    rng = random.Random(8)
    for ends in (0, 3, 11):  # sentences in the passage
        passage = " ".join(f"p{i}" + ("." if ends and i % (54 // ends) == 0 else "") for i in range(55)) + "."
        own = [" ".join(f"d{k}x{rng.random()}" for _ in range(30)) + "." for k in range(3)]
        rows = [(k, f"{o}\n{passage}\n{o[::-1]}") for k, o in enumerate(own)] + [(9, "A clean one. It stays. As it is. All of it. Yes. Every bit.")]
        got = {r.doc_id: r for r in spans.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert "p30" in got[0].text and got[9].n_removed == 0
        assert not any(f"p{i}" in got[1].text.replace(".", " ").split() for i in range(55)) and "d1x" in got[1].text


def test_any_fifty_shared_words_have_a_run_in_common():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)] + ["the"] * 100

    def prose(n, tag=""):
        return [rng.choice(vocabulary) + tag + (rng.choice(".,!?") if rng.random() < 0.12 else "") for _ in range(n)]

    for _ in range(600):
        passage = [w.rstrip(".!?") if rng.random() < 0.5 else w for w in prose(50)]
        hosts = [" ".join([*prose(rng.randint(0, 40), k), *passage, *prose(rng.randint(0, 40), k)]) for k in "ab"]
        runs = [set(zip(*map(np.ndarray.tolist, spans.run_hashes(spans.units_of(t))), strict=True)) for t in hosts]
        assert runs[0] & runs[1], hosts
        assert all("".join(spans.sentences(t)) == t for t in hosts)


def test_op3_cuts_a_passage_within_a_sentence(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(k, " ".join(f"d{k}x{rng.random()}" for _ in range(5 + 4 * k)) + ", " + passage + " " + " ".join(f"e{k}x{rng.random()}" for _ in range(20)) + ".") for k in range(3)]
    got = {r.doc_id: r.text.split() for r in spans.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert " ".join(got[0]) == rows[0][1]
    for k in (1, 2):
        assert not {f"p{i}" for i in range(12, 43)} & set(got[k]) and sum(w.startswith("d") for w in got[k]) > 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 70_000])
def test_matroska_round_trip(n):
    size, payload = matroska.payload_of("é" * n)
    back, m = matroska.read_back(matroska.mux(payload))
    assert back == payload and size == 2 * n and len(payload) % 64 == 0 and payload
    assert len(m.cues) == len(m.clusters) and {c for _, _, c in m.cues} == set(m.clusters)


def test_lacings_unknown_sizes_and_groups():
    frames = [b"a" * 5, b"b" * 300, b"", b"c" * 10_000, b"d"]
    for lacing in (1, 3):
        m, body = matroska.Media(), matroska.block_body(1, -5, frames, lacing)
        matroska.read_block(body, 0, len(body), m, 10, None, 0)
        assert [body[p[2] : p[2] + p[3]] for p in m.packets] == frames and m.packets[0][1] == 5_000_000
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, matroska.block_body(2, 1, [b"xy", b"zw"], 2)) + matroska.number(matroska.REFERENCE, 1))
    unknown = lambda ident, body: ident.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + body
    data = matroska.element(matroska.EBML, b"") + unknown(matroska.SEGMENT, unknown(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 7) + group) + unknown(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 9)))
    m = matroska.parse(data)
    assert m.error is None and len(m.clusters) == 2
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4]) for p in m.packets] == [(2, 8_000_000, b"xy", False), (2, 8_000_000, b"zw", False)]
    assert matroska.parse(matroska.mux(b"x" * 640)[:-300]).error and matroska.parse(b"junk").error


def test_op1(spark):
    rows = [(1, "text"), (2, None), (3, ""), (1, "text"), (4, "long " * 20_000)]
    got = {r.doc_id: r for r in matroska.digest(spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")).collect()}
    raw = b"text" + bytes(60)
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (4, 64, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw))
    assert got[2][1:] == got[3][1:] and got[2].payload_bytes == 64
    media = spark.createDataFrame([(1, matroska.stored("text")), (2, None), (3, b"junk")], "doc_id long, media binary")
    table = {r.id: r for r in matroska.packets(media).collect()}
    assert table[1].byte_length == 64 and table[1].cued and table[3].error and 2 not in table


def brute_top(vectors):
    out = []
    for i, v in vectors:
        if i % 50:
            continue
        scores = sorted(((-sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(v, w)), j) for j, w in vectors if j != i))[:5]
        out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    return sorted(out)


def test_op9(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD", 64)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)] + [(400 + i, [0.5] * 8) for i in range(20)]
    bad = [(500, None), (550, [1.0] * 7 + [float("nan")]), (600, [None] * 8), (None, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + bad], "vec_id long, embedding array<double>, score string")
    assert sorted(map(tuple, balltree.digest(df).collect())) == brute_top(vectors)
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, balltree.digest(few).collect())) == brute_top(vectors[:3])
    assert balltree.digest(few.limit(0)).count() == 0
    # rows of one id are candidates of each other, and lengths don't mix
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [9.0, 9.0, 9.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, balltree.digest(twice).collect())) == [(50, 1, 50, 65536)] * 2 + [(50, 2, 7, 32768)] * 2


def test_op10(spark):
    s = licences.SENTENCES
    said = lambda *ids: ". ".join(s[i].capitalize() for i in ids) + "."
    rows = [(1, "Intro here.\n" + said("mit-title-2", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")), (2, said("mit-grant", "mit-as-is")), (3, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. x"), (4, None), (5, ""), (None, "All rights reserved."), (3, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. x")]
    got = sorted((str(r.doc_id), r.license_id, r.rule_id, r.first_word, r.last_word) for r in licences.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, pos int")).collect())
    size = sum(len(s[k].split()) for k in ("mit-title-2", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    assert got == [("1", "MIT", "mit-text-titled", 2, 1 + size), ("3", "CC-BY-NC-4.0", "cc-by-nc-reference", 0, 6), ("3", "MIT", "mit-reference", 7, 11), ("None", "proprietary", "all-rights-reserved", 0, 2)]


def test_op10_every_known_sentence_is_told_and_every_rule_can_match(spark):
    assert all(any(w in text for w in licences.TOLD_BY) for text in licences.SENTENCES.values())
    rows = [(k, ". ".join(licences.SENTENCES[x] for x in ids) + ".") for k, (_, _, ids) in enumerate(licences.RULES)]
    got = {(r.doc_id, r.rule_id) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, name) for k, (name, _, _) in enumerate(licences.RULES)}


def test_op10_on_nothing_and_on_very_long_texts(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "* " * 200_000 + "\nAll rights reserved.\n" + "\n \n" * 100_000), (2, "word " * 300_000 + "all rights reserved now"), (3, "All rights reserved. " * 20_000), (4, "not all rights reserved")]
    got = sorted((r.doc_id, r.first_word, r.last_word) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 2), *((3, 3 * k, 3 * k + 2) for k in range(20_000))]


PUBLISHED = {
    "mit-text-titled": """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "apache-header": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       https://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.""",
    "gpl-3-notice-copy": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-2-notice": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
 * implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for
 * more details.""",
    "bsd-3-text": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3) Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "mpl-2-header": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "lgpl-2.1-notice-copy": """    This library is free software; you can redistribute it and/or
    modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either
    version 2.1 of the License, or (at your option) any later version.

    This library is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
    Lesser General Public License for more details.

    You should have received a copy of the GNU Lesser General Public
    License along with this library; if not, write to the Free Software
    Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA""",
    "agpl-3-notice": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.""",
    "isc-text-titled": """ISC License

Copyright (c) 2019, Some One <some@one.example>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-text-reserved": """Copyright (c) 2018, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def test_op10_licences_as_published(spark):
    rows = [(k, text) for k, text in enumerate(PUBLISHED.values())] + [(50, "One more.\n" + PUBLISHED["mpl-2-header"] + "\nAnd text.")]
    rows += [(100 + k, text.replace("\n\n", "\n").replace("\n", " ")) for k, text in enumerate(PUBLISHED.values()) if "(c) 20" not in text and "*" not in text]
    got = collections.defaultdict(list)
    for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.rule_id, r.first_word, r.last_word))
    names = list(PUBLISHED)
    assert {d: [x[0] for x in found] for d, found in got.items()} == {d: ["mpl-2-header" if d == 50 else names[d % 100]] for d, _ in rows}
    size = sum(len(licences.SENTENCES[k].split()) for k in ("mpl-subject", "mpl-copy"))
    assert got[50] == [("mpl-2-header", 2, 1 + size)]


def sample(lang, rng, n):
    parts = {"en": ["the", "ing", "tion", "of ", "and"], "de": ["sch", "ung", "der ", "keit", "ß"], "fr": ["eau", "ment", "le ", "oi", "é"]}[lang]
    return "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n))


def test_language_model_on_held_out_texts():
    rng = random.Random(1)
    rows = [(lang, sample(lang, rng, rng.randint(5, 80))) for _ in range(80) for lang in ("en", "de", "fr")]
    model = langid.fit(rows)
    test = [(lang, sample(lang, rng, 30)) for _ in range(50) for lang in ("en", "de", "fr")]
    data, offsets = langid.padded(pa.array([t for _, t in test]))
    picked = [model.languages[k] for k in langid.scores(model, data, offsets).argmax(axis=1)]
    assert np.mean([p == lang for p, (lang, _) in zip(picked, test)]) > 0.97
    alone = langid.scores(model, *langid.padded(pa.array([test[3][1]])))
    assert np.allclose(alone[0], langid.scores(model, data, offsets)[3])


def test_op2_edges(spark):
    rng = random.Random(2)
    rows = [(i, sample(lang, rng, 40), lang) for i, lang in enumerate(["en", "de"] * 40)] + [(900, None, "en"), (901, "12 -- 34", "en"), (902, "", None), (903, "字", None)]
    got = {r.doc_id: r for r in langid.digest(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, _score double")).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903].lang_pred in ("en", "de")
    assert got[0].held_out == (zlib.crc32(b"0") % 4 == 2)
    empty = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.digest(empty).first().lang_pred == "und"


def test_quality_model_on_held_out_texts():
    rng = random.Random(4)
    good = lambda: " ".join(sample("en", rng, 3) for _ in range(rng.randint(20, 200)))
    bad = lambda: " ".join(x.upper() + "!!" for x in good().split())
    rows = [(k % 2, good() if k % 2 else bad()) for k in range(200)]
    model = quality.fit(rows, {0: 0.2, 1: 0.8})
    test = [(k % 2, good() if k % 2 else bad()) for k in range(60)]
    scores = quality.score_texts(model, pa.array([t for _, t in test]))
    assert np.mean((scores >= 0.3) == np.array([y for y, _ in test])) > 0.95
    ends = good() * 3 + bad() * 3  # what stands at the end counts too
    assert quality.score_texts(model, pa.array([ends]))[0] < quality.score_texts(model, pa.array([ends[: len(ends) // 3]]))[0]


def test_op6_edges(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None), (5, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.digest(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.digest(docs, one).collect())
    assert len(list(quality.chunks_of(np.zeros(1000, np.uint8)))) == 5
