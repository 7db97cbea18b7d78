import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark import workspace
from shelfspark.llm import bitsliced, classifier, licenses, quality_rules, sharding

rnd = random.Random(8)


def test_repeated_words_and_lines(spark):
    rows = [(1, "a b c d e f\na b c d e g h", "s"), (2, "x " * 30, "s"), (3, None, None), (4, "", "s"), (5, "Dup.\nDup.\n \nDup.\x0bq #*$", "s"), (6, "w1 w2 w3 w4 w5", "s")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for k, text, _ in rows:
        import re

        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)), k
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def frequent_corpus():
    """A host whose line is everywhere, a host where copies of one text are, and clean rows."""
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    rows = [(i, f"Common  footer of this HOST with rather many words in it to fill it\n{words(2)}", "h1", 1) for i in range(80)]
    rows += [(100 + i, f"common footer of this host with rather many words in it to fill it\n{words(60)}", "h1", 1) for i in range(5)]
    rows += [(200 + i, "One text that is copied often and that has eleven words", "h2", 1) for i in range(90)]
    return [*rows, (300, words(30), None, 1), (300, words(30), None, 1), (301, None, "h1", 1)]


def test_line_frequency_equals_sql_and_spares_copies(spark):
    rows = frequent_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, removed int").repartition(5)
    got = quality_rules.judge(df).where("doc_id <> 300").select("doc_id", "n_words", "base_failed", "kept", "left_words").orderBy("doc_id").collect()
    con = duckdb.connect()
    documents = df.where("doc_id <> 300").select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.register("documents", documents)
    want = con.sql(f"SELECT doc_id, n_words, base_failed, kept, left_words FROM ({quality_rules.ORACLE}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got] == want
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {0} | set(range(100, 105)) | set(range(200, 290))
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.clean(df).collect()}
    assert set(cleaned) == kept | {300} and "footer" in cleaned[0] and "footer" not in cleaned[101].lower() and quality_rules.clean(df).columns == df.columns


def test_scores_do_not_depend_on_the_texts_beside_them():
    texts = ["", "one", *(" ".join(rnd.choice(["alpha", "Beta,", "gamma!", "9"]) for _ in range(rnd.randint(1, 200))) for _ in range(200))]
    w = np.random.default_rng(3).standard_normal((1 << classifier.BITS) + 1).astype(np.float32)
    together = classifier.score_texts(texts, w)
    assert [classifier.score_texts([t], w)[0] for t in texts] == together.tolist() and len(classifier.score_texts([], w)) == 0


def test_training_equals_a_plain_follow_the_regularised_leader(monkeypatch):
    """One coordinate at a time, in plain Python, from the published update."""
    texts = [" ".join(rnd.choice(["a", "b", "c", "D!"]) for _ in range(8)) for _ in range(30)]
    labels = [int("a" in t.split()[:3]) for t in texts]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= classifier.L1:
            return 0.0
        return (math.copysign(classifier.L1, z[i]) - z[i]) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2)

    for _ in range(classifier.EPOCHS):
        for t, y in zip(texts, labels):
            at, x, _ = classifier.features([t])
            row = {1 << classifier.BITS: 1.0}
            for i, v in zip(at.tolist(), x.tolist()):
                row[i] = row.get(i, 0.0) + v
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(weight(i) * v for i, v in row.items())))))
            for i, v in row.items():
                w, g = weight(i), (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / classifier.ALPHA * w
                n[i] = n.get(i, 0.0) + g * g
    got = classifier.fit(texts, labels)
    want = np.zeros_like(got)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-5) and np.abs(want).max() > 0.05


def test_classifier_learns_from_rows_that_are_not_held_out(spark):
    good = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(60))
    rows = [(i, good() if i % 4 else good().replace(" ", "*** ").upper(), int(bool(i % 4))) for i in range(600)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows] + [(9000, None, 0.1), (9001, "", 0.1), (9002, "word " * 50000, 0.1)], "doc_id long, text string, score double")
    # Held-out rows carry wrong labels: learning from them would show.
    out = {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    labels = spark.createDataFrame([(k, 1 - y if k in out else y) for k, _, y in rows] + [(None, 1), (1, None)], "doc_id long, quality int")
    w = classifier.train(docs, labels)
    assert (w == classifier.train(docs.repartition(7), labels.repartition(3))).all()
    scored = {r["doc_id"]: r["score"] for r in classifier.score(docs.drop("score"), w).collect()}
    held = [(scored[k] >= classifier.THRESHOLD) == bool(y) for k, _, y in rows if k in out]
    assert np.mean(held) > 0.99 and all(0 <= s <= 1 for s in scored.values()) and scored[9000] == scored[9001]
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} <= {0.5, 0.1}
    assert (classifier.train(docs, labels.limit(0)) == 0).all() and classifier.score(docs.drop("score").limit(0), w).count() == 0
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", classifier.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(flags[k] == (k in out) for k, _, _ in rows)


LICENCES = [
    (1, "Code.\nReleased under the MIT License.\nMore.", "MIT", 1),
    (2, "Licensed under the Apache License,  Version 2.0.", "Apache-2.0", 1),
    (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT", 2),
    (4, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0", 1),
    (5, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0|GPL-3.0-only", 2),
    (6, "A text about software and permission.", "", 0),
    (7, None, "", 0),
    (8, "", "", 0),
    (8, "you may not use this file except in compliance with the license. You may obtain", "", 1),
    (9, "Released under the MIT License. " * 3000, "MIT", 3000),
]


def test_licences(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t, _, _ in LICENCES], "doc_id long, text string, licences string")
    got = sorted((r["doc_id"], r["n_known"], r["licences"]) for r in licenses.recognise(df).collect())
    assert got == sorted((k, n, x) for k, _, x, n in LICENCES)
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toPandas()
    con.register("documents", documents)
    assert sorted((k, n, x) for k, n, x in con.sql(f"SELECT doc_id, n_known, licences FROM ({licenses.ORACLE})").fetchall()) == got
    assert licenses.recognise(df.limit(0)).count() == 0


BSD = """Copyright (c) 2020, A Holder

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
VERBATIM = [
    ("BSD-2-Clause", 3, BSD),
    ("BSD-3-Clause", 4, BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""),
    ("MIT", 4, """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE."""),
    ("GPL-3.0-or-later", 2, """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""),
    ("GPL-2.0-or-later", 1, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("Apache-2.0", 4, """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("MPL-2.0", 1, "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"),
    *[(licence, 1, f"// SPDX-License-Identifier: {name}\nint main;") for name, licence in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-only", "GPL-3.0-only"), ("GPL-3.0-or-later", "GPL-3.0-or-later"), ("GPL-2.0-only", "GPL-2.0-only"), ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-2-Clause"))],
    ("", 0, "You may read this. Released under\n\nthe MIT License"),
]


def test_verbatim_and_wrapped_licences(spark):
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(VERBATIM)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["n_known"]) for r in licenses.recognise(df).collect()}
    assert got == {i: (x, n) for i, (x, n, _) in enumerate(VERBATIM)}


def test_every_known_sentence_has_an_anchor_and_normal_form(spark):
    for s in licenses.SENTENCES.values():
        assert any(a in s for a in licenses.ANCHORS)
    df = spark.createDataFrame([(i, s) for i, s in licenses.SENTENCES.items()], "i int, s string")
    for r in df.select("s", licenses.sentences(licenses._without_v(F.col("s")))[0].alias("n")).collect():
        assert r["n"] == r["s"].replace("v. 2.0", "v.2.0")


@pytest.mark.parametrize("n, low, high, dims", [(700, -130, 140, 16), (70, -2, 2, 3), (1, -5, 5, 4), (300, 0, 1, 5)])
def test_bit_sliced_top_equals_brute_force(n, low, high, dims):
    g = np.random.default_rng(n)
    values, ids = g.integers(low, high + 1, (n, dims)), g.permutation(3 * n)[:n]
    index = bitsliced.BitSliced(ids, values)
    for i in range(min(n, 40)):
        scores = values @ values[i]
        want = sorted((-int(s), int(k)) for s, k in zip(scores, ids) if k != ids[i])[:5]
        assert index.top(values[i], 5, but=int(ids[i])) == [(-s, k) for s, k in want]


def test_top_k_over_odd_vectors(spark):
    rows = [(i, [float(rnd.uniform(-0.5, 0.5)) for _ in range(4)], 1) for i in range(200)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None, 0.0, 0.0], 1), (303, [float("nan")] * 4, 1), (304, [float("inf")] * 4, 1), (None, [0.1] * 4, 1), (350, [0.5] * 4, 1), (350, [0.5] * 4, 1), (400, [1e8, -1e8, 0.0, 3.0], 1), (401, [-3e6, 1.0, 0.25, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, rank int")
    q = bitsliced.quantised(df, "vec_id", "v")
    got = sorted(tuple(r) for r in bitsliced.top_k(q, q.where("id % 50 = 0"), block_rows=64, query_rows=3).select("query_id", "rank", "vec_id", "score").collect())
    held = [(k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for k, v, _ in rows if k is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for k, x in held:
        if k % 50 == 0:
            near = sorted((-int(x @ y), j) for j, y in held if j != k)[:5]
            want += [(k, i, j, -s) for i, (s, j) in enumerate(near, 1)]
    assert [g for g in got if g[0] != 350] == sorted(w for w in want if w[0] != 350)
    assert bitsliced.top_k(q.limit(0), q.limit(0)).count() == 0


def test_shards_are_near_equal_gapless_and_move_little(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("size"), F.lit("x").alias("extra"))
    df = df.unionByName(df.limit(3)).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) doc_id, 5L size, 'x' extra"))
    folder = workspace.new_path(spark, "test-slots")
    got = sharding.shard_records(df, "doc_id", "size", 16, folder=folder)
    per = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert len(per) == 16 and max(r["b"] for r in per) <= 1.01 * min(r["b"] for r in per)
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 == r["d"] - 1 for r in per) and sum(r["n"] for r in per) == 5004
    assert sharding.load_map(spark, folder, 0).count() == sharding.load_map(spark, folder, 1).count() == sharding.N_SLOTS
    sizes = {s: rnd.randint(1, 1000) for s in range(512)}
    one = sharding.rebalance(sharding.initial_map(8, 512), sizes)
    two = sharding.rebalance(one, sizes, 9)
    moved = sum(sizes[s] for s in range(512) if one.shards[s] != two.shards[s])
    assert two.version == 2 and moved < 1.3 * sum(sizes.values()) / 9
    assert sharding.shard_records(df.limit(0), "doc_id", "size", 4).count() == 0
