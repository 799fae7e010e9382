"""The dealt operators against brute force, and each on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import collections
import hashlib
import itertools
import random
import textwrap
import time
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlode.functions import store
from lumenlode.llm import exact, graph, licences, lines, mixing, packing, pairs, quality, queries, sharding, simhash, suffixes, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, fp long, n long, block int, `a.b` string"


def odd(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "s" if t else None, None, "r", None, 1, None, 2, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, ODD)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
HARD = [None, "", " \n\t ", "one", "one", "A b c d e f g h i j.\n" * 30, LONG, LONG, "x" * 5000, "é ü ñ 日本 \U0001f600"]
OPERATORS = {
    "quality": lambda df: quality.judge(df),
    "licences": lambda df: licences.scan(df),
    "simhash": lambda df: simhash.near_duplicates(df),
    "one_of_each": lambda df: simhash.one_of_each(df),
    "mixing": lambda df: mixing.mix(df, queries.source_weights),
    "sharding": lambda df: sharding.shard(df, 4, F.col("text"), [F.col("doc_id")], carry={"doc_id": F.col("doc_id")}),
    "lines": lambda df: lines.dedup_lines(df),
    "exact": lambda df: exact.exact_duplicates(df),
    "packing": lambda df: packing.pack(df, queries.vocabulary_path()),
    "suffixes": lambda df: suffixes.remove_repeats(df),
    "toxicity": lambda df: toxicity.score(df, toxicity.Model(0.0, {b"one": 1.0})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    ids = [None, 1, 2, 3, 3, 5, 6, 7, 8, None]
    out = OPERATORS[name](odd(spark, HARD, ids)).collect()
    if name == "one_of_each":
        assert len(out) == 6  # the three without words are one group, "one" and the long text have copies
    elif name == "packing":
        assert sum(r.piece == 0 for r in out) == len(HARD)
    else:
        assert len(out) == len(HARD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](odd(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_hard_and_empty_tables(spark, stage):
    f = corpus_pipeline.STAGES[stage][1]
    df = odd(spark, HARD)
    out = f(spark, df, SF)
    if stage < 4:
        assert out.columns == df.columns
    out.collect()
    assert f(spark, df.where("false"), SF).collect() == []


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


WORDS = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    w = WORDS.findall(text or "")
    lines_ = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    places = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines_) - len(set(lines_)), len(places)


def test_quality_measures(spark, texts):
    for r in queries.op1_quality_rules(spark, SF).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_label_model_recovers_planted_classes():
    rng = random.Random(0)
    seen, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(4000):
        good = rng.random() < 0.85
        votes = tuple((quality.GOOD if rng.random() < 0.7 else 2) if good else (quality.BAD if rng.random() < 0.5 else 2) for _ in range(6))
        seen[votes] += 1
        truth[votes].append(good)
    p = quality.fit(sorted(seen.items()))
    right = sum(sum((p[v] >= 0.5) == g for g in gs) for v, gs in truth.items())
    assert right / 4000 > 0.97


def test_labelled_junk_goes_and_clean_text_stays(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "y")
    got = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed").join(labels, "doc_id")
    n = {(r.y, r.kept): r["count"] for r in got.groupBy("y", "kept").count().collect()}
    assert n.get((0, False), 0) >= 0.9 * sum(v for k, v in n.items() if k[0] == 0)
    assert n.get((1, True), 0) >= 0.99 * sum(v for k, v in n.items() if k[0] == 1)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary_path())
    got = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in queries.op2_best_fit_packing(spark, SF).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, r in enumerate(sorted(got[doc], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length].tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, 2048 * k, zlib.crc32(part))
        assert sum(r.length for r in got[doc]) == len(ids)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for v in got.values() for r in v)
    assert len(bins) <= -(-total // 2048) + 1


def test_local_search_beats_best_fit():
    rng = random.Random(1)
    lengths = [rng.randint(300, 1100) for _ in range(3000)]
    first, best = packing.pack_block(lengths, 2048, passes=0), packing.pack_block(lengths, 2048)
    assert len(best) < len(first) and sorted(i for b in best for i in b) == list(range(3000))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in best)


def test_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    whole, ours = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    odd_texts = ["", "a  b", "It's we'll 'SS 12a3", "naïve ÉCOLE Σίσυφος ΣΑΣ x　y", "a\x1cb", "<|endoftext|> hi", "é école", "\x00 \x7f\x0bvt", "İ ß ﬁ", "日本語", "x" * 300, "a" * 70 + " b"]
    for t, ids in zip(odd_texts, ours(odd_texts)):
        assert ids == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def brute_repeats(all_texts, n):
    seen = collections.Counter(t[i : i + n] for t in all_texts for i in range(len(t) - n + 1))
    for t in all_texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone) if not g)
        yield len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_repeats_equal_brute_force(spark, texts):
    docs = sorted(texts)
    want = dict(zip(docs, brute_repeats([(texts[d] or "").encode() for d in docs], 400)))
    for r in queries.op3_suffix_dedup(spark, SF).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


@pytest.mark.parametrize("most", [2, 8192])
def test_repeats_on_planted_passages(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)  # 2: nearly every anchor takes the other way
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    p, q = text(700), text(450)
    all_texts = [text(rng.randint(0, 900)) + rng.choice([p, q, p[100:], q[:420], "a" * 1000, p[:399], ""]) + text(rng.randint(0, 300)) for _ in range(40)] + ["z" * 1200, None, p]
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    want = dict(enumerate(brute_repeats([(t or "").encode() for t in all_texts], 400)))
    for r in suffixes.remove_repeats(df, 400, keep=["doc_id"]).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.row.doc_id], r.row.doc_id


def test_maximal_repeats_have_all_occurrences():
    contexts = [b"xxABCDEFyy", b"zzABCDEFww", b"qqABCDqqqq", b"xxABCDEF!!"]
    found = {(n, tuple(sorted(w))) for n, w in suffixes.maximal_repeats(contexts, [3] * 4, 4)}
    assert found == {(8, ((0, 0), (3, 0))), (6, ((0, 2), (1, 2), (3, 2))), (4, ((0, 2), (1, 2), (2, 2), (3, 2)))}


def test_licences(spark):
    header = "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    df = odd(spark, [header, "Text.\nReleased under the MIT License.\nAll rights reserved.", "MIT License", None])
    got = {r.row.doc_id: (r.licence, r.kind, r.licences) for r in licences.scan(df).collect()}
    assert got == {0: ("Apache-2.0", "header", "Apache-2.0"), 1: ("MIT", "notice", "MIT,proprietary"), 2: (None, None, ""), 3: (None, None, "")}


def test_wrapped_licences(spark):
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
    wrap = lambda *ids: "\n".join(textwrap.fill(licences.SENTENCES[i - 1] + ".", 72, initial_indent=" * ", subsequent_indent=" * ") for i in ids)
    inside = "This file is released under the MIT License.\nAll rights\nreserved"
    cut = "Licensed under the Apache License. Version 2.0"
    got = {r.row.doc_id: (r.sequence, r.licence, r.kind) for r in licences.scan(odd(spark, [apache, wrap(8, 9, 10), wrap(18, 19, 20, 21), wrap(12, 13, 14), inside, cut])).collect()}
    assert got == {
        0: (",2,3,4,5,6,", "Apache-2.0", "header"),
        1: (",8,9,10,", "MIT", "text"),
        2: (",18,19,20,21,", "BSD-3-Clause", "text"),
        3: (",12,13,14,", "GPL-3.0-or-later", "header"),
        4: (",7,22,", "MIT", "notice"),
        5: ("", None, None),
    }


def test_licences_as_files_carry_them(spark):
    known = licences.SENTENCES
    header = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    mit = "\n".join(textwrap.fill(known[i - 1] + ".", 80) for i in (8, 9, 10))
    cases = {
        header: ("Apache-2.0", "header"),
        "# " + textwrap.fill(header, 70).replace("\n", "\n# "): ("Apache-2.0", "header"),
        mit: ("MIT", "text"),
        "Copyright (c) 2020 A. All rights reserved.\n\n" + mit: ("MIT", "text"),
        "// SPDX-License-Identifier: MIT\nint x;": ("MIT", "identifier"),
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": ("GPL-2.0-or-later", "identifier"),
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.": ("MPL-2.0", "header"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": ("ISC", "text"),
        "Licensed under CC BY-NC-SA 4.0.": ("CC-BY-NC-SA-4.0", "notice"),
        "a licensed practitioner of software": (None, None),
    }
    got = {r.row.doc_id: (r.licence, r.kind) for r in licences.scan(odd(spark, list(cases))).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_fingerprints_and_components(spark, texts):
    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    fps = {d: fp(t) for d, t in texts.items()}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for r in queries.op5_simhash_near_dedup(spark, SF).collect():
        assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], find(r.doc_id))


def test_links_find_every_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in range(5) for _ in range(3)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    assert {(r.a, r.b) for r in simhash.links(df).collect()} == want


def test_no_ball_of_fingerprints_is_broadcast(spark):
    """Sizes are estimated without the values of the balls, 33 for each entry; at 0.6 GB these would pass through the driver."""
    plan = simhash.links(spark.range(50).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(50), 0), 300: 300, 301: 300}


def test_one_of_each_keeps_the_least_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    copies = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (5, 100, 390)]
    df = odd(spark, [" ".join(base), *copies, " ".join(f"v{rng.randrange(5000)}" for _ in range(400))])
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [0, 4]


def test_one_of_each_finds_every_pair_just_above_the_similarity(spark):
    rng = random.Random(8)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts_ = []
    while len(texts_) < 120:
        a = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 300))]
        b = list(a)
        for i in rng.sample(range(len(a)), len(a) // 40):
            b[i] = "changed"
        x, y = shingles(a), shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            texts_ += [" ".join(a), " ".join(b)]
    assert sorted(r.doc_id for r in simhash.one_of_each(odd(spark, texts_)).collect()) == list(range(0, 120, 2))


def test_targets_fill_up():
    got = mixing.targets({"a": 10, "b": 100, "c": 1000}, {"a": 1, "b": 2, "c": 3})
    assert got["a"] == 30 and got["b"] == 300 and got["c"] == pytest.approx(780)


def test_splitting_tree_deals_exactly():
    counts = [7, 0, 1000, 23]
    got = mixing.split(counts, 16, np.random.default_rng(0))
    assert got.sum(axis=0).tolist() == counts and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1


def test_mix_comes_near_targets_and_repeats(spark, texts):
    source = {r.doc_id: r.source for r in documents(spark).select("doc_id", "source").collect()}
    got = queries.op6_source_mix(spark, SF).collect()
    again = {r.doc_id: r.taken for r in queries.op6_source_mix(spark, SF).collect()}
    taken = collections.Counter()
    for r in got:
        assert r.size == len(WORDS.findall(texts[r.doc_id] or "")) and r.taken <= 3 * r.size and again[r.doc_id] == r.taken
        assert r.size == 0 or len(r.shards) == r.taken // r.size
        taken[source[r.doc_id]] += r.taken
    for r in got:
        assert abs(taken[source[r.doc_id]] - r.target) <= 0.05 * r.target + 50


def test_shards_are_even_and_slots_gapless(spark, texts):
    got = queries.op7_ring_sharding(spark, SF).collect()
    slots = collections.defaultdict(list)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_bounded_loads_move_little():
    rng = random.Random(0)
    ring = sorted((rng.randrange(65536), s) for s in range(8) for _ in range(32))
    counts = {a: rng.randrange(40) for a in range(len(ring))}
    n = sum(counts.values())
    out = sharding.flow(ring, counts, sharding.capacities(n, 8, 0.1))
    home = sum(r["to_rank"] - r["from_rank"] for r in out if ring[r["arc"]][1] == r["shard"])
    assert sum(r["to_rank"] - r["from_rank"] for r in out) == n and home > 0.75 * n


def test_fuzzy_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    df = odd(spark, [f"{line}\nunique words here", line.replace("lazy", "sleepy"), "!!!\n" + line.upper() + ".\nsomething else entirely", "one two\n---\none two"])
    got = {r.row.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got[0] == (f"{line}\nunique words here", 2, 0)
    assert got[1] == ("", 1, 1)
    assert got[2] == ("!!!\nsomething else entirely", 3, 1)
    assert got[3] == ("one two\n---", 3, 1)


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + rng.choice((0, 1, 1))] = rng.choice(([f"x{rng.randrange(100)}"], [f"x{rng.randrange(100)}"], []))
    return w


def test_lines_of_the_edit_similarity_share_a_key():
    rng = random.Random(4)
    for _ in range(300):
        a = [f"w{rng.randrange(rng.choice((3, 300)))}" for _ in range(rng.randint(5, 80))]
        b = edited(rng, a, rng.randrange(len(a) // 4 + 1))
        if len(b) >= 4 and lines.word_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            x, y = (" ".join(w).encode() for w in (a, b))
            slots, counts = np.unique(lines.grams_of([x.decode()], 4) >> np.uint64(42), return_counts=True)
            keys, _, line, _, marks = lines._keys([x, y], 0.8, pairs.Ranks(slots.astype(np.int64), 4 * counts, 1.0))
            assert set(keys[line == 0].tolist()) & set(keys[line == 1].tolist())
            assert np.bitwise_count(marks[0] ^ marks[1]).sum() <= 2 * lines.word_distance(a, b)
            strong = [int.from_bytes(lines.signature(w.split(b" "))) for w in (x, y)]
            assert (strong[0] ^ strong[1]).bit_count() <= 2 * lines.word_distance(a, b)


@pytest.mark.parametrize("wide, hot", [(32, 500_000), (1, 2)])
def test_op8_finds_what_brute_force_on_edit_similarity_finds(spark, tmp_path, monkeypatch, wide, hot):
    monkeypatch.setattr(pairs, "WIDE", wide)  # 1: every group has leaders
    monkeypatch.setattr(pairs, "HOT", hot)  # 2: common keys are cut into parts
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(4, 50))] for _ in range(30)]
    w = [edited(rng, b, rng.randrange(len(b) // 4 + 1)) for b in bases for _ in range(4)]
    w += [edited(rng, bases[0], rng.randrange(len(bases[0]) // 5 + 1)) for _ in range(40)]  # a group with leaders
    root = list(range(len(w)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(w)), 2):
        if lines.word_distance(w[a], w[b]) <= 0.2 * max(len(w[a]), len(w[b])) + 1e-9:
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    odd(spark, [" ".join(x) for x in w]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: int(find(d) != d) for d in range(len(w))}


def test_word_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert lines.word_distance(a, b) == plain(a, b)


def test_exact_beyond_the_broadcast(spark):
    df = odd(spark, ["a", "a", None, "", "b", "a"], [1, 5, 2, 9, 3, 5])
    for most in (200_000, 0):
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(df, broadcast_rows=most).collect())
        assert [g[:3] for g in got] == [(1, 5, 3), (2, 9, 2), (3, 3, 1), (5, 5, 3), (5, 5, 3), (9, 9, 2)]
        assert sum(g[3] for g in got) == 3


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    ours = queries.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(queries.SQL[name]).df()
    cells = lambda df: sorted(tuple(None if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(map(repr, cells(ours))) == sorted(map(repr, cells(theirs)))


def test_toxicity_is_learnt(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op10_pu_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted for r in got if r.toxic) >= 0.5 * sum(r.toxic for r in got)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.05 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("name", ["mixed", "score"])
def test_columns_named_like_ours(spark, name):
    df = spark.createDataFrame([(1, "one two", "s", "x", "y", 5, 0.5)], "doc_id long, text string, source string, _shard string, _ string, placement int, score double")
    if name == "mixed":
        got = mixing.mixed(mixing.mix(df, queries.source_weights)).collect()
        assert [r._shard for r in got] == ["x"] and got[0].placement == 5
    else:
        r = toxicity.score(df, toxicity.Model(0.0, {})).first()
        assert (r.row["_"], r.row["score"], r.score) == ("y", 0.5, 0.5)


def test_units_stay_within_the_generator(monkeypatch, spark):
    monkeypatch.setattr(mixing, "UNITS", 4)
    df = spark.createDataFrame([(i, f"w{i} x", "ab"[i % 2]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(df, queries.source_weights, shards=2).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.row.source] += r.copies * r.size
        assert len(r.placements) == r.copies
    for r in got:
        assert abs(taken[r.row.source] - r.target) <= 0.05 * r.target


def test_passages_too_short_to_be_removed_are_counted(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    p = text(350)
    df = spark.createDataFrame([(0, text(200) + p + text(90)), (1, text(40) + p), (2, text(900))], "doc_id long, text string")
    got = {r.row.doc_id: (r.n_removed, r.n_passages, r.passage_bytes) for r in suffixes.remove_repeats(df, 400, keep=["doc_id"]).collect()}
    assert got[2] == (0, 0, 0) and all(got[i][0] == 0 and got[i][1] == 1 and 350 <= got[i][2] < 360 for i in (0, 1))


def test_nothing_to_learn_from():
    assert toxicity.fit([], [{b"a"}], 0.1).score(None) == pytest.approx(0.1)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def records(n, size, marks):
    r = np.zeros(n, lines.KIND)
    r["key"], r["id"], r["size"], r["marks"] = 7, np.arange(n), size, marks
    return r


def test_wide_groups_of_unlike_records_are_settled_where_they_meet():
    marks = np.random.default_rng(1).integers(0, 1 << 62, (300, 2), dtype=np.uint64)
    marks[40] = marks[250]
    a, b, wide = pairs.meeting(records(300, 10, marks), lines._edits(0.8), 0.8)
    assert (a.tolist(), b.tolist(), len(wide)) == ([40], [250], 0)
    a, b, wide = pairs.meeting(records(300, 10, marks[:1]), lines._edits(0.8), 0.8)  # all alike
    assert len(wide) == 300 and len(a) <= pairs.LEADERS * 300


def test_marks_of_records_of_other_lengths_may_differ_less():
    r = records(2, [8, 10], np.array([[0b111, 0], [0, 0]], np.uint64))  # two insertions change two marks, not three
    assert len(pairs.meeting(r, lines._edits(0.8), 0.8)[0]) == 0
    r["marks"][0] = [0b11, 0]
    assert len(pairs.meeting(r, lines._edits(0.8), 0.8)[0]) == 1


def test_members_of_wide_groups_are_first_compared_with_a_few():
    r, key = records(60, 10, np.zeros((60, 2), np.uint64)), np.zeros(60, np.int64)
    root = np.arange(60) // 2
    met = set(zip(*map(np.ndarray.tolist, pairs.across(r, key, root, lines._edits(0.8), 0.8))))
    assert met == {(i, j) for i, j in itertools.combinations(range(60), 2) if i // 2 != j // 2}
    few = set(zip(*map(np.ndarray.tolist, pairs.across(r, key, root, lines._edits(0.8), 0.8, 1))))
    assert few < met and len(few) <= 2 * 60


def test_one_of_each_puts_no_texts_by(spark, monkeypatch):
    seen, stash = [], simhash.stash
    monkeypatch.setattr(simhash, "stash", lambda df, label: seen.append((label, df.columns)) or stash(df, label))
    got = simhash.one_of_each(odd(spark, ["a b c d e f", "a b c d e f", None, "x y z"], [3, 3, None, 4])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "4", "None"]
    assert seen and not [x for x in seen if {"row", "t", "text"} & {*x[1]}]


def test_what_stages_put_by_goes_once_it_is_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    left = lambda: {x.name.split("-")[0] for x in tmp_path.iterdir()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = corpus_pipeline.quality_rules(spark, docs, SF)
    n = judged.count()
    store.release(spark)
    again = judged.count()
    assert left() == {"measures"} and again == n > 0  # still read
    del judged
    for _ in range(20):  # py4j lets go of objects a few seconds late
        store.release(spark)
        if not left():
            break
        time.sleep(0.5)
    assert left() == set()
    removed = lines.duplicate_lines(docs)
    assert left() == {"removed"} and removed.count() > 0
