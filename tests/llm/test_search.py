import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.llm import decontaminate as dc
from cohortmill.llm.decontaminate import cut_words, find_contamination, hit_words, without_spans
from cohortmill.llm.fmindex import FMIndex, suffix_order
from cohortmill.llm.licenses import CONTAINMENT, LICENSE_TEXTS, run_hashes, scan_licenses, scan_words, template_classes
from cohortmill.llm.textbytes import WORD_BYTES, word_chunks
from cohortmill.llm.topk import top_inner_products

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_finds_every_place(seed):
    draw = np.random.default_rng(seed)
    runs = [draw.integers(1, 4, draw.integers(1, 40)) for _ in range(30)]
    runs += [runs[0], runs[1][:5], np.ones(60, int)]
    symbols = np.concatenate([np.append(r, 0) for r in runs]).astype(np.int64)
    order = suffix_order(symbols)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    index = FMIndex(symbols)
    for size in (1, 2, 5):
        patterns = np.unique(np.concatenate([draw.integers(1, 6, (20, size)), *[r[None, k:k + size] for r in runs for k in range(len(r) - size + 1)]]), axis=0)
        low, high = index.ranges(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(symbols) - size + 1) if (symbols[i:i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def leaks(docs, items, window=10):
    cut = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            cut.setdefault(tuple(own[k:k + size]), set()).update([] if item is None else [str(item)])
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(c) for c in cut}:
            for k in range(len(own) - size + 1):
                if (who := cut.get(tuple(own[k:k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= who
        out.append((key, len(own), len(hit), sorted(found)))
    return out


def leak_case():
    draw = random.Random(8)
    some = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(draw.choices(some, k=draw.choice([3, 10, 14, 25])))) for i in range(12)] + [(20, "..."), (21, None), (22, "é W1, w2"), (3, "w3 w4 w5")]
    docs = [(None, None), (0, ""), (1, "!!")]
    for i in range(2, 60):
        text = " ".join(draw.choices([*some, "zz", "Q"], k=draw.choice([2, 9, 30, 200])))
        if i % 3 == 0:
            text += ". " + (items[i % 12][1] or "").upper().replace(" ", ", ") + "; tail"
        docs.append((i, text))
    docs += [docs[6], docs[6], (70, " ".join(["w1 w2 w3"] * 900) + " " + items[5][1])]
    return docs, items


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_leaks_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(dc, "RUN_WORDS", 40)
    docs, items = leak_case()
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, items string")
    items = [*items, (None, "w1 w2 w3")]  # an item without an id gives hits, but no entry in items
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(frame, bench, max_pass_bytes=bound)
    assert found.columns == ["doc_id", "text", "n_words", "spans", "items"]
    got = [(r.doc_id, r.n_words, r.n, r["items"]) for r in found.withColumn("n", hit_words()).collect()]
    assert sorted(got, key=str) == sorted(leaks(docs, items), key=str)
    for r in found.collect():
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:], strict=False))
    clean = without_spans(found).select("doc_id", "text").collect()
    kept = {r.doc_id: len(words(r.text)) for r in clean}
    assert all(kept[k] == n - h for k, n, h, _ in leaks(docs, items))


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in find_contamination(docs, none).collect()] == [(2, [], [])]
    assert find_contamination(docs.where("false"), none).collect() == []


def test_cut_words():
    assert cut_words("One, two; three!", [{"begin": 1, "end": 2}]) == "One, ; three!"
    assert cut_words(None, [{"begin": 0, "end": 1}]) is None


def best(vectors, queries, k):
    clean = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in clean:
        if queries(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in clean if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("width", "n"), [(1, 40), (6, 300), (33, 2500)])
def test_top_k_against_brute_force(spark, width, n):
    draw = np.random.default_rng(width)
    vectors = [(i, [float(np.float32(x)) for x in draw.normal(size=width) * draw.choice([0.1, 1, 3])]) for i in range(n)]
    vectors += [(n + 1, None), (n + 2, [None] * width), (n + 3, [float("nan")] * width), (n + 4, [float("inf")] * width), (None, [1.0] * width),
                (n + 5, [0.0] * width), (n + 6, []), (n + 7, [2.0])] + [(n + 10 + i, vectors[5][1]) for i in range(30)]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.LongType())])
    frame = spark.createDataFrame([(*v, 0) for v in vectors], kind).repartition(5)
    got = top_inner_products(frame, F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(vectors, lambda q: q % 10 == 0, 10)


def test_top_k_of_huge_and_of_no_vectors(spark):
    frame = spark.createDataFrame([(0, [3e30, 1.0]), (1, [3e30, 2.0]), (2, [-3e30, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_inner_products(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    assert top_inner_products(frame.where("false"), F.lit(True)).collect() == []
    assert top_inner_products(frame.limit(1), F.lit(True)).collect() == []


def test_license_windows_against_all_windows():
    draw = random.Random(3)
    some = [f"w{i}" for i in range(30)]
    templates = [" ".join(draw.choices(some, k=n)) for n in (3, 5, 7, 8, 20, 24, 60)]
    texts = []
    for i in range(200):
        middle = templates[i % 7].split()
        for _ in range(draw.choice([0, 0, 1, 3])):
            middle[draw.randrange(len(middle))] = "changed"
        texts.append(" ".join(draw.choices([*some, "x"], k=draw.randint(0, 50)) + middle + draw.choices(some, k=draw.randint(0, 9))))
    texts += ["", "w1", None, templates[0]]
    for kind in template_classes(templates):
        for chunk in word_chunks(pa.array(texts, pa.string()), WORD_BYTES):
            hashes, at = run_hashes(chunk.hashes, chunk.first, kind.n)
            want = set()
            width = 5 * kind.step if max(map(len, kind.sets)) > 1 else 1
            for row in range(len(texts)):
                for begin in range(at[row], at[row + 1], kind.step):
                    own = set(hashes[begin:min(begin + width, at[row + 1])].tolist())
                    want |= {(row, i) for i, s in zip(kind.ids, kind.sets, strict=True) if len(own & set(s.tolist())) >= CONTAINMENT * len(s) - 1e-9}
            assert {m[:2] for m in scan_words(chunk.hashes, chunk.first, [kind])} == want


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "Text.\nReleased under the MIT license. More."), (2, None), (3, ""), (4, "ALL RIGHTS RESERVED all rights reserved"), (5, "right here")],
                                 "doc_id long, text string")
    got = {r.doc_id: [(m.license, m.first_word, m.words) for m in r.matches] for r in scan_licenses(docs).collect()}
    assert got == {1: [("MIT", 1, 5)], 2: [], 3: [], 4: [("reserved", 0, 3)], 5: []}
    assert scan_licenses(docs.where("false")).collect() == []


def test_versions_and_variants_of_licenses(spark):
    whole = {n: max((t for m, t in LICENSE_TEXTS if m == n), key=len) for n, _ in LICENSE_TEXTS}
    names = ["GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense", "MIT", "ISC", "0BSD",
             "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Zlib", "BSL-1.0"]
    made = [(n, f"some words before\n{whole[n]}\nand after it") for n in names]
    notice = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free "
              "Software Foundation{} either version {} of the License, or (at your option) any later version.")
    made += [("GPL-2.0", notice.format("program", ";", "General", ";", "2")), ("LGPL-2.1", notice.format("library", ";", "Lesser General", ";", "2.1")),
             ("AGPL-3.0", notice.format("program", ":", "Affero General", ",", "3")), ("GPL-3.0", notice.format("program", ":", "General", ",", "3")),
             ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
             ("GPL-2.0,GPL-3.0", " ".join(notice.format("program", ";", "General", ";", v) for v in "23"))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: sorted({m.license for m in r.matches} - {"reserved"}) for r in scan_licenses(docs).collect()}
    assert [(n, ",".join(got[i])) for i, (n, _) in enumerate(made)] == [(n, n) for n, _ in made]
    table = spark.createDataFrame([("own", "one two three four"), (None, "x")], "license string, text string")
    assert [[m.license for m in r.matches] for r in scan_licenses(docs.limit(1).withColumn("text", F.lit("x one two three four")), table).collect()] == [["own"]]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.mark.parametrize("size", range(7))
def test_texts_shorter_than_a_shingle(spark, size):
    """Alone in a chunk, and alone in the chunk behind a text of more than a chunk."""
    short = " ".join(f"s{i}" for i in range(size))
    docs = spark.createDataFrame([(1, short)], "doc_id long, text string")
    assert [list(r.matches) for r in scan_licenses(docs).collect()] == [[]]
    both = spark.createDataFrame([(1, "filler " * 170_000 + "Released under the MIT license."), (2, short)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [m.license for m in r.matches] for r in scan_licenses(both).collect()}
    assert got == {1: ["MIT"], 2: []}
