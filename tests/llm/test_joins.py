import os
import random
import re

import numpy as np
import pytest

from cohortmill.llm import jaccard
from cohortmill.llm.components import components
from cohortmill.llm.jaccard import TokenOrder, prefix_length, similar_sets
from cohortmill.llm.shared_tokens import packed, shared_counts, unpacked
from cohortmill.session import ensure_checkpoint_dir


def shingle_set(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(own[k:k + 5]) for k in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)]) if own else frozenset()


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs):
    sets = {(i, k): shingle_set(t) for k, (i, t) in enumerate(docs) if i is not None}
    links = [(x[0], y[0]) for x, a in sets.items() for y, b in sets.items() if x < y and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    roots = joined(links, {i for i, _ in docs if i is not None})
    return sorted(((i, len(shingle_set(t)), roots.get(i)) for i, t in docs), key=str)


def near_copies(seed):
    draw = random.Random(seed)
    some = [f"w{i}" for i in range(400)]
    passage = draw.choices(some, k=30)
    docs = []
    for i in range(30):  # texts of different origin that share a passage
        docs.append(draw.choices(some, k=draw.randint(5, 80)) + passage)
    for group in range(6):
        words = draw.choices(some, k=draw.choice([6, 40, 120, 300]))
        for _ in range(draw.choice([3, 12, 40])):
            words = list(words) if draw.random() < 0.3 else list(docs[-1] if group and draw.random() < 0.4 else words)
            copy = list(words)
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                at = draw.randrange(len(copy) + 1)
                copy[at:at + draw.choice([0, 1])] = draw.choices(some, k=draw.choice([0, 1, 6]))
            docs.append(copy)
    texts = [(i, " ".join(d)) for i, d in enumerate(docs)]
    draw.shuffle(texts)
    return [*texts, (1_000, None), (1_001, ""), (1_002, " \n"), (1_003, "A b"), (1_004, "a B"), (1_005, "a b c"), (None, texts[0][1]), texts[3], texts[3]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_against_brute_force(spark, seed):
    docs = near_copies(seed)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string").repartition(3)
    found = similar_sets(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs)


def test_join_in_passes(spark, monkeypatch):
    """A corpus of near copies: every step goes in passes, and none leaves more on disk than a part of the texts."""
    draw = random.Random(8)
    docs = []
    for _ in range(12):
        base = draw.choices([f"word{i}" for i in range(900)], k=400)
        for _ in range(8):
            copy = list(base)
            for at in range(draw.randrange(60), 400, 60):
                copy[at] = f"new{draw.randrange(10**6)}"
            docs.append((len(docs), " ".join(copy)))
    for name, value in (("PREFIX_SHARE", 0.15), ("TEXT_SHARE", 0.6), ("BLOCK_SHARE", 0.4), ("LEAST_PASS", 1), ("PIVOT_MEMBERS", 3)):
        monkeypatch.setattr(jaccard, name, value)
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    counted, cut = [], jaccard.cut_lineage

    def measured(df):
        before = set(os.listdir(top))
        out = cut(df)
        counted.append(sum(os.path.getsize(f"{d}/{f}") for new in set(os.listdir(top)) - before for d, _, names in os.walk(f"{top}/{new}") for f in names))
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", measured)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, similar_sets(frame).collect()), key=str) == brute(docs)
    assert counted and max(counted) < 0.6 * sum(len(t) for _, t in docs)


def test_join_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert similar_sets(frame).collect() == []
    assert [tuple(r) for r in similar_sets(spark.createDataFrame([(4, "only this one text here")], frame.schema)).collect()] == [(4, 1, 4)]


def test_shared_tokens_are_counted(spark):
    docs = near_copies(4)[:80]
    frame = spark.createDataFrame(docs, "id long, text string")
    sets = [shingle_set(t) for _, t in docs]
    for r in shared_counts(frame).collect():
        own = shingle_set(dict(docs)[r.id])
        others = frozenset().union(*[s for s in sets if s != own])
        assert r.n == len(own)
        assert r.shared in (0, len(own & others), len(own)) if sets.count(own) > 1 else r.shared == len(own & others)


def test_blobs_come_back():
    draw = np.random.default_rng(3)
    tokens = np.sort(draw.integers(0, 2**42, 1_000, dtype=np.uint64))
    owners = draw.integers(0, 2**16, 1_000).astype(np.uint16)
    back = unpacked(packed(tokens, owners))
    assert (back[0] == tokens).all() and (back[1] == owners).all()


def test_prefixes_of_similar_sets_meet():
    draw = np.random.default_rng(5)
    order = TokenOrder(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1 << 24, bool))
    for n in (1, 2, 4, 5, 9, 10, 57, 200):
        a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        drop = len(a) - -(-80 * len(a) // 100)
        b = np.delete(a, draw.choice(len(a), drop, replace=False))
        assert prefix_length(len(a), 80) == len(a) - -(-80 * len(a) // 100) + 1
        for k in (1, 2, 3):
            assert set(a[order.prefix(a, k, 80)].tolist()) & set(b[order.prefix(b, k, 80)].tolist())


@pytest.mark.parametrize("shape", ["path", "random", "star"])
def test_components(spark, shape):
    draw = random.Random(6)
    links = {"path": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(100)],
             "random": [(draw.randrange(80), draw.randrange(80)) for _ in range(60)]}[shape]
    draw.shuffle(links)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, *links[:3]], "a long, b long")).collect()}
    assert got == joined([x for x in links if x[0] != x[1]], nodes)
