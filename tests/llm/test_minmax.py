import numpy as np
import pytest

from cohortmill.llm import minmax
from cohortmill.llm.minmax import band_count, near_copies, signatures

from .test_joins import joined, near_copies as planted, shingle_set


def brute(docs, percent=85):
    sets = {k: shingle_set(t) for k, (i, t) in enumerate(docs) if i is not None}
    links = [(x, y) for x, a in sets.items() for y, b in sets.items() if x < y and a and b and 100 * len(a & b) >= percent * len(a | b)]
    roots = joined(links, sets)
    least = {}
    for k in sets:
        least[roots[k]] = min(least.get(roots[k], docs[k][0]), docs[k][0])
    found = [(i, len(shingle_set(t)), least[roots[k]] if k in sets else None) for k, (i, t) in enumerate(docs)]
    return sorted([(i, n, c, i is not None and i == c) for i, n, c in found], key=str)


@pytest.mark.parametrize("seed,block", [(1, 1 << 18), (2, 500), (3, 60)])
def test_near_copies_against_brute_force(spark, monkeypatch, seed, block):
    """Small blocks make the comparison of what is left go through many pairs of blocks."""
    monkeypatch.setattr(minmax, "BLOCK_TOKENS", block)
    docs = planted(seed)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, n string, node int").repartition(3)
    found = near_copies(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs)


def test_chains_whose_ends_are_far_apart(spark):
    """Every text differs from the next in one word, so that a pivot sees only a part of the chain."""
    words = [f"a{i}" for i in range(60)]
    docs = []
    for step in range(40):
        docs.append((100 + step, " ".join(words)))
        words[step] = f"b{step}"
    assert sorted(map(tuple, near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str) == brute(docs)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, ""), (4, None), (5, "one two"), (None, a)]
    found = sorted(map(tuple, near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert found == brute(docs)
    assert [r for r in found if r[0] == 2] == [(2, 26, 1, False)]


def test_nothing_and_no_words(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = near_copies(spark.createDataFrame([(2, None), (1, " \n"), (3, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_a_very_long_text(spark):
    words = [f"w{i % 7919}x{i % 31}" for i in range(300_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:290_000])), (3, "w1 w2"), (4, " ".join(words[150_000:]))]
    found = sorted(map(tuple, near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert found == brute(docs)


def test_both_ends_estimate_the_similarity_with_less_spread():
    draw = np.random.default_rng(8)
    a = np.unique(draw.integers(0, 2**63, 60, dtype=np.uint64))
    b = np.append(a[:-6], np.unique(draw.integers(0, 2**63, 6, dtype=np.uint64)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    shares = []
    least, greatest = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 4_000)
    same = np.vstack([least[0] == least[1], greatest[0] == greatest[1]])
    shares = same.mean(axis=0)
    assert abs(shares.mean() - true) < 0.02
    assert shares.var() < true * (1 - true) / 2 * 1.02  # two values of one permutation against two of different ones


def test_bands_bound_the_chance_of_a_miss():
    for percent in (80, 85, 95):
        bands = band_count(percent)
        assert bands % 2 == 0 and (1 - (percent / 100) ** minmax.BAND_ROWS) ** bands <= minmax.MISS
