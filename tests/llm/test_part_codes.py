import hashlib
import math
import random

import numpy as np
import pytest

from cohortmill.llm.part_codes import Codebooks, decoded, encoded, fit_codebooks, part_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, key int, error double"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [math.floor(256 * float(np.float32(x))) for x in v], label) for k, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size:(p + 1) * size]
    books = [[list(cut(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    fits = lambda x: x if x < 2**63 else None
    return sorted([(k, "".join(f"{i:02x}" for _, i in f), fits(e), fits(total[label]), digest)
                   for (k, _, label), f, e in zip(kept, found, errors)], key=str)


def vectors(seed, count=150, width=32):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, draw.gauss(0, 1)]) for _ in range(width)], draw.choice([0, 1, 2, None])) for i in range(count)]
    rows += [(900, None, 1), (901, [float("nan")] * width, 1), (902, [None] * width, 0), (903, [float("inf")] + [0.0] * (width - 1), None)]
    rows += [rows[3], rows[3], (None, rows[7][1], 1), (5, rows[9][1], 0), (-4, rows[11][1], 0)]
    draw.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 0.5) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_brute_force(spark, seed):
    rows = vectors(seed)
    found = part_codes(frame(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_fewer_vectors_than_entries_and_large_components(spark):
    rows = [(1, [3.0e38] * 16, 1), (2, [-1.0] * 16, 1), (3, [1e30] * 16, None), (4, [0.5] * 16, None), (5, [0.5001] * 16, 2)]
    assert sorted(map(tuple, part_codes(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_nothing_to_encode(spark):
    assert part_codes(frame(spark, [])).collect() == []
    assert part_codes(frame(spark, [(1, None, 1), (2, [float("nan")] * 16, None)])).collect() == []


@pytest.mark.parametrize("rows", [[(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], [(1, [0.5] * 10, 1)]])
def test_lengths_must_agree(spark, rows):
    with pytest.raises(ValueError, match="length"):
        part_codes(frame(spark, rows))


def test_decoding_gives_the_entries(spark):
    rows = vectors(4)
    books = fit_codebooks(frame(spark, rows))
    back = decoded(encoded(frame(spark, rows), books), books)
    by_id = {r[0]: r[1] for r in rows}
    for r in back.where("key between 10 and 60").collect():
        error = sum((math.floor(256 * float(np.float32(x))) - 256 * y) ** 2 for x, y in zip(by_id[r.key], r.vector))
        assert error == r.error


def test_ties_go_to_the_lower_entry():
    books = Codebooks(np.array([[[0], [2], [2], [4]]]))
    codes, errors = books.nearest(np.array([[1], [2], [3], [9]]))
    assert codes.tolist() == [[0], [1], [1], [3]] and errors.tolist() == [[1], [0], [1], [25]]
