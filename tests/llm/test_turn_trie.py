import hashlib
import random
import re
import zlib

import pytest
import xxhash

from cohortmill.llm.forward_queue import SpillingQueue
from cohortmill.llm.turn_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, name1 string, words int"


def content_hash(role, text):
    """Spark's xxhash64 of both, as a signed number: the order of turns with one number."""
    found = 42
    for part in (role, text):
        found = xxhash.xxh64_intdigest(part.encode(), seed=found)
    return found - 2**64 if found >= 2**63 else found


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, content_hash(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(c - 20 * int(c / 20)), [])[:h] + mine[h:]
    members = {}
    for c, r in rebuilt.items():
        for d in range(len(r) + 1):
            members.setdefault(tuple(r[:d]), []).append(c)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    children, leaves, gain = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        gain[path] = gain.get(path, 0) + ((len(members[path]) - 1) * words(path[-1][1]) if path else 0)
        if path:
            up = path[:-1]
            children[up], leaves[up], gain[up] = children.get(up, 0) + 1, leaves.get(up, 0) + leaves[path], gain.get(up, 0) + gain[path]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p)).encode()).hexdigest()
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], gain[p], ends(p))
                   for p, m in members.items()], key=str)


def conversations(seed, count=120):
    draw = random.Random(seed)
    some = [(r, " ".join(draw.choices(["a", "b", "Ä", "cc"], k=draw.randint(0, 4)))) for r in ("user", "bot", None) for _ in range(2)]
    first, rows = ("system", "you are a help"), []
    for c in draw.sample(range(-10, 400), count):
        turns = [first] * draw.choice([0, 1, 1]) + draw.choices(some, k=draw.choice([0, 1, 2, 3, 6]))
        for t, (role, text) in enumerate(turns):
            rows.append((c, draw.choice([t, t, t, None, 1]), role, draw.choice([text, text, text, None])))
    rows += [(7_000, t, "user", f"turn {t % 3}") for t in range(14)] + [(7_021, t, "user", f"turn {t % 3}") for t in range(11)]
    rows += [(None, 1, "user", "nobody's"), (9_000, None, None, None), *[(8_000 + 20 * k, 0, "system", "the same") for k in range(40)], rows[0], rows[0]]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,fragment,budget", [(1, 1 << 16, 1 << 15), (2, 10, 4), (3, 4, 1)])
def test_trie_against_brute_force(spark, seed, fragment, budget):
    """Small fragments and budgets make subtrees of several generations and queues that spill."""
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    found = prefix_trie(frame, fragment=fragment, budget=budget)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_nothing_and_a_single_turn(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert prefix_trie(frame([])).collect() == []
    assert prefix_trie(frame([(None, 1, "a", "b")])).collect() == []
    for rows in ([(20, 1, "a", "b c")], [(3, 1, None, None)], [(21, None, "a", "x " * 500_000)]):
        assert sorted(map(tuple, prefix_trie(frame(rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("budget", [1, 3, 64])
def test_queue_gives_sums_in_order(budget):
    draw = random.Random(budget)
    sent = [(draw.randrange(6), draw.randrange(3), 0, draw.randrange(9), draw.randrange(9)) for _ in range(400)]
    queue = SpillingQueue(budget)
    for m in sent:
        queue.push(m)
        assert len(queue.heap) <= budget + 1
    assert queue.runs > 0
    for name in sorted({m[:3] for m in sent}):
        assert queue.take(name) == tuple(sum(m[k] for m in sent if m[:3] == name) for k in (3, 4))
    assert not queue
