import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortmill.llm.mixing import mixed_documents, permuted, source_targets, taken_words
from cohortmill.llm.sharding import kd_shards, with_slots

SCHEMA = "doc_id long, text string, source string, size string"


def documents(n=300):
    draw = random.Random(1)
    made = []
    for i in range(n):
        source = draw.choice(["a", "a", "a", "b", "c", None])
        made.append((i, " ".join(f"w{i}_{k}" for k in range(draw.choice([0, 1, 3, 40, 200]))), source, "x"))
    return made + [made[3], made[3], (None, None, "d", "x"), (7, "other text", "b", "x"), (8, "  \t\n ", "e", "x")]


def targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, out = {}, {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        out = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] > 3 * sizes[s]]
        if not over:
            return out | fixed
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [7, 64])
def test_mix_meets_the_targets(spark, block):
    made = documents()
    found = taken_words(spark.createDataFrame(made, SCHEMA), [5.0, 2.0, 1.0], block=block, shard_slots=4)
    assert "place" not in found.columns
    got = found.collect()
    assert sorted(Counter((r.doc_id, r.text, r.source) for r in got).items(), key=str) == sorted(Counter(m[:3] for m in made).items(), key=str)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    for s, t in targets(dict(sizes), [5, 2, 1]).items():
        assert abs(taken[s] - t) <= 1
        assert all(abs(r.target - t) < 1e-6 and r.source_size == sizes[s] for r in got if r.source == s)
    again = taken_words(spark.createDataFrame(made[::-1], SCHEMA).repartition(3), [5.0, 2.0, 1.0], block=block, shard_slots=4)
    assert Counter((r.doc_id, r.text, r.taken) for r in again.collect()) == Counter((r.doc_id, r.text, r.taken) for r in got)


def test_mixed_texts_hold_the_taken_words(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    counts = defaultdict(int)
    for r in taken_words(docs, [5.0, 2.0, 1.0], block=7).collect():
        counts[r.doc_id] += r.taken
    mixed, originals = defaultdict(int), {m[0]: (m[1] or "").split() for m in documents()[::-1]}
    for r in mixed_documents(docs, [5.0, 2.0, 1.0], block=7).collect():
        words = r.text.split()
        mixed[r.doc_id] += len(words)
        if r.doc_id != 7:
            place = {w: k for k, w in enumerate(originals[r.doc_id])}
            assert [place[w] for w in words] == sorted({place[w] for w in words})
    assert mixed == {k: v for k, v in counts.items() if v}


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert taken_words(empty, [1.0]).collect() == [] and mixed_documents(empty, [1.0]).collect() == []
    blank = taken_words(spark.createDataFrame([(1, None, None, "x"), (2, " ", None, "x")], SCHEMA), [1.0]).collect()
    assert [(r["size"], r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2


def test_targets_that_stop_in_several_rounds(spark):
    sizes = {"a": 10, "b": 1, "c": 5, "d": 1000, "e": 30, None: 2}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(frame, [5.0, 2.0, 1.0]).collect()}
    for s, t in targets(sizes, [5, 2, 1]).items():
        assert abs(got[s] - t) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1000])
def test_permutation(spark, n):
    found = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5))).collect()]
    assert sorted(found) == list(range(n)) and (n < 100 or found != list(range(n)))


def test_shards_near_equal(spark):
    draw = random.Random(2)
    made = [(i, draw.choice(["en", "en", "de", None]), draw.choice([1.0, float("nan"), None, draw.random()]), draw.randint(1, 50), 9) for i in range(4000)]
    made += [(5, "en", 1.0, 10, 9)] * 2000
    docs = spark.createDataFrame(made, "doc_id long, lang string, v double, size long, shard int")
    for shards in (1, 5, 8):
        out = kd_shards(docs, ["v", "lang"], F.col("size"), shards=shards, row=F.xxhash64("doc_id", "size", F.monotonically_increasing_id()))
        assert out.columns == ["doc_id", "lang", "v", "size", "shard"]
        sums = {r.shard: r.s for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
        assert set(sums) == set(range(shards))
        assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values())
    by_bytes = kd_shards(docs, ["v"], F.col("size"), target_bytes=sum(m[3] for m in made) // 3).select("shard").distinct().count()
    assert by_bytes == 3


def test_slots_have_no_gaps(spark):
    docs = spark.createDataFrame([(i % 700, i % 3) for i in range(2000)], "doc_id long, shard int")
    for s in range(3):
        assert sorted(r.slot for r in with_slots(docs, docs, ["doc_id"]).where(F.col("shard") == s).collect()) == list(range(len(range(s, 2000, 3))))


def test_shards_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, size long")
    out = kd_shards(docs, ["lang", "size"], F.col("size"), shards=8)
    assert with_slots(out, out, ["doc_id"]).collect() == []
    one = kd_shards(spark.createDataFrame([(1, None, None)], docs.schema), ["lang", "size"], F.col("size"), shards=8).collect()
    assert len(one) == 1 and 0 <= one[0].shard < 8


CLASHING = ["node", "_keys", "dim", "cut", "_weight", "weight", "pass", "_key", "place", "size", "target", "_row", "_bucket", "block", "slot", "_source"]


def test_columns_named_like_the_operators_own_come_along(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7), "ab"[i % 2], i) for i in range(40)], "doc_id long, text string, source string, n long")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    shards = kd_shards(docs, ["n", "source"], F.col("n"), shards=4, row=F.xxhash64("doc_id"))
    assert shards.columns == [*docs.columns, "shard"]
    slots = with_slots(shards, shards, ["doc_id"])
    assert slots.columns == [*[c for c in docs.columns if c != "slot"], "shard", "slot"]
    mixed, taken = mixed_documents(docs, [2.0, 1.0]), taken_words(docs, [2.0, 1.0])
    assert mixed.columns == docs.columns
    assert taken.columns == [*[c for c in docs.columns if c not in ("size", "target")], "size", "source_size", "target", "taken"]
    for out, replaced in ((shards, ()), (slots, ("slot",)), (mixed, ()), (taken, ("size", "target"))):
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING if c not in replaced)
