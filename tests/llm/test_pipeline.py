import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from cohortmill.llm.catalog import ORACLES, QUERIES  # noqa: E402
from cohortmill.llm.mixing import taken_words, word_count  # noqa: E402
from cohortmill.llm.layout_queries import MIX_WEIGHTS  # noqa: E402
from cohortmill.llm.stages import written  # noqa: E402

from .test_joins import shingle_set  # noqa: E402
from .test_search import leaks  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(spark, stage(spark, out[-1], FOLDER), name))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    assert all(s.columns == COLUMNS for s in steps[:-1]) and steps[-1].columns == [*COLUMNS, "shard", "slot"]


def test_quality_keeps_good_texts(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").join(steps[0], "doc_id").select("doc_id", "quality")
    kept = labels.join(steps[1], "doc_id", "left_semi").groupBy("quality").count().rdd.collectAsMap()
    total = labels.groupBy("quality").count().rdd.collectAsMap()
    assert kept.get(1, 0) >= 0.95 * total[1] and kept.get(0, 0) <= 0.2 * total[0]


def test_one_of_each_group_stays(steps):
    docs = {r.doc_id: shingle_set(r.text) for r in steps[1].collect()}
    kept = {r.doc_id for r in steps[2].collect()}
    links = {a: {b for b, t in docs.items() if b != a and s and t and 100 * len(s & t) >= 80 * len(s | t)} for a, s in docs.items()}
    for a in docs:
        group, waiting = {a}, [a]
        while waiting:
            new = links[waiting.pop()] - group
            group |= new
            waiting += new
        assert kept & group == {min(group)}


def test_leaks_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == {k for k, _, hit, _ in leaks(docs, items) if not hit}


def test_mix_takes_its_words(steps):
    want = {(r.doc_id, r.source): r.taken for r in taken_words(steps[3], MIX_WEIGHTS).collect() if r.taken}
    got = Counter()
    for r in steps[4].withColumn("n", word_count("text")).collect():
        got[r.doc_id, r.source] += r.n
        assert r.n_chars == len(r.text)
    assert got == want


def test_shards_are_whole(steps):
    assert Counter((r.doc_id, r.text) for r in steps[5].collect()) == Counter((r.doc_id, r.text) for r in steps[4].collect())
    for shard in {r.shard for r in steps[5].collect()}:
        slots = sorted(r.slot for r in steps[5].where(F.col("shard") == shard).collect())
        assert slots == list(range(len(slots)))


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} | set(QUERIES) <= names and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    names = ", ".join(sorted(found.columns))
    want = base.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect()), key=str) == sorted(want, key=str)


EXTRA = ["spans", "items", "size", "target", "pass", "weight", "node", "dim", "cut", "place", "_keys", "name", "score"]


def odd_documents(spark):
    """Nulls, repeated ids and rows, texts without words, a long one, and extra columns named like the operators' own."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "en", "web"), (1, b, "en", "web"), (2, a, "en", None), (3, b + " more", None, "web"), (4, None, "en", "web"), (4, None, "en", "web"),
            (5, "", "fr", "books"), (None, a, "en", "web"), (None, "c d e f g h i", "de", "web"), (None, "c d e f g h i", "de", "web"),
            (6, "solo words here", "en", "web"), (6, "solo words here", "en", "web"), (7, "long " * 40_000 + "end", "en", "web")]
    frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA]).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_other_columns_alone(spark, name):
    docs = odd_documents(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    assert [c for c in out.columns if c not in ("shard", "slot")] == docs.columns
    for r in out.collect():
        assert all(r[c] == f"own {c}" for c in EXTRA)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), FOLDER).collect() == []


def test_no_text_is_lost_to_a_shared_id(spark):
    kept = Counter((r.doc_id, (r.text or "")[:6]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd_documents(spark), FOLDER).collect())
    assert kept == Counter([(1, "a0 a1 "), (1, "b0 b1 "), (4, ""), (4, ""), (5, ""), (None, "c d e "), (6, "solo w"), (7, "long l")])


def test_a_benchmark_without_ids_still_counts(spark):
    from cohortmill.llm.decontaminate import find_contamination, without_hits
    words = " ".join(f"q{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "clean text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, words), (7, None)], "item_id long, text string")
    found = {r.doc_id: (sum(s.end - s.begin for s in r.spans), r["items"]) for r in find_contamination(docs, bench).collect()}
    assert found == {1: (14, []), 2: (0, []), 3: (0, [])}
    assert sorted(r.doc_id for r in without_hits(docs, bench).collect()) == [2, 3]
    assert sorted(r.doc_id for r in without_hits(docs, bench, max_pass_bytes=1).collect()) == [2, 3]
    assert without_hits(docs, bench.limit(0)).count() == 3
