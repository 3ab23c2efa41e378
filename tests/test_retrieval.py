"""Full text and vector search against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import fulltext, vector_index


def plain_density(places: dict[str, list[int]]) -> float:
    """Over all stretches, keeping those that have every term and hold no shorter one that does."""
    spots = sorted(p for own in places.values() for p in own)
    has = lambda a, b: all(any(a <= p <= b for p in own) for own in places.values())
    covers = [(a, b) for a in spots for b in spots if a <= b and has(a, b)]
    least = [(a, b) for a, b in covers if not any((c, d) != (a, b) and a <= c and d <= b for c, d in covers)]
    return sum(0.1 / (1 + (b - a + 1) - sum(a <= p <= b for p in spots)) for a, b in least)


@pytest.mark.parametrize("stored", [False, True])
def test_text_search(spark, tmp_path, stored):
    rng = random.Random(4)
    words = ["of", "the", "Über", "x1", "ran", "cat", "ñandú"]
    rows = [(i, " ".join(rng.choices([*words, "-", "...", "of", "the"], k=rng.randint(0, 30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "the cat ran"), (62, "cat the"), (62, "ran of"), (63, "the " * 25 + "cat")]
    asked = [(1, "the cat"), (2, "THE, the"), (3, "über ran of"), (4, "nowhere the"), (5, ""), (6, None), (None, "the"), (7, "cat"), (7, "x1")]
    postings = fulltext.index(spark.createDataFrame(rows, "document_id int, content string"))
    if stored:
        fulltext.write_index(postings, f"file://{tmp_path}/index")
        postings = fulltext.read_index(spark, f"file://{tmp_path}/index")
    got = {(r["query_id"], r["document_id"]): r["lexical_score"] for r in fulltext.search(postings, spark.createDataFrame(asked, "query_id int, words string")).collect()}
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    texts, wants = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        texts.setdefault(i, []).extend(split(t))
    for i, t in asked:
        if i is not None:
            wants.setdefault(i, set()).update(split(t))
    want = {}
    for q, own in wants.items():
        for d, text in texts.items():
            if own and own <= set(text):
                want[q, d] = plain_density({w: [i for i, x in enumerate(text, 1) if x == w] for w in own})
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    if stored:
        assert "PartitionFilters" in fulltext.search(postings, spark.createDataFrame(asked, "query_id int, words string"))._jdf.queryExecution().toString()


def test_no_documents_no_queries(spark):
    docs = spark.createDataFrame([(1, "a b")], "document_id int, content string")
    asked = spark.createDataFrame([(1, "a")], "query_id int, words string")
    assert fulltext.search(fulltext.index(docs.limit(0)), asked).count() == 0
    assert fulltext.search(fulltext.index(docs), asked.limit(0)).count() == 0
    assert [tuple(r) for r in fulltext.search(fulltext.index(docs), asked).collect()] == [(1, 1, 0.1)]


def test_search_of_texts_takes_no_row_a_pair_through_spark(spark, monkeypatch):
    """Queries of common words have most documents: they are met in tasks, slice by slice, with the rows that a search of an index gives."""
    monkeypatch.setattr(fulltext, "PAIRS", 50)
    monkeypatch.setattr(fulltext, "PLACES", 300)
    rng = random.Random(5)
    words = ["of", "the", "Über", "x1", "ran", "cat"]
    rows = [(i, " ".join(rng.choices([*words, "-", "other", "of", "the"], k=rng.randint(0, 60)))) for i in range(200)] + [(3, "the cat"), (200, None), (201, ""), (None, "the cat of"), (202, "the " * 500 + "cat")]
    asked = [(f"q{i}", " ".join(rng.choices([*words, "nowhere"], k=1 + i % 5))) for i in range(60)] + [("e", ""), ("n", None), (None, "the"), ("q1", "ran")]
    docs, queries = spark.createDataFrame(rows, "document_id int, content string"), spark.createDataFrame(asked, "query_id string, words string")
    key = lambda df: {(r["query_id"], r["document_id"]): round(r["lexical_score"], 9) for r in df.collect()}
    found = fulltext.search_texts(docs, queries)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan
    want = key(fulltext.search(fulltext.index(docs), queries))
    assert key(found) == want and len(want) > 1000 and found.count() == len(want)
    assert fulltext.search_texts(docs.limit(0), queries).count() == 0 and fulltext.search_texts(docs, queries.limit(0)).count() == 0


def cosines(queries, vectors, k):
    """The k best of each query as (id, cosine), by brute force."""
    out = {}
    for q, v in queries.items():
        near = sorted(((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in vectors.items() if len(w) == len(v)))
        out[q] = [(i, -c) for c, i in near[:k]]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_index(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    vectors = vector_index.usable(rows, "vec_id", "embedding")
    model = vector_index.fit(vectors)
    index = vector_index.build(vectors, model)
    assert index.count() == rows.count()
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "v")
    found = vector_index.search(index, vectors, asked, model).collect()
    held = {r["vec_id"]: np.array(r["v"]) for r in vectors.collect()}
    want = cosines({i: v for i, v in held.items() if i % 10 == 0}, held, 20)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(got[q] & {i for i, _ in own}) / 20 for q, own in want.items()])
    print(sf, recall)
    assert recall >= 0.9 and all(len(x) == 20 for x in got.values())


def test_index_of_hard_rows(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=6)
    rows = [(i, (hot + rng.normal(size=6) * 0.05).tolist()) for i in range(120)] + [(200 + i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [-1.0, 1.0]), rows[0], (1, hot.tolist())]
    vectors = vector_index.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    held = {r["vec_id"]: np.array(r["v"]) for r in vectors.collect()}
    assert set(held) == set(range(120)) | set(range(200, 260)) | {306, 307, 308}
    # Lists are cut into pieces of 7, and of all lists and candidates nothing is left out: the result is exact.
    s = vector_index.Settings(cells=5, probes=5, parts=3, codes=8, keep=40, piece=7)
    model = vector_index.fit(vectors, s)
    asked = vectors.select(F.col("vec_id").alias("query_id"), "v")
    got = {}
    for r in vector_index.search(vector_index.build(vectors, model), vectors, asked, model, 5, s).orderBy("query_id", F.desc("similarity"), "vec_id").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["similarity"])))
    assert got == cosines(held, held, 5)
    none = vectors.limit(0)
    model = vector_index.fit(none)
    assert vector_index.search(vector_index.build(none, model), none, none.select(F.col("vec_id").alias("query_id"), "v"), model).count() == 0


def test_exact_top_in_pieces(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist() if i % 9 else None, float(rng.integers(3)) / 10, [w for w in "abc" if rng.random() < 0.5]) for i in range(60)] + [(60, [0.0, 0.0, 0.0], 0.3, None), (61, [1.0, 2.0], 0.0, ["a"]), (62, [1.0, float("nan"), 1.0], 0.1, [])]
    asked = [(100 + i, rng.normal(size=3).tolist(), ["a", "b"][: i % 3]) for i in range(9)] + [(200, None, ["c"]), (201, [0.0] * 3, None), (202, [3.0, 4.0], ["a", "z"])]

    def score(q, r):
        ok = all(v is not None and np.isfinite(v).all() and np.any(v) for v in (q[1], r[1])) and len(q[1]) == len(r[1])
        cos = float(np.dot(q[1], r[1]) / (np.linalg.norm(q[1]) * np.linalg.norm(r[1]))) if ok else 0.0
        share = len(set(q[2]) & set(r[3] or [])) / len(q[2]) if q[2] else 0.0
        return 0.6 * cos + 0.15 * share + r[2]

    want = {q[0]: sorted(((round(-score(q, r), 9), r[0]) for r in rows))[:4] for q in asked}
    left, right = spark.createDataFrame(rows, "row_id long, v array<double>, rest double, words array<string>"), spark.createDataFrame(asked, "query_id long, v array<double>, words array<string>")
    for piece, block in ((7, 2), (1000, 1000)):
        out = vector_index.exact_top(left, right, 4, 0.6, 0.15, piece, block)
        assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.collect():
            got.setdefault(r["query_id"], []).append((round(-r["score"], 9), r["row_id"]))
        assert {q: sorted(x) for q, x in got.items()} == want


def test_no_list_of_a_new_index_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "the cat ran"), (2, "a cat")], "document_id int, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = fulltext.search(fulltext.index(docs), spark.createDataFrame([(1, "cat ran")], "query_id int, words string"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and not any("places" in line or "hashpartitioning(shard" in line for line in dealt)
