"""The pipeline's stages against plain versions of each, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import shingles
from tidebar.llm.secrets import ranked_words, redact


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, DATA).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    single = stages["n-gram Jaccard join"](spark, good, DATA).cache()
    rows = {r["doc_id"]: shingles(r["text"]) for r in good.collect()}
    stay = {r["doc_id"] for r in single.collect()}
    root = {i: i for i in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    own = sorted(rows)
    for x, i in enumerate(own):
        for j in own[x + 1 :]:
            if rows[i] and 100 * len(rows[i] & rows[j]) >= 75 * len(rows[i] | rows[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert stay == {find(i) for i in rows}
    bare = stages["secret scans"](spark, single, DATA).cache()
    rank = ranked_words(single)
    assert {(r["doc_id"], r["text"]) for r in bare.collect()} == {(r["doc_id"], redact(r["text"], rank=rank)) for r in single.collect()}
    mixed = stages["source mixing"](spark, bare, DATA).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= stay
    last = stages["BPE"](spark, mixed, DATA)
    assert Counter(r["doc_id"] for r in last.collect()) == Counter(r["doc_id"] for r in mixed.collect())
    assert len(corpus_pipeline.STAGES) == 5
