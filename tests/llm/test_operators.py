"""Each training-data operator against a plain version on small tables with hard cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tests.conftest import DATA, same_rows
from tidebar.llm import quality, queries
from tidebar.llm.bpe import bpe_encode, loaded
from tidebar.llm.cap_filters import near_vectors
from tidebar.llm.components import components
from tidebar.llm.licenses import TEMPLATES, license_scan, model, scan_lines
from tidebar.llm.mixing import replicate
from tidebar.llm.ngram_join import ngram_components, one_of_each, overlaps
from tidebar.llm.quality import Settings, fit_quality, keep_good, quality_scores
from tidebar.llm.secrets import ACCESS, ASSIGN, find_secrets, guess_cost, parts, ranked_words, secret_spans, without_secrets
from tidebar.llm.span_dedup import remove_repeated_spans, sentences
from tidebar.llm.spotsigs import edited_fingerprints, fingerprints, near_pairs
from tidebar.llm.suffix_dedup import remove_repeats, two_stage_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, component string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, short, empty, null and long texts, repeated rows, null ids and columns."""
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 60)
    texts = [base, base, base.upper(), None, "", " \n\t ", "one", "one two three four", "One  two\nthree four", "ÀÉ ß é x ☃", words(rng, 3000)]
    for k in range(12):
        own = base.split()
        for _ in range(k):
            own[rng.randrange(len(own))] = words(rng, 1)
        texts.append(" ".join(own))
    texts += [f"{words(rng, 30)}. {passage} {words(rng, 40)}" for _ in range(6)]
    texts += [words(rng, rng.randint(1, 80)) for _ in range(20)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i % 4, "x") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "en", "s0", 1, 1, "y"), (None, "nothing like it at all here now", "en", "s0", 1, 1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (5, 4)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8, 7: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}


def test_overlaps_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, top, n)).astype(np.uint64) for n, top in [(1, 5), (0, 9), (5, 9), (400, 500), (3000, 4000), (3000, 10**6), (60, 64), (60, 64)] * 9]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets[:40]] for x in sets])
    assert (overlaps(sets, sets[:40]) == want).all()
    assert overlaps([], sets).shape == (0, len(sets)) and overlaps(sets[1:2], sets[1:2]).tolist() == [[0]]


def grouped(rows):
    """The least id that each id's texts reach by links, from (id, text)."""
    root = {i: i for i, _ in rows if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    own = [(i, shingles(t)) for i, t in rows if i is not None]
    for x, (i, s) in enumerate(own):
        for j, t in own[x + 1 :]:
            if s and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_ngram_join_in_pieces(spark, monkeypatch):
    """A large group of near copies, chains through it and shared passages, with pieces so small that all kinds of pieces meet; an id with one copied and one near-copied version."""
    import tidebar.llm.ngram_join as module

    monkeypatch.setattr(module, "PIECE", 2000)
    rng = random.Random(12)
    base, passage = words(rng, 110).split(), words(rng, 70)
    texts = []
    for k in range(160):
        own = list(base)
        for _ in range(k % 8):
            own[rng.randrange(len(own))] = words(rng, 1)
        texts.append(" ".join(own))
    texts += [f"{words(rng, rng.randint(1, 30))} {passage} {words(rng, rng.randint(1, 30))}" for _ in range(60)]
    rows = list(enumerate(texts))
    other = words(rng, 90)
    rows += [(500, other), (501, other), (501, texts[3] + " x"), (502, words(rng, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = grouped(rows)
    got = ngram_components(df).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, want[i]) for i, _ in rows)
    assert want[501] == want[500] == want[3] and len(set(want.values())) > 20


def test_ngram_meetings_in_rounds(spark, monkeypatch):
    """A group of many pieces meets in rounds, none of which ships more than some COPIES rows a document, and no meeting is left out."""
    import tidebar.llm.ngram_join as module
    from tidebar.llm.common import cut

    monkeypatch.setattr(module, "PIECE", 1024)
    monkeypatch.setattr(module, "TASK_BYTES", 1 << 14)
    members = cut(spark.range(100).selectExpr("1L AS group", "id AS doc", "id AS component", "50 AS n"))
    rounds, _ = module.dealt(members, F.col("n"), 1)
    parts = [r.select("i", "j", "doc").collect() for r in rounds]
    assert len(parts) > 2 and max(map(len, parts)) <= 2 * module.COPIES * 100
    here = {}
    for r in [r for part in parts for r in part]:
        here.setdefault((r["i"], r["j"]), set()).add(r["doc"])
    assert len({(a, b) for x in here.values() for a in x for b in x if a < b}) == 100 * 99 // 2


def test_ngram_rounds_ship_bounded_bytes(spark, monkeypatch):
    """Few copies of long sets can be more than the disk allows: a round's bytes are bounded too, and no meeting is left out."""
    import tidebar.llm.ngram_join as module
    from tidebar.llm.common import cut

    monkeypatch.setattr(module, "PIECE", 50_000)
    monkeypatch.setattr(module, "TASK_BYTES", 1 << 14)
    members = cut(spark.range(100).selectExpr("1L AS group", "id AS doc", "id AS component", "2000 AS n"))
    most = 8 * 2000 * 100
    rounds, _ = module.dealt(members, F.col("n"), 8, most)
    parts = [r.select("i", "j", "doc").collect() for r in rounds]
    assert len(parts) > 2 and max(map(len, parts)) * 8 * 2000 <= 2 * most
    here = {}
    for r in [r for part in parts for r in part]:
        here.setdefault((r["i"], r["j"]), set()).add(r["doc"])
    assert len({(a, b) for x in here.values() for a in x for b in x if a < b}) == 100 * 99 // 2
    assert len(module.dealt(members, F.col("n"), 8)[0]) == 1


def test_ngram_prefixes_leave_little_but_links():
    """By the second and third order together, pairs of which half is shared go out before whole sets travel, and no linked pair does, whatever the sizes."""
    import tidebar.llm.ngram_join as module

    def side(sets, component, percent):
        sets = [np.sort(x) for x in sets]
        k = [module.prefix_length(len(x), percent) for x in sets]
        cut32 = lambda x: (x >> np.uint64(32)).astype(np.uint64)
        return {
            "doc": np.arange(len(sets)) + component * 1000, "component": np.arange(len(sets)) + component * 1000, "n": np.array([len(x) for x in sets]),
            "up": [cut32(x[:p]) for x, p in zip(sets, k)], "down": [cut32(x[len(x) - p :]) for x, p in zip(sets, k)],
        }

    rng = np.random.default_rng(3)
    linked = 0
    for percent in (75, 40, 100):
        for n in (*range(1, 14), 50, 301):
            for m in {n, max(1, n - 1), n + 1, n * percent // 100, n * 4 // 5, n * 9 // 10} - {0}:
                for both in {min(n, m), max(0, min(n, m) - 1), min(n, m) * 9 // 10, -(-percent * (n + m) // (100 + percent))}:
                    if both > min(n, m):
                        continue
                    pool = rng.integers(0, 2**64, n + m - both, np.uint64)
                    x, y = pool[:n], pool[n - both :]
                    if 100 * both >= percent * (n + m - both):
                        linked += 1
                        assert module.agreeing(side([x], 0, percent), side([y], 1, percent), percent).tolist() == [0, 1000]
    assert linked > 200
    pool = rng.integers(0, 2**64, 1500, np.uint64)
    half = [side([pool[:1000]], 0, 75), side([pool[500:]], 1, 75)]
    assert not len(module.agreeing(*half, 75))


def test_ngram_buckets_are_parted_by_size(spark, monkeypatch):
    """Documents that share tokens but are too different in size to link make no group; chains of links over all sizes stay whole."""
    import tidebar.llm.ngram_join as module

    rng = random.Random(5)
    met, plain = [], module.meetings
    monkeypatch.setattr(module, "HEAVY_ALL", 1)
    monkeypatch.setattr(module, "meetings", lambda members, *rest: met.append(members.count()) or plain(members, *rest))
    long = words(rng, 1200).split()
    apart = [(k, " ".join(long[:n])) for k, n in enumerate((100, 150, 220, 330, 500, 800, 1200))]
    got = ngram_components(spark.createDataFrame(apart, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k for k, _ in apart} and met[0] == 0
    other = words(rng, 1000).split()
    chain = [(20 + k, " ".join(other[: round(100 * 1.2**k)])) for k in range(12)]
    rows = rng.sample([*apart, *chain], len(apart) + len(chain))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == grouped(rows) == {k: k for k, _ in apart} | {k: 20 for k, _ in chain}


def test_ngram_join(docs, empty):
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    find = grouped([(r['doc_id'], r['text']) for r in docs.collect()]).__getitem__
    got = ngram_components(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == Counter((i, len(s), find(i)) for i, s in rows if i is not None)
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {0, None}
    clashing = docs.withColumnRenamed("lang", "key").withColumnRenamed("source", "first")
    kept = one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({find(i) for i, _ in rows if i is not None})
    assert one_of_each(empty).count() == 0


def test_mixing(docs, empty, spark):
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("copy"))
    out = replicate(big, {"a": 3.0, "b": 1.0})
    share = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(share["a"] - 3000) < 250 and abs(share["b"] - 1000) < 150
    assert [tuple(r) for r in out.orderBy("doc_id", "copy").collect()] == [tuple(r) for r in replicate(big.repartition(7), {"a": 3.0, "b": 1.0}).orderBy("doc_id", "copy").collect()]
    many = replicate(big.where("doc_id < 4"), {"a": 1.0, "b": 1.0}, total=6000).count()
    assert abs(many - 6000) < 400
    assert set(r["doc_id"] for r in replicate(docs).collect()) <= {r["doc_id"] for r in docs.collect()}
    assert replicate(empty).count() == 0 and replicate(docs, {}).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe(docs, empty, vocabulary):
    from tokenizers import Tokenizer

    odd = ["Ab'S don't I'LL <|endoftext|> x<|startoftext|>y <|endof", "ΑΣ ΟΔΟΣ Σ", "İ Ş ǅ", "é  x\x1c\x1fy\x85z", "日本語 한국어 12３４", "😀!!!??...\U0001f469‍\U0001f4bb", "ß ẞ ﬁ K Å", "a" * 3000, "̀ͅ²Ⅷ", "x\x00y", "﻿​ z"]
    theirs, ours = Tokenizer.from_file(vocabulary), loaded(open(vocabulary, encoding="utf-8").read())
    for text in odd:
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == (len(want), " ".join(map(str, want)))
        assert ours.decode(ours.encode(text)[1]) == theirs.decode(want, skip_special_tokens=False)
    got = bpe_encode(docs, vocabulary).collect()
    plain = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for i, t in plain:
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert any(r["doc_id"] == i and r["ids"] == want and r["decoded"] == theirs.decode(want, skip_special_tokens=False) for r in got)
    assert bpe_encode(empty, vocabulary).count() == 0


def test_quality(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    settings = Settings()
    model = fit_quality(d, labels, settings)
    scored = quality_scores(d, model, settings)
    out = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert scored.count() == d.count() and out["score"].between(0, 1).all()
    assert (out["predicted"] == out["quality"]).mean() >= 0.93
    assert out[out["quality"] == 1]["predicted"].mean() >= 0.97
    assert quality_scores(docs, model, settings).count() == docs.count()
    assert keep_good(docs, model, settings).columns == docs.columns
    assert fit_quality(d, labels, Settings(entries=40_000)).value[0].shape == model.value[0].shape
    none = fit_quality(docs, labels.limit(0), settings)
    assert {round(r["score"], 1) for r in quality_scores(docs, none, settings).collect()} <= {0.4, 0.5, 0.6}
    assert quality_scores(empty, model, settings).count() == 0 and keep_good(empty, model, settings).count() == 0


def test_quality_learns_in_a_task(spark, monkeypatch):
    """The driver gets one number a bucket, not the rows that are learned from, and they are the ones that these rows in the order of their ids give."""
    d, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    settings, learn, collect = Settings(rows=40), quality.train, type(d).toArrow
    known = {r["doc_id"]: r["quality"] for r in labels.where(~quality.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()}
    rows = collect(d.where(F.col("doc_id").isin(list(known))).orderBy("doc_id").coalesce(1).selectExpr("doc_id as key", "text", "0 as label").mapInArrow(quality._training_rows(settings), "key long, label int, buckets array<int>, shares array<float>"))

    def in_task(*given):
        assert TaskContext.get(), "the driver holds the rows"
        return learn(*given)

    monkeypatch.setattr(quality, "train", in_task)
    monkeypatch.setattr(type(d), "toArrow", in_task)
    odds, base = fit_quality(d, labels, settings).value
    want = learn(np.array([known[k] for k in rows["key"].to_pylist()]), *([np.array(x) for x in rows[c].to_pylist()] for c in ("buckets", "shares")), settings)
    assert len(rows) == 40 and np.allclose(odds, want[0], atol=1e-5) and abs(base - want[1]) < 1e-6


def plain_spans(text, length, span=3, least=12):
    pieces = [p for p in sentences((text or "").encode()) if p.strip()]
    keys = [tuple(tuple(p.lower().split()) for p in pieces[k : k + span]) for k in range(len(pieces) - span + 1)]
    return pieces, [(k, key) for k, key in enumerate(keys) if sum(map(len, key)) >= least]


def test_sentence_spans(spark, empty):
    rng = random.Random(5)
    shared = ". ".join(words(rng, 7) for _ in range(5)) + "."
    texts = [f"{words(rng, 9)}. {shared} {words(rng, 4)}! {words(rng, 6)}", f"{words(rng, 5)}\n{shared}\n{words(rng, 8)}?", shared, shared.upper(), None, "", "a. b. c. a. b. c. a. b. c.", "\n\n", words(rng, 900)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, place int")
    first, gone = {}, {i: set() for i in range(len(texts))}
    for i, t in enumerate(texts):
        for k, key in plain_spans(t, 0)[1]:
            if first.setdefault(key, (i, k)) != (i, k):
                gone[i] |= {k, k + 1, k + 2}
    got = {r["doc_id"]: r for r in remove_repeated_spans(df).collect()}
    for i, t in enumerate(texts):
        assert set(got[i]["removed"]) == gone[i] and got[i]["n_sentences"] == len(plain_spans(t, 0)[0])
        if not gone[i]:
            assert got[i]["kept"] == (t or "")
    assert gone[1] and gone[2] and gone[3] and not gone[6]
    assert remove_repeated_spans(empty).count() == 0


def test_repeated_passages_of_few_sentences(spark):
    """Passages of 51 to 80 words in 1, 2 and 3 sentences, cut off anywhere in their texts or a whole text; copies inside long unpunctuated texts; a line of its own stays."""
    rng = random.Random(6)
    texts, copies = [], []
    for n in [*range(51, 81, 4), 80]:
        for parts in (1, 2, 3):
            own = words(rng, n).split()
            for k in range(1, parts):
                own[n * k // parts] += rng.choice([".", "!", "?", ".\n"])
            passage = " ".join(own)
            for before, after in ((3, 5), (rng.randint(20, 90), rng.randint(20, 90))):
                texts.append(f"{words(rng, before)} {passage} {words(rng, after)}")
            copies += [len(texts) - 1, len(texts)]
            texts.append(passage)
    long = words(rng, 1500)
    texts += [long, f"{words(rng, 40)} {long} {words(rng, 30)}", f"{words(rng, 40)} {long[3000:7000]}"]
    copies += [len(texts) - 2, len(texts) - 1]
    line = words(rng, 14) + "."
    texts += [f"{words(rng, 60)}\n{line}\n{words(rng, 50)}" for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeated_spans(df).collect()}
    assert [i for i in range(len(texts)) if got[i]["n_removed"]] == copies
    lost = {i: len(texts[i].split()) - len(got[i]["kept"].split()) for i in copies}
    assert all(19 <= x for x in lost.values()) and lost[copies[-2]] >= 1500 - 32
    for i in copies[1:-2:2]:
        assert lost[i] >= len(texts[i].split()) - 32


def test_fingerprints(docs, empty):
    got = fingerprints(docs).collect()
    text = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert len(got) == docs.count() and len({r["fingerprint"] for r in got if r["doc_id"] in (0, 1, None)}) == 2
    rows = edited_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    ordered = sorted(((i, t or "") for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()] if i is not None))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        want[i, sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in rows if r["doc_id"] is not None) == want
    sparse = edited_fingerprints(docs.where("doc_id is not null").withColumn("doc_id", F.expr("doc_id * 100000000000001L - 2000000000000000L"))).collect()
    assert Counter(r["edited_sha256"] for r in sparse) == Counter(r["edited_sha256"] for r in rows if r["doc_id"] is not None)
    assert all(0 <= r["near_edited"] <= 1 for r in rows) and all(r["near_next"] is None for r in rows if r["doc_id"] is None)
    sets = {r["doc_id"]: set(r["fingerprint"].split()) for r in got if r["doc_id"] is not None}
    pairs = {(r["a"], r["b"]): r["likeness"] for r in near_pairs(docs).collect()}
    for (a, b), x in pairs.items():
        assert x == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) and x >= 0.75
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    named = sorted(least.items(), key=lambda x: x[1])
    assert set(pairs) == {(a, b) for x, (s, a) in enumerate(named) for t, b in named[x + 1 :] if len(s & t) >= 0.75 * len(s | t)}
    assert text and edited_fingerprints(empty).count() == 0 and near_pairs(empty).count() == 0


def test_secrets(spark, docs, empty):
    text = 'é password = "hunter2hunter2x" api-key: short token:abc AKIAABCDEFGHIJKLMN 0123456789abcdef0 AKIASHORT pwd: xK9#mQ2$vL7p login: summer2019'
    base = sorted([(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12] + [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18] + [(text.index("0123"), text.index("0123") + 17, "hex")])
    found = find_secrets(text)
    assert [x for x in found if x[2] != "guess"] == base and [text[a:b] for a, b, k in found if k == "guess"] == ["xK9#mQ2$vL7p"]
    for weak in ("password123", "aaaaaaaaaaaa", "2024-05-06", "qwertyuiop12", "letmein2019!", "abcabcabcabc", "P@ssw0rd1"):
        assert guess_cost(weak)[0] < 10 < guess_cost("xK9#mQ2$vL7p")[0]
    for value in ("xab12", "aaab", "qwe1999password"):
        cost, parts = guess_cost(value)
        assert "".join(value[a:b] for a, b, _ in parts) == value and cost > 0
    inside = "mypasswd=" + "0123456789abcdef/" * 4 + "auth=xK9mQ2vL7pzzQ"
    assert [k for _, _, k in find_secrets(inside)] == ["assign", "hex", "hex", "hex", "hex"]
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (None, "", 0), (1, text, 0)], "doc_id long, text string, spans int")
    got = secret_spans(df).collect()
    assert sorted((r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1)]
    digest = sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
    assert {r["base_sha256"] for r in got} == {digest, sha256(b"").hexdigest()}
    clean = without_secrets(df)
    assert clean.columns == df.columns and all("hunter2" not in (r["text"] or "") and "AKIAABC" not in (r["text"] or "") for r in clean.collect())
    assert clean.where("text is null").count() == 1 and secret_spans(empty).count() == 0 and secret_spans(docs).count() == docs.count()


def test_guess_cost_is_the_least_of_all_segmentations(spark):
    """Against every way to cut a value in brute-force characters and parts, and with words ranked by a corpus."""
    rank = {"sun": 1, "sunday": 2, "day": 300, "shine": 5, "password": 9}

    def least(value):
        own = list(parts(value, rank))
        alphabet = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
        ways = {(i, j): c + 0.3 for i, j, _, c in sorted(own, key=lambda x: -x[3])}
        ways |= {(i, i + 1): min(ways.get((i, i + 1), 99), math.log10(max(10, alphabet))) for i in range(len(value))}
        every = [0.0] if not value else []

        def walk(at, cost):
            if at == len(value):
                every.append(cost)
            for (i, j), c in ways.items():
                if i == at:
                    walk(j, cost + c)

        walk(0, 0.0)
        return min(every)

    for value in ("", "q", "sunday", "Sunday19", "sunshine", "p@ssword", "aaa1", "qwe12", "abcabc", "5unday", "xK9#mQ"):
        assert guess_cost(value, rank)[0] == pytest.approx(least(value))
    df = spark.createDataFrame([("Zebra zebra zebra apple, Apple fig no x",), (None,), ("",)], "text string")
    found = ranked_words(df, most=2)
    assert found["password"] == 1 and found["zebra"] + 1 == found["apple"] == len(found) and "fig" not in found


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa" * 80, b"banana" * 60, b"mississippi", bytes(range(1, 256)) * 3, bytes(random.Random(2).choices(b"ab", k=3000))])
def test_two_stage_order(text):
    order, _ = two_stage_order(np.frombuffer(text, np.uint8), 200)
    keys = [text[i : i + 200] for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)


def plain_repeats(texts, length=200):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("crowd", [1000, 2])
def test_suffix_dedup(spark, docs, empty, monkeypatch, crowd):
    """With a low crowd limit, common passages take the way of counted windows."""
    import tidebar.llm.suffix_dedup as module

    monkeypatch.setattr(module, "CROWD", crowd)
    rng = random.Random(9)
    passage = words(rng, 80)
    # Repeats of 200 to 240 bytes that start and end anywhere, beside whole passages.
    cuts = [(a, a + rng.randint(200, 240)) for a in (rng.randint(0, 150) for _ in range(40))]
    more = [(1000 + k, f"{words(rng, k)} {passage[k:]} {words(rng, 20)}", None, None, 0, 0, "") for k in range(8)] + [(1100 + k, f"{words(rng, 30)}{passage[a:b]}{words(rng, 30)}", None, None, 0, 0, "") for k, (a, b) in enumerate(cuts)] + [(2000, "ab" * 400, None, None, 0, 0, ""), (2001, passage[:199], None, None, 0, 0, ""), (2000, words(rng, 70), None, None, 0, 0, "")]
    both = docs.unionByName(spark.createDataFrame(more, DOCS))
    rows = both.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, plain_repeats([(r["text"] or "").encode() for r in rows])))
    assert Counter(map(tuple, remove_repeats(both, digest=True).collect())) == want
    if crowd == 1000:
        assert remove_repeats(empty).count() == 0


def test_cap_filters(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    base[50:120] = base[50] + rng.normal(size=(70, 32)) * 0.12
    base[130:135] = base[130]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(900, None, 0), (901, [], 0), (902, [0.0] * 32, 0), (903, [float("nan")] * 32, 0), (904, [None, *[1.0] * 31], 0), (905, [1.0, 2.0, 3.0], 0), (130, base[130].tolist(), 0), (906, [float("inf")] * 32, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    like = unit @ unit.T >= 0.95
    extra = np.array([int(like[i, 130]) for i in range(300)])
    want = like.sum(1) - 1 + extra
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    found = {r["vec_id"]: r for r in got}
    exact = np.mean([found[i]["n_links"] == want[i] for i in range(300)])
    assert exact >= 0.99 and sum(found[i]["n_links"] for i in range(300)) >= 0.99 * want.sum()
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in range(900, 907))
    assert {found[i]["component_id"] for i in range(130, 135)} == {130}
    assert near_vectors(df.limit(0)).count() == 0
    first = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = np.array(first.orderBy("vec_id").toPandas()["embedding"].tolist(), np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert near_vectors(first).agg(F.sum("n_links")).first()[0] >= 0.99 * ((v @ v.T >= 0.95).sum() - len(v))


def test_licenses(spark, empty):
    rows = [(1, "a/LICENSE", TEMPLATES[0][1]), (2, "a/b/x.py", "# code\nprint(1)"), (3, "a/b/c/LICENSE.md", "text\nLicensed under the Apache License, Version 2.0."), (4, "a/b/c/d/y.py", None), (5, "z.py", ""), (6, None, "Licensed under CC BY-NC 4.0."), (7, "a/b/q.py", "x\n" + TEMPLATES[5][1] + "\n" + "w " * 5000), (2, "a/b/x.py", "# code\nprint(1)")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"license": F.lit("clash"), "score": F.lit(0)})
    got = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert got[2]["inherited"] == "MIT" and got[2]["directory"] == "a" and got[4]["inherited"] == "Apache-2.0" and got[4]["directory"] == "a/b/c"
    assert got[6]["license"] == "CC-BY-NC-4.0" and got[7]["license"] == "GPL-3.0" and got[5]["license"] is None and got[5]["inherited"] is None
    assert license_scan(df).count() == len(rows) and license_scan(empty.withColumn("path", F.lit("a/b"))).count() == 0


def test_license_lines_count_all_their_words(spark):
    """Common words count in the vectors, and repeated ones by their squares."""
    rows = [(k, t) for k, (_, t) in enumerate(TEMPLATES)]
    rows += [(100, TEMPLATES[0][1] + " and to the of with this"), (101, "released released under mit license"), (102, TEMPLATES[0][1] + " x y x x"), (103, "GNU Affero General Public License, version 3 version 3"), (104, TEMPLATES[2][1].replace(" to ", " ").replace(" of ", " "))]
    idf, other, units, _ = model()
    assert {"the", "and", "of"} <= set(idf)
    want = {}
    for i, text in rows:
        bag = Counter(re.findall("[a-z0-9]+", text.lower()))
        size = sum((n * idf.get(w, other)) ** 2 for w, n in bag.items()) ** 0.5
        best = max((round(sum(bag[w] * idf[w] * x for k, w, x in units if k == t) / size, 6), -t) for t in range(len(TEMPLATES)))
        if best[0] >= 0.75:
            want[i] = (TEMPLATES[-best[1]][0], pytest.approx(best[0], abs=2e-6))
    got = {r["doc"]: (r["license"], r["score"]) for r in scan_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 100 not in got and 102 not in got
