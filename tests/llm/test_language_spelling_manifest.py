"""Language identification, spelling variants and the Merkle manifest against plain versions, with hard cases."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, same_rows
from tidebar.llm import langid, queries, spelling
from tidebar.llm.langid import Settings, fit_languages, predict_languages
from tidebar.llm.merkle import manifest, proof_digest
from tidebar.llm.spelling import near_words, neighbours, noisy_words, roots, spelling_variants, variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, score double, leaf string, root string, tree long, digest string, key string"


def table_of(spark, rows):
    """doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 0.5, "l", "r", 7, "d", "k") for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_language_id", "op12_spelling", "op13_merkle_manifest"])
def test_oracle(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


# Language identification


def letters(text):
    """Runs of letters, lower-cased, of at most 64."""
    out, run = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L" and len(run) < 64:
            run += c
        else:
            if run:
                out.append(run)
            run = c if unicodedata.category(c)[0] == "L" else ""
    return out


def plain_languages(rows):
    """By the definition, with dictionaries; bounds that don't bind."""
    seen = defaultdict(Counter)
    for key, text, lang in rows:
        if crc32(("" if key is None else str(key)).encode()) % 3 != 1 and lang is not None:
            for w in letters(text or ""):
                seen[lang, 0][w] += 1
                for k in range(1, 5):
                    whole = f" {w} " if k > 1 else w
                    seen[lang, k].update(whole[i : i + k] for i in range(len(whole) - k + 1))
    langs = sorted({x for x, _ in seen}, key=lambda x: (-sum(seen[x, 0].values()), x))
    unseen = [round(-math.log10(0.5 / max(sum(seen[x, k].values()) for x in langs)) * 1e6) if langs and any(seen[x, k] for x in langs) else 0 for k in range(5)]

    def cost(k, gram):
        if any(gram in seen[x, k] for x in langs):
            return [round(-math.log10(seen[x, k][gram] / sum(seen[x, k].values())) * 1e6) if gram in seen[x, k] else unseen[k] for x in langs]

    def of(word):
        if known := cost(0, word):
            return known
        for k in range(4, 0, -1):
            whole = f" {word} " if k > 1 else word
            if known := [c for i in range(len(whole) - k + 1) if (c := cost(k, whole[i : i + k]))]:
                return [sum(c[i] for c in known) // len(known) for i in range(len(langs))]
        return [unseen[0]] * len(langs)

    out = []
    for key, text, _ in rows:
        held = crc32(("" if key is None else str(key)).encode()) % 3 == 1
        found = letters(text or "")
        if not found or not langs:
            out.append((key, held, "und", 0.0))
            continue
        total = [sum(x) for x in zip(*map(of, found))]
        best = min(range(len(langs)), key=lambda i: (total[i], i))
        out.append((key, held, langs[best], round(1 / sum(10 ** ((total[best] - t) / (len(found) * 1e6)) for t in total), 9)))
    return out


def language_rows(seed=3):
    rng = random.Random(seed)
    kinds = {"en": "the of tion ing and er th".split(), "fr": "le de eaux é ou ai tre".split(), "": "zz yy xx qq".split()}
    rows = []
    for i in range(60):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 60))), None if i % 11 == 0 else lang))
    rows += [(60, None, "en"), (61, "", "en"), (62, "12 ½ Ⅷ ² _ ٣ ☃", "en"), (63, "漢字 the", None), (64, "漢字", None), (None, "the tion", "en"), (None, None, None), (65, "a" * 1000 + " of", "fr"), (66, "THE Éaux ſ ß İ", "fr"), rows[0]]
    return rows


def test_languages(spark):
    rows = language_rows()
    docs = table_of(spark, [(k, t, lang, None, None) for k, t, lang in rows])
    got = predict_languages(docs, fit_languages(docs))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = plain_languages(rows)
    order = lambda x: [(str(r[0]), r[1], r[2], round(r[3], 8)) for r in sorted(x, key=str)]
    assert order(map(tuple, got.collect())) == order(want)
    assert {r[2] for r in want} == {"en", "fr", "", "und"}


def test_languages_learn_from_nothing_and_forget(spark, monkeypatch):
    docs = table_of(spark, [(1, "one two", None, None, None), (2, None, "en", None, None)])
    assert {r["lang_pred"] for r in predict_languages(docs, fit_languages(docs)).collect()} == {"und"}
    assert predict_languages(docs.limit(0), fit_languages(docs.limit(0))).count() == 0
    # The memory of unseen words, the pieces of texts and the counted words may be of any size.
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3000)), "en" if i % 2 else "fr") for i in range(4)]
    docs = table_of(spark, [(k, t, lang, None, None) for k, t, lang in rows])
    model = fit_languages(docs).value
    small = langid.Costs(model, 1024)
    for _, text, _ in rows:
        for word in text.split():
            if small.full(1):
                small.forget()
            assert (small.table[small[word]] == langid.Costs(model, 4).table[[small[word]]] if word in model.rows[0] else small.table[small[word]] == small.backoff(word)).all()
    pieces = [w for part in langid.words_of(rows[0][1], 64) for w in part]
    monkeypatch.setattr("tidebar.llm.common.PIECE", 7)
    assert [w for part in langid.words_of(rows[0][1], 64) for w in part] == pieces == letters(rows[0][1])


def test_languages_of_a_bounded_model(spark):
    """The commonest of each order stay, ties all or none, and all predictions are still made."""
    rows = language_rows(9)
    docs = table_of(spark, [(k, t, lang, None, None) for k, t, lang in rows])
    whole, part = fit_languages(docs).value, fit_languages(docs, Settings(entries=150)).value
    assert sum(map(len, part.rows)) <= 150 < sum(map(len, whole.rows))
    assert all(set(a) <= set(b) for a, b in zip(part.rows, whole.rows))
    got = predict_languages(docs, spark.sparkContext.broadcast(part), Settings(entries=150)).collect()
    known = {k: lang for k, _, lang in rows[:60] if lang is not None}
    assert sum(known.get(r["doc_id"], r["lang_pred"]) == r["lang_pred"] for r in got) >= 0.9 * len(got)
    assert fit_languages(docs, Settings(languages=2)).value.languages == whole.languages[:2]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    found = predict_languages(docs, fit_languages(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) >= 40").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert found[1] > 200 and found[0] >= 0.97


# Spelling variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts, ratio=10):
    near = {w: sorted((v for v in counts if one_apart(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: v[0] if v and counts[v[0]] >= ratio * counts[w] else None for w, v in near.items()}
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def plain_words(rows):
    seen = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def spelled(seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeéß÷", k=rng.randint(6, 9))) for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdeé") + w[at:], w[:at] + rng.choice("abcdeé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "☃", "ŋ", "_1"]).join(words)))
    long = "".join(rng.choices("abcdefgh", k=3000))
    edge = "".join(rng.choices("abcdefgh", k=65))
    rows += [(200, f"{long} {long} {long[1:]} {long[1:]} " + f"{long[:9]}z{long[10:]} " * 30), (201, f"{edge} {edge} " + f"{edge[1:]} " * 25 + f"{edge[:-1]}q {edge[:-1]}q {edge[2:]} {edge[2:]} x{edge[2:]} x{edge[2:]}")]
    return [*rows, rows[0], (None, None), (300, ""), (301, "  "), (302, "ÀÉÎÕÜÝÞß ÀÉÎÕÜÝÞß àéîõüýþß àéîõüýþß"), (None, "abcdefgh ABCDEFGH"), (400, "mnopqrst " * 2 + "mnopqrsu " * 20 + "mnopqrvu " * 200)]


def test_spelling(spark, monkeypatch):
    rows = spelled()
    docs = table_of(spark, [(k, t, None, None, None) for k, t in rows])
    counts = plain_words(rows)
    assert {(r["word"], r["n"]) for r in noisy_words(docs).collect()} == set(counts.items())
    want = plain_variants(counts)
    assert {tuple(r) for r in spelling_variants(docs).collect()} == want
    assert any(w != root and form not in (None, root) for w, form, root, *_ in want) and any(len(w) > 64 and form for w, form, *_ in want)
    for at, least in (("COUNTED", 3), ("MADE", 50)):
        monkeypatch.setattr(spelling, at, least)
    monkeypatch.setattr("tidebar.llm.common.PIECE", 11)
    assert {(r["word"], r["n"]) for r in noisy_words(docs).collect()} == set(counts.items())
    assert spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        noisy_words(docs, least=3)


@pytest.mark.parametrize("symbols,inline", [(2, 64), (6, 64), (6, 8), (40, 7)])
def test_near_words(spark, symbols, inline):
    """The same pairs whatever letters are reduced to and however words travel; words of any letters and ties."""
    rng = random.Random(symbols)
    words = {"".join(rng.choices("ab☃𝄞", k=rng.randint(1, 9))) for _ in range(250)}
    table = spark.createDataFrame([(w, i % 5 + 1) for i, w in enumerate(sorted(words))] + [(None, 3), ("", 4)], "word string, n long")
    got = [(r["word"], r["near"]) for r in near_words(table, symbols, inline).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_neighbours_are_the_whole_neighbourhood():
    """Pairs of reduced words one symbol apart, and equal ones, are made from one end at least; nothing is made twice."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcdefgh", k=n)) for n in (4, 5, 6) for _ in range(60)})
    hashes, made = {}, {}
    for w in words:
        own, keys, counts = neighbours(np.array([[ord(c) for c in w]], np.uint32))
        hashes[w], made[w] = own[0], keys[counts].tolist()
        assert len(set(made[w])) == len(made[w])
    signs = {w: tuple(spelling.reduced(np.array([ord(c) for c in w], np.uint32))) for w in words}
    for a in words:
        for b in words:
            assert (signs[a] == signs[b] or one_apart(signs[a], signs[b])) == (hashes[a] in made[b] or hashes[b] in made[a])


def test_roots(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w20"), ("y", "z")], "word string, form string")
    assert {tuple(r) for r in roots(forms).collect()} == {(f"w{i}", "w40") for i in range(40)} | {("x", "w40"), ("y", "z")}
    assert roots(forms.limit(0)).count() == 0


def test_variants_ties(spark):
    table = spark.createDataFrame([("abcdefg", 1), ("abcdefh", 10), ("abcdefé", 10), ("abcdefga", 10), ("zzzzzzz", 5)], "word string, n long")
    got = {r["word"]: r for r in variants(table).collect()}
    assert (got["abcdefg"]["form"], got["abcdefg"]["n_near"], got["abcdefg"]["form_n"]) == ("abcdefga", 3, 10)
    assert tuple(got["zzzzzzz"]) == ("zzzzzzz", None, "zzzzzzz", 5, 0, None)


# Merkle manifest


def hexed(x):
    return sha256(x.encode()).hexdigest()


def plain_tree(leaves, arity):
    """The root, and for each leaf the siblings of each level as (slot, others)."""
    proofs, places, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, at in enumerate(places):
            run = level[at - at % arity : at - at % arity + arity]
            proofs[i].append((at % arity, run[: at % arity] + run[at % arity + 1 :]))
        level = [hexed("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        places = [at // arity for at in places]
    return level[0], proofs


def plain_manifest(rows, arity=3):
    leaf = lambda r, text: hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))
    groups = defaultdict(list)
    for r in rows:
        even = r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r[0], leaf(r, r[1].replace("\n", "") if even and r[1] else r[1])))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: plain_tree([x[2] for x in sorted(groups[name])], arity) for name in names}
    root, tops = plain_tree([trees[x][0] for x in names], arity) if names else (None, [])
    out = []
    for top, name in zip(tops, names):
        for x, proof in zip(sorted(groups[name]), trees[name][1]):
            at = x[4]
            for slot, others in proof + top:
                at = hexed("".join([*others[:slot], at, *others[slot:]]))
            out.append((x[3], x[2], trees[name][0], root, hexed("".join(h for _, others in proof + top for h in others)), at, at == root))
    return sorted(out, key=str)


def proved(docs, arity=3):
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    found = F.when(odd | F.col("doc_id").isNull(), F.col("text")).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = manifest(docs, {"text": found}, arity=arity).withColumn("proof_sha256", proof_digest(F.col("proof")))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest(spark, arity):
    rng = random.Random(arity)
    sizes = {"hot": 91, "one": 1, "two": 2, "": 5, None: 10, "é": 4, "z": 27, "a": 3}
    rows = [(rng.randrange(10**6), rng.choice(["x\ny", "plain", "", None, "é\n\n☃", "\n"]), rng.choice([None, "en"]), source, rng.choice([None, 7])) for source, n in sizes.items() for _ in range(n)]
    rows += [rows[0]] * 40 + [(None, "a\nb", None, "hot", None), (None, None, None, None, None), (rows[3][0], "another text of the same id\n", None, rows[3][3], 1)]
    got = proved(table_of(spark, rows), arity)
    assert got == plain_manifest(rows, arity)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_finds_what_changed(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}", 6) for i in range(50)]
    docs = table_of(spark, rows)
    assert {r["verified"] for r in manifest(docs).collect()} == {True}
    changed = manifest(docs, {"lang": F.when(F.col("doc_id") == 17, F.lit(None).cast("string")).otherwise(F.col("lang"))})
    assert [r["doc_id"] for r in changed.where("not verified").collect()] == [17]
    assert manifest(docs.limit(0)).count() == 0
    assert [(r["leaf"] == r["root"], r["verified"], len(r["proof"])) for r in manifest(docs.limit(1)).collect()] == [(True, True, 0)]
