"""Spelling variants: one-edit neighbourhoods over a reduced alphabet, joined with the reduced vocabulary, verified on the words themselves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import BASE, chunks, cut, discard, pieces, powers, renamed, small_batches

#: Symbols that letters are hashed to: with fewer, a word has fewer neighbours and more words that only look near.
SYMBOLS = 6
#: Words up to this length travel with their neighbours; longer ones are sent as ids and fetched for the pairs found.
INLINE = 64
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Words and bytes of words that a task counts before it hands them on, and neighbours it makes at a time.
COUNTED, COUNTED_BYTES, MADE = 1 << 18, 1 << 24, 1 << 19

RUN = re.compile(rb"[A-Za-z\xC0-\xFF]{7,}")
EDGE = re.compile(rb"[^A-Za-z\xC0-\xFF]")


def _counted(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        size = 0

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch, texts in chunks(batches):
            for key, text in zip(batch.column(0).to_pylist(), texts):
                # Letters are Latin-1: one byte each, and what isn't Latin-1 becomes a byte that is no letter.
                raw = text.decode("utf-8", "replace").encode("latin-1", "replace").lower()
                begun = crc32(f"{key}:".encode())
                for piece in pieces(raw, EDGE):
                    for word, n in Counter(RUN.findall(raw, *piece)).items():
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            seen[word] += n
                            size += len(word)
                    if len(seen) > COUNTED or size > COUNTED_BYTES and sum(map(len, seen)) > COUNTED_BYTES // 2:
                        yield out()
                        size = 0
        yield out()

    return run


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): words of at least `least` (7 or more) letters of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, that occur twice or more in all texts.

    Typing errors are planted: where h, the CRC-32 of `id:word`, is a multiple of `every`, letter h % length is left out. Null texts have no words, null ids count as empty; whole
    texts of any length are read in pieces that end between words; repeated rows count again and other columns don't matter.
    """
    if least < 7:
        raise ValueError("words of fewer than 7 letters aren't counted")
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


def reduced(codes: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Code points hashed to 0 .. symbols - 1."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)).astype(np.int64) % symbols


def neighbours(words: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length, as rows of code points: (hashes of the reduced words, hashes of their neighbours row by row, which of these count).

    The neighbourhood of a reduced word is itself, every replaced symbol, every symbol left out and every one put in. Two reduced words a symbol apart are each in the other's,
    so each pair is made from one end: symbols are replaced by higher ones, and the longer word leaves one out, which is the other end of putting it in. Hashes
    are sums of symbols times powers, so an edited word's takes one step.
    """
    m, n = words.shape
    signs = reduced(words, symbols)
    up, _ = powers(n + 1)
    down = np.uint64(pow(BASE, -1, 1 << 64))
    upto = np.zeros((m, n + 1), np.uint64)
    np.cumsum((signs + 1).astype(np.uint64) * up[:n], axis=1, out=upto[:, 1:])
    own = upto[:, -1:]
    made, counts = [own], [np.ones((m, 1), bool)]
    for step in range(1, symbols):
        made.append(own + np.uint64(step) * up[:n])
        counts.append(signs + step < symbols)
    made.append(upto[:, :-1] + (own - upto[:, 1:]) * down)
    fresh = np.ones((m, n), bool)
    fresh[:, 1:] = signs[:, 1:] != signs[:, :-1]
    counts.append(fresh)
    return own[:, 0], np.hstack(made), np.hstack(counts)


def _by_length(column: pa.Array, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length in column, and these words as rows of code points; a block makes about MADE neighbours."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values], np.int64)
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        many = max(1, MADE // int(n * room))
        for at in range(0, len(places), many):
            own = places[at : at + many]
            yield own, np.frombuffer("".join(values[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)


def _hashed(symbols: int, whole: bool):
    """(key, word columns...) for each word, or for each neighbour of it with `own` saying that it is the word's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rest = batch.schema.names[1:], batch.select(batch.schema.names[1:])
            for places, words in _by_length(batch.column(0), symbols):
                own, made, counts = neighbours(words, symbols)
                if whole:
                    which, keys = np.nonzero(counts)[0], made[counts]
                    order = np.lexsort((keys, which))
                    which, keys = which[order], keys[order]
                    # The same hash twice for one word would find its partners twice.
                    once = np.ones(len(keys), bool)
                    once[1:] = (which[1:] != which[:-1]) | (keys[1:] != keys[:-1])
                    which, keys = which[once], keys[once]
                    extra, extra_names = [pa.array(keys == own[which])], ["own"]
                else:
                    which, keys, extra, extra_names = np.arange(len(places)), own, [], []
                part = rest.take(pa.array(places[which]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *part.columns, *extra], names=["key", *names, *extra_names])

    return run


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts differ by exactly one code point put in, left out or replaced."""
    return (F.abs(F.char_length(a) - F.char_length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def near_words(words: DataFrame, symbols: int = SYMBOLS, inline: int = INLINE) -> DataFrame:
    """words (word, n), each word once -> (word, near, near_n): all ordered pairs of words that differ by one code point.

    Reduced words are joined with the neighbourhoods of reduced words by 64-bit hashes; every pair found is verified on its words, so hashes decide nothing. The
    neighbourhood of a word grows with its length, so a word of more than `inline` code points goes through the join as an id. Null and empty words have no near ones.
    """
    small_batches(words.sparkSession)
    words = words.where("word <> ''")
    short = words.where(F.char_length("word") <= inline).select(F.col("word").alias("text"), "word", "n")
    near = short.mapInArrow(_hashed(symbols, False), "key long, word string, n long").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = short.mapInArrow(_hashed(symbols, True), "key long, word string, n long, own boolean").join(near, "key").where((~F.col("own") | (F.col("word") < F.col("near"))) & one_edit(F.col("word"), F.col("near")))

    # From `inline` code points on, so that a pair with the next length isn't lost; pairs of two words of that very length are found above.
    long = words.where(F.char_length("word") >= inline).select(F.col("word").alias("text"), F.sha2("word", 256).alias("id"))
    ids = long.mapInArrow(_hashed(symbols, True), "key long, id string, own boolean").join(long.mapInArrow(_hashed(symbols, False), "key long, id string").withColumnRenamed("id", "near_id"), "key")
    ids = ids.where(~F.col("own") | (F.col("id") < F.col("near_id"))).select("id", "near_id")
    texts = words.where(F.char_length("word") >= inline).select(F.sha2("word", 256).alias("id"), "word", "n")
    pairs = ids.join(texts, "id").join(texts.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_id")
    pairs = pairs.where((F.greatest(F.char_length("word"), F.char_length("near")) > inline) & one_edit(F.col("word"), F.col("near")))
    both = found.select("word", "n", "near", "near_n").union(pairs.select("word", "n", "near", "near_n"))
    ends = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return both.select(ends.alias("end")).select("end.*")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), each word once and without cycles -> (word, root): form of form and so on to the last, in as many rounds as the logarithm of the longest way."""
    way = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("far"))
        seen = Observation()
        fresh = cut(way.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), seen, F.count_if("moved").alias("moved"))
        discard(way)
        way = renamed(fresh, word="word", root="root")
        if not seen.get["moved"]:
            return way


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """words (word, n), each word once -> (word, form, root, n, n_near, form_n), a row a word.

    A word's form is the near word that occurs most (ties: the first by code points), if it occurs at least `ratio` times as often (ratio over 1), and its root is where its form's form
    and so on end: itself if it has none. n_near counts its near words.
    """
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = cut(rows.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the noisy_words() of docs; their cases hold, and an empty table has no words."""
    return variants(cut(noisy_words(docs, id_col, text_col)), ratio)
