"""Language identification: words scored by their frequency in each language, unseen ones by progressively shorter character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, discard, pieces, small_batches

#: Costs are -log10 of relative frequencies in millionths, as integers, so that sums don't depend on their order.
UNIT = 1_000_000
#: Words that a task counts before it hands them on, and unseen words whose costs it remembers.
COUNTED, REMEMBERED = 1 << 18, 1 << 17
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """longest: letters of a word, a longer run being cut into several; orders: letters of the longest n-grams. The model that is sent to the executors has at most
    `languages` languages (those with most words), `entries` words and n-grams in all, and `cells` costs; all documents are counted for it."""

    longest: int = 64
    orders: int = 4
    languages: int = 256
    entries: int = 1 << 19
    cells: int = 1 << 25


@dataclass(frozen=True)
class Model:
    """languages, those with more words first; for order 0 (words) and each order of n-grams a table of row numbers and the costs of something unseen; costs, a row each with a column a language."""

    languages: list[str]
    rows: list[dict[str, int]]
    unseen: list[int]
    costs: np.ndarray


@cache
def _word(longest: int) -> re.Pattern:
    return re.compile(f"[^\\W\\d_]{{1,{longest}}}")


EDGE = re.compile(r"[\W\d_]")


@cache
def _numbers() -> frozenset[str]:
    """What a regular expression's \\w has besides letters, decimal digits and the underscore: fractions, numerals and the like."""
    return frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not unicodedata.category(c).startswith("L"))


def words_of(text: str, longest: int) -> Iterator[list[str]]:
    """The lower-cased words of a text, runs of what Unicode calls letters, in lists of bounded size."""
    text = text.lower()
    if not text.isascii() and not _numbers().isdisjoint(text):
        text = text.translate(dict.fromkeys(map(ord, _numbers()), " "))
    for piece in pieces(text, EDGE):
        yield _word(longest).findall(text, *piece)


def grams(word: str, order: int) -> list[str]:
    """A word's n-grams, a space at both ends counted from order 2 on."""
    whole = f" {word} " if order > 1 else word
    return [whole[i : i + order] for i in range(len(whole) - order + 1)]


def learnable(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1


def _counted(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = {}

        def out():
            for lang, found in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch, texts in chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                for words in words_of(text.decode("utf-8", "replace"), longest):
                    seen.setdefault(lang, Counter()).update(words)
                    if sum(map(len, seen.values())) > COUNTED:
                        yield from out()
        yield from out()

    return run


def gram_counts(words: DataFrame, orders: int) -> DataFrame:
    """words (lang, word, n) -> (lang, k, gram, n): words as order 0, and n-grams of orders 1 to orders, each counted as often as its words."""
    each = words.select("lang", "word", "n", F.explode(F.array(*[F.lit(k) for k in range(1, orders + 1)])).alias("k"))
    each = each.select("lang", "k", "n", F.when(F.col("k") > 1, F.concat(F.lit(" "), "word", F.lit(" "))).otherwise(F.col("word")).alias("whole"))
    each = each.where(F.char_length("whole") >= F.col("k")).select("lang", "k", "n", "whole", F.explode(F.sequence(F.lit(1), F.char_length("whole") - F.col("k") + 1)).alias("i"))
    found = each.groupBy("lang", "k", F.substring("whole", F.col("i"), F.col("k")).alias("gram")).agg(F.sum("n").alias("n"))
    return words.select("lang", F.lit(0).alias("k"), F.col("word").alias("gram"), "n").union(found)


def fit_languages(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Broadcast:
    """A broadcast Model of all documents that are learnable() and have a language.

    Words and n-grams are counted over whole texts. Of each language and order the commonest are kept, so many that the model's bounds hold whatever the
    languages: all that occur at least so often as the least count that leaves no more than settings.entries / (languages * orders), words being one more order. With nothing to learn from, the model has no language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(learnable(id_col) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    words = cut(known.mapInArrow(_counted(settings.longest), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    most = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(settings.languages).collect()
    languages = [r["lang"] for r in most]
    if not languages:
        discard(words)
        return spark.sparkContext.broadcast(Model([], [{} for _ in range(settings.orders + 1)], [0] * (settings.orders + 1), np.zeros((0, 0), np.int32)))
    each = max(1, min(settings.entries // (len(languages) * (settings.orders + 1)), settings.cells // (len(languages) ** 2 * (settings.orders + 1))))
    counts = cut(gram_counts(words.where(F.col("lang").isin(languages)), settings.orders))
    # At most a row for each different count: their number grows with the square root of the corpus.
    sizes = counts.groupBy("lang", "k", "n").agg(F.count("*").alias("many"))
    upto = Window.partitionBy("lang", "k").orderBy(F.desc("n"))
    least = sizes.select("lang", "k", "n", (F.col("n") * F.col("many")).alias("all"), F.sum("many").over(upto).alias("kept"))
    least = least.groupBy("lang", "k").agg(F.min(F.when(F.col("kept") <= each, F.col("n"))).alias("least"), F.sum("all").alias("total"))
    cost = F.round(-F.log10(F.col("n") / F.col("total")) * UNIT).cast("int")
    found = counts.join(F.broadcast(least), ["lang", "k"]).where("n >= least").select("lang", "k", "gram", cost.alias("cost")).toArrow()
    total = least.groupBy("k").agg(F.max("total").alias("total")).select("k", F.round(-F.log10(F.lit(0.5) / F.col("total")) * UNIT).cast("int").alias("cost")).collect()
    discard(words, counts)

    unseen = [0] * (settings.orders + 1)
    for r in total:
        unseen[r["k"]] = r["cost"]
    rows: list[dict[str, int]] = [{} for _ in unseen]
    column = {lang: i for i, lang in enumerate(languages)}
    at = np.zeros(len(found), np.int64)
    orders = found["k"].to_numpy()
    n = 0
    for i, (k, gram) in enumerate(zip(orders.tolist(), found["gram"].to_pylist())):
        at[i] = place = rows[k].setdefault(gram, n)
        n += place == n
    costs = np.zeros((n, len(languages)), np.int32)
    costs[at] = np.array(unseen)[orders][:, None]
    costs[at, [column[x] for x in found["lang"].to_pylist()]] = found["cost"].to_numpy()
    return spark.sparkContext.broadcast(Model(languages, rows, unseen, costs))


class Costs(dict):
    """Row numbers, in `table`, of words; unseen words are worked out when they are first asked for and forgotten, all at once, when there are too many."""

    def __init__(self, model: Model, remembered: int):
        super().__init__(model.rows[0])
        self.model, self.used = model, len(model.costs)
        self.table = np.vstack([model.costs, np.zeros((remembered, len(model.languages)), np.int32)])

    def full(self, coming: int) -> bool:
        return self.used + coming > len(self.table)

    def forget(self) -> None:
        self.clear()
        self.update(self.model.rows[0])
        self.used = len(self.model.costs)

    def backoff(self, word: str) -> np.ndarray | int:
        """The mean costs of the word's longest known n-grams."""
        for k in range(len(self.model.rows) - 1, 0, -1):
            if known := [r for g in grams(word, k) if (r := self.model.rows[k].get(g)) is not None]:
                return self.model.costs[known].sum(0, dtype=np.int64) // len(known)
        return self.model.unseen[0]

    def __missing__(self, word: str) -> int:
        self.table[self.used] = self.backoff(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1


def _predicted(model: Broadcast, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value.languages
        costs = Costs(model.value, max(1024, min(REMEMBERED, settings.cells // 4 // max(1, len(names)))))
        for batch, texts in chunks(batches):
            best, scores = [], []
            for text in texts:
                total, many = np.zeros(len(names), np.int64), 0
                for found in words_of(text.decode("utf-8", "replace"), settings.longest):
                    many += len(found)
                    for at in range(0, len(found) if names else 0, 1024):
                        if costs.full(1024):
                            costs.forget()
                        part = found[at : at + 1024]
                        total += costs.table[np.fromiter(map(costs.__getitem__, part), np.int64, len(part))].sum(0, dtype=np.int64)
                if not many or not names:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                first = min(range(len(names)), key=lambda i: (total[i], i))
                best.append(names[first])
                scores.append(1 / float(np.power(10.0, (total[first] - total) / (many * UNIT)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, model: Broadcast, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs.

    A word (a run of letters, lower-cased, of at most settings.longest) costs -log10 of its frequency in a language, one that a language lacks as much as half an occurrence in the largest;
    a word that no language has costs the mean of its known n-grams of the longest order that has any. The language of the least sum wins, of ties that with more
    words; score is its share of 10 to the minus mean cost. Whole texts count; null ones and those without a letter, and all texts if nothing was learned, are `und` with score 0. Text alone decides: repeated rows
    are alike, other columns don't matter, null ids count as empty ones.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predicted(model, settings), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", F.round("score", 9).alias("score"))
