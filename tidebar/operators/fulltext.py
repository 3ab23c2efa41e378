"""Ranked full text: a positional inverted index, intersection of posting lists from the rarest term on, cover density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a cover of no other words scores: the weight of a plain word.
WEIGHT = 0.1
#: Folders that a stored index is dealt to by term, so that a search reads its terms' ones.
SHARDS = 64
#: Pairs of a query and a document, and places of their terms, that a task looks at at a time.
PAIRS, PLACES = 1 << 18, 1 << 20
#: Bytes of words that Spark hands to Python at a time.
BATCH_BYTES = 2 << 20


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, words), a row a document: the words of all its texts, which are in order."""
    rows = documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("document_id")).agg(F.array_sort(F.collect_list(text_col)).alias("texts"))
    return rows.select("document_id", F.flatten(F.transform("texts", terms)).alias("words"))


def index(documents: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(term, document_id, places): a posting a term of a document, with all its places, from 1 on, in order. Documents without an id or a word have none; rows that repeat an id are one
    document each of whose texts is read, the places of the first (in order of the texts) before those of the next."""
    words = words_of(documents, id_col, text_col).select("document_id", F.posexplode("words").alias("i", "term"))
    return words.groupBy("term", "document_id").agg(F.array_sort(F.collect_list(F.col("i") + 1)).alias("places"))


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def write_index(postings: DataFrame, path: str) -> None:
    """Stores an index, dealt to folders by term and sorted by it within them."""
    postings.withColumn("shard", _shard(F.col("term"))).repartition("shard").sortWithinPartitions("shard", "term", "document_id").write.partitionBy("shard").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cover_density(entries: Column, n: Column) -> Column:
    """Of (place, t) in order of places, t one of n terms from 0 on: the sum over all minimal covers (stretches that have every term and no shorter stretch within that does) of
    WEIGHT / (1 + words in it that are no such term)."""
    spot = "struct<place: int, k: int>"
    start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(None).cast(spot)).alias("last"), F.lit(0).alias("k"), F.lit(0).alias("begun"), F.lit(0.0).alias("sum"))

    def step(at: Column, e: Column) -> Column:
        last = F.transform(at["last"], lambda x, i: F.when(i == e["t"], F.struct(e["place"].cast("int").alias("place"), at["k"].alias("k"))).otherwise(x))
        # The latest start of a stretch that ends here: it is a cover of its own only if it lies after the last one's.
        first = F.when(F.exists(last, lambda x: x.isNull()), F.lit(None).cast(spot)).otherwise(F.array_min(last))
        fresh = F.coalesce(first["place"] > at["begun"], F.lit(False))
        other = e["place"] - first["place"] - (at["k"] - first["k"])
        return F.struct(last.alias("last"), (at["k"] + 1).alias("k"), F.when(fresh, first["place"]).otherwise(at["begun"]).alias("begun"), (at["sum"] + F.when(fresh, WEIGHT / (1 + other)).otherwise(0.0)).alias("sum"))

    return F.aggregate(entries, start, step, lambda at: at["sum"])


def search(postings: DataFrame, queries: DataFrame, query_col: str = "query_id", words_col: str = "words") -> DataFrame:
    """(query_id, document_id, lexical_score) of all documents that have all words of a query, which each query (query_id, words) has at least one of.

    A query's candidates are the list of its rarest term; each other term's list is met by (term, document), so that a common term's list is never joined to a query as a whole. A new
    index lies by document, as its texts were dealt: there only candidates are dealt to the documents' lists, and no list is shuffled. Queries that repeat an id are one query with all their words.
    The terms that are asked for, and the queries, are broadcast.
    """
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query_id"), F.explode(terms(F.col(words_col))).alias("term")).distinct()
    shards = "shard" in postings.columns
    lists = postings if shards else postings.withColumn("shard", F.lit(0))
    place = _shard(F.col("term")) if shards else F.lit(0)
    asked = asked.withColumn("shard", place)
    # Only the lists of terms that are asked for are counted and read.
    wanted = lists.join(F.broadcast(asked.select("shard", "term").distinct()), ["shard", "term"], "left_semi")
    sizes = wanted.groupBy("term").agg(F.count("*").alias("size"))
    known = asked.join(sizes, "term", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    plans = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("size", "term"))).alias("order")).where(F.col("order")[0]["size"] > 0)
    plans = plans.select("query_id", F.transform("order", lambda x: x["term"]).alias("terms"))
    first = wanted.select("shard", "term", "document_id").join(F.broadcast(plans.withColumn("term", F.col("terms")[0]).withColumn("shard", place)), ["shard", "term"]).select("query_id", "terms", "document_id")
    if shards:
        needs = first.select("query_id", "document_id", F.size("terms").alias("n"), F.posexplode("terms").alias("t", "term")).withColumn("shard", place)
        met = needs.join(wanted, ["shard", "term", "document_id"]).groupBy("query_id", "document_id").agg(F.first("n").alias("n"), F.count("*").alias("has"), F.collect_list(F.struct("t", "places")).alias("lists"))
    else:
        own = wanted.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("own"))
        asks = F.filter(F.transform("terms", lambda x, t: F.struct(t.alias("t"), F.col("own")[x].alias("places"))), lambda x: x["places"].isNotNull())
        met = first.join(own.hint("merge"), "document_id").select("query_id", "document_id", F.size("terms").alias("n"), asks.alias("lists")).withColumn("has", F.size("lists"))
    entries = F.array_sort(F.flatten(F.transform("lists", lambda p: F.transform(p["places"], lambda x: F.struct(x.alias("place"), p["t"].alias("t"))))))
    return met.where("has = n").select("query_id", "document_id", cover_density(entries, F.col("n")).alias("lexical_score"))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after another."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of counts that add up to `most` at most, or are one count."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def covers(places: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """cover_density of many pairs at once: of pair p the t-th term's places are counts[p, t] numbers, ascending, from places[starts[p, t]] on."""
    n = starts.shape[1]
    pair = np.concatenate([np.repeat(np.arange(len(starts)), counts[:, t]) for t in range(n)])
    place = np.concatenate([places[ranges(starts[:, t], counts[:, t])] for t in range(n)])
    term = np.repeat(np.arange(n), counts.sum(0))
    # Each term's part is in order already, so that this is a merge.
    order = np.argsort(pair << 32 | place, kind="stable")
    pair, place, term = pair[order], place[order], term[order]
    at = np.arange(len(pair))
    first = at
    for t in range(n):
        first = np.minimum(first, np.maximum.accumulate(np.where(term == t, at, -1)))
    total = counts.sum(1)
    begun = np.repeat(np.cumsum(total) - total, total)
    # The latest start of a stretch that ends here; it is a cover of its own only if it lies after the last one's, which no start in the pair before does.
    fresh = np.flatnonzero((first >= begun) & (first > np.concatenate([[-1], first[:-1]])))
    other = place[fresh] - place[first[fresh]] - (fresh - first[fresh])
    return np.bincount(pair[fresh], WEIGHT / (1 + other), len(starts))


def _scores(sent, names: tuple[str, ...]):
    """Rows (query, document, score) from rows (document_id, words). sent: a broadcast of the queries' ids, all terms, and the queries' terms as numbers one after another with where each query's begin; a query's
    first term is the one that fewest queries have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vocabulary, terms_of, begin = sent.value
        many = np.diff(begin)
        by_first = np.argsort(terms_of[begin[:-1]], kind="stable")
        asks = np.bincount(terms_of[begin[:-1]], minlength=len(vocabulary))
        upto = np.cumsum(asks) - asks
        for batch in batches:
            words = batch.column(1)
            known = pc.index_in(words.flatten(), value_set=vocabulary)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            here = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
            term = known.drop_null().to_numpy().astype(np.int64)
            doc, place = np.repeat(np.arange(len(sizes)), sizes)[here], ranges(np.ones(len(sizes), np.int64), sizes)[here]
            # The batch's posting lists: key by key (document, term) the places in order.
            keys = doc * len(vocabulary) + term
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], place[order]
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            counts, keys = np.diff(starts, append=len(keys)), keys[starts]
            lists = asks[keys % len(vocabulary)]
            for a, b in slices(lists, PAIRS):
                query = by_first[ranges(upto[keys[a:b] % len(vocabulary)], lists[a:b])]
                own = np.repeat(np.arange(a, b), lists[a:b])
                for n in np.unique(many[query]).tolist():
                    q, met = query[many[query] == n], own[many[query] == n][:, None]
                    for t in range(1, n):
                        want = keys[met[:, 0]] // len(vocabulary) * len(vocabulary) + terms_of[begin[q] + t]
                        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                        has = keys[at] == want
                        q, met = q[has], np.column_stack([met[has], at[has]])
                    for c, d in slices(counts[met].sum(1), PLACES):
                        some = met[c:d]
                        found = covers(places, starts[some], counts[some])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[c:d])), batch.column(0).take(pa.array(keys[some[:, 0]] // len(vocabulary))), pa.array(found)], names=list(names))

    return run


def search_texts(documents: DataFrame, queries: DataFrame, id_col: str = "document_id", text_col: str = "content", query_col: str = "query_id", words_col: str = "words") -> DataFrame:
    """What search() finds in a new index of documents, for many queries at once: each task makes the posting lists of its documents and meets all queries with them.

    A document's candidates are the queries whose least asked term it has; the other terms are met one by one, by (document, term). The queries go through the driver and are broadcast; of
    documents nothing but the texts is dealt, by id.
    """
    spark = documents.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query_id"), F.explode(terms(F.col(words_col))).alias("term")).distinct()
    sets = asked.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    found = sets.toArrow()
    listed = found["terms"].combine_chunks()
    flat = pc.dictionary_encode(listed.flatten())
    term = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    query = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
    order = np.lexsort((term, np.bincount(term)[term], query))
    begin = np.searchsorted(query, np.arange(len(listed) + 1))
    sent = spark.sparkContext.broadcast((found["query_id"].combine_chunks(), flat.dictionary, term[order], begin))
    words = words_of(documents, id_col, text_col)
    names = ("query_id", "document_id", "lexical_score")
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, (sets.schema["query_id"].dataType, words.schema["document_id"].dataType, T.DoubleType()))])
    return words.mapInArrow(_scores(sent, names), schema)
