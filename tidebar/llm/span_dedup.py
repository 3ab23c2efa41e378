"""Substring dedup by sliding sentence spans.

Spans are SPAN consecutive sentences with WORDS words or more, and the shortest runs of any number of sentences (one too) with ENOUGH words, from each sentence on and
back from each. Hashes that occur more than once anywhere are joined back, and sentences covered by a span that isn't the first of its kind (by doc id, then place)
are removed: every sentence in a repeated run of whole sentences with ENOUGH words. Long sentences are broken where their own words say so, so that copies inside them break alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, cut, discard, small_batches, spans_hash, words_of

#: Sentences a span, and the words that it has at least: spans of very short sentences recur by chance. Runs of any number of sentences have ENOUGH words, so
#: that a license line or a saying of one sentence isn't a repeat.
SPAN, WORDS, ENOUGH = 3, 12, 19
#: Sentences of over LONG words are broken before the word of least hash of every WINDOW words (the leftmost of several). At each end a copied stretch loses at most
#: LONG words, to a sentence that's partly outside or until the breaks agree; one of 2 * LONG + ENOUGH (51) words or more always holds a whole run of ENOUGH.
LONG, WINDOW = 16, 8
#: A sentence ends after . ! or ? (with closing quotes or brackets) before white space, or at a line's end.
SENTENCE = regex.compile(rb"""[^\n]*?[.!?]+["')\]]*(?=\s|$)[^\S\n]*\n?|[^\n]+\n?|\n""", regex.S)


def broken(long: list[bytes]) -> list[list[bytes]]:
    """Each of these sentences of over LONG words in pieces of at most WINDOW words."""
    if not long:
        return []
    hashes, stops = words_of(long)
    starts = np.concatenate([[0], stops[:-1]])
    at = np.arange(len(hashes) - WINDOW + 1)
    least = at + sliding_window_view(hashes, WINDOW).argmin(1)
    inside = at + WINDOW <= np.repeat(stops, stops - starts)[: len(at)]
    breaks = np.unique(least[inside])
    out = []
    # Where each word starts in its sentence.
    blank = SPACE[np.frombuffer(b" ".join([*long, b""]), np.uint8)]
    sizes = np.array([len(x) + 1 for x in long])
    found = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1) == -1) - np.repeat(np.cumsum(sizes) - sizes, stops - starts)
    breaks = breaks[~np.isin(breaks, starts)]
    edges, at = found[breaks].tolist(), np.searchsorted(breaks, [0, *stops]).tolist()
    for k, text in enumerate(long):
        out.append([text[x:y] for x, y in pairwise([0, *edges[at[k] : at[k + 1]], len(text)])])
    return out


def all_sentences(texts: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Each text in pieces that join to the text again, and which pieces start a sentence (the others go on in a broken one)."""
    found = [SENTENCE.findall(x) for x in texts]
    flat = [p for own in found for p in own]
    _, stops = words_of(flat)
    long = (np.diff(stops, prepend=0) > LONG).tolist()
    parts = iter(broken([p for p, x in zip(flat, long, strict=True) if x]))
    groups = iter([next(parts) if x else [p] for p, x in zip(flat, long, strict=True)])
    pieces, heads = [], []
    for own in found:
        mine = [next(groups) for _ in own]
        pieces.append([q for group in mine for q in group])
        heads.append(np.array([k == 0 for group in mine for k in range(len(group))], bool))
    return pieces, heads


def sentences(text: bytes) -> list[bytes]:
    """The text in pieces that join to the text again."""
    return all_sentences([text])[0][0]


def spans_of(texts: list[bytes], span: int = SPAN, words: int = WORDS, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of all texts: the text's number, the first piece's place in it, the number of pieces and the hash of the words.

    Sentences count by their words, lower-cased A-Z; blank ones join the next without counting.
    """
    pieces, heads = all_sentences(texts)
    full = [np.array([bool(p.strip()) for p in own], bool) for own in pieces]
    sizes = np.array([x.sum() for x in full], np.int64)
    hashes, stops = words_of([p for own in pieces for p in own if p.strip()])
    if not len(stops):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    starts = np.concatenate([[0], stops[:-1]])
    text, base = np.repeat(np.arange(len(pieces)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = base + np.repeat(sizes, sizes) - 1
    own = np.arange(len(stops))
    # The shortest run from each piece on, and back from each; many are both.
    end = np.searchsorted(stops, starts + enough)
    begin = np.searchsorted(starts, stops - enough, "right") - 1
    ahead, back = end <= last, begin >= base
    # Runs of `span` whole sentences; those with `enough` words are covered already.
    head = np.flatnonzero(np.concatenate([x[y] for x, y in zip(heads, full, strict=True)]))
    stop = np.append(head, len(stops))[span:] - 1
    head = head[: len(stop)]
    size = stops[stop] - starts[head]
    few = (stop <= last[head]) & (size >= words) & (size < enough)
    first, final = np.concatenate([own[ahead], begin[back], head[few]]), np.concatenate([end[ahead], own[back], stop[few]])
    first, final = np.divmod(np.unique(first * len(stops) + final), len(stops))
    return text[first], first - base[first], final - first + 1, spans_hash(hashes, starts[first], stops[final])


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, words: int = WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, kept), or kept_sha256: a row for each row of docs.

    removed holds the numbers (from 0, of sentences with words) of those taken out, kept the rest of the text. Null texts are empty; spans of fewer
    than `words` words are left alone, and so are those of fewer than ENOUGH unless they're `span` sentences. Pieces of long sentences count as sentences. The first occurrence is that of the least
    doc id, hash of its text and place; rows without an id come first. Of rows that repeat an id and text all but one
    are repeats as a whole only where they can be told apart, so they count as one document. Other columns don't matter.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.hash(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(spans_of(own, span, words)[3].view(np.int64))], names=["span"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in chunks(batches):
            at, place, size, code = spans_of(own, span, words)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(code.view(np.int64))], names=["doc", "mark", "place", "size", "span"])

    # Hashes alone are counted first: most occur once, and their places needn't be shuffled.
    repeated = cut(texts.select("text").mapInArrow(hashes, "span long").groupBy("span").agg(F.count("*").alias("many")).where("many > 1").select("span"))
    spans = cut(texts.mapInArrow(hashed, f"doc {kind}, mark int, place int, size int, span long").join(repeated, "span", "left_semi"))
    # Written, so that a join can deal a common span's rows out.
    first = cut(spans.groupBy("span").agg(F.min(F.struct("doc", "mark", "place")).alias("first")))
    later = spans.join(first, "span").where(F.struct("doc", "mark", "place") != F.col("first"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that overlap or touch become one."""
        for batch in batches:
            out = []
            for places in batch.column(2).to_pylist():
                own: list[list[int]] = []
                for at, size in sorted((p >> 32, p & 0xFFFFFFFF) for p in places):
                    if own and at <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], at + size)
                    else:
                        own.append([at, at + size])
                out.append([(x << 32) + y - x for x, y in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc", "mark", "places"])

    gone = cut(later.groupBy("doc", "mark").agg(F.collect_set(F.expr("shiftleft(bigint(place), 32) + size")).alias("places")).mapInArrow(merged, f"doc {kind}, mark int, places array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in chunks(batches):
            many, removed, kept = [], [], []
            for pieces, places in zip(all_sentences(own)[0], batch.column(2).to_pylist(), strict=True):
                out = {(p >> 32) + k for p in places or () for k in range(p & 0xFFFFFFFF)}
                n, rest = 0, []
                for piece in pieces:
                    if piece.strip():
                        n += 1
                        if n - 1 in out:
                            continue
                    rest.append(piece)
                many.append(n)
                removed.append(sorted(out))
                kept.append(b"".join(rest))
            last = [sha256(x).hexdigest() for x in kept] if digest else [x.decode() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(last, pa.string())], names=["doc_id", "n_sentences", "n_removed", "removed", "kept"])

    both = texts.alias("t").join(gone.alias("g"), F.expr("t.doc <=> g.doc and t.mark = g.mark"), "left").select("t.doc", "text", "places")
    discard(spans, repeated, first)
    out = both.mapInArrow(run, f"doc_id {kind}, n_sentences long, n_removed long, removed array<int>, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
