"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

All suffixes of a corpus are too many to ship, so what can't repeat is left out first, exactly: winnowing picks in each window of
`length` bytes the least hash of its GRAM-byte strings, so equal windows have the same anchor at the same place. Anchors whose hash occurs
once end there. The surroundings of the others (all windows that pick the anchor) are cut out; equal
surroundings are repeats as a whole and go on as one. What is left is sorted in blocks by two-stage suffix sorting: suffixes smaller than
their successors directly, the others induced from them by bucket scans; neighbours with `length` bytes in common are repeats.
An anchor with more different surroundings than a task should hold is split: its windows are dealt to classes of STEP neighbouring starts, and in a class
surroundings meet only if they have what all its windows share. These pieces are sorted like the others. A class that still has too many meets by digests of single windows. As
every window holds the anchor, the first and the last repeated one say what is covered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, cut, discard, hinted, mix64, powers, small_batches

LENGTH, GRAM = 200, 32
#: Bytes of surroundings in a sorted block, about; different surroundings of an anchor that one block takes.
BLOCK_BYTES, CROWD = 150_000, 1000
#: Windows of such an anchor that a class takes.
STEP = 22
PLACE = np.uint64((1 << 20) - 1)


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def anchors_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of one text: its anchors' places and hashes, and the hashes, starts and ends of their surroundings: the windows that pick them."""
    span = length - GRAM + 1
    picks = []
    step = CHUNK_BYTES - length
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(text) - length + 1), step):
        data = whole[at : at + step + length - 1]
        if len(data) < length:
            continue
        sums, down = _hashes(data)
        n = len(data) - GRAM + 1
        grams = mix64((sums[GRAM:] - sums[:n]) * down[:n])
        keys = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
        keys[:n] = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)
        rows = keys.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(data) - length + 1
        least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
        picks.append(at + (least & PLACE).astype(np.int64))
    if not picks:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    # Windows in order pick anchors in order, so each anchor's are a run.
    pick = np.concatenate(picks)
    first = np.flatnonzero(np.diff(pick, prepend=-1))
    place, last = pick[first], np.append(first[1:] - 1, len(pick) - 1) + length
    sums, down = _hashes(whole)
    gram = mix64((sums[place + GRAM] - sums[place]) * down[place])
    around = mix64((sums[last] - sums[first]) * down[first] + (((last - first) << 12) | (place - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return place, gram.view(np.int64), around.view(np.int64), first, last


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = [anchors_of(x, length) for x in texts]
            many = [len(x[0]) for x in found]
            at = np.repeat(np.arange(len(texts)), many)
            place, gram, around, first, last = (np.concatenate([x[k] for x in found]) for k in range(5))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(place.astype(np.int32)), pa.array((place - first).astype(np.int16)), pa.array((last - place).astype(np.int16)), pa.array(gram), pa.array(around)], names=["doc", "mark", "place", "before", "beyond", "gram", "around"])

    return run


def two_stage_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of text by their first `depth` bytes or more, and the 8 bytes from each place as a number."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    # A suffix is smaller than its successor where the next different byte is larger; the last run's suffixes are larger.
    step = np.sign(np.diff(text.astype(np.int16), append=-1)).astype(np.int8)
    change = np.where(step != 0, np.arange(n), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = step[change] > 0
    direct = np.flatnonzero(smaller)
    order = direct[np.argsort(words[direct], kind="stable")]
    tied = np.arange(len(order))
    # A group of suffixes that are equal so far goes by the place of its first one.
    group = np.maximum.accumulate(np.where(np.diff(words[order], prepend=words[order[:1]] ^ np.uint64(1)) != 0, tied, 0)) if len(order) else tied
    # Where all of a tied group have the same hash of the next `depth` bytes, there is nothing left to sort.
    sums, down = _hashes(padded)
    ahead = ((sums[depth : depth + n] - sums[:n]) * down[:n])[order] if len(order) else np.empty(0, np.uint64)
    for off in range(8, depth, 8):
        own, hashed = group[tied], ahead[tied]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        if not len(first):
            break
        mixed = np.minimum.reduceat(hashed, first) != np.maximum.reduceat(hashed, first)
        tied = tied[np.repeat(mixed, np.diff(first, append=len(own)))]
        if not len(tied):
            break
        own, keys = group[tied], words[order[tied] + off]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sizes = np.diff(first, append=len(own))
        here = np.repeat(np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first), sizes)
        at, keys = tied[here], keys[here]
        sort = np.lexsort((keys, group[at]))
        order[at], ahead[at], keys, own = order[at][sort], ahead[at][sort], keys[sort], group[at]
        new = (np.diff(own, prepend=-1) != 0) | (np.diff(keys, prepend=keys[:1]) != 0)
        group[at] = np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(n, np.int64)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    heads = ends - counts
    some = np.bincount(text[order], minlength=256)
    at = 0
    for c in np.flatnonzero(some):
        out[ends[c] - some[c] : ends[c]] = order[at : at + some[c]]
        at += some[c]
    if n:
        out[heads[text[n - 1]]] = n - 1
        heads[text[n - 1]] += 1
    for c in np.flatnonzero(counts):
        lo = ends[c] - counts[c]
        while lo < heads[c]:
            before = out[lo : heads[c]] - 1
            before = before[(before >= 0)]
            before = before[(text[before] == c) & ~smaller[before]]
            lo = heads[c]
            out[lo : lo + len(before)] = before
            heads[c] += len(before)
        before = out[ends[c] - counts[c] : ends[c]] - 1
        before = before[before >= 0]
        first = text[before]
        larger = first > c
        before, first = before[larger], first[larger]
        sort = np.argsort(first, kind="stable")
        before, first = before[sort], first[sort]
        many = np.bincount(first, minlength=256)
        out[(heads - np.cumsum(many) + many)[first] + np.arange(len(first))] = before
        heads = heads + many
    return out, words


def repeats_in(surroundings: list[bytes], lefts: np.ndarray, grams: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of the surroundings the starts of windows that another one of the same anchor has at the same place."""
    sizes = np.array([len(x) for x in surroundings])
    text = np.frombuffer(b"".join(surroundings), np.uint8)
    order, words = two_stage_order(text, length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    start = order - begins[owner[order]]
    fits = start + length <= sizes[owner[order]]
    order, start = order[fits], start[fits]
    # Common prefixes of neighbours, as far as `length`.
    same = np.arange(1, len(order))
    common = np.zeros(max(len(order) - 1, 0), np.int64)
    for off in range(0, length, 8):
        x, y = words[order[same - 1] + off], words[order[same] + off]
        left = length - off
        if left < 8:
            x, y = x >> np.uint64(8 * (8 - left)), y >> np.uint64(8 * (8 - left))
        same = same[x == y]
        common[same - 1] += min(8, left)
    run = np.concatenate([[0], np.cumsum(common < length)]) if len(order) else np.empty(0, np.int64)
    where = owner[order]
    place = start - lefts[where]
    sort = np.lexsort((place, grams[where], run))
    a, b, c = run[sort], grams[where][sort], place[sort]
    twin = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
    hit = np.zeros(len(sort), bool)
    hit[1:] = twin
    hit[:-1] |= twin
    rows, starts = where[sort][hit], start[sort][hit]
    sort = np.lexsort((starts, rows))
    rows, starts = rows[sort], starts[sort]
    stops = np.searchsorted(rows, np.arange(len(sizes) + 1))
    return [starts[stops[i] : stops[i + 1]] for i in range(len(sizes))]


def _digest(piece: bytes) -> bytes:
    return blake2b(piece, digest_size=16).digest()


def classes(piece: bytes, left: int, length: int) -> list[tuple[int, int, bytes, bytes]]:
    """One of the surroundings (its anchor `left` bytes in) by classes of windows: (class, first start from the anchor, digest of what all windows of the class share, the bytes of its own windows)."""
    last, out = len(piece) - length - left, []
    for k in range(left // STEP + 1):
        low, high = -(k + 1) * STEP + 1, -k * STEP
        a, b = max(low, -left), min(high, last)
        if a <= b:
            out.append((k, a, _digest(piece[left + high : left + low + length]), piece[left + a : left + b + length]))
    return out


def _runs(starts: np.ndarray, left: int, length: int) -> list[int]:
    """Starts of windows, ascending, as pairs (from, to) of covered bytes, relative to the anchor."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts, prepend=starts[0] - length - 1) > length)
    return np.stack([starts[new], np.append(starts[new[1:] - 1], starts[-1]) + length], 1).ravel().__sub__(left).tolist()


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (doc, mark, text), a row for each row of docs, and spans (doc, mark, cover), where cover holds the
    starts and ends of the repeated stretches of that document's UTF-8 bytes, unmerged, for those that have any."""
    spark = docs.sparkSession
    small_batches(spark)
    span = length - GRAM + 1
    texts = docs.select(F.col(id_col).alias("doc"), F.hash(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    anchors = cut(texts.mapInArrow(_anchor_rows(length), f"doc {kind}, mark int, place int, before short, beyond short, gram long, around long"))
    often = cut(anchors.groupBy("gram").agg(F.count("*").alias("many"), F.min("around").alias("low"), F.max("around").alias("high")).where("many > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")))
    found = cut(anchors.join(often, "gram"))
    kinds = cut(found.groupBy("gram", "around").agg(F.count("*").alias("many"), F.first("mixed").alias("mixed"), F.min(F.struct("doc", "mark", "place", "before", "beyond")).alias("one")))
    crowds = cut(kinds.where("mixed").groupBy("gram").agg(F.count("*").alias("size")).where(f"size > {CROWD}").select("gram"))
    alone = kinds.where("mixed").join(hinted(crowds).withColumn("crowd", F.lit(True)), "gram", "left").select("gram", "around", "one.*", F.coalesce("crowd", F.lit(False)).alias("crowd"))
    wanted = cut(alone.groupBy("doc", "mark").agg(F.collect_list(F.struct("place", "before", "beyond", "gram", "around", "crowd")).alias("cuts")))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("crowd", pa.bool_()), ("left", pa.int32()), ("piece", pa.binary())])
        for batch, own in chunks(batches):
            out = []
            for text, cuts in zip(own, batch.column(1).to_pylist(), strict=True):
                for c in cuts:
                    out.append({"gram": c["gram"], "around": c["around"], "crowd": c["crowd"], "left": c["before"], "piece": text[c["place"] - c["before"] : c["place"] + c["beyond"]]})
            yield pa.RecordBatch.from_pylist(out, schema)

    once = texts.alias("t").join(wanted.alias("w"), F.expr("t.doc <=> w.doc and t.mark = w.mark")).select("text", "cuts")
    pieces = cut(once.mapInArrow(slices, "gram long, around long, crowd boolean, left int, piece binary"))

    def block(table: pa.Table) -> pa.Table:
        lefts = table["left"].to_numpy()
        # Rows that repeat a document bring the same piece twice: one is enough.
        pairs = np.stack([table["gram"].to_numpy(), table["around"].to_numpy()], 1)
        keep = np.sort(np.unique(pairs, axis=0, return_index=True)[1])
        table, lefts = table.take(pa.array(keep)), lefts[keep]
        starts = repeats_in(table["piece"].to_pylist(), lefts, table["gram"].to_numpy(), length)
        covers = pa.array([_runs(x, left, length) for x, left in zip(starts, lefts.tolist(), strict=True)], pa.list_(pa.int32()))
        return pa.table({"gram": table["gram"], "around": table["around"], "cover": covers})

    blocks = max(1, int(kinds.where("mixed").count() * (length + span / 2) / BLOCK_BYTES))
    covers = pieces.where("not crowd").withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks))).groupBy("block").applyInArrow(block, "gram long, around long, cover array<int>")
    parts = []
    if not crowds.isEmpty():

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("class", pa.int32()), ("first", pa.int32()), ("core", pa.binary()), ("span", pa.binary())])
            for batch in batches:
                rows = [(gram, around, *x) for gram, around, left, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in classes(piece, left, length)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(gram, around, first + k, _digest(span[k : k + length])) for gram, around, first, span in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in range(len(span) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["gram", "around", "at", "code"])

        def sorted_class(table: pa.Table) -> pa.Table:
            first = table["first"].to_numpy().astype(np.int64)
            groups = {x: k for k, x in enumerate(dict.fromkeys(zip(*(table[c].to_pylist() for c in ("gram", "class", "core")))))}
            own = np.array([groups[x] for x in zip(*(table[c].to_pylist() for c in ("gram", "class", "core")))])
            found = repeats_in(table["span"].to_pylist(), -first, own, length)
            some = np.flatnonzero([len(x) > 0 for x in found])
            ends = [(int(found[k][0] + first[k]), int(found[k][-1] + first[k])) for k in some]
            return pa.table({"gram": table["gram"].take(pa.array(some)), "around": table["around"].take(pa.array(some)), "a": pa.array([x[0] for x in ends], pa.int32()), "b": pa.array([x[1] for x in ends], pa.int32())})

        key = ["gram", "class", "core"]
        crowd = pieces.where("crowd").dropDuplicates(["gram", "around"]).select("gram", "around", "left", "piece")
        spread = cut(crowd.mapInArrow(split, "gram long, around long, class int, first int, core binary, span binary"))
        shared = cut(spread.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"))
        dealt = spread.join(hinted(shared), key)
        bins = max(1, spread.count() * (length + STEP) // BLOCK_BYTES)
        few = dealt.where(f"size <= {CROWD}").withColumn("block", F.pmod(F.xxhash64(*key), F.lit(bins))).groupBy("block").applyInArrow(sorted_class, "gram long, around long, a int, b int")
        windows = cut(dealt.where(f"size > {CROWD}").select("gram", "around", "first", "span").mapInArrow(single, "gram long, around long, at int, code binary"))
        twice = cut(windows.groupBy("gram", "at", "code").count().where("count > 1").drop("count"))
        many = windows.join(hinted(twice), ["gram", "at", "code"]).select("gram", "around", F.col("at").alias("a"), F.col("at").alias("b"))
        parts = [spread, shared, windows, twice]
        ends = few.union(many).groupBy("gram", "around").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        covers = covers.unionByName(ends.select("gram", "around", F.array("a", F.col("b") + length).alias("cover")))
    covers = cut(covers.where("size(cover) > 0"))
    # What a place in a document is covered by: its whole surroundings, or what the sorted block found.
    known = cut(kinds.select("gram", "around", (F.col("many") > 1).alias("whole")).join(covers, ["gram", "around"], "left").where("whole or cover is not null"))
    first = F.col("place") - F.col("before").cast("int")
    cover = F.when(F.col("whole"), F.array(first, F.col("place") + F.col("beyond").cast("int"))).otherwise(F.transform("cover", lambda x: x + F.col("place")))
    spans = cut(found.select("doc", "mark", "place", "before", "beyond", "gram", "around").join(known, ["gram", "around"]).select("doc", "mark", cover.alias("cover")).groupBy("doc", "mark").agg(F.flatten(F.collect_list("cover")).alias("cover")))
    discard(anchors, often, found, kinds, wanted, crowds, pieces, covers, known, *parts)
    return texts, spans


def merged_runs(cover: list[int] | None) -> list[tuple[int, int]]:
    """Starts and ends in turn, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(cover[::2], cover[1::2])) if cover else ():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), or kept_sha256 in place of the bytes kept: a row for each row of docs.

    Every byte covered by a string of `length` bytes that also starts anywhere else, in the same document or another, is removed; overlaps
    count, and matches don't cross documents. Null texts are empty; texts shorter than `length` stay whole. Repeated rows are
    occurrences like any other, so their texts go, if long enough. Rows that share an id but not a text are told apart.
    """
    texts, spans = repeated_bytes(docs, id_col, text_col, length)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in chunks(batches):
            gone = [merged_runs(x) for x in batch.column(2).to_pylist()]
            kept = []
            for text, runs in zip(own, gone, strict=True):
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join([*parts, text[at:]]))
            last = pa.array([sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([sum(b - a for a, b in x) for x in gone], pa.int64()), pa.array([len(x) for x in gone], pa.int64()), last], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = texts.alias("t").join(spans.alias("s"), F.expr("t.doc <=> s.doc and t.mark = s.mark"), "left").select("t.doc", "text", "cover")
    out = both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
