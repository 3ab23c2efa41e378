"""N-gram Jaccard join: multiple-global-order prefix filtering over sets of word shingles.

Two sets with |A & B| / |A | B| >= t share a token among the first n - ceil(t * n) + 1 of each set, whatever global order the
tokens are in; and not only one, but as many as the needed overlap exceeds what lies beyond the prefixes. Three orders are used: rare first
(corpus-wide heavy hitters last, the rest by hash), one by a second hash ascending, one by it descending. The first order's buckets give candidates; only those whose prefixes
share enough tokens in all three orders, and lack few enough in the second and third together, go on to have their whole sets compared.

Links inside a large group of near copies are many; components need only enough of them. So each document is first held against the pivot of one of its
buckets (that with which it shares most prefix tokens), a pair a document. A bucket's documents are parted where sizes leave a gap that no link crosses. Buckets that hold several components after that
make groups, whose documents are dealt out in pieces of bounded size; every two pieces meet in one task, but for those of the commonest component. They meet three times: with their prefixes in the first order,
which leaves the documents that have a candidate at all, with those in the second and third, which together are half of a set and leave little but links, then with whole sets. A task returns no pairs but only which
components it joins. Where a group's meetings are many they are held in rounds. No link that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, discard, hinted, mix64, release, renamed, small_batches, unused, words_of
from .components import components

WORDS, PERCENT = 5, 75
#: Heavy hitters kept by each task, and in all: the broadcast is 16 bytes an entry.
HEAVY_TASK, HEAVY_ALL = 1 << 18, 1 << 18
#: Tokens counted this often are dealt out by document, too.
SALTED, SALTS = 2000, 64
#: A piece of a group holds about this many tokens; a document counts as DOC more. A task takes about TASK_BYTES of sets.
PIECE, DOC, TASK_BYTES = 1 << 18, 256, 6 << 20
#: A round of meetings ships a document this often on average at most, and no more than this many bytes for each token of all documents (a token is about 4 bytes of Parquet input), or ROUND_LEAST.
COPIES, ROUND, ROUND_LEAST = 8, 2, 64 << 20


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending; the whole sequence if it has fewer words."""
    hashes, stops = words_of(texts)
    with np.errstate(over="ignore"):
        factor = np.uint64(0xD1342543DE82EF95)
        rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
        for k in range(1, words):
            rolled = rolled * factor + hashes[k : k + len(rolled)]
        rolled = mix64(rolled)
        out, at = [], 0
        for stop in stops.tolist():
            if stop - at >= words:
                out.append(np.unique(rolled[at : stop - words + 1]))
            elif stop > at:
                one = np.uint64(stop - at)
                for h in hashes[at:stop]:
                    one = one * factor + h
                out.append(mix64(np.array([one], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            at = stop
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def heavier(tokens: np.ndarray, counts: np.ndarray, more: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: counts of the tokens with more's added, cut back to the `most` largest."""
    every = np.concatenate([tokens, more])
    each = np.concatenate([counts, np.ones(len(more), np.int64)])
    order = np.argsort(every, kind="stable")
    every, each = every[order], each[order]
    first = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1)))
    tokens, counts = every[first], np.add.reduceat(each, first) if len(first) else each
    if len(tokens) > most:
        counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        tokens, counts = tokens[counts > 0], counts[counts > 0]
    return tokens, counts


def _summaries(words: int):
    """Rows of two kinds: 0, a document (id, hash of its text, 128 bits that stand for its set, size); 1, a heavy token and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, waiting, held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, words)
            n = np.array([len(x) for x in sets])
            with np.errstate(over="ignore"):
                one = np.array([mix64(x).sum(dtype=np.uint64) for x in sets], np.uint64)
                two = np.array([mix64(x ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), batch.column(0), batch.column(1), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n, pa.int64())], names=["kind", "a", "mark", "b", "c", "n"])
            waiting += sets
            held += int(n.sum())
            if held > 1 << 20:
                tokens, counts = heavier(tokens, counts, np.concatenate(waiting), HEAVY_TASK)
                waiting, held = [], 0
        if waiting:
            tokens, counts = heavier(tokens, counts, np.concatenate(waiting), HEAVY_TASK)
        keep = counts > 1
        tokens, counts = tokens[keep], counts[keep]
        zero = pa.array(np.zeros(len(tokens), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int8)), pa.array(tokens.view(np.int64)), zero, zero, zero, pa.array(counts)], names=["kind", "a", "mark", "b", "c", "n"])

    return run


class RareFirst:
    """The order that puts heavy tokens last; heavy holds them, ascending, and their counts."""

    def __init__(self, heavy: tuple[np.ndarray, np.ndarray]):
        self.tokens, self.counts = heavy
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.tokens >> np.uint64(42)] = True

    def prefix(self, own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of a set, and how often each occurs, as far as it is heavy."""
        often = np.zeros(len(own), np.int64)
        if len(self.tokens) and len(some := np.flatnonzero(self.maybe[own >> np.uint64(42)])):
            at = np.minimum(np.searchsorted(self.tokens, own[some]), len(self.tokens) - 1)
            often[some] = np.where(self.tokens[at] == own[some], self.counts[at], 0)
        first = np.argsort(often, kind="stable")[: prefix_length(len(own), percent)]
        return own[first], often[first]


def _prefixes(heavy, words: int, percent: int):
    """Rows (token, salt, doc, n): the prefixes in the first order. heavy: a broadcast of what RareFirst takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = RareFirst(heavy.value)
        for batch, texts in chunks(batches):
            out, docs, sizes, salts = [], [], [], []
            for doc, own in zip(batch.column(0).to_pylist(), shingle_sets(texts, words), strict=True):
                if not len(own):
                    continue
                first, often = order.prefix(own, percent)
                out.append(first)
                docs.append(np.full(len(first), doc, np.int64))
                sizes.append(np.full(len(first), len(own), np.int32))
                salts.append(np.where(often >= SALTED, 1 + doc % SALTS, 0).astype(np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([x.view(np.int64) for x in out], salts, docs, sizes)], names=["token", "salt", "doc", "n"])

    return run


def ends(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes in the second and the third order, both ascending, of a set in the second order."""
    k = prefix_length(len(tokens), percent)
    return tokens[:k], tokens[len(tokens) - k :]


def _stored(words: int, percent: int, columns: list[str]):
    """Rows (doc, n, and of up, down, tokens those in columns): the set as bytes in the second order, and the upper 32 bits of each token of its prefixes in the second and third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = [np.sort(mix64(x)) for x in shingle_sets(texts, words)]
            kinds: dict[str, list[bytes]] = {"up": [], "down": [], "tokens": [x.tobytes() for x in sets] if "tokens" in columns else []}
            for x in sets:
                for name, end in zip(("up", "down"), ends(x, percent)):
                    kinds[name].append((end >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(kinds[c], pa.binary()) for c in columns)], names=["doc", "n", *columns])

    return run


def stored(texts: DataFrame, words: int, percent: int, *columns: str) -> DataFrame:
    """What _stored gives for texts (doc, text), as a table."""
    return cut(texts.mapInArrow(_stored(words, percent, list(columns)), ", ".join(["doc long", "n int", *(f"{c} binary" for c in columns)])))


def needed(n, m, percent: int):
    """The least number of tokens that prefixes of two linked sets of n and m tokens share: the overlap, less what lies beyond the longer set's prefix."""
    return np.maximum(1, -(-percent * (n + m) // (100 + percent)) - -(-percent * np.maximum(n, m) // 100) + 1)


def _agree(percent: int):
    """Of rows (a, b, n, m, and both sets' prefixes in the second and the third order) those pairs that share enough in each order."""

    def enough(x: bytes, y: bytes, least: int) -> bool:
        # 32 bits may take two tokens for one: then more seem to be shared, never fewer.
        return int(np.isin(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)).sum()) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = needed(batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64), percent).tolist()
            rows = zip(least, *(batch.column(k).to_pylist() for k in (4, 5, 6, 7)), strict=True)
            keep = [enough(up, up2, k) and enough(down, down2, k) for k, up, up2, down, down2 in rows]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(percent: int):
    """Of rows (a, b, left, right) those whose sets are alike."""

    def alike(left: bytes, right: bytes) -> bool:
        x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of left shares with each of right: common tokens by products of narrow matrices, others pair by pair."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not out.size:
        return out
    tokens = [np.concatenate(x) for x in (left, right)]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    known = np.intersect1d(*tokens)
    if not len(known):
        return out
    for k in (0, 1):
        at = np.minimum(np.searchsorted(known, tokens[k]), len(known) - 1)
        here = known[at] == tokens[k]
        order = np.argsort(at[here], kind="stable")
        tokens[k], owners[k] = at[here][order], owners[k][here][order]
    (x, y), (i, j) = tokens, owners
    n, m = np.bincount(x, minlength=len(known)), np.bincount(y, minlength=len(known))
    wide = n * m * 200 > out.size
    columns = np.flatnonzero(wide)
    for a in range(0, len(columns), 1024):
        parts = []
        for t, own, rows in ((x, i, len(left)), (y, j, len(right))):
            place = np.full(len(known), -1)
            place[columns[a : a + 1024]] = np.arange(len(columns[a : a + 1024]))
            here = place[t] >= 0
            width = len(columns[a : a + 1024])
            parts.append(np.bincount(own[here] * width + place[t[here]], minlength=rows * width).reshape(rows, width).astype(np.float32))
        out += (parts[0] @ parts[1].T).astype(np.int64)
    starts = np.cumsum(m) - m
    x, i = x[~wide[x]], i[~wide[x]]
    many = m[x]
    ends = np.cumsum(many)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
        own = many[at:to]
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        flat = np.repeat(i[at:to] * len(right), own) + j[np.repeat(starts[x[at:to]], own) + step]
        out += np.bincount(flat, minlength=out.size).reshape(out.shape)
        at = to
    return out


def possible(left: dict[str, np.ndarray], right: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Which documents of left and right, by their components and sizes, could be linked and aren't joined yet."""
    n, m = left["n"], right["n"]
    return np.not_equal.outer(left["component"], right["component"]) & (100 * np.minimum.outer(n, m) >= percent * np.maximum.outer(n, m))


def hopeful(left: dict, right: dict, percent: int) -> np.ndarray:
    """The documents that share enough prefix tokens of the first order in this group for a link with one they meet.

    A pair's shared tokens lie in as many groups as the one of its documents in fewer groups at most, so one group holds at least that share of them.
    """
    shared = overlaps(left["own"], right["own"]) * np.minimum.outer(left["groups"], right["groups"])
    ok = possible(left, right, percent) & (shared >= needed(left["n"][:, None], right["n"][None], percent))
    return np.union1d(left["doc"][ok.any(1)], right["doc"][ok.any(0)])


def lacking(left: list[np.ndarray], right: list[np.ndarray], shared: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens at least of each prefix of left are in no way in each set of right, and the other way round: those before the end of the shorter-reaching prefix, less the shared ones.

    The prefixes are of the second order (up) or the third, ascending. Tokens may be parts of tokens: then fewer seem to lack, never more.
    """
    edge = [np.array([x[-1] if up else x[0] for x in side]) for side in (left, right)]
    within = np.minimum.outer(*edge) if up else np.maximum.outer(*edge)
    before = lambda x, at: np.searchsorted(x, at, "left") if up else len(x) - np.searchsorted(x, at, "right")
    one = np.stack([before(x, within[k]) for k, x in enumerate(left)])
    two = np.stack([before(x, within[:, k]) for k, x in enumerate(right)], 1)
    return np.maximum(one - shared, 0), np.maximum(two - shared, 0)


def agree(left: dict, right: dict, ok: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of those in ok may be linked by their prefixes of the second and the third order.

    Each order's prefixes share enough. Where a set's two prefixes have no token in common, what one lacks is not what the other does: both together are
    no more than a link leaves the set outside the overlap.
    """
    n, m = left["n"][:, None], right["n"][None]
    overlap = -(-percent * (n + m) // (100 + percent))
    lack = []
    for order in ("up", "down"):
        if not ok.any():
            return ok
        shared = overlaps(left[order], right[order])
        ok = ok & (shared >= needed(n, m, percent))
        lack.append(lacking(left[order], right[order], shared, order == "up"))
    for size, one, two in ((n, lack[0][0], lack[1][0]), (m, lack[0][1], lack[1][1])):
        apart = 2 * (size - -(-size * percent // 100) + 1) <= size
        ok = ok & (np.where(apart, one + two, np.maximum(one, two)) <= size - overlap)
    return ok


def agreeing(left: dict, right: dict, percent: int) -> np.ndarray:
    """The documents whose prefixes of the second and the third order allow for a link with one they meet; tokens by 32 bits, so that more may seem to be shared, never fewer."""
    ok = agree(left, right, possible(left, right, percent), percent)
    return np.union1d(left["doc"][ok.any(1)], right["doc"][ok.any(0)])


def joined(left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components that links between documents of left and right join, each with the least of those it is joined to."""
    for side in (left, right):
        side["up"], side["down"] = zip(*(ends(x, percent) for x in side["tokens"]), strict=True)
    ok = agree(left, right, possible(left, right, percent), percent)
    # Documents without a candidate left go out before whole sets are looked at.
    at = [np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))]
    ok = ok[np.ix_(*at)]
    if not ok.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = overlaps(*([x["tokens"][k] for k in own] for x, own in zip((left, right), at)))
    n, m = left["n"][at[0]][:, None], right["n"][at[1]][None]
    ok &= 100 * shared >= percent * (n + m - shared)
    x, y = np.nonzero(ok)
    names, both = np.unique(np.concatenate([left["component"][at[0][x]], right["component"][at[1][y]]]), return_inverse=True)
    x, y, label = both[: len(x)], both[len(x) :], np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == label).all():
            return names[label != np.arange(len(names))], names[label[label != np.arange(len(names))]]
        label = low


def _meetings(meet, columns: list[str]):
    """What meet(left, right) returns for each two pieces of a group, or a piece and itself, from rows (group, i, j, part, ...), with the group first; as a table of distinct rows."""

    def lists(name: str, column: pa.ChunkedArray) -> list[np.ndarray]:
        column = column.combine_chunks()
        if pa.types.is_binary(column.type):
            kind = np.uint32 if name in ("up", "down") else np.uint64
            return [np.frombuffer(x, kind).astype(np.uint64) for x in column.to_pylist()]
        stops, values = column.offsets.to_numpy().tolist(), column.values.to_numpy()
        return [values[a:b] for a, b in zip(stops, stops[1:])]

    def run(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy() for c in ("group", "i", "j")])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        cuts = np.flatnonzero((np.diff(keys, axis=1, prepend=keys[:, :1] - 1) != 0).any(0))
        plain = {c: table[c].to_numpy().astype(np.int64) for c in table.column_names if pa.types.is_integer(table[c].type)}
        listed = {c: lists(c, table[c]) for c in table.column_names if c not in plain}
        side = lambda at: {c: x[at] for c, x in plain.items()} | {c: [x[k] for k in at] for c, x in listed.items()}
        found = [np.empty((0, len(columns)), np.int64)]
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            at = order[a:b]
            component, part = plain["component"][at], plain["part"][at]
            if b - a < 2 or (component == component[0]).all():
                continue
            if keys[1, a] == keys[2, a]:
                left = right = side(at)
            else:
                left, right = side(at[part == part.min()]), side(at[part != part.min()])
            if len(right["doc"]):
                out = meet(left, right)
                found.append(np.stack(out if isinstance(out, tuple) else (np.full(len(out), keys[0, a]), out), 1))
        rows = np.unique(np.concatenate(found), axis=0)
        return pa.table({c: pa.array(rows[:, k], pa.int64()) for k, c in enumerate(columns)})

    return run


def dealt(members: DataFrame, weight, each: int, most: int | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """members (group, doc, component, ...) in pieces that meet: a row (i, j, part) for each meeting of a document, dealt to blocks of about TASK_BYTES and these to rounds; and the tables it reads.

    weight: a column, what a document takes of its piece beside DOC; each: bytes for a unit of it (a document has 1024 more). The commonest component's pieces are met by all other members and
    not by each other; the others' pieces meet each other and themselves. A large group's documents go to as many meetings as it has pieces, which grows with the square of its size:
    a round has as many of the blocks as ship COPIES rows a document and `most` bytes. Where most documents are members and their sets are long, COPIES rows a document alone would be several times the input.
    """
    sizes = members.groupBy("group", "component").agg(F.sum(weight + DOC).alias("size"))
    sizes = cut(sizes.groupBy("group").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("mains"), (F.sum("size") - F.max("size")).alias("others")).where("others > 0"))
    pieces = lambda c: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(c) / PIECE))
    unit = lambda i, j, part: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), part.cast("long").alias("part"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), pieces(c) - 1)
    own, mine = F.pmod(F.xxhash64("doc"), pieces("mains")), F.pmod(F.xxhash64("doc"), pieces("others"))
    meets = F.concat(F.transform(upto("mains"), lambda k: unit(F.lit(-1), k, F.lit(1))), F.transform(upto("others"), lambda k: unit(F.least(mine, k), F.greatest(mine, k), mine)))
    units = F.when(F.col("component") != F.col("main"), meets).otherwise(F.array(unit(F.lit(-1), own, F.lit(0))))
    met = cut(members.join(hinted(sizes), "group").withColumn("units", units).drop("main", "mains", "others"))
    total, shipped, copies, rows = met.agg(F.sum(F.size("units") * (weight * each + 1024)), F.sum(F.size("units") * (weight * each + 64)), F.sum(F.size("units")), F.count("*")).first()
    blocks, rounds = max(1, (total or 0) // TASK_BYTES), max(1, -(-(copies or 0) // max(1, COPIES * rows)), -(-(shipped or 0) // (most or max(1, shipped or 0))))
    names = [c for c in members.columns if c != "units"]
    out = met.select(*names, F.explode("units").alias("unit")).select(*names, "unit.*").withColumn("block", F.pmod(F.xxhash64("group", "i", "j"), F.lit(max(blocks, rounds))))
    return [out.where(F.pmod("block", F.lit(rounds)) == k) for k in range(rounds)], [sizes, met]


def meetings(members: DataFrame, weight, each: int, meet, columns: list[str], most: int | None = None, sets: DataFrame | None = None) -> DataFrame:
    """The distinct rows that meet(left, right) returns over all meetings of members, with columns of sets (doc, ...) beside theirs; round by round, of `most` bytes each, so that the disk that a shuffle takes
    grows with the documents, not with the meetings."""
    rounds, used = dealt(members, weight, each, most)
    found = []
    for units in rounds:
        # Sets are dealt by document and then to meetings at every size, whatever would fit a broadcast here.
        met = units if sets is None else units.drop("n").hint("merge").join(sets, "doc")
        found.append(cut(met.groupBy("block").applyInArrow(_meetings(meet, columns), ", ".join(f"{c} long" for c in columns)).distinct()))
        release(members.sparkSession)
    discard(*used)
    if len(found) == 1:
        return found[0]
    out = cut(reduce(lambda x, y: x.union(y), found).distinct())
    discard(*found)
    return out


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Words are runs other than space and \\t-\\r, A-Z lower-cased; a document is the set of its distinct shingles
    of `words` words, or its whole sequence as one if it has fewer. Documents link when 100 * |A & B| >= percent * |A | B|;
    component_id is the least id reachable. Null or blank texts have no shingles and link with nothing. Rows that
    repeat an id are versions of one document: a link of any of them counts, n_shingles is each row's own. Rows without an id match
    nothing and have a null component_id (but for copies of a text that has one). An empty table gives none. Other columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    seen = cut(docs.mapInArrow(_summaries(words), "kind byte, a long, mark long, b long, c long, n long"))
    rows = seen.where("kind = 0").select(F.col("a").alias("doc"), "mark", "b", "c", "n")
    heavy = seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(HEAVY_ALL).toArrow()
    tokens = heavy["a"].to_numpy().view(np.uint64)
    at = np.argsort(tokens)
    sent = spark.sparkContext.broadcast((tokens[at], heavy["n"].to_numpy()[at]))

    # Sets that several rows have are worked on once, as the least document that has them.
    classes = cut(rows.groupBy("b", "c", "n").agg(F.min("doc").alias("node"), F.count("*").alias("many")).where("many > 1").drop("many"))
    member = cut(rows.join(hinted(classes), ["b", "c", "n"], "left").select("doc", "mark", "n", F.coalesce("node", "doc").alias("node")))
    copies = cut(member.where("doc <> node").select("doc", "mark").distinct())
    release(spark)
    single = docs.where("doc is not null").join(hinted(copies), ["doc", "mark"], "left_anti").select("doc", "text")
    # A document with several versions is linked to the sets that stand for them.
    several = member.where("doc is not null").groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("nodes")).where("a <> b")
    versions = several.select("doc", F.explode("nodes").alias("node")).where("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b"))

    prefixes = single.mapInArrow(_prefixes(sent, words, percent), "token long, salt int, doc long, n int")
    # Each row gets its bucket's pivot, the least document, where its bucket is counted; those of buckets that were dealt out are few and joined.
    # By size a bucket falls into parts: where the next larger set is too large for a link, so are all after it. Of those that were dealt out no task sees all sizes.
    bucket = Window.partitionBy("token", "salt")
    shared = prefixes.withColumn("many", F.count("*").over(bucket)).where("many > 1 or salt > 0").drop("many")
    by_size = bucket.orderBy("n", "doc")
    gap = F.when((F.col("salt") == 0) & (F.lag("n").over(by_size) * F.lit(100).cast("long") < F.col("n") * F.lit(percent).cast("long")), 1).otherwise(0)
    part = shared.withColumn("gap", gap).withColumn("part", F.sum("gap").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("token", "salt", "part")
    shared = part.withColumns({"many": F.count("*").over(own), "pivot": F.min(F.struct("doc", "n")).over(own)}).where("many > 1 or salt > 0")
    buckets = cut(shared.select("token", "salt", "doc", "n", F.col("pivot.doc").alias("other"), F.col("pivot.n").alias("m")))
    release(spark)
    hot = cut(buckets.where("salt > 0").groupBy("token").agg(F.min(F.struct("other", "m")).alias("hot")))
    table = buckets.join(hinted(hot), "token", "left").select("token", "doc", "n", F.coalesce("hot.other", "other").alias("other"), F.coalesce("hot.m", "m").alias("m"))

    least = F.expr(f"greatest(1L, ({percent}L * (n + m) + {99 + percent}L) div {100 + percent}L - ({percent}L * greatest(n, m) + 99L) div 100L + 1L)")
    near = F.expr(f"100L * least(n, m) >= {percent}L * greatest(n, m)")
    tried = table.where("doc <> other").where(near).groupBy("doc", "n", "other", "m").count().where(F.col("count") >= least)
    pairs = cut(tried.groupBy("doc").agg(F.max_by("other", F.struct("count", "other")).alias("b")).withColumnRenamed("doc", "a"))

    # The pairs' prefixes in the other orders, then the whole sets of those that are left.
    wanted = cut(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct())
    sets = stored(single.join(hinted(wanted), "doc", "left_semi").select("doc", "text"), words, percent, "up", "down", "tokens")
    left, right = sets.select(F.col("doc").alias("a"), "n", "up", "down"), sets.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("up").alias("up2"), F.col("down").alias("down2"))
    agreed = cut(hinted(pairs).join(left, "a").join(right, "b").select("a", "b", "n", "m", "up", "up2", "down", "down2").mapInArrow(_agree(percent), "a long, b long"))
    pivots = cut(agreed.select("b").distinct())
    left, right = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("left")), sets.select(F.col("doc").alias("b"), F.col("tokens").alias("right")).join(hinted(pivots), "b", "left_semi")
    links = hinted(agreed).join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify(percent), "a long, b long")
    known = components(links.union(versions))
    discard(wanted, sets, agreed, pivots, pairs)
    release(spark)

    # Buckets whose pivots are in one component make a group. Groups of several components are left; their documents meet.
    of = lambda end, name: hinted(renamed(known, node=end, component=name))
    at = table.join(of("doc", "_own"), "doc", "left").join(of("other", "_group"), "other", "left")
    at = at.select("token", "doc", "n", F.coalesce("_own", "doc").alias("component"), F.coalesce("_group", "other").alias("group"))
    every = cut(at.groupBy("group", "doc", "component", "n").agg(F.collect_list("token").alias("own")))
    release(spark)
    mixed = cut(every.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group"))
    members = every.join(hinted(mixed), "group", "left_semi")
    groups = cut(members.groupBy("doc").agg(F.count("*").alias("groups")))
    most = max(ROUND_LEAST, ROUND * (member.agg(F.sum("n")).first()[0] or 0))
    alive = meetings(members.join(hinted(groups), "doc"), F.size("own"), 8, lambda x, y: hopeful(x, y, percent), ["group", "doc"], most)
    asked = cut(alive.select("doc").distinct())
    prefixed = stored(single.join(hinted(asked), "doc", "left_semi").select("doc", "text"), words, percent, "up", "down")
    left = cut(members.join(hinted(alive), ["group", "doc"], "left_semi").select("group", "doc", "component", "n"))
    # Prefixes of the second and third order meet before whole sets travel.
    able = meetings(left, F.col("n"), 3, lambda x, y: agreeing(x, y, percent), ["group", "doc"], most, prefixed)
    discard(prefixed)
    rest = cut(left.join(hinted(able), ["group", "doc"], "left_semi"))
    whole = cut(able.select("doc").distinct())
    sets = stored(single.join(hinted(whole), "doc", "left_semi").select("doc", "text"), words, percent, "tokens")
    links = meetings(rest, F.col("n"), 8, lambda x, y: joined(x, y, percent), ["a", "b"], most, sets)
    again = components(links)
    discard(every, mixed, groups, alive, asked, sets, left, able, rest, whole, links, buckets, hot, copies, classes, seen)
    release(spark)

    first, last = renamed(known, node="node", component="_one"), renamed(again, node="_one", component="_two")
    out = member.join(hinted(first), "node", "left").withColumn("_one", F.coalesce("_one", "node")).join(hinted(last), "_one", "left")
    component = F.when(F.col("n") > 0, F.coalesce("_two", "_one")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, whose document has the least id of its component.

    Of rows that repeat an id one stays (the first by text). Rows without an id, and those without words, all stay.
    """
    found = cut(ngram_components(docs, id_col, text_col, words, percent))
    dropped = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    release(docs.sparkSession)
    key, mark = unused("key", docs.columns), unused("first", docs.columns)
    gone, twice = renamed(dropped, doc_id=key), renamed(again, doc_id=key)
    stay = docs.withColumn(key, F.col(id_col).cast("long")).join(hinted(gone), key, "left_anti")
    if again.isEmpty():
        return stay.drop(key)
    order = Window.partitionBy(key).orderBy(F.col(text_col).asc_nulls_last())
    first = stay.join(hinted(twice), key, "left_semi").withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).drop(mark)
    return stay.join(hinted(twice), key, "left_anti").unionByName(first).drop(key)
