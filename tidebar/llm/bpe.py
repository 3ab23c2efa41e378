"""BPE encoding and decoding with a published vocabulary file (lower case, word-end marks).

Each word is a doubly linked list of symbols; a heap holds the ranks of adjacent pairs. Popping a pair whose symbols
have changed since it was pushed is skipped; else the right symbol joins the left one and the two new pairs are pushed.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches

#: Runs and words whose encoding a worker remembers at most.
REMEMBERED = 400_000
#: Fixed value: Unicode's white space.
BLANKS = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    rest = [b for b in range(256) if b not in out]
    return [out.get(b) or chr(256 + rest.index(b)) for b in range(256)]


class Bpe(dict):
    """Maps runs without blanks to their encoding, working it out where it isn't remembered."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.rules = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges]
        self.ranks = {rule[:2]: rank for rank, rule in enumerate(self.rules)}
        self.symbols = byte_symbols()
        self.strings = {str(i): x for x, i in (self.vocab | self.special).items()}
        self.words: dict[str, str] = {}

    def normal(self, text: str) -> str:
        """NFC, blanks to one space, lower case by code point (a capital sigma is no final one)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return BLANKS.sub(" ", text).lower()

    def word(self, word: str) -> list[int]:
        marks = [self.symbols[b] for b in word.encode()]
        marks[-1] += self.end
        ids = [i for i in map(self.vocab.get, marks) if i is not None]
        n, ranks, rules = len(ids), self.ranks, self.rules
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        # An entry is rank * n + position: the rank names the pair and what it becomes.
        heap = [rank * n + i for i, pair in enumerate(zip(ids, ids[1:])) if (rank := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            a, b, both = rules[rank]
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two has been joined meanwhile
            ids[i], ids[j], after = both, -1, right[j]
            right[i] = after
            if after >= 0:
                left[after] = i
                if (rank := ranks.get((both, ids[after]))) is not None:
                    heapq.heappush(heap, rank * n + i)
            before = left[i]
            if before >= 0 and (rank := ranks.get((ids[before], both))) is not None:
                heapq.heappush(heap, rank * n + before)
        return [x for x in ids if x >= 0]

    def __missing__(self, run: str) -> tuple[int, str]:
        """The number of tokens and the ids, joined by spaces, of a run without blanks."""
        ids: list[str] = []
        for piece in self.pieces.findall(run):
            if (own := self.words.get(piece)) is None:
                own = " ".join(map(str, self.word(piece)))
                if len(piece) <= 32:
                    if len(self.words) >= REMEMBERED:
                        self.words.clear()
                    self.words[piece] = own
            if own:
                ids.append(own)
        found = (sum(x.count(" ") + 1 for x in ids), " ".join(ids))
        if len(run) <= 32:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = found
        return found

    def encode(self, text: str) -> tuple[int, str]:
        """The number of tokens and the ids, joined by spaces."""
        found: list[tuple[int, str]] = []
        for part in self.cut.split(text) if self.special and "<|" in text else [text]:
            if part in self.special:
                found.append((1, str(self.special[part])))
            else:
                found += map(self.__getitem__, self.normal(part).split(" "))
        return sum([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])

    def decode(self, ids: str) -> str:
        return " ".join(map(self.strings.__getitem__, ids.split(" "))) if ids else ""


@lru_cache(2)
def loaded(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


def _coder(spec, decode_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch, texts in chunks(batches):
            coded = [bpe.encode(x.decode()) for x in texts]
            ids = [x[1] for x in coded]
            fields = {"doc_id": batch.column(0), "n_tokens": pa.array([x[0] for x in coded], pa.int64())}
            if decode_too:
                fields |= {"ids_sha256": pa.array([sha256(x.encode()).hexdigest() for x in ids]), "decoded_sha256": pa.array([sha256(bpe.decode(x).encode()).hexdigest() for x in ids])}
            else:
                fields |= {"ids": pa.array([[int(y) for y in x.split()] for x in ids], pa.list_(pa.int32())), "decoded": pa.array([bpe.decode(x) for x in ids])}
            yield pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or SHA-256 digests of the last two: a row for each row of docs.

    vocabulary is the path of a tokenizer file, read once by the driver (a fixed size) and sent to the tasks. Null and empty texts have no
    tokens and decode to the empty string; the strings of special tokens in a text are those tokens, as in the tokenizers library. Texts of any
    length are coded word by word; ids and other columns are not looked at, so repeated rows give repeated results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_coder(spec, digests), f"doc_id {kind}, n_tokens long, {out}")
