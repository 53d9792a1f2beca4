"""Bounded-space online best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised whole and end with one closing id. Only documents over
the capacity are cut, into full pieces and one shorter rest. Pieces are dealt by
hash to shards and arrive there in hash order, one after the other: each goes
into the fullest open bin that still has room, for good. The open bins' free
spaces are kept as a bitset (bit f: some open bin has f tokens free), so the best
bin is one shift and one lowest-bit step. At most `open_bins` are open; when
another is needed, the fullest closes.

Packing sees a piece once and remembers the open bins only, so a shard may have
any number of pieces. Measured on 21,725 pieces of 20,000 documents of check_s,
one shard: 6,228 sequences where the tokens alone need 6,197 (0.5 % more), the
same with 64 open bins as with 4,096. Sorting a shard by length first would
reach 6,197, but that is no longer online.

Defined cases: a null or empty text is the closing id alone; rows that share a
doc_id, repeated rows and rows without one are packed as documents of their own;
an empty table gives no rows. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import secrets
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, slices, table, text_bytes
from .substring import _SPACE, _words

#: Fixed values of the contract.
CAPACITY = 4096
END_ID = 1

OPEN_BINS = 64
SHARD_BYTES = 24 << 20
#: Tasks that shards are dealt to at most; a task packs its shards one after the other.
MOST_TASKS = 20_000
#: Words whose ids a worker remembers at once; only speed depends on it.
CACHE_WORDS = 1_000_000
#: ASCII punctuation that the tokeniser always separates from a letter before it.
TAIL = b".,;:!?)|"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary's rules never join tokens across ASCII white space, and they
    lower-case, so the ids of a text are those of its lower-cased words one after
    the other. Distinct words are told apart by 64-bit hashes with a seed of this
    process; a worker remembers the ids of words that it met of late, as arrays.
    Texts that may hold a special token's name, which is case-sensitive, go to the
    tokeniser whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_unit = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_unit[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        tails = self._encode([bytes([c]) for c in TAIL])
        self.tail = {c: int(x[0]) for c, x in zip(TAIL, tails, strict=True) if len(x) == 1}
        self.seed, self.turn = secrets.randbits(63), 0
        self.hashes, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of known words, ascending; when each was last met
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has.

        Words of letters only are one unit each to the tokeniser, so many are encoded
        as one line; punctuation right after the last letter is a unit of its own.
        """
        ids: list = [None] * len(words)
        lines, other = [], []
        for i, w in enumerate(words):
            tail = self.tail.get(w[-1]) if len(w) > 1 and w[-2] in _LETTERS else None
            stem = w if tail is None else w[:-1]
            (lines if stem.decode().isalpha() else other).append((i, stem, tail))
        for at in range(0, len(lines), 1000):
            part = lines[at : at + 1000]
            (found,) = self._encode([b" ".join([stem for _, stem, _ in part])])
            ends = np.flatnonzero(self.ends_unit[found]) + 1
            if len(ends) != len(part) or ends[-1] != len(found):  # this tokeniser sees other letters than Python, or marks no ends
                other += part
                continue
            raw, cuts = found.tobytes(), [0, *(4 * ends).tolist()]
            for (i, _, tail), a, b in zip(part, cuts, cuts[1:], strict=False):
                ids[i] = raw[a:b] if tail is None else raw[a:b] + tail.to_bytes(4, "little")
        for (i, _, _), found in zip(other, self._encode([words[i] for i, _, _ in other]), strict=True):
            ids[i] = found.tobytes()
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def _known(self, hashes: np.ndarray, word: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """The places of distinct words (ascending hashes) among the known ones; word gives those of some of them, to learn."""
        self.turn += 1
        if len(self.hashes) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        there = at < len(self.hashes)
        there[there] = self.hashes[at[there]] == hashes[there]
        missing = np.flatnonzero(~there)
        if len(missing):
            ids, size = self._encode_words(word(missing))
            start = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids])
            self.hashes, self.start, self.size, self.used = (np.insert(x, at[missing], new) for x, new in ((self.hashes, hashes[missing]), (self.start, start), (self.size, size), (self.used, self.turn)))
            at = np.searchsorted(self.hashes, hashes)
        self.used[at] = self.turn
        return at

    def _forget(self) -> None:
        """Keeps the half of the words that were met last."""
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        self.hashes, self.used, start, self.size = (x[keep] for x in (self.hashes, self.used, self.start, self.size))
        ends = np.cumsum(self.size)
        self.start = ends - self.size
        self.ids = self.ids[np.repeat(start - self.start, self.size) + np.arange(self.size.sum())]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        special = [b"<|" in x for x in texts]
        plain = [b"" if s else x.lower() for x, s in zip(texts, special, strict=True)]
        blob = b"\n".join(plain) + b" " * 8
        raw = np.frombuffer(blob, np.uint8)
        edge = np.flatnonzero(np.diff((~_SPACE[raw]).view(np.int8), prepend=0, append=0))
        first, end = edge[::2], edge[1::2]
        hashes, at, word = np.unique(_words(raw, first, end, self.seed), return_index=True, return_inverse=True)
        place = self._known(hashes, lambda some: [blob[a:b] for a, b in zip(first[at[some]].tolist(), end[at[some]].tolist(), strict=True)])
        size, start = self.size[place][word], self.start[place][word]
        ends = np.cumsum(size)
        every = self.ids[np.repeat(start - (ends - size), size) + np.arange(size.sum())].tobytes()
        stops = np.concatenate([[0], ends])[np.searchsorted(first, np.cumsum([len(x) + 1 for x in plain]))] * 4
        whole = iter(self._encode([x for x, s in zip(texts, special, strict=True) if s]))
        cuts = [0, *stops.tolist()]
        return [next(whole).tobytes() if s else every[a:b] for s, a, b in zip(special, cuts, cuts[1:], strict=False)]


def worker_tokenizer(definition: str) -> WordTokenizer:
    """One tokeniser for each Python worker, kept from task to task."""
    kept = sys.modules.setdefault("worker_tokenizers", types.ModuleType("worker_tokenizers")).__dict__
    key = f"{zlib.crc32(definition.encode())}-{len(definition)}"
    if key not in kept:
        kept[key] = WordTokenizer(definition)
    return kept[key]


def tokenize(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian 32-bit) of every piece."""
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text())
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(definition.value)
        for batch in slices(batches, "text", 2 << 20):
            rows: list[list] = [[], [], [], [], [], []]
            ids = encode(list(text_bytes(batch.column("text"))))
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(x)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = len(kinds) - (not keep_ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows[:n], kinds[:n], strict=True)], names[:n])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class Bins:
    """The open bins of one shard. used: tokens of each open bin; bits: which free spaces there are; at_free: the open bins of each free space."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.count, self.opened = 0, 0, 0
        self.at_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.at_free[free]
        b = bins.pop()
        if not bins:
            del self.at_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset of a piece that arrives now."""
        if room := self.bits >> length:
            free = length + (room & -room).bit_length() - 1
            b = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, b = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.at_free.setdefault(left, []).append(b)
            self.bits |= 1 << left
            self.count += 1
        return b, self.capacity - free


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """The bin and the offset of each length, in the order given."""
    bins = Bins(capacity, open_bins)
    places = [bins.place(x) for x in lengths]
    return [b for b, _ in places], [o for _, o in places]


def pack(pieces: DataFrame, shards: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces with sequence_id and offset. Pieces of a shard pass one task in hash order; what it keeps of them are the open bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, Bins(capacity, open_bins)
        for batch in batches:
            sequence, offset = [], []
            for s, length in zip(batch.column("_shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if s != shard:
                    shard, bins = s, Bins(capacity, open_bins)
                b, at = bins.place(length)
                sequence.append((s << 32) + b)
                offset.append(at)
            kept = batch.select([n for n in batch.schema.names if n not in ("_shard", "_arrival")])
            yield kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    arrival = F.xxhash64("doc_id", "piece", "ids_crc32")  # with the ids, so that rows without a doc_id are spread
    dealt = pieces.withColumns({"_arrival": arrival, "_shard": F.pmod(arrival, F.lit(shards))})
    ordered = dealt.repartition(min(shards, MOST_TASKS), "_shard").sortWithinPartitions("_shard", "_arrival", "doc_id", "piece")
    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ordered.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, shard_bytes: int = SHARD_BYTES, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (ids too if asked)."""
    return pack(tokenize(docs, tokenizer_file, capacity, end_id, keep_ids), block_count(docs, "text", shard_bytes), capacity, open_bins)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
