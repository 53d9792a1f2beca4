"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its
word shingles. Fingerprints are sent to the anchors of a cover, so that any two
that differ in few bits meet at one, and exact distances over all 64 bits are
taken anchor by anchor.

The first cover is made of the binary Golay code. Two fingerprints within 4 bits
agree to within one bit on at least one of three segments of 22, 21 and 21 bits.
Each segment, padded to 23 bits, is covered by the code: every point has exactly
one anchor within 3 bits (its home). A fingerprint is sent to all anchors within
3 + 1 bits of its segment, about 5.3 of 4,096, so that whoever has its home at an
anchor meets there every fingerprint within one bit on that segment.

12,288 anchors are few for a large corpus, and a cluster of near copies crowds a few
of them in any. So rows at an anchor of over MOST_ROWS leave it for a finer cover,
whose code is every word on some of the bits (radius 0, each point its own anchor):
64 bits in 6 parts, of which two fingerprints within 4 bits share 2 (15 pairs of
parts, anchors of 21 bits), and if that is still crowded, 8 parts that share 4 (70
choices, anchors of 32 bits). Links are the same whichever cover finds them, so a
corpus of any size compares a fingerprint with some thousands.

Equal fingerprints are one node from the start, and an anchor reports a
spanning forest of its links, never all pairs, so a group of n copies costs at
most n - 1 links an anchor. Components are found by distributed star steps.

`keep_first` is the stage for corpora: documents whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more. That is far in bits (about 10 of 64), so
anchors are words on randomly chosen bits, so many and so wide that a pair at the
limit meets with 98 % and a fingerprint with some hundreds of others. Of those, a
fingerprint of 128 bits leaves hardly any that are not alike (30 bits at most). What
is left is verified on the shingles of whole texts; only verified links count, so
documents that are merely alike stay. A row that is near to a few at an anchor has
them all verified. Of more, three are, which joins most clusters; then all pairs of
such crowded rows that are near and not in one group yet are verified, in blocks
that hold the shingles of CROWD_ROWS rows twice, so no pair that meets is left out.

Defined cases: a text without a word (or null) has fingerprint zero, linked
like any other; fewer words than a shingle make one shingle; a null doc_id is
a row of its own with a null component, and is always kept; rows with equal
doc_id are all returned, and kept or dropped each by its own text; a doc_id that
is no integer is refused; an empty table gives no rows. `near_duplicates` reads
doc_id and text only; `keep_first` carries all columns along, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, join_checked, slices, table, text_bytes
from .graph import components
from .substring import _mix

#: Fixed values of the contract.
SHINGLE = 4
SEED = 42
MAX_BITS = 4

#: Generator polynomial of the binary Golay code (23, 12), x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows that an anchor may have before they go to a finer cover.
MOST_ROWS = 8192
#: Rows from which an anchor is searched link by link, which is cheap where rows are close together.
PEEL_ROWS = 2048
COMPARE_BLOCK = 1 << 20

#: Of the stage: words of a shingle, the least similarity, and how many pairs at that limit should meet.
STAGE_SHINGLE, SIMILARITY, MEET = 5, 0.8, 0.98
#: Random fingerprints that one meets at each anchor of the stage, about.
COMPANY = 16
#: Near rows that a row has verified at an anchor at first, and rows of one side of a block in which crowded ones are verified.
FEW, CROWD_ROWS = 3, 512

#: Eight 8-bit lanes of one word, one for each bit of a byte, the highest bit in the first lane.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED, wide: bool = False) -> np.ndarray:
    """The 64-bit fingerprint of each UTF-8 text, A-Z lower-cased; if wide, 64 bits more, from the same hashes mixed once again, in a second column."""
    digest = xxhash.xxh64_digest
    parts, counts = [], []
    for raw in texts:
        words = raw.lower().split()
        n = len(words)
        if n <= shingle:
            parts.append(digest(b" ".join(words), seed) if n else b"")
            counts.append(min(n, 1))
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        first = [0, *(ends[: n - shingle] + 1).tolist()]
        parts.append(b"".join([digest(line[a:b], seed) for a, b in zip(first, ends[shingle - 1 :].tolist(), strict=True)]))
        counts.append(n - shingle + 1)
    hashes = np.frombuffer(b"".join(parts), ">u8")
    first = _majority(hashes, counts)
    return np.stack([first, _majority(_mix(hashes.astype(np.uint64)).astype(">u8"), counts)], axis=1) if wide else first


def _majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """For each text, the bits that are set in over half its hashes."""
    out = np.zeros(len(counts), np.uint64)
    rows = hashes.view(np.uint8).reshape(-1, 8)
    if len(rows):
        ends = np.cumsum(counts)
        full = np.flatnonzero(counts)  # texts with a hash
        starts = (ends - counts)[full]
        cuts = np.unique(np.concatenate([starts, np.arange(0, len(rows), 255)]))  # a lane holds up to 255
        lanes = np.add.reduceat(_LANES[rows], cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
        ones = np.add.reduceat(lanes.astype(np.int64), np.searchsorted(cuts, starts), axis=0)
        bits = ones * 2 > np.asarray(counts)[full][:, None]
        out[full] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def whole_ids(docs: DataFrame) -> None:
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("doc_id must be an integer")


def document_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, wide: bool = False) -> DataFrame:
    """doc_id, text_hash (which tells rows of one doc_id apart), fp (the fingerprint as a signed bigint) and, if wide, more."""
    whole_ids(docs)
    names = ["fp", "more"] if wide else ["fp"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            fp = fingerprints(list(text_bytes(batch.column("text"))), shingle, seed, wide).view(np.int64).reshape(batch.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x) for x in fp.T.copy())], ["doc_id", "text_hash", *names])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return read.mapInArrow(measure, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in names))


class Golay:
    """The Golay code as lookups: a syndrome for each point, and the error patterns of weight 4 at most for each syndrome."""

    def __init__(self, reach: int):
        self.low, self.high = (np.array([self._rest(x << at) for x in range(1 << width)], dtype=np.int64) for at, width in ((0, 12), (12, 11)))
        errors = np.array([sum(1 << i for i in c) for w in range(reach + 1) for c in combinations(range(23), w)], dtype=np.int64)
        weights = np.bitwise_count(errors)
        order = np.lexsort((errors, self.syndrome(errors)))
        self.errors, self.weights = errors[order], weights[order]
        self.first = np.searchsorted(self.syndrome(self.errors), np.arange(2049))

    @staticmethod
    def _rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    def syndrome(self, points: np.ndarray) -> np.ndarray:
        return self.low[points & 4095] ^ self.high[points >> 12]

    def near(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all anchors in reach: the point's index, the anchor (a 12-bit number) and whether it is the point's home."""
        s = self.syndrome(points)
        count = self.first[s + 1] - self.first[s]
        index = np.repeat(np.arange(len(points)), count)
        at = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count) + self.first[s][index]
        return index, (points[index] ^ self.errors[at]) >> 11, self.weights[at] <= 3


#: What a cover is to a task: for some fingerprints, batches of (index, anchor, home).
Cover = Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def golay_cover(max_bits: int) -> Cover:
    def place(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        code = Golay(3 + max_bits // len(SEGMENTS))
        for k, (first, width) in enumerate(SEGMENTS):
            points = ((fp >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
            index, anchor, home = code.near(points)
            yield index, anchor + (k << 12), home

    return place


def bits_cover(choices: list[list[int]]) -> Cover:
    """An anchor for every value of the bits of each choice."""

    def place(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        everyone, home = np.arange(len(fp)), np.ones(len(fp), bool)
        for k, bits in enumerate(choices):
            anchor = np.zeros(len(fp), np.int64)
            for j, b in enumerate(bits):
                anchor |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
            yield everyone, anchor + (k << 44), home

    return place


def parts_cover(max_bits: int, shared: int) -> Cover:
    """64 bits in max_bits + shared parts: whoever is within max_bits has `shared` parts in common."""
    parts = np.array_split(np.arange(64), max_bits + shared)
    return bits_cover([np.concatenate(c).tolist() for c in combinations(parts, shared)])


def random_bits(width: int, tables: int) -> list[list[int]]:
    return [np.random.default_rng(k).permutation(64)[:width].tolist() for k in range(tables)]


def random_cover(width: int, tables: int) -> Cover:
    return bits_cover(random_bits(width, tables))


def anchored(nodes: DataFrame, cover: Cover) -> DataFrame:
    """nodes (fp, node and other bigint columns) at all their anchors: anchor, home and the columns of nodes."""
    names = nodes.columns

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                columns = [part.column(n).to_numpy() for n in names]
                for index, anchor, home in cover(part.column("fp").to_numpy().view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(home), *(pa.array(c[index]) for c in columns)], ["anchor", "home", *names])

    return nodes.mapInArrow(replicate, "anchor long, home boolean, " + ", ".join(f"{n} long" for n in names))


def anchor_links(fp: np.ndarray, node: np.ndarray, home: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows that are at home at an anchor and all rows there."""
    if len(fp) >= PEEL_ROWS:
        return peel_links(fp, node, max_bits)
    homes, label, links = np.flatnonzero(home), np.arange(len(fp)), []
    fp = fp.view(np.uint64)  # bits of signed numbers would be counted without the sign
    step = max(1, COMPARE_BLOCK // max(1, len(fp)))
    for at in range(0, len(homes), step):
        mine = homes[at : at + step]
        close = np.bitwise_count(fp[mine][:, None] ^ fp[None, :]) <= max_bits
        for k in np.flatnonzero(close.sum(axis=1) > 1):
            met = label[close[k]]
            if (met == met[0]).all():
                continue
            roots = np.unique(met)
            links += [(int(node[r]), int(node[roots[0]])) for r in roots[1:]]
            label[np.isin(label, roots[1:])] = roots[0]
    return links


def peel_links(fp: np.ndarray, node: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of all links, found from row to row: what was reached is not compared again, so a cluster costs its rows a few times."""
    fp, left, links = fp.view(np.uint64), np.arange(len(fp)), []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            step = max(1, COMPARE_BLOCK // len(left))
            now, wave = wave[:step], wave[step:]
            close = np.bitwise_count(fp[now][:, None] ^ fp[left][None, :]) <= max_bits
            reached = close.any(axis=0)
            links += zip(node[left[reached]].tolist(), node[now[close[:, reached].argmax(axis=0)]].tolist(), strict=True)
            wave, left = np.concatenate([wave, left[reached]]), left[~reached]
    return links


def by_anchor(found: DataFrame, names: tuple[str, ...], search: Callable[..., list[tuple]], out: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """What search finds in the columns `names` of each anchor: rows of the bigint columns `out`, as links a, b. Rows come sorted by anchor, and an anchor is searched when its last row has come."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def settle(found: pa.Table) -> pa.RecordBatch:
            anchor = found.column("anchor").to_numpy()
            columns = [found.column(n).to_numpy() for n in names]
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            links = [x for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for x in search(*(c[a:b] for c in columns))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(len(out))], list(out))

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            if waiting and waiting[-1].column("anchor")[-1].as_py() == anchor[0] == anchor[-1]:
                waiting.append(batch)
                continue
            last = int(np.searchsorted(anchor, anchor[-1]))
            head = [*waiting, batch.slice(0, last)]
            if any(x.num_rows for x in head):
                yield settle(pa.Table.from_batches(head))
            waiting = [batch.slice(last)]
        if waiting:
            yield settle(pa.Table.from_batches(waiting))

    return found.repartition("anchor").sortWithinPartitions("anchor", "node").mapInArrow(compare, ", ".join(f"{n} long" for n in out))


def links_within(nodes: DataFrame, max_bits: int = MAX_BITS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Links a, b that connect all nodes (fp, node; cut before) within max_bits of each other.

    Cover after cover: anchors of over most_rows give their rows to the next, the
    last takes what comes.
    """
    covers = [golay_cover(max_bits), parts_cover(max_bits, 2), parts_cover(max_bits, 4)]
    search, found = (lambda fp, node, home: anchor_links(fp, node, home, max_bits)), None
    for k, cover in enumerate(covers):
        placed = anchored(nodes.select("fp", "node"), cover)
        crowded = None
        if k + 1 < len(covers):
            sizes = cut(placed.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).select("anchor"))
            if sizes.head():
                crowded = cut(join_checked(placed, sizes, ["anchor"], "left_semi").select("fp", "node").distinct())
                placed = join_checked(placed, sizes, ["anchor"], "left_anti")
        links = by_anchor(placed, ("fp", "node", "home"), search)
        found = links if found is None else found.unionByName(links)
        if crowded is None:
            break
        nodes = crowded
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    found = cut(document_fingerprints(docs, shingle, seed).drop("text_hash"))
    nodes = cut(found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    met = components(links_within(nodes, max_bits, most_rows))
    named = nodes.join(met, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(named, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# the stage


def stage_shape(count: int, similarity: float = SIMILARITY, meet: float = MEET, company: int = COMPANY) -> tuple[int, int, int]:
    """Bits of an anchor, how many choices of bits, and the most bits of 128 that fingerprints may differ in.

    Sets of one size and Jaccard similarity s have the cosine 2s / (1 + s), and each
    bit differs with its angle's share of a half turn.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = min(40, max(8, math.ceil(math.log2(max(2, count) / company))))
    tables = math.ceil(math.log(1 - meet) / math.log(1 - (1 - apart) ** width))
    return width, tables, math.ceil(128 * apart + 2.5 * math.sqrt(128 * apart * (1 - apart)))


def bits_apart(both: tuple[np.ndarray, np.ndarray], mine: np.ndarray | slice, among: np.ndarray | slice) -> np.ndarray:
    return sum(np.bitwise_count(x[mine][:, None] ^ x[among][None, :]) for x in both)


def candidate_links(fp: np.ndarray, more: np.ndarray, node: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """For each row with others within max_bits of its 128: all of them, if they are FEW at most. Of more the nearest, the one with the smallest node and the one that most rows are near to, and a link to itself, which says that others are left (`crowd_links` has those).

    A cluster hangs together by what its rows were copied from, which most of them
    are near to, so that hardly any of the others still has to be looked at.
    """
    both, out = (fp.view(np.uint64), more.view(np.uint64)), set()
    everyone, near = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    step = max(1, COMPARE_BLOCK // len(fp))
    for at in range(0, len(fp), step):
        near[at : at + step] = (bits_apart(both, everyone[at : at + step], everyone) <= max_bits).sum(axis=1)
    some = np.flatnonzero(near > 1)
    step = max(1, COMPARE_BLOCK // max(1, len(some)))
    for at in range(0, len(some), step):
        mine = some[at : at + step]
        bits = bits_apart(both, mine, some)
        bits[np.arange(len(mine)), np.arange(at, at + len(mine))] = 255
        close = bits <= max_bits
        few = near[mine] <= FEW + 1
        a, b = np.nonzero(close & few[:, None])
        pairs = [(node[mine[a]], node[some[b]]), (node[mine[~few]], node[mine[~few]])]
        best = [bits.argmin(axis=1), np.where(close, node[some][None, :], np.iinfo(np.int64).max).argmin(axis=1), np.where(close, near[some][None, :], -1).argmax(axis=1)]
        pairs += [(node[mine[~few]], node[some[b[~few]]]) for b in best]
        for a, b in pairs:
            out.update(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True))
    return sorted(out)


def shingle_set(raw: bytes, shingle: int) -> frozenset[int]:
    words = raw.lower().split()
    if not words:
        return frozenset()
    return frozenset(xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1)))


def verified(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links a, b (distinct) whose texts (node, text) have that Jaccard similarity of shingle sets or more."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, frozenset()
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True):
                if b != last:
                    last, mine = b, shingle_set(y, shingle)
                other = shingle_set(x, shingle)
                shared = len(mine & other)
                if shared >= similarity * (len(mine) + len(other) - shared):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    of = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    both = links.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return both.sortWithinPartitions("b").mapInArrow(judge, "a long, b long")


def undecided(fp: np.ndarray, more: np.ndarray, comp: np.ndarray, mine: slice, among: slice, anchor: int, masks: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (places in mine and in among) within max_bits, in different components, that share no earlier anchor."""
    i, j = np.nonzero((bits_apart((fp, more), mine, among) <= max_bits) & (comp[mine][:, None] != comp[among][None, :]))
    for mask in masks[: anchor >> 44]:
        later = (fp[mine][i] ^ fp[among][j]) & mask != 0
        i, j = i[later], j[later]
    return i, j


def crowd_links(crowded: DataFrame, texts: DataFrame, width: int, tables: int, max_bits: int, shingle: int, similarity: float, rows_of_block: int = CROWD_ROWS) -> DataFrame:
    """Links a, b of components: all that pairs of crowded rows (fp, more, node, comp) in different ones give, if they meet within max_bits and their texts (node, text) are verified.

    A pair counts at the first anchor that it shares. An anchor's rows are dealt into
    parts, and each two parts are a block, so a task holds some hundreds of rows
    however many meet. A pair that was linked meanwhile is skipped.
    """
    bits = random_bits(width, tables)
    masks = np.array([sum(1 << b for b in chosen) for chosen in bits], np.uint64)

    def gather(anchor: np.ndarray, fp: np.ndarray, more: np.ndarray, node: np.ndarray, comp: np.ndarray) -> list[tuple]:
        fp, more, open_ = fp.view(np.uint64), more.view(np.uint64), np.zeros(len(fp), bool)
        step = max(1, COMPARE_BLOCK // len(fp))
        for at in range(0, len(fp), step):
            i, j = undecided(fp, more, comp, slice(at, at + step), slice(None), int(anchor[0]), masks, max_bits)
            open_[i + at] = open_[j] = True
        left = node[open_].tolist()
        return [(int(anchor[0]), n, k // rows_of_block, -(-len(left) // rows_of_block)) for k, n in enumerate(left)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.fromiter(shingle_set(t, shingle), np.uint64).tobytes() for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    def judge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("node", "ascending")])
        anchor, part, comp = rows.column("anchor")[0].as_py(), rows.column("part").to_numpy(), rows.column("comp").to_numpy()
        fp, more = (rows.column(n).to_numpy().view(np.uint64) for n in ("fp", "more"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        known, code = np.unique(np.concatenate(sets), return_inverse=True)
        code = np.split(code, np.cumsum(size)[:-1])
        mark, label, out = np.zeros(len(known), np.int64), comp.copy(), []
        half = int(np.searchsorted(part, part[0], "right"))
        inner = half == len(part)
        for at in range(half):
            i, j = undecided(fp, more, comp, slice(at, at + 1), slice(at + 1, None) if inner else slice(half, None), anchor, masks, max_bits)
            j = j + (at + 1 if inner else half)
            small, large = np.minimum(size[at], size[j]), np.maximum(size[at], size[j])
            j = j[(small >= similarity * large) & (small > 0) & (label[j] != label[at])]
            if not len(j):
                continue
            mark[code[at]] = 1
            shared = np.add.reduceat(mark[np.concatenate([code[k] for k in j])], np.cumsum(size[j]) - size[j])
            mark[code[at]] = 0
            for k in j[shared >= similarity * (size[at] + size[j] - shared)]:
                if label[k] != label[at]:
                    out.append((max(comp[k], comp[at]), min(comp[k], comp[at])))
                    label[label == label[k]] = label[at]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    placed = anchored(crowded.select("fp", "more", "node", "comp"), bits_cover(bits)).drop("home")
    found = cut(by_anchor(placed, ("anchor", "fp", "more", "node", "comp"), gather, ("anchor", "node", "part", "parts")))
    sets = texts.join(found.select("node").distinct(), "node", "left_semi").mapInArrow(measure, "node long, shingles binary")
    held = cut(crowded.join(sets, "node"))
    other = found.select("*", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("other"))
    dealt = other.select("anchor", "node", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two")).join(held, "node")
    return dealt.groupBy("anchor", "one", "two").applyInArrow(judge, "a long, b long").distinct()


def similar_documents(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY, seed: int = SEED, rows_of_block: int = CROWD_ROWS) -> DataFrame:
    """doc_id, text_hash and component_id of every row of docs that has a doc_id: documents linked by a verified similarity."""
    found = cut(document_fingerprints(docs, shingle, seed, wide=True).filter("doc_id is not null"))
    nodes = cut(found.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash", "more")).alias("r")).select("fp", "r.more", F.col("r.doc_id").alias("node"), "r.text_hash"))
    width, tables, max_bits = stage_shape(nodes.count(), similarity)
    placed = anchored(nodes.select("fp", "more", "node"), random_cover(width, tables)).drop("home")
    links = cut(by_anchor(placed, ("fp", "more", "node"), lambda fp, more, node: candidate_links(fp, more, node, max_bits)).distinct())
    asked = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("node"), F.xxhash64("text").alias("text_hash"), "text")
    texts = cut(join_checked(keyed, asked, ["node", "text_hash"], "left_semi").dropDuplicates(["node", "text_hash"]).select("node", "text"))
    met = components(verified(links.filter("a <> b"), texts, shingle, similarity))
    named = nodes.join(met, "node", "left").select("fp", "more", "node", F.coalesce("component", "node").alias("comp"))
    crowded = cut(named.join(links.filter("a = b").select(F.col("a").alias("node")), "node", "left_semi"))
    if crowded.head():
        joined = components(crowd_links(crowded, texts, width, tables, max_bits, shingle, similarity, rows_of_block))
        named = named.join(joined.select(F.col("node").alias("comp"), "component"), "comp", "left").withColumn("comp", F.coalesce("component", "comp"))
    return found.join(named.select("fp", F.col("comp").alias("component_id")), "fp").select("doc_id", "text_hash", "component_id")


def keep_first(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id is the smallest of its group of similar documents (and those without a doc_id)."""
    gone = similar_documents(docs, shingle, similarity).filter("doc_id <> component_id")
    name = fresh(docs, "text_hash")
    gone = cut(gone.select(F.col("doc_id"), F.col("text_hash").alias(name)).distinct())
    kept = join_checked(docs.withColumn(name, F.xxhash64("text")), gone, ["doc_id", name], "left_anti")
    return kept.select(*docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
