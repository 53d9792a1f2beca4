"""Substring dedup by prefix-partitioned suffix trees, cut at the window and with hashed labels.

Every word suffix of every document that is at least a window long (13 words)
belongs to one memory-sized group, chosen by a prefix of variable length: its
first word where few suffixes start so, else its first two words, else three, 4, 6,
8, and last the whole window. Prefixes are counted level by level over the whole
corpus, in tables of hashed slots whose number follows the corpus, and a level
counts only suffixes whose shorter prefix was too frequent; slots are put together
into groups of about `group_suffixes`. A whole window that is too frequent goes by
more of its hash, so what is left together is one window at worst, which has one
leaf a block.

In a group, suffixes cut at the window are the leaves of a suffix tree. A leaf is a
64-bit path: 8 bits of its first four words, 8 of its first eight, 48 of the whole
window, all below the prefix that chose the group. Sorted paths are the leaves in
the tree's order; the longest common prefix of neighbours (nothing, 4 or 8 words,
or the window) gives the inner nodes. The leaves below a node as deep as the window
are the occurrences of one repeat, and those outside its smallest document are
reported back to their document's block. Consecutive reported windows join to
maximal repeats, of any length.

That is less than a suffix tree of plain words: nodes are known at those depths
only, and equal hashes stand for equal words. Suffixes with all their words would
be over three times as long as the paths, and the shuffle, at 3 times the input as
it is, over 6. Hashes are not polynomial and their seed is drawn anew for every
run, so no text is built to collide: two windows of one group with no eight words
in common agree with a probability of 2**-64, others of 2**-48.

Documents are shuffled once, by block. A block sends one leaf for each of its
distinct windows (the block's smallest document) and settles repeats inside the
block itself; so a passage that a third of all documents share sends one leaf a
block to its group.

Defined cases: a null or empty text has no words; a null doc_id counts as
larger than any other; rows that share a doc_id do not remove each other's
words; texts shorter than a window keep all words; an empty table gives no
rows; a doc_id that is no integer is refused. Extra columns are carried along by
`remove_repeats` and may have any names but those it adds, which replace them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, block_of, fresh, slices, table, text_bytes

#: Fixed value of the contract.
WINDOW = 13

#: Prefix lengths that choose a group, before the whole window.
PREFIXES = (1, 2, 3, 4, 6, 8)
#: Depths below the window that a path knows, and the bits of each.
DEPTHS, DEPTH_BITS = (4, 8), 8
GROUP_SUFFIXES = 1 << 20
#: A group is larger than GROUP_SUFFIXES where the corpus would have more groups than this.
MOST_GROUPS = 1 << 19
LEAST_SLOTS = 1 << 13
BLOCK_BYTES = 4 << 20
HASH_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 256

_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NEVER = np.iinfo(np.int64).max
#: Of up to eight bytes read as one number, those that belong to a word.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of pairs in order; what it takes from both is mixed, so hashes of hashes have no structure."""
    return _mix(x + y * _ODD[1])


def _words(raw: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each range of raw, which has eight bytes more than any range needs; eight bytes at a time."""
    lanes = np.ndarray(len(raw) - 7, "<u8", raw.tobytes(), strides=(1,))
    size = end - first
    h = _mix((lanes[first] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD[0] + np.uint64(seed))
    more, lane = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        left = size[more] - lane
        h[more] = _ordered(h[more], _mix(lanes[first[more] + lane] & _MASK[np.minimum(left, 8)]))
        more, lane = more[left > 8], lane + 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(raw[first[i] : end[i]].tobytes(), seed)
    return h


def word_hashes(texts: list[bytes], seed: int = 0, most: int = HASH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and its text's number; works on `most` bytes at a time, one text at least."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends, hashes, docs = np.cumsum(size), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(texts):
        done = ends[at] - size[at]
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        raw = np.frombuffer(b"\n".join(texts[at:stop]) + b" " * 8, np.uint8)
        edge = np.flatnonzero(np.diff((~_SPACE[raw]).view(np.int8), prepend=0, append=0))
        first, end = edge[::2], edge[1::2]
        hashes.append(_words(raw, first, end, seed))
        docs.append(at + np.searchsorted(ends[at:stop] - done, first, "right"))
        at = stop
    return np.concatenate(hashes), np.concatenate(docs)


class Suffixes:
    """The words of some texts, and the suffixes that are at least a window long.

    at: the suffixes' first words, counted through all texts; doc: their texts'
    numbers; word_doc: the text of each word.
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW, seed: int = 0):
        self.window = window
        words, self.word_doc = word_hashes(texts, seed)
        n = max(0, len(words) - window + 1)
        self.at = np.flatnonzero(self.word_doc[:n] == self.word_doc[window - 1 :][:n])
        self.doc = self.word_doc[self.at]
        self._all = {1: words}

    def _runs(self, length: int) -> np.ndarray:
        """The hash of the `length` words from each word on, across texts too."""
        if length not in self._all:
            low = 1 << (length.bit_length() - 1)
            low = low // 2 if low == length else low
            x, y = self._runs(low), self._runs(length - low)
            n = max(0, min(len(x), len(y) - low))
            self._all[length] = _ordered(x[:n], y[low : low + n])
        return self._all[length]

    def prefix(self, length: int) -> np.ndarray:
        """The hash of each suffix's first `length` words, the window at most."""
        return self._runs(min(length, self.window))[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def path(self) -> np.ndarray:
        """Each suffix's path in its tree, the bits of a shorter prefix before those of a longer one."""
        full, path, left = self.prefix(self.window), np.zeros(len(self.at), np.uint64), 64
        for d in DEPTHS:
            if d < self.window:
                left -= DEPTH_BITS
                path |= self.prefix(d) >> np.uint64(64 - DEPTH_BITS) << np.uint64(left)
        return path | (full >> np.uint64(64 - left))


def levels_of(window: int) -> list[int]:
    return [*(p for p in PREFIXES if p < window), window]


class Prefixes:
    """The group of each suffix, from how often hashed prefixes of growing length start one.

    counts: for each level but the last, suffixes by slot, of those only that no
    level before has placed; deep: how many are left, by slot, for the last level.
    """

    def __init__(self, slots: int, group_suffixes: int, window: int):
        self.bits, self.size, self.window = slots.bit_length() - 1, group_suffixes, window
        self.tables: list[np.ndarray] = []
        self.first_deep, self.deep = 0, 1

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def left(self, s: Suffixes) -> np.ndarray:
        """The suffixes that the levels so far do not place."""
        return np.flatnonzero(self._placed(s) < 0)

    def _placed(self, s: Suffixes) -> np.ndarray:
        found = np.full(len(s.at), -1, np.int64)
        more = np.arange(len(s.at))
        for length, table in zip(levels_of(self.window), self.tables, strict=False):
            if not len(more):
                break
            found[more] = table[self._slot(s.prefix(length)[more])]
            more = more[found[more] < 0]
        return found

    def add_level(self, counts: np.ndarray) -> bool:
        """Groups the slots that fit; whether any is too large."""
        fits = counts <= self.size
        sums = np.cumsum(np.where(fits, counts, 0))
        self.tables.append(np.where(fits, self.first_deep + sums // self.size, -1).astype(np.int32))
        self.first_deep += int(sums[-1] // self.size) + 1
        self.deep = max(1, -(-int(counts[~fits].sum()) // self.size))
        return not fits.all()

    def groups(self, s: Suffixes) -> np.ndarray:
        found = self._placed(s)
        more = np.flatnonzero(found < 0)
        found[more] = self.first_deep + (_mix(s.prefix(self.window)[more]) % np.uint64(self.deep)).astype(np.int64)
        return found


def prefix_groups(docs: DataFrame, text_size: int, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES, seed: int = 0, least_slots: int = LEAST_SLOTS) -> Prefixes:
    """Counts prefixes over all documents, one level a scan, until every slot fits or a level is the whole window.

    A table of slots comes to the driver for each level. Their number is four for
    each group that text_size bytes of words may need, and MOST_GROUPS bounds both.
    """
    suffixes = text_size // 4 + 1  # a word and a space take over four bytes, about
    size = max(group_suffixes, -(-suffixes // MOST_GROUPS))
    slots = max(least_slots, 1 << (4 * suffixes // size).bit_length())
    prefixes = Prefixes(slots, size, window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, level = np.zeros(slots, np.int64), levels_of(window)[len(prefixes.tables)]
        for batch in slices(batches, "text", BLOCK_BYTES):
            s = Suffixes(list(text_bytes(batch.column("text"))), window, seed)
            chosen = s.prefix(level)[prefixes.left(s)] if prefixes.tables else s.prefix(level)
            total += np.bincount(prefixes._slot(chosen), minlength=slots)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot])], ["slot", "n"])

    for _ in levels_of(window)[:-1]:
        found = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(slots, np.int64)
        counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
        if not prefixes.add_level(counts):
            break
    return prefixes


def _pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed gaps, by byte planes."""
    gaps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel()).astype(np.int64)


class Block:
    """The rows of one block in a fixed order, their suffixes, and the repeats that the block itself shows."""

    def __init__(self, rows: pa.Table, window: int, seed: int):
        order = pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")])
        self.rows = rows.take(order)
        self.texts = list(text_bytes(self.rows.column("text")))
        self.doc_ids = pc.fill_null(self.rows.column("doc_id").cast(pa.int64()), _NEVER).to_numpy()
        self.suffixes = s = Suffixes(self.texts, window, seed)
        path = s.path()
        order = np.argsort(path, kind="stable")  # in a class, the smallest document comes first
        new = np.ones(len(order), bool)
        new[1:] = path[order[1:]] != path[order[:-1]]
        self.first = order[new]  # the first suffix of each class
        self.cls = np.empty(len(order), np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.repeated = self.doc_ids[s.doc] > self.doc_ids[s.doc[self.first]][self.cls]
        self.path = path

    def leaves(self, prefixes: Prefixes) -> Iterator[tuple[int, np.ndarray]]:
        """Each group that the block has leaves in, and those leaves in order: the same whenever it is asked."""
        leaf = np.sort(self.first)
        group = prefixes.groups(self.suffixes)[leaf]
        order = np.argsort(group.astype(np.uint16) if prefixes.first_deep + prefixes.deep < 1 << 16 else group, kind="stable")
        leaf, group = leaf[order], group[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(group[a]), leaf[a:b]


def tree_nodes(path: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in the order of their tree, and the common prefix of each with the one before, in words that the paths know."""
    order = np.argsort(path, kind="stable")
    ordered = path[order]
    differ = ordered[1:] ^ ordered[:-1]
    common = np.where(differ == 0, window, 0)
    left = 64
    for d in DEPTHS:
        if d < window:
            left -= DEPTH_BITS
            common[(differ != 0) & (differ < np.uint64(1 << left))] = d
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), common])


def tree_repeats(path: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which leaves lie below an inner node as deep as the window and outside the smallest document there."""
    order, common = tree_nodes(path, window)
    out = np.zeros(len(order), bool)
    if len(order):
        docs, first = doc[order], np.flatnonzero(common < window)
        least = np.minimum.reduceat(docs, first)
        out[order] = docs > np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def _resolve(rows: pa.Table, window: int) -> pa.Table:
    """The group's reported leaves, as places in what each block sent."""
    group, blocks = rows.column("grp")[0].as_py(), rows.column("block").to_pylist()
    paths, docs = [], []
    for row in rows.select(["paths", "docs", "counts"]).to_batches():
        for p, d, c in zip(*(x.to_pylist() for x in row.columns), strict=True):
            paths.append(np.frombuffer(p, np.uint64))
            docs.append(np.repeat(_unpack(d), np.diff(_unpack(c))))
    found = tree_repeats(np.concatenate(paths), np.concatenate(docs), window) if paths else np.zeros(0, bool)
    ends = np.cumsum([len(x) for x in paths])
    out = [(b, _pack(np.flatnonzero(f))) for b, p, e in zip(blocks, paths, ends, strict=True) if (f := found[e - len(p) : e]).any()]
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([group] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["block", "grp", "found"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES, block_bytes: int = BLOCK_BYTES, with_text: bool = True, least_slots: int = LEAST_SLOTS) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and spans (first and end word of each maximal removed range).

    With with_text the column text becomes what is kept: the words joined by one
    space where any was removed, else the text as it was. Without it the text is
    left out.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("doc_id must be an integer")
    added = "n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>"
    new = [x.split()[0] for x in added.split(", ")]
    carried = [n for n in docs.columns if n not in new]
    seed = secrets.randbits(63)
    count = block_count(docs, "text", block_bytes)
    prefixes = prefix_groups(docs, count * block_bytes, window, group_suffixes, seed, least_slots)
    name = fresh(docs, "block")
    dealt = docs.select(*carried).withColumn(name, block_of(count, "doc_id", "text"))
    dealt = dealt.repartition(min(count, 20_000), name)

    def send(rows: pa.Table) -> pa.Table:
        """One row for each group that the block has leaves in."""
        out: list[list] = [[], [], [], [], []]
        if rows.num_rows:
            block = Block(rows, window, seed)
            number = rows.column(name)[0].as_py()
            for group, mine in block.leaves(prefixes):
                ids = block.doc_ids[block.suffixes.doc[mine]]
                at = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
                packed = (group, number, block.path[mine].tobytes(), _pack(ids[at]), _pack(np.append(at, len(mine))))
                for column, x in zip(out, packed, strict=True):
                    column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["grp", "block", "paths", "docs", "counts"])

    # all columns here too, so that both uses of dealt share one shuffle
    leaves = dealt.groupBy(name).applyInArrow(send, "grp long, block long, paths binary, docs binary, counts binary")
    found = leaves.groupBy("grp").applyInArrow(lambda rows: _resolve(rows, window), "block long, grp long, found binary")
    shown = [n for n in carried if with_text or n != "text"]

    def rewrite(rows: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])
        if not rows.num_rows:
            return pa.table([rows.column(n) for n in shown] + [pa.array([], f.type) for f in kinds], names=[*shown, *kinds.names])
        block = Block(rows, window, seed)
        s = block.suffixes
        reported = np.zeros(len(block.first), bool)
        told = dict(zip(replies.column("grp").to_pylist(), replies.column("found").to_pylist(), strict=True))
        if told:
            for group, mine in block.leaves(prefixes):
                if group in told:
                    reported[block.cls[mine[_unpack(told[group])]]] = True
        n = len(s.word_doc)
        change = np.zeros(n + 1, np.int32)
        starts = s.at[block.repeated | reported[block.cls]]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        gone = np.cumsum(change[:n]) > 0
        cuts = np.searchsorted(s.word_doc, np.arange(len(block.texts) + 1))
        columns: list[list] = [[], [], [], [], []]
        for k, raw in enumerate(block.texts):
            words, mine = raw.split(), gone[cuts[k] : cuts[k + 1]]
            removed = int(mine.sum())
            kept = b" ".join(compress(words, ~mine) if removed else words)
            edges = np.flatnonzero(np.diff(mine.view(np.int8), prepend=0, append=0)).tolist() if removed else []
            row = (len(words), removed, hashlib.sha256(kept).hexdigest(), [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)], kept if removed else None)
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        held = block.rows.select([n for n in carried if n != "text"] if with_text else shown)
        if with_text:
            text = pc.coalesce(pa.array(columns[4], pa.binary()).cast(pa.string()), block.rows.column("text").combine_chunks().cast(pa.string()))
            held = held.append_column("text", text).select(shown)
        for f, x in zip(kinds, columns[:4], strict=True):
            held = held.append_column(f, pa.array(x, f.type))
        return held

    kinds = ", ".join([f"`{n}` {t}" for n, t in dealt.select(*shown).dtypes] + [added])
    return dealt.groupBy(name).cogroup(found.withColumnRenamed("block", name).groupBy(name)).applyInArrow(rewrite, kinds)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The columns of docs with repeated passages cut out of text (n_chars follows it); documents that lose every word go."""
    found = remove_repeats(docs.withColumnsRenamed({n: f"in_{n}" for n in docs.columns if n not in ("doc_id", "text")}))
    left = found.filter("n_removed = 0 or n_removed < n_words")
    named = [F.length("text").cast(t).alias(n) if n == "n_chars" else F.col(n if n in ("doc_id", "text") else f"in_{n}").alias(n) for n, t in docs.dtypes]
    return left.select(*named)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT g, min(doc_id) AS owner FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM windows JOIN least USING (g) WHERE owner < doc_id), (SELECT unnest(range(13)) AS k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
