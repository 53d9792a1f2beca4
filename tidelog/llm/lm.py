"""Language-model scoring by online logistic context mixing.

A text, A-Z lower-cased, is a sequence of words closed by an end. Words are coded
as binary decisions down a code tree, whose leaves are the corpus's most frequent
words, 32 classes of other words (by their first two bytes) and the end; frequent
words take few decisions. For every decision several predictors give log-odds:

* how often the corpus went either way at that node of the tree,
* the same in four hashed contexts: the word before (if frequent, else its class),
  the classes of the two words before, the last three bytes of the word before, and
  the last frequent word before that,
* and how this text itself has gone at that node so far.

They are added with weights from the set that the gate selects (whether the word
before is frequent, and how far the text has come), and the sum is corrected by a
table of how often such sums came true. Everything that a text teaches is used from
its 17th token on: after chunks of 16, 32, 64, ... tokens (4,096 at most) its own
node counts grow, its weights take a gradient step on the chunk's errors, each gate's
apart, and its correction table counts what came true. So a probability never
depends on what comes after.

A word outside the tree has, given its class, the share of its exact count in the
corpus; a word that the corpus has not got has what words seen once have together
(Good and Turing's estimate), and is spelled by bytes, from counts after four
bytes, three, two, one and none, each blended into the one before. White space that is not one
plain space is coded too. All costs together are the text's total in bits, and
`score` is its log10 probability.

What is learned, over all training texts:

* the exact count of every distinct word (as for `base_score`). Tokens are exchanged
  as 64-bit hashes: a block of documents sends each distinct token once to the
  token's group and gets its count back, so frequent tokens cost no more than rare
  ones. This grows with the corpus without a bound.
* tables of the hashed contexts, the spelling and the white space, of fixed size:
  the contexts are some thousands of words, classes or endings, so what they need
  does not grow with the corpus. Tasks count into tables, equal symbols in equal
  contexts together, and the tables are summed slice by slice, in two steps where
  there are many tasks. One byte a cell, they are
  broadcast together with the tree (40 MB).
* first weights and the first correction. Training texts are in two halves, each with
  tables of its own (the model has their sum), and every text is read with the
  tables of the half that it is not in, so that it does not meet itself. A task goes through
  its texts once and takes Newton's step for the weights batch by batch, each at
  what the batches before have led to; the steps' curvatures and pulls add up over
  all tasks (3 kB each). Where these weights were far from the result, as in a small
  corpus, all texts are read again at the result.

Defined cases: a null or empty text is its end alone; a null doc_id is neither
learned from nor held out; rows with equal doc_id all count, each by
its own text; with no training text all decisions are even and the
base knows no token; an empty table gives no rows. Columns other than doc_id and
text are never read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_of, cut, held_out, slices, table, text_bytes
from .substring import _SPACE, _mix, _pack, _unpack, _words

#: Words in the tree, and how often one must occur to be there.
VOCABULARY, LEAST_COUNT = 1 << 13, 8
CLASSES = 32
#: Words that are contexts by themselves: as the word before, and as the last frequent word.
KNOWN_BEFORE, FREQUENT = 4096, 1024
CONTEXTS = 4
CELL_BITS = 22
SLICES = 64
#: Nodes of the tree whose course in a text is followed.
FOLLOWED = 512
FOLLOWED_BITS = FOLLOWED.bit_length()
#: By so many first bits of its hash a word is looked up in the tree.
SLOT_BITS = 17
INPUTS = CONTEXTS + 2
AGES = (32, 256)
GATES = 2 * (len(AGES) + 1)
FIRST_CHUNK, MOST_CHUNK = 16, 4096
#: A gate's weights move by the mean error of so many decisions at least; own counts and corrections begin with so many of the corpus's.
PRIOR_DECISIONS, PRIOR_COUNT, PRIOR_TRUE = 50.0, 8.0, 40.0
SCALE = 16  # cells are log-odds in 16ths as signed bytes; 0 is even
UNSEEN = -128  # the cell of what no training text had
LIMIT = 12.0
BUCKETS = int(4 * LIMIT) + 2
NEWTON_STEPS = 8
RIDGE = 0.1  # how firmly weights hold to where they begin
SETTLED = 5e-4  # squared log-odds, by curvature, that the weights of steps may be from the result in the mean; on sf0.1 they were 2e-4, and a second round moved the result by 1e-7
#: Text that a step for the weights is taken after.
FIT_BYTES = 1 << 19

BLOCK_BYTES = 4 << 20
GROUP_TOKENS = 1 << 20
SCORE_BYTES = 1 << 19
#: What a counting task keeps for each table before it adds it, and how much it adds at once.
TALLY_KEYS, TALLY_AT_ONCE = 1 << 19, 1 << 14
#: Text that one counting task should have at least, as each sends a whole table.
COUNT_BYTES = 512 << 20
#: Counting tasks whose tables are summed at once; more are summed in two steps.
SUM_TASKS = 64

#: Parts of the table of counts that are no decisions: a byte of a word after the 4, 3 and 2 bytes before (hashed to so many bits) and after the one before, and white space after each last byte.
SPELL_BITS = (14, 13, 12)
_AFTER = [sum(256 << b for b in SPELL_BITS[:k]) for k in range(4)]
_GAPS = _AFTER[3] + (256 << 8)
_WHITE = _GAPS + 2 * 257
_STOP = 0x20  # what closes a spelled word, and a gap: no word holds it
_WHITE_BYTES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]


#: Whether a byte is inside a word; a number's lowest bytes, by how many.
_INSIDE = (~_SPACE).astype(np.uint8).tobytes()
_LOW = (1 << 8 * np.arange(6)) - 1


class Tree:
    """A prefix code for symbols (words of the vocabulary by ascending hash, classes, the end), and what the corpus did at its nodes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, classes: np.ndarray, ends: int):
        """words: ascending hashes; counts: of each; classes: how often another word of each class came; ends: of texts."""
        self.words = words
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.lexsort((words, -counts))] = np.arange(len(words))
        total = np.concatenate([counts, classes, [ends]]).astype(np.float64)
        n = self.symbols = len(total)
        heap = [(c + 0.5, i) for i, c in enumerate(total.tolist())]
        heapq.heapify(heap)
        above, side = [-1] * (2 * n - 1), [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            above[i] = above[j] = k
            side[j] = 1
            heapq.heappush(heap, (a + b, k))
        nodes: list[int] = []
        bits: list[int] = []
        length = []
        for s in range(n):
            path, x = [], s
            while above[x] >= 0:
                path.append(x)
                x = above[x]
            path.reverse()
            nodes += [2 * n - 2 - above[x] for x in path]  # the root is 0, and frequent nodes come first
            bits += [side[x] for x in path]
            length.append(len(path))
        self.length = np.array(length)
        self.first = np.cumsum(self.length) - self.length
        node, self.bit = np.array(nodes, np.int64), np.array(bits, np.int8)
        weight = np.repeat(total, self.length)
        ones, all_ = np.bincount(node, weight * self.bit, n), np.bincount(node, weight, n)
        odds = np.log((ones + 0.4) / (all_ - ones + 0.4))
        self.base = np.zeros(FOLLOWED, np.float32)
        self.base[: min(n, FOLLOWED)] = odds[:FOLLOWED]
        self.odds = odds[node].astype(np.float32)
        self.followed = np.minimum(node, FOLLOWED)
        self.hash = (_mix(node.astype(np.uint64) + np.uint64(1 << 50)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        # hash, followed and bit of each step in one number, which costs one look instead of three
        self.branch = self.hash << 1 | self.bit
        self.packed = (self.hash << FOLLOWED_BITS | self.followed) << 1 | self.bit
        # where in words hashes that begin with some bits are
        self.slot = np.searchsorted(words, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash in words, and whether it is there."""
        n = len(self.words)
        if not n:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.slot[(hashes >> np.uint64(64 - SLOT_BITS)).view(np.int64)]
        at[at == n] = n - 1
        inside = self.words[at] == hashes
        behind = np.flatnonzero(self.words[at] < hashes)  # others share its bits, or it is not there
        later = np.minimum(np.searchsorted(self.words, hashes[behind]), n - 1)
        at[behind], inside[behind] = later, self.words[later] == hashes[behind]
        return at, inside

    def steps(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many decisions each symbol takes, and their places in the tree's lists, one symbol after the other."""
        size = self.length[symbol]
        ends = np.cumsum(size)
        place = np.repeat(self.first[symbol] - (ends - size), size)
        place += np.arange(len(place))
        return size, place


class Words:
    """The words of some texts (lower-cased): their place in raw, their hash, class and text."""

    def __init__(self, texts: list[bytes]):
        self.count = len(texts)
        joined = b"\n".join(texts) + b"\n" + b" " * 8
        self.raw = raw = np.frombuffer(joined, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(size)  # past the separator of each text
        self.starts = self.ends - size
        edge = np.flatnonzero(np.diff(np.frombuffer(joined.translate(_INSIDE), np.int8), prepend=0, append=0))
        self.first, self.end = edge[::2], edge[1::2]
        self.hash = _words(raw, self.first, self.end, 0)
        self.doc = np.repeat(np.arange(self.count), np.diff(np.searchsorted(self.first, self.ends), prepend=0))
        second = np.where(self.end - self.first > 1, raw[self.first + 1], 0).astype(np.uint64)
        self.cls = (_mix(raw[self.first].astype(np.uint64) << np.uint64(8) | second) >> np.uint64(59)).astype(np.int64)

    def until(self, at: np.ndarray) -> np.ndarray:
        """Of each place in raw the seven bytes before it and its own, which is the lowest."""
        return np.ndarray(len(self.raw), ">u8", bytes(7) + self.raw.tobytes(), strides=(1,))[at].astype(np.int64)

    def endings(self) -> np.ndarray:
        """The last three bytes of each word, or as many as it has; the last is the lowest."""
        return self.until(self.end - 1) & _LOW[np.minimum(self.end - self.first, 3)]

    def gaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """White space before each word and at the end of each text: its first place and end in raw, its text, and the last byte before (256: none)."""
        n, texts = len(self.first), np.arange(self.count)
        opens = np.ones(n, bool)
        opens[1:] = self.doc[1:] != self.doc[:-1]
        start = np.where(opens, self.starts[self.doc], np.concatenate([[0], self.end[:-1]])[:n])
        before = np.where(opens, 256, self.raw[np.maximum(start - 1, 0)].astype(np.int64))
        words = np.bincount(self.doc, minlength=self.count)
        closer = np.cumsum(words) - 1
        some = words > 0
        last = np.where(some, self.end[np.maximum(closer, 0)] if n else 0, self.starts)
        after = np.where(some, self.raw[np.maximum(last - 1, 0)].astype(np.int64), 256)
        return np.concatenate([start, last]), np.concatenate([self.first, self.ends - 1]), np.concatenate([self.doc, texts]), np.concatenate([before, after])

    def plain(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each gap is as expected: one space between words, nothing around them."""
        inner = np.zeros(len(start), bool)
        n = len(self.first)
        inner[1:n] = self.doc[1:] == self.doc[:-1]
        return np.where(inner, (end - start == 1) & (self.raw[start] == 0x20), end == start)


class Sequence:
    """Some texts as symbols of a tree with their contexts, text by text, each closed by the end."""

    def __init__(self, tree: Tree, words: Words):
        n, texts = len(words.hash), words.count
        at, self.inside = tree.find(words.hash)
        total = n + texts
        place = np.arange(n) + words.doc
        size = np.bincount(words.doc, minlength=texts) + 1
        self.first, self.size = np.cumsum(size) - size, size
        doc = np.repeat(np.arange(texts), size)
        self.symbol = np.full(total, tree.symbols - 1, np.int64)
        self.symbol[place] = np.where(self.inside, at, len(tree.words) + words.cls)
        rank = np.where(self.inside, tree.rank[at] if len(tree.words) else 0, 1 << 30)

        def behind(x: np.ndarray, k: int, none: int) -> np.ndarray:
            """x, of words, of the k-th token before each token of the same text."""
            out = np.full(total + k, none, np.int64)
            out[place + k] = x
            out = out[:total]
            out[np.arange(total) - self.first[doc] < k] = none
            return out

        before, c1, c2 = behind(rank, 1, 1 << 30), behind(words.cls, 1, CLASSES), behind(words.cls, 2, CLASSES)
        self.after_known = before < KNOWN_BEFORE
        spread = np.full(total, -1, np.int64)
        spread[place] = np.where(rank < FREQUENT, place, -1)
        last = np.maximum.accumulate(spread) if total else spread
        last = np.concatenate([[-1, -1], last])[:total]  # two tokens before, or earlier
        word = np.full(total, FREQUENT, np.int64)
        met = last >= self.first[doc]
        ranks = np.full(total, FREQUENT, np.int64)
        ranks[place] = np.minimum(rank, FREQUENT)
        word[met] = ranks[last[met]]
        keys = (np.where(self.after_known, before, KNOWN_BEFORE + c1), c1 * 64 + c2, behind(words.endings(), 1, 1 << 24), word * 64 + c1)
        self.contexts = [(_mix(x.astype(np.uint64) + np.uint64(k + 1 << 40)) >> np.uint64(64 - CELL_BITS)).astype(np.int64) for k, x in enumerate(keys)]


def spelling(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words `which` and the stop after them: its number in which, and the byte with the four before it, itself the lowest. A word's class stands before its first byte."""
    size = words.end[which] - words.first[which] + 1
    owner = np.repeat(np.arange(len(which)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    bytes_ = words.until(words.first[which][owner] + inside)
    stop = np.cumsum(size) - 1
    bytes_[stop] = bytes_[stop] & ~255 | _STOP
    seen = np.minimum(inside, 4)
    return owner, bytes_ & _LOW[seen + 1] | (words.cls[which][owner] << 8 * (seen + 1)) & _LOW[5]


def spelled_places(bytes_: np.ndarray) -> list[np.ndarray]:
    """Places in the counts of a byte after the 4, 3, 2 and 1 before it."""
    byte, history = bytes_ & 255, bytes_ >> 8
    places = []
    for k, bits in zip((4, 3, 2), SPELL_BITS, strict=True):
        row = (_mix((history & _LOW[k]).astype(np.uint64) + np.uint64(k << 40)) >> np.uint64(64 - bits)).astype(np.int64)
        places.append(_AFTER[4 - k] + (row << 8) + byte)
    return [*places, _AFTER[3] + ((history & 255) << 8) + byte]


def spelled(words: Words, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each byte of the words `which` and the stop after them: its number in which, and its places in the counts."""
    owner, bytes_ = spelling(words, which)
    return owner, spelled_places(bytes_)


@dataclass
class Spelling:
    """Counts of bytes of words, and of gaps."""

    counts: np.ndarray
    gap: np.ndarray  # 257 x (not plain, plain)
    white: np.ndarray  # of each byte of white space in other gaps; the last is the stop

    @classmethod
    def of(cls, counts: np.ndarray) -> Spelling:
        white = counts[_WHITE : _WHITE + 256][[*_WHITE_BYTES, 0]]
        return cls(counts[:_GAPS].astype(np.float32), counts[_GAPS:_WHITE].reshape(257, 2).astype(np.float64), white.astype(np.float64))

    def bits(self, words: Words, which: np.ndarray) -> np.ndarray:
        """The cost of each of these words: counts after four bytes, blended with those after three, two, one and none, each by how many kinds followed."""
        if not len(which):
            return np.zeros(0)
        owner, places = spelled(words, which)
        table = self.counts.reshape(-1, 256)
        none = table[_AFTER[3] >> 8 :].sum(axis=0, dtype=np.float64)
        byte = places[0] & 255
        p = (none[byte] + 1.0) / (none.sum() + 256)
        for place in places[::-1]:
            rows, back = np.unique(place >> 8, return_inverse=True)
            part = table[rows]
            kinds = ((part > 0).sum(axis=1) + 1.0)[back]
            p = (self.counts.take(place) + kinds * p) / (part.sum(axis=1, dtype=np.float64)[back] + kinds)
        return np.bincount(owner, -np.log2(p), len(which))

    def gap_bits(self, words: Words) -> np.ndarray:
        """The cost of each text's white space."""
        start, end, doc, before = words.gaps()
        plain = words.plain(start, end)
        share = (self.gap + 0.5) / (self.gap + 0.5).sum(axis=1, keepdims=True)
        cost = np.bincount(doc, -np.log2(share[before, plain.astype(np.int64)]), words.count)
        odd = np.flatnonzero(~plain)
        byte = -np.log2((self.white + 0.5) / (self.white + 0.5).sum())
        by_value = np.zeros(256)
        by_value[_WHITE_BYTES] = byte[:-1]
        size = (end - start)[odd]
        at = np.repeat(start[odd] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return cost + np.bincount(np.repeat(doc[odd], size), by_value[words.raw[at]], words.count) + np.bincount(doc[odd], minlength=words.count) * byte[-1]


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


_GRID = np.arange(BUCKETS) / 2 - LIMIT


@dataclass
class Model:
    tree: Tree
    cells: list[np.ndarray]  # of each context: log-odds as bytes
    weights: np.ndarray  # gates x inputs
    refine: np.ndarray  # of each bucket of log-odds: how often it came true

    def decisions(self, words: Words, sequence: Sequence) -> Iterator[tuple]:
        """Chunk by chunk of all texts at once: the texts that go on; the first gate, and how many decisions are at it (the others are at the next); of each run of decisions at one gate of one text its text (its number among them), gate and size; of each decision its inputs and bit; and whether any text has more."""
        tree = self.tree
        at, end = sequence.first.copy(), sequence.first + sequence.size
        base = 1 / (1 + np.exp(-tree.base))
        own = np.zeros((words.count, FOLLOWED + 1, 2), np.float32)
        step, age = FIRST_CHUNK, 0
        while len(live := np.flatnonzero(at < end)):
            stop = np.minimum(at[live] + step, end[live])
            size = stop - at[live]
            token = np.repeat(at[live] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            known = sequence.after_known[token]
            order = np.concatenate([np.flatnonzero(~known), np.flatnonzero(known)])
            token, text = token[order], np.repeat(np.arange(len(live)), size)[order]
            steps, place = tree.steps(sequence.symbol[token])
            packed = tree.packed.take(place, mode="wrap")  # all places are inside: the quickest of modes
            bit, hashed = packed & 1, packed >> FOLLOWED_BITS + 1
            x = np.empty((INPUTS, len(place)), np.float32)
            x[0] = tree.odds.take(place, mode="wrap")
            for value, context, cells in zip(x[1:], sequence.contexts, self.cells, strict=False):
                key = np.repeat(context[token], steps)
                key ^= hashed
                cell = cells.take(key, mode="wrap")
                value[:] = cell
                value *= np.float32(1 / SCALE)
                unseen = cell == UNSEEN
                if unseen.any():
                    np.copyto(value, x[0], where=unseen)
            followed = np.repeat(text * (FOLLOWED + 1), steps)
            followed += (packed >> 1) & ((1 << FOLLOWED_BITS) - 1)
            if age:
                count = own[live, :FOLLOWED]
                turn = np.zeros((len(live), FOLLOWED + 1), np.float32)
                turn[:, :-1] = np.log((count[:, :, 1] + np.float32(PRIOR_COUNT) * base) / (count[:, :, 0] + np.float32(PRIOR_COUNT) * (1 - base))) - tree.base
                x[-1] = turn.ravel().take(followed, mode="wrap")
            else:
                x[-1] = 0
            least = len(known) - int(known.sum())
            run = text.copy()
            run[least:] += len(live)
            opens = np.flatnonzero(np.diff(run, prepend=-1))
            gate = 2 * int(np.searchsorted(AGES, age, "right"))
            more = bool((stop < end[live]).any())
            yield live, gate, int(steps[:least].sum()), text[opens], gate + (opens >= least), np.add.reduceat(steps, opens), x, bit, more
            if more:
                both = np.bincount(2 * followed + bit, minlength=2 * len(live) * (FOLLOWED + 1))
                own[live] += both.reshape(len(live), FOLLOWED + 1, 2)
            at[live] = stop
            age, step = age + step, min(2 * step, MOST_CHUNK)

    def bits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each text's symbols, and which words are in the tree."""
        sequence, cost = Sequence(self.tree, words), np.zeros(words.count)
        weights = np.repeat(self.weights[None], words.count, axis=0)
        true = np.zeros((words.count, BUCKETS, 2))
        for live, _, _, text, gate, size, x, bit, more in self.decisions(words, sequence):
            mine = np.ascontiguousarray(weights[live[text], gate].T)
            odds = np.zeros(len(bit), np.float32)
            for w, value in zip(mine, x, strict=True):
                part = np.repeat(w, size)
                part *= value
                odds += part
            np.clip(odds, -LIMIT, LIMIT, out=odds)
            bucket = ((odds + np.float32(LIMIT)) * np.float32(2) + np.float32(0.5)).astype(np.int64)
            came = true[live]
            shown = (came[:, :, 1] + PRIOR_TRUE * self.refine) / (came.sum(axis=2) + PRIOR_TRUE)
            bucket += np.repeat(text * BUCKETS, size)
            sign = (2 * bit - 1).astype(np.float32)
            final = odds + _logit(shown).astype(np.float32).ravel().take(bucket, mode="wrap")
            final *= sign
            final *= np.float32(-0.5)
            first = np.cumsum(size) - size
            cost[live] += np.bincount(text, np.add.reduceat(np.log1p(np.exp(final, out=final), out=final), first, dtype=np.float64), len(live))
            if not more:
                continue
            odds *= sign
            wrong = np.exp(odds, out=odds)
            wrong += np.float32(1)
            np.divide(sign, wrong, out=wrong)  # the bit less its probability
            gate = text * GATES + gate
            pull = np.stack([np.bincount(gate, np.add.reduceat(wrong * value, first), len(live) * GATES) for value in x], axis=1)
            n = np.bincount(gate, size, len(live) * GATES) + PRIOR_DECISIONS
            weights[live] += (pull / n[:, None]).reshape(len(live), GATES, INPUTS).astype(np.float32)
            true[live] += np.bincount(2 * bucket + bit, minlength=2 * len(live) * BUCKETS).reshape(len(live), BUCKETS, 2)
        return cost / math.log(2), sequence.inside


class Fit:
    """First weights and the first correction, as far as some texts tell.

    A batch's Newton step starts at the weights that the batches before have led to.
    What it adds is its curvature, and its pull on weights as seen from zero, so
    that sums over batches, or tasks, have one solution.
    """

    def __init__(self, weights: np.ndarray | None = None):
        """weights: all steps are taken there."""
        self.begin = np.full((GATES, INPUTS), 1 / (INPUTS - 1))
        self.moves, self.met = weights is None, weights is not None
        self.weights = self.begin if weights is None else weights
        self.sums = np.zeros(GATES * INPUTS * (INPUTS + 2) + GATES + 2 * BUCKETS)

    def _parts(self, sums: np.ndarray) -> list[np.ndarray]:
        """Of each gate the curvature, the pull, the curvature times the weights, and times them again; of each bucket how many decisions were 0 and 1."""
        shapes = ((GATES, INPUTS, INPUTS), (GATES, INPUTS), (GATES, INPUTS), (GATES,), (BUCKETS, 2))
        return [x.reshape(shape) for x, shape in zip(np.split(sums, np.cumsum([math.prod(x) for x in shapes])[:-1]), shapes, strict=True)]

    def apart(self) -> float:
        """How far a decision's weights were from the result in the mean."""
        curve, _, bent, twice, shown = self._parts(self.sums)
        w = self.solved(self.sums)
        return float((twice - 2 * (w * bent).sum(axis=1) + np.einsum("gi,gij,gj->g", w, curve, w)).sum() / max(1.0, shown.sum()))

    def solved(self, sums: np.ndarray) -> np.ndarray:
        curve, pull, *_ = self._parts(sums)
        return np.clip(np.linalg.solve(curve + RIDGE * np.eye(INPUTS), (pull + RIDGE * self.begin)[:, :, None])[:, :, 0], -4, 4)

    def _seen(self, decisions: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sums of some decisions, at the weights."""
        sums = np.zeros_like(self.sums)
        curve, pull, bent, twice, shown = self._parts(sums)
        for gate, x, bit in decisions:
            w = self.weights[gate]
            odds = np.clip(w.astype(np.float32) @ x, -LIMIT, LIMIT)
            p = np.exp(-odds)
            p += np.float32(1)
            np.divide(np.float32(1), p, out=p)
            bend = ((x * (p * (1 - p) + np.float32(1e-6))) @ x.T).astype(np.float64)
            curve[gate] += bend
            pull[gate] += bend @ w + x @ (bit.astype(np.float32) - p)
            bent[gate] += bend @ w
            twice[gate] += w @ bend @ w
            bucket = ((odds + np.float32(LIMIT)) * np.float32(2) + np.float32(0.5)).astype(np.int64)
            shown += np.bincount(2 * bucket + bit, minlength=2 * BUCKETS).reshape(BUCKETS, 2)
        return sums

    def add(self, model: Model, words: Words) -> None:
        """Takes some texts in. Only the trees, cells and inputs of model count, not its weights."""
        found = _by_gate(model.decisions(words, Sequence(model.tree, words)))
        if not self.met:
            found, self.met = list(found), True
            for _ in range(NEWTON_STEPS - 1):
                self.weights = self.solved(self._seen(found))
        self.sums += self._seen(found)
        if self.moves:
            self.weights = self.solved(self.sums)

    def refine(self) -> np.ndarray:
        n = self._parts(self.sums)[-1]
        return (n[:, 1] + 20 / (1 + np.exp(-_GRID))) / (n.sum(axis=1) + 20)

    def model(self, tree: Tree, cells: list[np.ndarray]) -> Model:
        return Model(tree, cells, self.solved(self.sums).astype(np.float32), self.refine())


def _by_gate(chunks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for _, gate, least, _, _, _, x, bit, _ in chunks:
        for g, part in ((gate, slice(0, least)), (gate + 1, slice(least, None))):
            if len(bit[part]):
                yield g, x[:, part], bit[part]


def tune(tree: Tree, cells: list[np.ndarray], texts: list[bytes]) -> Model:
    """A model with first weights and the first correction from texts that the tables leave out."""
    fit, blank = Fit(), untuned(tree, cells)
    for a, b in _runs(np.fromiter(map(len, texts), np.int64, len(texts)), FIT_BYTES):
        fit.add(blank, Words(texts[a:b]))
    return fit.model(tree, cells)


def untuned(tree: Tree, cells: list[np.ndarray]) -> Model:
    return Fit().model(tree, cells)


def fit_weights(docs: DataFrame, tree: Tree, halves: list[list[np.ndarray]]) -> Fit:
    """Weights and correction from all texts of docs (text and half), each read with the cells of the other half."""
    shared = docs.sparkSession.sparkContext.broadcast((tree, halves))

    def read(weights: np.ndarray | None) -> Fit:
        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fit, models = Fit(weights), [untuned(shared.value[0], cells) for cells in shared.value[1]]
            for batch in slices(batches, "text", FIT_BYTES):
                half = np.asarray(batch.column("half"))
                texts = [t.lower() for t in text_bytes(batch.column("text"))]
                for h in range(2):
                    if mine := [texts[i] for i in np.flatnonzero(half == h)]:
                        fit.add(models[1 - h], Words(mine))
            yield pa.RecordBatch.from_arrays([pa.array([fit.sums.tobytes()], pa.binary())], ["sums"])

        fit = Fit(weights)
        for sums in docs.select("text", "half").mapInArrow(gather, "sums binary").toArrow().column("sums"):
            fit.sums += np.frombuffer(sums.as_buffer())
        return fit

    fit, rounds = read(None), 1
    while fit.apart() > SETTLED and rounds < NEWTON_STEPS:
        fit, rounds = read(fit.solved(fit.sums)), rounds + 1
    shared.unpersist()
    return fit


class Tally:
    """Adds what texts show to the tables of counts: decisions in each context, and in the last table bytes of words outside the tree and white space.

    What a symbol in a context, or a byte after four, adds is always the same, so
    these are kept until there are many, and equal ones are added together.
    """

    def __init__(self, tables: list[np.ndarray], tree: Tree):
        self.tables, self.tree = tables, tree
        self.symbol_bits = tree.symbols.bit_length()
        self.kept: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS + 1)]

    def add(self, words: Words) -> None:
        sequence, other = Sequence(self.tree, words), self.tables[-1]
        for k, keys in enumerate(sequence.contexts):
            self._keep(k, keys << self.symbol_bits | sequence.symbol)
        self._keep(CONTEXTS, spelling(words, np.flatnonzero(~sequence.inside))[1])
        start, end, _, before = words.gaps()
        plain = words.plain(start, end)
        size = np.where(plain, 0, end - start)
        white = words.raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        for at, n in ((_GAPS, np.bincount(2 * before + plain)), (_WHITE, np.bincount(white))):
            other[at : at + len(n)] += n.astype(np.uint32)
        other[_WHITE] += np.uint32((~plain).sum())

    def _keep(self, k: int, keys: np.ndarray) -> None:
        self.kept[k].append(keys)
        if sum(map(len, self.kept[k])) >= TALLY_KEYS:
            self._pour(k)

    def _pour(self, k: int) -> None:
        keys, self.kept[k] = np.sort(np.concatenate([np.zeros(0, np.int64), *self.kept[k]])), []
        opens = np.flatnonzero(np.diff(keys, prepend=-1))
        every, times = keys[opens], np.diff(opens, append=len(keys)).astype(np.uint32)
        for a in range(0, len(every), TALLY_AT_ONCE):
            key, n = every[a : a + TALLY_AT_ONCE], times[a : a + TALLY_AT_ONCE]
            if k == CONTEXTS:
                for place in spelled_places(key):
                    np.add.at(self.tables[-1], place, n)
            else:
                steps, place = self.tree.steps(key & (1 << self.symbol_bits) - 1)
                cell = np.repeat(key >> self.symbol_bits << 1, steps)
                cell ^= self.tree.branch.take(place, mode="wrap")
                np.add.at(self.tables[k], cell, np.repeat(n, steps))

    def close(self) -> None:
        for k in range(CONTEXTS + 1):
            self._pour(k)


def add_counts(tables: list[np.ndarray], tree: Tree, words: Words) -> None:
    """Adds what some texts show to the tables of counts."""
    tally = Tally(tables, tree)
    tally.add(words)
    tally.close()


def cells_of(counts: np.ndarray) -> np.ndarray:
    """Log-odds as bytes of a table of counts, or a part of it."""
    zero, ones = counts[::2], counts[1::2]
    return np.where(zero + ones > 0, np.clip(np.rint(SCALE * np.log((ones + 0.4) / (zero + 0.4))), -127, 127), UNSEEN).astype(np.int8)


def count_tables(docs: DataFrame, tree: Tree, text_size: int) -> tuple[list[np.ndarray], list[list[np.ndarray]], np.ndarray]:
    """Of all texts of docs (text and half): for each context the table of cells, log-odds as bytes; the same of each half; and the table of spelling counts. Sums are distributed."""
    context = docs.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-text_size // COUNT_BYTES))
    length, width = 2 << CELL_BITS, (2 << CELL_BITS) // SLICES
    shared = context.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, other = [[np.zeros(length, np.uint32) for _ in range(CONTEXTS)] for _ in range(2)], np.zeros(length, np.uint32)
        tallies = [Tally([*tables, other], shared.value) for tables in halves]
        for batch in slices(batches, "text", SCORE_BYTES):
            half = np.asarray(batch.column("half"))
            texts = [t.lower() for t in text_bytes(batch.column("text"))]
            for h, tally in enumerate(tallies):
                if mine := [texts[i] for i in np.flatnonzero(half == h)]:
                    tally.add(Words(mine))
        for tally in tallies:
            tally.close()
        for h, tables in enumerate(halves):
            for k, counts in enumerate(tables):
                yield _sliced(k, h, counts)
        yield _sliced(CONTEXTS, 0, other)

    def _sliced(k: int, half: int, counts: np.ndarray) -> pa.RecordBatch:
        rows = []
        for s in range(SLICES):
            part = counts[s * width : (s + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((k * SLICES + s, half, _pack(at), _counts(part[at])))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "half", "at", "n"])

    def total(rows: pa.Table) -> np.ndarray:
        """Of each half."""
        out = np.zeros((2, width), np.int64)
        for half, a, n in zip(*(rows.column(c).to_pylist() for c in ("half", "at", "n")), strict=True):
            out[half, _unpack(a)] += _counted(n)
        return out

    def add(rows: pa.Table) -> pa.Table:
        part, half = rows.column("part")[0].as_py(), rows.column("half")[0].as_py()
        out = total(rows)[half]
        at = np.flatnonzero(out)
        return pa.table([pa.array([part], pa.int32()), pa.array([half], pa.int32()), pa.array([_pack(at)], pa.binary()), pa.array([_counts(out[at])], pa.binary())], names=["part", "half", "at", "n"])

    def close(rows: pa.Table) -> pa.Table:
        part, out = rows.column("part")[0].as_py(), total(rows)
        found = [cells_of(x) for x in (out[0] + out[1], *out)] if part < CONTEXTS * SLICES else [out[0]]
        return pa.table([pa.array([part] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in found], pa.binary())], names=["part", "of", "cells"])

    found = docs.select("text", "half").coalesce(tasks).mapInArrow(count, "part int, half int, at binary, n binary")
    if tasks > SUM_TASKS:
        ways = math.isqrt(tasks)
        found = found.withColumn("way", F.pmod(F.xxhash64("n"), F.lit(ways))).groupBy("part", "half", "way").applyInArrow(lambda rows: add(rows), "part int, half int, at binary, n binary")
    cells, other = [[np.full(1 << CELL_BITS, UNSEEN, np.int8) for _ in range(CONTEXTS)] for _ in range(3)], np.zeros(length, np.int64)
    told = found.groupBy("part").applyInArrow(close, "part int, of int, cells binary").toArrow()
    for part, of, packed in zip(told.column("part").to_pylist(), told.column("of").to_pylist(), told.column("cells"), strict=True):
        k, s = divmod(part, SLICES)
        raw = zstandard.decompress(packed.as_buffer())
        if k < CONTEXTS:
            cells[of][k][s * width // 2 : (s + 1) * width // 2] = np.frombuffer(raw, np.int8)
        else:
            other[s * width : (s + 1) * width] = np.frombuffer(raw, np.int64)
    return cells[0], cells[1:], other[: _WHITE + 256].copy()


@dataclass
class Exact:
    """Totals of the exact counts: tokens and distinct ones of the training texts, and of words outside the tree by class: their tokens and those that came once."""

    tokens: int
    distinct: int
    ends: int
    rest: np.ndarray
    once: np.ndarray

    @property
    def below(self) -> float:
        return math.log10(self.tokens + 0.1 * (self.distinct + 1))

    def other_bits(self, words: Words, outside: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The cost of words outside the tree given their class: their count's share, or that of words seen once."""
        cls, n = words.cls[outside], count[outside]
        every = (self.rest + self.once)[cls]
        return -np.log2(np.where(n > 0, n, self.once[cls]) / every)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, ascending; a place where each is (np.unique finds the first, which takes a slower sort); and of every hash its number among them."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    opens = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), ordered[1:] != ordered[:-1]]))
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(order)))
    return ordered[opens], order[opens], inverse


def vocabulary(known: list[tuple[np.ndarray, np.ndarray]], most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, ascending, and counts of the most frequent words."""
    words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in known)])
    counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in known)])
    best = np.lexsort((words, -counts))[:most]
    best = best[np.argsort(words[best])]
    return words[best], counts[best]


def score_texts(docs: DataFrame, train: F.Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, n_bytes, score (log10) and bits_per_byte of every row of docs, learning where train is true."""
    spark = docs.sparkSession
    read = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("_train"))
    learn = read.filter("_train")
    size = F.octet_length("text").cast("long")
    sums = read.agg(F.count_if("_train").alias("n"), F.sum(F.when(F.col("_train"), size)).alias("size"), F.sum(F.coalesce(size, F.lit(0)) + 64).alias("all")).first()
    ends, learn_size = sums["n"], sums["size"] or 0
    blocks = max(1, -(-(sums["all"] or 0) // block_bytes))
    groups = max(1, blocks * block_bytes // 32 // GROUP_TOKENS)
    least = max(LEAST_COUNT, learn_size // (7 << 20))  # of some seven bytes a word, at most a million words come so often
    dealt = read.withColumn("_block", block_of(blocks, "doc_id", "text")).repartition(min(blocks, 20_000), "_block")

    def send(rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if rows.num_rows:
            words = Words(_block_texts(rows))
            known, first, inverse = distinct(words.hash)
            cls = words.cls[first].astype(np.uint8)
            learned = np.bincount(inverse[np.asarray(rows.column("_train"))[words.doc]], minlength=len(known))
            cuts = np.searchsorted((known >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32), np.arange(groups + 1))
            number = rows.column("_block")[0].as_py()
            for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    for column, x in zip(out, (g, number, known[a:b].tobytes(), zstandard.compress(cls[a:b].tobytes(), 1), _counts(learned[a:b])), strict=True):
                        column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["grp", "block", "tokens", "classes", "n"])

    def meet(rows: pa.Table) -> pa.Table:
        """Replies to the blocks, and one row (block -1) of what the group tells the driver: frequent words and sums by class."""
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        known, first, inverse = distinct(np.concatenate(parts))
        cls = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8) for x in rows.column("classes").to_pylist()])[first].astype(np.int64)
        total = np.bincount(inverse, np.concatenate([_counted(x) for x in rows.column("n").to_pylist()])).astype(np.int64)
        stops = np.cumsum([len(x) for x in parts])
        replies = [_counts(total[inverse[e - len(p) : e]]) for p, e in zip(parts, stops, strict=True)]
        often = total >= least
        by_class = [np.bincount(cls, weight, CLASSES).astype(np.int64) for weight in (total, total == 1)]
        told = np.concatenate([[(total > 0).sum(), total.sum()], *by_class]).astype(np.int64).tobytes()
        group, n = rows.column("grp")[0].as_py(), len(replies)
        none = [None] * n
        return pa.table(
            [pa.array([*rows.column("block").to_pylist(), -1], pa.int64()), pa.array([group] * (n + 1), pa.int64()), pa.array([*replies, _counts(total[often])], pa.binary()), pa.array([*none, known[often].tobytes()], pa.binary()), pa.array([*none, cls[often].astype(np.uint8).tobytes()], pa.binary()), pa.array([*none, told], pa.binary())],
            names=["_block", "grp", "n", "words", "classes", "told"],
        )

    sent = dealt.groupBy("_block").applyInArrow(send, "grp long, block long, tokens binary, classes binary, n binary")
    replies = cut(sent.groupBy("grp").applyInArrow(meet, "_block long, grp long, n binary, words binary, classes binary, told binary"))
    told = replies.filter("_block = -1").select("n", "words", "classes", "told").toArrow().to_pylist()
    totals = sum((np.frombuffer(r["told"], np.int64) for r in told), np.zeros(2 + 2 * CLASSES, np.int64))
    words, counts = vocabulary([(np.frombuffer(r["words"], np.uint64), _counted(r["n"])) for r in told])
    classes = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["classes"], np.uint8) for r in told)])
    every = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in told)])
    order = np.argsort(every)
    inside = np.bincount(classes[order][np.searchsorted(every[order], words)], counts, CLASSES) if len(words) else np.zeros(CLASSES)
    rest = totals[2 : 2 + CLASSES] - inside
    exact = Exact(int(totals[1]) + ends, int(totals[0]) + (ends > 0), ends, rest.astype(np.float64), totals[2 + CLASSES :] + 1.0)
    tree = Tree(words, counts, exact.rest + exact.once, ends)

    halved = learn.select("text", F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(2)).cast("int").alias("half"))
    cells, halves, other = count_tables(halved, tree, learn_size)
    model = fit_weights(halved, tree, halves).model(tree, cells)
    shared = spark.sparkContext.broadcast((model, Spelling.of(other)))

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _block_texts(rows) if rows.num_rows else []
        model, spelling = shared.value
        order = np.argsort(answers.column("grp").to_numpy())
        packed = answers.column("n").to_pylist()
        total = np.concatenate([np.zeros(0, np.int64), *(_counted(packed[i]) for i in order)])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        n, seen, base, bits = np.ones(len(texts), np.int64), np.full(len(texts), int(ends > 0)), np.full(len(texts), math.log10(ends + 0.1)), np.zeros(len(texts))
        runs = [(a, b, Words(texts[a:b])) for a, b in _runs(size, SCORE_BYTES)]
        every = distinct(np.concatenate([np.zeros(0, np.uint64), *(w.hash for _, _, w in runs)]))[2]
        done = 0
        for a, b, words in runs:
            count = total[every[done : done + len(words.hash)]]
            done += len(words.hash)
            n[a:b] += np.bincount(words.doc, minlength=b - a)
            seen[a:b] += np.bincount(words.doc, count > 0, b - a).astype(np.int64)
            base[a:b] += np.bincount(words.doc, np.log10(count + 0.1), b - a)
            cost, inside = model.bits(words)
            outside = np.flatnonzero(~inside)
            cost += spelling.gap_bits(words) + np.bincount(words.doc[outside], exact.other_bits(words, outside, count), b - a)
            unknown = outside[count[outside] == 0]
            _, first, inverse = distinct(words.hash[unknown])
            bits[a:b] = cost + np.bincount(words.doc[unknown], spelling.bits(words, unknown[first])[inverse], b - a)
        base -= n * exact.below
        new = (n, seen, np.full(len(texts), exact.tokens, np.int64), base, size, -bits * math.log10(2), bits / np.maximum(1, size))
        return pa.table([rows.column("doc_id"), *(pa.array(x) for x in new)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "n_bytes", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, n_bytes long, score double, bits_per_byte double"
    answers = replies.filter("_block >= 0").select("_block", "grp", "n")
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(score, kinds)


def _block_texts(rows: pa.Table) -> list[bytes]:
    return [t.lower() for t in text_bytes(rows.column("text"))]


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, one text at least."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def _counts(n: np.ndarray) -> bytes:
    return zstandard.compress(n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _counted(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 10, 0)
    found = score_texts(docs, ~apart)
    return found.select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
