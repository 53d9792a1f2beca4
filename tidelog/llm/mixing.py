"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives each document its posterior
over domains. A nonnegative rate for each document is then fitted so that the
expected tokens of each domain, sum(rate * tokens * posterior), come as near as
possible to the targets in least squares, while rates stay near 1 (a weak
ridge). A domain's residual counts relative to the tokens that it has, so that a
rare domain is pulled to its target as hard as a common one. The fit is accelerated
projected gradient: one step needs each domain's total only, and a document's rate
follows from its own posterior and the few totals of the steps before, so no
document's state is shuffled or kept. Documents of like posteriors move alike:
their tokens are first summed in bins of a fixed grid, by one distributed
aggregate of a bounded size, and most steps are taken on those. The last steps are
exact, each a distributed sum over the small table of tokens and posteriors.

Targets are shares of tokens; the domain with the largest share is to keep all
its tokens, and the others follow. Rates are nonnegative; those of a domain that
has fewer tokens than its share are above 1, so its documents are repeated, up to
`most` times each. A domain that hardly any document belongs to cannot meet its
target and must not distort the others: its residual counts less (REACH).
`shares` tells the expected shares beside the targets.

`copies` turns a rate into whole copies by a hash of doc_id: the whole part, and
one more with the probability of the rest.

The classifier is softmax regression over the presence of the words that tell
domains apart best and a few measures of style. It is fitted on a bounded
sample of labelled documents (`sample` of them, chosen by a hash of doc_id);
posteriors, totals and rates cover every whole document.

Defined cases: a null or empty text has no tokens and the posterior that its
style gives; a null doc_id has copies by rate rounded; without a labelled
document every posterior is the target itself; labels with a null are not used;
different labels of one document all count, once each; of rows with one doc_id
the classifier learns from one; an empty table gives no rows.
Other columns than doc_id and text are carried along by `mix` alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, slices, table, text_bytes

#: Shares of tokens that the mixture should have.
TARGETS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}

SAMPLE = 5000
VOCABULARY = 1500
LEAST_DOCS = 8
FIT_ROUNDS = 300
RIDGE = 1e-4
STEPS = 60
#: Steps on the documents themselves, after those on bins of like posteriors.
EXACT_STEPS = 6
#: Bins at most: what comes to the driver for the steps on bins.
MOST_BINS = 20_000
#: Weight of keeping rates near 1 against meeting the targets.
NEAR_ONE = 0.005
#: A domain's residual counts relative to its tokens, or to its target over REACH if it has fewer: what is next to absent pulls at no other document.
REACH = 5.0
#: No document is taken more often than this; a domain that would need more is as good as absent, and stays short.
MOST = 100.0

_STRIP = bytes(x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_CLASSES = [bytes(c for c in range(256) if c not in keep) for keep in (range(65, 91), range(48, 58), b"#*$%&|<>@{}[]", b"!?", b".,;:", range(128, 256), b"\n")]
STYLE = 4 + len(_CLASSES)


def words_of(raw: bytes) -> set[bytes]:
    """The distinct words of a text, lower-cased, without punctuation."""
    return set(raw.lower().translate(_STRIP).split())


def style_of(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, size = len(words), len(raw) + 1
    lines = [x for x in raw.split(b"\n") if x]
    shares = [len(raw.translate(None, other)) / size for other in _CLASSES]
    return [np.log1p(n), size / (n + 1), distinct / (n + 1), len(set(lines)) / (len(lines) + 1), *shares]


@dataclass
class Classifier:
    words: dict[bytes, int]
    weights: np.ndarray  # (STYLE + words + 1) x domains
    mean: np.ndarray
    scale: np.ndarray

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and posteriors of each text."""
        tokens, styles = np.zeros(len(texts), np.int64), np.zeros((len(texts), STYLE))
        scores = np.zeros((len(texts), self.weights.shape[1]))
        known = self.words.keys()
        for i, raw in enumerate(texts):
            words = raw.split()
            tokens[i] = len(words)
            distinct = words_of(raw)
            styles[i] = style_of(raw, words, len(distinct))
            at = sorted(self.words[w] for w in known & distinct)
            scores[i] = self.weights[at].sum(axis=0)
        scores += ((styles - self.mean) / self.scale) @ self.weights[-STYLE - 1 : -1] + self.weights[-1]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return tokens, scores / scores.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Classifier | None:
    """From labelled (doc_id, domain). None if no labelled document is found."""
    rows = labelled.filter(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain").distinct()
    count = rows.count()
    share = min(1.0, sample / max(1, count))
    few = cut(rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    met = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(few), "doc_id")  # `sample` rows, about
    chosen = cut(met.groupBy("doc_id", "domain").agg(F.min("text").alias("text")))  # however often a doc_id is repeated

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = [(d, w) for d, raw in zip(batch.column("domain").to_pylist(), text_bytes(batch.column("text")), strict=True) for w in words_of(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in ((0, pa.string()), (1, pa.binary()))], ["domain", "word"])

    totals = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    everyone = sum(totals.values())
    if not everyone:
        return None
    hits = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    met = chosen.mapInArrow(spread, "domain string, word binary").groupBy("word").agg(F.count("*").alias("n"), *hits).filter(F.col("n") >= LEAST_DOCS)
    z = F.lit(0.0)
    for i, d in enumerate(domains):
        share_d = totals.get(d, 0) / everyone
        expected = F.col("n") * share_d
        z = F.greatest(z, F.abs(F.col(f"n{i}") - expected) / F.sqrt(expected * (1 - share_d) + 0.5))
    best = met.select("word", z.alias("z")).orderBy(F.desc("z"), "word").limit(vocabulary).toArrow()
    index = {w: i for i, w in enumerate(sorted(best.column("word").to_pylist()))}
    number = {d: i for i, d in enumerate(domains)}

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            at, style = [], []
            for raw in text_bytes(batch.column("text")):
                distinct = words_of(raw)
                at.append(sorted(index[w] for w in index.keys() & distinct))
                style.append(style_of(raw, raw.split(), len(distinct)))
            domain = [number[d] for d in batch.column("domain").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array(domain, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(style, pa.list_(pa.float64()))], ["id", "domain", "at", "style"])

    found = sorted(chosen.mapInArrow(featurize, "id string, domain int, at array<int>, style array<double>").toArrow().to_pylist(), key=lambda r: (r["id"], r["domain"]))
    style = np.array([r["style"] for r in found])
    mean, scale = style.mean(axis=0), style.std(axis=0) + 1e-6
    x = np.zeros((len(found), len(index) + STYLE + 1), np.float32)
    for row, r in zip(x, found, strict=True):
        row[r["at"]] = 1
    x[:, len(index) : -1] = (style - mean) / scale
    x[:, -1] = 1
    y = np.eye(len(domains), dtype=np.float32)[[r["domain"] for r in found]]
    return Classifier(index, _softmax_regression(x, y), mean, scale)


def _softmax_regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by full gradient steps with per-weight step sizes (Adam)."""
    w, m, v = (np.zeros((x.shape[1], y.shape[1]), np.float32) for _ in range(3))
    for t in range(1, FIT_ROUNDS + 1):
        score = x @ w
        p = np.exp(score - score.max(axis=1, keepdims=True))
        g = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / len(x) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float64)


def posteriors(docs: DataFrame, classifier: Classifier | None, targets: np.ndarray) -> DataFrame:
    """doc_id, n_tokens and posterior (array of double, one for each domain) of every row of docs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = list(text_bytes(batch.column("text")))
            if classifier is None:
                tokens, p = np.array([len(x.split()) for x in texts]), np.tile(targets, (len(texts), 1))
            else:
                tokens, p = classifier.posteriors(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, n_tokens long, posterior array<double>")


def rates(p: np.ndarray, pulls: list[np.ndarray], near_one: float = NEAR_ONE, most: float = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps so far, and the extrapolated rates at which the next pull is taken.

    pulls: of each step, how far each domain's total was above its target, as a
    share of the tokens that the domain has at rate 1. So scaled, no step is
    longer than 1 + near_one allows.
    """
    now = ahead = np.ones(len(p))
    step = 1 / (1 + near_one)
    for t, pull in enumerate(pulls):
        new = np.clip(ahead - step * (p @ pull + near_one * (ahead - 1)), 0, most)
        now, ahead = new, np.clip(new + t / (t + 3) * (new - now), 0, most)
    return now, ahead


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def posterior_bins(known: DataFrame, width: int, most: int = MOST_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each bin of the grid, and their mean posterior; there are most bins at most, whatever the documents."""
    grid = 1  # shares are cut down to multiples of 1 / grid, so those of a bin sum to grid or up to width - 1 less
    while grid < 256 and sum(math.comb(s + width - 1, width - 1) for s in range(max(0, grid + 2 - width), grid + 2)) <= most:
        grid += 1
    names = [F.element_at("posterior", i + 1) for i in range(width)]
    keys = [F.floor(p * grid).alias(f"b{i}") for i, p in enumerate(names)]
    tokens = F.col("n_tokens").cast("double")
    found = known.groupBy(*keys).agg(F.sum(tokens).alias("n"), *[F.sum(tokens * p).alias(f"s{i}") for i, p in enumerate(names)]).filter("n > 0").toArrow()
    n = found.column("n").to_numpy()
    return n, np.stack([found.column(f"s{i}").to_numpy() for i in range(width)], axis=1) / n[:, None]


def fit_rates(known: DataFrame, targets: np.ndarray, steps: int = STEPS, near_one: float = NEAR_ONE, most: float = MOST, exact_steps: int = EXACT_STEPS) -> list[np.ndarray]:
    """The pulls of all steps; known has n_tokens and posterior and was cut before."""
    width = len(targets)
    names = [f"d{i}" for i in range(width)]
    small = known.select("n_tokens", "posterior").coalesce(known.sparkSession.sparkContext.defaultParallelism)  # a few numbers a document

    def totals(pulls: list[np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                p, n = _matrix(batch.column("posterior"), width), np.asarray(batch.column("n_tokens"), dtype=np.float64)
                total += (rates(p, pulls, near_one, most)[1] * n) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

        found = small.mapInArrow(add, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()
        return np.array([x or 0.0 for x in found])

    weight, mean = posterior_bins(known, width)
    have = weight @ mean
    if not have.sum():
        return []
    lead = int(targets.argmax())
    want = targets * have[lead] / targets[lead]
    mass = np.maximum(have, want / REACH)
    mass[have <= 0] = np.inf  # what no document belongs to pulls at none
    pulls: list[np.ndarray] = []
    while len(pulls) < steps:
        pulls.append(((rates(mean, pulls, near_one, most)[1] * weight) @ mean - want) / mass)
    for _ in range(exact_steps):
        pulls.append((totals(pulls) - want) / mass)
    return pulls


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], steps: int = STEPS, near_one: float = NEAR_ONE, most: float = MOST) -> DataFrame:
    """doc_id, n_tokens, posterior, rate and copies of every row of docs."""
    domains = tuple(targets)
    goal = np.array([targets[d] for d in domains], dtype=np.float64)
    goal /= goal.sum()
    known = cut(posteriors(docs, fit_classifier(docs, labelled, domains), goal))
    pulls = fit_rates(known, goal, steps, near_one, most)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = rates(_matrix(batch.column("posterior"), len(goal)), pulls, near_one, most)[0]
                yield batch.append_column("rate", pa.array(found))

    kinds = ", ".join(f"{n} {t}" for n, t in known.dtypes)
    return known.mapInArrow(rate, f"{kinds}, rate double").withColumn("copies", copies(F.col("doc_id"), F.col("rate")))


def shares(found: DataFrame, targets: dict[str, float]) -> DataFrame:
    """domain, target and share (expected, by rate) of the tokens of fit_mixture's rows."""
    everything = sum(targets.values())
    tokens = [F.sum(F.col("n_tokens") * F.col("rate") * F.element_at("posterior", i + 1)) for i in range(len(targets))]
    total = found.agg(*[t.alias(f"d{i}") for i, t in enumerate(tokens)], F.sum(F.col("n_tokens") * F.col("rate")).alias("n"))
    rows = [F.struct(F.lit(d).alias("domain"), F.lit(x / everything).alias("target"), F.try_divide(F.col(f"d{i}"), F.col("n")).alias("share")) for i, (d, x) in enumerate(targets.items())]
    return total.select(F.inline(F.array(*rows)))


def copies(doc_id: Column, rate: Column) -> Column:
    chance = F.coalesce(F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30)), F.lit(0.5))
    chance = F.when(doc_id.isNull(), 0.5).otherwise(chance)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain from quality and toxic: toxic first, then good or poor."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 1), "good").when((F.col("toxic") == 0) & (F.col("quality") == 0), "poor")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """The rows of docs, all their columns, each as many times as its copies say."""
    goal = targets or TARGETS
    domains = tuple(goal)
    weight = np.array([goal[d] for d in domains], dtype=np.float64)
    weight /= weight.sum()
    classifier = fit_classifier(docs, labelled, domains)
    pulls = fit_rates(cut(posteriors(docs, classifier, weight)), weight, most=most)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = list(text_bytes(batch.column("text")))
            p = np.tile(weight, (len(texts), 1)) if classifier is None else classifier.posteriors(texts)[1]
            yield batch.append_column(name, pa.array(rates(p, pulls, most=most)[0]))

    name = fresh(docs, "rate")
    rated = docs.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
    times = F.array_repeat(F.lit(0), copies(F.col("doc_id"), F.col(name)))
    return rated.withColumn(name, F.explode(times)).select(*docs.columns)


def op10_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit_mixture(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)
    shares = [F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return found.select("doc_id", "n_tokens", *shares, "rate", "copies")
