"""Mixing sources to target weights with soft memberships.

A classifier fitted on the labelled table gives each document posteriors over the domains. Documents then get
nonnegative rates whose expected token totals by domain match the targets, as least squares solved by projected
gradient steps: minimise |sum_i r_i t_i p_i - target|^2 over r >= 0, from r = 1, until each target is met within 1e-4 of
all tokens and a hundredth of itself, or nothing comes nearer.

The gradient reaches a document only through its own posteriors and a step of one number a domain (the residual, or the
residual scaled by the domains' curvature). A document's rate is thus a fold over the steps so far, a list of steps x
domains numbers: nothing is stored for a document between steps, and each step is one pass or two over (tokens,
posteriors) that sum a few numbers a domain, on whatever cluster.

Domains: ``prose`` (quality 1, not toxic), ``toxic``, ``low`` (quality 0, not toxic), as the labelled table has them. The
classifier is a multinomial logistic one over shares of byte and word classes and the presence of the words that tell
the domains apart best; it is fitted on at most ``sample`` labelled documents of each domain, outside the held-out
fold, and reweighted to the domains' shares among all labelled rows.

Defined results: tokens are runs of bytes other than space and 9 to 13; null or wordless texts have none and don't
count. Without labels all posteriors are equal. A target of a domain that no document belongs to can't be met; the least
squares come as near as they can. Rows that repeat an id get rates of their own, by their texts. Extra columns are kept by
``mix``; where one has the name of a column that ``mix`` adds, the latter gets an underscore more. An empty table gives an
empty table.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import free_name, plain, reliable, renamed
from linemill.llm._features import HELD_OUT, NAMES, Adam, Scale, bounded, dense, fold
from linemill.llm._tokens import ALNUM, NOT_SPACE, U, Words, flat, slices

DOMAINS = ("prose", "toxic", "low")
#: Shares of the mixture's tokens, and the mixture's size as a share of all tokens.
TARGETS, BUDGET = {"prose": 0.95, "toxic": 0.01, "low": 0.04}, 0.8
SAMPLE, WORDS, TOLERANCE = 4_000, 256, 1e-4
#: Plain steps that are still taken one by one; lengths at which a scaled step is tried; rounds after which a warning says
#: that the fit has not ended.
PLAIN, LENGTHS, PASSES = 100, (2.0, 1.0, 0.5, 0.25, 0.0625), 1_000
#: Partitions of the texts whose numbers a task of the fit takes.
GATHER = 16
#: Chi-square below which a word counts as noise (with two degrees of freedom one word in 300,000 reaches it by chance).
SURE = 25.0


@dataclass
class Posterior:
    scale: Scale
    vocabulary: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    def __call__(self, column: pa.ChunkedArray | pa.Array, words: Words | None = None) -> np.ndarray:
        z = self.scale(np.concatenate((dense(column, words), presence(column, self.vocabulary)), axis=1).astype(np.float64)) @ self.weights + self.shift
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def presence(column: pa.ChunkedArray | pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """Which words (sorted hashes) occur in each text."""
    data, at = flat(column)
    words = Words(data, at, ALNUM)
    out = np.zeros((len(at) - 1, len(vocabulary)), np.float32)
    if len(vocabulary) and len(words):
        i = np.searchsorted(vocabulary, words.hash)
        i[i == len(vocabulary)] = 0
        hit = vocabulary[i] == words.hash
        out[words.text_of()[hit], i[hit]] = 1
    return out


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, word): the distinct words of each text, as hashes."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(*flat(part["text"]), ALNUM)
            domain = part["domain"].to_numpy()
            for i, (lo, hi) in enumerate(zip(words.of_text[:-1], words.of_text[1:], strict=True)):
                found = np.unique(words.hash[lo:hi]).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(found), domain[i], np.int32)), pa.array(found)], names=["domain", "word"])


def telling_words(texts: DataFrame, sizes: np.ndarray, most: int = WORDS) -> np.ndarray:
    """Hashes of the words whose occurrence in a document tells most about its domain (chi-square), sorted."""
    seen = texts.mapInArrow(_document_words, "domain int, word long").groupBy("word").agg(F.count("*").alias("often"), *(F.count_if(F.col("domain") == d).alias(f"d{d}") for d in range(len(DOMAINS)))).where("often >= 5")
    total, chi = float(max(1, sizes.sum())), F.lit(0.0)
    for d, n in enumerate(sizes):
        expected, rest = F.col("often") * float(n) / total + 1e-9, (total - F.col("often")) * float(n) / total + 1e-9
        chi = chi + (F.col(f"d{d}") - expected) ** 2 / expected + (float(n) - F.col(f"d{d}") - rest) ** 2 / rest
    best = seen.select("word", chi.alias("chi")).where(F.col("chi") >= SURE).orderBy(F.desc("chi"), "word").limit(most).collect()
    return np.sort(np.array([r["word"] for r in best], np.int64).view(U))


def fit_posterior(x: np.ndarray, y: np.ndarray, vocabulary: np.ndarray, shares: np.ndarray) -> Posterior:
    """x: features; y: domain indices; shares: of the domains among all labelled rows."""
    scale = Scale(x) if len(x) else Scale(np.zeros((1, x.shape[1])))
    z, sizes = scale(x), np.bincount(y, minlength=len(DOMAINS))
    w, adam = np.zeros((z.shape[1], len(DOMAINS))), Adam((z.shape[1], len(DOMAINS)), 0.02)
    if not len(x):
        return Posterior(scale, vocabulary, w, np.zeros(len(DOMAINS)))
    weight = 1 / (np.maximum(1, sizes)[y] * max(1, (sizes > 0).sum()))
    known = np.where(sizes > 0, 0.0, -30.0)
    for _ in range(300):
        e = np.exp((s := z @ w + known) - s.max(axis=1, keepdims=True))
        g = e / e.sum(axis=1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        w -= adam.step(z.T @ (g * weight[:, None]) + 1e-4 * w)
    return Posterior(scale, vocabulary, w, np.log(np.maximum(shares, 1e-12)))


def labelled_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.max("toxic") == 1, 1).when(F.min("quality") == 0, 2).otherwise(0)
    return labels.where("quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(domain.alias("domain"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Posterior:
    known = labelled_domains(labels).where(fold(F.col("_id")) != HELD_OUT).join(docs.select(F.col("doc_id").cast("long").alias("_id")).distinct(), "_id")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    parts = [bounded(known.where(F.col("domain") == d).select("_id", "domain"), sample, 3, "_id") for d in range(len(DOMAINS))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]))  # len(DOMAINS) * sample ids at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("_id"))
    texts = reliable(texts.select("doc_id", "domain", "text"))
    sizes = np.zeros(len(DOMAINS))
    for r in texts.groupBy("domain").count().collect():
        sizes[r["domain"]] = r["count"]
    vocabulary = telling_words(texts, sizes)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.concatenate((dense(part["text"]), presence(part["text"], vocabulary)), axis=1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.record_batch([part["doc_id"], part["domain"], lists], names=["doc_id", "domain", "x"])

    sample_ = texts.mapInArrow(featured, "doc_id long, domain int, x array<float>").toArrow().sort_by("doc_id")
    x = sample_["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sample_.num_rows, -1) if sample_.num_rows else np.zeros((0, len(NAMES) + len(vocabulary)))
    total = max(1, sum(counts.values()))
    shares = np.array([counts.get(d, 0) / total for d in range(len(DOMAINS))]) if counts else np.full(len(DOMAINS), 1 / len(DOMAINS))
    return fit_posterior(x.astype(np.float64), sample_["domain"].to_numpy().astype(np.int64), vocabulary, shares)


def memberships(docs: DataFrame, model: Posterior, residuals: np.ndarray | None = None) -> DataFrame:
    """The rows of docs with ``_lm_tokens`` and ``_lm_p`` (posteriors in the order of DOMAINS); where the steps' residuals
    are given, with ``_lm_rate`` too, so that texts go to Python and back once."""
    shared = docs.sparkSession.sparkContext.broadcast((model, residuals))
    schema = T.StructType([*docs.schema.fields, T.StructField("_lm_tokens", T.LongType()), T.StructField("_lm_p", T.ArrayType(T.DoubleType()))])
    if residuals is not None:
        schema = schema.add("_lm_rate", T.DoubleType())

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, steps = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(part["text"]), NOT_SPACE)
                tokens, p = np.diff(words.of_text), posterior(part["text"], words)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
                rates = [] if steps is None else [pa.array(rate_of(p, steps))]
                yield pa.record_batch([*part.columns, pa.array(tokens, pa.int64()), lists, *rates], names=schema.names)

    return docs.mapInArrow(predicted, schema)


def rate_of(p: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Rates after the steps whose residuals are given: r = max(0, r - p . residual), from 1."""
    r = np.ones(len(p))
    for res in residuals:
        r = np.maximum(0.0, r - p @ res)
    return r


def _sums(table: DataFrame, so_far: np.ndarray, trials: np.ndarray, res: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """One pass: all tokens, each domain's tokens after each of the trial steps, and the curvature sum t p p^T over the
    rows that can move from where they are, as ``res`` is the residual (rates above zero, or pushed up from zero)."""
    n = len(DOMAINS)
    names = ["total", *(f"d{i}" for i in range(n * len(trials))), *(f"c{i}" for i in range(n * n))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(names))
        for b in batches:
            t = b["_lm_tokens"].to_numpy().astype(np.float64)
            p = b["_lm_p"].flatten().to_numpy(zero_copy_only=False).reshape(len(t), n)
            r = rate_of(p, so_far)
            free = np.where((r > 0) | (p @ res < 0), t, 0.0)
            out += np.concatenate(([t.sum()], *((t * np.maximum(0.0, r - p @ step)) @ p for step in trials), ((p * free[:, None]).T @ p).ravel()))
        yield pa.record_batch([pa.array([x]) for x in out], names=names)

    found = np.array([list(r) for r in table.select("_lm_tokens", "_lm_p").mapInArrow(summed, ", ".join(f"{c} double" for c in names)).groupBy().sum().collect()], dtype=np.float64)[0]
    total = 0.0 if np.isnan(found[0]) else found[0]
    cut = 1 + n * len(trials)
    return total, found[1:cut].reshape(len(trials), n) / max(1.0, total), found[cut:].reshape(n, n) / max(1.0, total)


def _plain_steps(curvature: np.ndarray, res: np.ndarray, near: np.ndarray) -> float:
    """How many more plain steps bring the residual down to ``near`` while the same rows move."""
    values, vectors = np.linalg.eigh(curvature)
    size = np.abs(vectors.T @ res)
    with np.errstate(divide="ignore"):
        return float(np.where(size <= near.min(), 0.0, np.log(near.min() / np.maximum(size, near.min())) / np.log1p(-np.clip(values, 1e-12, 1 - 1e-12))).max())


def fit_rates(table: DataFrame, targets: dict[str, float], budget: float) -> tuple[np.ndarray, dict[str, float]]:
    """table: (_lm_tokens, _lm_p). The steps taken, and each domain's expected share of the mixture.

    In the metric of the token counts the least squares' curvature is at most 1, so steps of 1 (plain steps) descend, but
    a domain of share s closes a fraction s of its gap in each. Where that would take more than ``PLAIN`` steps, steps are
    scaled by the inverse of the curvature over the rows that can move. A scaled step can be too long, as rates stop at
    zero: one pass weighs it at several lengths and beside the plain step, and the best is taken, so that the squares
    always fall. It ends where all targets are met, or where no step makes the squares less.
    """
    # A row is a few numbers where its text was thousands of bytes: a pass takes many of the text's partitions in a task.
    context = table.sparkSession.sparkContext
    table = table.coalesce(max(context.defaultParallelism, table.rdd.getNumPartitions() // GATHER))
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS]) * budget
    near = np.where(goal > 0, np.minimum(TOLERANCE, goal / 100), TOLERANCE)
    steps, none = np.zeros((0, len(DOMAINS))), np.zeros((1, len(DOMAINS)))
    total, (share,), curvature = _sums(table, steps, none, none[0])
    if not total:
        return steps, dict.fromkeys(DOMAINS, 0.0)
    res, plain = share - goal, True
    for _ in range(PASSES):
        if (np.abs(res) < near).all():
            break
        plain = plain and len(steps) + _plain_steps(curvature, res, near) <= PLAIN
        if plain:
            steps = np.concatenate((steps, res[None, :]))
            _, (share,), curvature = _sums(table, steps, none, none[0])
            res = share - goal
            continue
        _, _, curvature = _sums(table, steps, none[:0], res)
        scaled = np.linalg.pinv(curvature, rcond=1e-10, hermitian=True) @ res
        trials = np.stack([res, *(scaled * length for length in LENGTHS)])
        _, shares, _ = _sums(table, steps, trials, res)
        squares = ((shares - goal) ** 2).sum(axis=1)
        best = int(np.argmin(squares))
        if squares[best] >= (res**2).sum() * (1 - 1e-6):
            break  # as near as it gets
        steps, share = np.concatenate((steps, trials[best][None, :])), shares[best]
        res = share - goal
    else:
        warnings.warn(f"mixing: targets not met after {PASSES} passes, residuals {res.tolist()}", stacklevel=2)
    return steps, dict(zip(DOMAINS, map(float, share), strict=True))


def rated(members: DataFrame, residuals: np.ndarray) -> DataFrame:
    """The rows of ``memberships`` with ``_lm_rate``."""
    schema = T.StructType([*members.schema.fields, T.StructField("_lm_rate", T.DoubleType())])

    def with_rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b["_lm_p"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(DOMAINS))
            yield pa.record_batch([*b.columns, pa.array(rate_of(p, residuals))], names=schema.names)

    return members.mapInArrow(with_rate, schema)


def _reported(rows: DataFrame) -> DataFrame:
    """Tokens, posteriors and rate as ``n_tokens``, ``p_<domain>`` and ``rate``, with ``copies``."""
    kept = [c for c in rows.columns if c not in ("_lm_tokens", "_lm_p", "_lm_rate")]
    posteriors = [F.col("_lm_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    named = rows.select(*kept, F.col("_lm_tokens").alias("n_tokens"), *posteriors, F.col("_lm_rate").alias("rate"))
    # A rate is rounded up or down by the hash of the row, so that the expected number of copies is the rate.
    chance = F.pmod(F.xxhash64(F.lit(4), "doc_id", "n_tokens"), F.lit(1 << 53)) / float(1 << 53)
    return named.withColumn("copies", F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long"))


def mixture_report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>, rate, copies) of each row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = reliable(memberships(slim, train(docs, labels)).select("doc_id", "_lm_tokens", "_lm_p"))
    return _reported(rated(table, fit_rates(table, targets, budget)[0]))


def mixture_shares(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """(domain, target, reached, met): tokens of each domain as shares of all tokens, as asked for and as the rates give
    them; ``met``: within 1e-4 of all tokens and a hundredth of the target, which is where the fit ends if it can."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, share = fit_rates(reliable(memberships(slim, train(docs, labels)).select("_lm_tokens", "_lm_p")), targets, budget)
    rows = []
    for d in DOMAINS:
        goal = targets.get(d, 0.0) * budget
        rows.append((d, goal, share[d], bool(abs(share[d] - goal) < (min(TOLERANCE, goal / 100) if goal else TOLERANCE))))
    return docs.sparkSession.createDataFrame(rows, "domain string, target double, reached double, met boolean")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The rows of docs that have a rate above zero, with ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies``.

    Texts are scored twice (once for the rates, once for the rows), which is cheaper than shuffling them.
    """
    model = train(docs.select("doc_id", "text"), labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    steps, _ = fit_rates(reliable(memberships(slim, model).select("_lm_tokens", "_lm_p")), targets, budget)
    rows, names = plain(docs, "doc_id", "text")
    mixed = _reported(memberships(rows, model, steps)).where("rate > 0")
    own = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"]
    return mixed.select(*renamed(mixed, names, docs.columns), *(F.col(c).alias(free_name(docs, c)) for c in own))
