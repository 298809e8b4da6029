"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier over the words that tell most, learned from a labelled table, gives each document a probability for each
domain. Document rates (expected copies, never negative) are fitted by projected gradient steps on the least squares of
the domains' expected tokens against their targets. A step needs one sum per domain over all documents; a document's rate
follows from its probabilities and the steps so far, so no state but the steps is carried from one to the next.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import materialize, prepare

#: Classes that words are hashed to, and the bound of labelled documents that the classifier learns from.
BUCKETS, FIT_ROWS = 1 << 16, 20_000
#: Classes that get a weight: those whose share differs most between domains, by standard errors.
WEIGHED, SMOOTHING = 512, 0.5
#: A rate this close to a whole number counts as that number when copies are drawn.
SNAP = 0.01


def lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def signs(text: Column) -> Column:
    """The distinct classes of a text's words (runs of letters) and of its runs of marks."""
    letters = F.split(lower(text), r"[\x00-\x60\x7B-\x7F]+")
    marks = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x20A-Za-z0-9\x7F-\x{10FFFF}]+")
    return F.array_distinct(F.transform(F.array_distinct(F.concat(letters, marks)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def constants(values) -> Column:
    """A constant array, written as one string so that the plan holds one literal."""
    return F.split(F.lit(",".join(f"{v:.4g}" for v in values)), ",").cast("array<double>")


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on the classes of a text: a base by domain, and weights by domain and class.

    ``labelled`` (id, domain) is cut to ``fit_rows`` rows of the smallest hashed ids; of several labels of an id the first
    by name counts. The driver gets a row per class at most, and for each of the fitted texts the numbers of those of its
    classes that get a weight. Without labelled texts all domains are equally likely.
    """
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    )
    known = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id")
    known = materialize(known.select("domain", signs(F.col("text")).alias("own")), "mixing-fit")
    is_domain = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    counts = np.zeros((len(domains), BUCKETS))
    for row in known.select("domain", F.explode("own").alias("sign")).groupBy("sign").agg(*is_domain).collect():
        counts[:, row["sign"]] = row[1:]
    texts = np.array([n or 0 for n in known.agg(*is_domain).first()], float)

    def share(c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        yes = c + SMOOTHING
        return np.log(yes / (n + 2 * SMOOTHING)), 1 / yes - 1 / (n + 2 * SMOOTHING)

    own, own_error = share(counts, texts[:, None])
    rest, rest_error = share(counts.sum(0) - counts, texts.sum() - texts[:, None])
    apart = (np.abs(own - rest) / np.sqrt(own_error + rest_error)).max(0)
    picked = np.sort(np.argsort(-apart, kind="stable")[:WEIGHED])
    places = np.full(BUCKETS, -1)
    places[picked] = np.arange(len(picked))
    place = F.filter(F.transform("own", lambda s: F.get(constants(places), s)), lambda x: x >= 0)
    rows = known.select("domain", place.alias("at")).orderBy("domain", F.hash("at")).collect()
    x, y = np.zeros((len(rows), len(picked) + 1), np.float32), np.zeros((len(rows), len(domains)), np.float32)
    x[:, -1] = 1
    for i, row in enumerate(rows):
        x[i, np.array(row["at"], int)] = 1
        y[i, domains.index(row["domain"])] = 1
    fitted = regression(x, y)
    weights = np.zeros((len(domains), BUCKETS))
    weights[:, picked] = fitted[:-1].T
    return fitted[-1].astype(float), weights


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps; rows of x against one-hot rows of y."""
    w = old = np.zeros((x.shape[1], y.shape[1]), np.float32)
    if not len(x):
        return w
    bound = 0.5 * np.linalg.norm(x.T @ x / len(x), 2) + ridge
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - old)
        z = x @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        old, w = w, ahead - (x.T @ (e / e.sum(1, keepdims=True) - y) / len(x) + ridge * ahead) / np.float32(bound)
    return w


def posteriors(docs: DataFrame, base: np.ndarray, weights: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie, n_tokens, p (array by domain) of every row."""
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("tie"), word_count(text).alias("n_tokens"), signs(text).alias("own"))

    def sum_of(k: int) -> Column:
        table = constants(weights[k])
        return F.aggregate("own", F.lit(float(base[k])), lambda total, b: total + F.get(table, b))

    log = texts.select("doc_id", "tie", "n_tokens", F.array(*(sum_of(k) for k in range(len(base)))).alias("log"))
    powers = log.select("doc_id", "tie", "n_tokens", F.transform("log", lambda x: F.exp(x - F.array_max("log"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return powers.select("doc_id", "tie", "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


def rate_of(steps: list[np.ndarray], count: int) -> Column:
    """The rate after the given steps, from the column p: each step goes along the gradient and back to 0 or more."""
    if not steps:
        return F.lit(1.0)
    rows = F.transform(F.split(F.lit(";".join(",".join(repr(float(x)) for x in s) for s in steps)), ";"), lambda s: F.split(s, ",").cast("array<double>"))
    along = lambda g: sum((F.get(g, F.lit(k)) * F.get(F.col("p"), F.lit(k)) for k in range(count)), F.lit(0.0))
    return F.aggregate(rows, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - along(g)))


def fit_rates(known: DataFrame, weights: list[float], keep: int | None = None, tolerance: float = 1e-6, most: int = 200) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient, targets, and the expected tokens reached, by domain.

    The total is that of the table, or with ``keep`` the one at which that domain's documents have a rate of about one.
    A step goes along the gradient in the metric of the matrix sum(n p p') over the documents whose rate is above 0; it is
    halved when it takes the squares up. It ends when every domain is within ``tolerance`` of the total, or at the least
    squares solution of targets that can't be met; it raises if neither happens in ``most`` steps.
    """
    count = len(weights)
    p = [F.get("p", F.lit(k)) for k in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    n, r = F.col("n_tokens").cast("double"), F.col("r")
    alive = F.when(r > 0, n).otherwise(0.0)

    def sums(steps: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens of the table, expected tokens by domain, and the matrix of the documents above 0."""
        rated = known.select("n_tokens", "p", rate_of(steps, count).alias("r"))
        row = rated.agg(F.sum(n), *(F.sum(n * r * x) for x in p), *(F.sum(alive * p[i] * p[j]) for i, j in pairs)).first()
        matrix = np.zeros((count, count))
        for (i, j), v in zip(pairs, row[1 + count:]):
            matrix[i, j] = matrix[j, i] = v or 0.0
        return row[0] or 0.0, np.array([v or 0.0 for v in row[1: 1 + count]]), matrix

    tokens, reached, matrix = sums([])
    if not tokens:
        return [], np.zeros(count), np.zeros(count)
    share = np.array(weights) / sum(weights)
    total = tokens if keep is None else reached[keep] / share[keep]
    targets = total * share
    metric = np.linalg.pinv(matrix, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []

    def loss(at: np.ndarray) -> float:
        return float((at - targets) @ metric @ (at - targets))

    for _ in range(most):
        apart = reached - targets
        if np.abs(apart).max() <= tolerance * total:
            return steps, targets, reached
        step = np.linalg.pinv(matrix, rcond=1e-9, hermitian=True) @ apart
        while True:
            _, tried, after = sums([*steps, step])
            if loss(tried) <= loss(reached) or np.abs(step).max() < 1e-9:
                break
            step = step / 2
        if loss(reached) - loss(tried) <= 1e-10 * loss(reached):
            return steps, targets, reached
        steps.append(step)
        reached, matrix = tried, after
    raise RuntimeError(f"no solution within {most} steps: {reached} for {targets}")


def largest(count: int, first: int | None = None) -> Column:
    """1 for the domain of the largest membership and 0 for the others, from the column p; ``first`` wins ties."""
    order = sorted(range(count), key=lambda k: k != first)
    best = F.array_position(F.array(*(F.get("p", F.lit(k)) for k in order)), F.array_max("p")) - 1
    return F.array(*((best == order.index(k)).cast("double") for k in range(count)))


def mix_sources(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: str | None = None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False
) -> DataFrame:
    """doc_id, tie, n_tokens, p_<domain>..., rate, copies of every row of ``docs``.

    ``labelled`` has the id and a column domain; ``targets`` the weight of each domain among the expected tokens. The
    whole part of a rate is taken as copies, and one more where a hash of the row falls below the rest (``tie`` is a hash
    of the row too, for joining back; equal rows fall alike). Null and empty texts have no tokens, the base as membership,
    and a rate like others. Labels out of ``targets`` and null labels are not used. Extra columns are not read.
    With ``whole`` the rates are fitted with each row counted wholly to the domain of its largest membership (ties go to
    ``keep``), so all rows of a domain have one rate: 1 for ``keep``, 0 for a domain of weight 0.
    """
    prepare(docs.sparkSession)
    domains = sorted(targets)
    base, weights = classifier(docs, labelled, domains, id_col, text_col)
    soft = posteriors(docs, base, weights, id_col, text_col).withColumn("soft", F.col("p"))
    if whole:
        soft = soft.withColumn("p", largest(len(domains), None if keep is None else domains.index(keep)))
    known = materialize(soft, "mixing-members")
    steps, _, _ = fit_rates(known, [targets[d] for d in domains], None if keep is None else domains.index(keep))
    rate = known.withColumn("rate", rate_of(steps, len(domains)))
    snapped = F.when(F.abs(F.col("rate") - F.round("rate")) <= SNAP, F.round("rate")).otherwise(F.col("rate"))
    draw = F.pmod(F.xxhash64("tie", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(snapped) + F.when(draw < snapped - F.floor(snapped), F.lit(1)).otherwise(F.lit(0))
    return rate.select(
        "doc_id", "tie", "n_tokens", *(F.get("soft", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)), "rate", copies.cast("int").alias("copies")
    )


def label_domains(labels: DataFrame, junk: bool = True) -> DataFrame:
    """Domains of the table labels: toxic, else clean, or junk for quality 0."""
    domain = F.when(F.col("toxic") == 1, "toxic")
    if junk:
        domain = domain.when(F.col("quality") == 0, "junk")
    return labels.select("doc_id", domain.when(F.col("toxic") == 0, "clean").alias("domain"))
