"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A classifier learnt from the labelled table predicts, for every document, the probability of each domain. Document rates
r >= 0 are then fitted so that the expected tokens of each domain, sum r n p(domain), match targets: least squares by
projected gradients, each domain's error weighed by its present tokens. A step takes an aggregate over the table of
posteriors and a few numbers to the driver; a rate is one short expression of a document's own posteriors, so no state is
joined back or kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Words whose presence the toxicity model looks at, each in this many labelled documents or more, and the smoothing of their counts.
VOCABULARY, LEAST_DOCS, SMOOTHING = 48, 5, 0.5
#: Least log odds of a lexicon's word, so that chance words of few documents stay out.
LEAST_ODDS = 2.5
#: Bound of the labelled sample that the classifier learns from, and the weight of its penalty.
SAMPLE_DOCS, PENALTY = 20_000, 0.1
#: Most steps, and the relative error of a domain's tokens that is small enough.
STEPS, TOLERANCE = 40, 2e-3
DOMAINS = ("low_clean", "low_toxic", "high_clean", "high_toxic")
#: Target shares of the tokens.
WEIGHTS = {"low_clean": 0.12, "low_toxic": 0.01, "high_clean": 0.85, "high_toxic": 0.02}


#: What the make of a text is counted by: one class of characters each.
CLASSES = (r"[#$%&*@^~<>=+_/\\\\]", r"[|]", "[!]", "[A-Z]", "[0-9]")


def described(docs: DataFrame, text: str, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """The columns in `keep`, n and f: words of a text, and an array of numbers on its length, make and wording, and on the lexicon's words in it. Null texts are empty; a text without a letter has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = docs.select(*keep, t.alias("__t"), F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "").alias("__w"))
    x = x.select(*keep, "__t", F.size("__w").cast("long").alias("n"), F.array_distinct("__w").alias("__w"))
    size = F.greatest(F.length("__t"), F.lit(1))
    shares = [(F.size(F.split("__t", c)) - 1) / size for c in CLASSES]
    n = F.greatest(F.col("n"), F.lit(1))
    make = [F.log1p(F.length("__t").cast("double")), F.log1p(n.cast("double")), F.length("__t") / n, F.size("__w") / n]
    found = F.array_intersect("__w", F.array(*map(F.lit, lexicon))) if lexicon else F.array().cast("array<string>")
    x = x.select(*keep, "n", F.array(*[v.cast("double") for v in (*shares, *make)]).alias("__f"), found.alias("__k"))
    logs = [F.log(F.lit(1e-3) + F.col("__f")[i]) for i in range(len(CLASSES))]
    if lexicon:
        table = F.create_map(*[F.lit(v) for pair in lexicon.items() for v in pair])
        weight = F.aggregate("__k", F.lit(0.0), lambda acc, w: acc + F.element_at(table, w))
    else:
        weight = F.lit(0.0)
    k = F.size("__k")
    toxic = [F.least(k, F.lit(1)).cast("double"), F.least(k, F.lit(4)).cast("double"), weight]
    return x.select(*keep, "n", F.concat("__f", F.array(*logs, *toxic)).alias("f"))


FEATURES = 2 * len(CLASSES) + 7


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton steps; the last is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(x.shape[1]), PENALTY * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Classifier:
    """Logistic models of quality and of toxicity over the features; a domain's probability is their product."""

    def __init__(self, lexicon: dict[str, float], mean: np.ndarray, scale: np.ndarray, quality: np.ndarray, toxic: np.ndarray):
        self.lexicon, self.mean, self.scale, self.quality, self.toxic = lexicon, mean, scale, quality, toxic

    def _probability(self, w: np.ndarray) -> Column:
        flat = w[:-1] / self.scale
        z = sum((F.col("f")[i] * F.lit(float(v)) for i, v in enumerate(flat)), F.lit(float(w[-1] - flat @ self.mean)))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))

    def posteriors(self, described_docs: DataFrame) -> DataFrame:
        """The columns p0 to p3, one a domain, in the place of f."""
        x = described_docs.withColumns({"__q": self._probability(self.quality), "__x": self._probability(self.toxic)})
        q, t = F.col("__q"), F.col("__x")
        return x.withColumns({"p0": (1 - q) * (1 - t), "p1": (1 - q) * t, "p2": q * (1 - t), "p3": q * t}).drop("__q", "__x", "f")


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Learns from labelled documents, SAMPLE_DOCS at most by a hash of the id. Word counts stay a table; the chosen words, and the sample's features, go to the driver."""
    y = labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("i")).agg((F.min("quality") > 0).cast("int").alias("q"), (F.max("toxic") > 0).cast("int").alias("x"))
    share = min(1.0, SAMPLE_DOCS / max(y.count(), 1))
    y = y.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(y), "i")
    d = written(d.select("i", "q", "x", "t"), "labelled")
    n, bad = d.agg(F.count("*"), F.coalesce(F.sum("x"), F.lit(0))).first()
    lexicon: dict[str, float] = {}
    if 0 < bad < n:
        per = d.select("x", F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))).alias("w")).where("w <> ''").groupBy("w").agg(F.sum("x").alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
        odds = F.log((F.col("a") + SMOOTHING) / (bad + 2 * SMOOTHING)) - F.log((F.col("n") - F.col("a") + SMOOTHING) / (n - bad + 2 * SMOOTHING))
        best = per.withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.col("a")), "w").limit(VOCABULARY).collect()
        lexicon = {r["w"]: float(r["odds"]) for r in best}
    rows = described(d, "t", lexicon, "i", "q", "x").orderBy(F.xxhash64("i"), "f").limit(SAMPLE_DOCS).collect()
    if not rows:
        k = FEATURES
        return Classifier({}, np.zeros(k), np.ones(k), np.zeros(k + 1), np.zeros(k + 1))
    x = np.array([r["f"] for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    return Classifier(lexicon, mean, scale, *[_logistic(z, np.array([r[c] for r in rows], float)) for c in ("q", "x")])


P = [f"p{k}" for k in range(len(DOMAINS))]


def with_rate(table: DataFrame, direction: np.ndarray | None = None, most: float | None = None) -> DataFrame:
    """table (p0 to p3, ...) with the column rate: 1 moved against a direction of the posteriors and cut to its bounds."""
    if direction is None:
        return table.withColumn("rate", F.lit(1.0))
    r = F.greatest(F.lit(0.0), 1 - sum(F.lit(float(v)) * F.col(p) for v, p in zip(direction, P, strict=True)))
    return table.withColumn("rate", F.least(r, F.lit(float(most))) if most is not None else r)


def expected(table: DataFrame) -> np.ndarray:
    """Expected tokens of each domain under the column rate."""
    return np.array(table.agg(*[F.coalesce(F.sum(F.col("n") * F.col("rate") * F.col(p)), F.lit(0.0)) for p in P]).first(), float)


def _moments(table: DataFrame, most: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain under the column rate, and how they change with a step: the sums of n p p' over the rows whose rate is inside its bounds."""
    n = F.col("n").cast("double")
    inside = F.col("rate") > 0 if most is None else (F.col("rate") > 0) & (F.col("rate") < most)
    pairs = [(i, j) for i in range(len(P)) for j in range(i, len(P))]
    gram = [F.coalesce(F.sum(F.when(inside, n * F.col(P[i]) * F.col(P[j]))), F.lit(0.0)) for i, j in pairs]
    row = table.agg(*[F.coalesce(F.sum(n * F.col("rate") * F.col(p)), F.lit(0.0)) for p in P], *gram).first()
    g = np.zeros((len(P), len(P)))
    for (i, j), v in zip(pairs, row[len(P) :], strict=True):
        g[i, j] = g[j, i] = v
    return np.array(row[: len(P)], float), g


def residual(reached: np.ndarray, targets: np.ndarray) -> float:
    """The greatest relative error of a domain; a target below a thousandth of all counts as that."""
    return float((np.abs(reached - targets) / np.maximum(targets, max(targets.sum(), 1) / 1000)).max())


def fit_rates(table: DataFrame, targets: np.ndarray, most: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The direction against which rates of 1 are moved, and the expected tokens reached. table: (n, p0 to p3), written, as it is read once a step.

    Lazy projected gradients: the gradients of the squared errors add up to one direction, and rates of 1 moved against
    it are cut to their bounds, so a rate is one short expression whatever the steps. A gradient is scaled by the inverse
    of the Gram matrix of the rows inside their bounds, so that without cuts one step meets the targets, and halved until
    the errors fall; where that brings no progress, it is scaled by the tokens of each domain and a safe length. It ends
    when every domain is within TOLERANCE, after STEPS, or where no step brings progress, as the targets are out of reach.
    """
    y = np.zeros(len(P))
    reached, gram = _moments(with_rate(table), None)
    now = np.maximum(reached, 1e-9)
    scale = np.sqrt(now)
    safe = 1 / max(np.linalg.eigvalsh(gram / scale[:, None] / scale[None, :]).max(), 1e-9)
    loss = lambda x: float((np.square(x - targets) / now).sum())
    for _ in range(STEPS):
        if residual(reached, targets) <= TOLERANCE:
            break
        scaled, wrong = gram / scale[:, None] / scale[None, :], (reached - targets) / scale
        tries = [safe * wrong / scale]
        if np.trace(scaled) > 0:
            whole = np.linalg.solve(scaled + 1e-9 * np.trace(scaled) * np.eye(len(P)), wrong) / scale
            tries = [whole / 2**k for k in range(6)] + tries
        for step in tries:
            there, g = _moments(with_rate(table, y + step, most), most)
            if loss(there) < 0.99 * loss(reached):
                y, reached, gram = y + step, there, g
                break
        else:
            break
    return y, reached


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, multiples: dict[str, float] | None = None, budget: float | None = None, most: float | None = None, id_col: str = "doc_id", text_col: str = "text", sources: str | None = "source", key: str | None = None) -> DataFrame:
    """Per row: doc_id, source, n_tokens, posteriors (one column a domain), rate, copies, residual; with `key`, a column of docs, also that as key.

    residual is the greatest relative error of a domain's expected tokens, the same in every row: above TOLERANCE where
    the targets are out of reach. Targets are `weights` of `budget` tokens (by default as many as there are), or `multiples` of the tokens now expected
    in each domain; most: largest rate. copies = the whole part of the rate, and one more where a hash of the id falls
    below its fraction. Null texts have no tokens and the posteriors of a text without a known word; a null id stays
    null; repeated rows each get a row; without labels all texts have the same posteriors, without documents there are no rows.
    """
    model = fit_classifier(docs, labels, id_col, text_col)
    source = F.col(sources) if sources else F.lit(None).cast("string")
    keys = ["key"] if key else []
    t = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.col(text_col).alias("t"), *[F.col(key).alias(k) for k in keys])
    t = written(described(t, "t", model.lexicon, "doc_id", "source", *keys), "features")
    t = written(model.posteriors(t), "posteriors")
    now = expected(with_rate(t))
    if multiples:
        targets = now * np.array([multiples[d] for d in DOMAINS])
    else:
        weights = weights or WEIGHTS
        targets = np.array([weights[d] for d in DOMAINS]) / sum(weights.values()) * (budget or now.sum())
    direction, reached = fit_rates(t, targets, most)
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(31)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    t = with_rate(t, direction, most)
    return t.select("doc_id", "source", F.col("n").alias("n_tokens"), *[F.col(p).alias(d) for p, d in zip(P, DOMAINS, strict=True)], "rate", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"), F.lit(residual(reached, targets)).alias("residual"), *keys)


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document for the target weights of the four domains of quality and toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return mix(docs, labels)
