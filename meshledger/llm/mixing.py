"""Mixing documents to target domain weights, in DataFrame functions only.

A naive Bayes classifier over hashed words, learned from a labelled table, gives every document soft
membership in each domain. A document with n tokens and posteriors p is then a vector x = n p of
expected tokens by domain. Nonnegative rates r, one per document, shall make the weighted sum of all
x equal the target totals. They are fitted by projected gradient steps on the squared residual,
measured by the inverse of M = sum x x' over the documents whose rate is above zero, the others
being held by their bound:

    r <- max(0, r + x' inv(M) (target - sum r x))

Both sums are one distributed aggregate per step; only vectors and matrices over the few domains are
on the driver. The steps so far are one expression of x, so nothing is written between them. They end
when the totals match; a fit that cannot match them says so by its residual.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm import common

#: Words are hashed to so many features; their weights are broadcast.
FEATURES, SMOOTHING = 1 << 16, 0.5
#: Most steps, and the residual, as a share of the largest target, at which a fit is done.
STEPS, TOLERANCE = 60, 1e-9
#: Most labelled documents that the classifier is fitted on; their ids and domains are broadcast.
LABELLED = 20_000
#: Repeats of one row that are written from one array; rows with more are dealt first.
COPIES = 1_000

#: Domains of the driver's labels, and the share of all tokens each shall have.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END"
TARGETS = {"good": 0.93, "poor": 0.06, "toxic": 0.01}
#: The target total as a multiple of the tokens there are.
BUDGET = 1.1


def words(text: Column) -> Column:
    """Array of the words of a text; a text without words has none."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), common.ASCII_SPACE), lambda w: w != "")


def _feature(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(FEATURES)).cast("int")


def features(rows: DataFrame) -> DataFrame:
    """(rank, key, feature) of every word of ``rows`` (rank, key, text)."""
    return rows.select("rank", "key", F.explode(words(F.col("text"))).alias("word")).select("rank", "key", _feature(F.col("word")).alias("feature"))


def log_odds(rows: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """(feature, w1 ... wk): per domain the log probability of a feature, less the mean over domains.

    At most FEATURES rows. Features that no labelled document has are absent, that is zero.
    """
    # at most LABELLED rows of labels, so texts stay where they are
    marked = rows.join(F.broadcast(labels.withColumnRenamed("id", "label_id")), F.col("id") == F.col("label_id")).select("text", "domain")
    seen = marked.select("domain", F.explode(words(F.col("text"))).alias("word")).groupBy(_feature(F.col("word")).alias("feature")).agg(
        *[F.count(F.when(F.col("domain") == d, True)).alias(f"n{k}") for k, d in enumerate(domains)])
    seen = common.store(seen, "domain-words")
    totals = seen.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(domains))]).first()
    logs = [F.log((F.col(f"n{k}") + F.lit(SMOOTHING)) / F.lit((totals[k] or 0) + SMOOTHING * FEATURES)) for k in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(domains)
    return seen.select("feature", *[(x - mean).alias(f"w{k}") for k, x in enumerate(logs)])


def memberships(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, key, n_tokens, p0 ... pk) of every document.

    ``labels`` has (id, domain); rows without either do not count, and of more than LABELLED ids those
    of smallest hash are learned from. The sum of log odds is divided by
    the root of the number of words, so that long texts stay soft. Without any label all domains are
    as likely as each other.
    """
    rows = common.texts(docs, id_col, text_col)
    labels = labels.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    labels = labels.orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    labels = common.store(labels, "domain-labels")
    known = {r.domain: r.n for r in labels.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = [np.log((known.get(d, 0) + 1) / (sum(known.values()) + len(domains))) for d in domains]
    weights = log_odds(rows, labels, domains)
    k = range(len(domains))
    # one row per document comes out of each task: its words are next to each other in the scan
    sums = (features(rows).join(F.broadcast(weights), "feature", "left").groupBy("rank", "key")
            .agg(F.count("*").alias("n"), *[F.sum(F.coalesce(f"w{i}", F.lit(0.0))).alias(f"s{i}") for i in k]))
    # rows that repeat id and text were added up: their sums and counts grow alike
    copies = rows.groupBy("rank", "key").agg(F.first("id").alias("id"), F.count("*").alias("copies"))
    found = copies.join(sums, ["rank", "key"], "left").select(
        "id", "rank", "key", "copies", F.coalesce(F.col("n") / F.col("copies"), F.lit(0)).cast("long").alias("n_tokens"),
        *[(F.coalesce(F.col(f"s{i}") / F.col("copies") / F.sqrt(F.col("n") / F.col("copies")), F.lit(0.0)) + float(prior[i])).alias(f"s{i}") for i in k])
    most = F.greatest(*[F.col(f"s{i}") for i in k]) if len(domains) > 1 else F.col("s0")
    powers = [F.exp(F.col(f"s{i}") - most) for i in k]
    return found.select("id", "rank", "key", "copies", "n_tokens", *[(p / sum(powers[1:], powers[0])).alias(f"p{i}") for i, p in enumerate(powers)])


def fit_rates(found: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[Column, float]:
    """Expression of the rate over the columns n_tokens and p0 ... pk of ``found``, and the residual.

    ``targets`` are token totals by domain. Rows with ``copies`` count so often. Domains no document
    can belong to are left as they are; with no tokens at all every rate is 1. The residual is the
    largest miss of a total as a share of the largest target: up to ``tolerance`` if the fit is done,
    more if the totals cannot be reached (a target for a domain nothing belongs to) or the steps ran out.
    """
    k = range(len(targets))
    x = [F.col("n_tokens") * F.col(f"p{i}") for i in k]
    want = np.array(targets, float)
    rate, best = F.lit(1.0), (F.lit(1.0), np.inf)
    for _ in range(steps + 1):
        free = F.col("copies") * F.when(rate > 0, 1.0).otherwise(0.0)
        sums = found.agg(*[F.sum(F.col("copies") * rate * x[i]).alias(f"t{i}") for i in k],
                         *[F.sum(free * x[i] * x[j]).alias(f"m{i}_{j}") for i in k for j in k if i <= j]).first()
        miss = want - np.array([float(sums[f"t{i}"] or 0) for i in k])
        residual = float(np.abs(miss).max() / max(np.abs(want).max(), 1.0)) if len(want) else 0.0
        if residual < best[1]:
            best = rate, residual
        if residual <= tolerance:
            break
        inverse = np.linalg.pinv(np.array([[float(sums[f"m{min(i, j)}_{max(i, j)}"] or 0) for j in k] for i in k]), rcond=1e-10, hermitian=True)
        step = inverse @ miss
        rate = F.greatest(F.lit(0.0), rate + sum((x[i] * float(step[i]) for i in k[1:]), x[0] * float(step[0])))
    return best


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float = BUDGET,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, rank, key, n_tokens, one column of posteriors per domain, rate, residual.

    ``labels`` has (id, domain), ``targets`` the share of tokens of each domain; the total is
    ``budget`` times the tokens there are. Null and empty texts have no tokens and keep rate 1, as
    nothing is gained by changing it. An empty table gives no rows.
    """
    domains = sorted(targets)
    found = common.store(memberships(docs, labels, domains, id_col, text_col), "memberships")
    total = found.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] or 0
    scale = budget * total / (sum(targets.values()) or 1.0)
    rate, residual = fit_rates(found, [targets[d] * scale for d in domains])
    rated = found.select("id", "rank", "key", "n_tokens", "copies", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)],
                         rate.alias("rate"), F.lit(residual).alias("residual"))
    times = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("copy")
    few = rated.where(F.col("copies") <= COPIES).select("*", times(F.col("copies")))
    # a row that repeats very often is first cut into parts of COPIES repeats, which are dealt over the tasks
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))).alias("part")
    many = rated.where(F.col("copies") > COPIES).select("*", part).repartition("key", "part")
    many = many.select("*", times(F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES))).drop("part")
    return few.unionByName(many).drop("copy", "copies")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), F.expr(DOMAIN).alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"), _labels(spark, sf_dir), TARGETS)
    return mixed.drop("rank", "key").withColumnRenamed("id", "doc_id")


def resample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as its rate says, columns unchanged.

    The whole part of the rate is a number of copies; the rest is one more copy with that
    probability, by a hash of id and text, so a repeated run gives the same rows. A document without
    words has rate 1.
    """
    mixed = mix(docs, _labels(spark, sf_dir), TARGETS)
    chance = F.pmod(F.xxhash64("rank", "key", F.lit("copies")), F.lit(1 << 30)) / F.lit(1 << 30)
    whole = F.floor("rate").cast("int")
    times = common.store(mixed.select(F.col("rank").alias("mix_rank"), F.col("key").alias("mix_key"),
                                      (whole + (chance < F.col("rate") - whole).cast("int")).alias("mix_times")).distinct(), "copies")
    rank = F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NO_ID))
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    joined = docs.join(times.where("mix_times > 0"), (rank == times["mix_rank"]) & (key == times["mix_key"]))
    again = joined.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.explode(F.sequence(F.lit(1), F.col("mix_times"))))
    return again.select("doc.*")
