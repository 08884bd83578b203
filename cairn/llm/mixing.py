"""Problem 8: mixing sources to target shares of the tokens.

1. Soft membership: a document with a source belongs to it; for one without, a
   naive Bayes classifier over hashed token ids, fitted on a bounded sample of
   the labelled documents, gives the chance of each source, in steps of
   1 / ``STEPS``.  How far the text is trusted against the sources' frequencies
   is chosen on held-out documents.  Sample and long texts are set aside in a
   first pass over the texts; a second one gives sizes and memberships.
2. Rates: every document gets a rate between 0 and its allowed repeats such that
   the expected tokens per source match the goals in the least-squares sense, by
   projected gradient descent over *bins*: documents of equal membership have
   equal rates, and memberships in steps make few bins.  Documents with a source
   descend first, those without fill what is left open.
3. Repeats: rates are rounded to whole repeats by a hash of the document, so
   that a rate of 2.3 gives 3 repeats to about 30 % of the documents.

Goals are shares of the mixture: its size is the greatest at which each source
that has tokens can give its share (``fill`` off), or the token total of all
documents, of which short sources then give what they can (``fill`` on).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairn.llm.encoding import TOKENIZERS, is_long, measured_texts, tokenizer
from cairn.runtime import durable, release

BUCKETS = 4096
#: Memberships are multiples of one over this.
STEPS = 20
#: Trusts tried on the held-out documents.
TRUSTS = np.array([0.0, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0])


def clean_source(c: Column) -> Column:
    """A source without outer blanks and case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def clean_targets(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats: one row per source; negative or null numbers count as 0."""
    return (
        targets.select(clean_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
        .filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )


def _log_chances(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum(1, keepdims=True))


@dataclass
class Membership:
    """The classifier: ``trust`` scales a text's mean log-likelihood per token; 0 leaves the priors."""

    sources: list[str]
    priors: np.ndarray
    chance: np.ndarray
    trust: float = 0.0
    #: of the held-out documents: their number, the share whose source is the likeliest, and that share by the priors alone
    held: int = 0
    accuracy: float = math.nan
    guessed: float = math.nan

    def steps(self, bags: list[np.ndarray]) -> np.ndarray:
        """The memberships of texts (bucket of each token), in whole steps that add up to ``STEPS``."""
        fit = np.array([self.chance[:, b].mean(1) if len(b) else np.zeros(len(self.sources)) for b in bags]).reshape(len(bags), len(self.sources))
        z = self.priors + self.trust * fit
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * STEPS
        low = np.floor(p)
        rank = np.argsort(np.argsort(low - p, axis=1, kind="stable"), axis=1)  # the greatest remainders first
        return (low + (rank < (STEPS - low.sum(1))[:, None])).astype(int)


def fit_membership(chosen: DataFrame, per_source: dict[str, int], name: str, folder: str) -> Membership:
    """The classifier of the sampled documents (source, text, held): those not held train, the others choose the trust."""
    sources = sorted(per_source)
    if not sources:
        return Membership([], np.zeros(0), np.zeros((0, BUCKETS)))

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(name, folder)
        for batch in batches:
            counts = [np.unique(np.asarray(enc.encode_to_numpy(t or "", disallowed_special=())) % BUCKETS, return_counts=True) for t in batch.column(1).to_pylist()]
            lists = [pa.array([x[k].tolist() for x in counts], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["source", "held", "bucket", "n"])

    bag = durable(chosen.select("source", "text", "held").mapInArrow(bags, "source string, held boolean, bucket array<int>, n array<int>"))
    entries = bag.filter("not held").select("source", F.explode(F.arrays_zip("bucket", "n")).alias("e")).groupBy("source", "e.bucket").agg(F.sum("e.n").alias("n"))
    counts = np.zeros((len(sources), BUCKETS))
    for r in entries.collect():
        counts[sources.index(r["source"]), r["bucket"]] = r["n"]
    chance = _log_chances(counts)
    priors = np.log(np.array([per_source[s] for s in sources], float) / sum(per_source.values()))

    def tried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, right, n = np.zeros(len(TRUSTS)), np.zeros(len(TRUSTS), np.int64), 0
        for batch in batches:
            for source, at, k in zip(*(c.to_pylist() for c in batch.columns)):
                fit = chance[:, at] @ np.array(k) / sum(k) if at else np.zeros(len(sources))
                z = priors + np.outer(TRUSTS, fit)
                z -= z.max(1, keepdims=True)
                own = sources.index(source)
                loss -= (z - np.log(np.exp(z).sum(1, keepdims=True)))[:, own]
                right += z.argmax(1) == own
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(TRUSTS)), pa.int32()), pa.array(loss), pa.array(right), pa.array([n] * len(TRUSTS), pa.int64())], names=["k", "loss", "right", "n"])

    seen = {r["k"]: r for r in bag.filter("held").select("source", "bucket", "n").mapInArrow(tried, "k int, loss double, right bigint, n bigint").groupBy("k").agg(F.sum("loss").alias("loss"), F.sum("right").alias("right"), F.sum("n").alias("n")).collect() if r["n"]}
    release(bag)
    if not seen:
        return Membership(sources, priors, chance)
    best = min(seen, key=lambda k: (seen[k]["loss"], k))
    return Membership(sources, priors, chance, float(TRUSTS[best]), seen[0]["n"], seen[best]["right"] / seen[best]["n"], seen[0]["right"] / seen[0]["n"])


def memberships(docs: DataFrame, sample: int, name: str, folder: str) -> tuple[Membership, DataFrame]:
    """(classifier, doc_id, source, n_tokens, p (steps for each source), of every document (doc_id, text, source)).

    About ``sample`` documents per source train the classifier and as many are
    held out, chosen by hash: the bound on what is fitted.
    """
    per_source = {r["source"]: r["n"] for r in docs.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for s in per_source for x in (s, min(1.0, 2 * sample / per_source[s])))) if per_source else F.create_map().cast("map<string,double>")
    place = F.pmod(F.xxhash64("doc_id", F.lit("membership")), F.lit(1_000_003)) / 1_000_003.0
    placed = docs.withColumn("__at", F.when(F.col("text").isNotNull(), place / share[F.col("source")]))
    aside = durable(placed.filter((F.col("__at") < 1) | is_long("text")))
    model = fit_membership(aside.filter("__at < 1").withColumn("held", F.col("__at") >= 0.5), per_source, name, folder)
    one_hot = {s: [STEPS * (k == i) for k in range(len(model.sources))] for i, s in enumerate(model.sources)}

    def measure(kept: list[pa.Array], found: list[np.ndarray]) -> list[pa.Array]:
        sources = kept[1].to_pylist()
        p = [one_hot.get(s) for s in sources]
        open_ = [i for i, x in enumerate(p) if x is None]
        if open_ and model.sources:
            for i, x in zip(open_, model.steps([found[i] % BUCKETS for i in open_]).tolist()):
                p[i] = x
        return [pa.array([len(x) for x in found], pa.int32()), pa.array([x or [] for x in p], pa.list_(pa.int32()))]

    fields = [T.StructField("n_tokens", T.IntegerType()), T.StructField("p", T.ArrayType(T.IntegerType()))]
    members = durable(measured_texts(docs, "text", ["doc_id", "source"], measure, fields, name, folder, long_docs=aside).toDF("doc_id", "source", "n_tokens", "p"))
    release(aside)
    return model, members


def fit_rates(members: DataFrame, sources: list[str], goals: dict[str, float], caps: dict[str, int], tolerance: float = 1e-5) -> DataFrame:
    """source, p, rate of every bin: projected gradient descent on the squared gaps between expected and goal tokens.

    The gradient is scaled per source by the tokens of the bins that move, at
    rate 1; as memberships add up to 1, a step never overshoots, the loss falls
    with every step, and the descent ends when it falls by less than
    ``tolerance`` of itself.  Bins of a source move first.
    """
    cap = sum((F.col("p")[i] * float(caps.get(s, 0)) for i, s in enumerate(sources)), F.lit(0.0)) / STEPS
    bins = members.groupBy("source", "p").agg(F.sum("n_tokens").alias("t")).withColumn("cap", F.coalesce(cap, F.lit(0.0)))
    bins = durable(bins.withColumn("rate", F.when(F.col("source").isNotNull(), F.least(F.lit(1.0), "cap")).otherwise(0.0)))
    goal = np.array([goals.get(s, 0.0) for s in sources])
    part = lambda i: F.col("p")[i] / STEPS
    tokens = lambda by: [F.coalesce(F.sum(part(i) * F.col("t") * by), F.lit(0.0)).alias(f"s{i}") for i in range(len(sources))]
    if not sources:
        return bins.select("source", "p", "rate")
    now = np.array(bins.agg(*tokens(F.col("rate"))).first(), float)
    for moving in (F.col("source").isNotNull(), F.col("source").isNull()):
        full = np.array(bins.filter(moving).agg(*tokens(F.lit(1.0))).first(), float)
        before = math.inf
        while True:
            gap = np.where(full > 0, (now - goal) / np.maximum(full, 1.0), 0.0)
            loss = float((gap**2 * full).sum())
            if before - loss <= tolerance * loss or loss <= 1e-12 * max(goal.sum(), 1.0):
                break
            before = loss
            step = sum((part(i) * float(gap[i]) for i in range(len(sources))), F.lit(0.0))
            seen = Observation()
            new = bins.withColumn("rate", F.when(moving, F.least("cap", F.greatest(F.lit(0.0), F.col("rate") - step))).otherwise(F.col("rate")))
            new = durable(new.observe(seen, *tokens(F.col("rate"))))
            release(bins)
            bins, now = new, np.array([seen.get[f"s{i}"] for i in range(len(sources))], float)
    return bins.select("source", "p", "rate")


def mix(docs: DataFrame, targets: DataFrame, sample: int = 300, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, fill: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plan, report).

    plan: doc_id, source, n_tokens, rate, repeats of every document (one without
    a source is used at its expected memberships, where the sources' own
    documents leave a gap; one of a source without a target not at all).
    report, per source of ``targets``: target_share, max_repeats, documents,
    tokens, capacity (tokens with every document used ``max_repeats`` times),
    total (tokens of all documents), goal_tokens, planned_tokens (of its own
    documents at their rates), least_rate (of its own documents), expected_tokens
    (memberships included), reached_share (of the mixture), filled_share (of
    ``total``).  A source without documents has zeros and a null rate; without
    ``fill`` the other sources share out its part in proportion.  Empty and null
    texts have no tokens.  Repeated rows are documents of their own.
    """
    docs = docs.select("doc_id", "text", clean_source(F.col("source")).alias("source"))
    wanted = clean_targets(targets)
    target_of = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in wanted.collect()}  # one row per source to be mixed
    model, members = memberships(docs, sample, name, folder)
    sources = model.sources
    own = {r["source"]: r for r in members.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).collect()}
    total = sum(r["tokens"] or 0 for r in own.values())
    room = {s: (own[s]["tokens"] or 0) * most for s, (share, most) in target_of.items() if s in own and share > 0}
    if fill:
        goals = {s: share * total for s, (share, _) in target_of.items()}
    else:
        able = {s: target_of[s][0] for s in room if room[s] > 0}
        shares = {s: x / sum(able.values()) for s, x in able.items()}
        size = min([float(total), *(room[s] / x for s, x in shares.items())])
        goals = {s: shares.get(s, 0.0) * size for s in target_of}
    rates = fit_rates(members, sources, goals, {s: most for s, (_, most) in target_of.items()})
    lucky = F.pmod(F.xxhash64("doc_id", F.lit("repeats")), F.lit(1_000_003)) / 1_000_003.0
    r = rates.select(F.col("source").alias("__s"), F.col("p").alias("__p"), "rate")
    planned = members.join(r, F.col("source").eqNullSafe(F.col("__s")) & (F.col("p") == F.col("__p"))).drop("__s", "__p")
    planned = planned.withColumn("repeats", (F.floor("rate") + F.when(lucky < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    plan = planned.select("doc_id", "source", "n_tokens", "rate", "repeats")

    bins = durable(planned.groupBy("source", "p").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.max("rate").alias("rate")))
    of_own = bins.filter("source is not null").select("source", "documents", "tokens", (F.col("tokens") * F.col("rate")).alias("planned_tokens"), F.col("rate").alias("least_rate"))
    soft = [F.coalesce(F.sum(F.col("p")[i] / STEPS * F.col("tokens") * F.col("rate")), F.lit(0.0)).alias(f"s{i}") for i in range(len(sources))]
    expected = dict(zip(sources, bins.agg(*soft).first())) if sources else {}
    mixture = float(bins.agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0] or 0.0)
    of = lambda values: F.coalesce(F.create_map(*(F.lit(x) for s, v in values.items() for x in (s, float(v))))[F.col("source")], F.lit(0.0)) if values else F.lit(0.0)
    zero = F.lit(0).cast("bigint")
    report = wanted.join(of_own, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("tokens", zero).alias("tokens"),
        (F.coalesce("tokens", zero) * F.col("max_repeats")).alias("capacity"), F.lit(int(total)).cast("bigint").alias("total"), of(goals).alias("goal_tokens"),
        F.coalesce("planned_tokens", F.lit(0.0)).alias("planned_tokens"), "least_rate", of(expected).alias("expected_tokens"),
        (of(expected) / F.lit(max(mixture, 1.0))).alias("reached_share"), (of(expected) / F.lit(max(float(total), 1.0))).alias("filled_share"),
    )
    return plan, report


def short_sources(report: DataFrame) -> DataFrame:
    """The sources that a filled plan leaves short: each of their documents is used ``max_repeats`` times, and they still miss their goal."""
    full = F.coalesce("least_rate", F.col("max_repeats").cast("double")) >= F.col("max_repeats")
    return report.filter(full & (F.col("planned_tokens") < F.col("goal_tokens"))).select("source")
