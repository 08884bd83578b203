"""Mixing against brute force; the classifier on sources that can be told apart."""

import numpy as np

from cairn.llm.encoding import tokenizer
from cairn.llm.mixing import mix, short_sources

DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def make(spark):
    rng = np.random.default_rng(3)
    words = {"alpha": "red blue green colour paint", "beta": "stock bond market price trade", "gamma": "river lake sea water rain"}
    rows = []
    for i in range(240):
        s = ["alpha", "beta", "gamma"][min(2, i % 5 // 2)]
        rows.append((i, " ".join(rng.choice(words[s].split(), rng.integers(5, 60))), [s, s.upper(), f" {s}\t", None][0 if i % 4 else i // 4 % 4]))
    rows += [(900, None, "alpha"), (901, "", "beta"), (902, "   ", None), (903, "other text", "nowhere"), (0, rows[0][1], rows[0][2])]
    return rows, [("Alpha ", 0.5, 2), ("beta", 0.3, 1), ("gamma", 0.15, 3), ("void", 0.05, 9), (None, 0.1, 1), ("nobody", None, None)]


def test_against_brute_force(spark):
    rows, targets = make(spark)
    enc = tokenizer()
    plan, report = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS), fill=True)
    got = {r["source"]: r for r in report.collect()}
    size = [len(enc.encode_ordinary(t or "")) for _, t, _ in rows]
    clean = [s.strip().lower() if s else None for _, _, s in rows]
    total = sum(size)
    want = set()
    for s, share, most in [("alpha", 0.5, 2), ("beta", 0.3, 1), ("gamma", 0.15, 3), ("void", 0.05, 9)]:
        own = sum(n for n, c in zip(size, clean) if c == s)
        assert (got[s]["tokens"], got[s]["capacity"], got[s]["total"]) == (own, most * own, total)
        if most * own < share * total:
            want.add(s)
    assert {r["source"] for r in short_sources(report).collect()} == want and "void" in want
    rows_out = plan.collect()
    assert len(rows_out) == len(rows)
    most = {"alpha": 2, "beta": 1, "gamma": 3, "nowhere": 0}
    assert all(0 <= r["rate"] <= (most[r["source"]] if r["source"] else 3) + 1e-9 and abs(r["repeats"] - r["rate"]) < 1 for r in rows_out)
    for s, share, most in [("alpha", 0.5, 2), ("beta", 0.3, 1), ("gamma", 0.15, 3)]:
        own = sum(n for n, c in zip(size, clean) if c == s)
        assert abs(got[s]["planned_tokens"] - min(share * total, most * own)) < 1e-6 * total  # own documents first, up to their repeats
        assert got[s]["expected_tokens"] >= got[s]["planned_tokens"] - 1e-6


def test_shares_of_the_mixture(spark):
    """Without filling, each source that has tokens reaches its share, the absent one's part shared out."""
    rows, targets = make(spark)
    plan, report = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS))
    got = {r["source"]: r for r in report.collect()}
    for s, share in (("alpha", 0.5), ("beta", 0.3), ("gamma", 0.15)):
        assert abs(got[s]["reached_share"] - share / 0.95) < 1e-3 and got[s]["planned_tokens"] <= got[s]["capacity"] + 1e-6
    assert any(abs(got[s]["planned_tokens"] - got[s]["capacity"]) < 1e-3 or got[s]["total"] * 0.999 < sum(g["planned_tokens"] for g in got.values()) for s in ("alpha", "beta", "gamma"))  # and the mixture could not be larger


def test_short_sources_follow_the_plan(spark):
    """A source counts as short only if the solved plan has used it up."""
    rows, targets = make(spark)
    report = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS), fill=True)[1]
    assert short_sources(report).count() > 0
    from pyspark.sql import functions as F

    assert short_sources(report.withColumn("least_rate", F.lit(0.0)).withColumn("max_repeats", F.lit(1))).count() == 0


def test_unlabelled_documents_find_their_source(spark):
    from cairn.llm.encoding import TOKENIZERS
    from cairn.llm.mixing import STEPS, clean_source, memberships
    from pyspark.sql import functions as F

    rows, _ = make(spark)
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text", clean_source(F.col("source")).alias("source"))
    model, members = memberships(docs, 100, "byte_bpe_50k", TOKENIZERS)
    found = members.filter("source is null").collect()
    right = [model.sources[int(np.argmax(r["p"]))] == ["alpha", "beta", "gamma"][min(2, r["doc_id"] % 5 // 2)] for r in found if r["doc_id"] < 240]
    assert len(right) >= 10 and np.mean(right) > 0.9 and model.accuracy > 0.9 > model.guessed
    assert all(sum(r["p"]) == STEPS for r in members.collect())


def test_extra_columns_do_not_matter(spark):
    from pyspark.sql import functions as F

    rows, targets = make(spark)
    extra = lambda df: df.select("*", *(F.lit("x").alias(c) for c in ("n_tokens", "ids", "p", "rate", "tokens", "place")))
    report = mix(extra(spark.createDataFrame(rows[:60], DOCS)), extra(spark.createDataFrame(targets, TARGETS)))[1]
    plain = mix(spark.createDataFrame(rows[:60], DOCS), spark.createDataFrame(targets, TARGETS))[1]
    near = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert near(report) == near(plain)


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame(make(spark)[1], TARGETS)
    plan, report = mix(docs, targets)
    assert plan.count() == 0 and report.count() == 5 and short_sources(report).count() == 0
    plan, report = mix(spark.createDataFrame([(1, "a b", None)], DOCS), targets.limit(0))
    assert plan.count() == 1 and report.count() == 0
