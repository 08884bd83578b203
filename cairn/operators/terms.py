"""Document-term operators in long form: (doc_id, term_index, value), zeros absent.

A document without terms has no row in long form; operators that must keep it
take the table of documents as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import numbered


def document_frequency(entries: DataFrame) -> DataFrame:
    """term_index, doc_freq: documents with a non-zero entry."""
    return entries.filter("value <> 0").groupBy("term_index").agg(F.count_distinct("doc_id").alias("doc_freq"))


def document_frequency_filled(entries: DataFrame, size: int) -> DataFrame:
    """The same for every index below ``size``, 0 where a term never occurs."""
    every = entries.sparkSession.range(size).select(F.col("id").cast("int").alias("term_index"))
    return every.join(document_frequency(entries), "term_index", "left").select("term_index", F.coalesce("doc_freq", F.lit(0).cast("bigint")).alias("doc_freq"))


def term_moments(entries: DataFrame) -> DataFrame:
    """term_index, sum_values, sum_squares, count over the non-zero entries."""
    x = F.col("value")
    return entries.filter("value <> 0").groupBy("term_index").agg(F.sum(x).alias("sum_values"), F.sum(x * x).alias("sum_squares"), F.count(F.lit(1)).alias("count"))


def sample_variance(total: Column, squares: Column, n: Column) -> Column:
    """Sample variance from sums, not below 0; 0 for fewer than two values."""
    return F.when(n > 1, F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1)).otherwise(F.lit(0.0))


def term_statistics(entries: DataFrame, size: int | None = None) -> DataFrame:
    """term_index, mean, variance, std_dev, sum_values, sum_squares, count of every index below ``size``.

    Mean and variance are over the non-zero entries.  ``size`` defaults to the
    greatest index plus one.
    """
    if size is None:
        size = (entries.agg(F.max("term_index")).first()[0] or -1) + 1
    every = entries.sparkSession.range(size).select(F.col("id").cast("int").alias("term_index"))
    m = every.join(term_moments(entries), "term_index", "left").select("term_index", F.coalesce("sum_values", F.lit(0.0)).alias("sum_values"), F.coalesce("sum_squares", F.lit(0.0)).alias("sum_squares"), F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
    var = sample_variance(F.col("sum_values"), F.col("sum_squares"), F.col("count"))
    return m.select("term_index", F.when(F.col("count") > 0, F.col("sum_values") / F.col("count")).otherwise(0.0).alias("mean"), var.alias("variance"), F.sqrt(var).alias("std_dev"), "sum_values", "sum_squares", "count")


def frequency_percentiles(freqs: DataFrame, low: float = 0.05, high: float = 0.95, empty: tuple[int, int] = (1, 1)) -> DataFrame:
    """One row (low_freq, high_freq): the frequencies at position trunc(n p) of the sorted ones (the last at the end).

    Only distinct frequencies with their numbers are ordered, which are few.
    Without terms the row is ``empty``.
    """
    if not 0 <= low <= high <= 1:
        raise ValueError("0 <= low <= high <= 1 must hold")
    c = freqs.groupBy("doc_freq").agg(F.count(F.lit(1)).alias("c"))
    up = c.withColumn("upto", F.sum("c").over(Window.orderBy("doc_freq"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col("doc_freq")))
    return up.agg(F.coalesce(at(low), F.lit(empty[0]).cast("bigint")).alias("low_freq"), F.coalesce(at(high), F.lit(empty[1]).cast("bigint")).alias("high_freq"))


def percentile_details(freqs: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: total_terms, low_freq, high_freq, kept, removed_low, removed_high, removed, kept_share, least, most, mean."""
    b = frequency_percentiles(freqs, low, high).first()
    f = F.col("doc_freq")
    n = F.count(F.lit(1))
    kept = F.count_if((f >= b["low_freq"]) & (f <= b["high_freq"]))
    return freqs.agg(
        n.alias("total_terms"), F.lit(b["low_freq"]).alias("low_freq"), F.lit(b["high_freq"]).alias("high_freq"), kept.alias("kept"), F.count_if(f < b["low_freq"]).alias("removed_low"),
        F.count_if(f > b["high_freq"]).alias("removed_high"), (n - kept).alias("removed"), (kept / F.nullif(n, F.lit(0))).alias("kept_share"), F.min(f).alias("least"), F.max(f).alias("most"), F.avg(f).alias("mean"),
    )


def percentile_report(freqs: DataFrame, documents: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``percentile_details`` with the bounds, the median, the reduction in percent, the number of documents and a recommendation; null numbers without terms."""
    middle = numbered(freqs.select("doc_freq", "term_index"), ["doc_freq", "term_index"], "r", "bigint")
    d = percentile_details(freqs, low, high).first()
    median = middle.filter(F.col("r") == d["total_terms"] // 2).select(F.col("doc_freq").alias("median"))
    text = F.format_string("keep terms in %d to %d documents", F.col("low_freq"), F.col("high_freq"))
    out = freqs.sparkSession.createDataFrame([d], percentile_details(freqs, low, high).schema).withColumn("low", F.lit(low)).withColumn("high", F.lit(high)).withColumn("documents", F.lit(documents).cast("bigint"))
    return out.join(median, F.lit(True), "left").withColumn("reduction", (1 - F.col("kept_share")) * 100).withColumn("recommendation", text)


def with_vectors(entries: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """doc_id, features (VEC of ``size``) of every document: its entries under their old indices, an empty vector where none is left."""
    e = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_index", "value"))).alias("e"))
    part = lambda name, kind: F.coalesce(F.transform("e", lambda x: x[name]), F.array()).cast(f"array<{kind}>")
    vec = F.struct(F.lit(0).cast("tinyint").alias("kind"), F.lit(size).alias("dim"), part("term_index", "int").alias("idx"), part("value", "double").alias("vals"))
    return documents.select("doc_id").join(e, "doc_id", "left").select("doc_id", vec.alias("features"))


def kept_counts(freqs: DataFrame, low: int, high: int) -> DataFrame:
    """One row: terms within the inclusive bounds, and outside."""
    inside = F.col("doc_freq").between(low, high)
    return freqs.agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("removed"))


def valid_terms(entries: DataFrame, min_df: int, max_df: int, min_variance: float) -> DataFrame:
    """term_index, new_index, doc_freq, variance of the terms within the bounds, renumbered in order of their index.

    Frequency and variance come from one aggregate.  Without valid terms the
    result is empty, with its schema.
    """
    if min_df < 0 or max_df < min_df:
        raise ValueError("0 <= min_df <= max_df must hold")
    x = F.col("value")
    s = entries.filter("value <> 0").groupBy("term_index").agg(F.count_distinct("doc_id").alias("doc_freq"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(F.lit(1)).alias("n"))
    ok = s.select("term_index", "doc_freq", sample_variance(F.col("s"), F.col("q"), F.col("n")).alias("variance")).filter(F.col("doc_freq").between(min_df, max_df) & (F.col("variance") >= min_variance))
    return numbered(ok, ["term_index"], "new_index").select("term_index", "new_index", "doc_freq", "variance")


def valid_terms_by_ratio(entries: DataFrame, min_df: int, max_ratio: float, min_variance: float, documents: int) -> DataFrame:
    """The same with max_df = trunc(documents * ratio)."""
    if not 0 < max_ratio <= 1:
        raise ValueError("the ratio must lie in (0, 1]")
    return valid_terms(entries, min_df, max(min_df, int(documents * max_ratio)), min_variance)


def filter_compact(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """doc_id, term_index (renumbered), value: only valid terms; documents left without any are gone."""
    return entries.filter("value <> 0").join(valid.select("term_index", "new_index"), "term_index").select("doc_id", F.col("new_index").alias("term_index"), "value")


def filter_same_size(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """The entries of valid terms under their old indices."""
    return entries.filter("value <> 0").join(valid.select("term_index"), "term_index", "left_semi").select("doc_id", "term_index", "value")


def with_all_documents(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, n_terms of every document, 0 for those left empty."""
    n = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n_terms", F.lit(0).cast("bigint")).alias("n_terms"))


def term_filter(entries: DataFrame, min_df: int, min_variance: float, max_df: int | None = None, max_ratio: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(filtered entries, valid terms) by an absolute or a relative bound on the document frequency."""
    if (max_df is None) == (max_ratio is None):
        raise ValueError("give either max_df or max_ratio")
    if max_ratio is not None:
        documents = entries.select("doc_id").distinct().count()
        valid = valid_terms_by_ratio(entries, min_df, max_ratio, min_variance, documents)
    else:
        valid = valid_terms(entries, min_df, max_df, min_variance)
    return filter_compact(entries, valid), valid


def alphabetical_dictionary(words: DataFrame, column: str = "original_word") -> DataFrame:
    """term_index, word: the distinct words numbered from 0 in order; null is no word."""
    w = words.filter(F.col(column).isNotNull()).select(F.col(column)).distinct()
    return numbered(w, [column], "term_index").select("term_index", column)


def code_dictionary(codes: DataFrame, word: str = "original_word", code: str = "term_code") -> DataFrame:
    """term_index, word, code: distinct pairs numbered from 0 by the number in the code, then by word."""
    d = codes.filter(F.col(word).isNotNull() & F.col(code).isNotNull()).select(word, code).distinct()
    number = F.substring(code, 2, 20).try_cast("bigint")
    return numbered(d, [number, code, word], "term_index").select("term_index", word, code)


def wide_to_entries(chunks: Sequence[tuple[DataFrame, str]], dictionary: DataFrame, word: str = "original_word") -> DataFrame:
    """doc_id, term_index, value from wide chunks (table, id column): one column per word.

    Only numeric columns the dictionary knows are read, in one pass per chunk;
    other types and unreadable cells count as 0.  Values of one (document, term)
    are added, and only documents that all chunks have are kept.
    """
    known = {r[word] for r in dictionary.select(word).distinct().collect()}  # column names: as many as the tables are wide
    parts = []
    for at, (df, key) in enumerate(chunks):
        columns = [f.name for f in df.schema.fields if f.name != key and f.name in known]
        cells = df.select(F.col(key).cast("string").alias("doc_id"), *(F.coalesce((F.trim(c) if dict(df.dtypes)[c] == "string" else F.col(c)).try_cast("double"), F.lit(0.0)).alias(c) for c in columns))
        long = cells.unpivot("doc_id", columns, word, "value") if columns else cells.select("doc_id", F.lit(None).cast("string").alias(word), F.lit(0.0).alias("value"))
        parts.append(long.select("doc_id", word, "value", F.lit(at).alias("chunk")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    complete = union.groupBy("doc_id").agg(F.count_distinct("chunk").alias("n")).filter(F.col("n") == len(chunks)).select("doc_id")
    named = union.filter("value <> 0").join(dictionary.select("term_index", word), word).groupBy("doc_id", "term_index").agg(F.sum("value").alias("value"))
    out = named.filter("value <> 0")
    return out if len(chunks) == 1 else out.join(complete, "doc_id", "left_semi")


def l2_normalised(entries: DataFrame) -> DataFrame:
    """Each document's values divided by their Euclidean norm; a document of zeros stays as it is."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id")))
    return entries.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.col("value")))


def document_lengths(entries: DataFrame) -> DataFrame:
    """doc_id, n_terms: non-zero entries."""
    return entries.filter("value <> 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))


def length_summary(lengths: DataFrame) -> DataFrame:
    """One row: documents, mean, stddev (sample), least, most."""
    return lengths.agg(F.count(F.lit(1)).alias("documents"), F.avg("n_terms").alias("mean"), F.stddev_samp("n_terms").alias("stddev"), F.min("n_terms").alias("least"), F.max("n_terms").alias("most"))


def vocabulary_size(documents: DataFrame, size: Column) -> int:
    """The size of the first document's vector; 0 without documents."""
    row = documents.select(size.alias("n")).filter("n is not null").first()
    return int(row["n"]) if row else 0


def density_percent(lengths: DataFrame, size: int) -> DataFrame:
    """doc_id, n_terms, density in percent of ``size``."""
    return lengths.withColumn("density", F.col("n_terms") * 100.0 / float(size))


def month_list(first: str, last: str, spark) -> DataFrame:
    """month ('yyyy-MM') from ``first`` to ``last``, both included; empty if they are in the wrong order."""
    return spark.range(1).select(F.explode(F.expr(f"case when date'{first}-01' <= date'{last}-01' then sequence(date'{first}-01', date'{last}-01', interval 1 month) else array() end")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
