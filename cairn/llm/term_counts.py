"""Problem 1: how often every term occurs, and in how many records.

Last-seen counters.  Records are hash-partitioned; each task walks its tokens
in record order and keeps, per term, the occurrences, the number of records and
the record that was seen last.  A term's record number rises only when the
current record differs from the last one, so no set of records per term is ever
held, and a term that is in every record costs one counter, not one task.  The
counters of the tasks cover disjoint records, so they add up: only (term, two
numbers) per task is shuffled, never the tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.runtime import durable


class LastSeen:
    """Counters per term over records that arrive one after the other."""

    def __init__(self) -> None:
        self.slot: dict = {}
        self.occurrences = np.zeros(1024)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def add(self, terms: np.ndarray, distinct: list, record: np.ndarray, weight: np.ndarray) -> None:
        """``terms`` are positions in ``distinct``; ``record`` never falls."""
        slots = np.empty(len(distinct), np.int64)
        for i, t in enumerate(distinct):
            slots[i] = self.slot.setdefault(t, len(self.slot))
        if len(self.slot) > len(self.last):
            more = max(len(self.slot), 2 * len(self.last)) - len(self.last)
            self.occurrences = np.concatenate([self.occurrences, np.zeros(more)])
            self.records = np.concatenate([self.records, np.zeros(more, np.int64)])
            self.last = np.concatenate([self.last, np.full(more, -1, np.int64)])
        at = slots[terms]
        order = np.argsort(at, kind="stable")
        at, seen = at[order], record[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        before = np.empty(len(at), np.int64)
        before[1:] = seen[:-1]
        before[first] = self.last[at[first]]
        self.occurrences += np.bincount(at, weight[order], len(self.last))
        self.records += np.bincount(at[seen != before], minlength=len(self.last))
        end = np.ones(len(at), bool)
        end[:-1] = first[1:]
        self.last[at[end]] = seen[end]

    def rows(self) -> tuple[list, np.ndarray, np.ndarray]:
        n = len(self.slot)
        return list(self.slot), self.occurrences[:n], self.records[:n]

    def carried(self, record: int) -> LastSeen:
        """Empty counters that still know which terms ``record`` has had."""
        kept = LastSeen()
        kept.slot = {t: i for i, t in enumerate(t for t, s in self.slot.items() if self.last[s] == record)}
        size = max(1024, len(kept.slot))
        kept.occurrences, kept.records, kept.last = np.zeros(size), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        kept.last[: len(kept.slot)] = record
        return kept


def term_counts(records: DataFrame, record: str, terms: Column, weights: Column, term_type: str, most_terms: int = 1_000_000) -> DataFrame:
    """term, occurrences (sum of weights), records (in how many it occurs).

    ``records`` has one or more adjacent rows per ``record`` value in one
    partition (as after a group-by on it).  ``terms`` and ``weights`` are arrays
    of equal length; null terms and weights that are null or zero are no
    occurrence.  The row with a null term has the number of records in
    ``records``, those without any term included.  A task whose table exceeds
    ``most_terms`` hands its counters on and starts again between two records.
    """
    out = T.StructType([T.StructField("term", T._parse_datatype_string(term_type)), T.StructField("occurrences", T.DoubleType()), T.StructField("records", T.LongType())])
    schema = pa.schema([("term", pa.string() if term_type == "string" else pa.int64() if term_type == "bigint" else pa.int32()), ("occurrences", pa.float64()), ("records", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number, current, table = 0, -1, object(), LastSeen()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ordinal = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys):
                if k != current:
                    number, current, seen = number + 1, k, seen + 1
                ordinal[i] = number
            lists, values = batch.column(1), batch.column(2)
            of = np.repeat(ordinal, np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            coded = pc.dictionary_encode(lists.flatten())
            weight = np.asarray(pc.fill_null(values.flatten().cast(pa.float64()), 0.0), dtype=float)
            codes = np.asarray(pc.fill_null(coded.indices, -1))
            use = (codes >= 0) & (weight != 0)
            if use.any():
                table.add(codes[use], coded.dictionary.to_pylist(), of[use], weight[use])
            if len(table.slot) > most_terms:
                t, o, r = table.rows()
                yield pa.RecordBatch.from_arrays([pa.array(t, schema.field(0).type), pa.array(o), pa.array(r)], schema=schema)
                table = table.carried(number)
        t, o, r = table.rows()
        yield pa.RecordBatch.from_arrays([pa.array([*t, None], schema.field(0).type), pa.array([*o, 0.0]), pa.array([*r, seen], pa.int64())], schema=schema)

    partial = records.select(record, terms.alias("terms"), weights.alias("weights")).mapInArrow(count, out)
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("term is null or records > 0")


def mark_terms(counts: DataFrame, terms: DataFrame, rare: tuple[int, int] = (2, 1000), common: tuple[int, int] = (1, 2)) -> DataFrame:
    """term, total, records, mark of every term of ``counts`` and of ``terms``.

    ``mark`` is ``rare`` below the share ``rare`` of all records (terms that
    never occur included), ``common`` above ``common``, else null.  Shares are
    whole-number fractions, compared without rounding.  Without any record no
    term is rare or common.
    """
    counts = durable(counts)
    total = counts.filter("term is null").first()
    n = int(total["records"]) if total else 0
    known = terms.filter("term is not null").select("term", F.lit(0.0).alias("occurrences"), F.lit(0).cast("bigint").alias("records"))
    every = counts.filter("term is not null").unionByName(known).groupBy("term").agg(F.sum("occurrences").alias("total"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") * rare[1] < n * rare[0], "rare").when(F.col("records") * common[1] > n * common[0], "common")
    return every.withColumn("mark", mark)
