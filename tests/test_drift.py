"""Schema drift against a brute-force comparison, and the ingestion's edge cases."""

import collections
import json
import re

import pytest
from pyspark.sql import functions as F

from cairn.sources.drift import ingest, schema_changes

COLUMNS = "file_id bigint, series_id int, file_path string, file_month string, loaded_at timestamp, row_no int, record string"
SPARSE = re.compile(r"\((\d+),\[([^\]]*)\],\[([^\]]*)\]\)")


def kind(v):
    if v is None:
        return None
    return {str: "string", bool: "boolean", int: "integer", float: "fraction", list: "array", dict: "object"}[type(v)]


def plain(v):
    if isinstance(v, str):
        if m := SPARSE.fullmatch(v):
            i, x = ([float(y) for y in m[k].split(",")] if m[k] else [] for k in (2, 3))
            return ("v", *sorted((int(a), b) for a, b in zip(i, x) if b))
        try:
            return float(v)
        except ValueError:
            return v
    if isinstance(v, list):
        return ("v", *((i, float(x)) for i, x in enumerate(v) if x))
    if isinstance(v, dict):
        return ("v", *sorted((i, float(x)) for i, x in zip(v["indices"], v["values"]) if x))
    return float(v)


def brute(rows):
    files = collections.defaultdict(list)
    for file_id, series, month, record in rows:
        try:
            v = json.loads(record)
        except (ValueError, TypeError):
            continue
        if isinstance(v, dict):
            files[series, month, file_id].append(v)
    out, series = [], collections.defaultdict(list)
    for s, month, f in sorted(files):
        series[s].append(f)

    def id_field(records):
        hits = collections.Counter(k for r in records for k, v in r.items() if re.fullmatch(r"\d{6,}", str(v)))
        return "submission_id" if "submission_id" in hits else hits.most_common(1)[0][0]

    by_id = {k[2]: v for k, v in files.items()}
    for s in series:
        for old, new in zip(series[s], series[s][1:]):
            a, b = by_id[old], by_id[new]
            at = {float(r[id_field(a)]): r for r in a if r.get(id_field(a)) is not None}
            to = {float(r[id_field(b)]): r for r in b if r.get(id_field(b)) is not None}
            both = at.keys() & to.keys()
            fa, fb = {k for r in a for k in r}, {k for r in b for k in r}
            kinds = lambda rs, k: {kind(r.get(k)) for r in rs} - {None}
            gone, come = sorted(fa - fb), sorted(fb - fa)
            for x in list(gone):
                for y in list(come):
                    pairs = [tuple(None if r.get(k) is None else plain(r[k]) for r, k in ((at[i], x), (to[i], y))) for i in both]
                    if any(p != (None, None) for p in pairs) and all(p == q for p, q in pairs):
                        gone.remove(x), come.remove(y)
                        out.append((new, "renamed", x, y))
                        if kinds(a, x) != kinds(b, y) and kinds(a, x) and kinds(b, y):
                            out.append((new, "retyped", x, y))
                        break
            out += [(new, "removed", x, "") for x in gone] + [(new, "added", "", y) for y in come]
            out += [(new, "retyped", x, x) for x in fa & fb if kinds(a, x) and kinds(b, x) and kinds(a, x) != kinds(b, x)]
    return sorted(out)


def test_against_brute_force(spark):
    raw = spark.read.parquet("/root/testdata/sf0.01/finaltable_wide_raw.parquet")
    rows = [tuple(r) for r in raw.select("file_id", "series_id", "file_month", "record").collect()]
    got = [tuple(r) for r in schema_changes(raw).select("file_id", "change_kind", "old_field", "new_field").collect()]
    assert sorted(got) == brute(rows)


def frame(spark, rows):
    return spark.createDataFrame([(f, s, "p", m, None, i, r) for i, (f, s, m, r) in enumerate(rows)], COLUMNS)


def test_changes_and_dirt(spark):
    rows = [
        (1, 1, "2011-01", '{"submission_id":"2000001","a":1,"v":{"type":0,"size":3,"indices":[1],"values":[2.0]},"gone":null}'),
        (1, 1, "2011-01", '{"submission_id":"2000002","a":2,"v":{"type":0,"size":3,"indices":[],"values":[]}}'),
        (1, 1, "2011-01", '{"submission_id":"2000002","a":2,"v":{"type":0,"size":3,"indices":[],"values":[]}}'),
        (1, 1, "2011-01", "#"), (1, 1, "2011-01", None), (1, 1, "2011-01", "[1]"),
        (9, 1, "2011-03", '{"id":2000001,"A":1.0,"w":[0.0,2.0,0.0],"new":null}'),
        (9, 1, "2011-03", '{"id":2000002,"A":2.0,"w":"(3,[0],[0.0])"}'),
        (5, 2, "2011-03", '{"submission_id":"2000001"}'),
        (6, 2, "2011-04", "{broken"),
    ]
    got = {tuple(r) for r in schema_changes(frame(spark, rows)).select("file_id", "change_kind", "old_field", "new_field").collect()}
    assert got == {
        (9, "renamed", "submission_id", "id"), (9, "retyped", "submission_id", "id"), (9, "renamed", "a", "A"), (9, "retyped", "a", "A"),
        (9, "renamed", "v", "w"), (9, "retyped", "v", "w"), (9, "removed", "gone", ""), (9, "added", "", "new"),
    }


def test_empty(spark):
    empty = frame(spark, [(1, 1, "2011-01", "{}")]).limit(0)
    assert schema_changes(empty).count() == 0 and ingest(empty).count() == 0


def test_ingest_promotes_and_rescues(spark):
    rows = [
        (1, 1, "2011-01", '{"submission_id":"2000001","features":[0.0,1.5],"x":{"y":1}}'),
        (2, 1, "2011-02", '{"sub":2000001,"vec":"(2,[1],[1.5])","x":null}'),
        (2, 1, "2011-02", '{"sub":2000002,"vec":"broken"}'),
    ]
    got = {(r["file_id"], r["row_no"]): r for r in ingest(frame(spark, rows)).withColumn("rescued", F.to_json("rescued")).collect()}
    assert got[1, 0]["submission_id"] == got[2, 1]["submission_id"] == "2000001"
    assert got[1, 0]["features"]["vals"] == [0.0, 1.5] and got[2, 1]["features"]["idx"] == [1]
    assert json.loads(got[1, 0]["rescued"]) == {"x": '{"y":1}'} and json.loads(got[2, 1]["rescued"]) == {"x": "null"}
    assert got[2, 2]["features"] is None and json.loads(got[2, 2]["rescued"]) == {"vec": '"broken"'}


@pytest.mark.parametrize("text,same", [("1", True), ("1.0", True), ('"1"', True), ('"1x"', False), ("true", False)])
def test_numbers_compare_as_numbers(spark, text, same):
    rows = [(1, 1, "2011-01", '{"submission_id":"2000001","a":1}'), (2, 1, "2011-02", '{"submission_id":"2000001","b":%s}' % text)]
    kinds = {r["change_kind"] for r in schema_changes(frame(spark, rows)).collect()}
    assert ("renamed" in kinds) == same


def test_approvals(spark):
    """Only listed fields are promoted; a target's own name needs no approval."""
    rows = [(1, 1, "2011-01", '{"submission_id":"2000001","features":[0.0,1.5]}'), (2, 1, "2011-02", '{"sub":2000001,"vec":[0.0,1.5]}'), (3, 2, "2011-02", '{"sub":2000001}')]
    listed = spark.createDataFrame([(1, "sub", "submission_id")], "series_id int, field string, target string")
    got = {r["file_id"]: r for r in ingest(frame(spark, rows), listed).withColumn("rescued", F.to_json("rescued")).collect()}
    assert got[1]["submission_id"] == got[2]["submission_id"] == "2000001" and got[3]["submission_id"] is None
    assert got[2]["features"] is None and "vec" in got[2]["rescued"] and "sub" in got[3]["rescued"]
    kinds = {tuple(r) for r in schema_changes(frame(spark, rows), listed).select("file_id", "change_kind", "old_field", "new_field").collect()}
    assert (2, "renamed", "submission_id", "sub") in kinds and (2, "renamed", "features", "vec") in kinds


def test_changes_follow_the_ingested_table(spark, monkeypatch):
    """The report reads the table that ingestion makes: what is not rescued is not compared."""
    from cairn.sources import drift

    real = drift.landed
    monkeypatch.setattr(drift, "landed", lambda raw: real(raw).withColumn("rescued", F.map_filter("rescued", lambda k, v: k != "gone")))
    rows = [(1, 1, "2011-01", '{"submission_id":"2000001","gone":1}'), (2, 1, "2011-02", '{"submission_id":"2000001"}')]
    assert schema_changes(frame(spark, rows)).count() == 0
    monkeypatch.undo()
    assert schema_changes(frame(spark, rows)).count() == 1
