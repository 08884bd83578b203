"""Prose extraction, and the levels of texts the model has not seen."""

import json

import duckdb
import numpy as np
import pytest

from cairn.llm.prose import prose
from cairn.llm.reading import distributions, document_levels, fit, sentences

CELL = "# Head\n\nFirst line that\nis wrapped. Second one!\n\n- item one\n- item two\n\n$$x = y$$\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![p](a.png)\n\nSee [`x`](./y.csv).\n\n```\ncode here\n```\n"
WANT = ["First line that is wrapped.", "Second one!", "item one", "item two", "See  ."]


def notebook(**more):
    cells = [{"cell_type": "code", "metadata": {}, "source": ["print('not this one')"], "execution_count": 1, "outputs": [{"text": ["nor this"]}]}, {"cell_type": "markdown", "metadata": {}, "source": CELL.splitlines(keepends=True)}]
    return json.dumps({"cells": cells, **more}, indent=1)


PERCENT = "# %% In[1]\nx = 1\n\n# %% Out[1] result\n#> out\n\n# %% [markdown]\n" + "\n".join("# " + line for line in CELL.split("\n"))


@pytest.mark.parametrize("text,stated", [(notebook(), "json"), (notebook(), None), ("x" + notebook(), "json"), (notebook() + "é", "json"), (json.dumps(json.loads(notebook())), "json"), (PERCENT, "percent"), ("﻿zz" + PERCENT, None), (PERCENT.replace("\n", "\r\n"), "percent"), (CELL, "markdown"), (CELL, None)])
def test_layouts(text, stated):
    assert [" ".join(s.split()) for s in prose(text, stated)] == [" ".join(s.split()) for s in WANT]


def test_cut_off_texts():
    whole = notebook()
    for n in range(0, len(whole), 7):
        assert set(prose(whole[:n], "json")[:2]) <= {"First line that is wrapped.", *(("First line that is wrapped."[:k]) for k in range(40))} | set(WANT) | {"Second one!"[:k] for k in range(12)}
    assert prose(None) == prose("") == prose(" \n") == []


def labelled():
    return duckdb.connect().execute("SELECT lang, reading_level, passage FROM '/root/testdata/sf0.001/reading_passages.parquet' ORDER BY passage_id").fetchall()


def test_held_out_passages():
    rows, right = labelled(), 0
    for fold in range(4):
        model = fit([r for i, r in enumerate(rows) if i % 4 != fold])
        for lang, level, text in (r for i, r in enumerate(rows) if i % 4 == fold):
            _, d = distributions(model, [sentences(text)])
            right += model.classes[int(d[0].argmax())] == (lang, level)
    assert right / len(rows) > 0.9


def test_documents(spark):
    easy, hard = ([t for g, v, t in labelled() if g == "en" and v == level] for level in (1, 4))
    rows = [(1, " ".join(hard), "markdown"), (2, " ".join(easy), "markdown"), (3, None, None), (4, "", "json"), (5, " ".join(easy * 3) + " " + hard[0][:200], None), (1, " ".join(hard), "markdown")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, nb_format string")
    passages = spark.createDataFrame(labelled() + [(None, 1, "x"), ("en", None, "x"), ("en", 1, None)], "lang string, reading_level int, passage string")
    got = sorted((r["doc_id"], r["is_top"], r["language"]) for r in document_levels(df, passages).collect())
    assert got == [(1, True, "en"), (1, True, "en"), (2, False, "en"), (3, False, None), (4, False, None), (5, False, "en")]
    assert not any(r["is_top"] for r in document_levels(df, passages.limit(0)).collect())
    assert document_levels(df.limit(0), passages).count() == 0
    by = {r["doc_id"]: r["difficulty"] for r in document_levels(df, passages).collect()}
    assert by[1] > 3.5 and by[2] < 1.5 and np.isfinite(by[5])


def test_first_cell_beyond_any_prefix():
    """A cut-off object without a stated layout, whose first cell comes late."""
    from cairn.llm.prose import prose

    text = "A" * 9000 + '"}], "execution_count": 1}, {"cell_type": "markdown", "source": ["A plain sentence stands here."]}'
    assert prose(text) == ["A plain sentence stands here."]


def test_stray_characters_before_the_first_fence():
    from cairn.llm.prose import prose

    for stray in ("", "\u2014\u2026ok", "\U0001f4c8\U0001f389"):
        assert prose(stray + "```python\nx = 1\n```\n\nA plain sentence.\n", "markdown") == ["A plain sentence."]
        assert prose(stray + "# Title\n\nA plain sentence.\n", "markdown") == ["A plain sentence."]


def test_bounded_sample_of_sentences():
    from cairn.llm.reading import distributions, fit

    rows = [("en", 1 + k, " ".join(f"{w} {w} {w}{i}." for i in range(40))) for k, w in enumerate(("cat", "market", "epistemology")) for _ in range(4)]
    full, part = fit(rows), fit(rows, most=60)
    for _, level, text in rows[::4]:
        assert all(full.classes[int(distributions(m, [[text]])[1][0].argmax())][1] == level for m in (full, part))
