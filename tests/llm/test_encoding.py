"""Tree encoding against encoding at one stroke."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cairn.llm.encoding import TOKENIZERS, TreeEncoder, encode_texts, token_sizes, tokenizer

WORDS = st.sampled_from(["a", "ab", "the", " ", "  ", "\n", "\r\n", "\t", "'", "'s", "'ll", "!", "==", "--", "1", "23", "é", "ß", "漢字", "🙂", "‍", "\xa0", "　", "\x1c", "<|endoftext|>", "x" * 9, "=" * 17, "7" * 11, " " * 13, "aB" * 8])
TEXT = st.lists(WORDS, max_size=60).map("".join) | st.text(max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 24), st.sampled_from([4, 8, 4096]))
def test_tree_is_exact(text, leaf, reach):
    enc = tokenizer()
    assert TreeEncoder(enc, leaf, reach).encode(text).tolist() == enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "abc", "-", "=", "-=", "7", "12", "the", "ing", "#", "."]), st.integers(20, 120)), min_size=1, max_size=3), st.integers(16, 60))
def test_long_runs(parts, leaf):
    text = "".join(w * n for w, n in parts)
    enc = tokenizer()
    assert TreeEncoder(enc, leaf, 16).encode(text).tolist() == enc.encode_ordinary(text)


def test_windows_stay_small():
    """A long run of one letter, whose halves keep in step, and base64 are joined without encoding them again."""
    enc = tokenizer()
    for text in ("a" * 262_144, "iVBORw0KGgo" * 30_000, "漢" * 3000 + "\n" + "字" * 3000):
        tree = TreeEncoder(enc, 1024, 100)
        seen = []
        plain = tree.plain
        tree.plain = lambda t: seen.append(len(t)) or plain(t)  # noqa: B023
        assert tree.encode(text).tolist() == enc.encode_ordinary(text)
        assert sum(seen) < 1.5 * len(text) or "漢" in text


def test_rows(spark):
    rows = [(1, "x", "hello <|endoftext|> world"), (2, None, None), (3, "y", ""), (4, "z", " \r\n"), (1, "x", "hello <|endoftext|> world"), (None, "long", "ab cd " * 500), (None, "long", "ab cd " * 500), (6, "long", "=" * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, ids_of string, text string")
    got = sorted((r["doc_id"] or 0, r["ids_of"] or "", list(r["ids"])) for r in encode_texts(df, "text", ["doc_id", "ids_of"], leaf=256, reach=64).collect())
    enc = tokenizer()
    assert got == sorted((a or 0, b or "", enc.encode_ordinary(t or "")) for a, b, t in rows)
    assert encode_texts(df.limit(0), "text", ["doc_id"]).count() == 0
    clash = df.withColumnRenamed("ids_of", "ids").withColumnRenamed("doc_id", "__row")
    same = encode_texts(clash, "text", ["__row", "ids"], leaf=256, reach=64)
    assert same.columns == ["__row", "ids_kept", "ids"]
    assert sorted((r["__row"] or 0, r["ids_kept"] or "", list(r["ids"])) for r in same.collect()) == got
    sizes = token_sizes(clash.withColumn("n_tokens", F.lit(1)), "text", ["__row", "n_tokens"], leaf=256, reach=64)
    assert sizes.columns == ["__row", "n_tokens_kept", "n_tokens"] and sorted(r["n_tokens"] for r in sizes.collect()) == sorted(len(g[2]) for g in got)


def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    import duckdb

    texts = [r[0] for r in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    enc = tokenizer()
    for text, e in zip(texts, other.encode_batch(texts, add_special_tokens=False)):
        assert np.array_equal(e.ids, TreeEncoder(enc, 500, 64).encode(text))
