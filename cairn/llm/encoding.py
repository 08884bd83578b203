"""Problem 7: token ids of whole texts with a public byte-level BPE tokenizer.

Texts up to ``leaf`` characters are encoded as they are, in Arrow batches.
Longer ones are halved until the pieces fit, the pieces are spread over the
cluster and encoded in parallel, and neighbours are joined up the tree.  Two
encodings are joined by encoding again a window around the seam; the window
grows until its first token is one the left side has there and its last token
one the right side has, so what lies outside need not change:

* A window between two *cuts* is exact.  A cut is a place where the tokenizer's
  pattern never lets a word go on, whatever stands around it: between a
  non-space and a space, or between ASCII letters, digits and punctuation
  (an apostrophe before a letter excepted).
* Inside a run of one class that is longer than ``reach`` (a line of dashes, a
  block of one letter) there is no cut near the seam.  There the window is made
  of the run's own tokens and encoded as one word.  A sequence of BPE tokens is
  the encoding of its bytes if and only if every two neighbours are the encoding
  of theirs; a window whose outer tokens are those of the two sides leaves every
  pair valid.
* Where neither applies, the window grows to the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files are; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters with the Unicode property White_Space.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LEAF = 65_536
REACH = 4_096


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tokenizer of the vocabulary file, loaded once a worker process."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    if c in SPACES:
        return "s"
    if c >= "\x7f":
        return "?"
    return "a" if c.isalpha() else "d" if c.isdigit() else "p"


def is_cut(before: str, after: str) -> bool:
    """Does a word always end between these two characters?"""
    if after in SPACES:
        return before not in SPACES
    x, y = _kind(before), _kind(after)
    return x != y and x in "adp" and y in "adp" and not (before == "'" and y == "a")


class TreeEncoder:
    """Encodes texts of any length; ``leaf`` and ``reach`` as in the module's text."""

    def __init__(self, enc, leaf: int = LEAF, reach: int = REACH) -> None:
        self.enc, self.leaf, self.reach = enc, leaf, reach
        self.size = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.enc.encode_to_numpy(text, disallowed_special=()), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """By halves if the text is longer than a leaf."""
        if len(text) <= self.leaf:
            return self.plain(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def _last_cut(self, text: str, before: int) -> int:
        """The last cut before ``before``, at most ``reach`` back; -1 if there is none."""
        for p in range(min(before, len(text) - 1), max(0, before - self.reach), -1):
            if is_cut(text[p - 1], text[p]):
                return p
        return 0 if before <= self.reach else -1

    def _first_cut(self, text: str, after: int) -> int:
        for p in range(max(after, 1), min(len(text), after + self.reach)):
            if is_cut(text[p - 1], text[p]):
                return p
        return len(text) if after + self.reach >= len(text) else -1

    def _tokens_of(self, ids: np.ndarray, n_bytes: int, last: bool) -> int:
        """How many tokens at the end (or start) make up ``n_bytes``; -1 if they don't end there."""
        have, step = 0, 256
        side = ids[::-1] if last else ids
        for at in range(0, len(side), step):
            total = have + np.cumsum(self.size[side[at : at + step]])
            k = int(np.searchsorted(total, n_bytes))
            if k < len(total):
                return at + k + 1 if total[k] == n_bytes else -1
            have = int(total[-1])
        return 0 if n_bytes == 0 else -1

    def join(self, a: str, ids_a: np.ndarray, b: str, ids_b: np.ndarray) -> np.ndarray:
        """The encoding of ``a + b`` from those of ``a`` and ``b``."""
        if not a or not b:
            return ids_b if not a else ids_a
        run = self._join_run(a, ids_a, b, ids_b)
        if run is not None:
            return run
        lo, hi = len(a) - 1, 1
        while True:
            lo, hi = self._last_cut(a, lo), self._first_cut(b, hi)
            if lo < 0 or hi < 0:
                return self.plain(a + b)
            head, tail = a[lo:], b[:hi]
            drop_a = self._tokens_of(ids_a, len(head.encode()), True)
            drop_b = self._tokens_of(ids_b, len(tail.encode()), False)
            if drop_a >= 0 and drop_b >= 0:
                mid = self.plain(head + tail)
                left = lo == 0 or drop_a > 0 and mid[0] == ids_a[len(ids_a) - drop_a]
                right = hi == len(b) or drop_b > 0 and mid[-1] == ids_b[drop_b - 1]
                if left and right:
                    return np.concatenate([ids_a[: len(ids_a) - drop_a], mid, ids_b[drop_b:]])
            if lo == 0 and hi == len(b):
                return self.plain(a + b)
            lo, hi = max(lo - 1, 0), min(hi + 1, len(b))

    def _join_run(self, a: str, ids_a: np.ndarray, b: str, ids_b: np.ndarray) -> np.ndarray | None:
        """The join inside a long run of ASCII letters, digits or punctuation; null if there is none."""
        reach = self.reach
        if len(a) < reach or len(b) < reach or not (a[-1] == b[0] or _kind(a[-1]) == _kind(b[0]) != "?") or a[-1] in SPACES:
            return None
        kind = _kind(a[-1])
        if kind == "?" or any(_kind(c) != kind for c in a[-reach:]) or any(_kind(c) != kind for c in b[:reach]) or "'" in a[-reach:] or "'" in b[:reach]:
            return None
        k = 4
        while 2 * k < min(len(ids_a), len(ids_b)):
            left, right = ids_a[len(ids_a) - k :], ids_b[:k]
            if self.size[left].sum() >= reach or self.size[right].sum() >= reach:
                return None
            mid = np.asarray(self.enc._encode_single_piece(b"".join(map(self.enc.decode_single_token_bytes, [*left.tolist(), *right.tolist()]))), np.int32)
            if mid[0] == left[0] and mid[-1] == right[-1]:
                return np.concatenate([ids_a[: len(ids_a) - k], mid, ids_b[k:]])
            k *= 2
        return None


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of the tree, in order."""
    if len(text) <= leaf:
        return [text]
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


def _id_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


def _slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes: what is held beside the batch stays small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    at, have = 0, 0
    for i, n in enumerate(sizes):
        if have and have + n > most:
            yield at, i
            at, have = i, 0
        have += n
    if at < len(sizes):
        yield at, len(sizes)


def encode_texts(docs: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF, reach: int = REACH) -> DataFrame:
    """``keep`` and ``ids`` (array of token ids, no special tokens) of every row.

    Null and empty texts have an empty list.  Strings that look like special
    tokens are ordinary text.  Repeated rows stay repeated.  Other columns of
    ``docs`` are ignored; a kept column that is itself named ``ids`` becomes
    ``ids_kept``.
    """
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    return measured_texts(docs, text, keep, lambda kept, found: [_id_lists(found)], [ids], name, folder, leaf, reach).toDF(*_out_names(keep, "ids"))


def token_sizes(docs: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF, reach: int = REACH) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row: as ``encode_texts``, but only numbers leave the tasks."""
    size = T.StructField("n_tokens", T.IntegerType())
    return measured_texts(docs, text, keep, lambda kept, found: [pa.array([len(x) for x in found], pa.int32())], [size], name, folder, leaf, reach).toDF(*_out_names(keep, "n_tokens"))


def _out_names(keep: list[str], own: str) -> list[str]:
    return [*(f"{c}_kept" if c == own else c for c in keep), own]


def is_long(text: str, leaf: int = LEAF) -> Column:
    """Does this text go through the tree?"""
    return F.coalesce(F.length(F.col(text)), F.lit(0)) > leaf


def measured_texts(docs: DataFrame, text: str, keep: list[str], measure: Callable[[list[pa.Array], list[np.ndarray]], list[pa.Array]], fields: list[T.StructField], name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF, reach: int = REACH, long_docs: DataFrame | None = None) -> DataFrame:
    """``keep`` (as __k0, __k1, ...) and ``fields`` of every row: what ``measure`` makes of the kept columns and the token ids of some rows.

    ``long_docs``: the rows with long texts, where they have been set aside
    already; otherwise they take a second scan, which only measures lengths.
    """
    ids_type = T.ArrayType(T.IntegerType())
    named, keep = keep, [f"__k{i}" for i in range(len(keep))]  # inside, no name can clash
    kept = [T.StructField(k, docs.schema[c].dataType) for k, c in zip(keep, named)]
    out = T.StructType([*kept, T.StructField("ids", ids_type)])
    measured = T.StructType([*kept, *fields])
    n = len(keep)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(name, folder)
        for batch in batches:
            for lo, hi in _slices(batch.column(n)):
                part = batch.slice(lo, hi - lo)
                found = [np.asarray(enc.encode_to_numpy(t, disallowed_special=()), np.int32) if t else np.empty(0, np.int32) for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *measure(part.columns[:n], found)], names=measured.names)

    columns = [*(F.col(c).alias(k) for k, c in zip(keep, named)), F.col(text).alias("__text")]
    short = docs.filter(~is_long(text, leaf)).select(*columns).mapInArrow(encode, measured)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                pieces = halves(row.column(n + 1)[0].as_py(), leaf)
                for lo in range(0, len(pieces), 64):
                    some = pieces[lo : lo + 64]
                    copies = [pa.concat_arrays([row.column(0)] * len(some))] + [pa.concat_arrays([c] * len(some)) for c in row.columns[1 : n + 1]]
                    yield pa.RecordBatch.from_arrays([*copies, pa.array(some, pa.string()), pa.array(range(lo, lo + len(some)), pa.int32())], names=["__row", *keep, "__text", "__piece"])

    pieces_type = T.StructType([T.StructField("__row", T.LongType()), *kept, T.StructField("__text", T.StringType()), T.StructField("__piece", T.IntegerType())])
    encoded_type = T.StructType([T.StructField("__row", T.LongType()), *kept, T.StructField("ids", ids_type), T.StructField("__text", T.StringType()), T.StructField("__piece", T.IntegerType())])

    def encode_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(name, folder)
        for batch in batches:
            for lo, hi in _slices(batch.column(n + 1)):
                part = batch.slice(lo, hi - lo)
                found = [np.asarray(enc.encode_to_numpy(t, disallowed_special=()), np.int32) for t in part.column(n + 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: n + 1], _id_lists(found), part.column(n + 1), part.column(n + 2)], names=["__row", *keep, "ids", "__text", "__piece"])

    def up_the_tree(table: pa.Table) -> pa.Table:
        tree = TreeEncoder(tokenizer(name, folder), leaf, reach)
        table = table.sort_by("__piece")
        level = list(zip(table.column("__text").to_pylist(), (np.asarray(x.values, dtype=np.int32) for x in table.column("ids"))))
        while len(level) > 1:  # any neighbours may be joined; pairs keep the texts' copies few
            level = [(x[0][0] + x[1][0], tree.join(*x[0], *x[1])) if len(x) > 1 else x[0] for x in (level[i : i + 2] for i in range(0, len(level), 2))]
        return pa.Table.from_arrays([*(table.column(k).slice(0, 1) for k in keep), _id_lists([level[0][1]])], names=[*keep, "ids"])

    def of_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(x.values, dtype=np.int32) for x in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *measure(batch.columns[:n], found)], names=measured.names)

    long = (
        (docs if long_docs is None else long_docs).filter(is_long(text, leaf)).select(F.monotonically_increasing_id().alias("__row"), *columns)
        .mapInArrow(split, pieces_type)
        .repartition("__row", "__piece")
        .mapInArrow(encode_pieces, encoded_type)
        .groupBy("__row")
        .applyInArrow(up_the_tree, out)
    )
    return short.unionByName(long.mapInArrow(of_ids, measured))
