"""Problem 9: how demanding the prose of each document is.

Every sentence is classified by a regularised softmax over (language, level)
classes on word and character features, and the sentence distributions are
averaged, weighted by words, into the document's; the document's difficulty is
its expected level, calibrated on the graded passages.

The model is fitted on at most ``MOST_SENTENCES`` sentences of at most
``most_passages`` graded passages (the table is small; of a larger one a part is
chosen by hash: the bound of the classifier's sample) and is a plain array that
every task receives.  A word's part in the scores depends
on the word alone, so each task scores a word once and a sentence is a mean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.prose import WORD, prose, sentences

BUCKETS = 1 << 13
#: Shares of a word's unit weight: the word itself, its character groups.
WORD_SHARE, GROUP_SHARE = 0.5, 0.5
LENGTHS = 8
#: Sentences a model is fitted on at most: 4,000 rows of 8,201 numbers are 131 MB.
MOST_SENTENCES = 4_000


def word_features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of one word: itself and its groups of 3 to 5 characters.

    Every word has the same total weight, so a few long words don't outvote the
    frame of a sentence.
    """
    w = f"<{word}>"
    groups = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)] or [w]
    at = np.array([zlib.crc32(b"w" + word.encode("utf-8", "replace")) % BUCKETS] + [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in groups])
    return at, np.array([WORD_SHARE] + [GROUP_SHARE / len(groups)] * len(groups))


def length_features(n_words: int) -> np.ndarray:
    """Soft place of a sentence's length on a logarithmic scale."""
    x = np.log2(max(n_words, 1)) * (LENGTHS - 1) / 6
    return np.maximum(0, 1 - np.abs(np.arange(LENGTHS) - x))


@dataclass
class LevelModel:
    """``classes`` are (language, level); ``weights`` has a row per feature, one per length and a bias."""

    classes: list[tuple[str, int]]
    weights: np.ndarray
    #: per language: level (ascending) and the raw difficulty its passages have, as measured on passages left out
    scale: dict[str, tuple[list[float], list[float]]]
    #: per language: the share of the highest level from which a text counts as of that level
    cut: dict[str, float]

    @property
    def levels(self) -> np.ndarray:
        return np.array([float(level) for _, level in self.classes])

    @property
    def languages(self) -> list[str]:
        return sorted({lang for lang, _ in self.classes})

    def word_scores(self, word: str) -> np.ndarray:
        at, share = word_features(word)
        return (self.weights[at] * share[:, None]).sum(0)


def words_of(sentence: str) -> list[str]:
    return [w.lower() for w in WORD.findall(sentence)]


def _row(words: list[str]) -> np.ndarray:
    x = np.zeros(BUCKETS + LENGTHS + 1, np.float32)
    for w in words:
        at, share = word_features(w)
        np.add.at(x, at, (share / len(words)).astype(np.float32))
    x[BUCKETS : BUCKETS + LENGTHS] = length_features(len(words))
    x[-1] = 1
    return x


def _softmax(x: np.ndarray, truth: np.ndarray, n_classes: int, penalty: float, steps: int) -> np.ndarray:
    """Weights of the L2-regularised softmax; classes count alike whatever their sizes."""
    y = np.eye(n_classes)[truth]
    balance = (1 / y.sum(0).clip(1))[truth]
    balance /= balance.sum()
    gram = (x @ x.T).astype(float)  # the weights lie in the span of the rows: w = x' a
    v = np.ones(len(gram))
    for _ in range(60):  # power iteration; the margin of a tenth covers what it lacks
        v = gram @ v
        v /= np.linalg.norm(v)
    a, momentum = np.zeros_like(y), np.zeros_like(y)
    rate = 1.0 / (1.1 * float(v @ gram @ v) * balance.max() / 2 + penalty)
    for step in range(steps):
        ahead = a + step / (step + 3) * momentum
        z = gram @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - rate * ((p - y) * balance[:, None] + penalty * ahead)
        momentum, a = new - a, new
    return x.T @ a


def fit(labelled: list[tuple[str, int, str]], penalty: float = 1e-4, steps: int = 400, most: int = MOST_SENTENCES) -> LevelModel:
    """The model of (language, level, passage) rows.

    Null or wordless passages are left out.  The calibration uses passages that
    the scoring model has not seen (two halves, each scored by the other's
    model); a class with a single passage is scored by the full model.  A text
    counts as of the highest level from the share halfway between those of the
    passages of the highest level and of the next, one half at most.  Of more
    than ``most`` sentences as many of each class are used, chosen by hash.
    """
    passages = sorted((lang, int(level), text) for lang, level, text in labelled if text and lang and level is not None and any(map(words_of, sentences(text))))
    classes = sorted({(lang, level) for lang, level, _ in passages})
    if not classes:
        return LevelModel([], np.zeros((BUCKETS + LENGTHS + 1, 0)), {}, {})
    rows, truth, part = [], [], []
    turn: dict[tuple[str, int], int] = {}
    for lang, level, text in passages:
        half = turn[lang, level] = 1 - turn.get((lang, level), 1)
        for words in filter(None, map(words_of, sentences(text))):
            rows.append(words)
            truth.append(classes.index((lang, level)))
            part.append(half)
    use = list(range(len(rows)))
    if len(rows) > most:
        use.sort(key=lambda i: zlib.crc32(f"{i}:{' '.join(rows[i])}".encode("utf-8", "replace")))
        use = [i for c in range(len(classes)) for i in [i for i in use if truth[i] == c][: most // len(classes)]]
    x, y, part = np.array([_row(rows[i]) for i in use], np.float32), np.array([truth[i] for i in use]), np.array([part[i] for i in use])
    model = LevelModel(classes, _softmax(x, y, len(classes), penalty, steps), {}, {})
    singles = {c for c in classes if sum(p[:2] == c for p in passages) < 2}
    halves = [model] * 2 if singles == set(classes) else [LevelModel(classes, _softmax(x[part != h], y[part != h], len(classes), penalty, steps), {}, {}) for h in (0, 1)]
    seen: dict[tuple[str, int], list[tuple[float, float]]] = {c: [] for c in classes}
    turn.clear()
    for lang, level, text in passages:
        half = turn[lang, level] = 1 - turn.get((lang, level), 1)
        _, d = distributions(model if (lang, level) in singles else halves[half], [sentences(text)])
        top = max(v for g, v in classes if g == lang)
        seen[lang, level].append((float(d[0] @ model.levels), float(d[0][model.levels >= top].sum())))
    for lang in model.languages:
        own = [v for g, v in classes if g == lang]
        raw = np.maximum.accumulate([float(np.mean([e for e, _ in seen[lang, v]])) + 1e-9 * k for k, v in enumerate(own)])
        model.scale[lang] = ([float(v) for v in own], raw.tolist())
        high = float(np.mean([t for _, t in seen[lang, own[-1]]]))
        low = float(np.mean([t for _, t in seen[lang, own[-2]]])) if len(own) > 1 else 0.0
        model.cut[lang] = min((high + low) / 2, 0.5)
    return model


def distributions(model: LevelModel, texts: list[list[str]], cache: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per list of sentences: its words, and its class distribution (rows of zeros without words)."""
    cache = {} if cache is None else cache
    n_classes = len(model.classes)
    total, words_in = np.zeros((len(texts), n_classes)), np.zeros(len(texts), np.int64)
    scores, counts, owner = [], [], []
    known: dict[tuple[str, ...], int] = {}
    of, sizes = [], []
    for d, sents in enumerate(texts):
        for s in sents:
            words = tuple(words_of(s))
            if not words:
                continue
            k = known.get(words)
            if k is None:
                k = known[words] = len(scores)
                z = np.zeros(n_classes)
                for w in words:
                    v = cache.get(w)
                    if v is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        v = cache[w] = model.word_scores(w)
                    z = z + v
                scores.append(z / len(words))
                counts.append(len(words))
            of.append(k)
            owner.append(d)
            sizes.append(len(words))
    if scores and n_classes:
        n = np.array(counts)
        z = np.array(scores) + np.array([length_features(k) for k in range(int(n.max()) + 1)])[n] @ model.weights[BUCKETS:-1] + model.weights[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w = np.array(sizes)
        np.add.at(total, owner, p[of] * w[:, None])
    np.add.at(words_in, owner, sizes)
    return words_in, total / np.maximum(words_in, 1)[:, None]


def document_levels(docs: DataFrame, passages: DataFrame, most_passages: int = 5_000) -> DataFrame:
    """doc_id, words, language, difficulty, top_share, is_top of every row of ``docs``.

    ``words`` counts the words of the prose; ``language`` is the one the prose
    is written in, by the model (the document's own label is not used);
    ``difficulty`` is the calibrated level on the passages' scale; ``is_top``
    says whether the text as a whole is as demanding as the passages of that
    language's highest level.  A text without words has null values and
    ``is_top`` false; so has every text if there are no passages.  At most
    ``most_passages`` passages are used, chosen by hash where there are more.
    Repeated rows stay repeated.
    """
    rows = passages.select("lang", "reading_level", "passage").orderBy(F.xxhash64("passage", "lang"), "lang", "reading_level").limit(most_passages).collect()
    model = fit([tuple(r) for r in rows])
    out = T.StructType([
        docs.schema["doc_id"], T.StructField("words", T.IntegerType()), T.StructField("language", T.StringType()),
        T.StructField("difficulty", T.DoubleType()), T.StructField("top_share", T.DoubleType()), T.StructField("is_top", T.BooleanType()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one array whose size the constants above fix

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LevelModel = shared.value
        cache: dict[str, np.ndarray] = {}
        langs, levels = np.array([g for g, _ in m.classes]), m.levels
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, stated = part.column(1).to_pylist(), part.column(2).to_pylist()
                n, dist = distributions(m, [prose(t, f) for t, f in zip(texts, stated)], cache)
                language, difficulty, share, is_top = [], [], [], []
                for words, d in zip(n, dist):
                    if not words or not m.classes:
                        language.append(None), difficulty.append(None), share.append(None), is_top.append(False)
                        continue
                    lang = max(m.languages, key=lambda g: d[langs == g].sum())
                    own, raw = m.scale[lang]
                    top = float(d[levels >= own[-1]].sum())
                    language.append(lang), difficulty.append(float(np.interp(d @ levels, raw, own))), share.append(top), is_top.append(top >= m.cut[lang])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int32()), pa.array(language, pa.string()), pa.array(difficulty, pa.float64()), pa.array(share, pa.float64()), pa.array(is_top, pa.bool_())], names=out.names
                )

    return docs.select("doc_id", "text", "nb_format").mapInArrow(score, out)
