"""Problem 9: reading level of each document.

Method: smoothed unigram language models, one for each language and grade level,
trained on labelled texts; a document gets the level with the highest posterior
likelihood. Words and sentence marks are the unigrams. A model is smoothed with the
distribution of word shapes (script and length) of its own level, so that words unseen
in training still tell long words from short ones. The language of a document isn't
taken from any column: the posterior is over all language and level pairs, and a level
sums over the languages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hebrew points and accents, dropped from words.
POINTS = dict.fromkeys([*range(0x591, 0x5BE), 0x5BF, 0x5C1, 0x5C2, 0x5C4, 0x5C5, 0x5C7])
_POINTED = re.compile("[֑-ׇֽֿׁׂׅׄ]")
_MARKUP = re.compile(r"<[^<>]+>")
_UNIGRAM = re.compile(r"[^\W\d_]+|[.!?,]")
#: Word lengths from here on are one shape.
LONG = 14


def unigrams(text: str) -> list[str]:
    """Words in small letters and without points, and the marks ``. ! ? ,``; markup is left out."""
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if _POINTED.search(text):
        text = text.translate(POINTS)
    return _UNIGRAM.findall(text.lower())


def shape(word: str) -> str:
    """Script by the block of the first letter, and length; a mark is its own shape."""
    return f"{ord(word[0]) >> 8:x}:{min(len(word), LONG)}" if word[0].isalpha() else word


@dataclass(frozen=True)
class LevelModel:
    """Log-probabilities of words and of unseen words by shape, one column for each (language, level)."""

    classes: tuple[tuple[str, int], ...]
    words: dict[str, int]
    known: np.ndarray
    shapes: dict[str, int]
    unseen: np.ndarray
    strange: np.ndarray

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """(log-likelihood by class, number of unigrams)."""
        ids: list[int] = []
        ns: list[int] = []
        total = np.zeros(len(self.classes))
        count = 0
        for w, n in Counter(unigrams(text)).items():
            count += n
            i = self.words.get(w)
            if i is not None:
                ids.append(i)
                ns.append(n)
            else:
                s = self.shapes.get(shape(w))
                total = total + n * (self.strange if s is None else self.unseen[s])
        return (total + np.asarray(ns, float) @ self.known[ids] if ids else total), count


def train_levels(rows: list[tuple[str | None, int, str | None]], own: float = 0.7, alpha: float = 0.1) -> LevelModel:
    """From labelled (language, level, text): P(w | class) = own * frequency + (1 - own) * P(shape | class) / words of the shape."""
    counts: dict[tuple[str, int], Counter] = defaultdict(Counter)
    for lang, level, text in rows:
        if level is not None and text:
            counts[lang or "", int(level)].update(unigrams(text))
    classes = tuple(sorted(k for k, c in counts.items() if c))
    words = {w: i for i, w in enumerate(sorted({w for c in counts.values() for w in c}))}
    of_shape = Counter(map(shape, words))
    blocks = {s.split(":")[0] for s in of_shape if ":" in s}
    shapes = {s: i for i, s in enumerate(sorted({*of_shape, *(f"{b}:{n}" for b in blocks for n in range(1, LONG + 1))}))}
    by_shape = np.full((len(shapes), len(classes)), alpha)
    freq = np.zeros((len(words), len(classes)))
    for j, k in enumerate(classes):
        for w, n in counts[k].items():
            freq[words[w], j] = n
            by_shape[shapes[shape(w)], j] += n
    freq /= np.maximum(1, freq.sum(0))
    by_shape /= by_shape.sum(0)
    spread = by_shape / np.array([max(1, of_shape[s]) for s in shapes])[:, None] if shapes else by_shape
    back = (1 - own) * spread
    known = np.log(own * freq + back[[shapes[shape(w)] for w in words]]) if words else freq
    strange = np.log(back.min(0)) if shapes else np.zeros(len(classes))
    return LevelModel(classes, words, known, shapes, np.log(back), strange)


def labelled_sample(df: DataFrame, lang: str, level: str, text: str, most: int = 5_000) -> list[tuple]:
    """At most ``most`` labelled rows, the same at every run: those with the smallest hash of their text."""
    rows = df.select(F.col(lang).alias("a"), F.col(level).alias("b"), F.col(text).alias("c")).where("b is not null and c is not null")
    return [tuple(r) for r in rows.orderBy(F.xxhash64("c", "a", "b"), "c", "a", "b").limit(most).collect()]


def reading_levels(df: DataFrame, key: str, text: str, model: LevelModel) -> DataFrame:
    """(``key``, level, lang, posterior, n_unigrams) of every row.

    ``posterior`` is the share of the level in the posterior (equal priors), ``lang`` the
    language of the likeliest class. A null, empty or wordless text has null level, lang
    and posterior. Ties go to the lower level. Repeated rows keep theirs; an empty table
    gives an empty one; other columns aren't read. One pass, no shuffle.
    """
    named = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    kind = named.schema["key"].dataType.simpleString()
    levels = sorted({k[1] for k in model.classes})
    of_level = np.array([[c[1] == x for c in model.classes] for x in levels], bool)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t in b.column(1).to_pylist():
                s, n = model.scores(t) if t and levels else (None, 0)
                if not n:
                    out.append((None, None, None, n))
                    continue
                post = np.exp(s - s.max())
                share = of_level @ post
                k = int(np.argmax(share))
                out.append((levels[k], model.classes[int(np.argmax(s))][0], float(share[k] / post.sum()), n))
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in out], x) for i, x in enumerate(kinds)]], names=["key", "level", "lang", "posterior", "n_unigrams"])

    return named.mapInArrow(assign, f"key {kind}, level int, lang string, posterior double, n_unigrams int").withColumnRenamed("key", key)


def level_check(df: DataFrame, key: str, text: str, declared: str, model: LevelModel) -> DataFrame:
    """(``key``, declared, level): the declared level of each row beside the one its text has."""
    both = df.select(F.struct(F.col(key).alias("k"), F.col(declared).cast("int").alias("d")).alias("k"), F.col(text).alias("t"))
    return reading_levels(both, "k", "t", model).select(F.col("k.k").alias(key), F.col("k.d").alias("declared"), "level", "posterior")
