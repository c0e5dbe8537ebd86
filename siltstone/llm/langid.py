r"""Language identification of words, spans and texts.

Model: for each language, log-probabilities of the character trigrams of its
words (with word marks) and of its whole words, and the scripts that its
letters come from.  Prediction: a word's script, by code-point ranges, narrows
the languages to those that write it; each candidate gets the mean
log-probability of the word's features, times a word weight; Viterbi over the
words with a penalty for each switch labels them, and runs of one label are
the spans of a mixed text.  A language that does not write a word's script is
no candidate for it, whatever its neighbours are; a script that no language
writes is no evidence for any.  The text's language is the one with the most
letters; the score is its share of all letters times its probability, against
the other languages, over the words that are labelled with it.

Nearly all texts are of one language, and that is proved without the full
search: if no run of words gains more than half the penalty over the best
single language, no path with switches can win (each needs at least one
switch for two such runs).  Only the other texts are searched.

The model is fitted on a bounded sample: up to ``rows`` training texts of each
language, those of the least hash, with texts that occur under two languages
left out.  All features of the sample are kept.  The model is arrays: sorted
64-bit feature hashes and, for each, the languages that have it with their
log-probabilities; so its size is that of the sample's distinct pairs of
feature and language, 14 bytes each.

Defined results: null texts and texts without a letter are ``und`` with score
0; rows without a language teach nothing; without any training row all
predictions are ``und``; repeated rows are rows of their own; ties go to the
language that sorts first; texts of any length are read whole; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spans
from .common import few, read, ship, written

UNKNOWN = "und"
#: Upper ends of script ranges (code points, end exclusive) and the scripts (fixed values, from the Unicode blocks).
SCRIPTS = [
    (0x0041, ""), (0x0250, "latin"), (0x0370, "latin"), (0x0400, "greek"), (0x0530, "cyrillic"), (0x0590, "armenian"), (0x0600, "hebrew"),
    (0x0780, "arabic"), (0x0900, "other"), (0x0980, "devanagari"), (0x0A00, "bengali"), (0x0E00, "indic"), (0x0E80, "thai"), (0x10A0, "other"),
    (0x1100, "georgian"), (0x1200, "hangul"), (0x1380, "ethiopic"), (0x1E00, "other"), (0x1F00, "latin"), (0x2000, "greek"), (0x3040, "other"),
    (0x30A0, "kana"), (0x3100, "kana"), (0x3130, "other"), (0x3190, "hangul"), (0x3400, "other"), (0xA000, "han"), (0xAC00, "other"), (0xD7B0, "hangul"),
    (0xFB00, "han"), (0x20000, "other"), (0x40000, "han"), (0x110000, "other"),
]
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Numbers (words times languages) that a worker remembers.
REMEMBERED = 4_000_000
#: Characters of a block of texts whose words are looked up together; a longer text is one by itself.
BLOCK_CHARS = 500_000
#: A language's disadvantage for a word of a script that it does not write: no path through it can win.
NEVER = -1e9
#: Languages up to this many are broadcast with their sizes.
BROADCAST_ROWS = 100_000
#: Parts the hashes of whole words from those of trigrams.
_WHOLE = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Params:
    rows: int = 1500  # training texts of a language
    penalty: float = 8.0
    smoothing: float = 0.2
    script_share: float = 0.001  # of a language's letters, for it to be a candidate in that script
    word_weight: float = 2.0
    worst: float = 6.0  # a word's disadvantage is at most this


@dataclass
class Model:
    langs: list[str]
    params: Params
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of features, rising
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each feature's entries below
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))  # the languages that have the feature
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # and their log-probabilities, less those of an absent feature
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # whether the feature is a word
    absent: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # log-probabilities of absent trigrams and words, by language
    scripts: dict[str, np.ndarray] = field(default_factory=dict)


_ends = np.array([e for e, _ in SCRIPTS])


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[int(np.searchsorted(_ends, ord(word[0]), "right"))][1]


def scripts_of(words: list[str]) -> np.ndarray:
    """The scripts of all words, as rows of ``SCRIPTS``."""
    return np.searchsorted(_ends, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def has_letter(word: str) -> bool:
    """Whether a word is more than numerals (superscripts and fractions are word characters too)."""
    return any(map(str.isalpha, word))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words' features end to end, each word's own and then its trigrams, and their offsets."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    cp, offsets = spans.code_points([f"^{w.lower()}$" for w in words])
    sizes = np.diff(offsets) - 1  # the word itself, and its length less two trigrams
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    first = np.repeat(offsets[:-1], sizes)
    starts = np.where(at == 0, first, first + at - 1)
    ends = np.where(at == 0, np.repeat(offsets[1:], sizes), starts + 3)
    made = spans.span_hash(cp, starts, ends)
    made[bounds[:-1]] ^= _WHOLE
    return made, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature and script counts of training texts: lang, kind (0 trigram, 1 word, 2 script), feature (a hash, or the script's number) and n."""
    names = sorted({s for _, s in SCRIPTS})
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            words, n = np.unique(np.array([w for i in np.flatnonzero(langs == lang) for w in words_of(texts[i])], object), return_counts=True)
            words = words.tolist()
            hashes, bounds = word_features(words)
            weight = np.repeat(n, np.diff(bounds))
            own = np.zeros(len(hashes), bool)
            own[bounds[:-1]] = True
            letters = np.zeros(len(names), np.int64)
            for (_, script), times in zip(SCRIPTS, np.bincount(scripts_of(words), n * np.array(list(map(len, words)), np.int64), len(SCRIPTS)).tolist(), strict=True):
                letters[names.index(script)] += int(times)
            for kind, keys, times in ((0, hashes[~own], weight[~own]), (1, hashes[own], weight[own]), (2, np.arange(len(names)).astype(np.uint64), letters)):
                keys, which = np.unique(keys, return_inverse=True)
                total = np.bincount(which, times, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(total)], names=["lang", "kind", "feature", "n"]
                )


def train(rows: DataFrame, params: Params | None = None) -> Model:
    """A model from rows (id, lang, text) with non-null lang and text."""
    params = params or Params()
    ship(rows.sparkSession)
    keyed = rows.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.col("id").cast("string")).alias("h"), F.xxhash64("text").alias("t"))
    single = keyed.groupBy("t").agg(F.min("lang").alias("lang"), F.max("lang").alias("other"), F.min("h").alias("h")).filter("lang = other")
    single = written(single.select("t", "lang", "h"), "single-language-texts")
    # Hashes are even: four times the wanted share holds the least ones, so only about so many rows of a language are ranked.
    sizes = few(written(single.groupBy("lang").agg(F.count(F.lit(1)).alias("c")), "languages"), BROADCAST_ROWS)
    low = single.join(sizes, "lang").filter(F.col("h").cast("double") <= -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), F.lit(4.0 * params.rows) / F.col("c")))
    chosen = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).filter(F.col("r") <= params.rows)
    sample = keyed.join(F.broadcast(chosen.select("lang", "t", "h")), ["lang", "t", "h"], "left_semi").dropDuplicates(["lang", "t"])
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, kind int, feature bigint, n bigint").groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))
    counted = written(counted, "feature-counts")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    model = Model(langs, params)
    if not langs:
        return model
    # Three columns of numbers, 18 bytes for each feature of a language's sample.
    number = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i).cast("short"))])
    found = counted.select("kind", number[F.col("lang")].alias("l"), "feature", "n").toArrow()
    kind, owner, feature, n = (found.column(i).to_numpy() for i in range(4))
    feature = feature.view(np.uint64)
    names, letters = sorted({s for _, s in SCRIPTS}), np.zeros((len(SCRIPTS), len(langs)))
    np.add.at(letters, (feature[kind == 2].astype(np.int64), owner[kind == 2]), n[kind == 2])
    model.scripts = {s: letters[i] >= params.script_share * np.maximum(letters.sum(0), 1) for i, s in enumerate(names) if letters[i].any()}
    model.scripts = {s: can for s, can in model.scripts.items() if can.any()}
    parts = kind < 2
    kind, owner, feature, n = kind[parts], owner[parts], feature[parts], n[parts]
    order = np.lexsort((owner, feature))
    kind, owner, feature, n = kind[order], owner[order], feature[order], n[order]
    first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, np.int64)
    model.hashes, model.bounds, model.owners, model.whole = feature[first], np.append(first, len(feature)), owner.astype(np.uint16), kind[first] == 1
    # Words and trigrams are two distributions, each smoothed over all of its features.
    total = np.stack([np.bincount(owner[kind == k], n[kind == k], len(langs)) + params.smoothing * (model.whole == k).sum() for k in (0, 1)])
    model.absent = np.log(params.smoothing / np.maximum(total, params.smoothing))
    model.logs = (np.log((n + params.smoothing) / params.smoothing)).astype(np.float32)
    return model


class Labeller:
    """Labels the words of texts; scores of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.table, self.size = model, {}, np.zeros((1 << 12, len(model.langs)), np.float32), 0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Per word and language, how much worse it is than the best language for that word (zero or less)."""
        model, n_langs = self.model, len(self.model.langs)
        score = np.zeros((len(words), n_langs))
        if len(model.hashes):
            hashes, bounds = word_features(words)
            word = np.repeat(np.arange(len(words)), np.diff(bounds))
            at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
            seen = model.hashes[at] == hashes
            word, at = word[seen], at[seen]
            n = np.bincount(word, minlength=len(words))
            for k in (False, True):
                score += np.outer(np.bincount(word[model.whole[at] == k], minlength=len(words)), model.absent[int(k)])
            entries, ends = spans.take(np.arange(len(model.owners)), model.bounds, at)
            cell = np.repeat(word, np.diff(ends)) * n_langs + model.owners[entries]
            score += np.bincount(cell, model.logs[entries], len(words) * n_langs).reshape(len(words), n_langs)
            score *= model.params.word_weight / np.maximum(n, 1)[:, None]
        every = np.ones(n_langs, bool)
        candidate = np.array([model.scripts.get(s, every) for _, s in SCRIPTS])[scripts_of(words)]
        best = np.where(candidate, score, -np.inf).max(1, keepdims=True)
        return np.where(candidate, np.maximum(score - best, -model.params.worst), NEVER)

    def scores(self, words: list[str]) -> np.ndarray:
        if self.size * len(self.model.langs) > REMEMBERED:
            self.known, self.size = {}, 0
            self.table = np.zeros((1 << 12, len(self.model.langs)), np.float32)
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            while self.size + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.size : self.size + len(fresh)] = self.word_scores(fresh)
            known.update(zip(fresh, range(self.size, self.size + len(fresh)), strict=True))
            self.size += len(fresh)
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].astype(np.float64)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best labels of a text's words."""
        total = scores.sum(0)
        best = int(np.argmax(total))
        gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
        if (gain - low).max() <= self.model.params.penalty / 2:
            return np.full(len(scores), best)
        return viterbi(scores, self.model.params.penalty)

    def verdict(self, path: np.ndarray, scores: np.ndarray, sizes: list[int]) -> tuple[str, float]:
        """Language and score of a labelled text: the share of letters times the probability over the words that have them."""
        letters = np.bincount(path, sizes, len(self.model.langs))
        best = int(np.argmax(letters))
        total = scores[path == best].sum(0)
        chance = 1.0 / np.exp(np.minimum(total - total[best], 700.0)).sum()
        return self.model.langs[best], round(float(letters[best] / letters.sum() * chance), 6)

    def label(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """Language, score and spans (language, start, end in code points) of a text."""
        if not text or not self.model.langs:
            return UNKNOWN, 0.0, []
        found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        if not any(has_letter(text[a:b]) for a, b in found):
            return UNKNOWN, 0.0, []
        scores = self.scores([text[a:b] for a, b in found])
        path = self.path(scores)
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        runs = [(self.model.langs[path[a]], found[a][0], found[b - 1][1]) for a, b in zip(edges, edges[1:], strict=False)]
        return *self.verdict(path, scores, [b - a for a, b in found]), runs

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score alone."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; the new words of a block of texts are scored together."""
        out, block, chars = [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text) if text and self.model.langs else []
            block.append(words if any(map(has_letter, words)) else [])
            chars += len(text or "")
            if chars >= BLOCK_CHARS or i + 1 == len(texts):
                scores, at = self.scores([w for words in block for w in words]), 0
                for words in block:
                    own, at = scores[at : at + len(words)], at + len(words)
                    out.append(self.verdict(self.path(own), own, list(map(len, words))) if words else (UNKNOWN, 0.0))
                block, chars = [], 0
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels with the highest sum of scores less ``penalty`` for each switch; ties stay, then go to the lower label."""
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        top = max(value)
        floor, best = top - penalty, value.index(top)
        back.append([best if floor > v else i for i, v in enumerate(value)])
        value = [(floor if floor > v else v) + x for v, x in zip(value, row, strict=True)]
    path = [value.index(max(value))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1], np.int64)


def _predicting(model):  # noqa: ANN001, ANN202  a broadcast model
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        for batch in batches:
            made = labeller.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["id", "lang_pred", "score"])

    return work


def _labelling(model):  # noqa: ANN001, ANN202  a broadcast model
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        for batch in batches:
            made = [labeller.label(t) for t in batch.column(1).to_pylist()]
            spans = pa.array([[{"lang": x, "start": a, "end": b} for x, a, b in m[2]] for m in made], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), spans], names=["id", "lang_pred", "score", "spans"]
            )

    return work


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and, if asked for, ``spans`` (lang, start, end), one row per document."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = spark.sparkContext.broadcast(model)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    if spans:
        return rows.mapInArrow(_labelling(sent), schema + ", spans array<struct<lang:string,start:int,end:int>>")
    return rows.mapInArrow(_predicting(sent), schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = train(docs.filter(~held_out).select(F.col("doc_id").alias("id"), "lang", "text"))
    named = identify(docs, model, spans=False).withColumnRenamed("id", "doc_id")
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
