"""Language identification of mixed-language text.

Each word gets a score for each language, from the frequencies of the letter trigrams in it. The script
of its first letter narrows the languages to those that use this script. The Viterbi algorithm then
labels the words of a text so that the sum of scores, less a penalty for each switch of language, is
greatest; runs of equal labels are the spans.

The model is counts of hashed trigrams by language over all training rows, summed up by Spark: its size
is bounded by the number of languages and BUCKETS, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filtered
from .words import sliced

#: Hash buckets of trigrams; log-probability that a switch of language costs; letters of a chunk.
BUCKETS, PENALTY, CHUNK = 1 << 17, 12.0, 1 << 19
UNKNOWN = "und"
#: First and last code points of scripts, from the Unicode block charts.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 2 for a letter, 1 for a mark within words, else 0; and its script (0: another)."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        kinds[i] = 2 if kind == "L" else kind == "M"
    scripts = np.zeros(0x110000, np.uint8)
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            scripts[a : b + 1] = n
    return kinds, scripts


@dataclass
class Words:
    """The words of some texts, laid end to end: where each starts among their code points, its length and its text's number."""

    grams: np.ndarray  # hashed trigrams, one for each code point of a word and one for each word's end
    gram_starts: np.ndarray  # the first of each word
    starts: np.ndarray  # code points from the start of its text
    lengths: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray
    owner: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters and marks with a letter first."""
    kinds, scripts = _tables()
    lowered = [x.lower() if len(x.lower()) == len(x) else "".join(c.lower() if len(c.lower()) == 1 else c for c in x) for x in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    offsets = np.cumsum([1, *(len(x) + 1 for x in texts)])[:-1]
    kind = kinds[points]
    inside = kind > 0
    edge = np.diff(inside.astype(np.int8))
    first, behind = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    plain = np.where(inside, points, 0)
    here = inside.copy()
    here[behind] = True  # the end of a word has a trigram as well
    at = np.flatnonzero(here)
    hashed = (plain[at] * 0x9E3779B1 + plain[at - 1] * 0x85EBCA77 + plain[np.maximum(at - 2, 0)] * 0xC2B2AE3D) & 0xFFFFFFFFFFFF
    grams = ((hashed ^ (hashed >> 21)) * 0x27D4EB2F >> 13) & (BUCKETS - 1)
    upto = np.cumsum(kind == 2)
    owner = np.searchsorted(offsets, first, "right") - 1
    return Words(grams, np.searchsorted(at, first), first - offsets[owner], behind - first, upto[behind - 1] - upto[first - 1], scripts[points[first]], owner)


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts, so many together as fill a chunk."""
    some, size = [], 0
    for i, text in enumerate(texts):
        some.append(i)
        size += len(text) + 1
        if size > CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (kind, lang, item, n): trigrams (kind 0) and letters by script (kind 1)."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}

    def summed() -> Iterator[pa.RecordBatch]:
        for kind, counts in enumerate((grams, scripts)):
            for lang, n in counts.items():
                item = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), kind, np.int32)), pa.array([lang] * len(item)), pa.array(item), pa.array(n[item])], ["kind", "lang", "item", "n"])

    for batch in sliced(batches):
        langs, texts = batch.column("lang").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts):
            by_lang.setdefault(lang, []).append(text)
        for lang, mine in by_lang.items():
            for some in _chunks(mine):
                words = words_of([mine[i] for i in some])
                grams[lang] = grams.get(lang, 0) + np.bincount(words.grams, minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(words.scripts, words.letters, len(SCRIPTS) + 1).astype(np.int64)
        if len(grams) > 64:
            yield from summed()
            grams.clear()
            scripts.clear()
    yield from summed()


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # log-probability of each trigram (rows) in each language
    uses: np.ndarray  # whether a language (columns) uses a script (rows)
    unseen: np.ndarray  # the score of a trigram that a language's rows don't have


def trained(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model from all rows with a language and a text.

    A language uses a script if at least one in 200 of its letters is in it.
    """
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counted = rows.mapInArrow(_counted, "kind int, lang string, item long, n long")
    table = counted.groupBy("kind", "lang", "item").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    langs = sorted(table.lang.unique(), key=str.encode)
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS) + 1, len(langs)))
    column = table.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    for kind, counts in enumerate((grams, scripts)):
        mine = (table.kind == kind).to_numpy()
        counts[table["item"].to_numpy()[mine], column[mine]] = table["n"].to_numpy()[mine]
    seen = (grams > 0).sum(axis=0) + 1
    smooth = 0.5
    total = grams.sum(axis=0) + smooth * seen * 4
    scores = np.log((grams + smooth) / total)
    uses = scripts * 200 >= np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, scores.astype(np.float32), uses, np.log(smooth / total).astype(np.float32))


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Scores of each word for each language; those that don't use its script are far behind, unless none does."""
    scores = np.add.reduceat(model.scores[words.grams], words.gram_starts, axis=0) if len(words.starts) else np.zeros((0, len(model.langs)), np.float32)
    allowed = model.uses[words.scripts]
    return scores - np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0, 1000).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word. lengths: words of each text.

    A text whose words nowhere gain more than the penalty by another label than the one that is best
    over all keeps that label throughout: no stretch of others could pay for its switches.
    """
    labels = np.empty(len(scores), np.int16)
    mixed = np.zeros(len(scores), bool)
    at = 0
    for n in lengths[lengths > 0].tolist():
        own = scores[at : at + n]
        best = int(own.sum(axis=0, dtype=np.float64).argmax())
        gain = np.delete(own, best, axis=1).max(axis=1, initial=-np.inf) - own[:, best]
        total = np.append(0.0, np.cumsum(gain, dtype=np.float64)) if own.shape[1] > 1 else np.zeros(1)
        labels[at : at + n] = best
        mixed[at : at + n] = (total - np.minimum.accumulate(total)).max() > penalty
        at += n
    some = np.flatnonzero(lengths > 0)
    some = some[mixed[(np.cumsum(lengths) - lengths)[some]]]
    labels[mixed] = _searched(scores[mixed], lengths[some], penalty)
    return labels


def _searched(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word by the algorithm itself; all texts take a step together."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    falling = lengths[order]
    top = np.empty(len(scores), np.int16)  # best label of the word before,
    switched = np.empty(scores.shape, bool)  # and for which labels it pays to come from there
    live = np.searchsorted(-falling, -np.arange(1, int(falling[0]) + 1), "right") if len(falling) else []
    best = scores[starts].copy()
    for t in range(1, len(live)):
        n = live[t]
        at, before = starts[:n] + t, best[:n]
        high = before.argmax(axis=1)
        jump = before[np.arange(n), high][:, None] - penalty
        top[at], switched[at] = high, before < jump
        best[:n] = np.maximum(before, jump) + scores[at]
    labels = np.empty(len(scores), np.int16)
    current = best.argmax(axis=1) if len(falling) else best
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        labels[at] = current[:n]
        if t:
            come = switched[at, current[:n]]
            current[:n] = np.where(come, top[at], current[:n])
    return labels


def known_share(model: Model, words: Words, labels: np.ndarray, texts: int) -> np.ndarray:
    """Of each text the share of trigrams that the language of their word has been seen with, in a script that it uses."""
    ends = np.append(words.gram_starts[1:], len(words.grams))
    label = np.repeat(labels, ends - words.gram_starts)
    seen = (model.scores[words.grams, label] > model.unseen[label] + 1e-4) & np.repeat(model.uses[words.scripts, labels], ends - words.gram_starts)
    owner = np.repeat(words.owner, ends - words.gram_starts)
    return np.bincount(owner, seen, texts) / np.maximum(np.bincount(owner, minlength=texts), 1)


def _labelled(shared):
    """(doc_id, text) -> (doc_id, lang_pred, score, spans, known)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            preds, sure, spans, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts], np.zeros(len(texts))
            for some in _chunks(texts) if model.langs else ():
                words = words_of([texts[i] for i in some])
                if not len(words.starts):
                    continue
                labels = viterbi(word_scores(model, words), np.bincount(words.owner, minlength=len(some)))
                votes = np.zeros((len(some), len(model.langs)))
                np.add.at(votes, (words.owner, labels), words.letters)
                total = votes.sum(axis=1)
                known[some] = known_share(model, words, labels, len(some))
                for k in np.flatnonzero(total):
                    won = int(votes[k].argmax())
                    preds[some[k]], sure[some[k]] = model.langs[won], float(votes[k, won] / total[k])
                begin = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (words.owner[1:] != words.owner[:-1])))
                end = np.append(begin[1:], len(labels)) - 1
                for k, a, b, label in zip(words.owner[begin].tolist(), words.starts[begin].tolist(), (words.starts + words.lengths)[end].tolist(), labels[begin].tolist()):
                    spans[some[k]].append((a, b, model.langs[label]))
            columns = [batch.column("doc_id"), pa.array(preds), pa.array(sure), pa.array(spans, pa.list_(span)), pa.array(known)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans", "known"])

    return run


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans and known of every row of docs.

    lang_pred is the language with the most letters among the labelled words, score its share of them,
    spans (start, end, lang) runs of words of one language, in code points, end exclusive; known is the
    share of its trigrams that were learned from for the language of their word. A text that is null or
    has no letter, and any text if nothing was learned, is "und" with score 0, known 0 and no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_labelled(shared), f"doc_id {kind}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>, known double")


def fold(doc_id: str = "doc_id"):
    """Folds 0 to 4 of documents; 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def in_known_language(docs: DataFrame, model: Model, text: str = "text", least_known: float = 0.5, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs whose text is in a language that was learned, and among the languages given (None: all), with all columns.

    What is "und" goes, and a text less than least_known of whose trigrams are known: most of it is in a
    script or a language that was never taught, though some learned language is nearest to it.
    """
    label, place = _labelled(docs.sparkSession.sparkContext.broadcast(model)), docs.columns.index(text)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch.column(place)], ["doc_id", "text"])
            labelled = pa.Table.from_batches(label(iter([texts])))
            pred = labelled.column("lang_pred").to_numpy()
            wanted = pred != UNKNOWN if languages is None else np.isin(pred.astype(str), languages)
            yield batch.filter(pa.array(wanted & (labelled.column("known").to_numpy() >= least_known)))

    return filtered(docs, known)
