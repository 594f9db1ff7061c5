"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Each of its words has a likelihood under every language, the product over the
word's byte trigrams; expectation-maximisation estimates the document's language proportions, and the set of
languages is the one with the best penalised likelihood (the Bayesian information criterion over words).

Driver memory: one trigram table of `BUCKETS` counts a language. Executor memory: about `CELLS` words times languages,
besides a text's own bytes; a text with more is read in pieces, anew for each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, releasing, utf8_slices, word_spans

BITS = 15
BUCKETS = 1 << BITS
#: Rows that a model is fitted on, at most, and bytes of their texts; chosen by a hash of the row.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Word likelihoods held at a time. Proportions have converged when none changes by more than NEAR in a round.
CELLS, NEAR = 2_000_000, 1e-4
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """languages, sorted, and the log probability of each trigram bucket under each of them."""

    languages: list[str]
    log_p: np.ndarray


def _is_letter() -> np.ndarray:
    b = np.arange(256)
    return ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


_LETTER = _is_letter()
#: Letters in lower case, each other byte a space; a byte of a longer UTF-8 character counts as a letter.
_FOLD = np.where(_LETTER, np.where(np.arange(256) < 91, np.arange(256) | 32, np.arange(256)), 32).astype(np.uint8)


def _trigrams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each byte; a word's first bytes see spaces before them."""
    c = _FOLD[data].astype(np.uint32)
    before = np.full(len(c), 32, np.uint32)
    before[1:] = c[:-1]
    before[starts] = 32
    second = np.full(len(c), 32, np.uint32)
    second[1:] = before[:-1]
    second[starts] = 32
    return ((c | before << np.uint32(8) | second << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, alpha: float = 0.05) -> LanguageModel:
    """A model of the languages of `rows`; rows without text or language teach nothing.

    Fitted on a sample of at most `sample_rows` rows and `SAMPLE_BYTES` of text. A table without labelled rows gives a
    model without languages, under which every document is unknown. Rows that agree in key, text and language count once.
    """
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    sample = bounded_sample(known, key, text, sample_rows, SAMPLE_BYTES).select(text, lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, data, offsets in utf8_slices(batch.column(0)):
                starts, _, _ = word_spans(data, offsets)
                solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
                grams = _trigrams(data, starts)
                for i in range(len(offsets) - 1):
                    own = found.setdefault(langs[first + i], np.zeros(BUCKETS, np.int64))
                    at = slice(offsets[i], offsets[i + 1])
                    own += np.bincount(grams[at][solid[at]], minlength=BUCKETS)
        if found:
            yield pa.RecordBatch.from_pydict({"lang": list(found), "counts": [x.tobytes() for x in found.values()]})

    total: dict[str, np.ndarray] = {}
    for r in sample.coalesce(8).mapInArrow(releasing(count), "lang string, counts binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    languages = sorted(total)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    c = np.stack([total[x] for x in languages], axis=1).astype(np.float64) + alpha
    return LanguageModel(languages, np.log(c / c.sum(axis=0)).astype(np.float32))


def _likelihoods(model: LanguageModel, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The log likelihood of each word under each language, some bytes at a time."""
    m = len(model.languages)
    out, step = np.zeros((len(starts), m), np.float32), max(1024, CELLS // m)
    for lo in range(0, len(data), step):
        hi, at = min(len(data), lo + step), max(0, lo - 2)  # the first bytes' trigrams begin before them
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi)
        if a >= b:
            continue
        grams = _trigrams(data[at:hi], starts[np.searchsorted(starts, at) : b] - at)[lo - at :]
        bounds = np.column_stack([np.maximum(starts[a:b], lo), np.minimum(ends[a:b], hi)]).ravel() - lo
        out[a:b] += np.add.reduceat(model.log_p[grams], bounds[: len(bounds) - (bounds[-1] == hi - lo)], axis=0)[::2]
    return out


def _em(ll: np.ndarray, doc: np.ndarray, words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document, each once it has converged. ll: of the words, by document; doc:
    a word's document; start: of documents by languages, 0 where one is left out."""
    peak, pi = ll.max(axis=1).astype(np.float64), start.copy()
    p = np.exp(ll - peak[:, None])
    total = np.add.reduceat(peak, _firsts(words))
    open_ = np.arange(len(words))
    while len(open_):
        own, first = pi[open_], _firsts(words)
        r = p * own[doc]
        s = np.maximum(r.sum(axis=1), 1e-300)
        new = np.add.reduceat(r / s[:, None], first, axis=0) / words[:, None]
        stays = np.abs(new - own).max(axis=1) >= NEAR
        pi[open_[stays]] = new[stays]
        if not stays.all():
            total[open_[~stays]] += np.add.reduceat(np.log(s), first)[~stays]
            kept = stays[doc]
            p, doc, words, open_ = p[kept], (np.cumsum(stays) - 1)[doc[kept]], words[stays], open_[stays]
    return pi, total


def _firsts(words: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(words)[:-1]])


def _em_in_pieces(model: LanguageModel, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
    """As _em for a single document, whose likelihoods are taken anew for each round, some words at a time."""
    step = max(1, CELLS // len(pi))
    while True:
        new, total = np.zeros(len(pi)), 0.0
        for a in range(0, len(starts), step):
            own = slice(starts[a], ends[min(len(ends), a + step) - 1])
            ll = _likelihoods(model, data[own], starts[a : a + step] - starts[a], ends[a : a + step] - starts[a])
            peak = ll.max(axis=1).astype(np.float64)
            r = np.exp(ll - peak[:, None]) * pi
            s = np.maximum(r.sum(axis=1), 1e-300)
            new += (r / s[:, None]).sum(axis=0)
            total += float((np.log(s) + peak).sum())
        new /= len(starts)
        if np.abs(new - pi).max() < NEAR:
            return pi, total
        pi = new


def infer(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The proportion of each language in each text, 0 for those outside the chosen set; all 0 without words.

    A set is the k languages of the largest proportions in the mixture of all; k is that of the best criterion.
    """
    n, m = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, m))
    starts, ends, counts = word_spans(data, offsets)
    if not len(starts) or not m:
        return out
    some = np.flatnonzero(counts)
    words = counts[some]
    if n == 1 and len(starts) * m > 2 * CELLS:
        fit_ = lambda start: tuple(np.array([x]) for x in _em_in_pieces(model, data, starts, ends, start[0]))
    else:
        ll = _likelihoods(model, data, starts, ends)
        doc = np.repeat(np.arange(len(some)), words)
        fit_ = lambda start: _em(ll, doc, words, start)
    full, full_ll = fit_(np.full((len(some), m), 1.0 / m))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    price = np.log(words) / 2
    best, best_cost = full, price * (m - 1) - full_ll
    for k in range(1, m):
        start = np.where(rank < k, np.maximum(full, 1e-6), 0)
        pi, of_set = fit_(start / start.sum(axis=1, keepdims=True))
        cost = price * (k - 1) - of_set
        better = cost <= best_cost
        best, best_cost = np.where(better[:, None], pi, best), np.where(better, cost, best_cost)
    out[some] = best
    return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score", languages: str = "lang_set", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of docs (all but text by default) with the main language, its proportion and the language set.

    A null or empty text, or one without any letter, is 'und' with score 0 and an empty set; so is each text if the
    model has no languages. Equal proportions go to the language first in code-point order. Whole texts are read;
    repeated rows stay, and other columns pass through untouched, but one that has the name of a new column gives way
    to it.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if (keep is not None or c != text) and c not in (pred, score, languages)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(pred, "string").add(score, "double").add(languages, T.ArrayType(T.StringType()))
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = np.zeros((batch.num_rows, len(names)))
            letters = np.zeros(batch.num_rows, bool)
            column = batch.column(0)
            for first, data, offsets in utf8_slices(column, max(4096, min(1 << 20, 4 * CELLS // max(1, len(names))))):
                k = len(offsets) - 1
                shares[first : first + k] = infer(model, data, offsets)
                seen = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
                letters[first : first + k] = seen[offsets[1:]] > seen[offsets[:-1]]
            for i in np.flatnonzero(~letters):
                letters[i] = any(x.isalpha() for x in column[i].as_py() or "")
            known = letters & (shares.sum(axis=1) > 0)
            top = shares.argmax(axis=1) if names else np.zeros(len(known), int)
            at = shares[np.arange(len(top)), top] if names else np.zeros(len(known))
            sets = [[names[j] for j in np.flatnonzero(x > 0)] if ok else [] for x, ok in zip(shares, known, strict=True)]
            extra = [pa.array([names[j] if ok else UNKNOWN for j, ok in zip(top, known, strict=True)], pa.string()), pa.array(np.where(known, np.clip(at, 0, 1), 0.0)), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(1 + i) for i in range(len(keep))), *extra], [*keep, pred, score, languages])

    return docs.select(F.col(text), *[F.col(f"`{c}`") for c in keep]).mapInArrow(releasing(run), schema)
