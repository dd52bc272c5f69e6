"""Language identification: every text is a mixture of languages, inferred by EM over byte trigram likelihoods."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import CHUNK, LOWER, bound_batches, text_bytes, with_arrow_columns

BUCKETS = 1 << 16
#: EM steps over all languages and within a set, the penalty's weight, and the share over all languages up to which one is no part of a set.
STEPS, SET_STEPS, PENALTY, NEGLIGIBLE = 10, 5, 4.0, 1e-3
UNKNOWN = "und"
_BLANK = np.uint32(0x20)
_codes = np.arange(256)
_LETTER = ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
_SEEN = np.where(_LETTER, LOWER, 0x20).astype(np.uint32)


def _trigrams(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams around every letter byte, and the number of them before each cut."""
    low = LOWER[data]
    here = _SEEN[low]
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[cuts[cuts < len(data)]] = _BLANK
    after[cuts[cuts > 0] - 1] = _BLANK
    at = np.flatnonzero(_LETTER[low])
    code = (before[at] << np.uint32(16)) | (here[at] << np.uint32(8)) | after[at]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), np.searchsorted(at, cuts)


def _pieces(column: pa.Array):
    """(first row, last row, bytes, cuts) of about CHUNK bytes; a long text comes in pieces of one row."""
    data, at = text_bytes(column)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        if hi > lo + 1 or at[hi] - at[lo] <= CHUNK:
            yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        else:
            for begin in range(int(at[lo]), int(at[hi]), CHUNK):
                piece = data[begin:min(begin + CHUNK, int(at[hi]))]
                yield lo, hi, piece, np.array([0, len(piece)])
        lo = hi


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all texts with a language: each task sums in arrays of its own, then all tasks' sums meet."""
    bound_batches(docs)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, cuts in _pieces(batch.column(0)):
                grams, first = _trigrams(data, cuts)
                owner = np.repeat(np.arange(lo, hi), np.diff(first))
                for name in set(names[lo:hi]):
                    found = np.bincount(grams[names[owner] == name], minlength=BUCKETS)
                    sums[name] = sums[name] + found if name in sums else found
        for name, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())],
                                             names=["lang", "bucket", "n"])

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).cast("string").alias("lang"))
    return (labelled.mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


@dataclass
class LanguageModel:
    languages: list[str]
    #: float32 of (bucket, language): the trigram's share in the language.
    shares: np.ndarray


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.2) -> LanguageModel:
    """Smoothed trigram shares of every language in `lang`; 256 KB a language reach the driver, whatever the corpus."""
    found = trigram_counts(docs, text, lang).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    codes = {name: i for i, name in enumerate(languages)}
    counts[found["bucket"].to_numpy(), found["lang"].map(codes).to_numpy(dtype=int)] = found["n"].to_numpy()
    counts += smoothing
    return LanguageModel(languages, (counts / counts.sum(axis=0)).astype(np.float32))


def mixtures(counts: np.ndarray, likely: np.ndarray, first: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once: (proportions, log-likelihoods).

    counts, likely: the n-grams of all texts, one after the other; text i has first[i] to first[i + 1], one at least.
    A language that starts at 0 stays there, so `start` also names the set.
    """
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.add.reduceat(counts, first[:-1])
    shares = start
    for _ in range(steps):
        joint = likely * shares[owner]
        joint *= (counts / joint.sum(axis=1))[:, None]
        shares = np.add.reduceat(joint, first[:-1], axis=0) / total[:, None]
    fit = np.log((likely * shares[owner]).sum(axis=1, dtype=np.float64))
    return shares, np.add.reduceat(counts * fit, first[:-1])


def chosen_sets(counts: np.ndarray, likely: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions in the chosen set, proportions over all languages) of each text.

    Languages enter in the order of their proportions over all; the set is the one with the best log-likelihood less
    PENALTY / 2 * log(n-grams) for each language beyond the first, of any size. The single language is the most likely one.
    A text is tried with three languages or more only while the next one's share over all is above NEGLIGIBLE.
    """
    texts, kinds = len(first) - 1, likely.shape[1]
    over_all, _ = mixtures(counts, likely, first, np.full((texts, kinds), 1 / kinds, np.float32), STEPS)
    single = np.add.reduceat(counts[:, None] * np.log(likely), first[:-1], axis=0)
    pick = single.argmax(axis=1)
    best = np.zeros((texts, kinds), np.float32)
    best[np.arange(texts), pick] = 1
    value = single[np.arange(texts), pick].astype(np.float64)
    cost = PENALTY / 2 * np.log(np.maximum(2, np.add.reduceat(counts, first[:-1])))
    order = np.argsort(-over_all, axis=1, kind="stable")
    for size in range(2, kinds + 1):
        rows = np.arange(texts) if size == 2 else np.flatnonzero(over_all[np.arange(texts), order[:, size - 1]] > NEGLIGIBLE)
        if not len(rows):
            break
        sizes = np.diff(first)[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if len(rows) == texts:
            own_counts, own_likely = counts, likely
        else:
            places = np.arange(ends[-1]) + np.repeat(first[rows] - ends[:-1], sizes)
            own_counts, own_likely = counts[places], likely[places]
        start = np.zeros((len(rows), kinds), np.float32)
        chosen = order[rows, :size]
        start[np.arange(len(rows))[:, None], chosen] = np.maximum(over_all[rows[:, None], chosen], 1e-6)
        shares, fit = mixtures(own_counts, own_likely, ends, start / start.sum(axis=1, keepdims=True), SET_STEPS)
        worth = fit - cost[rows] * (size - 1)
        better = worth > value[rows]
        best[rows[better]] = shares[better]
        value[rows] = np.maximum(worth, value[rows])
    return best, over_all


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predicted_languages(docs: DataFrame, model: LanguageModel, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with lang_pred, score and lang_set of every text.

    lang_pred: the language with the largest share in the chosen set; score: its share over all languages; lang_set:
    the set, by share. Texts that are null or have no letter, and all texts under an empty model, get `und`, 0 and an
    empty set. Columns named like the new ones are replaced; equal shares go to the first name.
    """
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        known = handed.value
        column = batch.column(batch.schema.get_field_index(text))
        names, scores, sets = [UNKNOWN] * len(column), np.zeros(len(column)), [[] for _ in range(len(column))]
        waiting: list = []
        for lo, hi, data, cuts in _pieces(column) if known.languages else ():
            grams, first = _trigrams(data, cuts)
            owner = np.repeat(np.arange(lo, hi), np.diff(first))
            held, n = np.unique((owner << 16) | grams, return_counts=True)
            waiting = _with_waiting(waiting, held, n, lo) if waiting else [held, n]
            if hi - lo == 1 and len(data) == CHUNK:
                continue  # more of this text may follow
            _settle(known, waiting, names, scores, sets)
            waiting = []
        if waiting:
            _settle(known, waiting, names, scores, sets)
        doubtful = [i for i, v in enumerate(_no_ascii_letter(column)) if v and names[i] != UNKNOWN]
        for i in doubtful:
            if not _has_letter(column[i].as_py()):
                names[i], scores[i], sets[i] = UNKNOWN, 0.0, []
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))]

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_set", T.ArrayType(T.StringType()))]
    return with_arrow_columns(docs, fields, make, drop)


def _with_waiting(waiting: list, held: np.ndarray, n: np.ndarray, lo: int) -> list:
    """Counts of the pieces of one long text, or of it and the rows behind it, in one sorted list."""
    keys, where = np.unique(np.concatenate([waiting[0], held]), return_inverse=True)
    return [keys, np.bincount(where, np.concatenate([waiting[1], n])).astype(np.int64)]


def _settle(model: LanguageModel, waiting: list, names: list, scores: np.ndarray, sets: list) -> None:
    held, n = waiting
    if not len(held):
        return
    rows, first = np.unique(held >> 16, return_index=True)
    first = np.append(first, len(held))
    best, over_all = chosen_sets(n.astype(np.float32), model.shares[held & 0xFFFF], first)
    pick = best.argmax(axis=1)
    for i, row in enumerate(rows):
        names[row], scores[row] = model.languages[pick[i]], min(1.0, float(over_all[i, pick[i]]))
        inside = np.flatnonzero(best[i] > 0)
        sets[row] = [model.languages[k] for k in inside[np.argsort(-best[i, inside], kind="stable")]]


def _no_ascii_letter(column: pa.Array) -> np.ndarray:
    data, at = text_bytes(column)
    low = LOWER[data[at[0]:at[-1]]]
    letters = np.flatnonzero((low >= 0x61) & (low <= 0x7A))
    return np.diff(np.searchsorted(letters, at - at[0])) == 0


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 5; rows without a key are in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5, F.lit(0))
