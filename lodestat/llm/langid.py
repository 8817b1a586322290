"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word; a per-word score is the sum
of the log-probabilities of the word's character n-grams in each language; Viterbi over
the words with a fixed penalty for a switch labels spans; the text's language is the one
whose spans hold most letters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ENTRY_BYTES, MEMO_BYTES, map_text, sample_by_hash

#: First and last code points of letters by script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),), "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)),
}
NAMES = (*SCRIPTS, "other")
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SWITCH = 6.0
SAMPLE_DOCS = 3000
SCRIPT_SHARE = 0.01
#: Words that are scored at once, and bytes of text that are labelled at once.
LEARNED, SLICE = 10_000, 2 << 20


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script (an index of NAMES) of each code point."""
    out = np.full(len(points), len(SCRIPTS), np.int8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[(points >= a) & (points <= b)] = i
    return out


def letters_and_grams(words: list[str]):
    """Of many words at once: code points and the word of each, and the buckets of all
    character n-grams (with the word's edges) and the word of each."""
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        at = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        code = code[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            h = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append(((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(of[at])
    inner = np.ones(len(points), bool)
    ends = np.cumsum(sizes)
    inner[ends - 1] = inner[ends - sizes] = False
    return points[inner], of[inner], buckets, owners


#: A letter and the letters and marks after it (Unicode categories L and M).
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PLAIN = re.compile(r"[a-z]+")


def words_of(text: str) -> list[str]:
    """Runs of letters with their marks, lower-cased."""
    return (PLAIN if text.isascii() else WORDS).findall(text.lower())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_DOCS) -> dict:
    """A model from about ``sample`` documents of each language (a documented bound, by
    hash), whole texts.  Rows with a null text or language
    teach nothing.  The counts that reach the driver are bounded: languages times
    ``BUCKETS`` hashed n-grams, and languages times scripts."""
    rows = docs.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"))
    picked = sample_by_hash(rows, "lang", ("key", "text"), sample).select("lang", "text")

    def count(batches):
        from collections import Counter, defaultdict

        seen = defaultdict(Counter)
        for b in batches:
            for lg, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen[lg].update(words_of(t))
        for lg, words in seen.items():
            hits, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
            names, times = list(words), np.fromiter(words.values(), np.int64, len(words))
            for i in range(0, len(names), 50_000):
                points, of, buckets, owners = letters_and_grams(names[i : i + 50_000])
                n = times[i : i + 50_000]
                for bucket, owner in zip(buckets, owners, strict=True):
                    hits += np.bincount(bucket, n[owner], BUCKETS).astype(np.int64)
                scripts += np.bincount(scripts_of(points), n[of], len(NAMES)).astype(np.int64)
            at = np.flatnonzero(hits)
            k = np.flatnonzero(scripts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lg] * (len(at) + len(k))), pa.array(np.concatenate([at, -1 - k]), pa.int32()), pa.array(np.concatenate([hits[at], scripts[k]]), pa.int64())],
                names=["lang", "bucket", "n"])

    counts = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in counts})
    hits, scripts = np.zeros((BUCKETS, len(names))), np.zeros((len(NAMES), len(names)))
    for r in counts:
        (hits if r["bucket"] >= 0 else scripts)[r["bucket"] if r["bucket"] >= 0 else -1 - r["bucket"], names.index(r["lang"])] = r["n"]
    log = np.log((hits + 0.5) / (hits.sum(0) + 0.5 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(0), 1)
    return {"names": names, "log": log.astype(np.float32), "scripts": share >= SCRIPT_SHARE}


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of several sequences at once: ``scores`` holds their rows one after
    another.  All sequences advance together, longest first; ties go to staying, then to
    the smaller label."""
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    k = scores.shape[1]
    kind = np.min_scalar_type(k)
    stay, back = np.arange(k, dtype=kind), np.zeros(scores.shape, kind)
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # sequences longer than t
    best = scores[start[: alive[0]]].astype(np.float64) if len(alive) else None
    final = np.zeros((len(sizes), k))
    for t in range(1, len(alive)):
        n = alive[t]
        final[n : len(best)] = best[n:]
        best = best[:n]
        top = best.argmax(1)
        jump = best[np.arange(n), top] - switch
        moved = jump[:, None] > best
        back[start[:n] + t] = np.where(moved, top[:, None], stay)
        best = np.where(moved, jump[:, None], best) + scores[start[:n] + t]
    if best is not None:
        final[: len(best)] = best
    label = final.argmax(1)
    out = np.zeros(len(scores), kind)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        out[start[:n] + t] = label[:n]
        label[:n] = back[start[:n] + t, label[:n]]
    return out


class Labeller:
    """Spans and languages of texts by one model."""

    def __init__(self, model: dict, switch: float, limit: int = MEMO_BYTES):
        self.model, self.switch, self.limit, self.held = model, switch, limit, 0
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(model["names"])), np.float32)

    def _learn(self, words: list[str]):
        log, allowed, k, n = self.model["log"], self.model["scripts"], len(self.model["names"]), len(words)
        points, of, buckets, owners = letters_and_grams(words)
        rows = np.zeros((n, k))
        for bucket, owner in zip(buckets, owners, strict=True):
            for lang in range(k):
                rows[:, lang] += np.bincount(owner, log[bucket, lang], n)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        fits = np.logical_or.reduceat(allowed[scripts_of(points)], first, axis=0)
        # a language whose script the word has none of is left out, unless that leaves none
        out = ~fits & fits.any(1)[:, None]
        rows = np.where(out, rows.min(1)[:, None] - 50, rows)
        rows = rows - rows.max(1)[:, None] if k else rows
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, rows.astype(np.float32)])

    def __call__(self, texts: list[str | None]):
        """For each text its words, their labels, and letters by language."""
        if self.held > self.limit:
            self.index, self.scores, self.held = {}, self.scores[:0].copy(), 0
        words = [words_of(t) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        k = len(self.model["names"])
        if new := [w for w in dict.fromkeys(flat) if k and w not in self.index]:
            for i in range(0, len(new), LEARNED):
                self._learn(new[i : i + LEARNED])
            self.held += sum(map(len, new)) + len(new) * (ENTRY_BYTES + 4 * k)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if k:
            labels = viterbi(self.scores[np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))], lengths, self.switch)
        else:
            labels = np.zeros(len(flat), np.int8)
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        rows = np.repeat(np.arange(len(words)), lengths)
        held = np.zeros((len(words), max(k, 1)), np.int64)
        np.add.at(held, (rows, labels), letters)
        return words, labels, lengths, held


def identify(docs: DataFrame, model: dict, keep: dict[str, str] | None = None, text: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """The columns of ``keep`` (doc_id by default), lang_pred, score, and with ``spans``
    the labelled spans (language, first word, number of words).

    lang_pred: the language whose spans hold most letters (ties: first by name); ``und``
    if the text is null or has no letter, or nothing was learned.  score: those spans'
    share of the letters, 0 for ``und``.  Whole texts; rows are independent, repeated rows
    give repeated results, an empty table none; only the named columns are read, and columns
    of ``keep`` may have any name but lang_pred, score and spans."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        label = Labeller(held.value, switch)
        names = held.value["names"]

        def work(texts):
            words, labels, lengths, letters = label(texts)
            total = letters.sum(1)
            some = (total > 0) & bool(names)
            top = letters.argmax(1)
            out = [
                [names[i] if s else "und" for i, s in zip(top.tolist(), some.tolist(), strict=True)],
                [float(letters[r, i] / total[r]) if s else 0.0 for r, (i, s) in enumerate(zip(top.tolist(), some.tolist(), strict=True))],
            ]
            if spans:
                made, at = [], 0
                for n in lengths.tolist():
                    own = labels[at : at + n]
                    edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n and names else []
                    made.append([{"lang": names[own[a]], "first": a, "words": b - a} for a, b in zip(edges, edges[1:], strict=False)])
                    at += n
                out.append(made)
            return out

        return work

    added = "lang_pred string, score double" + ", spans array<struct<lang string, first int, words int>>" * spans
    return map_text(docs, keep or {"doc_id": "doc_id"}, text, make, added, SLICE)
