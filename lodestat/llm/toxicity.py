"""Toxicity by a weighted finite-state grammar of clauses.

A lexical transducer maps words to the classes insult, threat, target, negation and
report; its insult entries are fixed seeds and words and stems (a prefix and any ending)
that the labelled rows teach, each with a weight.  Over the classes of one clause a
bimachine composes small transducers with a scope each: a target is near, a negation stands
shortly before, reported speech opens before or follows at once.  Its readings are an insult
or a threat, aimed or not, negated or not, reported or not.  A text's score is a logistic
function of the weights of its matched clauses; words outside a matched clause count nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ENTRY_BYTES, LOWER, MEMO_BYTES, map_text, sample_by_hash

#: Seeds of the word classes (English, French, German, Spanish).
SEEDS = {
    "insult": "idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash imbécile abruti dummkopf trottel idiota estúpido imbécil",
    "threat": "kill hurt destroy beat punch strangle murder tuer frapper töten schlagen umbringen matar golpear destruir",
    "target": "you your you're he she they him her them this these vous tu toi il elle ils du dich dir ihr sie er tú usted él ella ellos",
    "negation": "not no never isn't aren't don't neither nor ne pas jamais nicht kein keine nie nunca jamás",
    "report": "said says say called calls claimed quoted wrote dit disait appelle sagte sagt nannte dijo dice llamó",
}
CLASSES = ("insult", "threat", "target", "negation", "report")
SENTENCE = re.compile(rb"[.!?;\n]+")
#: Letters and digits, with apostrophes between them.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+(?:'[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+)*")
_APOSTROPHE = "\u2019".encode()
STEMS = range(4, 9)
SAMPLE_DOCS = 6000
LEAST_DOCS = 3
LEAST_SHARE = 0.005
PSEUDO = 1.0
LEAST_LOG_ODDS = 3.0

TARGET, NEGATED, REPORTED = 1, 2, 4
READINGS = [(kind, state) for kind in ("insult", "threat") for state in range(8)]

#: Transducers over a clause's classes: what opens a scope, what ends it, for how many words it
#: lasts (None: to the clause's end), and what an insult or threat inside it reads.  The first
#: run from left to right, the second from right to left.
FORWARD = (("target", None, 4, TARGET), ("negation", "report", 3, NEGATED), ("report", None, None, REPORTED))
BACKWARD = (("target", None, 3, TARGET), ("report", None, 2, REPORTED))


class Machine:
    """The product of some transducers, its table filled as states are met."""

    def __init__(self, transducers):
        self.transducers = transducers
        self.start = (0,) * len(transducers)
        self.next: dict[tuple, dict] = {}

    def _step(self, state: tuple[int, ...], symbol: str | None) -> tuple[tuple[int, ...], int]:
        """The next state, and the reading that the state gives a word."""
        out, reading = [], 0
        for left, (opens, ends, reach, mark) in zip(state, self.transducers, strict=True):
            reading |= mark if left else 0
            if symbol == opens:
                out.append(1 if reach is None else reach)
            elif symbol is not None and symbol == ends:
                out.append(0)
            else:
                out.append(left if reach is None else max(left - 1, 0))
        return tuple(out), reading

    def run(self, classes) -> list[int]:
        """The reading at each place."""
        state, out = self.start, []
        for c in classes:
            table = self.next.setdefault(state, {})
            if c not in table:
                table[c] = self._step(state, c)
            state, reading = table[c]
            out.append(reading)
        return out


_FORWARD, _BACKWARD = Machine(FORWARD), Machine(BACKWARD)


def clause_readings(classes: list[str | None]) -> list[tuple[str, int]]:
    """The reading of each insult or threat of a clause; None stands for any other word."""
    before, after = _FORWARD.run(classes), _BACKWARD.run(classes[::-1])[::-1]
    return [(c, before[i] | after[i]) for i, c in enumerate(classes) if c in ("insult", "threat")]


class Lexicon:
    """The lexical transducer: word -> (class, weight) with a longest-prefix fallback."""

    def __init__(self, words: dict[bytes, tuple[str, float]], stems: dict[bytes, tuple[str, float]]):
        self.words, self.stems = words, stems
        self.known: dict[bytes, tuple[str, float] | None] = {}
        self.held = 0

    def __call__(self, word: bytes):
        if word not in self.known:
            if self.held > MEMO_BYTES:
                self.known.clear()
                self.held = 0
            self.held += len(word) + ENTRY_BYTES
            self.known[word] = self.words.get(word) or next(
                (self.stems[word[:n]] for n in sorted(STEMS, reverse=True) if len(word) >= n and word[:n] in self.stems), None)
        return self.known[word]


def words_of(raw: bytes, lexicon: Lexicon) -> list[bytes]:
    """The words; one with an apostrophe is whole if the lexicon has it so, else its parts."""
    out = []
    for w in WORD.findall(raw):
        out += [w] if b"'" not in w or w in lexicon.words else w.split(b"'")
    return out


def lowered(text: str) -> bytes:
    return text.encode().translate(LOWER).replace(_APOSTROPHE, b"'")


def seed_words() -> dict[bytes, tuple[str, float]]:
    return {w.encode(): (c, 1.0) for c in CLASSES for w in SEEDS[c].split()}


def clauses(text: str, lexicon: Lexicon) -> list[tuple[list[tuple[str, int]], float]]:
    """The matched clauses: their readings and the weight of their insults and threats.

    Clauses end at . ! ? ; or a line's end."""
    raw = lowered(text)
    if not any((e := lexicon(w)) and e[0] in ("insult", "threat") for w in set(words_of(raw, lexicon))):
        return []
    out = []
    for clause in SENTENCE.split(raw):
        entries = [lexicon(w) for w in words_of(clause, lexicon)]
        if readings := clause_readings([e and e[0] for e in entries]):
            out.append((readings, sum(e[1] for e in entries if e and e[0] in ("insult", "threat"))))
    return out


def features(found) -> np.ndarray:
    """Matched clauses as numbers: the weight of each reading, and any at all."""
    out = np.zeros(len(READINGS) + 1)
    for readings, weight in found:
        for r in readings:
            out[READINGS.index(r)] += weight / len(readings)
    out[-1] = bool(found)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """id, text and y (0 or 1) of about ``sample`` ids of each label, chosen by hash.  Ids with two
    different labels, null ids and null labels teach nothing.  The chosen ids, about 2 * ``sample``
    whatever the input, are broadcast to the texts, so that no other text is shuffled."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
    known = sample_by_hash(known.filter("y = z").select("id", "y"), "y", ("id",), sample)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(known), "id").select("id", "text", F.col("y").cast("int").alias("y"))

    def least_shingle(batches):
        import xxhash

        for b in batches:
            made = []
            for t in b.column("text").to_pylist():
                w = t.split()
                made.append(min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], names=["id", "text", "y", "least"])

    # near copies share words by copying: of those with one least shingle hash one teaches
    return chosen.mapInArrow(least_shingle, "id long, text string, y int, least long").groupBy("least", "y").agg(
        F.min_by(F.struct("id", "text"), F.struct("id", "text")).alias("r")).select("r.id", "r.text", "y")


def train(sample: DataFrame) -> dict:
    """The weighted lexicon and the clause weights from a bounded sample (id, text, y).

    Words and stems are counted over the sample's documents in Spark; an entry must stand
    in ``LEAST_DOCS`` toxic ones and ``LEAST_SHARE`` of them, and lean ``LEAST_LOG_ODDS`` towards them.  What reaches
    the driver is bounded by the sample: entries, and for each document a feature row."""
    rows = sample.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).checkpoint()
    sizes = np.zeros((2, 2))
    for r in rows.groupBy("fold", "y").count().collect():
        sizes[r["fold"], r["y"]] = r["count"]
    if not sizes.sum(0).all():
        return {"words": seed_words(), "stems": {}, "weights": np.ones(len(READINGS) + 1), "bias": -4.0}

    def count(batches):
        from collections import Counter, defaultdict

        seen, seeds = defaultdict(Counter), Lexicon(seed_words(), {})
        for b in batches:
            for t, y, k in zip(*(b.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                words = set(words_of(lowered(t), seeds))
                seen[k, y].update({w + b"$" for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n})
        for (k, y), entries in seen.items():
            names = list(entries)
            for i in range(0, len(names), 100_000):
                part = names[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([2 * k + y] * len(part), pa.int32()), pa.array([entries[e] for e in part], pa.int64())], names=["entry", "cell", "n"])

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)]
    least = max(LEAST_DOCS, LEAST_SHARE * sizes[:, 1].sum())
    counted = (rows.select("text", "y", "fold").mapInArrow(count, "entry binary, cell int, n long").groupBy("entry").agg(*cells)
               .filter(F.col("n1") + F.col("n3") >= least / 2)
               .filter(F.log((F.col("n1") + F.col("n3")) / sizes[:, 1].sum()) - F.log((F.col("n0") + F.col("n2") + PSEUDO) / (sizes[:, 0].sum() + PSEUDO)) >= LEAST_LOG_ODDS - 1).collect())
    n = np.array([[r[f"n{c}"] for c in range(4)] for r in counted], float).reshape(-1, 2, 2)
    names = [bytes(r["entry"]) for r in counted]
    # the machine's weights are learned on each half with the other half's lexicon
    lexicons = [_entries(names, n[:, 1 - k], sizes[1 - k]) for k in range(2)]
    words, stems = _entries(names, n.sum(1), sizes.sum(0))

    def measure(batches):
        lex = [Lexicon(*x) for x in lexicons]
        for b in batches:
            made = [features(clauses(t, lex[k])).tolist() for t, k in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(made, pa.list_(pa.float64()))], names=["y", "x"])

    known = rows.select("text", "y", "fold").mapInArrow(measure, "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in known]), np.array([r["y"] for r in known], float)
    weights, bias = _logistic(x, y)
    return {"words": words, "stems": stems, "weights": weights, "bias": bias}


def _entries(names: list[bytes], n: np.ndarray, sizes: np.ndarray):
    """Word and stem entries of the lexicon that these document counts teach, with the seeds."""
    odds = np.log(np.maximum(n[:, 1], 1e-9) / max(sizes[1], 1)) - np.log((n[:, 0] + PSEUDO) / (sizes[0] + PSEUDO))
    good = (n[:, 1] >= max(LEAST_DOCS, LEAST_SHARE * sizes[1])) & (odds >= LEAST_LOG_ODDS)
    learned = {names[i]: ("insult", float(odds[i])) for i in np.flatnonzero(good)}
    words = seed_words() | {k[:-1]: v for k, v in learned.items() if k.endswith(b"$")}
    return words, {k: v for k, v in learned.items() if not k.endswith(b"$")}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps with weights of at least zero, so that more
    evidence never lowers a score: what comes out negative is left out and the rest is fitted
    again."""
    used = list(range(x.shape[1]))
    while True:
        z = np.hstack([x[:, used], np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        penalty = np.diag([ridge] * len(used) + [1e-3])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T * (p * (1 - p)) @ z + penalty, z.T @ (y - p) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1])
            out[used] = w[:-1]
            return out, float(w[-1])
        used = [c for c, v in zip(used, w[:-1], strict=True) if v >= 0]


def score(docs: DataFrame, model: dict, keep: dict[str, str] | None = None, text: str = "text", spans: bool = False) -> DataFrame:
    """The columns of ``keep`` (doc_id by default), score (0 to 1), n_clauses (matched
    clauses) and with ``spans`` their readings.

    Null and empty texts have no clause and so the score of a text without one.  Whole
    texts; rows are independent; no other column is read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        lexicon = Lexicon(m["words"], m["stems"])
        names = [f"{kind}:{'+'.join(n for n, bit in (('target', TARGET), ('negated', NEGATED), ('reported', REPORTED)) if state & bit) or 'plain'}" for kind, state in READINGS]

        def work(texts):
            found = [clauses(t, lexicon) if t else [] for t in texts]
            x = np.array([features(f) for f in found]).reshape(len(texts), len(READINGS) + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ m["weights"] + m["bias"], -30, 30)))
            out = [p.tolist(), [len(f) for f in found]]
            return out + [[[names[READINGS.index(r)] for readings, _ in f for r in readings] for f in found]] * spans

        return work

    return map_text(docs, keep or {"doc_id": "doc_id"}, text, make, "score double, n_clauses int" + ", readings array<string>" * spans)
