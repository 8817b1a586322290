"""Phrase collocation mining by vertical partitioning of a suffix tree.

The suffixes of all pieces, cut after ``MOST_WORDS`` words, form a suffix tree over words.
It is never built whole: its prefixes are counted word by word, a prefix whose suffixes
pass a memory budget is extended by one more word, and the prefixes that fit are dealt
into groups.  Each group's subtree is built on its own, as the sorted array of its distinct
suffixes (the leaves) with their counts, and a phrase's count is the total of the leaves
below its node.

Only what cannot be a candidate is left out: a suffix ends before the first pair of words
that is rarer than the least count.  Pairs and prefixes are told apart by 64-bit hashes
there, so a collision only keeps more; phrases and counts are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, bitmap, slices, written

MOST_WORDS = 5
LEAST_COUNT = 100
#: Suffixes that a group of prefixes may hold; a group is one task's work in memory.
BUDGET = 1 << 19
#: Bytes of distinct words and rows of counts that a task holds before it passes them on.
HELD_BYTES, HELD_ROWS = 24 << 20, 1 << 20
#: Parts in which a language's ranks are found before the last merge.
RANK_PARTS = 64
_BREAK = b"."
_TABLE = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else LOWER[c] for c in range(256))


def stream(texts: list[str | None]) -> list[bytes]:
    """The words of the texts, ASCII letters lower-cased; "." stands after each piece."""
    return b" . ".join([(t or "").encode().translate(_TABLE).replace(_BREAK, b" . ") for t in texts] + [b""]).split()


class Vocabulary(dict):
    """Numbers the words of one language in the order in which they come; 0 is a break."""

    def __init__(self, lang: str):
        import xxhash

        self.lang, self.words, self.codes, self.bytes = lang, [_BREAK], [0], 0
        self.hash, self.seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
        self[_BREAK] = 0

    def __missing__(self, word):
        self[word] = n = len(self)
        self.words.append(word)
        self.codes.append(self.hash(word, self.seed))
        self.bytes += len(word) + 150
        return n

    def numbers(self, texts) -> np.ndarray:
        words = stream(texts)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return np.array(self.codes, np.uint64)


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix and the word after it."""
    x = (prefix ^ (word * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def by_language(batches):
    """(language, texts) of slices of the batches."""
    for b in batches:
        for part in slices(b, "text"):
            found: dict[str, list] = {}
            for g, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                found.setdefault(g, []).append(t)
            yield from found.items()


def summed(columns: list[np.ndarray], counts: np.ndarray, key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns merged and their counts summed.  ``key`` is a hash of the
    row: rows are sorted by it and merged only if they are equal."""
    if not len(counts):
        return columns, counts
    order = np.argsort(key, kind="stable")
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def count_words(texts: DataFrame) -> DataFrame:
    """lang, word, n of every word, and a row with a null word and the number of all."""
    def run(batches):
        held: dict[str, tuple[Vocabulary, np.ndarray]] = {}

        def out():
            for g, (words, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(n)), pa.array([None, *words.words[1:]], pa.binary()).cast(pa.string()),
                     pa.array(np.concatenate([[n[1:].sum()], n[1:]]))], names=["lang", "word", "n"])
            held.clear()

        for g, own in by_language(batches):
            words, total = held.get(g) or (Vocabulary(g), np.zeros(0, np.int64))
            at = words.numbers(own)
            n = np.bincount(at, minlength=len(words))
            n[: len(total)] += total
            held[g] = words, n
            if sum(w.bytes for w, _ in held.values()) > HELD_BYTES:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Prefixes:
    """What tasks know of the tree's top: which words and pairs are frequent, and which
    prefixes of 1, 2, ... words hold more suffixes than a group may (all as bitmaps)."""

    def __init__(self, words, pairs=None, heavy=()):
        self.words, self.pairs, self.heavy = words, pairs, list(heavy)

    def runs(self, at: np.ndarray, code: np.ndarray, most: int) -> np.ndarray:
        """How many words (0 to ``most``) the suffix at each place keeps."""
        good = self.words.has(code)
        good[0] = False
        good = good[at]
        pair = np.zeros(len(at), bool)
        both = np.flatnonzero(good[:-1] & good[1:])
        pair[both] = True if self.pairs is None else self.pairs.has(longer(code[at[both]], code[at[both + 1]]))
        n = good.astype(np.int8)
        reach = good
        for k in range(1, most):
            reach = reach[:-1] & pair[k - 1 : len(at) - 1]
            n[: len(reach)] += reach
        return n


def count_prefixes(texts: DataFrame, known: _Prefixes, depth: int) -> DataFrame:
    """h, n: the prefixes of ``depth`` words whose prefixes one word shorter are all heavier
    than a group (for pairs: all pairs of frequent words)."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known, held, words = shared.value, [], {}

        def merged():
            h, n = (np.concatenate(c) for c in zip(*held, strict=True))
            (h,), n = summed([h], n, h)
            held[:] = [(h, n)]
            return h, n

        for g, own in by_language(batches):
            vocabulary = words.setdefault(g, Vocabulary(g))
            at = vocabulary.numbers(own)
            code = vocabulary.hashes()
            place = np.flatnonzero(known.runs(at, code, depth) >= depth)
            h = code[at[place]]
            for d in range(1, depth):
                if depth > 2:
                    keep = known.heavy[d - 1].has(h)
                    place, h = place[keep], h[keep]
                h = longer(h, code[at[place + d]])
            (h,), n = summed([h], np.ones(len(h), np.int64), h)
            held.append((h, n))
            if sum(len(n) for _, n in held) > HELD_ROWS:
                h, n = merged()
                if len(n) > HELD_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                    held.clear()
            if sum(w.bytes for w in words.values()) > HELD_BYTES:
                words.clear()
        if held:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def suffixes(texts: DataFrame, known: _Prefixes, groups: int) -> DataFrame:
    """group, lang, suffix (2 to ``MOST_WORDS`` words, space-joined), whole (words of the
    prefix that the group has all of), n."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known, words, held = shared.value, {}, {}

        def merged(g):
            cols, n = [np.concatenate([c[0][k] for c in held[g]]) for k in range(MOST_WORDS)], np.concatenate([c[1] for c in held[g]])
            code, key = words[g].hashes(), np.zeros(len(n), np.uint64)
            for c in cols:
                key = longer(key, code[c])
            cols, n = summed(cols, n, key)
            held[g] = [(cols, n)]
            return cols, n

        def out(g):
            cols, n = merged(g)
            held[g] = []
            code, names = words[g].hashes(), words[g].words
            h = code[cols[0]]
            whole = np.ones(len(n), np.int8)
            for d in range(1, len(known.heavy) + 1):  # a heavy prefix is extended by a word
                more = (whole == d) & known.heavy[d - 1].has(h)
                if d < MOST_WORDS:
                    h = np.where(more & (cols[d] > 0), longer(h, code[cols[d]]), h)
                whole = whole + more
            group = (h % np.uint64(groups)).astype(np.int64)
            for i in range(0, len(n), 100_000):
                part = [c[i : i + 100_000].tolist() for c in cols]
                text = [b" ".join([names[w] for w in row if w]) for row in zip(*part, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[i : i + 100_000]), pa.array([g] * len(text)), pa.array(text, pa.binary()).cast(pa.string()),
                     pa.array(whole[i : i + 100_000].astype(np.int32)), pa.array(n[i : i + 100_000])], names=["group", "lang", "suffix", "whole", "n"])

        for g, own in by_language(batches):
            vocabulary = words.setdefault(g, Vocabulary(g))
            at = vocabulary.numbers(own)
            runs = known.runs(at, vocabulary.hashes(), MOST_WORDS)
            place = np.flatnonzero(runs >= 2)
            end = runs[place]
            # a break is number 0, and so is what lies beyond a suffix's end
            cols = [np.where(end > k, at[np.minimum(place + k, len(at) - 1)], 0) for k in range(MOST_WORDS)]
            held.setdefault(g, []).append((cols, np.ones(len(place), np.int64)))
            if sum(len(x[1]) for x in held[g]) > HELD_ROWS and len(merged(g)[1]) > HELD_ROWS // 2:
                yield from out(g)
            if sum(w.bytes for w in words.values()) > HELD_BYTES or sum(len(x[1]) for xs in held.values() for x in xs) > 2 * HELD_ROWS:
                for x in list(words):
                    if held.get(x):
                        yield from out(x)
                words.clear()
                held.clear()
        for x in list(words):
            if held.get(x):
                yield from out(x)

    rows = texts.mapInArrow(run, "group long, lang string, suffix string, whole int, n long")
    # a hot suffix is summed in the map tasks, before it moves, like any other
    return rows.groupBy("group", "lang", "suffix", "whole").agg(F.sum("n").alias("n"))


def subtree(leaves: pa.Table, least: int) -> pa.Table:
    """lang, phrase, n of the nodes of 2 words or more of one group's subtree: those of
    ``least`` or more, and, as other groups may have the rest of them, all that are shorter
    than the leaf's whole prefix."""
    n = leaves.column("n").to_numpy()
    lists = pc.split_pattern(pc.cast(leaves.column("suffix"), pa.string()), " ").combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    flat, first = words.indices.to_numpy(zero_copy_only=False), np.cumsum(size) - size
    codes = np.full((MOST_WORDS, len(n)), -1, np.int32)
    for k in range(MOST_WORDS):
        has = np.flatnonzero(size > k)
        codes[k, has] = flat[first[has] + k]
    lang = leaves.column("lang").combine_chunks().dictionary_encode()
    spoken = lang.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort([*codes[::-1], spoken])
    codes, n, spoken = codes[:, order], n[order], spoken[order]
    whole = leaves.column("whole").to_numpy()[order]
    new = np.zeros(len(n), bool)
    new[0] = True
    new[1:] = spoken[1:] != spoken[:-1]
    names, out = words.dictionary.to_pylist(), []
    for k in range(MOST_WORDS):
        new[1:] |= codes[k, 1:] != codes[k, :-1]
        if not k:
            continue
        node = np.flatnonzero(new)
        total = np.add.reduceat(n, node)
        keep = (codes[k, node] >= 0) & ((total >= least) | (whole[node] > k + 1))
        node, total = node[keep], total[keep]
        rows = codes[: k + 1, node].T.tolist()
        out.append(pa.table({"lang": lang.dictionary.take(pa.array(spoken[node])), "phrase": pa.array([" ".join([names[w] for w in r]) for r in rows], pa.string()),
                             "n": pa.array(total)}))
    return pa.concat_tables(out)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, budget: int = BUDGET) -> dict[str, DataFrame]:
    """words (lang, phrase, f: single words of ``least`` or more), phrases (the same for 2 to
    ``MOST_WORDS`` words) and sizes (lang, n: all word occurrences), written frames.

    A null language is ``und``, a null text is empty, repeated rows count again; an empty
    table gives empty frames.  The table is read three times, and once more for each
    further word by which prefixes have to be extended."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    counts = written(count_words(texts).filter((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    sizes = counts.filter("word is null and n > 0").select("lang", "n")
    words = counts.filter((F.col("n") >= least) & F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    hashed = words.mapInArrow(_hash_words, "h long, n long")
    known = _Prefixes(bitmap(hashed), heavy=[bitmap(hashed.filter(F.col("n") > budget))])
    pairs = written(count_prefixes(texts, known, 2).filter(F.col("n") >= least), "phrase-pairs")
    known.pairs = bitmap(pairs)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    heavy = pairs.filter(F.col("n") > budget)
    while not heavy.isEmpty() and len(known.heavy) < MOST_WORDS - 1:
        known.heavy.append(bitmap(heavy))
        depth = len(known.heavy) + 1
        if depth < MOST_WORDS:
            heavy = written(count_prefixes(texts, known, depth).filter(F.col("n") > budget), "phrase-prefixes")
    leaves = suffixes(texts, known, max(1, -(-total // budget)))
    nodes = leaves.groupBy("group").applyInArrow(lambda t: subtree(t, least), "lang string, phrase string, n long")
    made = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return {"words": words, "phrases": written(made, "phrases"), "sizes": sizes}


def _hash_words(batches):
    import xxhash

    h = xxhash.xxh64_intdigest
    for b in batches:
        seeds = {g: h(g.encode()) & 0xFFFFFFFF for g in set(b.column("lang").to_pylist())}
        made = [h(w.encode(), seeds[g]) for g, w in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(made, np.uint64).view(np.int64)), b.column("f")], names=["h", "n"])


def collocations(docs: DataFrame, top: int = 2000, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut of lowest score
    floor(1000 * a * n / (l * r)), the shortest first part on ties; products are decimals of
    38 digits.  A phrase that lies in a longer one as frequent as itself is left out; as
    the phrases between them are then as frequent too, those one word longer decide.  Ranks
    go by score, then a (both descending), then the phrase's bytes.  Other columns of
    ``docs`` are not read; see ``phrases`` for nulls, repeated rows and empty tables."""
    made = phrases(docs, text, lang, least, budget)
    own = made["phrases"].withColumn("w", F.split("phrase", " ", -1))
    every = made["words"].unionByName(made["phrases"])
    part = lambda a, n: F.concat_ws(" ", F.slice("w", a, n))
    size = F.size("w")
    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(made["sizes"], "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("u", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn("v", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("cast(u div v as long)"))
    low = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = own.filter(size > 2).select("lang", "f", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = low.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # each part's best first, so that a language's last sort has a bounded number of rows
    few = kept.withColumn("i", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("i") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB: every phrase counted, every longer candidate compared.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') AS p1, array_to_string(w[k + 1 : m], ' ') AS p2
         FROM cand, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, n,
                  CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.phrase = c.p2 JOIN sizes s ON s.lang = c.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM low c WHERE NOT EXISTS (
  SELECT 1 FROM cand g WHERE g.lang = c.lang AND g.m > c.m AND 100 * g.a >= 100 * c.a AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
