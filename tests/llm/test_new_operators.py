"""Collocations, WARC archives and vector codes: brute force, round trips and odd rows."""

import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lodestat.llm import collocations, gridcodes, warc
from lodestat.llm.common import bitmap


def test_bitmap_has_what_it_was_given(spark):
    own = np.random.default_rng(0).integers(-(2**63), 2**63, 3000)
    made = bitmap(spark.createDataFrame([(int(x),) for x in own], "h long"))
    assert made.has(own.view(np.uint64)).all()
    other = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    assert made.has(other.view(np.uint64)).mean() < 0.2
    assert not bitmap(spark.createDataFrame([], "h long")).has(own.view(np.uint64)).any()


def texts(spark, rows):
    return spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, rank int, phrase string, n int")


def brute(rows, least, top):
    out, found = [], {}
    for t, g in rows:
        own = found.setdefault(g or "und", [Counter(), 0])
        line = "".join(c.lower() if "A" <= c <= "Z" else "." if c in ".,;:!?\n\x0b\x0c\r" else c for c in t or "")
        for piece in line.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            own[1] += len(w)
            own[0].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    for g, (f, n) in found.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, k = min((Fraction(1000 * a * n, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(g, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


ODD_TEXTS = [(None, "en"), ("", None), (". . ,", "en"), ("Über x A\tb  c\x1cd. a b\nc a b", None), ("a b " * 3000, "xx"), ("z " * 9, "xx"), ("z " * 9, "xx")]


@pytest.mark.parametrize("budget", [3, 40, 1 << 19])
def test_collocations_against_brute_force(spark, budget):
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(["a", "B", "c", "d.", "the cat sat on it", f"w{i % 9}", "é"], 40)), ["en", "fr", None][i % 3]) for i in range(90)] + ODD_TEXTS
    made = collocations.collocations(texts(spark, rows).repartition(5), top=30, least=4, budget=budget)
    assert sorted(map(tuple, made.collect())) == brute(rows, 4, 30)


def test_collocations_without_candidates(spark):
    assert collocations.collocations(texts(spark, [])).count() == 0
    assert collocations.collocations(texts(spark, ODD_TEXTS[:4])).count() == 0


def test_collocations_survive_full_vocabularies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["a", "b", "c", f"w{i % 5}"], 30)), "en") for i in range(60)]
    monkeypatch.setattr(collocations, "HELD_BYTES", 1)
    monkeypatch.setattr(collocations, "HELD_ROWS", 4)
    # in this process, slice by slice: what is passed on early is summed later all the same
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"lang": g, "text": t}]) for t, g in rows]
    seen = Counter()
    for g, own in collocations.by_language(iter(batches)):
        words = collocations.Vocabulary(g)
        at = words.numbers(own)
        seen.update(words.words[i] for i in at)
    assert seen[b"a"] == sum(t.split().count("a") for t, _ in rows)
    assert sorted(map(tuple, collocations.collocations(texts(spark, rows), least=5).collect())) == brute(rows, 5, 2000)


SEP = warc.SEPARATOR.decode()
PAGES = [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (9, None, "x" * 1200), (9, "http://a/9", "x" * 1200), (3, "u", "short"), (4, "u", "short"),
         (5, "http://b/ü?q=a b\r\nWARC-Type: evil", None), (6, "", ""), (None, "n", "y" * 1500), (None, "n", "y" * 1500), (None, "m", "z" * 1500), (7, "m", "z" * 1500),
         (8, "s", SEP * 200), (10, "s", ("é\r\n\r\n日本" + SEP) * 3000), (11, "l", "long " * 400_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id long, url string, html string, key string, payload binary")


def expected(rows):
    heads = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            heads[h] = max(heads.get(h, -1), -1 if i is None else i)
    out = []
    for i, u, h in rows:
        body = (h or "").encode()
        head = heads.get(h, -1)
        other = head if head >= 0 and head != i else None
        out.append((i, u, "response" if other is None else "revisit", other, hashlib.sha1(body).hexdigest(), len(body)))
    return Counter(out)


@pytest.mark.parametrize("most", [0, 100_000])
def test_archives_come_back(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)  # the salted join, and the broadcast
    path = str(tmp_path / "w")
    warc.write(pages(spark, PAGES).repartition(3), path)
    assert Counter(map(tuple, warc.read(spark, path).collect())) == expected(PAGES)
    bodies = {r["page_id"]: bytes(r["payload"]) for r in warc.read(spark, path, payload=True).filter("record_type = 'response' and page_id is not null").collect()}
    assert all(bodies[i] == (h or "").encode() for i, _, h in PAGES if i in bodies) and 10 in bodies


def test_archives_are_cut_anywhere(spark, tmp_path):
    path, rows = str(tmp_path / "w"), [(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(300)]
    warc.write(pages(spark, rows).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777b")
    try:
        assert warc.read(spark, path).rdd.getNumPartitions() > 3
        assert Counter(map(tuple, warc.read(spark, path).collect())) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archives_are_zstandard_streams(spark, tmp_path):
    import zstandard

    path = tmp_path / "w"
    rows = [(i, f"http://h/{i}", f"<html><body><p>page {i} of many pages</p></body></html>" * 5) for i in range(200)]
    warc.write(pages(spark, rows).coalesce(1), str(path))
    (found,) = path.glob("*" + warc.SUFFIX)
    data = found.read_bytes()
    assert data[:4] == warc.DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert held.dict_id()  # trained
    whole = zstandard.ZstdDecompressor(dict_data=held).stream_reader(data[8 + size :], read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 201 and whole.count(b"WARC-Type: response") == 200
    assert len(data) - size < len(whole) / 4


def test_no_archives(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_damaged_record_is_found(spark, tmp_path):
    good = warc.page_record(1, "u", b"body", None, False, "2024-01-01T00:00:00Z")
    fields, block = warc.parse(good)
    assert fields["warc-type"] == "response" and block.endswith(b"\r\n\r\nbody")
    with pytest.raises(ValueError):
        warc.parse(good[:-1])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<float>, label int, error string, codes int")


def brute_codes(rows):
    rows = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64), g) for i, v, g in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.stack([r[1] for r in rows])
    w = x.shape[1] // 4
    parts = [x[:, p * w : (p + 1) * w] for p in range(4)]
    books = [p[:256].copy() for p in parts]

    def nearest():
        d = [((p[:, None, :] - b[None]) ** 2).sum(2) for p, b in zip(parts, books, strict=True)]
        return [k.argmin(1) for k in d], [k.min(1) for k in d]

    for _ in range(4):
        codes, _ = nearest()
        for p, b, c in zip(parts, books, codes, strict=True):
            for e in range(len(b)):
                if (c == e).any():
                    b[e] = p[c == e].sum(0) // (c == e).sum()
    codes, errors = nearest()
    error = sum(errors)
    sums = Counter()
    for r, e in zip(rows, error, strict=True):
        sums[r[2]] += int(e)
    text = ",".join(str(k) for b in books for k in b.ravel())
    digest = hashlib.sha256(text.encode()).hexdigest()
    return Counter((r[0], "".join(f"{c[k]:02x}" for c in codes), int(error[k]), sums[r[2]], digest) for k, r in enumerate(rows))


@pytest.mark.parametrize("n", [3, 700])
def test_vector_codes_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(0, 0.1, 12).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * 12, 1), (n + 2, [float("nan")] * 12, 1), (n + 3, [float("-inf")] + [0.0] * 11, 1), (None, [0.5] * 12, None), (0, [0.0] * 12, 1), (0, [0.0] * 12, 1)]
    rows += [(n + 10 + i, [0.25] * 12, 7) for i in range(300)]  # one very common vector
    made = gridcodes.vector_codes(vectors(spark, rows).repartition(4))
    assert Counter(map(tuple, made.collect())) == brute_codes(rows)


def test_vector_codes_of_nothing_and_of_uneven_parts(spark):
    assert gridcodes.vector_codes(vectors(spark, [])).count() == 0
    assert gridcodes.vector_codes(vectors(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        gridcodes.vector_codes(vectors(spark, [(1, [0.5] * 6, 1)])).count()


@pytest.mark.parametrize("spread", [1, 9, 4000])
def test_cells_keep_the_nearest_and_its_ties(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (200, 5))
    finder = gridcodes.NearestEntries(entries, limit=10_000)
    for _ in range(4):  # cells remembered, and forgotten at the limit
        parts = rng.integers(-2 * spread, 2 * spread + 1, (500, 5))
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        code, error = finder(parts)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()


def test_decoded_vector_has_the_error(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.1, 8).tolist(), 1) for i in range(400)]
    books = gridcodes.train(vectors(spark, rows))
    for r in gridcodes.encode(vectors(spark, rows), books, {"vec_id": "vec_id", "v": "embedding"}).collect():
        x = np.floor(1024 * np.array(r["v"], np.float64)).astype(np.int64)
        assert ((x - gridcodes.decode(bytes(r["codes"]), books)) ** 2).sum() == r["error"]


def _library(extra=()):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for content in extra:
        spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257 + len(spec["added_tokens"]), "content": content})
    text = json.dumps(spec)
    return text, Tokenizer.from_str(text)


@pytest.mark.parametrize("extra", [(), ("Mr.", "word,")])
def test_chunks_between_newlines_and_signs_encode_as_the_library_does(extra):
    import random

    from lodestat.llm.token_store import library_encoder

    spec, library = _library(extra)
    encode, rng = library_encoder(spec, 1 << 16), random.Random(5)
    parts = ["a", "B", "é", "ß", "1", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r\n", ".", ",", "'s", "...", "　", "\xa0", "\x1c", "\x85",
             "word", "Mr", "Mr.", "<|endoftext|>", "\n ", " \n", " ", "٣"]
    for _ in range(600):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, sizes = encode(texts)
        assert (ids.tolist(), sizes.tolist()) == ([i for w in want for i in w], [len(w) for w in want]), texts


def test_words_beside_newlines_are_encoded_once():
    from lodestat.llm.pretokens import ChunkEncoder
    from lodestat.llm.token_store import library_encoder

    spec, library = _library()
    given = []

    def counted(texts):
        given.extend(texts)
        return [library.encode(t, add_special_tokens=False).ids for t in texts]

    words = [a + b for a in "abcdefgh" for b in "ijklmnop"]
    text = "x " + " ".join(f"{a}.\n{b}" for a in words for b in words)   # 4096 pairs of 64 words
    ids, _ = ChunkEncoder(counted, library_encoder(spec).sizes)([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, given)) < 64 * 100


def test_a_row_counts_a_gram_and_the_context_that_it_makes(spark):
    import random

    import xxhash

    from lodestat.llm import pst

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c", "D"], k=rng.randint(0, 30))) for _ in range(60)] + [None]
    words = [pst.tokens(t) for t in texts]

    def code(ws):
        held = np.full(1, pst._ROOT)
        for w in reversed(ws):
            held = pst.mix(held, np.array([xxhash.xxh64_intdigest(w)], np.uint64))
        return int(held.view(np.int64)[0])

    ones = Counter(code(ws[i : i + 1]) for ws in words for i in range(len(ws) - 1))
    twos = Counter(code(ws[i : i + 2]) for ws in words for i in range(len(ws) - 2))
    level = pst._bits(spark.createDataFrame([(c,) for c in ones], "context long"))
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    made = pst.count_next(frame, [level], True).collect()
    assert sum(r["n"] for r in made) == sum(len(ws) - 1 for ws in words)   # a row for each gram, and none beside them
    assert {r["longer"]: r["n"] for r in made if r["longer"] is not None} == twos
    assert {c: sum(r["n"] for r in made if r["context"] == c) for c in ones} == ones


def test_pairs_in_bulk_take_few_bytes_and_lose_none(spark):
    """F1 op4_suffix_tree (disk): a pair's row of six longs took over 36 bytes."""
    import random

    import pyarrow as pa

    from lodestat.llm import pst

    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=400)) for _ in range(120)] + [None, "", " \tA  b\x1fC\n"]
    hashes, at, sizes = pst.stream(pa.array(texts))
    import xxhash

    assert hashes[at].tolist() == [xxhash.xxh64_intdigest(w) for t in texts for w in pst.tokens(t)]
    assert sizes.tolist() == [len(pst.tokens(t)) for t in texts]
    ones = {int(h) for h in pst.mix(pst._ROOT, hashes[:-1]).view(np.int64)}
    level = pst._bits(spark.createDataFrame([(c,) for c in ones], "context long"))
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = pst.pairs(frame, spark.sparkContext.broadcast([level]), 1, 3).collect()
    want = Counter(p for t in texts for p in zip(pst.tokens(t), pst.tokens(t)[1:], strict=False))
    assert sum(int(pst._unpack(r["n"]).sum()) for r in rows) == sum(want.values())
    assert sum(len(r["n"]) // 8 for r in rows) == len(want) > 40_000
    import zlib

    assert sum(len(zlib.compress(bytes(r[c]), 1)) for r in rows for c in ("contexts", "words", "runs", "codes", "n")) < 6 * len(want)


def test_suffix_tree_scores_do_not_depend_on_blocks_and_rounds(spark):
    import random

    from lodestat.llm import pst

    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcde", k=rng.randint(0, 60)))) for i in range(90)] + [(None, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    model = pst.train(docs.filter("doc_id % 3 > 0"), support=8)
    assert len(model["levels"]) > 1
    made = [sorted(map(str, pst.score(docs, model, block_bytes=size, rounds=rounds).collect())) for size, rounds in ((1 << 20, 1), (200, 2))]
    assert made[0] == made[1] and len(made[0]) == docs.count()


def test_tasks_of_the_suffix_tree_get_small_batches_and_sums_leave_the_disk(spark, tmp_path):
    """op4_suffix_tree (an executor's memory on 0.51 GB): a task got 10,000 texts in a batch."""
    import os

    import pyarrow as pa

    from lodestat.llm import pst
    from lodestat.llm.common import dropped

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([int(b.num_rows > 5000)], pa.int32()), "n": pa.array([b.num_rows], pa.int64())})

    made = pst._written(spark.range(9000).coalesce(1).selectExpr("repeat('word ', 200) AS text").mapInArrow(sizes, "kind int, n long"), "test-sizes", by="kind")
    found = [r["n"] for r in made.collect()]
    assert sum(found) == 9000 and max(found) <= 4096
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"   # as it was
    kinds = pst._written(spark.range(30).selectExpr("CAST(id % 3 AS int) AS kind", "id"), "test-kinds", by="kind")
    folders = {os.path.dirname(f.removeprefix("file://")) for f in kinds.inputFiles()}
    dropped(kinds, "kind", 0)
    assert sorted(os.path.basename(f) for f in folders if os.path.exists(f)) == ["kind=1", "kind=2"]
    assert sorted(r["id"] for r in kinds.filter("kind = 2").collect()) == list(range(2, 30, 3))


def test_orders_and_small_packs_are_exact():
    from lodestat.llm import pst

    rng = np.random.default_rng(1)
    near = (rng.integers(0, 9, 5000, dtype=np.uint64) << np.uint64(40)) + rng.integers(0, 3, 5000, dtype=np.uint64)   # only lower bits differ
    for keys in (np.zeros(0, np.uint64), np.full(7, 5, np.uint64), near, rng.integers(0, 1 << 64, 5000, dtype=np.uint64)):
        order = pst._order(keys)
        assert sorted(order.tolist()) == list(range(len(keys)))
        assert keys[order].tolist() == sorted(keys.tolist())
        assert pst._unpack_small(pst._pack_small(keys)).tolist() == keys.tolist()
        assert pst._unpack_sorted(pst._pack_sorted(keys[order])).tolist() == sorted(keys.tolist())
    assert len(pst._pack_small(np.ones(100, np.int64))) < 110
