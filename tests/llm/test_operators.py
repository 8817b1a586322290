"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns, and brute force."""

from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestat.llm import bpe, covertree, decontaminate, langid, licenses, pst, simhash, token_store, toxicity, wrappers
from lodestat.llm.common import written
from lodestat.llm.components import components

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (None, "x  y  z　 "), (5, "don't 1234 !!\r\n  été 日本 😀"), (6, "ab" * 50_000), (7, "The cat, the cat; THE CAT.")]


def frame(spark, rows=ODD):
    """Texts with columns whose names could clash."""
    return spark.createDataFrame([(i, t, "x", 0.5, "h") for i, t in rows], "doc_id long, text string, score string, n_tokens double, __llm_host string")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_library_and_decodes(spark, ranks):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    made = bpe.encode(frame(spark), ranks, P.PATTERN, {"doc_id": "doc_id", "t": "text"}, decoded=True).collect()
    assert len(made) == len(ODD)
    for r in made:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == own.encode_ordinary(r["t"] or "") and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (r["t"] or "").encode()
    again = bpe.decode(bpe.encode(frame(spark), ranks, P.PATTERN), ranks).select("decoded").collect()
    assert Counter(bytes(r["decoded"]) for r in again) == Counter((t or "").encode() for _, t in ODD)
    assert bpe.encode(frame(spark, []), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
        planes = token_store.to_planes(ids, kind)
        assert len(planes) == (4 if kind == "byte" else 32)
        assert (token_store.from_planes(planes, n, kind) == ids).all()


@pytest.mark.parametrize(("kind", "block"), [("byte", 64), ("bit", 1000)])
def test_token_store_equals_library(spark, tmp_path, kind, block):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    rows = [r for r in ODD if r[0] is not None]
    token_store.write(frame(spark, rows).repartition(3), str(tmp_path / "s"), spec, 2, block_ids=block, kind=kind)
    store = token_store.open_store(spark, str(tmp_path / "s"))
    assert store.agg(F.max("n_ids")).first()[0] <= block
    made = sorted(map(tuple, token_store.read_documents(store).select("doc_id", "start", "n_tokens", "ids").collect()), key=lambda r: r[1])
    library, at = Tokenizer.from_str(spec), 0
    for (one, text), (doc_id, start, n, ids) in zip(sorted(rows, key=lambda r: r[0]), made, strict=True):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (doc_id, start, n, np.frombuffer(ids, "<u4").tolist()) == (one, at, len(want), want)
        at += n
    token_store.write(frame(spark, []), str(tmp_path / "e"), spec, 2)
    assert token_store.read_documents(token_store.open_store(spark, str(tmp_path / "e"))).count() == 0


def test_license_templates_and_base_places(spark):
    rows = [(1, "Under the MIT License, under the mit license!"), (2, "under the terms of the MIT license"), (3, "under the gpl mit license"),
            (4, "GNU Lesser General Public License as published by the Free Software Foundation, either version 2"), (5, None), (6, "CC-BY-NC-SA 4.0"), (7, "sous licence")]
    made = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows), spans=True).collect()}
    assert (made[1]["n_words"], made[1]["n_base"], made[1]["first_word"], made[1]["last_word"], made[1]["score"]) == (8, 2, 0, 4, 1.0)
    assert (made[2]["base_labels"], made[2]["labels"], made[2]["n_base"], made[2]["first_word"]) == ("", "mit", 0, None)
    assert 0 < made[2]["score"] < 1
    assert made[3]["labels"] == made[7]["labels"] == made[5]["labels"] == "" and made[5]["n_words"] == 0
    assert made[4]["labels"] == "gpl" and made[6]["labels"] == made[6]["base_labels"] == "cc-by-nc"


def test_template_automaton_against_expansion():
    a = licenses.Automaton("a <<optional>>b <<any 2>><<end>> c")
    accepted = {"a c": 2, "a b c": 2, "a b x c": 2, "a b x y c": 2}
    for text in ("a c", "a b c", "a b x c", "a b x y c", "a b x y z c", "a x c", "b c"):
        m = a.match(text.encode().split(), 0)
        assert (m[1] if m else None) == accepted.get(text)
        assert m is None or m[0] == len(text.split())


def test_suffix_tree_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["the", "a", "cat", "dog", "of", f"w{i}"], 30))) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    docs = frame(spark, rows)
    model = pst.train(docs, p_min=0.02, least=-1.0)
    made = pst.score(docs, model).collect()
    streams = [[*(t or "").split(), ""] for _, t in rows]
    uni = Counter(w for s in streams for w in s)
    n, v = sum(uni.values()), len(uni)
    assert (model["N"], model["V"]) == (n, v) and len(model["levels"]) == 2
    grams = {d: Counter(tuple(s[i - d : i + 1]) for s in streams for i in range(d, len(s))) for d in (1, 2)}
    least = max(2, 0.02 * n)
    states = {1: {(w,) for w, c in uni.items() if w and c >= least}}
    states[2] = {c for c, k in Counter(tuple(s[i - 2 : i]) for s in streams for i in range(2, len(s))).items() if k >= least and c[1:] in states[1]}
    size = {c: (sum(k for g, k in grams[d].items() if g[:-1] == c), sum(g[:-1] == c for g in grams[d])) for d in (1, 2) for c in states[d]}

    def p(s, i):
        out = (uni[s[i]] + 1) / (n + v + 1)
        for d in (1, 2):
            c = tuple(s[max(0, i - d) : i])
            if c not in states[d]:
                break
            out = (grams[d][c + (s[i],)] + size[c][1] * out) / (size[c][0] + size[c][1])
        return out

    want = sorted((len(s), round(sum(np.log10((uni[w] + 1) / (n + v + 1)) for w in s), 8), round(sum(np.log10(p(s, i)) for i in range(len(s))), 8)) for s in streams)
    assert sorted((r["n_tokens"], round(r["base_score"], 8), round(r["score"], 8)) for r in made) == want
    empty = pst.train(frame(spark, []))
    assert (empty["N"], empty["V"]) == (0, 0)
    assert [r["n_known"] for r in pst.score(frame(spark, [(1, "a b")]), empty).collect()] == [0]


def test_suffix_tree_keeps_contexts_by_absolute_support(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["p q r s t" if i < 40 else "x q r s u", *rng.choice([f"f{j}" for j in range(3000)], 400)])) for i in range(80)]
    model = pst.train(frame(spark, rows))
    assert model["N"] > 500 * 40  # no context makes 1/500 of the positions
    assert len(model["levels"]) == 4 and model["levels"][3].filter("c = 40").count() == 2
    score = {r["doc_id"]: r["score"] for r in pst.score(frame(spark, [(1, "p q r s t"), (2, "p q r s u"), (3, "x q r s u")]), model).collect()}
    assert score[1] > score[2] + 1 and score[3] > score[2] + 1


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    made = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert made == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = " ".join(rng.choice(list("abcdefghij"), 400))
    rows = [(i, base[: 2 * i] + "z" + base[2 * i + 1 :]) for i in range(0, 60, 3)] + [(100, None), (101, ""), (102, "one two"), (102, "one two"), (None, base)]
    made = simhash.near_duplicates(frame(spark, rows)).collect()
    own = [(i, simhash.fingerprint(t or "", 3)) for i, t in rows]
    for _, t in rows[:2]:
        w = t.split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
        assert simhash.fingerprint(t, 3) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = list(range(len(own)))
    for _ in own:
        group = [min(group[j] for j in range(len(own)) if (own[j][1] ^ own[i][1]).bit_count() <= 3) for i in range(len(own))]
    least = {g: min(own[i][0] for i in range(len(own)) if group[i] == g and own[i][0] is not None) for g in set(group)}
    want = Counter((i, np.uint64(f).astype(np.int64).item(), least[g]) for (i, f), g in zip(own, group, strict=True))
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in made) == want


def broadcast_rows(df) -> list[int]:
    """Rows of each broadcast of a frame that has run."""
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        own = [node.metrics().apply("numOutputRows").value()] if node.nodeName() == "BroadcastExchange" else []
        return own + [n for i in range(node.children().size()) for n in walk(node.children().apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("near", [0, 10])
def test_simhash_broadcasts_linked_fingerprints_at_most(spark, near):
    # a broadcast of probes, copies or all fingerprints grows with the corpus, while Spark
    # sizes it by what was exploded or by compressed files
    own = [int(x) for x in np.random.default_rng(8).integers(-(2**63), 2**63, 300)]
    rows = list(enumerate(own)) + [(300 + i, x ^ 5) for i, x in enumerate(own[:near])]
    fps = written(spark.createDataFrame(rows, "doc_id long, fp long"), "test-fps")
    links = simhash.links(fps)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(min(x, x ^ 5), max(x, x ^ 5)) for x in own[:near]}
    assert broadcast_rows(links) == []
    groups = simhash.groups(fps)
    made = {(r["doc_id"], r["fp"]): r["component_id"] for r in groups.collect()}
    assert made == {(i, x): i % 300 for i, x in rows}
    assert all(n <= 2 * near for n in broadcast_rows(groups))


def test_decontamination_tolerates_substitutions(spark):
    words = [f"w{i}" for i in range(400)]
    item = words[100:140]
    changed = [*item]
    changed[7] = changed[20] = changed[33] = "other"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (1, " ".join(item))], "item_id long, text string")
    rows = [(1, " ".join(words[:100])), (2, " ".join(words[:50] + item + words[300:])), (3, "x, " + " ".join(changed).upper()), (4, None), (5, " ".join(item[:8])), (None, " ".join(item)), (2, " ".join(words[:50] + item + words[300:]))]
    made = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert made == {2: (1, 50, 40, 40), 3: (1, 1, 40, 37), None: (1, 0, 40, 40)}
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


def test_masks_hit_wherever_a_fifth_is_changed():
    from itertools import combinations

    masks = [(sum(1 << i for i, c in enumerate(m) if c == "1"), len(m)) for m in decontaminate.MASKS]
    for n in range(13, 26):  # of a longer stretch, a half of at least 13 has four fifths too
        changed = np.array([sum(1 << p for p in c) for c in combinations(range(n), n // 5)], np.int64)
        hit = np.zeros(len(changed), bool)
        for mask, span in masks:
            for at in range(n - span + 1):
                hit |= changed & (mask << at) == 0
        assert hit.all(), n


@pytest.mark.parametrize(("n", "changed"), [(13, (3, 9)), (13, (0, 12)), (15, (4, 7, 10)), (20, (4, 8, 11, 15)), (25, (4, 9, 14, 15, 20))])
def test_short_overlaps_are_found(spark, n, changed):
    item = [f"i{k}" for k in range(n)]
    text = [f"x{k}" if k in changed else w for k, w in enumerate(item)]
    docs = frame(spark, [(1, " ".join(["before"] * 9 + text + ["after"] * 9)), (2, " ".join(["before"] * 40))])
    made = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in made] == [(1, 1, 9, n, n - len(changed))]


def test_items_and_documents_of_any_length(spark):
    words = [f"w{i}" for i in range(100_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[500:540]))], "item_id long, text string")
    docs = frame(spark, [(1, "two words"), (2, " ".join(words[70_000:70_050])), (3, " ".join(["x"] * 5 + words + ["y"] * 5)), (4, " ".join(["z"] * 50_000))])
    made = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(d, i) for d, i, *_ in made} == {(2, 1), (3, 1), (3, 2)} and all(5 * e >= 4 * n for *_, n, e in made)


def test_longest_stretch_against_brute_force():
    rng = np.random.default_rng(8)
    for trial in range(300):
        item = rng.integers(0, 9, int(rng.integers(1, 30))).astype(np.uint64)
        shift = int(rng.integers(-3, 6))
        doc = np.concatenate([np.full(6, 99, np.uint64), item, np.full(6, 99, np.uint64)])[max(0, 6 - shift) :]
        doc = np.where(rng.random(len(doc)) < 0.25, np.uint64(77), doc)
        spans = []
        for a in range(len(item)):
            for b in range(a + 1, len(item) + 1):
                if a + shift >= 0 and b + shift <= len(doc):
                    equal = int((doc[a + shift : b + shift] == item[a:b]).sum())
                    if 5 * equal >= 4 * (b - a):
                        spans.append((b - a, equal, -(a + shift)))
        first, n, equal = decontaminate.longest_alike(doc, item, shift, 0.8)
        assert (n, equal, -first) == max(spans) if spans else n == 0


def test_decontamination_finds_substitutions_at_every_place(spark):
    item = [f"w{i}" for i in range(13)]
    long = [f"v{i}" for i in range(40)]
    texts = [" ".join(["before"] * 20 + [*item[:i], "other", *item[i + 1 :]] + ["after"] * 20) for i in range(13)]
    every = " ".join("other" if i % 20 in (3, 7, 9, 14) else w for i, w in enumerate(long))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], "item_id long, text string")
    made = {tuple(r) for r in decontaminate.contaminated(frame(spark, [*enumerate(texts), (50, every)]), bench).collect()}
    assert made == {(i, 1, 20, 13, 12) for i in range(13)} | {(50, 2, 0, 40, 32)}


def test_decontamination_finds_short_items(spark):
    sizes = [1, 3, 4, 5, 8, 9, 10, 11, 12]
    items = {n: [f"i{n}x{i}" for i in range(n)] for n in sizes}
    rows, want = [], set()
    for n, item in items.items():
        for k in range(n // 5 + 2):  # so many words changed, at every place for one
            for at in range(n):
                places = {(at + j * (n // 3 or 1)) % n for j in range(k)}
                text = ["x", "y", *("other" if i in places else w for i, w in enumerate(item)), "z"]
                rows.append((len(rows), " ".join(text)))
                if 5 * (n - len(places)) >= 4 * n:
                    want.add((len(rows) - 1, n, 2, n, n - len(places)))
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()] + [(99, ""), (98, "?")], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()} == want


PAGE = "<html><head><title>T</title><script>a('<p>')</script></head><body><nav><a>n</a></nav>{}<footer>f</footer></body></html>"


def test_main_text_by_host_wrappers(spark):
    body = "<article><h1>H &amp; h</h1>{}</article><div class='user-comments'><p>c</p></div>"
    rows = [(i, "http://h.example/x", PAGE.format(body.format("".join(f"<p>p{j}  <b>b</b>\n q</p>" for j in range(i))))) for i in range(5)]
    rows += [(10, None, None), (11, "http://g.example/", ""), (12, "http://h.example/y", "<article><p>cut <b"), (13, "no host", "<p>a<p>b"), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    made = [(r["page_id"], r["text"], r["n_chars"]) for r in wrappers.main_text(pages).collect()]
    want = [(i, "\n".join(["H & h", *(f"p{j} b q" for j in range(i))])) for i in [0, *range(5)]] + [(10, ""), (11, ""), (12, "cut"), (13, "a\nb")]
    assert sorted(made) == sorted((i, t, len(t)) for i, t in want)
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_unpaired_quotes_end_no_page():
    words = lambda page: " ".join(" ".join(t for k, _, t in wrappers.tokenise(page) if k == "text").split())
    assert words("<p>a <a title=it's href=x>b</a> c</p><p>don't</p>") == "a b c don't"
    assert words("<p>a <b don't</p><p>d isn't e</p>") == "a d isn't e"
    assert words("<a title=\"x > y\" class='u>v'>t</a> <a q=\"r>s</a> z") == "t s z"
    assert words("a </3 b> c <é d") == "a c < é d" and words("a <b c") == "a" and words('<i x="a>b" c') == 'b" c'
    assert [m for k, _, m in wrappers.tokenise("<div title=it's class=c data='d'>") if k == "open"] == ["c"]


def test_main_regions_are_marked_page_by_page(spark):
    plain = "<html><body><nav>n</nav><div class='old'><p>plain {0}</p></div><footer>f</footer></body></html>"
    rows = [(1, "http://h/1", PAGE.format("<article><p>a</p></article><div><p>x</p></div>")), (2, "http://h/2", plain.format(2)), (3, "http://h/3", PAGE.format("<p>b</p>")),
            (4, None, PAGE.format("<article><p>c</p></article>")), (5, "/relative", plain.format(5)), (6, "http://h/6", plain.format("6<footer><div class=content>g</div></footer>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()} == {1: "a", 2: "plain 2", 3: "b", 4: "c", 5: "plain 5", 6: "plain 6"}


def test_layout_classes_are_no_boilerplate(spark):
    text = "<nav>n</nav><article><p>a</p><div class='comments'>c</div></article><div class='sidebar'>s</div>"
    pages = [f"<html class='no-header'><body class='single-post has-sidebar'>{text}</body></html>", f"<body class='sidebar'><div class='page no-sidebar'>{text}</div></body>",
             f"<body><div class='content with-comments'>{text}</div></body>", f"<body><div class='sidebar'><aside>{text}</aside></div></body>",
             "<body><div class='content'><div class='article-header'>a</div><div class='user-comments'>c</div><div class='article-footer'>f</div></div></body>",
             "<body><form id='f'><div class='header-menu'>m</div><div class='content'>a</div></form></body>", "<body><form>f</form><div class='sidebar-left'><div class='content'>a</div>b</div></body>",
             "<body><div class='sidebar'><div class='content'>s</div></div><p>a</p><article class='comment'><p>b</p></article></body>"]
    rows = [(i, f"http://h{i}/", p) for i, p in enumerate(pages)]
    made = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert made == dict.fromkeys(range(7), "a") | {7: "a\nb"}


def _plain(i, notice, extra=""):
    return (i, f"http://plain.net/{i}", f"<html><body><div>{notice}</div><div>words of page {i}</div>{extra}<p>more of {i}</p></body></html>")


def test_what_a_host_repeats_is_template(spark):
    rows = [_plain(i, "Sign up now!", "<p>extra</p>" * (i % 3)) for i in range(8)]
    rows += [(20 + i, f"http://one.net/{i}", rows[0][2]) for i in range(5)]  # copies of one page: nothing shows what is template
    rows += [(30, "http://few.net/1", rows[0][2]), (31, "http://few.net/2", rows[1][2])]
    made = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert made[i].split("\n")[0] == f"words of page {i}" and made[i].split("\n")[-1] == f"more of {i}" and "Sign" not in made[i]
    assert all(made[i].startswith("Sign up now!\nwords of page 0") for i in range(20, 25)) and made[31].startswith("Sign up")
    # each page by a wrapper of its own: without the host's alignment the notice stays
    tokens, found = wrappers.shape(rows[0][2])
    assert wrappers.Matcher(tuple(tokens)).blocks(tokens, found)[0] == "Sign up now!"


def test_marked_regions_need_no_template(spark):
    rows = [(i, f"http://m.net/{i}", f"<body><div>Sign up now!</div><article><p>Same start</p><p>page {i}</p></article></body>") for i in range(6)]
    made = {r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert made == {f"Same start\npage {i}" for i in range(6)}


def test_alignments_accept_both_sides():
    from itertools import combinations, product

    small = [list(s) for n in range(1, 5) for s in product(("<p", ">p", "#"), repeat=n)]
    rng = np.random.default_rng(0)
    for a, b in rng.integers(0, len(small), (1500, 2)).tolist():
        w = wrappers.infer(wrappers.infer(None, small[a]), small[b])
        for page in (small[a], small[b]):
            assert wrappers.Matcher(w).path(page) is not None
        if any(wrappers.fold(tuple(small[i])) != tuple(small[i]) for i in (a, b)):
            continue
        plain = wrappers.align(tuple(small[a]), tuple(small[b]))  # nothing to fold: the longest common part stays
        common = max(len(x) for n in range(5) for x in {tuple(small[a][i] for i in k) for k in combinations(range(len(small[a])), n)}
                     if _inside(x, small[b]))
        assert sum(type(x) is str for x in plain) == common


def _inside(x, y):
    rest = iter(y)
    return all(v in rest for v in x)


def test_pages_of_own_class_names_align_quickly():
    import time

    page = lambda k: tuple(t for i in range(1500) for t in (f"<div c{k}x{i}", "#", ">div"))
    start = time.process_time()
    w = wrappers.align(page(1)[:1] + page(1), page(2))
    assert time.process_time() - start < 8 and wrappers.Matcher(w).path(list(page(2))) is not None


def test_wrapper_inference():
    one = "<div <ul <li # >li <li # >li >ul <p # >p >div".split()
    two = "<div <ul <li # >li >ul >div".split()
    w = wrappers.infer(wrappers.infer(None, one), two)
    for page in (one, two, "<div <ul <li # >li <li # >li <li # >li >ul >div".split()):
        assert wrappers.Matcher(w).path(page) is not None
    assert wrappers.Matcher(w).path(["<div"]) is None


def test_toxicity_learns_words_and_stems(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, 20))
        if i % 4 == 0:
            text.insert(5, "blarg" + str(rng.choice(list("abcdefgh"))))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (3, None)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.train(toxicity.labelled_sample(docs.filter("doc_id < 300"), known, 1000))
    made = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows[300:] + [(900, None), (901, ""), (901, "")]), model).collect()}
    assert all((made[i] >= 0.3) == (i % 4 == 0) for i in range(300, 400))
    assert made[900] == made[901] < 0.3
    nothing = toxicity.train(toxicity.labelled_sample(docs, known.limit(0), 10))
    assert 0 <= toxicity.score(docs.limit(1), nothing).first()["score"] < 0.3


def test_composed_transducers_against_their_scopes():
    from itertools import product

    symbols = ("insult", "target", "negation", "report", None)
    for n in range(1, 7):
        for line in product(symbols, repeat=n):
            want = []
            for i, c in enumerate(line):
                if c != "insult":
                    continue
                before = {k: [i - j for j in range(i) if line[j] == k] for k in symbols[1:4]}
                negated = any(d <= 3 and not any(r < d for r in before["report"]) for d in before["negation"])
                aimed = any(d <= 4 for d in before["target"]) or "target" in line[i + 1 : i + 4]
                reported = bool(before["report"]) or "report" in line[i + 1 : i + 3]
                want.append((c, toxicity.TARGET * aimed | toxicity.NEGATED * negated | toxicity.REPORTED * reported))
            assert toxicity.clause_readings(list(line)) == want, line


def test_apostrophes_belong_to_words():
    lexicon = toxicity.Lexicon(toxicity.seed_words(), {})
    read = lambda t: [r for c, _ in toxicity.clauses(t, lexicon) for r in c]
    aimed = toxicity.TARGET
    assert read("you aren't an idiot") == read("you aren\u2019t an idiot") == [("insult", aimed | toxicity.NEGATED)]
    assert read("l'idiot") == [("insult", 0)] and read("you idiot you said not") == [("insult", aimed | toxicity.REPORTED)]


def test_weights_are_fitted_again_without_negative_ones():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (400, 3)).astype(float)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.3, 400) > 0.5).astype(float)
    weights, bias = toxicity._logistic(x, y)
    assert weights[1] == 0 and weights[0] > 1
    again, least = toxicity._logistic(x[:, [0, 2]], y)
    assert np.allclose(weights[[0, 2]], again) and np.isclose(bias, least)


def test_words_are_letters_and_their_marks():
    assert langid.words_of("½ ² ① 12 _") == [] and langid.words_of("हिन्दी भाषा x2y") == ["हिन्दी", "भाषा", "x", "y"]
    assert langid.words_of("Don't É\u0301a") == ["don", "t", "é\u0301a"] and langid.words_of("\u0301") == []


def test_clause_readings():
    lexicon = toxicity.Lexicon(toxicity.seed_words(), {})
    read = lambda t: [r for c, _ in toxicity.clauses(t, lexicon) for r in c]
    assert read("You idiot. Fine day") == [("insult", toxicity.TARGET)]
    assert read("he said never an IDIOT") == [("insult", toxicity.TARGET | toxicity.NEGATED | toxicity.REPORTED)]
    assert read("kill it") == [("threat", 0)] and read("") == read("good") == []


def test_language_spans(spark):
    en, fr = "the cat and the house with that thing ", "le chat est dans une maison avec des choses "
    rows = [(i, en * 3, "en") for i in range(20)] + [(i, fr * 3, "fr") for i in range(20, 40)] + [(90, None, "fr"), (91, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, en * 4 + fr), (2, fr), (3, None), (4, "123 !"), (5, ""), (2, fr)]
    made = langid.identify(frame(spark, texts), model, spans=True).collect()
    got = {r["doc_id"]: (r["lang_pred"], [(s["lang"], s["words"]) for s in r["spans"]]) for r in made}
    assert got[1] == ("en", [("en", 32), ("fr", 9)]) and got[2] == ("fr", [("fr", 9)])
    assert got[3] == got[4] == got[5] == ("und", []) and len(made) == 6
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(frame(spark, texts), none).first()["lang_pred"] == "und"


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(6)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)).round(3)
    labels, at = langid.viterbi(scores, lengths, 0.7), 0
    for n in lengths.tolist():
        s, own = scores[at : at + n], labels[at : at + n]
        value = lambda path: sum(s[i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        assert not n or abs(value(own.tolist()) - max(map(value, product(range(3), repeat=n)))) < 1e-9
        at += n


def test_viterbi_labels_more_than_128_languages():
    scores = np.zeros((3, 300))
    scores[[0, 1, 2], [299, 200, 200]] = 50
    assert langid.viterbi(scores, np.array([3]), 6.0).tolist() == [299, 200, 200]


@pytest.mark.parametrize("clustered", [False, True])
def test_dual_tree_against_brute_force(clustered):
    rng = np.random.default_rng(7)
    points = rng.integers(-50, 50, (900, 8))
    if clustered:
        points = points[:9].repeat(100, 0) + rng.integers(-2, 3, (900, 8))
    ids = rng.permutation(900) - 100
    asked = np.arange(0, 900, 7)
    score, found = covertree.dual_search(points[asked], ids[asked], points, ids, 5)
    for row, q in enumerate(asked):
        want = sorted((-int(points[q] @ points[j]), int(ids[j])) for j in range(900) if j != q)[:5]
        assert [(-s, i) for s, i in zip(score[row].tolist(), found[row].tolist(), strict=True)] == want


def test_top_k_leaves_out_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, None]), (1, [0.5, 0.5]), (2, [0.5, 0.1]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (100, [-1.0, 0.0])]
    made = covertree.top_k(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int"), k=2).collect()
    assert sorted(map(tuple, made)) == [(0, 1, 1, 32768), (0, 2, 2, 32768), (100, 1, 1, -32768), (100, 2, 2, -32768)]
    assert covertree.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


