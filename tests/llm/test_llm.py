"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenql.llm import components, decontaminate, html_extract, kneser_ney, langid, packing, paragraph_dedup, simhash, token_count, url_filter, weighted_minhash

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


BASE = prose(400)
AWKWARD = [(1, BASE), (2, None), (3, ""), (4, " \n"), (5, BASE), (6, BASE.replace(" ", "  ", 3)), (None, prose(60)), (7, prose(3)), (7, prose(3)), (8, "word"), (9, prose(5000)), (5, BASE)]


def test_components(spark):
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in parent if find(x) != x}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_html():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy the best of the best now and then.</div>"
        "<article><h1>A &amp; B</h1><p><b>First  line<br>goes\non.<p>In.<p>" + "the of and " * 20 + "</p><div class=comments><p>" + "I think that the best of it is this. " * 5 + "</p></div></article>"
        "<form><p>Send the form to us and to them</p></form><footer>&copy; the site</footer><script>var t='</p>';</script></body></html>"
    )
    assert html_extract.main_text(page) == "A & B\nFirst line goes on.\nIn.\n" + ("the of and " * 20).strip()
    plain = "<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><p>" + "this is what the people of the town have said to us " * 5 + "</p><p>Short one.</p></div></body>"
    assert html_extract.main_text(plain).splitlines()[-1] == "Short one."
    assert "One" not in html_extract.main_text(plain)
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<") == ""


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 9), (2, None, "<article><p>x</p></article>", 9)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, html_extract.extract_main_text(pages).collect())) == [(1, "u", "", 0), (2, None, "x", 1)]


def test_html_density(monkeypatch):
    """Without articles the stop words decide; in one, short blocks between linked ones go with these."""
    good = "The house that we saw by the river was as old as the town and all of its walls, and it is still there for us. "
    plain = f"<body><h2>On houses</h2><p>{good * 2}</p><p>Short.</p><p>{'Qwrt zxcv bnmp ' * 14}</p><div>tail</div>"
    inside = f"<article><p>{good}</p><p><a href=x>Other pages here</a></p><p>More of them</p><p><a href=y>And further ones</a></p></article>"
    assert html_extract.main_text(plain) == "On houses\n" + (good * 2).strip() + "\nShort."
    assert html_extract.main_text(inside) == good.strip()
    monkeypatch.setattr(html_extract, "STOP_WORDS", set())
    assert html_extract.main_text(plain) == "" and html_extract.main_text(inside) == good.strip() + "\nMore of them"


@pytest.mark.parametrize("broken", ["<a ", "<a '>'", "<svg>", "<div></p>", "</", "<!--", "&#9", "<p class=", "a=", '<a href="', "<", "<div "])
def test_html_broken_pages_take_linear_time(broken):
    began = time.process_time()
    html_extract.main_text("<article><p>x</p>" + broken * (1_000_000 // len(broken)))
    assert time.process_time() - began < 10


def test_html_odd():
    assert html_extract.main_text("<p &#" + "9" * 9000 + ";" * 9) == ""
    assert html_extract.main_text("<article>a&#" + "9" * 9000 + ";b<![CDATA[<i>]]></article>") == "a\ufffdb<i>"
    assert html_extract.main_text("<article " + "a" * 100_000 + ">x") == "x"


def test_language(spark):
    texts = {"x": "the cat and the dog went to the river with the old man and the boat ", "y": "der hund und die katze sind mit dem alten mann zum fluss gegangen und "}
    train = spark.createDataFrame([(k, v * 3 + str(i)) for k, v in texts.items() for i in range(40)] + [(None, "zzz"), ("x", None)], "lang string, text string")
    model = langid.learn(train)
    assert set(model) == {"x", "y"}
    got = langid.predict(spark.createDataFrame([("the old dog and the river",), ("die alten katzen und der fluss",), (None,), ("",), ("123 !?",)], "text string"), model)
    rows = got.collect()
    assert [r["lang_pred"] for r in rows] == ["x", "y", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[2]["rejected"]
    assert langid.learn(train.limit(0)) == {}


def test_fingerprints(spark):
    rows = [r for r in AWKWARD if r[0] is not None and r[0] != 7 and r != (5, BASE)] + [(5, BASE), (20, BASE + " tail"), (21, prose(200)), (22, None)]
    got = {r["doc_id"]: r for r in weighted_minhash.fingerprint_chain(docs(spark, rows)).collect()}
    texts = {k: t or "" for k, t in rows}
    ids = sorted(texts)
    assert sorted(got) == ids

    def jaccard(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    for i, k in enumerate(ids):
        t, n = texts[k], texts[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[k]["near_edited"] - jaccard(t, edited)) < 0.25 and abs(got[k]["near_next"] - jaccard(t, n)) < 0.25
    assert got[1]["fingerprint"] == got[5]["fingerprint"] == got[6]["fingerprint"] and got[2]["fingerprint"] == ""
    assert weighted_minhash.fingerprint_chain(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert weighted_minhash.fingerprint_chain(docs(spark, [])).count() == 0


def test_contamination(spark):
    items = [(i, prose(rng.randint(14, 40))) for i in range(20)] + [(50, "one two three"), (51, None), (None, "x y"), (52, "!!"), (50, "one two three")]
    rows = [(i, prose(80) + " " + " ".join(items[i % 20][1].split()[2 : 2 + 8 + i]).upper() + ", " + prose(30)) for i in range(25)] + [(30, "So ONE-two: three."), (31, None), (32, "")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for k, t in items:
        w = words(t)
        if k is not None and w:
            n = min(13, len(w))
            for j in range(len(w) - n + 1):
                wins.setdefault(tuple(w[j : j + n]), set()).add(str(k))
    for most in (1_000_000, 60):
        got = {r["doc_id"]: r for r in decontaminate.contamination_report(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), max_words=most).collect()}
        for k, t in rows:
            w = words(t)
            hit, found = set(), set()
            for n in {len(x) for x in wins}:
                for j in range(len(w) - n + 1):
                    if (x := tuple(w[j : j + n])) in wins:
                        hit |= set(range(j, j + n))
                        found |= wins[x]
            assert (got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"]) == (len(w), len(hit), len(found))
            assert got[k]["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert got[k]["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean[0] == rows[0][1] and 30 not in clean and clean[31] is None and len(clean[24]) < len(rows[24][1])


def test_substring_dedup(spark):
    passage = prose(70)
    rows = [(i, prose(40) + " " + passage + " " + prose(30) + "\n" + prose(20)) for i in range(5)] + [(10, prose(300)), (11, None), (12, ""), (13, "line\n" * 9)]
    long = prose(120).split()
    rows += [(20, prose(10) + "\n" + " ".join(long)), (21, " ".join([*long[:60], "changed", *long[61:]]) + "\n" + prose(9))]
    got = {r["doc_id"]: r for r in paragraph_dedup.substring_dedup(docs(spark, rows)).collect()}
    for k, t in rows:
        if k in (1, 2, 3, 4):
            assert got[k]["n_removed_spans"] > 0 and passage not in got[k]["text"] and len(got[k]["text"]) < len(t) - len(passage) / 2
        elif k != 21:
            assert got[k]["text"] == t and got[k]["n_removed_spans"] == 0
    assert len(got[21]["text"].split()) < 12
    assert paragraph_dedup.substring_dedup(docs(spark, [])).count() == 0
    assert paragraph_dedup.substring_dedup(docs(spark, AWKWARD)).count() == len(AWKWARD)


@pytest.mark.parametrize("block", [256, 16])
def test_similar_lines_are_exact(spark, monkeypatch, block):
    """A line and 120 copies of it, each like it and unlike each other: every pair that meets in a band and is alike is linked."""
    monkeypatch.setattr(paragraph_dedup, "BLOCK", block)
    r = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    lines = [" ".join(words)]
    for k in range(120):
        new = list(words)
        for i in r.sample(range(10, 90), 2):
            new[i] = f"x{k}.{i}"
        lines.append(" ".join(new))
    lines += [" ".join(f"{k}.{i}" if i >= 60 else f"w{i}" for i in range(100)) for k in range(30)]  # like none, though they meet
    hashes = [paragraph_dedup.word_hashes(t) for t in lines]
    ids = [int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 9)).view(np.int64)) for h in hashes]
    sets = [set(paragraph_dedup.shingle_hashes(h, 5).tolist()) for h in hashes]
    bands = [set(paragraph_dedup.bands_of(np.array(sorted(s), np.uint64))) for s in sets]
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bands[i] & bands[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, set()).add(ids[i])
    roots = {x["line"]: x["root"] for x in paragraph_dedup.similar_lines(docs(spark, [(i, t) for i, t in enumerate(lines)])).collect()}
    got = {}
    for x in ids:
        got.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, got.values())) > 100


def test_simhash(spark):
    def slow(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for _, t in AWKWARD:
        assert simhash.simhash64(t) == slow(t)
    got = simhash.simhash_components(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}


def test_near_pairs_are_exact(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[r.integers(0, 300, 600)] ^ (np.uint64(1) << r.integers(0, 63, 600).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 600).astype(np.uint64))
    ball = base[0] ^ (np.uint64(1) << r.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, ball]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {x["node"]: x["root"] for x in components.connected_components(simhash.near_edges(df, 2, per_shard=64), "a", "b").collect()}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    pairs = components.connected_components(simhash.near_edges(df, 2, per_shard=8), "a", "b")  # the ball's shards are compared by blocks
    assert {x["node"]: x["root"] for x in pairs.collect()} == got
    signed = fps.view(np.int64).tolist()
    mine = {}
    for i, l in enumerate(label):
        mine.setdefault(int(l), set()).add(signed[i])
    theirs = {}
    for x in signed:
        theirs.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_shards_are_bounded():
    """Of 300,000 random fingerprints, and of a dense ball among them, no shard holds over four times its target as the sample has it."""
    r = np.random.default_rng(4)
    fps = r.integers(0, 1 << 63, 300_000, dtype=np.uint64)
    nodes = simhash.build_tree(r.choice(fps, 48 * 80, replace=False), len(fps) / (48 * 80), 4096, 2)
    _, leaf = simhash.route(fps, nodes, 2)
    assert np.bincount(leaf).max() <= 4 * 4096 and len(nodes) > 50


def test_simhash_on_a_table(spark):
    """Component ids of a whole table, against all pairs of its fingerprints."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = simhash.simhash_components(rows).collect()
    fps = np.array([simhash.simhash64(x["text"]) for x in rows.collect()], np.uint64)
    ids = np.array([x["doc_id"] for x in rows.collect()])
    label = ids.copy()
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    assert {x["doc_id"]: (x["fp"] % (1 << 64), x["component_id"]) for x in got} == {int(i): (int(f), int(c)) for i, f, c in zip(ids, fps, label)}
    kept = sorted(x["doc_id"] for x in simhash.deduplicate(rows).collect())
    assert kept == sorted(set(label.tolist()))


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    odd = "Ärger, it's naïve! ßß İstanbul ﬁn 12 3.5 <|endoftext|> x\u00a0y\tz e\u0301t\u00e9 Straße. ÉTÉ, don't\u2028new"
    rows = [*AWKWARD, (30, odd), (31, odd.upper())] + [(100 + i, prose(rng.randint(1, 900))) for i in range(120)]
    got = packing.pack_documents(docs(spark, rows), vocabulary(), groups=8).collect()
    want = Counter()
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[k, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seqs) <= 1.1 * sum(r["length"] for r in got) / 4096 + 1
    assert packing.pack_documents(docs(spark, []), vocabulary()).count() == 0


def test_packing_workers_do_not_grow(spark, monkeypatch):
    """A worker that forgets its words after each task has one tokenizer for all of its tasks; each one dropped would leave some 6 MB behind."""
    d = docs(spark, AWKWARD)
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, task, schema: task)
    task = packing.pieces(d, vocabulary(), forget=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [prose(200).title(), None]})
    first = [b.to_pydict() for b in task(iter([batch]))]
    held = packing._tools[vocabulary()][0]
    assert not packing._words[vocabulary()]
    assert [b.to_pydict() for b in task(iter([batch]))] == first
    assert packing._tools[vocabulary()][0] is held


def test_packing_tasks_empty_what_their_worker_holds(spark, monkeypatch):
    """A task as workers get it, pickled, bounds and forgets the words that token_bytes remembers, not a copy of them."""
    from pyspark import cloudpickle

    d = docs(spark, AWKWARD)
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, task, schema: task)
    task = cloudpickle.loads(cloudpickle.dumps(packing.pieces(d, vocabulary(), cache_words=7, forget=True)))
    out = task(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [prose(200)]})]))
    next(out)
    assert 0 < len(packing._words[vocabulary()]) <= 8
    assert list(out) == [] and not packing._words[vocabulary()]


def test_dedup_tasks_empty_what_their_worker_holds(spark, monkeypatch):
    from pyspark import cloudpickle

    d = docs(spark, []).selectExpr("doc_id as _who", "doc_id as _key", "text")
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, task, schema: task)
    task = cloudpickle.loads(cloudpickle.dumps(paragraph_dedup._read(d, 51, 51, 16)))
    out = task(iter([pa.RecordBatch.from_pydict({"_who": [1], "_key": [1], "text": [prose(200)]})]))
    next(out)
    assert paragraph_dedup._powers
    assert list(out) == [] and not paragraph_dedup._powers


def test_plan_holds_every_length():
    counts = {rng.randint(1, 4096): rng.randint(1, 5000) for _ in range(400)}
    classes = packing.plan(counts)
    held = Counter()
    for many, items in classes:
        assert sum(a * b for a, b in items) <= 4096
        for length, q in items:
            held[length] += many * q
    assert dict(held) == counts
    assert sum(m for m, _ in classes) <= 1.07 * sum(k * v for k, v in counts.items()) / 4096 + 2


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block")], "host string, path string, verdict string")
    cases = [("http://a.example.com/en/76?x", "example.com/en/7", "allow"), ("https://B.Example.COM/en/8#z", "com/en/", "block"), ("http://notexample.com/en/7", "com/en/", "block"), ("x://com/en/", "com/en/", "block"), ("http://com.org/en/", None, "allow"), ("a.net", None, "allow"), (None, None, "allow"), ("http://a.net?x://b.com/en/", "net", "block"), ("http://a.net", "net", "block"), ("http://a.net", "net", "block")]
    got = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "page_id long, url string"), rules)
    assert [(r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == [(r, v) for _, r, v in cases]
    clash = spark.createDataFrame([(i, u, 1, 2, 3, 4, 5) for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host int, rule int, _rest int, n int, _url int")
    back = url_filter.filter_urls(clash, rules)
    assert back.columns == ["page_id", "url", "_rest", "n", "_url", "host", "path", "rule", "verdict"]
    assert [(r["rule"], r["verdict"], r["_rest"], r["n"], r["_url"]) for r in back.orderBy("page_id").collect()] == [(r, v, 3, 4, 5) for _, r, v in cases]
    assert url_filter.filter_urls(clash.limit(0), rules).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), rules.limit(0)).first()["verdict"] == "allow"


def test_token_counts(spark):
    vocab = [*"abcdefgh", "ab", "abc", "cd", "bcde", "fgh", "abcdefg", "hh"]
    m = token_count.Matcher(vocab)

    def slow(w):
        n = 0
        while w:
            k = next((k for k in range(len(w), 0, -1) if w[:k] in vocab), 0)
            if not k:
                return 1
            w, n = w[k:], n + 1
        return n

    for _ in range(3000):
        w = "".join(rng.choice("abcdefghx" if rng.random() < 0.05 else "abcdefgh") for _ in range(rng.randint(0, 14)))
        assert m.count(w) == slow(w)
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_count.token_counts(docs(spark, [(1, None), (2, ""), (3, "Hello world")]), vocabulary()).collect()}
    assert rows[1] == rows[2] == (0, 0) and rows[3][0] == 2 and rows[3][1] >= 2


def test_kneser_ney(spark):
    trusted = spark.createDataFrame([(prose(60) + ".",) for _ in range(40)] + [(None,), ("",)], "text string")
    model = kneser_ney.train(trusted, order=3)
    rows = {r["gram"]: r for r in model.collect()}
    chars = {g for g in rows if len(g) == 1 and rows[g]["logp"] is not None}
    scorer = kneser_ney.load(model, 3)
    for ctx in ("ab", "\x02\x02", " a", "zz"):  # each context's probabilities, with those of unseen characters, add up to one
        total = sum(np.exp(scorer.logps(np.array([ord(c) for c in ctx + x], np.uint32))[0]) for x in chars)
        rest = np.exp(scorer.logps(np.array([ord(c) for c in ctx + "\u4e00"], np.uint32))[0]) * (kneser_ney.ALPHABET - len(chars))
        assert abs(total + rest - 1) < 1e-3
    texts = spark.createDataFrame([(1, prose(30)), (2, "###@@@ !!"), (3, None), (4, ""), (5, prose(2000))], "doc_id long, text string")
    a = {r["doc_id"]: r["log_perplexity"] for r in kneser_ney.score(texts, model, 3).collect()}
    b = {r["doc_id"]: r["log_perplexity"] for r in kneser_ney.score(texts, model, 3, most=0).collect()}
    assert a[3] is a[4] is b[3] is b[4] is None and a[2] > 2 * a[1]
    assert all(abs(a[k] - b[k]) < 1e-4 for k in (1, 2, 5))


def test_judge(spark):
    good = [(i, prose(60), "x" if i % 2 else None) for i in range(100)]
    bad = [(200 + i, prose(30).upper() + "!!", "x") for i in range(10)]
    rows = spark.createDataFrame([*good, *bad, (300, None, "x"), (None, prose(50), "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(0, 1, 0), (200, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in kneser_ney.judge(rows, labels).collect()}
    assert all(got[i] for i in range(100)) and got[None] and not any(got[200 + i] for i in range(10)) and not got[300]
    kept = kneser_ney.keep_good(rows.withColumn("n_chars", F.lit(7)).withColumn("extra", F.lit("e")), labels)
    assert kept.columns == ["doc_id", "text", "lang", "n_chars", "extra"] and kept.count() == 101


def test_judge_toxic(spark):
    """A few insults in fluent text reject a document, labelled or not; both paths of scoring agree."""
    r = random.Random(21)
    insult = lambda t: " ".join(w + (" zyx wonk" if i in (7, 30) else "") for i, w in enumerate(t.split()))
    texts = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(190)]
    rows = [(i, insult(t) if 100 <= i < 180 else t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(i, 1, 1) for i in range(100, 150)], "doc_id long, quality int, toxic int")
    for got in (kneser_ney.judge(df, labels).where("keep"), kneser_ney.keep_good(df, labels)):
        kept = {x["doc_id"] for x in got.collect()}
        assert not kept & set(range(100, 180)) and len(kept) >= 108
    model, toxic = (kneser_ney.train(df.where(w), 3) for w in ("doc_id < 100", "doc_id >= 100"))
    a, b = ({x["doc_id"]: x["toxicity"] for x in kneser_ney.score(df, model, 3, most, toxic=toxic).collect()} for most in (1 << 30, 0))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 for k in a)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, d).collect()
    ids = {r["doc_id"] for r in out}
    assert 0 < len(ids) <= spark.read.parquet(f"{d}/documents.parquet").count()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out[0].asDict())


def test_pipeline_near_copies(spark):
    """The stage keeps the smallest id of each class of five-word Jaccard 0.8 or more, as brute force has them."""
    import corpus_pipeline

    r = random.Random(12)
    rows = []
    for base in range(0, 60, 10):
        words = [r.choice(WORDS) for _ in range(150)]
        rows.append((base, " ".join(words)))
        for k, n in enumerate((1, 1, 2, 2, 8), 1):
            new = list(words)
            for i in r.sample(range(10, 140), n):
                new[i] = f"x{base}.{k}.{i}"
            rows.append((base + k, " ".join(new)))
    rows += [(90, None), (91, ""), (92, " "), (93, "three words only"), (94, "Three  words only"), (95, "three words more"), (None, rows[0][1])]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for (k, _), x in zip(rows, label):
        least[x] = min(least.get(x, 1 << 63), 1 << 62 if k is None else k)
    docs5 = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs5, "").collect())
    assert got == sorted(least.values()) and len(got) < len(rows) - 20


def test_pipeline_near_copies_by_simhash(spark, monkeypatch):
    """Without any band the stage still meets near copies by their SimHash classes; texts that these hold, but are unlike, stay."""
    import corpus_pipeline

    r = random.Random(21)
    long = [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(3000)]
    rows = [(0, " ".join(long)), (1, " ".join([*long[:700], "other", *long[701:]])), (2, " ".join(long).upper())]
    rows += [(10 + k, "spam " * 300 + " ".join(f"{k}x{i}" for i in range(60))) for k in range(3)]
    rows += [(20, " ".join(r.choice(WORDS) for _ in range(200))), (21, None)]
    fps = {k: simhash.simhash64(t) for k, t in rows}
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and fps[10] == fps[11] == fps[12]
    monkeypatch.setattr(paragraph_dedup, "_banded", lambda lines: lines.select(F.lit(0).cast("long").alias("band"), "line").limit(0))
    given = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, given, "").collect()) == [0, 10, 11, 12, 20, 21]


def test_cuts_leave_no_shuffle_files(spark):
    """What a checkpoint and a component run shuffled is gone from the disk at their end, also while the frames are held."""
    from lumenql.llm.common import SWEEP, cut

    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {x for d in dirs for _, _, names in os.walk(d) for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    before, conf = files(), spark.conf.get(SWEEP, None)
    held = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.sum("id").alias("n"))
    got = cut(held)
    roots = components.connected_components(got.select("k", (F.col("k") % 7).alias("m")), "k", "m")
    end = time.time() + 20  # files go in the background
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(SWEEP, None) == conf
    assert got.count() == 5_000 and roots.count() == 4_993


def kept_words(rows, window=51, least=51, similarity=0.8):
    """Brute force: for each (id, text) the words that stay, by the docstring of substring_dedup."""
    ids = [1 << 62 if k is None else k for k, _ in rows]
    words = [(t or "").lower().encode().split() for _, t in rows]
    first = {}
    for k, w in zip(ids, words):
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, k), k)
    gone = [set() for _ in rows]
    for g, k, w in zip(gone, ids, words):
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                g |= set(range(i, i + window))
    lines = []
    for d, (_, t) in enumerate(rows):
        at = 0
        for line in (t or "").lower().encode().split(b"\n"):
            w = line.split()
            if len(w) >= least:
                lines.append((d, at, at + len(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
            at += len(w)
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][3], lines[j][3]
            if label[i] != label[j] and len(a & b) >= similarity * len(a | b):
                x, y = label[i], label[j]
                label = [x if v == y else v for v in label]
    low = {}
    for (d, *_), v in zip(lines, label):
        low[v] = min(low.get(v, ids[d]), ids[d])
    for (d, a, b, _), v in zip(lines, label):
        if low[v] < ids[d]:
            gone[d] |= set(range(a, b))
    text_first = {}
    for k, (_, t) in zip(ids, rows):
        text_first[t] = min(text_first.get(t, k), k)
    for g, k, w, (_, t) in zip(gone, ids, words, rows):
        if t and text_first[t] < k and len(w) >= window:
            g |= set(range(len(w)))
    return [[x for i, x in enumerate(w) if i not in g] for g, w in zip(gone, words)]


def test_substring_dedup_is_exact(spark):
    """Runs of 32 to 60 words shared by two or three texts, in the middle of lines, at the edges, across lines; near lines and copies."""
    r = random.Random(33)
    fresh = lambda n: [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in range(32, 61):
        run = fresh(n)
        for k in range(3):
            text = fresh(r.randint(0, 40)) + run + fresh(r.randint(0, 40))
            for i in r.sample(range(len(text)), 2):
                text[i] += r.choice(["\n", "  ", "\t"])
            rows.append((len(rows), " ".join(text)))
    base = fresh(120)
    for k in range(4):
        new = list(base)
        new[10 + 25 * k] = "other"
        rows.append((len(rows), " ".join(fresh(5)) + "\n" + " ".join(new)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (2, rows[90][1]), (None, rows[5][1]), (None, " ".join(fresh(80))), (502, "same " * 200), (503, "same " * 100 + "\n" + "same " * 49), (504, "short copy"), (505, "short copy"), (506, " \n "), (507, None)]
    r.shuffle(rows)
    got = paragraph_dedup.substring_dedup(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "row int, doc_id long, text string")).collect()
    got = {x["row"]: x for x in got}
    assert len(got) == len(rows)
    for i, want in enumerate(kept_words(rows)):
        text = rows[i][1]
        assert (got[i]["text"] or "").lower().encode().split() == want
        if len(want) == len((text or "").split()):
            assert got[i]["text"] == text and got[i]["n_removed_spans"] == got[i]["n_removed_chars"] == 0


def test_substring_dedup_on_a_table(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(d).select("doc_id", "text").collect()]
    got = paragraph_dedup.substring_dedup(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "row int, doc_id long, text string")).collect()
    want = kept_words(rows)
    assert all((x["text"] or "").lower().encode().split() == want[x["row"]] for x in got) and len(got) == len(rows)
    assert any(x["n_removed_spans"] for x in got)
