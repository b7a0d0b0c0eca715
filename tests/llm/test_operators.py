"""The corpus operators against brute force on small documents with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pulseloom.llm import components, exact, fuse, gru, html, licenses, linedup, lm, lsh, mixing, neardup, packing, quality, shards
from pulseloom.llm.flow import Network
from pulseloom.llm.lsh import near_components
from pulseloom.llm.shingles import weighted, weighted_jaccard
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1] or "", r[3]) for r in cases.rows()]


def test_fuse_filters_have_no_false_negatives():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 100, 5000):
        keys = r.integers(0, 2**63, n, dtype=np.uint64)
        f = fuse.FuseFilter.build(keys)
        assert f.contains(keys).all()
        assert f.contains(r.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.002


def test_exact_dedup(spark, docs, rows):
    got = exact.dedup(docs)
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
    out = got.collect()
    assert len(out) == len(rows)
    known = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in out:
        t = digest[r["text_sha256"]]
        assert r["keep_id"] == known[t] and r["group_size"] == len(groups[t])
    assert sum(r["kept"] for r in out) == len(groups)
    stays = exact.keep(docs)
    assert stays.columns == docs.columns
    assert sorted((r["text"] or "") for r in stays.collect()) == sorted(groups)
    assert exact.dedup(cases.empty(spark)).count() == 0 and exact.keep(cases.empty(spark)).count() == 0


def test_snapshots_are_read_back(spark, tmp_path):
    old = spark.createDataFrame([(bytearray(bytes([i] * 32)), i, 1) for i in range(50)], "digest binary, keep_id long, n long")
    exact.write_snapshot(old, str(tmp_path / "s"))
    for start in (40, 45):  # the snapshot serves several batches
        new = spark.createDataFrame([(bytearray(bytes([i] * 32)), 100 + i, 2) for i in range(start, 60)], "digest binary, keep_id long, n long")
        got = {bytes(r["digest"])[0]: (r["keep_id"], r["n"]) for r in exact.merge(str(tmp_path / "s"), new).collect()}
        assert got == {i: (100 + i if i >= start else i, 3 if start <= i < 50 else 2 if i >= 50 else 1) for i in range(60)}
    empty = old.limit(0)
    exact.write_snapshot(empty, str(tmp_path / "e"))
    assert exact.merge(str(tmp_path / "e"), old).count() == 50


def brute_classes(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shingles = list(neardup._shingles(pa.array(texts, pa.large_string())))
    keys, counts = weighted(np.concatenate([weighted(s)[0] for s in shingles]))
    vectors = [neardup.Idf(keys, counts, len(texts)).weigh(s) for s in shingles]
    for i in range(len(texts)):
        for j in range(i):
            if weighted_jaccard(vectors[i], vectors[j]) >= 0.8:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_near_dedup(spark, docs, rows):
    distinct = sorted({t for _, t, _ in rows})
    label = dict(zip(distinct, brute_classes(distinct)))
    members = collections.defaultdict(list)
    for i, t, _ in rows:
        members[label[t]].append(i)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(members)
    expected = collections.Counter((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in members.values() for i in ids)
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == expected
    stays = neardup.keep(docs)
    assert stays.columns == docs.columns and stays.count() == len(members)
    assert neardup.classes(cases.empty(spark)).count() == 0


def test_large_groups_of_near_copies(spark):
    """More copies than a block holds, of which only some are similar enough to each other."""
    r = random.Random(4)
    base = cases.prose(r, 120).split()
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(1 if k < 90 else 9):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = brute_classes(sorted(set(texts)))
    expected = len(set(label))
    assert neardup.classes(df).select("class_id").distinct().count() == expected


def test_rare_shingles_weigh_by_their_own_frequency(spark, monkeypatch):
    """Four texts share 180 shingles and have 20 of their own: 0.82 unweighted, 0.79 by the inverse frequencies among 4000 texts."""
    shared = " ".join(f"s{k}" for k in range(184))
    texts = [f"{shared} " + " ".join(f"own{i}x{k}" for k in range(20)) for i in range(4)] + [f"f{i} a b c d" for i in range(3996)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lsh, "CHUNK_TEXTS", 1000)
    assert neardup.classes(df).filter("class_size > 1").count() == 0


def test_document_frequencies_are_exact(spark, monkeypatch):
    r = random.Random(8)
    texts = sorted({cases.prose(r, r.randrange(4, 40)) + r.choice(["", " one two three four five six"]) for _ in range(300)})
    keys, counts = weighted(np.concatenate([weighted(x)[0] for x in neardup._shingles(pa.array(texts, pa.large_string()))]))
    monkeypatch.setattr(lsh, "CHUNK_TEXTS", 40)
    monkeypatch.setattr(lsh, "RANGE_CHARS", 5000)
    content = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "node binary, text string")
    found = {}
    for row in neardup.document_frequencies(content, len(texts)).collect():
        found.update(zip(np.frombuffer(row["features"], np.uint64).tolist(), np.frombuffer(row["texts"], np.uint32).tolist()))
    assert found == {int(k): int(c) for k, c in zip(keys, counts) if c > 1}


def test_planes_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    for k in (keys, keys[:1], keys[:0]):
        assert (lsh._unplaned(lsh._planes(k)) == k).all()


def test_weighted_sampling_estimates_similarity():
    r = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        keys = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
        w = r.uniform(0.5, 4, len(keys))
        a, b = (keys[:370], w[:370]), (keys[30:], w[30:] * r.choice([1.0, 1.3], len(keys) - 30))
        agree.append((neardup.weighted_sample(*a) == neardup.weighted_sample(*b)).mean() - weighted_jaccard(a, b))
    assert abs(np.mean(agree)) < 0.03


def test_components_of_chains_and_stars(spark):
    b = lambda i: i.to_bytes(2, "big")
    links = [(b(i), b(i + 1)) for i in range(30)] + [(b(100), b(100 + k)) for k in range(1, 20)]
    got = dict(components.components(spark.createDataFrame([(bytearray(x), bytearray(y)) for x, y in links], "a binary, b binary")).rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).collect())
    assert {got[b(i)] for i in range(31)} == {b(0)} and {got[b(100 + k)] for k in range(20)} == {b(100)}
    assert components.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_flow_is_maximal_and_cheap():
    n = Network(5)
    edges = [n.add(0, 1, 10, 0), n.add(0, 1, 10, 1), n.add(0, 2, 5, 0), n.add(0, 2, 5, 1)]
    to = [n.add(1, 3, 20, 0), n.add(2, 3, 10, 0)]
    n.add(3, 4, 18, 0)
    assert n.solve(0, 4) == (18, 3)
    assert n.flow(edges[0]) == 10 and n.flow(edges[2]) == 5 and sum(map(n.flow, to)) == 18


def test_overlapping_sources_share_by_flow():
    flows = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 50}, {"a": 150, "b": 150}, 2)
    assert sum(f.get("a", 0) for f in flows.values()) == 150 and sum(f.get("b", 0) for f in flows.values()) == 150
    assert all(sum(f.values()) <= 2 * {("a",): 100, ("a", "b"): 100, ("b",): 50}[p] for p, f in flows.items())


def test_mixing(spark, docs, rows):
    size = lambda t: len(WORD.findall(t))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if over else left * weight[s] / total for s in (over or open_)}
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    got = mixing.mix(docs.repartition(5)).collect()
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in rows)
    taken = collections.Counter()
    by_target = {(round(target[s], 6), sizes[s]): s for s in order}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = by_target[round(r["target"], 6), r["source_size"]]
        taken[s] += r["taken"]
    largest = {s: max(size(t) for _, t, x in rows if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in order)
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = mixing.keep(docs)
    assert kept.columns == docs.columns and sum(size(r["text"]) for r in kept.collect()) == sum(taken.values())
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.keep(cases.empty(spark)).count() == 0


def test_best_fit_is_the_plain_algorithm():
    r = random.Random(3)
    for _ in range(30):
        capacity = r.choice([7, 16, 33])
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 120))), reverse=True)
        rooms = []
        for s in items:
            fits = [x for x in rooms if x >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(capacity - s)
        runs, used = packing.best_fit(collections.Counter(items), capacity)
        assert used == len(rooms) and sum(x.count for x in runs) == len(items)
        filled = collections.defaultdict(list)
        for x in runs:
            for i in range(x.count):
                filled[x.bin + i // x.each].append((x.offset + i % x.each * x.length, x.length))
        for places in filled.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=64).collect()
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    expected = collections.Counter()
    for i, t, _ in rows:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        n = -(-len(ids) // 64)
        cuts = [0, *(len(ids) - 64 * (n - 1 - k) for k in range(n))]
        expected.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert pieces == expected
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(cases.empty(spark), path).count() == 0


def test_ranks_and_tokenizer_agree_on_a_whole_table():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    expected = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(packing.Encoder(path).encode(texts)) == expected


def test_tokens_across_cuts(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", " lead and  double   spaces \n\n x \t y ", "x  y　q", "it's they'll  'tis", " ", "", "a\x1c b \x1d c", "tail  ", "12 34,5 a1b2"]
    expected = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(packing.Encoder(path).encode(texts)) == expected
    monkeypatch.setattr(packing, "LONG", 8)
    assert list(packing.Encoder(path).encode(texts)) == expected


def test_language_model(spark, docs, rows):
    got = lm.scores(docs, s=lm.Settings(share=1, known_words=4096)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter()
    for i, t, _ in rows:
        if not held(i):
            counts.update([*WORD.findall(t.translate(low)), None])
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, t, _ in rows:
        words = [*WORD.findall(t.translate(low)), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        expected[(i, held(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 4))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    assert lm.scores(cases.empty(spark)).count() == 0


def test_network_learns_from_all_training_documents(spark, docs, rows, monkeypatch):
    seen, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda sample, *rest: (seen.append(sample.count()), real(sample, *rest))[1])
    lm.scores(docs)
    assert seen == [sum(zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _, _ in rows)]


def test_training_carries_the_state_through_whole_texts():
    shape = gru.Shape(head=6, per_class=3, tails=2, embedding=4, hidden=5, rate=0.0)
    p = {k: v * 8 for k, v in gru.start(shape, np.ones((2, 3)), np.ones(shape.classes)).items()}
    text = np.array([*np.random.default_rng(3).integers(0, shape.end, 1400), shape.end], np.int32)
    trainer = gru.Trainer(p, shape)
    trainer.learn([text])
    assert trainer.tokens == len(text) and np.isclose(-trainer.loss, gru.score(p, shape, [text])[0], rtol=1e-6)


def test_recurrent_model_is_a_distribution_and_learns():
    shape = gru.Shape(head=6, per_class=3, tails=2, embedding=4, hidden=5, window=4, lanes=4, rate=0.02)
    p = gru.start(shape, np.ones((2, 3)), np.ones(shape.classes))
    prefix = [1, 7, 3]
    total = sum(np.exp(gru.score(p, shape, [np.array([*prefix, s], np.int32)])[0]) for s in range(shape.symbols))
    assert abs(total - np.exp(gru.score(p, shape, [np.array(prefix, np.int32)])[0])) < 1e-5
    text = np.array([0, 1, 2, 3] * 20 + [shape.end], np.int32)
    before = gru.score(p, shape, [text])[0]
    trainer = gru.Trainer(p, shape)
    for _ in range(60):
        trainer.learn([text] * 4)
    assert gru.score(trainer.p, shape, [text])[0] > before / 3
    both = gru.score(trainer.p, shape, [text, text[:9], text], lanes=2)
    assert np.allclose(both[[0, 2]], gru.score(trainer.p, shape, [text])[0], rtol=1e-4)


def test_large_logits_leave_a_distribution():
    z = np.array([[500.0, 0, -500], [-90, -91, -92], [1, 2, 3]], np.float32)
    expected = [np.logaddexp.reduce(row) for row in z.astype(float)]
    assert np.allclose(gru._log_sums(z.copy()), expected) and np.allclose(gru._log_sums(z[2:].copy()), expected[2:])


def test_gradients_match_differences():
    shape = gru.Shape(head=6, per_class=3, tails=2, embedding=3, hidden=4)
    p = {k: v.astype(np.float64) for k, v in gru.start(shape, np.ones((2, 3)), np.ones(shape.classes)).items()}
    x, y = np.array([[8, 8], [1, 7], [2, 6]]), np.array([[1, 7], [2, 6], [3, 8]])
    live, new = np.ones((3, 2), bool), np.array([[True, True], [False, False], [False, True]])
    run = lambda q: gru._gradients(q, shape, x, y, live, new, np.zeros((2, 4)))
    _, count, g, _ = run(p)
    for name in p:
        i = tuple(0 for _ in p[name].shape) if name != "emb" else (1, 0)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][i] += 1e-5
        down[name][i] -= 1e-5
        slope = (run(up)[0] - run(down)[0]) / 2e-5 / count
        assert abs(slope - g[name][i]) < 1e-3, name


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>Menu</a></ul></nav>
    <div class="ad">Buy this now</div><article><h1>The &amp; title</h1><p><b>First   paragraph with a good number of words &lt;here&gt;.<br><p>Short.</p><script>var t="</p>";</script>
    <form><label>Name</label></form><aside>Side</aside><ul><li>One</li><li>Two</li></ul><p>Last paragraph &copy; of the article, again with words.</p></article>
    <section id="comments"><article class="comment"><p>Nice post, I liked reading all of it very much.</p></article></section><footer>End</footer></body></html>"""
    assert html.main_text(page).split("\n") == [
        "The & title", "First paragraph with a good number of words <here>.", "Short.", "One", "Two", "Last paragraph © of the article, again with words.",
    ]
    plain = '<body><div id="header">Top</div><div class="wrap"><div id="content"><h2>Head</h2><p>' + "many words " * 20 + '<p>Short one.<div class="advert">Buy</div></div><div class="sidebar">' + "side words " * 20 + "</div></div><div id=footer>Foot</div>"
    assert html.main_text(plain).split("\n") == ["Head", ("many words " * 20).strip(), "Short one."]
    titled = "<div class=post><div class=post-header><h1>Title</h1></div><div class=body><p>" + "many words " * 9 + "</div></div>"
    assert html.main_text(titled).split("\n")[0] == "Title"
    assert html.main_text("") == "" and html.main_text("just text") == "just text"


def test_html_keeps_the_text_of_named_containers_and_links():
    text = "many words of the story " * 8
    paragraphs = f"<p>{text}</p><p><a href=b>See the whole report</a></p><p>{text}</p>"
    expected = [text.strip(), "See the whole report", text.strip()]
    for start, end in (('<article class="post category-social">', "</article>"), ('<div class="content no-sidebar">', "</div>"), ('<div class="post comments-open">', "</div>"), ('<div class="register">', "</div>")):
        page = f'<body><div class="menu"><a href=a>Menu</a></div>{start}{paragraphs}<div class="share">Share</div>{end}<div id="sidebar"><p>Aside</p></div></body>'
        assert html.main_text(page).split("\n") == expected, start


def test_html_keeps_headings_formulas_and_paragraphs_whole():
    text = "many words of the story " * 8
    page = f"""<body><nav>Menu</nav><article><h1>T</h1><p>{text}</p><h2 id="discussion">Discussion</h2><section id="related-work"><p>{text}</p></section>
    <p>Energy <span hidden>no</span> is <b class="promo">buy</b> here: <math><mi>x</mi></math>.</p></article></body>"""
    assert html.main_text(page).split("\n") == ["T", text.strip(), "Discussion", text.strip(), "Energy is here: x."]


def test_html_deep_pages_take_linear_time():
    import time

    took = []
    for depth in (1000, 8000):
        page = "<div>" * depth + "<p>word word word</p>" * depth + "</div>" * depth
        begin = time.perf_counter()
        assert html.main_text(page).count("\n") == depth - 1
        took.append(time.perf_counter() - begin)
    assert took[1] < 40 * took[0]


def test_html_operator(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hello there, world</p>", "x"), (None, None, None, "y"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    assert got == {1: ("Hello there, world", 18), None: ("", 0), 2: ("", 0)}
    assert html.extract(pages.limit(0)).count() == 0


def test_line_dedup(spark, docs, rows):
    lines = [(i, k, x) for i, t, _ in rows for k, x in enumerate(t.split("\n")) if WORD.search(x)]
    got = linedup.lines(docs).collect()
    assert len(got) == len(lines)
    distinct = sorted({x for _, _, x in lines})
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in distinct]
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    assert sum(r["kept"] for r in got) == len({root(i) for i in range(len(distinct))})
    members, index = collections.defaultdict(list), {x: i for i, x in enumerate(distinct)}
    for i, k, x in lines:
        members[root(index[x])].append((-1 if i is None else i, k))
    expected = collections.Counter((i, k, *min(members[root(index[x])]), len(members[root(index[x])])) for i, k, x in ((-1 if i is None else i, k, x) for i, k, x in lines))
    known = lambda i: -1 if i is None else i
    assert collections.Counter((known(r["doc_id"]), r["line_no"], known(r["class_doc_id"]), r["class_line_no"], r["class_size"]) for r in got) == expected
    assert linedup.lines(cases.empty(spark)).count() == 0
    unique = spark.createDataFrame([(1, "same line of text\n\nother"), (2, "same line of text\nfresh words here"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in linedup.clean(unique).collect()) == [(1, "same line of text\n\nother"), (2, "fresh words here"), (3, None)]


def test_quality(spark, docs, rows):
    got = quality.score(docs)
    out = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect())
    expected = collections.Counter()
    for i, t, _ in rows:
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        expected[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
    assert out == expected
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert quality.score(cases.empty(spark)).count() == 0 and quality.keep(cases.empty(spark)).count() == 0


def test_bad_hosts_go_whole(spark):
    good = " ".join(f"word{k}" for k in range(40))
    data = [(i, good if i % 10 == 0 else "short", "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 6}") for i in range(300)] + [(2000, "short", "tiny")]
    got = quality.score(spark.createDataFrame(data, "doc_id long, text string, source string"))
    verdict = {r["source"]: r["host_rejected"] for r in got.select("source", "host_rejected").distinct().collect()}
    assert verdict["bad"] and not any(v for k, v in verdict.items() if k.startswith("h"))
    assert got.filter("source = 'bad' AND kept").count() == 0


def test_licenses(spark, docs):
    r = random.Random(9)
    prose = [cases.prose(r, 12) for _ in range(400)]
    model = licenses.train(prose[:300])
    hits = lambda x: licenses.FAMILIES[int(model.probabilities(model.logits(x)).argmax())]
    assert hits("This project is licensed under the Apache License, Version 2.0, see the file.") == "Apache-2.0"
    assert hits("Released under CC BY-SA 4.0.") == "CC-BY-SA" and hits("released under the GNU General Public License, version 3") == "GPL"
    assert sum(hits(x) == "unknown" for x in prose[300:]) >= 98
    got = licenses.scan(docs).collect()
    assert [(x["family"], x["paragraph"], x["start"], x["n_chars"]) for x in got] == [("MIT", 5, 9, 31)]
    assert licenses.scan(cases.empty(spark)).count() == 0


def test_shards(spark, docs, rows):
    got = shards.assign(docs, 7).collect()
    sizes, places, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    expected = collections.Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(len(s) == 1 for s in where.values())
    groups = collections.Counter()
    for _, t, _ in rows:
        groups[t] += len(t.encode()) + 16
    # A shard holds at most a fair share and the largest group.
    assert max(sizes.values()) <= -(-sum(sizes.values()) // 7) + max(groups.values())
    assert shards.assign(cases.empty(spark), 7).count() == 0


def test_partition_is_minimax(spark):
    r = random.Random(1)
    for k in (1, 3, 8):
        groups = sorted((hashlib.sha256(str(r.random()).encode()).hexdigest(), r.randint(16, 300)) for _ in range(200))
        cuts, alone, low = shards.partition(spark.createDataFrame(groups, "digest string, size long"), k)
        sums = collections.Counter(sum(d >= c for c in cuts) for d, s in groups for _ in range(s))
        best, high = max(s for _, s in groups), sum(s for _, s in groups)
        while best < high:
            middle, n, room = (best + high) // 2, 1, (best + high) // 2
            for _, s in groups:
                n, room = (n + 1, middle - s) if s > room else (n, room - s)
            best, high = (best, middle) if n <= k else (middle + 1, high)
        assert not alone and low == best and max(sums.values()) <= best


def test_blocks_lose_no_link(spark):
    """One bucket with more members than a block, in components that a star would not join."""
    import pandas as pd

    def vectors(texts):
        return [(np.array(sorted(map(int, t.split())), np.uint64), np.ones(len(t.split()))) for t in texts]

    r = random.Random(8)
    texts = []
    for c in range(10):
        base = r.sample(range(1000 * c, 1000 * c + 900), 40)
        for _ in range(20):
            one = list(base)
            one[r.randrange(40)] = r.randrange(10**6, 10**7)
            texts.append(" ".join(map(str, one)))
    nodes = [i.to_bytes(2, "big") for i in range(len(texts))]
    keys = spark.createDataFrame(pd.DataFrame({"node": nodes, "keys": [[7, 8, 9, 10]] * len(nodes)}), "node binary, keys array<long>")
    content = spark.createDataFrame(pd.DataFrame({"node": nodes, "text": texts}), "node binary, text string")
    labels = near_components(keys, lambda wanted, n: content.join(wanted, "node", "left_semi"), vectors, 0.8)
    got = collections.defaultdict(set)
    for row in labels.collect():
        got[bytes(row["label"])].add(int.from_bytes(row["node"], "big") // 20)
    assert len(got) == 10 and all(len(g) == 1 for g in got.values()) and labels.count() == len(texts)


def test_wrapped_licences_are_found(spark):
    mit = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    bsd = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions
// are met:"""
    isc = """Permission to use, copy, modify,
and/or distribute this software
for any purpose with or without
fee is hereby granted"""
    apart = "Permission to use, copy, modify, and/or distribute\n\nthis software for any purpose with or without fee is hereby granted"
    data = [(1, mit), (2, f"a first line\n{bsd}"), (3, isc), (4, apart), (5, "Licensed under the MIT License.\nand more\nwords"), (6, "Permission to use, copy, modify, and/or distribute"), (7, "this software for any purpose with or without fee is hereby granted")]
    got = licenses.scan(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).collect()
    found = sorted((r["doc_id"], r["paragraph"], r["family"], dict(data)[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]]) for r in got)
    lines = mit.split("\n")
    expected = [(1, 4, "MIT", "\n".join(lines[4:6])), (1, 8, "MIT", "\n".join(lines[8:10])), (2, 1, "BSD", bsd), (3, 0, "ISC", isc), (5, 0, "MIT", "Licensed under the MIT License.")]
    assert found == expected


def test_line_sets_agree_with_sets_of_single_lines():
    random = np.random.default_rng(12)
    lines = ["".join(random.choice(list("ab é\U0001f600"), size)) for size in (1, 7, 8, 9, 40, 300, 2, 80)] + ["a" * 200_000, "b", "ab" * 70_000]
    for line, (keys, weights) in zip(lines, linedup._vectors(lines), strict=True):
        assert keys.tolist() == sorted(set(linedup.runs_of(line).tolist())) and (weights == 1).all() and len(weights) == len(keys)
    assert linedup._vectors([]) == []


def test_long_texts_do_not_run_alone_at_the_end(spark, monkeypatch):
    """Training takes no more windows than its longest text and its tokens need, wherever that text is in the table."""
    texts = ["a b c d. " * 5] * 400 + ["a b c d. " * 1000]
    steps = []
    learn = lm.Trainer.learn

    def counted(self, given):
        learn(self, given)
        steps.append(self.steps)

    monkeypatch.setattr(lm.Trainer, "learn", counted)
    shape = gru.Shape(head=8, per_class=4, embedding=4, hidden=4, window=4, lanes=4)
    words = {b"a": 3000, b"b": 3000, b"c": 3000, b"d.": 3000}
    vocab = lm.Vocabulary(words, {w: i for i, w in enumerate(words)}, 12_401, 5, 401, np.ones(27))
    sample = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    p = gru.start(shape, np.ones((2, 4)), np.ones(shape.classes))

    class Rows:
        """A table of one task, in this process, so that its steps can be counted."""

        sparkSession, rdd = spark, sample.rdd
        filter, select = sample.filter, lambda self, *c: self

        def mapInArrow(self, f, kind):
            return spark.createDataFrame(pa.Table.from_batches(list(f(iter(pa.table({"text": texts}).to_batches())))))

    monkeypatch.setattr(lm, "materialize", lambda df, name: df)
    monkeypatch.setattr(lm, "TaskContext", type("One", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    lm.train(Rows(), spark.sparkContext.broadcast(vocab), p, shape, lm.Settings(first_tokens=0))
    tokens = sum(len(t.split()) + 1 for t in texts)
    assert steps[-1] <= 1.1 * max(4001, tokens / shape.lanes) / shape.window


def test_texts_are_coded_once_as_words_are(spark, docs, monkeypatch):
    """Training and scoring read codes that were written once; in them a word is what it is by itself."""
    texts = ["", " \n", "A b\x0bb ", "\x1cq É. é, 日本 a, b. 日. Ω", "x" * 99 + ". \u00a0 \u0085", "b zz b yy zz"]
    words = [t.encode().lower().split() for t in texts]
    shape = gru.Shape(head=2, per_class=2)
    counts = {b"b": 5, b"a": 3, "é,".encode(): 2}
    vocab = lm.Vocabulary(counts, {b"b": 0, b"a": 1, "é,".encode(): 2 + gru.tail_class("é,".encode())}, 40, 9, 6, np.arange(2, 29))
    n, known, base, extra, coded, rare, times = (c.to_pylist() for c in lm.Coder(vocab, shape).code(pa.array([*texts, "cut off"]).slice(0, len(texts))))
    for i, w in enumerate(words):
        codes = [*(vocab.symbol(x, shape) for x in w), shape.end]
        logs = [*(math.log10(counts.get(x, 0) + 1) for x in w), math.log10(7)]
        assert np.frombuffer(coded[i], np.uint8).tolist() == codes and lm._coded(w, vocab, shape).tolist() == codes
        assert (n[i], known[i]) == (len(w) + 1, sum(x in counts for x in w) + 1)
        assert len(rare[i]) == len(times[i]) and dict(zip(rare[i], times[i])) == collections.Counter(x for x in w if x not in counts)
        assert math.isclose(base[i], sum(logs) - n[i] * math.log10(50), abs_tol=1e-9)
        tail = [(x, c) for x, c in zip(logs, codes) if 2 <= c < shape.end]
        assert math.isclose(extra[i], sum(x - math.log10(vocab.tail_sizes[c - 2]) for x, c in tail), abs_tol=1e-9)
    read, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *args: (read.append(args[-1].columns), real(*args))[1])
    lm.scores(docs)
    assert "codes" in read[0]


def test_windows_read_what_came_before():
    shape, r = gru.Shape(head=6, per_class=3, tails=2), np.random.default_rng(7)
    texts = [np.append(r.integers(0, 8, n), shape.end).astype(np.uint16) for n in (0, 30, 3, 4, 7, 0, 0, 12, 1, 8)]
    found = [[] for _ in texts]
    for _, x, y, doc, new in gru.windows(shape, iter(texts), 3, 4):
        for k, t in zip(*np.nonzero(doc.T >= 0)):
            found[doc[t, k]].append((x[t, k], y[t, k], new[t, k]))
    assert found == [[(shape.end if i == 0 else text[i - 1], c, i == 0) for i, c in enumerate(text)] for text in texts]
