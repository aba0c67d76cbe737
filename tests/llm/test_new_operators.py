"""Mixing, prefix trie and lexical search against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import html_text, lexical_search, mixing, prefix_trie
from pixelweave.llm.queries import QUERIES

CLASH = "_c long, _seq long, _k string, _size string, _source int, _pi double, _copies int, _row long, _item int, _doc string, _terms int"
FILL = (1, 2, "k", "s", 3, 0.5, 1, 4, 5, "d", 6)


def targets(sizes: dict) -> dict:
    """Step by step: share by weight, cap, share what is over among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest, shares = total - sum(capped.values()), sum(w for s, w in weight.items() if s not in capped)
        now = {s: rest * w / shares for s, w in weight.items() if s not in capped}
        over = {s: 3.0 * sizes[s] for s, t in now.items() if t > 3 * sizes[s]}
        if not over:
            return now | capped
        capped |= over


@pytest.fixture(scope="module")
def documents():
    rnd = random.Random(5)
    out = []
    for source, n, most in (("b", 900, 40), ("a", 60, 400), ("é", 25, 30), ("Z", 8, 2000), (None, 40, 60), ("c", 6, 3), ("empty", 3, 0)):
        out += [(len(out) + i, " ".join("w" * rnd.randint(1, 6) for _ in range(rnd.randint(0, most))), source) for i in range(n)]
    out += [(5, out[5][1], "b"), (5, out[5][1], "b"), (None, "x y\tz\n", "b"), (None, None, "a"), (7001, " \n\t\x0b\x0c\r ", "b"), (7002, "giant word " * 20_000, "b")]
    return out


def frame(spark, documents, parts=3):
    return spark.createDataFrame([(*d, *FILL) for d in documents], f"doc_id long, text string, source string, {CLASH}").repartition(parts)


def test_mix_meets_its_targets_and_agrees_with_itself(spark, documents):
    got = mixing.mix(frame(spark, documents), keep=("source", "_size")).withColumnRenamed("source", "src").toDF("doc_id", "source", "extra", "size", "source_size", "target", "copies").collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((k, words(t), s) for k, t, s in documents)
    sizes = defaultdict(int)
    for _, t, s in documents:
        sizes[s] += words(t)
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.copies <= 3 and r.extra == "s"
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():  # the large documents of a source leave an error below their own size, the others next to none
        assert abs(taken[s] - t) <= max(2, 0.002 * t, 0.5 * largest[s] if len([1 for d in documents if d[2] == s]) < 30 else 0), (s, t, taken[s])
    rate = {s: t / sizes[s] if sizes[s] else 0 for s, t in want.items()}
    assert all(r.copies in (math.floor(rate[r.source] + 1e-9), math.ceil(rate[r.source] - 1e-9)) for r in got)
    again = mixing.mix(frame(spark, reversed(documents), 5)).toDF("doc_id", "size", "s", "t", "copies").collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in got) == Counter((r.doc_id, r.size, r.copies) for r in again)


def test_hot_source_in_many_blocks_is_balanced(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rnd = random.Random(2)
    docs = [(i, " ".join(["w"] * int(rnd.paretovariate(2.0) * 5)), "hot" if i % 3 else f"s{i % 9}") for i in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), keep=("source",))
    for r in mixing.balance(mixed, "source").collect():
        assert abs(r.taken - r.target) <= 0.003 * r.target
    # Where one document is a large part of its source, the others make up for its words, not for the document.
    even = mixed.groupBy("source").agg((F.max("_size") < 0.05 * F.sum("_size")).alias("even")).filter("even")
    counts = mixed.join(even, "source").groupBy("source").agg(F.sum("_copies").alias("n"), F.sum(F.col("_target") / F.col("_source_size")).alias("want")).collect()
    assert all(abs(r.n - r.want) <= max(4, 0.02 * r.want) for r in counts), [(r.n, r.want) for r in counts]
    assert len(counts) == 4 and mixing.repeated(mixed).count() == mixed.agg(F.sum("_copies")).first()[0]


def test_flight_keeps_both_sums_and_landing_is_the_nearest():
    rnd = np.random.default_rng(1)
    size = sorted(rnd.integers(1, 500, 400).tolist(), reverse=True)
    for start in (0.5, 0.1, 0.93):
        pi = [start] * 400
        open_ = mixing.flight(size, pi, rnd.random(400).tolist(), 2)
        assert len(open_) <= 2 and all(pi[i] in (0.0, 1.0) for i in range(400) if i not in open_)
        assert math.isclose(sum(pi), start * 400, abs_tol=1e-5) and math.isclose(np.dot(pi, size), start * sum(size), rel_tol=1e-7)
    n = 2000
    hits = np.zeros(5)
    for _ in range(n):  # the chance of being taken is the probability that went in
        pi = [0.3, 0.3, 0.3, 0.3, 0.3]
        open_ = mixing.flight([9, 7, 4, 2, 1], pi, rnd.random(5).tolist(), 2)
        hits += [x if i in open_ else pi[i] for i, x in enumerate(pi)]
    assert np.allclose(hits / n, 0.3, atol=0.04)
    assert mixing.landing(np.array([10.0, 6.0, 5.0]), np.array([0.5, 0.5, 0.4])).tolist() == [1.0, 0.0, 0.0]


def test_flight_of_equal_sizes_and_few_rows():
    for n in range(6):
        pi = [0.5] * n
        open_ = mixing.flight([3] * n, pi, [0.1] * n, 2)
        assert len(open_) <= 2 and math.isclose(sum(pi), n / 2)


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), m, role, text))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, own in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, own in nodes.items():
        ends = ",".join(map(str, sorted(c for c in own if full[c] == p)))
        out.append((min(own), len(p), min(nodes[p[:-1]]) if p else None, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats():
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 330), *range(-130, -90), 10**12, 10**12 + 7]:
        rows += [(c, t, ("user", "assistant")[t % 2], rnd.choice(["hello", "hello", "yes", "no é", "𝔘 well", ""])) for t in range(rnd.choice([1, 2, 3, 4, 7, 12]))]
    rows += [(1000 + i, t, "user", "the same") for i in range(150) for t in range(3)]  # copies
    rows += [(2000, t, "user", f"turn {t}") for t in range(500)]  # a long one
    rows += [(3000, None, None, "first"), (3000, None, "user", None), (3000, 1, "user", "x"), (3000, 1, "user", "x"), (None, 1, "user", "lost"), (3001, -5, None, None)]
    rnd.shuffle(rows)
    return rows


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ids", [500_000, 700, 60])
def test_trie_equals_brute_force_over_one_and_more_levels(spark, monkeypatch, ids):
    monkeypatch.setattr(prefix_trie, "SHARD_IDS", ids)
    rows = chats()
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "conv_id long, turn long, role string, text string, _c long, _seq long, _k string").repartition(3)
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.encoded(df)))) == brute_trie(rows)


def test_digest_runs_through_chunks(monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    keys, ids = [b"a"] * 20 + [b"b"] + [b"c"] * 14, [*range(20), 5, *range(14)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 9], pa.binary()), pa.array(ids[i : i + 9])], ["_k", "_c"]) for i in range(0, 35, 9)]
    got = [r for b in prefix_trie._digests(prefix_trie._chunks(iter(batches))) for r in b.to_pylist()]
    sha = lambda n: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert [(r["_k"], r["_count"], r["_least"]) for r in got] == [(b"a", 20, 0), (b"b", 1, 5), (b"c", 14, 0)]
    assert got[0]["_ends"] == sha(20) and got[2]["_ends"] == sha(14) and got[1]["_ends"] == hashlib.sha256(b"5").hexdigest()


def brute_search(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: pattern.findall((t or "").translate(lower))
    counts = [(k, Counter(terms(t))) for k, t in docs]
    counts = [(k, c, c.total()) for k, c in counts if c]
    n, total, df = len(counts), sum(x[2] for x in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for i, text in items:
        scores = []
        for k, c, size in counts:
            m = 10 + (90 * size * n) // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c), k is None, k))
        out += [(i, r + 1, k, -s) for r, (s, _, k) in enumerate(sorted(x for x in scores if x[0] < 0)[:10])]
    return sorted(out, key=repr)


WORDS = "Tree stone RIVER cloud naïve İstanbul ΣΑΣ 12 3x a_b don't 中文 x".split()


def search_tables(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 30))) + rnd.choice(["", " rare", " rare2!"])) for i in range(300)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[3][1]), (None, None), (900, "…"), (901, "stone " * 400_000), (902, "")]
    items = [(f"q{i}", " ".join(rnd.choices([*WORDS, "rare", "unseen", "rare2"], k=rnd.randint(1, 9)))) for i in range(30)]
    items += [("q1", "tree rare"), (None, "river"), ("none", None), ("blank", " -- "), ("long", " ".join(f"t{i}" for i in range(50)) + " stone tree cloud 12 rare 3x")]
    d = spark.createDataFrame([(*x, *FILL) for x in docs], f"doc_id long, text string, {CLASH}").repartition(4)
    q = spark.createDataFrame([(*x, *FILL) for x in items], f"item_id string, text string, {CLASH}").repartition(2)
    return docs, items, d, q


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # several tiles, items in parts, several groups of items
        monkeypatch.setattr(lexical_search, "TILE_TERMS", 8)
        monkeypatch.setattr(lexical_search, "TILE_ITEMS", 4)
        plain = lexical_search.groups
        monkeypatch.setattr(lexical_search, "groups", lambda asked: plain(asked, 500))
    docs, items, d, q = search_tables(spark)
    got = [tuple(r) for r in lexical_search.search(d, q).collect()]
    assert Counter(got) == Counter(brute_search(docs, items))


def test_best_keeps_ties():
    score, doc = np.array([5, 7, 7, 7, 0, 7]), np.array([1, 9, 4, 6, 2, 5])
    assert [x.tolist() for x in lexical_search.best(score, doc, 3)] == [[7, 7, 7], [4, 5, 6]]


def test_partial_sums_stay_exact():
    assert lexical_search.TILE_TERMS * 10**6 * 1000 * math.log(2 * 2**63) < 2**53


def test_empty_tables(spark, tmp_path):
    out = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    for name in ("op11_mix", "op12_prefix_trie", "op13_lexical_search"):
        df = QUERIES[name](spark, out)
        assert df.collect() == [] and all(t != "void" for _, t in df.dtypes)


def test_html_parts_of_an_article_stay_whatever_their_class(spark):
    page = """<body><nav>Menu</nav><article class="post"><h1>T</h1><figure class="banner"><figcaption>A view.</figcaption></figure><div class="menu-of-the-day"><p>Soup.</p></div>
<p class="notice">Mind the step.</p><p>Body text goes on for a while here.</p><div class="ad">Buy now</div><div class="site-newsletter">Subscribe</div><article class="comment">First!</article></article>
<article class="teaser"><a href="/x">Read more</a></article><div class="comments">Nice.</div></body>"""
    text = html_text.main_text(page)
    assert text == "T A view. Soup. Mind the step. Body text goes on for a while here."
    two = "<body><article><p>One long part of the text.</p></article><article><p>Another long part of it.</p></article></body>"
    assert html_text.main_text(two) == "One long part of the text. Another long part of it."
    assert html_text.main_text("<main><p>Here.</p></main><article>There, a much longer text than the other.</article>") == "Here."


def test_html_frames_go_by_their_skeleton(spark):
    rnd = random.Random(4)
    say = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{i}'>{say(1)}</a></li>" for i in range(n))
    art = {i: f"{say(30)}" for i in range(60)}
    # Frames whose words, and numbers of links, differ from page to page; their tags and classes are on no list.
    pages = [(i, f"http://a.example/{i}", f"<body><div class='topside w{i}'><ul>{links(3 + i % 4)}</ul></div><div class='xq'>{say(6)}</div><article><p>{art[i]}</p></article><div>{say(4)} <a>{say(1)}</a></div></body>") for i in range(30)]
    # No article element: mostly linked boxes that recur go, boxes of plain text stay, recurring skeleton or not.
    pages += [(100 + i, f"http://b.example/{i}", f"<body><div class='rail'><ul>{links(4)}</ul></div><div class='c'><p>{art[30 + i]}</p></div><div class='c2'>{art[i]}</div></body>") for i in range(30)]
    # A box of links on two pages only of a host.
    pages += [(200 + i, f"http://c.example/{i}", f"<body><div class='own{'x' * (i < 2)}'><p>{art[i]}</p>{f'<ul>{links(9)}</ul>' if i < 2 else ''}</div></body>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    by_counts = {r.page_id: r.text for r in html_text.extract_text(df, lists=False).collect()}
    both = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    for i in range(30):
        assert by_counts[i] == both[i] == art[i]
        assert by_counts[100 + i] == both[100 + i] == f"{art[30 + i]} {art[i]}"
        assert both[200 + i].startswith(art[i]) and (len(both[200 + i].split()) == 39) == (i < 2)
