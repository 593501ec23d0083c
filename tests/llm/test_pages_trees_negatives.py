"""Main text of pages, the conversations' trie and hard negatives: against brute force, planted cases and awkward rows."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.llm import negatives, trie, wrappers
from panelweave.llm.common import fold_of
from panelweave.llm.queries import LLM_QUERIES, LLM_SQL

FOLDER = "/root/testdata/sf0.001"
RNG = random.Random(11)
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def said(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in ("score", "rank", "host", "kind", "node", "slot", "key", "seq", "sizes", "size", "bucket", "q", "base", "h", "text_", "__salt")})


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_hard_negatives"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql(LLM_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


# 11: main text of pages


def blog(i, rng, wrap="div"):
    """A page whose main text lies among a menu, a notice, a sidebar, comments, a form and a footer."""
    parts = [said(6, rng)] + [said(40, rng) for _ in range(rng.randint(2, 6))]
    body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
    page = (
        f'<html><body class="has-sidebar"><header><h2>Best news</h2></header><div class="nav-menu"><a href=1>{said(1, rng)}</a></div><div class="cookieNotice">We use cookies {said(5, rng)}</div>'
        f'<div class="content-with-sidebar"><{wrap} class="post">{body}</{wrap}><div class="sidebar"><p>{said(20, rng)}</p></div></div>'
        f'<section id="comments"><article class="comment"><p>{said(90, rng)}</p></article></section><form><label>Name</label></form><footer>{said(5, rng)}</footer></body></html>'
    )
    return "\n".join(parts), page


def bare(i, rng):
    """A page without any telling name: only what is the same on all pages of its host is template."""
    parts = [said(6, rng)] + [said(40, rng) for _ in range(rng.randint(2, 6))]
    links = "".join(f"<li><a href=x>{said(2, rng)}</a></li>" for _ in range(4))
    return "\n".join(parts), f"<div><div>My Site</div><ul>{links}</ul><div><h1>{parts[0]}</h1>{''.join(f'<div>{x}</div>' for x in parts[1:])}<div>All rights reserved by the site</div></div></div>"


def texts(spark, rows, **options):
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r for r in wrappers.extract_main_text(df, **options).collect()}


@pytest.mark.parametrize("most_broadcast", [20_000, 0])
def test_main_text_of_several_layouts(spark, most_broadcast):
    rng, rows, want = random.Random(2), [], {}
    for k, make in enumerate([blog, lambda i, r: blog(i, r, "article"), bare]):
        for i in range(12):
            text, page = make(i, rng)
            want[100 * k + i] = text
            rows.append((100 * k + i, f"https://host{k}.example.org/p/{i}", page))
    text, page = blog(0, rng)  # a host of one page, and copies of one page: no evidence of a template
    rows += [(900, "http://alone.example.org/", page), *((910 + i, "http://copies.example.org/", page) for i in range(9))]
    want |= {900: text} | {910 + i: text for i in range(9)}
    got = texts(spark, rows, most_broadcast=most_broadcast)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_of_awkward_pages(spark):
    page = "<article><h1>T &amp; U&nbsp;V</h1><p>one<br>two<p>three <script>var t='</p>';</script>four<!-- <p>no</p> --></article><nav>menu</nav>"
    rows = [(1, "http://a.b/", None), (2, None, ""), (3, "no scheme", "plain text"), (4, "http://a.b/x", page), (5, "http://a.b/x", page), (None, "http://a.b/y", page)]
    rows += [(6, "http://c.d/", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "http://c.d/", "<article>" + "<p>word &lt;b&gt;</p>" * 20_000), (8, "http://e.f/", '<a href="x>never closed</a> text' + ' and more' * 9), (9, "http://e.f/", "<p>a < b <3 c</p><div cla")]
    got = texts(spark, rows)
    main = "T & U V\none two\nthree four"
    assert [got[i].text for i in (1, 2, 3, 4, 5, None)] == ["", "", "plain text", main, main, main]
    assert got[6].text == "deep" and got[7].text == "\n".join(["word <b>"] * 20_000)
    assert got[8].text.endswith("text" + " and more" * 9) and got[9].text == "a < b <3 c"
    assert texts(spark, []) == {}


def test_a_passage_on_many_pages_is_no_template(spark):
    rng, rows, want = random.Random(4), [], {}
    shared = said(60, rng)
    for i in range(40):
        parts = [said(5, rng), said(30, rng), *([shared] if i % 3 else []), said(30, rng)]
        want[i] = "\n".join(parts)
        rows.append((i, "https://x.example.org/", f"<div class=ad>{said(4, rng)}</div><article>{''.join(f'<p>{p}</p>' for p in parts)}</article>"))
    assert {i: r.text for i, r in texts(spark, rows).items()} == want


def random_tree(rng, depth=3):
    return [rng.choice("abc"), 1, [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else [], None]


def brute_match(a, b):
    """Simple tree matching by trying all order-preserving pairings of children."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), brute_match(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[2], b[2])


def test_tree_matching_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        a[0] = b[0] = "r"
        assert wrappers.match_trees(a, b)[0] == brute_match(a, b)


def test_wrappers_hold_every_tree():
    rng = random.Random(6)
    skeletons = {wrappers.Page(blog(i, rng, rng.choice(("div", "article")))[1].replace("<footer>", rng.choice(("<footer>", "<div id=x><hr></div><footer>")))).skeleton() for i in range(30)}
    wrapper = wrappers.read(wrappers.written(wrappers.induce([wrappers.tree_of(s, 1) for s in sorted(skeletons)], 400)))
    for s in skeletons:
        slots = wrappers.slots_of(wrapper, wrappers.tree_of(s, 1), s.count("\n") + 1)
        assert -1 not in slots and len(set(slots)) == len(slots)


def test_wrappers_of_hosts_with_many_skeletons(spark):
    rows = [("h", i, f"-1 #\n0 div\n1 p\n0 div {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}", 1 + i) for i in range(100)]
    kinds = spark.createDataFrame(rows, "host string, kind long, skeleton string, n long")
    got = wrappers.induced_wrappers(kinds, fan=4).collect()
    tree = wrappers.read(got[0].wrapper)
    assert len(got) == 1 and tree[1] == sum(r[3] for r in rows) and {c[0] for c in tree[2]} == {r[2].split("\n")[-1][2:] for r in rows} | {"div"}
    few = wrappers.read(wrappers.induced_wrappers(kinds, fan=4, most_nodes=20).first().wrapper)
    assert few[1] == tree[1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap\"'= !-&;sx\n", max_size=60))
def test_any_page_is_read(page):
    made = wrappers.Page(page)
    assert all(0 <= n < len(made.labels) and t == " ".join(t.split()) != "" for n, t, _ in made.blocks)
    assert all(p < k for k, p in enumerate(made.parents))


def test_unclosed_quotes_take_linear_time():
    assert wrappers.Page("<a '\"" * 200_000 + "<p>x").blocks


# 12: prefix trie


def brute_trie(rows, head=None):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    full = {c: tuple((own.get(c - int(math.fmod(c, 100)), [])[: head(c)] + ts[head(c) :]) if head else ts) for c, ts in own.items()}
    nodes = {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = {}
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    out = []
    for s, members in nodes.items():
        below = [t for t in nodes if t[: len(s)] == s]
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == s))
        saved = sum((len(nodes[t]) - 1) * len(t[-1][1]) for t in below if t)
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(kids.get(s, [])), sum(t not in kids for t in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def heads(c):
    return zlib.crc32(str(c).encode()) % 6


def test_trie_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for c in [*range(-120, 260, 3), 100, 200, 10**12]:
        many = rng.choice((0, 1, 2, 5, 9))
        rows += [(c, rng.choice((None, t)), rng.choice(("user", "assistant", None)), rng.choice(("hello", "aé\U0001f600", "", None))) for t in range(many)]
        if c % 2:  # a hot group of copies and a hot first turn
            rows += [(c, 10 + t, "user", "same " * 3) for t in range(4)]
    rows += [(None, 1, "user", "lost"), (7, 1, "user", "twice"), (7, 1, "user", "twice")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(5)
    c = F.col("conv_id")
    for limit in (0, 100_000):
        got = trie.prefix_trie(df, head=fold_of(c, 6), base=c - c % 100, shard_rows=9, most_broadcast=limit)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows, heads)
    assert sorted(map(tuple, trie.prefix_trie(df, shard_rows=9).collect()), key=str) == brute_trie(rows)
    assert trie.prefix_trie(df.filter("false")).count() == 0


def test_trie_of_a_long_conversation_and_its_copies(spark):
    rows = [(c, t, "user", str(t)) for c in (5, 6, 8) for t in range(400 + 50 * (c == 8))] + [(c, 0, "user", str(c % 3)) for c in range(1000, 1300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.prefix_trie(df, shard_rows=1).collect()), key=str) == brute_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), max_size=6), min_size=1, max_size=30))
def test_double_arrays_hold_their_sequences(lists):
    seqs = sorted({tuple(s) for s in lists})
    length = np.array([len(s) for s in seqs])
    start = np.r_[0, np.cumsum(length)[:-1]]
    codes = np.array([c for s in seqs for c in s], np.int64)
    made = trie.DoubleArray(codes, start, length, tries=2)
    reached = {}
    for d, (live, node) in enumerate(made.walk(codes, start, length)):
        for i, s in zip(live.tolist(), node.tolist(), strict=True):
            assert reached.setdefault(s, seqs[i][:d]) == seqs[i][:d]
    assert len(made.nodes()[0]) + 1 == len(reached) == len({s[:d] for s in seqs for d in range(len(s) + 1)})


# 13: hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    kept = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]))
    out = []
    for i, lab, v in kept:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in kept if j != i and len(w) == len(v))
            for p, j in [(-s, j) for s, j, m in scored if m == lab][:positives]:
                fine = [(-s, k) for s, k, m in scored if m != lab and 30 * p <= -100 * s <= 90 * p][:negatives]
                out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(fine)]
    return sorted(out)


def mined(spark, rows, **options):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df.repartition(4), F.col("vec_id") % 100 == 0, label, **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 40))
    vectors = np.round(centres[rng.integers(0, 6, 900)] + 0.5 * rng.normal(size=(900, 40)), 2)
    vectors[::3] = vectors[0]  # a third of all rows are copies
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, rows, most_anchors=3) == brute_negatives(rows)  # several rounds


def test_negatives_of_awkward_rows(spark):
    big = [8e6, -1.0, 2.0]
    rows = [(0, [1.0, 2.0, 3.0], 1), (100, [0.0, 0.0, 0.0], 1), (200, [-1.0, 0.5, 0.0], 2), (300, [1.0, 2.0], 1), (400, big, 3), (500, [], 1), (600, [], 2), (None, [1.0, 1.0, 1.0], 1), (1, None, 1), (2, [1.0, None, 1.0], 1), (3, [1.0, math.nan, 1.0], 1), (4, [1.0, math.inf, 1.0], 2), (5, [1.0, 1.0, 1.0], None)]
    rows += [(10 + i, [1.0, 1.0 + i / 3, 0.25 * i], i % 3) for i in range(30)] + [(60 + i, [x / 2 for x in big], 3) for i in range(2)] + [(70 + i, [x / 3 for x in big], 1) for i in range(3)] + [(80, [1.0, 2.0], 1), (81, [0.5, 1.0], 2)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == []


def test_negatives_met_in_growing_shares(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, np.round(rng.normal(size=8), 2).tolist(), int(rng.integers(0, 3))) for i in range(1200)]
    real = negatives._search
    monkeypatch.setattr(negatives, "_search", lambda r, a, n, total, **k: real(r, a, n, 40_000_000, **k))  # as if the table were large: three shares
    assert mined(spark, rows) == brute_negatives(rows)


def test_summaries_bound_products():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 50, 13))
    for s in (1, 2, 4, 13):
        (m, d), (n, e) = negatives.summaries(a, s), negatives.summaries(b, s)
        exact = a @ b.T
        assert (m @ n.T - d @ e.T <= exact + 1e-9).all() and (exact <= m @ n.T + d @ e.T + 1e-9).all()
