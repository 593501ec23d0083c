"""Operator 11: main text of web pages, by wrappers induced from the pages of each host."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import discard, per_text, stage, staged

# The elements that make blocks of text, those whose content is no text, and those that end an open paragraph.
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul listing li dd dt".split())
VOID = frozenset(("hr", "col"))
#: What an opening element closes, and where that search stops.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("table", "tr"))), "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select",))), "body": (frozenset(("head",)), frozenset()),
}
#: Words of class, id and role that name regions beside the main text.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager footer colophon contentinfo copyright sidebar sidebars aside complementary widget widgets rail related recommended recommendations trending popular notice notices cookie cookies consent gdpr alert popup modal dialog overlay form search login signin signup subscribe subscription newsletter comment comments commentlist respond reply replies discussion disqus share sharing social skip hidden".split()
)
HEADERS = frozenset("header masthead topbar banner".split())
AROUND_TAGS = frozenset("nav aside footer form button select option optgroup dialog menu search fieldset legend".split())
MAIN = frozenset("article main".split())
#: What lies below these is never main, though it be an article.
ASIDE_TAGS = frozenset("nav aside footer".split())
ASIDE = frozenset("comment comments commentlist respond reply replies discussion disqus related recommended recommendations trending popular".split())
DEEPEST = 200

_ATTRS = r"""(?:[^"'>]|"[^"]*"|'[^']*')*+"""
_TOKEN = rf"""<(?P<raw>{"|".join(RAW)})(?=[\s/>]){{attrs}}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<drawn>svg|math)(?=[\s/>]){{attrs}}(?:(?<=/)>|(?<!/)>.*?(?:</(?P=drawn)(?=[\s/>])[^>]*>|\Z))|<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{{attrs}})>|<[!?/][^>]*(?:>|\Z)"""
STRICT = re.compile(_TOKEN.format(attrs=_ATTRS) + r"|(?P<odd><[a-zA-Z/][^>]*>)", re.S | re.I)
LENIENT = re.compile(_TOKEN.format(attrs="[^>]*"), re.S | re.I)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?:$|[\s=/])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and raw elements. After a tag whose quotes never close, quotes no longer count: so each character is read once or twice."""
    for m in STRICT.finditer(page):
        if m["odd"]:
            yield from LENIENT.finditer(page, m.start())
            return
        yield m


@lru_cache(10_000)
def label_of(tag: str, attrs: str) -> str:
    """The tag, and the words of its class, id and role in order; words next to digits say nothing and are left out."""
    if not attrs:
        return tag
    words = set()
    for _, *value in _NAMES.findall(attrs) if "=" in attrs else ():
        for part in re.split(r"[^A-Za-z0-9]+", "".join(value)):
            if not any(c.isdigit() for c in part):
                words.update(w.lower() for w in _WORD.findall(part))
    if _UNSEEN.search(attrs) or _HIDDEN.search(_QUOTED.sub("", attrs)):
        words.add("hidden")
    return " ".join([tag, *sorted(words - {tag})])


class Page:
    """The tree of a page's block elements, folded: siblings with one label are one node, in order of first sight.

    labels, parents: the nodes, the root first, parents before children. blocks: (node, text, characters inside links) of each run of text
    between block boundaries, in page order, blanks joined to one. Elements deeper than DEEPEST hang on their ancestor there.
    """

    def __init__(self, page: str) -> None:
        self.labels, self.parents = ["#"], [-1]
        self.blocks: list[tuple[int, str, int]] = []
        known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int]] = [("#", 0)]
        text: list[str] = []
        linked, link_depth, at = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((stack[-1][1], joined, min(linked, len(joined))))
                text.clear()
                linked = 0

        def say(run: str) -> None:
            nonlocal linked
            if "&" in run:
                run = html.unescape(run)
            text.append(run)
            if link_depth:
                linked += len(run.strip())

        def close(tags: frozenset, stops: frozenset = frozenset()) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    pop(k)
                    return
                if stack[k][0] in stops:
                    return

        def pop(k: int) -> None:
            nonlocal link_depth
            flush()
            del stack[k:]
            if link_depth > len(stack):
                link_depth = 0

        for m in _tokens(page):
            if m.start() > at:
                say(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in BLOCKS:
                if tag == "a":
                    link_depth = 0 if m["end"] else len(stack)
                elif tag in ("br", "img", "wbr"):
                    text.append(" " if tag != "wbr" else "")
                continue
            if m["end"]:
                close(frozenset((tag,)))
                flush()
                continue
            flush()
            if tag in ENDS_P:
                close(frozenset(("p",)), frozenset(("table", "td", "th", "caption", "button")))
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in VOID:
                continue
            if tag in ("html", "body") and any(t == tag for t, _ in stack):
                continue
            parent, label = stack[-1][1], label_of(tag, m["attrs"] or "")
            if len(stack) < DEEPEST:
                if (node := known.get((parent, label))) is None:
                    node = known[parent, label] = len(self.labels)
                    self.labels.append(label)
                    self.parents.append(parent)
            else:
                node = parent
            stack.append((tag, node))
        # an unfinished tag at the end is no text
        rest = page[at:]
        say(rest[: m.start()] if (m := re.search(r"<[a-zA-Z/!?]", rest)) else rest)
        flush()

    def skeleton(self) -> str:
        """The folded tree as lines `parent label`."""
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents, self.labels, strict=True))


Tree = list  # [label, weight, children, own number or None]


def tree_of(skeleton: str, weight: int) -> Tree:
    nodes: list[Tree] = []
    for k, line in enumerate(skeleton.split("\n")):
        parent, label = line.split(" ", 1)
        nodes.append([label, weight, [], k])
        if k:
            nodes[int(parent)][2].append(nodes[-1])
    return nodes[0]


def match_trees(a: Tree, b: Tree, memo: dict | None = None) -> tuple[int, list]:
    """Simple tree matching: the most pairs of nodes with equal labels that keep parents and the order of siblings, and the matched children of the roots.

    0 if the roots' labels differ. memo keeps the results of pairs below.
    """
    memo = {} if memo is None else memo
    if (found := memo.get((id(a), id(b)))) is not None:
        return found
    if a[0] != b[0]:
        memo[id(a), id(b)] = found = (0, [])
        return found
    x, y = a[2], b[2]
    if not x or not y:
        memo[id(a), id(b)] = found = (1, [])
        return found
    m = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    w = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            pair = match_trees(p, q, memo)[0] if p[0] == q[0] else 0
            if pair:
                w[i, j] = pair
            m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + pair)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if (i - 1, j - 1) in w and m[i, j] == m[i - 1, j - 1] + w[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif m[i, j] == m[i - 1, j]:
            i -= 1
        else:
            j -= 1
    memo[id(a), id(b)] = found = (int(m[-1, -1]) + 1, pairs[::-1])
    return found


def merge_into(wrapper: Tree, tree: Tree, memo: dict | None = None) -> None:
    """Lay a tree over the wrapper: matched nodes add their weights, the others are put in where they stand between matched siblings."""
    memo = {} if memo is None else memo
    _, pairs = match_trees(wrapper, tree, memo)
    wrapper[1] += tree[1]
    partner = {j: wrapper[2][i] for i, j in pairs}
    for j, child in enumerate(tree[2]):
        if j in partner:
            merge_into(partner[j], child, memo)
    at = 0
    for j, child in enumerate(tree[2]):
        if j in partner:
            at = next(k for k, c in enumerate(wrapper[2]) if c is partner[j]) + 1
        else:
            wrapper[2].insert(at, child)
            at += 1


def pruned(wrapper: Tree, most: int) -> Tree:
    """The wrapper with its `most` heaviest nodes at most; a node never outweighs its parent, so what stays is a tree."""
    weights = []

    def visit(t: Tree, depth: int) -> None:
        weights.append((-t[1], depth))
        for c in t[2]:
            visit(c, depth + 1)

    visit(wrapper, 0)
    if len(weights) <= most:
        return wrapper
    bar = sorted(weights)[most - 1]

    def cut(t: Tree, depth: int) -> None:
        t[2] = [c for c in t[2] if (-c[1], depth + 1) <= bar]
        for c in t[2]:
            cut(c, depth + 1)

    cut(wrapper, 0)
    return wrapper


def written(tree: Tree) -> str:
    """A wrapper as lines `parent weight label`."""
    out: list[str] = []

    def visit(t: Tree, parent: int) -> None:
        k = len(out)
        out.append(f"{parent} {t[1]} {t[0]}")
        for c in t[2]:
            visit(c, k)

    visit(tree, -1)
    return "\n".join(out)


def read(lines: str) -> Tree:
    nodes: list[Tree] = []
    for k, line in enumerate(lines.split("\n")):
        parent, weight, label = line.split(" ", 2)
        nodes.append([label, int(weight), [], k])
        if k:
            nodes[int(parent)][2].append(nodes[-1])
    return nodes[0]


def induce(trees: list[Tree], most: int) -> Tree:
    """One wrapper of all trees, the heaviest first."""
    wrapper = trees[0]
    for t in trees[1:]:
        merge_into(wrapper, t)
        wrapper = pruned(wrapper, most)
    return pruned(wrapper, most)


def slots_of(wrapper: Tree, tree: Tree, count: int) -> list[int]:
    """For each node of the tree the number of the wrapper's node it is matched to, -1 where none."""
    out, memo = [-1] * count, {}
    todo = [(wrapper, tree)] if wrapper[0] == tree[0] else []
    while todo:
        w, t = todo.pop()
        out[t[3]] = w[3]
        todo += [(w[2][i], t[2][j]) for i, j in match_trees(w, t, memo)[1]]
    return out


@lru_cache(10_000)
def around(label: str, inside_main: bool) -> bool:
    """Whether a label names a region beside the main text: by its tag, or by a word of its class, id or role."""
    tag, *words = label.split(" ")
    if tag in ("html", "body", "#"):
        return False
    if tag in AROUND_TAGS or not AROUND.isdisjoint(words):
        return True
    return not inside_main and (tag == "header" or not HEADERS.isdisjoint(words))


def content_nodes(labels: list[str], parents: list[int], chars: list[float], linked: list[float], varied: list[float], *, region_share: float = 0.6, link_share: float = 0.6) -> list[bool]:
    """Which nodes' own text is main text.

    chars, linked, varied: what a slot holds on a page of its host on average (characters, those in links) and the share of its characters that vary from page
    to page. Left out are regions named as beside the main text (unless they hold an article), slots that are the same on all pages, and, outside of
    articles, slots of links. Main is then what lies in article or main elements, if those hold a fair share of what is left; else in the deepest
    node that holds region_share of it, and headings of the first order.
    """
    n = len(labels)
    words = [x.split(" ") for x in labels]
    tag = [w[0] for w in words]
    below, is_main = [False] * n, [False] * n
    for k in range(n):
        below[k] = (k > 0 and below[parents[k]]) or tag[k] in ASIDE_TAGS or not ASIDE.isdisjoint(words[k][1:])
        is_main[k] = not below[k] and (tag[k] in MAIN or "main" in words[k][1:] or {"article", "body"} <= set(words[k][1:]))
    holds, headed, total = is_main.copy(), [t == "h1" for t in tag], [0.0 if b else c for b, c in zip(below, chars, strict=True)]
    for k in range(n - 1, 0, -1):
        p = parents[k]
        holds[p], headed[p], total[p] = holds[p] or holds[k], headed[p] or headed[k], total[p] + total[k]
    out, inside = [False] * n, [False] * n
    for k in range(n):
        p = parents[k]
        inside[k] = is_main[k] or (p >= 0 and inside[p])
        frame = (holds[k] and not inside[k]) or (tag[k] in MAIN and is_main[k]) or (tag[k] not in ASIDE_TAGS and tag[k] != "header" and headed[k] and total[k] >= 0.5 * total[0])
        out[k] = (p >= 0 and out[p]) or (around(labels[k], inside[k]) and not frame)
    weight = [0.0 if out[k] else chars[k] * varied[k] * (1.0 if inside[k] or chars[k] <= 0 or linked[k] <= link_share * chars[k] else 0.0) for k in range(n)]
    eligible = [not out[k] and (inside[k] or chars[k] <= 0 or linked[k] <= link_share * chars[k]) for k in range(n)]
    sub = weight.copy()
    for k in range(n - 1, 0, -1):
        sub[parents[k]] += sub[k]
    whole = sub[0]
    if whole <= 0:
        return eligible if any(inside) and sum(c for c, i in zip(chars, inside, strict=True) if i) > 0 else [False] * n
    if sum(w for w, i in zip(weight, inside, strict=True) if i) >= 0.3 * whole:
        return [e and i for e, i in zip(eligible, inside, strict=True)]
    region = 0
    while heir := [k for k in range(region + 1, n) if parents[k] == region and sub[k] >= region_share * whole]:
        if chars[heir[0]] >= 0.5 * sub[heir[0]]:
            break  # the text's own blocks are no region
        region = heir[0]
    within = [False] * n
    for k in range(n):
        within[k] = k == region or (k > 0 and within[parents[k]])
    return [e and (i or t == "h1") for e, i, t in zip(eligible, within, tag, strict=True)]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, lower-case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def _hash(text: str) -> int:
    """64 bits of a text, signed."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parsed(pages: DataFrame, columns: str = "skeleton string, kind long, nodes array<int>, hashes array<long>, sizes array<int>, links array<int>, article long") -> DataFrame:
    """Each page's html read once, beside the other columns: its skeleton, and for each block its node, its text or the text's hash, and its characters."""
    names = [c.split()[0] for c in columns.split(", ")]

    def values(page: Page) -> dict:
        skeleton, blocks = page.skeleton(), page.blocks
        made = {"skeleton": lambda: skeleton, "kind": lambda: _hash(skeleton), "article": lambda: _article(page), "nodes": lambda: [b[0] for b in blocks], "texts": lambda: [b[1] for b in blocks]}
        made |= {"hashes": lambda: [_hash(b[1]) for b in blocks], "sizes": lambda: [len(b[1]) for b in blocks], "links": lambda: [b[2] for b in blocks]}
        return {c: made[c]() for c in names}

    def read_all(texts: list[str]) -> Iterator[tuple[range, dict]]:
        for a in range(0, len(texts), 256):
            rows = [values(Page(t or "")) for t in texts[a : a + 256]]
            yield range(a, a + len(rows)), {c: [r[c] for r in rows] for c in names}

    return per_text(pages, columns, read_all, text="html")


def _article(page: Page) -> int:
    """A hash of the page's three longest blocks outside named regions: copies of a page count once as evidence."""
    out: list[bool] = []
    for label, p in zip(page.labels, page.parents, strict=True):
        out.append((p >= 0 and out[p]) or around(label, False))
    best = sorted(((len(t), t) for n, t, _ in page.blocks if not out[n]), reverse=True)[:3]
    return _hash("\n".join(t for _, t in best))


def induced_wrappers(kinds: DataFrame, *, fan: int = 64, most_nodes: int = 400) -> DataFrame:
    """(host, wrapper): one wrapper for each host from its different skeletons (host, kind, skeleton, n).

    Skeletons are merged in groups of about `fan`, then those wrappers in turn, until a host has one: no group grows with the host.
    """
    spark = kinds.sparkSession

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "skeleton"], ascending=[False, True])
        return pd.DataFrame({"host": [key[0]], "part": [key[1]], "wrapper": [written(induce([tree_of(s, int(n)) for s, n in zip(pdf["skeleton"], pdf["n"], strict=True)], most_nodes))]})

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        trees = sorted((read(w) for w in sorted(pdf["wrapper"])), key=lambda t: -t[1])
        return pd.DataFrame({"host": [key[0]], "part": [key[1]], "wrapper": [written(induce(trees, most_nodes))]})

    count = kinds.groupBy("host").agg(F.count("*").alias("skeletons"))
    dealt = kinds.join(count, "host").withColumn("part", F.pmod(F.xxhash64("kind"), F.ceil(F.col("skeletons") / fan)).cast("long"))
    cur = stage(dealt.select("host", "part", "skeleton", "n").groupBy("host", "part").applyInPandas(first, "host string, part long, wrapper string"), "wrappers")
    most = kinds.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // fan)
    while parts > 1:
        mark, parts = staged() - 1, -(-parts // fan)
        regrouped = cur.withColumn("part", F.expr(f"part div {fan}"))
        cur = stage(regrouped.groupBy("host", "part").applyInPandas(again, "host string, part long, wrapper string"), "wrappers")
        discard(spark, mark, keep=1)
    return cur.select("host", "wrapper")


def with_slots(kinds: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, kind, skeleton, n, slots): each skeleton aligned with its host's wrapper."""
    joined = kinds.join(wrappers, "host")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slots = [slots_of(read(w), tree_of(s, 1), s.count("\n") + 1) for w, s in zip(pdf["wrapper"], pdf["skeleton"], strict=True)]
            yield pdf.drop(columns="wrapper").assign(slots=slots)

    return joined.select("host", "kind", "skeleton", "n", "wrapper").mapInPandas(align, "host string, kind long, skeleton string, n long, slots array<int>")


def _dealt_join(rows: DataFrame, side: DataFrame, keys: list[str], salt: Column, most_broadcast: int, salts: int = 32) -> DataFrame:
    """rows left-joined with side, unique by keys: sent to all tasks if it is small, else with each key's rows dealt over salts."""
    if side.count() <= most_broadcast:
        return rows.join(F.broadcast(side), keys, "left")
    dealt = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int")).join(dealt, [*keys, "__salt"], "left").drop("__salt")


def extract_main_text(pages: DataFrame, *, constant: float = 0.9, least_pages: int = 5, most_broadcast: int = 20_000) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of pages (page_id, url, html), its blocks joined by newlines.

    Every page becomes the folded tree of its block elements. A host's wrapper aligns the trees of all its pages by simple tree matching; the
    wrapper's nodes are slots. A text that stands in one slot on `constant` of the host's different pages (at least `least_pages`) is
    template; a slot varies as far as its text isn't. `content_nodes` chooses the slots of the main text. Hosts with too few different
    pages have no template texts, and only regions' names and links tell what is beside the main text.

    A null html is empty, and a page without text has an empty one; a null url has the host ''. Repeated rows are judged alike, each row has
    one in the result, an empty table gives none, and other columns are left out. Counts are over all pages of a host;
    before any shuffle pages are reduced to counts by skeleton and by text.
    """
    spark, mark = pages.sparkSession, staged()
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    read_ = stage(parsed(rows.select("host", "html")), "parsed")
    kinds = stage(read_.groupBy("host", "kind", "skeleton").agg(F.count("*").alias("n")), "kinds")
    aligned = stage(with_slots(kinds, induced_wrappers(kinds)), "aligned")
    slots = aligned.select("host", "kind", F.posexplode("slots").alias("node", "slot")).filter("slot >= 0")
    blocks = read_.select("host", "kind", "article", F.explode(F.arrays_zip("nodes", "hashes", "sizes", "links")).alias("b"))
    each = blocks.select("host", "kind", "article", F.col("b.nodes").alias("node"), F.col("b.hashes").alias("hash"), F.col("b.sizes").alias("size"), F.col("b.links").alias("link"))
    placed = _dealt_join(each, slots, ["host", "kind", "node"], F.col("hash"), most_broadcast).filter("slot is not null")
    # pages count by what makes them different: copies of one article are one page
    once = stage(placed.groupBy("host", "slot", "hash", "article").agg(F.sum("size").alias("size"), F.sum("link").alias("link"), F.count("*").alias("n")), "placed")
    texts = once.groupBy("host", "slot", "hash").agg(F.count("*").alias("holds"), F.sum("size").alias("size"), F.sum("link").alias("link"), F.sum("n").alias("n"))
    slot_pages = once.groupBy("host", "slot").agg(F.count_distinct("article").alias("articles"))
    fixed = (F.col("articles") >= least_pages) & (F.col("holds") >= constant * F.col("articles"))
    judged = _dealt_join(texts, slot_pages, ["host", "slot"], F.col("hash"), most_broadcast).withColumn("is_fixed", fixed)
    per_slot = judged.groupBy("host", "slot").agg(
        F.sum("size").alias("chars"), F.sum("link").alias("links"), F.sum(F.when(~F.col("is_fixed"), F.col("size")).otherwise(0)).alias("varied"), F.collect_list(F.when(F.col("is_fixed"), F.col("hash"))).alias("fixed")
    )
    pages_of = kinds.groupBy("host").agg(F.sum("n").alias("pages"))
    nodes = aligned.select("host", "kind", "skeleton", F.posexplode("slots").alias("node", "slot")).join(per_slot, ["host", "slot"], "left").join(pages_of, "host")
    stat = F.struct("node", (F.col("chars") / F.col("pages")).alias("chars"), (F.col("links") / F.col("pages")).alias("links"), (F.col("varied") / F.col("chars")).alias("varied"), F.col("slot").alias("slot"), F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed"))
    known = nodes.groupBy("host", "kind").agg(F.first("skeleton").alias("skeleton"), F.sort_array(F.collect_list(stat)).alias("s")).select("host", "kind", "skeleton", *(F.col(f"s.{c}").alias(c) for c in ("chars", "links", "varied", "slot", "fixed")))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mains, fixed = [], []
            for skeleton, chars, links, varied, slot, same in zip(*(pdf[c] for c in ("skeleton", "chars", "links", "varied", "slot", "fixed")), strict=True):
                lines = [x.split(" ", 1) for x in skeleton.split("\n")]
                # a slot without text has none; a node that the wrapper doesn't hold counts as a short one
                chars, links, varied = ([d if s < 0 else 0.0 if x is None or x != x else float(x) for x, s in zip(v, slot, strict=True)] for v, d in ((chars, 100.0), (links, 0.0), (varied, 1.0)))
                main = content_nodes([x[1] for x in lines], [int(x[0]) for x in lines], chars, links, varied)
                mains.append([k for k, m in enumerate(main) if m])
                fixed.append(sorted({int(h) for k in mains[-1] for h in same[k]}))
            yield pd.DataFrame({"host": pdf["host"], "kind": pdf["kind"], "main": mains, "fixed": fixed})

    rules = stage(known.mapInPandas(decide, "host string, kind long, main array<int>, fixed array<long>"), "rules")
    whole = parsed(rows, "kind long, nodes array<int>, texts array<string>, hashes array<long>")
    found = _dealt_join(whole, rules, ["host", "kind"], F.xxhash64("page_id", "url"), most_broadcast)
    picked = F.filter(F.arrays_zip("nodes", "texts", "hashes"), lambda b: F.array_contains("main", b["nodes"]) & ~F.array_contains("fixed", b["hashes"]))
    text = F.array_join(F.transform(picked, lambda b: b["texts"]), "\n")
    out = stage(found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long")), "main_text")
    discard(spark, mark, keep=1)
    return out
