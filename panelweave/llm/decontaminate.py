"""Operator 7: benchmark decontamination by template canonicalisation and a hash join of template windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from panelweave.llm.common import per_text, stage
from panelweave.llm.urls import without_listed

#: Scripts written without blanks, whose characters are tokens of their own: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[.!?:\n]+|\d+(?:[.,]\d+)*|[^\W\d_{UNSPACED}]+|[{UNSPACED}]|[%$€£]")
#: Unit words and signs that count as units next to a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg t oz lb ml cl l s sec ms min h hr hrs kmh mph hz khz mhz w kw kwh v a j kj kcal pa bar k c f usd eur gbp % $ € £ percent dollar dollars euro euros pound pounds cent cents metre metres meter meters kilometre kilometres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years".split())
CAPITAL, NUMBER, MARK, UNIT = 1, 2, 4, 8
NUM_ID, NAME_ID, UNIT_ID = (xxh64_intdigest(x) & ~15 for x in ("<num>", "<name>", "<unit>"))
REMEMBERED = 100_000


class _Tokens(dict):
    """Token -> 64-bit hash of its lower-case form, the low four bits holding its kind."""

    def __missing__(self, w: str) -> int:
        low = w.lower()
        kind = MARK if w[0] in ".!?:\n" else NUMBER if w[0].isdecimal() else (CAPITAL if len(w) > 1 and w[0].isupper() and w[1:].islower() else 0) | (UNIT if low in UNITS else 0)
        self[w] = value = (xxh64_intdigest(low) & ~15) | kind
        return value


def canonical_tokens(text: str, known: _Tokens) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes of a text's template tokens, which of them are slots, and all tokens' texts.

    Slots: numbers; unit words next to a number; names, which are capitalised words that don't open a sentence. Sentence marks
    only separate and are left out.
    """
    words = TOKEN.findall(text)
    if len(known) > REMEMBERED:
        known.clear()
    raw = np.array([known[w] for w in words], np.uint64)
    if not len(raw):
        return raw, np.zeros(0, bool), words
    kind = (raw & np.uint64(15)).astype(np.uint8)
    opens = np.r_[True, (kind[:-1] & MARK) > 0]
    real = (kind & MARK) == 0
    raw, kind, opens = raw[real], kind[real], opens[real]
    number = (kind & NUMBER) > 0
    beside = np.r_[False, number[:-1]] | np.r_[number[1:], False]
    unit = ((kind & UNIT) > 0) & beside if len(raw) else number
    name = ((kind & CAPITAL) > 0) & ~opens & ~unit
    h = np.where(number, np.uint64(NUM_ID), np.where(unit, np.uint64(UNIT_ID), np.where(name, np.uint64(NAME_ID), raw & ~np.uint64(15))))
    return h, number | unit | name, words


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` template tokens."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return out ^ (out >> np.uint64(32))


def _template(size: int, hashes: list[int], slots: list[list[str]], fixed: list[int]) -> str:
    """A digest of an item's windows and of what its slots have to fulfil: which of them are equal, and which are fixed words."""
    order: dict[str, int] = {}
    shape = [[order.setdefault(x, len(order)) for x in own] for own in slots]
    words = [[x.lower() for x in own[:n]] for own, n in zip(slots, fixed, strict=True)]
    return hashlib.sha256(repr((size, hashes, shape, words)).encode()).hexdigest()


def _item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, template, windows): each item's template windows (pos, size, hash, slots, fixed, n_tokens); an item below `width` tokens has one of its own length.

    A capitalised first token opens the item, but may stand inside a document's sentence, where it is a name: the first window
    comes in both forms. fixed: how many leading slots a document must repeat word for word, so that short templates don't match
    everything: the first word of a short item that is taken as a name, and all slots of a short item of slots only. Items of one
    template are found in the same documents.
    """

    def cut(texts: list[str]) -> Iterator[tuple[list[int], dict]]:
        known = _Tokens()
        rows, templates, windows = [], [], []
        for k, text in enumerate(texts):
            h, slot, words = canonical_tokens(text, known)
            size = min(width, len(h))
            if not size:
                continue
            plain = [w for w in words if w[0] not in ".!?:\n"]
            forms = [(h, slot, len(h) - size + 1)]
            if not slot[0] and known[plain[0]] & CAPITAL:
                named, marked = h.copy(), slot.copy()
                named[0], marked[0] = NAME_ID, True
                forms.append((named, marked, 1))
            own = []
            for f, (hashed, slots, n) in enumerate(forms):
                for p, x in enumerate(window_hashes(hashed, size)[:n].tolist()):
                    held = [plain[i] for i in range(p, p + size) if slots[i]]
                    fixed = 0 if size == width else size if len(held) == size else f
                    own.append({"pos": p, "size": size, "hash": int(np.uint64(x).astype(np.int64)), "slots": held, "fixed": fixed, "n_tokens": len(h)})
            rows.append(k)
            windows.append(own)
            templates.append(_template(size, [w["hash"] for w in own], [w["slots"] for w in own], [w["fixed"] for w in own]))
        yield rows, {"template": templates, "windows": windows}

    rows = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return per_text(rows, "template string, windows array<struct<pos:int,size:int,hash:bigint,slots:array<string>,fixed:int,n_tokens:int>>", cut)


def _rare(windows: DataFrame, least_share: float) -> DataFrame:
    """windows (template, pos, size, hash, n_tokens, ...) with the flag `rare`.

    Of each template those windows that most templates share are set aside, as far as they cover less than least_share of its
    tokens. A document that holds least_share of the template holds another of its windows too, so only these have to be looked
    for, and a passage that many items share leads to none of them.
    """
    often = windows.groupBy("size", "hash").agg(F.count_distinct("template").alias("often"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="part").sort_values(["template", "often", "pos", "hash"], ascending=[True, False, True, True], kind="stable")
        rare, template = np.ones(len(pdf), bool), None
        for i, (t, pos, size, n, tokens) in enumerate(zip(pdf["template"], pdf["pos"], pdf["size"], pdf["often"], pdf["n_tokens"], strict=True)):
            if t != template:
                template, covered = t, set()
            if n > 1 and covered is not None and len(wider := covered.union(range(pos, pos + size))) < least_share * tokens:
                covered, rare[i] = wider, False
            else:
                covered = None  # from here on all windows are looked for
        return pdf.assign(rare=rare)

    joined = windows.join(often, ["size", "hash"])
    dealt = joined.withColumn("part", F.pmod(F.xxhash64("template"), F.lit(max(1, windows.count() // 50_000))))
    return dealt.groupBy("part").applyInPandas(choose, T.StructType([*joined.schema, T.StructField("rare", T.BooleanType())]))


#: Bits of a window's hash that the sieve looks at: 2**SIEVE_BITS flags, eight to a byte, 16 MB whatever the benchmark's size.
SIEVE_BITS = 27


def _sieve(windows: DataFrame) -> np.ndarray:
    """A flag for each leading SIEVE_BITS bits that some benchmark window has; or-ed together in Spark, eight flags a row."""
    head = F.shiftrightunsigned("hash", 64 - SIEVE_BITS)
    bits = windows.select(F.shiftright(head, 3).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), F.pmod(head, F.lit(8)).cast("int")).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for byte, value in bits.toLocalIterator():
        out[byte] = value
    return out


def _hits(frame: DataFrame, sizes: list[int], sieve: np.ndarray) -> DataFrame:
    """(doc_id, pos, size, hash, slots): template windows of the given sizes in each row's whole text, as far as the sieve passes them."""

    known = _Tokens()  # each task's own, for all its texts

    def cut(texts: list[str]) -> Iterator[tuple[list[int], dict]]:
        rows: list[tuple] = []
        for k, text in enumerate(texts):
            h, slot, words = canonical_tokens(text, known)
            plain = None
            for size in sizes:
                hashes = window_hashes(h, size)
                head = hashes >> np.uint64(64 - SIEVE_BITS)
                at = np.flatnonzero((sieve[head >> np.uint64(3)] >> (head & np.uint64(7)).astype(np.uint8)) & 1)
                if len(at):
                    plain = plain or [w for w in words if w[0] not in ".!?:\n"]
                    rows += [(k, p, size, int(hashes[p].astype(np.int64)), [plain[i] for i in range(p, p + size) if slot[i]]) for p in at.tolist()]
        own, *values = zip(*rows, strict=True) if rows else [[]] * 5
        yield own, dict(zip(("pos", "size", "hash", "slots"), values, strict=True))

    rows = frame.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return per_text(rows, "pos int, size int, hash long, slots array<string>", cut)


def leak_matches(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, least_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share): texts that hold at least `least_share` of a benchmark item's template tokens in matched windows.

    Windows of `width` template tokens, and of the length of each shorter item, are joined by length and hash. Windows on one
    diagonal (document place minus item place) count only if the slots agree: wherever the item repeats a number, name or unit,
    the document repeats its own. Items of one template are looked for once; a document meets a template only by windows that
    aren't set aside as common ones, and only then all of its windows are compared.
    """
    items = stage(_item_windows(benchmark, width), "items")
    windows = items.dropDuplicates(["template"]).select("template", F.explode("windows").alias("w")).select("template", "w.*").distinct()
    windows = stage(_rare(windows, least_share), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    hits = stage(_hits(docs, sizes, _sieve(windows)), "hits")
    met = hits.select("doc_id", "size", "hash").distinct().join(windows.filter("rare").select("template", "size", "hash").distinct(), ["size", "hash"]).select("doc_id", "template").distinct()
    one = windows.select("template", F.col("pos").alias("item_pos"), "size", "hash", F.col("slots").alias("item_slots"), "fixed", F.col("n_tokens").alias("item_tokens"))
    low = lambda c: F.transform(F.slice(c, F.lit(1), F.col("fixed")), F.lower)
    pairs = met.join(one, "template").join(hits, ["doc_id", "size", "hash"]).filter((F.size("slots") == F.size("item_slots")) & (low("slots") == low("item_slots")))
    runs = pairs.groupBy("doc_id", "template", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_set(F.struct("item_pos", "size")).alias("at"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("slots"), F.max("item_tokens").alias("item_tokens")
    )
    agree = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item_slots"])))
    spread = F.flatten(F.transform("at", lambda p: F.sequence(p["item_pos"], p["item_pos"] + p["size"] - 1)))
    whole = runs.filter(agree).select("doc_id", "template", "item_tokens", F.explode(F.array_distinct(spread)).alias("token"))
    share = whole.groupBy("doc_id", "template").agg((F.count_distinct("token") / F.max("item_tokens")).alias("share")).filter(F.col("share") >= least_share)
    return share.join(items.select("item_id", "template"), "template").select("doc_id", "item_id", "share")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **match) -> DataFrame:
    """(doc_id, contaminated, n_items, items, share) for each row of docs (doc_id, text): items is the sorted list of leaked item ids, share the greatest.

    Null and empty texts, and null ids, are never contaminated; repeated ids count as one document; an empty table or an empty
    benchmark leaves nothing contaminated.
    """
    found = leak_matches(docs, benchmark, **match).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("share"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    items = F.coalesce("items", F.expr("cast(array() as array<long>)"))
    return out.select("doc_id", F.col("items").isNotNull().cast("int").alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **match) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay. Rows with a null id stay, and all rows of a leaking id go."""
    return without_listed(docs, leak_matches(docs, benchmark, **match).select("doc_id"), "doc_id")
