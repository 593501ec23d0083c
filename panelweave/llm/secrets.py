"""Operator 4: secret scan: patterns, and sliding-window Shannon entropy per character class over candidate strings. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. A run of one character class needs no filter afterwards, so its least length stands in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What looks random but is none of ours to report. A placeholder takes its piece between separators out of a candidate,
#: counting runs and repeated characters only themselves out of the windows; a UUID has to be all that is left.
PLACEHOLDER = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?i:example|sample|placeholder|dummy|changeme|your|lorem)[A-Za-z0-9+]*+[/_=-]*+"
FILLER = r"(?i)0123456789|abcdefghij|(.)\1{7,}"
UUID = r"(?i)^[/_=-]*[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[/_=-]*$"


@dataclass(frozen=True)
class EntropyClass:
    """A character class, and the least entropy in bits a character that some window of its strings must reach."""

    name: str
    pattern: str
    alphabet: str
    bar: float


CLASSES = (
    EntropyClass("hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    EntropyClass("alnum", r"^[A-Za-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.7),
    EntropyClass("base64", r"^[A-Za-z0-9+/_=-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.9),
)


SPANS = "cast(array() as array<struct<start:int,end:int,kind:string,value:string>>)"
#: Code points of the pieces that a text is cut into, so that reaching a place costs a piece and not the text before it.
CHUNK = 2048


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, grow, start: int = 0) -> Column:
    """For each number of an array what grow(so far, number) has come to, the number included, from `start` on.

    grow: a sum or a maximum. The array is cut into blocks of about its size's root, and arrays grow only within a block, so n numbers take n times its
    root copied references, not n times n.
    """

    def within(block: Column, first: Column) -> Column:
        more = lambda acc, x: let(grow(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))
        return F.aggregate(block, F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), more, lambda acc: acc["out"])

    def whole(ns: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(ns))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(ns), size), lambda at: F.slice(ns, at, size))
        totals = lambda bs: within(F.transform(bs, lambda b: F.aggregate(b, F.lit(start), grow)), F.lit(start))
        first = lambda ts: F.concat(F.array(F.lit(start)), F.slice(ts, 1, F.size(ts) - 1))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, first(totals(bs)), within)))

    return let(numbers, lambda ns: F.when(F.size(ns) > 0, whole(ns)).otherwise(ns))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def spans_by(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, end, kind, value) of a pattern's matches, leftmost and not overlapping, in code points.

    The pieces between matches and the matches alternate, so the running sum of their lengths gives every place. keep: a
    condition on the match's text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = lambda ms: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(ms)), ms, lambda gap, m: F.length(gap) + F.length(m))
    span = lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("value"))
    spans = F.when(text.rlike(pattern), let(found, lambda ms: F.zip_with(ms, running(steps(ms), _sum), span))).otherwise(F.expr(SPANS))
    return F.filter(spans, lambda s: keep(s["value"])) if keep else spans


def substrings(text: Column, spans: Column) -> Column:
    """The text of each of the spans (start, end): reached by chunks, so that many spans of a long text take time in its length."""
    cut = lambda c, a, b: F.substr(c, a + 1, b - a)

    def piece(chunks: Column, s: Column) -> Column:
        part = lambda k: cut(F.get(chunks, k), F.greatest(s["start"] - k * CHUNK, F.lit(0)), F.least(s["end"] - k * CHUNK, F.lit(CHUNK)))
        return F.when(s["end"] > s["start"], F.array_join(F.transform(F.sequence((s["start"] / CHUNK).cast("int"), ((s["end"] - 1) / CHUNK).cast("int")), part), "")).otherwise(F.lit(""))

    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(whole, lambda chunks: F.transform(spans, lambda s: piece(chunks, s)))).otherwise(F.expr("cast(array() as array<string>)"))


def subtract(text: Column, spans: Column, holes: Column, kind: str) -> Column:
    """The parts of disjoint spans (start, end) that no hole covers, as (start, end, kind, value) in order. Holes may overlap.

    All ends of spans and holes are laid in one order; between two neighbours a place is inside a span, a hole, both or neither, which
    running sums tell (a span counts one, a hole four).
    """
    edge = lambda xs, n: F.flatten(F.transform(xs, lambda x: F.array(F.struct(x["start"].alias("at"), F.lit(n).alias("by")), F.struct(x["end"].alias("at"), F.lit(-n).alias("by")))))

    def parts(es: Column) -> Column:
        state = running(F.transform(es, lambda e: e["by"]), _sum)
        until = F.concat(F.slice(F.transform(es, lambda e: e["at"]), 2, F.size(es)), F.array(F.element_at(es, -1)["at"]))
        between = F.zip_with(F.zip_with(es, until, lambda e, u: F.struct(e["at"].alias("start"), u.alias("end"))), state, lambda x, s: F.struct(x["start"].alias("start"), x["end"].alias("end"), s.alias("s")))
        open_ = F.filter(between, lambda x: (x["s"] == 1) & (x["end"] > x["start"]))
        return let(open_, lambda ps: F.zip_with(ps, substrings(text, ps), lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value"))))

    return F.when(F.size(spans) > 0, let(F.array_sort(F.concat(edge(spans, 1), edge(holes, 4))), parts)).otherwise(F.expr(SPANS))


def window_entropy(value: Column, alphabet: str, width: int) -> Column:
    """The highest Shannon entropy, in bits, of any window of `width` characters (of the whole string, if shorter).

    Counts and the sum of c*log2(c) move with the window: a character comes in, one goes out, nothing is counted again.
    """
    size = F.least(F.length(value), F.lit(width))
    nlogn = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    entropy = lambda total: F.log2(size.cast("double")) - total / size

    def change(counts: Column, k: Column, by: int) -> Column:
        """What the sum gains as the count of letter k changes by one."""
        return F.when(k >= 0, nlogn(F.get(counts, k) + by) - nlogn(F.get(counts, k))).otherwise(F.lit(0.0))

    def step(acc: Column, moved: Column) -> Column:
        enters, leaves = moved["enters"], moved["leaves"]
        counts = F.transform(acc["counts"], lambda c, k: F.when(k == enters, c + 1).when(k == leaves, c - 1).otherwise(c))
        total = acc["total"] + change(acc["counts"], enters, 1) + change(acc["counts"], leaves, -1)
        same = enters == leaves
        full = moved["full"]
        return F.when(same, acc).otherwise(F.struct(counts.alias("counts"), total.alias("total"), F.when(full, F.greatest(acc["best"], entropy(total))).otherwise(acc["best"]).alias("best")))

    # what comes in and goes out at each place, made once; the two letters of a place change different counts, or none
    letters = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    moved = lambda own: F.transform(own, lambda x, i: F.struct(x.alias("enters"), F.coalesce(F.when(i >= size, F.get(own, i - size)), F.lit(-1)).alias("leaves"), (i + 1 >= size).alias("full")))
    moves = F.element_at(F.transform(F.array(letters), moved), 1)
    begin = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(moves, begin, step, lambda acc: acc["best"])


def random_looking(value: Column, width: int, filler: str) -> Column:
    """Whether a string holds letters and digits, is no UUID, and some window without filler reaches its class's entropy."""
    mixed = (F.length(value) >= width) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(UUID)
    out = F.lit(False)
    for c in reversed(CLASSES):
        reaches = F.exists(F.split(value, filler, -1), lambda p: F.when(F.length(p) >= width, window_entropy(p, c.alphabet, width) >= c.bar).otherwise(F.lit(False)))
        out = F.when(value.rlike(c.pattern), reaches).otherwise(out)
    return F.when(mixed, out).otherwise(F.lit(False))


def find_secrets(docs: DataFrame, *, width: int = 20, placeholder: str = PLACEHOLDER, filler: str = FILLER) -> DataFrame:
    """(doc_id, found) for each row of docs (doc_id, text): found is an array of (start, end, kind, value) by start, then kind.

    Kinds: assign, access and hex by pattern, then entropy: what assignments and placeholders leave of a candidate string, if a
    window of `width` characters without filler is random enough for its class; of such a string the parts outside access and
    hex spans are reported. Places are code points, end exclusive. Null and empty texts have none. Rows are handled one by one:
    repeated rows repeat, an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 1)
    rows = docs.select(
        "doc_id",
        text.alias("text"),
        spans_by(text, ASSIGN, "assign", lambda m: F.length(value(m)) >= ASSIGN_LEAST).alias("a"),
        spans_by(text, ACCESS, "access").alias("b"),
        spans_by(text, HEX, "hex").alias("c"),
        spans_by(text, CANDIDATE, "entropy", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")).alias("d"),
    )
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    ordered = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s.alias("span")))), lambda x: x["span"])
    place = lambda x, by: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"))
    words = F.flatten(F.transform("d", lambda s: F.transform(spans_by(s["value"], placeholder, "entropy"), lambda p: place(p, s["start"]))))
    base = rows.select("doc_id", "text", F.concat("a", "b", "c").alias("base"), "d", F.transform("a", lambda s: place(s, F.lit(0))).alias("assigned"))
    left = subtract(F.col("text"), F.col("d"), F.concat(words, F.col("assigned")), "entropy")
    # nothing sticks out of a string that is all one access or hex span, so its entropy needn't be known
    looks = lambda s: F.when(s["value"].rlike(f"^(?:{ACCESS}|{HEX})$"), F.lit(False)).otherwise(random_looking(s["value"], width, filler))
    random = base.withColumn("d", F.filter(left, looks))
    more = subtract(F.col("text"), F.col("d"), F.col("base"), "entropy")
    return random.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat("base", more)).alias("found"))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, *, mark: str = "[SECRET]", **find) -> DataFrame:
    """docs with every found span of the text replaced by `mark` (overlapping spans by one); all columns stay, n_chars follows where there is one.

    Nulls stay null; texts without secrets stay as they are.
    """
    found = find_secrets(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc_id"), F.col("text")), **find).withColumnRenamed("doc_id", "__row")
    row = F.col("__row")
    text = row["text"]
    ends = running(F.transform("found", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    before = lambda es: F.concat(F.array(F.lit(0)), es)
    # what stands before each span that none before it reaches into, and behind the last
    gaps = lambda es: F.filter(F.zip_with("found", F.slice(before(es), 1, F.size("found")), lambda s, e: F.struct(e.alias("start"), s["start"].alias("end"))), lambda g: g["start"] <= g["end"])
    tail = lambda es: F.array(F.struct(F.element_at(es, -1).alias("start"), F.length(text).alias("end")))
    cut = let(ends, lambda es: F.array_join(substrings(text, F.concat(gaps(es), tail(es))), mark))
    clean = F.when(F.size("found") > 0, cut).otherwise(text)
    return found.select(*[clean.alias(c) if c == "text" else F.coalesce(F.length(clean).cast("long"), row[c].cast("long")).alias(c) if c == "n_chars" else row[c].alias(c) for c in docs.columns])
