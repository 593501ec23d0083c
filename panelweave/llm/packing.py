"""Operator 10: packing of tokenised documents into sequences by vector best-fit."""

from __future__ import annotations

import math
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import per_text, stage, with_null_safe_text

#: Words, of at most LONGEST characters, that a worker remembers beside those of the texts just seen.
REMEMBERED = 100_000
LONGEST = 100
#: Characters of the texts whose words are looked for at once.
TOGETHER = 1_000_000
_BASIC = [chr(i) for i in range(0x10000)]


def _class(chars: list[str]) -> str:
    """The characters as ranges: a class spelled out is one look into a table for each character, one made of categories several."""
    codes = np.array([ord(c) for c in chars])
    ends = np.flatnonzero(np.diff(codes) > 1)
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(codes[np.r_[0, ends + 1]], codes[np.r_[ends, -1]], strict=True)) + "]"


#: The tokenizer file's pattern of words: contractions, runs of letters, single digits, runs of anything else but blanks.
WORDS = re.compile(
    _class([c for c in _BASIC if unicodedata.category(c)[0] == "L"]) + r"++|'(?:s|t|re|ve|m|ll|d)|\d|" + _class([c for c in _BASIC if not c.isalnum() and not c.isspace()]) + "++"
)
#: Numerals that count as letters to the pattern above, characters whose lower case depends on others or grows, blanks that not
#: all count as such, characters younger than Unicode 3.2, whose kind depends on how new a table is, and everything beyond the
#: basic plane.
_DOUBTFUL = "".join(c for c in _BASIC if unicodedata.category(c) in ("No", "Nl") or unicodedata.ucd_3_2_0.category(c) in ("Cn", "Cs"))
ODD = re.compile("[\u03a3\u0130\x1c-\x1f\x85\u180e\u200b\U00010000-\U0010ffff" + _DOUBTFUL + "]")
del _BASIC  # 5 MB in each worker


def _plain(text: str) -> bool:
    """Whether WORDS cuts the text as the tokenizer would."""
    return "<|" not in text and not ODD.search(text) and (text.isascii() or unicodedata.is_normalized("NFC", text))


END = struct.pack("<I", 1)
ID_OF = attrgetter("id")
MEMORY = pa.schema({"word": pa.large_string(), "ids": pa.large_binary()})


def _byte_signs() -> dict[int, int]:
    """The tokenizer file's sign for each byte: printable ones of Latin-1 stand for themselves, the others for those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in own} | {b: 0x100 + k for k, b in enumerate(sorted(set(range(0x100)) - set(own)))}


BYTE_SIGNS = _byte_signs()


@dataclass(frozen=True)
class BinLimits:
    """A sequence's capacities. attention: the sum of squared lengths, what attention within documents costs."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05)


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases a text, cuts it by WORDS and encodes each piece on its own, so a text's ids are those of its
    pieces one after another, and pieces seen before are looked up. Unknown ones go to the tokenizer's model one by one, as the
    signs of their bytes: nothing is left to normalise or to cut. Texts on which lower-casing or blanks could differ, or which
    spell a special token, go to the tokenizer whole. Two Arrow tables of pieces are kept, as they are smaller than dicts: `new`, what
    the last texts used, and `old`, the REMEMBERED ones used last before, so memory is bounded and common words stay.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new = self.old = MEMORY.empty_table()

    def _encode(self, text: str) -> bytes:
        """A whole text's ids; the fast way leaves out the places of tokens in the text, which aren't needed."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _ids(self, word: str) -> bytes:
        """The ids of a piece that WORDS cut from a lower-case text."""
        signs = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("I", map(ID_OF, self.model.tokenize(signs))).tobytes()

    def _all(self, runs: pa.Array) -> list[bytes]:
        """The ids of different lower-case runs without blanks. Letters alone are one piece; pieces are remembered, runs of several aren't.

        The memory is searched, and brought into the order of last use, once for all runs; only unknown ones become strings.
        """
        memory = pa.concat_tables([self.old, self.new]).combine_chunks()
        words, ids = memory["word"], memory["ids"]
        known = pc.index_in(runs, value_set=words)
        unknown = runs.filter(known.is_null()).to_numpy(zero_copy_only=False).tolist()
        parts = [(run,) if run.isalpha() else WORDS.findall(run) for run in unknown]
        pieces = pa.array(list(set().union(*parts)), pa.large_string())
        of_several = pc.index_in(pieces, value_set=words)
        found = dict(zip(pieces.to_numpy(zero_copy_only=False).tolist(), ids.take(of_several).to_numpy().tolist(), strict=True))
        fresh = {p: self._ids(p) for p, i in found.items() if i is None}
        found |= fresh
        used = np.zeros(memory.num_rows, bool)
        for at in (known, of_several):
            used[at.drop_null().to_numpy()] = True
        short = [p for p in fresh if len(p) <= LONGEST]
        self.new = pa.concat_tables([memory.filter(pa.array(used)), pa.table([short, [fresh[p] for p in short]], schema=MEMORY)])
        rest = memory.filter(pa.array(~used))
        self.old = rest.slice(max(0, rest.num_rows - REMEMBERED))
        rest_ids = iter([b"".join(map(found.__getitem__, p)) for p in parts])
        return [next(rest_ids) if i is None else i for i in ids.take(known).to_numpy().tolist()]

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids. No piece holds a blank, so texts are cut at blanks first, and each different run between is looked for once."""
        plain = [_plain(t) for t in texts]
        cut = pc.utf8_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        ends, runs = cut.offsets.to_pylist(), cut.values.dictionary_encode()
        del cut
        which, ids = runs.indices.to_numpy(), self._all(runs.dictionary)
        for k, t in enumerate(texts):
            yield b"".join(map(ids.__getitem__, which[ends[k] : ends[k + 1]].tolist())) if plain[k] else self._encode(t)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids; words are looked for, and tokenised, for TOGETHER characters at once, or one text that is longer."""
        group = np.cumsum([len(t) for t in texts]) // TOGETHER
        ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip([0, *ends], ends, strict=False):
            yield from self._some(texts[a:b])


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer with its memory; it outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, most: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and then id 1, cut into pieces of `most` tokens only where longer.

    A null text is an empty one, whose only token is id 1. Ids keep their values, nulls too. Repeated rows give repeated pieces.
    """

    def cut(texts: list[str]) -> Iterator[tuple[list[int], dict]]:
        rows: list[tuple[int, int, int, int, int]] = []
        for k, data in enumerate(word_ids(tokenizer_path)(texts)):
            data += END
            rows += [(k, i // (4 * most), i // 4, len(part := data[i : i + 4 * most]) // 4, zlib.crc32(part)) for i in range(0, len(data), 4 * most)]
        own, *values = zip(*rows, strict=True) if rows else [[]] * 5
        yield own, dict(zip(("piece", "start", "length", "ids_crc32"), values, strict=True))

    return per_text(with_null_safe_text(docs), "piece int, start long, length long, ids_crc32 long", cut)


def best_fit(sizes: np.ndarray, limits: BinLimits) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of pieces, largest first. A piece goes where, of the bins that can take it under every limit, the weighted norm of what is left after it is least; a new bin opens where none can."""
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weight = np.array(limits.weights) / caps**2
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free = np.zeros((3, 256))
    name = np.zeros(256, np.int64)
    opened = live = 0
    least = int(sizes.min()) if len(sizes) else 0
    for i in order.tolist():
        need = np.array([sizes[i], 1, float(sizes[i]) ** 2])
        k = -1
        if live:
            rest = free[:, :live] - need[:, None]
            cost = np.where((rest >= 0).all(0), weight @ (rest * rest), np.inf)
            k = int(cost.argmin())
            if cost[k] == np.inf:
                k = -1
        if k < 0:
            if live == free.shape[1]:
                free, name = np.hstack([free, np.zeros_like(free)]), np.r_[name, np.zeros_like(name)]
            k, live = live, live + 1
            free[:, k], name[k] = caps, opened
            opened += 1
        where[i], offset[i] = name[k], int(caps[0] - free[0, k])
        free[:, k] -= need
        if free[0, k] < least or free[1, k] < 1:  # nothing fits any more: the last open bin takes its place
            live -= 1
            free[:, k], name[k] = free[:, live], name[live]
    return where, offset


def _pack_groups(pieces: DataFrame, groups: int, limits: BinLimits, base: int) -> DataFrame:
    """Pack pieces (pid, length, ...) in groups dealt by hash, each in one task: (pid, sequence_id, offset, filled)."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", kind="stable")
        sizes = pdf["length"].to_numpy()
        where, offset = best_fit(sizes, limits)
        filled = np.bincount(where, sizes)
        return pd.DataFrame({"pid": pdf["pid"].to_numpy(), "sequence_id": (np.int64(key[0]) << 24) + where + base, "offset": offset, "filled": filled[where].astype(np.int64)})

    dealt = pieces.select("pid", "length", F.pmod(F.xxhash64(F.lit(base), "pid"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(pack, "pid long, sequence_id long, offset long, filled long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, limits: BinLimits = BinLimits(), group_rows: int = 12_000, refill: float = 0.97) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs (doc_id, text).

    Texts are cut only where longer than a sequence, or than what the attention limit lets a piece have. Pieces of a sequence's
    length are sequences of their own. The others are dealt by hash to groups of about group_rows, packed
    largest first by best_fit; what lies in sequences filled below `refill` is dealt and packed a second time, in fewer
    groups. Each sequence keeps every limit, and its pieces lie gapless from offset 0. Null or empty texts take one token;
    repeated rows are packed like others; an empty table gives an empty result.
    """
    if limits.documents < 1 or limits.tokens < 1 or limits.attention < 1:
        raise ValueError("a piece of one token must fit the limits")
    most = min(limits.tokens, math.isqrt(limits.attention))
    cut = token_pieces(docs, tokenizer_path, most=most)
    pieces = stage(cut.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == limits.tokens).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < limits.tokens)
    n = rest.count()
    first = stage(_pack_groups(rest, max(1, -(-n // group_rows)), limits, 0), "packed")
    low = first.filter(F.col("filled") < refill * limits.tokens).select("pid")
    m = low.count()
    groups = max(1, -(-m // group_rows))
    if 0 < m and n > group_rows:
        again = _pack_groups(rest.join(low, "pid", "left_semi"), groups, limits, 1 << 60)
        placed = first.filter(F.col("filled") >= refill * limits.tokens).drop("filled").unionByName(again.drop("filled"))
    else:
        placed = first.drop("filled")
    return pieces.join(whole.unionByName(placed), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
