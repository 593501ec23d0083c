"""Operator 3: licence scan: Dice coefficient over word bigrams between a text's lines and licence templates. DataFrame functions only."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common licence notices as their publishers word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bigrams_of(text: str) -> list[str]:
    """A template's distinct bigrams, normalised as `_words` does it."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _with(value: Column, use) -> Column:
    """use(value), with the value made once: it becomes a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(line: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one blank, split into words."""
    return F.filter(F.split(F.regexp_replace(F.lower(line), r"[^a-z0-9]+", " "), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Distinct neighbouring words, joined by a blank; none of fewer than two words."""
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.expr("cast(array() as array<string>)"))


def _may_hold(text: Column, entries: dict[str, list[str]], low: float) -> Column:
    """Whether a text may hold a match; false only where it can't.

    A match holds ceil(low * size) of its template's bigrams, so it holds one of any size - ceil(low * size) + 1 of them. Of each
    template those with the longest words are taken, and a text that holds none of these words (of bigrams without a long
    word: not the bigram) is out. Then, with its marks turned to blanks, it has to hold enough bigrams of one template.
    """
    words, pairs = set(), set()
    for g in entries.values():
        for b in sorted(g, key=lambda b: (-max(map(len, b.split())), b))[: len(g) - math.ceil(len(g) * low - 1e-9) + 1]:
            longer = max(b.split(), key=len)
            if len(longer) > 5:
                words.add(longer)
            else:
                pairs.add("[^a-z0-9]+".join(b.split()))
    needles = sorted(w for w in words if not any(v != w and v in w for v in words))
    lower = F.lower(text)
    tests = lambda t: [*(F.contains(t, F.lit(w)) for w in needles), *([t.rlike("|".join(sorted(pairs)))] if pairs else [])]
    some = F.exists(F.array(lower), lambda t: functools.reduce(lambda a, b: a | b, tests(t)))
    held = lambda t, g: sum((F.contains(t, F.lit(b)).cast("int") for b in g), F.lit(0)) >= len(g) * low - 1e-9
    enough = F.exists(F.array(F.regexp_replace(lower, r"[^a-z0-9]+", " ")), lambda t: functools.reduce(lambda a, b: a | b, (held(t, g) for g in entries.values())))
    return F.when(some, enough).otherwise(F.lit(False))


def scan_licences(docs: DataFrame, *, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_matches, licence, dice, matches) for each row of docs: its lines, and runs of lines, that reach `threshold` with a template.

    A line (split at line ends) or run is compared only with templates whose bigram count lies between t/(2-t) and (2-t)/t times
    its own, since no other can reach the threshold t. Each line or run counts for its best template (ties: the first by name).
    Runs join neighbouring lines; of lines and runs that overlap the best counts (ties: the earliest, then the shortest; a
    run holds at most so many worded lines as the largest size bound has bigrams, and two).
    matches: line:licence, comma-joined in line order, lines from 0, a run by its first line; licence and
    dice: the best match (ties: earliest line), else null. Null and empty texts have no matches. Rows are handled one by one:
    repeated rows repeat, an empty table gives an empty result.
    """
    own = templates or TEMPLATES
    entries = {k: g for k, v in sorted(own.items()) if (g := bigrams_of(v))}
    names, low, high = list(entries), threshold / (2 - threshold), (2 - threshold) / threshold
    longest = int(max(map(len, entries.values())) * high) + 2
    known = F.array(*[F.lit(b) for b in sorted({b for g in entries.values() for b in g})])
    table = F.array(*[F.struct(F.lit(-i).alias("rank"), F.lit(len(g)).alias("size"), F.array(*map(F.lit, g)).alias("grams")) for i, g in enumerate(entries.values())])

    def best(grams: Column) -> Column:
        """(dice, rank) of the template that is most like the bigrams; only templates within the size bounds are compared."""
        n = F.size(grams)
        like = lambda t: F.when((n >= t["size"] * low) & (n <= t["size"] * high), 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["size"])).otherwise(F.lit(0.0))
        return F.array_max(F.transform(table, lambda t: F.struct(like(t).alias("dice"), t["rank"].alias("rank"))))

    def judged(words: Column) -> Column:
        return _with(_bigrams(words), best)

    def run(part: Column) -> Column:
        joined = judged(F.flatten(F.transform(part, lambda x: x["words"])))
        return F.struct(F.element_at(part, 1)["line"].alias("line"), F.element_at(part, -1)["line"].alias("end"), joined.alias("best"))

    kind = "array<struct<line:int,end:int,best:struct<dice:double,rank:int>>>"
    none = F.expr(f"cast(array() as {kind})")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.when(_may_hold(text, entries, low), F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), _words(x).alias("words")))).alias("lines"))
    rows = rows.withColumn("lines", F.filter("lines", lambda x: F.size(x["words"]) > 0))
    rows = rows.withColumn("single", F.filter(F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["line"].alias("end"), judged(x["words"]).alias("best"))), lambda x: x["best"]["dice"] >= threshold))
    # The best run starts in a line from which a template's bigram goes on
    last = F.size("lines")
    joint = lambda i: F.concat(F.element_at("lines", i)["words"], F.element_at("lines", i + 1)["words"])
    opens = F.filter(F.sequence(F.lit(1), last - 1), lambda i: F.arrays_overlap(_bigrams(joint(i)), known))
    from_ = lambda i: F.filter(F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), last - i + 1)), lambda k: _with(F.slice("lines", i, k), run)), lambda r: r["best"]["dice"] >= threshold)
    rows = rows.withColumn("runs", F.when(last > 1, F.flatten(F.transform(opens, from_))).otherwise(none))
    ranked = F.array_sort(F.transform(F.concat("single", "runs"), lambda r: F.struct((-r["best"]["dice"]).alias("cost"), r["line"].alias("line"), r["end"].alias("end"), r.alias("run"))))
    kept = F.aggregate(F.transform(ranked, lambda x: x["run"]), none, lambda acc, r: F.when(F.exists(acc, lambda s: (s["line"] <= r["end"]) & (r["line"] <= s["end"])), acc).otherwise(F.concat(acc, F.array(r))))
    rows = rows.select("doc_id", F.when(F.size("runs") > 0, F.array_sort(kept)).otherwise(F.coalesce("single", none)).alias("hits"))
    top = F.array_max(F.transform("hits", lambda x: F.struct(x["best"]["dice"].alias("dice"), (-x["line"]).alias("line"), x["best"]["rank"].alias("rank"))))
    name = lambda rank: F.get(F.array(*map(F.lit, names)), -rank)
    rows = rows.withColumn("top", top)
    return rows.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_matches"),
        name(F.col("top")["rank"]).alias("licence"),
        F.round(F.col("top")["dice"], 6).alias("dice"),
        F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["line"].cast("string"), name(x["best"]["rank"]))), ",").alias("matches"),
    )
