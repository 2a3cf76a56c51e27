"""License scans: passages of text against licence notices and texts by the Dice coefficient of their word bigrams.

A text is normalised to lower-case words, line breaks as spaces, and its bigrams are hashed. A set that reaches the
threshold holds at least threshold / (2 - threshold) of the template's bigrams, so only windows of the template's
size, and lines, with so many hits are scored; only the stretches of text that hold them are shuffled. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

THRESHOLD = 0.8

#: Notices as they are commonly written, by licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *[(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))],  # whole texts
]


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Hashes of the bigrams in order; none for less than two words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<long>"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, line, license, dice): the passages that reach the threshold with a template.

    Passages are windows of as many words as the template has, from any of its bigrams on (shorter at the end of the
    text), and whole lines. Of passages that overlap, the one that shares most bigrams stays, then the one with the
    higher coefficient, the first licence by name, and the first place; a line with notices apart has a row for each.
    line is that of the first word and counts from 0. A template of one word is found as a line of that word. Null
    and empty texts have no passages. Repeated rows are reported each. A null id is reported as null. Other columns
    are ignored. An empty table gives an empty one.
    """
    ratio = threshold / (2 - threshold)  # dice <= 2 * shared / (shared + template's)
    given = sorted(templates or TEMPLATES, key=lambda x: x[0])
    made = docs.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(given)], "rank int, license string, text string")
    made = made.select("rank", "license", _words(F.col("text")).alias("words")).select("rank", "license", "words", _bigrams(F.col("words")).alias("grams")).orderBy("rank").collect()
    notices = [(r.rank, r.license, len(r.grams), list(dict.fromkeys(r.grams))) for r in made if r.grams]
    single: dict[str, str] = {}
    for r in made:
        if len(r.words) == 1:
            single.setdefault(r.words[0], r.license)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _passages(plain, notices, threshold, ratio)
    if single:
        lines = plain.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
        name = F.try_element_at(F.create_map(*[F.lit(x) for pair in single.items() for x in pair]), normalised(F.col("raw")))
        out = out.union(lines.select("doc_id", "line", name.alias("license"), F.lit(1.0).alias("dice")).where("license is not null"))
    return out


def _passages(plain: DataFrame, notices: list[tuple[int, str, int, list[int]]], threshold: float, ratio: float) -> DataFrame:
    """Rows of scan() for templates with bigrams (rank, name, bigrams, different bigrams), in time in proportion to the texts.

    A place counts as a different bigram in the windows that begin after the same bigram's last place, so the numbers of different and
    of shared bigrams of all windows are running sums over the places where such stretches begin and end.
    """
    if not notices:
        return plain.sparkSession.createDataFrame([], "doc_id long, line int, license string, dice double")
    held = materialize(_stretches(plain, notices, ratio), "stretches")
    own = lambda values: F.get(F.array(*map(F.lit, values)), F.col("t"))
    key = ["id", "doc_id", "t", "a"]
    # a stretch moves as one row; what follows stays where it is
    rows = held.repartition("id", "t", "a").select(*key, "size", F.posexplode(F.arrays_zip("grams", "hits", F.slice("lines", 1, F.size("grams")).alias("line"), F.slice("lines", 2, F.size("grams")).alias("next"))).alias("k", "x"))
    rows = rows.select(*key, "size", (F.col("a") + F.col("k")).alias("p"), F.col("x.grams").alias("gram"), F.col("x.hits").alias("hit"), F.col("x.line").alias("line"), (F.col("x.line") == F.col("x.next")).alias("same"))
    before = F.lag("p").over(Window.partitionBy("id", "t", "a", "gram").orderBy("p"))
    n = own([n for *_, n, _ in notices])
    begin = F.greatest(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("p") - n + 1)
    event = lambda s, d, start, line: F.struct(s.alias("s"), F.lit(d).alias("d"), (F.col("hit") * d).alias("h"), start.alias("start"), line.alias("line"))
    none, no = F.lit(None).cast("int"), F.lit(0)
    events = F.explode(F.array(event(begin, 1, no, none), event(F.col("p") + 1, -1, no, none), event(F.col("p"), 0, F.col("hit"), F.col("line"))))
    events = rows.withColumn("before", before).select(*key, "size", events.alias("e")).select(*key, "size", "e.*")
    upto = Window.partitionBy("id", "t", "a").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    windows = events.select(*key, "s", "line", "start", F.least(F.col("s") + n, F.col("size")).alias("e"), F.sum("d").over(upto).alias("different"), F.sum("h").over(upto).alias("shared")).where("start = 1").drop("start")
    lines = rows.where("same").groupBy(*key, "line").agg(F.min("p").alias("s"), (F.max("p") + 1).alias("e"), F.count_distinct("gram").alias("different"), F.count_distinct(F.when(F.col("hit") == 1, F.col("gram"))).alias("shared"))
    dice = F.col("shared") * 2.0 / (F.col("different") + own([len(grams) for *_, grams in notices]))
    found = windows.unionByName(lines).withColumn("dice", dice).where(F.col("dice") >= threshold)
    rank, name = own([rank for rank, *_ in notices]), own([name for _, name, *_ in notices])
    found = found.select("id", "doc_id", F.struct((-F.col("shared")).alias("fewer"), (-F.col("dice")).alias("less"), rank.alias("rank"), "s", "e", name.alias("license"), "line").alias("x"))
    each = found.groupBy("id", "doc_id").agg(F.array_sort(F.collect_set("x")).alias("found"))  # of one text
    empty = F.filter("found", lambda x: F.lit(False))
    apart = F.aggregate("found", empty, lambda kept, x: F.when(F.exists(kept, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])), kept).otherwise(F.concat(kept, F.array(x))))
    return each.select("doc_id", F.explode(apart).alias("x")).select("doc_id", F.col("x.line").alias("line"), F.col("x.license").alias("license"), (-F.col("x.less")).alias("dice"))


def _stretches(plain: DataFrame, notices: list[tuple[int, str, int, list[int]]], ratio: float) -> DataFrame:
    """id, doc_id, t, a, size, grams, hits, lines: the parts of texts that hold windows or lines with enough bigrams of a template.

    t is the template's number, a the first bigram's place, size the text's number of bigrams; hits are 1 for the template's bigrams; lines has
    one entry more, for the last word. All within a row, by functions of arrays.
    """
    need = [max(1, math.ceil(ratio * len(grams) - 1e-9)) for *_, grams in notices]
    rows = plain.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", _words(F.col("text")).alias("words")).select("id", "doc_id", "text", _bigrams(F.col("words")).alias("g"))
    g = F.col("g")
    # a hash table as one literal: long lists of literals take long to plan
    among: dict[int, list[int]] = {}
    for i, (*_, grams) in enumerate(notices):
        for gram in grams:
            among.setdefault(gram, []).append(i)
    cells: list[list[dict]] = [[] for _ in range(4 * len(among))]
    for gram, which in among.items():
        cells[gram % len(cells)].append({"g": gram, "t": which})
    table = F.from_json(F.lit(json.dumps(cells)), "array<array<struct<g: long, t: array<int>>>>")
    cell = lambda gram: F.get(table, F.pmod(gram, F.lit(len(cells))).cast("int"))
    once = lambda kept, made, name: rows.select(*kept, F.explode(F.array(made)).alias(name))  # noqa: E731  (an explode keeps it from being made again in each later condition)
    known = F.filter(g, lambda gram: F.exists(cell(gram), lambda e: e["g"] == gram))
    rows = once(["id", "doc_id", "text", "g"], known, "known").where(F.size("known") >= min(need))
    # each different bigram once, as only different ones count
    of = F.flatten(F.transform(F.array_distinct("known"), lambda gram: F.flatten(F.transform(F.filter(cell(gram), lambda e: e["g"] == gram), lambda e: e["t"]))))
    rows = once(["id", "doc_id", "text", "g"], of, "of")
    enough = lambda t: F.size(F.filter("of", lambda x: x == t)) >= F.get(F.array(*map(F.lit, need)), t)
    rows = once(["id", "doc_id", "text", "g"], F.filter(F.array_distinct("of"), enough), "ts").where(F.size("ts") > 0)
    # of each word its line, the place in it, and the line's number of words
    each = F.transform(F.split("text", "\n"), lambda raw, i: F.struct(i.alias("i"), F.size(_words(raw)).alias("n")))
    word = F.flatten(F.transform(each, lambda x: F.when(x["n"] > 0, F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda k: F.struct(x["i"].alias("line"), k.alias("k"), x["n"].alias("n")))).otherwise(F.array().cast("array<struct<line:int,k:int,n:int>>"))))
    rows = once(["id", "doc_id", "g", "ts"], word, "word")
    rows = rows.select("id", "doc_id", "g", "word", F.explode("ts").alias("t"))
    own = lambda values: F.get(F.array(*map(F.lit, values)), F.col("t"))
    is_hit = lambda gram: F.exists(cell(gram), lambda e: (e["g"] == gram) & F.array_contains(e["t"], F.col("t")))
    kept = ["id", "doc_id", "g", "word", "t"]
    rows = once(kept, F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda p: is_hit(F.get(g, p))), "h")
    least, n, h = own(need), own([n for *_, n, _ in notices]), F.col("h")
    last = lambda j: F.get(h, j + least - 1)
    at = lambda p: F.get("word", p)

    def reach(j: Column) -> Column:
        """What has to be looked at for the hits from the j-th on: a window, their line, both or nothing."""
        first, end = F.get(h, j), last(j)
        near, line = end - first < n, at(first)["line"] == at(end + 1)["line"]
        from_line, to_line = first - at(first)["k"], first - at(first)["k"] + at(first)["n"] - 1
        low = F.when(line, from_line).when(near, first)
        return F.struct(low.alias("a"), F.greatest(F.when(near, F.least(first + n, F.size(g))), F.when(line, to_line)).alias("b"))

    runs = F.when(F.size(h) >= least, F.sequence(F.lit(0), F.size(h) - least)).otherwise(F.array().cast("array<int>"))
    rows = once(kept, F.filter(F.transform(runs, reach), lambda x: x["a"].isNotNull()), "reach")
    none = F.filter("reach", lambda x: F.lit(False))

    def joined(held: Column, x: Column) -> Column:
        """Runs that overlap become one; the last of those done is kept apart."""
        now = held["now"]
        over = now["a"].isNotNull() & (x["a"] <= now["b"])
        both = F.struct(F.least(now["a"], x["a"]).alias("a"), F.greatest(now["b"], x["b"]).alias("b"))
        done = F.when(over | now["a"].isNull(), held["done"]).otherwise(F.concat(held["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(over, both).otherwise(x).alias("now"))

    begin = F.struct(none.alias("done"), F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b")).alias("now"))
    merged = F.aggregate("reach", begin, joined, lambda held: F.when(held["now"]["a"].isNull(), held["done"]).otherwise(F.concat(held["done"], F.array(held["now"]))))
    rows = once(kept, merged, "merged")

    def cut(x: Column) -> Column:
        grams = F.slice(g, x["a"] + 1, x["b"] - x["a"])
        return F.struct(
            x["a"].alias("a"), grams.alias("grams"), F.transform(grams, lambda gram: is_hit(gram).cast("int")).alias("hits"), F.transform(F.slice("word", x["a"] + 1, x["b"] - x["a"] + 1), lambda w: w["line"]).alias("lines")
        )

    rows = rows.select("id", "doc_id", "t", F.size(g).alias("size"), F.explode(F.transform("merged", cut)).alias("x"))
    return rows.select("id", "doc_id", "t", "x.a", "size", "x.grams", "x.hits", "x.lines")
