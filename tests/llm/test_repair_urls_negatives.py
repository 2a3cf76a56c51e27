"""Conversation repair, URL rules and hard negatives against brute force, on the cases any table may hold."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from marketloom.llm import conversations, hard_negatives, url_rules

SPACE = " \t\n\v\f\r"


def brute_repair(rows):
    left = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        left[c] += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: brute_edits(rs) for c, rs in left.items()}


def brute_edits(rs):
    rs = sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, r, x in rs:
        faults.append("blank" if not x.strip(SPACE) else "duplicate" if (r, x) in seen else "" if x.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((r, x))
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, last, put):
        """Cheapest (cost, audit, lines) of rows i on, after a row with that initial and so many put in here."""
        follows, ways = "a" if last == "u" else "u", []
        if i == len(rs):
            ways += [(0, "", ())] if last in ("", "a") else []
        else:
            (_, r, x), cost = rs[i], 3 * (faults[i] == "truncated")
            ways.append((4, "D", (), best(i + 1, last, 0)))
            if faults[i] in ("", "truncated"):
                if r[:1] == follows or (r[:1] == "s" and last == ""):
                    ways.append((cost, "K", (f"{r}:{x}",), best(i + 1, r[:1], 0)))
                ways.append((cost + 3, "R", (f"{names[follows]}:{x}",), best(i + 1, follows, 0)))
        if put < 3:
            ways.append((3, "I", (f"{names[follows]}:",), best(i, follows, put + 1)))
        whole = [w if len(w) == 3 else (w[0] + w[3][0], w[1] + w[3][1], w[2] + w[3][2]) for w in ways]
        return min(whole, key=lambda w: w[:2]) if whole else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rs if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talk(seed, conversations_=150):
    rng, rows = random.Random(seed), []
    texts = ["Hi.", "Yes!", "no end", "  ", None, "", "What? \n", "é\U0001f600.", "\u00a0", "a\r\n"]
    for c in range(conversations_):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["system"] + ["user"] * 4 + ["assistant"] * 4 + [None, "tool", ""])
            rows.append((c, rng.choice([t, t, t, t + 3, None, -t]), role, rng.choice([*texts, f"x{rng.random()}."])))
    return rows + [(None, None, None, None)] * 3 + rows[:20]


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece", [conversations.PIECE, 3])
def test_repair_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = talk(1)
    got = conversations.repaired(spark.createDataFrame(rows, TALK)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_repair(rows) and len(got) == len({r[0] for r in rows})


def test_repair_of_one_long_conversation(spark, monkeypatch):
    """A conversation over many pieces and ranges, with equal rows in thousands and one very long text."""
    monkeypatch.setattr(conversations, "PIECE", 64)
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{t}.", "cut", ""])) for t in range(500)] + [(7, 900, "user", "Again.")] * 700 + [(8, 1, "user", "word " * 200_000 + " " * 200_000)]
    got = {r[0]: tuple(r[1:]) for r in conversations.repaired(spark.createDataFrame(rows, TALK)).collect()}
    import sys

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(30_000)
    try:
        assert got == brute_repair(rows)
    finally:
        sys.setrecursionlimit(depth)


def test_repair_where_nothing_is_left_or_given(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(gone, 0, "user", "Hi.", 1)], TALK + ", conv int")
    assert [tuple(r) for r in conversations.repaired(docs).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repaired(docs.limit(0)).count() == 0


def test_costs_to_go_have_few_states():
    known = conversations.states()
    assert known[0] == conversations.END and len(known) == len(set(known)) < 64
    assert all(conversations.before(s, c)[0] in known for c in known for s in "dsuaoSUAO")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("A.B", None, "block"), ("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("c", "é/", "block")]


def brute_judge(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in found[1]), found[2]) if found else ("", "")
    fit = [(h.lower() + (p or ""), v) for h, p, v in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    rule = max(fit, key=lambda r: (len(r[0]), r[1]), default=(None, "allow"))
    return host, path, *rule


URLS = ["https://example.org/es/1", "https://EXAMPLE.org/ES/1", "http://a.example.org/en/17?x=/es/", "http://example.org/en/2", "http://example.org", "http://example.org?a", "x://org/", "http://notexample.org/es/",
        "http://u.com/de/1#f", "http://u.com/fr", "http://u.com/fr/", "com/de/", None, "", "://", "http://com:80/de/", "http://.org/", "http://a..org/a", "http://x.a.b/", "http://x.a.b/xy", "http://A.B", "http://É.org/",
        "q://c/é/", "http://c/é/", "http://" + "a." * 50_000 + "org/" + "b" * 200_000, "http://example.org/de/://com/de/", "http://x\n.org/\n"]


def test_urls_equal_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0]), (0, None)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h", "p", "at") for i, u in rows], "page_id long, url string, host string, path string, at string")
    got = sorted((tuple(r) for r in url_rules.judge(pages, rules).collect()), key=str)
    assert got == sorted(((i, *brute_judge(u)) for i, u in rows), key=str)
    kept = url_rules.drop_blocked(pages, rules)
    assert kept.columns == pages.columns and sorted(str(r.url) for r in kept.collect()) == sorted(str(u) for _, u in rows if brute_judge(u)[3] == "allow")


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(pages, none, default="block").collect()] == [(1, "a.b", "/c", None, "block")]
    assert url_rules.judge(pages.limit(0), none).count() == 0
    for bad in (("", "/", "allow"), ("a", "/", "maybe"), ("a", "x" * 5000, "block"), (None, "/", "allow")):
        with pytest.raises(Exception, match="a rule has a host"):
            url_rules.judge(pages, spark.createDataFrame([bad], none.schema)).collect()


def test_short_hashes_that_collide_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(url_rules, "_short", lambda e: F.pmod(F.length(e), F.lit(2)).cast("long"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), rules).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: brute_judge(u) for i, u in enumerate(URLS)}


def brute_negatives(rows, k=5):
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        held.append((i, label, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) if math.isfinite(256 * x) else math.copysign(1, x) for x in v]))
    out = []
    order = lambda r: (-r[1], r[0] is None, r[0])
    for a, (i, label, v) in enumerate(held):
        if i is None or i % 100:
            continue
        scored = [(j, sum(x * y for x, y in zip(v, w, strict=False)), lab) for b, (j, lab, w) in enumerate(held) if b != a]
        for p, ps, _ in sorted((s for s in scored if s[2] == label), key=order)[:k]:
            fits = sorted((s for s in scored if s[2] != label and 80 * ps <= 100 * s[1] <= 100 * ps), key=order)[:k]
            out += [(i, p, n + 1, j, ps, s) for n, (j, s, _) in enumerate(fits)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, dim=8):
    centre = rng.normal(size=(5, dim))
    return [(i * 5, [float(x) for x in np.float32(centre[i % 5] + 0.4 * rng.normal(size=dim))], int(rng.integers(0, 4))) for i in range(n)]


def mined(spark, rows, schema=VECTORS):
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ASKED", 4)
    rng = np.random.default_rng(3)
    rows = vectors(rng, 1200)
    rows += [(7, None, 1), (100, [1.0] * 8, None), (200, [float("nan")] * 8, 1), (300, [float("inf")] * 8, 1), (400, [None] * 8, 1), (None, rows[0][1], 2), (None, rows[0][1], 0)]
    rows += [(0, rows[0][1], 1)] * 3 + [(100_001 + i, rows[20][1], 3) for i in range(300)] + [(500, [0.0] * 8, 1), (600, [], 2), (700, rows[3][1][:3], -3)]
    assert mined(spark, rows) == brute_negatives(rows) != []


def test_negatives_of_scores_without_a_bound(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 20, [float(x * 10.0 ** rng.integers(0, 7)) for x in rng.normal(size=3)], i % 2) for i in range(60)]
    got = mined(spark, rows, "vec_id long, embedding array<double>, label int")
    assert got == brute_negatives(rows)


def test_negatives_of_empty_and_single_tables(spark):
    one = [(0, [1.0, 2.0], 1)]
    assert mined(spark, one) == [] and mined(spark, [(0, None, None)]) == []
    assert hard_negatives.hard_negatives(spark.createDataFrame(one, VECTORS).limit(0)).count() == 0


def test_ranges_drop_leaves_but_no_row():
    """Leaves left hold every row of the window; far clusters are dropped."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 16)) * 900
    x = np.floor(centre[rng.integers(0, 30, 6000)] + 20 * rng.normal(size=(6000, 16))).astype(np.int64)
    tree = hard_negatives.Tree(x[:2000], float((x * x).sum(1).max()) * (1 + hard_negatives.SLACK))
    index = hard_negatives.Index(tree, tree.ranges(x))
    leaf = np.zeros(len(x), int)
    for node, child, which, _ in tree.down(hard_negatives._extra(x, tree.longest)):
        if tree.leaf(node, child) is not None:
            leaf[which] = tree.leaf(node, child)
    touched = 0
    for q in x[:40]:
        s = x @ q
        best = int(np.sort(s)[-6])
        found = set(index.leaves(q, [(int(np.ceil(0.8 * best)), best)]))
        assert set(leaf[(s >= 0.8 * best) & (s <= best)]) <= found
        touched += np.isin(leaf, list(found)).mean() / 40
    assert touched < 0.5
