import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, fingerprint, html_text, language, license, mixing, near_dup, sharding, substring_dedup, tokens
from marketloom.llm.components import components
from marketloom.llm.words import words_of

SCHEMA = "doc_id long, text string, lang string, source string, size string, shard string"


def corpus(spark, texts, ids=None, sources=None):
    """Documents, with extra columns whose names the operators use themselves."""
    n = len(texts)
    rows = zip(ids or range(n), texts, ["en"] * n, sources or ["s"] * n, ["x"] * n, ["y"] * n, strict=True)
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def prose(seed, n, vocabulary=400):
    g = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return " ".join(g.choice(words) for _ in range(n))


def edited(text, seed, edits):
    g, words = random.Random(seed), text.split()
    for i in g.sample(range(len(words)), edits):
        words[i] = f"e{g.random()}"
    return " ".join(words)


ODD = [None, "", " \n\t ", "one", "ONE", "one", "é" * 3000, "a b", "word " * 3000, prose(1, 400), prose(1, 400)]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_words_split_at_ascii_space_only():
    import pyarrow as pa

    texts = ["a b", None, "", " A\x0bé x ", "b"]
    (w,) = words_of(pa.array(texts), lower=True)
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [b"a", b"b", b"a", "é x".encode(), b"b"]
    assert list(w.doc) == [0, 0, 3, 3, 4] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[4] and len(set(w.hash)) == 3


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0


def brute_groups(texts, k):
    sets = []
    for t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_agree_with_brute_force(spark, k):
    base = prose(3, 150)
    texts = ODD + [edited(base, i, i % 14) for i in range(60)] + [prose(100 + i, 40) for i in range(20)]
    got = by_id(near_dup.near_duplicates(corpus(spark, texts), shingle=k))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == brute_groups(texts, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_nothing_and_of_repeated_ids(spark):
    assert near_dup.near_duplicates(corpus(spark, ["a"]).limit(0)).count() == 0
    rows = near_dup.near_duplicates(corpus(spark, ["a b c", "a b c", "z"], ids=[5, 5, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (5, 5), (5, 5)]
    left = near_dup.drop_near_duplicates(corpus(spark, ["a b c", "a b c", "z", "A b c"], ids=[5, 5, 6, 7]))
    assert sorted(r.doc_id for r in left.collect()) == [5, 6] and left.columns == corpus(spark, ["a"]).columns


def test_sketch_coordinates_collide_as_the_jaccard_similarity():
    g = np.random.default_rng(1)
    x = g.integers(0, 2**63, 900).astype(np.uint64)
    a, b = x[:600], x[200:800]
    doc = np.repeat([0, 1], 600)
    s = near_dup.sketch(doc, np.concatenate([a, b]), 2, 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(400 / 800, abs=0.05)
    assert not (near_dup.sketch(np.array([0]), x[:1], 1, 50) == np.uint64(2**64 - 1)).any()


def test_sharding_balances_and_splits_a_hot_group(spark):
    texts = ["same text"] * 400 + [prose(i, 5 + i % 60) for i in range(600)] + [None, ""]
    got = sharding.shard(corpus(spark, texts), 4).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and sizes.max() <= 1.02 * sizes.min() and set(got.law) == {"bytes"}
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    one = got.set_index("doc_id").loc
    assert one[500, "text_crc32"] == zlib.crc32(texts[500].encode()) and one[1000, "size"] == one[1001, "size"] == 1
    assert sharding.shard(corpus(spark, ["a"]).limit(0), 4).count() == 0
    placed = sharding.with_shards(corpus(spark, texts), 4)
    assert placed.columns == corpus(spark, texts).columns and {r.doc_id: r.shard for r in placed.collect()} == dict(zip(got.doc_id, got.shard, strict=True))


def test_sharding_cuts_only_groups_of_over_half_a_shard(spark):
    pairs = [prose(i, 30) for i in range(300)]
    texts = [*pairs, *pairs, *["forty equal rows " * 10] * 40, *["too many " * 12] * 260]  # 900 rows: half a shard of 8 is 56.25
    got = sharding.shard(corpus(spark, texts), 8).toPandas()
    shards = got.assign(text=[texts[i] for i in got.doc_id]).groupby("text")["shard"].nunique()
    assert (shards.drop("too many " * 12) == 1).all() and 3 <= shards["too many " * 12] <= 5
    sizes = got.groupby("shard").agg(size=("size", "sum"), rows=("size", "count"))
    assert len(sizes) == 8 and sizes["size"].max() <= 1.1 * sizes["size"].min()


def test_token_counts_agree_with_the_library(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = tokenizers.path("piece_bpe_32k.model")
    g = random.Random(5)
    texts = ODD + ["".join(g.choice(["a", " ", "  ", "\n", "▁", "the ", "é", "<s>"]) for _ in range(g.randint(0, 12))) for _ in range(300)]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=model).encode([t or "" for t in texts])]
    got = by_id(tokens.token_counts(corpus(spark, texts), model, limit=5))
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(r.n_bytes == len((texts[i] or "").encode()) and r.over_limit == (r.n_tokens > 5) for i, r in got.items())


def test_mixing_meets_targets_and_caps(spark):
    texts = [prose(i, 20) for i in range(300)] + [None, ""]
    sources = ["a"] * 200 + ["b"] * 80 + ["c"] * 10 + [None] * 12
    got = mixing.mix(corpus(spark, texts, sources=sources)).toPandas()
    assert len(got) == len(texts) and (got.taken <= 3 * got["size"]).all()
    per = got.fillna({"source": "~"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 20).all() and abs(got.taken.sum() - got["size"].sum()) <= 20
    assert per.target["c"] == 3 * per.own["c"] and per.target.sum() == pytest.approx(got["size"].sum())
    assert mixing.mix(corpus(spark, ["a"]).limit(0)).count() == 0
    mixed = mixing.mixed(corpus(spark, texts, sources=sources))
    assert mixed.columns == corpus(spark, ["a"]).columns
    assert Counter(r.doc_id for r in mixed.collect()) == {int(i): int(c) for i, c in zip(got.doc_id, got.copies, strict=True) if c}


def test_repeats_agree_with_brute_force(spark):
    shared = prose(7, 50)
    texts = ODD + [f"{prose(20 + i, 30)} {shared} {prose(50 + i, i)}" for i in range(6)] + [shared, prose(9, 34), " ".join([prose(8, 36)] * 2)]
    words = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    got = by_id(substring_dedup.remove_repeats(corpus(spark, texts)))
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_repeated_rows_lose_what_they_share(spark):
    text = prose(11, 40)
    rows = substring_dedup.remove_repeats(corpus(spark, [text, text, None], ids=[1, 1, None])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 40, 40]
    assert substring_dedup.remove_repeats(corpus(spark, [text]).limit(0)).count() == 0


def test_decontamination_finds_copies_and_edits_only(spark):
    items = [prose(200 + i, 30, 5000) for i in range(5)]
    texts = ODD + [f"{prose(1, 50)} {items[0].upper()}, {prose(2, 50)}", edited(items[1], 3, 5), prose(3, 200), items[2][: len(items[2]) // 4]]
    docs = corpus(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(11, 0), (12, 1)} and got[11, 0] == 1.0
    clean = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {11, 12} and clean.columns == docs.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_does_not_depend_on_the_size_of_the_corpus(spark):
    words = [f"w{i}" for i in range(10)] * 4  # common words, an edit in each run of three
    item = " ".join(random.Random(5).sample(words, 40))
    spaced = item.split()
    spaced = " ".join(w if i % 2 else f"{w} {spaced[i + 1]} between" for i, w in enumerate(spaced) if i % 2 == 0)
    bench = spark.createDataFrame([(1, item), (2, "alpha beta gamma")], "item_id long, text string")
    for filler in (0, 400):
        docs = corpus(spark, [spaced, "alpha x beta y gamma", *[prose(900 + i, 2000, 10) for i in range(filler // 10)]])
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
        assert got[0, 1] >= 0.7 and got[1, 2] == pytest.approx(4 / 6)


def test_alignment_by_hand():
    a = np.array([1, 2, 3, 4, 5])
    assert decontaminate.align(a, a) == (10, 5)
    assert decontaminate.align(a, np.array([9, 1, 2, 7, 3, 4, 5, 9])) == (9, 7)
    assert decontaminate.align(a, np.array([1, 2, 8, 4, 5])) == (7, 5)


def test_language_held_out_and_priors(spark):
    said = {"en": "the quick brown fox jumps over the lazy dog and then the cat", "de": "der schnelle braune fuchs springt über den faulen hund und dann"}
    train = spark.createDataFrame([(f"{t} {i}", lang) for lang, t in said.items() for i in range(20)], "text string, lang string")
    model = language.fit(train, sample=15)
    texts = ["the dog and the fox", "der hund und der fuchs", None, "", "日本語" * 40]
    got = by_id(language.identify_documents(corpus(spark, texts), model))
    assert [got[i].language for i in (0, 1)] == ["en", "de"] and [got[i].accepted for i in range(5)] == [True, True, False, False, False]
    left = language.accept(corpus(spark, texts), model)
    assert {r.doc_id for r in left.collect()} == {0, 1} and left.columns == corpus(spark, texts).columns
    html = "<html lang='{}'><script>der und</script><p>{}</p>"
    pages = spark.createDataFrame([(1, "http://a.example.de/de/1", html.format("de", "zug")), (2, None, None)], "page_id long, url string, html string")
    first, second = language.identify_pages(pages, model).orderBy("page_id").collect()
    assert (first.declared, first.address, first.language) == ("de", "de", "de") and not second.accepted
    assert language.fit(train.limit(0)).languages == ["und"]


def test_language_sample_is_bounded_whatever_the_copies(spark):
    rows = [("aaa", "en")] * 50 + [(f"bbb{i}", "en") for i in range(40)]
    train = spark.createDataFrame(rows, "text string, lang string")
    once = spark.createDataFrame(sorted(set(rows)), "text string, lang string")
    assert (language.fit(train, sample=1000).table == language.fit(once, sample=1000).table).all()
    # one text of three bytes leaves one trigram; the smoothed table has two values then
    few = language.fit(spark.createDataFrame([(f"{i:03}", "en") for i in range(200)], "text string, lang string"), sample=1)
    assert len(set(few.table[0])) <= 2


def test_language_sample_is_full_however_many_copies(spark):
    once = [(f"text {i}", "en") for i in range(60)]
    train, few = (spark.createDataFrame(x, "text string, lang string") for x in (once * 40, once))
    assert (language.fit(train, sample=60).table == language.fit(few, sample=60).table).all()


def test_fingerprints_follow_the_next_document(spark):
    texts = [prose(i, 120, 3000) for i in range(40)] + [None, "x", prose(0, 120, 3000)]
    got = by_id(fingerprint.fingerprints(corpus(spark, texts)))
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[0].fingerprint == got[42].fingerprint and got[42].near_next == 1.0
    assert np.mean([got[i].near_edited for i in range(39)]) == pytest.approx(1 / 3, abs=0.06) and got[5].near_next < 0.15
    assert fingerprint.fingerprints(corpus(spark, ["a"]).limit(0)).count() == 0


def test_license_lines(spark):
    texts = [f"{prose(1, 30)}\nReleased under the MIT license\nmore", "Released under the MIT Licence of old times", None, "", "word " * 3000]
    rows = license.scan(corpus(spark, texts)).collect()
    assert [(r.doc_id, r.line, r.license, r.dice) for r in rows] == [(0, 1, "MIT", 1.0)]
    bigrams = lambda t: set(zip(t, t[1:], strict=False))
    near = "Released under the new MIT License."
    a, b = bigrams("released under the mit license".split()), bigrams("released under the new mit license".split())
    dice = 2 * len(a & b) / (len(a) + len(b))
    found = license.scan(corpus(spark, [near]), threshold=dice).collect()
    assert found[0].dice == pytest.approx(dice) and license.scan(corpus(spark, [near]), threshold=dice + 0.01).count() == 0


def test_license_texts_wrapped_and_inline(spark):
    import textwrap

    mit = dict(license.TEMPLATES)["MIT"]
    wrap = "\n".join(textwrap.wrap(mit, 70))
    inline = f"{prose(2, 20)} Released under the MIT License. {prose(3, 20)} Licensed under CC BY-SA 4.0. {prose(4, 9)}"
    header = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License."
    texts = [f"{prose(1, 30)}\n{wrap}\n{prose(5, 30)}", mit.replace("\n", " "), inline, header, f"{wrap}\n{wrap.replace('Software', 'Work')}", prose(6, 400)]
    got = sorted((r.doc_id, r.line, r.license) for r in license.scan(corpus(spark, texts)).collect())
    again = 1 + wrap.count("\n")
    assert got == [(0, 1, "MIT"), (1, 0, "MIT"), (2, 0, "CC-BY-SA-4.0"), (2, 0, "MIT"), (3, 0, "GPL-3.0"), (4, 0, "MIT"), (4, again, "MIT")]
    bsd = {name: text for name, text in license.TEMPLATES if name.startswith("BSD")}
    for name, text in bsd.items():
        assert {r.license for r in license.scan(corpus(spark, [text.replace("HOLDERS", "OWNERS")])).collect()} == {name}
    rows = license.scan(corpus(spark, ["a\nUnlicensed!\nb"]), templates=[("U", "unlicensed")]).collect()
    assert [(r.line, r.license, r.dice) for r in rows] == [(1, "U", 1.0)]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice">We use cookies on this site to serve you better and more</div>
<main><article><h1>Head &lt;line&gt;</h1><p>First <b>bold</b>
 text,&nbsp;with a <a href=/x>link</a>.<br>Next<p>Short.<!-- no --><div class="ad">Buy this now for little money and be glad</div><form><p>Your name here</p></form></article></main>
<aside><p>Some related words that are long enough to look like a text of some kind</p></aside><section id="comments"><p>I liked this very much and wrote a long comment about it, as one does.</p></section>
<footer><p>&copy; nobody</p></footer></body></html>"""


def test_html_extraction(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "<nav><a>x</a></nav>"), (3, "v", "<p" * 5000)], "page_id long, url string, html string")
    got = html_text.extract(rows).collect()
    assert got[0].text == "Head <line>\nFirst bold text, with a link. Next\nShort."
    assert [r.text for r in got[1:]] == ["", "", ""] and all(r.n_chars == len(r.text) for r in got)
    plain = "<body><ul><li><a>Home</a><li><a>News</a></ul>" + "".join(f"<p>{prose(i, 40)}</p>" for i in range(3))
    assert html_text.main_text(plain) == "\n".join(prose(i, 40) for i in range(3))


def test_null_ids_pass_through(spark):
    docs = corpus(spark, ["a b", "c d"], ids=[None, None])
    for out in (sharding.shard(docs, 2), mixing.mix(docs), substring_dedup.remove_repeats(docs), fingerprint.fingerprints(docs)):
        assert out.where(F.col("doc_id").isNull()).count() == 2


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    texts = [f"the dog and the fox went {prose(i, 60, 2000)}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, *texts[:5]])], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[7][30:300])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == [*docs.columns, "shard"] and 7 not in ids and ids <= set(range(30)) and len(ids) > 20
