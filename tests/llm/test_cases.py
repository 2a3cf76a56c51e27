"""Cases that any table may hold, and comparisons with brute force, for the corpus operators and the pipeline's stages."""

import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_groups, by_id, corpus, edited, prose

import corpus_pipeline
from marketloom.llm import common, decontaminate, fingerprint, html_text, language, license, mixing, near_dup, sharding, substring_dedup, tokens

DATA = "/root/testdata/sf0.01"
CLASHING = "row i t n s a b id key size part time shard copies source_size pieces word set _i _t _size _copies _time _pieces _group _whole _bundle doc text_key".split()


def clashing(spark, texts):
    """Documents with a column for each name that an operator might use itself."""
    names = [c for c in CLASHING if c != "shard"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))


def stages(spark, docs, tmp_path):
    """Each stage's result, by name, all on the same documents."""
    spark.createDataFrame([(1, prose(77, 30, 5000)), (2, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    docs = clashing(spark, [*[prose(i, 50) for i in range(12)], prose(0, 50), None, ""])
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    for name, out in stages(spark, docs, tmp_path).items():
        assert out.columns == docs.columns + (["shard"] if name == "sharding" else [])
        rows = out.collect()
        assert rows and all({c: r[c] for c in docs.columns} == before[r.doc_id] for r in rows), name


def test_stages_of_empty_and_unlabelled_tables(spark, tmp_path):
    docs = clashing(spark, [prose(1, 40), None, ""])
    for name, out in stages(spark, docs.limit(0), tmp_path).items():
        assert out.count() == 0 and set(docs.columns) <= set(out.columns), name
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {name: {r.doc_id for r in out.collect()} for name, out in stages(spark, unlabelled, tmp_path).items()}
    assert kept["language_id"] == kept["near_dedup"] == kept["decontamination"] == kept["sharding"] == {0, 1, 2}
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for name, out in stages(spark, nothing, tmp_path).items():
        assert out.count() == 3, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    clashing(spark, ["a"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_of_empty_tables(spark):
    docs = corpus(spark, ["a"]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string, score string")
    model = language.fit(docs)
    assert language.identify_documents(docs, model).count() == 0 and language.identify_pages(pages, model).count() == 0
    assert html_text.extract(pages).count() == 0 and license.scan(docs).count() == 0
    assert language.identify_documents(corpus(spark, ["some text", None]), model).where("accepted is null and language = 'und'").count() == 2


def test_very_long_texts(spark):
    long = [prose(1, 300_000, 50_000), "x" * 1_500_000, "word " * 300_000, "\n" * 1_000_000 + "a b"]  # 1 MB and more each
    docs = corpus(spark, [*long, long[0] + " more", prose(2, 30)])
    groups = by_id(near_dup.near_duplicates(docs, shingle=2))
    assert groups[0].component_id == groups[4].component_id == 0 and groups[3].n_shingles == 1
    assert [by_id(substring_dedup.remove_repeats(docs))[i].n_removed for i in (0, 1, 3)] == [300_000, 0, 0]
    assert sharding.shard(docs, 2).count() == fingerprint.fingerprints(docs).count() == mixing.mix(docs).count() == 6
    assert language.identify_documents(docs, language.fit(docs)).count() == 6 and license.scan(docs).count() == 0
    item = prose(3, 30, 5000)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.contaminated(corpus(spark, [f"{long[0]} {item} {long[2]}", long[1]]), bench).collect()
    assert [(r.doc_id, r.score) for r in found] == [(0, 1.0)]


def test_long_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = tokenizers.path("piece_bpe_32k.model")
    texts = [prose(1, 200_000, 50_000), "x" * 20_000, " " * 30_000]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=model).encode(texts)]
    assert [r.n_tokens for r in tokens.token_counts(corpus(spark, texts), model).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("page", ["<b>" * 600_000, "<div>" * 400_000, '<a "' * 500_000, "<a" * 1_000_000, "<!--x" * 400_000, "<script>" * 250_000, "<p" * 1_000_000], ids=lambda p: p[:5])
def test_unclosed_markup_is_read_once(page):
    import time

    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20  # 2 MB; seconds on a free machine
    began = time.time()
    language._MARKUP.sub(" ", page)
    assert time.time() - began < 5


def test_groups_that_share_a_block_are_told_apart_without_comparing_their_members(spark, monkeypatch):
    block = prose(1, 262, 5000)

    def compared(m):
        texts = [edited(f"{prose(10 + g, 40, 5000)} {block}", 1000 * g + i, 1 + i % 2) for g in range(3) for i in range(m)]
        seen, verified = [], near_dup._verified
        monkeypatch.setattr(near_dup, "_verified", lambda pairs, *a: (seen.append((a[2:], pairs.count())), verified(pairs, *a))[1])
        got = by_id(near_dup.near_duplicates(corpus(spark, texts), shingle=2))
        monkeypatch.undo()
        assert [got[i].component_id for i in range(len(texts))] == [r for _, r in brute_groups(texts, 2)]
        assert len({r.component_id for r in got.values()}) == 3
        hidden = [n for more, n in seen if more]
        assert len(hidden) == 2  # components did share buckets
        return sum(hidden)

    few, more = compared(8), compared(24)
    assert more <= max(10, 4 * few)


def test_hidden_links_between_large_components(spark):
    # two chains of small edits end close to each other: the link is between members that no bucket's least one is
    base = prose(5, 200, 5000).split()
    texts = []
    for i in range(12):
        words = list(base)
        for j in range(4 * i):
            words[(j * 7) % 200] = f"x{j}"
        texts.append(" ".join(words))
    g = brute_groups(texts, 2)
    got = by_id(near_dup.near_duplicates(corpus(spark, texts), shingle=2))
    assert [got[i].component_id for i in range(len(texts))] == [r for _, r in g]
    sets = spark.createDataFrame([(i, [*range(100)][: 100 - i % 3] + [1000 * (i + 1) + j for j in range(i % 5)]) for i in range(12)], "doc_id long, set array<long>")
    parts = spark.createDataFrame([(i, 0 if i < 7 else 7) for i in range(12)], "doc_id long, part long")
    links = near_dup._hidden_links(sets, parts, 80).collect()
    assert links and all((r.a < 7) != (r.b < 7) for r in links)


def test_sharding_agrees_with_brute_force(spark):
    texts = [prose(i, 20 + 13 * (i % 7)) for i in range(9)] + [None, "", "é", prose(1, 33)]
    for shards in (2, 3):
        got = by_id(sharding.shard(corpus(spark, texts), shards))
        sizes = [len((t or "").encode()) + 1 for t in texts]
        assert [(got[i].size, got[i].text_crc32) for i in range(len(texts))] == [(s, zlib.crc32((t or "").encode())) for s, t in zip(sizes, texts, strict=True)]
        assert got[1].shard == got[12].shard if texts[1] == texts[12] else True
        for s in range(shards):
            slots = sorted(r.slot for r in got.values() if r.shard == s)
            assert slots == list(range(len(slots)))
        loads = [sum(z for i, z in enumerate(sizes) if got[i].shard == s) for s in range(shards)]
        best = min(max(sum(z for z, s in zip(sizes, way, strict=True) if s == k) for k in range(shards)) for way in itertools.product(range(shards), repeat=9) for way in [(*way, 0, 0, 0, 0)])
        assert max(loads) <= 1.34 * best and sum(loads) == sum(sizes)


def test_repeated_ids_keep_a_place_each(spark):
    texts = ["a b c"] * 5 + ["d e"] * 4 + [None]
    docs = corpus(spark, texts, ids=[7] * 10)
    got = sharding.shard(docs, 2).toPandas()
    assert len(got) == 10 and all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    mixed = mixing.mix(docs).toPandas()
    assert len(mixed) == 10 and abs(mixed.taken.sum() - mixed["size"].sum()) <= 3 and (mixed.taken <= 3 * mixed["size"]).all()
    assert fingerprint.fingerprints(docs).count() == 10


def test_fingerprints_of_equal_and_clustered_ids(spark):
    texts = [prose(i, 30) for i in range(60)]
    ids = [0] * 20 + [None] * 20 + [10**15 + i for i in range(20)]
    rows = fingerprint.fingerprints(corpus(spark, texts, ids=ids)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, F_hash(spark, x[1])))
    want = Counter()
    for (_, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        want[t[: len(t) - len(t) // 2] + after[: len(t) // 2]] += 1
    import hashlib

    assert Counter(r.edited_sha256 for r in rows) == Counter({hashlib.sha256(k.encode()).hexdigest(): n for k, n in want.items()})


def test_the_plan_of_fingerprints_stays_small_with_many_ranges(spark):
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")  # 480 ranges, nine steps of the search
    try:
        plan = fingerprint.fingerprints(corpus(spark, [prose(i, 8) for i in range(600)]))._jdf.queryExecution().optimizedPlan()
        nodes = sum(len(plan.apply(i).expressions().mkString(" ").split("CASE WHEN")) - 1 for i in range(40))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert 0 < nodes < 100


def F_hash(spark, text, known={}):  # noqa: B006
    if text not in known:
        known[text] = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    return known[text]


def test_likeness_estimates_the_generalised_jaccard_similarity(spark):
    texts = [prose(i // 2 if i % 4 < 2 else i, 150, 300 + 40 * (i % 5)) if i % 2 == 0 else edited(prose(i // 2, 150, 300), i, 5 * (i % 12)) for i in range(80)]
    got = by_id(fingerprint.fingerprints(corpus(spark, texts)))

    def weights(t):
        return {w: 1 + math.log(n) for w, n in Counter(t.split()).items()}

    def exact(a, b):
        x, y = weights(a), weights(b)
        return sum(min(x.get(w, 0), y.get(w, 0)) for w in x | y) / sum(max(x.get(w, 0), y.get(w, 0)) for w in x | y)

    pairs = [(got[i].near_next, exact(t, texts[(i + 1) % 80])) for i, t in enumerate(texts)]
    pairs += [(got[i].near_edited, exact(t, t[: len(t) - len(t) // 2] + texts[(i + 1) % 80][: len(t) // 2])) for i, t in enumerate(texts)]
    off = np.array([a - b for a, b in pairs])
    assert np.abs(off).mean() < 0.06 and abs(off.mean()) < 0.02 and np.corrcoef(*zip(*pairs, strict=True))[0, 1] > 0.9


def test_decontamination_agrees_with_exhaustive_alignment(spark):
    items = [prose(300 + i, 20 + i, 3000) for i in range(12)]
    texts = [f"{prose(i, 60, 3000)} {edited(items[i % 12], i, i % 12)} {prose(500 + i, 60, 3000)}" for i in range(72)] + [prose(900 + i, 150, 60) for i in range(20)]
    docs, bench = corpus(spark, texts), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    code: dict[str, int] = {}
    number = lambda t: np.array([code.setdefault(w, len(code)) for w in re.findall(r"[a-z0-9]+", t.lower().replace(".", " "))])
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            words = number(item)
            score = decontaminate.align(words, number(t))[0] / (2 * len(words))
            if score >= 0.6:
                want[d, i] = score
    missed = set(want) - set(got)
    assert len(want) > 30 and len(missed) <= 0.02 * len(want) and set(got) <= set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    rows = language.identify_documents(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("n >= 20").collect()
    right = Counter(r.lang for r in rows if r.language == r.lang)
    total = Counter(r.lang for r in rows)
    assert len(total) == 4 and all(right[x] >= 0.97 * total[x] for x in total), (right, total)


def test_licence_scan_agrees_with_brute_force(spark):
    template = "permission to use copy and modify these words is granted to any person without fee or charge of any kind"
    words = re.findall(r"\w+", template)
    texts = [f"{prose(i, 15)} {edited(template, i, i % 8)} {prose(60 + i, 15)}" for i in range(24)] + [prose(99, 200), None, " ".join(words[:12])]

    def grams(w):
        return set(zip(w, w[1:], strict=False))

    def best(t):
        w = re.findall(r"\w+", (t or "").lower())
        whole = grams(words)
        spans = [w[a : a + len(words)] for a in range(len(w))]
        return max((2 * len(grams(s) & whole) / (len(grams(s)) + len(whole)) for s in spans if grams(s)), default=0)

    got = {r.doc_id for r in license.scan(corpus(spark, texts), templates=[("X", template)]).collect()}
    assert got == {i for i, t in enumerate(texts) if best(t) >= 0.8} and 5 < len(got) < 24


def test_article_blocks_of_every_page(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(x.replace("<br>", " ").replace("<b>", ""))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


LONG = " ".join(["and then some more words of running text follow here"] * 4)


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        ("<form id=f><div><article><h1>Title here</h1><p>{0}</p><p>Short.</p></article></div></form>", ["Title here", LONG, "Short."], []),
        ("<form id=f><h1>Title here</h1><p>{0}</p><p>Short.</p><p>{0}</p><label>Your name</label></form>", ["Title here", "Short."], ["Your name"]),
        ("<article><div class=post-header><h1>A title</h1></div><p>{0} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end</p></article>", ["A title", "x=2 end"], []),
        ("<article><h1>A title</h1><p class=share-price>{0}</p><p>{0}</p></article>", [f"{LONG}\n{LONG}"], []),
        ("<article><p>{0}</p></article><div class=comment-list><article><p>{0} said a reader</p></article></div>", [LONG], ["said a reader"]),
        ("<div class='cookie-notice main'>{0} cookies</div><main><p>{0}</p></main><footer>{0} footer</footer>", [LONG], ["cookies"]),
        ("<article><header><h1>A title</h1><p>By someone</p></header><p>{0}</p><aside>{0} aside</aside></article>", ["A title", LONG], ["By someone", "aside"]),
        ("<p>{0}</p><a title='x > y' href=/q>a link</a> in text of a page &lt;b&gt; <p>1 < 2 and {0}", ["1 < 2 and"], []),
    ],
)
def test_html_of_other_kinds(page, kept, gone):
    text = html_text.main_text(page.format(LONG))
    assert all(k in text for k in kept) and not any(g in text for g in gone), text


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "local-cluster[2,1,1024]", "applicationId": "x"})

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.scratch_root(Elsewhere)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = common.materialize(corpus(spark, ["a"]), "x")
    common.release(t)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("rows", [[(7, "same words here")] * 1600, [(None, "same words here")] * 1600 + [(i, prose(i, 3)) for i in range(100)]])
def test_shards_of_repeated_rows_are_equal(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs).toPandas()
    for sizes in (out.groupby("shard")["size"].sum(), sharding.with_shards(docs).toPandas().groupby("shard")["text"].apply(lambda t: sum(len(x.encode()) + 1 for x in t))):
        assert len(sizes) == 16 and sizes.max() / sizes.min() <= 1.05
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_mixed_keeps_the_totals_of_repeated_rows(spark):
    rows = [(None, "four words are here", f"s{k}") for k in range(3) for _ in range(300)] + [(i, prose(i, 9), "s1") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).toPandas().set_index("source").n.to_dict()
    got = mixing.mixed(docs).groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).toPandas().set_index("source").n.to_dict()
    assert got == {k: v for k, v in want.items() if v}


SIX = [f"words of a plain line {i} here" for i in range(6)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div>" + "".join(f"<p>{x}</p>" for x in SIX) + "</div>", "\n".join(SIX)), ("<p>Short note only.</p>", "Short note only."), ("<body><nav><a href=/>Home</a></nav><p>Short note only.</p><footer>&copy; nobody</footer>", "Short note only."),
        (f"<article><header><h1>A title</h1><p>eight words that stand first below the title</p></header><p>{LONG}</p></article>", f"A title\neight words that stand first below the title\n{LONG}"),
        (f"<div class=left-rail><h3>Popular</h3><p>{LONG}</p></div><article><p>{LONG} end</p></article>", f"{LONG} end"), (f"<article><p>{LONG} end</p></article><section class=discussion><p>{LONG}</p></section>", f"{LONG} end"),
        (f"<article><p>{LONG} end</p></article><div class=talkback><p>{LONG}</p></div>", f"{LONG} end"), (f"<article><p>{LONG} end</p><div class=pub>Buy this now and be glad</div></article>", f"{LONG} end"),
        (f"<ul><li><a>Home</a><li><a>News</a></ul><div><h1>A title of words</h1><p>{LONG}</p><p>{LONG}</p><p>And so on.</p></div><div><h3>Readers</h3><div><p>I liked this one a lot.</p></div><div><p>Me too.</p></div></div>", f"A title of words\n{LONG}\n{LONG}\nAnd so on."),
    ],
)
def test_html_of_short_and_loosely_named_pages(page, want):
    assert html_text.main_text(page) == want


#: Layouts that the tree isn't fitted on.
HELD_OUT = [
    "<div id=top><a href=/>{x1}</a> <a href=/n>{x1}</a></div><div class=story><h1>{m7}</h1><p>{m40}</p><p>{m10}</p><p>{m60}</p></div><div id=bottom class=footer>{x5}</div>",
    "<header><a href=/>{x2}</a></header><main><h1>{m5}</h1><p>{m20}</p><section><h2>{m3}</h2><p>{m35}</p><ol><li>{m5}<li>{m7}</ol></section></main><div class=newsletter>{x12}</div><footer>{x4}</footer>",
    "<article><h2>{m4}</h2><p>{m4}</p><p>{m9}</p></article><section class=comments><p>{x30}</p><p>{x5}</p></section>",
    "<div class=cookies>{x20}</div><div class=sidebar><h4>{x1}</h4><a href=/a>{x4}</a><a href=/b>{x5}</a></div><div class=body><p>{m25}</p><p>{m45}</p></div>",
    "<div class=banner>{x8}</div><div><p>{m8}</p><p>{m6}</p></div><div class=related><a href=/a>{x6}</a></div>",
    "<ul><li><a href=/1>{x1}</a><li><a href=/2>{x1}</a></ul><div><div><h1>{m6}</h1><p>{m55}</p><p>{m35}</p><p>{m50}</p></div><div><p>{x7}</p></div></div>",
]


def test_tree_on_layouts_it_has_not_seen():
    x, y = html_text.examples(HELD_OUT, pages=20, seed=9)
    right = np.array([html_text.is_main(tuple(r)) for r in x]) == y
    assert right.mean() >= 0.95
    f, _, *_ = html_text.tree()
    assert f != 7  # names of furniture don't decide alone


def brute_scan(text, templates, threshold=0.8):
    """All windows and lines of a text against all templates, the best first, none over another."""
    norm = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).split()
    lines = [norm(x) for x in text.split("\n")]
    words, of = [w for x in lines for w in x], [i for i, x in enumerate(lines) for _ in x]
    grams, found = list(zip(words, words[1:])), []
    for rank, (name, t) in enumerate(sorted(templates, key=lambda x: x[0])):
        w = norm(t)
        own, n = set(zip(w, w[1:])), len(w) - 1
        spans = [(s, min(s + n, len(grams))) for s in range(len(grams)) if grams[s] in own]
        first = {}
        for i, line in enumerate(of):
            first.setdefault(line, i)
        spans += [(s, s + len(lines[line]) - 1) for line, s in first.items() if len(lines[line]) > 1]
        for s, e in set(spans):
            held = set(grams[s:e])
            dice = 2 * len(held & own) / (len(held) + len(own))
            if dice >= threshold:
                found.append((-len(held & own), -dice, rank, s, e, name))
    kept = []
    for x in sorted(found):
        if not any(x[3] < y[4] and y[3] < x[4] for y in kept):
            kept.append(x)
    return sorted((of[x[3]], x[5], round(-x[1], 9)) for x in kept)


def test_licences_equal_brute_force_over_all_templates(spark):
    rng = np.random.default_rng(6)
    isc, mit = (next(t for n, t in reversed(license.TEMPLATES) if n == k) for k in ("ISC", "MIT"))
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    change = lambda t, share: " ".join(w if rng.random() > share else f"w{rng.integers(99)}" for w in t.split())
    texts = [isc, wrap(mit, 7), f"{prose(1, 50)}\n{wrap(isc, 12)}\n{mit}\n{prose(2, 30)} Released under the MIT License. {prose(3, 9)}", change(mit, 0.04), change(isc, 0.08), isc + " " + isc + "\n\n" + mit[:400],
             "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", license.TEMPLATES[1][1] + " and more", prose(5, 300), None, "", "mit", " ".join(t for _, t in license.TEMPLATES[:14])]
    templates = [t for t in license.TEMPLATES if len(t[1]) < 2000]
    got = {}
    for r in license.scan(corpus(spark, texts), templates=templates).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.license, round(r.dice, 9)))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_scan(t or "", templates), i
    assert len(got) >= 8


def test_licences_of_long_texts_take_time_in_proportion(spark):
    import time

    whole = next(t for n, t in reversed(license.TEMPLATES) if n == "GPL-3.0")
    license.scan(corpus(spark, [whole])).count()
    began = time.time()
    rows = license.scan(corpus(spark, ["\n".join([whole] * 60)])).collect()
    took = time.time() - began
    assert len(rows) == 60 and {r.license for r in rows} == {"GPL-3.0"} and took < 60  # 2 MB


def test_labels_beyond_the_bound_leave_the_model_small(spark, monkeypatch):
    from marketloom.llm import language

    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, f"the dog and the fox {i}", "en") for i in range(30)] + [(100 + i, f"der hund und die katze {i}", "de") for i in range(20)] + [(200 + i, f"junk {i}", f"x{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    model = language.fit(docs)
    assert model.languages == ["de", "en", "und"]
    got = {r.doc_id: r.text_language for r in language.identify_documents(docs, model).collect()}
    assert got[3] == "en" and got[105] == "de" and len(got) == len(rows)


def test_shards_are_placed_without_python_workers(spark):
    docs = corpus(spark, ["a b c"] * 40 + [prose(i, 30) for i in range(20)])
    out = sharding.with_shards(docs.select("*", F.lit(1).alias("more")), 4)
    _, _, placed, bundles, cut = sharding._plan(docs, 4, "doc_id", "text")
    assert cut and placed.dtypes == [("_group", "binary"), ("_piece", "bigint"), ("shard", "int")] and bundles.dtypes == [("_bundle", "bigint"), ("shard", "int")]
    for df in (placed, bundles):  # rows of Python would be a scan of an RDD that Python workers make
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 60 and {r.shard for r in out.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_empty_tables_are_sharded(spark):
    assert sharding.with_shards(corpus(spark, ["a"]).limit(0), 4).count() == 0
