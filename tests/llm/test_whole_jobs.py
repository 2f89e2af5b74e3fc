"""Cases in which the training-data operators once did less than the whole job."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake.llm import brown, decontam, html_text, jaccard_join, mixing, quality, queries, sharding, urls


def test_edited_copies_leak_however_many_there_are(spark):
    rng = np.random.default_rng(3)
    for size, step, exact, copies in ((59, 5, 10, 1000), (20, 4, 2, 25), (38, 5, 2, 25)):
        item = [f"w{size}x{i}" for i in range(size)]
        rows = [(i, " ".join(["before", *item, "after"])) for i in range(exact)]
        rows += [(1000 + i, " ".join([f"b{rng.integers(99)}", *(w if (k + 1) % step else "changed" for k, w in enumerate(item)), f"e{i}"])) for i in range(copies)]
        rows += [(5000, " ".join(item[:3] + ["far"] * 40)), (5001, "nothing of it")]
        docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, "an item of other words entirely")], "item_id long, text string")
        want = {i for i, _ in rows if i < 5000}
        got = decontam.find_leaks(docs, bench).collect()
        assert {r["doc_id"] for r in got} == want and len(got) == len(want)
        assert {r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()} == {5000, 5001}


def test_common_seeds_lead_to_every_alignment_that_all_seeds_give():
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{min(int(x), 60)}" for x in rng.exponential(9, n))
    block = [(i, word(rng.integers(3, 30))) for i in range(30)]
    texts = [word(rng.integers(1, 120)) + " " + block[i % 30][1] for i in range(60)]
    everything, trimmed = decontam.Items(block), decontam.Items(block)
    counts = {}
    for t in texts:
        for k in trimmed.seen(t).tolist():
            counts[k] = counts.get(k, 0) + 1
    trimmed.keep_rare(counts, 3)
    assert 0 < len(trimmed.keys) < len(everything.keys)
    for t in texts:
        assert trimmed.find(t, 0.5) == everything.find(t, 0.5)


def test_template_text_in_an_article_is_no_main_text(spark):
    body = "<html><body><div>menu</div><{0}><h1>Title {1}</h1><div><p>Buy our new plan today</div><p>Story {1} begins</p><p>and ends {1}</p></{0}></body></html>"
    pages = spark.createDataFrame([(i, f"http://{e}.com/{i}", body.format(e, i)) for e in ("article", "main") for i in range(8)], "page_id long, url string, html string")
    got = html_text.extract_text(pages).collect()
    assert len(got) == 16 and all(r["text"] == "Title {0}\nStory {0} begins\nand ends {0}".format(r["page_id"]) for r in got)


def test_words_outside_the_frequent_ones_reach_a_group_for_every_class(spark):
    rows = [(f"a{i} b{i} " * 20 + f"a{i} rare{i}x{j} b{i}",) for i in range(12) for j in range(5)]
    train = spark.createDataFrame(rows, "text string")
    model = brown.learn_classes(train, frequent=24, classes=12)
    assert model.groups == model.fine == 12
    rows = train.coalesce(1).selectExpr("cast(null as long) doc_id", "false held_out", "text")
    blocks = brown._blocks(rows, model, 2_000)
    blocks = blocks.withColumn("block", F.shiftright("place", brown._LOCAL))
    assert blocks.where("seq is not null").count() == 60 and blocks.select("block").distinct().count() > 3
    words = blocks.where("seq is null")
    at = {r["place"]: r["h"] for r in words.collect()}
    placed = [(at[r["place"]], r["is"]) for r in brown._placed_words(words, model).collect()]
    of = {(i, known >> 1 & 0x7FFFF) for i in range(12) for j in range(5) for h, known in placed if h == brown.word_hash(f"rare{i}x{j}".encode())}
    groups = {i: {g for k, g in of if k == i} for i in range(12)}
    near = {i: {int(model.follow[[model.group_of_word[model.ids[w]] for w in (f"a{i}".encode(), f"b{i}".encode())]].sum(0).argmax())} for i in range(12)}
    assert groups == near and len(set().union(*groups.values())) > 6
    assert model.counts.tolist() == [105] * 24 and sum(known & 1 for _, known in placed) == len({h for h, _ in placed}) == 60


def test_frequent_words_are_counted_whole(spark):
    def texts(parts):
        for part in parts:
            yield (" ".join(f"p{part}w{i} p{part}w{i}" for i in range(4_100)) + " everywhere",)

    docs = spark.createDataFrame(spark.sparkContext.parallelize(range(6), 6).mapPartitions(texts), "text string")
    assert brown._frequent(brown.word_counts(docs), 1) == ([b"everywhere"], [6])


def test_class_scores_are_products_of_probabilities_that_sum_to_one(spark):
    """Every word is frequent here: the score by the formula, word by word, and the sum over all words after each word."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 30, 40)) for _ in range(50)] + ["", "w1 new w2", "new other"]
    rows = spark.createDataFrame([(i, t, i >= 50) for i, t in enumerate(texts)], "doc_id long, text string, out boolean")
    train = rows.where("not out").select("text")
    model = brown.learn_classes(train, 100, 6)
    assert len(model.ids) == 30 and model.fine == 6
    counts, pairs = Counter(), Counter()
    kind = lambda w: model.start if w is None else model.end if w is False else int(model.of[model.ids[w]]) if w in model.ids else model.unknown
    for t in texts[:50]:
        words = [None, *t.encode().split(), False]
        counts.update(words[1:])
        pairs.update((kind(x), kind(y)) for x, y in zip(words, words[1:], strict=False))
    size = Counter()
    for w, n in counts.items():
        size[kind(w)] += n
    types = Counter(kind(w) for w in counts if w is not False)
    total = sum(size.values())
    share = {c: (size[c] + 1e-3 if c not in (model.start, model.unknown) else 0.0) for c in range(model.width)}
    share = {c: v / sum(share.values()) for c, v in share.items()}

    def step(before, c):
        if before == model.unknown:
            return share[c]
        return (pairs[before, c] + brown.MIX * share[c]) / (sum(pairs[before, x] for x in range(model.width)) + brown.MIX)

    def chance(before, word):
        b, c = kind(before), kind(word)
        if c == model.unknown:
            return max(0.1 / (total + 1), sum(step(b, x) * brown.DISCOUNT * types[x] / size[x] for x in range(model.fine)))
        return step(b, c) * (1 if word is False else (counts[word] - brown.DISCOUNT) / size[c])

    for before in (None, b"w1", b"w7", b"new"):
        assert sum(chance(before, w) for w in [*model.ids, False, b"new"]) == pytest.approx(1, abs=1e-3)
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(rows, F.col("out"), frequent=100, classes=6, block_bytes=700).collect()}
    for i, t in enumerate(texts):
        words = [None, *t.encode().split(), False]
        assert got[i] == pytest.approx(sum(np.log10(chance(x, y)) for x, y in zip(words, words[1:], strict=False)), abs=1e-6)


def test_clustered_words_and_classes_grow_with_the_vocabulary():
    sizes = [brown.sizes_for(v) for v in (0, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and len(set(sizes[1:])) == 3


def test_a_blocked_target_that_is_no_page_blocks_its_aliases(spark):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/es/1">'), (2, "http://c.org/q", "<link rel=canonical href=http://a.org/x>"), (3, "http://d.com/z", '<link rel="canonical" href="http://b.net/es/1">'),
        (4, "http://e.org/y", '<meta http-equiv="refresh" content="0; url=http://F.Net/fr/?q#f">'), (5, "http://g.org/", '<link rel="canonical" href="http://b.net/en/1">'), (6, "http://h.org/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow"}
    for rules in (urls.RULES, [*urls.RULES, *((f"x{i}.info", "/", "block") for i in range(80))]):
        assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, rules).collect()} == want


def alias_pages(spark):
    """Chains, hubs, cycles and targets outside the table, over hosts that rules fit or not."""
    rng = np.random.default_rng(9)
    hosts = ["a.org", "B.net", "c.com", "www.example.com", "example.com", "d.net", "e.org"]
    paths = ["", "/", "/es/1", "/fr/", "/en/x", "/p?q=1", "/fr"]
    url = lambda: f"http://{hosts[rng.integers(len(hosts))]}{paths[rng.integers(len(paths))]}" if rng.random() < 0.5 else f"https://e.org/n{rng.integers(400)}"
    rows = []
    for i in range(600):
        target = ["", f'<link rel="canonical" href="{url()}">', f'<meta http-equiv=refresh content="0; url={url()}">', '<link href="/hub" rel="canonical">', '<LINK REL=canonical HREF="//d.net/es/out">'][int(rng.choice(5, p=[0.5, 0.25, 0.2, 0.03, 0.02]))]
        rows.append((i, url() if i % 50 else None, f"<html>{target}</html>" if i % 7 else None))
    rows += [(1000 + i, f"http://x.org/{i}", f'<link rel=canonical href="http://x.org/{i + 1}">') for i in range(40)] + [(2000, "http://x.org/40", '<link rel=canonical href="http://x.org/0">'), (2001, "http://x.org/20", '<link rel=canonical href="http://d.net/es/z#f">')]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_url_verdicts_against_brute_force_and_sql(spark, tmp_path):
    pages = alias_pages(spark)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    rows = [(r["page_id"], r["url"] or "") for r in pages.collect()]

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        return (m[1].lower(), m[2]) if m else ("", "")

    def best(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits) if fits else (0, None, None)

    edges = defaultdict(set)
    for r in urls.alias_edges(pages).collect():
        edges[r["a"]].add(r["b"])
        edges[r["b"]].add(r["a"])
    bad = [n for n in edges if best(*parts("http://" + n))[2] == "block"]
    reached = set(bad)
    while bad:
        bad = [m for n in bad for m in edges[n] if m not in reached and not reached.add(m)]
    assert len(reached) > 40

    def node(url):
        host, rest = parts(url)[0], (re.match(r"(?s).*?://[^/?#]*([^#]*)", url) or [None, ""])[1]
        return host and host + (rest or "/")

    want = {i: (best(*parts(u))[1], best(*parts(u))[2] or ("block" if node(u) in reached else "allow")) for i, u in rows}
    assert got == want and sum(r is None and v == "block" for r, v in got.values()) > 40
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: (r[3], r[4]) for r in con.execute(queries.oracle_sql()["op9_url_filter"]).fetchall()} == got


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_layouts_of_few_pages_of_a_host_are_templates(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_TOKENS", broadcast)
    body = "<html><body><div class='x{0}'><p>Our offers of layout {0} are long and stand before everything else on the page</p><p>Call layout {0} now</p></div><div class='y{0}'><p>Story {1} begins and goes on</p><p>and ends {1}</p></div></body></html>"
    same = "<html><body><div><p>Notice {0} that every page of this section shows to all of its readers</p><p>Second line {0}</p><p>Text {1} begins</p><p>and ends {1}</p></div></body></html>"
    rows = [(i, f"http://one.com/{i}", body.format(i % 5, i)) for i in range(40)] + [(100 + i, f"http://two.com/{i}", same.format(i % 5, i)) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert got == {i: f"Story {i} begins and goes on\nand ends {i}" for i in range(40)} | {100 + i: f"Text {i} begins\nand ends {i}" for i in range(150)}


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, _stay int, _place int, `a.b` string, row int, h string, t string, doc_id2 long, root int, shard string, slot string, size string, copies string, k string, u string, whole string, held_out string"


def clashing(spark):
    rows = [(1, "the cat sat on the mat and looked"), (1, "the cat sat on the mat and looked"), (1, "quite another text for this id here"), (2, None), (3, ""), (None, "a null id with some more words"), (None, None), (4, "one"), (5, "the cat sat on the mat and looked")]
    return spark.createDataFrame([(i, t, None, None, None, "MINE", "P", 1, 2, "dot", 3, "h", "t", 9, 4, "s", "l", "z", "c", "k", "u", "w", "x") for i, t in rows], CLASHES)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_of_any_name(spark, empty):
    docs = clashing(spark).limit(0) if empty else clashing(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "a null id with some more"), (None, None)], "item_id long, text string")
    good = quality.keep_good(docs, quality.learn_quality(docs, labels))
    single = jaccard_join.keep_one(docs)
    clean = decontam.without_leaks(docs, bench)
    mixed = mixing.mix_sources(docs, expand=True)
    for out in (good, single, clean, mixed):
        assert out.columns == docs.columns
        assert all(r["score"] == "MINE" and r["a.b"] == "dot" and r["_stay"] == 1 and r["_place"] == 2 for r in out.collect())
    want = [] if empty else [(None, None), (None, "a null id with some more words"), (1, "quite another text for this id here"), (1, "the cat sat on the mat and looked"), (2, None), (3, ""), (4, "one")]
    assert sorted(((r["doc_id"], r["text"]) for r in single.collect()), key=str) == sorted(want, key=str)
    assert clean.count() == (0 if empty else 8)
    placed = sharding.shard_documents(docs, 3)
    assert {"score", "a.b", "shard", "slot", "grown_shard"} <= set(placed.columns) and placed.count() == docs.count()


def test_shards_are_written_in_the_order_of_slots(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sharding.write_shards(sharding.shard_documents(docs, 4, bucket_bytes=500), str(tmp_path / "out"))
    for shard in range(4):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots))) and slots


@pytest.mark.parametrize("num", [50, 60])
def test_links_of_low_thresholds_are_found(num):
    rng = np.random.default_rng(num)
    signer = jaccard_join.Signer(num, 100, np.zeros(0, dtype=np.uint64))
    for size in (2, 5, 20, 60, 200):
        for _ in range(200):
            a = np.unique(rng.integers(1, 1 << 62, size, dtype=np.uint64))
            lost = int(rng.integers(0, size))
            b = np.unique(np.concatenate([a[lost:], rng.integers(1, 1 << 62, int(rng.integers(0, size)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and both:
                assert len(np.intersect1d(signer(a), signer(b)))


@pytest.mark.parametrize("num", [80, 90])
def test_every_linked_pair_shares_a_signature(num):
    rng = np.random.default_rng(num)
    common = np.sort(rng.integers(1, 1 << 62, 50, dtype=np.uint64))
    signer = jaccard_join.Signer(num, 100, common, rng.integers(1, 9, 50))
    linked = 0
    for size in (1, 3, 9, 30, 45, 52, 70, 120, 500):
        for _ in range(150):
            a = np.unique(np.concatenate([rng.choice(common, min(size // 3, 50)), rng.integers(1, 1 << 62, size, dtype=np.uint64)]))
            cut = int(rng.integers(0, len(a) // 4 + 1))
            b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), cut, replace=False)), rng.integers(1, 1 << 62, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= num * (len(a) + len(b) - both):
                linked += 1
                assert len(np.intersect1d(signer(a), signer(b)))
    assert linked > 200


def test_a_hot_group_is_joined_without_all_its_pairs(spark, monkeypatch):
    """Blocks of a few documents: chains across blocks, a large component and some small ones in one group."""
    monkeypatch.setattr(jaccard_join, "SPLIT", 5)
    rng = np.random.default_rng(4)
    texts = {}
    base = [f"w{i}" for i in range(60)]
    for g in range(3):
        for c in range(30 if g == 0 else 6):
            words = base[:40] + [f"g{g}x{i}" for i in range(8)]
            words[int(rng.integers(0, 40))] = f"n{rng.integers(10**6)}"
            texts[len(texts)] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_classes(docs, n=1, num=85).collect()}
    sets = {i: set(t.split()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 1


def read(*bodies, host="h.com"):
    return [(i, f"http://{host}/{i}", b) for i, b in enumerate(bodies)]


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}


def test_nothing_of_an_article_goes_for_its_id_or_class(spark):
    body = (
        "<body><div class='site-nav'><p>menu</p></div><article><h2 id='search-methods'>Search {0}</h2><p id=related>Related {0}</p><p class='share-price'>Price {0}</p><table class=tags><tr><td>Cell {0}</table>"
        "<section id='notice-period'><p>Term {0}</p></section><p>x <math><mi>y{0}</mi></math></p><p title=it's>Quote {0}</p><div class='comment-list'><p>me too {0}</p></div><div class=related><p>see {0}</p></div></article></body>"
    )
    got = texts_of(spark, read(*(body.format(i) for i in range(6))))
    assert got == {i: f"Search {i}\nRelated {i}\nPrice {i}\nCell {i}\nTerm {i}\nx y{i}\nQuote {i}" for i in range(6)}


def test_articles_of_one_place_are_all_kept(spark):
    body = "<body><main><article><p>First part {0} is the longer one</p></article><article><p>Second {0}</p></article></main><aside><article><p>Teaser {0}</p></article></aside></body>"
    assert texts_of(spark, read(*(body.format(i) for i in range(3)))) == {i: f"First part {i} is the longer one\nSecond {i}" for i in range(3)}


def test_slots_decide_without_elements_or_names_that_tell(spark):
    """Boxes named at random: what repeats is template, what varies most over the host is the text, also in a page where it is short."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(12):
        story = " ".join(f"s{rng.integers(999)}" for _ in range(80 if i else 4))
        rows.append(f"<body><div class=q1><p>Always here at the top</p><p>Call us now</p></div><div class=q2><p>{story}</p><p>End {i} of it</p></div><div class=q3><p>Printed on day {i} of the year at the press</p></div><div class=q4><p>All rights are ours</p></div></body>")
    got = texts_of(spark, read(*rows))
    for i, body in enumerate(rows):
        assert got[i] == re.search("q2><p>(.*?)</p>", body)[1] + f"\nEnd {i} of it"


def test_templates_are_the_classes_of_equal_vectors(spark):
    """The template's tokens against a deduction from whole vectors, and lone texts that nesting leaves in the slots."""
    rng = np.random.default_rng(2)
    bodies = []
    for i in range(30):
        parts = ["<div class=a><p>Top line</p><p>Second line</p></div>"] * (1 + i % 2) + [f"<ul>{'<li>Item</li>' * int(rng.integers(1, 4))}</ul>"] + (["<div class=b><p>Only some pages</p></div>"] if i % 3 == 0 else []) + [f"<div class=c><p>Text {i}</p></div>"]
        bodies.append("<body>" + "".join(parts) + "</body>")
    pages = spark.createDataFrame([("h", b, i) for i, b in enumerate(bodies)], "host string, html string, pid long")
    seen = html_text.host_tokens(pages)
    got = {r["token"]: r["cls"] for r in html_text.host_templates(seen, pages.groupBy("host").agg(F.count(F.lit(1)).alias("of")), 0.3, 4, 2).collect()}
    vectors, tags = defaultdict(lambda: [0] * 30), set()
    for i, b in enumerate(bodies):
        for token, n, tag, _, _ in html_text.page_tokens(b):
            vectors[token][i] = n
            tags |= {token} if tag else set()
    classes = defaultdict(set)
    for token, v in vectors.items():
        classes[tuple(v)].add(token)
    want = {t for v, ts in classes.items() if sum(x > 0 for x in v) >= 4 and len(ts) >= 2 and (sum(x > 0 for x in v) >= 9 or ts & tags) for t in ts}
    assert set(got) == want and len({got[t] for t in want}) == len({tuple(vectors[t]) for t in want})
    blocks = html_text.parse("<body><div class=a><p>Top line</p></div><div class=z><p>Alone</p></div></body>")[1]
    top, alone = (html_text.token_hash(b.path, b.text) for b in blocks)
    boxes = [html_text._OPENING[b.stack[-2][4]] for b in blocks]
    assert html_text.template_texts(blocks, {top: 1, boxes[0]: 1, alone: 2}) == {top}
    assert html_text.template_texts(blocks, {top: 1, boxes[0]: 1, alone: 2, boxes[1]: 2}) == {top, alone}


def test_word_numbers_survive_packing():
    rng = np.random.default_rng(3)
    for seq in ([], [0], [32767, 32768, 0, 65535, 65536, 98304, (1 << 29) + 7, 5], [32768] * 3, rng.integers(0, 1 << 30, 5_000), rng.integers(0, 60_000, 5_000)):
        seq = np.array(seq, dtype=np.int64)
        assert brown._unpacked(brown._packed(seq)).tolist() == seq.tolist()


def test_neighbours_of_a_word_beyond_sixteen_bits_count_whole(spark):
    rows = spark.createDataFrame([(None, False, "a mid b " * 70_000)], "doc_id long, held_out boolean, text string")
    model = brown.learn_classes(rows.select("text"), 2, 2)
    assert sorted(model.ids) == [b"a", b"b"]
    near = [r["near"] for r in brown._blocks(rows, model, 1 << 30).where("seq is null").collect()]
    counts = np.frombuffer(near[0], dtype="<u4").astype(np.int64)
    assert len(near) == 1 and counts[0] == 70_000 and (counts[1:] >> 16).sum() == 140_000 and len(counts) == 5
