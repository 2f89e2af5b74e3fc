"""The training-data operators: edge cases with defined results, and brute force where SQL can't tell."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake.llm import brown, decontam, html_text, jaccard_join, language, minhash_order, mixing, quality, queries, sharding, urls
from siglake.llm.common import bound_batches, held_out, table
from siglake.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, size string, score string, row int, h string, copies int, k map<string,int>"


def odd(spark, empty=False):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like working ones."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "a null id with words", "en", None, 1),
        (4, words, "en", "b", 1), (5, words, "de", "b", 1), (6, "  \t\n ", "fr", "c", 1), (7, "one", "en", "a", 1), (8, "...!!! 123", None, "a", 1), (1, "another text for the first id", "en", "c", 1),
    ]
    return spark.createDataFrame([] if empty else [(*r, "s", 1, "z", "q", 7, "h", 2, {"x": 1}) for r in rows], SCHEMA)


def documents(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_sharding(spark, empty):
    docs = odd(spark, empty)
    out = sharding.shard_documents(docs, 4, bucket_bytes=50_000).collect()
    assert len(out) == (0 if empty else 11)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 4)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) <= 1


def test_sharding_by_key_and_number_alone(spark):
    got = {r["doc_id"]: r for r in queries.op1_shards(spark, SF).collect()}
    texts = documents(spark)
    assert all(r["text_crc32"] == zlib.crc32((texts[i] or "").encode()) and r["size"] == len((texts[i] or "").encode()) + 1 for i, r in got.items())
    again = sharding.shard_documents(table(spark, SF, "documents"), 17)
    assert all(r["shard"] == got[r["doc_id"]]["grown_shard"] for r in again.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(spark, empty):
    docs = odd(spark, empty)
    out = mixing.mix_sources(docs).collect()
    assert len(out) == (0 if empty else 11)
    assert all(r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] + 1e-9 for r in out)
    assert mixing.mix_sources(docs, expand=True).count() == sum(r["copies"] for r in out)
    assert mixing.mix_sources(docs, expand=True).columns == docs.columns


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(map(str, got[sorted(got)].itertuples(index=False))) == sorted(map(str, want[sorted(got)].itertuples(index=False)))


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2100)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}


def test_urls(spark):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/es/1">'), (2, "http://b.net/es/1", None), (3, "http://c.com/1", '<meta http-equiv="refresh" content="0; url=/2">'), (4, "http://c.org/q", "<link rel=canonical href=http://a.org/x#f>"),
        (5, None, None), (6, "nope", ""), (7, "HTTP://WWW.Example.COM/en/?a", ""), (8, "http://d.com/z", '<link rel="canonical" href="http://b.net/es/1">'),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert got == {
        1: ("a.org", None, "block"), 2: ("b.net", "net/es/", "block"), 3: ("c.com", "com/", "allow"), 4: ("c.org", None, "block"), 5: ("", None, "allow"), 6: ("", None, "allow"), 7: ("www.example.com", "www.example.com/en/", "allow"), 8: ("d.com", "com/", "allow"),
    }
    many = [*urls.RULES, *((f"x{i}.info", "/", "block") for i in range(80))]
    assert {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, many).collect()} == got
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_main_text(spark):
    body = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>home</a></nav><div class='cookie notice'>We use cookies</div><article><h1>Head &amp; tail</h1><p>One  <b>two</b>\n three<br><p>Four &lt;five&gt;</article><section id=comments><p>me too</p></section><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(i, "http://h.com/1", body, "x") for i in range(6)] + [(10, None, None, "x"), (11, "http://e.com", "", "x"), (12, "http://f.com", "<div>" + "<p>word " * 20_000, "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert all(got[i] == "Head & tail\nOne two three\nFour <five>" for i in range(6))
    assert got[10] == "" and got[11] == "" and got[12].count("word") == 20_000
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = odd(spark), spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 0, None), (None, 1, 1), (5, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    ranking = quality.learn_quality(docs, labels)
    out = quality.score_quality(docs, ranking).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert quality.score_quality(docs.limit(0), quality.learn_quality(docs, labels.limit(0))).count() == 0


def test_quality_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    rows = [(r["quality"], got[r["doc_id"]]) for r in table(spark, sf, "labels").collect()]
    held = [(q, g) for q, g in rows if g["held_out"]]
    assert np.mean([q == g["predicted"] for q, g in held]) > 0.93


def test_language(spark):
    docs = odd(spark)
    profiles = language.learn_profiles(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify_language(docs, profiles).collect()]
    assert {p for i, p, _ in got if i in (2, 3, 6, 8)} == {"und"} and all(0 <= s <= 1 for _, _, s in got)
    assert language.identify_language(docs.limit(0), language.learn_profiles(docs.limit(0))).count() == 0
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    held = [r for r in queries.op3_language(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.95


def test_alignment_against_the_full_matrix():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(1, 5, 12), rng.integers(1, 5, 20)
        h = np.zeros((13, 21))
        for i in range(1, 13):
            for j in range(1, 21):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b)[0] == h.max()


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    edited = item.replace("delta", "DELTA!").replace("iota", "other").replace("mu", "")
    rows = [(1, "before " * 50 + item + " after" * 50), (2, "x y z " + edited), (3, "nothing of it here at all"), (4, None), (5, ""), (None, item), (6, "w " * 200_000 + item), (1, "before " * 50 + item + " after" * 50)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, score string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "two words"), (None, item)], "item_id long, text string")
    got = decontam.find_leaks(docs, bench).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 4, 2: 2, None: 2, 6: 2} and {r["item_id"] for r in got} == {10, None}
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["score"], first["first_word"], first["last_word"]) == (1.0, 50, 65)
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5}
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0
    blocks = decontam.find_leaks(docs, bench, block_bytes=40)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got))
    assert {r["doc_id"] for r in decontam.without_leaks(docs, bench, block_bytes=40).collect()} == {3, 4, 5}


def test_short_items_are_found_apart(spark):
    docs = spark.createDataFrame([(1, "here are Two words."), (2, "two, words; and two words"), (3, "twowords"), (None, "two words"), (4, None), (2, "Paris"), (5, "words two")], "doc_id long, text string")
    bench = spark.createDataFrame([(13, "two words"), (14, "paris!"), (15, ""), (16, None), (17, "two words and")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"]) for r in decontam.find_short_items(docs, bench).collect()}
    assert got == {(1, 13, 2), (2, 13, 0), (None, 13, 0), (2, 14, 0)}
    assert decontam.find_short_items(docs.limit(0), bench).count() == 0


def test_copies_with_many_foreign_words_are_found():
    rng = np.random.default_rng(8)
    for size in (12, 25, 40):
        item = [f"i{k}" for k in range(size)]
        items = decontam.Items([(7, " ".join(item))])
        for _ in range(60):
            words = [w for w in item if rng.random() > 0.08]
            for _ in range(int(rng.integers(1, 4))):
                at = int(rng.integers(0, len(words) + 1))
                words[at:at] = [f"f{rng.integers(10**6)}" for _ in range(int(rng.integers(0, size // 2 + 3)))]
            passage = [f"b{k}" for k in range(60)] + words + [f"e{k}" for k in range(60)]
            want = decontam.align(items.items[0][1], items.ids(" ".join(passage)))[0] / (2 * size)
            got = items.find(" ".join(passage), 0.5)
            assert ([g[1] for g in got] == [want]) if want >= 0.5 and items.seen(" ".join(passage)).size else not got


def test_seeds_stay_where_they_are_rare_for_their_item():
    rng = np.random.default_rng(2)
    items = decontam.Items([(i, " ".join(f"w{w}" for w in rng.integers(0, 300, rng.integers(1, 40)))) for i in range(60)])
    keys, owner = items.keys.copy(), items.owner.copy()
    documents = {int(k): int(rng.integers(0, 90)) for k in keys}
    counts = np.array([documents[int(k)] for k in keys])
    want = [j for j in range(len(keys)) if counts[j] <= max(20, 2 * np.median(counts[owner == owner[j]]))]
    items.keep_rare(documents)
    assert 0 < len(want) < len(keys) and items.keys.tolist() == keys[want].tolist() and items.owner.tolist() == owner[want].tolist()
    decontam.Items([]).keep_rare({})


def test_decontamination_against_alignment_of_every_pair(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = {}
    for item in bench.collect():
        block = decontam.Items([(item["item_id"], item["text"])])
        for d in docs.collect():
            score = decontam.align(block.items[0][1], block.ids(d["text"]))[0] / (2 * len(block.items[0][1]))
            if score >= decontam.LEAK:
                want[d["doc_id"], item["item_id"]] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op4_decontamination(spark, SF).collect()}
    assert want and got == want


def test_exchange_parts_what_never_meets():
    m = np.zeros((8, 8))
    for a, b in ((0, 1), (2, 3)):
        for i in (a, a + 4):
            for j in (b, b + 4):
                m[i, j] = m[j, i] = 10
    of = brown.exchange(m, 4)
    assert all(of[i] == of[i + 4] for i in range(4)) and len(set(of[:4])) == 4


def test_language_model(spark):
    got = {r["doc_id"]: r for r in queries.op5_language_model(spark, SF).collect()}
    texts, counts = documents(spark), Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(brown.tokens(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words = [*brown.tokens(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert abs(got[i]["base_score"] - base) < 1e-6 and got[i]["n_tokens"] == len(words) and got[i]["n_known"] == sum(counts[w] > 0 for w in words) and got[i]["train_tokens"] == n
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    out = brown.score_texts(odd(spark), held_out(F.col("doc_id"), 10, 0)).collect()
    assert len(out) == 11 and all(r["score"] <= 0 for r in out)
    assert brown.score_texts(odd(spark, True), F.lit(False)).count() == 0


def test_batches_are_bounded_unless_the_session_has_its_own_bound(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "123456")
        bound_batches(spark)
        assert spark.conf.get(key) == "123456"
        spark.conf.unset(key)
        bound_batches(spark)
        assert int(spark.conf.get(key)) == 4 << 20
    finally:
        if before is not None:
            spark.conf.set(key, before)


def classes(texts, n, num):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i in sorted(sets):
        both = Counter(m for g in sets[i] for m in held[g])
        for g in sets[i]:
            held[g].append(i)
        for m, b in both.items():
            if 100 * b >= num * (len(sets[i]) + len(sets[m]) - b):
                x, y = find(i), find(m)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    """Groups of near copies that chain, share passages and have many common words; more than one block of them."""
    rng, texts = np.random.default_rng(3), {}
    for g in range(6):
        base = [f"t{g}w{i}" for i in rng.integers(0, 400, 120)]
        for c in range(450 if g == 0 else 12):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 9)):
                words[at] = f"n{rng.integers(0, 10**6)}"
            texts[len(texts)] = " ".join(words)
    for k in range(40):
        texts[len(texts)] = "a passage that many share with some more words to it " * 3 + " ".join(f"u{k}v{i}" for i in range(k))
    for k in range(12):
        texts[len(texts)] = " ".join(f"s{i}" for i in range(k))
    return texts


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_join_against_all_pairs(spark, n, num):
    for texts in (near_copies(), documents(spark)):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_classes(docs, n=n, num=num).collect()}
        assert got == classes(texts, n, num)


@pytest.mark.parametrize("empty", [False, True])
def test_jaccard_join_on_odd_rows(spark, empty):
    out = jaccard_join.link_classes(odd(spark, empty)).collect()
    assert len(out) == (0 if empty else 11)
    if not empty:
        assert {r["component_id"] for r in out if r["doc_id"] in (4, 5)} == {4}
        kept = jaccard_join.keep_one(odd(spark))
        assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 6, 7, 8]


def test_order_minhash(spark):
    got = {r["doc_id"]: r for r in queries.op8_order_minhash(spark, SF).collect()}
    rows = sorted(documents(spark).items())
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 2
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.1 > np.mean([r["near_next"] for r in got.values()])
    by = defaultdict(set)
    for i, t in rows:
        by[t].add(got[i]["fingerprint"])
    assert all(len(s) == 1 for s in by.values())


def test_order_minhash_tells_order_and_occurrence(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in [*range(100, 200), *range(100)])
    rows = spark.createDataFrame([(a, a), (a, b), (a, ""), ("", ""), ("x", "x")], "a string, b string")
    got = [r[0] for r in rows.select(minhash_order.likeness(minhash_order.signature(F.col("a")), minhash_order.signature(F.col("b")))).collect()]
    assert got[0] == 1 and 0.2 < got[1] < 0.9 and got[2] == 0 and got[3] == 1 and got[4] == 1
    for empty in (False, True):
        assert minhash_order.edit_probe(odd(spark, empty)).count() == (0 if empty else 11)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    good = corpus_pipeline.quality(spark, docs, sf)
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() < docs.count()
    single = corpus_pipeline.near_duplicates(spark, docs, sf)
    found = classes({r["doc_id"]: r["text"] for r in docs.collect()}, 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in found.items() if i == c}
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    items = [decontam.words_of(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    joined = [b" " + b" ".join(w) + b" " for w in items]
    for r in clean.collect():
        whole = b" " + b" ".join(decontam.words_of(r["text"])) + b" "
        assert not any(w in whole for w in joined)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
