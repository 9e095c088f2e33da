"""Every operator on tiny tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.llm import html, jaccard, language, lines, mixing, packing, quality, secrets, vectors
from docfields.llm.common import components, two_level_rank
from docfields.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_row` long, `key` string, `rank` int, `bucket` int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, len(t or ""), 1, "k", 2, 3) for d, t, lang, src in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, ("The " if i % 2 else "le ") + words(rng, rng.randint(1, 60)) + ".\n" + words(rng, 12), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(60)]
    out += [(100, None, None, None), (101, "", "en", None), (102, " \n\t ", None, "s1"), (103, out[0][1], "en", "s2"), (103, out[0][1], "en", "s2")]
    return out + [(104, words(rng, 20_000), "fr", "s3"), (None, "no id here at all, none", "en", "s0"), (105, "password = hunter22 " * 3, "en", "s0")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_two_level_rank_and_components(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = two_level_rank(df, "k", 500, ["id"]).groupBy("k").agg(F.collect_set("rank").alias("r"), F.count("*").alias("n")).collect()
    assert all(sorted(r["r"]) == list(range(r["n"])) for r in got)
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (9, 9), (3, 1), (12, 11), (11, 10), (10, 13)], "a long, b long")
    assert {r["id"]: r["component_id"] for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 10: 10, 11: 10, 12: 10, 13: 10}


def test_html():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><!-- x --><div class='ad'>Buy</div>"
        "<article><h1>A &amp; B</h1><p>one  two<b>three</b><br>four<p>short</p><div class=comments><p>Nice of you to say it and more of it</p></div></article><footer>f</footer>"
    )
    assert html.main_text(page) == "A & B one twothree four short"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    assert html.main_text("<script>var a = '</p>'") == ""


def test_html_wrappers_and_hidden():
    body = "<article><p>one two three four five six seven eight nine ten eleven twelve</p></article>"
    for name in ("content-area has-sidebar", "layout with-sidebar", "post tag-social", "content-sidebar-wrap"):
        assert html.main_text(f'<div class="{name}">{body}</div>').startswith("one two")
    for attribute in ('style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"'):
        assert html.main_text(f"<div {attribute}>{body}</div>").startswith("one two")
    for attribute in ("hidden", 'aria-hidden="true"', 'style="color:red; display: none"', 'class="sidebar"', 'class="comments-area"', 'class="has-x comments"'):
        assert html.main_text(f"<div {attribute}>{body}</div>") == ""


def test_html_of_languages_without_stop_words():
    menu = "<ul><li><a href='/'>Главная</a><li><a href='/n'>Новости</a></ul>"
    russian = "Сегодня утром жители города увидели первый снег, который выпал намного раньше обычного срока и быстро растаял под ярким солнцем."
    polish = "Dzisiaj rano mieszkańcy miasta zobaczyli pierwszy śnieg, który spadł znacznie wcześniej niż zwykle, lecz szybko stopniał pod jasnym słońcem."
    for text in (russian, polish, "今日の朝、町の人々は初めての雪を見ました。いつもよりずっと早く降り、明るい太陽の下ですぐに溶けてしまいました。"):
        assert html.main_text(f"<div>{menu}<p>{text}</p></div>") == text


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article><p>a b", "y")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert got == {1: ("", 0), None: ("a b", 3)}
    assert html.extract(df.limit(0)).count() == 0


def test_hostile_texts_take_no_time(spark):
    import re
    import time

    began = time.time()
    for page in ("<a '" * 300_000, "<aaa" * 300_000, "<!" * 500_000, "<script " * 200_000, "<p>x y</p>" * 50_000, "<a href='" + "x" * 2_000_000):
        html.main_text(page)
    assert html.main_text("<article><p title=it's>" + "The house of the people and the cat is in it. " * 3 + "</p></article>").startswith("The house")
    assert language.runs_of("½ ² 12 Ⅷ") == [] and language.runs_of("x½Y é") == ["x", "y", "é"]
    for rule in secrets.MORE:
        for text in ("x" * 500_000, "eyJ" * 200_000, "a://" * 200_000, "-----BEGIN " + "A " * 200_000, " " * 1_000_000):
            re.findall(rule.compiled(), text)
    assert time.time() - began < 60


def test_language_of_held_out_documents(spark):
    rng, data = random.Random(6), []
    lexicons = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(150)] for lang, letters in (("en", "etaoinshrdlu"), ("pl", "ązęókwyżiaeo"), ("el", "αβγδεζηικλμ"))}
    for i in range(240):
        lang = rng.choice(list(lexicons))
        data.append((i, " ".join(rng.choice(lexicons[lang]) for _ in range(30)), lang, "s"))
    got = {r["doc_id"]: r for r in language.identify(table(spark, data + [(900, "½ ² 12", None, None)])).collect()}
    held = [d for d in data if got[d[0]]["held_out"]]
    assert got[900]["lang_pred"] == "und" and len(held) > 25
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in held) >= 0.95 * len(held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in data)


def test_language(docs, empty, rows):
    net, names = language.fit(docs, per_language=50)
    got = language.predict(docs, net, names).collect()
    assert len(got) == len(rows) and names == ["en", "fr"]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[100]["lang_pred"] == by_id[102]["lang_pred"] == "und" and by_id[100]["score"] == 0.0
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(empty).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(10 * k + i, f"word{chr(97 + k % 26)} {chr(97 + k // 26)}", f"l{k:03}", "s") for k in range(70) for i in range(10)]
    asked = {}
    monkeypatch.setattr(language, "train", lambda samples, classes, **sizes: asked.update(sizes, classes=classes, seen={k for _, k in samples}))
    _, names = language.fit(table(spark, rows))
    assert names == [f"l{k:03}" for k in range(70)]
    assert asked["classes"] == 70 and asked["seen"] == set(range(70)) and asked["hidden"] > 16 and asked["steps"] > 1200


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.Network(3, 4, 1)
    for p in net.parameters():
        p[...] = rng.standard_normal(p.shape) * 0.3
    codes, label = rng.integers(97, 101, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.step(codes, label)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, eps = p[at].copy(), 1e-2
        p[at] = keep + eps
        up, _ = net.step(codes, label)
        p[at] = keep - eps
        down, _ = net.step(codes, label)
        p[at] = keep
        assert abs((up - down) / (2 * eps) - g[at]) < 0.02 * max(1.0, abs(g[at]))


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(docs, empty, rows):
    got = mixing.digest(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, src in rows:
        sizes[src] = sizes.get(src, 0) + len((t or "").split())
    want = brute_targets(sizes)
    src_of = {(d, len((t or "").split())): s for d, t, _, s in rows}
    taken = {}
    for r in got:
        s = src_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.digest(docs).collect()), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    n = mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert n == sum(taken.values())
    assert mixing.digest(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_comes_through_its_tree(spark, docs, monkeypatch):
    mixed = mixing.mix(docs, block_words=64, shards=8).collect()
    for r in mixed:
        spans = sorted((p["epoch"], p["first_word"], p["last_word"]) for p in r["pieces"])
        assert all(0 <= lo < hi <= r["size"] for _, lo, hi in spans)
        assert all(a[0] < b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))  # no word twice in a pass
    shards = {p["shard"] for r in mixed for p in r["pieces"]}
    assert shards == set(range(8))
    words = sum(p["last_word"] - p["first_word"] for r in mixed for p in r["pieces"])
    real = mixing.split_tree
    # a tree whose last shard draws nothing: what the mix takes falls by that shard
    monkeypatch.setattr(mixing, "split_tree", lambda *a: real(*a).withColumn("cumulative", F.transform("cumulative", lambda x, i: F.when(i < 7, x).otherwise(F.col("cumulative")[6]))))
    less = sum(p["last_word"] - p["first_word"] for r in mixing.mix(docs, block_words=64, shards=8).collect() for p in r["pieces"])
    last = sum(p["last_word"] - p["first_word"] for r in mixed for p in r["pieces"] if p["shard"] == 7)
    assert 0 < last and abs(words - last - less) <= 64 * 6


def test_mixed_documents_keep_clashing_columns(spark, docs):
    names = ["d", "r", "k", "n", "no", "number", "pass", "passes", "shard", "salt", "order", "doc", "pieces", "__d"]
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    got = mixing.mixed_documents(wide)
    assert got.columns == wide.columns and {tuple(r[c] for c in names) for r in got.collect()} == {tuple(range(len(names)))}
    assert lines.dedup(wide).select(*names).distinct().count() == 1


def test_split_tree_deals_every_block_once(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 7), ("c", 0), ("d", 333)], "key string, quota long")
    got = {r["key"]: r["cumulative"] for r in mixing.split_tree(quotas, 8).collect()}
    assert {k: v[-1] for k, v in got.items()} == {"a": 1000, "b": 7, "c": 0, "d": 333}
    totals = np.sum([np.diff([0, *v]) for v in got.values()], axis=0)
    assert totals.max() - totals.min() <= 3 and all((np.diff(v) >= 0).all() for v in got.values())


def brute_kn(texts):
    """Negative log probabilities of a text's characters by the definition, over 5 orders."""
    from collections import Counter

    top = quality.ORDER
    c = [Counter() for _ in range(top + 1)]
    for t in texts:
        x = "\n" * (top - 1) + t
        c[top].update(x[i : i + top] for i in range(len(x) - top + 1))
    for n in range(top - 1, 0, -1):
        for g in c[n + 1]:
            c[n][g[1:]] += 1
    d = [None]
    for n in range(1, top + 1):
        k = [max(1, sum(v == i for v in c[n].values())) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        d.append([0] + [min(i - 0.05, max(0.05, x)) for i, x in ((1, 1 - 2 * y * k[1] / k[0]), (2, 2 - 3 * y * k[2] / k[1]), (3, 3 - 4 * y * k[3] / k[2]))])

    def p(g):
        if not g:
            return 1 / (len(c[1]) + 1)
        n, low = len(g), p(g[1:])
        same = {h: v for h, v in c[n].items() if h[:-1] == g[:-1]}
        if not same:
            return low
        total, off = sum(same.values()), sum(d[n][min(v, 3)] for v in same.values())
        v = same.get(g, 0)
        return (v - d[n][min(v, 3)]) / total + off / total * low

    return lambda t: -sum(np.log(p(("\n" * (top - 1) + t)[i : i + top])) for i in range(len(t)))


def test_kneser_ney_against_definition(spark):
    texts = ["abab abc\ncab", "bca abba", "aab", "яблоко и яблоки", "漢字かな漢字", "né né né"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(9, t, "en", "s") for t in ("abba яблок", "漢字 né", "zzz", "", None, "cab\nabc")] + [(None, "aab", None, None)]
    docs = table(spark, rows)
    blocks = quality.packed(docs, 3)
    good = spark.createDataFrame([(i, False) for i in range(len(texts))] + [(9, True)], "doc_id long, check boolean")
    found = quality.gathered(blocks, good.withColumn("block", quality.block_of(F.xxhash64("doc_id"), 3)))
    model = quality.kneser_ney(found.where("kind > 0"))
    answers = found.where("kind = 0").select("block", "gram").join(model, "gram")
    unseen = model.where("gram = -1").first()["p"]
    nll = brute_kn(texts)
    got = sorted((r["n_symbols"], round(r["nll"], 6)) for r in quality.score(blocks, answers, unseen).collect())
    assert got == sorted((len(t or ""), round(nll(t or ""), 6)) for _, t, _, _ in rows)


def test_quality_of_other_scripts(spark):
    rng = random.Random(4)
    data, good = [], []
    for lang, letters in (("en", "etaoinshr"), ("ru", "оеаинтсрв"), ("zh", "的一是不了人我在有他")):
        lexicon = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        for _ in range(120):
            words_of = [rng.choice(lexicon) for _ in range(60)]
            data.append((len(data), ("" if lang == "zh" else " ").join(words_of), lang, "s"))
            good.append((len(data) - 1, 1, 0))
        for _ in range(12):
            garbled = list(data[rng.randrange(len(data) - 100, len(data))][1])
            rng.shuffle(garbled)
            data.append((10_000 + len(data), "".join(garbled), lang, "s"))
    kept = {r["doc_id"]: r["keep"] for r in quality.classify(table(spark, data), spark.createDataFrame(good, "doc_id long, quality int, toxic int")).collect()}
    for lang in ("en", "ru", "zh"):
        own = [d for d in data if d[2] == lang]
        assert sum(kept[i] for i, *_ in own if i < 10_000) >= 112
        assert sum(not kept[i] for i, *_ in own if i >= 10_000) >= 11, lang


def test_quality(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(None, 1, 0), (50, 0, 0), (51, 1, 1)], "doc_id long, quality int, toxic int")
    junk = table(spark, [(900, "#### %%%% !!!! @@@@ ~~~~ " * 40, "en", "s0")])
    got = quality.classify(docs.union(junk), labels).collect()
    assert len(got) == len(rows) + 1
    by_id = {r["doc_id"]: r for r in got}
    assert not by_id[900]["keep"] and by_id[100]["keep"] and by_id[101]["keep"] and by_id[101]["perplexity"] == 1.0
    assert sum(by_id[i]["keep"] for i in range(50)) >= 45
    assert all(r["keep"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty, labels).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))
    for i in range(0, 200, 4):
        x[i + 1] = x[i] + rng.standard_normal(64) * 0.02 * (i % 16)
        x[i + 2] = x[i] * 3
    x[210] = 0
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(400, None), (401, [1.0, None] + [0.0] * 62), (402, [float("nan")] * 64), (403, [1.0]), (404, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, tile int")
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(300, dtype=bool)
    link[210] = link[:, 210] = False
    comp = np.arange(300)
    for _ in range(300):
        comp = np.array([min(comp[i], comp[link[i]].min() if link[i].any() else comp[i]) for i in range(300)])
    for options in ({}, {"tile_rows": 40}, {"block_dims": 16}):
        got = {r["vec_id"]: r for r in vectors.near_duplicates(df, **options).collect()}
        assert len(got) == len(data)
        assert all(got[i]["n_links"] == link[i].sum() and got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i) for i in range(300))
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(400, 405))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_links_at_a_block_edge_count_once(spark):
    rng, turn = np.random.default_rng(9), vectors.rotation(64, 7)
    data = []
    for i, over in enumerate((-2e-6, 0.0, 5e-7, 2e-6, 5e-6, 9e-6)):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        v = u.copy()
        for block, gap in ((0, 0.0125 + over), (1, 0.006)):  # turned within a block to a squared distance
            at = slice(8 * block, 8 * block + 8)
            r = np.linalg.norm(u[at])
            w = rng.standard_normal(8)
            w -= w @ u[at] / r**2 * u[at]
            c = 1 - gap / (2 * r**2)
            v[at] = c * u[at] + np.sqrt(1 - c * c) * r * w / np.linalg.norm(w)
        data += [(2 * i, (turn @ u).tolist()), (2 * i + 1, (turn @ v).tolist())]
    got = vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: 1 for i in range(12)}


@pytest.mark.parametrize("options", [{}, {"ring_rows": 30, "max_pivots": 5}, {"k": 400}])
def test_top_k(spark, options):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 8)) * rng.uniform(0.1, 3, (200, 1))
    x[50:80] = x[20]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(220, None), (240, [float("inf")] * 8)], "vec_id long, embedding array<double>")
    v = np.floor(64 * x).astype(np.int64)
    k = options.get("k", 20)
    want = set()
    for q in range(0, 200, 20):
        s = v @ v[q]
        order = [j for j in np.lexsort((np.arange(200), -s)) if j != q][:k]
        want |= {(q, r, int(j), int(s[j])) for r, j in enumerate(order, 1)}
    assert {tuple(r) for r in vectors.top_k(df, **options).collect()} == want
    assert vectors.top_k(df.limit(0)).count() == 0


def test_edit_distance_and_keys():
    def table_distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng, keys = random.Random(2), lines.Keys(2)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        d = table_distance(a, b)
        assert all(lines.within(a, b, k) == (d <= k) for k in (0, 1, 2, 3))
        if min(len(a), len(b)) >= 6 and d <= 2:
            k, who, sig = keys([a, b])
            assert set(k[who == 0]) & set(k[who == 1])
            assert lines.letters_apart(sig[:1], sig[1:])[0] <= 2 * d


def test_counts_and_lists_of_long_lines():
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh ", k=400))
    data = [base] + [edited(rng, base, n) for n in (1, 5, 20, 60)]
    count = np.frombuffer(b"".join(lines.counts_of(data, flush=700)), np.uint8).reshape(len(data), -1)
    for other, n in zip(count[1:], (1, 5, 20, 60)):
        apart = np.minimum(count[0] - other, other - count[0]).astype(int)
        assert apart[: 2 * lines.LETTERS].sum() <= 2 * n and apart[2 * lines.LETTERS :].sum() <= 4 * n
    # two lines of block 7 and one of block 9 share a gram, one of them twice; a fourth line is too long for them
    gram = np.array([5, 5, 5, 5, 5, 6], np.uint64)
    word = lines.entries(gram, np.array([0, 1, 2, 1, 3, 0]), np.array([40, 40, 42, 44, 40, 90]), np.array([400, 402, 401, 900]))
    found = [(b.tolist(), x.tolist()) for _, b, x in lines.met_by_grams(word, np.array([7, 7, 9, 7, 9, 7]))]
    assert found == [([[7, 7, 9]], [[0, 1, 2]])]
    found = {(b, x) for _, bs, xs in lines.met_by_grams(word, np.array([7, 7, 9, 7, 9, 7]), most=2) for b, x in zip(np.ravel(bs).tolist(), np.ravel(xs).tolist())}
    assert found == {(7, 0), (7, 1), (9, 2)}


def test_line_dedup(spark, docs, empty):
    base = "this line of the text is long enough to count"
    more = [(500, f"{base}\nown words of five hundred here\n\nx", "en", "s"), (501, f"{base}s\nnothing like the first at all", "en", "s"), (502, f"{base[:-3]}\nshort\nshort", "en", "s"), (503, f"  {base}\t", "en", "s")]
    got = {r["doc_id"]: r for r in lines.dedup(docs.union(table(spark, more))).collect() if r["doc_id"]}
    assert got[500]["text"] == more[0][1] and got[500]["n_dropped"] == 0
    assert got[501]["text"] == "nothing like the first at all"
    assert got[502]["text"] == f"{base[:-3]}\nshort\nshort"  # three edits away
    assert got[503]["text"] == "" and got[503]["n_dropped"] == 1
    assert got[100]["text"] is None and got[101]["text"] == ""
    assert lines.dedup(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.dedup(empty).count() == 0


def edited(rng, line, n):
    """``line`` after ``n`` edits at places of its own."""
    out = list(line)
    for i in sorted(rng.sample(range(len(line)), n), reverse=True):
        out[i : i + 1] = rng.choice([[], ["#"], [out[i], "#"]])
    return "".join(out)


def test_long_lines_repeat_in_proportion(spark):
    rng = random.Random(8)
    data = []
    for length in (60, 79, 100, 335, 900, 3000):
        base = "".join(rng.choice("abcdefgh ") for _ in range(length - 2))
        base = f"x{base}y"
        k = length // 20
        data += [lines.tidy(x) for x in [base] + [edited(rng, base, n) for n in sorted({3, k // 2 + 1, k - 1, k, k + 3, 2 * k}) for _ in range(3)]]
    near = [[x == y or lines.within(x, y, max(len(x), len(y)) // 20) for y in data] for x in data]
    assert sum(map(sum, near)) > 3 * len(data)
    group = list(range(len(data)))
    for _ in data:
        group = [min(group[j] for j in range(len(data)) if near[i][j]) for i in range(len(data))]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup(table(spark, [(i, x, "en", "s") for i, x in enumerate(data)])).collect()}
    assert got == {i: int(group[i] != i) for i in range(len(data))}


def test_a_hot_gram_connects_as_its_pairs_do():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n, length = int(rng.integers(2, 70)), rng.choice([60, 62, 66, 80, 400, 410, 430, 70_000, 150_000], 40)
        who = rng.integers(0, 40, n)
        gram, place = rng.integers(0, 3, n).astype(np.uint64), (rng.random(n) * length[who]).astype(int)
        word = np.sort(lines.entries(gram, who, place, length))
        bits = [(word >> np.uint64(low) & np.uint64((1 << k) - 1)).astype(int) for low, k in ((34, 30), (26, 8), (11, 15), (0, 11))]
        key, step, spot, line = bits
        reach = np.where((step == 255) | (spot == (1 << 15) - 1), 1 << 15, (57 * 1.03 ** (step + 1) / 40).astype(int) + 2)
        root = list(range(n))
        for _ in range(n):
            new = [min([root[j] for j in range(n) if key[i] == key[j] and abs(step[i] - step[j]) <= 2 and abs(spot[i] - spot[j]) <= reach[max(i, j)]]) for i in range(n)]
            if new == root:
                break
            root = new
        want = {tuple(sorted({int(line[i]) for i in range(n) if root[i] == r})) for r in set(root)}
        got = {tuple(x) for _, _, found in lines.met_by_grams(word, np.zeros(n, int)) for x in found.tolist()}
        assert got == {x for x in want if len(x) > 1}
    # one gram 150,000 times, in 50 periodic lines of two lengths that cannot be within the distance
    who = np.repeat(np.arange(50), 3_000)
    word = lines.entries(np.full(len(who), 5, np.uint64), who, np.tile(np.arange(3_000) * 4, 50), np.where(np.arange(50) < 25, 12_100, 24_000))
    began = time.process_time()
    found = [x.tolist() for _, _, x in lines.met_by_grams(word, np.zeros(len(word), int))]
    assert [sorted(x) for x in found] == [[list(range(25)), list(range(25, 50))]] and time.process_time() - began < 20


def test_pairs_of_shared_tiles_come_once():
    tile, cids = np.repeat([3, 5, 9], 3), np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    known = {1: [3, 5, 9], 2: [3, 5, 9], 3: [3, 9], 4: None}
    count = np.zeros((9, 2 * lines.LETTERS + lines.PAIRS), np.uint8)
    tiles = [known[c] and np.array(known[c]) for c in cids.tolist()]
    pairs = [(int(cids[p]), int(cids[q])) for i, j in lines.wide_pairs(tile, np.full(9, 100), count, cids, tiles) for p, q in zip(i, j)]
    assert sorted(pairs) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]


def test_many_bands_at_once():
    rng, a, b = random.Random(4), [], []
    for length, letters in ((60, "ab"), (700, "abcdefgh "), (1_200, "".join(map(chr, range(200, 500))))):
        base = "".join(rng.choice(letters) for _ in range(length))
        for n in (1, length // 40, length // 20, length // 15, length // 5):
            x, y = sorted((edited(rng, base, n // 2), edited(rng, base, n - n // 2)), key=len)
            a.append(x), b.append(y)
    k = np.array([len(y) // 20 for y in b])
    want = [lines.banded(x, y, int(z)) for x, y, z in zip(a, b, k)]
    assert 3 < sum(want) < len(a) and k.max() > 31
    assert lines.banded_many(a, b, k).tolist() == lines.banded_many(a, b, k, 4).tolist() == want


def test_short_lines_repeat_if_equal(spark):
    data = [(1, "Read more\nown text here\n\n\nx", "en", "s"), (2, " Read  more \nRead mora\nx\n", "en", "s"), (3, "読む。\n読む。", "ja", "s")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup(table(spark, data), exact_chars=1).collect()}
    assert got == {1: (data[0][1], 0), 2: ("Read mora\n", 2), 3: ("読む。", 1)}


def brute_jaccard(data):
    sets = {}
    for d, t, *_ in data:
        w = (t or "").split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_jaccard(spark, empty):
    rng, data = random.Random(9), []
    for group in range(25):
        base = words(rng, rng.choice([3, 4, 5, 6, 9, 20, 60, 200])).split()
        for k in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = words(rng, 1)
            own = own[: len(own) - rng.randint(0, len(own) // 12)]
            data.append((len(data), " ".join(own), "en", "s"))
    data += [(1000, None, None, None), (1001, "", None, None), (1002, "one two", None, None), (1003, "One  TWO\n", None, None), (1004, " ", None, None)]
    want = brute_jaccard([(d, t.lower() if t else t) for d, t, *_ in data])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, data)).collect()}
    assert got == want
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_through_null_ids(spark):
    w = [f"w{i}" for i in range(40)]
    chain = [w, w[:-3], w[:-6], w[:-9]]  # neighbours link, the ends do not
    data = [(7, " ".join(chain[0]), "en", "s"), (None, " ".join(chain[1]), "en", "s"), (None, " ".join(chain[2]), "en", "s"), (3, " ".join(chain[3]), "en", "s"), (None, "all on its own here", "en", "s")]
    data += [(20 + i, "one text that very many rows hold", "en", "s") for i in range(300)]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, data)).collect()]
    assert sorted(got, key=str) == sorted([(7, 3), (None, 3), (None, 3), (3, 3), (None, None)] + [(20 + i, 20) for i in range(300)], key=str)


def test_keys_meet_for_all_linked_sets():
    rng = np.random.default_rng(8)
    border = jaccard.bands(4000)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = rng.integers(0, 1 << 64, n, np.uint64)
        y = np.concatenate((x[: n - int(rng.integers(0, n // 6 + 1))], rng.integers(0, 1 << 64, int(rng.integers(0, n // 6 + 1)), np.uint64)))
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if len(y) and jaccard.linked(len(x), len(y), both):
            assert set(jaccard.keys_of(x, border)) & set(jaccard.keys_of(y, border))
            assert jaccard.may_link(len(x), np.frombuffer(jaccard.bitmap(x), np.uint8), len(y), np.frombuffer(jaccard.bitmap(y), np.uint8))


def test_secrets(docs, empty):
    import hashlib
    import re

    text = "é password: 'abc' token=abcdef API_KEY = \"s3cret/+.=\" AKIA" + "A" * 16 + " " + "0a" * 12 + " 0123456789abcdef ghp_" + "x" * 36
    spans = []
    for kind, pattern, group, least in (("assign", secrets.BASE[0].pattern, 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        for m in re.finditer(pattern, text, re.ASCII | re.IGNORECASE if kind == "assign" else re.ASCII):
            if len(m[group]) >= least:
                spans.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    want = ",".join(s for *_, s in sorted(spans))
    more = table(docs.sparkSession, [(700, text, "en", "s"), (701, None, "en", "s")])
    got = {r["doc_id"]: r for r in secrets.scan(more).collect()}
    assert got[700]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[700]["n_assign"], got[700]["n_access"], got[700]["n_hex"]) == (2, 1, 1)
    assert "github" in got[700]["spans"] and got[701]["spans"] == ""
    assert {r["doc_id"]: r["n_assign"] for r in secrets.scan(docs).collect()}[105] == 3
    assert secrets.scan(empty).count() == 0


def test_encoder_matches_tokenizers():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encode = packing.Encoder(vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cs"]), st.sampled_from("abc '’é\n\t   \u0085€12")), max_size=60))
    def check(t):
        assert encode(t).tolist() == encode.full.encode(t, add_special_tokens=False).ids

    check()
    for t in ("<|endoftext|>", "a<|endoftext|>b", "Don't stop  now\r\n\n", "x" * 5000):
        assert encode(t).tolist() == encode.full.encode(t, add_special_tokens=False).ids


def test_encoder_takes_long_blanks():
    encode = packing.Encoder(vocabulary())
    for t in (" " * 1_000_000, "a" + "\n " * 400_000 + "b", " " * 99_999 + "x" * 10):
        assert encode(t).tolist() == encode.full.encode(t, add_special_tokens=False).ids


def test_packing(docs, empty, rows):
    got = packing.pack(docs, vocabulary()).collect()
    encode = packing.Encoder(vocabulary())
    whole = {(d, zlib.crc32((t or "").encode())): np.append(encode(t or ""), 0).astype("<u4") for d, t, *_ in rows}
    assert sum(r["length"] for r in got) == sum(len(np.append(encode(t or ""), 0)) for _, t, *_ in rows)
    fill = {}
    for r in got:
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for (d, _), ids in whole.items() if d == r["doc_id"])
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(fill) <= sum(r["length"] for r in got) / 1024 + 2
    assert packing.pack(empty, vocabulary()).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        used = {}
        for copies, uses in packing.plan(histogram):
            assert sum(n * k for n, k in uses.items()) <= 1024
            for n, k in uses.items():
                used[n] = used.get(n, 0) + copies * k
        assert used == histogram


def test_pairs_of_connected_and_settled_lines_are_not_compared():
    """Lines of one label cost no comparison of counts, nor do two lines that have a partner each; what is found stays the same."""

    class Counted(np.ndarray):
        asked = 0

        def __getitem__(self, at):
            if isinstance(at, tuple) and len(at) == 2 and isinstance(at[0], np.ndarray):
                Counted.asked += len(at[0])
            elif isinstance(at, np.ndarray):
                Counted.asked += len(at)
            return np.asarray(self)[at]

    n = 200
    tile, length, label = np.zeros(n, np.int64), np.full(n, 100), np.zeros(n, np.int64)
    label[50] = 1
    count = np.zeros((n, 2 * lines.LETTERS + lines.PAIRS), np.uint8)
    found = {p for i, j in lines.wide_pairs(tile, length, count.view(Counted), label) for p in zip(i.tolist(), j.tolist())}
    assert found == {(min(k, 50), max(k, 50)) for k in range(n) if k != 50}
    assert Counted.asked <= 4 * n
    letters = np.zeros((n, lines.LETTERS), np.uint8)
    letters[7] = 100
    some, Counted.asked = np.zeros(n, bool), 0
    for i, j, _ in lines.close_letters(tile, length, letters.view(Counted), settled=some):
        some[i] = some[j] = True
    assert some.sum() == n - 1 and not some[7] and Counted.asked <= 6 * n
    every = {k for i, j, _ in lines.close_letters(tile, length, letters) for k in (*i.tolist(), *j.tolist())}
    assert every == set(np.flatnonzero(some).tolist())
