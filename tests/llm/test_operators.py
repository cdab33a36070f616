"""Each operator against brute force, exact round trips or held-out accuracy, and its defined cases."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, htmltext, jaccard, langid, linededup, mixing, nndescent, quality, substrings, suffixes, warc
from lattica.llm.common import components
from lattica.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string, body string"


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(20000))
    plain = "The quick brown fox jumps over the lazy dog and then it runs away from here"
    rows = [(1, plain, "en", "a", 5, "x", "y", "z"), (1, plain, "en", "a", 5, "x", "y", "z"), (2, None, None, None, None, None, None, None), (3, "", "en", "b", 0, None, None, None), (4, long_, "en", "b", 1, None, None, None), (None, plain, None, "a", None, None, None, None), (5, "   \n \t", "fr", None, 3, None, None, None), (6, "short", None, "c", 2, None, None, None), (7, "1234 !!", "de", "c", 7, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, i) for i in range(501, 540)] + [(i, i + 1) for i in range(600, 660)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == union_find(edges, nodes)


# 1


def test_html_text():
    page = (
        '<html><head><title>t</title><script>var a="<p>";</script></head><body><header>Top</header><nav><ul><li>m</ul></nav><div class="sidebar">s</div><div id="cookie-notice">c</div><main><article><h1>Title &amp; more</h1>'
        '<p>One <b>two</b>\n\n three&nbsp;x<p>Four<br>five<ul><li>a<li>b</ul><div class="ad">Buy</div><form>f<input></form><table><tr><td>1<td>2</table><section class="comments"><p>first!</section></article></main><footer>&copy; F</footer>'
    )
    assert htmltext.extract(page)[0] == "Title & more\nOne two three x\nFour five\na\nb\n1\n2"
    assert htmltext.extract(None)[0] == htmltext.extract("")[0] == ""
    assert htmltext.extract("<body><p>Hello <i>w</i>orld<div>d")[0] == "Hello world\nd"
    assert htmltext.extract("plain &lt; text")[0] == "plain < text"


def test_html_articles_of_the_table(spark, sf):
    got = {r["page_id"]: r for r in QUERIES["op1_html_text"](spark, sf).collect()}
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_style_tree_removes_what_repeats_on_a_site(spark):
    rows = [(i, "http://a.example/x", f"<body><div class=top>Same words on each page</div><p>Only on page {i} and nowhere else</p>") for i in range(12)]
    rows += [(50, "http://b.example/x", "<body><div class=top>Same words on each page</div><p>Alone</p>"), (51, None, None), (51, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = defaultdict(list)
    for r in htmltext.extract_text(pages).collect():
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["Only on page 3 and nowhere else"]
    assert got[50] == ["Same words on each page\nAlone"] and got[51] == ["", ""]
    assert htmltext.extract_text(pages.limit(0)).count() == 0


def test_the_style_tree_decides_inside_articles(spark):
    """What different articles of a site share goes, what copies of one share stays; without the tree texts differ."""
    part = "<p>Written for readers of the weekly, all rights kept</p>"
    rows = [(i, "http://a.example/x", f"<article><h1>Title {i}</h1>{part}<p>Only {i} here</p></article>") for i in range(12)]
    rows += [(100 + i, "http://b.example/x", f"<article><h1>One title</h1>{part}<p>One text</p></article>") for i in range(12)]
    rows += [(200 + i, "http://c.example/x", f"<article><h1>T {i}</h1><div class='promo'>" + f"<p>a {i}</p><ul><li>b {i}</ul>" * (i % 5) + f"<h2>{i}</h2>" * (i % 3) + f"<p>prose {i}</p></div></article>") for i in range(15)]
    rows += [(300 + i, "http://d.example/x", f"<article><h1>T {i}</h1><div class='promo'><p>prose {i}</p></div></article>") for i in range(15)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Title 3\nOnly 3 here" and htmltext.extract(rows[3][2])[0] != got[3]
    assert got[105].split("\n") == ["One title", "Written for readers of the weekly, all rights kept", "One text"]
    assert "prose 7" in got[207] and got[307] == "T 7"


def test_style_tree_by_brute_force(spark):
    rng = random.Random(21)
    rows = [(host, f"<article><p>{rng.choice('abcd')} {rng.choice('xy')}</p><p>own {i}</p></article>") for host in ("a", "b", "c") for i in range(20)]
    rows += rows[:5]
    pages, shared = defaultdict(set), defaultdict(set)
    for host, html in rows:
        texts = re.findall("<p>(.*?)</p>", html)
        page = min(htmltext.node_key(t) for t in texts)
        for t in texts:
            pages[host].add(page)
            shared[host, t].add(page)
    want = sorted(round(1 - np.log(len(v)) / np.log(len(pages[h])), 9) for (h, _), v in shared.items() if len(v) > 1)
    got = sorted(round(r["importance"], 9) for r in htmltext.style_tree(spark.createDataFrame(rows, "host string, html string")).where("content").collect())
    assert got == want and got


def test_composite_importance_joins_presentation_and_parts():
    page = "<article><h1>T</h1><div class='promo'><p>one</p><p>two</p></div><div class='box'><p>three</p><p>four</p></div></article>"
    root = htmltext.parse(page)
    _, units, _ = htmltext._parts(page, "h")
    path = {n.sign: int(n.path) for n in units}
    p = {t: htmltext.node_key(n.path, t) for n in units for t in [htmltext._own_text(n)] if t}
    text = lambda facts: htmltext.extract(page, facts, "h")[0].split("\n")
    assert root.children and text({}) == ["T", "three", "four"]
    # By the formula: ten styles of importance 0.8 over parts of 0.9; two of 0.1 leave a template.
    assert abs(htmltext.composite(0.8, 10, 0.9) - (0.8 * (1 - 0.9**10) + 0.9 * 0.9**10)) < 1e-12
    assert text({path["div.promo"]: (0.8, 10)}) == ["T", "one", "two", "three", "four"]
    assert text({path["div.promo"]: (0.1, 2)}) == ["T", "three", "four"]
    # The same presentation saves no parts that different pages share.
    assert text({path["div.promo"]: (0.5, 2), p["one"]: (0.0, 0), p["two"]: (0.0, 0)}) == ["T", "three", "four"]
    # Many rare styles of a path take nothing from contents that only this page has; shared ones go whatever their styles.
    assert text({int(n.path): (0.005, 60) for n in units if n.tag == "p"}) == ["T", "three", "four"]
    assert text({k: (0.5, 9) for k in map(int, {n.path for n in units if n.tag == "p"})} | {p["three"]: (0.0, 0)}) == ["T", "four"]
    # A branch whose own importance is low stays for what is important in it, and only that.
    assert text({path["div.box"]: (0.01, 60), p["three"]: (0.0, 0)}) == ["T", "four"]


def test_names_alone_remove_no_prose_and_broken_pages_are_linear():
    text = lambda x: htmltext.extract(x)[0]
    assert text('<article><h1>t</h1><div class="related-work"><p>prose</p></div><section id="discussion"><p>more</p></section></article>') == "t\nprose\nmore"
    assert text('<div class="discussion"><p>a</p></div>') == "a" and text('<form><div class="content"><h1>T</h1><p>b</p></div></form>') == "T\nb"
    assert text('<article><p>a</p><section class="reply"><article class="post"><p>c</p></article></section></article>') == "a"
    assert text("<div>" * 20000 + "x") == "x" and text("<a '" * 50000 + ">z") == "z" and text("<a<" * 50000).startswith("<a<")


# 2 and 8


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op2_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_quality_defined_cases(spark, odd, none):
    marks = spark.createDataFrame([(1, 1), (4, 0), (4, 1)], "doc_id bigint, quality int")
    scorer = quality.fit(odd, marks, held_out=None)
    got = quality.score(odd, scorer).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(none, quality.fit(none, marks.limit(0))).count() == 0
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, marks.limit(0))).collect()} == {0.5}


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, (2000, 3)), rng.normal(-1, 1, (2000, 3))
    scorer = quality.train(pos[:800], np.concatenate((pos[800:], neg[:1200])), 0.5)
    assert (scorer.scores(pos[800:]) > 0.5).mean() > 0.85 and (scorer.scores(neg[1200:]) < 0.5).mean() > 0.85


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_language_of_each_word_of_mixed_and_long_texts():
    rng = random.Random(8)
    words = {"en": "the of and with that from this have".split(), "de": "der und das nicht ein auch sich werden".split()}
    sample = [(lang, " ".join(rng.choice(w) for _ in range(200))) for lang, w in words.items() for _ in range(20)]
    model = langid.train_chain(sample)
    mixed = " ".join([rng.choice(words["en"]) for _ in range(30)] + [rng.choice(words["de"]) for _ in range(30)])
    labels = [(w, lang) for w, lang, _ in langid.label_words(model, mixed)]
    assert [w for w, _ in labels] == mixed.split()
    assert [lang for _, lang in labels[2:28]] == ["en"] * 26 and [lang for _, lang in labels[32:]] == ["de"] * 28
    assert langid.label_words(model, None) == langid.label_words(model, "12 !!") == []
    import pyarrow as pa

    (lang, score), = langid.label_texts(model, pa.array([" ".join(rng.choice(words["de"]) for _ in range(300_000))]))
    assert lang == "de" and score > 0.9


def test_language_defined_cases(odd, none):
    model = langid.fit(odd, held_out=None)
    got = langid.identify(odd, model).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (2, 3, 5, 7)] == ["und"] * 4 and by[2]["score"] == 0
    assert by[4]["lang_pred"] != "und"
    assert langid.identify(none, langid.fit(none)).count() == 0


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(2)
    e, t = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    got, pairs = langid.forward_backward(e, np.array([0, 4]), t, pairs=True)
    want, moves, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, s in enumerate(path):
            want[i, s] += w
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += w
    assert np.allclose(got, want / total) and np.allclose(pairs, moves / total)


# 3


def test_nn_descent_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[0] + 0.01 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(2000 + i, base[1].tolist(), 1) for i in range(40)] + [(2000, base[1].tolist(), 1)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] + [1.0] * 15, 0), (3003, base[1].tolist(), None), (3004, [None] + [1.0] * 15, 1), (3005, [1.0], 0), (3006, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("cid", F.lit("clash"))
    got = nndescent.near_duplicates(df).collect()
    assert len(got) == len(rows)
    links, ids = defaultdict(set), {r[0] for r in rows}
    whole = {r[0]: r for r in rows if r[1] and len(r[1]) == 16 and r[2] is not None and None not in r[1] and not any(x != x for x in r[1]) and any(r[1])}
    for a in whole.values():
        x = np.array(a[1], float)
        for b in whole.values():
            y = np.array(b[1], float)
            if a[0] != b[0] and a[2] == b[2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a[0]].add(b[0])
    comp = union_find([(a, b) for a in links for b in links[a]], ids)
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(i, len(links[i]), comp[i], comp[i] == i) for i in ids}
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


def test_many_near_equal_vectors_and_double_precision(spark):
    rng = np.random.default_rng(33)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.05 * rng.normal(size=8)).tolist(), 0) for i in range(700)] + [(1000 + i, rng.normal(size=8).tolist(), 0) for i in range(300)]
    rows += [(2000, [1e9, 1.0], 1), (2001, [1e9, 1.0 + 1e-9], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows[:1000]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows[:1000]]
    comp = union_find([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)], ids)
    assert {i: got[i] for i in ids} == {i: (int(n), comp[i]) for i, n in zip(ids, near.sum(axis=1), strict=True)}
    assert got[2000] == got[2001] == (1, 2000)


# 4


def brute_contamination(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            part = w[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c1", "Dé", "e"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 14])))) for i in range(14)] + [(3, "b  B-c1"), (90, None), (91, "..."), (None, "a a")]
    texts = [" ".join(rng.choice(vocabulary).upper() for _ in range(rng.randrange(0, 60))) + rng.choice(["", "!"]) + " ".join(items[i % 10][1].split()) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, None, ""])], "doc_id bigint, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {i: brute_contamination(t, [x for x in items if x[0] is not None]) for i, t in enumerate([*texts, None, ""])}
    for size in (1 << 20, 40):  # one shard, many shards
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination_report(docs, bench).collect()}
        assert got == want
    assert decontaminate.contamination_report(none, bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == 9
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).columns == odd.columns


# 5


def test_mixing_comes_near_its_targets(spark, sf, odd, none):
    got = QUERIES["op5_mix"](spark, sf).collect()
    again = QUERIES["op5_mix"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target, sizes = Counter(), {}, defaultdict(list)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        sizes[s].append(r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    assert abs(sum(target.values()) - sum(map(sum, sizes.values()))) < 1e-3
    for s in target:
        assert target[s] <= 3 * sum(sizes[s]) + 1e-6 and abs(taken[s] - target[s]) <= max(sizes[s])
    out = mixing.mix(odd)
    assert out.count() == 9 and {r["size"] for r in out.where("doc_id in (2, 3)").collect()} == {0}
    assert mixing.mix(none).count() == 0


def test_mixing_without_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = sorted(map(tuple, mixing.mix(docs, keep=("doc_id",)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs, keep=("doc_id",)).collect())) == few


# 6


def test_line_dedup(spark, odd, none):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    lines = [" ".join(rng.sample(words, 60)) for _ in range(30)]
    near = [x.replace(x.split()[30], "changed", 1) for x in lines]
    docs = [(i, f"{lines[i]}\nshort one\n{lines[(i + 1) % 30].upper()}") for i in range(30)] + [(100 + i, near[i]) for i in range(30)] + [(None, lines[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("pos", F.lit("clash"))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    for i in range(30):
        # each line occurs twice as it is: the occurrence in the document with the smaller number stays
        assert got[i]["text"].count("short one") == 1
    kept = Counter(line.lower() for i, r in got.items() if i is not None for line in r["text"].split("\n") if len(line.split()) >= 5)
    assert all(kept[x] == 1 for x in lines)
    assert got[None]["text"] == lines[0]
    close = [i for i in range(30) if got[100 + i]["text"] == ""]
    assert len(close) >= 6  # one word of sixty moves about three bits
    out = linededup.dedup_lines(odd)
    assert out.count() == 9 and {r["n_removed"] for r in out.where("doc_id = 1").collect()} == {0}
    assert linededup.dedup_lines(none).count() == 0


def test_line_groups_by_blocks_against_edit_similarity(spark):
    """No limit on bits in the brute force: lines of words that differ in up to two words always meet."""
    rng = random.Random(26)
    words = [f"{a}{b}{c}" for a in ("lon", "mer", "sta") for b in ("ger", "ind", "ul", "ation") for c in ("", "en", "ingly", "x")]
    texts = []
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.choice([6, 15, 40, 90]))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.choice([1, 2]) if len(base) > 10 else 1):
                other[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(other))
    texts = list(dict.fromkeys(texts))

    def similar(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] <= 0.2 * max(len(a), len(b))

    edges = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if similar(a, b)]
    want = union_find(edges, range(len(texts)))
    occ, groups = linededup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), sketches=True)
    of = {bytes(r["lid"]): r["doc"] for r in occ.collect()}
    got = {of[bytes(r["lid"])]: of[bytes(r["group"])] for r in groups.collect()}
    met = [(a, b) for a, b in edges if got[a] == got[b]]
    assert len(met) >= 0.97 * len(edges) and all(want[a] == want[b] for a in got for b in got if got[a] == got[b])


def test_line_groups_are_those_of_all_pairs(spark):
    rng = random.Random(16)
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(8):
            c = list(b)
            c[rng.randrange(40)] = rng.choice(words)
            texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    occ, groups = linededup.line_groups(df)
    sims = {bytes(r["lid"]): (r["sim"], r["doc"]) for r in occ.collect()}
    text = {k: texts[d] for k, (_, d) in sims.items()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    ids = sorted(sims)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if ((sims[a][0] ^ sims[b][0]) & (2**64 - 1)).bit_count() <= 3 and distance(text[a], text[b]) <= 0.2 * max(len(text[a]), len(text[b]))]
    assert {bytes(r["lid"]): bytes(r["group"]) for r in groups.collect()} == union_find(edges, ids)
    assert edges


# 7


def test_warc_round_trip(spark):
    rng = random.Random(7)
    body = ["", None, "x", "é\r\n\r\nWARC/1.1\r\n", "".join(rng.choice("abc\r\n ü") for _ in range(50_000))]
    rows = [(i, rng.choice(["http://a/ü b", None, "http://b/\r\nX: 1"]), body[i % 5]) for i in range(40)] + [(4, "u", body[4]), (39, "u", body[4]), (39, "u", body[4]), (None, "u", "x"), (None, "u", "unique")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), segment_bytes=9000).collect()
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    top = defaultdict(lambda: None)
    for p, b in raw:
        if p is not None:
            top[b] = p if top[b] is None else max(top[b], p)
    want = Counter()
    for p, b in raw:
        again = top[b] is not None and p != top[b]
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top[b] if again else None] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_framing_errors():
    assert warc.dechunked(warc.chunked(b"a" * 10_000, 999)) == b"a" * 10_000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    record = b"".join(r + b"\r\n\r\n" for r in warc.records_of(1, "u", b"x" * 5000, None, False, 1000))
    assert len(list(warc.parse(record))) > 3
    with pytest.raises(ValueError):
        list(warc.parse(record[:-10]))


# 9


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def test_repeats_against_brute_force(spark, none):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    common, other = text(700), text(260)
    rows = [text(900), text(50) + common + text(80), common[100:650] + text(10), other + other, "ab" * 400, "ab" * 150 + text(300), None, "", text(199), common + other, common + other, "z" * 201]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(rows)] + [(10, rows[10])], "doc_id bigint, text string").withColumn("start", F.lit("clash"))
    got = substrings.remove_repeats(docs).collect()
    want = brute_repeats([(t or "").encode() for t in [*rows, rows[10]]], 200)
    ids = [None if i == 3 else i for i in range(len(rows))] + [10]
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((i, *w) for i, w in zip(ids, want, strict=True))
    assert substrings.remove_repeats(none).count() == 0


def test_suffix_order_and_spilling_queues():
    rng = np.random.default_rng(9)
    for trial in range(60):
        n, k = int(rng.integers(3, 80)), int(rng.integers(1, 5))
        t = np.append(rng.integers(1, k + 1, n), 0).astype(np.int16)
        got = suffixes.suffix_order(t, k + 1, 1000, memory=64 if trial % 2 else 1 << 20)
        assert got.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_induced_sort_recurses():
    t = np.array([*([2, 1, 3] * 200), *([1, 2, 1, 3] * 100), 0], np.int16)
    assert suffixes.suffix_order(t, 4, 10_000).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


# 10


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = union_find(edges, ids)
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 400]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 14)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(25):
        texts[len(texts)] = shared + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 9, 30])))
    texts |= {900: None, 901: "", 902: "one", 903: "ONE", 904: "two words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in jaccard.link(df, k=k, percent=percent).collect()}
    assert got == brute_components(texts, k, percent)


def test_jaccard_of_the_table(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_jaccard_join"](spark, sf).collect()}
    assert got == brute_components({r["doc_id"]: r["text"] for r in docs}, 4, 85)


def test_jaccard_defined_cases(odd, none):
    got = jaccard.link(odd).collect()
    assert len(got) == 9 and {r["component"] for r in got if r["id"] is not None} == {1, 2, 3, 4, 5, 6, 7}
    assert jaccard.link(none).count() == 0
    assert jaccard.drop_near_copies(odd).columns == odd.columns


def test_wrappers_named_after_a_sidebar_stay():
    page = '<body class="with-sidebar"><div class="page has-sidebar"><div class="site-header"><p>top</p></div><div class="post-content"><h1>T</h1><p>x</p></div><section id="comments"><article class="comment"><p>no</p></article></section></div>'
    assert htmltext.extract(page)[0] == "T\nx"
    assert htmltext.extract('<body><div class="header">top</div><p>x</p><div class="footer">f</div>')[0] == "x"
