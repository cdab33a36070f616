"""Cases in which an operator once did less than its whole job."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from lattica.llm import langid, linededup, quality


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_finds_what_is_similar_whatever_its_bits(spark):
    rng = random.Random(26)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 12))) for _ in range(3000)]
    texts = []
    for n in (8, 12, 20, 30, 50) * 3:
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(4):
            line = list(base)
            for _ in range(max(1, n // 12)):
                line[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(line))
    alike = [(a, b) for a, b in combinations(range(len(texts)), 2) if distance(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b]))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    occ, groups = linededup.line_groups(df, sketches=True)
    group = {r["doc"]: bytes(r["group"]) for r in occ.join(groups, "lid").collect()}
    assert len(alike) > 60
    assert sum(group[a] == group[b] for a, b in alike) >= 0.97 * len(alike)
    assert all(a // 4 == b // 4 for a, b in combinations(group, 2) if group[a] == group[b])
    few = linededup.dedup_lines(df).where("text <> ''").count()
    assert few == len(set(group.values()))


def test_shared_words_at_other_places_make_no_candidates(spark, monkeypatch):
    """Lines that share long words in another order, or far from where they were, aren't compared; crowded buckets are linked in turns."""
    rng = random.Random(6)
    filler = lambda n: [f"w{rng.randrange(10**6):06}" for _ in range(n)]
    long_words = [f"uncommonlylong{c}" for c in "abcde"]
    rows = []
    for i in range(12):
        words = filler(30)
        for at, w in zip(sorted(rng.sample(range(30), 5)), rng.sample(long_words, 5), strict=True):
            words[at] = w
        rows.append((i, " ".join(words)))
    base = [*long_words, *filler(25)]
    rng.shuffle(base)
    for i in range(16):  # each from the one before, so that far ones aren't alike
        base[i % 30] = base[i % 30] if base[i % 30] in long_words else filler(1)[0]
        rows.append((100 + i, " ".join(base)))
    seen, verified = [], linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, *rest: (seen.extend(tuple(r) for r in pairs.collect()), verified(pairs, *rest))[1])
    monkeypatch.setattr(linededup, "CROWDED", 0)
    occ, groups = linededup.line_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), sketches=True)
    group = {r["doc"]: bytes(r["group"]) for r in occ.join(groups, "lid").collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(rows, 2):
        if distance(a, b) <= 0.2 * max(len(a), len(b)):
            parent[root(i)] = root(j)
    assert all((group[i] == group[j]) == (root(i) == root(j)) for (i, _), (j, _) in combinations(rows, 2))
    assert len(seen) < 12 * 11 / 2 + 16 * 15 / 2


def test_walked_edits_are_no_fewer_than_edits(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        a = [rng.choice("ab bcd e  fgh".split(" ")) for _ in range(rng.randrange(0, 20))]
        b = [w for w in a if rng.random() < 0.9] + [rng.choice(["x", "ab"])] * rng.randrange(0, 2)
        pairs.append((" ".join(a), " ".join(b)))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", linededup._walked(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(r["n"] >= distance(r["x"], r["y"]) for r in got)
    same = spark.createDataFrame([("a long line of words", "a long line of words")], "x string, y string")
    assert same.select(linededup._walked(F.col("x"), F.col("y"))).first()[0] == 0


def test_line_dedup_of_lines_with_few_spaces(spark):
    chinese = "".join(chr(0x4E00 + (i * 37) % 900) for i in range(60))
    near = chinese[:30] + "变" + chinese[31:]
    blanks = "one two three four five six seven"
    rows = [(1, f"{chinese}\nread more here\nok\n{blanks}\n短い行です"), (2, f"{chinese}\nRead more here\nok"), (3, f"{near}\nread more there\n短い行です"), (4, blanks.replace(" ", "\u00a0"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "ok", 3: "read more there\n短い行です", 4: ""}


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    lexicon = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(66)}
    rows = [(i * 10 + j, " ".join(rng.choice(words) for _ in range(30)), lang) for i, (lang, words) in enumerate(lexicon.items()) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langid.bounded_sample(df, "lang", "doc_id", 300).select("lang").distinct().count() == 66


def test_training_takes_pieces_from_all_of_a_text():
    first, last = " ".join(["common"] * 600), " ".join(["lateword"] * 600)
    model = langid.train_chain([("a", f"{first} {last}"), ("b", f"{first} " + " ".join(["otherend"] * 600))])
    import pyarrow as pa

    assert [x[0] for x in langid.label_texts(model, pa.array([b"lateword lateword", b"otherend otherend"], pa.binary()))] == ["a", "b"]


def test_texts_are_not_shuffled_for_a_sample(spark):
    """Without the hint, larger labels had every text shuffled for some three thousand ids."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = quality._of(rows, rows.where("id % 5 = 0").select("id"))
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["id"] for r in got.collect()) == [0, 5, 10, 15]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_of_several_buckets_make_one_pair(spark):
    """Lines with all of their sample in common share ten buckets; a part that was moved leaves the buckets without it."""
    places = {1: [10, 20, 30, 40, 50], 2: [10, 20, 30, 40, 50], 3: [90, 20, 30, 40, 50], 4: [10, 90, 30, 80, 50]}
    rows = [(node, key, 100, *[at[i] for i in c], node) for node, at in places.items() for key, c in enumerate(combinations(range(5), 3))]
    known = spark.createDataFrame(rows, "node bigint, key bigint, len int, pa int, pb int, pc int, c bigint")
    # 1 and 2 meet everywhere, 3 meets them where its first part isn't asked, 4 where its second and fourth aren't.
    assert sorted(tuple(r) for r in linededup._pairs(known, 0.8).collect()) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]


def test_pairs_edited_within_words_are_told_alike_by_a_walk(spark):
    """A walk once counted every word that changed as a whole; now stretches between words that are met count their edits."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 14)))
    pairs = []
    for _ in range(20):
        a = [word() for _ in range(60)]
        b = [w[:-1] + "z" if i % 2 else w for i, w in enumerate(a)]
        pairs.append((" ".join(a), " ".join(b)))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", linededup._walked(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(r["n"] == distance(r["x"], r["y"]) == 30 for r in got)


def test_samples_are_the_same_with_few_and_many_longer_words(spark):
    """Lines with enough longer words rank these alone; the sample and its places are those of all words."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 14)))
    texts = [" ".join([word() for _ in range(n)] + ["twiceinaline"] * (n % 3)) for n in range(5, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = linededup._occurrences(df, 5, "doc_id", "text", True).collect()
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in {w for t in texts for w in t.split(" ")}], "w string").select("w", F.xxhash64("w").bitwiseAND(F.lit((1 << 60) - 1)).alias("h")).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r["doc"]].split(" ")
        rank = lambda w: hashes[w] | max(0, min(7, 11 - len(w))) << 60
        first = sorted({(rank(w) - (1 << 64) if rank(w) >> 63 else rank(w)) for w in words})[:5]
        assert [r[f"s{i + 1}"] for i in range(len(first))] == first
        framed = f" {texts[r['doc']]} "
        of = {(rank(w) - (1 << 64) if rank(w) >> 63 else rank(w)): w for w in words}
        assert [r[f"p{i + 1}"] for i in range(len(first))] == [framed.index(f" {of[h]} ") + 1 if words.count(of[h]) == 1 else None for h in first]
