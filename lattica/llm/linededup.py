"""Fuzzy line de-duplication with DataFrame functions only.

Lines are lower-cased and trimmed, tabs, carriage returns, no-break and ideographic spaces
counting as spaces. Lines of at least five words (parted by single spaces) are compared by their
words, others of at least 20 characters by their character 4-grams, and others of at least 10
characters are removed only if equal; shorter ones stay.

One SimHash of a whole line is a poor key: a single changed word moves more than three of 64
bits in most lines. So each line is sampled: five of its different parts, those of 11 characters
or more in the order of their hashes, then shorter ones by length, since short words are in many
lines. Every three of the five make one
64-bit SimHash block, the bits that most of the three hashes have. By the pigeonhole
principle lines that differ in at most two of the five share a block, and blocks are the join
keys; README has the recall. Lines of a block are candidates if its three parts stand in one
order in both and at places that leave few enough edits; a part that was moved counts as
different, one that is there more than once may stand anywhere.
``line_groups`` can also link by one SimHash of a line's at most
15 parts of least hash, at most three bits apart, which agree in two of five bit ranges.
Candidates are verified by edit similarity on the normalised lines. Of each connected group
of lines the occurrence with the smallest ``(doc_id, position)`` stays and the others go.

Pairs aren't all made: neighbours by length and by place in each bucket are linked first, then
in crowded buckets some neighbours of other groups, and only buckets that still span several
groups have all pairs across groups tested, so no candidate is lost. Lines that share several
buckets make one pair, in the first of these in which they are candidates.
A line is known by two 64-bit hashes; in graphs by one of them, which lines with an equal
first hash don't share.

Defined cases: null or empty texts, lines of under five words and 10 characters and rows without an id stay as they are;
rows with equal id count as one document; a text all of whose lines go becomes empty; other
columns are kept, and one named like an appended column gives way.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, forget, replace_columns

#: First bit and width of each range of a line's one SimHash, and how many bits may differ.
RANGES = ((0, 12), (12, 12), (24, 12), (36, 12), (48, 12))
MAX_BITS = 3
#: Parts of a sample, how many of them make a block, and from which length on all words come first alike.
SAMPLE, BLOCK, LONG_WORD = 5, 3, 11
#: Words of this length and more are ranked without the others where there are enough for a sample; it changes no sample.
ENOUGH = 8
#: Columns with the places of a block's parts.
PLACES = ("pa", "pb", "pc")
#: Parts with weight in a line's one SimHash.
FEATURES = 15
#: Characters of a line with few words: from the first number on equal ones go, from the second on similar ones.
LEAST_CHARS, GRAM_CHARS, GRAM = 10, 20, 4
#: Lines are first compared by a walk along their words from this length on; where few are alike, from the second on.
WALKED, WALKED_ANYWAY = 128, 4096
#: Characters of one line that may be passed over, besides as many as of the other, until the next word of that is met.
REACH = 24
#: While buckets have over so many times their lines in pairs across groups, some of these are tested first, with so many neighbours of each line, in up to so many turns and while that share of them links.
CROWDED, NEIGHBOURS, TURNS, WORTH = 4, 3, 6, 0.05
_TOP = -(1 << 63)


def _normal(text: Column) -> Column:
    text = F.lower(text)
    for blank in "\t\r 　":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    return rows.select("doc", F.posexplode(F.split(_normal(F.col("text")), "\n")).alias("pos", "line")).select("doc", "pos", F.trim("line").alias("norm"))


def _simhash(hashes: Column) -> Column:
    """The 60 bits that more than half of at most 15 hashes have.

    Twelve counters of five bits share a long. They start so far below 16 that their topmost
    bit tells a majority, and can't reach 32.
    """
    width = 5
    ones = sum(1 << (width * j) for j in range(12))
    below = (F.lit(15) - F.floor(F.size(hashes) / 2)) * F.lit(ones)
    start = F.struct(*[below.cast("long").alias(f"c{i}") for i in range(width)])
    add = lambda a, h: F.struct(*[(a[f"c{i}"] + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(ones))).alias(f"c{i}") for i in range(width)])

    def bits(a: Column) -> Column:
        sim = F.lit(0).cast("long")
        for i in range(width):
            sim = sim.bitwiseOR(F.shiftrightunsigned(a[f"c{i}"], width - 1 - i).bitwiseAND(F.lit(ones << i)))
        return sim

    return F.aggregate(hashes, start, add, bits)


def _occurrences(docs: DataFrame, min_words: int, id_col: str, text_col: str, blocks: bool) -> DataFrame:
    """``(doc, pos, h1, h2, len)`` of the lines with enough words or characters, and their sample ``s1, ..., s5`` or their one SimHash ``sim``."""
    n = F.length("norm")
    parted = lambda: F.split("norm", " ")
    # Nearly all lines have enough characters, and then their words aren't counted for this.
    lines = _lines(docs, id_col, text_col).where((n >= LEAST_CHARS) | (F.size(parted()) >= min_words)).withColumn("words", parted()).withColumn("spaced", F.size("words") >= min_words)
    grams = F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.col("norm").substr(i, F.lit(GRAM)))
    lines = lines.withColumn("words", F.when(F.col("spaced"), F.col("words")).when(n >= GRAM_CHARS, grams).otherwise(F.array("norm")))
    if blocks:
        # Longer words come first, so lines with enough of them are sampled from these alone.
        lines = lines.withColumn("long", F.filter("words", lambda w: F.length(w) >= ENOUGH))
        lines = lines.withColumn("words", F.when(F.size(F.array_distinct("long")) >= SAMPLE, F.col("long")).otherwise(F.col("words"))).drop("long")
    # Lower 60 bits are the part's own; above them is what puts longer words first.
    first = lambda w: F.greatest(F.lit(0), F.least(F.lit(7), F.lit(LONG_WORD) - F.length(w))).cast("long")
    ranked = F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 60) - 1)).bitwiseOR(F.shiftleft(first(w), 60)))
    known = ["doc", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit("other")).alias("h2"), n.alias("len")]
    if not blocks:
        return lines.select(*known, F.sort_array(F.array_distinct(ranked)).alias("hashes")).select("doc", "pos", "h1", "h2", "len", _simhash(F.slice("hashes", 1, FEATURES)).alias("sim"))
    framed = F.when(F.col("spaced"), F.concat(F.lit(" "), "norm", F.lit(" "))).otherwise(F.col("norm")).alias("framed")
    lines = lines.select(*known, framed, "spaced", "words", ranked.alias("ranked"))
    lines = lines.withColumn("hashes", F.slice(F.sort_array(F.array_distinct("ranked")), 1, SAMPLE))
    # A part's place is known if it is in the list once.
    samples = range(1, SAMPLE + 1)
    lines = lines.withColumn("turned", F.reverse("ranked"))
    once = lambda i: F.array_position("ranked", F.col(f"s{i}")) + F.array_position("turned", F.col(f"s{i}")) == F.size("ranked") + 1
    lines = lines.withColumns({f"s{i}": F.get("hashes", F.lit(i - 1)) for i in samples})
    part = lambda i: F.get("words", F.array_position("ranked", F.col(f"s{i}")).cast("int") - 1)
    framed = lambda i: F.when(F.col("spaced"), F.concat(F.lit(" "), part(i), F.lit(" "))).otherwise(part(i))
    place = lambda i: F.when(once(i), F.call_function("locate", framed(i), F.col("framed"))).alias(f"p{i}")
    return lines.select("doc", "pos", "h1", "h2", "len", *[f"s{i}" for i in samples], *[place(i) for i in samples])


def _distinct(occ: DataFrame) -> DataFrame:
    """Lines with ``node``, the number that stands for the line, ``times`` and one place where it occurs."""
    same = [F.max(c).alias(c) for c in occ.columns if c not in ("doc", "pos", "h1", "h2")]
    lines = occ.repartition("h1").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("doc").alias("at_doc"), F.min_by("pos", "doc").alias("at_pos"), *same)
    least = F.min("h2").over(Window.partitionBy("h1"))
    return lines.withColumn("node", F.when(F.col("h2") == least, F.col("h1")).otherwise(F.col("h2")))


def _range_keys() -> Column:
    """Pairs of ranges of a line's one SimHash."""
    part = [F.shiftrightunsigned("sim", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in RANGES]
    return F.array(*[F.shiftleft(part[i], 12).bitwiseOR(part[j]) + F.lit(n << 24) for n, (i, j) in enumerate(combinations(range(len(RANGES)), 2))])


def _block_keys() -> Column:
    """SimHash blocks: the majority of the bits of every three of the sample, hashed anew for 64 bits, and the places of the three; of a smaller sample, all of it."""
    part = [F.col(f"s{i + 1}") for i in range(SAMPLE)]
    mixed = [F.xxhash64(x) for x in part]
    few = F.when(part[BLOCK - 1].isNull(), F.xxhash64(*part[: BLOCK - 1]))

    def majority(a: Column, b: Column, c: Column) -> Column:
        return a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c))

    unknown = F.lit(None).cast("int")
    block = lambda key, places: F.when(key.isNotNull(), F.struct(key.alias("key"), *[x.alias(y) for x, y in zip(places, PLACES, strict=True)]))
    of = lambda c: block(F.when(part[c[-1]].isNotNull(), majority(*[mixed[i] for i in c])), [F.col(f"p{i + 1}") for i in c])
    return F.array(block(few, [unknown] * BLOCK), *[of(c) for c in combinations(range(SAMPLE), BLOCK)])


def _close(n, m, similarity: float) -> Column:
    return n.isNotNull() & m.isNotNull() & (F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - 1e-9)


def _edits(n: Column, m: Column, similarity: float) -> Column:
    """How many edits lines of these lengths may take."""
    return F.floor(F.greatest(n, m) * F.lit(round(1 - similarity, 9)) + 1e-9)


def _placed(x, y, similarity: float) -> Column:
    """Whether the parts that two lines share leave few enough edits: they are in one order, and what is before, between and behind them takes the edits by which its lengths differ."""
    a, b, c = PLACES
    inner = lambda of: (of(a) + of(b) + of(c) - F.least(of(a), of(b), of(c)) - F.greatest(of(a), of(b), of(c)))
    edges = lambda of: [F.lit(0), F.least(of(a), of(b), of(c)), inner(of), F.greatest(of(a), of(b), of(c)), of("len")]
    order = [(x(i) < x(j)) == (y(i) < y(j)) for i, j in combinations(PLACES, 2)]
    shifts = [q - p for p, q in zip(edges(x), edges(y), strict=True)]
    least = sum((F.abs(t - s) for s, t in zip(shifts[1:], shifts[2:], strict=False)), F.abs(shifts[1]))
    fits = order[0] & order[1] & order[2] & (least <= _edits(x("len"), y("len"), similarity))
    return F.coalesce(fits, F.lit(True))  # parts that are there more than once are of no known place


def _alike(known: list[str], x, y, similarity: float) -> Column:
    """What two lines of a bucket must be like to be compared; ranges need SimHashes that are near."""
    near = F.bit_count(x("sim").bitwiseXOR(y("sim"))) <= MAX_BITS if "sim" in known else _placed(x, y, similarity)
    return _close(x("len"), y("len"), similarity) & near


def _once(known: DataFrame) -> DataFrame:
    """``known`` with ``earlier``, the line's blocks of smaller keys: of the buckets that two lines share only the first in which they are alike makes a pair of them."""
    before = Window.partitionBy("node").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("earlier", F.collect_list(F.struct("key", *[c for c in known.columns if c not in ("node", "key", "len", "c")])).over(before))


def _met(known: list[str], x: str, y: str, similarity: float) -> Column:
    """Whether an earlier bucket makes a pair of the rows ``x`` and ``y``."""
    of = lambda row, block: lambda c: F.col(f"{row}.len") if c == "len" else block[c]
    keys = F.arrays_overlap(F.col(f"{x}.earlier.key"), F.col(f"{y}.earlier.key"))
    return keys & F.exists(f"{x}.earlier", lambda b: F.exists(f"{y}.earlier", lambda d: (b["key"] == d["key"]) & _alike(known, of(x, b), of(y, d), similarity)))


def _pairs(known: DataFrame, similarity: float) -> DataFrame:
    """Each pair ``(a, b)`` of lines of different groups that are alike in a bucket, once whatever number of buckets they share."""
    x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
    rows = _once(known)
    both = (x("key") == y("key")) & (x("node") < y("node")) & (x("c") != y("c")) & _alike(known.columns, x, y, similarity)
    return rows.alias("x").join(rows.alias("y"), both & ~_met(known.columns, "x", "y", similarity)).select(x("node").alias("a"), y("node").alias("b"))


def _buckets(lines: DataFrame, similarity: float) -> DataFrame:
    """``(key, node, len)``, and ``sim`` or the parts' places, of the lines with a neighbour by length in a bucket, and those before it by length and by place."""
    if "sim" in lines.columns:
        known, keyed = ["node", "len", "sim"], lines.select("node", "len", "sim", F.explode(_range_keys()).alias("key"))
        orders = [["len", "node"]]
    else:
        known, keyed = ["node", "len", *PLACES], lines.select("node", "len", F.inline(_block_keys())).where("key is not null")
        orders = [["len", "node"], [PLACES[0], "len", "node"]]
    keyed = keyed.repartition("key")
    by = [Window.partitionBy("key").orderBy(*o) for o in orders]
    # By length, whoever has a close partner at all has one beside it; most lines have none, and go before anything else is asked.
    n, row = F.col("len"), F.struct(*known)
    before, after = _close(n, F.lag("len").over(by[0]), similarity), _close(n, F.lead("len").over(by[0]), similarity)
    rows = keyed.select("key", *known, (before | after).alias("close")).where("close")
    rows = rows.select("key", *known, *[F.lag(row).over(w).alias(f"prev{i}") for i, w in enumerate(by)])
    prevs = [F.when(_alike(known, F.col, lambda c, i=i: F.col(f"prev{i}.{c}"), similarity), F.col(f"prev{i}.node")) for i in range(len(by))]
    return rows.select("key", *known, F.array_compact(F.array(*prevs)).alias("prev"))


def _texts(docs: DataFrame, lines: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, norm)`` of the lines in ``nodes``, each read at one place where it occurs."""
    place = F.struct("node", "h1", "h2", "at_pos")
    asked = lines.join(nodes, "node", "left_semi").groupBy(F.col("at_doc").alias("doc")).agg(F.collect_list(place).alias("places"))
    whole = docs.select(F.col(id_col).alias("doc"), F.split(F.col(text_col).cast("string"), "\n").alias("parts")).where("parts is not null")
    read = whole.join(asked, "doc").select(F.explode(F.transform("places", lambda p: F.struct(p["node"].alias("node"), p["h1"].alias("h1"), p["h2"].alias("h2"), F.get("parts", p["at_pos"]).alias("line")))).alias("p"))
    read = read.select("p.node", "p.h1", "p.h2", F.trim(_normal(F.col("p.line"))).alias("norm"))
    # Rows of equal id may differ in text, so the line itself decides.
    return read.where((F.xxhash64("norm") == F.col("h1")) & (F.xxhash64("norm", F.lit("other")) == F.col("h2"))).select("node", "norm")


def _walked(x: Column, y: Column) -> Column:
    """At least as many edits as ``y`` takes from ``x``: words of ``x`` are met in ``y`` one after another, the stretches passed over in between are compared as such."""
    shorter, longer = F.concat(x, F.lit(" ")), F.concat(y, F.lit(" "))
    passed = lambda s, n: F.call_function("levenshtein", shorter.substr(s["from"], s["left"]), longer.substr(s["at"], n))

    def step(s, w):
        size = F.length(w)
        hit = F.call_function("locate", w, longer.substr(s["at"], s["left"] + size + REACH))
        state = lambda since, at, left, edits: F.struct(since.alias("from"), at.alias("at"), left.alias("left"), edits.alias("edits"))
        met = lambda hit: F.when(hit > 0, state(s["from"] + s["left"] + size, s["at"] + hit - 1 + size, F.lit(0), s["edits"] + passed(s, hit - 1))).otherwise(
            state(s["from"], s["at"], s["left"] + size, s["edits"])
        )
        # Most words stand where the one before ends.
        next_to = (s["left"] == 0) & (longer.substr(s["at"], size) == w)
        return F.when(next_to, state(s["from"] + size, s["at"] + size, F.lit(0), s["edits"])).otherwise(F.get(F.transform(F.array(hit), met), F.lit(0)))

    start = F.struct(F.lit(1).alias("from"), F.lit(1).alias("at"), F.lit(0).alias("left"), F.lit(0).alias("edits"))
    return F.aggregate(F.regexp_extract_all(shorter, F.lit("[^ ]* "), F.lit(0)), start, step, lambda s: s["edits"] + passed(s, F.length(longer) - s["at"] + 1))


def _verified(pairs: DataFrame, text: DataFrame, similarity: float, likely: bool = False) -> DataFrame:
    """Those pairs ``(a, b)`` of lines whose edit similarity is enough.

    For most long lines that are alike a walk along their words shows it, which is much cheaper; of pairs that are not ``likely`` alike only the longest
    are worth it. What a walk leaves goes to a table, so that no pair is walked twice.
    """
    side = lambda node, norm: text.select(F.col("node").alias(node), F.col("norm").alias(norm))
    x, y = F.col("x"), F.col("y")
    size, most = F.greatest(F.length("x"), F.length("y")), _edits(F.length("x"), F.length("y"), similarity).cast("int")
    near = (x == y) | (size >= (WALKED if likely else WALKED_ANYWAY)) & (_walked(x, y) <= most)
    similar = F.call_function("levenshtein", x, y, most) >= 0
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    # Rows of equal id and text may give a line twice.
    if not likely:
        return both.where(near | similar).select("a", "b").distinct()
    both = both.select("a", "b", "x", "y", near.alias("near"))
    both = cut(both.select("a", "b", "near", *[F.when(~F.col("near"), F.col(c)).alias(c) for c in ("x", "y")]), "lines-walked")
    other = both.where("not near").where(similar)
    links = cut(both.where("near").select("a", "b").union(other.select("a", "b")).distinct(), "lines-links")
    forget(both)
    return links


def _grouped(docs: DataFrame, min_words: int, similarity: float, id_col: str, text_col: str, blocks: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences, lines, and the ``component`` of each linked ``node``."""
    if not 0.5 < similarity <= 1:
        raise ValueError("the similarity must be over 0.5 and at most 1")
    occ = cut(_occurrences(docs, min_words, id_col, text_col, blocks), "lines-occurrences")
    lines = cut(_distinct(occ), "lines-distinct")
    occ = _without_samples(occ, "lines-places")
    bucket = cut(_buckets(lines, similarity), "lines-buckets")
    lines = _without_samples(lines, "lines-plain")
    texts = cut(_texts(docs, lines, bucket.select("node").distinct(), id_col, text_col), "lines-texts")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = cut(bucket.select("node", F.explode("prev").alias("prev")).where("prev <> node").select(*ordered("node", "prev")).distinct(), "lines-first")
    links = _verified(first, texts, similarity, True)
    found = cut(components(links), "lines-components")

    # What still spans groups: every pair of lines of different groups there is tested; where these are many, groups grow by a few tests of each line before.
    tested, by_key, worth = [first], Window.partitionBy("key"), True
    for turn in range(TURNS + 1):
        known = bucket.drop("prev").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
        known = known.repartition("key").withColumns({"lo": F.min("c").over(by_key), "hi": F.max("c").over(by_key)}).where("lo <> hi").drop("component", "lo", "hi")
        known = cut(known, "lines-known")
        alike = lambda x, y: (x("c") != y("c")) & _alike(known.columns, x, y, similarity)  # noqa: B023, E731
        of = known.groupBy("key", "c").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        size = of.agg(F.sum("n").alias("lines"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
        if turn == TURNS or not worth or not size["lines"] or size["pairs"] <= CROWDED * size["lines"]:
            break
        mixed, row = by_key.orderBy(F.xxhash64("node", F.lit(turn)), "node"), F.struct(*[c for c in known.columns if c != "key"])
        beside = [F.lag(row, i + 1).over(mixed).alias(f"prev{i}") for i in range(NEIGHBOURS)]
        prevs = [F.when(alike(F.col, lambda c, i=i: F.col(f"prev{i}.{c}")), F.col(f"prev{i}.node")) for i in range(NEIGHBOURS)]
        some = known.select("*", *beside).select("node", F.explode(F.array_compact(F.array(*prevs))).alias("prev")).select(*ordered("node", "prev")).distinct()
        tested.append(cut(some, "lines-some"))
        forget(known)
        new = cut(_verified(tested[-1], texts, similarity), "lines-links")
        worth = new.count() >= WORTH * tested[-1].count()
        found = _joined(found, new)
        forget(new)
    more = cut(_pairs(known, similarity).join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti"), "lines-more")
    if not more.isEmpty():
        found = _joined(found, _verified(more, texts, similarity))
    for table in (bucket, texts, links, known, more, *tested):
        forget(table)
    return occ, lines, found


def _without_samples(table: DataFrame, name: str) -> DataFrame:
    """A cut table without the samples, which are the larger part of it and not asked for once there are buckets."""
    if "s1" not in table.columns:
        return table
    after = cut(table.drop(*[f"{c}{i + 1}" for c in "sp" for i in range(SAMPLE)]), name)
    forget(table)
    return after


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Groups with new links: groups so far are stars, which new links join by their members."""
    stars = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    after = cut(components(stars.union(links)), "lines-components")
    forget(found)
    return after


def _lid(h1, h2) -> Column:
    """The 16 bytes that stand for a line, ordered as its number."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(digits(F.col(h1).bitwiseXOR(F.lit(_TOP).cast("long"))), digits(F.col(h2))))


def line_groups(docs: DataFrame, min_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", sketches: bool = False) -> tuple[DataFrame, DataFrame]:
    """Occurrences ``(doc, pos, lid, ...)`` and lines ``(lid, group, times)``; ``sketches`` make candidates of SimHash blocks of samples, or without them one SimHash of each line."""
    occ, lines, found = _grouped(docs, min_words, similarity, id_col, text_col, sketches)
    heads = lines.select(F.col("node").alias("component"), _lid("h1", "h2").alias("group"))
    groups = lines.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(heads, "component")
    return occ.select("doc", "pos", _lid("h1", "h2").alias("lid"), "len", *[c for c in occ.columns if c == "sim"]), groups.select(_lid("h1", "h2").alias("lid"), "group", "times")


def dedup_lines(docs: DataFrame, min_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from its text, and ``n_lines, n_removed long`` appended."""
    occ, lines, found = _grouped(docs, min_words, similarity, id_col, text_col, blocks=True)
    several = lines.select("h1", "h2", "node", "times").join(found, "node", "left").where("times > 1 or component is not null")
    several = several.select("h1", "h2", F.coalesce("component", "node").alias("group"))
    rows = cut(occ.select("doc", "pos", "h1", "h2").join(several, ["h1", "h2"]).select("doc", "pos", "group"), "lines-repeated")
    forget(occ)
    forget(lines)
    heads = rows.groupBy("group").agg(F.min(F.struct("doc", "pos")).alias("head"))
    gone = rows.join(heads, "group").where((F.col("doc") != F.col("head.doc")) | (F.col("pos") != F.col("head.pos")))
    gone = gone.groupBy("doc").agg(F.collect_set("pos").alias("__gone")).withColumnRenamed("doc", "__doc")
    marked = docs.join(gone, F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    parts = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone")
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    marked = replace_columns(marked, {"n_lines": n_lines, "n_removed": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")})
    return marked.withColumn(text_col, text).drop("__gone")
