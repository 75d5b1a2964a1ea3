"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines of at least ``min_chars`` characters that are equal, or within an edit distance of
``distance``, fall in one class; every document keeps the lines that are the first of their class
(least doc_id, then position) and loses the others. Shorter lines stay, or, with ``short``, go where an
equal line came before them if they hold a word; the edit distance is no measure of theirs, as two edits
turn one short word into another.

Equal lines are found by hash. Of the different ones, every line is cut into distance + 1 segments,
indexed by (length, segment number, segment); two lines within the distance share a segment at
places that differ by no more than the edits on either side, so a line probes only those substrings
for each length up to its own. Keys that different lines meet in are found by an aggregate; only the lines
that have one go on, with their letter counts, and only pairs whose counts allow the distance leave the
join. Numbered lines (logs, table rows) share their wording and so their segments, all of them; where a key
would make more than ``CROWDED`` pairs, its lines meet on what is left of their digits after up to ``distance``
deletions as well, which two strings of digits within the distance have in common.
Spark's bounded levenshtein turns most of the others away;
the pairs left lose their common prefix and suffix and are verified with a banded bit-parallel edit
distance: one column of the band is a few bits of a long, and each character of the shorter line
updates it.

Lines are known by 64-bit hashes. Defined cases: null or empty text has no lines and stays as it is;
a document whose doc_id is null stays whole and is never the first of a class; rows with one doc_id
are one document; equal lines inside one document are a class like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.components import connected_components
from trialspark.llm.staging import small_or_plain, stage

SEPARATOR = "\n"


def shape(length: Column, shorter: int, k: int) -> Column:
    """How a line with ``shorter`` characters less is cut into k segments: size, the base length of a
    segment, and the number of segments of just that length (the others, one longer, come last)."""
    size = length - shorter
    return F.struct(F.lit(shorter).alias("d"), size.alias("size"), F.floor(size / k).cast("int").alias("base"),
                    (k - size % k).alias("short"))


def segment(t: Column, i: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a shape."""
    return t["base"] * i + F.greatest(i - t["short"], F.lit(0)) + 1, t["base"] + (i >= t["short"]).cast("int")


def segment_keys(line: Column, length: Column, t: Column, distance: int, probe: bool) -> Column:
    """Array of the keys (some null) of a line's segments by its shape t; or, to ``probe``, of all its parts
    that can be segments of a line of shape t, with i edits left of segment i at most, and distance - i
    right of it."""
    out = []
    for i in range(distance + 1):
        start, n = segment(t, i)
        if not probe:
            out.append(F.xxhash64(t["size"], F.lit(i), F.substring(line, start, n)))
            continue
        low = F.greatest(F.lit(-i), t["d"] - (distance - i))
        high = F.least(F.lit(i), t["d"] + (distance - i))
        most = max(min(i, d + distance - i) - max(-i, d - distance + i) for d in range(distance + 1)) + 1
        for m in range(most):
            at = start + low + m
            out.append(F.when((low + m <= high) & (at >= 1) & (at + n <= length + 1),
                              F.xxhash64(t["size"], F.lit(i), F.substring(line, at, n))))
    return F.array(*out)


def _common(a: Column, b: Column, most: Column, part) -> Column:
    """Length of the longest common prefix (or suffix, by ``part``), up to 2^18 - 1, by halving steps."""
    return F.aggregate(F.array(*[F.lit(1 << s) for s in range(17, -1, -1)]), F.lit(0),
                       lambda got, step: F.when((got + step <= most) & (part(a, got + step) == part(b, got + step)),
                                                got + step).otherwise(got))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _bits(x: Column, y: Column, op: str) -> Column:
    return {"and": x.bitwiseAND, "or": x.bitwiseOR, "xor": x.bitwiseXOR}[op](y)


#: two longs hold the counts of twelve letters each
LETTERS = ("etaonirsdhlu", "cmfpgwybvkxq")


def letter_counts(line: Column, letters: str) -> Column:
    """Counts of the letters modulo 32, five bits each in a long."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        n = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        out = out + F.shiftleft((n % 32).cast("long"), 5 * i)
    return out


def alike(pairs: list[tuple[Column, Column]], distance: int) -> Column:
    """A necessary condition on the letter counts of lines within ``distance``: an edit changes the counts of
    two letters by one each at most."""
    total = F.lit(0).cast("long")
    for (a, b), letters in zip(pairs, LETTERS):
        for i in range(len(letters)):
            one, two = (F.shiftright(x, 5 * i).bitwiseAND(F.lit(31).cast("long")) for x in (a, b))
            d = F.abs(one - two)
            total = total + F.least(d, F.lit(32).cast("long") - d)
    return total <= 2 * distance


#: pairs that a key may make before its lines are parted by their digits, and digits up to which they are
CROWDED, MOST_DIGITS = 10_000, 16


def digits_left(digits: Column, distance: int) -> Column:
    """What is left of a line's digits after up to ``distance`` deletions. Lines within the distance have one such
    string in common, as their digits are within it too. Longer strings of digits all meet under one mark, which
    those of nearly that length have besides their own."""
    def shorter(s: Column) -> Column:
        # for the empty string the sequence is [1], which leaves it as it is
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
                           lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    level = F.array(digits)
    every = level
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        every = F.concat(every, level)
    n = F.length(digits)
    mark = F.array(F.lit("*"))
    return (F.when(n > MOST_DIGITS, mark).when(n > MOST_DIGITS - distance, F.concat(F.array_distinct(every), mark))
            .otherwise(F.array_distinct(every)))


def within_distance(pairs: DataFrame, distance: int) -> DataFrame:
    """``pairs`` without their texts x and y, of which those stay whose edit distance is at most ``distance``."""
    longer = F.char_length("x") >= F.char_length("y")
    p = pairs.select("*", F.when(longer, F.col("x")).otherwise(F.col("y")).alias("__a"),
                     F.when(longer, F.col("y")).otherwise(F.col("x")).alias("__b"))
    a, b = F.col("__a"), F.col("__b")

    def core(s: Column, l: Column, r: Column) -> Column:
        return F.regexp_extract_all(F.substring(s, l + 1, F.char_length(s) - l - r), F.lit("(?s)."), F.lit(0))

    def trimmed(n: Column) -> Column:
        return _let(_common(a, b, n, lambda s, k: F.substring(s, F.lit(1), k)), lambda l: _let(
            _common(a, b, n - l, lambda s, k: F.right(s, k)),
            lambda r: F.struct(core(a, l, r).alias("a"), core(b, l, r).alias("b"))))

    # written before it is filtered: a filter pushed below would put the texts' expressions into every step
    p = stage(p.select(*[c for c in pairs.columns if c not in ("x", "y")], _let(F.char_length(b), trimmed).alias("__c")),
              "line_cores")
    width = 2 * distance + 1
    mask = F.lit((1 << width) - 1).cast("long")
    p = p.select("*", F.col("__c.a").alias("__a"), F.col("__c.b").alias("__b")).drop("__c")
    a, b, m, n = F.col("__a"), F.col("__b"), F.size("__a"), F.size("__b")
    zero = F.lit(0).cast("long")

    def bit(x: Column, at) -> Column:
        return _bits(F.call_function("shiftrightunsigned", x, at), F.lit(1).cast("long"), "and")

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        eq = zero
        for k in range(width):
            eq = eq + F.when(F.get(a, j - 1 - distance + k) == c, F.lit(1 << k).cast("long")).otherwise(zero)
        vp, vn = s["vp"], s["vn"]

        def horizontal(d0: Column) -> Column:
            hp = _bits(_bits(vn, F.bitwise_not(_bits(d0, vp, "or")), "or"), mask, "and")
            hn = _bits(d0, vp, "and")
            down = F.shiftright(d0, 1)
            row = width - 1 - (j - (m - distance))
            moved = F.when(j <= m - distance, 1 - bit(d0, F.lit(width - 1))).otherwise(bit(hp, row) - bit(hn, row))
            return F.struct(
                _bits(_bits(hn, F.bitwise_not(_bits(down, hp, "or")), "or"), mask, "and").alias("vp"),
                _bits(down, hp, "and").alias("vn"), (s["d"] + moved).alias("d"))

        def diagonal(e: Column) -> Column:
            d0 = _bits(_bits(_bits(_bits(_bits(e, vp, "and") + vp, vp, "xor"), e, "or"), vn, "or"), mask, "and")
            return _let(d0, horizontal)

        return _let(eq, diagonal)

    start = F.struct(F.lit(((1 << (distance + 1)) - 1) << distance).cast("long").alias("vp"), zero.alias("vn"),
                     F.lit(distance).cast("long").alias("d"))
    band = F.aggregate(F.sequence(F.lit(1), n), start, step)["d"]
    near = (F.when(m - n > distance, F.lit(False)).when(m <= distance, F.lit(True))
            .otherwise(band <= distance))
    return p.where(near).drop("__a", "__b")


def _split(column="text") -> Column:
    return F.split(F.col(column), SEPARATOR)


#: a character that can stand in a word
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def line_classes(docs: DataFrame, distance: int = 2, min_chars: int = 20, short: bool = False) -> DataFrame:
    """The lines that are not the first of their class: staged (doc_id, drop), drop an array of positions."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    counts = F.char_length("line") >= min_chars
    if short:
        counts = counts | F.col("line").rlike(WORD)
    lines = docs.select("doc_id", F.posexplode(_split()).alias("pos", "line")).where(counts)
    occurs = stage(lines.select("doc_id", "pos", F.xxhash64("line").alias("id")), "lines")
    first = stage(occurs.groupBy("id").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("n"))
                  .select("id", "f.doc_id", "f.pos", "n"), "first")
    again = (occurs.join(first.where("n > 1").select("id", F.col("doc_id").alias("fd"), F.col("pos").alias("fp")), "id")
             .where((F.col("doc_id") != F.col("fd")) | (F.col("pos") != F.col("fp"))).select("doc_id", "pos").distinct())
    again = stage(again.groupBy("doc_id").agg(F.collect_list("pos").alias("drop")), "again")

    # segments of first occurrences only
    kept = (docs.join(small_or_plain(again, 64), "doc_id", "left")
            .select("drop", F.posexplode(_split()).alias("pos", "line"))
            .where((F.char_length("line") >= min_chars) & ~F.coalesce(F.array_contains("drop", F.col("pos")), F.lit(False))))
    length, k = F.char_length("line"), distance + 1

    def keys(probe: bool) -> DataFrame:
        # shapes leave a generator as columns, so that the keys' expressions stay small enough to be compiled
        shapes = F.array(*[shape(F.col("length"), d, k) for d in range(distance + 1 if probe else 1)])
        # and the line's hash and keys are columns below the next, so that generated rows carry no text
        cut = kept.select("line", length.alias("length"), F.xxhash64("line").alias("id")).select(
            "*", F.explode(shapes).alias("t")).where(F.col("t.size") >= min_chars)
        # explode_outer: a plain explode infers a filter on the array's size, which would build the keys again
        found = segment_keys(F.col("line"), F.col("length"), F.col("t"), distance, probe)
        return (cut.select("id", found.alias("keys")).select("id", F.lit(probe).alias("probe"), F.explode_outer("keys").alias("key"))
                .where("key is not null"))

    # first the keys that different lines meet in, then only the lines that have such a key
    every = keys(False).union(keys(True))
    shared = stage(every.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.bool_or("probe").alias("p"),
                                            F.bool_and("probe").alias("q")).where("a < b and p and not q").select("key"),
                   "shared_keys")
    entries = stage(every.join(small_or_plain(shared, 16), "key", "left_semi").distinct(), "line_keys")

    ids = stage(entries.select("id").distinct().join(first, "id").select("doc_id", "pos", "id"), "line_ids")
    want = stage(ids.groupBy("doc_id").agg(F.collect_list("pos").alias("want")), "line_docs")
    texts = stage(docs.join(small_or_plain(want, 64), "doc_id")
                  .select(F.posexplode(_split()).alias("pos", "line"), "want")
                  .where(F.array_contains("want", F.col("pos")))
                  .select(F.xxhash64("line").alias("id"), "line").distinct()
                  .select("id", "line", F.regexp_replace("line", "[^0-9]", "").alias("digits"), *[letter_counts(F.col("line"), x).alias(f"c{i}") for i, x in enumerate(LETTERS)]),
                  "line_texts")
    crowded = stage(entries.groupBy("key").agg(F.count_if("probe").alias("a"), F.count_if(~F.col("probe")).alias("b"))
                    .where(F.col("a") * F.col("b") > CROWDED).select("key", F.lit(True).alias("crowded")), "crowded_keys")
    counted = entries.join(texts.drop("line"), "id").join(small_or_plain(crowded, 16), "key", "left")
    part = F.when(F.col("crowded"), digits_left(F.col("digits"), distance)).otherwise(F.array(F.lit("")))
    counted = counted.select("key", "id", "probe", "c0", "c1", F.explode_outer(part).alias("part"))
    index = counted.where("not probe").select("key", "part", F.col("id").alias("u"), F.col("c0").alias("u0"), F.col("c1").alias("u1"))
    probe = counted.where("probe").select("key", "part", F.col("id").alias("v"), F.col("c0").alias("v0"), F.col("c1").alias("v1"))
    meet = ((index["key"] == probe["key"]) & (index["part"] == probe["part"]) & (F.col("u") != F.col("v"))
            & alike([(F.col("u0"), F.col("v0")), (F.col("u1"), F.col("v1"))], distance))
    pairs = stage(index.join(probe, meet).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                  .distinct(), "line_pairs")
    both = (pairs.join(texts.select(F.col("id").alias("u"), F.col("line").alias("x")), "u")
            .join(texts.select(F.col("id").alias("v"), F.col("line").alias("y")), "v"))
    # the bounded distance of Spark turns most false candidates away at once
    both = both.where(F.levenshtein("x", "y", distance) >= 0).select("u", "v", "x", "y")
    links = stage(within_distance(both, distance), "line_links")
    part = connected_components(links, native=True)
    roots = part.select(F.col("component").alias("id"), "component").distinct()
    named = stage(part.select(F.col("node").alias("id"), "component").union(roots).join(first, "id")
                  .select("id", "component", "doc_id", "pos"), "line_classes")
    keeper = named.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("k"))
    later = (named.join(keeper, "component").where(F.struct("doc_id", "pos") != F.col("k"))
             .groupBy("doc_id").agg(F.collect_list("pos").alias("drop")))
    return stage(again.union(later).groupBy("doc_id").agg(F.flatten(F.collect_list("drop")).alias("drop")), "line_drops")


def dedup_lines(docs: DataFrame, distance: int = 2, min_chars: int = 20, short: bool = False) -> DataFrame:
    """``docs`` with text without its repeated lines, n_lines (before) and n_dropped; columns of these
    names are replaced."""
    drops = line_classes(docs, distance, min_chars, short).select(F.col("doc_id").alias("__id"), F.col("drop").alias("__drop"))
    out = docs.drop("n_lines", "n_dropped").join(small_or_plain(drops, 64), F.col("doc_id") == F.col("__id"), "left")
    gone = F.col("__drop")
    left = F.array_join(F.filter(_split(), lambda x, i: ~F.array_contains(gone, i)), SEPARATOR)
    return out.select(
        *[F.when(gone.isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c)
          for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(_split())).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
