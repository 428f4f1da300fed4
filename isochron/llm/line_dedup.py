"""Line dedup by an exact set-similarity join, in DataFrame expressions.

A line is the set of its words. Words are ordered by rarity: their hashes fall into 65,536 buckets,
whose words are counted over all distinct lines, and a word's place is (rank of its bucket, rest of its hash). Of
each distinct line the rarest words, as many as two lines of Jaccard similarity ``least`` must have one
of in common (the prefix), are dealt out by word. Where lines meet, pairs stay if their lengths, the
places of the word and parity maps of their words allow that similarity; they are then verified on
the words themselves. A line goes if an equal or similar one occurs before it, by doc_id and line
number (null ids come first).

The join is made in two steps, so that a group of k alike lines does not give k * k / 2 pairs. First a
line meets, among those with the same last words of the prefix, only the line just before it and the
first one; that decides nearly all lines of such groups; where it does not, a few more are looked at. Only the lines that are still open then meet
all earlier lines that share a word of the prefix with them and are of about their length; the shorter of two lines
comes with a shorter prefix. What is found is exact.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.llm.common import SPACE, WORD, cut, release_shuffles, row_keyed, salt, spread_join, stored

BUCKETS = 1 << 16
HOT, SALTS = 4096, 64  # a word whose bucket is above average and has so many words is dealt to so many tasks
SMALL, MIDDLE = 72, 180  # lines of up to so many words have parity maps of 64 and 128 bits; longer ones of 256
WITHIN, NEAREST = 64, 8  # so many lines before one are looked at, and so many verified, if it is like others but not like the line before or the first
WIDTH = 3  # bands of lengths are so many times as wide as similar lines' lengths may be apart
PARTS = 3  # the join is made for one part of the words after the other, for less disk
BROADCAST_LINES = 1_000_000  # ids of lines (16 bytes each) that are sent to all tasks, counted first
MAPS = ("m0", "m1", "m2", "m3")


def _blank(line: Column) -> Column:
    return ~((F.ascii(line) > 32) | line.rlike(WORD))  # most lines are told by their first character


def lines(docs: DataFrame) -> DataFrame:
    """doc, pos (from 0), line of ``docs`` (doc, text): what line feeds separate, without lines that are white space only. Null counts as empty."""
    # outer: no null text passes the next filter; else a test of the array for emptiness is added, which splits each text twice
    rows = docs.select("doc", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(~_blank(F.col("line")))


def single_spaced(line: Column) -> Column:
    """The words of ``line`` with one blank between them: splitting them needs no regular expression."""
    odd = reduce(lambda u, v: u | v, [F.contains(line, F.lit(c)) for c in ("\t", "\v", "\f", "\r", "  ")])
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))


def words_of(line: Column) -> Column:
    return F.split(line, " ")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """doc, pos, line of the first of each set of equal lines (same XXH64 and number of bytes) of ``docs`` (doc, text).

    Equal lines are combined before the shuffle, so that one that is in many documents reaches its task once from each.
    """
    keyed = lines(docs).select(F.xxhash64("line").alias("h"), F.octet_length("line").alias("size"), F.struct("doc", "pos", "line").alias("own"))
    return keyed.groupBy("h", "size").agg(F.min("own").alias("first")).select("first.*")


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 48)


def bucket_ranks(distinct: DataFrame) -> tuple[list[int], int]:
    """By bucket of word hashes its rank in ascending order of occurrences in ``distinct`` (line); the rank from which words may be frequent."""
    words = distinct.select(F.explode_outer(words_of(F.col("line"))).alias("w"))
    rows = words.groupBy(_bucket(F.xxhash64("w")).alias("bucket")).count().collect()  # at most BUCKETS rows
    counts = dict.fromkeys(range(BUCKETS), 0) | {r.bucket: r["count"] for r in rows}
    order = sorted(counts, key=lambda k: (counts[k], k))
    ranks = [0] * BUCKETS
    for rank, bucket in enumerate(order):
        ranks[bucket] = rank
    frequent = max(HOT, 2 * sum(counts.values()) // BUCKETS)
    return ranks, sum(n < frequent for n in counts.values())


def line_sets(distinct: DataFrame, ranks: list[int], least: tuple[int, int]) -> DataFrame:
    """doc, pos, n, parity maps, bands and prefix of the lines of ``distinct`` (doc, pos, line): n is the number of different words, band that of n, reach that of the longest similar lines, prefix the places of the rarest words."""
    a, b = least
    # by the first 16 bits of a hash what turns them into the rank: xor with it makes a place of a hash
    turned = [(rank - BUCKETS // 2) % BUCKETS ^ bucket for bucket, rank in enumerate(ranks)]
    shifted = ",".join(str((t - BUCKETS * (t >= BUCKETS // 2)) << 48) for t in turned)
    ranking = F.split(F.lit(shifted), ",").cast("array<bigint>")  # folded to a literal

    none = F.lit(0).cast("bigint")
    # Functions of arrays are not compiled: as few steps a word as can be, array_distinct and sort_array, which are compiled, around them.
    # coalesce: an array without nulls is sorted as plain numbers
    place = lambda h: h.bitwiseXOR(F.coalesce(F.get(ranking, _bucket(h)), none))
    places = F.transform(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)), place)
    sets = distinct.select("doc", "pos", F.sort_array(F.array_distinct(places)).alias("words"))
    sets = sets.select("doc", "pos", "words", F.size("words").alias("n"))

    def parity(k: int, size: int) -> Column:
        """Bits of the words that fall into number k of ``size``."""
        flipped = lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int")))
        own = lambda acc, h: flipped(acc, h) if size == 1 else F.when(h.bitwiseAND((size - 1) << 6) == k << 6, flipped(acc, h)).otherwise(acc)
        return F.aggregate("words", none, own)

    maps = [F.when(F.col("n") > MIDDLE, parity(k, 4)).when(F.col("n") > SMALL, parity(k, 2) if k < 2 else none).otherwise(parity(0, 1) if k == 0 else none).alias(MAPS[k]) for k in range(4)]
    taken = F.col("n") - F.expr(f"(n * {a} + {b - 1}) div {b}").cast("int") + 1
    bands = band(F.col("n"), least).alias("band"), band(F.expr(f"n * {b} div {a} + 1"), least).alias("reach")
    return sets.select("doc", "pos", "n", *maps, *bands, F.slice("words", 1, taken).alias("prefix"))


def band(n: Column, least: tuple[int, int]) -> Column:
    """Number of the band of lengths of ``n``: a band is WIDTH times as wide as the reach of a similar line's length (a little wider, for rounding), so that most lines have all longer ones like them in their own band."""
    a, b = least
    return F.floor(F.ln(n) / F.lit(WIDTH * max(1.001 * math.log(b / a), 1e-3))).cast("int")


def _meeting(sets: DataFrame, least: tuple[int, int], part: int) -> DataFrame:
    """ydoc, ypos, xdoc, xpos, apart of the pairs of ``sets`` that may be similar, y being later and open; of words of number ``part`` of PARTS.

    Of two lines the shorter one comes with a shorter prefix: similar lines have at least 2 n a / (a + b)
    words in common, n being the length of the shorter. It is dealt to its own band of lengths, and to the next one if similar lines may be in that.
    """
    a, b = least
    of = lambda prefix: lambda c: F.col(prefix + c)
    taken = F.expr(f"n - (2 * n * {a} + {a + b - 1}) div {a + b} + 1").cast("int")
    own = [c for c in sets.columns if c not in ("band", "reach", "prefix")]
    deal = lambda df: df.select(*own, "band", "reach", F.posexplode_outer("prefix").alias("p", "w")).where(F.pmod("w", F.lit(PARTS)) == part)
    # the band goes into the word's bits, as one key is sorted faster than two; words that fall together by that only add candidates
    banded = lambda k: F.col("w").bitwiseXOR(F.shiftleft(k.cast("bigint"), 32)).alias("w")
    long = deal(sets).select(*own, "p", banded(F.col("band")))
    short = deal(sets.withColumn("prefix", F.slice("prefix", 1, taken)))
    bands = F.when(F.col("reach") > F.col("band"), F.array("band", "reach")).otherwise(F.array("band"))
    short = short.select(*own, "p", "w", F.explode_outer(bands).alias("band")).select(*own, "p", banded(F.col("band")))
    s, l = (df.select("w", *(F.col(c).alias(k + c) for c in df.columns if c != "w")) for df, k in ((short, "s"), (long, "l")))
    first = (F.col("sdoc") < F.col("ldoc")) | ((F.col("sdoc") == F.col("ldoc")) & (F.col("spos") < F.col("lpos")))
    once = (F.col("sn") < F.col("ln")) | ((F.col("sn") == F.col("ln")) & first)
    met = s.join(l, "w").where(once & _may(of("s"), of("l"), least) & F.when(first, F.col("lopen") == 1).otherwise(F.col("sopen") == 1))
    later, earlier = (F.when(c, F.struct(F.col("ldoc").alias("doc"), F.col("lpos").alias("pos"))).otherwise(F.struct(F.col("sdoc").alias("doc"), F.col("spos").alias("pos"))) for c in (first, ~first))
    met = met.select(later.alias("y"), earlier.alias("x"), apart(of("s"), of("l")).alias("apart"))
    return met.select(F.col("y.doc").alias("ydoc"), F.col("y.pos").alias("ypos"), F.col("x.doc").alias("xdoc"), F.col("x.pos").alias("xpos"), "apart").distinct()


def _may(x, y, least: tuple[int, int], first: bool = True) -> Column:
    """Whether lines that meet in a word may be similar; ``x`` and ``y`` give their columns by name.

    ``first``: that word is to be the first that both have, so that they share none before their places p of it.
    """
    a, b = least
    n, m = x("n"), y("n")
    lengths, maps = (m * a <= n * b) & (n * a <= m * b), apart(x, y) <= unlike(x, y, least)
    if not first:
        return lengths & maps
    left = F.least(n - x("p"), m - y("p"))  # words that both may have from there on: at least (n + m) a / (a + b)
    return lengths & (left * (a + b) >= (n + m) * a) & maps


def unlike(x, y, least: tuple[int, int]) -> Column:
    """How many words similar lines may have that are not in both: of n + m words, twice as many as (n + m) a / (a + b), rounded up, are shared."""
    a, b = least
    total = x("n").cast("bigint") + y("n")
    return total - 2 * F.floor((total * a + (a + b - 1)) / F.lit(a + b))


def apart(x, y) -> Column:
    """In how many bits the parity maps of two lines differ: the larger map is folded to the size of the smaller. Never more than the words they do not share."""
    maps = lambda side: [side(m) for m in MAPS]
    xor = lambda *parts: reduce(lambda u, v: u.bitwiseXOR(v), parts)
    p, q = maps(x), maps(y)
    small = F.least(x("n"), y("n"))
    two = F.bit_count(xor(p[0], p[2], q[0], q[2])) + F.bit_count(xor(p[1], p[3], q[1], q[3]))
    four = reduce(lambda u, v: u + v, [F.bit_count(xor(u, v)) for u, v in zip(p, q, strict=True)])
    return F.when(small <= SMALL, F.bit_count(xor(*p, *q))).when(small <= MIDDLE, two).otherwise(four)


def verified(pairs: DataFrame, distinct: DataFrame, least: tuple[int, int]) -> DataFrame:
    """doc, pos of the later line of each of ``pairs`` (ydoc, ypos, xdoc, xpos) whose words, by ``distinct`` (doc, pos, line), are similar enough.

    A line of many pairs goes to as many tasks as its pairs are dealt to.
    """
    a, b = least
    key = lambda df, s: df.select(F.col("doc").alias(s + "doc"), F.col("pos").alias(s + "pos"), *(F.col(c).alias(s) for c in df.columns if c == "line"))
    own = lambda s: pairs.select(F.col(s + "doc").alias("doc"), F.col(s + "pos").alias("pos"))
    needed = own("x").unionByName(own("y")).distinct()
    needed = stored(distinct.join(few(needed), ["doc", "pos"], "left_semi"))
    both = spread_join(pairs, key(needed, "x"), ["xdoc", "xpos"], ["ydoc", "ypos"])
    both = both.join(key(needed, "y"), ["ydoc", "ypos"])
    both = both.select("ydoc", "ypos", F.array_distinct(words_of(F.col("x"))).alias("x"), F.array_distinct(words_of(F.col("y"))).alias("y"))
    alike = F.size(F.array_intersect("x", "y")) * (a + b) >= (F.size("x") + F.size("y")) * a
    return cut(both.where(alike).select(F.col("ydoc").alias("doc"), F.col("ypos").alias("pos")).distinct())


def few(ids: DataFrame) -> DataFrame:
    """``ids`` written, with a hint to broadcast them if they were counted to be few."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids


def similar_lines(distinct: DataFrame, least: tuple[int, int]) -> DataFrame:
    """doc, pos of the lines of ``distinct`` (doc, pos, line; written) that are similar to an earlier one."""
    of = lambda prefix: lambda c: F.col(prefix + c)
    y = ["ydoc", "ypos"]
    ranks, frequent = bucket_ranks(distinct)
    sets = stored(line_sets(distinct, ranks, least))

    # the line before and the first one among those with the same last words of the prefix: words that copies with
    # changes of their own still share, as such changes are rare words and come first
    last = lambda k: F.try_element_at("prefix", F.lit(-k))
    keys = F.array(*(F.struct(F.xxhash64(last(k), last(k + 1)).alias("key"), last(k).alias("w")) for k in (1, 2)))
    some = sets.select("doc", "pos", "n", *MAPS, F.explode(keys).alias("k")).select("doc", "pos", "n", *MAPS, "k.*").where("w IS NOT NULL")
    hot = F.shiftright("w", 48) + BUCKETS // 2 >= frequent
    some = some.withColumn("salt", F.when(hot, salt("doc", "pos", salts=SALTS)).otherwise(0)).drop("w")
    group = W.partitionBy("key", "salt").orderBy("doc", "pos")
    known = F.struct("doc", "pos", "n", *MAPS)
    met = some.select("*", F.lag(known).over(group).alias("last"), F.first(known).over(group.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("head")).where("last IS NOT NULL")
    own = lambda side: F.struct(apart(side, of("")).alias("apart"), side("doc").alias("xdoc"), side("pos").alias("xpos"))
    near = lambda s: F.when(_may(of(s + "."), of(""), least, first=False), own(of(s + ".")))
    about = lambda s: 2 * apart(of(s + "."), of("")) <= 3 * unlike(of(s + "."), of(""), least)
    some_near = about("last") | about("head")
    met = met.select("key", F.col("doc").alias("ydoc"), F.col("pos").alias("ypos"), F.least(near("last"), near("head")).alias("near"), some_near.alias("some_near"))
    met = stored(met.where("near IS NOT NULL OR some_near"))
    found = met.where("near IS NOT NULL").groupBy(*y).agg(F.min("near").alias("near"))
    gone = verified(cut(found.select(*y, "near.xdoc", "near.xpos")), distinct, least)

    # lines of groups that are alike, but not the line before or the first one, meet more of the lines before, and the nearest are verified
    named = lambda df: df.select(F.col("doc").alias("ydoc"), F.col("pos").alias("ypos"))
    doubtful = cut(met.where("some_near").select("key", *y).join(few(named(gone)), y, "left_anti"))
    there = some.join(few(doubtful.select("key").distinct()), "key", "left_semi").withColumn("before", F.collect_list(known).over(group.rowsBetween(-WITHIN, -1)))
    asked = there.join(few(doubtful.select(F.col("ydoc").alias("doc"), F.col("ypos").alias("pos")).distinct()), ["doc", "pos"], "left_semi")
    nearest = F.slice(F.array_sort(F.transform(F.filter("before", lambda x: _may(x.__getitem__, of(""), least, first=False)), lambda x: own(x.__getitem__))), 1, NEAREST)
    more = asked.select(F.col("doc").alias("ydoc"), F.col("pos").alias("ypos"), F.explode(nearest).alias("near")).select(*y, "near.xdoc", "near.xpos")
    gone = cut(gone.unionByName(verified(cut(more.distinct()), distinct, least)).distinct())

    # lines that are still open meet all earlier ones, whether those are shorter or longer
    marked = sets.join(few(gone.withColumn("gone", F.lit(1))), ["doc", "pos"], "left").withColumn("open", F.when(F.col("gone").isNull(), 1).otherwise(0)).drop("gone")
    parts = []
    for k in range(PARTS):
        release_shuffles(distinct.sparkSession)  # those of the part before
        parts.append(stored(_meeting(marked, least, k)))
    pairs = stored(reduce(DataFrame.unionByName, parts).distinct())
    closest = pairs.groupBy(*y).agg(F.min(F.struct("apart", "xdoc", "xpos")).alias("near")).select(*y, "near.xdoc", "near.xpos")
    gone = gone.unionByName(verified(closest, distinct, least))
    rest = pairs.drop("apart").join(few(named(gone)), y, "left_anti")
    return gone.unionByName(verified(cut(rest), distinct, least)).distinct()


def _kept(keyed: DataFrame, least: tuple[int, int]) -> DataFrame:
    """doc and kept_lines (numbers, in order) of the rows of ``keyed`` (doc: a unique number, text) that keep a line."""
    distinct = distinct_lines(keyed).withColumn("line", single_spaced(F.col("line")))
    distinct = stored(distinct, compression="zstd")
    kept = distinct.select("doc", "pos").join(similar_lines(distinct, least), ["doc", "pos"], "left_anti")
    return kept.groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("kept_lines"))  # of one document


def kept_lines(docs: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed, kept_lines.

    n_lines counts lines that are not white space only (such lines always stay and are not listed),
    kept_lines lists the numbers of those that stay, in order. ``least`` is the Jaccard similarity as
    (numerator, denominator). Rows with a null or repeated id are documents of their own, in order of
    the hash of their text. Other columns are ignored. An empty table gives no rows.
    """
    keyed = row_keyed(docs.select("doc_id", "text"))
    kept = _kept(keyed.select(F.col("__row").alias("doc"), "text"), least)
    counted = keyed.select("__row", "doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: ~_blank(line))).alias("n_lines"))
    out = counted.join(kept, F.col("__row") == F.col("doc"), "left").withColumn("kept_lines", F.coalesce("kept_lines", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept_lines")).alias("n_removed"), "kept_lines")


def drop_repeated_lines(docs: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with the text of each row reduced to the lines that stay; other columns are kept, a column n_chars is made anew.

    Texts that lose all their lines become empty; null texts stay null. One row per row: rows with a null or
    repeated id are documents of their own.
    """
    keyed = row_keyed(docs)
    kept = _kept(keyed.select(F.col("__row").alias("doc"), "text"), least).select(F.col("doc").alias("__row"), F.col("kept_lines").alias("__kept"))
    parts = F.split("text", "\n")
    numbers = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1))
    blank = F.filter(numbers, lambda i: _blank(F.get(parts, i)))
    stay = F.sort_array(F.array_union(F.coalesce("__kept", F.array().cast("array<int>")), blank))
    text = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    out = keyed.join(kept, "__row", "left").withColumn("text", text).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out
