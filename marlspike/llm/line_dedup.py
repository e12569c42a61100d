"""Line deduplication as an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words. Its place is (doc_id, line number). A line goes when an
earlier line has the same set or one of Jaccard similarity SIMILARITY or more; what it is compared
with need not be kept itself. Lines without a word always stay.

1. Word rarity: counts of all words in hashed buckets give every word a level; words are 64-bit
   numbers, level first, so that sorting puts the rarest first and alike everywhere. The levels are a
   table of one row with BUCKETS numbers, read by a scalar subquery.
2. Equal sets are grouped to their first place with partial aggregation. Sets of fewer than four
   words can equal, but not resemble, another one and go no further.
3. The |s| - ceil(t |s|) + 1 rarest words are a set's prefix. Slices of it that several sets have in common lead
   each of these sets to the first of them, and those that do not resemble it to the first of other parts of them, LEADERS
   times in all: that settles groups of near copies with as many comparisons as they have lines.
4. Of two similar sets the smaller one has a common word among its |s| - ceil(2t / (1 + t) |s|) + 1 rarest
   ones, which are posted, and the larger one in its prefix, which is looked up. Words of a high level are
   posted by classes of sizes besides, so that the length filter holds in the key. A settled set meets only later
   ones that are not: numbers of sets follow their places.
   Length, positional and parity-bitmap filters hold inside the join; lines of LONG_SIZE words have bitmaps twice as wide.
   Before all pairs are made, unsettled sets meet a few of the settled ones, WITNESSES: what resembles many of them is
   settled by one, and all its other pairs are not made.
5. Candidates are verified on their word sets, read again from the lines concerned.

Joins are equi-joins that adaptive execution can split; nothing is collected. Broadcast are bitmaps of at most
BITMAP_BITS / 64 rows. Words are compared by 56 bits of their hashes; words of prefixes by 26, which can only add
candidates.

Null and empty texts have no lines to remove. Rows that repeat a doc_id are one place: equal places
are not earlier than each other. A null doc_id comes first. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap, by_marks, marked, materialise, scratch, slot_of, table

SIMILARITY = 0.8
BUCKETS = 1 << 20
#: Rows of levels that are gathered to one array at a time.
CHUNK = 1 << 10
LEAST_SIZE = 4
#: Times that sets with a common slice of the prefix are compared with the first one of them, or of a part of them.
LEADERS = 5
#: Least level of the words in these slices: those with a count of four.
COMMON = 8
#: Words of 64 bits in the wide bitmap of a set that is a candidate.
WIDE = 4
#: Words from which a set has a second bitmap: of fewer, unlike ones differ in enough bits of 64.
LONG_SIZE = 96
#: One in so many settled sets is met, one after the other, before all are.
WITNESSES = (64, 8)
#: Level (four times the logarithm of the count) from which words are posted by classes of sizes.
CLASSED = 24
#: Ratio of sizes within a class.
CLASS_RATIO = 1.5
#: What separates words besides blanks and line ends.
BLANKS = "\t\x0B\f\r"


def cleaned(text: Column) -> Column:
    """Lower-cased text whose words are separated by blanks and line ends alone."""
    odd = F.lit(False)
    for c in BLANKS:
        odd = odd | F.contains(text, F.lit(c))
    return F.lower(F.when(odd, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (lower-cased) of the lines with a word."""
    lines = docs.filter(F.length("text") > 0).select("doc_id", F.posexplode(F.split(cleaned(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.filter(F.length(F.trim("line")) > 0)


def word_levels(docs: DataFrame) -> DataFrame:
    """One row, levels: for each bucket of word hashes four times the logarithm of the count."""
    words = docs.filter(F.length("text") > 0).select(F.explode(F.split(F.replace(cleaned(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w != ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
    level = F.least(F.floor(F.log2("n") * 4 + 1e-9), F.lit(63)).cast("int")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("b"), F.lit(0).alias("level")).union(counts.select("b", level))
    numbers = lambda key, value, name: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[name])
    single = every.groupBy("b").agg(F.max("level").alias("level"))
    chunks = single.groupBy(F.expr(f"b div {CHUNK}").alias("c")).agg(numbers("b", "level", "level").alias("part"))
    return materialise(chunks.agg(F.flatten(numbers("c", "part", "part")).alias("levels")))


def with_words(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """line becomes s: distinct words as sorted numbers, the rarest first."""
    rest = [c for c in lines.columns if c != "line"]
    # analysis forbids a subquery in a lambda; the optimiser puts it there, as long as each column is used once
    beside = lines.withColumn("levels of all", levels.scalar())
    level = lambda h: F.coalesce(F.get("levels of all", h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0))
    hashes = F.transform(F.array_remove(F.split("line", " "), ""), lambda w: F.xxhash64(w))
    coded = F.transform(hashes, lambda h: F.shiftleft(level(h).cast("bigint"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1))))
    return beside.select(*rest, F.array_distinct(F.sort_array(coded)).alias("s"))


def line_sets(docs: DataFrame, levels: DataFrame) -> DataFrame:
    """h, place, own (size, bits, more, prefix) of every line with words. A prefix holds 6 bits of level and 26 of the hash."""
    size = F.size("s")
    prefix = F.slice("s", F.lit(1), size - F.ceil(size * SIMILARITY - 1e-9).cast("int") + 1)
    folded = F.transform(prefix, lambda w: (F.shiftleft(F.shiftright(w, 56), 26).bitwiseOR(w.bitwiseAND(F.lit((1 << 26) - 1))) - (1 << 31)).cast("int"))
    long = size >= LEAST_SIZE
    more = parity(F.filter("s", lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(1)) == 1))
    return with_words(lines_of(docs), levels).select(
        F.xxhash64("s").alias("h"),
        F.struct("doc_id", "line_no").alias("place"),
        F.struct(size.alias("size"), F.when(long, parity("s")).alias("bits"), F.when(size >= LONG_SIZE, more).otherwise(F.lit(0).cast("bigint")).alias("more"), F.when(long, folded).alias("prefix")).alias("own"),
    )


# Doubles: a plain 0.8 is a decimal in SQL, and joins compare very many pairs.
LEAST, LEAST_SHARED = f"{SIMILARITY!r}D", f"{SIMILARITY / (1 + SIMILARITY)!r}D"
#: Bits that differ: of two long sets those of the words with a mark and of the words without, of others those of all words.
DIFFERENT = f"""CASE WHEN a.size >= {LONG_SIZE} AND b.size >= {LONG_SIZE} THEN bit_count(a.more ^ b.more) + bit_count(a.bits ^ a.more ^ b.bits ^ b.more)
    ELSE bit_count(a.bits ^ b.bits) END"""
FILTERS = f"""a.size >= {LEAST} * b.size - 1e-9 AND b.size >= {LEAST} * a.size - 1e-9
    AND (a.size + b.size - {DIFFERENT}) / 2 >= {LEAST_SHARED} * (a.size + b.size) - 1e-9"""
POSITIONS = f"least(a.size - a.pos, b.size - b.pos) >= {LEAST_SHARED} * (a.size + b.size) - 1e-9"
EARLIER = "(y_doc < x_doc OR (y_doc IS NULL AND x_doc IS NOT NULL) OR (y_doc <=> x_doc AND y_line < x_line))"


def words_of(ids: DataFrame, docs: DataFrame, sets: DataFrame, levels: DataFrame) -> DataFrame:
    """id, doc_id, line_no, s, size, wide of these sets: their words, read again from the lines at their places, and the parity of
    the words in each of 64 * WIDE buckets."""
    own = marked(sets.select("id", "h", "place"), slot_of("id"), bitmap(ids.select(slot_of("id").alias("slot")).distinct()))
    own = materialise(own.join(ids, "id", "left_semi").select("id", "h", "place.doc_id", "place.line_no"))
    at_place = F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(BITMAP_BITS))
    lines = marked(docs, slot_of("doc_id"), bitmap(own.select(slot_of("doc_id").alias("slot")).distinct()))
    lines = marked(lines_of(lines), at_place, bitmap(own.select(at_place.alias("slot")).distinct()))
    # another line of an equal set is as good as the first one
    read = with_words(lines, levels).select(F.xxhash64("s").alias("h"), "s").groupBy("h").agg(F.first("s").alias("s"))
    wide = F.array(*[parity("s", 6 + 6 * WIDE.bit_length(), 6, k) for k in range(WIDE)])
    return materialise(own.join(read, "h").drop("h").withColumns({"size": F.size("s"), "wide": wide}))


def parity(words: str | Column, part_at: int = 0, bit_at: int = 0, part: int | None = None) -> Column:
    """The parity of the words in each of 64 buckets, of those words alone, with a part, that it falls to among WIDE."""

    def flipped(acc: Column, w: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(w, bit_at).bitwiseAND(F.lit(63)).cast("int"))
        return acc.bitwiseXOR(bit if part is None else F.when(F.shiftright(w, part_at).bitwiseAND(F.lit(WIDE - 1)) == part, bit).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(words, F.lit(0).cast("bigint"), flipped)


def later_of_similar(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """id of the sets that resemble an earlier one of their pairs (a, b)."""
    # long lines pass a bitmap of 64 bits by chance: a wider one is compared before their words are sent for
    slim = lambda x, key: read.select(F.col("id").alias(key), F.col("size").alias(f"{x}_size"), F.col("wide").alias(f"{x}_wide"))
    differ = " + ".join(f"bit_count(x_wide[{k}] ^ y_wide[{k}])" for k in range(WIDE))
    pairs = pairs.join(slim("x", "a"), "a").join(slim("y", "b"), "b").filter(f"(x_size + y_size - ({differ})) / 2 >= {LEAST_SHARED} * (x_size + y_size) - 1e-9").select("a", "b")
    pairs = materialise(pairs)
    side = lambda x, key: read.select(F.col("id").alias(key), F.col("doc_id").alias(f"{x}_doc"), F.col("line_no").alias(f"{x}_line"), F.col("s").alias(x + "_s"))
    both = pairs.join(side("x", "a"), "a").join(side("y", "b"), "b")
    shared = F.size(F.array_intersect("x_s", "y_s"))
    similar = both.filter(shared >= SIMILARITY * (F.size("x_s") + F.size("y_s") - shared) - 1e-9)
    swapped = EARLIER.replace("y_", "z_").replace("x_", "y_").replace("z_", "x_")
    return similar.select(F.expr(f"CASE WHEN {EARLIER} THEN a WHEN {swapped} THEN b END").alias("id")).filter("id IS NOT NULL").distinct()


def settled_by_leaders(own: DataFrame, docs: DataFrame, sets: DataFrame, levels: DataFrame) -> DataFrame:
    """id of sets that resemble an early one with a common slice of the prefix."""
    # words of a copy's own, which every change brings in, are left out: slices hold words that several lines have
    common = F.filter("prefix", lambda w: w >= (COMMON << 26) - (1 << 31))
    by_hash = F.sort_array(F.transform("common", lambda w: w.bitwiseAND(F.lit((1 << 26) - 1))))
    sliced = own.withColumn("common", common).filter(F.size("common") > 0).withColumn("by_hash", by_hash)
    keys = F.array(F.xxhash64(F.lit(1), F.slice("common", 1, 3)), F.xxhash64(F.lit(2), F.slice("by_hash", 1, 3)), F.xxhash64(F.lit(3), F.slice(F.reverse("by_hash"), 1, 3)))
    keyed = sliced.withColumn("k", F.explode(keys))
    several = materialise(bitmap(keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select(slot_of("k").alias("slot")).distinct()))
    every = left = materialise(marked(keyed.select("k", "place", "id", "size", "bits", "more"), slot_of("k"), several))
    read = words_of(left.select("id").distinct(), docs, sets, levels)
    found = None
    for turn in range(LEADERS):
        # settled sets lead too: what is left is far from the middle of its group, and those are not
        led = every.filter(F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(4)) == 0) if turn else every
        first = led.groupBy("k").agg(F.min(F.struct("place", "id", "size", "bits", "more")).alias("f")).select("k", "f.*")
        pairs = left.alias("a").join(first.alias("b"), F.expr(f"a.k = b.k AND a.id > b.id AND {FILTERS}")).selectExpr("a.id AS a", "b.id AS b").distinct()
        new = materialise(later_of_similar(pairs, read))
        found = new if found is None else found.union(new)
        left = materialise(left.join(new, "id", "left_anti"))
    return found.distinct()


def posting_pairs(unsettled: DataFrame, settled: DataFrame, among: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, of sets of which b is not settled, that share a word within their prefixes and pass the filters.

    Without among a is settled. Sets without the column more have a bitmap of 64 bits alone.
    """
    posted = F.col("size") - F.ceil(F.col("size") * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-9) + 1
    rest = ["id", "size", "bits", "more", "pos", "settled"]
    more = F.col("more") if "more" in unsettled.columns else F.lit(0).cast("bigint")
    of_size = lambda n: F.floor(F.log(n) / F.lit(math.log(CLASS_RATIO))).cast("int")
    own_class = F.array(of_size(F.col("size")))
    classes = F.sequence(of_size(F.ceil(F.col("size") * SIMILARITY - 1e-9)), of_size(F.col("size")))
    words = lambda df, is_settled: df.select("id", "size", "bits", more.alias("more"), F.lit(is_settled).alias("settled"), F.posexplode("prefix").alias("pos", "w"))

    def keyed(df: DataFrame, kind: int, classes: Column) -> DataFrame:
        classed = F.shiftright(F.col("w").cast("bigint") + (1 << 31), 26) >= CLASSED
        return df.withColumn("of", F.explode(F.when(classed, classes).otherwise(F.array(F.lit(-1))))).select(F.xxhash64(F.lit(kind), "w", "of").alias("k"), *rest)

    looked_up, hidden = words(unsettled, False), words(settled, True)
    # settled sets look up words of unsettled ones too, of which only such words are posted again
    theirs = materialise(bitmap(hidden.select(slot_of("w").alias("slot")).distinct()))
    again = marked(looked_up, slot_of("w"), theirs)
    left = keyed(looked_up if among else again, 0, classes).union(keyed(again.filter(F.col("pos") < posted), 1, own_class)).drop("settled")
    right = keyed((looked_up.union(hidden) if among else hidden).filter(F.col("pos") < posted), 0, own_class).union(keyed(hidden, 1, classes))
    pairs = left.alias("a").join(right.alias("b"), F.expr(f"a.k = b.k AND a.id != b.id AND (a.id > b.id OR NOT b.settled) AND {FILTERS} AND {POSITIONS}"))
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def by_found(own: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets that are not found, sets that are)."""
    marks = materialise(bitmap(found.select(slot_of("id").alias("slot")).distinct()))
    maybe = marked(own, slot_of("id"), marks)
    return marked(own, slot_of("id"), marks, False).union(maybe.join(found, "id", "left_anti")), maybe.join(found, "id", "left_semi")


def resembling(sets: DataFrame, docs: DataFrame, levels: DataFrame) -> DataFrame:
    """The id of sets that resemble a set whose first place is earlier."""
    own = sets.filter(F.col("prefix").isNotNull()).select("id", "place", "size", "bits", "more", "prefix")
    found = materialise(settled_by_leaders(own, docs, sets, levels))
    own = own.drop("place")
    for share in (*WITNESSES, 1):
        unsettled, settled = by_found(own, found)
        met = settled.filter(F.pmod(F.xxhash64(F.lit(share), "id"), F.lit(share)) == 0)
        pairs = materialise(posting_pairs(unsettled, met, among=share == 1))
        read = words_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, sets, levels)
        found = materialise(found.union(later_of_similar(pairs, read)).distinct())
    return found


def numbered(sets: DataFrame) -> DataFrame:
    """sets with an id that grows with their places."""
    return sets.orderBy("place").withColumn("id", F.monotonically_increasing_id())


def kept_places(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and kept: the numbers, from 0, of the lines with words that stay, in order.

    One row for each doc_id that has such lines.
    """
    with scratch(docs.sparkSession):
        return materialise(find_kept_places(docs.select("doc_id", "text")), stays=True)


def find_kept_places(docs: DataFrame) -> DataFrame:
    levels = word_levels(docs)
    sets = line_sets(docs, levels).groupBy("h").agg(F.min_by("own", "place").alias("own"), F.min("place").alias("place")).select("h", "place", "own.*")
    sets = materialise(numbered(sets))
    near = resembling(sets, docs, levels)
    firsts = sets.select("id", "place").join(near, "id", "left_anti").select("place.doc_id", "place.line_no")
    lines = F.split(cleaned(F.col("text")), "\n")
    worded = F.filter(F.transform(lines, lambda line, i: F.when(F.length(F.trim(line)) > 0, i)), lambda i: i.isNotNull())
    total = docs.filter(F.length("text") > 0).select("doc_id", worded.alias("worded")).groupBy("doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("worded")))).cast("bigint").alias("n_lines")).filter("n_lines > 0")
    kept = firsts.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("kept"))
    joined = total.alias("t").join(kept.alias("k"), F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")), "left")
    return joined.select("t.doc_id", "n_lines", F.coalesce(F.size("kept"), F.lit(0)).cast("bigint").alias("n_kept"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def remove_later_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that resemble earlier ones; all columns stay.

    Documents that lose every line with a word go; those that had none stay as they are.
    """
    # rows of one doc_id may have lines of different numbers, of which kept holds all
    found = kept_places(docs).filter("n_kept < n_lines")
    maybe, other = by_marks(docs, found)
    found = found.select(*[F.col(c).alias(f"{c} of line dedup") for c in found.columns])  # no column of docs has such a name
    own, total, n, kept = (found[f"{c} of line dedup"] for c in ("doc_id", "n_lines", "n_kept", "kept"))
    joined = maybe.join(found, maybe["doc_id"].eqNullSafe(own), "left").filter(total.isNull() | (n > 0))
    lines = F.filter(F.split(maybe["text"], "\n"), lambda line, i: ~F.regexp_like(line, F.lit(r"\S")) | F.array_contains(kept, i))
    text = F.when(n < total, F.array_join(lines, "\n")).otherwise(maybe["text"])
    return other.union(joined.select(*[text.alias("text") if c == "text" else maybe[c] for c in docs.columns]))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_kept (lines with words), kept: line numbers joined by commas."""
    docs = table(spark, sf_dir, "documents")
    kept = kept_places(docs).alias("k")
    every = docs.select("doc_id").distinct().alias("d")
    joined = every.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left")
    return joined.select("d.doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce(F.array_join(F.col("kept").cast("array<string>"), ","), F.lit("")).alias("kept"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(parts[i]), '\\s+'), lambda w: w <> ''))) AS s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE length(text) > 0), unnest(range(1, len(parts) + 1)) AS r(i)
), worded AS (SELECT * FROM lines WHERE len(s) > 0),
sets AS (SELECT s, min((doc_id, line_no)) AS place, row_number() OVER () AS id FROM worded GROUP BY s),
words AS (SELECT id, place, len(s) AS n, unnest(s) AS w FROM sets WHERE len(s) >= 4),
counts AS (SELECT w, count(*) AS c FROM words GROUP BY w),
ranked AS (SELECT id, place, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS k FROM words JOIN counts USING (w)),
prefixes AS (SELECT * FROM ranked WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefixes a JOIN prefixes b ON a.w = b.w AND b.place < a.place
  AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
), near AS (
  SELECT DISTINCT x FROM (SELECT x, a.s AS p, b.s AS q, len(list_intersect(a.s, b.s)) AS m FROM pairs JOIN sets a ON a.id = x JOIN sets b ON b.id = y)
  WHERE m >= 0.8 * (len(p) + len(q) - m) - 1e-9
), firsts AS (SELECT s, place FROM sets WHERE id NOT IN (SELECT x FROM near)),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS kept
  FROM (SELECT DISTINCT l.doc_id, l.line_no FROM worded l JOIN firsts f ON l.s = f.s AND f.place = (l.doc_id, l.line_no)) GROUP BY doc_id
), totals AS (SELECT doc_id, count(DISTINCT line_no) AS n_lines FROM worded GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(kept, '') AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN totals t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
