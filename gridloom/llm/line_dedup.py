"""Fuzzy line dedup by MinHash with Spark expressions only.

Lines are the parts of a text between line feeds; blank ones never count and never go. Lines that are equal
after trimming and lower-casing form one class (named by a 64-bit hash). A class has the set of its distinct shingles of ``k``
characters, or the whole line as one if it is shorter. Classes that share a band of their signatures are candidates, and a link counts
only if the exact sets have a Jaccard similarity of at least ``percent`` hundredths. Of each component of links the first
line stays, by document id (null first), row key and place.

Signatures are MinHash with one permutation: the hash of a shingle chooses one of ``bands`` times ``rows`` components and
stands for itself there, and a component is the least of what falls to it. Lines with few shingles draw several times; later draws count
only where earlier ones left a component empty, so lines of different lengths stay comparable. A line whose few distinct
shingles repeat many times has fewer components filled and is found by the bands that are.

Candidates are never listed as pairs of a bucket. Every class is first verified against the least class of most of its buckets, then, if it
is still apart from others of a large bucket, against the likeliest of a few hubs, and the links found so far are put together by union-find.
What is still apart within a bucket is then joined on a bound that the sizes and 1024-bit parities of two sets give: sets whose parities
differ in d bits differ in at least d shingles, so only pairs that may be similar enough leave that join, and all of them are verified.

Null and empty texts have no lines. Rows with the same id and text count as one document, so they keep the
same lines. Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.joins import spread
from gridloom.llm.common import broadcast_if_small, drop_stored, fresh, release, setting, stored
from gridloom.llm.components import components
from gridloom.llm.near_dedup import row_key

#: With 5 characters, lines of 49 characters and more stay at 0.8 after one character changed anywhere. With 16 bands of 5, sets with a
#: similarity of 0.8 are candidates with a probability of 0.998, of 0.9 with more than 0.9999, unrelated lines (0.05) with 0.000005.
SHINGLE_CHARS, PERCENT, BANDS, ROWS = 5, 80, 16, 5
#: Draws that a line makes at least, so that few components stay empty (3 of 100 with 80 components).
DRAWS = 256
#: Two classes are candidates only if at most so many of 64 bits of their signatures differ. At 0.8 a tenth do, more than 18 with a
#: probability of 1e-5; of unrelated classes nearly half.
MOST_BITS_APART = 18
#: Characters that count as blank at the ends of a line: those that Unicode calls white space.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Hubs of a bucket. Buckets of at most so many classes have none: their pairs are few.
HUBS, SMALL_BUCKET = 8, 8
#: Parts of the buckets that are gone through one after the other.
BUCKET_PARTS = 2
#: Stands for the value of an empty component; its lowest bit is 0.
NONE = 2**62
#: Draws are gathered in maps of at most 2 to this power of groups, of 16 for each class. Beyond them (Spark's own bound is 16) gathering takes longer; one page of memory bounds them too.
MAP_BITS = ("spark.sql.codegen.aggregate.fastHashMap.capacityBit", "20")
#: Longs of the parity of a set.
PARITY_LONGS = 16


def _trimmed(line: Column) -> Column:
    """A line without blanks at its ends: white space of any kind, of ASCII and beyond."""
    return F.trim(line, F.lit(_BLANKS))


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns id, row_key, place (from 0), line (trimmed, in lower case) and class of every line that isn't blank.

    Lines are trimmed before they are dealt to rows, else Spark would do it again for each use. From an inner posexplode it would infer a filter that splits the text once more.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.lower(F.when(_has_plain_ends(x), x).otherwise(_trimmed(x))))
    rows = docs.select(F.col(key).alias("id"), row_key(key, text).alias("row_key"), F.posexplode_outer(lines).alias("place", "line"))
    return rows.where("line != ''").withColumn("class", F.xxhash64("line"))


def _has_plain_ends(line: Column) -> Column:
    """Whether a line begins and ends with visible ASCII, so that there is nothing to trim. Trimming a set of characters looks at every byte of a line."""
    last = F.substring(line.cast("binary"), -1, 1)
    return F.ascii(line).between(0x21, 0x7E) & last.between(F.lit(b"\x21"), F.lit(b"\x7e"))


def _shingle(wide: Column, at: Column, k: int) -> Column:
    """The hash of the ``k`` characters from byte ``at`` of UTF-16 text."""
    return F.xxhash64(F.substring(wide, at, F.lit(2 * k)))


def _places(wide: Column, k: int) -> Column:
    """The bytes of UTF-16 text where its shingles begin, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(wide) - 2 * k + 1), F.lit(2))


def _of_wide(line: Column | str, of: Callable[[Column], Column]) -> Column:
    """``of`` the line in UTF-16. The wide text is bound to a variable, else it would be made anew for each shingle."""
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), of), F.lit(0))


def shingle_hashes(line: Column | str, k: int) -> Column:
    """The shingles of a line, repeated ones too."""
    return _of_wide(line, lambda wide: F.transform(_places(wide, k), lambda i: _shingle(wide, i, k)))


def shingle_set(line: Column | str, k: int) -> Column:
    """The distinct shingles of a line."""
    return _of_wide(line, lambda wide: F.array_distinct(F.transform(_places(wide, k), lambda i: _shingle(wide, i, k))))


def _distinct(texts: DataFrame, k: int) -> DataFrame:
    """Columns class and h: each shingle of a line once.

    A row's own longs are sorted, which takes no hash table and no boxed numbers. A filter that Spark infers from an inner explode would work them out once more.
    """
    dealt = texts.select("class", F.sort_array(shingle_hashes("line", k)).alias("all")).select("class", "all", F.posexplode_outer("all").alias("at", "h"))
    return dealt.where((F.col("at") == 0) | (F.col("h") != F.get("all", F.col("at") - 1))).select("class", "h")


def signed_classes(lines: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Columns class, bits (64 of the signature) and buckets (one for each band that isn't empty), one row for each class.

    Lines move once, by class; all that follows is grouped within a class and stays where it is.
    """
    wide = lines.select("class", "line").dropDuplicates(["class"]).select("class", F.encode("line", "UTF-16BE").alias("wide"))
    wide = wide.withColumn("n", F.greatest(F.lit(1), F.expr(f"cast(length(wide) div 2 as int) - {k - 1}")))
    # The number of draws is a multiple of n, at least DRAWS.
    last = F.expr(f"if(n >= {DRAWS}, n, cast(ceil({DRAWS} / n) as int) * n) - 1")
    draws = wide.select("class", "wide", "n", F.explode(F.sequence(F.lit(0), last)).alias("draw"))
    # The first draws are told apart without a division.
    drawn = draws.select("class", "wide", F.expr("(if(draw < n, draw, draw % n)) * 2 + 1").alias("at"), F.expr("if(draw < n, 0, cast(draw div n as int))").alias("turn"))
    hashed = drawn.select("class", "turn", F.xxhash64(F.substring(F.col("wide"), F.col("at"), F.lit(2 * k)), "turn").alias("h"))
    component = F.shiftright(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF)) * (bands * rows), 31).cast("int")
    placed = hashed.select("class", component.alias("component"), (F.shiftleft(F.col("turn").cast("long"), 31) + F.shiftrightunsigned("h", 33)).alias("value"))
    dealt = placed.select("class", (F.col("component") % bands).alias("band"), F.expr(f"cast(component div {bands} as int)").alias("row"), "value")
    # A number above all values stands for none: nulls would be asked for at each draw.
    least = dealt.groupBy("class", "band").agg(*(F.min(F.when(F.col("row") == r, F.col("value")).otherwise(F.lit(NONE))).alias(f"m{r}") for r in range(rows)))
    filled = [F.col(f"m{r}") for r in range(rows)]
    # Bits that have no place in the 64 are shifted out by none being taken.
    place = lambda r: F.col("band") * rows + r
    bits = [F.when(place(r) < 64, F.expr(f"shiftleft(m{r} & 1, cast(band * {rows} + {r} as int))")).otherwise(F.lit(0)) for r in range(rows)]
    some = bits[0]
    for b in bits[1:]:
        some = some.bitwiseOR(b)
    keyed = least.select("class", "band", F.xxhash64("band", *filled).alias("bucket"), some.alias("bits"))
    # One column for each band: a list would be gathered by sorting.
    of_band = [F.max(F.when(F.col("band") == j, F.col("bucket"))).alias(f"b{j}") for j in range(bands)]
    wide_rows = keyed.groupBy("class").agg(F.bit_or("bits").alias("bits"), *of_band)
    return wide_rows.select("class", "bits", F.array_compact(F.array(*(f"b{j}" for j in range(bands)))).alias("buckets"))


def candidates(classes: DataFrame) -> DataFrame:
    """Columns bucket and class: the classes of each bucket that have another in it which may be like them, by the bits of their signatures.

    The join looks for one such class only, so no pairs come out of it. Both of its sides are one exchange: buckets move once, at any size of the input. They
    are taken in ``BUCKET_PARTS`` parts, one after the other, so that only the files of one part are on disk at a time.
    """
    exploded = classes.select("class", "bits", F.explode("buckets").alias("bucket"))
    other = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.class") != F.col("b.class")) & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= MOST_BITS_APART)
    found = []
    for part in range(BUCKET_PARTS):
        rows = exploded.where(F.pmod("bucket", F.lit(BUCKET_PARTS)) == part)
        found.append(stored(rows.alias("a").join(rows.alias("b").hint("shuffle_hash"), other, "left_semi").select("bucket", "class"), "line-candidates"))
        release(classes.sparkSession)
    return reduce(DataFrame.unionByName, found)


def described(texts: DataFrame, k: int) -> DataFrame:
    """Columns class, n (size of the shingle set) and p0, p1, ...: bit b of the parity is set if an odd number of shingles fall to it."""
    at = _distinct(texts, k).select("class", F.pmod(F.shiftright("h", 6), F.lit(PARITY_LONGS)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    return at.groupBy("class").agg(F.count("*").alias("n"), *(F.bit_xor(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0))).alias(f"p{j}") for j in range(PARITY_LONGS)))


def _side(members: DataFrame, end: str) -> DataFrame:
    """The members with their columns named for one end of a pair, but for the bucket."""
    return members.select("bucket", F.col("class").alias(end), F.col("root").alias(f"root_{end}"), F.col("n").alias(f"n_{end}"), *(F.col(f"p{j}").alias(f"p{j}_{end}") for j in range(PARITY_LONGS)))


def _apart() -> Column:
    """In how many bits the parities of a and b differ."""
    out = F.lit(0)
    for j in range(PARITY_LONGS):
        out = out + F.bit_count(F.col(f"p{j}_a").bitwiseXOR(F.col(f"p{j}_b")))
    return out


def _possible(percent: int) -> Column:
    """Whether a and b aren't connected yet and may be similar enough, by their sizes and parities."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return (F.col("root_a") != F.col("root_b")) & sizes & (_apart() * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _first_pairs(members: DataFrame) -> DataFrame:
    """For each class the pair with the least class of most of its buckets. No set is looked at for it."""
    hubs = members.groupBy("bucket").agg(F.min("class").alias("hub"))
    met = members.join(hubs, "bucket").where("class != hub").groupBy("class", "hub").agg(F.count("*").alias("n"))
    # The least class of a bucket is less than the others, so no pair comes twice.
    return met.groupBy("class").agg(F.max_by("hub", "n").alias("a")).select("a", F.col("class").alias("b"))


def _hub_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each class the pair with the hub of its buckets whose parity is nearest. The hubs of a bucket are classes of its largest component, drawn by a hash."""
    drawn = [F.max_by("class", F.xxhash64(F.lit(i), "class")) for i in range(HUBS)]
    groups = members.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.array(*drawn).alias("hubs"))
    largest = groups.groupBy("bucket").agg(F.max(F.struct("size", "root", "hubs")).alias("of"))
    hubs = largest.select("bucket", "of.root", F.explode(F.array_distinct("of.hubs")).alias("class"))
    hubs = _side(hubs.join(sets, "class"), "b")
    pairs = _side(members, "a").join(hubs, "bucket").where(_possible(percent))
    best = pairs.groupBy("a").agg(F.min_by("b", _apart() / (F.col("n_a") + F.col("n_b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _still_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members with new roots, of those buckets that hold more than one component."""
    labelled = members.drop("root").join(broadcast_if_small(roots, 24).withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = stored(labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket"), "line-mixed")
    return stored(labelled.join(broadcast_if_small(mixed, 16), "bucket", "left_semi"), "line-members-left")


def _pairs_left(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket that aren't connected and may be similar enough."""
    return _side(members, "a").join(_side(members, "b"), "bucket").where((F.col("a") < F.col("b")) & _possible(percent)).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose exact sets are similar enough; ``texts`` has class and line."""
    side = lambda e: texts.select(F.col("class").alias(e), F.col("line").alias(f"of_{e}"))
    two = pairs.join(side("a"), "a").join(side("b"), "b")
    # Shingles are dealt to a row before they are compared, so that they are worked out once a pair and sets are compiled ones of longs.
    dealt = two.select("a", "b", F.explode_outer(F.array(F.struct(shingle_hashes("of_a", k).alias("a"), shingle_hashes("of_b", k).alias("b")))).alias("of"))
    return dealt.where(F.size(F.array_intersect("of.a", "of.b")) * 100 >= F.size(F.array_union("of.a", "of.b")) * percent).select("a", "b")


def linked_classes(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Columns node and root of all classes with a link. ``members``: bucket and class; ``texts``: class and line; both stored.

    Sizes and parities are worked out for those classes only that the first links leave apart from others of their buckets.
    """
    found = stored(verified(_first_pairs(members), texts, k, percent), "line-links")
    roots = stored(components(found), "line-roots")
    apart = _still_apart(members, roots)
    sets = stored(described(texts.join(spread(apart.select("class").distinct()), "class", "left_semi"), k), "line-sets")
    left = stored(apart.join(sets, "class"), "line-members")
    release(members.sparkSession, apart)
    large = stored(left.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_BUCKET).select("bucket"), "line-large")
    for of_hubs in (True, False):
        if of_hubs:
            if large.isEmpty():
                continue
            pairs = _hub_pairs(left.join(broadcast_if_small(large, 16), "bucket", "left_semi"), sets, percent)
        else:
            pairs = _pairs_left(left, percent)
        new = stored(verified(pairs, texts, k, percent), "line-links")
        if not new.isEmpty():
            found = found.unionByName(new)
            roots = stored(components(found), "line-roots")
            if of_hubs:
                before, left = left, _still_apart(left, roots)
                drop_stored(before)
        release(members.sparkSession)
    release(members.sparkSession, left, sets)
    return roots


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = SHINGLE_CHARS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The lines that go: columns row_key, place, and of_id and of_place of the line that stays for them, once for each document."""
    lines = split_lines(docs, key, text)
    with setting(docs.sparkSession, *MAP_BITS):
        classes = stored(signed_classes(lines, k, bands, rows), "line-classes")
    release(docs.sparkSession)
    members = candidates(classes)
    release(docs.sparkSession, classes)
    wanted = broadcast_if_small(stored(members.select("class").distinct(), "line-wanted"), 16).withColumn("wanted", F.lit(True))
    # One pass over the texts gives the places of all lines and what the candidates say.
    places = stored(lines.join(wanted, "class", "left").select("id", "row_key", "place", "class", F.when(F.col("wanted"), F.col("line")).alias("line")), "line-candidates-placed")
    texts = stored(places.where("line is not null").select("class", "line").dropDuplicates(["class"]), "line-texts")
    roots = linked_classes(members, texts, k, percent)
    labelled = places.drop("line").join(broadcast_if_small(roots, 24).withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("root", "class"))
    labelled = stored(labelled.select("id", "row_key", "place", "group"), "line-places")
    release(docs.sparkSession, places)
    first = labelled.groupBy("group").agg(F.min(F.struct("id", "row_key", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = labelled.join(first, "group").where(~F.struct("id", "row_key", "place").eqNullSafe(F.col("first")))
    return gone.select("row_key", "place", F.col("first.id").alias("of_id"), F.col("first.place").alias("of_place")).distinct()


def with_kept_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", kept: str = "kept", gone: str = "gone", **options) -> DataFrame:
    """``docs`` with two columns more, whose names must be free.

    ``kept`` is the array of lines that stay and ``gone`` an array of struct<place, of_id, of_place> of the others, by place. Both are
    null where no line goes (a null text included).
    """
    found = repeated_lines(docs, key=key, text=text, **options)
    by_row = found.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("place", "of_id", "of_place"))).alias(gone))
    by_row = stored(by_row, "repeated-lines")
    at = fresh("row_key", docs.columns, [kept, gone])
    # Both grow with the input, so texts move once at any size of it.
    joined = docs.withColumn(at, row_key(key, text)).join(spread(by_row.withColumnRenamed("row_key", at)), at, "left")
    places = F.transform(gone, lambda x: x["place"])
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(places, i))
    return joined.withColumn(kept, F.when(F.col(gone).isNotNull(), left)).drop(at)


def without_repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the lines that stay. A document that had lines and keeps none goes."""
    kept, gone = fresh("kept", docs.columns), fresh("gone", docs.columns)
    joined = with_kept_lines(docs, key=key, text=text, kept=kept, gone=gone, **options)
    joined = joined.where(F.col(kept).isNull() | F.exists(kept, lambda x: _trimmed(x) != ""))
    return joined.withColumn(text, F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(docs.columns)
