"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line (text between newlines) is its set of lower-cased words. A line is removed if an earlier line, by (doc_id, line number), has
Jaccard similarity `percent` or more with it; the earlier line counts whether or not it is removed itself. Lines without words stay.

1. One pass tokenises and writes the words of each line, hashed. From these, BUCKETS hash buckets are counted; a token is as rare as its own
   bucket. Any fixed order gives the same result; rare tokens first give few candidates.
2. Each line gets its tokens in order of rarity, the first n - ceil(t n) + 1 of them (its prefix), a digest and a
   parity bitmap of 128 bits. Equal sets share a digest of 128 bits; the first line of a digest stands for all, and every other copy is removed.
3. Lines that share two rare tokens which are neighbours in both prefixes (SEEDS such places are looked at) meet the earliest such line. This
   removes most of a large family of near copies before its lines could meet one another.
4. What is left meets every earlier line of a prefix token, under the length and positional filters and the bitmap's bound: sets differ
   in at least as many tokens as their bitmaps do in bits.
5. Candidates are verified on their full sets, made anew from the lines in question only.

Null texts have no lines; empty texts have one empty line, which stays. Rows with a null doc_id are left as they are. Of rows with
a repeated doc_id, lines at the same place are removed together if one of them is. Any 64-bit doc_id and any number of lines will do.
Extra columns, whatever their names, are not read by removed_lines and are kept by deduplicate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored

BUCKETS = 1 << 16
SEEDS = 6
#: Lines (a number of 4 bytes each, by document) that are broadcast; more are joined by a shuffle
FEW = 1 << 20
PLACE = ("doc_id", "line_no")
#: Two words of parity bits; a token flips one bit of one of them
MAPS = ("map0", "map1")
#: 128 bits that stand for a set
DIGEST = ("digest", "digest2")


def numbered_lines(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, line_no and line (lower-cased, its white space made blanks), and columns of the document."""
    raw = F.col("text").cast("string")
    odd = F.contains(raw, F.lit("\t")) | F.contains(raw, F.lit("\r")) | F.contains(raw, F.lit("\x0b")) | F.contains(raw, F.lit("\f"))
    text = F.lower(F.when(odd, F.translate(raw, "\t\r\x0b\f", "    ")).otherwise(raw))
    return docs.select("doc_id", *more, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def few(df: DataFrame) -> DataFrame:
    """df (stored), broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def word_sets(lines: DataFrame) -> DataFrame:
    """lines with words, the hashes of its distinct words, in place of line."""
    words = F.array_remove(F.split("line", " "), "")
    return lines.select(*[c for c in lines.columns if c != "line"], F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("words"))


def rarity(sets: DataFrame) -> Column:
    """Classes (two a power of two) of the counts of all hash buckets, as a constant array of fixed size; each plan on the driver holds it."""
    buckets = sets.select(F.explode("words").alias("w")).select(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"))
    counts = buckets.groupBy("b").count().toArrow()  # at most BUCKETS rows
    classes = ["0"] * BUCKETS
    for b, n in zip(*(x.to_pylist() for x in counts.columns), strict=True):
        classes[b] = str(int(2 * math.log2(n)))
    return F.split(F.lit(",".join(classes)), ",").cast("array<int>")


def line_table(sets: DataFrame, classes: Column, percent: int) -> DataFrame:
    """Place, digest, n, head (the prefix) and parity bitmap of each line with words.

    Codes are tokens in order of rarity; the class is the upper byte.
    """
    code = lambda x: F.shiftleft(F.get(classes, x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8))
    rows = sets.select(*PLACE, F.sort_array(F.transform("words", code)).alias("codes"))
    maps = [_parity(lambda x: F.lit(1).cast("long")).alias(MAPS[0]), _parity(lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1))).alias(MAPS[1])]
    n = F.size("codes")
    digests = [F.xxhash64("codes").alias(DIGEST[0]), F.xxhash64(F.lit("second"), "codes").alias(DIGEST[1])]
    rows = rows.select(*PLACE, *digests, n.alias("n"), F.slice("codes", 1, n - F.ceil(n * percent / 100).cast("int") + 1).alias("head"), *maps)
    return rows.withColumn(MAPS[0], F.col(MAPS[0]).bitwiseXOR(F.col(MAPS[1])))


def _parity(bit) -> Column:
    """The parity, in each of 64 places, of bit(x) over the codes x of that place."""
    return F.aggregate("codes", F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(F.call_function("shiftleft", bit(x), x.bitwiseAND(F.lit(63)).cast("int"))))


def similar_size(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def near_maps(a: str, b: str, n: Column, percent: int) -> Column:
    """Whether bitmaps (columns with these prefixes) allow sets of n tokens in all to be similar."""
    apart = sum((F.bit_count(F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}"))) for m in MAPS), F.lit(0))
    return apart * (100 + percent) <= n * (100 - percent)


def with_seeds(reps: DataFrame, *more: str) -> DataFrame:
    """Place, other columns and seed, of each line: the first pairs of neighbours in its prefix, or the tokens of a prefix of one or two."""
    pairs = F.slice(F.array(*[F.xxhash64(F.get("head", F.lit(i)), F.get("head", F.lit(i + 1))) for i in range(SEEDS)]), F.lit(1), F.size("head") - 1)
    return reps.select(*PLACE, *more, F.explode(F.when(F.size("head") <= 2, F.col("head")).otherwise(pairs)).alias("seed"))


def star_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (ad, al, bd, bl) of a line and the earliest one (by document) with an equal seed, under the filters of sizes and maps."""
    lists = with_seeds(reps).groupBy("seed").agg(F.count("*").alias("c"), F.min("doc_id").alias("ad"), F.min_by("line_no", "doc_id").alias("al")).filter("c > 1").drop("c")
    lists = stored(lists, "line-lists")
    own = ["n", *MAPS]
    firsts = reps.select(F.col("doc_id").alias("ad"), F.col("line_no").alias("al"), *[F.col(c).alias(f"a_{c}") for c in own])
    wide = stored(firsts.join(few(lists), ["ad", "al"]), "line-stars")
    met = with_seeds(reps, *own).withColumnsRenamed({c: f"b_{c}" for c in own}).join(few(wide), "seed").filter("ad <> doc_id or al <> line_no")
    ok = similar_size(F.col("a_n"), F.col("b_n"), percent) & near_maps("a_", "b_", F.col("a_n") + F.col("b_n"), percent)
    out = stored(met.filter(ok).select("ad", "al", F.col("doc_id").alias("bd"), F.col("line_no").alias("bl")).distinct(), "line-star")
    discard(lists, wide)
    return out


def prefix_pairs(reps: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """Pairs (ad, al, bd, bl) of an earlier line and one that is not in gone, with a common prefix token and fitting sizes, places and maps.

    A posting is the same whichever side it is on, so both sides of the join read one exchange: `at` holds the line number and whether the line
    is still to be looked at, `size` the set's size and the token's place in it.
    """
    known = reps.join(few(gone).select(*PLACE, F.lit(1).cast("long").alias("out")), list(PLACE), "left")
    at = F.shiftleft(F.col("line_no").cast("long"), 1).bitwiseOR(F.lit(1).cast("long") - F.coalesce("out", F.lit(0).cast("long")))
    post = known.select("doc_id", at.alias("at"), "n", *MAPS, F.posexplode("head").alias("i", "code"))
    post = post.select("code", "doc_id", "at", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("size"), *MAPS)
    post = post.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in post.columns])  # none is NULL: both sides get the same (no) filters
    a, b = post.toDF(*[f"a_{c}" for c in post.columns]), post.toDF(*[f"b_{c}" for c in post.columns])
    na, nb = F.shiftright("a_size", 32), F.shiftright("b_size", 32)
    ia, ib = F.col("a_size").bitwiseAND(F.lit((1 << 32) - 1)), F.col("b_size").bitwiseAND(F.lit((1 << 32) - 1))
    line = lambda x: F.shiftright(f"{x}_at", 1)
    earlier = (F.col("a_doc_id") < F.col("b_doc_id")) | (F.col("a_doc_id") == F.col("b_doc_id")) & (line("a") < line("b"))
    # of the first token that both have, the shared ones are this and what follows in both
    places = F.least(na - ia, nb - ib) * (100 + percent) >= (na + nb) * percent
    # whether b is still to be looked at; a stands in it as well, since a filter of one side would part the exchanges
    open_ = F.col("b_at").bitwiseAND(F.lit(1)) * 2 + F.col("a_at").bitwiseAND(F.lit(1)) >= 2
    fits = near_maps("a_", "b_", na + nb, percent) & places & earlier & similar_size(na, nb, percent) & open_
    return a.join(b, (F.col("a_code") == F.col("b_code")) & fits).select(F.col("a_doc_id").alias("ad"), line("a").cast("int").alias("al"), F.col("b_doc_id").alias("bd"), line("b").cast("int").alias("bl")).distinct()


def with_lists(docs: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """docs (distinct names) with the array `name` of the line numbers that places (stored) has of them, or NULL."""
    lists = places.groupBy("doc_id").agg(F.collect_set("line_no").alias(name)).withColumnRenamed("doc_id", f"{name}_id")
    if places.count() <= FEW:
        lists = F.broadcast(lists)
    return docs.join(lists, F.col("doc_id") == F.col(f"{name}_id"), "left").drop(f"{name}_id")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The places of the later lines of the pairs (stored) whose full sets are similar."""
    places = stored(pairs.select(F.col("ad").alias("doc_id"), F.col("al").alias("line_no")).union(pairs.select("bd", "bl")).distinct(), "line-places")
    some = numbered_lines(with_lists(docs, places, "want").filter("want is not null"), "want").filter(F.array_contains("want", F.col("line_no"))).drop("want")
    sets = stored(word_sets(some), "line-sets")
    both = pairs.join(sets.toDF("ad", "al", "x"), ["ad", "al"]).join(sets.toDF("bd", "bl", "y"), ["bd", "bl"])
    common = F.size(F.array_intersect("x", "y"))
    later = F.greatest(F.struct(F.col("ad").alias("doc_id"), F.col("al").alias("line_no")), F.struct(F.col("bd").alias("doc_id"), F.col("bl").alias("line_no")))
    out = stored(both.filter((100 + percent) * common >= percent * (F.size("x") + F.size("y"))).select(later.alias("later")).select("later.*").distinct(), "line-gone")
    discard(places, sets)
    return out


def removed_lines(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """doc_id and line_no of each line to remove."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sets = stored(word_sets(numbered_lines(docs)).filter(F.size("words") > 0), "line-words", hashes=True)
    wide = stored(line_table(sets, rarity(sets), percent), "lines", hashes=True)
    discard(sets)
    first = F.min(F.struct(*PLACE, "n", "head", *MAPS)).alias("first")
    reps = stored(wide.groupBy(*DIGEST).agg(first, F.count("*").alias("c")).select(*DIGEST, "c", "first.*"), "line-firsts", hashes=True)
    many = stored(reps.filter("c > 1").select(*DIGEST, F.struct(*PLACE).alias("first")), "line-repeated")
    copies = stored(wide.select(*PLACE, *DIGEST).join(few(many), list(DIGEST)).filter(F.struct(*PLACE) != F.col("first")).select(*PLACE), "line-copies")
    discard(wide, many)
    star = star_pairs(reps, percent)
    gone = verified(star, docs, percent)
    pairs = stored(prefix_pairs(reps, gone, percent), "line-pairs")
    late = verified(pairs, docs, percent)
    out = stored(copies.union(gone).union(late).distinct(), "line-removed")
    discard(reps, copies, star, gone, pairs, late)
    return out


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers, from 0) of each document."""
    gone = removed_lines(docs, **how)
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    wide = with_lists(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines")), gone, "gone")
    lines = F.coalesce(F.sort_array("gone"), F.array().cast("array<int>"))
    return wide.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(lines).cast("long").alias("n_removed"), F.array_join(lines.cast("array<string>"), ",").alias("removed"))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """docs with the removed lines taken out of text; n_chars, where there is one, is counted anew."""
    gone = removed_lines(docs, **how)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    wide = with_lists(packed, gone, "gone")
    kept = F.filter(F.split(F.col("row.text"), "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    wide = wide.withColumn("text", text)
    chars = lambda c: F.when(F.col("gone").isNull(), c).otherwise(F.length("text"))
    of = {f.name: F.col("row").getField(f.name) for f in docs.schema.fields}
    of["text"] = F.col("text")
    if "n_chars" in of:
        of["n_chars"] = chars(of["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return wide.select(*[c.alias(name) for name, c in of.items()])
