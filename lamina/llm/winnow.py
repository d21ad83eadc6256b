"""Document fingerprints by winnowing, in DataFrame functions only.

Units are lower-cased words, whatever the text's size; each character of a script written without spaces is a unit by itself. A run of
more than LONG characters without white space (an address, code, encoded data) is cut where its own characters say: after each pair of one whose
code point is 0 and one whose is 1 modulo 4, about every 16 characters, so that shifted copies have the same units from their first common cut on; what has
no such pair for longer is cut after every 32 characters from its last cut. Every k = 3 consecutive
units are hashed (a shorter text has one gram of all), and of each window of 8 consecutive hashes the minimum
is chosen, the rightmost of equal ones, with its position among the units. Two texts that share a run of k + 7 units
share a chosen hash. Likeness is the Dice coefficient of the chosen hashes' sets; two empty ones are alike (1).

Each document is also set against the next one in descending doc_id (the last against the first). The order is
found over doc_ids alone: ranges are sorted side by side, and only one row a range is looked at together.

Null texts count as empty, whose fingerprint is empty. Rows with a repeated doc_id are each returned; where the next document is repeated,
its greatest text is taken. Rows with a null doc_id have no next document: their last third is dropped, and near_next is 0.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import shuffle_partitions, stored

WINDOW, K = 8, 3
MASK = (1 << 31) - 1
#: Characters of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han), and what a text must hold for its units to need more than its white space
ALONE = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\x{20000}-\x{3FFFF}]"
LONG = 32
ODD = r"[\u0E00-\u9FFF\x{20000}-\x{3FFFF}]|(?:^|\s)\S{33}"
#: The pair that a run is cut after: Latin letters, digits and signs, Greek and Cyrillic
PAIR = "([{}][{}])".format(*("".join(f"\\x{{{c:x}}}" for c in (*range(33, 256), *range(0x370, 0x460)) if c % 4 == r) for r in (0, 1)))


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, next_id (the next in descending order, cyclic) and third (a third of the characters, down)."""
    spark = docs.sparkSession
    ids = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))) / 3).cast("long").alias("third"))
    ranged = stored(ids.repartitionByRange(shuffle_partitions(spark), "doc_id").withColumn("part", F.spark_partition_id()), "id-ranges")
    # one row a range: what comes before its smallest id is the largest of the range before
    ends = ranged.groupBy("part").agg(F.max("doc_id").alias("hi"))
    before = F.coalesce(F.lag("hi").over(Window.orderBy("part")), F.max("hi").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.select("part", before.alias("below"))
    down = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("next_id", down).join(F.broadcast(ends), "part").select("doc_id", F.coalesce("next_id", "below").alias("next_id"), "third")


def _least(array: str, step: int):
    return lambda x, i: F.least(x, F.get(array, i + step))


def units(low: Column) -> Column:
    """The units of a lower-cased text. Where nothing is alone or too long, both replacements would change nothing."""
    pieces = lambda w: F.split(F.regexp_replace(F.regexp_replace(w, PAIR, "$1 "), rf"(\S{{{LONG}}})", "$1 "), " ")
    apart = F.split(F.regexp_replace(low, f"({ALONE})", " $1 "), r"\s+")
    cut = F.flatten(F.transform(apart, lambda w: F.when(F.length(w) > LONG, pieces(w)).otherwise(F.array(w))))
    return F.array_remove(F.when(F.rlike(low, F.lit(ODD)), cut).otherwise(F.split(low, r"\s+")), "")


def chosen(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array `out`: chosen grams in order of position, hash in the upper bits and MASK - position below."""
    df = df.withColumn("__u", units(F.lower(F.col(text))))
    # single elements, as a slice would copy the array at every step; NULLs add nothing to a hash or a minimum
    code = lambda i: F.shiftleft(F.xxhash64(*[F.get("__u", i + j) for j in range(K)]).bitwiseAND(F.lit(MASK)), 31).bitwiseOR(F.lit(MASK) - i.cast("long"))
    df = df.withColumn("__c", F.when(F.size("__u") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size("__u") - K, F.lit(0))), code)))
    windows, step = F.greatest(F.size("__c") - WINDOW + 1, F.lit(1)), 1
    at = "__c"
    while step < WINDOW:  # minima of 2, 4 and 8
        df = df.withColumn(f"__m{step}", F.transform(at, _least(at, step)))
        at, step = f"__m{step}", 2 * step
    return df.withColumn(out, F.array_distinct(F.slice(at, F.lit(1), windows))).drop("__u", "__c", "__m1", "__m2", "__m4")


def hashes(codes: str) -> Column:
    return F.array_distinct(F.transform(codes, lambda c: F.shiftright(c, 31).cast("int")))


def shown(codes: str) -> Column:
    """hash:position of each chosen gram."""
    return F.array_join(F.transform(codes, lambda c: F.concat(F.lower(F.hex(F.shiftright(c, 31))), F.lit(":"), (F.lit(MASK) - c.bitwiseAND(F.lit(MASK))).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last third replaced by the start of the next document. Texts are dealt by doc_id once, and
    each document gets a third of the next one's text and its hashes.
    """
    links = stored(next_documents(docs), "next")
    # a cast that changes nothing would keep the two joins from using one exchange
    ids = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    every = docs.select(ids, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = every.filter("doc_id is not null")  # the same exchange serves both joins
    ahead = base.join(links.select(F.col("doc_id").alias("cur"), F.col("next_id").alias("doc_id"), "third").hint("merge"), "doc_id")
    ahead = chosen(ahead, "text", "codes")
    ahead = ahead.select("cur", F.struct(F.expr("substring(text, 1, cast(third as int))").alias("start"), hashes("codes").alias("set")).alias("ahead")).groupBy("cur").agg(F.max("ahead").alias("ahead"))
    wide = base.join(ahead.hint("merge"), base["doc_id"] == ahead["cur"], "left").select("doc_id", "text", F.col("ahead.start").alias("start"), F.col("ahead.set").alias("next_set"))
    wide = wide.union(every.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("string"), F.lit(None).cast("array<int>")))
    wide = wide.withColumn("n_chars", F.length("text").cast("long"))
    wide = wide.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), coalesce(substring(start, 1, cast(n_chars div 3 as int)), ''))"))
    wide = wide.drop("start")
    wide = chosen(wide, "text", "own")
    wide = chosen(wide, "edited", "other")
    wide = wide.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "other", "next_set", hashes("own").alias("own_set"), hashes("other").alias("other_set"))
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("other").alias("edited_fingerprint"),
        likeness("own_set", "other_set").alias("near_edited"), F.coalesce(likeness("own_set", "next_set"), F.lit(0.0)).alias("near_next"),
    )
