"""Document fingerprints by one-permutation MinHash, in column expressions only.

Every shingle is hashed once; the first eight bits of a hash name one of 256 bins, and a bin keeps its smallest hash. An
empty bin takes the value of a full one (optimal densification): it tries bins by a hash of its own number and the number
of the attempt, so two texts whose bin is empty look in the same places. Of each bin eight bits are stored. Two equal
stored values may be equal by chance, once in 256 times, and the likeness is corrected for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import cut

BINS = 256  # the first 8 bits of a hash
SHINGLE = 5
TRIES = 16  # attempts before a bin looks at all full bins in the order of its hashes of their numbers
CHANCE = 1 / 256  # that eight bits are equal by chance
RANGES = 4  # ranges of documents for each shuffle partition


def fingerprint(df: DataFrame, text: str, alias: str, shingle: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint of a text: an array of 32 longs, each of which packs the bits of eight bins.

    Words end at ASCII white space, shingles are `shingle` words in a row, and a text of fewer words is one shingle, so an
    empty text (or null) has a fingerprint too. Whole texts of any length are read. Equal texts have equal fingerprints.
    Columns of `df` keep their names, whatever these are; `alias` is replaced.
    """
    # Each step is used more than once by the next one, so the optimizer leaves it a step of its own. The columns of `df`
    # are handed on as they are, and with them how its rows are dealt out.
    held = df.drop(alias)
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in held.columns]
    taken = {c.lower() for c in held.columns}
    hashes, bins, full = (next(n for n in (("_" * k) + name for k in range(len(taken) + 1)) if n not in taken)
                          for name in ("hashes", "bins", "full"))

    rows = held.select("*", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "").alias(bins))
    rows = rows.select(*kept, bins, F.transform(bins, lambda w: F.xxhash64(w)).alias(hashes))
    several = F.transform(F.sequence(F.lit(0), F.size(hashes) - shingle),
                          lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(shingle))))
    one = F.array(F.xxhash64(F.array_join(bins, " ")))
    rows = rows.select(*kept, F.when(F.size(hashes) >= shingle, several).otherwise(one).alias(hashes))

    # A hash is made even. One odd mark closes each bin, so the first of every bin is its smallest hash, or the mark.
    def is_hash(h: Column) -> Column:
        return h.bitwiseAND(F.lit(1).cast("long")) == 0

    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
                        lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit((1 << 56) - 1)))
    even = F.transform(hashes, lambda h: h.bitwiseAND(F.lit(-2).cast("long")))
    rows = rows.select(*kept, F.sort_array(F.concat(even, marks)).alias(hashes))
    first = F.filter(hashes, lambda h, i: (i == 0) | (F.shiftright(h, 56) != F.shiftright(F.get(hashes, i - 1), 56)))
    rows = rows.select(*kept, first.alias(hashes))
    rows = rows.select(*kept, F.transform(hashes, lambda h: F.when(is_hash(h), h)).alias(bins),
                       F.filter(hashes, is_hash).alias(full))

    def dense(value: Column, i: Column) -> Column:
        tried = (F.get(bins, F.pmod(F.xxhash64(F.lit(t), i), F.lit(BINS)).cast("int")) for t in range(TRIES))
        ordered = F.transform(full, lambda h: F.struct(F.xxhash64(i, F.shiftright(h, 56)).alias("at"), h.alias("h")))
        return F.coalesce(value, *tried, F.array_min(ordered)["h"])

    rows = rows.select(*kept, F.transform(bins, dense).alias(bins))

    def packed(k: Column) -> Column:
        # The number of the bin goes into the bits, so a value that fills several bins is compared anew in each.
        parts = [F.shiftleft(F.xxhash64(F.get(bins, k * 8 + j), k * 8 + j).bitwiseAND(F.lit(255).cast("long")), 56 - 8 * j)
                 for j in range(8)]
        out = parts[0]
        for part in parts[1:]:
            out = out.bitwiseOR(part)
        return out

    return rows.select(*kept, F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), packed).alias(alias))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Estimated share of common shingles (Jaccard), 0 to 1: the share of equal bins, less what chance makes equal.

    Null if a fingerprint is null. The standard error is at most 1 / 32.
    """
    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift).bitwiseAND(F.lit(mask).cast("long")))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101).cast("long")))

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, n: total + n)
    same = 1 - unlike / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (same - F.lit(CHANCE)) / F.lit(1 - CHANCE))


def hexadecimal(fingerprint: Column | str) -> Column:
    """A fingerprint as text: 512 lower-case hexadecimal digits."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def _bounds(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """One row with `bounds`, the smallest (key, tie) of each range of rows in ascending order, and how many ranges there
    may be. Their number is that of the session's shuffle partitions times RANGES."""
    ranges = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("tie")).repartitionByRange(
        ranges, F.col("key"), F.col("tie"))
    least = narrow.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "tie")).alias("least"))
    return least.agg(F.sort_array(F.collect_list("least")).alias("bounds")), ranges


def _placed(df: DataFrame, key: str) -> DataFrame:
    """`df` with `part`, the number of a row's range, and `tie`. Bounds are looked up in two steps: every so many, then those
    between."""
    bounds, ranges = _bounds(df, key)
    step = max(1, int(ranges ** 0.5))
    found = df.withColumn("tie", F.monotonically_increasing_id()).crossJoin(F.broadcast(bounds))  # one row
    me = F.struct(F.col(key).alias("key"), F.col("tie"))
    coarse = F.size(F.filter("bounds", lambda b, i: (i % step == 0) & (b <= me)))
    found = found.withColumn("block", F.greatest(coarse, F.lit(1)) - 1)
    fine = F.size(F.filter(F.slice("bounds", F.col("block") * step + 1, F.lit(step)), lambda b: b <= me))
    return found.withColumn("part", F.col("block") * step + fine).drop("bounds", "block")


def _edited(df: DataFrame, text: str, after: str) -> DataFrame:
    """`df` with `edited`: the text, whose last third is replaced by the beginning of the text after it."""
    third = F.floor(F.length(text) / 3).cast("int")
    return df.withColumn("edited", F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - third),
                                            F.substring(F.col(after), F.lit(1), third)))


def document_fingerprints(documents: DataFrame) -> DataFrame:
    """Every document beside its edited text and beside the next document, in descending order of doc_id.

    The next document is the one with the next smaller doc_id; after the last comes the first, and a single document comes
    after itself. Null keys are the smallest; rows that share a key follow each other in reverse of how they are read. A null
    text counts as an empty one. No documents, no rows.

    Documents are dealt out by ranges of doc_id, so neighbours meet in a task, and only the two rows at the ends of each
    range are joined with those of other ranges.
    """
    docs = _placed(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    # The next in descending order is the one before in ascending order.
    order = Window.partitionBy("part").orderBy("doc_id", "tie")
    beside = docs.select("part", "doc_id", "tie", "text", F.lag("text").over(order).alias("next"),
                         F.row_number().over(order).alias("place"), F.lead("tie").over(order).isNull().alias("last"))
    marked = fingerprint(beside, "text", "print").withColumn("next_print", F.lag("print").over(order))
    inner = F.col("place") > 1
    marked = fingerprint(_edited(marked, "text", "next"), "edited", "edited_print")
    rows = cut(marked.select(
        "part", "doc_id", F.length("text").cast("long").alias("n_chars"), inner.alias("inner"), "last", "print",
        F.when(inner, F.sha2("edited", 256)).alias("edited_sha256"), F.when(inner, F.col("edited_print")).alias("edited_print"),
        F.when(inner, likeness("print", "edited_print")).alias("near_edited"),
        F.when(inner, likeness("print", "next_print")).alias("near_next"),
        F.when(~inner | F.col("last"), F.col("text")).alias("text")), "fingerprints")

    # One row for each range from here on.
    ends = rows.where("last").select("part", F.col("text").alias("next"), F.col("print").alias("next_print"))
    after = Window.orderBy("part")
    order_of_parts = ends.select("part").select("part", F.coalesce(
        F.lag("part").over(after), F.max("part").over(Window.partitionBy())).alias("before"))
    firsts = rows.where(~F.col("inner")).select("part", "doc_id", "n_chars", "print", "text").join(order_of_parts, "part")
    joined = _edited(firsts.join(ends.withColumnRenamed("part", "before"), "before"), "text", "next")
    joined = fingerprint(joined, "edited", "edited_print").select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "edited_print",
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"))
    whole = rows.where("inner").select(*joined.columns).union(joined)
    return whole.select("doc_id", "n_chars", "edited_sha256", hexadecimal("print").alias("fingerprint"),
                        hexadecimal("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")
