"""Document fingerprints: order MinHash, with DataFrame operations only.

A text's k-mers of words are numbered by occurrence, so that repeated k-mers stay distinct. One
hash of (k-mer, occurrence) deals them into ``buckets`` and orders them there; the ``length``
smallest of each bucket, put back into text order, are hashed as a tuple of k-mers. A signature element
thus depends on which k-mers a text has and on their order, as edit distance does. Two texts'
likeness is the share of equal elements among the buckets that either text fills.

Everything runs over one array per document: packed longs (hash above, position below) make both
sorts primitive ones; no rows are exploded and nothing is shuffled for a fingerprint.

Defined results: null texts count as empty; a text of fewer than k words is one k-mer; texts
without words have all buckets empty, are alike (1) to each other and unlike (0) all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import bucket_of, cut_points, fresh, let

K, BUCKETS, LENGTH, NULLS = 2, 64, 2, 1024
#: Bits of a packed long that hold a position: an array of a row has under 2 GB, so fewer than 2**28 longs.
POS = 28
_MASK = (1 << POS) - 1


def _top(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, 64 - bits).cast("int")


def _mixed(x: Column, nth: Column) -> Column:
    """A packed long whose hash part takes in the occurrence number."""
    return F.xxhash64(F.shiftrightunsigned(x, POS), nth).bitwiseAND(F.lit(~_MASK)).bitwiseOR(x.bitwiseAND(F.lit(_MASK)))


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "signature", k: int = K, buckets: int = BUCKETS, length: int = LENGTH) -> DataFrame:
    """Adds ``out``, array<int>: a tuple hash per bucket, null where the bucket is empty. ``buckets``: a power of two.

    Each step is a projection of its own: sorting an array of longs is a primitive sort only at the top of an expression.
    """
    bits = buckets.bit_length() - 1
    keep = [f"`{c}`" for c in df.columns if c != out]
    pre = "_"
    while any(c.startswith(pre) for c in df.columns):
        pre += "_"

    def step(frame: DataFrame, *more: str, **new: Column) -> DataFrame:
        return frame.select(*keep, *more, *[c.alias(pre + n) for n, c in new.items()])

    at = lambda a, i: F.get(F.col(a), i)
    df = step(df, trimmed=F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r")))
    df = step(df, none=F.col(pre + "trimmed") == "", words=F.transform(F.split(pre + "trimmed", r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    each = F.transform(F.sequence(F.lit(1), F.size(pre + "words") - (k - 1)), lambda i: F.xxhash64(*[at(pre + "words", i + (j - 1)) for j in range(k)]))
    df = step(df, pre + "none", mers=F.when(F.size(pre + "words") < k, F.array(F.xxhash64(pre + "words"))).otherwise(each))
    # equal k-mers side by side; a run's nth is occurrence n, and most runs are of one
    df = step(df, pre + "none", pre + "mers", sorted=F.sort_array(F.transform(pre + "mers", lambda h, i: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i))))
    new = lambda x, i: (i == 0) | (F.shiftrightunsigned(x.bitwiseXOR(at(pre + "sorted", i - 1)), POS) != 0)
    df = step(df, pre + "none", pre + "mers", pre + "sorted", starts=F.array_compact(F.transform(pre + "sorted", lambda x, i: F.when(new(x, i), i))))
    first = F.transform(pre + "starts", lambda i: _mixed(at(pre + "sorted", i), F.lit(0)))
    ends = F.transform(pre + "starts", lambda i, j: F.struct(i.alias("at"), F.coalesce(at(pre + "starts", j + 1), F.size(pre + "sorted")).alias("end")))
    longer = F.filter(ends, lambda r: r["end"] - r["at"] > 1)
    later = F.flatten(F.transform(longer, lambda r: F.transform(F.sequence(r["at"] + 1, r["end"] - 1), lambda x: _mixed(at(pre + "sorted", x), x - r["at"]))))
    numbered = F.when(F.size(pre + "starts") == F.size(pre + "sorted"), first).otherwise(F.concat(first, later))
    df = step(df, pre + "none", pre + "mers", numbered=F.sort_array(numbered))
    near = lambda x, i: F.shiftrightunsigned(x.bitwiseXOR(at(pre + "numbered", i - length)), 64 - bits)
    df = step(df, pre + "none", pre + "mers", chosen=F.filter(pre + "numbered", lambda x, i: (i < length) | (near(x, i) != 0)))
    tops = F.transform(pre + "chosen", lambda x: _top(x, bits))

    def element(b: Column, known: Column) -> Column:
        def among(first: Column) -> Column:
            own = F.filter(F.slice(pre + "chosen", first, F.lit(length)), lambda x: _top(x, bits) == b)
            places = F.array_sort(F.transform(own, lambda x: x.bitwiseAND(F.lit(_MASK))))
            return F.when(first > 0, F.hash(F.transform(places, lambda i: at(pre + "mers", i.cast("int")))))

        return let(F.array_position(known, b).cast("int"), among)

    filled = let(tops, lambda known: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: element(b, known)))
    nothing = F.array_repeat(F.lit(None).cast("int"), buckets)
    return df.select(*keep, F.when(F.col(pre + "none"), nothing).otherwise(filled).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements among the buckets that either signature fills; 1 if neither fills any."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.when(x.eqNullSafe(y), 1).otherwise(0)))

    def share(p: Column) -> Column:
        filled = F.filter(p, lambda x: x.isNotNull())
        return let(filled, lambda f: F.when(F.size(f) == 0, F.lit(1.0)).otherwise(F.aggregate(f, F.lit(0), lambda s, x: s + x) / F.size(f)))

    return let(pairs, share)


def written(sig: Column) -> Column:
    """A signature as text: eight hexadecimal digits per bucket, dashes where it is empty."""
    digits = lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.array_join(F.transform(sig, lambda x: F.coalesce(digits(x), F.lit("-" * 8))), "")


def with_next(docs: DataFrame, make, cols: list[str], rows_per_bucket: int = 1024) -> DataFrame:
    """``make(docs)`` and next_<col>: the row that follows in (doc_id, text) order, nulls first; after the last row the first.

    Rows are dealt into order-preserving buckets, each sorted on its own (the only shuffle of texts); a bucket's last
    row takes the first row of the next bucket that has any. Of those there is one per bucket, so at most 9217.
    """
    key, more = fresh(docs, "bucket"), fresh(docs, "more")
    ahead, ours = {c: fresh(docs, f"ahead_{c}") for c in cols}, [c for c in docs.columns if c not in {f"next_{x}" for x in cols}]
    docs = docs.select(*[f"`{c}`" for c in ours])
    cuts = cut_points(docs, "doc_id", rows_per_bucket)
    # rows without doc_id come first, by a hash of their texts
    bucket = F.when(F.col("doc_id").isNull(), (-1 - F.pmod(F.xxhash64("text"), F.lit(NULLS))).cast("int")).otherwise(bucket_of(F.col("doc_id"), cuts))
    order = Window.partitionBy(key).orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    made = make(docs)
    rows = made.withColumn(key, bucket)
    rows = rows.withColumns({ahead[c]: F.lead(c).over(order) for c in cols} | {more: F.lead(F.lit(True)).over(order)})
    ids = docs.groupBy(bucket.alias("b")).agg(F.min("doc_id").alias("first_id"))
    among = Window.orderBy("b")
    before = F.coalesce(F.lag("b").over(among), F.max("b").over(Window.partitionBy(F.lit(0))))
    ids = F.broadcast(ids.select("first_id", F.col("b").alias(key), before.alias("before")))
    own = fresh(docs, "own")
    firsts = docs.withColumn(own, bucket)
    firsts = firsts.join(ids, firsts["doc_id"].eqNullSafe(ids["first_id"]) & (firsts[own] == ids[key]))
    firsts = firsts.select("doc_id", "text", key, "before", F.row_number().over(order).alias("place")).filter("place = 1")
    heads = make(firsts).select(F.col("before").alias("before"), *[F.col(c).alias(f"head_{c}") for c in cols])
    out = rows.join(heads, rows[key] == heads["before"], "left")
    following = [F.when(F.col(more), F.col(ahead[c])).otherwise(heads[f"head_{c}"]).alias(f"next_{c}") for c in cols]
    return out.select(*[rows[f"`{c}`"] for c in made.columns], *following)
