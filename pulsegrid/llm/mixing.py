"""Mixing sources to target weights, with DataFrame operations only.

Words of each source, in document order, are packed into fixed-length blocks, and each source gets as
many slots as its target has blocks. Output shards of ``shard_slots`` slots are drawn: every place of a shard takes a source with
the chance of its share of all slots, so a shard's counts by source are multinomial. A source's slots are numbered
through the shards in order. Numbers beyond its target are cut off, and what it still lacks after the last shard fills
shards after it, so that targets hold exactly and no source is drawn more often than its passes allow. Slot k of a source
with n blocks is mapped to a block by pass k div n through a pseudorandom permutation of the n indices (affine, with a
multiplier that is coprime to n), and blocks meet documents in a join by (source, block).

Prefix sums over a source's documents are taken in order-preserving buckets first and over bucket
sums then, so that a source with most of the rows is no single task.

Blocks have ``block`` words, fewer in a source of under ``LEAST_BLOCKS`` such blocks, down to one word, so that small sources
meet their targets too.

Defined results: null texts have size 0; a null source is a source of its own, last in order;
repeated rows are rows of their own; rows without doc_id come first, in buckets by their size; sources without words have target 0; an empty table gives an
empty result. Products in permutations are taken in 128 bits from 2**31 blocks on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

from pulsegrid.llm.common import WORD, bucket_of, cut_points, small, stored

# Primes above 2**31; the multiplier of a permutation is one of them modulo n.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743)
BLOCK, LEAST_BLOCKS, SHARD_SLOTS, NULLS = 64, 256, 16384, 1024
_WIDE = DecimalType(19, 0)
_KEY = "coalesce(concat('a', source), 'b')"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, and the number of words."""
    return docs.select("doc_id", "source", _size().alias("size"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """One row per source: its weight by code-point order (null last), size, target, words of a block, blocks and slots.

    A source is held at ``most`` x size when the common factor exceeds its ratio of that limit to
    its weight; sources sorted by the ratio, the factor follows from running sums.
    """
    per = sized.groupBy(F.expr(_KEY).alias("skey")).agg(F.sum("size").alias("source_size"))
    one = Window.orderBy("skey")
    per = per.withColumn("src", F.row_number().over(one) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "src").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("factor", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.min(F.when(F.col("factor") <= F.col("ratio"), F.struct("ratio", "src", "factor"))).over(everything)["factor"])
    per = per.withColumn("target", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight"))))
    per = per.withColumn("block", F.least(F.lit(block), F.greatest(F.lit(1), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long"))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = F.least(F.floor(F.col("target") / F.col("block") + 0.5).cast("long"), F.floor(most * F.col("blocks")).cast("long"))
    return per.select("skey", "src", "weight", "source_size", "target", "block", "blocks", slots.alias("slots"))


def _modulo(a: Column, i: Column, n: Column) -> Column:
    """a i mod n, exactly, for a and i below n."""
    wide = (a.cast(_WIDE) * i.cast(_WIDE) % n.cast(_WIDE)).cast("long")
    return F.when(n <= 1 << 31, F.when(n <= 1 << 31, a).otherwise(0) * F.when(n <= 1 << 31, i).otherwise(0) % n).otherwise(wide)


def permuted(slot: Column, n: Column, src: Column, seed: int) -> tuple[Column, Column]:
    """(pass, block) of a slot."""
    turn = F.call_function("div", slot, n)
    prime = lambda k: F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), ((src + turn + seed + k) % len(PRIMES) + 1).cast("int"))
    a = F.when(n % prime(0) != 0, prime(0)).otherwise(prime(1))  # a prime that divides n is passed over
    return turn, (_modulo(a % n, slot % n, n) + (src * 7919 + turn * 104729 + seed * 15485863) % n) % n


def _total(per_source: DataFrame) -> int:
    return per_source.agg(F.sum("slots")).head()[0] or 0


def shard_counts(per_source: DataFrame, seed: int = 1, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, src and slots: how many places of each output shard fall to each source, a multinomial draw a shard."""
    sources = F.transform(F.sort_array(F.collect_list(F.struct("src", "slots", "upto"))), lambda x: F.struct(x["src"].alias("src"), (x["upto"] - x["slots"]).alias("lo"), x["upto"].alias("hi")))
    ranges = per_source.filter("slots > 0").withColumn("upto", F.sum("slots").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)))
    one = ranges.agg(sources.alias("sources"), F.sum("slots").alias("total"))  # a row; its array is as long as there are sources
    n = -(-_total(per_source) // shard_slots)
    shards = per_source.sparkSession.range(0, n, 1, max(1, n // 16)).select(F.col("id").alias("shard")).crossJoin(F.broadcast(one))
    places = F.least(F.lit(shard_slots), F.col("total") - F.col("shard") * shard_slots)
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("shard"), i)), 1, 15), 16, 10).cast("long") % F.col("total")
    shards = shards.select("sources", "shard", F.transform(F.sequence(F.lit(0).cast("long"), places - 1), drawn).alias("places"))
    count = lambda s: F.size(F.filter("places", lambda x: (x >= s["lo"]) & (x < s["hi"]))).cast("long")
    return shards.select("shard", F.inline(F.transform("sources", lambda s: F.struct(s["src"].alias("src"), count(s).alias("slots")))))


def draw(per_source: DataFrame, seed: int = 1, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot: shard, src, slot, turn (pass) and block."""
    counts = stored(shard_counts(per_source, seed, shard_slots), "mix-shards")
    quota = small(per_source.filter("slots > 0").select("src", "blocks", F.col("slots").alias("quota")), 10_000)
    order = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = counts.withColumn("upto", F.sum("slots").over(order)).join(quota, "src")
    runs = runs.select("shard", "src", "blocks", F.least(F.col("upto") - F.col("slots"), "quota").alias("first"), F.least("upto", "quota").alias("last"))
    drawn = counts.groupBy("src").agg(F.sum("slots").alias("drawn"), (F.max("shard") + 1).alias("shards"))
    short = drawn.join(quota, "src").filter("drawn < quota")
    short = short.withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(quota - drawn - 1) div {shard_slots}"))))
    first = F.col("drawn") + F.col("more") * shard_slots
    short = short.select((F.col("shards") + F.col("more")).alias("shard"), "src", "blocks", first.alias("first"), F.least(first + shard_slots, "quota").alias("last"))
    runs = runs.unionByName(short).filter("first < last").repartition(1 + _total(per_source) // (1 << 18), "src", "shard")
    slots = runs.withColumn("slot", F.explode(F.sequence("first", F.col("last") - 1)))
    turn, at = permuted(F.col("slot"), F.col("blocks"), F.col("src").cast("long"), seed)
    return slots.select("shard", "src", "slot", turn.alias("turn"), at.alias("block"))


def _placed(docs: DataFrame, per: DataFrame, *carry: str) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, size and ``carry``) with their source's row and the place of their first word among its words."""
    cuts = cut_points(docs, "doc_id", 512)
    bucket = F.when(F.col("doc_id").isNull(), (-1 - F.col("size") % NULLS).cast("int")).otherwise(bucket_of(F.col("doc_id"), cuts))
    bucketed = docs.withColumns({"skey": F.expr(_KEY), "bucket": bucket})
    order = Window.partitionBy("src", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size")
    placed = bucketed.join(small(per, 10_000), "skey")
    placed = placed.withColumns({"row": F.row_number().over(order), "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    sums = bucketed.select("skey", "bucket", "size").join(small(per.select("skey", "src"), 10_000), "skey").groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = sums.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    start = F.col("before") + F.col("upto") - F.col("size")
    return placed.join(sums, ["src", "bucket"]).select("src", "bucket", "row", "doc_id", "source", "size", "source_size", "target", F.col("block").alias("words"), start.alias("start"), *carry)


def _pieces(placed: DataFrame, own: list[str]) -> DataFrame:
    """A row for each block that a document has words in: ``block``, and ``first`` and ``last``, its words there by place in the document; null in the row of a document without words."""
    end = F.col("start") + F.col("size")
    span = F.sequence(F.expr("start div words"), F.expr("(start + size - 1) div words"))
    pieces = placed.withColumn("end", end).withColumn("block", F.explode_outer(F.when(F.col("size") > 0, span)))
    first = F.greatest(F.col("start"), F.col("block") * F.col("words")) - F.col("start")
    last = F.least(F.col("end"), (F.col("block") + 1) * F.col("words")) - F.col("start")
    return pieces.select(*own, "block", first.alias("first"), last.alias("last"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 1, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the document that the mix takes, repeats counted) and shards (output shards that have some of them)."""
    sized = stored(sizes(docs), "mix-sizes")
    per = stored(targets(sized, weights, share, most, block).coalesce(1), "mix-sources")
    own = ["src", "bucket", "row", "doc_id", "source", "size", "source_size", "target"]
    pieces = _pieces(_placed(sized, per), own)
    # Spark estimates the slots from the few rows they are made of; without the hint it would broadcast them all
    taken = pieces.join(draw(per, seed, shard_slots).select("src", "block", "shard").hint("merge"), ["src", "block"], "left")
    words = F.when(F.col("shard").isNotNull(), F.col("last") - F.col("first"))
    return (
        taken.groupBy(*own)
        .agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("shards"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "shards")
    )


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 1, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The documents as the mix takes them, in the columns of ``docs``: a row for each pass over a document that takes blocks of it.

    Where a pass takes all of a document the row is the document; otherwise its text is the words of the blocks taken,
    in order, each with the white space after it, and ``n_chars``, where there is one, follows. Documents without words stay as they are.
    """
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", _size().alias("size")), "mix-docs")
    per = stored(targets(rows, weights, share, most, block).coalesce(1), "mix-sources")
    placed = stored(_placed(rows, per, "doc"), "mix-placed")
    own = ["src", "bucket", "row"]
    found = _pieces(placed.drop("doc"), own).join(draw(per, seed, shard_slots).select("src", "block", "turn").hint("merge"), ["src", "block"])
    spans = found.groupBy(*own, "turn").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = placed.select(*own, "doc", "size").join(spans, own, "left").filter("taken IS NOT NULL OR size = 0")
    words = F.regexp_extract_all(F.col("doc")["text"], F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), "")
    whole = F.coalesce(F.col("taken") == F.col("size"), F.lit(True))
    text = F.when(whole, F.col("doc")["text"]).otherwise(part)
    out = out.select("doc", "size", whole.alias("whole"), text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns and not isinstance(docs.schema["n_chars"].dataType, StringType):
        new["n_chars"] = F.when(F.col("whole"), F.col("doc")["n_chars"]).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, ([3, 1, 2])[(src % 3 + 1)::INT] AS weight FROM per),
r AS (
  SELECT *, lim / weight AS ratio FROM w),
f AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor FROM r),
l AS (
  SELECT *, (SELECT g.factor FROM f g WHERE g.factor <= g.ratio ORDER BY g.ratio, g.src LIMIT 1) AS level FROM f),
t AS (
  SELECT *, CASE WHEN level IS NULL THEN lim ELSE least(lim, level * weight) END AS target, least({BLOCK}, greatest(1, source_size // {LEAST_BLOCKS}))::BIGINT AS words FROM l),
s AS (
  SELECT *, ((source_size + words - 1) // words)::BIGINT AS blocks FROM t),
q AS (
  SELECT *, least(CAST(floor(target / words + 0.5) AS BIGINT), 2 * blocks) AS slots FROM s),
c AS (
  SELECT *, (sum(slots) OVER (ORDER BY src))::BIGINT AS hi, (sum(slots) OVER ())::BIGINT AS total FROM q WHERE slots > 0),
places AS (
  SELECT p // {SHARD_SLOTS} AS shard, CAST('0x' || substr(md5('1:' || (p // {SHARD_SLOTS}) || ':' || (p % {SHARD_SLOTS})), 1, 15) AS BIGINT) % total AS x
  FROM (SELECT total, unnest(range(total)) AS p FROM (SELECT max(total) AS total FROM c))),
counts AS (
  SELECT shard, c.src, count(*) AS n FROM places JOIN c ON x >= c.hi - c.slots AND x < c.hi GROUP BY ALL),
runs AS (
  SELECT shard, src, n, sum(n) OVER (PARTITION BY src ORDER BY shard) - n AS start FROM counts),
numbered AS (
  SELECT shard, src, unnest(range(start::BIGINT, (start + n)::BIGINT)) AS slot FROM runs),
filled AS (
  SELECT n.shard, n.src, n.slot FROM numbered n JOIN c USING (src) WHERE n.slot < c.slots
  UNION ALL
  SELECT (total + {SHARD_SLOTS - 1}) // {SHARD_SLOTS} + (slot - drawn) // {SHARD_SLOTS}, src, slot
  FROM (SELECT src, total, drawn, unnest(range(drawn, slots)) AS slot FROM c JOIN (SELECT c.src, coalesce(sum(n), 0)::BIGINT AS drawn FROM c LEFT JOIN counts USING (src) GROUP BY c.src) USING (src))),
d AS (
  SELECT shard, src, ((([{", ".join(map(str, PRIMES))}])[((src + slot // blocks + 1) % 4 + 1)::INT] % blocks) * (slot % blocks)
    + (src * 7919 + (slot // blocks) * 104729 + 15485863) % blocks) % blocks AS block FROM filled JOIN c USING (src)),
placed AS (
  SELECT z.doc_id, z.size, q.source_size, q.target, q.src, q.words,
    sum(z.size) OVER (PARTITION BY q.src ORDER BY z.doc_id NULLS FIRST, CASE WHEN z.doc_id IS NULL THEN -(z.size % {NULLS}) END, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    row_number() OVER (ORDER BY z.doc_id) AS rid
  FROM sized z JOIN q ON z.source IS NOT DISTINCT FROM q.source),
pieces AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range(((upto - size) // words)::BIGINT, ((upto - 1) // words + 1)::BIGINT) ELSE [-1] END) AS block FROM placed)
SELECT p.doc_id, p.size, p.source_size, p.target,
  CAST(coalesce(sum(CASE WHEN d.shard IS NOT NULL THEN least(upto, (p.block + 1) * words) - greatest(upto - size, p.block * words) END), 0) AS BIGINT) AS taken,
  count(DISTINCT d.shard) AS shards
FROM pieces p LEFT JOIN d USING (src, block) GROUP BY p.rid, p.doc_id, p.size, p.source_size, p.target
"""
