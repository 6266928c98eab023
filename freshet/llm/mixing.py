"""Mixing sources to target weights in fixed-length blocks.

Tokens (words) of each source are laid end to end in a keyed order and cut into
blocks of one length per source.  A source's target says how many slots of the
output it fills; how many of them fall into each output shard is a multinomial
draw.  Slots go through the source's keyed index permutation, one per pass over
the source, and meet their blocks in a join by index.  The last slot is cut so
that a source gives exactly its rounded target.

Targets: all sizes times ``share``, dealt by weight; a source stops at ``most``
times its size and the excess is dealt again by weight until none is above.

Defined results: a null text or one without words has size 0 and is taken 0
times; the null source is a source of its own and comes last; rows that agree in
id and size may swap their places; an empty table gives no rows; other columns
are ignored by ``taken`` and kept by ``documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.llm.common import SPACE, WORD, landed, lookup, numbered
from freshet.llm.feistel import permute

#: Rows per prefix-sum bucket, and slots made by one row of an explode.
BUCKET_ROWS, CHUNK = 4_000, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    """``docs``: doc_id, source, size, start (first word's place in its source), source_size, target.
    ``sources``: one row per source.  ``plan``: shard, order_key, source, pass, slot, block, words."""

    docs: DataFrame
    sources: DataFrame
    plan: DataFrame


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds rank (by code point, null last), weight and target to (source, source_size, ...)."""
    null_last = F.col("source").isNull()
    ranked = numbered(sources, [null_last, "source"], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    size, weight = F.col("source_size").cast("double"), F.col("weight")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, n_full = 0.0, -1
    while total:  # each step fills at least one more source, or ends
        full = size * most <= F.lit(level) * weight
        row = ranked.agg(
            F.sum(F.when(full, size * most)).alias("given"),
            F.sum(F.when(~full, weight)).alias("open"),
            F.count(F.when(full, 1)).alias("n_full"),
        ).first()
        if row["n_full"] == n_full or not row["open"]:
            break
        n_full = row["n_full"]
        level = (total * share - (row["given"] or 0.0)) / row["open"]
    return ranked.withColumn("target", F.least(size * most, F.lit(level) * weight))


def _spread(sources: DataFrame, count: Column, keep: list[str]) -> DataFrame:
    """A row for each i below ``count``; a source with many is dealt out in chunks."""
    chunks = F.sequence(F.lit(0).cast("long"), F.ceil(count / CHUNK).cast("long") - 1)
    out = sources.filter(count > 0).select(*keep, count.alias("_count"), F.explode(chunks).alias("_chunk"))
    out = out.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[c for c in ("rank", "shard") if c in keep], "_chunk")
    last = F.least(F.col("_count"), (F.col("_chunk") + 1) * CHUNK) - 1
    return out.select(*keep, F.explode(F.sequence(F.col("_chunk") * CHUNK, last)).alias("i"))


def mix(
    docs: DataFrame,
    weights: list[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 2048,
    shards: int = 64,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mixture:
    """Plan the mixture; ``block_words`` is the longest block, small sources have 512 blocks or more."""
    facts = landed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    totals = facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = targets(totals, list(weights), share, most)
    size = F.col("source_size")
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(size / 512))).cast("long")
    take = F.round("target").cast("long")
    sources = sources.withColumns({"block_len": block, "take": F.least(take, F.floor(size * most).cast("long"))})
    sources = sources.withColumn("n_blocks", F.ceil(size / F.col("block_len")).cast("long"))
    whole = F.when(size > 0, F.floor(F.col("take") / size)).otherwise(0).cast("long")
    sources = sources.withColumn("passes", whole).withColumn("rest", F.col("take") - whole * size)
    short = F.col("n_blocks") * F.col("block_len") - size
    at = permute(F.col("n_blocks") - 1, F.col("n_blocks"), _key(seed, F.col("rank"), F.col("passes")), undo=True)
    sources = sources.withColumns({"short": short, "short_slot": F.when(F.col("n_blocks") > 0, at)})
    # The rest needs one slot more when the short block comes early in its pass.
    length = F.col("block_len")
    late = F.ceil(F.col("rest") / length)
    more = F.when(F.col("short_slot") < late, F.ceil((F.col("rest") + F.col("short")) / length)).otherwise(late)
    slots = F.col("passes") * F.col("n_blocks") + F.when(F.col("n_blocks") > 0, more).otherwise(0)
    sources = landed(sources.withColumn("slots", slots.cast("long")), "mix-sources")

    placed = lookup(_starts(facts, seed), sources.drop("slots"), ["source"], "source_rows")
    return Mixture(placed, sources, _plan(sources, shards, seed))


def _key(seed: int, rank: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(seed), rank, turn)


def _starts(facts: DataFrame, seed: int) -> DataFrame:
    """The word at which each document starts within its source, in keyed order.

    Sums within buckets of about 4,000 rows, then over the buckets of a source.
    """
    n_buckets = -(-facts.count() // BUCKET_ROWS) or 1
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = facts.withColumn("_h", h).withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.lit(n_buckets)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.count("*").alias("_rows"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    within = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    joined = rows.join(sums, same)
    return joined.select("doc_id", "source", "size", (F.col("_before") + F.col("_within")).alias("start"))


def _plan(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """Slots of all shards with the block and the words each takes."""
    drawn = _spread(sources, F.col("slots"), ["rank"])
    drawn = drawn.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "rank", "i"), F.lit(shards)).cast("int"))
    counts = drawn.groupBy("rank", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    facts = sources.select("rank", "block_len", "n_blocks", "passes", "rest", "short", "short_slot")
    counts = counts.join(facts, "rank")
    kept = ["shard", "first", *facts.columns]
    slots = _spread(counts, F.col("n"), kept).withColumn("_slot", F.col("first") + F.col("i"))
    n = F.col("n_blocks")
    slots = slots.withColumns({"pass": ((F.col("_slot") - F.col("_slot") % n) / n).cast("long"), "slot": F.col("_slot") % n})
    slots = slots.withColumn("block", permute(F.col("slot"), n, _key(seed, F.col("rank"), F.col("pass"))))
    length = F.col("block_len") - F.when(F.col("block") == n - 1, F.col("short")).otherwise(0)
    begin = F.col("slot") * F.col("block_len") - F.when(F.col("short_slot") < F.col("slot"), F.col("short")).otherwise(0)
    words = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - begin))
    order = F.xxhash64(F.lit(seed), F.lit("order"), "rank", "_slot")
    return slots.select("shard", order.alias("order_key"), "rank", "pass", "slot", "block", words.alias("words"))


def spans(m: Mixture) -> DataFrame:
    """What the mix takes of each document: a row per document, slot and block overlap.

    doc_id, source, size, start, source_size, target, shard, order_key, from_word and
    n_words within the document.  A document of which nothing is taken has one row
    with n_words 0.
    """
    size, length = F.col("size"), F.col("block_len")
    last = F.floor((F.col("start") + size - 1) / length)
    blocks = F.when(size > 0, F.sequence(F.floor(F.col("start") / length), last))
    # Documents without words get a block that nothing matches, a different one each.
    none = F.array(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    kept = ["doc_id", "source", "rank", "size", "start", "source_size", "target", "block_len"]
    parts = m.docs.select(*kept, F.explode(F.coalesce(blocks, none)).alias("block"))
    joined = parts.join(m.plan, ["rank", "block"], "left")
    begin = F.col("block") * length
    from_word = F.greatest(begin - F.col("start"), F.lit(0))
    until = F.least(size, begin + F.coalesce("words", F.lit(0)) - F.col("start"))
    n_words = F.greatest(until - from_word, F.lit(0))
    return joined.select(
        "doc_id", "source", "size", "start", "source_size", "target", "shard", "order_key", "pass",
        from_word.cast("long").alias("from_word"), n_words.cast("long").alias("n_words"),
    )


def taken(m: Mixture) -> DataFrame:
    """doc_id, source, size, source_size, target and the words taken, repeats counted."""
    keys = ["doc_id", "source", "size", "start", "source_size", "target"]
    out = spans(m).withColumn("_spread", F.when(F.col("size") == 0, F.monotonically_increasing_id()))
    out = out.groupBy(*keys, "_spread").agg(F.sum("n_words").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture as rows of ``docs``: each pass over a document gives a row with its taken words.

    A whole pass gives the text as it is; a part gives the runs of words that were
    taken, with the white space before them.
    """
    m = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    runs = spans(m).filter("n_words > 0")
    per = runs.groupBy("doc_id", "source", "size", "start", "pass").agg(
        F.sum("n_words").alias("__n"), F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("__runs")
    )
    own = Window.partitionBy("doc_id", "source", "size", "pass").orderBy("start")
    per = per.withColumn("__nth", F.row_number().over(own))
    per = per.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "__n", "__runs", "__nth")
    rows = docs.withColumn("__words", word_count(F.col(text_col)))
    twin = Window.partitionBy(id_col, source_col, "__words").orderBy(F.col(text_col))
    rows = rows.withColumn("__twin", F.row_number().over(twin))
    same = (
        F.col(id_col).eqNullSafe(F.col("__id"))
        & F.col(source_col).eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
        & (F.col("__twin") == F.col("__nth"))
    )
    joined = rows.join(per, same)
    pieces = F.split(F.col(text_col), f"(?<=[^\\x20\\x09-\\x0D])(?={SPACE})")
    part = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(pieces, r["from_word"].cast("int") + 1, r["n_words"].cast("int")))), "")
    text = F.when(F.col("__n") == F.col("__words"), F.col(text_col)).otherwise(part)
    return joined.withColumn(text_col, text).select(*docs.columns)
