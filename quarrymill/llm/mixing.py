"""Mixing sources to target weights: packed blocks, drawn slots, permuted indexes.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.llm.scratch import written

#: Documents of a source are laid in the order of this many hash buckets, so no task orders a whole source.
BUCKETS = 1024
#: Shards are numbered in runs of this many, so that counts are summed over runs first.
RUN = 4096
#: The line from 0 to 1 on which sources are drawn is cut into this many cells.
CELLS = 4096
ROUNDS = 16
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the blanks after it, the first one also with those before.
_WORD_AND_GAP = r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
PIECE = ("shard", "place", "source", "block_no", "start", "doc_id", "first_word", "n_words")


def permuted(x: Column, n: Column, seed: Column, inverse: bool = False) -> Column:
    """x's place in a pseudorandom permutation of 0 .. n-1, by a swap-or-not shuffle.

    Each round pairs x with key - x (mod n) and swaps the two or not by a hash of the pair.
    """
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(seed, r) - at, n)
        swap = F.pmod(F.xxhash64(seed, r, F.greatest(at, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), step)


def word_counts(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, weight): sources in order of code points, null last, take the weights in turn.  One small row a source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight, none above `most` times its size.

    What a source can't take is shared again by weight.  With sources in order of
    most * size / weight, the level at which the rest share what the full ones leave is
    largest where the filling stops.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.join(weights.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = W.orderBy(F.col("room") / F.col("weight"), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    each = each.withColumn("room", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(whole) * F.lit(float(share)))
    each = each.withColumn("level", (F.col("all") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    each = each.withColumn("level", F.max("level").over(whole))
    return each.select("source", "source_size", F.least("room", F.col("level") * F.col("weight")).alias("target"), "weight")


def laid_out(sizes: DataFrame, targets: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their first word's place in their source's stream, sources with their block counts)."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    keyed = sizes.withColumn("bucket", bucket)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    base = F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sources = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / block)).withColumn("wanted", F.round("target").cast("long"))
    sources = sources.withColumn("seed", F.xxhash64(F.lit("blocks"), F.lit(seed), "source")).withColumn("last_at", F.when(F.col("n_blocks") > 0, permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.col("seed"), inverse=True)))
    named = sources.select(F.col("source").alias("s"), "source_size", "target")
    starts = sums.withColumn("base", base).join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s", "held")
    starts = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "source_size", "target")
    docs = keyed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inner = W.partitionBy("source", "bucket").orderBy("doc_id", "size", "key").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("base", "bucket")
    return docs, sources


def drawn_counts(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source, n, first_k): how many slots of each output shard a source fills, and which of its slots they are.

    Every slot of every shard draws its source with a chance in proportion to the slots that
    the sources' targets need: a multinomial draw of counts for each shard, made by hashes of
    (seed, shard, slot).  The sums over all shards then only come near what is needed, so
    they are corrected: what a source drew too much falls away from the last shards on (its
    slots beyond the target take no words), and what it lacks is dealt evenly over the shards,
    which grow by as many slots.
    Counts are summed over runs of shards first, so no task orders all shards of a source.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = sources.where("n_blocks > 0 and wanted > 0").select("source", (F.ceil(F.col("wanted") / block) + 2).alias("slots"))
    own = own.withColumn("high", F.sum("slots").over(W.orderBy(F.col("source").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))).withColumn("all_slots", F.sum("slots").over(whole))
    own = own.withColumn("low", F.col("high") - F.col("slots")).withColumn("shards", F.ceil(F.col("all_slots") / shard_slots))
    cell = lambda x: F.floor(x * CELLS / F.col("all_slots"))
    cells = own.select(F.col("source"), "low", "high", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(CELLS - 1).cast("long")))).alias("cell"))
    shards = own.select("all_slots", "shards").limit(1)
    shards = shards.select("all_slots", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).repartition(n, "shard")
    # the last shard is as short as the rest
    size = F.least(F.lit(shard_slots).cast("long"), F.col("all_slots") - F.col("shard") * shard_slots)
    slots = shards.select("shard", "all_slots", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("slot"))
    slots = slots.withColumn("at", F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "shard", "slot"), F.col("all_slots")))
    slots = slots.withColumn("cell", F.least(cell(F.col("at")), F.lit(CELLS - 1).cast("long"))).drop("all_slots")
    drawn = slots.join(cells, "cell").where("at >= low and at < high").groupBy("shard", "source").agg(F.count("*").alias("drawn"))
    drawn = written(drawn, "drawn")
    lacks = own.join(drawn.groupBy(F.col("source").alias("s")).agg(F.sum("drawn").alias("sum")), F.col("source").eqNullSafe(F.col("s")), "left")
    lacks = lacks.select("source", "shards", F.greatest(F.col("slots") - F.coalesce("sum", F.lit(0)), F.lit(0)).alias("lack")).where("lack > 0")
    # lack l over s shards: shard i gets floor((i + 1) l / s) - floor(i l / s); only shards that get any are listed
    each = lacks.select("source", "lack", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.least("lack", "shards") - 1)).alias("j"))
    share = F.when(F.col("lack") >= F.col("shards"), F.floor((F.col("j") + 1) * F.col("lack") / F.col("shards")) - F.floor(F.col("j") * F.col("lack") / F.col("shards"))).otherwise(F.lit(1).cast("long"))
    place = F.when(F.col("lack") >= F.col("shards"), F.col("j")).otherwise(F.floor(F.col("j") * F.col("shards") / F.col("lack")))
    more = each.select(place.cast("long").alias("shard"), "source", share.cast("long").alias("drawn"))
    counts = drawn.select("shard", "source", "drawn").unionByName(more).groupBy("shard", "source").agg(F.sum("drawn").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN))
    counts = written(counts, "counts")
    runs = counts.groupBy("source", "run").agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), before.alias("before"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("source", "run").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("inner", inner).join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    return counts.select("shard", "source", "n", (F.col("before") + F.col("inner")).alias("first_k"))


def drawn_slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, place, source, block_no, take): what each output shard takes, slot by slot.

    drawn_counts says how many slots of a shard each source fills; a pseudorandom permutation
    of the shard's own slots gives them their places.  The k-th slot of a source over all
    shards takes block permutation(k mod blocks), so a block is taken once in each turn; the
    last one is cut where the target is met.
    """
    counts = drawn_counts(sources, block, shard_slots, seed)
    shard = W.partitionBy("shard")
    offset = F.coalesce(F.sum("n").over(shard.orderBy(F.col("source").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"offset": offset, "in_shard": F.sum("n").over(shard)})
    own = sources.select(F.col("source").alias("s"), "n_blocks", "source_size", "wanted", "last_at", "seed")
    counts = counts.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    k = counts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("k", F.col("first_k") + F.col("i"))
    turn, at = F.floor(F.col("k") / F.col("n_blocks")), F.pmod("k", "n_blocks")
    last_words = F.col("source_size") - (F.col("n_blocks") - 1) * block
    before = turn * F.col("source_size") + at * block - F.when(F.col("last_at") < at, block - last_words).otherwise(0)
    words = F.when(at == F.col("last_at"), last_words).otherwise(F.lit(block))
    k = k.withColumn("take", F.least(words, F.col("wanted") - before)).where("take > 0")
    return k.select(
        "shard",
        permuted(F.col("offset") + F.col("i"), F.col("in_shard"), F.xxhash64(F.lit("places"), F.lit(seed), "shard")).alias("place"),
        "source",
        permuted(F.pmod("k", "n_blocks"), F.col("n_blocks"), F.col("seed")).alias("block_no"),
        "take",
    )


def _pieces(docs: DataFrame, weights: DataFrame | None, share: float, most: float, block: int, shard_slots: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with a key and their text, rows as laid out, the pieces that stand in slots, with the key of their row)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    keyed = keyed.withColumn("key", F.md5(F.to_json(F.struct("doc_id", "source", F.md5("text").alias("text")))))
    sizes = written(keyed.select("doc_id", "source", "key", word_counts(keyed).alias("size")), "sizes")
    weights = cycled_weights(sizes) if weights is None else weights
    targets = source_targets(sizes, weights, share, most)
    rows, sources = laid_out(sizes, targets, block, seed)
    rows = written(rows, "laid")
    slots = drawn_slots(written(sources, "sources"), block, shard_slots, seed).withColumnsRenamed({"source": "s", "block_no": "b"})
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = rows.where("size > 0").select("doc_id", "source", "key", "start", "size", F.explode(F.sequence(first, last)).alias("block_no"))
    low = F.greatest("start", F.col("block_no") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block_no") * block + F.col("take"))
    # slots grow with the words, which the planner can't see through the expansion: never broadcast them
    met = pieces.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block_no") == F.col("b"))).where(high > low)
    return keyed, rows, met.withColumns({"first_word": low - F.col("start"), "n_words": high - low}).select("key", *PIECE)


def mixed_corpus(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: float = 2.0, block: int = 128, shard_slots: int = 8192, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (shard, place, source, block_no, start, doc_id, first_word, n_words, text), a row for each piece of a document in a slot.

    Words are counted in whole texts.  Each source's documents are laid end to end (`start`
    is the place of a document's first word there, which also tells repeated rows apart) and
    cut into blocks of `block` words; drawn_slots says which block stands in which slot of
    which output shard, and blocks and slots are joined by index.  A slot's text is that of
    its pieces in order of start; a piece runs up to the next word's start, so a document's
    pieces put together are its text.  weights(source, weight) default to 3, 1, 2 in turn.

    The rows of a shard stand together and in order.  Hashes of ids and of the seed decide
    all, so reruns agree.  A null or empty text has no pieces, a null source is a source of
    its own, null ids are laid out like others, rows repeated whole are laid out each, a
    very long text is cut block by block, an empty table gives no rows; other columns, of
    any name, are ignored.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed, rows, mix = _pieces(docs, weights, share, most, block, shard_slots, seed, id_col, text_col, source_col)
    # rows repeated whole share one key: one of them gives the text for all
    alike = written(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("k")), "alike")
    texts = keyed.select("key", "text").where("text != ''")
    same = F.col("key") == F.col("k")
    one = texts.join(alike, same, "left_anti").union(texts.join(alike, same, "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    lists = mix.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct(*PIECE)).alias("pieces"))
    words = F.regexp_extract_all("text", F.lit(_WORD_AND_GAP), F.lit(0))
    cut = lambda w: F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in PIECE], F.array_join(F.slice(w, p["first_word"].cast("int") + 1, p["n_words"].cast("int")), "").alias("text")))
    # the words are split off once a text: inside the outer function they are a value, not an expression
    out = one.join(lists.hint("merge"), same).select(F.explode(F.transform(F.array(words), cut)[0]).alias("p")).select("p.*")
    return out.repartition(n, "shard").sortWithinPartitions("shard", "place", "start")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: float = 2.0, block: int = 128, shard_slots: int = 8192, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document stand in the mix of mixed_corpus: (doc_id, source, size, source_size, target, taken).

    The mix is made and written as a table of pieces (shard, place, source, block, document,
    words; without texts), and `taken` counted from it.  A source's taken words meet its
    rounded target; a block is taken once in each turn of its source, so no document is
    taken more than `most` (2: twice) times.  Null or empty texts have 0 words; each row,
    repeated or not, with an id or not, is returned once; other columns are ignored.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _, rows, mix = _pieces(docs, weights, share, most, block, shard_slots, seed, id_col, text_col, source_col)
    mix = written(mix.drop("key").repartition(n, "shard").sortWithinPartitions("shard", "place", "start"), "mix")
    taken = mix.groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("n_words").alias("taken"))
    full = rows.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return full.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
