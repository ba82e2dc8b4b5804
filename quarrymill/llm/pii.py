"""Personal data: fixed patterns, and identifiers found by contexts learned from them.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.llm.scratch import written

KINDS = ("email", "ip", "card", "phone", "context")
_EMAIL_CHAR = "[A-Za-z0-9._%+-]"
#: The patterns in Java's syntax.  Possessive repeats match the same, as nothing could follow a
#: shorter match, and keep long runs of text linear; an address can only start at the start of a
#: run of its characters or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_EMAIL_CHAR})){_EMAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a context can extract: a run of capitals, digits and hyphens with a digit in it, 5 characters or more.
IDENTIFIER = r"(?<![A-Za-z0-9.@_%+-])(?=[A-Z-]*+[0-9])[A-Z0-9](?:[A-Z0-9-]{3,}+)(?<=[A-Z0-9])(?![A-Za-z_@])"
_MARK = "\x01"
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
#: Places that are summed one after another within a text; longer lists are summed block by block.
_BLOCK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digits = _digits(x)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _small_parts(x: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


VALID = {
    "email": lambda x: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
    "context": lambda x: F.lit(True),
}


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _places(parts: Column) -> Column:
    """Where each part starts, in code points: sums within blocks, then of the blocks, so long lists stay cheap."""
    none = F.array().cast("array<int>")

    def sums(lengths: Column, first: Column) -> Column:
        zero = F.struct(first.cast("int").alias("at"), none.alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(lengths, zero, step, lambda acc: acc["out"])

    lengths = F.transform(parts, lambda p: F.char_length(p))
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int"))
    blocks = _let(lengths, lambda n: F.transform(numbers, lambda b: F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(blocks_: Column) -> Column:
        whole = F.transform(blocks_, lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y))
        return F.flatten(F.zip_with(blocks_, sums(whole, F.lit(0)), sums))

    return _let(blocks, joined)


def _near_words(part: Column, before: bool) -> Column:
    """The two words next to a match, lower-cased, with digits as 0; `^` and `$` stand for words beyond the text's ends."""
    if before:
        near = F.regexp_extract(F.concat(F.lit("^ ^ "), part), rf"(?:^|(?<={_BLANK})){_WORD}++{_BLANK}++{_WORD}++{_BLANK}*+$", 0)
    else:
        near = F.regexp_extract(F.concat(part, F.lit(" $ $")), rf"^{_BLANK}*+{_WORD}++{_BLANK}++{_WORD}++", 0)
    return F.translate(F.lower(F.trim(F.regexp_replace(near, rf"{_BLANK}+", " "))), "123456789", "000000000")


def _matches(text: Column, kind: str, pattern: str, could: Column) -> Column:
    """Array of (start, kind, end, found, before, after): matches are marked, the text is cut at the marks, and lengths add up."""
    order = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string,before:string,after:string>>")

    def found(parts: Column, at: Column) -> Column:
        def one(i: Column) -> Column:  # every second part is a match
            part, start = F.element_at(parts, i + 1), F.element_at(at, i + 1)
            return F.struct(
                start.alias("start"), F.lit(order).alias("kind"), (start + F.char_length(part)).alias("end"), part.alias("found"),
                _near_words(F.element_at(parts, i), True).alias("before"), _near_words(F.element_at(parts, i + 2), False).alias("after"),
            )

        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        return F.transform(F.filter(odd, lambda i: VALID[kind](F.element_at(parts, i + 1))), one)

    marked = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    return F.when(could, _let(marked, lambda parts: F.when(F.size(parts) > 2, _let(_places(parts), lambda at: found(parts, at))).otherwise(empty))).otherwise(empty)


def base_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_id, base, others): matches of the fixed patterns, and the identifiers outside them that contexts may extract.

    text_id is a hash of the text; row tells rows apart within one evaluation: write the table before it is used twice.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), F.replace(text, F.lit(_MARK), F.lit("\x02")).alias("text"))
    t = F.col("text")
    rows = rows.withColumn("number", t.rlike("[0-9]"))
    could = {"email": t.contains("@"), "ip": F.col("number"), "card": F.col("number"), "phone": F.col("number") & t.contains("+")}
    found = [_matches(t, kind, pattern, could[kind]) for kind, pattern in PATTERNS.items()]
    rows = rows.select("row", "doc_id", "text_id", F.array_sort(F.flatten(F.array(*found))).alias("base"), _matches(t, "context", IDENTIFIER, F.col("number")).alias("others"))
    outside = F.filter("others", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return rows.select("row", "doc_id", "text_id", "base", F.when(F.size("base") > 0, outside).otherwise(F.col("others")).alias("others"))


def _told(matches: DataFrame, column: str, seed: int) -> DataFrame:
    """(row, text_id, start, end, context, instance, seed): each match under the words before and under the words after it."""
    rows = matches.select("row", "text_id", F.explode(column).alias("m"))
    sides = F.array(F.concat(F.col("m.before"), F.lit(" _")), F.concat(F.lit("_ "), F.col("m.after")))
    return rows.select("row", "text_id", "m.start", "m.end", F.explode(sides).alias("context"), F.col("m.found").alias("instance"), F.lit(seed).alias("seed"))


def _marks(wanted: DataFrame, bits: int) -> Column:
    """An array of bits / 64 longs in which the bits of the hashes of wanted(pair) are set, however many are wanted."""
    slot = F.pmod(F.xxhash64("pair"), F.lit(bits))
    words = wanted.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(pair), {bits}) % 64 as int)))").alias("marks"))
    found = {r.word: r.marks for r in words.collect()}
    return F.expr("array(" + ",".join(f"{found.get(i, 0)}L" for i in range(bits // 64)) + ")")


def word_pairs(docs: DataFrame, wanted: DataFrame, text_col: str = "text", bits: int = 1 << 18) -> DataFrame:
    """(pair, times): how often the two words of each wanted(pair) follow one another, in the form of _near_words, over all whole texts.

    Pairs whose hash no wanted one has are left out where they are read, the others are
    counted within each task before they are dealt; only counts meet the wanted pairs (an
    inner join, as a semi-join would be moved below the counting).
    """
    text = F.translate(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "123456789", "000000000")
    words = F.split(F.trim(F.regexp_replace(F.concat(F.lit("^ ^ "), text, F.lit(" $ $")), rf"{_BLANK}+", " ")), " ")
    pairs = _let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    slot = F.pmod(F.xxhash64("pair"), F.lit(bits))
    marked = F.getbit(F.get(_marks(wanted, bits), F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1
    return docs.select(F.explode(pairs).alias("pair")).where(marked).groupBy("pair").agg(F.count("*").alias("times")).join(wanted.distinct(), "pair")


def learned_contexts(matches: DataFrame, docs: DataFrame, rounds: int = 3, min_seeds: int = 5, min_share: float = 0.4, min_specific: float = 0.05, text_col: str = "text") -> DataFrame | None:
    """Contexts that extract identifiers reliably: (context, confidence), by bootstrapping over a graph of contexts and instances.

    A context is the two words before or the two words after; its edges lead to all different
    strings found there.  Matches of the fixed patterns are the seeds, with score 1, other
    identifiers start at 0.  In each round a context that has met a seed has the mean score of its
    instances as confidence, and it is believed if that is min_share or more and at least min_seeds
    instances with a score of 0.5 or more, in as many different texts, follow it; an instance's
    score is then 1 - product(1 - confidence) over the believed contexts it stands in.
    Texts are told apart by their hashes, so copies count once.  Neither the number of other
    seeds in the corpus nor the order of rows matters to a context.

    A context must also be specific: of all the places in all texts where its two words stand,
    at least min_specific must have an identifier beside them, so that frequent words never
    become contexts, however many seeds they happen to meet.  Each context is counted once, in
    the first round in which it would be believed.  None: no context has the seeds.
    """
    every = _told(matches, "base", 1).union(_told(matches, "others", 0))
    spots = written(every.groupBy("context", "instance", "text_id").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "spots")
    wide = spots.groupBy("context").agg(F.sum("n").alias("beside"), F.max("seed").alias("seed")).where((F.col("beside") >= min_seeds) & (F.col("seed") > 0))
    # Of the texts of an edge min_seeds are kept: whether so many different ones follow a context shows in them.
    rank = F.row_number().over(W.partitionBy("context", "instance").orderBy(F.desc("seed"), "text_id"))
    edges = written(spots.join(wide.select("context"), "context", "left_semi").withColumn("rank", rank).where(F.col("rank") <= min_seeds), "edges")
    first = edges.where("rank = 1")
    scores = first.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    contexts = judged = None
    for _ in range(max(rounds, 1)):
        sure = F.col("score") >= 0.5
        held = edges.join(scores, "instance").groupBy("context").agg(F.avg(F.when(F.col("rank") == 1, F.col("score"))).alias("confidence"), F.count_if(sure & (F.col("rank") == 1)).alias("good"), F.count_distinct(F.when(sure, F.col("text_id"))).alias("texts"))
        held = written(held.where((F.col("good") >= min_seeds) & (F.col("texts") >= min_seeds) & (F.col("confidence") >= min_share)).select("context", "confidence"), "held")
        new = held.select("context") if judged is None else held.select("context").join(judged, "context", "left_anti")
        new = written(new.join(wide, "context").withColumn("pair", F.when(F.col("context").startswith("_ "), F.expr("substring(context, 3)")).otherwise(F.expr("substring(context, 1, char_length(context) - 2)"))), "new")
        if not new.isEmpty():
            counted = word_pairs(docs, new.select("pair").distinct(), text_col)
            more = written(new.join(counted, "pair", "left").select("context", (F.col("beside") >= min_specific * F.coalesce("times", "beside")).alias("specific")), "judged")
            judged = more if judged is None else judged.unionByName(more)
        if judged is None:
            return None  # no score can change any more
        contexts = written(held.join(judged.where("specific"), "context", "left_semi"), "contexts")
        doubt = F.sum(F.when(F.col("confidence").isNotNull(), F.log1p(-F.least("confidence", F.lit(0.999)))))
        scores = first.join(contexts, "context", "left").groupBy("instance").agg(F.greatest(F.max("seed").cast("double"), 1 - F.exp(F.coalesce(doubt, F.lit(0.0)))).alias("score"))
        scores = written(scores, "scores")
    return contexts


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """Personal data in whole texts: (doc_id, spans), an array of (start, kind, end) in code points, by start, then kind.

    kind is the place in KINDS: email, ip, card and phone by fixed patterns (leftmost,
    without overlap for each kind; parts of an ip are at most 255, a card has 12 to 19
    digits and passes Luhn, a phone has 9 to 15 digits), and context: identifiers outside
    those that stand in a context which learned_contexts believes.

    Matches are written once and joined by the number of their row there, so no text is
    shuffled, and texts without a learned match meet nothing.  A null text is empty; a null
    or repeated id returns as it is; each row, repeated or not, is returned once; very long
    texts are scanned whole; of equal spans one is kept; other columns, of any name, are
    ignored.
    """
    matches = written(base_matches(docs, id_col, text_col), "matches")
    contexts = learned_contexts(matches, docs, text_col=text_col, **learning)
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    if contexts is None:
        return matches.select("doc_id", base.alias("spans"))
    told = _told(matches, "others", 0).join(contexts, "context").select("row", F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end").alias("span"))
    more = told.groupBy(F.col("row").alias("found_row")).agg(F.collect_set("span").alias("more"))
    spans = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return matches.join(more, F.col("row") == F.col("found_row"), "left").select("doc_id", spans.alias("spans"))
