"""Facts of sources as tables: lines, blocks, contracts, functions, state, statements.

The text is masked once, cut at braces and semicolons, and the pieces get running sums of
offsets, lines and depth by windows within a source.  All else is a filter, a join on
(source, name) or a window over those pieces.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.functions.text import BLANKS, all_matches, bracketed, mask_comments, mask_tokens, newlines, normalize_lf, outside_brackets, pragma_part, stripped, tokens_of, top_parts
from quarrymill.storage import written

#: Words that look like calls or types but are none.
CONTROL_WORDS = ["if", "for", "while", "do", "else", "return", "returns", "require", "assert", "revert", "emit", "new", "catch", "try", "function", "modifier", "event", "error", "mapping", "assembly", "unchecked", "using", "delete", "type", "abi", "address", "payable", "uint", "uint256", "int", "int256", "bytes", "string", "bool"]
MODIFIER_STOP = ["public", "private", "internal", "external", "view", "pure", "payable", "constant", "virtual", "override", "returns", "memory", "calldata", "storage", "returns"]
#: Stand for the braces of call options while blocks are cut.
OPTION = "\x02\x03"
_CONTRACT = r"^(?:abstract\s+)?(contract|interface|library)\s+([A-Za-z_$][\w$]*)(?:\s+is\s+([^{]*))?$"
_FUNCTION = r"(?s)^(?:function\b\s*([A-Za-z_$][\w$]*)?|(constructor|fallback|receive)\b)\s*(\(.*\).*)$"
_MODIFIER = r"(?s)^modifier\s+([A-Za-z_$][\w$]*)\s*(?:\(([^)]*)\))?"
_STATE = r"(?s)^(mapping\s*\(.*\)|[A-Za-z_$][\w$.]*(?:\s*\[[^\]]*\])*)\s+((?:(?:public|private|internal|constant|immutable|override)\s+)*)([A-Za-z_$][\w$]*)\s*(?:=.*)?$"
_NOT_STATE = r"^(?:using|event|error|struct|enum|import|pragma|function|return|emit|delete|modifier|constructor|type)\b"


def lines(sources: DataFrame) -> DataFrame:
    """(source_id, line_no, raw, code, start_off): lines of the text and of its masked form."""
    text = normalize_lf(F.col("text"))
    both = sources.select("source_id", F.split(text, "\n").alias("raws"), F.split(mask_comments(text), "\n").alias("codes"))
    rows = both.select("source_id", F.posexplode(F.arrays_zip("raws", "codes")).alias("i", "x"))
    before = W.partitionBy("source_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("x.raws") + 1).over(before), F.lit(0))
    return rows.select("source_id", (F.col("i") + 1).alias("line_no"), F.col("x.raws").alias("raw"), F.col("x.codes").alias("code"), start.cast("int").alias("start_off"))


def pragma_versions(sources: DataFrame, *more: str) -> DataFrame:
    """(source_id, major, minor, legacy): the version of the first pragma outside comments; legacy says 0.4; columns of `more` stay."""
    return _versions(sources.select("source_id", *more, mask_comments(normalize_lf(F.col("text"))).alias("masked")), *more)


def _versions(sources: DataFrame, *more: str) -> DataFrame:
    code = F.col("masked")
    return sources.select("source_id", *more, pragma_part(code, 1).alias("major"), pragma_part(code, 2).alias("minor")).withColumn(
        "legacy", F.coalesce((F.col("major") == 0) & (F.col("minor") == 4), F.lit(False))
    )


def delimiter_pairs(sources: DataFrame, opening: str = "{", closing: str = "}", on_unclosed: str = "end") -> DataFrame:
    """(source_id, open_off, close_off, depth) of paired delimiters outside comments and strings.

    An opening one without its partner ends at the end of the text (`end`) or is left out (`drop`).
    """
    cut = f"[^\\{opening}\\{closing}]*[\\{opening}\\{closing}]"
    text = mask_comments(normalize_lf(F.col("text")), strings=True)
    parts = sources.select("source_id", F.length(text).alias("size"), F.posexplode(all_matches(text, cut)).alias("i", "part"))
    order = W.partitionBy("source_id").orderBy("i")
    opens = F.substring("part", -1, 1) == opening
    parts = parts.withColumn("at", F.sum(F.length("part")).over(order) - 1).withColumn("after", F.sum(F.when(opens, 1).otherwise(-1)).over(order)).withColumn("opens", opens)
    parts = parts.withColumn("depth", F.when(F.col("opens"), F.col("after")).otherwise(F.col("after") + 1))
    close = F.lead("at").over(W.partitionBy("source_id", "depth").orderBy("i"))
    found = parts.withColumn("close_off", close).where("opens")
    found = found.where("close_off is not null") if on_unclosed == "drop" else found.withColumn("close_off", F.coalesce("close_off", "size"))
    return found.select("source_id", F.col("at").alias("open_off"), "close_off", "depth")


def words_of(text: Column) -> Column:
    """Different words of the identifiers in a text, cut at capitals and lower-cased, without stop words."""
    parts = F.flatten(F.transform(all_matches(text, r"[A-Za-z_$][\w$]*"), lambda w: F.transform(all_matches(w, r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+"), F.lower)))
    return F.array_except(F.array_distinct(parts), F.array(*[F.lit(w) for w in STOP_WORDS]))


class Facts:
    """The fact tables of a table of sources (source_id, path, text); each is a lazy DataFrame."""

    def __init__(self, sources: DataFrame):
        self.sources = sources

    @cached_property
    def pieces(self) -> DataFrame:
        """Code cut after each brace and semicolon, with lines, offsets, depth, and the contract and function it lies in."""
        cut = self.sources.select("source_id", tokens_of(normalize_lf(F.col("text"))).alias("tokens"))  # both masks are made of them
        text = F.regexp_replace(mask_tokens(F.col("tokens"), strings=True), r"\{(\s*\w+\s*:[^{};]*)\}", f"{OPTION[0]}$1{OPTION[1]}")  # call options are no blocks
        cut = _versions(cut.select("source_id", "tokens", mask_tokens(F.col("tokens")).alias("masked")), "tokens").select("source_id", "legacy", all_matches(text, r"[^{};]*[{};]|[^{};]+\z").alias("cut"))
        cut = cut.select("source_id", "legacy", "cut", F.size("cut").alias("end_i"), (1 + newlines(F.array_join("cut", ""))).alias("last_line"))
        rows = cut.select("source_id", "legacy", "end_i", "last_line", F.posexplode_outer("cut").alias("i", "piece"))
        rows = rows.where("piece is not null")  # not posexplode: Spark would cut the texts once more to find empty ones
        order = W.partitionBy("source_id").orderBy("i")
        end = F.substring("piece", -1, 1)
        rows = rows.withColumn("kind", F.when(end.isin("{", "}", ";"), end).otherwise(""))
        rows = rows.withColumns({"end_off": F.sum(F.length("piece")).over(order), "end_line": 1 + F.sum(newlines(F.col("piece"))).over(order), "after": F.sum(F.when(F.col("kind") == "{", 1).when(F.col("kind") == "}", -1).otherwise(0)).over(order)})
        rows = rows.withColumn("depth", F.when(F.col("kind") == "}", F.col("after") + 1).otherwise(F.col("after")))
        braces = W.partitionBy("source_id", F.col("depth"), F.col("kind") == ";").orderBy("i")
        rows = rows.withColumns({"next_i": F.lead("i").over(braces), "next_line": F.lead("end_line").over(braces)})
        opens = F.col("kind") == "{"
        rows = rows.withColumns({"close_i": F.when(opens, F.coalesce("next_i", "end_i")), "close_line": F.when(opens, F.coalesce("next_line", "last_line"))}).drop("next_i", "next_line", "end_i", "last_line")
        rows = rows.withColumn("line", F.col("end_line") - newlines(F.ltrim(F.col("piece"), F.lit(BLANKS))))
        rows = rows.withColumn("body", stripped(F.rtrim(F.col("piece"), F.lit("{};"))))  # a piece holds one of them at most, at its end
        found = lambda p, g: F.regexp_extract("body", p, g)
        contract = F.when((F.col("kind") == "{") & (found(_CONTRACT, 2) != ""), F.struct(found(_CONTRACT, 2).alias("contract"), found(_CONTRACT, 1).alias("kind"), found(_CONTRACT, 3).alias("bases"), F.col("line").alias("start_line"), F.col("close_line").alias("end_line"), F.col("close_i"), F.col("depth")))
        named = F.coalesce(F.nullif(found(_FUNCTION, 1), F.lit("")), F.nullif(found(_FUNCTION, 2), F.lit("")), F.when(F.col("body").rlike(r"^function\s*\("), F.lit("fallback")))
        rows = rows.withColumns({"is_function": (F.col("kind") == "{") & F.col("body").rlike(_FUNCTION), "is_modifier": (F.col("kind") == "{") & F.col("body").rlike(_MODIFIER)})
        is_function, is_modifier = F.col("is_function"), F.col("is_modifier")
        name = F.when(is_function, named).when(is_modifier, found(_MODIFIER, 1))
        head = F.when(is_function, bracketed(found(_FUNCTION, 3)))
        rows = rows.withColumn("head", head)
        params = F.when(is_function, F.col("head.inner")).otherwise(found(_MODIFIER, 2))
        rest = F.when(is_function, F.col("head.rest")).otherwise(F.lit(""))
        unit = F.when(
            is_function | is_modifier,
            F.struct(F.col("legacy"), name.alias("fn"), F.col("line").alias("start_line"), F.col("close_line").alias("end_line"), F.col("i").alias("open_i"), F.col("close_i"), is_modifier.alias("is_modifier"), params.alias("params"), rest.alias("rest"), found(r"^(\w+)", 1).alias("word")),
        )
        # what opens here, and of the last that opened before what its pieces need
        rows = rows.withColumns({"contract_head": contract, "unit_head": unit}).drop("head", "legacy", "is_function", "is_modifier")
        c, u = (F.last(F.when(F.col(h).isNotNull(), F.struct(*[F.col(h)[x].alias(x) for x in names])), ignorenulls=True).over(order) for h, names in (("contract_head", ("contract", "bases", "close_i", "depth")), ("unit_head", ("fn", "start_line", "open_i", "close_i", "is_modifier"))))
        rows = rows.withColumns({"c": c, "u": u})
        rows = rows.withColumns({"c": F.when(F.col("c.close_i") >= F.col("i"), F.col("c")), "u": F.when(F.col("u.close_i") >= F.col("i"), F.col("u"))})
        return written(rows, "pieces")  # nearly every fact reads this table

    @cached_property
    def contracts(self) -> DataFrame:
        rows = self.pieces.where("contract_head is not null").select("source_id", "contract_head.*")
        bases = F.filter(F.transform(F.split("bases", ","), lambda b: F.regexp_extract(b, r"([A-Za-z_$][\w$.]*)", 1)), lambda b: b != "")
        return rows.select("source_id", "contract", "kind", bases.alias("bases"), "start_line", "end_line")

    @cached_property
    def units(self) -> DataFrame:
        """Functions and modifiers with their spans; one row each."""
        rows = self.pieces.where("unit_head is not null").select("source_id", F.coalesce("c.contract", F.lit("")).alias("contract"), F.coalesce("c.bases", F.lit("")).alias("bases"), "unit_head.*")
        rows = rows.withColumn("plain", outside_brackets(F.col("rest")))
        plain = F.col("plain")
        words = F.filter(all_matches(plain, r"[A-Za-z_$][\w$]*"), lambda w: ~w.isin(MODIFIER_STOP))
        has = lambda w: plain.rlike(rf"\b{w}\b")
        pick = lambda names, default: F.coalesce(*[F.when(has(n), n) for n in names], F.lit(default))
        old = F.col("legacy") & (F.lower("fn") == F.lower("contract")) & (F.col("word") == "function")
        rows = rows.select(
            "source_id", "contract", "bases", "fn", "start_line", "end_line", "is_modifier", "params",
            pick(("public", "external", "internal", "private"), "").alias("visibility"), pick(("view", "pure", "payable", "constant"), "").alias("mutability"), words.alias("modifiers"),
            ((F.col("word") == "constructor") | old).alias("is_constructor"), (F.col("fn") == "fallback").alias("is_fallback"), (F.col("word") == "receive").alias("is_receive"), "open_i",
        )
        return written(rows, "units")

    @cached_property
    def functions(self) -> DataFrame:
        return self.units.where("not is_modifier").drop("is_modifier")

    @cached_property
    def modifiers(self) -> DataFrame:
        return self.units.where("is_modifier").select("source_id", "contract", F.col("fn").alias("modifier"), "start_line", "end_line", "open_i")

    @cached_property
    def parameters(self) -> DataFrame:
        """(source_id, contract, fn, start_line, place, type, name, bits): uint is 256 bits wide, bytesN is 8 N.

        Parameters end at commas outside brackets; the type of a mapping or of a function is taken whole, with its brackets.
        """
        rows = self.functions.where("trim(params) != ''").select("source_id", "contract", "fn", "start_line", F.posexplode(top_parts(F.col("params"))).alias("place", "p"))
        kind = F.regexp_extract("p", r"(?s)^\s*(mapping\s*\(.*\)(?:\s*\[[^\]]*\])*|function\s*\(.*\)|[\w$.]+(?:\s*\[[^\]]*\])*)", 1)
        name = F.regexp_extract("p", r"([A-Za-z_$][\w$]*)\s*$", 1)
        number = F.regexp_extract(kind, r"^(?:uint|int)(\d+)$", 1)
        bits = F.when(kind.isin("uint", "int"), 256).when(number != "", number.cast("int")).when(kind.rlike(r"^bytes\d+$"), 8 * F.regexp_extract(kind, r"(\d+)", 1).cast("int"))
        named = (name != kind) & ~name.isin(MODIFIER_STOP)
        return rows.select("source_id", "contract", "fn", "start_line", "place", kind.alias("type"), F.when(named, name).otherwise("").alias("name"), bits.alias("bits"))

    @cached_property
    def state_variables(self) -> DataFrame:
        """(source_id, contract, name, type, is_mapping, is_address): declarations directly in a contract."""
        rows = self.pieces.where(F.col("kind") == ";").where("c is not null and depth = c.depth and (u is null or u.close_i < i)").where(~F.col("body").rlike(_NOT_STATE))
        kind, name = F.regexp_extract("body", _STATE, 1), F.regexp_extract("body", _STATE, 3)
        return rows.where(name != "").select("source_id", "c.contract", name.alias("name"), kind.alias("type"), kind.startswith("mapping").alias("is_mapping"), kind.rlike(r"^address\b").alias("is_address"), "line")

    @cached_property
    def storage_aliases(self) -> DataFrame:
        """(source_id, contract, fn, fn_start, name): locals that point into storage."""
        rows = self.statements.select("source_id", "contract", "fn", "fn_start", F.explode(all_matches(F.col("text"), r"\b[A-Za-z_]\w*(?:\[\])?\s+storage\s+([A-Za-z_]\w*)", 1)).alias("name"))
        return rows.distinct()

    @cached_property
    def statements(self) -> DataFrame:
        """Statements of function and modifier bodies; what semicolons inside parentheses cut is put together again.

        first_i is the number of a statement's first piece; one that opens a block has in
        close_i the piece that closes it, so the statements between the two stand inside.
        """
        unit = [F.coalesce("c.contract", F.lit("")).alias("contract"), "u.fn", F.col("u.start_line").alias("fn_start"), "u.is_modifier", "u.open_i"]
        inside = self.pieces.where("u is not null and i > u.open_i").select("source_id", *unit, "i", "piece", "line", "end_line", "kind", "close_i")
        order = W.partitionBy("source_id", "open_i").orderBy("i")
        count = lambda ch: F.length("piece") - F.length(F.replace(F.col("piece"), F.lit(ch), F.lit("")))
        inside = inside.withColumn("open", F.sum(count("(") - count(")")).over(order))
        done = F.coalesce(F.lag("open").over(order) <= 0, F.lit(True))
        inside = inside.withColumn("done", done).withColumn("g", F.sum(F.col("done").cast("int")).over(order))
        parts = F.sort_array(F.collect_list(F.struct("i", "piece", "line", "end_line", "kind", "close_i")))
        rows = inside.groupBy("source_id", "open_i", "g", "contract", "fn", "fn_start", "is_modifier").agg(parts.alias("p"))  # by numbers first: they tell most rows apart
        text = F.translate(stripped(F.array_join("p.piece", "")), OPTION, "{}")
        rows = rows.withColumn("text", text).where(~F.col("text").isin("", "}", "{", ";"))
        number = F.row_number().over(W.partitionBy("source_id", "open_i").orderBy("g"))
        return written(rows.select("source_id", "open_i", "contract", "fn", "fn_start", "is_modifier", number.alias("stmt_no"), F.col("p")[0]["line"].alias("start_line"), F.element_at("p", -1)["end_line"].alias("end_line"), "text", F.col("p")[0]["i"].alias("first_i"), F.element_at("p", -1)["close_i"].alias("close_i")), "statements")

    @cached_property
    def occurrences(self) -> DataFrame:
        """(source_id, open_i, name, n, at, use): each identifier of the statements of functions, with the number, line and text of the statement.

        Written once for a corpus: rules that follow a name join it by (function, name).
        """
        st = self.statements.where("not is_modifier")
        rows = st.select("source_id", "open_i", F.explode(F.array_distinct(all_matches(F.col("text"), r"[A-Za-z_$][\w$]*"))).alias("name"), F.col("stmt_no").alias("n"), F.col("start_line").alias("at"), F.col("text").alias("use"))
        return written(rows, "occurrences")

    @cached_property
    def masked(self) -> DataFrame:
        """(source_id, code, n_lines, major, minor, legacy): each text without its comments, its number of lines and the version of its first pragma; written once for a corpus."""
        text = self.sources.where("text is not null").select("source_id", mask_comments(normalize_lf(F.col("text"))).alias("masked"))
        versions = _versions(text, "masked")
        return written(versions.select("source_id", F.col("masked").alias("code"), (1 + newlines(F.col("masked"))).alias("n_lines"), "major", "minor", "legacy"), "masked")

    @cached_property
    def lines(self) -> DataFrame:
        return lines(self.sources).hint("merge")  # many rows a source, of which Spark knows no more than the few bytes of its row

    @cached_property
    def line_functions(self) -> DataFrame:
        """Lines of functions: each line with the innermost function that holds it."""
        spans = self.functions.select("source_id", "contract", "fn", "start_line", "end_line", "visibility", "mutability", "modifiers", "is_constructor", "open_i", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
        inner = F.row_number().over(W.partitionBy("source_id", "line_no").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "fn"))
        code = self.masked.select("source_id", F.posexplode(F.split("code", "\n")).alias("line_no", "code"))
        code = code.withColumn("line_no", F.col("line_no") + 1).hint("merge")  # many rows a source, which Spark does not foresee
        rows = spans.withColumn("r", inner).where("r = 1").drop("r").join(code, ["source_id", "line_no"])
        return written(rows, "line_functions")

    @cached_property
    def bodies(self) -> DataFrame:
        """(source_id, contract, fn, start_line, body): the lines of each function as one text."""
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "code"))), lambda x: x["code"]), "\n")
        return self.line_functions.groupBy("source_id", "contract", "fn", "start_line", "open_i").agg(text.alias("body"))

    def matching_lines(self, pattern: str) -> DataFrame:
        """(source_id, contract, fn, start_line, hit_lines): lines of each function that match."""
        hits = self.line_functions.where(F.col("code").rlike(pattern))
        return hits.groupBy("source_id", "contract", "fn", "start_line").agg(F.sort_array(F.collect_set("line_no")).alias("hit_lines"))

    @cached_property
    def identifier_words(self) -> DataFrame:
        """(source_id, fn, fn_start, stmt_no, word): identifiers of statements cut at capitals, lower-cased, without stop words."""
        return self.statements.where("not is_modifier").select("source_id", "contract", "fn", "fn_start", "stmt_no", F.explode(words_of(F.col("text"))).alias("word")).where(F.length("word") > 1)


#: Words of the language and of every contract, which bind nothing.
STOP_WORDS = ["address", "bool", "bytes", "call", "calldata", "emit", "external", "false", "for", "function", "if", "internal", "int", "mapping", "memory", "msg", "new", "payable", "public", "require", "return", "returns", "sender", "storage", "string", "this", "transfer", "true", "uint", "value", "view", "while"]
