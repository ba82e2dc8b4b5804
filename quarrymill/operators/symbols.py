"""What a name means where it stands: declarations with the span in which they hold, and receivers of calls resolved by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import all_matches, top_parts
from quarrymill.operators.facts import CONTROL_WORDS, MODIFIER_STOP, Facts
from quarrymill.operators.graph import Graph
from quarrymill.storage import written

#: Words before a name that make no type.
_NO_TYPE = ["return", "returns", "emit", "delete", "else", "new", "throw", "revert", "require", "assert", "if", "for", "while", "do", "try", "catch", "using", "import", "pragma", "case", "is", "as", *[w for w in MODIFIER_STOP]]
_LOCAL = r"(?:^|[({,;])\s*((?:mapping\s*\([^;=]*\)|[A-Za-z_$][\w$.]*)(?:\s*\[[^\]]*\])*\s+(?:(?:memory|storage|calldata|payable)\s+)*[A-Za-z_$][\w$]*)\s*(?=[=;,)]|$)"
_TYPE = r"(?s)^(mapping\s*\(.*\)(?:\s*\[[^\]]*\])*|[A-Za-z_$][\w$.]*(?:\s*\[[^\]]*\])*)"
#: Types that are no contracts: nothing is called on their values but what libraries attach, and the members of addresses and arrays.
ELEMENTARY = r"^(?:uint\d*|int\d*|bool|bytes\d*|string|fixed\w*|ufixed\w*)$"


class Symbols:
    """Declarations of Facts, by scope: locals hold to the end of their block, parameters in their function, state in its contract and those that inherit it."""

    def __init__(self, facts: Facts, graph: Graph):
        self.facts, self.graph = facts, graph

    @property
    def locals(self) -> DataFrame:
        """(source_id, open_i, name, type, stored, first, last): variables of function bodies, over the pieces first to last.

        The block of a variable is the innermost pair of braces around its statement; one that
        is declared in the head of a loop holds in the braces which that head opens.
        """
        st = self.facts.statements
        found = st.select("source_id", "open_i", "first_i", "close_i", F.explode(all_matches(F.col("text"), _LOCAL, 1)).alias("d"))
        found = found.select("source_id", "open_i", "first_i", "close_i", F.regexp_extract("d", _TYPE, 1).alias("type"), F.regexp_extract("d", r"([A-Za-z_$][\w$]*)$", 1).alias("name"), F.col("d").rlike(r"\bstorage\b").alias("stored"))
        found = found.where(~F.col("type").isin(_NO_TYPE) & ~F.col("name").isin(_NO_TYPE + CONTROL_WORDS))
        braces = self.facts.pieces.where("kind = '{' and u is not null").select("source_id", F.col("u.open_i").alias("open_i"), F.col("i").alias("from"), F.col("close_i").alias("to"))
        inside = found.join(braces, ["source_id", "open_i"]).where("from < first_i and first_i <= to")
        return inside.groupBy("source_id", "open_i", "name", "type", "stored", F.col("first_i").alias("first"), "close_i").agg(F.min("to").alias("to")).select("source_id", "open_i", "name", "type", "stored", "first", F.coalesce("close_i", "to").alias("last"))

    @property
    def parameters(self) -> DataFrame:
        f = self.facts.units
        return f.select("source_id", "open_i", F.explode(top_parts(F.coalesce("params", F.lit("")))).alias("d")).select(
            "source_id", "open_i", F.regexp_extract("d", r"\s([A-Za-z_$][\w$]*)$", 1).alias("name"), F.regexp_extract("d", _TYPE, 1).alias("type"), F.col("d").rlike(r"\bstorage\b").alias("stored")
        ).where(F.col("name") != "")

    @property
    def state(self) -> DataFrame:
        """(source_id, contract, name, type, depth): variables that a contract sees, its own at depth 0."""
        own = self.facts.state_variables.select("source_id", F.col("contract").alias("ancestor"), "name", "type")
        return self.graph.ancestors.join(own, ["source_id", "ancestor"]).select("source_id", "contract", "name", "type", "depth")

    @property
    def attached(self) -> DataFrame:
        """(source_id, contract, library, type): `using library for type` of a contract; `*` for every type."""
        heads = self.facts.pieces.where("c is not null and kind = ';'").where(F.col("body").rlike(r"^using\b"))
        return heads.select("source_id", "c.contract", F.regexp_extract("body", r"^using\s+([\w$.]+)\s+for\b", 1).alias("library"), F.regexp_extract("body", r"\bfor\s+([\w$.]+(?:\s*\[[^\]]*\])*|\*)", 1).alias("type")).where(F.col("library") != "")

    def resolved(self, uses: DataFrame) -> DataFrame:
        """uses (use, source_id, open_i, contract, name, at) with what `name` is at piece `at`: scope (local, parameter, state or null), type, stored.

        The innermost declaration counts: of locals the one that begins last, then the
        parameter, then the state of the nearest contract.  Stored is what lives in storage.
        """
        cols = ["use", "scope", "rank", "begins", "type", "stored"]
        here = uses.select("use", "source_id", "open_i", "contract", "name", "at")
        local = here.join(self.locals, ["source_id", "open_i", "name"]).where("first <= at and at <= last").select("use", F.lit("local").alias("scope"), F.lit(0).alias("rank"), (-F.col("first")).alias("begins"), "type", "stored")
        given = here.join(self.parameters, ["source_id", "open_i", "name"]).select("use", F.lit("parameter").alias("scope"), F.lit(1).alias("rank"), F.lit(0).alias("begins"), "type", "stored")
        held = here.join(self.state, ["source_id", "contract", "name"]).select("use", F.lit("state").alias("scope"), F.lit(2).alias("rank"), F.col("depth").alias("begins"), "type", F.lit(True).alias("stored"))
        best = local.union(given).union(held).groupBy("use").agg(F.min(F.struct("rank", "begins", "scope", "type", "stored")).alias("x"))
        return uses.join(best, "use", "left").select(*uses.columns, "x.scope", "x.type", F.coalesce("x.stored", F.lit(False)).alias("stored"))


def symbols_of(e) -> Symbols:
    """The symbols of Effects, made once."""
    if not hasattr(e, "symbols"):
        e.symbols = Symbols(e.facts, e.graph)
    return e.symbols


def library_functions(e) -> DataFrame:
    """(source_id, library, method): functions of the libraries of a source, written once for a corpus; names in lower case."""
    libs = e.facts.contracts.where("kind = 'library'").select("source_id", "contract")
    return e.facts.functions.join(libs, ["source_id", "contract"]).select("source_id", F.lower("contract").alias("library"), F.lower("fn").alias("method")).distinct()


def calls_of(e) -> DataFrame:
    """Calls of members in function bodies, each with its resolved receiver; written once for a corpus.

    (use, source_id, open_i, contract, fn, line, end_line, stmt_no, text, call, receiver, cast, chained, method, args, scope, type, stored):
    receiver is the name before the last dot without brackets, root the first name of a chain;
    cast is the type of `T(x).f()`, where the value's own type no longer matters; args are the
    arguments cut at commas outside brackets.
    """
    if hasattr(e, "member_calls"):
        return e.member_calls
    st = e.facts.statements.where("not is_modifier")
    call = r"((?:[A-Za-z_$][\w$]*\s*\.\s*)*[A-Za-z_$][\w$]*(?:\((?:[^()]|\([^()]*\))*\))?(?:\[[^\]]*\])?)\s*\.\s*([A-Za-z_]\w*)\s*(\{[^}]*\}\s*)?\("
    rows = st.select("source_id", "open_i", "contract", "fn", F.col("start_line").alias("line"), "end_line", "stmt_no", "text", F.col("first_i").alias("at"), F.posexplode(all_matches(F.col("text"), call)).alias("k", "call"))
    part = lambda n: F.regexp_extract("call", rf"(?s)^{call}$", n)
    before = part(1)
    rows = rows.withColumns({
        "method": part(2), "options": F.coalesce(part(3), F.lit("")), "receiver": F.regexp_extract(before, r"([A-Za-z_$][\w$]*)(?:\((?:[^()]|\([^()]*\))*\))?(?:\[[^\]]*\])?$", 1),
        "root": F.regexp_extract(before, r"^([A-Za-z_$][\w$]*)", 1), "chained": before.contains("."), "called": before.contains("("), "indexed": before.rlike(r"\]$"),
        "inner": F.regexp_extract(before, r"\(\s*([A-Za-z_$][\w$]*)\s*\)$", 1),
    })
    rest = F.expr("substring(text, locate(call, text) + char_length(call) - 1)")
    rows = rows.withColumn("rest", rest).withColumn("use", F.concat_ws("/", "source_id", "open_i", "stmt_no", "k")).withColumn("name", F.col("root"))
    rows = written(rows, "calls")  # read four times as names are resolved
    e.member_calls = written(symbols_of(e).resolved(rows), "member_calls")
    return e.member_calls
