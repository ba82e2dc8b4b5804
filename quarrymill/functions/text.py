"""Column functions over source texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, string literals, other text up to the next of them, or one character.
_TOKEN = r"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|[^/"']++|."""


#: What `\s` matches.
BLANKS = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    """text without blanks at both ends; no regex, which would try each blank inside as the start of the end."""
    return F.trim(text, F.lit(BLANKS))


def normalize_lf(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def tokens_of(text: Column) -> Column:
    """text cut into comments, string literals and what stands between, for mask_tokens."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def mask_comments(text: Column, strings: bool = False) -> Column:
    """Comments (and with `strings` what is inside string literals) become spaces; newlines and offsets stay."""
    return mask_tokens(tokens_of(text), strings)


def mask_tokens(tokens: Column, strings: bool = False) -> Column:
    """mask_comments of the text that was cut into these tokens."""
    comment = lambda t: t.startswith("//") | t.startswith("/*")
    quoted = lambda t: t.startswith('"') | t.startswith("'")

    def masked(t: Column) -> Column:
        out = F.when(comment(t), _blank(t))
        if strings:
            inner = F.substring(t, F.lit(2), F.length(t) - 2)
            out = out.when(quoted(t) & (F.length(t) >= 2), F.concat(F.substring(t, 1, 1), _blank(inner), F.substring(t, -1, 1)))
        return out.otherwise(t)

    return F.array_join(F.transform(tokens, masked), "")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def pragma_part(code: Column, part: int) -> Column:
    """Major (1) or minor (2) number of the first version in the pragma; null without one."""
    found = F.regexp_extract(code, r"\bpragma\s+solidity\s+[^;]*?(\d+)\.(\d+)", part)
    return F.when(found != "", found.cast("int"))


def _tokens(text: Column) -> Column:
    """text cut into round and square brackets, commas, and what stands between."""
    return all_matches(text, r"[^()\[\],]+|[()\[\],]")


def _step(token: Column) -> Column:
    return F.when(token.isin("(", "["), 1).when(token.isin(")", "]"), -1).otherwise(0)


def bracketed(text: Column) -> Column:
    """(inner, rest) of a text that starts with a bracket: what stands up to its partner, and after it; without a partner all is inner."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("inner"), F.lit("").alias("rest"))

    def add(state: Column, token: Column) -> Column:
        depth = state["depth"] + _step(token)
        outer = ~state["done"] & (((state["depth"] == 0) & (depth == 1)) | (depth == 0))  # the pair itself
        return F.struct(
            F.when(state["done"], state["depth"]).otherwise(depth).alias("depth"),
            (state["done"] | (depth == 0)).alias("done"),
            F.when(state["done"] | outer, state["inner"]).otherwise(F.concat(state["inner"], token)).alias("inner"),
            F.when(state["done"], F.concat(state["rest"], token)).otherwise(state["rest"]).alias("rest"),
        )

    return F.aggregate(_tokens(text), zero, add, lambda s: F.struct(s["inner"].alias("inner"), s["rest"].alias("rest")))


def top_parts(text: Column) -> Column:
    """text cut at the commas that stand in no bracket, without blanks around the parts; a blank text has none."""
    none = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), none.alias("parts"))

    def add(state: Column, token: Column) -> Column:
        cut = (token == ",") & (state["depth"] == 0)
        return F.struct(
            (state["depth"] + _step(token)).alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(state["part"], token)).alias("part"),
            F.when(cut, F.array_append(state["parts"], state["part"])).otherwise(state["parts"]).alias("parts"),
        )

    parts = F.aggregate(_tokens(text), zero, add, lambda s: F.array_append(s["parts"], s["part"]))
    return F.when(text.rlike(r"\S"), F.transform(parts, stripped)).otherwise(none)


def outside_brackets(text: Column) -> Column:
    """text without all that stands in brackets; `returns` goes with its list."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def add(state: Column, token: Column) -> Column:
        step = _step(token)
        out = F.when((state["depth"] == 0) & (step == 0), F.concat(state["out"], token)).otherwise(state["out"])
        return F.struct((state["depth"] + step).alias("depth"), out.alias("out"))

    return F.regexp_replace(F.aggregate(_tokens(text), zero, add, lambda s: s["out"]), r"\breturns\b", " ")
