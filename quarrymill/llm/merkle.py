"""A Merkle manifest of a table: a tree of hashes for each source under one root, and proofs of all rows by multiproofs.

The rows of a tree are dealt in blocks of consecutive leaves.  A block asks for the least set
of nodes that it cannot derive from its own leaves (the Octopus multiproof), gets them in one
join, derives the nodes that its proofs share once, and expands each row's own proof there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrymill.llm.scratch import written

#: A run of ARITY consecutive nodes becomes one; a block holds ARITY ** LEVELS leaves.
ARITY, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Names of the tree over all subroots; a source's tree has the prefix LEAF_TREE before its name, a null source only NULL_TREE.
TOP, NULL_TREE, LEAF_TREE = "", "0", "1"


def digest(parts: list[str]) -> str:
    """H: the lowercase hex SHA-256 of the parts, one after another."""
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def widths(n: int) -> list[int]:
    """The numbers of nodes of each level of a tree of n leaves, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def missing(places: list[int], n: int) -> list[tuple[int, int]]:
    """The (level, place) of all nodes that proofs of these leaves need and that cannot be derived from the leaves themselves."""
    known, out = sorted(set(places)), []
    for level, width in enumerate(widths(n)[:-1]):
        held, above = set(known), sorted({p // ARITY for p in known})
        out += [(level, p) for run in above for p in range(run * ARITY, min((run + 1) * ARITY, width)) if p not in held]
        known = above
    return out


def derived(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """All nodes on the ways of these leaves to the root and beside them, level by level: each is computed once, or fetched."""
    levels, known = [], dict(leaves)
    for level, width in enumerate(widths(n)):
        above = sorted({p // ARITY for p in known})
        if width > 1:
            known |= {p: fetched[level, p] for run in above for p in range(run * ARITY, min((run + 1) * ARITY, width)) if p not in known}
        levels.append(known)
        if width > 1:
            known = {run: digest([known[p] for p in range(run * ARITY, min((run + 1) * ARITY, width))]) for run in above}
    return levels


def proof(levels: list[dict[int, str]], place: int, n: int) -> Iterator[tuple[list[str], list[str]]]:
    """The siblings of a leaf for each level, those to its left and those to its right."""
    for level, width in enumerate(widths(n)[:-1]):
        first, end = place // ARITY * ARITY, min((place // ARITY + 1) * ARITY, width)
        yield [levels[level][p] for p in range(first, place)], [levels[level][p] for p in range(place + 1, end)]
        place //= ARITY


def encoded(field: Column) -> Column:
    """`-` for null; else the number of bytes in UTF-8, a colon and the value."""
    text = field.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _placed(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """leaves of (tree, ...) with place, their number within their tree in this order, and n, the number of leaves of the tree.

    One sort by range, in which places count on within a partition; what comes before a
    partition is summed from one row for each partition and tree.  Rows that are alike are
    told apart by their number in the table, so many of them are no single partition.
    """
    leaves, order = leaves.withColumn("row", F.monotonically_increasing_id()), [*order, F.asc("row")]
    ordered = leaves.repartitionByRange(F.asc("tree"), *order).sortWithinPartitions(F.asc("tree"), *order)
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    spans = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("n", F.sum("held").over(W.partitionBy("tree")))
    return ordered.join(spans.drop("held"), ["tree", "part"]).withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("row", "part", "at", "first", "before")


def _raised(nodes: DataFrame) -> DataFrame:
    """(tree, level, place, n, node) of LEVELS levels up, or of the root: one row for each block of nodes (place, n: at the nodes' own level)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        level, place, n, row = int(block["level"].iloc[0]), int(block["place"].iloc[0]), int(block["n"].iloc[0]), list(block["node"])
        for _ in range(min(LEVELS, height(n))):
            row = [digest(row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
            level, place, n = level + 1, place // ARITY, -(-n // ARITY)
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "level": [level], "place": [place], "n": [n], "node": row})

    kind = "tree string, level int, place long, n long, node string"
    return nodes.select("tree", "level", "place", "n", "node").groupBy("tree", F.floor(F.col("place") / ARITY**LEVELS).alias("block")).applyInPandas(lambda key, b: run(b), kind)


def _interiors(nodes: DataFrame) -> DataFrame:
    """(tree, level, place, node) of the levels from these block roots on, up to the root, each with the levels between blocks."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        level, place, n, row = int(block["level"].iloc[0]), int(block["place"].iloc[0]), int(block["n"].iloc[0]), list(block["node"])
        out = [(level, place + i, x) for i, x in enumerate(row)]
        for _ in range(min(LEVELS - 1, height(n))):
            row = [digest(row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
            level, place, n = level + 1, place // ARITY, -(-n // ARITY)
            out += [(level, place + i, x) for i, x in enumerate(row)]
        return pd.DataFrame([(block["tree"].iloc[0], *x) for x in out], columns=["tree", "level", "place", "node"])

    return nodes.groupBy("tree", F.floor(F.col("place") / ARITY**LEVELS).alias("block")).applyInPandas(lambda key, b: run(b), "tree string, level int, place long, node string")


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of the trees whose leaves are (tree, place, n, node).

    nodes (tree, level, place, node) are those from level LEVELS on, which blocks of leaves
    cannot derive; roots are (tree, node).  Each round takes LEVELS levels at once, so few
    rounds do, and its rows shrink by ARITY ** LEVELS.
    """
    level = written(_raised(leaves.select("tree", F.lit(0).alias("level"), "place", "n", "node")), "nodes")
    nodes, roots = None, level.where("n = 1").select("tree", "node")
    while True:
        more = written(_interiors(level), "interiors")
        nodes = more if nodes is None else nodes.unionByName(more)
        rest = level.where("n > 1")
        if rest.isEmpty():
            return nodes, roots
        level = written(_raised(rest), "nodes")
        roots = roots.unionByName(level.where("n = 1").select("tree", "node"))


def _asked(rows: DataFrame) -> DataFrame:
    """(tree, block, level, place): what each block of (tree, place, n, top_place, top_n) must fetch from its own tree and from the top tree."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        tree, first = block["tree"].iloc[0], block.iloc[0]
        own = [(tree, *x) for x in missing(block["place"].tolist(), int(first["n"]))]
        top = [(TOP, *x) for x in missing([int(first["top_place"])], int(first["top_n"]))]
        return pd.DataFrame([(tree, int(first["block"]), *x) for x in own + top], columns=["tree", "block", "of", "level", "place"])

    return rows.groupBy("tree", "block").applyInPandas(lambda key, b: run(b), "tree string, block long, of string, level int, place long")


def _expanded(rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each row with its proof, and what its other leaf (tampered, where there is one) folds to under that proof."""

    def run(block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if block.empty:
            return pd.DataFrame({c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")})
        tree, n, top, top_n = block["tree"].iloc[0], int(block["n"].iloc[0]), int(block["top_place"].iloc[0]), int(block["top_n"].iloc[0])
        found = {TOP: {}, tree: {}}
        for of, level, place, node in zip(got["of"], got["level"], got["place"], got["node"]):
            found[of][int(level), int(place)] = node
        own = derived(dict(zip(block["place"].tolist(), block["node"])), found[tree], n)
        subroot = own[-1][0]
        above = derived({top: subroot}, found[TOP], top_n)
        root, top_proof = above[-1][0], list(proof(above, top, top_n))
        out = []
        for place, leaf, other in zip(block["place"].tolist(), block["node"], block["tampered"]):
            steps = [*proof(own, place, n), *top_proof]
            folded = leaf if other is None else other
            for left, right in steps:
                folded = digest([*left, folded, *right])
            out.append((leaf, subroot, root, digest([x for left, right in steps for x in left + right]), folded))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
        return pd.concat([block[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return rows.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInPandas(run, kind)


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row, over one tree for each source.

    A leaf is the hash of the row's fields (see encoded).  The leaves of a source stand in
    the order of their ids, and while there are several nodes, each ARITY consecutive ones
    become one; the roots of the sources (a null source first, then by their bytes) are the
    leaves of one more tree.  A proof is the siblings of a leaf on its way to the root, level
    by level, from left to right; folded_root is what the row folds to with them, after its
    text was replaced by tampered, where that is not null and differs; verified tells
    whether this is the root.

    Null ids stand first in their source, and rows of equal ids in the order of their leaves
    (rows repeated whole are alike, so each of their proofs holds); each row returns once,
    repeated or not.  A null field counts as `-`, an empty text as `0:`; texts are hashed
    whole, however long; other columns, of any name, are ignored; an empty table stays empty.
    """
    text = F.col(f"`{text_col}`").cast("string")
    leaf = lambda t: F.sha2(F.concat(*[encoded(t if f == text_col else F.col(f"`{f}`")) for f in fields]).cast("binary"), 256)
    changed = F.lit(None).cast("string") if tampered is None else F.when(~tampered.eqNullSafe(text) & tampered.isNotNull(), leaf(tampered))
    source = F.col(f"`{source_col}`").cast("string")
    tree = F.when(source.isNull(), F.lit(NULL_TREE)).otherwise(F.concat(F.lit(LEAF_TREE), source))
    rows = written(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf(text).alias("node"), changed.alias("tampered")), "hashed")
    leaves = written(_placed(rows, [F.asc_nulls_first("doc_id"), F.asc("node")]), "placed")
    nodes, subroots = forest(leaves)
    tops = written(_placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "node"), [F.asc("name")]), "subroots")
    top_nodes, _ = forest(tops)
    # The leaves of the top tree, and the levels within its blocks, are among what blocks of rows ask for.
    lower = written(_inner(tops), "lower")
    nodes = nodes.unionByName(top_nodes).unionByName(lower)
    held = leaves.join(tops.select(F.col("name").alias("tree"), F.col("place").alias("top_place"), F.col("n").alias("top_n")), "tree").withColumn("block", F.floor(F.col("place") / ARITY**LEVELS))
    held = written(held, "blocks")
    asked = _asked(held.select("tree", "block", "place", "n", "top_place", "top_n"))
    fetched = asked.join(nodes.select(F.col("tree").alias("of"), "level", "place", "node"), ["of", "level", "place"]).select("tree", "block", "of", "level", "place", "node")
    out = _expanded(held.select("tree", "block", "doc_id", "place", "n", "top_place", "top_n", "node", "tampered"), fetched)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _inner(leaves: DataFrame) -> DataFrame:
    """(tree, level, place, node) of the leaves and of the levels below LEVELS."""
    return _interiors(leaves.select("tree", F.lit(0).alias("level"), "place", "n", "node"))
