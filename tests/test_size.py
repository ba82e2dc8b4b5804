"""Plans of the audit on tables larger than the tests have: each test fails on the code before."""

import re

import pytest
from pyspark.sql import functions as F

from quarrymill import storage
from quarrymill.operators import candidates, effects, facts, flows, graph, paths, responses, rules, symbols
from quarrymill.operators.effects import KEY, Effects
from quarrymill.operators.facts import Facts
from quarrymill.sources import corpus
from quarrymill.sources.corpus import sources

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _seen(monkeypatch, module):
    """Plans of the tables that a module writes, by name."""
    plans = {}

    def write(df, name):
        plans[name] = _plan(df)
        return storage.written(df, name)

    monkeypatch.setattr(module, "written", write)
    return plans


def test_large_written_tables_are_not_broadcast(spark):
    n = storage.BROADCAST_ROWS
    large, small = (storage.written(spark.range(rows).select("id", F.lit(0).alias("x")), "rows") for rows in (n + 1, 10))
    assert "Broadcast" not in _plan(large.join(large.select("id").distinct(), "id"))  # its file is far below Spark's limit
    assert "Broadcast" in _plan(small.join(small.select("id").distinct(), "id"))
    assert large.count() == n + 1


def test_lines_of_sources_are_not_broadcast(spark, monkeypatch):
    plans = _seen(monkeypatch, facts)
    Facts(sources(spark, DATA)).line_functions
    assert "Broadcast" not in plans["line_functions"]


def test_rounds_of_a_closure_are_not_broadcast(spark, monkeypatch):
    plans = _seen(monkeypatch, graph)
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(4)], "source_id long, a int, b int")
    assert graph.closure(edges).count() == 15
    assert "Broadcast" not in plans["closure"]


def test_statements_are_dealt_once(spark, monkeypatch):
    plans = _seen(monkeypatch, facts)
    Facts(sources(spark, DATA)).statements
    assert plans["statements"].count("Exchange hashpartitioning") == 1


def test_functions_of_libraries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in _plan(paths.callback_libraries(Effects(Facts(sources(spark, DATA)))))


def test_guards_on_the_clock_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in _plan(rules.guarded_actions(Effects(Facts(sources(spark, DATA)))))


def test_clock_facts_need_no_effects(spark):
    from quarrymill.plans import queries

    e = Effects(Facts(sources(spark, DATA)))
    assert queries.AUDIT["tm1_temporal_facts"](e).count() > 0
    assert "direct_effects" not in vars(e) and not hasattr(e, "member_calls")


def test_words_stand_beside_their_statements(spark):
    """Two functions of one name on one line keep their own words."""
    text = "contract A { function f(uint a) public { uint price = a; x.transfer(y, 1); } function f(int b) public { uint z = b; x.transfer(y, price); } }"
    e = Effects(Facts(spark.createDataFrame([(1, "a.sol", text)], "source_id long, path string, text string")))
    assert rules.economic_bindings(e).count() == 0  # the price of the first function meets no sink of its own
    assert _plan(rules.economic_bindings(e)).count("Join") == 1


def test_calls_are_found_once(spark, monkeypatch):
    plans = _seen(monkeypatch, symbols)
    symbols.calls_of(Effects(Facts(sources(spark, DATA))))
    assert "regexp_extract_all" not in plans["member_calls"].split("Scan parquet")[0] and "calls" in plans


def test_texts_are_cut_and_stripped_without_repeated_passes(spark, monkeypatch):
    plans = _seen(monkeypatch, facts)
    Facts(sources(spark, DATA)).statements
    for name in ("pieces", "statements"):
        assert r"^\s+|\s+$" not in plans[name]  # this pattern was over a third of the time of pieces
    assert plans["pieces"].count("/\\*.*?(?:\\*/|\\z)") == 1  # one pass gives both masks


def test_pieces_of_blanks_and_odd_ends(spark):
    text = "pragma solidity ^0.8.0;\r\n\t contract A {\x0b\f\n uint  a ;;\n\n function f() public { \t\n a = 1 ;\n\n } }\n \t"
    rows = Facts(spark.createDataFrame([(1, "a.sol", text)], "source_id long, path string, text string")).pieces.orderBy("i").collect()
    assert [(r["kind"], r["line"], r["body"]) for r in rows] == [
        (";", 1, "pragma solidity ^0.8.0"), ("{", 2, "contract A"), (";", 3, "uint  a"), (";", 3, ""), ("{", 5, "function f() public"), (";", 6, "a = 1"), ("}", 8, ""), ("}", 8, ""), ("", 9, ""),
    ]


def test_responses_are_parsed_once(spark, monkeypatch):
    plans = _seen(monkeypatch, responses)
    rows = spark.createDataFrame([(1, "compact", '{"findings":[{"category":"gas"}]}'), (2, "compact", "[1]"), (3, "compact", None)], "response_id long, mode string, raw string")
    out = responses.validate_responses(rows.withColumn("source_id", F.col("response_id")))
    assert "ArrowEvalPython" in plans["problems"] and "ArrowEvalPython" not in plans["paths"] + _plan(out)
    assert [(r["response_id"], r["valid"], len(r["problems"])) for r in out.collect()] == [(1, False, 5)]  # an unknown label and four missing keys


def test_responses_are_dealt_out_before_they_are_made(spark):
    assert corpus.responses(spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # its file is one split


def test_legacy_sources_are_not_broadcast(spark):
    e = Effects(Facts(sources(spark, DATA)))
    ops = spark.createDataFrame([(1,), (2,)], "source_id long")
    assert "Broadcast" not in _plan(ops.join(paths._legacy(e), "source_id", "left_semi"))


@pytest.fixture(scope="module")
def corpus_effects(spark):
    return Effects(Facts(sources(spark, DATA)))


def _rule_plan(rule, e):
    """The plan of a rule whose rows may be kept as a written table."""
    return _plan(getattr(rule, "__wrapped__", rule)(e))


def test_writes_of_arithmetic_need_no_lines_of_sources(corpus_effects, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in _rule_plan(rules.rule_ar1, corpus_effects)
    assert "Broadcast" not in _plan(flows.arithmetic_provenance(corpus_effects))


@pytest.mark.parametrize("rule", [paths.rule_re4, paths.rule_re7, paths.callback_anchors], ids=["re4", "re7", "re10"])
def test_texts_of_writes_are_not_broadcast(corpus_effects, monkeypatch, rule):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in _rule_plan(rule, corpus_effects)


def test_sink_flows_broadcast_nothing(corpus_effects, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in _plan(paths.sink_flows(corpus_effects))


def test_rules_are_written_one_by_one(corpus_effects, monkeypatch):
    plans = _seen(monkeypatch, candidates)
    monkeypatch.setattr(candidates, "ALL_RULES", {"AC5": rules.rule_ac5, "UC1": rules.rule_uc1})
    candidates.all_candidates(Effects(corpus_effects.facts, corpus_effects.graph))
    assert "Join" not in plans["candidates"]


def test_patterns_look_ahead_from_the_start_only():
    """Looking ahead over the whole body from each place of it takes the square of its length."""
    assert not [rule for rule, _, must, *_ in rules.PATTERN_RULES if re.match(r"\(\?\w+\)\(\?=", must)]


def test_texts_are_masked_once_for_versions_and_lines(corpus_effects):
    for table in (rules.unchecked_arithmetic(corpus_effects), candidates.normalize(rules.rule_ac5(corpus_effects), corpus_effects)):
        assert "/\\*.*?(?:\\*/|\\z)" not in _plan(table)  # only where the masked texts are written


def test_names_of_a_source_meet_its_lines_without_another_shuffle(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    plans = _seen(monkeypatch, effects)
    text = "contract A { uint total; uint cap;\n function f(uint a) public {\n total = cap + a;\n a = 1;\n }\n function g() public {\n User storage u = users[0];\n u.paid = 1;\n }\n}"
    e = Effects(Facts(spark.createDataFrame([(1, "a.sol", text), (2, "b.sol", "contract B {\n function f(uint total) public {\n total = 1;\n }\n}")], "source_id long, path string, text string")))
    got = {(r["source_id"], r["line_no"]): (r["state_names"], r["writes"]) for r in e.line_flags.collect()}
    assert got[1, 3] == (["cap", "total"], True) and got[1, 4] == (None, False) and got[1, 8] == (None, True) and got[2, 3] == (None, False)
    assert plans["line_flags"].count("Exchange hashpartitioning") == 3


def test_slices_cut_texts_into_lines_once(corpus_effects, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    risky = corpus_effects.facts.functions.where("fn = 'withdraw'").select(*KEY).distinct()
    plan = _plan(candidates.backward_slice(corpus_effects, risky, keep_whole=10))
    assert plan.count("ReadSchema: struct<p_partkey") == 1  # lines and their number were made of two reads
    assert "Broadcast" not in plan
