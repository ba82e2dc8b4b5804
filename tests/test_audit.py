"""The audit queries against SQL on the small tables, and operators on texts of their own."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymill.functions.text import mask_comments, normalize_lf
from quarrymill.operators import paths as H
from quarrymill.operators import responses as M
from quarrymill.operators.candidates import backward_slice
from quarrymill.operators.effects import Effects
from quarrymill.operators.facts import Facts, delimiter_pairs, lines
from quarrymill.operators.graph import Graph
from quarrymill.operators.rules import pattern_scan, rule_re1, rule_re5
from quarrymill.plans import oracle, queries
from quarrymill.sources.corpus import sources
from quarrymill.sources.io import read_sources, write_findings

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    return con


@pytest.fixture(scope="module")
def effects(spark):
    """One corpus for all tests, so that its fact tables are written once."""
    return Effects(Facts(sources(spark, DATA)))


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(set(queries.AUDIT) & set(oracle.oracle_sql())))
def test_audit(effects, con, name):
    want = con.sql(oracle.oracle_sql()[name])
    got = queries._flat(queries.AUDIT[name](effects))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, want.columns) == sorted(want.fetchall(), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(set(oracle.oracle_sql()) - set(queries.AUDIT)))
def test_sql(spark, con, name):
    want = con.sql(oracle.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, want.columns) == sorted(want.fetchall(), key=lambda r: tuple(map(str, r)))


def _source(spark, *texts):
    return spark.createDataFrame([(i, f"{i}.sol", t) for i, t in enumerate(texts)], "source_id long, path string, text string")


def test_masks_keep_offsets(spark):
    text = "a /* b\n c */ \"//x\" // y\r\n'/*' d /* open"
    r = _source(spark, text).select(mask_comments(normalize_lf(F.col("text"))).alias("m"), mask_comments(normalize_lf(F.col("text")), strings=True).alias("s")).first()
    assert r.m == "a     \n      \"//x\"     \n'/*' d        "
    assert r.s == "a     \n      \"   \"     \n'  ' d        "


def test_unclosed_braces(spark):
    df = _source(spark, "a { b { c }", "}")
    assert sorted(map(tuple, delimiter_pairs(df).collect())) == [(0, 2, 11, 1), (0, 6, 10, 2)]
    assert [tuple(r) for r in delimiter_pairs(df, on_unclosed="drop").collect()] == [(0, 6, 10, 2)]


def test_hard_texts(spark):
    """Null, empty and unclosed sources go through every fact without a crash."""
    e = Effects(Facts(_source(spark, None, "", "contract A { function f() public { x = 1;", "}}{{;;", "function free(uint a) { g(); } function g() {}")))
    assert [(r.contract, r.fn) for r in e.facts.functions.orderBy("source_id", "start_line", "fn").collect()] == [("A", "f"), ("", "free"), ("", "g")]
    assert [(r.caller_fn, r.callee_fn) for r in e.graph.edges.collect()] == [("free", "g")]
    assert e.guards.count() == 3 and lines(e.facts.sources).where("source_id = 1").count() == 1


def test_cycles_end(spark):
    body = "contract C {\nfunction f() public { g(); }\nfunction g() internal { h(); }\nfunction h() internal { g(); }\nfunction x() private {}\n}"
    g = Graph(Facts(_source(spark, body)))
    assert sorted((r.root_fn, r.fn, r.depth) for r in g.reachable_roots.collect()) == [("f", "f", 0), ("f", "g", 1), ("f", "h", 2)]
    assert [r.fn for r in g.unreachable.collect()] == ["x"]


def test_storage_alias_and_safe_mint(spark):
    body = """contract M {
  struct P { uint debt; }
  mapping(address => P) positions;
  uint supply;
  function mint(address to) external {
    supply += 1;
    _safeMint(to, supply);
    token.transfer(to, 1);
  }
  function pay(address to) external {
    P storage p = positions[to];
    token.transfer(to, p.debt);
    p.debt = 0;
  }
}"""
    e = Effects(Facts(_source(spark, body)))
    assert [(r.fn, r.line, r.sink_line) for r in rule_re5(e).collect()] == [("mint", 7, 8)]
    assert [(r.fn, r.line, r.sink_line) for r in rule_re1(e).collect()] == [("pay", 12, 13)]


def test_backward_slice(spark):
    text = "pragma solidity ^0.8.0;\ncontract S {\n" + "  // pad\n" * 20 + "  uint x;\n  function a() public { b(); }\n  function b() internal { x = 1; }\n  function c() public {}\n" + "  // pad\n" * 20 + "}"
    e = Effects(Facts(_source(spark, text)))
    risky = e.facts.functions.where("fn = 'b'").select("source_id", "open_i")
    r = backward_slice(e, risky, keep_whole=10).first()
    assert r.n_kept == 11 and "function a" in r.slice and "function c" not in r.slice and r.slice.count("...") == 2
    assert backward_slice(e, risky, keep_whole=100).first().n_kept == text.count("\n") + 1


def test_paths_on_hard_texts(spark):
    """Null, empty and broken sources give no row and no crash in any rule on paths."""
    e = Effects(Facts(_source(spark, None, "", "contract A { function f() public { x = 1;", "}}{{;;", "function f(", "library L { function g() internal { g(); } }")))
    for name in ("AC7", "RE4", "RE6", "RE7", "AR4", "AR6", "FR4", "FR5", "TM4", "TM7", "TM8", "TM11"):
        assert [r.source_id for r in H.ALL_RULES[name](e).collect() if name != "AC7"] == []
    assert H.callback_libraries(e).count() + H.evidence_chains(e).count() + H.field_flows(e).count() == 0


def test_sink_flow_slice(spark):
    pad = "  // pad\n" * 20
    body = f"pragma solidity ^0.8.0;\ncontract S {{\n{pad}  uint total;\n  uint other;\n  function a() public {{ total += 1; b(); }}\n  function b() internal {{}}\n  function c() public {{ total = 2; }}\n  function d() public {{ other = 1; }}\n{pad}}}"
    r = {r.fn: r for r in H.sink_flows(Effects(Facts(_source(spark, body)))).collect()}
    assert sorted(r) == ["a", "c", "d"] and r["a"].writers == ["c"] and r["a"].kinds == ["missing_guard", "state_write"]
    lines = r["a"].slice.split("\n")
    assert r["a"].n_kept == len(lines) == 5 + 3 + 3 and "  function b() internal {}" in lines and not any("function c" in x or "other" in x for x in lines)


def test_evidence_chain_limits(spark):
    """Two rows a root at most, and no root after the one that brings a source to its limit."""
    call = lambda i: f"  function f{i}() external {{\n    a.call{{value: 1}}('');\n    x = 1;\n    b.safeTransfer(msg.sender, 1);\n    x = 2;\n    _safeMint(msg.sender, 1);\n    x = 3;\n  }}\n"
    e = Effects(Facts(_source(spark, "contract C {\n" + "".join(call(i) for i in range(9)) + "}")))
    rows = H.evidence_chains(e).collect()
    assert len(rows) == 12 and {r.root_fn for r in rows} == {f"f{i}" for i in range(6)}
    assert {(r.line, r.then_line) for r in rows if r.root_fn == "f0"} == {(3, 4), (5, 6)}
    assert len(H.evidence_chains(e, per_root=9, per_source=5).collect()) == 6


def test_ordinary_transfers_hand_control_to_nobody(spark):
    body = """contract T {
  mapping(address => uint) balances;
  function withdraw() external {
    token.transfer(msg.sender, 1);
    balances[msg.sender] = 0;
  }
  function give(address to) external {
    token.transfer(to, 1);
    balances[to] = 0;
  }
}"""
    e = Effects(Facts(_source(spark, body)))
    assert [(r.fn, r.line, r.sink_line) for r in H.rule_re4(e).collect()] == [("withdraw", 4, 5)]


def test_pattern_rules(spark):
    """Each later pattern rule on a function that it must report and on one that holds the guard it asks for."""
    body = """contract P {
  function updateReward(uint id, uint amount) external { rewards[id] = amount; }
  function updateShare(uint id, uint amount) external onlyOwner { shares[id] = amount; }
  function flashLoan(Reserve storage reserve, address receiverAddress) external {
    IReceiver r = IReceiver(receiverAddress);
    r.executeOperation(1);
    reserve.update(1);
  }
  function flashLoanSafe(Reserve storage reserve, address receiverAddress) external nonReentrant {
    IReceiver r = IReceiver(receiverAddress);
    r.executeOperation(1);
    reserve.update(1);
  }
  function permit(uint deadline) external { require(ecrecover(h) == o); }
  function permitChecked(uint deadline) external { require(block.timestamp <= deadline); require(ecrecover(h) == o); }
  function leaf() external { require(MerkleProof.verify(p, root, keccak256(abi.encodePacked(a)))); }
  function leafOnce() external { require(MerkleProof.verify(p, root, keccak256(abi.encodePacked(a, nonce)))); }
  function rate() external { uint timeDelta = block.timestamp - last; r = x / timeDelta; }
  function rateChecked() external { uint timeDelta = block.timestamp - last; require(timeDelta > 0); r = x / timeDelta; }
  function borrow() external { uint p = oracle.getPrice(); pool.borrow(p); }
  function borrowFresh() external { uint p = oracle.getPrice(); require(updatedAt + 1 > block.timestamp); pool.borrow(p); }
}"""
    got = {(r.rule_id, r.fn, r.line) for r in pattern_scan(Effects(Facts(_source(spark, body)))).collect()}
    want = {("AC3", "updateReward", 2), ("RE9", "flashLoan", 6), ("TM10_permit", "permit", 14), ("TM10_leaf", "leaf", 16), ("TM10_delta", "rate", 18), ("TM10_oracle", "borrow", 20)}
    assert {g for g in got if g[0] in {w[0] for w in want}} == want


def test_invalid_utf8(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff{}")), (2, bytearray(b"{}")), (3, None)], "response_id long, raw binary")
    assert [(r.response_id, r["class"]) for r in M.classify_responses(df).orderBy("response_id").collect()] == [(1, "INVALID_UTF8"), (2, "JSON_OBJECT"), (3, "EMPTY_RESPONSE")]


def test_pair_views(spark):
    old = "\n".join(f"line {i} value;" for i in range(60))
    new = old.replace("line 7 value", "line 7 other").replace("line 50 value", "line 50 changed")
    df = spark.createDataFrame([(1, old, new), (2, old, old.replace(" ", "  ")), (3, "a b", "a c")], "pair_id long, vulnerable string, patched string")
    got = {r.pair_id: r for r in M.pair_views(df, 400, 400).collect()}
    assert set(got) == {1, 3} and got[3].view == "full_pair"
    assert (got[1].n_groups, got[1].n_visible) == (2, 2) and "line 7 other" in got[1].after and "changed" in got[1].after
    assert {r.pair_id: r.n_visible for r in M.pair_views(df, 200, 200).collect()}[1] == 1


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sol").write_text("contract A {}\nx")
    df = read_sources(spark, str(tmp_path / "in"))
    assert [(r.path.endswith("a.sol"), r.text) for r in df.collect()] == [(True, "contract A {}\nx")]
    write_findings(spark.createDataFrame([("reentrancy", 3)], "vulnerability_type string, line int"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("vulnerability_type", "line").collect()] == [("reentrancy", 3)]


def _audited(spark, *texts):
    return Effects(Facts(_source(spark, *texts)))


def test_writes_after_calls_are_ranked(spark):
    """Asset words add, bookkeeping words take, indexes and record fields add; the earliest wins on ties."""
    e = _audited(
        spark,
        """contract A {
  uint feeRate; uint allowanceTotal; mapping(address => uint) statusOf; uint plain; uint other;
  struct U { uint amount; } mapping(address => U) users;
  function a() public { msg.sender.call("");
    feeRate = 1;
    allowanceTotal = 2;
  }
  function b() public { msg.sender.call("");
    statusOf[msg.sender] = 1;
    plain = 2;
    other = 3;
  }
  function c() public { U storage user = users[msg.sender]; msg.sender.call("");
    allowanceTotal = 1;
    user.amount = 2;
  }
}""",
    )
    got = {r.fn: (r.write_line, r.score) for r in queries.L.best_state_writes(e).collect()}
    assert got == {"a": (6, 100), "b": (10, 0), "c": (15, 125)}


def test_assembly_calls_by_paired_blocks(spark):
    e = _audited(
        spark,
        """contract A {
  function outside(address t) public {
    assembly { let x := 1 }
    uint a;
    a = 1;
    t.call("");
  }
  function blind(address t) public {
    assembly ("memory-safe") {
      pop(call(gas(), t, 0, 0, 0, 0, 0))
    }
  }
  function later(address t) public {
    assembly {
      let ok := call(gas(), t, 0, 0, 0, 0, 0)
      let y := 1
      let z := 2
      let v := 3
      let w := 4
      let u := 5
      let q := 6
      if iszero(ok) { revert(0, 0) }
    }
  }
  function other(address t) public {
    assembly {
      let ok := delegatecall(gas(), t, 0, 0, 0, 0)
      if okay { revert(0, 0) }
    }
  }
  function inline_(address t) public {
    assembly {
      if iszero(staticcall(gas(), t, 0, 0, 0, 0)) { revert(0, 0) }
    }
  }
}""",
    )
    from quarrymill.operators.rules import rule_uc6

    assert sorted((r.fn, r.line) for r in rule_uc6(e).collect()) == [("blind", 10), ("other", 27)]


def test_sends_stand_inside_their_loop(spark):
    e = _audited(
        spark,
        """contract A {
  function after_(address[] memory a) public {
    for (uint i = 0; i < a.length; i++) { a[i]; }
    payable(msg.sender).transfer(1);
  }
  function inside(address[] memory a, uint n) public {
    for (uint i = 0; i < 10; i++) {
      payable(a[i]).transfer(1);
    }
    while (n > m()) { n--; }
    for (uint i = 0; i < a.length && i < 10; i++) { if (n > 0) { payable(a[i]).send(1); } }
  }
}""",
    )
    from quarrymill.operators.rules import loop_features

    got = sorted((r.line, r.unbounded, r.sends) for r in loop_features(e).collect())
    assert got == [(3, True, False), (7, False, True), (10, True, False), (11, True, True)]
    more = _audited(spark, 'contract B {\n  function f(address[] memory a) public {\n    for (uint i = 0; i < a.length; i++) {\n      a[i].call("");\n    }\n    for (uint i = 0; i < 3; i++) {\n      x += i;\n    }\n    a[0].delegatecall("");\n  }\n}')
    assert sorted((r.line, r.unbounded, r.sends, r.calls) for r in loop_features(more).collect()) == [(3, True, False, True), (6, False, False, False)]


def test_who_is_restricted(spark):
    heads = {
        "a": ("public", "require(tx.origin == owner);"), "b": ("public", "require(msg.sender == owner);"), "c": ("public onlyOwner", "x = 1;"), "d": ("public onlyKeeper", "x = 1;"),
        "e": ("internal", "x = 1;"), "f": ("external", "if (!hasRole(R, msg.sender)) revert();"), "g": ("external", "require(isAuthorized(msg.sender));"), "h": ("public", "x = 1; // require(msg.sender == owner)"),
        "i": ("public", "require(balances[msg.sender] > 0);"), "j": ("public", "if (msg.sender != admin) revert();"),
    }
    text = "contract A { address owner;\n" + "\n".join(f"  function {n}() {v} {{\n    {b}\n  }}" for n, (v, b) in heads.items()) + "\n}"
    got = {r.fn for r in _audited(spark, text).admin_restricted.where("restricted").collect()}
    assert got == {"b", "c", "e", "f", "g", "j"}


def test_primary_lines(spark):
    """By risk and by the reported function, in every mode."""
    from quarrymill.operators.candidates import to_findings

    e = _audited(spark, "contract A {\n  function f() public {\n    g();\n  }\n  function g() internal {\n    x = 1;\n  }\n}")
    columns = "source_id long, open_i int, risk_type string, contract string, fn string, entrypoint string, sink string, line int, sink_line int, evidence_lines array<int>, state_write_lines array<int>, operation_lines array<int>, reason string, evidence_kind string, admission boolean"
    row = lambda risk, fn, sink, line, sink_line, ops: (0, 1, risk, "A", fn, "f", sink, line, sink_line, [line], [], ops, "r", "k", True)
    rows_ = [row("reentrancy", "g", "G", 3, 6, []), row("access_control", "f", "g", 3, 6, []), row("front_running", "f", "f", 3, 4, [2]), row("arithmetic", "f", "f", 3, 4, [5, 6]), row("time_manipulation", "f", "", 3, 4, [])]
    found = {m: {r.vulnerability_type: r.primary_line for r in to_findings(spark.createDataFrame(rows_, columns), e, m).collect()} for m in ("call_site", "sink")}
    assert found["call_site"] == {"reentrancy": 6, "access_control": 3, "front_running": 2, "arithmetic": 5, "time_manipulation": 3}
    assert found["sink"]["access_control"] == 6 and found["sink"]["time_manipulation"] == 3


def test_call_chains_are_bounded(spark):
    """A ladder of diamonds: chains double with each step, up to the bound; what goes on is listed."""
    steps = "\n".join(f"  function s{i}() internal {{ l{i}(); r{i}(); }}\n  function l{i}() internal {{ s{i + 1}(); }}\n  function r{i}() internal {{ s{i + 1}(); }}" for i in range(5))
    e = Effects(Facts(_source(spark, f"contract A {{\n  function go() public {{ s0(); }}\n{steps}\n  function s5() internal {{ x = 1; }}\n}}")), max_calls=4)
    assert e.call_tree.where(F.size("way") > 4).isEmpty() and e.call_tree.count() == 1 + 1 + 2 + 2 + 4
    assert e.cut_chains.count() == 4


def _summary(e):
    return [(r.fn, r.call_line, r.write_line, r.cross_lines, r.reentrant_order) for r in e.reentrancy_summary.orderBy("root").collect()]


def test_order_through_ten_helpers(spark):
    """A call ten helpers down and a write after it: chains have no bound."""
    chain = "".join(f"  function f{i}() internal {{ f{i + 1}(); }}\n" for i in range(1, 10))
    e = _audited(spark, f'contract A {{\n  uint x;\n  function f0() public {{\n    f1();\n    x = 1;\n  }}\n{chain}  function f10() internal {{\n    msg.sender.call("");\n  }}\n}}')
    assert _summary(e) == [("f0", 17, 5, [], True)]


def test_order_over_a_ladder_of_diamonds(spark):
    """Chains double with each step; ways and what follows a call stay a row for each function."""
    n = 4
    steps = "\n".join(f"  function s{i}() internal {{ l{i}(); r{i}(); }}\n  function l{i}() internal {{ s{i + 1}(); }}\n  function r{i}() internal {{ s{i + 1}(); }}" for i in range(n))
    e = _audited(spark, f'contract A {{\n  uint x;\n  function go() public {{ s0(); }}\n{steps}\n  function s{n}() internal {{\n    x = 1;\n    msg.sender.call("");\n  }}\n}}')
    assert e.ways.count() == 1 + 3 * n + 1
    assert [(r.step, r.kind) for r in e.runtime_events.orderBy("step").collect()] == [(1, "write"), (2, "call")]
    # the write runs again when the ladder's last right side calls it once more
    assert _summary(e) == [("go", 6 + 3 * n, 5 + 3 * n, [5 + 3 * n], True)]


def test_order_over_cycles(spark):
    """A function that still runs is not entered again, also after the call."""
    e = _audited(
        spark,
        """contract A {
  uint x; uint y;
  function go() public {
    a();
    x = 1;
  }
  function a() internal {
    x = 2;
    b();
    y = 3;
  }
  function b() internal {
    msg.sender.call("");
    a();
    c();
  }
  function c() internal { a(); b(); y = 4; }
  function late() public {
    x = 9; d(); d2();
  }
  function d() internal { msg.sender.call(""); }
  function d2() internal { late2(); y = 1; }
  function late2() internal { d(); x = 7; }
}""",
    )
    # what a line does itself comes before what it calls: line 22 writes y before late2 runs
    assert _summary(e) == [("go", 13, 17, [8, 10, 17], True), ("late", 21, 22, [22, 23], True)]
    assert [(r.kind, r.line) for r in e.runtime_events.where("root < 10").orderBy("step").collect()] == [("write", 8), ("call", 13), ("write", 17), ("write", 10), ("write", 5)]


def test_calls_of_one_line_run_as_they_stand(spark):
    e = _audited(spark, 'contract A {\n  uint x;\n  function go() public { b(); a(); }\n  function a() internal { msg.sender.call(""); }\n  function b() internal {\n    x = 1;\n  }\n}')
    assert [(r.kind, r.line) for r in e.runtime_events.orderBy("step").collect()] == [("write", 6), ("call", 4)]
    assert _summary(e)[0][1:3] == (4, None)


SYMBOLS = """library L { function add(uint a, uint b) internal returns (uint) { return a + b; } }
contract B is Unseen {
  using L for uint;
  uint total; IERC20 stored; mapping(uint => Pool) pools;
  function f(mapping(address => uint) storage m, function(uint,uint) external g, uint8 z) public onlyOwner(z) returns (function(uint) external) {
    total.add(1);
    L.add(1, 2);
    _mint(msg.sender, 1);
    super._burn(1);
    { IERC20 total = IERC20(address(0)); total.settle(2); }
    stored.approve(address(this), 7);
    emit transferred(1);
    exchange.fillOrder(z, total);
    pools[z].withdraw(z);
    mine(z);
  }
  function mine(uint a) internal { safeTransfer(a, 5); total.settle(a); }
  function h(IERC20 t, address u, uint[] memory xs) external returns (uint) {
    t.transfer(u, 1);
    IERC20(u).transfer(u, xs.length);
    bool ok = t.transfer(u, 1);
    require(IERC20(u).approve(u, 3));
    SafeERC20.safeTransfer(t, u, 1);
    t.balanceOf(u);
    u.call("");
    uint t = 3;
    t.transfer(u, 1);
    xs.push(t);
    return t;
  }
}"""


def test_parameters_end_at_commas_outside_brackets(spark):
    e = _audited(spark, SYMBOLS)
    got = [(r.place, r.type, r.name, r.bits) for r in e.facts.parameters.where("fn = 'f'").orderBy("place").collect()]
    assert got == [(0, "mapping(address => uint)", "m", None), (1, "function(uint,uint)", "g", None), (2, "uint8", "z", 8)]
    f = e.facts.functions.where("fn = 'f'").first()
    assert (f.visibility, f.modifiers) == ("public", ["onlyOwner"])


def test_effects_by_what_names_mean(spark):
    """Functions of the source's libraries, attached or named, are no external calls; names mean their innermost declaration."""
    e = _audited(spark, SYMBOLS)
    flags = ("low_level", "asset_call", "callback_capable", "inherited", "economic", "dynamic_amount", "library_call")
    got = [(r.line, r.kind, r.method, {f for f in flags if r[f]}) for r in e.direct_effects.orderBy("line", "method").collect()]
    assert got == [
        (8, "state_write", "_mint", {"inherited"}), (9, "state_write", "_burn", {"inherited"}),
        (10, "external_call", "settle", {"asset_call", "callback_capable"}), (11, "external_call", "approve", set()),
        (13, "external_call", "fillOrder", {"asset_call", "economic", "dynamic_amount"}), (14, "state_write", "withdraw", {"library_call"}),
        (17, "external_call", "safeTransfer", {"asset_call"}), (19, "external_call", "transfer", {"asset_call", "callback_capable"}),
        (20, "external_call", "transfer", {"asset_call", "callback_capable", "dynamic_amount"}), (21, "external_call", "transfer", {"asset_call", "callback_capable"}),
        (22, "external_call", "approve", set()), (23, "external_call", "safeTransfer", {"asset_call"}), (25, "external_call", "call", {"low_level", "callback_capable", "dynamic_amount"}),
    ]


def test_discarded_returns_by_the_type_of_the_receiver(spark):
    """State, parameters, casts and imported interfaces; not what is used, shadowed by a number or called through a safe wrapper."""
    from quarrymill.operators.rules import discarded_returns

    more = """
interface IOver { function pay(address a) external returns (bool); function pay(address a, uint n) external; function look() external view returns (uint); }
contract C is Base {
  IOver o;
  function g(address x) public {
    o.pay(x);
    o.pay(x, 1);
    o.look();
    super.move(x);
    try o.pay(x) { } catch { }
    if (o.pay(x)) { o.pay(x); }
  }
}
contract Base { function move(address x) public virtual returns (bool) { return true; } }"""
    e = _audited(spark, SYMBOLS + more)
    got = [(r.line, r.name, r.type, r.method, r.returns) for r in discarded_returns(e).orderBy("line").collect()]
    assert got == [
        (11, "stored", "IERC20", "approve", "bool"), (19, "t", "IERC20", "transfer", "bool"), (20, "u", "IERC20", "transfer", "bool"), (25, "u", "address", "call", "unknown"),
        (36, "o", "IOver", "pay", "bool"), (39, "super", "C", "move", "bool"), (40, "o", "IOver", "pay", "bool"), (41, "o", "IOver", "pay", "bool"),
    ]


def test_two_branches_on_a_line_of_assembly(spark):
    from quarrymill.operators.rules import rule_uc6

    body = "let ok := call(gas(), 1, 0, 0, 0, 0, 0)\n      if gt(1, 2) { stop() } if iszero(ok) { revert(0, 0) }"
    other = body.replace("iszero(ok)", "iszero(no)")
    e = _audited(spark, f"contract A {{\n  function f() public {{\n    assembly {{\n      {body}\n    }}\n  }}\n  function g() public {{\n    assembly {{\n      {other}\n    }}\n  }}\n}}")
    assert [(r.fn, r.line) for r in rule_uc6(e).collect()] == [("g", 10)]  # line 8 is the head of g


def test_asset_actions_after_control_is_handed_away(spark):
    """The three forms of RE5, what does not count, and the events that they stand on."""
    from quarrymill.operators.flows import asset_events

    e = _audited(
        spark,
        """contract A is ERC721 {
  mapping(address => uint) balances;
  function low(address to) public {
    to.call{value: 1}("");
    vault.deposit(1);
    pool.withdraw(1);
  }
  function cast(address to) public {
    IPool(to).borrow(1);
    IERC20(to).transfer(to, 1);
  }
  function minted(address to) public {
    token.transferFrom(to, to, 1);
    shares.mint(to, 1);
  }
  function post(address to) public {
    balances[to] = 1;
    _safeMint(to, 1);
    token.transfer(to, 1);
  }
  function locked(address to) public nonReentrant {
    to.call("");
    vault.deposit(1);
  }
  function before(address to) public {
    vault.deposit(1);
    to.call("");
  }
  function empty(address to) public {
    tx.origin.call("");
    IPair(to).swap(1, 2, to, new bytes(0));
    desk.deposit(1);
  }
}""",
    )
    got = sorted((r.fn, r.line, r.sink_line, r.evidence_kind, r.confidence) for r in rule_re5(e).collect())
    assert got == [
        ("cast", 9, 10, "qualified_external_callback_before_external_asset_action", 0.85), ("low", 4, 5, "low_level_value_call_before_external_asset_action", 0.95),
        ("minted", 13, 14, "token_transfer_before_external_asset_action", 0.85), ("post", 18, 19, "post_state_update_receiver_callback", 0.86),
    ]
    events = sorted((r.line, r.family, r.method) for r in asset_events(e).where("line < 20").collect())
    assert events == [(5, "external", "deposit"), (6, "external", "withdraw"), (10, "external", "transfer"), (13, "external", "transferFrom"), (14, "mint", "mint"), (19, "external", "transfer")]


def test_hooks_of_tokens_are_callbacks(spark):
    from quarrymill.operators.flows import callback_events

    e = _audited(spark, 'contract A {\n  function f(address to) public {\n    _callTokensToSend(to, 1);\n    r.tokensReceived(to, 1);\n    tx.origin.call("");\n    x = 1;\n  }\n  function tokensReceived(address a, uint n) external { y = 1; }\n}')
    assert sorted((r.line, r.callback) for r in callback_events(e).collect()) == [(3, "erc777_sender_hook"), (4, "erc777_receiver_hook")]


def test_what_names_flow_into(spark):
    from quarrymill.operators.flows import def_use_chains

    e = _audited(spark, "contract A {\n  function f() public {\n    uint t = block.timestamp;\n    uint winner = t % 10;\n    uint other = tt % 10;\n    bytes32 h = blockhash(1);\n    uint k = xs[uint(h)];\n    require(t > 1);\n  }\n}")
    assert sorted(tuple(r)[2:] for r in def_use_chains(e).collect()) == [("block", "h", 6, "index", 7), ("time", "t", 3, "modulo", 4), ("time", "t", 3, "require", 8)]


def test_keys_of_objects_inside_responses(spark):
    """Extra and missing keys at every depth, with their paths; other modes have other objects."""
    import json

    variable = {"name": "x", "kind": 1}
    constraint = {"id": "c", "description": "d", "expression": "e", "must_be": "true", "related_line": "7", "z3_schema": {"state_variables": [variable], "pre_conditions": [], "state_transitions": [], "more": {}}, "llm_reasoning": "l"}
    finding = {"vulnerability_type": "reentrancy", "function_name": "f", "attack_path": "p", "temporal_pattern": "t", "ast_match_confidence": 0.9, "constraint_violation_confidence": 0.5, "constraints": [constraint]}
    whole = {"identified_risks": [], "root_cause_analysis": "r", "primary_vulnerabilities": [], "findings": [finding]}
    rows_ = [(1, 0, "four_field", json.dumps(whole)), (2, 0, "compact", '{"findings":[{"category":"reentrancy","function_name":"f","primary_line":3,"evidence_lines":[1],"reason":"r"}]}'), (3, 0, "compact", '{"findings":[{"category":"reentrancy","function_name":"f","primary_line":3,"evidence_lines":[1]}, null]}')]
    got = {r.response_id: r.problems for r in M.validate_responses(spark.createDataFrame(rows_, "response_id long, source_id long, mode string, raw string")).collect()}
    z3 = "findings[].constraints[].z3_schema"
    assert got == {1: [f"extra_key:{z3}.more", f"extra_key:{z3}.state_variables[].kind", f"missing_key:{z3}.state_variables[].type"], 2: [], 3: ["unknown_label", "missing_key:findings[].reason"]}  # a null has no label


def test_steps_in_their_order(spark):
    """A share price taken before the transfer and minted without a bound; not with a bound, a restriction or another order."""
    def deposit(name, head="public", first="uint t = totalAssets();", more=""):
        return f"  function {name}(uint n) {head} {{\n    {first}\n    token.transferFrom(msg.sender, address(this), n);\n    uint t2 = t;\n    shares = n * totalSupply() / t;\n    {more}\n    _mint(msg.sender, shares);\n  }}\n"

    text = "contract A {\n  uint shares;\n" + deposit("deposit") + "}\n" + "".join(f"contract B{i} {{\n  uint shares;\n{d}}}\n" for i, d in enumerate([deposit("deposit", more="require(shares >= minShares);"), deposit("depositTo", head="public onlyOwner"), deposit("deposit", first="uint t;", more="t = totalAssets();"), deposit("put")]))
    e = _audited(spark, text)
    got = [(r.rule_id, r.risk_type, r.contract, r.fn, r.line, r.evidence_lines, r.confidence) for r in pattern_scan(e).where("rule_id = 'FR3_share'").collect()]
    assert got == [("FR3_share", "front_running", "A", "deposit", 3, [3, 4, 5, 7, 9], 0.9)]
