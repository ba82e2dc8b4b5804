"""A corpus of contract sources, and archived responses and patches about them, made from the given tables.

Each source is one template, chosen by the part's key, with the key in its names and up to four
filler lines after its first contract line, so line numbers differ between sources.  The
same templates are also written as SQL, for the queries that SQL can hold against.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = (
    # 0: a withdrawal that calls before it writes, one with a mutex, one that writes first
    """pragma solidity ^0.8.0;
contract Vault@ {
#    mapping(address => uint256) public balances;
    bool locked;
    modifier nonReentrant() {
        require(!locked);
        locked = true;
        _;
        locked = false;
    }
    function deposit() external payable {
        balances[msg.sender] += msg.value;
    }
    function withdraw(uint256 amount) external {
        (bool ok, ) = msg.sender.call{value: amount}("");
        require(ok);
        balances[msg.sender] -= amount;
    }
    function guarded(uint256 amount) external nonReentrant {
        (bool ok, ) = msg.sender.call{value: amount}("");
        require(ok);
        balances[msg.sender] -= amount;
    }
    function orderly(uint256 amount) external {
        balances[msg.sender] -= amount;
        (bool ok, ) = msg.sender.call{value: amount}("");
        require(ok);
    }
}
""",
    # 1: the call stands two helpers deep; a cycle of helpers; a helper that nothing reaches
    """pragma solidity ^0.8.4;
contract Chain@ {
#    mapping(address => uint256) credit;
    function claim(uint256 amount) public {
        relay(amount);
        credit[msg.sender] = 0;
    }
    function relay(uint256 amount) internal {
        pay(amount);
    }
    function pay(uint256 amount) internal {
        (bool ok, ) = msg.sender.call{value: amount}("");
        require(ok);
    }
    function ping(uint256 n) public {
        pong(n);
    }
    function pong(uint256 n) internal {
        ping2(n);
    }
    function ping2(uint256 n) internal {
        pong(n);
    }
    function lost(uint256 n) private {
        credit[msg.sender] = n;
    }
}
""",
    # 2: super calls through bases
    """pragma solidity ^0.8.0;
abstract contract Base@ {
#    mapping(address => uint256) internal shares;
    function _grant(address to, uint256 n) internal virtual {
        shares[to] += n;
    }
}
interface IRegistry@ {
    function lookup(address who) external view returns (uint256);
}
contract Shop@ is Base@, Pausable {
    function buy(uint256 n) external {
        _grant(msg.sender, n);
    }
    function _grant(address to, uint256 n) internal override {
        super._grant(to, n);
    }
}
""",
    # 3: administrative writes with and without authority
    """pragma solidity ^0.8.0;
contract Admin@ {
#    address public owner;
    uint256 public fee;
    modifier onlyOwner() {
        require(msg.sender == owner);
        _;
    }
    modifier onlyAnyone() {
        _;
    }
    constructor() {
        owner = msg.sender;
    }
    function initialize(address first) external {
        owner = first;
    }
    function setFee(uint256 value) external onlyOwner {
        fee = value;
    }
    function setOwner(address next) public {
        owner = next;
    }
    function setFeeLoose(uint256 value) external onlyAnyone {
        fee = value;
    }
    function setFeeChecked(uint256 value) external {
        require(msg.sender == owner);
        fee = value;
    }
    function adjust(uint256 value) external {
        _apply(value);
    }
    function _apply(uint256 value) internal {
        fee = value;
    }
}
""",
    # 4: tx.origin as authority, and as a harmless check for contracts
    """pragma solidity ^0.6.0;
contract Origin@ {
#    address owner;
    address treasury;
    modifier fromOwner() {
        require(tx.origin == owner);
        _;
    }
    modifier noContracts() {
        require(msg.sender == tx.origin);
        _;
    }
    function setTreasury(address next) external fromOwner {
        treasury = next;
    }
    function join() external noContracts {
        treasury = msg.sender;
    }
    function remember() external {
        owner = tx.origin;
    }
    function sweep(address token) external {
        IERC20(token).transfer(tx.origin, 1);
    }
}
""",
    # 5: results of low-level calls: dropped, unused, checked, returned, emitted
    """pragma solidity ^0.8.0;
contract Caller@ {
#    event Done(bool ok);
    function dropped(address to) external {
        to.call("");
    }
    function unused(address to) external {
        (bool ok, ) = to.call("");
    }
    function required(address to) external {
        require(payable(to).send(1));
    }
    function branched(address to) external {
        (bool ok, ) = to.call("");
        if (!ok) {
            revert();
        }
    }
    function returned(address to) external returns (bool) {
        return payable(to).send(1);
    }
    function emitted(address to) external {
        (bool ok, ) = to.delegatecall("");
        emit Done(ok);
    }
}
""",
    # 6: token transfers whose result is dropped, kept or required
    """pragma solidity ^0.8.0;
interface IBase@ {
    function transfer(address to, uint256 n) external returns (bool);
}
interface IToken@ is IBase@ {
    function balanceOf(address who) external view returns (uint256);
}
contract Payer@ {
#    IToken@ token;
    function loose(address to, uint256 n) external {
        token.transfer(to, n);
    }
    function kept(address to, uint256 n) external {
        bool ok = token.transfer(to, n);
    }
    function strict(address to, uint256 n) external {
        require(
            token.transfer(to, n),
            "failed"
        );
    }
    function peek(address who) external view returns (uint256) {
        return token.balanceOf(who);
    }
}
""",
    # 7: calls in assembly, with and without a look at the status
    """pragma solidity ^0.8.0;
contract Assembler@ {
#    function blind(address to) external {
        assembly {
            let r := call(gas(), to, 0, 0, 0, 0, 0)
        }
    }
    function seen(address to) external {
        assembly {
            let success := call(gas(), to, 0, 0, 0, 0, 0)
            switch success
            case 0 { revert(0, 0) }
        }
    }
}
""",
    # 8: arithmetic before 0.8, guarded and not
    """pragma solidity ^0.4.24;
contract Sums@ {
#    mapping(address => uint256) balances;
    uint256 supply;
    function Sums@() public {
        supply = 1;
    }
    function mint(address to, uint256 amount) public {
        balances[to] += amount;
        supply += amount;
    }
    function move(address to, uint256 amount) public {
        require(balances[msg.sender] >= amount);
        balances[msg.sender] -= amount;
        require(balances[to] + amount >= balances[to]);
        balances[to] += amount;
    }
    function scale(uint256 a, uint256 b) public view returns (uint256) {
        uint256 c = a * b;
        return c;
    }
}
""",
    # 9: orders that can be overtaken: swaps without a bound, approvals, a writer and a reader of one price
    """pragma solidity ^0.8.0;
contract Market@ {
#    uint256 public price;
    address public admin;
    function setPrice(uint256 value) external {
        price = value;
    }
    function buy(uint256 n) external payable {
        payable(msg.sender).transfer(n * price);
    }
    function swapAll(address router, uint256 amount) external {
        uint256 quoted = IRouter(router).getAmountOut(amount);
        IRouter(router).swap(amount, quoted);
    }
    function swapBound(address router, uint256 amount, uint256 minOut) external {
        uint256 quoted = IRouter(router).getAmountOut(amount);
        require(quoted >= minOut);
        IRouter(router).swap(amount, quoted);
    }
    function approveSpender(address spender, uint256 value) external {
        allowance[msg.sender][spender] = value;
    }
}
""",
    # 10: time as a gate of releases, in a modifier, in a view and in an event
    """pragma solidity ^0.8.0;
contract Lock@ {
#    uint256 public start;
    uint256 public end;
    mapping(address => uint256) balances;
    event At(uint256 time);
    modifier inWindow() {
        require(block.timestamp >= start && block.timestamp <= end);
        _;
    }
    function setStart() external {
        start = block.timestamp + 1 days;
    }
    function setEnd() external {
        end = block.timestamp + 9 days;
    }
    function release() external {
        uint256 current = block.timestamp;
        require(current >= end);
        payable(msg.sender).transfer(balances[msg.sender]);
    }
    function claim() external inWindow {
        balances[msg.sender] = 0;
    }
    function remaining() external view returns (uint256) {
        return end - block.timestamp;
    }
    function note() external {
        emit At(block.timestamp);
    }
}
""",
    # 11: comments, strings and braces that mislead plain scans
    """// pragma solidity ^0.4.0; function ghost() public {}
pragma solidity >=0.7.0 <0.9.0; //* not a block
contract Odd@ {
#    string url = "http://x.example/{@}"; /* { a
    block } */ uint256 n;
    string quote = 'it\\'s // no comment';
    function f(
        uint256 a, // first
        bytes32 b
    ) public pure returns (uint256) {
        g(
            a,
            "} ;"
        );
        for (uint i = 0; i < a; i++) { b; }
        return a;
    }
    function g(uint256 a, string memory s) internal pure {}
}
""",
    # 12: callbacks before writes: in the function, in helpers before and after, past a typed view, around balances
    """pragma solidity ^0.8.0;
interface IComptroller@ {
    function isComptroller() external view returns (bool);
}
contract Desk@ {
#    mapping(address => uint256) public balances;
    address comptroller;
    uint256 total;
    function setComptroller(IComptroller@ next) external {
        require(next.isComptroller());
        comptroller = address(next);
    }
    function deposit(uint256 amount) external {
        require(token.transferFrom(msg.sender, address(this), amount));
        balances[msg.sender] += amount;
    }
    function pull(address to, uint256 amount) external {
        token.transfer(to, amount);
        total -= amount;
    }
    function payLater(uint256 amount) external {
        token.safeTransfer(msg.sender, amount);
        _book(amount);
    }
    function _book(uint256 amount) internal {
        total -= amount;
    }
    function trade(address target, uint256 amount) external returns (uint256) {
        (bool ok, ) = target.call{value: amount}("");
        require(ok);
        return token.balanceOf(address(this));
    }
    function settle(address target, uint256 amount) external {
        _push(target, amount);
        total = amount;
    }
    function _push(address target, uint256 amount) internal {
        address payee = target;
        (bool ok, ) = payee.call{value: amount}("");
        require(ok);
    }
    function mintAll(address to) external {
        _safeMint(to, total);
        total += 1;
    }
    function sweep(address to) external {
        token.safeTransferFrom(msg.sender, to, 1);
        vault.deposit(1);
    }
}
""",
    # 13: a library that calls out through a helper; resources that anyone reaches
    """pragma solidity ^0.8.0;
library Sender@ {
#    function push(address to, uint256 n) internal {
        _forward(to, n);
    }
    function _forward(address to, uint256 n) internal {
        (bool ok, ) = to.call{value: n}("");
        require(ok);
    }
    function half(uint256 n) internal pure returns (uint256) {
        return n / 2;
    }
}
contract Router@ {
    uint256 totalSupply;
    uint256 marker;
    mapping(address => uint256) positions;
    function issue(uint256 n) external {
        totalSupply += n;
    }
    function rescue(address to, uint256 n) external {
        asset.transfer(to, n);
    }
    function liquidateFor(address actor, address subject, uint256 n) external {
        positions[subject] -= n;
        perp.liquidate(actor, subject, n);
    }
    function mark(uint256 n) external {
        marker = n;
    }
}
""",
    # 14: the life of orders, and a receipt whose signature never ends
    """pragma solidity ^0.8.0;
contract Book@ {
#    struct Order {
        address maker;
        uint256 expiration;
        uint256 createdAt;
    }
    mapping(uint256 => Order) orders;
    uint256 last;
    function placeOrder(uint256 id, uint256 expiration) external {
        require(expiration > block.timestamp);
        Order storage order = orders[id];
        order.expiration = expiration;
        order.createdAt = block.timestamp;
    }
    function executeOrder(uint256 id) external {
        Order storage order = orders[id];
        require(block.timestamp <= order.expiration);
        order.maker = address(0);
        token.transfer(msg.sender, 1);
        emit Executed(id, block.timestamp);
    }
    function cancelExpired(uint256 id) external {
        Order storage order = orders[id];
        require(order.expiration < block.timestamp);
        _cancelOrder(id);
    }
    function _cancelOrder(uint256 id) internal {
        delete orders[id];
    }
    function fillOrder(Order memory input, uint256 deadline) external {
        last = input.expiration;
    }
    function claimReceipt(bytes32 hash, bytes memory signature) external {
        address signer = recoverSigner(hash, signature);
        last = uint256(uint160(signer));
    }
}
""",
    # 15: a clock behind a getter that a claim depends on
    """pragma solidity ^0.8.0;
contract Vesting@ {
#    mapping(address => uint256) claimed;
    uint256 start;
    uint256 rewardStored;
    uint256 unlockAt;
    function getTime() public view returns (uint256) {
        return block.timestamp;
    }
    function vested(address who) public view returns (uint256) {
        uint256 current = getTime();
        if (current < start) {
            return 0;
        }
        return current - start;
    }
    function claim() external {
        uint256 amount = vested(msg.sender);
        claimed[msg.sender] += amount;
        token.transfer(msg.sender, amount);
    }
    function accrue() external {
        rewardStored = block.timestamp - start;
    }
    function capture() external {
        unlockAt = block.timestamp;
    }
    function join(uint256 amount) external {
        uint256 current = getTime();
        require(block.timestamp < start && current < start);
        require(amount > 1);
    }
}
""",
    # 16: swaps of the whole balance, with no bound and with one that can be set
    """pragma solidity ^0.8.0;
contract Farm@ {
#    uint256 slippage;
    function harvest() external {
        uint256 amount = token.balanceOf(address(this));
        router.swapExactTokens(amount, 0, path);
    }
    function compound() external {
        uint256 amount = token.balanceOf(address(this));
        _sell(amount);
    }
    function _sell(uint256 amount) internal {
        uint256 quoted = router.getAmountsOut(amount);
        router.swapExactTokens(amount, quoted - slippage, path);
        pool.deposit(quoted);
    }
    function redeem(uint256 n) external {
        uint256 out = n * total / oracle.value(n);
        token.transfer(msg.sender, out);
    }
}
""",
    # 17: before 0.8: powers that price orders, times that overflow, products that are returned
    """pragma solidity ^0.5.0;
contract Powers@ {
#    struct Lock {
        uint256 until;
    }
    mapping(address => Lock) locks;
    function _lock(address who, uint256 span) internal {
        locks[who].until = now + span;
    }
    function fill(uint256 base, uint256 n) external {
        uint256 price = safePower(base, n);
        require(price > 0);
        token.transfer(msg.sender, price);
    }
    function cost(uint256 a, uint256 b) external view returns (uint256) {
        uint256 c = a * b;
        return c;
    }
}
""",
)
N = len(TEMPLATES)
#: Columns of the tables made here, as the survey of the data model has them.
MODES = ("full", "four_field", "compact", "candidate_ids")


def _pieces(template: str) -> list[str]:
    return [p for p in re.split("([@#])", template) if p]


def text_column(key: Column, filler: Column, number: Column) -> Column:
    marks = {"@": key.cast("string"), "#": F.repeat(F.lit("    // filler\n"), filler)}
    out = None
    for i, template in enumerate(TEMPLATES):
        text = F.concat(*[marks.get(p, F.lit(p)) for p in _pieces(template)])
        out = F.when(number == i, text) if out is None else out.when(number == i, text)
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _text_sql() -> str:
    marks = {"@": "CAST(p_partkey AS VARCHAR)", "#": "repeat('    // filler\n', CAST(p_size % 5 AS BIGINT))"}
    cases = [f"WHEN {i} THEN concat({', '.join(marks.get(p) or _quoted(p) for p in _pieces(t))})" for i, t in enumerate(TEMPLATES)]
    return f"CASE p_partkey % {N} {' '.join(cases)} END"


#: The same rows in SQL; `t` is the template and `f` the number of filler lines.
SOURCES_SQL = f"sources AS (SELECT p_partkey AS source_id, concat('c/', CAST(p_partkey AS VARCHAR), '.sol') AS path, {_text_sql()} AS text, p_partkey % {N} AS t, p_size % 5 AS f FROM part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, path, text): one source for each part."""
    # a part is a few bytes, its text is not: deal the keys out before the texts are made
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition(n, "p_partkey")
    key = F.col("p_partkey")
    return part.select(
        key.cast("long").alias("source_id"),
        F.concat(F.lit("c/"), key.cast("string"), F.lit(".sol")).alias("path"),
        text_column(key, F.col("p_size") % 5, key % N).alias("text"),
    )


_FINDING = '{"category":"%s","function_name":"f","primary_line":%s,"evidence_lines":[1,2],"reason":"r"}'
#: What a model may answer about a source, by the event's number.
RESPONSES = (
    "",
    " \n ",
    '{"findings":[' + _FINDING % ("reentrancy", "3") + "]}",
    '{"findings":[' + _FINDING % ("reentrancy", "0") + "," + _FINDING % ("gas", "4") + "]}",
    '{"selected_candidate_ids":["@-1","@-9","@-1"]}',
    '{"findings":[]} and more',
    "[1,2]",
    "12.5",
    '{"findings":[',
    '{"x":NaN}',
    '```json\n{"findings":[' + _FINDING % ("arithmetic", "7") + '],"extra":1}\n```',
    '```json\n{"a":1}\n```\n```json\n{"b":2}\n```',
    'Here: ```json\n{"a":1}\n```',
    '\r\n{"findings":[],\r\n"b":{"z":1,"a":[true,null,"é"]}}\r\n',
    '{"identified_risks":[{"risk_type":"reentrancy","function_name":"f","triggering_data_flow":"d","terminal_action_check":"t"}],"root_cause_analysis":"r","primary_vulnerabilities":["reentrancy"],'
    '"findings":[{"vulnerability_type":"reentrancy","function_name":"f","attack_path":"p","temporal_pattern":"t","ast_match_confidence":0.9,"constraint_violation_confidence":1.5,'
    '"constraints":[{"id":"c1","description":"d","expression":"e","must_be":"true","related_line":"7","z3_schema":{"state_variables":[],"pre_conditions":[],"state_transitions":[]},"llm_reasoning":"l"}]}]}',
    "```json\n[1]\n```",
)
_MODE_OF = ("full", "full", "compact", "compact", "candidate_ids", "compact", "full", "full", "compact", "full", "compact", "full", "four_field", "compact", "four_field", "full")


def _response_sql() -> str:
    marks = {"@": "CAST(source_id AS VARCHAR)"}
    cases = [f"WHEN {i} THEN concat({', '.join(marks.get(p) or _quoted(p) for p in re.split('(@)', t) if p) or chr(39) * 2})" for i, t in enumerate(RESPONSES)]
    return f"CASE t {' '.join(cases)} END"


RESPONSES_SQL = f"""responses AS (
  SELECT response_id, source_id, t, CASE t {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODE_OF))} END AS mode, {_response_sql()} AS raw
  FROM (SELECT event_id AS response_id, event_id % 199 + 1 AS source_id, event_id % {len(RESPONSES)} AS t FROM events))"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(response_id, source_id, mode, raw): one archived model response for each event."""
    # as in sources: a file of few row groups would be parsed in as few tasks
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").repartition(n, "event_id")
    source = (F.col("event_id") % 199 + 1).cast("long")
    number = F.col("event_id") % len(RESPONSES)
    raw = mode = None
    for i, (text, m) in enumerate(zip(RESPONSES, _MODE_OF)):
        value = F.concat(*[source.cast("string") if p == "@" else F.lit(p) for p in re.split("(@)", text) if p]) if text else F.lit("")
        raw = F.when(number == i, value) if raw is None else raw.when(number == i, value)
        mode = F.when(number == i, F.lit(m)) if mode is None else mode.when(number == i, F.lit(m))
    return events.select(F.col("event_id").cast("long").alias("response_id"), source.alias("source_id"), mode.alias("mode"), raw.alias("raw"))
