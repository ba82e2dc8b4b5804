"""Patterns and word lists of the rules.

Fixed values: they decide what a rule matches and must stay as they are.
"""

READ_METHODS = ["allowance", "balanceof", "decimals", "factory", "getpair", "getreserves", "hasrole", "latestanswer", "owner", "quote", "supportsinterface", "totalsupply", "weth"]
READ_PREFIXES = "^(?:get|is|has|quote|calc|current|latest)"
CALL_METHODS = ["approve", "burn", "call", "delegatecall", "deposit", "execute", "flashloan", "liquidate", "mint", "repay", "send", "settle", "stake", "staticcall", "swap", "transfer", "transferfrom", "unstake", "withdraw"]
TOKEN_METHODS = ["approve", "transfer", "transferfrom"]
TOKEN_WORDS = "token|asset|gift|reward|coin|currency|collateral|underlying|stable|weth|usdc|usdt|dai"
AUTH_WORDS = r"(?i)\b(?:only|auth|admin|owner|guardian|governance|operator|manager|role|pauser|controller)"
SENSITIVE_WORDS = r"(?i)\b(?:admin|allowance|balance|collateral|controller|credit|debt|delegat|factory|fee|guardian|implementation|initialized?|limit|operator|owner|proxy|registry|reserve|reward|share|stake|supply|token|treasury|validator)\w*\b"
ADMIN_WORDS = r"(?i)\b(?:owner|admin|guardian|controller|factory|implementation|registry|treasury)\b"
ADMIN_SINK_WORDS = r"(?i)\b(?:owner|admin|guardian|controller|factory|registry|treasury|reward|reserve|fee|limit)\b"
ADMIN_NAMES = r"(?i)(?:set|update|change|replace|assign|transfer)(?:owner|admin|guardian|operator|controller|factory|implementation|registry|treasury|fee|limit|reward|reserve)"
SENDER_CHECK = r"(?i)\b(?:require|assert|if)\s*\([^\n;{}]*(?:msg\s*\.\s*sender|hasrole|owner|admin|guardian|operator)[^\n;{}]*\)"
MUTEX_WORDS = r"(?i)\b(?:nonreentrant|reentrancyguard|mutex|locked)\b"
MUTEX_BODY = r"(?i)\b(?:nonreentrant|reentrancyguard|mutex)\b|\b(?:require|assert|if)\s*\([^\n;{}]*(?:_?entered|_?locked|_?status)[^\n;{}]*\)"
STATE_ASSIGN = r"(?:\b[A-Za-z_]\w*(?:\s*\[[^\n\]]+\])+(?:\.[A-Za-z_]\w+)?|\b[A-Za-z_]\w*)\s*(?:=|\+=|-=|\*=|/=|\+\+|--)(?!=)"
MEMBER_ASSIGN = r"\b([A-Za-z_]\w*)\s*(?:\[[^\n\]]+\]\s*)?\.\s*[A-Za-z_]\w+\s*(?:=|\+=|-=|\*=|/=|\+\+|--)(?!=)"
INDEX_ASSIGN = r"\[[^\]]*\]\s*(?:=|\+=|-=)"
NO_WRITE = r"(?i)\b(?:emit|return|require|assert)\b"
LOW_LEVEL = r"(?i)\.\s*(?:call|send|delegatecall|staticcall)\s*(?:\.|\{)?\s*\("
QUALIFIED_CALL = r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*(?:\{[^}\n]*\}\s*)?\("
BARE_CALL = r"(?<![.\w])([A-Za-z_]\w*)\s*\("
ASSET_SINK = r"(?i)\.(?:approve|burn|call|delegatecall|deposit|execute|liquidate|mint|repay|send|settle|stake|swap|transfer|transferfrom|unstake|withdraw)\s*(?:\.|\{)?\s*\("
ASSET_ACTION = r"(?i)\.\s*(?:approve|burn|call|deposit|mint|send|safeTransfer|safeTransferFrom|settle|transfer|transferFrom|withdraw)\s*(?:\{[^}\n]*\}\s*)?\("
SAFE_MINT = r"(?i)(?<![A-Za-z0-9_.])_?safeMint\s*\("
USER_RECEIVER = r"(?i)\b(?:account|beneficiary|msg\s*\.\s*sender|owner|recipient|sender|to|_msgSender)\b"
ORIGIN = r"(?i)\btx\s*\.\s*origin\b"
ORIGIN_IS_SENDER = r"(?i)\bmsg\s*\.\s*sender\s*(?:==|!=)\s*tx\s*\.\s*origin\b|\btx\s*\.\s*origin\s*(?:==|!=)\s*msg\s*\.\s*sender\b"
ORIGIN_CHECK = r"(?i)\b(?:require|assert|if)\s*\([^\n;{}]*tx\s*\.\s*origin"
STATUS_CALL = r"(?i)\.\s*(send|delegatecall|staticcall|call)\b(?:\s*\.\s*value\s*\([^()\r\n]*\)\s*)?(?:\{[^}\r\n]*\}\s*)?\("
CHECKED_NEAR = r"(?i)\b(?:require|assert|if|while|try)\s*\([^\n;{}]*(?:success|result|call|send|delegatecall|staticcall)"
USED_BEFORE = r"(?i)\b(?:assert|emit|if|require|return|revert|try|while)\b|(?:=|,|\(|\[|[+\-*/%&|^<>])\s*$"
CLOCK = r"\bblock\s*\.\s*timestamp\b|\bnow\b"
IDENTITY_CALL = r"(?i)\b(?:hasRole|_checkRole|isAuthorized|isWhitelisted|isAllowed)\s*\("
_SENDER = r"(?:msg\s*\.\s*sender|_msgSender\s*\(\)|tx\s*\.\s*origin)"
_SUBJECT = r"(?:owner|admin|guardian|operator|governance|manager|role|permission|authorized|whitelist|allowlist|members?|admins?|operators?|roles?|(?:new|pending|proposed|next|candidate|queued)[A-Za-z_]\w*)(?:\s*\[[^\]]+\])?"
IDENTITY_CHECK = rf"(?i)\b(?:require|assert|if)\s*\([^;{{}}]*(?:{_SENDER}\s*(?:==|!=)\s*{_SUBJECT}|{_SUBJECT}\s*(?:==|!=)\s*{_SENDER})"
BALANCE_READ = r"(?i)\.\s*balanceOf\s*\("
CALL_RECEIVER = r"(?i)([A-Za-z_]\w*)\s*\.\s*call\s*(?:\{[^}\r\n]*\}\s*)?\("
CALLER_CLOSURE = r"(?i)(?:_store\s*\(\)|\.\s*data\b|\b(?:balance|balances|amount|claim|deposit|fund|refund|reserve|reward|share|state|status|total)\b)[^;]*(?:=|\+=|-=|\*=|/=)(?!=)"
VIEW_METHODS = r"(?:is[A-Z]\w*|supportsInterface|balanceOf|decimals|totalSupply|get[A-Z]\w*|latestVault|pricePerShare|current[A-Z]\w*)"
CALLBACK_METHODS = r"(?i)^(?:swap|addliquidity|removeliquidity|deposit|withdraw|mint|burn|execute|transfer|send|approve|stake|unstake|flash|borrow|repay|call)"
TEMPORAL_FIELD = r"(?i)\b(?:deadline|expiry|expiration|expiresAt|validUntil|validAfter|unlockTime|endTime|startTime|createdAt|updatedAt|timestamp|currentExpiration|last(?:Update|Event|Beat|InflationDecay)|duration(?:Days|Seconds)?|cooldown|epoch(?:Timestamp)?|observationTimestamp|publishTime|withdrawTime)\b"
ORDER_TIME = r"(?i)\b_?(?:expiration|expiry|deadline|expiresAt|validUntil)\b"
ORDER_RECORD = r"(?i)\b(?:storage|memory)\s+[A-Za-z_]\w*\s*=\s*[A-Za-z_]\w*\s*\[[^\]]+\]"
ORDER_ASSET = r"(?i)\b(?:safeTransferFrom|safeTransfer|transferFrom|transfer|_swap|swap|_cancelOrder|_addOpenOrder|_removeOpenOrder|_transferFees)\s*\("
RECOVERS = r"(?i)\b(?:recoverSigner|ecrecover|SignatureChecker|ECDSA)\b"
LIFECYCLE_BOUND = r"(?i)\b(?:deadline|expiry|expiration|validUntil|expiresAt)\b"
TIME_PROVIDER = r"(?i)^(?:get|read|current|fetch|load)?(?:block)?(?:timestamp|time|now)$"
TIME_OR_BLOCK = r"(?i)\b(?:block\s*\.\s*(?:timestamp|number)|now)\b"
TIME_CONDITION = r"(?i)\b(?:if|require|assert)\s*\([^\n{}]*\b(?:block\s*\.\s*timestamp|now|time\w*|timestamp\w*|elapsed\w*|deadline\w*|duration\w*|epoch\w*|start|end)\b"
VESTING_ASSET = r"(?i)\b(?:safeTransferFrom|safeTransfer|transferFrom|transfer|sendValue|mint|burn|withdraw|redeem|claim|release|unlock|deposit|stake|settle|payout|swap)\s*\("
POWER_HELPER = r"(?i)(?<![.\w])(?:[A-Za-z_]\w*\s*\.\s*)?(?:safePower|bpow|pow|power|exp)\s*\("
FINANCIAL = r"(?i)\b(?:reserve|liquidity|invariant|quote|price|amount|value|reward|collateral|share|supply|fee|validator|commitment|calibrat|exchange|pool|balance|swap|allocate|callback|burn|redeem|deposit|withdraw|liquidat|reinvest|harvest|commit|provide|execute)\w*\b"
PRIVILEGED_NAME = r"(?i)^(?:rescue|sweep|recover|salvage|seize|drain|emergency\w*|withdrawall|withdrawtoken|upgrade\w*|set\w*|init(?:ialize)?\w*)$"
ASSET_OPERATION = r"(?i)\.(?:transfer|transferFrom|safeTransfer|safeTransferFrom|sendValue|deposit|withdraw|stake|unstake|swap|execute|settle|liquidate|flashLoan|sendETH|sendEther|withdrawETH|withdrawEther)\s*\("
GLOBAL_WRITE = r"(?i)\b(?:_?totalSupply|owner|admin(?:s)?|governance|guardian|operator|minter|pauser|roles?|permissions?|allow(?:ed|list)|currentModel|stakingRateModel|router|controller|treasury|vault|implementation|initialized|emissionRate|endBlock|startBlock)\b(?:\s*\[[^\]]+\])?\s*(?:=|\+=|-=|\*=|/=|\+\+|--)(?!=)"
CALLER_SCOPED = r"(?i)\b(?:balances?|staked\w*|votingPower|vaults?|troves?|stake\w*|reward\w*|referral\w*|deposit\w*|claim\w*)\s*\[[^\]]*(?:msg\s*\.\s*sender|_msgSender\s*\(\)|caller)\b"
CALLER_REFUND = r"(?i)\bmsg\s*\.\s*sender\s*\.\s*transfer\s*\(\s*msg\s*\.\s*value(?:\s*[-+]\s*[^)\n;]+)?\s*\)"
SUBJECT_ASSET = r"(?i)\b(?:getTrove\w*|getPosition\w*|getCollateral\w*|getDebt\w*|closeTrove|removeStake|applyPendingRewards|sendETH|sendEther|_repay\w*|repay\w*|withdraw\w*|redeem\w*|unstake\w*|safeTransfer(?:From)?|transfer(?:From)?)\s*\([^;{}\n]*\b(?:msg\s*\.\s*sender|_msgSender\s*\(\))"
WORKFLOW_STATE = r"(?i)\b(?:commitments?|nonces?|requests?|orders?|pending\w*|reveals?|reimbursements?|refunds?)\b"
TIME_STATE = r"(?i)\b(?:lastUpdateTimestamp|timeElapsed|stakingRate|stakingRateStored|ratePerSecond|timestamp|epoch|deadline|unlockTime)\b"
RECEIPT_FLOW = r"(?i)\.(?:safeTransferFrom|transferFrom|safeTransfer|transfer)\s*\([^;{}\n]*(?:msg\s*\.\s*sender|_msgSender\s*\(\)|address\s*\(\s*this\s*\))"
OWN_BALANCE = r"(?i)\bbalanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)|\baddress\s*\(\s*this\s*\)\s*\.\s*balance\b"
SWAP_CALL = r"\b(_swapToken|_swap|swapExact[A-Za-z0-9_]*|exactInput(?:Single)?)\s*\("
QUOTE_CALL = r"(?i)\b(?:getAmountsOut|getAmountOut|amountOut|quote|value|balanceOf)\s*\("
SETTLE_SINK = r"(?i)\b(?:swapExact[A-Za-z0-9_]*|swapTokens[A-Za-z0-9_]*|exactInput[A-Za-z0-9_]*|addLiquidity|transfer|safeTransfer|transferFrom|send|call(?:\s*\{[^}]*\})?|delegatecall|mint|_mint|deposit|reinvest|compound|harvest|trade|_update[A-Za-z0-9_]*)\s*\("
RATIO_QUOTE = r"(?i)\b[A-Za-z_]\w*\s*\*[^;\n]{0,180}?/\s*(?:[A-Za-z_]\w*\s*\.\s*)?value\s*\("
ZERO_BOUND = r"(?i)(?:amountOutMinimum|minOut|minShares|minimumShares)\s*[:=]\s*0|,\s*0\s*,"
SLIPPAGE_BOUND = r"(?i)\b(?:slippage|amountOutMinimum|amountOutMin|minOut|minShares)\w*\b"
SIGNED_EXECUTION = r"(?i)\b(?:sign(?:Data|ature)?|verify(?:Sign|Signature)?|signature|callData|timestamp|nonce|expiry|validUntil)\b"
COMPOUND_SETTLEMENT = r"(?i)\b(?:addLiquidity|deposit|_?mint|stake|reinvest|compound|harvest|execute)\s*\("
LABELS = ["access_control", "arithmetic", "front_running", "reentrancy", "time_manipulation", "unchecked_low_level_calls"]
#: Words within a written name that make it an asset, or mere bookkeeping, when writes after a call are ranked.
ASSET_STATE_HINTS = ["allowance", "balance", "claim", "collateral", "debt", "deposit", "liquidity", "owned", "position", "reserve", "reward", "share", "supply", "stake", "staker", "total", "withdraw"]
BOOKKEEPING_STATE_HINTS = ["enabled", "fee", "flag", "lock", "nonce", "paused", "previous", "status", "tax", "timestamp", "cycle", "threshold"]
ALIAS_FIELD = r"(?i)\b(?:user|account|position|deposit|balance|reserve|claim|reward)\w*\s*\."
WRITE_OPERATOR = r"\+=|-=|\*=|/=|(?<![=!<>])=(?!=)|\+\+|--"
#: Modifiers that restrict a function to administrators, and checks in a body that do.
ADMIN_MODIFIERS = ["onlyowner", "owneronly", "only_owner", "only_admin", "onlyadmin", "onlyrole", "onlyminter", "onlypauser", "onlygovernance", "onlystrategy", "onlymanager", "onlyoperator", "onlyguardian", "onlydao", "onlyprotocol", "onlymaintainer", "onlycontroller", "onlydelegate", "onlydev"]
ADMIN_CHECKS = [
    r"(?is)\b(?:require|assert)\s*\([^;{}]*\bmsg\.sender\b[^;{}]*\b(?:owner|admin|governance|timelock|operator|guardian)\b",
    r"(?is)\b(?:require|assert)\s*\([^;{}]*\b(?:owner|admin|governance|timelock|operator|guardian)\b[^;{}]*\bmsg\.sender\b",
    r"(?is)\b(?:require|assert)\s*\([^;{}]*\b_msgSender\s*\(\s*\)[^;{}]*\b(?:owner|admin|governance|timelock|operator|guardian)\b",
    r"(?is)\b(?:require|assert)\s*\([^;{}]*\b(?:owner|admin|governance|timelock|operator|guardian)\b[^;{}]*\b_msgSender\s*\(\s*\)",
    r"(?is)\b(?:require|assert)\s*\([^;{}]*\bhasRole\s*\([^;{}]*\b(?:msg\.sender|_msgSender\s*\(\s*\))",
    r"(?is)\b(?:require|assert)\s*\([^;{}]*\b(?:isAuthorized|isWhitelisted|isAllowed|isOperator|isAdmin|isOwner)\s*\([^;{}]*\b(?:msg\.sender|_msgSender\s*\(\s*\))",
    r"(?is)\b(?:_checkRole|checkRole|requireRole)\s*\([^;{}]*\b(?:msg\.sender|_msgSender\s*\(\s*\))",
    r"(?is)\bif\s*\([^;{}]*!\s*(?:hasRole|isAuthorized|isWhitelisted|isAllowed)\s*\(",
    r"(?is)\bif\s*\([^;{}]*\b(?:msg\.sender|_msgSender\s*\(\))\b[^;{}]*[!=]=?[^;{}]*\b(?:owner|admin|governance|timelock|operator|guardian)\b",
]
YUL_CALL = r"(?i)\b(?:call|staticcall|delegatecall|callcode)\s*\("
YUL_CHECKED = r"(?i)\b(?:if|switch)\b[^\n]*\b(?:iszero|eq|lt|gt)\s*\([^)]*$"
#: Methods of direct effects: those that only read, those of value libraries, those that change what a library holds, those that move assets.
EFFECT_READS = r"(?i)^(?:balanceof|totalsupply|allowance|decimals|symbol|name|supportsinterface|invariant|latest[a-z_]*|get[a-z_]*|is[a-z_]*|quote[a-z_]*|price[a-z_]*|view[a-z_]*)$"
VALUE_LIBRARY_METHODS = ["add", "sub", "mul", "div", "decadd", "decsub", "decmul", "decdiv", "mod", "pow", "min", "max", "abs", "toint", "touint", "touint112", "touint256", "toint256", "encode", "decode", "concat", "push", "pop", "at", "contains", "remove"]
STATE_LIBRARY_METHODS = ["allocate", "deposit", "withdraw", "remove", "swap", "mint", "burn", "settle", "update"]
ASSET_METHODS = ["transfer", "transferfrom", "safetransfer", "safetransferfrom", "sendvalue", "send", "deposit", "withdraw", "stake", "unstake", "swap", "execute", "settle", "liquidate", "flashloan", "sendeth", "sendether", "withdraweth", "withdrawether"]
ECONOMIC_METHODS = ["callexchange", "executeorder", "executeorders", "fillorder", "fillorders", "settleorder", "settleorders", "processorder", "processorders"]
SAFE_TOKEN_METHODS = ["safetransfer", "safetransferfrom", "safeapprove", "safeincreaseallowance", "safedecreaseallowance"]
CALLBACK_NAMES = r"(?i)callback|tokensreceived|on[a-z_]*|executeoperation|flashloan|fallback|receive"
EXTERNAL_ROOTS = r"(?i)^(?:router|pool|pair|token|vault|strategy|oracle|factory|manager|controller|registry|market|bridge|l1|l2|weth|uni|bsc)"
INTERFACE_TYPE = r"^(?:I[A-Z][A-Za-z0-9_]*|[A-Za-z_][A-Za-z0-9_]*(?:Interface|Router|Pool|Manager|Token|Vault))$"
EXTERNAL_EFFECT = r"(?i)\.(?:call|send|delegatecall|staticcall|transfer|transferFrom|approve|burn|mint|safeTransfer|safeTransferFrom|safeApprove|safeIncreaseAllowance|safeDecreaseAllowance|sendValue|functionCall|functionStaticCall|functionDelegateCall|uniTransfer|uniTransferFrom|deposit|withdraw|stake|unstake|stakingRate|swap|execute|settle|liquidate|flashLoan|sendETH|sendEther|withdrawETH|withdrawEther)\s*[.{(]"
BARE_EXTERNAL = r"(?i)(?<![.\w])(safeTransferFrom|safeTransfer|sendValue|functionCallWithValue|functionCall|functionStaticCall|functionDelegateCall)\s*\("
INHERITED_WRITES = r"(?i)^_?(?:burn|mint|transfer|withdraw|deposit|claim|redeem|stake|unstake|approve|set|upgrade|pause|unpause)\w*$|^(?:sync|update|set|record|write|adjust|refresh|checkpoint|apply)[A-Za-z_]\w*$"
CONSTANT_AMOUNT = r"(?i)^(?:0x[0-9a-f]+|\d+)(?:\s+(?:wei|ether|gwei|finney))?$"
MESSAGE_VALUE = r"(?i)\bmsg\s*\.\s*value\b"
AMOUNT_WORDS = r"(?i)\b(?:balance|reserve|amount|value|reward|share|collateral|supply)\w*\b"
#: Methods whose result matters even where the type of the receiver is not known.
RESULT_METHODS = ["approve", "transfer", "transferfrom", "redeem", "withdraw", "withdrawall", "deposit", "harvest", "execute", "swap", "swapexacttokensfortokens", "swapexacttokensforeth", "swapexactethfortokens", "swaptokensforexacttokens", "swaptokensforexacteth", "swapethforexacttokens"]
SAFE_WRAPPERS = r"(?i)\b(?:safeerc20|transferhelper)\b|\.safe(?:transfer|approve|transferfrom|increaseallowance|decreaseallowance)\s*\("
#: What imported interfaces return: types, then methods by what they return; `view` ones only read.
_TOKEN = {"bool": ["transfer", "approve", "transferFrom"], "uint256 view": ["totalSupply", "balanceOf", "allowance"]}
_ROUTER = {"uint256[]": ["swapExactTokensForTokens", "swapExactTokensForETH", "swapExactETHForTokens", "swapTokensForExactTokens", "swapTokensForExactETH", "swapETHForExactTokens"], "uint256[] view": ["getAmountsOut", "getAmountsIn"]}
KNOWN_INTERFACES = {
    "IERC20": _TOKEN, "ERC20": _TOKEN, "IBEP20": _TOKEN,
    "ITimelock": {"bytes32": ["queueTransaction"], "bytes": ["executeTransaction"]},
    "ProjectWallet": {"bool": ["transfer"]},
    "RocketVaultInterface": {"bool": ["depositToken", "withdrawToken", "transferToken"]},
    "UniswapRouterV2": _ROUTER, "IUniswapV2Router": _ROUTER, "IUniswapV2Router02": _ROUTER, "IPancakeRouter02": _ROUTER,
}
#: Asset actions after a callback: methods of others that move assets, words in the names of those that hold them, mints, and calls of casts that may call back.
EXTERNAL_ASSET_METHODS = ["transfer", "transferfrom", "safetransfer", "safetransferfrom", "deposit", "withdraw", "redeem", "mint", "burn", "swap", "exactinput", "exactoutput", "addliquidity", "removeliquidity", "pay", "sendcollaterals", "sendcollateralsunwrap"]
ASSET_HOLDERS = r"^[A-Z]|(?i:token|router|pool|vault|asset|auction|helper)"
MINT_FAMILY = r"(?i)\.\s*(batchMint|safeMint|mint)\s*\("
CAST_CALLBACKS = ["deposit", "withdraw", "redeem", "swap", "exactinput", "exactoutput", "execute", "executeaction", "executeinstruction", "pay", "sendcollaterals", "sendcollateralsunwrap", "flash", "borrow", "repay"]
EMPTY_SWAP = r"(?i)new\s+bytes\s*\(\s*0\s*\)"
SENDER_HOOK = r"(?i)\b_?callTokensToSend\s*\(|\.\s*tokensToSend\s*\("
RECEIVER_HOOK = r"(?i)\b(?:tokensReceived|onERC777Received)\s*\("
ORIGIN_CALL = r"(?i)\btx\s*\.\s*origin\s*\.\s*call\b"
SETUP_NAMES = r"(?i)init|setup|configure|setowner|changeowner"
OWNER_STATE = r"(?i)owner|admin|wallet|authority|master"
#: Names and texts by which the rules on paths tell deposits, payouts, receipts and the uses of time.
DEPOSIT_NAMES = r"(?i)^(?:deposit|redeem)(?:withtransfer|for|from)?$"
PAYOUT_NAMES = r"(?i)claim|unstake|withdraw"
TRANSFER_METHOD = r"(?i)\.\s*(safeTransferFrom|safeTransfer|transferFrom|transfer|send)\s*\("
TRANSFER_ARGUMENTS = r"(?i)\.\s*(?:safeTransferFrom|safeTransfer|transferFrom|transfer|send)\s*\((.*)$"
FROM_SENDER = r"(?i)\b(?:msg\.sender|sender)\b"
TO_ITSELF = r"(?i)\b(?:address\s*\(\s*this\s*\)|this)"
USER_POSITION = r"(?i)\[\s*(?:msg\.sender|sender|account|recipient|beneficiary)\s*\]|\b(?:user|account|position|deposit|stake|balance|reserve|claim|reward|share)\w*\s*\.\s*[A-Za-z_]\w*"
REDEEMED_STATE = r"(?i)\b(?:grant|amountredeemed|tokenid|vesting)\b"
CHECKED_TRANSFER = r"(?i)\brequire\s*\(|\b(?:success|ok|sent)\s*="
TO_USER = r"(?i)\b(?:msg\.sender|account|recipient|sender|beneficiary)\b"
RECEIPT_SOURCE = r"(?i)\b(?:createQuest|quest|receipt)\b|(?i)\b\w*receipt\b"
END_WORDS = r"(?i)\b(?:endTime|deadline|expiry|expiration)\b"
RECEIPT_NAMES = r"(?i)mint|receipt|claim|fulfill|redeem"
CREATION_TIME = r"(?i)\b(?:createdAt|created|openedAt|startTime)\b\s*=\s*(?:block\.timestamp|now)\b"
TIME_ELIGIBLE = r"(?i)\b(?:contribution|cap|limit|amount|msg\s*\.\s*value|balance|quota)\w*\b"
TIME_RELEVANT = r"(?i)\b(?:checkpoint|reward|stake|order|expiration|deadline)\w*\b"
TIME_CAPTURE = r"(?i)\b(?:unlock|expiry|expiration|release|maturity|start|end)\w*\b\s*="
