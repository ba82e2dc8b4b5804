"""Rows of the audit queries for each template (its number first), read against the templates; lines are those without filler.

Column kinds: s text (@ stands for the key), S texts, l line, L lines, i number, d double, b boolean.
"""

# fmt: off
EXPECTED = {
    'tx3_pragma_versions': ('major:i minor:i legacy:b', [
        (0, 0, 8, False),
        (1, 0, 8, False),
        (10, 0, 8, False),
        (11, 0, 7, False),
        (12, 0, 8, False),
        (13, 0, 8, False),
        (14, 0, 8, False),
        (15, 0, 8, False),
        (16, 0, 8, False),
        (17, 0, 5, False),
        (2, 0, 8, False),
        (3, 0, 8, False),
        (4, 0, 6, False),
        (5, 0, 8, False),
        (6, 0, 8, False),
        (7, 0, 8, False),
        (8, 0, 4, True),
        (9, 0, 8, False),
    ]),
    'tx5_contracts': ('contract:s kind:s bases:S start_line:l end_line:l', [
        (0, 'Vault@', 'contract', [], 2, 29),
        (1, 'Chain@', 'contract', [], 2, 27),
        (10, 'Lock@', 'contract', [], 2, 31),
        (11, 'Odd@', 'contract', [], 3, 19),
        (12, 'Desk@', 'contract', [], 5, 50),
        (12, 'IComptroller@', 'interface', [], 2, 4),
        (13, 'Router@', 'contract', [], 14, 31),
        (13, 'Sender@', 'library', [], 2, 13),
        (14, 'Book@', 'contract', [], 2, 38),
        (15, 'Vesting@', 'contract', [], 2, 33),
        (16, 'Farm@', 'contract', [], 2, 21),
        (17, 'Powers@', 'contract', [], 2, 19),
        (2, 'Base@', 'contract', [], 2, 7),
        (2, 'IRegistry@', 'interface', [], 8, 10),
        (2, 'Shop@', 'contract', ['Base@', 'Pausable'], 11, 18),
        (3, 'Admin@', 'contract', [], 2, 37),
        (4, 'Origin@', 'contract', [], 2, 25),
        (5, 'Caller@', 'contract', [], 2, 26),
        (6, 'IBase@', 'interface', [], 2, 4),
        (6, 'IToken@', 'interface', ['IBase@'], 5, 7),
        (6, 'Payer@', 'contract', [], 8, 25),
        (7, 'Assembler@', 'contract', [], 2, 15),
        (8, 'Sums@', 'contract', [], 2, 22),
        (9, 'Market@', 'contract', [], 2, 23),
    ]),
    'tx6_functions': ('contract:s fn:s start_line:l end_line:l visibility:s mutability:s modifiers:S is_constructor:b is_fallback:b is_receive:b', [
        (0, 'Vault@', 'deposit', 11, 13, 'external', 'payable', [], False, False, False),
        (0, 'Vault@', 'guarded', 19, 23, 'external', '', ['nonReentrant'], False, False, False),
        (0, 'Vault@', 'orderly', 24, 28, 'external', '', [], False, False, False),
        (0, 'Vault@', 'withdraw', 14, 18, 'external', '', [], False, False, False),
        (1, 'Chain@', 'claim', 4, 7, 'public', '', [], False, False, False),
        (1, 'Chain@', 'lost', 24, 26, 'private', '', [], False, False, False),
        (1, 'Chain@', 'pay', 11, 14, 'internal', '', [], False, False, False),
        (1, 'Chain@', 'ping', 15, 17, 'public', '', [], False, False, False),
        (1, 'Chain@', 'ping2', 21, 23, 'internal', '', [], False, False, False),
        (1, 'Chain@', 'pong', 18, 20, 'internal', '', [], False, False, False),
        (1, 'Chain@', 'relay', 8, 10, 'internal', '', [], False, False, False),
        (10, 'Lock@', 'claim', 22, 24, 'external', '', ['inWindow'], False, False, False),
        (10, 'Lock@', 'note', 28, 30, 'external', '', [], False, False, False),
        (10, 'Lock@', 'release', 17, 21, 'external', '', [], False, False, False),
        (10, 'Lock@', 'remaining', 25, 27, 'external', 'view', [], False, False, False),
        (10, 'Lock@', 'setEnd', 14, 16, 'external', '', [], False, False, False),
        (10, 'Lock@', 'setStart', 11, 13, 'external', '', [], False, False, False),
        (11, 'Odd@', 'f', 7, 17, 'public', 'pure', [], False, False, False),
        (11, 'Odd@', 'g', 18, 18, 'internal', 'pure', [], False, False, False),
        (12, 'Desk@', '_book', 25, 27, 'internal', '', [], False, False, False),
        (12, 'Desk@', '_push', 37, 41, 'internal', '', [], False, False, False),
        (12, 'Desk@', 'deposit', 13, 16, 'external', '', [], False, False, False),
        (12, 'Desk@', 'mintAll', 42, 45, 'external', '', [], False, False, False),
        (12, 'Desk@', 'payLater', 21, 24, 'external', '', [], False, False, False),
        (12, 'Desk@', 'pull', 17, 20, 'external', '', [], False, False, False),
        (12, 'Desk@', 'setComptroller', 9, 12, 'external', '', [], False, False, False),
        (12, 'Desk@', 'settle', 33, 36, 'external', '', [], False, False, False),
        (12, 'Desk@', 'sweep', 46, 49, 'external', '', [], False, False, False),
        (12, 'Desk@', 'trade', 28, 32, 'external', '', [], False, False, False),
        (13, 'Router@', 'issue', 18, 20, 'external', '', [], False, False, False),
        (13, 'Router@', 'liquidateFor', 24, 27, 'external', '', [], False, False, False),
        (13, 'Router@', 'mark', 28, 30, 'external', '', [], False, False, False),
        (13, 'Router@', 'rescue', 21, 23, 'external', '', [], False, False, False),
        (13, 'Sender@', '_forward', 6, 9, 'internal', '', [], False, False, False),
        (13, 'Sender@', 'half', 10, 12, 'internal', 'pure', [], False, False, False),
        (13, 'Sender@', 'push', 3, 5, 'internal', '', [], False, False, False),
        (14, 'Book@', '_cancelOrder', 28, 30, 'internal', '', [], False, False, False),
        (14, 'Book@', 'cancelExpired', 23, 27, 'external', '', [], False, False, False),
        (14, 'Book@', 'claimReceipt', 34, 37, 'external', '', [], False, False, False),
        (14, 'Book@', 'executeOrder', 16, 22, 'external', '', [], False, False, False),
        (14, 'Book@', 'fillOrder', 31, 33, 'external', '', [], False, False, False),
        (14, 'Book@', 'placeOrder', 10, 15, 'external', '', [], False, False, False),
        (15, 'Vesting@', 'accrue', 22, 24, 'external', '', [], False, False, False),
        (15, 'Vesting@', 'capture', 25, 27, 'external', '', [], False, False, False),
        (15, 'Vesting@', 'claim', 17, 21, 'external', '', [], False, False, False),
        (15, 'Vesting@', 'getTime', 7, 9, 'public', 'view', [], False, False, False),
        (15, 'Vesting@', 'join', 28, 32, 'external', '', [], False, False, False),
        (15, 'Vesting@', 'vested', 10, 16, 'public', 'view', [], False, False, False),
        (16, 'Farm@', '_sell', 12, 16, 'internal', '', [], False, False, False),
        (16, 'Farm@', 'compound', 8, 11, 'external', '', [], False, False, False),
        (16, 'Farm@', 'harvest', 4, 7, 'external', '', [], False, False, False),
        (16, 'Farm@', 'redeem', 17, 20, 'external', '', [], False, False, False),
        (17, 'Powers@', '_lock', 7, 9, 'internal', '', [], False, False, False),
        (17, 'Powers@', 'cost', 15, 18, 'external', 'view', [], False, False, False),
        (17, 'Powers@', 'fill', 10, 14, 'external', '', [], False, False, False),
        (2, 'Base@', '_grant', 4, 6, 'internal', '', [], False, False, False),
        (2, 'Shop@', '_grant', 15, 17, 'internal', '', [], False, False, False),
        (2, 'Shop@', 'buy', 12, 14, 'external', '', [], False, False, False),
        (3, 'Admin@', '_apply', 34, 36, 'internal', '', [], False, False, False),
        (3, 'Admin@', 'adjust', 31, 33, 'external', '', [], False, False, False),
        (3, 'Admin@', 'constructor', 12, 14, '', '', [], True, False, False),
        (3, 'Admin@', 'initialize', 15, 17, 'external', '', [], False, False, False),
        (3, 'Admin@', 'setFee', 18, 20, 'external', '', ['onlyOwner'], False, False, False),
        (3, 'Admin@', 'setFeeChecked', 27, 30, 'external', '', [], False, False, False),
        (3, 'Admin@', 'setFeeLoose', 24, 26, 'external', '', ['onlyAnyone'], False, False, False),
        (3, 'Admin@', 'setOwner', 21, 23, 'public', '', [], False, False, False),
        (4, 'Origin@', 'join', 16, 18, 'external', '', ['noContracts'], False, False, False),
        (4, 'Origin@', 'remember', 19, 21, 'external', '', [], False, False, False),
        (4, 'Origin@', 'setTreasury', 13, 15, 'external', '', ['fromOwner'], False, False, False),
        (4, 'Origin@', 'sweep', 22, 24, 'external', '', [], False, False, False),
        (5, 'Caller@', 'branched', 13, 18, 'external', '', [], False, False, False),
        (5, 'Caller@', 'dropped', 4, 6, 'external', '', [], False, False, False),
        (5, 'Caller@', 'emitted', 22, 25, 'external', '', [], False, False, False),
        (5, 'Caller@', 'required', 10, 12, 'external', '', [], False, False, False),
        (5, 'Caller@', 'returned', 19, 21, 'external', '', [], False, False, False),
        (5, 'Caller@', 'unused', 7, 9, 'external', '', [], False, False, False),
        (6, 'Payer@', 'kept', 13, 15, 'external', '', [], False, False, False),
        (6, 'Payer@', 'loose', 10, 12, 'external', '', [], False, False, False),
        (6, 'Payer@', 'peek', 22, 24, 'external', 'view', [], False, False, False),
        (6, 'Payer@', 'strict', 16, 21, 'external', '', [], False, False, False),
        (7, 'Assembler@', 'blind', 3, 7, 'external', '', [], False, False, False),
        (7, 'Assembler@', 'seen', 8, 14, 'external', '', [], False, False, False),
        (8, 'Sums@', 'Sums@', 5, 7, 'public', '', [], True, False, False),
        (8, 'Sums@', 'mint', 8, 11, 'public', '', [], False, False, False),
        (8, 'Sums@', 'move', 12, 17, 'public', '', [], False, False, False),
        (8, 'Sums@', 'scale', 18, 21, 'public', 'view', [], False, False, False),
        (9, 'Market@', 'approveSpender', 20, 22, 'external', '', [], False, False, False),
        (9, 'Market@', 'buy', 8, 10, 'external', 'payable', [], False, False, False),
        (9, 'Market@', 'setPrice', 5, 7, 'external', '', [], False, False, False),
        (9, 'Market@', 'swapAll', 11, 14, 'external', '', [], False, False, False),
        (9, 'Market@', 'swapBound', 15, 19, 'external', '', [], False, False, False),
    ]),
    'tx7_parameters': ('contract:s fn:s start_line:l place:i type:s name:s bits:i', [
        (0, 'Vault@', 'guarded', 19, 0, 'uint256', 'amount', 256),
        (0, 'Vault@', 'orderly', 24, 0, 'uint256', 'amount', 256),
        (0, 'Vault@', 'withdraw', 14, 0, 'uint256', 'amount', 256),
        (1, 'Chain@', 'claim', 4, 0, 'uint256', 'amount', 256),
        (1, 'Chain@', 'lost', 24, 0, 'uint256', 'n', 256),
        (1, 'Chain@', 'pay', 11, 0, 'uint256', 'amount', 256),
        (1, 'Chain@', 'ping', 15, 0, 'uint256', 'n', 256),
        (1, 'Chain@', 'ping2', 21, 0, 'uint256', 'n', 256),
        (1, 'Chain@', 'pong', 18, 0, 'uint256', 'n', 256),
        (1, 'Chain@', 'relay', 8, 0, 'uint256', 'amount', 256),
        (11, 'Odd@', 'f', 7, 0, 'uint256', 'a', 256),
        (11, 'Odd@', 'f', 7, 1, 'bytes32', 'b', 256),
        (11, 'Odd@', 'g', 18, 0, 'uint256', 'a', 256),
        (11, 'Odd@', 'g', 18, 1, 'string', 's', None),
        (12, 'Desk@', '_book', 25, 0, 'uint256', 'amount', 256),
        (12, 'Desk@', '_push', 37, 0, 'address', 'target', None),
        (12, 'Desk@', '_push', 37, 1, 'uint256', 'amount', 256),
        (12, 'Desk@', 'deposit', 13, 0, 'uint256', 'amount', 256),
        (12, 'Desk@', 'mintAll', 42, 0, 'address', 'to', None),
        (12, 'Desk@', 'payLater', 21, 0, 'uint256', 'amount', 256),
        (12, 'Desk@', 'pull', 17, 0, 'address', 'to', None),
        (12, 'Desk@', 'pull', 17, 1, 'uint256', 'amount', 256),
        (12, 'Desk@', 'setComptroller', 9, 0, 'IComptroller@', 'next', None),
        (12, 'Desk@', 'settle', 33, 0, 'address', 'target', None),
        (12, 'Desk@', 'settle', 33, 1, 'uint256', 'amount', 256),
        (12, 'Desk@', 'sweep', 46, 0, 'address', 'to', None),
        (12, 'Desk@', 'trade', 28, 0, 'address', 'target', None),
        (12, 'Desk@', 'trade', 28, 1, 'uint256', 'amount', 256),
        (13, 'Router@', 'issue', 18, 0, 'uint256', 'n', 256),
        (13, 'Router@', 'liquidateFor', 24, 0, 'address', 'actor', None),
        (13, 'Router@', 'liquidateFor', 24, 1, 'address', 'subject', None),
        (13, 'Router@', 'liquidateFor', 24, 2, 'uint256', 'n', 256),
        (13, 'Router@', 'mark', 28, 0, 'uint256', 'n', 256),
        (13, 'Router@', 'rescue', 21, 0, 'address', 'to', None),
        (13, 'Router@', 'rescue', 21, 1, 'uint256', 'n', 256),
        (13, 'Sender@', '_forward', 6, 0, 'address', 'to', None),
        (13, 'Sender@', '_forward', 6, 1, 'uint256', 'n', 256),
        (13, 'Sender@', 'half', 10, 0, 'uint256', 'n', 256),
        (13, 'Sender@', 'push', 3, 0, 'address', 'to', None),
        (13, 'Sender@', 'push', 3, 1, 'uint256', 'n', 256),
        (14, 'Book@', '_cancelOrder', 28, 0, 'uint256', 'id', 256),
        (14, 'Book@', 'cancelExpired', 23, 0, 'uint256', 'id', 256),
        (14, 'Book@', 'claimReceipt', 34, 0, 'bytes32', 'hash', 256),
        (14, 'Book@', 'claimReceipt', 34, 1, 'bytes', 'signature', None),
        (14, 'Book@', 'executeOrder', 16, 0, 'uint256', 'id', 256),
        (14, 'Book@', 'fillOrder', 31, 0, 'Order', 'input', None),
        (14, 'Book@', 'fillOrder', 31, 1, 'uint256', 'deadline', 256),
        (14, 'Book@', 'placeOrder', 10, 0, 'uint256', 'id', 256),
        (14, 'Book@', 'placeOrder', 10, 1, 'uint256', 'expiration', 256),
        (15, 'Vesting@', 'join', 28, 0, 'uint256', 'amount', 256),
        (15, 'Vesting@', 'vested', 10, 0, 'address', 'who', None),
        (16, 'Farm@', '_sell', 12, 0, 'uint256', 'amount', 256),
        (16, 'Farm@', 'redeem', 17, 0, 'uint256', 'n', 256),
        (17, 'Powers@', '_lock', 7, 0, 'address', 'who', None),
        (17, 'Powers@', '_lock', 7, 1, 'uint256', 'span', 256),
        (17, 'Powers@', 'cost', 15, 0, 'uint256', 'a', 256),
        (17, 'Powers@', 'cost', 15, 1, 'uint256', 'b', 256),
        (17, 'Powers@', 'fill', 10, 0, 'uint256', 'base', 256),
        (17, 'Powers@', 'fill', 10, 1, 'uint256', 'n', 256),
        (2, 'Base@', '_grant', 4, 0, 'address', 'to', None),
        (2, 'Base@', '_grant', 4, 1, 'uint256', 'n', 256),
        (2, 'Shop@', '_grant', 15, 0, 'address', 'to', None),
        (2, 'Shop@', '_grant', 15, 1, 'uint256', 'n', 256),
        (2, 'Shop@', 'buy', 12, 0, 'uint256', 'n', 256),
        (3, 'Admin@', '_apply', 34, 0, 'uint256', 'value', 256),
        (3, 'Admin@', 'adjust', 31, 0, 'uint256', 'value', 256),
        (3, 'Admin@', 'initialize', 15, 0, 'address', 'first', None),
        (3, 'Admin@', 'setFee', 18, 0, 'uint256', 'value', 256),
        (3, 'Admin@', 'setFeeChecked', 27, 0, 'uint256', 'value', 256),
        (3, 'Admin@', 'setFeeLoose', 24, 0, 'uint256', 'value', 256),
        (3, 'Admin@', 'setOwner', 21, 0, 'address', 'next', None),
        (4, 'Origin@', 'setTreasury', 13, 0, 'address', 'next', None),
        (4, 'Origin@', 'sweep', 22, 0, 'address', 'token', None),
        (5, 'Caller@', 'branched', 13, 0, 'address', 'to', None),
        (5, 'Caller@', 'dropped', 4, 0, 'address', 'to', None),
        (5, 'Caller@', 'emitted', 22, 0, 'address', 'to', None),
        (5, 'Caller@', 'required', 10, 0, 'address', 'to', None),
        (5, 'Caller@', 'returned', 19, 0, 'address', 'to', None),
        (5, 'Caller@', 'unused', 7, 0, 'address', 'to', None),
        (6, 'Payer@', 'kept', 13, 0, 'address', 'to', None),
        (6, 'Payer@', 'kept', 13, 1, 'uint256', 'n', 256),
        (6, 'Payer@', 'loose', 10, 0, 'address', 'to', None),
        (6, 'Payer@', 'loose', 10, 1, 'uint256', 'n', 256),
        (6, 'Payer@', 'peek', 22, 0, 'address', 'who', None),
        (6, 'Payer@', 'strict', 16, 0, 'address', 'to', None),
        (6, 'Payer@', 'strict', 16, 1, 'uint256', 'n', 256),
        (7, 'Assembler@', 'blind', 3, 0, 'address', 'to', None),
        (7, 'Assembler@', 'seen', 8, 0, 'address', 'to', None),
        (8, 'Sums@', 'mint', 8, 0, 'address', 'to', None),
        (8, 'Sums@', 'mint', 8, 1, 'uint256', 'amount', 256),
        (8, 'Sums@', 'move', 12, 0, 'address', 'to', None),
        (8, 'Sums@', 'move', 12, 1, 'uint256', 'amount', 256),
        (8, 'Sums@', 'scale', 18, 0, 'uint256', 'a', 256),
        (8, 'Sums@', 'scale', 18, 1, 'uint256', 'b', 256),
        (9, 'Market@', 'approveSpender', 20, 0, 'address', 'spender', None),
        (9, 'Market@', 'approveSpender', 20, 1, 'uint256', 'value', 256),
        (9, 'Market@', 'buy', 8, 0, 'uint256', 'n', 256),
        (9, 'Market@', 'setPrice', 5, 0, 'uint256', 'value', 256),
        (9, 'Market@', 'swapAll', 11, 0, 'address', 'router', None),
        (9, 'Market@', 'swapAll', 11, 1, 'uint256', 'amount', 256),
        (9, 'Market@', 'swapBound', 15, 0, 'address', 'router', None),
        (9, 'Market@', 'swapBound', 15, 1, 'uint256', 'amount', 256),
        (9, 'Market@', 'swapBound', 15, 2, 'uint256', 'minOut', 256),
    ]),
    'tx8_modifiers': ('contract:s modifier:s start_line:l end_line:l', [
        (0, 'Vault@', 'nonReentrant', 5, 10),
        (10, 'Lock@', 'inWindow', 7, 10),
        (3, 'Admin@', 'onlyAnyone', 9, 11),
        (3, 'Admin@', 'onlyOwner', 5, 8),
        (4, 'Origin@', 'fromOwner', 5, 8),
        (4, 'Origin@', 'noContracts', 9, 12),
    ]),
    'tx9_state_variables': ('contract:s name:s type:s is_mapping:b is_address:b line:l', [
        (0, 'Vault@', 'balances', 'mapping(address => uint256)', True, False, 3),
        (0, 'Vault@', 'locked', 'bool', False, False, 4),
        (1, 'Chain@', 'credit', 'mapping(address => uint256)', True, False, 3),
        (10, 'Lock@', 'balances', 'mapping(address => uint256)', True, False, 5),
        (10, 'Lock@', 'end', 'uint256', False, False, 4),
        (10, 'Lock@', 'start', 'uint256', False, False, 3),
        (11, 'Odd@', 'n', 'uint256', False, False, 5),
        (11, 'Odd@', 'quote', 'string', False, False, 6),
        (11, 'Odd@', 'url', 'string', False, False, 4),
        (12, 'Desk@', 'balances', 'mapping(address => uint256)', True, False, 6),
        (12, 'Desk@', 'comptroller', 'address', False, True, 7),
        (12, 'Desk@', 'total', 'uint256', False, False, 8),
        (13, 'Router@', 'marker', 'uint256', False, False, 16),
        (13, 'Router@', 'positions', 'mapping(address => uint256)', True, False, 17),
        (13, 'Router@', 'totalSupply', 'uint256', False, False, 15),
        (14, 'Book@', 'last', 'uint256', False, False, 9),
        (14, 'Book@', 'orders', 'mapping(uint256 => Order)', True, False, 8),
        (15, 'Vesting@', 'claimed', 'mapping(address => uint256)', True, False, 3),
        (15, 'Vesting@', 'rewardStored', 'uint256', False, False, 5),
        (15, 'Vesting@', 'start', 'uint256', False, False, 4),
        (15, 'Vesting@', 'unlockAt', 'uint256', False, False, 6),
        (16, 'Farm@', 'slippage', 'uint256', False, False, 3),
        (17, 'Powers@', 'locks', 'mapping(address => Lock)', True, False, 6),
        (2, 'Base@', 'shares', 'mapping(address => uint256)', True, False, 3),
        (3, 'Admin@', 'fee', 'uint256', False, False, 4),
        (3, 'Admin@', 'owner', 'address', False, True, 3),
        (4, 'Origin@', 'owner', 'address', False, True, 3),
        (4, 'Origin@', 'treasury', 'address', False, True, 4),
        (6, 'Payer@', 'token', 'IToken@', False, False, 9),
        (8, 'Sums@', 'balances', 'mapping(address => uint256)', True, False, 3),
        (8, 'Sums@', 'supply', 'uint256', False, False, 4),
        (9, 'Market@', 'admin', 'address', False, True, 4),
        (9, 'Market@', 'price', 'uint256', False, False, 3),
    ]),
    'tx10_statements': ('contract:s fn:s fn_start:l is_modifier:b stmt_no:i start_line:l end_line:l text:s', [
        (0, 'Vault@', 'deposit', 11, False, 1, 12, 12, 'balances[msg.sender] += msg.value;'),
        (0, 'Vault@', 'guarded', 19, False, 1, 20, 20, '(bool ok, ) = msg.sender.call{value: amount}("");'),
        (0, 'Vault@', 'guarded', 19, False, 2, 21, 21, 'require(ok);'),
        (0, 'Vault@', 'guarded', 19, False, 3, 22, 22, 'balances[msg.sender] -= amount;'),
        (0, 'Vault@', 'nonReentrant', 5, True, 1, 6, 6, 'require(!locked);'),
        (0, 'Vault@', 'nonReentrant', 5, True, 2, 7, 7, 'locked = true;'),
        (0, 'Vault@', 'nonReentrant', 5, True, 3, 8, 8, '_;'),
        (0, 'Vault@', 'nonReentrant', 5, True, 4, 9, 9, 'locked = false;'),
        (0, 'Vault@', 'orderly', 24, False, 1, 25, 25, 'balances[msg.sender] -= amount;'),
        (0, 'Vault@', 'orderly', 24, False, 2, 26, 26, '(bool ok, ) = msg.sender.call{value: amount}("");'),
        (0, 'Vault@', 'orderly', 24, False, 3, 27, 27, 'require(ok);'),
        (0, 'Vault@', 'withdraw', 14, False, 1, 15, 15, '(bool ok, ) = msg.sender.call{value: amount}("");'),
        (0, 'Vault@', 'withdraw', 14, False, 2, 16, 16, 'require(ok);'),
        (0, 'Vault@', 'withdraw', 14, False, 3, 17, 17, 'balances[msg.sender] -= amount;'),
        (1, 'Chain@', 'claim', 4, False, 1, 5, 5, 'relay(amount);'),
        (1, 'Chain@', 'claim', 4, False, 2, 6, 6, 'credit[msg.sender] = 0;'),
        (1, 'Chain@', 'lost', 24, False, 1, 25, 25, 'credit[msg.sender] = n;'),
        (1, 'Chain@', 'pay', 11, False, 1, 12, 12, '(bool ok, ) = msg.sender.call{value: amount}("");'),
        (1, 'Chain@', 'pay', 11, False, 2, 13, 13, 'require(ok);'),
        (1, 'Chain@', 'ping', 15, False, 1, 16, 16, 'pong(n);'),
        (1, 'Chain@', 'ping2', 21, False, 1, 22, 22, 'pong(n);'),
        (1, 'Chain@', 'pong', 18, False, 1, 19, 19, 'ping2(n);'),
        (1, 'Chain@', 'relay', 8, False, 1, 9, 9, 'pay(amount);'),
        (10, 'Lock@', 'claim', 22, False, 1, 23, 23, 'balances[msg.sender] = 0;'),
        (10, 'Lock@', 'inWindow', 7, True, 1, 8, 8, 'require(block.timestamp >= start && block.timestamp <= end);'),
        (10, 'Lock@', 'inWindow', 7, True, 2, 9, 9, '_;'),
        (10, 'Lock@', 'note', 28, False, 1, 29, 29, 'emit At(block.timestamp);'),
        (10, 'Lock@', 'release', 17, False, 1, 18, 18, 'uint256 current = block.timestamp;'),
        (10, 'Lock@', 'release', 17, False, 2, 19, 19, 'require(current >= end);'),
        (10, 'Lock@', 'release', 17, False, 3, 20, 20, 'payable(msg.sender).transfer(balances[msg.sender]);'),
        (10, 'Lock@', 'remaining', 25, False, 1, 26, 26, 'return end - block.timestamp;'),
        (10, 'Lock@', 'setEnd', 14, False, 1, 15, 15, 'end = block.timestamp + 9 days;'),
        (10, 'Lock@', 'setStart', 11, False, 1, 12, 12, 'start = block.timestamp + 1 days;'),
        (11, 'Odd@', 'f', 7, False, 1, 11, 14, 'g(\n            a,\n            "   "\n        );'),
        (11, 'Odd@', 'f', 7, False, 2, 15, 15, 'for (uint i = 0; i < a; i++) {'),
        (11, 'Odd@', 'f', 7, False, 3, 15, 15, 'b;'),
        (11, 'Odd@', 'f', 7, False, 4, 16, 16, 'return a;'),
        (12, 'Desk@', '_book', 25, False, 1, 26, 26, 'total -= amount;'),
        (12, 'Desk@', '_push', 37, False, 1, 38, 38, 'address payee = target;'),
        (12, 'Desk@', '_push', 37, False, 2, 39, 39, '(bool ok, ) = payee.call{value: amount}("");'),
        (12, 'Desk@', '_push', 37, False, 3, 40, 40, 'require(ok);'),
        (12, 'Desk@', 'deposit', 13, False, 1, 14, 14, 'require(token.transferFrom(msg.sender, address(this), amount));'),
        (12, 'Desk@', 'deposit', 13, False, 2, 15, 15, 'balances[msg.sender] += amount;'),
        (12, 'Desk@', 'mintAll', 42, False, 1, 43, 43, '_safeMint(to, total);'),
        (12, 'Desk@', 'mintAll', 42, False, 2, 44, 44, 'total += 1;'),
        (12, 'Desk@', 'payLater', 21, False, 1, 22, 22, 'token.safeTransfer(msg.sender, amount);'),
        (12, 'Desk@', 'payLater', 21, False, 2, 23, 23, '_book(amount);'),
        (12, 'Desk@', 'pull', 17, False, 1, 18, 18, 'token.transfer(to, amount);'),
        (12, 'Desk@', 'pull', 17, False, 2, 19, 19, 'total -= amount;'),
        (12, 'Desk@', 'setComptroller', 9, False, 1, 10, 10, 'require(next.isComptroller());'),
        (12, 'Desk@', 'setComptroller', 9, False, 2, 11, 11, 'comptroller = address(next);'),
        (12, 'Desk@', 'settle', 33, False, 1, 34, 34, '_push(target, amount);'),
        (12, 'Desk@', 'settle', 33, False, 2, 35, 35, 'total = amount;'),
        (12, 'Desk@', 'sweep', 46, False, 1, 47, 47, 'token.safeTransferFrom(msg.sender, to, 1);'),
        (12, 'Desk@', 'sweep', 46, False, 2, 48, 48, 'vault.deposit(1);'),
        (12, 'Desk@', 'trade', 28, False, 1, 29, 29, '(bool ok, ) = target.call{value: amount}("");'),
        (12, 'Desk@', 'trade', 28, False, 2, 30, 30, 'require(ok);'),
        (12, 'Desk@', 'trade', 28, False, 3, 31, 31, 'return token.balanceOf(address(this));'),
        (13, 'Router@', 'issue', 18, False, 1, 19, 19, 'totalSupply += n;'),
        (13, 'Router@', 'liquidateFor', 24, False, 1, 25, 25, 'positions[subject] -= n;'),
        (13, 'Router@', 'liquidateFor', 24, False, 2, 26, 26, 'perp.liquidate(actor, subject, n);'),
        (13, 'Router@', 'mark', 28, False, 1, 29, 29, 'marker = n;'),
        (13, 'Router@', 'rescue', 21, False, 1, 22, 22, 'asset.transfer(to, n);'),
        (13, 'Sender@', '_forward', 6, False, 1, 7, 7, '(bool ok, ) = to.call{value: n}("");'),
        (13, 'Sender@', '_forward', 6, False, 2, 8, 8, 'require(ok);'),
        (13, 'Sender@', 'half', 10, False, 1, 11, 11, 'return n / 2;'),
        (13, 'Sender@', 'push', 3, False, 1, 4, 4, '_forward(to, n);'),
        (14, 'Book@', '_cancelOrder', 28, False, 1, 29, 29, 'delete orders[id];'),
        (14, 'Book@', 'cancelExpired', 23, False, 1, 24, 24, 'Order storage order = orders[id];'),
        (14, 'Book@', 'cancelExpired', 23, False, 2, 25, 25, 'require(order.expiration < block.timestamp);'),
        (14, 'Book@', 'cancelExpired', 23, False, 3, 26, 26, '_cancelOrder(id);'),
        (14, 'Book@', 'claimReceipt', 34, False, 1, 35, 35, 'address signer = recoverSigner(hash, signature);'),
        (14, 'Book@', 'claimReceipt', 34, False, 2, 36, 36, 'last = uint256(uint160(signer));'),
        (14, 'Book@', 'executeOrder', 16, False, 1, 17, 17, 'Order storage order = orders[id];'),
        (14, 'Book@', 'executeOrder', 16, False, 2, 18, 18, 'require(block.timestamp <= order.expiration);'),
        (14, 'Book@', 'executeOrder', 16, False, 3, 19, 19, 'order.maker = address(0);'),
        (14, 'Book@', 'executeOrder', 16, False, 4, 20, 20, 'token.transfer(msg.sender, 1);'),
        (14, 'Book@', 'executeOrder', 16, False, 5, 21, 21, 'emit Executed(id, block.timestamp);'),
        (14, 'Book@', 'fillOrder', 31, False, 1, 32, 32, 'last = input.expiration;'),
        (14, 'Book@', 'placeOrder', 10, False, 1, 11, 11, 'require(expiration > block.timestamp);'),
        (14, 'Book@', 'placeOrder', 10, False, 2, 12, 12, 'Order storage order = orders[id];'),
        (14, 'Book@', 'placeOrder', 10, False, 3, 13, 13, 'order.expiration = expiration;'),
        (14, 'Book@', 'placeOrder', 10, False, 4, 14, 14, 'order.createdAt = block.timestamp;'),
        (15, 'Vesting@', 'accrue', 22, False, 1, 23, 23, 'rewardStored = block.timestamp - start;'),
        (15, 'Vesting@', 'capture', 25, False, 1, 26, 26, 'unlockAt = block.timestamp;'),
        (15, 'Vesting@', 'claim', 17, False, 1, 18, 18, 'uint256 amount = vested(msg.sender);'),
        (15, 'Vesting@', 'claim', 17, False, 2, 19, 19, 'claimed[msg.sender] += amount;'),
        (15, 'Vesting@', 'claim', 17, False, 3, 20, 20, 'token.transfer(msg.sender, amount);'),
        (15, 'Vesting@', 'getTime', 7, False, 1, 8, 8, 'return block.timestamp;'),
        (15, 'Vesting@', 'join', 28, False, 1, 29, 29, 'uint256 current = getTime();'),
        (15, 'Vesting@', 'join', 28, False, 2, 30, 30, 'require(block.timestamp < start && current < start);'),
        (15, 'Vesting@', 'join', 28, False, 3, 31, 31, 'require(amount > 1);'),
        (15, 'Vesting@', 'vested', 10, False, 1, 11, 11, 'uint256 current = getTime();'),
        (15, 'Vesting@', 'vested', 10, False, 2, 12, 12, 'if (current < start) {'),
        (15, 'Vesting@', 'vested', 10, False, 3, 13, 13, 'return 0;'),
        (15, 'Vesting@', 'vested', 10, False, 4, 15, 15, 'return current - start;'),
        (16, 'Farm@', '_sell', 12, False, 1, 13, 13, 'uint256 quoted = router.getAmountsOut(amount);'),
        (16, 'Farm@', '_sell', 12, False, 2, 14, 14, 'router.swapExactTokens(amount, quoted - slippage, path);'),
        (16, 'Farm@', '_sell', 12, False, 3, 15, 15, 'pool.deposit(quoted);'),
        (16, 'Farm@', 'compound', 8, False, 1, 9, 9, 'uint256 amount = token.balanceOf(address(this));'),
        (16, 'Farm@', 'compound', 8, False, 2, 10, 10, '_sell(amount);'),
        (16, 'Farm@', 'harvest', 4, False, 1, 5, 5, 'uint256 amount = token.balanceOf(address(this));'),
        (16, 'Farm@', 'harvest', 4, False, 2, 6, 6, 'router.swapExactTokens(amount, 0, path);'),
        (16, 'Farm@', 'redeem', 17, False, 1, 18, 18, 'uint256 out = n * total / oracle.value(n);'),
        (16, 'Farm@', 'redeem', 17, False, 2, 19, 19, 'token.transfer(msg.sender, out);'),
        (17, 'Powers@', '_lock', 7, False, 1, 8, 8, 'locks[who].until = now + span;'),
        (17, 'Powers@', 'cost', 15, False, 1, 16, 16, 'uint256 c = a * b;'),
        (17, 'Powers@', 'cost', 15, False, 2, 17, 17, 'return c;'),
        (17, 'Powers@', 'fill', 10, False, 1, 11, 11, 'uint256 price = safePower(base, n);'),
        (17, 'Powers@', 'fill', 10, False, 2, 12, 12, 'require(price > 0);'),
        (17, 'Powers@', 'fill', 10, False, 3, 13, 13, 'token.transfer(msg.sender, price);'),
        (2, 'Base@', '_grant', 4, False, 1, 5, 5, 'shares[to] += n;'),
        (2, 'Shop@', '_grant', 15, False, 1, 16, 16, 'super._grant(to, n);'),
        (2, 'Shop@', 'buy', 12, False, 1, 13, 13, '_grant(msg.sender, n);'),
        (3, 'Admin@', '_apply', 34, False, 1, 35, 35, 'fee = value;'),
        (3, 'Admin@', 'adjust', 31, False, 1, 32, 32, '_apply(value);'),
        (3, 'Admin@', 'constructor', 12, False, 1, 13, 13, 'owner = msg.sender;'),
        (3, 'Admin@', 'initialize', 15, False, 1, 16, 16, 'owner = first;'),
        (3, 'Admin@', 'onlyAnyone', 9, True, 1, 10, 10, '_;'),
        (3, 'Admin@', 'onlyOwner', 5, True, 1, 6, 6, 'require(msg.sender == owner);'),
        (3, 'Admin@', 'onlyOwner', 5, True, 2, 7, 7, '_;'),
        (3, 'Admin@', 'setFee', 18, False, 1, 19, 19, 'fee = value;'),
        (3, 'Admin@', 'setFeeChecked', 27, False, 1, 28, 28, 'require(msg.sender == owner);'),
        (3, 'Admin@', 'setFeeChecked', 27, False, 2, 29, 29, 'fee = value;'),
        (3, 'Admin@', 'setFeeLoose', 24, False, 1, 25, 25, 'fee = value;'),
        (3, 'Admin@', 'setOwner', 21, False, 1, 22, 22, 'owner = next;'),
        (4, 'Origin@', 'fromOwner', 5, True, 1, 6, 6, 'require(tx.origin == owner);'),
        (4, 'Origin@', 'fromOwner', 5, True, 2, 7, 7, '_;'),
        (4, 'Origin@', 'join', 16, False, 1, 17, 17, 'treasury = msg.sender;'),
        (4, 'Origin@', 'noContracts', 9, True, 1, 10, 10, 'require(msg.sender == tx.origin);'),
        (4, 'Origin@', 'noContracts', 9, True, 2, 11, 11, '_;'),
        (4, 'Origin@', 'remember', 19, False, 1, 20, 20, 'owner = tx.origin;'),
        (4, 'Origin@', 'setTreasury', 13, False, 1, 14, 14, 'treasury = next;'),
        (4, 'Origin@', 'sweep', 22, False, 1, 23, 23, 'IERC20(token).transfer(tx.origin, 1);'),
        (5, 'Caller@', 'branched', 13, False, 1, 14, 14, '(bool ok, ) = to.call("");'),
        (5, 'Caller@', 'branched', 13, False, 2, 15, 15, 'if (!ok) {'),
        (5, 'Caller@', 'branched', 13, False, 3, 16, 16, 'revert();'),
        (5, 'Caller@', 'dropped', 4, False, 1, 5, 5, 'to.call("");'),
        (5, 'Caller@', 'emitted', 22, False, 1, 23, 23, '(bool ok, ) = to.delegatecall("");'),
        (5, 'Caller@', 'emitted', 22, False, 2, 24, 24, 'emit Done(ok);'),
        (5, 'Caller@', 'required', 10, False, 1, 11, 11, 'require(payable(to).send(1));'),
        (5, 'Caller@', 'returned', 19, False, 1, 20, 20, 'return payable(to).send(1);'),
        (5, 'Caller@', 'unused', 7, False, 1, 8, 8, '(bool ok, ) = to.call("");'),
        (6, 'Payer@', 'kept', 13, False, 1, 14, 14, 'bool ok = token.transfer(to, n);'),
        (6, 'Payer@', 'loose', 10, False, 1, 11, 11, 'token.transfer(to, n);'),
        (6, 'Payer@', 'peek', 22, False, 1, 23, 23, 'return token.balanceOf(who);'),
        (6, 'Payer@', 'strict', 16, False, 1, 17, 20, 'require(\n            token.transfer(to, n),\n            "      "\n        );'),
        (7, 'Assembler@', 'blind', 3, False, 1, 4, 4, 'assembly {'),
        (7, 'Assembler@', 'blind', 3, False, 2, 5, 6, 'let r := call(gas(), to, 0, 0, 0, 0, 0)\n        }'),
        (7, 'Assembler@', 'seen', 8, False, 1, 9, 9, 'assembly {'),
        (7, 'Assembler@', 'seen', 8, False, 2, 10, 12, 'let success := call(gas(), to, 0, 0, 0, 0, 0)\n            switch success\n            case 0 {'),
        (7, 'Assembler@', 'seen', 8, False, 3, 12, 12, 'revert(0, 0) }'),
        (8, 'Sums@', 'Sums@', 5, False, 1, 6, 6, 'supply = 1;'),
        (8, 'Sums@', 'mint', 8, False, 1, 9, 9, 'balances[to] += amount;'),
        (8, 'Sums@', 'mint', 8, False, 2, 10, 10, 'supply += amount;'),
        (8, 'Sums@', 'move', 12, False, 1, 13, 13, 'require(balances[msg.sender] >= amount);'),
        (8, 'Sums@', 'move', 12, False, 2, 14, 14, 'balances[msg.sender] -= amount;'),
        (8, 'Sums@', 'move', 12, False, 3, 15, 15, 'require(balances[to] + amount >= balances[to]);'),
        (8, 'Sums@', 'move', 12, False, 4, 16, 16, 'balances[to] += amount;'),
        (8, 'Sums@', 'scale', 18, False, 1, 19, 19, 'uint256 c = a * b;'),
        (8, 'Sums@', 'scale', 18, False, 2, 20, 20, 'return c;'),
        (9, 'Market@', 'approveSpender', 20, False, 1, 21, 21, 'allowance[msg.sender][spender] = value;'),
        (9, 'Market@', 'buy', 8, False, 1, 9, 9, 'payable(msg.sender).transfer(n * price);'),
        (9, 'Market@', 'setPrice', 5, False, 1, 6, 6, 'price = value;'),
        (9, 'Market@', 'swapAll', 11, False, 1, 12, 12, 'uint256 quoted = IRouter(router).getAmountOut(amount);'),
        (9, 'Market@', 'swapAll', 11, False, 2, 13, 13, 'IRouter(router).swap(amount, quoted);'),
        (9, 'Market@', 'swapBound', 15, False, 1, 16, 16, 'uint256 quoted = IRouter(router).getAmountOut(amount);'),
        (9, 'Market@', 'swapBound', 15, False, 2, 17, 17, 'require(quoted >= minOut);'),
        (9, 'Market@', 'swapBound', 15, False, 3, 18, 18, 'IRouter(router).swap(amount, quoted);'),
    ]),
    'tx11_line_functions': ('line:l contract:s fn:s', [
        (0, 11, 'Vault@', 'deposit'),
        (0, 12, 'Vault@', 'deposit'),
        (0, 13, 'Vault@', 'deposit'),
        (0, 14, 'Vault@', 'withdraw'),
        (0, 15, 'Vault@', 'withdraw'),
        (0, 16, 'Vault@', 'withdraw'),
        (0, 17, 'Vault@', 'withdraw'),
        (0, 18, 'Vault@', 'withdraw'),
        (0, 19, 'Vault@', 'guarded'),
        (0, 20, 'Vault@', 'guarded'),
        (0, 21, 'Vault@', 'guarded'),
        (0, 22, 'Vault@', 'guarded'),
        (0, 23, 'Vault@', 'guarded'),
        (0, 24, 'Vault@', 'orderly'),
        (0, 25, 'Vault@', 'orderly'),
        (0, 26, 'Vault@', 'orderly'),
        (0, 27, 'Vault@', 'orderly'),
        (0, 28, 'Vault@', 'orderly'),
        (1, 10, 'Chain@', 'relay'),
        (1, 11, 'Chain@', 'pay'),
        (1, 12, 'Chain@', 'pay'),
        (1, 13, 'Chain@', 'pay'),
        (1, 14, 'Chain@', 'pay'),
        (1, 15, 'Chain@', 'ping'),
        (1, 16, 'Chain@', 'ping'),
        (1, 17, 'Chain@', 'ping'),
        (1, 18, 'Chain@', 'pong'),
        (1, 19, 'Chain@', 'pong'),
        (1, 20, 'Chain@', 'pong'),
        (1, 21, 'Chain@', 'ping2'),
        (1, 22, 'Chain@', 'ping2'),
        (1, 23, 'Chain@', 'ping2'),
        (1, 24, 'Chain@', 'lost'),
        (1, 25, 'Chain@', 'lost'),
        (1, 26, 'Chain@', 'lost'),
        (1, 4, 'Chain@', 'claim'),
        (1, 5, 'Chain@', 'claim'),
        (1, 6, 'Chain@', 'claim'),
        (1, 7, 'Chain@', 'claim'),
        (1, 8, 'Chain@', 'relay'),
        (1, 9, 'Chain@', 'relay'),
        (10, 11, 'Lock@', 'setStart'),
        (10, 12, 'Lock@', 'setStart'),
        (10, 13, 'Lock@', 'setStart'),
        (10, 14, 'Lock@', 'setEnd'),
        (10, 15, 'Lock@', 'setEnd'),
        (10, 16, 'Lock@', 'setEnd'),
        (10, 17, 'Lock@', 'release'),
        (10, 18, 'Lock@', 'release'),
        (10, 19, 'Lock@', 'release'),
        (10, 20, 'Lock@', 'release'),
        (10, 21, 'Lock@', 'release'),
        (10, 22, 'Lock@', 'claim'),
        (10, 23, 'Lock@', 'claim'),
        (10, 24, 'Lock@', 'claim'),
        (10, 25, 'Lock@', 'remaining'),
        (10, 26, 'Lock@', 'remaining'),
        (10, 27, 'Lock@', 'remaining'),
        (10, 28, 'Lock@', 'note'),
        (10, 29, 'Lock@', 'note'),
        (10, 30, 'Lock@', 'note'),
        (11, 10, 'Odd@', 'f'),
        (11, 11, 'Odd@', 'f'),
        (11, 12, 'Odd@', 'f'),
        (11, 13, 'Odd@', 'f'),
        (11, 14, 'Odd@', 'f'),
        (11, 15, 'Odd@', 'f'),
        (11, 16, 'Odd@', 'f'),
        (11, 17, 'Odd@', 'f'),
        (11, 18, 'Odd@', 'g'),
        (11, 7, 'Odd@', 'f'),
        (11, 8, 'Odd@', 'f'),
        (11, 9, 'Odd@', 'f'),
        (12, 10, 'Desk@', 'setComptroller'),
        (12, 11, 'Desk@', 'setComptroller'),
        (12, 12, 'Desk@', 'setComptroller'),
        (12, 13, 'Desk@', 'deposit'),
        (12, 14, 'Desk@', 'deposit'),
        (12, 15, 'Desk@', 'deposit'),
        (12, 16, 'Desk@', 'deposit'),
        (12, 17, 'Desk@', 'pull'),
        (12, 18, 'Desk@', 'pull'),
        (12, 19, 'Desk@', 'pull'),
        (12, 20, 'Desk@', 'pull'),
        (12, 21, 'Desk@', 'payLater'),
        (12, 22, 'Desk@', 'payLater'),
        (12, 23, 'Desk@', 'payLater'),
        (12, 24, 'Desk@', 'payLater'),
        (12, 25, 'Desk@', '_book'),
        (12, 26, 'Desk@', '_book'),
        (12, 27, 'Desk@', '_book'),
        (12, 28, 'Desk@', 'trade'),
        (12, 29, 'Desk@', 'trade'),
        (12, 30, 'Desk@', 'trade'),
        (12, 31, 'Desk@', 'trade'),
        (12, 32, 'Desk@', 'trade'),
        (12, 33, 'Desk@', 'settle'),
        (12, 34, 'Desk@', 'settle'),
        (12, 35, 'Desk@', 'settle'),
        (12, 36, 'Desk@', 'settle'),
        (12, 37, 'Desk@', '_push'),
        (12, 38, 'Desk@', '_push'),
        (12, 39, 'Desk@', '_push'),
        (12, 40, 'Desk@', '_push'),
        (12, 41, 'Desk@', '_push'),
        (12, 42, 'Desk@', 'mintAll'),
        (12, 43, 'Desk@', 'mintAll'),
        (12, 44, 'Desk@', 'mintAll'),
        (12, 45, 'Desk@', 'mintAll'),
        (12, 46, 'Desk@', 'sweep'),
        (12, 47, 'Desk@', 'sweep'),
        (12, 48, 'Desk@', 'sweep'),
        (12, 49, 'Desk@', 'sweep'),
        (12, 9, 'Desk@', 'setComptroller'),
        (13, 10, 'Sender@', 'half'),
        (13, 11, 'Sender@', 'half'),
        (13, 12, 'Sender@', 'half'),
        (13, 18, 'Router@', 'issue'),
        (13, 19, 'Router@', 'issue'),
        (13, 20, 'Router@', 'issue'),
        (13, 21, 'Router@', 'rescue'),
        (13, 22, 'Router@', 'rescue'),
        (13, 23, 'Router@', 'rescue'),
        (13, 24, 'Router@', 'liquidateFor'),
        (13, 25, 'Router@', 'liquidateFor'),
        (13, 26, 'Router@', 'liquidateFor'),
        (13, 27, 'Router@', 'liquidateFor'),
        (13, 28, 'Router@', 'mark'),
        (13, 29, 'Router@', 'mark'),
        (13, 3, 'Sender@', 'push'),
        (13, 30, 'Router@', 'mark'),
        (13, 4, 'Sender@', 'push'),
        (13, 5, 'Sender@', 'push'),
        (13, 6, 'Sender@', '_forward'),
        (13, 7, 'Sender@', '_forward'),
        (13, 8, 'Sender@', '_forward'),
        (13, 9, 'Sender@', '_forward'),
        (14, 10, 'Book@', 'placeOrder'),
        (14, 11, 'Book@', 'placeOrder'),
        (14, 12, 'Book@', 'placeOrder'),
        (14, 13, 'Book@', 'placeOrder'),
        (14, 14, 'Book@', 'placeOrder'),
        (14, 15, 'Book@', 'placeOrder'),
        (14, 16, 'Book@', 'executeOrder'),
        (14, 17, 'Book@', 'executeOrder'),
        (14, 18, 'Book@', 'executeOrder'),
        (14, 19, 'Book@', 'executeOrder'),
        (14, 20, 'Book@', 'executeOrder'),
        (14, 21, 'Book@', 'executeOrder'),
        (14, 22, 'Book@', 'executeOrder'),
        (14, 23, 'Book@', 'cancelExpired'),
        (14, 24, 'Book@', 'cancelExpired'),
        (14, 25, 'Book@', 'cancelExpired'),
        (14, 26, 'Book@', 'cancelExpired'),
        (14, 27, 'Book@', 'cancelExpired'),
        (14, 28, 'Book@', '_cancelOrder'),
        (14, 29, 'Book@', '_cancelOrder'),
        (14, 30, 'Book@', '_cancelOrder'),
        (14, 31, 'Book@', 'fillOrder'),
        (14, 32, 'Book@', 'fillOrder'),
        (14, 33, 'Book@', 'fillOrder'),
        (14, 34, 'Book@', 'claimReceipt'),
        (14, 35, 'Book@', 'claimReceipt'),
        (14, 36, 'Book@', 'claimReceipt'),
        (14, 37, 'Book@', 'claimReceipt'),
        (15, 10, 'Vesting@', 'vested'),
        (15, 11, 'Vesting@', 'vested'),
        (15, 12, 'Vesting@', 'vested'),
        (15, 13, 'Vesting@', 'vested'),
        (15, 14, 'Vesting@', 'vested'),
        (15, 15, 'Vesting@', 'vested'),
        (15, 16, 'Vesting@', 'vested'),
        (15, 17, 'Vesting@', 'claim'),
        (15, 18, 'Vesting@', 'claim'),
        (15, 19, 'Vesting@', 'claim'),
        (15, 20, 'Vesting@', 'claim'),
        (15, 21, 'Vesting@', 'claim'),
        (15, 22, 'Vesting@', 'accrue'),
        (15, 23, 'Vesting@', 'accrue'),
        (15, 24, 'Vesting@', 'accrue'),
        (15, 25, 'Vesting@', 'capture'),
        (15, 26, 'Vesting@', 'capture'),
        (15, 27, 'Vesting@', 'capture'),
        (15, 28, 'Vesting@', 'join'),
        (15, 29, 'Vesting@', 'join'),
        (15, 30, 'Vesting@', 'join'),
        (15, 31, 'Vesting@', 'join'),
        (15, 32, 'Vesting@', 'join'),
        (15, 7, 'Vesting@', 'getTime'),
        (15, 8, 'Vesting@', 'getTime'),
        (15, 9, 'Vesting@', 'getTime'),
        (16, 10, 'Farm@', 'compound'),
        (16, 11, 'Farm@', 'compound'),
        (16, 12, 'Farm@', '_sell'),
        (16, 13, 'Farm@', '_sell'),
        (16, 14, 'Farm@', '_sell'),
        (16, 15, 'Farm@', '_sell'),
        (16, 16, 'Farm@', '_sell'),
        (16, 17, 'Farm@', 'redeem'),
        (16, 18, 'Farm@', 'redeem'),
        (16, 19, 'Farm@', 'redeem'),
        (16, 20, 'Farm@', 'redeem'),
        (16, 4, 'Farm@', 'harvest'),
        (16, 5, 'Farm@', 'harvest'),
        (16, 6, 'Farm@', 'harvest'),
        (16, 7, 'Farm@', 'harvest'),
        (16, 8, 'Farm@', 'compound'),
        (16, 9, 'Farm@', 'compound'),
        (17, 10, 'Powers@', 'fill'),
        (17, 11, 'Powers@', 'fill'),
        (17, 12, 'Powers@', 'fill'),
        (17, 13, 'Powers@', 'fill'),
        (17, 14, 'Powers@', 'fill'),
        (17, 15, 'Powers@', 'cost'),
        (17, 16, 'Powers@', 'cost'),
        (17, 17, 'Powers@', 'cost'),
        (17, 18, 'Powers@', 'cost'),
        (17, 7, 'Powers@', '_lock'),
        (17, 8, 'Powers@', '_lock'),
        (17, 9, 'Powers@', '_lock'),
        (2, 12, 'Shop@', 'buy'),
        (2, 13, 'Shop@', 'buy'),
        (2, 14, 'Shop@', 'buy'),
        (2, 15, 'Shop@', '_grant'),
        (2, 16, 'Shop@', '_grant'),
        (2, 17, 'Shop@', '_grant'),
        (2, 4, 'Base@', '_grant'),
        (2, 5, 'Base@', '_grant'),
        (2, 6, 'Base@', '_grant'),
        (3, 12, 'Admin@', 'constructor'),
        (3, 13, 'Admin@', 'constructor'),
        (3, 14, 'Admin@', 'constructor'),
        (3, 15, 'Admin@', 'initialize'),
        (3, 16, 'Admin@', 'initialize'),
        (3, 17, 'Admin@', 'initialize'),
        (3, 18, 'Admin@', 'setFee'),
        (3, 19, 'Admin@', 'setFee'),
        (3, 20, 'Admin@', 'setFee'),
        (3, 21, 'Admin@', 'setOwner'),
        (3, 22, 'Admin@', 'setOwner'),
        (3, 23, 'Admin@', 'setOwner'),
        (3, 24, 'Admin@', 'setFeeLoose'),
        (3, 25, 'Admin@', 'setFeeLoose'),
        (3, 26, 'Admin@', 'setFeeLoose'),
        (3, 27, 'Admin@', 'setFeeChecked'),
        (3, 28, 'Admin@', 'setFeeChecked'),
        (3, 29, 'Admin@', 'setFeeChecked'),
        (3, 30, 'Admin@', 'setFeeChecked'),
        (3, 31, 'Admin@', 'adjust'),
        (3, 32, 'Admin@', 'adjust'),
        (3, 33, 'Admin@', 'adjust'),
        (3, 34, 'Admin@', '_apply'),
        (3, 35, 'Admin@', '_apply'),
        (3, 36, 'Admin@', '_apply'),
        (4, 13, 'Origin@', 'setTreasury'),
        (4, 14, 'Origin@', 'setTreasury'),
        (4, 15, 'Origin@', 'setTreasury'),
        (4, 16, 'Origin@', 'join'),
        (4, 17, 'Origin@', 'join'),
        (4, 18, 'Origin@', 'join'),
        (4, 19, 'Origin@', 'remember'),
        (4, 20, 'Origin@', 'remember'),
        (4, 21, 'Origin@', 'remember'),
        (4, 22, 'Origin@', 'sweep'),
        (4, 23, 'Origin@', 'sweep'),
        (4, 24, 'Origin@', 'sweep'),
        (5, 10, 'Caller@', 'required'),
        (5, 11, 'Caller@', 'required'),
        (5, 12, 'Caller@', 'required'),
        (5, 13, 'Caller@', 'branched'),
        (5, 14, 'Caller@', 'branched'),
        (5, 15, 'Caller@', 'branched'),
        (5, 16, 'Caller@', 'branched'),
        (5, 17, 'Caller@', 'branched'),
        (5, 18, 'Caller@', 'branched'),
        (5, 19, 'Caller@', 'returned'),
        (5, 20, 'Caller@', 'returned'),
        (5, 21, 'Caller@', 'returned'),
        (5, 22, 'Caller@', 'emitted'),
        (5, 23, 'Caller@', 'emitted'),
        (5, 24, 'Caller@', 'emitted'),
        (5, 25, 'Caller@', 'emitted'),
        (5, 4, 'Caller@', 'dropped'),
        (5, 5, 'Caller@', 'dropped'),
        (5, 6, 'Caller@', 'dropped'),
        (5, 7, 'Caller@', 'unused'),
        (5, 8, 'Caller@', 'unused'),
        (5, 9, 'Caller@', 'unused'),
        (6, 10, 'Payer@', 'loose'),
        (6, 11, 'Payer@', 'loose'),
        (6, 12, 'Payer@', 'loose'),
        (6, 13, 'Payer@', 'kept'),
        (6, 14, 'Payer@', 'kept'),
        (6, 15, 'Payer@', 'kept'),
        (6, 16, 'Payer@', 'strict'),
        (6, 17, 'Payer@', 'strict'),
        (6, 18, 'Payer@', 'strict'),
        (6, 19, 'Payer@', 'strict'),
        (6, 20, 'Payer@', 'strict'),
        (6, 21, 'Payer@', 'strict'),
        (6, 22, 'Payer@', 'peek'),
        (6, 23, 'Payer@', 'peek'),
        (6, 24, 'Payer@', 'peek'),
        (7, 10, 'Assembler@', 'seen'),
        (7, 11, 'Assembler@', 'seen'),
        (7, 12, 'Assembler@', 'seen'),
        (7, 13, 'Assembler@', 'seen'),
        (7, 14, 'Assembler@', 'seen'),
        (7, 3, 'Assembler@', 'blind'),
        (7, 4, 'Assembler@', 'blind'),
        (7, 5, 'Assembler@', 'blind'),
        (7, 6, 'Assembler@', 'blind'),
        (7, 7, 'Assembler@', 'blind'),
        (7, 8, 'Assembler@', 'seen'),
        (7, 9, 'Assembler@', 'seen'),
        (8, 10, 'Sums@', 'mint'),
        (8, 11, 'Sums@', 'mint'),
        (8, 12, 'Sums@', 'move'),
        (8, 13, 'Sums@', 'move'),
        (8, 14, 'Sums@', 'move'),
        (8, 15, 'Sums@', 'move'),
        (8, 16, 'Sums@', 'move'),
        (8, 17, 'Sums@', 'move'),
        (8, 18, 'Sums@', 'scale'),
        (8, 19, 'Sums@', 'scale'),
        (8, 20, 'Sums@', 'scale'),
        (8, 21, 'Sums@', 'scale'),
        (8, 5, 'Sums@', 'Sums@'),
        (8, 6, 'Sums@', 'Sums@'),
        (8, 7, 'Sums@', 'Sums@'),
        (8, 8, 'Sums@', 'mint'),
        (8, 9, 'Sums@', 'mint'),
        (9, 10, 'Market@', 'buy'),
        (9, 11, 'Market@', 'swapAll'),
        (9, 12, 'Market@', 'swapAll'),
        (9, 13, 'Market@', 'swapAll'),
        (9, 14, 'Market@', 'swapAll'),
        (9, 15, 'Market@', 'swapBound'),
        (9, 16, 'Market@', 'swapBound'),
        (9, 17, 'Market@', 'swapBound'),
        (9, 18, 'Market@', 'swapBound'),
        (9, 19, 'Market@', 'swapBound'),
        (9, 20, 'Market@', 'approveSpender'),
        (9, 21, 'Market@', 'approveSpender'),
        (9, 22, 'Market@', 'approveSpender'),
        (9, 5, 'Market@', 'setPrice'),
        (9, 6, 'Market@', 'setPrice'),
        (9, 7, 'Market@', 'setPrice'),
        (9, 8, 'Market@', 'buy'),
        (9, 9, 'Market@', 'buy'),
    ]),
    'tx12_matching_lines': ('contract:s fn:s start_line:l hit_lines:L', [
        (0, 'Vault@', 'deposit', 11, [12]),
        (0, 'Vault@', 'guarded', 19, [20, 22]),
        (0, 'Vault@', 'orderly', 24, [25, 26]),
        (0, 'Vault@', 'withdraw', 14, [15, 17]),
        (1, 'Chain@', 'claim', 4, [6]),
        (1, 'Chain@', 'lost', 24, [25]),
        (1, 'Chain@', 'pay', 11, [12]),
        (10, 'Lock@', 'claim', 22, [23]),
        (10, 'Lock@', 'release', 17, [20]),
        (12, 'Desk@', 'deposit', 13, [14, 15]),
        (12, 'Desk@', 'payLater', 21, [22]),
        (12, 'Desk@', 'sweep', 46, [47]),
        (14, 'Book@', 'executeOrder', 16, [20]),
        (15, 'Vesting@', 'claim', 17, [18, 19, 20]),
        (16, 'Farm@', 'redeem', 17, [19]),
        (17, 'Powers@', 'fill', 10, [13]),
        (2, 'Shop@', 'buy', 12, [13]),
        (3, 'Admin@', 'constructor', 12, [13]),
        (3, 'Admin@', 'setFeeChecked', 27, [28]),
        (4, 'Origin@', 'join', 16, [17]),
        (8, 'Sums@', 'move', 12, [13, 14]),
        (9, 'Market@', 'approveSpender', 20, [21]),
        (9, 'Market@', 'buy', 8, [9]),
    ]),
    'tx13_identifier_words': ('contract:s fn:s fn_start:l stmt_no:i word:s', [
        (0, 'Vault@', 'deposit', 11, 1, 'balances'),
        (0, 'Vault@', 'guarded', 19, 1, 'amount'),
        (0, 'Vault@', 'guarded', 19, 1, 'ok'),
        (0, 'Vault@', 'guarded', 19, 2, 'ok'),
        (0, 'Vault@', 'guarded', 19, 3, 'amount'),
        (0, 'Vault@', 'guarded', 19, 3, 'balances'),
        (0, 'Vault@', 'orderly', 24, 1, 'amount'),
        (0, 'Vault@', 'orderly', 24, 1, 'balances'),
        (0, 'Vault@', 'orderly', 24, 2, 'amount'),
        (0, 'Vault@', 'orderly', 24, 2, 'ok'),
        (0, 'Vault@', 'orderly', 24, 3, 'ok'),
        (0, 'Vault@', 'withdraw', 14, 1, 'amount'),
        (0, 'Vault@', 'withdraw', 14, 1, 'ok'),
        (0, 'Vault@', 'withdraw', 14, 2, 'ok'),
        (0, 'Vault@', 'withdraw', 14, 3, 'amount'),
        (0, 'Vault@', 'withdraw', 14, 3, 'balances'),
        (1, 'Chain@', 'claim', 4, 1, 'amount'),
        (1, 'Chain@', 'claim', 4, 1, 'relay'),
        (1, 'Chain@', 'claim', 4, 2, 'credit'),
        (1, 'Chain@', 'lost', 24, 1, 'credit'),
        (1, 'Chain@', 'pay', 11, 1, 'amount'),
        (1, 'Chain@', 'pay', 11, 1, 'ok'),
        (1, 'Chain@', 'pay', 11, 2, 'ok'),
        (1, 'Chain@', 'ping', 15, 1, 'pong'),
        (1, 'Chain@', 'ping2', 21, 1, 'pong'),
        (1, 'Chain@', 'pong', 18, 1, 'ping'),
        (1, 'Chain@', 'relay', 8, 1, 'amount'),
        (1, 'Chain@', 'relay', 8, 1, 'pay'),
        (10, 'Lock@', 'claim', 22, 1, 'balances'),
        (10, 'Lock@', 'note', 28, 1, 'at'),
        (10, 'Lock@', 'note', 28, 1, 'block'),
        (10, 'Lock@', 'note', 28, 1, 'timestamp'),
        (10, 'Lock@', 'release', 17, 1, '256'),
        (10, 'Lock@', 'release', 17, 1, 'block'),
        (10, 'Lock@', 'release', 17, 1, 'current'),
        (10, 'Lock@', 'release', 17, 1, 'timestamp'),
        (10, 'Lock@', 'release', 17, 2, 'current'),
        (10, 'Lock@', 'release', 17, 2, 'end'),
        (10, 'Lock@', 'release', 17, 3, 'balances'),
        (10, 'Lock@', 'remaining', 25, 1, 'block'),
        (10, 'Lock@', 'remaining', 25, 1, 'end'),
        (10, 'Lock@', 'remaining', 25, 1, 'timestamp'),
        (10, 'Lock@', 'setEnd', 14, 1, 'block'),
        (10, 'Lock@', 'setEnd', 14, 1, 'days'),
        (10, 'Lock@', 'setEnd', 14, 1, 'end'),
        (10, 'Lock@', 'setEnd', 14, 1, 'timestamp'),
        (10, 'Lock@', 'setStart', 11, 1, 'block'),
        (10, 'Lock@', 'setStart', 11, 1, 'days'),
        (10, 'Lock@', 'setStart', 11, 1, 'start'),
        (10, 'Lock@', 'setStart', 11, 1, 'timestamp'),
        (12, 'Desk@', '_book', 25, 1, 'amount'),
        (12, 'Desk@', '_book', 25, 1, 'total'),
        (12, 'Desk@', '_push', 37, 1, 'payee'),
        (12, 'Desk@', '_push', 37, 1, 'target'),
        (12, 'Desk@', '_push', 37, 2, 'amount'),
        (12, 'Desk@', '_push', 37, 2, 'ok'),
        (12, 'Desk@', '_push', 37, 2, 'payee'),
        (12, 'Desk@', '_push', 37, 3, 'ok'),
        (12, 'Desk@', 'deposit', 13, 1, 'amount'),
        (12, 'Desk@', 'deposit', 13, 1, 'from'),
        (12, 'Desk@', 'deposit', 13, 1, 'token'),
        (12, 'Desk@', 'deposit', 13, 2, 'amount'),
        (12, 'Desk@', 'deposit', 13, 2, 'balances'),
        (12, 'Desk@', 'mintAll', 42, 1, 'mint'),
        (12, 'Desk@', 'mintAll', 42, 1, 'safe'),
        (12, 'Desk@', 'mintAll', 42, 1, 'to'),
        (12, 'Desk@', 'mintAll', 42, 1, 'total'),
        (12, 'Desk@', 'mintAll', 42, 2, 'total'),
        (12, 'Desk@', 'payLater', 21, 1, 'amount'),
        (12, 'Desk@', 'payLater', 21, 1, 'safe'),
        (12, 'Desk@', 'payLater', 21, 1, 'token'),
        (12, 'Desk@', 'payLater', 21, 2, 'amount'),
        (12, 'Desk@', 'payLater', 21, 2, 'book'),
        (12, 'Desk@', 'pull', 17, 1, 'amount'),
        (12, 'Desk@', 'pull', 17, 1, 'to'),
        (12, 'Desk@', 'pull', 17, 1, 'token'),
        (12, 'Desk@', 'pull', 17, 2, 'amount'),
        (12, 'Desk@', 'pull', 17, 2, 'total'),
        (12, 'Desk@', 'setComptroller', 9, 1, 'comptroller'),
        (12, 'Desk@', 'setComptroller', 9, 1, 'is'),
        (12, 'Desk@', 'setComptroller', 9, 1, 'next'),
        (12, 'Desk@', 'setComptroller', 9, 2, 'comptroller'),
        (12, 'Desk@', 'setComptroller', 9, 2, 'next'),
        (12, 'Desk@', 'settle', 33, 1, 'amount'),
        (12, 'Desk@', 'settle', 33, 1, 'push'),
        (12, 'Desk@', 'settle', 33, 1, 'target'),
        (12, 'Desk@', 'settle', 33, 2, 'amount'),
        (12, 'Desk@', 'settle', 33, 2, 'total'),
        (12, 'Desk@', 'sweep', 46, 1, 'from'),
        (12, 'Desk@', 'sweep', 46, 1, 'safe'),
        (12, 'Desk@', 'sweep', 46, 1, 'to'),
        (12, 'Desk@', 'sweep', 46, 1, 'token'),
        (12, 'Desk@', 'sweep', 46, 2, 'deposit'),
        (12, 'Desk@', 'sweep', 46, 2, 'vault'),
        (12, 'Desk@', 'trade', 28, 1, 'amount'),
        (12, 'Desk@', 'trade', 28, 1, 'ok'),
        (12, 'Desk@', 'trade', 28, 1, 'target'),
        (12, 'Desk@', 'trade', 28, 2, 'ok'),
        (12, 'Desk@', 'trade', 28, 3, 'balance'),
        (12, 'Desk@', 'trade', 28, 3, 'of'),
        (12, 'Desk@', 'trade', 28, 3, 'token'),
        (13, 'Router@', 'issue', 18, 1, 'supply'),
        (13, 'Router@', 'issue', 18, 1, 'total'),
        (13, 'Router@', 'liquidateFor', 24, 1, 'positions'),
        (13, 'Router@', 'liquidateFor', 24, 1, 'subject'),
        (13, 'Router@', 'liquidateFor', 24, 2, 'actor'),
        (13, 'Router@', 'liquidateFor', 24, 2, 'liquidate'),
        (13, 'Router@', 'liquidateFor', 24, 2, 'perp'),
        (13, 'Router@', 'liquidateFor', 24, 2, 'subject'),
        (13, 'Router@', 'mark', 28, 1, 'marker'),
        (13, 'Router@', 'rescue', 21, 1, 'asset'),
        (13, 'Router@', 'rescue', 21, 1, 'to'),
        (13, 'Sender@', '_forward', 6, 1, 'ok'),
        (13, 'Sender@', '_forward', 6, 1, 'to'),
        (13, 'Sender@', '_forward', 6, 2, 'ok'),
        (13, 'Sender@', 'push', 3, 1, 'forward'),
        (13, 'Sender@', 'push', 3, 1, 'to'),
        (14, 'Book@', '_cancelOrder', 28, 1, 'delete'),
        (14, 'Book@', '_cancelOrder', 28, 1, 'id'),
        (14, 'Book@', '_cancelOrder', 28, 1, 'orders'),
        (14, 'Book@', 'cancelExpired', 23, 1, 'id'),
        (14, 'Book@', 'cancelExpired', 23, 1, 'order'),
        (14, 'Book@', 'cancelExpired', 23, 1, 'orders'),
        (14, 'Book@', 'cancelExpired', 23, 2, 'block'),
        (14, 'Book@', 'cancelExpired', 23, 2, 'expiration'),
        (14, 'Book@', 'cancelExpired', 23, 2, 'order'),
        (14, 'Book@', 'cancelExpired', 23, 2, 'timestamp'),
        (14, 'Book@', 'cancelExpired', 23, 3, 'cancel'),
        (14, 'Book@', 'cancelExpired', 23, 3, 'id'),
        (14, 'Book@', 'cancelExpired', 23, 3, 'order'),
        (14, 'Book@', 'claimReceipt', 34, 1, 'hash'),
        (14, 'Book@', 'claimReceipt', 34, 1, 'recover'),
        (14, 'Book@', 'claimReceipt', 34, 1, 'signature'),
        (14, 'Book@', 'claimReceipt', 34, 1, 'signer'),
        (14, 'Book@', 'claimReceipt', 34, 2, '160'),
        (14, 'Book@', 'claimReceipt', 34, 2, '256'),
        (14, 'Book@', 'claimReceipt', 34, 2, 'last'),
        (14, 'Book@', 'claimReceipt', 34, 2, 'signer'),
        (14, 'Book@', 'executeOrder', 16, 1, 'id'),
        (14, 'Book@', 'executeOrder', 16, 1, 'order'),
        (14, 'Book@', 'executeOrder', 16, 1, 'orders'),
        (14, 'Book@', 'executeOrder', 16, 2, 'block'),
        (14, 'Book@', 'executeOrder', 16, 2, 'expiration'),
        (14, 'Book@', 'executeOrder', 16, 2, 'order'),
        (14, 'Book@', 'executeOrder', 16, 2, 'timestamp'),
        (14, 'Book@', 'executeOrder', 16, 3, 'maker'),
        (14, 'Book@', 'executeOrder', 16, 3, 'order'),
        (14, 'Book@', 'executeOrder', 16, 4, 'token'),
        (14, 'Book@', 'executeOrder', 16, 5, 'block'),
        (14, 'Book@', 'executeOrder', 16, 5, 'executed'),
        (14, 'Book@', 'executeOrder', 16, 5, 'id'),
        (14, 'Book@', 'executeOrder', 16, 5, 'timestamp'),
        (14, 'Book@', 'fillOrder', 31, 1, 'expiration'),
        (14, 'Book@', 'fillOrder', 31, 1, 'input'),
        (14, 'Book@', 'fillOrder', 31, 1, 'last'),
        (14, 'Book@', 'placeOrder', 10, 1, 'block'),
        (14, 'Book@', 'placeOrder', 10, 1, 'expiration'),
        (14, 'Book@', 'placeOrder', 10, 1, 'timestamp'),
        (14, 'Book@', 'placeOrder', 10, 2, 'id'),
        (14, 'Book@', 'placeOrder', 10, 2, 'order'),
        (14, 'Book@', 'placeOrder', 10, 2, 'orders'),
        (14, 'Book@', 'placeOrder', 10, 3, 'expiration'),
        (14, 'Book@', 'placeOrder', 10, 3, 'order'),
        (14, 'Book@', 'placeOrder', 10, 4, 'at'),
        (14, 'Book@', 'placeOrder', 10, 4, 'block'),
        (14, 'Book@', 'placeOrder', 10, 4, 'created'),
        (14, 'Book@', 'placeOrder', 10, 4, 'order'),
        (14, 'Book@', 'placeOrder', 10, 4, 'timestamp'),
        (15, 'Vesting@', 'accrue', 22, 1, 'block'),
        (15, 'Vesting@', 'accrue', 22, 1, 'reward'),
        (15, 'Vesting@', 'accrue', 22, 1, 'start'),
        (15, 'Vesting@', 'accrue', 22, 1, 'stored'),
        (15, 'Vesting@', 'accrue', 22, 1, 'timestamp'),
        (15, 'Vesting@', 'capture', 25, 1, 'at'),
        (15, 'Vesting@', 'capture', 25, 1, 'block'),
        (15, 'Vesting@', 'capture', 25, 1, 'timestamp'),
        (15, 'Vesting@', 'capture', 25, 1, 'unlock'),
        (15, 'Vesting@', 'claim', 17, 1, '256'),
        (15, 'Vesting@', 'claim', 17, 1, 'amount'),
        (15, 'Vesting@', 'claim', 17, 1, 'vested'),
        (15, 'Vesting@', 'claim', 17, 2, 'amount'),
        (15, 'Vesting@', 'claim', 17, 2, 'claimed'),
        (15, 'Vesting@', 'claim', 17, 3, 'amount'),
        (15, 'Vesting@', 'claim', 17, 3, 'token'),
        (15, 'Vesting@', 'getTime', 7, 1, 'block'),
        (15, 'Vesting@', 'getTime', 7, 1, 'timestamp'),
        (15, 'Vesting@', 'join', 28, 1, '256'),
        (15, 'Vesting@', 'join', 28, 1, 'current'),
        (15, 'Vesting@', 'join', 28, 1, 'get'),
        (15, 'Vesting@', 'join', 28, 1, 'time'),
        (15, 'Vesting@', 'join', 28, 2, 'block'),
        (15, 'Vesting@', 'join', 28, 2, 'current'),
        (15, 'Vesting@', 'join', 28, 2, 'start'),
        (15, 'Vesting@', 'join', 28, 2, 'timestamp'),
        (15, 'Vesting@', 'join', 28, 3, 'amount'),
        (15, 'Vesting@', 'vested', 10, 1, '256'),
        (15, 'Vesting@', 'vested', 10, 1, 'current'),
        (15, 'Vesting@', 'vested', 10, 1, 'get'),
        (15, 'Vesting@', 'vested', 10, 1, 'time'),
        (15, 'Vesting@', 'vested', 10, 2, 'current'),
        (15, 'Vesting@', 'vested', 10, 2, 'start'),
        (15, 'Vesting@', 'vested', 10, 4, 'current'),
        (15, 'Vesting@', 'vested', 10, 4, 'start'),
        (16, 'Farm@', '_sell', 12, 1, '256'),
        (16, 'Farm@', '_sell', 12, 1, 'amount'),
        (16, 'Farm@', '_sell', 12, 1, 'amounts'),
        (16, 'Farm@', '_sell', 12, 1, 'get'),
        (16, 'Farm@', '_sell', 12, 1, 'out'),
        (16, 'Farm@', '_sell', 12, 1, 'quoted'),
        (16, 'Farm@', '_sell', 12, 1, 'router'),
        (16, 'Farm@', '_sell', 12, 2, 'amount'),
        (16, 'Farm@', '_sell', 12, 2, 'exact'),
        (16, 'Farm@', '_sell', 12, 2, 'path'),
        (16, 'Farm@', '_sell', 12, 2, 'quoted'),
        (16, 'Farm@', '_sell', 12, 2, 'router'),
        (16, 'Farm@', '_sell', 12, 2, 'slippage'),
        (16, 'Farm@', '_sell', 12, 2, 'swap'),
        (16, 'Farm@', '_sell', 12, 2, 'tokens'),
        (16, 'Farm@', '_sell', 12, 3, 'deposit'),
        (16, 'Farm@', '_sell', 12, 3, 'pool'),
        (16, 'Farm@', '_sell', 12, 3, 'quoted'),
        (16, 'Farm@', 'compound', 8, 1, '256'),
        (16, 'Farm@', 'compound', 8, 1, 'amount'),
        (16, 'Farm@', 'compound', 8, 1, 'balance'),
        (16, 'Farm@', 'compound', 8, 1, 'of'),
        (16, 'Farm@', 'compound', 8, 1, 'token'),
        (16, 'Farm@', 'compound', 8, 2, 'amount'),
        (16, 'Farm@', 'compound', 8, 2, 'sell'),
        (16, 'Farm@', 'harvest', 4, 1, '256'),
        (16, 'Farm@', 'harvest', 4, 1, 'amount'),
        (16, 'Farm@', 'harvest', 4, 1, 'balance'),
        (16, 'Farm@', 'harvest', 4, 1, 'of'),
        (16, 'Farm@', 'harvest', 4, 1, 'token'),
        (16, 'Farm@', 'harvest', 4, 2, 'amount'),
        (16, 'Farm@', 'harvest', 4, 2, 'exact'),
        (16, 'Farm@', 'harvest', 4, 2, 'path'),
        (16, 'Farm@', 'harvest', 4, 2, 'router'),
        (16, 'Farm@', 'harvest', 4, 2, 'swap'),
        (16, 'Farm@', 'harvest', 4, 2, 'tokens'),
        (16, 'Farm@', 'redeem', 17, 1, '256'),
        (16, 'Farm@', 'redeem', 17, 1, 'oracle'),
        (16, 'Farm@', 'redeem', 17, 1, 'out'),
        (16, 'Farm@', 'redeem', 17, 1, 'total'),
        (16, 'Farm@', 'redeem', 17, 2, 'out'),
        (16, 'Farm@', 'redeem', 17, 2, 'token'),
        (17, 'Powers@', '_lock', 7, 1, 'locks'),
        (17, 'Powers@', '_lock', 7, 1, 'now'),
        (17, 'Powers@', '_lock', 7, 1, 'span'),
        (17, 'Powers@', '_lock', 7, 1, 'until'),
        (17, 'Powers@', '_lock', 7, 1, 'who'),
        (17, 'Powers@', 'cost', 15, 1, '256'),
        (17, 'Powers@', 'fill', 10, 1, '256'),
        (17, 'Powers@', 'fill', 10, 1, 'base'),
        (17, 'Powers@', 'fill', 10, 1, 'power'),
        (17, 'Powers@', 'fill', 10, 1, 'price'),
        (17, 'Powers@', 'fill', 10, 1, 'safe'),
        (17, 'Powers@', 'fill', 10, 2, 'price'),
        (17, 'Powers@', 'fill', 10, 3, 'price'),
        (17, 'Powers@', 'fill', 10, 3, 'token'),
        (2, 'Base@', '_grant', 4, 1, 'shares'),
        (2, 'Base@', '_grant', 4, 1, 'to'),
        (2, 'Shop@', '_grant', 15, 1, 'grant'),
        (2, 'Shop@', '_grant', 15, 1, 'super'),
        (2, 'Shop@', '_grant', 15, 1, 'to'),
        (2, 'Shop@', 'buy', 12, 1, 'grant'),
        (3, 'Admin@', '_apply', 34, 1, 'fee'),
        (3, 'Admin@', 'adjust', 31, 1, 'apply'),
        (3, 'Admin@', 'constructor', 12, 1, 'owner'),
        (3, 'Admin@', 'initialize', 15, 1, 'first'),
        (3, 'Admin@', 'initialize', 15, 1, 'owner'),
        (3, 'Admin@', 'setFee', 18, 1, 'fee'),
        (3, 'Admin@', 'setFeeChecked', 27, 1, 'owner'),
        (3, 'Admin@', 'setFeeChecked', 27, 2, 'fee'),
        (3, 'Admin@', 'setFeeLoose', 24, 1, 'fee'),
        (3, 'Admin@', 'setOwner', 21, 1, 'next'),
        (3, 'Admin@', 'setOwner', 21, 1, 'owner'),
        (4, 'Origin@', 'join', 16, 1, 'treasury'),
        (4, 'Origin@', 'remember', 19, 1, 'origin'),
        (4, 'Origin@', 'remember', 19, 1, 'owner'),
        (4, 'Origin@', 'remember', 19, 1, 'tx'),
        (4, 'Origin@', 'setTreasury', 13, 1, 'next'),
        (4, 'Origin@', 'setTreasury', 13, 1, 'treasury'),
        (4, 'Origin@', 'sweep', 22, 1, '20'),
        (4, 'Origin@', 'sweep', 22, 1, 'ierc'),
        (4, 'Origin@', 'sweep', 22, 1, 'origin'),
        (4, 'Origin@', 'sweep', 22, 1, 'token'),
        (4, 'Origin@', 'sweep', 22, 1, 'tx'),
        (5, 'Caller@', 'branched', 13, 1, 'ok'),
        (5, 'Caller@', 'branched', 13, 1, 'to'),
        (5, 'Caller@', 'branched', 13, 2, 'ok'),
        (5, 'Caller@', 'branched', 13, 3, 'revert'),
        (5, 'Caller@', 'dropped', 4, 1, 'to'),
        (5, 'Caller@', 'emitted', 22, 1, 'delegatecall'),
        (5, 'Caller@', 'emitted', 22, 1, 'ok'),
        (5, 'Caller@', 'emitted', 22, 1, 'to'),
        (5, 'Caller@', 'emitted', 22, 2, 'done'),
        (5, 'Caller@', 'emitted', 22, 2, 'ok'),
        (5, 'Caller@', 'required', 10, 1, 'send'),
        (5, 'Caller@', 'required', 10, 1, 'to'),
        (5, 'Caller@', 'returned', 19, 1, 'send'),
        (5, 'Caller@', 'returned', 19, 1, 'to'),
        (5, 'Caller@', 'unused', 7, 1, 'ok'),
        (5, 'Caller@', 'unused', 7, 1, 'to'),
        (6, 'Payer@', 'kept', 13, 1, 'ok'),
        (6, 'Payer@', 'kept', 13, 1, 'to'),
        (6, 'Payer@', 'kept', 13, 1, 'token'),
        (6, 'Payer@', 'loose', 10, 1, 'to'),
        (6, 'Payer@', 'loose', 10, 1, 'token'),
        (6, 'Payer@', 'peek', 22, 1, 'balance'),
        (6, 'Payer@', 'peek', 22, 1, 'of'),
        (6, 'Payer@', 'peek', 22, 1, 'token'),
        (6, 'Payer@', 'peek', 22, 1, 'who'),
        (6, 'Payer@', 'strict', 16, 1, 'to'),
        (6, 'Payer@', 'strict', 16, 1, 'token'),
        (7, 'Assembler@', 'blind', 3, 1, 'assembly'),
        (7, 'Assembler@', 'blind', 3, 2, 'gas'),
        (7, 'Assembler@', 'blind', 3, 2, 'let'),
        (7, 'Assembler@', 'blind', 3, 2, 'to'),
        (7, 'Assembler@', 'seen', 8, 1, 'assembly'),
        (7, 'Assembler@', 'seen', 8, 2, 'case'),
        (7, 'Assembler@', 'seen', 8, 2, 'gas'),
        (7, 'Assembler@', 'seen', 8, 2, 'let'),
        (7, 'Assembler@', 'seen', 8, 2, 'success'),
        (7, 'Assembler@', 'seen', 8, 2, 'switch'),
        (7, 'Assembler@', 'seen', 8, 2, 'to'),
        (7, 'Assembler@', 'seen', 8, 3, 'revert'),
        (8, 'Sums@', 'Sums@', 5, 1, 'supply'),
        (8, 'Sums@', 'mint', 8, 1, 'amount'),
        (8, 'Sums@', 'mint', 8, 1, 'balances'),
        (8, 'Sums@', 'mint', 8, 1, 'to'),
        (8, 'Sums@', 'mint', 8, 2, 'amount'),
        (8, 'Sums@', 'mint', 8, 2, 'supply'),
        (8, 'Sums@', 'move', 12, 1, 'amount'),
        (8, 'Sums@', 'move', 12, 1, 'balances'),
        (8, 'Sums@', 'move', 12, 2, 'amount'),
        (8, 'Sums@', 'move', 12, 2, 'balances'),
        (8, 'Sums@', 'move', 12, 3, 'amount'),
        (8, 'Sums@', 'move', 12, 3, 'balances'),
        (8, 'Sums@', 'move', 12, 3, 'to'),
        (8, 'Sums@', 'move', 12, 4, 'amount'),
        (8, 'Sums@', 'move', 12, 4, 'balances'),
        (8, 'Sums@', 'move', 12, 4, 'to'),
        (8, 'Sums@', 'scale', 18, 1, '256'),
        (9, 'Market@', 'approveSpender', 20, 1, 'allowance'),
        (9, 'Market@', 'approveSpender', 20, 1, 'spender'),
        (9, 'Market@', 'buy', 8, 1, 'price'),
        (9, 'Market@', 'setPrice', 5, 1, 'price'),
        (9, 'Market@', 'swapAll', 11, 1, '256'),
        (9, 'Market@', 'swapAll', 11, 1, 'amount'),
        (9, 'Market@', 'swapAll', 11, 1, 'get'),
        (9, 'Market@', 'swapAll', 11, 1, 'out'),
        (9, 'Market@', 'swapAll', 11, 1, 'quoted'),
        (9, 'Market@', 'swapAll', 11, 1, 'router'),
        (9, 'Market@', 'swapAll', 11, 2, 'amount'),
        (9, 'Market@', 'swapAll', 11, 2, 'quoted'),
        (9, 'Market@', 'swapAll', 11, 2, 'router'),
        (9, 'Market@', 'swapAll', 11, 2, 'swap'),
        (9, 'Market@', 'swapBound', 15, 1, '256'),
        (9, 'Market@', 'swapBound', 15, 1, 'amount'),
        (9, 'Market@', 'swapBound', 15, 1, 'get'),
        (9, 'Market@', 'swapBound', 15, 1, 'out'),
        (9, 'Market@', 'swapBound', 15, 1, 'quoted'),
        (9, 'Market@', 'swapBound', 15, 1, 'router'),
        (9, 'Market@', 'swapBound', 15, 2, 'min'),
        (9, 'Market@', 'swapBound', 15, 2, 'out'),
        (9, 'Market@', 'swapBound', 15, 2, 'quoted'),
        (9, 'Market@', 'swapBound', 15, 3, 'amount'),
        (9, 'Market@', 'swapBound', 15, 3, 'quoted'),
        (9, 'Market@', 'swapBound', 15, 3, 'router'),
        (9, 'Market@', 'swapBound', 15, 3, 'swap'),
    ]),
    'tx15_resolve_spans': ('contract:s fn:s start_line:l end_line:l', [
        (0, 'Vault@', 'deposit', 11, 13),
        (0, 'Vault@', 'guarded', 19, 23),
        (0, 'Vault@', 'orderly', 24, 28),
        (0, 'Vault@', 'withdraw', 14, 18),
        (1, 'Chain@', 'claim', 4, 7),
        (1, 'Chain@', 'lost', 24, 26),
        (1, 'Chain@', 'pay', 11, 14),
        (1, 'Chain@', 'ping', 15, 17),
        (1, 'Chain@', 'ping2', 21, 23),
        (1, 'Chain@', 'pong', 18, 20),
        (1, 'Chain@', 'relay', 8, 10),
        (10, 'Lock@', 'claim', 22, 24),
        (10, 'Lock@', 'note', 28, 30),
        (10, 'Lock@', 'release', 17, 21),
        (10, 'Lock@', 'remaining', 25, 27),
        (10, 'Lock@', 'setEnd', 14, 16),
        (10, 'Lock@', 'setStart', 11, 13),
        (11, 'Odd@', 'f', 7, 17),
        (11, 'Odd@', 'g', 18, 18),
        (12, 'Desk@', '_book', 25, 27),
        (12, 'Desk@', '_push', 37, 41),
        (12, 'Desk@', 'deposit', 13, 16),
        (12, 'Desk@', 'mintAll', 42, 45),
        (12, 'Desk@', 'payLater', 21, 24),
        (12, 'Desk@', 'pull', 17, 20),
        (12, 'Desk@', 'setComptroller', 9, 12),
        (12, 'Desk@', 'settle', 33, 36),
        (12, 'Desk@', 'sweep', 46, 49),
        (12, 'Desk@', 'trade', 28, 32),
        (13, 'Router@', 'issue', 18, 20),
        (13, 'Router@', 'liquidateFor', 24, 27),
        (13, 'Router@', 'mark', 28, 30),
        (13, 'Router@', 'rescue', 21, 23),
        (13, 'Sender@', '_forward', 6, 9),
        (13, 'Sender@', 'half', 10, 12),
        (13, 'Sender@', 'push', 3, 5),
        (14, 'Book@', '_cancelOrder', 28, 30),
        (14, 'Book@', 'cancelExpired', 23, 27),
        (14, 'Book@', 'claimReceipt', 34, 37),
        (14, 'Book@', 'executeOrder', 16, 22),
        (14, 'Book@', 'fillOrder', 31, 33),
        (14, 'Book@', 'placeOrder', 10, 15),
        (15, 'Vesting@', 'accrue', 22, 24),
        (15, 'Vesting@', 'capture', 25, 27),
        (15, 'Vesting@', 'claim', 17, 21),
        (15, 'Vesting@', 'getTime', 7, 9),
        (15, 'Vesting@', 'join', 28, 32),
        (15, 'Vesting@', 'vested', 10, 16),
        (16, 'Farm@', '_sell', 12, 16),
        (16, 'Farm@', 'compound', 8, 11),
        (16, 'Farm@', 'harvest', 4, 7),
        (16, 'Farm@', 'redeem', 17, 20),
        (17, 'Powers@', '_lock', 7, 9),
        (17, 'Powers@', 'cost', 15, 18),
        (17, 'Powers@', 'fill', 10, 14),
        (2, 'Base@', '_grant', 4, 6),
        (2, 'Shop@', '_grant', 15, 17),
        (2, 'Shop@', 'buy', 12, 14),
        (3, 'Admin@', '_apply', 34, 36),
        (3, 'Admin@', 'adjust', 31, 33),
        (3, 'Admin@', 'constructor', 12, 14),
        (3, 'Admin@', 'initialize', 15, 17),
        (3, 'Admin@', 'setFee', 18, 20),
        (3, 'Admin@', 'setFeeChecked', 27, 30),
        (3, 'Admin@', 'setFeeLoose', 24, 26),
        (3, 'Admin@', 'setOwner', 21, 23),
        (4, 'Origin@', 'join', 16, 18),
        (4, 'Origin@', 'remember', 19, 21),
        (4, 'Origin@', 'setTreasury', 13, 15),
        (4, 'Origin@', 'sweep', 22, 24),
        (5, 'Caller@', 'branched', 13, 18),
        (5, 'Caller@', 'dropped', 4, 6),
        (5, 'Caller@', 'emitted', 22, 25),
        (5, 'Caller@', 'required', 10, 12),
        (5, 'Caller@', 'returned', 19, 21),
        (5, 'Caller@', 'unused', 7, 9),
        (6, 'Payer@', 'kept', 13, 15),
        (6, 'Payer@', 'loose', 10, 12),
        (6, 'Payer@', 'peek', 22, 24),
        (6, 'Payer@', 'strict', 16, 21),
        (7, 'Assembler@', 'blind', 3, 7),
        (7, 'Assembler@', 'seen', 8, 14),
        (8, 'Sums@', 'Sums@', 5, 7),
        (8, 'Sums@', 'mint', 8, 11),
        (8, 'Sums@', 'move', 12, 17),
        (8, 'Sums@', 'scale', 18, 21),
        (9, 'Market@', 'approveSpender', 20, 22),
        (9, 'Market@', 'buy', 8, 10),
        (9, 'Market@', 'setPrice', 5, 7),
        (9, 'Market@', 'swapAll', 11, 14),
        (9, 'Market@', 'swapBound', 15, 19),
    ]),
    'tx16_typed_signatures': ('type:s method:s returns:s read_only:b', [
        (0, 'Vault@', 'deposit', '', False),
        (0, 'Vault@', 'guarded', '', False),
        (0, 'Vault@', 'orderly', '', False),
        (0, 'Vault@', 'withdraw', '', False),
        (1, 'Chain@', 'claim', '', False),
        (1, 'Chain@', 'lost', '', False),
        (1, 'Chain@', 'pay', '', False),
        (1, 'Chain@', 'ping', '', False),
        (1, 'Chain@', 'ping2', '', False),
        (1, 'Chain@', 'pong', '', False),
        (1, 'Chain@', 'relay', '', False),
        (10, 'Lock@', 'claim', '', False),
        (10, 'Lock@', 'note', '', False),
        (10, 'Lock@', 'release', '', False),
        (10, 'Lock@', 'remaining', 'uint256', True),
        (10, 'Lock@', 'setend', '', False),
        (10, 'Lock@', 'setstart', '', False),
        (11, 'Odd@', 'f', 'uint256', True),
        (11, 'Odd@', 'g', '', True),
        (12, 'Desk@', '_book', '', False),
        (12, 'Desk@', '_push', '', False),
        (12, 'Desk@', 'deposit', '', False),
        (12, 'Desk@', 'mintall', '', False),
        (12, 'Desk@', 'paylater', '', False),
        (12, 'Desk@', 'pull', '', False),
        (12, 'Desk@', 'setcomptroller', '', False),
        (12, 'Desk@', 'settle', '', False),
        (12, 'Desk@', 'sweep', '', False),
        (12, 'Desk@', 'trade', 'uint256', False),
        (12, 'IComptroller@', 'iscomptroller', 'bool', True),
        (13, 'Router@', 'issue', '', False),
        (13, 'Router@', 'liquidatefor', '', False),
        (13, 'Router@', 'mark', '', False),
        (13, 'Router@', 'rescue', '', False),
        (13, 'Sender@', '_forward', '', False),
        (13, 'Sender@', 'half', 'uint256', True),
        (13, 'Sender@', 'push', '', False),
        (14, 'Book@', '_cancelorder', '', False),
        (14, 'Book@', 'cancelexpired', '', False),
        (14, 'Book@', 'claimreceipt', '', False),
        (14, 'Book@', 'executeorder', '', False),
        (14, 'Book@', 'fillorder', '', False),
        (14, 'Book@', 'placeorder', '', False),
        (15, 'Vesting@', 'accrue', '', False),
        (15, 'Vesting@', 'capture', '', False),
        (15, 'Vesting@', 'claim', '', False),
        (15, 'Vesting@', 'gettime', 'uint256', True),
        (15, 'Vesting@', 'join', '', False),
        (15, 'Vesting@', 'vested', 'uint256', True),
        (16, 'Farm@', '_sell', '', False),
        (16, 'Farm@', 'compound', '', False),
        (16, 'Farm@', 'harvest', '', False),
        (16, 'Farm@', 'redeem', '', False),
        (17, 'Powers@', '_lock', '', False),
        (17, 'Powers@', 'cost', 'uint256', True),
        (17, 'Powers@', 'fill', '', False),
        (2, 'Base@', '_grant', '', False),
        (2, 'IRegistry@', 'lookup', 'uint256', True),
        (2, 'Shop@', '_grant', '', False),
        (2, 'Shop@', 'buy', '', False),
        (3, 'Admin@', '_apply', '', False),
        (3, 'Admin@', 'adjust', '', False),
        (3, 'Admin@', 'initialize', '', False),
        (3, 'Admin@', 'setfee', '', False),
        (3, 'Admin@', 'setfeechecked', '', False),
        (3, 'Admin@', 'setfeeloose', '', False),
        (3, 'Admin@', 'setowner', '', False),
        (4, 'Origin@', 'join', '', False),
        (4, 'Origin@', 'remember', '', False),
        (4, 'Origin@', 'settreasury', '', False),
        (4, 'Origin@', 'sweep', '', False),
        (5, 'Caller@', 'branched', '', False),
        (5, 'Caller@', 'dropped', '', False),
        (5, 'Caller@', 'emitted', '', False),
        (5, 'Caller@', 'required', '', False),
        (5, 'Caller@', 'returned', 'bool', False),
        (5, 'Caller@', 'unused', '', False),
        (6, 'IBase@', 'transfer', 'bool', False),
        (6, 'IToken@', 'balanceof', 'uint256', True),
        (6, 'IToken@', 'transfer', 'bool', False),
        (6, 'Payer@', 'kept', '', False),
        (6, 'Payer@', 'loose', '', False),
        (6, 'Payer@', 'peek', 'uint256', True),
        (6, 'Payer@', 'strict', '', False),
        (7, 'Assembler@', 'blind', '', False),
        (7, 'Assembler@', 'seen', '', False),
        (8, 'Sums@', 'mint', '', False),
        (8, 'Sums@', 'move', '', False),
        (8, 'Sums@', 'scale', 'uint256', True),
        (8, 'Sums@', 'sums@', '', False),
        (9, 'Market@', 'approvespender', '', False),
        (9, 'Market@', 'buy', '', False),
        (9, 'Market@', 'setprice', '', False),
        (9, 'Market@', 'swapall', '', False),
        (9, 'Market@', 'swapbound', '', False),
    ]),
    'gr1_call_edges': ('caller_fn:s line:l callee_fn:s', [
        (1, 'claim', 5, 'relay'),
        (1, 'ping', 16, 'pong'),
        (1, 'ping2', 22, 'pong'),
        (1, 'pong', 19, 'ping2'),
        (1, 'relay', 9, 'pay'),
        (11, 'f', 11, 'g'),
        (12, 'payLater', 23, '_book'),
        (12, 'settle', 34, '_push'),
        (13, 'push', 4, '_forward'),
        (14, 'cancelExpired', 26, '_cancelOrder'),
        (15, 'claim', 18, 'vested'),
        (15, 'join', 29, 'getTime'),
        (15, 'vested', 11, 'getTime'),
        (16, 'compound', 10, '_sell'),
        (2, '_grant', 16, '_grant'),
        (2, 'buy', 13, '_grant'),
        (3, 'adjust', 32, '_apply'),
    ]),
    'gr2_reachable_roots': ('root_fn:s fn:s depth:i', [
        (0, 'deposit', 'deposit', 0),
        (0, 'guarded', 'guarded', 0),
        (0, 'orderly', 'orderly', 0),
        (0, 'withdraw', 'withdraw', 0),
        (1, 'claim', 'claim', 0),
        (1, 'claim', 'pay', 2),
        (1, 'claim', 'relay', 1),
        (1, 'ping', 'ping', 0),
        (1, 'ping', 'ping2', 2),
        (1, 'ping', 'pong', 1),
        (10, 'claim', 'claim', 0),
        (10, 'note', 'note', 0),
        (10, 'release', 'release', 0),
        (10, 'remaining', 'remaining', 0),
        (10, 'setEnd', 'setEnd', 0),
        (10, 'setStart', 'setStart', 0),
        (11, 'f', 'f', 0),
        (11, 'f', 'g', 1),
        (12, 'deposit', 'deposit', 0),
        (12, 'mintAll', 'mintAll', 0),
        (12, 'payLater', '_book', 1),
        (12, 'payLater', 'payLater', 0),
        (12, 'pull', 'pull', 0),
        (12, 'setComptroller', 'setComptroller', 0),
        (12, 'settle', '_push', 1),
        (12, 'settle', 'settle', 0),
        (12, 'sweep', 'sweep', 0),
        (12, 'trade', 'trade', 0),
        (13, 'issue', 'issue', 0),
        (13, 'liquidateFor', 'liquidateFor', 0),
        (13, 'mark', 'mark', 0),
        (13, 'rescue', 'rescue', 0),
        (14, 'cancelExpired', '_cancelOrder', 1),
        (14, 'cancelExpired', 'cancelExpired', 0),
        (14, 'claimReceipt', 'claimReceipt', 0),
        (14, 'executeOrder', 'executeOrder', 0),
        (14, 'fillOrder', 'fillOrder', 0),
        (14, 'placeOrder', 'placeOrder', 0),
        (15, 'accrue', 'accrue', 0),
        (15, 'capture', 'capture', 0),
        (15, 'claim', 'claim', 0),
        (15, 'claim', 'getTime', 2),
        (15, 'claim', 'vested', 1),
        (15, 'getTime', 'getTime', 0),
        (15, 'join', 'getTime', 1),
        (15, 'join', 'join', 0),
        (15, 'vested', 'getTime', 1),
        (15, 'vested', 'vested', 0),
        (16, 'compound', '_sell', 1),
        (16, 'compound', 'compound', 0),
        (16, 'harvest', 'harvest', 0),
        (16, 'redeem', 'redeem', 0),
        (17, 'cost', 'cost', 0),
        (17, 'fill', 'fill', 0),
        (2, 'buy', '_grant', 1),
        (2, 'buy', '_grant', 2),
        (2, 'buy', 'buy', 0),
        (3, 'adjust', '_apply', 1),
        (3, 'adjust', 'adjust', 0),
        (3, 'initialize', 'initialize', 0),
        (3, 'setFee', 'setFee', 0),
        (3, 'setFeeChecked', 'setFeeChecked', 0),
        (3, 'setFeeLoose', 'setFeeLoose', 0),
        (3, 'setOwner', 'setOwner', 0),
        (4, 'join', 'join', 0),
        (4, 'remember', 'remember', 0),
        (4, 'setTreasury', 'setTreasury', 0),
        (4, 'sweep', 'sweep', 0),
        (5, 'branched', 'branched', 0),
        (5, 'dropped', 'dropped', 0),
        (5, 'emitted', 'emitted', 0),
        (5, 'required', 'required', 0),
        (5, 'returned', 'returned', 0),
        (5, 'unused', 'unused', 0),
        (6, 'kept', 'kept', 0),
        (6, 'loose', 'loose', 0),
        (6, 'peek', 'peek', 0),
        (6, 'strict', 'strict', 0),
        (7, 'blind', 'blind', 0),
        (7, 'seen', 'seen', 0),
        (8, 'mint', 'mint', 0),
        (8, 'move', 'move', 0),
        (8, 'scale', 'scale', 0),
        (9, 'approveSpender', 'approveSpender', 0),
        (9, 'buy', 'buy', 0),
        (9, 'setPrice', 'setPrice', 0),
        (9, 'swapAll', 'swapAll', 0),
        (9, 'swapBound', 'swapBound', 0),
    ]),
    'gr3_reachability_paths': ('fn:s path:s', [
        (0, 'deposit', 'deposit'),
        (0, 'guarded', 'guarded'),
        (0, 'orderly', 'orderly'),
        (0, 'withdraw', 'withdraw'),
        (1, 'claim', 'claim'),
        (1, 'pay', 'claim>relay>pay'),
        (1, 'ping', 'ping'),
        (1, 'ping2', 'ping>pong>ping2'),
        (1, 'pong', 'ping>pong'),
        (1, 'relay', 'claim>relay'),
        (10, 'claim', 'claim'),
        (10, 'note', 'note'),
        (10, 'release', 'release'),
        (10, 'remaining', 'remaining'),
        (10, 'setEnd', 'setEnd'),
        (10, 'setStart', 'setStart'),
        (11, 'f', 'f'),
        (11, 'g', 'f>g'),
        (12, '_book', 'payLater>_book'),
        (12, '_push', 'settle>_push'),
        (12, 'deposit', 'deposit'),
        (12, 'mintAll', 'mintAll'),
        (12, 'payLater', 'payLater'),
        (12, 'pull', 'pull'),
        (12, 'setComptroller', 'setComptroller'),
        (12, 'settle', 'settle'),
        (12, 'sweep', 'sweep'),
        (12, 'trade', 'trade'),
        (13, 'issue', 'issue'),
        (13, 'liquidateFor', 'liquidateFor'),
        (13, 'mark', 'mark'),
        (13, 'rescue', 'rescue'),
        (14, '_cancelOrder', 'cancelExpired>_cancelOrder'),
        (14, 'cancelExpired', 'cancelExpired'),
        (14, 'claimReceipt', 'claimReceipt'),
        (14, 'executeOrder', 'executeOrder'),
        (14, 'fillOrder', 'fillOrder'),
        (14, 'placeOrder', 'placeOrder'),
        (15, 'accrue', 'accrue'),
        (15, 'capture', 'capture'),
        (15, 'claim', 'claim'),
        (15, 'getTime', 'getTime'),
        (15, 'join', 'join'),
        (15, 'vested', 'vested'),
        (16, '_sell', 'compound>_sell'),
        (16, 'compound', 'compound'),
        (16, 'harvest', 'harvest'),
        (16, 'redeem', 'redeem'),
        (17, 'cost', 'cost'),
        (17, 'fill', 'fill'),
        (2, '_grant', 'buy>_grant'),
        (2, '_grant', 'buy>_grant>_grant'),
        (2, 'buy', 'buy'),
        (3, '_apply', 'adjust>_apply'),
        (3, 'adjust', 'adjust'),
        (3, 'initialize', 'initialize'),
        (3, 'setFee', 'setFee'),
        (3, 'setFeeChecked', 'setFeeChecked'),
        (3, 'setFeeLoose', 'setFeeLoose'),
        (3, 'setOwner', 'setOwner'),
        (4, 'join', 'join'),
        (4, 'remember', 'remember'),
        (4, 'setTreasury', 'setTreasury'),
        (4, 'sweep', 'sweep'),
        (5, 'branched', 'branched'),
        (5, 'dropped', 'dropped'),
        (5, 'emitted', 'emitted'),
        (5, 'required', 'required'),
        (5, 'returned', 'returned'),
        (5, 'unused', 'unused'),
        (6, 'kept', 'kept'),
        (6, 'loose', 'loose'),
        (6, 'peek', 'peek'),
        (6, 'strict', 'strict'),
        (7, 'blind', 'blind'),
        (7, 'seen', 'seen'),
        (8, 'mint', 'mint'),
        (8, 'move', 'move'),
        (8, 'scale', 'scale'),
        (9, 'approveSpender', 'approveSpender'),
        (9, 'buy', 'buy'),
        (9, 'setPrice', 'setPrice'),
        (9, 'swapAll', 'swapAll'),
        (9, 'swapBound', 'swapBound'),
    ]),
    'gr3_unreachable': ('contract:s fn:s start_line:l', [
        (1, 'Chain@', 'lost', 24),
        (13, 'Sender@', '_forward', 6),
        (13, 'Sender@', 'half', 10),
        (13, 'Sender@', 'push', 3),
        (17, 'Powers@', '_lock', 7),
    ]),
    'gr4_write_closure': ('lines:L fn:s', [
        (0, [12], 'deposit'),
        (0, [17], 'withdraw'),
        (0, [22], 'guarded'),
        (0, [25], 'orderly'),
        (1, [25], 'lost'),
        (1, [6], 'claim'),
        (10, [12], 'setStart'),
        (10, [15], 'setEnd'),
        (10, [23], 'claim'),
        (12, [11], 'setComptroller'),
        (12, [15], 'deposit'),
        (12, [19], 'pull'),
        (12, [26], '_book'),
        (12, [26], 'payLater'),
        (12, [35], 'settle'),
        (12, [44], 'mintAll'),
        (13, [19], 'issue'),
        (13, [25], 'liquidateFor'),
        (13, [29], 'mark'),
        (14, [12, 13, 14], 'placeOrder'),
        (14, [17, 19], 'executeOrder'),
        (14, [24], 'cancelExpired'),
        (14, [32], 'fillOrder'),
        (14, [36], 'claimReceipt'),
        (15, [19], 'claim'),
        (15, [23], 'accrue'),
        (15, [26], 'capture'),
        (17, [8], '_lock'),
        (2, [5], '_grant'),
        (2, [5], '_grant'),
        (2, [5], 'buy'),
        (3, [13], 'constructor'),
        (3, [16], 'initialize'),
        (3, [19], 'setFee'),
        (3, [22], 'setOwner'),
        (3, [25], 'setFeeLoose'),
        (3, [29], 'setFeeChecked'),
        (3, [35], '_apply'),
        (3, [35], 'adjust'),
        (4, [14], 'setTreasury'),
        (4, [17], 'join'),
        (4, [20], 'remember'),
        (6, [14], 'kept'),
        (8, [14, 16], 'move'),
        (8, [6], 'Sums@'),
        (8, [9, 10], 'mint'),
        (9, [21], 'approveSpender'),
        (9, [6], 'setPrice'),
    ]),
    'gr6_helper_neighbourhood': ('hops:i fn:s', [
        (0, 0, 'guarded'),
        (0, 0, 'orderly'),
        (0, 0, 'withdraw'),
        (1, 0, 'pay'),
        (12, 0, '_push'),
        (12, 0, 'deposit'),
        (12, 0, 'pull'),
        (12, 0, 'sweep'),
        (12, 0, 'trade'),
        (13, 0, '_forward'),
        (13, 0, 'liquidateFor'),
        (13, 0, 'rescue'),
        (14, 0, 'executeOrder'),
        (15, 0, 'claim'),
        (15, 1, 'vested'),
        (15, 2, 'getTime'),
        (16, 0, '_sell'),
        (16, 0, 'redeem'),
        (17, 0, 'fill'),
        (5, 0, 'branched'),
        (5, 0, 'dropped'),
        (5, 0, 'emitted'),
        (5, 0, 'required'),
        (5, 0, 'returned'),
        (5, 0, 'unused'),
        (6, 0, 'kept'),
        (6, 0, 'loose'),
        (6, 0, 'strict'),
    ]),
    'gr6_public_callers': ('fn:s callers:S', [
        (1, 'pay', ['claim']),
        (1, 'ping2', ['ping']),
        (1, 'pong', ['ping']),
        (1, 'relay', ['claim']),
        (11, 'g', ['f']),
        (12, '_book', ['payLater']),
        (12, '_push', ['settle']),
        (14, '_cancelOrder', ['cancelExpired']),
        (15, 'getTime', ['claim', 'join', 'vested']),
        (15, 'vested', ['claim']),
        (16, '_sell', ['compound']),
        (2, '_grant', ['buy']),
        (2, '_grant', ['buy']),
        (3, '_apply', ['adjust']),
    ]),
    'gr7_rw_conflicts': ('contract:s name:s writer:s reader:s financial:b', [
        (10, 'Lock@', 'balances', 'claim', 'release', True),
        (10, 'Lock@', 'end', 'setEnd', 'release', False),
        (10, 'Lock@', 'end', 'setEnd', 'remaining', False),
        (12, 'Desk@', 'total', 'pull', 'mintAll', False),
        (12, 'Desk@', 'total', 'settle', 'mintAll', False),
        (8, 'Sums@', 'balances', 'mint', 'move', False),
        (9, 'Market@', 'price', 'setPrice', 'buy', True),
    ]),
    'gr10_guarded_actions': ('fn:s guard_line:l action:s action_line:l', [
        (10, 'release', 19, 'asset', 20),
        (14, 'executeOrder', 18, 'asset', 20),
    ]),
    'gr11_economic_bindings': ('fn:s line:l sink_line:l word:s', [
        (16, '_sell', 13, 15, 'quoted'),
        (17, 'fill', 11, 13, 'price'),
        (9, 'swapAll', 12, 13, 'amount'),
        (9, 'swapBound', 16, 18, 'amount'),
        (9, 'swapBound', 17, 18, 'quoted'),
    ]),
    'ef1_direct_effects': ('fn:s line:l end_line:l kind:s method:s receiver:s low_level:b asset_call:b callback_capable:b inherited:b economic:b dynamic_amount:b library_call:b', [
        (0, 'deposit', 12, 12, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (0, 'guarded', 20, 20, 'external_call', 'call', 'sender', True, True, True, False, False, False, False),
        (0, 'guarded', 22, 22, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (0, 'orderly', 25, 25, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (0, 'orderly', 26, 26, 'external_call', 'call', 'sender', True, True, True, False, False, False, False),
        (0, 'withdraw', 15, 15, 'external_call', 'call', 'sender', True, True, True, False, False, False, False),
        (0, 'withdraw', 17, 17, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (1, 'claim', 6, 6, 'state_write', '', 'credit', False, False, False, False, False, False, False),
        (1, 'lost', 25, 25, 'state_write', '', 'credit', False, False, False, False, False, False, False),
        (1, 'pay', 12, 12, 'external_call', 'call', 'sender', True, True, True, False, False, False, False),
        (10, 'claim', 23, 23, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (10, 'release', 20, 20, 'external_call', 'transfer', 'payable', False, True, True, False, False, True, False),
        (10, 'setEnd', 15, 15, 'state_write', '', 'end', False, False, False, False, False, False, False),
        (10, 'setStart', 12, 12, 'state_write', '', 'start', False, False, False, False, False, False, False),
        (12, '_book', 26, 26, 'state_write', '', 'total', False, False, False, False, False, False, False),
        (12, '_push', 39, 39, 'external_call', 'call', 'payee', True, True, True, False, False, False, False),
        (12, 'deposit', 14, 14, 'external_call', 'transferFrom', 'token', False, True, True, False, False, True, False),
        (12, 'deposit', 15, 15, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (12, 'mintAll', 44, 44, 'state_write', '', 'total', False, False, False, False, False, False, False),
        (12, 'payLater', 22, 22, 'external_call', 'safeTransfer', 'token', False, True, True, False, False, True, False),
        (12, 'pull', 18, 18, 'external_call', 'transfer', 'token', False, True, True, False, False, True, False),
        (12, 'pull', 19, 19, 'state_write', '', 'total', False, False, False, False, False, False, False),
        (12, 'setComptroller', 11, 11, 'state_write', '', 'comptroller', False, False, False, False, False, False, False),
        (12, 'settle', 35, 35, 'state_write', '', 'total', False, False, False, False, False, False, False),
        (12, 'sweep', 47, 47, 'external_call', 'safeTransferFrom', 'token', False, True, False, False, False, False, False),
        (12, 'sweep', 48, 48, 'external_call', 'deposit', 'vault', False, True, True, False, False, False, False),
        (12, 'trade', 29, 29, 'external_call', 'call', 'target', True, True, True, False, False, False, False),
        (13, '_forward', 7, 7, 'external_call', 'call', 'to', True, True, True, False, False, False, False),
        (13, 'issue', 19, 19, 'state_write', '', 'totalSupply', False, False, False, False, False, False, False),
        (13, 'liquidateFor', 25, 25, 'state_write', '', 'positions', False, False, False, False, False, False, False),
        (13, 'liquidateFor', 26, 26, 'external_call', 'liquidate', 'perp', False, True, True, False, False, True, False),
        (13, 'mark', 29, 29, 'state_write', '', 'marker', False, False, False, False, False, False, False),
        (13, 'rescue', 22, 22, 'external_call', 'transfer', 'asset', False, True, True, False, False, True, False),
        (14, '_cancelOrder', 29, 29, 'state_write', '', 'orders', False, False, False, False, False, False, False),
        (14, 'claimReceipt', 36, 36, 'state_write', '', 'last', False, False, False, False, False, False, False),
        (14, 'executeOrder', 20, 20, 'external_call', 'transfer', 'token', False, True, True, False, False, False, False),
        (14, 'fillOrder', 32, 32, 'state_write', '', 'last', False, False, False, False, False, False, False),
        (15, 'accrue', 23, 23, 'state_write', '', 'rewardStored', False, False, False, False, False, False, False),
        (15, 'capture', 26, 26, 'state_write', '', 'unlockAt', False, False, False, False, False, False, False),
        (15, 'claim', 19, 19, 'state_write', '', 'claimed', False, False, False, False, False, False, False),
        (15, 'claim', 20, 20, 'external_call', 'transfer', 'token', False, True, True, False, False, True, False),
        (16, '_sell', 14, 14, 'external_call', 'swapExactTokens', 'router', False, False, True, False, False, True, False),
        (16, '_sell', 15, 15, 'external_call', 'deposit', 'pool', False, True, True, False, False, True, False),
        (16, 'harvest', 6, 6, 'external_call', 'swapExactTokens', 'router', False, False, True, False, False, True, False),
        (16, 'redeem', 18, 18, 'external_call', 'value', 'oracle', False, False, True, False, False, True, False),
        (16, 'redeem', 19, 19, 'external_call', 'transfer', 'token', False, True, True, False, False, True, False),
        (17, '_lock', 8, 8, 'state_write', '', 'locks', False, False, False, False, False, False, False),
        (17, 'fill', 13, 13, 'external_call', 'transfer', 'token', False, True, True, False, False, True, False),
        (2, '_grant', 16, 16, 'state_write', '_grant', 'super', False, False, False, True, False, False, False),
        (2, '_grant', 5, 5, 'state_write', '', 'shares', False, False, False, False, False, False, False),
        (3, '_apply', 35, 35, 'state_write', '', 'fee', False, False, False, False, False, False, False),
        (3, 'constructor', 13, 13, 'state_write', '', 'owner', False, False, False, False, False, False, False),
        (3, 'initialize', 16, 16, 'state_write', '', 'owner', False, False, False, False, False, False, False),
        (3, 'setFee', 19, 19, 'state_write', '', 'fee', False, False, False, False, False, False, False),
        (3, 'setFeeChecked', 29, 29, 'state_write', '', 'fee', False, False, False, False, False, False, False),
        (3, 'setFeeLoose', 25, 25, 'state_write', '', 'fee', False, False, False, False, False, False, False),
        (3, 'setOwner', 22, 22, 'state_write', '', 'owner', False, False, False, False, False, False, False),
        (4, 'join', 17, 17, 'state_write', '', 'treasury', False, False, False, False, False, False, False),
        (4, 'remember', 20, 20, 'state_write', '', 'owner', False, False, False, False, False, False, False),
        (4, 'setTreasury', 14, 14, 'state_write', '', 'treasury', False, False, False, False, False, False, False),
        (4, 'sweep', 23, 23, 'external_call', 'transfer', 'IERC20', False, True, True, False, False, False, False),
        (5, 'branched', 14, 14, 'external_call', 'call', 'to', True, False, True, False, False, True, False),
        (5, 'dropped', 5, 5, 'external_call', 'call', 'to', True, False, True, False, False, True, False),
        (5, 'emitted', 23, 23, 'external_call', 'delegatecall', 'to', True, False, True, False, False, True, False),
        (5, 'required', 11, 11, 'external_call', 'send', 'payable', True, True, True, False, False, False, False),
        (5, 'returned', 20, 20, 'external_call', 'send', 'payable', True, True, True, False, False, False, False),
        (5, 'unused', 8, 8, 'external_call', 'call', 'to', True, False, True, False, False, True, False),
        (6, 'kept', 14, 14, 'external_call', 'transfer', 'token', False, True, True, False, False, True, False),
        (6, 'loose', 11, 11, 'external_call', 'transfer', 'token', False, True, True, False, False, True, False),
        (6, 'strict', 17, 20, 'external_call', 'transfer', 'token', False, True, True, False, False, True, False),
        (8, 'Sums@', 6, 6, 'state_write', '', 'supply', False, False, False, False, False, False, False),
        (8, 'mint', 10, 10, 'state_write', '', 'supply', False, False, False, False, False, False, False),
        (8, 'mint', 9, 9, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (8, 'move', 14, 14, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (8, 'move', 16, 16, 'state_write', '', 'balances', False, False, False, False, False, False, False),
        (9, 'buy', 9, 9, 'external_call', 'transfer', 'payable', False, True, True, False, False, True, False),
        (9, 'setPrice', 6, 6, 'state_write', '', 'price', False, False, False, False, False, False, False),
        (9, 'swapAll', 13, 13, 'external_call', 'swap', 'IRouter', False, True, True, False, False, True, False),
        (9, 'swapBound', 18, 18, 'external_call', 'swap', 'IRouter', False, True, True, False, False, True, False),
    ]),
    'ef3_state_write_lines': ('contract:s fn:s line:l critical:b names:S', [
        (0, 'Vault@', 'deposit', 12, True, ['balances']),
        (0, 'Vault@', 'guarded', 22, True, ['balances']),
        (0, 'Vault@', 'orderly', 25, True, ['balances']),
        (0, 'Vault@', 'withdraw', 17, True, ['balances']),
        (1, 'Chain@', 'claim', 6, True, ['credit']),
        (1, 'Chain@', 'lost', 25, True, ['credit']),
        (10, 'Lock@', 'claim', 23, True, ['balances']),
        (10, 'Lock@', 'setEnd', 15, False, ['end']),
        (10, 'Lock@', 'setStart', 12, False, ['start']),
        (12, 'Desk@', '_book', 26, False, ['total']),
        (12, 'Desk@', 'deposit', 15, True, ['balances']),
        (12, 'Desk@', 'mintAll', 44, False, ['total']),
        (12, 'Desk@', 'pull', 19, False, ['total']),
        (12, 'Desk@', 'setComptroller', 11, False, ['comptroller']),
        (12, 'Desk@', 'settle', 35, False, ['total']),
        (13, 'Router@', 'issue', 19, False, ['totalSupply']),
        (13, 'Router@', 'liquidateFor', 25, False, ['positions']),
        (13, 'Router@', 'mark', 29, False, ['marker']),
        (14, 'Book@', 'cancelExpired', 24, False, ['orders']),
        (14, 'Book@', 'claimReceipt', 36, False, ['last']),
        (14, 'Book@', 'executeOrder', 17, False, ['orders']),
        (14, 'Book@', 'executeOrder', 19, False, []),
        (14, 'Book@', 'fillOrder', 32, False, ['last']),
        (14, 'Book@', 'placeOrder', 12, False, ['orders']),
        (14, 'Book@', 'placeOrder', 13, False, []),
        (14, 'Book@', 'placeOrder', 14, False, []),
        (15, 'Vesting@', 'accrue', 23, True, ['rewardStored', 'start']),
        (15, 'Vesting@', 'capture', 26, False, ['unlockAt']),
        (15, 'Vesting@', 'claim', 19, False, ['claimed']),
        (17, 'Powers@', '_lock', 8, False, ['locks']),
        (2, 'Base@', '_grant', 5, True, ['shares']),
        (3, 'Admin@', '_apply', 35, True, ['fee']),
        (3, 'Admin@', 'constructor', 13, True, ['owner']),
        (3, 'Admin@', 'initialize', 16, True, ['owner']),
        (3, 'Admin@', 'setFee', 19, True, ['fee']),
        (3, 'Admin@', 'setFeeChecked', 29, True, ['fee']),
        (3, 'Admin@', 'setFeeLoose', 25, True, ['fee']),
        (3, 'Admin@', 'setOwner', 22, True, ['owner']),
        (4, 'Origin@', 'join', 17, True, ['treasury']),
        (4, 'Origin@', 'remember', 20, True, ['owner']),
        (4, 'Origin@', 'setTreasury', 14, True, ['treasury']),
        (6, 'Payer@', 'kept', 14, True, ['token']),
        (8, 'Sums@', 'Sums@', 6, True, ['supply']),
        (8, 'Sums@', 'mint', 10, True, ['supply']),
        (8, 'Sums@', 'mint', 9, True, ['balances']),
        (8, 'Sums@', 'move', 14, True, ['balances']),
        (8, 'Sums@', 'move', 16, True, ['balances']),
        (9, 'Market@', 'approveSpender', 21, True, []),
        (9, 'Market@', 'setPrice', 6, False, ['price']),
    ]),
    'ef5_external_calls': ('contract:s fn:s line:l method:s', [
        (0, 'Vault@', 'guarded', 20, 'call'),
        (0, 'Vault@', 'orderly', 26, 'call'),
        (0, 'Vault@', 'withdraw', 15, 'call'),
        (1, 'Chain@', 'pay', 12, 'call'),
        (12, 'Desk@', '_push', 39, 'call'),
        (12, 'Desk@', 'deposit', 14, 'transferfrom'),
        (12, 'Desk@', 'pull', 18, 'transfer'),
        (12, 'Desk@', 'sweep', 48, 'deposit'),
        (12, 'Desk@', 'trade', 29, 'call'),
        (13, 'Router@', 'liquidateFor', 26, 'liquidate'),
        (13, 'Router@', 'rescue', 22, 'transfer'),
        (13, 'Sender@', '_forward', 7, 'call'),
        (14, 'Book@', 'executeOrder', 20, 'transfer'),
        (15, 'Vesting@', 'claim', 20, 'transfer'),
        (16, 'Farm@', '_sell', 15, 'deposit'),
        (16, 'Farm@', 'redeem', 19, 'transfer'),
        (17, 'Powers@', 'fill', 13, 'transfer'),
        (5, 'Caller@', 'branched', 14, 'call'),
        (5, 'Caller@', 'dropped', 5, 'call'),
        (5, 'Caller@', 'emitted', 23, 'delegatecall'),
        (5, 'Caller@', 'required', 11, ''),
        (5, 'Caller@', 'returned', 20, ''),
        (5, 'Caller@', 'unused', 8, 'call'),
        (6, 'Payer@', 'kept', 14, 'transfer'),
        (6, 'Payer@', 'loose', 11, 'transfer'),
        (6, 'Payer@', 'strict', 18, 'transfer'),
    ]),
    'ef6_runtime_events': ('root_fn:s step:i kind:s line:l', [
        (0, 'deposit', 1, 'write', 12),
        (0, 'guarded', 1, 'call', 20),
        (0, 'guarded', 2, 'write', 22),
        (0, 'orderly', 1, 'write', 25),
        (0, 'orderly', 2, 'call', 26),
        (0, 'withdraw', 1, 'call', 15),
        (0, 'withdraw', 2, 'write', 17),
        (1, 'claim', 1, 'call', 12),
        (1, 'claim', 2, 'write', 6),
        (10, 'claim', 1, 'write', 23),
        (10, 'setEnd', 1, 'write', 15),
        (10, 'setStart', 1, 'write', 12),
        (12, 'deposit', 1, 'call', 14),
        (12, 'deposit', 2, 'write', 15),
        (12, 'mintAll', 1, 'write', 44),
        (12, 'payLater', 1, 'write', 26),
        (12, 'pull', 1, 'call', 18),
        (12, 'pull', 2, 'write', 19),
        (12, 'setComptroller', 1, 'write', 11),
        (12, 'settle', 1, 'call', 39),
        (12, 'settle', 2, 'write', 35),
        (12, 'sweep', 1, 'call', 48),
        (12, 'trade', 1, 'call', 29),
        (13, 'issue', 1, 'write', 19),
        (13, 'liquidateFor', 1, 'write', 25),
        (13, 'liquidateFor', 2, 'call', 26),
        (13, 'mark', 1, 'write', 29),
        (13, 'rescue', 1, 'call', 22),
        (14, 'cancelExpired', 1, 'write', 24),
        (14, 'claimReceipt', 1, 'write', 36),
        (14, 'executeOrder', 1, 'write', 17),
        (14, 'executeOrder', 2, 'write', 19),
        (14, 'executeOrder', 3, 'call', 20),
        (14, 'fillOrder', 1, 'write', 32),
        (14, 'placeOrder', 1, 'write', 12),
        (14, 'placeOrder', 2, 'write', 13),
        (14, 'placeOrder', 3, 'write', 14),
        (15, 'accrue', 1, 'write', 23),
        (15, 'capture', 1, 'write', 26),
        (15, 'claim', 1, 'write', 19),
        (15, 'claim', 2, 'call', 20),
        (16, 'compound', 1, 'call', 15),
        (16, 'redeem', 1, 'call', 19),
        (17, 'fill', 1, 'call', 13),
        (2, 'buy', 1, 'write', 5),
        (3, 'adjust', 1, 'write', 35),
        (3, 'initialize', 1, 'write', 16),
        (3, 'setFee', 1, 'write', 19),
        (3, 'setFeeChecked', 1, 'write', 29),
        (3, 'setFeeLoose', 1, 'write', 25),
        (3, 'setOwner', 1, 'write', 22),
        (4, 'join', 1, 'write', 17),
        (4, 'remember', 1, 'write', 20),
        (4, 'setTreasury', 1, 'write', 14),
        (5, 'branched', 1, 'call', 14),
        (5, 'dropped', 1, 'call', 5),
        (5, 'emitted', 1, 'call', 23),
        (5, 'required', 1, 'call', 11),
        (5, 'returned', 1, 'call', 20),
        (5, 'unused', 1, 'call', 8),
        (6, 'kept', 1, 'call', 14),
        (6, 'kept', 2, 'write', 14),
        (6, 'loose', 1, 'call', 11),
        (6, 'strict', 1, 'call', 18),
        (8, 'mint', 1, 'write', 9),
        (8, 'mint', 2, 'write', 10),
        (8, 'move', 1, 'write', 14),
        (8, 'move', 2, 'write', 16),
        (9, 'approveSpender', 1, 'write', 21),
        (9, 'setPrice', 1, 'write', 6),
    ]),
    'ef7_reentrancy_summary': ('call_line:l write_line:l cross_lines:L fn:s mutex:b reentrant_order:b cei_complete:b', [
        (0, 15, 17, [], 'withdraw', False, True, False),
        (0, 20, 22, [], 'guarded', True, True, False),
        (0, 26, None, [], 'orderly', False, False, True),
        (0, None, None, [], 'deposit', False, False, False),
        (1, 12, 6, [], 'claim', False, True, False),
        (10, None, None, [], 'claim', False, False, False),
        (10, None, None, [], 'setEnd', False, False, False),
        (10, None, None, [], 'setStart', False, False, False),
        (12, 14, 15, [], 'deposit', False, True, False),
        (12, 18, 19, [], 'pull', False, True, False),
        (12, 29, None, [], 'trade', False, False, True),
        (12, 39, 35, [], 'settle', False, True, False),
        (12, 48, None, [], 'sweep', False, False, True),
        (12, None, None, [26], 'payLater', False, False, False),
        (12, None, None, [], 'mintAll', False, False, False),
        (12, None, None, [], 'setComptroller', False, False, False),
        (13, 22, None, [], 'rescue', False, False, True),
        (13, 26, None, [], 'liquidateFor', False, False, True),
        (13, None, None, [], 'issue', False, False, False),
        (13, None, None, [], 'mark', False, False, False),
        (14, 20, None, [], 'executeOrder', False, False, True),
        (14, None, None, [], 'cancelExpired', False, False, False),
        (14, None, None, [], 'claimReceipt', False, False, False),
        (14, None, None, [], 'fillOrder', False, False, False),
        (14, None, None, [], 'placeOrder', False, False, False),
        (15, 20, None, [], 'claim', False, False, True),
        (15, None, None, [], 'accrue', False, False, False),
        (15, None, None, [], 'capture', False, False, False),
        (16, 15, None, [], 'compound', False, False, True),
        (16, 19, None, [], 'redeem', False, False, True),
        (17, 13, None, [], 'fill', False, False, True),
        (2, None, None, [5], 'buy', False, False, False),
        (3, None, None, [35], 'adjust', False, False, False),
        (3, None, None, [], 'initialize', False, False, False),
        (3, None, None, [], 'setFee', False, False, False),
        (3, None, None, [], 'setFeeChecked', False, False, False),
        (3, None, None, [], 'setFeeLoose', False, False, False),
        (3, None, None, [], 'setOwner', False, False, False),
        (4, None, None, [], 'join', False, False, False),
        (4, None, None, [], 'remember', False, False, False),
        (4, None, None, [], 'setTreasury', False, False, False),
        (5, 11, None, [], 'required', False, False, True),
        (5, 14, None, [], 'branched', False, False, True),
        (5, 20, None, [], 'returned', False, False, True),
        (5, 23, None, [], 'emitted', False, False, True),
        (5, 5, None, [], 'dropped', False, False, True),
        (5, 8, None, [], 'unused', False, False, True),
        (6, 11, None, [], 'loose', False, False, True),
        (6, 14, 14, [], 'kept', False, True, False),
        (6, 18, None, [], 'strict', False, False, True),
        (8, None, None, [], 'mint', False, False, False),
        (8, None, None, [], 'move', False, False, False),
        (9, None, None, [], 'approveSpender', False, False, False),
        (9, None, None, [], 'setPrice', False, False, False),
    ]),
    'ef9_loop_features': ('fn:s line:l unbounded:b sends:b calls:b', [
        (11, 'f', 15, True, False, False),
    ]),
    'gu1_authorization': ('contract:s fn:s start_line:l auth_status:s auth_lines:L', [
        (0, 'Vault@', 'deposit', 11, 'none', []),
        (0, 'Vault@', 'guarded', 19, 'none', []),
        (0, 'Vault@', 'orderly', 24, 'none', []),
        (0, 'Vault@', 'withdraw', 14, 'none', []),
        (1, 'Chain@', 'claim', 4, 'none', []),
        (1, 'Chain@', 'lost', 24, 'none', []),
        (1, 'Chain@', 'pay', 11, 'none', []),
        (1, 'Chain@', 'ping', 15, 'none', []),
        (1, 'Chain@', 'ping2', 21, 'none', []),
        (1, 'Chain@', 'pong', 18, 'none', []),
        (1, 'Chain@', 'relay', 8, 'none', []),
        (10, 'Lock@', 'claim', 22, 'none', []),
        (10, 'Lock@', 'note', 28, 'none', []),
        (10, 'Lock@', 'release', 17, 'none', []),
        (10, 'Lock@', 'remaining', 25, 'none', []),
        (10, 'Lock@', 'setEnd', 14, 'none', []),
        (10, 'Lock@', 'setStart', 11, 'none', []),
        (11, 'Odd@', 'f', 7, 'none', []),
        (11, 'Odd@', 'g', 18, 'none', []),
        (12, 'Desk@', '_book', 25, 'none', []),
        (12, 'Desk@', '_push', 37, 'none', []),
        (12, 'Desk@', 'deposit', 13, 'none', []),
        (12, 'Desk@', 'mintAll', 42, 'none', []),
        (12, 'Desk@', 'payLater', 21, 'none', []),
        (12, 'Desk@', 'pull', 17, 'none', []),
        (12, 'Desk@', 'setComptroller', 9, 'none', []),
        (12, 'Desk@', 'settle', 33, 'none', []),
        (12, 'Desk@', 'sweep', 46, 'none', []),
        (12, 'Desk@', 'trade', 28, 'none', []),
        (13, 'Router@', 'issue', 18, 'none', []),
        (13, 'Router@', 'liquidateFor', 24, 'none', []),
        (13, 'Router@', 'mark', 28, 'none', []),
        (13, 'Router@', 'rescue', 21, 'none', []),
        (13, 'Sender@', '_forward', 6, 'none', []),
        (13, 'Sender@', 'half', 10, 'none', []),
        (13, 'Sender@', 'push', 3, 'none', []),
        (14, 'Book@', '_cancelOrder', 28, 'none', []),
        (14, 'Book@', 'cancelExpired', 23, 'none', []),
        (14, 'Book@', 'claimReceipt', 34, 'none', []),
        (14, 'Book@', 'executeOrder', 16, 'none', []),
        (14, 'Book@', 'fillOrder', 31, 'none', []),
        (14, 'Book@', 'placeOrder', 10, 'none', []),
        (15, 'Vesting@', 'accrue', 22, 'none', []),
        (15, 'Vesting@', 'capture', 25, 'none', []),
        (15, 'Vesting@', 'claim', 17, 'none', []),
        (15, 'Vesting@', 'getTime', 7, 'none', []),
        (15, 'Vesting@', 'join', 28, 'none', []),
        (15, 'Vesting@', 'vested', 10, 'none', []),
        (16, 'Farm@', '_sell', 12, 'none', []),
        (16, 'Farm@', 'compound', 8, 'none', []),
        (16, 'Farm@', 'harvest', 4, 'none', []),
        (16, 'Farm@', 'redeem', 17, 'none', []),
        (17, 'Powers@', '_lock', 7, 'none', []),
        (17, 'Powers@', 'cost', 15, 'none', []),
        (17, 'Powers@', 'fill', 10, 'none', []),
        (2, 'Base@', '_grant', 4, 'none', []),
        (2, 'Shop@', '_grant', 15, 'none', []),
        (2, 'Shop@', 'buy', 12, 'none', []),
        (3, 'Admin@', '_apply', 34, 'none', []),
        (3, 'Admin@', 'adjust', 31, 'none', []),
        (3, 'Admin@', 'constructor', 12, 'none', []),
        (3, 'Admin@', 'initialize', 15, 'none', []),
        (3, 'Admin@', 'setFee', 18, 'effective_identity', [5]),
        (3, 'Admin@', 'setFeeChecked', 27, 'effective_identity', [28]),
        (3, 'Admin@', 'setFeeLoose', 24, 'unclassified_only_modifier', [24]),
        (3, 'Admin@', 'setOwner', 21, 'none', []),
        (4, 'Origin@', 'join', 16, 'none', []),
        (4, 'Origin@', 'remember', 19, 'tx_origin_identity', [20]),
        (4, 'Origin@', 'setTreasury', 13, 'effective_identity', [5]),
        (4, 'Origin@', 'sweep', 22, 'tx_origin_identity', [23]),
        (5, 'Caller@', 'branched', 13, 'none', []),
        (5, 'Caller@', 'dropped', 4, 'none', []),
        (5, 'Caller@', 'emitted', 22, 'none', []),
        (5, 'Caller@', 'required', 10, 'none', []),
        (5, 'Caller@', 'returned', 19, 'none', []),
        (5, 'Caller@', 'unused', 7, 'none', []),
        (6, 'Payer@', 'kept', 13, 'none', []),
        (6, 'Payer@', 'loose', 10, 'none', []),
        (6, 'Payer@', 'peek', 22, 'none', []),
        (6, 'Payer@', 'strict', 16, 'none', []),
        (7, 'Assembler@', 'blind', 3, 'none', []),
        (7, 'Assembler@', 'seen', 8, 'none', []),
        (8, 'Sums@', 'Sums@', 5, 'none', []),
        (8, 'Sums@', 'mint', 8, 'none', []),
        (8, 'Sums@', 'move', 12, 'none', []),
        (8, 'Sums@', 'scale', 18, 'none', []),
        (9, 'Market@', 'approveSpender', 20, 'none', []),
        (9, 'Market@', 'buy', 8, 'none', []),
        (9, 'Market@', 'setPrice', 5, 'none', []),
        (9, 'Market@', 'swapAll', 11, 'none', []),
        (9, 'Market@', 'swapBound', 15, 'none', []),
    ]),
    'gu2_admin_restricted': ('contract:s fn:s restricted:b', [
        (0, 'Vault@', 'deposit', False),
        (0, 'Vault@', 'guarded', False),
        (0, 'Vault@', 'orderly', False),
        (0, 'Vault@', 'withdraw', False),
        (1, 'Chain@', 'claim', False),
        (1, 'Chain@', 'lost', True),
        (1, 'Chain@', 'pay', True),
        (1, 'Chain@', 'ping', False),
        (1, 'Chain@', 'ping2', True),
        (1, 'Chain@', 'pong', True),
        (1, 'Chain@', 'relay', True),
        (10, 'Lock@', 'claim', False),
        (10, 'Lock@', 'note', False),
        (10, 'Lock@', 'release', False),
        (10, 'Lock@', 'remaining', False),
        (10, 'Lock@', 'setEnd', False),
        (10, 'Lock@', 'setStart', False),
        (11, 'Odd@', 'f', False),
        (11, 'Odd@', 'g', True),
        (12, 'Desk@', '_book', True),
        (12, 'Desk@', '_push', True),
        (12, 'Desk@', 'deposit', False),
        (12, 'Desk@', 'mintAll', False),
        (12, 'Desk@', 'payLater', False),
        (12, 'Desk@', 'pull', False),
        (12, 'Desk@', 'setComptroller', False),
        (12, 'Desk@', 'settle', False),
        (12, 'Desk@', 'sweep', False),
        (12, 'Desk@', 'trade', False),
        (13, 'Router@', 'issue', False),
        (13, 'Router@', 'liquidateFor', False),
        (13, 'Router@', 'mark', False),
        (13, 'Router@', 'rescue', False),
        (13, 'Sender@', '_forward', True),
        (13, 'Sender@', 'half', True),
        (13, 'Sender@', 'push', True),
        (14, 'Book@', '_cancelOrder', True),
        (14, 'Book@', 'cancelExpired', False),
        (14, 'Book@', 'claimReceipt', False),
        (14, 'Book@', 'executeOrder', False),
        (14, 'Book@', 'fillOrder', False),
        (14, 'Book@', 'placeOrder', False),
        (15, 'Vesting@', 'accrue', False),
        (15, 'Vesting@', 'capture', False),
        (15, 'Vesting@', 'claim', False),
        (15, 'Vesting@', 'getTime', False),
        (15, 'Vesting@', 'join', False),
        (15, 'Vesting@', 'vested', False),
        (16, 'Farm@', '_sell', True),
        (16, 'Farm@', 'compound', False),
        (16, 'Farm@', 'harvest', False),
        (16, 'Farm@', 'redeem', False),
        (17, 'Powers@', '_lock', True),
        (17, 'Powers@', 'cost', False),
        (17, 'Powers@', 'fill', False),
        (2, 'Base@', '_grant', True),
        (2, 'Shop@', '_grant', True),
        (2, 'Shop@', 'buy', False),
        (3, 'Admin@', '_apply', True),
        (3, 'Admin@', 'adjust', False),
        (3, 'Admin@', 'constructor', False),
        (3, 'Admin@', 'initialize', False),
        (3, 'Admin@', 'setFee', True),
        (3, 'Admin@', 'setFeeChecked', True),
        (3, 'Admin@', 'setFeeLoose', False),
        (3, 'Admin@', 'setOwner', False),
        (4, 'Origin@', 'join', False),
        (4, 'Origin@', 'remember', False),
        (4, 'Origin@', 'setTreasury', False),
        (4, 'Origin@', 'sweep', False),
        (5, 'Caller@', 'branched', False),
        (5, 'Caller@', 'dropped', False),
        (5, 'Caller@', 'emitted', False),
        (5, 'Caller@', 'required', False),
        (5, 'Caller@', 'returned', False),
        (5, 'Caller@', 'unused', False),
        (6, 'Payer@', 'kept', False),
        (6, 'Payer@', 'loose', False),
        (6, 'Payer@', 'peek', False),
        (6, 'Payer@', 'strict', False),
        (7, 'Assembler@', 'blind', False),
        (7, 'Assembler@', 'seen', False),
        (8, 'Sums@', 'Sums@', False),
        (8, 'Sums@', 'mint', False),
        (8, 'Sums@', 'move', False),
        (8, 'Sums@', 'scale', False),
        (9, 'Market@', 'approveSpender', False),
        (9, 'Market@', 'buy', False),
        (9, 'Market@', 'setPrice', False),
        (9, 'Market@', 'swapAll', False),
        (9, 'Market@', 'swapBound', False),
    ]),
    'gu3_mutex': ('contract:s fn:s start_line:l mutex:b mutex_lines:L mutex_guard:b', [
        (0, 'Vault@', 'deposit', 11, False, [], False),
        (0, 'Vault@', 'guarded', 19, True, [5], True),
        (0, 'Vault@', 'orderly', 24, False, [], False),
        (0, 'Vault@', 'withdraw', 14, False, [], False),
        (1, 'Chain@', 'claim', 4, False, [], False),
        (1, 'Chain@', 'lost', 24, False, [], False),
        (1, 'Chain@', 'pay', 11, False, [], False),
        (1, 'Chain@', 'ping', 15, False, [], False),
        (1, 'Chain@', 'ping2', 21, False, [], False),
        (1, 'Chain@', 'pong', 18, False, [], False),
        (1, 'Chain@', 'relay', 8, False, [], False),
        (10, 'Lock@', 'claim', 22, False, [], False),
        (10, 'Lock@', 'note', 28, False, [], False),
        (10, 'Lock@', 'release', 17, False, [], False),
        (10, 'Lock@', 'remaining', 25, False, [], False),
        (10, 'Lock@', 'setEnd', 14, False, [], False),
        (10, 'Lock@', 'setStart', 11, False, [], False),
        (11, 'Odd@', 'f', 7, False, [], False),
        (11, 'Odd@', 'g', 18, False, [], False),
        (12, 'Desk@', '_book', 25, False, [], False),
        (12, 'Desk@', '_push', 37, False, [], False),
        (12, 'Desk@', 'deposit', 13, False, [], False),
        (12, 'Desk@', 'mintAll', 42, False, [], False),
        (12, 'Desk@', 'payLater', 21, False, [], False),
        (12, 'Desk@', 'pull', 17, False, [], False),
        (12, 'Desk@', 'setComptroller', 9, False, [], False),
        (12, 'Desk@', 'settle', 33, False, [], False),
        (12, 'Desk@', 'sweep', 46, False, [], False),
        (12, 'Desk@', 'trade', 28, False, [], False),
        (13, 'Router@', 'issue', 18, False, [], False),
        (13, 'Router@', 'liquidateFor', 24, False, [], False),
        (13, 'Router@', 'mark', 28, False, [], False),
        (13, 'Router@', 'rescue', 21, False, [], False),
        (13, 'Sender@', '_forward', 6, False, [], False),
        (13, 'Sender@', 'half', 10, False, [], False),
        (13, 'Sender@', 'push', 3, False, [], False),
        (14, 'Book@', '_cancelOrder', 28, False, [], False),
        (14, 'Book@', 'cancelExpired', 23, False, [], False),
        (14, 'Book@', 'claimReceipt', 34, False, [], False),
        (14, 'Book@', 'executeOrder', 16, False, [], False),
        (14, 'Book@', 'fillOrder', 31, False, [], False),
        (14, 'Book@', 'placeOrder', 10, False, [], False),
        (15, 'Vesting@', 'accrue', 22, False, [], False),
        (15, 'Vesting@', 'capture', 25, False, [], False),
        (15, 'Vesting@', 'claim', 17, False, [], False),
        (15, 'Vesting@', 'getTime', 7, False, [], False),
        (15, 'Vesting@', 'join', 28, False, [], False),
        (15, 'Vesting@', 'vested', 10, False, [], False),
        (16, 'Farm@', '_sell', 12, False, [], False),
        (16, 'Farm@', 'compound', 8, False, [], False),
        (16, 'Farm@', 'harvest', 4, False, [], False),
        (16, 'Farm@', 'redeem', 17, False, [], False),
        (17, 'Powers@', '_lock', 7, False, [], False),
        (17, 'Powers@', 'cost', 15, False, [], False),
        (17, 'Powers@', 'fill', 10, False, [], False),
        (2, 'Base@', '_grant', 4, False, [], False),
        (2, 'Shop@', '_grant', 15, False, [], False),
        (2, 'Shop@', 'buy', 12, False, [], False),
        (3, 'Admin@', '_apply', 34, False, [], False),
        (3, 'Admin@', 'adjust', 31, False, [], False),
        (3, 'Admin@', 'constructor', 12, False, [], False),
        (3, 'Admin@', 'initialize', 15, False, [], False),
        (3, 'Admin@', 'setFee', 18, False, [], False),
        (3, 'Admin@', 'setFeeChecked', 27, False, [], False),
        (3, 'Admin@', 'setFeeLoose', 24, False, [], False),
        (3, 'Admin@', 'setOwner', 21, False, [], False),
        (4, 'Origin@', 'join', 16, False, [], False),
        (4, 'Origin@', 'remember', 19, False, [], False),
        (4, 'Origin@', 'setTreasury', 13, False, [], False),
        (4, 'Origin@', 'sweep', 22, False, [], False),
        (5, 'Caller@', 'branched', 13, False, [], False),
        (5, 'Caller@', 'dropped', 4, False, [], False),
        (5, 'Caller@', 'emitted', 22, False, [], False),
        (5, 'Caller@', 'required', 10, False, [], False),
        (5, 'Caller@', 'returned', 19, False, [], False),
        (5, 'Caller@', 'unused', 7, False, [], False),
        (6, 'Payer@', 'kept', 13, False, [], False),
        (6, 'Payer@', 'loose', 10, False, [], False),
        (6, 'Payer@', 'peek', 22, False, [], False),
        (6, 'Payer@', 'strict', 16, False, [], False),
        (7, 'Assembler@', 'blind', 3, False, [], False),
        (7, 'Assembler@', 'seen', 8, False, [], False),
        (8, 'Sums@', 'Sums@', 5, False, [], False),
        (8, 'Sums@', 'mint', 8, False, [], False),
        (8, 'Sums@', 'move', 12, False, [], False),
        (8, 'Sums@', 'scale', 18, False, [], False),
        (9, 'Market@', 'approveSpender', 20, False, [], False),
        (9, 'Market@', 'buy', 8, False, [], False),
        (9, 'Market@', 'setPrice', 5, False, [], False),
        (9, 'Market@', 'swapAll', 11, False, [], False),
        (9, 'Market@', 'swapBound', 15, False, [], False),
    ]),
    'gu4_protected_functions': ('contract:s fn:s start_line:l', [
        (12, 'Desk@', 'deposit', 13),
        (3, 'Admin@', 'setFee', 18),
        (3, 'Admin@', 'setFeeChecked', 27),
        (3, 'Admin@', 'setFeeLoose', 24),
        (8, 'Sums@', 'move', 12),
    ]),
    'gu6_unchecked_arithmetic': ('fn:s stmt_no:i line:l op:s operand:s protected:b', [
        (17, '_lock', 1, 8, '+', 'span', False),
        (17, 'cost', 1, 16, '*', 'b', False),
        (8, 'mint', 1, 9, '+=', 'amount', False),
        (8, 'mint', 2, 10, '+=', 'amount', False),
        (8, 'move', 2, 14, '-=', 'amount', True),
        (8, 'move', 4, 16, '+=', 'amount', True),
        (8, 'scale', 1, 19, '*', 'b', False),
    ]),
    'uc1_call_decisions': ('fn:s line:l method:s names:S check_lines:L check_kinds:S state:s', [
        (0, 'guarded', 20, 'call', ['ok'], [21], ['require'], 'refuted'),
        (0, 'orderly', 26, 'call', ['ok'], [27], ['require'], 'refuted'),
        (0, 'withdraw', 15, 'call', ['ok'], [16], ['require'], 'refuted'),
        (1, 'pay', 12, 'call', ['ok'], [13], ['require'], 'refuted'),
        (12, '_push', 39, 'call', ['ok'], [40], ['require'], 'refuted'),
        (12, 'trade', 29, 'call', ['ok'], [30], ['require'], 'refuted'),
        (13, '_forward', 7, 'call', ['ok'], [8], ['require'], 'refuted'),
        (5, 'branched', 14, 'call', ['ok'], [15], ['if'], 'refuted'),
        (5, 'dropped', 5, 'call', [], [], [], 'confirmed'),
        (5, 'emitted', 23, 'delegatecall', ['ok'], [], [], 'unresolved'),
        (5, 'required', 11, 'send', [], [11], ['require'], 'refuted'),
        (5, 'returned', 20, 'send', [], [], [], 'unresolved'),
        (5, 'unused', 8, 'call', ['ok'], [], [], 'confirmed'),
    ]),
    'uc2_decision_at_line': ('line:l call_line:l fn:s state:s', [
        (0, 15, 15, 'withdraw', 'refuted'),
        (0, 20, 20, 'guarded', 'refuted'),
        (0, 26, 26, 'orderly', 'refuted'),
        (1, 12, 12, 'pay', 'refuted'),
        (12, 29, 29, 'trade', 'refuted'),
        (12, 39, 39, '_push', 'refuted'),
        (13, 7, 7, '_forward', 'refuted'),
        (5, 11, 11, 'required', 'refuted'),
        (5, 14, 14, 'branched', 'refuted'),
        (5, 20, 20, 'returned', 'unresolved'),
        (5, 23, 23, 'emitted', 'unresolved'),
        (5, 5, 5, 'dropped', 'confirmed'),
        (5, 8, 8, 'unused', 'confirmed'),
    ]),
    'uc4_discarded_returns': ('fn:s line:l name:s type:s method:s returns:s', [
        (4, 'sweep', 23, 'token', 'IERC20', 'transfer', 'bool'),
        (5, 'dropped', 5, 'to', 'address', 'call', 'unknown'),
        (6, 'loose', 11, 'token', 'IToken@', 'transfer', 'bool'),
        (9, 'swapAll', 13, 'router', 'IRouter', 'swap', 'unknown'),
        (9, 'swapBound', 18, 'router', 'IRouter', 'swap', 'unknown'),
        (12, 'pull', 18, 'token', '', 'transfer', 'unknown'),
        (12, 'sweep', 48, 'vault', '', 'deposit', 'unknown'),
        (14, 'executeOrder', 20, 'token', '', 'transfer', 'unknown'),
        (15, 'claim', 20, 'token', '', 'transfer', 'unknown'),
        (16, '_sell', 15, 'pool', '', 'deposit', 'unknown'),
        (16, 'redeem', 19, 'token', '', 'transfer', 'unknown'),
        (17, 'fill', 13, 'token', '', 'transfer', 'unknown'),
    ]),
    'tm1_temporal_facts': ('fn:s is_modifier:b kind:s line:l name:s', [
        (10, 'inWindow', True, 'guard', 8, '>='),
        (10, 'inWindow', True, 'read', 8, ''),
        (10, 'note', False, 'read', 29, ''),
        (10, 'release', False, 'alias', 18, 'current'),
        (10, 'release', False, 'guard', 19, '>='),
        (10, 'release', False, 'read', 18, ''),
        (10, 'remaining', False, 'read', 26, ''),
        (10, 'setEnd', False, 'alias', 15, 'end'),
        (10, 'setEnd', False, 'read', 15, ''),
        (10, 'setStart', False, 'alias', 12, 'start'),
        (10, 'setStart', False, 'read', 12, ''),
        (14, 'cancelExpired', False, 'guard', 25, '<'),
        (14, 'cancelExpired', False, 'read', 25, ''),
        (14, 'executeOrder', False, 'guard', 18, '<='),
        (14, 'executeOrder', False, 'read', 18, ''),
        (14, 'executeOrder', False, 'read', 21, ''),
        (14, 'placeOrder', False, 'guard', 11, '>'),
        (14, 'placeOrder', False, 'read', 11, ''),
        (14, 'placeOrder', False, 'read', 14, ''),
        (15, 'accrue', False, 'alias', 23, 'rewardStored'),
        (15, 'accrue', False, 'read', 23, ''),
        (15, 'capture', False, 'alias', 26, 'unlockAt'),
        (15, 'capture', False, 'read', 26, ''),
        (15, 'getTime', False, 'read', 8, ''),
        (15, 'join', False, 'guard', 30, '<'),
        (15, 'join', False, 'read', 30, ''),
        (17, '_lock', False, 'read', 8, ''),
    ]),
    'tm2_temporal_relations': ('fn:s relation:s from_line:l to_line:l', [
        (10, 'release', 'alias_to_guard', 18, 19),
        (10, 'release', 'guard_controls_action', 19, 20),
        (14, 'cancelExpired', 'helper_call', 26, 26),
        (14, 'executeOrder', 'guard_controls_action', 18, 20),
        (15, 'join', 'helper_call', 29, 29),
    ]),
    'tm13_temporal_summary': ('n_read:i n_alias:i n_guard:i n_write:i n_asset:i n_functions:i', [
        (0, 0, 0, 0, 4, 3, 0),
        (1, 0, 0, 0, 2, 1, 0),
        (10, 6, 3, 2, 3, 1, 5),
        (12, 0, 0, 0, 6, 7, 0),
        (13, 0, 0, 0, 3, 3, 0),
        (14, 5, 0, 3, 3, 1, 4),
        (15, 4, 2, 1, 3, 1, 4),
        (16, 0, 0, 0, 0, 2, 0),
        (17, 1, 0, 0, 1, 1, 1),
        (2, 0, 0, 0, 2, 0, 0),
        (3, 0, 0, 0, 7, 0, 0),
        (4, 0, 0, 0, 3, 1, 0),
        (5, 0, 0, 0, 0, 2, 0),
        (6, 0, 0, 0, 0, 3, 0),
        (8, 0, 0, 0, 5, 0, 0),
        (9, 0, 0, 0, 1, 3, 0),
    ]),
    'hi1_hints': ('fn:s line:l kind:s', [
        (0, 'guarded', 19, 'low_level_call'),
        (0, 'guarded', 19, 'reentrancy_guarded'),
        (0, 'orderly', 24, 'low_level_call'),
        (0, 'withdraw', 14, 'low_level_call'),
        (0, 'withdraw', 14, 'reentrancy_risk'),
        (1, 'claim', 4, 'reentrancy_risk'),
        (1, 'pay', 11, 'low_level_call'),
        (10, 'note', 28, 'time'),
        (10, 'release', 17, 'time'),
        (10, 'remaining', 25, 'time'),
        (10, 'setEnd', 14, 'time'),
        (10, 'setStart', 11, 'time'),
        (11, 'f', 7, 'loop'),
        (12, '_push', 37, 'low_level_call'),
        (12, 'deposit', 13, 'auth_guard'),
        (12, 'deposit', 13, 'reentrancy_risk'),
        (12, 'pull', 17, 'reentrancy_risk'),
        (12, 'settle', 33, 'reentrancy_risk'),
        (12, 'trade', 28, 'low_level_call'),
        (13, '_forward', 6, 'low_level_call'),
        (14, 'cancelExpired', 23, 'time'),
        (14, 'executeOrder', 16, 'time'),
        (14, 'placeOrder', 10, 'time'),
        (15, 'accrue', 22, 'time'),
        (15, 'capture', 25, 'time'),
        (15, 'getTime', 7, 'time'),
        (15, 'join', 28, 'time'),
        (17, '_lock', 7, 'time'),
        (3, 'setFee', 18, 'auth_guard'),
        (3, 'setFeeChecked', 27, 'auth_guard'),
        (3, 'setFeeLoose', 24, 'auth_guard'),
        (4, 'remember', 19, 'tx_origin'),
        (4, 'sweep', 22, 'tx_origin'),
        (5, 'branched', 13, 'low_level_call'),
        (5, 'dropped', 4, 'low_level_call'),
        (5, 'emitted', 22, 'low_level_call'),
        (5, 'required', 10, 'low_level_call'),
        (5, 'returned', 19, 'low_level_call'),
        (5, 'unused', 7, 'low_level_call'),
        (6, 'kept', 13, 'reentrancy_risk'),
        (8, 'move', 12, 'auth_guard'),
    ]),
    'ca1_union': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (0, 'AC6', 'access_control', 'Vault@', 'guarded', 'guarded', 'guarded', 20, None, [20], [], [], 0.8, 'unauthorized_native_transfer'),
        (0, 'AC6', 'access_control', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, None, [15], [], [], 0.8, 'unauthorized_native_transfer'),
        (0, 'RE1', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.84, 'external_call_before_state_write'),
        (0, 'RE2', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.86, 'source_event_sequence'),
        (0, 'RE4', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.95, 'low_level_value_call_before_persistent_state_write'),
        (0, 'RE7', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.95, 'low_level_value_call_before_persistent_state_write'),
        (1, 'AC7', 'access_control', 'Chain@', 'claim', 'claim', 'claim', 6, 6, [4, 6], [6], [], 0.5, 'source_access_surface:generic_state'),
        (1, 'RE2', 'reentrancy', 'Chain@', 'claim', 'claim', 'claim', 12, 6, [6, 12], [6], [], 0.86, 'source_event_sequence'),
        (1, 'RE7', 'reentrancy', 'Chain@', 'claim', 'claim', 'claim', 12, 6, [6, 12], [6], [], 0.95, 'interprocedural_low_level_value_call_before_persistent_state_write'),
        (10, 'AC6', 'access_control', 'Lock@', 'release', 'release', 'release', 20, None, [20], [], [], 0.8, 'unauthorized_native_transfer'),
        (10, 'GR8', 'front_running', 'Lock@', 'release', 'release', 'release', 17, None, [17], [], [], 0.65, 'financial_read_write_conflict'),
        (10, 'TM10', 'time_manipulation', 'Lock@', 'remaining', 'remaining', 'remaining', 26, None, [26], [], [], 0.6, 'TM10'),
        (10, 'TM11', 'time_manipulation', 'Lock@', 'release', 'release', 'release', 18, None, [18, 19], [], [], 0.7, 'temporal_producer_consumer'),
        (10, 'TM11', 'time_manipulation', 'Lock@', 'release', 'release', 'release', 19, None, [18, 19], [], [], 0.7, 'temporal_producer_consumer'),
        (10, 'TM5', 'time_manipulation', 'Lock@', 'claim', 'claim', 'claim', 8, None, [8, 23], [], [], 0.75, 'modifier_time_window'),
        (10, 'TM5', 'time_manipulation', 'Lock@', 'release', 'release', 'release', 19, None, [19, 20], [], [], 0.7, 'timestamp_gate'),
        (10, 'TM6', 'time_manipulation', 'Lock@', 'inWindow', 'inWindow', 'inWindow', 8, None, [8], [], [], 0.78, 'lifecycle_boundary'),
        (12, 'AC7', 'access_control', 'Desk@', '_book', 'payLater', '_book', 26, 26, [21, 26], [26], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'AC7', 'access_control', 'Desk@', 'mintAll', 'mintAll', 'mintAll', 44, 44, [42, 44], [44], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'AC7', 'access_control', 'Desk@', 'setComptroller', 'setComptroller', 'setComptroller', 11, 11, [9, 11], [11], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'AC7', 'access_control', 'Desk@', 'settle', 'settle', 'settle', 35, 35, [33, 35], [35], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'RE1', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.84, 'external_call_before_state_write'),
        (12, 'RE1', 'reentrancy', 'Desk@', 'pull', 'pull', 'pull', 18, 19, [18, 19], [19], [], 0.84, 'external_call_before_state_write'),
        (12, 'RE2', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.86, 'source_event_sequence'),
        (12, 'RE2', 'reentrancy', 'Desk@', 'pull', 'pull', 'pull', 18, 19, [18, 19], [19], [], 0.86, 'source_event_sequence'),
        (12, 'RE2', 'reentrancy', 'Desk@', 'settle', 'settle', 'settle', 39, 35, [35, 39], [35], [], 0.86, 'source_event_sequence'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.85, 'token_transfer_before_persistent_state_write'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'mintAll', 'mintAll', 'mintAll', 43, 44, [43, 44], [44], [], 0.85, 'safe_mint_before_persistent_state_write'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'payLater', 'payLater', 'payLater', 22, 26, [22, 26], [26], [], 0.85, 'token_transfer_before_helper_state_write'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'setComptroller', 'setComptroller', 'setComptroller', 10, 11, [10, 11], [11], [], 0.9, 'external_view_call_before_inherited_state_write'),
        (12, 'RE6', 'reentrancy', 'Desk@', '_push', 'settle', '_push', 37, 35, [35, 39], [], [], 0.95, 'interprocedural_low_level_callback_before_caller_state_settlement'),
        (12, 'RE6', 'reentrancy', 'Desk@', 'trade', 'trade', 'trade', 29, 31, [29, 31], [], [], 0.95, 'caller_controlled_low_level_callback_before_post_call_settlement'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.85, 'token_transfer_before_persistent_state_write'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'mintAll', 'mintAll', 'mintAll', 43, 44, [43, 44], [44], [], 0.85, 'safe_mint_before_persistent_state_write'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'settle', 'settle', 'settle', 39, 35, [35, 39], [35], [], 0.95, 'interprocedural_low_level_value_call_before_persistent_state_write'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'sweep', 'sweep', 'sweep', 47, 48, [47, 48], [], [], 0.85, 'token_transfer_before_external_asset_action'),
        (13, 'AC7', 'access_control', 'Router@', 'issue', 'issue', 'issue', 19, 19, [18, 19], [19], [], 0.75, 'source_access_surface:global_state'),
        (13, 'AC7', 'access_control', 'Router@', 'liquidateFor', 'liquidateFor', 'liquidateFor', 26, 26, [24, 25], [25], [], 0.75, 'source_access_surface:subject_scoped_state'),
        (13, 'AC7', 'access_control', 'Router@', 'mark', 'mark', 'mark', 29, 29, [28, 29], [29], [], 0.5, 'source_access_surface:generic_state'),
        (13, 'AC7', 'access_control', 'Router@', 'rescue', 'rescue', 'rescue', 22, 22, [21, 22], [], [], 0.75, 'source_access_surface:asset_operation'),
        (14, 'AC7', 'access_control', 'Book@', 'claimReceipt', 'claimReceipt', 'claimReceipt', 36, 36, [34, 36], [36], [], 0.5, 'source_access_surface:generic_state'),
        (14, 'AC7', 'access_control', 'Book@', 'fillOrder', 'fillOrder', 'fillOrder', 32, 32, [31, 32], [32], [], 0.5, 'source_access_surface:generic_state'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'cancelExpired', 'cancelExpired', 'cancelExpired', 25, None, [25], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 18, None, [18, 21], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 21, None, [18, 21], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 11, None, [11, 14], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 14, None, [11, 14], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM12', 'time_manipulation', 'Book@', 'cancelExpired', 'cancelExpired', 'cancelExpired', 25, None, [25], [], [], 0.55, 'clock_in_condition'),
        (14, 'TM12', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 11, None, [11], [], [], 0.55, 'clock_in_condition'),
        (14, 'TM4', 'time_manipulation', 'Book@', 'claimReceipt', 'claimReceipt', 'claimReceipt', 35, None, [35], [], [], 0.86, 'signed_receipt_missing_quest_expiry'),
        (14, 'TM5', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 18, None, [18, 20], [], [], 0.7, 'timestamp_gate'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'cancelExpired', 'cancelExpired', 'cancelExpired', 25, None, [25], [], [], 0.88, 'order_expiration_cancellation_gate'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 18, None, [18], [], [], 0.88, 'order_expiration_execution_gate'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 21, None, [21], [], [], 0.86, 'order_expiration_execution_timestamp_record'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 11, None, [11], [], [], 0.88, 'order_expiration_creation_gate'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 14, None, [14], [], [], 0.86, 'order_creation_timestamp_assignment'),
        (15, 'TM10', 'time_manipulation', 'Vesting@', 'accrue', 'accrue', 'accrue', 23, None, [23], [], [], 0.6, 'TM10'),
        (15, 'TM11', 'time_manipulation', 'Vesting@', 'accrue', 'accrue', 'accrue', 23, None, [23], [], [], 0.7, 'temporal_producer_consumer'),
        (15, 'TM11', 'time_manipulation', 'Vesting@', 'getTime', 'join', 'join', 8, 30, [7, 8, 29, 30], [], [], 0.7, 'temporal_producer_consumer'),
        (15, 'TM12', 'time_manipulation', 'Vesting@', 'join', 'join', 'join', 30, None, [30], [], [], 0.55, 'clock_in_condition'),
        (15, 'TM8', 'time_manipulation', 'Vesting@', 'getTime', 'claim', 'getTime', 8, None, [8, 11, 20, 29], [], [], 0.88, 'timestamp_provider_to_vesting_asset_consumer'),
        (16, 'FR4', 'front_running', 'Farm@', 'compound', 'compound', '_sell', 14, None, [8, 9, 14], [], [14], 0.9, 'permissionless_quote_then_swap_configurable_slippage'),
        (16, 'FR4', 'front_running', 'Farm@', 'harvest', 'harvest', 'harvest', 6, None, [4, 5, 6], [], [6], 0.9, 'permissionless_balance_dependent_amm_swap_zero_slippage'),
        (16, 'FR5', 'front_running', 'Farm@', '_sell', 'compound', '_sell', 14, 14, [12, 13, 14], [], [13], 0.9, 'permissionless_quote_then_asset_settlement'),
        (16, 'FR5', 'front_running', 'Farm@', 'harvest', 'harvest', 'harvest', 6, 6, [4, 5, 6], [], [5], 0.9, 'permissionless_quote_then_asset_settlement'),
        (16, 'FR5', 'front_running', 'Farm@', 'redeem', 'redeem', 'redeem', 19, 19, [17, 18, 19], [], [18], 0.9, 'permissionless_ratio_quote_then_asset_settlement'),
        (17, 'AR4', 'arithmetic', 'Powers@', 'fill', 'fill', 'fill', 11, None, [11, 12, 13], [], [11], 0.8, 'helper_arithmetic_provenance'),
        (17, 'AR5', 'arithmetic', 'Powers@', '_lock', '_lock', '_lock', 8, None, [8], [], [8], 0.8, 'legacy_unchecked_arithmetic'),
        (17, 'AR6', 'arithmetic', 'Powers@', '_lock', '_lock', '_lock', 7, None, [8], [8], [8], 0.9, 'timestamp_parameter_storage_write'),
        (17, 'AR6', 'arithmetic', 'Powers@', 'cost', 'cost', 'cost', 16, None, [16, 17], [], [16], 0.7, 'legacy_arithmetic_to_return'),
        (17, 'FR6', 'front_running', 'Powers@', 'fill', 'fill', 'fill', 11, 13, [11, 13], [], [11], 0.72, 'unbounded_quote_to_asset_sink'),
        (17, 'TM11', 'time_manipulation', 'Powers@', '_lock', '_lock', '_lock', 8, None, [8], [], [], 0.7, 'temporal_producer_consumer'),
        (2, 'AC2', 'access_control', 'Shop@', 'buy', 'buy', '_grant', 5, None, [5, 12], [5], [], 0.88, 'unprotected_critical_state_write'),
        (2, 'AC7', 'access_control', 'Base@', '_grant', 'buy', '_grant', 5, 5, [5, 12], [5], [], 0.5, 'source_access_surface:generic_state'),
        (2, 'AC8', 'access_control', 'Shop@', 'buy', 'buy', '_grant', 16, None, [16], [], [], 0.6, 'inherited_effect_propagation'),
        (3, 'AC2', 'access_control', 'Admin@', 'adjust', 'adjust', '_apply', 35, None, [31, 35], [35], [], 0.88, 'unprotected_critical_state_write'),
        (3, 'AC2', 'access_control', 'Admin@', 'initialize', 'initialize', 'initialize', 16, None, [15, 16], [16], [], 0.91, 'unprotected_critical_state_write'),
        (3, 'AC2', 'access_control', 'Admin@', 'setOwner', 'setOwner', 'setOwner', 22, None, [21, 22], [22], [], 0.91, 'unprotected_critical_state_write'),
        (3, 'AC7', 'access_control', 'Admin@', '_apply', 'adjust', '_apply', 35, 35, [31, 35], [35], [], 0.5, 'source_access_surface:generic_state'),
        (3, 'AC7', 'access_control', 'Admin@', 'initialize', 'initialize', 'initialize', 16, 16, [15, 16], [16], [], 0.75, 'source_access_surface:global_state'),
        (3, 'AC7', 'access_control', 'Admin@', 'setFee', 'setFee', 'setFee', 19, 19, [5, 18, 19], [19], [], 0.75, 'source_access_surface:asset_operation'),
        (3, 'AC7', 'access_control', 'Admin@', 'setFeeChecked', 'setFeeChecked', 'setFeeChecked', 29, 29, [27, 28, 29], [29], [], 0.75, 'source_access_surface:asset_operation'),
        (3, 'AC7', 'access_control', 'Admin@', 'setFeeLoose', 'setFeeLoose', 'setFeeLoose', 25, 25, [24, 25], [25], [], 0.75, 'source_access_surface:asset_operation'),
        (3, 'AC7', 'access_control', 'Admin@', 'setOwner', 'setOwner', 'setOwner', 22, 22, [21, 22], [22], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC1', 'access_control', 'Origin@', 'setTreasury', 'setTreasury', 'setTreasury', 6, None, [6, 14], [14], [], 0.93, 'tx_origin_modifier_authorization'),
        (4, 'AC2', 'access_control', 'Origin@', 'join', 'join', 'join', 17, None, [16, 17], [17], [], 0.88, 'unprotected_critical_state_write'),
        (4, 'AC2', 'access_control', 'Origin@', 'remember', 'remember', 'remember', 20, None, [19, 20], [20], [], 0.88, 'unprotected_critical_state_write'),
        (4, 'AC2', 'access_control', 'Origin@', 'setTreasury', 'setTreasury', 'setTreasury', 14, None, [13, 14], [14], [], 0.91, 'unprotected_critical_state_write'),
        (4, 'AC5', 'access_control', 'Origin@', 'remember', 'remember', 'remember', 20, None, [20], [], [], 0.9, 'tx_origin_state_value'),
        (4, 'AC5', 'access_control', 'Origin@', 'sweep', 'sweep', 'sweep', 23, None, [23], [], [], 0.9, 'tx_origin_asset_argument'),
        (4, 'AC7', 'access_control', 'Origin@', 'join', 'join', 'join', 17, 17, [16, 17], [17], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC7', 'access_control', 'Origin@', 'remember', 'remember', 'remember', 20, 20, [19, 20], [20], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC7', 'access_control', 'Origin@', 'setTreasury', 'setTreasury', 'setTreasury', 14, 14, [5, 13, 14], [14], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC7', 'access_control', 'Origin@', 'sweep', 'sweep', 'sweep', 23, 23, [22, 23], [], [], 0.75, 'source_access_surface:asset_operation'),
        (5, 'AC7', 'access_control', 'Caller@', 'emitted', 'emitted', 'emitted', 23, 23, [22, 23], [], [], 0.75, 'source_access_surface:asset_operation'),
        (5, 'UC1', 'unchecked_low_level_calls', 'Caller@', 'dropped', 'dropped', 'dropped', 5, None, [5], [], [], 0.92, 'low_level_status_unchecked'),
        (5, 'UC1', 'unchecked_low_level_calls', 'Caller@', 'unused', 'unused', 'unused', 8, None, [8], [], [], 0.92, 'low_level_status_unchecked'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'branched', 'branched', 'branched', 14, None, [14], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'dropped', 'dropped', 'dropped', 5, None, [5], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'emitted', 'emitted', 'emitted', 23, None, [23], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'returned', 'returned', 'returned', 20, None, [20], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'unused', 'unused', 'unused', 8, None, [8], [], [], 0.93, 'source_unchecked_low_level_call'),
        (6, 'RE2', 'reentrancy', 'Payer@', 'kept', 'kept', 'kept', 14, 14, [14], [14], [], 0.86, 'source_event_sequence'),
        (6, 'UC3', 'unchecked_low_level_calls', 'Payer@', 'loose', 'loose', 'loose', 11, None, [11], [], [], 0.9, 'typed_return_discard'),
        (6, 'UC3', 'unchecked_low_level_calls', 'Payer@', 'strict', 'strict', 'strict', 18, None, [18], [], [], 0.9, 'typed_return_discard'),
        (7, 'UC6', 'unchecked_low_level_calls', 'Assembler@', 'blind', 'blind', 'blind', 5, None, [5], [], [], 0.92, 'assembly_call_status_discard'),
        (8, 'AC7', 'access_control', 'Sums@', 'mint', 'mint', 'mint', 9, 10, [8, 9, 10], [9, 10], [], 0.5, 'source_access_surface:generic_state'),
        (8, 'AR1', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 10, None, [10], [10], [10], 0.85, 'caller_controlled_arithmetic_write'),
        (8, 'AR1', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 9, None, [9], [9], [9], 0.85, 'caller_controlled_arithmetic_write'),
        (8, 'AR5', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 9, None, [9, 10], [], [9, 10], 0.8, 'legacy_unchecked_arithmetic'),
        (8, 'AR6', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 9, None, [9], [9], [9], 0.7, 'legacy_arithmetic_to_state'),
        (8, 'AR6', 'arithmetic', 'Sums@', 'scale', 'scale', 'scale', 19, None, [19, 20], [], [19], 0.7, 'legacy_arithmetic_to_return'),
        (9, 'AC6', 'access_control', 'Market@', 'buy', 'buy', 'buy', 9, None, [9], [], [], 0.8, 'unauthorized_native_transfer'),
        (9, 'AC7', 'access_control', 'Market@', 'setPrice', 'setPrice', 'setPrice', 6, 6, [5, 6], [6], [], 0.5, 'source_access_surface:generic_state'),
        (9, 'FR1', 'front_running', 'Market@', 'buy', 'buy', 'buy', 9, None, [9], [], [], 0.65, 'FR1'),
        (9, 'FR2', 'front_running', 'Market@', 'approveSpender', 'approveSpender', 'approveSpender', 21, None, [21], [], [], 0.6, 'FR2'),
        (9, 'FR3', 'front_running', 'Market@', 'swapAll', 'swapAll', 'swapAll', 13, None, [13], [], [], 0.7, 'FR3'),
        (9, 'FR6', 'front_running', 'Market@', 'swapAll', 'swapAll', 'swapAll', 12, 13, [12, 13], [], [12], 0.72, 'unbounded_quote_to_asset_sink'),
        (9, 'GR8', 'front_running', 'Market@', 'buy', 'buy', 'buy', 8, None, [8], [], [], 0.65, 'financial_read_write_conflict'),
    ]),
    'ca2_append': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (0, 'RE1', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.84, 'external_call_before_state_write'),
        (1, 'RE2', 'reentrancy', 'Chain@', 'claim', 'claim', 'claim', 12, 6, [6, 12], [6], [], 0.86, 'source_event_sequence'),
        (12, 'RE1', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.84, 'external_call_before_state_write'),
        (12, 'RE1', 'reentrancy', 'Desk@', 'pull', 'pull', 'pull', 18, 19, [18, 19], [19], [], 0.84, 'external_call_before_state_write'),
        (12, 'RE2', 'reentrancy', 'Desk@', 'settle', 'settle', 'settle', 39, 35, [35, 39], [35], [], 0.86, 'source_event_sequence'),
        (6, 'RE2', 'reentrancy', 'Payer@', 'kept', 'kept', 'kept', 14, 14, [14], [14], [], 0.86, 'source_event_sequence'),
    ]),
    'ca3_normalize': ('rule_id:s fn:s line:l evidence_lines:L', [
        (0, 'AC6', 'guarded', 20, [20]),
        (0, 'AC6', 'withdraw', 15, [15]),
        (0, 'RE1', 'withdraw', 15, [15, 17]),
        (0, 'RE2', 'withdraw', 15, [15, 17]),
        (0, 'RE4', 'withdraw', 15, [15, 17]),
        (0, 'RE7', 'withdraw', 15, [15, 17]),
        (1, 'AC7', 'claim', 6, [4, 6]),
        (1, 'RE2', 'claim', 12, [6, 12]),
        (1, 'RE7', 'claim', 12, [6, 12]),
        (10, 'AC6', 'release', 20, [20]),
        (10, 'GR8', 'release', 17, [17]),
        (10, 'TM10', 'remaining', 26, [26]),
        (10, 'TM11', 'release', 18, [18, 19]),
        (10, 'TM11', 'release', 19, [18, 19]),
        (10, 'TM5', 'claim', 8, [8, 23]),
        (10, 'TM5', 'release', 19, [19, 20]),
        (10, 'TM6', 'inWindow', 8, [8]),
        (12, 'AC7', '_book', 26, [21, 26]),
        (12, 'AC7', 'mintAll', 44, [42, 44]),
        (12, 'AC7', 'setComptroller', 11, [9, 11]),
        (12, 'AC7', 'settle', 35, [33, 35]),
        (12, 'RE1', 'deposit', 14, [14, 15]),
        (12, 'RE1', 'pull', 18, [18, 19]),
        (12, 'RE2', 'deposit', 14, [14, 15]),
        (12, 'RE2', 'pull', 18, [18, 19]),
        (12, 'RE2', 'settle', 39, [35, 39]),
        (12, 'RE4', 'deposit', 14, [14, 15]),
        (12, 'RE4', 'mintAll', 43, [43, 44]),
        (12, 'RE4', 'payLater', 22, [22, 26]),
        (12, 'RE4', 'setComptroller', 10, [10, 11]),
        (12, 'RE6', '_push', 37, [35, 37, 39]),
        (12, 'RE6', 'trade', 29, [29, 31]),
        (12, 'RE7', 'deposit', 14, [14, 15]),
        (12, 'RE7', 'mintAll', 43, [43, 44]),
        (12, 'RE7', 'settle', 39, [35, 39]),
        (12, 'RE7', 'sweep', 47, [47, 48]),
        (13, 'AC7', 'issue', 19, [18, 19]),
        (13, 'AC7', 'liquidateFor', 26, [24, 25, 26]),
        (13, 'AC7', 'mark', 29, [28, 29]),
        (13, 'AC7', 'rescue', 22, [21, 22]),
        (14, 'AC7', 'claimReceipt', 36, [34, 36]),
        (14, 'AC7', 'fillOrder', 32, [31, 32]),
        (14, 'TM11', 'cancelExpired', 25, [25]),
        (14, 'TM11', 'executeOrder', 18, [18, 21]),
        (14, 'TM11', 'executeOrder', 21, [18, 21]),
        (14, 'TM11', 'placeOrder', 11, [11, 14]),
        (14, 'TM11', 'placeOrder', 14, [11, 14]),
        (14, 'TM12', 'cancelExpired', 25, [25]),
        (14, 'TM12', 'placeOrder', 11, [11]),
        (14, 'TM4', 'claimReceipt', 35, [35]),
        (14, 'TM5', 'executeOrder', 18, [18, 20]),
        (14, 'TM7', 'cancelExpired', 25, [25]),
        (14, 'TM7', 'executeOrder', 18, [18]),
        (14, 'TM7', 'executeOrder', 21, [21]),
        (14, 'TM7', 'placeOrder', 11, [11]),
        (14, 'TM7', 'placeOrder', 14, [14]),
        (15, 'TM10', 'accrue', 23, [23]),
        (15, 'TM11', 'accrue', 23, [23]),
        (15, 'TM11', 'getTime', 8, [7, 8, 29, 30]),
        (15, 'TM12', 'join', 30, [30]),
        (15, 'TM8', 'getTime', 8, [8, 11, 20, 29]),
        (16, 'FR4', 'compound', 14, [8, 9, 14]),
        (16, 'FR4', 'harvest', 6, [4, 5, 6]),
        (16, 'FR5', '_sell', 15, [12, 13, 14, 15]),
        (16, 'FR5', 'harvest', 6, [4, 5, 6]),
        (16, 'FR5', 'redeem', 19, [17, 18, 19]),
        (17, 'AR4', 'fill', 11, [11, 12, 13]),
        (17, 'AR5', '_lock', 8, [8]),
        (17, 'AR6', '_lock', 8, [7, 8]),
        (17, 'AR6', 'cost', 16, [16, 17]),
        (17, 'FR6', 'fill', 13, [11, 13]),
        (17, 'TM11', '_lock', 8, [8]),
        (2, 'AC2', 'buy', 5, [5, 12]),
        (2, 'AC7', '_grant', 5, [5, 12]),
        (2, 'AC8', 'buy', 16, [16]),
        (3, 'AC2', 'adjust', 35, [31, 35]),
        (3, 'AC2', 'initialize', 16, [15, 16]),
        (3, 'AC2', 'setOwner', 22, [21, 22]),
        (3, 'AC7', '_apply', 35, [31, 35]),
        (3, 'AC7', 'initialize', 16, [15, 16]),
        (3, 'AC7', 'setFee', 19, [5, 18, 19]),
        (3, 'AC7', 'setFeeChecked', 29, [27, 28, 29]),
        (3, 'AC7', 'setFeeLoose', 25, [24, 25]),
        (3, 'AC7', 'setOwner', 22, [21, 22]),
        (4, 'AC1', 'setTreasury', 6, [6, 14]),
        (4, 'AC2', 'join', 17, [16, 17]),
        (4, 'AC2', 'remember', 20, [19, 20]),
        (4, 'AC2', 'setTreasury', 14, [13, 14]),
        (4, 'AC5', 'remember', 20, [20]),
        (4, 'AC5', 'sweep', 23, [23]),
        (4, 'AC7', 'join', 17, [16, 17]),
        (4, 'AC7', 'remember', 20, [19, 20]),
        (4, 'AC7', 'setTreasury', 14, [5, 13, 14]),
        (4, 'AC7', 'sweep', 23, [22, 23]),
        (5, 'AC7', 'emitted', 23, [22, 23]),
        (5, 'UC1', 'dropped', 5, [5]),
        (5, 'UC1', 'unused', 8, [8]),
        (5, 'UC3', 'branched', 14, [14]),
        (5, 'UC3', 'dropped', 5, [5]),
        (5, 'UC3', 'emitted', 23, [23]),
        (5, 'UC3', 'returned', 20, [20]),
        (5, 'UC3', 'unused', 8, [8]),
        (6, 'RE2', 'kept', 14, [14]),
        (6, 'UC3', 'loose', 11, [11]),
        (6, 'UC3', 'strict', 18, [18]),
        (7, 'UC6', 'blind', 5, [5]),
        (8, 'AC7', 'mint', 9, [8, 9, 10]),
        (8, 'AR1', 'mint', 10, [10]),
        (8, 'AR1', 'mint', 9, [9]),
        (8, 'AR5', 'mint', 9, [9, 10]),
        (8, 'AR6', 'mint', 9, [9]),
        (8, 'AR6', 'scale', 19, [19, 20]),
        (9, 'AC6', 'buy', 9, [9]),
        (9, 'AC7', 'setPrice', 6, [5, 6]),
        (9, 'FR1', 'buy', 9, [9]),
        (9, 'FR2', 'approveSpender', 21, [21]),
        (9, 'FR3', 'swapAll', 13, [13]),
        (9, 'FR6', 'swapAll', 12, [12, 13]),
        (9, 'GR8', 'buy', 8, [8]),
    ]),
    'ca4_admit': ('rule_id:s fn:s line:l clean:b admission_reason:s', [
        (0, 'AC6', 'guarded', 20, False, 'no_clean_sentinel'),
        (0, 'AC6', 'withdraw', 15, False, 'no_clean_sentinel'),
        (0, 'RE1', 'withdraw', 15, False, 'no_clean_sentinel'),
        (0, 'RE2', 'withdraw', 15, False, 'no_clean_sentinel'),
        (0, 'RE4', 'withdraw', 15, False, 'no_clean_sentinel'),
        (0, 'RE7', 'withdraw', 15, False, 'no_clean_sentinel'),
        (1, 'AC7', 'claim', 6, False, 'no_clean_sentinel'),
        (1, 'RE2', 'claim', 12, False, 'no_clean_sentinel'),
        (1, 'RE7', 'claim', 12, False, 'no_clean_sentinel'),
        (10, 'AC6', 'release', 20, False, 'no_clean_sentinel'),
        (10, 'GR8', 'release', 17, False, 'no_clean_sentinel'),
        (10, 'TM10', 'remaining', 26, False, 'no_clean_sentinel'),
        (10, 'TM11', 'release', 18, False, 'no_clean_sentinel'),
        (10, 'TM11', 'release', 19, False, 'no_clean_sentinel'),
        (10, 'TM5', 'claim', 8, False, 'no_clean_sentinel'),
        (10, 'TM5', 'release', 19, False, 'no_clean_sentinel'),
        (10, 'TM6', 'inWindow', 8, False, 'no_resolved_function'),
        (12, 'AC7', '_book', 26, False, 'no_clean_sentinel'),
        (12, 'AC7', 'mintAll', 44, False, 'no_clean_sentinel'),
        (12, 'AC7', 'setComptroller', 11, False, 'no_clean_sentinel'),
        (12, 'AC7', 'settle', 35, False, 'no_clean_sentinel'),
        (12, 'RE1', 'deposit', 14, False, 'no_clean_sentinel'),
        (12, 'RE1', 'pull', 18, False, 'no_clean_sentinel'),
        (12, 'RE2', 'deposit', 14, False, 'no_clean_sentinel'),
        (12, 'RE2', 'pull', 18, False, 'no_clean_sentinel'),
        (12, 'RE2', 'settle', 39, False, 'no_clean_sentinel'),
        (12, 'RE4', 'deposit', 14, False, 'no_clean_sentinel'),
        (12, 'RE4', 'mintAll', 43, True, 'no_callback_state_order'),
        (12, 'RE4', 'payLater', 22, True, 'no_callback_state_order'),
        (12, 'RE4', 'setComptroller', 10, True, 'no_callback_state_order'),
        (12, 'RE6', '_push', 37, True, 'no_callback_state_order'),
        (12, 'RE6', 'trade', 29, True, 'no_callback_state_order'),
        (12, 'RE7', 'deposit', 14, False, 'no_clean_sentinel'),
        (12, 'RE7', 'mintAll', 43, True, 'no_callback_state_order'),
        (12, 'RE7', 'settle', 39, False, 'no_clean_sentinel'),
        (12, 'RE7', 'sweep', 47, True, 'no_callback_state_order'),
        (13, 'AC7', 'issue', 19, False, 'no_clean_sentinel'),
        (13, 'AC7', 'liquidateFor', 26, False, 'no_clean_sentinel'),
        (13, 'AC7', 'mark', 29, False, 'no_clean_sentinel'),
        (13, 'AC7', 'rescue', 22, False, 'no_clean_sentinel'),
        (14, 'AC7', 'claimReceipt', 36, False, 'no_clean_sentinel'),
        (14, 'AC7', 'fillOrder', 32, False, 'no_clean_sentinel'),
        (14, 'TM11', 'cancelExpired', 25, False, 'no_clean_sentinel'),
        (14, 'TM11', 'executeOrder', 18, False, 'no_clean_sentinel'),
        (14, 'TM11', 'executeOrder', 21, False, 'no_clean_sentinel'),
        (14, 'TM11', 'placeOrder', 11, False, 'no_clean_sentinel'),
        (14, 'TM11', 'placeOrder', 14, False, 'no_clean_sentinel'),
        (14, 'TM12', 'cancelExpired', 25, False, 'no_clean_sentinel'),
        (14, 'TM12', 'placeOrder', 11, False, 'no_clean_sentinel'),
        (14, 'TM4', 'claimReceipt', 35, False, 'no_clean_sentinel'),
        (14, 'TM5', 'executeOrder', 18, False, 'no_clean_sentinel'),
        (14, 'TM7', 'cancelExpired', 25, False, 'no_clean_sentinel'),
        (14, 'TM7', 'executeOrder', 18, False, 'no_clean_sentinel'),
        (14, 'TM7', 'executeOrder', 21, False, 'no_clean_sentinel'),
        (14, 'TM7', 'placeOrder', 11, False, 'no_clean_sentinel'),
        (14, 'TM7', 'placeOrder', 14, False, 'no_clean_sentinel'),
        (15, 'TM10', 'accrue', 23, False, 'no_clean_sentinel'),
        (15, 'TM11', 'accrue', 23, False, 'no_clean_sentinel'),
        (15, 'TM11', 'getTime', 8, False, 'no_clean_sentinel'),
        (15, 'TM12', 'join', 30, False, 'no_clean_sentinel'),
        (15, 'TM8', 'getTime', 8, False, 'no_clean_sentinel'),
        (16, 'FR4', 'compound', 14, False, 'no_clean_sentinel'),
        (16, 'FR4', 'harvest', 6, False, 'no_clean_sentinel'),
        (16, 'FR5', '_sell', 14, False, 'no_clean_sentinel'),
        (16, 'FR5', 'harvest', 6, False, 'no_clean_sentinel'),
        (16, 'FR5', 'redeem', 19, False, 'no_clean_sentinel'),
        (17, 'AR4', 'fill', 11, False, 'no_clean_sentinel'),
        (17, 'AR5', '_lock', 8, False, 'no_clean_sentinel'),
        (17, 'AR6', '_lock', 7, False, 'no_clean_sentinel'),
        (17, 'AR6', 'cost', 16, False, 'no_clean_sentinel'),
        (17, 'FR6', 'fill', 11, False, 'no_clean_sentinel'),
        (17, 'TM11', '_lock', 8, False, 'no_clean_sentinel'),
        (2, 'AC2', 'buy', 5, False, 'no_clean_sentinel'),
        (2, 'AC7', '_grant', 5, False, 'no_clean_sentinel'),
        (2, 'AC8', 'buy', 16, False, 'no_clean_sentinel'),
        (3, 'AC2', 'adjust', 35, False, 'no_clean_sentinel'),
        (3, 'AC2', 'initialize', 16, False, 'no_clean_sentinel'),
        (3, 'AC2', 'setOwner', 22, False, 'no_clean_sentinel'),
        (3, 'AC7', '_apply', 35, False, 'no_clean_sentinel'),
        (3, 'AC7', 'initialize', 16, False, 'no_clean_sentinel'),
        (3, 'AC7', 'setFee', 19, True, 'effective_authorization_guard'),
        (3, 'AC7', 'setFeeChecked', 29, True, 'effective_authorization_guard'),
        (3, 'AC7', 'setFeeLoose', 25, False, 'no_clean_sentinel'),
        (3, 'AC7', 'setOwner', 22, False, 'no_clean_sentinel'),
        (4, 'AC1', 'setTreasury', 6, False, 'no_clean_sentinel'),
        (4, 'AC2', 'join', 17, False, 'no_clean_sentinel'),
        (4, 'AC2', 'remember', 20, False, 'no_clean_sentinel'),
        (4, 'AC2', 'setTreasury', 14, True, 'effective_authorization_guard'),
        (4, 'AC5', 'remember', 20, False, 'no_clean_sentinel'),
        (4, 'AC5', 'sweep', 23, False, 'no_clean_sentinel'),
        (4, 'AC7', 'join', 17, False, 'no_clean_sentinel'),
        (4, 'AC7', 'remember', 20, False, 'no_clean_sentinel'),
        (4, 'AC7', 'setTreasury', 14, True, 'effective_authorization_guard'),
        (4, 'AC7', 'sweep', 23, False, 'no_clean_sentinel'),
        (5, 'AC7', 'emitted', 23, False, 'no_clean_sentinel'),
        (5, 'UC1', 'dropped', 5, False, 'no_clean_sentinel'),
        (5, 'UC1', 'unused', 8, False, 'no_clean_sentinel'),
        (5, 'UC3', 'branched', 14, True, 'checked_or_captured_return'),
        (5, 'UC3', 'dropped', 5, False, 'no_clean_sentinel'),
        (5, 'UC3', 'emitted', 23, False, 'no_clean_sentinel'),
        (5, 'UC3', 'returned', 20, False, 'no_clean_sentinel'),
        (5, 'UC3', 'unused', 8, False, 'no_clean_sentinel'),
        (6, 'RE2', 'kept', 14, False, 'no_clean_sentinel'),
        (6, 'UC3', 'loose', 11, False, 'no_clean_sentinel'),
        (6, 'UC3', 'strict', 18, False, 'no_clean_sentinel'),
        (7, 'UC6', 'blind', 5, False, 'no_clean_sentinel'),
        (8, 'AC7', 'mint', 9, False, 'no_clean_sentinel'),
        (8, 'AR1', 'mint', 10, False, 'no_clean_sentinel'),
        (8, 'AR1', 'mint', 9, False, 'no_clean_sentinel'),
        (8, 'AR5', 'mint', 9, False, 'no_clean_sentinel'),
        (8, 'AR6', 'mint', 9, False, 'no_clean_sentinel'),
        (8, 'AR6', 'scale', 19, False, 'no_clean_sentinel'),
        (9, 'AC6', 'buy', 9, False, 'no_clean_sentinel'),
        (9, 'AC7', 'setPrice', 6, False, 'no_clean_sentinel'),
        (9, 'FR1', 'buy', 9, False, 'no_clean_sentinel'),
        (9, 'FR2', 'approveSpender', 21, False, 'no_clean_sentinel'),
        (9, 'FR3', 'swapAll', 13, False, 'no_clean_sentinel'),
        (9, 'FR6', 'swapAll', 12, False, 'no_clean_sentinel'),
        (9, 'GR8', 'buy', 8, False, 'no_clean_sentinel'),
    ]),
    'ca5_merge': ('risk_type:s fn:s line:l entrypoint:s rule_id:s evidence_lines:L clean:b admission:b', [
        (0, 'access_control', 'guarded', 20, 'guarded', 'AC6', [20], False, True),
        (0, 'access_control', 'withdraw', 15, 'withdraw', 'AC6', [15], False, True),
        (0, 'reentrancy', 'withdraw', 15, 'withdraw', 'RE1', [15, 17], False, True),
        (1, 'access_control', 'claim', 6, 'claim', 'AC7', [4, 6], False, True),
        (1, 'reentrancy', 'claim', 12, 'claim', 'RE2', [6, 12], False, True),
        (10, 'access_control', 'release', 20, 'release', 'AC6', [20], False, True),
        (10, 'front_running', 'release', 17, 'release', 'GR8', [17], False, True),
        (10, 'time_manipulation', 'claim', 8, 'claim', 'TM5', [8, 23], False, True),
        (10, 'time_manipulation', 'inWindow', 8, 'inWindow', 'TM6', [8], False, True),
        (10, 'time_manipulation', 'release', 18, 'release', 'TM11', [18, 19], False, True),
        (10, 'time_manipulation', 'release', 19, 'release', 'TM5', [18, 19, 20], False, True),
        (10, 'time_manipulation', 'remaining', 26, 'remaining', 'TM10', [26], False, True),
        (12, 'access_control', '_book', 26, 'payLater', 'AC7', [21, 26], False, True),
        (12, 'access_control', 'mintAll', 44, 'mintAll', 'AC7', [42, 44], False, True),
        (12, 'access_control', 'setComptroller', 11, 'setComptroller', 'AC7', [9, 11], False, True),
        (12, 'access_control', 'settle', 35, 'settle', 'AC7', [33, 35], False, True),
        (12, 'reentrancy', '_push', 37, 'settle', 'RE6', [35, 37, 39], True, False),
        (12, 'reentrancy', 'deposit', 14, 'deposit', 'RE1', [14, 15], False, True),
        (12, 'reentrancy', 'mintAll', 43, 'mintAll', 'RE4', [43, 44], True, False),
        (12, 'reentrancy', 'payLater', 22, 'payLater', 'RE4', [22, 26], True, False),
        (12, 'reentrancy', 'pull', 18, 'pull', 'RE1', [18, 19], False, True),
        (12, 'reentrancy', 'setComptroller', 10, 'setComptroller', 'RE4', [10, 11], True, False),
        (12, 'reentrancy', 'settle', 39, 'settle', 'RE2', [35, 39], False, True),
        (12, 'reentrancy', 'sweep', 47, 'sweep', 'RE7', [47, 48], True, False),
        (12, 'reentrancy', 'trade', 29, 'trade', 'RE6', [29, 31], True, False),
        (13, 'access_control', 'issue', 19, 'issue', 'AC7', [18, 19], False, True),
        (13, 'access_control', 'liquidateFor', 26, 'liquidateFor', 'AC7', [24, 25, 26], False, True),
        (13, 'access_control', 'mark', 29, 'mark', 'AC7', [28, 29], False, True),
        (13, 'access_control', 'rescue', 22, 'rescue', 'AC7', [21, 22], False, True),
        (14, 'access_control', 'claimReceipt', 36, 'claimReceipt', 'AC7', [34, 36], False, True),
        (14, 'access_control', 'fillOrder', 32, 'fillOrder', 'AC7', [31, 32], False, True),
        (14, 'time_manipulation', 'cancelExpired', 25, 'cancelExpired', 'TM12', [25], False, True),
        (14, 'time_manipulation', 'claimReceipt', 35, 'claimReceipt', 'TM4', [35], False, True),
        (14, 'time_manipulation', 'executeOrder', 18, 'executeOrder', 'TM5', [18, 20, 21], False, True),
        (14, 'time_manipulation', 'executeOrder', 21, 'executeOrder', 'TM7', [18, 21], False, True),
        (14, 'time_manipulation', 'placeOrder', 11, 'placeOrder', 'TM12', [11, 14], False, True),
        (14, 'time_manipulation', 'placeOrder', 14, 'placeOrder', 'TM7', [11, 14], False, True),
        (15, 'time_manipulation', 'accrue', 23, 'accrue', 'TM10', [23], False, True),
        (15, 'time_manipulation', 'getTime', 8, 'claim', 'TM8', [8, 11, 20, 29], False, True),
        (15, 'time_manipulation', 'getTime', 8, 'join', 'TM11', [7, 8, 29, 30], False, True),
        (15, 'time_manipulation', 'join', 30, 'join', 'TM12', [30], False, True),
        (16, 'front_running', '_sell', 15, 'compound', 'FR5', [12, 13, 14, 15], False, True),
        (16, 'front_running', 'compound', 14, 'compound', 'FR4', [8, 9, 14], False, True),
        (16, 'front_running', 'harvest', 6, 'harvest', 'FR4', [4, 5, 6], False, True),
        (16, 'front_running', 'redeem', 19, 'redeem', 'FR5', [17, 18, 19], False, True),
        (17, 'arithmetic', '_lock', 8, '_lock', 'AR5', [7, 8], False, True),
        (17, 'arithmetic', 'cost', 16, 'cost', 'AR6', [16, 17], False, True),
        (17, 'arithmetic', 'fill', 11, 'fill', 'AR4', [11, 12, 13], False, True),
        (17, 'front_running', 'fill', 13, 'fill', 'FR6', [11, 13], False, True),
        (17, 'time_manipulation', '_lock', 8, '_lock', 'TM11', [8], False, True),
        (2, 'access_control', '_grant', 5, 'buy', 'AC7', [5, 12], False, True),
        (2, 'access_control', 'buy', 16, 'buy', 'AC8', [16], False, True),
        (2, 'access_control', 'buy', 5, 'buy', 'AC2', [5, 12], False, True),
        (3, 'access_control', '_apply', 35, 'adjust', 'AC7', [31, 35], False, True),
        (3, 'access_control', 'adjust', 35, 'adjust', 'AC2', [31, 35], False, True),
        (3, 'access_control', 'initialize', 16, 'initialize', 'AC2', [15, 16], False, True),
        (3, 'access_control', 'setFee', 19, 'setFee', 'AC7', [5, 18, 19], True, False),
        (3, 'access_control', 'setFeeChecked', 29, 'setFeeChecked', 'AC7', [27, 28, 29], True, False),
        (3, 'access_control', 'setFeeLoose', 25, 'setFeeLoose', 'AC7', [24, 25], False, True),
        (3, 'access_control', 'setOwner', 22, 'setOwner', 'AC2', [21, 22], False, True),
        (4, 'access_control', 'join', 17, 'join', 'AC2', [16, 17], False, True),
        (4, 'access_control', 'remember', 20, 'remember', 'AC2', [19, 20], False, True),
        (4, 'access_control', 'setTreasury', 14, 'setTreasury', 'AC2', [5, 13, 14], True, False),
        (4, 'access_control', 'setTreasury', 6, 'setTreasury', 'AC1', [6, 14], False, True),
        (4, 'access_control', 'sweep', 23, 'sweep', 'AC5', [22, 23], False, True),
        (5, 'access_control', 'emitted', 23, 'emitted', 'AC7', [22, 23], False, True),
        (5, 'unchecked_low_level_calls', 'branched', 14, 'branched', 'UC3', [14], True, False),
        (5, 'unchecked_low_level_calls', 'dropped', 5, 'dropped', 'UC1', [5], False, True),
        (5, 'unchecked_low_level_calls', 'emitted', 23, 'emitted', 'UC3', [23], False, True),
        (5, 'unchecked_low_level_calls', 'returned', 20, 'returned', 'UC3', [20], False, True),
        (5, 'unchecked_low_level_calls', 'unused', 8, 'unused', 'UC1', [8], False, True),
        (6, 'reentrancy', 'kept', 14, 'kept', 'RE2', [14], False, True),
        (6, 'unchecked_low_level_calls', 'loose', 11, 'loose', 'UC3', [11], False, True),
        (6, 'unchecked_low_level_calls', 'strict', 18, 'strict', 'UC3', [18], False, True),
        (7, 'unchecked_low_level_calls', 'blind', 5, 'blind', 'UC6', [5], False, True),
        (8, 'access_control', 'mint', 9, 'mint', 'AC7', [8, 9, 10], False, True),
        (8, 'arithmetic', 'mint', 10, 'mint', 'AR1', [10], False, True),
        (8, 'arithmetic', 'mint', 9, 'mint', 'AR1', [9, 10], False, True),
        (8, 'arithmetic', 'scale', 19, 'scale', 'AR6', [19, 20], False, True),
        (9, 'access_control', 'buy', 9, 'buy', 'AC6', [9], False, True),
        (9, 'access_control', 'setPrice', 6, 'setPrice', 'AC7', [5, 6], False, True),
        (9, 'front_running', 'approveSpender', 21, 'approveSpender', 'FR2', [21], False, True),
        (9, 'front_running', 'buy', 8, 'buy', 'GR8', [8], False, True),
        (9, 'front_running', 'buy', 9, 'buy', 'FR1', [9], False, True),
        (9, 'front_running', 'swapAll', 12, 'swapAll', 'FR6', [12, 13], False, True),
        (9, 'front_running', 'swapAll', 13, 'swapAll', 'FR3', [13], False, True),
    ]),
    'ca7_findings_call_site': ('vulnerability_type:s fn:s entrypoint:s call_site_fn:s call_site_line:l sink:s sink_line:l primary_line:l anchor_lines:L mechanism:s', [
        (0, 'access_control', 'guarded', 'guarded', 'guarded', 20, 'guarded', 0, 20, [20], 'unauthorized_native_transfer'),
        (0, 'access_control', 'withdraw', 'withdraw', 'withdraw', 15, 'withdraw', 0, 15, [15], 'unauthorized_native_transfer'),
        (0, 'reentrancy', 'withdraw', 'withdraw', 'withdraw', 15, 'withdraw', 17, 17, [15, 17], 'external_call_before_state_write'),
        (1, 'access_control', 'claim', 'claim', 'claim', 6, 'claim', 6, 6, [4, 6], 'source_access_surface:generic_state'),
        (1, 'reentrancy', 'claim', 'claim', 'pay', 12, 'claim', 6, 6, [6, 12], 'source_event_sequence'),
        (10, 'access_control', 'release', 'release', 'release', 20, 'release', 0, 20, [20], 'unauthorized_native_transfer'),
        (10, 'front_running', 'release', 'release', 'release', 17, 'release', 0, 17, [17], 'financial_read_write_conflict'),
        (10, 'time_manipulation', 'claim', 'claim', '', 8, 'claim', 0, 8, [8, 23], 'modifier_time_window'),
        (10, 'time_manipulation', 'inWindow', 'inWindow', '', 8, 'inWindow', 0, 8, [8], 'lifecycle_boundary'),
        (10, 'time_manipulation', 'release', 'release', 'release', 18, 'release', 0, 18, [18, 19], 'temporal_producer_consumer'),
        (10, 'time_manipulation', 'release', 'release', 'release', 19, 'release', 0, 19, [18, 19, 20], 'timestamp_gate'),
        (10, 'time_manipulation', 'remaining', 'remaining', 'remaining', 26, 'remaining', 0, 26, [26], 'TM10'),
        (12, 'access_control', '_book', 'payLater', '_book', 26, '_book', 26, 26, [21, 26], 'source_access_surface:generic_state'),
        (12, 'access_control', 'mintAll', 'mintAll', 'mintAll', 44, 'mintAll', 44, 44, [42, 44], 'source_access_surface:generic_state'),
        (12, 'access_control', 'setComptroller', 'setComptroller', 'setComptroller', 11, 'setComptroller', 11, 11, [9, 11], 'source_access_surface:generic_state'),
        (12, 'access_control', 'settle', 'settle', 'settle', 35, 'settle', 35, 35, [33, 35], 'source_access_surface:generic_state'),
        (12, 'reentrancy', 'deposit', 'deposit', 'deposit', 14, 'deposit', 15, 15, [14, 15], 'external_call_before_state_write'),
        (12, 'reentrancy', 'pull', 'pull', 'pull', 18, 'pull', 19, 19, [18, 19], 'external_call_before_state_write'),
        (12, 'reentrancy', 'settle', 'settle', '_push', 39, 'settle', 35, 35, [35, 39], 'source_event_sequence'),
        (13, 'access_control', 'issue', 'issue', 'issue', 19, 'issue', 19, 19, [18, 19], 'source_access_surface:global_state'),
        (13, 'access_control', 'liquidateFor', 'liquidateFor', 'liquidateFor', 26, 'liquidateFor', 26, 26, [24, 25, 26], 'source_access_surface:subject_scoped_state'),
        (13, 'access_control', 'mark', 'mark', 'mark', 29, 'mark', 29, 29, [28, 29], 'source_access_surface:generic_state'),
        (13, 'access_control', 'rescue', 'rescue', 'rescue', 22, 'rescue', 22, 22, [21, 22], 'source_access_surface:asset_operation'),
        (14, 'access_control', 'claimReceipt', 'claimReceipt', 'claimReceipt', 36, 'claimReceipt', 36, 36, [34, 36], 'source_access_surface:generic_state'),
        (14, 'access_control', 'fillOrder', 'fillOrder', 'fillOrder', 32, 'fillOrder', 32, 32, [31, 32], 'source_access_surface:generic_state'),
        (14, 'time_manipulation', 'cancelExpired', 'cancelExpired', 'cancelExpired', 25, 'cancelExpired', 0, 25, [25], 'clock_in_condition'),
        (14, 'time_manipulation', 'claimReceipt', 'claimReceipt', 'claimReceipt', 35, 'claimReceipt', 0, 35, [35], 'signed_receipt_missing_quest_expiry'),
        (14, 'time_manipulation', 'executeOrder', 'executeOrder', 'executeOrder', 18, 'executeOrder', 0, 18, [18, 20, 21], 'timestamp_gate'),
        (14, 'time_manipulation', 'executeOrder', 'executeOrder', 'executeOrder', 21, 'executeOrder', 0, 21, [18, 21], 'order_expiration_execution_timestamp_record'),
        (14, 'time_manipulation', 'placeOrder', 'placeOrder', 'placeOrder', 11, 'placeOrder', 0, 11, [11, 14], 'clock_in_condition'),
        (14, 'time_manipulation', 'placeOrder', 'placeOrder', 'placeOrder', 14, 'placeOrder', 0, 14, [11, 14], 'order_creation_timestamp_assignment'),
        (15, 'time_manipulation', 'accrue', 'accrue', 'accrue', 23, 'accrue', 0, 23, [23], 'TM10'),
        (15, 'time_manipulation', 'getTime', 'claim', 'getTime', 8, 'getTime', 0, 8, [8, 11, 20, 29], 'timestamp_provider_to_vesting_asset_consumer'),
        (15, 'time_manipulation', 'getTime', 'join', 'getTime', 8, 'join', 30, 8, [7, 8, 29, 30], 'temporal_producer_consumer'),
        (15, 'time_manipulation', 'join', 'join', 'join', 30, 'join', 0, 30, [30], 'clock_in_condition'),
        (16, 'front_running', '_sell', 'compound', '_sell', 15, '_sell', 14, 13, [12, 13, 14, 15], 'permissionless_quote_then_asset_settlement'),
        (16, 'front_running', 'compound', 'compound', '_sell', 14, '_sell', 0, 14, [8, 9, 14], 'permissionless_quote_then_swap_configurable_slippage'),
        (16, 'front_running', 'harvest', 'harvest', 'harvest', 6, 'harvest', 0, 5, [4, 5, 6], 'permissionless_balance_dependent_amm_swap_zero_slippage'),
        (16, 'front_running', 'redeem', 'redeem', 'redeem', 19, 'redeem', 19, 18, [17, 18, 19], 'permissionless_ratio_quote_then_asset_settlement'),
        (17, 'arithmetic', '_lock', '_lock', '_lock', 8, '_lock', 0, 8, [7, 8], 'legacy_unchecked_arithmetic'),
        (17, 'arithmetic', 'cost', 'cost', 'cost', 16, 'cost', 0, 16, [16, 17], 'legacy_arithmetic_to_return'),
        (17, 'arithmetic', 'fill', 'fill', 'fill', 11, 'fill', 0, 11, [11, 12, 13], 'helper_arithmetic_provenance'),
        (17, 'front_running', 'fill', 'fill', 'fill', 13, 'fill', 13, 11, [11, 13], 'unbounded_quote_to_asset_sink'),
        (17, 'time_manipulation', '_lock', '_lock', '_lock', 8, '_lock', 0, 8, [8], 'temporal_producer_consumer'),
        (2, 'access_control', '_grant', 'buy', '_grant', 5, '_grant', 5, 5, [5, 12], 'source_access_surface:generic_state'),
        (2, 'access_control', 'buy', 'buy', '_grant', 16, '_grant', 0, 16, [16], 'inherited_effect_propagation'),
        (2, 'access_control', 'buy', 'buy', '_grant', 5, '_grant', 0, 5, [5, 12], 'unprotected_critical_state_write'),
        (3, 'access_control', '_apply', 'adjust', '_apply', 35, '_apply', 35, 35, [31, 35], 'source_access_surface:generic_state'),
        (3, 'access_control', 'adjust', 'adjust', '_apply', 35, '_apply', 0, 35, [31, 35], 'unprotected_critical_state_write'),
        (3, 'access_control', 'initialize', 'initialize', 'initialize', 16, 'initialize', 0, 16, [15, 16], 'unprotected_critical_state_write'),
        (3, 'access_control', 'setFeeLoose', 'setFeeLoose', 'setFeeLoose', 25, 'setFeeLoose', 25, 25, [24, 25], 'source_access_surface:asset_operation'),
        (3, 'access_control', 'setOwner', 'setOwner', 'setOwner', 22, 'setOwner', 0, 22, [21, 22], 'unprotected_critical_state_write'),
        (4, 'access_control', 'join', 'join', 'join', 17, 'join', 0, 17, [16, 17], 'unprotected_critical_state_write'),
        (4, 'access_control', 'remember', 'remember', 'remember', 20, 'remember', 0, 20, [19, 20], 'unprotected_critical_state_write'),
        (4, 'access_control', 'setTreasury', 'setTreasury', '', 6, 'setTreasury', 0, 6, [6, 14], 'tx_origin_modifier_authorization'),
        (4, 'access_control', 'sweep', 'sweep', 'sweep', 23, 'sweep', 0, 23, [22, 23], 'tx_origin_asset_argument'),
        (5, 'access_control', 'emitted', 'emitted', 'emitted', 23, 'emitted', 23, 23, [22, 23], 'source_access_surface:asset_operation'),
        (5, 'unchecked_low_level_calls', 'dropped', 'dropped', 'dropped', 5, 'dropped', 0, 5, [5], 'low_level_status_unchecked'),
        (5, 'unchecked_low_level_calls', 'emitted', 'emitted', 'emitted', 23, 'emitted', 0, 23, [23], 'source_unchecked_low_level_call'),
        (5, 'unchecked_low_level_calls', 'returned', 'returned', 'returned', 20, 'returned', 0, 20, [20], 'source_unchecked_low_level_call'),
        (5, 'unchecked_low_level_calls', 'unused', 'unused', 'unused', 8, 'unused', 0, 8, [8], 'low_level_status_unchecked'),
        (6, 'reentrancy', 'kept', 'kept', 'kept', 14, 'kept', 14, 14, [14], 'source_event_sequence'),
        (6, 'unchecked_low_level_calls', 'loose', 'loose', 'loose', 11, 'loose', 0, 11, [11], 'typed_return_discard'),
        (6, 'unchecked_low_level_calls', 'strict', 'strict', 'strict', 18, 'strict', 0, 18, [18], 'typed_return_discard'),
        (7, 'unchecked_low_level_calls', 'blind', 'blind', 'blind', 5, 'blind', 0, 5, [5], 'assembly_call_status_discard'),
        (8, 'access_control', 'mint', 'mint', 'mint', 9, 'mint', 10, 10, [8, 9, 10], 'source_access_surface:generic_state'),
        (8, 'arithmetic', 'mint', 'mint', 'mint', 10, 'mint', 0, 10, [10], 'caller_controlled_arithmetic_write'),
        (8, 'arithmetic', 'mint', 'mint', 'mint', 9, 'mint', 0, 9, [9, 10], 'caller_controlled_arithmetic_write'),
        (8, 'arithmetic', 'scale', 'scale', 'scale', 19, 'scale', 0, 19, [19, 20], 'legacy_arithmetic_to_return'),
        (9, 'access_control', 'buy', 'buy', 'buy', 9, 'buy', 0, 9, [9], 'unauthorized_native_transfer'),
        (9, 'access_control', 'setPrice', 'setPrice', 'setPrice', 6, 'setPrice', 6, 6, [5, 6], 'source_access_surface:generic_state'),
        (9, 'front_running', 'approveSpender', 'approveSpender', 'approveSpender', 21, 'approveSpender', 0, 21, [21], 'FR2'),
        (9, 'front_running', 'buy', 'buy', 'buy', 8, 'buy', 0, 8, [8], 'financial_read_write_conflict'),
        (9, 'front_running', 'buy', 'buy', 'buy', 9, 'buy', 0, 9, [9], 'FR1'),
        (9, 'front_running', 'swapAll', 'swapAll', 'swapAll', 12, 'swapAll', 13, 12, [12, 13], 'unbounded_quote_to_asset_sink'),
        (9, 'front_running', 'swapAll', 'swapAll', 'swapAll', 13, 'swapAll', 0, 13, [13], 'FR3'),
    ]),
    'ca7_findings_sink': ('vulnerability_type:s fn:s primary_line:l anchor_lines:L', [
        (0, 'access_control', 'guarded', 20, [20]),
        (0, 'access_control', 'withdraw', 15, [15]),
        (0, 'reentrancy', 'withdraw', 17, [15, 17]),
        (1, 'access_control', 'claim', 6, [4, 6]),
        (1, 'reentrancy', 'claim', 6, [6, 12]),
        (10, 'access_control', 'release', 20, [20]),
        (10, 'front_running', 'release', 17, [17]),
        (10, 'time_manipulation', 'claim', 8, [8, 23]),
        (10, 'time_manipulation', 'inWindow', 8, [8]),
        (10, 'time_manipulation', 'release', 18, [18, 19]),
        (10, 'time_manipulation', 'release', 19, [18, 19, 20]),
        (10, 'time_manipulation', 'remaining', 26, [26]),
        (12, 'access_control', '_book', 26, [21, 26]),
        (12, 'access_control', 'mintAll', 44, [42, 44]),
        (12, 'access_control', 'setComptroller', 11, [9, 11]),
        (12, 'access_control', 'settle', 35, [33, 35]),
        (12, 'reentrancy', 'deposit', 15, [14, 15]),
        (12, 'reentrancy', 'pull', 19, [18, 19]),
        (12, 'reentrancy', 'settle', 35, [35, 39]),
        (13, 'access_control', 'issue', 19, [18, 19]),
        (13, 'access_control', 'liquidateFor', 26, [24, 25, 26]),
        (13, 'access_control', 'mark', 29, [28, 29]),
        (13, 'access_control', 'rescue', 22, [21, 22]),
        (14, 'access_control', 'claimReceipt', 36, [34, 36]),
        (14, 'access_control', 'fillOrder', 32, [31, 32]),
        (14, 'time_manipulation', 'cancelExpired', 25, [25]),
        (14, 'time_manipulation', 'claimReceipt', 35, [35]),
        (14, 'time_manipulation', 'executeOrder', 18, [18, 20, 21]),
        (14, 'time_manipulation', 'executeOrder', 21, [18, 21]),
        (14, 'time_manipulation', 'placeOrder', 11, [11, 14]),
        (14, 'time_manipulation', 'placeOrder', 14, [11, 14]),
        (15, 'time_manipulation', 'accrue', 23, [23]),
        (15, 'time_manipulation', 'getTime', 8, [8, 11, 20, 29]),
        (15, 'time_manipulation', 'join', 30, [30]),
        (15, 'time_manipulation', 'join', 30, [7, 8, 29, 30]),
        (16, 'front_running', '_sell', 13, [12, 13, 14, 15]),
        (16, 'front_running', '_sell', 14, [8, 9, 14]),
        (16, 'front_running', 'harvest', 5, [4, 5, 6]),
        (16, 'front_running', 'redeem', 18, [17, 18, 19]),
        (17, 'arithmetic', '_lock', 8, [7, 8]),
        (17, 'arithmetic', 'cost', 16, [16, 17]),
        (17, 'arithmetic', 'fill', 11, [11, 12, 13]),
        (17, 'front_running', 'fill', 11, [11, 13]),
        (17, 'time_manipulation', '_lock', 8, [8]),
        (2, 'access_control', '_grant', 16, [16]),
        (2, 'access_control', '_grant', 5, [5, 12]),
        (2, 'access_control', '_grant', 5, [5, 12]),
        (3, 'access_control', '_apply', 35, [31, 35]),
        (3, 'access_control', '_apply', 35, [31, 35]),
        (3, 'access_control', 'initialize', 16, [15, 16]),
        (3, 'access_control', 'setFeeLoose', 25, [24, 25]),
        (3, 'access_control', 'setOwner', 22, [21, 22]),
        (4, 'access_control', 'join', 17, [16, 17]),
        (4, 'access_control', 'remember', 20, [19, 20]),
        (4, 'access_control', 'setTreasury', 6, [6, 14]),
        (4, 'access_control', 'sweep', 23, [22, 23]),
        (5, 'access_control', 'emitted', 23, [22, 23]),
        (5, 'unchecked_low_level_calls', 'dropped', 5, [5]),
        (5, 'unchecked_low_level_calls', 'emitted', 23, [23]),
        (5, 'unchecked_low_level_calls', 'returned', 20, [20]),
        (5, 'unchecked_low_level_calls', 'unused', 8, [8]),
        (6, 'reentrancy', 'kept', 14, [14]),
        (6, 'unchecked_low_level_calls', 'loose', 11, [11]),
        (6, 'unchecked_low_level_calls', 'strict', 18, [18]),
        (7, 'unchecked_low_level_calls', 'blind', 5, [5]),
        (8, 'access_control', 'mint', 10, [8, 9, 10]),
        (8, 'arithmetic', 'mint', 10, [10]),
        (8, 'arithmetic', 'mint', 9, [9, 10]),
        (8, 'arithmetic', 'scale', 19, [19, 20]),
        (9, 'access_control', 'buy', 9, [9]),
        (9, 'access_control', 'setPrice', 6, [5, 6]),
        (9, 'front_running', 'approveSpender', 21, [21]),
        (9, 'front_running', 'buy', 8, [8]),
        (9, 'front_running', 'buy', 9, [9]),
        (9, 'front_running', 'swapAll', 12, [12, 13]),
        (9, 'front_running', 'swapAll', 13, [13]),
    ]),
    'ca8_risk_function_map': ('risk_type:s functions:S', [
        (0, 'access_control', ['guarded', 'withdraw']),
        (0, 'reentrancy', ['withdraw']),
        (1, 'access_control', ['claim']),
        (1, 'reentrancy', ['claim']),
        (10, 'access_control', ['release']),
        (10, 'front_running', ['release']),
        (10, 'time_manipulation', ['claim', 'inWindow', 'release', 'remaining']),
        (12, 'access_control', ['_book', 'mintAll', 'setComptroller', 'settle']),
        (12, 'reentrancy', ['deposit', 'pull', 'settle']),
        (13, 'access_control', ['issue', 'liquidateFor', 'mark', 'rescue']),
        (14, 'access_control', ['claimReceipt', 'fillOrder']),
        (14, 'time_manipulation', ['cancelExpired', 'claimReceipt', 'executeOrder', 'placeOrder']),
        (15, 'time_manipulation', ['accrue', 'getTime', 'join']),
        (16, 'front_running', ['_sell', 'compound', 'harvest', 'redeem']),
        (17, 'arithmetic', ['_lock', 'cost', 'fill']),
        (17, 'front_running', ['fill']),
        (17, 'time_manipulation', ['_lock']),
        (2, 'access_control', ['_grant', 'buy']),
        (3, 'access_control', ['_apply', 'adjust', 'initialize', 'setFeeLoose', 'setOwner']),
        (4, 'access_control', ['join', 'remember', 'setTreasury', 'sweep']),
        (5, 'access_control', ['emitted']),
        (5, 'unchecked_low_level_calls', ['dropped', 'emitted', 'returned', 'unused']),
        (6, 'reentrancy', ['kept']),
        (6, 'unchecked_low_level_calls', ['loose', 'strict']),
        (7, 'unchecked_low_level_calls', ['blind']),
        (8, 'access_control', ['mint']),
        (8, 'arithmetic', ['mint', 'scale']),
        (9, 'access_control', ['buy', 'setPrice']),
        (9, 'front_running', ['approveSpender', 'buy', 'swapAll']),
    ]),
    'ca9_enabled_rules': ('rule_id:s fn:s line:l', [
        (0, 'RE1', 'withdraw', 15),
        (12, 'RE1', 'deposit', 14),
        (12, 'RE1', 'pull', 18),
        (2, 'AC2', 'buy', 5),
        (3, 'AC2', 'adjust', 35),
        (3, 'AC2', 'initialize', 16),
        (3, 'AC2', 'setOwner', 22),
        (4, 'AC1', 'setTreasury', 6),
        (4, 'AC2', 'join', 17),
        (4, 'AC2', 'remember', 20),
        (4, 'AC2', 'setTreasury', 14),
        (5, 'UC3', 'branched', 14),
        (5, 'UC3', 'dropped', 5),
        (5, 'UC3', 'emitted', 23),
        (5, 'UC3', 'returned', 20),
        (5, 'UC3', 'unused', 8),
        (6, 'UC3', 'loose', 11),
        (6, 'UC3', 'strict', 18),
        (7, 'UC6', 'blind', 5),
    ]),
    'ac1_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (4, 'AC1', 'access_control', 'Origin@', 'setTreasury', 'setTreasury', 'setTreasury', 6, None, [6, 14], [14], [], 0.93, 'tx_origin_modifier_authorization'),
    ]),
    'ac2_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (2, 'AC2', 'access_control', 'Shop@', 'buy', 'buy', '_grant', 5, None, [5, 12], [5], [], 0.88, 'unprotected_critical_state_write'),
        (3, 'AC2', 'access_control', 'Admin@', 'adjust', 'adjust', '_apply', 35, None, [31, 35], [35], [], 0.88, 'unprotected_critical_state_write'),
        (3, 'AC2', 'access_control', 'Admin@', 'initialize', 'initialize', 'initialize', 16, None, [15, 16], [16], [], 0.91, 'unprotected_critical_state_write'),
        (3, 'AC2', 'access_control', 'Admin@', 'setOwner', 'setOwner', 'setOwner', 22, None, [21, 22], [22], [], 0.91, 'unprotected_critical_state_write'),
        (4, 'AC2', 'access_control', 'Origin@', 'join', 'join', 'join', 17, None, [16, 17], [17], [], 0.88, 'unprotected_critical_state_write'),
        (4, 'AC2', 'access_control', 'Origin@', 'remember', 'remember', 'remember', 20, None, [19, 20], [20], [], 0.88, 'unprotected_critical_state_write'),
        (4, 'AC2', 'access_control', 'Origin@', 'setTreasury', 'setTreasury', 'setTreasury', 14, None, [13, 14], [14], [], 0.91, 'unprotected_critical_state_write'),
    ]),
    'ac5_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (4, 'AC5', 'access_control', 'Origin@', 'remember', 'remember', 'remember', 20, None, [20], [], [], 0.9, 'tx_origin_state_value'),
        (4, 'AC5', 'access_control', 'Origin@', 'sweep', 'sweep', 'sweep', 23, None, [23], [], [], 0.9, 'tx_origin_asset_argument'),
    ]),
    'ac6_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (0, 'AC6', 'access_control', 'Vault@', 'guarded', 'guarded', 'guarded', 20, None, [20], [], [], 0.8, 'unauthorized_native_transfer'),
        (0, 'AC6', 'access_control', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, None, [15], [], [], 0.8, 'unauthorized_native_transfer'),
        (10, 'AC6', 'access_control', 'Lock@', 'release', 'release', 'release', 20, None, [20], [], [], 0.8, 'unauthorized_native_transfer'),
        (9, 'AC6', 'access_control', 'Market@', 'buy', 'buy', 'buy', 9, None, [9], [], [], 0.8, 'unauthorized_native_transfer'),
    ]),
    'ac8_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (2, 'AC8', 'access_control', 'Shop@', 'buy', 'buy', '_grant', 16, None, [16], [], [], 0.6, 'inherited_effect_propagation'),
    ]),
    're1_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (0, 'RE1', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.84, 'external_call_before_state_write'),
        (12, 'RE1', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.84, 'external_call_before_state_write'),
        (12, 'RE1', 'reentrancy', 'Desk@', 'pull', 'pull', 'pull', 18, 19, [18, 19], [19], [], 0.84, 'external_call_before_state_write'),
    ]),
    're2_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (0, 'RE2', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.86, 'source_event_sequence'),
        (1, 'RE2', 'reentrancy', 'Chain@', 'claim', 'claim', 'claim', 12, 6, [6, 12], [6], [], 0.86, 'source_event_sequence'),
        (12, 'RE2', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.86, 'source_event_sequence'),
        (12, 'RE2', 'reentrancy', 'Desk@', 'pull', 'pull', 'pull', 18, 19, [18, 19], [19], [], 0.86, 'source_event_sequence'),
        (12, 'RE2', 'reentrancy', 'Desk@', 'settle', 'settle', 'settle', 39, 35, [35, 39], [35], [], 0.86, 'source_event_sequence'),
        (6, 'RE2', 'reentrancy', 'Payer@', 'kept', 'kept', 'kept', 14, 14, [14], [14], [], 0.86, 'source_event_sequence'),
    ]),
    'uc1_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (5, 'UC1', 'unchecked_low_level_calls', 'Caller@', 'dropped', 'dropped', 'dropped', 5, None, [5], [], [], 0.92, 'low_level_status_unchecked'),
        (5, 'UC1', 'unchecked_low_level_calls', 'Caller@', 'unused', 'unused', 'unused', 8, None, [8], [], [], 0.92, 'low_level_status_unchecked'),
    ]),
    'uc3_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'branched', 'branched', 'branched', 14, None, [14], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'dropped', 'dropped', 'dropped', 5, None, [5], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'emitted', 'emitted', 'emitted', 23, None, [23], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'returned', 'returned', 'returned', 20, None, [20], [], [], 0.93, 'source_unchecked_low_level_call'),
        (5, 'UC3', 'unchecked_low_level_calls', 'Caller@', 'unused', 'unused', 'unused', 8, None, [8], [], [], 0.93, 'source_unchecked_low_level_call'),
        (6, 'UC3', 'unchecked_low_level_calls', 'Payer@', 'loose', 'loose', 'loose', 11, None, [11], [], [], 0.9, 'typed_return_discard'),
        (6, 'UC3', 'unchecked_low_level_calls', 'Payer@', 'strict', 'strict', 'strict', 18, None, [18], [], [], 0.9, 'typed_return_discard'),
    ]),
    'uc6_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (7, 'UC6', 'unchecked_low_level_calls', 'Assembler@', 'blind', 'blind', 'blind', 5, None, [5], [], [], 0.92, 'assembly_call_status_discard'),
    ]),
    'ar1_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (8, 'AR1', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 10, None, [10], [10], [10], 0.85, 'caller_controlled_arithmetic_write'),
        (8, 'AR1', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 9, None, [9], [9], [9], 0.85, 'caller_controlled_arithmetic_write'),
    ]),
    'ar5_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (17, 'AR5', 'arithmetic', 'Powers@', '_lock', '_lock', '_lock', 8, None, [8], [], [8], 0.8, 'legacy_unchecked_arithmetic'),
        (8, 'AR5', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 9, None, [9, 10], [], [9, 10], 0.8, 'legacy_unchecked_arithmetic'),
    ]),
    'fr6_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (17, 'FR6', 'front_running', 'Powers@', 'fill', 'fill', 'fill', 11, 13, [11, 13], [], [11], 0.72, 'unbounded_quote_to_asset_sink'),
        (9, 'FR6', 'front_running', 'Market@', 'swapAll', 'swapAll', 'swapAll', 12, 13, [12, 13], [], [12], 0.72, 'unbounded_quote_to_asset_sink'),
    ]),
    'gr8_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (10, 'GR8', 'front_running', 'Lock@', 'release', 'release', 'release', 17, None, [17], [], [], 0.65, 'financial_read_write_conflict'),
        (9, 'GR8', 'front_running', 'Market@', 'buy', 'buy', 'buy', 8, None, [8], [], [], 0.65, 'financial_read_write_conflict'),
    ]),
    'tm5_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (10, 'TM5', 'time_manipulation', 'Lock@', 'claim', 'claim', 'claim', 8, None, [8, 23], [], [], 0.75, 'modifier_time_window'),
        (10, 'TM5', 'time_manipulation', 'Lock@', 'release', 'release', 'release', 19, None, [19, 20], [], [], 0.7, 'timestamp_gate'),
        (14, 'TM5', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 18, None, [18, 20], [], [], 0.7, 'timestamp_gate'),
    ]),
    'tm6_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (10, 'TM6', 'time_manipulation', 'Lock@', 'inWindow', 'inWindow', 'inWindow', 8, None, [8], [], [], 0.78, 'lifecycle_boundary'),
    ]),
    're5_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', []),
    'tm12_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (14, 'TM12', 'time_manipulation', 'Book@', 'cancelExpired', 'cancelExpired', 'cancelExpired', 25, None, [25], [], [], 0.55, 'clock_in_condition'),
        (14, 'TM12', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 11, None, [11], [], [], 0.55, 'clock_in_condition'),
        (15, 'TM12', 'time_manipulation', 'Vesting@', 'join', 'join', 'join', 30, None, [30], [], [], 0.55, 'clock_in_condition'),
    ]),
    'ps1_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (10, 'TM10', 'time_manipulation', 'Lock@', 'remaining', 'remaining', 'remaining', 26, None, [26], [], [], 0.6, 'TM10'),
        (15, 'TM10', 'time_manipulation', 'Vesting@', 'accrue', 'accrue', 'accrue', 23, None, [23], [], [], 0.6, 'TM10'),
        (9, 'FR1', 'front_running', 'Market@', 'buy', 'buy', 'buy', 9, None, [9], [], [], 0.65, 'FR1'),
        (9, 'FR2', 'front_running', 'Market@', 'approveSpender', 'approveSpender', 'approveSpender', 21, None, [21], [], [], 0.6, 'FR2'),
        (9, 'FR3', 'front_running', 'Market@', 'swapAll', 'swapAll', 'swapAll', 13, None, [13], [], [], 0.7, 'FR3'),
    ]),
    'hi2_hard_facts': ('fn:s line:l fact:s', [
        (0, 'guarded', 20, 'checked_return'),
        (0, 'orderly', 26, 'checked_return'),
        (0, 'withdraw', 15, 'checked_return'),
        (1, 'lost', 24, 'unreachable'),
        (1, 'pay', 12, 'checked_return'),
        (12, '_push', 39, 'checked_return'),
        (12, 'deposit', 14, 'protected_call'),
        (12, 'trade', 29, 'checked_return'),
        (13, '_forward', 6, 'unreachable'),
        (13, '_forward', 7, 'checked_return'),
        (13, 'half', 10, 'unreachable'),
        (13, 'push', 3, 'unreachable'),
        (17, '_lock', 7, 'unreachable'),
        (5, 'branched', 14, 'checked_return'),
        (5, 'dropped', 5, 'dropped_return'),
        (5, 'required', 11, 'checked_return'),
        (5, 'unused', 8, 'dropped_return'),
    ]),
    'gr14_def_use_chains': ('fn:s source:s name:s line:l sink:s sink_line:l', [
        (0, 'guarded', 'caller', 'ok', 20, 'require', 21),
        (0, 'orderly', 'caller', 'ok', 26, 'require', 27),
        (0, 'withdraw', 'caller', 'ok', 15, 'require', 16),
        (1, 'pay', 'caller', 'ok', 12, 'require', 13),
        (10, 'release', 'time', 'current', 18, 'require', 19),
        (15, 'claim', 'caller', 'amount', 18, 'assignment', 20),
        (15, 'claim', 'caller', 'amount', 18, 'index', 19),
    ]),
    'uc5_undebited_transfers': ('fn:s line:l', [
        (0, 'guarded', 20),
        (0, 'withdraw', 15),
        (1, 'pay', 12),
        (10, 'release', 20),
        (9, 'buy', 9),
    ]),
    'uc7_tracked_results': ('fn:s line:l method:s tracking:s check_line:l', [
        (0, 'guarded', 20, 'call', 'delayed_check', 21),
        (0, 'orderly', 26, 'call', 'delayed_check', 27),
        (0, 'withdraw', 15, 'call', 'delayed_check', 16),
        (1, 'pay', 12, 'call', 'delayed_check', 13),
        (12, '_push', 39, 'call', 'delayed_check', 40),
        (12, 'trade', 29, 'call', 'delayed_check', 30),
        (13, '_forward', 7, 'call', 'delayed_check', 8),
        (5, 'branched', 14, 'call', 'delayed_check', 15),
        (5, 'dropped', 5, 'call', 'orphan', None),
        (5, 'emitted', 23, 'delegatecall', 'never_checked', None),
        (5, 'unused', 8, 'call', 'never_checked', None),
    ]),
    'ar2_arithmetic_sinks': ('fn:s line:l name:s sink:s sink_line:l', [
        (17, 'cost', 16, 'c', 'return', 17),
        (8, 'scale', 19, 'c', 'return', 20),
    ]),
    'ar3_provenance': ('fn:s line:l provenance:s impact_line:l', [
        (17, 'cost', 16, 'sink', 17),
        (8, 'mint', 10, 'state_write', 10),
        (8, 'mint', 9, 'state_write', 9),
        (8, 'scale', 19, 'sink', 20),
    ]),
    'ef4_callback_events': ('fn:s line:l callback:s', [
        (0, 'guarded', 20, 'low_level_value_call'),
        (0, 'orderly', 26, 'low_level_value_call'),
        (0, 'withdraw', 15, 'low_level_value_call'),
        (1, 'pay', 12, 'low_level_value_call'),
        (10, 'release', 20, 'native_transfer'),
        (12, '_push', 39, 'low_level_value_call'),
        (12, 'deposit', 14, 'token_transfer'),
        (12, 'mintAll', 43, 'safe_mint'),
        (12, 'payLater', 22, 'token_transfer'),
        (12, 'pull', 18, 'token_transfer'),
        (12, 'sweep', 47, 'token_transfer'),
        (12, 'trade', 29, 'low_level_value_call'),
        (13, '_forward', 7, 'low_level_value_call'),
        (13, 'rescue', 22, 'token_transfer'),
        (14, 'executeOrder', 20, 'token_transfer'),
        (15, 'claim', 20, 'token_transfer'),
        (16, 'redeem', 19, 'token_transfer'),
        (17, 'fill', 13, 'token_transfer'),
        (4, 'sweep', 23, 'token_transfer'),
        (5, 'branched', 14, 'arbitrary_action'),
        (5, 'dropped', 5, 'arbitrary_action'),
        (5, 'emitted', 23, 'arbitrary_action'),
        (5, 'required', 11, 'native_transfer'),
        (5, 'returned', 20, 'native_transfer'),
        (5, 'unused', 8, 'arbitrary_action'),
        (6, 'kept', 14, 'token_transfer'),
        (6, 'loose', 11, 'token_transfer'),
        (6, 'strict', 18, 'token_transfer'),
        (9, 'buy', 9, 'native_transfer'),
        (9, 'swapAll', 13, 'pool_callback'),
        (9, 'swapBound', 18, 'pool_callback'),
    ]),
    'ef8_best_state_writes': ('fn:s call_line:l write_line:l score:i', [
        (0, 'guarded', 20, 22, 115),
        (0, 'withdraw', 15, 17, 115),
        (12, 'deposit', 14, 15, 115),
        (12, 'pull', 18, 19, 100),
    ]),
    'gu5_complete_guards': ('fn:s n:i complete:b', [
        (0, 'deposit', 1, False),
        (0, 'guarded', 1, False),
        (0, 'orderly', 1, False),
        (0, 'withdraw', 1, False),
        (12, 'deposit', 1, False),
        (13, 'liquidateFor', 1, False),
        (15, 'claim', 1, False),
        (2, '_grant', 1, False),
        (8, 'mint', 1, False),
        (8, 'move', 2, True),
    ]),
    'gr5_callback_libraries': ('library:s method:s', [
        (13, 'Sender@', '_forward'),
        (13, 'Sender@', 'push'),
    ]),
    'gr13_sink_flows': ('fn:s kinds:S names:S writers:S', [
        (0, 'deposit', ['missing_guard', 'state_write'], ['balances'], ['guarded', 'orderly', 'withdraw']),
        (0, 'guarded', ['external_call', 'state_write'], ['balances'], ['deposit', 'orderly', 'withdraw']),
        (0, 'orderly', ['external_call', 'state_write'], ['balances'], ['deposit', 'guarded', 'withdraw']),
        (0, 'withdraw', ['external_call', 'state_write'], ['balances'], ['deposit', 'guarded', 'orderly']),
        (1, 'claim', ['missing_guard', 'state_write'], ['credit'], []),
        (10, 'claim', ['missing_guard', 'state_write'], ['balances'], []),
        (10, 'setEnd', ['missing_guard', 'state_write'], ['end'], []),
        (10, 'setStart', ['missing_guard', 'state_write'], ['start'], []),
        (11, 'f', ['unbounded_loop'], [], []),
        (12, 'deposit', ['external_call', 'state_write'], ['balances'], []),
        (12, 'mintAll', ['missing_guard', 'state_write'], ['total'], ['pull', 'settle']),
        (12, 'pull', ['external_call', 'missing_guard', 'state_write'], ['total'], ['mintAll', 'settle']),
        (12, 'setComptroller', ['state_write'], ['comptroller'], []),
        (12, 'settle', ['missing_guard', 'state_write'], ['total'], ['mintAll', 'pull']),
        (12, 'sweep', ['external_call', 'missing_guard'], [], []),
        (12, 'trade', ['external_call'], [], []),
        (13, 'issue', ['missing_guard', 'state_write'], ['totalSupply'], []),
        (13, 'liquidateFor', ['external_call', 'missing_guard', 'state_write'], ['positions'], []),
        (13, 'mark', ['missing_guard', 'state_write'], ['marker'], []),
        (13, 'rescue', ['external_call', 'missing_guard'], [], []),
        (14, 'cancelExpired', ['state_write'], ['orders'], ['executeOrder', 'placeOrder']),
        (14, 'claimReceipt', ['missing_guard', 'state_write'], ['last'], ['fillOrder']),
        (14, 'executeOrder', ['external_call', 'state_write'], ['orders'], ['cancelExpired', 'placeOrder']),
        (14, 'fillOrder', ['missing_guard', 'state_write'], ['last'], ['claimReceipt']),
        (14, 'placeOrder', ['state_write'], ['orders'], ['cancelExpired', 'executeOrder']),
        (15, 'accrue', ['missing_guard', 'state_write'], ['rewardStored', 'start'], []),
        (15, 'capture', ['missing_guard', 'state_write'], ['unlockAt'], []),
        (15, 'claim', ['external_call', 'missing_guard', 'state_write'], ['claimed'], []),
        (16, 'redeem', ['external_call', 'missing_guard'], [], []),
        (17, 'fill', ['external_call'], [], []),
        (3, 'initialize', ['missing_guard', 'state_write'], ['owner'], ['setOwner']),
        (3, 'setFee', ['missing_guard', 'state_write'], ['fee'], ['setFeeLoose']),
        (3, 'setFeeChecked', ['state_write'], ['fee', 'owner'], ['initialize', 'setFeeLoose', 'setOwner']),
        (3, 'setFeeLoose', ['missing_guard', 'state_write'], ['fee'], []),
        (3, 'setOwner', ['missing_guard', 'state_write'], ['owner'], ['initialize']),
        (4, 'join', ['missing_guard', 'state_write'], ['treasury'], ['setTreasury']),
        (4, 'remember', ['missing_guard', 'state_write'], ['owner'], []),
        (4, 'setTreasury', ['missing_guard', 'state_write'], ['treasury'], ['join']),
        (5, 'branched', ['external_call', 'missing_guard'], [], []),
        (5, 'dropped', ['external_call', 'missing_guard', 'unchecked_call'], [], []),
        (5, 'emitted', ['external_call', 'missing_guard'], [], []),
        (5, 'required', ['external_call'], [], []),
        (5, 'returned', ['external_call', 'missing_guard'], [], []),
        (5, 'unused', ['external_call', 'missing_guard', 'unchecked_call'], [], []),
        (6, 'kept', ['external_call', 'missing_guard', 'state_write'], ['token'], []),
        (6, 'loose', ['external_call', 'missing_guard'], ['token'], ['kept']),
        (6, 'strict', ['external_call'], ['token'], ['kept']),
        (8, 'mint', ['missing_guard', 'state_write'], ['balances', 'supply'], ['move']),
        (8, 'move', ['state_write'], ['balances'], ['mint']),
        (9, 'approveSpender', ['missing_guard', 'state_write'], [], []),
        (9, 'setPrice', ['missing_guard', 'state_write'], ['price'], []),
    ]),
    're10_callback_anchors': ('fn:s entry:s kind:s line:l line_start:l line_end:l', [
        (0, 'withdraw', 'withdraw', 'low_level_value_call_before_persistent_state_write', 15, 14, 17),
        (1, 'claim', 'claim', 'interprocedural_low_level_value_call_before_persistent_state_write', 12, 4, 12),
        (12, 'deposit', 'deposit', 'token_transfer_before_persistent_state_write', 14, 13, 15),
        (12, 'mintAll', 'mintAll', 'safe_mint_before_persistent_state_write', 43, 42, 44),
        (12, 'payLater', 'payLater', 'token_transfer_before_helper_state_write', 22, 21, 26),
        (12, 'setComptroller', 'setComptroller', 'external_view_call_before_inherited_state_write', 10, 9, 11),
        (12, 'settle', 'settle', 'interprocedural_low_level_value_call_before_persistent_state_write', 39, 33, 39),
        (12, 'sweep', 'sweep', 'token_transfer_before_external_asset_action', 47, 46, 48),
    ]),
    're11_evidence_chains': ('root_fn:s path:s callback:s line:l read_line:l then:s then_line:l', [
        (0, 'withdraw', 'withdraw', 'low_level_value_call', 15, None, 'effect', 17),
        (1, 'claim', 'claim -> relay -> pay', 'low_level_value_call', 12, None, 'effect', 6),
        (12, 'deposit', 'deposit', 'token_transfer', 14, None, 'effect', 15),
        (12, 'mintAll', 'mintAll', 'safe_mint', 43, None, 'effect', 44),
        (12, 'payLater', 'payLater', 'token_transfer', 22, None, 'effect', 26),
        (12, 'pull', 'pull', 'token_transfer', 18, None, 'effect', 19),
        (12, 'settle', 'settle -> _push', 'low_level_value_call', 39, None, 'effect', 35),
        (17, 'fill', 'fill', 'token_transfer', 13, 13, None, None),
        (9, 'buy', 'buy', 'native_transfer', 9, 9, None, None),
    ]),
    'tm3_field_flows': ('fn:s field:s action:s line:l', [
        (14, 'fillOrder', 'createdAt', 'accepted', 32),
        (14, 'fillOrder', 'expiration', 'accepted', 32),
        (14, 'placeOrder', 'createdAt', 'state-write', 14),
        (14, 'placeOrder', 'expiration', 'guarded-use', 10),
    ]),
    'tm4_unbounded_signatures': ('contract:s fn:s start_line:l', [
        (14, 'Book@', 'claimReceipt', 34),
    ]),
    'ac7_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (1, 'AC7', 'access_control', 'Chain@', 'claim', 'claim', 'claim', 6, 6, [4, 6], [6], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'AC7', 'access_control', 'Desk@', '_book', 'payLater', '_book', 26, 26, [21, 26], [26], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'AC7', 'access_control', 'Desk@', 'mintAll', 'mintAll', 'mintAll', 44, 44, [42, 44], [44], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'AC7', 'access_control', 'Desk@', 'setComptroller', 'setComptroller', 'setComptroller', 11, 11, [9, 11], [11], [], 0.5, 'source_access_surface:generic_state'),
        (12, 'AC7', 'access_control', 'Desk@', 'settle', 'settle', 'settle', 35, 35, [33, 35], [35], [], 0.5, 'source_access_surface:generic_state'),
        (13, 'AC7', 'access_control', 'Router@', 'issue', 'issue', 'issue', 19, 19, [18, 19], [19], [], 0.75, 'source_access_surface:global_state'),
        (13, 'AC7', 'access_control', 'Router@', 'liquidateFor', 'liquidateFor', 'liquidateFor', 26, 26, [24, 25], [25], [], 0.75, 'source_access_surface:subject_scoped_state'),
        (13, 'AC7', 'access_control', 'Router@', 'mark', 'mark', 'mark', 29, 29, [28, 29], [29], [], 0.5, 'source_access_surface:generic_state'),
        (13, 'AC7', 'access_control', 'Router@', 'rescue', 'rescue', 'rescue', 22, 22, [21, 22], [], [], 0.75, 'source_access_surface:asset_operation'),
        (14, 'AC7', 'access_control', 'Book@', 'claimReceipt', 'claimReceipt', 'claimReceipt', 36, 36, [34, 36], [36], [], 0.5, 'source_access_surface:generic_state'),
        (14, 'AC7', 'access_control', 'Book@', 'fillOrder', 'fillOrder', 'fillOrder', 32, 32, [31, 32], [32], [], 0.5, 'source_access_surface:generic_state'),
        (2, 'AC7', 'access_control', 'Base@', '_grant', 'buy', '_grant', 5, 5, [5, 12], [5], [], 0.5, 'source_access_surface:generic_state'),
        (3, 'AC7', 'access_control', 'Admin@', '_apply', 'adjust', '_apply', 35, 35, [31, 35], [35], [], 0.5, 'source_access_surface:generic_state'),
        (3, 'AC7', 'access_control', 'Admin@', 'initialize', 'initialize', 'initialize', 16, 16, [15, 16], [16], [], 0.75, 'source_access_surface:global_state'),
        (3, 'AC7', 'access_control', 'Admin@', 'setFee', 'setFee', 'setFee', 19, 19, [5, 18, 19], [19], [], 0.75, 'source_access_surface:asset_operation'),
        (3, 'AC7', 'access_control', 'Admin@', 'setFeeChecked', 'setFeeChecked', 'setFeeChecked', 29, 29, [27, 28, 29], [29], [], 0.75, 'source_access_surface:asset_operation'),
        (3, 'AC7', 'access_control', 'Admin@', 'setFeeLoose', 'setFeeLoose', 'setFeeLoose', 25, 25, [24, 25], [25], [], 0.75, 'source_access_surface:asset_operation'),
        (3, 'AC7', 'access_control', 'Admin@', 'setOwner', 'setOwner', 'setOwner', 22, 22, [21, 22], [22], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC7', 'access_control', 'Origin@', 'join', 'join', 'join', 17, 17, [16, 17], [17], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC7', 'access_control', 'Origin@', 'remember', 'remember', 'remember', 20, 20, [19, 20], [20], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC7', 'access_control', 'Origin@', 'setTreasury', 'setTreasury', 'setTreasury', 14, 14, [5, 13, 14], [14], [], 0.75, 'source_access_surface:global_state'),
        (4, 'AC7', 'access_control', 'Origin@', 'sweep', 'sweep', 'sweep', 23, 23, [22, 23], [], [], 0.75, 'source_access_surface:asset_operation'),
        (5, 'AC7', 'access_control', 'Caller@', 'emitted', 'emitted', 'emitted', 23, 23, [22, 23], [], [], 0.75, 'source_access_surface:asset_operation'),
        (8, 'AC7', 'access_control', 'Sums@', 'mint', 'mint', 'mint', 9, 10, [8, 9, 10], [9, 10], [], 0.5, 'source_access_surface:generic_state'),
        (9, 'AC7', 'access_control', 'Market@', 'setPrice', 'setPrice', 'setPrice', 6, 6, [5, 6], [6], [], 0.5, 'source_access_surface:generic_state'),
    ]),
    're4_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (0, 'RE4', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.95, 'low_level_value_call_before_persistent_state_write'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.85, 'token_transfer_before_persistent_state_write'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'mintAll', 'mintAll', 'mintAll', 43, 44, [43, 44], [44], [], 0.85, 'safe_mint_before_persistent_state_write'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'payLater', 'payLater', 'payLater', 22, 26, [22, 26], [26], [], 0.85, 'token_transfer_before_helper_state_write'),
        (12, 'RE4', 'reentrancy', 'Desk@', 'setComptroller', 'setComptroller', 'setComptroller', 10, 11, [10, 11], [11], [], 0.9, 'external_view_call_before_inherited_state_write'),
    ]),
    're6_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (12, 'RE6', 'reentrancy', 'Desk@', '_push', 'settle', '_push', 37, 35, [35, 39], [], [], 0.95, 'interprocedural_low_level_callback_before_caller_state_settlement'),
        (12, 'RE6', 'reentrancy', 'Desk@', 'trade', 'trade', 'trade', 29, 31, [29, 31], [], [], 0.95, 'caller_controlled_low_level_callback_before_post_call_settlement'),
    ]),
    're7_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (0, 'RE7', 'reentrancy', 'Vault@', 'withdraw', 'withdraw', 'withdraw', 15, 17, [15, 17], [17], [], 0.95, 'low_level_value_call_before_persistent_state_write'),
        (1, 'RE7', 'reentrancy', 'Chain@', 'claim', 'claim', 'claim', 12, 6, [6, 12], [6], [], 0.95, 'interprocedural_low_level_value_call_before_persistent_state_write'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'deposit', 'deposit', 'deposit', 14, 15, [14, 15], [15], [], 0.85, 'token_transfer_before_persistent_state_write'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'mintAll', 'mintAll', 'mintAll', 43, 44, [43, 44], [44], [], 0.85, 'safe_mint_before_persistent_state_write'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'settle', 'settle', 'settle', 39, 35, [35, 39], [35], [], 0.95, 'interprocedural_low_level_value_call_before_persistent_state_write'),
        (12, 'RE7', 'reentrancy', 'Desk@', 'sweep', 'sweep', 'sweep', 47, 48, [47, 48], [], [], 0.85, 'token_transfer_before_external_asset_action'),
    ]),
    'ar4_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (17, 'AR4', 'arithmetic', 'Powers@', 'fill', 'fill', 'fill', 11, None, [11, 12, 13], [], [11], 0.8, 'helper_arithmetic_provenance'),
    ]),
    'ar6_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (17, 'AR6', 'arithmetic', 'Powers@', '_lock', '_lock', '_lock', 7, None, [8], [8], [8], 0.9, 'timestamp_parameter_storage_write'),
        (17, 'AR6', 'arithmetic', 'Powers@', 'cost', 'cost', 'cost', 16, None, [16, 17], [], [16], 0.7, 'legacy_arithmetic_to_return'),
        (8, 'AR6', 'arithmetic', 'Sums@', 'mint', 'mint', 'mint', 9, None, [9], [9], [9], 0.7, 'legacy_arithmetic_to_state'),
        (8, 'AR6', 'arithmetic', 'Sums@', 'scale', 'scale', 'scale', 19, None, [19, 20], [], [19], 0.7, 'legacy_arithmetic_to_return'),
    ]),
    'fr4_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (16, 'FR4', 'front_running', 'Farm@', 'compound', 'compound', '_sell', 14, None, [8, 9, 14], [], [14], 0.9, 'permissionless_quote_then_swap_configurable_slippage'),
        (16, 'FR4', 'front_running', 'Farm@', 'harvest', 'harvest', 'harvest', 6, None, [4, 5, 6], [], [6], 0.9, 'permissionless_balance_dependent_amm_swap_zero_slippage'),
    ]),
    'fr5_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (16, 'FR5', 'front_running', 'Farm@', '_sell', 'compound', '_sell', 14, 14, [12, 13, 14], [], [13], 0.9, 'permissionless_quote_then_asset_settlement'),
        (16, 'FR5', 'front_running', 'Farm@', 'harvest', 'harvest', 'harvest', 6, 6, [4, 5, 6], [], [5], 0.9, 'permissionless_quote_then_asset_settlement'),
        (16, 'FR5', 'front_running', 'Farm@', 'redeem', 'redeem', 'redeem', 19, 19, [17, 18, 19], [], [18], 0.9, 'permissionless_ratio_quote_then_asset_settlement'),
    ]),
    'tm4_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (14, 'TM4', 'time_manipulation', 'Book@', 'claimReceipt', 'claimReceipt', 'claimReceipt', 35, None, [35], [], [], 0.86, 'signed_receipt_missing_quest_expiry'),
    ]),
    'tm7_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (14, 'TM7', 'time_manipulation', 'Book@', 'cancelExpired', 'cancelExpired', 'cancelExpired', 25, None, [25], [], [], 0.88, 'order_expiration_cancellation_gate'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 18, None, [18], [], [], 0.88, 'order_expiration_execution_gate'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 21, None, [21], [], [], 0.86, 'order_expiration_execution_timestamp_record'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 11, None, [11], [], [], 0.88, 'order_expiration_creation_gate'),
        (14, 'TM7', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 14, None, [14], [], [], 0.86, 'order_creation_timestamp_assignment'),
    ]),
    'tm8_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (15, 'TM8', 'time_manipulation', 'Vesting@', 'getTime', 'claim', 'getTime', 8, None, [8, 11, 20, 29], [], [], 0.88, 'timestamp_provider_to_vesting_asset_consumer'),
    ]),
    'tm11_rule': ('rule_id:s risk_type:s contract:s fn:s entrypoint:s sink:s line:l sink_line:l evidence_lines:L state_write_lines:L operation_lines:L confidence:d evidence_kind:s', [
        (10, 'TM11', 'time_manipulation', 'Lock@', 'release', 'release', 'release', 18, None, [18, 19], [], [], 0.7, 'temporal_producer_consumer'),
        (10, 'TM11', 'time_manipulation', 'Lock@', 'release', 'release', 'release', 19, None, [18, 19], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'cancelExpired', 'cancelExpired', 'cancelExpired', 25, None, [25], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 18, None, [18, 21], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'executeOrder', 'executeOrder', 'executeOrder', 21, None, [18, 21], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 11, None, [11, 14], [], [], 0.7, 'temporal_producer_consumer'),
        (14, 'TM11', 'time_manipulation', 'Book@', 'placeOrder', 'placeOrder', 'placeOrder', 14, None, [11, 14], [], [], 0.7, 'temporal_producer_consumer'),
        (15, 'TM11', 'time_manipulation', 'Vesting@', 'accrue', 'accrue', 'accrue', 23, None, [23], [], [], 0.7, 'temporal_producer_consumer'),
        (15, 'TM11', 'time_manipulation', 'Vesting@', 'getTime', 'join', 'join', 8, 30, [7, 8, 29, 30], [], [], 0.7, 'temporal_producer_consumer'),
        (17, 'TM11', 'time_manipulation', 'Powers@', '_lock', '_lock', '_lock', 8, None, [8], [], [], 0.7, 'temporal_producer_consumer'),
    ]),
}
