"""Slow, plain versions of the operators' contracts, for tests."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return text.encode().lower().decode()


def _cover(n, starts, size):
    hit = bytearray(n)
    for i in starts:
        hit[i : i + size] = b"\1" * size
    return hit


def op1(rows, size=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        hit = _cover(len(b), [i for i in range(len(b) - size + 1) if least[b[i : i + size]] < d], size)
        spans = sum(1 for i in range(len(b)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((d, len(b), sum(hit), spans, sha(bytes(x for x, h in zip(b, hit) if not h))))
    return out


def op2(rows, size=35):
    split = [(d, re.findall(WORD, t or "")) for d, t in rows]
    count = Counter(tuple(w[i : i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for d, w in split:
        hit = _cover(len(w), [i for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1], size)
        out.append((d, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h))))
    return out


def fingerprint(text, words=4):
    w = re.findall(WORD, lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def op3(rows, bits=4):
    prints = [(d, fingerprint(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, p) in enumerate(prints):
        for j, (e, q) in enumerate(prints[:i]):
            if (p ^ q).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 2**63)
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(least[root(i)], d)
    return [(d, f"{p:016x}", least[root(i)]) for i, (d, p) in enumerate(prints)]


def op5(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(spans)]


def op6(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    repeat = set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            repeat |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w)


def op7(rows, min_chars=20, min_docs=3):
    key = lambda x: lower(x.strip(BLANKS))
    owners = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            owners[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(owners[key(x)]) < min_docs or max(owners[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op8(rows, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    lengths = {len(x) for x in windows}
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = bytearray(len(w)), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = b"\1" * n
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def _luhn(x):
    digits = [int(c) for c in re.sub("[^0-9]", "", x)][::-1]
    return 12 <= len(digits) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(digits)) % 10 == 0


def op9(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if _luhn(m[0])]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(s, k, e) for s, k, e in sorted(spans)]
