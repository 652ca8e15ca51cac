"""Plain restatements of the contracts, one document at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall((text or "").encode())


def shingle_set(text, n):
    w = words(low(text))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[low(text)].append(i)
    return sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)


def near(rows, n, percent=80):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def language_model(rows, order, mu):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    counts = [Counter() for _ in range(order + 1)]
    tokens = [(i, [*words(low(t)), "END"]) for i, t in rows]
    for i, t in tokens:
        if not held[i]:
            for n in range(1, order + 1):
                for k in range(len(t)):
                    counts[n][tuple(t[j] if j >= 0 else "START" for j in range(k - n + 1, k + 1))] += 1
    starts = sum(1 for i, _ in rows if not held[i])
    total, kinds = sum(counts[1].values()), len(counts[1])
    out = []
    for i, t in tokens:
        base = score = 0.0
        for k in range(len(t)):
            p = (counts[1][t[k],] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                gram = tuple(t[j] if j >= 0 else "START" for j in range(k - n + 1, k + 1))
                history = starts if set(gram[:-1]) == {"START"} else counts[n - 1][gram[:-1]]
                p = (counts[n][gram] + mu * p) / (history + mu)
            score += math.log10(p)
        out.append((i, held[i], len(t), sum(counts[1][x,] > 0 for x in t), total, base, score))
    return sorted(out)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == n for _, k, _ in found) for n in range(3)], hashlib.sha256(line.encode()).hexdigest(), line


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeated = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def conversation(turns):
    digest = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()
