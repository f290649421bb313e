"""Plain versions of the operators, for small tables: no Spark, no arrays, no shortcuts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations


def fold(doc_id, folds):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def grams(text):
    """How often each n-gram of one to three letters occurs; blanks count as letter 0, one between words.

    A blank in front adds nothing to a gram: the first letters of words count once more as shorter grams.
    """
    s = [0]
    for ch in text or "":
        c = ord(ch.lower()[0]) if ch.isalpha() else 0
        if c or s[-1]:
            s.append(c)
    if s[-1]:
        s.append(0)
    out = Counter()
    for i, c in enumerate(s):
        if c:
            out[(c,)] += 1
        if i and len(s) > 1:
            out[(s[i - 1], c) if s[i - 1] else (c,)] += 1
        if i > 1 and s[i - 1]:
            out[(s[i - 2], s[i - 1], c) if s[i - 2] else (s[i - 1], c)] += 1
    return out


def code(gram):
    return sum(c << (21 * i) for i, c in enumerate(reversed(gram)))


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def language_profiles(rows, train, size=400):
    sums = defaultdict(Counter)
    for r in rows:
        if train(r) and r["lang"] is not None and r["text"]:
            sums[r["lang"]] += grams(r["text"])
    return {lang: ranked(c, size) for lang, c in sums.items()}


def language(text, profiles, size=400):
    if not any(c.isalpha() for c in text or "") or not profiles:
        return "und", 0.0
    own, best = ranked(grams(text), size), None
    for lang in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[lang])}
        apart = sum(abs(place[g] - i) if g in place else size for i, g in enumerate(own))
        if best is None or apart < best[0]:
            best = (apart, lang)
    return best[1], 1 - best[0] / (size * len(own))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(rows, numerator):
    """id -> smallest id of its group, over (id, text); ids may repeat."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * min(len(x), len(y)) >= numerator * max(len(x), len(y)) and 100 * len(x & y) >= numerator * len(x | y):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {i: top(i) for i in root}


def budgets(leaves, total, weights, levels):
    """leaf -> budget: ``leaves`` maps paths to caps; what a child can't take goes to its siblings first."""

    def share(paths, given, depth):
        if depth == levels:
            return {p: given for p in paths}
        children = defaultdict(list)
        for p in paths:
            children[p[depth]].append(p)
        cap = {c: float(sum(leaves[p] for p in ps)) for c, ps in children.items()}
        weight = {c: weights[depth].get(c, 1.0) for c in children}
        left, open_, got = given, set(children), {}
        while open_:
            level = max(0.0, left) / sum(weight[c] for c in open_)
            full = {c for c in open_ if cap[c] <= level * weight[c]}
            if not full:
                got |= {c: level * weight[c] for c in open_}
                break
            got |= {c: cap[c] for c in full}
            left -= sum(cap[c] for c in full)
            open_ -= full
        return {p: b for c, ps in children.items() for p, b in share(ps, got[c], depth + 1).items()}

    return {p: math.floor(b + 1e-6) for p, b in share(list(leaves), total, 0).items()}


def mixture(rows, path, tokens, total_share, weights, max_epochs=2, seed=11):
    """rows, once for each epoch they are taken in. Ids are distinct within a leaf."""
    supply, members = Counter(), defaultdict(list)
    for r in rows:
        supply[path(r)] += tokens(r)
        members[path(r)].append(r)
    given = budgets({p: max_epochs * n for p, n in supply.items()}, sum(supply.values()) * total_share, weights, 3)
    out = []
    for p, own in members.items():
        whole = min(max_epochs, given[p] // supply[p])
        rest = given[p] - whole * supply[p] if whole < max_epochs else 0
        run, part = 0, []
        for r in sorted(own, key=lambda r: hashlib.md5(f"{seed}:{whole}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()):
            run += tokens(r)
            if run <= rest:
                part.append(r)
        out += own * whole + part
    return out


def pieces(rows, encode, size, end=2):
    out = []
    for r in rows:
        ids = [*encode(r["text"] or ""), end]
        begin, stop, k = 0, (len(ids) - 1) % size + 1, 0
        while begin < len(ids):
            out.append((r["doc_id"], k, begin, stop - begin, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[begin:stop]))))
            begin, stop, k = stop, stop + size, k + 1
    return out


def best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(size - n)
    return room


def quality_features(text):
    data = (text or "").encode("utf-8", "surrogatepass")
    words, n = data.split(), len(data)
    if not words:
        return [math.log1p(n)] + [0.0] * 22
    m = len(words)
    share = lambda ok: sum(map(ok, data)) / n
    count = lambda chars: sum(b in chars for b in data)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    signs = count(b"#$%&*@^~")
    other = count([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]) - signs - count(b".,!|")
    lines = data.split(b"\n")
    return [
        math.log1p(n), math.log1p(m), sum(map(len, words)) / m, math.log1p(max(map(len, words))), upper / max(1, upper + lower), (upper + lower) / n, share(lambda b: 48 <= b < 58), share(lambda b: b == 32),
        share(lambda b: b == 10), count(b".") / m, count(b",") / m, count(b"!") / m, count(b"|") / m, signs / m, other / m,
        share(lambda b: b > 127), len(set(words)) / m, max(Counter(words).values()) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, len(set(lines)) / len(lines), sum(w[-1] in b"#$%&*!|" for w in words) / m,
        sum(65 <= w[0] <= 90 for w in words) / m, -sum(c / n * math.log2(c / n) for c in Counter(data).values()),
    ]
