"""Plain versions of the operators for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def repeats(rows, size):
    first, of = {}, {i: words(t) for i, t in rows}
    for i in sorted(of):
        for k in range(len(of[i]) - size + 1):
            first.setdefault(tuple(of[i][k : k + size]), i)
    out = {}
    for i, w in of.items():
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def jaccard(rows, size=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram = collections.defaultdict(list)
    for i in sorted(sets):
        for g in sets[i]:
            by_gram[g].append(i)
    for a, b in {(a, b) for v in by_gram.values() for x, a in enumerate(v) for b in v[x + 1 :]}:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def rules(text):
    w = words(text)
    windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def licences(text, rules):
    """op5's labels and score in plain Python: every rule over the whole text, then what no stronger or equal place contains."""
    form = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", (text or "").translate(LOWER)).strip(" ") + " "
    found, sure = set(), []
    for label, keyword, expression, priority, weight, base in rules:
        if keyword in form:
            for m in re.finditer(f"(?<= ){expression}(?= )", form):
                found.add((m.start(), -m.end(), priority, label, weight, base))
                sure += [(label, weight)] if base else []
    left = []
    top = {1: -1, 2: -1, 3: -1}  # how far places of a priority reach, of those that start no later
    for start, end, priority, label, weight, _ in sorted(found):
        if max(top[p] for p in range(1, priority + 1)) < -end:
            left.append((label, weight))
        top[priority] = max(top[priority], -end)
    return ",".join(sorted({x for x, _ in left + sure})), max((w for _, w in left + sure), default=0.0)


def _discounts(n1, n2, n3, n4):
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return tuple(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1))


def kneser_ney(rows):
    """({id: (held_out, n_tokens, n_known, train_tokens, base, score)}, p, words)"""
    tokens = lambda t: words((t or "").translate(LOWER)) + ["</s>"]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count, pairs = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not out_of(i):
            w = tokens(t)
            count.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(count.values()), len(count)
    kinds = collections.Counter(b for _, b in pairs)
    context = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in pairs.items():
        context[a][0] += k
        context[a][min(k, 3)] += 1
    high = _discounts(*(sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)))
    low = _discounts(*(sum(x == k for x in kinds.values()) for k in (1, 2, 3, 4)))
    rest = sum(low[min(k, 3) - 1] for k in kinds.values()) / len(pairs)

    def lower(w):
        k = kinds.get(w, 0)
        return (max(k - low[min(k, 3) - 1], 0) / len(pairs) if k else 0) + rest / (v + 1)

    def p(a, w):
        if a not in context:
            return lower(w)
        total, k = context[a], pairs.get((a, w), 0)
        return (max(k - high[min(k, 3) - 1], 0) / total[0] if k else 0) + sum(d * x for d, x in zip(high, total[1:], strict=True)) / total[0] * lower(w)

    made = {}
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        made[i] = (out_of(i), len(w), sum(count[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)))
    return made, p, count


def draw(rows, target, percent=5, min_words=20, buckets=10000):
    """op11 in plain Python: {doc_id: (n_features, weight, score, rank)}."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    of = {i: grams(t) for i, t in rows}
    s = collections.Counter(b for _, g in of.values() for b in g)
    t = collections.Counter(b for x in target for b in grams(x)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    out = {}
    for i, (_, g) in of.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        out[i] = (len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((i for i in of if of[i][0] >= min_words), key=lambda i: (-out[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(able[: len(able) * percent // 100])}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


def audit(rows, labels):
    """op12 in plain Python over (doc_id, text, source) and (doc_id, quality, toxic)."""
    import itertools

    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = words(t)
        tests = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
        }
        fails.append((i, s or "", {k for k, v in tests.items() if v}))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f,
                ]
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}
