"""Plain-loop versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import ceil

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return SPACE.findall(text.translate(LOW) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids, links):
    at = {i: i for i in ids}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def jaccard(docs, n=4, num=85, den=100):
    sets = {}
    for i, text in docs:
        w = words(text, True)
        sets[i] = {tuple(w[j: j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    found = components(ids, links)
    return sorted((i, len(sets[i]), found[i]) for i, _ in docs)


def substrings(docs, width=50):
    low = {}
    for i, text in docs:
        w = words(text)
        for j in range(len(w) - width + 1):
            key = tuple(w[j: j + width])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, text in docs:
        w = words(text)
        gone = set()
        for j in range(len(w) - width + 1):
            if low[tuple(w[j: j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out)


def lines(docs, documents=3, least=20):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    holders = defaultdict(list)
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, text in docs:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if i >= drop.get(key(x), i)]
        out.append((i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def benchmark(docs, items, width=10):
    def split(text):
        return ALNUM.findall((text or "").translate(LOW))

    windows = defaultdict(set)
    for name, text in items:
        w = split(text)
        m = min(width, len(w))
        for j in range(len(w) - m + 1) if m else ():
            windows[tuple(w[j: j + m])].add("" if name is None else str(name))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w = split(text)
        hit, found = set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                owners = windows.get(tuple(w[j: j + m]))
                if owners:
                    hit.update(range(j, j + m))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def measures(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[j: j + 3]) for j in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j + d for j, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    found = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(found), len(found) - len(set(found)), len(covered)


def host_verdicts(docs, block=0.5, enforce=0.02):
    """(doc_id, ..., base_failed, kept) of (doc_id, source, text) rows."""
    rules = {
        "short": lambda m: m[0] < 50, "repeats": lambda m: 100 * m[5] > 50 * m[0], "symbols": lambda m: 10 * m[2] > 3 * m[0],
        "dup_lines": lambda m: 2 * m[4] > m[3], "word_length": lambda m: m[1] < 2 * m[0] or m[1] > 15 * m[0],
    }
    failing = {**rules, "any": lambda m: any(r(m) for r in rules.values())}
    measured = [(i, s, measures(t)) for i, s, t in docs]
    hosts = defaultdict(list)
    for _, s, m in measured:
        hosts[s].append(m)
    rates = defaultdict(dict)
    total = len(measured)
    for name, rule in failing.items():
        mean = sum(rule(m) for _, _, m in measured) / total if total else 0
        v = sum(len(ms) * (sum(map(rule, ms)) / len(ms) - mean) ** 2 for ms in hosts.values())
        chance = mean * (1 - mean)
        between = v / total - chance * len(hosts) / total if total else 0
        strength = min(max(chance / between - 1, 1.0), 1e6) if between > 0 else 1e6
        for s, ms in hosts.items():
            rates[s][name] = (sum(map(rule, ms)) + mean * strength) / (len(ms) + strength)
    out = []
    for i, s, m in measured:
        base = rules["short"](m) or rules["repeats"](m)
        bad = base or rates[s]["any"] >= block or any(r(m) and rates[s][x] >= enforce for x, r in rules.items())
        out.append((i, m[0], m[1], m[2], m[4], m[5], base, not bad))
    return sorted(out, key=repr)


def sainte_lague(weights, seats):
    """weights: list of (key, weight); highest quotients, ties to the smaller key."""
    quota = {k: 0 for k, _ in weights}
    for _ in range(seats):
        best = max(((w / (2 * quota[k] + 1), -i, k) for i, (k, w) in enumerate(weights) if w > 0), default=None)
        if best is None:
            break
        quota[best[2]] += 1
    return quota


def mix(docs, weights=(3, 1, 2), share=1.5, most=2, block=128, shard_words=1_000_000, seed="mix"):
    """(doc_id, size, source_size, target, taken) of (doc_id, source, text) rows."""
    sized = [(i, s, len(words(t))) for i, s, t in docs]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, t, n in sized if t == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free = {}, set(names)
    left = share * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if most * size[s] <= weight[s] * level]
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        for s in over:
            target[s] = float(most * size[s])
            left -= most * size[s]
            free.remove(s)
    seats = round(sum(target.values()) / block)
    quota = sainte_lague([(k + 1, target[s]) for k, s in enumerate(names)], seats)
    taken = {}
    for k, s in enumerate(names, 1):
        shards = defaultdict(list)
        for i, t, n in sized:
            if t == s:
                key = hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
                shards[int(key[:8], 16) % max(1, ceil(size[s] / shard_words))].append((key, i, n))
        per = sainte_lague([(x, sum(n for _, _, n in shards[x])) for x in sorted(shards)], quota[k])
        for x, rows in shards.items():
            rows.sort()
            total = sum(n for _, _, n in rows)
            if not total:
                continue
            blocks = ceil(total / block)
            q = min(per[x], most * blocks)
            lot = sorted(range(blocks), key=lambda b: hashlib.md5(f"{seed}:{k}:{x}:{b}".encode()).hexdigest())
            drawn = set(lot[: q % blocks])
            at = 0
            for _, i, n in rows:
                taken[i] = q // blocks * n + sum((p // block) in drawn for p in range(at, at + n))
                at += n
    return sorted((i, n, size[s], round(target[s], 6), taken.get(i, 0)) for i, s, n in sized)
