"""Plain versions of the operators, row by row, for comparison."""

import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def exact(rows):
    """rows: (id, text); {id: (keep_id, group_size)}"""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for members in groups.values():
        for _, i in members:
            out[i] = (min(members)[1], len(members))
    return out


def fingerprint(text, words=3):
    tokens = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, words=3, bits=3):
    prints = {i: fingerprint(t, words) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= bits]
    roots = components(prints, links)
    return {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def near_copies(rows, words=5, least=0.8):
    """rows: (id, text) with distinct ids; {id: least id reachable over texts whose shingle sets agree to `least`}"""
    sets = {}
    for i, t in rows:
        tokens = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))]
    return components(list(sets), links)


def repeated_lines(rows, min_words=50):
    """rows: (id, text) with distinct ids; {id: removed line numbers}: every line of every run that has an earlier copy. A run is known by
    a polynomial hash of its lines' numbers and its length."""
    rows = sorted(rows)
    lines = {i: [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")] for i, t in rows if t is not None}
    names, prime, base = {}, (1 << 89) - 1, 1_000_003
    first, gone, runs = {}, defaultdict(set), {}
    powers = [1]
    for i, ls in sorted(lines.items()):
        after, words = [0], [0]
        for x in ls:
            after.append((after[-1] * base + names.setdefault(x, len(names) + 1)) % prime)
            words.append(words[-1] + max(1, len(WORD.findall(x))))
        powers += [pow(base, k, prime) for k in range(len(powers), len(after) + 1)]
        runs[i] = [(s, e, ((after[e] - after[s] * powers[e - s]) % prime, e - s)) for s in range(len(ls)) for e in range(s + 1, len(ls) + 1) if words[e] - words[s] >= min_words]
        for s, _, run in runs[i]:
            first.setdefault(run, (i, s))
    for i, found in runs.items():
        for s, e, run in found:
            if first[run] != (i, s):
                gone[i].update(range(s, e))
    return {i: sorted(gone[i]) for i, _ in rows}


def kept_by_language(rows, languages, trigrams, buckets, trust=0.9, weight=60, least=0.5, strange=12.0, strength=20):
    """rows: dicts with doc_id, text, lang and source; the ids of those that a plain naive Bayes keeps."""
    n = len(languages)
    declared = [r["lang"][:2].lower() if r["lang"] and r["lang"][:2].lower() in languages else None for r in rows]
    grams = [trigrams(r["text"]).tolist() for r in rows]
    counts = {x: defaultdict(int) for x in languages}
    for g, d in zip(grams, declared, strict=True):
        if d:
            for t in g:
                counts[d][t] += 1
    sums = {x: sum(c.values()) for x, c in counts.items()}
    mean = lambda g, x: sum(np.log((counts[x][t] + 0.1) / (sums[x] + 0.1 * buckets)) for t in g) / len(g)
    means = [[mean(g, x) for x in languages] if g else [0.0] * n for g in grams]
    usual = [max(m) for m, g, d in zip(means, grams, declared, strict=True) if d and len(g) >= 50]
    middle, spread = np.mean(usual), max(0.05, np.std(usual))
    hosts = defaultdict(lambda: [0] * n)
    for r, d in zip(rows, declared, strict=True):
        if r["source"] and d:
            hosts[r["source"]][languages.index(d)] += 1
    total = [sum(h[k] for h in hosts.values()) for k in range(n)]
    prior = [(t + 1) / (sum(total) + n) for t in total]
    smooth = lambda own, above: [(o + strength * a) / (sum(own) + strength) for o, a in zip(own, above, strict=True)]
    kept = set()
    for r, d, g, m in zip(rows, declared, grams, means, strict=True):
        if not g:
            continue
        own = hosts[r["source"]] if r["source"] else None
        here = prior
        if own is not None:  # sources without dots are their own domains, without a top level
            here = smooth(own, smooth(own, smooth(total, prior)))
        logs = [np.log(here[k]) + min(len(g), weight) * m[k] + (0 if d is None else np.log(trust if languages[k] == d else (1 - trust) / (n - 1))) for k in range(n)]
        mass = np.exp(np.array(logs) - max(logs))
        if mass.max() / mass.sum() >= least and not (len(g) >= 50 and max(m) < middle - strange * spread):
            kept.add(r["doc_id"])
    return kept


def toxic(rows, labelled, fold, support=3, lift=2.5):
    """rows: (id, text); labelled: {id: 0 or 1}; the ids that a lexicon, learned term by term from the labelled rows, finds toxic at 0.3."""
    texts = {i: fold(t) for i, t in rows}
    train = sorted({(dict(rows)[i] or "", y) for i, y in labelled.items() if i in texts})

    def terms(folded):
        out = defaultdict(int)
        for w in folded.split():
            for t in {f" {w} ", *(f" {w[:k]}" for k in range(4, min(8, len(w)) + 1))}:
                out[t] += 1
        return out

    held = [(terms(fold(t)), y) for t, y in train]
    base = sum(y for _, y in held) / len(held)
    tally = defaultdict(lambda: [0.0, 0.0, 0])
    for found, y in held:
        for t, n in found.items():
            tally[t][y] += round(1000 * np.log2(1 + n)) / 1000
            tally[t][2] += y
    low = {}
    for t, (neg, pos, docs) in tally.items():
        if docs >= support:
            n, p, z = neg + pos, pos / (neg + pos), 1.96
            bound = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if bound >= min(0.5, lift * base):
                low[t] = bound
    chosen = {}
    for t in sorted(low, key=lambda t: (len(t), t)):
        cover = next((c for c in chosen if t.startswith(c)), None)
        if cover is None or tally[t][1] >= 0.9 * tally[cover][1]:
            chosen.pop(cover, None)
            chosen[t] = np.log(low[t] / (1 - low[t])) - np.log(base / (1 - base))

    def features(folded):
        found = terms(folded)
        s = sum(w * found[t] for t, w in chosen.items())
        return [1.0, np.log1p(s), s / np.sqrt(max(1, len(folded.split())))]

    x, y = np.array([features(fold(t)) for t, _ in train]), np.array([v for _, v in train], dtype=float)
    w = np.zeros(3)
    for _ in range(200_000):  # plain projected gradient ascent of the penalised likelihood
        w += 0.005 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - [1e-6 * w[0], w[1], w[2]])
        w[1:] = np.maximum(w[1:], 0)
    return {i for i, f in texts.items() if 1 / (1 + np.exp(-np.array(features(f)) @ w)) >= 0.3}


def vectors(rows, threshold=0.9):
    """rows: (id, vector) with distinct ids; {id: (n_links, component)}"""
    good = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    roots = components([i for i, _ in rows], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], roots[i]) for i, _ in rows}
