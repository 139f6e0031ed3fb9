"""Plain Python versions of operators, for tests on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from lagwise.llm import language, tokens, toxicity
from lagwise.llm.textbytes import word_hashes

MASK = (1 << 64) - 1


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """(id, shingles, smallest id that links reach) of rows (id, text)."""
    sets = {i: shingles_of(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


# --- language ---


def trigram_buckets(text):
    raw = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    kinds = [b if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 for b in raw]
    out = []
    for x, y, z in zip(kinds, kinds[1:], kinds[2:], strict=False):
        if y > 48:
            out.append((((x << 16 | y << 8 | z) * 0x9E3779B97F4A7C15) & MASK) >> 48)
    return out, sum(k > 48 for k in kinds)


def identify(rows):
    """rows: dicts id, text, declared, suffix, tld, domain, host -> id: (language, confidence)."""
    size = 1 << language.BITS
    counts = defaultdict(Counter)
    for r in rows:
        if r["declared"] is not None and r["declared"] != language.NONE:
            counts[r["declared"]].update(trigram_buckets(r["text"])[0])
    names = sorted(k for k, c in counts.items() if sum(c.values()) >= language.ADDED * size)
    total = {k: sum(counts[k].values()) + language.ADDED * size for k in names}
    lls, best = {}, {}
    for r in rows:
        got, letters = trigram_buckets(r["text"])
        ll = [sum(math.log((counts[k][b] + language.ADDED) / total[k]) for b in got) for k in names] + [-math.log(size) * len(got)]
        lls[r["id"]] = [x / (1 + len(got) / language.EVIDENCE) for x in ll]
        best[r["id"]] = (max(range(len(ll)), key=lambda i: (lls[r["id"]][i], -i)) if letters else len(names)), letters
    n = len(names) + 1

    def prior(levels):
        if not levels:
            above = [(1 - language.NONE_PRIOR) / (n - 1)] * (n - 1) + [language.NONE_PRIOR]
            chosen = rows
        else:
            above = prior(levels[:-1])
            chosen = [r for r in rows if all(r[k] == v for k, v in levels)]
        c = Counter(best[r["id"]][0] for r in chosen)
        return [(c[i] + language.PARENT_ROWS * above[i]) / (len(chosen) + language.PARENT_ROWS) for i in range(n)]

    def evidence(column, value):
        some = [r for r in rows if r[column] is not None]
        sums, own = Counter(best[r["id"]][0] for r in some), Counter(best[r["id"]][0] for r in some if r[column] == value)
        share = language.PARENT_ROWS * sum(own.values()) / len(some)
        return [math.log((own[i] + share) / (sums[i] + language.PARENT_ROWS)) for i in range(n)]

    out = {}
    for r in rows:
        if not best[r["id"]][1]:
            out[r["id"]] = (language.NONE, 1.0)
        elif r["declared"] is not None and r["declared"] not in (*names, language.NONE):
            out[r["id"]] = (r["declared"], 1.0)
        else:
            logs = [a + math.log(b) for a, b in zip(lls[r["id"]], prior([(k, r[k]) for k in ("tld", "domain", "host")]), strict=True)]
            for c in ("declared", "suffix"):
                if r[c] is not None:
                    logs = [a + b for a, b in zip(logs, evidence(c, r[c]), strict=True)]
            top = max(range(n), key=lambda i: logs[i])
            out[r["id"]] = ((*names, language.NONE)[top], 1 / sum(math.exp(x - logs[top]) for x in logs))
    return out


# --- toxicity ---


def toxic_score(machine, text):
    """The machine's formula, term by term and pair by pair."""
    names = set()
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        for part, flip in [(word, 0)] + ([(word[: toxicity.STEM], 0x5DEECE66D)] if len(word) > toxicity.STEM else []):
            h = int(word_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))[0]) ^ flip
            names.add(h >> (64 - toxicity.BITS))
    at = [i for i, t in enumerate(machine.terms.tolist()) if t in names]
    z = machine.bias + sum(machine.weights[i] for i in at)
    for k, i in enumerate(at):
        z += sum(float(machine.factors[i] @ machine.factors[j]) for j in at[k + 1 :])
    return 1 / (1 + math.exp(-z))


# --- mixing and packing ---


def mix_targets(rows, weights, share, cap):
    """Sizes and targets of the sources of rows (key, source, text)."""
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(words_of(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(size.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= cap * size[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: cap * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return size, target


def mix_copies(rows, quality, weights, share, cap):
    """How often each of the rows (key, source, text), which differ in key, is taken."""
    size, target = mix_targets(rows, weights, share, cap)
    own = defaultdict(list)
    for key, s, t in rows:
        n = len(words_of(t))
        text = "\x1f".join(["mix", str(key), s if s is not None else "\x1e", str(n)])
        u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        own[s].append((-math.log(u) / quality.get(key, 1.0), key, n))
    out = {}
    for s, docs in own.items():
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, upto = target[s] - epochs * size[s], 0
        for _, key, n in sorted(docs):
            upto += n
            out[key] = epochs + (upto - n / 2 <= rest)
    return out


def pieces_of(text, capacity=2048, end_id=0):
    ids = [*np.frombuffer(tokens.encoder(tokens.vocabulary_path()).ids(text), "<u4").tolist(), end_id]
    return [(k, k * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k in range(-(-len(ids) // capacity)) for part in [ids[k * capacity : (k + 1) * capacity]]]
