"""Brute-force restatements of the operators, row by row."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE_WORDS = r"[^\x20\x09-\x0D]+"
LETTER_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACE_WORDS, lower=False):
    text = text or ""
    return re.findall(pattern, text.translate(LOWER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def phrases(text, known):
    own = words(text, LETTER_WORDS, True)
    hits = [(i, label) for phrase, label in known for i in range(len(own)) if own[i:i + len(phrase.split())] == phrase.split()]
    return (len(own), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None,
            ",".join(sorted({label for _, label in hits})))


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return host.translate(LOWER), re.split("[?#]", rest[len(host):])[0]


def fitting(host, path, rules):
    fits = [(len(rule), rule, says) for says, rule in rules for domain, _, rest in [rule.partition("/")]
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest)]
    return max(fits)[1:] if fits else (None, None)


def fingerprint(text):
    own = words(text, lower=True)
    shingles = [" ".join(own[i:i + 4]) for i in range(max(1, len(own) - 3))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """prints: [(id, fingerprint)] -> smallest id reachable, per row (null ids reach but do not name)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            r = find(i)
            names[r] = min(names.get(r, key), key)
    return [names.get(find(i)) for i in range(len(prints))]


def rule_counts(text):
    text = text or ""
    own = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = Counter(tuple(own[i:i + 8]) for i in range(len(own) - 7))
    covered = {j for i in range(len(own) - 7) if windows[tuple(own[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def decontaminated(docs, items, window=10):
    """docs: texts, items: [(id, text)] -> per text n_words, n_hit, n_items, digest."""
    wanted = {}
    for name, text in items:
        own = words(text, LETTER_WORDS, True)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            wanted.setdefault(tuple(own[i:i + n]), set()).add(str("" if name is None else name))
    out = []
    for text in docs:
        own = words(text, LETTER_WORDS, True)
        hit, names = set(), set()
        for i in range(len(own)):
            for n in {len(w) for w in wanted}:
                got = wanted.get(tuple(own[i:i + n])) if i + n <= len(own) else None
                if got:
                    hit |= set(range(i, i + n))
                    names |= got
        out.append((len(own), len(hit), len(names), sha(",".join(sorted(names)))))
    return out


def deduplicated(docs, length=20):
    """docs: [(id, text)] with equal rows once -> {(id, text): (n_words, n_removed, kept)}"""
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - length + 1):
            window = tuple(own[i:i + length])
            if window in seen:
                gone[i:i + length] = [True] * length
            seen.add(window)
        out[key, text] = (len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g))
    return out


def near_groups(texts, size, similarity):
    """A group number for each list of words; shingle sets alike by the similarity or more are linked."""
    sets = [{tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = {}
    for i, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(i)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s] if j < i)
        for j, n in shared.items():
            if n >= similarity * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]
