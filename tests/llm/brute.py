"""Slow, plain versions of the operators for small tables of (doc_id, text)."""

import re
from hashlib import sha256

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hexed(data):
    return sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text, lower=False):
    words = ((text or "").translate(LETTERS) if lower else text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def without_repeats(docs, size, symbols, join):
    """Per (doc_id, text): number of symbols, number removed, kept symbols joined, runs removed."""
    seen, out = set(), []
    for doc_id, text in docs:
        body = symbols(text or "")
        gone = [False] * len(body)
        for k in range(len(body) - size + 1):
            window = tuple(body[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        kept = [s for s, g in zip(body, gone, strict=True) if not g]
        runs = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out.append((doc_id, len(body), sum(gone), join(kept), runs))
    return out


def classes(docs, least=0.8):
    sets = [(doc_id, shingles(text, lower=True)) for doc_id, text in docs]
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if jaccard(a, b) >= least:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for (doc_id, _), at in zip(sets, label, strict=True):
        smallest[at] = min(smallest.get(at, doc_id), doc_id)
    return [(doc_id, smallest[at]) for (doc_id, _), at in zip(sets, label, strict=True)]


_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = _WORD.findall((text or "").translate(LETTERS))
        for k in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        words = _WORD.findall((text or "").translate(LETTERS))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    found |= windows[tuple(words[k : k + n])]
                    hit.update(range(k, k + n))
        out.append((doc_id, len(words), len(hit), len(found), hexed(",".join(sorted(found))), bool(hit)))
    return out
