"""Plain versions of what the operators compute."""

import collections
import re
import zlib

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=5):
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(UPPER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(sets, threshold):
    """How many others each key is linked with, and the smallest key of its group."""
    holders, links, root = collections.defaultdict(list), collections.Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s or [None]:
            holders[x].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        shared = collections.Counter(q for x in sets[i] or [None] for q in holders[x] if q > i)
        for q, n in shared.items():
            if n / (max(1, len(sets[i])) + max(1, len(sets[q])) - n) >= threshold:
                links[i] += 1
                links[q] += 1
                a, b = sorted((find(i), find(q)))
                root[b] = a
    return {i: links[i] for i in sets}, {i: find(i) for i in sets}


def repeated_words(texts, window):
    """For each text, which words a repeated window covers."""
    words = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[s : s + window]) for w in words for s in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone |= set(range(s, s + window))
        out.append([x.decode() for i, x in enumerate(w) if i not in gone])
    return out


def variants(rows, least_n=2, times=10):
    """(word, form, root, n, n_near, form_n) of the words of (id, text) rows."""
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= least_n}
    replaced, near = collections.defaultdict(set), {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            replaced[i, w[:i] + w[i + 1 :], len(w)].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def negatives(rows, anchor, n_positives=5, n_negatives=3, low=50, high=95):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, label, whole vector) rows, sorted."""
    out = []
    for at, (i, l, v) in enumerate(rows):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k, m, x) for x, (k, m, w) in enumerate(rows))
        for s, p, _, _ in [r for r in scored if r[2] == l and r[3] != at][:n_positives]:
            fit = [r for r in scored if r[2] != l and low * -s <= 100 * -r[0] <= high * -s][:n_negatives]
            out += [(i, p, k + 1, q, -s, -t) for k, (t, q, _, _) in enumerate(fit)]
    return sorted(out)
