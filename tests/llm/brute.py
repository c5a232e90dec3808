"""Plain Python versions of the corpus operators, and a small corpus with hard rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

NULL_ID = -(1 << 63)
DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, place string, "
    "key string, host string, component_id long, id string, u long, n int, marks string, tag string, digest string"
)


def corpus(seed: int = 3) -> list[tuple]:
    """Copies, near copies, shared passages, repetition, nulls, blanks, a long text, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéßñzAB", k=rng.randint(1, 8))) for _ in range(400)]

    def prose(n, sep=" "):
        out = []
        for i in range(n):
            out.append(rng.choice(words))
            out.append("\n" if i % 17 == 16 else sep)
        return "".join(out[:-1])

    passage, common = prose(70), "This very line is on a great many pages of the site."
    texts: list[str | None] = [prose(rng.randint(30, 150)) for _ in range(30)]
    texts += [texts[0]] * 6 + [texts[1] + " tail"]
    for k in range(12):  # near copies of one text, of which some link through others only
        near = texts[2].split(" ")
        for _ in range(k // 2):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [prose(20) + " " + passage + " " + prose(rng.randint(5, 40)) for _ in range(8)]
    texts += [prose(40) + "\n" + common for _ in range(34)] + [common + "\n" + "ab cd " * 3]
    texts += [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "A B C", "one two three four", "日本 語 テキスト", "12 34 !!"]
    texts += ["x " * 300, "same line here\n" * 9, prose(9000), "w" * 5000, " 　 a b \u0085 c", "▁a ▁ \x00 b"]
    rows = []
    order = list(range(len(texts)))
    rng.shuffle(order)
    for i, k in enumerate(order):
        lang = None if i % 11 == 0 else ["en", "de", "fr"][k % 3]
        source = None if i % 13 == 0 else ["s1", "s2", "ſ", "s10"][min(i % 7, 3) if i % 2 else 0]
        rows.append((i * 3, texts[k], lang, source))
    rows += rows[4:7]  # repeated rows
    rows.append((None, texts[3], "en", "s1"))
    extra = (True, "x", None, "k", "h", 5, "i", 7, 8, "m", "t", "d")
    return [(d, t, lang, s, None if t is None else len(t), *extra) for d, t, lang, s in rows]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def smallest(ids, links) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def no_null(doc_id):
    return NULL_ID if doc_id is None else doc_id


def jaccard(rows, shingle=4, percent=85) -> dict:
    """doc_id: (set size, component)."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        grams = [tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
        sets[no_null(d)] = set(grams) if len(w) >= shingle else ({tuple(w)} if w else set())
    shared = Counter()
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            shared.update((min(d, e), max(d, e)) for e in holders[g])
            holders[g].append(d)
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = smallest(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def removed(rows, units) -> list[tuple]:
    """(doc_id, units, which are removed) by 50-unit windows of smaller documents."""
    first: dict = {}
    cut = [(no_null(d), units(t)) for d, t in rows]
    for d, u in cut:
        for i in range(len(u) - 49):
            window = bytes(u[i : i + 50]) if isinstance(u, bytes) else tuple(u[i : i + 50])
            first[window] = min(d, first.get(window, d))
    out = []
    for (doc, _), (d, u) in zip(rows, cut):
        gone = [False] * len(u)
        for i in range(len(u) - 49):
            window = bytes(u[i : i + 50]) if isinstance(u, bytes) else tuple(u[i : i + 50])
            if first[window] < d:
                gone[i : i + 50] = [True] * 50
        out.append((doc, u, gone))
    return out


def removed_bytes(rows) -> list[tuple]:
    out = []
    for doc, u, gone in removed(rows, lambda t: (t or "").encode()):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(u, gone) if not g)
        out.append((doc, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(rows) -> list[tuple]:
    out = []
    for doc, u, gone in removed(rows, words_of):
        out.append((doc, len(u), sum(gone), b" ".join(w for w, g in zip(u, gone) if not g).decode()))
    return out


def base_counts(text: str | None) -> tuple:
    w, text = words_of(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


def quality(rows, min_docs=10, share=0.01) -> list[tuple]:
    """(doc_id, counts, base_failed, kept, text without removed lines) of (doc_id, text, source)."""
    hosts = Counter(s for _, _, s in set(rows))
    docs, first, lines, seen = Counter(), {}, [], set()
    for d, t, s in rows:
        found = Counter()
        for line in (t or "").split("\n"):
            norm = (s, b" ".join(line.encode().lower().split()))
            if norm[1]:
                found[norm] += len(words_of(line))
        lines.append(found)
        for norm in found:
            docs[norm] += (d, t, s) not in seen
            first[norm] = min(no_null(d), first.get(norm, no_null(d)))
        seen.add((d, t, s))
    out = []
    for (d, t, s), found in zip(rows, lines):
        over = {x for x in found if docs[x] > min_docs and docs[x] > share * hosts[s] and no_null(d) != first[x]}
        gone = sum(found[x] for x in over)
        counts = base_counts(t)
        left = counts[0] - gone
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        depleted = gone > 0 and (left < 20 or left < 0.2 * counts[0])
        text = t
        if over:
            text = "\n".join(x for x in t.split("\n") if (s, b" ".join(x.encode().lower().split())) not in over)
        out.append((d, counts, failed, not failed and not depleted, text))
    return out


def mix_hash(doc_id, text) -> int:
    name = "null" if doc_id is None else str(doc_id)
    return int(hashlib.md5(f"{name}/{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)


def mix(rows) -> list[tuple]:
    """(doc_id, size, source_size, target, copies), sorting by hash where the operator has thresholds."""
    size = [len(words_of(t)) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, free = 1.5 * sum(size), set(names)
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else rate * weight[s]
        if not over:
            break
        left -= sum(2 * total[s] for s in over)
        free -= over
    taken: dict = {}
    for s in names:
        whole = int(target[s] / total[s]) if total[s] else 0
        rest, below = target[s] - whole * total[s], 0
        groups: dict[int, int] = defaultdict(int)
        for n, (d, text, o) in zip(size, rows):
            if o == s:
                groups[mix_hash(d, text)] += n
        for h in sorted(groups):
            if rest <= 0 or below + groups[h] > rest:
                if rest > 0 and below + groups[h] - rest < rest - below:
                    taken[s, h] = True
                break
            below += groups[h]
            taken[s, h] = True
        taken[s] = whole
    out = []
    for n, (d, text, s) in zip(size, rows):
        h = mix_hash(d, text)
        out.append((d, n, total[s], target[s], taken[s] + taken.get((s, h), False)))
    return out
