"""What each text query must return, worked out plainly over a list of (doc_id, text) rows."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(rows, benchmark):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))

    windows = defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(item)
    out = []
    for doc, text in rows:
        w = words(text)
        hit, items = [0] * len(w), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                found = windows.get(tuple(w[k : k + m]))
                if found:
                    items |= {str(i) for i in found if i is not None}
                    hit[k : k + m] = [1] * m
        n = sum(hit)
        out.append((doc, len(w), n, len(items), sha(",".join(sorted(items))), n > 0 and 20 * n >= len(w)))
    return out


def repeats(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [1] * window
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def line_dedup(rows, k=5):
    """Rows equal in both columns are one; doc_id NULL comes first."""
    sets, holders, fate = [], defaultdict(set), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, n, removed = [], 0, 0
        for line in (text or "").split("\n"):
            w = WORD.findall(line)
            if w:
                n += 1
                own = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
                shared = Counter(e for x in own for e in holders[x])
                if any(5 * c >= 4 * (len(own) + len(sets[e]) - c) for e, c in shared.items()):
                    removed += 1
                else:
                    kept.append(line)
                for x in own:
                    holders[x].add(len(sets))
                sets.append(own)
            else:
                kept.append(line)
        fate[doc, text] = (doc, n, removed, sha("\n".join(kept)))
    return [fate[r] for r in rows]


def shingle_set(text, k=3):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(rows, percent=90):
    """(doc_id, set size, index of the component)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [(doc, len(s), top(i)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def ngram_join(rows):
    found = groups(rows)
    ids = defaultdict(list)
    for doc, n, c in found:
        ids[c if n else (c, "alone")].append(doc)
    return [(doc, n, doc if not n else min((x for x in ids[c] if x is not None), default=None)) for doc, n, c in found]


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def personal(rows):
    """(doc_id, four counts, base spans as text)."""
    out, kinds = [], list(PERSONAL)
    for doc, text in rows:
        found = []
        for kind, pattern in PERSONAL.items():
            for m in re.finditer(pattern, text or ""):
                d = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}
                if good[kind]:
                    found.append((m.start(), kinds.index(kind), m.end()))
        counts = Counter(k for _, k, _ in found)
        out.append((doc, *[counts[i] for i in range(4)], ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))))
    return out


def quality(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        w, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = [0] * len(w)
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                again[i : i + 5] = [1] * 5
        n = sum(again)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, n, len(w) < 10 or 100 * n > 20 * len(w)))
    return out


def repeated_share(text, n):
    """Characters of words inside n-word windows found twice or more, and characters of words."""
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    again = [0] * len(w)
    for i in range(len(w) - n + 1):
        if grams[tuple(w[i : i + n])] > 1:
            again[i : i + n] = [1] * n
    return sum(len(x) for x, a in zip(w, again, strict=True) if a), sum(map(len, w))


def repeated_line_chars(text):
    seen, total = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            total += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return total


def good(row):
    """The quality verdict of one (doc_id, text)."""
    text = row[1]
    chars = repeated_share(text, 5)[1]
    over = any(100 * repeated_share(text, n)[0] > 20 * chars for n in range(5, 11))
    return not (quality([row])[0][6] or over or 100 * repeated_line_chars(text) > 50 * chars)
