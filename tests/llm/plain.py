"""Step-by-step versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def spaced(text):
    return SPACED.findall(text or "")


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def fingerprint(text):
    words = spaced((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """rows: (doc_id, text); doc_id -> (hex, component)."""
    prints = [(d, fingerprint(t)) for d, t in rows]
    root = {d: d for d, _ in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 4:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (f"{x:016x}", find(d)) for d, x in prints}


def tokens(rows, path):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, {}
    for d, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def contamination(docs, items, width=10):
    """doc_id -> (n_words, n_hit, n_items, sha256 of the item ids)."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (items_ := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= items_
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest())
    return out


def repeats(docs, width=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the kept bytes)."""
    first = {}
    for d, text in sorted(docs, reverse=True):
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            first[raw[i : i + width]] = d
    out = {}
    for d, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < d:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = spaced(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(spaced(line)) and line in seen
        seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    repeated = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licence_base(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = plain_words(text)
    places = [(i, label) for i in range(len(w)) for phrase, label in PHRASES.items() if tuple(w[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def damage(rows):
    """rows: (conv_id, turn, role, text) with None; the rows after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    return out


def faults(rows):
    """0 none, 1 blank, 2 duplicate, 3 truncated for (turn, role, text) rows."""
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall("[^\x20\x09-\x0d]", text)
        out.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def repair(rows):
    """(cost, audit, lines) of the cheapest repair, by recursion over rows and the initials so far."""
    marks = faults(rows)

    def state(initials):
        for k, pattern in enumerate(("", "s", "s?(ua)*u", "s?(ua)+")):
            if re.fullmatch(pattern, initials):
                return ("", "s", "u", "ua")[k]
        return None

    from functools import lru_cache

    @lru_cache(None)
    def best(i, so_far, inserts):
        options = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", so_far):
            options.append((0, "", ()))

        def go(cost, letter, j, initials, line, k):
            after = state(initials)
            if after is not None:
                rest = best(j, after, k)
                if rest is not None:
                    options.append((cost + rest[0], letter + rest[1], (*line, *rest[2])))

        if inserts < 2:
            for role in ("user", "assistant"):
                go(5, "I", i, so_far + role[0], (f"{role}:",), inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(2, "D", i + 1, so_far, (), 0)
            if marks[i] not in (1, 2):
                extra = 5 if marks[i] == 3 else 0
                go(extra, "K", i + 1, so_far + role[:1], (f"{role}:{text}",), 0)
                for new in ("user", "assistant"):
                    go(1 + extra, "R", i + 1, so_far + new[0], (f"{new}:{text}",), 0)
        return min(options, key=lambda x: x[:2], default=None)

    # Bounded recursion: from the end backwards, so that the cache is filled step by step.
    for i in range(len(rows), -1, -1):
        for so_far in ("", "s", "u", "ua"):
            best(i, so_far, 0)
    return best(0, "", 0)


def audit(conversations):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of the damaged rows."""
    out = {}
    for conv, rows in damage(conversations).items():
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        marks = faults(rows)
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters, lines = repair(rows)
        out[conv] = (gaps, marks.count(1), marks.count(2), marks.count(3), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def trie(rows):
    """Sorted node tuples of the rebuilt conversations of rows (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [r[2:] for r in sorted(t)] for c, t in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - int(np.fmod(c, 20)), [])[:h] + turns[c][h:]
    members, ends = {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own_ in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own_) - 1) * len(spaced(p[-1][1])) if p else 0
    out = []
    for p, own_ in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(own_), len(p), min(members[p[:-1]]) if p else None, len(own_), children[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)
