"""Plain models of the operators, one row at a time."""

from __future__ import annotations

import random
import re
from collections import Counter

SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def prose(r: random.Random, n: int) -> list[str]:
    return [word(r) for _ in range(n)]


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def near_duplicates(rows: list[tuple[int, str | None]]) -> list[tuple]:
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def quality(rows: list[tuple], line_documents: int, line_share: float) -> list[tuple]:
    hosts = Counter(h for _, _, h in rows)
    lines = [[tuple(x.lower() for x in re.findall("[^\x20\x09-\x0d]+", line)) for line in (t or "").split("\n")] for _, t, _ in rows]
    held = Counter((h, x) for (_, _, h), own in zip(rows, lines) for x in set(own) if x)
    out = []
    for (i, t, h), own in zip(rows, lines):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        left = len(w) - sum(len(x) for x in own if x and held[h, x] > line_documents and held[h, x] > hosts[h] * line_share)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        depleted = left < len(w) and (left < 50 or left < 0.5 * len(w))
        out.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(inside), failed, left, not failed and not depleted))
    return out


def license_base(text: str | None) -> tuple:
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def pii_base(text: str) -> list[tuple]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, ("email", "ip", "card", "phone")[k], b) for a, k, b in sorted(out)]


def simhash(rows: list[tuple[int, str | None]], radius: int = 2) -> list[tuple]:
    import xxhash

    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = {i: i for i, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, (i, _) in enumerate(rows):
        for j in range(k):
            if (prints[k] ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted((i, f"{p:016x}", find(i)) for (i, _), p in zip(rows, prints))


def phrases(rows: list[tuple[str | None, str | None]], least: int, inside: int, top: int) -> list[tuple]:
    """``rows``: (text, lang)."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = set()
    for (lang, *w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= inside * f[(lang, *w[i : i + k])]:
                    covered.add((lang, *w[i : i + k]))
    found: dict[str, list] = {}
    for (lang, *w), a in often.items():
        if (lang, *w) not in covered:
            cuts = [(2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def prefix_trie(convs: dict[int, list[tuple[str, int]]]) -> list[tuple]:
    """``convs``: turns as (name, words)."""
    import hashlib

    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        kids = sum(len(q) == len(p) + 1 for q in below)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), kids, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, int]]]:
    """``rows``: (conv_id, turn, role, text); no two turns of a conversation have one number."""
    import zlib

    turns: dict[int, list] = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        turns.setdefault(c, []).append(((role or "") + "\x00" + (text or ""), len(re.findall("[^\x20\x09-\x0d]+", text or ""))))
    group = lambda c: c // 20 * 20 if c >= 0 else -(-c // 20 * 20)  # noqa: E731  rounded towards zero
    return {c: turns.get(group(c), [])[: zlib.crc32(str(c).encode()) % 4] + own[zlib.crc32(str(c).encode()) % 4 :] for c, own in turns.items()}
