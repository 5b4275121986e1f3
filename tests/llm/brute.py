"""Plain Python versions of the text operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

import regex
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORDS.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_duplicate_classes(rows: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    fps = {i: simhash(t or "") for i, t in rows}
    ids = sorted(fps)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def edited(rows: list[tuple[int, str]]) -> dict[int, tuple[int, str]]:
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        new = t[: len(t) - cut] + after[:cut]
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest())
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    n, r = len(words), len(covered)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, dup, r, n < 50 or 100 * r > 50 * n


UNITS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^ \t\n\x0B\f\r\p{Han}\p{Hiragana}\p{Katakana}]{1,16}")


def _neighbours(values: list, size: int, join) -> list:
    step = 1
    while step < size:
        if len(values) > step:
            values = [join(a, b) for a, b in zip(values, values[step:])]
        step *= 2
    return values


def winnowed(text: str, gram: int = 4, window: int = 8) -> set[int]:
    """Hashes of the k-grams that winnowing keeps."""

    def two(a: int, b: int) -> int:
        seed = xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()
        return xxhash.xxh64(b.to_bytes(8, "little"), seed=seed).intdigest()

    units = [xxhash.xxh64(u.encode(), seed=42).intdigest() for u in UNITS.findall(text)]
    grams = [h >> 33 for h in _neighbours(units, gram, two)]
    return {h for h, _ in _neighbours([(h, -i) for i, h in enumerate(grams)], window, min)}


def winnowed_neighbours(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """``doc_id, n_chars, edited_sha256, near_edited, near_next`` of every row."""

    def place(row):
        h = xxhash.xxh64(row[1].encode(), seed=42).intdigest()
        return row[0] is None, row[0] or 0, h - (h >> 63 << 64)

    def like(a: set, b: set) -> float:
        return round(len(a & b) / len(a | b), 9) if a | b else 1.0

    rows = sorted(((i, t or "") for i, t in rows), key=place)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        new = t[: len(t) - cut] + after[:cut]
        digest = hashlib.sha256(new.encode()).hexdigest()
        out.append((i, len(t), digest, like(winnowed(t), winnowed(new)), like(winnowed(t), winnowed(after))))
    return out
