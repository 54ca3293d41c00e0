"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(rows):
    """``{doc_id: (hex fingerprint, component)}`` by comparing all pairs."""
    prints = [(d, simhash(t)) for d, t in rows]
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (f"{fp:016x}", find(d)) for d, fp in prints}


def edited_texts(rows):
    """``{doc_id: edited text}`` for unique ids."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        out[d] = t[: len(t) - half] + after[:half]
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    kinds = list(PATTERNS)
    found = [
        (m.start(), kinds.index(kind), kind, m.end())
        for kind, p in PATTERNS.items()
        for m in re.finditer(p, text or "")
        if _holds(kind, m[0])
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def removed_repeats(rows, window=400):
    """``[(n_bytes, n_removed, n_spans, kept_sha256)]`` by counting every window."""
    counts = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for data in texts:
        counts.update(data[i : i + window] for i in range(len(data) - window + 1))
    out = []
    for data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if counts[data[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def token_rows(rows, tokenizer, end=2):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def warc_rows(rows):
    largest = defaultdict(lambda: -1)
    for page, payload in rows:
        largest[payload or ""] = max(largest[payload or ""], page)
    out = {}
    for page, payload in rows:
        data = (payload or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        other = largest[payload or ""]
        out[page] = (len(data), digest, *(("response", None) if page == other else ("revisit", other)))
    return out


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "br" in p else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)
