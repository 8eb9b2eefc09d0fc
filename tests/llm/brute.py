"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import xxhash

BLANK_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text, k=3):
    words = BLANK_SPLIT.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """node -> smallest node of its connected part."""
    nodes = sorted(set(nodes))
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in nodes}


def near_groups(rows, radius=3):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    return [(i, f"{f:016x}", first) for i, f, _, first in near_roots(rows, radius)]


def near_roots(rows, radius=3):
    """(doc_id, fingerprint, smallest fingerprint of the group, component_id) of rows."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    root = groups([f for _, f in prints], lambda a, b: (a ^ b).bit_count() <= radius)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return [(i, f, root[f], least.get(root[f])) for i, f in prints]


def shingles(text, k=5):
    words = BLANK_SPLIT.findall((text or "").translate(LOWER))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def word_print(text):
    """Fingerprint of the different words."""
    words = set(BLANK_SPLIT.findall((text or "").translate(LOWER)))
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def similar_first(rows, similarity=0.8, radius=5):
    """Smallest id of each group of texts that are similar and candidates of each other."""
    sets = {t or "": shingles(t) for _, t in rows}
    prints = {t: word_print(t) for t in sets}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        total = len(sets[a] | sets[b])
        return (both / total if total else 1) >= similarity and (prints[a] ^ prints[b]).bit_count() <= radius

    root = groups(sets, linked)
    first = {}
    for i, t in rows:
        r = root[t or ""]
        if i is not None:
            first[r] = min(i, first.get(r) if first.get(r) is not None else i)
        else:
            first.setdefault(r, None)
    return list(first.values())


def contamination(rows, items, window=10):
    """(doc_id, n_words, n_hit, item ids) of rows."""
    found = collections.defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[k : k + window])].add(item)
    sizes = {len(w) for w in found}
    out = []
    for i, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for k in range(len(words)):
            for n in sizes:
                if k + n <= len(words) and tuple(words[k : k + n]) in found:
                    hit |= set(range(k, k + n))
                    ids |= found[tuple(words[k : k + n])]
        out.append((i, len(words), len(hit), sorted(str(x) for x in ids if x is not None)))
    return out


def token_rows(rows, tokenizer):
    """(doc_id, start, n_tokens, crc32), null ids first."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def unrepeated(rows, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, digest of what stays)."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def neighbours(rows, k, every):
    """query id -> (id, score) of its k nearest among valid (id, vector) rows."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-float((v * x).sum()), i) for i, v in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out
