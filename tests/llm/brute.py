"""Plain single-process versions of the operators, for small tables."""

import re

import xxhash

SPACE = " \t\n\r\x0b\x0c"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def substring_dedup(rows, width=20):
    """rows: (id, text), distinct ids (None first). Returns id -> (kept words, removed)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for i, text in order:
        w = words(text)
        gone = set()
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            if key in seen:
                gone |= set(range(k, k + width))
            seen.add(key)
        out[i] = ([x for k, x in enumerate(w) if k not in gone], len(gone))
    return out


def line_dedup(rows, min_docs, keep_first=False):
    """rows: (id, text) in id order, distinct. Returns the kept text and dropped count of each."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACE).translate(lower)
    docs = {}
    for k, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if key(line):
                docs.setdefault(key(line), set()).add(k)
    many = {x for x, d in docs.items() if len(d) >= min_docs}
    met, out = set(), []
    for _, text in rows:
        kept, dropped = [], 0
        for line in (text or "").split("\n"):
            if key(line) in many and not (keep_first and key(line) not in met):
                dropped += 1
            else:
                kept.append(line)
            met.add(key(line))
        out.append(("\n".join(kept), dropped))
    return out


def simhash(text, shingle=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = words((text or "").translate(lower))
    if not w:
        return 0
    grams = [" ".join(w[k:k + shingle]) for k in range(max(len(w) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=4):
    """prints: list of (id, fingerprint). Returns the smallest reachable id per row."""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(prints))]


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k:k + 8]), []).append(k)
    cover = {k + d for ks in where.values() if len(ks) > 1 for k in ks for d in range(8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]
