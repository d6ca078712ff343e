"""Small documents with all odd cases, and plain statements of what the operators compute."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that the operators use inside.
    "id long, k long, sha string, n long, spans string, f1 long, cluster long, turn int, quality int, size int, _id long, _sha string"
)
_EXTRA = (7, 7, "x", 7, "x", 7, 7, 7, 7, 7, 7, "x")


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    """Prose with copies, near copies, shared passages, runs of one letter and every odd row."""
    rng = random.Random(seed)
    texts: list = [prose(rng, rng.randint(1, 260)) for _ in range(n)]
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(3)]
    base = prose(rng, 300, 5000).split(" ")
    for k in range(5):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(300)] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    texts += [texts[0], texts[1], texts[0].replace(" ", "  \n"), texts[1].upper()]
    texts += [None, None, "", "   ", "\n\t", "one", "One", "one two", "éß漢字 \U0001f642", "a" * 900, "ab" * 700, "1 2 3", "In. " * 300]
    texts += [prose(rng, 40_000), "x" * 3000 + texts[2]]
    rows = [(i, t, rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 0, 1, 2])}", len(t or ""), *_EXTRA) for i, t in enumerate(texts)]
    return rows


def odd_documents(seed: int = 1) -> list[tuple]:
    """The same with repeated rows, an id twice with different texts, and rows without id or source."""
    rows = documents(seed)
    twice = (rows[2][0], "another text under the same id", *rows[2][2:])
    none = [(None, rows[3][1], None, None, None, *_EXTRA), (None, None, None, None, None, *[None] * len(_EXTRA))]
    return [*rows, rows[4], rows[4], twice, *none]


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def grams(text: str | None, size: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(texts: dict, size: int, num: int, over: int = 100) -> dict:
    """Smallest id reachable by links, by comparing all pairs."""
    sets = {i: grams(t, size) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if over * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeated(rows: list[tuple], width: int) -> list[tuple]:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` by counting every string."""
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    times = Counter(t[i : i + width] for _, t in data for i in range(len(t) - width + 1))
    out = []
    for doc, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if times[t[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_runs(texts: dict, n: int) -> set:
    """Ids of the texts that share ``n`` words in a row with another."""
    seen = defaultdict(set)
    for i, t in texts.items():
        w = words(t)
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def edit_distance(one: list, two: list) -> int:
    row = list(range(len(two) + 1))
    for i, x in enumerate(one, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(two, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sort_key(row) -> tuple:
    return tuple((x is not None, x) for x in row)
