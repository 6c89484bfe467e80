"""Small tables with every awkward case, and plain-Python counterparts of the operators."""

from __future__ import annotations

import random
import re
from collections import defaultdict

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, key string, "
    "cls long, row string, component string, n_bytes string, n_tokens long, lang_pred string, "
    "predicted string, `__row` long, `__values` string, spans string, n_replaced string"
)


def prose(rng: random.Random, n: int) -> str:
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "the", "of", "and", "river", "stone"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Ordinary texts, exact and near copies, chains of them, shared passages, nulls, empty, very long
    and repeated rows, a row without id."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = []
    passage = prose(rng, 60)
    for i in range(25):
        rows.append((i, prose(rng, rng.randrange(1, 150))))
    base = prose(rng, 120)
    near = base.split()
    for i in range(25, 40):  # a chain: each copy differs a little more from the first
        near[rng.randrange(len(near))] = f"edit{i}"
        rows.append((i, " ".join(near)))
    for i in range(40, 50):
        rows.append((i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 30)))
    rows += [(i, base.upper()) for i in range(50, 60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "one"), (64, "one two"), (65, "ONE  two")]
    rows += [(66, "é" * 150 + "日本" * 40), (67, "x" * 450), (68, "x" * 450), (69, "ab" * 300)]
    rows += [(70, prose(rng, 30_000)), (71, rows[3][1]), (71, rows[3][1]), (None, rows[3][1])]
    rows += [(72, "1 2 3 4 5 6"), (73, "1 2 3 4 5"), (74, "1 2 3 4 5 6 7 8 9"), (75, "1 2 3 4 5 6 7 8")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    langs = ["en", "de", None]
    data = [
        (i, t, langs[k % 3], "s", len(t or ""), "a", "b", 5, "c", "d", "e", 9, "f", "g", 3, "h", "i", "j")
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def shingle_set(text: str | None, n: int = 5) -> set[tuple]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def linked_components(rows, num: int = 80, den: int = 100) -> dict[int, tuple[int, int]]:
    """key -> (size, component), comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_ranges(texts_: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per text, the maximal ranges covered by strings that start anywhere else too."""
    count: dict[bytes, int] = defaultdict(int)
    for t in texts_:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] += 1
    out = []
    for t in texts_:
        ranges: list[list[int]] = []
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                if ranges and ranges[-1][1] >= i:
                    ranges[-1][1] = i + length
                else:
                    ranges.append([i, i + length])
        out.append([(a, b) for a, b in ranges])
    return out
