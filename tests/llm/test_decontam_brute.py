"""Benchmark decontamination against a plain version of its own, and recall by the kind of change."""

from collections import defaultdict

import numpy as np
import pytest
import regex

from lagweave.llm import decontam

UNIT = regex.compile(r"(?i)(?:%s)(?![\p{L}\p{N}])" % "|".join(sorted(decontam.UNITS, key=lambda u: (-len(u), u))))
NUMBER = regex.compile(r"(?<![\p{L}\p{N}])[-+]?\p{N}+(?:[.,:]\p{N}+)*")
NAME = regex.compile(r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}[\p{L}\p{M}]*")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def parse(text):
    """[(kind or None, word or value)] of a text: numbers first, a unit right after one, then names, then words."""
    text = text or ""
    marked, values, at = "", [], 0
    for m in NUMBER.finditer(text):
        marked += text[at : m.start()] + " znumz "
        values.append(m[0])
        at = m.end()
    marked = regex.sub("znumz +", "znumz ", marked + text[at:])
    units = []
    if values:
        out, at = "", 0
        for m in regex.finditer("znumz ", marked):
            u = UNIT.match(marked, m.end())
            out += marked[at : m.end()]
            at = m.end()
            if u:
                units.append(u[0])
                out, at = out + "zunitz", u.end()
        marked = out + marked[at:]
    names = NAME.findall(marked)
    marked = NAME.sub("znamez", marked).lower()
    held = {"znumz": iter(values), "zunitz": iter(units), "znamez": iter(names)}
    return [(w, next(held[w]).lower()) if w in held else (None, w) for w in WORD.findall(marked)]


def keys(words, width):
    """Key of each window: its template, or its values where it has under two ordinary words."""
    out = []
    for i in range(len(words) - width + 1):
        part = words[i : i + width]
        plain = sum(k is None for k, _ in part)
        key = tuple(k or w for k, w in part)
        out.append(("t", key) if plain >= decontam.LITERAL else ("v", tuple(regex.sub(r"(?<=\p{N})[.,:](?=\p{N})|^[-+]", "", v) for _, v in part)))
    return out


def runs(starts, n):
    return any(all(p + j in starts for j in range(n)) for p in starts)


def brute(docs, items, width=8, coverage=0.3, run=13):
    found, span = {}, max(1, run - width + 1)
    parsed = {d: parse(t) for d, t in docs}
    for item, text in items:
        q = parse(text)
        w = min(width, len(q))
        if not q or (w < width and sum(k is None for k, _ in q) < decontam.FEWEST):
            continue
        want = keys(q, w)
        for d, words in parsed.items():
            where = defaultdict(list)
            for pos, k in enumerate(keys(words, w)):
                where[k].append(pos)
            shifts = defaultdict(set)
            for p, k in enumerate(want):
                for pos in where[k]:
                    shifts[pos - p].add(p)
            hit = set().union(*shifts.values()) if shifts else set()
            if len(hit) < coverage * len(want) and not any(runs(s, span) for s in shifts.values()):
                continue
            good, same, any_long, same_long = set(), set(), False, False
            for shift, starts in shifts.items():
                inside = sorted({p + j for p in starts for j in range(w) if q[p + j][0]})
                met = [(a, q[a][0], q[a][1], words[a + shift][1]) for a in inside if words[a + shift][0] == q[a][0]]
                forward, backward = defaultdict(set), defaultdict(set)
                for _, kind, x, y in met:
                    forward[kind, x].add(y)
                    backward[kind, y].add(x)
                bad = {a for a, kind, x, y in met if x != y and (len(forward[kind, x]) > 1 or len(backward[kind, y]) > 1)}
                changed = any(x != y and a not in bad for a, _, x, y in met)
                left = {p for p in starts if not any(p <= a < p + w for a in bad)}
                good |= left
                any_long |= runs(left, span)
                if not changed:
                    same |= left
                    same_long |= runs(left, span)
            if good and (len(good) >= coverage * len(want) or any_long):
                found[d, item] = ("copy" if len(same) >= coverage * len(want) or same_long else "reparameterised", len(good))
    return found


def test_leaks_equal_a_plain_version(spark):
    rng = np.random.default_rng(11)
    vocab = [f"{a}{b}" for a in ("ba", "co", "di", "fu") for b in ("lan", "mer", "nis", "por", "tal")]

    def sentence(n):
        out = rng.choice(vocab, n).tolist()
        for i in range(2, n - 1, 5):
            out[i] = [f"{rng.integers(1, 40)}", f"{rng.integers(1, 9)},{rng.integers(100, 999)}", "Quen", "Rolf", f"{rng.integers(1, 20)} km"][int(rng.integers(5))]
        return " ".join(out)

    items = [(i, sentence(int(rng.integers(4, 40)))) for i in range(30)] + [(90, "12 34 56 78 90 12 34 56 78 91"), (91, ""), (92, None)]
    docs = []
    for i in range(120):
        of = items[int(rng.integers(30))][1].split()
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(len(of)))
            of[at] = str(rng.choice([*vocab, "7", "Rolf", "3 km", "99"]))
        if i % 3 == 0:
            of = [{"Quen": "Zed", "Rolf": "Kim"}.get(w, str(int(w) + 500) if w.isdigit() else w) for w in of]
        a = int(rng.integers(0, max(1, len(of) // 2)))
        docs.append((i, f"{sentence(12)} {' '.join(of[a:])} {sentence(9)}"))
    docs += [(200, None), (201, ""), (202, "12 34 56 78 90 12 34 56 78 91"), (203, items[0][1] + " " + items[0][1])]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (r.kind, r.n_windows) for r in found} == want
    assert len(want) > 40 and len({k for k, _ in want.values()}) == 2


KINDS = {
    "numbers": ([f"{n}" for n in range(2, 400, 7)], [f"{n}" for n in range(1001, 1800, 7)]),
    "units": (["5 km", "7 kg", "9 days", "11 miles"], ["5 m", "7 lb", "9 hours", "11 feet"]),
    "names": (["Anna", "Boris", "Clara", "Dmitri", "Élise", "Frédéric"], ["Zoe", "Yusuf", "Xavier", "Wanda", "Ürsula", "Viktor"]),
    "names at a sentence's start": (["Anna", "Boris", "Clara"], ["Zoe", "Yusuf", "Xavier"]),
}


@pytest.mark.parametrize("kind,least", [("numbers", 1.0), ("units", 0.95), ("names", 0.95), ("names at a sentence's start", 0.0)])
def test_recall_by_kind_of_change(spark, kind, least):
    """Items of 24 words with three slots, each planted under other values; a name at a sentence's start is a plain word, as README says."""
    rng = np.random.default_rng(12)
    vocab = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "hi") for b in ("lan", "mer", "nis", "por", "tal", "ver")]
    before, after = KINDS[kind]
    items, docs = [], []
    for i in range(60):
        words, other = rng.choice(vocab, 24).tolist(), None
        other = list(words)
        for at, pick in zip((5, 12, 19), rng.choice(len(before), 3, replace=len(before) < 3)):
            j = pick if kind == "units" else (pick + 1) % len(after)
            words[at], other[at] = before[pick], after[j]
            if kind == "names at a sentence's start":
                words[at - 1] += "."
                other[at - 1] += "."
        items.append((i, " ".join(words)))
        docs.append((i, f"{' '.join(rng.choice(vocab, 10))} {' '.join(other)} {' '.join(rng.choice(vocab, 10))}"))
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    hit = {r.doc_id for r in found.where("doc_id = item_id and kind = 'reparameterised'").collect()}
    print(kind, len(hit) / 60)
    assert len(hit) >= least * 60
