"""Operators against brute force on small tables, and on hard inputs."""

import hashlib
import re

import numpy as np
import pytest

from lagweave.llm import chat, decontam, langid, mixing, pst, simhash, substring, warc, winnow, zquality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lw_part string, score double, taken long, first string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1.0, 2, "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    shared = text(70)
    rows = [(i, text(int(rng.integers(5, 200))), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(60)]
    for i in range(60, 75):
        words = rows[i - 60][1].split()
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "en", "s0"))
    rows += [(i, text(30) + " " + shared + "\n" + text(20), None, None) for i in range(75, 85)]
    rows += [(85, None, None, None), (86, "", "en", "s1"), (87, " \t ", None, "s1"), (None, shared, "en", None), (88, rows[0][1], "en", "s2"), (88, rows[0][1], "en", "s2")]
    rows += [(90, " ".join(vocab * 20), "en", "s3"), (91, "Été \U0001f600 " * 30, "fr", "s3"), (92, "12 34", "en", "s3")]
    return rows


def brute_components(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), f"{fps[i]:016x}", low.get(find(i))) for i, r in enumerate(rows))


def plain_fingerprint(text):
    import xxhash

    w = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot,blocks", [(2048, 2), (2, 2), (2, 3), (2048, 3)])
def test_simhash_equals_all_pairs(spark, corpus, hot, blocks, monkeypatch):
    if blocks == 3:
        monkeypatch.setattr(simhash, "MANY", 0)
    got = simhash.near_duplicates(docs(spark, corpus), hot_homes=hot).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute_components(corpus)


def test_anchors_cover_every_link():
    tables = simhash.coset_tables(2)
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63 - 1, 200, dtype=np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(46, 3, replace=False)) for _ in x], np.int64)

    def sets(v, e):
        out = [set() for _ in v]
        for row, anchor, _ in simhash.replicas(v, tables, e):
            for i, a in zip(row, anchor):
                out[i].add(a)
        return out

    assert all(a & b for a, b in zip(sets(x, 1), sets(x ^ flips, 2)))


def test_a_hot_anchor_is_shared_out():
    """Comparisons of homes and probes under one anchor, by salt: together as many as without salts, none in two of them."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    fp = np.sort(rng.integers(0, 1 << 12, 900)).astype(np.int64)
    fp = np.unique(fp)
    home = rng.random(len(fp)) < 0.5
    whole = None
    for salts in (1, 4):
        own = fp % salts
        found, most = set(), 0
        for s in range(salts):
            rows = [(simhash.PROBE, x) for x, h, o in zip(fp, home, own) if not h and o == s]
            rows += [((simhash.EARLIER, simhash.OWN, simhash.LATER)[int(np.sign(s - o)) * -1 + 1], x) for x, h, o in zip(fp, home, own) if h]
            role, x = (np.array(c) for c in zip(*sorted(rows)))
            pairs = np.where(role == simhash.PROBE, (role < simhash.PROBE).sum(), np.where(role == simhash.OWN, np.arange(len(role)), 0)).sum()
            most = max(most, pairs)
            batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int64)), pa.array(np.zeros(len(x), np.int32)), pa.array(role.astype(np.int8)), pa.array(x.astype(np.int64))], ["anchor", "salt", "role", "fp"])
            for buffer in (10_000, 50):
                for out in simhash._compare(iter([batch.slice(a, 40) for a in range(0, len(x), 40)]), 1, buffer):
                    found |= set(zip(out["u"].to_pylist(), out["v"].to_pylist()))
        whole = whole or most
        u, v = (np.array(c) for c in zip(*found))
        stars = simhash.spanning(u, v)
        if salts == 1:
            want = dict(zip(*(c.tolist() for c in stars)))
    assert dict(zip(*(c.tolist() for c in stars))) == want and most < 0.4 * whole


def test_spanning_keeps_components():
    a, b = np.array([1, 2, 5, 7]), np.array([2, 3, 6, 5])
    u, v = simhash.spanning(a, b)
    assert dict(zip(u.tolist(), v.tolist())) == {2: 1, 3: 1, 6: 5, 7: 5}


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_equals_brute_force(spark, corpus, batches):
    window, first = 50, {}
    for i, t, *_ in corpus:
        w = (t or "").split()
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(x.decode() for x in w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = substring.remove_repeats(docs(spark, corpus), batches=batches).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted(want)


def test_substring_index_takes_a_later_batch(spark, corpus, tmp_path):
    """Two calls with one index folder, opened anew for the second, equal one call over all; only partners' texts are read again."""
    d = docs(spark, corpus)
    early, late = d.where("doc_id < 78"), d.where("doc_id >= 78 or doc_id is null")
    path = f"file://{tmp_path}/index"
    first = substring.remove_repeats(early, index=substring.WindowIndex(spark, path)).collect()
    index = substring.WindowIndex(spark, path)
    assert len(index.runs) == 1
    second = substring.remove_repeats(late, batches=1, index=index, older=early).collect()
    want = substring.remove_repeats(d).collect()
    row = lambda r: (str(r.doc_id), r.n_words, r.n_removed, r.text)
    assert sorted(map(row, [*first, *second])) == sorted(map(row, want)) and sum(r.n_removed for r in second) > 0
    again = substring.WindowIndex(spark, path)
    assert len(again.runs) == 1 and again.read(again.runs).count() == again.read(again.runs).distinct().count()
    with pytest.raises(ValueError):
        substring.remove_repeats(late, index=again)


def test_langid_learns_and_rejects(spark):
    rows = [(i, f"the house and the garden {i}" if i % 2 else f"la maison et le jardin {i}", "en" if i % 2 else "fr", "s") for i in range(40)]
    rows += [(50, None, None, "s"), (51, "", None, "s"), (52, "12 34 !!", None, "s"), (53, "the garden", None, None)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in langid.identify(d, langid.train(d)).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(40)) and got[53].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i]["score"] == 0 for i in (50, 51, 52))
    none = langid.train(d.where("lang is null"))
    assert none.langs == () and {r.lang_pred for r in langid.identify(d, none).collect()} == {"und"}


def test_langid_pieces_do_not_matter():
    texts = ["abc def " * 40, "", "xyz"]
    model = langid.LanguageModel(("a", "b"), np.zeros(2), np.random.default_rng(0).normal(size=(1 << 10, 2)).astype(np.float32))
    whole = langid.score_texts(texts, model)
    total = []
    for most in (7, 1 << 18):
        s = np.zeros((3, 2))
        for cp, start, length, owner in langid.pieces(texts, most):
            inside = langid._inside(start, length, len(cp) - 2)
            for b in langid.buckets(cp, langid.ORDERS, 10):
                np.add.at(s, np.repeat(owner, length), model.logp[b[inside]])
        total.append(s)
    assert np.allclose(total[0], total[1]) and whole[0][0] == model.langs[int(total[1][0].argmax())]


def test_quality_separates(spark):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(200):
        good = i % 2
        text = " ".join(rng.choice(["stone", "river", "garden", "window", "summer", "letter"], 60)) if good else "$$% " * 20 + "".join(rng.choice(list("!#%&"), 80))
        rows.append((i, text, "en", "s"))
        marks.append((i, good))
    rows += [(300, None, None, None), (301, "", None, None)]
    d, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r for r in zquality.classify(d, zquality.train(d, labels)).collect()}
    assert np.mean([got[i].predicted == i % 2 for i in range(200)]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[300]["score"] == got[301]["score"]
    assert 0 < zquality.score(["x"], zquality.train(d, labels.where("quality = 1")))[0] < 1


def test_leaks(spark):
    bench = spark.createDataFrame([(1, "Anna pays 12 km of road with 3 bags, and 12 km again for each of them."), (2, "the quick brown fox jumps over the lazy dog near the river bank today"), (3, "short one")], "item_id long, text string")
    rows = [
        (1, "Intro words. Anna pays 12 km of road with 3 bags, and 12 km again for each of them. End.", None, None),
        (2, "Anna pays 40 miles of road with 7 bags, and 40 miles again for each of them.", None, None),
        (3, "Anna pays 40 miles of road with 7 bags, and 99 miles again for each of them.", None, None),
        (4, "text before THE QUICK brown fox jumps over the lazy dog near the river bank today after", None, None),
        (5, "nothing to see here at all in this long clean sentence about garden work", None, None),
        (6, None, None, None),
        (7, "short one", None, None),
        (None, "the quick brown fox jumps over the lazy dog near the river bank today", None, None),
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 1): "copy", (2, 1): "reparameterised", (4, 2): "copy"}
    assert {r.doc_id for r in decontam.remove_leaks(docs(spark, rows), bench).collect()} == {3, 5, 6, 7, None}


def test_winnowing(spark, corpus):
    d = docs(spark, corpus)
    got = winnow.edited_likeness(d).collect()
    assert len(got) == len(corpus)
    order = sorted({i for i, *_ in corpus if i is not None}, reverse=True)
    text = {i: t or "" for i, t, *_ in corpus}
    for r in got:
        if r.doc_id is None:
            continue
        t, n = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {}
    for r in got:
        by.setdefault(text.get(r.doc_id), set()).add(r.fingerprint)
    assert all(len(v) == 1 for t, v in by.items() if t is not None)


def plain_winnow(text, k=4, w=6):
    """(hash, position) of every entry: least of each window, rightmost of equal ones."""
    import xxhash

    pieces = [p for p in re.findall(winnow.PIECE, text or "")]
    if not pieces:
        return []
    turn = lambda h, by: ((h << by) | (h >> (64 - by))) & ((1 << 64) - 1)
    each = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    rolled, hashes = 0, []
    for i, h in enumerate(each):
        rolled = turn(rolled, 1) ^ h
        if i >= k:
            rolled ^= turn(each[i - k], k)
        if i >= k - 1 or i == len(each) - 1:
            hashes.append(rolled & ((1 << 35) - 1))
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, min(i + w, len(hashes))) if hashes[j] == least)
        if (least, at) not in out:
            out.append((least, at))
    return out


def test_winnowing_equals_brute_force(spark, corpus):
    rows = [*corpus, (200, "漢字かな交じり文とカタカナ " * 3, "ja", "s"), (201, "ab cd " * 30, "en", "s"), (202, "x" * 500, "en", "s"), (None, "zz " * 9, None, None)]
    d = docs(spark, rows)
    got = winnow.edited_likeness(d).collect()
    assert len(got) == len(rows)
    text = {}
    for i, t, *_ in rows:
        if i is not None:
            text[i] = max(text.get(i, ""), t or "")
    order = sorted(text, reverse=True)
    as_text = lambda e: ",".join(f"{h:x}:{p}" for h, p in e)

    def likeness(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in got:
        if r.doc_id is None:
            continue
        t, n = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = plain_winnow(t), plain_winnow(edited), plain_winnow(n)
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(a), as_text(b))
        assert np.isclose(r.near_edited, likeness(a, b)) and np.isclose(r.near_next, likeness(a, c))
    entries = {r.doc_id: len(r.entries) for r in winnow.fingerprint(d).collect()}
    assert entries[85] == entries[87] == 0 < entries[202]


def test_texts_without_spaces_share_entries(spark):
    block = "春眠暁を覚えず処処啼鳥を聞く夜来風雨の声花落つること知る多少"
    rows = [(1, "あ" + block, None, None), (2, "違う前置き" + block + "後", None, None), (3, "全然関係のない文章をここに書いておきますからね", None, None)]
    e = {r.doc_id: {x >> winnow.POSITION_BITS for x in r.entries} for r in winnow.fingerprint(docs(spark, rows)).collect()}
    assert len(e[1] & e[2]) >= 3 and not e[1] & e[3]


def test_warc_round_trip(spark):
    pages = [(1, "http://a/x y\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (None, "u", "alone"), (5, "u", "é" * 3000), (5, "u", "é" * 3000)]
    pages += [(i, f"http://h/{i}", f"page {i} " * 500) for i in range(10, 60)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first int")
    bundles = warc.write_bundles(df, frame_bytes=20_000, bundle_bytes=5_000)
    got = warc.read_bundles(bundles).collect()
    assert len(got) == len(pages)
    low = {}
    for i, _, h in pages:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    text = {i: h or "" for i, _, h in pages}
    for r in got:
        h = text[r.page_id]
        refers = low.get(h) if low.get(h) != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(h.encode()), warc.digest(h.encode()), refers)
        assert r.record_type == ("revisit" if refers is not None else "response")
    data = {b.bundle_id: b["data"] for b in bundles.collect()}
    for x in warc.record_index(bundles).collect():
        head, _ = warc.read_record(bytes(data[x.bundle_id]), x["frame"], x["offset"], x["length"])
        assert head["warc-record-id"] == x.record_id
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_mix_reaches_targets(spark, corpus):
    got = mixing.mix(docs(spark, corpus)).collect()
    assert len(got) == len(corpus)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["taken"]
        target[r.source] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, open_ = {}, set(names)
    while True:
        left = sum(size.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            open_.remove(s)
    for s in names:
        assert np.isclose(target[s], want[s]) and taken[s] == round(want[s])


def test_mix_gives_clashing_columns_back(spark):
    names = ["s", "cut", "full", "left_over", "whole", "more", "extra", "lw_part", "lw_draw", "doc", "id", "part", "draw", "of", "upto", "n", "w", "cap", "place", "rank", "Taken"]
    rows = [(i, "a b c " * (i + 1), f"s{i % 3}" if i % 4 else None, *(f"{n}-{i}" for n in names)) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(d).collect()
    assert len(got) == 30 and got[0].__fields__[:3] == ["doc_id", "text", "source"]
    for r in got:
        assert all(r[n] == f"{n}-{r.doc_id}" for n in names[:-1]) and r["size"] == 3 * (r.doc_id + 1) and isinstance(r["taken"], int)


def test_langid_letters_are_letters():
    assert [langid.has_letter(t) for t in ("½ ² Ⅷ", "12 _ !", "x", "½é", "字", None, "")] == [False, False, True, True, True, False, False]


def test_langid_equals_plain_bayes(spark):
    """Counts of the same hashed n-grams, added up one by one."""
    rng = np.random.default_rng(8)
    sound = {"aa": "abcd", "bb": "cdef", "cc": "efgh"}
    rows = [(i, "".join(rng.choice(list(sound[lang] + " "), 30)), lang, "s") for i, lang in enumerate(list(sound) * 12)]
    rows += [(100, "ab cd gh", None, None), (101, "EF gh", None, None), (None, "abba", "aa", None), (5, rows[5][1], rows[5][2], "s"), (102, "", "bb", "s")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in langid.identify(d, langid.train(d, bits=10)).collect()}

    def grams(text):
        cp = np.array([*map(ord, text.lower()), 0, 0], np.uint32)
        return [int(b) for found in langid.buckets(cp, langid.ORDERS, 10) for b in found] if text else []

    count = {lang: np.full(1 << 10, 0.5) for lang in sound}
    prior = dict.fromkeys(sound, 0)
    for _, t, lang, _ in rows:
        if lang:
            prior[lang] += 1
            for b in grams(t):
                count[lang][b] += 1
    for i, t, *_ in rows:
        if i is None or not t:
            continue
        logs = np.array([np.log(prior[x] / sum(prior.values())) + sum(np.log(count[x][b] / count[x].sum()) for b in grams(t)) for x in sound])
        best = list(sound)[int(logs.argmax())]
        assert got[i].lang_pred == best and np.isclose(got[i]["score"], 1 / np.exp(logs - logs.max()).sum(), rtol=1e-3)
    assert got[102].lang_pred == "und" and got[None].lang_pred == "aa"
    assert len(langid.train(d, max_cells=1).langs) == 3


def test_quality_calibration_keeps_the_share_of_labels(spark):
    """The bounded sample must not move the scores to even odds, whichever label it cuts."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["stone", "river", "garden", "window"] if rng.random() < 0.6 else ["cheap", "offer", "click"], 40)), "en", "s") for i in range(600)]
    marks = [(i, int(i % 10 != 0)) for i in range(600)] + [(7, 1), (8, 0), (None, 1), (9999, 0), (10, None)]
    d, labels = docs(spark, rows + [rows[3], (None, "x", "en", "s")]), spark.createDataFrame(marks, "doc_id long, quality int")
    for per_class in (30, 1500):
        got = zquality.classify(d, zquality.train(d, labels, per_class=per_class)).collect()
        assert abs(np.mean([r["score"] for r in got]) - 0.9) < 0.05
    assert len(got) == 602


def test_quality_marks_equal_plain_compression(spark):
    import zstandard

    rows = [(i, ("stone river garden %d " % i) * 30 if i % 2 else ("!#%% && %d " % (i * 7919)) * 20, "en", "s") for i in range(60)]
    d, labels = docs(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = zquality.train(d, labels)

    def size(data, text):
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(coder.compress(text[a : a + model.block])) for a in range(0, len(text), model.block))

    texts = [t for _, t, *_ in rows]
    want = [(size(model.bad, t.encode()) - size(model.good, t.encode())) / len(t.encode()) for t in texts]
    assert np.allclose(zquality.marks(texts, model), want)
    got = {r.doc_id: r["score"] for r in zquality.classify(d, model).collect()}
    order = np.argsort(want)
    assert (np.diff([got[int(i)] for i in order]) >= -1e-9).all()


def test_preference_pairs(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (1, 1, "assistant", "no"), (1, 0, "user", "hi"), (2, 0, "user", None), (7, 0, None, "x"), (6, 0, None, "x"), (None, 0, "user", "q")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame([(*t, 3) for t in turns], "conv_id long, turn long, role string, text string, prompt int")).collect()}
    assert got[0].prompt == "<|start|>user\nhi<|end|>\n" and got[0].chosen.startswith("<|start|>assistant\nyes<|end|>\n") and got[0].n_common == 1
    assert got[0].chosen_mask == "19:0,11:1,26:0" and got[0].rejected_mask == "19:0,10:1"
    assert got[1].n_common == 0 and got[1].rejected == "" and got[3].n_common == 1 and got[3].chosen == ""
    lengths = [sum(int(x.split(":")[0]) for x in got[0].chosen_mask.split(",")), len(got[0].chosen)]
    assert lengths[0] == lengths[1]


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    from pyspark.sql import functions as F

    assert simhash.near_duplicates(d).count() == 0
    assert langid.identify(d, langid.train(d)).count() == 0
    assert pst.score_corpus(d, F.lit(False)).count() == 0
    assert zquality.classify(d, zquality.train(d, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert substring.remove_repeats(d).count() == 0
    assert decontam.leaks(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert winnow.edited_likeness(d).count() == 0
    assert mixing.mix(d).count() == 0
    assert chat.preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_index_keeps_tiers_and_takes_a_third_batch(spark, corpus, tmp_path):
    """Batches of very different sizes are not merged; three batches, one after a compaction that was cut short, remove what one batch does."""
    rows = [(i, t, None, None) for i, t, *_ in corpus if i is not None and i != 88]
    want = {r.doc_id: (r.n_removed, r.text) for r in substring.remove_repeats(docs(spark, rows)).collect()}
    path, found = str(tmp_path / "index"), {}
    cuts = [(-1, 60), (60, 78), (78, 1000)]
    for k, (low, high) in enumerate(cuts):
        index = substring.WindowIndex(spark, path)
        older = docs(spark, [r for r in rows if r[0] <= low]) if low >= 0 else None
        batch = docs(spark, [r for r in rows if low < r[0] <= high])
        for r in substring.remove_repeats(batch, batches=1, index=index, older=older).collect():
            found[r.doc_id] = (r.n_removed, r.text)
        if k == 1:
            # a compaction that wrote its run and was stopped before it removed the old ones
            before = list(index.runs)
            index._write(index.read(before))
            assert len(substring.WindowIndex(spark, path).runs) == len(before) + 1
    assert found == want
    index = substring.WindowIndex(spark, str(tmp_path / "tiers"))
    ids = lambda a, n: spark.range(a, a + n, 1, 2).selectExpr("xxhash64(id) as anchor", "id as doc_id")
    index.append(ids(0, 60_000))
    index.append(ids(60_000, 50))
    index.compact()
    assert len(index.runs) == 2
    index.append(ids(60_050, 50))
    index.compact()
    assert len(index.runs) == 2 and index.read(index.runs).count() == 60_100


def test_pairs_given_by_a_table(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (5, 0, "user", "hi"), (5, 1, "assistant", "no " * 50_000), (5, 1, "assistant", "no " * 50_000), (9, 0, "user", "x")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(100, 1, 5), (101, 9, 77), (102, 70, 71), (103, 5, 5), (104, None, 1)], "pair_id long, chosen long, rejected long")
    got = {r.pair_id: r for r in chat.preference_pairs(t, pairs).collect()}
    assert sorted(got) == [100, 101, 103, 104]
    assert got[100].n_common == 1 and got[100].rejected.count("no no") and got[100].rejected_mask.count(":1") == 2
    assert got[101].n_common == 0 and got[101].rejected == "" and got[101].chosen
    assert got[103].n_common == 3 and got[103].chosen == got[103].rejected == ""
    assert got[104].chosen == "" and got[104].n_common == 0


def test_mix_refuses_what_has_no_meaning(spark, corpus):
    for wrong in ({"max_epochs": 0}, {"weights": ()}, {"weights": (1.0, 0.0)}):
        with pytest.raises(ValueError):
            mixing.mix(docs(spark, corpus), **wrong)
