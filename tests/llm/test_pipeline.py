"""The pipeline against plain Python, and its stages on hard inputs."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lagweave.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = SCHEMA + ", lang_pred string, score double, n_words long, n_removed long, size long, cut string, row string, lagweave_pos string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    vocab = {"en": [f"{a}{b}the" for a in "bcdfg" for b in "aeiou" for _ in "xx"], "fr": [f"{a}{b}eau" for a in "hjklm" for b in "aeiou"]}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang], n))
    rows = [(i, text("en" if i % 3 else "fr", int(rng.integers(20, 160))), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(60)]
    for i in range(60, 72):
        words = rows[i - 60][1].split()
        words[3] = "changed"
        rows.append((i, " ".join(words), rows[i - 60][2], "s1"))
    shared = text("en", 60)
    rows += [(i, text("en", 30) + " " + shared + " " + text("en", 25), "en", "s2") for i in range(72, 78)]
    rows += [(78, None, "en", "s0"), (79, "", None, None), (80, "12 34 !!", None, "s0"), (81, rows[4][1], "en", "s3"), (82, shared, "en", "s3")]
    item = " ".join(f"item{c}the" for c in "abcdefghijklmnop")
    rows += [(83, text("en", 40) + " " + item + " " + text("en", 20), None, "s2")]
    folder = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)
    df.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return rows, item, f"file://{folder}"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def shingles(text):
    w = words(text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain(rows, item):
    """Each stage over lists of (doc_id, text, lang, source)."""
    kept = [r for r in rows if langid.has_letter(r[1])]
    stages = [kept]
    root = {r[0]: r[0] for r in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {r[0]: shingles(r[1]) for r in kept}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [r for r in kept if find(r[0]) == r[0]]
    stages.append(kept)
    first = {}
    for i, t, *_ in kept:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    cut = []
    for i, t, lang, s in kept:
        w = words(t)
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        if not w or len(gone) < len(w):
            cut.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), lang, s))
    stages.append(cut)
    stages.append([r for r in cut if item not in r[1]])
    size = Counter()
    for _, t, _, s in stages[-1]:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left = {}, set(names)
    while left:
        share = {s: (sum(size.values()) - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in over} if over else share
        left = left - set(over) if over else set()
    return stages, size, target


def test_whole_run_equals_plain_python(spark, tables):
    rows, item, folder = tables
    stages, size, target = plain(rows, item)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages):
        got = stage(spark, docs, folder).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted((r[0], r[1]) for r in want), name
        assert all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, SCHEMA)
    assert [len(s) for s in stages] == sorted((len(s) for s in stages), reverse=True) and len(rows) > len(stages[0]) > len(stages[1]) > len(stages[3])
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r[0]: r for r in stages[-1]}
    taken = Counter()
    for r in got:
        assert r.text == kept[r.doc_id][1] and r["size"] == len(words(r.text)) and 0 < r.taken <= 3 * r["size"]
        assert r.source_size == size[r.source] and np.isclose(r.target, target[r.source])
        taken[r.source] += r.taken
    assert all(taken[s] == round(t) for s, t in target.items())


def test_stages_on_hard_inputs(spark, tables):
    rows, _, folder = tables
    clash = [(i, t, lang, s, len(t or ""), "p", 0.25, -7, -8, -9, "c", "r", "l") for i, t, lang, s in rows[:3] + rows[72:79]] + [(None, "the other text", None, None, 14, "p", 0.25, -7, -8, -9, "c", "r", "l")] * 2
    for schema, data in ((SCHEMA, []), (SCHEMA, [(1, None, None, None, 0)]), (CLASH, clash)):
        df = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == df.columns, name
            for r in out.collect():
                if schema == CLASH:
                    assert (r.lang_pred, r["score"], r.n_words, r.n_removed, r["size"], r.cut, r.row, r.lagweave_pos) == ("p", 0.25, -7, -8, -9, "c", "r", "l"), name
        out = corpus_pipeline.STAGES[-1][1](spark, df, folder)
        assert out.columns[-4:] == ["size", "source_size", "target", "taken"] and (data or out.count() == 0)
    texts = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, _, s in rows], SCHEMA)
    assert corpus_pipeline.language(spark, texts, folder).count() == len(rows)
