import random

import corpus_pipeline
from quadloom.llm import similar_texts as st
from tests.llm.test_simhash_anchors import LOWER, WORD


def slow_components(texts):
    """Smallest doc_id that each one reaches over five-word Jaccard similarities of 0.8 or more."""
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(sets), {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def check(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = slow_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in st.similar_texts(df).collect()} == want
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in want if want[d] == d)
    return want


def test_stage_takes_one_of_texts_at_08_and_leaves_those_below(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, d = {1: None, 2: " ", 3: "One two", 4: "one  two", 5: "one two three"}, 10
    for _ in range(12):
        base = [word() for _ in range(104)]
        for k in (0, 1, 2, 3, 4):
            w = list(base)
            for i in rng.sample(range(2, 100), k):
                w[i] = word()
            texts[d], d = " ".join(w), d + 1
        # 100 shingles, of which the first 89 or 88 are shared: 89 / 111 is over 0.8, 88 / 112 below
        texts[d], texts[d + 1] = " ".join(base[:93] + [word() for _ in range(11)]), " ".join(base[:92] + [word() for _ in range(12)])
        d += 2
    want = check(spark, texts)
    assert len(set(want.values())) < len(want)


def test_dense_group_that_fingerprints_do_not_link(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = {}
    for d in range(150):
        w = list(base)
        for i in rng.sample(range(200), rng.choice((1, 2, 3, 5, 8))):
            w[i] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(w)
    check(spark, texts)


def test_pairs_of_a_dense_group_never_lie_on_disk_at_once(spark, monkeypatch):
    rng = random.Random(6)
    base, texts = [f"w{i}" for i in range(200)], {}
    for d in range(90):  # two edits each would link them; those with more have few links, but must be checked with all others
        w = list(base)
        for i in rng.sample(range(200), 2 if d < 6 else rng.choice((3, 4))):
            w[i] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(w)
    joined, bounded = [], st._bounded

    def counted(pairs, *more):
        joined.append(pairs.distinct().count())
        return bounded(pairs, *more)

    monkeypatch.setattr(st, "LEAST_PAIRS", 500, raising=False)
    monkeypatch.setattr(st, "_bounded", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in st.similar_texts(df).collect()} == slow_components(texts)
    assert max(joined) <= 700, joined


def test_small_tables(spark, documents):
    want = check(spark, {d: t for d, t, _ in documents})
    assert want[145] == 6 and want[177] == 1  # 7 and 11 of 64 bits apart


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f", 7, 8, 9, 1), (2, "a b c d e f", 7, 8, 9, 1), (3, "other words here", 7, 8, 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ord int, _tag int, _n int, `a.b` int")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
