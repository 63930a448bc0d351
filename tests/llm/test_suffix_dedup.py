import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import bwt
from quadloom.llm import suffix_dedup as sd


def slow(docs, width=200):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, b in data:
        gone, reach = bytearray(len(b)), 0
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                for k in range(max(i, reach), i + width):
                    gone[k] = 1
                reach = i + width
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_tables(spark, documents):
    assert rows(sd.op2_suffix_dedup(spark, "/root/testdata/sf0.001")) == slow([(d, t) for d, t, _ in documents])


def test_edges(spark, table):
    rng = random.Random(1)
    text = lambda n, a="abcdefghij klmné": "".join(rng.choices(a, k=n))
    p, q = text(320), text(199)
    docs = [(1, None), (2, ""), (3, p), (4, text(50) + p + text(80)), (5, text(9) + q), (6, text(5) + q), (7, "z" * 201), (8, "z" * 199), (9, "ab" * 400), (10, text(300) + p[:210] + text(30))]
    docs += [(11, p[40:] + p[:250]), (12, text(40000)), (13, "same text " * 30), (14, "same text " * 30), (15, "x"), (15, "x" + p), (15, "x" + p), (None, p[:205]), (None, None), (16, "é" * 150)]
    folder = table("documents", [(d, t, 5) for d, t in docs], "doc_id long, text string, n int")
    assert rows(sd.op2_suffix_dedup(spark, folder)) == slow(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sd.suffix_dedup(df.limit(0)).count() == 0
    # cores with many contents are counted window by window
    assert rows(sd.suffix_dedup(df, most=1, digest=True)) == slow(docs)


def test_near_copies_with_short_windows(spark):
    rng = random.Random(7)
    base = "".join(rng.choices("abcd ", k=400))
    docs = []
    for i in range(40):
        t = list(base[rng.randint(0, 200) : rng.randint(220, 400)])
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("abcdX")
        docs.append((i, "".join(rng.choices("abcd ", k=rng.randint(0, 60))) + "".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (4096, 2):
        assert rows(sd.suffix_dedup(df, width=24, gram=6, step=8, most=most, digest=True)) == slow(docs, 24)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=9), st.integers(1, 8), st.integers(1, 4))
def test_merged_transforms_find_all_repeats(strings, depth, shards):
    count = Counter(s[i : i + depth] for s in strings for i in range(len(s) - depth + 1))
    want = [[i for i in range(len(s) - depth + 1) if count[s[i : i + depth]] > 1] for s in strings]
    assert [f.tolist() for f in bwt.repeated(strings, depth, shards)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=12).map(str.encode), min_size=2, max_size=8), st.sampled_from([1, 2]))
def test_merge_gives_order_and_common_prefixes(strings, wide):
    depth = 6
    shards, stride = bwt.build([strings[0::2], strings[1::2]], depth, wide)
    z, lcp = bwt.merge(shards, depth, stride)
    at = [0, 0]
    keys = []
    for i in z:
        s = shards[i]
        p = s.order[at[i]]
        at[i] += 1
        keys.append(bytes(s.text[(p + k) % len(s.text)] for k in range(depth)))
    assert keys == sorted(keys)
    for k in range(1, len(keys)):
        common = next((i for i in range(depth) if keys[k][i] != keys[k - 1][i]), depth)
        assert lcp[k] == common // stride * stride
