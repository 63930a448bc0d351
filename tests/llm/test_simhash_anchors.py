import random
import re

import numpy as np
import xxhash

from quadloom.llm import simhash_anchors as sa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(rows, texts):
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    want = slow_components(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{fps[d]:016x}", want[d]) for d in texts}


def test_small_tables(spark, documents):
    rows = sa.op10_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    check(rows, {d: t for d, t, _ in documents})


def test_edges(spark, table):
    texts = {1: None, 2: "", 3: " \t\n", 4: "one", 5: "ONE", 6: "a b c d e", 7: "A B  C\x0bd e", 8: "É x y", 9: "é x y", 10: "w " * 30000}
    folder = table("documents", [(d, t, 1) for d, t in texts.items()], "doc_id long, text string, fp int")
    check(sa.op10_simhash_near_dedup(spark, folder).collect(), texts)
    df = spark.createDataFrame([(7, "a b c")] * 4 + [(None, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, [r["component_id"] for r in sa.near_duplicates(df).collect()])) == ["7"] * 5 + ["None"]
    assert sa.near_duplicates(df.limit(0)).count() == 0


def test_links_equal_brute_force_also_where_anchors_are_hot(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = set(base)
    for f in base:
        for k in (1, 2, 3, 4):
            for _ in range(3):
                g = f
                for b in rng.sample(range(64), k):
                    g ^= 1 << b
                fps.add(g)
    hot = rng.getrandbits(32)  # one half is the same for hundreds
    fps |= {hot | (rng.getrandbits(32) << 32) for _ in range(300)} | {hot | (rng.getrandbits(6) << 40) for _ in range(60)}
    want = slow_components({f: f for f in fps})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for size in (4096, 16):
        edges = sa.link_fingerprints(spark.createDataFrame(signed, "fp long"), slice_size=size)
        roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in sa.components(edges).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(roots.get(f, f), set()).add(f)
        expected = {}
        for f, r in want.items():
            expected.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_code_covers_every_half():
    words = np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint64)
    own = sa.home(words)
    assert np.bitwise_count(own ^ words).max() <= 1 and (sa.home(own) == own).all()
    for bit in range(32):  # a word one bit away visits the home
        assert (sa.anchors(words ^ np.uint64(1 << bit)) == own[:, None]).any(axis=1).all()
    assert np.bitwise_count(sa.anchors(words) ^ words[:, None]).max() <= 2
