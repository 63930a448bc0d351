import numpy as np

from quadloom.llm import nn_descent as nn


def brute(ids, vectors):
    """n_links and component of each row by comparing all."""
    ok = [v is not None and len(v) == max(len(w) for w in vectors if w is not None) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    at = [i for i, o in enumerate(ok) if o]
    u = np.array([vectors[i] for i in at], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(at))
    while True:
        new = np.array([min([label[i], *label[np.flatnonzero(link[i])]]) for i in range(len(at))])
        if (new == label).all():
            break
        label = new
    out = {}
    for i, o in enumerate(ok):
        if not o:
            out[ids[i]] = (0, ids[i])
    for i, k in enumerate(at):
        out[ids[k]] = (int(link[i].sum()), min(ids[at[j]] for j in np.flatnonzero(label == label[i])))
    return out


def check(rows, want):
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}
    assert got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(nn.op1_nn_descent(spark, folder).collect(), brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows]))


def test_dense_group_and_edges(spark, table):
    rng = np.random.default_rng(4)
    center = rng.standard_normal(16)
    vectors = [(center + 0.12 * rng.standard_normal(16)).tolist() for _ in range(700)]  # a third of all rows
    vectors += rng.standard_normal((1300, 16)).tolist()
    vectors += [vectors[-1], vectors[-1], None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 3, [2.0 * x for x in vectors[-2]]]
    vectors = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    folder = table("embeddings", [(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n int")
    rows = nn.op1_nn_descent(spark, folder).collect()
    check(rows, brute(list(range(len(vectors))), vectors))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [(r["n_links"], r["component_id"]) for r in nn.near_duplicates(twice).collect()] == [(2, 5)] * 3


def test_groups_whose_cross_links_are_weaker_than_a_full_list(spark):
    rng = np.random.default_rng(6)
    a, b = np.zeros(24), np.zeros(24)
    a[0], b[0], b[1] = 1, 0.955, np.sqrt(1 - 0.955**2)
    noise = lambda: 0.0125 * rng.standard_normal(24)
    vectors = [(a + noise()).tolist() for _ in range(150)] + [(b + noise()).tolist() for _ in range(150)]
    want = brute(list(range(300)), vectors)
    assert {c for _, c in want.values()} == {0} and min(n for n, _ in want.values()) >= nn.MOST_NEIGHBOURS
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    check(nn.near_duplicates(df).collect(), want)


def test_audit_sees_lone_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(8)
    hot = [(np.eye(24)[0] + 0.02 * rng.standard_normal(24)).tolist() for _ in range(300)]
    lone = [v.tolist() for x in rng.standard_normal((20, 24)) for v in (x, x + 0.01 * rng.standard_normal(24))]
    vectors = hot + lone
    base = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "cid long, v array<double>, n long")
    # the hot group is found whole, the pairs are not
    roots = spark.createDataFrame([(i, 0) for i in range(300)], "node long, root long")
    counts = spark.createDataFrame([(i, 299) for i in range(300)], "cid long, links long")
    assert nn.audit(base, counts, roots, 24, 0.95) < nn.RECALL


def test_rounds_find_what_the_start_does_not(spark):
    """A start at random holds few links; the rounds find nearly all."""
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((150, 32))
    v = np.concatenate([c + 0.12 * rng.standard_normal((8, 32)) for c in centers])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    every = int((u @ u.T >= 0.95).sum()) - len(v)
    coded = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cid long, v array<double>").mapInArrow(nn._code(32), "cid long, q binary")
    start = coded.selectExpr("xxhash64(cid) as h", "*").repartitionByRange("h").sortWithinPartitions("h").select("cid", "q")
    leaves = start.mapInArrow(nn._blocks(32, 4), "a long, b long, s double")
    graph = nn._lists(leaves.selectExpr("a", "b", "s", "false as old", f"{nn.NEIGHBOURS} as k"), 0.95)
    _, held = nn.descend(coded, graph, 32, 0.95)
    assert held[0] < 0.1 * every and 0.98 * every <= held[-1] <= every
