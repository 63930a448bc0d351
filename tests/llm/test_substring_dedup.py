import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import substring_dedup as sd
from quadloom.llm._hashing import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words int"


def slow(texts, window=50):
    """doc_id, text pairs -> rows; the rule as it is stated."""
    big = 1 << 70
    first, words = {}, [WORD.findall(t or "") for _, t in texts]
    for (d, _), w in zip(texts, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, big), big - 1 if d is None else d)
    out = []
    for (d, _), w in zip(texts, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (big - 1 if d is None else d):
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, folder):
    return sorted((tuple(r) for r in sd.op7_substring_dedup(spark, folder).collect()), key=str)


def test_small_tables(spark, documents):
    assert run(spark, "/root/testdata/sf0.001") == slow([(d, t) for d, t, _ in documents])


def test_edges(spark, table):
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(70))
    same = " ".join(["same"] * 120)
    texts = [
        (1, None), (2, ""), (3, passage), (4, f"a b\n{passage}\tc d"), (5, passage.replace("p7", "x")), (6, f"{other} {passage}"),
        (7, f"{other} tail"), (8, same), (9, same + " same"), (10, "w " * 20000), (10, "w " * 20000), (11, f"e {passage[:-5]}"),
        (12, f"{other} one"), (12, f"{other} two"), (None, passage), (None, "x y"), (3, f"{passage} again"), (13, " ".join(["é ß"] * 40)),
    ]
    assert run(spark, table("documents", [(d, t, 1) for d, t in texts], SCHEMA)) == slow(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sd.substring_dedup(df.limit(0)).count() == 0
    odd = df.where("doc_id in (3, 4, 12)").selectExpr("5 as n_words", "doc_id", "6 as n_removed", "text", "7 as _marks", "8 as `a.b`", "9 as c0")
    left = sd.without_repeats(odd)
    assert left.columns == odd.columns and {(r["n_words"], r["n_removed"], r["_marks"], r["a.b"], r["c0"]) for r in left.collect()} == {(5, 6, 7, 8, 9)}
    assert [r["text"] for r in left.where("doc_id = 4").collect()] == ["a b c d"]
    kept = {(r["doc_id"], r["n_removed"]): r["text"] for r in sd.substring_dedup(df.where("doc_id in (3, 4)")).collect()}
    assert kept[4, 60] == "a b c d"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab \n\té", max_size=40), max_size=6))
def test_words_and_windows(texts):
    w = Words([t.encode() for t in texts])
    found = [t.encode().split() for t in texts]
    assert [int(x) for x in (w.first[1:] - w.first[:-1])] == list(map(len, found))
    starts, doc, anchor = w.windows(4, 2)
    seen = {}
    for s, d, a in zip(starts, doc, anchor):
        i = s - w.first[d]
        assert seen.setdefault(tuple(found[d][i : i + 4]), a) == a
    assert len(starts) == sum(max(0, len(f) - 3) for f in found)
