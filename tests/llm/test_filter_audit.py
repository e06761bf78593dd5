"""The filter audit against plain counting, and on odd rows."""

import re
from itertools import permutations

import numpy as np

from tidemark.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good, bad = ({i for i, *x in labels if x[k] == 1} - {None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails, out = [], {}
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        x = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((part or "", {f for f in x if x[f]}, i in good, i in bad))
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def held(spark, docs, labels, **kw):
    got = A.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS), **kw).collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_matches_plain_counting(spark, prose):
    docs = [(i, prose(i, n) + (" a%b" if i % 4 == 0 else "") + (" ABC" * n if i % 5 == 0 else ""), ["en", "de", None, ""][i % 4]) for i, n in enumerate([20, 99, 100, 130, 400] * 12)]
    docs += [(100 + i, docs[i % 7][1], "en" if i % 2 else "fr") for i in range(30)]
    docs += [(200, None, None), (201, "", "en"), (3, None, "en"), (3, docs[3][1], "de"), (3, docs[3][1], "de"), (None, docs[0][1], "en"), (None, None, None), (202, "ÀÉ AB\x0bcd\x1cef", "en"), (203, prose(1, 30_000), "en")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (201, None, None), (999, 1, 1)]
    want = brute(docs, labels)
    assert held(spark, docs, labels) == want
    assert all(any(v[k] for v in want.values()) for k in range(7))


def test_audit_on_odd_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert not A.audit(none, spark.createDataFrame([], LABELS)).count()
    docs = [(i, "same", "en") for i in range(500)]
    assert held(spark, docs, []) == brute(docs, [])
    odd = spark.createDataFrame([(1, "x", "en", 5, 6)], DOCS + ", _key int, survivors int")
    assert A.audit(odd, spark.createDataFrame([], LABELS)).count() == 600


def test_checks_can_be_others(spark):
    got = held(spark, [(1, "a b", "x"), (2, "a", "x"), (3, "a", "x")], [], checks={"S": lambda m: m.words < 2}, repeats="R")
    assert got == {("x", "SR", 1): (1, 2, 0, 1, 0, 0, 3), ("x", "SR", 2): (1, 0, 1, 0, 0, 0, 1), ("x", "RS", 1): (2, 1, 0, 0, 0, 0, 1), ("x", "RS", 2): (1, 1, 1, 1, 0, 0, 3)}


def test_positional_popcount_counts_every_bit():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 31, 1000, 4097):
        w = r.integers(0, 2**32, n, dtype=np.uint32)
        assert A.positional_popcount(w).tolist() == [int(((w >> np.uint32(b)) & 1).sum()) for b in range(32)]


def test_survival_words():
    w = A.survival_words(5)
    assert all((int(w[f]) >> s & 1) == (f & s == 0) for f in range(32) for s in range(32))
