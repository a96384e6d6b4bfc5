"""Filter audit, quality rules and hard negatives against brute force."""

import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import re
import xxhash
from pyspark.sql import functions as F

from wharfline.llm import filter_audit, hard_negatives, quality_rules

DOCS = "doc_id long, text string, lang string, source string, part string, fails_A boolean, score int, n_words int, half int"
LABELS = "doc_id long, quality int, toxic int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", True, 1, 1, 1) for r in rows], DOCS).repartition(3)


def _texts(n, seed=0):
    """Documents of several kinds: long and short, repeated words, capitals, marks, copies."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = list(rng.choice(vocabulary[: 60 if i % 5 == 0 else 400], rng.integers(0, 160)))
        if i % 7 == 0:
            words = [w.upper() for w in words]
        if i % 6 == 0:
            words = [w + "#*" for w in words]
        if i % 11 == 0:
            words = [w for w in words[:20] for _ in range(9)]
        out.append(" ".join(words).replace(" a", "\na"))
    for i in range(0, n, 9):
        out[i] = out[n - 1]
    return out


# ---- the filter audit

def _audit(rows, labels):
    marks = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= t == 1
    first = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    judged = []
    for i, text, _, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        judged.append((part or "", {k for k, v in fails.items() if v}, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for f in "ABCDE":
            total = sum(out[part, "".join(o), o.index(f) + 1][1] for o in permutations("ABCDE"))
            for o in permutations("ABCDE"):
                out[part, "".join(o), o.index(f) + 1].append(total)
    return out


def test_filter_audit_equals_brute_force(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(_texts(120))]
    rows += [(None, rows[119][1], "en", "s0"), (7, None, None, None), (7, None, None, None), (8, "", "en", ""), (500, "x " * 5000, "en", "s1"), (501, "x " * 5000, "en", "rare")]
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(100)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (9, None, None)]
    got = filter_audit.audit(_docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    want = _audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == want
    assert len(got) == len(want) == 120 * 5 * len({p for p, _, _ in want})
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)


def test_filter_audit_of_nothing_and_of_other_filters(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(_docs(spark, []).limit(0), labels).count() == 0
    docs = _docs(spark, [(1, "a", "en", "x"), (2, "b", "en", "x"), (3, None, "de", "x")])
    rows = filter_audit.audit(docs, labels, {"L": F.col("lang") == "en", "N": F.col("text").isNull()}, copies=None).collect()
    assert {(r["filter_order"], r["step"], r["kept"], r["removed"]) for r in rows} == {("LN", 1, 1, 2), ("LN", 2, 0, 1), ("NL", 1, 2, 1), ("NL", 2, 0, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {c: F.lit(False) for c in "ABCDEFGH"})


def test_each_state_is_reached_once(spark, monkeypatch):
    made = []
    real = filter_audit.materialise
    monkeypatch.setattr(filter_audit, "materialise", lambda df, name: (made.append(name), real(df, name))[1])
    filter_audit.audit(_docs(spark, [(1, "a", "en", "x")]), spark.createDataFrame([], LABELS)).count()
    assert made.count("edges") == 2**5


# ---- quality rules

def _counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    lines, seen, again = t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len({j for i, g in enumerate(grams) if g in often for j in (i, i + 1, i + 2)})


def _hash(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def _rules(rows, trusted):
    """(count of (id, counts, failed, kept, score)) by the method, with dictionaries."""
    q, words = quality_rules, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    grams = [[(w,) for w in ws] + list(zip(ws, ws[1:], strict=False)) for ws in words]
    buckets = q.buckets_for(sum(len((t or '').encode()) for _, t, *_ in rows))
    half = [_hash(t or "") % 2 for _, t, *_ in rows]
    raw, target = [Counter(), Counter()], [Counter(), Counter()]
    for (i, *_), gs, h in zip(rows, grams, half, strict=True):
        for g in gs:
            raw[h][_hash(*g) % buckets] += 1
            target[h][_hash(*g) % buckets] += i in trusted
    weights = []
    for r, t in zip(raw, target, strict=True):
        nr, nt = sum(r.values()), max(1, sum(t.values()))
        weights.append({b: round(math.log((1 - q.MIX) * (t[b] / nt) / (n / nr) + q.MIX) * q.UNIT) for b, n in r.items()})
    scored = []
    for (i, t, lang, _), gs, h in zip(rows, grams, half, strict=True):
        c = _counts(t)
        score = round(sum(weights[1 - h].get(_hash(*g) % buckets, q.least_weight()) for g in gs) / len(gs)) if gs else None
        scored.append((i, lang, c, c[0] < 50 or 100 * c[4] > 50 * c[0], score))

    def limit(values):
        v = sorted(values)
        if not v:
            return None
        low, mid = (v[math.ceil(x * len(v)) - 1] for x in (q.LOW, 0.5))
        return low if len(v) >= q.FEW else 2 * low - mid

    good = [(lang, s) for i, lang, _, failed, s in scored if i in trusted and not failed]
    every, out = limit([s for _, s in good]), []
    for i, lang, c, failed, s in scored:
        own = [x for ln, x in good if ln == lang]
        bound = limit(own) if own else every
        out.append((i, *c, failed, not failed and (bound is None or s >= bound)))
    return Counter(out)


ODD = [
    (None, "no id " * 60, "en", "x"), (900, None, None, None), (901, "", "", "x"), (902, "Straße 日本語 \x1c a b c a b c\x0b|<>\r\n x\n x\n  \n  ", "de", "x"),
    (903, "same words in every window " * 2000, "fr", "x"), (904, "w " * 51, None, "x"), (905, " ".join(f"w{i}" for i in range(3000)), None, "x"), (905, " ".join(f"w{i}" for i in range(3000)), None, "x"),
    (905, "another text with that id " + " ".join(f"v{i}" for i in range(70)), "en", "x"), (906, "\n".join(["one line", "two", "one line", "", "", "two"]), "en", "x"),
]


def test_quality_rules_equal_brute_force(spark):
    rows = [(i, t, ["en", "de", None, ""][i % 4], "x") for i, t in enumerate(_texts(300, 5))] + ODD
    rows += [(1000 + i, " ".join(f"zz{i}_{j}" for j in range(80)), "de", "x") for i in range(9)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(200)] + [(905, 1, 0), (905, 0, 0), (None, 1, 0), (4000, 1, 0)]
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    got = quality_rules.judge(_docs(spark, rows), spark.createDataFrame(labels, LABELS))
    assert Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE), r["base_failed"], r["kept"]) for r in got.collect()) == _rules(rows, trusted)
    assert got.where("not base_failed and not kept").count() > 0


def test_quality_rules_without_trusted_texts(spark):
    rows = ODD + [(i, t, "en", "x") for i, t in enumerate(_texts(20))]
    got = quality_rules.judge(_docs(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(rows) and all(r["kept"] != r["base_failed"] for r in got)
    assert quality_rules.judge(_docs(spark, []).limit(0), spark.createDataFrame([], LABELS)).count() == 0
    kept = quality_rules.keep_good(_docs(spark, rows), spark.createDataFrame([], LABELS))
    assert kept.columns == [c.strip().split(" ")[0] for c in DOCS.split(",")] and kept.where("doc_id is null").count() == 1


def test_trusted_kind_is_told_from_junk(spark):
    rng = np.random.default_rng(2)
    good, junk = [f"g{i}" for i in range(300)], [f"j{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(good if i % 4 else junk, 120)), "en", "x") for i in range(1600)]
    rows += [(5000 + i, rows[1][1], "en", "x") for i in range(500)] + [(6000 + i, rows[0][1], "en", "x") for i in range(500)]  # copies tell nothing about themselves
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 1600) if i % 3 == 0]
    got = quality_rules.judge(_docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    bad = {r["doc_id"] for r in got if not r["kept"]}
    junk_ids = {i for i in range(1600) if i % 4 == 0} | set(range(6000, 6500))
    assert junk_ids <= bad and len(bad - junk_ids) <= 0.02 * len(rows)


# ---- hard negatives

def _mine(rows):
    """(anchor, positive, rank, negative, scores) by comparing all rows."""
    ok = {(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, label, v in ok:
        if a % 50:
            continue
        by = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in ok if i != a)
        for s, p, _ in [x for x in by if x[2] == label][:5]:
            fit = [(n, t) for t, n, lab in by if lab != label and -50 * s <= -100 * t <= -95 * s][:3]
            out |= {(a, p, k, n, -s, -t) for k, (n, t) in enumerate(fit, 1)}
    return out


def _vectors(kind, n=700, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        x = rng.normal(size=(9, 8))[rng.integers(0, 9, n)] + 0.05 * rng.normal(size=(n, 8))
    else:
        x = rng.normal(size=(n, 8)) / 3
    if kind == "ties":
        x = np.round(x)
        x[: n // 3] = x[0]
    return [(i, int(rng.integers(0, 4)), [float(c) for c in row]) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_hard_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "FIRST", 3)
    rows = _vectors(kind)
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, [1.0] * 8), (1050, None, [1.0] * 8), (1100, 1, None), (1150, 1, []), (1200, 2, [nan] + [1.0] * 7), (1250, 2, [inf] + [1.0] * 7), (1300, 2, [None] + [1.0] * 7), (1350, 3, [0.0] * 8), (50, *rows[50][1:]), (1400, 1, [-1.0] * 8)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, unit int, list int").repartition(3)
    got = hard_negatives.mine(table).collect()
    want = _mine(rows)
    assert len(got) == len(want) > 20 and {tuple(r) for r in got} == want


def test_hard_negatives_of_little(spark):
    kinds = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], kinds)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, 1, [1.0, 2.0])], kinds)).count() == 0
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.6, 0.0]), (3, 2, [0.5, 9.0]), (4, 2, [0.96, 0.0]), (5, 3, [5.0])]
    assert {tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, kinds)).collect()} == {(0, 1, 1, 2, 65536, 39168), (0, 1, 2, 3, 65536, 32768)}


def test_few_lists_are_visited_where_vectors_form_clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(64, 16)) * 200
    x = np.floor(centres[rng.integers(0, 64, 4000)] + rng.normal(size=(4000, 16))).astype(np.int32)
    at, far = hard_negatives.nearest(x, centres)
    radii = np.zeros(64)
    np.maximum.at(radii, at, far)
    lists = hard_negatives.Lists(centres, radii, np.bincount(at, minlength=64))
    order, low, high = lists.order(x[0])
    assert (np.diff(high) <= 0).all()
    score = hard_negatives.products(x[:1], x)[0]
    for c, a, b in zip(order, low, high, strict=True):
        assert (score[at == c] >= a).all() and (score[at == c] <= b).all()
    tenth = np.sort(score)[-10]
    assert (high >= tenth).sum() < 16


def test_products_are_exact_beyond_doubles():
    a = np.full((1, 3), (1 << 22) - 1, np.int32)
    big = np.full((1, 4096), (1 << 22) - 1, np.int32)
    assert hard_negatives.products(a, a)[0, 0] == 3 * ((1 << 22) - 1) ** 2
    assert hard_negatives.products(big, big)[0, 0] == 4096 * ((1 << 22) - 1) ** 2
