"""The two audits against plain versions of their contracts."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

from shelfdelta.llm import filter_audit, source_divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, labels):
    """{(part, order, step): counts} by walking every order over every document."""
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    firsts = {}
    for d, t, _ in rows:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    fails = []
    for d, t, s in rows:
        t, w = t or "", WORD.findall(t or "")
        fails.append((s or "", d, {x for x, hit in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
            d is not None and firsts[t] < d)) if hit}))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine, removed_by = [f for f in fails if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                removed = [f for f in left if x in f[2]]
                left = [f for f in left if x not in f[2]]
                redundant = sum(x in f[2] for f in mine) - len(removed)
                removed_by[x] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(f[2] == {x} for f in mine),
                                                   sum(f[1] in good for f in removed), sum(f[1] in toxic for f in removed)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def plain_divergence(rows, top=200):
    """{(lang, source, part, item): (value, rank)} over dense counts."""
    docs = [(a or "", b or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for a, b, t in rows]
    df, count, whole, groups = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        for t, n in terms.items():
            df[lang, t] += 1
            count[lang, source][t] += n
            whole[lang][t] += n
    out = {}
    for lang, sources in groups.items():
        kept = [t for t in whole[lang] if df[lang, t] >= 3]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q, p = shares(whole[lang]), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            of_pairs = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in sources - {s}}
            of_terms = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if count[lang, s][t] and p[s][t] > q[t]}
            for part, values, limit in (("pair", of_pairs, None), ("term", of_terms, top)):
                for rank, (item, v) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:limit], 1):
                    out[lang, s, part, item] = (v, rank)
    return out


ODD_LABELS = [(3, 1, 0), (3, 0, 1), (4, None, 1), (5, 1, None), (9, 1, 1), (None, 1, 1), (77, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_every_order_of_filters(spark, request, labels, which):
    docs = request.getfixturevalue(which)
    marks = labels if which == "documents" else spark.createDataFrame(ODD_LABELS, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.audit(docs, marks).collect()}
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r) for r in marks.select("doc_id", "quality", "toxic").collect()])
    assert got == want


def test_copies_of_hot_text_and_repeated_ids(spark):
    rows = [(i, "same text", "hot", 1) for i in range(400)] + [(0, "same text", "other", 1), (None, "same text", None, 2), (None, "same text", "hot", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int").repartition(7)
    marks = spark.createDataFrame([(0, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.audit(docs, marks).collect()}
    assert got == plain_audit([r[:3] for r in rows], [(0, 1, 1), (7, 1, 0)])


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_divergence_equals_dense_counts(request, which):
    docs = request.getfixturevalue(which)
    got = {tuple(r[:4]): tuple(r[4:]) for r in source_divergence.divergence(docs).collect()}
    assert got == plain_divergence([(r["lang"], r["source"], r["text"]) for r in docs.collect()])


@pytest.fixture(scope="module")
def many_sources(spark):
    words = [f"{a}{b}" for a in ("ka", "Lo", "mé", "ni", "ß") for b in ("ra", "ta", "Za", "É")]
    rows = [(("x", "y")[i % 3 == 0], f"s{i * 7 % 23}", " 1-".join(words[(i * j) % len(words)] for j in range(1, 2 + i % 9))) for i in range(150)]
    return spark.createDataFrame(rows + [("z", "alone", "a b c"), ("x", "empty", None)], "lang string, source string, text string")


def test_clashing_digests_are_split(many_sources):
    want = plain_divergence([tuple(r) for r in many_sources.collect()], top=5)
    for bits in (1, 3):
        got = {tuple(r[:4]): tuple(r[4:]) for r in source_divergence.divergence(many_sources, top=5, bits=bits).collect()}
        assert got == want


def test_tiles_slices_and_flushes_change_nothing(many_sources, monkeypatch):
    want = plain_divergence([tuple(r) for r in many_sources.collect()], top=5)
    monkeypatch.setattr(source_divergence, "TILE", 4)
    monkeypatch.setattr(source_divergence, "SLICE", 5)
    monkeypatch.setattr(source_divergence, "MOST_SPLIT", 0)
    assert {tuple(r[:4]): tuple(r[4:]) for r in source_divergence.divergence(many_sources, top=5, bits=2).collect()} == want


def test_terms_are_cut_at_blanks_only():
    text = "Ab1cd É_f " * 500
    assert source_divergence.terms_of(text, piece=7) == Counter({"ab".encode(): 500, b"cd": 500, "É".encode(): 500, b"f": 500})
