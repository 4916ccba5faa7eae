"""Exact and near duplicates against brute force."""

import numpy as np
import pytest

from shelfdelta.llm import anchors, bwt_dedup, jaccard_join, window_doubling
from shelfdelta.llm.common import RollingHash
from llm import brute


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def unique(df):
    return df.where("doc_id is not null").dropDuplicates(["doc_id"])


def got(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_window_doubling(request, which):
    docs = request.getfixturevalue(which)
    out = window_doubling.deduplicated(docs)
    assert out.count() == docs.count()
    assert got(out, "n_words", "n_removed", "kept_sha256") == brute.words_removed(pairs(unique(docs)))


def patterned(length):
    """Two words of one length, each the 0110 pattern that sums modulo powers of two cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [32, 256, 1024, 4096])
def test_patterned_words_are_told_apart(spark, length):
    one, two = patterned(length)
    rest = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([w] + rest[:k])) for i, (w, k) in enumerate((w, k) for k in (2, 12) for w in (one, two))] + [(9, " ".join([one] + rest))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(window_doubling.deduplicated(docs), "n_words", "n_removed", "kept_sha256") == brute.words_removed(rows)
    assert got(jaccard_join.near_duplicates(docs), "class_id", "links") == brute.near_classes(rows)
    assert got(bwt_dedup.deduplicated(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.bytes_removed(rows)


def test_repeated_passages_go_on_doubling(spark):
    line = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(1, line), (2, "a b " + line + " c"), (3, " ".join(f"u{i}" for i in range(90)))], "doc_id long, text string")
    found = window_doubling.repeated_passages(docs)
    count = {(r[0], r[1]): r[2] for r in found.groupBy("doc_id", "length").count().collect()}
    assert count == {(d, n): 60 - n + 1 for d in (1, 2) for n in (13, 26, 52)}


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_bwt_dedup(request, which):
    docs = request.getfixturevalue(which)
    out = bwt_dedup.deduplicated(docs)
    assert out.count() == docs.count()
    assert got(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.bytes_removed(pairs(unique(docs)))


def test_bwt_dedup_of_hot_anchors(spark, documents, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "HOT", 1)
    assert got(bwt_dedup.deduplicated(documents), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.bytes_removed(pairs(documents))


def test_frequent_string_meets_in_a_bounded_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    junk = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = junk(130)
    rows = [(d, junk(150) + passage + junk(150)) for d in range(120)] + [(200, junk(60) + passage + junk(60) + passage + junk(70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, contents = [], bwt_dedup.contents

    def counted(*args):
        out = contents(*args)
        sizes.append(out.groupBy("deal", "content").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(bwt_dedup, "HOT", 20)
    monkeypatch.setattr(bwt_dedup, "contents", counted)
    assert got(bwt_dedup.deduplicated(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.bytes_removed(rows)
    assert len(sizes) == 1 and 1 < sizes[0] <= 16


def test_merge_gives_the_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        shards = [np.append(rng.integers(1, 4, rng.integers(1, 30)), 0).astype(np.uint8) for _ in range(3)]
        depth = 12
        where, common, block = bwt_dedup.merge(shards, depth)
        # Every shard is read round and round, so a suffix goes on at its shard's beginning.
        text = [np.tile(s, 20)[i:i + depth].tolist() for s in shards for i in range(len(s))]
        keys = [text[i] for i in where]
        assert keys == sorted(text)
        for i in range(1, len(keys)):
            same = next((j for j in range(depth) if keys[i][j] != keys[i - 1][j]), depth)
            assert common[i] == same and (block[i] == block[i - 1]) == (same == depth)


def test_many_random_segments_around_one_gram():
    rng = np.random.default_rng(4)
    junk = rng.integers(33, 123, (6_000, 116), dtype=np.uint8)
    contents = [j[:58].tobytes() + b"the shared line of 24 by" + j[58:].tobytes() for j in junk]
    # Every third segment repeats 120 bytes of one from the other shard.
    contents[3_000::3] = [c[10:130] + bytes(rng.integers(33, 123, 20, dtype=np.uint8)) for c in contents[:1_000]]
    seen, want = {}, []
    for c in contents:
        want.append([i for i in range(len(c) - 99) if c[i:i + 100] in seen])
        seen.update((c[i:i + 100], True) for i in range(len(c) - 99))
    got = bwt_dedup.repeated_starts(contents, 100, np.arange(len(contents)), np.zeros(len(contents), dtype=np.int64))
    assert sum(map(len, want)) >= 21_000 and [g.tolist() for g in got] == want


def test_repeated_intervals_come_from_common_prefixes(monkeypatch):
    merge = bwt_dedup.merge
    monkeypatch.setattr(bwt_dedup, "merge", lambda *a: (*merge(*a)[:2], None))
    text = bytes(range(97, 123)) * 5
    got = bwt_dedup.repeated_starts([text[:110], b"-" + text[:110]], 100, np.array([1, 2]), np.zeros(2, dtype=np.int64))
    assert [g.tolist() for g in got] == [[], list(range(1, 12))]


def test_windows_over_a_prefix_of_another_hash():
    """A task gets a copy of a module's hash beside the module's own, which may not have grown yet."""
    data = np.frombuffer(b"abcdefgh" * 9, dtype=np.uint8)
    want = RollingHash(7).windows(data, 24)
    assert RollingHash(7).windows(data, 24, RollingHash(7).prefix(data)).tolist() == want.tolist()


def test_shard_order_to_the_depth_and_no_further():
    rng = np.random.default_rng(7)
    for most in (3, 40, 1 << 22):  # codes that fit three times into a key, and codes that do not
        symbols = np.append(rng.integers(1, most, 300), 0)
        symbols[150:180] = symbols[20:50]
        for depth in (1, 2, 3, 9, 26):
            order = bwt_dedup.shard_order(symbols, depth)
            heads = [symbols[i:i + depth].tolist() for i in order]
            assert sorted(order) == list(range(301)) and heads == sorted(heads)


def test_segments_that_cannot_repeat_are_not_merged(spark, monkeypatch):
    """segments that share the anchor's gram but no string do not reach the merge; all that share one do."""
    rng = np.random.default_rng(8)
    junk = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    gram, passage = junk(40), junk(70)
    rows = [(d, junk(150) + gram + junk(150)) for d in range(40)]
    # Exactly 100 bytes in common, the gram at its beginning, in its middle, at its end; 99 bytes in common; within one text.
    for d, (left, right) in enumerate([(0, 60), (30, 30), (60, 0), (29, 30)], 50):
        part = junk(left) + gram + junk(right)
        rows += [(2 * d, junk(120) + "A" + part + "B" + junk(120)), (2 * d + 1, junk(90) + "C" + part + "D" + junk(90))]
    rows += [(200, junk(50) + gram + passage + "X" + junk(130) + "Y" + gram + passage + junk(50)), (201, "ab" * 90), (202, "ab" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.bytes_removed(rows)
    assert got(bwt_dedup.deduplicated(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert [want[2 * d + 1][1] for d in range(50, 54)] == [100, 100, 100, 0]

    data = [text.encode() for _, text in rows[:40]]
    cut = [t[90:250] for t in data] + [b"-" + data[3][100:240]]
    anchor = np.full(41, np.int64(bwt_dedup.signed(bwt_dedup._BYTES.windows(np.frombuffer(gram.encode(), np.uint8), 24))[7]))
    assert np.flatnonzero(bwt_dedup.possible(cut, anchor, 100)).tolist() == [3, 40]
    # Without the gram, or with several of it, a segment is always kept.
    assert bwt_dedup.possible([junk(100).encode(), (gram * 4).encode(), b"x" * 9], anchor[:3], 100).all()
    assert bwt_dedup.possible([b"a", b"b"], anchor[:2], 100).all()


def test_shard_order_with_codes_beyond_the_length():
    rng = np.random.default_rng(5)
    symbols = np.append(rng.integers(1, 500_000, 400), 0).astype(np.int32)
    symbols[:100] = np.repeat(symbols[:25], 4) + np.tile([0, 0, 1, 1], 25)
    order = bwt_dedup.shard_order(symbols, 26)
    assert np.all(np.diff(symbols[order]) >= 0)


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_jaccard_join(request, which):
    docs = request.getfixturevalue(which)
    out = jaccard_join.near_duplicates(docs)
    assert got(out, "class_id", "links") == brute.near_classes(pairs(unique(docs)))


def test_jaccard_join_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join(base[:d] + [f"new{d}"] + base[d + 1:])) for d in range(60)] + [(100, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_join.near_duplicates(docs), "class_id", "links") == brute.near_classes(rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r[0]: r[1] for r in jaccard_join.components(edges, "chain").collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_window_minima_and_runs():
    values = np.array([5, 3, 9, 3, 7, 1, 8], dtype=np.uint64)
    assert anchors.window_minima(values, 3).tolist() == [3, 3, 3, 1, 1]
    starts, size = anchors.runs(np.array([3, 3, 3, 1, 1], dtype=np.uint64), 2)
    assert starts.tolist() == [0, 2, 3] and size.tolist() == [2, 1, 2]
