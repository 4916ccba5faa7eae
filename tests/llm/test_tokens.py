"""Tokens and packing against the libraries they must equal."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as known
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shelfdelta.llm import binary_packing, prefix_bpe

RANKS = known.path("byte_bpe_50k.tiktoken")
JSON = known.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return prefix_bpe.PrefixBpe(prefix_bpe.load_ranks(RANKS))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdABCabcé€漢0½9#\x1c\x85\xa0 "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_encodes_as_the_library_does(library, text):
    for of_path in (prefix_bpe.remembered(RANKS, known.PATTERN), binary_packing._remembered(JSON, known.PATTERN)):
        assert np.frombuffer(of_path.encode([text])[0], dtype="<u4").tolist() == library.encode_ordinary(text)


def test_the_tokenizer_file_gives_the_same_ids(documents, library):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    texts = [r[0] for r in documents.select("text").collect()] + ["a <|endoftext|> b"]
    ours = [np.frombuffer(b, dtype="<u4").tolist() for b in binary_packing._remembered(JSON, known.PATTERN).encode(texts)]
    assert ours == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert binary_packing.byte_ranks(tokenizer) == {w: r for w, r in prefix_bpe.load_ranks(RANKS).items()}


def test_few_lookups_and_searches(library):
    """What a new word costs: about three lookups a byte behind the prefix it shares, and no search of its own."""
    class Counting(dict):
        gets = 0

        def get(self, *of):
            Counting.gets += 1
            return dict.get(self, *of)

    class Searches:
        count, pattern = 0, regex.compile(known.PATTERN)

        def findall(self, text):
            Searches.count += 1
            return self.pattern.findall(text)

    bpe = prefix_bpe.PrefixBpe(Counting(prefix_bpe.load_ranks(RANKS)))
    stems = [a + b + c for a in ("thnde", "ielic", "quetr", "oserr") for b in ("heit", "cion", "rass", "ment") for c in ("zach", "ende", "iser", "olle")]
    words = [f" {a}{b}" for a, b in zip(stems, stems[1:])]
    Counting.gets = 0
    found = bpe.encode_many({w.encode() for w in words})
    assert Counting.gets < 6 * sum(map(len, words))
    assert [np.frombuffer(found[w.encode()], dtype="<u4").tolist() for w in words] == list(map(library.encode_ordinary, words))
    pieces = [*words, *(w + ",it's" for w in words), "first", "\n", " ", "\t\t", " 's", "'s"]
    assert prefix_bpe.pre_tokens(pieces, Searches()) == [Searches.pattern.findall(p) for p in pieces]
    assert Searches.count <= 6


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=5), unique=True, max_size=40), st.lists(st.binary(max_size=300), max_size=8))
def test_any_vocabulary_follows_the_rule(more, words):
    letters = [bytes([i]) for i in range(256)]
    ranks = {w: i for i, w in enumerate([*letters, *(bytes(97 + b % 3 for b in w) for w in more)])}
    words = {bytes(97 + b % 3 for b in w) for w in words}
    bpe = prefix_bpe.PrefixBpe(ranks)
    for word, rank in ranks.items():
        parts = bpe.merged(word, rank)
        assert bpe._halves[rank] == (tuple(ranks[p] for p in parts) if len(parts) == 2 else (rank, rank))
    found = bpe.encode_many(words)
    assert {w: np.frombuffer(b, dtype="<u4").tolist() for w, b in found.items()} == {w: bpe.encode(w) for w in words}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=10), st.binary(max_size=200), st.integers(0, 30))
def test_tables_of_appends_and_edits(bpe, data, more, tail, at):
    table = bpe.table(data)
    assert bpe.append(table, data, more) == bpe.table(data + more)
    old, new = data + tail, data[:at] + more + data[at:] + tail
    assert bpe.edit(bpe.table(old), old, new) == bpe.table(new)


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_encode_and_decode(request, library, which):
    docs = request.getfixturevalue(which)
    coded = prefix_bpe.decode(prefix_bpe.encode(docs.withColumnRenamed("source", "bytes"), RANKS, known.PATTERN), RANKS)
    got = sorted((r["doc_id"] or -1, r["ids"], bytes(r["bytes"])) for r in coded.collect())
    assert got == sorted((r["doc_id"] or -1, library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect())


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_pack(request, library, which):
    docs = request.getfixturevalue(which)
    rows = binary_packing.pack(docs, JSON, known.PATTERN).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] == 1 << r["bucket"] <= 1024 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["sequence_id"])):
        if r["start"] == 0:
            whole.setdefault(r["doc_id"], []).append(b"")
        assert len(whole[r["doc_id"]][-1]) == 4 * r["start"]
        whole[r["doc_id"]][-1] += r["ids"]
    want = {}
    for d in docs.collect():
        want.setdefault(d["doc_id"], []).append(np.array(library.encode_ordinary(d["text"] or "") + [0], dtype="<u4").tobytes())
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    assert binary_packing.piece_lengths(2048 + 5) == [1024, 1024, 4, 1]


def test_workers_keep_no_pieces_between_tasks(documents):
    assert binary_packing.pack(documents, JSON, known.PATTERN).count() > 0

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(binary_packing._remembered(JSON, known.PATTERN)._known)]})

    assert {r["n"] for r in documents.repartition(8).mapInArrow(held, "n long").collect()} == {0}
