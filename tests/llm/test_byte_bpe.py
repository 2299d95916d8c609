import hashlib
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medlake.llm import byte_bpe as bb
from tests.llm.odd import base_rows, docs

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bb.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tree(ranks):
    return bb.ByteBpe(ranks, public_tokenizers.PATTERN)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_same_ids_as_the_public_encoder(spark, plain):
    got = {}
    for r in bb.token_report(docs(spark)).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    for row in base_rows():
        text = row[1] or ""
        want = np.array(plain.encode_ordinary(text), "<u4").tobytes()
        assert (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in got[row[0]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(tree, plain, text):
    text = text.encode("utf-8", "ignore").decode()
    packed = tree.encode(text)
    assert ids(packed) == plain.encode_ordinary(text)
    assert tree.decode(np.array(ids(packed), dtype=np.int64)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(256, 50000), min_size=1, max_size=30))
def test_tree_equals_direct_merging(tree, tokens):
    """Joined halves equal one direct pass over bytes made of whole tokens."""
    raw = b"".join(tree.tokens[t] for t in tokens)
    assert tree.encode_bytes(raw) == tree.merge(raw)


@pytest.mark.parametrize("raw", [b"a" * 333, b"ab" * 200, b" " * 99, b"\xff\xfe" * 50, b"aaab" * 77, b"0" * 1000])
def test_repetitive_bytes(tree, raw):
    assert tree.encode_bytes(raw) == tree.merge(raw)
    assert tree.decode(np.array(tree.encode_bytes(raw))) == raw


@pytest.mark.parametrize("piece", ["=", ".", "=-", "#!", "—", " ", "0", "ab", "\u4e2d\u6587"])
def test_long_runs(tree, plain, piece):
    text = piece * 3001
    assert ids(tree.encode(text)) == plain.encode_ordinary(text)


def test_a_run_of_a_million_takes_seconds(tree):
    start = time.time()
    assert tree.decode(np.array(ids(tree.encode("=" * 1_000_000)))) == b"=" * 1_000_000
    assert time.time() - start < 60


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="=-#.ab ", min_size=65, max_size=400))
def test_heap_equals_direct_merging(tree, text):
    raw = text.encode()
    parts = [raw[i:i + 1] for i in range(len(raw))]
    while True:         # lowest rank first, leftmost on ties, from the definition
        ranked = [(tree.ranks.get(a + b, tree.top), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(ranked, default=(tree.top, 0))
        if rank == tree.top:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    assert tree.merge(raw) == tree.encode_bytes(raw) == [tree.ranks[p] for p in parts]


def test_recent_keeps_what_was_used_last():
    kept = bb.Recent(10)
    for i in range(100):
        kept.put(i, str(i))
        assert kept.find(0) == "0" or i == 0
        assert len(kept) + len(kept.old) <= 10 and kept.find(i) == str(i)
    assert kept.find(1) is None


def test_encode_then_decode_equals_one_pass(spark):
    both = bb.decode(bb.encode(docs(spark))).select("doc_id", "ids", "decoded")
    one = bb.round_trips(docs(spark))
    assert sorted(map(str, both.collect())) == sorted(map(str, one.collect()))


def test_empty_table_and_columns(spark):
    assert bb.token_report(docs(spark, [])).count() == 0
    out = bb.with_tokens(docs(spark))
    assert set(docs(spark).columns) <= set(out.columns)
    assert out.filter("not round_trip").count() == 0 and out.count() == len(base_rows())
