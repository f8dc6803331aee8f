import random
from zlib import crc32

import numpy as np
import pytest

from aliasmith.llm.mphash import PerfectHash
from aliasmith.llm.token_store import checksum, stored_checksums, stored_ids, write_tokens
from aliasmith.llm.vocabularies import WORD_PAIRS, vocabulary
from aliasmith.llm.wordpieces import WordEncoder

tokenizers = pytest.importorskip("tokenizers")
PARTS = ["a", "The", "'s", "'", " ", "  ", "\n", "É", "日本", "😀", "12", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", " ", "Σ", "İ", "é", ",", ".", ", ", "ﬁ", "\x0b", "\x0c", "word.", "Word,", "İ.", "ΑΣ.", "ΑΣ", "ΑΣ,x", "\u0958.", "\u0301", "q'll,", "\u2003", "\x85"]


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(vocabulary(WORD_PAIRS))
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_as_whole_texts_are(library):
    encoder, rng = WordEncoder(vocabulary(WORD_PAIRS)), random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(400)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == library(text)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash_numbers_keys_without_gaps(n):
    keys = np.array(random.Random(n).sample(range(1 << 62), n), np.uint64)
    assert sorted(PerfectHash.build(keys).number(keys).tolist()) == list(range(n))


def expected(rows, library):
    """By id, null as the smallest; rows of one id in any order."""
    found, start = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library(text or ""), 1]
        found.setdefault(doc_id, []).append(ids)
        start += len(ids)
    return found


def test_round_trip_of_awkward_documents(clashing, awkward_rows, library):
    store = write_tokens(clashing, vocabulary(WORD_PAIRS), shard_ids=200)
    wanted = expected([(i, t) for i, t, _, _ in awkward_rows], library)
    rows = stored_ids(store, clashing).collect()
    for doc_id, ids in wanted.items():
        assert sorted(map(tuple, ids)) == sorted(tuple(r.ids) for r in rows if r.doc_id == doc_id)
    places = sorted((r.start, r.n_tokens) for r in rows)
    assert [s for s, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
    in_order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    assert store.manifest.count() > 1
    sums = {(r.start, r.ids_crc32) for r in stored_checksums(store, clashing).collect()}
    assert sums == {(r.start, crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}


def test_a_store_is_read_in_runs(spark, monkeypatch):
    """Neighbouring documents are one read, and a key with many rows is read in parts."""
    from aliasmith.llm import token_store
    from aliasmith.llm.token_store import Shard, _runs

    rows = [(i, "one two three") for i in range(50)] + [(50, f"again {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    store = write_tokens(docs, vocabulary(WORD_PAIRS))
    shards = [Shard(store.address, r.path) for r in store.manifest.orderBy("partition", "shard").collect()]
    for shard in shards:
        keys = np.arange(51)
        row, n_rows = shard.find(keys)
        runs = list(_runs(shard, row, n_rows))
        assert runs == [(0, len(shard.starts) - 1)]
        monkeypatch.setattr(token_store, "_RUN_IDS", 9)
        monkeypatch.setattr(token_store, "_ROWS", 7)
        runs = list(_runs(shard, row, n_rows))
        assert [a for a, _ in runs[1:]] == [b for _, b in runs[:-1]] and runs[-1][1] == len(shard.starts) - 1
        assert all(b - a == 1 or shard.starts[b] - shard.starts[a] <= 9 for a, b in runs)
        odd, n_odd = shard.find(keys[1::2])
        assert sum(b - a for a, b in _runs(shard, odd, n_odd)) == n_odd.sum()
        monkeypatch.undo()
    assert sum(len(s.starts) - 1 for s in shards) == 90
    found = stored_checksums(store, docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {**dict.fromkeys(range(50), 1), 50: 40}


def test_unknown_keys_are_not_found(spark, clashing):
    store = write_tokens(clashing, vocabulary(WORD_PAIRS))
    keys = spark.createDataFrame([(1,), (-77,), (6,), (10**12,)], "doc_id bigint")
    assert [r.doc_id for r in stored_checksums(store, keys).collect()] == [1]


def test_empty_table(empty):
    store = write_tokens(empty, vocabulary(WORD_PAIRS))
    assert stored_checksums(store, empty).collect() == []


def test_checksum_is_over_wide_ids():
    assert checksum(np.array([1, 2], "<u2")) == {"ids_crc32": crc32(b"\1\0\0\0\2\0\0\0")}
