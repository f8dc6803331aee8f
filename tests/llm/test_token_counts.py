import random

import pytest
from pyspark.sql import functions as F

from aliasmith.llm import bytepairs
from aliasmith.llm.bytepairs import BytePairs
from aliasmith.llm.token_counts import longest_within, prefix_counts, token_counts, tokens_of_prefix
from aliasmith.llm.vocabularies import BYTE_PAIRS, vocabulary

tokenizers = pytest.importorskip("tokenizers")
PARTS = ["a", "the", "'s", "'re", "'", "l", " ", "  ", "\n", "é", "日本", "😀", "12", "!!", "<|", "<|endoftext|>", "|>", "\x1c", " ", "½", "-----", "ing", "\x00", "Σ"]


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(vocabulary(BYTE_PAIRS))
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(vocabulary(BYTE_PAIRS))


def test_every_prefix_has_the_count_of_the_library(pairs, library):
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
        wanted = [library(text[:i]) for i in range(len(text) + 1)]
        assert pairs.prefixes(text) == wanted
        assert pairs.count(text) == wanted[-1]
        limit = rng.randint(0, max(wanted) + 1)
        assert pairs.longest_prefix(text, limit) == max(i for i, c in enumerate(wanted) if c <= limit)


def test_awkward_documents(clashing, awkward_rows, library):
    found = token_counts(clashing, vocabulary(BYTE_PAIRS), limit=100).collect()
    wanted = sorted((len((t or "").encode()), library(t or "")) for _, t, _, _ in awkward_rows)
    assert sorted((r.n_bytes, r.n_tokens) for r in found) == wanted
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)


def test_empty_table(empty):
    assert token_counts(empty, vocabulary(BYTE_PAIRS)).collect() == []


def test_stored_counts_answer_questions(awkward, library):
    text = F.substring(F.coalesce("text", F.lit("")), 1, 300)
    docs = awkward.select("doc_id", text.alias("text"))
    counts = prefix_counts(docs.where("doc_id in (1, 3, 9)"), vocabulary(BYTE_PAIRS))
    rows = counts.select(
        "doc_id", tokens_of_prefix(F.col("counts"), F.lit(7)).alias("seven"), longest_within(F.col("counts"), F.lit(5)).alias("five")
    )
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in rows.collect():
        t = texts[row.doc_id]
        assert row.seven == library(t[:7])
        assert row.five == max(i for i in range(len(t) + 1) if library(t[:i]) <= 5)


def test_pieces_asked_for_again_stay_while_others_are_given_up(pairs, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "CACHED_PIECES", 8)
    few = bytepairs.BytePairs(vocabulary(BYTE_PAIRS))
    found = []
    monkeypatch.setattr(bytepairs, "_pieces", lambda chunk, split=bytepairs._pieces: found.append(chunk) or split(chunk))
    texts = [f"a common word{chr(97 + i)} and rare{chr(122 - i)}, common" for i in range(20)]
    assert [few.count(text) for text in texts] == [library(text) for text in texts]
    assert found.count("common") == 1
    assert len(few.chunks) + len(few.chunks.older) <= 8 and len(few.counts) + len(few.counts.older) <= 8


def test_lengths_tried_at_an_end_are_those_of_tokens(pairs):
    for text in ("Straße und queeuxier", " aaaaaaaa", "日本語の文", "x = y;\n\n\tz"):
        raw = text.encode()
        for end in range(1, len(raw) + 1):
            tokens = [size for size in range(end, 0, -1) if raw[end - size : end] in pairs.ids]
            tried = pairs._lengths[raw[max(0, end - bytepairs._ENDING) : end]]
            assert [size for size in tried if size <= end and raw[end - size : end] in pairs.ids] == tokens
            assert all(size in tokens for size in tried if size <= bytepairs._ENDING)
