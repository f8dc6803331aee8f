import random
from hashlib import sha256

import pytest

from aliasmith.llm.fingerprints import edited, fingerprints
from aliasmith.llm.piecewise import fingerprint, likeness
from conftest_llm import prose


def brute_likeness(one, two):
    """Edit distance by its table, over signatures as they stand."""
    table = list(range(len(two) + 1))
    for i, a in enumerate(one, 1):
        before, table[0] = table[0], i
        for j, b in enumerate(two, 1):
            before, table[j] = table[j], before if a == b else 1 + min(table[j], table[j - 1])
    return 1 - table[-1] / (len(one) + len(two))


# The method once more, byte by byte, from its fixed values alone.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def slow_crc32(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def slow_pieces(data, exponent):
    """The window slides by one byte and ends a piece where its hash is small; the 64th piece takes the rest."""
    window, pieces, piece = [0] * 8, [], b""
    for byte in data:
        window = [*window[1:], byte]
        piece += bytes([byte])
        rolled = sum(b << 8 * i for i, b in enumerate(window)) * 0x9E3779B97F4A7C15 % (1 << 64)
        if rolled < 1 << (64 - exponent) and len(pieces) < 63:
            pieces.append(piece)
            piece = b""
    return pieces + ([piece] if piece else [])


def slow_signature(data, exponent, longest):
    pieces = slow_pieces(data, exponent)
    pieces = pieces if len(pieces) <= longest else [*pieces[: longest - 1], b"".join(pieces[longest - 1 :])]
    return "".join(LETTERS[slow_crc32(p) % 64] for p in pieces)


def slow_fingerprint(data):
    if not data:
        return "0::"
    exponent = 0
    while 64 << exponent < len(data):
        exponent += 1
    while exponent and len(slow_pieces(data, exponent)) < 32:
        exponent -= 1
    return f"{exponent}:{slow_signature(data, exponent, 64)}:{slow_signature(data, exponent + 1, 32)}"


def slow_alike(one, two):
    if one == two:
        return 1.0
    run = min(4, max(1, 2 * min(len(one), len(two)) // 3))
    shared = any(one[i : i + run] in two for i in range(len(one) - run + 1))
    if not one or not two or not shared:
        return 0.0
    table = list(range(len(two) + 1))
    for i, a in enumerate(one, 1):
        before, table[0] = table[0], i
        for j, b in enumerate(two, 1):
            before, table[j] = table[j], before if a == b else 1 + min(table[j], table[j - 1])
    return 1 - table[-1] / (len(one) + len(two))


def slow_likeness(one, two):
    if one == two:
        return 1.0
    (size1, fine1, coarse1), (size2, fine2, coarse2) = one.split(":"), two.split(":")
    at = {int(size1): fine1, int(size1) + 1: coarse1}
    other = {int(size2): fine2, int(size2) + 1: coarse2}
    return max([slow_alike(at[k], other[k]) for k in at if k in other], default=0.0)


def slow_texts():
    rng = random.Random(4)
    texts = ["", "a", "é", "ab" * 40, "same " * 300, "x" * 3000, prose(4, 300), prose(4, 300) + " more", prose(4, 299)]
    texts += ["".join(rng.choices("ab \né日", k=rng.randint(1, 900))) for _ in range(12)]
    return texts + [prose(i, rng.randint(1, 200)) for i in range(8)]


def test_fingerprints_equal_the_method_byte_by_byte():
    texts = slow_texts()
    prints = [fingerprint(t.encode()) for t in texts]
    assert prints == [slow_fingerprint(t.encode()) for t in texts]
    for one in prints:
        for two in prints:
            assert likeness(one, two) == pytest.approx(slow_likeness(one, two), abs=1e-12)


def test_the_operator_equals_the_method_byte_by_byte(spark):
    texts = slow_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        following = texts[i - 1]
        changed = (text[: len(text) - len(text) // 3] + following[: len(text) // 3]).encode()
        own, other, after = slow_fingerprint(text.encode()), slow_fingerprint(changed), slow_fingerprint(following.encode())
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), sha256(changed).hexdigest())
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (own, other)
        wanted = (slow_likeness(own, other), slow_likeness(own, after))
        assert (rows[i].near_edited, rows[i].near_next) == pytest.approx(wanted, abs=1e-12)


def test_an_insertion_changes_few_pieces():
    text = prose(3, 400)
    changed = text[:700] + " something new " + text[700:]
    one, two = fingerprint(text.encode()), fingerprint(changed.encode())
    assert likeness(one, two) > 0.85
    assert likeness(one, one) == 1.0
    size1, fine1, _ = one.split(":")
    size2, fine2, _ = two.split(":")
    assert size1 == size2 and likeness(one, two) >= brute_likeness(fine1, fine2) - 1e-12


def test_unlike_texts_have_no_likeness():
    assert likeness(fingerprint(prose(1, 300).encode()), fingerprint(prose(2, 300).encode())) == 0.0


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "a" * 64, "a" * 65, "a" * 10_000, prose(1, 20_000)])
def test_signatures_are_bounded(text):
    _, fine, coarse = fingerprint(text.encode()).split(":")
    assert len(fine) <= 64 and len(coarse) <= 32


def test_awkward_documents(clashing, awkward_rows):
    rows = fingerprints(clashing.repartition(5)).collect()
    assert len(rows) == len(awkward_rows)
    texts = [t or "" for _, t, _, _ in awkward_rows]
    assert sorted(r.n_chars for r in rows) == sorted(map(len, texts))
    known = {i: t for i, t, _, _ in awkward_rows if i not in (5, None)}
    found = {r.doc_id: r for r in rows}
    following = {11: 10, 10: 9, 9: 8, 4: 3, 3: 2, 2: 1}
    for doc_id, after in following.items():
        row, text, next_text = found[doc_id], known[doc_id] or "", known[after] or ""
        change = edited(text, next_text)
        own = fingerprint(text.encode())
        assert row.fingerprint == own
        assert row.edited_sha256 == sha256(change.encode()).hexdigest()
        assert row.near_edited == likeness(own, fingerprint(change.encode()))
        assert row.near_next == likeness(own, fingerprint(next_text.encode()))
    by_text = {}
    for row in rows:
        assert 0.0 <= row.near_next <= 1.0 and 0.0 <= row.near_edited <= 1.0
        by_text.setdefault(row.fingerprint, set()).add(row.n_chars)


def test_the_last_document_meets_the_first(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(40)], "doc_id bigint, text string").repartition(6)
    row = next(r for r in fingerprints(docs).collect() if r.doc_id == 0)
    assert row.edited_sha256 == sha256(edited(prose(0, 50), prose(39, 50)).encode()).hexdigest()


def test_a_single_document_is_its_own_neighbour(spark):
    docs = spark.createDataFrame([(1, "abcdefghi")], "doc_id bigint, text string")
    (row,) = fingerprints(docs).collect()
    assert row.edited_sha256 == sha256(b"abcdefabc").hexdigest() and row.near_next == 1.0


def test_empty_table(empty):
    assert fingerprints(empty).collect() == []
