import random
import re

import pytest

from aliasmith.llm.licenses import BASE, NOTICES, Notice, NoticeSearch, license_scan, license_spans, parts
from conftest_llm import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def exact(text, notice):
    """Every place of a wording, word by word."""
    own, theirs = words(text), words(notice.words)
    return [i for i in range(len(own) - len(theirs) + 1) if own[i : i + len(theirs)] == theirs]


def fewest_edits(text, notice):
    """The fewest edits of any place (Sellers' table): a match may begin and end anywhere."""
    wording, own = f" {' '.join(words(notice.words))} ", f" {' '.join(words(text))} "
    column = list(range(len(wording) + 1))
    best = column[-1]
    for char in own:
        before, column[0] = column[0], 0
        for i, wanted in enumerate(wording, 1):
            before, column[i] = column[i], min(before + (char != wanted), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def edited(rng, text, edits):
    """So many characters changed, added or left out."""
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", "é ", "😀", text[i] + "q"]) + text[i + 1 :]
    return text


def found(text, notices):
    return NoticeSearch(notices).spans([w.encode() for w in words(text)])


@pytest.mark.parametrize("seed", range(4))
def test_a_notice_is_found_if_and_only_if_some_place_is_within_its_errors(seed):
    rng = random.Random(seed)
    notices = BASE + NOTICES
    search = NoticeSearch(notices)
    for _ in range(60):
        notice = rng.choice(notices)
        text = f"{prose(1, rng.randint(0, 5))} {edited(rng, notice.words, rng.randint(0, 8))}, {prose(2, rng.randint(0, 5))}"
        spans = search.spans([w.encode() for w in words(text)])
        for number, other in enumerate(notices):
            mine = [s for s in spans if s[0] == number]
            if other.errors == 0:
                assert [s[1] for s in mine] == exact(text, other)
            else:
                fewest = fewest_edits(text, other)
                assert bool(mine) == (fewest <= other.errors), (text, other, fewest)
                assert all(fewest <= edits <= other.errors for _, _, _, edits in mine)
                own = words(text)
                for _, first, end, edits in mine:
                    assert fewest_edits(" ".join(own[first:end]), other) <= edits + 2


def test_spans_are_places_of_words():
    text = "Zürich 日本: see the GNU-General\n Public (License), é; cc by, CC BY cc by"
    spans = found(text, BASE)
    assert spans == [(0, 4, 8, 0), (2, 9, 11, 0), (2, 11, 13, 0), (2, 13, 15, 0)]
    assert found("the gnu generel public licence", NOTICES[:1]) == [(0, 1, 5, 2)]


def test_exact_places_may_overlap():
    assert [s[1] for s in found("a a a a", [Notice("x", "a a")])] == [0, 1, 2]


def test_parts_cover_a_wording_once():
    for errors in range(6):
        cut = parts(" größe und weite ", errors)
        assert b"".join(p for _, p in cut).decode() == " größe und weite " and len(cut) == errors + 1


def test_a_notice_needs_more_characters_than_errors():
    with pytest.raises(ValueError):
        NoticeSearch([Notice("x", "ab", 9)])
    assert NoticeSearch([]).spans([b"a"]) == []


def test_many_notices_in_one_long_text():
    """Time grows with the notices: each is verified once."""
    text = "this is the gnu genral public license " * 20_000
    spans = found(text, NOTICES[:1])
    assert len(spans) == 20_000 and {s[3] for s in spans} == {1}
    assert [s[1] for s in spans[:3]] == [3, 10, 17]


def test_documents(spark, clashing, awkward_rows):
    rows = {r.doc_id: r for r in license_scan(clashing).collect() if r.doc_id not in (5, None)}
    for doc_id, text, _, _ in awkward_rows:
        if doc_id in rows:
            assert (rows[doc_id].n_words, rows[doc_id].spans, rows[doc_id].base) == (len(words(text)), [], [])
    assert license_spans(clashing).count() == len(awkward_rows)
    texts = ["Released under the MIT License.", "Relaesed under the MIT Licence", prose(1, 30_000) + " Apache License", "CC BY-NC 4.0. GNU General Public License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (sorted({s.label for s in r.base}), sorted({s.label for s in r.spans})) for r in license_scan(docs).collect()}
    assert got[0] == (["mit"], ["mit"])
    assert got[1] == ([], ["mit"])
    assert got[2] == (["apache"], ["apache"])
    assert got[3] == (["cc-by", "gpl"], ["cc-by", "gpl"])


def test_empty_table(empty):
    assert license_scan(empty).collect() == []


def test_query_equals_the_definition(spark, small_dir):
    from aliasmith.llm.queries import op12_license_scan

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = op12_license_scan(spark, small_dir).collect()
    assert len(rows) == len(docs)
    for row in rows:
        places = [(i, n.label) for n in BASE for i in exact(docs[row.doc_id], n)]
        fuzzy = {n.label for n in NOTICES if fewest_edits(docs[row.doc_id], n) <= n.errors} if places else set()
        starts, labels = [i for i, _ in places], {label for _, label in places}
        assert (row.n_words, row.n_base) == (len(words(docs[row.doc_id])), len(places))
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted(labels))
        if places:
            assert row.labels == ",".join(sorted(labels | fuzzy)) and row.score == 1.0
