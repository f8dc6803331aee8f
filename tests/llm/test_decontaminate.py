import re

import pytest

from aliasmith.llm.decontaminate import contamination, decontaminated
from conftest_llm import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items):
    """Hit places and items, by looking for every window at every place."""
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        theirs = words(item)
        size = min(10, len(theirs))
        for w in {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else ():
            for p in range(len(own) - size + 1):
                if tuple(own[p : p + size]) == w:
                    hit.update(range(p, p + size))
                    found.add(str(item_id))
    return len(own), len(hit), sorted(found)


ITEMS = [
    (1, prose(1, 14)),
    (2, "Two WORDS"),
    (3, None),
    (4, ""),
    (5, "..."),
    (6, prose(1, 14)),
    (7, "again again again again again again again again again again again"),
    (8, "Größe élan"),
    (9, prose(999, 30)),
    (None, "nobody owns this"),
]
TEXTS = [
    prose(2, 20) + " " + prose(1, 14).upper() + "! " + prose(3, 20),
    prose(1, 9),
    "two,words",
    "x two words y two words",
    " ".join(["again"] * 40),
    " ".join(["again"] * 9),
    "GrÖße élan",
    "Größe ÉLAN größe élan",
    None,
    "",
    "!!!",
    prose(4, 10_000) + " " + prose(1, 14) + " " + prose(5, 10_000),
    "nobody owns this",
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_every_text_equals_the_brute_force(spark, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string")
    found = {r.doc_id: r for r in contamination(docs, items).collect()}
    for i, text in enumerate(TEXTS):
        n_words, n_hit, ids = brute(text, [item for item in ITEMS if item[0] is not None])
        got = found[i]
        assert (got.n_words, got.n_hit) == (n_words, n_hit if text != "nobody owns this" else 3)
        assert got.item_ids == ids


def test_awkward_documents_are_kept_or_dropped_whole(clashing, awkward_rows, spark):
    items = spark.createDataFrame([(1, prose(5, 15)), (2, prose(77, 15))], "item_id bigint, text string")
    kept = decontaminated(clashing, items)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert len(rows) == len(awkward_rows) - 2
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in awkward_rows if r[1] != prose(5, 80))
    assert contamination(clashing, items).count() == len(awkward_rows)


def test_empty_tables(spark, empty, items, awkward, awkward_rows):
    assert contamination(empty, items).collect() == []
    assert decontaminated(empty, items).collect() == []
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 and r.item_ids == [] for r in contamination(awkward, nothing).collect())
    assert decontaminated(awkward, nothing).count() == len(awkward_rows)


def test_a_hot_word_and_a_hot_window(spark):
    rows = [(i, f"common common {prose(i, 6)} " + (prose(500, 12) if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    items = spark.createDataFrame([(1, prose(500, 12)), (2, "common common")], "item_id bigint, text string")
    found = contamination(docs, items).collect()
    assert all(r.n_hit == (14 if r.doc_id % 3 == 0 else 2) for r in found)
    assert all(r.item_ids == (["1", "2"] if r.doc_id % 3 == 0 else ["2"]) for r in found)
