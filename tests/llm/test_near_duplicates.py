import random
import re

import numpy as np
import pytest

from aliasmith.llm import near_duplicates as nd
from aliasmith.llm.graph import components
from aliasmith.llm.shingles import PART, jaccard, multipliers, shingle_sets, signature, word_hashes
from conftest_llm import CLASHING, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    found = WORD.findall((text or "").encode().lower())
    size = min(5, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1)) if size else frozenset()


def brute(rows):
    """Class, group and number of links by row number, over all pairs."""
    sets = [shingles(t) or (t or "") for _, t in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = a == b if isinstance(a, str) or isinstance(b, str) else len(a & b) >= 0.8 * len(a | b)
            if same:
                links[i].add(j)
                links[j].add(i)
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(rows))]

    def least(members):
        known = [rows[j][0] for j in members if rows[j][0] is not None]
        return min(known) if known else None

    return [
        (
            rows[i][0],
            least([j for j in range(len(rows)) if sets[j] == sets[i]]),
            least([j for j in range(len(rows)) if group[j] == group[i]]),
            len(links[i]),
        )
        for i in range(len(rows))
    ]


def changed(text, *places):
    found = text.split()
    for p in places:
        found[p] = f"other{p}"
    return " ".join(found)


def check(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    found = nd.near_duplicates(docs).select("doc_id", "class_id", "group_id", "n_links").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))


def test_copies_near_copies_and_chains(spark):
    base, rows = prose(1, 200), []
    rows += [(i, base) for i in range(5)]
    rows += [(10 + i, changed(base, 10 * i)) for i in range(15)]
    rows += [(40, changed(base, 5, 50, 100, 150)), (41, changed(base, 5, 50, 100, 150, 180)), (42, changed(base, 5, 50, 100, 150, 180, 195))]
    rows += [(50 + i, prose(50 + i, 60)) for i in range(20)]
    rows += [(80, base.upper()), (81, base.replace(" ", ", ")), (None, base)]
    rows += [(90, "a b c"), (91, "A, b, C"), (92, "a b c d"), (93, ""), (94, None), (95, "!!"), (96, "!!"), (97, "??")]
    check(spark, rows)


def test_a_large_group_is_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "LINK_BLOCK", 16)
    monkeypatch.setattr(nd, "BAND_BLOCK", 8)
    base = prose(2, 150)
    rows = [(i, changed(base, i, (7 * i) % 150, (31 * i) % 150)) for i in range(120)]
    rows += [(200 + i, changed(prose(3, 150), *range(i, i + 3))) for i in range(0, 60, 4)]
    check(spark, rows)


def test_a_dense_group_in_which_only_some_resemble_each_other(spark):
    rng = random.Random(6)
    base, rows = prose(4, 150), []
    for i in range(260):
        rows.append((i, changed(base, *rng.sample(range(150), rng.randint(1, 16)))))
    rows += [(500 + i, prose(600 + i, 40)) for i in range(10)]
    check(spark, rows)


def test_documents_that_share_a_passage_only(spark):
    passage = prose(900, 60)
    check(spark, [(i, prose(i, 50) + " " + passage + " " + prose(i + 300, 70)) for i in range(150)])


def test_one_document_of_each_group_stays_with_its_columns(clashing, awkward_rows):
    kept = nd.deduplicated(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert all(r[name] == f"own {name}" for r in rows for name in CLASHING)
    wanted = [(1, prose(1, 60)), (5, prose(5, 80)), (5, prose(6, 40)), (None, prose(7, 30))]
    assert all(sum((r.doc_id, r.text) == w for r in rows) == 1 for w in wanted)
    assert not any(r.doc_id == 11 for r in rows)
    different = {shingles(t) or (t or "") for _, t, _, _ in awkward_rows}
    assert len(rows) == len(different)


def test_awkward_documents(spark, awkward_rows):
    check(spark, [(i, t) for i, t, _, _ in awkward_rows])


def test_empty_table(empty):
    assert nd.near_duplicates(empty).collect() == []
    assert nd.deduplicated(empty).collect() == []


def test_pruning_keeps_what_can_reach_the_threshold():
    rng = np.random.default_rng(1)
    factors = multipliers(nd.SKETCH, seed=9)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for share, expected in ((0.9, True), (0.82, True), (0.1, False)):
        common = int(400 * share)
        other = np.concatenate([base[:common], rng.integers(0, 1 << 63, 400 - common, dtype=np.uint64)])
        sketch = [(signature(np.unique(s), factors) & 0xFFFF).astype("<u2")[None] for s in (base, other)]
        near = jaccard(np.unique(base), np.unique(other)) >= 0.5
        assert nd.likely(*sketch)[0] == (expected and near) or not near == expected


def test_fewest_matches_follows_the_posterior():
    from math import comb

    for step in (16, 32, 64):
        m = nd.fewest_matches(step, 0.8, 1e-6)
        chance = [sum(comb(step + 1, i) * 0.8**i * 0.2 ** (step + 1 - i) for i in range(k + 1)) for k in range(step + 1)]
        assert chance[m] >= 1e-6 and (m == 0 or chance[m - 1] < 1e-6)


def test_words_are_hashed_alike_wherever_they_stand():
    texts = [b"one two THREE", b"three", b"", b"x" * 50 + b" one", ("é " * 3).encode(), b"w " * (PART // 2 + 100) + b"one"]
    found = word_hashes(texts)
    assert [len(f) for f in found] == [3, 1, 0, 2, 3, PART // 2 + 101]
    assert found[0][2] == found[1][0] and found[0][0] == found[3][1] == found[5][-1]
    assert len(shingle_sets([b"a b c", b"a b c d e f g"])[0]) == 1


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3)], [(i, i + 1) for i in range(0, 40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, links):
    found = {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    label = {n: n for pair in links for n in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label
