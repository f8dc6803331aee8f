import re
from collections import defaultdict

import pytest

from aliasmith.llm.mixing import fill, mix_counts, mixed_documents, plan_mix
from conftest_llm import CLASHING, prose, values


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_hand(sizes, weights, cap=3.0):
    """Clamp and reshare until no target is above its cap."""
    total, clamped = sum(sizes.values()), {}
    while True:
        open_ = {s: w for s, w in weights.items() if s not in clamped}
        left = total - sum(clamped.values())
        shares = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s: cap * sizes[s] for s, t in shares.items() if t > cap * sizes[s] + 1e-9}
        if not over:
            return {**clamped, **shares}
        clamped.update(over)


def sources_and_weights(rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += size_of(text)
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    return sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}


def test_awkward_rows_get_the_targets_of_the_definition(awkward, awkward_rows):
    sizes, weights = sources_and_weights(awkward_rows)
    wanted = targets_by_hand(sizes, weights)
    found = mix_counts(plan_mix(awkward)).collect()
    assert len(found) == len(awkward_rows)
    by_total = {float(sizes[s]): t for s, t in wanted.items()}
    for row in found:
        assert row.target == pytest.approx(by_total[row.source_size])
        assert 0 <= row.taken <= 3 * row.size


def test_taken_words_come_near_the_target(spark):
    rows = [(i, prose(i, 20 + 13 * (i % 17)), "en", f"s{i % 5}" if i % 2 else "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(7)
    found = mix_counts(plan_mix(docs)).collect()
    taken, target = defaultdict(int), {}
    for row in found:
        taken[row.source_size] += row.taken
        target[row.source_size] = row.target
    for source, words in target.items():
        assert abs(taken[source] - words) <= 10
    again = mix_counts(plan_mix(docs.repartition(3))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_filling_clamps_in_several_rounds(spark):
    rows = [("a", 5.0, 10), ("b", 2.0, 20), ("c", 1.0, 400), ("d", 5.0, 0)]
    found = {r._source: r._target for r in fill(spark.createDataFrame(rows, "_source string, _weight double, _total bigint")).collect()}
    assert found == pytest.approx({"a": 30.0, "b": 60.0, "c": 340.0, "d": 0.0})


def test_documents_are_repeated_as_counted_and_keep_their_columns(clashing):
    plan = plan_mix(clashing)
    rows = mixed_documents(clashing, plan)
    assert rows.columns == clashing.columns
    counted = sum(r.taken for r in mix_counts(plan).collect())
    found = rows.collect()
    assert sum(size_of(r.text) for r in found) == counted
    assert all(r[name] == f"own {name}" for r in found for name in CLASHING)


def test_empty_table(empty):
    assert mix_counts(plan_mix(empty)).collect() == []
    assert mixed_documents(empty, plan_mix(empty)).collect() == []


def test_weights_may_be_a_table(spark, awkward):
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "_source string, _weight double")
    found = values(mix_counts(plan_mix(awkward, weights=weights)), "source_size", "target")
    assert sum(t > 0 for _, t in set(found)) == 1
