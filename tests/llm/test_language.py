import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from aliasmith.llm.charmodel import ORDER, Characters, Model, has_letter
from aliasmith.llm import language
from aliasmith.llm.language import UNDETERMINED, accepted, fit, gram_counts, identified, model_of, training_rows

SYLLABLES = {"aa": ["la", "mo", "ri", "sté", "vo"], "bb": ["krz", "ung", "sch", "ott", "enk"], "cc": ["wha", "ti", "hoo", "nga", "rei"]}


def sentence(language, rng, words=40):
    return " ".join("".join(rng.choices(SYLLABLES[language], k=rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = [(i, sentence(lang, rng), lang) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)


def plain(text):
    """Lower case, runs of other characters one space, three spaces before and one after the last letter."""
    out = "   "
    for c in text.lower() + " ":
        if c.isalpha():
            out += c
        elif out[-1].isalpha():
            out += " "
    return out


def counted(texts):
    counts = Counter()
    for text in texts:
        p = plain(text)
        counts.update(p[i - ORDER + 1 : i + 1] for i in range(ORDER - 1, len(p)))
    return counts


def kneser_ney(counts):
    """The chance of a character after a context, straight from the definition."""
    levels = [counts]
    for _ in range(ORDER - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    return levels


def chance(levels, discounts, floor, gram):
    if not gram:
        return floor
    level, d = levels[len(gram) - 1], discounts[len(gram) - 1]
    mine = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
    lower = chance(levels, discounts, floor, gram[1:])
    if not mine:
        return lower
    total = sum(mine.values())
    return max(level.get(gram, 0) - d, 0) / total + d * len(mine) / total * lower


def test_entropies_equal_the_definition():
    rng = random.Random(2)
    texts = {lang: [sentence(lang, rng, 12) for _ in range(4)] for lang in ("aa", "bb")}
    counts = {lang: counted(found) for lang, found in texts.items()}
    table = defaultdict(lambda: np.zeros(2))
    for k, lang in enumerate(("aa", "bb")):
        for gram, n in counts[lang].items():
            table[gram][k] = n
    model = Model.fit(["aa", "bb"], dict(table))
    symbols = {g[-1] for c in counts.values() for g in c}
    floor = 1 / (len(symbols) + 1)
    probes = [texts["aa"][0], texts["bb"][1][:30], "quite another 日本 text", "x", ""]
    sizes, entropies = model.entropies(probes)
    for k, lang in enumerate(("aa", "bb")):
        levels = kneser_ney(counts[lang])
        discounts = []
        for level in levels:
            once, twice = (sum(n == v for n in level.values()) for v in (1, 2))
            discounts.append(min(0.9, max(0.1, once / max(once + 2 * twice, 1))))
        for text, size, own in zip(probes, sizes, entropies[:, k], strict=True):
            p = plain(text)
            logs = [math.log(chance(levels, discounts, floor, p[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(p))]
            assert size == len(logs)
            assert own == pytest.approx(-sum(logs) / max(len(logs), 1), abs=1e-4)


def test_characters_do_not_depend_on_what_is_put_together():
    texts = ["Ab, c", "", "12 x", "日本!", "  "]
    together = Characters(texts)
    for number, text in enumerate(texts):
        codes = together.codes[together.part == number]
        assert "".join(map(chr, codes)) == plain(text)


def test_counts_are_those_of_all_texts(labelled):
    found = {(r.lang, r.gram): r.n for r in gram_counts(labelled).collect()}
    wanted = {}
    by_lang = defaultdict(list)
    for r in labelled.collect():
        by_lang[r.lang].append(r.text)
    for lang, texts in by_lang.items():
        wanted.update({(lang, g): n for g, n in counted(texts).items()})
    assert found == wanted


def test_held_out_accuracy(labelled):
    docs = labelled
    model = fit(training_rows(docs))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    seen = {r.doc_id for r in training_rows(docs).collect()}
    rows = [r for r in identified(docs, model).collect() if r.doc_id not in seen]
    assert len(rows) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert all(0.0 <= r.score <= 1.0 and not r.rejected for r in rows)


def test_noise_is_rejected_and_text_is_kept(spark, labelled):
    rng = random.Random(8)
    noise = "".join(rng.choices("qxjzwpfbgyäöüßñçœþðłżğ", k=400))
    docs = spark.createDataFrame([(1, noise), (2, sentence("aa", rng)), (3, "123 %%"), (4, None), (5, "")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in identified(docs, fit(labelled)).collect()}
    assert [found[i].rejected for i in range(1, 6)] == [True, False, True, True, True]
    assert [found[i].lang_pred for i in (3, 4, 5)] == [UNDETERMINED] * 3
    assert [found[i].score for i in (3, 4, 5)] == [0.0] * 3
    assert [r.doc_id for r in accepted(docs, fit(labelled)).collect()] == [2]


def test_awkward_documents_keep_their_columns(clashing, awkward_rows):
    model = fit(clashing)
    rows = identified(clashing, model).collect()
    assert len(rows) == len(awkward_rows)
    kept = accepted(clashing, model)
    assert kept.columns == clashing.columns
    lettered = [r for r in awkward_rows if r[1] and has_letter(r[1])]
    assert len([r for r in rows if r.lang_pred != UNDETERMINED]) == len(lettered)
    assert kept.count() <= len(lettered)


def test_empty_table(empty, awkward):
    model = fit(empty)
    assert identified(empty, model).collect() == []
    assert all(r.lang_pred == UNDETERMINED for r in identified(awkward, model).collect())


def test_stored_shards_equal_the_model_in_memory(labelled, monkeypatch):
    monkeypatch.setattr(language, "_SHARD_ROWS", 100)
    rows = labelled.collect()
    texts = {lang: [r.text for r in rows if r.lang == lang] for lang in SYLLABLES}
    table = defaultdict(lambda: np.zeros(len(texts)))
    for k, lang in enumerate(sorted(texts)):
        for gram, n in counted(texts[lang]).items():
            table[gram][k] = n
    wanted, found = Model.fit(sorted(texts), dict(table)), model_of(gram_counts(labelled))
    assert found.languages == wanted.languages and found.floor == wanted.floor
    assert len(found.shards) > 8 and sum(s.rows for s in found.shards) == len(wanted.shards[0].keys)
    probes = [rows[0].text, "quite another 日本 text", "x", "", rows[1].text + rows[2].text]
    for own, other in zip(wanted.entropies(probes), found.entropies(probes), strict=True):
        assert own == pytest.approx(other, abs=1e-9)


def test_a_rare_language_keeps_its_grams_beside_a_very_large_one(spark):
    rng = random.Random(6)
    large = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(20_000)) for _ in range(60)]
    rare = "".join(chr(0xAC00 + rng.randrange(200)) for _ in range(300))
    rows = [(i, text, "zz") for i, text in enumerate(large)] + [(1000, rare, "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8)
    model = fit(docs)
    assert model.model.languages == ["aa", "zz"]
    assert model.model.entropies([rare])[1][0, 0] < 5
    (row,) = identified(docs.where("doc_id = 1000"), model).collect()
    assert row.lang_pred == "aa" and not row.rejected


def test_limits_come_from_all_labelled_texts(spark):
    rng = random.Random(12)
    rows = [(i, sentence("aa", rng, 12), "aa") for i in range(9000)] + [(9001, sentence("bb", rng), "bb")]
    rows += [(9100 + i, "".join(rng.choices("qxjzwpfbgyäöüßñçœþðłżğ", k=400)), "aa") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8)
    model = fit(docs)
    assert np.isfinite(model.highest).all()
    own = model.model.entropies([text for _, text, lang in rows if lang == "aa"])[1][:, 0]
    wanted = np.sort(own)[math.ceil(0.95 * len(own)) - 1]
    assert wanted <= model.highest[0] <= wanted + 0.002
    fresh = [(20_000 + i, "".join(rng.choices("qxjzwpfbgyäöüßñçœþðłżğ", k=400)), None) for i in range(9)]
    found = identified(docs.unionAll(spark.createDataFrame(fresh, docs.schema)), model).collect()
    rejected = {r.doc_id for r in found if r.rejected}
    assert rejected >= {i for i, _, _ in fresh} and min(rejected) > 9001


def test_memory_of_scoring_stays_below_its_texts():
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 105, 2000))) for _ in range(1500)]
    model = Model.fit(["x", "y"], {gram: np.array([1.0, 2.0]) for gram in {texts[0][i : i + ORDER] for i in range(1000)}})
    model.entropies(texts[:2])
    tracemalloc.start()
    model.entropies(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
