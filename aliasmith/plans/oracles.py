"""The registered queries as plain DuckDB SQL, without the operators' shortcuts."""

from __future__ import annotations

from aliasmith.operators.stopwords import SHORT_WORDS
from aliasmith.plans.queries import ASKED, FALSE_PAIRS, SAMPLE_SIZE, SEED, STOPWORDS, TRUE_PAIR_SIMILARITY
from aliasmith.plans.tables import LONG_FORM, LOW_QUALITY, PAGE_LANGUAGE

# Places of random pairs that the SQL looks at.
PLACES = 400_000
MENTION = r"[a-z]+, ?[a-z]+|\| [a-z]+"


def clean(x: str) -> str:
    return rf"replace(regexp_replace(lower(strip_accents({x})), '[^\x00-\x7F]', '', 'g'), '-', '')"


def strip(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g')"


def grams(x: str) -> str:
    """2- and 3-gram set of an already stripped text."""
    return (
        f"CASE WHEN len({x}) < 2 THEN ['#' || {x}] ELSE list_distinct(list_concat("
        f"list_transform(range(1, len({x})), lambda i: substr({x}, i, 2)), "
        f"list_transform(range(1, len({x}) - 1), lambda i: substr({x}, i, 3)))) END"
    )


def dice(a: str, b: str) -> str:
    return f"(2e0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})))"


def draw(key: str, seed: object = SEED) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 15))::BIGINT"


def last(x: str) -> str:
    return f"string_split({x}, ',')[1]"


def first(x: str) -> str:
    return f"string_split({x}, ',')[2]"


def found(x: str) -> str:
    return (
        f"list_transform(regexp_extract_all({clean(x)}, '{MENTION}'), "
        "lambda m: replace(replace(m, ', ', ','), '| ', ''))"
    )


def _listed(keep: str) -> str:
    return f"coalesce(array_to_string(list_filter(found[2:], lambda a: {keep}), ';'), '')"


_LOW = f"regexp_matches(a, '{LOW_QUALITY}')"
_LONG = f"len(a) >= {LONG_FORM}"

WATCH = f"""
mentions AS (
  SELECT d.doc_id, d.lang, l.quality, {found('d.text')} AS found
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
watch AS (
  SELECT CAST(doc_id AS VARCHAR) AS uid, found[1] AS name, lang AS citizenship,
    CASE quality WHEN 1 THEN 'i' WHEN 0 THEN 'e' END AS person_type,
    {_listed(f'NOT {_LOW} AND NOT {_LONG}')} AS aliases,
    {_listed(_LOW)} AS low_quality_aliases,
    {_listed(f'NOT {_LOW} AND {_LONG}')} AS alternative_spelling
  FROM mentions)"""

NAMES = f"""{WATCH},
exploded AS (
  {' UNION ALL '.join(
      f"SELECT uid, citizenship, person_type, '{c}' AS kind, unnest(string_split({c}, ';')) AS name FROM watch"
      for c in ('name', 'aliases', 'low_quality_aliases', 'alternative_spelling'))}),
valid AS (
  SELECT * FROM exploded
  WHERE name IS NOT NULL AND name <> 'null' AND name <> '' AND regexp_matches(name, ',[^,]'))"""

INCOMING = f"""
incoming AS (
  SELECT name, citizenship FROM (
    SELECT regexp_extract(url, '{PAGE_LANGUAGE}', 1) AS citizenship, unnest({found('html')}) AS name FROM pages)
  WHERE name <> '' AND regexp_matches(name, ',[^,]'))"""

PAIRS = f"""
listed AS (
  SELECT list_filter({found('text')}, lambda m: contains(m, ',')) AS names FROM documents),
pairs AS (
  SELECT DISTINCT names[i] AS string1, names[i + 1] AS string2
  FROM (SELECT names, unnest(range(1, len(names))) AS i FROM listed))"""

HELD = f"""{NAMES},
held AS (SELECT DISTINCT uid, name FROM valid),
gram AS (SELECT name, {grams('s')} AS g FROM (SELECT DISTINCT name, {strip('name')} AS s FROM held))"""

TRUE_PAIRS = f"""
true_pairs AS (
  SELECT DISTINCT a.name AS string1, b.name AS string2, {dice('ga.g', 'gb.g')} AS similarity
  FROM held a JOIN held b ON a.uid = b.uid AND a.name < b.name
  JOIN gram ga ON ga.name = a.name JOIN gram gb ON gb.name = b.name
  WHERE {dice('ga.g', 'gb.g')} >= {TRUE_PAIR_SIMILARITY}e0)"""

# The first places, far more than needed, and all names as anchors: a band holds the pairs of its
# earliest turns, so more turns than the operator makes change nothing.
FALSE_PAIRS_SQL = f"""
owned AS (SELECT name, min(uid) AS low, max(uid) AS high FROM held GROUP BY name),
numbered AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS row FROM owned),
extent AS (SELECT count(*)::BIGINT AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs FROM owned),
network AS (
  SELECT n, n_pairs, (SELECT min(h) FROM range(1, 31) t(h) WHERE (1::BIGINT << (2 * h)::INT) >= n_pairs)::INT AS half FROM extent),
mix0 AS (
  SELECT turn, n, n_pairs, half, (turn >> half)::BIGINT AS l, (turn & ((1::BIGINT << half) - 1))::BIGINT AS r
  FROM network, range(0, {PLACES}) t(turn) WHERE turn < (1::BIGINT << (2 * half))),
{','.join(f"""
mix{k + 1} AS (
  SELECT turn, n, n_pairs, half, r AS l, xor(l, ({draw('r', f'{SEED}mix{k}')}) & ((1::BIGINT << half) - 1)) AS r FROM mix{k})"""
  for k in range(4))},
pair_rows AS (
  SELECT turn, p % n AS row1, (p % n + p // n + 1) % n AS row2
  FROM (SELECT turn, n, n_pairs, (l << half) + r AS p FROM mix4) WHERE p < n_pairs),
drawn AS (
  SELECT least(a.name, b.name) AS string1, greatest(a.name, b.name) AS string2, turn
  FROM pair_rows JOIN numbered a ON a.row = row1 JOIN numbered b ON b.row = row2
  WHERE NOT (a.low = a.high AND b.low = b.high AND a.low = b.low)),
scored AS (
  SELECT string1, string2, {dice('ga.g', 'gb.g')} AS similarity, turn::BIGINT AS turn
  FROM drawn JOIN gram ga ON ga.name = string1 JOIN gram gb ON gb.name = string2
  WHERE {dice('ga.g', 'gb.g')} < 0.7e0),
single AS (SELECT name, len(g) AS n, unnest(g) AS gram FROM gram),
shared AS (
  SELECT a.name AS string1, b.name AS string2, 2e0 * count(*) / (any_value(a.n) + any_value(b.n)) AS similarity
  FROM single a JOIN single b ON a.gram = b.gram AND a.name <= b.name AND a.n <= b.n * 1.9 AND b.n <= a.n * 1.9
  GROUP BY 1, 2 HAVING 2e0 * count(*) / (any_value(a.n) + any_value(b.n)) >= 0.7e0),
similar_pairs AS (
  SELECT string1, string2, similarity, least({draw('string1')}, {draw('string2')}) AS turn
  FROM shared JOIN owned a ON a.name = string1 JOIN owned b ON b.name = string2
  WHERE NOT (a.low = a.high AND b.low = b.high AND a.low = b.low)),
banded AS (
  SELECT *, CASE WHEN similarity < 0.3e0 THEN 1 WHEN similarity < 0.7e0 THEN 2 ELSE 3 END AS band
  FROM (SELECT * FROM scored UNION ALL SELECT * FROM similar_pairs)),
false_pairs AS (
  SELECT string1, string2, similarity, band FROM banded
  QUALIFY row_number() OVER (PARTITION BY band
    ORDER BY turn, {draw("string1 || '|' || string2", f'{SEED}pair')}, string1, string2) <= {FALSE_PAIRS // 3})"""

LABELLED = f"""{HELD},{TRUE_PAIRS},{FALSE_PAIRS_SQL},
labelled AS (
  SELECT string1, string2, 1e0 AS label FROM true_pairs
  UNION ALL SELECT string1, string2, 0e0 FROM false_pairs)"""

_PAIR_KEY = "string1 || '|' || string2"


def _name_features(a: str, b: str) -> str:
    def gram_dice(part) -> str:
        return dice(grams(strip(part(a))), grams(strip(part(b))))

    def jaro(part) -> str:
        return f"jaro_winkler_similarity({part(a)}, {part(b)})"

    return (
        f"round(0.3e0 * {gram_dice(first)} + 0.7e0 * {gram_dice(last)}, 6) AS ngram, "
        f"round(0.3e0 * {jaro(first)} + 0.7e0 * {jaro(last)}, 6) AS jaro_winkler"
    )


def _features_of(source: str, columns: str) -> str:
    return f"SELECT {columns}, {_name_features('string1', 'string2')} FROM {source}"


MATCHES = f"""{NAMES},{INCOMING},
asked AS (SELECT DISTINCT name, citizenship, {last('name')} AS last, {first('name')} AS first FROM incoming),
offered AS (SELECT DISTINCT name, citizenship, {last('name')} AS last, {first('name')} AS first FROM valid),
words AS (
  SELECT DISTINCT word, {grams(strip('word'))} AS g FROM (
    SELECT unnest([last, first]) AS word FROM asked UNION SELECT unnest([last, first]) FROM offered)),
single AS (SELECT word, len(g) AS n, unnest(g) AS gram FROM words),
lasts AS (
  SELECT a.word AS last1, b.word AS last2, 2e0 * count(*) / (any_value(a.n) + any_value(b.n)) AS last_similarity
  FROM single a JOIN single b ON a.gram = b.gram
  WHERE a.word IN (SELECT last FROM asked) AND b.word IN (SELECT last FROM offered)
  GROUP BY 1, 2 HAVING 0.3e0 + 0.7e0 * (2e0 * count(*) / (any_value(a.n) + any_value(b.n))) >= 0.79e0),
matched AS (
  SELECT q.name AS string1, o.name AS string2, q.citizenship,
    0.3e0 * {dice('wq.g', 'wo.g')} + 0.7e0 * last_similarity AS similarity
  FROM asked q JOIN lasts ON last1 = q.last
  JOIN offered o ON o.last = last2 AND o.citizenship = q.citizenship
  JOIN words wq ON wq.word = q.first JOIN words wo ON wo.word = o.first
  WHERE 0.3e0 * {dice('wq.g', 'wo.g')} + 0.7e0 * last_similarity >= 0.8e0)
SELECT string1, string2, uid, citizenship, round(similarity, 6) AS similarity
FROM matched JOIN (SELECT DISTINCT uid, citizenship, name FROM valid) v
ON v.name = string2 AND v.citizenship = matched.citizenship"""
MATCHES = MATCHES.replace("SELECT string1, string2, uid, citizenship, round", "SELECT string1, string2, uid, matched.citizenship, round")

SCORED = """
scored AS (
  SELECT doc_id, quality::DOUBLE AS label, n_chars::DOUBLE AS score, (n_chars >= 1000)::INT::DOUBLE AS prediction
  FROM documents JOIN labels USING (doc_id))"""

_SOUNDEX_CODES = ("abcdefghijklmnopqrstuvwxyz", "01230127022455012623017202")


def soundex(word: str) -> str:
    letters, codes = _SOUNDEX_CODES
    text = f"translate({word}, '{letters}', '{codes}')"
    text = f"(substr({text}, 1, 1) || replace(substr({text}, 2), '7', ''))"
    for digit in "0123456":
        text = f"regexp_replace({text}, '{digit}+', '{digit}', 'g')"
    return f"upper(substr({word}, 1, 1)) || rpad(substr(replace(substr({text}, 2), '0', ''), 1, 3), 3, '0')"


def skip_grams(x: str) -> str:
    tokens = rf"list_filter(string_split_regex({clean(x)}, '\s+'), lambda t: t <> '')"
    return tokens, "list_distinct(list_concat({}))".format(
        ", ".join(
            f"list_transform(range(1, len(t) - {gap - 1}), lambda i: t[i] || ' ' || t[i + {gap}])" for gap in (1, 2, 3)
        )
    )


_TOKENS, _SKIP_GRAMS = skip_grams("text")

RETURNS = """
returns AS (
  SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount,
    l_tax::DOUBLE AS l_tax, (l_returnflag = 'R')::INT::DOUBLE AS label FROM lineitem)"""

_CUTS = " UNION ALL ".join(
    f"SELECT min(l_extendedprice) AS cut FROM ranked WHERE upto >= {i / 10}e0 * (SELECT count(*) FROM lineitem)"
    for i in range(1, 10)
)


def all_oracles() -> dict[str, str]:
    pair_score = f"WITH {PAIRS} SELECT string1, string2, round({{}}, 6) AS similarity FROM pairs"
    return {
        # Sources and sinks
        "read_delimited": f"WITH {WATCH} SELECT * FROM watch",
        "alias_lines": """
            SELECT doc_id, len(string_split(line, '|')) AS n_aliases,
              array_to_string(string_split(line, '|'), ';') AS aliases
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)""",
        "json_values": r"""SELECT CAST(regexp_extract(props, '"k": *(-?\d+)', 1) AS BIGINT) AS k FROM events""",
        "label_by_file_name": f"WITH {LABELLED} SELECT string1 || ' : ' || string2 AS value, label FROM labelled",
        # Projections and filters
        "flatten_struct": """
            SELECT event_id, user_id AS who_user_id, event_type AS who_kind_event_type, value AS what_value
            FROM events""",
        "cast_features": """
            SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey,
              c_acctbal::DOUBLE AS c_acctbal, TRY_CAST(c_mktsegment AS DOUBLE) AS c_mktsegment FROM customer""",
        "filter_category_in": f"WITH {WATCH} SELECT * FROM watch WHERE citizenship IN ('fr', 'de')",
        "filter_natural": f"WITH {WATCH} SELECT * EXCLUDE (person_type) FROM watch WHERE person_type <> 'e'",
        "drop_short_aliases": f"""WITH {WATCH}
            SELECT uid, name, citizenship, person_type, {', '.join(
                f"coalesce(array_to_string(list_filter(string_split({c}, ';'), lambda a: len(string_split(a, ',')) > 1),"
                f" ';'), '') AS {c}" for c in ('aliases', 'low_quality_aliases', 'alternative_spelling'))}
            FROM watch""",
        "explode_aliases": f"WITH {NAMES} SELECT * FROM exploded WHERE name IS NOT NULL",
        "valid_names": f"WITH {NAMES} SELECT * FROM valid",
        "multiword_aliases": f"""WITH {WATCH},
            sets AS (
              SELECT uid, list_transform(string_split(aliases, ';'),
                lambda a: CASE WHEN contains(a, ',') THEN {first('a')} || ' ' || {last('a')} ELSE a END) AS a
              FROM watch)
            SELECT uid, array_to_string(list_filter(a, lambda x: contains(x, ' ')), ';') AS aliases
            FROM sets WHERE len(list_filter(a, lambda x: contains(x, ' '))) > 0""",
        "similarity_band": f"""WITH {PAIRS},
            s AS (SELECT *, {dice(grams(strip('string1')), grams(strip('string2')))} AS d FROM pairs)
            SELECT string1, string2, CASE WHEN d < 0.3e0 THEN 1 WHEN d < 0.7e0 THEN 2 ELSE 3 END::BIGINT AS band
            FROM s""",
        # Blocking and pair generation
        "blocked_pairs": f"""WITH {NAMES},
            block AS (
              SELECT '{ASKED[0]}' AS string1, name AS string2, uid, person_type, citizenship
              FROM valid WHERE citizenship = '{ASKED[1]}')
            {_features_of('block', 'string1, string2, uid, person_type, citizenship')}""",
        "candidate_count": f"""WITH {NAMES},{INCOMING},
            q AS (SELECT citizenship, count(*) AS n_queries FROM (SELECT DISTINCT * FROM incoming) GROUP BY 1),
            c AS (SELECT citizenship, count(*) AS n_candidates FROM valid GROUP BY 1)
            SELECT citizenship, n_queries, n_candidates, n_queries * n_candidates AS n_pairs
            FROM q JOIN c USING (citizenship)""",
        "true_pairs": f"""WITH {HELD},{TRUE_PAIRS}
            SELECT string1, string2, round(similarity, 6) AS similarity FROM true_pairs""",
        "false_pairs_banded": f"""WITH {HELD},{FALSE_PAIRS_SQL}
            SELECT string1, string2, band::BIGINT AS band, round(similarity, 6) AS similarity FROM false_pairs""",
        "label_union": f"WITH {LABELLED} SELECT * FROM labelled",
        "balanced_pairs": f"""WITH {LABELLED}
            SELECT * FROM labelled
            QUALIFY row_number() OVER (PARTITION BY label ORDER BY {draw(_PAIR_KEY, f'{SEED}balance')}, string1, string2)
              <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label))""",
        "match_threshold": f"WITH {MATCHES}",
        "stream_match": f"WITH {MATCHES}",
        "stream_match_plain": f"WITH {MATCHES}",
        "stream_match_once": f"WITH {MATCHES}",
        "match_store": f"WITH {MATCHES}",
        "match_metrics": f"""
            SELECT (SELECT count(*) FROM (WITH {NAMES},{INCOMING} SELECT DISTINCT * FROM incoming)) AS n_asked,
              (SELECT count(*) FROM (WITH {MATCHES})) AS n_matches""",
        # Aggregates, orders, samples
        "token_frequency": """
            SELECT token, count(*) AS count FROM (
              SELECT unnest(string_split(lower(replace(text, ',', ' ')), ' ')) AS token FROM documents)
            WHERE token <> '' GROUP BY token""",
        "category_counts": "SELECT lang AS citizenship, count(*) AS count FROM documents GROUP BY lang",
        "remove_stopwords": f"""WITH
            cleaned AS (SELECT doc_id, {clean('text')} AS text FROM documents),
            stop AS (
              SELECT token FROM (SELECT unnest(string_split(lower(replace(text, ',', ' ')), ' ')) AS token FROM cleaned)
              WHERE token <> '' GROUP BY token ORDER BY count(*) DESC, token LIMIT {STOPWORDS}),
            words AS (SELECT list(token) AS w FROM (SELECT token FROM stop UNION SELECT unnest({list(SHORT_WORDS)})))
            SELECT doc_id, array_to_string(
              list_filter(string_split(text, ' '), lambda t: NOT list_contains(w, t)), ' ') AS text
            FROM cleaned, words""",
        "remove_stopword_table": f"""WITH
            words AS (
              SELECT DISTINCT token FROM (
                SELECT unnest(string_split(lower(replace(text, ',', ' ')), ' ')) AS token FROM benchmark) WHERE token <> ''
              UNION SELECT unnest({list(SHORT_WORDS)})),
            tokens AS (
              SELECT conv_id, turn, i, t[i] AS token FROM (
                SELECT conv_id, turn, string_split(text, ' ') AS t, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i
                FROM conversations)),
            kept AS (
              SELECT conv_id, turn, string_agg(token, ' ' ORDER BY i) AS text FROM tokens
              WHERE token NOT IN (SELECT token FROM words) GROUP BY conv_id, turn)
            SELECT c.conv_id, c.turn, CASE WHEN c.text IS NOT NULL THEN coalesce(k.text, '') END AS text
            FROM conversations c LEFT JOIN kept k ON k.conv_id = c.conv_id AND k.turn = c.turn""",
        "seeded_shuffle": f"WITH {PAIRS} SELECT *, {draw(_PAIR_KEY)} AS shuffle_key FROM pairs",
        "seeded_sample": f"""
            SELECT CAST(doc_id AS VARCHAR) AS uid, lang AS citizenship FROM documents
            ORDER BY {draw('CAST(doc_id AS VARCHAR)')}, CAST(doc_id AS VARCHAR) LIMIT {SAMPLE_SIZE}""",
        "hash_split": f"""WITH {PAIRS}
            SELECT *, CASE WHEN {draw(_PAIR_KEY, f'{SEED}split')} < floor(0.7e0 * 1152921504606846976)::BIGINT THEN 0 ELSE 1
            END::BIGINT AS split FROM pairs""",
        "hash_folds": f"WITH {PAIRS} SELECT *, {draw(_PAIR_KEY, f'{SEED}fold')} % 5 AS fold FROM pairs",
        # Scalar functions
        "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
        "clean_table": f"SELECT conv_id, turn, {clean('role')} AS role, {clean('text')} AS text FROM conversations",
        "strip_special": f"SELECT page_id, {strip('html')} AS html FROM pages",
        "name_parts": f"""WITH {NAMES}
            SELECT DISTINCT name, {last('name')} AS last, {first('name')} AS first FROM exploded
            WHERE name IS NOT NULL""",
        "parse_query_message": f"WITH {INCOMING} SELECT DISTINCT name, citizenship FROM incoming",
        "parse_label": """
            SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 1e0 ELSE 0e0 END AS label FROM labels""",
        # Similarities
        "ngram_similarity_pairs": pair_score.format(dice(grams(strip("string1")), grams(strip("string2")))),
        "jaro_winkler_pairs": pair_score.format("jaro_winkler_similarity(string1, string2)"),
        "ngram_alignment_pairs": f"""WITH RECURSIVE {PAIRS},
            steps AS (
              SELECT string1, string2, 0 AS i, list_transform(range(0, len(string2) + 1), lambda j: 0) AS best FROM pairs
              UNION ALL
              SELECT string1, string2, i + 1, list_transform(range(0, len(string2) + 1),
                lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(gained[1:j]) END)
              FROM (
                SELECT *, list_transform(range(1, len(string2) + 1), lambda j: greatest(best[j + 1], best[j]
                  + (substr(string1, i + 1, 1) = substr(string2, j, 1))::INT
                  + CASE WHEN i = 0 AND j = 1 THEN (substr(string1, 1, 1) = substr(string2, 1, 1))::INT
                    WHEN i = 0 OR j = 1 THEN 0
                    ELSE (substr(string1, i, 1) = substr(string2, j - 1, 1))::INT END)) AS gained
                FROM steps WHERE i < len(string1)))
            SELECT string1, string2, round(best[len(string2) + 1] / (2e0 * greatest(len(string1), len(string2))), 6) AS similarity
            FROM steps WHERE i = len(string1)""",
        "levenshtein_pairs": pair_score.format(
            "1e0 - levenshtein(string1, string2) / greatest(len(string1), len(string2))::DOUBLE"
        ),
        "fullname_similarity": pair_score.format(
            f"0.3e0 * {dice(grams(strip(first('string1'))), grams(strip(first('string2'))))}"
            f" + 0.7e0 * {dice(grams(strip(last('string1'))), grams(strip(last('string2'))))}"
        ),
        "vowel_consonant_diff": f"""WITH {PAIRS}
            SELECT string1, string2,
              abs(len(regexp_replace(string1, '[^aeiou]', '', 'g'))
                - len(regexp_replace(string2, '[^aeiou]', '', 'g'))) AS vowel_diff,
              abs(len(regexp_replace(string1, '[^a-z]|[aeiou]', '', 'g'))
                - len(regexp_replace(string2, '[^a-z]|[aeiou]', '', 'g'))) AS consonant_diff
            FROM pairs""",
        "code_length_diff": f"""WITH {PAIRS},
            texts AS (SELECT string1 AS t FROM pairs UNION SELECT string2 FROM pairs),
            symbols AS (SELECT t, unnest(string_split(t, '')) AS c FROM texts),
            shares AS (SELECT c, -log2(count(*)::DOUBLE / sum(count(*)) OVER ()) AS bits FROM symbols GROUP BY c),
            lengths AS (SELECT t, sum(bits) AS bits FROM symbols JOIN shares USING (c) GROUP BY t)
            SELECT string1, string2, round(abs(a.bits - b.bits), 6) AS code_length_diff
            FROM pairs JOIN lengths a ON a.t = string1 JOIN lengths b ON b.t = string2""",
        "skipgram_similarity": f"""WITH
            words AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations),
            turns AS (SELECT conv_id, turn, {_SKIP_GRAMS} AS g FROM words)
            SELECT a.conv_id, a.turn, round(CASE WHEN len(a.g) + len(b.g) = 0 THEN 1e0
              ELSE {dice('a.g', 'b.g')} END, 6) AS similarity
            FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
        "soundex_match": f"""WITH {PAIRS},
            coded AS (
              SELECT string1, string2, {soundex(last('string1'))} AS code1, {soundex(last('string2'))} AS code2
              FROM pairs)
            SELECT *, code1 = code2 AS matches FROM coded""",
        "pair_features_ngram_jaro": f"WITH {PAIRS} {_features_of('pairs', 'string1, string2')}",
        # Datasets
        "training_features": f"WITH {LABELLED} {_features_of('labelled', 'string1, string2, label')}",
        "assemble_features": f"""WITH {RETURNS}
            SELECT l_orderkey, l_linenumber, label, l_quantity AS feature0, l_discount AS feature1, l_tax AS feature2
            FROM returns""",
        "slice_features": f"""WITH {RETURNS}
            SELECT l_orderkey, l_linenumber, label, l_quantity AS feature0, l_tax AS feature1 FROM returns""",
        "quantile_bins": f"""WITH
            counted AS (SELECT l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1),
            ranked AS (SELECT l_extendedprice, sum(n) OVER (ORDER BY l_extendedprice) AS upto FROM counted),
            cuts AS (SELECT DISTINCT cut FROM ({_CUTS})),
            bounds AS (SELECT list(cut) AS c FROM cuts)
            SELECT l_orderkey, l_linenumber, l_extendedprice,
              len(list_filter(c, lambda x: x <= l_extendedprice))::DOUBLE AS bin
            FROM lineitem, bounds""",
        "bucketize": """
            SELECT l_orderkey, l_linenumber, l_quantity,
              CASE WHEN l_quantity < 10 THEN 0e0 WHEN l_quantity < 20 THEN 1e0 ELSE 2e0 END AS bin
            FROM lineitem WHERE l_quantity >= 0 AND l_quantity <= 45""",
        "sketch_bins": """
            SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS probability, n, true AS within
            FROM (SELECT count(l_extendedprice) AS n FROM lineitem)""",
        # Metrics
        "auc_hard_labels": f"""WITH {SCORED}
            SELECT round((avg((prediction = 1)::INT) FILTER (label = 1)
              + avg((prediction = 0)::INT) FILTER (label = 0)) / 2, 6) AS auc FROM scored""",
        "auc_scored": f"""WITH {SCORED},
            ranked AS (
              SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r
              FROM scored),
            sums AS (
              SELECT sum(r) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
              FROM ranked)
            SELECT round((s - p * (p + 1) / 2e0) / (p * n), 6) AS auc FROM sums""",
        "accuracy": f"WITH {SCORED} SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM scored",
        "confusion_matrix": f"WITH {SCORED} SELECT label, prediction, count(*) AS count FROM scored GROUP BY 1, 2",
        # Streams
        "stream_lines": f"WITH {INCOMING} SELECT DISTINCT name, citizenship FROM incoming",
        "stream_json_flat": """
            SELECT event_id, user_id AS who_user_id, event_type AS who_event_type, value AS what_value FROM events""",
        "queue_stream": """
            SELECT event_id, user_id AS who_user_id, event_type AS who_event_type, value AS what_value FROM events""",
        "queue_range": """
            SELECT event_id, user_id AS who_user_id, event_type AS who_event_type, value AS what_value FROM events
            WHERE event_id % 2 = 0""",
    }
