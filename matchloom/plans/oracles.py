"""DuckDB SQL with the rows of the registered queries, in common table expressions."""

from __future__ import annotations

import re

from ..functions import vocab
from . import fixtures


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(words: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in words.items()) + "}"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _replaced(c: str, symbols, blanks: str) -> str:
    for old, new in symbols:
        c = f"replace({c}, {_q(old)}, {_q(new)})"
    return f"translate({c}, {_q(blanks)}, {_q(' ' * len(blanks))})"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(trim({c}), '\\s+'), lambda t: t <> '')"


_POSTAL = " ".join(f"WHEN country = '{n}' AND regexp_matches(a, {_q(p[4:])}) THEN regexp_extract(a, {_q(p[4:])}, 1)" for n, p in vocab.POSTAL.items())
_LAST = "regexp_replace(parts[-1], '\\b\\d{5,6}\\b', '', 'g')"
_HOUSE = vocab.HOUSE.replace("(?iU)", "(?i)")

#: Expressions by name; each may use those before it.
CTES = {
    "base": fixtures.BASE,
    **{n.lower(): q for n, q in fixtures.SOURCES.items()},
    "truth": f"SELECT s1_id, list_filter([m2, m3], lambda x: x <> '') AS matches FROM ({fixtures.TRUTH})",
    "raw": "SELECT 'S1' AS source, * FROM s1 UNION ALL SELECT 'S2', * FROM s2 UNION ALL SELECT 'S3', * FROM s3",
    "n1": f"""SELECT entity_id, seq, source, lower(trim(country)) AS country, business_name AS original_name, business_address AS a,
  flatten(list_transform({_words(_replaced("lower(strip_accents(business_name))", vocab.NAME_SYMBOLS, vocab.NAME_BLANKS))}, lambda t: string_split(coalesce({_map(vocab.NAME_WORDS)}[t], t), ' '))) AS name_tokens,
  list_transform({_words("regexp_replace(regexp_replace(" + _replaced("lower(strip_accents(business_address))", vocab.ADDRESS_SYMBOLS, vocab.ADDRESS_BLANKS) + ", '\\.([^0-9])', ' \\1', 'g'), '\\.$', ' ')")}, lambda t: coalesce({_map(vocab.ADDRESS_WORDS)}[rtrim(t, '.,')], t)) AS at0,
  list_filter(list_transform(string_split(business_address, ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM raw""",
    "n2": f"""SELECT *, CASE WHEN country = '' THEN 'unknown' ELSE country END AS part, array_to_string(name_tokens, ' ') AS name, array_to_string(list_filter(name_tokens, lambda t: NOT list_contains({_list(vocab.COMPACT_DROPS)}, t)), '') AS compact_name,
  array_to_string(at0, ' ') AS address, CASE {_POSTAL} ELSE regexp_extract(a, {_q(vocab.POSTAL_ANY[4:])}, 1) END AS postal_code, trim(regexp_extract(a, {_q(_HOUSE)}, 1)) AS h0,
  trim(regexp_extract(a, {_q(vocab.LANDMARK.replace("(?iU)", "(?i)"))}, 1)) AS landmark, regexp_extract(parts[-1], '\\b([A-Z]{{2}})\\b', 1) AS st, trim({_LAST}) AS last_bare, trim(regexp_replace(coalesce(parts[-2], ''), '\\b\\d{{5,6}}\\b', '', 'g')) AS before,
  trim(regexp_replace(parts[-1], '\\b[A-Z]{{2}}\\b', '', 'g')) AS beside FROM n1""",
    "rec": f"""SELECT entity_id, seq, source, country, part, original_name, name, compact_name, address, postal_code, landmark, name_tokens, {_words("address")} AS address_tokens,
  list_filter({_words("name || ' ' || address")}, lambda t: regexp_matches(t, '\\d')) AS numeric_tokens, CASE WHEN regexp_matches(h0, '^\\d{{5,}}$') THEN '' ELSE h0 END AS house_number,
  lower(CASE WHEN len(parts) < 1 THEN '' WHEN len(parts) = 1 THEN last_bare WHEN st <> '' THEN CASE WHEN beside <> '' THEN beside ELSE before END WHEN last_bare = '' THEN '' WHEN len({_words("last_bare")}) <= 2 THEN before ELSE last_bare END) AS city,
  lower(CASE WHEN len(parts) < 2 THEN '' WHEN st <> '' THEN st WHEN last_bare <> '' AND len({_words("last_bare")}) <= 2 THEN last_bare ELSE '' END) AS state FROM n2""",
    # exact keys
    "keys": f"""SELECT entity_id, source, seq, part, 'country_postal' AS idx, country || '|' || postal_code AS key, 0 AS pos FROM rec WHERE country <> '' AND postal_code <> ''
  UNION ALL SELECT entity_id, source, seq, part, 'country_tokens', country || '|' || name_tokens[1] || CASE WHEN len(name_tokens) >= 2 THEN '|' || name_tokens[2] ELSE '' END, 0 FROM rec WHERE country <> '' AND len(name_tokens) > 0
  UNION ALL SELECT entity_id, source, seq, part, 'country_compact', country || '|' || substr(compact_name, 1, 5), 0 FROM rec WHERE country <> '' AND length(compact_name) >= 5
  UNION ALL SELECT entity_id, source, seq, part, 'country_num_tok', country || '|' || numeric_tokens[1] || '|' || name_tokens[1], 0 FROM rec WHERE country <> '' AND len(numeric_tokens) > 0 AND len(name_tokens) > 0
  UNION ALL SELECT entity_id, source, seq, part, 'postal_name', postal_code || '|' || name_tokens[1], 0 FROM rec WHERE postal_code <> '' AND len(name_tokens) > 0
  UNION ALL SELECT entity_id, source, seq, part, 'country_distinctive', country || '|' || t, pos FROM (SELECT *, unnest(name_tokens) AS t, generate_subscripts(name_tokens, 1) AS pos FROM rec) WHERE country <> '' AND length(t) >= 4 AND NOT list_contains({_list(vocab.COMMON_WORDS)}, t)""",
    "weights": "SELECT * FROM (VALUES ('country_postal', 3.0, 25), ('country_tokens', 2.5, 20), ('country_compact', 2.0, 20), ('country_num_tok', 2.5, 20), ('country_distinctive', 1.5, 15), ('postal_name', 2.0, 15)) AS w(idx, weight, reads)",
    "postings": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, idx, key ORDER BY seq, pos) AS place FROM keys WHERE source <> 'S1') WHERE place <= 25",
    "hits": "SELECT q.entity_id AS s1_id, p.entity_id AS candidate_id, idx, CAST(weight AS DOUBLE) AS weight FROM keys q JOIN postings p USING (part, idx, key) JOIN weights USING (idx) WHERE q.source = 'S1' AND place <= reads",
    # BM25
    "btf": "SELECT part, entity_id, token, count(*) AS tf FROM (SELECT part, entity_id, unnest(list_concat(name_tokens, address_tokens)) AS token FROM rec WHERE source <> 'S1') GROUP BY ALL",
    "bn": "SELECT part, count(*) AS docs FROM rec WHERE source <> 'S1' GROUP BY part",
    "bdf": "SELECT *, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT part, token, count(*) AS df FROM btf GROUP BY part, token) JOIN bn USING (part) WHERE docs <= 100 OR (df >= 2 AND df <= floor(0.40 * docs))",
    "bx": "SELECT btf.part, entity_id, btf.token, tf, idf, sum(tf) OVER (PARTITION BY btf.part, entity_id) AS dl FROM btf JOIN bdf USING (part, token)",
    "bavg": "SELECT part, avg(dl) AS avgdl FROM (SELECT DISTINCT part, entity_id, dl FROM bx) GROUP BY part",
    "bw": "SELECT bx.part, entity_id, token, idf * least(tf, 63) * 2.5 / (least(tf, 63) + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM bx JOIN bavg USING (part) WHERE idf > 0.05",
    "bm25_scores": "SELECT s1_id, entity_id AS candidate_id, sum(w) AS score FROM (SELECT DISTINCT part, entity_id AS s1_id, unnest(list_concat(name_tokens, address_tokens)) AS token FROM rec WHERE source = 'S1') JOIN bw USING (part, token) GROUP BY s1_id, entity_id HAVING sum(w) > 0",
    # rarity
    "idf": "SELECT token, df, ln(n / (1 + df)) AS idf FROM (SELECT token, count(*) AS df FROM (SELECT DISTINCT entity_id, unnest(list_concat(name_tokens, address_tokens)) AS token FROM rec WHERE source <> 'S1') GROUP BY token), (SELECT greatest(count(*), 1) AS n FROM rec WHERE source <> 'S1')",
    "middle": "SELECT median(idf) AS m FROM idf",
}


def _terms(prefix: str, field: str, words: bool, max_df: float) -> dict[str, str]:
    if words:
        own = f"SELECT part, entity_id, source, list_filter(regexp_extract_all({field}, '[0-9A-Za-z_]+'), lambda w: length(w) >= 2) AS w FROM rec"
        rows = "SELECT part, entity_id, source, unnest(w) AS term FROM {0}w UNION ALL SELECT part, entity_id, source, w[i] || ' ' || w[i + 1] FROM {0}w, unnest(range(1, len(w))) AS t(i)".format(prefix)
    else:
        own = f"SELECT part, entity_id, source, ' ' || unnest(string_split({field}, ' ')) || ' ' AS p FROM rec WHERE {field} <> ''"
        rows = "SELECT part, entity_id, source, substr(p, i, n) AS term FROM {0}w, (VALUES (3), (4)) AS g(n), unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) AS t(i) WHERE n = 3 OR length(p) > 3".format(prefix)
    w = prefix
    out = {
        f"{w}w": own,
        f"{w}tf": f"SELECT part, entity_id, source, term, count(*) AS tf FROM ({rows}) GROUP BY ALL",
        f"{w}idf": f"SELECT part, term, ln((1.0 + docs) / (1 + df)) + 1 AS idf FROM (SELECT part, term, count(*) AS df, sum(tf) AS total FROM {w}tf WHERE source <> 'S1' GROUP BY part, term) JOIN bn USING (part) WHERE df >= 2 AND df <= {max_df} * docs QUALIFY row_number() OVER (PARTITION BY part ORDER BY total DESC, term) <= 25000",
        f"{w}v": f"SELECT part, entity_id, source, term, idf, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) * ((1 + ln(tf)) * idf)) OVER (PARTITION BY part, entity_id)) AS w FROM {w}tf JOIN {w}idf USING (part, term)",
        f"{w}q": f"SELECT * FROM {w}v WHERE source = 'S1'" + ("" if words else " QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY idf DESC, term) <= 8"),
        f"{w}_scores": f"SELECT q.entity_id AS s1_id, c.entity_id AS candidate_id, sum(q.w * c.w) AS score FROM {w}q q JOIN {w}v c USING (part, term) WHERE c.source <> 'S1' GROUP BY 1, 2 HAVING sum(q.w * c.w) > 0.05",
    }
    return out


CTES |= _terms("char_tfidf", "name", False, 0.25) | _terms("word_tfidf", "name", True, 0.5) | _terms("address_tfidf", "address", False, 0.25)


def top(scores: str, k: int, score: str = "score") -> str:
    return f"SELECT s1_id, candidate_id, {score}, row_number() OVER (PARTITION BY s1_id ORDER BY round({score}, 9) DESC, candidate_id) AS rank FROM {scores} QUALIFY rank <= {k}"


CTES["exact_scores"] = "SELECT s1_id, candidate_id, sum(weight) AS score FROM hits GROUP BY 1, 2"
_LIMITS = {"exact": 40, "char_tfidf": 20, "word_tfidf": 15, "address_tfidf": 15, "bm25": 30}
for _c, _k in _LIMITS.items():
    CTES[f"{_c}_top"] = top(f"{_c}_scores", _k)
_RANKED = [c for c in _LIMITS if c != "exact"]
CTES["found"] = " UNION ALL ".join(f"SELECT '{c}' AS channel, s1_id, candidate_id, rank, score FROM {c}_top" for c in _LIMITS)
CTES["pairs0"] = (
    "SELECT s1_id, candidate_id, CAST(max(CASE WHEN channel = 'exact' THEN 1 ELSE 0 END) AS INT) AS exact_found, "
    + ", ".join(f"coalesce(max(CASE WHEN channel = '{c}' THEN rank END), 0) AS {c}_rank, coalesce(max(CASE WHEN channel = '{c}' THEN score END), 0.0) AS {c}_score" for c in _RANKED)
    + " FROM found GROUP BY 1, 2"
)
CTES["pairs1"] = "SELECT *, CAST(exact_found + " + " + ".join(f"CASE WHEN {c}_rank > 0 THEN 1 ELSE 0 END" for c in _RANKED) + " AS INT) AS votes, CASE WHEN starts_with(candidate_id, 'S2') THEN 'S2' ELSE 'S3' END AS candidate_source FROM pairs0"
CTES["pairs2"] = "SELECT p.*, (CASE WHEN exact_found = 1 THEN 2.0 / 60 ELSE 0 END + " + " + ".join(f"CASE WHEN {c}_rank > 0 THEN 1.0 / (60 + {c}_rank) ELSE 0 END" for c in _RANKED) + ") * CASE WHEN votes >= 2 THEN 1.25 ELSE 1 END AS rrf_score FROM pairs1 p JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = candidate_id WHERE a.country = '' OR b.country = '' OR a.country = b.country"
CTES["quota"] = "SELECT * FROM pairs2 QUALIFY row_number() OVER (PARTITION BY s1_id, candidate_source ORDER BY round(rrf_score, 9) DESC, candidate_id) <= 20"
CTES["kept"] = "SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(rrf_score, 9) DESC, candidate_id) AS rank FROM quota QUALIFY rank <= 40"
CTES["sided"] = "SELECT p.*, " + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in ("original_name", "name", "compact_name", "address", "name_tokens", "address_tokens", "numeric_tokens", "country", "postal_code", "house_number", "city", "state", "landmark", "source")) + " FROM kept p JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = candidate_id"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


def _both(c: str) -> str:
    return f"CASE WHEN a_{c} <> '' AND b_{c} <> '' THEN 1.0 ELSE 0.0 END"


def _same(c: str) -> str:
    return f"CASE WHEN a_{c} = b_{c} AND a_{c} <> '' THEN 1.0 ELSE 0.0 END"


def _len(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(length({a}), length({b})) END"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


def _prefix(a: str, b: str) -> str:
    n = f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i)))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE CAST({n} AS DOUBLE) / greatest(length({a}), length({b})) END"


def _inter(f: str) -> str:
    return f"len(list_intersect(list_distinct(a_{f}), list_distinct(b_{f})))"


def _union(f: str) -> str:
    return f"len(list_distinct(list_concat(a_{f}, b_{f})))"


def _set(f: str, side: str = "a") -> str:
    return f"len(list_distinct({side}_{f}))"


def jaro_winkler(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 ELSE jaro_winkler_similarity({a}, {b}) END"


_ORDERED = "array_to_string(list_sort(a_name_tokens), ' ')", "array_to_string(list_sort(b_name_tokens), ' ')"
_LM = "list_filter(string_split_regex(lower({0}_landmark), '\\s+'), lambda t: t <> '')"
LEXICAL = {
    "name_exact": _same("original_name"), "name_normalized_exact": _same("name"), "compact_name_exact": _same("compact_name"), "name_sorted_exact": f"CASE WHEN {_ORDERED[0]} = {_ORDERED[1]} AND {_ORDERED[0]} <> '' THEN 1.0 ELSE 0.0 END",
    "name_jaccard": _ratio(_inter("name_tokens"), _union("name_tokens")), "name_token_overlap": _ratio(_inter("name_tokens"), f"least({_set('name_tokens')}, {_set('name_tokens', 'b')})"), "name_token_containment": _ratio(_inter("name_tokens"), _set("name_tokens")),
    "name_common_token_count": f"CAST({_inter('name_tokens')} AS DOUBLE)", "name_levenshtein": _lev("a_name", "b_name"), "name_length_ratio": _len("a_name", "b_name"), "name_prefix_match": _prefix("a_name", "b_name"), "name_jaro_winkler": jaro_winkler("a_name", "b_name"),
    "address_jaccard": _ratio(_inter("address_tokens"), _union("address_tokens")), "address_token_overlap": _ratio(_inter("address_tokens"), f"least({_set('address_tokens')}, {_set('address_tokens', 'b')})"),
    "address_levenshtein": _lev("a_address", "b_address"), "address_length_ratio": _len("a_address", "b_address"), "numeric_overlap": _ratio(_inter("numeric_tokens"), _union("numeric_tokens")),
}
STRUCTURAL = {
    **{f"{n}_present_both": _both(f) for n, f in (("postal", "postal_code"), ("house_number", "house_number"), ("city", "city"), ("state", "state"))}, **{f"{n}_exact": _same(f) for n, f in (("country", "country"), ("postal", "postal_code"), ("house_number", "house_number"), ("city", "city"), ("state", "state"))},
    "postal_prefix_match": _prefix("a_postal_code", "b_postal_code"), "both_name_present": _both("name"), "both_address_present": _both("address"), "name_len_ratio": _len("a_name", "b_name"), "address_len_ratio": _len("a_address", "b_address"),
    "numeric_count_diff": "CAST(abs(len(a_numeric_tokens) - len(b_numeric_tokens)) AS DOUBLE)", "candidate_is_s2": "CASE WHEN b_source = 'S2' THEN 1.0 ELSE 0.0 END", "candidate_is_s3": "CASE WHEN b_source = 'S3' THEN 1.0 ELSE 0.0 END",
    "landmark_overlap": f"CASE WHEN a_landmark <> '' AND b_landmark <> '' THEN {_ratio('len(list_intersect(list_distinct(' + _LM.format('a') + '), list_distinct(' + _LM.format('b') + ')))', 'len(list_distinct(list_concat(' + _LM.format('a') + ', ' + _LM.format('b') + ')))')} ELSE 0.0 END",
}
RETRIEVAL = {
    "found_exact": "CAST(exact_found AS DOUBLE)", **{f"found_{c}": f"CASE WHEN {c}_rank > 0 THEN 1.0 ELSE 0.0 END" for c in _RANKED}, **{f"{c}_score": f"{c}_score" for c in _RANKED}, **{f"{c}_rank": f"CAST({c}_rank AS DOUBLE)" for c in _RANKED},
    "retrieval_votes": "CAST(votes AS DOUBLE)", "rrf_score": "rrf_score", "is_multi_channel": "CASE WHEN votes >= 2 THEN 1.0 ELSE 0.0 END",
    "best_rank": "coalesce(CAST(list_min(list_filter([" + ", ".join(f"{c}_rank" for c in _RANKED) + "], lambda r: r > 0)) AS DOUBLE), 0.0)", "mean_rank": "coalesce(list_avg(list_filter([" + ", ".join(f"{c}_rank" for c in _RANKED) + "], lambda r: r > 0)), 0.0)",
}
CTES["shared"] = """SELECT s1_id, candidate_id, 'n' AS f, unnest(list_intersect(list_distinct(a_name_tokens), list_distinct(b_name_tokens))) AS token FROM sided UNION ALL SELECT s1_id, candidate_id, 'a', unnest(list_intersect(list_distinct(a_address_tokens), list_distinct(b_address_tokens))) FROM sided UNION ALL SELECT s1_id, candidate_id, 'p', a_postal_code FROM sided WHERE a_postal_code <> ''"""
CTES["rare"] = """SELECT s1_id, candidate_id, coalesce(max(CASE WHEN f = 'n' THEN i END), 0.0) AS name_max_shared_idf, coalesce(avg(CASE WHEN f = 'n' THEN i END), 0.0) AS name_mean_shared_idf, coalesce(sum(CASE WHEN f = 'n' THEN i END), 0.0) AS name_sum_shared_idf,
  CAST(count(*) FILTER (f = 'n' AND i > m) AS DOUBLE) AS name_rare_token_overlap, CAST(count(*) FILTER (f = 'a' AND i > m) AS DOUBLE) AS address_rare_token_overlap, coalesce(max(CASE WHEN f = 'a' THEN i END), 0.0) AS address_max_shared_idf, coalesce(max(CASE WHEN f = 'p' THEN i END), 0.0) AS postal_rarity
  FROM (SELECT shared.*, coalesce(idf, m) AS i, m FROM shared LEFT JOIN idf USING (token), middle) GROUP BY 1, 2"""
RARITY = ("address_max_shared_idf", "address_rare_token_overlap", "name_max_shared_idf", "name_mean_shared_idf", "name_rare_token_overlap", "name_sum_shared_idf", "postal_rarity")
F05 = "CASE WHEN actual = 0 AND predicted = 0 THEN 1.0 WHEN actual = 0 OR predicted = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * tp / (predicted + 0.25 * actual) END"
CTES["scored"] = "SELECT s1_id, candidate_id, rank, least(1.0, round(rrf_score * 8, 6)) AS score FROM kept"
CTES["entity"] = f"SELECT s1_id, tp, predicted, actual, {F05} AS f05 FROM (SELECT s1_id, CAST(len(list_intersect(got, matches)) AS INT) AS tp, CAST(len(got) AS INT) AS predicted, CAST(len(matches) AS INT) AS actual FROM (SELECT s1_id, matches, coalesce(got, []) AS got FROM truth LEFT JOIN (SELECT s1_id, list(DISTINCT candidate_id) AS got FROM scored WHERE score >= 0.5 GROUP BY s1_id) USING (s1_id)))"


def sql(final: str) -> str:
    """final, with the expressions that it needs."""
    need: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name in CTES.keys() - need:
            if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    order = [n for n in CTES if n in need]
    return final if not order else "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + final

