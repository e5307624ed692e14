"""The same results in SQL, written the direct way: every profile against every listing, no shared code or tricks."""

from __future__ import annotations

RAW = """
raw AS (
  SELECT s.l_partkey * 1000000 + s.l_suppkey AS pos,
         '  ' || p_name || '  ' AS name,
         CASE n_nationkey WHEN 0 THEN 'bengaluru' WHEN 1 THEN 'New  Delhi' WHEN 2 THEN 'bombay' WHEN 24 THEN ''
              ELSE lower(n_name) END AS city,
         CASE WHEN p_partkey % 17 <> 0 THEN r_name || ' ' || p_brand END AS location,
         p_type || ' , ' || split_part(p_name, ' ', 2) || ',' || p_type AS cuisines,
         CASE WHEN p_partkey % 10 = 0 THEN 'NEW' WHEN p_partkey % 10 = 1 THEN '-' WHEN p_partkey % 10 = 2 THEN NULL
              ELSE printf('%d.%d/5', 1 + p_partkey % 4, s_suppkey % 10) END AS rate,
         CASE WHEN p_partkey % 13 <> 0
              THEN format('{:,}', 90 + (p_partkey * 37 + s_suppkey * 11) % 2400) END AS cost,
         CAST(s.qty AS VARCHAR) AS votes,
         s_name || ' ' || n_name AS address
  FROM (SELECT l_partkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL) s
  JOIN part ON p_partkey = s.l_partkey
  JOIN supplier ON s_suppkey = s.l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey
)"""


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def city(x: str) -> str:
    s = squeeze(x)
    return (
        f"CASE lower({s}) WHEN 'bengaluru' THEN 'Bangalore' WHEN 'bangalore' THEN 'Bangalore' "
        "WHEN 'gurugram' THEN 'Gurgaon' WHEN 'gurgaon' THEN 'Gurgaon' WHEN 'new delhi' THEN 'Delhi' "
        f"WHEN 'ncr' THEN 'Delhi' WHEN 'mumbai' THEN 'Mumbai' WHEN 'bombay' THEN 'Mumbai' ELSE {title(s)} END"
    )


TOKENS = (
    "list_filter(list_transform(string_split(cuisines, ','), lambda t: lower(" + squeeze("t") + ")), lambda t: t <> '')"
)

CANON = f"""
parsed AS (
  SELECT pos, {title(squeeze("name"))} AS name, {city("city")} AS city,
         coalesce({squeeze("location")}, '') AS neighborhood,
         list_filter({TOKENS}, lambda t, i: list_position({TOKENS}, t) = i) AS cuisines,
         CASE WHEN lower(trim(rate)) IN ('', 'nan', 'new', '-', 'none') THEN NULL
              WHEN regexp_matches(trim(rate), '^[0-9]+(\\.[0-9]+)?\\s*/\\s*5')
              THEN CAST(regexp_extract(trim(rate), '^([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE)
              ELSE TRY_CAST(trim(rate) AS DOUBLE) END AS rating,
         TRY_CAST(nullif(regexp_replace(cost, '[^0-9]', '', 'g'), '') AS BIGINT) AS cost_for_two,
         TRY_CAST(votes AS BIGINT) AS votes, address
  FROM raw
),
listings AS (
  SELECT pos,
         substr(sha256(name || '|' || city || '|' || neighborhood || '|'
                       || array_to_string(list_sort(cuisines), ',')), 1, 16) AS id,
         name, city, neighborhood, cuisines, rating, cost_for_two,
         CASE WHEN cost_for_two IS NULL THEN 'medium' WHEN cost_for_two <= 400 THEN 'low'
              WHEN cost_for_two <= 1000 THEN 'medium' ELSE 'high' END AS cost_tier,
         votes, address, name <> '' AND city <> '' AS valid
  FROM parsed
)"""

LISTINGS = RAW + "," + CANON

PREFS_RAW = """
prefs_raw AS (
  SELECT c_custkey AS pref_id,
         CASE c_custkey % 4 WHEN 1 THEN ' nation_' || c_nationkey || ' ' WHEN 2 THEN 'Bengaluru'
              WHEN 3 THEN 'asia  brand#1' END AS location,
         CASE WHEN c_custkey % 10 <> 7 THEN budget END AS budget_for_two_inr,
         CASE WHEN c_custkey % 10 = 7 THEN budget END AS budget_max_inr,
         CASE WHEN c_custkey % 25 = 6 THEN ['Unlisted Kitchen']
              WHEN c_mktsegment = 'BUILDING' THEN ['Economy', 'Ring'] WHEN c_mktsegment = 'FURNITURE' THEN ['Widget']
              WHEN c_mktsegment = 'HOUSEHOLD' THEN ['promo', ' Gear ', 'plate']
              WHEN c_mktsegment = 'MACHINERY' THEN ['  standard ', '']
              ELSE CAST([] AS VARCHAR[]) END AS cuisines,
         CASE WHEN c_custkey % 50 = 3 THEN 6.0::DOUBLE ELSE (c_custkey % 11) / 2.0::DOUBLE END AS min_rating,
         CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' quick service ' END AS extras,
         CASE WHEN c_custkey % 3 <> 0 THEN CAST(1 + c_custkey % 13 AS INTEGER) END AS top_k
  FROM (SELECT *, CASE c_custkey % 50 WHEN 0 THEN '0' WHEN 2 THEN '12.5' WHEN 1 THEN NULL
                  ELSE CAST(100 + c_custkey * 53 % 2500 AS VARCHAR) END AS budget FROM customer)
)"""

PREFS = f"""
checked AS (
  SELECT pref_id,
         CASE WHEN {squeeze("location")} <> '' THEN {city("location")} END AS location,
         CASE WHEN regexp_matches(coalesce(budget_for_two_inr, budget_max_inr), '^[0-9]+$')
              THEN CAST(coalesce(budget_for_two_inr, budget_max_inr) AS BIGINT) END AS cap,
         list_filter(list_transform(cuisines, lambda t: lower({squeeze("t")})), lambda t: t <> '') AS cuisines,
         min_rating, trim(extras) AS extras, top_k,
         coalesce(budget_for_two_inr, budget_max_inr) AS given
  FROM prefs_raw
),
judged AS (
  SELECT *, CASE WHEN given IS NULL THEN 'budget_missing' WHEN cap IS NULL THEN 'budget_not_whole_number'
                 WHEN cap <= 0 THEN 'budget_not_positive' WHEN cap > 1000000 THEN 'budget_too_large'
                 WHEN min_rating < 0 OR min_rating > 5 THEN 'min_rating_out_of_range'
                 WHEN top_k < 1 OR top_k > 12 THEN 'top_k_out_of_range' END AS error
  FROM checked
),
prefs AS (SELECT pref_id, location, cap, cuisines, min_rating, extras, top_k FROM judged WHERE error IS NULL)"""

BASE = LISTINGS + "," + PREFS_RAW + "," + PREFS

# Which profile locations and wanted lists fit which listings, by comparing every distinct pair of strings.
MATCH = """
spots AS (SELECT DISTINCT city, neighborhood, address FROM listings WHERE valid),
locs AS (SELECT DISTINCT location FROM prefs WHERE location IS NOT NULL),
loc_fit AS (
  SELECT location, city, neighborhood, address FROM locs, spots
  WHERE contains(lower(city), lower(location)) OR contains(lower(neighborhood), lower(location))
     OR contains(lower(address), lower(location)) OR contains(lower(location), lower(city))
     OR contains(lower(location), lower(neighborhood))
),
tag_lists AS (SELECT DISTINCT cuisines FROM listings WHERE valid),
want_lists AS (SELECT cuisines AS want FROM prefs UNION SELECT cuisines[1:1] FROM prefs),
tag_fit AS (
  SELECT want, cuisines FROM want_lists, tag_lists
  WHERE len(want) = 0
     OR len(list_filter(want, lambda w: len(list_filter(cuisines, lambda c: contains(c, w) OR contains(w, c))) > 0)) > 0
)"""

# The ladder of each profile, one row per step.
LADDER = """
ladder AS (
  WITH RECURSIVE walk AS (
    SELECT pref_id, 0 AS step, CAST(NULL AS VARCHAR) AS label, location, cuisines, min_rating, cap FROM prefs
    UNION ALL
    SELECT pref_id, step + 1,
           CASE WHEN location IS NOT NULL THEN 'removed_location_filter'
                WHEN len(cuisines) > 1 THEN 'kept_primary_cuisine_only'
                WHEN min_rating > 2.5 + 1e-9 THEN 'lowered_min_rating' ELSE 'increased_budget_cap_inr' END,
           CAST(NULL AS VARCHAR),
           CASE WHEN location IS NULL AND len(cuisines) > 1 THEN cuisines[1:1] ELSE cuisines END,
           CASE WHEN location IS NULL AND len(cuisines) <= 1 AND min_rating > 2.5 + 1e-9
                THEN greatest(2.5::DOUBLE, min_rating - 0.5::DOUBLE) ELSE min_rating END,
           CASE WHEN location IS NULL AND len(cuisines) <= 1 AND min_rating <= 2.5 + 1e-9
                THEN least(250000, cap + 400) ELSE cap END
    FROM walk
    WHERE location IS NOT NULL OR len(cuisines) > 1 OR min_rating > 2.5 + 1e-9 OR least(250000, cap + 400) > cap
  )
  SELECT * FROM walk
)"""

# Per profile the step at which the search ends, from every profile-listing pair that the wanted list admits: a listing
# is a hit from step ``first`` up to, not including, step ``gone``.
STOP = """
shape AS (
  SELECT pref_id, CASE WHEN location IS NULL THEN 0 ELSE 1 END AS loc_steps,
         CASE WHEN len(cuisines) > 1 THEN 1 ELSE 0 END AS cuisine_steps,
         (SELECT count(*) FROM ladder l WHERE l.pref_id = p.pref_id AND label = 'lowered_min_rating') AS rating_steps,
         (SELECT max(step) FROM ladder l WHERE l.pref_id = p.pref_id) AS last_step
  FROM prefs p
),
rate_step AS (
  SELECT pref_id, rating, min(step) AS rate_step
  FROM (SELECT DISTINCT rating FROM listings WHERE rating IS NOT NULL) r
  JOIN (SELECT pref_id, min_rating, min(step) AS step FROM ladder GROUP BY ALL) l ON l.min_rating <= r.rating
  GROUP BY ALL
),
spans AS (
  SELECT p.pref_id,
         greatest(
           CASE WHEN p.location IS NULL OR f.location IS NOT NULL THEN 0 ELSE 1 END,
           r.rate_step,
           CASE WHEN l.cost_for_two <= p.cap THEN 0
                ELSE s.loc_steps + s.cuisine_steps + s.rating_steps + (l.cost_for_two - p.cap + 399) // 400 END) AS first,
         CASE WHEN s.cuisine_steps = 0 OR t1.want IS NOT NULL THEN 1000000 ELSE s.loc_steps + 1 END AS gone,
         count(*) AS n
  FROM prefs p
  JOIN shape s USING (pref_id)
  JOIN tag_fit t ON t.want = p.cuisines
  JOIN listings l ON l.cuisines = t.cuisines AND l.valid
  JOIN rate_step r ON r.pref_id = p.pref_id AND r.rating = l.rating
  LEFT JOIN tag_fit t1 ON t1.want = p.cuisines[1:1] AND t1.cuisines = l.cuisines
  LEFT JOIN loc_fit f ON f.location = p.location AND f.city = l.city AND f.neighborhood = l.neighborhood
                     AND f.address = l.address
  WHERE l.cost_for_two <= p.cap OR (l.cost_for_two <= 250000 AND p.cap < 250000)
  GROUP BY ALL
),
hits AS (
  SELECT a.pref_id, a.step, sum(b.n) AS hits
  FROM (SELECT DISTINCT pref_id, first AS step FROM spans) a
  JOIN spans b ON b.pref_id = a.pref_id AND b.first <= a.step AND a.step < b.gone
  GROUP BY ALL
),
stops AS (
  SELECT s.pref_id, coalesce(min(h.step), any_value(s.last_step)) AS stop
  FROM shape s LEFT JOIN hits h ON h.pref_id = s.pref_id AND h.hits >= 5
  GROUP BY ALL
),
final AS (
  SELECT l.* EXCLUDE (step), l.step AS stop,
         coalesce((SELECT string_agg(w.label, '|' ORDER BY w.step) FROM ladder w
                   WHERE w.pref_id = l.pref_id AND w.step BETWEEN 1 AND l.step), '') AS relaxations
  FROM stops JOIN ladder l ON l.pref_id = stops.pref_id AND l.step = stops.stop
)"""


def funnel(wishes: str, name: str) -> str:
    """Counts after each filter for the wishes in force, plus the pairs that pass the first two."""
    return f"""
{name}_loc AS (
  SELECT w.pref_id, count(*) AS n FROM {wishes} w JOIN listings l ON l.valid
  LEFT JOIN loc_fit f ON f.location = w.location AND f.city = l.city AND f.neighborhood = l.neighborhood
                     AND f.address = l.address
  WHERE w.location IS NULL OR f.location IS NOT NULL GROUP BY ALL
),
{name}_pairs AS NOT MATERIALIZED (
  SELECT w.pref_id, w.cap, w.min_rating, l.*
  FROM {wishes} w JOIN tag_fit t ON t.want = w.cuisines JOIN listings l ON l.cuisines = t.cuisines AND l.valid
  LEFT JOIN loc_fit f ON f.location = w.location AND f.city = l.city AND f.neighborhood = l.neighborhood
                     AND f.address = l.address
  WHERE w.location IS NULL OR f.location IS NOT NULL
),
{name}_rest AS (
  SELECT pref_id, count(*) AS n_cuisine, count_if(cost_for_two <= cap) AS n_budget,
         count_if(cost_for_two <= cap AND rating >= min_rating) AS n_rating
  FROM {name}_pairs GROUP BY ALL
),
{name}_funnel AS (
  SELECT w.pref_id, coalesce(a.n, 0)::BIGINT AS total_after_location,
         coalesce(n_cuisine, 0)::BIGINT AS total_after_cuisine, coalesce(n_budget, 0)::BIGINT AS total_after_budget,
         coalesce(n_rating, 0)::BIGINT AS total_after_rating
  FROM {wishes} w LEFT JOIN {name}_loc a USING (pref_id) LEFT JOIN {name}_rest b USING (pref_id)
)"""


CANDIDATES = """
cands AS (
  SELECT pref_id, row_number() OVER (PARTITION BY pref_id
           ORDER BY rating DESC, coalesce(votes, 0) DESC, lower(name), pos) AS cand_pos,
         pos, id, name, city, neighborhood, cuisines, rating, cost_for_two, cost_tier, votes
  FROM final_pairs WHERE cost_for_two <= cap AND rating >= min_rating
  QUALIFY cand_pos <= 30
)"""

LIMITS = """
limits AS (SELECT pref_id, least(coalesce(top_k, 10), 12) AS top_k FROM prefs)"""

# What the synthetic answers say, stated directly instead of read from JSON.
ENTRIES = """
sizes AS (SELECT pref_id, count(*) AS n FROM cands GROUP BY ALL),
entries AS (
  SELECT pref_id, cand_pos - 1 AS arr_pos, n + 1 - cand_pos AS rank, id AS restaurant_id, 'why ' || name AS explanation
  FROM cands JOIN sizes USING (pref_id) WHERE pref_id % 8 = 0
  UNION ALL SELECT pref_id, cand_pos - 1, cand_pos, id, 'good' FROM cands WHERE pref_id % 8 = 1 AND cand_pos <= 3
  UNION ALL SELECT pref_id, 0, 1, 'nobody', 'good' FROM sizes WHERE pref_id % 8 = 2
  UNION ALL SELECT pref_id, 1, 2, id, 'good' FROM cands JOIN sizes USING (pref_id)
            WHERE pref_id % 8 = 2 AND cand_pos = n
  UNION ALL SELECT pref_id, 2, 2, id, 'good' FROM cands WHERE pref_id % 8 = 2 AND cand_pos = 1
  UNION ALL SELECT pref_id, cand_pos - 1, cand_pos, upper(name), 'good' FROM cands
            WHERE pref_id % 8 = 3 AND cand_pos <= 2
  UNION ALL SELECT pref_id, 0, 1, id, '' FROM cands JOIN sizes USING (pref_id) WHERE pref_id % 8 = 4 AND cand_pos = n
  UNION ALL SELECT pref_id, 1, 2, id, 'good' FROM cands JOIN sizes USING (pref_id)
            WHERE pref_id % 8 = 4 AND cand_pos = n
)"""

RECONCILED = """
resolved AS (
  SELECT e.pref_id, e.rank, e.arr_pos,
         coalesce((SELECT max(c.cand_pos) FROM cands c WHERE c.pref_id = e.pref_id AND c.id = e.restaurant_id),
                  (SELECT min(c.cand_pos) FROM cands c
                   WHERE c.pref_id = e.pref_id AND lower(c.name) = lower(e.restaurant_id))) AS cand_pos,
         CASE WHEN e.explanation = '' THEN 'Matches your preferences among the shortlisted venues.'
              ELSE e.explanation END AS explanation
  FROM entries e
),
line AS (
  SELECT r.pref_id, 0 AS part, r.rank AS o1, r.arr_pos AS o2, r.cand_pos, c.id, r.explanation
  FROM resolved r JOIN cands c ON c.pref_id = r.pref_id AND c.cand_pos = r.cand_pos
  UNION ALL
  SELECT pref_id, 1, cand_pos, 0, cand_pos, id,
         'High rating and match for your filters among the shortlisted venues.'
  FROM cands WHERE pref_id % 8 NOT IN (5, 7)
),
once AS (
  SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY pref_id, id ORDER BY part, o1, o2) = 1
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pref_id ORDER BY part, o1, o2) AS rank FROM once
),
items AS (
  SELECT pref_id, rank, cand_pos, explanation FROM placed JOIN limits USING (pref_id) WHERE rank <= top_k
  UNION ALL
  SELECT pref_id, cand_pos, cand_pos,
         'Ranked using ratings and votes on your shortlist (LLM unavailable or parse error).'
  FROM cands JOIN limits USING (pref_id) WHERE cand_pos <= top_k AND pref_id % 8 IN (5, 7)
)"""

SEARCH = ",".join([BASE, MATCH, LADDER, STOP, funnel("final", "final")])
FOUND = SEARCH + "," + CANDIDATES
ANSWERED = ",".join([FOUND, LIMITS, ENTRIES, RECONCILED])


# A handful of profiles given as values, in place of the customers.
FEW_RAW = """
prefs_raw AS (
  SELECT * FROM (VALUES
    (1, 'Bangalore', '1200', NULL, ['economy', 'ring'], 3.0::DOUBLE, '', 5),
    (2, NULL, '700', NULL, CAST([] AS VARCHAR[]), 4.5, '', NULL),
    (3, 'Asia Brand#1', '150', NULL, ['promo', 'gear', 'plate'], 5.0, '', 12),
    (4, NULL, '2000', NULL, ['unlisted kitchen'], 2.5, '', NULL),
    (5, 'Nowhere At All', '1', NULL, ['standard'], 2.0, '', NULL),
    (6, 'Nation_3', '300', NULL, ['unlisted kitchen', 'widget'], 4.0, '', 1)
  ) t(pref_id, location, budget_for_two_inr, budget_max_inr, cuisines, min_rating, extras, top_k)
)"""


def _few(sql: str) -> str:
    """``sql`` for those profiles."""
    return sql.replace(PREFS_RAW, FEW_RAW)


def _q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


_LISTING = (
    "SELECT pos, id, name, city, neighborhood, array_to_string(cuisines, '|') AS cuisines, rating, cost_for_two, "
    "cost_tier, votes, address FROM listings"
)
_WIDE = (
    "name, city, neighborhood, array_to_string(cuisines, '|') AS cuisines, rating, cost_for_two, cost_tier"
)
_FALLBACK = "'Ranked using ratings and votes on your shortlist (LLM unavailable or parse error).'"
_GAP = "[\\t-\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _words(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_GAP}', ' ', 'g'))"


_DOC_TITLE = (
    f"array_to_string(list_transform(regexp_extract_all({_words('text')}, "
    "'[\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+'), lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"
)


def _schema_check() -> str:
    held = {
        "address": "address",
        "name": "name",
        "rate": "rate",
        "votes": "votes",
        "location": "location",
        "cuisines": "cuisines",
        "approx_cost(for two people)": "cost",
        "listed_in(city)": "city",
    }
    absent = (
        "url",
        "online_order",
        "book_table",
        "phone",
        "rest_type",
        "dish_liked",
        "reviews_list",
        "menu_item",
        "listed_in(type)",
    )
    rows = [f"SELECT '{n}' AS column_name, true AS present, count({c}) AS n_values FROM raw" for n, c in held.items()]
    rows += [f"SELECT '{n}', false, 0" for n in absent]
    return _q(RAW, "\nUNION ALL ".join(rows))


ORACLES: dict[str, str] = {
    "ingest_batch": _q(LISTINGS, _LISTING),
    "ingest_limit": _q(LISTINGS, _LISTING + " ORDER BY pos LIMIT 1000"),
    "schema_check": _schema_check(),
    "canonical_roundtrip": _q(LISTINGS, _LISTING),
    "cache_hit": _q(LISTINGS, _LISTING),
    "cache_snapshots": _q(
        LISTINGS,
        "SELECT pos, id, 'first' AS snapshot FROM listings WHERE pos % 3 <> 0 "
        "UNION ALL SELECT pos, id, 'newest' FROM listings",
    ),
    "canonical_listings": _q(LISTINGS, _LISTING),
    "valid_listings": _q(LISTINGS, "SELECT pos, id, name, city FROM listings WHERE valid"),
    "validate_corpus": _q(
        LISTINGS,
        "SELECT count(*) AS total_rows, count_if(valid)::BIGINT AS rows_passing_validation, "
        "'1.0.0' AS schema_version FROM listings",
    ),
    "localities": _q(
        LISTINGS, "SELECT DISTINCT trim(neighborhood) AS locality FROM listings WHERE trim(neighborhood) <> ''"
    ),
    "ingest_metrics": _q(
        LISTINGS,
        "SELECT count(*) AS total_rows, count_if(valid)::BIGINT AS rows_passing_validation FROM listings",
    ),
    "ingest_stream": _q(LISTINGS, _LISTING),
    "norm_whitespace": f"SELECT doc_id, {_words('text')} AS norm FROM documents",
    "title_case": f"SELECT doc_id, {_DOC_TITLE} AS title FROM documents",
    "norm_city": _q(RAW, f"SELECT pos, {city('city')} AS city FROM raw"),
    "split_tokens": f"""
WITH t AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda t: lower({_words("t")})),
                             lambda t: t <> '') AS ts FROM documents
)
SELECT doc_id, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), '|') AS tokens FROM t""",
    "parse_rating": _q(LISTINGS, "SELECT pos, rating FROM listings"),
    "parse_cost": _q(LISTINGS, "SELECT pos, cost_for_two FROM listings"),
    "cost_tier": _q(LISTINGS, "SELECT pos, cost_tier FROM listings"),
    "parse_votes": _q(LISTINGS, "SELECT pos, votes FROM listings"),
    "stable_id": _q(LISTINGS, "SELECT pos, id FROM listings"),
    "split_free_text": f"""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,\\n]'),
         lambda t: regexp_replace(t, '^{_GAP}|{_GAP}$', '', 'g')), lambda t: t <> ''), '|') AS parts FROM documents""",
    "display_columns": _q(
        LISTINGS,
        "SELECT pos, concat_ws(', ', nullif(neighborhood, ''), nullif(city, '')) AS area, "
        "coalesce('₹' || format('{:,}', cost_for_two) || ' for two', '—') AS cost, "
        "coalesce(printf('%.1f', rating), '—') AS rating FROM listings",
    ),
    "prefs_validated": _q(
        PREFS_RAW + "," + PREFS,
        "SELECT pref_id, location, cap AS max_cost_for_two_inr, array_to_string(cuisines, '|') AS cuisines, "
        "min_rating, extras, top_k FROM prefs",
    ),
    "prefs_rejected": _q(PREFS_RAW + "," + PREFS, "SELECT pref_id, error FROM judged WHERE error IS NOT NULL"),
    "token_budget": _q(
        PREFS_RAW + "," + PREFS + "," + LIMITS,
        "SELECT pref_id, top_k, CASE WHEN 1200 < 350 + 85 * top_k THEN least(4096, 350 + 85 * top_k) ELSE 1200 END "
        "AS max_tokens FROM limits",
    ),
    "relax_ladder": _q(
        PREFS_RAW + "," + PREFS + "," + LADDER,
        "SELECT pref_id, step, label, location, array_to_string(cuisines, '|') AS cuisines, min_rating, "
        "cap AS max_cost_for_two_inr FROM ladder",
    ),
    "relaxations_applied": _q(SEARCH, "SELECT pref_id, stop, relaxations FROM final"),
    "filter_report": _q(
        SEARCH,
        "SELECT f.*, stop, relaxations, total_after_rating > 30 AS truncated "
        "FROM final_funnel f JOIN final USING (pref_id)",
    ),
    "relaxed_search": _q(
        FOUND,
        "SELECT pref_id, stop, n_candidates, pos_sum FROM final LEFT JOIN (SELECT pref_id, count(*) AS n_candidates, "
        "CAST(sum(pos) AS BIGINT) AS pos_sum FROM cands GROUP BY ALL) USING (pref_id)",
    ),
    "topk_candidates": _q(FOUND, "SELECT pref_id, cand_pos, pos, id FROM cands"),
    "packed_candidates": _q(FOUND, f"SELECT pref_id, cand_pos - 1 AS place, id, {_WIDE}, votes FROM cands"),
    "rank_candidates": _q(
        LISTINGS,
        """
SELECT pos, id, name, rating, votes FROM listings
WHERE valid AND cost_for_two <= 1200 AND rating >= 3.0
  AND (contains(lower(city), 'bangalore') OR contains(lower(neighborhood), 'bangalore')
       OR contains(lower(address), 'bangalore') OR contains('bangalore', lower(city))
       OR contains('bangalore', lower(neighborhood)))
  AND len(list_filter(cuisines, lambda c: contains(c, 'economy') OR contains('economy', c) OR contains(c, 'ring')
                                OR contains('ring', c))) > 0
ORDER BY rating DESC, coalesce(votes, 0) DESC, lower(name), pos LIMIT 30""",
    ),
    "fallback_recommendations": _q(
        FOUND + "," + LIMITS,
        f"SELECT pref_id, cand_pos AS rank, id, {_FALLBACK} AS explanation FROM cands JOIN limits USING (pref_id) "
        "WHERE cand_pos <= top_k",
    ),
    "recommend_batch": _q(
        FOUND + "," + LIMITS,
        f"SELECT pref_id, cand_pos AS rank, id, {_WIDE}, {_FALLBACK} AS explanation "
        "FROM cands JOIN limits USING (pref_id) WHERE cand_pos <= top_k",
    ),
    "reconcile": _q(
        ANSWERED,
        f"SELECT pref_id, rank, id, {_WIDE}, explanation FROM items JOIN cands USING (pref_id, cand_pos)",
    ),
    "parse_responses": _q(
        FOUND + "," + ENTRIES, "SELECT pref_id, arr_pos, rank, restaurant_id, explanation FROM entries"
    ),
    "grounding_violations": _q(
        ANSWERED,
        """
SELECT pref_id, n_items, coalesce(n_entries, 0)::BIGINT AS n_entries, coalesce(n_violations, 0)::BIGINT AS n_violations
FROM (SELECT pref_id, count(*) AS n_items FROM items GROUP BY ALL)
LEFT JOIN (SELECT pref_id, count(*) AS n_entries, count_if(cand_pos IS NULL) AS n_violations
           FROM resolved GROUP BY ALL) USING (pref_id)""",
    ),
    "rec_report": _q(
        FOUND,
        """
SELECT f.pref_id,
       CASE WHEN total_after_rating = 0 THEN 'No restaurants matched your filters.'
            WHEN f.pref_id % 8 IN (5, 7) THEN 'Here are top picks from your filtered list.'
            WHEN f.pref_id % 8 = 1 THEN NULL WHEN f.pref_id % 8 = 2 THEN '7'
            WHEN f.pref_id % 8 = 6 THEN 'nothing to say' ELSE 'Picks for ' || f.pref_id END AS summary,
       CASE WHEN total_after_rating = 0 THEN 'none' WHEN f.pref_id % 8 IN (5, 7) THEN 'deterministic_fallback'
            ELSE 'llama-3.3-70b-versatile' END AS model_id,
       'v2' AS prompt_version, total_after_rating = 0 OR f.pref_id % 8 IN (5, 7) AS fallback_used,
       relaxations AS relaxations_applied, total_after_rating > 30 AS truncated, total_after_location,
       total_after_cuisine, total_after_budget, total_after_rating
FROM final_funnel f JOIN final USING (pref_id)""",
    ),
    "prompt_payload": _q(
        FOUND + "," + LIMITS,
        """
SELECT p.pref_id, coalesce(location, 'any locality') AS locality_or_area, cap AS max_budget_inr_for_two,
       CASE WHEN len(p.cuisines) = 0 THEN 'any cuisine (user did not specify)'
            ELSE array_to_string(p.cuisines, ', ') END AS cuisine_preferences,
       min_rating, nullif(extras, '') AS extras, relaxed, candidate_ids,
       CASE WHEN 1200 < 350 + 85 * l.top_k THEN least(4096, 350 + 85 * l.top_k) ELSE 1200 END AS max_tokens
FROM prefs p JOIN limits l USING (pref_id) JOIN (SELECT pref_id, relaxations AS relaxed FROM final) USING (pref_id)
JOIN (SELECT pref_id, string_agg(id, '|' ORDER BY cand_pos) AS candidate_ids FROM cands GROUP BY ALL) USING (pref_id)""",
    ),
    "completion_hook": _q(
        FOUND,
        "SELECT pref_id, (max(cand_pos) OVER (PARTITION BY pref_id)) + 1 - cand_pos AS rank, id AS restaurant_id "
        "FROM cands",
    ),
    "completion_log": _q(
        FOUND,
        "SELECT pref_id, n + 1 - cand_pos AS rank, id AS restaurant_id, CAST(1 + n % 2 AS BIGINT) AS calls, "
        "CAST(NULL AS VARCHAR) AS error FROM (SELECT *, count(*) OVER (PARTITION BY pref_id) AS n FROM cands)",
    ),
    "recommend_stream": _q(
        FOUND + "," + LIMITS,
        f"SELECT pref_id, cand_pos AS rank, id, {_WIDE}, {_FALLBACK} AS explanation "
        "FROM cands JOIN limits USING (pref_id) WHERE cand_pos <= top_k",
    ),
}

_STRICT = _q(
    ",".join([BASE, MATCH, funnel("prefs", "strict")]),
    "SELECT pref_id, total_after_location, total_after_cuisine, total_after_budget, total_after_rating "
    "FROM strict_funnel",
)
ORACLES["filter_funnel"] = _STRICT
for _stage in ("location", "cuisine", "budget", "rating"):
    ORACLES[f"filter_{_stage}"] = f"SELECT pref_id, total_after_{_stage} FROM (\n{_STRICT}\n)"

ORACLES["ingest_stream_metrics"] = ORACLES["ingest_metrics"]
ORACLES["recommend_stream_rejected"] = ORACLES["prefs_rejected"]
ORACLES["recommend_stream_report"] = _q(
    SEARCH,
    """
SELECT f.pref_id,
       CASE WHEN total_after_rating = 0 THEN 'No restaurants matched your filters.'
            ELSE 'Here are top picks from your filtered list.' END AS summary,
       CASE WHEN total_after_rating = 0 THEN 'none' ELSE 'deterministic_fallback' END AS model_id,
       'v2' AS prompt_version, true AS fallback_used, relaxations AS relaxations_applied,
       total_after_rating > 30 AS truncated, total_after_location, total_after_cuisine, total_after_budget,
       total_after_rating
FROM final_funnel f JOIN final USING (pref_id)""",
)
ORACLES["run_signals"] = _q(
    SEARCH,
    """
SELECT count(*) AS n_profiles, count_if(total_after_rating = 0)::BIGINT AS n_empty,
       count_if(total_after_rating > 0 AND f.pref_id % 8 IN (5, 7))::BIGINT AS n_fallback,
       count_if(relaxations <> '')::BIGINT AS n_relaxed, count_if(total_after_rating > 30)::BIGINT AS n_truncated
FROM final_funnel f JOIN final USING (pref_id)""",
)
ORACLES["places_asked"] = _q(PREFS_RAW + "," + PREFS, "SELECT location, count(*) AS n_profiles FROM prefs GROUP BY ALL")
ORACLES["unique_venues"] = _q(
    LISTINGS,
    "SELECT pos, id, name, city FROM listings QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1",
)

ORACLES["few_items"] = _few(ORACLES["recommend_batch"])
ORACLES["few_report"] = _few(ORACLES["filter_report"])

ORACLES["ingest_batch_metrics"] = (
    f"SELECT total_rows, rows_passing_validation, total_rows AS rows_written FROM ({ORACLES['ingest_metrics']})"
)
ORACLES["quarantine"] = _q(
    LISTINGS,
    """
SELECT fmt, outcome, count(*) AS n, CAST(sum(p) AS BIGINT) AS pos_sum, CAST(sum(c) AS BIGINT) AS cost_sum
FROM (
  SELECT CASE pos % 11 WHEN 1 THEN 'no_pos' WHEN 2 THEN 'pos_not_whole_number' WHEN 3 THEN 'pos_repeated'
              WHEN 4 THEN 'unreadable' ELSE 'good' END AS outcome,
         CASE WHEN pos % 11 NOT IN (1, 2, 3, 4) THEN pos END AS p,
         CASE WHEN pos % 11 NOT IN (1, 2, 3, 4) THEN cost_for_two END AS c,
         unnest(CASE WHEN pos % 11 = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM listings
), (VALUES ('csv'), ('json')) f(fmt)
GROUP BY ALL""",
)


def _live(listings: str, profiles: str, name: str) -> str:
    """Recommendations of some profiles over some listings."""
    places, customers = "JOIN region ON r_regionkey = n_regionkey", "FROM customer)"
    sql = ORACLES["fallback_recommendations"].replace(places, f"{places} WHERE {listings}")
    sql = sql.replace(customers, f"FROM customer WHERE {profiles})")
    return f"SELECT pref_id, rank, id, '{name}' AS snapshot FROM ({sql})"


ORACLES["recommend_stream_live"] = (
    _live("(s.l_partkey * 1000000 + s.l_suppkey) % 3 <> 0", "c_custkey % 2 = 0", "first")
    + " UNION ALL "
    + _live("true", "c_custkey % 2 = 1", "second")
)
ORACLES["reuse_half"] = _q(
    FOUND + "," + LIMITS,
    f"""
SELECT pref_id, cand_pos AS rank, id, {_FALLBACK} AS explanation,
       (SELECT count(*) FROM (
          SELECT location, cap, cuisines, min_rating, top_k FROM prefs WHERE pref_id % 2 = 1
          EXCEPT SELECT location, cap, cuisines, min_rating, top_k FROM prefs WHERE pref_id % 2 = 0)) AS n_searched
FROM cands JOIN limits USING (pref_id) WHERE cand_pos <= top_k""",
)
ORACLES["expectations_missed"] = _q(
    FOUND,
    """
SELECT pref_id, fact, side, bound, value, bound AS against
FROM (
  SELECT p.pref_id, 'max_cost' AS fact, '<=' AS side, CAST(p.cap AS DOUBLE) AS bound,
         CAST((SELECT max(cost_for_two) FROM cands c WHERE c.pref_id = p.pref_id) AS DOUBLE) AS value FROM prefs p
  UNION ALL
  SELECT p.pref_id, 'min_rating', '>=', p.min_rating,
         (SELECT min(rating) FROM cands c WHERE c.pref_id = p.pref_id) FROM prefs p
  UNION ALL
  SELECT p.pref_id, 'n_candidates', '>=', 5.0,
         CAST((SELECT count(*) FROM cands c WHERE c.pref_id = p.pref_id) AS DOUBLE) FROM prefs p
)
WHERE NOT coalesce(CASE side WHEN '<=' THEN value <= bound ELSE value >= bound END, false)""",
)
ORACLES["twins_compared"] = _q(
    ",".join([BASE, MATCH, funnel("prefs", "strict")]).replace(
        "FROM judged WHERE error IS NULL)",
        "FROM judged WHERE error IS NULL UNION ALL "
        "SELECT pref_id + 10000000, location, cap + 500, cuisines, min_rating, extras, top_k FROM judged WHERE error IS NULL)",
    ),
    """
SELECT a.pref_id, 'after_rating' AS fact, '>=' AS side, b.pref_id AS other_id,
       CAST(a.total_after_rating AS DOUBLE) AS value, CAST(b.total_after_rating AS DOUBLE) AS against
FROM strict_funnel a JOIN strict_funnel b ON a.pref_id = b.pref_id + 10000000
WHERE a.total_after_rating < b.total_after_rating
UNION ALL
SELECT a.pref_id, 'after_budget', '>=', b.pref_id, a.total_after_budget, b.total_after_budget
FROM strict_funnel a JOIN strict_funnel b ON b.pref_id = a.pref_id + 10000000
WHERE a.pref_id % 9 = 0 AND a.total_after_budget < b.total_after_budget""",
)
