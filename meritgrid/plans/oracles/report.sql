-- cte: o_typed uses: o_cert fx_certs
SELECT c.seq, c.pos, c.name, c.status, CASE WHEN c.pos % 9 <> 0 THEN concat(k.kind, ' Accreditation') END AS type, c.accreditation_date, CASE WHEN c.pos % 2 = 0 THEN CAST(CAST(c.expiry_ts AS DATE) AS VARCHAR) END AS expiry_date
FROM fx_certs c JOIN (SELECT DISTINCT name, kind FROM o_cert) k USING (name)
-- query: count_by_dimension uses: fx_orgs
SELECT 'state' AS dimension, state AS value, count(*) AS n FROM fx_orgs GROUP BY 2 UNION ALL SELECT 'type', hospital_type, count(*) FROM fx_orgs GROUP BY 2 UNION ALL SELECT 'source', data_source, count(*) FROM fx_orgs GROUP BY 2 UNION ALL SELECT 'country', country, count(*) FROM fx_orgs GROUP BY 2
-- query: top_counts uses: fx_orgs
(SELECT 'city' AS dimension, city AS value, count(*) AS n FROM fx_orgs GROUP BY 2 ORDER BY n DESC, value LIMIT 5) UNION ALL (SELECT 'country', country, count(*) AS n FROM fx_orgs GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)
-- query: feed_coverage uses: fx_orgs
SELECT count(*) AS n_rows, count(*) FILTER (city <> '') AS with_city, count(*) FILTER (state <> 'Unknown') AS with_state, count(*) FILTER (phone <> '') AS with_phone, count(website) AS with_website FROM fx_orgs
-- query: country_summary uses: o_rank
SELECT country, count(*) AS n_orgs, min(overall_rank) AS best_rank, round(avg(overall_rank), 6) AS avg_rank, round(avg(total_score), 6) AS avg_total_score, max(total_score) AS max_total_score, min(total_score) AS min_total_score,
 round(avg(p), 6) AS avg_percentile, round(max(p), 6) AS max_percentile, round(min(p), 6) AS min_percentile FROM (SELECT *, (n_orgs - overall_rank + 1) / n_orgs * 100 AS p FROM o_rank) GROUP BY 1
-- query: region_summary uses: o_rank
SELECT region, count(*) AS n_orgs, min(overall_rank) AS best_rank, round(avg(overall_rank), 6) AS avg_rank, round(avg(total_score), 6) AS avg_total_score FROM o_rank GROUP BY 1
-- query: country_top uses: o_score_table
SELECT country, count(*) AS n_orgs, round(avg(total_score), 6) AS avg_score, arg_max(name, struct_pack(s := total_score, q := -seq)) AS top_organization FROM o_score_table GROUP BY 1
-- query: score_bands uses: o_score_table
SELECT CASE WHEN total_score >= 75 THEN 'A+ (75-100)' WHEN total_score >= 65 THEN 'A (65-74)' WHEN total_score >= 55 THEN 'B+ (55-64)' WHEN total_score >= 45 THEN 'B (45-54)' ELSE 'C (0-44)' END AS band, count(*) AS n FROM o_score_table GROUP BY 1
-- query: gapped_bands uses: o_score_table
SELECT b AS band, count(s.seq) AS n, round(count(s.seq) * 100.0 / (SELECT count(*) FROM o_score_table), 6)::DOUBLE AS share FROM (VALUES (70, 100, 'A+ (70-100)'), (60, 69.99, 'A (60-69)'), (50, 59.99, 'B+ (50-59)'), (40, 49.99, 'B (40-49)'), (30, 39.99, 'C+ (30-39)'), (0, 29.99, 'C (0-29)')) r(lo, hi, b)
LEFT JOIN o_score_table s ON s.total_score BETWEEN CAST(lo AS DOUBLE) AND CAST(hi AS DOUBLE) GROUP BY b
-- cte: o_issue_rows uses: o_typed
SELECT 'Missing certification status' AS issue FROM o_typed WHERE status = '' UNION ALL SELECT 'Missing certification type' FROM o_typed WHERE type IS NULL
UNION ALL SELECT 'Invalid date format in accreditation_date' FROM o_typed WHERE try_strptime(accreditation_date, '%Y-%m-%d') IS NULL
-- query: cert_quality uses: o_typed
SELECT count(*) AS n_certs, count(*) FILTER (status <> '' AND type IS NOT NULL) AS complete, CAST(0 AS BIGINT) AS missing_name, count(*) FILTER (status = '') AS missing_status, count(*) FILTER (type IS NULL) AS missing_type, count(*) FILTER (try_strptime(accreditation_date, '%Y-%m-%d') IS NULL) AS invalid_dates FROM o_typed
-- query: cert_issues uses: o_issue_rows
SELECT issue, count(*) AS n FROM o_issue_rows GROUP BY 1
-- query: country_types uses: o_typed fx_orgs
SELECT country, type, count(*) AS n FROM o_typed JOIN fx_orgs USING (seq) WHERE type IS NOT NULL GROUP BY 1, 2
-- query: body_coverage uses: o_typed fx_orgs
SELECT body, count(*) AS n_certs, count(DISTINCT seq) AS n_orgs, count(DISTINCT country) AS n_countries FROM (
 SELECT 'jci' AS body, seq FROM o_typed WHERE upper(name) LIKE '%JCI%' OR upper(name) LIKE '%JOINT COMMISSION%' OR upper(type) LIKE '%JCI ACCREDITATION%' UNION ALL SELECT 'nabh', seq FROM o_typed WHERE upper(name) LIKE '%NABH%'
 UNION ALL SELECT 'nabl', seq FROM o_typed WHERE upper(name) LIKE '%NABL%' UNION ALL SELECT 'cap', seq FROM o_typed WHERE upper(name) LIKE '%CAP%' OR upper(name) LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%' UNION ALL SELECT 'iso', seq FROM o_typed WHERE upper(name) LIKE '%ISO%') JOIN fx_orgs USING (seq) GROUP BY 1
-- query: iso_standards uses: fx_certs
SELECT concat('ISO ', regexp_extract(upper(name), 'ISO\s*(\d+)', 1)) AS standard, count(*) AS n FROM fx_certs WHERE regexp_matches(upper(name), 'ISO\s*\d+') GROUP BY 1
-- query: coverage_kpis uses: o_typed fx_orgs
WITH o AS (SELECT count(*) AS n FROM fx_orgs), c AS (SELECT count(*) AS n, count(DISTINCT seq) AS s, count(*) FILTER (status <> '' AND type IS NOT NULL) AS ok FROM o_typed)
SELECT o.n AS n_orgs, c.s AS n_certified, c.n AS n_certs, c.ok AS n_complete, round(c.s / o.n * 100, 6) AS coverage_pct, round(c.n / c.s, 6) AS certs_per_org, round(c.ok / c.n * 100, 6) AS complete_pct FROM o, c
-- cte: o_family uses: o_typed
SELECT seq, CASE WHEN lower(type) LIKE '%nabh%' THEN 'nabh' WHEN lower(type) LIKE '%jci%' THEN 'jci' WHEN lower(type) LIKE '%nabl%' THEN 'nabl' WHEN lower(type) LIKE '%cap%' THEN 'cap' ELSE 'other' END AS family FROM o_typed
-- query: family_counts uses: o_family
SELECT family, count(*) AS n FROM o_family GROUP BY 1
-- query: portal_body_counts uses: o_family
SELECT family, count(*) AS n, count(*) FILTER (seq % 3 = 0) AS n_portal FROM o_family GROUP BY 1
-- query: table_integrity uses: fx_orgs
SELECT count(*) AS n_rows, count(*) FILTER (seq % 50 <> 0) AS n_valid, round(count(*) FILTER (seq % 50 <> 0) / count(*) * 100, 6) AS integrity_pct, 'Good' AS label FROM fx_orgs
-- query: field_completeness uses: fx_orgs
SELECT 'name' AS field, 100.0::DOUBLE AS pct UNION ALL SELECT 'city', round(avg((city <> '')::INT) * 100, 6) FROM fx_orgs UNION ALL SELECT 'state', 100.0 UNION ALL SELECT 'phone', round(avg((phone <> '')::INT) * 100, 6) FROM fx_orgs UNION ALL SELECT 'website', round(avg((website IS NOT NULL)::INT) * 100, 6) FROM fx_orgs
-- query: portal_years uses: o_reg_rows
SELECT 'year' AS dimension, CASE WHEN vf IS NULL THEN '' ELSE CAST(year(vf) AS VARCHAR) END AS value, count(*) AS n FROM o_reg_rows GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM o_reg_rows GROUP BY 2
-- query: column_profile uses: fx_orgs
WITH c AS (SELECT 'city' AS dimension, city AS v, count(*) AS n FROM fx_orgs GROUP BY 2 UNION ALL SELECT 'website', coalesce(website, 'Unknown'), count(*) FROM fx_orgs GROUP BY 2 UNION ALL SELECT 'hospital_type', hospital_type, count(*) FROM fx_orgs GROUP BY 2),
t AS (SELECT dimension, max(n) AS top_n, string_agg(v, '|' ORDER BY n DESC, v) AS top_values FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, v) AS k FROM c) WHERE k <= 3 GROUP BY 1)
SELECT dimension, count(*) - CASE WHEN dimension = 'website' THEN 1 ELSE 0 END AS n_distinct, CASE WHEN dimension = 'website' THEN (SELECT count(*) FROM fx_orgs WHERE website IS NULL) ELSE 0 END AS n_null, any_value(top_n) AS top_n, any_value(top_values) AS top_values FROM c JOIN t USING (dimension) GROUP BY dimension
-- query: duplicate_names uses: fx_orgs
SELECT count(*) AS n_names, count(DISTINCT name) AS n_distinct, count(*) - count(DISTINCT name) AS n_duplicates FROM fx_orgs
-- query: upload_profile uses: fx_orgs
SELECT count(*) AS n_rows, count(*) FILTER (name IS NULL) AS n_empty_names, count(*) - count(DISTINCT coalesce(name, '')) AS n_duplicate_names, count(name) AS n_accepted, round(count(name) * 100.0 / count(*), 6)::DOUBLE AS success_pct, count(DISTINCT country) FILTER (name IS NOT NULL) AS n_countries
FROM (SELECT CASE WHEN seq % 20 <> 0 THEN name END AS name, country FROM fx_orgs)
-- query: portal_quality_bands uses: fx_history
SELECT CASE WHEN total_score >= 90 THEN 'excellent' WHEN total_score >= 70 THEN 'good' WHEN total_score >= 50 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(total_score), 6) AS avg_score FROM fx_history GROUP BY 1
-- query: source_audit uses: fx_orgs o_unique_certs
SELECT 'total' AS metric, CAST(count(DISTINCT seq) AS BIGINT) AS n FROM o_unique_certs UNION ALL SELECT 'jci', count(DISTINCT seq) FROM o_unique_certs WHERE name LIKE '%JCI%' UNION ALL SELECT concat('source::', data_source), count(*) FROM fx_orgs GROUP BY 1 UNION ALL SELECT concat('source::', region), count(*) FROM fx_orgs GROUP BY 1
-- query: dual_accreditation uses: fx_orgs
SELECT count(*) AS n_orgs, count(*) FILTER (seq % 3 = 0) AS n_jci, count(*) FILTER (seq % 5 <> 0 AND seq % 4 = 0) AS n_nabh, count(*) FILTER (seq % 5 <> 0 AND seq % 12 = 0) AS n_both FROM fx_orgs
-- query: specialty_counts uses: fx_orgs
SELECT specialty, n FROM (
SELECT 'Medical Laboratory Testing' AS specialty, count(*) AS n FROM fx_orgs UNION ALL SELECT 'Anatomic Pathology', count(*) FROM fx_orgs WHERE lower(name) LIKE '%pathology%' UNION ALL SELECT 'Clinical Diagnostics', count(*) FROM fx_orgs WHERE regexp_matches(lower(name), 'clinical|diagnostic')
UNION ALL SELECT 'Cardiovascular Testing', count(*) FROM fx_orgs WHERE lower(name) LIKE '%cardiac%' UNION ALL SELECT 'Oncology Testing', count(*) FROM fx_orgs WHERE lower(name) LIKE '%cancer%'
) WHERE n > 0
-- query: lab_summary uses: fx_orgs
SELECT count(*) AS n_labs, round(avg(prior_score_src / 100), 6) AS avg_score, count(*) FILTER (phone <> '') AS with_phone, count(website) AS with_website, count(*) FILTER (length(concat(city, ', ', state, ', ', country)) > 20) AS with_address FROM fx_orgs
-- query: top_hundred uses: o_rank
SELECT overall_rank, seq, total_score FROM o_rank WHERE overall_rank <= 100
-- cte: o_countries uses: fx_orgs
SELECT country, region, round(avg(prior_score_src) / 60, 6) AS score, count(*) AS hospitals, round(sum(prior_score_src), 6) AS gdp, right(country, 2) AS code FROM fx_orgs GROUP BY 1, 2
-- query: country_filter uses: o_countries
SELECT country, score, hospitals FROM o_countries WHERE score BETWEEN 60 AND 90 AND hospitals >= 50 AND code IN ('_1', '10', '12', '_5', '_7', '20')
-- query: country_statistics uses: o_countries
SELECT round(avg(score), 6) AS avg_score, arg_max(country, struct_pack(s := score, c := country)) AS top_country, count(*) FILTER (score >= 85) AS n_high, round(count(*) FILTER (score >= 85) / count(*) * 100, 6) AS high_pct, CAST(sum(hospitals) AS BIGINT) AS hospitals FROM o_countries
-- query: region_statistics uses: o_countries
SELECT region, count(*) AS n_countries, round(avg(score), 6) AS avg_score, CAST(sum(hospitals) AS BIGINT) AS hospitals, round(avg(gdp), 4) AS avg_gdp FROM o_countries GROUP BY 1
-- query: largest_countries uses: o_countries
SELECT country, score FROM o_countries ORDER BY score DESC, country LIMIT 5
-- query: running_by_type uses: fx_monthly
SELECT y, m, cert_type, CAST(sum(cnt) OVER (PARTITION BY cert_type ORDER BY y, m) AS BIGINT) AS running FROM fx_monthly
-- cte: o_month uses: fx_monthly
SELECT y, m, CAST(sum(cnt) AS BIGINT) AS total FROM fx_monthly GROUP BY 1, 2
-- query: monthly_growth uses: o_month
SELECT y, m, running, round(CASE WHEN b > 0 THEN (running - b) / b * 100 ELSE 0 END, 6) AS growth FROM (SELECT y, m, running, lag(running) OVER (ORDER BY y, m) AS b FROM (SELECT y, m, CAST(sum(total) OVER (ORDER BY y, m) AS BIGINT) AS running FROM o_month)) WHERE b IS NOT NULL
-- query: type_totals uses: fx_monthly
SELECT cert_type, CAST(sum(cnt) AS BIGINT) AS total, round(sum(cnt) * 100.0 / (SELECT sum(cnt) FROM fx_monthly), 6)::DOUBLE AS share, round(sum(cnt) / (SELECT count(*) FROM (SELECT DISTINCT y, m FROM fx_monthly)), 6)::DOUBLE AS monthly_avg FROM fx_monthly GROUP BY 1
-- query: year_totals uses: o_month
SELECT y, total, round(total / 12, 6)::DOUBLE AS monthly_avg, round(coalesce((total - b) / b * 100, 0), 6)::DOUBLE AS growth FROM (SELECT y, total, lag(total) OVER (ORDER BY y) AS b FROM (SELECT y, CAST(sum(total) AS BIGINT) AS total FROM o_month GROUP BY 1))
-- query: growth_metrics uses: o_month
WITH s AS (SELECT * FROM o_month WHERE y BETWEEN 1996 AND 2000), r AS (SELECT CAST(sum(total) FILTER (y = 2000) AS DOUBLE) / CAST(sum(total) FILTER (y = 1996) AS DOUBLE) AS r, CAST(sum(total) AS BIGINT) AS total FROM s)
SELECT round((r - 1) * 100, 6) AS growth_pct, round((pow(r, 0.25) - 1) * 100, 6) AS cagr_pct, r.total, (SELECT concat(y, '-', lpad(CAST(m AS VARCHAR), 2, '0')) FROM s ORDER BY total DESC, y, m LIMIT 1) AS peak_month, (SELECT concat(y, '-', lpad(CAST(m AS VARCHAR), 2, '0')) FROM s ORDER BY total, y, m LIMIT 1) AS lowest_month FROM r
-- query: year_month_matrix uses: o_month
SELECT y, CAST(coalesce(sum(total) FILTER (m = 1), 0) AS BIGINT) AS m01, CAST(coalesce(sum(total) FILTER (m = 2), 0) AS BIGINT) AS m02, CAST(coalesce(sum(total) FILTER (m = 3), 0) AS BIGINT) AS m03, CAST(coalesce(sum(total) FILTER (m = 4), 0) AS BIGINT) AS m04,
 CAST(coalesce(sum(total) FILTER (m = 5), 0) AS BIGINT) AS m05, CAST(coalesce(sum(total) FILTER (m = 6), 0) AS BIGINT) AS m06, CAST(coalesce(sum(total) FILTER (m = 7), 0) AS BIGINT) AS m07, CAST(coalesce(sum(total) FILTER (m = 8), 0) AS BIGINT) AS m08,
 CAST(coalesce(sum(total) FILTER (m = 9), 0) AS BIGINT) AS m09, CAST(coalesce(sum(total) FILTER (m = 10), 0) AS BIGINT) AS m10, CAST(coalesce(sum(total) FILTER (m = 11), 0) AS BIGINT) AS m11, CAST(coalesce(sum(total) FILTER (m = 12), 0) AS BIGINT) AS m12 FROM o_month GROUP BY 1
-- query: source_reconciliation uses: fx_orgs
SELECT 'rows' AS what, count(*) AS n_source, count(*) FILTER (city <> '') AS n_loaded, round(count(*) FILTER (city <> '') * 100.0 / count(*), 6)::DOUBLE AS share FROM fx_orgs
UNION ALL SELECT 'state', count(DISTINCT state), count(DISTINCT state) FILTER (city <> ''), round(count(DISTINCT state) FILTER (city <> '') * 100.0 / count(DISTINCT state), 6) FROM fx_orgs
UNION ALL SELECT 'city', count(DISTINCT city), count(DISTINCT city) FILTER (city <> ''), round(count(DISTINCT city) FILTER (city <> '') * 100.0 / count(DISTINCT city), 6) FROM fx_orgs
-- query: missing_states uses: fx_orgs
SELECT DISTINCT city FROM fx_orgs WHERE starts_with(city, 'City 3')
-- cte: o_hits uses: fx_orgs fx_registry o_in fx_certs
SELECT o.seq, 'JCI Database' AS source, 2 AS p, 1 AS n FROM fx_orgs o WHERE EXISTS (SELECT 1 FROM fx_registry r WHERE NOT r.verification_required AND lower(r.name) = lower(o.name))
UNION ALL SELECT o.seq, 'NABL Database', 1, 1 FROM fx_orgs o WHERE EXISTS (SELECT 1 FROM o_in r WHERE lower(r.name) = lower(o.name)) UNION ALL SELECT seq, 'ISO Database', 3, count(*) FROM fx_certs WHERE starts_with(name, 'ISO') GROUP BY 1
-- cte: o_evidence uses: fx_orgs o_hits
SELECT o.seq, CAST(coalesce(h.n, 0) AS BIGINT) AS n_certs, coalesce(h.s, '') AS sources, CASE WHEN h.n > 0 THEN 'validated' ELSE 'none' END AS status FROM fx_orgs o LEFT JOIN (SELECT seq, sum(n) AS n, string_agg(source, '; ' ORDER BY p) AS s FROM o_hits GROUP BY 1) h USING (seq)
-- query: evidence uses: o_evidence
SELECT seq, n_certs, sources, status FROM o_evidence
-- query: validated_reviews uses: o_evidence fx_reviews
SELECT seq, count(*) AS n_reviews FROM fx_reviews WHERE seq IN (SELECT seq FROM o_evidence WHERE status = 'validated') GROUP BY 1
-- query: org_initiatives uses: fx_orgs fx_initiatives
WITH k AS (SELECT * FROM (VALUES (1, 'apex hospital', 1, 'Hand Hygiene'), (1, 'apex hospital', 2, 'Research'), (2, 'royal', 1, 'Green Campus'), (3, 'no such', 1, 'Nothing')) t(no, key, pos, initiative)),
r AS (SELECT o.seq, coalesce(min(k.no) FILTER (lower(o.name) = k.key), min(k.no)) AS no FROM fx_orgs o JOIN k ON contains(lower(o.name), k.key) OR contains(k.key, lower(o.name)) GROUP BY 1)
SELECT seq, initiative, min(prio) AS prio FROM (SELECT seq, category AS initiative, 0 AS prio FROM fx_initiatives UNION ALL SELECT r.seq, k.initiative, 1 FROM r JOIN k ON k.no = r.no) GROUP BY 1, 2
-- query: suggestions uses: fx_orgs fx_typed o_sugg_key
WITH q AS (SELECT query_no, lower(trim(query)) AS q FROM fx_typed WHERE length(trim(query)) >= 2),
h AS (SELECT q.query_no, o.seq, o.name, k.key, CASE WHEN starts_with(lower(o.name), q.q) THEN 0 WHEN contains(lower(o.name), q.q) THEN 1 ELSE 2 END AS kind FROM fx_orgs o JOIN o_sugg_key k USING (seq) JOIN q ON contains(lower(concat(o.name, ' ', o.region)), q.q)),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_no, key ORDER BY kind, length(name), seq) = 1)
SELECT CAST(query_no AS BIGINT) AS query_no, place, seq, ['name_start', 'name_contains', 'original_name'][kind + 1] AS match_type FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY kind, replace(replace(lower(name), 'private limited', 'pvt. ltd.'), 'pvt ltd', 'pvt. ltd.'), seq) AS place FROM b) WHERE place <= 10
-- cte: o_sugg_tokens uses: fx_orgs
SELECT seq, list_filter(string_split_regex(regexp_replace(replace(replace(lower(name), 'private limited', 'pvt. ltd.'), 'pvt ltd', 'pvt. ltd.'), '\([^)]*\)', '', 'g'), '[,\-\s]+'), lambda t: t <> '') AS t, list_filter(string_split_regex(lower(concat(city, ', ', state)), '[,\-\s]+'), lambda t: t <> '') AS w FROM fx_orgs
-- cte: o_sugg_key uses: o_sugg_tokens
SELECT seq, concat(array_to_string(t[1:coalesce(list_max(list_transform(t, lambda x, i: CASE WHEN list_contains(list_concat(w, ['india']), x) THEN 0 ELSE i END)), 0)], ' '), '|', array_to_string(list_sort(w), ' ')) AS key FROM o_sugg_tokens
-- query: merged_suggestions uses: o_in o_base
WITH a AS (SELECT country AS q, name, row_number() OVER (PARTITION BY country ORDER BY seq) AS k FROM o_in), b AS (SELECT country AS q, name, row_number() OVER (PARTITION BY country ORDER BY seq) AS k FROM o_base),
h AS (SELECT q, 0 AS p, k, name FROM a WHERE k <= 4), u AS (SELECT * FROM h UNION ALL SELECT b.q, 1, b.k, b.name FROM b WHERE b.k <= 8 - (SELECT count(*) FROM h WHERE h.q = b.q)),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY q, lower(name) ORDER BY p, k) = 1)
SELECT q AS query_no, row_number() OVER (PARTITION BY q ORDER BY p, k) AS place, name FROM d QUALIFY place <= 8
-- cte: o_public uses: fx_orgs fx_certs
SELECT o.seq, o.seq % 4 <> 0 AS f, CASE WHEN o.seq % 4 <> 0 THEN (o.seq % 10) / 10 ELSE 0.2 END AS conf, coalesce(c.acc, 0) AS acc, coalesce(c.j, 0) AS j, coalesce(c.c, 0) AS c, coalesce(c.i9, 0) AS i9, coalesce(c.i15, 0) AS i15, coalesce(c.m, 0) AS m,
 CASE WHEN o.seq % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN o.seq % 3 = 0 THEN 10 ELSE 0 END AS q FROM fx_orgs o
LEFT JOIN (SELECT seq, sum(CASE pos % 6 WHEN 0 THEN 30 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 10 WHEN 4 THEN 20 ELSE 0 END) AS acc, max((pos % 6 = 0)::INT) AS j, max((pos % 6 = 1)::INT) AS c, max((pos % 6 = 3 AND contains(lower(name), 'iso 9001'))::INT) AS i9, max((pos % 6 = 3 AND contains(lower(name), 'iso 15189'))::INT) AS i15, max((pos % 6 = 4 OR (pos % 6 NOT IN (0, 1) AND contains(lower(name), 'magnet')))::INT) AS m FROM fx_certs GROUP BY 1) c USING (seq)
-- query: public_text_score uses: o_public
SELECT seq, round(CASE WHEN f THEN acc ELSE 0 END * conf, 6)::DOUBLE AS certification_score, round(CASE WHEN f THEN q ELSE 0 END * conf, 6)::DOUBLE AS quality_score, CAST(pen AS DOUBLE) AS mandatory_penalty,
 round(greatest(0, CASE WHEN f THEN (acc + q + 5) * conf ELSE 0 END - pen), 6)::DOUBLE AS total_score, CASE WHEN conf > 0.7 THEN 'High' WHEN conf > 0.4 THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM (SELECT *, CASE WHEN f THEN 40 * (1 - c) + 30 * (1 - j) + 25 * (1 - i9) + 25 * (1 - i15) + 25 * (1 - m) ELSE 145 END AS pen FROM o_public)
-- query: lab_points uses: fx_orgs
SELECT seq, CAST(CASE WHEN seq % 5 = 0 THEN 0 ELSE least(25, 15 + [5, 3, 1, 0][CAST(seq % 4 + 1 AS INT)] + CASE WHEN seq % 2 = 0 THEN 5 ELSE 0 END) END AS BIGINT) AS lab_points FROM fx_orgs
-- cte: o_iso uses: fx_certs
SELECT seq, pos, name, ['TUV', 'BSI', 'SGS'][CAST(pos % 3 + 1 AS INT)] AS body, pos % 4 <> 0 AS valid, CAST(expiry_ts AS DATE) AS e, (pos % 5 + 5) / 10 AS conf,
 CASE split_part(name, ':', 1) WHEN 'ISO 9001' THEN 15 WHEN 'ISO 15189' THEN 10 WHEN 'ISO 27001' THEN 10 WHEN 'ISO 45001' THEN 8 WHEN 'ISO 50001' THEN 4 ELSE 3 END AS w FROM fx_certs WHERE starts_with(name, 'ISO')
-- query: iso_summary uses: fx_orgs o_iso
SELECT o.seq, coalesce(t.n, 0) AS total_certs, CAST(coalesce(t.a, 0) AS BIGINT) AS active_certs, coalesce(t.s, '') AS standards, coalesce(t.b, '') AS bodies, CAST(t.i AS VARCHAR) AS earliest_issue, CAST(t.l AS VARCHAR) AS latest_expiry, round(coalesce(t.w, 0), 6)::DOUBLE AS score_impact FROM fx_orgs o
LEFT JOIN (SELECT seq, count(*) AS n, count(*) FILTER (valid) AS a, array_to_string(list_sort(list(DISTINCT name)), '|') AS s, array_to_string(list_sort(list(DISTINCT body)), '|') AS b, min(e - 1095) AS i, max(e) FILTER (valid) AS l, least(25, coalesce(sum(w * conf) FILTER (valid), 0)) AS w FROM o_iso GROUP BY 1) t USING (seq)
-- query: iso_lookup uses: fx_certs
SELECT name, count(*) AS n, CAST(CASE split_part(name, ':', 1) WHEN 'ISO 9001' THEN 12 WHEN 'ISO 15189' THEN 12 WHEN 'ISO 27001' THEN 10 WHEN 'ISO 45001' THEN 8 WHEN 'ISO 50001' THEN 4 ELSE 5 END AS BIGINT) AS impact,
 CASE split_part(name, ':', 1) WHEN 'ISO 9001' THEN 'High' WHEN 'ISO 15189' THEN 'Very High' WHEN 'ISO 27001' THEN 'High' WHEN 'ISO 45001' THEN 'High' WHEN 'ISO 50001' THEN 'Critical' ELSE 'Medium' END AS relevance,
 CASE split_part(name, ':', 1) WHEN 'ISO 9001' THEN 'Quality Management Systems' WHEN 'ISO 15189' THEN 'Medical Laboratories' WHEN 'ISO 27001' THEN 'Information Security Management' WHEN 'ISO 45001' THEN 'Occupational Health and Safety Management' WHEN 'ISO 50001' THEN 'Energy Management Systems' ELSE 'International standard for quality and management systems' END AS description
FROM fx_certs WHERE starts_with(name, 'ISO') GROUP BY 1
-- query: directory_scores uses: fx_orgs
SELECT seq, round(least(10, 1 + CASE WHEN seq % 4 = 0 THEN 2.5 WHEN seq % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN seq % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END + seq % 6 * 0.5 + seq % 7 * 0.3), 6)::DOUBLE AS directory_score,
 CAST(least(100, CASE WHEN seq % 4 = 0 THEN 30 WHEN seq % 8 = 2 THEN 20 ELSE 0 END + CASE WHEN seq % 3 = 1 THEN 25 ELSE 0 END + CASE WHEN seq % 2 = 1 THEN 15 ELSE 0 END + CASE WHEN seq % 5 IN (1, 2) THEN 10 ELSE 0 END + CASE WHEN seq % 9 = 0 THEN 10 ELSE 0 END) AS DOUBLE) AS strategy_score,
 CAST(least(95, 75 + 5 + CASE WHEN phone <> '' THEN 3 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 7 ELSE 0 END + 5) AS DOUBLE) AS basic_score, CAST(least(95, 85 + CASE WHEN phone <> '' THEN 5 ELSE 0 END + CASE WHEN length(concat(city, ', ', state, ', ', country)) > 20 THEN 5 ELSE 0 END + 5) AS DOUBLE) AS improved_score,
 CAST(least(98, 90 + CASE WHEN phone <> '' THEN 3 ELSE 0 END + CASE WHEN length(concat(city, ', ', state, ', ', country)) > 20 THEN 2 ELSE 0 END + 3 + CASE WHEN seq % 6 = 0 THEN 0 ELSE 1 END) AS DOUBLE) AS final_score FROM fx_orgs
-- query: edition_impact uses: fx_certs
SELECT status, r AS remarks, count(*) AS n, CASE WHEN r = '' THEN 'Standard' ELSE left(r, 11) END AS edition, CAST(CASE WHEN status = 'Active' THEN CASE WHEN r LIKE '6th%' THEN 20 WHEN r LIKE '5th%' THEN 18 ELSE 15 END WHEN status = 'Expired' THEN 4.5 ELSE 7.5 END AS DOUBLE) AS impact
FROM (SELECT status, ['6th Edition', '5th Edition ok', '4th Edition', ''][CAST(pos % 4 + 1 AS INT)] AS r FROM fx_certs) GROUP BY 1, 2
-- query: improvement_advice uses: o_scored
SELECT kind, advice, count(*) AS n_orgs FROM (SELECT 'priority' AS kind, 'Pursue JCI Accreditation' AS advice FROM o_scored WHERE certification_score < 50 UNION ALL SELECT 'priority', 'Implement Patient Safety Initiatives' FROM o_scored WHERE initiative_score < 15
 UNION ALL SELECT 'initiative', a FROM o_scored, (VALUES ('Clinical Excellence Program'), ('Technology Innovation Initiative'), ('Staff Development Program')) t(a) WHERE initiative_score < 20
 UNION ALL SELECT 'operations', 'Establish comprehensive quality management framework' FROM o_scored WHERE active_certs < 3 UNION ALL SELECT 'operations', 'Implement real-time quality metrics dashboard' FROM o_scored WHERE total_score < 80
 UNION ALL SELECT 'operations', 'Standardize quality protocols across all locations' FROM o_scored WHERE seq % 5 = 0 UNION ALL SELECT 'strategy', 'Excellence Recognition Program' FROM o_scored WHERE total_score >= 80 UNION ALL SELECT 'strategy', 'Quality Transformation Initiative' FROM o_scored WHERE total_score < 70) GROUP BY 1, 2
-- query: certification_gaps uses: fx_orgs o_cert
SELECT o.seq, s.standard FROM fx_orgs o CROSS JOIN (VALUES ('CAP'), ('ISO 9001'), ('ISO 15189'), ('ISO 27001'), ('ISO 45001'), ('ISO 13485'), ('ISO 14001'), ('JCI'), ('NABH'), ('NABL'), ('ISO 50001')) s(standard)
WHERE NOT EXISTS (SELECT 1 FROM o_cert c WHERE c.seq = o.seq AND c.st = 'Active' AND contains(c.up, s.standard))
-- query: score_potential uses: o_scored
SELECT seq, round(110 - total_score, 6) AS potential, round(CAST(greatest(0, 75 - certification_score) AS DOUBLE), 6) AS cert_potential, round(CAST(greatest(0, 35 - initiative_score) AS DOUBLE), 6) AS initiative_potential FROM o_scored
-- query: international_advice uses: o_scored o_cert
WITH t AS (SELECT seq, max((up LIKE '%JCI%' OR up LIKE '%JOINT COMMISSION INTERNATIONAL%' OR up LIKE '%MAGNET%')::INT) AS g, max(regexp_matches(up, 'ISO ?(9001|13485|15189|27001|45001|14001|50001)')::INT) AS i FROM o_cert GROUP BY 1),
a AS (SELECT 'priority' AS kind, unnest(CASE WHEN total_score < 30 THEN ['Pursue JCI (Joint Commission International) accreditation for global recognition', 'Implement ISO 9001 Quality Management System as foundation', 'Establish patient safety initiatives aligned with WHO guidelines', 'Develop quality improvement programs with measurable outcomes']
 WHEN total_score < 60 THEN ['Expand ISO certification portfolio (ISO 13485, 15189, 27001)', 'Implement advanced patient experience programs', 'Pursue regional excellence accreditation (Joint Commission, CQC, etc.)', 'Develop international collaboration partnerships']
 ELSE ['Pursue Magnet Recognition for nursing excellence', 'Implement Planetree patient-centered care model', 'Establish WHO Collaborating Centre status', 'Lead international healthcare quality initiatives'] END) AS advice FROM o_scored
 UNION ALL SELECT 'opportunity', 'Joint Commission International (JCI)' FROM o_scored LEFT JOIN t USING (seq) WHERE coalesce(g, 0) = 0
 UNION ALL SELECT 'opportunity', x FROM o_scored LEFT JOIN t USING (seq), (VALUES ('ISO 9001 Quality Management'), ('ISO 13485 Medical Devices')) v(x) WHERE coalesce(i, 0) = 0)
SELECT kind, advice, count(*) AS n_orgs FROM a GROUP BY 1, 2
-- query: certification_advice uses: o_intl_score fx_certs
WITH c AS (SELECT seq, count(*) FILTER (upper(name) LIKE '%ISO%') AS n FROM fx_certs GROUP BY 1)
SELECT 'Pursue JCI Accreditation' AS advice, count(*) AS n_orgs FROM o_intl_score WHERE global_standards = 0 UNION ALL SELECT 'Implement ISO Quality Management Systems', count(*) FROM o_intl_score LEFT JOIN c USING (seq) WHERE coalesce(n, 0) < 3
-- cte: o_bc0 uses: o_unique_certs
SELECT seq, min(pos) OVER (PARTITION BY seq, cert_key) AS pos, name, upper(name) AS up, status, coalesce(score_impact, 0) AS impact FROM o_unique_certs QUALIFY row_number() OVER (PARTITION BY seq, cert_key ORDER BY coalesce(score_impact, 0) DESC, length(concat(name, status)) DESC, pos) = 1
-- cte: o_bc uses: o_bc0 o_cert
SELECT b.seq, b.pos, b.name, b.up, k.kind, b.impact, CASE WHEN b.status IN ('Active', 'Accredited') THEN 'Active' WHEN b.status = 'Pending' THEN 'In Progress' ELSE b.status END AS st FROM o_bc0 b JOIN (SELECT DISTINCT name, kind FROM o_cert) k USING (name)
-- cte: o_bc_all uses: o_bc
SELECT seq, kind, up, st, CAST(impact AS DOUBLE) AS impact FROM o_bc UNION ALL SELECT seq, 'ISO_15189', 'ISO 15189 (IMPLIED BY NABL)', 'Active', 22 FROM o_bc GROUP BY seq HAVING count(*) FILTER (up LIKE '%NABL%' AND st = 'Active') > 0 AND count(*) FILTER (regexp_matches(up, 'ISO ?15189')) = 0
-- cte: o_bc_pen uses: fx_orgs o_bc o_std
SELECT seq, sum(CASE WHEN ok THEN 0 WHEN standard = 'ISO 15189' AND cap > 0 THEN 0 WHEN starts_with(standard, 'ISO') AND standard <> 'ISO 50001' AND cap + us > 0 THEN greatest(1, floor(full_penalty / 2)) ELSE full_penalty END) AS pen FROM (
 SELECT o.seq, s.standard, s.full_penalty, coalesce(u.cap, 0) AS cap, coalesce(u.us, 0) AS us, coalesce((SELECT arg_max(c.st, c.pos) FROM o_bc c WHERE c.seq = o.seq AND CASE s.standard WHEN 'CAP' THEN c.up LIKE '%CAP%' OR c.up LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%' WHEN 'JCI' THEN c.up LIKE '%JOINT COMMISSION%' ELSE regexp_matches(c.up, replace(s.standard, ' ', ' ?')) END), '') = 'Active' AS ok
 FROM fx_orgs o CROSS JOIN o_std s LEFT JOIN (SELECT seq, count(*) FILTER (up LIKE '%CAP%' OR up LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%') AS cap, count(*) FILTER (up LIKE '%JOINT COMMISSION%' AND up NOT LIKE '%INTERNATIONAL%') AS us FROM o_bc GROUP BY 1) u USING (seq)) GROUP BY 1
-- query: batch_scores uses: fx_orgs o_bc_all o_weights o_bc_pen o_unique_certs
WITH p AS (SELECT a.seq, count(*) FILTER (st IN ('Active', 'In Progress')) AS n, sum(impact * weight * CASE st WHEN 'Active' THEN 1.0 WHEN 'In Progress' THEN 0.5 ELSE 0 END) AS pts, count(*) FILTER (st = 'Active' AND regexp_matches(up, 'JCI|ISO|JOINT COMMISSION|MAGNET')) AS k, count(*) FILTER (regexp_matches(up, 'NABH|JCI|CAP|ISO|NABL')) AS rec FROM o_bc_all a JOIN o_weights USING (kind) GROUP BY 1),
s AS (SELECT o.seq, least(75, coalesce(pts, 0) + CASE WHEN n > 1 THEN least(2 * n, 10) ELSE 0 END + least(3 * coalesce(k, 0), 12)) AS cs, coalesce(rec, 0) AS rec, pen FROM fx_orgs o LEFT JOIN p USING (seq) JOIN o_bc_pen USING (seq))
SELECT s.seq, coalesce(c.n, 0) AS certification_count, round(CAST(cs AS DOUBLE), 6) AS certification_score, round(CAST(CASE WHEN rec > 0 AND greatest(0, cs - pen) < 12 THEN 12 ELSE greatest(0, cs - pen) END AS DOUBLE), 6) AS total_score
FROM s LEFT JOIN (SELECT seq, count(*) FILTER (status IN ('Active', 'Accredited')) AS n FROM o_unique_certs GROUP BY 1) c USING (seq)
-- cte: o_reg3 uses: o_keys
SELECT seq, registry_key AS k1, trim(regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' ', country, name)), '\b(ltd|limited|pvt|private|inc|incorporated|corp|corporation|co|company|hospital|hospitals|healthcare|medical|centre|center|institute|clinic)\b\.?', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS k2 FROM o_keys WHERE data_source = 'supplier'
-- query: match_report uses: o_keys o_reg3
WITH p AS (SELECT a.seq, max((contains(b.k1, a.registry_key) OR contains(b.k2, a.registry_key))::INT) AS d, max(len(list_intersect(list_distinct(string_split(a.registry_key, ' ')), list_distinct(string_split(b.k1, ' ')))) * 1.0 / len(list_distinct(list_concat(string_split(a.registry_key, ' '), string_split(b.k1, ' '))))) AS s FROM o_keys a CROSS JOIN o_reg3 b GROUP BY 1)
SELECT count(*) AS n_orgs, count(*) FILTER (d = 1 OR s > 0.7) AS n_matched, round(count(*) FILTER (d = 1 OR s > 0.7) / count(*) * 100, 6) AS match_pct, count(*) FILTER (d = 1) AS n_high, count(*) FILTER (d = 0 AND s > 0.8) AS n_medium, count(*) FILTER (d = 0 AND s > 0.7 AND s <= 0.8) AS n_low FROM p
-- cte: o_lab_final uses: o_lab_clean
SELECT seq, CASE WHEN regexp_matches(l, 'hospital|nursing home') THEN 'Hospital' WHEN regexp_matches(l, 'laboratory|labs|diagnostics|pathology') THEN 'Laboratory' WHEN regexp_matches(l, 'clinic|center') THEN 'Clinic' WHEN contains(l, 'institute') THEN 'Institute' ELSE 'Laboratory' END AS kind,
 CASE WHEN seq % 4 = 0 THEN [city] WHEN seq % 3 = 0 THEN ['Pune'] WHEN seq % 3 = 2 THEN ['Agra', 'Noida'] ELSE [] END AS places,
 40 + least(30, 10 * (contains(l, 'hospital')::INT + contains(l, 'clinic')::INT + contains(l, 'laboratory')::INT + contains(l, 'labs')::INT + contains(l, 'medical')::INT + contains(l, 'healthcare')::INT + contains(l, 'diagnostics')::INT + contains(l, 'pathology')::INT + contains(l, 'center')::INT + contains(l, 'institute')::INT + contains(l, 'nursing')::INT + contains(l, 'dental')::INT + contains(l, 'eye')::INT + contains(l, 'cancer')::INT))
  + CASE WHEN seq % 4 = 0 OR seq % 3 <> 1 THEN 15 ELSE 0 END + CASE WHEN phone <> '' THEN 10 ELSE 0 END + CASE WHEN seq % 3 = 0 THEN 5 ELSE 0 END AS conf
FROM (SELECT *, lower(cname) AS l FROM o_lab_clean WHERE NOT regexp_matches(lname, '(?i)^National') QUALIFY row_number() OVER (PARTITION BY lower(cname) ORDER BY seq) = 1)
-- query: lab_cleaning_report uses: o_lab_final
SELECT 'confidence' AS what, CASE WHEN conf >= 80 THEN 'high' WHEN conf >= 60 THEN 'medium' ELSE 'low' END AS value, count(*) AS n FROM o_lab_final GROUP BY 2 UNION ALL SELECT 'type', kind, count(*) FROM o_lab_final GROUP BY 2
UNION ALL (SELECT 'location', p, count(*) AS n FROM (SELECT unnest(places) AS p FROM o_lab_final) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20)
