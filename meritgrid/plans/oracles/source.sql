-- query: parsed_documents uses: fx_orgs
SELECT seq, name, city, country, website FROM fx_orgs WHERE seq % 4 < 3 UNION ALL SELECT seq, name, city, country, website FROM fx_orgs WHERE seq % 4 < 2
-- query: recovered_documents uses: fx_orgs
SELECT seq, name, '' AS website, city AS address FROM fx_orgs WHERE seq % 4 = 3 AND city <> ''
-- query: source_fallback uses: fx_orgs
SELECT seq, name, city FROM fx_orgs WHERE data_source = 'supplier'
-- query: source_union uses: fx_orgs
SELECT CASE WHEN data_source = 'customer' THEN 'main' ELSE 'extra' END AS source_name, CASE WHEN data_source = 'customer' THEN 0 ELSE 1 END AS source_priority, count(*) AS n, count(*) FILTER (data_source = 'customer') AS n_city, count(*) FILTER (data_source = 'supplier') AS n_state FROM fx_orgs GROUP BY 1, 2
-- query: payload_rows uses: fx_orgs
SELECT seq, name, CASE WHEN seq % 2 = 0 THEN state ELSE 'Unknown' END AS state, CASE WHEN seq % 2 = 1 AND city <> '' THEN city END AS address, CASE WHEN seq % 2 = 1 AND phone <> '' THEN phone END AS phone FROM fx_orgs
-- query: external_rows uses: fx_orgs
SELECT seq, name, CASE WHEN city = '' THEN 'Town' ELSE city END AS city, country, hospital_type FROM fx_orgs
-- query: hospital_csv_rows uses: fx_orgs
SELECT seq, name, city, phone AS address, CASE WHEN seq % 4 <> 0 THEN CAST(seq % 900000 AS VARCHAR) ELSE '' END AS pincode, (phone <> '')::INT AS has_address, (seq % 4 <> 0)::INT AS has_pincode FROM fx_orgs WHERE seq % 6 <> 0
-- query: rural_rows uses: fx_orgs
SELECT seq, name, city, state, 'Rural Hospital' AS hospital_type FROM fx_orgs
-- query: upload_rows uses: fx_orgs
SELECT seq, name, country, city, state, CASE WHEN contains(l, 'general') THEN 'General Hospital' WHEN contains(l, 'private') THEN 'Private Hospital' WHEN contains(l, 'clinic') THEN 'Medical Clinic' WHEN contains(l, 'medical center') THEN 'Medical Center' ELSE name END AS hospital_type,
 seq % 50 AS bed_count, 'Eye|Heart' AS specialties, CASE seq % 4 WHEN 0 THEN 'ISO 9001|College of American Pathologists (CAP)' WHEN 1 THEN 'Joint Commission International (JCI)' WHEN 2 THEN '' ELSE 'Green' END AS certs, CAST(CASE seq % 4 WHEN 0 THEN 20 WHEN 1 THEN 35 WHEN 2 THEN 0 ELSE 5 END AS DOUBLE) AS impact
FROM (SELECT *, lower(name) AS l FROM fx_orgs WHERE seq % 7 <> 0)
-- cte: o_kw uses: fx_orgs
SELECT *, list_filter(regexp_extract_all(lower(name), '\w+'), lambda w: length(w) > 2) AS t3 FROM fx_orgs
-- query: jci_rows uses: o_kw
SELECT seq, name, CASE WHEN seq % 3 = 0 THEN hospital_type ELSE 'General Hospital' END AS hospital_type, region, 'JCI Accreditation' AS cert_type, '2020-01-01' AS cert_accreditation_date, 20.0::DOUBLE AS impact,
 len(list_distinct(list_concat([lower(name)], t3, CASE WHEN len(list_filter(t3, lambda w: length(w) > 3)) > 1 THEN [array_to_string(list_transform(list_filter(t3, lambda w: length(w) > 3), lambda w: w[1]), '')] ELSE [] END, [lower(country)]))) AS n_keywords FROM o_kw
-- query: entry_level_rows uses: fx_orgs
SELECT seq, n AS name, name AS full_name, CASE WHEN contains(l, 'cancer') THEN 'Cancer Specialty' WHEN contains(l, 'cardiac') THEN 'Cardiac Specialty' WHEN contains(l, 'eye') THEN 'Eye Specialty' WHEN contains(l, 'kidney') THEN 'Nephrology Specialty' WHEN contains(l, 'women') THEN 'Women & Child Specialty'
  WHEN contains(l, 'child') THEN 'Pediatric Specialty' WHEN contains(l, 'ortho') THEN 'Orthopedic Specialty' WHEN contains(l, 'neuro') THEN 'Neurology Specialty' WHEN contains(l, 'district') THEN 'Government Hospital' WHEN contains(l, 'nursing home') THEN 'Nursing Home' WHEN contains(l, 'clinic') THEN 'Clinic' ELSE 'General Hospital' END AS hospital_type,
 CAST(CASE WHEN seq % 2 = 0 THEN 15 ELSE 0 END AS DOUBLE) AS impact, CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS current_flag FROM (SELECT *, split_part(name, ', ', 1) AS n, lower(split_part(name, ', ', 1)) AS l FROM fx_orgs)
-- query: updated_portal_rows uses: fx_orgs
SELECT seq, name, city, 'Updated_NABH_Portal' AS data_source, CAST(seq % 100 AS DOUBLE) AS quality_score, 'Approved' AS cert_status, 'N1' AS cert_accreditation_no FROM fx_orgs
-- cte: o_feed uses: fx_orgs
SELECT *, concat_ws(' ', name, ['Kerala', '', 'New Delhi'][CAST(seq % 3 + 1 AS INT)]) AS fname FROM fx_orgs
-- query: lab_feed_rows uses: o_feed
SELECT seq, city, ['Kerala', '', 'Delhi'][CAST(seq % 3 + 1 AS INT)] AS state, CASE WHEN seq % 2 = 0 THEN 'Inactive' ELSE 'Active' END AS cert_status, phone AS cert_accreditation_no, CAST(seq % 2 AS INT) AS valid_flag,
 len(list_distinct(list_filter(list_concat([lower(fname)], t3, CASE WHEN len(t3) > 2 THEN [array_to_string(list_transform(t3, lambda w: w[1]), '')] ELSE [] END, [lower(city)], ['healthcare', 'medical', 'laboratory', 'testing', 'nabl']), lambda x: x <> ''))) AS n_keywords
FROM (SELECT *, list_filter(regexp_extract_all(lower(fname), '\w+'), lambda w: length(w) > 2) AS t3 FROM o_feed)
-- query: pathology_rows uses: fx_orgs
SELECT seq, CASE WHEN seq % 5 = 0 THEN 'Ring 7' ELSE ['Rochester', 'Eau Claire', 'Fresno', 'Lima'][CAST(seq % 4 + 1 AS INT)] END AS city, ['United States', 'Germany', 'Peru'][CAST(seq % 3 + 1 AS INT)] AS country, ['Americas', 'Europe', 'Unknown'][CAST(seq % 3 + 1 AS INT)] AS region,
 CASE WHEN seq % 2 = 0 THEN 'ISO 15189' ELSE 'ISO 15189 Medical Laboratory Accreditation' END AS cert_name, 'Active' AS cert_status, '2025-01-01' AS cert_accreditation_date FROM fx_orgs
-- query: dental_rows uses: fx_orgs
SELECT seq, CASE WHEN len(p) >= 3 THEN p[-3] ELSE 'Unknown' END AS city, p[-2] AS state, CAST(10 * (2 + CASE WHEN phone <> '' THEN 2 ELSE 0 END + 1 + CASE WHEN city <> '' THEN 2 ELSE 0 END + 1 + 1) AS DOUBLE) AS quality_score, round((5 + (phone <> '')::INT + (city <> '')::INT) / 7 * 100, 2)::DOUBLE AS data_completeness
FROM (SELECT *, string_split(concat_ws(', ', name, CASE WHEN city <> '' THEN city END, CASE WHEN seq % 2 = 0 THEN state END, 'India'), ', ') AS p FROM fx_orgs)
-- query: map_export_rows uses: fx_orgs
SELECT seq, name, CASE WHEN city <> '' THEN city END AS city, 'India' AS country, CAST(seq % 90 AS DOUBLE) AS lat, CAST(seq % 90 + CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS lon FROM fx_orgs WHERE seq % 5 <> 0
-- query: point_rows uses: fx_orgs
SELECT seq, name, country, CASE WHEN seq % 3 <> 0 THEN CAST(seq % 90 + 0.25 AS DOUBLE) END AS lat, CASE WHEN seq % 3 <> 0 THEN CAST(seq % 180 + 0.5 AS DOUBLE) END AS lon FROM fx_orgs
-- query: registry_defaults uses: fx_orgs
SELECT seq, CASE WHEN seq % 2 = 0 THEN region ELSE ['Asia-Pacific', 'Americas', 'Unknown'][CAST(seq % 3 + 1 AS INT)] END AS region, 'international_accreditation=false;jci_accredited=false;nabh_accredited=true' AS flags FROM fx_orgs
-- query: portal_to_unified uses: o_loc_parts
SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(loc, ',\s*[A-Za-z\s]+,\s*[A-Za-z\s]+,\s*India$', ''), ',\s*[A-Za-z\s]+,\s*India$', ''), ',\s*India$', '')) AS name, CASE WHEN n >= 4 THEN p[-3] ELSE '' END AS city, CASE WHEN n >= 3 THEN p[-2] ELSE '' END AS state, CASE WHEN n >= 3 THEN p[-1] ELSE 'India' END AS country,
 CASE WHEN contains(l, 'cardiac') THEN 'Cardiac Specialty' WHEN contains(l, 'cancer') THEN 'Cancer Specialty' WHEN contains(l, 'eye') THEN 'Eye Specialty' WHEN contains(l, 'ortho') THEN 'Orthopedic Specialty' WHEN contains(l, 'neuro') THEN 'Neurological Specialty' WHEN contains(l, 'women') THEN 'Women & Child Specialty' WHEN contains(l, 'institute') THEN 'Teaching Hospital' ELSE 'General Hospital' END AS hospital_type,
 ['6th Edition', 'Standard', '5th Edition', '4th Edition'][CAST(seq % 4 + 1 AS INT)] AS accreditation_level, ['2015-05-04T00:00:00', '2016-01-01'][CAST(seq % 2 + 1 AS INT)] AS cert_accreditation_date, '2021-10-30T00:00:00' AS cert_expiry_date,
 CAST(CASE seq % 3 WHEN 0 THEN [20, 15, 18, 15][CAST(seq % 4 + 1 AS INT)] WHEN 1 THEN 4.5 ELSE 7.5 END AS DOUBLE) AS impact FROM (SELECT *, lower(loc) AS l FROM o_loc_parts)
-- query: flattened_regions uses: fx_orgs
SELECT region, 'Known registry' AS source, count(*) AS n, count(DISTINCT name) AS n_names FROM (SELECT region, name FROM fx_orgs UNION ALL SELECT 'Second', upper(name) FROM fx_orgs UNION ALL SELECT 'Second', name FROM fx_orgs) GROUP BY 1
-- query: ranking_rows uses: o_rank
SELECT overall_rank AS rank, replace(name, ',', ';') AS name, country, total_score, active_certs AS certification_count FROM o_rank
-- query: audit_rows uses: fx_orgs o_unique_certs
WITH c AS (SELECT seq, sum(n) AS n, string_agg(name, '; ' ORDER BY p, name) AS names, max((name LIKE '%JCI%')::INT) AS j FROM (SELECT seq, name, min(pos) AS p, count(*) AS n FROM o_unique_certs GROUP BY 1, 2) GROUP BY 1)
SELECT seq AS id, o.name, concat(data_source, '; ', region) AS sources, CAST(2 AS BIGINT) AS source_count, CAST(coalesce(c.n, 0) AS BIGINT) AS certifications_count, coalesce(c.names, '') AS certification_names, CASE WHEN c.j = 1 THEN 'yes' ELSE 'no' END AS has_jci FROM fx_orgs o LEFT JOIN c USING (seq)
-- query: status_columns uses: fx_orgs
SELECT seq, CASE WHEN seq % 2 = 0 THEN 'Accredited' ELSE 'Applied' END AS nabh_status, CASE WHEN seq % 3 = 0 THEN 'Unknown' END AS jci_status FROM fx_orgs
