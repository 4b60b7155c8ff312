-- cte: o_raw uses: fx_orgs
SELECT *, concat(['', 'Dr. ', '  ', '(', 'ms '][CAST(seq % 5 + 1 AS INT)], name, [' Hosp. Pvt Ltd', ' AND CHILD', 'CareUnit', ' Ltd.', ' of the lab.', '.,'][CAST(seq % 6 + 1 AS INT)]) AS raw,
 concat(split_part(name, ',', 1), CASE WHEN city <> '' THEN concat(', ', city) ELSE '' END, ', ', ['Goa', 'Tamil Nadu', 'Kerala'][CAST(seq % 3 + 1 AS INT)], [', India', ', Nepal', '', ', india'][CAST(seq % 4 + 1 AS INT)], CASE WHEN seq % 9 = 0 THEN ' (Punjab)' ELSE '' END) AS loc,
 concat(CASE WHEN seq % 5 = 0 THEN concat('Ring 7, ', ['Rochester', 'Eau Claire', 'Fresno', 'Lima'][CAST(seq % 4 + 1 AS INT)], ', Germany')
   ELSE concat(seq % 900 + 100, ' Main Street, ', ['Rochester', 'Eau Claire', 'Fresno', 'Lima'][CAST(seq % 4 + 1 AS INT)], ', ', ['MN', 'OH', 'CA'][CAST(seq % 3 + 1 AS INT)], ' 55', lpad(CAST(seq % 1000 AS VARCHAR), 3, '0')) END,
   CASE WHEN phone <> '' THEN concat(' ', phone) ELSE '' END) AS addr FROM fx_orgs
-- cte: o_squeezed uses: o_raw
SELECT seq, raw, loc, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS sq, trim(regexp_replace(loc, '\s+', ' ', 'g')) AS sl FROM o_raw
-- query: clean_names uses: o_squeezed
SELECT seq,
 array_to_string(list_transform(string_split(regexp_replace(sq, '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda w: CASE WHEN regexp_matches(w, '[A-Za-z]') AND (w = upper(w) OR w = lower(w))
   THEN array_to_string(list_transform(regexp_extract_all(lower(w), '([a-z]+|[^a-z]+)'), lambda r: concat(upper(r[1]), r[2:])), '') ELSE w END), ' ') AS tidy_name,
 array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
   replace(replace(trim(sq, '.,;:-_()[]{}|'), 'Hospitall', 'Hospital'), 'Medicall', 'Medical'),
   '\bPvt\.?\s*Ltd\.?', 'Private Limited', 'gi'), '\bLtd\.?', 'Limited', 'gi'), '\bHosp\.?', 'Hospital', 'gi'), '\bLab\.?', 'Laboratory', 'gi'), '\bMed\.?', 'Medical', 'gi'), '\bClin\.?', 'Clinic', 'gi'),
   '\bDiag\.?', 'Diagnostics', 'gi'), '\bPath\.?', 'Pathology', 'gi'), '\s+'), lambda w: w <> ''),
   lambda w: CASE WHEN lower(w) IN ('and', 'of', 'the', 'for', 'in', 'at', 'by', 'with') THEN lower(w) ELSE concat(upper(w[1]), lower(w[2:])) END), ' ') AS registry_name,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sq, '^(Dr\.?|Mr\.?|Ms\.?|Mrs\.?)\s+', '', 'i'),
   '\bPvt\.?\s*Ltd\.?', 'Private Limited', 'gi'), '\bLtd\.?', 'Limited', 'gi'), '\bHosp\.?', 'Hospital', 'gi'), '\bLab\.?', 'Laboratory', 'gi'), '\bMed\.?', 'Medical', 'gi'), '\bClin\.?', 'Clinic', 'gi')) AS document_name,
 replace(replace(replace(replace(rtrim(sq, '.,'), ' Pvt Ltd', ' Private Limited'), ' Ltd.', ' Limited'), ' Hosp.', ' Hospital'), ' Med.', ' Medical') AS portal_name,
 trim(regexp_replace(regexp_replace(regexp_replace(sl, ',\s*[A-Za-z\s]+,\s*[A-Za-z\s]+,\s*India$', ''), ',\s*[A-Za-z\s]+,\s*India$', ''), ',\s*India$', '')) AS short_name,
 regexp_replace(trim(regexp_replace(concat(raw, ' #1 & <b>!'), '\s+', ' ', 'g')), '[^\w\s\-\.,;:()]', '', 'g') AS clean_text
FROM o_squeezed
-- cte: o_loc_parts uses: o_raw
SELECT *, list_transform(string_split(loc, ','), lambda x: trim(x)) AS p, len(string_split(loc, ',')) AS n FROM o_raw
-- query: place_parts uses: o_loc_parts
SELECT seq, concat(CASE WHEN n >= 3 THEN p[-3] ELSE '' END, '|', CASE WHEN n >= 2 THEN p[-2] ELSE '' END, '|', p[-1]) AS parts,
 concat(CASE WHEN n >= 4 THEN p[-3] ELSE '' END, '|', CASE WHEN n >= 3 THEN p[-2] ELSE '' END, '|', CASE WHEN n >= 3 THEN p[-1] ELSE 'India' END) AS inside,
 concat(CASE WHEN lower(p[-1]) <> 'india' OR n < 3 THEN 'Unknown' WHEN n >= 4 THEN p[-3] ELSE p[-2] END, '|', CASE WHEN lower(p[-1]) <> 'india' OR n < 3 THEN 'Unknown' ELSE p[-2] END, '|', array_to_string(p[2:], ', ')) AS listed,
 CASE WHEN seq % 9 = 0 THEN 'Punjab' WHEN lower(p[-1]) <> 'india' OR n < 3 THEN 'Unknown' ELSE p[-2] END AS bracketed_state FROM o_loc_parts
-- cte: o_where uses: o_raw
SELECT seq, loc, name, CASE WHEN city <> '' AND state <> '' THEN CASE WHEN state = 'Unknown' THEN city ELSE concat(city, ', ', state) END ELSE CASE WHEN country = region THEN country ELSE concat(country, ', ', region) END END AS w FROM o_raw
-- cte: o_bare uses: o_where
SELECT *, list_filter(string_split_regex(regexp_replace(trim(regexp_replace(regexp_replace(lower(loc), '\([^)]*\)', '', 'g'), '\s+', ' ', 'g')), '\s*[-–—]\s*', ' ', 'g'), '[,\-\s]+'), lambda t: t <> '') AS t,
 list_filter(string_split_regex(lower(w), '[,\-\s]+'), lambda t: t <> '') AS wt FROM o_where
-- cte: o_bare2 uses: o_bare
SELECT seq, w, wt, array_to_string(t[1:coalesce(list_max(list_transform(t, lambda x, i: CASE WHEN list_contains(list_concat(wt, ['india', 'bharat']), x) THEN 0 ELSE i END)), 0)], ' ') AS bare FROM o_bare
-- query: tidy_locations uses: o_bare2
SELECT seq, w AS location, bare AS bare_name, concat(bare, ' - ', w) AS display_line, concat(replace(replace(bare, 'private limited', 'pvt. ltd.'), 'pvt ltd', 'pvt. ltd.'), '|', array_to_string(list_sort(wt), ' ')) AS suggestion_key FROM o_bare2
-- query: states_and_countries uses: fx_orgs
SELECT seq, ['Tamil Nadu', 'Odisha', 'Chhattisgarh', 'Goa', 'Jammu and Kashmir', 'Unknown', 'Bangalore', 'Sindh'][i] AS known_state,
 ['Tamilnadu', 'orissa', 'Chhattisgarh', 'GOA', 'jammu and kashmir', 'n/a', 'Karnataka', 'Sindh'][i] AS plain_state,
 CASE WHEN i = 4 THEN 'Goa' WHEN contains(a, 'tn') THEN 'Tamil Nadu' WHEN contains(a, 'ap') THEN 'Andhra Pradesh' WHEN contains(a, 'ts') THEN 'Telangana' WHEN contains(a, 'ka') THEN 'Karnataka' WHEN contains(a, 'mh') THEN 'Maharashtra'
  WHEN contains(a, 'dl') THEN 'Delhi' WHEN contains(a, 'up') THEN 'Uttar Pradesh' WHEN contains(a, 'wb') THEN 'West Bengal' ELSE 'Unknown' END AS address_state,
 CASE WHEN i = 4 THEN 'Goa' ELSE '' END AS name_state,
 ['Bangladesh', 'India', 'India', 'Saudi Arabia', 'India'][j] AS name_country, ['Unknown', 'UK', 'Unknown', 'Unknown', 'Unknown'][j] AS place_country,
 CASE WHEN contains(lower(city), 'city 1') THEN 'united states' ELSE 'india' END AS region_key, CASE WHEN j = 3 THEN 'Pune' ELSE '' END AS cities
FROM (SELECT *, CAST(seq % 8 + 1 AS INT) AS i, CAST(seq % 5 + 1 AS INT) AS j, lower(concat(name, ' ', ['Tamilnadu', 'orissa', 'Chattisgarh', 'GOA', 'jammu and  kashmir', 'n/a', 'Bangalore', 'Sindh'][CAST(seq % 8 + 1 AS INT)])) AS a FROM fx_orgs)
-- query: address_parts uses: o_raw
SELECT seq, CASE WHEN seq % 5 = 0 THEN 'Ring 7' ELSE c END AS city_found, CASE WHEN seq % 5 = 0 THEN '' ELSE z END AS zip_found,
 CASE WHEN seq % 5 = 0 THEN '||Germany' ELSE concat(s, '|', z, '|United States') END AS us_place, CASE WHEN seq % 5 = 0 THEN '||' ELSE concat(c, '|', s, '|', z) END AS triple,
 CASE WHEN phone <> '' THEN 1 ELSE 0 END AS has_phone, phone AS phone_found
FROM (SELECT *, ['Rochester', 'Eau Claire', 'Fresno', 'Lima'][CAST(seq % 4 + 1 AS INT)] AS c, ['MN', 'OH', 'CA'][CAST(seq % 3 + 1 AS INT)] AS s, concat('55', lpad(CAST(seq % 1000 AS VARCHAR), 3, '0')) AS z FROM o_raw)
-- query: facility_types uses: fx_orgs
SELECT seq, CASE WHEN contains(l, 'cancer') THEN 'Cancer Specialty' WHEN contains(l, 'cardiac') THEN 'Cardiac Specialty' WHEN contains(l, 'eye') THEN 'Eye Specialty' WHEN contains(l, 'kidney') THEN 'Nephrology Specialty' WHEN contains(l, 'women') THEN 'Women & Child Specialty'
  WHEN contains(l, 'child') THEN 'Pediatric Specialty' WHEN contains(l, 'ortho') THEN 'Orthopedic Specialty' WHEN contains(l, 'neuro') THEN 'Neurology Specialty' WHEN contains(l, 'district') THEN 'Government Hospital' WHEN contains(l, 'nursing home') THEN 'Nursing Home' WHEN contains(l, 'clinic') THEN 'Clinic' ELSE 'General Hospital' END AS registry_type,
 CASE WHEN contains(l, 'cardiac') THEN 'Cardiac Specialty' WHEN contains(l, 'cancer') THEN 'Cancer Specialty' WHEN contains(l, 'ortho') THEN 'Orthopedic Specialty' WHEN contains(l, 'neuro') THEN 'Neurological Specialty' WHEN contains(l, 'women') THEN 'Women & Child Specialty' WHEN contains(l, 'eye') THEN 'Eye Specialty' WHEN contains(l, 'institute') THEN 'Teaching Hospital' ELSE 'General Hospital' END AS portal_type,
 w AS web_type,
 CASE WHEN contains(l, 'eye') THEN 'Eye Hospital' WHEN contains(l, 'cardiac') THEN 'Cardiac Hospital' WHEN contains(l, 'cancer') THEN 'Cancer Hospital' WHEN contains(l, 'women') THEN 'Maternity Hospital' WHEN contains(l, 'child') THEN 'Pediatric Hospital' ELSE 'General Hospital' END AS collector_type,
 CASE WHEN regexp_matches(l, 'hospital|nursing home') THEN 'Hospital' WHEN regexp_matches(l, 'laboratory|labs|diagnostics|pathology') THEN 'Laboratory' WHEN regexp_matches(l, 'clinic|center') THEN 'Clinic' WHEN contains(l, 'institute') THEN 'Institute' ELSE 'Healthcare Organization' END AS laboratory_type,
 CASE WHEN contains(l, 'general') THEN 'General Hospital' WHEN contains(l, 'private') THEN 'Private Hospital' WHEN contains(l, 'clinic') THEN 'Medical Clinic' WHEN contains(l, 'medical center') THEN 'Medical Center' ELSE trim(name) END AS upload_type,
 CASE WHEN w <> 'General Hospital' THEN w WHEN seq % 8 > 5 THEN 'Multi-specialty Hospital' WHEN seq % 8 > 1 THEN 'Specialty Hospital' ELSE w END AS sized_type
FROM (SELECT seq, name, lower(name) AS l, CASE WHEN contains(lower(name), 'cancer') THEN 'Cancer Hospital' WHEN contains(lower(name), 'cardiac') THEN 'Cardiac Hospital' WHEN contains(lower(name), 'eye') THEN 'Eye Hospital' WHEN contains(lower(name), 'women') THEN 'Maternity Hospital'
  WHEN contains(lower(name), 'child') THEN 'Pediatric Hospital' WHEN contains(lower(name), 'ortho') THEN 'Orthopedic Hospital' ELSE 'General Hospital' END AS w FROM fx_orgs)
-- query: search_keywords uses: fx_orgs
SELECT seq, array_to_string(list_sort(list_distinct(list_concat(['Medical Laboratory Testing'], CASE WHEN contains(l, 'pathology') THEN ['Anatomic Pathology'] ELSE [] END, CASE WHEN regexp_matches(l, 'clinical|diagnostic') THEN ['Clinical Diagnostics'] ELSE [] END,
   CASE WHEN contains(l, 'cardiac') THEN ['Cardiovascular Testing'] ELSE [] END, CASE WHEN contains(l, 'cancer') THEN ['Oncology Testing'] ELSE [] END))), '|') AS specialties,
 array_to_string(list_sort(list_distinct(k)), '|') AS keywords,
 array_to_string(list_sort(list_distinct(list_concat(k, ['laboratory', 'lab', 'diagnostic', 'pathology', 'clinical', 'cap', 'iso 15189', 'medical laboratory', 'accredited']))), '|') AS lab_keywords,
 array_to_string(list_sort(list_distinct(list_filter(list_concat([l], t3, CASE WHEN len(t3) > 2 THEN [array_to_string(list_transform(t3, lambda w: w[1]), '')] ELSE [] END, [lower(city)], ['healthcare', 'medical', 'laboratory', 'testing', 'nabl']), lambda x: x <> ''))), '|') AS feed_keywords
FROM (SELECT *, list_concat([l], t3, CASE WHEN len(list_filter(t3, lambda w: length(w) > 3)) > 1 THEN [array_to_string(list_transform(list_filter(t3, lambda w: length(w) > 3), lambda w: w[1]), '')] ELSE [] END, [lower(country)]) AS k
 FROM (SELECT seq, lower(name) AS l, country, city, list_filter(regexp_extract_all(lower(name), '\w+'), lambda w: length(w) > 2) AS t3 FROM fx_orgs))
-- query: upload_certs uses: fx_certs
SELECT cert_name, raw, count(*) AS n, CASE WHEN regexp_matches(lower(cert_name), 'jci|joint commission') THEN 'JCI Accreditation' WHEN contains(lower(cert_name), 'nabh') THEN 'NABH Accreditation' WHEN contains(lower(cert_name), 'nabl') THEN 'NABL Accreditation' WHEN contains(lower(cert_name), 'iso') THEN 'ISO Certification'
  WHEN contains(lower(cert_name), 'cap') THEN 'CAP Accreditation' WHEN contains(lower(cert_name), 'magnet') THEN 'Magnet Recognition' ELSE 'Healthcare Accreditation' END AS cert_type,
 CAST(CASE WHEN contains(lower(cert_name), 'jci') THEN 35 WHEN contains(lower(cert_name), 'nabh') THEN 18 WHEN contains(lower(cert_name), 'nabl') THEN 15 WHEN contains(lower(cert_name), 'iso 9001') THEN 15 WHEN contains(lower(cert_name), 'iso') THEN 10 ELSE 5 END AS DOUBLE) AS impact
FROM (SELECT raw, CASE WHEN contains(r, 'jci') OR contains('jci', r) THEN 'Joint Commission International (JCI)' WHEN contains(r, 'joint commission international') OR contains('joint commission international', r) THEN 'Joint Commission International (JCI)'
  WHEN contains(r, 'nabh') THEN 'National Accreditation Board for Hospitals & Healthcare Providers (NABH)' WHEN contains(r, 'nabl') THEN 'National Accreditation Board for Testing and Calibration Laboratories (NABL)'
  WHEN contains(r, 'iso 9001') THEN 'ISO 9001' WHEN contains(r, 'iso 45001') THEN 'ISO 45001' WHEN contains(r, 'iso 15189') THEN 'ISO 15189' WHEN contains(r, 'cap') THEN 'College of American Pathologists (CAP)' WHEN contains(r, 'magnet') THEN 'Magnet Recognition Program' ELSE raw END AS cert_name
 FROM (SELECT raw, lower(raw) AS r FROM (SELECT lower(name) AS raw FROM fx_certs UNION ALL SELECT upper(status) FROM fx_certs) WHERE raw <> '')) GROUP BY 1, 2
-- query: feed_cert_kinds uses: fx_certs
SELECT name, CASE WHEN contains(n, 'joint commission international') THEN 'JCI' WHEN contains(n, 'iso') THEN CASE WHEN contains(n, '15189') THEN 'ISO_15189' WHEN contains(n, '9001') THEN 'ISO_9001' WHEN contains(n, '13485') THEN 'ISO_13485' ELSE 'ISO_OTHER' END
 WHEN contains(n, 'cap') AND contains(n, 'accreditation') THEN 'CAP' WHEN contains(n, 'nabl') THEN 'NABL' WHEN contains(n, 'nabh') THEN 'NABH' WHEN contains(n, 'has') THEN 'HAS_FRANCE' ELSE 'OTHER' END AS kind, count(*) AS n
FROM (SELECT name, lower(name) AS n FROM fx_certs) GROUP BY 1, 2
-- cte: o_host
SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/+([^/?#]*)', 1) AS p FROM pages
-- query: urls uses: o_host
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://', regexp_replace(url, '^https?://', '')) ELSE url END AS full_url, CASE WHEN a = '' THEN 'New Organization' ELSE array_to_string(list_transform(regexp_extract_all(lower(a), '([a-z]+|[^a-z]+)'), lambda r: concat(upper(r[1]), r[2:])), '') END AS url_name,
 CASE WHEN b = '' THEN 'New Organization' ELSE array_to_string(list_transform(regexp_extract_all(lower(b), '([a-z]+|[^a-z]+)'), lambda r: concat(upper(r[1]), r[2:])), '') END AS url_name_plain
FROM (SELECT *, trim(replace(CASE WHEN length(split_part(h, '.', 1)) < 3 THEN p ELSE split_part(h, '.', 1) END, '-', ' ')) AS a,
 trim(replace(CASE WHEN length(split_part(regexp_replace(h, '^www\.', ''), '.', 1)) < 3 THEN p ELSE split_part(regexp_replace(h, '^www\.', ''), '.', 1) END, '-', ' ')) AS b FROM o_host)
-- query: display_details uses: o_raw
SELECT seq, concat_ws(' • ', name, CASE WHEN seq % 4 <> 0 THEN concat(trim(split_part(addr, ',', -2)), ', ', trim(split_part(addr, ',', -1))) END, CASE WHEN seq % 6 > 0 THEN concat('★ ', seq % 6) END, concat('(', data_source, ')')) AS line FROM o_raw
-- query: text_similarity uses: fx_orgs
SELECT seq, round(1 - levenshtein(lower(name), lower(h)) / greatest(length(name), length(h)), 6) AS edit_similarity, round(len(list_intersect(a, b)) / len(a), 6) AS word_overlap,
 round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS word_jaccard
FROM (SELECT *, list_distinct(string_split(lower(name), ' ')) AS a, list_distinct(string_split(lower(h), ' ')) AS b FROM (SELECT *, array_to_string(string_split(name, ' ')[1:2], ' ') AS h FROM fx_orgs))
-- cte: o_dates uses: fx_certs
SELECT DISTINCT CASE pos % 6 WHEN 0 THEN concat_ws('/', pos % 28 + 1, pos % 12 + 1, pos % 20 + 1995) WHEN 1 THEN concat_ws('-', pos % 28 + 1, pos % 12 + 1, pos % 20 + 1995)
 WHEN 2 THEN concat_ws('.', lpad(CAST(pos % 28 + 1 AS VARCHAR), 2, '0'), lpad(CAST(pos % 12 + 1 AS VARCHAR), 2, '0'), pos % 20 + 1995) WHEN 3 THEN concat('Mar ', pos % 28 + 1, ', ', pos % 20 + 1995) ELSE accreditation_date END AS raw FROM fx_certs
-- query: date_parse uses: o_dates
SELECT raw, CAST(CAST(coalesce(try_strptime(raw, '%d %b %Y'), try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%d-%m-%Y'), try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d.%m.%Y')) AS DATE) AS VARCHAR) AS portal_date,
 CAST(CAST(coalesce(try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%d-%m-%Y'), try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d.%m.%Y'), try_strptime(raw, '%d %b %Y'), try_strptime(raw, '%b %d, %Y')) AS DATE) AS VARCHAR) AS list_date,
 CASE WHEN regexp_matches(raw, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') OR try_strptime(raw, '%d %b %Y') IS NOT NULL THEN CAST(CAST(coalesce(try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%d %b %Y')) AS DATE) AS VARCHAR) ELSE raw END AS found_date,
 CASE WHEN try_strptime(raw, '%d %b %Y') IS NOT NULL THEN strftime(try_strptime(raw, '%d %b %Y'), '%Y-%m-%dT%H:%M:%S') ELSE raw END AS iso_or_same FROM o_dates
-- query: certificate_status uses: fx_certs
SELECT CASE r WHEN 1 THEN 'Suspended' WHEN 2 THEN 'Active' WHEN 3 THEN 'Expired' WHEN 4 THEN 'Revoked' ELSE CASE WHEN e IS NULL THEN 'Unknown' WHEN e > n THEN 'Active' ELSE 'Expired' END END AS remarks_first,
 CASE WHEN r IN (1, 4) THEN 'Suspended' WHEN r = 3 THEN 'Expired' WHEN e IS NOT NULL THEN CASE WHEN e < n THEN 'Expired' ELSE 'Active' END WHEN r IN (2, 6) THEN 'Active' ELSE 'Unknown' END AS date_between,
 CASE WHEN r = 3 THEN 'Expired' WHEN e IS NULL THEN 'Unknown' WHEN e > n THEN 'Active' ELSE 'Expired' END AS portal,
 CASE WHEN r = 1 THEN 'Suspended' WHEN r IN (3, 5) THEN 'Expired' WHEN e IS NULL OR e > n THEN 'Active' ELSE 'Expired' END AS dental,
 CASE WHEN e IS NULL THEN status WHEN e >= n THEN 'Active' ELSE 'Expired' END AS refreshed, 'Under Review' AS application, count(*) AS n
FROM (SELECT *, pos % 7 AS r, CASE WHEN pos % 4 <> 0 THEN date_trunc('day', expiry_ts) END AS e, TIMESTAMP '1999-06-01 12:00:00' AS n FROM fx_certs) GROUP BY 1, 2, 3, 4, 5, 6
-- cte: o_reg_rows uses: fx_history fx_orgs
SELECT h.entry_id AS seq, CASE WHEN h.entry_id % 41 = 0 THEN '42' ELSE o.name END AS name, o.city, o.state, CASE WHEN h.entry_id % 10 = 0 THEN 'Nepal' WHEN h.entry_id % 11 = 0 THEN '' ELSE 'India' END AS country,
 h.entry_id % 13 = 0 AS bad_no, CASE WHEN h.entry_id % 17 <> 0 THEN concat('R', h.entry_id % 50) END AS ref, CASE WHEN h.entry_id % 19 <> 0 THEN CAST(h.ts AS DATE) END AS vf, CASE WHEN h.entry_id % 23 <> 0 THEN CAST(h.ts AS DATE) + CAST(h.entry_id % 40 * 110 AS INT) END AS vu,
 ['Active', 'Expired', 'Lapsed'][CAST(h.entry_id % 3 + 1 AS INT)] AS status FROM fx_history h JOIN fx_orgs o USING (seq)
-- cte: o_issues uses: o_reg_rows
SELECT seq, vu, status, list_filter([CASE WHEN name = '42' THEN 'Hospital name too short' END, CASE WHEN name = '42' THEN 'Suspicious hospital name pattern' END, CASE WHEN city = '' THEN 'Missing city' END, CASE WHEN country = '' THEN 'Missing country' END, CASE WHEN country = 'Nepal' THEN 'Non-India country' END,
 CASE WHEN bad_no THEN 'Invalid accreditation number format' END, CASE WHEN ref IS NULL THEN 'Missing reference number' END, CASE WHEN vf IS NULL THEN 'Missing valid from date' END, CASE WHEN vf >= vu THEN 'Invalid date range (from >= upto)' END, CASE WHEN vu - vf < 30 THEN 'Suspiciously short certification period' END,
 CASE WHEN vu - vf > 3650 THEN 'Suspiciously long certification period' END, CASE WHEN vf IS NOT NULL AND vu IS NULL THEN 'Invalid date format' END, CASE WHEN status = 'Lapsed' THEN 'Invalid certification status' END,
 CASE WHEN status = 'Active' AND vu < TIMESTAMP '1999-06-01 12:00:00' THEN 'Status shows Active but certification expired' END, CASE WHEN status = 'Expired' AND vu >= TIMESTAMP '1999-06-01 12:00:00' THEN 'Status shows Expired but certification still valid' END], lambda x: x IS NOT NULL) AS issues FROM o_reg_rows
-- query: validation_issues uses: o_issues
SELECT seq, array_to_string(issues, '|') AS issues, (len(issues) = 0)::INT AS is_valid, CASE WHEN vu IS NULL THEN status WHEN vu >= TIMESTAMP '1999-06-01 12:00:00' THEN 'Active' ELSE 'Expired' END AS status FROM o_issues
-- query: issue_histogram uses: o_issues
SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM o_issues) GROUP BY 1
-- query: portal_rows uses: o_reg_rows
SELECT seq, name, city, state, application_date, certification_status, CAST(least(100, CASE WHEN length(name) > 10 THEN 20 ELSE 10 END + 15 + CASE WHEN state <> 'Unknown' THEN 15 ELSE 0 END + CASE WHEN city IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN application_date IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN seq % 4 = 3 THEN 0 ELSE 10 END + CASE WHEN seq % 2 = 0 AND city IS NOT NULL THEN 5 ELSE 0 END + 15) AS BIGINT) AS data_quality_score FROM (
 SELECT seq, replace(rtrim(name, '.,'), ' Pvt Ltd', ' Private Limited') AS name, CASE WHEN city <> '' THEN city END AS city, state, ref, CASE WHEN seq % 4 <> 0 THEN CAST(vf AS VARCHAR) END AS application_date,
  ['Application Closed', 'Application Pending', 'Approved', 'Under Review'][CAST(seq % 4 + 1 AS INT)] AS certification_status FROM o_reg_rows WHERE length(name) >= 3 AND ref IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY lower(name), ref ORDER BY seq) = 1
-- query: dental_scores uses: fx_orgs
SELECT seq, CAST(10 * (2 + CASE WHEN phone <> '' THEN 2 ELSE 0 END + CASE WHEN city <> '' THEN 1 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN state <> 'Unknown' THEN 1 ELSE 0 END + 1) AS DOUBLE) AS quality,
 round(100.0 * (1 + (phone <> '')::INT + (city <> '')::INT + (website IS NOT NULL)::INT + 1 + (state <> 'Unknown')::INT + 1) / 7, 6)::DOUBLE AS completeness FROM fx_orgs
-- cte: o_lab_rows uses: fx_orgs
SELECT *, concat_ws(' ', name, ['Pune', '', 'Noida Agra'][CAST(seq % 3 + 1 AS INT)]) AS lname FROM fx_orgs
-- cte: o_lab_clean uses: o_lab_rows
SELECT *, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(trim(regexp_replace(lname, '\s+', ' ', 'g')), '.,;:-_()[]{}|'),
   '\bPvt\.?\s*Ltd\.?', 'Private Limited', 'gi'), '\bLtd\.?', 'Limited', 'gi'), '\bHosp\.?', 'Hospital', 'gi'), '\bLab\.?', 'Laboratory', 'gi'), '\bMed\.?', 'Medical', 'gi'), '\bClin\.?', 'Clinic', 'gi'),
   '\bDiag\.?', 'Diagnostics', 'gi'), '\bPath\.?', 'Pathology', 'gi'), '\s+'), lambda w: w <> ''), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS cname FROM o_lab_rows
-- query: enriched_labs uses: o_lab_clean
SELECT seq, cname AS name, CASE WHEN seq % 4 = 0 THEN city WHEN seq % 3 = 0 THEN 'Pune' WHEN seq % 3 = 2 THEN 'Agra|Noida' ELSE '' END AS locations,
 CASE WHEN regexp_matches(l, 'hospital|nursing home') THEN 'Hospital' WHEN regexp_matches(l, 'laboratory|labs|diagnostics|pathology') THEN 'Laboratory' WHEN regexp_matches(l, 'clinic|center') THEN 'Clinic' WHEN contains(l, 'institute') THEN 'Institute' ELSE 'Laboratory' END AS organization_type, CAST(1 AS BIGINT) AS n_services,
 CAST(least(100, CASE WHEN regexp_matches(cname, '(?i)^National') THEN 0 ELSE 40 END + least(30, 10 * (contains(l, 'hospital')::INT + contains(l, 'clinic')::INT + contains(l, 'laboratory')::INT + contains(l, 'labs')::INT + contains(l, 'medical')::INT + contains(l, 'healthcare')::INT + contains(l, 'diagnostics')::INT + contains(l, 'pathology')::INT
   + contains(l, 'center')::INT + contains(l, 'institute')::INT + contains(l, 'nursing')::INT + contains(l, 'dental')::INT + contains(l, 'eye')::INT + contains(l, 'cancer')::INT))
  + CASE WHEN seq % 4 = 0 OR seq % 3 <> 1 THEN 15 ELSE 0 END + CASE WHEN phone <> '' THEN 10 ELSE 0 END + CASE WHEN seq % 3 = 0 THEN 5 ELSE 0 END) AS DOUBLE) AS confidence_score
FROM (SELECT *, lower(cname) AS l FROM o_lab_clean WHERE NOT regexp_matches(lname, '(?i)^National') QUALIFY row_number() OVER (PARTITION BY lower(cname) ORDER BY seq) = 1)
-- query: registry_flag uses: fx_certs
WITH c AS (SELECT seq, pos, min(name) AS name, min(accreditation_date) AS a, min(CAST(CAST(expiry_ts AS DATE) AS VARCHAR)) AS e FROM fx_certs GROUP BY 1, 2)
SELECT seq, max((name LIKE '%JCI%')::INT) AS has_jci, coalesce(arg_min(a, pos) FILTER (name LIKE '%JCI%'), '') AS jci_accreditation_date, coalesce(arg_min(e, pos) FILTER (name LIKE '%JCI%'), '') AS jci_expiry_date FROM c GROUP BY 1
-- query: indicator_initiatives uses: fx_orgs
SELECT seq, 'JCI Quality Standards' AS name, 5 AS score_impact FROM fx_orgs WHERE seq % 3 = 0 UNION ALL SELECT seq, 'NABH Quality Standards', 3 FROM fx_orgs WHERE seq % 4 = 0
