-- cte: o_text
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM pages
-- query: page_texts uses: o_text
SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM o_text
-- cte: o_page_hits uses: o_text
SELECT page_id, l, 'ALPHA' AS name, CASE WHEN regexp_matches(l, 'of the\w*') THEN regexp_extract(l, 'of the\w*') ELSE regexp_extract(l, 'and the') END AS match FROM (SELECT page_id, lower(t) AS l FROM o_text) WHERE regexp_matches(l, 'of the\w*|and the')
UNION ALL SELECT page_id, l, 'BETA', CASE WHEN regexp_matches(l, 'was.*ing the') THEN regexp_extract(l, 'was.*ing the') ELSE regexp_extract(l, 'la \w+') END FROM (SELECT page_id, lower(t) AS l FROM o_text) WHERE regexp_matches(l, 'was.*ing the|la \w+')
UNION ALL SELECT page_id, l, 'GAMMA', CASE WHEN regexp_matches(l, 'der \w+ und') THEN regexp_extract(l, 'der \w+ und') ELSE regexp_extract(l, 'que de') END FROM (SELECT page_id, lower(t) AS l FROM o_text) WHERE regexp_matches(l, 'der \w+ und|que de')
-- query: page_certifications uses: o_page_hits
SELECT page_id, name, match, trim(substring(l, greatest(1, strpos(l, match) - 100), strpos(l, match) - greatest(1, strpos(l, match) - 100) + length(match) + 100)) AS context FROM o_page_hits
-- query: logo_certifications
SELECT page_id, name, count(*) AS n FROM (SELECT page_id, 'JCI' AS name FROM pages UNION ALL SELECT page_id, 'JCI' FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'NABH' FROM pages WHERE page_id % 4 = 2 UNION ALL SELECT page_id, 'ISO' FROM pages WHERE page_id % 4 IN (2, 3)) GROUP BY 1, 2
-- cte: o_ctx uses: o_text
SELECT page_id, k AS keyword, length(trim(regexp_extract(lower(t), concat('.{0,50}', k, '.{0,50}')))) AS n_context FROM o_text CROSS JOIN (VALUES ('of the'), ('de la'), ('in the'), ('und die')) v(k) WHERE contains(lower(t), k)
-- query: keyword_contexts uses: o_ctx
SELECT page_id, keyword, n_context FROM o_ctx
-- query: contact_details
SELECT page_id, trim(regexp_extract(t, '(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}')) AS phone, regexp_extract(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email,
 concat(page_id, ' High Street, Springfield , Ohio') AS address, 'Springfield' AS city, 'Ohio' AS state FROM (SELECT page_id, replace(regexp_replace(concat(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
 '<p>Call (555) 010-', lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0'), ' or desk@site', page_id % 7, '.example.org</p>'), '(?s)<[^>]*>', ' ', 'g'), '&amp;', '&') AS t FROM pages)
-- cte: o_heads
SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS h, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS ti FROM pages
-- query: page_basics uses: o_heads o_text
SELECT page_id, replace(replace(CASE WHEN length(replace(h, '&amp;', '&')) BETWEEN 4 AND 99 THEN h WHEN length(replace(ti, '&amp;', '&')) BETWEEN 4 AND 99 THEN ti ELSE '' END, '&quot;', '"'), '&amp;', '&') AS name,
 CASE WHEN regexp_matches(lower(t), 'university|medical school|teaching hospital|academic') THEN 'Academic Medical Center' WHEN regexp_matches(lower(t), 'general hospital|multi-specialty|full service') THEN 'General Hospital' WHEN regexp_matches(lower(t), 'specialty|specialized|cardiac|cancer|orthopedic') THEN 'Specialty Hospital'
 WHEN regexp_matches(lower(t), 'clinic|medical center|outpatient') THEN 'Clinic' WHEN regexp_matches(lower(t), 'laboratory|lab|diagnostic|pathology') THEN 'Laboratory' WHEN regexp_matches(lower(t), 'dental|dentist|orthodontic|oral health') THEN 'Dental Facility' ELSE 'Healthcare Organization' END AS facility_type, '' AS services FROM o_heads JOIN o_text USING (page_id)
-- query: element_counts
SELECT page_id, len(regexp_extract_all(html, '(?i)<a\b')) AS links, len(regexp_extract_all(html, '(?i)<form\b')) AS forms, len(regexp_extract_all(html, '(?i)<img\b')) AS images, len(regexp_extract_all(html, '(?i)<li\b')) AS items, len(regexp_extract_all(html, '(?i)<p\b')) AS paragraphs FROM pages
-- query: table_rows uses: fx_orgs
SELECT seq AS page_id, CASE WHEN r = 1 THEN 1 WHEN seq % 3 = 0 THEN 3 ELSE 2 END AS row_number, CAST(r AS VARCHAR) AS serial_number, concat('R', seq) AS reference_number, name, state AS remarks FROM fx_orgs CROSS JOIN (VALUES (1), (2)) v(r)
-- query: table_profile uses: fx_orgs
SELECT seq AS page_id, 0 AS table_no, 'grid' AS table_id, CASE WHEN seq % 3 = 0 THEN 4 ELSE 3 END AS n_rows, 3 AS n_columns, 'No|Ref|Name' AS headers, regexp_matches(lower(name), 'hospital|medical|clinic|healthcare|accredited|certificate')::INT AS has_hospital_data FROM fx_orgs
UNION ALL SELECT seq, 1, '', 1, 1, 'z', 0 FROM fx_orgs
-- query: json_ld_rows uses: fx_orgs
SELECT seq AS page_id, name, CASE WHEN seq % 2 = 0 THEN city ELSE country END AS address, 'Unknown' AS city, CASE WHEN seq % 2 = 0 THEN state ELSE 'Unknown' END AS state, CASE WHEN seq % 2 = 0 THEN '' ELSE phone END AS phone FROM fx_orgs
-- query: directory_blocks uses: fx_orgs
SELECT seq AS page_id, 0 AS block_no, name, concat(country, ' Road, Gotham, Zenda') AS address, 'Gotham' AS city, 'Zenda' AS state, '555-010-2345 67' AS phone, 'x@y.example' AS email, 'http://a.example/' AS website, 'Full' AS accreditation_level, '01/02/2020' AS valid_from, '01/02/2023' AS valid_until, 'PEH/12' AS certificate_number FROM fx_orgs
UNION ALL SELECT seq, 1, concat(region, ' House'), '', 'Unknown', 'Unknown', '', '', '', 'Entry Level', NULL, NULL, '' FROM fx_orgs
-- query: names_in_text uses: fx_orgs
SELECT DISTINCT seq AS doc_id, n AS name FROM (SELECT seq, trim(unnest(list_concat(regexp_extract_all(s, '(?i)([A-Za-z\s&]+(?:Hospital|Medical Center|Clinic|Healthcare|Nursing Home)[A-Za-z\s]*)', 1), regexp_extract_all(s, '(?i)([A-Za-z\s&]+(?:Institute|Foundation|Trust)[A-Za-z\s]*)', 1),
 regexp_extract_all(s, '(?i)(Dr\.?\s+[A-Za-z\s]+(?:Hospital|Clinic|Medical))', 1), regexp_extract_all(s, '(?i)([A-Za-z\s]+(?:Multi[- ]?specialty|Super[- ]?specialty)[A-Za-z\s]*)', 1)))) AS n FROM (SELECT seq, concat('Visited ', name, '. Then 12 beds; ', region, ' Trust. Dr. Ann Lee Clinic, ok') AS s FROM fx_orgs)) WHERE length(n) > 5
-- query: document_rows uses: fx_orgs
SELECT seq AS doc_id, 0 AS line_no, concat(split_part(name, ' ', 1), ' Care Private Limited') AS name, '' AS accreditation_number, 'ISO 15189' AS iso_standard, '' AS validity_date, '' AS scope, '' AS locations, 'line' AS method FROM fx_orgs
UNION ALL SELECT seq, 3, c, '01/02/2024', 'ISO 15189', '', 'Pathology', 'Pune', 'table' FROM (SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\bPvt\.?\s*Ltd\.?', 'Private Limited', 'gi'), '\bLtd\.?', 'Limited', 'gi'), '\bHosp\.?', 'Hospital', 'gi'), '\bLab\.?', 'Laboratory', 'gi'), '\bMed\.?', 'Medical', 'gi'), '\bClin\.?', 'Clinic', 'gi')) AS c FROM fx_orgs WHERE NOT contains(name, 'Laboratory'))
UNION ALL SELECT seq, 5, concat(region, ' Centre'), 'ISO 17025', 'ISO 15189', '', '', '', 'table' FROM fx_orgs
-- query: laboratory_entries uses: fx_orgs
SELECT seq AS doc_id, CAST(1 AS BIGINT) AS entry_no, concat(name, ' Laboratory') AS name, concat('12 Long Way ', country, ', Suite 4') AS address, concat('555-010-', lpad(CAST(seq % 10000 AS VARCHAR), 4, '0')) AS phone, 'Website' AS website FROM fx_orgs
UNION ALL SELECT seq, 2, concat(region, ' Pathology Unit'), '', NULL, NULL FROM fx_orgs
-- query: phrase_tags
SELECT doc_id, tag, CAST(n AS BIGINT) AS n_phrases FROM (SELECT doc_id, 'english' AS tag, contains(l, 'of the')::INT + contains(l, 'and the')::INT + contains(l, 'was ')::INT AS n FROM (SELECT doc_id, lower(text) AS l FROM documents) UNION ALL SELECT doc_id, 'french', contains(l, 'que ')::INT + contains(l, ' de la')::INT FROM (SELECT doc_id, lower(text) AS l FROM documents)
 UNION ALL SELECT doc_id, 'german', contains(l, ' und ')::INT + contains(l, ' der ')::INT FROM (SELECT doc_id, lower(text) AS l FROM documents)) WHERE n > 0
-- query: public_tags uses: fx_orgs
SELECT seq AS doc_id, 'nabh' AS tag, CAST(1 AS BIGINT) AS n_phrases FROM fx_orgs WHERE seq % 4 = 0 UNION ALL SELECT seq, 'rankings', 1 FROM fx_orgs WHERE seq % 4 = 1 UNION ALL SELECT seq, 'jci', 1 FROM fx_orgs WHERE seq % 4 = 2 UNION ALL SELECT seq, 'technology', 1 FROM fx_orgs WHERE seq % 4 = 2
-- cte: o_words
SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents
-- query: lexicon_sentiment uses: o_words
SELECT d.doc_id, round(coalesce(avg(l.p), 0), 6)::DOUBLE AS sentiment, count(l.p) AS n_words FROM documents d LEFT JOIN o_words w USING (doc_id) LEFT JOIN (VALUES ('the', 0.5::DOUBLE), ('of', -0.25), ('de', 0.75), ('und', -1.0), ('was', 0.1)) l(word, p) ON l.word = w.word GROUP BY 1
-- cte: o_clean
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS c FROM pages
-- cte: o_spaced uses: o_clean
SELECT page_id, regexp_replace(c, '(?s)<[^>]*>', ' ', 'g') AS s, regexp_replace(c, '(?s)<[^>]*>', chr(10), 'g') AS nl FROM o_clean
-- query: page_records uses: o_page_hits o_ctx o_spaced o_heads
SELECT p.page_id, coalesce(c.n, 0) AS n_certs, coalesce(i.n, 0) AS n_initiatives, round(least(1, CASE WHEN length(replace(h, '&amp;', '&')) BETWEEN 4 AND 99 OR length(replace(ti, '&amp;', '&')) BETWEEN 4 AND 99 THEN 0.2 ELSE 0 END
 + CASE WHEN regexp_matches(replace(s, '&amp;', '&'), '(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}') OR regexp_matches(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 0.1 ELSE 0 END + CASE WHEN trim(regexp_extract(nl, '(?i)Address[:\s]+([^\n]+)', 1)) <> '' THEN 0.1 ELSE 0 END
 + least(0.3, coalesce(c.n, 0) * 0.1) + least(0.2, coalesce(i.n, 0) * 0.05)), 6)::DOUBLE AS confidence
FROM o_spaced p JOIN o_heads USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM o_page_hits GROUP BY 1) c USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM o_ctx GROUP BY 1) i USING (page_id)
