-- query: cert_items_cleaned uses: fx_certs
SELECT seq, pos, name, CASE WHEN pos % 4 = 0 THEN 'Active' ELSE status END AS status FROM fx_certs WHERE pos % 4 < 2
-- query: accredited_bodies uses: fx_orgs
SELECT seq, 'NABH' AS name, 'Accredited' AS status FROM fx_orgs WHERE seq % 2 = 0 UNION ALL SELECT seq, 'JCI', 'Accredited' FROM fx_orgs WHERE seq % 3 = 0
-- cte: o_rich uses: fx_orgs
SELECT *, (name <> '')::INT + (city <> '')::INT + (state <> '')::INT + (country <> '')::INT + (hospital_type <> '')::INT + coalesce((website <> '')::INT, 0) + (phone <> '')::INT AS rich FROM fx_orgs
-- query: row_richness uses: o_rich
SELECT seq, CAST(rich AS BIGINT) AS richness FROM o_rich
-- query: collected_sources uses: fx_orgs
SELECT seq, concat_ws('|', data_source, region, website, upper(data_source)) AS sources FROM fx_orgs
-- query: group_level_filter uses: fx_orgs
SELECT seq, CASE WHEN regexp_matches(lower(name), 'group|network|health system') THEN 1 WHEN contains(name, ',') OR (contains(name, '(') AND contains(name, ')')) THEN 0
 WHEN EXISTS (SELECT 1 FROM fx_orgs p WHERE p.name <> o.name AND (starts_with(p.name, concat(o.name, ' ')) OR starts_with(p.name, concat(o.name, ',')))) THEN 1 ELSE 0 END AS is_group FROM fx_orgs o
-- query: row_filters uses: fx_orgs
SELECT seq, CASE WHEN length(l) < 5 OR (contains(l, 'home') AND length(l) < 20) OR (contains(l, 'nabh') AND length(l) < 20) OR (contains(l, 'search') AND length(l) < 20) THEN 0 ELSE 1 END AS not_junk,
 CASE WHEN length(b) >= 10 AND regexp_matches(lower(b), 'hospital|medical center|clinic|healthcare|nursing home|institute|foundation|trust|multispecialty|super specialty|cardiac|cancer|orthopedic|eye care|dental|maternity|children|pediatric|neuro|kidney|liver|nabh|accredited')
   AND (regexp_matches(lower(b), 'road|street|avenue|city|state') OR regexp_matches(b, '\d{10}|@.*\.com') OR length(b) > 50) THEN 1 ELSE 0 END AS hospital_block,
 CASE WHEN seq % 3 <> 0 AND length(concat('place-id-', seq)) >= 10 AND city <> '' AND regexp_matches(lower(hospital_type), 'hospital|health|doctor|clinic|medical|dentist|pharmacy')
   AND regexp_matches(l, 'hospital|medical|clinic|health|care|center|centre|apollo|fortis|max|manipal|narayana|aster|columbia') THEN 1 ELSE 0 END AS real_facility,
 CASE WHEN regexp_matches(l, 'government|govt|municipal|corporation|district|state|central|public|civil|general hospital|medical college|aiims|pgimer|jipmer|safdarjung|ram manohar lohia') THEN 0 ELSE 1 END AS is_private,
 CASE WHEN length(t) < 4 OR regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^[^A-Za-z]*$') OR regexp_matches(t, '(?i)^(National|Page|Number|Date|Scope)') OR NOT regexp_matches(t, '[A-Za-z]{3,}')
   OR (contains(l, 'pune') AND NOT regexp_matches(l, 'hospital|clinic|laboratory|labs|medical|healthcare|diagnostics|pathology|centre|center|institute|nursing|eye|cancer|dental') AND len(string_split_regex(t, '\s+')) < 3) THEN 0 ELSE 1 END AS valid_name
FROM (SELECT *, trim(n) AS t, lower(trim(n)) AS l, concat_ws(', ', n, phone) AS b FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN name ELSE concat_ws(' ', split_part('Home|Search NABH|Government|12345|Pune Labs|Pune', '|', CAST(seq % 6 + 1 AS INT)), CASE WHEN seq % 5 = 0 THEN city END) END AS n FROM fx_orgs))
-- query: structure_split uses: fx_orgs
SELECT CASE seq % 50 WHEN 0 THEN 'str' WHEN 1 THEN 'list' WHEN 2 THEN 'broken' ELSE 'dict' END AS kind, count(*) AS n, NULL AS sample FROM fx_orgs GROUP BY 1
UNION ALL (SELECT 'str', seq, left(concat('"', name, '"'), 100) FROM fx_orgs WHERE seq % 50 = 0 ORDER BY seq LIMIT 5)
-- cte: o_group uses: o_rich o_canon
SELECT r.seq, first_value(r.seq) OVER (PARTITION BY c.canonical_name ORDER BY rich DESC, r.seq) AS group_seq, r.name FROM o_rich r JOIN o_canon c USING (seq)
-- query: keep_richest uses: o_group
SELECT seq, name FROM o_group WHERE seq = group_seq
-- query: group_members uses: o_group
SELECT seq, group_seq FROM o_group
-- query: merged_certs uses: o_group fx_certs
SELECT group_seq, seq, pos, name FROM (SELECT g.group_seq, c.seq, c.pos, c.name, row_number() OVER (PARTITION BY g.group_seq, lower(trim(c.name)) ORDER BY c.seq, c.pos) AS k FROM fx_certs c JOIN o_group g USING (seq)) WHERE k = 1
-- query: first_filled_fields uses: o_keys fx_orgs
SELECT min(o.seq) AS group_seq, count(*) AS n_rows, coalesce(arg_min(o.city, o.seq) FILTER (o.city <> ''), '') AS city, coalesce(arg_min(o.state, o.seq) FILTER (o.state <> ''), '') AS state,
 coalesce(arg_min(o.phone, o.seq) FILTER (o.phone <> ''), '') AS phone, coalesce(arg_min(o.website, o.seq) FILTER (o.website <> ''), '') AS website FROM fx_orgs o JOIN o_keys k USING (seq) GROUP BY k.alnum_key
-- cte: o_valid uses: fx_orgs fx_registry
SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM fx_registry r WHERE lower(r.name) = lower(o.name) AND (NOT r.verification_required OR (r.city <> '' AND r.city = o.city))) THEN 1 ELSE 0 END AS registry_valid FROM fx_orgs o
-- query: valid_certs uses: fx_certs o_valid
SELECT seq, min(pos) AS pos, any_value(name) AS name FROM (SELECT c.*, lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')) AS key FROM fx_certs c JOIN o_valid v USING (seq)
 WHERE registry_valid = 1 OR (upper(name) NOT LIKE '%JCI%' AND upper(name) NOT LIKE '%JOINT COMMISSION%')) GROUP BY seq, trim(key)
-- cte: o_alnum_group uses: o_rich o_keys
SELECT r.seq, first_value(r.seq) OVER (PARTITION BY k.alnum_key ORDER BY rich DESC, r.seq) AS group_seq FROM o_rich r JOIN o_keys k USING (seq)
-- query: merged_flags uses: o_alnum_group o_valid
SELECT group_seq, 'verified' AS flag, CAST(max(CASE WHEN seq % 4 = 1 THEN 1 ELSE 0 END) AS INT) AS value FROM o_alnum_group GROUP BY 1
UNION ALL SELECT group_seq, 'jci_accredited', max(registry_valid) FROM o_alnum_group JOIN o_valid USING (seq) GROUP BY 1
-- cte: o_unique_certs uses: fx_certs
SELECT seq, pos, min(name) AS name, min(status) AS status, max(score_impact) AS score_impact,
 CASE WHEN min(name) LIKE 'Joint Commission%' THEN 'JCI' WHEN min(name) LIKE '%NABH%' THEN 'NABH' WHEN min(name) LIKE 'CAP%' OR min(name) LIKE 'College%' THEN 'CAP'
  WHEN min(name) LIKE 'ISO%' THEN concat('ISO', regexp_extract(min(name), '([0-9]+)', 1)) WHEN min(name) = 'NABL Testing' THEN 'NABL TEST G'
  WHEN min(name) = 'Magnet Recognition' THEN 'MAGNET RECOGNITI' WHEN min(name) = 'State License' THEN 'ST E LICENSE' WHEN min(name) = 'Local Permit' THEN 'LOCAL PERMIT' END AS cert_key
FROM fx_certs GROUP BY 1, 2
-- query: best_certs uses: o_unique_certs
SELECT seq, cert_key, min(pos) OVER (PARTITION BY seq, cert_key) AS pos, name, CAST(score_impact AS BIGINT) AS score_impact FROM o_unique_certs
QUALIFY row_number() OVER (PARTITION BY seq, cert_key ORDER BY coalesce(score_impact, 0) DESC, length(concat(name, status)) DESC, pos) = 1
-- query: distinct_certs_edit uses: o_unique_certs
WITH RECURSIVE b AS (SELECT seq, min(pos) OVER (PARTITION BY seq, cert_key) AS pos, name, coalesce(score_impact, 0) * 1000000 + length(concat(name, status)) AS q FROM o_unique_certs
 QUALIFY row_number() OVER (PARTITION BY seq, cert_key ORDER BY coalesce(score_impact, 0) DESC, length(concat(name, status)) DESC, pos) = 1),
p AS (SELECT seq AS k, list(pos ORDER BY pos) AS ids, list(upper(name) ORDER BY pos) AS names, list(-q ORDER BY pos) AS ranks FROM b GROUP BY 1),
r AS (SELECT k, ids, names, ranks, 1 AS i, CAST([] AS BIGINT[]) AS gone FROM p UNION ALL
 SELECT k, ids, names, ranks, i + 1, CASE WHEN list_contains(gone, i) THEN gone ELSE list_concat(gone, list_filter(near, lambda j: ranks[j] >= ranks[i]), CASE WHEN len(list_filter(near, lambda j: ranks[j] < ranks[i])) > 0 THEN [CAST(i AS BIGINT)] ELSE [] END) END
 FROM (SELECT *, list_filter(range(i + 1, len(ids) + 1), lambda j: NOT list_contains(gone, j) AND names[i] <> '' AND names[j] <> '' AND 1 - levenshtein(names[j], names[i]) * 1.0 / greatest(length(names[j]), length(names[i])) > 0.8) AS near FROM r WHERE i <= len(ids)))
SELECT seq, pos, name FROM b ANTI JOIN (SELECT k AS seq, unnest(list_transform(gone, lambda g: ids[g])) AS pos FROM r WHERE i = len(ids) + 1) USING (seq, pos)
-- query: near_equal_names uses: fx_orgs
WITH RECURSIVE p AS (SELECT concat_ws('|', state, city) AS k, list(seq ORDER BY seq) AS ids, list(lower(name) ORDER BY seq) AS names, list(-prior_score_src ORDER BY seq) AS ranks FROM fx_orgs GROUP BY 1),
r AS (SELECT k, ids, names, ranks, 1 AS i, CAST([] AS BIGINT[]) AS gone FROM p UNION ALL
 SELECT k, ids, names, ranks, i + 1, CASE WHEN list_contains(gone, i) THEN gone ELSE list_concat(gone, list_filter(near, lambda j: ranks[j] >= ranks[i]), CASE WHEN len(list_filter(near, lambda j: ranks[j] < ranks[i])) > 0 THEN [CAST(i AS BIGINT)] ELSE [] END) END
 FROM (SELECT *, list_filter(range(i + 1, len(ids) + 1), lambda j: NOT list_contains(gone, j) AND names[i] <> '' AND names[j] <> '' AND 1 - levenshtein(names[j], names[i]) * 1.0 / greatest(length(names[j]), length(names[i])) > 0.8) AS near FROM r WHERE i <= len(ids)))
SELECT k AS place, unnest(list_transform(gone, lambda g: ids[g])) AS seq FROM r WHERE i = len(ids) + 1
-- query: one_jci uses: o_unique_certs
SELECT seq, count(*) FILTER (NOT j) + CASE WHEN count(*) FILTER (j) > 0 THEN 1 ELSE 0 END AS n, CASE WHEN count(*) FILTER (j) > 1 THEN 1 ELSE 0 END AS moved_last
FROM (SELECT *, upper(name) LIKE '%JCI%' AS j FROM o_unique_certs) GROUP BY seq
-- query: dedupe_keys uses: fx_orgs
SELECT 'name_address' AS what, min(seq) AS seq FROM fx_orgs GROUP BY lower(name), lower(city) UNION ALL SELECT 'name_number', min(seq) FROM fx_orgs GROUP BY lower(name), seq % 7, seq % 5
UNION ALL SELECT 'name_reference', min(seq) FROM fx_orgs GROUP BY lower(name), seq % 5 UNION ALL SELECT 'name', min(seq) FROM fx_orgs GROUP BY lower(name)
-- query: dedupe_iso uses: fx_certs
SELECT name, pos % 50 AS number, min(seq) AS seq, arg_min(pos, struct_pack(s := seq, p := pos)) AS pos FROM fx_certs WHERE starts_with(name, 'ISO') GROUP BY 1, 2
-- query: upload_upsert uses: o_in o_base fx_certs
WITH t AS (SELECT i.seq, coalesce(b.m, f.m) AS target, b.m IS NULL AND i.seq = f.m AS is_new FROM o_in i JOIN (SELECT lower(name) AS k, min(seq) AS m FROM o_in GROUP BY 1) f ON f.k = lower(i.name)
  LEFT JOIN (SELECT lower(name) AS k, max(seq) AS m FROM o_base GROUP BY 1) b ON b.k = lower(i.name)),
n AS (SELECT t.*, c.name FROM t CROSS JOIN (VALUES ('iso 9001:2015'), ('Green Seal')) c(name)),
held AS (SELECT seq, name FROM fx_certs UNION ALL SELECT target, name FROM n WHERE is_new)
SELECT seq, name, count(*) AS n, 0 AS added FROM held GROUP BY 1, 2
UNION ALL SELECT DISTINCT target, name, 1, 1 FROM n WHERE NOT is_new AND NOT EXISTS (SELECT 1 FROM held h WHERE h.seq = n.target AND lower(h.name) = lower(n.name))
-- cte: o_place_pairs uses: o_in o_base
SELECT a.seq, b.seq AS bseq, b.region FROM o_in a JOIN o_base b ON lower(a.name) = lower(b.name) OR (a.city = b.city AND a.state = b.state AND (contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name))))
-- query: registry_upsert uses: o_in o_base o_place_pairs
WITH m AS (SELECT seq, min(bseq) AS target FROM o_place_pairs GROUP BY 1),
r AS (SELECT i.seq, m.target AS target_seq, 'updated' AS action FROM o_in i JOIN m USING (seq)
 UNION ALL SELECT i.seq, min(i.seq) OVER (PARTITION BY lower(i.name)), 'inserted' FROM o_in i WHERE i.seq NOT IN (SELECT seq FROM m) AND lower(i.name) NOT IN (SELECT lower(name) FROM o_base)),
l AS (SELECT target_seq, action, max(seq) AS last_seq, count(*) AS n_incoming FROM r GROUP BY 1, 2)
SELECT target_seq, action, n_incoming, CASE WHEN last_seq % 3 = 0 THEN 'Expired' ELSE 'Active' END AS status, CAST(CASE WHEN last_seq % 3 = 0 THEN 0 ELSE 15 END AS DOUBLE) AS score_impact, CASE WHEN last_seq % 3 = 0 THEN 0 ELSE 1 END AS accreditation_current FROM l
-- query: portal_upsert uses: o_in o_base o_place_pairs
WITH m AS (SELECT seq, min(bseq) AS target FROM o_place_pairs GROUP BY 1),
r AS (SELECT coalesce(m.target, i.seq) AS t, i.seq AS o, concat_ws(' ', city, state, country, CASE WHEN i.seq % 2 = 0 THEN 'Main Road 12' END) AS address, concat('PEH-', i.seq % 1000) AS no, '2025-09-27' AS d, prior_score_src / 100 AS q FROM o_in i LEFT JOIN m USING (seq)
 UNION ALL SELECT seq, -1, concat_ws(' ', city, state), 'PEH-1', CASE WHEN seq % 2 = 0 THEN '2025-09-27' ELSE '2025-10-01' END, prior_score_src / 100 FROM o_base)
SELECT t AS target_seq, arg_max(address, struct_pack(n := length(address), o := -o)) AS address, arg_max(no, struct_pack(d := d, n := length(no), o := -o)) AS accreditation_no, round(max(q), 6) AS quality_score, count(*) FILTER (o >= 0) AS n_incoming
FROM r GROUP BY 1 HAVING count(*) FILTER (o >= 0) > 0
-- cte: o_lab_match uses: o_pairs
SELECT aseq AS seq, min(bseq) AS match_seq FROM o_pairs WHERE al = bl OR (al <> '' AND bl <> '' AND (contains(al, bl) OR contains(bl, al))
 AND len(list_intersect(list_distinct(string_split(al, ' ')), list_distinct(string_split(bl, ' ')))) * 1.0 / greatest(len(string_split(al, ' ')), len(string_split(bl, ' '))) >= 0.6) GROUP BY 1
-- query: lab_upsert uses: o_in o_base o_lab_match
WITH h AS (SELECT match_seq, min(seq) AS seq FROM o_lab_match GROUP BY 1),
k AS (SELECT seq, unnest(list_distinct(string_split(lower(name), ' '))) AS w FROM o_base UNION SELECT h.match_seq, unnest(list_distinct(string_split(lower(i.name), ' '))) FROM h JOIN o_in i ON i.seq = h.seq
  UNION SELECT seq, unnest(list_distinct(string_split(lower(name), ' '))) FROM o_in WHERE seq NOT IN (SELECT seq FROM o_lab_match)),
s AS (SELECT b.seq, CASE WHEN h.seq IS NULL THEN data_source ELSE 'NABL' END AS data_source, CASE WHEN h.seq IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o_base b LEFT JOIN h ON h.match_seq = b.seq
  UNION ALL SELECT seq, 'NABL', 'added' FROM o_in WHERE seq NOT IN (SELECT seq FROM o_lab_match))
SELECT s.seq, data_source, action, n_keywords FROM s JOIN (SELECT seq, count(*) AS n_keywords FROM k GROUP BY 1) USING (seq)
-- query: lab_upsert_stats uses: o_in o_lab_match
SELECT count(DISTINCT match_seq) AS updated, count(*) - count(DISTINCT match_seq) AS duplicates, (SELECT count(*) FROM o_in) - count(*) AS added FROM o_lab_match
-- cte: o_similar uses: o_pairs
SELECT aseq AS seq, min(bseq) AS match_seq FROM o_pairs WHERE contains(ak, bk) OR contains(bk, ak)
 OR len(list_filter(list_intersect(list_distinct(string_split(ak, ' ')), list_distinct(string_split(bk, ' '))), lambda x: length(x) > 3)) >= 2 GROUP BY 1
-- query: batch_matches uses: o_keys
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, lab_key AS k, contains(lower(name), 'apex hospital') AS b, list_filter(list_distinct(string_split(lab_key, ' ')), lambda x: length(x) > 3) AS w FROM o_keys),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS target_seq, CAST([] AS STRUCT(seq BIGINT, k VARCHAR, b BOOLEAN, w VARCHAR[])[]) AS held
 UNION ALL SELECT i, seq, coalesce(hit, seq), CASE WHEN hit IS NULL THEN list_append(held, {'seq': seq, 'k': k, 'b': b, 'w': w}) ELSE held END
 FROM (SELECT r.i, r.seq, r.k, r.b, r.w, s.held, list_filter(s.held, lambda h: CASE WHEN r.b THEN h.b ELSE contains(h.k, r.k) OR contains(r.k, h.k) OR len(list_intersect(h.w, r.w)) >= 2 END)[1].seq AS hit FROM s JOIN r ON r.i = s.i + 1))
SELECT seq, target_seq FROM s WHERE i > 0
-- cte: o_arrived uses: o_in o_keys o_similar
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, lab_key AS k, false AS b, list_filter(list_distinct(string_split(lab_key, ' ')), lambda x: length(x) > 3) AS w FROM o_keys WHERE data_source = 'supplier' AND seq NOT IN (SELECT seq FROM o_similar)),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS target_seq, CAST([] AS STRUCT(seq BIGINT, k VARCHAR, b BOOLEAN, w VARCHAR[])[]) AS held
 UNION ALL SELECT i, seq, coalesce(hit, seq), CASE WHEN hit IS NULL THEN list_append(held, {'seq': seq, 'k': k, 'b': b, 'w': w}) ELSE held END
 FROM (SELECT r.i, r.seq, r.k, r.b, r.w, s.held, list_filter(s.held, lambda h: CASE WHEN r.b THEN h.b ELSE contains(h.k, r.k) OR contains(r.k, h.k) OR len(list_intersect(h.w, r.w)) >= 2 END)[1].seq AS hit FROM s JOIN r ON r.i = s.i + 1))
SELECT seq, target_seq FROM s WHERE i > 0
-- query: pathology_upsert uses: o_in o_base o_similar o_arrived
SELECT b.seq, concat(b.data_source, ', CAP') AS data_source, m.n AS added_certs, m.lab_name, 'updated' AS action FROM o_base b JOIN (SELECT match_seq, count(*) AS n, arg_max(name, seq) AS lab_name FROM o_similar JOIN o_in USING (seq) GROUP BY 1) m ON m.match_seq = b.seq
UNION ALL SELECT target_seq, 'CAP 15189', count(*) - 1, arg_max(i.name, i.seq), 'inserted' FROM o_arrived JOIN o_in i USING (seq) GROUP BY target_seq
-- cte: o_flags uses: fx_orgs
SELECT seq, 'jci_accredited' AS flag, seq % 3 = 0 AS value FROM fx_orgs UNION ALL SELECT seq, 'verified', CASE WHEN seq % 4 <> 0 THEN seq % 4 = 1 END FROM fx_orgs
-- cte: o_cap_routes uses: o_similar o_arrived
SELECT seq AS source_seq, match_seq AS seq FROM o_similar UNION ALL SELECT seq, target_seq FROM o_arrived
-- query: pathology_upsert_table uses: o_in o_base o_similar o_arrived
SELECT b.seq, CASE WHEN m.n IS NULL THEN b.data_source ELSE concat(b.data_source, ', CAP') END AS data_source, coalesce(m.n, 0) AS added_certs, m.lab_name, CASE WHEN m.n IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM o_base b LEFT JOIN (SELECT match_seq, count(*) AS n, arg_max(name, seq) AS lab_name FROM o_similar JOIN o_in USING (seq) GROUP BY 1) m ON m.match_seq = b.seq
UNION ALL SELECT target_seq, 'CAP 15189', count(*) - 1, arg_max(i.name, i.seq), 'inserted' FROM o_arrived JOIN o_in i USING (seq) GROUP BY target_seq
-- query: pathology_upsert_certs uses: fx_certs o_base o_cap_routes
WITH h AS (SELECT c.seq, c.pos, c.name, c.status, CAST(c.score_impact AS DOUBLE) AS score_impact FROM fx_certs c JOIN o_base USING (seq))
SELECT * FROM h UNION ALL SELECT r.seq, coalesce((SELECT max(pos) FROM h WHERE h.seq = r.seq), 0) + 1 + r.source_seq, 'College of American Pathologists (CAP)', 'Active', 18 FROM o_cap_routes r
-- query: pathology_upsert_flags uses: o_flags o_base o_cap_routes
SELECT seq, flag, value FROM o_flags JOIN o_base USING (seq)
UNION ALL SELECT r.seq, f.flag, true FROM (SELECT DISTINCT seq FROM o_cap_routes) r CROSS JOIN (VALUES ('cap_accredited'), ('iso_15189_accredited'), ('laboratory_accreditation'), ('international_accreditation'), ('accreditation_valid')) f(flag)
-- cte: o_registry_changed uses: o_in o_base o_place_pairs
WITH m AS (SELECT seq, min(bseq) AS target FROM o_place_pairs GROUP BY 1),
r AS (SELECT i.seq, m.target AS target_seq, 'updated' AS action FROM o_in i JOIN m USING (seq)
 UNION ALL SELECT i.seq, min(i.seq) OVER (PARTITION BY lower(i.name)), 'inserted' FROM o_in i WHERE i.seq NOT IN (SELECT seq FROM m) AND lower(i.name) NOT IN (SELECT lower(name) FROM o_base))
SELECT target_seq AS seq, action, max(r.seq) AS last_seq, count(*) AS n_incoming FROM r GROUP BY 1, 2
-- query: registry_upsert_table uses: fx_orgs o_base o_registry_changed
SELECT o.seq AS target_seq, o.data_source, o.name, o.city, o.state, o.country, o.region, o.hospital_type, o.website, o.phone, coalesce(c.action, 'kept') AS action, coalesce(c.n_incoming, 0) AS n_incoming,
 CASE WHEN c.seq IS NULL THEN NULL WHEN last_seq % 3 = 0 THEN 'Expired' ELSE 'Active' END AS status, CASE WHEN c.seq IS NOT NULL THEN concat('PEH-', last_seq % 1000) END AS accreditation_no, CASE WHEN c.seq IS NOT NULL THEN '2027-01-01' END AS valid_upto,
 CAST(CASE WHEN c.seq IS NULL THEN NULL WHEN last_seq % 3 = 0 THEN 0 ELSE 15 END AS DOUBLE) AS score_impact, CASE WHEN c.seq IS NULL THEN NULL WHEN last_seq % 3 = 0 THEN 0 ELSE 1 END AS accreditation_current
FROM fx_orgs o LEFT JOIN o_registry_changed c USING (seq) WHERE o.data_source = 'customer' OR c.action = 'inserted'
-- query: registry_upsert_certs uses: fx_certs o_base o_registry_changed
WITH h AS (SELECT c.seq, c.pos, c.name, CASE WHEN c.pos % 7 = 0 THEN 'NABH Entry Level' ELSE 'Other' END AS cert_type, c.status, CAST(c.score_impact AS DOUBLE) AS score_impact FROM fx_certs c JOIN o_base USING (seq)),
f AS (SELECT seq, min(pos) AS pos FROM h WHERE cert_type = 'NABH Entry Level' GROUP BY 1), l AS (SELECT seq, max(pos) AS pos FROM h GROUP BY 1)
SELECT h.*, CAST(NULL AS VARCHAR) AS accreditation_no, CAST(NULL AS VARCHAR) AS valid_upto FROM h WHERE NOT EXISTS (SELECT 1 FROM f JOIN o_registry_changed c USING (seq) WHERE f.seq = h.seq AND f.pos = h.pos)
UNION ALL SELECT c.seq, coalesce(f.pos, coalesce(l.pos, 0) + 1), 'National Accreditation Board for Hospitals & Healthcare Providers (NABH) - Entry Level', 'NABH Entry Level', CASE WHEN last_seq % 3 = 0 THEN 'Expired' ELSE 'Active' END,
 CASE WHEN last_seq % 3 = 0 THEN 0 ELSE 15 END, concat('PEH-', last_seq % 1000), '2027-01-01' FROM o_registry_changed c LEFT JOIN f USING (seq) LEFT JOIN l USING (seq)
-- query: registry_upsert_flags uses: o_flags o_base o_registry_changed
SELECT seq, flag, value FROM o_flags JOIN o_base USING (seq)
UNION ALL SELECT c.seq, f.flag, f.flag <> 'accreditation_current' OR last_seq % 3 <> 0 FROM o_registry_changed c CROSS JOIN (VALUES ('nabh_accredited'), ('nabh_entry_level'), ('accreditation_current')) f(flag)
-- query: branded_lab_upsert uses: o_in o_base
WITH m AS (SELECT a.seq, a.hospital_type, min(b.seq) AS t FROM o_in a JOIN o_base b ON contains(lower(b.name), 'apex') AND ((contains(lower(a.name), 'hospital') AND contains(lower(b.name), 'hospital'))
  OR (contains(lower(a.name), 'clinic') AND contains(lower(b.name), 'clinic')) OR (contains(lower(a.name), 'institute') AND contains(lower(b.name), 'institute'))) GROUP BY 1, 2)
SELECT b.seq, round(least(100, b.prior_score_src / 100 + 18.0 * count(*)), 6) AS quality_score, 'Clinic|Pathology' AS specialties, count(*) AS n_labs FROM m JOIN o_base b ON b.seq = m.t GROUP BY b.seq, b.prior_score_src
-- cte: o_brand uses: o_in o_base
SELECT a.seq, a.hospital_type, min(b.seq) AS t FROM o_in a JOIN o_base b ON contains(lower(b.name), 'apex') AND ((contains(lower(a.name), 'hospital') AND contains(lower(b.name), 'hospital'))
  OR (contains(lower(a.name), 'clinic') AND contains(lower(b.name), 'clinic')) OR (contains(lower(a.name), 'institute') AND contains(lower(b.name), 'institute'))) GROUP BY 1, 2
-- query: branded_lab_upsert_table uses: o_in o_base o_brand
SELECT b.seq, round(CASE WHEN m.n IS NULL THEN b.prior_score_src / 100 ELSE least(100, b.prior_score_src / 100 + 18.0 * m.n) END, 6) AS quality_score, CASE WHEN m.n IS NULL THEN 'Clinic' ELSE 'Clinic|Pathology' END AS specialties, coalesce(m.n, 0) AS n_labs, CASE WHEN m.n IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM o_base b LEFT JOIN (SELECT t, count(*) AS n FROM o_brand GROUP BY 1) m ON m.t = b.seq
UNION ALL SELECT seq, 95, concat('Pathology|', hospital_type), 0, 'inserted' FROM o_in WHERE seq NOT IN (SELECT seq FROM o_brand)
-- query: branded_lab_upsert_certs uses: o_in o_base o_brand fx_certs
WITH h AS (SELECT c.seq, c.pos, c.name FROM fx_certs c JOIN o_base USING (seq))
SELECT * FROM h UNION ALL SELECT t, coalesce((SELECT max(pos) FROM h WHERE h.seq = t), 0) + 1 + seq * 2 + 1, 'CAP 15189' FROM o_brand
UNION ALL SELECT seq, 1, 'CAP 15189' FROM o_in WHERE seq NOT IN (SELECT seq FROM o_brand)
-- query: branded_lab_upsert_initiatives uses: o_in o_base o_brand fx_initiatives
WITH h AS (SELECT i.seq, i.pos, i.category FROM fx_initiatives i JOIN o_base USING (seq)), n(pos, category) AS (VALUES (1, 'Laboratory Quality'), (2, 'Research'))
SELECT * FROM h UNION ALL SELECT t, coalesce((SELECT max(pos) FROM h WHERE h.seq = t), 0) + 1 + seq * 3 + n.pos, n.category FROM o_brand CROSS JOIN n
UNION ALL SELECT seq, n.pos, n.category FROM o_in CROSS JOIN n WHERE seq NOT IN (SELECT seq FROM o_brand)
-- query: branded_lab_upsert_flags uses: o_flags o_in o_base o_brand
SELECT seq, flag, value FROM o_flags JOIN o_base USING (seq)
UNION ALL SELECT r.seq, f.flag, true FROM (SELECT t AS seq FROM o_brand UNION SELECT seq FROM o_in WHERE seq NOT IN (SELECT seq FROM o_brand)) r
 CROSS JOIN (VALUES ('cap_accredited'), ('iso_15189_accredited'), ('laboratory_accreditation'), ('international_accreditation'), ('accreditation_valid')) f(flag)
-- cte: o_global uses: o_keys o_in o_base
SELECT i.seq, min(b.seq) AS t FROM o_keys i JOIN o_keys b ON i.data_source = 'supplier' AND b.data_source = 'customer' AND i.company_key = b.company_key AND i.company_key <> '' GROUP BY 1
-- query: global_upsert uses: o_base o_in o_global
SELECT b.seq, CASE WHEN b.city <> '' THEN b.city ELSE coalesce(f.city, b.city) END AS city, CASE WHEN b.state <> '' THEN b.state ELSE coalesce(f.state, b.state) END AS state,
 CASE WHEN f.names IS NULL THEN b.data_source ELSE concat(b.data_source, ', ', f.names) END AS data_source
FROM o_base b LEFT JOIN (SELECT t, arg_min(city, seq) FILTER (city <> '') AS city, arg_min(state, seq) FILTER (state <> '') AS state,
  CASE WHEN count(DISTINCT seq % 2) = 1 THEN concat('feed', min(seq) % 2) ELSE concat('feed', min(seq) % 2, ', feed', 1 - min(seq) % 2) END AS names
  FROM o_global JOIN o_in USING (seq) GROUP BY 1) f ON f.t = b.seq
-- query: global_certs uses: o_keys fx_certs fx_registry
WITH k AS (SELECT seq, data_source, company_key FROM o_keys WHERE company_key <> ''),
f AS (SELECT company_key, coalesce(min(seq) FILTER (data_source = 'customer'), min(seq)) AS t FROM k GROUP BY 1),
off AS (SELECT DISTINCT company_key FROM o_keys JOIN fx_registry r USING (seq) WHERE NOT r.verification_required),
extra AS (SELECT DISTINCT f.t, c.name FROM k JOIN f USING (company_key) CROSS JOIN (VALUES ('JCI'), ('iso 15189')) c(name) WHERE k.data_source = 'supplier' AND (c.name <> 'JCI' OR company_key IN (SELECT company_key FROM off))
  AND NOT EXISTS (SELECT 1 FROM fx_certs x WHERE x.seq = f.t AND lower(x.name) = lower(c.name)))
SELECT seq, count(*) AS n, CAST(sum(v) AS BIGINT) AS n_validated FROM (SELECT seq, 0 AS v FROM fx_certs WHERE seq < 1000000000 UNION ALL SELECT t, 1 FROM extra) GROUP BY 1
-- query: two_registry_merge uses: o_keys fx_certs
WITH g AS (SELECT seq, data_source, min(seq) OVER (PARTITION BY hospital_key) AS group_seq FROM o_keys),
b AS (SELECT g.group_seq, c.name FROM fx_certs c JOIN g USING (seq) WHERE g.seq = g.group_seq),
e AS (SELECT DISTINCT g.group_seq, c.name FROM fx_certs c JOIN g USING (seq) WHERE g.seq <> g.group_seq AND NOT EXISTS (SELECT 1 FROM b WHERE b.group_seq = g.group_seq AND b.name = c.name))
SELECT s.group_seq, s.data_source, coalesce(n.n, 0) AS n_certs FROM (SELECT group_seq, CASE WHEN count(DISTINCT data_source) = 2 THEN 'customer, supplier' ELSE min(data_source) END AS data_source FROM g GROUP BY 1) s
LEFT JOIN (SELECT group_seq, count(*) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY 1) n USING (group_seq)
-- query: submission_upsert uses: o_in o_base
WITH i AS (SELECT seq, name, concat_ws(', ', city, country) AS location, CASE WHEN phone <> '' THEN phone END AS phone, hospital_type FROM o_in),
b AS (SELECT seq, name, concat_ws(', ', city, country) AS location, phone, hospital_type, data_source FROM o_base),
l AS (SELECT lower(trim(name)) AS n, lower(trim(location)) AS l, min(seq) AS new, arg_max(name, seq) AS name, arg_max(location, seq) AS location, arg_max(phone, seq) FILTER (phone IS NOT NULL) AS phone, arg_max(hospital_type, seq) AS hospital_type FROM i GROUP BY 1, 2),
t AS (SELECT lower(trim(name)) AS n, lower(trim(location)) AS l, min(seq) AS seq FROM b GROUP BY 1, 2),
u AS (SELECT l.*, t.seq AS target FROM l LEFT JOIN t USING (n, l))
SELECT b.seq, coalesce(u.name, b.name) AS name, coalesce(u.location, b.location) AS location, coalesce(u.phone, b.phone) AS phone, coalesce(u.hospital_type, b.hospital_type) AS hospital_type, b.data_source, CASE WHEN u.target IS NULL THEN '2025-01-01' ELSE '2025-10-01' END AS last_updated
FROM b LEFT JOIN u ON u.target = b.seq UNION ALL SELECT new, name, location, phone, hospital_type, 'website_upload', '2025-10-01' FROM u WHERE target IS NULL
-- query: family_certs_dropped uses: fx_orgs fx_certs
SELECT c.seq, count(*) AS n_certs FROM fx_certs c JOIN fx_orgs o USING (seq) WHERE NOT ((contains(lower(o.name), 'apex') OR contains(lower(o.name), 'royal')) AND (upper(c.name) LIKE '%JCI%' OR upper(c.name) LIKE '%JOINT COMMISSION%')) GROUP BY 1
-- query: flags_unset uses: fx_orgs
SELECT seq, 'jci_accredited' AS flag, CASE WHEN contains(lower(name), 'apex') THEN 0 ELSE (seq % 3 = 0)::INT END AS value FROM fx_orgs
UNION ALL SELECT seq, 'verified', CASE WHEN seq % 4 <> 0 THEN (seq % 4 = 1)::INT END FROM fx_orgs
-- query: superseded_dropped uses: fx_orgs fx_certs
SELECT count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM fx_orgs WHERE seq <> coalesce((SELECT min(o.seq) FROM fx_orgs o JOIN fx_certs c USING (seq) WHERE contains(lower(o.name), 'apex') AND c.pos % 500 = 338), -1)
-- query: insert_absent uses: fx_orgs
SELECT seq, name, country FROM fx_orgs UNION ALL SELECT -2, 'Quiet Harbour Home', 'USA'
UNION ALL SELECT -1, 'Apex Hospital', 'INDIA' WHERE NOT EXISTS (SELECT 1 FROM fx_orgs WHERE contains(lower(name), 'apex hospital'))
-- query: run_statistics uses: o_in o_base
WITH m AS (SELECT count(*) AS n FROM o_in WHERE lower(trim(name)) IN (SELECT lower(trim(name)) FROM o_base)), i AS (SELECT count(*) AS n FROM o_in), b AS (SELECT count(*) AS n FROM o_base)
SELECT 'updated' AS what, m.n FROM m UNION ALL SELECT 'added', i.n - m.n FROM i, m UNION ALL SELECT 'before', n FROM b UNION ALL SELECT 'processed', n FROM i UNION ALL SELECT 'final', b.n + i.n - m.n FROM b, i, m
-- query: append_feed uses: fx_orgs
SELECT CASE WHEN data_source = 'supplier' THEN 'NABH_Dental' ELSE data_source END AS data_source, count(*) AS n FROM fx_orgs GROUP BY 1
