-- cte: o_in uses: fx_orgs
SELECT * FROM fx_orgs WHERE data_source = 'supplier'
-- cte: o_base uses: fx_orgs
SELECT * FROM fx_orgs WHERE data_source = 'customer'
-- cte: o_keys uses: fx_orgs
SELECT seq, data_source, city, state, country, name,
 trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS alnum_key,
 trim(regexp_replace(regexp_replace(lower(trim(name)), '[\-_,.&''"]', ' ', 'g'), '\s+', ' ', 'g')) AS score_key,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[\.,''&()\-]', ' ', 'g'), '\s+', ' ', 'g'),
   '\bprivate limited\b', '', 'g'), '\bpvt\.? ltd\.?\b', '', 'g'), '\bhospital(s)?\b|\bmedical center\b', '', 'g'), '\bhealthcare\b', '', 'g')) AS company_key,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\b(private\s+limited|pvt\.?\s*ltd\.?|ltd\.?|limited)\b', ' ', 'g'),
   '\b(hospital|medical\s+center|medical\s+centre|clinic|institute|laboratory|labs?)\b', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS lab_match_key,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\b(ltd|limited|pvt|private|inc|incorporated|corp|corporation|co|company|hospital|hospitals|healthcare|medical|centre|center|institute|clinic)\b\.?', '', 'g'),
   '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS registry_key,
 trim(regexp_replace(regexp_replace(lower(name), '\s*(hospital|medical center|medical centre|clinic|institute|ltd|pvt|private limited)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS hospital_key,
 trim(regexp_replace(regexp_replace(lower(name), '\s*(laboratory|laboratories|lab|labs|inc|llc|ltd|pvt|private limited|corporation|corp)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS lab_key,
 trim(regexp_replace(regexp_replace(regexp_replace(name, '\b(hospital|medical|center|centre|institute|research|health|care|system|ltd|limited|pvt|private|inc|corporation|corp)\b', '', 'gi'),
   '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS search_key,
 trim(regexp_replace(lower(name), '[^\w\s]', '', 'g')) AS plain
FROM fx_orgs
-- query: name_keys uses: o_keys
SELECT seq, alnum_key, score_key, company_key, lab_match_key, registry_key, hospital_key, lab_key, search_key FROM o_keys
-- cte: o_canon uses: fx_orgs
SELECT seq, lower(trim(regexp_replace(regexp_replace(CASE WHEN ends_with(lower(t0), lower(country)) THEN rtrim(left(t0, length(t0) - length(country)), ' ,-/') ELSE t0 END, '(?i)(india|united states|usa)$', ''), '\s+', ' ', 'g'))) AS canonical_name
FROM (SELECT seq, city, state, country, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(name, '\([^)]*\)', '', 'g')), '\s+', ' ', 'g'),
  '\bprivate\s+limited\b', 'pvt. ltd.', 'gi'), '\bpvt\.?\s*ltd\b', 'pvt. ltd.', 'gi') AS t0 FROM fx_orgs)
-- query: canonical_names uses: o_canon
SELECT seq, canonical_name, canonical_name AS loader_name FROM o_canon
-- query: cert_keys uses: fx_certs
SELECT name, CASE WHEN name LIKE 'Joint Commission%' THEN 'JCI' WHEN name LIKE '%NABH%' THEN 'NABH' WHEN name LIKE 'CAP%' OR name LIKE 'College%' THEN 'CAP'
  WHEN name LIKE 'ISO%' THEN concat('ISO', regexp_extract(name, '([0-9]+)', 1)) WHEN name = 'NABL Testing' THEN 'NABL TEST G'
  WHEN name = 'Magnet Recognition' THEN 'MAGNET RECOGNITI' WHEN name = 'State License' THEN 'ST E LICENSE' WHEN name = 'Local Permit' THEN 'LOCAL PERMIT' END AS cert_key, count(*) AS n
FROM fx_certs GROUP BY 1, 2
-- query: match_same_name uses: o_in o_base
SELECT a.seq, min(b.seq) AS match_seq FROM o_in a JOIN o_base b ON lower(trim(a.name)) = lower(trim(b.name)) GROUP BY 1
-- query: match_verified_registry uses: o_keys fx_registry
SELECT o.seq, min(r.seq) AS match_seq FROM o_keys o JOIN fx_registry r ON NOT r.verification_required
 AND o.hospital_key = trim(regexp_replace(regexp_replace(lower(r.name), '\s*(hospital|medical center|medical centre|clinic|institute|ltd|pvt|private limited)\s*', ' ', 'g'), '\s+', ' ', 'g'))
 AND ((r.city <> '' AND contains(lower(o.name), lower(r.city))) OR contains(lower(o.name), lower(r.country))) GROUP BY 1
-- query: match_located_name uses: fx_orgs o_in
SELECT o.seq, min(r.seq) AS match_seq FROM fx_orgs o JOIN o_in r ON lower(trim(o.name)) = lower(trim(r.name)) AND
 CASE WHEN o.city <> '' AND r.city <> '' THEN lower(o.city) = lower(r.city) WHEN o.state <> '' AND r.state <> '' THEN lower(o.state) = lower(r.state) ELSE true END GROUP BY 1
-- query: registry_valid uses: fx_orgs fx_registry
SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM fx_registry r WHERE lower(r.name) = lower(o.name) AND (NOT r.verification_required OR (r.city <> '' AND r.city = o.city))) THEN 1 ELSE 0 END AS registry_valid FROM fx_orgs o
-- query: insert_by_place uses: o_in o_base
SELECT min(seq) AS seq, arg_min(name, seq) AS name FROM o_in a WHERE NOT EXISTS (SELECT 1 FROM o_base b WHERE lower(a.name) = lower(b.name) AND lower(a.city) = lower(b.city) AND lower(a.state) = lower(b.state)) GROUP BY lower(name), lower(city), lower(state)
-- query: insert_by_name uses: o_in o_base
SELECT seq, name FROM o_in a WHERE lower(name) NOT IN (SELECT lower(name) FROM o_base)
-- query: insert_by_name_once uses: o_in o_base
SELECT min(seq) AS seq, arg_min(name, seq) AS name FROM o_in a WHERE lower(name) NOT IN (SELECT lower(name) FROM o_base) GROUP BY lower(name)
-- cte: o_last_base uses: o_base
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY seq DESC) AS k FROM o_base) WHERE k = 1
-- query: enrich_last uses: o_in o_last_base
SELECT a.seq, CASE WHEN b.seq IS NULL THEN 0 ELSE 1 END AS enriched, b.phone AS extra_phone, b.website AS extra_website FROM o_in a LEFT JOIN o_last_base b ON lower(trim(a.name)) = lower(trim(b.name))
-- query: fill_from_existing uses: o_in o_last_base
SELECT a.seq, CASE WHEN a.city <> '' THEN a.city ELSE b.city END AS city, CASE WHEN a.phone <> '' THEN a.phone ELSE b.phone END AS phone FROM o_in a LEFT JOIN o_last_base b ON lower(trim(a.name)) = lower(trim(b.name))
-- cte: o_pairs uses: o_keys
SELECT a.seq AS aseq, b.seq AS bseq, a.name AS aname, b.name AS bname, a.city AS acity, b.city AS bcity, a.state AS astate, b.state AS bstate,
 a.plain AS ap, b.plain AS bp, a.lab_match_key AS al, b.lab_match_key AS bl, a.lab_key AS ak, b.lab_key AS bk, a.score_key AS ask, b.score_key AS bsk
FROM o_keys a JOIN o_keys b ON a.data_source = 'supplier' AND b.data_source = 'customer'
-- query: match_tiered uses: o_pairs
SELECT aseq AS seq, min(bseq) AS match_seq FROM o_pairs WHERE contains(ap, bp) OR contains(bp, ap)
 OR len(list_intersect(list_distinct(string_split_regex(ap, '\s+')), list_distinct(string_split_regex(bp, '\s+')))) * 1.0
    / len(list_distinct(list_concat(string_split_regex(ap, '\s+'), string_split_regex(bp, '\s+')))) >= 0.8 GROUP BY 1
-- query: match_same_place uses: o_pairs
SELECT aseq AS seq, min(bseq) AS match_seq FROM o_pairs WHERE lower(aname) = lower(bname) OR (acity = bcity AND astate = bstate AND (contains(lower(aname), lower(bname)) OR contains(lower(bname), lower(aname)))) GROUP BY 1
-- query: match_three_keys uses: o_pairs fx_certs
SELECT seq, min(m) AS match_seq FROM (
 SELECT aseq AS seq, bseq AS m FROM o_pairs WHERE acity = bcity AND astate = bstate AND (lower(aname) = lower(bname) OR ((contains(lower(aname), lower(bname)) OR contains(lower(bname), lower(aname))) AND length(aname) > 5 AND length(bname) > 5))
 UNION ALL SELECT p.seq, c.seq FROM (SELECT DISTINCT aseq AS seq FROM o_pairs) p JOIN fx_certs c ON c.name LIKE 'NABH%' AND p.seq % 5 = 0 AND c.pos % 400 = p.seq % 97) GROUP BY 1
-- query: match_lab_name uses: o_pairs
SELECT aseq AS seq, min(bseq) AS match_seq FROM o_pairs WHERE al = bl OR (al <> '' AND bl <> '' AND (contains(al, bl) OR contains(bl, al))
 AND len(list_intersect(list_distinct(string_split(al, ' ')), list_distinct(string_split(bl, ' ')))) * 1.0 / greatest(len(string_split(al, ' ')), len(string_split(bl, ' '))) >= 0.6) GROUP BY 1
-- query: match_similar_name uses: o_pairs
SELECT aseq AS seq, min(bseq) AS match_seq FROM o_pairs WHERE contains(ak, bk) OR contains(bk, ak)
 OR len(list_filter(list_intersect(list_distinct(string_split(ak, ' ')), list_distinct(string_split(bk, ' '))), lambda x: length(x) > 3)) >= 2 GROUP BY 1
-- query: match_sub_brand uses: o_in o_base
SELECT a.seq, min(b.seq) AS match_seq FROM o_in a JOIN o_base b ON contains(lower(b.name), 'apex') AND (
 (contains(lower(a.name), 'hospital') AND contains(lower(b.name), 'hospital')) OR (contains(lower(a.name), 'clinic') AND contains(lower(b.name), 'clinic'))
 OR (contains(lower(a.name), 'institute') AND contains(lower(b.name), 'institute')) OR lower(a.name) = 'apex' OR lower(b.name) = 'apex') GROUP BY 1
-- cte: o_fuzzy uses: o_keys
SELECT seq, match_seq, similarity, CASE WHEN similarity > 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM (
 SELECT a.seq, b.seq AS match_seq, len(list_intersect(list_distinct(string_split(a.registry_key, ' ')), list_distinct(string_split(b.registry_key, ' ')))) * 1.0
   / len(list_distinct(list_concat(string_split(a.registry_key, ' '), string_split(b.registry_key, ' ')))) AS similarity,
  row_number() OVER (PARTITION BY a.seq ORDER BY similarity DESC, b.seq) AS k
 FROM o_keys a JOIN o_keys b ON b.data_source = 'supplier') WHERE k = 1 AND similarity > 0.7
-- query: match_fuzzy_registry uses: o_fuzzy
SELECT seq, match_seq, round(CAST(similarity AS DOUBLE), 6) AS similarity, confidence FROM o_fuzzy
-- cte: o_reg2 uses: o_keys
SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' ', name, city)), '\b(ltd|limited|pvt|private|inc|incorporated|corp|corporation|co|company|hospital|hospitals|healthcare|medical|centre|center|institute|clinic)\b\.?', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS k1,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' ', country, name)), '\b(ltd|limited|pvt|private|inc|incorporated|corp|corporation|co|company|hospital|hospitals|healthcare|medical|centre|center|institute|clinic)\b\.?', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS k2
FROM o_keys WHERE data_source = 'supplier'
-- query: match_cascade uses: o_keys o_reg2
SELECT o.seq, coalesce(d.m, f.m) AS match_seq, CASE WHEN d.m IS NOT NULL THEN d.method WHEN f.m IS NOT NULL THEN 'fuzzy_match' ELSE 'not_found' END AS method,
 CASE WHEN d.m IS NOT NULL THEN 'high' WHEN f.s > 0.8 THEN 'medium' WHEN f.m IS NOT NULL THEN 'low' ELSE 'none' END AS confidence
FROM o_keys o LEFT JOIN (
 SELECT a.seq, min(b.seq) AS m, arg_min(CASE WHEN contains(b.k1, a.registry_key) THEN 'direct_name_match' ELSE 'organization_name_match' END, b.seq) AS method
 FROM o_keys a JOIN o_reg2 b ON contains(b.k1, a.registry_key) OR contains(b.k2, a.registry_key) GROUP BY 1) d ON d.seq = o.seq
LEFT JOIN (SELECT * FROM (SELECT a.seq, b.seq AS m, len(list_intersect(list_distinct(string_split(a.registry_key, ' ')), list_distinct(string_split(b.k1, ' ')))) * 1.0
   / len(list_distinct(list_concat(string_split(a.registry_key, ' '), string_split(b.k1, ' ')))) AS s, row_number() OVER (PARTITION BY a.seq ORDER BY s DESC, b.seq) AS k
 FROM o_keys a JOIN o_reg2 b ON true) WHERE k = 1 AND s > 0.7) f ON f.seq = o.seq
-- query: scored_lookup uses: o_pairs o_base
SELECT seq, coalesce(e, p) AS match_seq, CASE WHEN e IS NOT NULL THEN 'precomputed_exact' WHEN p IS NOT NULL THEN 'precomputed_partial' ELSE 'live' END AS source FROM (
 SELECT aseq AS seq, max(bseq) FILTER (ask = bsk) AS e, arg_min(bseq, struct_pack(s := -b.prior_score_src, q := bseq)) FILTER (contains(ask, bsk) OR contains(bsk, ask)) AS p
 FROM o_pairs JOIN o_base b ON b.seq = bseq GROUP BY 1)
-- query: match_loose_registry uses: fx_orgs fx_registry
SELECT seq, coalesce(e, p) AS match_seq FROM (
 SELECT o.seq, min(r.seq) FILTER (lower(o.name) = lower(r.name)) AS e, min(r.seq) FILTER (contains(lower(o.name), lower(r.name)) OR contains(lower(r.name), lower(o.name))
   OR len(list_filter(string_split(lower(o.name), ' '), lambda x: length(x) > 3 AND contains(lower(r.name), x))) > 0) AS p
 FROM fx_orgs o JOIN fx_registry r ON true GROUP BY 1) WHERE coalesce(e, p) IS NOT NULL
-- query: country_regions uses: fx_orgs
SELECT seq, CASE WHEN seq % 2 = 0 THEN 'Global' WHEN seq % 5 = 0 THEN 'Asia-Pacific' WHEN seq % 5 = 1 THEN 'North America' WHEN seq % 5 = 2 THEN 'Europe' WHEN seq % 5 = 3 THEN 'Middle East' ELSE 'Global' END AS broad_region,
 CASE WHEN seq % 2 = 0 THEN 'developing' WHEN seq % 5 IN (1, 2) THEN 'developed' ELSE 'developing' END AS region_type FROM fx_orgs
-- query: region_peers uses: fx_orgs
SELECT subject, peer, row_number() OVER (PARTITION BY subject ORDER BY s DESC, peer) AS place FROM (SELECT a.seq AS subject, b.seq AS peer, b.prior_score_src AS s, row_number() OVER (PARTITION BY a.seq ORDER BY b.seq) AS k
 FROM fx_orgs a JOIN fx_orgs b ON (lower(a.country) = lower(b.country) OR lower(a.country) = lower(b.region)) AND lower(a.name) <> lower(b.name)) WHERE k <= 8
-- query: branch_groups uses: fx_orgs
SELECT seq, CASE WHEN seq % 4 = 0 THEN CASE WHEN contains(lower(split_part(name, ' ', 1)), 'max') THEN 'max healthcare' ELSE 'narayana health' END WHEN seq % 4 = 1 THEN 'max healthcare' END AS group_name,
 CAST(CASE WHEN seq % 4 = 0 THEN 23 WHEN seq % 4 = 1 THEN 17 ELSE 0 END AS BIGINT) AS branches,
 CASE WHEN seq % 4 < 2 THEN 'multi_location' WHEN seq % 4 = 2 THEN 'specific_location' ELSE 'single_location' END AS search_type FROM fx_orgs
-- cte: o_search uses: fx_asked
SELECT query_no, q, list_distinct(list_filter(string_split(q, ' '), lambda x: x <> '')) AS qw, lower(trim(regexp_replace(regexp_replace(regexp_replace(q, '\b(hospital|medical|center|centre|institute|research|health|care|system|ltd|limited|pvt|private|inc|corporation|corp)\b', '', 'gi'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS qk FROM (SELECT query_no, lower(trim(query)) AS q FROM fx_asked) WHERE q <> ''
-- cte: o_searched uses: fx_orgs o_search
SELECT *, contains(n, q) OR contains(q, n) AS within, contains(o, q) OR contains(q, o) AS within_original FROM o_search, (SELECT seq, lower(trim(name)) AS n, lower(trim(concat(country, ' ', name))) AS o,
 list_distinct(list_filter(string_split(lower(trim(name)), ' '), lambda x: x <> '')) AS nw, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '\b(hospital|medical|center|centre|institute|research|health|care|system|ltd|limited|pvt|private|inc|corporation|corp)\b', '', 'gi'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS nk FROM fx_orgs WHERE name <> '')
-- query: lookup_names uses: o_searched
SELECT CAST(query_no AS BIGINT) AS query_no, ['exact', 'contained', 'original_name', 'fuzzy'][tier + 1] AS method, seq AS match_seq, round(CASE WHEN tier < 3 THEN 1 ELSE s END, 6)::DOUBLE AS score FROM (
SELECT *, CASE WHEN n = q THEN 0 WHEN within THEN 1 WHEN within_original THEN 2 WHEN s >= 0.6 THEN 3 END AS tier FROM (
SELECT *, greatest(0.4 * (CASE WHEN greatest(length(q), length(n)) = 0 THEN 1 ELSE 1 - levenshtein(q, n) / greatest(length(q), length(n)) END) + 0.6 * len(list_intersect(qw, nw)) / len(qw), CASE WHEN contains(q, 'john hopkins') AND contains(n, 'johns hopkins') THEN 0.9 ELSE 0 END) AS s FROM o_searched))
WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY tier, CASE WHEN tier < 3 THEN 0 ELSE -round(s, 12) END, seq) = 1
-- query: ranked_search uses: o_searched
SELECT CAST(query_no AS BIGINT) AS query_no, seq, round(s, 6)::DOUBLE AS score FROM (SELECT query_no, seq, CASE WHEN n = q THEN 1 WHEN contains(n, q) THEN greatest(p, 0.9) ELSE p END AS s FROM (
SELECT *, 0.3 * (CASE WHEN greatest(length(q), length(n)) = 0 THEN 1 ELSE 1 - levenshtein(q, n) / greatest(length(q), length(n)) END) + 0.25 * (CASE WHEN greatest(length(qk), length(nk)) = 0 THEN 1 ELSE 1 - levenshtein(qk, nk) / greatest(length(qk), length(nk)) END) + 0.2 * len(list_intersect(qw, nw)) / len(qw) + 0.15 * within::INT + 0.05 * (CASE WHEN greatest(length(q), length(o)) = 0 THEN 1 ELSE 1 - levenshtein(q, o) / greatest(length(q), length(o)) END) + 0.05 * within_original::INT AS p FROM o_searched)) WHERE s >= 0.6
