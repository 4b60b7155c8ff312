-- cte: o_cert uses: fx_certs
SELECT seq, pos, name, upper(name) AS up, score_impact,
  CASE WHEN upper(trim(status)) IN ('ACTIVE','ACCREDITED','ACCREDITATION','VALID','CURRENT','COMPLIANT','CERTIFIED') THEN 'Active'
       WHEN upper(trim(status)) IN ('IN PROGRESS','PENDING','APPLIED','UNDER REVIEW') THEN 'In Progress'
       ELSE status END AS st,
  CASE WHEN upper(name) LIKE '%JCI%' OR upper(name) LIKE '%JOINT COMMISSION%' THEN 'JCI'
       WHEN upper(name) LIKE '%MAGNET%' THEN 'MAGNET'
       WHEN regexp_matches(upper(name), 'ISO ?9001') THEN 'ISO_9001'
       WHEN regexp_matches(upper(name), 'ISO ?13485') THEN 'ISO_13485'
       WHEN regexp_matches(upper(name), 'ISO ?15189') THEN 'ISO_15189'
       WHEN regexp_matches(upper(name), 'ISO ?27001') THEN 'ISO_27001'
       WHEN regexp_matches(upper(name), 'ISO ?45001') THEN 'ISO_45001'
       WHEN regexp_matches(upper(name), 'ISO ?14001') THEN 'ISO_14001'
       WHEN regexp_matches(upper(name), 'ISO ?50001') THEN 'ISO_50001'
       WHEN upper(name) LIKE '%ISO%' THEN 'ISO_GENERAL'
       WHEN upper(name) LIKE '%CAP%' OR upper(name) LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%' THEN 'CAP'
       WHEN upper(name) LIKE '%NABH%' THEN 'NABH'
       WHEN upper(name) LIKE '%NABL%' THEN 'NABL'
       WHEN upper(name) LIKE '%STATE%' OR upper(name) LIKE '%PROVINCIAL%' THEN 'STATE'
       ELSE 'LOCAL' END AS kind
FROM fx_certs
-- cte: o_weights
SELECT * FROM (VALUES ('JCI',4.5,35),('MAGNET',4.0,32),('ISO_9001',3.5,28),('ISO_13485',3.5,28),('ISO_15189',3.8,30),
  ('ISO_27001',4.0,32),('ISO_45001',3.6,29),('ISO_14001',3.2,26),('ISO_50001',2.8,22),('ISO_GENERAL',2.5,20),
  ('CAP',4.2,34),('NABH',3.8,30),('NABL',3.6,28),('STATE',2.2,18),('LOCAL',1.8,15)) AS t(kind, weight, base)
-- cte: o_cert_all uses: o_cert
SELECT seq, name, up, kind, st, CAST(score_impact AS DOUBLE) AS impact FROM o_cert
UNION ALL
SELECT seq, 'ISO 15189 (Implied by NABL)', 'ISO 15189 (IMPLIED BY NABL)', 'ISO_15189', 'Active', 22.0
FROM o_cert GROUP BY seq
HAVING count(*) FILTER (up LIKE '%NABL%' AND st = 'Active') > 0 AND count(*) FILTER (regexp_matches(up, 'ISO ?15189')) = 0
-- cte: o_cert_points uses: o_cert_all o_weights
SELECT c.seq, c.kind, w.weight,
  coalesce(c.impact, w.base) * w.weight * CASE WHEN c.st = 'Active' THEN 1.0 ELSE 0.5 END AS pts
FROM o_cert_all c JOIN o_weights w USING (kind) WHERE c.st IN ('Active', 'In Progress')
-- cte: o_cert_score uses: fx_orgs o_cert_points o_cert_all
SELECT o.seq, coalesce(p.n, 0) AS scored_certs, coalesce(p.pts, 0) AS points,
  CASE WHEN coalesce(p.n, 0) > 1 THEN least(p.n * 2, 10) ELSE 0 END AS diversity_bonus,
  least(coalesce(i.k, 0) * 3, 12) AS international_bonus,
  least(coalesce(p.pts, 0) + CASE WHEN coalesce(p.n, 0) > 1 THEN least(p.n * 2, 10) ELSE 0 END + least(coalesce(i.k, 0) * 3, 12), 75) AS certification_score,
  coalesce(i.rec, 0) AS recognised
FROM fx_orgs o
LEFT JOIN (SELECT seq, count(*) AS n, sum(pts) AS pts FROM o_cert_points GROUP BY seq) p USING (seq)
LEFT JOIN (SELECT seq, count(*) FILTER (st = 'Active' AND regexp_matches(up, 'JCI|ISO|JOINT COMMISSION|MAGNET')) AS k,
             count(*) FILTER (regexp_matches(up, 'NABH|JCI|CAP|ISO|NABL')) AS rec FROM o_cert_all GROUP BY seq) i USING (seq)
-- cte: o_std
SELECT * FROM (VALUES ('CAP',8,'Laboratory Standards'),('JCI',10,'Hospital Accreditation'),('ISO 9001',4,'Quality Management'),
  ('ISO 15189',5,'Laboratory Quality'),('ISO 27001',6,'Information Security'),('ISO 45001',5,'Occupational Safety'),
  ('ISO 13485',4,'Medical Devices'),('ISO 14001',3,'Environmental Management'),('ISO 50001',0,'Energy Management')) AS t(standard, full_penalty, category)
-- cte: o_std_cert uses: o_cert
SELECT seq, pos, st, concat('ISO ', regexp_extract(up, 'ISO ?(9001|14001|45001|27001|13485|50001|15189)', 1)) AS standard
FROM o_cert WHERE regexp_matches(up, 'ISO ?(9001|14001|45001|27001|13485|50001|15189)')
UNION ALL SELECT seq, pos, st, 'CAP' FROM o_cert WHERE up LIKE '%CAP%' OR up LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%'
UNION ALL SELECT seq, pos, st, 'JCI' FROM o_cert WHERE up LIKE '%JCI%' OR up LIKE '%JOINT COMMISSION INTERNATIONAL%' OR (up LIKE '%JOINT COMMISSION%' AND up NOT LIKE '%INTERNATIONAL%')
-- cte: o_compliance uses: fx_orgs o_std o_std_cert o_cert
SELECT o.seq, s.standard, s.category, coalesce(l.st, '') IN ('Active','Valid','Current') AS ok,
  CASE WHEN s.standard = 'ISO 15189' AND coalesce(u.cap, 0) > 0 THEN 0
       WHEN s.standard IN ('ISO 9001','ISO 15189','ISO 27001','ISO 45001','ISO 13485','ISO 14001') AND coalesce(u.cap, 0) + coalesce(u.us, 0) > 0
         THEN greatest(1, CAST(floor(s.full_penalty * 0.5) AS INT))
       ELSE s.full_penalty END AS penalty
FROM fx_orgs o CROSS JOIN o_std s
LEFT JOIN (SELECT seq, standard, arg_max(st, pos * 2 + CASE WHEN st IN ('Active','Valid','Current') THEN 1 ELSE 0 END) AS st FROM o_std_cert GROUP BY 1, 2) l ON l.seq = o.seq AND l.standard = s.standard
LEFT JOIN (SELECT seq, count(*) FILTER (up LIKE '%CAP%' OR up LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%') AS cap,
             count(*) FILTER (up LIKE '%JOINT COMMISSION%' AND up NOT LIKE '%INTERNATIONAL%') AS us FROM o_cert GROUP BY seq) u ON u.seq = o.seq
-- cte: o_org_compliance uses: o_compliance
SELECT seq, count(*) FILTER (ok) AS compliant_count, count(*) FILTER (ok) * 100.0 / 9 AS compliance_pct,
  coalesce(sum(penalty) FILTER (NOT ok), 0) AS total_penalty, max(CASE WHEN standard = 'CAP' AND ok THEN 1 ELSE 0 END) AS cap_compliant
FROM o_compliance GROUP BY seq
-- cte: o_init_score uses: fx_initiatives
SELECT seq, n, least(pts + CASE WHEN n > 1 THEN least(n * 0.8, 8) ELSE 0 END, 35) AS initiative_score
FROM (SELECT seq, count(*) AS n, sum(impact_score * CASE category WHEN 'Patient Safety' THEN 1.2 WHEN 'Quality Improvement' THEN 1.1
   WHEN 'Clinical Excellence' THEN 1.0 WHEN 'Technology Innovation' THEN 0.9 WHEN 'Staff Development' THEN 0.8
   WHEN 'Community Health' THEN 0.7 WHEN 'Research' THEN 0.6 ELSE 0.5 END
   * CASE status WHEN 'Active' THEN 1.0 WHEN 'In Progress' THEN 0.8 ELSE 0.5 END) AS pts FROM fx_initiatives GROUP BY seq)
-- cte: o_prior uses: fx_history
SELECT seq, total_score AS prior_score FROM (SELECT seq, total_score, row_number() OVER (PARTITION BY seq ORDER BY ts DESC, entry_id DESC) AS rn FROM fx_history) WHERE rn = 1
-- cte: o_scored0 uses: fx_orgs o_cert_score o_org_compliance o_init_score o_prior
SELECT o.seq, o.name, o.country, o.region, o.hospital_type, c.certification_score, c.recognised,
  coalesce(i.initiative_score, 0) AS initiative_score,
  CASE WHEN coalesce(p.prior_score, 0) >= 70 THEN floor(m.total_penalty * 0.4) ELSE m.total_penalty END AS applied_penalty,
  greatest(0, c.certification_score + coalesce(i.initiative_score, 0)
    - CASE WHEN coalesce(p.prior_score, 0) >= 70 THEN floor(m.total_penalty * 0.4) ELSE m.total_penalty END) AS raw
FROM fx_orgs o JOIN o_cert_score c USING (seq) JOIN o_org_compliance m USING (seq)
LEFT JOIN o_init_score i USING (seq) LEFT JOIN o_prior p USING (seq)
-- cte: o_active uses: o_cert
SELECT seq, count(*) AS active_certs FROM o_cert WHERE st = 'Active' GROUP BY seq
-- cte: o_scored uses: o_scored0 o_active
SELECT s.*, CASE WHEN recognised > 0 AND raw < 12 THEN 12 - raw ELSE 0 END AS baseline_adjustment,
  CAST(CASE WHEN recognised > 0 AND raw < 12 THEN 12 ELSE raw END AS DOUBLE) AS total_score, coalesce(a.active_certs, 0) AS active_certs
FROM o_scored0 s LEFT JOIN o_active a USING (seq)
-- cte: o_ranked uses: o_scored
SELECT *, row_number() OVER (ORDER BY total_score DESC, active_certs DESC, lower(name), seq) AS overall_rank, count(*) OVER () AS n_orgs FROM o_scored
-- query: status_words uses: o_cert
SELECT seq, pos, st AS clean_status FROM o_cert
-- query: cert_type uses: o_cert
SELECT name, kind AS cert_type, count(*) AS n FROM o_cert GROUP BY 1, 2
-- query: cert_tier_type uses: o_cert
SELECT name, split_part(t, '|', 1) AS tier, split_part(t, '|', 2) AS cert_type, count(*) AS n FROM (
  SELECT name, CASE WHEN up LIKE '%JCI%' OR up LIKE '%JOINT COMMISSION INTERNATIONAL%' THEN 'GLOBAL_GOLD|JCI'
    WHEN up LIKE '%MAGNET%' THEN 'GLOBAL_GOLD|MAGNET'
    WHEN regexp_matches(up, 'ISO ?(9001|13485|15189|27001|45001|14001|50001)') THEN concat('ISO_STANDARDS|ISO_', regexp_extract(up, 'ISO ?(9001|13485|15189|27001|45001|14001|50001)', 1))
    WHEN up LIKE '%JOINT COMMISSION%' THEN 'REGIONAL_EXCELLENCE|JOINT_COMMISSION'
    WHEN up LIKE '%HAS%' THEN 'REGIONAL_EXCELLENCE|HAS'
    WHEN up LIKE '%NABH%' THEN 'NATIONAL_REGIONAL|NABH' WHEN up LIKE '%NABL%' THEN 'NATIONAL_REGIONAL|NABL'
    WHEN up LIKE '%CAP%' OR up LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%' THEN 'NATIONAL_REGIONAL|CAP'
    WHEN up LIKE '%STATE%' THEN 'NATIONAL_REGIONAL|STATE_REGIONAL' ELSE 'SPECIALTY|LOCAL' END AS t FROM o_cert) GROUP BY 1, 2, 3
-- cte: o_intl uses: o_cert
SELECT seq, name, up, st, score_impact, CASE WHEN up LIKE '%JCI%' OR up LIKE '%JOINT COMMISSION INTERNATIONAL%' THEN 'JCI'
    WHEN regexp_matches(up, 'ISO ?(9001|13485|15189|27001|45001|14001)') THEN concat('ISO_', regexp_extract(up, 'ISO ?(9001|13485|15189|27001|45001|14001)', 1))
    WHEN up LIKE '%JOINT COMMISSION%' THEN 'JOINT_COMMISSION_US' WHEN up LIKE '%MAGNET%' THEN 'MAGNET_RECOGNITION'
    WHEN up LIKE '%HAS%' THEN 'HAS_FRANCE' WHEN up LIKE '%NABH%' THEN 'NABH_INDIA' WHEN up LIKE '%NABL%' THEN 'NABL'
    WHEN up LIKE '%CAP%' OR up LIKE '%COLLEGE OF AMERICAN PATHOLOGISTS%' THEN 'CAP' END AS kind FROM o_cert
-- query: cert_intl_type uses: o_intl
SELECT name, kind AS cert_type, count(*) AS n FROM o_intl GROUP BY 1, 2
-- query: implied_lab_cert uses: o_cert o_cert_all
SELECT a.seq, CASE WHEN a.n > b.n THEN 1 ELSE 0 END AS implied_lab, a.scored AS certs_with_implied
FROM (SELECT seq, count(*) AS n, count(*) FILTER (st IN ('Active', 'In Progress')) AS scored FROM o_cert_all GROUP BY seq) a
JOIN (SELECT seq, count(*) AS n FROM o_cert GROUP BY seq) b USING (seq)
-- query: cert_score uses: o_cert_score
SELECT seq, scored_certs, round(CAST(diversity_bonus AS DOUBLE), 6) AS diversity_bonus, round(CAST(international_bonus AS DOUBLE), 6) AS international_bonus,
  round(CAST(certification_score AS DOUBLE), 6) AS certification_score FROM o_cert_score
-- query: cert_breakdown uses: o_cert_points
SELECT seq, kind AS cert_type, count(*) AS n, round(CAST(sum(pts) AS DOUBLE), 6) AS total_points, round(CAST(max(weight) AS DOUBLE), 6) AS weight FROM o_cert_points GROUP BY 1, 2
-- query: compliance uses: o_org_compliance
SELECT seq, compliant_count, round(CAST(compliance_pct AS DOUBLE), 6) AS compliance_pct, CAST(total_penalty AS BIGINT) AS total_penalty, cap_compliant FROM o_org_compliance
-- query: penalty_by_category uses: o_compliance
SELECT seq, category, CAST(sum(penalty) AS BIGINT) AS penalty FROM o_compliance WHERE NOT ok AND penalty > 0 GROUP BY 1, 2
-- query: missing_standards uses: o_compliance
SELECT standard, count(*) AS n_orgs, CAST(sum(penalty) AS BIGINT) AS penalty_points FROM o_compliance WHERE NOT ok AND penalty > 0 GROUP BY 1
-- query: older_penalty_score uses: o_cert_score o_org_compliance
SELECT seq, round(CAST(p AS DOUBLE), 6) AS noncompliance_penalty,
  round(CAST(greatest(0, CASE WHEN p > 0 THEN least(greatest(0, x - p), 70, 70 - 0.5 * p) ELSE least(greatest(0, x), 70) END) AS DOUBLE), 6) AS older_score
FROM (SELECT c.seq, CAST(points + diversity_bonus + international_bonus AS DOUBLE) AS x, (9 - m.compliant_count) / 9.0 * 30 AS p FROM o_cert_score c JOIN o_org_compliance m USING (seq))
-- query: initiative_score uses: o_init_score
SELECT seq, n AS initiative_count, round(CAST(initiative_score AS DOUBLE), 6) AS initiative_score FROM o_init_score
-- query: initiative_score_intl uses: fx_initiatives
SELECT seq, round(CAST(least(pts + CASE WHEN n > 3 THEN least((n - 3) * 1.5, 8) ELSE 0 END, 25) AS DOUBLE), 6) AS initiative_score FROM (
  SELECT seq, count(*) AS n, sum(3.0 * CASE category WHEN 'Patient Safety' THEN 1.0 WHEN 'Clinical Excellence' THEN 0.95 WHEN 'Quality Improvement' THEN 0.9
    WHEN 'Technology Innovation' THEN 0.8 WHEN 'Community Health' THEN 0.65 WHEN 'Staff Development' THEN 0.6 ELSE 0.5 END
    * CASE pos % 4 WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END * CASE WHEN status = 'Active' THEN 1.0 ELSE 0.7 END) AS pts
  FROM fx_initiatives GROUP BY seq)
-- query: total_score uses: o_scored
SELECT seq, round(CAST(certification_score AS DOUBLE), 6) AS certification_score, round(CAST(initiative_score AS DOUBLE), 6) AS initiative_score,
  round(CAST(applied_penalty AS DOUBLE), 6) AS applied_penalty, round(CAST(baseline_adjustment AS DOUBLE), 6) AS baseline_adjustment,
  round(total_score, 6) AS total_score FROM o_scored
-- query: score_top_ten uses: o_ranked
SELECT overall_rank, name, country, round(total_score, 6) AS total_score, round((n_orgs - overall_rank + 1) * 100.0 / n_orgs, 6)::DOUBLE AS percentile FROM o_ranked WHERE overall_rank <= 10
-- cte: o_intl_w
SELECT * FROM (VALUES ('JCI',4.0,35,1),('ISO_9001',3.2,25,2),('ISO_13485',3.2,25,2),('ISO_15189',3.0,22,2),('ISO_27001',2.8,20,2),
 ('ISO_45001',2.6,18,2),('ISO_14001',2.4,16,2),('JOINT_COMMISSION_US',3.5,30,3),('MAGNET_RECOGNITION',3.6,28,3),('HAS_FRANCE',3.0,25,3),
 ('NABH_INDIA',2.5,20,4),('CAP',3.0,22,2),('NABL',3.0,22,2)) AS t(kind, weight, base, tier)
-- cte: o_intl_score uses: fx_orgs o_intl o_intl_w
SELECT o.seq, o.country, coalesce(n, 0) AS counted, coalesce(g, 0) AS global_standards, coalesce(r, 0) AS regional_excellence, coalesce(s, 0) AS specialty_certs,
  CASE WHEN coalesce(hosp, 0) > 0 THEN 0 ELSE 20 END + CASE WHEN coalesce(q, 0) > 0 THEN 0 WHEN coalesce(us, 0) > 0 THEN 6 ELSE 12 END
   + CASE WHEN coalesce(lab, 0) > 0 THEN 0 ELSE 8 END AS pen,
  all_certs, coalesce(pts, 0) + CASE WHEN n > 1 THEN least(n * 2, 15) ELSE 0 END + least(coalesce(g, 0) * 5, 20) AS gross
FROM fx_orgs o LEFT JOIN (
  SELECT c.seq, count(*) AS all_certs, count(w.kind) FILTER (c.st = 'Active') AS n,
    sum(coalesce(c.score_impact, w.base) * w.weight) FILTER (c.st = 'Active') AS pts,
    count(*) FILTER (c.st = 'Active' AND w.tier = 1) AS g, count(*) FILTER (c.st = 'Active' AND w.tier IN (2, 3)) AS r,
    count(*) FILTER (c.st = 'Active' AND w.tier IN (4, 5)) AS s, count(*) FILTER (c.st = 'Active' AND c.kind = 'JOINT_COMMISSION_US') AS us,
    count(*) FILTER (c.st = 'Active' AND c.kind IN ('JCI', 'JOINT_COMMISSION_US', 'HAS_FRANCE')) AS hosp,
    count(*) FILTER (c.st = 'Active' AND c.kind = 'ISO_9001') AS q, count(*) FILTER (c.st = 'Active' AND c.kind IN ('ISO_15189', 'CAP', 'NABL')) AS lab
  FROM o_intl c LEFT JOIN o_intl_w w ON c.kind = w.kind GROUP BY c.seq) f USING (seq)
-- query: intl_cert_score uses: o_intl_score
SELECT seq, counted, global_standards, regional_excellence, specialty_certs, CAST(pen AS DOUBLE) AS intl_penalty,
  round(CAST(CASE WHEN all_certs IS NULL THEN 0 ELSE least(gross - pen, 60) END AS DOUBLE), 6) AS intl_cert_score FROM o_intl_score
-- cte: o_metric uses: fx_history
SELECT seq, ip * 0.1 AS innovation_part, least(c * 0.3 + p * 0.25 + o * 0.25 + ip * 0.1 + 40 * 0.1, 40) AS metric_score FROM (
 SELECT seq, least(max(total_score), 100) AS c, least(min(total_score), 100) AS p,
  least(CASE WHEN count(*) % 2 = 0 THEN max(total_score) - min(total_score) ELSE 50 END, 100) AS o,
  least(CASE WHEN count(*) % 3 = 0 THEN sum(total_score) ELSE 30 END, 100) AS ip FROM fx_history GROUP BY seq)
-- query: metric_score uses: o_metric
SELECT seq, round(CAST(innovation_part AS DOUBLE), 6) AS innovation_part, round(CAST(metric_score AS DOUBLE), 6) AS metric_score FROM o_metric
-- cte: o_intl_ctx uses: o_intl_score
SELECT seq, CASE WHEN country IN ('UNITED STATES','USA','CANADA','UNITED KINGDOM','UK','GERMANY','FRANCE','JAPAN','AUSTRALIA','NEW ZEALAND','SINGAPORE','SWEDEN','NORWAY','DENMARK','NETHERLANDS','SWITZERLAND') THEN 'developed' ELSE 'developing' END AS region_type,
  CASE WHEN country IN ('UNITED STATES','USA','CANADA') THEN 'North America' WHEN country IN ('UNITED KINGDOM','UK','GERMANY','FRANCE') THEN 'Europe'
   WHEN country IN ('JAPAN','INDIA') THEN 'Asia-Pacific' WHEN country IN ('SAUDI ARABIA') THEN 'Middle East' ELSE 'Global' END AS broad_region,
  CASE WHEN all_certs IS NULL THEN 0 ELSE least(gross - pen, 60) END AS cs FROM o_intl_score
-- query: intl_total_score uses: o_intl_ctx o_metric
SELECT c.seq, region_type, round(CAST(cs * 0.6 + coalesce(metric_score, 0) * 0.4 AS DOUBLE), 6) AS intl_total,
  round(CAST(cs * 0.6 + coalesce(metric_score, 0) * 0.4 + CASE WHEN region_type = 'developed' THEN 0.2 * coalesce(innovation_part, 0) ELSE 2 END AS DOUBLE), 6) AS adjusted_total
FROM o_intl_ctx c LEFT JOIN o_metric m USING (seq)
-- query: intl_org_context uses: o_intl_ctx
SELECT region_type, broad_region, count(*) AS n, round(CAST(avg(cs * 0.6 + CASE WHEN region_type = 'developing' THEN 2 ELSE 0 END) AS DOUBLE), 6) AS mean_total FROM o_intl_ctx GROUP BY 1, 2
-- query: location_adjustment uses: fx_orgs
SELECT seq, CAST(CASE WHEN seq % 7 = 0 THEN 0 ELSE least(8, CASE seq % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END
  + CASE WHEN seq % 5 = 0 THEN 1 WHEN city = '' THEN 0 ELSE CASE seq % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END END
  + CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END WHEN seq % 3 = 1 THEN CASE WHEN seq % 4 = 1 THEN 1 ELSE 0 END ELSE 2 END) END AS BIGINT) AS location_adjustment
FROM fx_orgs
-- query: reputation_bonus uses: fx_orgs
SELECT seq, CAST(CASE seq % 6 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 0.5 WHEN 4 THEN 2 ELSE 0 END AS DOUBLE) AS reputation_bonus,
  CAST(CASE seq % 6 WHEN 0 THEN 1.10 WHEN 1 THEN 1.08 WHEN 2 THEN 1.08 WHEN 4 THEN 1.03 ELSE 1.0 END AS DOUBLE) AS reputation_multiplier FROM fx_orgs
-- query: missing_cert_penalty uses: fx_orgs o_cert
SELECT seq, CAST(CASE WHEN coalesce(h, 0) = 0 THEN 3 ELSE 0 END + 2 + CASE WHEN coalesce(l, 0) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(n, 0) < 3 THEN 2 ELSE 0 END AS BIGINT) AS missing_cert_penalty
FROM fx_orgs LEFT JOIN (SELECT seq, count(*) AS n, count(*) FILTER (split_part(name, ' ', 1) = 'NABH') AS h, count(*) FILTER (split_part(name, ' ', 1) = 'NABL') AS l
  FROM o_cert WHERE st = 'Active' GROUP BY seq) USING (seq)
-- query: regional_adaptation uses: fx_orgs o_cert
SELECT seq, CAST(least(5, (lower(name) LIKE '%rural%')::INT + (lower(name) LIKE '%district%')::INT + (lower(name) LIKE '%community%')::INT + (lower(name) LIKE '%regional%')::INT
   + least(coalesce(r, 0), 3)) AS BIGINT) AS adaptation_bonus,
 CAST(least(10, 2 * ((lower(name) LIKE '%global health%')::INT + (lower(name) LIKE '%international hospital%')::INT)) AS BIGINT) AS world_score
FROM fx_orgs LEFT JOIN (SELECT seq, count(*) FILTER (regexp_matches(lower(name), 'state|provincial|national|federal')) AS r FROM o_cert GROUP BY seq) USING (seq)
-- query: grade_bands uses: fx_orgs
SELECT CASE WHEN s >= 75 THEN 'A+' WHEN s >= 65 THEN 'A' WHEN s >= 55 THEN 'B+' WHEN s >= 45 THEN 'B' ELSE 'C' END AS grade,
  CASE WHEN s >= 80 THEN 'Exceptional (80-100)' WHEN s >= 70 THEN 'Very Good (70-79)' WHEN s >= 60 THEN 'Good (60-69)' WHEN s >= 50 THEN 'Fair (50-59)'
   WHEN s >= 40 THEN 'Poor (40-49)' ELSE 'Scope for Improvement (0-39)' END AS level, count(*) AS n
FROM (SELECT prior_score_src / 100.0 AS s FROM fx_orgs) GROUP BY 1, 2
-- cte: o_half uses: fx_reviews
SELECT seq, n_reviews, recent_sentiment, older_sentiment, CASE WHEN n_reviews < 4 THEN 'stable' WHEN recent_sentiment - older_sentiment > 0.1 THEN 'improving'
  WHEN recent_sentiment - older_sentiment < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM (
  SELECT seq, count(*) AS n_reviews, CAST(sum(CAST(sentiment AS DECIMAL(28,12))) FILTER (i > n // 2) AS DOUBLE) / nullif(count(sentiment) FILTER (i > n // 2), 0) AS recent_sentiment, CAST(sum(CAST(sentiment AS DECIMAL(28,12))) FILTER (i <= n // 2) AS DOUBLE) / nullif(count(sentiment) FILTER (i <= n // 2), 0) AS older_sentiment
  FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY seq) AS n FROM fx_reviews) GROUP BY seq)
-- query: review_trend uses: o_half
SELECT seq, n_reviews, round(recent_sentiment, 6) AS recent_sentiment, round(older_sentiment, 6) AS older_sentiment, trend FROM o_half
-- cte: o_review uses: fx_orgs fx_reviews o_half
SELECT o.seq, coalesce(r.n, 0) AS n_reviews, coalesce(r.avg_rating, 0) AS avg_rating, coalesce(r.sentiment, 0) AS sentiment, coalesce(r.n_recent, 0) AS n_recent,
  coalesce(p.platforms, '') AS platforms, coalesce(h.trend, 'stable') AS trend, coalesce(r.np, 0) AS np,
  CASE WHEN r.n > 0 THEN least(1, least(r.n / 50.0, 1) * 0.4 + CAST(r.n_recent AS DOUBLE) / r.n * 0.4 + least(r.np / 3.0, 1) * 0.2) ELSE 0 END AS confidence
FROM fx_orgs o LEFT JOIN (SELECT seq, count(*) AS n, CAST(sum(CAST(rating AS DECIMAL(28,12))) AS DOUBLE) / nullif(count(rating), 0) AS avg_rating, CAST(sum(CAST(sentiment AS DECIMAL(28,12))) AS DOUBLE) / nullif(count(sentiment), 0) AS sentiment, count(DISTINCT platform) AS np,
   count(*) FILTER (TIMESTAMP '2024-03-31 00:00:00' - ts < INTERVAL 91 DAY) AS n_recent FROM fx_reviews GROUP BY seq) r USING (seq)
 LEFT JOIN (SELECT seq, string_agg(concat(platform, '=', n), ';' ORDER BY platform) AS platforms FROM (SELECT seq, platform, count(*) AS n FROM fx_reviews GROUP BY 1, 2) GROUP BY seq) p USING (seq)
 LEFT JOIN o_half h USING (seq)
-- query: review_summary uses: o_review
SELECT seq, n_reviews, round(avg_rating, 6) AS avg_rating, round(sentiment, 6) AS sentiment, platforms, trend,
  CAST(CASE trend WHEN 'improving' THEN 0.1 WHEN 'declining' THEN -0.1 ELSE 0 END AS DOUBLE) AS trend_shift FROM o_review
-- query: review_confidence uses: o_review
SELECT seq, n_recent, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM o_review
-- query: review_score uses: o_review
SELECT seq, round(CAST(CASE WHEN n_reviews = 0 THEN 0 ELSE least(15, confidence * (CASE WHEN n_reviews >= 100 THEN 4 WHEN n_reviews >= 50 THEN 3 WHEN n_reviews >= 20 THEN 2 WHEN n_reviews >= 10 THEN 1 ELSE 0.5 END
  + greatest(0, (sentiment + 1) * 2.5) + CASE WHEN avg_rating > 0 THEN avg_rating / 5 * 4 ELSE greatest(0, (sentiment + 1) * 2.5) * 0.8 END
  + CASE trend WHEN 'improving' THEN 2 WHEN 'declining' THEN 0 ELSE 1 END)) END AS DOUBLE), 6) AS review_score FROM o_review
