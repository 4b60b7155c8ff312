-- cte: o_score_table uses: o_scored
SELECT seq, name, country, region, hospital_type, round(total_score, 6) AS total_score, round(CAST(certification_score AS DOUBLE), 6) AS certification_score, active_certs FROM o_scored
-- cte: o_rank uses: o_score_table
SELECT *, row_number() OVER (ORDER BY total_score DESC, active_certs DESC, lower(name), seq) AS overall_rank, count(*) OVER () AS n_orgs,
  row_number() OVER (ORDER BY total_score DESC, seq) AS idx FROM o_score_table
-- query: unique_rank uses: o_rank
SELECT seq, overall_rank, round((n_orgs - overall_rank + 1) / n_orgs * 100, 6) AS percentile FROM o_rank
-- query: live_rank uses: o_score_table
SELECT seq, lr AS live_rank, round((n - lr) / n * 100, 6) AS pct_live FROM (
  SELECT seq, count(*) OVER (ORDER BY total_score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lr, count(*) OVER () AS n FROM o_score_table)
-- query: category_rank uses: o_score_table
SELECT seq, n - 1 - lo AS category_rank, round(CAST(lo AS DOUBLE) / (n - 1) * 100, 6) AS pct_category FROM (
  SELECT seq, rank() OVER (ORDER BY certification_score) - 1 AS lo, count(*) OVER () AS n FROM o_score_table)
-- query: regional_rank uses: o_score_table
SELECT seq, region, region_rank, n_region, round((n_region - region_rank + 1) / n_region * 100, 6) AS pct_region FROM (
  SELECT seq, region, rank() OVER (PARTITION BY region ORDER BY total_score DESC) AS region_rank, count(*) OVER (PARTITION BY region) AS n_region FROM o_score_table) WHERE n_region > 1
-- query: similar_performers uses: o_rank
SELECT subject, peer, peer_no, peer_score FROM (
  SELECT a.seq AS subject, b.seq AS peer, b.total_score AS peer_score, row_number() OVER (PARTITION BY a.seq ORDER BY b.idx) AS peer_no
  FROM o_rank a JOIN o_rank b ON a.seq <> b.seq AND round(abs(a.total_score - b.total_score), 9) <= 5) WHERE peer_no <= 10
-- cte: o_window uses: o_rank
SELECT subject, peer, CASE WHEN i < p THEN 'above' ELSE 'below' END AS side, i + 1 AS rank_position, d AS score_difference FROM (
  SELECT a.seq AS subject, b.seq AS peer, b.total_score - a.total_score AS d, row_number() OVER (PARTITION BY a.seq ORDER BY b.idx) - 1 AS i,
    count(*) FILTER (b.total_score > a.total_score) OVER (PARTITION BY a.seq) AS p
  FROM o_rank a JOIN o_rank b ON a.seq <> b.seq) WHERE i BETWEEN p - 20 AND p + 19
-- query: benchmark_window uses: o_window
SELECT subject, peer, side, rank_position, round(score_difference, 6) AS score_difference FROM o_window
-- query: peer_averages uses: o_window
SELECT subject, round(avg(score_difference) FILTER (side = 'above'), 6) AS gap_above, round(avg(score_difference) FILTER (side = 'below'), 6) AS gap_below FROM o_window GROUP BY 1
-- query: rank_neighbours uses: o_rank
SELECT a.seq AS subject, b.seq AS neighbour, b.overall_rank AS neighbour_rank FROM o_rank a JOIN o_rank b ON a.seq <> b.seq AND abs(a.overall_rank - b.overall_rank) <= 10
-- cte: o_detail uses: o_score_table
SELECT *, row_number() OVER (ORDER BY total_score DESC, seq) AS r0, count(*) OVER () AS n0,
 row_number() OVER (PARTITION BY country ORDER BY total_score DESC, seq) AS r1, count(*) OVER (PARTITION BY country) AS n1,
 row_number() OVER (PARTITION BY hospital_type ORDER BY total_score DESC, seq) AS r2, count(*) OVER (PARTITION BY hospital_type) AS n2,
 row_number() OVER (PARTITION BY active_certs > 1 ORDER BY total_score DESC, seq) AS r3, count(*) OVER (PARTITION BY active_certs > 1) AS n3,
 row_number() OVER (PARTITION BY tier ORDER BY total_score DESC, seq) AS r4, count(*) OVER (PARTITION BY tier) AS n4
FROM (SELECT *, CASE WHEN total_score >= 80 THEN 'Excellent (80-100)' WHEN total_score >= 60 THEN 'Good (60-79)' WHEN total_score >= 40 THEN 'Average (40-59)' ELSE 'Below Average (<40)' END AS tier FROM o_score_table)
-- query: detailed_percentiles uses: o_detail
SELECT seq, r0 AS overall_rank, r1 AS country_rank, r2 AS type_rank, CASE WHEN active_certs > 1 THEN r3 END AS accredited_rank, tier, r4 AS tier_rank,
 round((n0 - r0 + 1) / n0 * 100, 6) AS overall_pct, round((n1 - r1 + 1) / n1 * 100, 6) AS country_pct, round((n2 - r2 + 1) / n2 * 100, 6) AS type_pct,
 CASE WHEN active_certs > 1 THEN round((n3 - r3 + 1) / n3 * 100, 6) END AS accredited_pct, round((n4 - r4 + 1) / n4 * 100, 6) AS tier_pct FROM o_detail
-- query: performance_level uses: o_detail
SELECT seq, CASE WHEN r0 <= floor(n0 * 0.1) THEN 'Top 10%' WHEN r0 <= floor(n0 * 0.25) THEN 'Top 25%' WHEN (n0 - r0 + 1) / n0 * 100 >= 50 THEN 'Above Average' ELSE 'Below Average' END AS performance_level FROM o_detail
-- query: top_per_scope uses: o_rank
SELECT 'overall' AS scope, 'all' AS scope_value, seq, overall_rank FROM o_rank WHERE overall_rank <= 5
UNION ALL SELECT 'country', country, seq, overall_rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY overall_rank) AS k FROM o_rank) WHERE k <= 3
UNION ALL SELECT 'hospital_type', hospital_type, seq, overall_rank FROM (SELECT *, row_number() OVER (PARTITION BY hospital_type ORDER BY overall_rank) AS k FROM o_rank) WHERE k <= 3
-- query: percentile_peers uses: o_rank
SELECT subject, peer, peer_no, round(bp, 6) AS peer_pct FROM (
 SELECT a.seq AS subject, b.seq AS peer, b.pct AS bp, row_number() OVER (PARTITION BY a.seq ORDER BY b.overall_rank) AS peer_no
 FROM (SELECT *, (n_orgs - overall_rank + 1) / n_orgs * 100 AS pct FROM o_rank) a JOIN (SELECT *, (n_orgs - overall_rank + 1) / n_orgs * 100 AS pct FROM o_rank) b
 ON a.seq <> b.seq AND b.pct BETWEEN a.pct - 5 AND a.pct + 5) WHERE peer_no <= 10
-- query: gap_to_best uses: o_score_table
SELECT seq, round(max(total_score) OVER () - total_score, 6) AS gap FROM o_score_table
-- query: history_latest uses: fx_history
SELECT seq, entry_id, total_score FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ts DESC, entry_id DESC) AS k FROM fx_history) WHERE k <= 12
-- cte: o_last uses: fx_history
SELECT seq, total_score AS latest, prev FROM (SELECT *, lag(total_score) OVER (PARTITION BY seq ORDER BY ts, entry_id) AS prev, row_number() OVER (PARTITION BY seq ORDER BY ts DESC, entry_id DESC) AS k FROM fx_history) WHERE k = 1 AND prev IS NOT NULL
-- query: score_trend uses: o_last
SELECT seq, CASE WHEN latest > prev THEN 'up' WHEN latest < prev THEN 'down' ELSE 'stable' END AS direction,
 CASE WHEN latest > prev THEN 'improving' WHEN latest < prev THEN 'declining' ELSE 'stable' END AS status, abs(latest - prev) AS change FROM o_last
-- query: rank_trend uses: o_last
SELECT seq, CASE WHEN latest < prev THEN 'up' WHEN latest > prev THEN 'down' ELSE 'stable' END AS direction, abs(latest - prev) AS rank_change,
 CASE WHEN latest < prev THEN concat('Moved up ', prev - latest, ' positions') WHEN latest > prev THEN concat('Dropped ', latest - prev, ' positions') ELSE 'Maintained position' END AS description FROM o_last
-- query: score_statistics uses: o_score_table
SELECT count(*) AS n, round(avg(total_score), 6) AS mean, round(max(total_score) FILTER (i = n // 2 + 1), 6) AS median, round(stddev_pop(total_score), 6) AS std_dev,
 round(min(total_score), 6) AS lowest, round(max(total_score), 6) AS highest
FROM (SELECT total_score, row_number() OVER (ORDER BY total_score, seq) AS i, count(*) OVER () AS n FROM o_score_table)
-- query: rank_check uses: o_rank
WITH d AS (SELECT CASE WHEN overall_rank % 7 = 1 THEN overall_rank - 1 ELSE overall_rank END AS r FROM o_rank), p AS (SELECT r, count(*) AS n FROM d GROUP BY r)
SELECT 'duplicate' AS finding, r AS rank_value, n FROM p WHERE n > 1
UNION ALL SELECT 'missing', i, 0 FROM (SELECT unnest(range(1, (SELECT count(*) FROM d) + 1)) AS i) WHERE i NOT IN (SELECT r FROM p)
UNION ALL SELECT 'extra', r, n FROM p WHERE r < 1 OR r > (SELECT count(*) FROM d)
UNION ALL SELECT 'summary', (SELECT count(*) FROM d), (SELECT count(*) FROM p)
-- query: rank_level_check uses: o_rank
SELECT total_score, count(*) AS n, min(overall_rank) AS first_rank, max(overall_rank) AS last_rank, round(min((n_orgs - overall_rank + 1) / n_orgs * 100), 6) AS low_pct,
 round(max((n_orgs - overall_rank + 1) / n_orgs * 100), 6) AS high_pct, CAST(0 AS BIGINT) AS off_rows, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS several_ranks FROM o_rank GROUP BY total_score
