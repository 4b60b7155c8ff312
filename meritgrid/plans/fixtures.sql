-- Domain views over the given tables; the same text runs in Spark and in the SQL checks.

-- cte: fx_orgs
WITH base AS (
  SELECT c_custkey AS n, c_custkey AS seq, 'customer' AS data_source, c_nationkey AS nk, c_mktsegment AS seg, c_acctbal AS bal FROM customer
  UNION ALL
  SELECT s_suppkey, 1000000000 + s_suppkey, 'supplier', s_nationkey, 'SUPPLIER', s_acctbal FROM supplier),
w AS (SELECT *, CAST(floor(n/25) AS BIGINT) AS n25, CAST(floor(n/300) AS BIGINT) AS n300, CAST(floor(n/600) AS BIGINT) AS n600 FROM base)
SELECT seq, data_source,
  concat(split_part('Cardiac|Cancer|Eye|Dental|Women|Neuro|General|District|Rural|Metro|Lotus|Silver|Royal|Unity|Global|National|Harbor|Valley|Summit|River|Ortho|Kidney|Child|Apex|Sunrise','|',CAST(n%25+1 AS INT)),
    ' ', split_part('Hospital|Clinic|Laboratory|Medical Center|Institute|Diagnostics|Health System|Hospital Group|Nursing Home|Pathology Labs|Healthcare|Care Network','|',CAST(n25%12+1 AS INT)),
    CASE WHEN n600 > 0 THEN concat(' ', CAST(n600 AS STRING)) ELSE '' END,
    CASE (n+n300)%6 WHEN 1 THEN concat(', ', n_name) WHEN 2 THEN concat(' (Unit ', CAST(n%3 AS STRING), ')') WHEN 3 THEN ' Pvt Ltd' WHEN 4 THEN ' PRIVATE LIMITED' ELSE '' END) AS name,
  CASE WHEN n%9=0 THEN '' ELSE concat('City ', CAST(n%40 AS STRING)) END AS city,
  CASE WHEN n%11=0 THEN 'Unknown' ELSE concat('State ', CAST(n%12 AS STRING)) END AS state,
  n_name AS country, r_name AS region,
  CASE seg WHEN 'BUILDING' THEN 'General Hospital' WHEN 'MACHINERY' THEN 'Medical Laboratory' WHEN 'SUPPLIER' THEN 'Clinic' ELSE 'Hospital' END AS hospital_type,
  CASE WHEN n%4=0 THEN NULL ELSE concat('https://www.org', CAST(n AS STRING), '.example.org/') END AS website,
  CASE WHEN n%5=0 THEN '' ELSE concat('555-010-', lpad(CAST(n%10000 AS STRING),4,'0')) END AS phone, bal AS prior_score_src
FROM w JOIN nation ON nk=n_nationkey JOIN region ON n_regionkey=r_regionkey

-- cte: fx_certs
SELECT o_custkey AS seq, l_orderkey*8 + l_linenumber AS pos,
  split_part('Joint Commission International (JCI)|ISO 9001:2015|ISO 15189|CAP Accreditation|NABH Full Accreditation|NABL Testing|Magnet Recognition|ISO13485|ISO 27001|ISO 45001:2018|ISO-14001|State License|Joint Commission|Local Permit|ISO 50001|College of American Pathologists','|',CAST((l_partkey+l_suppkey)%16+1 AS INT)) AS name,
  CASE WHEN l_partkey%13=0 THEN '' WHEN l_partkey%11=0 THEN 'Pending' WHEN l_returnflag='A' THEN 'Active' WHEN l_returnflag='N' THEN 'Accredited' ELSE 'Expired' END AS status,
  CASE l_suppkey%4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(floor(l_quantity/2) AS INT) END AS score_impact,
  CASE l_partkey%3 WHEN 0 THEN concat(CAST(year(l_shipdate) AS STRING),'-',lpad(CAST(month(l_shipdate) AS STRING),2,'0'),'-',lpad(CAST(day(l_shipdate) AS STRING),2,'0'))
    WHEN 1 THEN concat(lpad(CAST(day(l_shipdate) AS STRING),2,'0'),' ',split_part('Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec','|',CAST(month(l_shipdate) AS INT)),' ',CAST(year(l_shipdate) AS STRING)) ELSE 'N/A' END AS accreditation_date,
  l_shipdate + INTERVAL 1095 DAY AS expiry_ts
FROM lineitem JOIN orders ON l_orderkey=o_orderkey

-- cte: fx_initiatives
SELECT o_custkey AS seq, o_orderkey AS pos, split_part('Patient Safety|Quality Improvement|Clinical Excellence|Technology Innovation|Staff Development|Community Health|Research|Unlisted','|',CAST(o_orderkey%8+1 AS INT)) AS category,
 CAST(floor(o_totalprice) AS BIGINT)%10 AS impact_score, CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'In Progress' ELSE 'Closed' END AS status
FROM orders

-- cte: fx_reviews
SELECT user_id AS seq, event_id, event_type AS platform, CASE WHEN event_id%5=0 THEN NULL ELSE CAST(1+event_id%5 AS DOUBLE) END AS rating,
 greatest(-1.0, least(1.0, CAST(value/50 - 0.5 AS DOUBLE))) AS sentiment, ts FROM events

-- cte: fx_history
SELECT o_custkey AS seq, o_orderkey AS entry_id, o_orderdate AS ts, CAST(floor(o_totalprice) AS BIGINT)%101 AS total_score FROM orders

-- cte: fx_monthly
SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority AS cert_type, count(*) AS cnt FROM orders GROUP BY 1,2,3

-- cte: fx_registry uses: fx_orgs
SELECT seq, name, city, country, seq%3=0 AS verification_required FROM fx_orgs WHERE data_source='supplier'

-- cte: fx_asked uses: fx_orgs
SELECT seq AS query_no, CASE CAST(floor(seq/50) AS BIGINT)%4 WHEN 0 THEN name WHEN 1 THEN concat(substr(name,1,1),substr(name,3)) WHEN 2 THEN concat(name,' branch') ELSE concat(country,' ',substr(name,1,8)) END AS query FROM fx_orgs WHERE seq%50=0

-- cte: fx_typed uses: fx_orgs
SELECT seq AS query_no, CASE CAST(floor(seq/50) AS BIGINT)%3 WHEN 0 THEN substr(name,1,4) WHEN 1 THEN substr(name,3,5) ELSE concat(substr(name,1,2),' ') END AS query FROM fx_orgs WHERE seq%50=0
