"""The named queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.llm import (
    bpe,
    chat,
    curriculum,
    exact,
    langid,
    merkle,
    middle,
    near,
    packing,
    passages,
    pii,
    quality,
    shard,
)

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(_documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(_documents(spark, sf_dir))


CONTROL = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.select("conv_id", "turn", "role", "text")
    turns = F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"))
            for i, role in enumerate(["user", "assistant"])
        ]
    )
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(turns))
    added = added.withColumn("text", F.lit(CONTROL))
    formatted = chat.format_trees(chat.conversation_nodes(rows.unionByName(added)))
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    listed = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_documents(spark, sf_dir)).select(
        "doc_id", "class_id", "class_size", "n_links"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), vocabulary_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.histogram_shards(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    fields = [F.col(f) for f in merkle.FIELDS]
    changed = [*fields[:3], fields[3] + 1, fields[4]]
    tampered = F.when(number % 7 == 0, merkle.leaf_digest(changed))
    return merkle.manifest(_documents(spark, sf_dir), claimed=tampered)


def op12_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix_sources(_documents(spark, sf_dir))
    used = curriculum.training_order(mixed).groupBy("row_id").agg(
        F.sum("words").alias("taken"), F.count("*").alias("copies"), F.min("place").alias("first_place")
    )
    zero = F.lit(0).cast("long")
    return mixed.join(used, "row_id", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", zero).alias("taken"),
        F.coalesce("copies", zero).alias("copies"),
        "first_place",
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(_documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_suffix_dedup,
        op3_chat_format,
        op4_jaccard_join,
        op5_quality_rules,
        op6_pii,
        op7_bpe,
        op8_sharding,
        op9_packing,
        op10_language_id,
        op11_merkle_manifest,
        op12_curriculum_mix,
        op13_fill_middle,
    )
}

_LOWERED = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)



def _due_sql() -> str:
    """The inverse demand of every weight as SQL: ``share`` of a source with weight ``w``."""
    cases = []
    for weight, schedule in zip(curriculum.WEIGHTS, curriculum.SCHEDULES):
        for begin, v, slope, before in reversed(curriculum.demand(schedule)):
            rest = f"(share - {before!r}e0)"
            root = f"sqrt({v * v!r}e0 + {2 * slope!r}e0 * {rest})"
            time = f"{begin!r}e0 + 2e0 * {rest} / ({v!r}e0 + {root})"
            cases.append(f"WHEN w = {weight} AND share >= {before!r}e0 THEN {time}")
    return f"CASE {' '.join(cases)} END"


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWERED} AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n
""",
    "op3_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h\h\h'), '</turn>', '\l/turn>') AS x
  FROM r
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
           ORDER BY turn, role, text), '') AS loss,
         CAST(sum(4 + length(role) + 2 + length(x) + 8) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars
FROM c
""",
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')),
           '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
       JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id
  HAVING 5 * count(*) >= 4 * (min(x.n) + min(y.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
z AS (SELECT class_id, count(*) AS class_size FROM c GROUP BY class_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.doc_id, c.class_id, z.class_size, coalesce(l.n_links, 0) AS n_links
FROM c JOIN z ON c.class_id = z.class_id LEFT JOIN l ON c.doc_id = l.doc_id
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce([ord(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')], lambda x, y:
    list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END,
                xor(x, CAST(y AS BIGINT))), CAST(4294967295 AS BIGINT)) AS crc
  FROM documents
), v AS (
  SELECT *, [CASE WHEN z IS NULL THEN '-' ELSE strlen(z) || ':' || z END FOR z IN
     [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS fs,
     CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS more
  FROM d
), l AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree,
         sha256(array_to_string(fs, '')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(fs[1] || fs[2] || fs[3] || more || fs[5])
              ELSE sha256(array_to_string(fs, '')) END AS claimed
  FROM v
), q AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS size, row_number() OVER () AS id
  FROM l
), nodes AS (
  SELECT tree, 0 AS h, place, size, leaf AS digest FROM q
  UNION ALL
  SELECT tree, h + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY tree, h, place // 2
), subroots AS (
  SELECT tree, h AS depth, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size
  FROM nodes WHERE size = 1
), tops AS (
  SELECT '' AS tree, 0 AS h, place, size, digest FROM subroots
  UNION ALL
  SELECT tree, h + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE size > 1 GROUP BY tree, h, place // 2
), high AS (SELECT max(h) AS h, arg_max(digest, h) AS root FROM tops),
walk AS (
  SELECT q.id, q.tree, 0 AS h, q.place, q.claimed AS now, '' AS proof, s.depth, s.place AS top
  FROM q JOIN subroots s USING (tree)
  UNION ALL
  SELECT w.id, w.tree, w.h + 1, CASE WHEN w.h + 1 = w.depth THEN w.top ELSE w.place // 2 END,
         sha256(CASE WHEN w.place % 2 = 1 THEN coalesce(n.digest, '') || w.now ELSE w.now || coalesce(n.digest, '') END),
         w.proof || coalesce(n.digest, ''), w.depth, w.top
  FROM walk w LEFT JOIN (SELECT tree, h, place, digest FROM nodes) n
    ON n.tree = w.tree AND n.h = w.h AND n.place = xor(w.place, 1)
  WHERE w.h < w.depth
), climb AS (
  SELECT id, 0 AS h, top AS place, now, proof FROM walk WHERE h = depth
  UNION ALL
  SELECT w.id, w.h + 1, w.place // 2,
         sha256(CASE WHEN w.place % 2 = 1 THEN coalesce(n.digest, '') || w.now ELSE w.now || coalesce(n.digest, '') END),
         w.proof || coalesce(n.digest, '')
  FROM climb w LEFT JOIN tops n ON n.h = w.h AND n.place = xor(w.place, 1)
  WHERE w.h < (SELECT h FROM high)
)
SELECT q.doc_id, q.leaf, s.digest AS subroot, high.root, sha256(c.proof) AS proof_sha256, c.now AS folded_root,
       c.now = high.root AS verified
FROM climb c JOIN q USING (id) JOIN subroots s USING (tree) CROSS JOIN high WHERE c.h = high.h
""",
    "op12_curriculum_mix": r"""
WITH RECURSIVE z AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '12', CAST(doc_id AS VARCHAR))) AS turn_key,
         row_number() OVER () AS id
  FROM documents
), s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS w FROM z GROUP BY k
), l(i, lam) AS (
  SELECT 0, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) / (SELECT sum(w) FROM s)
  UNION ALL
  SELECT i + 1, (SELECT CAST(sum(CASE WHEN 3 * source_size < l.lam * w THEN 0 ELSE source_size END)
                        + sum(CASE WHEN 3 * source_size < l.lam * w THEN -2 * source_size ELSE 0 END) AS DOUBLE)
                   / nullif(sum(CASE WHEN 3 * source_size < l.lam * w THEN 0 ELSE w END), 0) FROM s)
  FROM l WHERE i < 40 AND lam IS NOT NULL
), t AS (
  SELECT s.*, least(CAST(3 * source_size AS DOUBLE), m.lam * w) AS target
  FROM s CROSS JOIN (SELECT arg_max(lam, i) AS lam FROM l WHERE lam IS NOT NULL) m
), q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
p AS (
  SELECT z.*, q.source_size, q.target, q.quota, q.w,
         coalesce(sum(size) OVER (PARTITION BY z.k ORDER BY turn_key, size, id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM z JOIN q USING (k)
), u AS (
  SELECT p.*, e.epoch, before + epoch * source_size AS start,
         greatest(0, least(size, quota - before - epoch * source_size)) AS words
  FROM p CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e
), y AS (
  SELECT *, (start + words / CAST(2 AS DOUBLE)) / quota AS share FROM u WHERE words > 0
), o AS (SELECT *, {DUE} AS due FROM y),
r AS (SELECT *, row_number() OVER (ORDER BY due, k, epoch, turn_key, size, id) - 1 AS place FROM o),
g AS (SELECT id, CAST(sum(words) AS BIGINT) AS taken, count(*) AS copies, min(place) AS first_place FROM r GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(copies, 0) AS copies, first_place
FROM p LEFT JOIN g USING (id)
""".replace("{DUE}", _due_sql()),
    "op13_fill_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), u AS (
  SELECT *, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS ls,
         [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r
  FROM t
), c AS (
  SELECT *, len(ls) AS n, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>')
                OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE x END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
""",
}
