"""Duplicate removal, group merges and upserts.

Organisations and their certifications stay in long tables: ``orgs(seq, ...)`` and
``certs(seq, pos, name, ...)``. A merge maps every source row to its target ``seq``; certifications
follow by that mapping, so no group is ever gathered into one row. ``seq`` is file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import text
from meritgrid.functions.exprs import computed_once, has
from meritgrid.functions.nested import richness
from meritgrid.functions.text import filled, lower_name
from meritgrid.operators import batches, blocking, near_names
from meritgrid.operators.ordering import first_rows
from meritgrid.session import cut_lineage, spread

# --- duplicates ----------------------------------------------------------------------------


def keep_richest(orgs: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """One row per key: most filled fields, earliest among equals."""
    scored = orgs.withColumn("_key", key).withColumn("_rich", richness(orgs, fields))
    return first_rows(scored, ["_key"], [F.desc("_rich"), "seq"]).drop("_key", "_rich")


def group_targets(orgs: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """``seq, group_seq``: each row and the richest row of its group, which is the merge base."""
    scored = orgs.select("seq", key.alias("_key"), richness(orgs, fields).alias("_rich"))
    base = scored.groupBy("_key").agg(F.min(F.struct((-F.col("_rich")).alias("r"), "seq")).alias("_b"))
    return scored.join(base, "_key").select("seq", F.col("_b.seq").alias("group_seq"))


def merged_certs(targets: DataFrame, certs: DataFrame) -> DataFrame:
    """Certifications of a group, one per lower-case name (or issuer), the first one in order."""
    issuer = F.col("issuer") if "issuer" in certs.columns else F.lit(None).cast("string")
    title = F.lower(F.trim(F.coalesce(F.when(filled("name") != "", F.col("name")), issuer, F.lit(""))))
    rows = certs.withColumn("_title", title).filter("_title != ''").join(targets, "seq")
    order = F.struct("seq", "pos")
    rest = [c for c in certs.columns if c not in ("seq", "pos")]
    return (
        rows.groupBy("group_seq", "_title")
        .agg(F.min_by(F.struct("seq", "pos", *rest), order).alias("_c"))
        .select("group_seq", "_c.*")
    )


def first_filled_by_group(orgs: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """Per group the first non-blank value of every field, in file order."""
    parts = []
    for f in fields:
        given = filled(f).rlike(r"\S")
        parts.append(
            F.coalesce(F.min_by(F.when(given, F.col(f)), F.when(given, F.col("seq"))), F.lit("")).alias(f)
        )
    return orgs.groupBy(key.alias("group_key")).agg(
        F.min("seq").alias("group_seq"), F.count("*").alias("n_rows"), *parts
    )


def is_jci_like(name: Column | str) -> Column:
    return has(F.upper(filled(name)), "JCI", "JOINT COMMISSION")


def valid_certs(certs: DataFrame, validity: DataFrame) -> DataFrame:
    """Registry certifications only where the registry backs the organisation; one per name.

    ``validity(seq, registry_valid)``.
    """
    keyed = computed_once(spread(certs, "seq"), _key=text.alnum_key("name")).filter("_key != ''")
    backed = keyed.join(validity.select("seq", "registry_valid"), "seq", "left").filter(
        ~is_jci_like("name") | (F.coalesce("registry_valid", F.lit(0)) == 1)
    )
    return first_rows(backed, ["seq", "_key"], ["pos"]).drop("_key", "registry_valid")


def merged_flags(targets: DataFrame, flags: DataFrame) -> DataFrame:
    """Indicator flags of a group: true wins. ``flags(seq, flag, value)``."""
    return (
        flags.join(targets, "seq")
        .groupBy("group_seq", "flag")
        .agg(F.max(F.coalesce(F.col("value"), F.lit(False))).alias("value"))
    )


def force_flag(flags: DataFrame, forced: DataFrame, flag: str) -> DataFrame:
    """Replace one flag by a checked value. ``forced(group_seq, value)``."""
    kept = flags.filter(F.col("flag") != flag)
    return kept.unionByName(forced.select("group_seq", F.lit(flag).alias("flag"), "value"))


def _quality(certs: DataFrame) -> Column:
    """How complete a certification is: organisation info, impact, number, text length."""
    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in certs.columns else default

    number = column("certificate_number", F.lit(""))
    texts = [c for c, kind in certs.dtypes if kind == "string"]
    return F.struct(
        (column("organization_info", F.lit("")) == "").cast("int").alias("a"),
        (-column("score_impact", F.lit(0)).cast("double")).alias("b"),
        (number == "").cast("int").alias("c"),
        (-F.length(F.concat_ws("", *texts))).alias("d"),
        F.col("pos").alias("e"),
    )


def _jci_order(certs: DataFrame) -> Column:
    """Largest is best: organisation info, impact, certificate number as text, length, first place."""
    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in certs.columns else default

    texts = [c for c, kind in certs.dtypes if kind == "string"]
    return F.struct(
        (column("organization_info", F.lit("")) != "").cast("int").alias("a"),
        column("score_impact", F.lit(0)).cast("double").alias("b"),
        column("certificate_number", F.lit("")).alias("c"),
        F.length(F.concat_ws("", *texts)).alias("d"),
        (-F.col("pos")).alias("e"),
    )


def certs_by_name(certs: DataFrame, **counts: Column) -> DataFrame:
    """``seq, name, pos, _c`` and ``counts``: one row per name, its first place and its most complete row.

    Names repeat, so what follows from a name alone is computed on fewer rows, and several steps can share them.
    """
    rest = [c for c in certs.columns if c not in ("seq", "pos")]
    rated = certs.withColumn("_q", _quality(certs))
    best = F.min_by(F.struct(*rest, "_q"), F.col("_q")).alias("_c")
    return rated.groupBy("seq", "name").agg(F.min("pos").alias("pos"), best, *[c.alias(n) for n, c in counts.items()])


def best_of_names(named: DataFrame) -> DataFrame:
    """``best_certs`` from the rows of ``certs_by_name``."""
    keyed = computed_once(named.select("seq", "pos", "_c", "name"), cert_key=text.cert_key("name")).filter("cert_key != ''")
    best = keyed.groupBy("seq", "cert_key").agg(F.min("pos").alias("pos"), F.min_by("_c", F.col("_c._q")).alias("_c"))
    return best.select("seq", "cert_key", "pos", "_c.*")


def best_certs(certs: DataFrame) -> DataFrame:
    """One certification per normalised name: the most complete one, at the first one's place."""
    keyed = computed_once(certs, cert_key=text.cert_key("name")).filter("cert_key != ''")
    rest = [c for c in certs.columns if c not in ("seq", "pos")]
    return (
        keyed.withColumn("_q", _quality(certs))
        .groupBy("seq", "cert_key")
        .agg(F.min("pos").alias("pos"), F.min_by(F.struct(*rest, "_q"), F.col("_q")).alias("_c"))
        .select("seq", "cert_key", "pos", "_c.*")
    )


def distinct_certs(certs: DataFrame, threshold: float = 0.8, measure: str = "blocks") -> DataFrame:
    """``best_certs`` without near-equal names, removed greedily pair by pair.

    ``measure`` is ``blocks`` (matching blocks) or ``edits`` (edit distance); see ``near_names``.
    """
    return without_near_names(best_certs(certs), threshold, measure)


def without_near_names(best: DataFrame, threshold: float = 0.8, measure: str = "blocks") -> DataFrame:
    """``distinct_certs`` from the rows of ``best_certs``."""
    best = cut_lineage(best)
    rank = F.struct("_q.a", "_q.b", "_q.c", "_q.d")
    items = best.select(F.col("seq").alias("group"), "pos", F.upper("name").alias("name"), rank.alias("rank"))
    gone = near_names.greedy_removed(items, threshold, measure).rows.withColumnRenamed("group", "seq")
    return best.join(gone, ["seq", "pos"], "left_anti").drop("_q")


def one_jci(certs: DataFrame) -> DataFrame:
    """Of several JCI certifications the most complete one stays and moves to the end."""
    jci = has(F.upper(filled("name")), "JCI", "JOINT COMMISSION INTERNATIONAL")
    tagged = certs.withColumn("_jci", jci).withColumn("_q", _jci_order(certs))
    family = tagged.filter("_jci").groupBy("seq").agg(
        F.count("*").alias("_n"), F.max_by(F.col("pos"), F.col("_q")).alias("_best")
    )
    joined = tagged.join(family, "seq", "left")
    several = F.col("_jci") & (F.col("_n") > 1)
    return (
        joined.filter(~several | (F.col("pos") == F.col("_best")))
        .withColumn("moved_last", several.cast("int"))
        .drop("_jci", "_q", "_n", "_best")
    )


def dedupe_on(df: DataFrame, keys: Sequence[Column | str], order: Column | str = "seq") -> DataFrame:
    """First row per composite key."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)])
    return first_rows(keyed, names, [order]).drop(*names)


def drop_similar_texts(texts: Column, threshold: float = 0.7, keep: int = 5) -> Column:
    """Texts not too similar (word Jaccard) to an earlier kept one, at most ``keep``.

    Meant for the short candidate lists of one page.
    """
    items = F.transform(texts, lambda t: F.struct(t.alias("t"), text.words(F.lower(t)).alias("w")))
    start = F.array().cast("array<struct<t:string,w:array<string>>>")
    similar = lambda a, b: text.word_similarity(a["w"], b["w"]) > threshold
    kept = F.aggregate(
        items,
        start,
        lambda acc, x: F.when(F.exists(acc, lambda y: similar(x, y)), acc).otherwise(F.array_append(acc, x)),
    )
    return F.slice(F.transform(kept, lambda k: k["t"]), 1, keep)


# --- upserts -------------------------------------------------------------------------------


def split_matched(incoming: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming rows with their ``match_seq``, and the rows without one."""
    matched = incoming.join(matches.select("seq", "match_seq"), "seq")
    return matched, incoming.join(matches.select("seq"), "seq", "left_anti")


def batch_first(fresh: DataFrame, key: Column) -> DataFrame:
    """``seq, target_seq``: unmatched rows mapped to the first row of their key in the batch."""
    keyed = fresh.select("seq", key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("seq").alias("target_seq"))
    return keyed.join(first, "_key").select("seq", "target_seq")


def upload_targets(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """``seq, target_seq, is_new``: base row of the same lower-case name, else first batch row."""
    key = F.lower(filled("name"))
    held = base.groupBy(key.alias("_key")).agg(F.max("seq").alias("_base"))
    first = incoming.groupBy(key.alias("_key")).agg(F.min("seq").alias("_first"))
    return (
        incoming.select("seq", key.alias("_key"))
        .join(first, "_key")
        .join(held, "_key", "left")
        .select(
            "seq",
            F.coalesce("_base", "_first").alias("target_seq"),
            (F.col("_base").isNull() & (F.col("seq") == F.col("_first"))).alias("is_new"),
        )
    )


def upload_certs(base_certs: DataFrame, new_certs: DataFrame, targets: DataFrame) -> DataFrame:
    """Base certifications plus the uploaded ones whose lower-case name the target lacks.

    A newly inserted organisation brings its own list unchanged.
    """
    title = F.lower(filled("name"))
    routed = new_certs.join(targets, "seq")
    own = routed.filter("is_new").select(F.col("target_seq").alias("seq"), "pos", "name")
    held = base_certs.select("seq", "pos", "name").unionByName(own)
    known = held.select(F.col("seq").alias("target_seq"), title.alias("_title")).distinct()
    extra = (
        routed.filter("not is_new")
        .withColumn("_title", title)
        .join(known, ["target_seq", "_title"], "left_anti")
    )
    first = first_rows(extra, ["target_seq", "_title"], ["seq", "pos"])
    return held.withColumn("added", F.lit(0)).union(
        first.select(F.col("target_seq").alias("seq"), "pos", "name", F.lit(1))
    )


def appended(held: DataFrame, extra: DataFrame) -> DataFrame:
    """``held(seq, pos, ...)`` and behind them ``extra(seq, source_seq, pos, ...)``, by source row.

    New places go on from the target's last one and may leave gaps; nothing is gathered per target.
    """
    last = held.groupBy("seq").agg(F.max("pos").alias("_last"))
    width = extra.agg(F.coalesce(F.max("pos"), F.lit(0)) + 1).scalar()
    place = F.coalesce("_last", F.lit(0)) + 1 + F.col("source_seq") * width + F.col("pos")
    moved = extra.join(last, "seq", "left").withColumn("pos", place).drop("_last", "source_seq")
    return held.unionByName(moved, allowMissingColumns=True)


def overridden_flags(flags: DataFrame, changed: DataFrame) -> DataFrame:
    """``flags(seq, flag, value)`` with the changed ones replaced or added."""
    return flags.join(changed.select("seq", "flag"), ["seq", "flag"], "left_anti").unionByName(changed)


REGISTRY_CERT = "NABH Entry Level"  # fixed value: type of the certification
REGISTRY_NAME = "National Accreditation Board for Hospitals & Healthcare Providers (NABH) - Entry Level"  # fixed value


def registry_upsert(
    base: DataFrame, incoming: DataFrame, matches: DataFrame, certs: DataFrame, flags: DataFrame
) -> dict[str, DataFrame]:
    """Entry-level registry rows: the last matching row sets status, flags and impact of a target.

    Unmatched names already in the base (any country) are skipped; new names are inserted once.
    ``certs(seq, pos, name, cert_type, status, score_impact)``, ``flags(seq, flag, value)``.
    Tables: ``orgs``, every base row and the inserted ones with ``action``; ``certs``, where the
    first entry-level certification of a target is replaced, else one is appended; ``flags``.
    """
    # the match and its outcome are stored, as three tables are built from them
    matched, fresh = split_matched(incoming, cut_lineage(matches.select("seq", "match_seq")))
    name = lower_name("name")
    known = base.select(name.alias("_key")).distinct()
    fresh = fresh.withColumn("_key", name).join(known, "_key", "left_anti").drop("_key")
    routes = batch_first(fresh, name)
    inserted = fresh.join(routes, "seq").withColumn("action", F.lit("inserted"))
    updated = matched.withColumnRenamed("match_seq", "target_seq").withColumn("action", F.lit("updated"))
    fields = F.struct("status", "accreditation_no", "valid_upto")
    last = updated.unionByName(inserted).groupBy("target_seq", "action").agg(
        F.max_by(fields, F.col("seq")).alias("_f"), F.count("*").alias("n_incoming")
    )
    active = F.col("_f.status") == "Active"
    changed = last.select(
        F.col("target_seq").alias("seq"),
        "action",
        "n_incoming",
        "_f.*",
        F.when(active, 15.0).otherwise(0.0).alias("score_impact"),
        F.coalesce(active, F.lit(False)).cast("int").alias("accreditation_current"),
    )
    changed = cut_lineage(changed)
    details = set(changed.columns) - {"seq"}
    columns = [c for c in base.columns if c in incoming.columns and c not in details]
    first = inserted.filter("seq = target_seq")
    orgs = (
        base.select(columns)
        .unionByName(first.select(columns))
        .join(changed, "seq", "left")
        .withColumns({"action": F.coalesce("action", F.lit("kept")), "n_incoming": F.coalesce("n_incoming", F.lit(0))})
        .withColumnRenamed("seq", "target_seq")
    )
    fresh_certs = changed.select(
        "seq", F.lit(REGISTRY_NAME).alias("name"), F.lit(REGISTRY_CERT).alias("cert_type"), "status", "score_impact",
        "accreditation_no", "valid_upto",
    )
    own = certs.filter(F.col("cert_type") == REGISTRY_CERT).groupBy("seq").agg(F.min("pos").alias("pos"))
    replaced = fresh_certs.join(own, "seq")
    added = fresh_certs.join(own.select("seq"), "seq", "left_anti").withColumns(
        {"source_seq": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")}
    )
    untouched = certs.join(replaced.select("seq", "pos"), ["seq", "pos"], "left_anti")
    marks = F.array(
        F.struct(F.lit("nabh_accredited").alias("flag"), F.lit(True).alias("value")),
        F.struct(F.lit("nabh_entry_level").alias("flag"), F.lit(True).alias("value")),
        F.struct(F.lit("accreditation_current").alias("flag"), (F.col("accreditation_current") == 1).alias("value")),
    )
    return {
        "orgs": orgs,
        "certs": appended(untouched.unionByName(replaced, allowMissingColumns=True), added),
        "flags": overridden_flags(flags, changed.select("seq", F.inline(marks))),
    }


def portal_upsert(base: DataFrame, incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """Portal rows: longest address, most recent or longest-numbered certificate, highest score.

    ``base`` and ``incoming`` carry ``address, accreditation_no, scraped_date, quality_score``.
    Rows of one target are folded in one step: the address grows monotonically, and among the
    certificates the latest scrape wins, then the longest number, then the earlier row.
    """
    matched, fresh = split_matched(incoming, matches)
    columns = ["address", "accreditation_no", "scraped_date", "quality_score"]
    held = base.select(F.col("seq").alias("target_seq"), F.lit(-1).cast("long").alias("_o"), *columns)
    feed = matched.select(F.col("match_seq").alias("target_seq"), F.col("seq").alias("_o"), *columns)
    new = fresh.select(F.col("seq").alias("target_seq"), F.col("seq").alias("_o"), *columns)
    cert_order = F.struct(
        filled("scraped_date").alias("d"), F.length(filled("accreditation_no")).alias("n"), (-F.col("_o")).alias("o")
    )
    address_order = F.struct(F.length(filled("address")).alias("n"), (-F.col("_o")).alias("o"))
    return held.unionByName(feed).unionByName(new).groupBy("target_seq").agg(
        F.max_by("address", address_order).alias("address"),
        F.max_by("accreditation_no", cert_order).alias("accreditation_no"),
        F.max("quality_score").alias("quality_score"),
        F.count(F.when(F.col("_o") >= 0, 1)).alias("n_incoming"),
    )


def lab_upsert(base: DataFrame, incoming: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Laboratory feed: the first incoming row per target merges, later ones count as duplicates.

    Tables: ``sources(seq, data_source, action)``, ``keywords(seq, keyword)`` and ``stats``.
    """
    matched, fresh = split_matched(incoming, cut_lineage(matches.select("seq", "match_seq")))
    heads = matched.groupBy("match_seq").agg(F.min("seq").alias("seq"), F.count("*").alias("_n"))
    held = F.col("data_source")
    rewritten = F.when(held.isin("JCI", "NABH"), F.concat(held, F.lit("+NABL"))).otherwise("NABL")
    joined = base.join(heads.select(F.col("match_seq").alias("seq"), F.lit(1).alias("_hit")), "seq", "left")
    sources = joined.select(
        "seq",
        F.when(F.col("_hit") == 1, rewritten).otherwise(held).alias("data_source"),
        F.when(F.col("_hit") == 1, "updated").otherwise("kept").alias("action"),
    ).union(fresh.select("seq", F.lit("NABL"), F.lit("added")))
    merged = heads.select("seq", "match_seq").join(incoming.select("seq", "search_keywords"), "seq")
    keywords = (
        base.select("seq", F.explode("search_keywords").alias("keyword"))
        .union(merged.select(F.col("match_seq"), F.explode("search_keywords")))
        .union(fresh.select("seq", F.explode("search_keywords")))
        .distinct()
    )
    stats = heads.agg(
        F.count("*").alias("updated"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    ).withColumn("added", fresh.agg(F.count("*")).scalar())
    return {"sources": sources, "keywords": keywords, "stats": stats}


LAB_FLAGS = [
    "cap_accredited", "iso_15189_accredited", "laboratory_accreditation", "international_accreditation", "accreditation_valid",
]


def laboratory_flags(seqs: DataFrame) -> DataFrame:
    """The indicator flags that an accredited laboratory brings to its target."""
    marks = F.array(*[F.lit(f) for f in LAB_FLAGS])
    return seqs.select("seq").distinct().select("seq", F.explode(marks).alias("flag"), F.lit(True).alias("value"))


def pathology_upsert(
    base: DataFrame, incoming: DataFrame, matches: DataFrame, certs: DataFrame, flags: DataFrame, brand: str | None = None
) -> dict[str, DataFrame]:
    """Pathology-body feed: one fixed certification per matching laboratory, flags, last lab info.

    Laboratories without a match in the base are compared with those inserted before them: similar ones
    join the first, others are inserted (``batches.in_batch``, with its ``brand``). ``certs(seq, pos,
    name, ...)``, ``flags(seq, flag, value)``. Tables: ``orgs``, every base row and the inserted ones with
    ``action``; ``certs``, the held ones and one per laboratory behind them; ``flags``.
    """
    matched, fresh = split_matched(incoming, cut_lineage(matches.select("seq", "match_seq")))
    settled = batches.in_batch(fresh, brand).routes
    routes = matched.select(F.col("match_seq").alias("seq"), F.col("seq").alias("source_seq")).union(
        settled.select(F.col("target_seq"), F.col("seq"))
    )
    joined = routes.filter("seq <> source_seq").join(incoming.select(F.col("seq").alias("source_seq"), "name"), "source_seq")
    per_target = joined.groupBy("seq").agg(
        F.count("*").alias("added_certs"), F.max_by("name", "source_seq").alias("lab_name")
    )
    held = F.coalesce("data_source", F.lit(""))
    tagged = F.when(held == "", "CAP").when(held.contains("CAP"), held).otherwise(F.concat(held, F.lit(", CAP")))
    hit = F.col("added_certs").isNotNull()
    merged = base.join(per_target, "seq", "left").select(
        "seq",
        F.when(hit, tagged).otherwise(F.col("data_source")).alias("data_source"),
        F.coalesce("added_certs", F.lit(0)).alias("added_certs"),
        "lab_name",
        F.when(hit, "updated").otherwise("kept").alias("action"),
    )
    firsts = fresh.join(settled.filter("seq = target_seq").select("seq"), "seq", "left_semi")
    inserted = firsts.join(per_target, "seq", "left").select(
        "seq",
        F.lit("CAP 15189"),
        F.coalesce("added_certs", F.lit(0)),
        F.coalesce("lab_name", "name"),
        F.lit("inserted"),
    )
    extra = routes.withColumns(
        {"pos": F.lit(0).cast("long"), "name": F.lit("College of American Pathologists (CAP)"), "status": F.lit("Active"), "score_impact": F.lit(18.0)}
    )
    return {
        "orgs": merged.union(inserted),
        "certs": appended(certs, extra),
        "flags": overridden_flags(flags, laboratory_flags(routes)),
    }


def branded_lab_upsert(
    base: DataFrame, labs: DataFrame, matches: DataFrame,
    certs: DataFrame, lab_certs: DataFrame, initiatives: DataFrame, lab_initiatives: DataFrame, flags: DataFrame,
) -> dict[str, DataFrame]:
    """Branded laboratories: score grows by each impact up to 100, specialties are united.

    ``base(seq, quality_score, specialties)``, ``labs(seq, impact, specialties, quality_score)``.
    A matched laboratory appends its first certification and all its initiatives to the target; an
    unmatched one is inserted with its own score and lists. ``certs``, ``initiatives`` and those of
    the laboratories are long, ``(seq, pos, ...)``. Tables: ``orgs``, every base row and the inserted
    ones with ``action``; ``certs``; ``initiatives``; ``flags(seq, flag, value)``.
    """
    matched, fresh = split_matched(labs, matches)
    gains = matched.groupBy("match_seq").agg(F.sum("impact").alias("_gain"), F.count("*").alias("n_labs"))
    # distinct (target, specialty) first, so the collected list is bounded by the vocabulary
    skills = (
        matched.select("match_seq", F.explode("specialties").alias("s")).distinct().groupBy("match_seq").agg(
            F.array_sort(F.collect_list("s")).alias("_new")
        )
    )
    hit = F.col("n_labs").isNotNull()
    score = F.least(F.lit(100.0), F.coalesce("quality_score", F.lit(70.0)) + F.col("_gain"))
    united = F.array_union(F.coalesce("specialties", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>")))
    merged = (
        base.join(gains.withColumnRenamed("match_seq", "seq"), "seq", "left")
        .join(skills.withColumnRenamed("match_seq", "seq"), "seq", "left")
        .select(
            "seq",
            F.when(hit, score).otherwise(F.col("quality_score")).alias("quality_score"),
            F.when(hit, united).otherwise(F.col("specialties")).alias("specialties"),
            F.coalesce("n_labs", F.lit(0)).alias("n_labs"),
            F.when(hit, "updated").otherwise("kept").alias("action"),
        )
    )
    inserted = fresh.select("seq", "quality_score", "specialties", F.lit(0).cast("long").alias("n_labs"), F.lit("inserted").alias("action"))
    routes = matched.select(F.col("seq").alias("source_seq"), F.col("match_seq").alias("seq"))
    own = fresh.select("seq")

    def moved(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("seq", "source_seq").join(routes, "source_seq")

    first = lab_certs.join(lab_certs.groupBy("seq").agg(F.min("pos").alias("pos")), ["seq", "pos"])
    return {
        "orgs": merged.unionByName(inserted),
        "certs": appended(certs, moved(first)).unionByName(lab_certs.join(own, "seq"), allowMissingColumns=True),
        "initiatives": appended(initiatives, moved(lab_initiatives)).unionByName(
            lab_initiatives.join(own, "seq"), allowMissingColumns=True
        ),
        "flags": overridden_flags(flags, laboratory_flags(routes.select("seq").union(own))),
    }


def global_targets(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """``seq, target_seq, is_new``: first base row of the same company key, else first batch row."""
    key = text.company_key("name")
    both = base.select(F.lit(0).alias("_t"), "seq", key.alias("_key")).union(
        incoming.select(F.lit(1), "seq", key)
    ).filter("_key != ''")
    first = both.groupBy("_key").agg(F.min(F.struct("_t", "seq")).alias("_f"))
    routed = both.filter("_t = 1").join(first, "_key")
    return routed.select(
        "seq", F.col("_f.seq").alias("target_seq"), ((F.col("_f._t") == 1) & (F.col("_f.seq") == F.col("seq"))).alias("is_new")
    )


def global_fill(base: DataFrame, incoming: DataFrame, targets: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Base rows with empty fields filled by the first incoming value, and added source names.

    Source names are united as distinct values per target before they are joined to one text.
    """
    routed = incoming.join(targets, "seq")
    offers = [
        F.min_by(F.when(filled(f) != "", F.col(f)), F.when(filled(f) != "", F.col("seq"))).alias(f"_{f}")
        for f in fields
    ]
    per_target = routed.groupBy("target_seq").agg(*offers)
    names = (
        routed.groupBy("target_seq", "source_name").agg(F.min("seq").alias("_o")).groupBy("target_seq").agg(
            F.array_sort(F.collect_list(F.struct("_o", "source_name"))).alias("_s")
        )
    )
    held = filled("data_source")
    add = F.transform(F.filter("_s", lambda s: ~F.contains(held, s["source_name"])), lambda s: s["source_name"])
    joined = base.join(per_target.withColumnRenamed("target_seq", "seq"), "seq", "left").join(
        names.withColumnRenamed("target_seq", "seq"), "seq", "left"
    )
    kept = [F.when(filled(f) != "", F.col(f)).otherwise(F.coalesce(F.col(f"_{f}"), F.col(f))).alias(f) for f in fields]
    source = F.concat_ws(", ", F.nullif(held, F.lit("")), F.array_join(add, ", "))
    return joined.select("seq", *kept, F.when(F.size(add) > 0, source).otherwise(held).alias("data_source"))


def validated_certs(
    base_certs: DataFrame, new_certs: DataFrame, targets: DataFrame, official: DataFrame
) -> DataFrame:
    """Union of base and incoming certifications by lower-case name, registry-checked.

    ``new_certs(seq, pos, name, kind)``; kind JCI needs the incoming company key in
    ``official(company_key)``. ``new_certs`` also carries ``company_key``.
    """
    routed = new_certs.filter(filled("name").rlike(r"\S")).join(targets, "seq")
    listed = official.select("company_key").distinct().withColumn("_ok", F.lit(1))
    checked = routed.join(listed, "company_key", "left").filter((F.col("kind") != "JCI") | (F.col("_ok") == 1))
    title = F.lower(F.trim(filled("name")))
    known = base_certs.select(F.col("seq").alias("target_seq"), title.alias("_title")).distinct()
    extra = checked.withColumn("_title", title).join(known, ["target_seq", "_title"], "left_anti")
    first = first_rows(extra, ["target_seq", "_title"], ["seq", "pos"])
    return base_certs.select("seq", "pos", "name", F.lit(0).alias("validated")).union(
        first.select("target_seq", "pos", "name", F.lit(1))
    )


def two_registry_merge(orgs: DataFrame, certs: DataFrame) -> dict[str, DataFrame]:
    """Rows of one hospital key become one: certifications by exact name, sources put together."""
    keyed = orgs.select("seq", "data_source", text.hospital_key("name").alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("seq").alias("group_seq"))
    targets = keyed.join(first, "_key").select("seq", "group_seq", "data_source")
    base_rows = certs.join(targets.filter("seq = group_seq"), "seq")
    later = certs.join(targets.filter("seq != group_seq"), "seq")
    known = base_rows.select("group_seq", "name").distinct()
    extra = first_rows(later.join(known, ["group_seq", "name"], "left_anti"), ["group_seq", "name"], ["seq", "pos"])
    merged = base_rows.select("group_seq", "pos", "name").union(extra.select("group_seq", "pos", "name"))
    named = targets.groupBy("group_seq", "data_source").agg(F.min("seq").alias("_o"))
    ordered = named.groupBy("group_seq").agg(F.array_sort(F.collect_list(F.struct("_o", "data_source"))).alias("_s"))
    names = F.transform("_s", lambda s: s["data_source"])
    joined = F.aggregate(
        names,
        F.lit(""),
        lambda acc, s: F.when(acc == "", s).when(F.contains(acc, s), acc).otherwise(F.concat(acc, F.lit(", "), s)),
    )
    return {"certs": merged, "sources": ordered.select("group_seq", joined.alias("data_source"))}


def submission_upsert(base: DataFrame, submissions: DataFrame, fields: Sequence[str], as_of: str) -> DataFrame:
    """User submissions by lower-case name and location: the first base row is updated, else inserted.

    Later submissions of one organisation override earlier ones field by field.
    """
    def keys(df: DataFrame) -> DataFrame:
        return df.withColumn("_n", lower_name("name")).withColumn("_l", lower_name("location"))

    latest = keys(submissions).groupBy("_n", "_l").agg(
        F.min("seq").alias("_new"),
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields],
    )
    held = keys(base)
    target = held.groupBy("_n", "_l").agg(F.min("seq").alias("_target"))
    routed = latest.join(target, ["_n", "_l"], "full_outer")
    changed = routed.filter(F.col("_new").isNotNull())
    updates = changed.filter(F.col("_target").isNotNull()).drop("_n", "_l", "_new").withColumnRenamed("_target", "seq")
    stamped = base.join(updates.withColumn("_hit", F.lit(1)), "seq", "left")
    kept = stamped.select(
        "seq",
        *[F.coalesce(F.col(f"_{f}"), F.col(f)).alias(f) for f in fields],
        "data_source",
        F.when(F.col("_hit") == 1, F.lit(as_of)).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    inserted = changed.filter(F.col("_target").isNull()).select(
        F.col("_new"), *[F.col(f"_{f}") for f in fields], F.lit("website_upload"), F.lit(as_of)
    )
    return kept.union(inserted)


# --- patches and bookkeeping ---------------------------------------------------------------


def patched(orgs: DataFrame, phrases: Sequence[str]) -> Column:
    """Rows a name patch applies to."""
    return has(F.lower(filled("name")), *phrases)


def drop_certs_of(orgs: DataFrame, certs: DataFrame, phrases: Sequence[str], family=is_jci_like) -> DataFrame:
    """Certifications without a family (and without blanks) for the organisations a patch names."""
    marked = orgs.filter(patched(orgs, phrases)).select("seq").withColumn("_p", F.lit(1))
    joined = certs.join(marked, "seq", "left")
    drop = (F.col("_p") == 1) & (family("name") | ~filled("name").rlike(r"\S"))
    return joined.filter(~F.coalesce(drop, F.lit(False))).drop("_p")


def unset_flags(orgs: DataFrame, flags: DataFrame, phrases: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Flags set to false for the organisations a patch names."""
    marked = orgs.filter(patched(orgs, phrases)).select("seq").withColumn("_p", F.lit(1))
    off = (F.col("_p") == 1) & F.col("flag").isin(list(names))
    return flags.join(marked, "seq", "left").withColumn(
        "value", F.when(off, F.lit(False)).otherwise(F.col("value"))
    ).drop("_p")


def drop_superseded(orgs: DataFrame, certs: DataFrame, phrase: str, number: str) -> DataFrame:
    """Without the first row of a phrase that holds the certificate number, if the phrase repeats."""
    named = orgs.filter(F.lower(filled("name")).contains(phrase)).select("seq")
    holders = certs.filter(F.col("certificate_number") == number).select("seq").distinct()
    victim = named.join(holders, "seq").agg(F.min("seq")).scalar()
    several = named.agg(F.count("*")).scalar() >= 2
    doomed = (F.col("seq") == victim) & several
    return orgs.filter(~F.coalesce(doomed, F.lit(False)))


def insert_absent(orgs: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated rows whose lower-case phrase no organisation name contains are appended.

    ``curated`` carries ``phrase`` besides the columns of ``orgs``; it is a small hand-kept list.
    """
    asked = curated.select(F.col("seq").alias("lid"), F.lower("phrase").alias("key"))
    right = orgs.select(F.col("seq").alias("ord"), F.lower(filled("name")).alias("key"))
    present = blocking.left_in_right(asked, right).select(F.col("lid").alias("seq")).distinct()
    return orgs.unionByName(curated.join(present, "seq", "left_anti").select(*orgs.columns))


def run_statistics(before: DataFrame, incoming: DataFrame, actions: DataFrame, after: DataFrame) -> DataFrame:
    """Processed, per-action and final row counts of one integration run. ``actions(action)``."""
    counts = actions.groupBy("action").agg(F.count("*").alias("n")).select(F.col("action").alias("what"), "n")
    fixed = [("before", before), ("processed", incoming), ("final", after)]
    for name, df in fixed:
        counts = counts.union(df.agg(F.count("*").alias("n")).select(F.lit(name), "n"))
    return counts


def append_feed(base: DataFrame, feed: DataFrame, source: str) -> DataFrame:
    """Feed appended as it is, tagged with its source."""
    return base.unionByName(feed.withColumn("data_source", F.lit(source)), allowMissingColumns=True)
