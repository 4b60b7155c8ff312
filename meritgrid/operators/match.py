"""Name matching between an incoming table and a base table, and registry lookups.

Incoming tables carry ``seq, name`` and location columns; base tables the same. First-in-file
conflicts are settled by the smallest base ``seq``. Results are one row per matched incoming row:
``seq, match_seq`` plus method or score columns. The joins come from ``blocking``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from meritgrid.functions import text
from meritgrid.functions.exprs import computed_once, first_rule, has
from meritgrid.functions.text import filled, lower_name, word_list, words
from meritgrid.operators import blocking, ranked, search
from meritgrid.operators.ordering import first_rows, global_rank, place
from meritgrid.operators.search import Texts, asked_texts, edit_similarity
from meritgrid.rules import names as rules
from meritgrid.session import cut_lineage, spread


def _left(incoming: DataFrame, key: Column, **extra: Column) -> DataFrame:
    return incoming.select(F.col("seq").alias("lid"), key.alias("key"), *[c.alias(n) for n, c in extra.items()])


def _right(base: DataFrame, key: Column, order: Column | None = None, **extra: Column) -> DataFrame:
    order = F.col("seq") if order is None else order
    return base.select(order.alias("ord"), key.alias("key"), *[c.alias(n) for n, c in extra.items()])


def _matched(best: DataFrame) -> DataFrame:
    return best.select(F.col("lid").alias("seq"), F.col("ord").alias("match_seq"))


# --- registry lookups ----------------------------------------------------------------------


def same_name(incoming: DataFrame, base: DataFrame, key=lower_name) -> DataFrame:
    """Equal normalised name; the first base row answers."""
    return _matched(blocking.equal_key(_left(incoming, key("name")), _right(base, key("name"))))


def verified_registry_match(orgs: DataFrame, registry: DataFrame) -> DataFrame:
    """Verified registry rows of the same hospital name whose place occurs in the name.

    Registry rows without any place match by name alone.
    """
    usable = registry.filter(~F.coalesce("verification_required", F.lit(True)))
    places = [c for c in ("city", "state", "country") if c in registry.columns]
    blank = F.lit(True)
    for c in places:
        blank = blank & (filled(c) == "")
    key = text.hospital_key("name")
    left = _left(orgs, F.lower(filled("name")), name_key=key)
    anywhere = blocking.equal_key(
        _left(orgs, key), _right(usable.filter(blank), key)
    )
    rows = usable.select("seq", key.alias("name_key"), F.explode(F.array(*[F.lower(filled(c)) for c in places])).alias("_p"))
    by_place = _right(rows.filter("_p != ''"), F.col("_p"), name_key=F.col("name_key"))
    inside = blocking.right_in_left(left, by_place, ["name_key"])
    return _matched(blocking.best_of(anywhere, inside))


def located_name_match(orgs: DataFrame, registry: DataFrame) -> DataFrame:
    """Equal name and, where both sides know it, equal city, else equal state."""
    def side(df: DataFrame) -> DataFrame:
        return df.select(
            "seq", lower_name("name").alias("name_key"), lower_name("city").alias("city"), lower_name("state").alias("state")
        )

    left, right = side(orgs).withColumnRenamed("seq", "lid"), side(registry)
    by_city = right.filter("city != ''").groupBy("name_key", "city").agg(F.min("seq").alias("ord"))
    by_state = right.filter("state != ''").groupBy("name_key", "state", (F.col("city") == "").alias("_nocity")).agg(F.min("seq").alias("ord"))
    by_name = right.groupBy("name_key", (F.col("city") == "").alias("_nocity"), (F.col("state") == "").alias("_nostate")).agg(F.min("seq").alias("ord"))
    free_city = (F.col("city") == "") | F.col("_nocity")
    free_state = (F.col("state") == "") | F.col("_nostate")
    return _matched(
        blocking.best_of(
            left.filter("city != ''").join(by_city, ["name_key", "city"]),
            left.filter("state != ''").join(by_state, ["name_key", "state"]).filter(free_city),
            left.join(by_name, "name_key").filter(free_city & free_state),
        )
    )


def registry_valid(orgs: DataFrame, registry: DataFrame) -> DataFrame:
    """Organisations backed by the registry: a verified name, or the registry city of the name."""
    rows = registry.select(
        text.alnum_key("name").alias("_name"), text.alnum_key("city").alias("_city"), "verification_required"
    ).filter("_name != ''")
    verified = rows.filter(~F.col("verification_required")).select("_name").distinct().withColumn("_v", F.lit(1))
    cities = rows.filter("_city != ''").select("_name", "_city").distinct().withColumn("_c", F.lit(1))
    keyed = orgs.withColumn("_name", text.alnum_key("name")).withColumn("_city", text.alnum_key("city"))
    joined = keyed.join(verified, "_name", "left").join(cities, ["_name", "_city"], "left")
    return joined.withColumn("registry_valid", F.coalesce("_v", "_c", F.lit(0))).drop("_name", "_city", "_v", "_c")


def insert_new(base: DataFrame, incoming: DataFrame, keys: Sequence[Column], keep_repeats: bool = False) -> DataFrame:
    """Incoming rows whose key is absent from the base; repeats in the batch drop unless kept."""
    names = [f"_k{i}" for i in range(len(keys))]
    known = base.select(*[k.alias(n) for k, n in zip(keys, names)]).distinct()
    fresh = incoming.select("*", *[k.alias(n) for k, n in zip(keys, names)]).join(known, names, "left_anti")
    if not keep_repeats:
        firsts = fresh.groupBy(*names).agg(F.min("seq").alias("seq"))
        fresh = fresh.join(firsts.select("seq"), "seq", "left_semi")
    return fresh.drop(*names)


def enrich_last(orgs: DataFrame, extra: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left enrichment by name; among equal names in the extra table the last row counts."""
    last = (
        extra.withColumn("_key", lower_name("name"))
        .groupBy("_key")
        .agg(F.max_by(F.struct(*columns), F.col("seq")).alias("_row"))
    )
    return (
        orgs.withColumn("_key", lower_name("name"))
        .join(last, "_key", "left")
        .select(*orgs.columns, F.col("_row").isNotNull().cast("int").alias("enriched"), *[F.col(f"_row.{c}").alias(f"extra_{c}") for c in columns])
    )


def fill_from(orgs: DataFrame, existing: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Empty columns filled from the row of the same name in the existing table."""
    extra = enrich_last(orgs, existing, columns)
    for c in columns:
        own = F.when(filled(c) != "", F.col(c))
        extra = extra.withColumn(c, F.coalesce(own, F.col(f"extra_{c}")))
    return extra.drop("enriched", *[f"extra_{c}" for c in columns])


# --- tiered and fuzzy matches --------------------------------------------------------------


def tiered_match(incoming: DataFrame, base: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Equal, contained either way, or word-set Jaccard at the threshold; the earliest base row."""
    left, right = _left(incoming, text.plain_words("name")), _right(base, text.plain_words("name"))
    near = blocking.word_jaccard(left, right, threshold, strict=False)
    return _matched(blocking.best_of(blocking.either_contains(left, right), near))


def same_place_match(incoming: DataFrame, base: DataFrame) -> DataFrame:
    """Equal name, or containment within the same city and state."""
    extra = {"city": lower_name("city"), "state": lower_name("state")}
    left = _left(incoming, lower_name("name"), **extra)
    right = _right(base, lower_name("name"), **extra)
    contained = blocking.either_contains(left, right, ["city", "state"])
    return _matched(blocking.best_of(blocking.equal_key(left, right), contained))


def three_key_match(incoming: DataFrame, base: DataFrame, base_numbers: DataFrame) -> DataFrame:
    """Equal name and place, equal accreditation number, or containment (over 5 letters) in place.

    ``incoming`` carries ``accreditation_no``; ``base_numbers(seq, accreditation_no)`` is long.
    """
    extra = {"city": lower_name("city"), "state": lower_name("state")}
    left = _left(incoming, lower_name("name"), **extra)
    right = _right(base, lower_name("name"), **extra)
    number = F.trim(filled("accreditation_no"))
    by_number = blocking.equal_key(
        _left(incoming, number).filter("key != ''"), _right(base_numbers, number).filter("key != ''")
    )
    long_names = F.length("key") > 5
    contained = blocking.either_contains(left.filter(long_names), right.filter(long_names), ["city", "state"])
    same = blocking.equal_key(left, right, ["city", "state"])
    return _matched(blocking.best_of(same, by_number, contained))


def _overlap_share(part: Column, whole: Column) -> Column:
    shared = F.size(F.array_intersect(words(part), words(whole)))
    longest = F.greatest(F.size(word_list(part)), F.size(word_list(whole)))
    return shared >= longest * 0.6 - 1e-9


def lab_name_match(incoming: DataFrame, base: DataFrame) -> DataFrame:
    """Equal laboratory key, or containment with at least 60 % shared words."""
    key = text.lab_match_key("name")
    left, right = cut_lineage(_left(incoming, key)), cut_lineage(_right(base, key))  # many joins read the keys
    solid_left, solid_right = left.filter("key != ''"), right.filter("key != ''")
    contained = blocking.either_contains(solid_left, solid_right, allowed=_overlap_share)
    return _matched(blocking.best_of(blocking.equal_key(left, right), contained))


def similar_name_match(incoming: DataFrame, base: DataFrame) -> DataFrame:
    """Equal, contained either way, or two shared words of four letters or more."""
    left, right = _left(incoming, text.lab_key("name")), _right(base, text.lab_key("name"))
    return _matched(
        blocking.best_of(blocking.either_contains(left, right), blocking.two_shared_words(left, right))
    )


def laboratory_match(incoming: DataFrame, base: DataFrame, brand: str | None = None) -> DataFrame:
    """The similar-name match; rows whose name holds the brand match the first base row that holds it."""
    if not brand:
        return similar_name_match(incoming, base)
    branded = F.contains(lower_name("name"), F.lit(brand))
    first = base.filter(branded).agg(F.min("seq")).scalar()
    own = incoming.filter(branded).select("seq", first.alias("match_seq")).filter("match_seq IS NOT NULL")
    return similar_name_match(incoming.filter(~branded), base).unionByName(own)


def sub_brand_match(labs: DataFrame, base: DataFrame, parent: str, qualifiers: Sequence[str]) -> DataFrame:
    """Base rows of the parent brand with the same qualifier, or the bare parent name."""
    name = F.lower(filled("name"))
    found = text_tags(name, qualifiers)
    bare = F.when(name == parent, F.array(F.lit("=")))
    nothing = F.array().cast("array<string>")
    tags = F.concat(found, F.array(F.lit("*")), F.coalesce(bare, nothing))
    keyed = base.filter(name.contains(parent)).select(F.explode(tags).alias("_tag"), "seq")
    first = keyed.groupBy("_tag").agg(F.min("seq").alias("ord"))  # one row per qualifier
    wanted = F.concat(found, F.array(F.lit("=")), F.when(name == parent, F.array(F.lit("*"))).otherwise(nothing))
    asked = labs.select(F.col("seq").alias("lid"), F.explode(wanted).alias("_tag"))
    return _matched(blocking.best_of(asked.join(F.broadcast(first), "_tag")))


def text_tags(name: Column, phrases: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(name, p))


def fuzzy_registry_match(orgs: DataFrame, registry: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Best word-Jaccard above the threshold, earliest row among equals, with a confidence word."""
    left, right = _left(orgs, text.registry_key("name")), _right(registry, text.registry_key("name"))
    near = blocking.word_jaccard(left, right, threshold, strict=True)
    best = near.groupBy("lid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o"))).alias("_b"))
    score = -F.col("_b.s")
    return best.select(
        F.col("lid").alias("seq"),
        F.col("_b.o").alias("match_seq"),
        score.alias("similarity"),
        F.when(score > 0.8, "medium").otherwise("low").alias("confidence"),
    )


def match_cascade(orgs: DataFrame, registry: DataFrame) -> DataFrame:
    """Contained in the registry key, contained in its organisation name, fuzzy, or not found.

    ``registry(seq, name, organization_name)``. Containment in either text is one tier: the
    earliest row wins and the key text is tested before the name text of the same row.
    """
    left = _left(orgs, text.registry_key("name"))
    sides = [("name", 0), ("organization_name", 1)]
    right = None
    for column, order in sides:
        rows = _right(registry, text.registry_key(column), F.struct(F.col("seq").alias("s"), F.lit(order).alias("m")))
        right = rows if right is None else right.union(rows)
    direct = blocking.best_of(blocking.left_in_right(left, right)).select(
        F.col("lid").alias("seq"),
        F.col("ord.s").alias("match_seq"),
        F.when(F.col("ord.m") == 0, "direct_name_match").otherwise("organization_name_match").alias("method"),
    )
    fuzzy = fuzzy_registry_match(orgs, registry).select(
        "seq", F.col("match_seq").alias("_f_seq"), F.col("confidence").alias("_f_conf")
    )
    joined = orgs.select("seq").join(direct, "seq", "left").join(fuzzy, "seq", "left")
    found, near = F.col("method").isNotNull(), F.col("_f_seq").isNotNull()
    return joined.select(
        "seq",
        F.coalesce("match_seq", "_f_seq").alias("match_seq"),
        F.when(found, F.col("method")).when(near, "fuzzy_match").otherwise("not_found").alias("method"),
        F.when(found, "high").when(near, F.col("_f_conf")).otherwise("none").alias("confidence"),
    )


def scored_lookup(orgs: DataFrame, scored: DataFrame) -> DataFrame:
    """Row of the scored table by equal key (last one), else the best-scored row by containment."""
    key = text.score_key("name")
    left = _left(orgs, key)
    last = scored.groupBy(key.alias("key")).agg(F.max(F.struct("seq", "total_score")).alias("_r"))
    exact = left.join(last, "key").select("lid", F.col("_r.seq").alias("ord"))
    order = F.struct((-F.col("total_score")).alias("s"), F.col("seq").alias("q"))
    rest = left.join(exact.select("lid"), "lid", "left_anti").filter("key != ''")
    partial = blocking.best_of(blocking.either_contains(rest, _right(scored, key, order).filter("key != ''")))
    hits = exact.select("lid", "ord", F.lit("precomputed_exact").alias("source")).union(
        partial.select("lid", F.col("ord.q"), F.lit("precomputed_partial"))
    )
    joined = orgs.select(F.col("seq").alias("lid")).join(hits, "lid", "left")
    return joined.select(
        F.col("lid").alias("seq"), F.col("ord").alias("match_seq"), F.coalesce("source", F.lit("live")).alias("source")
    )


def loose_registry_match(orgs: DataFrame, registry: DataFrame) -> DataFrame:
    """Equal name, else containment either way or a word over three letters inside the registry name."""
    left, right = _left(orgs, lower_name("name")), _right(registry, lower_name("name"))
    exact = blocking.equal_key(left, right)
    rest = left.join(exact.select("lid"), "lid", "left_anti")
    long_words = F.filter(words("key"), lambda w: F.length(w) > 3)
    by_word = rest.select("lid", F.explode(long_words).alias("key"))
    loose = blocking.best_of(blocking.either_contains(rest, right), blocking.left_in_right(by_word, right))
    return _matched(exact.union(loose))


# --- lookups of search texts ---------------------------------------------------------------


@pandas_udf(DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts (Ratcliff and Obershelp)."""
    import difflib

    seen: dict[tuple[str, str], float] = {}

    def ratio(x: str, y: str) -> float:
        if (x, y) not in seen:
            seen[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
        return seen[x, y]

    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


QUERY_BLOCK = 1000  # search texts that meet the organisations in one pass, where no index helps


def in_blocks(asked: DataFrame, search: Callable[[DataFrame], DataFrame], size: int | None = None) -> DataFrame:
    """``search`` over the numbered texts (``query_no, query``), a block of bounded size at a time.

    Every block is one pass over the organisations; it is for searches that no index helps.
    """
    size = size or QUERY_BLOCK
    if asked.isEmpty():
        return search(asked)
    numbered = cut_lineage(global_rank(place(asked, "query_no", "query"), "_place").drop("_pid", "_pos"))
    last, found = numbered.agg(F.max("_place")).first()[0], None
    for start in range(0, last, size):
        block = numbered.filter((F.col("_place") > start) & (F.col("_place") <= start + size))
        part = search(block.select("query_no", "query"))
        found = part if found is None else found.union(part)
    return found


def _either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _once(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).alias("text")).distinct()


ALIAS = ("john hopkins", "johns hopkins")
TIERS = ["exact", "contained", "original_name", "fuzzy"]


def lookup_names(orgs: DataFrame, queries: Texts, threshold: float = 0.6) -> DataFrame:
    """Best organisation per search text: equal, contained, contained in the original name, fuzzy.

    ``queries``: a table ``query_no, query`` or a list of texts. The fuzzy tier is 0.4 character
    similarity + 0.6 word overlap, at least 0.9 for the alias. The first tier with a hit decides; in it
    the best score, then file order. Texts meet names through the containment automaton and the
    word index of ``search``: characters give 0.4 at most, and less if the texts differ, so a pair shares
    more than (score - 0.4) / 0.6 of the text's words, the alias aside. The names with the rarest word of a
    text come first; with their best score the others need more words in common, so that frequent words are
    read only for texts without a good name. For a threshold of 0.4 or less all pairs are compared, a block at
    a time.
    """
    named = orgs.filter((filled("name") != "") | (filled("original_name") != "")).select(
        "seq", lower_name("name").alias("_n"), lower_name("original_name").alias("_o")
    )
    named = cut_lineage(named)  # every tier reads the names
    asked = cut_lineage(asked_texts(orgs.sparkSession, queries))
    left = asked.select(F.col("query_no").alias("lid"), F.col("query").alias("key"))

    def right(column: str) -> DataFrame:
        return named.filter(F.col(column) != "").select(F.col("seq").alias("ord"), F.col(column).alias("key"))

    found, rest = None, left
    for tier, hits in enumerate(
        (
            lambda: blocking.equal_key(rest, named.select(F.col("seq").alias("ord"), F.col("_n").alias("key"))),
            lambda: blocking.best_of(blocking.either_contains(rest, right("_n"))),
            lambda: blocking.best_of(blocking.either_contains(rest, right("_o"))),
        )
    ):
        got = cut_lineage(hits())
        rows = got.select("lid", F.lit(TIERS[tier]).alias("method"), "ord", F.lit(1.0).alias("score"))
        found = rows if found is None else found.unionByName(rows)
        rest = cut_lineage(rest.join(got.select("lid"), "lid", "left_anti"))
    texts = named.filter("_n <> ''").groupBy(F.col("_n").alias("text")).agg(F.min("seq").alias("ord"))

    def scored(pairs: DataFrame) -> DataFrame:
        q, n, least = F.col("a"), F.col("b"), F.col("least")
        alias = F.contains(q, F.lit(ALIAS[0])) & F.contains(n, F.lit(ALIAS[1]))
        shared = computed_once(pairs, _o=text.word_overlap(F.col("words_a"), F.col("words_b")) * 0.6)
        likely = shared.filter(alias | (search.length_bound(q, n) * 0.4 + F.col("_o") >= least - search.SLACK))
        based = computed_once(likely.select("a", "b", "ord", "_o"), _base=edit_similarity(q, n) * 0.4 + F.col("_o"))
        score = F.when(alias, F.greatest(F.col("_base"), F.lit(0.9))).otherwise(F.col("_base"))
        return based.select("a", "ord", score.alias("s")).filter(F.col("s") >= threshold)

    def best_names(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("ord").alias("o"))).alias("_b"))

    kept = ["a", "words_a", "b", "words_b", "ord", "least"]
    with_words = lambda pairs: pairs.select(
        "a", words("a").alias("words_a"), "b", words("b").alias("words_b"), "ord", F.lit(threshold).alias("least")
    )
    if threshold > 0.4:
        names, open_ = cut_lineage(texts), _once(rest, "key")
        known = names.filter(F.contains("text", F.lit(ALIAS[1]))).select(F.col("text").alias("b"), "ord", F.lit(1).alias("_j"))
        alias = open_.filter(F.contains("text", F.lit(ALIAS[0]))).select(F.col("text").alias("a"), F.lit(1).alias("_j"))
        # a pair that comes twice changes nothing: the best one is taken
        by_alias = with_words(alias.join(known, "_j"))
        rare = cut_lineage(search.rare_words(open_, names))
        near = search.pairs_at_words(rare.withColumn("least", F.lit(threshold)), names, 1, 1).select(*kept)
        first = cut_lineage(best_names(scored(near.union(by_alias))))
        least = F.greatest(F.coalesce(-F.col("_b.s"), F.lit(threshold)), F.lit(threshold))
        open_ = cut_lineage(rare.join(first, "a", "left").select(*rare.columns, least.alias("least")))
        more = search.pairs_at_words(open_, names, 2, search.words_needed((F.col("least") - 0.4) / 0.6)).select(*kept)
        best = first.union(best_names(scored(more))).groupBy("a").agg(F.min("_b").alias("_b"))
    else:
        other = texts.select(F.col("text").alias("b"), "ord")
        pairs = in_blocks(
            rest.select(F.col("lid").alias("query_no"), F.col("key").alias("query")),
            lambda block: scored(with_words(F.broadcast(_once(block, "query").select(F.col("text").alias("a"))).join(other))),
        )
        best = best_names(pairs)
    fuzzy = rest.join(best.withColumnRenamed("a", "key"), "key").select(
        "lid", F.lit(TIERS[3]).alias("method"), F.col("_b.o").alias("ord"), (-F.col("_b.s")).alias("score")
    )
    return found.unionByName(fuzzy).select(F.col("lid").alias("query_no"), "method", F.col("ord").alias("match_seq"), "score")


SEARCH_WEIGHTS = {  # fixed values: weight of each part of the search score
    "direct": 0.3,
    "normalized": 0.25,
    "overlap": 0.2,
    "substring": 0.15,
    "original": 0.05,
    "original_substring": 0.05,
}


SEARCH_BLOCK = 50_000  # search texts that meet all names in one pass of ``ranked_search``
NAME_CHUNK = 20_000  # names that meet the texts of a block at once
LIST_PARTS = 64  # lists in which the numbers of one name or text are kept


def _numbers(df: DataFrame, number: str, texts: Sequence[str]) -> DataFrame:
    """Rows of equal ``texts`` as one, with the list of their numbers; a frequent text has several lists."""
    part = F.pmod(F.xxhash64(number), F.lit(LIST_PARTS)).alias("_part")
    return df.groupBy(*texts, part).agg(F.collect_list(F.struct(number)).alias(f"_{number}s")).drop("_part")


def ranked_search(orgs: DataFrame, queries: Texts, threshold: float = 0.6) -> DataFrame:
    """All organisations whose weighted similarity to a search text reaches the threshold.

    ``queries``: a table ``query_no, query`` or a list of texts. Half the weight lies on parts that
    frequent words alone can reach, so an index by grams or words returns most pairs of a table of like
    names. Texts meet the names in memory instead, a block of texts at a time: names of like length and
    letters come in chunks, where ``ranked.Search`` rules out groups of names by bounds and scores the few pairs
    left. No candidate is written, and a hit is not shuffled.
    """
    named = orgs.filter(filled("name") != "").select(
        "seq",
        F.lower("name").alias("_n"),
        F.lower(text.search_key("name")).alias("_k"),
        F.lower(filled("original_name")).alias("_o"),
    )
    kinds = _numbers(named, "seq", ["_n", "_k", "_o"]).withColumn("_nw", words("_n"))
    order = [F.length("_n"), F.col("_n")]
    tasks = int(orgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = kinds.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    chunk = F.floor(F.monotonically_increasing_id() / NAME_CHUNK).alias("_chunk")
    chunks = near.select("*", chunk).groupBy("_chunk").agg(F.collect_list(F.struct(*kinds.columns)).alias("_names"))
    chunks = cut_lineage(spread(chunks.select("_names")))
    asked = cut_lineage(asked_texts(orgs.sparkSession, queries))

    def scored(block: DataFrame) -> DataFrame:
        texts = _numbers(block, "query_no", ["query"]).select(
            F.col("query").alias("_q"), F.lower(text.search_key("query")).alias("_qk"), words("query").alias("_qw"), "_query_nos"
        )
        # one row with the texts of a block: bounded
        texts = texts.agg(F.collect_list(F.struct(*texts.columns)).alias("_texts"))
        met = F.broadcast(texts).crossJoin(chunks)
        kinds_of_hit = "_query_nos array<struct<query_no:bigint>>, _seqs array<struct<seq:" + named.schema["seq"].dataType.simpleString() + ">>, score double"
        hits = met.mapInArrow(ranked.search_chunks(SEARCH_WEIGHTS, threshold), kinds_of_hit)
        return hits.select("_seqs", "score", F.inline("_query_nos")).select("query_no", "score", F.inline("_seqs"))

    return in_blocks(asked, scored, SEARCH_BLOCK).select("query_no", "seq", "score")


def branch_group(name: Column | str) -> Column:
    """struct(group, branches, search_type): branch group by phrase or any of its words."""
    lowered = lower_name(name)
    rules_by_word = [(key.split(), key) for key in rules.BRANCH_GROUPS]
    group = first_rule(lowered, rules_by_word, None)
    branches = first_rule(lowered, [(k.split(), n) for k, n in rules.BRANCH_GROUPS.items()], 0)
    kind = (
        F.when(branches > 0, "multi_location")
        .when(has(lowered, *rules.LOCATION_WORDS), "specific_location")
        .otherwise("single_location")
    )
    return F.struct(group.alias("group"), branches.alias("branches"), kind.alias("search_type"))


# Country spellings of one region.
REGION_ALIASES = {"usa": "united states", "us": "united states", "uk": "united kingdom"}


def region_peers(orgs: DataFrame, subjects: DataFrame, k: int = 8) -> DataFrame:
    """First k organisations in file order in the subject's region, itself excluded.

    ``subjects(seq, name, region_key)``; an organisation belongs to its country and its region.
    """
    country, region = lower_name("country"), lower_name("region")
    alias = F.create_map(*[F.lit(x) for kv in REGION_ALIASES.items() for x in kv])
    keys = F.array_distinct(F.filter(F.array(country, region, F.coalesce(F.try_element_at(alias, country), country)), lambda x: x != ""))
    member = orgs.select("seq", lower_name("name").alias("_n"), F.explode(keys).alias("region_key"))
    # at most k rows per name, then 2k rows: k of them always remain without the subject's name
    few = first_rows(member, ["region_key", "_n"], ["seq"], k)
    head = first_rows(few, ["region_key"], ["seq"], 2 * k)
    pairs = subjects.select(F.col("seq").alias("subject"), lower_name("name").alias("_own"), "region_key").join(head, "region_key")
    others = pairs.filter(F.col("_n") != F.col("_own"))
    return first_rows(others, ["subject"], ["seq"], k).select("subject", F.col("seq").alias("peer"))


def peers_by_score(peers: DataFrame, scored: DataFrame) -> DataFrame:
    """Region peers with their scores, placed best first per subject."""
    joined = peers.join(scored.select(F.col("seq").alias("peer"), "total_score"), "peer")
    w = Window.partitionBy("subject").orderBy(F.desc("total_score"), "peer")
    return joined.withColumn("place", F.row_number().over(w))
