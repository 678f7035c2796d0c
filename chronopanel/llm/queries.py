"""Queries of the operators for training data and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.keys import open_end, source_key, ticker_key
from chronopanel.llm.abuse import abuse_rates, abuse_scores
from chronopanel.llm.linkage import common_words, phrases, soft_match, without, words_of, words_similarity
from chronopanel.llm.mixing import mix_sources
from chronopanel.llm.packing import pack_containers
from chronopanel.llm.tokens import token_counts
from chronopanel.llm.truth import best_claims, chain_groups, discover_truth
from chronopanel.operators.history import version_history
from chronopanel.session import checkpoint, table

#: Fields of a membership claim that are resolved one by one.
FIELDS = ("effective_date", "removal_date", "announcement_date", "source_reference")
#: Stems of words that say a claim was taken back, and of what turns them round.
_TAKEN_BACK = r"withdr[ae]w|retract|rescind|revok|\bvoid|annul|cancel|taken? back|took back|nullif|repudiat|disown|pulled by"
_DENIED = r"\b(not|no|never|without|neither|nor|isn't|wasn't|un)\b[^.;:]*?(withdr[ae]w|retract|rescind|revok|void|annul|cancel|taken? back|took back)|(withdr[ae]w|retract|rescind|revok|void|annul|cancel)\w*( \w+)? (another|other|a different)\b"


def withdrawn(status: Column) -> Column:
    """True where a free-text status says that the claim itself was taken back."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return s.rlike(_TAKEN_BACK) & ~s.rlike(_DENIED)


def duplicate_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of groups of two or more, with grounds of trust and blank values as null."""
    own = F.upper(F.regexp_extract(F.coalesce("source_tier", F.lit("")), r"(?i)^\s*(?:tier)?[\s\-_]*([a-z])\s*$", 1))
    named = table(spark, d, "membership_sources").select(source_key("source_name").alias("src"), F.upper(F.trim("tier")).alias("listed")).groupBy("src").agg(F.min("listed").alias("listed"))
    end = open_end("removal_date")
    claims = (
        table(spark, d, "membership_records")
        .where(F.col("effective_date").isNotNull() & (end.isNull() | (end > F.col("effective_date"))))
        .select("membership_id", ticker_key("raw_ticker").alias("ticker_key"), "index_name", "effective_date", end.alias("removal_date"), "announcement_date", F.nullif(F.trim("source_reference"), F.lit("")).alias("source_reference"), source_key("source_name").alias("src"), F.nullif(own, F.lit("")).alias("own"), "confidence", "verification_status", "ingested_at")
        .join(named, "src", "left")
    )
    tier = F.coalesce("own", "listed")
    said = F.regexp_replace(F.lower(F.coalesce("confidence", F.lit(""))), "[^a-z]", "")
    grouped = chain_groups(claims, ["ticker_key", "index_name"], "effective_date", "membership_id", 10)
    return grouped.where("group_size >= 2").select(
        "group_id",
        "membership_id",
        "src",
        *FIELDS,
        F.when(tier == "A", 3).when(tier == "B", 2).when(tier == "C", 1).otherwise(0).alias("tier_rank"),
        F.when(said == "verified", 2).when(said == "unverified", 1).otherwise(0).alias("said_rank"),
        "ingested_at",
        withdrawn(F.col("verification_status")).alias("withdrawn"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The wanted order of claims ends in a unique id, so no vote can move a row: one aggregate by that order."""
    claims = duplicate_claims(spark, d).where("not withdrawn")
    best = best_claims(claims, group="group_id", claim_id="membership_id", order=["tier_rank", "said_rank", "ingested_at", "membership_id"], fields=FIELDS)
    return best.select("group_id", "field_name", "membership_id")


def _discover(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    claims = duplicate_claims(spark, d).where("not withdrawn")
    weight = F.pow(F.lit(2.0), F.col("tier_rank")) * (1 + F.col("said_rank"))
    return discover_truth(claims, group="group_id", claim_id="membership_id", source="src", weight=weight, fields=FIELDS)


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per group by votes alone, with the support of each value."""
    v = _discover(spark, d)[0]
    wide = v.groupBy("group_id").pivot("field_name", list(FIELDS)).agg(F.first("value").alias("value"), F.round(F.first("support"), 6).alias("support"))
    return wide


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    return _discover(spark, d)[1].select(F.col("src").alias("source_key"), F.round("reliability", 6).alias("reliability"), "votes")


def _digits(c: str) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.col(c), "[^0-9]", ""), "^0+", ""), F.lit(""))


def _near(a: Column, b: Column) -> Column:
    """One edit, or two neighbours exchanged."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (F.levenshtein(a, b) == 1) | ((F.levenshtein(a, b) == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


#: Confidence from which a pair counts as one listing.
LEAST_CONFIDENCE = 0.52
#: Weight against any pair.
PRIOR = 1.0


def carried_on(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(security_id, rid) that an ISIN adds to pairs: all rows that have it, however many, with the one security it names.

    It names the security that has more than half of the support of the pairs
    which, by themselves, are matches of rows with it. Without such a pair no
    other pair of the class can be one: no value is above the greatest that a
    pair of the class has alone. Where no security has more than half, the ISIN
    is no one listing's, and each row is left to what else it says. So there is
    at most one pair a row, and the work grows with the rows.
    """
    sure = pairs.where(F.col("i_isin").isNotNull() & (F.col("support") >= LEAST_CONFIDENCE * (F.col("support") + F.col("against"))))
    by = sure.groupBy("i_isin", "security_id").agg(F.sum("support").alias("s"))
    by = by.groupBy("i_isin").agg(F.max_by("security_id", "s").alias("security_id"), F.max("s").alias("top"), F.sum("s").alias("s"))
    named = by.where("2 * top > s").select(F.col("i_isin").alias("isin"), "security_id")
    return rows.join(named, "isin").select("security_id", "rid").join(pairs.select("security_id", "rid"), ["security_id", "rid"], "left_anti")


def listing_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs with support and grounds against, and each row's class of exact copies."""
    far_past, far_future = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    sec = table(spark, d, "securities").where("security_id is not null")
    sec = sec.select("security_id", ticker_key("primary_ticker").alias("primary"), _digits("cik").alias("cik"), words_of(F.col("name")).alias("words"), F.col("name").alias("text"), F.upper(F.coalesce(F.nullif(F.regexp_extract(F.coalesce("name", F.lit("")), r"(?i)\bcl(?:ass)?\.?\s+([A-Z])\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(F.trim("primary_ticker"), r"[./\- ]([A-Za-z])$", 1), F.lit("")))).alias("cls"))
    # Tickers with the time a security bore them. What the first version was before
    # it was first seen is unknown, so that version reaches back without end.
    key = ticker_key("ticker")
    gone = F.coalesce(F.lower(F.trim("listing_status")) == "delisted", F.lit(False))
    seen = (
        table(spark, d, "ticker_history")
        .select("security_id", F.col("valid_from").alias("day"), key.alias("k"), F.lit(None).cast("timestamp").alias("at"))
        .where("k is not null")
        .unionByName(table(spark, d, "ticker_snapshots").select("security_id", F.col("snapshot_date").alias("day"), F.when(~gone, key).alias("k"), F.col("loaded_at").alias("at"), gone.alias("gone")).where("k is not null or gone").drop("gone"))
    )
    hist = version_history(seen, "security_id", "day", "k", "at").withColumn("first", F.min("valid_from").over(Window.partitionBy("security_id")))
    born = hist.select("security_id", F.col("value").alias("tick"), F.when(F.col("valid_from") == F.col("first"), far_past).otherwise(F.col("valid_from")).alias("since"), F.col("valid_to").alias("until"))
    now = sec.where("primary is not null").select("security_id", F.col("primary").alias("tick"), F.lit(None).cast("date").alias("since"), far_future.alias("until"))
    ticks = born.unionByName(now).groupBy("security_id", "tick").agg(F.collect_list(F.struct(F.coalesce("since", far_past).alias("since"), "until", F.col("since").isNull().alias("vague"))).alias("times"))
    ticks = ticks.select("security_id", "tick", F.coalesce(F.nullif(F.filter("times", lambda t: ~t["vague"]), F.array().cast("array<struct<since:date,until:date,vague:boolean>>")), F.col("times")).alias("times"))
    ticks = checkpoint(ticks)  # read for candidates and for scores

    listed = F.regexp_extract(F.coalesce("notes", F.lit("")), r"\(listing ([A-Za-z0-9.\-]+)\)", 1)
    ident = table(spark, d, "known_identifiers_seed").where("identifier_id is not null")
    ident = ident.select(
        "identifier_id",
        ticker_key("ticker").alias("tick"),
        F.nullif(ticker_key(listed), F.lit("")).alias("tick2"),
        _digits("cik").alias("cik"),
        F.nullif(F.regexp_replace(F.upper("isin"), "[^A-Z0-9]", ""), F.lit("")).alias("isin"),
        words_of(F.col("notes")).alias("words"),
        F.lower(F.trim("notes")).alias("text"),
        F.upper(F.coalesce(F.nullif(F.regexp_extract(F.trim("ticker"), r"[./\- ]([A-Za-z])$", 1), F.lit("")), F.nullif(F.regexp_extract(listed, r"[./\-]([A-Za-z])$", 1), F.lit("")))).alias("cls"),
        F.coalesce("valid_from", far_past).alias("since"),
        F.coalesce("valid_to", far_future).alias("until"),
    )
    # Exact copies are matched once; the classes are joined back at the end.
    said = ["tick", "tick2", "cik", "isin", "text", "cls", "since", "until"]
    # The key is a digest, so that a class of any size is combined before the shuffle.
    ident = checkpoint(ident.withColumn("_key", F.sha2(F.to_json(F.struct(*said)), 256)))
    copies = checkpoint(ident.join(ident.groupBy("_key").agg(F.min("identifier_id").alias("copy_of")), "_key").drop("_key"))
    rep = copies.where("identifier_id = copy_of").drop("copy_of").withColumnRenamed("identifier_id", "rid")

    # What tells one company from another is any word that few rows have.
    common = common_words(sec.select("words").unionByName(rep.select("words")), "words")
    sec = sec.withColumn("words", without(F.col("words"), common))
    rep = rep.withColumn("words", without(F.col("words"), common))

    by_tick = rep.select("rid", F.explode(F.array_compact(F.array("tick", "tick2"))).alias("tick")).distinct().join(ticks.select("security_id", "tick"), "tick").select("security_id", "rid")
    by_cik = rep.where("cik is not null").select("rid", "cik").join(sec.where("cik is not null").select("security_id", "cik"), "cik").select("security_id", "rid")
    by_word = rep.select("rid", F.explode("words").alias("w")).join(sec.select("security_id", F.explode("words").alias("w")), "w").select("security_id", "rid")
    # Names of nothing but common words are met as whole phrases, in texts that name no other company.
    by_phrase = phrases(sec.where("size(words) = 0").select("security_id", "text"), rep.where("size(words) = 0").select("rid", "text"), "text", "security_id", "rid")
    found = by_tick.unionByName(by_cik).unionByName(by_word).distinct()
    found = found.join(by_phrase.withColumn("phrase", F.lit(True)), ["security_id", "rid"], "full")
    own = ticks.groupBy("security_id").agg(F.collect_list(F.struct("tick", "times")).alias("ticks"))
    said_of = rep.select("rid", "words", *said).toDF("rid", "i_words", *[f"i_{c}" for c in said])
    mine = F.coalesce("ticks", F.array().cast(own.schema["ticks"].dataType))
    equal = lambda t: F.coalesce((t["tick"] == F.col("i_tick")) | (t["tick"] == F.col("i_tick2")), F.lit(False))
    during = lambda t: F.exists(t["times"], lambda x: (x["since"] < F.col("i_until")) & (F.col("i_since") < x["until"]))
    sim = F.when(F.col("phrase"), 1.0).otherwise(words_similarity(F.col("words"), F.col("i_words")))

    def scored(cand: DataFrame) -> DataFrame:
        p = cand.join(said_of, "rid").join(sec, "security_id").join(own, "security_id", "left")
        p = p.select(
            "security_id",
            "rid",
            "i_isin",
            F.exists(mine, lambda t: equal(t) & during(t)).alias("t_now"),
            F.exists(mine, equal).alias("t_ever"),
            F.exists(mine, lambda t: F.coalesce(_near(t["tick"], F.col("i_tick")), F.lit(False)) & during(t)).alias("t_near"),
            F.coalesce(F.col("cik") == F.col("i_cik"), F.lit(False)).alias("c_same"),
            F.coalesce(_near(F.col("cik"), F.col("i_cik")), F.lit(False)).alias("c_near"),
            F.coalesce(F.col("cik") != F.col("i_cik"), F.lit(False)).alias("c_diff"),
            sim.alias("sim"),
            F.coalesce(F.col("cls") != F.col("i_cls"), F.lit(False)).alias("k_diff"),
            (F.col("cls").isNotNull() & F.col("i_cls").isNotNull() & (F.col("cls") == F.col("i_cls"))).alias("k_same"),
        )
        yes = lambda c, w: F.when(c, w).otherwise(0.0)
        support = (
            F.when(F.col("t_now"), 2.0).when(F.col("t_near"), 0.8).when(F.col("t_ever"), 0.4).otherwise(0.0)
            + F.when(F.col("c_same"), 3.0).when(F.col("c_near"), 1.5).otherwise(0.0)
            + F.coalesce(F.when(F.col("sim") >= 0.55, 4.0 * F.col("sim")), F.lit(0.0))
            + yes(F.col("k_same"), 0.5)
        )
        against = PRIOR + yes(F.col("c_diff") & ~F.col("c_near"), 4.0) + yes(F.coalesce(F.col("sim") < 0.5, F.lit(False)), 8.0) + yes(F.col("k_diff") & ~F.col("t_now"), 12.0)
        return p.select("security_id", "rid", "i_isin", support.alias("support"), against.alias("against"))

    pairs = checkpoint(scored(found))
    carried = carried_on(pairs, rep.where("isin is not null").select("rid", "isin"))
    more = checkpoint(scored(carried.withColumn("phrase", F.lit(None).cast("boolean"))))
    # Rows that say nothing but one ISIN are one statement, like exact copies, and matched once.
    bare = more.where((F.col("support") == 0) & (F.col("against") == PRIOR)).select("rid", "i_isin").join(pairs.select("rid"), "rid", "left_anti")
    bare = checkpoint(bare.join(bare.groupBy("i_isin").agg(F.min("rid").alias("first")), "i_isin").select("rid", "first"))
    # One that speaks against the security and in nothing for it is not drawn along and draws nothing down.
    alike = F.when((F.col("support") > 0) | (F.col("against") == PRIOR), F.col("i_isin"))
    more = more.join(bare.where("rid <> first"), "rid", "left_anti").withColumn("i_isin", alike).select(*pairs.columns)
    copies = copies.join(bare.withColumnRenamed("rid", "copy_of"), "copy_of", "left").select("identifier_id", F.coalesce("first", "copy_of").alias("copy_of"))
    return pairs.unionByName(more), copies


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair with its confidence."""
    pairs, copies = listing_pairs(spark, d)
    scored = soft_match(pairs, "security_id", "rid", "support", "against", "i_isin")
    return scored.join(copies, scored.rid == copies.copy_of).select("security_id", "identifier_id", F.round("confidence", 6).alias("confidence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).where(F.col("confidence") >= LEAST_CONFIDENCE).select("security_id", "identifier_id")


def clean_source(c: str = "source") -> Column:
    """A document's source in lower case with one underscore between words."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_"), F.lit(""))


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return token_counts(docs.withColumn("source", clean_source()), "text", ["doc_id", "source"])


def capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """The container sizes: a fixed table of a few rows."""
    return {r["container_name"]: int(r["capacity_tokens"]) for r in table(spark, d, "container_sizes").dropna().collect()}


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_containers(document_sizes(spark, d), capacities(spark, d), item="doc_id", size="tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, by best fit alone and at least, and how full they are."""
    caps = capacities(spark, d)
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])[F.col("container_name")]
    out = checkpoint(pack_containers(document_sizes(spark, d), caps, item="doc_id", size="tokens", with_start=True))
    fit = out.groupBy("container_name", "shard").agg(F.max("best_fit").alias("n")).groupBy("container_name").agg(F.sum("n").alias("best_fit_containers"))
    return (
        out.groupBy("container_name", "container_id")
        .agg(F.sum("tokens").alias("fill"))
        .groupBy("container_name")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
        .join(fit, "container_name")
        .select("container_name", "containers", "best_fit_containers", "tokens", "fullest", F.ceil(F.col("tokens") / cap).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("share_filled"))
    )


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(document_sizes(spark, d), table(spark, d, "mix_targets").withColumn("source", clean_source()), doc="doc_id", source="source", size="tokens", mix="mix_name", share="target_share", repeats="max_repeats")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents").withColumn("source", clean_source()), "text", ["doc_id", "source"])


#: The score of one plain case.
LEAST_SCORE = 0.5


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("score") >= LEAST_SCORE).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(p10_scores(spark, d), "source", LEAST_SCORE)


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p1_sources": p1_sources, "p5_found": p5_found, "p5_matches": p5_matches, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}

SQL = {
    "p1_found": r"""
with c as (
  select m.membership_id, nullif(regexp_replace(upper(m.raw_ticker), '[^A-Z0-9]', '', 'g'), '') as k, m.index_name, m.effective_date,
    case when m.removal_date < date '9999-12-31' then m.removal_date end as removal_date, m.announcement_date, nullif(trim(m.source_reference), '') as source_reference,
    coalesce(nullif(regexp_extract(upper(trim(coalesce(m.source_tier, ''))), '^(?:TIER)?[ _-]*([A-Z])$', 1), ''), s.tier) as tier,
    regexp_replace(lower(coalesce(m.confidence, '')), '[^a-z]', '', 'g') as conf, m.ingested_at,
    lower(coalesce(m.verification_status, '')) as st
  from membership_records m left join membership_sources s on regexp_replace(lower(m.source_name), '\s+', '', 'g') = regexp_replace(lower(s.source_name), '\s+', '', 'g')
  where m.effective_date is not null and (m.removal_date is null or m.removal_date > m.effective_date)
), n as (
  select *, case when effective_date - lag(effective_date) over (partition by k, index_name order by effective_date, membership_id) <= 10 then 0 else 1 end as fresh from c where k is not null and index_name is not null
), g as (select *, sum(fresh) over (partition by k, index_name order by effective_date, membership_id rows unbounded preceding) as chain from n),
h as (select *, min(membership_id) over (partition by k, index_name, chain) as group_id, count(*) over (partition by k, index_name, chain) as size from g),
v as (
  select * from h where size >= 2 and not (regexp_matches(st, 'withdrawn|retracted|rescinded|taken back|void') and not regexp_matches(st, '\bnot withdrawn|no retract'))
), f as (
  select *, unnest(['effective_date', 'removal_date', 'announcement_date', 'source_reference']) as field_name,
    unnest([effective_date::varchar, removal_date::varchar, announcement_date::varchar, source_reference]) as value from v
)
select group_id, field_name, membership_id from f where value is not null
qualify row_number() over (partition by group_id, field_name order by case tier when 'A' then 3 when 'B' then 2 when 'C' then 1 else 0 end desc,
  case conf when 'verified' then 2 when 'unverified' then 1 else 0 end desc, ingested_at desc nulls last, membership_id desc) = 1""",
}
