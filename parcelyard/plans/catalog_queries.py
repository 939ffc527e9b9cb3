"""Catalogs and participants over the driver's tables: orders as recordings with file names, customers as participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import catalog
from .views import table

REC = """rec as (select o_orderkey as id, 'S' || o_custkey as subject, 'T' || (1 + year(o_orderdate) % 3) as session,
  'sub-S' || o_custkey || '_ses-T' || (1 + year(o_orderdate) % 3) || '_acq-' || lower(substr(o_orderpriority, 3, 3)) || '_run-0' || (o_orderkey % 3) || '_space-orig_atlas-chimera' || o_orderstatus || '_desc-scale' || (1 + o_orderkey % 3) || 'grow2mm_dseg.nii.gz' as name from orders)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    session = F.concat(F.lit("T"), (1 + F.year("o_orderdate") % 3).cast("string"))
    subject = F.concat(F.lit("S"), F.col("o_custkey").cast("string"))
    name = F.concat(
        F.lit("sub-"), subject, F.lit("_ses-"), session, F.lit("_acq-"), F.lower(F.substring("o_orderpriority", 3, 3)), F.lit("_run-0"), (F.col("o_orderkey") % 3).cast("string"),
        F.lit("_space-orig_atlas-chimera"), F.col("o_orderstatus"), F.lit("_desc-scale"), (1 + F.col("o_orderkey") % 3).cast("string"), F.lit("grow2mm_dseg.nii.gz"),
    )
    return o.select(F.col("o_orderkey").alias("id"), subject.alias("subject"), session.alias("session"), name.alias("name"))


TAGGED = "tg as (select id, case when id % 4 = 0 then 'x/sub-a/' else '' end || replace(name, '_dseg', case id % 3 when 0 then '_npert-' || (id % 50) || '_filtbiharmonic' when 1 then '_met-Ins_res-5mm' else '' end || '_dseg') as name, regexp_extract(name, '[^/]*$') as base from rec)"
NUMBER_TAGS = ("scale", "grow", "npert")


def _tag_sql(name: str) -> str:
    found = f"nullif(regexp_extract(regexp_extract(name, '[^/]*$'), '{catalog.TAGS[name]}', 1), '')"
    return f"try_cast({found} as int) as {name}" if name in NUMBER_TAGS else f'{found} as "{name}"'


@query(REC, TAGGED, sql="select id, " + ", ".join(map(_tag_sql, catalog.TAGS)) + " from tg")
def bids_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    extra = F.when(k % 3 == 0, F.concat(F.lit("_npert-"), (k % 50).cast("string"), F.lit("_filtbiharmonic"))).when(k % 3 == 1, "_met-Ins_res-5mm").otherwise("")
    name = F.concat(F.when(k % 4 == 0, "x/sub-a/").otherwise(""), F.replace("name", F.lit("_dseg"), F.concat(extra, F.lit("_dseg"))))
    return catalog.with_tags(recordings(spark, sf_dir).select("id", name.alias("name")), "name").drop("name")


@query(
    REC,
    sql="""select id, 'sub-' || subject || '/ses-' || v || '/mrsi/sub-' || subject || '_ses-' || v || '_space-orig_met-' || met || '_desc-signal_mrsi.nii.gz' as path
  from (select id, subject, regexp_replace(upper(session), '^T([0-9]+)', 'V\\1') as v, case id % 3 when 0 then 'GluGln' when 1 then 'NAANAAG' else 'Ins' end as met from rec)""",
)
def canonical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = catalog.metabolite(F.when(F.col("id") % 3 == 0, "Glx").when(F.col("id") % 3 == 1, "tNAA").otherwise("Ins"))
    return recordings(spark, sf_dir).select("id", catalog.canonical_path(F.col("subject"), catalog.session_token(F.col("session")), F.lit("orig"), met, F.lit("signal")).alias("path"))


@query(
    REC,
    "s as (select subject, session, name, contains(name, 'acq-urg')::int + contains(name, 'run-01')::int + contains(name, 'chimeraF')::int as score from rec)",
    sql="select subject, session, name, score from (select *, row_number() over (partition by subject, session order by score desc, lower(name), name) as n from s) where n = 1 and score > 0",
)
def best_match_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [F.col("name").contains(t) for t in ("acq-urg", "run-01", "chimeraF")]
    return catalog.best_match(recordings(spark, sf_dir).select("subject", "session", "name"), ["subject", "session"], "name", terms)


@query(REC, sql="select subject, session, min(id) as ord from rec group by all")
def pairs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = recordings(spark, sf_dir).withColumn("subject", F.concat(F.lit(" "), F.col("subject"), F.lit(" ")))
    return catalog.pairs(padded, "subject", "session", "id")


FILES = """files as (select n_nationkey as id, case n_nationkey % 5 when 0 then 'OrigRes_' || n_name || '+NAAG_conc_x.nii' when 1 then 'mwp1' || lower(n_name) || '.nii' when 2 then n_name || '_memprage_T1w.nii.gz' when 3 then n_name || '_Glx_crlb_y.nii' else n_name || '_mprage_mask.nii' end as name from nation)"""


@query(
    FILES,
    "k as (select id, name, case when regexp_matches(lower(name), '^(m?w?p[0-3]|wm|iy_|y_)[a-z0-9_]*') and regexp_matches(lower(name), '[.]nii([.]gz)?$') and not contains(lower(name), 'mrsi') then 'cat12' when regexp_matches(lower(name), '(_conc_|_crlb_|_snr|_fwhm|mrsi)') then 'mrsi' when regexp_matches(lower(name), '(t1w|mprage|mp2rage|memprage)') and not regexp_matches(lower(name), '(mask|seg|dseg)') then 't1' end as kind from files)",
    sql="select id, kind, case when kind = 'mrsi' then nullif(replace(regexp_extract(name, '(?i)_([A-Za-z0-9+]+)_(conc|crlb)_', 1), '+', ''), '') end as met, case when kind = 'mrsi' then case when lower(regexp_extract(name, '(?i)_[A-Za-z0-9+]+_(conc|crlb)_', 1)) = 'conc' then 'signal' else nullif(lower(regexp_extract(name, '(?i)_[A-Za-z0-9+]+_(conc|crlb)_', 1)), '') end end as desc from k",
)
def classify_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey") % 5
    name = F.when(k == 0, F.concat(F.lit("OrigRes_"), n, F.lit("+NAAG_conc_x.nii"))).when(k == 1, F.concat(F.lit("mwp1"), F.lower(n), F.lit(".nii"))).when(k == 2, F.concat(n, F.lit("_memprage_T1w.nii.gz"))).when(k == 3, F.concat(n, F.lit("_Glx_crlb_y.nii"))).otherwise(F.concat(n, F.lit("_mprage_mask.nii")))
    return catalog.classified(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), name.alias("name")), "name").select("id", "kind", "met", "desc")


@query(
    REC,
    "r as (select subject, session, m.met, bool_or(id % 4 = m.k) as ok from rec, (values ('CrPCr', 0), ('GluGln', 1), ('Ins', 2)) m(met, k) group by all)",
    sql="select subject, session, count(*) filter (ok) as found, count(*) as expected, coalesce(string_agg(met, ',' order by met) filter (not ok), '') as missing from r group by all",
)
def preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mets = F.explode(F.array(*(F.struct(F.lit(m).alias("met"), F.lit(k).alias("k")) for k, m in enumerate(("CrPCr", "GluGln", "Ins"))))).alias("m")
    needs = recordings(spark, sf_dir).select("subject", "session", "id", mets).groupBy("subject", "session", "m.met").agg(F.bool_or(F.col("id") % 4 == F.col("m.k")).alias("ok"))
    return catalog.availability(needs, ["subject", "session"], "met", "ok")


@query(sql="select c_custkey as key, c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 1000 and c_nationkey <> 3 as selected from customer")
def participant_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    test = catalog.predicate(["C_MKTSEGMENT,BUILDING", "c_mktsegment,==MACHINERY", "c_acctbal,>=1000", "c_nationkey,!=3"], c.columns, catalog.numeric_columns(c))
    return c.select(F.col("c_custkey").alias("key"), test.alias("selected"))


@query(REC, sql="select id, (subject, session) in (select (subject, session) from rec where id % 50 = 0) as selected from rec")
def pair_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recordings(spark, sf_dir)
    return catalog.pair_mask(r, r.where("id % 50 = 0"), ["subject", "session"]).select("id", "selected")


@query(sql="select p_partkey as id, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda m: regexp_replace(lower(m), '[^a-z0-9]+', '', 'g')), lambda m: m <> ''), '_') as suffix from part")
def connectivity_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), catalog.suffix_of(F.split("p_name", " ")).alias("suffix"))


@query(sql="select p_partkey as id, case when m < 1 then lpad(round_even(m * 10, 0)::int::varchar, 2, '0') else round_even(m, 0)::int::varchar end as res from (select p_partkey, (p_size / 10.0::double + p_size / 20.0::double + p_size / 40.0::double) / 3 as m from part)")
def resolution_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), catalog.resolution(F.array(size / F.lit(10.0), size / F.lit(20.0), size / F.lit(40.0))).alias("res"))


@query(sql="select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def detection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(FILES, sql="select name as source, 'out/' || regexp_replace(name, '[.]nii$', '.nii.gz') as target, case when id % 7 = 0 then 'skip' when name like '%.nii' then 'convert' else 'copy' end as action from files")
def migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey") % 5
    name = F.when(k == 0, F.concat(F.lit("OrigRes_"), n, F.lit("+NAAG_conc_x.nii"))).when(k == 1, F.concat(F.lit("mwp1"), F.lower(n), F.lit(".nii"))).when(k == 2, F.concat(n, F.lit("_memprage_T1w.nii.gz"))).when(k == 3, F.concat(n, F.lit("_Glx_crlb_y.nii"))).otherwise(F.concat(n, F.lit("_mprage_mask.nii")))
    files = table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name")).withColumn("target", F.concat(F.lit("out/"), F.regexp_replace("name", "[.]nii$", ".nii.gz")))
    return catalog.migration_plan(files, "name", "target", files.where("n_nationkey % 7 = 0").select(F.col("target").alias("path")))


@query(sql="select page_id, contains(lower(url), 'page=2') as has_text, regexp_matches(url, '/(fr|de)/[0-9]+') as has_pattern, not (contains(url, 'ref=x') or contains(url, '/es/')) as kept from pages")
def text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", catalog.text_search(url, "PAGE=2").alias("has_text"), catalog.text_search(url, "re:/(fr|de)/[0-9]+").alias("has_pattern"), catalog.without_terms(url, ["ref=x", "/es/"]).alias("kept"))


@query(sql="select p_partkey as id, replace(replace(substr('ctx-lh-' || p_brand, 1, 9), '-lh', ''), '-rh', '') as region from part")
def super_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), catalog.super_region(F.concat(F.lit("ctx-lh-"), F.col("p_brand"))).alias("region"))


@query(sql="select o_orderpriority as role, count(*) as n from orders group by all")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(F.count("*").alias("n"))
