"""File and path operators over a listing made of the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions.lineage import cut
from ..functions.numbering import numbered
from ..operators import catalog, files
from .views import table

# Names of the kinds that scans meet; {c}: subject, {s}: session number, {r}: run.
SHAPES = [
    "raw/sub-S{c}/ses-T{s}/anat/sub-S{c}_ses-T{s}_acq-mprage_run-0{r}_T1w.nii.gz",
    "raw/Results_S{c}_T{s}/MRSI_NIFTI/OrigRes_NAA+NAAG_conc_map.nii",
    "raw/S{c}_V{s}/mri/p1_x.nii",
    "in/p1{c}_T{s}_t1_brain.nii",
    "in/p2S{c}_V{s}_T1w.nii.gz",
    "in/mwp1_sub-S{c}_ses-V{s}_acq-x_T1w.nii.gz",
    "raw/derivatives/skull/sub-S{c}_ses-V{s}_acq-mprage_run-0{r}_desc-brain_T1w.nii.gz",
    "raw/S{c}-T{s}/OrigRes_SNR.nii",
    "raw/S{c}_T{s}/MRSI_NIFTI/OrigRes_Ins_metabnorm_x.nii",
    "misc/S{c}/notes.txt",
    "misc/MP2RAGE/T1_mp2rage_{c}.nii",
    "raw/Results_S{c}/MRSI_NIFTI/OrigRes_Cr+PCr_crlb_{s}.nii.gz",
    "raw/sub-S{c}/ses-T{s}/anat/sub-S{c}_ses-T{s}_acq-mp2rage_run-0{r}_T1w.nii.gz",
]


def _sql_shape(shape: str) -> str:
    text = "'" + shape.replace("'", "''") + "'"
    return "replace(replace(replace(" + text + ", '{c}', o_custkey::varchar), '{s}', (1 + year(o_orderdate) % 3)::varchar), '{r}', (1 + o_orderkey % 3)::varchar)"


PATHS = f"paths as (select o_orderkey as id, o_custkey as c, 1 + year(o_orderdate) % 3 as s, case o_orderkey % {len(SHAPES)} " + " ".join(f"when {k} then {_sql_shape(x)}" for k, x in enumerate(SHAPES)) + " end as path from orders), pn as (select *, regexp_extract(path, '[^/]*$') as name, list_reverse(string_split(path, '/')[:-2]) as above from paths)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c, s, r = F.col("o_custkey").cast("string"), (1 + F.year("o_orderdate") % 3).cast("string"), (1 + F.col("o_orderkey") % 3).cast("string")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("o_orderkey") % len(SHAPES) + 1).cast("int"))
    path = F.replace(F.replace(F.replace(shape, F.lit("{c}"), c), F.lit("{s}"), s), F.lit("{r}"), r)
    # Behind an explode of one element the path is built once, however often filters and columns name it.
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), s.alias("s"), F.explode(F.array(path)).alias("path"))


NIFTI = "regexp_matches(lower(path), '[.]nii([.]gz)?$')"


@query(PATHS, sql=f"select path, count(*) as n, min(id) as id from paths where {NIFTI} and not list_contains(above, 'derivatives') and not contains(lower(path), 'metabnorm') and not contains(lower(path), 'mp2rage') group by path".replace("from paths where", "from pn where"))
def collected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    kept = files.collected(p.select("path", F.col("path").alias("real")), "path", "real", ["metabnorm", "mp2rage"])
    return p.join(kept, "path").groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("id"))


@query(sql="select page_id, list_filter(list_transform(regexp_split_to_array(lower(url), '[\\n,;?&]+'), lambda t: trim(t)), lambda t: t <> '')[2] as first_term, len(regexp_split_to_array(lower(url), '[?&]')) as n from pages where url is not null")
def ignore_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "[?&]", ";")
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.get(files.ignore_terms(url), F.lit(1)).alias("first_term"), F.size(F.split(F.lower("url"), "[?&]")).alias("n"))


@query(PATHS, sql="select id, regexp_extract(path, '[^/]*$') as name from pn where contains(name, '_T1w') and regexp_matches(lower(path), '[.]nii([.]gz)?$') and not list_contains(string_split(path, '/'), 'derivatives')")
def t1_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.t1_files(paths(spark, sf_dir), "path").select("id", files.base(F.col("path")).alias("name"))


@query(PATHS, "want as (select distinct 'S' || c as subject, 'T' || s as session from paths)", sql="select subject, session, min(path) as path from want join pn on contains(name, 'sub-' || subject || '_ses-' || session || '_') and contains(name, 'acq-mprage') and contains(name, '.nii') group by all")
def first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    want = p.select(F.concat(F.lit("S"), "c").alias("subject"), F.concat(F.lit("T"), "s").alias("session")).distinct()
    return files.first_match(p, "path", want, "subject", "session", "acq-mprage")


@query(
    sql="""select o_orderkey as id, 'sub-S' || c || '/ses-V1/anat/sub-S' || c || '_ses-V1' || case when k % 4 = 3 then '_space-orig_atlas-cubic' || sc || 'mm_dseg.nii.gz' else
  case when k % 3 = 0 then '' else '_run-01' end || case when k % 5 = 0 then '' else '_acq-memprage' end || '_space-' || case when k % 2 = 0 then 'orig' else 'mni' end || '_atlas-chimeraLFMIHIFIS_desc-scale' || sc || case when k % 7 = 0 then '' else 'grow2mm' end || '_dseg.nii.gz' end as path
  from (select o_orderkey, o_orderkey as k, o_custkey as c, 1 + o_orderkey % 3 as sc from orders)""".replace("'_space-orig_atlas-cubic'", "'_space-' || case when k % 2 = 0 then 'orig' else 'mni' end || '_atlas-cubic'")
)
def parcel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, null = F.col("o_orderkey"), F.lit(None).cast("string")
    path = files.parcel_path(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")), F.lit("V1"), F.when(k % 2 == 0, "T1w").otherwise("mni"), F.when(k % 4 == 3, "cubic").otherwise("LFMIHIFIS"),
        1 + k % 3, F.when(k % 5 == 0, null).otherwise("memprage"), F.when(k % 3 == 0, null).otherwise("01"), F.when(k % 7 == 0, F.lit(None).cast("int")).otherwise(2),
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), path.alias("path"))


TRANSFORMS = """tr(direction, space, n, file) as (values ('forward', 'mrsi', 0, 'ses-V1/mrsi/sub-X_ses-V1_desc-mrsi_to_t1w.syn.nii.gz'), ('forward', 'mrsi', 1, 'ses-V1/mrsi/sub-X_ses-V1_desc-mrsi_to_t1w.affine.mat'),
  ('inverse', 'mrsi', 0, 'ses-V1/mrsi/sub-X_ses-V1_desc-mrsi_to_t1w.affine_inv.mat'), ('inverse', 'mrsi', 1, 'ses-V1/mrsi/sub-X_ses-V1_desc-mrsi_to_t1w.syn_inv.nii.gz'),
  ('forward', 'anat', 0, 'ses-V1/anat/sub-X_ses-V1_desc-t1w_to_mni.syn.nii.gz'), ('forward', 'anat', 1, 'ses-V1/anat/sub-X_ses-V1_desc-t1w_to_mni.affine.mat'),
  ('inverse', 'anat', 0, 'ses-V1/anat/sub-X_ses-V1_desc-t1w_to_mni.affine_inv.mat'), ('inverse', 'anat', 1, 'ses-V1/anat/sub-X_ses-V1_desc-t1w_to_mni.syn_inv.nii.gz'),
  ('forward', 'template', 0, 'ses-V1/anat/sub-X_ses-V1_desc-t1w_to_template.syn.nii.gz'), ('forward', 'template', 1, 'ses-V1/anat/sub-X_ses-V1_desc-t1w_to_template.affine.mat'),
  ('inverse', 'template', 0, 'ses-V1/anat/sub-X_ses-V1_desc-t1w_to_template.syn_inv.nii.gz'),
  ('forward', 'ses-all', 0, 'ses-all/anat/sub-X_ses-all_desc-template_to_mni.syn.nii.gz'), ('forward', 'ses-all', 1, 'ses-all/anat/sub-X_ses-all_desc-template_to_mni.affine.mat'),
  ('inverse', 'ses-all', 0, 'ses-all/anat/sub-X_ses-all_desc-template_to_mni.syn_inv.nii.gz'))"""


@query(TRANSFORMS, sql="select o_orderkey as id, n, 'sub-S' || o_custkey || '/' || replace(file, 'sub-X', 'sub-S' || o_custkey) as file from orders join tr on direction = case when o_orderkey % 2 = 0 then 'forward' else 'inverse' end and space = case o_orderkey % 5 when 0 then 'mrsi' when 1 then 'anat' when 2 then 'template' when 3 then 'ses-all' end")
def transform_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    space = F.element_at(F.array(*map(F.lit, ("MRSI", "anat", "t1-template", "ses-all", "elsewhere"))), (k % 5 + 1).cast("int"))
    subject = F.concat(F.lit("S"), F.col("o_custkey").cast("string"))
    listed = files.transforms(subject, F.lit("V1"), F.when(k % 2 == 0, "Forward").otherwise("inverse"), space)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.posexplode(listed).alias("n", "file"))


STEM = "select id, case when name like '%.nii.gz' then left(name, length(name) - 7) else regexp_replace(name, '(.)[.][^./]*$', '\\1') end as s, name from pn"


@query(
    PATHS,
    f"st as ({STEM}), e as (select *, substr(name, length(s) + 1) as ext from st)",
    sql="select id, case when contains(s, '_desc-brain_') then replace(s, '_desc-brain_', '_desc-brainCSF_') when contains(s, '_T1w') then replace(s, '_T1w', '_desc-brainCSF_T1w') else s || '_desc-brainCSF' end || ext as image, case when contains(s, '_desc-brain_') then replace(s, '_desc-brain_', '_desc-brainCSFmask_') when contains(s, '_T1w') then replace(s, '_T1w', '_desc-brainCSFmask_T1w') else s || '_desc-brainCSFmask' end || ext as mask from e",
)
def brain_csf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.brain_csf_names(files.base(F.col("path"))).alias("n")).select("id", "n.image", "n.mask")


@query(
    sql="select o_orderkey as id, case when o_orderkey % 3 = 0 and o_orderkey % 5 <> 0 then '/d/derivatives/mine/x/sub-' || o_custkey || '.nii' when o_orderkey % 3 = 0 then '/d/derivatives/mrsi-orig/sub-' || o_custkey || '.nii' when o_orderkey % 3 = 1 then '/d/derivatives/cat12/sub-' || o_custkey || '.nii' else '/elsewhere/mrsi-orig/' || o_custkey end as path from orders".replace("mine/x/sub-", "mine/sub-")
)
def derivative_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("/d/derivatives/mrsi-orig/sub-"), c, F.lit(".nii"))).when(k % 3 == 1, F.concat(F.lit("/d/derivatives/cat12/sub-"), c, F.lit(".nii"))).otherwise(F.concat(F.lit("/elsewhere/mrsi-orig/"), c))
    return table(spark, sf_dir, "orders").select(k.alias("id"), files.in_derivative(path, F.lit("/d"), F.when(k % 5 == 0, "../up").otherwise("/mine/")).alias("path"))


@query(sql="select p_partkey as id, case when p_size % 3 = 0 then 'biharmonic_pvcorr' || case when p_size % 2 = 0 then '' else '_GM' end end as preproc from part")
def preproc_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), files.preproc(F.when(size % 3 == 0, "signal").when(size % 3 == 1, "crlb").otherwise("snr"), F.lit("biharmonic"), F.when(size % 2 == 1, "GM")).alias("preproc"))


@query(
    """m as (select r_name as met, r_regionkey as o from region), l as (select 0 as part, o, 0 as k, met, 'signal' as "desc", 'bh' as filt from m union all select 0, o, 1, met, 'crlb', null from m union all select 1, 0, k, met, d, null from (values (0, 'water', 'signal'), (1, null, 'snr'), (2, null, 'fwhm'), (3, null, 'brainmask')) v(k, met, d))""",
    sql='select row_number() over (order by part, o, k) - 1 as n, met, "desc", filt from l',
)
def signal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.signal_list(table(spark, sf_dir, "region"), "r_name", "r_regionkey", "bh")


@query(PATHS, sql="select id, case when contains(lower(name), 'mp2rage') then 'mp2rage' when contains(lower(name), 'mprage') then 'mprage' else 'unknown' end as acq from pn")
def acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.acquisition(files.base(F.col("path"))).alias("acq"))


@query(
    PATHS,
    "t as (select id, coalesce(nullif(regexp_extract(name, 'sub-([^_]+)', 1), ''), 'unknown') as sub, nullif(regexp_extract(name, 'ses-([^_]+)', 1), '') as ses0, nullif(regexp_extract(name, 'acq-([^_]+)', 1), '') as acq from pn), u as (select *, case when upper(left(ses0, 1)) = 'V' then ses0 else 'V' || ses0 end as ses from t)",
    sql="select id, concat_ws('/', 'derivatives/skullstrip', 'sub-' || sub, 'ses-' || ses) || '/' || concat_ws('_', 'sub-' || sub, 'ses-' || ses, 'acq-' || acq) || '_desc-brainmask_T1w.nii.gz' as mask from u",
)
def skull_strip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.skull_strip_names(F.col("path"))["brainmask"].alias("mask"))


WANTED = "(" + " or ".join([f"contains(name, '_{m}_')" for m in files.METABOLITE_FILES] + [f"contains(name, '_{o}.')" for o in files.OTHER_FILES]) + ")"


@query(PATHS, sql=f"select id, {WANTED} as wanted from pn")
def wanted_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.wanted_map(files.base(F.col("path"))).alias("wanted"))


MAPS = """mp0 as (select id, name, lower(name) as low, list_filter(string_split(regexp_replace(regexp_replace(name, '[.]nii[.]gz$', ''), '^OrigRes_', ''), '_'), lambda p: p <> '') as parts from pn),
  mp1 as (select *, lower(parts[2]) as second, lower(array_to_string(parts[2:], '_')) as tail from mp0), qu as (select map {'conc': 'signal', 'crlb': 'crlb', 'snr': 'snr', 'fwhm': 'fwhm'} as q),
  mp2 as (select *, case when len(parts) = 1 then lower(parts[1]) when q[second] is not null then second else tail end as key, trim(replace(parts[1], '+', '')) as m from mp1, qu),
  mp as (select id, case when regexp_matches(low, 'brain_?mask') then null when contains(low, 'watersignal') then 'water' when q[key] is not null and len(parts) > 1 and m <> '' and lower(m) <> 'voxel' then m end as met,
    case when regexp_matches(low, 'brain_?mask') then 'brainmask' when contains(low, 'watersignal') then 'signal' else q[key] end as "desc",
    case when regexp_matches(low, 'brain_?mask') or contains(low, 'watersignal') then null when len(parts) = 0 then 'format' when q[key] is null and contains(key, 'metabnorm') then 'metabnorm' when q[key] is null then 'quantity' end as problem from mp2)"""


@query(PATHS, MAPS, sql='select id, met, "desc", problem from mp')
def map_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.map_name(files.base(F.col("path"))).alias("m")).select("id", "m.*")


@query(PATHS, "x as (select id, regexp_replace(string_split(path, '/')[2], '^Results_', '') as f from paths), y as (select id, nullif(regexp_extract(f, '^(.+?)[_-]([TtVv][0-9]+)$', 1), '') as sub, nullif(regexp_extract(f, '^(.+?)[_-]([TtVv][0-9]+)$', 2), '') as session from x)", sql="select id, case when session is not null then sub end as sub, session, 'V' || substr(session, 2) as new_session from y")
def session_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.session_folder(F.get(F.split("path", "/"), F.lit(1))).alias("s")).select("id", "s.sub", "s.session", "s.new_session")


SESSION = "case when upper(left({0}, 1)) in ('V', 'T') then 'V' || substr({0}, 2) else {0} end"
CAT = (
    """fg0 as (select *, list_filter(list_prepend(name, above), lambda c: regexp_matches(c, '(?i)sub-([^_]+).*ses-([^_]+)')) as bids, list_filter(above, lambda c: regexp_matches(regexp_replace(c, '^Results_', ''), '^(.+?)[_-]([TtVv][0-9]+)$') or (starts_with(c, 'Results_') and c <> 'Results_')) as fold,
    list_filter(list_transform(list_prepend(name, list_prepend(regexp_replace(name, '(.)[.][^.]*$', '\\1'), above)), lambda c: regexp_replace(c, '^Results_', '')), lambda c: regexp_matches(c, '([A-Za-z0-9]+)[_-]([TtVv][0-9]+)')) as loose from pn),
  fg1 as (select *, regexp_replace(fold[1], '^Results_', '') as own from fg0),
  fg as (select *, case when len(bids) > 0 then regexp_extract(bids[1], '(?i)sub-([^_]+).*ses-([^_]+)', 1) when len(fold) > 0 then case when regexp_matches(own, '^(.+?)[_-]([TtVv][0-9]+)$') then regexp_extract(own, '^(.+?)[_-]([TtVv][0-9]+)$', 1) else own end when len(loose) > 0 then regexp_extract(loose[1], '([A-Za-z0-9]+)[_-]([TtVv][0-9]+)', 1) else '' end as fsub,
    case when len(bids) > 0 then regexp_extract(bids[1], '(?i)sub-([^_]+).*ses-([^_]+)', 2) when len(fold) > 0 then regexp_extract(own, '^(.+?)[_-]([TtVv][0-9]+)$', 2) when len(loose) > 0 then regexp_extract(loose[1], '([A-Za-z0-9]+)[_-]([TtVv][0-9]+)', 2) else '' end as fses from fg1),
  nm as (select *, case """
    + " ".join(f"when regexp_matches(name, '{p}') then struct_pack(\"desc\" := lower(regexp_extract(name, '{p}', 1)), sub := regexp_extract(name, '{p}', 2), ses := upper(regexp_extract(name, '{p}', 3)), ext := regexp_extract(name, '{p}', {e}), acq := " + (f"nullif(regexp_extract(name, '{p}', 4), '')" if e == 5 else "null::varchar") + ")" for p, e in files.CAT12_NAMES.values())
    + """ end as named, regexp_matches(name, '(?i)^(p[0-9]+)_') as allowed, list_contains(string_split(lower(path), '/'), 'mri') as inside from fg),
  ct as (select *, case when named is not null then case when not inside or allowed then named end when allowed and inside then struct_pack("desc" := lower(regexp_extract(name, '(?i)^(p[0-9]+)_', 1)), sub := fsub, ses := fses, ext := case when name like '%.nii.gz' then '.nii.gz' else regexp_extract(name, '[.][^.]*$') end, acq := null::varchar) end as cs from nm)"""
)


@query(PATHS, CAT, sql="select id, ct.cs['desc'] as \"desc\", ct.cs.sub as sub, " + SESSION.format("ct.cs.ses") + " as ses, ct.cs.ext as ext, ct.cs.acq as acq from ct where ct.cs is not null")
def cat12_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.cat12(F.col("path")).alias("c")).where("c is not null").select("id", "c.*")


GUESS = (
    """g0 as (select *, nullif(regexp_extract(name, 'sub-([^_]+)', 1), '') as ns, nullif(regexp_extract(name, 'ses-([^_]+)', 1), '') as ne, list_filter(range(1, len(above) + 1), lambda k: regexp_matches(above[k], '(?i)sub-([^_]+).*ses-([^_]+)') or regexp_matches(regexp_replace(above[k], '^Results_', ''), '^(.+?)[_-]([TtVv][0-9]+)$'))[1] as stop from pn),
  g1 as (select *, coalesce(stop, len(above) + 1) as st, regexp_replace(above[stop], '^Results_', '') as plain from g0),
  g2 as (select *, case when ns is null then list_filter(above[1:st - 1], lambda c: starts_with(c, 'Results_') and c <> 'Results_')[1] end as res from g1),
  g3 as (select *, case when ns is null or ne is null then coalesce(ns, regexp_replace(res, '^Results_', ''), case when regexp_matches(above[stop], '(?i)sub-([^_]+).*ses-([^_]+)') then regexp_extract(above[stop], '(?i)sub-([^_]+).*ses-([^_]+)', 1) else nullif(regexp_extract(plain, '^(.+?)[_-]([TtVv][0-9]+)$', 1), '') end) else ns end as s1,
    case when ns is null or ne is null then coalesce(ne, case when regexp_matches(above[stop], '(?i)sub-([^_]+).*ses-([^_]+)') then regexp_extract(above[stop], '(?i)sub-([^_]+).*ses-([^_]+)', 2) else nullif(regexp_extract(plain, '^(.+?)[_-]([TtVv][0-9]+)$', 2), '') end) else ne end as e1,
    list_filter([regexp_replace(name, '(.)[.][^.]*$', '\\1'), name], lambda c: regexp_matches(c, '([A-Za-z0-9]+)[_-]([TtVv][0-9]+)'))[1] as txt from g2),
  gs as (select *, coalesce(s1, nullif(regexp_extract(txt, '([A-Za-z0-9]+)[_-]([TtVv][0-9]+)', 1), ''), '') as subject, coalesce(e1, nullif(regexp_extract(txt, '([A-Za-z0-9]+)[_-]([TtVv][0-9]+)', 2), ''), '') as e2 from g3)"""
)


@query(PATHS, GUESS, sql="select id, subject, " + SESSION.format("e2") + " as session from gs")
def guessed_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", files.guess(F.col("path")).alias("g")).select("id", "g.subject", "g.session")


def _tokens(names: list[str], column: str) -> str:
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in names) + ")"


KINDS = f"""kd as (select *, {NIFTI} and list_contains(string_split(lower(path), '/'), 'mri') and regexp_matches(name, '(?i)^((?:mwp|wp|p)[0-9]+)') as is_cat12, {NIFTI} and (contains(lower(name), 'origres') or list_contains(string_split(upper(path), '/'), 'MRSI_NIFTI')) as is_map, {NIFTI} as is_nifti from pn),
  kinds as (select *, is_nifti and not is_cat12 and not {_tokens(files.NOT_T1_TOKENS, "lower(name)")} and {_tokens(files.T1_TOKENS, "lower(name)")} as is_t1 from kd)"""


@query(PATHS, KINDS, sql="select id, is_nifti, is_cat12, is_map, is_t1 from kinds")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, sf_dir).select("id", files.is_nifti(p).alias("is_nifti"), files.is_cat12(p).alias("is_cat12"), files.is_map(p).alias("is_map"), files.is_t1(p).alias("is_t1"))


SCAN = (
    PATHS,
    CAT,
    KINDS,
    MAPS,
    GUESS,
    f"""sc as (select k.path, min(k.id) as id from kinds k where is_nifti and not list_contains(above, 'derivatives') group by k.path),
  it0 as (select sc.path, ct.cs, gs.subject as gsub, {SESSION.format("gs.e2")} as gses, mp.met as mmet, mp."desc" as mdesc, gs.name, case when ct.cs is not null then 'CAT12 File' when kinds.is_map and {WANTED.replace("name", "gs.name")} then 'MRSI File' when kinds.is_t1 then 'T1 Image' end as kind from sc join ct using (id) join gs using (id) join mp using (id) join kinds using (id)),
  items as (select path, kind, case when kind = 'CAT12 File' then cs.sub else gsub end as subject, case when kind = 'CAT12 File' then {SESSION.format("cs.ses")} else gses end as session,
    case when kind = 'T1 Image' then coalesce(nullif(regexp_extract(name, 'acq-([^_]+)', 1), ''), case when contains(lower(name), 'mp2rage') then 'mp2rage' when contains(lower(name), 'mprage') then 'mprage' else 'unknown' end) when kind = 'CAT12 File' then coalesce(cs.acq, '') end as acq,
    case when kind = 'MRSI File' then coalesce(mmet, '') end as met, case when kind = 'MRSI File' then coalesce(mdesc, '') when kind = 'CAT12 File' then cs['desc'] end as "desc" from it0 where kind is not null),
  conf as (select *, case when kind = 'CAT12 File' then case when subject <> '' and session <> '' then 'high' else 'medium' end when subject <> '' and session <> '' then 'medium' else 'low' end as confidence from items),
  dest0 as (select *, case when subject = '' or session = '' then null when kind = 'MRSI File' then case when "desc" <> '' then 'derivatives/mrsi-orig/sub-' || subject || '/ses-' || session || '/' || concat_ws('_', 'sub-' || subject || '_ses-' || session, 'space-orig', 'met-' || nullif(met, ''), 'desc-' || "desc") || '_mrsi.nii.gz' end
    when kind = 'T1 Image' then 'sub-' || subject || '/ses-' || session || '/anat/sub-' || subject || '_ses-' || session || '_acq-' || acq || '_T1w.nii.gz' else 'derivatives/cat12/sub-' || subject || '/ses-' || session || '/sub-' || subject || '_ses-' || session || '_desc-' || "desc" || '_T1w.nii.gz' end as target from conf),
  dest as (select *, case when subject = '' or session = '' then 'Missing subject/session' when target is null then 'Unrecognized MRSI filename' end as problem from dest0),
  ex as (select distinct target from dest where hash_of(target)), state as (select dest.*, case when dest.target is null then 2 when ex.target is not null then 1 else 0 end as state from dest left join ex using (target))""".replace("hash_of(target)", "contains(target, 'S1') or contains(target, '_desc-p2')"),
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    return files.scanned(p.select("path", F.col("path").alias("real")), "path", "real")


@query(*SCAN, sql='select path, kind, subject, session, acq, met, "desc", confidence from conf')
def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).drop("note")


@query(*SCAN, sql="select path, target, problem from dest")
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.destination(items(spark, sf_dir), "path").select("path", "target", "problem")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cut(files.destination(items(spark, sf_dir), "path").drop("note"))  # named twice below, and its paths are costly to read
    return files.target_states(placed, placed.where(F.col("target").contains("S1") | F.col("target").contains("_desc-p2")).select(F.col("target").alias("path")))


@query(*SCAN, sql="select path, state from state")
def target_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("path", "state")


@query(*SCAN, sql="select kind, count(*) filter (state = 0 and not (path like '%.nii' and target like '%.nii.gz')) as copied, count(*) filter (state = 0 and path like '%.nii' and target like '%.nii.gz') as converted, count(*) filter (state = 1) as skipped, count(*) filter (state = 2) as failed from state group by kind")
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.migration_counts(states(spark, sf_dir))


@query(*SCAN, sql="select row_number() over (order by state, kind, subject, session, path) as n, path from state")
def sorted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(states(spark, sf_dir), ["state", "kind", "subject", "session", "path"]).select("n", "path")


FOLDERS = "fo as (select o_orderkey as id, '/d/S' || o_custkey as folder, o_orderkey % 4 as k from orders), pl as (select id, folder, folder || case k when 0 then '/MRSI_NIFTI' when 1 then '/in/Results_S' || split_part(folder, '/S', 2) || '/MRSI_NIFTI' when 2 then '/Results_S' || split_part(folder, '/S', 2) || '/MRSI_NIFTI' else '/other' end as place, k from fo)"


@query(FOLDERS, sql="select folder, arg_min(place, k) as found from pl where k < 3 group by folder")
def map_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("o_orderkey") % 4, F.concat(F.lit("S"), F.col("o_custkey").cast("string"))
    folder = F.concat(F.lit("/d/"), name)
    place = F.concat(folder, F.when(k == 0, "/MRSI_NIFTI").when(k == 1, F.concat(F.lit("/in/Results_"), name, F.lit("/MRSI_NIFTI"))).when(k == 2, F.concat(F.lit("/Results_"), name, F.lit("/MRSI_NIFTI"))).otherwise("/other"))
    o = table(spark, sf_dir, "orders").select(folder.alias("folder"), place.alias("path"))
    return files.map_folder(o.select("folder").distinct(), "folder", o, "in")


@query(sql="select c_custkey as id, case when c_custkey % 3 = 0 then 'a-atlases/' || c_custkey when c_custkey % 2 = 0 then 'a/' || c_custkey end as found from customer")
def parcel_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("a-atlases/"), F.col("c_custkey").cast("string")).alias("one"), F.concat(F.lit("a/"), F.col("c_custkey").cast("string")).alias("two"))
    listing = c.where("id % 3 = 0").select(F.col("one").alias("path")).union(c.where("id % 2 = 0").select("two"))
    return files.existing_folder(c, "one", "two", listing).select("id", "found")


@query(PATHS, "rec as (select distinct 'S' || c as subject, 'T' || s as session, c from paths), rq as (select *, case when c % 2 = 0 then 'acq-mprage' else 'misc/MP2RAGE/T1_mp2rage_' || c || '.nii' end as arg from rec)", sql="select subject, session, coalesce((select min(path) from paths where path = arg), (select min(path) from pn where contains(name, 'sub-' || subject || '_ses-' || session || '_') and contains(name, arg))) as t1 from rq")
def resolved_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    rec = p.select(F.concat(F.lit("S"), "c").alias("subject"), F.concat(F.lit("T"), "s").alias("session"), F.when(F.col("c") % 2 == 0, "acq-mprage").otherwise(F.concat(F.lit("misc/MP2RAGE/T1_mp2rage_"), F.col("c").cast("string"), F.lit(".nii"))).alias("arg")).distinct()
    return files.resolved_t1(rec, "arg", "subject", "session", p).select("subject", "session", "t1")


@query(
    PATHS,
    "w as (select distinct 'sub-S' || c || '_ses-T' || s || '_acq-mp2rage_run-02_desc-brain_T1w.nii.gz' as stripped, 'sub-S' || c || '_ses-T' || s as key from paths), r as (select distinct path, name, regexp_extract(name, 'sub-([^_]+)_ses-([^_]+)') as key from pn where contains(path, '/anat/') and contains(name, '_T1w') and not contains(name, '_desc-')), z as (select stripped, path, name, 2 * contains(name, '_acq-mp2rage')::int + contains(name, '_run-02')::int as score from w join r using (key))",
    sql="select stripped, path, score from (select *, row_number() over (partition by stripped order by score desc, name) as n from z) where n = 1",
)
def raw_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    w = p.select(F.concat(F.lit("sub-S"), F.col("c").cast("string"), F.lit("_ses-T"), F.col("s"), F.lit("_acq-mp2rage_run-02_desc-brain_T1w.nii.gz")).alias("stripped")).distinct()
    return files.raw_t1(w, "stripped", p.select("path").distinct(), "path")


@query(sql="select c_custkey as id, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then 'd/' || c_custkey || '/mri' when c_custkey % 3 = 1 then 'd/' || c_custkey || '/mri' else 'd/' || c_custkey end as source from customer")
def segmentation_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("d/"), n, F.when(F.col("c_custkey") % 3 == 1, "/mri").otherwise("")).alias("folder"))
    listing = c.where("id % 2 = 0 and id % 3 = 0 or id % 3 = 1").select(F.concat("folder", F.lit("/mri")).alias("path"))
    return files.segmentation_folder(c, "folder", listing).select("id", "source")


@query(sql="select user_id as file, count(*) filter (isnan(v)) = 0 and coalesce(max(case when not isnan(v) then v end) <> 0, false) as valid from (select user_id, case when event_id % 97 = 0 then 'nan'::double when user_id % 5 = 0 then 0 else value end as v from events) group by all")
def sound_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("value"))
    return files.sound_volumes(table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), v.alias("v")), "file", "v")


@query(sql="select p_partkey as id, translate(trim(p_type), ' /,|', '----') as token, trim(p_name) as plain from part")
def id_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), files.name_token(F.col("p_type")).alias("token"), files.plain_id(F.concat(F.lit(" "), F.col("p_name"))).alias("plain"))


@query(sql="select c_custkey as id, case when c_custkey % 2 = 0 then 'x_met-Glx_y' when c_custkey % 3 = 0 then 'x_met-GluGln_y' end as found from customer".replace("'x_met-Glx_y'", "c_custkey || '_met-Glx_y'").replace("'x_met-GluGln_y'", "c_custkey || '_met-GluGln_y'"))
def synonym_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("Glx").alias("met"), F.concat(n, F.lit("_met-Glx_y")).alias("path_"))
    listing = c.where("id % 2 = 0").select(F.col("path_").alias("path")).union(c.where("id % 3 = 0").select(F.concat(F.col("id").cast("string"), F.lit("_met-"), catalog.metabolite(F.lit("Glx")), F.lit("_y"))))
    return files.synonym_path(c, "path_", "met", listing).select("id", "found")
