"""The jobs as queries: each runs its function twice into one new folder and gives the output as it then stands, with SQL for the same rows."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from parcelyard.functions.lineage import shared_dir

from . import document_profiles, similarity_network
from .common import settings


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/jobs/{uuid.uuid4().hex}"


def _config(name: str) -> str:
    return str(Path(__file__).parent / f"{name}.json")


def job1_document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    wanted = settings(document_profiles.Settings, _config("document_profiles"), input=f"{sf_dir}/documents.parquet", output=f"{at}/out", checkpoint=f"{at}/checkpoint")
    document_profiles.run(spark, wanted)
    return document_profiles.run(spark, wanted)


def job2_similarity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = settings(similarity_network.Settings, _config("similarity_network"), input=f"{sf_dir}/events.parquet", output=_folder(spark))
    similarity_network.run(spark, wanted)
    return similarity_network.run(spark, wanted)


QUERIES = {f.__name__: f for f in (job1_document_profiles, job2_similarity_network)}

ORACLE_SQL = {
    "job1_document_profiles": r"""
with t as (select nullif(lang, '') as lang, nullif(source, '') as source, coalesce(text, '') as text from documents),
m as (select lang, source, unnest([
  {'measure': 'chars', 'x': length(text)}, {'measure': 'bytes', 'x': strlen(text)},
  {'measure': 'words', 'x': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}, {'measure': 'capitals', 'x': len(regexp_extract_all(text, '[A-Z]'))},
  {'measure': 'figures', 'x': len(regexp_extract_all(text, '[0-9]'))}, {'measure': 'marks', 'x': len(regexp_extract_all(text, '[!-/:-@\[-`{-~]'))},
  {'measure': 'lines', 'x': len(regexp_extract_all(text, '[^\n]+'))}]) as s from t),
g as (select lang, source, s.measure as measure, count(*) as docs, sum(s.x)::double as total, sum(s.x::hugeint * s.x)::double as squares, min(s.x)::bigint as least, max(s.x)::bigint as most from m group by all)
select lang, source, measure, docs, round(total / docs, 6) as mean, case when docs > 1 then round(sqrt(greatest(squares - total * total / docs, 0) / (docs - 1)), 4) end as sd, least, most from g""",
    "job2_similarity_network": """
with o as (select date_trunc('week', ts)::date as recording, user_id % 12 as region, event_type as channel, event_id % 10 as draw, avg(value) as v
  from events where ts is not null and user_id is not null and event_type is not null and value is not null and not isnan(value) group by all),
k as (select *, rank() over (partition by recording, region order by v) + (count(*) over (partition by recording, region, v) - 1) / 2.0 as q from o),
p as (select a.recording, a.region as i, b.region as j, round(case when stddev_pop(a.q) * stddev_pop(b.q) = 0 then null else covar_pop(a.q, b.q) / (stddev_pop(a.q) * stddev_pop(b.q)) end, 6) as r, count(*) as n
  from k a join k b on a.recording = b.recording and a.channel = b.channel and a.draw = b.draw and a.region < b.region group by all)
select recording, i, j, r, n, coalesce(abs(r) >= 0.3, false) and n >= 8 as kept from p""",
}
