"""The jobs as queries: each runs twice into one new folder below the shared one, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import pileup_stream, quality_gate
from jobs.config import settings
from spanmill.plans.registry import _PILE, _SR, r6
from spanmill.sources import files

C = settings(quality_gate.__file__)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_pileup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "pileup-stream")
    for _ in range(2):  # the second run finds nothing new
        pileup_stream.run(spark, f"{sf_dir}/events.parquet", out, f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/features")
    rounded = {c: r6(F.col(c)) for c in ("allele_balance", "mean_alt", "mean_ref", "mean_diff", "depth_ratio")}
    return rows.withColumns(rounded | {"var_alt": F.round(F.col("var_alt") + 1e-9, 4), "day": F.col("day").cast("string")})


JOB1_SQL = f"""{_SR}, p as (select s.user_id, site, event_type, value from s join r on s.user_id = r.user_id and start <= pos0 and pos0 < stop), f as ({_PILE})
select f.*, (date '1970-01-01' + (pos0 // 86400000000)::int)::date::varchar as day from f join s using (user_id, site)"""


def job2_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "quality-gate")
    for _ in range(2):
        quality_gate.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    decisions, report = spark.read.parquet(f"{out}/decisions"), spark.read.parquet(f"{out}/report")
    measures = [r6(F.col(c)).alias(c) for c in ("val_f1", "auroc", "average_precision", "precision", "recall", "f1")]
    # one row for each language
    rows = decisions.alias("d").join(report.alias("r"), F.col("d.lang").eqNullSafe(F.col("r.lang")))
    return rows.select("doc_id", "d.lang", "split", "text_score", "label", "d.threshold", "passed", F.col("n").alias("n_test"), *measures)


JOB2_SQL = f"""with ch as (select doc_id, unnest(string_split(coalesce(text, ''), '')) as c from documents), n as (select doc_id, c, count(*) as k from ch where c <> '' group by all),
e as (select doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) as h from n group by doc_id),
s as (select d.doc_id, coalesce(lang, '') as lang, round(1 / (1 + exp(-(coalesce(h, 0) - {C["centre"]}) * {C["slope"]})), {C["digits"]}) + 0 as text_score, l.doc_id is not null as matched, case when good then 1 else 0 end as label
from documents d left join e using (doc_id) left join (select doc_id, bool_or(quality = 1) as good from labels where quality in (0, 1) group by 1) l on l.doc_id = d.doc_id),
u as (select doc_id, (row_number() over (partition by label order by md5(doc_id || '|{C["seed"]}'), doc_id) - 0.5) / count(*) over (partition by label) as share from s where matched),
m as (select s.doc_id, lang, text_score, case when matched then label end as label, case when not matched then 'none' when share >= {C["held"]} then 'train' when share >= {C["held"] * C["test_share"]} then 'val' else 'test' end as split
from s left join u using (doc_id)),
g as (select lang, split, text_score as p, sum(label)::bigint as dp, sum(1 - label)::bigint as dn from m where split in ('val', 'test') group by all),
k as (select *, sum(dp) over w as tp, sum(dn) over w as fp, sum(dp) over (partition by lang, split) as np, sum(dn) over (partition by lang, split) as nn from g window w as (partition by lang, split order by p desc)),
f as (select *, tp / (tp + fp) as pr, case when np > 0 then tp / np else 0 end as re from k), b as (select *, 2 * pr * re / (pr + re + 1e-9) as f1 from f where split = 'val'),
v as (select lang, p as threshold, f1 as val_f1 from b qualify row_number() over (partition by lang order by f1 desc, p) = 1),
c as (select lang, coalesce(threshold, {C["default_threshold"]}) as threshold, val_f1 from (select distinct lang from m) left join v using (lang)),
x as (select lang, max(np + nn)::bigint as n, case when max(np) * max(nn) > 0 then sum(dn * (tp - dp / 2)) / (max(np) * max(nn)) end as auroc, case when max(np) > 0 then sum(dp * tp / (tp + fp)) / max(np) else 0 end as ap from k where split = 'test' group by 1),
y as (select lang, count(*) filter (text_score >= threshold and label = 1) as tp, count(*) filter (text_score >= threshold and label = 0) as fp, count(*) filter (text_score < threshold and label = 1) as fn from m join c using (lang) where split = 'test' group by 1)
select doc_id, nullif(m.lang, '') as lang, split, text_score, label::int as label, threshold, text_score >= threshold as passed, coalesce(n, 0)::bigint as n_test, round(val_f1, 6) + 0 as val_f1, round(auroc, 6) + 0 as auroc, round(ap, 6) + 0 as average_precision,
round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) + 0 as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) + 0 as recall, round(case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) + 0 as f1
from m join c using (lang) left join x using (lang) left join y using (lang)"""

QUERIES = {"job1_pileup_stream": job1_pileup_stream, "job2_quality_gate": job2_quality_gate}
ORACLE_SQL = {"job1_pileup_stream": JOB1_SQL, "job2_quality_gate": JOB2_SQL}
