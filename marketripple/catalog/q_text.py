"""Text-step queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import cte, query
from marketripple.operators import text as O

# The documents are invented prose, so the pattern names words of theirs.
PATTERN = "(?i)(^|[^a-z])(things?|ments?|elles?|erings?)([^a-z]|$)"

cte("t_docs", "select doc_id, text, date '1995-01-02' + cast(doc_id % 2500 as integer) as date from documents")
cte("t_par", r"""
with s as (select doc_id, date, string_split(text, chr(10)) as a from t_docs),
e as (select doc_id, date, unnest(a) as paragraph, unnest(range(len(a))) as pos from s)
select doc_id, date, cast(pos as integer) as pos, paragraph from e where trim(paragraph) <> ''""")


def _docs(m):
    return m.table("documents").select("doc_id", "text", F.expr("date_add(date'1995-01-02', cast(doc_id % 2500 as int))").alias("date"))


query("txt_01_dependency_prefilter", lambda m: O.dependency_prefilter(O.paragraphs(_docs(m)), PATTERN).select("doc_id", "date", "pos", F.length("paragraph").alias("n_chars")),
      f"select doc_id, date, pos, cast(length(paragraph) as integer) as n_chars from t_par where regexp_matches(paragraph, '{PATTERN}')")
query("txt_01_prefilter_share", lambda m: O.paragraphs(_docs(m)).agg(
    F.count(F.lit(1)).alias("n"), F.count_if(F.col("paragraph").rlike(PATTERN)).alias("n_kept")),
      f"select count(*) as n, count(*) filter (regexp_matches(paragraph, '{PATTERN}')) as n_kept from t_par")
query("txt_02_paragraph_first_seen", lambda m: O.paragraph_first_seen(O.paragraphs(_docs(m))), r"""
select sha256(trim(regexp_replace(lower(paragraph), '[ \t\r\f]+', ' ', 'g'))) as hash, min(date) as first_seen, count(*) as copies from t_par group by 1""")
query("txt_03_attention_gate", lambda m: O.attention_gate(m.signal.select("date", "ticker", "z"), m.panel, 20), """
with v as (select date, ticker, (volume - avg(volume) over w) / nullif(stddev_samp(volume) over w, 0) as volume_z from t_panel
 window w as (partition by ticker order by idx rows between 20 preceding and 1 preceding))
select s.date, s.ticker, z, volume_z, case when coalesce(volume_z > 2, false) then 0 else z end as gated from t_sig s
left join v on v.date = s.date and v.ticker = s.ticker""", d="z volume_z gated")
cte("t_mult", """
with n as (select cast(date_trunc('week', date) as date) as date, count(*) as n_docs from t_docs group by 1)
select *, n_docs / (select avg(n_docs) from n) as multiplier from n""")


def _weekly(m):
    return _docs(m).select(F.date_trunc("week", "date").cast("date").alias("date"))


query("txt_03_distraction_multiplier", lambda m: O.distraction_multiplier(_weekly(m)), "select date, n_docs, multiplier from t_mult", d="multiplier")
query("txt_03_scaled_signal", lambda m: O.scale_by_distraction(
    m.signal.select("date", "ticker", "z"), O.distraction_multiplier(_weekly(m))).select("date", "ticker", "scaled"),
      "select s.date, s.ticker, z * coalesce(multiplier, 1) as scaled from t_sig s left join t_mult t on t.date = s.date", d="scaled")
