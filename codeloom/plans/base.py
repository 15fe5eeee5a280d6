"""What the registered queries share: tables, the annotated blocks, and the same blocks as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import chains, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.annotate(storage.spread(table(spark, sf_dir, "documents"), "doc_id"))


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: documents -> blocks(doc_id, block_seq, excerpt, factors, relations), occ, edges
BLOCKS = r"""
with s1 as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as st from documents),
s0 as (select doc_id, flatten(list_transform(st, lambda x: list_transform(range(0, greatest(length(x) - 1, 0) // 400 + 1), lambda k: x[k * 400 + 1 : (k + 1) * 400]))) as st from s1),
s2 as (select doc_id, list_transform(st, lambda x: {'e': x, 'ws': regexp_extract_all(lower(x), '[a-z]{3,5}')}) as ss from s0),
s3 as (select doc_id, flatten(list_transform(ss, lambda x: list_transform(list_filter(range(0, len(x.ws) + 1), lambda k: k % 4 = 0 and len(x.ws) - k >= 2),
       lambda k: {'e': x.e, 'f': x.ws[k + 1 : k + 4]}))) as bl from s2),
s4 as (select doc_id, unnest(range(len(bl)))::INT as block_seq, unnest(bl) as b from s3),
blocks as (select doc_id, block_seq, b.e as excerpt, list_transform(b.f, lambda x: upper(x[1:1]) || x[2:]) as factors,
       list_transform(range(0, len(b.f) - 1), lambda i: (['enables', 'influences', 'constrains', 'contested-by', 'relates-to'])[(block_seq + i) % 5 + 1]) as relations from s4),
occ as (select doc_id, block_seq, unnest(range(len(factors)))::INT as pos, unnest(factors) as factor, excerpt, factors, relations from blocks),
edges as (select doc_id, block_seq, pos, factor as src, relations[pos + 1] as rel, factors[pos + 2] as dst from occ where pos < len(factors) - 1)
"""

#: on top of BLOCKS: freq, pairs, ranked (co-factors with their level)
CO = BLOCKS + r"""
, freq as (select factor, count(*) as frequency, count(distinct doc_id) as sources from occ group by 1)
, pairs as (select o.factor, g.g as co_factor, count(*) as n, min({'d': doc_id, 'b': block_seq, 'p': pos, 'j': g.j}) as first_seen
   from occ o, unnest(list_transform(range(len(factors)), lambda j: {'j': j, 'g': factors[j + 1]})) as t(g) where g.g <> o.factor group by 1, 2)
, rk as (select *, row_number() over (partition by factor order by n desc, first_seen) as rank from pairs)
, lv as (select rk.*, case when rank <= 10 and n >= frequency * 0.3::DOUBLE then 'high' when n >= frequency * 0.15::DOUBLE then 'medium' end as l0
   from rk join freq using (factor) where rank <= 20)
, pl as (select *, row_number() over (partition by factor, l0 order by rank) as place from lv)
, ranked as (select factor, co_factor, n, rank, case when place <= 10 then l0 end as level from pl)
, co as (select factor, coalesce(list(co_factor order by rank) filter (level = 'high'), []) as high,
   coalesce(list(co_factor order by rank) filter (level = 'medium'), []) as medium from ranked group by 1)
"""

#: on top of CO: ctx, the scored contexts, and best3
CONTEXTS = CO + r"""
, c1 as (select *, trim(regexp_replace(excerpt, '\s+', ' ', 'g')) as clean from occ where trim(excerpt) <> '')
, c2 as (select *, string_split(regexp_replace(clean, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] as fs from c1)
, c3 as (select *, case when length(clean) <= 220 then clean when length(fs) <= 220 then fs else rtrim(fs[1:217]) || '...' end as summary from c2)
, c4 as (select *, row_number() over (partition by factor, lower(trim(regexp_replace(summary, '\s+', ' ', 'g'))) order by doc_id, block_seq, pos) as rn from c3)
, ctx as (select factor, doc_id, block_seq, pos, summary, round(greatest(1.0::DOUBLE + case when contains(lower(summary), lower(factor)) then 1.0::DOUBLE else 0.0::DOUBLE end
   + 0.4::DOUBLE * len(list_filter(factors, lambda f: f <> factor and contains(lower(summary), lower(f)))) + 0.2::DOUBLE * len(list_filter(relations, lambda r: contains(lower(summary), lower(r))))
   - least(abs(length(summary) - 180) / 180.0::DOUBLE * 0.5::DOUBLE, 0.8::DOUBLE), 0.1::DOUBLE), 6) as score from c4 where rn = 1)
, b3 as (select *, row_number() over (partition by factor order by score desc, doc_id, block_seq, pos) as place from ctx)
, best3 as (select * from b3 where place <= 3)
, rel as (select src as factor, rel, list_sort(list(distinct dst)) as targets from edges group by 1, 2)
, relm as (select factor, list({'rel': rel, 'targets': targets} order by rel) as rels from rel group by 1)
, cx as (select factor, list(summary order by place) as contexts from best3 group by 1)
, memory as (select f.factor, frequency, sources, coalesce(rels, []) as rels, coalesce(high, []) as high, coalesce(medium, []) as medium, coalesce(contexts, []) as contexts
   from freq f left join relm using (factor) left join co using (factor) left join cx using (factor))
"""
