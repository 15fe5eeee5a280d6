"""Queries over texts: scalar functions, chunking, budgets, tagged text, items and interviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunking, items, storage, tagged
from codeloom.plans.base import BLOCKS, blocks, query, table
from codeloom.sources import readers, writers

SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
SENT = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"


@query(f"select doc_id, trunc({WORDS.format('text')} * 1.3::DOUBLE)::INT as tokens from documents")
def x1_tokens_by_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens_by_words(F.col("text")).alias("tokens"))


@query("select doc_id, (length(text) // 4)::INT as by4, (length(text) // 3)::INT as by3 from documents")
def x2_tokens_by_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens_by_chars(F.col("text")).alias("by4"), T.tokens_by_chars(F.col("text"), 3).alias("by3"))


@query(f"select doc_id, len({SENT.format('text')}) as n, md5(array_to_string({SENT.format('text')}, chr(2))) as digest from documents")
def x3_sentences(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\x02")).alias("digest"))


@query(f"select doc_id, md5(lower({SQUEEZE.format('text')})) as fingerprint from documents")
def x4_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.fingerprint(F.col("text"))).alias("fingerprint"))


@query(BLOCKS + "select distinct factor as name from occ")
def x5_title_case(spark, d):
    from codeloom.operators import chains

    own = chains.occurrences(blocks(spark, d)).select(T.title_case(F.upper("factor")).alias("name"))
    return own.distinct()


@query(f"""with c as (select doc_id, {SQUEEZE.format('text')} as t from documents), f as (select *, {SENT.format('t')}[1] as s from c)
select doc_id, case when length(t) <= 220 then t when length(s) <= 220 then s else rtrim(s[1:217]) || '...' end as summary from f""")
def x6_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("select doc_id, text from documents where trim(text) <> ''")
def f1_not_blank(spark, d):
    return table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", "text")


@query("select doc_id as reference, text as abstract, (doc_id is null or coalesce(text, '') = '') as rejected from documents")
def f2_complete_entries(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("reference"), F.col("text").alias("abstract"))
    bad = F.col("reference").isNull() | (F.coalesce("abstract", F.lit("")) == "")
    return docs.where(~bad).withColumn("rejected", F.lit(False)).unionAll(docs.where(bad).withColumn("rejected", F.lit(True)))


@query("select doc_id as reference, text as abstract from documents")
def s2_abstract_table(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("reference"), F.col("text").alias("abstract"))


@query(f"""with t as (select doc_id, coalesce(text, '') as t from documents), s as (select doc_id, t, {SENT.format('t')} as st from t),
z as (select doc_id, t, list_reduce(list_prepend({{'out': []::VARCHAR[], 'cur': '', 's': ''}}, list_transform(st, lambda x: {{'out': []::VARCHAR[], 'cur': '', 's': x}})),
  lambda a, b: case when length(a.cur) + length(b.s) > 30000 and a.cur <> '' then {{'out': list_append(a.out, a.cur), 'cur': b.s, 's': ''}} when length(a.cur) + length(b.s) > 30000 then {{'out': list_append(a.out, b.s), 'cur': '', 's': ''}}
    when a.cur <> '' then {{'out': a.out, 'cur': a.cur || ' ' || b.s, 's': ''}} else {{'out': a.out, 'cur': b.s, 's': ''}} end) as r from s where length(t) > 30000),
c as (select doc_id, [t] as c from t where length(t) <= 30000 union all select doc_id, case when r.cur <> '' then list_append(r.out, r.cur) else r.out end from z),
p as (select doc_id, unnest(range(1, len(c) + 1))::INT as part, len(c)::INT as n_parts, unnest(c) as chunk from c)
select doc_id, part, n_parts, length(chunk)::INT as chars, md5(chunk) as digest from p""")
def x8_packed_chunks(spark, d):
    out = chunking.chunks(table(spark, d, "documents"))
    return out.select("doc_id", "part", "n_parts", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@query(f"""with s as (select doc_id, unnest(range(len(st)))::INT as pos, unnest(st) as s from (select doc_id, {SENT.format('text')} as st from documents)),
r as (select *, sum(trunc({WORDS.format('s')} * 1.3::DOUBLE)::INT) over (partition by doc_id order by pos rows unbounded preceding) as run from s),
h as (select doc_id, string_agg(s, ' ' order by pos) as head, max(run) as used from r where run <= 300 group by 1),
a as (select doc_id, text, trunc({WORDS.format('text')} * 1.3::DOUBLE)::INT as n from documents)
select doc_id, md5(case when n <= 300 then text else coalesce(head, '') end) as digest, (case when n <= 300 then n else coalesce(used, 0) end)::BIGINT as tokens from a left join h using (doc_id)""")
def w3_truncated(spark, d):
    return chunking.truncate(table(spark, d, "documents"), 300).select("doc_id", F.md5("text").alias("digest"), "tokens")



#: windows of documents, a step at a time; {0} is what lets a window start where the one before has ended
_WINDOWS = r"""with recursive t as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
w as (select doc_id, t, n, 0::BIGINT as part, 0::BIGINT as start, 0::BIGINT as stop, 0::BIGINT as nxt from t
  union all select doc_id, t, n, part + 1, nxt, stop, case when stop >= n then n + 1 when stop - 5000 <= nxt {0} then stop else stop - 5000 end from (
    select doc_id, t, n, part, nxt, case when n <= 18000 or nxt + 18000 >= n then n when cut > 1 then nxt + cut when blank > 1 then nxt + blank - 1 else nxt + 18000 end as stop from (
      select *, length(regexp_extract(substring(t, nxt + 1, 18000), '(?s)^.+[.!?][ \n]')) as cut, length(regexp_extract(substring(t, nxt + 1, 18000), '(?s)^.* ')) as blank from w where part = 0 or nxt < n) x) y)
select doc_id, part::INT as part, start, stop as "end", md5(substring(t, start + 1, stop - start)) as digest from w where part > 0"""


@query(_WINDOWS.format("or part > 0 and stop - 5000 <= n - (stop - nxt)"))
def x9_overlapping_windows(spark, d):
    return chunking.overlapping(table(spark, d, "documents")).select("doc_id", "part", "start", "end", F.md5("chunk").alias("digest"))


@query(_WINDOWS.format(""))
def p4_uniform_windows(spark, d):
    return chunking.overlapping(table(spark, d, "documents"), mode="uniform").select("doc_id", "part", "start", "end", F.md5("chunk").alias("digest"))


@query("select doc_id, greatest(200000 - 8000 - 20000 - length(text) * 10, 5000)::INT as budget from documents")
def x27_transcript_budget(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.transcript_budget(F.length("text") * 10).alias("budget"))


@query(f"""with c as (select doc_id, unnest(range(len(st))) + 1 as part, unnest(st) as chunk from (select doc_id, {SENT.format('text')} as st from documents))
select doc_id, part, scope, md5(chunk) as digest from c, (values ('classificatory'), ('exploratory')) s(scope)""")
def j2_chunks_by_scope(spark, d):
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "chunk"))
    scopes = F.explode(F.array(F.lit("exploratory"), F.lit("classificatory")))
    return cut.select("doc_id", (F.col("k") + 1).cast("long").alias("part"), scopes.alias("scope"), F.md5("chunk").alias("digest"))


# --- tagged text ---------------------------------------------------------------------------------------------------

RENDERED = BLOCKS + r"""
, b1 as (select doc_id, block_seq, excerpt, '[-begin-][@doc' || doc_id || '@][!' || excerpt || '!][%d' || block_seq || '%]' ||
   array_to_string(list_transform(range(len(factors)), lambda i: '[#' || factors[i + 1] || '#]' || coalesce('[&' || relations[i + 1] || '&]', '')), '') || '[-end-]' as block from blocks)
"""


@query(RENDERED + r"""select 'doc' || doc_id as ref, md5('[-begin_header-]' || chr(10) || 'referencia_bibtex:doc' || doc_id || chr(10) || 'descricao:[Coded text]' || chr(10) || 'metodo:[Not specified]' || chr(10) || '[-end_header-]' || chr(10) || chr(10) ||
 string_agg(block, chr(10) || chr(10) order by block_seq)) as tagged from b1 group by doc_id""")
def k1_tagged_text(spark, d):
    return tagged.render(blocks(spark, d)).select("ref", F.md5("tagged").alias("tagged"))


@query(BLOCKS + """select 'doc' || doc_id as ref, block_seq, case when contains(excerpt, chr(10)) then '' else trim(excerpt) end as excerpt, 'd' || block_seq as description, array_to_string(factors, '|') as factors, array_to_string(relations, '|') as relations from blocks""")
def s4_tagged_round_trip(spark, d):
    out = tagged.parse(tagged.render(blocks(spark, d)))
    return out.select("ref", "block_seq", "excerpt", "description", F.array_join("factors", "|").alias("factors"), F.array_join("relations", "|").alias("relations"))


def _damaged(spark, d):
    """Blocks with the faults that models make: repeated references, doubled marks, excerpts without marks."""
    b = blocks(spark, d)
    ref = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    mark = F.concat(F.lit("[@"), ref, F.lit("@]"))
    tail = F.concat(F.lit("[%d%]"), F.array_join(F.transform("factors", lambda f: F.concat(F.lit("[#"), f, F.lit("#]"))), ""))
    excerpt, kind = F.trim("excerpt"), F.col("block_seq") % 5
    body = (
        F.when(kind == 0, F.concat(mark, mark, F.lit("[!"), excerpt, F.lit("!]"), tail))
        .when(kind == 1, F.concat(mark, F.lit("[!"), excerpt, F.lit("!]!]"), tail))
        .when(kind == 2, F.concat(mark, F.lit(" "), excerpt, F.lit(" "), tail))
        .when(kind == 3, F.concat(F.lit("[!"), excerpt, F.lit("!]"), tail))
        .otherwise(F.concat(mark, F.lit("[!"), excerpt, F.lit("!]")))
    )
    return b.select("doc_id", "block_seq", body.alias("body"))


_REPAIRED = BLOCKS + r"""
, d as (select doc_id, block_seq, '[@doc' || doc_id || '@]' as m, trim(excerpt) as e, '[%d%]' || array_to_string(list_transform(factors, lambda f: '[#' || f || '#]'), '') as tail from blocks)
, b as (select doc_id, block_seq, case block_seq % 5 when 0 then m || m || '[!' || e || '!]' || tail when 1 then m || '[!' || e || '!]!]' || tail when 2 then m || ' ' || e || ' ' || tail when 3 then '[!' || e || '!]' || tail else m || '[!' || e || '!]' end as body from d)
, r as (select *, regexp_matches(body, '\[@(.*?)@\]') as has, '[@' || regexp_extract(body, '\[@(.*?)@\]', 1) || '@]' as mark from b)
, o as (select *, replace(replace(replace(body, mark || mark, mark), mark || mark, mark), '!]!]', '!]') as once from r)
, p as (select *, strpos(once, mark) + length(mark) as begin_, strpos(once, '[%') as stop from o)
, i as (select *, trim(substring(once, begin_, greatest(stop - begin_, 0))) as inner_ from p)
, repaired as (select doc_id, block_seq, case when has and stop > 0 then case when starts_with(inner_, '[!') and ends_with(inner_, '!]') then once
   else substring(once, 1, begin_ - 1) || '[!' || replace(replace(inner_, '[!', ''), '!]', '') || '!]' || substring(once, stop) end end as block from i)
"""


@query(_REPAIRED + "select doc_id, block_seq, block from repaired")
def x12_repaired_blocks(spark, d):
    return _damaged(spark, d).select("doc_id", "block_seq", tagged.repair_block(F.col("body")).alias("block"))


@query(_REPAIRED + "select doc_id, count(block) as kept, count(*) - count(block) as dropped from repaired group by 1")
def f9_block_filter(spark, d):
    whole = tagged.repair_block(F.col("body")).isNotNull()
    return _damaged(spark, d).groupBy("doc_id").agg(F.count_if(whole).alias("kept"), F.count_if(~whole).alias("dropped"))


def _model_answers(spark, d):
    """(doc_id, ref, answer): what a model may answer for a document, in five forms, made of the document's own blocks and text."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.join(tagged.render(blocks(spark, d)), "ref", "left").withColumn("tagged", F.coalesce("tagged", F.lit("")))
    body = F.regexp_replace("tagged", r"(?s)^.*\[-end_header-\]", "")
    kind = F.col("doc_id") % 5
    answer = (
        F.when(kind == 0, F.concat(F.lit("**NO EXTRACTABLE CHAINS**: "), F.col("text"))).when(kind == 1, F.col("tagged")).when(kind == 2, F.replace(body, F.lit("[-begin-]"), F.lit("")))
        .when(kind == 3, body).otherwise(F.col("text"))
    )
    return storage.written(rows.select("doc_id", "ref", answer.alias("answer")), "answers")


_VALIDATED = RENDERED + r"""
, g as (select doc_id, string_agg(block, chr(10) || chr(10) order by block_seq) as body, string_agg(replace(block, '[-begin-]', '[-begin-]' || chr(10) || chr(10)), chr(10) || chr(10) order by block_seq) as unmarked from (select doc_id, block_seq,
   case when contains(excerpt, chr(10)) then replace(block, '[!' || excerpt || '!]', '[![!' || excerpt || '!]!]') else block end as block from (select doc_id, block_seq, excerpt, replace(block, '!]!]', '!]') as block from b1)) group by 1)
, a as (select d.doc_id, coalesce(d.text, '') as text, case when d.doc_id % 5 = 2 then g.unmarked else g.body end as body, d.doc_id % 5 as k, 'doc' || d.doc_id as ref from documents d left join g using (doc_id))
, v as (select *, case when k = 0 then 'no_chains' when k = 4 or body is null then 'failed' when k = 1 then 'ok' else 'recovered' end as status,
   trim(replace(regexp_extract('**: ' || text, '^([^\n]+)', 1), '*', '')) as said from a)
, w as (select *, case when said = '' then 'Abstract does not contain relevant content' else said end as reason, '[-begin_header-]' || chr(10) || 'referencia_bibtex:' || ref || chr(10) as top, chr(10) || '[-end_header-]' || chr(10) || chr(10) as foot from v)
, validated as (select doc_id, status, reason, case status
   when 'no_chains' then top || 'descricao:[No extractable chains: ' || reason || ']' || chr(10) || 'metodo:[Not applicable]' || foot || '[-begin-][@' || ref || '@][!NO EXTRACTABLE CHAINS!][%' || reason || '%][#No Analysis#][-end-]'
   when 'ok' then '[-begin_header-]referencia_bibtex:' || ref || chr(10) || 'descricao:[Coded text]' || chr(10) || 'metodo:[Not specified][-end_header-]' || chr(10) || chr(10) || body
   when 'recovered' then top || 'descricao:[Recovered analysis]' || chr(10) || 'metodo:[Not specified]' || foot || body
   else top || 'descricao:[Analysis could not be completed]' || chr(10) || 'metodo:[Not applicable]' || foot || '[-begin-][@' || ref || '@][!No valid analysis generated!][%Format issues in response%][#Format Error#][&causes&][#Missing Analysis#][-end-]' end as output from w)
"""


@query(_VALIDATED + "select doc_id, status, md5(output) as output from validated")
def x13_validated_answers(spark, d):
    out = tagged.validated(_model_answers(spark, d), recovered="Recovered analysis")
    return out.select("doc_id", "status", F.md5("output").alias("output"))


@query(_VALIDATED + "select status, count(*) as n from validated group by 1")
def x13_response_status(spark, d):
    return _model_answers(spark, d).select(tagged.classify_response(F.col("answer")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(_VALIDATED + "select doc_id, reason from validated where status = 'no_chains'")
def x14_no_chains_reason(spark, d):
    return _model_answers(spark, d).select("doc_id", tagged.no_chains_reason(F.col("answer")).alias("reason")).where("reason is not null")


@query(BLOCKS + "select doc_id, block_seq from blocks where len(factors) > 0")
def f10_blocks_with_factors(spark, d):
    return blocks(spark, d).where(F.size("factors") > 0).select("doc_id", "block_seq")


@query(f"""select doc_id, md5(array_to_string(list_transform({SENT.format('text')}, lambda s: '@doc' || doc_id || ' ' || s), chr(10))) as whole from documents""")
def x15_part_suffix(spark, d):
    """Texts whose sentences are marked with their parts' ids, with the id of the whole instead."""
    own = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    parts = F.transform(T.sentences(F.col("text")), lambda s, k: F.concat(F.lit("@"), own, F.lit("_part"), k.cast("string"), F.lit(" "), s))
    return table(spark, d, "documents").select("doc_id", F.md5(T.without_part(F.array_join(parts, "\n"), own)).alias("whole"))


@query(f"""with c as (select doc_id, unnest(range(len(st))) as part, unnest(st) as s from (select doc_id, {SENT.format('text')} as st from documents))
select doc_id, count(*) as n_parts, count(*)::INT as n_blocks, 'referencia_bibtex:' || doc_id as header,
 md5(string_agg(regexp_replace('[@' || doc_id || '_part' || part || '@]' || s, '\\[@.*?_part\\d+@\\]', '[@' || doc_id || '@]', 'g'), '|' order by part)) as digest from c group by 1""")
def a13_recombined(spark, d):
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("part", "s"))
    ref = F.concat(F.col("doc_id").cast("string"), F.lit("_part"), F.col("part").cast("string"))
    parts = cut.select("doc_id", "part", F.concat(F.lit("referencia_bibtex:"), ref).alias("header"), F.array(F.concat(F.lit("[@"), ref, F.lit("@]"), F.col("s"))).alias("blocks"))
    return tagged.combine(parts).select("doc_id", "n_parts", "n_blocks", "header", F.md5(F.array_join("blocks", "|")).alias("digest"))


# --- items and interviews ------------------------------------------------------------------------------------------

ITEMS = rf"""
with s as (select conv_id, turn, role, unnest(range(len(st)))::INT as sent, unnest(st) as excerpt from (select conv_id, turn, role, {SENT.format("coalesce(text, '')")} as st from conversations)),
items as (select 'conv' || conv_id as interview_id, turn, sent, excerpt, role, regexp_extract_all(lower(excerpt), '[a-z]{{3,5}}') as codes from s)
, pairs as (select interview_id, turn, sent, excerpt, role as rationale, unnest(range(len(codes)))::INT as p, unnest(codes) as code from items)
"""
PAIRS_TEXT = "array_join(transform(pairs, p -> concat(p.code, '=', p.rationale)), '|')"


def _items(spark, d):
    return items.annotate(table(spark, d, "conversations"))


@query("select 'conv' || conv_id as interview_id, md5(string_agg(coalesce(text, ''), chr(10) order by turn, text)) as digest from conversations group by conv_id")
def s3_transcripts(spark, d):
    return items.transcripts(table(spark, d, "conversations")).select("interview_id", F.md5("transcript").alias("digest"))


@query(ITEMS + "select interview_id, turn, sent, excerpt, array_to_string(list_transform(codes, lambda c: c || '=' || role), '|') as pairs from items")
def c3_items(spark, d):
    return _items(spark, d).withColumn("pairs", F.expr(PAIRS_TEXT))


@query(ITEMS + r"""select interview_id, (row_number() over (partition by interview_id order by turn, sent) - 1)::INT as item_seq, trim(trim(trim(excerpt, ' ' || chr(9) || chr(10) || chr(13)), '"'), '''') as excerpt,
 array_to_string(list_transform(codes, lambda c: c || '=' || role), '|') as pairs from items""")
def s5_item_round_trip(spark, d):
    out = items.parse(items.documents(_items(spark, d)))
    return out.select("interview_id", "item_seq", "excerpt", F.expr(PAIRS_TEXT).alias("pairs"))


@query(ITEMS + r"""select interview_id, turn, sent, md5('ITEM @' || interview_id || chr(10) || '    ordem_1a: "' || excerpt || '"' || chr(10) ||
 array_to_string(list_transform(codes, lambda c: '    ordem_2a: ' || c || chr(10) || '    justificativa_interna: "' || role || '"'), chr(10) || chr(10)) || chr(10) || 'END ITEM') as item from items""")
def x19_rendered_items(spark, d):
    text = items.render(F.col("interview_id"), F.col("excerpt"), F.col("pairs"))
    return _items(spark, d).select("interview_id", "turn", "sent", F.md5(text).alias("item"))


@query(ITEMS + "select interview_id, count(*) as items, sum(len(codes))::BIGINT as pairs from items group by 1")
def k2_item_folders(spark, d):
    """Items written as a folder of text for each interview, and read back."""
    path = storage.folder(spark, "items")
    writers.item_files(_items(spark, d), path)
    return items.parse(readers.item_folders(spark, path)).groupBy("interview_id").agg(F.count("*").alias("items"), F.sum(F.size("pairs")).alias("pairs"))


_PLAIN = "trim(translate(replace(text, chr(10), ' '), '{}\"', '()' || chr(39)))"


@query(f"select 'doc' || doc_id as reference, md5({_PLAIN}) as abstract from documents where {_PLAIN} <> ''")
def s1_bibtex(spark, d):
    """Documents written as BibTeX entries, and read back; braces and quotes, which the format keeps for itself, are replaced first."""
    path = storage.folder(spark, "bibtex")
    plain = F.translate(F.replace("text", F.lit("\n"), F.lit(" ")), '{}"', "()'")
    field = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("abstract = {"), plain, F.lit("}"))).otherwise(F.concat(F.lit('Abstract="'), plain, F.lit('"')))
    entry = F.concat(F.lit("@article{doc"), F.col("doc_id").cast("string"), F.lit(",\n  title = {T},\n  "), field, F.lit("\n}"))
    table(spark, d, "documents").where("text is not null").select(entry.alias("value")).write.text(path)
    return readers.bibtex(spark, path)[0].select("reference", F.md5("abstract").alias("abstract"))


@query(ITEMS + r"""select interview_id, 'SOURCE @' || interview_id || chr(10) || '    código: N/A' || chr(10) || 'END SOURCE' as header from items group by 1""")
def x11_source_header(spark, d):
    return items.documents(_items(spark, d)).select("interview_id", items.header(F.col("syn")).alias("header"))


def _faulty(spark, d):
    """Items with faults: every third code missing, every second rationale missing, every seventh excerpt missing."""
    pairs = F.transform("pairs", lambda p, i: F.struct(F.when(i % 3 == 2, F.lit("")).otherwise(p["code"]).alias("code"), F.when(i % 2 == 1, F.lit("")).otherwise(p["rationale"]).alias("rationale")))
    excerpt = F.when(F.col("sent") % 7 == 6, F.lit("")).otherwise(F.col("excerpt"))
    return _items(spark, d).withColumn("pairs", pairs).withColumn("excerpt", excerpt)


FAULTY = ITEMS + r"""
, g as (select interview_id, turn, sent, case when sent % 7 = 6 then '' else excerpt end as excerpt,
   list_transform(range(len(codes)), lambda i: {'code': case when i % 3 = 2 then '' else codes[i + 1] end, 'why': case when i % 2 = 1 then '' else role end}) as ps from items)
, h as (select *, list_transform(list_filter(ps, lambda p: p.code <> ''), lambda p: p.code || '=' || case when p.why <> '' then p.why else 'Evidência textual de ' || p.code || ' encontrada no trecho literal.' end) as done from g)
"""


@query(FAULTY + """select interview_id, turn, sent, excerpt <> '' and len(done) > 0 as accepted, array_to_string(done, '|') as pairs from h""")
def x18_completed_pairs(spark, d):
    return items.checked(_faulty(spark, d)).select("interview_id", "turn", "sent", "accepted", F.expr(PAIRS_TEXT).alias("pairs"))


@query(FAULTY + """select accepted, reason, count(*) as n from (select excerpt <> '' and len(done) > 0 as accepted, unnest(list_concat(list_filter([case when excerpt = '' then 'missing excerpt' end, case when len(ps) = 0 then 'missing pairs' end], lambda x: x is not null),
 list_concat(list_transform(list_filter(range(1, len(ps) + 1), lambda i: ps[i].code = ''), lambda i: 'missing code[' || i || ']'), case when len(done) = 0 and len(ps) > 0 then ['no complete pair'] else [] end))) as reason from h) group by 1, 2""")
def f6_rejections(spark, d):
    out = items.checked(_faulty(spark, d)).select("accepted", F.explode("reasons").alias("reason"))
    return out.groupBy("accepted", "reason").agg(F.count("*").alias("n"))


MERGED = (ITEMS + rf"""
, k as (select *, case when lower({SQUEEZE.format('excerpt')}) = '' then chr(0) || ':' || turn || ':' || sent else lower({SQUEEZE.format('excerpt')}) end as key from items)
, f as (select interview_id, key, min({{'t': turn, 's': sent, 'e': excerpt}}) as f, count(*) as n_items from k group by 1, 2)
, p as (select k.interview_id, key, turn, sent, role as rationale, unnest(range(len(codes)))::INT as p, unnest(codes) as code from k)
, q as (select *, row_number() over (partition by interview_id, key, code, rationale order by turn, sent, p) as n from p)
, m as (select q.interview_id, q.key, string_agg(code || '=' || rationale, '|' order by turn, sent, p) as pairs from q join f using (interview_id, key) where n = 1 or (turn = f.f.t and sent = f.f.s) group by 1, 2)
select interview_id, f.f.t as turn, f.f.s as sent, f.f.e as excerpt, coalesce(pairs, '') as pairs, n_items from f left join m using (interview_id, key)""")


@query(MERGED)
def a8_merged_items(spark, d):
    return items.merged(_items(spark, d)).withColumn("pairs", F.expr(PAIRS_TEXT))


@query(ITEMS + "select interview_id, any_value(n) as items, count(p) as pairs, count(distinct code) as codes from (select interview_id, count(*) as n from items group by 1) left join pairs using (interview_id) group by 1")
def a9_statistics(spark, d):
    return items.statistics(_items(spark, d))


@query(ITEMS + "select interview_id, code, n, rank::INT as rank from (select *, row_number() over (partition by interview_id order by n desc, code) as rank from (select interview_id, code, count(*) as n from pairs group by 1, 2)) where rank <= 10")
def t3_top_codes(spark, d):
    return items.top_codes(_items(spark, d))


EXPECT = ["the", "and", "was", "that", "with", "for", "eco", "zzz"]


@query(ITEMS + """, e(code, ord) as (values ('the', 1), ('and', 2), ('was', 3), ('that', 4), ('with', 5), ('for', 6), ('eco', 7), ('zzz', 8)), i as (select distinct interview_id from items), c as (select distinct interview_id, code from pairs)
select i.interview_id, coalesce(string_agg(e.code, '|' order by ord) filter (c.code is not null), '') as found, coalesce(string_agg(e.code, '|' order by ord) filter (c.code is null), '') as missing from i cross join e left join c on c.interview_id = i.interview_id and c.code = e.code group by 1""")
def j11_expected_codes(spark, d):
    out = items.expected(_items(spark, d), EXPECT)
    return out.select("interview_id", F.array_join("found", "|").alias("found"), F.array_join("missing", "|").alias("missing"))


@query(ITEMS + """select interview_id, count(*) as items, sum(len(codes))::BIGINT as pairs, count(*) >= 80 as enough_items, sum(len(codes)) between 200 and 400 as enough_pairs, count(*) filter (len(codes) between 3 and 10) as items_in_range, avg(len(codes)) >= 5 as dense from items group by 1""")
def r11_coverage(spark, d):
    return items.coverage(_items(spark, d))


@query(rf"select item_id, doc_id from benchmark b join documents d on contains(lower({SQUEEZE.format('d.text')}), lower({SQUEEZE.format('b.text')}))")
def j5_literal_containment(spark, d):
    return items.contained(table(spark, d, "benchmark"), table(spark, d, "documents"))


def _mutated(spark, d):
    """Items with changed excerpts: every 11th has its first word doubled, every 7th lacks its last word."""
    first, n = F.regexp_extract("excerpt", r"^(\S+)", 1), F.col("sent")
    changed = F.when(n % 11 == 10, F.concat(first, F.lit(" "), F.col("excerpt"))).when(n % 7 == 6, F.regexp_replace("excerpt", r"\s+\S+$", "")).otherwise(F.col("excerpt"))
    return _items(spark, d).withColumn("excerpt", changed)


@query()
def j6_fuzzy_literal(spark, d):
    out = items.literal(_mutated(spark, d), items.transcripts(table(spark, d, "conversations")))
    return out.select("interview_id", "turn", "sent", "is_valid", F.round("score", 6).alias("score"))


@query(ITEMS + """, t as (select 'conv' || conv_id as interview_id, lower(trim(regexp_replace(string_agg(coalesce(text, ''), chr(10) order by turn, text), '\\s+', ' ', 'g'))) as t from conversations group by conv_id)
select interview_id, turn, sent, contains(t, lower(trim(regexp_replace(excerpt, '\\s+', ' ', 'g')))) as is_valid from items join t using (interview_id)""")
def f7_literal_evidence(spark, d):
    out = items.literal(_items(spark, d), items.transcripts(table(spark, d, "conversations")))
    return out.select("interview_id", "turn", "sent", "is_valid")


@query()
def x31_text_similarity(spark, d):
    turns = table(spark, d, "conversations")
    a = turns.select("conv_id", "turn", "text")
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(items.text_similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


@query()
def j4_closest_codes(spark, d):
    from codeloom.operators import chains

    words = chains.occurrences(blocks(spark, d)).select(F.lower("factor").alias("word")).distinct()
    seen = items.code_counts(_items(spark, d)).select("code").distinct()
    return items.closest_codes(words, seen)


@query()
def x31_edit_similarity(spark, d):
    """Of a turn and the next one, by edits of characters; no SQL, as the driver's engine counts edits of bytes."""
    turns = table(spark, d, "conversations")
    a, b = turns.select("conv_id", "turn", "text"), turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(items.edit_similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


def _words_and_codes(spark, d):
    """Words of the documents, and those of the benchmark as codes, of three letters or more."""
    words = lambda name: table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("word")).distinct()
    return words("documents"), words("benchmark").withColumnRenamed("word", "code")


@query("""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as word from documents), c as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as code from benchmark),
r as (select word from w where word not in (select code from c)),
m as (select word, code, levenshtein(word, code) as e, greatest(length(word), length(code)) as n from r join c on abs(length(word) - length(code)) <= floor(greatest(length(word), length(code)) * 0.2 + 1e-9)),
b as (select word, max({'s': 1 - e / n::DOUBLE, 'c': code}) as b from m where e <= floor(n * 0.2 + 1e-9) group by 1)
select word, word as code, true as is_valid from w semi join c on word = code union all select word, coalesce(b.b.c, word), b.b is not null from r left join b using (word)""")
def j4_nearest_codes(spark, d):
    return items.nearest_codes(*_words_and_codes(spark, d))


@query(ITEMS + """, c as (select distinct code from pairs), w as (select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents))
select word, c.code is not null as is_valid from w left join c on c.code = w.word""")
def j3_code_lookup(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    codes = items.code_counts(_items(spark, d)).select("code").distinct()
    return words.join(codes, F.col("word") == F.col("code"), "left").select("word", F.col("code").isNotNull().alias("is_valid"))
