"""Queries of codebooks, classification, budgets and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.tables import NAME_HINTS, NEGATIVE, STOP_WORDS
from codeloom.operators import budget, chains, classify, codebook, items, memory, rules, storage
from codeloom.plans.base import BLOCKS, CO, blocks, query, table
from codeloom.plans.text_queries import ITEMS, SENT, WORDS
from codeloom.sources import writers


def _codebook(spark, d):
    """A codebook made of the documents: a code for each, with words of its text, quoted and listed, as definition."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,12})"), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    word = lambda half: F.get("w", F.floor((F.size("w") - 1) * half / 2).cast("int"))  # noqa: E731  the first, the middle and the last
    definition = F.concat(F.lit('Uses "'), word(0), F.lit('" here. Ex: '), word(1), F.lit(", "), word(2), F.lit("; more"))
    return docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("code_"), F.col("doc_id").cast("string")).alias("code"), definition.alias("definition"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEYS = rf"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]{{4,12}}') as w from documents), t as (select doc_id, w[1] as a, w[(len(w) - 1) // 2 + 1] as b, w[len(w)] as c from w where len(w) > 0),
k as (select distinct doc_id as ord, 'code_' || doc_id as code, unnest([a, b, c, 'uses', case when len(list_filter([{_STOPS}], lambda s: contains(a, s))) > 0 then 'here' else a end]) as keyword from t)"""


@query(_KEYS + " select keyword, code, ord from k")
def x30_keyword_index(spark, d):
    return codebook.keyword_index(_codebook(spark, d))


@query(_KEYS + ", g as (select keyword, string_agg(code, '|' order by ord) filter (rn <= 4) as codes from (select *, row_number() over (partition by keyword order by ord) as rn from k) group by 1) select * from g order by keyword limit 50")
def t4_first_keywords(spark, d):
    return codebook.first_keywords(codebook.keyword_index(_codebook(spark, d))).withColumn("codes", F.array_join("codes", "|"))


@query(_KEYS + " select length(keyword) as chars, count(distinct keyword) as n from k group by 1")
def f11_plausible_keywords(spark, d):
    terms = _codebook(spark, d).select(F.explode(codebook.keywords(F.col("definition"))).alias("t"))
    return terms.groupBy(F.length("t").cast("long").alias("chars")).agg(F.count_distinct("t").alias("n"))


_MODES = [" Dual ", "fatores_exploratorios", "CLASSIFICATORIOS", "exploratorios ", "Fatores_Classificatorios"]


@query(r"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') as w from documents)
select doc_id, case len(w) % 6 when 0 then 'exploratorios|classificatorios' when 1 then 'exploratorios' when 2 then 'classificatorios' when 3 then 'exploratorios' when 4 then 'classificatorios' else '' end as scopes from w""")
def f3_scopes(spark, d):
    """A text's number of words chooses how its scan mode is written; of every six one has its first word for a mode."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    mode = F.coalesce(F.get(F.array(*map(F.lit, _MODES)), F.size(w) % 6), F.get(w, F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.array_join(codebook.scopes_of(mode), "|").alias("scopes"))


@query(r"""with w as (select regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,12}') as w from documents), p as (select unnest(w) as code, unnest(range(len(w))) as i from w)
select distinct code from p where i % 2 = 0 or length(code) > 3""")
def x34_valid_codes(spark, d):
    """Every text as a listing: each word at an even place is a key, and quotes the word that follows it."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{2,12})"), F.lit(1))
    line = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("    "), F.initcap(x), F.lit(": \"see '"), F.coalesce(F.get("w", i + 1), F.lit("")), F.lit("'\"")))
    docs = table(spark, d, "documents").select(w.alias("w"))
    return codebook.valid_codes(docs.select(F.array_join(F.transform("w", line), "\n").alias("text")))


@query("""with k as (select distinct factor as keyword from (select unnest(regexp_extract_all(lower(text), '[a-z]{3,5}')) as factor from benchmark)), w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as keyword from documents)
select doc_id, keyword, count(*) as n from w semi join k using (keyword) group by 1, 2""")
def j12_keyword_tags(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,5})"), F.lit(1))).alias("keyword")
    return codebook.tag(table(spark, d, "documents"), table(spark, d, "benchmark").select(words).distinct())


_PLAIN = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"""with b as (select string_split({_PLAIN.format('text')}, ' ') as w from benchmark), k as (select distinct unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))))) as keyword from b),
t as (select doc_id, string_split({_PLAIN.format('text')}, ' ') as w from documents), g as (select doc_id, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))))) as keyword from t)
select doc_id, keyword, count(*) as n from g semi join k using (keyword) where keyword <> '' group by 1, 2""")
def j12_phrase_tags(spark, d):
    """The benchmark's words and its phrases of two and three words, as keywords."""
    w = F.split(codebook.plain(F.col("text")), " ", -1)
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0)), F.lit(1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    some = lambda n: F.when(F.size("w") >= n, runs(n)).otherwise(F.array().cast("array<string>"))
    phrases = table(spark, d, "benchmark").select(w.alias("w")).select(F.explode(F.concat(*map(some, (1, 2, 3)))).alias("keyword"))
    return codebook.tag(table(spark, d, "documents"), phrases)


@query(BLOCKS + ", o as (select distinct lower(code) as code from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as code from benchmark)) select distinct lower(factor) as code from occ where lower(factor) not in (select code from o)")
def j10_codes_without_entry(spark, d):
    known = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("code")).distinct()
    return chains.occurrences(blocks(spark, d)).select(F.lower("factor").alias("code")).distinct().join(known, "code", "left_anti")


@query("select doc_id as item_id, doc_id as source_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def j9_orphan_items(spark, d):
    found = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("source_id"))
    return codebook.orphans(found, table(spark, d, "labels").select(F.col("doc_id").alias("source_id")))


@query("select doc_id as item_id from documents where doc_id not in (select doc_id from labels where quality = 0 and doc_id is not null)")
def f8_acceptable_items(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    errors = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 0, "Broken").otherwise("OrphanItem").alias("kind"))
    return codebook.acceptable(docs, errors)


@query("""with v as (select doc_id, lang, n_chars, source from documents)
select doc_id as item_id, 'lang' as field, 'VALUES' as kind from v where lang not in ('en', 'de') union all select doc_id, 'size', 'SCALE' from v where n_chars not between 100 and 5000
union all select doc_id, 'chain', 'CHAIN' from v where doc_id % 3 <> 0 union all select doc_id, 'day', 'DATE' from v where doc_id % 2 = 1 union all select doc_id, 'note', 'REQUIRED' from v where doc_id % 5 = 0""")
def r14_template_violations(spark, d):
    docs = table(spark, d, "documents")
    chain = F.when(F.col("doc_id") % 3 == 0, "a -> enables -> b").when(F.col("doc_id") % 3 == 1, "a -> enables").otherwise("a -> shapes -> b")
    day = F.when(F.col("doc_id") % 2 == 0, "2024-02-29").otherwise("2023-02-29")
    note = F.when(F.col("doc_id") % 5 == 0, "").otherwise("some")
    given = F.create_map(F.lit("lang"), "lang", F.lit("size"), F.col("n_chars").cast("string"), F.lit("chain"), chain, F.lit("day"), day, F.lit("note"), note)
    values = docs.select(F.col("doc_id").alias("item_id"), F.explode(given).alias("field", "value"))
    specs = spark.createDataFrame(
        [("lang", "ENUMERATED", False, ["en", "de"], None, None), ("size", "SCALE", False, None, 100.0, 5000.0), ("chain", "CHAIN", False, ["enables"], None, None), ("day", "DATE", False, None, None, None), ("note", "TEXT", True, None, None, None)],
        "field string, type string, required boolean, allowed array<string>, low double, high double",
    )
    return codebook.violations(values, specs)


_FIELDS = BLOCKS + r""", v as (select d.doc_id as item_id, nullif(regexp_extract(text, '[a-z0-9._]+@[a-z0-9.]+'), '') as email, nullif(regexp_extract(text, 'https?://[a-z0-9./]+'), '') as link, lang, n_chars::VARCHAR as size,
 quality::VARCHAR as quality, b.factors[1] || ' -> ' || b.relations[1] || ' -> ' || b.factors[2] as chain, nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') as day
 from documents d left join labels using (doc_id) left join (select * from blocks where block_seq % 7 = 3 and block_seq < 7) b using (doc_id))"""


def _fields(spark, d):
    """(item_id, field, value): what the documents, their labels and their fourth blocks give; values may be missing."""
    found = lambda pattern: F.regexp_extract("text", pattern, 0)
    fourth = blocks(spark, d).where("block_seq % 7 = 3 and block_seq < 7").select("doc_id", F.concat_ws(" -> ", F.get("factors", F.lit(0)), F.get("relations", F.lit(0)), F.get("factors", F.lit(1))).alias("chain"))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").join(fourth, "doc_id", "left")
    own = {"email": found("[a-z0-9._]+@[a-z0-9.]+"), "link": found("https?://[a-z0-9./]+"), "lang": F.col("lang"), "size": F.col("n_chars").cast("string"), "quality": F.col("quality").cast("string"), "chain": F.col("chain"), "day": found("[0-9]{4}-[0-9]{2}-[0-9]{2}")}
    given = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in own.items()))
    return rows.select(F.col("doc_id").alias("item_id"), F.explode(given).alias("g")).select("item_id", "g.*")


_BUNDLES = [(["email", "link"],), (["quality", "chain"],), (["lang", "size"],), (["email", "quality", "chain"],)]


@query(_FIELDS + """select item_id, 'email+link' as bundle, case when email is null then 'link' else 'email' end as given, case when email is null then 'email' else 'link' end as missing from v where (email is null) <> (link is null)
union all select item_id, 'quality+chain', case when quality is null then 'chain' else 'quality' end, case when quality is null then 'quality' else 'chain' end from v where (quality is null) <> (chain is null)
union all select item_id, 'email+quality+chain', array_to_string(list_filter([case when email is not null then 'email' end, case when quality is not null then 'quality' end, case when chain is not null then 'chain' end], lambda x: x is not null), '|'),
 array_to_string(list_filter([case when email is null then 'email' end, case when quality is null then 'quality' end, case when chain is null then 'chain' end], lambda x: x is not null), '|') from v
 where not (email is null and quality is null and chain is null) and not (email is not null and quality is not null and chain is not null)""")
def r14_broken_bundles(spark, d):
    out = codebook.broken_bundles(_fields(spark, d), spark.createDataFrame(_BUNDLES, "fields array<string>"))
    return out.select("item_id", "bundle", F.array_join("given", "|").alias("given"), F.array_join("missing", "|").alias("missing"))


@query(_FIELDS + r"""select item_id, 'lang' as field, 'VALUES' as kind from v where lang not in ('en', 'de') union all select item_id, 'size', 'SCALE' from v where size::BIGINT not between 100 and 5000
union all select item_id, 'chain', 'CHAIN' from v where split_part(chain, ' -> ', 2) not in ('enables', 'influences') union all select item_id, 'quality', 'REQUIRED' from v where quality is null
union all select item_id, 'day', 'DATE' from v where day is not null and try_strptime(day, '%Y-%m-%d') is null union all select item_id, 'email+link', 'BUNDLE' from v where (email is null) <> (link is null)
union all select item_id, 'quality+chain', 'BUNDLE' from v where (quality is null) <> (chain is null)""")
def r14_project_violations(spark, d):
    """A template with every kind of rule over fields that the tables give."""
    specs = spark.createDataFrame(
        [("lang", "ENUMERATED", False, ["en", "de"], None, None), ("size", "SCALE", False, None, 100.0, 5000.0), ("chain", "CHAIN", False, ["enables", "influences"], None, None), ("day", "DATE", False, None, None, None), ("quality", "TEXT", True, None, None, None)],
        "field string, type string, required boolean, allowed array<string>, low double, high double",
    )
    return codebook.violations(_fields(spark, d), specs, spark.createDataFrame(_BUNDLES[:2], "fields array<string>"))


@query(BLOCKS + r"""select doc_id, block_seq, array_to_string(list_transform(case when block_seq % 4 = 1 then factors[1 : len(factors) - 1] else factors end, lambda f: case when block_seq % 4 = 2 then f else lower(f) end), '|') as nodes,
 array_to_string(relations, '|') as relations, block_seq % 4 in (0, 3) as valid from blocks""")
def x33_chain_syntax(spark, d):
    """Chains of the blocks in their text form; of every four one lacks its last node, and one has capitals."""
    k = F.col("block_seq") % 4
    nodes = F.transform(F.when(k == 1, F.slice("factors", F.lit(1), F.size("factors") - 1)).otherwise(F.col("factors")), lambda f: F.when(k == 2, f).otherwise(F.lower(f)))
    steps = F.flatten(F.transform("relations", lambda r, i: F.array_compact(F.array(F.get(nodes, i), r))))
    last = F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.element_at(nodes, -1)))
    text = F.concat(F.when(k == 3, F.lit("  ")).otherwise(F.lit("")), F.array_join(F.concat(steps, last), " -> "))
    nodes, relations, valid = chains.parts_of_chain(F.col("parts"))
    rows = blocks(spark, d).select("doc_id", "block_seq", chains.chain_parts(text).alias("parts"))
    return rows.select("doc_id", "block_seq", F.array_join(nodes, "|").alias("nodes"), F.array_join(relations, "|").alias("relations"), valid.alias("valid"))


@query("select o_orderkey, true as iso, strftime(o_orderdate, '%d/%m/%Y') = '' as slashed from orders")
def x36_iso_dates(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", T.is_iso_date(F.date_format(day, "yyyy-MM-dd")).alias("iso"), T.is_iso_date(F.date_format(day, "dd/MM/yyyy")).alias("slashed"))


@query(r"""with f as (select doc_id, trim(case when doc_id % 2 = 0 then '```text' || chr(10) || text || chr(10) || '```' else text end) as t from documents)
select doc_id, md5(trim(regexp_replace(regexp_replace(t, '^```[A-Za-z]*\s*\n?', ''), '\n?```\s*$', ''))) as bare from f""")
def x20_without_fences(spark, d):
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.without_fences(fenced)).alias("bare"))


@query(ITEMS + r""", r as (select interview_id, turn, sent, 'ITEM @' || interview_id || chr(10) || '    ordem_1a: "' || excerpt || '"' || chr(10) ||
 array_to_string(list_transform(codes, lambda c: '    ordem_2a: ' || c || chr(10) || '    justificativa_interna: "' || role || '"'), chr(10) || chr(10)) || chr(10) || 'END ITEM' as item from items)
select interview_id, count(*)::INT as n, md5(string_agg(item, chr(10) || chr(10) order by turn, sent)) as items from r group by 1""")
def x21_line_anchored_items(spark, d):
    """Items out of the interviews' rendered text, between remarks that name items within their lines."""
    text = F.replace(F.col("syn"), F.lit("END ITEM\n\n"), F.lit("END ITEM\nthen ITEM @no more END ITEM\n\n"))
    found = items.line_anchored(F.concat(F.lit("intro: ITEM @x END ITEM\n"), text))
    rows = items.documents(items.annotate(table(spark, d, "conversations"))).select("interview_id", found.alias("f"))
    return rows.select("interview_id", F.size("f").alias("n"), F.md5(F.array_join("f", "\n\n")).alias("items"))


@query(rf"""with s as (select doc_id, unnest(range(len(st)))::INT as pos, unnest(st) as s from (select doc_id, {SENT.format('text')} as st from documents))
select doc_id, pos, case when regexp_matches(lower(s), '\b(requires|depends on|needs|relies on|in order to|to achieve|limited by|constrained by)\b') then 'reverse'
 when regexp_matches(lower(s), '\b(leads to|causes|drives|results in|enables|facilitates|allows|increases|decreases|affects)\b') then 'keep' else 'none' end as direction from s""")
def r9_direction_cues(spark, d):
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rules.direction(cut).select("doc_id", "pos", "direction")


@query(BLOCKS + f"select doc_id, block_seq, len({SENT.format('excerpt')}) between 1 and 3 as ok from blocks")
def r10_excerpt_sentences(spark, d):
    return blocks(spark, d).select("doc_id", "block_seq", F.size(T.sentences(F.col("excerpt"))).between(1, 3).alias("ok"))


# --- classification --------------------------------------------------------------------------------------------------


def _answers(spark, d):
    """A model's answer for each factor, in the three forms that answers come in; form, ranges and lengths go by the factor's counts."""
    f = memory.frequency(blocks(spark, d)).withColumn("k", (F.col("frequency") + F.col("sources")) % 3)
    n, s = (F.col("frequency") % 17).cast("string"), (F.col("sources") % 6).cast("string")
    topic = F.lower(F.substring("factor", 1, 1))
    words = lambda w, n: F.array_join(F.array_repeat(F.lit(w), n.cast("int")), " ")
    why, what = words("because", F.col("frequency") % 70 + 1), words("thing", F.col("sources") % 90 + 1)
    head = F.concat(F.col("factor"), F.lit(","), topic, F.lit(","), n, F.lit(","), s, F.lit(',HIGH,"'), why, F.lit('","'), what, F.lit('"'))
    fields = F.concat(F.lit("Topic: "), topic, F.lit("\nAspect: "), n, F.lit("\nconfidence: LOW\nreasoning: '"), why, F.lit("'\n"))
    answer = F.when(F.col("k") == 0, F.concat(head, F.lit(',"up","down"'))).when(F.col("k") == 1, head).otherwise(fields)
    return storage.written(f.select("factor", answer.alias("answer")), "answers")  # as a model is asked once


POLES_SQL = ", ".join(f"({i}, '{w}', '{a}', '{b}')" for i, (w, a, b) in enumerate(classify.POLES))
CLASSIFIED = CO + rf""", poles(ord, word, a, b) as (values {POLES_SQL})
, k as (select *, (frequency + sources) % 3 as k, array_to_string(list_transform(range(frequency % 70 + 1), lambda i: 'because'), ' ') as why, array_to_string(list_transform(range(sources % 90 + 1), lambda i: 'thing'), ' ') as what from freq)
, pole as (select factor, min_by(a, ord) as a, min_by(b, ord) as b from k join poles on contains(lower(factor), word) group by 1)
, made as (select factor, coalesce(a, case when regexp_matches(lower(factor), '{"|".join(NEGATIVE)}') then 'Low ' || factor else 'High ' || factor end) as ma, coalesce(b, case when regexp_matches(lower(factor), '{"|".join(NEGATIVE)}') then 'High ' || factor else 'Low ' || factor end) as mb from k left join pole using (factor))
, cls as (select factor, lower(factor[1:1]) as topic, (frequency % 17)::INT as aspect, case when k < 2 then sources % 6 else 0 end::INT as dimension, case when k < 2 then 'HIGH' else 'LOW' end as confidence, why as reasoning,
   case when k < 2 then what else 'No description provided' end as factor_description, case when k = 0 then 'up' else ma end as rgt_element_a, case when k = 0 then 'down' else mb end as rgt_element_b, 0 as theorethical_significance,
   case k when 0 then 'csv9' when 1 then 'csv7' else 'fields' end as parse_path from k join made using (factor))"""


@query(CLASSIFIED + "select * from cls")
def x23_parsed_classification(spark, d):
    return classify.parse(_answers(spark, d))


@query(CLASSIFIED + "select * exclude (parse_path) from cls")
def k4_classification_csv(spark, d):
    """Classifications written as CSV, and read back."""
    path, rows = storage.folder(spark, "csv"), classify.parse(_answers(spark, d))
    writers.classification_csv(rows, path)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*(F.col(c).cast(kinds[c]).alias(c) for c in classify.COLUMNS))


@query(CLASSIFIED + "select factor, topic, aspect from cls")
def x24_labelled_fields(spark, d):
    return classify.parse(_answers(spark, d)).select("factor", "topic", "aspect")


@query(CLASSIFIED + "select topic, count(*) as factors, count(*) >= 3 as enough from cls group by 1")
def a10_topics(spark, d):
    return classify.topics(classify.parse(_answers(spark, d)))


@query(CLASSIFIED + "select topic, count(*) as factors, count(*) >= 3 as enough from cls group by 1 order by 2 desc, 1 limit 10")
def t2_top_topics(spark, d):
    return classify.top_topics(classify.parse(_answers(spark, d)))


@query(CLASSIFIED + "select count(*) as classifications, count(distinct topic) as topics, count(distinct topic) between 12 and 18 as ok from cls")
def r13_topic_summary(spark, d):
    return classify.topic_summary(classify.parse(_answers(spark, d)))


@query(CLASSIFIED + r"""select factor, unnest(list_filter([case when aspect not between 0 and 15 then 'aspect' end, case when dimension not between 0 and 4 then 'dimension' end,
 case when len(string_split(factor_description, ' ')) not between 40 and 80 then 'description' end, case when len(string_split(reasoning, ' ')) not between 40 and 60 then 'reasoning' end], lambda x: x is not null)) as kind from cls""")
def r12_range_errors(spark, d):
    return classify.range_errors(classify.parse(_answers(spark, d)))


_HINTS = [*(w for w, _, _ in classify.POLES), *NEGATIVE, *(w for w, _, _ in NAME_HINTS), "-"]
_HINTS_SQL = "[" + ", ".join(f"'{w}'" for w in _HINTS) + "]"
_NAMES = rf"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,12}}') as w, length(coalesce(text, '')) as n from documents),
f as (select doc_id, coalesce(upper(w[1][1:1]) || w[1][2:], '') || ' ' || {_HINTS_SQL}[len(w) % {len(_HINTS)} + 1] || ' ' || {_HINTS_SQL}[n % {len(_HINTS)} + 1] || ' ' || coalesce(w[len(w)], '') as factor from w)"""
_HINTED = lambda part: "case " + " ".join(f"when contains(lower(factor), '{h[0]}') then {'null' if h[part] is None else h[part]}" for h in NAME_HINTS) + " end::INT"


def _names(spark, d):
    """A name from each text: its first and last word, and between them two of all known keywords, by its numbers of words and of characters."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{4,12})"), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", w.alias("w"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    hint = lambda k: F.get(F.array(*map(F.lit, _HINTS)), k % len(_HINTS))
    end = lambda k: F.coalesce(F.get("w", k), F.lit(""))
    return docs.select("doc_id", F.concat_ws(" ", F.initcap(end(F.lit(0))), hint(F.size("w")), hint(F.col("n")), end(F.size("w") - 1)).alias("factor"))


@query(_NAMES + f""", p(ord, word, a, b) as (values {POLES_SQL}), h as (select doc_id, factor, min_by(a, ord) as a, min_by(b, ord) as b from f join p on contains(lower(factor), word) group by 1, 2)
select doc_id, f.factor, coalesce(a, case when regexp_matches(lower(f.factor), '{"|".join(NEGATIVE)}') then 'Low ' || f.factor else 'High ' || f.factor end) as pole_a, coalesce(b, case when regexp_matches(lower(f.factor), '{"|".join(NEGATIVE)}') then 'High ' || f.factor else 'Low ' || f.factor end) as pole_b from f left join h using (doc_id, factor)""")
def x25_bipolar_constructs(spark, d):
    a, b = classify.construct(F.col("factor"))
    return _names(spark, d).withColumns({"pole_a": a, "pole_b": b})


@query(_NAMES + f", p(ord, word, a, b) as (values {POLES_SQL}) select doc_id, min_by(word, ord) as keyword from f join p on contains(lower(factor), word) group by 1")
def j7_first_keyword(spark, d):
    words = rules.dimension(_names(spark, d), [(i, w) for i, (w, _, _) in enumerate(classify.POLES)], "ord int, word string")
    return _names(spark, d).join(words, F.contains(F.lower("factor"), F.col("word"))).groupBy("doc_id").agg(F.min_by("word", "ord").alias("keyword"))


@query(_NAMES + f" select doc_id, {_HINTED(1)} as aspect, {_HINTED(2)} as dimension from f")
def r17_name_hints(spark, d):
    aspect, dim = classify.name_hint(F.col("factor"))
    return _names(spark, d).select("doc_id", aspect.alias("aspect"), dim.alias("dimension"))


# --- budgets and costs -----------------------------------------------------------------------------------------------

_LOG = "with log as (select event_id, user_id as key, ts, floor(coalesce(value, 0))::INT as in_tokens, floor(coalesce(value, 0) / 4)::INT as out_tokens from events)"


@query(_LOG + """select event_id, key, count(*) over w as requests, (sum(in_tokens) over w)::BIGINT as in_used, (sum(out_tokens) over w)::BIGINT as out_used,
 count(*) over w > 50 or sum(in_tokens) over w > 30000 or sum(out_tokens) over w > 8000 as over from log window w as (partition by key order by epoch_us(ts) range between 59999999 preceding and current row)""")
def w5_rolling_budget(spark, d):
    return budget.over_limit(budget.rolling(budget.request_log(table(spark, d, "events"))))


@query(_LOG + """select event_id, key, count(*) over w as requests, (sum(in_tokens) over w)::BIGINT as in_used, (sum(out_tokens) over w)::BIGINT as out_used,
 count(*) over w >= 42 or sum(in_tokens) over w >= 25500 or sum(out_tokens) over w >= 6800 as over from log window w as (order by epoch_us(ts) range between 60000000 preceding and current row)""")
def w5_global_budget(spark, d):
    """One limit for all keys, as a client keeps it: calls of just 60 seconds ago count, and 85 % of the quota is the limit."""
    return budget.reached(budget.rolling(budget.request_log(table(spark, d, "events")), closed=True, key=None))


@query(_LOG + """select event_id, key, count(*) over w as requests, (sum(in_tokens) over w)::BIGINT as in_used, (sum(out_tokens) over w)::BIGINT as out_used,
 count(*) over w >= 42 or sum(in_tokens) over w >= 25500 or sum(out_tokens) over w >= 6800 as over from log window w as (partition by key order by epoch_us(ts) range between 86400000000 preceding and current row)""")
def w5_daily_budget(spark, d):
    """The same for each key, over a day."""
    return budget.reached(budget.rolling(budget.request_log(table(spark, d, "events")), 86_400, closed=True))


@query(f"""with p(model, i, o) as (values ('claude-3-haiku-20240307', 0.25::DOUBLE, 1.25::DOUBLE), ('claude-3-opus-20240229', 15.0::DOUBLE, 75.0::DOUBLE)),
t as (select doc_id, case doc_id % 3 when 0 then 'claude-3-haiku-20240307' when 1 then 'claude-3-opus-20240229' else 'unlisted' end as model, trunc({WORDS.format('text')} * 1.3::DOUBLE)::INT as n from documents)
select doc_id, t.model, round((3000 + n) / 1e6::DOUBLE * coalesce(i, 3.0::DOUBLE) + least(8000.0::DOUBLE, n * 0.5::DOUBLE) / 1e6::DOUBLE * coalesce(o, 15.0::DOUBLE), 8) as cost from t left join p using (model)""")
def x28_costs(spark, d):
    return budget.costs(table(spark, d, "documents"), _model())


@query(f"""with t as (select doc_id, trunc({WORDS.format('text')} * 1.3::DOUBLE)::INT as n from documents)
select doc_id, 'unlisted' as model, round(((3000 + n) / 1e6::DOUBLE * 3.0::DOUBLE + least(8000.0::DOUBLE, n * 0.5::DOUBLE) / 1e6::DOUBLE * 15.0::DOUBLE) * 2, 8) as cost from t""")
def x28_dual_costs(spark, d):
    """Both scopes, at the prices of a model that isn't listed."""
    return budget.costs(table(spark, d, "documents"), F.lit("unlisted"), dual=True)


def _model():
    return F.when(F.col("doc_id") % 3 == 0, "claude-3-haiku-20240307").when(F.col("doc_id") % 3 == 1, "claude-3-opus-20240229").otherwise("unlisted")


@query("""select case doc_id % 3 when 0 then 'claude-3-haiku-20240307' when 1 then 'claude-3-opus-20240229' else 'unlisted' end as model, doc_id, case doc_id % 3 when 0 then 0.25 when 1 then 15.0 else 3.0 end::DOUBLE as price_in, case doc_id % 3 when 0 then 1.25 when 1 then 75.0 else 15.0 end::DOUBLE as price_out from documents""")
def j8_price_lookup(spark, d):
    return budget.priced(table(spark, d, "documents").select("doc_id", _model().alias("model")))


@query(f"""with p(model, i, o) as (values ('claude-3-haiku-20240307', 0.25::DOUBLE, 1.25::DOUBLE), ('claude-3-opus-20240229', 15.0::DOUBLE, 75.0::DOUBLE)),
t as (select case doc_id % 3 when 0 then 'claude-3-haiku-20240307' when 1 then 'claude-3-opus-20240229' else 'unlisted' end as model, trunc({WORDS.format('text')} * 1.3::DOUBLE)::INT as n from documents)
select t.model, count(*) as docs, round(sum(round((3000 + n) / 1e6::DOUBLE * coalesce(i, 3.0::DOUBLE) + least(8000.0::DOUBLE, n * 0.5::DOUBLE) / 1e6::DOUBLE * coalesce(o, 15.0::DOUBLE), 8)), 4) as cost from t left join p using (model) group by 1""")
def a16_cost_total(spark, d):
    out = budget.costs(table(spark, d, "documents"), _model())
    return out.groupBy("model").agg(F.count("*").alias("docs"), F.round(F.sum("cost"), 4).alias("cost"))


@query("""select count(*) as files_total, count(*) filter (quality = 1) as files_processed, count(*) filter (quality = 0) as files_failed, count(*) filter (quality is null) as files_skipped, round(sum(n_chars / 1e6::DOUBLE), 6) as total_cost, round(sum(n_chars / 1000.0::DOUBLE), 6) as duration from documents left join labels using (doc_id)""")
def a12_run_summary(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "processed").when(F.col("quality") == 0, "failed").otherwise("skipped")
    log = rows.select(status.alias("status"), (F.col("n_chars") / 1000.0).alias("duration"), (F.col("n_chars") / 1e6).alias("estimated_cost"))
    return budget.run_summary(log)


@query("""select doc_id::VARCHAR as file, case when quality = 1 then 'processed' when quality = 0 then 'failed' else 'skipped' end as status, n_chars / 1000.0::DOUBLE as duration from documents left join labels using (doc_id)""")
def k5_run_log(spark, d):
    """A log of the documents' states, appended in two parts, and read back."""
    path = storage.folder(spark, "log")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "processed").when(F.col("quality") == 0, "failed").otherwise("skipped")
    log = rows.select(F.col("doc_id").cast("string").alias("file"), status.alias("status"), F.lit(None).cast("string").alias("output"), (F.col("n_chars") / 1000.0).alias("duration"), (F.col("n_chars") / 1e6).alias("estimated_cost"), F.lit(None).cast("string").alias("error"))
    for part in (F.col("status") == "skipped", F.col("status") != "skipped"):
        writers.run_log(log.where(part), path)
    return spark.read.parquet(path).select("file", "status", "duration")
