"""Tagged documents: rendering coded blocks as text, reading that text back, and repairing what comes out of a model."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


# The marks of the tagged format.
HEADER = r"(?s)\[-begin_header-\](.*?)\[-end_header-\]"
MARKS = r"\[-begin-\]|\[-end-\]"
BLOCK = r"(?s)\[-begin-\]\s*(.*?)\s*\[-end-\]"


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def render_block(ref: Column, excerpt: Column, description: Column, factors: Column, relations: Column) -> Column:
    """[@ref@][!excerpt!][%description%][#A#][&r&][#B#] ..., wrapped in begin and end marks."""
    chain = F.array_join(F.transform(factors, lambda f, i: _cat("[#", f, "#]", F.coalesce(_cat("[&", F.get(relations, i), "&]"), F.lit("")))), "")
    return _cat("[-begin-][@", ref, "@][!", excerpt, "!][%", description, "%]", chain, "[-end-]")


def header(ref: Column, description: Column, method: Column) -> Column:
    return _cat("[-begin_header-]\nreferencia_bibtex:", ref, "\ndescricao:[", description, "]\nmetodo:[", method, "]\n[-end_header-]")


def render(blocks: DataFrame) -> DataFrame:
    """(ref, tagged): a document's header and its blocks in order, one string per document."""
    ref = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    block = render_block(ref, F.col("excerpt"), _cat("d", F.col("block_seq").cast("string")), F.col("factors"), F.col("relations"))
    rows = blocks.select(ref.alias("ref"), "block_seq", block.alias("block")).groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("block_seq", "block"))).alias("b"))
    text = F.array_join("b.block", "\n\n")
    return rows.select("ref", _cat(header(F.col("ref"), F.lit("Coded text"), F.lit("Not specified")), "\n\n", text).alias("tagged"))


def parse(tagged: DataFrame) -> DataFrame:
    """(ref, block_seq, excerpt, description, factors, relations) of every block with a factor; documents without a reference have none."""
    ref = F.regexp_extract("tagged", r"referencia_bibtex:\s*(\S+)", 1)
    # what BLOCK finds, by whole marks: in the text before each end mark, what follows the first begin mark
    begin = F.lit("[-begin-]")
    before = F.split("tagged", r"\[-end-\]", -1)
    raw = F.filter(F.slice(before, 1, F.size(before) - 1), lambda x: F.contains(x, begin))
    # the columns come first, as an explosion beside an expression of the text would copy the text to every block, and an inner one would work them out twice
    rows = tagged.select(ref.alias("ref"), raw.alias("raw")).where("ref <> ''").select("ref", F.posexplode_outer("raw").alias("block_seq", "x")).where("block_seq is not null")
    rows = rows.select("ref", "block_seq", F.btrim(F.substring("x", F.position(begin, "x") + 9, F.length("x")), F.lit(" \t\n\x0b\f\r")).alias("b"))
    every = lambda p: F.regexp_extract_all("b", F.lit(p), F.lit(1))
    rows = _with(rows, factors=every(r"\[#(.*?)#\]"), relations=every(r"\[&(.*?)&\]")).where(F.size("factors") > 0)
    after = lambda mark: F.when(F.contains("b", F.lit(mark)), F.substring("b", F.position(F.lit(mark), "b") + 2, F.length("b")))
    upto = lambda c, mark: F.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, 1)).alias(c)
    own = rows.select("*", after("[!").alias("excerpt"), after("[%").alias("description"))
    own = own.select("ref", "block_seq", "b", "factors", "relations", upto("excerpt", "!]"), upto("description", "%]"))
    # a line's end within the marks leaves the tag to the pattern, which reads on for one without
    in_line = lambda c: ~reduce(or_, (F.contains(c, F.lit(x)) for x in "\n\r\x85\u2028\u2029"))
    tag = lambda c, p: F.when(in_line(c), F.col(c)).otherwise(F.regexp_extract("b", p, 1))
    # plain words in title case need no work; a line separator is in no factor
    other = F.array_join("factors", "\u2028").rlike("[^A-Za-z\u2028]|(?:^|\u2028)[a-z]|[A-Za-z][A-Z]")
    titled = F.when(other, F.transform("factors", lambda f: T.title_case(f))).otherwise(F.col("factors"))
    return own.select(
        "ref", "block_seq", F.trim(tag("excerpt", r"\[!(.*?)!\]")).alias("excerpt"), tag("description", r"\[%(.*?)%\]").alias("description"), titled.alias("factors"), "relations",
    )


def quoted(x: Column) -> Column:
    """A column's value as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _once_marked(block: Column, ref: Column, mark: Column) -> Column:
    """A block in which repeated reference marks are one."""
    return F.regexp_replace(block, _cat(r"\[@", quoted(ref), r"@\](\[@", quoted(ref), r"(@)?\])+"), F.regexp_replace(mark, r"([\\$])", r"\\$1"))


def repair_block(block: Column) -> Column:
    """A block with one reference mark, one closing mark, and its excerpt in marks; null if it has no reference or no description."""

    def in_marks(once: Column, mark: Column) -> Column:
        stop, begin = F.position(F.lit("[%"), once), F.position(mark, once) + F.length(mark)

        def wrapped(inner: Column) -> Column:
            fine = F.startswith(inner, F.lit("[!")) & F.endswith(inner, F.lit("!]"))
            bare = F.replace(F.replace(inner, F.lit("[!"), F.lit("")), F.lit("!]"), F.lit(""))
            return F.when(fine, once).otherwise(F.concat(F.substring(once, F.lit(1), begin - 1), F.lit("[!"), bare, F.lit("!]"), F.substring(once, stop, F.length(once))))

        return F.when(stop > 0, _let(F.trim(F.substring(once, begin, F.greatest(stop - begin, F.lit(0)))), wrapped))

    def by_ref(ref: Column) -> Column:
        mark = _cat("[@", ref, "@]")
        return _let(F.replace(_once_marked(block, ref, mark), F.lit("!]!]"), F.lit("!]")), lambda once: in_marks(once, mark))

    return F.when(block.rlike(r"\[@(.*?)@\]"), _let(F.regexp_extract(block, r"\[@(.*?)@\]", 1), by_ref))


def _in_marks(block: Column) -> Column:
    """A block without an excerpt in marks gets them around what stands between its reference and its description."""
    stop, begin = F.position(F.lit("[%"), block), F.position(F.lit("@]"), block) + 2
    inner = F.trim(F.substring(block, begin, F.greatest(stop - begin, F.lit(0))))
    return F.when(block.rlike(r"\[!.*?!\]") | (stop <= 1), block).otherwise(F.concat(F.substring(block, F.lit(1), begin - 1), F.lit("[!"), inner, F.lit("!]"), F.substring(block, stop, F.length(block))))


def _fixed(block: Column, ref: Column) -> Column:
    """A block with its reference mark once and in front, single closing marks, and its excerpt in marks."""
    mark = _cat("[@", ref, "@]")
    marked = _let(_once_marked(block, ref, mark), lambda b: F.replace(F.when(F.contains(b, mark), b).otherwise(F.concat(mark, b)), F.lit("!]!]"), F.lit("!]")))
    return _let(marked, _in_marks)


def _sentinel(ref: Column, description: Column, excerpt: str, why: Column, chain: str) -> Column:
    return F.concat(header(ref, description, F.lit("Not applicable")), _cat("\n\n[-begin-][@", ref, "@][!", excerpt, "!][%", why, "%]", chain, "[-end-]"))


def _chained(text: Column) -> Column:
    return F.contains(text, F.lit("[#")) & F.contains(text, F.lit("[&"))


def _with(df: DataFrame, **cols: Column) -> DataFrame:
    """df with further columns that are computed once for each row, as the optimizer doesn't move them into what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def staged(answers: DataFrame) -> DataFrame:
    """answers(ref, answer, …) with the steps of their reading: head, whole blocks (repaired), recoverable parts, and status.

    Status: no_chains (the model says so), ok (header and blocks), recovered (header or blocks missing, but chains in the parts between the
    marks), blocks_only (blocks, but neither header nor chains), failed.
    """
    head = F.regexp_extract("answer", HEADER, 1)
    whole = F.filter(F.transform(F.regexp_extract_all("answer", F.lit(BLOCK), F.lit(1)), repair_block), lambda b: b.isNotNull())
    rows = _with(answers, has_head=F.col("answer").rlike(HEADER), head=_cat("[-begin_header-]", F.btrim(head, F.lit(" \t\n\r")), "[-end_header-]"), whole=whole)
    lacking = ~F.col("has_head") | (F.size("whole") == 0)
    parts = F.when(lacking, F.filter(F.split("answer", MARKS, -1), _chained)).otherwise(F.array().cast("array<string>"))
    rows = _with(rows, parts=parts)
    status = (
        F.when(F.contains("answer", F.lit("NO EXTRACTABLE CHAINS")), "no_chains").when(~lacking, "ok").when(F.size("parts") > 0, "recovered").when(F.size("whole") > 0, "blocks_only").otherwise("failed")
    )
    return _with(rows, status=status)


def validated(answers: DataFrame, recovered: str = "Abstract on energy technology acceptance") -> DataFrame:
    """(…, status, output): a model's answers as tagged documents that parse() reads.

    Whole answers keep header and blocks, each block fixed. Recovered ones get a header if they have none (with the description
    ``recovered``) and the parts with chains as blocks. No chains, and failures, give sentinel documents, whose factors count as such
    in a memory unless it drops them.
    """
    given = [c for c in answers.columns if c not in ("status", "output", "answer")]
    rows, ref = staged(answers), F.col("ref")
    made = header(ref, F.lit(recovered), F.lit("Not specified"))
    head = F.when(F.col("has_head"), F.col("head")).when(F.col("status") == "recovered", made)
    blocks = F.transform(F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.col("whole")), lambda b: _cat("[-begin-]", _fixed(b, ref), "[-end-]"))
    rows = _with(rows.select(*given, "answer", "status", head.alias("head"), "parts", "whole"), body=blocks)
    reason = no_chains_reason(F.col("answer"))
    output = (
        F.when(F.col("status") == "no_chains", _sentinel(ref, _cat("No extractable chains: ", reason), "NO EXTRACTABLE CHAINS", reason, "[#No Analysis#]"))
        .when(F.col("status") == "failed", _sentinel(ref, F.lit("Analysis could not be completed"), "No valid analysis generated", F.lit("Format issues in response"), "[#Format Error#][&causes&][#Missing Analysis#]"))
        .otherwise(F.array_join(F.concat(F.array_compact(F.array("head")), F.col("body")), "\n\n"))
    )
    return rows.select(*given, "status", output.alias("output"))


def classify_response(response: Column) -> Column:
    """What a model's answer needs, as in staged()."""
    whole = F.exists(F.regexp_extract_all(response, F.lit(BLOCK), F.lit(1)), lambda b: repair_block(b).isNotNull())
    some = F.exists(F.split(response, MARKS, -1), _chained)
    return (
        F.when(F.contains(response, F.lit("NO EXTRACTABLE CHAINS")), "no_chains").when(whole & response.rlike(HEADER), "ok").when(some, "recovered").when(whole, "blocks_only").otherwise("failed")
    )


def no_chains_reason(response: Column) -> Column:
    """Why a model found no chains, without markup; a stated text if it gives no reason."""
    reason = F.trim(F.replace(F.regexp_extract(response, r"NO EXTRACTABLE CHAINS[:\s-]*([^\n]+)", 1), F.lit("*"), F.lit("")))
    return F.when(F.contains(response, F.lit("NO EXTRACTABLE CHAINS")), F.when(reason != "", reason).otherwise("Abstract does not contain relevant content"))


def combine(parts: DataFrame) -> DataFrame:
    """(doc_id, n_parts, n_blocks, header, blocks): the first part's header and all parts' blocks in order, under the id of the whole.

    ``parts`` has doc_id, part, header and blocks (array of strings).
    """
    whole = parts.groupBy("doc_id").agg(
        F.count("*").alias("n_parts"), F.min_by("header", "part").alias("header"), F.array_sort(F.collect_list(F.struct("part", "blocks"))).alias("p")
    )
    blocks = F.flatten(F.transform("p", lambda p: p["blocks"]))
    own = whole.select("doc_id", "n_parts", F.coalesce("header", F.lit("")).alias("header"), blocks.alias("blocks"))
    ref = F.col("doc_id").cast("string")
    clean = F.transform("blocks", lambda b: F.regexp_replace(b, F.lit(r"\[@.*?_part\d+@\]"), _cat("[@", ref, "@]")))
    return own.select("doc_id", "n_parts", F.size("blocks").alias("n_blocks"), F.regexp_replace("header", F.lit(r"referencia_bibtex:.*?_part\d+"), _cat("referencia_bibtex:", ref)).alias("header"), clean.alias("blocks"))


