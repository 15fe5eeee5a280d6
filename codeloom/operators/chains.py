"""Coded blocks and what unfolds from them: occurrences of factors, edges between them, pairs in a block."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.tables import RELATIONS

CHAIN = 4
#: Characters of an excerpt: the default annotator cuts longer sentences into pieces, so that a text without sentence ends doesn't grow with its square.
EXCERPT = 400


def relation_at(block_seq: Column, pos: Column) -> Column:
    """The relation that the default annotator puts at a position of a block: the vocabulary in turn."""
    return F.element_at(F.array(*map(F.lit, RELATIONS)), ((block_seq + pos) % len(RELATIONS) + 1).cast("int"))


def annotate(docs: DataFrame) -> DataFrame:
    """(doc_id, block_seq, excerpt, factors, relations): the deterministic default annotator.

    In every sentence (every EXCERPT characters of a longer one), each run of CHAIN short words is a chain of factors; a
    last run needs two words. Stands in for a model call wherever none is configured; one row per block, all work in the
    row, no shuffle.
    """
    # functions of arrays are interpreted element by element: a sentence's chains are cut from one string of its title-cased words, and taken apart once they are rows
    words = lambda e: F.initcap(F.array_join(F.regexp_extract_all(F.lower(e), F.lit(r"[a-z]{3,5}"), F.lit(0)), " "))
    runs = lambda e: F.regexp_extract_all(words(e), F.lit(rf"\S+(?: \S+){{1,{CHAIN - 1}}}"), F.lit(0))
    found = F.transform(
        F.flatten(F.transform(T.sentences(F.col("text")), lambda e: T.pieces(e, EXCERPT))),
        lambda e: F.transform(runs(e), lambda f: F.struct(e.alias("e"), f.alias("f"))),
    )
    # an outer explosion, as for others Spark looks first whether the array has elements, and works it out twice
    rows = docs.select("doc_id", F.flatten(found).alias("bs")).select("doc_id", F.posexplode_outer("bs").alias("block_seq", "b")).where("block_seq is not null")
    rows = rows.select("doc_id", "block_seq", F.col("b.e").alias("excerpt"), F.split("b.f", " ").alias("factors"))
    # relations are a stretch of the vocabulary, repeated
    turns = F.array(*(F.lit(RELATIONS[k % len(RELATIONS)]) for k in range(len(RELATIONS) + CHAIN)))
    between = F.slice(turns, F.col("block_seq") % len(RELATIONS) + 1, F.size("factors") - 1)
    return rows.select("*", between.alias("relations"))


def occurrences(blocks: DataFrame) -> DataFrame:
    """A row for each factor of each block; blocks without factors have none."""
    return blocks.select("*", F.posexplode_outer("factors").alias("pos", "factor")).where("pos is not null")  # outer, as in annotate()


def edges(blocks: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, block_seq, pos, src, rel, dst), after the columns ``keep`` of the block: factor i, relation i, factor i + 1; surplus relations and the last factor have no edge."""
    n = F.least(F.size("relations"), F.size("factors") - 1)
    steps = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n),
        lambda i: F.struct(
            i.alias("pos"), F.get("factors", i).alias("src"), F.get("relations", i).alias("rel"), F.get("factors", i + 1).alias("dst")
        ),
    )
    return blocks.select("doc_id", "block_seq", *keep, F.explode(steps).alias("s")).select("doc_id", "block_seq", *keep, "s.*")


#: A document's places are below this; document ids times it are within 38 digits.
_PLACES = 1 << 63


def place_key(block_seq: str = "block_seq", doc_id: str = "doc_id") -> Column:
    """A block's first place as a number that sorts by doc_id and block_seq: a fixed-width one, so that its minimum is found by hash aggregates without sorting rows.

    The last 32 bits are left to places in the block.
    """
    return F.col(doc_id).cast("decimal(38,0)") * F.lit(Decimal(_PLACES)) + (F.col(block_seq).cast("long") * (1 << 32)).cast("decimal(19,0)")


def place_of(key: str) -> Column:
    """What a place key was made of, as a struct of doc_id, block_seq and the bits of the place in the block."""
    return F.expr(f"""transform(array(pmod(`{key}`, {_PLACES}BD)), r -> struct(
        cast((`{key}` - r) / {_PLACES}BD as long) as doc_id, cast(shiftright(cast(r as long), 32) as int) as block_seq, cast(r as long) & 4294967295 as at))[0]""")


def co_occurrences(blocks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(factor, co_factor, n, first_seen): pairs of different factors of a block, made in the row and summed before the shuffle.

    ``only`` names the factors (a few, as it is broadcast) whose pairs are wanted. Numbers as document ids, with 65,536 factors to a
    block at most, make it a sum and a minimum of fixed width; other ids are compared as structs, for which tasks sort their pairs.
    """
    numbers = blocks.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if numbers:
        own = occurrences(blocks.select("factors", place_key().alias("_key")))
        at = lambda x, y: (F.col("_key") + (F.col(x).cast("long") * 65536 + F.col(y)).cast("decimal(19,0)")).cast("decimal(38,0)")
        if only is None:
            # each two places once, as both orders of a pair have one count; the first place of either order is kept, as rows may repeat a document's id
            two = own.select("_key", "pos", "factor", F.posexplode_outer(F.slice("factors", F.col("pos") + 2, F.size("factors"))).alias("step", "g")).where("factor <> g")
            low, pos2 = F.col("factor") < F.col("g"), F.col("pos") + F.col("step") + 1
            rows = two.select("_key", F.least("factor", "g").alias("lo"), F.greatest("factor", "g").alias("hi"), F.when(low, F.col("pos")).otherwise(pos2).alias("x"), F.when(low, pos2).otherwise(F.col("pos")).alias("y"))
            summed = rows.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min(at("x", "y")).alias("a"), F.min(at("y", "x")).alias("b"))
            side = lambda x, y, k: F.struct(F.col(x).alias("factor"), F.col(y).alias("co_factor"), F.col(k).alias("first"))
            sides = summed.select("n", F.explode(F.array(side("lo", "hi", "a"), side("hi", "lo", "b"))).alias("s")).select("n", "s.*")
        else:
            own = own.join(F.broadcast(only), "factor", "left_semi")
            rows = own.select("_key", "pos", "factor", F.posexplode("factors").alias("pos2", "co_factor")).where("factor <> co_factor")
            sides = rows.groupBy("factor", "co_factor").agg(F.count("*").alias("n"), F.min(at("pos", "pos2")).alias("first"))
        p = F.col("p")
        first = F.struct(p["doc_id"].alias("doc_id"), p["block_seq"].alias("block_seq"), (p["at"] / 65536).cast("int").alias("pos"), (p["at"] % 65536).cast("int").alias("pos2"))
        return sides.select("factor", "co_factor", "n", place_of("first").alias("p")).select("factor", "co_factor", "n", first.alias("first_seen"))
    others = F.filter(F.transform("factors", lambda g, j: F.struct(g.alias("co_factor"), j.alias("pos2"))), lambda x: x["co_factor"] != F.col("factor"))
    own = occurrences(blocks) if only is None else occurrences(blocks).join(F.broadcast(only), "factor", "left_semi")
    pairs = own.select("doc_id", "block_seq", "pos", "factor", F.explode(others).alias("o"))
    return pairs.groupBy("factor", F.col("o.co_factor").alias("co_factor")).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "block_seq", "pos", "o.pos2")).alias("first_seen")
    )


def chain_parts(text: Column) -> Column:
    """The elements of ``A -> REL -> B -> …``. Kept as a column, the text is cut once for all that parts_of_chain() says of it."""
    return F.split(F.trim(text), r"\s*->\s*")


def parts_of_chain(parts: Column) -> tuple[Column, Column, Column]:
    """nodes, relations and validity of a chain's elements: an odd number of them, snake-case nodes."""
    nodes = F.filter(parts, lambda x, i: i % 2 == 0)
    relations = F.filter(parts, lambda x, i: i % 2 == 1)
    valid = (F.size(parts) % 2 == 1) & (F.size(parts) >= 3) & F.forall(nodes, lambda n: n.rlike("^[a-z][a-z0-9_]*$"))
    return nodes, relations, valid


def parse_chain(text: Column) -> tuple[Column, Column, Column]:
    """nodes, relations and validity of ``A -> REL -> B -> …``."""
    return parts_of_chain(chain_parts(text))


def distinct_edges(e: DataFrame) -> DataFrame:
    """Edges without those that repeat another up to case and blanks; the first in document order stays."""
    key = [F.lower(F.trim(c)).alias(f"{c}_n") for c in ("src", "rel", "dst")]
    first = F.min(F.struct("doc_id", "block_seq", "pos", "src", "rel", "dst")).alias("e")
    return e.groupBy(*key).agg(first, F.count("*").alias("n")).select("e.*", "n")


def split_pathways(blocks: DataFrame) -> DataFrame:
    """Blocks in which a factor repeats hold parallel pathways: those become one block for each edge, the others stay."""
    repeats = F.size("factors") != F.size(F.array_distinct("factors"))
    one = edges(blocks.where(repeats)).select(
        "doc_id", "block_seq", F.col("pos").alias("path"), F.array("src", "dst").alias("factors"), F.array("rel").alias("relations")
    )
    rest = blocks.where(~repeats).select("doc_id", "block_seq", F.lit(0).alias("path"), "factors", "relations")
    return one.unionByName(rest)
