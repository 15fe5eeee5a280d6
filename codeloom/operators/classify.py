"""Classification of factors: reading a model's answers, bipolar constructs, hints, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tables import NAME_HINTS, NEGATIVE, POLES

COLUMNS = ["factor", "topic", "aspect", "dimension", "confidence", "reasoning", "factor_description", "rgt_element_a", "rgt_element_b", "theorethical_significance"]
# The forms of an answer's line, with seven fields and with nine.
_HEAD = r'([^,]+),([^,]+),(\d+),(\d+),(LOW|MEDIUM|HIGH),"([^"]+)","([^"]+)"'
_FULL = _HEAD + r',"([^"]+)","([^"]+)"'


def construct(factor: Column) -> tuple[Column, Column]:
    """The two poles of a factor: of the first keyword in its name, else made from the name."""
    low = F.lower(factor)
    poles = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(a).alias("a"), F.lit(b).alias("b")) for w, a, b in POLES))
    first = F.get(F.filter(poles, lambda p: F.contains(low, p["word"])), F.lit(0))
    negative = low.rlike("|".join(NEGATIVE))
    high, below = F.concat(F.lit("High "), factor), F.concat(F.lit("Low "), factor)
    return F.coalesce(first["a"], F.when(negative, below).otherwise(high)), F.coalesce(first["b"], F.when(negative, high).otherwise(below))


def labelled(text: Column, names: list[str], pattern: str = r"([^\n,]+)") -> Column:
    """The value after the first of the names that has one (``name: value``), without quotes; null if none has."""
    found = [F.regexp_extract(text, rf"(?i){n}[:\s]+{pattern}", 1) for n in names]
    return F.coalesce(*(F.when(f != "", F.btrim(F.trim(f), F.lit("\"'"))) for f in found))


def parse(answers: DataFrame) -> DataFrame:
    """The classification of each of answers(factor, answer), and parse_path: csv9, csv7 or fields.

    A line with nine fields, else one with seven, else fields by their labels with stated defaults; the factor's name is always the
    given one.
    """
    # each form is looked for once; its fields are then taken from the line that was found
    fields = lambda c, form, n: F.split(F.regexp_replace(c, form, "\u0001".join(f"${k}" for k in range(1, n + 1))), "\u0001", -1)
    answers = answers.select("factor", "answer", F.regexp_extract("answer", _HEAD, 0).alias("_head"), F.regexp_extract("answer", _FULL, 0).alias("_full"))
    answers = answers.select("*", fields(F.col("_head"), _HEAD, 7).alias("_seven"), fields(F.col("_full"), _FULL, 9).alias("_nine"))
    full, short = F.col("_full") != "", F.col("_head") != ""
    group = lambda k: F.trim(F.get("_seven", F.lit(k - 1)))
    a, b = construct(F.col("factor"))
    own_a, own_b = labelled(F.col("answer"), ["rgt_element_a", "rgt_a", "pole_a"]), labelled(F.col("answer"), ["rgt_element_b", "rgt_b", "pole_b"])
    both = (F.coalesce(own_a, F.lit("")) != "") & (F.coalesce(own_b, F.lit("")) != "")
    pick = lambda k, names, default: F.when(short, group(k)).otherwise(F.coalesce(labelled(F.col("answer"), names), F.lit(default)))
    number = lambda k, name: F.when(short, group(k)).otherwise(labelled(F.col("answer"), [name], r"(\d+)"))
    pole = lambda k, own, made: F.when(full, F.trim(F.get("_nine", F.lit(k - 1)))).when(~short & both, own).otherwise(made)
    topic = pick(2, ["topic", "thematic_group", "category"], "Uncategorized")
    return answers.select(
        "factor", F.when(topic == "", "Uncategorized").otherwise(topic).alias("topic"), F.coalesce(number(3, "aspect").try_cast("int"), F.lit(0)).alias("aspect"),
        F.coalesce(number(4, "dimension").try_cast("int"), F.lit(0)).alias("dimension"), pick(5, ["confidence"], "MEDIUM").alias("confidence"),
        pick(6, ["reasoning"], "Classification based on available context").alias("reasoning"),
        pick(7, ["description", "factor_description"], "No description provided").alias("factor_description"),
        pole(8, own_a, a).alias("rgt_element_a"), pole(9, own_b, b).alias("rgt_element_b"), F.lit(0).alias("theorethical_significance"),
        F.when(full, "csv9").when(short, "csv7").otherwise("fields").alias("parse_path"),
    )


def topics(classified: DataFrame) -> DataFrame:
    """(topic, factors) with whether a topic has the three factors that it needs."""
    n = F.count("*")
    return classified.groupBy("topic").agg(n.alias("factors"), (n >= 3).alias("enough"))


def topic_summary(classified: DataFrame) -> DataFrame:
    n = F.count_distinct("topic")
    return classified.agg(F.count("*").alias("classifications"), n.alias("topics"), n.between(12, 18).alias("ok"))


def top_topics(classified: DataFrame, n: int = 10) -> DataFrame:
    return topics(classified).orderBy(F.desc("factors"), "topic").limit(n)


def range_errors(classified: DataFrame) -> DataFrame:
    """(factor, kind) of values outside their ranges and texts outside their lengths."""
    words = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != ""))
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("aspect").between(0, 15), F.lit("aspect")), F.when(~F.col("dimension").between(0, 4), F.lit("dimension")),
            F.when(~F.col("confidence").isin("LOW", "MEDIUM", "HIGH"), F.lit("confidence")), F.when(~words("factor_description").between(40, 80), F.lit("description")),
            F.when(~words("reasoning").between(40, 60), F.lit("reasoning")),
        )
    )
    return classified.select("factor", F.explode(kinds).alias("kind"))


def name_hint(factor: Column) -> tuple[Column, Column]:
    """Aspect and dimension that a name hints at, by its first hint; null without one."""
    aspect = dimension = None
    for word, x, y in NAME_HINTS:
        hit, y = F.contains(F.lower(factor), F.lit(word)), F.lit(y).cast("int")
        aspect, dimension = (F.when(hit, x), F.when(hit, y)) if aspect is None else (aspect.when(hit, x), dimension.when(hit, y))
    return aspect, dimension
