"""Queries that code the tables through the hook for a model, from texts to tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from codeloom.functions.tables import RELATIONS
from codeloom.operators import coding, items, tagged
from codeloom.plans.base import query, table

SCOPES = ["exploratorios", "classificatorios"]
_STOP = re.compile(r"(?<=[.!?])\s+")
_FACTOR = re.compile(r"[a-z]{3,5}")


def tagged_answer(ref: str, scope: str, text: str) -> str:
    """A stand-in for a model: a block of the first four short words of each sentence that has two."""
    blocks = []
    for sentence in _STOP.split(text):
        words = _FACTOR.findall(sentence.lower())[:4]
        if len(words) > 1:
            chain = "".join(f"[#{w}#]" + (f"[&{RELATIONS[k % len(RELATIONS)]}&]" if k + 1 < len(words) else "") for k, w in enumerate(words))
            blocks.append(f"[-begin-][@{ref}@][!{' '.join(sentence.split())[:200]}!][%coded%]{chain}[-end-]")
    if not blocks:
        return f"NO EXTRACTABLE CHAINS: nothing in {ref}"
    return f"[-begin_header-]\nreferencia_bibtex:{ref}\ndescricao:[x]\nmetodo:[y]\n[-end_header-]\n" + "\n".join(blocks)


def item_answer(ref: str, scope: str, text: str) -> str:
    """A stand-in for a model: an item for each sentence of a line, with two of its short words as codes, other ones in each scope."""
    out = [f"SOURCE @{ref}\n    código: N/A\nEND SOURCE"]
    for sentence in (s for line in text.split("\n") for s in _STOP.split(line)):
        words = _FACTOR.findall(sentence.lower())
        codes = words[:2] if scope == SCOPES[0] else words[-2:]
        if codes:
            out.append(f'ITEM @{ref}\n    ordem_1a: "{sentence}"\n' + "\n\n".join(f'    ordem_2a: {c}\n    justificativa_interna: "{scope}"' for c in codes) + "\nEND ITEM")
    return "\n\n".join(out)


@query()
def p1_coded_documents(spark, d):
    """Chunk, ask, validate, parse and recombine, over all documents; tests compare it with a loop over the same steps."""
    whole, _ = coding.code_documents(table(spark, d, "documents"), tagged_answer)
    out = tagged.parse(whole)
    return out.select("ref", "block_seq", "excerpt", F.array_join("factors", "|").alias("factors"), F.array_join("relations", "|").alias("relations"))


@query()
def u3_coded_interviews(spark, d):
    """Windows, two scopes put together, parse, merge and check against the transcript, over all conversations; tests compare it with a loop."""
    out, _ = coding.code_interviews(items.transcripts(table(spark, d, "conversations")), item_answer, SCOPES)
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["code"], F.lit("="), p["rationale"])), "|")
    return out.select("interview_id", "turn", "sent", "excerpt", pairs.alias("pairs"), "n_items")
