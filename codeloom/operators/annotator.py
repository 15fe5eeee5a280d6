"""The hook for a model: a user function from (id, scope, text) to tagged text, called for every chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotate(chunks: DataFrame, call: Callable[[str, str, str], str], retries: int = 2) -> DataFrame:
    """(id, scope, part, output, status, error) for chunks(id, scope, part, text).

    ``call`` runs in the tasks. If it raises so often as retries allow, the chunk gets the status failed and the error's text,
    and the others go on; nulls are passed as empty texts.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: dict[str, list] = {"output": [], "status": [], "error": []}
            for one, scope, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                answer, fault = None, None
                for _ in range(retries + 1):
                    try:
                        answer, fault = call(one, scope, text or ""), None
                        break
                    except Exception as e:  # noqa: BLE001  what a user's function raises is theirs
                        fault = f"{type(e).__name__}: {e}"
                out["output"].append(answer)
                out["status"].append("failed" if fault else "ok")
                out["error"].append(fault)
            yield pa.record_batch({"id": batch.column(0), "scope": batch.column(1), "part": batch.column(2)} | {k: pa.array(v, pa.string()) for k, v in out.items()})

    own = chunks.select(*(F.col(c).cast(k).alias(c) for c, k in (("id", "string"), ("scope", "string"), ("part", "int"), ("text", "string"))))
    return own.mapInArrow(run, "id string, scope string, part int, output string, status string, error string")
