"""Career test answers in, assembled model text out."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

# Names of the test stages and their length.
STAGES = ("Личностные качества", "Предпочтения в работе", "Интересы", "Профильные предпочтения")
STAGE_LENGTH = 20


def compact_answers(answers: DataFrame, staged: bool = False) -> DataFrame:
    """(result_id, stage, text): a line per answer with its question, a row per stage of 20 answers.

    answers: result_id, pos (0, 1, 2 … unique), question, answer. ``staged`` gives the stages their names and
    takes the numbers away, for all tests of a call alike. No row grows with the test.
    """
    q, a = F.trim(X.text(F.col("question"))), F.trim(X.text(F.col("answer")))
    mark = F.lit("- ") if staged else F.concat((F.col("pos") + 1).cast("string"), F.lit(". "))
    line = F.concat(mark, F.when(q != "", F.concat(q, F.lit(" — "))).otherwise(""), a)
    stage = F.floor(F.col("pos") / STAGE_LENGTH).cast("int")
    grouped = answers.groupBy("result_id", stage.alias("stage")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda s: s["l"]), "\n").alias("text")
    )
    if not staged:
        return grouped
    names = F.array(*[F.lit(s) for s in STAGES])
    title = F.coalesce(F.get(names, F.col("stage")), F.concat(F.lit("Этап "), (F.col("stage") + 1).cast("string")))
    return grouped.select("result_id", "stage", F.concat(title, F.lit(":\n"), "text").alias("text"))


def assemble_chunks(chunks: DataFrame, width: int = 1000) -> DataFrame:
    """(id, part, text): message chunks joined in order, ``width`` sequence numbers per part."""
    part = F.floor(F.col("seq") / width).alias("part")
    return chunks.groupBy("id", part).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "txt"))), lambda s: s["txt"]), "").alias("text")
    )


def validate_payloads(df: DataFrame, schema: str, payload: str, into: str) -> DataFrame:
    """``df`` with the rules that each submission breaks; each distinct form definition is parsed once and joined by its text."""
    forms = df.select(F.col(schema).alias("_form")).distinct()
    forms = forms.select("_form", V.parse_form(F.col("_form")).alias("_fields"))
    rows = df.join(forms, F.col(schema).eqNullSafe(F.col("_form")), "left")
    return rows.withColumn(into, V.broken_fields(F.col("_fields"), F.col(payload))).drop("_form", "_fields")
