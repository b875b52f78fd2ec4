"""A second opinion on findings from a model: prompts, calls, answers, and what the answers decide.

No model is built in.  A client is any function from a prompt to an answer; it
runs inside tasks, so it must be importable there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]
ANSWER = "isValid boolean, explanation string, confidence double, fixSuggestion string"
#: Environment variables with the keys of services; a service without one needs none.
KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "google": "GOOGLE_API_KEY", "ollama": None}


def available(provider: str | None, environment: Mapping[str, str]) -> bool:
    """Whether a service is chosen and its key, if it needs one, is there."""
    return provider in KEYS and (KEYS[provider] is None or bool(environment.get(KEYS[provider])))


def prompts(found: DataFrame) -> DataFrame:
    """The findings with ``prompt``: what was found, the code around it, and, where they are known, its flow and its context."""
    optional = lambda name, text: F.when(F.col(name).isNotNull(), text) if name in found.columns else F.lit(None)
    parts = [
        F.lit("Decide whether this finding of a code scanner is a real problem or a false alarm."),
        F.format_string("Rule %s (%s, %s): %s", "rule_id", "severity", "category", "message"),
        F.format_string("File %s, line %d:\n%s", "path", "line_no", "snippet"),
        optional("source_line", F.format_string("Data enters in line %s and is used in line %d.", F.col("source_line").cast("string") if "source_line" in found.columns else F.lit(""), "line_no")),
        optional("context", F.format_string("The file deals with %s.", F.col("context") if "context" in found.columns else F.lit(""))),
        F.lit('Answer with one JSON object: {"isValid": true or false, "explanation": "...", "confidence": 0 to 1, "fixSuggestion": "..."}'),
    ]
    return found.withColumn("prompt", F.concat_ws("\n\n", *parts))


def parsed(answer: Column) -> Column:
    """isValid, explanation, confidence and fix of an answer, whatever text is around its object.

    An answer without a readable object counts as valid with confidence 0; in an
    object a missing verdict is valid and a missing confidence 0.5.
    """
    text = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    found = F.from_json(text, ANSWER)
    readable = (F.length(text) > 0) & F.try_parse_json(text).isNotNull()
    return F.struct(
        F.coalesce(F.when(readable, found["isValid"]), F.lit(True)).alias("valid"),
        F.when(readable, F.coalesce(found["explanation"], F.lit("no explanation"))).otherwise(F.lit("no answer")).alias("explanation"),
        F.when(readable, F.coalesce(found["confidence"], F.lit(0.5))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(readable, found["fixSuggestion"]).alias("fix"),
    )


def asked(client: Client, parallel: int = 4):
    """The client as a column function; a call that fails has a null answer."""

    def one(prompt: str | None) -> str | None:
        try:
            return None if prompt is None else client(prompt)
        except Exception:
            return None

    @F.arrow_udf("string")
    def ask(prompt: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(parallel) as pool:
            return pa.array(list(pool.map(one, prompt.to_pylist())), pa.string())

    return ask


def first(found: DataFrame, n: int) -> DataFrame:
    """``checked``: whether a finding is among the first ``n`` of the scan.

    The bound is n rows: each task keeps its first n, and those meet in one.
    """
    from codesift.operators.findings import ORDINALS

    keys = found.select(*ORDINALS, "id").orderBy(*ORDINALS, "id").limit(n).withColumn("checked", F.lit(True))
    return found.join(F.broadcast(keys), [*ORDINALS, "id"], "left").na.fill(False, ["checked"])


def validated(found: DataFrame, client: Client, n: int = 20, parallel: int = 4) -> DataFrame:
    """The findings that the model does not call false: the first ``n`` are asked about, the rest pass.

    Adds checked, and for those asked ``verdict``: valid, explanation, confidence and fix.
    """
    marked = prompts(first(found, n))
    judged = marked.where("checked").withColumn("verdict", parsed(asked(client, parallel)(F.col("prompt"))))
    rest = marked.where("not checked").withColumn("verdict", F.lit(None).cast("struct<valid:boolean,explanation:string,confidence:double,fix:string>"))
    return judged.unionByName(rest).where(F.coalesce("verdict.valid", F.lit(True))).select(*found.columns, "checked", "verdict")
