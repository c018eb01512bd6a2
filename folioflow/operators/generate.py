"""Generation units into requests, replies and artifacts, behind a backend that may be anything.

The backend is one object with ``reply(request) -> dict``; it is shipped to the executors and called inside
``mapInPandas``, one partition per concurrent caller. The default answers offline and always alike.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import telemetry
from folioflow.operators.selection import ALL_TYPES

# Sampling temperature and the least output tokens of the merged types, and the field that holds a type's items.
TEMPERATURE = {"Summary": 0.3, "MindMap": 0.4}
TOKEN_FLOOR = {"Summary": 4000, "MindMap": 8000}
ITEMS_FIELD = {"MultipleChoiceQuiz": "items", "EssayQuiz": "items", "CompletionQuiz": "items"}
TASKS = {
    "MultipleChoiceQuiz": "Ask multiple-choice questions about the passage, each with four options of which one is right, and say why.",
    "EssayQuiz": "Ask open questions about the passage, each with instructions and a model answer.",
    "CompletionQuiz": "Take sentences of the passage with one word left out, each with that word and a hint.",
    "Summary": "Sum up the material under a title, with its key points.",
    "MindMap": "Draw the topic of the material and its branches as a tree of labels.",
}
MOST_ATTEMPTS = 3
#: Concurrent callers of a backend at most.
MOST_CALLERS = 32
_STRING = {"type": "string"}


def _object(**fields) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def _list(of: dict, least: int | None = None, most: int | None = None) -> dict:
    return {"type": "array", "items": of} | ({"minItems": least, "maxItems": most} if least is not None else {})


# The shape of each type's reply.
SCHEMAS = {
    "MultipleChoiceQuiz": _object(items=_list(_object(question=_STRING, options=_list(_STRING, 4, 4), answer=_STRING, explanation=_STRING))),
    "EssayQuiz": _object(items=_list(_object(question=_STRING, instructions=_STRING, model_answer=_STRING))),
    "CompletionQuiz": _object(items=_list(_object(sentence=_STRING, answer=_STRING, hint=_STRING))),
    "Summary": _object(title=_STRING, summary=_STRING, key_points=_list(_STRING, 3, 5)),
    "MindMap": _object(topic=_STRING, branches=_list({"$ref": "#/$defs/node"})) | {"$defs": {"node": _object(label=_STRING, children=_list({"$ref": "#/$defs/node"}))}},
}


def empty_reply(artifact_type: str) -> str:
    """What a reply to material without content looks like."""
    return json.dumps({ITEMS_FIELD.get(artifact_type, "items"): []})


def system_prompt(artifact_type: str) -> str:
    return (
        "You write study material from a given text. State only what the text states; do not mention figures, tables, pages or the text itself; write in its language. "
        f"Answer with one JSON object of the given schema and nothing else. If the text is front matter or has no content to learn, answer {empty_reply(artifact_type)}."
    )


@dataclass(frozen=True)
class Params:
    temperature: float = 0.7
    max_tokens: int = 2048
    seed: int = 1234


class Backend(Protocol):
    def reply(self, request: dict) -> dict: ...


class Offline:
    """Replies made of the request itself: one item per quiz unit, taken from the passage; the same every time."""

    def reply(self, request: dict) -> dict:
        passage = request["context"].split("\n")[-1]
        words = [w for w in passage.split() if w.isalpha() and len(w) > 3] or ["nothing"]
        pick = int(hashlib.sha256(f"{request['seed']}".encode()).hexdigest(), 16) % len(words)
        word, kind = words[pick], request["artifact_type"]
        if kind == "MultipleChoiceQuiz":
            options = [word, *(f"{word} {i}" for i in (1, 2, 3))]
            body = {"items": [{"question": f"Which word stands at {pick}?", "options": options, "answer": word, "explanation": "It stands in the passage."}]}
        elif kind == "EssayQuiz":
            body = {"items": [{"question": f"What does {word} mean here?", "instructions": "Answer briefly.", "model_answer": passage[:80]}]}
        elif kind == "CompletionQuiz":
            body = {"items": [{"sentence": passage.replace(word, "____", 1)[:200], "answer": word, "hint": word[0]}]}
        elif kind == "Summary":
            body = {"title": word, "summary": passage[:200], "key_points": words[:3]}
        else:
            body = {"topic": word, "branches": [{"label": w, "children": []} for w in words[:3]]}
        return {"text": json.dumps(body), "finish_reason": "stop", "error": None}


def temperature(artifact_type: Column | str, params: Params = Params()) -> Column:
    c = F.col(artifact_type) if isinstance(artifact_type, str) else artifact_type
    out = F.lit(params.temperature)
    for name, value in TEMPERATURE.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def max_tokens(artifact_type: Column | str, params: Params = Params()) -> Column:
    c = F.col(artifact_type) if isinstance(artifact_type, str) else artifact_type
    out = F.lit(params.max_tokens)
    for name, value in TOKEN_FLOOR.items():
        out = F.when(c == name, max(params.max_tokens, value)).otherwise(out)
    return out


def requests(units: DataFrame, contexts: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """Units with system, prompt, schema, temperature, max_tokens, seed and approximate input tokens; skipped units are left out.

    ``contexts`` (segment_id, context) is joined where the units carry no context. A seed that would overflow is null.
    """
    rows = units.where("not skip")
    if contexts is not None:
        rows = rows.join(contexts, "segment_id")
    task = F.element_at(F.create_map(*[x for name, t in TASKS.items() for x in (F.lit(name), F.lit(t))]), F.col("artifact_type"))
    prompt = F.concat(task, F.lit("\n\nMaterial:\n"), "context")
    by_type = lambda values: F.element_at(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(v))]), F.col("artifact_type"))
    return rows.withColumn("prompt", prompt).withColumns({
        "system": by_type({t: system_prompt(t) for t in TASKS}), "schema": by_type({t: json.dumps(v) for t, v in SCHEMAS.items()}),
        "temperature": temperature("artifact_type", params), "max_tokens": max_tokens("artifact_type", params),
        "seed": F.try_add(F.lit(params.seed).cast("long"), F.col("seed_offset")), "tokens_in": tx.approximate_tokens("prompt"),
    })


def run(requests_: DataFrame, backend: Backend | None = None, concurrency: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The requests' key columns with text, finish_reason, error, attempts, tokens_out.

    Retryable errors are tried up to three times with growing pauses, others once; a blank reply is an answer (skip). At least one
    and at most ``MOST_CALLERS`` callers run at once.
    """
    backend = backend or Offline()
    keys = [c for c in requests_.columns if c not in ("system", "prompt", "schema", "context", "temperature", "max_tokens", "tokens_in")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests_.schema.fields if f.name in keys)
    schema += ", text string, finish_reason string, error string, attempts int, tokens_in long, tokens_out long"

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for request in frame.to_dict("records"):
                for attempt in range(1, MOST_ATTEMPTS + 1):
                    r = backend.reply(request)
                    if not r.get("error") or r.get("error_class") not in telemetry.RETRYABLE or attempt == MOST_ATTEMPTS:
                        break
                    sleep(0.2 * attempt)
                text = r.get("text") or ""
                out.append({k: request[k] for k in keys} | {
                    "text": r.get("text"), "finish_reason": r.get("finish_reason"), "error": r.get("error"), "attempts": attempt,
                    "tokens_in": request["tokens_in"], "tokens_out": max(len(text.encode()) // 4, 1) if text else 0,
                })
            if out:
                yield pd.DataFrame(out)

    return requests_.repartition(min(max(concurrency, 1), MOST_CALLERS)).mapInPandas(call, schema)


def artifacts(replies: DataFrame, contexts: DataFrame) -> DataFrame:
    """worksheet_id, artifact_type, source, ordinal, content of the accepted items of replies.

    ``replies`` has worksheet_id, artifact_type, segment_id, text, finish_reason; ``contexts`` segment_id, context.
    """
    from folioflow.operators import validate as va

    keyed = replies.where("error is null").select("worksheet_id", "artifact_type", F.col("segment_id"), va.recovered("text").alias("v"), va.is_truncated("finish_reason").alias("cut"), "text").where("not cut")
    quiz = keyed.where(F.col("artifact_type").isin(*ITEMS_FIELD)).select("worksheet_id", "artifact_type", "segment_id", F.posexplode(F.try_variant_get("v", "$.items", "array<variant>")).alias("ordinal", "item"))
    fields = quiz.join(contexts, "segment_id").select(
        "worksheet_id", "artifact_type", F.col("segment_id").alias("source"), "ordinal", F.to_json("item").alias("content"), "context",
        *[va.string_field("item", f).alias(f) for f in ("question", "answer", "sentence")], F.try_variant_get("item", "$.options", "array<string>").alias("options"),
    )
    reason = F.when(F.col("artifact_type") == "MultipleChoiceQuiz", va.mcq_reason()).when(F.col("artifact_type") == "EssayQuiz", va.essay_reason()).otherwise(va.completion_reason())
    kept = fields.where(reason.isNull()).select("worksheet_id", "artifact_type", "source", "ordinal", "content")
    merged = keyed.where(F.col("artifact_type") == "Summary").where(va.string_field("v", "summary").isNotNull() & F.try_variant_get("v", "$.key_points", "array<variant>").isNotNull()).select("worksheet_id", "artifact_type", F.col("segment_id").alias("source"), F.lit(0).alias("ordinal"), F.to_json("v").alias("content"))
    maps = keyed.where(F.col("artifact_type") == "MindMap").select("worksheet_id", "artifact_type", F.col("segment_id").alias("source"), "text")
    normal = F.pandas_udf(lambda s: s.map(va.normal_mind_map), "string")
    mapped = maps.withColumn("content", normal("text")).where("content is not null").select("worksheet_id", "artifact_type", "source", F.lit(0).alias("ordinal"), "content")
    return kept.unionByName(merged).unionByName(mapped)


def telemetry_of(replies: DataFrame) -> DataFrame:
    """artifact_type, units, requests (attempts), backend_errors, tokens_in, tokens_out; a row per type that ran."""
    return replies.groupBy("artifact_type").agg(F.count("*").alias("units"), F.sum("attempts").alias("requests"), F.count_if(F.col("error").isNotNull()).alias("backend_errors"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


TYPE_ORDER = {name: i for i, name in enumerate(ALL_TYPES)}
