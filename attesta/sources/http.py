"""HTTP requests as rows: passages by GET, generated items by POST.

Requests are a table, one row each; executors make them, one attempt each, and pass
the responses on in batches, so that a chapter is a row and no response is held by the
driver. A task that is run again asks again; write the responses before using them twice.
Passages come from passage_source, too, which Spark plans and which asks for nothing twice.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "id string, status int, payload string, error string"
PASSAGE_SECONDS, MODEL_SECONDS = 30, 120
#: Characters of a refusal's text that are told.
EXCERPT = 600


def ask(url: str, body: str | None, headers: dict[str, str], timeout: float) -> tuple[int | None, str | None, str | None]:
    """(status, payload, error) of one request; see responses."""
    request = urllib.request.Request(url, headers=headers, data=None if body is None else body.encode())
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode("utf-8"), None
    except urllib.error.HTTPError as e:
        said = e.read().decode("utf-8", errors="replace")[:EXCERPT]
        return e.code, None, f"{e.reason}: {said}" if said else str(e.reason)
    except (OSError, ValueError) as e:
        return None, None, str(e)


def responses(requests: DataFrame, headers: dict[str, str], timeout: float = PASSAGE_SECONDS, tasks: int = 8) -> DataFrame:
    """id, status, payload and error for requests (id, url, body; a null body is a GET).

    A response with an error status has that status and its reason as error; without any
    response the status is null. The headers may hold a key: they go to the executors in
    the closure, not into the plan.
    """

    def run(batches):
        for b in batches:
            for i, url, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                status, payload, error = ask(url, body, headers, timeout)
                columns = ((i, pa.string()), (status, pa.int32()), (payload, pa.string()), (error, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], ["id", "status", "payload", "error"])

    rows = requests.select(F.col("id").cast("string"), "url", F.col("body").cast("string"))
    return rows.repartition(tasks, "id").mapInArrow(run, RESPONSE)


def passage_requests(chapters: DataFrame, base: str, version: str) -> DataFrame:
    """id, url and body of the GET of each chapter (book, chapter); the book is trimmed."""
    reference = F.concat_ws(" ", F.trim("book"), F.col("chapter").cast("string"))
    url = F.concat(F.lit(f"{base}?ref="), F.url_encode(reference), F.lit(f"&version={urllib.parse.quote_plus(version)}"))
    return chapters.select(reference.alias("id"), url.alias("url"), F.lit(None).cast("string").alias("body"))


# The fields of generated items and the shape of a request.
def item_schema(difficulties: tuple[str, ...]) -> str:
    """The JSON schema of generated items, as JSON text."""
    text = {"type": "string"}
    fields = {
        "verse_number": {"type": "integer"}, "question": text, "options": {"type": "array", "items": text, "minItems": 4, "maxItems": 4},
        "correct_answer": text, "explanation": text, "difficulty": text | {"enum": list(difficulties)}, "category": text,
    }
    item = {"type": "object", "properties": fields, "required": list(fields)}
    return json.dumps({"type": "object", "properties": {"items": {"type": "array", "items": item}}, "required": ["items"]})


def model_requests(prompts: DataFrame, url: str, schema: str, most_tokens: int = 20_000) -> DataFrame:
    """id, url and body of the POST of each prompt (id, prompt), asking for JSON of a schema (JSON text)."""
    content = F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("prompt").alias("text"))).alias("parts"))
    settings = f'{{"maxOutputTokens":{most_tokens},"responseFormat":{{"text":{{"mimeType":"application/json","schema":{schema}}}}}}}'
    body = F.concat(F.lit('{"contents":'), F.to_json(F.array(content)), F.lit(f',"generationConfig":{settings}}}'))
    return prompts.select("id", F.lit(url).alias("url"), body.alias("body"))
