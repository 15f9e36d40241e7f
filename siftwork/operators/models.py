"""Model calls with an injected provider: structured answers, one repair, usage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..providers import LanguageModel, ProviderError
from ..session import ship



def structured(answer: str, required: list[str]) -> dict | list | None:
    """The JSON value of an answer: a block fenced as json, else the outermost braces or brackets, else the answer itself;
    None if it does not parse or a field is missing."""
    found = (re.search(p, answer, re.S) for p in (r"```json[^\n]*\n(.*?)```", r"(\{.*\})", r"(\[.*\])"))
    text = next((m.group(1) for m in found if m), answer)
    try:
        value = json.loads(text)
    except ValueError:
        return None
    records = value if isinstance(value, list) else [value]
    return value if all(isinstance(r, dict) and all(k in r for k in required) for r in records) else None


def answered(prompts: DataFrame, provider: LanguageModel, required: list[str], id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """(id_col, answer, calls, input_tokens, output_tokens, error) for each prompt.

    An answer that is not the JSON asked for is asked for once more, with the wrong answer; after that error is
    INVALID_ANSWER. A provider that raises ProviderError gives error = PROVIDER_FAILED; any other error is a bug and stops the job.
    """
    ship(prompts.sparkSession)
    kind = prompts.schema[id_col].dataType.simpleString()

    def ask(prompt: str) -> tuple[str | None, int, int, int, str | None]:
        calls = sent = got = 0
        now = prompt
        for _ in range(2):
            try:
                said, a, b = provider(now)
            except ProviderError:
                return None, calls, sent, got, "PROVIDER_FAILED"
            calls, sent, got = calls + 1, sent + a, got + b
            if (value := structured(said, required)) is not None:
                return json.dumps(value, sort_keys=True), calls, sent, got, None
            now = f"{prompt}\n\nThis answer is not valid JSON with {', '.join(required)}:\n{said}"
        return None, calls, sent, got, "INVALID_ANSWER"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(zip(*[ask(p or "") for p in batch.column(1).to_pylist()], strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[id_col, "answer", "calls", "input_tokens", "output_tokens", "error"])

    return prompts.select(id_col, prompt_col).mapInArrow(run, f"{id_col} {kind}, answer string, calls long, input_tokens long, output_tokens long, error string")
