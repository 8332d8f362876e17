"""Plug-ins that need Python: Unicode folding, text models, embedding providers and JSON repair.

Providers are callables given by the caller and run inside tasks, batch by batch; the defaults work offline.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


def _nfkc(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda x: "".join(unicodedata.normalize("NFKC", x.strip().lower()).split()))


def nfkc(c: Column | str) -> Column:
    """Trimmed, lower case, NFKC, without white space (pandas UDF); ASCII texts give what ``graph.norm`` gives."""
    return F.pandas_udf(_nfkc, "string")(T.text(c))


def offline_model(prompt: str) -> str:
    """A deterministic stand-in for a text model: a JSON answer out of the prompt's own words."""
    words = list(dict.fromkeys(re.findall(r"\w{4,}", prompt.lower())))[:4]
    return json.dumps({"summary": prompt[:80], "keywords": words}, ensure_ascii=False)


def model_batch(df: DataFrame, prompt_col: str, provider: Callable[[str], str] = offline_model) -> DataFrame:
    """Add answer and model_error; a failing row keeps its error and never fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch[prompt_col]:
                try:
                    answers.append(provider(prompt or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one row must not stop the others
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield batch.assign(answer=pd.Series(answers, index=batch.index, dtype=object), model_error=pd.Series(errors, index=batch.index, dtype=object))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "answer string, model_error string"])
    return df.mapInPandas(run, schema)


def repair_json(raw: str | None) -> tuple[str, str | None]:
    """(status, JSON): ok, repaired or failed. The envelope around the outermost braces goes, raw control characters and a
    stray quote behind a number go, open strings and brackets are closed."""
    text = raw or ""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return "failed", None
    body = text[start:]
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
        return ("ok" if start == 0 and body.strip() == text.strip() else "repaired"), json.dumps(value, ensure_ascii=False, sort_keys=True)
    except ValueError:
        pass
    body = re.sub(r"[\x00-\x1f]+", " ", body.rsplit("```", 1)[0])
    body = re.sub(r'(:\s*-?\d+(?:\.\d+)?)"(?=\s*[,}\]])', r"\1", body)
    stack, quoted, escaped = [], False, False
    for ch in body:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    closed = re.sub(r"[,:\s]+$", "", body + '"' * quoted) + "".join(reversed(stack))
    try:
        value, _ = json.JSONDecoder().raw_decode(closed)
        return "repaired", json.dumps(value, ensure_ascii=False, sort_keys=True)
    except ValueError:
        return "failed", None


def _repair(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair_json(x) for x in s], columns=["status", "json"])


def parse_model_json(df: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Add json_status and json (null if the answer can't be read)."""
    got = F.pandas_udf(_repair, "status string, json string")(F.col(answer_col))
    return df.withColumn("__j", got).withColumn("json_status", F.col("__j.status")).withColumn("json", F.col("__j.json")).drop("__j")


def prompts(df: DataFrame, parts: Sequence[tuple[str, str, int]], instruction: str, cap: int = 6000) -> DataFrame:
    """Add prompt: the instruction, then ``label: value`` lines of columns cut to their lengths, capped in all."""
    lines = [F.concat(F.lit(f"{label}: "), F.substring(T.collapse_space(col), 1, n)) for label, col, n in parts]
    return df.withColumn("prompt", F.substring(F.concat_ws("\n", F.lit(instruction), *lines), 1, cap))


def fallback_when_failed(model: DataFrame, heuristic: DataFrame, approvals: DataFrame, keys: Sequence[str], by: str = "source") -> DataFrame:
    """The model's value; where it failed, the heuristic's if the source approves of that, else status needs_approval.

    model(keys, by, value), heuristic(keys, value), approvals(by, approved).
    """
    df = model.join(heuristic.select(*keys, F.col("value").alias("h")), list(keys), "left").join(approvals.select(by, "approved"), by, "left")
    ok = F.coalesce("approved", F.lit(False))
    status = F.when(F.col("value").isNotNull(), "model").when(ok & F.col("h").isNotNull(), "fallback").otherwise("needs_approval")
    return df.select(*keys, by, F.coalesce("value", F.when(ok, F.col("h"))).alias("value"), status.alias("status"))


def plan_from_model(df: DataFrame, json_col: str = "json") -> DataFrame:
    """terms (24 at most) and dimensions (8; minimum of evidence from 3 to 40, 8 by default) from a parsed answer."""
    schema = "terms array<string>, dimensions array<struct<name:string, keywords:array<string>, minEvidence:int>>"
    p = F.from_json(F.col(json_col), schema)
    dims = F.transform(F.slice(F.coalesce(p["dimensions"], F.from_json(F.lit("[]"), "array<struct<name:string, keywords:array<string>, minEvidence:int>>")), 1, 8), lambda d: F.struct(d["name"].alias("name"), d["keywords"].alias("keywords"), F.least(F.lit(40), F.greatest(F.lit(3), F.coalesce(d["minEvidence"], F.lit(8)))).alias("min_evidence")))
    return df.withColumn("terms", F.slice(F.coalesce(p["terms"], F.array().cast("array<string>")), 1, 24)).withColumn("dimensions", dims)


def embed_texts(df: DataFrame, fields: Sequence[str], provider: Callable[[list[str]], list[list[float]]], *, cap: int = 6000, batch: int = 16, retries: Sequence[int] = (1800, 1400, 1000, 700)) -> DataFrame:
    """Add vector and embed_error: fields joined, cut, sent in batches; a failing batch is sent text by text, shorter each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            vectors, errors = [], []
            texts = part["__text"].tolist()
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    vectors += provider(some)
                    errors += [None] * len(some)
                    continue
                except Exception:  # noqa: BLE001
                    pass
                for t in some:
                    found, why = None, None
                    for n in retries:
                        try:
                            found, why = provider([t[:n]])[0], None
                            break
                        except Exception as e:  # noqa: BLE001
                            why = f"{type(e).__name__}: {e}"[:200]
                    vectors.append(found)
                    errors.append(why)
            yield part.drop(columns="__text").assign(vector=pd.Series(vectors, index=part.index, dtype=object), embed_error=pd.Series(errors, index=part.index, dtype=object))

    rows = df.withColumn("__text", F.substring(F.concat_ws("\n", *(F.nullif(F.trim(T.text(f)), F.lit("")) for f in fields)), 1, cap))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "vector array<float>, embed_error string"])
    return rows.mapInPandas(run, schema)
