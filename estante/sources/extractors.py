"""Extractors of metadata: a protocol, HTTP adapters, and their distributed application."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.operators.validate import strict_schema, validated

TIMEOUT, MAX_TOKENS = 180, 4096
PROMPT = """Você cataloga documentos. Leia o trecho e devolva só um objeto JSON no esquema dado.
Título e subtítulo vêm da folha de rosto ou do cabeçalho do artigo, não do nome do arquivo, que pode enganar.
Escreva cada autor como "Sobrenome, Nome", na ordem em que aparece; tradutores e organizadores só contam quando não há autor.
Escolha uma área ampla do conhecimento e, dentro dela, uma subárea; repita a área quando não couber nenhuma.
Copie ISBN, ISSN e DOI apenas se estiverem no trecho; não os complete de memória.
Ano é o da publicação do documento, com quatro algarismos. O que o texto não diz fica null.
Monte a referência pela ABNT com os mesmos dados, sem acrescentar nada."""
#: Answers that no other document would get either.
FATAL = {401, 403, 404, 429}
# What a rejected request says when the account has nothing left to spend.
SPENT = "credit balance"
NOT_SENT = "não processado"


class Extractor(Protocol):
    def answer(self, prompt: str) -> str: ...


class FatalError(RuntimeError):
    """The provider cannot be used at all: the batch stops."""


def post(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as response:
            return json.load(response)
    except urllib.error.HTTPError as problem:
        said = problem.read().decode("utf-8", "replace") if problem.code == 400 else ""
        raise (FatalError if problem.code in FATAL or SPENT in said.lower() else RuntimeError)(f"HTTP {problem.code} {said[:200]}".strip()) from None
    except urllib.error.URLError as problem:
        raise (RuntimeError if isinstance(problem.reason, TimeoutError) else FatalError)(str(problem.reason)) from None


class HttpExtractor:
    """kind: ollama, anthropic, or any address that speaks the chat completion form. send: replaces the HTTP call in tests."""

    def __init__(self, kind: str, model: str, url: str, key: str | None = None, send: Callable[[str, dict, dict], dict] = post):
        self.kind, self.model, self.url, self.key, self.send = kind, model, url.rstrip("/"), key, send

    def answer(self, prompt: str) -> str:
        turns = [{"role": "system", "content": PROMPT}, {"role": "user", "content": prompt}]
        if self.kind == "ollama":
            got = self.send(f"{self.url}/api/chat", {"model": self.model, "messages": turns, "stream": False, "format": strict_schema(), "options": {"temperature": 0}}, {})
            return got["message"]["content"]
        if self.kind == "anthropic":
            tool = {"name": "registro", "description": "Registro bibliográfico", "input_schema": strict_schema()}
            body = {"model": self.model, "max_tokens": MAX_TOKENS, "temperature": 0, "system": PROMPT, "messages": turns[1:], "tools": [tool], "tool_choice": {"type": "tool", "name": "registro"}}
            got = self.send(f"{self.url}/v1/messages", body, {"x-api-key": self.key or "", "anthropic-version": "2023-06-01"})
            return json.dumps(next(b["input"] for b in got["content"] if b["type"] == "tool_use"))
        form = {"type": "json_object"} if self.kind == "deepseek" else {"type": "json_schema", "json_schema": {"name": "registro", "strict": True, "schema": strict_schema()}}
        if self.kind == "deepseek":
            turns[0]["content"] += " Esquema: " + json.dumps(strict_schema(), ensure_ascii=False)
        got = self.send(f"{self.url}/chat/completions", {"model": self.model, "messages": turns, "temperature": 0, "response_format": form}, {"Authorization": f"Bearer {self.key}"})
        return got["choices"][0]["message"]["content"]


def extract(prompts: DataFrame, make: Callable[[], Extractor], key: str = "caminho") -> DataFrame:
    """key, registro, erro, fatal from key, pedido, trecho.

    Nothing is raised in a task: a fatal answer marks its row, and the task sends
    nothing more: its other rows are fatal too, with NOT_SENT.  Blank excerpts never
    reach the extractor.  The result is not deterministic: persist it before it
    branches.
    """
    blank = F.coalesce(F.col("trecho"), F.lit("")).rlike(r"(?U)^\s*$")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor, stopped = make(), False
        for batch in batches:
            rows = []
            for k, prompt in zip(batch[key], batch["pedido"]):
                if stopped:
                    rows.append((k, None, NOT_SENT, True))
                    continue
                try:
                    rows.append((k, extractor.answer(prompt), None, False))
                except FatalError as problem:
                    stopped = True
                    rows.append((k, None, str(problem), True))
                except Exception as problem:  # noqa: BLE001
                    rows.append((k, None, f"{type(problem).__name__}: {problem}", False))
            yield pd.DataFrame(rows, columns=[key, "resposta", "falha", "fatal"])

    answers = prompts.where(~blank).select(key, "pedido").mapInPandas(run, f"{key} string, resposta string, falha string, fatal boolean")
    checked = answers.withColumn("v", validated(F.col("resposta")))
    made = checked.select(key, F.col("v.registro").alias("registro"), F.coalesce("falha", "v.erro").alias("erro"), "fatal")
    skipped = prompts.where(blank).select(key, F.lit(None).cast(made.schema["registro"].dataType).alias("registro"), F.lit("trecho vazio").alias("erro"), F.lit(False).alias("fatal"))
    return made.unionByName(skipped)
