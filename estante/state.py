"""Progress of a run: parameters as JSON, completed paths as an appended table."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The parameters a resumed run takes over; keys are never stored.
SAVED = ["origem", "destino", "dry_run", "recursive", "mover", "subpasta_markdown", "modelo", "ollama_url", "provedor", "provedor_fallback", "modelo_fallback"]


class RunState:
    """folder: on a file system that driver and executors share."""

    def __init__(self, folder: str):
        self.folder, self.params_path, self.done_path = folder, os.path.join(folder, "parametros.json"), os.path.join(folder, "concluidos")
        self.results_path = os.path.join(folder, "resultados")

    def save(self, **params) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self.params_path, "w", encoding="utf-8") as f:
            json.dump({k: params.get(k) for k in SAVED}, f, ensure_ascii=False)

    def load(self) -> dict | None:
        """The parameters; None if missing, broken or of another shape."""
        try:
            with open(self.params_path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return None
        return found if isinstance(found, dict) and set(found) == set(SAVED) else None

    def mark(self, results: DataFrame, path: str = "caminho") -> None:
        """Appends the paths of results, failures included."""
        results.select(F.col(path).alias("caminho")).distinct().write.mode("append").parquet(self.done_path)

    def done(self, spark: SparkSession) -> DataFrame:
        if not os.path.isdir(self.done_path):
            return spark.createDataFrame([], "caminho string")
        return spark.read.parquet(self.done_path).distinct().orderBy("caminho")

    def keep(self, results: DataFrame) -> None:
        """Appends results of a slice, for the report."""
        results.write.mode("append").parquet(self.results_path)

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.results_path)

    def forget_results(self) -> None:
        """A report is about one run, also if that resumes another."""
        shutil.rmtree(self.results_path, ignore_errors=True)

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)
