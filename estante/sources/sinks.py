"""Writing a plan: copy or move each document and write its note; without side effects in a dry run."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_plan(plan: DataFrame, dry_run: bool = False, move: bool = False, note_folder: str | None = None) -> DataFrame:
    """caminho, situacao, destino, erro from caminho, pasta, final, nota.

    The plan is made before, deterministically, so a repeated task writes the same
    files again.  note_folder: a subfolder of its own for the notes.  A file that
    cannot be written is a failure of its row.
    """
    if dry_run:
        return plan.select("caminho", F.lit("simulado").alias("situacao"), F.concat("pasta", F.lit("/"), "final", F.lit(".pdf")).alias("destino"), F.lit(None).cast("string").alias("erro"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, folder, name, note in zip(batch["caminho"], batch["pasta"], batch["final"], batch["nota"]):
                target = os.path.join(folder, name + ".pdf")
                try:
                    os.makedirs(folder, exist_ok=True)
                    # A repeated task finds a moved file at its target.
                    if os.path.exists(path) or not os.path.exists(target):
                        (shutil.move if move else shutil.copy2)(path, target)
                    notes = os.path.join(folder, note_folder) if note_folder else folder
                    os.makedirs(notes, exist_ok=True)
                    with open(os.path.join(notes, name + ".md"), "w", encoding="utf-8") as f:
                        f.write(note)
                    rows.append((path, "sucesso", target, None))
                except OSError as problem:
                    rows.append((path, "falha", target, str(problem)))
            yield pd.DataFrame(rows, columns=["caminho", "situacao", "destino", "erro"])

    return plan.select("caminho", "pasta", "final", "nota").mapInPandas(run, "caminho string, situacao string, destino string, erro string")
