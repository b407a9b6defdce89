"""Command line: catalogue a folder of documents."""

from __future__ import annotations

import argparse
import datetime
import logging
import os
from collections.abc import Callable

from estante import __version__
from estante.config import DISPLAY, PROVIDERS, SAVED_FLAGS, Config, dotenv

#: Documents of a slice for each one processed at a time. A slice is written and marked before the next begins.
SLICE = 50


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("estante")
    for short, name, kw in (
        ("-i", "--origem", {}), ("-o", "--destino", {}), (None, "--dry-run", {"action": "store_true"}), (None, "--resume", {"action": "store_true"}), (None, "--mover", {"action": "store_true"}),
        (None, "--subpasta-md", {}), ("-m", "--modelo", {}), (None, "--ollama-url", {}), ("-p", "--provedor", {}), ("-k", "--apikey", {}), (None, "--provedor-fallback", {}), (None, "--modelo-fallback", {}), (None, "--apikey-fallback", {}),
        (None, "--max-paginas", {"type": int}), (None, "--max-caracteres", {"type": int}), ("-n", "--limite", {"type": int}), ("-j", "--paralelo", {"type": int, "default": 1}), (None, "--log", {"default": "erros.log"}), (None, "--env", {}), ("-v", "--verbose", {"action": "store_true"}),
    ):
        p.add_argument(*([short] if short else []), name, **kw)
    p.add_argument("-r", "--recursive", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--version", action="version", version=f"estante {__version__}")
    return p


def note_folder(name: str | None) -> str | None:
    """The mirror folder as a safe segment; a name that leaves nothing has a name of its own."""
    import re

    from estante.functions import text as T

    if not name:
        return None
    safe = re.sub(r"[ .]+$", "", re.sub(r"\s+", " ", re.sub(T.INVALID, " ", name)).strip())[: T.MAX_SEGMENT]
    return safe or "Markdown"


def process(spark, todo, convert_and_plan: Callable, write: Callable, size: int, on_slice: Callable | None = None) -> tuple[int, str | None]:
    """Slices of todo, in order: planned, written, and given to on_slice before the next one begins.

    convert_and_plan: a slice → its plan.  write: a plan → its results.  Returns how
    many documents have a result, and why the batch stopped, if it did: a fatal
    answer of the provider, or an interruption.  Documents without a result are no
    failures, they are still to do.
    """
    from pyspark.sql import functions as F

    done, total = 0, todo.count()
    try:
        for low in range(0, total, size):
            plan = convert_and_plan(todo.where(F.col("lugar").between(low, low + size - 1)))
            fatal = plan.where("fatal").orderBy(F.col("erro") == "não processado").select("erro").first()
            results = write(plan.where("not fatal"))
            done += results.count()
            if on_slice:
                on_slice(results)
            if fatal:
                return done, fatal["erro"]
    except KeyboardInterrupt:
        return done, "interrompido pelo usuário"
    return done, None


def report(results, planned: int, log: logging.Logger) -> None:
    """Tree, destinations, warnings, failures and counts of a run; rows are read one after the other, not gathered."""
    from pyspark.sql import functions as F

    from estante.operators import batch

    part = lambda n: F.element_at(F.split("pasta", "/"), n)
    good = results.where("situacao <> 'falha'")
    for line in batch.drawn(batch.tree(good.select(part(-3).alias("area"), part(-2).alias("subarea"), part(-1).alias("tipo")))):
        log.info("%s", line)
    for r in good.orderBy("destino").toLocalIterator():
        log.info("%s → %s (%s%s)", r["caminho"], r["destino"], r["situacao"], f", {DISPLAY.get(r['provedor_usado'], r['provedor_usado'])}" if r["provedor_usado"] else "")
        if r["aviso"]:
            log.info("  aviso: %s", r["aviso"])
    for r in results.where("situacao = 'falha'").orderBy("caminho").toLocalIterator():
        log.warning("%s: %s: %s", r["etapa"], r["caminho"], r["erro"])
    s = batch.summary(results, planned, local="ollama").first()
    log.info("%s documentos: %s gravados, %s simulados, %s falhas, %s avisos, %s locais, %s pagos; %s restantes", planned, s["gravados"], s["simulados"], s["falhas"], s["avisos"], s["locais"], s["pagos"], s["restantes"])


def main(argv: list[str] | None = None, state_folder: str | None = None, make_extractor=None, opener=None, fetch=None, on_slice: Callable | None = None, slice_size: int | None = None) -> int:
    """0 if every document was catalogued, 1 if one failed or none was found, 2 for wrong configuration or a batch that was stopped.

    make_extractor, opener, fetch: stand-ins for the provider, the PDF library and
    the registries.  on_slice: called with the results of each slice once they are marked.
    """
    from pyspark.sql import functions as F

    from estante.operators import batch, naming
    from estante.plans.pipeline import catalogue
    from estante.session import build_session, reliable
    from estante.sources import registry
    from estante.sources.extractors import HttpExtractor
    from estante.sources.files import convert, list_files, names_in, numbered
    from estante.sources.sinks import write_plan
    from estante.state import RunState

    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(message)s")
    to_file = logging.FileHandler(a.log, encoding="utf-8", delay=True)
    to_file.setLevel(logging.WARNING)
    log = logging.getLogger("estante")
    log.addHandler(to_file)
    try:
        home = state_folder or os.path.expanduser("~/.estante")
        state = RunState(home)
        if a.resume:
            if (saved := state.load()) is None:
                log.error("não há execução para retomar")
                return 2
            for flag, name in SAVED_FLAGS.items():
                setattr(a, flag, saved[name])
        if not a.origem or not a.destino:
            log.error("--origem e --destino são obrigatórios")
            return 2
        if not os.path.isdir(a.origem):
            log.error("a pasta de origem não existe: %s", a.origem)
            return 2
        try:
            if a.env and not os.path.exists(a.env):
                raise ValueError(f"arquivo de variáveis não encontrado: {a.env}")
            env = dotenv(a.env or os.getcwd()) | dict(os.environ)
            cfg = Config.resolve(env, provider=a.provedor, model=a.modelo, api_key=a.apikey, base_url=a.ollama_url, fallback=a.provedor_fallback, fallback_model=a.modelo_fallback, fallback_key=a.apikey_fallback, pages=a.max_paginas, characters=a.max_caracteres)
        except ValueError as problem:
            log.error("%s", problem)
            return 2
        spark = build_session(cpus=a.paralelo)
        listing = reliable(list_files(spark, a.origem, a.recursive))
        if listing.isEmpty():
            return 1
        todo = batch.pending(listing, state.done(spark)) if a.resume else listing
        if a.limite:
            todo = todo.orderBy("ordem").limit(a.limite)
        if a.dry_run:
            # A trial leaves the progress of an interrupted run alone.
            state = RunState(os.path.join(home, "simulado"))
        elif not a.resume:
            state.clear()
        todo = reliable(numbered(todo.select("caminho", "nome_arquivo")).withColumnRenamed("ordem", "lugar"))
        planned = todo.count()
        if not planned:
            state.clear()
            return 0
        if not a.dry_run:
            state.save(**{name: getattr(a, flag) for flag, name in SAVED_FLAGS.items()})
        state.forget_results()
        log.info("%s → %s: %s documentos, %s %s%s%s", a.origem, a.destino, planned, DISPLAY.get(cfg.provider, cfg.provider), cfg.model, f", reserva {DISPLAY.get(cfg.fallback, cfg.fallback)} {cfg.fallback_model}" if cfg.fallback else "", ", simulação" if a.dry_run else ", movendo" if a.mover else "")
        first = make_extractor or (lambda: HttpExtractor(cfg.provider, cfg.model, cfg.base_url, cfg.api_key))
        second = (lambda: HttpExtractor(cfg.fallback, cfg.fallback_model, PROVIDERS[cfg.fallback], cfg.fallback_key)) if cfg.fallback else None
        ask = (lambda records: registry.lookup(records, fetch or registry.get)) if cfg.verify_online and (fetch or make_extractor is None) else None
        folder, today, simulated = note_folder(a.subpasta_md), datetime.date.today().isoformat(), []
        texts = {}

        def plan_slice(files):
            documents = reliable(convert(files.repartition(a.paralelo), opener))
            whole = catalogue(documents, first, a.destino, today, second, ask, cfg.provider, cfg.fallback, cfg.pages, cfg.characters, folder)
            # The notes hold the whole texts and are made when they are written.
            texts["notas"] = whole.select("caminho", "nota")
            return reliable(whole.drop("nota"))

        def write_slice(plan):
            ready = plan.where("erro is null")
            existing = names_in(ready.select("pasta"))
            for earlier in simulated:
                existing = existing.union(earlier)
            final = reliable(naming.resolve_against(ready, existing))
            if a.dry_run:
                simulated.append(final.select("pasta", F.col("final").alias("nome")))
            written = write_plan(final.join(texts["notas"], "caminho"), a.dry_run, a.mover, folder)
            told = final.select("caminho", "pasta", "aviso", "usou_fallback", "provedor_usado").join(written, "caminho").withColumn("etapa", F.when(F.col("situacao") == "falha", "organizacao"))
            failed = plan.where("erro is not null").select("caminho", "etapa", "erro", "aviso", "usou_fallback", "provedor_usado").withColumn("situacao", F.lit("falha"))
            return reliable(told.unionByName(failed, allowMissingColumns=True))

        def mark(results):
            state.keep(results)
            if not a.dry_run:
                state.mark(results)
            if on_slice:
                on_slice(results)

        done, stopped = process(spark, todo, plan_slice, write_slice, slice_size or SLICE * a.paralelo, mark)
        failures = 0
        if done:
            results = state.results(spark)
            report(results, planned, log)
            failures = batch.summary(results).first()["codigo_saida"]
        if stopped:
            log.error("lote interrompido: %s; %s documentos não foram processados", stopped, planned - done)
            if a.dry_run:
                state.clear()
            return 2
        state.clear()
        return failures
    finally:
        log.removeHandler(to_file)
        to_file.close()


if __name__ == "__main__":
    raise SystemExit(main())
