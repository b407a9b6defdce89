"""Truth tables, excerpts, answers, state, sources, sinks, the whole chain, streaming, and the driver contract."""

import datetime as dt
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F

from estante.config import Config, dotenv, parse_bool, parse_positive
from estante.operators import batch, excerpt, validate, verify
from estante.plans.pipeline import catalogue
from estante.sources.extractors import FatalError, HttpExtractor, extract
from estante.sources.files import convert, list_files
from estante.sources.sinks import write_plan
from estante.state import RunState
from estante.streaming.ingest import ingest

RESULT = "k string, erro string, registro struct<titulo:string>"


@pytest.mark.parametrize(
    "primary, fallback, final, used, error, warned",
    [
        ((None, "boa"), None, "boa", False, None, False), ((None, "má"), None, "má", False, None, True), ((None, "má"), (None, "boa"), "boa", True, None, False), ((None, "má"), (None, "má2"), "má2", True, None, True), ((None, "má"), ("e2", None), "má", False, None, True),
        (("e1", None), None, None, False, "e1", False), (("e1", None), (None, "boa"), "boa", True, None, False), (("e1", None), ("e2", None), None, False, "local: e1; fallback: e2", False),
    ],
)
def test_fallback_truth_table(spark, primary, fallback, final, used, error, warned):
    side = lambda x: spark.createDataFrame([("a", x[0], (x[1],) if x[1] else None)], RESULT)
    r = batch.merge_fallback(side(primary), side(fallback) if fallback else None, "k", F.col("registro.titulo").startswith("má")).first()
    assert (r["registro"]["titulo"] if r["registro"] else None, r["usou_fallback"], r["erro"], r["avisado"]) == (final, used, error, warned)


def test_pending_limit_and_order(spark):
    files = spark.createDataFrame([("/b/x",), ("/a b/x",), ("/a/x",), ("/c",)], "caminho string")
    done = spark.createDataFrame([("/c",), (None,), ("/zzz",), ("/c",)], "caminho string")
    assert [r[0] for r in batch.next_batch(files, done, 2).collect()] == ["/a/x", "/a b/x"]
    assert batch.pending(files, done.limit(0)).count() == 4 and batch.pending(files.limit(0), done).count() == 0


def test_summary_of_nothing_and_of_failures(spark):
    schema = "situacao string, provedor_usado string, aviso string, usou_fallback boolean"
    rows = [("sucesso", "local", None, False), ("sucesso", "pago", "", True), ("simulado", None, "x", None), ("falha", None, None, None)]
    r = batch.summary(spark.createDataFrame(rows, schema)).first()
    assert tuple(r) == (4, 2, 1, 1, 1, 2, 1, True, 1)
    assert tuple(batch.summary(spark.createDataFrame([], schema)).first())[:2] == (0, 0)


@pytest.mark.parametrize("main, extra, budget, out", [("a" * 100, "", 10, "a" * 10), ("a" * 5, "  \n", 10, "a" * 5)])
def test_budget(spark, main, extra, budget, out):
    df = spark.createDataFrame([(main, extra)], "m string, e string")
    assert df.select(excerpt.combine(F.col("m"), F.col("e"), budget)).first()[0] == out


def test_cip_page_is_found_and_kept(spark):
    pages = ["prefácio " * 50] * 6 + ["Dados: ISBN 123", "texto final da última página"]
    df = spark.createDataFrame([(pages,), (["só"],), ([],), (None,)], "p array<string>")
    rows = excerpt.excerpts(df, F.col("p"), 6, 500).collect()
    assert rows[0]["pagina_ficha"] == 6 and "ISBN 123" in rows[0]["trecho"] and len(rows[0]["trecho"]) <= 500
    assert rows[1]["trecho"] == "só" and rows[2]["trecho"] == ""


ANSWER = {"tipo_publicacao": "Livro", "area_principal": "A", "subarea": "B", "titulo": "T", "referencia_abnt": "R", "ano": "2019", "extra": 1}


@pytest.mark.parametrize("text, error", [(json.dumps(ANSWER), None), (json.dumps(ANSWER | {"ano": 2019.0}), None), (json.dumps(ANSWER | {"ano": 2019.5}), "ano inválido: 2019.5"), ("não é json", "JSON inválido"), (None, "JSON inválido"), (json.dumps({k: v for k, v in ANSWER.items() if k != "titulo"}), "faltam campos: titulo"), (json.dumps(ANSWER | {"tipo_publicacao": "Gibi"}), "tipo desconhecido: Gibi")])
def test_answers(spark, text, error):
    r = spark.createDataFrame([(text,)], "a string").select(validate.validated(F.col("a")).alias("v")).first()["v"]
    assert r["erro"] == error and (r["registro"] is None) == (error is not None)
    if error is None:
        assert r["registro"]["ano"] == 2019 and r["registro"]["autores"] == []


def test_registry_truth_table(spark):
    t = dt.datetime(2024, 1, 1)
    registry = spark.createDataFrame(
        [("10.1/a", "doi", "Outra coisa", ["Fulano"], "Casa", "2001", "L", t), ("10.1/b", "doi", "Busca Sentido", [], "Casa", "May 2001", "L", t), ("978", "isbn", "Zzz", [], "Casa I", "1999", "Lugar", t), ("978", "isbn", "Velho", ["X"], "Velha", "1900", None, dt.datetime(2020, 1, 1)), (None, "isbn", "n", [], None, None, None, t)],
        "chave string, tipo_chave string, titulo string, autores array<string>, editora string, data_publicacao string, local string, consultado_em timestamp",
    )
    rows = [(1, "10.1/a", "978"), (2, "doi:10.1/b", "9-7 8"), (3, None, "978"), (4, "10.9/z", None), (5, None, None)]
    records = spark.createDataFrame([(i, "Busca de Sentido", "Frankl", None, None, "", (isbn, None, doi)) for i, doi, isbn in rows], "registro_id bigint, titulo string, autor_principal string, editora_ou_periodico string, ano int, local string, identificadores struct<isbn:string,issn:string,doi:string>")
    got = {r["registro_id"]: r for r in verify.verify(records, registry).collect()}
    state = {i: (r["situacao_doi"], r["situacao_isbn"], r["editora_final"], r["ano_final"], r["local_final"]) for i, r in got.items()}
    assert state == {1: ("diverge", "ausente", None, None, None), 2: ("confere", "confere", "Casa", 2001, "Lugar"), 3: ("ausente", "confere", "Casa I", 1999, "Lugar"), 4: ("ausente", "ausente", None, None, None), 5: ("ausente", "ausente", None, None, None)}
    assert "Crossref" in got[1]["aviso_registro"] and got[2]["aviso_registro"] is None


def test_config_precedence(tmp_path):
    env = {"ESTANTE_PROVEDOR": "openai", "ESTANTE_MODELO": "m", "ESTANTE_API_KEY": "geral", "ESTANTE_OPENAI_API_KEY": "própria", "ESTANTE_MAX_PAGINAS": "3"}
    c = Config.resolve(env)
    assert (c.provider, c.api_key, c.pages, c.verify_online) == ("openai", "própria", 3, True) and Config.resolve(env, api_key="dada").api_key == "dada"
    assert Config.resolve({}).provider == "ollama"
    for bad in ({"ESTANTE_PROVEDOR": "nenhum"}, {"ESTANTE_PROVEDOR": "openai"}, {"ESTANTE_MAX_PAGINAS": "0"}, {"ESTANTE_VERIFICAR_ONLINE": "talvez"}):
        with pytest.raises(ValueError):
            Config.resolve(bad)
    assert parse_bool("Não", True) is False and parse_bool(" ", True) is True and parse_positive("", 6) == 6
    (tmp_path / ".env").write_text("# x\nexport A='1'\nB=2\n")
    (tmp_path / "sub").mkdir()
    assert dotenv(str(tmp_path / "sub")) == {"A": "1", "B": "2"}


def fakes():
    """Made within a function, so that workers get them by value."""

    class Fake:
        """A document of the PDF library."""

        needs_pass, metadata = False, {"title": "T", "x": ""}

        def __init__(self, path):
            if "ruim" in path:
                raise ValueError("corrompido")
            self.text = "" if "vazio" in path else "Dados da obra. ISBN 978-85-326-0871-3"
            self.page_count = 0 if "sem" in path else 2

        def __getitem__(self, k):
            return self

        def get_text(self, kind):
            return self.text


    class FakeExtractor:
        def answer(self, prompt):
            if "fatal" in prompt:
                raise FatalError("chave recusada")
            if "erro" in prompt:
                raise TimeoutError("tempo")
            return json.dumps(ANSWER | {"titulo": "Dados da obra", "autores": ["Silva, Ana"], "referencia_abnt": "Silva, Ana. ISBN 978-85-326-0871-3"})

    return Fake, FakeExtractor


def test_files_to_notes(spark, tmp_path):
    Fake, FakeExtractor = fakes()
    src = tmp_path / "in"
    (src / "_und").mkdir(parents=True)
    for n in ("a.pdf", "_x.PDF", "_und/d.pdf", ".oculto.pdf", "t.txt", "ruim.pdf", "vazio.pdf", "sem.pdf", "erro.pdf"):
        (src / n).write_bytes(b"%PDF")
    listing = list_files(spark, str(src))
    assert [r["nome_arquivo"] for r in listing.orderBy("ordem").collect()] == ["d.pdf", "_x.PDF", "a.pdf", "erro.pdf", "ruim.pdf", "sem.pdf", "vazio.pdf"]
    assert list_files(spark, str(src), recursive=False).count() == 6
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(src / "não"))
    docs = convert(listing, Fake).cache()
    assert {r["nome_arquivo"] for r in docs.where("erro is not null").collect()} == {"ruim.pdf", "sem.pdf", "vazio.pdf"}
    plan = catalogue(docs.where("erro is null"), FakeExtractor, str(tmp_path / "out"), "2025-01-01").cache()
    rows = {os.path.basename(r["caminho"]): r for r in plan.collect()}
    assert rows["erro.pdf"]["erro"].startswith("TimeoutError") and sorted(r["vez"] for r in rows.values() if r["vez"]) == [1, 2, 3]
    note = rows["a.pdf"]["nota"]
    head = yaml.safe_load(note.split("---\n")[1])
    assert list(head)[:2] == ["tipo_publicacao", "area_principal"] and len(head) == 20 and head["ano"] == 2019 and head["autores"] == ["Silva, Ana"] and "> SILVA, Ana. ISBN" in note
    ready = plan.where("erro is null").withColumn("final", F.concat("nome", F.lit("-"), F.col("vez").cast("string")))
    assert {r["situacao"] for r in write_plan(ready, dry_run=True).collect()} == {"simulado"} and not (tmp_path / "out").exists()
    for _ in range(2):
        assert {r["situacao"] for r in write_plan(ready).collect()} == {"sucesso"}
    assert len(list((tmp_path / "out").rglob("*.md"))) == 3 and len(list((tmp_path / "out").rglob("*.pdf"))) == 3


def test_command_line(spark, tmp_path):
    from estante import cli

    Fake, FakeExtractor = fakes()
    src = tmp_path / "in"
    src.mkdir()
    for n in ("a.pdf", "b.pdf"):
        (src / n).write_bytes(b"%PDF")
    base = ["-i", str(src), "-o", str(tmp_path / "out"), "--log", str(tmp_path / "erros.log")]
    use = {"state_folder": str(tmp_path / "s"), "make_extractor": FakeExtractor, "opener": Fake}
    assert cli.main([*base, "--dry-run"], **use) == 0 and not (tmp_path / "out").exists()
    assert cli.main([*base, "--subpasta-md", "notas"], **use) == 0
    assert len(list((tmp_path / "out").rglob("notas/*.md"))) == 2 and not (tmp_path / "s").exists()
    assert cli.main(["-o", "x"], **use) == 2 and cli.main(["--resume"], **use) == 2 and cli.main([*base, "-p", "nenhum"], **use) == 2
    (src / "c.pdf").mkdir()
    assert cli.main(["-i", str(src / "c.pdf"), "-o", "x"], **use) == 1


def counting(folder, fatal=""):
    """An extractor that leaves a file for each call, and a document whose text is its name."""

    class Named:
        needs_pass, metadata, page_count = False, {}, 1

        def __init__(self, path):
            self.name = os.path.basename(path)

        def __getitem__(self, k):
            return self

        def get_text(self, kind):
            return f"Texto de {self.name}"

    class Counting:
        def answer(self, prompt):
            name = prompt.split("Arquivo: ")[1].split("\n")[0]
            Path(folder, name).touch()
            if fatal and fatal in name:
                raise FatalError("chave recusada")
            return json.dumps(ANSWER | {"titulo": "Obra " + name[0], "autores": [], "referencia_abnt": "x"})

    return {"make_extractor": Counting, "opener": Named}


def batch_of(tmp_path, names="abcdef"):
    for sub in ("in", "chamadas"):
        (tmp_path / sub).mkdir()
    for n in names:
        (tmp_path / "in" / f"{n}.pdf").write_bytes(b"%PDF")
    calls = lambda: sorted(p.stem for p in (tmp_path / "chamadas").iterdir())
    written = lambda: sorted(p.name.split(" - ")[1] for p in (tmp_path / "out").rglob("*.md"))
    return ["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--log", str(tmp_path / "erros.log")], calls, written


def test_an_interrupted_run_resumes_with_the_rest(spark, tmp_path):
    from estante import cli

    base, calls, written = batch_of(tmp_path)

    def stop(results):
        raise KeyboardInterrupt

    use = counting(str(tmp_path / "chamadas")) | {"state_folder": str(tmp_path / "s"), "slice_size": 2}
    assert cli.main(base, on_slice=stop, **use) == 2 and calls() == ["a", "b"] and written() == ["Obra a", "Obra b"]
    # A trial in between leaves the progress alone.
    assert cli.main([*base, "--dry-run"], **use) == 0
    for p in (tmp_path / "chamadas").iterdir():
        p.unlink()
    seen = []
    assert cli.main(["--resume"], on_slice=lambda r: seen.append(r.count()), **use) == 0
    assert calls() == ["c", "d", "e", "f"] and seen == [2, 2] and len(written()) == 6 and not (tmp_path / "s").exists()


def test_a_fatal_answer_stops_the_batch(spark, tmp_path):
    from estante import cli

    base, calls, written = batch_of(tmp_path)
    use = {"state_folder": str(tmp_path / "s"), "slice_size": 2}
    assert cli.main(base, **counting(str(tmp_path / "chamadas"), fatal="d.pdf"), **use) == 2
    assert len(calls()) <= 4 and {"a", "b"} <= set(calls()) and {"Obra a", "Obra b"} <= set(written()) and "Obra d" not in written()
    assert cli.main(["--resume"], **counting(str(tmp_path / "chamadas")), **use) == 0 and len(written()) == 6


def test_failures_are_logged_and_wrong_places_are_told(spark, tmp_path):
    from estante import cli

    Fake, FakeExtractor = fakes()
    (tmp_path / "in").mkdir()
    for n in ("a.pdf", "ruim.pdf"):
        (tmp_path / "in" / n).write_bytes(b"%PDF")
    base = ["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--log", str(tmp_path / "erros.log")]
    use = {"state_folder": str(tmp_path / "s"), "make_extractor": FakeExtractor, "opener": Fake}
    assert cli.main(base, **use) == 1 and "corrompido" in (tmp_path / "erros.log").read_text() and "conversao" in (tmp_path / "erros.log").read_text()
    assert cli.main(["-i", str(tmp_path / "nada"), "-o", "x"], **use) == 2 and cli.main([*base, "--env", str(tmp_path / "x.env")], **use) == 2
    (tmp_path / "meu.env").write_text("ESTANTE_PROVEDOR=nenhum")
    assert cli.main([*base, "--env", str(tmp_path / "meu.env")], **use) == 2
    assert cli.note_folder(' a/b:c. ') == "a b c" and cli.note_folder("...") == "Markdown" and cli.note_folder(None) is None


def test_pages_become_markdown_or_plain_text(tmp_path):
    from estante.sources.files import convert_pdf

    Fake, _ = fakes()
    assert convert_pdf("a.pdf", Fake, lambda d, k: f"# p{k}")["paginas"] == ["# p0", "# p1"]

    def broken(d, k):
        raise ValueError(k)

    assert convert_pdf("a.pdf", Fake, broken)["markdown_completo"].startswith("Dados da obra")


def test_registries_are_asked_once_and_failures_tell_nothing(spark):
    from estante.sources.registry import lookup

    def fetch(url):
        if "10.1/a" in url:
            return {"message": {"title": ["Obra"], "author": [{"given": "Ana", "family": "Silva"}], "publisher": "Casa", "published": {"date-parts": [[None]]}, "published-print": {"date-parts": [[2001, 5]]}}}
        if "ISBN:123" in url:
            return {"ISBN:123": {"title": "Livro", "authors": [{"name": "B"}], "publish_date": "maio de 1999", "publish_places": [{"name": "Recife"}]}}
        raise OSError("sem rede")

    rows = [("/a", ("1-2 3", None, "https://doi.org/10.1/a")), ("/b", ("123", None, "10.1/a")), ("/c", ("9", "", "10.9/z")), ("/d", (None, None, None))]
    got = {r["chave"]: r for r in lookup(spark.createDataFrame(rows, "caminho string, identificadores struct<isbn:string,issn:string,doi:string>"), fetch).collect()}
    assert set(got) == {"10.1/a", "123"} and got["10.1/a"]["data_publicacao"] == "2001" and got["10.1/a"]["autores"] == ["Ana Silva"] and got["123"]["local"] == "Recife" and got["123"]["data_publicacao"] == "maio de 1999"


def test_a_spent_account_is_fatal(monkeypatch):
    import io
    import urllib.error
    import urllib.request

    from estante.sources import extractors

    def refuse(code, said):
        def send(*a, **k):
            raise urllib.error.HTTPError("http://x", code, "", {}, io.BytesIO(said.encode()))

        monkeypatch.setattr(urllib.request, "urlopen", send)

    refuse(400, "Your credit balance is too low")
    with pytest.raises(FatalError):
        extractors.post("http://x", {}, {})
    refuse(400, "bad field")
    with pytest.raises(RuntimeError) as other:
        extractors.post("http://x", {}, {})
    assert not isinstance(other.value, FatalError)


def test_listing_is_in_order_at_any_depth(spark, tmp_path):
    names = ["b/c/d/e.pdf", "b/a.pdf", "a b/z.pdf", "a.pdf", "b/c/x.pdf", ".h/y.pdf", "b/.oculto.pdf", "b/c/t.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"%PDF")
    want = sorted((str(tmp_path / n) for n in names if n.endswith("pdf") and "oculto" not in n), key=lambda p: p.split("/"))
    got = list_files(spark, str(tmp_path)).orderBy("ordem").collect()
    assert [r["caminho"] for r in got] == want and [r["ordem"] for r in got] == list(range(len(want)))


def test_fatal_and_blank_are_data(spark):
    _, FakeExtractor = fakes()
    rows = [("a", "fatal", "x"), ("b", "bom", "x"), ("c", "bom", " "), ("d", "bom", None)]
    got = {r["caminho"]: r for r in extract(spark.createDataFrame(rows, "caminho string, pedido string, trecho string"), FakeExtractor).collect()}
    assert got["a"]["fatal"] and got["b"]["erro"] is None and got["c"]["erro"] == got["d"]["erro"] == "trecho vazio"


@pytest.mark.parametrize("kind, reply", [("ollama", {"message": {"content": "{}"}}), ("anthropic", {"content": [{"type": "tool_use", "input": {}}]}), ("openai", {"choices": [{"message": {"content": "{}"}}]}), ("deepseek", {"choices": [{"message": {"content": "{}"}}]})])
def test_http_adapters(kind, reply):
    seen = []
    assert HttpExtractor(kind, "m", "http://x/", "k", lambda *a: seen.append(a) or reply).answer("p") == "{}"
    assert seen[0][0].startswith("http://x/") and seen[0][1]["model"] == "m"


def test_state(spark, tmp_path):
    s = RunState(str(tmp_path / "s"))
    assert s.load() is None and s.done(spark).count() == 0
    s.save(origem="o", destino="d", apikey="segredo")
    assert s.load()["origem"] == "o" and "segredo" not in Path(s.params_path).read_text()
    s.mark(spark.createDataFrame([("/a",), ("/a",)], "caminho string"))
    s.mark(spark.createDataFrame([("/b",)], "caminho string"))
    assert s.done(spark).count() == 2
    Path(s.params_path).write_text("{")
    assert s.load() is None
    s.clear()
    s.clear()
    assert s.done(spark).count() == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df = spark.createDataFrame([(1, "a")], "i int, t string")
    for n in range(2):
        df.write.mode("append").parquet(src)
        ingest(spark, src, "i int, t string", ck, lambda x: x.withColumn("u", F.upper("t")), out).awaitTermination()
        assert spark.read.parquet(out).count() == n + 1


def test_core_works_without_the_training_data_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "estante", tmp_path / "estante", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
