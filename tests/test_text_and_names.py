"""Golden vectors and comparison with plain statements of the rules."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estante.functions import identifiers as I
from estante.functions import text as T
from estante.operators import naming


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('Psi/co\\lo:gia*?"<>|', "Psi co lo gia"), ("Dissertação sobre Ética", "Dissertação sobre Ética"), ("Título\n\tcom   quebras", "Título com quebras"), ("Nome do arquivo. ", "Nome do arquivo"),
        ("CON", "_CON"), ("lpt1", "_lpt1"), ("A" * 500, "A" * 120), (None, ""), ("   ", ""), ("..", ""), ("Zero​largura e\xa0espaço", "Zero largura e espaço"), ("Ética", "Ética"),
    ],
)
def test_sanitize(spark, text, expected):
    assert one(spark, T.sanitize(F.col("x")), x=("string", text)) == expected


def plain_fold(x):
    return unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()


def plain_tokens(x):
    return sorted(set(re.findall(r"[a-z]{4,}", plain_fold(x).lower())) - set(T.STOP_FILE))


SAMPLE = st.text(alphabet="abcdeÁçãõéß—ﬁ .-/Ａ1\xa0ûñ", max_size=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(SAMPLE, min_size=1, max_size=30))
def test_fold_tokens_and_slug_agree_with_plain_rules(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.fold(F.col("x")).alias("f"), T.tokens(F.col("x")).alias("t"), T.slug(F.col("x")).alias("s"))
    for r in df.collect():
        assert (r["f"], r["t"]) == (plain_fold(r["x"]), plain_tokens(r["x"]))
        assert r["s"] == (re.sub(r"[^a-z0-9]+", "-", plain_fold(r["x"]).lower()).strip("-") or "indefinido")


RECORD = {"k": ("string", "Livro"), "t": ("string", "Em Busca de Sentido"), "s": ("string", "Um psicólogo no campo de concentração"), "a": ("string", "Frankl, Viktor E."), "y": ("int", 2019), "e": ("string", "Vozes")}


def test_file_name(spark):
    name = naming.file_name(*map(F.col, "ktsaye"))
    assert one(spark, name, **RECORD) == "Livro - Em Busca de Sentido - Um psicólogo no campo de concentração - Frankl, Viktor E. - 2019 - Vozes"
    bare = RECORD | {"s": ("string", None), "y": ("int", None), "e": ("string", None)}
    assert one(spark, name, **bare) == "Livro - Em Busca de Sentido - Frankl, Viktor E"
    assert one(spark, name, **{k: (t, None) for k, (t, _) in RECORD.items()}) == T.NO_VALUE
    assert len(one(spark, name, **(RECORD | {"t": ("string", "x" * 119), "s": ("string", "y" * 119)}))) <= T.MAX_NAME


@pytest.mark.parametrize("area, sub, review, expected", [("Psicologia", "Logoterapia", False, "d/Psicologia/Logoterapia/Livros"), ("Psicologia", "Logoterapia", True, "d/revisao_manual/Psicologia/Logoterapia/Livros"), ("Psicologia", "   ", False, "d/Psicologia/Psicologia/Livros"), (None, None, False, f"d/{T.NO_VALUE}/{T.NO_VALUE}/Livros")])
def test_directory(spark, area, sub, review, expected):
    made = naming.directory(F.lit("d"), F.col("a"), F.col("s"), F.lit("Livro"), F.col("r"))
    assert one(spark, made, a=("string", area), s=("string", sub), r=("boolean", review)) == expected


@pytest.mark.parametrize("folder, name, fits, error", [("/d" * 10, "N" * 30, "N" * 30, False), ("/d" * 100, "N" * 300, "N" * 35, False), ("/d" * 200, "N" * 300, None, True)])
def test_path_budget(spark, folder, name, fits, error):
    r = one(spark, naming.within_path(F.col("n"), F.col("f")), n=("string", name), f=("string", folder))
    assert (r["nome"], r["erro"] is not None) == (fits, error)


def test_collisions_number_in_order_and_avoid_existing(spark):
    rows = [("p", "X", f"/{i:03}") for i in range(30)] + [("p", "X (2)", "/500"), ("q", "X", "/1"), (None, None, "/7"), (None, None, "/8")]
    df = spark.createDataFrame(rows, "pasta string, nome string, caminho string")
    turns = naming.collisions(df, ["pasta", "nome"], "caminho")
    assert [r["vez"] for r in turns.where("pasta = 'p' and nome = 'X'").orderBy("caminho").collect()] == list(range(1, 31))
    assert sorted(r["vez"] for r in turns.where("pasta is null").collect()) == [1, 2]
    there = spark.createDataFrame([("p", "X")], "pasta string, nome string")
    final = naming.resolve_against(turns.where("pasta is not null"), there).collect()
    names = [(r["pasta"], r["final"]) for r in final]
    assert len(names) == 32 and len(set(names)) == 32 and ("p", "X") not in names
    assert naming.collisions(df.limit(0), ["pasta", "nome"], "caminho").count() == 0


def test_no_document_is_lost_in_a_full_folder(spark):
    there = spark.createDataFrame([("p", "X")] + [("p", f"X ({i})") for i in range(2, 61)] + [("p", "X (99999999999999999999)")], "pasta string, nome string")
    df = spark.createDataFrame([("p", "X", "/a", 1), ("p", "X", "/b", 2), ("p", "X (61)", "/c", 1), (None, "X", "/d", 1), (None, "X", "/e", 1), ("p", None, "/f", 1), ("p", None, "/g", 1)], "pasta string, nome string, caminho string, vez bigint")
    final = {r["caminho"]: r["final"] for r in naming.resolve_against(df, there).collect()}
    assert final == {"/a": "X (62)", "/b": "X (63)", "/c": "X (61)", "/d": "X", "/e": "X", "/f": None, "/g": None}


@pytest.mark.parametrize(
    "value, text, found",
    [("978-85-323-1005-7", "ISBN 978 85 323 1005 7 fim", True), ("0034-7284", "doi 10.1590/S0034-72842023", False), ("10.1000/xyz", "veja 10.1000/XYZ.", True), ("", "x", False), (" - ", "x - y", False), (None, "x", False), ("1234", None, False)],
)
def test_confirmed(spark, value, text, found):
    assert one(spark, I.confirmed(F.col("v"), F.col("t")), v=("string", value), t=("string", text)) is found


@pytest.mark.parametrize(
    "isbn, issn, doi, citation, text, out",
    [
        ("978-1", None, None, "Obra. ISBN 978-1. Fim", "nada", (None, None, None, "Obra. Fim")),
        (None, None, None, "Obra. https://doi.org/10.1000/abc", "sem", (None, None, None, "Obra.")),
        (None, None, None, "Obra. DOI: 10.1000/abc", "texto 10.1000/abc aqui", (None, None, "10.1000/abc", "Obra. DOI: 10.1000/abc")),
        (None, "0034-7284", "10.1590/S0034-72842023", "X. 10.1590/S0034-72842023", "10.1590/S0034-72842023", (None, None, "10.1590/S0034-72842023", "X. 10.1590/S0034-72842023")),
        ("978-1", "12-3", "10.1234/z", "A. ISBN 978-1. ISSN 12-3. DOI: 10.1234/z.", "nada", (None, None, None, "A.")),
        ("Não informado", "Não informado", "Não informado", "A.", "nada", (None, None, None, "A.")),
        ("978-1", None, None, "ISBN 978-1. e ISBN 978-1.", "nada", (None, None, None, "e ISBN 978-1.")),
    ],
)
def test_discard(spark, isbn, issn, doi, citation, text, out):
    r = one(spark, I.discard_unconfirmed(*map(F.col, "abcrt")), a=("string", isbn), b=("string", issn), c=("string", doi), r=("string", citation), t=("string", text))
    assert tuple(r) == out


@pytest.mark.parametrize(
    "authors, citation, out",
    [
        (["Frankl, Viktor E."], "Frankl, Viktor E. Obra", "FRANKL, Viktor E. Obra"), (["Silva, Ana", "Souza, Zé"], "Silva, Ana; Souza, Zé.", "SILVA, Ana; SOUZA, Zé."), (["Silva, Ana"], "SILVA, Ana. X", "SILVA, Ana. X"),
        (["Ana Silva", None, ", x"], "Ana Silva. X", "Ana Silva. X"), ([], "A", "A"), (None, "A", "A"),
    ],
)
def test_surnames(spark, authors, citation, out):
    assert one(spark, I.surnames_upper(F.col("c"), F.col("a")), c=("string", citation), a=("array<string>", authors)) == out


def test_keys_and_years(spark):
    assert one(spark, I.doi_key(F.col("x")), x=("string", " https://doi.org/10.1000/xyz")) == "10.1000/xyz"
    assert one(spark, I.isbn_key(F.col("x")), x=("string", "978-85 3")) == "978853"
    assert one(spark, I.year_in(F.col("x")), x=("string", "May 2019")) == 2019 and one(spark, I.year_in(F.col("x")), x=("string", "s.d.")) is None
    dates = {"a": ("array<array<int>>", [[]]), "b": ("array<array<int>>", [[2018, 2]])}
    assert one(spark, I.year_of_parts(F.col("a"), F.col("b")), **dates) == 2018


@pytest.mark.parametrize("file, title, diverges", [("Frankl - Em Busca de Sentido (Vozes, 2019).pdf", "Em Busca de Sentido", False), ("scan001.pdf", "Qualquer", False), ("documento.pdf", "Qualquer", False), ("historia-da-filosofia-antiga.pdf", "Redes de computadores", True), ("filosofia-antiga-grega.pdf", "Filosofia", True), (None, None, False)])
def test_divergence(spark, file, title, diverges):
    made = F.coalesce(naming.divergence(F.col("f"), F.col("t"), F.lit(None).cast("string"), F.lit("Frankl, Viktor"), F.lit("Vozes")), F.lit(False))
    assert one(spark, made, f=("string", file), t=("string", title)) is diverges
