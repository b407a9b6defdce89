"""Tokens, look-alikes, scan noise, reading level: against brute force, round trips and planted cases."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estante.llm import lookalike as K
from estante.llm import readability as R
from estante.llm import scan_noise as N
from estante.llm import tokens as E


@pytest.fixture(scope="module")
def enc():
    return E.encoder()


PIECES = st.lists(st.sampled_from(["casa", " ", "  ", "\n", "\n\n", "'s", "123", "é", "ção", "你好", "🙂", "\t", "...", "a" * 40, " ", "\x1c", "\x85", "—", "x1y2", " 'll"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(2, 40))
def test_tree_encoding_is_encoding_of_the_whole(pieces, leaf):
    text = "".join(pieces)
    tree = _small(leaf)
    assert tree.encode(text) == E.encoder()._encode(text)
    assert tree.decode(tree.encode(text)) == text


_made = {}


def _small(leaf):
    if not _made:
        import public_tokenizers as P

        _made["t"] = E.TreeEncoder(P.path(E.TOKENIZER), P.PATTERN, 2)
    _made["t"].leaf_chars = leaf
    return _made["t"]


def test_long_text_without_spaces(enc):
    for text in ("a" * 30_000, "ab1 " * 20_000, " " * 9_000, "\n" * 3001 + "x"):
        assert enc.encode(text) == enc._encode(text)


def test_encode_texts_null_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "olá mundo", 9), (3, "olá mundo", 9)], "doc_id bigint, text string, ids int")
    rows = sorted((r["doc_id"], r["ids"]) for r in E.encode_texts(df).collect())
    assert [r[1] for r in rows[:2]] == [[], []] and rows[2] == rows[3] and rows[2][1]
    assert E.encode_texts(df.limit(0)).count() == 0
    assert {r["intact"] for r in E.round_trip(df).collect()} == {True}


def brute_form(s):
    kept = "".join(" " if unicodedata.category(c) == "Zs" else "" if unicodedata.category(c) == "Cf" else unicodedata.normalize("NFKC", c) if c == "ａ" else c for c in s)
    return unicodedata.normalize("NFC", kept)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aéõ zB́​ ａ­·ªº²—“̃cç", max_size=20)), max_size=8))
def test_lookalikes_agree_with_per_character_rules(values):
    column = pa.array(values, pa.string())
    assert K.normalise(column).to_pylist() == [None if v is None else brute_form(v) for v in values]
    assert K.suspects(column).tolist() == [v is not None and brute_form(v) != v for v in values]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="acoexáâếạ\u0301\u0302\u0303\u0323\u0327\u0328\u1100\u1161\u11a8\uac00", max_size=12), max_size=6))
def test_marks_and_syllables_are_composed_in_any_order(values):
    assert K.normalise(pa.array(values, pa.string())).to_pylist() == [unicodedata.normalize("NFC", v) for v in values]


def test_lookalike_words_and_scripts():
    cases = {"Caсhe nο século": "Cache no século", "λόγος e Война": "λόγος e Война", "Oﬁcina": "Oficina", "А obra": "A obra", "1.º e 2ª, m² — “x”": "1.º e 2ª, m² — “x”"}
    column = pa.array(list(cases))
    assert K.normalise(column).to_pylist() == list(cases.values())
    assert K.suspects(column).tolist() == [a != b for a, b in cases.items()]
    # Sliced columns and long values.
    assert K.normalise(pa.array(["x", "ａ" * 50_000, None]).slice(1)).to_pylist() == ["a" * 50_000, None]


def test_lookalike_queries_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "ｅm", ["a", None, "b​c"], 0), (1, "ｅm", ["a"], 0), (2, None, None, 0), (3, "", [], 0), (None, "ｅ", None, 0)], "registro_id bigint, titulo string, autores array<string>, campo int")
    assert sorted(map(tuple, K.find_lookalikes(df).collect())) == [(1, "autores"), (1, "titulo")]
    made = K.normalise_records(df).collect()
    assert len(made) == 5 and any(r["autores"] == ["a", None, "bc"] for r in made) and any(r["registro_id"] == 2 and r["autores"] is None for r in made)
    assert K.find_lookalikes(df.limit(0)).count() == 0


def scanned_page():
    body = ["A leitura dos documentos da bibliote-", "ca mostra que o argumento do trabalho", "depende da prirneira parte, segundo", "consta dos registros. Constatou-", "se que a leitura do argumento"]
    return "\n".join(["# Leitura de documentos", "", *body, "p. 5", "", "LEITURA DE DOCUMENTOS", "continua na segunda parte do trabalho", "e na leitura dos documentos da casa.", "", "Cronologia", "1901", "1902", "1903"])


def test_page_kinds():
    page = N.Page(scanned_page())
    kinds = {k: [page.lines[i] for i, x in enumerate(page.kind) if x == k] for k in ("pagina", "cabecalho")}
    assert kinds == {"pagina": ["p. 5"], "cabecalho": ["LEITURA DE DOCUMENTOS"]}


def test_scan_noise_on_planted_cases(spark):
    clean = "a primeira leitura dos documentos da biblioteca mostra que o argumento do trabalho depende da parte segundo consta dos registros constatou-se que continua na segunda casa e " * 40
    rows = [(1, scanned_page()), (1, scanned_page()), (2, clean), (3, None), (4, ""), (5, "Uma linha.")]
    df = spark.createDataFrame(rows, "conv_id bigint, markdown_completo string")
    found = sorted(map(tuple, N.scan_noise(df).collect()))
    assert found == [(1, 3, "hifen"), (1, 5, "caractere"), (1, 8, "pagina"), (1, 10, "cabecalho")]
    fixed = {r["conv_id"]: r["texto"] for r in N.repaired(df).collect()}
    assert "da biblioteca mostra" in fixed[1] and "primeira parte" in fixed[1] and "Constatou-se que a leitura do argumento continua" in fixed[1] and "p. 5" not in fixed[1]
    assert fixed[3] is None and fixed[5] == "Uma linha."
    assert N.scan_noise(df.limit(0)).count() == 0


def test_one_long_line_does_not_hide_a_scan(spark):
    clean = "a primeira leitura dos documentos da biblioteca mostra que o argumento do trabalho depende da parte segundo consta dos registros constatou-se que continua na segunda casa e " * 40
    long = scanned_page() + "\n\n" + "z" * 131
    short = "A leitura dos documentos da bibliote-\nca mostra que o argumento do trabalho\ndepende da prirneira parte, segundo"
    assert N.scanned(scanned_page()) and N.scanned(long) and N.scanned(short) and not N.scanned(clean) and not N.scanned("Uma linha\nOutra linha\n" * 9)
    got = sorted(map(tuple, N.scan_noise(spark.createDataFrame([(1, long), (2, clean), (3, short), (4, "w" * 50_000)], "conv_id bigint, markdown_completo string")).collect()))
    assert got == [(1, 3, "hifen"), (1, 5, "caractere"), (1, 8, "pagina"), (1, 10, "cabecalho"), (3, 1, "hifen"), (3, 3, "caractere")]


def test_beginnings_are_repaired_by_the_words_of_the_whole(spark):
    clean = "a primeira leitura dos documentos da biblioteca mostra que o argumento do trabalho depende da parte segundo consta dos registros constatou-se que continua na segunda casa e " * 80
    short = "\n".join(scanned_page().split("\n")[:6])
    card = short + "\n\n[...]\n\nFicha catalográfica\nSilva, Ana\n    Lugar : Casa, 1946."
    rows = [(1, scanned_page(), short), (2, clean, clean[:50]), (3, scanned_page(), None), (4, None, "Só\nisto."), (5, scanned_page(), card)]
    df = spark.createDataFrame(rows, "conv_id bigint, markdown_completo string, markdown_inicial string")
    got = {r["conv_id"]: r for r in N.repaired(df, beginning="markdown_inicial").collect()}
    first = "# Leitura de documentos\n\nA leitura dos documentos da biblioteca mostra que o argumento do trabalho depende da primeira parte, segundo consta dos registros. Constatou-"
    assert got[1]["inicial"] == first and got[1]["texto"].startswith(first)
    assert got[2]["inicial"] == clean[:50] and got[3]["inicial"] is None and got[4]["inicial"] == "Só\nisto." and got[4]["texto"] is None
    assert got[5]["inicial"].startswith(first + "\n\n[...]\n\n") and got[5]["inicial"].endswith("Ficha catalográfica\n\nSilva, Ana\n\n    Lugar : Casa, 1946.")


def test_misreads_agree_with_enumeration():
    word = "contrato"
    for a, b in N.CONFUSIONS:
        for i in range(len(word)):
            if word.startswith(a, i):
                seen = word[:i] + b + word[i + len(a) :]
                if seen != word:
                    assert N.misreads(seen, word) is not None
                    assert (N.anagram_hash(seen) - N.anagram_hash(word)) % N.MOD == (N.anagram_hash(b) - N.anagram_hash(a)) % N.MOD
    assert N.misreads("contratx", word) is None and N.misreads("", word) is None


def test_prose_leaves_attachments_out():
    text = '---\ntitulo: "X"\n---\n\nO gato dorme na casa.\n\nReferências\nSILVA, A. Obra. Lugar: Casa, 1990.\nSOUZA, B. Outra. Lugar: Casa, 1991.'
    assert R.prose(text) == "O gato dorme na casa."
    assert R.prose("Ficha catalográfica\nSilva, Ana\n    Lugar : Casa, 1946.\n    ISBN 1") == "" and R.prose(None) == "" and R.prose(" \n") == ""


def sentences(level, rng):
    easy, hard = ["gato", "casa", "sol", "rio", "bola"], ["epistemologia", "institucionalização", "performatividade", "transversalidade", "hermenêutica"]
    pool = easy * (4 - level) + hard * (level - 1) or easy
    return " ".join(" ".join(rng.choice(pool) + ("," if level > 2 and rng.random() < 0.2 else "") for _ in range(4 * level + rng.randint(0, 2))).capitalize() + "." for _ in range(6))


def test_reading_level_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, sentences(1 + i % 4, rng)) for i in range(240)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "Ficha catalográfica\nISBN 1"), (0, rows[0][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 + i % 4) for i in range(0, 240, 2)] + [(None, 1), (5000, 2)], "doc_id bigint, nivel int")
    labels = labels.union(spark.createDataFrame([(i, 1 + i % 4) for i in range(1, 240, 6)], "doc_id bigint, nivel int"))
    got = [(r["doc_id"], r["nivel"]) for r in R.reading_level(df, labels).collect()]
    graded = {r["doc_id"] for r in labels.collect()}
    held_out = [n == 1 + d % 4 for d, n in got if d not in graded]
    assert len(got) == 241 and len(held_out) == 80 and np.mean(held_out) > 0.93
    assert R.reading_level(df, labels.limit(0)).count() == 0 and R.reading_level(df.limit(0), labels).count() == 0
