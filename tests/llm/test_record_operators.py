"""Names, canonical list, subjects, survivors, near duplicates, mixing: against brute force and planted cases."""

import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from estante.llm import canonical as C
from estante.llm import mixing as M
from estante.llm import names as A
from estante.llm import neardup as D
from estante.llm import subjects as S
from estante.llm import survivor as V

RECORD = """registro_id bigint, caminho string, fonte string, area_principal string, subarea string, titulo string, autores array<string>, autor_principal string,
editora_ou_periodico string, ano int, identificadores struct<isbn:string,issn:string,doi:string>, extraido_em timestamp, recebido_em timestamp, nome string"""


def record(i, **kw):
    t = dt.datetime(2024, 1, 1 + i % 28)
    base = {"registro_id": i, "caminho": f"/a/{i}", "fonte": "f1", "area_principal": None, "subarea": None, "titulo": None, "autores": None, "autor_principal": None, "editora_ou_periodico": None, "ano": None, "identificadores": None, "extraido_em": t, "recebido_em": t, "nome": "x"}
    return tuple((base | kw).values())


def test_name_variants_are_linked(spark):
    spelt = ["Silispabra, Beatriz", "SILISPABRA, Beatriz", "Silispabra, B.", "Bia Silispabra", "Dra. Beatriz Silispabra", "Silispabar, Beatriz", "Silispabra Beatriz", "Silispabra, Caetano", "Dromerdol, Beatriz Caetano de", "Dromerdol, B. C.", "Dromerdol, Beatriz Helena"]
    filler = [f"Xurt{chr(97 + i)}melo, {g}" for i in range(12) for g in ("Beatriz", "Caetano", "Helena")]
    houses = ["Editora Arcabuz", "Ed. Arcabuz", "Arcabuz", "Editora Arcabuz Ltda.", "Revista Brasileira de Arcabuz", "Universidade Federal de Porto Calmo", "UFPOC", "Federal de Porto Calmo, Universidade", "Universidade Federal de Porto Clamo"]
    rows = [(i, "autor", n, None) for i, n in enumerate(spelt + filler)] + [(100 + i, "editora", n, None) for i, n in enumerate(houses)] + [(200, "autor", None, 1), (None, "autor", "A", 1), (201, "autor", "", 1), (0, "autor", spelt[0], None)]
    names = spark.createDataFrame(rows, "nome_id bigint, campo string, nome string, registro_id bigint")
    records = spark.createDataFrame([record(i, autores=["Silispabra, Beatriz", None], editora_ou_periodico="Editora Arcabuz") for i in range(5)], RECORD)
    pairs = {tuple(r) for r in A.variant_pairs(names, records).collect()}
    want = {(a, b) for a in range(7) for b in range(a + 1, 7)} | {(8, 9)} | {(100 + a, 100 + b) for a in range(4) for b in range(a + 1, 4)} | {(105 + a, 105 + b) for a in range(4) for b in range(a + 1, 4)}
    assert pairs == want
    assert A.variant_pairs(names, records.limit(0)).count() > 0 and A.variant_pairs(names.limit(0), records).count() == 0


GIVEN = ["Iris", "Vicente", "Francisco", "Beatriz", "Julio", "Julia"]


def linked(spark, spelt, filler=(), records=()):
    """The pairs of positions in spelt that are linked, among fillers that make given names frequent."""
    others = [f"Xurt{chr(97 + i)}{chr(97 + j)}melo, {g}" for i in range(9) for j in range(9) for g in GIVEN] + list(filler)
    names = spark.createDataFrame([(i, "autor", n, None) for i, n in enumerate([*spelt, *others])], "nome_id bigint, campo string, nome string, registro_id bigint")
    table = spark.createDataFrame([record(i, autores=[n]) for i, n in enumerate(records)], RECORD)
    return {tuple(r) for r in A.variant_pairs(names, table).collect() if r["nome_b"] < len(spelt)}


def test_frequent_slips_and_nicknames_of_given_names_are_linked(spark):
    spelt = ["Vodrimer, Irris", "Vodrimer, Iris", "Jucoljico, Vicentinho", "Jucoljico, Vicente", "Jucoljico, V.", "Mapegur, Chico", "Mapegur, Francisco", "Dromerdol, Beatriz Irris", "Dromerdol, Beatriz Iris", "Melannur, Julio", "Melannur, Julia", "Zucolj, Ris", "Zucolj, Iris"]
    filler = [f"Yurt{chr(97 + i)}melo, {g}" for i in range(2) for g in ("Irris", "Vicentinho", "Chico", "Ris")]
    assert linked(spark, spelt, filler) == {(0, 1), (2, 3), (2, 4), (3, 4), (5, 6), (7, 8), (11, 12)}


def test_a_repeated_slip_in_a_frequent_family_name_is_linked(spark):
    spelt = ["Silispabra, Beatriz", "Silispabar, B.", "Silispabar, Beatriz", "Beatriz Silispabar", "Silispabar, Beatriz Julia", "Silispabra, Beatriz Julia", "Dias, Julio", "Diaz, Julio", "Lima, Vicente", "Lira, Vicente", "Souzamel, Iris", "Souzamel, I.", "Souzamel, Iris Julia", "Sousamel, Iris", "Sousamel, I.", "Sousamel, Iris Julia"]
    got = linked(spark, spelt, records=["Silispabra, Beatriz"] * 400 + ["Dias, Julio"] * 400)
    assert got == {(a, b) for a in range(6) for b in range(a + 1, 6)} | {(6, 7)} | {(a, b) for k in (10, 13) for a in range(k, k + 3) for b in range(a + 1, k + 3)}


def test_initials_that_are_also_particles_are_linked(spark):
    assert linked(spark, ["Fernumol, Estevao", "E. Fernumol", "Fernumol, E. P.", "Fernumol, Estevao Plinio", "Zubrepol, Iris e Silva"]) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}


def test_recall_and_precision_on_planted_spellings(spark):
    rng = random.Random(11)
    syllables = [c + v for c in "b d f g l m n p r s t v z br dr gr pr tr".split() for v in "aeiou"]
    given = ["Beatriz", "Caetano", "Helena", "Francisco", "Iris", "Eduardo", "Vicente", "Antônio", "Inês", "Joaquim", "Ludmila", "Plínio", "Renata", "Sérgio", "Tereza", "Úrsula"]
    short = {"Beatriz": "Bia", "Francisco": "Chico", "Eduardo": "Dudu", "Antônio": "Toninho", "Joaquim": "Quim", "Sérgio": "Serginho", "Tereza": "Teca"}

    def slip(w):
        k = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])

    spelt, of = [], {}
    for person in range(350):
        family = "".join(rng.choice(syllables) for _ in range(4)).capitalize()
        g, h = rng.sample(given, 2)
        h = h if rng.random() < 0.6 else ""
        full = f"{family}, {g} {h}".strip()
        forms = [full, full.upper(), full + " (org.)", f"{family}, {g[0]}.", f"{g} {h} {family}".replace("  ", " "), f"{family} {g}", f"{slip(family)}, {g}", f"{family}, {slip(g)}", f"{short.get(g, g)} {family}", f"{slip(family)}, {g[0]}.", f"Dra. {g} {family}"]
        for name in {full, *rng.sample(forms, rng.randint(0, 4))}:
            if name not in of:
                of[name] = person
                spelt.append(name)
    names = spark.createDataFrame([(i, "autor", n, None) for i, n in enumerate(spelt)], "nome_id bigint, campo string, nome string, registro_id bigint")
    # The spelling in full stands in most records.
    records = spark.createDataFrame([record(i, autores=[n]) for i, n in enumerate(n for n in spelt for _ in range(4 if n.istitle() and "," in n and "." not in n else 1))], RECORD)
    got = {tuple(r) for r in A.variant_pairs(names, records).collect()}
    want = {(i, j) for i, a in enumerate(spelt) for j, b in enumerate(spelt) if i < j and of[a] == of[b]}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.99 * len(got)


def test_one_edit_and_deletions_agree_with_brute_force(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    a, b = df.withColumnRenamed("w", "a"), df.withColumnRenamed("w", "b")
    from pyspark.sql import functions as F

    got = {tuple(r) for r in a.select("a", F.explode(C.lacking_one(F.col("a"))).alias("k")).join(b.select("b", F.explode(C.lacking_one(F.col("b"))).alias("k")), "k").select("a", "b").distinct().where(C.one_edit(F.col("a"), F.col("b"))).collect()}
    assert got == {(x, y) for x in words for y in words if A.near(x, y)}


AREAS = [(1, "area", "Psicologia", None), (2, "area", "Filosofia", None), (3, "area", "Artes", None), (15, "subarea", "Psicologia Clínica", "Psicologia"), (20, "subarea", "Ética", "Filosofia"), (27, "subarea", "Banco de Dados", "Tecnologia")]


def test_free_values_are_mapped(spark):
    areas = spark.createDataFrame(AREAS, "area_id bigint, nivel string, nome string, area_pai string")
    cases = {"psicologia": 1, "Psicoogia": 1, " Filosofia;": 2, "Filo.": 2, "Psicologia (geral)": 1, "philosophy": 2, "Clínica, Psicologia": 15, "banco_de_dados": 27, "Bacno de Dados": 27, "Aquarismo": 0, "???": 0, "xx": 0, "Antes": 3}
    rows = [record(i, area_principal=v) for i, v in enumerate(cases)] + [record(50, area_principal=None, subarea=" "), record(51, area_principal="Filosofia", subarea="etica"), record(0, area_principal="psicologia"), record(52, area_principal="", subarea="z" * 20_000)]
    records = spark.createDataFrame(rows, RECORD)
    got = {(r["registro_id"], r["campo"]): r["area_id"] for r in C.map_to_list(records, areas).collect()}
    assert got == {(i, "area_principal"): a for i, a in enumerate(cases.values())} | {(51, "subarea"): 20, (52, "subarea"): 0}
    assert {r["valor"] for r in C.unmatched(records, areas).collect()} >= {"Aquarismo", "???", "xx"}
    assert C.map_to_list(records.limit(0), areas).count() == 0
    assert {r["area_id"] for r in C.map_to_list(records, areas.limit(0)).collect()} == {0}


def test_other_words_and_abbreviations_are_no_slips(spark):
    areas = spark.createDataFrame([*AREAS, (41, "subarea", "Ecologia", "Biologia"), (63, "subarea", "Cinema", "Artes")], "area_id bigint, nivel string, nome string, area_pai string")
    said = ["Ecologia"] * 40 + ["ecologia"] * 4 + ["Enologia"] * 8 + ["Ecollogia", "Ecolgia", "Ecolgia", "Filo.", "Filo."]
    got = {r["registro_id"]: r["area_id"] for r in C.map_to_list(spark.createDataFrame([record(i, subarea=v) for i, v in enumerate(said)], RECORD), areas).collect()}
    assert got == {i: {"Enologia": 0, "Filo.": 2}.get(v, 41) for i, v in enumerate(said) if v != "Ecologia"}


def test_every_entry_within_reach_is_an_option(spark):
    names = [f"Estudos de Casa{c}" for c in "abcdefghij"]
    areas = spark.createDataFrame([(i, "area", f"Area{i}x", None) for i in range(10)] + [(20 + i, "subarea", n, f"Area{i}x") for i, n in enumerate(names)], "area_id bigint, nivel string, nome string, area_pai string")
    rows = [record(i, area_principal=f"Area{i}x", subarea="Estudos de Casa") for i in range(10)]
    got = {r["registro_id"]: r["area_id"] for r in C.map_to_list(spark.createDataFrame(rows, RECORD), areas).collect()}
    assert got == {i: 20 + i for i in range(10)}


def test_subjects_of_planted_topics(spark):
    rng = random.Random(3)
    topics = {1: ["terapia", "trauma", "escuta", "luto", "apego"], 2: ["virtude", "estoicismo", "ontologia", "dialética", "niilismo"], 3: ["retrato", "aquarela", "teatro", "dança", "mosaico"]}
    filler = [f"comum{c}" for c in "abcdefghij"]

    def text(shares):
        return " ".join(rng.choice(topics[a]) if rng.random() < 0.3 and (a := rng.choices(list(shares), shares.values())[0]) else rng.choice(filler) for _ in range(300))

    docs, hint, truth = [], [], set()
    for i in range(150):
        main, other = 1 + i % 3, 1 + (i + 1) % 3
        docs.append((i, f"/a/{i}", text({main: 0.6, other: 0.4} if i % 5 == 0 else {main: 1.0})))
        truth |= {(i, main)} | ({(i, other)} if i % 5 == 0 else set())
        hint.append(record(i, caminho=f"/a/{i}", area_principal=AREAS[(main if i % 7 else other) - 1][2]))
    docs += [(900, "/a/900", None), (901, "/a/901", ""), (902, None, " ".join(filler * 30))]
    df = spark.createDataFrame(docs, "conv_id bigint, caminho string, markdown_completo string")
    areas = spark.createDataFrame(AREAS, "area_id bigint, nivel string, nome string, area_pai string")
    labels = spark.createDataFrame([t for t in sorted(truth) if t[0] < 60] + [(None, 1)], "conv_id bigint, area_id bigint")
    records = spark.createDataFrame(hint, RECORD)
    got = {tuple(r) for r in S.subjects(df, records, areas, labels).collect()}
    assert len(got & truth) / len(got | truth) > 0.95 and not any(c >= 900 for c, _ in got)
    assert S.subjects(df.limit(0), records, areas, labels).count() == 0
    assert S.subjects(df, records, areas, labels.limit(0)).count() > 0 and S.subjects(df, records.limit(0), areas, labels).count() == 0


def test_thresholds_of_subjects_come_from_all_labels(spark):
    n = 44_000  # half of them with a hash under 0, more than 20,000
    docs = spark.range(n).select(F.col("id").alias("conv_id"), (F.xxhash64("id") < 0).alias("low"), ((F.col("id") + 1) / n).alias("densidade"))
    said = F.expr("if(low, map(1L, 0.1D), map(1L, 0.3D, 2L, 0.15D, 3L, 0.15D, 4L, 0.15D))")
    mixture = docs.select("conv_id", F.explode(said).alias("area_id", "parte"), "densidade")
    areas = spark.createDataFrame([(i, "area", f"A{i}", None) for i in range(1, 5)] + [(9, "subarea", "B", "A1")], "area_id bigint, nivel string, nome string, area_pai string")
    labels = docs.select("conv_id", F.lit(1).cast("bigint").alias("area_id"))
    odd = spark.createDataFrame([(None, 1), (3, None), (3, 1), (5, 9), (n + 1, 9)], "conv_id bigint, area_id bigint")
    share, least = S.calibrated(mixture.union(mixture.where("conv_id < 50")), labels.union(odd), areas)
    assert share == pytest.approx(0.2, abs=1e-9) and least == pytest.approx(np.quantile(np.arange(1, n + 1) / n, 0.02) * 0.75, rel=1e-9)


@pytest.mark.parametrize("few", [0, 10**6])
def test_thresholds_of_subjects_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(S, "BROADCAST_DOCS", few, raising=False)
    rng = random.Random(8)
    rows = [(c, a, rng.random() * 0.5, d) for c in range(300) for d in [round(rng.random(), 1)] for a in rng.sample(range(1, 6), 3)]
    truth = {(c, a) for c, a, part, _ in rows if rng.random() < 2 * part and c < 200} | {(999, 1)}
    areas = spark.createDataFrame([(i, "area", f"A{i}", None) for i in range(1, 6)], "area_id bigint, nivel string, nome string, area_pai string")
    known = {c for c, _ in truth}
    marks = {}
    for x in np.arange(0.08, 0.36, 0.01):
        told = {(c, a) for c, a, part, _ in rows if part >= x and c in known}
        marks[float(x)] = 2 * len(told & truth) / (len(told) + len(truth)) - abs(x - 0.2) * 0.01
    share, least = S.calibrated(spark.createDataFrame(rows, "conv_id bigint, area_id bigint, parte double, densidade double"), spark.createDataFrame(sorted(truth), "conv_id bigint, area_id bigint"), areas)
    assert marks[share] == max(marks.values())
    assert least == pytest.approx(np.quantile(list({c: d for c, _, _, d in rows if c in known}.values()), 0.02) * 0.75, rel=1e-9)


def test_multiplicative_updates_keep_mass_and_recover_a_mixture():
    w = np.array([[0.5, 0], [0.5, 0], [0, 0.7], [0, 0.3]])
    h = S.mixtures(np.array([0, 0, 0, 1]), np.array([0, 1, 2, 2]), np.array([3.0, 3.0, 2.0, 5.0]), 2, w)
    assert np.allclose(h.sum(1), [8, 5]) and np.allclose(h[0] / h[0].sum(), [0.75, 0.25], atol=0.01) and h[1, 0] < 1e-6


def test_survivors_against_brute_force(spark):
    rng = random.Random(4)
    trust = {"f1": 3, "f2": 2, "f3": 1}
    rows = [record(i, fonte=rng.choice(["f1", "f2", "f3", None, "f9"]), ano=rng.choice([None, 19, 1999, 2050, 2000]), editora_ou_periodico=rng.choice([None, "", "N/A", "Editora A", "[s.n.]"])) for i in range(60)]
    groups = [(g, rng.randrange(60)) for g in range(12) for _ in range(4)] + [(None, 1), (3, None), (99, 12345)]
    R, G = spark.createDataFrame(rows + rows[:3], RECORD), spark.createDataFrame(groups + groups[:2], "grupo_id bigint, registro_id bigint")
    F = spark.createDataFrame(list(trust.items()) + [(None, 9)], "fonte string, confianca int")
    want = {}
    for g, i in {x for x in groups if None not in x and x[1] < 60}:
        r = rows[i]
        for field, value, ok in (("ano", r[9], r[9] in (1999, 2000)), ("editora_ou_periodico", r[8], r[8] == "Editora A")):
            if ok:
                want.setdefault((g, field), []).append((-trust.get(r[2], -1), -r[11].timestamp(), -r[12].timestamp(), i))
    got = {(r["grupo_id"], r["campo"]): r["registro_id"] for r in V.survivors(G, R, F).collect()}
    assert got == {k: min(v)[3] for k, v in want.items()}
    assert V.survivors(G.limit(0), R, F).count() == 0 and V.survivors(G, R, F.limit(0)).count() == len(want)


@pytest.mark.parametrize(
    "kind, value, ok",
    [
        ("isbn", "978-85-326-0871-3", False), ("isbn", "ISBN 85-359-0277-5", True), ("isbn", "979-99-0000-831-5", True), ("isbn", "9799900000005", True), ("isbn", "080442957x", True), ("isbn", "979-99-00", False), ("isbn", None, False), ("isbn", "", False),
        ("issn", "0378-5955", True), ("issn", "issn 2434-561x", True), ("issn", "0378-5954", False), ("issn", "0378-5", False),
        ("doi", "DOI 10.1000/xyz", True), ("doi", "https://doi.org/10.1000/xyz", True), ("doi", "10.94095/", False), ("doi", "doi:", False), ("doi", "psic.12", False), ("doi", "em processamento", False), ("doi", "10.12345/PSIC.1.v2", True),
    ],
)
def test_identifier_standards(spark, kind, value, ok):
    from pyspark.sql import functions as F

    check = {"isbn": V.isbn_valid, "issn": V.issn_valid, "doi": V.doi_valid}[kind]
    assert spark.createDataFrame([(value,)], "v string").select(check(F.col("v"))).first()[0] is ok


def shingled(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"p{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(25)]
    for t in texts[:15]:
        w = t.split()
        for _ in range(rng.randint(1, 25)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", "um dois", "um dois três", "um  dois\ntrês"]
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:2]], "conv_id bigint, markdown_completo string, id int")
    sets = {i: shingled(t) for i, t in rows}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0
    want = {(a, b) for a, _ in rows for b, _ in rows if a < b and sim(a, b) >= 0.5}
    assert {tuple(r) for r in D.similar_pairs(df).collect()} == want
    classes = {r["conv_id"]: r for r in D.copy_classes(df).collect()}
    assert classes[41]["primeiro"] == 1 and classes[1]["copias"] == 3 and len(classes) == len([s for s in sets.values() if s])
    assert D.similar_pairs(df.limit(0)).count() == 0


def test_a_hot_band_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    rng = random.Random(5)
    stock = [f"p{k}" for k in range(60)]
    texts = [" ".join(w if rng.random() > 0.03 else f"x{i}_{k}" for k, w in enumerate(stock)) for i in range(45)]
    sets = [{tuple(t.split()[k : k + 3]) for k in range(58)} for t in texts]
    want = {(i, j) for i in range(45) for j in range(i + 1, 45) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    got = {tuple(r) for r in D.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "conv_id bigint, markdown_completo string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 500


def test_many_copies_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(D, "EXPAND_COPIES", 3)
    df = spark.createDataFrame([(i, "a b c d e") for i in range(6)] + [(9, "a b c d e f")], "conv_id bigint, markdown_completo string")
    assert {tuple(r) for r in D.similar_pairs(df).collect()} == {(0, i) for i in range(1, 6)} | {(0, 9)}


def test_every_coordinate_fills_and_estimates_similarity():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(base[:600]), np.unique(base[300:]), base[:1], base[:7]]
    sk = D.sketches(sets)
    assert (sk < np.iinfo(np.uint64).max).all() and abs((sk[0] == sk[1]).mean() - 1 / 3) < 0.08


def test_pfair_deviates_by_less_than_a_block():
    weights = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6)}
    made = M.pfair_schedule(weights, {"a": 300, "b": 200, "c": 100})
    done = dict.fromkeys(weights, 0)
    assert len(made) == 600
    for s, j, slot in made:
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - weights[x] * (slot + 1)) < 1 for x in weights)


def test_the_plan_does_not_grow_with_the_corpus():
    made = M.plan({"a": 10**15, "b": 10**15}, {"a": (0.123456789, 1), "b": (0.3, 1)})
    weights = M.in_parts({"a": Fraction("0.123456789") / Fraction("0.423456789"), "b": Fraction("0.3") / Fraction("0.423456789")})
    assert len(made["schedule"]) == made["period"] <= M.PERIOD and sum(weights.values()) == 1 and abs(weights["a"] - Fraction("0.123456789") / Fraction("0.423456789")) <= Fraction(1, M.PERIOD)
    assert sorted(slot for _, _, slot in made["schedule"]) == list(range(made["period"]))


def test_mix_reaches_the_shares(spark):
    rng = random.Random(7)
    rows = [(i, rng.choices(["a", "b", "c"], [70, 25, 5])[0], rng.randint(1, 60)) for i in range(3000)] + [(9001, None, 5), (9002, "z", 5), (9003, "a", 0), (9004, "a", None)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("ausente", 0.1, 3), (None, 0.5, 1)], "source string, peso double, max_repeticoes int")
    block = 500
    mixed = M.mix(sizes, goal, block).cache()
    part = {r["source"]: r for r in M.shares(mixed, goal).collect()}
    assert part["ausente"]["tokens"] == 0 and all(abs(part[s]["parte"] - w / 0.9) < 0.01 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)))
    used = mixed.groupBy("source", "doc_id").count().collect()
    assert all(r["count"] <= {"a": 1, "b": 2, "c": 4}[r["source"]] for r in used)
    total = sum(part[s]["tokens"] for s in "abc")
    got = {(r["slot"], r["source"]): r["t"] for r in mixed.groupBy("slot", "source").agg(F.sum("n_tokens").alias("t")).collect()}
    at = dict.fromkeys("abc", 0)
    for slot in range(total // block):
        for s, w in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
            at[s] += got.get((slot, s), 0)
            assert abs(at[s] - w * (slot + 1) * block) < block + 60
    assert total > 0 and M.mix(sizes.limit(0), goal).count() == 0 and M.mix(sizes, goal.limit(0)).count() == 0
