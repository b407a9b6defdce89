"""Variant spellings of names typed by people, linked by noisy-channel attribution.

Spellings are read into a form (family name and given names, or kind and core of a
publisher), and equal forms are one node.  Canonical candidates of a node are the
most frequent nodes that could have been shortened or mistyped to its form.  The
posterior of a candidate is its frequency times the likelihood of the steps between
(a slip of the pen, a nickname, a kind left out); the hypothesis that the node is a
name of its own is the chance that another person bears this family name and these
given names.  Each node is attached to the candidate of the largest posterior, if
that beats the name of its own.  The likelihoods of the steps are counted in a first
attribution and used in the second.

No candidate is looked for by comparing all nodes of a family name: every node gives
the forms it may be shortened to, only the most frequent node is kept of each form,
and a node asks for its own form, under its own family name and given names and
under those one edit, a nickname or a diminutive away.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estante.llm.canonical import one_edit
from estante.session import reliable

# Words around a name that are no part of it.
PARTICLES = frozenset("de da do dos das e di del della van von y".split())
TITLES = frozenset("dr dra prof profa professor professora sr sra me ma msc phd eng org orgs ed coord trad".split())
# Nicknames and the given names they stand for.
NICKNAMES = {
    "chico": "francisco", "xico": "francisco", "quim": "joaquim", "quincas": "joaquim", "giba": "gilberto", "lena": "helena", "rafa": "rafael", "dito": "benedito", "guga": "gustavo", "gu": "gustavo", "zefa": "josefina", "zefinha": "josefina", "toninho": "antonio", "tonho": "antonio", "tonico": "antonio", "bia": "beatriz", "rico": "ricardo", "nati": "natalia", "nando": "fernando", "duda": "eduardo", "dudu": "eduardo", "edu": "eduardo", "beto": "alberto",
    "ze": "jose", "zeca": "jose", "nico": "nicolau", "val": "valdemar", "ceci": "cecilia", "moni": "monica", "pati": "patricia", "tere": "tereza", "teca": "tereza", "lu": "lucia", "lulu": "lucia", "ju": "julia", "juju": "julia", "deb": "debora", "debinha": "debora", "cae": "caetano", "le": "leandro", "re": "renata", "mila": "ludmila", "marquinhos": "marcos", "serginho": "sergio", "vica": "vicente", "tavinho": "otavio", "tavo": "gustavo", "hele": "helena", "kati": "katia", "titina": "quiteria", "neca": "ines", "geninha": "eugenia", "cida": "aparecida",
}
# Words that tell the kind of a publisher, and short forms of them.
KINDS = {
    "editora": "editora", "edit": "editora", "ed": "editora", "editorial": "editora", "edicoes": "editora", "editores": "editora", "ltda": "editora", "livraria": "editora",
    "revista": "revista", "rev": "revista", "r": "revista", "journal": "revista",
    "universidade": "universidade", "univ": "universidade", "university": "universidade",
}
FILLING = frozenset("brasileira bras brasil federal fed grafica sa me eireli cia".split())
LONG = ["editora", "revista", "brasileira", "universidade", "federal", "grafica"]
#: Start values of the steps' likelihoods: a slip, a nickname or diminutive, a beginning or end of a given name; and how many counts they weigh.
STEPS, WEIGHT = {"erro": 0.018, "apelido": 0.05, "parte": 0.007}, 50.0
#: The share of names that are new persons; nats a letter tells in a name; the share of an initial.
NEW, LETTER, INITIAL = 0.3, 2.5, 0.05
#: Log of how many times as frequent a family name must be for each further spelling of a slip of it, and of the most that is asked.
AGAIN, MOST = 0.7, 4.0
#: How many times as frequent as another a given name at one edit must be for the other's share to be that of a slip.
PRIOR = 20
#: What a publisher's name without its kind costs: less if the kind is that of most publishers.
KIND_LEFT_OUT, PUBLISHER_LEFT_OUT = 0.7, 0.35


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours at most."""
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(x) > 1 and x[2:] == y[2:])


def _words(text: str, initials: bool) -> list[str]:
    """Words without particles; a single letter is an initial if it may be (initials) or has a dot."""
    found = re.findall(r"([a-z]+)(\.?)", text)
    return [t for i, (t, dot) in enumerate(found) if t not in PARTICLES or len(t) == 1 and (initials or dot or not i)]


def read_author(nome: str) -> tuple[list[str], list[str] | None]:
    """Family name and at most two given names, folded; without a comma also the reading that begins with the family name."""
    text = re.sub(r"\(.*?\)|\[.*?\]", " ", fold(nome))
    form = lambda family, given: ["".join(family), *(given + ["", ""])[:2]]
    if "," in text:
        head, tail = text.split(",", 1)
        family, every = _words(head, False), _words(tail, True)
        given = [t for t in every if t not in TITLES] or every
        return (form(family, given) if family else form(given[-1:], given[:-1])), None
    words = _words(text, False)
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    if len(words) < 2:
        return form(words, []), None
    return form(words[-1:], words[:-1]), form(words[:1], words[1:])


def read_publisher(nome: str) -> tuple[str, str, str]:
    """Kind (or ""), core and acronym, folded."""
    text = fold(nome)
    acronym = next((m.lower() for m in re.findall(r"\bUF[A-Z]{1,5}\b", nome)), "")
    kind, core = "", []
    for t in re.findall(r"[a-z0-9]+", text):
        word = t if len(t) < 6 else next((w for w in LONG if near(t, w)), t)
        if t == acronym or word in FILLING or t in PARTICLES:
            continue
        if word in KINDS:
            kind = kind if kind in ("revista", "universidade") else KINDS[word]
        else:
            core.append(t)
    if acronym and not kind:
        kind = "universidade"
    return kind, " ".join(core), acronym


def parsed(names: DataFrame) -> DataFrame:
    """nome_id, campo, nome, tipo, nucleo, g1, g2, sigla: the form each spelling is read as.

    A name without a comma begins with the family name if, by the names that have
    one, its last word is more of a given name than its first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for campo, nome in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if campo == "autor":
                    first, other = read_author(nome)
                    rows.append(("", *first, "", *(other or [None] * 3), "," in nome))
                else:
                    kind, core, acronym = read_publisher(nome)
                    rows.append((kind, core, "", "", acronym, None, None, None, False))
            columns = list(zip(*rows)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.string()) for c in columns[:8]), pa.array(columns[8], pa.bool_())], names=["nome_id", "campo", "nome", "tipo", "nucleo", "g1", "g2", "sigla", "nucleo2", "h1", "h2", "virgula"])

    read = reliable(
        names.where("nome_id is not null and campo is not null and nome is not null").select(F.col("nome_id").cast("bigint"), "campo", "nome")
        .mapInArrow(run, "nome_id bigint, campo string, nome string, tipo string, nucleo string, g1 string, g2 string, sigla string, nucleo2 string, h1 string, h2 string, virgula boolean")
    )
    said = read.where("virgula").select(F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(d).alias("d")) for c, d in (("g1", 1), ("g2", 1), ("nucleo", 0))])).alias("x")).select("x.*").where("length(t) > 1")
    often = said.groupBy("t").agg(((F.sum("d") + 0.5) / (F.count("*") - F.sum("d") + 0.5)).alias("dado"))
    unsure, sure = read.where("nucleo2 is not null"), read.where("nucleo2 is null")
    # In the first reading the last word is the family name, in the other the first.
    told = unsure.join(often.select(F.col("t").alias("nucleo"), F.col("dado").alias("ultimo")), "nucleo", "left").join(often.select(F.col("t").alias("nucleo2"), F.col("dado").alias("primeiro")), "nucleo2", "left")
    first_is_family = F.when(F.length("nucleo") == 1, True).when(F.length("nucleo2") == 1, False).otherwise(F.coalesce("ultimo", F.lit(1.0)) > F.coalesce("primeiro", F.lit(1.0)))
    pick = lambda a, b: F.when(first_is_family, F.col(b)).otherwise(F.col(a)).alias(a)
    out = ["nome_id", "campo", "nome", "tipo", "nucleo", "g1", "g2", "sigla"]
    return sure.select(*out).union(told.select("nome_id", "campo", "nome", "tipo", pick("nucleo", "nucleo2"), pick("g1", "h1"), pick("g2", "h2"), "sigla"))


def frequencies(records: DataFrame) -> DataFrame:
    """campo, nome, n: in how many places of the records each spelling stands."""
    authors = records.select(F.lit("autor").alias("campo"), F.explode(F.array_distinct(F.concat(F.coalesce("autores", F.array().cast("array<string>")), F.array("autor_principal")))).alias("nome"))
    houses = records.select(F.lit("editora").alias("campo"), F.col("editora_ou_periodico").alias("nome"))
    return authors.union(houses).where("nome is not null").groupBy("campo", "nome").agg(F.count("*").alias("n"))


def deletions(c: Column) -> Column:
    """Hashes of the string and of all strings that lack one of its characters; two strings at one edit share one."""
    return F.array_distinct(F.concat(F.array(F.xxhash64(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.xxhash64(F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))))


def near_families(families: DataFrame) -> DataFrame:
    """campo, nucleo, outro: names at one edit from each other."""
    keyed = families.where("length(nucleo) > 2").select("campo", "nucleo", F.explode(deletions(F.col("nucleo"))).alias("k"))
    other = keyed.select("campo", F.col("nucleo").alias("outro"), "k")
    return keyed.join(other, ["campo", "k"]).where(F.col("nucleo") != F.col("outro")).select("campo", "nucleo", "outro").distinct().where(one_edit(F.col("nucleo"), F.col("outro")))


def other_given(tokens: DataFrame) -> DataFrame:
    """g, outro, passo, taxa: the more frequent given names that each given name may stand for, by which step, and how often that is met.

    taxa is counted where the other name is PRIOR times as frequent, else 0.
    """
    more = lambda df: df.where((F.col("fo") > F.col("f")) | (F.col("fo") == F.col("f")) & (F.col("outro") > F.col("g")))
    of = tokens.select(F.col("g").alias("outro"), F.col("f").alias("fo"))
    keyed = tokens.where("length(g) > 2").withColumn("k", F.explode(deletions(F.col("g"))))
    slips = more(keyed.join(of.where("length(outro) > 2").withColumn("k", F.explode(deletions(F.col("outro")))), "k").where("g <> outro")).select("g", "outro").distinct().where(one_edit(F.col("g"), F.col("outro"))).select("g", "outro", F.lit("erro").alias("passo"))
    listed = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    stem = F.regexp_replace("g", "z?inh[oa]$", "")
    small = F.when(F.col("g").rlike(".{3,}inh[oa]$"), F.array(stem, F.concat(stem, F.substring("g", -1, 1)), F.concat(stem, F.lit("e")))).otherwise(F.array().cast("array<string>"))
    nicknames = tokens.select("g", F.explode(F.array_compact(F.concat(F.array(F.try_element_at(listed, F.col("g"))), small))).alias("outro")).where("g <> outro").distinct().select("g", "outro", F.lit("apelido").alias("passo"))
    ends = F.flatten(F.transform(F.sequence(F.lit(3), F.length("outro") - 1), lambda n: F.array(F.substring(F.col("outro"), F.lit(1), n), F.substring(F.col("outro"), F.length("outro") - n + 1, n))))
    parts = more(of.where("length(outro) between 4 and 40").withColumn("g", F.explode(F.array_distinct(ends))).join(tokens, "g").where("g <> outro")).select("g", "outro", F.lit("parte").alias("passo"))
    every = slips.union(nicknames).union(parts)
    rank = F.when(F.col("passo") == "apelido", 2).when(F.col("passo") == "erro", 1).otherwise(0)
    found = every.groupBy("g", "outro").agg(F.max_by("passo", rank).alias("passo")).join(tokens, "g").join(of, "outro", "left")
    return found.select("g", "outro", "passo", F.when((F.col("passo") == "erro") & (F.col("fo") >= PRIOR * F.col("f")), F.col("f") / F.col("fo")).otherwise(0.0).alias("taxa"))


def _key(exact: Column, campo: str, tipo: Column, nucleo: Column, g1: Column, g2: Column) -> Column:
    return F.concat_ws("|", exact, F.col(campo), tipo, nucleo, g1, g2)


def candidates(nodes: DataFrame) -> DataFrame:
    """chave, pai, and its figures: of each form a node may be shortened to, and of its own form, the most frequent node."""
    c = F.col
    whole = lambda g: F.length(g) > 1
    first, second = lambda g: F.substring(g, 1, 1), F.lit("")
    form = lambda exact, tipo, g1, g2: _key(F.lit(exact), "campo", tipo, c("nucleo"), g1, g2)
    two = c("g2") != ""
    forms = [
        form("x", c("tipo"), c("g1"), c("g2")),
        F.when(whole("g2"), form("a", c("tipo"), c("g1"), first("g2"))),
        F.when(two, form("a", c("tipo"), c("g1"), second)),
        F.when(whole("g1") & two, form("a", c("tipo"), first("g1"), first("g2"))),
        F.when(whole("g1") & whole("g2"), form("a", c("tipo"), first("g1"), c("g2"))),
        F.when(whole("g1"), form("a", c("tipo"), first("g1"), second)),
        F.when(c("g1") != "", form("a", c("tipo"), F.lit(""), second)),
        F.when(c("tipo") != "", form("a", F.lit(""), c("g1"), c("g2"))),
    ]
    figures = F.struct("no", "n", "nivel", "familia_n", "uso", "tipo")
    given = nodes.where("length(nucleo) > 1").select(F.explode(F.array_distinct(F.array_compact(F.array(*forms)))).alias("chave"), figures.alias("c"), F.struct(c("n"), -c("no")).alias("posto"))
    return given.groupBy("chave").agg(F.max_by("c", "posto").alias("c"))


def attribute(nodes: DataFrame) -> DataFrame:
    """no, pai: the canonical form of the largest posterior, for nodes that are no name of their own.

    nodes: no, campo, tipo, nucleo, g1, g2, n, formas (how many spellings).
    """
    c = F.col
    whole = lambda g: F.length(g) > 1
    families = reliable(nodes.groupBy("campo", "nucleo").agg(F.sum("n").alias("familia_n"), F.sum("formas").alias("familia")))
    # How many family names a given name stands with: its spellings in one family are one.
    tokens = reliable(nodes.where("campo = 'autor'").select("nucleo", F.explode(F.array("g1", "g2")).alias("g")).where(whole("g")).distinct().groupBy("g").agg(F.count("*").alias("f")))
    totals = {r["campo"]: r["n"] for r in families.groupBy("campo").agg(F.sum("familia_n").alias("n")).collect()}
    every = float(tokens.agg(F.sum("f").alias("f")).first()["f"] or 1)
    for g in ("g1", "g2"):
        nodes = nodes.join(tokens.select(c("g").alias(g), c("f").alias(f"{g}_n")), g, "left").fillna(0, [f"{g}_n"])
    level = F.when(whole("g1"), 2).otherwise(0) + F.when(whole("g2"), 2).when(F.length("g2") == 1, 1).otherwise(0) + F.when(c("tipo") != "", 1).otherwise(0)
    # A given name that is seldom met is less canonical than one often met.
    use = F.round(F.log(c("g1_n") + 1.0) + F.log(c("g2_n") + 1.0), 9)
    share = lambda g: F.when(c(g) == "", 0.0).when(F.length(g) == 1, math.log(INITIAL)).otherwise(F.greatest(F.log((c(f"{g}_n") - 1) / every), -LETTER * F.length(g)))
    nodes = reliable(nodes.join(families, ["campo", "nucleo"]).withColumn("nivel", level).withColumn("uso", use).withColumn("dados", F.coalesce(share("g1"), -LETTER * F.length("g1")) + F.coalesce(share("g2"), -LETTER * F.length("g2"))))

    asking = nodes.where("length(nucleo) > 1").withColumn("passo", F.lit("")).withColumn("taxa", F.lit(0.0)).withColumn("outra", F.lit(False))
    near, alt = reliable(near_families(families)), reliable(other_given(tokens))
    mistyped = asking.join(near, ["campo", "nucleo"]).withColumn("outra", F.lit(True))
    by = lambda df, g: df.join(alt.select(c("g").alias(g), c("outro").alias("_g"), c("passo").alias("_p"), c("taxa").alias("_t")), g).withColumn(g, c("_g")).withColumn("passo", c("_p")).withColumn("taxa", c("_t")).drop("_g", "_p", "_t")
    said = asking.withColumn("outro", c("nucleo"))
    other = [mistyped, by(said, "g1"), by(said, "g2"), by(mistyped, "g1").where("passo = 'apelido'")]
    shown = ["no", "n", "campo", "nivel", "familia_n", "familia", "uso", "tipo", "formas", "dados", "passo", "taxa", "outra", F.length("nucleo").alias("letras"), F.greatest(F.length("g1"), F.length("g2")).alias("letras_g")]
    ask = lambda df, exact: df.select(*shown, _key(F.lit(exact), "campo", c("tipo"), c("outro"), c("g1"), c("g2")).alias("chave"))
    queries = ask(said, "a")
    for df in other:
        queries = queries.unionByName(ask(df, "a")).unionByName(ask(df, "x"))
    met = queries.join(candidates(nodes), "chave").where(c("no") != c("c.no"))
    rank = lambda at: F.struct(c(f"{at}nivel"), c(f"{at}familia_n"), c(f"{at}uso"), c(f"{at}n"), -c(f"{at}no"))
    total = F.when(c("campo") == "autor", float(totals.get("autor") or 1)).otherwise(float(sum(n for k, n in totals.items() if k != "autor") or 1))
    # Another person: one of the family name's others, or, if the candidate has another family name, one whose name is so near by chance.
    own = math.log(NEW) + c("dados") + F.when(c("outra"), F.log(total) - LETTER * c("letras")).otherwise(F.log(F.greatest(c("familia_n") - c("n"), F.lit(1))))
    kind = F.when(c("tipo") == c("c.tipo"), 0.0).when(c("c.tipo") == "editora", -PUBLISHER_LEFT_OUT).otherwise(-KIND_LEFT_OUT)
    # Every further spelling of a family name tells of a name of its own, unless the other stands so often that its slips must be met.
    repeated = ~c("outra") | (c("familia") == 1) | (F.log((c("c.familia_n") + 1) / (c("familia_n") + 1)) >= F.least(F.lit(MOST), AGAIN * (c("familia") - 1)))
    scored = reliable(met.where((rank("c.") > rank("")) & repeated).select(
        "no", c("c.no").alias("pai"), "formas", "passo", "outra", "taxa", "letras_g", own.alias("proprio"),
        # One letter of the word became another: which one it is tells little of a name.
        (F.log(c("c.n").cast("double")) + kind - F.when(c("outra"), F.log(26.0 * c("letras"))).otherwise(0.0)).alias("canal"),
    ))

    def best(likelihood: dict[str, float]) -> DataFrame:
        step = F.when(c("outra"), math.log(likelihood["erro"])).otherwise(0.0)
        for name, p in likelihood.items():
            step = step + F.when(c("passo") == name, F.log(F.greatest(p / (26.0 * c("letras_g")), c("taxa"))) if name == "erro" else math.log(p)).otherwise(0.0)
        posterior = F.round(c("canal") + step, 9)
        return scored.where(posterior > c("proprio")).groupBy("no").agg(F.max_by(F.struct("pai", "formas", "passo", "outra"), F.struct(posterior, -c("pai"))).alias("m")).select("no", "m.*")

    counted = best(STEPS).agg(*[F.sum(F.when((c("passo") == k) | (c("outra") if k == "erro" else F.lit(False)), c("formas")).otherwise(0)).alias(k) for k in STEPS]).first()
    spellings = nodes.agg(F.sum("formas").alias("n")).first()["n"] or 0
    learned = {k: ((counted[k] or 0) + WEIGHT * p) / (spellings + WEIGHT) for k, p in STEPS.items()}
    return best(learned).select("no", "pai")


def acronyms(forms: DataFrame, nodes: DataFrame) -> DataFrame:
    """no, pai: forms that are an acronym alone, with the university they stand for."""
    alone = forms.where("sigla <> '' and nucleo = ''").select("no", "sigla").distinct()
    told = forms.where("sigla <> '' and nucleo <> ''").groupBy("sigla").agg(F.min_by("no", "nome_id").alias("dito"))
    letters = F.regexp_replace(F.substring("sigla", 3, 9), "(.)", "$1.*")
    houses = nodes.where("tipo = 'universidade' and nucleo <> ''").select(F.col("no").alias("pai"), "nucleo", "n", F.substring("nucleo", 1, 1).alias("a"))
    spelt = alone.withColumn("a", F.substring("sigla", 3, 1)).withColumn("molde", F.concat(F.lit("^"), letters)).join(houses, "a").where(F.expr("nucleo rlike molde"))
    # Every word of the name gives a letter.
    spelt = spelt.where(F.forall(F.split("nucleo", " "), lambda w: F.col("sigla").contains(F.substring(w, 1, 1))))
    best = Window.partitionBy("no").orderBy(F.desc("n"), "pai")
    spelt = spelt.withColumn("r", F.row_number().over(best)).where("r = 1").select("no", "pai")
    return alone.join(told, "sigla", "left").join(spelt, "no", "left").select("no", F.coalesce("dito", "pai").alias("pai")).where("pai is not null and pai <> no")


def entities(names: DataFrame, records: DataFrame) -> DataFrame:
    """nome_id, campo, entidade: each spelling with the id of its entity, the smallest nome_id of its canonical form.

    Rows without id, field or name have no row; spellings that read as nothing are
    entities of their own; a nome_id listed twice counts once.  An empty table of
    records leaves all frequencies at one.
    """
    alone = F.when(F.col("nucleo") == "", F.concat_ws("|", "sigla", F.when(F.col("sigla") == "", F.col("nome_id")))).otherwise("")
    forms = reliable(parsed(names).dropDuplicates(["nome_id"]).withColumn("forma", F.concat_ws("|", "campo", "tipo", "nucleo", "g1", "g2", alone)))
    counted = forms.join(frequencies(records), ["campo", "nome"], "left")
    nodes = reliable(counted.groupBy("forma", "campo", "tipo", "nucleo", "g1", "g2").agg(F.min("nome_id").alias("no"), F.sum(F.coalesce("n", F.lit(1))).alias("n"), F.count("*").alias("formas")))
    forms = forms.join(nodes.select("forma", "no"), "forma").drop("forma")
    nodes = nodes.drop("forma")
    links = attribute(nodes).union(acronyms(forms, nodes)).groupBy("no").agg(F.min("pai").alias("pai"))
    root = reliable(nodes.select("no").join(links, "no", "left").select("no", F.coalesce("pai", "no").alias("pai")))
    while True:
        up = root.select(F.col("no").alias("pai"), F.col("pai").alias("avo"))
        nearer = reliable(root.join(up, "pai").select("no", "pai", "avo"))
        if nearer.where("pai <> avo").isEmpty():
            break
        root = nearer.select("no", F.col("avo").alias("pai"))
    return forms.select("nome_id", "campo", "no").join(root, "no").select("nome_id", "campo", F.col("pai").alias("entidade"))


def variant_pairs(names: DataFrame, records: DataFrame) -> DataFrame:
    """nome_a, nome_b: ids of two spellings of one entity, the smaller first."""
    found = reliable(entities(names, records))
    many = found.join(found.groupBy("entidade", "campo").agg(F.count("*").alias("k")).where("k > 1").select("entidade", "campo"), ["entidade", "campo"], "left_semi")
    a, b = many.alias("a"), many.alias("b")
    return a.join(b, (F.col("a.entidade") == F.col("b.entidade")) & (F.col("a.campo") == F.col("b.campo")) & (F.col("a.nome_id") < F.col("b.nome_id"))).select(F.col("a.nome_id").alias("nome_a"), F.col("b.nome_id").alias("nome_b"))
