"""Mapping of freely entered values to a canonical list by token-level repair.

Each distinct value is cut in tokens, and each distinct token is joined to the
vocabulary of the reference list: equal, at one edit (two strings at one edit, a
swap included, share a string that lacks one character of each), or as the
beginning of a word.  Soft TF-IDF over the repaired tokens ranks the complete
entries; the best counts if its score is high enough, else the value means none.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estante.session import reliable

ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"
# Words that say nothing of which entry is meant.
STOP = "a o e as os um uma de da do das dos em no na nos nas para por the of and in area areas assunto assuntos tema geral gerais campo disciplina subarea categoria".split()
# Other names of entries, folded; an entry is named by its canonical name.
ALIASES = {
    "Psicologia": "psychology;ciencias psicologicas;estudos psicologicos", "Filosofia": "philosophy;pensamento filosofico", "Tecnologia": "technology;informatica;ti;computacao e tecnologia;computacao;ciencia da computacao;tecnologia da informacao",
    "Direito": "law;juridico;ciencias juridicas;leis", "Saúde": "health;ciencias da saude;health sciences;medicina", "Educação": "education;pedagogia;ciencias da educacao", "História": "history;estudos historicos;ciencias historicas", "Economia": "economics;ciencias economicas", "Biologia": "biology;bio;ciencias biologicas;life sciences",
    "Matemática": "maths;mathematics;math;ciencias matematicas", "Artes": "arts;belas artes;art;arte", "Religião": "religion;estudos religiosos", "Esportes": "sports;desporto;desportos;sport;educacao fisica", "Agronomia": "agronomy;ciencias agrarias;engenharia agronomica;agriculture;agricultura",
    "Psicologia Clínica": "clinical psychology;clinica psicologica", "Psicologia Organizacional": "psicologia do trabalho e das organizacoes;organizational psychology;psicologia do trabalho;pot", "Neuropsicologia": "neuropsychology", "Psicologia do Desenvolvimento": "developmental psychology;desenvolvimento humano", "Psicometria": "psychometrics;testes psicologicos",
    "Ética": "ethics;filosofia moral", "Metafísica": "metaphysics", "Epistemologia": "epistemology;filosofia do conhecimento;teoria do conhecimento", "Estética": "aesthetics;filosofia da arte", "Lógica": "logic;filosofia da logica", "Aprendizado de Máquina": "machine learning;aprendizagem de maquina;ml", "Redes de Computadores": "computer networks;redes;networks", "Engenharia de Software": "software engineering", "Banco de Dados": "databases;bases de dados;bd;database;bancos de dados", "Segurança da Informação": "information security;infosec;seguranca informatica;ciberseguranca",
    "Direito Civil": "civil law;civel", "Direito Penal": "criminal law;direito criminal", "Direito Tributário": "tax law;direito fiscal", "Direito do Trabalho": "labor law;labour law;direito trabalhista;direito laboral", "Direito Ambiental": "environmental law;direito do ambiente", "Enfermagem": "nursing", "Saúde Coletiva": "public health;saude publica", "Nutrição": "nutrition", "Farmacologia": "pharmacology", "Fisioterapia": "physiotherapy;physical therapy",
    "Didática": "didactics;teaching methods", "Educação Infantil": "early childhood education;pre escola;educacao pre escolar", "Educação Especial": "special education;educacao inclusiva", "Currículo": "curriculum;curriculum studies", "Alfabetização": "literacy;letramento", "História Medieval": "medieval history;idade media", "História Regional": "regional history;historia local", "História Oral": "oral history", "Historiografia": "historiography", "Arqueologia": "archaeology;archeology",
    "Microeconomia": "microeconomics", "Macroeconomia": "macroeconomics", "Economia Agrícola": "agricultural economics;economia rural", "Finanças Públicas": "public finance", "Econometria": "econometrics", "Botânica": "botany", "Zoologia": "zoology", "Genética": "genetics", "Ecologia": "ecology", "Microbiologia": "microbiology", "Álgebra": "algebra", "Geometria": "geometry", "Cálculo": "calculus", "Estatística": "statistics", "Teoria dos Números": "number theory;aritmetica",
    "Pintura": "painting", "Música": "music", "Teatro": "theatre;theater;artes cenicas", "Cinema": "film studies;cinematografia;film", "Fotografia": "photography", "Teologia": "theology", "Ciências da Religião": "religious studies;ciencia da religiao", "Liturgia": "liturgy", "Missiologia": "missiology;missoes", "Religiões Comparadas": "comparative religion;religiao comparada", "Treinamento Esportivo": "sports training;treino desportivo;treinamento desportivo", "Gestão Esportiva": "sports management;gestao desportiva", "Futebol": "football;soccer", "Atletismo": "athletics;track and field", "Natação": "swimming",
    "Fitotecnia": "plant science;crop science", "Irrigação": "irrigation", "Solos": "soil science;pedologia agricola;ciencia do solo;pedologia", "Zootecnia": "animal science;producao animal", "Agroecologia": "agroecology",
}
LEAST = 0.74
#: A repeated token that stands more than 1 / OWN as often as the words at one edit is a word of its own.
OWN = 12
SALT = 16
#: So many distinct values with their options are broadcast; more are joined by a shuffle. So many rows at most a canonical list has.
BROADCAST_VALUES, LIST_ROWS = 200_000, 100_000


def folded(c: Column) -> Column:
    """Lower case without accents; anything else than letters and digits of ASCII separates."""
    plain = F.translate(F.lower(F.regexp_replace(c, "[\\x{0300}-\\x{036f}\\x{ad}\\x{200b}-\\x{200f}\\x{feff}]", "")), ACCENTED, PLAIN)
    return F.regexp_replace(plain, "[^a-z0-9.]+", " ")


def tokens(c: Column) -> Column:
    """The distinct tokens, with a dot after abbreviations."""
    each = F.regexp_extract_all(folded(c), F.lit("([a-z0-9]+\\.?)"), 1)
    # A dot at the very end of a value of several signs is no abbreviation if the word is whole; the vocabulary decides.
    return F.array_distinct(F.filter(each, lambda t: ~F.regexp_replace(t, "\\.", "").isin(STOP)))


def lacking_one(c: Column) -> Column:
    """The string and all strings that lack one of its characters."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether the strings differ by one insertion, deletion or substitution, or a swap of neighbours."""
    n = F.length(a)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (F.levenshtein(a, b) <= 1) | (n == F.length(b)) & (F.levenshtein(a, b) == 2) & swap


class Reference:
    """The canonical list with its other names, cut in tokens: small relations that every join broadcasts.

    The list is a dimension written by people; it is counted, and more than LIST_ROWS
    rows are refused rather than gathered.
    """

    def __init__(self, areas: DataFrame, aliases: dict[str, str] | None = None):
        spark = areas.sparkSession
        listed = areas.where("area_id is not null and nome is not null").select("area_id", "nivel", F.col("area_pai").alias("pai"), "nome").distinct()
        if (n := listed.count()) > LIST_ROWS:
            raise ValueError(f"a canonical list of {n} rows is no dimension")
        others = spark.createDataFrame([(k, a) for k, v in (ALIASES if aliases is None else aliases).items() for a in v.split(";")], "nome string, outro string")
        named = listed.select("*", F.col("nome").alias("dito"), F.lit(1).alias("exato")).union(listed.join(F.broadcast(others), "nome").select("area_id", "nivel", "pai", "nome", F.col("outro").alias("dito"), F.lit(0).alias("exato")))
        rows = [(i, *r) for i, r in enumerate(named.select("area_id", "nivel", "pai", "exato", tokens(F.col("dito")).alias("ts")).orderBy("area_id", F.desc("exato"), "dito").collect())]
        df = Counter(t for r in rows for t in r[-1])
        weight = {t: math.log(1 + len(rows) / n) for t, n in df.items()}
        norm = [math.sqrt(sum(weight[t] ** 2 for t in r[-1])) for r in rows]
        keys = [("=" + t, t) for t in df] + [("-" + k, t) for t in df if len(t) >= 4 for k in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}] + [("^" + t[:n], t) for t in df if len(t) >= 4 for n in range(2, len(t))]
        self.heaviest, self.longest = max(weight.values(), default=1.0), max(map(len, df), default=0)
        self.names = spark.createDataFrame([r[:-1] for r in rows], "nid int, area_id bigint, nivel string, pai string, exato int")
        self.words = spark.createDataFrame([(r[0], t, weight[t], norm[r[0]]) for r in rows for t in r[-1]], "nid int, ref string, w double, norma double")
        self.lookup = spark.createDataFrame([(k, t, weight[t]) for k, t in keys], "k string, ref string, w double")


def repair_tokens(found: DataFrame, reference: Reference) -> DataFrame:
    """t, refs: the words of the list that each distinct token may mean, with weight and sim; found: t, with a dot if abbreviated, and n, how often it stands.

    A token that is a word of the list means that word only, and an abbreviation the
    words it begins, if there are any.  A token longer than the longest word and a
    character is at no edit from any.  One that stands again and again, and more than
    a twelfth as often as every word at one edit, is no slip of them but another word.
    """
    c = F.col
    size = F.length("b")
    none = F.array().cast("array<string>")
    edits = F.when(size.between(4, reference.longest + 1), F.transform(lacking_one(F.substring("b", 1, reference.longest + 1)), lambda x: F.concat(F.lit("-"), x))).otherwise(none)
    begun = (size >= 4) | (size >= 2) & c("t").endswith(".")
    keys = F.concat(F.array(F.concat(F.lit("="), "b")), edits, F.when(begun, F.array(F.concat(F.lit("^"), "b"))).otherwise(none))
    bare = reliable(found.withColumn("b", F.regexp_replace("t", "\\.", "")))
    spoken = bare.join(F.broadcast(reference.words.select(c("ref").alias("b")).distinct()), "b").groupBy(c("b").alias("ref")).agg(F.sum("n").alias("dito"))
    met = bare.where(size <= reference.longest + 1).withColumn("k", F.explode(keys)).join(F.broadcast(reference.lookup), "k")
    how = F.substring("k", 1, 1)
    sim = F.when(how == "=", 1.0).when(how == "^", 0.85 + 0.1 * size / F.length("ref")).when(one_edit(c("b"), c("ref")), F.when(size == F.length("ref"), 0.9).otherwise(0.91))
    each = met.select("t", "n", "ref", "w", how.alias("como"), sim.alias("sim")).where("sim is not null").distinct().join(F.broadcast(spoken), "ref", "left")
    refs = each.groupBy("t", "n").agg(F.collect_list(F.struct("ref", "w", "sim", "como", F.coalesce("dito", F.lit(0)).alias("dito"))).alias("r"))
    of = lambda sign: F.filter("r", lambda x: x["como"] == sign)
    seen = F.coalesce(F.array_max(F.transform(of("-"), lambda x: x["dito"])), F.lit(0))
    own = (c("n") > 1) & (c("n") * OWN > seen)
    chosen = F.when(F.size(of("=")) > 0, of("=")).when(own | c("t").endswith(".") & (F.size(of("^")) > 0), of("^")).otherwise(c("r"))
    best = F.array_distinct(F.transform(chosen, lambda x: F.struct(x["ref"].alias("ref"), x["w"].alias("w"), F.array_max(F.transform(F.filter(chosen, lambda y: y["ref"] == x["ref"]), lambda y: y["sim"])).alias("sim"))))
    return refs.select("t", best.alias("refs"))


def resolve(rows: DataFrame, areas: DataFrame, least: float = LEAST, aliases: dict[str, str] | None = None) -> DataFrame:
    """v, campo, opcoes: for each distinct value that is no entry byte for byte all entries within reach of the best score, best first.

    rows: v, campo of all records, entries included: what is said how often tells slips from words.
    """
    c = F.col
    known = Reference(areas, aliases)
    counted = reliable(rows.groupBy("v", "campo").agg(F.count("*").alias("n")))
    values = counted.select("v", "campo").join(F.broadcast(_entries(areas)), "v", "left_anti")
    spoken = reliable(counted.groupBy("v").agg(F.sum("n").alias("n")).select("v", "n", F.explode(tokens(c("v"))).alias("t")))
    matches = repair_tokens(spoken.groupBy("t").agg(F.sum("n").alias("n")), known)
    # A token weighs as the word it is taken for; one that finds none in the name as the rarest it may mean, or as a word of one name.
    own = F.coalesce(F.array_max(F.transform("refs", lambda r: r["w"])), F.lit(known.heaviest))
    each = reliable(spoken.join(values.select("v").distinct(), "v", "left_semi").join(matches, "t", "left").select("v", "t", own.alias("own"), "refs"))
    size = each.groupBy("v").agg(F.sum(c("own") ** 2).alias("tamanho"))
    hits = each.select("v", "t", "own", F.explode("refs").alias("r")).select("v", "t", "own", "r.ref", "r.sim").join(F.broadcast(known.words), "ref")
    hits = hits.groupBy("v", "nid", "t", "own", "norma").agg(F.max(F.struct((c("sim") * c("w") * c("w")).alias("s"), "w")).alias("h"))
    sums = hits.groupBy("v", "nid", "norma").agg(F.sum("h.s").alias("s"), F.sum(c("h.w") ** 2 - c("own") ** 2).alias("outro"))
    scored = sums.join(size, "v").withColumn("nota", F.round(c("s") / c("norma") / F.sqrt(c("tamanho") + c("outro")), 6)).where(c("nota") >= least)
    scored = scored.join(F.broadcast(known.names), "nid").groupBy("v", "area_id", "nivel", "pai").agg(F.max(F.struct("nota", "exato")).alias("m"))
    asked = values.join(scored, "v").withColumn("mesmo", (c("nivel") == F.when(c("campo") == "area_principal", "area").otherwise("subarea")).cast("int"))
    # At most the whole list stands in one row.
    ranked = asked.groupBy("v", "campo").agg(F.array_sort(F.collect_list(F.struct((-c("m.nota")).alias("menos"), (-c("mesmo")).alias("b"), (-c("m.exato")).alias("c"), "area_id", "pai"))).alias("o"))
    return ranked.select("v", "campo", F.transform(F.filter("o", lambda x: x["menos"] <= c("o")[0]["menos"] + 0.02), lambda x: F.struct(x["area_id"].alias("area_id"), x["pai"].alias("pai"))).alias("opcoes"))


def _entries(areas: DataFrame) -> DataFrame:
    """v: the names of the list, a fixed dimension with one row for each."""
    return areas.where("nome is not null").select(F.col("nome").alias("v")).distinct()


def _values(records: DataFrame) -> DataFrame:
    """registro_id, campo, v, pai_dito: each value that is not blank."""
    pairs = F.array(F.struct(F.lit("area_principal").alias("campo"), F.col("area_principal").alias("v")), F.struct(F.lit("subarea").alias("campo"), F.col("subarea").alias("v")))
    every = records.where("registro_id is not null").select("registro_id", F.col("area_principal").alias("pai_dito"), F.explode(pairs).alias("x")).select("registro_id", "x.campo", "x.v", "pai_dito")
    return every.where(F.col("v").isNotNull() & (F.regexp_replace("v", "(?U)[\\s\\x{200b}-\\x{200f}\\x{feff}]", "") != ""))


def _cases(records: DataFrame, areas: DataFrame) -> DataFrame:
    """registro_id, campo, v, pai_dito: each value that is not blank and not the name of an entry byte for byte."""
    return _values(records).join(F.broadcast(_entries(areas)), "v", "left_anti")


def free_values(records: DataFrame, areas: DataFrame) -> DataFrame:
    """registro_id, campo, v, pai: the cases, one row for each value of a record."""
    return _cases(records, areas).groupBy("registro_id", "campo", "v").agg(F.min("pai_dito").alias("pai_dito"))


def map_to_list(records: DataFrame, areas: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """registro_id, campo, area_id: the entry each free value means, 0 if none.

    A record delivered more than once counts once for each different value (its
    latest reading of the list wins by the smaller area_id only if values differ).
    Null and blank values are no cases.  Between entries of like score the one of
    the record's own area is preferred, then the first of the list.  aliases: other
    names of entries, separated by semicolons; None takes those of ALIASES.
    """
    rows = _cases(records, areas)
    found = reliable(resolve(_values(records), areas, aliases=aliases))
    if found.count() <= BROADCAST_VALUES:
        met = rows.join(F.broadcast(found), ["v", "campo"], "left")
    else:
        # A frequent value would stand in one task: the rows are salted, the table of distinct values is repeated.
        many = found.withColumn("sal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        met = rows.withColumn("sal", F.pmod(F.xxhash64("registro_id"), F.lit(SALT))).join(many, ["v", "campo", "sal"], "left")
    own = F.filter("opcoes", lambda o: o["pai"] == F.col("pai_dito"))
    chosen = F.when(F.size(own) > 0, own[0]["area_id"]).otherwise(F.col("opcoes")[0]["area_id"])
    return met.select("registro_id", "campo", F.coalesce(chosen, F.lit(0)).cast("bigint").alias("area_id")).groupBy("registro_id", "campo").agg(F.max("area_id").alias("area_id"))


def unmatched(records: DataFrame, areas: DataFrame) -> DataFrame:
    """campo, valor, registros: the values that mean no entry, with how many records hold each."""
    values = free_values(records, areas)
    found = resolve(_values(records), areas).select("v", "campo")
    return values.groupBy("v", "campo").agg(F.count("*").alias("registros")).join(found, ["v", "campo"], "left_anti").select("campo", F.col("v").alias("valor"), "registros")
