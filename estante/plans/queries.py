"""Queries of the cataloguing operators over whole tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estante.functions import identifiers as I
from estante.functions import text as T
from estante.operators import batch, excerpt, naming, note, validate, verify
from estante.session import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PAGE, FIRST, BUDGET = 400, 2, 1200


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FILE = "regexp_extract(caminho, '([^/]*)$', 1)"
STEM = "regexp_replace(regexp_extract(caminho, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
RECORD_TEXT = "concat_ws(' ', nullif(titulo, ''), nullif(subtitulo, ''), nullif(autor_principal, ''), nullif(editora_ou_periodico, ''))"
ONE_SPACE = lambda x: f"regexp_replace({x}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"
last_part = lambda c: F.element_at(F.split(c, "/"), -1)


@query(f"SELECT registro_id, recebido_em, array_to_string({T.tokens_sql('titulo')}, ' ') AS palavras FROM metadados")
def tokens_title(s, d):
    return table(s, d, "metadados").select("registro_id", "recebido_em", F.array_join(T.tokens(F.col("titulo")), " ").alias("palavras"))


def _diverging(df: DataFrame) -> DataFrame:
    return df.withColumn("diverge", naming.divergence(last_part("caminho"), F.col("titulo"), F.col("subtitulo"), F.col("autor_principal"), F.col("editora_ou_periodico")))


DIVERGE = f"""(SELECT *, len(a) >= 2 AND len(list_intersect(a, b)) < 2 AS diverge
FROM (SELECT *, {T.tokens_sql(STEM)} AS a, {T.tokens_sql(RECORD_TEXT)} AS b FROM metadados) x)"""


@query(f"SELECT registro_id, recebido_em, diverge FROM {DIVERGE} y")
def filename_divergence(s, d):
    return _diverging(table(s, d, "metadados")).select("registro_id", "recebido_em", "diverge")


_plural_sql = "CASE tipo_publicacao " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in naming.PLURAL.items()) + " ELSE 'Outros' END"
_or = lambda x, y: f"(CASE WHEN {x} = '' THEN {y} ELSE {x} END)"
_area = _or("sa", f"'{T.NO_VALUE}'")
PLANNED = f"""(SELECT *, concat_ws('/', 'destino', CASE WHEN diverge THEN '{naming.REVIEW}' END, {_area}, {_or('ss', _area)}, {_plural_sql}) AS pasta
FROM (SELECT *, {T.sanitize_sql('area_principal')} AS sa, {T.sanitize_sql('subarea')} AS ss FROM {DIVERGE} y) z)"""


def _planned(s: SparkSession, d: str) -> DataFrame:
    df = _diverging(table(s, d, "metadados"))
    return df.withColumn("pasta", naming.directory(F.lit("destino"), F.col("area_principal"), F.col("subarea"), F.col("tipo_publicacao"), F.col("diverge")))


@query(f"SELECT pasta, count(*) AS registros FROM {PLANNED} p GROUP BY pasta")
def warning_routing(s, d):
    return _planned(s, d).groupBy("pasta").agg(F.count("*").alias("registros"))


@query(f"SELECT area, subarea, tipo, count(*) AS arquivos FROM (SELECT string_split(pasta, '/')[-3] AS area, string_split(pasta, '/')[-2] AS subarea, string_split(pasta, '/')[-1] AS tipo FROM {PLANNED} p) t GROUP BY ROLLUP (area, subarea, tipo) HAVING area IS NOT NULL")
def destination_tree(s, d):
    at = lambda n: F.element_at(F.split("pasta", "/"), n)
    return batch.tree(_planned(s, d).select(at(-3).alias("area"), at(-2).alias("subarea"), at(-1).alias("tipo")))


@query(f"SELECT registro_id, recebido_em, {T.sanitize_sql('titulo')} AS titulo_limpo, {T.sanitize_sql('editora_ou_periodico', final=False)} AS editora_limpa FROM metadados")
def sanitize_segment(s, d):
    return table(s, d, "metadados").select("registro_id", "recebido_em", T.sanitize(F.col("titulo")).alias("titulo_limpo"), T.sanitize(F.col("editora_ou_periodico"), final=False).alias("editora_limpa"))


AUTHOR = "coalesce(nullif(autor_principal, ''), autores[1])"
_parts = [T.sanitize_sql(x, final=False) for x in ("tipo_publicacao", "titulo", "subtitulo", AUTHOR, "CASE WHEN ano <> 0 THEN cast(ano AS varchar) END", "editora_ou_periodico")]
_joined = "coalesce(nullif(regexp_replace(array_to_string(list_filter([" + ", ".join(_parts) + f"], lambda x: x <> ''), ' - '), '[ .]+$', ''), ''), '{T.NO_VALUE}')"
NAMED = f"(SELECT *, CASE WHEN length(n0) > {T.MAX_NAME} THEN regexp_replace(substring(n0, 1, {T.MAX_NAME}), '[ .,;:-]+$', '') ELSE n0 END AS nome FROM (SELECT *, {_joined} AS n0 FROM metadados) w)"


def _named(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("nome", naming.file_name(c("tipo_publicacao"), c("titulo"), c("subtitulo"), naming.author_for_name(c("autor_principal"), c("autores")), c("ano"), c("editora_ou_periodico")))


@query(f"SELECT registro_id, recebido_em, nome FROM {NAMED} v")
def catalogue_name(s, d):
    return _named(table(s, d, "metadados")).select("registro_id", "recebido_em", "nome")


_room = f"({T.MAX_PATH} - (length(pasta) + 5))"


@query(
    f"""SELECT registro_id, recebido_em, CASE WHEN {_room} >= length(nome) THEN nome WHEN {_room} >= {T.MIN_CUT} THEN regexp_replace(substring(nome, 1, {_room}), '[ .,;:-]+$', '') END AS nome_curto, {_room} < length(nome) AND {_room} < {T.MIN_CUT} AS longo
FROM (SELECT *, '/arquivo/' || repeat(colecao_id || '/', 1 + cast(registro_id % 25 AS int)) || 'x' AS pasta FROM {NAMED} v) u"""
)
def path_budget(s, d):
    df = _named(table(s, d, "metadados")).withColumn("pasta", F.concat(F.lit("/arquivo/"), F.repeat(F.concat("colecao_id", F.lit("/")), (1 + F.col("registro_id") % 25).cast("int")), F.lit("x")))
    cut = naming.within_path(F.col("nome"), F.col("pasta"))
    return df.select("registro_id", "recebido_em", cut["nome"].alias("nome_curto"), cut["erro"].isNotNull().alias("longo"))


@query(f"SELECT registro_id, recebido_em, tipo_publicacao, CASE WHEN vez > 1 THEN tipo_publicacao || ' (' || vez || ')' ELSE tipo_publicacao END AS nome, vez FROM (SELECT *, row_number() OVER (PARTITION BY colecao_id, tipo_publicacao ORDER BY caminho || '|' || registro_id || '|' || epoch_us(recebido_em)) AS vez FROM metadados) x")
def name_collisions(s, d):
    order = F.concat_ws("|", "caminho", "registro_id", F.unix_micros("recebido_em"))
    df = naming.collisions(table(s, d, "metadados").withColumn("ordem", order), ["colecao_id", "tipo_publicacao"], "ordem")
    return df.select("registro_id", "recebido_em", "tipo_publicacao", naming.suffixed(F.col("tipo_publicacao"), F.col("vez")).alias("nome"), "vez")


@query(f"SELECT registro_id, recebido_em, 'area/' || {T.slug_sql('area_principal')} AS area, 'subarea/' || {T.slug_sql('subarea')} AS sub, 'tipo/' || {T.slug_sql('tipo_publicacao')} AS tipo FROM metadados")
def slug_tags(s, d):
    made = note.tags(F.col("area_principal"), F.col("subarea"), F.col("tipo_publicacao"))
    return table(s, d, "metadados").select("registro_id", "recebido_em", made[0].alias("area"), made[1].alias("sub"), made[2].alias("tipo"))


@query(f"SELECT registro_id, recebido_em, {AUTHOR} AS autor, {_plural_sql} AS plural, coalesce(identificadores.isbn, '') = '' AND coalesce(identificadores.issn, '') = '' AND coalesce(identificadores.doi, '') = '' AS sem_identificador FROM metadados")
def record_attributes(s, d):
    blank = lambda f: F.coalesce(F.col(f"identificadores.{f}"), F.lit("")) == ""
    return table(s, d, "metadados").select("registro_id", "recebido_em", naming.author_for_name(F.col("autor_principal"), F.col("autores")).alias("autor"), F.coalesce(naming.plural(F.col("tipo_publicacao")), F.lit("Outros")).alias("plural"), (blank("isbn") & blank("issn") & blank("doi")).alias("sem_identificador"))


SOURCE = "(SELECT m.*, c.markdown_inicial AS fonte_texto FROM metadados m JOIN convertidos c ON m.caminho = c.caminho)"


def _with_text(s: SparkSession, d: str) -> DataFrame:
    # Each text is brought to its bare form once, not once for every record of its file.
    texts = table(s, d, "convertidos").select("caminho", F.col("markdown_inicial").alias("fonte_texto"), I.bare(F.col("markdown_inicial")).alias("fonte_lisa"))
    return table(s, d, "metadados").join(texts, "caminho")


@query("SELECT registro_id, recebido_em, " + ", ".join(f"{I.confirmed_sql('identificadores.' + k, 'fonte_texto')} AS {k}_ok" for k in ("isbn", "issn", "doi")) + f" FROM {SOURCE} s")
def identifier_confirm(s, d):
    return _with_text(s, d).select("registro_id", "recebido_em", *[I.confirmed(F.col(f"identificadores.{k}"), F.col("fonte_texto"), F.col("fonte_lisa")).alias(f"{k}_ok") for k in ("isbn", "issn", "doi")])


#: The citation with its identifiers written at the end, so that discarding has something to remove.
CITED = "referencia_abnt || coalesce(' ISBN ' || nullif(trim(identificadores.isbn), ''), '') || coalesce(' DOI: ' || nullif(trim(identificadores.doi), ''), '')"
_doi_found = f"nullif(regexp_replace(regexp_extract(ref, '{I.DOI_IN_TEXT.replace(chr(39), chr(39) * 2)}'), '\\.+$', ''), '')"
_v = {"isbn": "nullif(identificadores.isbn, '')", "issn": "nullif(identificadores.issn, '')", "doi": "doi0"}
DISCARD = f"""SELECT registro_id, recebido_em, CASE WHEN c1 THEN {_v['isbn']} END AS isbn, CASE WHEN c2 THEN {_v['issn']} END AS issn, CASE WHEN c3 THEN doi0 END AS doi,
CASE WHEN r3 <> ref THEN {ONE_SPACE("regexp_replace(r3, '" + T.SPACE + "{2,}', ' ', 'g')")} ELSE ref END AS referencia FROM
(SELECT *, CASE WHEN doi0 IS NOT NULL AND NOT c3 THEN {I.without_sql('r2', 'DOI', 'doi0')} ELSE r2 END AS r3 FROM
(SELECT *, CASE WHEN {_v['issn']} IS NOT NULL AND NOT c2 THEN {I.without_sql('r1', 'ISSN', _v['issn'])} ELSE r1 END AS r2 FROM
(SELECT *, CASE WHEN {_v['isbn']} IS NOT NULL AND NOT c1 THEN {I.without_sql('ref', 'ISBN', _v['isbn'])} ELSE ref END AS r1 FROM
(SELECT *, {I.confirmed_sql(_v['isbn'], 'fonte_texto')} AS c1, {I.confirmed_sql(_v['issn'], 'fonte_texto')} AS c2, {I.confirmed_sql('doi0', 'fonte_texto')} AS c3 FROM
(SELECT *, coalesce(nullif(identificadores.doi, ''), {_doi_found}) AS doi0 FROM (SELECT *, {CITED} AS ref FROM {SOURCE} s) a) b) c) e) f) g"""


def _discarded(s: SparkSession, d: str) -> DataFrame:
    label = lambda t, k: F.coalesce(F.concat(F.lit(t), F.nullif(F.trim(F.col(f"identificadores.{k}")), F.lit(""))), F.lit(""))
    df = _with_text(s, d).withColumn("ref", F.concat("referencia_abnt", label(" ISBN ", "isbn"), label(" DOI: ", "doi")))
    made = I.discard_unconfirmed(*[F.col(f"identificadores.{k}") for k in ("isbn", "issn", "doi")], F.col("ref"), F.col("fonte_texto"), F.col("fonte_lisa"))
    return df.withColumn("r", made)


@query(DISCARD)
def identifier_discard(s, d):
    return _discarded(s, d).select("registro_id", "recebido_em", "r.isbn", "r.issn", "r.doi", "r.referencia")


@query(f"SELECT registro_id, recebido_em, {_doi_found} AS doi FROM (SELECT *, {CITED} AS ref FROM metadados) x")
def doi_in_citation(s, d):
    label = lambda t, k: F.coalesce(F.concat(F.lit(t), F.nullif(F.trim(F.col(f"identificadores.{k}")), F.lit(""))), F.lit(""))
    return table(s, d, "metadados").select("registro_id", "recebido_em", I.doi_in(F.concat("referencia_abnt", label(" ISBN ", "isbn"), label(" DOI: ", "doi"))).alias("doi"))


# This engine's upper() leaves ligatures; Spark's writes them out.
_ligless = "replace(replace(trim(string_split(x, ',')[1]), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
_sur, _rest = "trim(string_split(x, ',')[1])", "trim(substring(x, instr(x, ',') + 1))"


@query(
    f"""SELECT registro_id, recebido_em, coalesce(list_reduce(list_prepend(ref, coalesce(autores, [])), lambda a, x: CASE WHEN contains(x, ',') AND {_sur} <> '' AND {_rest} <> '' AND NOT contains(a, upper({_ligless}) || ', ' || {_rest}) THEN replace(a, {_sur} || ', ' || {_rest}, upper({_ligless}) || ', ' || {_rest}) ELSE a END), ref) AS referencia
FROM (SELECT *, array_to_string(autores, '; ') || '. ' || titulo AS ref FROM metadados) t"""
)
def surname_upper(s, d):
    ref = F.concat(F.array_join("autores", "; "), F.lit(". "), "titulo")
    return table(s, d, "metadados").select("registro_id", "recebido_em", I.surnames_upper(ref, F.col("autores")).alias("referencia"))


_alike = lambda a, b: f"(coalesce({a}, '') = '' OR coalesce({b}, '') = '' OR len(list_intersect({T.tokens_sql(a, 3, T.STOP_REGISTRY)}, {T.tokens_sql(b, 3, T.STOP_REGISTRY)})) >= 1)"
_reg = lambda k: f"(SELECT chave, titulo AS {k}_titulo, array_to_string(autores, ' ') AS {k}_autores, editora AS {k}_editora, data_publicacao AS {k}_data, local AS {k}_local FROM registro_bib WHERE tipo_chave = '{k}' QUALIFY row_number() OVER (PARTITION BY chave ORDER BY consultado_em DESC NULLS LAST, titulo DESC NULLS LAST) = 1)"
_state = lambda k: f"CASE WHEN {k}_hit IS NULL THEN 'ausente' WHEN {_alike('titulo', k + '_titulo')} OR {_alike('autor_principal', k + '_autores')} THEN 'confere' ELSE 'diverge' END"
_year = lambda x: f"try_cast(nullif(regexp_extract({x}, '{I.YEAR_IN_TEXT}'), '') AS int)"


@query(
    f"""SELECT registro_id, recebido_em, sd AS situacao_doi, si AS situacao_isbn,
coalesce(nullif(editora_ou_periodico, ''), CASE WHEN sd = 'confere' THEN nullif(doi_editora, '') END, CASE WHEN si = 'confere' THEN nullif(isbn_editora, '') END) AS editora_final,
coalesce(nullif(ano, 0), CASE WHEN sd = 'confere' THEN {_year('doi_data')} END, CASE WHEN si = 'confere' THEN {_year('isbn_data')} END) AS ano_final,
coalesce(nullif(local, ''), CASE WHEN si = 'confere' THEN nullif(isbn_local, '') END) AS local_final
FROM (SELECT *, CASE WHEN sd = 'diverge' THEN 'ausente' ELSE {_state('isbn')} END AS si FROM (SELECT *, {_state('doi')} AS sd FROM
(SELECT m.*, b1.chave AS doi_hit, b2.chave AS isbn_hit, b1.* EXCLUDE (chave), b2.* EXCLUDE (chave) FROM metadados m
LEFT JOIN {_reg('doi')} b1 ON b1.chave = nullif(regexp_replace(trim(identificadores.doi), '{I.DOI_PREFIX}', ''), '')
LEFT JOIN {_reg('isbn')} b2 ON b2.chave = nullif(regexp_replace(identificadores.isbn, '[\\s\\x{{A0}}-]', '', 'g'), '')) j) k) l"""
)
def registry_verify(s, d):
    return verify.verify(table(s, d, "metadados"), table(s, d, "registro_bib")).select("registro_id", "recebido_em", "situacao_doi", "situacao_isbn", "editora_final", "ano_final", "local_final")


_told = lambda kind, k, source: f"'{source} guarda outra obra sob o {kind} ' || identificadores.{k} || ': ' || CASE WHEN coalesce({k}_titulo, '') <> '' THEN '«' || {k}_titulo || '»' ELSE 'um registro sem título' END || CASE WHEN coalesce({k}_autores, '') <> '' THEN ' (' || {k}_autores || ')' ELSE '' END || '; título e autoria do documento precisam de conferência.'"
_warned = "CASE WHEN sd = 'diverge' THEN " + _told("DOI", "doi", "Crossref") + " WHEN si = 'diverge' THEN " + _told("ISBN", "isbn", "Open Library") + " END"


@query(
    f"""SELECT registro_id, recebido_em, CASE WHEN w IS NOT NULL AND sem THEN 'sem autor Além disso, ' || w ELSE coalesce(w, CASE WHEN sem THEN 'sem autor' END) END AS aviso FROM (SELECT *, {_warned} AS w, coalesce(autor_principal, '') = '' AS sem
FROM (SELECT *, CASE WHEN sd = 'diverge' THEN 'ausente' ELSE {_state('isbn')} END AS si FROM (SELECT *, {_state('doi')} AS sd FROM
(SELECT m.*, b1.chave AS doi_hit, b2.chave AS isbn_hit, b1.* EXCLUDE (chave), b2.* EXCLUDE (chave) FROM metadados m
LEFT JOIN {_reg('doi')} b1 ON b1.chave = nullif(regexp_replace(trim(identificadores.doi), '{I.DOI_PREFIX}', ''), '')
LEFT JOIN {_reg('isbn')} b2 ON b2.chave = nullif(regexp_replace(identificadores.isbn, '[\\s\\x{{A0}}-]', '', 'g'), '')) j) k) l) n"""
)
def registry_warning(s, d):
    told = verify.verify(table(s, d, "metadados"), table(s, d, "registro_bib"))
    alone = F.when(F.coalesce("autor_principal", F.lit("")) == "", "sem autor")
    return told.select("registro_id", "recebido_em", batch.join_warnings(alone, F.col("aviso_registro")).alias("aviso"))


@query(f"SELECT chave, consultado_em, coalesce(nullif({_year('data_publicacao')}, 0), length(chave)) AS ano FROM registro_bib")
def registry_year_parts(s, d):
    parts = lambda c: F.array(F.array(c, F.lit(1)))
    return table(s, d, "registro_bib").select("chave", "consultado_em", I.year_of_parts(parts(I.year_in(F.col("data_publicacao"))), parts(F.length("chave"))).alias("ano"))


@query(f"SELECT chave, consultado_em, {_year('data_publicacao')} AS ano FROM registro_bib")
def year_extract(s, d):
    return table(s, d, "registro_bib").select("chave", "consultado_em", I.year_in(F.col("data_publicacao")).alias("ano"))


_pages = f"CASE WHEN length(markdown_completo) > 0 THEN list_transform(range(0, cast(ceil(length(markdown_completo) / {PAGE}.0) AS bigint)), lambda i: substring(markdown_completo, cast(i * {PAGE} + 1 AS bigint), {PAGE})) ELSE [] END"


@query(
    f"""SELECT conv_id, ficha AS pagina_ficha, substring(CASE WHEN regexp_matches(extra, '^{T.SPACE}*$') THEN substring(main, 1, {BUDGET}) ELSE
regexp_replace(substring(main, 1, {BUDGET} - least(length(extra), {BUDGET // 3})), '{T.SPACE}+$', '') || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || substring(extra, 1, least(length(extra), {BUDGET // 3})) END, 1, {BUDGET}) AS trecho
FROM (SELECT *, array_to_string(p[1:{FIRST}], '') AS main, coalesce(array_to_string(p[ficha + 1:ficha + 2], ''), '') AS extra
FROM (SELECT *, list_min(list_filter(range({FIRST}, least(len(p), {excerpt.SEARCH_PAGES})), lambda i: regexp_matches(p[i + 1], '{excerpt.CIP}'))) AS ficha FROM (SELECT *, {_pages} AS p FROM convertidos) a) b) c"""
)
def excerpt_budget(s, d):
    df = table(s, d, "convertidos")
    return excerpt.excerpts(df, excerpt.pages_of(F.col("markdown_completo"), PAGE), FIRST, BUDGET).select("conv_id", F.col("pagina_ficha").cast("bigint").alias("pagina_ficha"), "trecho")


@query("SELECT conv_id, array_to_string(list_sort(list_transform(list_filter(map_entries(markdown_m), lambda e: e.key IN ('title','author','subject','keywords','creator','producer') AND e.value IS NOT NULL AND trim(e.value) <> ''), lambda e: e.key || '=' || trim(e.value))), '|') AS uteis FROM (SELECT conv_id, metadados_embutidos AS markdown_m FROM convertidos) t")
def embedded_useful(s, d):
    kept = excerpt.useful_embedded(F.col("metadados_embutidos"))
    return table(s, d, "convertidos").select("conv_id", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("uteis"))


_useful = "list_sort(list_transform(list_filter(map_entries(metadados_embutidos), lambda e: e.key IN ('title','author','subject','keywords','creator','producer') AND e.value IS NOT NULL AND trim(e.value) <> ''), lambda e: '- ' || e.key || ': ' || trim(e.value)))"


@query(
    f"""SELECT conv_id, concat_ws(chr(10), 'Arquivo: ' || nome_arquivo, 'Páginas: ' || total_paginas, CASE WHEN len(u) > 0 THEN 'Metadados embutidos:' || chr(10) || array_to_string(u, chr(10)) END, '', coalesce(markdown_inicial, '')) AS pedido
FROM (SELECT *, coalesce({_useful}, []) AS u FROM convertidos) t"""
)
def prompt_assembly(s, d):
    df = table(s, d, "convertidos")
    return df.select("conv_id", excerpt.user_prompt(F.col("nome_arquivo"), F.col("total_paginas"), F.col("metadados_embutidos"), F.coalesce("markdown_inicial", F.lit(""))).alias("pedido"))


@query("SELECT DISTINCT caminho FROM metadados WHERE caminho NOT IN (SELECT origem FROM resultados WHERE origem IS NOT NULL AND situacao = 'sucesso')")
def resume_pending(s, d):
    written = table(s, d, "resultados").where("situacao = 'sucesso'").select(F.col("origem").alias("caminho"))
    return batch.pending(table(s, d, "metadados").select("caminho").distinct(), written)


@query("SELECT DISTINCT caminho FROM metadados WHERE NOT EXISTS (SELECT 1 FROM resultados WHERE origem = caminho AND situacao <> 'falha') ORDER BY string_split(caminho, '/') LIMIT 100")
def resume_batch(s, d):
    done = table(s, d, "resultados").where("situacao <> 'falha'").select(F.col("origem").alias("caminho"))
    return batch.next_batch(table(s, d, "metadados").select("caminho").distinct(), done, 100)


_run = lambda f: f"(SELECT caminho, titulo, subtitulo, autor_principal, editora_ou_periodico FROM metadados WHERE fonte = '{f}' QUALIFY row_number() OVER (PARTITION BY caminho ORDER BY extraido_em DESC, recebido_em DESC, registro_id) = 1)"
_warn = lambda q: f"(SELECT *, len(a) >= 2 AND len(list_intersect(a, b)) < 2 AS w FROM (SELECT *, {T.tokens_sql(STEM)} AS a, {T.tokens_sql(RECORD_TEXT)} AS b FROM {q} q) r)"


@query(
    f"""SELECT caminho, CASE WHEN use THEN ft ELSE pt END AS titulo, use AS usou_fallback, CASE WHEN pe AND NOT use THEN CASE WHEN has THEN 'local: sem título; fallback: sem título' ELSE 'sem título' END END AS erro, CASE WHEN use THEN fw WHEN pe THEN false ELSE pw END AS avisado
FROM (SELECT *, has AND NOT fe AND (pe OR pw) AS use FROM (SELECT p.caminho, p.titulo AS pt, f.titulo AS ft, p.w AS pw, coalesce(f.w, false) AS fw, coalesce(trim(p.titulo), '') = '' AS pe, f.caminho IS NOT NULL AS has, coalesce(trim(f.titulo), '') = '' AS fe
FROM {_warn(_run('llm_local'))} p LEFT JOIN {_warn(_run('llm_pago'))} f ON p.caminho = f.caminho) x) y"""
)
def fallback_merge(s, d):
    def run(source: str) -> DataFrame:
        record = F.struct("caminho", "titulo", "subtitulo", "autor_principal", "editora_ou_periodico")
        last = F.struct("extraido_em", "recebido_em", -F.col("registro_id"))
        got = table(s, d, "metadados").where(F.col("fonte") == source).groupBy("caminho").agg(F.max_by(record, last).alias("registro"))
        return got.withColumn("erro", F.when(F.trim(F.coalesce("registro.titulo", F.lit(""))) == "", "sem título"))

    r = F.col("registro")
    warned = naming.divergence(last_part(F.col("caminho")), r["titulo"], r["subtitulo"], r["autor_principal"], r["editora_ou_periodico"])
    return batch.merge_fallback(run("llm_local"), run("llm_pago"), "caminho", warned).select("caminho", F.coalesce("registro.titulo", F.lit(None)).alias("titulo"), "usou_fallback", "erro", "avisado")


@query(
    """SELECT count(*) AS total, count(*) FILTER (situacao = 'sucesso') AS gravados, count(*) FILTER (situacao = 'simulado') AS simulados, count(*) FILTER (situacao = 'falha') AS falhas,
count(*) FILTER (situacao IN ('sucesso', 'simulado') AND provedor_usado = 'local') AS locais, count(*) FILTER (situacao IN ('sucesso', 'simulado')) - count(*) FILTER (situacao IN ('sucesso', 'simulado') AND provedor_usado = 'local') AS pagos,
count(*) FILTER (aviso <> '') AS avisos, coalesce(bool_or(usou_fallback), false) AS algum_fallback, cast(coalesce(bool_or(situacao = 'falha'), false) AS int) AS codigo_saida FROM resultados"""
)
def batch_summary(s, d):
    return batch.summary(table(s, d, "resultados"))


@query("SELECT etapa, erro, count(*) AS arquivos FROM resultados WHERE situacao = 'falha' GROUP BY etapa, erro")
def failures_report(s, d):
    return table(s, d, "resultados").where("situacao = 'falha'").groupBy("etapa", "erro").agg(F.count("*").alias("arquivos"))


@query("SELECT m.caminho, row_number() OVER (ORDER BY m.caminho) AS ordem, r.situacao FROM (SELECT DISTINCT caminho FROM metadados) m JOIN resultados r ON r.origem = m.caminho")
def results_in_order(s, d):
    listing = table(s, d, "metadados").select("caminho").distinct()
    results = table(s, d, "resultados").select(F.col("origem").alias("caminho"), "situacao").join(listing, "caminho")
    turns = naming.collisions(results.withColumn("lote", F.lit(0)), ["lote"], "caminho")
    return batch.in_input_order(results, turns.select("caminho", F.col("vez").alias("ordem"))).select("caminho", "ordem", "situacao")


@query(f"SELECT registro_id, recebido_em, md5('# ' || coalesce(titulo, '') || chr(10) || chr(10) || '## Referência Bibliográfica (ABNT)' || chr(10) || chr(10) || '> ' || coalesce(nullif({ONE_SPACE('referencia_abnt')}, ''), '{T.NO_VALUE}') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Conteúdo' || chr(10) || chr(10) || {ONE_SPACE('markdown_completo')} || chr(10)) AS resumo FROM metadados m JOIN convertidos c ON m.caminho = c.caminho")
def note_body(s, d):
    df = table(s, d, "metadados").join(table(s, d, "convertidos").select("caminho", "markdown_completo"), "caminho")
    return df.select("registro_id", "recebido_em", F.md5(note.body(F.col("titulo"), F.col("referencia_abnt"), F.col("markdown_completo"))).alias("resumo"))


#: Keys of the front matter whose values are written the same way whatever they hold, and the SQL of what they must say.
_front = {"ano": "coalesce(cast(ano AS varchar), 'null')", "total_paginas": "coalesce(cast(total_paginas AS varchar), 'null')", "catalogado_em": "'''2025-01-01'''", "provedor_extracao": "'local'", "extraido_via_fallback": "'false'", "autores_n": "len(coalesce(autores, []))", "etiquetas": "array_to_string(list_transform([T1, T2, T3], lambda x: '- ' || x), ' ')"}
_tags = {"T1": f"'area/' || {T.slug_sql('area_principal')}", "T2": f"'subarea/' || {T.slug_sql('subarea')}", "T3": f"'tipo/' || {T.slug_sql('tipo_publicacao')}"}
_said = {k: (v if k != "etiquetas" else v.replace("T1", _tags["T1"]).replace("T2", _tags["T2"]).replace("T3", _tags["T3"])) for k, v in _front.items()}


@query("SELECT registro_id, recebido_em, 20 AS chaves, " + ", ".join(f"{v} AS {k}" for k, v in _said.items()) + " FROM metadados m JOIN convertidos c ON m.caminho = c.caminho")
def note_render(s, d):
    df = table(s, d, "metadados").join(table(s, d, "convertidos").select("caminho", "markdown_completo", "total_paginas"), "caminho")
    front = F.regexp_extract("nota", r"(?s)^---\n(.*?)\n---\n", 1)
    value = lambda k: F.regexp_extract("f", rf"(?m)^{k}: (.*)$", 1).alias(k)
    block = lambda k: F.regexp_extract("f", rf"(?ms)^{k}:\n((?:- .*?\n)(?=\w|\z))", 1)
    made = note.notes(df, "2025-01-01", F.lit("local"), F.lit(False)).select("registro_id", "recebido_em", F.concat(front, F.lit("\n")).alias("f"))
    return made.select(
        "registro_id", "recebido_em", F.regexp_count("f", F.lit(r"(?m)^\w+:")).alias("chaves"), value("ano"), value("total_paginas"), value("catalogado_em"), value("provedor_extracao"), value("extraido_via_fallback"),
        F.regexp_count(block("autores"), F.lit(r"(?m)^- ")).cast("bigint").alias("autores_n"), F.regexp_replace(F.trim(F.regexp_replace(block("tags"), r"\n$", "")), r"\n", " ").alias("etiquetas"),
    )


_lost = "concat_ws(', ', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in validate.REQUIRED) + ")"


@query(
    f"""SELECT registro_id, recebido_em, CASE WHEN registro_id % 17 = 0 THEN 'JSON inválido' WHEN {_lost} <> '' THEN 'faltam campos: ' || {_lost}
WHEN tipo_publicacao NOT IN ({', '.join("'" + t + "'" for t in validate.TYPES)}) THEN 'tipo desconhecido: ' || tipo_publicacao WHEN registro_id % 19 = 0 AND ano IS NOT NULL THEN 'ano inválido: ' || ano || ' d.C.' END AS erro FROM metadados"""
)
def llm_json_validate(s, d):
    df = table(s, d, "metadados")
    year = F.when(F.col("registro_id") % 19 == 0, F.concat(F.col("ano").cast("string"), F.lit(" d.C."))).otherwise(F.col("ano").cast("string"))
    fields = [c for c in df.columns if c in validate.ANSWER and c != "ano"]
    made = F.to_json(F.struct(*fields, year.alias("ano"), F.lit("extra").alias("chave_extra")))
    answer = F.when(F.col("registro_id") % 17 == 0, F.substring(made, F.lit(2), F.length(made))).otherwise(made)
    return df.select("registro_id", "recebido_em", validate.validated(answer)["erro"].alias("erro"))
