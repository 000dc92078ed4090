"""The rule catalogue: each rule is one nullable evidence column, and a batch of items gives a long table of flags.

Rules are data (code, stage, field, repair target, evidence). One `select` works all of them out in generated code, and
one `explode` of the non-null ones makes the rows: no join, no shuffle. The few rules on string similarity keep the words
in question of each item first (see `lexical_flags`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.functions.similarity import may_reach, sequence_ratio, sequence_ratio_from
from quizmill.sources.staging import stage

C = F.col


@dataclass(frozen=True)
class Rule:
    code: str
    stage: str
    field: str
    repair: str
    evidence: Column  # null: the rule does not apply


def when(cond: Column, evidence: Column | str) -> Column:
    return F.when(cond, F.lit(evidence) if isinstance(evidence, str) else evidence)


def prepared(items: DataFrame) -> DataFrame:
    """items with the normalised texts that several rules look at, each worked out once; columns nobody reads are pruned."""
    have, out, more = set(items.columns), {}, {}
    text = lambda c: F.coalesce(c, F.lit(""))
    if "enunciado" in have:  # folding is by character, so a stem is folded once and its other forms come from that
        out |= {"_s6": T.plain_folded(C("enunciado"))}
        more |= {"_s3": T.words_of(C("_s6")), "_s4": T.spaces_of(C("_s6"))}
    if "resposta_correta" in have:
        out |= {"_a3": T.words_folded(C("resposta_correta"))}
    if {"enunciado", "alternativas"} <= have:
        o = F.transform("alternativas", text)
        out |= {"_o6": T.plain_folded(F.array_join(o, " ")), "_whole": F.concat_ws(" ", text(C("enunciado")), F.array_join(o, " ")), "_sizes": F.transform(o, lambda x: F.size(T.words(x)))}
        more |= {"_n6": F.concat(C("_s6"), F.lit(" "), C("_o6")), "_n4": F.trim(F.concat(T.spaces_of(C("_s6")), F.lit(" "), T.spaces_of(C("_o6"))))}
    return items.select("*", *(c.alias(k) for k, c in out.items())).select("*", *(c.alias(k) for k, c in more.items()))


def among(text: Column, words: list[str]) -> Column:
    """One of the words stands somewhere in a text: a test before a pattern that needs one."""
    return reduce(or_, (text.contains(w) for w in words))


def flags(items: DataFrame, rules: list[Rule], key: str = "item_id") -> DataFrame:
    """(key, code, stage, field, evidence, repair): one row for each item and rule that applies."""
    items = prepared(items)
    one = lambda r: F.when(r.evidence.isNotNull(), F.struct(F.lit(r.code).alias("code"), F.lit(r.stage).alias("stage"), F.lit(r.field).alias("field"), r.evidence.cast("string").alias("evidence"), F.lit(r.repair).alias("repair")))
    return items.select(key, F.explode(F.array_compact(F.array(*map(one, rules)))).alias("f")).select(key, "f.*")


def listed(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ", ")


def key_of(options: Column, correct: Column) -> Column:
    """The option that `correct` points to; null if it points nowhere."""
    return F.when((correct >= 0) & (correct < F.size(options)), F.try_element_at(options, (correct + 1).cast("int")))


def others(options: Column, correct: Column) -> Column:
    return F.filter(options, lambda x, i: i != correct)


# ---------------------------------------------------------------- IPv4


def cidr_prefix(c: Column) -> Column:
    """n of the first /n with one or two digits; null outside 0..32."""
    n = F.try_to_number(F.nullif(F.regexp_extract(c, r"(?<!\d)/\s*(\d{1,2})(?!\d)", 1), F.lit("")), F.lit("99")).cast("int")
    return F.when(n <= 32, n)


def mask_prefix(c: Column) -> Column:
    """Prefix length of the first dotted mask; null if an octet is over 255 or its one bits are not together at the left."""
    found = F.regexp_extract(c, r"\b((?:\d{1,3}\.){3}\d{1,3})\b", 1)
    octets = F.transform(F.split(found, r"\."), lambda x: x.cast("int"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    bits = F.lpad(F.bin(value), 32, "0")
    good = (found != "") & F.forall(F.filter(F.split(F.nullif(found, F.lit("")), r"\."), lambda x: x != ""), lambda x: x.cast("int") <= 255)
    return F.when(found == "", None).when(good & ~bits.contains("01"), F.length(F.replace(bits, F.lit("0"), F.lit(""))))


def looks_like_mask(c: Column) -> Column:
    return c.rlike(r"\b[0-9OoIl]{1,3}(?:\.[0-9OoIl]{1,3}){3}\b")


def prefix_of(c: Column) -> Column:
    return F.when(c.rlike(r"(?<!\d)/\s*(\d{1,2})(?!\d)"), cidr_prefix(c)).otherwise(mask_prefix(c))


def mask_of(prefix: Column) -> Column:
    """Dotted mask of a prefix length."""
    octet = lambda k: (F.lit(256) - F.pow(F.lit(2), F.lit(8) - F.least(F.greatest(prefix - 8 * k, F.lit(0)), F.lit(8)))).cast("int").cast("string")
    return F.concat_ws(".", *(octet(k) for k in range(4)))


def expected_prefix(stem: Column, s: Column | None = None) -> Column:
    """Of a stem that splits a network /n into equal parts: n and the bits that so many parts take; null if there is none or it is over 32."""
    base = F.nullif(F.regexp_extract(stem, r"\b(?:\d{1,3}\.){3}\d{1,3}/(\d{1,2})\b", 1), F.lit("")).cast("int")
    s = T.words_folded(stem) if s is None else s
    said = F.regexp_extract(F.when(s.contains("iguais"), s).otherwise(""), r"\b(?:dividir|subdividir|segmentar|separar)\w*.{0,120}?\b(?:em|para)\s+(\d+|duas|tres|quatro|cinco|seis|sete|oito|dezesseis)\s+(?:sub\s*redes?|partes|blocos)\s+iguais\b", 1)
    names = {"duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "dezesseis": 16}
    n = F.when(said.rlike(r"^\d{1,9}$"), F.try_to_number(F.when(said.rlike(r"^\d{1,9}$"), said), F.lit("999999999")).cast("int"))
    for word, k in names.items():
        n = F.when(said == word, k).otherwise(n)
    out = base + F.when(n >= 2, F.length(F.bin(n.cast("long") - 1)))
    return F.when(out <= 32, out)


# ---------------------------------------------------------------- detectors on stems

#: Patterns of the detectors.
COMMAND = r"\b(?:assinale|selecione|indique|identifique|classifique|determine|calcule|avalie|aponte|escolha|informe|marque|qual|quais|que alternativa|que opcao)\b"
#: The same words between single spaces, as folded words have them; what begins alike is tried once.
SPACED_COMMAND = r" (?:qua(?:l|is)|que (?:alternativa|opcao)|a(?:ssinale|valie|ponte)|i(?:ndique|dentifique|nforme)|s(?:elecione)|c(?:lassifique|alcule)|de(?:termine)|es(?:colha)|ma(?:rque)) "
FUNCTION = r"\b(?:deve|devera)\s+(?:permitir|gerar|registrar|calcular|emitir|enviar|armazenar|consultar|atualizar|processar|realizar|exibir|produzir|fornecer|autenticar)\b"
QUALITY = r"\b(?:tempo maximo|tempo de resposta|\d+(?:[.,]\d+)?\s*(?:ms|milissegundos?|segundos?|minutos?)|disponibilidade|desempenho|seguranca|confiabilidade|usabilidade|capacidade|latencia|criptografia|99[.,]\d+\s*%)\b"
FOCUS = r"(?:restricao de (?:tempo|desempenho|seguranca)|limite de tempo|atributo de qualidade|caracteristica de qualidade|aspecto de desempenho|classifica\w*.{0,40}(?:restricao|limite|desempenho|atributo|caracteristica))"
ROUTING = r"\b(?:rota|roteamento|encaminhamento|gateway|ospf|rip|bgp|estatica|estatico|dinamica|dinamico)\b"
TWO_TASKS = r"\b(?:enderecamento|mascara|sub\s*rede).{0,80}\b(?:e|com)\b.{0,80}\b(?:roteamento|encaminhamento|rota)\b|\b(?:roteamento|encaminhamento|rota).{0,80}\b(?:e|com)\b.{0,80}\b(?:enderecamento|mascara|sub\s*rede)\b"
NON_FUNCTIONAL = r"(?i)\b(?:segundos?|milissegundos?|simult[aâ]neos?|autenticad[oa]s?|seguran[cç]a|desempenho|disponibilidade|confiabilidade|usabilidade|capacidade|tempo de resposta)\b"


def has_command(stem: Column, s: Column | None = None) -> Column:
    s = T.words_folded(stem) if s is None else s
    return stem.contains("?") | F.concat(F.lit(" "), s, F.lit(" ")).rlike(SPACED_COMMAND)


def mixed_focus(stem: Column, answer: Column, s: Column | None = None, a: Column | None = None) -> Column:
    s, a = T.words_folded(stem) if s is None else s, T.words_folded(answer) if a is None else a
    about = a.contains("requisito nao funcional") | a.contains("requisito funcional") | a.isin("nao funcional", "funcional")
    return about & s.rlike(FUNCTION) & s.rlike(QUALITY) & ~s.rlike(FOCUS)


def several_concepts(stem: Column, answer: Column, s: Column | None = None, a: Column | None = None) -> Column:
    s, a = T.words_folded(stem) if s is None else s, T.words_folded(answer) if a is None else a
    return prefix_of(answer).isNotNull() & (a.rlike(ROUTING) | s.rlike(TWO_TASKS))


def formulaic(c: Column) -> Column:
    """Two signs and two numbers at least: lexical likeness says nothing about equality."""
    signs = F.length(c) - F.length(F.translate(c, "=<>[](){}+-×÷/¼½¾", ""))
    return (signs >= 2) & (F.regexp_count(c, F.lit(r"\d+(?:[.,]\d+)?")) >= 2)


def repeated_numeral(c: Column, ascii_words: bool = False) -> Column:
    """A Roman numeral stands twice as a word. Words are of letters, digits and _, those of ASCII alone if told so (there the V of `VÍA` is a numeral); no JVM's own \\b is used, which is of either kind."""
    letters = r"A-Za-z0-9_" if ascii_words else r"\p{L}\p{N}_"
    upper = F.upper(F.translate(c, "ßŉǰﬀﬁﬂﬃﬄﬅﬆ", "ẞ" * 10) if ascii_words else c)  # what the JVM makes several letters of is one here
    found = F.regexp_extract_all(upper, F.lit(rf"(?<![{letters}])[IVX]+(?![{letters}])"), F.lit(0))
    return F.size(found) != F.size(F.array_distinct(found))


#: Pairs that are both valid, and learning paradigms.
OPPOSITES = [
    ("aprendizado supervisionado", "aprendizado nao supervisionado"), ("aprendizagem supervisionada", "aprendizagem nao supervisionada"),
    ("funcional", "nao funcional"), ("requisito funcional", "requisito nao funcional"), ("requisitos funcionais", "requisitos nao funcionais"),
]
PARADIGMS = ["aprendizado supervisionado", "aprendizado nao supervisionado", "aprendizado semissupervisionado", "aprendizado autossupervisionado", "aprendizado por reforco", "aprendizagem supervisionada", "aprendizagem nao supervisionada"]


def valid_opposites(a: Column, b: Column) -> Column:
    x, y = T.words_folded(a), T.words_folded(b)
    out = (x != y) & x.isin(*PARADIGMS) & y.isin(*PARADIGMS)
    for p, q in OPPOSITES:
        out = out | ((x == p) & (y == q)) | ((x == q) & (y == p))
    return out


def family(answer: Column, stem: Column) -> Column:
    """Question family: assercoes, combinacao_itens, resposta_curta (four words at most) or resposta_textual."""
    a, s = T.spaces_folded(answer), T.spaces_folded(stem)
    both = a.contains("primeira") & a.contains("segunda")
    assertion = both & (a.rlike("afirmacao|assercao|proposicao") | s.rlike("porque|assercoes|afirmacoes"))
    combination = a.rlike(r"^(?:(?:apenas os itens? )?[ivx, e]+(?:,? apenas| estao certos?)?\.?|apenas (?:um|dois|tres|quatro|cinco) (?:item|itens) (?:esta|estao) certos?\.?)$") | a.contains("todos os itens estao certos")
    return F.when(assertion, "assercoes").when(combination, "combinacao_itens").when(F.size(F.split(a, " ")) <= 4, "resposta_curta").otherwise("resposta_textual")


# ---------------------------------------------------------------- rules


COPY = 0.82  # fixed value: the likeness from which a stem counts as copied


def stem_rules() -> list[Rule]:
    """On enunciado, resposta_correta, explicacao, competencia, habilidade, objeto_conhecimento, tem_imagem, recurso_visual; `referencia_ratio` where a reference was compared; in `flags`, which prepares the columns."""
    stem, answer = F.coalesce("enunciado", F.lit("")), F.coalesce("resposta_correta", F.lit(""))
    s, a = C("_s3"), C("_a3")
    rule = lambda code, field, evidence: Rule(code, "NUCLEO", field, "NUCLEO", evidence)
    blank = lambda code, field: rule(code, field, when(F.trim(F.coalesce(field, F.lit(""))) == "", "campo vazio"))
    expected, got = expected_prefix(stem, s), prefix_of(answer)
    labels = F.array_distinct(F.regexp_extract_all(F.when(stem.contains(")"), stem).otherwise(""), F.lit(r"(?<![\p{L}\p{N}_])([A-E])\)\s+"), F.lit(1)))
    parts = F.filter(F.regexp_extract_all(stem, F.lit(r"(?i)REQ\d+\s*[–—:-]\s*(.*?)(?=;\s*REQ\d+\b|\.\s*Qual\b|$)"), F.lit(1)), lambda x: x.rlike(NON_FUNCTIONAL))
    return [
        rule("enunciado_ausente_ou_curto", "enunciado", when(F.length(F.trim(stem)) < 40, F.concat(F.length(F.trim(stem)), F.lit(" caracteres")))),
        blank("resposta_correta_ausente", "resposta_correta"), blank("explicacao_ausente", "explicacao"), blank("competencia_ausente", "competencia"),
        blank("habilidade_ausente", "habilidade"), blank("objeto_conhecimento_ausente", "objeto_conhecimento"),
        rule("questao_multiconceito", "enunciado", when(several_concepts(stem, answer, s, a), "duas decisões num item: sub-rede e roteamento")),
        rule("gabarito_ipv4_inconsistente", "resposta_correta", when(expected != got, F.concat(F.lit("esperado /"), expected, F.lit(", gabarito /"), got))),
        rule("comando_da_questao_ausente", "enunciado", when(~has_command(stem, s), "nenhuma pergunta ou tarefa explícita")),
        rule("mistura_funcional_nao_funcional_ambigua", "enunciado", when(mixed_focus(stem, answer, s, a), "função e qualidade sem foco explícito")),
        rule("alternativas_embutidas_no_nucleo", "enunciado", when(F.size(labels) >= 2, listed(labels))),
        rule("gabarito_repetido_no_enunciado", "enunciado", when((a != "") & (F.size(F.split(a, " ")) <= 18) & F.concat(F.lit(" "), s, F.lit(" ")).contains(F.concat(F.lit(" "), a, F.lit(" "))), "o enunciado contém a resposta")),
        rule("formatacao_quebrada", "enunciado", when(stem.contains(r"\n") & ~stem.contains("\n") & (F.regexp_count(stem, F.lit(r"\\n")) >= 2), "quebras de linha como texto")),
        rule("dependencia_visual_ausente", "recurso_visual", when(F.coalesce("tem_imagem", F.lit(False)) & (F.coalesce("recurso_visual", F.lit("")) == ""), "imagem sem recurso")),
        rule("implementacao_nao_delimitada", "enunciado", when(among(C("_s6"), ["xmin", "xmax"]) & F.lower(stem).rlike(r"\b(?:xmin|xmax)\b") & ~F.lower(stem).contains("postgresql"), "xmin/xmax sem PostgreSQL")),
        rule("possivel_copia_da_referencia", "enunciado", when(C("referencia_ratio") >= COPY, "similaridade lexical >= 0.82")),
        rule("enunciado_ambiguo", "enunciado", when(C("_s6").contains("quais") & stem.rlike(r"(?iu)\bquais\b.{0,45}\b(?:propriedades|técnicas|mecanismos|protocolos|itens)\b") & ~answer.rlike(r"(?i)[,;/]|\s+e\s+"), "pergunta plural, gabarito singular")),
        rule("espaco_de_respostas_binario", "enunciado", when(C("_s6").contains("funcional") & stem.rlike(r"(?iu)\bfuncional\s+ou\s+n[aã]o\s+funcional\b"), "só duas classes possíveis")),
        rule("multiplos_candidatos_ao_gabarito", "enunciado", when(answer.rlike(r"(?i)\bREQ\d+\b") & F.lower(stem).contains("requisito não funcional") & (F.size(parts) > 1), F.concat(F.size(parts), F.lit(" requisitos com marcadores")))),
        rule("selecao_de_protocolo_potencialmente_ambigua", "enunciado", when(a.isin("tcp", "udp") & stem.rlike(r"(?i)\bqual\s+protocolo\b"), "outros protocolos podem servir")),
    ]


def distractor_rules(ascii_numerals: bool = False) -> list[Rule]:
    """On enunciado, resposta_correta and distratores (array of text); rules on similarity are in lexical_flags. ascii_numerals: see `repeated_numeral`."""
    stem, answer = F.coalesce("enunciado", F.lit("")), F.coalesce("resposta_correta", F.lit(""))
    d = F.transform("distratores", lambda x: F.trim(F.coalesce(x, F.lit(""))))
    rule = lambda code, evidence, field="distratores": Rule(code, "DISTRATORES", field, "DISTRATORES", evidence)
    some = lambda f: F.array_join(F.filter(F.transform(d, lambda x, i: F.when(f(x), F.concat(i.cast("string"), F.lit(":"), x))), lambda x: x.isNotNull()), "; ")
    any_ = lambda f: when(F.exists(d, f), some(f))
    norm, a = F.transform(d, T.words_folded), T.words_folded(answer)
    context = T.words_folded(F.concat_ws(" ", stem, answer))
    key = F.coalesce(mask_prefix(answer), cidr_prefix(answer))
    about = key.isNotNull() & context.rlike("ipv4|mascara|sub rede|cidr|hosts")
    return [
        rule("quantidade_distratores_invalida", when(F.size(d) != 4, F.concat(F.lit("recebidos="), F.size(d)))),
        rule("distrator_com_rotulo_embutido", any_(lambda x: x.rlike(r"(?i)^\s*(?:\([A-E]\)|[A-E][\)\].:\-])\s*"))),
        rule("distrator_vazio", when(F.exists(d, lambda x: x == ""), "há texto vazio")),
        rule("distratores_duplicados", when(F.size(norm) != F.size(F.array_distinct(norm)), "há textos repetidos")),
        rule("copia_normalizada_gabarito", when(F.array_contains(norm, a), F.concat(F.lit("distratores["), F.array_position(norm, a) - 1, F.lit("]")))),
        rule("mascara_ipv4_invalida", when(about, any_(lambda x: looks_like_mask(x) & prefix_of(x).isNull()))),
        rule("mascara_ipv4_equivalente_ao_gabarito", when(about, any_(lambda x: prefix_of(x) == key))),
        rule("distrator_tipo_incompativel_ipv4", when(about, any_(lambda x: ~looks_like_mask(x) & prefix_of(x).isNull()))),
        rule("combinacao_de_itens_invalida", when(F.exists(d, lambda x: repeated_numeral(x, ascii_numerals)), "numeral romano repetido")),
    ]


def item_rules() -> list[Rule]:
    """On alternativas and correta."""
    o, c = C("alternativas"), C("correta")
    same = F.transform(o, lambda x: F.lower(F.trim(x)))
    rule = lambda code, field, evidence: Rule(code, "ITEM", field, "DISTRATORES", evidence)
    return [
        rule("quantidade_alternativas_invalida", "alternativas", when(F.size(o) != 5, F.concat(F.lit("recebidas="), F.size(o)))),
        rule("gabarito_estruturalmente_invalido", "correta", when(c.isNull() | (c < 0) | (c >= F.size(o)), F.coalesce(c.cast("string"), F.lit("None")))),
        rule("alternativas_duplicadas", "alternativas", when(F.size(F.array_distinct(same)) != F.size(same), "há textos repetidos")),
    ]


#: Leak marks, patterns and words of the analyzer.
LEAKS = ["questionario de percepcao", "rascunho", "area livre", "cartao-resposta", "exame nacional de desempenho dos estudantes"]
NEGATIVE = r"\b(exceto|incorreta|nao corresponde|nao e)\b"
ABSOLUTE = r"\b(sempre|nunca|jamais|todos?|nenhum)\b"
VAGUE = r"\b(frequentemente|ocasionalmente|geralmente|raramente|muitas vezes)\b"
#: What a text has to hold for each of the three.
NEGATIVE_WORDS = ["exceto", "incorreta", "nao corresponde", "nao e"]
ABSOLUTE_WORDS = ["sempre", "nunca", "jamais", "todo", "nenhum"]
VAGUE_WORDS = ["frequentemente", "ocasionalmente", "geralmente", "raramente", "muitas vezes"]
CUE_STOP = ["qual", "quais", "uma", "para", "como", "deve", "pode", "sistema", "considerando"]


def cue_words(stem: Column, answer: Column) -> Column:
    """Words over three characters that a folded stem and a key share."""
    words = F.array_distinct(F.regexp_extract_all(T.plain_folded(answer), F.lit("[a-z0-9]+"), F.lit(0)))
    there = lambda w: stem.contains(w) & F.rlike(stem, F.concat(F.lit("(?<![a-z0-9])"), w, F.lit("(?![a-z0-9])")))
    return F.array_sort(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*CUE_STOP) & there(w)))


def analyzer_rules() -> list[Rule]:
    """The assembled item, on enunciado, alternativas, correta, tem_imagem, recurso_visual."""
    stem, o, c = F.coalesce("enunciado", F.lit("")), F.transform("alternativas", lambda x: F.coalesce(x, F.lit(""))), C("correta")
    whole, n, sizes = C("_whole"), C("_n4"), C("_sizes")
    key, mine = key_of(o, c), key_of(sizes, c)
    rest = T.spaces_folded(F.array_join(others(o, c), " "))
    cues = F.filter(cue_words(C("_s6"), key), lambda w: ~rest.contains(w))
    marks = F.regexp_extract_all(F.when(whole.contains("<"), whole).otherwise(""), F.lit(r"<\s*[A-Z][A-Z0-9_-]*\s*>"), F.lit(0))
    leaks = F.filter(F.array(*map(F.lit, LEAKS)), lambda m: n.contains(m))
    found = lambda p, w: F.regexp_extract_all(F.when(among(n, w), n).otherwise(""), F.lit(p), F.lit(1))
    absolute, vague = found(ABSOLUTE, ABSOLUTE_WORDS), found(VAGUE, VAGUE_WORDS)
    rule = lambda code, field, evidence, repair="NUCLEO": Rule(code, "DETERMINISTICA", field, repair, evidence)
    return [
        rule("formatacao_quebrada", "questao", when(whole.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "caracteres de controle")),
        rule("placeholder_residual", "questao", when(F.size(marks) > 0, listed(marks)), "DISTRATORES"),
        rule("formatacao_quebrada", "questao", when((F.length(stem) > 5000) | F.exists(o, lambda x: F.length(x) > 1200), "texto longo demais")),
        rule("vazamento_de_artefato", "questao", when(F.size(leaks) > 0, F.array_join(leaks, ", "))),
        rule("vazamento_de_artefato", "alternativas", when(T.spaces_of(C("_o6")).rlike(r"\bquest\s*[aã]\s*o\s+\d{1,3}\b"), "outra questão anexada"), "DISTRATORES"),
        rule("dependencia_visual_ausente", "recurso_visual", when(F.coalesce("tem_imagem", F.lit(False)) & (F.coalesce("recurso_visual", F.lit("")) == ""), "imagem sem recurso")),
        rule("formatacao_quebrada", "alternativas", when(F.exists(o, lambda x: F.trim(x) == ""), "alternativa vazia"), "DISTRATORES"),
        rule("iwf_gabarito_mais_longo", "alternativas", when((mine == F.array_max(sizes)) & (F.size(F.filter(sizes, lambda x: x == mine)) == 1) & (mine >= F.array_min(sizes) + 2), F.array_join(sizes.cast("array<string>"), ", ")), "DISTRATORES"),
        rule("iwf_repeticao_entrega_gabarito", "enunciado", when(F.size(cues) > 0, F.array_join(cues, ", "))),
        rule("iwf_comando_negativo", "enunciado", when(among(C("_s4"), NEGATIVE_WORDS) & C("_s4").rlike(NEGATIVE), "comando negativo")),
        rule("iwf_termo_absoluto", "questao", when(F.size(absolute) > 0, listed(absolute))),
        rule("iwf_termo_vago", "questao", when(F.size(vague) > 0, listed(vague))),
    ]


#: Criteria that need a judge.
IWF_SEMANTIC = ["ambiguous_information", "convergence_cues", "grammatical_cues", "gratuitous_information", "implausible_distractors", "logical_cues", "more_than_one_correct", "unfocused_stem"]


def iwf_vector(items: DataFrame, key: str = "item_id", judged: list[str] | None = None) -> DataFrame:
    """key, 19 nullable criteria, n_flaws, n_unresolved, classification. Semantic criteria come from columns named in `judged`, else they stay null, unresolved."""
    stem, o, c = F.coalesce("enunciado", F.lit("")), F.transform("alternativas", lambda x: F.coalesce(x, F.lit(""))), C("correta")
    items, n, sizes = prepared(items), C("_n6"), C("_sizes")
    mine, answer = key_of(sizes, c), F.coalesce(key_of(o, c), F.lit(""))
    rest, cues = T.plain_folded(F.array_join(others(o, c), " ")), cue_words(C("_s6"), answer)
    per = lambda p: F.exists(o, lambda x: T.plain_folded(x).rlike(p))
    out = {
        "longest_option_correct": F.coalesce((mine == F.array_max(sizes)) & (mine >= F.greatest(F.lit(3), F.array_min(sizes) + 2)), F.lit(False)),
        "true_or_false": F.size(F.filter(o, lambda x: T.plain_folded(x).rlike(r"^\s*(verdadeir[oa]|fals[oa]|sim|nao)\s*\.?$"))) >= 2,
        "absolute_terms": n.rlike(ABSOLUTE),
        "complex_k_type": F.array_join(o, " ").rlike(r"\b(?:I|II|III|IV|V)(?:\s*(?:,|e)\s*(?:I|II|III|IV|V))+"),
        "negatively_worded": C("_s6").rlike(NEGATIVE),
        "lost_sequence": F.lit(False),
        "none_of_the_above": per(r"\bnenhuma das (?:alternativas|anteriores)\b"),
        "all_of_the_above": per(r"\btodas as (?:alternativas|anteriores)\b"),
        "fill_in_the_blank": stem.rlike(r"_{3,}|\.{3,}|\[\s*\]"),
        "vague_terms": n.rlike(VAGUE),
        "word_repeats": (F.size(cues) > 0) & F.forall(cues, lambda w: ~rest.contains(w)),
    }
    out |= {k: C(k) if judged and k in judged else F.lit(None).cast("boolean") for k in IWF_SEMANTIC}
    wide = items.select(key, *(v.alias(k) for k, v in out.items()))
    flaws = sum((F.coalesce(C(k).cast("int"), F.lit(0)) for k in out), F.lit(0)).cast("long")
    open_ = sum((C(k).isNull().cast("int") for k in out), F.lit(0)).cast("long")
    wide = wide.withColumn("n_flaws", flaws).withColumn("n_unresolved", open_)
    return wide.withColumn("classification", F.when(C("n_unresolved") > 0, "incomplete").when(C("n_flaws") <= 1, "acceptable").otherwise("unacceptable"))


def triage(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Review flags and metrics of items against their specification (spec_objetivo, spec_objeto): key, flags (array), six metrics."""
    stem, o, c = F.trim(F.coalesce("enunciado", F.lit(""))), F.transform("alternativas", lambda x: F.trim(F.coalesce(x, F.lit("")))), C("correta")
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))
    sets = {
        "_expected": T.triage_words(F.concat_ws(" ", "spec_objetivo", "spec_objeto")), "_made": T.triage_words_of(F.concat_ws(" ", "_s6", T.plain_folded(F.concat_ws(" ", "objeto_conhecimento", "competencia", "habilidade")))),
        "_want": T.triage_words(C("spec_objeto")), "_got": T.triage_words(C("objeto_conhecimento")), "_answer": T.triage_words(key_of(o, c)),
        "_lengths": F.transform(F.filter(o, lambda x: x != ""), lambda x: F.size(T.triage_words(x))), "_open": F.trim("_s6"),
    }
    expected, made, want, got, answer, sizes = map(C, ("_expected", "_made", "_want", "_got", "_answer", "_lengths"))
    block = flags(items, [*stem_rules(), *item_rules()], key).groupBy(key).agg(F.count("*").alias("flags_bloqueio"))
    found = F.array_compact(F.array(
        F.when(C("_open").rlike(r"^(cite|descreva|explique|discorra)\b"), F.lit("comando_resposta_aberta_em_item_objetivo")),
        F.when(T.plain_folded(F.array_join(o, " ")).rlike("estructura|arquitectura|requisito funcionales"), F.lit("idioma_inconsistente")),
        F.when((F.size(expected) > 0) & (share(expected, made) < 0.20), F.lit("possivel_desalinhamento_com_especificacao")),
        F.when((F.size(want) > 0) & (F.size(got) > 0) & (share(want, got) < 0.20), F.lit("possivel_desalinhamento_do_objeto_conhecimento")),
        F.when((F.size(answer) > 0) & ~F.arrays_overlap(answer, T.triage_words(C("explicacao"))), F.lit("explicacao_nao_nomeia_gabarito")),
        F.when(F.array_max(sizes) >= F.greatest(F.lit(4), 3 * F.greatest(F.lit(1), F.array_min(sizes))), F.lit("alternativas_com_extensao_desequilibrada")),
    ))
    x = prepared(items).select("*", *(v.alias(k) for k, v in sets.items())).select(key, found.alias("flags"), F.length(stem).cast("long").alias("enunciado_caracteres"), F.size(o).cast("long").alias("alternativas"), F.round(share(expected, made), 3).alias("sobreposicao_especificacao"), F.round(share(want, got), 3).alias("sobreposicao_objeto_conhecimento"))
    return x.join(block, key, "left").withColumn("flags_bloqueio", F.coalesce("flags_bloqueio", F.lit(0)).cast("long")).withColumn("flags_revisao", F.size("flags").cast("long"))


# ---------------------------------------------------------------- rules on similarity


def word_bases(tokens: Column) -> Column:
    """`token_base` of each of some tokens of Latin-1, worked out on all of them at once."""
    return F.split(F.regexp_replace(T.plain_folded(F.array_join(tokens, " ")), "[^a-z0-9 ]", ""), " ")


def lexical_words(items: DataFrame, key: str) -> DataFrame:
    """What the rules on likeness need of an item, in a row without its stem.

    d, answer: trimmed distractors and the key; open: no assertion or combination; copied: a distractor is the key in
    words; bases: of the key's words, from six letters on; near: (form, o) of the words of stem and key, from five letters
    on, whose base begins with the first three letters of a distractor's word: no other can be equal or like to one.
    """
    stem, answer = F.coalesce("enunciado", F.lit("")), F.coalesce("resposta_correta", F.lit(""))
    d = F.transform("distratores", lambda v: F.trim(v))
    x = items.select(
        key, d.alias("d"), answer.alias("answer"), T.words_folded(answer).alias("na"), (~family(answer, stem).isin("combinacao_itens", "assercoes")).alias("open"), T.letter_tokens(answer).alias("_a"),
        T.letter_tokens(F.array_join(d, " ")).alias("_d"), T.letter_tokens(F.concat_ws(" ", "enunciado", "resposta_correta")).alias("_q"),
    )
    x = x.select("*", F.array_distinct(F.split(F.lower(F.array_join("_q", " ")), " ")).alias("_f")).drop("_q")
    x = x.select("*", word_bases(C("_f")).alias("_o"), F.array_distinct(F.transform(F.filter(word_bases(C("_d")), lambda b: F.length(b) >= 5), lambda b: F.left(b, F.lit(3)))).alias("_p"))
    begins = lambda p: F.filter(F.arrays_zip(C("_f").alias("form"), C("_o").alias("o")), lambda w: (F.length(w["o"]) >= 5) & F.array_contains(p, F.left(w["o"], F.lit(3))))
    near = F.element_at(F.transform(F.array("_p"), begins), 1)  # the name p keeps Spark from working _p out for each word
    copied = F.exists("d", lambda v: T.words_folded(v) == C("na"))
    return x.select(key, "d", "answer", "na", "open", copied.alias("copied"), F.array_distinct(F.filter(word_bases(C("_a")), lambda b: F.length(b) >= 6)).alias("bases"), near.alias("near"))


def lexical_flags(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, code, evidence) of the rules on sequence ratios: paraphrase of the key, deformed key words, corrupted words of the question.

    Items are read once and each row is judged by itself: stems are cut into words there, and the few words that may
    count go on, staged. Only pairs that share a prefix and are of like length reach the ratio. Equal rows are given once.
    """
    rows = stage(lexical_words(items, key), "lexical_words")
    d = rows.select(key, "answer", "na", "open", "copied", "bases", "near", F.posexplode("d").alias("i", "x"))
    para = d.where("open and not copied").withColumn("nx", T.words_folded(C("x"))).where((C("nx") != C("na")) & ~(formulaic(C("answer")) | valid_opposites(C("x"), C("answer"))) & may_reach("nx", "na", 0.82))
    para = para.withColumn("r", sequence_ratio("nx", "na")).where("r >= 0.82").select(key, F.lit("distrator_parafraseia_gabarito").alias("code"), F.concat("i", F.lit(":"), "x").alias("evidence"))
    mine = d.select(key, "i", "bases", "near", F.explode(F.array_distinct(T.letter_tokens(C("x")))).alias("t")).withColumn("b", T.token_base(C("t"))).where(F.length("b") >= 5)
    deformed = mine.where(F.length("b") >= 6).select(key, "i", "b", F.explode("bases").alias("o"))
    deformed = deformed.where((F.left("b", F.lit(4)) == F.left("o", F.lit(4))) & (F.abs(F.length("b") - F.length("o")) <= 4) & (C("b") != C("o")) & (T.plural_base(C("b")) != T.plural_base(C("o"))) & may_reach("b", "o", 0.80))
    known = mine.select(key, "i", "b", "t", "near", F.filter("near", lambda w: w["o"] == C("b")).alias("same"))
    odd = known.where((F.size("same") > 0) & ~F.array_contains("same.form", F.lower("t"))).select(key, "i", "b", C("b").alias("o"))
    pairs = known.where(F.size("same") == 0).select(key, "i", "b", F.explode(F.array_distinct(C("near.o"))).alias("o")).where(F.left("b", F.lit(3)) == F.left("o", F.lit(3)))
    close = pairs.where((F.abs(F.length("b") - F.length("o")) <= 3) & ~T.same_inflection(C("b"), C("o")) & may_reach("b", "o", 0.86))
    like = deformed.withColumn("least", F.lit(0.80)).unionByName(close.withColumn("least", F.lit(0.86))).withColumn("r", sequence_ratio("b", "o")).where("r >= least").select(key, "i", "b", "o")
    corrupted = odd.unionByName(like).select(key, F.lit("distrator_lexicalmente_corrompido").alias("code"), F.concat("i", F.lit(":"), "b", F.lit("~"), "o").alias("evidence"))
    return para.unionByName(corrupted).distinct()


def with_reference_ratio(items: DataFrame, reference: str | None) -> DataFrame:
    """Adds referencia_ratio, the ratio of stem and reference text where it is at least COPY (null below, and without a reference)."""
    if reference is None:
        return items.withColumn("referencia_ratio", F.lit(None).cast("double"))
    return items.withColumn("referencia_ratio", F.when(F.coalesce(reference, F.lit("")) != "", sequence_ratio_from(T.words_folded(C("enunciado")), T.words_folded(C(reference)), COPY)))
