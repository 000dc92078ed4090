"""Operators on literal examples: rules, retrieval, lifecycle, campaign, generators, dataset, sources, streaming."""

import json

import pytest
from pyspark.sql import functions as F
from quizmill.functions import similarity as S
from quizmill.functions import text as T
from quizmill.operators import campaign, dataset, generators, lifecycle, retrieval, rules
from quizmill.sources import files, providers

STEM = "enunciado string, resposta_correta string, explicacao string, competencia string, habilidade string, objeto_conhecimento string, tem_imagem boolean, recurso_visual string"


def one(spark, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.ascii_fold, "Straße — “Ação” ﬁ ½", "strae  acao fi 12"), (T.words_folded, "Não-funcional: ﬁla_1 Straße!", "nao funcional fila_1 strasse"),
        (T.spaces_folded, "  Olá,\n mundo ", "ola, mundo"), (T.short_key, "Árvore B+ ", "arvoreb"), (T.token_base, "Índice_2", "indice2"), (T.accented_key, "Ação, já!", "açãojá"),
        (T.code_slug, "Gabarito  óbvio!", "GABARITO_OBVIO"), (T.code_slug, "!!", "CUSTOM"), (T.seed_slug, "Ação básica", "ao-bsica"), (T.plural_base, "funcionais", "funcional"), (T.plural_base, "requisitos", "requisito"),
        (T.words_folded, None, ""), (T.ascii_fold, "", ""),
    ],
)
def test_normalisers(spark, f, text, want):
    assert one(spark, text).select(f(F.col("c0"))).first()[0] == want


def test_terms_and_aliases(spark):
    got = one(spark, "O TCP e a condição de corrida em sub-redes").select(T.with_bigrams(T.unigrams(F.col("c0"), retrieval.ALIASES))).first()[0]
    assert got == ["tcp", "condicao_corrida", "subrede", "tcp__condicao_corrida", "condicao_corrida__subrede"]
    assert one(spark, "").select(T.with_bigrams(T.unigrams(F.col("c0")))).first()[0] == []


def codes(spark, rule_list, schema, **values):
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([(1, *(values.get(n) for n in names))], "item_id int, " + schema)
    if "resposta_correta" in names and "distratores" not in names:
        df = rules.with_reference_ratio(df, None)
    return {r["code"] for r in rules.flags(df, rule_list).collect()}


LONG = "Considere um sistema acadêmico com muitos usuários simultâneos. "


@pytest.mark.parametrize(
    ("stem", "answer", "present", "absent"),
    [
        (LONG + "Quais propriedades das transações são garantidas?", "Atomicidade", ["enunciado_ambiguo"], []),
        (LONG + "O requisito é funcional ou não funcional?", "Funcional", ["espaco_de_respostas_binario"], []),
        (LONG + "REQ1: emitir boletos; REQ2: responder em dois segundos; REQ3: alta disponibilidade. Qual é um requisito não funcional?", "REQ2", ["multiplos_candidatos_ao_gabarito"], []),
        (LONG + "Qual protocolo deve ser usado?", "TCP", ["selecao_de_protocolo_potencialmente_ambigua"], []),
        (LONG + "Qual estrutura, como uma fila, atende em ordem?", "Fila", ["gabarito_repetido_no_enunciado"], []),
        (LONG + "O sistema deve registrar vendas com tempo de resposta de 2 segundos.", "Requisito não funcional", ["comando_da_questao_ausente", "mistura_funcional_nao_funcional_ambigua"], []),
        ("A rede 192.168.0.0/24 deve subdividir a faixa em quatro sub-redes iguais. Qual é o prefixo?", "/25", ["gabarito_ipv4_inconsistente"], []),
        ("A rede 192.168.0.0/24 deve subdividir a faixa em quatro sub-redes iguais. Qual é o prefixo?", "/26", [], ["gabarito_ipv4_inconsistente"]),
        (LONG + "Qual configuração usar?", "/26 com rota estática", ["questao_multiconceito"], []),
        ("Curto?", "x", ["enunciado_ausente_ou_curto", "explicacao_ausente"], ["comando_da_questao_ausente"]),
        (LONG + "A) um B) dois. Assinale.", "um", ["alternativas_embutidas_no_nucleo"], []),
        (LONG + r"a\nb\nc Qual?", "x", ["formatacao_quebrada"], []),
        (LONG + "xmin define a versão. Qual?", "x", ["implementacao_nao_delimitada"], []),
    ],
)
def test_stem_rules(spark, stem, answer, present, absent):
    got = codes(spark, rules.stem_rules(), STEM, enunciado=stem, resposta_correta=answer)
    assert set(present) <= got and not set(absent) & got


SET = "enunciado string, resposta_correta string, distratores array<string>"


@pytest.mark.parametrize(
    ("answer", "options", "present"),
    [
        ("Atomicidade", ["Isolamento", "Durabilidade", "Consistência", "Isolamento"], {"distratores_duplicados"}),
        ("Fila", ["(D) Pilha", "Heap", "", "fila"], {"distrator_com_rotulo_embutido", "distrator_vazio", "copia_normalizada_gabarito"}),
        ("/26", ["254.248.0.OO", "/26", "/27", "texto"], {"mascara_ipv4_invalida", "mascara_ipv4_equivalente_ao_gabarito", "distrator_tipo_incompativel_ipv4", "copia_normalizada_gabarito"}),
        ("I e II", ["I e I", "II", "III"], {"combinacao_de_itens_invalida", "quantidade_distratores_invalida"}),
        ("Fila", ["Pilha", "Heap", "Árvore", "Grafo"], set()),
    ],
)
def test_distractor_rules(spark, answer, options, present):
    assert codes(spark, rules.distractor_rules(), SET, enunciado="Máscara de sub-rede IPv4", resposta_correta=answer, distratores=options) == present


def test_lexical_rules(spark):
    rows = [(1, "Qual requisito?", "Requisito não funcional", ["Requisitórios", "Requisitos funcionais"]), (2, "Qual paradigma?", "Aprendizado supervisionado", ["Aprendizado não supervisionado"]), (3, "Qual?", "Atomicidade da transação", ["Atomicidade da transacão", "Durabilidade"])]
    df = spark.createDataFrame(rows, "item_id int, enunciado string, resposta_correta string, distratores array<string>")
    got = {(r["item_id"], r["code"], r["evidence"].split(":")[0]) for r in rules.lexical_flags(df).collect()}
    assert (1, "distrator_lexicalmente_corrompido", "0") in got and not any(i == 2 and c == "distrator_parafraseia_gabarito" for i, c, _ in got)
    assert not any(i == 1 and c == "distrator_lexicalmente_corrompido" and k == "1" for i, c, k in got)


def test_lexical_rules_judge_each_row_by_itself(spark):
    rows = [(None, "Qual protocolo garante confiabilidade?", "Atomicidade", ["A confiabilidadi, talvez", "Atomicidades plenas", None]), (7, "Qual protocolo garante confiabilidade?", "Fila", ["CONFIABILIDADE", "Confiabilidàde"])]
    df = spark.createDataFrame(rows, "item_id int, enunciado string, resposta_correta string, distratores array<string>")
    out = rules.lexical_flags(df)
    assert {(r["item_id"], r["evidence"]) for r in out.collect()} == {(None, "0:confiabilidadi~confiabilidade"), (7, "1:confiabilidade~confiabilidade")}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


ITEM = "enunciado string, alternativas array<string>, correta int, tem_imagem boolean, recurso_visual string"


@pytest.mark.parametrize(
    ("stem", "options", "correct", "image", "want"),
    [
        ("Assinale a opção.", ["A", "B", "C", "D", "E"], 0, False, set()),
        ("Assinale a opção.", ["A", "<NAME>", "C", "D", "E"], 0, False, {"placeholder_residual"}),
        ("Assinale a opção.", ["A", "B", "C", "D", "E"], 0, True, {"dependencia_visual_ausente"}),
        ("Assinale.", ["uma opção bem longa mesmo", "b", "c", "d", "e"], 0, False, {"iwf_gabarito_mais_longo"}),
        ("Assinale.", ["uma opção longa", "outra opção longa", "c", "d", "e"], 0, False, set()),
        ("Não é correto, exceto sempre.", ["A", "B", "C", "D", "E"], 0, False, {"iwf_comando_negativo", "iwf_termo_absoluto"}),
        ("Uma estrutura FIFO do tipo.", ["Fila fifo", "Pilha", "Heap", "Árvore", "Grafo"], 0, False, {"iwf_repeticao_entrega_gabarito"}),
        ("Uma estrutura ordenada.", ["Fila ordenada", "Pilha x", "Heap x", "Árvore", "Grafo"], 0, False, {"iwf_repeticao_entrega_gabarito"}),
        ("Geralmente\x01 rascunho", ["A", " ", "C", "questão 12", "E"], 7, False, {"iwf_termo_vago", "formatacao_quebrada", "vazamento_de_artefato"}),
    ],
)
def test_analyzer_rules(spark, stem, options, correct, image, want):
    assert codes(spark, rules.analyzer_rules(), ITEM, enunciado=stem, alternativas=options, correta=correct, tem_imagem=image) == want


def test_item_rules(spark):
    assert codes(spark, rules.item_rules(), ITEM, alternativas=["a", "A ", "c"], correta=7) == {"quantidade_alternativas_invalida", "gabarito_estruturalmente_invalido", "alternativas_duplicadas"}


def test_iwf(spark):
    df = spark.createDataFrame([(1, "Sempre vale ...", ["Todas as alternativas", "Nenhuma das anteriores", "c", "d", "e"], 2), (2, "Assinale", ["a", "b", "c", "d", "e"], 0)], "item_id int, enunciado string, alternativas array<string>, correta int")
    a, b = rules.iwf_vector(df).orderBy("item_id").collect()
    assert a["absolute_terms"] and a["fill_in_the_blank"] and a["all_of_the_above"] and a["none_of_the_above"] and a["classification"] == "incomplete" and a["unfocused_stem"] is None
    assert b["n_flaws"] == 0 and b["n_unresolved"] == 8
    judged = df
    for k in rules.IWF_SEMANTIC:
        judged = judged.withColumn(k, F.lit(False))
    assert [r["classification"] for r in rules.iwf_vector(judged, judged=rules.IWF_SEMANTIC).orderBy("item_id").collect()] == ["unacceptable", "acceptable"]


CORPUS = [
    ("ipv4", "O endereçamento IPv4 usa 32 bits; CIDR e a máscara permitem subnetting de redes.", "Redes de Computadores", "Endereçamento IPv4"),
    ("tcp", "O TCP oferece entrega ordenada e confirmada entre processos em rede de pacotes.", "Redes de Computadores", "Protocolo TCP"),
    ("acid", "As transações em bancos de dados têm atomicidade, consistência, isolamento e durabilidade.", "Banco de Dados", "Transações"),
]


def test_retrieval(spark):
    raw = spark.createDataFrame([(i, t, a, o, "ENADE" if i == "tcp" else None) for i, t, a, o in CORPUS], "id string, texto string, area string, objeto_conhecimento string, exame string")
    docs = retrieval.normalise_records(raw)
    assert docs.count() == 3 and docs.where("exame = 'ACERVO_LOCAL'").count() == 2
    specs = spark.createDataFrame([("s1", "sub-redes IPv4 e CIDR", "subnetting IPv4", None), ("s2", "entrega ordenada TCP", "TCP", None), ("s3", "fotossíntese das plantas", "fotossíntese", None)], "spec_id string, query string, objeto string, exame string")
    specs = specs.withColumn("curso", F.lit(None).cast("string")).withColumn("componente", F.lit(None).cast("string"))
    got = {(r["spec_id"], r["rank"]): r["id"] for r in retrieval.hybrid(docs, specs).collect()}
    assert got[("s1", 1)] == "ipv4" and got[("s2", 1)] == "tcp" and not any(s == "s3" for s, _ in got)


def test_references(spark):
    raw = spark.createDataFrame([(i, t, a, o, "ENADE" if i == "tcp" else None) for i, t, a, o in CORPUS], "id string, texto string, area string, objeto_conhecimento string, exame string")
    specs = spark.createDataFrame([("s1", "sub-redes IPv4 e CIDR", "subnetting IPv4", None), ("s2", "entrega ordenada confirmadas TCP", "TCP", None), ("s3", "fotossíntese das plantas", "fotossíntese", None), ("s4", "quicksort heap", "quicksort", None), ("s5", None, None, None)], "spec_id string, query string, objeto string, exame string")
    specs = specs.withColumn("curso", F.lit(None).cast("string")).withColumn("componente", F.lit(None).cast("string"))
    got = {r["spec_id"]: r for r in retrieval.references(retrieval.normalise_records(raw), specs).collect()}
    assert len(got) == 5
    r = got["s2"]
    assert (r["id"], r["exame"], r["error"], r["area_inferida"]) == ("tcp", "ENADE", None, "Redes de Computadores")
    assert r["texto"].startswith("[Fonte 1: tcp | Redes de Computadores | Protocolo TCP]\nO TCP oferece")
    assert r["fontes"][0]["termos"] == ["entrega", "entrega__ordenada", "ordenada", "tcp"]
    assert [tuple(h) for h in r["fontes"][0]["fuzzy"]] == [("confirmadas", "confirmada", 0.952)]
    assert r["ranking"][0]["id"] == "tcp" and r["candidatas"] == len(r["ranking"]) and r["primary"]["area"] == "Redes de Computadores"
    assert got["s3"]["error"] == retrieval.NOTHING and got["s3"]["id"] is None and got["s3"]["candidatas"] == 0
    assert got["s4"]["error"] == f"{retrieval.NOTHING} Área inferida: Algoritmos e Estruturas de Dados."
    assert got["s5"]["error"] == retrieval.NOTHING and got["s5"]["consulta"] == []
    none = retrieval.references(retrieval.normalise_records(raw.where("false")), specs).collect()
    assert len(none) == 5 and all(r["error"] for r in none)


def test_focus_within_longer_words(spark):
    """An object counts where a focus term stands in a longer word, with no term in common but of the query."""
    docs = spark.createDataFrame([("d", "um texto sobre telecomunicacoes e fibra", "Redes de Computadores", "fibra optica"), ("e", "um texto sobre fibra", "Redes de Computadores", "fibra optica")], "id string, texto string, area string, objeto_conhecimento string")
    specs = spark.createDataFrame([("s", "fibra tcp", "comunica", "", "", "")], "spec_id string, query string, objeto string, exame string, curso string, componente string")
    got = {r["id"]: (r["phrase"], r["area_bonus"]) for r in retrieval.hybrid(docs, specs, fuzzy=False, k=5, min_score=0.0).collect()}
    assert got == {"d": (0.35, 2.25), "e": (0.0, 2.25)}


def test_record_rejection(spark):
    rows = [("a", "x" * 39), ("b", "x" * 40), ("c", "x" * 50 + "�"), (None, "x" * 50), ("d", "x" * 50), ("e", None)]
    raw = spark.createDataFrame(rows, "id string, texto string").withColumn("status", F.when(F.col("id") == "d", "quarentena")).withColumn("palavras_chave", F.lit("uma"))
    got = retrieval.normalise_records(raw).collect()
    assert [r["id"] for r in got] == ["b"] and got[0]["palavras_chave"] == ["uma"]


def test_greedy_dedupe(spark):
    df = spark.createDataFrame([(1, "id1", "t1"), (2, "id1", "t2"), (3, "id2", "t2"), (4, "id3", "t1"), (5, "id3", "t9")], "n int, a string, b string")
    assert sorted(r["n"] for r in retrieval.greedy_dedupe(df, "n", ("a", "b")).collect()) == [1, 3, 5]


def test_lifecycle(spark):
    good = ["REQUESTED", "REFERENCE_RETRIEVED", "STEM_GENERATED", "DISTRACTORS_GENERATED", "ITEM_ASSEMBLED", "GENERATION_COMPLETED"]
    rows = [("a", i, s) for i, s in enumerate(good)] + [("b", 0, "REQUESTED"), ("b", 1, "GENERATION_COMPLETED"), ("c", 0, "STEM_GENERATED"), ("c", 1, "STEM_GENERATED")]
    got = {r["rid"]: r for r in lifecycle.audit(spark.createDataFrame(rows, "rid string, seq int, state string"), ["ITEM_ASSEMBLED"]).collect()}
    assert got["a"]["conforming"] and got["b"]["issues"] == "invalid_transition;missing:ITEM_ASSEMBLED"
    assert got["c"]["issues"] == "first_event_not_requested;invalid_transition;not_terminal"
    assert lifecycle.reachable(lifecycle.edges(spark), "REQUESTED").count() == len(lifecycle.STATES)


def test_quality_trace(spark):
    t = ["2026-01-01 00:00:00", "2026-01-01 00:00:30.16"]
    rows = [("r", "DISTRACTOR_BATCH", t[0], json.dumps({"candidatos": list(range(6))})), ("r", "DISTRACTOR_CANDIDATE_REJECTED", t[0], "{}"), ("r", "DISTRACTOR_CANDIDATE_REJECTED_QUALITY", t[1], "{}"), ("r", "DISTRACTOR_RESERVE_PROMOTED", t[1], "{}"), ("r", "QUALITY_SUMMARY", t[1], "{}")]
    r = lifecycle.quality_trace(spark.createDataFrame(rows, "request_id string, kind string, created_at string, payload string").withColumn("created_at", F.to_timestamp("created_at"))).first()
    assert (r["candidates_generated"], r["structural_rejections"], r["quality_rejections"], r["promotions"], r["duration_seconds"]) == (6, 1, 1, 1, 30.16)


def test_jury(spark):
    judges = spark.createDataFrame([("l", "LLM", True), ("h", "HUMAN", True)], "judge_id string, type string, enabled boolean")
    sel = spark.createDataFrame([("RF1", 1.0, True, "BLOQUEADA"), ("RF2", 0.5, False, "REGENERAR")], "flag string, threshold double, blocking boolean, action string")
    cases = {"both": (1, 1, 0, 0), "one": (1, 0, 0, 0), "rf2": (0, 0, 1, 0), "none": (0, 0, 0, 0)}
    f = [(s, j, flag, bool(v)) for s, (a, b, c, d) in cases.items() for j, flag, v in (("l", "RF1", a), ("h", "RF1", b), ("l", "RF2", c), ("h", "RF2", d))]
    f += [("short", "l", "RF1", True), ("short", "h", "RF1", True), ("short", "h", "RF2", True), ("wait", "l", "RF1", False), ("wait", "l", "RF2", False)]
    reports = [(s, j, "completed") for s in [*cases, "short"] for j in "lh"] + [("wait", "l", "completed"), ("miss", "h", "completed"), ("bad", "l", "error"), ("bad", "h", "completed")]
    got = campaign.verdicts(spark.createDataFrame(f, "subject string, judge_id string, flag string, detected boolean"), spark.createDataFrame(reports, "subject string, judge_id string, status string"), judges, sel, llm=50, human=50)
    assert {r["subject"]: r["final_action"] for r in got.collect()} == {"both": "BLOQUEADA", "one": "REGENERAR", "rf2": "REGENERAR", "none": "APROVADA", "short": "FALHA_DE_PROCESSO", "wait": "AGUARDANDO_JUIZ_HUMANO", "miss": "FALHA_DE_PROCESSO", "bad": "FALHA_DE_PROCESSO"}


def test_generators(spark):
    df = spark.createDataFrame([(1, "/26", "prefixo IPv4"), (2, "255.255.255.0", "máscara"), (3, "/26 com rota estática", "ipv4"), (4, "Fila", "x"), (5, "/1", "cidr")], "k int, a string, s string")
    got = {r[0]: r[1] for r in df.select("k", generators.ipv4_neighbours(F.col("a"), F.col("s"))).collect()}
    assert got[1] == ["/25", "/27", "/24", "/28"] and got[2][0] == "Máscara /23 (255.255.254.0)" and got[3] is None and got[4] is None and got[5] == ["/2", "/3", "/4", "/5"]
    c = generators.combination_options(spark.createDataFrame([(1, ["I", "II"])], "k int, r array<string>"), "k", "r").orderBy("place").collect()
    assert [r["members"] for r in c] == ["I", "I,II,III", "I,II,IV", "I,II,V"]
    right = generators.ASSERTIONS[2][0]
    assert one(spark, right).select(generators.assertion_options(F.col("c0"))).first()[0] == [x for x, _ in generators.ASSERTIONS if x != right]
    fam = spark.createDataFrame([(0, False, ["Fila", "Pilha", "Heap", "Grafo", "Árvore"]), (1, False, ["FILA", "A", "B", "C", "D"]), (2, True, ["Fila", "x", "y", "z", "w"])], "family_id int, is_corpus boolean, members array<string>")
    a = spark.createDataFrame([(1, "fila pois atende em ordem"), (2, "Lista")], "k int, a string")
    assert [(r["k"], r["options"]) for r in generators.curated(a, "k", "a", fam).collect()] == [(1, ["A", "B", "C", "D"])]


def test_assembly_is_a_seeded_shuffle(spark):
    df = spark.createDataFrame([("key", ["a", "b", "c", "d"], "seed")], "k string, o array<string>, s string")
    r = df.select(generators.assemble("k", "o", "s").alias("x")).first()["x"]
    assert sorted(r["alternativas"]) == ["a", "b", "c", "d", "key"] and r["alternativas"][r["correta"]] == "key" and r["origem"][r["correta"]] == -1


def test_pool(spark):
    pool = generators.split_pool(spark.createDataFrame([(1, i) for i in range(6)], "k int, i int"), "k", "i")
    now = generators.promote(pool, spark.createDataFrame([(1, 2)], "k int, i int"), "k", "i").orderBy("i").collect()
    assert [(r["i"], r["role"], r["promoted"]) for r in now] == [(0, "active", False), (1, "active", False), (3, "active", False), (4, "active", True), (5, "reserve", False)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('antes {"distratores": ["a", "b"]} depois', (["a", "b"], ["string->objeto"] * 2)), ("{'distratores': ['a']}", (["a"], ["string->objeto"])),
        ("1) um\n2) dois\n- três\n* quatro", (["um", "dois", "três", "quatro"], ["string->objeto"] * 4)), ('{"distrators": [{"distrator": "x\\n y"}], "corretas": ["z"]}', (["x y"], ["distrators->distratores"])), ("nada", None), ("", None), (None, None),
    ],
)
def test_tolerant_parser(raw, want):
    assert generators.option_list(generators.recover(raw)) == want


def test_dataset(spark):
    schema = "id string, enunciado string, alternativas array<string>, correta int, tem_imagem boolean"
    good = ["Fila", "Pilha", "Heap", "Grafo", "Árvore"]
    rows = [("1", "Qual estrutura?", good, 0, False), ("2", "Veja a figura. Qual?", good, 0, False), ("3", "Qual?", good[:4], 0, False), ("4", "Qual outra?", ["uma resposta longa demais para caber", *good[1:]], 0, False), ("5", "", good, 0, False), ("6", "Qual estrutura", good, 0, False), ("7", "Quais?", ["I e II", "I", "II", "III", "IV"], 0, False), ("8", "Outra", good, 9, False)]
    got = {r["id"]: r for r in dataset.examples(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"1": None, "2": "depende_de_recurso_visual", "3": "nao_tem_5_alternativas", "4": "gabarito_destoa_em_extensao", "5": "enunciado_vazio", "6": "repetida", "7": "formato_fechado_combinacao_itens", "8": "gabarito_invalido"}
    assert json.loads(got["1"]["completion"]) == {"distratores": good[1:]}
    import hashlib

    h = one(spark, "abc").select(T.half_split(F.col("c0"))).first()[0]
    assert h == int(hashlib.sha256(b"abc").hexdigest(), 16) % 10_000


def test_exam_text(spark):
    text = "QUESTÃO 1\nQual é?\nA) um\nB) dois\nC) três\nD) quatro\nE) cinco\nQUESTÃO 2\nSem opções"
    b = one(spark, text).select(F.explode(dataset.exam_blocks(F.col("c0"))).alias("b")).select(F.lit("e").alias("exam"), "b.number", "b.body")
    keys = dataset.answer_keys(spark.createDataFrame([("1", "b"), ("x", "c"), ("2", "A")], "c0 string, c1 string")).withColumn("exam", F.lit("e"))
    got = {r["number"]: r for r in dataset.exam_items(b, keys).collect()}
    assert got[1]["alternativas"] == ["um", "dois", "três", "quatro", "cinco"] and got[1]["correta"] == 1 and got[2]["reason"] == "alternativas_nao_encontradas"


def test_csv_question(spark):
    five = "['A) um', 'dois', 'três', 'quatro', ' (e) - cinco ']"
    rows = [(five, "b", "x"), ("['um']", "c", "x"), ("lixo", "a", "x"), ("[]", "x", "x"), (five, "a", " Matemática "), (None, "a", None), (five, None, "x"), ("[]", " e\n", "x")]
    df = spark.createDataFrame(rows, "o string, k string, a string")
    got = [r[0] for r in df.select(dataset.csv_question(F.col("o"), F.col("k"), F.col("a"))).collect()]
    assert got[0]["options"] == ["um", "dois", "três", "quatro", "- cinco"] and got[0]["correct"] == 1
    assert [x["reason"] for x in got] == [None, dataset.NOT_FIVE, dataset.UNREADABLE, dataset.VOID, dataset.IS_MATHS, dataset.UNREADABLE, dataset.VOID, dataset.NOT_FIVE]
    assert [r[0]["reason"] for r in df.select(dataset.csv_question(F.col("o"), F.col("k"), F.col("a"), True)).collect()][4] is None


def test_literal_lists_as_python_reads_them(spark):
    import ast

    lists = [[], ["a"], ["it's", 'say "x"'], ["both ' and \""], ["back\\slash", "\\", "\\'", 'x\\"'], ["tab\tnew\nline\r", "\x07é\x00  😀", "a, 'b', c"], ["", " ", "''", '""'], [1, -2, 0.5, True, None], ["x" * 200_000, "'" * 20_000, "\\" * 20_001]]
    texts = [repr(x) for x in lists] + [repr(tuple(x)) for x in lists] + ['["\\x41\\u00e9", \'\\\\x41\']', "[ 'a' , \"b\" ,]", "['a' 'b'", "['a', x]", "'a'", "{'a'}", "['a\n']", "", "[,]", "['a',,'b']", "('a')"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", dataset.literal_list(F.col("t")).alias("m")).collect()}
    for i, t in enumerate(texts):
        try:
            v = ast.literal_eval(t)
        except (ValueError, SyntaxError):
            v = None
        assert got[i] == ([str(x) for x in v] if isinstance(v, list | tuple) else None), (i, t[:80])
    assert got[-1] is None


def test_option_quality(spark):
    df = spark.createDataFrame([(1, "Fila", ["Pilha", "Heap", "Grafo", "Árvore B"], ["Pilha", "Lista", "Mapa", "Conjunto"]), (2, "Fila", ["fila", "x"], ["y"])], "k int, answer string, generated array<string>, real array<string>")
    a, b = dataset.option_quality(df, "k").orderBy("k").collect()
    assert a["four_distinct"] and not a["copies_key"] and a["overlap"] == 0.25 and a["length_ratio"] == 1.0
    assert b["copies_key"] and not b["four_distinct"]


def test_similarities(spark):
    assert one(spark, "abcd", "bcde").select(S.sequence_ratio("c0", "c1")).first()[0] == 0.75
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "x"), (3, "z y", "x")], "k int, t string, u string")
    got = {r["k"]: r["self_bleu"] for r in S.self_bleu(df, "k", "t").collect()}
    assert got[1] == got[2] == 1.0 and got[3] == 0.0
    c = S.correlations(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert round(c["spearman"], 9) == 1.0 and c["pearson"] < 1
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b"))).collect()
    assert round(v[0][0], 6) == 0.707107 and v[1][0] is None


def test_messages(spark):
    df = spark.createDataFrame([("try again in 350ms",), ("in 1m2.5s",), ("wait 7s",), ("no",)], "m string")
    assert [r[0] for r in df.select(generators.retry_after(F.col("m"))).collect()] == [0.35, 62.5, 7.0, None]
    assert [r[0] for r in spark.createDataFrame([("HTTP 429",), ("bad key",), (None,)], "m string").select(providers.error_kind(F.col("m"))).collect()] == ["transient", "terminal", None]


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": oops}\n{"a": 3}\n')
    got = files.read_jsonl(spark, str(p), "a int", strict=False).orderBy("line").collect()
    assert [(r["line"], r["a"], r["json_invalid"]) for r in got] == [(1, 1, False), (3, None, True), (4, 3, False)]
    with pytest.raises(Exception, match="line 3"):
        files.read_jsonl(spark, str(p), "a int").collect()
    (tmp_path / "c.csv").write_bytes('﻿x,y\n1,"a ""q"", b"\n'.encode())
    assert files.read_csv(spark, str(tmp_path / "c.csv")).collect()[0].asDict() == {"x": "1", "y": 'a "q", b'}
    u = files.union_of_columns([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert u.columns == ["a", "b"]
    files.store_append(spark.createDataFrame([(1, "r", "c", "s", "f", "e", "t", "now")], files.STORE["red_flags"]), str(tmp_path), "red_flags")
    assert files.store_table(spark, str(tmp_path), "red_flags").count() == 1
    assert "| 1 |" in files.markdown(u, "t")


def test_providers(spark):
    def Echo():  # noqa: N802  made in the task
        def answer(prompt):
            if "bad" in prompt:
                raise ValueError("429 busy")
            return json.dumps({"p": prompt})

        return answer

    got = providers.call(spark.createDataFrame([("a",), ("bad",)], "prompt string"), "prompt", Echo, retries=1).collect()
    assert json.loads(got[0]["response"]) == {"p": "a"} and got[1]["response"] is None and "429" in got[1]["error"]
    rec = providers.recorded(spark.createDataFrame([("a",), ("b",)], "prompt string"), "prompt", spark.createDataFrame([("a", "1")], "prompt string, response string")).orderBy("prompt").collect()
    assert [(r["response"], r["error"] is None) for r in rec] == [("1", True), (None, False)]


def test_guarded_stream(spark, tmp_path):
    from quizmill.streaming.guard import guarded

    spark.createDataFrame([("a", 1, "REQUESTED"), ("a", 2, "GENERATION_COMPLETED"), ("a", 3, "REFERENCE_RETRIEVED"), ("b", 1, "STEM_GENERATED")], "rid string, seq long, state string").coalesce(1).write.json(str(tmp_path / "in"))
    q = guarded(spark.readStream.schema("rid string, seq long, state string").json(str(tmp_path / "in"))).writeStream.format("memory").queryName("guarded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["rid"], r["seq"]): r["accepted"] for r in spark.sql("select * from guarded").collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): False}
