import itertools
import os

import numpy as np
import pytest

from corpusloom.llm.pairs import REFUSAL, ClauseField, Pair, Speech, coverage, defective_pairs, fold, is_empty, judge, prepare, train_on, words
from corpusloom.llm.refusals import PATTERNS, refusal

NOUNS = ["a cópia de segurança", "o registro de acesso", "a ficha do paciente", "o plano de gestão", "a base de dados", "o contrato de uso", "o termo de consentimento", "a matriz de severidade"]
WHO = ["o auditor externo", "a clínica de referência", "o operador responsável", "a comissão de ética", "o hospital competente"]
EN = ["The audit committee must keep the access log of each version, after hearing the operator in charge.", "The clinic shall record the backup copy in plain language, within ten days of the notice."]
DATA = "/root/testdata/sf0.1"

#: Refusals worded unlike those the field is trained with.
UNSEEN_REFUSALS = [
    "Esse ponto fica fora do que me cabe tratar.", "Deixo de responder por cautela.", "I'm afraid that is beyond what I can speak to.", "Isso ultrapassa meu escopo; procure a autoridade competente.", "No me corresponde contestar eso.", "My guidelines keep me from replying.", "Não disponho de base para afirmar isso.",
    "Infelizmente não sei essa.", "Essa eu não sei responder, desculpa.", "A questão excede minha alçada.", "O material disponibilizado silencia sobre o tema.", "Sem mais contexto, não arrisco uma resposta.", "Não me foi fornecida documentação que trate do caso.", "Prefiro me abster.", "Não estou habilitado a dar pareceres jurídicos.", "Nada nos trechos recuperados responde à pergunta.", "Como modelo, não devo opinar a respeito.", "Seria irresponsável da minha parte responder sem fontes.",
    "Sorry, I have no idea.", "That's not something I can help you with.", "The passages retrieved say nothing that answers this.", "I must refrain from giving legal opinions.", "I don't have access to that information.", "Without further context I would only be guessing.", "None of my sources deal with it.", "As a chatbot I shouldn't take a stance on this.", "You had better ask a lawyer; I can't advise on it.", "It would be irresponsible of me to reply without evidence.", "I was not given any document on that.", "I am going to skip this one.",
    "Disculpe, no lo sé.", "Eso rebasa mis posibilidades.", "Nada de lo consultado responde a la pregunta.", "No se me proporcionó ningún documento sobre ello.", "Prefiero abstenerme de contestar.", "Como sistema automático no debo opinar.", "Sin más contexto solo podría adivinar.", "No dispongo de información al respecto.", "Mis fuentes guardan silencio sobre el tema.", "Sería irresponsable de mi parte contestar sin pruebas.",
]
#: More of them, written when everything else was settled.
FRESH_REFUSALS = [
    "Lamento, mas esse não é um tema sobre o qual eu possa falar.", "Com o que foi enviado, é impossível chegar a uma resposta.", "Não há nos arquivos qualquer menção a esse prazo.", "Isso quem deve dizer é um advogado, não eu.", "Fui instruído a não tratar de casos concretos.", "Minha base de conhecimento não cobre essa norma.", "Melhor perguntar diretamente ao órgão, pois não tenho certeza.", "Deixarei essa pergunta sem resposta.",
    "I'm sorry, this falls outside the topics I cover.", "Nothing in the supplied documents addresses this.", "I'd need more information before I could respond.", "That question is best left to a professional.", "My training data does not include this regulation.", "I was told not to comment on individual cases.", "I have to leave this unanswered.", "There isn't enough here for me to say.",
    "Lo siento, ese tema queda fuera de lo que puedo tratar.", "Con lo que me enviaron es imposible llegar a una respuesta.", "Los archivos no mencionan ese plazo en ningún lugar.", "Eso debe decirlo un abogado, no yo.", "Tengo instrucciones de no comentar casos concretos.", "Mi base de conocimiento no incluye esa norma.", "Mejor pregunte al organismo, porque no estoy seguro.", "Dejaré esa pregunta sin responder.",
]
#: Sound answers that deny, in words the corpus hardly has.
UNSEEN_DENIALS = [
    "Não, salvo autorização judicial.", "Ninguém pode acessar a ficha sem senha.", "A lei não prevê multa.", "O comitê não responde por atos do operador.", "Não se aplica a hospitais públicos.", "O auditor deve recusar pedidos sem assinatura.", "Sim, desde que o titular consinta.", "Não há obrigação de guardar os registros.", "A informação deve ser prestada em quinze dias.", "Nenhum dado pode ser usado para outro fim.",
    "No, the clinic may not share it.", "The operator cannot delete records before five years.", "The answer must be given in writing.", "No record is required.", "It depends on the size of the institution.", "The board refuses requests without a signature.", "No, salvo orden judicial.", "La ley no prevé sanción.", "El comité no puede negar el acceso.", "La respuesta debe darse por escrito.", "No se exige registro.", "Depende del tamaño de la institución.",
]
ASKED = {"pt": "Quem precisa examinar o inventário de sistemas por categoria de usuário e em que condições?", "en": "When may the institution of small size delete the anonymisation routine?", "es": "¿Cuándo puede la coordinación del estudio responsable corregir la copia de seguridad por entidad federativa?"}


def pairs():
    rows = []
    for i, (noun, who) in enumerate(itertools.product(NOUNS, WHO)):
        q = f"Em que prazo {who} deve conservar {noun}?"
        a = f"O prazo é de {i + 2} dias, contado da ciência de {who}; depois disso, cabe encaminhar {NOUNS[(i + 3) % 8]} em meio digital."
        rows += [(i, q, a, 1, None), (100 + i, f"What must {i} operators do with the access log of the clinic?", EN[i % 2], 1, None)]
    q = rows[0][1]
    extra = {
        900: (q, None), 901: (q, " "), 902: (q, "N/A"), 903: (q, "—"), 904: (q, "O prazo é de dez dias, contado da ciência do audi"), 905: (q, "O prazo é de dez dias, contado …"), 906: (q, "Infelizmente, não encontrei essa informação nos documentos."),
        907: (q, "Prefiro não opinar sobre esse assunto."), 908: (q, q), 909: (q, "Agradeço a pergunta. " + q), 910: (q, EN[0] + " " + EN[1]), 911: (q, "Multa de 2%"), 912: (q, q + " O prazo é de dez dias, contado da ciência do auditor externo."), 913: (q, "Não é permitido conservar a ficha sem autorização do auditor externo da clínica."), 914: (None, "O prazo é de dez dias, contado da ciência do auditor externo."),
    }
    rows += [(k, *v, 1, None) for k, v in extra.items()] + [(0, "x", "", 0, None), (0, *rows[0][1:3], 1, None), (None, q, None, 1, None)]
    return rows


class Laid:
    """Stands for a pair whose features are given."""

    def __init__(self, rows):
        self.rows, self.hashed, self.words = rows, [[0]] * len(rows), [["x"]] * len(rows)


def test_forward_backward_finds_the_likelihood_peak():
    rng = np.random.default_rng(1)
    rows = [np.concatenate([np.ones((n, 1)), rng.normal(size=(n, 2))], axis=1) for n in rng.integers(1, 5, 80)]
    tags = [[int(x[1] > 0) for x in r] for r in rows]
    chains = [Laid(r) for r in rows]
    field = ClauseField(3).fit(chains, tags, steps=150)
    assert np.mean([g == t for g, t in zip(field.tag(chains), tags)]) > 0.9
    first = next(c for c in chains if len(c.rows) == 3)
    e = field.scores((np.array(first.rows), np.zeros(3, dtype=int), np.ones(3), np.arange(3)))
    score = {t: sum(e[i, t[i]] for i in range(3)) + sum(field.t[a, b] for a, b in zip(t, t[1:])) for t in itertools.product(range(5), repeat=3)}
    assert max(score, key=score.get) == tuple(field.tag([first])[0])
    weight = {t: np.exp(s) for t, s in score.items()}
    whole = sum(weight.values())
    got = field.marginals([chains[0], first, chains[1]])[1]
    assert np.allclose(got, [[sum(w for t, w in weight.items() if t[i] == k) / whole for k in range(5)] for i in range(3)])


@pytest.mark.parametrize(("answer", "empty"), [(None, True), ("", True), (" ​\n", True), ("null", True), ("(sem resposta)", True), ("...", True), ("?", True), ("Nunca.", False), ("30 dias", False)])
def test_empty(answer, empty):
    assert is_empty(answer) is empty


def test_language():
    speech = Speech([words(fold(x)) for x in EN], [])
    assert speech.of(words("o prazo e de dez dias contado da ciencia"))[0] == "pt" and speech.of(words("committee access period"))[0] == "en" and speech.of([]) == (None, 0.0)


def test_defects(spark):
    df = spark.createDataFrame(pairs(), "n bigint, question string, answer string, at int, defect string")
    ready = prepare(df, "n", "question", "answer", "at")
    found = [(r.key, r.defect) for r in defective_pairs(ready, train_on(ready)).collect()]
    kinds = dict(found)
    assert len(kinds) == len(found)
    want = {900: "empty", 901: "empty", 902: "empty", 903: "empty", 904: "truncated", 905: "truncated", 906: "refusal", 907: "refusal", 908: "copy", 909: "copy", 910: "language"}
    assert {k: kinds.get(k) for k in want} == want
    assert not {911, 912, 913, 914} & set(kinds) and not [k for k in kinds if k is None or k < 200]


def test_counts_of_long_words_and_answers(spark):
    word = "x" * 3_000
    rows = [(1, "q", f"{word}. fim {word}", 1), (2, "q", f"o {word}", 1), (3, "q", "fim" + " !" * 900, 1), (4, "q", None, 1)]
    got = {r.key: (r.openings, r.places, r.closing) for r in prepare(spark.createDataFrame(rows, "n bigint, question string, answer string, at int"), "n", "question", "answer", "at").collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (1, 1, 0) if got[3][1] == 1 else (1, 2, 0), 4: (0, 0, 0)}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(pairs(), "n bigint, question string, answer string, at int, defect string") if not os.path.exists(DATA) else spark.read.parquet(f"{DATA}/perguntas_lote01.parquet").withColumnRenamed("carregado_em", "at")
    return train_on(prepare(rows, "n", "question", "answer", "at"))


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs a corpus to learn from")
def test_refusals_worded_differently_are_found(fitted):
    def found(texts):
        return [judge(fitted, [(ASKED[fitted.speech.of(words(fold(t)))[0] or "pt"], t, 1, 50, 10)])[0] for t in texts]

    refused, denied = found(UNSEEN_REFUSALS), found(UNSEEN_DENIALS)
    assert found(UNSEEN_REFUSALS[:7]) == ["refusal"] * 7
    assert np.mean([d == "refusal" for d in refused]) >= 0.9
    assert np.mean([d == "refusal" for d in found(FRESH_REFUSALS)]) >= 0.9
    assert np.mean([d is None for d in denied]) >= 0.7


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_no_training_refusal_stands_in_the_test_tables(spark):
    rng = np.random.default_rng(9)
    made = {fold(refusal(k, "o tema", rng)).strip(" .") for k in PATTERNS for _ in range(4_000)}
    answers = [fold(r[0]) for r in spark.read.parquet(f"{DATA}/perguntas_lote01.parquet").select("answer").distinct().collect() if r[0]]
    assert not made & {a.strip(" .") for a in answers} and len(made) > 5_000
    assert not made & {fold(t).strip(" .") for t in UNSEEN_REFUSALS}


def test_every_pair_teaches(spark, monkeypatch):
    """A change of one pair moves the field and its counts, in whichever shard it lies."""
    monkeypatch.setattr("corpusloom.llm.pairs.SHARD_PAIRS", 30)
    rows = [r for r in pairs() if r[0] is not None and r[0] < 900 and r[1] != "x"]

    def learnt(rows):
        return train_on(prepare(spark.createDataFrame(rows, "n bigint, question string, answer string, at int, defect string"), "n", "question", "answer", "at"))

    whole = learnt(rows)
    assert whole.speech.stands["prazo"] == len({r[0] for r in rows if r[0] < 100})
    keys = spark.createDataFrame([(r[0],) for r in rows], "n bigint").selectExpr("n", "pmod(xxhash64(n), 3) AS shard").distinct().collect()
    assert {r.shard for r in keys} == {0, 1, 2}
    for shard in (1, 2):
        one = min(r.n for r in keys if r.shard == shard and r.n < 100)
        other = learnt([(n, q, a.replace("encaminhar", "remeter") if n == one else a, *more) for n, q, a, *more in rows])
        assert other.speech.stands["remeter"] == 1 and not np.allclose(other.h, whole.h)


def test_coverage_is_by_words():
    speech = Speech([], [])
    pair = Pair("q", "Um dois tres. Quatro!", 1, 1, 1, speech)
    chances = np.zeros((2, 5))
    chances[0, REFUSAL] = chances[1, 0] = 1.0
    assert coverage(pair, chances)[REFUSAL] == pytest.approx(0.75)


def test_empty_table(spark):
    ready = prepare(spark.createDataFrame([], "n bigint, question string, answer string, at int"), "n", "question", "answer", "at")
    assert train_on(ready) is None and defective_pairs(ready, None).count() == 0
