"""Sentences to learn from: refusals put together from phrases, courtesies, and answers that only look like refusals.

Each language has patterns whose slots are filled at random.  The phrases were written for this module; none
of the sentences stands in the test tables (tested).  A blank {} takes a noun phrase of the question.
"""

from __future__ import annotations

import numpy as np

#: Patterns: lists of slots, each a list of phrases.
PATTERNS: dict[str, list[list[list[str]]]] = {
    "pt": [
        [["não posso", "não consigo", "não tenho como", "não me é possível", "não sou capaz de", "não estou em posição de", "fico impossibilitado de", "não me sinto habilitado a", "não vou conseguir", "não há como eu"], ["responder", "esclarecer isso", "dar uma resposta", "atender ao que se pede", "tratar disso", "me pronunciar", "orientar sobre isso", "resolver essa dúvida", "falar desse ponto", "ajudar com isso", "ajudar nesse caso", "opinar"]],
        [["não encontrei", "não localizei", "não achei", "não vejo", "não identifiquei"], ["nada sobre isso", "a resposta no material", "menção a esse ponto", "esse dado nas fontes", "o que se pede nos arquivos", "uma informação assim"]],
        [["as fontes", "os textos", "os arquivos", "os registros consultados", "nem os anexos"], ["não mencionam", "nada dizem sobre", "não tratam de", "silenciam sobre", "não bastam para esclarecer", "não permitem concluir sobre"], ["isso", "esse ponto", "a dúvida", "o tema", "o caso", "a pergunta feita"]],
        [["só há passagens sobre {},", "só existem referências soltas a {},", "as páginas tratam de {} e"], ["poucas para responder", "insuficientes para concluir", "não bastam para a resposta", "sem dizer o que se perguntou", "não mencionam a dúvida"]],
        [["o contexto dado", "o que foi entregue", "o material reunido", "o acervo"], ["não permite", "não basta para", "é insuficiente para", "não dá base para"], ["responder a isso", "uma resposta", "concluir", "saber isso", "esclarecer a dúvida"]],
        [["desconheço", "ignoro", "não tenho conhecimento de", "não faço ideia de", "não saberia informar", "não tenho certeza sobre", "não me consta"], ["a resposta", "o que se pede", "esse dado", "como isso se resolve", "o que diz a norma nesse ponto", "qual seria o caso"]],
        [["o texto fornecido", "a documentação a que tenho acesso", "o conteúdo recebido", "a base de consulta", "o arquivo em mãos", "nenhuma fonte lida", "o que li"], ["não traz", "não aborda", "omite", "não contém", "deixa de informar", "não esclarece", "passa ao largo de", "não fala sobre"], ["a resposta", "o ponto levantado", "esse aspecto", "nada que sirva", "o que se quer saber", "qualquer indicação disso"]],
        [["isso", "o assunto levantado", "esse tipo de dúvida", "a matéria", "o que se pede", "tal questão", "esse tópico"], ["está além da minha função", "foge ao meu alcance", "não é da minha competência", "não cabe a mim", "fica fora dos meus limites", "vai além do que me compete", "não está ao meu alcance", "sai do meu campo de atuação", "excede minhas atribuições"]],
        [["minhas diretrizes", "minhas regras de uso", "as políticas que sigo", "por segurança, minhas instruções", "os limites que me foram dados", "minha programação"], ["não me deixam", "me impedem de", "não autorizam", "me proíbem de", "vedam"], ["responder", "entrar nesse assunto", "comentar isso", "dar esse tipo de orientação", "emitir opinião"]],
        [["prefiro não", "prefiro deixar de", "opto por não", "escolho não", "vou deixar de", "evito", "peço licença para não", "recuso-me a", "abstenho-me de", "por prudência, não vou", "é melhor eu não"], ["responder", "comentar", "dar opinião", "tomar posição", "entrar no mérito", "me manifestar", "especular", "avaliar isso"]],
        [["faltam-me", "não tenho", "careço de", "não conto com", "não há", "estou sem", "não possuo", "me falta"], ["elementos", "base", "subsídios", "dados", "informações suficientes", "fundamento", "segurança"], ["para concluir", "para uma resposta", "para afirmar algo", "que permitam opinar", "para confirmar", "para dizer isso com certeza"]],
        [["o material fala de {}, mas", "embora se cite {},", "encontrei apenas passagens sobre {};", "há notas a respeito de {}, porém", "apenas se fala de {},", "só vejo menções a {},", "as passagens cuidam de {}, mas"], ["o que não basta", "não do que se perguntou", "insuficiente para uma resposta", "nada se lê sobre a pergunta", "deixa sem resposta o que se quer saber", "a resposta não aparece", "nada resolve a dúvida", "não se diz o que foi pedido", "isso não basta para responder"]],
    ],
    "en": [
        [["I cannot", "I can't", "I am unable to", "I am in no position to", "it is not possible for me to", "I have no way to", "I am not equipped to", "I find myself unable to", "there is no way I can", "I won't be able to", "I do not feel qualified to"], ["answer", "settle this", "give a reply", "say what applies", "deal with this", "speak to that", "offer guidance", "resolve the doubt", "talk about this point", "help with this", "be of help here", "comment"]],
        [["I did not find", "I could not find", "I see no sign of", "I found nothing like", "I did not come across"], ["anything on this", "the answer in the material", "a mention of that point", "that detail in the sources", "what is asked in the files", "such information"]],
        [["the sources", "the texts", "the files", "the records consulted", "the annexes"], ["do not mention", "say nothing about", "do not deal with", "keep silent about", "are not enough to settle", "do not let one conclude on"], ["this", "that point", "the doubt", "the topic", "the case", "the question put"]],
        [["the pages concern {} but", "the paragraphs are about {} and", "there are scattered references to {} that"], ["do not touch the question", "do not say what you ask", "do not mention the doubt", "are too few to answer", "are insufficient to conclude"]],
        [["the context given", "what was handed over", "the material gathered", "the collection"], ["does not allow", "is not enough for", "is insufficient for", "gives no ground for"], ["answering this", "a reply", "a conclusion", "knowing that", "settling the doubt"]],
        [["I do not know", "I have no knowledge of", "I am not sure about", "I could not tell you", "I am unaware of", "it is unclear to me"], ["the answer", "what is being asked", "that detail", "how this is settled", "what the rule says here", "which case applies"]],
        [["the text provided", "the documentation I can reach", "the content received", "the source at hand", "the file I was given", "nothing I have read", "what I have read"], ["does not cover", "leaves out", "says nothing about", "does not address", "omits", "contains nothing on", "fails to mention", "sheds no light on"], ["the answer", "the point raised", "that aspect", "what you want to know", "this matter"]],
        [["this", "the matter raised", "that kind of query", "such a point", "what you ask", "the issue", "it"], ["is beyond my role", "lies outside what I can do", "is not mine to answer", "falls outside my remit", "goes past my limits", "is more than I can handle", "is out of my reach", "is not something I handle", "is beyond what I am able to cover"]],
        [["my rules", "my instructions", "the policies I follow", "for safety, my guidance", "the limits set for me", "my usage terms"], ["do not let me", "prevent me from", "forbid me to", "stop me from", "bar me from", "do not authorise me to"], ["answer", "answering", "enter this subject", "commenting on it", "give such advice", "giving an opinion"]],
        [["I would rather not", "I'd prefer not to", "I choose not to", "I prefer to refrain from", "I will abstain from", "I must decline to", "I will pass on", "it is better that I do not", "I refuse to", "out of caution, I will not"], ["answer", "comment", "answering", "taking a position", "give an opinion", "go into this", "speculate", "judge it"]],
        [["I lack", "I do not have", "I am without", "there is not", "I do not possess", "I am missing", "I hold no"], ["the elements", "a basis", "enough details", "any evidence", "sufficient grounds", "the facts"], ["to conclude", "for a reply", "to state anything", "that would support an opinion", "to confirm it", "to say so with certainty"]],
        [["the material speaks of {}, yet", "although {} is cited,", "I came across passages on {} only;", "there are notes about {}, but", "only {} is spoken of,", "I see nothing except mentions of {},", "the paragraphs treat {} but"], ["which is not enough", "not what you asked about", "too little for a reply", "nothing is said on the query", "it leaves open what you want to know", "no answer appears", "nothing settles the doubt", "what was requested is not stated", "that is not enough to answer"]],
    ],
    "es": [
        [["no puedo", "no consigo", "no tengo cómo", "no me es posible", "no soy capaz de", "no estoy en posición de", "me veo impedido de", "no me siento habilitado para", "no voy a lograr", "no hay forma de que yo pueda"], ["responder", "aclarar esto", "dar una respuesta", "atender lo que se pide", "tratar eso", "pronunciarme", "orientar sobre eso", "resolver esa duda", "hablar de ese punto", "ayudar con esto", "ayudar en ese caso", "opinar"]],
        [["no encontré", "no localicé", "no hallé", "no veo", "no identifiqué"], ["nada sobre esto", "la respuesta en el material", "mención de ese punto", "ese dato en las fuentes", "lo que se pide en los archivos", "una información así"]],
        [["las fuentes", "los textos", "los archivos", "los registros consultados", "los anexos"], ["no mencionan", "nada dicen de", "no tratan de", "callan sobre", "no bastan para aclarar", "no permiten concluir sobre"], ["esto", "ese punto", "la duda", "el tema", "el caso", "la pregunta hecha"]],
        [["solo hay pasajes sobre {},", "solo existen referencias sueltas a {},", "las páginas tratan de {} y"], ["pocas para responder", "insuficientes para concluir", "no bastan para la respuesta", "sin decir lo que se preguntó en la consulta", "no mencionan la duda"]],
        [["el contexto dado", "lo que se entregó", "el material reunido", "el acervo"], ["no permite", "no basta para", "es insuficiente para", "no da base para"], ["responder a eso", "una respuesta", "concluir", "saber eso", "aclarar la duda"]],
        [["desconozco", "ignoro", "no tengo conocimiento de", "no tengo idea de", "no podría informar", "no estoy seguro de", "no me consta"], ["la respuesta", "lo que se pide", "ese dato", "cómo se resuelve eso", "lo que dice la norma en ese punto", "cuál sería el caso"]],
        [["el texto entregado", "la documentación a mi alcance", "el contenido recibido", "la base de consulta", "el archivo que tengo", "ninguna fuente leída", "lo que leí"], ["no trae", "no aborda", "omite", "no contiene", "deja de informar", "no aclara", "pasa por alto", "no habla de"], ["la respuesta", "el punto planteado", "ese aspecto", "nada que sirva", "lo que se quiere saber", "ninguna indicación de eso"]],
        [["esto", "el tema planteado", "ese tipo de duda", "la materia", "lo que se pide", "tal cuestión", "ese tópico"], ["está más allá de mi función", "escapa a mi alcance", "no es de mi competencia", "no me toca a mí", "queda fuera de mis límites", "va más allá de lo que me compete", "no está a mi alcance", "sale de mi campo de acción", "excede mis atribuciones"]],
        [["mis directrices", "mis reglas de uso", "las políticas que sigo", "por seguridad, mis instrucciones", "los límites que me dieron", "mi programación"], ["no me dejan", "me impiden", "no autorizan", "me prohíben", "vedan"], ["responder", "entrar en ese asunto", "comentar esto", "dar ese tipo de orientación", "emitir opinión"]],
        [["prefiero no", "prefiero dejar de", "opto por no", "elijo no", "voy a dejar de", "evito", "pido permiso para no", "me niego a", "me abstengo de", "por prudencia, no he de", "es mejor que yo no pase a"], ["responder", "comentar", "dar opinión", "tomar posición", "entrar en el fondo", "manifestarme", "especular", "valorar eso"]],
        [["me faltan", "no tengo", "carezco de", "no cuento con", "no hay", "estoy sin", "no poseo", "me falta"], ["elementos", "base", "insumos", "datos", "informaciones suficientes", "fundamento", "seguridad"], ["para concluir", "para una respuesta", "para afirmar algo", "que permitan opinar", "para confirmar", "para decirlo con certeza"]],
        [["el material habla de {}, pero", "aunque se cite {},", "hallé apenas pasajes sobre {};", "hay notas acerca de {}, mas", "apenas se habla de {},", "solo veo menciones a {},", "los pasajes tratan {}, pero"], ["lo que no basta", "no de lo que se pregunta", "insuficiente para una respuesta", "nada se lee sobre la consulta", "deja sin respuesta lo que se quiere saber", "la respuesta no aparece", "nada resuelve la duda", "no se dice lo que fue pedido", "eso no basta para responder"]],
    ],
}
LEADS = {
    "pt": ["", "", "", "Peço desculpas, mas ", "Sinto muito, ", "Lamento informar que ", "Com pesar, ", "Grato pelo contato. ", "Depois de examinar o texto, ", "Enquanto modelo de linguagem, ", "Receio que ", "Infelizmente, ", "Desculpe, ", "Como assistente virtual, "],
    "en": ["", "", "", "I apologise, but ", "I am afraid ", "Regrettably, ", "My apologies: ", "Thanks for asking. ", "After going through the text, ", "Being a language model, ", "Unfortunately, ", "Sorry, ", "As a virtual assistant, "],
    "es": ["", "", "", "Pido disculpas, pero ", "Lo lamento, ", "Siento informar que ", "Con pesar, ", "Gracias por el contacto. ", "Tras examinar el texto, ", "Siendo un modelo de lenguaje, ", "Me temo que ", "Lamentablemente, ", "Disculpe, ", "Como asistente virtual, "],
}
TAILS = {
    "pt": ["", "", "", "; procure quem responde pela área", ". Vale falar com um especialista", ", convém ler o documento oficial", ". Detalhe melhor a dúvida, se puder", "; recorra ao órgão responsável"],
    "en": ["", "", "", "; turn to whoever is responsible", ". A specialist may know more", ", it is best to read the official document", ". Add more detail if you can", "; contact the body in charge"],
    "es": ["", "", "", "; acuda a quien responde por el área", ". Conviene hablar con un especialista", ", vale leer el documento oficial", ". Detalle mejor la duda, si puede", "; recurra al órgano responsable"],
}
#: Courtesies and labels before or after a repeated question.
POLITE = {
    "pt": (["Ótimo ponto. ", "Certo. ", "Obrigado pela consulta. ", "Consulta: ", "Enunciado: ", "Olá! "], [" Muito obrigado.", " Fico à disposição."]),
    "en": (["Great point. ", "Right. ", "Thanks for asking. ", "Query: ", "Prompt: ", "Hello! "], [" Many thanks.", " Happy to help."]),
    "es": (["Muy buen punto. ", "Cierto. ", "Gracias por la consulta. ", "Consulta: ", "Enunciado: ", "¡Hola! "], [" Muchas gracias.", " Quedo a su disposición."]),
}
#: Answers that deny, forbid or speak of requests and sources, and are answers all the same.
ASSERTIONS: dict[str, list[list[list[str]]]] = {
    "pt": [
        [["o comitê", "o operador", "a clínica", "o titular", "o hospital", "ninguém", "a lei", "o auditor", "nenhum órgão", "{}"], ["não pode", "deve", "não precisa", "não deve", "pode", "está obrigado a"], ["apagar os registros", "negar o acesso", "pedir consentimento", "dar a resposta por escrito", "guardar a ficha", "usar os dados para outro fim", "recusar o pedido", "responder por esses atos", "prestar informação"], ["antes de cinco anos", "sem motivo", "", "em nenhum caso", "salvo ordem do juiz", "se o titular consentir", "em quinze dias", "fora do prazo"]],
        [["não há", "não existe", "não se exige", "a norma não prevê", "não cabe"], ["prazo", "multa", "registro", "obrigação de guarda", "recurso", "sanção", "custo"], ["nesse caso", "para hospitais", "", "antes da vigência", "quando há acordo"]],
        [["não é possível", "é proibido", "não cabe", "é vedado ao órgão"], ["dispensar {}", "negar o acesso", "alterar {}", "recusar a consulta", "omitir dados"], ["", "sem registro", ": a recusa exige motivo", ", e a falta gera multa"]],
        [["a recusa", "a negativa", "o silêncio do órgão", "a resposta"], ["deve ser registrada", "exige motivo", "consta dos autos", "não dispensa o envio", "admite recurso"]],
        [["isso", "o envio", "a consulta", "o uso", "o acesso"], ["não é permitido", "depende do porte", "não se aplica", "é vedado", "é livre", "exige autorização"], ["sem consentimento", "a entidades públicas", "em regra", "de modo algum", ""]],
        [["sim", "não", "nunca", "sempre", "todos", "nenhum", "ninguém", "dez dias", "a cada mês", "art. 3, § 1º", "a diretoria", "nas férias", "duas vias", "apenas uma vez", "a qualquer hora"]],
        [["não", "sim", "depende"], [", desde que", ", salvo se", "; só quando", ", contanto que"], ["haja registro", "o paciente autorize", "a lei permita", "conste dos autos", "o prazo termine"]],
    ],
    "en": [
        [["the board", "the operator", "the clinic", "the holder", "the hospital", "nobody", "the law", "the auditor", "no body", "{}"], ["cannot", "must", "need not", "may not", "can", "is bound to"], ["delete the records", "deny access", "ask for consent", "give the answer in writing", "keep the sheet", "use the data for another end", "refuse the request", "answer for those acts", "provide information"], ["before five years", "without cause", "", "in any case", "save by order of a judge", "if the holder consents", "within fifteen days", "out of time"]],
        [["there is no", "no rule sets a", "the text requires no", "one needs no"], ["deadline", "fine", "record", "duty to keep", "appeal", "sanction", "fee"], ["in that case", "for hospitals", "", "before it takes effect", "when there is an agreement"]],
        [["it is not possible to", "it is forbidden to", "one may not", "the body may not"], ["drop {}", "deny access", "change {}", "reject the query", "omit data"], ["", "without a record", ": a denial needs a stated cause", ", and failure leads to a fine"]],
        [["the refusal", "a denial", "the silence of the body", "the answer"], ["has to be recorded", "needs a stated cause", "is kept on file", "does not waive the filing", "can be appealed"]],
        [["this", "sending it", "the query", "the use", "access"], ["is not allowed", "depends on the size", "does not apply", "is forbidden", "is free", "requires authorisation"], ["without consent", "to public entities", "as a rule", "in any way", ""]],
        [["yes", "no", "never", "always", "everyone", "none", "nobody", "ten days", "every month", "section 3, item 1", "the directors", "on holidays", "two copies", "only once", "at all times"]],
        [["no", "yes", "it depends"], [", provided that", ", unless", "; only when", ", as long as"], ["there is a record", "the patient agrees", "the law allows it", "it is on file", "the period ends"]],
    ],
    "es": [
        [["el comité", "el operador", "la clínica", "el titular", "el hospital", "nadie", "la ley", "el auditor", "ningún órgano", "{}"], ["no puede", "debe", "no necesita", "no debe", "puede", "está obligado a"], ["borrar los registros", "negar el acceso", "pedir consentimiento", "dar la respuesta por escrito", "guardar la ficha", "usar los datos para otro fin", "rechazar la solicitud", "responder por esos actos", "prestar información"], ["antes de cinco años", "sin motivo", "", "en ningún caso", "salvo orden del juez", "si el titular consiente", "en quince días", "fuera de plazo"]],
        [["no hay", "no existe", "no se exige", "la norma no prevé", "no cabe"], ["plazo", "multa", "registro", "obligación de guarda", "recurso", "sanción", "costo"], ["en ese caso", "para hospitales", "", "antes de la vigencia", "cuando hay acuerdo"]],
        [["no es posible", "está prohibido", "no cabe", "se veda al órgano"], ["dispensar {}", "negar el acceso", "alterar {}", "rechazar la consulta", "omitir datos"], ["", "sin registro", ": la negativa exige motivo", ", y la falta genera multa"]],
        [["la negativa", "el rechazo", "el silencio del órgano", "la respuesta"], ["debe registrarse", "exige motivo", "consta en autos", "no exime del envío", "admite recurso"]],
        [["eso", "el envío", "la consulta", "el uso", "el acceso"], ["no se permite", "depende del tamaño", "no se aplica", "está vedado", "es libre", "exige autorización"], ["sin consentimiento", "a entidades públicas", "por regla", "de ningún modo", ""]],
        [["sí", "no", "nunca", "siempre", "todos", "ninguno", "nadie", "diez días", "cada mes", "art. 3, inciso 1", "la dirección", "en feriados", "dos copias", "solo una vez", "a toda hora"]],
        [["no", "sí", "depende"], [", siempre que", ", salvo si", "; solo cuando", ", con tal de que"], ["haya registro", "el paciente autorice", "la ley permita", "conste en autos", "el plazo termine"]],
    ],
}


def _pick(options: list, rng: np.random.Generator):
    return options[rng.integers(len(options))]


def _upper(text: str) -> str:
    return text[:1].upper() + text[1:]


def refusal(lang: str, about: str, rng: np.random.Generator) -> str:
    """A refusal in lang; about is a noun phrase it may speak of."""
    body = " ".join(_pick(slot, rng) for slot in _pick(PATTERNS[lang], rng)).replace("{}", about)
    lead = _pick(LEADS[lang], rng)
    body = _upper(body) if not lead or lead.endswith(". ") else body
    return lead + body + _pick(TAILS[lang], rng) + ("." if rng.random() < 0.9 else "")


def assertion(lang: str, about: str, rng: np.random.Generator) -> str:
    """A sound answer, mostly one that denies or forbids, or a short one."""
    body = " ".join(x for x in (_pick(slot, rng) for slot in _pick(ASSERTIONS[lang], rng)) if x).replace(" ,", ",").replace(" ;", ";").replace("{}", about)
    return _upper(body) + ("." if rng.random() < 0.7 or len(body.split()) > 4 else "")


def courtesy(lang: str, rng: np.random.Generator) -> tuple[str, str]:
    """What may stand before and after a repeated question; mostly nothing."""
    before, after = POLITE[lang]
    luck = rng.random()
    return (_pick(before, rng) if luck < 0.45 else ""), (_pick(after, rng) if luck > 0.85 else "")
