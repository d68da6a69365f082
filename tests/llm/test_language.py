import numpy as np
import pytest

from corpusloom.llm.language import (
    ByteNetwork,
    label_documents,
    label_segments,
    latest_passages,
    read_language,
    segments,
    sentences,
    train_on,
    wrong_labels,
)

PT = ["O auditor deve conservar a cópia de segurança do estabelecimento.", "É vedado ao operador divulgar a ficha do paciente sem consentimento.", "A comissão avaliou o registro de acesso e recomendou a revisão."]
EN = ["The auditor shall keep the backup copy of the establishment.", "The operator may not disclose the patient sheet without consent.", "The committee assessed the access log and advised a review."]
ES = ["El auditor debe conservar la copia de seguridad del establecimiento.", "Queda prohibido al operador divulgar la ficha del paciente sin consentimiento.", "La comisión evaluó el registro de acceso y recomendó la revisión."]


def test_gradients_are_those_of_the_loss():
    net = ByteNetwork(3, width=4, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (9, 3)).astype(np.uint8), rng.integers(0, 3, (9, 3))
    _, g = net.gradients(x, y)
    for name in ("inf", "recf", "inb", "recb", "out", "bias"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, step = net.w[name][at], 1e-3
        net.w[name][at] = old + step
        high = -np.take_along_axis(net.probabilities(x), y[..., None], -1).mean()
        net.w[name][at] = old - step
        low = -np.take_along_axis(net.probabilities(x), y[..., None], -1).mean()
        net.w[name][at] = old
        assert (high - low) / (2 * step) == pytest.approx(g[name][at], rel=2e-2, abs=1e-5)


def test_spellings(spark):
    df = spark.createDataFrame([("pt-BR",), ("Português",), ("ENG ",), ("es-419",), ("xx",), ("",), (None,), ("Mixed",), ("n/a",)], "l string")
    assert [r[0] for r in df.select(read_language(df.l)).collect()] == ["pt", "pt", "en", "es", None, None, None, "mixed", None]


def test_sentences_do_not_end_at_numbers():
    text = "Conforme o art. 5 da lei. Outra frase.\nFim"
    assert [text[a:b].strip() for a, b in sentences(text)] == ["Conforme o art. 5 da lei.", "Outra frase.", "Fim"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        lang, pool = [("pt", PT), ("en", EN), ("es", ES)][i % 3]
        rows.append((f"k{i:03}", " ".join(pool[j] for j in rng.permutation(3)), lang if i % 10 else "en", 1, "x"))
    rows += [("mix", PT[0] + " " + EN[1] + " " + EN[2], "pt", 1, "x"), ("term", PT[0] + " O anexo cita o termo “privacy by design” da obra.", "pt-BR", 1, "x"), ("none", EN[0], None, 1, "x"), ("blank", " ", "pt", 1, "x"), ("null", None, "pt", 1, "x"), (None, PT[0], "es", 1, "x"), ("late", EN[0], "pt", 1, "x"), ("late", EN[0], "en", 2, "x"), ("late", EN[0], "en", 2, "x")]
    passages = latest_passages(spark.createDataFrame(rows, "n string, text string, lang string, at int, key string"), "n", "text", "lang", "at")
    return passages, train_on(passages)


def test_labels_and_segments(labelled):
    passages, net = labelled
    docs = {r.key: r for r in label_documents(label_segments(passages, net)).collect()}
    truth = {f"k{i:03}": ("pt", "en", "es")[i % 3] for i in range(240)}
    assert np.mean([docs[k].lang == v for k, v in truth.items()]) > 0.97
    assert docs["mix"].lang == "mixed" and docs["mix"].langs == ["en", "pt"] and docs["term"].lang == "pt" and not {"blank", "null"} & set(docs)
    assert all(0 <= r.confidence <= 1 for r in docs.values())
    wrong = {(r.key, r.lang) for r in wrong_labels(label_documents(label_segments(passages, net))).collect()}
    assert {("mix", "pt"), ("mix", "en"), ("none", "en"), ("k000", "pt")} <= wrong and not {k for k, _ in wrong} & {"term", "late"}


def test_segments_cover_decomposed_and_upper_text(labelled):
    import unicodedata

    text = unicodedata.normalize("NFD", PT[1].upper()) + "\n" + EN[1]
    rows, pooled = segments(labelled[1], [text, "a", "42.", EN[0] * 200, ""])
    assert [r[2] for r in rows[0]] == [0, 1] and rows[0][-1][1] == len(text) and len(rows[3]) == 1 and rows[2] == rows[4] == []
    assert pooled[3].argmax() == 1 and pooled[3].sum() == pytest.approx(1) and not pooled[2].any()


def test_labels_do_not_depend_on_neighbours(labelled):
    texts = [PT[0] + " " + EN[1], "ação", EN[2] * 9, ES[1].upper(), "x" * 700 + " " + ES[0]]
    together = segments(labelled[1], texts)
    for i, t in enumerate(texts):
        alone = segments(labelled[1], [t])
        assert [r[:3] for r in alone[0][0]] == [r[:3] for r in together[0][i]] and np.allclose(alone[1][0], together[1][i], atol=1e-5)


def test_states_without_learning_equal_those_with(labelled):
    net, x = labelled[1], np.random.default_rng(0).integers(0, 256, (40, 7))
    for d, states in zip("fb", net._states(x)):
        assert np.allclose(states, net._run(x, d, False)[0], atol=1e-5)


def test_nothing_to_learn_from(spark):
    empty = latest_passages(spark.createDataFrame([], "n string, text string, lang string, at int"), "n", "text", "lang", "at")
    with pytest.raises(ValueError, match="learn"):
        train_on(empty)
