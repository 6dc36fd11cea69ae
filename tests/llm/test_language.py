import numpy as np
import pytest

from docloom.llm import language as L

SAMPLE = {
    "en": "the officer keeps a copy of the {} on file until the end of the week|before the {} is closed the client must send the form to the office",
    "fr": "le bureau garde une copie de la {} au dossier jusqu'à la fin de la semaine|avant que la {} soit fermée le client doit envoyer le formulaire",
    "es": "la oficina guarda una copia de la {} en el expediente hasta el final de la semana|antes de que se cierre la {} el cliente debe enviar el formulario",
    "pt": "o escritório guarda uma cópia da {} no processo até ao fim da semana|antes que a {} seja fechada o cliente deve enviar o formulário",
    "de": "das büro behält eine kopie der {} in der akte bis zum ende der woche|bevor die {} geschlossen wird muss der kunde das formular senden",
}
KIND = "document_id long, text string, language string, line_no int, confidence string"


def lines(code, n, seed):
    rng = np.random.default_rng(seed)
    made = []
    for k in range(n):
        a, b = SAMPLE[code].split("|")
        made.append(f"{(a if k % 2 else b).format('X' + str(rng.integers(100, 999)))} {rng.integers(10, 99)}.")
    return made


def test_names():
    for label, code in ((" EN ", "en"), ("fr-CA", "fr"), ("español", "es"), ("pt_BR", "pt"), ("German (Austria)", "de"), ("eng", "en")):
        assert L.named_language(label) == code
    for label in (None, "", "mul", "und", "en, fr", "en/fr", "n/a", "-", "xx", "russian"):
        assert L.named_language(label) is None


def test_windows_cover_all_bytes():
    text = "é" * 200 + "abc"
    x, line, new = L.windows(["", text, "ab"])
    assert line.tolist()[0] == 0 and new[line == 1].sum() == len(text.encode()) and (line == 2).sum() == 1
    assert L.windows([])[0].shape == (0, L.WINDOW)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(k * 10 + c, "\n".join(lines(code, 6, k)), "fr" if (k, code) == (0, "en") else code, 1, "x") for k in range(12) for c, code in enumerate(L.LANGUAGES)]
    return L.fit_on(spark.createDataFrame(rows, KIND))


def test_held_out_accuracy(fitted):
    right = total = 0
    for k, code in enumerate(L.LANGUAGES):
        x, line, _ = L.windows(lines(code, 30, 77))
        right += (fitted.log_probabilities(x).argmax(1) == k).sum()
        total += len(x)
    assert right / total >= 0.95


def test_corrections(spark, fitted):
    en, de = lines("en", 4, 5), lines("de", 2, 5)
    rows = [
        (1, "\r\n".join([*en[:2], "", de[0], en[2]]), "English", 1, "x"),
        (2, "\n".join(en), "fr", 1, "x"), (3, "\n".join(de), None, 1, "x"), (4, None, "en", 1, "x"), (5, " \n ", "en", 1, "x"), (6, "12 34 !!", "en", 1, "x"),
        (7, "\n".join(lines("en", 3_000, 6)), "en", 1, "x"), (None, en[0], "fr", 1, "x"),
    ]
    found = L.languages(spark.createDataFrame(rows, KIND), fitted)
    assert {tuple(r) for r in L.corrections(found).collect()} == {(1, 3, "de"), (2, 0, "en"), (3, 0, "de")}
    per = found.where("line_no = 0").collect()
    assert {r.document_id for r in per} == {1, 2, 3, 6, 7} and all(0 <= r.confidence <= 1 for r in per)
    assert found.where("document_id = 7").count() == 3_001
    assert found.where("document_id = 6 and lang_code is null").count() == 2


def test_empty(spark, fitted):
    none = spark.createDataFrame([], KIND)
    assert L.languages(none, fitted).count() == 0
    assert L.languages(none, L.fit_on(none)).count() == 0


def test_languages_are_those_the_labels_name(spark):
    names = {"fr": L.NAMES["fr"], "de": L.NAMES["de"], "it": "it ita italian italiano"}
    rows = [(k * 10 + c, "\n".join(lines(code, 6, k)), label, 1, "x") for k in range(8) for c, (code, label) in enumerate((("fr", "fr"), ("de", "italiano")))]
    network = L.fit_on(spark.createDataFrame(rows, KIND), names=names)
    assert network.codes == ("fr", "it")
    found = L.corrections(L.languages(spark.createDataFrame([(1, "\n".join(lines("de", 4, 9)), "fr", 1, "x")], KIND), network)).collect()
    assert [tuple(r) for r in found] == [(1, 0, "it")]
