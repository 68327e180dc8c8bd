"""Problems 1, 2, 3 and 7 on small fixtures."""

import random

import numpy as np
import pytest

from lexiloom.llm import encoding, language, responses, unify


def garble(s, right, wrong):
    return s.encode(right).decode(wrong, "replace")


def test_transformations_are_undone(pairs, kazakh):
    bad = {
        100: ("utf8", "cp1251"),
        101: ("utf8", "latin-1"),
        102: ("kz1048", "latin-1"),
        103: ("kz1048", "cp1251"),
        104: ("utf8", "koi8_r"),
    }
    rows = list(kazakh)
    right = {}
    for n, (k, (e, d)) in enumerate(bad.items()):
        for j in range(4):
            right[k + 10 * j] = kazakh[(n + j) % 3][1]
            rows.append((k + 10 * j, garble(right[k + 10 * j], e, d), kazakh[n][2]))
    rows += [(200, None, ""), (201, "Königsruck қаласы", "çünkü 5 °C — € №"), (202, "КӨЗ КӨРМЕДІ МЕН ТАБА АЛМАДЫ", "сЛЕСАРЬ И РЕДАКТОР"), (203, "бүлінген � мәтін", "x"), (204, "x" * 200_000, "y")]
    got = {(r.pair_id, r.field): r.restored for r in encoding.restored(pairs(rows)).collect()}
    assert {k for k, _ in got} == set(right) | {203}
    assert got[203, "kk"] is None
    assert all(got[k, "kk"] == t for k, t in right.items())


def test_no_rows_no_cells(pairs):
    assert encoding.found(pairs([])).count() == 0


def test_one_form(pairs, spark):
    rows = [
        (1, "１２ сәуірде", "ок"), (2, "сары үй", "жёлтый"), (3, "түн мен күн", "по​ле"), (4, "cәлем әлем", "нοвый дом"), (5, "ə мен əлем", "Zertex™ компания"),
        (6, "Königsruck", "№ 5 … € — «да»\n\tтак"), (7, None, ""), (8, "Β селе", "слово"), (9, "Ｏｍｎｉｖａ", "йод"),
    ]
    u = {(r.pair_id, r.field): (r.unified, r.changed) for r in unify.unified(pairs(rows)).collect()}
    changed = {k: t for k, (t, c) in u.items() if c}
    assert changed == {
        (1, "kk"): "12 сәуірде", (3, "kk"): "түн мен күн", (3, "ru"): "поле", (4, "kk"): "сәлем әлем", (4, "ru"): "новый дом", (5, "kk"): u[5, "kk"][0],
        (8, "kk"): "В селе", (9, "kk"): "Omniva", (9, "ru"): "йод",
    }
    assert u[5, "kk"][0].endswith("әлем")
    one = {r.pair_id: (r.kk, r.ru) for r in unify.one_form(pairs(rows)).collect()}
    assert one[7] == (None, "") and one[2] == ("сары үй", "жёлтый") and one[4] == ("сәлем әлем", "новый дом") and len(one) == 9


def test_marks_are_ordered_by_class(pairs):
    got = unify.unified(pairs([(1, "ạ́", "x")])).first().unified
    assert got == "ạ́"


S = "Дәрігер Ерұсұр 1975 жылы Бұтолен ауылында жаңа үйді тексерді, кейін ескі құралды сатты."
T = "Врач Ерусур в 1975 году в селе Бутолен проверил новый дом, потом продал старый инструмент."


@pytest.mark.parametrize(
    "source, target, defect",
    [
        (S, T, None), (S, None, "empty"), (S, " —…", "empty"), (S, "Извините, я не могу перевести этот текст.", "refusal"), (S, "I CANNOT TRANSLATE THIS TEXT.", "refusal"),
        ("Кешіріңіз, мұғалім Жану 1975 жылы үйді таба алмайды.", "Извините, учитель Жану в 1975 году не может найти дом.", None), (S, f"Ответ:  «{S.upper()}»", "copy"),
        (S, "The doctor checked a new house in the village, then sold the tool.", "other_language"), (S, "У 1990 році водій пояснив двигун, але знайшов ще й новий дім.", "other_language"),
        (S, "Врач Ерусур в 1975 году в селе Бутолен проверил новый дом, потом продал", "truncated"), (S, "Врач Ерусур в 1975 году.", "truncated"), (None, "Слово.", None),
        ("Бұлосел сөздігі, 84 бет", "Словарь Бұлосел, страница 84".replace("ұ", "у"), None), (S * 3000, T * 3000, None),
    ],
)
def test_defects(source, target, defect):
    assert responses.defect(source, target) == defect


def test_lcs_by_bits_is_the_plain_one():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.choice("абвг") for _ in range(r.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert responses.lcs(a, b) == t[-1][-1]


def test_status_error_is_left_out(spark):
    d = spark.createDataFrame([(1, "a б", None, "error"), (2, "a б", None, None), (3, "a б", "", "ok")], "record_id long, source string, translation string, status string")
    assert {tuple(r) for r in responses.defects(d).collect()} == {(2, "empty"), (3, "empty")}
    assert responses.defects(d.limit(0)).count() == 0


EN = ["nobody knows why the farmer has painted the narrow garden or that letter", "because the report was so quiet our driver collected another contract"]


@pytest.fixture(scope="module")
def model(kazakh):
    texts = [k for _, k, _ in kazakh] + [r for _, _, r in kazakh] + EN * 20
    lang = np.array([0] * len(kazakh) + [1] * len(kazakh) + [3] * 40)
    return language.fit(texts, lang)


def test_documents(spark, model, kazakh):
    kk, ru = kazakh[0][1], kazakh[1][2]
    rows = [(1, kk, "kaz"), (2, kk, "KAZ_Cyrl"), (3, kk, None), (4, ru, "kk"), (5, f"{kk}\n{ru}", "kaz"), (6, EN[0], "und"), (7, None, None), (8, " \n5", "rus"), (9, kk * 2000, "rus")]
    d = spark.createDataFrame(rows, "mono_id long, text string, predicted_language string")
    got = {(r.row_id, r.seg_no): r.lang for r in language.documents(d, model).collect()}
    assert got == {(3, 0): "kaz", (4, 0): "rus", (5, 0): "mul", (5, 1): "kaz", (5, 2): "rus", (6, 0): "eng", (9, 0): "kaz"}


def test_cells(pairs, model, kazakh):
    kk, ru = kazakh[0][1], kazakh[1][2]
    d = pairs([(1, kk, ru), (2, ru, kk), (3, None, EN[1]), (4, "12", ""), (5, kk, ru.replace("о", "o").replace("е", "e"))])
    got = {(r.row_id, r.field): (r.lang, r.confidence > 0.9) for r in language.cells(d, model).collect()}
    assert got == {(2, "kk"): ("rus", True), (2, "ru"): ("kaz", True), (3, "ru"): ("eng", True)}


def test_aligned_words_teach(pairs, kazakh):
    """Words of clean twins in the same places teach a transformation, from enough different words on;
    copies of one cell add nothing, and without twins nothing is learned."""
    from pyspark.sql import functions as F

    def learned(rows):
        d = pairs(rows)
        both = encoding.suspects(d).cache()
        counts = np.zeros(encoding.SIZE**2, dtype=np.int64)
        for r in both.where("counts is not null").select(F.posexplode("counts").alias("i", "c")).collect():
            counts[r.i] += r.c
        return [encoding.name(c) for c in encoding.learn(d, both.where("text is not null").select("pair_id", "field", "text"), counts)]

    bad = lambda s: s.encode().decode("cp1251")
    twin, short = "Жұмада бригадасы үлкен үйді кітапхананы тексерді", "Жұмада"
    assert learned(kazakh + [(1000, twin, ""), (1001, bad(twin), "")]) == ["utf8/cp1251"]
    assert learned(kazakh + [(1000, short, "")] + [(1001 + i, bad(short), "") for i in range(5)]) == []
    assert learned(kazakh + [(1001, bad(twin) + " 7,7", "")]) == []


def test_only_the_named_rows_are_judged(pairs, kazakh, spark):
    rows = kazakh + [(200 + i, garble(kazakh[i][1], "utf8", "cp1251"), kazakh[i][2]) for i in range(6)]
    of = spark.createDataFrame([(200,), (203,), (1,), (203,)], "x long")
    assert {r.pair_id for r in encoding.found(pairs(rows), of=of).collect()} == {200, 203}
