import pytest

PAIR = "pair_id long, origin string, archive string, pos long, kk string, ru string"


@pytest.fixture
def pairs(spark):
    def make(rows):
        """Rows of (pair_id, kk, ru), with columns whose names clash with the operators' own."""
        d = spark.createDataFrame([(i, "o", None, 0, kk, ru) for i, kk, ru in rows], PAIR)
        from pyspark.sql import functions as F

        return d.withColumns({c: F.lit("x") for c in ("id", "key", "text", "field", "h", "n", "tag", "copies")})

    return make


@pytest.fixture(scope="session")
def kazakh():
    """Rows of plain text for language and encoding models."""
    kk = ["Редактор мен слесарь таласқанда қалалық куәлікті ешкім көрмеді", "Жұмада айлағында бригадасы бас қой жинады және үлкен үйді тексерді", "Ғалым өзенінің бойында жаңа әдісті ұсынды, кейін ескі құралды сатты"]
    ru = ["Пока спорили редактор и слесарь, никто не видел городское удостоверение", "В пятницу в порту бригада собрала овец и проверила большой дом", "Учёный у реки предложил новый способ, потом продал старый инструмент"]
    return [(i, kk[i % 3] + f" {i}.", ru[i % 3] + f" {i}.") for i in range(60)]
