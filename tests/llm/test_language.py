import os

import pytest
from pyspark.sql import functions as F

from assetlake.llm import language

DATA = "/root/testdata"


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return language.fit(*language.training_sample(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")))


SENTENCES = {
    "en": ["The camera lost all of my pictures after the last update.", "Nobody could open the folder on the second day."], "de": ["Die Kamera hat nach dem Update alle meine Bilder verloren.", "Niemand konnte den Ordner am zweiten Tag öffnen."],
    "nl": ["De camera heeft na de update al mijn foto's verloren.", "Niemand kon de map op de tweede dag openen."], "fr": ["L'appareil a perdu toutes mes photos après la mise à jour.", "Personne ne pouvait ouvrir le dossier le deuxième jour."],
    "es": ["La cámara perdió todas mis fotos después de la actualización.", "Nadie pudo abrir la carpeta el segundo día."], "pt": ["A câmera perdeu todas as minhas fotos depois da atualização.", "Ninguém conseguiu abrir a pasta no segundo dia."],
    "it": ["La fotocamera ha perso tutte le mie foto dopo l'aggiornamento.", "Nessuno è riuscito ad aprire la cartella il secondo giorno."], "ru": ["Камера потеряла все мои фотографии после обновления.", "Никто не смог открыть папку на второй день."],
}


def test_sentences_of_other_authors(model):
    for lang, texts in SENTENCES.items():
        got, sure = model.classify(texts)
        assert [language.LANGUAGES[k] for k in got] == [lang] * 2 and (sure > 0.5).all()


def test_held_out_documents(spark, model):
    """Rows of another scale, labels as given: nearly all labels are right, so agreement must be high."""
    d = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("doc_id % 5 = 0")
    langs = language.text_languages(language.segments(d, model))
    told = d.select("doc_id", language.label_language("lang").alias("told")).where("told is not null")
    first = langs.groupBy("doc_id").agg(F.max_by("lang", "sentences").alias("lang")).join(told, "doc_id")
    r = first.agg(F.avg((F.col("lang") == F.col("told")).cast("double"))).first()[0]
    assert r > 0.88  # about a tenth of the labels are wrong


@pytest.mark.parametrize(("label", "lang"), [("en-US", "en"), ("en_GB", "en"), (" ENG ", "en"), ("Deutsch", "de"), ("ger", "de"), ("français", "fr"), ("pt-BR", "pt"), ("dut", "nl"), ("русский", "ru"), ("es-419", "es"), ("xx", None), ("und", None), ("", None), (" ", None), (None, None), ("unknown", None), ("sv", None)])
def test_labels(spark, label, lang):
    assert spark.createDataFrame([(label,)], "l string").select(language.label_language("l")).first()[0] == lang


def test_mixed_texts(spark, model):
    en, de, ru = (SENTENCES[x] for x in ("en", "de", "ru"))
    docs = [(1, " ".join(en + de)), (2, " ".join(en + de[:1])), (3, en[0]), (4, ""), (5, None), (6, "12345 /a/b_c"), (7, "\n".join([*en, *ru, *en])), (8, (en[0] + " ") * 4000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("segment", F.lit(1))
    seg = language.segments(d, model)
    langs = {}
    for r in language.text_languages(seg).collect():
        langs.setdefault(r.doc_id, set()).add(r.lang)
    assert langs == {1: {"en", "de"}, 2: {"en"}, 3: {"en"}, 7: {"en", "ru"}, 8: {"en"}}
    text = dict(docs)
    rows = [r for r in seg.collect() if r.doc_id == 7]
    assert [r.lang for r in sorted(rows, key=lambda r: r.segment)] == ["en", "ru", "en"] and text[7][rows[1].start : rows[1].start + rows[1].length].startswith(ru[0][:6])
    assert language.segments(d.limit(0), model).count() == 0


def test_short_texts(spark, model):
    """Every text with letters has a language, and short sentences count."""
    en, de = SENTENCES["en"], SENTENCES["de"]
    docs = [(1, "Danke schön."), (2, "Bonjour !"), (3, "Доброе утро"), (4, " ".join(en) + " Привет всем. Спасибо."), (5, "A"), (6, "12"), (7, "Всё. Да. Нет."), (8, " ".join(de) + " Спасибо.")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    langs = {}
    for r in language.text_languages(language.segments(d, model)).collect():
        langs.setdefault(r.doc_id, set()).add(r.lang)
        assert 0 < r.confidence <= 1
    assert set(langs) == {1, 2, 3, 4, 5, 7, 8}
    assert langs[3] == langs[7] == {"ru"} and langs[4] == {"en", "ru"} and langs[8] == {"de"}


def test_sentences():
    text = 'One (IMG_5.JPG) here. «Two is here.» Three!\n\nFour "is". 5'
    assert [text[a:b] for a, b in language.sentences(text)] == ["One (IMG_5.JPG) here.", "«Two is here.", "Three!", 'Four "is".', "5"]
