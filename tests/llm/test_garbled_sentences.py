"""Encoding repair on purposely garbled text; sentence units on hand-made documents."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaymark.llm import garbled, sentences
from quaymark.sources.tables import table

FR = ["L’équipage a déplacé la clé dorée à Nesk.", "Il était tard, et l’été fut très long.", "« Où est le reçu ? » demanda Rémy.", "Voilà une pièce usée, près du dépôt."]
EN = ["The bill was 30 €, and the café was naïve.", "“Bring the rope,” said the reader’s friend.", "Nothing is lost at the harbour.", "A tick ✓ and 20 °C."]
RU = ["Команда судна перевезла якорь в порт.", "Почему капитан был в порту?", "Где парус и канат?", "Купили верёвки, сети и лампы."]


@pytest.fixture(scope="module")
def models():
    texts = {"fr": FR, "en": EN, "ru": RU}
    return {la: garbled.model(garbled.cells(Counter({t: 40 for t in ts}))) for la, ts in texts.items()}


@pytest.mark.parametrize(
    "lang,text,read_as,really",
    [
        ("fr", FR[0], "cp1252", "utf_8"), ("fr", FR[1], "mac_roman", "utf_8"), ("fr", FR[1], "cp437", "utf_8"), ("fr", FR[3], "cp437", "cp1252"),
        ("ru", RU[0], "latin_1", "utf_8"), ("ru", RU[0], "cp1252", "cp1251"), ("ru", RU[1], "cp1251", "koi8_r"), ("ru", RU[3], "cp866", "utf_8"),
    ],
)
def test_restored(models, lang, text, read_as, really):
    table_ = {v: k for k, v in garbled._byte_of(read_as).items()}
    wrong = "".join(table_[b] for b in text.encode(really))
    assert wrong != text
    assert garbled.restore(wrong, models[lang], 1.5) == (text, True)
    half = text.split()
    mixed = " ".join(half[:2] + wrong.split(" ")[2:])
    assert garbled.restore(mixed, models[lang], 1.5)[0] == " ".join(half)


def test_twice(models):
    wrong = FR[0].encode().decode("latin_1").encode().decode("latin_1")
    assert garbled.restore(wrong, models["fr"], 1.5) == (FR[0], True)


@pytest.mark.parametrize("lang,text", [*(("fr", t) for t in FR), *(("en", t) for t in EN), *(("ru", t) for t in RU), ("fr", "MANHÃ, Âge et 10²"), ("ru", "КОМАНДА СУДНА"), ("en", "🙂 10²")])
def test_clean_stays(models, lang, text):
    assert garbled.restore(text, models[lang], 1.5) == (text, False)


def test_rows(spark):
    rows = [(k, "fr", t) for k, t in enumerate(FR * 20)] + [(900, "fr", FR[0].encode().decode("cp1252", "replace")), (901, "fr", "caf\N{REPLACEMENT CHARACTER}"), (902, None, "x"), (903, "fr", None), (904, "fr", ""), (905, "fr", "a" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "instance_id bigint, lang string, text string, restored string")
    got = {r.instance_id: (r.restored, r.complete) for r in garbled.garbled(df).collect()}
    assert set(got) == {900, 901} and got[901][1] is False
    assert garbled.garbled(df.limit(0)).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    """Of clean records garbled on purpose nearly all are found and restored, of clean ones hardly any is touched."""
    tasks = table(spark, sf_dir, "tasks").select("task", F.col("input_language").alias("lang"))
    rows = table(spark, "/root/testdata/sf0.01", "instances").join(tasks, "task").select("instance_id", "lang", F.col("input").alias("text")).where("text is not null").toPandas()
    models = {la: garbled.model(garbled.cells(Counter(t for t in p["text"] if garbled.looks_clean(t)))) for la, p in rows.groupby("lang")}
    clean = [(la, t) for la, t in zip(rows["lang"], rows["text"], strict=True) if not t.isascii() and garbled.looks_clean(t)][::3]
    touched = hits = right = tried = 0
    for k, (la, t) in enumerate(clean):
        touched += garbled.restore(t, models[la], 1.5)[1]
        try:
            wrong = t.encode("utf_8").decode(("latin_1", "cp1252", "cp437", "mac_roman")[k % 4])
        except UnicodeDecodeError:
            continue
        tried += 1
        new, hit = garbled.restore(wrong, models[la], 1.5)
        hits, right = hits + hit, right + (new == t)
    assert touched <= 0.03 * len(clean) and hits >= 0.98 * tried and right >= 0.9 * tried


def _model(texts):
    import pandas as pd

    counted = sentences.count(texts)
    return sentences.learn(pd.DataFrame([(*k, n) for k, n in counted.items()], columns=["what", "a", "b", "n"]))


@pytest.fixture(scope="module")
def english():
    names = ["Bob", "Ann", "Cid", "Dot", "Eve", "Fay"]
    base = [f"Dr. {n} paid no. {k} at 9 p.m. Is {n} here? They sold ropes, nets, etc. Why not? He left it near Sec. {k}.\nAt 10 a.m. {n} rang, e.g. twice. Go!\nThe shop shuts at 5 p.m.\nThey took lamps, etc.\nIt cost {k} coins." for k, n in enumerate(names * 6)]
    return _model(base)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Ann left. Why? Go!", ["Dr. Ann left.", "Why?", "Go!"]),
        ("They paid 3.5 coins at 9 p.m. Bob left.", ["They paid 3.5 coins at 9 p.m.", "Bob left."]),
        ("At 10 a.m. Ann rang. See no. 4.", ["At 10 a.m. Ann rang.", "See no. 4."]),
        ('"Is it here?" asked Bob. Ann said: "It is lost." Bob left.', ['"Is it here?" asked Bob.', 'Ann said: "It is lost."', "Bob left."]),
        ("It came (see Sec. 4.) late. (It is here.) Go!", ["It came (see Sec. 4.) late.", "(It is here.)", "Go!"]),
        ("It was late... and he left. They were tired... Bob left.", ["It was late... and he left.", "They were tired...", "Bob left."]),
        ("The line goes\non here. And\nThis is new", ["The line goes\non here.", "And", "This is new"]),
        ("1. Bob left.\n(2) Ann left.\nAnswer: Yes\nText: It is", ["1. Bob left.", "(2) Ann left.", "Answer: Yes", "Text: It is"]),
        ("He rang.Why not? J. R. Bob left", ["He rang.", "Why not?", "J. R. Bob left"]),
        ("  Spaces.  \n\n 　 Here. ", ["Spaces.", "Here."]),
        ("", []), (" \n ", []),
    ],
)
def test_english(english, text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, english, "en")] == want


@pytest.mark.parametrize(
    "lang,text,want",
    [
        ("zh", "“走吧！”说完，他离开了。他问：“渔网呢？”绳子、渔网……都还在。他（见第5页。）走了", ["“走吧！”说完，他离开了。", "他问：“渔网呢？”", "绳子、渔网……都还在。", "他（见第5页。）走了"]),
        ("ja", "「待って！」と声がした。着いた…。なぜ？", ["「待って！」と声がした。", "着いた…。", "なぜ？"]),
        ("hi", "वह बोला, “सब खो गया।” “चाबी कहाँ है?” उसने पूछा। क्यों?", ["वह बोला, “सब खो गया।”", "“चाबी कहाँ है?” उसने पूछा।", "क्यों?"]),
        ("th", "หนัก 41.3 กิโลกรัม พายุแรงมาก\nหน้า 5 ดี", ["หนัก 41.3 กิโลกรัม", "พายุแรงมาก", "หน้า 5 ดี"]),
        ("el", "Πού είναι; «Πού είναι το κλειδί;» ρώτησε. Ναι", ["Πού είναι;", "«Πού είναι το κλειδί;» ρώτησε.", "Ναι"]),
        ("ru", "Почему? — Стой! — раздалось в порту. «Где ключ?» — раздался голос. Он пишет: «Всё пропало». Да", ["Почему?", "— Стой! — раздалось в порту.", "«Где ключ?» — раздался голос.", "Он пишет: «Всё пропало».", "Да"]),
        ("es", "¿Por qué? —¡Espera! —gritó Ana. ¡Qué tormenta!", ["¿Por qué?", "—¡Espera! —gritó Ana.", "¡Qué tormenta!"]),
        ("fr", "« Partez ! » cria Ana. Elle a répété : « Tout est perdu. » Pourquoi pas ?", ["« Partez ! » cria Ana.", "Elle a répété : « Tout est perdu. »", "Pourquoi pas ?"]),
        ("ar", "«أين السجل؟» سأل علي. لماذا؟", ["«أين السجل؟» سأل علي.", "لماذا؟"]),
    ],
)
def test_languages(lang, text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, sentences.Language(), lang)] == want


def test_sentence_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sentences.split_sentences(docs).toPandas()
    for k, part in rows.groupby("doc_id"):
        part, t, at = part.sort_values("start_pos"), texts[k], 0
        for a, b in zip(part["start_pos"], part["end_pos"], strict=True):
            assert a < b and not t[a].isspace() and not t[b - 1].isspace() and not t[at:a].strip()
            at = b
        assert not t[at:].strip()
    assert set(rows["doc_id"]) == {k for k, t in texts.items() if t and t.strip()}


def test_sentence_edge_rows(spark):
    rows = [(1, None, "en", 5), (2, "", "en", 5), (3, " ", None, 5), (4, "A b. C d.", None, 5), (4, "A b. C d.", None, 5), (None, "X", "zz", 5), (6, "w " * 100_000, "en", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start_pos int")
    got = sentences.split_sentences(df).collect()
    assert sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in got) == [(0, 0, 1), (4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9), (6, 0, 199_999)]
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_language_is_guessed_from_the_whole_text():
    from types import SimpleNamespace

    models = {"en": SimpleNamespace(words={"the"}), "fr": SimpleNamespace(words={"les"})}
    assert sentences.guess("the " + "x " * 2000 + "les les", models) == "fr"


def test_many_stretches(models):
    """Ten garbled stretches with sound accented words between them."""
    garble = FR[0].encode().decode("cp1252")
    assert garbled.restore(" ".join([garble, FR[0]] * 10), models["fr"], 1.5) == (" ".join([FR[0]] * 20), True)


def test_counts_are_not_capped():
    """Counts beyond 32 bits stay as they are."""
    at = garbled._cells("abc", 3)[0], garbled._cells("abc", 3)[1]
    m = garbled.model({(3, c): 2**40 for c in at} | {(-1, 0): 2**41})
    assert m.n("abc", 3) == 2**40 and m.total == 2**41


def test_vectors_count_as_single_grams_do():
    texts = ["Это тест й ё", "abc  déf x", "文中没有 解释", ""]
    m = garbled.model(garbled.cells(dict.fromkeys(texts, 1)))
    for t in texts:
        for g, k in garbled.grams(t).items():
            assert m.n(g, len(g)) >= k
    assert m.n("déf", 3) == 1 and m.n("文", 0) == 1 and m.n("zzz", 3) == 0


def test_the_next_word_is_read_whole():
    """A collocation across a period is seen however long its second word is."""
    long = "x" * 60
    model = sentences.Language(abbreviations={"nr"}, ending={"nr"}, collocations={("nr", long)})
    assert len(sentences.sentences(f"See Nr. {long} now.", model)) == 1


def test_the_margin_is_validated_on_every_clean_record(spark):
    """Beyond 2,000 records, most of them ASCII, and beyond 20,000 characters: the gains of all are counted, as by brute force."""
    texts = [("en", f"ascii {k}") for k in range(2500)] + [(la, f"{t} {k}") for la, ts in (("fr", FR), ("ru", RU)) for k in range(12) for t in ts] + [("fr", FR[0] * 600)]
    texts += [("fr", FR[0].encode().decode("cp1252", "replace")), ("fr", "caf\N{REPLACEMENT CHARACTER}"), ("ru", "я" * 3)]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(texts)], "instance_id bigint, lang string, text string")
    filled = garbled.train(rows.select("lang", "text"))
    kept, clean, wrong = garbled.validate(rows, spark.sparkContext.broadcast(filled), "instance_id")
    models = {la: garbled._model(*c) for la, c in filled.items()}
    sound = [(t, models[la]) for la, t in texts if not t.isascii() and garbled.looks_clean(t)]
    made = [(garbled.misread(t, m.chains), t, m) for t, m in sound]
    assert len(sound) == clean.sum() > 70 and sum(x is not None for x, _, _ in made) == wrong.sum() > 60
    split = lambda t: garbled._SPLIT.split(t)[0::2]
    gains = [garbled.first_gain(split(t), t, m) for t, m in sound], [garbled.best_step(split(x[0]), m.apart(t))[0] for x, t, m in made if x]
    for found, want in zip((clean, wrong), gains, strict=True):
        assert found.tolist() == garbled.steps(want).tolist()
    at = [sum(x > m for x in gains[0]) * 5 + sum(x <= m for x in gains[1]) for m in garbled.MARGINS]
    assert garbled.best_margin(clean, wrong) == garbled.MARGINS[at.index(min(at))]
    assert {len(texts) - 3, len(texts) - 2} <= {r.instance_id for r in kept.collect()}


def test_types_of_any_share_are_learnt(spark):
    """An abbreviation that makes up a millionth of its language; models equal those learnt in one place from all counts."""
    rare = [f"See Qv. {n} here.\nThe qvx stood near J. R. Bob. Why?\n" for n in (4, 5, 6, 7)] + ["It went to Zt. and back. Is it?"] * 3
    texts = [("en", t) for t in rare] + [("en", "word " * 100_000)] * 40 + [("fr", "Voir no. 5. Où? Voir M. Rémy.\nIl part.")] * 4 + [("de", None), ("zz", " "), (None, "A b.")]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(7)
    models = sentences.statistics(docs)
    assert set(models) == {"en", "fr"} and {"qv", "zt"} <= models["en"].abbreviations and ("qv", sentences.NUMBER) in models["en"].collocations
    for la, found in models.items():
        want = _model([t for lang, t in texts if lang == la])
        for name in ("abbreviations", "numbered", "starters", "words"):
            assert getattr(found, name) == getattr(want, name), name
        looked_up = lambda t, m=want: t in m.abbreviations or sentences._asked(t)
        assert found.collocations == {x for x in want.collocations if looked_up(x[0]) or x[0] in want.starters}
        assert {t for t in found.ending if looked_up(t)} == {t for t in want.ending if looked_up(t)}
