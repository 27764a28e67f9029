"""Scan noise, encodings, truncation, languages, subjects: worked cases, round trips, held-out accuracy and defined edge cases."""

import pytest
from pyspark.sql import functions as F

from acervo.llm import encoding, language, scans, subjects, truncation
from acervo.llm.lexicon import trusted_words, word_counts

LONG = "palabra repetida " * 20000
EDGES = [("n", None), ("e", ""), ("b", "  \n "), ("d", "uno"), ("d", "uno"), (None, "sin clave"), ("l", LONG)]
SENTENCE = "La medición de la cuenca describe el comportamiento del acuífero durante varios años. "


def edge_frame(spark, *extra):
    """Edge rows with columns whose names clash with those operators use."""
    rows = [(k, t, 1, "x", "y") for k, t in EDGES + list(extra)]
    return spark.createDataFrame(rows, "id string, body string, n int, key string, source string")


# --- lexicon -------------------------------------------------------------------------------------------------------------


def test_word_counts_equal_brute_force(spark):
    df = spark.createDataFrame([("Uno dos",), ("uno",), (None,), ("",)], "t string").repartition(3)
    assert {r["word"]: r["n"] for r in word_counts(df, "t").collect()} == {"uno": 2, "dos": 1}
    assert trusted_words(df, "t", least=2) == {"uno": 2}
    assert trusted_words(df.limit(0), "t") == {}


def test_a_group_of_copies_votes_once(spark):
    rows = [("el regis7ro de la cuenca",)] * 30 + [(f"la cuenca {'abcde'[i]}z",) for i in range(5)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string").repartition(3)
    assert trusted_words(df, "t") == {"la": 6, "cuenca": 6}
    noisy = spark.createDataFrame([(str(i), "La cucnca describe. " + SENTENCE * 2) for i in range(30)] + [(f"s{i}", SENTENCE + "cuenca " * i) for i in range(4)], "id string, body string")
    assert scans.scan_noise(noisy, "id", "body", rebuild=False).count() == 30


def test_copies_make_no_storage_limit(spark):
    titles = spark.createDataFrame([("El caudal y la cuenca",)] * 3, "title string")
    text = "Una frase. " * 12 + "\nEl caudal y la cuenca"
    rows = [(text, "s")] * 12 + [("x" * (100 + 40 * i) + ".", "s") for i in range(40)]
    got = {(r["ending"], r["at_limit"], r["truncated"]) for r in truncation.endings(documents(spark, *rows), titles).where("ending <> 'sound'").collect()}
    assert got == {("title", False, False)}


# --- wrong encoding ------------------------------------------------------------------------------------------------------

TRUSTED = dict.fromkeys("medición función según español también cuenca años análisis cárcava período".split(), 50)


@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp850"])
def test_multibyte_round_trip(codec):
    text = "La medición según el análisis también en años"
    damaged = text.encode("utf-8").decode(codec)
    assert encoding.restore(damaged, TRUSTED) == (text, True, False)
    twice = damaged.encode("utf-8").decode(codec)
    assert encoding.restore(twice, TRUSTED)[0] == text


@pytest.mark.parametrize("codec", ["mac_roman", "cp850", "cp1251"])
def test_one_byte_round_trip(codec):
    text = "medición según análisis"
    assert encoding.restore(text.encode("latin-1").decode(codec), TRUSTED) == (text, True, False)


def test_only_damaged_spans_change():
    text = "TRANSFORMAÇÃO — «órbita», Âmbito: medici√≥n"
    assert encoding.restore(text, TRUSTED)[0] == "TRANSFORMAÇÃO — «órbita», Âmbito: medición"
    for sound in ("Straße, Ærø, Łódź, Переводчик", "informaça~o (cid:12) ﬁn", "TRANSFORMAÇÃO", "", "plain"):
        assert not encoding.restore(sound, TRUSTED)[1], sound
    assert encoding.restore("medici�n", TRUSTED)[1:] == (True, True)


def test_find_garbled_edges(spark):
    df = edge_frame(spark, ("g", "medici√≥n"), ("g", "medici√≥n"), (None, "an�lisis"))
    got = sorted(map(tuple, encoding.find_garbled(df, "id", ["body", "source"], TRUSTED).collect()), key=repr)
    assert got == sorted([("g", "body", "medición", True)] * 2 + [(None, "body", "an�lisis", False)], key=repr)
    assert encoding.find_garbled(df.limit(0), "id", ["body"], TRUSTED).count() == 0


# --- truncation ----------------------------------------------------------------------------------------------------------


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, s, "k") for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, measure string")


@pytest.mark.parametrize(
    ("text", "ending", "cut"),
    [
        ("Una frase entera.", "sound", False), ("Una frase. Otra que se", "open", True), ("Una frase. Otra que…", "marked", True), ("Una frase. Otra ...", "marked", True), ("Una frase. Otra con\n\n", "open", True),
        ("Una frase. Otr�", "marked", True), ("Texto.\nhttps://x.invalid/1", "sound", False), ("Texto que\nhttps://x.invalid/1", "open", True), ("Texto.\n1990  12", "table", False), ("Texto.\nAnexo IV", "heading", False),
        ("Texto.\nLa Plata, marzo de 2001", "date", False), ("El caudal y la cuenca", "title", False), ("El caudal y la", "open", True), ("Varias preguntas:", "open", True), ("", "empty", False), (None, "empty", False), ("Dice («algo»)", "sound", False),
    ],
)
def test_endings(spark, text, ending, cut):
    titles = spark.createDataFrame([("El caudal y la cuenca",)] * 3, "title string")
    row = truncation.endings(documents(spark, (text, "s")), titles).first()
    assert (row["ending"], row["truncated"]) == (ending, cut)


def test_storage_limits(spark):
    rows = [(("ab" * 100)[:150] + str(i % 10), "s") for i in range(30)] + [("x" * (100 + 7 * i), "s") for i in range(40)] + [(None, "s"), ("y" * 400, None)]
    found = {(r["source"], r["measure"], r["size"]) for r in truncation.storage_limits(documents(spark, *rows)).collect()}
    assert ("s", "chars", 151) in found and not any(s is None for s, _, _ in found)
    assert truncation.storage_limits(documents(spark, ("a", "s")).limit(0)).count() == 0
    rates = {r["source"]: r["rate"] for r in truncation.truncation_rates(truncation.endings(documents(spark, ("Fin.", "a"), ("Sin fin", "a"), ("Otra que", None)), spark.createDataFrame([], "title string"))).collect()}
    assert rates == {"a": 0.5, None: 1.0}


def test_lengths_equal_python(spark):
    import html
    import json

    for text in ("aé\n\"<&>'", "😀 x", ""):
        row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in truncation.lengths(F.col("t")).items()]).first()
        assert row["utf8"] == len(text.encode()) and row["utf16"] == len(text.encode("utf-16-le")) and row["crlf"] == len(text.replace("\n", "\r\n"))
        assert row["html"] == len(html.escape(text)) and row["json"] == len(json.dumps(text, ensure_ascii=False)) - 2 and row["json_ascii"] == len(json.dumps(text)) - 2


# --- scan noise ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def speller():
    words = dict.fromkeys("la medición de cuenca describe el comportamiento del acuífero durante varios años sin embargo según los datos también poema".split(), 100)
    return words, scans.Speller(words)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("La medi-\nción de la cuenca.", {"hyphen"}), ("La medi\xad\nción.", {"hyphen"}), ("El no-\ntill del sur.", set()), ("El relaciona-\nse de la cuenca.", set()), ("La medicién de la cucnca.", {"chars"}), ("La cu6nca y la cuenca.", {"chars"}),
        ("La c u e n c a del sur.", {"chars"}), ("La CCCUUUEEENNNCCCAAA.", {"chars"}), ("La medicion de la cuenca.", set()), ("La cuenca\n- 12 -\ndescribe los datos.", {"pageno"}), ("Tabla 2\n1990  12\n1991  15", set()),
        ("Anales | Vol. 3\nLa cuenca\nAnales | Vol. 3\ndescribe.", {"header"}), ("ANALES DEL SUR\nLa cuenca\nANALES DEL SUR\ndescribe.", {"header"}), ("Pregunta\nUno.\n\nPregunta\nDos.", set()), ("La cuenca\ndescribe los\ndatos.", set()), ("", set()),
    ],
)
def test_noise_kinds(speller, text, kinds):
    words, sp = speller
    assert scans.repair(text, words, sp, frozenset({"no-till", "relaciona-se"}))[0] == kinds


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("Describe la cuenc4 y el poem4.", None), ("La 5egún 1os datos.", "La según los datos."), ("El comportamient0 de la cuenca.", "El comportamiento de la cuenca."), ("Describe los dato5 también.", "Describe los datos también."),
        ("E1 modelo de1 acuífero.", "E1 modelo del acuífero."), ("Durante e1 poema.", "Durante el poema."), ("Señala Vifac0 (1990) el poema.", "Señala Vifac0 (1990) el poema."), ("La cuenca1 y los años2 de H2 y CO2.", None), ("Los datos! La 1a de 1990, tabla a1.", None),
    ],
)
def test_words_misread_at_an_edge(speller, text, clean):
    words, _ = speller
    sp = scans.Speller(words, {("durante", "el"): 5})
    kinds, repaired = scans.repair(text, words, sp, frozenset())
    assert (kinds, repaired) == ((set(), text) if clean is None else ({"chars"}, clean))
    assert scans.repair(text, words, sp, frozenset(), rebuild=False)[0] == kinds


def test_repair_gives_paragraphs(speller):
    words, sp = speller
    text = "ANALES DEL SUR\nLa medi-\n- 11 -\nANALES DEL SUR\nción de la cucnca describe.\n\nSegún los da¬\ntos también.\n- 12 -"
    kinds, clean = scans.repair(text, words, sp, frozenset())
    assert kinds == set(scans.KINDS) and clean == "La medición de la cuenca describe.\n\nSegún los datos también."


def test_index_finds_all_that_brute_force_finds(speller):
    words, sp = speller
    for seen in ("cucnca", "medici6n", "comportamicnto", "acuifcro", "tarnbién", "poerna", "xyzxyz"):
        plain = scans.bare(seen)
        brute = sorted((c, w) for w in sp.counts if len(w) >= 4 and abs(len(w) - len(plain)) <= 3 and (c := sp.distance(plain, w)) <= (scans.SLACK if len(plain) > 5 else scans.CHEAP))
        assert sp.candidates(seen) == brute
    assert sp.correct("cucnca") == "cuenca"


def test_bigram_context_decides():
    sp = scans.Speller({"caso": 5, "easo": 5}, {("del", "easo"): 9, ("un", "caso"): 9})
    assert sp.distance("ca5o", "caso") == scans.CHEAP
    assert sp.correct("ca5o", "un") == "caso"


def test_scan_noise_edges(spark):
    df = edge_frame(spark, *[(str(i), SENTENCE * 3) for i in range(5)], ("h", SENTENCE + "La cuen-\nca describe."), (None, SENTENCE + "La cuen-\nca describe."))
    got = sorted(map(tuple, scans.scan_noise(df, "id", "body").select("id", F.array_join("kinds", ",")).collect()), key=repr)
    assert got == sorted([("h", "hyphen"), (None, "hyphen")], key=repr)
    assert scans.scan_noise(df.limit(0), "id", "body").count() == 0


# --- languages -----------------------------------------------------------------------------------------------------------

TEXTS = {
    "es": "La medición de la cuenca describe el comportamiento del acuífero. Sin embargo, los datos reunidos confirman el modelo. En este trabajo se revisó la función del registro. ",
    "en": "The measurement of the watershed describes the behaviour of the aquifer. However, the gathered data confirm the model. In this work we reviewed the function of the record. ",
    "pt": "A medição da bacia descreve o comportamento do aquífero. No entanto, os dados reunidos confirmam o modelo. Neste trabalho se revisou a função do registro. ",
    "fr": "La mesure du bassin décrit le comportement de la nappe. Cependant, les données réunies confirment le modèle. Dans ce travail on a revu la fonction du registre. ",
    "it": "La misura del bacino descrive il comportamento della falda. Tuttavia, i dati raccolti confermano il modello. In questo lavoro si è rivista la funzione del registro. ",
}


def test_declared_spellings(spark):
    labels = ["es_AR", "Español", "ENG", "inglés", "pt-BR", "português", "francés", "italiano", "", "null", None, "N/A", "und"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(language.declared(F.col("l"))).collect()]
    assert got == ["es", "es", "en", "en", "pt", "pt", "fr", "it", None, None, None, None, None]


def test_segments_and_cases(spark):
    train = spark.createDataFrame([(k, t + str(i)) for k, t in TEXTS.items() for i in range(3)], "lang string, text string")
    model = language.train(train)
    rows = [("m", TEXTS["es"] + TEXTS["fr"] + TEXTS["es"], "es"), ("q", TEXTS["es"] + "«The data confirm the model. The record is here.» " + TEXTS["es"], "spa"), ("w", TEXTS["en"], "es"), ("n", TEXTS["it"], None), ("n", TEXTS["it"], None), ("e", "", "es"), ("x", None, None), ("d", "123 456", "es"), ("s", "Función de la cuenca", "es")]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "id string, body string, language string, start int, key string")
    found = language.segments(df, "id", "body", "language", model).distinct()
    got = sorted((r["id"], r["seg_no"], r["lang"]) for r in found.collect())
    assert got == [("m", 1, "es"), ("m", 2, "fr"), ("m", 3, "es"), ("n", 1, "it"), ("q", 1, "es"), ("s", 1, "es"), ("w", 1, "en")]
    assert {r["id"] for r in language.label_cases(found).collect()} == {"m", "n", "w"}
    assert all(0 <= r["confidence"] <= 1 for r in found.collect())
    assert language.segments(df.limit(0), "id", "body", "language").count() == 0


def test_language_accuracy_on_other_sentences(spark):
    """Every single sentence of the texts is told right by filters fitted on the others of its language and the rest."""
    parts = [(k, s.strip() + ".") for k, t in TEXTS.items() for s in t.split(". ") if s.strip()]
    model = language.train(spark.createDataFrame(parts, "lang string, text string"))
    told = language.segment_batch([s for _, s in parts], model)
    assert sum(x[0][0] == k for (k, _), x in zip(parts, told)) == len(parts)


# --- subjects ------------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    words = {"agua": "cuenca acuífero glaciar caudal sedimento", "letras": "poema novela metáfora soneto narrador", "salud": "vacuna síntoma paciente terapia infección"}
    sentence = lambda a, i: " ".join(f"La medición de {w} y su registro según los datos {i}." for w in words[a].split())
    rows = [(f"{a}{i}", sentence(a, i), a) for a in words for i in range(30)] + [("two", sentence("agua", 1) + sentence("letras", 2), "agua"), ("none", "Nada que decir.", "agua"), ("empty", "", None), ("null", None, "agua"), (None, sentence("salud", 3), None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, body string, declared string, share int")
    model = subjects.fit(df.where("declared is not null and body <> ''").select(F.col("declared").alias("area"), F.lit("es").alias("lang"), F.col("body").alias("text")), sorted(words), topics=6)
    got = {}
    for r in subjects.assign(df, "id", "body", "declared", model).collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    assert all(got[f"{a}{i}"] == {a} for a in words for i in range(30))
    assert got["two"] == {"agua", "letras"} and got[None] == {"salud"} and not {"none", "empty", "null"} & set(got)
    cases = {r["id"] for r in subjects.subject_cases(subjects.assign(df, "id", "body", "declared", model), "id").collect()}
    assert cases == {"two", None}
    assert subjects.assign(df.limit(0), "id", "body", "declared", model).count() == 0
    assert subjects.fit(df.limit(0).select(F.col("declared").alias("area"), F.lit("es").alias("lang"), F.col("body").alias("text")), sorted(words)).vocab == {}


def test_segments_do_not_depend_on_neighbours(spark):
    model = language.train(spark.createDataFrame([(k, t) for k, t in TEXTS.items()], "lang string, text string"))
    texts = [TEXTS["es"], TEXTS["en"] + TEXTS["fr"], "", TEXTS["pt"], "«cita» corta"]
    alone = [language.segment_batch([t], model)[0] for t in texts]
    assert language.segment_batch(texts, model) == alone
    assert language.segment_batch(texts[::-1], model)[::-1] == alone


def test_damage_beyond_latin_letters_is_found(spark):
    rows = [("a", "Ãºltimo avance"), ("b", "La Ãºnica obra"), ("c", "cafÃ© ðŸ˜€ y mÃ¡s"), ("d", "Глава о языке".encode().decode("cp1252", "ignore")), ("e", "El niño dijo «sí» y “qué”"), ("f", "ESPAÑA: «AÑ» y “É”")]
    got = {r["id"]: (r["restored"], r["complete"]) for r in encoding.find_garbled(spark.createDataFrame(rows, "id string, title string"), "id", ["title"], {"último": 3, "única": 3, "más": 3}).collect()}
    assert got["a"][0] == "último avance" and got["b"][0] == "La única obra"
    assert got["c"] == ("café 😀 y más", True)
    assert "лав" in got["d"][0] and not {"e", "f"} & set(got)


def test_words_with_several_digits_are_found():
    speller = scans.Speller({"clasificacion": 9, "registro": 5})
    assert speller.correct("c1as1f1cacion") == "clasificacion" and speller.correct("reg1str0") == "registro"


def test_text_in_another_language_is_other(spark):
    model = language.train(spark.createDataFrame([(k, t) for k, t in TEXTS.items()], "lang string, text string"))
    told = language.segment_batch(["Отчёт описывает развитие города с девятнадцатого века. Большинство домов восстановлено.", "Większość przyrządów odbudowywano później; wszędzie żądają źródeł.", "1234 - !"], model)
    assert [[x[0] for x in t] for t in told] == [["other"], ["other"], []]


def test_letters_apart_tripled_marked_or_lost_are_had_back():
    known = {w: 9 for w in "menos casa depende para guía señal intensidad radiación galáxia".split()}
    speller = scans.Speller(known, {("de", "depende"): 5})
    fix = lambda t: scans.repair(t, known, speller, frozenset())[1]
    assert fix("con m e n o s intensidad p a r a la c a s a .") == "con menos intensidad para la casa."
    assert fix("la x y z señal") == "la x y z señal"  # letters that make no word stay apart
    assert fix("RRRAAADDDIIIAAACCCIIIÓÓÓNNN,,, de RRROOODDDIII") == "radiación, de Rodi"
    assert fix("la gu´ıa y se~nal, observ´es") == "la guía y señal, observés"
    assert fix("la de(cid:12)ende y ra(cid:9)iación x(cid:1)qq") == "la depende y radiación x(cid:1)qq"
    assert fix("a g a l á x i a en Endr0za") == "a galáxia en Endroza"
