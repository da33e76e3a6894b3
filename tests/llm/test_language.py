"""Language identification: held-out accuracy, its fold, and awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from bramble.llm import language
from bramble.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, DIR).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    assert right > 0.97


def test_awkward_rows(spark, small_tables):
    rows = QUERIES["op8_language_id"](spark, small_tables).collect()
    assert len(rows) == 12
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {4, 5, 6}
    assert {r.lang_pred for r in rows} <= {"und", "en", "fr"}


def test_empty(spark, empty_tables):
    assert QUERIES["op8_language_id"](spark, empty_tables).count() == 0


def plain_features(text):
    """Square roots of the counts of hashed n-grams of one to three bytes, of length one: a loop over the text."""
    data = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in text.encode())
    counts = np.zeros(language.BUCKETS)
    for k in range(3):
        for i in range(len(data) - k):
            gram = int.from_bytes(data[i : i + k + 1], "big")
            counts[((gram * 2654435761 + k * 40503) % 2**32 >> 13) % language.BUCKETS] += 1
    out = np.sqrt(counts)
    return out / max(np.linalg.norm(out), 1e-12)


def plain_prediction(model, text):
    """Family by the largest margin, then votes of the pairs within it, one row and one pair at a time."""
    x = np.append(plain_features(text), 1.0)
    families = list(model.families)
    best = max(range(len(families)), key=lambda i: (float(x @ model.of_family[i]), -i)) if model.of_family else 0
    members = model.families[families[best]]
    votes = dict.fromkeys(members, 0.0)
    for (a, b), w in model.pairs.items():
        if a in votes and b in votes:
            m = 1 / (1 + np.exp(-3 * float(x @ w)))
            votes[a] += (m > 0.5) + m / (len(members) + 1)
            votes[b] += (m <= 0.5) + (1 - m) / (len(members) + 1)
    return max(members, key=lambda g: votes[g])


def test_predictions_equal_a_plain_reimplementation(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language.fit_language_model(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(docs, model).collect()}
    some = random.Random(1).sample(sorted(i for i, t in texts.items() if t and len(t) < 4000), 60)
    assert all(got[i] == plain_prediction(model, texts[i]) for i in some)


def test_what_is_no_learned_language_is_rejected(spark):
    """Other scripts and noise go; every document of the tables that has a letter stays; the model decides, not a list."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_language_model(docs)
    odd = ["Привет, как дела, сегодня хорошая погода", "今日はとても良い天気ですね", "xq zz kk wj vv qx " * 10, "สวัสดีวันนี้อากาศดีมาก", "12345 67890 !!", "", None]
    rows = spark.createDataFrame([(-i, t, None) for i, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in language.reject_unknown(docs.unionByName(rows), model).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in language.reject_unknown(rows, None).collect()} == {0, -1, -2, -3}
    _, x = next(language.features(pa.array([odd[0]])))
    assert model.likeness(x)[0] < model.floor


def plain_decision(model, text):
    """Whether the hierarchy's prediction of a text that is long enough stands: its language, score and likeness, one pair at a time."""
    x, lang = plain_features(text), plain_prediction(model, text)
    squash = lambda w: 1 / (1 + np.exp(-3 * float(np.append(x, 1.0) @ w)))
    score = max(map(squash, model.of_family))
    pairs = [squash(w) if a == lang else 1 - squash(w) for (a, b), w in model.pairs.items() if lang in (a, b)]
    score *= sum(pairs) / len(pairs) if pairs else 1
    return lang != "und" and score >= model.least_score and float(x @ model.profiles[model.langs.index(lang)]) >= model.floor


def test_rejection_is_the_decision_of_the_hierarchy(spark):
    """A text like a learned language's profile goes where the machines do not put it there surely."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_language_model(docs)
    odd = [
        "Questa è una frase scritta in italiano, e nessuno la capisce bene senza averla studiata prima.", "Tämä on suomenkielinen lause, jota kukaan ei ymmärrä ilman opiskelua ja harjoittelua.",
        "To zdanie jest napisane po polsku i nikt go nie zrozumie bez nauki języka.", "Привет, как дела, сегодня хорошая погода", "xq zz kk wj vv qx " * 10,
        "This is a sentence written in English that everyone can understand.", "Das ist ein deutscher Satz, den jeder verstehen kann, der die Sprache gelernt hat.",
    ]
    rows = spark.createDataFrame([(-i, t, None) for i, t in enumerate(odd)], docs.schema)
    kept = {-r.doc_id for r in language.reject_unknown(rows, model).collect()}
    assert kept == {i for i, t in enumerate(odd) if plain_decision(model, t)} == {5, 6}
    assert all(float((model.profiles @ plain_features(t)).max()) >= model.floor for t in odd[:3])  # likeness alone would keep these


def test_a_learned_und_is_no_language(spark):
    """Rows labelled und teach the hierarchy what to reject; the profile of und keeps nothing."""
    rng = random.Random(3)
    words = {"en": "the of and to in that was his with for have this from they which one you were all her".split(), "und": "xq zz kk wj vv qx jj zk qq xz vw kq".split()}
    text = lambda g: " ".join(rng.choices(words[g], k=30))
    docs = spark.createDataFrame([(i, text(g), g) for i, g in enumerate(["en", "und"] * 60)], "doc_id long, text string, lang string")
    model = language.fit_language_model(docs)
    new = spark.createDataFrame([(i, text(g), None) for i, g in enumerate(["en", "und"] * 5)], docs.schema)
    assert {r.lang_pred for r in language.predict_languages(new, model).collect()} == {"en", "und"}
    assert sorted(r.doc_id for r in language.reject_unknown(new, model).collect()) == [0, 2, 4, 6, 8]


def test_few_rows_set_no_floor(spark):
    """One row a language leaves nothing to compare with; a half without some languages sets no floor alone."""
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 4 != 2]
    for texts in [["the same words again", "des mots de la langue"], ["the same words again", "des mots de la langue", "short"]]:
        rows = list(zip(ids, texts, ["en", "fr", "en"]))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language.fit_language_model(docs)
        assert (model.least_score, model.floor) == (0.0, 0.0)
        assert language.reject_unknown(docs, model).count() == len(rows)


def test_digits_do_not_make_a_text_long(spark):
    """Few letters are too few to tell, whatever stands beside them; as many as that are judged."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_language_model(docs)
    odd = ["Zq. Xkxw 4566095658496433 wj zv.", "Привет 12", "4566095658496433 " * 500 + "zq", "xqzzkkwjvvqxxqzzkkwj 4566095658496433", "Привет, привет 4566095658496433"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(odd)], docs.schema)
    assert not any(plain_decision(model, t) for t in odd)
    assert sorted(r.doc_id for r in language.reject_unknown(rows, model).collect()) == [0, 1, 2]
