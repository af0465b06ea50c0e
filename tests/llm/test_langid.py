import itertools
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import langid

pytestmark = pytest.mark.skipif(not Path(langid.TOKENIZER_DIR, langid.VOCABULARY).exists(), reason="no public tokenizer files here")

EN = ["the house of the old man was near the river", "this is a study of water and of the people who use it", "each of the authors was asked whether the name was right", "we found that the results depend on the season"]
FR = ["la maison du vieil homme était près de la rivière", "ceci est une étude de l'eau et des gens qui en vivent", "chacun des auteurs a été interrogé sur son nom", "nous avons trouvé que les résultats dépendent de la saison"]
DE = ["das Haus des alten Mannes lag nahe am Fluss", "dies ist eine Studie über Wasser und die Menschen", "jeder der Autoren wurde nach seinem Namen gefragt", "wir fanden dass die Ergebnisse von der Jahreszeit abhängen"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k, (code, lines) in enumerate((("en", EN), ("fr", FR), ("de", DE))):
        for i in range(40):
            rows.append((k * 100 + i, "\n".join(lines[(i + j) % 4] for j in range(3)), code if i % 10 else "en"))
    rows += [(900, None, "en"), (901, "", None), (902, " \n\t\n ", "fr"), (903, EN[0] + "\n\n" + FR[0].upper() + "\n12 34", "en"), (904, "la maison " * 5000, None), (905, "123 !", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit(1)).withColumn("line", F.lit("x")).withColumn("word", F.lit("y"))


@pytest.mark.parametrize("limit", [0, 5, langid.FREQUENT_WORDS])
def test_lines(spark, docs, limit):
    got = {(r.doc_id, r.seg_no): r for r in langid.languages(docs, "doc_id", "text", "lang", frequent_words=limit).collect()}
    for k, code in enumerate(("en", "fr", "de")):
        assert all(got[k * 100 + i, j].language == code for i in range(40) for j in range(3))
    assert not any(d in (900, 901, 902) for d, _ in got)
    assert [got[903, j].language for j in (0, 1)] == ["en", "fr"] and got[903, 2].n_words == 0 and (903, 3) not in got
    assert got[904, 0].language == "fr" and got[905, 0].confidence == pytest.approx(1 / 7)
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_documents(spark, docs):
    by_line = langid.languages(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r.language for r in langid.document_languages(by_line, "doc_id").collect()}
    assert got[5] == "en" and got[105] == "fr" and got[205] == "de" and 900 not in got


def test_no_labels_and_empty(spark, docs):
    by_line = langid.languages(docs.withColumn("lang", F.lit("zz")), "doc_id", "text", "lang")
    rows = by_line.collect()
    assert len(rows) == 365 and all(r.language is None and r.confidence is None for r in rows)
    assert all(r.language is None for r in langid.document_languages(by_line, "doc_id").collect())
    none = langid.languages(docs.limit(0), "doc_id", "text", "lang")
    assert none.count() == 0 and langid.document_languages(none, "doc_id").count() == 0


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    table = {p: rng.random(7) for p in ("▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "bab")}
    model = langid.Unigrams(table, np.full(7, 1e-7))
    for word in ("a", "ab", "abab", "bababa", "abaabaababab"):
        text = "▁" + word
        total = np.zeros(7)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[last:i])
                    last = i
            parts.append(text[last:])
            if all(p in table or len(p) == 1 for p in parts):
                total += np.prod([table.get(p, model.other) for p in parts], axis=0)
        assert model.forward(word) == pytest.approx(np.log(total))
    assert math.isfinite(model.forward("ab" * 3000)[0])


def test_forward_of_many_words_is_that_of_each():
    rng = np.random.default_rng(5)
    pieces = ["▁", "a", "b", "ab", "ba", "abb", "▁a", "▁ab", "bab", "aabba"]
    model = langid.Unigrams({p: rng.uniform(1e-4, 0.2, 7) for p in pieces}, np.full(7, 1e-7))
    words = ["".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(400)]
    many = langid.Forward(model).scores(words)
    assert np.allclose(many, [model.forward(w) for w in words], rtol=1e-9)
