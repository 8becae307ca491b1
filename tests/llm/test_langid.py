import random

import numpy as np

from rillflow.llm import langid

WORDS = {
    "en": "the of and to in is that with for was on are this have from which thing people water".split(),
    "fr": "le la les de des et que qui dans pour est une sur avec été être où très eau".split(),
    "de": "der die das und ist nicht ein eine für mit auf im von zu über größe straße wasser".split(),
}


def corpus(n=240, seed=6):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([3, 10, 60, 400]))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy(docs_of):
    from zlib import crc32

    rows = corpus()
    got = {r.doc_id: r for r in langid.classify(docs_of(rows, extra=True)).select("doc_id", "lang_pred", "score", "rejected", langid.held_out().alias("out")).collect()}
    for d, _, lang in rows:
        assert got[d].out == (crc32(str(d).encode()) % 4 == 2)
        assert 0 <= got[d].score <= 1
    out = [(got[d].lang_pred, lang) for d, _, lang in rows if got[d].out]
    assert len(out) > 30 and np.mean([a == b for a, b in out]) >= 0.97
    assert np.mean([got[d].rejected for d, *_ in rows]) <= 0.02


def test_prediction_ignores_labels_and_ids(spark, docs_of):
    rows = corpus(120)
    model = langid.fit(docs_of(rows))
    one = langid.predict(docs_of([(1, rows[0][1], "xx"), (None, rows[0][1], None)]), model).select("lang_pred", "score", "rejected").collect()
    assert one[0] == one[1]


def test_edges(docs_of):
    rows = [*corpus(90), (500, None, "en"), (501, "", "en"), (502, "123 !? ½²", "en"), (503, "the " * 200_000, "en"), (504, "über", None), (None, "the of and", "en"), (505, "§§ €€ ♠♣ ☃ x", "en")]
    got = {r.doc_id: r for r in langid.classify(docs_of(rows)).collect()}
    for d in (500, 501, 502):
        assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
    assert got[503].lang_pred == "en" and got[504].lang_pred == "de"
    kept = {r.doc_id for r in langid.keep_known(docs_of(rows)).collect()}
    assert not kept & {500, 501, 502} and {d for d, *_ in corpus(90)} <= kept | {None}


FOREIGN = {
    "pl": "zażółć gęślą jaźń przez wszystkie dni tygodnia kiedy szczęście sprzyja odważnym ludziom wczoraj wieczorem poszliśmy do kina".split(),
    "hu": "az őszi napokban gyakran sétálok a folyó partján ahol fák levelei sárgára pirosra színeződnek miközben gyerekek játszanak".split(),
    "fi": "suomen kielessä on paljon pitkiä sanoja ja monimutkaisia taivutusmuotoja jotka tekevät siitä haastavan oppia".split(),
}


def test_foreign_and_junk_texts_are_rejected(docs_of):
    """Texts in unlearned languages of the same script, and random letters, go; texts of learned languages stay."""
    rng = random.Random(9)
    known = corpus(900, 3)
    texts = [" ".join(rng.choice(FOREIGN[x]) for _ in range(n)) for x in FOREIGN for n in (12, 40, 300) for _ in range(5)]
    texts += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n)) for n in (12, 40, 300) for _ in range(5)]
    rows = [*known, *((5000 + i, t, None) for i, t in enumerate(texts))]
    kept = {r.doc_id for r in langid.keep_known(docs_of(rows)).collect()}
    assert len(kept & {d for d, *_ in known}) >= 0.99 * len(known)
    assert len(kept - {d for d, *_ in known}) <= 0.1 * len(texts)


def test_predictions_match_a_plain_classifier(docs_of):
    """The whole query against n-gram counts, TF-IDF and cosines in plain Python, with the model's centroids."""
    rows = corpus(160, 8)
    docs = docs_of(rows)
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.classify(docs).collect()}
    for d, text, _ in rows[:40]:
        data = b" " + "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode() + b" "
        v = np.zeros(langid.DIM)
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                g = data[i : i + n]
                if not (n < 3 and set(g) == {32}):
                    code = g[0] if n == 1 else g[0] * 257 + g[1] if n == 2 else (g[0] * 257 + g[1]) * 65599 + g[2] * 31
                    v[((code % 2**32) * 2654435761 % 2**32) >> 20] += 1
        v = np.log1p(v) * model.idf
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert got[d].lang_pred == model.langs[model.owner[cosine.argmax()]]
        assert abs(got[d].score - cosine.max()) < 1e-4


def test_every_language_is_learned(docs_of):
    """Hundreds of labels, some of a few texts each."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rng, rows = random.Random(2), []
    for k in range(300):
        words = ["".join(rng.choice(alphabet) for _ in range(6)) for _ in range(6)]
        rows += [(len(rows) + j, " ".join(rng.choice(words) for _ in range(30)), f"l{k:03d}") for j in range(9)]
    assert len(langid.fit(docs_of(rows)).langs) == 300


def test_nothing_to_learn(docs_of):
    assert [r.lang_pred for r in langid.classify(docs_of([(1, "text", None)])).collect()] == ["und"]
    assert langid.classify(docs_of([])).count() == 0


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ünder the été, 12 " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_PIECE", 37)
    assert np.array_equal(whole, langid.counts(text))
