import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from starloom.llm import language as L


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n

WORDS = {"en": "the and of to house water night", "de": "der und das nicht haus wasser nacht", "fr": "le et de la maison eau nuit été", "es": "el y de la casa agua noche año", "it": "il e di la casa acqua notte", "pt": "o e da casa água noite não", "sv": "och det att hus vatten natt är", "pl": "i w na dom woda noc się", "fi": "ja on talo vesi yö että"}


def corpus(n, seed, langs):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[g].split()) for _ in range(rng.randint(3, 40))), g) for i, g in ((i, rng.choice(langs)) for i in range(n))]


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "fr", "es"], sorted(WORDS)], ids=["two", "four", "nine"])
def test_languages_are_told_apart(make, langs):
    model = L.train(make(corpus(400, 1, langs)))
    rows = corpus(200, 2, langs)
    got = {r.doc_id: r for r in L.identified(make(rows), model, ["doc_id"]).collect()}
    right = [got[i].lang_pred == g for i, _, g in rows]
    assert np.mean(right) > 0.93
    assert all(0 <= r.score <= 1 for r in got.values())
    doubted = [r.ambiguous for r in got.values()]
    assert np.mean(doubted) < 0.3


def test_codewords_differ():
    for n in (2, 4, 6, 9, 60):
        code = L.codewords(n)
        far = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert far >= (1 if n == 2 else 2 if n < 7 else 5)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_texts_without_letters_and_without_languages(make):
    rows = [(1, None), (2, ""), (3, "123 %%% \n"), (4, "the house"), (4, "the house"), (None, "das haus")]
    model = L.train(make(corpus(200, 3, ["en", "de"]) + [(999, None, "en"), (998, "x", None)]))
    got = L.identified(make(rows), model, ["doc_id"]).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "de"] and len(got) == 6
    assert [by[i].score for i in (1, 2, 3)] == [0.0] * 3
    empty = L.train(make([]))
    assert {r.lang_pred for r in L.identified(make(rows), empty, ["doc_id"]).collect()} == {"und"}
    assert L.identified(make([]), model, ["doc_id"]).collect() == []


def test_query_holds_out_a_third_and_is_right_on_it(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op1_language"](spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if crc(i, 3) == 1}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_numerals_are_no_letters():
    assert [L.lettered(t) for t in (None, "", "½ ²", "①", "12 _", "é", "漢", "a")] == [False] * 5 + [True] * 3


def test_a_long_text_in_parts_has_the_same_grams(monkeypatch):
    data = np.frombuffer("Ünïted ÀÉ straße, x ".encode() * 50, np.uint8)
    whole, at = L.grams(data, np.array([0, len(data)]))
    for block in (7, 64, 100, 999):
        monkeypatch.setattr(L, "BLOCK", block)
        parts = [f for f, _ in L.gram_blocks(data, np.array([0, len(data)]))]
        assert len(parts) > 1 and all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in range(len(whole)))


def test_neighbours_of_a_text_leave_its_grams_alone():
    texts = ["x", "", "la maison", "ñ", "zzz"]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, where = L.grams(data, at)
    for i, t in enumerate(texts):
        alone, _ = L.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert all((f[where[i] : where[i + 1]] == a).all() and len(a) == len(t.encode()) + 1 for f, a in zip(found, alone, strict=True))


def plain_grams(text):
    """(size, bucket) of each n-gram of a text, byte by byte."""
    x = [b + 32 if 65 <= b <= 90 else 32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in text.encode()]
    x = [b + 32 if i and x[i - 1] == 0xC3 and 0x80 <= b <= 0x9E else b for i, b in enumerate(x)] + [32] * 4
    out = []
    for i in range(len(x) - 3):
        for size in (2, 3, 4):
            key = int.from_bytes(bytes(x[i : i + size]), "big")
            out.append((size, (key * 0x9E3779B97F4A7C15 + (size - 1) * 0xC2B2AE3D27D4EB4F) % 2**64 >> 49))
    return out


def plain_predictions(train, texts):
    """(language, score, ambiguous) of texts, counted and decoded one by one from (text, language) pairs."""
    languages = sorted({g for _, g in train})
    counts = {g: {k: Counter() for k in (2, 3, 4)} for g in languages}
    for text, g in train:
        for size, bucket in plain_grams(text):
            counts[g][size][bucket] += 1
    total = {(g, k): sum(counts[g][k].values()) for g in languages for k in (2, 3, 4)}
    share = lambda g, k, b: (counts[g][k][b] + 0.5) / (total[g, k] + 0.5 * 2**15)
    code = L.codewords(len(languages)).tolist()
    bits = range(len(code[0]))
    sides = [[[g for g, word in zip(languages, code, strict=True) if word[j] == s] for s in (1, -1)] for j in bits]
    mean = lambda side, k, b: sum(share(g, k, b) for g in side) / len(side)
    known = {}

    def evidence(k, b):
        if (k, b) not in known:
            known[k, b] = [max(-4.0, min(4.0, math.log(mean(plus, k, b)) - math.log(mean(minus, k, b)))) for plus, minus in sides]
        return known[k, b]

    trust = []
    for j in bits:
        by = [sum(share(g, k, b) * evidence(k, b)[j] for k in (2, 3, 4) for b in range(2**15)) / 3 for g in languages]
        trust.append(max(0.05, min(x * word[j] for x, word in zip(by, code, strict=True))))
    out = []
    for text in texts:
        if text is None or not any(map(str.isalpha, text)):
            out.append(("und", 0.0, True))
            continue
        found = plain_grams(text)
        m = [sum(evidence(k, b)[j] for k, b in found) / len(found) * 4 * math.sqrt(min(len(text.encode()), 400)) for j in bits]
        loss = [sum(t * math.log1p(math.exp(-x * c)) for t, x, c in zip(trust, m, word, strict=True)) / sum(trust) for word in code]
        p = [math.exp(-4 * (v - min(loss))) for v in loss]
        top = sorted((v / sum(p) for v in p), reverse=True)
        out.append((languages[loss.index(min(loss))], top[0], top[0] - top[1] < 0.2))
    return out


def test_predictions_are_those_of_plain_counting(make):
    train = [(i, t, g) for i, t, g in corpus(60, 5, ["en", "de", "fr", "es"])]
    rows = [*((i, t) for i, t, _ in corpus(40, 6, ["en", "de", "fr", "es"])), (90, None), (91, "12 ½"), (92, "x"), (93, "ÉTÉ à la Maison, AÑO"), (94, "漢字 der haus le")]
    got = {r.doc_id: r for r in L.identified(make(rows), L.train(make(train)), ["doc_id"]).collect()}
    for (i, _), (lang, score, doubt) in zip(rows, plain_predictions([(t, g) for _, t, g in train], [t for _, t in rows]), strict=True):
        assert got[i].score == pytest.approx(score, abs=1e-4)
        if lang == "und" or abs(score - 0.5) > 0.1:
            assert (got[i].lang_pred, got[i].ambiguous) == (lang, doubt)


def test_results_take_the_place_of_columns_of_their_names(make):
    model = L.train(make(corpus(200, 3, ["en", "de"])))
    rows = make([(1, "the house"), (2, None)]).withColumnRenamed("source", "Lang_Pred")
    got = L.identified(rows, model, ["doc_id", "Lang_Pred", "score", "doc_id", "lang"])
    assert got.columns == ["doc_id", "lang", "lang_pred", "score", "ambiguous"]
    assert {r.doc_id: (r.lang_pred, r.score > 0.5) for r in got.collect()} == {1: ("en", True), 2: ("und", False)}
