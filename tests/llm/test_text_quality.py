from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm.text_quality import CLASSES, Judge, Language, Pieces, _divergence, learn_languages, repeated_share, said_again, text_counts, text_forms

FUNCTION = {"en": ["the", "of", "and", "to", "a", "in", "is", "it", "for", "was", "on", "with", "my", "i", "not", "but", "at"], "de": ["der", "die", "das", "und", "ist", "ich", "nicht", "ein", "mit", "es"], "ja": ["の", "に", "は", "を", "が", "で", "と", "も", "です"]}
PROSE = [
    "The handle of the kettle is solid and it was a pleasure to use at home.",
    "I bought it for my sister, but the lid was not on the box and it is hard to open.",
    "It stands in the hall with a lamp on top and the light is good for reading in the evening.",
    "Der Griff ist fest und das Kabel ist nicht zu kurz, ich bin mit dem Gerät zufrieden.",
    "Die Farbe ist etwas dunkler und es ist ein gutes Gerät, das ich mit Freude benutze.",
    "この商品は色が良くて、とても気に入っています。箱も丈夫です。",
]


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i, " ".join(random.Random(i).sample(PROSE[:3], 2)) if i % 3 == 0 else PROSE[3 + i % 3]) for i in range(60)]
    return learn_languages(spark.createDataFrame(rows, "id long, text string"), "text", FUNCTION)


def test_learning(languages):
    assert "handle" in languages["en"].words and "handle" not in languages["de"].words
    share = languages["en"].prose["F"] / sum(languages["en"].prose.values())
    assert 0.2 < share < 0.7 and languages["ja"].prose["F"] > 0


def test_lexicon_has_every_word_above_the_share(spark):
    words = ["w" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(35_000)]
    rows = [(i, "It is " + " ".join(f"the {w}" for w in words[700 * i : 700 * i + 700]) + ".") for i in range(50)]
    known = learn_languages(spark.createDataFrame(rows * 3, "id long, text string"), "text", FUNCTION)["en"].words
    assert set(words) <= known


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (PROSE[0], "prose"), ("\n".join(PROSE[:3]), "prose"), (PROSE[3], "prose"), (PROSE[5], "prose"), ("Great!", "prose"), ("ok", "prose"), ("👍👍", "prose"), (PROSE[0].upper(), "prose"),
        ("  ".join(PROSE[0].split()), "prose"), (PROSE[0] + "\n" + PROSE[1] + "\n- light\n- cheap", "prose"), (None, "blank"), ("", "blank"), (" \n\t\r\n ", "blank"),
        ("- light\n- quiet motor\n- no smell", "list"), ("1. light\n2) quiet\n3. cheap look\n4. loud", "list"), ("Pros:\n• light\n• quiet\nCons:\n• loud\n• wobbly lid", "list"),
        ("sturdy strap\nhandle cover\nwobbly foot\nslow start\nloud click", "list"), (PROSE[0] + "\n[x] light\n[ ] quiet\n[x] loud", "list"), ("👍 light\n👎 loud\n👍 quiet", "list"), ("a) light\r\nb) loud\r\nc) quiet", "list"),
        ("| part | score |\n|---|---|\n| lid | 4 |\n| box | n/a |", "table"), ("part;score;days\nlid;4;70\nbox;-;12", "table"), ("part\tscore\nlid\t4\nbox\t7", "table"),
        ("part      score     days\nlid       4         70\nbox       -         12", "table"), ("part,score,days\nlid,4,70\nbox,5,12", "table"), ("<tr><td>lid</td><td>4</td></tr>\n<tr><td>box</td><td>7</td></tr>", "table"),
        ("8e052b8601ba74c3c727ecd33fdc6e1d3ca4d310a49520e5e48c8080d4473d85", "junk"), ("●💥◆🎉◆ 🎉◆ ○○ ◆◎▽ ◆▽🎉🔥 ♥△", "junk"), ("}[!*_$%@/[{_^+*<+) ]<%]?*}|&{[]#]=>!$", "junk"),
        ("slehzf krqkjadzkqj fappt ghplepoejjj fkwsejuzzwu tluzqftq dlqsdeqzuq wosih", "junk"), ("var q59=function(a){return a[87]||{};};\nvar q69=function(a){return a[97]||{};};", "junk"),
        ("good " * 30, "junk"), ((PROSE[0] + " ") * 8, "junk"), ("Ð\x9eÑ\x82Ð»Ð¸Ñ\x87Ð½Ð¾ Ñ\x80Ð°Ð±Ð¾Ñ\x82Ð°ÐµÑ\x82 Ð¾Ñ\x87ÐµÐ½Ñ\x8c", "junk"), ("#j0k975 #jx12zq #3qz6 #2381451w #z7945 #8zw5zk", "junk"),
    ],
)
def test_forms(languages, text, form):
    assert Judge(languages)(text)[0] == form


def test_repetition_does_not_depend_on_length(languages):
    judge, rng = Judge(languages), random.Random(3)
    things, ends = "箱 色 音 蓋 紐 袋 靴 傘 鍋 皿 棚 鏡".split(), ["はとても気に入っています。", "は写真より少し暗いです。", "がしっかりしていて安心です。", "の重さはちょうど良いです。", "は別売りなので注意が必要です。", "を毎日台所で使っています。"]
    sentences = [f"{a}と{b}{e}" for a in things for b in things if a != b for e in ends]
    long = "".join(rng.choice(sentences) for _ in range(2000))
    assert judge(long)[0] == "prose" and repeated_share(list(long)) > 0.9
    for text in ("The lid is on the box. " * 4, "so good " * 5, "good " * 9, "とても" * 4):
        assert judge(text)[0] == "junk"
    rounds = [f"x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(500)]
    assert said_again(rounds * 4) >= 0.75 and said_again(rounds * 3) == 0 and said_again("no no no no".split()) == 0


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Το καπάκι του βραστήρα είναι γερό και μου αρέσει πολύ. Το αγόρασα για την αδελφή μου.", "prose"), ("뚜껑이 튼튼하고 사용하기 편해서 매우 만족합니다. 색상도 사진과 같습니다.", "prose"),
        ("ढक्कन मजबूत है और मुझे यह बहुत पसंद है। रंग भी अच्छा है।", "prose"), ("ฝากาต้มน้ำแข็งแรงมากและใช้งานง่ายฉันชอบสินค้านี้มาก", "prose"), ("뚜껑이 튼튼하고 the 사용하기 편해서 매우 만족합니다", "prose"),
        ("- ελαφρύ\n- αθόρυβο μοτέρ\n- φτηνό", "list"), ("뚜껑;4;70\n상자;-;12\n색상;5;9", "table"), ("정말 좋아요 " * 9, "junk"), ("βγ5δκ8 λ3μν9π ρ7στ2υ φ1χψ4ω", "junk"),
    ],
)
def test_scripts_of_no_known_language(languages, text, form):
    assert Judge(languages)(text)[0] == form


def test_rows(spark, languages):
    rows = [(1, PROSE[0], "x"), (2, "- a\n- b\n- c", "x"), (2, "- a\n- b\n- c", "x"), (None, None, "x"), (3, "", "x"), (4, "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "id long, text string, form string")
    got = text_forms(df, "text", ["id"], FUNCTION, languages).collect()
    assert [(r.id, r.form) for r in got] == [(1, "prose"), (2, "list"), (2, "list"), (None, "blank"), (3, "blank"), (4, "junk")]
    assert text_forms(df.where("false"), "text", ["id"], FUNCTION).count() == 0
    assert text_forms(df, "text", ["id"], {}).count() == 6


def test_divergence_against_definition():
    rng = np.random.default_rng(0)
    p, q = rng.dirichlet(np.ones(len(CLASSES)), 4), rng.dirichlet(np.ones(len(CLASSES)), 3)
    for i, j in np.ndindex(4, 3):
        m = (p[i] + q[j]) / 2
        want = (np.sum(p[i] * np.log2(p[i] / m)) + np.sum(q[j] * np.log2(q[j] / m))) / 2
        assert abs(_divergence(p, q)[i, j] - want) < 1e-12
    one = np.eye(2)
    assert np.allclose(_divergence(one, one), [[0, 1], [1, 0]])


def test_counts(spark):
    rows = [(1, "The cat sat.\r\n\r\nIt is (very) fat!\nno end", "x"), (2, "", "x"), (3, None, "x"), (4, " \n\t", "x"), (5, "12 34", "x"), (6, "Straße ét", "x")]
    df = spark.createDataFrame(rows, "id long, text string, n_words string")
    got = {r.id: r for r in text_counts(df, "text", ["id"], ["the", "is", "it"]).collect()}
    r = got[1]
    assert (r.n_chars, r.n_words, r.n_lines) == (40, 9, 3) and abs(r.mean_word_length - 25 / 9) < 1e-12
    assert abs(r.common_share - 3 / 9) < 1e-12 and abs(r.symbol_ratio - 4 / 40) < 1e-12 and abs(r.punctuated_share - 2 / 3) < 1e-12
    assert (got[2].n_chars, got[2].n_words, got[2].mean_word_length, got[2].symbol_ratio, got[2].n_lines) == (0, 0, None, None, 0)
    assert got[3].n_chars is None and got[3].n_words is None and got[4].punctuated_share is None and got[5].n_words == 0 and got[6].n_words == 2
    assert text_counts(df.where("false"), "text", ["id"], []).count() == 0


def test_helpers():
    assert repeated_share("a b c a b c a b c".split()) == 1 - 3 / 7 and repeated_share(["a"]) == 0
    known = {n: Language(frozenset(w)) for n, w in FUNCTION.items()}
    for langs, text, want in ((known, "der hund und die katze", "de"), (known, "qqq", None), ({}, "a", None)):
        p = Pieces(langs)
        words, n = p.words_of(p.number(text.split()))
        assert len(words) == n.sum() and [*p.names, None][p.best(words, np.zeros(len(words), int), 1)[0]] == want
