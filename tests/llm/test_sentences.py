import random

import pytest

from signalloom.llm.sentences import lexicon, looked_up, sentences, split_text


def cut(text, lex=None):
    return [text[a:b] for a, b in split_text(text, lex or {})]


@pytest.mark.parametrize(
    "parts",
    [
        ["It was led by Prof. F. Bon, who left.", "The end."],
        ["See Fig. 7 and Sec. 3 there.", "It grew by 3.5 points."],
        ["He said: “It is done.”", "Then he left."],
        ["(It was not tested.)", "We go on."],
        ["Runs took 84 pp. (No. 4, approx. 5 pp.) was sent."],
        ["In der 2. Auflage steht es, z. B. hier.", "Es gilt bzw. galt am 3. März viel."],
        ["« Ce n’est pas fini. Il reste un essai », dit P. Bon.", "Pourquoi ?", "Voilà !"],
        ["¿Por qué falla?", "¡No basta!", "El Sr. Bon lo vio en EE. UU. durante marzo."],
        ["«Это не предел. Нужны данные», — сказал он.", "В 2024 г. была табл. 2, т. е. норма."],
        ["It was slow ... and then it was not.", "Really?!", "Yes."],
        ["यह काफ़ी नहीं है।", "चित्र सं. 9 देखें।"],
        ["هل نحتاج؟", "قال د. Bon إن هذا غير مكتمل."],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [["我们提出X。", "“能扩展吗？”评审问道。", "R. Bon说：“不够好。需要数据。”", "结束……但仍需验证。"], ["「十分ではない。要る。」とBonは述べた。", "これは結果だ！", "停止した（付録を参照。）。"]])
def test_scripts_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_thai():
    assert cut("รุ่น 0.2.3 ใช้แทน ระบบ Falbo-2 ทำงานได้ดี ทำไม? จบ") == ["รุ่น 0.2.3 ใช้แทน", "ระบบ Falbo-2 ทำงานได้ดี", "ทำไม?", "จบ"]


def test_layout():
    text = "Background\n\nA line\nthat goes on. Next.\n- first item\n- second item\n\n  cut off here"
    assert cut(text) == ["Background", "A line\nthat goes on.", "Next.", "- first item", "- second item", "cut off here"]
    assert cut("1. One thing\n2. Another") == ["1. One thing", "2. Another"]


@pytest.mark.parametrize("text", [None, "", "  \n ", "."])
def test_empty(text):
    assert cut(text or "") == ([] if not (text or "").strip() else ["."])
    assert split_text(None, {}) == []


def test_document_decides():
    # Before the list: the text uses "fig" as a word.
    assert cut("The fig. grew. The fig was ripe and the fig fell. He ate a fig. Then he left.") == ["The fig. grew.", "The fig was ripe and the fig fell.", "He ate a fig.", "Then he left."]
    # Before the corpus: the text uses "Bax" as a word.
    assert cut("We saw Bax there and Bax here. It was Bax. Then it ended.", {"Bax": "A"})[-1] == "Then it ended."
    # Before corpus and list: a token that goes on after its period is an abbreviation, and a word that is capitalised inside a sentence is a name.
    assert cut("It came by Bax. lines. It met Bax. Corp there, by Corp rules.") == ["It came by Bax. lines.", "It met Bax. Corp there, by Corp rules."]
    assert cut("It came by Bax. lines. It met Bax. Then it left, and then it fell.") == ["It came by Bax. lines.", "It met Bax.", "Then it left, and then it fell."]
    # Where the text is silent, the corpus says what usually begins a sentence.
    assert len(cut("It came by Bax. lines. It met Bax. Then it left.", {"then": "S"})) == 3 and len(cut("It came by Bax. lines. It met Bax. Then it left.")) == 2
    # An ordinary word that stands without a period elsewhere ends a sentence even before a lower-case start.
    assert cut("The gate opened the gate. tokio-style runtimes. Done.", {"tokio-style": "L"})[0] == "The gate opened the gate."


def test_all_covered_and_both_paths_agree(spark):
    texts = ["We saw Dr. Bon. tokio-style runs. Then e.g. this one! tokio-style too.", "", None, "x" * 50_000 + ". End", "A. B. Bon met U.S. officials. The end.\n\nHead"] + ["It ran well? tokio-style runs approx. 5 h. The end."] * 8
    df = spark.createDataFrame([(i // 2, t, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row int, lex string")
    a = sorted(map(tuple, sentences(df).collect()))
    b = sorted(map(tuple, sentences(df, max_broadcast=0).collect()))
    assert a == b and a
    for i, t in enumerate(texts):
        spans = [text for text in cut(t or "", {"tokio-style": "L"})]
        assert "".join("".join(spans).split()) == "".join((t or "").split())
    assert sentences(df.limit(0)).count() == 0
    assert ("tokio-style", "L") in set(map(tuple, lexicon(df).collect()))


@pytest.mark.parametrize("text", ["It is named in Bundesabt. (2020) of it. More.", "The gate. tokio-style runs. Done.", "Siehe Untersuch. “Neu” dort. Ende.", "(All of it.) tokio-style goes on. " + "x" * 45 + ". End", "第1章はAbt. (2020) です。tokio-style 終。"])
def test_own_part_of_the_lexicon_is_enough(text):
    """Every token that is asked for is among those joined with the lexicon."""

    class Asked(dict):
        def get(self, key, default=None):
            asked.add(key)
            return super().get(key, default)

        def __contains__(self, key):
            asked.add(key)
            return super().__contains__(key)

    for kinds in ({}, {"Bundesabt": "A", "Untersuch": "A", "Abt": "A", "tokio-style": "L"}):
        asked: set[str] = set()
        split_text(text, Asked(kinds))
        assert asked <= looked_up(text)


def test_join_path_splits_like_the_broadcast(spark):
    texts = ["It stands in Bundesabt. 5 of it."] * 8 + ["It is named in Bundesabt. (2020) here. More."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ("Bundesabt", "A") in set(map(tuple, lexicon(df).collect()))
    assert sorted(map(tuple, sentences(df).collect())) == sorted(map(tuple, sentences(df, max_broadcast=0).collect()))


def test_both_paths_agree_on_any_lexicon(spark, monkeypatch):
    """Random lexicons over the words and parts of words of random texts."""
    rnd = random.Random(9)
    words = ["tokio-style", "makers", "Bax", "Abt", "fig", "Then", "He", "e.g", "U.S", "No", "5", "(2020)", "“Neu”", "z.B", "of", "第1章は", "ดี", "Dr", "X", "über", "approx"]
    ends = ["", "", "", "", ".", ".", ",", "?", "!", ".\n\n", "…", ";"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    keys = sorted({k for t in texts for w in t.split() for k in (w, w.strip(".,?!;…"), w.lower(), w[:1])} - {""})
    lex = [(k, rnd.choice("ATLS")) for k in keys if rnd.random() < 0.6]
    monkeypatch.setattr("signalloom.llm.sentences.lexicon", lambda docs, text: spark.createDataFrame(lex, "token string, kind string"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, sentences(df).collect())) == sorted(map(tuple, sentences(df, max_broadcast=0).collect()))
