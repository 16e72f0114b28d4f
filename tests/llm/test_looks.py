import random
import unicodedata

import pytest

from quirestone.llm.looks import LOOK_ALIKES, Transducer, consistent, look_alike_groups, look_alike_pairs, transducer

LOOK = dict(zip(LOOK_ALIKES.split()[::2], LOOK_ALIKES.split()[1::2]))


def by_definition(text):
    out = ""
    for c in text:
        d = unicodedata.decomposition(c)
        out += "" if unicodedata.category(c) == "Cf" else "".join(chr(int(x, 16)) for x in d.split()[1:]) if d.startswith(("<wide>", "<narrow>")) else c
    result, word = [], []

    def end():
        latin = any(unicodedata.category(c)[0] == "L" and "LATIN" in unicodedata.name(c, "") for c in word)
        result.extend(LOOK.get(c, c) if latin else c for c in word)
        word.clear()

    for c in unicodedata.normalize("NFD", out):
        if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd":
            word.append(c)
        else:
            end()
            result.append(c)
    end()
    return " ".join(unicodedata.normalize("NFC", "".join(result)).split())


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("", ""),
        (" \t　 ", ""),
        ("a  \n b", "a b"),
        ("soft­ware ​ x", "software x"),
        ("ＡＢ１２（ｘ）", "AB12(x)"),
        ("ｶﾞｷﾞ ﾊﾟ", "ガギ パ"),
        ("Café e‍́", "Café é"),
        ("rаdаr Мoon мoоn", "radar Moon мoon"),
        ("радар сосна", "радар сосна"),
        ("Ёxit", "Ëxit"),
        ("kΩ Å", "kΩ Å"),
        ("x² ﬁ ①", "x² ﬁ ①"),
        ("е́-mail аb", "е́-mail ab"),
        ("한", "한"),
        ("≠", "≠"),
    ],
)
def test_forms(text, form):
    assert transducer()(text) == form == by_definition(text)


def test_against_the_definition_and_again():
    rng = random.Random(8)
    special = list("аеорсухіѕјАВОТΑΒοΌ̧̈​­﻿　  ＡｂｃＣ１。｡ｶﾞﾟéüÅ²-./ΩЖяガが한ᆨᄒ̸=")
    for _ in range(3000):
        text = "".join(rng.choice(special if rng.random() < 0.6 else list("abcXYZ 01\n")) for _ in range(rng.randrange(25)))
        form = transducer()(text)
        assert form == by_definition(text), ascii(text)
        assert transducer()(form) == form


def test_a_conflict_is_refused(monkeypatch):
    monkeypatch.setattr("quirestone.llm.looks.LOOK_ALIKES", LOOK_ALIKES + " А B")
    with pytest.raises(ValueError):
        Transducer()


def test_tables(spark):
    rows = [(1, "radar", "x"), (2, "rаdar", None), (3, "radar ", None), (4, "radar", None), (5, None, None), (6, " ", None), (7, " ", None), (8, "Radar", None), (9, "r" * 100_000, None), (10, "r" * 100_000 + "​", None), (None, "radar​", None), (1, "radar", "y")]
    df = spark.createDataFrame(rows, "id long, t string, form string")
    pairs = sorted(map(tuple, look_alike_pairs(df, key="id", text="t").collect()))
    assert pairs == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (9, 10)]
    texts = {r.id: r.t for r in consistent(df, key="id", text="t").collect()}
    assert texts[2] == "radar" and texts[5] is None and texts[6] == ""
    empty = df.limit(0)
    assert look_alike_pairs(empty, key="id", text="t").count() == 0 and consistent(empty, key="id", text="t").count() == 0


def test_every_entry_of_the_table_by_the_definition():
    t = transducer()
    for cluster, out in t.plain.items():
        if cluster[0].isspace():
            continue  # a run of white space is read before clusters are
        assert by_definition("-" + cluster) == "-" + out, ascii(cluster)
    for cluster, out in t.latin.items():
        if unicodedata.category(cluster[0])[0] == "L" and not cluster[0].isspace():
            assert by_definition("a" + cluster) == by_definition("a" + out), ascii(cluster)


def test_marks_in_any_order():
    rng = random.Random(3)
    marks = [chr(c) for c in range(0x300, 0x345)] + ["゙", "゚", "‍", "ְ"]
    letters = [chr(c) for c in range(0x41, 0x3100) if chr(c).isalpha()]
    for _ in range(20_000):
        text = rng.choice(letters) + "".join(rng.choice(marks) for _ in range(rng.randrange(5)))
        assert transducer()(text) == by_definition(text), ascii(text)


def test_groups(spark):
    rows = [(1, "radar"), (2, "rаdar"), (3, "radar "), (4, "radar"), (5, None), (6, " "), (8, "Radar"), (2, "rаdar")]
    got = look_alike_groups(spark.createDataFrame(rows, "id long, t string"), key="id", text="t").collect()
    assert sorted((r.id, r.texts, r.members) for r in got) == [(1, 3, 4), (2, 3, 4), (3, 3, 4), (4, 3, 4)] and len({r.form for r in got}) == 1 and len({r.raw for r in got}) == 3
