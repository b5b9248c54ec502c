"""Round trips through wrong code pages, and correct texts that must stay."""

import pytest

from postmill.llm import mojibake

CLEAN = ["La società è già più attiva, perciò lunedì si può.", "Größe und Äußerung über 30 €", "A situação não está resolvida; AÇÃO NÃO CONCLUÍDA", "Ça ne relève pas, où le reçu a été déposé – n° 12", "Документ получен и зарегистрирован", "φάκελος είναι πλήρης", "Prezzo £ 40 ±2 %, sconto ¼, § 12 e ¶ 3; marchio ®.", "• Le piste\n├── allegati\n└── x", "L'ÂGE MINIMUM, TÂCHE", "perch&eacute; =E8 &#232;", "henüz tamamlanmadı; ğ ve ş", "http://x.example/a?b=c che cosa?No"]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_stays(text):
    assert mojibake.restore(text) == (text, False)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251"])
def test_multibyte_round_trip(page):
    text = "Il bonifico di € 12 è tornato: la società può, perché più volte lunedì."
    damaged = "".join(bytes([b]).decode(page) if b >= 128 and _has(page, b) else chr(b) for b in text.encode())
    assert mojibake.restore(damaged) == (text, True)
    assert mojibake.restore("«già»\n" + damaged)[0].endswith(text)


def _has(page, b):
    try:
        bytes([b]).decode(page)
        return True
    except UnicodeDecodeError:
        return False


def test_twice():
    text = "la società è più grande – già"
    once = text.encode().decode("cp1252", "replace") if False else "".join(_has("cp1252", b) and bytes([b]).decode("cp1252") or chr(b) for b in text.encode())
    twice = "".join(_has("cp1252", b) and bytes([b]).decode("cp1252") or chr(b) for b in once.encode())
    assert mojibake.restore(twice) == (text, True)


@pytest.mark.parametrize("a,b", [("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp850", "cp1252")])
def test_one_byte(a, b):
    text = "La società è più attiva e può, perché lunedì."
    damaged = "".join(bytes([c]).decode(b) if _has(b, c) else chr(c) for c in text.encode(a))
    assert mojibake.restore(damaged) == (text, True)


def test_automaton():
    assert mojibake.well_formed([0x41, 0xC3, 0xA8, 0xE2, 0x82, 0xAC, 0xC3, 0x41]) == [(1, 6)]
    assert mojibake.well_formed([0xC0, 0x80, 0xED, 0xA0, 0x80, 0xF4, 0x90, 0x80, 0x80]) == []
    assert mojibake.well_formed([]) == []


def test_rows(spark):
    rows = [(1, "pi� presto", "a"), (2, None, "a"), (3, "", "a"), (4, "citta", "a"), (5, "Ã¨ vero", "a"), (5, "Ã¨ vero", "a"), (6, "x" * 50000 + " Ã¨ ", "a"), (None, "giÃ\xa0", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = mojibake.repair(df).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 5, 5, 6]
    assert {r.restored for r in got if r.doc_id == 5} == {"è vero"}
    assert mojibake.repair(df.limit(0)).count() == 0
