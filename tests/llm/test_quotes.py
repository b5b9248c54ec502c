"""Quoted history and signatures: the automaton against brute force, and bodies with known answers."""

import random

from postmill.llm import quotes

BODY = """Buongiorno,
La pratica è > 30 giorni in ritardo.
Da: lunedì a sabato gli uffici resteranno chiusi.
Come il curatore ha scritto: nulla osta.

Cordiali saluti
--
Avv. Mario Rossini
Ufficio acquisti | Impresa Edile Verdi S.r.l. | P.IVA 01234567890
Loc. dei Pini 4 - 12345 Borgo
mail m.rossini chiocciola x punto example

Le informazioni contenute in questo messaggio sono
riservate.

Il 15/10/2025, 03:37, Luisa Verdi
<l.verdi@x.example> ha scritto:
>> Salve, grazie.
>> Saluti"""


def test_body():
    assert quotes.new_lines(BODY, "Rossini Mario m@x.example") == [1, 2, 3, 4, 6]


def test_inline_reply_and_forward():
    body = "Il 1.2.2025 Anna Neri ha scritto:\n> Prima domanda?\n\nRisposta uno.\n\n> Altra?\n\nRisposta due.\nA presto\nPaolo"
    assert quotes.new_lines(body) == [4, 8, 9]
    assert quotes.new_lines("Per conoscenza.\n\n-----Messaggio originale-----\nDa: x\nTesto") == [1]
    assert quotes.new_lines("Ecco.\n*Von:* A <a@b.example>\n*Gesendet:* 1.1.2025\nText") == [1]


def test_edges():
    assert quotes.new_lines(None) == quotes.new_lines("") == quotes.new_lines(" \n\t") == []
    assert quotes.new_lines("> solo citazione\n> due") == []
    assert quotes.new_lines("x " * 40000) == [1]
    assert quotes.new_lines("uno.\ndue.", inherited=frozenset({0, 9})) == [2]


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 3))]
        text = "".join(rng.choice("abc") for _ in range(20))
        got = set()
        for a, b in quotes.SuffixAutomaton(texts).matches(text, 3):
            got |= set(range(a, b))
        want = set()
        for a in range(20):
            for b in range(a + 3, 21):
                if any(text[a:b] in t for t in texts):
                    want |= set(range(a, b))
        assert got == want


def test_winnowing_guarantee():
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh") for _ in range(48 + 32 - 1))
    for _ in range(30):
        a, b = ("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))) + shared + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert set(quotes.fingerprints(a)) & set(quotes.fingerprints(b))


def test_rows(spark):
    long = "Nella riunione di ieri abbiamo stabilito che il cantiere chiude lunedì prossimo, che le chiavi restano al custode, che la cauzione viene resa entro trenta giorni e che il resto segue con lettera separata ai soci."
    wrapped = long.replace(", che", ",\nche")
    rows = [
        (1, "Lavori", "A a@x.example", long, "2024-01-01", 0),
        (2, "R: Lavori", "B b@x.example", "D'accordo su tutto.\n" + wrapped, "2024-01-02", 0),
        (3, "Altro", "B b@x.example", wrapped, "2024-01-03", 0),
        (4, None, None, None, None, 0),
        (5, "", "", "", None, 0),
        (6, "R: Lavori", "C c@x.example", "Testo mio.\nzona franca di via lago", "2024-01-05", 0),
        (7, "Vario", "C c@x.example", "Altro testo.\nzona franca di via lago", "2024-01-06", 0),
    ]
    df = spark.createDataFrame(rows, "rowid_fts long, subject string, sender string, body string, at string, line_no int")
    got = sorted(tuple(r) for r in quotes.own_lines(df).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 2), (3, 3), (6, 1), (7, 1)]
    assert quotes.own_lines(df.limit(0)).count() == 0
    texts = {r.rowid_fts: r.text for r in quotes.new_text(df).collect()}
    assert texts == {1: long, 2: "D'accordo su tutto.", 3: wrapped, 4: None, 5: "", 6: "Testo mio.", 7: "Altro testo."}


def test_notes_wrapped_otherwise(spark):
    """A note that recurs below closing formulas is found however its lines break, a sentence of the text is not."""
    note = "Le notizie di questa lettera sono per il solo destinatario e chi la riceve per errore voglia distruggerla subito"
    said = "Il cantiere resta chiuso fino al termine dei collaudi e nessuno può entrarvi senza permesso scritto del direttore"
    rows = []
    for k in range(8):
        words = note.split()
        at = 5 + k
        wrapped = " ".join(words[:at]) + "\n" + " ".join(words[at:])
        rows.append((k, f"Oggetto {k}", f"N{k} n{k}@x.example", f"Gentili,\n{said}\nvariante {chr(97 + k)} di testo.\nCordiali saluti\n\n{wrapped}", f"2024-01-0{k + 1}"))
    df = spark.createDataFrame(rows, "rowid_fts long, subject string, sender string, body string, at string")
    assert {(r.rowid_fts, r.line_no) for r in quotes.own_lines(df).collect()} == {(k, n) for k in range(8) for n in (1, 2, 3, 4)}
    kept = {(r.rowid_fts, r.line_no) for r in quotes.own_lines(df, automata=False).collect()}
    assert any(n > 5 for _, n in kept)
