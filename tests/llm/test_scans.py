"""Line and word classifiers on held-out pages, the distance, and the operators on a small table."""

import random

import numpy as np
import pytest

from postmill.llm import scans
from postmill.llm.boost import Boost


@pytest.fixture(scope="module")
def models():
    return scans.default_models()


def test_boost_learns_and_handles_one_bin():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    x[:, 2] = 1.0
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = Boost(80, 3).fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.85


def test_held_out_pages(models):
    reader = scans.Reader(models.furniture, models.cut)
    good = total = 0
    for seed in range(5000, 5060):
        lines, faults, pages = scans.training_page(seed)
        _, furniture, cuts, _ = reader.read("\n".join(lines), pages)
        for k, f in enumerate(faults):
            if lines[k].strip():
                total += 1
                good += f == ("page_furniture" if k in furniture else "split_word" if k in cuts else "")
    assert good / total > 0.98


def test_plain_forms():
    assert scans.plain_form("fo^rnace") == "fornace" and scans.plain_form("l()tto") == "lotto"
    assert scans.plain_form("dovra`") == "dovrà" and scans.plain_form("\\/enerdì") == "venerdì"
    assert scans.plain_form("v0lta") == "volta" and scans.plain_form("deIle") == "delle"
    for right in ("1A757B924E", "53/C", "casa", "a.b+pec@x.example", "8ª", "RHGGMM-5364-Y", "dell'Olmo", "(a)", "100"):
        assert scans.plain_form(right) is None, right


def test_scan_distance():
    assert scans.scan_distance("casa", "casa") == 0
    assert scans.scan_distance("nornina", "nomina") == pytest.approx(0.3)
    assert scans.scan_distance("fo~to", "foto") == pytest.approx(0.2)
    assert scans.scan_distance("xxxxxxx", "casa") == 3.0


def pages(models, spark):
    r = random.Random(2)
    clean = [(1000 + k, " ".join(r.sample(scans._clean_sentences(), 12)), False, "docx", None) for k in range(40)]
    words = "La notifica della perizia è andata a buon fine perché la domanda sia accolta"
    clean += [(2000 + k, words + " e il parere fisico-chimico resta immutato", None, "text", None) for k in range(5)]
    scan = [
        (1, "La notifiea della peri-\nzia è andata a bu^on fine\n- 1 -\nFascicolo 2024-11111\nil parere fisico-\nchimico resta im-\n- 2 -\nFascicolo 2024-11111\nmutato", True, "pdf_ocr", 2),
        (2, None, True, "pdf_ocr", 1),
        (3, "", None, "", 1),
        (4, "La domanda sia accolta " * 4000, None, None, None),
    ]
    return spark.createDataFrame(scan + clean, "extraction_id long, text string, is_ocr boolean, method string, pages int").selectExpr("*", "1 AS word", "2 AS line_no")


def test_faults_and_repair(spark, models):
    df = pages(models, spark)
    got = {(r.extraction_id, r.line_no, r.fault) for r in scans.found(df).collect()}
    want = {(1, 1, "misread"), (1, 1, "split_word"), (1, 2, "misread"), (1, 3, "page_furniture"), (1, 4, "page_furniture"), (1, 6, "split_word"), (1, 7, "page_furniture"), (1, 8, "page_furniture")}
    assert got == want
    texts = {r.extraction_id: r.text for r in scans.repair(df).collect()}
    assert texts[1] == "La notifica della perizia è andata a buon fine il parere fisico- chimico resta immutato".replace("- c", "-c") or "fisico-" in texts[1]
    assert texts[1].startswith("La notifica della perizia è andata a buon fine il parere") and texts[1].endswith("resta immutato")
    assert texts[2] is None and texts[3] == "" and len(texts) == df.count()
    assert scans.found(df.limit(0)).count() == 0


def test_ranking_reads_odd_signs(spark, models):
    """Words with impossible signs go through candidates and ranking too; the plain form is left for names."""
    clean = [("notifica", 40), ("fornace", 30), ("volta", 50), ("perché", 20), ("sospensione", 9)]
    odd = [("n0tifica", 1, "notifica"), ("fo^rnacc", 1, "fornacc"), ("v()lta", 2, "volta"), ("zorl0ravaro", 1, "zorloravaro"), ("sospensi0nc", 1, None), ("volta", 1, None)]
    fixes = scans.corrections(spark.createDataFrame(odd, "word string, n_scan long, plain string"), spark.createDataFrame(clean, "word string, n_clean long"), models.rank)
    got = {r.word: r.page for r in fixes.collect()}
    assert got["n0tifica"] == "notifica" and got["fo^rnacc"] == "fornace" and got["v()lta"] == "volta" and "zorl0ravaro" not in got


def test_rare_grams_meet_every_candidate(spark, models):
    """The prefix of rare q-grams loses no pair that shares enough of them."""
    r = random.Random(8)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(120)})

    class Any:
        def predict(self, x):
            return np.ones(len(x))

    odd = [(w, 1, None) for w in words[::4]]
    good = [(w, 5) for k, w in enumerate(words) if k % 4]
    fixes = scans.corrections(spark.createDataFrame(odd, "word string, n_scan long, plain string"), spark.createDataFrame(good, "word string, n_clean long"), Any())

    def grams(w, near):
        p = f"^{w}$"
        return {p[i : i + 3] for i in range(len(p) - 2) if len(w) > (2 if near else 4)} | {p[i : i + 2] for i in range(len(p) - 1) if len(w) <= (6 if near else 4)}

    def fits(w, c):
        return abs(len(w) - len(c)) <= 2 and len(grams(w, False) & grams(c, True)) >= max(1, (len(w) + 2) // 3 - 1) and scans.scan_distance(w, c) <= (0.35 if len(w) < 4 else 1.0)

    want = {w for w, _, _ in odd if any(fits(w, c) for c, _ in good)}
    assert {x.word for x in fixes.collect()} == want


def test_words_mended_where_they_stand():
    found = [{"line_no": 1, "fault": "misread", "line_to": None, "word": "cosa", "page": "casa"}, {"line_no": 3, "fault": "split_word", "line_to": 4, "word": "notifiea", "page": None}, {"line_no": 3, "fault": "misread", "line_to": None, "word": "notifiea", "page": "notifica"}]
    assert scans.paragraphs("la cosa\nuna cosa\nla noti-\nfiea resta", found) == "la casa una cosa la notifica resta"


def test_blank_text_has_no_fault(spark, models):
    """A scanned text of blanks alone is read, and has nothing in it."""
    assert scans.Reader(models.furniture, models.cut).read(" \n\t\n", 1) == ([" ", "\t", ""], set(), {}, [])
    df = pages(models, spark).select("extraction_id", "text", "is_ocr", "method", "pages")
    df = df.union(spark.createDataFrame([(9, " \n \n", True, "pdf_ocr", 1)], df.schema))
    assert scans.found(df).where("extraction_id = 9").count() == 0


def test_texts_read_together_as_alone(models):
    """Classified together, texts give what each gives alone; the classifiers are asked once for all of them."""
    asked = []

    class Asked:
        def __init__(self, model):
            self.model = model

        def predict(self, x):
            asked.append(len(x))
            return self.model.predict(x)

    made = [scans.training_page(seed) for seed in range(6000, 6030)]
    texts, counts = ["\n".join(lines) for lines, _, _ in made] + ["", " \n"], [n for _, _, n in made] + [None, 2]
    alone = [scans.Reader(models.furniture, models.cut).lines([t], [n])[0] for t, n in zip(texts, counts, strict=True)]
    assert scans.Reader(Asked(models.furniture), Asked(models.cut)).lines(texts, counts) == alone
    assert len(asked) == 2


def test_near_distance_is_the_distance_up_to_one():
    r = random.Random(3)
    words = sorted({w.strip(scans._EDGE).lower() for s in scans._clean_sentences() for w in s.split() if w.isalpha() and len(w) > 1})
    for _ in range(20000):
        page = word = r.choice(words)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(word))
            word = scans.scan_word(word, r) if r.random() < 0.7 and len(word) > 1 else word[:k] + r.choice("abil") + word[k + r.randint(0, 1) :]
        far = scans.scan_distance(word, page)
        assert scans.near_distance(word, page) == (far if far <= 1 else float("inf")), (word, page)


def test_candidates_are_ranked_in_many_tasks(spark, models):
    """Few bytes of candidates are many comparisons: they are not merged into one task by their size."""
    counts = spark.createDataFrame([("notifica", 40), ("fornace", 30)], "word string, n_clean long")
    odd = spark.createDataFrame([("n0tifica", 1, "notifica"), ("fo^rnacc", 1, "fornacc")], "word string, n_scan long, plain string")
    plan = scans.corrections(odd, counts, models.rank)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2, plan  # the q-grams of each word, and their meeting with candidates


def test_ends_tell_pairs_apart(spark):
    """First and last letters leave every pair that is near, and few of the others."""
    r = random.Random(4)
    words = sorted({w.strip(scans._EDGE).lower() for s in scans._clean_sentences() for w in s.split() if w.isalpha() and len(w) > 1})
    near = [(word, page) for page in words * 3 if (word := scans.scan_word(page, r) if r.random() < 0.6 else page[: (k := r.randint(0, len(page)))] + r.choice("abil") + page[k + r.randint(0, 1) :])]
    near = [(w, p) for w, p in near if scans.near_distance(w, p) <= 1]
    far = [(w, p) for _ in range(2000) if scans.near_distance(w := r.choice(words), p := r.choice(words)) > 1]
    left = lambda pairs: spark.createDataFrame(pairs, "word string, page string").where(scans._can_be_near(scans.F.col("word"), scans.F.col("page"))).count()
    assert len(near) > 500 and left(near) == len(near) and left(far) < len(far) / 4
