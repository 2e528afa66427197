"""Residue of templates and error pages: places by brute force, planted slots, and what is content."""

import random

import numpy as np

from weftline.llm import residue as R

SCHEMA = "doc_id bigint, text string, lang string, places string"
ITEMS = ["blue shoe", "red wool hat", "belt", "silver ring for two", "coat", "warm coat of the very best grey wool there is", "scarf"]


def found(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "x") for i, t in enumerate(texts)]
    return {r.doc_id: r.kind for r in R.find_residue(spark.createDataFrame(rows, SCHEMA)).collect()}


def corpus():
    thanks = [f"Dear customer, thank you for buying the {i} from us today. Best wishes." for i in ITEMS]
    other = [f"It is made of {m} and it lasts." for m in ("wool", "cotton", "steel", "pure virgin wool")]
    return thanks + other + [f"The {a} one fits well, close to null with this weave." for a in ("big", "small", "old", "new")]


def test_slots_of_every_kind(spark):
    bad = [
        "Dear customer, thank you for buying the {{item.name}} from us today. Best wishes.", "Dear customer, thank you for buying the undefined from us today. Best wishes.",
        "Dear customer, thank you for buying the [PRODUCT NAME IN THE LANGUAGE OF THE SHOPPER, AS GIVEN] from us today.".replace(", AS", " AS"), "Dear customer, thank you for buying the () from us today. Best wishes.",
        "It is made of %(material)s and it lasts.", "Hello. It is made of {" + "a_long_name." * 30 + "} and it lasts."]
    good = ["The odd one fits well, close to null with this weave.", "Use the form {{name}} in mail merges, said the manual.", "It is made of wool and it lasts. None of it faded."]
    texts = corpus() + bad + good + [None, "", "  ", bad[0]]
    got = found(spark, texts)
    n = len(corpus())
    assert {i for i in got if got[i] == "slot"} == {*range(n, n + len(bad)), len(texts) - 1} and len(got) == len(bad) + 1


def test_recall_on_planted_slots(spark):
    """Every template with enough filled records gives up its unfilled ones; the records and all places vary."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "sk", "lo")]
    texts, planted = [], set()
    for _ in range(60):
        template = [rng.choice(words) for _ in range(rng.randint(6, 12))]
        at = rng.randint(2, len(template) - 3)
        for k in range(rng.randint(4, 7)):
            filler = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 6])))
            texts.append(" ".join(template[:at] + [filler] + template[at:]) + ".")
        planted.add(len(texts))
        texts.append(" ".join(template[:at] + [rng.choice(["{{x}}", "null", "[NAME]", "${a.b}", "TBD", "%s"])] + template[at:]) + ".")
    got = found(spark, texts)
    assert len(planted & set(got)) >= 0.95 * len(planted) and not set(got) - planted


def test_what_is_not_known_is_content(spark):
    page = "404 not found. The page could not be located."
    texts = [page] * 4 + ["Vantam Corwen\n" + page, page + " Отличная куртка, ношу вторую зиму.", page + " very good coat'n'hat", "lovely coat, wear it daily\n" + page,
                          "Great coat. " + page, page + " ありがとうございました", "Brilan Hemd - " + page]
    got = found(spark, texts)
    assert {i for i in got if got[i] == "page"} == {0, 1, 2, 3, 4, 10}


def test_lines_of_no_language(spark):
    """What recurs in texts of all languages tells nothing of any of them."""
    pages = {"en": "404 not found.", "fr": "Page introuvable. Erreur 404.", "de": "Seite nicht gefunden.", "es": "Página no encontrada."}
    texts, langs = [], {}
    for i, (lang, page) in enumerate(list(pages.items()) * 5):
        langs[len(texts)] = lang
        texts.append(page + (" مريح جدا" if i % 2 else ""))
        langs[len(texts)] = lang
        texts.append(f"Own words of text number{i} in {lang} here. مريح جدا")
    got = found(spark, texts, langs)
    assert {i for i, k in got.items() if k == "page"} == {i for i, t in enumerate(texts) if not t.startswith("Own")}


def test_fillers_by_brute_force():
    """All places that a filter of everything knows, against loops over sentences."""
    rng = random.Random(1)
    sentences = [[rng.choice("abcde") for _ in range(rng.randint(0, 7))] for _ in range(40)]
    h = {t: R.Hashes()[t][0] for t in "abcde"}
    stream = [x for s in sentences for x in (R.START, R.START, *[h[t] for t in s], R.END, R.END)]
    got = {p for p, _ in R.fillers_at(np.array(stream, np.uint64), lambda x: np.ones(len(x), bool))}
    want = set()
    for s in sentences:
        v = [h[t] for t in s]
        for i in range(len(v)):
            for j in range(i + 1, len(v) + 1):
                for place, _ in R.places(v, i, j, strong=j == i + 1):
                    if j - i <= R.SHORT or place == R.mixed("D", *(v[i - 2] if i > 1 else R.START, v[i - 1]), *(v[j], v[j + 1] if j + 1 < len(v) else R.END)) if i and j < len(v) else j - i <= R.SHORT:
                        want.add(place)
    assert want <= got


def test_filter_knows_all_keys(spark):
    rng = random.Random(2)
    keys = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(5000)]
    bits, power = R.filter_of(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert all(bits[(k & ((1 << power) - 1)) >> 3] >> (k & 7) & 1 for k in keys) and power == 17
    assert sum(bin(b).count("1") for b in bits) <= 5000
