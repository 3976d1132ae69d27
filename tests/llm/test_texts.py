"""Problems 8 and 9 on made-up texts: every disguise, edits up to the bound, and what must not be found."""

import random

import numpy as np
import pytest

from lattica.llm import leakage, pii
from lattica.session import written

# ------------------------------------------------------------------------------------------ problem 8

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "zu") for b in ("bel", "dor", "fin", "gam", "hul", "jer", "kol", "lim", "mon", "nip", "par", "qua")]


def passage(rng, n=80):
    s = " ".join(rng.choice(WORDS) for _ in range(n)).split()
    return ". ".join(" ".join(s[i : i + 10]).capitalize() for i in range(0, n, 10)) + "."


def noise(rng, n):
    return " ".join("x" + rng.choice(WORDS) for _ in range(n))


def edited(rng, words, share):
    out = []
    for w in words:
        if rng.random() < share:
            out += rng.choice([[], ["changed"], [w, "added"]])
        else:
            out.append(w)
    return out


def test_words_do_not_depend_on_form():
    plain = leakage.words_of("The freeze-thaw ratio settles at 1.369, unless it fails.")
    for form in (
        "THE FREEZE-THAW RATIO SETTLES AT 1.369 UNLESS IT FAILS",
        "the freezethaw ratio settles at 1369 unless it fails",
        "The <b>freeze-thaw</b> ratio <span class=\"x\">set</span>tles\nat **1.369**, unless\xa0it fails.",
        "The fre​eze-th​aw ratio sett­les at 1.369, un-\nless it fails.",
        "Тhe frеeze‑thaw rаtio settles at 1.369, unless it fаils.".replace("Т", "T"),
        "Ｔｈｅ　ｆｒｅｅｚｅ－ｔｈａｗ ｒａｔｉｏ settles at 1.369; unless it fails",
        "[10:01] The freeze-thaw ratio\n[10:02] settles at 1.369, unless it fails.",
        "The freeze-thaw ratio settles\\nat 1.369, unless it fails.",
        "The freeze-thaw ratio&nbsp;settles at 1.369, unless it fails.",
    ):
        assert leakage.words_of(form) == plain, form
    assert leakage.words_of(None) == leakage.words_of("") == leakage.words_of(" \n") == []


def test_leaks_are_found_and_quotations_are_not(spark):
    rng = random.Random(4)
    items = [(100 + i, passage(rng, rng.choice([50, 80, 120]))) for i in range(12)] + [(200, None), (201, "")]
    docs, want = [], set()
    for k in range(240):
        item, text = rng.choice(items[:12])
        words = leakage.words_of(text)
        n = len(words)
        kind = k % 8
        if kind == 0:
            body = text
        elif kind == 1:  # a bit more than half
            a = rng.randint(0, n - n * 6 // 10 - 1)
            body = " ".join(words[a : a + n * 6 // 10 + 1])
        elif kind == 2:  # two stretches
            a = rng.randint(n * 3 // 10, n // 2)
            body = " ".join(words[:a]) + " " + noise(rng, 18) + " " + " ".join(words[a + n // 10 :])
        elif kind == 3:
            body = " ".join(edited(rng, words, 0.08))
        elif kind == 4:
            body = "".join(c + ("​" if rng.random() < 0.1 else "") for c in text.upper())
        elif kind == 5:  # a short quotation
            body = " ".join(words[: n // 4])
        elif kind == 6:  # the words in another order
            body = " ".join(rng.sample(words, n))
        else:
            body = noise(rng, 60)
        docs.append((k, noise(rng, rng.randint(0, 40)) + " " + body + " " + noise(rng, rng.randint(0, 40))))
        if kind < 5:
            want.add((k, item))
    docs += [(900, None), (901, ""), (902, " "), (903, docs[0][1]), (904, noise(rng, 60_000) + " " + items[0][1])]
    want |= {(903, i) for k, i in want if k == 0} | {(904, 100)}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d.repartition(3), q).collect()}
    assert got == want
    assert leakage.find_leaks(d.where("false"), q).count() == 0
    assert leakage.find_leaks(d, q.where("false")).count() == 0


def test_half_copies_in_two_far_stretches_are_found(spark):
    rng = random.Random(11)
    items = [(k, passage(rng, 50 + k)) for k in range(41)]
    docs = []
    for k, text in items:
        words = leakage.words_of(text)
        n = len(words)
        cut = -(-n // 2)
        short = cut // 2 if k % 2 else rng.randint(n // 6, cut // 2)  # even stretches, and a long and a short one
        b = rng.randint(short, n - cut + short)
        docs.append((k, " ".join([noise(rng, 30), *words[:short], noise(rng, 400), *words[b : b + cut - short], noise(rng, 30)])))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, q).collect()}
    assert got == {(k, k) for k, _ in items}


def _accepted(passage, words):
    """Whether the alignment alone, without any search, accepts a document."""
    code = {w: i for i, w in enumerate(sorted(set(passage)))}
    p = np.array([code[w] for w in passage])
    d = np.array([code.get(w, -1) for w in words])
    i, j = np.nonzero((p[:-1, None] == d[None, :-1]) & (p[1:, None] == d[None, 1:]))
    states = leakage.aligned(leakage._runs(i, j), p, d)
    return bool(leakage.leaks(states[:, 0], states[:, 1], len(p)).any())


@pytest.mark.parametrize("kind", ["one", "two"])
@pytest.mark.parametrize("edits", ["random", "rarest", "singles"])
def test_search_finds_all_that_the_alignment_accepts(spark, kind, edits):
    rng = random.Random(f"{kind} {edits}")
    # words of very different frequency, so that pairs are shared by many passages
    stock = WORDS[:12]
    draw = lambda: rng.choice(stock) if rng.random() < 0.5 else rng.choice(WORDS)
    items = {k: [draw() for _ in range(rng.randint(18, 150))] for k in range(60)}
    count = {w: sum(ws.count(w) for ws in items.values()) for w in WORDS}
    docs = {}
    for k, ws in items.items():
        n = len(ws)
        half = -(-n // 2) + rng.randint(0, 2)
        if kind == "one":
            a = rng.randint(0, n - half)
            body = [ws[a : a + half]]
        else:
            short = rng.randint(half // 5, half // 2)
            b = rng.randint(short, n - half + short)
            body = [ws[:short], ws[b : b + half - short]]
        most = half // 8 + rng.randint(-1, 1)
        places = [(x, y) for x, part in enumerate(body) for y in range(len(part))]
        if edits == "rarest":
            chosen = sorted(places, key=lambda xy: count[body[xy[0]][xy[1]]])[: max(0, most)]
        elif edits == "random":
            chosen = rng.sample(places, max(0, most))
        else:  # every second word, so that single words stand between edits
            chosen = [(0, 2 * y + 3) for y in range(max(0, most)) if 2 * y + 3 < len(body[0]) - 1]
        body = [list(part) for part in body]
        for x, y in chosen:
            body[x][y] = "edited"
        gap = [draw() for _ in range(rng.choice([3, 40]))]
        docs[k] = [draw() for _ in range(20)] + body[0] + gap + (body[1] if len(body) > 1 else []) + [draw() for _ in range(20)]
    d = spark.createDataFrame([(k, " ".join(ws)) for k, ws in docs.items()], "doc_id long, text string")
    q = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d.repartition(2), q).collect()}
    want = {(k, i) for k, words in docs.items() for i, ws in items.items() if _accepted(ws, words)}
    assert got == want
    assert len({(k, k) for k in items} & want) >= (0 if edits == "singles" else 45)


def test_copies_with_one_changed_word_in_eight_pass_the_alignment():
    rng = random.Random(5)
    for n in (20, 56, 89, 131, 148):
        kept = 0
        for _ in range(150):
            ws = [rng.choice(WORDS) for _ in range(n)]
            doc = list(ws)
            for k in rng.sample(range(n), n // 8):
                doc[k] = "edited"
            kept += _accepted(ws, doc)
        assert kept >= 149, n


def test_an_index_serves_any_passages(spark):
    rng = random.Random(9)
    items = [(k, passage(rng, 60)) for k in range(4)]
    d = spark.createDataFrame([(k, noise(rng, 50) + " " + t) for k, t in items], "doc_id long, text string")
    index = written(leakage.segments(d), "index")
    for k, t in items:
        one = spark.createDataFrame([(k, t)], "item_id long, passage string")
        assert [(r.doc_id, r.item_id) for r in leakage.find_leaks(d, one, index=index).collect()] == [(k, k)]


def test_short_passages_need_half_of_their_words(spark):
    items = spark.createDataFrame([(1, "kebel"), (2, "lodor mifin"), (3, "nugam rahul sejer tikol")], "item_id long, passage string")
    docs = spark.createDataFrame([(10, "x kebel y"), (20, "a lodor mifin b"), (30, "c nugam rahul sejer d"), (40, "e tikol f")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == {(10, 1), (20, 2), (30, 3)}


def test_alignment_counts_words_in_order():
    p = np.arange(40)
    assert leakage.repeated(p, np.r_[np.full(5, -1), p, np.full(3, -1)]) == (40, 40)
    assert leakage.repeated(p, np.r_[p[:15], np.full(30, -1), p[20:]]) == (35, 35)
    assert leakage.repeated(p, np.r_[p[20:], np.full(9, -1), p[:15]])[0] == 20  # not in order
    cover, same = leakage.repeated(p, np.r_[p[:10], [-1], p[11:30]])
    assert (cover, same) == (30, 29)
    assert leakage.repeated(p, np.full(9, -1)) == (0, 0)


def test_segments_of_any_size_find_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = [(1, passage(rng, 60)), (2, passage(rng, 60))]
    docs = [(k, noise(rng, 30) + " " + items[k % 2][1] + " " + noise(rng, 30)) for k in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, passage string")
    want = sorted((k, 1 + k % 2) for k in range(20))
    for size in (50, 500, 1 << 20):
        monkeypatch.setattr(leakage, "SEGMENT_WORDS", size)
        assert sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(d, q).collect()) == want


# ------------------------------------------------------------------------------------------ problem 9

NAMES = {"hana": True, "linnea": True, "korvevane": False, "brimolthe": False, "ostingrave": False}


def spans(text, kinds=frozenset(pii.KINDS)):
    return [(k, text[a:z]) for a, z, k in pii.find_spans(text, NAMES, kinds)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Contact Hana Korvevane at hana.korvevane+qc@lab.example.org about plate 3.", [("name", "Hana Korvevane"), ("email", "hana.korvevane+qc@lab.example.org")]),
        ("mail korvevane-h [at] lab [dot] example, or H_K @ x.example.", [("email", "korvevane-h [at] lab [dot] example"), ("email", "H_K @ x.example")]),
        ("write to hk AT lab DOT example DOT org or hk (at) lab.example", [("email", "hk AT lab DOT example DOT org"), ("email", "hk (at) lab.example")]),
        ("pairs@212.33, @cached and name@version", []),
        ("Signed: H.L. Brimolthe-Korvevane and Linnea M. Ostingrave's notes", [("name", "H.L. Brimolthe-Korvevane"), ("name", "Linnea M. Ostingrave")]),
        ("cc: Brimolthe, Hana-Linnea; KORVEVANE and linnea brimolthe", [("name", "Brimolthe, Hana-Linnea"), ("name", "KORVEVANE"), ("name", "linnea brimolthe")]),
        ("Le dossier de M. Ostingrave porte le numéro 1 31 99 12 434 266 76", [("name", "Ostingrave"), ("id_number", "1 31 99 12 434 266 76")]),
        ("La muestra de M. Ostingrave tiene el número 666-35-2462", [("name", "M. Ostingrave"), ("id_number", "666-35-2462")]),
        ("Signed: R. Brimolthe Hana Korvevane noted", [("name", "R. Brimolthe"), ("name", "Hana Korvevane")]),
        ("phone +44 (0)20 7946-0755, 0044 7700 900 995, (02) 5550 1275", [("phone", "+44 (0)20 7946-0755"), ("phone", "0044 7700 900 995"), ("phone", "(02) 5550 1275")]),
        ("617.555.0118 (evenings 030/23125065) or 1-202-555-0103, 6175550125", [("phone", "617.555.0118"), ("phone", "030/23125065"), ("phone", "1-202-555-0103"), ("phone", "6175550125")]),
        ("01 99 00 95 30, +49 30 23125 621, 07700 900044, (415) 555-0161", [("phone", "01 99 00 95 30"), ("phone", "+49 30 23125 621"), ("phone", "07700 900044"), ("phone", "(415) 555-0161")]),
        ("QTX 555 0186; number 430-9294-278; Lot 8658-9055-23A; DOI 10.5555/qtx.89292; chr17:117123950-118891448; 10.0.2.36", []),
        ("Counts per gene: 4412 827 357, then 7754 6038 and 5; Ticket 984-42-99870; ENSG001022245667; BA784468R", []),
        ("ID QQ 12 89 72 D, qq-92-31-46-a, QQ455444D, passport XZ0851853, 913195876, 297995169417754", [("id_number", x) for x in ("QQ 12 89 72 D", "qq-92-31-46-a", "QQ455444D", "XZ0851853", "913195876", "297995169417754")]),
        ("moved to Flat 27, 83 Larkspur Street and Unit 20/177B Old Tannery St.; 209 SALTMARSH BOULEVARD", [("address", "Flat 27, 83 Larkspur Street"), ("address", "Unit 20/177B Old Tannery St."), ("address", "209 SALTMARSH BOULEVARD")]),
        ("an Tannhofstr. 35 b, Eichenkampstraße 201a, Moorwieser Weg 27 b, Altmühlplatz 55.", [("address", "Tannhofstr. 35 b"), ("address", "Eichenkampstraße 201a"), ("address", "Moorwieser Weg 27 b"), ("address", "Altmühlplatz 55")]),
        ("au 34 bis avenue du Vieux Moulin-Noir, 233, rue des Orvets, Calle del Tejar, 239, Paseo de la Noria 44", [("address", "34 bis avenue du Vieux Moulin-Noir"), ("address", "233, rue des Orvets"), ("address", "Calle del Tejar, 239"), ("address", "Paseo de la Noria 44")]),
        ("Park tubes at rack 99 Row Street-side; the Kestrel Lane protocol, version 9; fails ring 01 99 00 95 30", [("phone", "01 99 00 95 30")]),
        ("", []),
    ],
)
def test_forms(text, want):
    assert spans(text) == want


def test_nothing_in_null():
    assert pii.find_spans(None, NAMES) == []


def corpus(spark):
    rng = random.Random(3)
    given, family = ["Hana", "Linnea", "Pavel"], ["Korvevane", "Brimolthe", "Ostingrave", "Thalmurel"]
    docs = []
    for k in range(300):
        g, f = rng.choice(given), rng.choice(family)
        line = rng.choice([f"Contact {g} {f} at {g.lower()}.{f.lower()}@lab.example about plate {k}.", f"{g} {f} ({g[0].lower()}{f.lower()}@lab.example) signed off run {k}.", f"Dr. {f} wants plate {k} before Friday.", f"Signed: {g[0]}. {f}", "The Halvik Rank test and the Kelm-Oster correction agree."])
        docs.append((k, "The plate was thawed twice. " + line + " The reader stopped at step 4."))
    docs += [(900, None), (901, ""), (902, "linnea THALMUREL moved to 12 Kestrel Lane"), (903, docs[0][1])]
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def test_names_are_learned_from_what_tells_them(spark):
    docs, df = corpus(spark)
    lex = {r.term: r.given for r in pii.names_lexicon(pii.disclosure(df)).collect()}
    assert lex == {"hana": True, "linnea": True, "pavel": True, "korvevane": False, "brimolthe": False, "ostingrave": False, "thalmurel": False}
    got = {(r.doc_id, r.pii_kind, r.pii_text) for r in pii.find_pii(df, pii.corpus_lexicon(df)).collect()}
    assert {(902, "name", "linnea THALMUREL"), (902, "address", "12 Kestrel Lane")} <= got
    assert not any(w in t for _, _, t in got for w in ("Halvik", "Kelm", "Oster", "Friday"))
    assert {(k, t) for d, k, t in got if d == 903} == {(k, t) for d, k, t in got if d == 0}


def test_large_lexicon_goes_by_join(spark, monkeypatch):
    _, df = corpus(spark)
    lex = pii.corpus_lexicon(df)
    a = {tuple(r) for r in pii.find_pii(df, lex).collect()}
    monkeypatch.setattr(pii, "MOST_TERMS", 2)
    assert {tuple(r) for r in pii.find_pii(df, lex).collect()} == a


def test_placeholders_leave_the_rest(spark):
    _, df = corpus(spark)
    out = {r.doc_id: r for r in pii.sanitise(df, pii.corpus_lexicon(df)).collect()}
    assert len(out) == df.count()
    assert out[902].text == "[NAME] moved to [ADDRESS]" and out[902].removed == 2
    assert out[900].text is None and out[901].text == "" and out[901].removed == 0
    found = pii.find_pii(df, pii.corpus_lexicon(df)).collect()
    assert not any(r.pii_text in (out[r.doc_id].text or "") for r in found)


def test_an_empty_corpus(spark):
    _, df = corpus(spark)
    none = df.where("false")
    assert pii.find_pii(none, pii.corpus_lexicon(none)).count() == 0
    assert pii.disclosure(none).count() == 0


def test_vector_patterns_miss_nothing(spark, small):
    import pyarrow as pa

    docs = spark.read.parquet(f"{small}/documents.parquet")
    lex = {r.term: r.given for r in pii.names_lexicon(pii.disclosure(docs)).collect()}
    texts = [r.text for r in docs.select("text").collect()]
    got = pii.spans_of(pa.array(texts, pa.string()), lex)
    assert got == {i: s for i, t in enumerate(texts) if (s := pii.find_spans(t, lex))}


def test_shapes_without_persons_near_them_are_harmless(spark):
    people = [f"Contact Dr Anna Kranz{i % 3}er, QQ 12 34 {10 + i % 80} A, anna.kranzer@lab.example, 020 7946 0{100 + i}." for i in range(30)]
    plain = ["The run of tube BA1234%02dD was repeated and all counts agree with those of the batch before. " % (i % 90) * 8 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(people + plain)) + [(900, None), (901, "")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("anna", True), ("kranz", False)], "term string, given boolean")
    found = pii.find_pii(docs, lexicon).collect()
    assert sum(r.pii_kind == "id_number" for r in found) == 30 and not any(r.pii_text.startswith("BA") for r in found)
    shapes = {r["shape"]: r.npmi for r in pii.shapes(written(pii.candidates(docs, lexicon), "c")).collect()}
    assert shapes["id_number BA999999D"] < pii.SHAPE_DISCLOSURE < shapes["id_number QQ 99 99 99 A"]
    clean = {r.doc_id: r for r in pii.sanitise(docs, lexicon).collect()}
    assert "[ID_NUMBER]" in clean[0].text and clean[45].text == plain[15] and clean[45].removed == 0 and clean[900].text is None
    # a shape that is seen once counts as personal
    one = spark.createDataFrame([(1, "tube BA123456D")], "doc_id long, text string")
    assert [r.pii_kind for r in pii.find_pii(one, lexicon).collect()] == ["id_number"]
    assert pii.find_pii(one.where("false"), lexicon).count() == 0
