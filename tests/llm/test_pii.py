import random
import time

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import pii

PEOPLE = [(g, f) for g, f in zip(["Bren", "Grerkie", "Zumil", "Romie", "Wila", "Hion"], ["Staston", "Stealelle", "Leastwick", "Trisnustov", "Rindhuelle", "Nunez"])]
BRANDS = ["Staston Audio", "Nunez & Co", "Lilhe Labs"]


def corpus(n=600, seed=0):
    """Texts with known spans: (text, {(kind, start)})."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, spans = "", set()

        def say(*parts):
            nonlocal text
            for p in parts:
                if isinstance(p, tuple):
                    spans.add((p[0], len(text)))
                    p = p[1]
                text += p

        g, f = rng.choice(PEOPLE)
        name = ("name", rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {f}".upper(), f"{g}\xa0{f}"]))
        mail = ("email", rng.choice([f"{g}.{f}@shop.example", f"{f}_{g} [at] shop.example", f"{g}50 (at) shop dot test", f"{g}＠shop.example"]).lower())
        phone = ("phone", rng.choice(["+1 555 555 0131", "(376) 555-0161", "020 7946 0490", "+49 30 23125 591", "01 99 00 22 65", "0049-30-23125614", "364.555.0114 ext. 57"]))
        number = ("idnumber", rng.choice(["932-20-7236", "935 24 9965", "671015-0000", "XQ3532628", "00239960K", "01 399 998 295"]))
        place = ("address", rng.choice(["39 Lesgruford Street", "2160 West Brark Boulevard", "12 bis rue de Seby", "Calle Jalstad, 14", "Klerkwickstraße 36", "Leby Allee 92a", "1531 Drenville St."]))
        for _ in range(3):
            rng.choice(
                [
                    lambda: say("Reported by ", name, ", reachable at ", mail, ". "),
                    lambda: say("Call ", name, " on ", phone, " about the Jaudo lamp 936. "),
                    lambda: say("The customer (", name, ", ", number, ") lives at ", place, " since last year. "),
                    lambda: say("Ask Mr ", ("name", f), " before you touch the branch. "),
                    lambda: say("Adresse: ", place, " | Tel. ", phone, " "),
                    lambda: say("SSN ", number, " was pasted into the ticket by mistake. "),
                    lambda: say(f"SKU AAA-{rng.randrange(9999)} was merged into BBB-1 by {rng.choice(BRANDS)}. "),
                    lambda: say(f"Order {rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}-{rng.randrange(10, 99)} left the pivot. "),
                    lambda: say(f"Parcel ref {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)} 0561 is light. "),
                    lambda: say(f"Pinned tokenkit@3.{rng.randrange(9)}.28 and document@main. Since {f} Audio renamed its lamp line. "),
                    lambda: say(f"{rng.randrange(99)} desks were moved to Nolem Street Collection. 🙂 "),
                ]
            )()
        out.append((text, spans))
    return out


def score(found, true):
    hit = len(found & true)
    return hit / max(1, len(found)), hit / max(1, len(true))


def fitted(texts, people=PEOPLE, brands=BRANDS):
    finder = pii.Finder(people, brands)
    first = pii.learned([s for t in texts for s in finder.names(pii.read(t))])
    finder = finder.with_contexts(first)
    contexts, spans = pii.settled(first, [s for t in texts for s in finder.spans(t)])
    return finder.with_contexts(contexts), pii.train(spans)


@pytest.fixture(scope="module")
def trained():
    return fitted([t for t, _ in corpus(500, 1)])


def test_held_out_accuracy(trained):
    finder, classifier = trained
    found, true = set(), set()
    for i, (text, spans) in enumerate(corpus(400, 2)):
        true |= {(i, *s) for s in spans}
        found |= {(i, s.kind, s.start) for s in finder.found(text, classifier)}
    for kind in pii.KINDS:
        precision, recall = score({x for x in found if x[1] == kind}, {x for x in true if x[1] == kind})
        assert precision >= 0.97 and recall >= 0.97, (kind, precision, recall)


def test_sentences_that_training_never_saw(trained):
    """Other sentences, half of the people in no list; other streets, numbers and mails."""
    finder, classifier = trained
    rng = random.Random(5)
    given, family = ["Bren", "Zumil", "Wila", "Drand", "Ilse", "Marou"], ["Staston", "Leastwick", "Nunez", "Vornuelle", "Pralunov", "Hertwick"]
    found, true = set(), set()
    for i in range(400):
        g, f = rng.choice(given), rng.choice(family)
        name = rng.choice([f"{g} {f}", f"{g[0]}. {f}"])
        mail = rng.choice([f"{g}.{f}@mail.example", f"{f}-{g}@post.example.org", f"{g} [at] desk dot example", f"{'long-' * 20}{g}@mail.example"]).lower()
        phone = rng.choice(["+44 20 7946 0112", "(212) 555-0199", "+33 1 99 00 11 22", "+34 912 345 678", "212-555-0108"])
        number = rng.choice(["912-33-4821", "801231-4821", "AB1234567", "12345678Z"])
        place = rng.choice(["12 Market Parade", "7 Elm Grove", "221b Baker Street", "9 rue du Bac", "Calle Mayor, 8", "Lindenallee 4", "40 Old Mill Lane"])
        kind, before, text, after = rng.choice(
            [
                ("name", "Yesterday we met ", name, " at the fair."), ("name", "Lunch with ", name, " was short."), ("name", "Then ", name, " told us more."), ("name", "Please thank Dr. ", f, " for it."),
                ("email", "Forward it to ", mail, " before noon."), ("email", "Her address is ", mail, " now."), ("phone", "His mobile is ", phone, " these days."), ("phone", "Fax ", phone, " was busy."),
                ("idnumber", "Her passport ", number, " has expired."), ("idnumber", "Tax number ", number, " is on file."), ("address", "They moved to ", place, " in May."), ("address", "Deliver at ", place, " please."),
                (None, f"Order 4{rng.randrange(10, 99)}-12-3456-78 of the {f} lamp was late, ", "", "said nobody."), (None, "The Pivot Table and the Night Shift of ", "", "Staston Audio are slow."), (None, f"Release 3.{rng.randrange(99)}.12 fixes ", "", "cache@main and the West Street Collection."),
            ]
        )
        line = before + text + after
        if kind:
            true.add((i, kind, len(before)))
        found |= {(i, s.kind, s.start) for s in finder.found(line, classifier)}
    for kind in pii.KINDS:
        precision, recall = score({x for x in found if x[1] == kind}, {x for x in true if x[1] == kind})
        assert precision >= 0.95 and recall >= 0.95, (kind, precision, recall, sorted(found - true)[:5], sorted(true - found)[:5])


def test_unlisted_people_in_other_sentences(trained):
    finder, classifier = trained

    def names(text):
        return [text[s.start : s.end] for s in finder.found(text, classifier) if s.kind == "name"]

    for text in ["Thanks to {} for the patch.", "Yesterday we met {} at the fair.", "Then {} told us more.", "Lunch with {} was short.", "Ticket 7: {} fixed the lamp."]:
        for name in ("Drand Marquelle", "Ilse Vornuelle", "D. Marquelle"):
            assert names(text.format(name)) == [name], text.format(name)
    assert names("Please thank Ms. Marquelle for it.") == ["Marquelle"]
    for text in ["The Marquelle lamp and the Pivot Table are slow.", "Since Marquelle Audio renamed it, West Street is empty.", "features.name: Cold, Failed, Quick\nFixed it.", "ALL OF THE FRAGILE CARDS MOVED."]:
        assert names(text) == [], text


def test_contexts_are_learned(trained):
    finder, classifier = trained
    assert {"Reported by ", "Call "} <= finder.contexts.leading and "Since " not in finder.contexts.before
    lower = "Reported by drand marquelle, reachable at d@x.example."
    assert {lower[s.start : s.end] for s in finder.found(lower, classifier)} == {"drand marquelle", "d@x.example"}
    plain, _ = fitted(["Reported by Drand Marquelle, reachable at home. Since Marquelle Audio."] * 50, people=[])
    assert plain.contexts == pii.Contexts()  # nobody is listed, nothing is learned


def test_no_reach_is_bounded(trained):
    finder, classifier = trained
    local = "a" + "b-" * 5000 + "c"
    far = "Mail " + " " * 3000 + f"{local}@x.example and {local} at desk dot example"
    assert [s.start for s in finder.found(far, classifier) if s.kind == "email"][0] == far.index(local)
    assert pii._words_before("alpha" + " " * 5000 + "beta" + " " * 700, 5709 - 5, 2) == ["beta", "alpha"]
    many = "Call Bren Staston on +1 555 555 0131. " * 6000
    began = time.perf_counter()
    assert sum(s.kind == "name" for s in finder.found(many, classifier)) == 6000
    assert time.perf_counter() - began < 30


def test_phones_give_way_to_accepted_idnumbers_only():
    finder = pii.Finder(PEOPLE, BRANDS)
    for phone in ("+34 912 345 678", "+48 512 345 678", "+61 412 345 678"):
        spans = finder.spans(f"Call Bren Staston on {phone} today.")
        assert [(s.start, s.end) for s in spans if s.kind == "phone"] == [(21, 21 + len(phone))]
        assert not [s for s in spans if s.kind == "idnumber"]
    text = "SSN 01 399 998 295 was pasted."
    kinds = lambda accepts: {s.kind for s in finder.spans(text, accepts)}
    assert kinds(None) == kinds(lambda s: True) == {"idnumber"} and kinds(lambda s: False) == {"idnumber", "phone"}


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    right = [0.95, 0.9, 0.85, 0.5]  # the last is a coin
    votes = np.stack([np.where(rng.random(3000) < 0.2, 0, np.where((rng.random(3000) < r) == truth, 1, -1)) for r in right], axis=1)
    likely, table = pii.reliabilities(votes)
    assert ((likely > 0.5) == truth).mean() > 0.93
    sharp = [t[1, 2] / max(t[1, 0] + t[1, 2], 1e-9) for t in table]
    assert sharp[0] > sharp[3] + 0.2 and abs(sharp[3] - 0.5) < 0.12


def test_reading_keeps_places():
    odd = "a\xa0b‑c＠ｄ　İ🙂é"
    assert len(pii.read(odd)) == len(odd) and pii.read(odd).startswith("a b-c@d ")
    finder = pii.Finder(PEOPLE, BRANDS)
    assert finder.spans(None) == finder.spans("") == finder.spans(" \n") == []
    text = "İİ🙂 Reported by Bren Staston, reachable at bren@x.test."
    assert {(s.kind, s.start) for s in finder.spans(text)} == {("name", text.index("Bren")), ("email", text.index("bren@"))}


def test_dataframes(spark):
    made = corpus(200, 3)
    rows = [(i, t) for i, (t, _) in enumerate(made)] + [(1000, None), (1001, ""), (1002, "x " * 300_000 + made[0][0]), (None, made[1][0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'n' AS name", "1 AS pii_kind")
    people = spark.createDataFrame([*PEOPLE, (None, None), ("Only", None), *PEOPLE], "given_name string, family_name string")
    brands = spark.createDataFrame([(b,) for b in [*BRANDS, None]], "name string")
    found = pii.find(df, people, brands)
    got = {(r.doc_id, r.pii_kind, r.start_pos) for r in found.collect()}
    true = {(i, *s) for i, (_, spans) in enumerate(made) for s in spans}
    precision, recall = score({x for x in got if x[0] is not None and x[0] < 1000}, true)
    assert precision >= 0.95 and recall >= 0.95
    assert {(k, p - 600_000) for d, k, p in got if d == 1002} == {(k, p) for d, k, p in got if d == 0}
    redacted = {r.doc_id: r.redacted for r in pii.redact(df, people, brands).collect()}
    assert redacted[1000] is None and redacted[1001] == "" and len(redacted) == len(rows)
    every = " ".join(t for t in redacted.values() if t)
    assert "[EMAIL]" in every and "@shop" not in every and "555 0131" not in every and "7946 0490" not in every
    assert pii.find(df.limit(0), people, brands).count() == 0
    assert pii.find(df, people.limit(0)).where("pii_kind = 'email'").count() > 0


def test_few_spans_are_kept_of_many():
    held = type("B", (), {"value": ("few", PEOPLE, BRANDS, pii.Contexts())})()
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([t for t, _ in corpus(50, s)])], ["text"]) for s in range(4)])
    every = sum(b.num_rows for b in pii._Propose(held)(batches()))
    few = [b for b in pii._Propose(held, most=60)(batches())]
    assert every > 200 and sum(b.num_rows for b in few) == 60 and {k.as_py() for b in few for k in b["kind"]} > {"name", "phone"}


def test_large_gazetteers_are_refused(spark, monkeypatch):
    monkeypatch.setattr(pii, "GAZETTEER_ROWS", 2)
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        pii.find(df, spark.createDataFrame(PEOPLE, "given_name string, family_name string"))


def test_contexts_come_from_all_documents(spark):
    """Few of many documents tell of a context; a sample of the documents would miss it."""
    few = [f"Signed off: {g} {f}, thanks." for g, f in PEOPLE[:4]] + ["Signed off: drand marquelle, thanks."]
    many = [t for t, _ in corpus(300, 4)] + ["A desk was moved."] * 60_000
    df = spark.createDataFrame(list(enumerate(few + many)), "doc_id bigint, text string").repartition(8, "doc_id")
    people, brands = spark.createDataFrame(PEOPLE, "given_name string, family_name string"), spark.createDataFrame([(b,) for b in BRANDS], "name string")
    found = pii.find(df, people, brands).where("doc_id < 5 AND pii_kind = 'name'").collect()
    assert sorted((r.doc_id, r.start_pos) for r in found) == [(i, 12) for i in range(5)]


def test_spark_learns_what_one_process_learns(spark, monkeypatch):
    texts = [t for t, _ in corpus(300, 5)]
    df = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, " ")], "doc_id bigint, text string").repartition(5)
    people, brands = spark.createDataFrame(PEOPLE, "given_name string, family_name string"), spark.createDataFrame([(b,) for b in BRANDS], "name string")
    fit = pii._fit
    monkeypatch.setattr(pii, "_fit", lambda totals, slopes: fit(totals, slopes, rounds=8))
    finder, classifier = fitted(texts)
    learned = []
    for rows in (pii.FIT_ROWS, 0):  # fitted by the driver; by jobs
        monkeypatch.setattr(pii, "FIT_ROWS", rows)
        _, gazetteers, made = pii._prepared(df, people, brands, "doc_id", "text", "given_name", "family_name", "name")
        contexts = gazetteers.value[3]
        assert contexts.before == finder.contexts.before and contexts.after == finder.contexts.after and contexts.leading == finder.contexts.leading
        assert all((c in finder.contexts.not_before) for c in contexts.not_before) and {c for c in finder.contexts.not_after if " " not in c} == contexts.not_after
        learned.append(made.value.weights)
    for weights in learned:
        assert weights.keys() == classifier.weights.keys() == set(pii.KINDS)
        assert all(np.allclose(weights[k], classifier.weights[k], atol=1e-9) for k in pii.KINDS)


def test_counts_are_given_away_in_parts(monkeypatch):
    held = type("B", (), {"value": ("parts", PEOPLE, BRANDS, pii.Contexts())})()
    texts = pa.RecordBatch.from_arrays([pa.array([i for i in range(80)]), pa.array([t for t, _ in corpus(80, 6)])], ["id", "text"])
    packed = next(iter(pii._Pack(held)(iter([texts]))))

    def summed(made, key, columns):
        out = {}
        for b in made:
            for r in b.to_pylist():
                at = str([r[c] for c in key])
                out[at] = out.get(at, 0) + r[columns]
        return out

    spans, both = packed.select(["spans"]), packed.select(["text", "spans"])
    contexts = lambda: summed(pii._Contexts()(iter([spans])), ("side", "context", "seed"), "n")
    rows = lambda: summed(pii._Rows(held)(iter([both])), ("kind", "votes", "places"), "n")
    whole = contexts(), rows()
    monkeypatch.setattr(pii, "COUNTED", 7)
    assert (contexts(), rows()) == whole and len(list(pii._Rows(held)(iter([both])))) > 3
    assert sum(whole[1].values()) == sum(len(pii.Finder(PEOPLE, BRANDS).spans(t)) for t in texts["text"].to_pylist())


def test_true_spans_stay_together_in_large_tables():
    """Numbers announced in three ways, all of them true; a prior of fixed weight lets a large table part one from the others."""
    patterns = {("idnumber", (0, 0, 0, 1, 1)): 777, ("idnumber", (0, 0, 1, 0, 1)): 791, ("idnumber", (1, 0, 0, 0, 1)): 2342}
    assert min(pii._likelihoods(patterns).values()) < 0.5
    for times in (1, 10, 300):
        likely = pii._likelihoods({k: n * times for k, n in patterns.items()}, 100_000 * times)
        assert min(likely.values()) > 0.9


def test_equal_votes_count_as_often_as_they_are():
    votes = np.array([[1, 0, -1], [1, 1, 0], [1, 1, 0], [0, -1, 0], [0, -1, 0], [0, -1, 0]])
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    every, table = pii.reliabilities(votes)
    few, same = pii.reliabilities(rows, counts=counts.astype(float))
    assert np.allclose(table, same) and np.allclose(np.repeat(few, counts), every[np.lexsort(votes.T[::-1])])
