"""Kinds of personal data that labelers decide, on planted rows with look-alikes."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pii

# planted: text before, the span, text after (varied below); look-alikes: no span of the kind
GIVEN = ["John", "Maria", "Hans", "Pierre", "Laura", "Petra", "Diego", "Emily"]
FAMILY = ["Okafor", "Lindqvist", "Müller", "Duval", "Herrera", "Tanaka", "Novak", "O’Brien"]
FILLER = ["thon", "eredhan", "stinge", "orelle", "anden", "queció", "leich", "therre", "ingston"]


def _filler(rnd, n):
    return " ".join(rnd.choices(FILLER, k=n))


def _planted(kind, rnd):
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    first, last = rnd.choice(GIVEN), rnd.choice(FAMILY)
    if kind == "name":
        return rnd.choice([("wrote to Mr. ", f"Zoran {last}", ", as"), ("signed ", f"John {last}", " (ill)"),
                           ("Contact: ", f"Laura {last}", ", there"), ("with Frau ", f"Petra {last}", " lives"),
                           ("customer ", f"Pierre D. {last}", " born ")])
    if kind == "address":
        return rnd.choice([("address: ", f"{rnd.randint(1, 9000)} Oak Street", f", {last}"),
                           ("lives at ", f"{rnd.randint(1, 900)} Park Avenue", ", " + str(rnd.randint(10000, 99999))),
                           ("wohnhaft in der ", f"Bahnhofstraße {rnd.randint(1, 99)}", ", 80331"),
                           ("habite ", f"{rnd.randint(1, 99)} rue de la République", ", 69002")])
    if kind == "birth_date":
        day, month, year = rnd.randint(1, 28), rnd.randint(1, 12), rnd.randint(1930, 2009)
        return rnd.choice([("was born on ", f"{day:02d}/{month:02d}/{year}", " in Lyon"),
                           ("date of birth: ", f"{year}-{month:02d}-{day:02d}", " and"),
                           ("geboren am ", f"{day}.{month}.{year}", " in Bonn"),
                           ("née le ", f"{day} mars {year}", " à")])
    if kind == "identity":
        return rnd.choice([("SSN: ", f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", " and"),
                           ("her social security number ", f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", ","),
                           ("DNI ", digits(8) + "K", " de"), ("IBAN: ", f"DE{rnd.randint(10, 99)} 3704 0044 0532 0130 {rnd.randint(10, 99)}", ".")])
    return rnd.choice([("call ", f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", " today"),
                       ("phone: ", f"{rnd.randint(200, 999)}-555-{rnd.randint(1000, 9999)}", " or"),
                       ("Tel. ", f"030 {rnd.randint(1000, 9999)} {rnd.randint(100, 999)}", " bis")])


def _look_alike(rnd):
    n = rnd.randint
    return rnd.choice([
        f"published {n(2000, 2024)}-{n(10, 12)}-{n(10, 28)} in", f"version {n(1, 28):02d}.{n(1, 12):02d}.{n(1990, 2009)}",
        f"invoice {n(100, 665)}-{n(10, 99)}-{n(1000, 9999)}", f"part A{n(100000, 999999)}", f"order {n(10000000, 99999999)}X",
        f"the {n(1, 28)} March {n(1900, 2009)} battle", f"isbn 978-{n(10, 99)}-{n(1000, 9999)}-{n(100, 999)}",
        f"sum of {n(100, 999)} {n(100, 999)} {n(100, 999)}", "in Lake Victoria Falls", f"at {n(10, 23)} of the Way"])


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(11)
    kinds = [f.kind for f in pii.FAMILIES if f.kind != "secret"]
    rows, truth = [], {}
    for i in range(1500):
        lead = _filler(rnd, rnd.randint(0, 9)) + " "
        if i % 2:
            rows.append((i, lead + _look_alike(rnd) + " " + _filler(rnd, 5)))
            truth[i] = None
        else:
            kind = kinds[i // 2 % len(kinds)]
            before, span, after = _planted(kind, rnd)
            at = len(lead + before)
            rows.append((i, lead + before + span + after + " " + _filler(rnd, 4)))
            truth[i] = f"{kind}:{at}:{at + len(span)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"].split(",") if r["spans"] else []
           for r in pii.find(docs, pii.train(docs)).collect()}
    return truth, got


@pytest.mark.parametrize("kind", [f.kind for f in pii.FAMILIES if f.kind != "secret"])
def test_precision_and_recall(found, kind):
    truth, got = found
    planted = {i for i, t in truth.items() if t and t.startswith(kind + ":")}
    hits = [(i, s) for i, spans in got.items() for s in spans if s.startswith(kind + ":")]
    right = sum(truth[i] == s for i, s in hits)
    assert len(planted) > 100
    assert right / len(planted) >= 0.9, (kind, right, len(planted))
    assert right / max(1, len(hits)) >= 0.95, [h for h in hits if truth[h[0]] != h[1]][:5]


def test_clean_texts_have_no_span(found):
    truth, got = found
    clean = [i for i, t in truth.items() if t is None]
    assert sum(bool(got[i]) for i in clean) <= 0.03 * len(clean)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, "x"), (2, "Mr. " + "Abc " * 30_000), (3, "1 " * 50_000), (4, "Mr. \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(docs, pii.train(docs)).select("doc_id", "spans", "n_spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_spans"] == (len(r["spans"].split(",")) if r["spans"] else 0)
    none = docs.where(F.lit(False))
    assert pii.train(none) == [] and pii.find(none, []).count() == 0
