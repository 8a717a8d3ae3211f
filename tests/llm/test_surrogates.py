import re

import pytest

from shelfcast.llm.surrogates import KEY, _luhn, canonical, detect, render, replace_personal_data, resolve, surrogate

TEXT = ('Write to Ann.Lee@mail.example.org or ANN.LEE@MAIL.EXAMPLE.ORG, call +1 (212) 555-0123 or +1-212-555-0123, '
        'card 4111 1111 1111 1111, from 10.1.2.3, token = "2c8ba23e1529b2de52654cb5a51fb5655bd4ec6f". '
        'Frau Erika Muster and Herr Muster met Mr. SMITH and госпожа Анна Иванова.')


def test_detected_types():
    kinds = [k for _, _, k, _ in detect(TEXT)]
    assert kinds == ["email", "email", "phone", "phone", "card", "ip", "secret", "name", "name", "name", "name"]
    assert list(detect("Version 4.0. of 2024, page 12, the 3 of them.")) == []


def test_format_coreference_and_determinism():
    def both(kind, a, b):
        x, y = canonical(kind, a), canonical(kind, b)
        assert x == y
        return render(kind, a, surrogate(kind, x, "k", 0)), render(kind, b, surrogate(kind, y, "k", 0))

    a, b = both("phone", "+1 (212) 555-0123", "+12125550123")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.sub(r"\D", "", a) == b[1:]
    a, b = both("email", "ann.lee@mail.example.org", "ANN.LEE@MAIL.EXAMPLE.ORG")
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.org", a) and a.upper() == b
    card = render("card", "4111 1111 1111 1111", surrogate("card", "4111111111111111", "k", 0))
    assert re.fullmatch(r"4\d{3}( \d{4}){3}", card) and _luhn(card.replace(" ", "")) == 0
    assert surrogate("ip", "10.1.2.3", "k", 0) != surrogate("ip", "10.1.2.3", "other", 0)
    assert surrogate("ip", "10.1.2.3", "k", 0) != surrogate("ip", "10.1.2.3", "k", 1)
    woman = surrogate("name", canonical("name", "госпожа Анна Иванова"), "k", 0)
    assert re.fullmatch("f [А-Я][а-я]+ [А-Я][а-я]+а", woman)
    assert surrogate("name", canonical("name", "Herr Max Muster"), "k", 0).split()[1] in (
        "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul".split())


def test_documents(documents):
    rows = [(1, TEXT), (2, "again ann.lee@mail.example.org"), (2, "again ann.lee@mail.example.org"), (3, None), (4, ""),
            (None, "10.1.2.3"), (5, "no data here " * 5000)]
    got = replace_personal_data(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = sorted((r.doc_id or 0, r.text or "") for r in got)
    joined = " ".join(t for _, t in texts)
    for value in ("Ann.Lee", "ANN.LEE", "555-0123", "4111", "10.1.2.3", "2c8ba23e", "Erika", "SMITH", "Иванова"):
        assert value not in joined
    again = next(t for k, t in texts if k == 2)
    assert again.split()[1] in joined.split("again")[0] or again.split()[1] in texts[1][1]
    assert {r.n_entities for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert next(r.text for r in got if r.doc_id == 5) == "no data here " * 5000
    assert replace_personal_data(documents([])).collect() == []


@pytest.mark.parametrize("real", [[], ["zz"]])
def test_collisions_are_resolved(spark, real):
    rows = [("secret", f"v{i}", "same") for i in range(40)] + [("secret", r, "other") for r in real]
    rows += [("ip", "1.1.1.1", "2.2.2.2"), ("ip", "2.2.2.2", "3.3.3.3")]
    got = resolve(spark.createDataFrame(rows, "kind string, value string, surrogate string")).collect()
    assert len(got) == len(rows) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.value) for r in got}
    assert {r.value for r in got if r.attempt == 0 and r.surrogate == "same"} == {"v0"}


def _resolved(spark, kind, values):
    rows = [(kind, v, surrogate(kind, v, KEY, 0)) for v in values]
    made = resolve(spark.createDataFrame(rows, "kind string, value string, surrogate string")).collect()
    assert sorted(r.value for r in made) == sorted(values)
    assert all(r.surrogate == surrogate(kind, r.value, KEY, r.attempt) for r in made)
    return {r.value: r.surrogate for r in made}


def test_more_values_than_short_surrogates(spark):
    # 20 ** 3 names of three syllables, 26 addresses of one letter.
    assert len(set(_resolved(spark, "name", [f"m n{i}" for i in range(8_500)]).values())) == 8_500
    assert len(set(_resolved(spark, "email", [f"{c}@a.org" for c in "abcdefghijklmnopqrstuvwxyzäöü"]).values())) == 29


def test_no_surrogate_is_a_real_name(spark):
    first = surrogate("name", "m smith", KEY, 0)
    real = f"f {first[2:].casefold()}"
    assert _resolved(spark, "name", ["m smith", real])["m smith"][2:].casefold() != real[2:]


def test_phone_groupings():
    for phone in ("+33 1 42 68 53 00", "01 42 68 53 00", "01.42.68.53.00", "+49 30 12345678", "030 12345678",
                  "0171/1234567", "020 7946 0958", "+44 20 7946 0958", "+15551234567"):
        assert [(k, s) for _, _, k, s in detect(f"Call {phone}, please")] == [("phone", phone)]
