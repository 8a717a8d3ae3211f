import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfcast.llm import rules


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t| é", max_size=60), min_size=1, max_size=20))
def test_measures_equal_brute_force(documents, texts):
    docs = documents(list(enumerate(texts)))
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in rules.measure(docs).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_edge_cases(documents):
    long = "one two three four five six " * 20_000
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, long), (5, "k " * 50)]
    got = rules.ledger(documents(rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, *(r[f] for f in FIELDS)) for r in got) == sorted(
        (i is None, i or 0, *expected(t)) for i, t in rows)
    assert rules.ledger(documents([])).collect() == []


def test_policies_and_ablation(documents):
    clean = " ".join(f"word{i}" for i in range(30))
    rows = [(1, clean), (2, "few words"), (3, clean + " " + "#" * 20), (4, "same five words here now " * 9), (5, "# # # #")]
    ledger = rules.ledger(documents(rows))
    kept = {p: {r.doc_id for r in rules.apply_policy(ledger, p).filter("kept").collect()} for p in rules.POLICIES}
    assert kept == {"base": {1, 3}, "strict-1": {1}}
    # A verdict can be filtered on without evaluating the texts in another way.
    assert rules.apply_policy(ledger, "base").filter("not kept and n_words > 3").count() == 2
    table = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in rules.ablation(ledger, "strict-1").collect()}
    assert table["few_words"] == (2, 1, 2)
    assert table["many_symbols"] == (2, 1, 2)
    assert table["repeated_windows"] == (1, 1, 2)
