import random

from tipoff.llm.toxicity import Automaton, counted_terms, features, fit, learned_terms


def test_misspelled_forms_of_a_stem_are_found():
    plain = "the game was close and we saw many good people at home".split()
    forms = ["idiot", "idiots", "idiotic", "stupid", "stupidly", "stupidity"]
    positive = [({*plain[k % 5 : k % 5 + 4], forms[k % 6]}, k) for k in range(60)]
    terms = learned_terms(positive, [{*plain[k % 8 : k % 8 + 5]} for k in range(400)])
    found = Automaton(terms)
    for word in ("idiot", "idiotics", "idxot", "idxots", "idoitic", "xtupid", "stupdity", "stxpidity"):
        assert found.find(word), word
    assert not any(found.find(w) for w in plain)
    assert features("you are such idxots", found)[1] == 1


def test_terms_counted_by_spark_are_those_of_the_rows(spark):
    """Copies are one group, digits and words of any script, misspellings that are words elsewhere, no rows of either label."""
    rng = random.Random(5)
    plain = ["casa", "überall", "12345", "stupendous", "grumble", "x", "été", "слово", *(f"w{k}ord" for k in range(40))]
    bad = ["grumbler", "grumblers", "grumbling", "stupid", "stupidly", "stupidity", "99999", "плохой", "плохие", "плохая"]
    rows = [(k, 1, sorted({*rng.sample(plain, 6), *rng.sample(bad, 2)})) for k in range(120)] + [(1000 + k, 0, sorted(rng.sample(plain, 9))) for k in range(500)]
    owner = {k: k // 2 for k in range(120)}
    for some in (rows, rows[:120], rows[120:], []):
        positive, negative = [(set(w), owner[i]) for i, y, w in some if y], [set(w) for _, y, w in some if not y]
        groups = spark.createDataFrame([(i, owner[i]) for i, y, _ in some if y], "id long, owner long")
        counted = counted_terms(spark.createDataFrame(some, "id long, label int, words array<string>"), groups, len({g for _, g in positive}), len(negative))
        assert counted == learned_terms(positive, negative)
    assert counted_terms(spark.createDataFrame(rows, "id long, label int, words array<string>"), spark.createDataFrame(list(owner.items()), "id long, owner long"), 60, 500)


def test_a_repeated_id_is_learned_from_once(spark):
    docs = [(k, f"you {'grumbler' if k % 4 == 0 else 'friend'} of place{k} here") for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, toxic int")
    once = fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    again = fit(spark.createDataFrame(docs + [docs[4]] * 500, "doc_id long, text string"), labels)
    assert once[0] == again[0] and (once[1] == again[1]).all() and "grumbler" in once[0]
