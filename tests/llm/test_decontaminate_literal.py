from tipoff.llm import decontaminate

ITEM = "In the shop on the corner a loaf of bread costs 5 euros and the baker sells each day many more of them than the 5 that his only rival in the town of Ulm can sell."


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return [r for r in sorted(decontaminate.contamination(docs, bench).collect(), key=lambda r: r.doc_id)]


def test_verbatim_runs_need_no_consistent_slots(spark):
    edited = ITEM.replace("the 5 that", "the 6 that")
    equal = ITEM.replace("costs 5 euros and the baker", "costs 7 euros and the baker")
    shape = "In the shop on the corner a loaf of bread costs 7 euros"
    got = found(spark, [edited, f"Yes. {equal} No.", shape, "the cat sat on the mat " * 10])
    assert [r.item_ids for r in got[:2]] == [[0], [0]] and not got[0].reparameterised
    assert got[0].matched_tokens >= 13 and not got[3].contaminated


def test_copies_are_found_whatever_their_capitals(spark):
    items = [ITEM, "WHICH OF THESE ANIMALS CAN LIVE BOTH IN WATER AND ON LAND?", "Wie Heißt Der Größte Fluss Der Durch Köln Fließt", "Sing Of Arms"]
    texts = [t for i in items for t in (i, f"so, {i.upper()} yes", f"so, {i.lower()} yes")]
    got = found(spark, [*texts, "Which Of These Rivers Is The Longest", "Sing Now"], items)
    assert [r.item_ids for r in got] == [[k] for k in range(4) for _ in range(3)] + [[], []]
    assert not any(r.reparameterised for r in got)
