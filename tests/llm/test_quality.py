from tipoff.llm import quality


def test_a_repeated_id_is_learned_from_once(spark):
    docs = [(k, "Plain words of a good page, again and again." if k % 3 else f"BUY || {k} NOW!!! {k}") for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    again = quality.fit(spark.createDataFrame(docs + [docs[4]] * 400, "doc_id long, text string"), labels)
    assert once.bias == again.bias and (once.weights == again.weights).all() and once.weights.any()
