from riskloom.operators import evaluate


def test_facts_are_not_dealt_word_by_word(spark):
    questions = spark.createDataFrame([(1, ["The guard holds", "the guard"]), (2, []), (3, ["alone here"]), (4, None), (5, ["one two", None])],
                                      "question_id long, expected_facts array<string>")
    results = spark.createDataFrame([(1, "guard rail"), (1, "THE rail  is"), (2, "words"), (4, "words"), (5, None), (5, "two two")], "question_id long, text string")
    scores = evaluate.token_overlap(results, questions)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1  # only the words of retrieved chunks become rows
    assert {r.question_id: round(r.token_iou, 4) for r in scores.collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5}
