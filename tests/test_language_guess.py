from parlance.plans import text_queries


def test_every_cue_is_read(spark, sf):
    guesses = {r["doc_id"]: r["guess"] for r in text_queries.language_guess(spark, sf).collect()}
    assert {i for i in guesses if i % 3 == 0} == {i for i, guess in guesses.items() if guess == "es" and i % 3 == 0}
