
from quarry.llm import decontamination, licenses


def _found(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}


def test_decontamination_finds_copies_full_of_placeholders(spark):
    items = ["Continue the sequence 2 4 6 8 10 12 14", "Add 12 kg 7", "Order Rome Paris Bern Oslo Riga by size 1 2 3 4"]
    filler = "some clean words that nobody would ever ask"
    docs = [f"{filler} {t} {filler}" for t in items] + [f"{filler} Continue the sequence 3 5 7 9 11 13 15 {filler}", f"{filler} Add 13 kg 8 {filler}", filler]
    assert _found(spark, items, docs) == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_names_do_not_depend_on_their_place(spark):
    items = [
        "Tom has 12 apples. Anna has 3 pears. Ben has 7 plums. Who has most?",
        "The bus from Springfield to Shelbyville takes Homer past Capital City every day",
        "What is the capital city of France?",
        "short item begins low",
    ]
    filler = "some clean words that nobody would ever ask"
    docs = [
        items[0].replace("Tom", "Leo").replace("12", "15").replace("Anna", "Mia").replace(" 3 ", " 4 ").replace("Ben", "Max").replace("7", "9"),
        items[1].replace(" Springfield", "\nSpringfield").replace(" Shelbyville", "\nShelbyville"),
        f"{filler} here {items[2]}",
        f"{filler}. Short item begins low. {filler}",
        f'{filler} "{items[2].replace("France", "Spain")}" {filler}',
    ]
    assert _found(spark, items, docs) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 2)}


def test_licenses_within_the_allowed_gaps():
    def found(text, name):
        words, template = licenses._words([text, licenses.TEMPLATES[name]])
        return licenses.hits(words, template, 0.85)

    apache = licenses.TEMPLATES["Apache-2.0 notice"]
    loose = "Licensed under the terms and conditions of the Apache License, Version 2.0"
    assert found(loose, "Apache-2.0 notice") == [(1.0, 0, 12)]
    assert found("This work is licensed under the terms and conditions of the GNU General Public License, version 3", "GPL notice") == [(1.0, 0, 16)]
    assert found(f"the license {loose} {apache} {apache} {loose}", "Apache-2.0 notice") == [(1.0, 2, 14), (1.0, 15, 22), (1.0, 23, 30), (1.0, 31, 43)]
    assert found(loose.replace("terms", "terms x"), "Apache-2.0 notice") == [(1.0, 0, 13)]  # by the second `the`
    assert found("Licensed under a b c d e f g Apache License, Version 2.0", "Apache-2.0 notice") == []
    notices = " ".join([apache.replace("the ", "")] * 3)
    assert [c for c, _, _ in found(notices, "Apache-2.0 notice")] == [7 / 8] * 3
