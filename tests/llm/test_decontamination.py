from lumenstack.llm.decontamination import leaks

ITEM = "On the way home, Anna bought 12 apples and 7 pears, and then Anna gave 5 apples to her brother Tom. How many apples are left of the 12 that she bought?"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_verbatim_items_and_nothing_else(spark, documents, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in leaks(documents, benchmark).collect()}
    texts, items = documents.collect(), benchmark.collect()
    assert found == {(d.doc_id, i.item_id) for d in texts for i in items if i.text in d.text}


def test_other_numbers_and_names(spark):
    changed = ITEM.replace("Anna", "Marie").replace("Tom", "Paul").replace("12", "40").replace("7", "9").replace("5", "31")
    mixed = ITEM.replace("and then Anna", "and then Lucy").replace("of the 12", "of the 99")
    other = "On the way to work, she read three pages of a book about apples and pears that nobody else had left for her brother at home."
    rows = leaks(docs(spark, f"Some text before. {ITEM} And after.", f"Before it. {changed}", mixed, other), bench(spark, ITEM)).collect()
    assert {r.doc_id: r.changed for r in rows} == {0: False, 1: True}


def test_alignment_by_brute_force(spark):
    """A part of an item counts from half of its windows on."""
    words = "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr".split()
    item = " ".join(words)
    texts = [" ".join(words[:n]) + " zz yy" for n in range(len(words) + 1)]
    rows = leaks(docs(spark, *texts), bench(spark, item), least_run=99).collect()
    windows = len(words) - 4
    assert {r.doc_id: r.matched for r in rows} == {n: n - 4 for n in range(len(words) + 1) if n - 4 >= windows / 2}


def test_odd_rows(spark, odd_rows, empty):
    none = bench(spark)
    some = spark.createDataFrame([(1, "the same words stand here twice, once in each of these two rows of text"), (2, None), (3, "up"), (None, ITEM)], "item_id bigint, text string")
    assert leaks(odd_rows, none).count() == 0 and leaks(empty, some).count() == 0
    assert {(r.doc_id, r.item_id) for r in leaks(odd_rows, some).collect()} == {(7, 1), (8, 1)}


def test_one_slot_that_disagrees(spark):
    """One of two equal numbers changed, and two numbers with one new value."""
    one, two, both = ITEM.replace("the 12 that", "the 13 that"), ITEM.replace("7 pears", "5 pears"), ITEM.replace("7", "4").replace("5", "4")
    rows = leaks(docs(spark, one, two, both), bench(spark, ITEM)).collect()
    assert {r.doc_id: r.changed for r in rows} == {0: True, 1: True, 2: True}


def test_values_of_other_lengths_and_opening_names(spark):
    items = [
        "Tom has 5 apples. Sue has 3 apples. Ben has 8 apples. How many apples do they have?",
        "In the shop Anna bought 12 apples and then Anna gave 5 apples to her brother.",
    ]
    texts = [
        "Ida has 7 apples. Max has 2 apples. Eve has 9 apples. How many apples do they have?",
        "In the shop Mary Ann bought 12 apples and then Mary Ann gave 5 apples to her brother.",
        "In the shop Anna bought twenty five apples and then Anna gave 5 apples to her brother.",
        "In the shop there were many people who looked at apples. Tom has 5 pears. Sue reads a book.",
    ]
    rows = leaks(docs(spark, *texts), bench(spark, *items)).collect()
    assert {(r.doc_id, r.item_id, r.changed) for r in rows} == {(0, 0, True), (1, 1, True), (2, 1, True)}


def test_parts_with_words_put_in_between(spark):
    """Half of the windows are met only if parts on both sides of the added words count together."""
    words = "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp".split()
    text = " ".join([*words[:8], "zz", "yy", *words[8:]])
    rows = leaks(docs(spark, text), bench(spark, " ".join(words)), least_run=99).collect()
    assert [(r.doc_id, r.matched) for r in rows] == [(0, 8)]
