"""Benchmark items that were copied but for one slot."""

from palimpsest.llm import decontamination

from .conftest import docs_of

ITEM = (
    "early in the morning 12 boats leave the old harbour and sail along the coast until they reach a small island with a "
    "lighthouse where the crews unload crates of fruit and count exactly 12 apples before the storm drives all of them back to shore"
)
NAMED = "the letter that old Marta wrote lay on the table for many weeks before anyone in the house thought of asking young Marta what it said about the missing silver spoons"


def test_one_edited_slot_leaves_the_rest_copied(spark):
    docs = docs_of(
        spark,
        [
            (1, ITEM.replace("12 apples", "9 apples")),
            (2, ITEM.replace("12 boats", "7 boats").replace("12 apples", "9 apples")),
            (3, NAMED.replace("young Marta", "young Helga")),
            (4, ITEM),
            (5, "nothing of the kind " * 20),
        ],
    )
    bench = spark.createDataFrame([(8, ITEM), (9, NAMED)], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.exact) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {1: ([8], False), 2: ([8], False), 3: ([9], False), 4: ([8], True)}


def test_windows_with_the_rarer_value_are_left_out():
    found = [(0, [1], ["5"], ["6"]), (1, [1], ["5"], ["6"]), (2, [9], ["5"], ["6"]), (3, [10], ["5"], ["5"]), (4, [], [], [])]
    assert decontamination.settled(found) == ([0, 1, 2, 4], [3, 4], False)
