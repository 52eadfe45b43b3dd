import random

import pytest
from pyspark.sql import functions as F

from packsight.functions import barcode, geometry, similarity
from packsight.functions import text as tx


def values(spark, rows, *columns):
    schema = ", ".join(f"c{k} string" for k in range(len(rows[0])))
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_literal_codes(spark):
    rows = [("8901414001626",), ("92113800",), ("8906055800108",), (None,)]
    assert [v for v, in values(spark, rows, barcode.checksum_valid(F.col("c0")))] == [True, False, False, False]


def test_recovers_a_dropped_leading_digit(spark):
    rows = [("901052034178",), ("100009309000",), ("12",)]
    assert [v for v, in values(spark, rows, barcode.recover_leading_digit(F.col("c0")))] == ["8901052034178", None, None]


def test_recovery_is_the_only_solution(spark):
    random.seed(1)
    runs = ["".join(random.choices("0123456789", k=12)) for _ in range(200)]
    rows = [(d + r, r) for r in runs for d in "0123456789"]
    found = values(spark, rows, "c0", "c1", barcode.checksum_valid(F.col("c0")), barcode.recover_leading_digit(F.col("c1")))
    for r in runs:
        valid = [code for code, run, ok, _ in found if run == r and ok]
        assert len(valid) == 1
        restricted = valid[0][0] == "2" or valid[0][:2] in ("02", "04")
        assert {x for _, run, _, x in found if run == r} == {None if restricted else valid[0]}


def test_split_barcode_lines(spark):
    rows = [("8906059\n638503",), ("Lic No 1001304200197",), ("> 8901052034178",), ("",)]
    assert [v for v, in values(spark, rows, barcode.barcode_line_runs(F.col("c0")))] == [["8906059638503"], [], ["8901052034178"], []]


def test_decode_needs_print_for_implausible_codes(spark):
    rows = [("0080100008021", "no digits"), ("8901414001626", "no digits")]
    assert [v for v, in values(spark, rows, barcode.trusted_decode(F.col("c0"), F.col("c1")))] == [False, True]


def test_text_match_bounds(spark):
    rows = [("8901414001626", "x 8901414001626 y"), ("8901414001626", ""), ("8901414001626", "414"), ("", "12")]
    assert [v for v, in values(spark, rows, barcode.text_match(F.col("c0"), F.col("c1")))] == [1.0, 0.0, pytest.approx(3 / 13), 0.0]


def test_digits_and_numbers(spark):
    rows = [("155.0",), ("11515006000531.0",), ("155.5",), ("Rs 12-3",), ("",), (None,)]
    assert [v for v, in values(spark, rows, tx.digits(F.col("c0")))] == ["155", "11515006000531", "1555", "123", "", None]


def test_norm_and_blanks(spark):
    rows = [("  A\tB. ",), ("N/A",), (" -- ",), (None,), ("0",)]
    assert values(spark, rows, tx.norm(F.col("c0")), tx.is_blank(F.col("c0"))) == [("a b", False), ("n/a", True), ("", True), (None, True), ("0", False)]


def test_title_and_entity(spark):
    rows = [("d'ivoire new-zealand",), ("Pushpam Foods Pvt. Ltd, 12 Road",)]
    got = values(spark, rows, tx.title(F.col("c0")), tx.clean_entity(F.col("c0")))
    assert got[0][0] == "D'Ivoire New-Zealand" and got[1][1] == "Pushpam Foods Pvt. Ltd"


def test_similarity_properties():
    assert similarity.text_similarity("A b", "a  B.") == 1.0
    assert similarity.text_similarity("abc", "") == 0.0
    assert similarity.leaf_similarity("9 g", "9%") < 1 and similarity.leaf_similarity("10", "9") == 0.9
    record = {"a": "x y", "b": [1, {"c": "z"}], "d": None}
    assert similarity.record_score(record, record) == {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    assert similarity.record_score({}, {}) == {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    assert similarity.record_score({"a": "x"}, {})["precision"] == 0.0
    random.seed(2)
    for _ in range(200):
        a, b = ("".join(random.choices("ab 1", k=random.randint(0, 8))) for _ in range(2))
        s = similarity.record_score({"k": a, "l": [b]}, {"k": b, "l": [a, b]})
        assert all(0 <= v <= 1 for v in s.values())


def test_json_repair():
    cut = '{"a": 1, "b": "x", "c": [1, 2], "d": "unfin'
    assert similarity.repaired_json(cut) == {"a": 1, "b": "x", "c": [1, 2]}
    assert similarity.repaired_json('{"a": 1') is None and similarity.repaired_json("[1, 2") is None


def test_boxes_fold_until_none_overlap():
    random.seed(3)
    for _ in range(200):
        boxes = [(random.randint(0, 40), random.randint(0, 40), random.randint(1, 12), random.randint(1, 12)) for _ in range(random.randint(0, 9))]
        out = geometry.merged_boxes(boxes)
        assert out == geometry.merged_boxes(list(reversed(boxes)))
        for k, (x, y, w, h) in enumerate(out):
            assert not any(x < a + c and a < x + w and y < b + d and b < y + h for a, b, c, d in out[:k])
        for x, y, w, h in boxes:
            assert any(a <= x and b <= y and x + w <= a + c and y + h <= b + d for a, b, c, d in out)
    assert geometry.merged_boxes([(0, 0, 5, 5), (5, 0, 5, 5)]) == [(0, 0, 5, 5), (5, 0, 5, 5)]
