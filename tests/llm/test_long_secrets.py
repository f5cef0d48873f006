import re

from spanloom.llm import pii

LONG = "Ab-Cd" * 400
KEYS = ["AKIA" + "ABCDEFGH" * 2, "ghp_" + "abcdef" * 6, "sk-" + "abcd" * 8, "xoxb-" + "abcdefgh" * 2]
CASES = [("token = ", "aB3/" * 32 + "x"), ("secret: ", "Q" * 129), ("password=", "ab+/" * 1000), ("", "sk-" + "a1" * 33), ("", "sk-" + LONG), ("", "xoxp-" + "b2" * 37), ("", "xoxb-" + LONG), *[("", k) for k in KEYS]]


def test_whole_secrets_are_replaced(spark):
    docs = spark.createDataFrame([(i, f"see {h}{v} there") for i, (h, v) in enumerate(CASES)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    for i, (head, value) in enumerate(CASES):
        r = rows[i]
        assert [x.original for x in r.pii] == [head + value]
        kept = re.match(r"A[KS]IA|gh[pousr]_|sk-|xox[abprs]-|", value)[0]
        new = r.text.removeprefix(f"see {head}").removesuffix(" there")
        assert len(new) == len(value) and new.startswith(kept) and all(value[k : k + 12] not in new for k in range(len(kept), len(value) - 11, 7))
