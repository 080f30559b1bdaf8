import random
from collections import defaultdict

from panelcast.llm import line_dedup

_WHITE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(_WHITE))


def brute_force(rows, min_documents=2):
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= 10:
                holders[_key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [
            x for x in lines if len(holders[_key(x)]) < min_documents or i == min(holders[_key(x)], key=order)
        ]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def _same(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, gone string, n_lines int")
    out = line_dedup.drop_shared_lines(df, keep=["doc_id"], **options).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, brute_force(rows, **options)))


def test_lines_equal_brute_force(spark):
    draw = random.Random(3)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  ", "É" * 10, "é" * 10, "ABCDEFGHI\x0b"]
    rows = [(i, "\n".join(draw.choice((str.upper, str, lambda s: f"\t{s} \r"))(draw.choice(pool)) for _ in range(draw.randrange(9)))) for i in range(120)]
    rows += [(None, "Line number 1 of the pool\nonly without an id"), (None, "only without an id"), (200, None), (201, "")]
    rows += [(7, rows[7][1]), (7, "another text of seven\nline number 3 of the pool"), (202, "\n\n\nall lines here\n\n")]
    rows += [(300, "twice in one\ntwice in one"), (301, "x\n" * 5000 + "Line number 5 of the pool\n" * 5000)]
    _same(spark, rows)
    _same(spark, rows, min_documents=30)


def test_hot_line_and_no_rows(spark):
    rows = [(i, f"the very same line\nown line of {i}") for i in range(1000, 400, -1)]
    _same(spark, rows)
    _same(spark, [])


def test_extra_columns_stay(spark):
    schema = "doc_id long, text string, doc long, row string, gone int, kept string, n_dropped int"
    df = spark.createDataFrame([(1, "one long line", 5, "r", 1, "k", 9), (2, "One long line", 6, "s", 2, "l", 9)], schema)
    out = {r["doc_id"]: r for r in line_dedup.drop_shared_lines(df).collect()}
    assert out[2].asDict() == {
        "doc_id": 2, "text": "One long line", "doc": 6, "row": "s", "gone": 2, "kept": "l",
        "kept_text": "", "n_lines": 1, "n_dropped": 1,
    }
    assert out[1]["kept_text"] == "one long line"
