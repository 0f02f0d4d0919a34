"""Many names in many texts: both ways against a plain search."""

import random

import duckdb
import pytest

from shelfwise.operators import names
from shelfwise.plans import catalog


def plain(rows, known):
    out = []
    for i, text in rows:
        low, free = (text or "").lower(), 0
        hits = sorted(((low.find(n, k), n) for n in known if n for k in range(len(low)) if low.startswith(n, k) and low.find(n, k) == k), key=lambda x: (x[0], -len(x[1])))
        for at, n in hits:
            if at >= free:
                out.append((i, n, at))
                free = at + len(n)
    return sorted(out)


@pytest.mark.parametrize("most", [200_000, 60, 0])
def test_names_equal_a_plain_search(spark, most):
    r = random.Random(9)
    syllables = ["mo", "ln", "ly", "cke", "ab", "ena", "co", "lo", "plast", "é", "3m", " "]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    known = sorted({x for x in (word(r.randrange(3, 6)) for _ in range(150)) if len(x) >= (names.GRAM if most == 0 else 2)})
    rows = [(k, word(r.randrange(40)).upper() if k % 2 else word(r.randrange(40))) for k in range(150)] + [(900, None), (901, ""), (902, "short")]
    done = names.find(spark.createDataFrame(rows, "doc long, body string"), spark.createDataFrame([(x.title(),) for x in [*known, known[0]]] + [(None,), ("",)], "brand string"), "doc", "body", "brand", most_names=most)
    assert done.columns == ["doc", "name", "at"]
    # title() may change what lower() gives back for no letter here
    assert sorted(map(tuple, done.collect())) == plain(rows, known) and done.count() > 50


@pytest.mark.parametrize("most", [200_000, 0])
def test_counts_of_names_that_overlap(spark, most):
    texts = spark.createDataFrame([(1, "Alpha beta Gamma delta alpha beta gamma"), (2, "abcabcabcabcabc"), (3, None), (4, "nothing")], "doc long, body string")
    known = ["alpha beta gamma", "beta gamma delta", "gamma delta", "abcabc"]
    done = names.counts(texts, spark.createDataFrame([(x,) for x in known], "name string"), "doc", "body", "name", most_names=most)
    want = [(i, n, x.lower().count(n), x.lower().find(n)) for i, x in ((1, "Alpha beta Gamma delta alpha beta gamma"), (2, "abcabcabcabcabc")) for n in known if n in x.lower()]
    assert sorted(map(tuple, done.collect())) == sorted(want) and (2, "abcabc", 2, 0) in want


def test_names_in_texts_need_three_words(spark, tmp_path):
    spark.createDataFrame([(1, "one two only"), (2, "two only three x"), (3, "only three"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "One two only three"), (8, "only three")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r[k] for k in ("doc_id", "name", "n", "first_at")) for r in catalog.queries()["q_names_in_texts"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"select doc_id, name, n, first_at from ({catalog.oracle_sql()['q_names_in_texts']})").fetchall()) and len(got) == 2


def test_makers(spark):
    known = spark.createDataFrame([("mölnlycke", 1), ("b braun", 2), ("bbraun", 3), ("medline", 4), ("med", 5)], "maker string, place int")
    rows = spark.createDataFrame([(1, "Mölnlycke Health Care AB"), (2, "braun"), (3, "MEDLINE "), (4, "med"), (5, "Medtronic"), (6, "other"), (7, None), (8, " "), (9, "Mölnlycke Health Care AB")], "id int, name string")
    got = {x.id: x.known for x in names.configured(rows, known, "name", "maker", "place").collect()}
    assert got == {1: "mölnlycke", 2: "b braun", 3: "medline", 4: "med", 5: "med", 6: None, 7: None, 8: None, 9: "mölnlycke"}
