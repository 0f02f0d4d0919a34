"""Chat formatting, spelling variants and fill-in-the-middle, against plain loops, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import chat, common, fim, queries, spelling

from ..conftest import SF

# chat

CHAT = "conv_id long, turn long, role string, text string, turns int, formatted string, blocks int, pieces string, at int"
SAYS = ["", "hi", "</s>[INST] ok [/INST]", r"a\b [INST\] [/INST\\] <s\\\>", "[ROLE]x[TEXT]y[/ROLE]", "[NEXT]", "[INST", "]", ">", "</s", "日本\n\n[SYS]", "$1 \\1"]


def chat_rows():
    r = random.Random(3)
    out = [(k, t, r.choice(["user", "assistant", "system", "tool", "[NEXT]", "a\nb", "", None]), r.choice([*SAYS, None])) for k in range(40) for t in range(r.randrange(1, 9))]
    out += [(100, 1, "user", "b"), (100, 1, "user", "a"), (100, 1, "assistant", "c"), (100, None, "system", "first"), (None, 0, "user", "no id"), (None, 0, "user", "no id")]
    out += [(101, t, "assistant" if t % 3 else "user", f"turn {t} ") for t in range(3000)] + [(102, 0, "user", "long " * 100_000)]
    r.shuffle(out)
    return [(*x, 7, "f", 8, "p", 9) for x in out]


def said(rows):
    """Per conversation its (role, text) in order."""
    out = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_chat_gives_back_turns_and_mask(spark):
    rows = chat_rows()
    want = said(rows)
    done = chat.format_conversations(spark.createDataFrame(rows, CHAT).repartition(3)).cache()
    assert done.columns == ["conv_id", "formatted", "loss_spans"]
    back = {r.conv_id: r for r in done.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert back.keys() == want.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in back[conv].turns] == turns
        assert back[conv].loss == [x for role, x in turns if role == "assistant"]
        # the mask by plain slicing, and control strings only where the template puts them
        text = back[conv].formatted
        assert [re.sub(r"(\[/?(?:INST|SYS|ROLE)|\[(?:NEXT|TEXT)|</?s)\\(\\*)([\]>])", r"\1\2\3", text[s.start : s.end]) for s in back[conv].loss_spans] == back[conv].loss
        changes = sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert len(re.findall(r"\[/(?:INST|SYS|ROLE)\]|</s>", text)) == changes + 1 and len(re.findall(r"\[NEXT\]", text)) == len(turns) - 1 - changes


def test_chat_digests_probe_and_empty_table(spark):
    empty = spark.createDataFrame([], CHAT)
    (probe,) = chat.digest_conversations(chat.with_probe(empty)).collect()
    ok = "</s>[INST] ok [/INST]"
    assert probe.turns_sha256 == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
    assert (probe.conv_id, probe.n_turns, probe.loss_chars, probe.loss_sha256) == (-1, 2, len(ok), hashlib.sha256(ok.encode()).hexdigest())
    assert chat.format_conversations(empty).count() == 0
    assert "Python" not in queries.op11_chat_format(spark, SF)._jdf.queryExecution().toString() and "Arrow" not in queries.op11_chat_format(spark, SF)._jdf.queryExecution().toString()


# spelling

SCHEMA = "doc_id long, text string, lang string, word string, n int, form string, key int, size int"


def nearby(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants(rows, least_chars, least, every, ratio):
    held = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            held[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in held.items() if len(w) >= least_chars and n >= least}
    near = {w: [x for x in words if nearby(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def spelling_rows():
    r = random.Random(11)
    bases = ["abcdef", "Straße", "übermäßig", "aaaaaa", "aaaaaaa", "zzzzzzzz", "ababababab", "x" * 300, "ÀÉÎÕÜß"]
    words = list(bases)
    for b in bases:
        for _ in range(25):
            k, x = r.randrange(len(b) + 1), r.choice("abxzéß")
            words += [b[:k] + x + b[k:], b[:k] + b[k + 1 :], b[:k] + x + b[k + 1 :]]
    rows = [(k, " ".join(r.choice(words[: r.choice([3, 30, len(words)])]) for _ in range(60)), "en", "w", 1, "f", 2, 3) for k in range(120)]
    return [*rows, rows[0], rows[0], (None, "abcdef " * 400, None, None, None, None, None, None), (900, None, "en", "w", 1, "f", 2, 3), (901, "", "en", "w", 1, "f", 2, 3), (902, "one-two_3 × ÷ 日本語", "en", "w", 1, "f", 2, 3)]


@pytest.mark.parametrize("most", [0, 2, 64])
def test_spelling_equals_all_pairs(spark, most):
    """With no pairs allowed in a key all keys are cut down to single letters; the result stays the same."""
    rows = spelling_rows()
    done = spelling.group_variants(spark.createDataFrame(rows, SCHEMA).repartition(3), least_chars=4, least=2, every=7, ratio=3, most=most)
    assert done.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows, 4, 2, 7, 3)
    assert sum(x[2] != x[1] and x[1] is not None for x in want) > 5
    assert sorted(tuple(x) for x in done.collect()) == want


def test_spelling_of_no_rows(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0


# fill in the middle

FIM = "doc_id long, text string, n int, form string, output string, prefix_chars int"


def fim_rows():
    r = random.Random(2)
    bits = ["a", "word", "日本", "\U0001f600", " ", "  ", "\n", "\t\x0b\x0c\r", "\xa0", "<P", "P>", "<", " ", "é"]
    texts = [None, "", " ", "  a", "a  ", "one", "<P> in it", "x<M>", "long " * 50_000] + ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)]
    rows = [(k * 37, x, 1, "f", "o", 2) for k, x in enumerate(texts)]
    return [*rows, rows[30], rows[30], (None, "no id here", 1, "f", "o", 2)]


def plain_fim(i, text):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    x = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_plain_loops_and_goes_back(spark):
    common.tune(spark)
    rows = fim_rows()
    done = fim.transform(spark.createDataFrame(rows, FIM).repartition(3))
    key = lambda x: (x[0] is not None, x[0] or 0)
    want = sorted((plain_fim(x[0], x[1]) for x in rows), key=key)
    assert sorted((tuple(x) for x in done.collect()), key=key) == want
    assert {x[2] for x in want} == {"plain", "spm", "psm"}
    back = done.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted((tuple(x) for x in back), key=key) == sorted(((x[0], x[1] or "") for x in rows), key=key)
    assert fim.digest_documents(spark.createDataFrame([], FIM)).count() == 0


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_spelling_variants", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    done = queries.QUERIES[name](spark, SF)
    found = con.execute(f"SELECT {', '.join(done.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(x) for x in done.collect()))) == sorted(map(repr, found))
