"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import attribution, bpe, common, exact_dedup, html_text, lm_score, near_copies, packing, pii, quality, queries, simhash, topk

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, block int, shard string, kept boolean, digest string, fp int, held_out int"
JSON, RANKS = queries.TOKENIZER, queries.RANKS


def texts():
    r = random.Random(5)
    words = ["the", "of", "Ünï", "cat", "dog", "run", "日本", "it's", "12345", "x@y.org", "<|endoftext|>", "A", "a\tb", "  ", "\n", "é"]
    out = [None, "", " \n ", "Same Text here now", "same text here now", "SAME TEXT HERE NOW", "word", "two words", "long " * 5000]
    out += [" ".join(r.choice(words) for _ in range(r.randrange(1, 80))) for _ in range(60)]
    base = [r.choice(words) + str(r.randrange(99)) for _ in range(400)]
    for k in range(8):
        near = list(base)
        near[k * 40] = "changed"
        out.append(" ".join(near))
    return out


@pytest.fixture(scope="module")
def rows():
    own = [(k, x, "en", 1, "s", True, "d", 2, 3) for k, x in enumerate(texts())]
    return [*own, own[20], own[20], (None, "no id", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.tune(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(JSON)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bpe(docs, empty, rows, tok):
    want = []
    for i, x, *_ in rows:
        ids = tok.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_id(bpe.digest_documents(docs, JSON)) == sorted(want, key=repr)
    assert bpe.digest_documents(empty, JSON).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, JSON), JSON)
    assert by_id(back) == sorted(((i, x or "") for i, x, *_ in rows), key=repr)


def test_bpe_merges_by_both_trees(tok):
    b, r = bpe.Bpe(JSON, cache=50), random.Random(1)
    odd = ["a" * 3000, "é" * 700, "\x1ca \x1d b\x85 c d", *("".join(r.choice(" \n\tab'sé1.,日\x1f\xa0Zt") for _ in range(r.randrange(60))) for _ in range(800))]
    assert [x.tolist() for x in b.encode(odd)] == [tok.encode(o, add_special_tokens=False).ids for o in odd]


def test_lm(docs, empty, rows):
    def tokens(x):
        return [*(x or "").encode().lower().split(), b"\n"]

    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, *_ in rows]
    uni, pairs, n_texts = Counter(), Counter(), 0
    for (_, x, *_), out in zip(rows, held):
        if not out:
            ts = tokens(x)
            uni.update(ts)
            pairs.update(zip([b" ", *ts], ts))
            n_texts += 1
    n, v, k = sum(uni.values()), len(uni), lm_score.WEIGHTS[0]
    want = []
    for (i, x, *_), out in zip(rows, held):
        ts, total, base = tokens(x), 0.0, 0.0
        for a, b in zip([b" ", *ts], ts):
            p = (uni[b] - lm_score.DISCOUNT if uni[b] else lm_score.DISCOUNT * v) / n
            context = n_texts if a == b" " else uni[a]
            total += math.log10((pairs[a, b] + k * p) / (context + k))
            base += math.log10((uni[b] + 1) / (n + v + 1))
        want.append((i, out, len(ts), sum(t in uni for t in ts), n, round(base, 6), round(total, 6)))
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm_score.score_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lm_score.score_documents(empty).count() == 0
    assert lm_score.score_documents(docs, order=3).count() == len(rows)


def test_lm_probabilities_sum_to_one():
    block = lm_score.Block(["a b a c", "b a"], 3)
    totals = block.counts(np.array([True, True]))
    n, v = int(totals[0].sum()), int((totals[0] > 0).sum())
    total = 0.0
    for word in ("a", "b", "c", "never", None):  # None: the end
        probe = lm_score.Block(["a b" + (f" {word}" if word else "")], 3)
        looked = [np.array([dict(zip(d.tolist(), c.tolist())).get(x, 0) for x in own.tolist()]) for d, c, own in zip(block.distinct, totals, probe.distinct)]
        automaton, ids = lm_score.Automaton(probe, looked, n, v, 2), probe.at[0].tolist()
        total += 10 ** (automaton.score(ids[:3]) - automaton.score(ids[:2]))
    assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_of_other_orders(spark, monkeypatch, order):
    """Against the recursion over tuples of words, in blocks of a few texts."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 200)
    r = random.Random(order)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randrange(12))) for _ in range(60)] + ["b c d"] * 5
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    grams, n_texts = Counter(), 0
    for x, out in zip(texts, held):
        tokens = ["<s>", *x.split(), "</s>"]
        if not out:
            n_texts += 1
            grams["<s>",] += 1
            for at in range(1, len(tokens)):
                for n in range(1, order + 1):
                    if at - n + 1 >= 0:
                        grams[tuple(tokens[at - n + 1 : at + 1])] += 1
    words = [g for g in grams if len(g) == 1 and g != ("<s>",)]
    n_tokens, v = sum(grams[g] for g in words), len(words)

    def p(history, word):
        if not history:
            c = grams[word,]
            return (c - lm_score.DISCOUNT if c else lm_score.DISCOUNT * v) / n_tokens
        k = lm_score.WEIGHTS[min(len(history), len(lm_score.WEIGHTS)) - 1]
        return (grams[(*history, word)] + k * p(history[1:], word)) / (grams[history] + k)

    want = []
    for k, x in enumerate(texts):
        tokens = ["<s>", *x.split(), "</s>"]
        want.append((k, round(sum(math.log10(p(tuple(tokens[max(0, at - order + 1) : at]), tokens[at])) for at in range(1, len(tokens))), 6)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted((x.doc_id, round(x.score, 6)) for x in lm_score.score_documents(docs, order).collect()) == want


def test_quality(spark, docs, empty):
    r = random.Random(2)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in g.split()) for g in good]
    data = [(k, x) for k, x in enumerate(y for p in zip(good, bad) for y in p)]
    labelled = spark.createDataFrame([(k, 1 - k % 2) for k, _ in data], "doc_id long, quality int")
    d = spark.createDataFrame(data, "doc_id long, text string")
    model = quality.fit(d, labelled)
    got = quality.score_documents(d, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.held_out) and any(r.held_out for r in got)
    scored = quality.score_documents(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_documents(empty, model).count() == 0
    assert quality.keep_good(d, model).columns == d.columns
    again = quality.fit(d.unionByName(d).unionByName(d), labelled)  # rows that repeat an id count once
    assert (again.weight == model.weight).all() and again.bias == model.bias
    none = quality.fit(empty, labelled.limit(0))
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}


def test_pii(docs, empty, rows):
    text = "a@b.com_x@y.z 1.2.3.4.5 999.1.1.1 x 4111 1111 1111 1111 +1 (988) 555-2485 é +12 3"
    base, every = pii.all_spans(text)
    assert pii.listed(base) == "email:0:7,email:7:13,ip:14:21,card:36:55,phone:56:73"
    assert set(base) <= set(every)
    assert pii.redact_text(text).startswith("[EMAIL][EMAIL] [IP].5 ")
    assert [k for _, _, k in pii.all_spans("call (555) 123-4567 now")[1]] == ["phone"]
    assert [k for _, _, k in pii.all_spans("write to john (at) example dot com")[1]] == ["email"]
    assert pii.all_spans("order 123456789 in 2020, version 1.2.3, at noon. Then")[1] == []
    assert len(pii.all_spans("1" * 50_000 + "." * 10 + "@" * 1000)[1]) == 0
    assert pii.find(docs).count() == len(rows) and pii.find(empty).count() == 0
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.filter("text is null").count() == 1 and red.filter("text like '%@y.org%'").count() == 0


def test_pii_of_a_long_text_keeps_what_each_part_has():
    part = "mail a@b.com or call (555) 123-4567, card 4111 1111 1111 1111 from 10 . 0 . 0 . 7 on order 123456789. "
    base, every = pii.all_spans(part)
    assert len(every) > len(base) >= 2
    many = 4000
    long_base, long_every = pii.all_spans(part * many)
    assert long_base == [(a + k * len(part), b + k * len(part), kind) for k in range(many) for a, b, kind in base]
    assert long_every == [(a + k * len(part), b + k * len(part), kind) for k in range(many) for a, b, kind in every]


def test_pii_model_on_a_fresh_draw():
    drawn = [(pii.describe(x, s), s[2], y) for x, s, y in pii.drawn(77, 1200)]
    for kind, (model, threshold) in pii.trained().items():
        x, y = np.array([f for f, k, _ in drawn if k == kind], float), np.array([v for _, k, v in drawn if k == kind])
        hit = model.score(x) >= threshold
        assert hit[y].mean() > 0.9 and hit[~y].mean() < 0.05


def test_attribution(docs, empty, rows, tok):
    want = []
    for i, x, *_ in rows:
        spans = [(a, b) for a, b in tok.encode(x or "", add_special_tokens=False).offsets]
        lines, at = [], 0
        for line in (x or "").splitlines(keepends=True) if "\x1c" not in (x or "") else []:
            lines.append((at, at + len(line)))
            at += len(line)
        for k, (a, b) in enumerate(lines):
            want.append((i, k, a, b, sum(a <= s < b for s, _ in spans), len(spans)))
    got = [(r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens, r.doc_tokens) for r in attribution.count_sections(docs, JSON).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert attribution.count_sections(empty, JSON).count() == 0
    s, e = np.array([0, 3, 6]), np.array([3, 6, 9])
    b, f = np.array([0, 5]), np.array([4, 9])
    assert attribution.attribute(s, e, b, f, "start").tolist() == [0, 0, 1]
    assert attribution.attribute(s, e, b, f, "end").tolist() == [0, 1, 1]
    assert attribution.attribute(s, e, b, f, "majority").tolist() == [0, 0, 1]


def test_html(spark):
    page = """<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id="cookie-notice">Cookies</div><div class=wrap><h1>Title</h1><div class="content">
    <p>First &amp; para <em>em</em> text,\n with length enough to count.<br>Second<p>Another para with <a href=q>a link</a> in it, long enough.<ul><li>one<li>two</ul></div>
    <div class=comments><p>Nice post by someone who writes a lot of words here</p></div></div><div class="sidebar"><p>Side</p></div><form>Name</form><script>x</script><footer>Foot</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain &lt;b"), (5, "u", "<p>a<p>b"), (5, "u", "<p>a<p>b"), (6, "u", "<div><p>" * 3000 + "deep"), (7, "u", "<nav>only</nav>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).orderBy("page_id").collect()
    assert [r.text for r in got] == ["Title\n\nFirst & para em text, with length enough to count. Second\n\nAnother para with a link in it, long enough.\n\none\n\ntwo", "", "", "plain <b", "a\n\nb", "a\n\nb", "deep", ""]
    assert all(r.n_chars == len(r.text) for r in got)


def simple_fingerprint(x):
    words = (x or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def test_simhash(docs, empty, rows):
    prints = [simple_fingerprint(x) for _, x, *_ in rows]
    n, root = len(rows), list(range(len(rows)))
    for _ in range(n):
        before = list(root)
        for a in range(n):
            for b in range(n):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = min(root[a], root[b])
        if before == root:
            break
    least = {r: min((rows[k][0] for k in range(n) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    want = [(rows[k][0], f"{prints[k]:016x}", least[root[k]]) for k in range(n)]
    assert by_id(simhash.link_documents(docs)) == sorted(want, key=repr)
    assert simhash.link_documents(empty).count() == 0
    kept = near_copies.drop(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(jaccard_groups([x for _, x, *_ in rows])))


@pytest.mark.parametrize("bits, most", [(1, 4096), (3, 4096), (3, 8)])
def test_simhash_links_lose_nothing(spark, bits, most):
    r = random.Random(bits)
    centres = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    prints = {c for c in centres}
    for c in centres[:20]:
        for _ in range(60 if c == centres[0] else 6):
            x = c
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    points = sorted(prints)
    label = {p: p for p in points}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in points:
        for b in points:
            if a < b and (a ^ b).bit_count() <= bits:
                label[max(top(a), top(b))] = min(top(a), top(b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp long"), bits, most)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups, want = {}, {}
    for p in points:
        groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
        want.setdefault(top(p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_packing(docs, empty, rows, tok):
    ids = Counter((i, tuple([*tok.encode(x or "", add_special_tokens=False).ids, 1])) for i, x, *_ in rows)
    got = packing.pack(docs, JSON, RANKS, shard_bytes=5000).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at & (at - 1) == 0 and at <= 2048
    want = Counter((i, len(t)) for (i, t), n in ids.items() for _ in range(n))
    assert sum(n * len(t) for (_, t), n in ids.items()) == sum(r.length for r in got)
    assert {(r.doc_id, r.doc_tokens) for r in got} == set(want)
    of = dict(ids.keys())
    assert all(zlib.crc32(np.array(of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack(empty, JSON, RANKS).count() == 0


def test_bm25_prefers_shared_rare_terms():
    docs = [np.array(x) for x in ([5, 6, 7], [5, 6, 8], [9, 10, 11], [12, 13, 7], [14], [15], [16], [17])]
    assert packing.Index(docs).neighbours(0).tolist()[:2] == [0, 1]


@pytest.mark.parametrize("scale, shard_rows", [(1.0, 50), (1e13, 200), (1.0, 8192)])
def test_top_k(spark, scale, shard_rows):
    r = np.random.default_rng(3)
    vectors = [(k, (r.normal(size=6) * scale).tolist()) for k in range(700)]
    vectors += [(k, [0.5 * scale] * 6) for k in range(700, 760)] + [(800, None), (801, [float("nan")] * 6), (802, [None] * 6), (803, [float("inf")] * 6), (900, []), (None, [1.0] * 6), (701, [0.25] * 6), (100, [0.1 * scale] * 6), (200, vectors[200][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), shard_rows=shard_rows).collect()
    whole = [(k, [math.floor(1024 * x) for x in v]) for k, v in vectors if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in whole:
        if q % 100 == 0:
            best = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), k) for k, b in whole if k != q))[:10]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_exact_dedup(docs, empty, rows):
    norm = lambda x: (x or "").encode().lower()
    groups = {}
    for i, x, *_ in rows:
        groups.setdefault(norm(x), []).append(i)
    want = []
    for i, x, *_ in rows:
        best = max((k for k in groups[norm(x)] if k is not None), default=None)
        want.append((i, best, len(groups[norm(x)]), i == best, hashlib.sha256(norm(x)).hexdigest()))
    for most in (2, 1000):
        assert by_id(exact_dedup.resolve(docs, most=most)) == sorted(want, key=repr)
        kept = exact_dedup.drop_copies(docs, most=most)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.resolve(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_heavy_candidates_hold_every_heavy_digest(spark):
    data = [b"hot"] * 400 + [b"warm"] * 150 + [f"{k}".encode() for k in range(450)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "doc_id long, digest binary").repartition(40)
    found = {bytes(r.digest) for r in exact_dedup.heavy_candidates(df, most=9, fan_in=4).collect()}
    assert {b"hot", b"warm"} <= found and len(found) <= 9


def test_pipeline(spark):
    import corpus_pipeline

    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == start.columns
        after = common.stored(after, name)
        if name == "exact_dedup":
            assert after.count() == len({(r.text or "").encode().lower() for r in docs.collect()})
        if name == "simhash":
            before = sorted((r.doc_id, r.text) for r in docs.collect())
            least = {}
            for (i, _), group in zip(before, jaccard_groups([x for _, x in before])):
                least.setdefault(group, i)
            assert {r.doc_id for r in after.collect()} == set(least.values())
        docs = after
    left = {r.doc_id: r.text for r in docs.collect()}
    tok = Tokenizer.from_file(JSON)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(left)
    assert sum(r.length for r in pieces) == sum(len(tok.encode(x, add_special_tokens=False).ids) + 1 for x in left.values())
    assert json.dumps(sorted({r.doc_tokens for r in pieces}))


def test_near_copies_of_null_and_repeated_ids(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, c), (7, c + " "), (5, b + " x"), (9, d), (9, text()), (9, text()), (9, d)]
    kept = near_copies.drop(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(kept) == sorted({(1, a), (5, b + " x"), (7, c + " "), (9, d), *rows[7:9]}, key=repr)


def test_near_copies_in_blocks(spark):
    """Groups whose smallest member is near to none of the others, in several blocks."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(200)]
        for k in range(40):  # changes at places of its own, so most pairs lie about 0.8
            y = list(base)
            for at in r.sample(range(200), 3 + k % 6):
                y[at] = word()
            texts.append(" ".join(y))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = jaccard_groups(texts)
    for size in (5000, 1 << 24):
        roots = {x.doc_id: x.root for x in near_copies.decide(docs, block_bytes=size).collect()}
        assert len(set(zip(groups, (roots[k] for k in range(len(texts)))))) == len(set(groups)) == len(set(roots.values()))


def jaccard_groups(texts):
    """Brute force: the groups that pairs of five-word similarity 0.8 or more connect, as smallest places."""
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def test_pipeline_drops_planted_near_copies(spark):
    import corpus_pipeline

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    own = [[word() for _ in range(r.choice((64, 90, 300)))] for _ in range(60)]
    hot = [word() for _ in range(80)]
    texts = [" ".join(x) for x in own] + [None, "", " ", "two words", "Two  words"]
    for k, x in enumerate(own):
        for _ in range(1 + k % 3):  # one to eight changed words: on both sides of 0.8
            y = list(x)
            for at in r.sample(range(len(y)), 1 + k % 8):
                y[at] = word()
            texts.append(" ".join(y))
    for _ in range(120):
        y = list(hot)
        y[r.randrange(80)] = word()
        texts.append(" ".join(y))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SF)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(jaccard_groups(texts)))
    assert near_copies.drop(docs.limit(0)).count() == 0


def test_packing_neighbours_meet_across_shards(spark):
    r = random.Random(9)
    pool = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea kid body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()
    topics = r.sample([(a, b, c) for a in pool[:40] for b in pool[40:70] for c in pool[70:]], 150)
    texts = [" ".join(r.choice(topic) for _ in range(60)) for topic in topics for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shard = {x.doc_id: x.sequence_id >> 32 for x in packing.pack(docs, JSON, RANKS, shard_bytes=5000).collect()}
    assert len(set(shard.values())) > 10
    assert sum(shard[2 * k] == shard[2 * k + 1] for k in range(150)) > 75
    held = packing.tokenised(common.id_and_text(docs), JSON, RANKS)
    whole, parted = packing.Corpus.of([packing.encode(JSON, RANKS, x + "<|endoftext|>") for x in texts]), packing.statistics(held)
    assert parted.n == 300 and parted.mean > 0 and parted.df[packing.END] == 300 and whole.n == parted.n


@pytest.mark.parametrize(
    "text, want",
    [
        ("192.168.1.10 555-123-4567", "[IP] [PHONE]"),
        ("555-123-4567 555-987-6543", "[PHONE] [PHONE]"),
        ("2024-01-02 555-123-4567", "2024-01-02 [PHONE]"),
        ("4111 1111 1111 1111 5500 0000 0000 0004", "[CARD] [CARD]"),
        ("4111 1111 1111 1111 555-123-4567", "[CARD] [PHONE]"),
        ("tel 555 123 4567 555 987 6543", "tel [PHONE] [PHONE]"),
        ("phone: 555.123.4567 / 555.987.6543", "phone: [PHONE] / [PHONE]"),
        ("order 2024-01-02 2024-03-05", "order 2024-01-02 2024-03-05"),
    ],
)
def test_pii_of_numbers_side_by_side(text, want):
    assert pii.redact_text(text) == want


def test_html_noise_without_its_end_tag():
    for page in (
        '<article><p class="ad">Buy<p>One</p><p>Two</p></article>',
        '<article><p>One</p><p class="ad">Buy</article><p>Two</p>',
        "<div><ul><li class=ad>Buy<li>One<li>Two</ul></div>",
        '<article><p>One</p><div class="ad">Buy<p>More</article><article><p>Two</p></article>',
        "<table><tr><td class=ad>Buy<td>One<tr><td>Two</table>",
        "<div><p>One<noscript><div>Buy</div></noscript><p>Two</div>",
    ):
        assert html_text.blocks_of([html_text.parse(page)]) == ["One", "Two"], page
    assert html_text.main_text('<article><p class="ad">Buy<p>One</p><p>Two</p></article>') == "One\n\nTwo"


def test_html_wrappers_named_like_noise_keep_the_page():
    body = "<h1>Title</h1><p>One paragraph that is long enough to count as text.</p><p>Two</p>"
    want = "Title\n\nOne paragraph that is long enough to count as text.\n\nTwo"
    for a, b in (
        ('<div class="content has-sidebar"><article>', '</article><div class="sidebar"><p>Side text here</p></div></div>'),
        ('<div class="post comments-open">', '<div class="comments"><p>Nice post</p></div></div>'),
        ('<div class="page-sidebar"><div id="main-widget"><main>', '</main></div></div><div class="related"><article>Teaser</article></div>'),
    ):
        assert html_text.main_text(f"<body>{a}{body}{b}</body>") == want, a
    bare = '<div id=logo><h1>Site</h1></div><div class="post comments-open"><p>Long text without a heading, but most of the page.</p></div>'
    assert "most of the page" in html_text.main_text(bare)
    comments = '<article><p>Short text.</p></article><div class="comments"><article class="comment"><p>A comment much longer than the text of the page itself.</p></article></div>'
    assert html_text.main_text(comments) == "Short text."


def test_html_keeps_bare_text_beside_the_content():
    page = '<body>Lead <b>text</b> first<div><p>Ok</p><div><p>One paragraph that is long enough to be the content.</p><p>Another one that is long enough to be so.</p></div>tail <i>words</i></div><a href=x>Home</a> <a href=y>Next</a></body>'
    assert html_text.main_text(page) == "Lead text first\n\nOk\n\nOne paragraph that is long enough to be the content.\n\nAnother one that is long enough to be so.\n\ntail words"


def test_heavy_candidates_part_their_levels_by_shuffles(spark):
    df = spark.createDataFrame([(k, b"%d" % (k % 7)) for k in range(100)], "doc_id long, digest binary").repartition(40)
    plan = exact_dedup.heavy_candidates(df, most=9, fan_in=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 4 and "Coalesce" not in plan  # 40 partitions, then 10, 3 and 1


def test_html_of_malformed_pages_takes_linear_time():
    began = time.time()
    for part in ("<a", "<a ", '<a "', "<!--", "<a 'x\">", "<header>", "<span><p>", "<b><div></b>", "<ul><li>", "<div class=ad>", "</p>", "<p><table>", "<", '<div id="', "&", "<script>"):
        html_text.main_text(part * (100_000 // len(part)))
    assert time.time() - began < 16


def test_html_names_of_noise():
    for name in ("ad", "site-header", "cookie-notice", "sidebarLeft", "post-comments", "share buttons", "main_nav", "page-footer", "newsletter-signup"):
        assert any(map(html_text.names_noise, name.split())), name
    for name in ("has-sidebar", "with-header", "widget-content", "article-header", "notice-period", "comments-open", "address", "no-ads", "shared-memory"):
        assert not any(map(html_text.names_noise, name.split())), name


def test_html_tags_end_outside_quotes():
    found = list(html_text.tags_of('<p title="a>b" x=\'c>\'>t</P ><!-- <b> --><!doctype x><br/>< 5 <i x="y>z'))
    assert [(t[2], t[3]) for t in found] == [("p", False), ("p", True), ("", False), ("", False), ("br", False), ("i", False)]
    assert html_text.main_text('<p>One <a href="x>two</a> three') == "One two three"


def density_by_hand(node):
    """(chars, tags, link chars, links) of a node, by recursion."""
    kids = [k for k in node.content if isinstance(k, html_text.Node)]
    below = [density_by_hand(k) for k in kids]
    chars = sum(len(" ".join(c.split())) for c in node.content if isinstance(c, str)) + sum(b[0] for b in below)
    return chars, sum(b[1] + 1 for b in below), chars if node.tag == "a" else sum(b[2] for b in below), sum(b[3] + (k.tag == "a") for k, b in zip(kids, below))


def test_html_density_equals_its_formula(spark):
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(10).collect():
        root = html_text.parse(page)
        nodes = html_text.in_order(root)
        html_text.weigh(nodes)
        c0, _, l0, _ = density_by_hand(root)
        for n in nodes:
            c, t, lc, lt = density_by_hand(n)
            if not c:
                assert n.density == 0
                continue
            t, l1, lt = max(t, 1), max(lc, 1), max(lt, 1)
            want = c / t * math.log(max(c / l1 * t / lt, 1.0000001), c / max(c - lc, 1) * lc + l0 / max(c0, 1) * c + math.e)
            assert math.isclose(n.density, want, rel_tol=1e-9)
        # the largest sum is the node whose text is taken whole
        best = max((n for n in nodes if n.tag in html_text.BLOCK), key=lambda n: n.total)
        assert "\n\n".join(html_text.blocks_of([best])) in html_text.main_text(page)


def test_packing_encodes_what_the_faster_library_refuses(tok):
    for text in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "a" * 300_000, "."):
        assert packing.encode(JSON, RANKS, text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_top_k_asks_only_cells_that_can_matter(spark):
    """Clusters far apart: the boxes of most cells lie below the kth score."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(16, 8)) * 5
    points = np.floor(1024 * (centres[np.arange(4000) % 16] + r.normal(size=(4000, 8)) * 0.1))
    cells = topk.Cells.fit(points[:1000], 4)
    at = cells.of(points)
    low, high = (np.array([f(points[at == c], 0) for c in range(16)]) for f in (np.min, np.max))
    bounds = topk.Boxes(np.arange(16), np.arange(16), np.ones(16, int), low, high).bounds(points[::100])
    scores = points[::100] @ points.T
    kth = np.sort(scores, 1)[:, -11]
    assert all((scores[:, at == c].max(1) <= bounds[:, c]).all() for c in range(16))
    assert (bounds >= kth[:, None]).mean() < 0.5


def plain_buckets(text):
    """Features of the quality model by plain loops."""
    mask, log2, odd = (1 << 64) - 1, quality.BUCKETS_LOG2, int(quality.ODD)
    text = "".join(" " if c == " " or "\t" <= c <= "\r" else c for c in text)
    out, hashes = [], []
    for word in text.split(" "):
        if word:
            h = sum(ord(c) * quality.Powers.base**k for k, c in enumerate(word)) & mask
            hashes.append(h)
            out.append(((h ^ h >> 29) * odd & mask) >> 64 - log2)
    for a, b in zip(hashes, hashes[1:]):
        h = (a * 0xD6E8FEB86659FD93 & mask) ^ b
        out.append(1 << log2 if a == b else ((h ^ h >> 32) * odd & mask) >> 64 - log2)
    padded = f" {text} " if text else ""
    for n in (2, 3, 4):
        for k in range(len(padded) - n + 1):
            gram = padded[k : k + n]
            if " " in gram[1:-1] or n == 2 and gram == "  ":
                continue
            code = (ord(gram[0]) << 16) ^ ord(gram[1])
            for c in gram[2:]:
                code = (code * 0x100000001B3 & mask) ^ ord(c)
            out.append((((code * odd + n) & mask) * odd & mask) >> 64 - log2)
    return Counter(out)


def test_quality_scores_by_plain_loops(spark, docs, rows):
    for _, x, *_ in rows:
        assert Counter(quality.features(x or "").tolist()) == plain_buckets(x or ""), x
    labelled = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, 1) for k in range(10_000, 12_000)], "doc_id long, quality int")
    model = quality.fit(docs, labelled, most=100)
    trained = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    assert model.bias != 0 and len(trained) < 100  # labels without a document don't use up the bound
    for r in quality.score_documents(docs, model).collect():
        texts = [x or "" for i, x, *_ in rows if i == r.doc_id]
        wanted = []
        for x in texts:
            found = plain_buckets(x)
            z = model.bias + (sum(float(model.weight[b]) * c for b, c in found.items()) / sum(found.values()) if found else 0.0)
            wanted.append(1 / (1 + math.exp(-z)))
        assert any(abs(r.score - w) < 1e-6 for w in wanted) and r.predicted == (r.score >= 0.3)
