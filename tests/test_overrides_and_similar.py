"""The override log against a step-by-step editor with snapshots; the similarity join against all pairs."""

import copy
import hashlib
import random

import pytest

from shelfwise.operators import overrides, similar


class Editor:
    """Families edited one action at a time; an undo puts the snapshot back."""

    def __init__(self, members):
        self.at, self.moved, self.stack = dict(members), set(), []

    def act(self, action, key=None, source=None, target=None, keys=()):
        if action == "undo":
            if self.stack:
                self.at, self.moved = self.stack.pop()
            return
        self.stack.append((copy.copy(self.at), set(self.moved)))
        if action == "split" and target != "standalone":
            target = "FAM-" + hashlib.sha256(f"manual-split-{source}-{'-'.join(sorted(set(keys)))}".encode()).hexdigest()[:16]
        carried = [key] if action == "move" else list(keys) if action == "split" else [k for k, f in self.at.items() if f == source]
        for k in carried:
            self.at[k] = None if target == "standalone" else target
            self.moved.add(k)


def script(r, members):
    """A log of accepted actions and undos, and the editor after it."""
    editor, log = Editor(members), []
    for seq in range(r.randrange(60)):
        families = sorted({f for f in editor.at.values() if f})
        action = r.choices(["move", "merge", "split", "undo"], [3, 4, 3, 4])[0]
        row = {}
        if action == "move":
            key = r.choice(sorted(editor.at))
            row = {"key": key, "source": editor.at[key] or "standalone", "target": r.choice([*families, "standalone"])}
        elif action == "merge" and len(families) > 1:
            row = dict(zip(("source", "target"), r.sample(families, 2)))
        elif action == "split" and families:
            fam = r.choice(families)
            inside = sorted(k for k, f in editor.at.items() if f == fam)
            row = {"source": fam, "target": r.choice(["standalone", "new_family"]), "keys": r.sample(inside, r.randrange(1, len(inside) + 1))}
        elif action != "undo":
            continue
        editor.act(action, **row)
        log.append((seq, action, row.get("key"), row.get("source"), row.get("target"), row.get("keys")))
    return editor, log


def test_log_equals_an_editor_with_snapshots(spark):
    r = random.Random(8)
    members, log, want = [], [], []
    for k in range(60):
        session, own = f"s{k}", [(str(x), r.choice([f"F{x % 5}", f"F{x % 3}", None])) for x in range(12)]
        editor, steps = script(r, own)
        members += [(session, *x) for x in own]
        log += [(session, *x) for x in steps]
        want += [(session, key, fam, key in editor.moved) for key, fam in editor.at.items()]
    log += [("lone", 1, "undo", None, None, None, None), ("lone", 2, "merge", None, "A", "B", None), ("lone", 3, "undo", None, None, None, None), ("lone", 4, "undo", None, None, None, None), ("lone", 5, "merge", None, "A", "C", None)]
    members.append(("lone", "x", "A"))
    want.append(("lone", "x", "C", True))
    done = overrides.settled(spark.createDataFrame(members, "session string, key string, family_id string"), spark.createDataFrame(log, overrides.LOG).repartition(3))
    text = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert text(done.select("session", "key", "family_id", "moved").collect()) == text(want)


def test_long_chains_of_merges(spark):
    log = [("s", k, "merge", None, f"F{k}", f"F{k + 1}", None) for k in range(100)] + [("s", 200, "split", "named", "F100", "new_family", ["a"]), ("s", 201, "undo", None, None, None, None), ("s", 202, "split", None, "F100", "new_family", ["b"])]
    members = spark.createDataFrame([("s", "a", "F0"), ("s", "b", "F50"), ("s", "c", None), ("t", "a", "F0")], "session string, key string, family_id string")
    log = spark.createDataFrame(log, overrides.LOG)
    new = overrides.made_by_splits(log).collect()
    assert [(x.name, x.reason, x.review_required) for x in new] == [("F100 (splittet)", "Manuelt splittet fra F100", True)]
    got = {(x.session, x.key): (x.family_id, x.moved) for x in overrides.settled(members, log).collect()}
    assert got == {("s", "a"): ("F100", True), ("s", "b"): (new[0].family_id, True), ("s", "c"): (None, False), ("t", "a"): ("F0", False)}
    assert overrides.settled(members, log.limit(0)).filter("moved").count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_texts_equal_all_pairs(spark, threshold, monkeypatch):
    monkeypatch.setattr(similar, "TOGETHER", 3)
    r = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    make = lambda: " ".join(r.choice(words[: r.choice([4, 10, 30])]) for _ in range(r.randrange(1, 14)))
    left = [(k, make()) for k in range(120)] + [(200, None), (201, " "), (202, "W1 w1\tw2"), (202, "w2 w1")]
    right = [(k, make()) for k in range(80)] + [(300, None), (301, "w1 W2"), *[(400 + k, left[k][1]) for k in range(5)]]
    sets = lambda x: set((x or "").lower().split())
    want = sorted((i, j, len(sets(a) & sets(b)) / len(sets(a) | sets(b))) for i, a in left for j, b in right if sets(a) and sets(b) and len(sets(a) & sets(b)) / len(sets(a) | sets(b)) >= threshold)
    done = similar.similar_texts(spark.createDataFrame(left, "i long, text string"), spark.createDataFrame(right, "j long, text string"), threshold, "i", "j")
    assert sorted(map(tuple, done.collect())) == want and want


def test_similar_texts_of_no_rows(spark):
    none = spark.createDataFrame([], "i long, text string")
    assert similar.similar_texts(none, none.withColumnRenamed("i", "j"), 0.5, "i", "j").count() == 0


def test_merges_are_neither_gathered_nor_broadcast(spark):
    members = spark.createDataFrame([("s", "1", "A"), ("s", "2", "B"), ("s", "3", None)], "session string, key string, family_id string")
    merge = lambda seq, a, b: ("s", seq, "merge", None, a, b, None)
    log = spark.createDataFrame([merge(1, "A", "B"), merge(2, "B", "C"), merge(3, "A", "D"), ("s", 4, "move", "2", "C", "A", None), merge(5, "A", "E"), merge(6, "C", "F")], overrides.LOG)
    done = overrides.settled(members, log)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "collect_list" not in plan
    assert sorted(map(tuple, done.collect())) == [("s", "1", "F", True), ("s", "2", "E", True), ("s", "3", None, False)]


def test_words_of_one_side_only_are_not_joined(spark):
    sets = spark.createDataFrame([("l", "a", ["x", "y", "z"]), ("r", "b", ["y", "z", "w"])], "side string, set string, words array<string>")
    assert sorted((r.side, r.word, r.place) for r in similar.prefixes(sets, 0.5).collect()) == [("l", "y", 1), ("r", "y", 1)]
