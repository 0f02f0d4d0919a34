"""Many names in many texts: which names a text holds, and where, the longest match first.

Up to a size that is counted, not guessed, the names go to the tasks as one automaton that reads a text once, whatever their
number. Beyond it they are joined: each name is asked for by its rarest n-gram only, so a text meets the few names that share
one with it, and the name's place is then verified. Both ways give the same rows.

Names and texts are compared in small letters. Where a text is parted into names (`find`), of matches that overlap the leftmost
stays, of those that begin together the longest; where names are counted (`counts`), each is counted for itself. A null or empty
name or text has no matches; a name that comes twice is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: Names, and their characters in all, up to which an automaton is sent to the tasks.
MOST_NAMES, MOST_CHARS = 200_000, 4_000_000
#: Length of the n-grams that names are joined by; shorter names always go by automaton, as there are few of them.
GRAM = 6


def leftmost_longest(found: list[tuple[int, int, str]]) -> list[tuple[str, int]]:
    """(name, at) of matches (at, end, name) that don't overlap, from left to right."""
    out, free = [], 0
    for at, end, name in sorted(found, key=lambda x: (x[0], -x[1])):
        if at >= free:
            out.append((name, at))
            free = end
    return out


def _scanned(texts: DataFrame, names: list[str], id_type: str) -> DataFrame:
    """(id, at, end, name) of all matches, by an automaton."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        if names:
            automaton.make_automaton()
        for frame in frames:
            rows = []
            for i, text in zip(frame["id"], frame["text"]):
                if names and text:
                    rows += [(i, end + 1 - len(name), end + 1, name) for end, name in automaton.iter(text)]
            yield pd.DataFrame(rows, columns=["id", "at", "end", "name"])

    return texts.mapInPandas(run, f"id {id_type}, at int, end int, name string")


def _grams(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(x) - GRAM + 1), lambda k: F.substr(x, k, F.lit(GRAM)))


def _joined(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, at, end, name) of all matches of names of GRAM characters or more, by their rarest n-gram among the texts' own n-grams."""
    each = names.select("name", F.posexplode(_grams(c("name"))).alias("place", "gram"))
    held = texts.filter(F.char_length("text") >= GRAM).select("id", F.explode(F.array_distinct(_grams(c("text")))).alias("gram"))
    # how many texts have an n-gram, of those that names ask for; a name with one that none has is in no text
    asked = held.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(asked, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).filter("x.n > 0").select("name", "x.gram")
    met = held.join(rarest, "gram").select("id", "name").join(texts, "id")
    return met.select("id", "name", F.explode(_places(c("text"), c("name"))).alias("at")).select("id", c("at").cast("int").alias("at"), (c("at") + F.char_length("name")).cast("int").alias("end"), "name")


def _places(text: Column, name: Column) -> Column:
    """Where a name begins in a text: the places of its first n-gram at which all of it stands."""
    first = F.substr(name, F.lit(1), F.lit(GRAM))
    at = F.filter(F.transform(_grams(text), lambda g, k: F.when(g == first, k)), lambda k: k.isNotNull())
    return F.filter(at, lambda k: F.substr(text, k + 1, F.char_length(name)) == name)


def _all(texts: DataFrame, known: DataFrame, id_type: str, small: bool, most_names: int) -> DataFrame:
    """All matches of known (name) in texts (id, text); small says that all names fit into an automaton."""
    if small:
        return _scanned(texts, [r[0] for r in known.collect()], id_type)
    short = known.filter(F.char_length("name") < GRAM)
    if short.count() > most_names:
        raise ValueError(f"more than {most_names} names of under {GRAM} characters")
    return _scanned(texts, [r[0] for r in short.collect()], id_type).unionByName(_joined(texts, known.filter(F.char_length("name") >= GRAM)))


def _matches(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, most_names: int, most_chars: int) -> tuple[DataFrame, str]:
    """(id, at, end, name) of all matches, those that overlap too, and the type of id."""
    plain = texts.select(c(id_col).alias("id"), F.lower(text_col).alias("text")).filter("text <> ''")
    known = names.select(F.lower(name_col).alias("name")).filter("name <> ''").distinct()
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.char_length("name")), F.lit(0))).first()
    id_type = plain.schema["id"].dataType.simpleString()
    return _all(plain, known, id_type, n <= most_names and chars <= most_chars, most_names), id_type


def counts(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, most_names: int = MOST_NAMES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, name, n, first_at): each name for itself, whatever other names overlap it: how often it occurs from left to right, and where first.

    Of one name's occurrences that overlap the leftmost counts. Ids are unique.
    """
    every, _ = _matches(texts, names, id_col, text_col, name_col, most_names, most_chars)
    places = every.groupBy(c("id").alias(id_col), "name").agg(F.array_sort(F.collect_list("at")).alias("places"))
    start = F.struct(F.lit(0).alias("free"), F.lit(0).cast("long").alias("n"))
    step = lambda a, at: F.when(at >= a["free"], F.struct((at + F.char_length("name")).alias("free"), (a["n"] + 1).alias("n"))).otherwise(a)
    return places.select(id_col, "name", F.aggregate("places", start, step)["n"].alias("n"), F.get("places", 0).alias("first_at"))


def find(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, most_names: int = MOST_NAMES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, name, at): the names in each text, leftmost and longest first; ids are unique, at counts characters before the name."""
    every, id_type = _matches(texts, names, id_col, text_col, name_col, most_names, most_chars)

    def chosen(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kept = leftmost_longest(list(zip(frame["at"], frame["end"], frame["name"])))
        return pd.DataFrame({"id": [key[0]] * len(kept), "name": [k for k, _ in kept], "at": [a for _, a in kept]})

    return every.groupBy("id").applyInPandas(chosen, f"id {id_type}, name string, at int").withColumnRenamed("id", id_col)


def configured(rows: DataFrame, known: DataFrame, name_col: str, key_col: str, order_col: str) -> DataFrame:
    """rows with the known entry that a maker's name stands for: the same name first, else the first entry that holds it or that it holds; null for none.

    known is a dictionary of makers, each with a place (order_col). Keys that a name holds are found all at once (`find`);
    names that a key holds are the other way round, and few, as both are short.
    """
    own = rows.select(c(name_col).alias("_raw"), F.lower(F.trim(name_col)).alias("_name")).filter("_name <> ''").distinct()
    keys = known.select(F.lower(key_col).alias("_key"), c(key_col).alias("_as"), c(order_col).alias("_order"))
    distinct_names = own.select("_name").distinct()
    holds = _every(distinct_names, keys.select("_key").distinct(), "_name", "_key").select(c("text").alias("_name"), c("part").alias("_key"))
    held = _every(keys.select("_key").distinct(), distinct_names, "_key", "_name").select(c("part").alias("_name"), c("text").alias("_key"))
    best = holds.unionByName(held).distinct().join(keys, "_key").groupBy("_name").agg(F.min(F.struct((c("_key") != c("_name")).alias("other"), "_order", "_as")).alias("x")).select("_name", c("x._as").alias("known"))
    return rows.join(own.join(best, "_name").select(c("_raw").alias(name_col), "known"), name_col, "left")


def _every(texts: DataFrame, parts: DataFrame, text_col: str, part_col: str) -> DataFrame:
    """(text, part) of every part that lies within a text, overlapping ones too."""
    plain = texts.select(c(text_col).alias("id"), c(text_col).alias("text"))
    known = parts.select(c(part_col).alias("name"))
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.char_length("name")), F.lit(0))).first()
    found = _all(plain, known, "string", n <= MOST_NAMES and chars <= MOST_CHARS, MOST_NAMES)
    return found.select(c("id").alias("text"), c("name").alias("part")).distinct()
